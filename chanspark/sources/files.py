"""Files by path or URI: local ones by Python, others by Arrow's file systems."""

from __future__ import annotations

import glob
import os
from typing import BinaryIO
from urllib.parse import unquote, urlparse


def local(path: str) -> str | None:
    """The path of a local file, None for another file system."""
    if "://" not in path and not path.startswith("file:"):
        return path
    return unquote(urlparse(path).path) if path.startswith("file:") else None


def open_input(path: str) -> BinaryIO:
    if (own := local(path)) is not None:
        return open(own, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def listed(path: str) -> list[str]:
    """The measurement files that a path, folder or pattern stands for, in order of their names."""
    if (own := local(path)) is None:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        if system.get_file_info(inner).type == fs.FileType.File:
            return [path]
        scheme = path.split("://", 1)[0]
        found = system.get_file_info(fs.FileSelector(inner, recursive=True))
        return sorted(f"{scheme}://{f.path.lstrip('/')}" if scheme != "viewfs" else f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith((".mf4", ".mdf", ".dat")))
    if os.path.isdir(own):
        return sorted(os.path.join(d, x) for d, _, names in os.walk(own) if "_temporary" not in d for x in names if x.lower().endswith((".mf4", ".mdf", ".dat")))
    if os.path.exists(own):
        return [own]
    if found := sorted(glob.glob(own)):
        return found
    raise FileNotFoundError(path)

"""A file's metadata, whatever its version."""

from __future__ import annotations

import struct
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from .blocks3 import Parser3
from .blocks4 import Parser
from .files import open_input
from .model import Meta
from .naming import unique_names

#: Files whose metadata are read at once.
READERS = 16


def read_meta(path: str, documents: bool = True) -> Meta:
    """documents: also the bytes of attachments."""
    with open_input(path) as f:
        head = f.read(64)
        if len(head) < 64 or head[:3] not in (b"MDF", b"UnF"):
            raise ValueError(f"{path} is no measurement file")
        big = head[24:26] != b"\0\0" and head[8:9] == b"3"
        version = struct.unpack_from(">H" if big else "<H", head, 28)[0]
        meta = (Parser3(f, path) if version < 400 else Parser(f, path, documents)).parse()
    unique_names(meta)
    return meta


def read_metas(paths: list[str]) -> Iterator[Meta]:
    """Metadata of many files, without attachments, in order. Opening files is mostly waiting, so READERS are opened at once;
    no more than these are held beside the one in hand."""
    with ThreadPoolExecutor(READERS) as pool:
        ahead: deque = deque()
        left = iter(paths)
        for path in islice(left, READERS):
            ahead.append(pool.submit(read_meta, path, False))
        while ahead:
            yield ahead.popleft().result()
            for path in islice(left, 1):
                ahead.append(pool.submit(read_meta, path, False))

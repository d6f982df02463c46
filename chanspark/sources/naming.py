"""Unique channel names, in the order of the file."""

from __future__ import annotations

from .model import Channel, Group, Meta


def unique_names(meta: Meta) -> None:
    """Where a name is taken, whatever tells the channel apart is appended; at last its place in the file.

    Names are compared without regard to case, as Spark compares column names.
    """
    taken: set[str] = set()
    for g in meta.groups:
        for c in g.channels:
            name = c.name
            if name.lower() in taken:
                for extra in _extras(meta, g, c):
                    if extra:
                        name += f" {extra}"
                    if name.lower() not in taken:
                        break
                else:
                    name += f" {c.position}"
                    while name.lower() in taken:
                        name += "_"
            taken.add(name.lower())
            c.name = name


def _extras(meta: Meta, g: Group, c: Channel) -> list[str]:
    if meta.version < 400:
        return [c.ecu or c.message]
    parts = [c.source.name, c.source.path] if c.source else []
    parts.append(g.name)
    return parts + ([g.source.name, g.source.path] if g.source else [])

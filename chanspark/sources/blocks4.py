"""Metadata of MDF 4.x files: follows the links between blocks; data blocks are only located, not read."""

from __future__ import annotations

import hashlib
import struct
import zlib
import xml.etree.ElementTree as ET
from dataclasses import replace
from functools import reduce
from typing import BinaryIO

from .model import PIECE, Array, Attachment, Channel, Conversion, Event, Group, History, Meta, Segment, Source

#: Parts of CANopen dates and times: (name, byte, bit offset, bits).
DATE_PARTS = (("ms", 0, 0, 16), ("min", 2, 0, 6), ("hour", 3, 0, 5), ("day", 4, 0, 5), ("month", 5, 0, 6), ("year", 6, 0, 7))
TIME_PARTS = (("ms", 0, 0, 28), ("days", 4, 0, 16))
BIG_ENDIAN = {1, 3, 5, 9, 16}
#: What our list of places behind a compressed stream begins with at which decompression can begin; then their number, and of
#: each the bytes of data, the stored bytes, and the Adler sum of the data. The stream is whole without it.
RESTARTS = b"chanspark restarts\0\0\0\0\0\0"


class Block:
    def __init__(self, f: BinaryIO, at: int, body: bool = True):
        f.seek(at)
        head = f.read(24)
        if len(head) < 24:
            raise ValueError(f"the file ends inside the block at {at}")
        self.at, (self.id, self.length, n) = at, struct.unpack("<4s4xQQ", head)
        if self.id[:2] != b"##":
            raise ValueError(f"no block at {at}: {self.id!r}")
        self.links = struct.unpack(f"<{n}q", f.read(8 * n)) if n else ()
        self.body = f.read(self.length - 24 - 8 * n) if body else b""

    def unpack(self, form: str, at: int = 0) -> tuple:
        return struct.unpack_from("<" + form, self.body, at)


def xml_text(source: str) -> tuple[str, dict[str, str]]:
    """The comment of a metadata text and its named values: <e name="...">, and the tags beside the comment."""
    try:
        root = ET.fromstring(source.strip())
    except ET.ParseError:
        return source.strip(), {}
    text, values = "", {}
    for x in root.iter():
        tag = x.tag.rpartition("}")[2]
        if tag == "TX" and not text:
            text = (x.text or "").strip()
        elif tag == "e":
            values[x.get("name", "")] = (x.text or "").strip()
        elif x is not root and not len(x) and tag != "TX":
            values[tag] = (x.text or "").strip()
    return text, values


class Parser:
    def __init__(self, f: BinaryIO, path: str, documents: bool = True):
        self.f, self.path, self.documents = f, path, documents
        self.texts: dict[int, tuple[str, dict[str, str]]] = {}
        self.conversions: dict[int, Conversion | str | None] = {}
        self.sources: dict[int, Source | None] = {}

    def text(self, at: int) -> str:
        return self.both(at)[0]

    def both(self, at: int) -> tuple[str, dict[str, str]]:
        if not at:
            return "", {}
        if at not in self.texts:
            b = Block(self.f, at)
            own = b.body.split(b"\0", 1)[0].decode("utf-8", "replace")
            self.texts[at] = xml_text(own) if b.id == b"##MD" else (own, {})
        return self.texts[at]

    def source(self, at: int) -> Source | None:
        if at and at not in self.sources:
            b = Block(self.f, at)
            kind, bus = b.unpack("BB")
            self.sources[at] = Source(self.text(b.links[0]), self.text(b.links[1]), kind, bus)
        return self.sources.get(at)

    def conversion(self, at: int, seen: frozenset[int] = frozenset()) -> Conversion | str | None:
        """A conversion, or the text that stands in its place."""
        if not at or at in seen:
            return None
        if at not in self.conversions:
            b = Block(self.f, at)
            if b.id in (b"##TX", b"##MD"):
                return self.text(at)
            kind, _, _, n_refs, n_values = b.unpack("BBHHH")
            values = list(b.unpack(f"{n_values}Q" if kind == 11 else f"{n_values}d", 24))
            refs = [self.conversion(x, seen | {at}) for x in b.links[4 : 4 + n_refs]]
            formula = refs[0] if kind == 3 and refs and isinstance(refs[0], str) else ""
            self.conversions[at] = Conversion(4, kind, values, refs, formula, self.text(b.links[0]), self.text(b.links[1]))
        return self.conversions[at]

    def chain(self, at: int) -> tuple[list[Segment], list[Segment], bytes]:
        """Segments of a data stream and of its invalidation bytes, and the id of the block it begins with."""
        data: list[Segment] = []
        invalid: list[Segment] = []
        if not at:
            return data, invalid, b""
        first = b = Block(self.f, at, body=False)
        if b.id == b"##HL":
            b = Block(self.f, b.links[0], body=False) if b.links[0] else b
        if b.id not in (b"##DL", b"##LD"):
            return (self.segments(b.at), [], b.id) if b.id != b"##HL" else ([], [], b.id)
        kind = b.id
        while True:
            b = Block(self.f, b.at)
            links = b.links[1:]
            if kind == b"##LD" and b.unpack("I")[0] >> 31:
                data += [s for x in links[0::2] if x for s in self.segments(x)]
                invalid += [s for x in links[1::2] if x for s in self.segments(x)]
            else:
                data += [s for x in links if x for s in self.segments(x)]
            if not b.links[0]:
                return data, invalid, kind if first.id != b"##HL" else kind
            b = Block(self.f, b.links[0], body=False)

    def segments(self, at: int) -> list[Segment]:
        """A data block as one segment, or as those that decompression can begin at, if the block lists them."""
        b = Block(self.f, at, body=False)
        if b.id == b"##DZ":
            self.f.seek(at + 24)
            _, zip_type, param, size, stored = struct.unpack("<2sBxIQQ", self.f.read(24))
            return (self.restarts(b, stored) if zip_type == 0 else []) or [Segment(at + 48, size, stored, zip_type, param)]
        if b.id in (b"##DT", b"##DV", b"##SD", b"##DI", b"##RD", b"##RV", b"##RI"):
            return [Segment(at + 24, b.length - 24)]
        raise ValueError(f"unknown data block {b.id!r} at {at}")

    def restarts(self, b: Block, stored: int) -> list[Segment]:
        head = len(RESTARTS) + 8
        if b.length < 48 + stored + head:
            return []
        self.f.seek(b.at + 48 + stored)
        said = self.f.read(head)
        if said[:-8] != RESTARTS:
            return []
        pieces, at = struct.iter_unpack("<3I", self.f.read(12 * int.from_bytes(said[-8:], "little"))), b.at + 50
        out = []
        for size, own, adler in pieces:
            out.append(Segment(at, size, own, PIECE, adler))
            at += own
        return out

    def parse(self) -> Meta:
        self.f.seek(0)
        head = self.f.read(64)
        version = struct.unpack_from("<H", head, 28)[0]
        hd = Block(self.f, 64)
        start, tz, dst, flags = hd.unpack("QhhB")
        meta = Meta(self.path, version, head[16:24].split(b"\0")[0].decode("latin-1").strip(), start, tz, dst, flags)
        comment, values = self.both(hd.links[5])
        meta.comments = values | ({"comment": comment} if comment else {})
        at = hd.links[1]
        while at:
            b = Block(self.f, at)
            text, tags = self.both(b.links[1])
            meta.history.append(History(*b.unpack("Qhh"), text, tags))
            at = b.links[0]
        at = hd.links[3] if self.documents else 0
        while at:
            b = Block(self.f, at)
            meta.attachments.append(self.attachment(b))
            at = b.links[0]
        at = hd.links[4]
        while at:
            b = Block(self.f, at)
            kind, sync, range_, cause, eflags = b.unpack("5B")
            base, factor = b.unpack("qd", 16)
            meta.events.append(Event(self.text(b.links[3]), self.text(b.links[4]), kind, sync, range_, cause, eflags, base, factor, b.links[1], at))
            at = b.links[0]
        at, n = hd.links[0], 0
        masters: dict[int, int] = {}
        links: list[tuple[Group, int]] = []
        while at:
            dg = Block(self.f, at)
            self.data_group(dg, n, meta, masters, links)
            at, n = dg.links[0], n + 1
        for g, to in links:
            if to in masters and masters[to] != g.index:
                g.master_group = masters[to]
        return meta

    def attachment(self, b: Block) -> Attachment:
        flags, md5, size, stored = *b.unpack("H"), b.body[8:24], *b.unpack("QQ", 24)
        data = intact = None
        if flags & 1:
            data = b.body[40 : 40 + stored]
            if flags & 2:
                try:
                    data = zlib.decompress(data)
                except zlib.error:
                    data, intact = None, False
            if data is not None:
                intact = len(data) == size and (not flags & 4 or hashlib.md5(data).digest() == md5)
        return Attachment(self.text(b.links[1]), self.text(b.links[2]), self.text(b.links[3]), flags, md5.hex(), size, data, intact)

    def data_group(self, dg: Block, n: int, meta: Meta, at_index: dict[int, int], links: list) -> None:
        id_size = dg.body[0]
        data, invalid, kind = self.chain(dg.links[2])
        own: list[Group] = []
        at = dg.links[1]
        while at:
            cg = Block(self.f, at)
            record_id, cycles, flags = cg.unpack("QQH")
            data_bytes, inval_bytes = cg.unpack("II", 24)
            g = Group(len(meta.groups), n, cycles, record_id, id_size, data_bytes, inval_bytes, flags, self.text(cg.links[2]), self.text(cg.links[5]), self.source(cg.links[3]), position=at, stream=data, invalid=invalid)
            at_index[at] = g.index
            if flags & 8 and len(cg.links) > 6:
                links.append((g, cg.links[6]))
            self.channels(cg.links[1], g.channels, 0)
            meta.groups.append(g)
            own.append(g)
            at = cg.links[0]
        columnar = kind in (b"##DV", b"##LD") or bool(data and kind == b"##DZ" and self.dz_kind(data[0]) == b"DV")
        for g in own:
            g.columnar, g.sorted = columnar, len(own) == 1
            g.siblings = {x.record_id: None if x.flags & 1 else x.record_size for x in own}
            for c in g.channels:
                if c.values_group is not None:
                    c.values_group = next((x.record_id for x in own if x.position == c.values_group), None)

    def dz_kind(self, s: Segment) -> bytes:
        self.f.seek(s.offset - (26 if s.zip == PIECE else 24))
        return self.f.read(2)

    def channels(self, at: int, out: list[Channel], base: int) -> None:
        while at:
            b = Block(self.f, at)
            kind, sync, data_type, bit_offset, byte_offset, bits, flags, inval = b.unpack("4BIIII")
            text = self.text(b.links[7])
            cc = self.conversion(b.links[4])
            cc = cc if isinstance(cc, Conversion) else None
            c = Channel(self.text(b.links[2]), kind, sync, data_type, byte_offset + base, bit_offset, bits, flags, inval, self.text(b.links[6]) or (cc.unit if cc else ""), text, cc, self.source(b.links[3]), position=at, big_endian=data_type in BIG_ENDIAN)
            if kind == 1 and b.links[5]:
                target = Block(self.f, b.links[5], body=False)
                if target.id == b"##CG":
                    c.values_group = b.links[5]
                else:
                    c.values = self.chain(b.links[5])[0]
            elif kind == 5 and b.links[5]:
                target = Block(self.f, b.links[5], body=False)
                c.size_channel = self.text(target.links[2]) if target.id == b"##CN" else ""
            parts = {13: DATE_PARTS, 14: TIME_PARTS}.get(data_type)
            if parts:
                out += [replace(c, name=f"{c.name} {n}", data_type=0, byte_offset=c.byte_offset + byte, bit_offset=bit, bit_count=size, conversion=None, kind=0, sync=0) for n, byte, bit, size in parts]
            elif b.links[1] and Block(self.f, b.links[1], body=False).id == b"##CN":
                self.channels(b.links[1], out, base)  # a structure: its members stand for it
            else:
                if b.links[1]:
                    self.array(b.links[1], c)
                out.append(c)
            at = b.links[0]

    def array(self, at: int, c: Channel) -> None:
        while at:
            b = Block(self.f, at)
            if b.id != b"##CA":
                return
            kind, storage, n, flags = b.unpack("BBHI")
            shape = b.unpack(f"{n}Q", 16)
            c.shape += shape
            c.order = "F" if flags & 64 else "C"
            c.arrays.append(self.array_info(b, Array(kind, storage, flags), shape))
            at = b.links[0]

    @staticmethod
    def array_info(b: Block, info: Array, shape: tuple[int, ...]) -> Array:
        """Axis values and cycle counts stand behind the sizes; links come by role, as flags and storage say."""
        n, at, cells = len(shape), 16 + 8 * len(shape), size_of(shape)
        if info.flags & 32:
            for size in shape:
                info.axes.append(list(b.unpack(f"{size}d", at)))
                at += 8 * size
        if info.storage:
            info.cycle_counts = list(b.unpack(f"{cells}Q", at))
        links = list(b.links[1:])
        roles = [("data", cells * (info.storage == 2)), ("dynamic_size", 3 * n * bool(info.flags & 1)), ("input", 3 * n * bool(info.flags & 2)), ("output", 3 * bool(info.flags & 4)), ("comparison", 3 * bool(info.flags & 8)), ("axis_conversion", n * bool(info.flags & 16)), ("axis", 3 * n * (info.flags & 48 == 16))]
        for role, count in roles:
            if count and links:
                info.links[role], links = links[:count], links[count:]
        return info


def size_of(shape: tuple[int, ...]) -> int:
    return reduce(lambda a, b: a * b, shape, 1)

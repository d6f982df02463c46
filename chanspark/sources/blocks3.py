"""Metadata of MDF 3.x files."""

from __future__ import annotations

import struct
from dataclasses import replace
from datetime import datetime, timezone
from typing import BinaryIO

from .blocks4 import DATE_PARTS, TIME_PARTS
from .model import Channel, Conversion, Group, Meta, Segment, Source

#: Data type of version 3 -> of version 4, little-endian form.
TYPES = {0: 0, 1: 2, 2: 4, 3: 4, 7: 6, 8: 10, 9: 0, 10: 2, 11: 4, 12: 4, 13: 0, 14: 2, 15: 4, 16: 4}
_BIG, _LITTLE = {9, 10, 11, 12}, {13, 14, 15, 16}


class Parser3:
    def __init__(self, f: BinaryIO, path: str):
        self.f, self.path = f, path
        f.seek(0)
        head = f.read(64)
        self.big = head[24:26] != b"\0\0"
        _, self.version, page = self.unpack("3H", head, 26)
        self.codec = f"cp{page}" if page and page != 65001 else "cp1252"
        try:
            "".encode(self.codec)
        except LookupError:
            self.codec = "cp1252"
        self.program = self.string(head[16:24])

    def string(self, data: bytes) -> str:
        return data.split(b"\0", 1)[0].decode(self.codec, "replace").strip()

    def read(self, at: int, size: int) -> bytes:
        self.f.seek(at)
        data = self.f.read(size)
        if len(data) < size:
            raise ValueError(f"the file ends inside the block at {at}")
        return data

    def unpack(self, form: str, data: bytes, at: int = 0) -> tuple:
        return struct.unpack_from((">" if self.big else "<") + form, data, at)

    def text(self, at: int) -> str:
        if not at:
            return ""
        size = self.unpack("H", self.read(at + 2, 2))[0]
        return self.string(self.read(at + 4, size - 4))

    def parse(self) -> Meta:
        hd = self.read(64, 164)
        dg, comment, _, _ = self.unpack("IIIH", hd, 4)
        day, clock, author, organisation, project, subject = (self.string(hd[a:b]) for a, b in ((18, 28), (28, 36), (36, 68), (68, 100), (100, 132), (132, 164)))
        meta = Meta(self.path, self.version, self.program)
        pairs = {"date": day, "time": clock, "author": author, "organisation": organisation, "project": project, "subject": subject, "comment": self.text(comment)}
        meta.comments = {k: v for k, v in pairs.items() if v}
        if self.version >= 320 and self.unpack("H", hd, 2)[0] >= 208:
            meta.start_ns, tz = self.unpack("Qh", self.read(64 + 164, 10))
            meta.tz_minutes = 60 * tz
        else:
            try:
                meta.start_ns = int(datetime.strptime(f"{day} {clock}", "%d:%m:%Y %H:%M:%S").replace(tzinfo=timezone.utc).timestamp()) * 10**9
            except ValueError:
                meta.start_ns = 0
        n = 0
        while dg:
            b = self.read(dg, 28)
            following, cg, _, data, _, n_ids = self.unpack("IIIIHH", b, 4)
            self.data_group(cg, data, n_ids, n, meta)
            dg, n = following, n + 1
        return meta

    def data_group(self, cg: int, data: int, n_ids: int, n: int, meta: Meta) -> None:
        own: list[Group] = []
        while cg:
            b = self.read(cg, 26)
            following, cn, comment, record_id, _, size, cycles = self.unpack("IIIHHHI", b, 4)
            g = Group(len(meta.groups), n, cycles, record_id, 1 if n_ids else 0, size, comment=self.text(comment), position=cg, trailing_id=n_ids == 2)
            while cn:
                cn = self.channel(cn, g)
            meta.groups.append(g)
            own.append(g)
            cg = following
        total = sum(g.cycle_count * g.record_size for g in own)
        for g in own:
            g.sorted = len(own) == 1
            g.stream = [Segment(data, total)] if data and total else []
            g.siblings = {x.record_id: x.record_size for x in own}

    def channel(self, at: int, g: Group) -> int:
        size = self.unpack("H", self.read(at + 2, 2))[0]
        b = self.read(at, min(size, 228)).ljust(228, b"\0")
        following, cc, ce, _, comment, kind = self.unpack("IIIIIH", b, 4)
        name, description = self.string(b[26:58]), self.string(b[58:186])
        first_bit, bits, data_type, _, _, _, _, long_name, display, extra = self.unpack("HHHHdddIIH", b, 186)
        name = self.text(long_name) or name
        conversion = self.conversion(cc) if cc else None
        source, ecu, message = self.extension(ce) if ce else (None, "", "")
        big = data_type in _BIG or (data_type not in _LITTLE and self.big)
        c = Channel(name, 2 if kind == 1 else 0, 1 if kind == 1 else 0, TYPES.get(data_type, 10), first_bit // 8 + extra, first_bit % 8, bits, unit=conversion.unit if conversion else "", description=self.text(comment) or description, conversion=conversion, source=source, position=at, big_endian=big, message=message, ecu=ecu)
        if conversion and conversion.kind in (132, 133):
            parts = DATE_PARTS if conversion.kind == 132 else TIME_PARTS
            g.channels += [replace(c, name=f"{c.name} {n}", data_type=0, byte_offset=c.byte_offset + byte, bit_offset=bit, bit_count=width, conversion=None, big_endian=False) for n, byte, bit, width in parts]
        else:
            g.channels.append(c)
        return following

    def conversion(self, at: int) -> Conversion:
        b = self.read(at, 46)
        kind, n = self.unpack("HH", b, 42)
        c = Conversion(3, kind, unit=self.string(b[22:42]))
        at += 46
        if kind in (0, 6, 7, 8, 9):
            count = {0: 2, 6: 6, 7: 7, 8: 7, 9: 6}[kind]
            c.values = list(self.unpack(f"{count}d", self.read(at, 8 * count)))
        elif kind in (1, 2):
            c.values = list(self.unpack(f"{2 * n}d", self.read(at, 16 * n)))
        elif kind == 10:
            c.formula = self.string(self.read(at, 256))
        elif kind == 11:
            for k in range(n):
                row = self.read(at + 40 * k, 40)
                c.values += self.unpack("d", row)
                c.refs.append(self.string(row[8:]))
        elif kind == 12:
            for k in range(n):
                low, high, text = self.unpack("ddI", self.read(at + 20 * k, 20))
                c.values += [low, high]
                c.refs.append(self.text(text))
        return c

    def extension(self, at: int) -> tuple[Source | None, str, str]:
        kind = self.unpack("H", self.read(at + 4, 2))[0]
        if kind == 2:
            b = self.read(at + 6, 118)
            description, ecu = self.string(b[6:86]), self.string(b[86:118])
            return Source(description, ecu, 1), ecu, ""
        if kind == 19:
            b = self.read(at + 6, 80)
            message, sender = self.string(b[8:44]), self.string(b[44:80])
            return Source(message, sender, 2, 2), "", message
        return None, "", ""

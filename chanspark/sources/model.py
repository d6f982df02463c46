"""What a measurement file's metadata says, for both format versions. All of it can be pickled."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Conversion:
    """From raw to physical values. refs: texts, nested conversions, or None (nothing is referred to)."""

    version: int
    kind: int
    values: list = field(default_factory=list)
    refs: list = field(default_factory=list)
    formula: str = ""
    name: str = ""
    unit: str = ""


@dataclass
class Source:
    name: str = ""
    path: str = ""
    kind: int = 0
    bus: int = 0


#: The zip type of a piece of a compressed block.
PIECE = -1


@dataclass
class Segment:
    """A stretch of a byte stream: size bytes of it, stored at offset in the file, perhaps compressed: by zip type 0 or 1 of
    the format, or (PIECE) as a piece of a larger compressed block that needs nothing before it; param is then its Adler sum."""

    offset: int
    size: int
    stored: int = 0
    zip: int | None = None
    param: int = 0


@dataclass
class Array:
    """What a file says of an array channel beside its shape: kind (0 array, 1 scaling axis, 2 look-up, 3 intervals, 4
    classification), storage (0 channel template, 1 and 2 group templates), fixed axis values by dimension, cycle counts,
    and the places of the blocks that it refers to, by role."""

    kind: int = 0
    storage: int = 0
    flags: int = 0
    axes: list[list[float]] = field(default_factory=list)
    cycle_counts: list[int] = field(default_factory=list)
    links: dict[str, list[int]] = field(default_factory=dict)


@dataclass
class Channel:
    """A column. kind: 0 fixed, 1 variable length, 2 master, 3 virtual master, 4 synchronisation, 5 maximum length, 6 virtual."""

    name: str
    kind: int = 0
    sync: int = 0
    data_type: int = 0
    byte_offset: int = 0
    bit_offset: int = 0
    bit_count: int = 0
    flags: int = 0
    inval_bit: int = 0
    unit: str = ""
    description: str = ""
    conversion: Conversion | None = None
    source: Source | None = None
    shape: tuple[int, ...] = ()
    order: str = "C"
    arrays: list[Array] = field(default_factory=list)
    position: int = 0
    big_endian: bool = False
    #: Where variable-length values are: a stream, or the record id of their own channel group.
    values: list[Segment] = field(default_factory=list)
    values_group: int | None = None
    size_channel: str = ""
    message: str = ""
    ecu: str = ""

    @property
    def n_bytes(self) -> int:
        return (self.bit_count + self.bit_offset + 7) // 8

    @property
    def virtual(self) -> bool:
        return self.kind in (3, 6)


@dataclass
class Group:
    """A channel group as stored. A group without its own master may borrow that of another, row by row."""

    index: int
    data_group: int
    cycle_count: int
    record_id: int = 0
    id_size: int = 0
    data_bytes: int = 0
    inval_bytes: int = 0
    flags: int = 0
    name: str = ""
    comment: str = ""
    source: Source | None = None
    channels: list[Channel] = field(default_factory=list)
    stream: list[Segment] = field(default_factory=list)
    invalid: list[Segment] = field(default_factory=list)
    #: Bytes before the first of these segments, where earlier ones were left out.
    stream_base: int = 0
    invalid_base: int = 0
    columnar: bool = False
    sorted: bool = True
    #: Record ids of all groups of this data group: (size of a record, or None for variable length).
    siblings: dict[int, int | None] = field(default_factory=dict)
    trailing_id: bool = False
    position: int = 0
    master_group: int | None = None

    @property
    def record_size(self) -> int:
        return (0 if self.columnar else self.id_size + self.inval_bytes) + self.data_bytes + self.trailing_id

    @property
    def master(self) -> Channel | None:
        return next((c for c in self.channels if c.kind in (2, 3)), None)


@dataclass
class Attachment:
    name: str
    mime: str
    comment: str
    flags: int
    md5: str
    size: int
    data: bytes | None = None
    intact: bool | None = None


@dataclass
class Event:
    name: str
    comment: str
    kind: int
    sync: int
    range_kind: int
    cause: int
    flags: int
    base: int
    factor: float
    parent: int
    position: int


@dataclass
class History:
    time_ns: int
    tz_minutes: int
    dst_minutes: int
    comment: str
    tags: dict[str, str] = field(default_factory=dict)


@dataclass
class Meta:
    path: str
    version: int
    program: str = ""
    start_ns: int = 0
    tz_minutes: int = 0
    dst_minutes: int = 0
    time_flags: int = 0
    comments: dict[str, str] = field(default_factory=dict)
    groups: list[Group] = field(default_factory=list)
    attachments: list[Attachment] = field(default_factory=list)
    events: list[Event] = field(default_factory=list)
    history: list[History] = field(default_factory=list)

    def tables(self) -> list[Table]:
        """The groups as tables: one that borrows another's master is part of that one's table."""
        by_master: dict[int, Table] = {}
        for g in self.groups:
            if g.flags & 1 and not g.channels[1:]:  # values of another group's channel
                continue
            home = g.index if g.master_group is None else g.master_group
            by_master.setdefault(home, Table(home, [])).groups.append(g)
        for t in by_master.values():
            t.groups.sort(key=lambda g: (g.index != t.index, g.index))
        return [by_master[k] for k in sorted(by_master)]

    def table_of(self, channel: str) -> Table:
        for t in self.tables():
            if any(c.name == channel for _, c in t.columns()):
                return t
        raise KeyError(f"no channel named {channel!r} in {self.path}")


@dataclass
class Table:
    index: int
    groups: list[Group]

    def columns(self) -> list[tuple[Group, Channel]]:
        return [(g, c) for g in self.groups for c in g.channels]

    @property
    def rows(self) -> int:
        return min((g.cycle_count for g in self.groups), default=0)

    @property
    def master(self) -> Channel | None:
        return self.groups[0].master if self.groups else None

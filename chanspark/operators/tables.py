"""Work on channel groups as tables: cut, resample, merge, concatenate, and the aggregates of channels.

Masters are any numeric or timestamp column in order of which a table is read. by names columns that keep series apart;
each of them is a key of its own in every shuffle. A table without by is one series: what needs its order is then done in
blocks of the master's axis (a shuffle by block, and the last value of each block carried over), never in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROW = "__t_row"


def q(name: str) -> Column:
    """A column by its name as it stands: dots and spaces are part of it."""
    return F.col("`" + name.replace("`", "``") + "`")


def cut(df: DataFrame, master: str, start: float | None = None, stop: float | None = None) -> DataFrame:
    """Rows whose master lies from start to stop, both included; null masters go. A filter that sources can prune by."""
    out = df if start is None else df.where(q(master) >= F.lit(start))
    out = out if stop is None else out.where(q(master) <= F.lit(stop))
    return out.where(q(master).isNotNull())


def resample(df: DataFrame, master: str, step: float, how: str = "mean", columns: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """One row for each step of the master that has rows: mean, min, max, sum, count, first or last of the columns.

    The master becomes the start of its step, floor(master / step) * step. Partial aggregates run before the shuffle.
    """
    names = columns or [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != master and f.name not in (by or [])]
    make = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count, "first": lambda c: F.min_by(c, q(master)), "last": lambda c: F.max_by(c, q(master))}[how]
    cell = F.floor(q(master) / F.lit(float(step)))
    grouped = df.where(q(master).isNotNull()).groupBy(*map(q, by or []), cell.alias(_ROW)).agg(*[make(q(n)).alias(n) for n in names])
    return grouped.select(*map(q, by or []), (F.col(_ROW) * F.lit(float(step))).alias(master), *map(q, names))


def carried(df: DataFrame, order: list[Column], by: list[str], columns: list[str], block: Column) -> DataFrame:
    """Each null of the columns replaced by the last value before it, in order, within by.

    block is a number that never falls along the order. Rows are put in order within a block; the last values of the
    blocks before come from a second, far smaller table with a row for each block that has values.
    """
    df = df.withColumn("__t_block", block)
    keys = [*map(q, by)]
    at = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)])
    lasts = [F.max_by(F.struct(q(c).alias("v")), F.when(q(c).isNotNull(), at)).alias(f"__t_{k}") for k, c in enumerate(columns)]
    ends = df.groupBy(*keys, "__t_block").agg(*lasts)
    earlier = Window.partitionBy(*keys).orderBy("__t_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "__t_block", *[F.last(F.col(f"__t_{k}.v"), True).over(earlier).alias(f"__t_{k}") for k in range(len(columns))])
    within = Window.partitionBy(*keys, "__t_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumns({c: F.last(q(c), True).over(within) for c in columns})
    a, b = local.alias("a"), ends.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.`{n}`").eqNullSafe(F.col(f"b.`{n}`")) for n in [*by, "__t_block"]])
    joined = a.join(b, same, "left")
    filled = {c: F.coalesce(F.col(f"a.`{c}`"), F.col(f"b.__t_{k}")) for k, c in enumerate(columns)}
    return joined.select(*[filled.get(n, F.col(f"a.`{n}`")).alias(n) for n in df.columns if n != "__t_block"])


#: Grid points that stand in an array at once.
GRID_POINTS = 10_000


def _cell(n: str) -> str:
    """The number of the stretch of GRID_POINTS that a grid point is in, negative ones too."""
    return f"cast(floor({n} / {GRID_POINTS}D) as bigint)"


def _numbers(cell: str) -> Column:
    """The grid points of a stretch that lie in __t_a to __t_b."""
    return F.expr(f"sequence(greatest(__t_a, {cell} * {GRID_POINTS}), least(__t_b, {cell} * {GRID_POINTS} + {GRID_POINTS - 1}))")


def grid(df: DataFrame, master: str, step: float, by: list[str] | None = None) -> DataFrame:
    """Masters from the first step to the last one, every step, for each series. A series' grid is exploded in blocks."""
    ends = df.where(q(master).isNotNull()).groupBy(*map(q, by or [])).agg(F.ceil(F.min(q(master)) / F.lit(float(step))).cast("long").alias("__t_a"), F.floor(F.max(q(master)) / F.lit(float(step))).cast("long").alias("__t_b")).where("__t_a <= __t_b")
    blocks = ends.withColumn("__t_first", F.explode(F.expr(f"sequence({_cell('__t_a')}, {_cell('__t_b')})")))
    spread = blocks.repartition(*map(q, by or []), "__t_first") if by else blocks.repartition("__t_first")
    return spread.select(*map(q, by or []), F.explode(_numbers("__t_first")).alias("__t_n")).select(*map(q, by or []), (F.col("__t_n") * F.lit(float(step))).alias(master))


def resample_previous(df: DataFrame, master: str, step: float, columns: list[str], by: list[str] | None = None, block_steps: int = 10_000) -> DataFrame:
    """The last value at or before each grid point: one row for each point of grid().

    Only df's rows are put in order, in blocks of the master's axis; each then makes the points from its master up to the next
    row's, so the grid is neither shuffled nor sorted. A block's last row ends at the first row of the next block that has any.
    """
    keys, width = [*map(q, by or [])], F.lit(float(step))
    rows = df.where(q(master).isNotNull()).select(*keys, q(master).cast("double").alias("__t_x"), F.struct(*map(q, columns)).alias("__t_v"))
    rows = rows.withColumn("__t_block", F.floor(F.col("__t_x") / F.lit(float(block_steps * step))).cast("long"))
    series = Window.partitionBy(*keys)
    ends = rows.groupBy(*keys, "__t_block").agg(F.min("__t_x").alias("__t_low"), F.max("__t_x").alias("__t_high"))
    ends = ends.select(*keys, "__t_block", F.lead("__t_low").over(series.orderBy("__t_block")).alias("__t_following"), (F.col("__t_block") == F.min("__t_block").over(series)).alias("__t_head"), F.ceil(F.min("__t_low").over(series) / width).cast("long").alias("__t_a"), F.floor(F.max("__t_high").over(series) / width).cast("long").alias("__t_b"))
    within = Window.partitionBy(*keys, "__t_block").orderBy("__t_x", "__t_v")
    local = rows.withColumns({"__t_next": F.lead("__t_x").over(within), "__t_first": F.lag("__t_x").over(within).isNull()})
    x, n = F.col("__t_x"), F.col("__t_n")

    def reached(x: Column) -> Column:
        """The first grid point at or behind x; the division may be off by one."""
        k = F.ceil(x / width).cast("long")
        return F.when((k - 1) * width >= x, k - 1).when(k * width < x, k + 1).otherwise(k)

    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*("`" + c.replace("`", "``") + "`" for c in by or []), "__t_block"]])
    found = local.alias("a").join(ends.alias("b"), same).select(*[F.col("a.`" + c.replace("`", "``") + "`") for c in by or []], "__t_x", "__t_v", "__t_a", "__t_b", F.coalesce("__t_next", "__t_following").alias("__t_next"), (F.col("__t_first") & F.col("__t_head")).alias("__t_first"))
    low = F.when(F.col("__t_first"), F.col("__t_a")).otherwise(F.greatest("__t_a", reached(x)))
    high = F.when(F.col("__t_next").isNull(), F.col("__t_b")).otherwise(F.least("__t_b", reached(F.col("__t_next")) - 1))
    points = found.select(*keys, "__t_x", "__t_v", low.alias("__t_a"), high.alias("__t_b")).where("__t_a <= __t_b")
    points = points.withColumn("__t_n", F.explode(F.expr(f"sequence({_cell('__t_a')}, {_cell('__t_b')})"))).withColumn("__t_n", F.explode(_numbers("__t_n")))
    return points.select(*keys, (n * width).alias(master), *[F.when(n * width >= x, F.col("__t_v")[c]).alias(c) for c in columns])


def resample_linear(df: DataFrame, master: str, step: float, column: str, by: list[str] | None = None, block_steps: int = 10_000) -> DataFrame:
    """The column at each grid point by the straight line between the values before and after it."""
    known = df.where(q(master).isNotNull() & q(column).isNotNull()).select(*map(q, by or []), q(master), F.struct(q(master).alias("x"), q(column).cast("double").alias("y")).alias("__t_p"))
    before = merge_asof(grid(df, master, step, by), known, master, by, block=block_steps * step)
    flipped = before.withColumn("__t_before", F.col("__t_p")).drop("__t_p").withColumn(master, -q(master))
    both = merge_asof(flipped, known.withColumn(master, -q(master)), master, by, block=block_steps * step)
    a, b, x = F.col("__t_before"), F.col("__t_p"), -q(master)
    value = F.when(a["x"] == b["x"], a["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * (x - a["x"]) / F.when(b["x"] != a["x"], b["x"] - a["x"]))
    return both.select(*map(q, by or []), x.alias(master), value.alias(column))


#: Rows of a series that one task sorts, on average.
ASOF_ROWS = 2_000_000


def _block(tables: list[DataFrame], master: str, by: list[str]) -> float | None:
    """The length of the master's axis that holds ASOF_ROWS rows of the longest series, None if no series has more."""
    axis = reduce(lambda a, b: a.union(b), [t.select(q(master).cast("double").alias("x"), *[q(c).cast("string").alias(f"b{k}") for k, c in enumerate(by)]) for t in tables])
    found = axis.where("x IS NOT NULL AND NOT isnan(x) AND abs(x) < 1e300").groupBy(*[f"b{k}" for k in range(len(by))]).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    r = found.agg(F.max("n").alias("n"), F.max_by(F.col("high") - F.col("low"), "n").alias("span")).first()
    return r["span"] / -(-r["n"] // ASOF_ROWS) if r["n"] and r["n"] > ASOF_ROWS and r["span"] else None


def merge_asof(left: DataFrame, right: DataFrame, master: str, by: list[str] | None = None, block: float | None = None) -> DataFrame:
    """Each row of left with the columns of the last row of right at or before its master, within by.

    Both sides are laid in one order and the right side's rows carried forward: one shuffle by series and block, no join
    of pairs. Of right rows with one master the last in the order of their values counts. block is the length of the
    master's axis that one task sorts. Without it, the rows are counted here: a series of up to ASOF_ROWS is a block of its
    own, a longer one is cut into blocks that have about so many on average.
    """
    by = by or []
    block = block if block is not None else _block([left, right], master, by)
    extra = [c for c in right.columns if c != master and c not in by]
    if clash := [c for c in extra if c in left.columns]:
        raise ValueError(f"both sides have {clash}")
    packed = F.struct(*[q(c).alias(c) for c in extra])
    a = left.withColumns({"__t_side": F.lit(1), "__t_right": F.lit(None).cast(right.select(packed.alias("p")).schema["p"].dataType)})
    b = right.where(q(master).isNotNull()).select(*[q(c).cast(left.schema[c].dataType) if c in [*by, master] else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.lit(0).alias("__t_side"), packed.alias("__t_right"))
    both = a.unionByName(b)
    cell = F.floor(q(master) / F.lit(float(block))).cast("long") if block else F.lit(0).cast("long")
    done = carried(both, [q(master), F.col("__t_side"), F.col("__t_right")], by, ["__t_right"], F.coalesce(cell, F.lit(-(1 << 62)))).where("__t_side = 1")
    return done.select(*map(q, left.columns), *[F.when(q(master).isNotNull(), F.col("__t_right")[c]).alias(c) for c in extra])


def concat(tables: list[DataFrame]) -> DataFrame:
    """The rows of all tables; a column that one of them lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.select("*") for t in tables])


def join_rows(left: DataFrame, right: DataFrame, row: str = "_row") -> DataFrame:
    """Two tables side by side by their row numbers."""
    return left.join(right, row)


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Least and largest value of each column as doubles; of arrays over all their cells."""

    def deepest(c: Column, kind: T.DataType, one: str) -> Column:
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
            if isinstance(kind, T.ArrayType):
                c = F.flatten(c)
            else:
                c = F.array_min(c) if one == "min" else F.array_max(c)
        return c.cast("double")

    kinds = {f.name: f.dataType for f in df.schema}
    return df.agg(*[getattr(F, one)(deepest(q(c), kinds[c], one)).alias(f"{one}_{c}") for c in columns for one in ("min", "max")])


def max_length(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bytes of the longest text or byte string of each column."""
    return df.agg(*[F.max(F.octet_length(q(c))).cast("long").alias(f"len_{c}") for c in columns])


def extract_bits(x: Column, offset: int, count: int, signed: bool = False) -> Column:
    """The number in count bits of a whole number, from the bit at offset on."""
    value = F.shiftrightunsigned(x.cast("long"), offset).bitwiseAND(F.lit((1 << count) - 1 if count < 63 else -1).cast("long"))
    if not signed:
        return value
    return F.shiftright(F.shiftleft(value, 64 - count), 64 - count)

"""Ordered (window) operators that stay balanced when one key holds most of the rows.

``Window.partitionBy(session)`` puts a whole session into one task.  Here every series is
cut into blocks by a monotone function of its order column, windows run per
``(keys, block)``, and what crosses a block border travels in a summary with one row per
block:

* ``scan``       unbounded look-back / look-ahead and running totals (two-level prefix scan)
* ``with_halo``  bounded row frames over dense positions (border rows are replicated)

Both shuffle the rows once, on ``(keys, block)``; the summary join reuses that partitioning.
``scan`` reads its input twice (rows and summary): put everything that shares an order into
one call, and ``stage`` between long chains.
Groups with a proven small bound (one attempt, one metric registry) use ``block=None`` and
get plain windows from the same calls.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_blk"
HALO_ROWS = 4096


class Series:
    """Rows of each key in a total order.

    ``block`` is SQL text for the block number; it must not decrease along the order.
    """

    def __init__(self, keys: Sequence[str], order: Sequence[str], block: str | None = None):
        self.keys = list(keys)
        self.order = list(order)
        self.block = block

    @classmethod
    def frames(cls, keys: Sequence[str], order: str = "frame_index", size: int = HALO_ROWS) -> Series:
        return cls(keys, [order], f"floor({order} / {size})")


@dataclass(frozen=True)
class Spec:
    kind: str
    value: Column


def prev_row(value: Column) -> Spec:
    """Value in the previous row (null there stays null)."""
    return Spec("prev", value)


def next_row(value: Column) -> Spec:
    return Spec("next", value)


def last_before(value: Column) -> Spec:
    """Last non-null value strictly before the row."""
    return Spec("last_before", value)


def first_after(value: Column) -> Spec:
    """First non-null value strictly after the row."""
    return Spec("first_after", value)


def running_sum(value: Column) -> Spec:
    """Sum up to and including the row."""
    return Spec("running_sum", value)


def running_max(value: Column) -> Spec:
    return Spec("running_max", value)


def running_max_before(value: Column) -> Spec:
    """Maximum strictly before the row."""
    return Spec("running_max_before", value)


def total(value: Column) -> Spec:
    """Sum over all rows of the key."""
    return Spec("total", value)


def _local(spec: Spec, part: list[str], order: list[str]) -> Column:
    ahead = Window.partitionBy(*part).orderBy(*order)
    back = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order])
    before = (Window.unboundedPreceding, -1)
    upto = (Window.unboundedPreceding, 0)
    match spec.kind:
        case "prev":
            return F.lag(F.struct(spec.value.alias("v"))).over(ahead)
        case "next":
            return F.lead(F.struct(spec.value.alias("v"))).over(ahead)
        case "last_before":
            return F.last(spec.value, ignorenulls=True).over(ahead.rowsBetween(*before))
        case "first_after":
            # reversed order keeps the frame growing, so each row costs O(1)
            return F.last(spec.value, ignorenulls=True).over(back.rowsBetween(*before))
        case "running_sum":
            return F.sum(spec.value).over(ahead.rowsBetween(*upto))
        case "running_max":
            return F.max(spec.value).over(ahead.rowsBetween(*upto))
        case "running_max_before":
            return F.max(spec.value).over(ahead.rowsBetween(*before))
        case "total":
            return F.sum(spec.value).over(Window.partitionBy(*part))
    raise ValueError(spec.kind)


def _summary(spec: Spec, order: list[str]) -> Column:
    at = F.struct(*order)
    match spec.kind:
        case "prev":
            return F.max_by(F.struct(spec.value.alias("v")), at)
        case "next":
            return F.min_by(F.struct(spec.value.alias("v")), at)
        case "last_before":
            return F.max_by(spec.value, F.when(spec.value.isNotNull(), at))
        case "first_after":
            return F.min_by(spec.value, F.when(spec.value.isNotNull(), at))
        case "running_sum" | "total":
            return F.sum(spec.value)
        case "running_max" | "running_max_before":
            return F.max(spec.value)
    raise ValueError(spec.kind)


def _carried(spec: Spec, name: str, keys: list[str]) -> Column:
    w = Window.partitionBy(*keys).orderBy(BLOCK)
    back = Window.partitionBy(*keys).orderBy(F.col(BLOCK).desc())
    before = (Window.unboundedPreceding, -1)
    match spec.kind:
        case "prev":
            return F.lag(name).over(w)
        case "next":
            return F.lead(name).over(w)
        case "last_before":
            return F.last(name, ignorenulls=True).over(w.rowsBetween(*before))
        case "first_after":
            return F.last(name, ignorenulls=True).over(back.rowsBetween(*before))
        case "running_sum":
            return F.sum(name).over(w.rowsBetween(*before))
        case "running_max" | "running_max_before":
            return F.max(name).over(w.rowsBetween(*before))
        case "total":
            return F.sum(name).over(Window.partitionBy(*keys))
    raise ValueError(spec.kind)


def _merge(spec: Spec, local: Column, carry: Column | None) -> Column:
    if spec.kind in ("prev", "next"):
        both = local if carry is None else F.coalesce(local, carry)
        return both.getField("v")
    if carry is None:
        return local
    match spec.kind:
        case "last_before" | "first_after":
            return F.coalesce(local, carry)
        case "running_sum":
            return F.when(local.isNotNull() | carry.isNotNull(), F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0)))
        case "running_max" | "running_max_before":
            return F.greatest(local, carry)
        case "total":
            return carry
    raise ValueError(spec.kind)


def scan(df: DataFrame, series: Series, **specs: Spec) -> DataFrame:
    """Add one column per spec; see the module text for how blocks are joined up."""
    keys, order = series.keys, series.order
    if series.block is None:
        return df.select("*", *[_merge(s, _local(s, keys, order), None).alias(n) for n, s in specs.items()])
    rows = df.withColumn(BLOCK, F.expr(series.block))
    part = [*keys, BLOCK]
    border = rows.groupBy(*part).agg(*[_summary(s, order).alias(f"_c_{n}") for n, s in specs.items()])
    border = border.select(*part, *[_carried(s, f"_c_{n}", keys).alias(f"_c_{n}") for n, s in specs.items()])
    local = rows.select(
        "*",
        *[_local(s, part, order).alias(f"_l_{n}") for n, s in specs.items() if s.kind != "total"],
    )
    joined = local.join(border, part, "inner")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[
            _merge(s, F.lit(None) if s.kind == "total" else F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n)
            for n, s in specs.items()
        ],
    )


def positions(df: DataFrame, series: Series, name: str = "pos", size_name: str | None = None) -> DataFrame:
    """Dense 1-based row position per key, and optionally the key's row count."""
    specs = {name: running_sum(F.lit(1).cast("long"))}
    if size_name:
        specs[size_name] = total(F.lit(1).cast("long"))
    return scan(df, series, **specs)


class Halo:
    """Rows replicated over block borders so that bounded row frames are complete."""

    def __init__(self, df: DataFrame, keys: Sequence[str], pos: str, before: int = 0, after: int = 0, size: int = HALO_ROWS):
        self.keys, self.pos = list(keys), pos
        at = F.col(pos).cast("long")
        home = F.floor(at / F.lit(size))
        first = F.floor((at - F.lit(after)) / F.lit(size))
        last = F.floor((at + F.lit(before)) / F.lit(size))
        self.columns = df.columns
        self.rows = df.select("*", home.alias("_home"), F.explode(F.sequence(first, last)).alias(BLOCK))

    def window(self):
        return Window.partitionBy(*self.keys, BLOCK).orderBy(self.pos)

    def select(self, **columns: Column) -> DataFrame:
        """Evaluate window columns, then drop the replicas."""
        out = self.rows.select("*", *[c.alias(n) for n, c in columns.items()])
        return out.filter(F.col("_home") == F.col(BLOCK)).drop("_home", BLOCK)


def with_halo(df: DataFrame, keys: Sequence[str], pos: str, before: int = 0, after: int = 0, size: int = HALO_ROWS) -> Halo:
    return Halo(df, keys, pos, before, after, size)


def islands(df: DataFrame, series: Series, starts: Column, name: str = "island") -> DataFrame:
    """Gaps-and-islands: number the runs that begin where ``starts`` is true."""
    return scan(df, series, **{name: running_sum(F.when(starts, 1).otherwise(0).cast("long"))})


def dim_join(facts: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "inner", spread: Sequence[str] = (), salts: int = 16) -> DataFrame:
    """Join a one-row-per-key dimension without piling a hot key into one task.

    Facts get a salt from ``spread``; the dimension is repeated once per salt.  Spark still
    turns this into a broadcast on its own when the measured copies are small: the salts are
    joined on, as an exploded sequence would leave the planner the size of a single copy.
    """
    if not spread:
        return facts.join(dim, list(on), how)
    salted = facts.withColumn("_salt", F.pmod(F.hash(*spread), F.lit(salts)))
    copies = dim.crossJoin(dim.sparkSession.range(salts).select(F.col("id").cast("int").alias("_salt")))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")

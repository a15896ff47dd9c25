"""Ordered keyed folds (state machines, filters) over series of any length.

A fold consumes a key's rows in order and carries a small state.  Rows are grouped by
``(keys, block)``, so no task ever holds more than one block of a key.  Keys that span
several blocks are resolved in rounds: every block runs from the state its predecessor
ended with in the round before, and only blocks whose starting state changed run again.
States are compared in full, so the result
is that of one pass over the whole series.  Folds that forget (trackers, state machines) settle in a few rounds; machines
that never forget run in one pass instead (``onepass``).  The state tables are checkpointed, one row per block.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kinetable.operators.lineage import cut_lineage
from kinetable.operators.ordered import BLOCK


class Fold:
    """A fold: ``start()`` gives a state, ``step`` consumes a row, ``finish`` ends a key.

    States are JSON values.  ``step(state, row)`` returns ``(state, [output tuples])``.
    """

    columns: Sequence[str] = ()
    schema: T.StructType

    def start(self):
        raise NotImplementedError

    def step(self, state, row):
        raise NotImplementedError

    def finish(self, state):
        return []

    def token(self, state):
        """What two states must have in common to be the same: all of it, unless a fold knows better."""
        return state


def _run(fold: Fold, columns: list[list], state, emit: bool):
    out = []
    for row in zip(*columns):
        state, produced = fold.step(state, tuple(None if v.__class__ is float and v != v else v for v in row))
        if emit and produced:
            out.extend(produced)
    return state, out


def _ordered(fold: Fold, table: pa.Table, order: Sequence[str]) -> list[list]:
    """The fold's columns as lists, rows in order.  Integers with nulls stay integers."""
    rank = list(zip(*[table.column(o).to_pylist() for o in order]))
    at = sorted(range(len(rank)), key=lambda i: [(v is None, v) for v in rank[i]])
    lists = [table.column(c).to_pylist() for c in fold.columns]
    return [[values[i] for i in at] for values in lists]


def keyed_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, fold: Fold) -> DataFrame:
    """Run ``fold`` over each key of ``df`` in ``order``; returns keys + ``fold.schema``."""
    keys, order = list(keys), list(order)
    need = list(dict.fromkeys([*keys, *order, *fold.columns]))
    rows = df.select(*need, block.cast("long").alias(BLOCK))
    key_fields = [df.schema[k] for k in keys]
    out_schema = T.StructType([*key_fields, *fold.schema.fields])
    target = to_arrow_schema(out_schema)

    def emit(table):
        given = table.column("_in")[0].as_py() if "_in" in table.column_names else None
        state, out = _run(fold, _ordered(fold, table, order), fold.start() if given is None else json.loads(given), True)
        if "_last" not in table.column_names or table.column("_last")[0].as_py():
            out.extend(fold.finish(state))
        key = tuple(table.column(k)[0].as_py() for k in keys)
        columns = zip(*[key + tuple(o) for o in out]) if out else [[] for _ in target]
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(columns, target)], schema=target)

    blocks = rows.select(*keys, BLOCK).distinct()
    by_key = Window.partitionBy(*keys).orderBy(BLOCK)
    plan = blocks.withColumn("_last", F.lead(BLOCK).over(by_key).isNull())
    if plan.filter(~F.col("_last")).isEmpty():
        return rows.groupBy(*keys, BLOCK).applyInArrow(emit, out_schema)

    plan = plan.withColumn("_first", F.lag(BLOCK).over(by_key).isNull())
    plan = cut_lineage(plan)
    long_keys = plan.filter(~F.col("_last")).select(*keys).distinct()
    multi = plan.join(long_keys, keys, "left_semi")
    solved = _settle(rows, multi, keys, order, fold)
    ready = plan.join(solved.select(*keys, BLOCK, "_in"), [*keys, BLOCK], "left").drop("_first")
    return rows.join(ready, [*keys, BLOCK]).groupBy(*keys, BLOCK).applyInArrow(emit, out_schema)


def _settle(rows: DataFrame, blocks: DataFrame, keys: list[str], order: list[str], fold: Fold) -> DataFrame:
    part = [*keys, BLOCK]
    state_schema = T.StructType(
        [*[rows.schema[c] for c in part], *[T.StructField(c, T.StringType()) for c in ("_in", "_in_token", "_out", "_out_token")]]
    )

    target = to_arrow_schema(state_schema)

    def settle(table):
        state = table.column("_in")[0].as_py()
        before = fold.start() if state is None else json.loads(state)
        given = [json.dumps(before), json.dumps(fold.token(before))]  # steps may change the state in place
        after, _ = _run(fold, _ordered(fold, table, order), before, False)
        row = [*(table.column(c)[0].as_py() for c in part), *given, json.dumps(after), json.dumps(fold.token(after))]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, target)], schema=target)

    start_token = json.dumps(fold.token(fold.start()))
    by_key = Window.partitionBy(*keys).orderBy(BLOCK)
    todo = blocks.select(*part, F.lit(None).cast("string").alias("_in"))
    solved = cut_lineage(rows.join(todo, part).groupBy(*part).applyInArrow(settle, state_schema))
    # every round settles at least one more block of each key
    longest = solved.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    for _ in range(longest + 1):
        wanted = solved.select(
            *part,
            "_in_token",
            F.lag("_out").over(by_key).alias("_want"),
            F.coalesce(F.lag("_out_token").over(by_key), F.lit(start_token)).alias("_want_token"),
        ).filter(F.col("_in_token") != F.col("_want_token"))
        redo = cut_lineage(wanted.select(*part, F.col("_want").alias("_in")))
        if redo.isEmpty():
            return solved
        again = rows.join(redo, part).groupBy(*part).applyInArrow(settle, state_schema)
        solved = cut_lineage(solved.join(redo.select(*part), part, "left_anti").unionByName(again))
    raise RuntimeError("fold states did not settle; the fold is not deterministic")


def fold_call(fold: Fold) -> Callable[[pd.DataFrame], list]:
    """Run a whole in-memory series through a fold (used by streaming buffers and tests)."""

    def call(pdf: pd.DataFrame) -> list:
        state, out = _run(fold, [pdf[n].tolist() for n in fold.columns], fold.start(), True)
        return out + list(fold.finish(state))

    return call

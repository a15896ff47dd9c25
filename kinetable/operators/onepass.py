"""Order-dependent machines in one pass over each key.

Rows are dealt by key and sorted within tasks by key and order; a task streams its Arrow batches through a machine
whose state is plain arrays, and hands the output on batch by batch.  Neither the rows of a key nor its output are ever
held together, and the number of jobs does not depend on how long a key is.  This is for machines that never forget,
where a block cannot begin before its predecessor ends: cutting them into blocks gains nothing.  Machines that forget
are cut into blocks instead (``fold``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


class Machine:
    """What happens to the rows of one key: ``row`` and ``end`` return output tuples.

    ``columns`` are what ``row`` takes; ``schema`` is the output behind the keys.  Every key gets a machine of its own.
    """

    columns: Sequence[str] = ()
    schema: T.StructType

    def row(self, *values) -> list[tuple]:
        raise NotImplementedError

    def end(self) -> list[tuple]:
        return []


def ordered_pass(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], schema: T.StructType, machine: Callable[[], Machine]) -> DataFrame:
    """Keys and ``schema``: each key's rows in ``order`` through a fresh machine.

    Integers with nulls stay integers, as rows never pass through floats.  Null keys are a key like any other.
    """
    keys = list(keys)
    target = to_arrow_schema(T.StructType([*[df.schema[k] for k in keys], *schema.fields]))
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, None
        for batch in batches:
            lists = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            out: list[tuple] = []
            for key, values in zip(zip(*lists[:n]), zip(*lists[n:])):
                if now is None or key != at:
                    if now is not None:
                        out += [(*at, *o) for o in now.end()]
                    at, now = key, machine()
                out += [(*key, *o) for o in now.row(*values)]
            if out:
                yield _batch(out, target)
        if now is not None and (out := [(*at, *o) for o in now.end()]):
            yield _batch(out, target)

    dealt = df.select(*dict.fromkeys([*keys, *order, *columns])).repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.select(*keys, *columns).mapInArrow(run, T.StructType([*[df.schema[k] for k in keys], *schema.fields]))


def _batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), target)], schema=target)


class PlaceIndex:
    """Numbered points on a grid, found by nearness.  Points may move; their numbers stay."""

    def __init__(self, cell: float):
        self.cell = cell * (1 + 1e-9)  # a point within one cell's width is then in a neighbouring cell
        self.x: list[float] = []
        self.y: list[float] = []
        self.cells: dict[tuple[int, int], set[int]] = {}

    def _cell(self, x: float, y: float) -> tuple[int, int]:
        return int(x // self.cell), int(y // self.cell)

    def add(self, x: float, y: float) -> int:
        at = len(self.x)
        self.x.append(x)
        self.y.append(y)
        self.cells.setdefault(self._cell(x, y), set()).add(at)
        return at

    def move(self, at: int, x: float, y: float) -> None:
        before, after = self._cell(self.x[at], self.y[at]), self._cell(x, y)
        self.x[at], self.y[at] = x, y
        if before != after:
            held = self.cells[before]
            held.discard(at)
            if not held:
                del self.cells[before]
            self.cells.setdefault(after, set()).add(at)

    def around(self, x: float, y: float, reach: float) -> Iterator[int]:
        """All points that may lie within ``reach``, in no order."""
        wide = int(reach // self.cell) + 1
        if (2 * wide + 1) ** 2 >= len(self.cells):
            yield from range(len(self.x))
            return
        i, j = self._cell(x, y)
        for a in range(i - wide, i + wide + 1):
            for b in range(j - wide, j + wide + 1):
                yield from self.cells.get((a, b), ())

"""The keyed folds as stateful streaming operators.

Rows wait per key until the watermark passes them, and are then fed in order to the same fold as in batch; late rows
behind the watermark are dropped by Spark.  A key that stays silent past the timeout is finished, which is the
streaming form of "end of data".

Waiting rows lie in a map state, in chunks by time slot.  A batch adds one chunk a slot that its rows fall into and
reads the chunks of slots that the watermark has reached; all others are neither read nor written.  A small index (one
entry a waiting slot, so about the delay over the slot's length) tells which these are.  Rows far ahead of the watermark, as
all are before the first one is known, lie in wider slots, twice as wide for twice the way, and move on when theirs is reached.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kinetable.operators.fold import Fold

LONGS = T.ArrayType(T.LongType())
INDEX = T.StructType([*[T.StructField(n, LONGS) for n in ("slots", "chunks", "first")], T.StructField("timer", T.LongType()), T.StructField("last", T.LongType())])
PLACE = T.StructType([T.StructField("slot", T.LongType()), T.StructField("chunk", T.LongType())])
TEXT = T.StructType([T.StructField("v", T.StringType())])
#: A row fewer slots ahead of the watermark lies in a slot of the usual length; chunks hold at most so many rows.
NEAR_SLOTS, CHUNK_ROWS = 512, 4096


class FoldProcessor(StatefulProcessor):
    """Runs a fold per key.  Needs an ``event_ts`` column and JSON-able fold columns."""

    def __init__(self, fold: Fold, keys: Sequence[str], order: str, timeout_ms: int, slot_ms: int):
        self.fold, self.keys, self.order, self.timeout_ms, self.slot_ms = fold, list(keys), order, timeout_ms, slot_ms
        self.names = [*self.keys, *fold.schema.fieldNames()]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", TEXT)
        self.index = handle.getValueState("index", INDEX)
        self.waiting = handle.getMapState("waiting", PLACE, TEXT)

    def _load(self):
        return json.loads(self.state.get()[0]) if self.state.exists() else self.fold.start()

    def _frame(self, key, rows: list) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in rows], columns=self.names).astype(object)

    def _slot(self, ms: int, watermark: int) -> int:
        """Number of a row's slot: which one of its width, and the width's exponent."""
        level = (max(0, ms - watermark) // (self.slot_ms * NEAR_SLOTS)).bit_length()
        return (ms // (self.slot_ms << level)) * 64 + level

    def _advance(self, key, watermark: int, more: list, fired: bool) -> list:
        """Feed everything at or before the watermark; ``more`` are new rows ``[ms, order, ...]``."""
        held = self.index.get() if self.index.exists() else ([], [], [], 0, watermark)
        slots = {int(s): [int(n), int(f)] for s, n, f in zip(*held[:3])}
        timer, last = 0 if fired else int(held[3]), max(int(held[4]), watermark, *(r[0] for r in more), 0)
        ready = [r for r in more if r[0] <= watermark]
        later: dict[int, list] = {}
        for r in more:
            if r[0] > watermark:
                later.setdefault(self._slot(r[0], watermark), []).append(r)
        for slot in [s for s, (_, first) in slots.items() if first <= watermark]:
            for chunk in range(slots.pop(slot)[0]):
                for r in json.loads(self.waiting.getValue((slot, chunk))[0]):
                    if r[0] <= watermark:
                        ready.append(r)
                    else:  # the slot that the watermark lies in, or a wide one
                        later.setdefault(self._slot(r[0], watermark), []).append(r)
                self.waiting.removeKey((slot, chunk))
        for slot, rows in later.items():
            n, first = slots.get(slot, (0, rows[0][0]))
            for at in range(0, len(rows), CHUNK_ROWS):
                self.waiting.updateValue((slot, n), (json.dumps(rows[at : at + CHUNK_ROWS]),))
                n += 1
            slots[slot] = [n, min(first, *(r[0] for r in rows))]
        state, out = None, []
        if ready:
            state = self._load()
            for r in sorted(ready, key=lambda r: r[1]):
                state, made = self.fold.step(state, tuple(r[2:]))
                out.extend(made)
            self.state.update((json.dumps(state),))
        # wake up when the watermark reaches the first waiting row, else after the timeout
        wake = min((f for _, f in slots.values()), default=last + self.timeout_ms)
        if wake != timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wake)
        self.index.update((list(slots), [n for n, _ in slots.values()], [f for _, f in slots.values()], wake, last))
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        more = []
        for pdf in rows:
            ms = (pd.to_datetime(pdf["event_ts"]).astype("datetime64[ns]").astype("int64") // 1_000_000).tolist()
            columns = [pdf[self.order].tolist(), *[pdf[n].tolist() for n in self.fold.columns]]
            more.extend([m, *map(_plain, values)] for m, *values in zip(ms, *columns))
        yield self._frame(key, self._advance(key, timerValues.getCurrentWatermarkInMs(), more, False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.index.exists() and len(self.index.get()[0]):
            yield self._frame(key, self._advance(key, timerValues.getCurrentWatermarkInMs(), [], True))
        else:
            out = self.fold.finish(self._load())
            self.state.clear()
            self.index.clear()
            yield self._frame(key, list(out))

    def close(self) -> None:
        pass


def _plain(v):
    if isinstance(v, float) and v != v:
        return None
    if hasattr(v, "tolist"):
        return _plain(v.tolist())
    if isinstance(v, list | tuple):
        return [_plain(x) for x in v]
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if hasattr(v, "asDict"):
        return _plain(v.asDict())
    return v


def fold_stream(rows: DataFrame, fold: Fold, keys: Sequence[str], order: str, delay: str, timeout_ms: int, slots: int = 8) -> DataFrame:
    """Stateful fold over a stream with an ``event_ts`` column; append mode.  The delay is cut into ``slots``."""
    key_fields = [rows.schema[k] for k in keys]
    out = T.StructType([*key_fields, *fold.schema.fields])
    need = list(dict.fromkeys([*keys, "event_ts", order, *fold.columns]))
    marked = rows.select(*need).withWatermark("event_ts", delay)
    slot_ms = max(1000, int(pd.Timedelta(delay).total_seconds() * 1000) // slots)
    return marked.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=FoldProcessor(fold, keys, order, timeout_ms, slot_ms), outputStructType=out, outputMode="Append", timeMode="EventTime"
    )

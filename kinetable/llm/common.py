"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.operators.lineage import scratch_folder

#: Texts are handled in groups of about so many bytes, so that work arrays stay small.
GROUP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: cuts the lineage, survives executors."""
    path = scratch_folder(df, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def map_columns(df: DataFrame, fn: Callable[[dict[str, list]], dict], schema: str, group: int = GROUP_BYTES) -> DataFrame:
    """``fn`` from a batch's columns (Python lists) to the result's columns, on Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, group):
                out = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                if out is not None:
                    yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in out.items()}).cast(target)

    target = _arrow_schema(df.sparkSession, schema)
    return df.mapInArrow(run, schema)


def rows_where(df: DataFrame, keep: Callable[[list], np.ndarray], text_col: str = "text") -> DataFrame:
    """Whole rows for whose texts ``keep`` is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                yield part.filter(pa.array(keep(part.column(at).to_pylist()), pa.bool_()))

    at = df.columns.index(text_col)
    return df.mapInArrow(run, df.schema)


def with_new_text(df: DataFrame, text: Column, text_col: str = "text") -> DataFrame:
    """``df`` with another text; an ``n_chars`` column follows it, all others stay."""
    cols = {text_col: text}
    if "n_chars" in df.columns:
        cols["n_chars"] = F.when(F.col("n_chars").isNotNull(), F.length(text)).cast(df.schema["n_chars"].dataType)
    return df.withColumns(cols)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    return to_arrow_schema(kind)


def sliced(batch: pa.RecordBatch, group: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Row groups of a batch of about ``group`` bytes each; no row is cut."""
    rows = batch.num_rows
    if rows:
        step = max(1, int(rows * group / max(batch.nbytes, 1)))
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def grouped(texts: list) -> Iterator[list[int]]:
    """Places of the texts that aren't empty, in groups of about ``GROUP_BYTES``."""
    group, size = [], 0
    for i, t in enumerate(texts):
        if t:
            group.append(i)
            size += len(t)
            if size >= GROUP_BYTES:
                yield group
                group, size = [], 0
    if group:
        yield group


def encoded(texts: list) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [(t or "").encode() for t in texts]


def ids_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that further columns can't clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


# ------------------------------------------------------------------ hashing of byte ranges

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of them."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        m = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            step = np.full(m, base, np.uint64)
            step[0] = 1
            _POWERS[name] = np.cumprod(step)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole word (a bijection of 64-bit values)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of ``values * base^i``: any range's polynomial hash is a difference of two."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=out[1:])
    return out


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ranges ``[start, end)``."""
    _, down = powers(len(sums))
    h = (sums[ends] - sums[starts]) * down[starts]
    return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_strings(parts: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings, the same as ``range_hashes`` gives for their ranges."""
    buf = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(parts) else ends
    return range_hashes(prefix_sums(BYTE_VALUES[buf]), starts, ends)

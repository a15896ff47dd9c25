"""Stream sources, window aggregates, de-duplication, joins and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.operators.lineage import scratch_folder, stage
from kinetable.session import configure
from kinetable.sources.store import LEAF_ROWS, SessionStore

c = F.col


def read_table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A folder's Parquet file(s) of one table as a stream."""
    schema = configure(spark).read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(folder)


def window_mix(rows: DataFrame, ts: str, keys: Sequence[str], length: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding counts per source; works on batches and streams."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    agg = rows.withWatermark(ts, delay).groupBy(*keys, w.alias("w"), "source").agg(F.count(F.lit(1)).alias("n"))
    return agg.select(*keys, c("w.start").alias("start"), c("w.end").alias("end"), "source", "n")


def gap_sessions(rows: DataFrame, ts: str, keys: Sequence[str], gap: str, delay: str = "10 minutes") -> DataFrame:
    w = F.session_window(ts, gap)
    agg = rows.withWatermark(ts, delay).groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return agg.select(*keys, c("w.start").alias("start"), c("w.end").alias("end"), "n")


def dedupe_frames(rows: DataFrame, ts: str, keys: Sequence[str], delay: str) -> DataFrame:
    """Keep the first row per key within the watermark (a batch overwrite would keep the last)."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def join_dimension(rows: DataFrame, dim: DataFrame, on: Sequence[str]) -> DataFrame:
    """Stream-static join; Spark re-reads the static side every batch and picks the join by size."""
    return rows.join(dim, list(on))


def run_to_table(stream: DataFrame, mode: str = "append", name: str = "stream", path: str | None = None) -> DataFrame:
    """Drain a stream that has an end (``availableNow``) into a table and return it.

    A ``path`` used before goes on where that run stopped: files that came since, same state.
    """
    spark = stream.sparkSession
    path = path or scratch_folder(spark, name)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-ckpt").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", path).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)

    def replace(batch: DataFrame, _batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    writer.foreachBatch(replace).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


class Summary:
    """A table of merged aggregates, updated batch by batch.

    A batch rewrites the leaves of its keys and leaves its number with the version it commits, so a batch that is
    retried after its commit changes nothing, and one that died before starts from the version before it.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], merge: dict[str, Column], max_rows: int = LEAF_ROWS):
        self.store, self.keys, self.merge = SessionStore(spark, path, keys, max_rows), list(keys), merge

    def rows(self) -> DataFrame:
        return self.store.rows()

    def update(self, partial: DataFrame, batch_id: int) -> None:
        """Merge ``partial`` (the keys and the merged columns) into the table as batch ``batch_id``."""
        done = self.store.mark("batch")
        if done is not None and done >= batch_id:
            return
        fresh = stage(partial)

        def merged(now: DataFrame | None) -> DataFrame:
            both = fresh if now is None else now.unionByName(fresh)
            return both.groupBy(*self.keys).agg(*[col.alias(n) for n, col in self.merge.items()])

        self.store.change(fresh, merged, marks={"batch": batch_id})
        self.store.vacuum()


def upsert_summary(stream: DataFrame, keys: Sequence[str], aggregates: dict[str, Column], merge: dict[str, Column], name: str = "summary", path: str | None = None) -> DataFrame:
    """Incremental session summary: each batch's aggregates are merged into the buckets they touch.

    ``merge`` must be associative and name every column of ``aggregates``.
    """
    spark = stream.sparkSession
    path = path or scratch_folder(spark, name)
    summary = Summary(spark, path, keys, merge)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        summary.update(batch.groupBy(*keys).agg(*[col.alias(n) for n, col in aggregates.items()]), batch_id)

    stream.writeStream.option("checkpointLocation", f"{path}-ckpt").trigger(availableNow=True).foreachBatch(upsert).start().awaitTermination()
    return summary.rows()

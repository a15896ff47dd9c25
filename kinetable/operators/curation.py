"""Training-set curation: pooling, merging, oversampling, de-duplication, leak checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.operators.joins import interval_join
from kinetable.operators.ordered import Series, positions

c = F.col


def pool(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Union candidate sources of the same schema, tagged by name."""
    out = None
    for tag, df in sources.items():
        tagged = df.withColumn("source", F.lit(tag))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def number_rows(df: DataFrame, order: Sequence[str], block: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Dense ids over a whole table, or within ``keys``, without a single-task sort.

    The outer prefix sum runs over one row per block.
    """
    if keys:
        return positions(df, Series(list(keys), list(order), block), name)
    return positions(df.withColumn("_all", F.lit(0)), Series(["_all"], list(order), block), name).drop("_all")


def merge_datasets(images: Sequence[DataFrame], annotations: Sequence[DataFrame], tags: Sequence[str], block: str) -> tuple[DataFrame, DataFrame]:
    """Re-key images over several sources; additions are train-only and get a name prefix."""
    parts = []
    for i, (df, tag) in enumerate(zip(images, tags)):
        df = df.withColumns({"source": F.lit(tag), "source_pos": F.lit(i)})
        parts.append(df if i == 0 else df.filter("split = 'train'").withColumn("file_name", F.concat(F.lit(f"{tag}_"), "file_name")))
    pooled = parts[0]
    for df in parts[1:]:
        pooled = pooled.unionByName(df)
    keyed = number_rows(pooled, ["source_pos", "image_id"], block, "new_image_id", ["split"])
    notes = [a.withColumn("source", F.lit(t)) for a, t in zip(annotations, tags)]
    all_notes = notes[0]
    for a in notes[1:]:
        all_notes = all_notes.unionByName(a)
    remapped = all_notes.join(keyed.select("source", "image_id", "split", "new_image_id"), ["source", "image_id"])
    return keyed, remapped


def oversample(df: DataFrame, repeats: Column) -> DataFrame:
    """Repeat rows; ``copy`` numbers the repeats from 1."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), repeats.cast("int"))))


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key wins, by partial aggregation."""
    rest = [n for n in df.columns if n not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def present_labels(df: DataFrame, keys: Sequence[str], label: str, order: Sequence[str]) -> DataFrame:
    """Distinct labels of each group in a fixed display order."""
    seen = df.groupBy(*keys).agg(F.collect_set(F.when(c(label).isin(*order), c(label))).alias("_s"))
    return seen.select(*keys, F.filter(F.array(*[F.lit(o) for o in order]), lambda o: F.array_contains("_s", o)).alias("labels"))


def key_differences(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, with the side; empty when the key sets agree."""
    left, right = a.select(*keys), b.select(*keys)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def exclude_held_out(df: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, lo: str, hi: str) -> DataFrame:
    """Drop rows inside any held-out range."""
    return interval_join(df, ranges, keys, at, lo, hi, how="left_anti")


def normalize_split(col: Column, allowed: Sequence[str] = ("train", "valid", "test")) -> Column:
    return F.when(col.isin(*allowed), col).otherwise("train")


def split_exposure(images: DataFrame, split: str = "split", file: str = "file_name") -> DataFrame:
    return images.groupBy(split).agg(F.count(F.lit(1)).alias("slots"), F.count_distinct(file).alias("unique_files"))


def even_sample(df: DataFrame, series: Series, n: int) -> DataFrame:
    """Every k-th row of each key with k = max(1, rows div n)."""
    rows = positions(df, series, "_pos", "_n")
    step = F.greatest(F.lit(1), F.floor(c("_n") / n))
    return rows.filter(F.pmod(c("_pos") - 1, step) == 0).drop("_pos", "_n")


def sample_frames(lo: Column, hi: Column, most: int = 24) -> Column:
    """At most about ``most`` evenly spaced frames of [lo, hi], the last one always included."""
    span = hi - lo
    n = F.least(F.lit(most), span + 1)
    step = F.greatest(F.lit(1), F.bround(span / F.greatest(F.lit(1), n - 1), 0).cast("int"))
    frames = F.sequence(lo, hi, step)
    full = F.when(F.element_at(frames, -1) == hi, frames).otherwise(F.concat(frames, F.array(hi)))
    return F.when(span <= 0, F.array(lo)).otherwise(full)

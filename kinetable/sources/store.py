"""Session tables: hash leaves that split as they grow, and a manifest that names the current files.

A row's leaf is a prefix of its session's hash.  A leaf that outgrows ``max_rows`` splits by further bits, so a save
rewrites about ``max_rows`` rows a touched session, whatever the table's size, and a point read opens one leaf.
Files are never changed: a save writes new folders for the leaves it touches and then one manifest, created under the
next version's name.  That creation is the commit.  A job that dies before it leaves the last version as it was; of
two that race for one version the second fails and can be run again.  Readers hold a version's folders until
``vacuum`` removes what the newest versions no longer name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.operators.lineage import located, remove_folder, stage, stage_table

c = F.col
#: Rows of a leaf, bits that one split adds at most, and bits that leaves may use.
LEAF_ROWS, SPLIT_BITS, MOST_BITS = 1 << 20, 6, 48
INTERRUPTED = "Analysis was interrupted before it finished; please submit the session again."


class Conflict(RuntimeError):
    """Another job has committed the version that this one was about to write."""


class SessionStore:
    """A table of sessions; ``keys`` name a session."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = ("sid",), max_rows: int = LEAF_ROWS):
        self.spark, self.path, self.keys, self.max_rows = spark, path.rstrip("/"), list(keys), max_rows

    # ------------------------------------------------------------------ versions

    def _versions(self) -> list[int]:
        files, place = located(self.spark, f"{self.path}/manifest")
        if not files.exists(place):
            return []
        return sorted(int(f.getPath().getName()) for f in files.listStatus(place) if f.getPath().getName().isdigit())

    def _manifest(self, version: int | None = None) -> dict:
        """The newest version, or the one asked for: its number, schema, leaves ``bits -> [folder, rows]`` and marks."""
        known = self._versions()
        if not known:
            return {"version": 0, "schema": None, "leaves": {}, "marks": {}}
        files, place = located(self.spark, f"{self.path}/manifest/{known[-1] if version is None else version}")
        stream = files.open(place)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, manifest: dict) -> None:
        """Create the next version's manifest; exclusive, and complete under a name of its own before it is renamed."""
        target = f"{self.path}/manifest/{manifest['version']}"
        files, place = located(self.spark, target)
        _, draft = located(self.spark, f"{self.path}/manifest/.{uuid.uuid4().hex}")
        stream = files.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        if files.exists(place) or not files.rename(draft, place):
            files.delete(draft, False)
            raise Conflict(f"version {manifest['version']} of {self.path} exists already")

    def mark(self, name: str):
        """A value that a committed change has left with the version."""
        return self._manifest()["marks"].get(name)

    # ------------------------------------------------------------------ reading

    def _read(self, manifest: dict, leaves: Sequence[str] | None = None) -> DataFrame:
        held = manifest["leaves"]
        folders = [f"{self.path}/data/{held[b][0]}" for b in (held if leaves is None else leaves) if b in held]
        schema = T.StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def rows(self, version: int | None = None) -> DataFrame:
        manifest = self._manifest(version)
        if manifest["schema"] is None:
            raise FileNotFoundError(self.path)
        return self._read(manifest)

    def get(self, *key) -> DataFrame:
        """Point read: one leaf's files, and the key's filter reaches the scan."""
        manifest = self._manifest()
        types = T.StructType.fromJson(manifest["schema"])
        typed = [F.lit(v).cast(types[k].dataType) for k, v in zip(self.keys, key)]
        bits = self.spark.range(1).select(_bits(typed, MOST_BITS)).first()[0]
        rows = self._read(manifest, [b for b in manifest["leaves"] if bits.startswith(b)])
        for k, v in zip(self.keys, typed):
            rows = rows.filter(c(k) == v)
        return rows

    # ------------------------------------------------------------------ writing

    def _placed(self, rows: DataFrame, leaves: Sequence[str]) -> DataFrame:
        """Rows with their leaf: a lookup of the hash's prefix for each depth that leaves have, in place, without a shuffle.

        The depths are few, as hashes spread evenly, and the leaves are no more than the manifest names.
        """
        by_depth: dict[int, list[str]] = {}
        for b in leaves:
            by_depth.setdefault(len(b), []).append(b)
        at = lambda depth: f"substring(_hash, 1, {depth})"
        found = [f"CASE WHEN {at(d)} IN ({', '.join(repr(b) for b in own)}) THEN {at(d)} END" for d, own in sorted(by_depth.items())] + ["CAST(NULL AS STRING)"]
        return rows.withColumn("_hash", _bits([c(k) for k in self.keys], MOST_BITS)).withColumn("_leaf", F.expr(f"coalesce({', '.join(found)})")).drop("_hash")

    def _parts(self, rows: DataFrame, large: Sequence[str]) -> DataFrame:
        """What the leaves hold by the bits that a split may add: rows, and the smallest and largest hash (as numbers, so that no rows are sorted)."""
        keys = [c(k) for k in self.keys]
        deeper = F.substring(_bits(keys, MOST_BITS), F.lit(1), F.length("_leaf") + SPLIT_BITS)
        own = F.shiftrightunsigned(F.xxhash64(*keys), 64 - MOST_BITS)
        agg = [F.count(F.lit(1)).alias("n"), F.min(own).alias("low"), F.max(own).alias("high")]
        return rows.filter(c("_leaf").isin(large)).groupBy("_leaf", deeper.alias("bits")).agg(*agg)

    def _split(self, rows: DataFrame, leaves: Sequence[str]) -> dict[str, int]:
        """New leaves with their rows, for leaves that hold ``rows``: those that are too large are split."""
        sizes = {r["_leaf"]: r["n"] for r in rows.groupBy("_leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
        out = {b: n for b, n in sizes.items() if n <= self.max_rows}
        large = [b for b in sizes if b not in out]
        if large:
            parts = self._parts(rows, large).collect()
            for b in large:
                held, todo = [r for r in parts if r["_leaf"] == b], [b]
                while todo:
                    at = todo.pop()
                    here = [r for r in held if r["bits"].startswith(at)]
                    n = sum(r["n"] for r in here)
                    several = here and min(r["low"] for r in here) != max(r["high"] for r in here)
                    if n > self.max_rows and several and len(at) < min(len(b) + SPLIT_BITS, MOST_BITS):
                        todo += [at + "0", at + "1"]
                    elif n:
                        out[at] = n
        return out

    def change(self, touched: DataFrame, fn: Callable[[DataFrame | None], DataFrame], schema: T.StructType | None = None, marks: dict | None = None) -> None:
        """Replace the leaves of the sessions in ``touched`` by ``fn(their rows)`` and commit the next version."""
        old = self._manifest()
        leaves = list(old["leaves"]) or [""]
        if not old["leaves"]:
            hit = [""]
        else:
            every = _cover(leaves)
            hit = [r[0] for r in self._placed(touched.select(*self.keys).distinct(), every).select("_leaf").distinct().collect()]
        now = self._read(old, hit) if old["schema"] is not None else None
        rows = fn(now)
        if old["schema"] is not None and schema is None:
            schema = T.StructType.fromJson(old["schema"])
        names = schema.fieldNames() if schema is not None else rows.columns
        if set(rows.columns) != set(names):
            raise ValueError(f"columns {sorted(set(rows.columns) ^ set(names))} are on one side only")
        rows = stage_table(self._placed(rows.select(names), hit), "save")
        new = self._split(rows, hit)
        folder = uuid.uuid4().hex
        dealt = self._placed(rows.drop("_leaf"), list(new)) if new and set(new) != set(hit) else rows
        # a leaf that stays too large is several files, dealt by whole rows: one session's, or many alike
        files = F.create_map(*[F.lit(x) for b, n in new.items() if n > self.max_rows for x in (b, -(-n // self.max_rows))]) if any(n > self.max_rows for n in new.values()) else None
        piece = F.lit(0) if files is None else F.pmod(F.hash(*names), F.coalesce(F.try_element_at(files, c("_leaf")), F.lit(1)))
        if new:
            dealt.withColumn("_piece", piece).repartition("_leaf", "_piece").drop("_piece").withColumn("leaf", F.concat(F.lit("r"), c("_leaf"))).drop("_leaf").write.partitionBy("leaf").parquet(f"{self.path}/data/{folder}")
        kept = {b: v for b, v in old["leaves"].items() if b not in hit}
        made = {b: [f"{folder}/leaf=r{b}", n] for b, n in new.items()}
        self._commit({"version": old["version"] + 1, "schema": rows.drop("_leaf").schema.jsonValue(), "leaves": kept | made, "marks": old["marks"] | (marks or {})})

    def replace(self, rows: DataFrame) -> None:
        """Replace the sessions of ``rows``; all others stay.  A missing or further column is an error."""
        ids = stage(rows.select(*self.keys).distinct())
        self.change(ids, lambda now: rows if now is None else now.join(ids, self.keys, "left_anti").unionByName(rows))

    def delete(self, gone: DataFrame) -> int:
        """Delete the sessions of ``gone``; returns the number of rows deleted.  Running it again is harmless."""
        ids = stage(gone.select(*self.keys).distinct())
        lost = self.rows().join(ids, self.keys, "left_semi").count()
        if lost:
            self.change(ids, lambda now: now.join(ids, self.keys, "left_anti"))
        return lost

    def vacuum(self, versions: int = 2) -> int:
        """Remove manifests before the last ``versions`` and the data that none of these names; returns the folders removed."""
        known = self._versions()
        kept = {v[0].split("/")[0] for n in known[-versions:] for v in self._manifest(n)["leaves"].values()}
        for n in known[:-versions]:
            remove_folder(self.spark, f"{self.path}/manifest/{n}")
        files, place = located(self.spark, f"{self.path}/data")
        old = [f.getPath() for f in files.listStatus(place) if f.getPath().getName() not in kept] if files.exists(place) else []
        for folder in old:
            files.delete(folder, True)
        return len(old)


def _bits(values: Sequence[Column], depth: int) -> Column:
    """The first bits of the session's hash, as text."""
    if not depth:
        return F.lit("")
    return F.substring(F.lpad(F.bin(F.xxhash64(*values)), 64, "0"), 1, depth)


def _cover(leaves: Sequence[str]) -> list[str]:
    """The leaves and, for prefixes that none holds (emptied ones), the missing siblings: together every hash has one leaf."""
    inner = {b[:i] for b in leaves for i in range(len(b))}
    return [*leaves, *[b + x for b in inner for x in "01" if b + x not in inner and b + x not in leaves]]


# ---------------------------------------------------------------------- jobs on session tables


def delete_sessions(sessions: SessionStore, shots: SessionStore, gone: DataFrame) -> tuple[int, int]:
    """Cascade: attempts first, so that a job that stops half-way leaves no attempt without a session.

    Returns the numbers of sessions and attempts deleted; running it again is harmless.
    """
    gone = stage(gone.select(*sessions.keys).distinct())
    n = shots.delete(gone)
    return sessions.delete(gone), n


def reconcile_orphans(sessions: DataFrame) -> DataFrame:
    """Sessions still marked processing become interrupted; ``changed`` marks them."""
    lost = c("status") == "processing"
    return sessions.withColumns(
        {"changed": lost, "error_message": F.when(lost, INTERRUPTED).otherwise(c("error_message")), "status": F.when(lost, "interrupted").otherwise(c("status"))}
    )


def reconcile_table(store: SessionStore) -> int:
    """Mark the table's orphans; only their leaves are written again.  Returns their number."""
    orphans = stage(store.rows().filter("status = 'processing'").select(*store.keys))
    lost = orphans.count()
    if lost:
        store.change(orphans, lambda rows: reconcile_orphans(rows).drop("changed"))
    return lost


def mark_failed(store: SessionStore, failures: DataFrame) -> int:
    """Set status and message of the sessions of ``failures`` (``keys, error_message``).

    Unknown sessions are left out; of several messages for one session the smallest is taken.
    Returns the number of sessions marked.
    """
    k = store.keys
    told = stage(failures.groupBy(*k).agg(F.min("error_message").alias("_told"), F.lit(True).alias("_failed")))
    marked = store.rows().join(told, k, "left_semi").count()
    if marked:

        def change(rows: DataFrame) -> DataFrame:
            new = {"status": F.when(c("_failed"), "failed").otherwise(c("status")), "error_message": F.when(c("_failed"), c("_told")).otherwise(c("error_message"))}
            return rows.join(told, k, "left").select(*[new[n].alias(n) if n in new else c(n) for n in rows.columns])

        store.change(told, change)
    return marked

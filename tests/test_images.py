"""The frame store: PNG there and back, what the scan skips, and motion against plain masks."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.operators.roi_motion import AreaTable, _pair_motion, disk_spans
from kinetable.sources import images


def filtered_png(rows, n, color, kinds):
    """A PNG by hand, with a given filter for each row."""
    height, stride = rows.shape[0], rows.shape[1]
    raw, above = b"", np.zeros(stride, int)
    for y in range(height):
        line = rows[y].astype(int)
        left = np.concatenate([np.zeros(n, int), line[:-n]])
        corner = np.concatenate([np.zeros(n, int), above[:-n]])
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        off = (0, left, above, (left + above) // 2, near)[kinds[y]]
        raw += bytes([kinds[y]]) + ((line - off) % 256).astype(np.uint8).tobytes()
        above = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", stride // n, height, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("color, n", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_every_row_filter_is_undone(color, n):
    rows = np.random.default_rng(color).integers(0, 256, (10, 7 * n), dtype=np.uint8)
    got = images.gray(filtered_png(rows, n, color, [0, 1, 2, 3, 4, 4, 3, 2, 1, 0]))
    assert np.allclose(got, rows.reshape(10, 7, n)[:, :, : {2: 1, 4: 3}.get(n, n)].mean(axis=2))


def test_there_and_back():
    rng = np.random.default_rng(0)
    for kind, top in ((np.uint8, 256), (np.uint16, 65536)):
        x = rng.integers(0, top, (9, 5)).astype(kind)
        assert (images.gray(images.png(x)) == x).all()
    assert images.shrunk(np.arange(20.0).reshape(4, 5), 2).tolist() == [[3.0, 5.0], [13.0, 15.0]]
    for bad in (b"", b"nothing", images.png(x)[:20]):
        with pytest.raises((ValueError, struct.error, zlib.error)):
            images.gray(bad)


def test_store_reads_only_what_is_asked(spark, tmp_path):
    path = str(tmp_path / "frames")
    rows = spark.range(400).select(F.floor(F.col("id") / 100).alias("sid"), (F.col("id") % 100).alias("frame_index"), (F.col("id") % 100 / 30).alias("timestamp_sec"), F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: (i * 1000 + F.col("id")).cast("int")).alias("gray"), F.lit(4).alias("width"))
    images.write_frames(rows, path, partitions=8)
    seen = images.read_frames(spark, path, (F.col("sid") == 2) & F.col("frame_index").between(10, 30), stride=3)
    got = {r["source_frame"]: r for r in seen.collect()}
    assert sorted(got) == list(range(12, 31, 3)) and got[12]["frame_index"] == 4
    assert (got[12]["width"], got[12]["height"], got[12]["valid"]) == (4, 3, True) and got[12]["gray"] == [i * 1000.0 + 212 for i in range(12)]
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(sid,2)" in plan and "GreaterThanOrEqual(frame_index,10)" in plan
    spark.createDataFrame([(9, 0, 0.0, bytearray(b"broken")), (9, 1, 0.0, None)], "sid long, frame_index long, timestamp_sec double, image binary").write.mode("append").parquet(path)
    assert [(r["valid"], r["gray"]) for r in images.read_frames(spark, path, F.col("sid") == 9).collect()] == [(False, None)] * 2


def test_motion_equals_plain_masks():
    rng = random.Random(4)
    for _ in range(200):
        h, w = rng.randint(3, 12), rng.randint(3, 12)
        a, b = (np.array([rng.randint(0, 99) for _ in range(h * w)], float) for _ in range(2))
        ball = None if rng.random() < 0.3 else {"x": rng.choice([rng.randint(-2, w), rng.uniform(-2, w)]), "y": rng.choice([rng.randint(-2, h), rng.uniform(0, h)]), "r": rng.choice([1.0, 2.0, rng.uniform(0, 5)])}
        person = None if rng.random() < 0.3 else {"x1": rng.uniform(-2, w), "y1": rng.randint(-2, h), "x2": rng.uniform(0, w + 2), "y2": rng.randint(0, h + 2)}
        region = (rng.randint(0, w), rng.randint(0, h), rng.randint(0, w), rng.randint(0, h))
        yy, xx = np.mgrid[0:h, 0:w]
        keep = (xx >= region[0]) & (xx < region[2]) & (yy >= region[1]) & (yy < region[3])
        if ball:
            keep &= ~((xx - ball["x"]) ** 2 + (yy - ball["y"]) ** 2 <= ball["r"] ** 2)
        if person:
            keep &= ~((xx >= person["x1"]) & (xx <= person["x2"]) & (yy >= person["y1"]) & (yy <= person["y2"]))
        diff = np.abs(a - b).reshape(h, w)
        want = None if region[2] <= region[0] or region[3] <= region[1] else diff[keep].mean() if keep.any() else 0.0
        got = _pair_motion(a, b, w, [region], ball, person)[0]
        assert got == want or abs(got - want) < 1e-9
    assert AreaTable(np.ones((2, 2))).box(-5, -5, 9, 9) == (4.0, 4) and disk_spans(1.0, 1.0, 0.0, 3) == [(1, 1, 2)]

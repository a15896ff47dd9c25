"""Order-dependent machines in one pass, against plain loops."""

import random
from math import hypot

from pyspark.sql import functions as F

from kinetable.operators import aggregates as ag
from kinetable.operators import track as tr
from kinetable.operators.onepass import PlaceIndex


def jobs_of(spark, action):
    """Result of an action and the number of Spark jobs it took."""
    tracker, group = spark.sparkContext.statusTracker(), f"g{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    out = action()
    found = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, found


def linear_clusters(rows, radius=40.0):
    """The first cluster in order whose running centroid is near enough, by looking at all of them."""
    state, out = [], []
    for x, y in rows:
        for i, (n, sx, sy) in enumerate(state):
            if ((x - sx / n) ** 2 + (y - sy / n) ** 2) ** 0.5 <= radius:
                state[i] = (n + 1, sx + x, sy + y)
                out.append(i)
                break
        else:
            state.append((1, x, y))
            out.append(len(state) - 1)
    return out


def test_clusters_equal_a_linear_search(spark):
    rng = random.Random(3)
    rows = {s: [(rng.uniform(-500, 500), rng.choice([0.0, 40.0, -40.0, rng.uniform(0, 300)])) for _ in range(600)] for s in ("a", "b", None)}
    flat = [(s, i, x, y) for s, v in rows.items() for i, (x, y) in enumerate(v)]
    df = spark.createDataFrame(flat, "sid string, frame_index long, x double, y double").repartition(5)
    got = {}
    for r in ag.greedy_clusters(df, ["sid"], ["frame_index"]).collect():
        got.setdefault(r["sid"], {})[r["frame_index"]] = r["cluster"]
    for s, v in rows.items():
        assert [got[s][i] for i in range(600)] == linear_clusters(v)


def test_rows_without_a_place_have_no_cluster(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 1.0), ("a", 1, None, 1.0), ("a", 2, float("nan"), 0.0), ("a", 3, 2.0, 2.0)], "sid string, frame_index long, x double, y double")
    assert sorted((r["frame_index"], r["cluster"]) for r in ag.greedy_clusters(df, ["sid"], ["frame_index"]).collect()) == [(0, 0), (1, None), (2, None), (3, 0)]
    assert ag.greedy_clusters(df.limit(0), ["sid"], ["frame_index"]).count() == 0


def test_job_count_does_not_grow_with_a_session(spark):
    """Five blocks' worth of frames and a hundred: the same number of jobs."""
    counts = []
    for frames in (5 * 4096, 100 * 4096):
        df = spark.range(frames).select(F.lit("s").alias("sid"), F.col("id").alias("frame_index"), (F.col("id") % 700).cast("double").alias("x"), F.lit(0.0).alias("y"))
        n, jobs = jobs_of(spark, lambda: ag.greedy_clusters(df, ["sid"], ["frame_index"]).count())
        assert n == frames
        counts.append(jobs)
    assert counts[0] == counts[1]


def linear_primary(frames, reach=1.5, recent=30):
    slots, out = [], []
    for boxes in frames:
        holder = {}
        for i, x1, y1, x2, y2 in boxes:
            w, h, cx, cy = x2 - x1, y2 - y1, (x1 + x2) / 2, (y1 + y2) / 2
            near = min(range(len(slots)), key=lambda s: hypot(cx - slots[s][0], cy - slots[s][1]), default=None)
            if near is None or hypot(cx - slots[near][0], cy - slots[near][1]) >= reach * max(w, h):
                slots.append((cx, cy, []))
                near = len(slots) - 1
            slots[near] = (cx, cy, (slots[near][2] + [w * h])[-recent:])
            holder[near] = i
        best = max(sorted(holder), key=lambda s: sum(slots[s][2]) / len(slots[s][2]), default=None)
        out.append((holder.get(best), best))
    return out


def test_primary_subject_equals_a_linear_search(spark):
    rng = random.Random(8)
    frames = []
    for f in range(400):
        boxes = []
        for i in range(rng.randint(0, 4)):
            x, y, w = rng.choice([0, 90, 300, 800]) + rng.uniform(-30, 30), rng.uniform(0, 60), rng.uniform(5, 90)
            boxes.append((f * 10 + i, x, y, x + w, y + 2 * w))
        frames.append(boxes)
    rows = [("s", f, *b) for f, boxes in enumerate(frames) for b in boxes] + [("s", f, None, None, None, None, None) for f, boxes in enumerate(frames) if not boxes]
    df = spark.createDataFrame(rows, "sid string, frame_index long, id long, x1 double, y1 double, x2 double, y2 double").repartition(4)
    got = sorted((r["frame_index"], r["box_id"], r["slot"]) for r in tr.select_primary(df, ["sid"]).collect())
    assert got == [(f, *v) for f, v in enumerate(linear_primary(frames))]


def test_primary_subject_prefers_the_large_slot(spark):
    big, small = (0.0, 0.0, 20.0, 40.0), (200.0, 0.0, 210.0, 10.0)
    rows = [("s", 0, 1, *big), ("s", 0, 2, *small), ("s", 1, 2, *small), ("s", 2, 1, *big), ("s", 2, 2, *small)]
    df = spark.createDataFrame(rows, "sid string, frame_index long, id long, x1 double, y1 double, x2 double, y2 double")
    assert [r["box_id"] for r in tr.select_primary(df, ["sid"]).orderBy("frame_index").collect()] == [1, 2, 1]


def test_places_follow_their_moves():
    rng, held, want = random.Random(1), PlaceIndex(10.0), {}
    for _ in range(300):
        x, y = rng.uniform(-99, 99), rng.uniform(-99, 99)
        if want and rng.random() < 0.5:
            at = rng.randrange(len(want))
            held.move(at, x, y)
        else:
            at = held.add(x, y)
        want[at] = (x, y)
        for reach in (3.0, 10.0, 35.0):
            near = {i for i, (a, b) in want.items() if hypot(a - 5, b - 5) <= reach}
            assert near <= set(held.around(5.0, 5.0, reach))


def test_primary_distances_and_means_are_those_of_sql():
    """A last bit decides: sqrt(11.7^2 + 0.7^2) is above 11.720921465482139, where hypot gives just that; sums go in order."""
    m = tr.PrimaryMachine()
    for x, y, areas in ((11.7, 0.7, (439.4599999999999, 152.88000000000002, 894.4)), (11.720921465482139, 0.0, (894.4, 152.88000000000002, 439.4599999999999))):
        m.places.add(x, y)
        m.areas.append(tr.deque(areas, maxlen=30))
    m.row(3, 7, -50.0, -50.0, 50.0, 50.0)
    assert m.holder == {1: 7}
    m = tr.PrimaryMachine()
    first, second = (894.4, 152.88000000000002, 439.4599999999999), (439.4599999999999, 894.4, 152.88000000000002)
    m.areas, m.frame, m.holder = [tr.deque(first), tr.deque(second)], 3, {0: 5, 1: 6}
    plain = [(a + b + c) / 3 for a, b, c in (first, second)]
    assert plain[0] < plain[1] and m.end() == [(3, 6, 1)]

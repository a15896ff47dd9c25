"""Block scans and halos against plain pandas, with one key holding most rows."""

import random

import pandas as pd
from pyspark.sql import functions as F

from kinetable.operators import ordered as od
from kinetable.operators import windows as win


def hot_series(n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for sid, size in (("hot", n), ("a", 7), ("b", 1)):
        for i in range(size):
            rows.append((sid, i, None if rng.random() < 0.3 else float(rng.randint(0, 20)), rng.random() < 0.2))
    rng.shuffle(rows)
    return pd.DataFrame(rows, columns=["sid", "i", "v", "mark"]).astype({"v": object})


def collect(df, *cols):
    return {(r["sid"], r["i"]): tuple(r[c] for c in cols) for r in df.collect()}


def test_scan_matches_pandas_over_many_blocks(spark):
    pdf = hot_series()
    df = spark.createDataFrame(pdf, "sid string, i long, v double, mark boolean")
    got = collect(
        od.scan(
            df, od.Series(["sid"], ["i"], "floor(i / 5)"),
            p=od.prev_row(F.col("v")), n=od.next_row(F.col("v")), b=od.last_before(F.when(F.col("mark"), F.col("v"))),
            a=od.first_after(F.when(F.col("mark"), F.col("v"))), s=od.running_sum(F.col("v")), m=od.running_max(F.col("v")),
            mb=od.running_max_before(F.col("v")), t=od.total(F.col("v")),
        ),
        "p", "n", "b", "a", "s", "m", "mb", "t",
    )
    assert len(got) == len(pdf)
    for sid, part in pdf.sort_values("i").groupby("sid"):
        vs, marks = [None if v != v else v for v in part["v"]], part["mark"].tolist()
        known = lambda xs: [x for x in xs if x is not None]
        for k in range(len(vs)):
            before = [v for v, m in zip(vs[:k], marks[:k]) if m and v is not None]
            after = [v for v, m in zip(vs[k + 1 :], marks[k + 1 :]) if m and v is not None]
            upto = known(vs[: k + 1])
            want = (
                vs[k - 1] if k else None, vs[k + 1] if k + 1 < len(vs) else None, before[-1] if before else None, after[0] if after else None,
                sum(upto) if upto else None, max(upto) if upto else None, max(known(vs[:k]), default=None), sum(known(vs)) if known(vs) else None,
            )
            assert got[(sid, k)] == want, (sid, k)


def test_blocks_and_plain_windows_agree(spark):
    df = spark.createDataFrame(hot_series(seed=2), "sid string, i long, v double, mark boolean")
    spec = {"s": od.running_sum(F.col("v")), "b": od.last_before(F.col("v"))}
    blocks = collect(od.scan(df, od.Series(["sid"], ["i"], "floor(i / 7)"), **spec), "s", "b")
    plain = collect(od.scan(df, od.Series(["sid"], ["i"]), **spec), "s", "b")
    assert blocks == plain


def test_positions_and_total(spark):
    df = spark.createDataFrame(hot_series(seed=3), "sid string, i long, v double, mark boolean")
    got = collect(od.positions(df, od.Series(["sid"], ["i"], "floor(i / 4)"), "pos", "n"), "pos", "n")
    assert all(pos == i + 1 for (_, i), (pos, _) in got.items())
    assert got[("hot", 0)][1] == 300 and got[("b", 0)][1] == 1


def test_halo_rows_equal_full_window(spark):
    df = spark.createDataFrame(hot_series(seed=4), "sid string, i long, v double, mark boolean")
    halo = od.with_halo(df, ["sid"], "i", before=9, after=2, size=8)
    w = halo.window().rowsBetween(-9, 2)
    got = collect(halo.select(m=F.max("v").over(w)), "m")
    pdf = hot_series(seed=4).sort_values("i")
    for sid, part in pdf.groupby("sid"):
        vs = [None if v != v else v for v in part["v"]]
        for k in range(len(vs)):
            seen = [v for v in vs[max(0, k - 9) : k + 3] if v is not None]
            assert got[(sid, k)][0] == (max(seen) if seen else None)


def test_streaks_across_block_borders(spark):
    rows = [("s", i, 3 <= i < 23) for i in range(30)]
    df = spark.createDataFrame(rows, "sid string, i long, ok boolean")
    got = win.streaks(df, od.Series(["sid"], ["i"], "floor(i / 4)"), F.col("ok"), 3).collect()
    assert [(r["start"], r["end"], r["length"]) for r in got] == [(3, 22, 20)]


def test_dim_join_keeps_all_rows(spark):
    facts = spark.createDataFrame([("hot", i) for i in range(50)] + [("x", 1)], "sid string, i long")
    dim = spark.createDataFrame([("hot", 1.0)], "sid string, w double")
    assert od.dim_join(facts, dim, ["sid"], "left", spread=["i"], salts=4).filter("w IS NULL").count() == 1
    assert od.dim_join(facts, dim, ["sid"], spread=["i"], salts=4).count() == 50


def test_salted_copies_are_not_broadcast_by_the_size_of_one(spark):
    facts = spark.range(200).select((F.col("id") % 50).alias("sid"), F.col("id").alias("i"))
    dim = spark.range(60_000).select(F.col("id").alias("sid"), (F.col("id") * 2).alias("w"))
    joined = od.dim_join(facts, dim, ["sid"], "left", spread=["i"])
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().sparkPlan().toString()
    assert joined.filter("w = sid * 2").count() == 200

"""Query registry and the bindings of the given tables to the operators' roles.

Each binding exists twice: as a DataFrame and as SQL text for the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.operators.lineage import stage
from kinetable.operators.ordered import Series, positions
from kinetable.plans.registry import Metric
from kinetable.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- attempts (lineitem)

SHOT_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
SHOT_METRICS = (
    Metric("quantity", "Quantity", "units", "l_quantity"),
    Metric("unit_price_root", "Unit price root", "money", "sqrt(l_extendedprice / l_quantity)"),
    Metric("discount_root", "Discount root", "money", "sqrt(l_extendedprice * l_discount)"),
    Metric("tax_root", "Tax root", "money", "CASE WHEN l_tax > 0 THEN sqrt(l_extendedprice * l_tax) END"),
)
_SHOT_COLUMNS = """
    CASE l_returnflag WHEN 'A' THEN 'made' WHEN 'R' THEN 'missed' ELSE 'unknown' END AS outcome,
    (l_tax >= 0.075) AS excluded_from_analysis,
    l_quantity / 51.3D AS pose_quality,
    1.0D - l_discount * 4.8713D AS ball_track_quality,
    l_tax * 9.8712D AS hoop_confidence,
    1.0D - l_tax * 8 AS release_confidence,
    {day} AS start_time_sec,
    {day} + l_quantity AS end_time_sec"""
_SHOT_SQL = _SHOT_COLUMNS.replace("51.3D", "51.3::DOUBLE").replace("4.8713D", "4.8713::DOUBLE").replace("9.8712D", "9.8712::DOUBLE").replace("1.0D", "1.0::DOUBLE").format(
    day="date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))::DOUBLE"
)


def shots(spark: SparkSession, sf_dir: str, sid: str = "l_orderkey") -> DataFrame:
    columns = _SHOT_COLUMNS.format(day="CAST(datediff(CAST(l_shipdate AS DATE), DATE '1995-01-01') AS DOUBLE)")
    items = table(spark, sf_dir, "lineitem")
    return items.selectExpr(f"{sid} AS sid", "*", *[c.strip() for c in _split(columns)])


def _split(columns: str) -> list[str]:
    return [line.strip().rstrip(",") for line in columns.strip().splitlines()]


def shot_series() -> Series:
    """Attempts of a session by date; blocks are months, so a hot session spreads over them."""
    return Series(["sid"], SHOT_ORDER, "year(l_shipdate) * 12 + month(l_shipdate)")


def shots_sql(sid: str = "l_orderkey") -> str:
    return f"shots AS (SELECT {sid} AS sid, *, {_SHOT_SQL} FROM lineitem)"


METRICS_SQL = """metric_rows AS (
  SELECT *, unnest([
    {pos: 0, key: 'quantity', label: 'Quantity', unit: 'units', value: l_quantity},
    {pos: 1, key: 'unit_price_root', label: 'Unit price root', unit: 'money', value: sqrt(l_extendedprice / l_quantity)},
    {pos: 2, key: 'discount_root', label: 'Discount root', unit: 'money', value: sqrt(l_extendedprice * l_discount)},
    {pos: 3, key: 'tax_root', label: 'Tax root', unit: 'money', value: CASE WHEN l_tax > 0 THEN sqrt(l_extendedprice * l_tax) END}
  ]) AS m FROM shots)"""


# ------------------------------------------------------------ frame series (events)

EVENT_SERIES = Series(["user_id"], ["ts", "event_id"], "unix_date(to_date(ts))")
_SOURCE = """CASE event_type WHEN 'view' THEN 'detected' WHEN 'purchase' THEN 'detected' WHEN 'click' THEN 'interpolated'
    WHEN 'signup' THEN 'predicted' ELSE 'unavailable' END"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a dense 30 fps frame series per user: x from props, y from value."""
    ev = positions(table(spark, sf_dir, "events"), EVENT_SERIES, "pos")
    k = F.from_json("props", "k INT")["k"].cast("double")
    return ev.select(
        F.col("user_id").alias("sid"),
        (F.col("pos") - 1).alias("frame_index"),
        ((F.col("pos") - 1) / F.lit(30.0)).alias("timestamp_sec"),
        k.alias("x"),
        F.col("value").alias("y"),
        F.expr(_SOURCE).alias("source"),
        (F.pmod(F.col("event_id") * 31, F.lit(97)) / F.lit(96.0)).alias("confidence"),
        (F.lit(3.0) + F.pmod("event_id", F.lit(5))).alias("radius"),
        "event_id",
        "ts",
    )


FRAMES_SQL = f"""frames AS (
  SELECT user_id AS sid, pos - 1 AS frame_index, (pos - 1) / 30.0::DOUBLE AS timestamp_sec,
         CAST(json_extract(props, '$.k') AS DOUBLE) AS x, value AS y, {_SOURCE} AS source,
         ((event_id * 31) % 97) / 96.0::DOUBLE AS confidence, 3.0::DOUBLE + event_id % 5 AS radius, event_id, ts
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events))"""

FRAME_SERIES = Series.frames(["sid"])

# --------------------------------------------- attempts with flight points (events)

ATTEMPT_FRAMES = 12
HOOP_X, HOOP_Y, HOOP_R = 50.0, 60.0, 12.0


def flight_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve consecutive frames form one attempt; frames 4 apart leave room for crossings."""
    return frames(spark, sf_dir).withColumn("shot_index", F.floor(F.col("frame_index") / ATTEMPT_FRAMES))


def hoops(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("sid")).distinct()
    return users.select(
        "sid",
        F.lit(HOOP_X).alias("hoop_x"),
        F.lit(HOOP_Y).alias("hoop_y"),
        F.lit(HOOP_R).alias("hoop_r"),
        (F.lit(0.25) + F.pmod("sid", F.lit(8)) / F.lit(10.0)).alias("hoop_conf"),
    )


POINTS_SQL = f"points AS (SELECT *, frame_index // {ATTEMPT_FRAMES} AS shot_index FROM frames)"
HOOPS_SQL = f"""hoops AS (SELECT DISTINCT user_id AS sid, {HOOP_X}::DOUBLE AS hoop_x, {HOOP_Y}::DOUBLE AS hoop_y,
  {HOOP_R}::DOUBLE AS hoop_r, 0.25::DOUBLE + (user_id % 8) / 10.0::DOUBLE AS hoop_conf FROM events)"""

# -------------------------------------------------------------- poses (embeddings)

JOINTS = (
    "nose", "left_shoulder", "right_shoulder", "left_elbow", "right_elbow", "left_wrist", "right_wrist",
    "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle",
)


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-number vectors as thirteen joints of (x, y, z, visibility); one session per label."""
    emb = table(spark, sf_dir, "embeddings")
    series = Series(["label"], ["vec_id"], "floor(vec_id / 4096)")
    placed = positions(emb, series, "pos")

    def joint(i: int) -> Column:
        at = [F.element_at("embedding", 4 * i + j + 1).cast("double") for j in range(4)]
        return F.struct(
            (at[0] + 0.5).alias("x"), (at[1] + 0.5).alias("y"), at[2].alias("z"),
            F.least(F.lit(1.0), F.abs(at[3]) * 8).alias("visibility"),
        ).alias(JOINTS[i])

    return placed.select(
        F.col("label").cast("long").alias("sid"),
        (F.col("pos") - 1).alias("frame_index"),
        ((F.col("pos") - 1) / F.lit(30.0)).alias("timestamp_sec"),
        (F.pmod("vec_id", F.lit(7)) != 0).alias("detected"),
        F.struct(*[joint(i) for i in range(len(JOINTS))]).alias("joints"),
        "vec_id",
    )


def _joint_sql(i: int) -> str:
    at = [f"embedding[{4 * i + j + 1}]::DOUBLE" for j in range(4)]
    n = JOINTS[i]
    return f"{at[0]} + 0.5 AS {n}_x, {at[1]} + 0.5 AS {n}_y, least(1.0::DOUBLE, abs({at[3]}) * 8) AS {n}_v"


POSES_SQL = f"""poses AS (
  SELECT label::BIGINT AS sid, pos - 1 AS frame_index, (pos - 1) / 30.0::DOUBLE AS timestamp_sec, vec_id % 7 <> 0 AS detected, vec_id,
    {', '.join(_joint_sql(i) for i in range(len(JOINTS)))}
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos FROM embeddings))"""

# ------------------------------------------------- detections, candidates (events)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several boxes per session and day; the day of the month is the frame."""
    ev = table(spark, sf_dir, "events")
    k = F.from_json("props", "k INT")["k"].cast("double")
    return ev.select(
        F.col("user_id").alias("sid"),
        F.dayofmonth("ts").cast("long").alias("frame_index"),
        k.alias("x1"), F.col("value").alias("y1"),
        (k + 4 + F.pmod("event_id", F.lit(13))).alias("x2"),
        (F.col("value") + 4 + F.pmod("event_id", F.lit(11))).alias("y2"),
        (F.pmod(F.col("event_id") * 31, F.lit(97)) / F.lit(96.0)).alias("confidence"),
        F.col("event_type").alias("class_name"),
        "event_id",
    )


DETECTIONS_SQL = """detections AS (
  SELECT user_id AS sid, day(ts)::BIGINT AS frame_index, CAST(json_extract(props, '$.k') AS DOUBLE) AS x1, value AS y1,
    CAST(json_extract(props, '$.k') AS DOUBLE) + 4 + event_id % 13 AS x2, value + 4 + event_id % 11 AS y2,
    ((event_id * 31) % 97) / 96.0::DOUBLE AS confidence, event_type AS class_name, event_id FROM events)"""
DETECTION_DAYS = 31


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"

# ------------------------------------------------------- frame signals (events)

TORSO_PX = 400.0


def signals(spark: SparkSession, sf_dir: str, staged: bool = False) -> DataFrame:
    """Frame signals: the object follows a wrist for six frames, then rises away from it for six;
    the table's own values are the noise on top.

    ``staged`` writes them once, as the table they would be for the folds that read them often.
    """
    from kinetable.operators.windows import min_distance, velocity

    step = F.pmod("frame_index", F.lit(12))
    height = F.lit(60.0) - F.when(step >= 6, F.lit(7.0) * (step - 5)).otherwise(F.lit(0.0)) + F.col("y") / 40
    f = frames(spark, sf_dir).withColumns({"x": F.col("x") / 4, "y": height})
    n = F.pmod("event_id", F.lit(7)).cast("double")
    held = F.pmod(F.floor(F.col("frame_index") / 6), F.lit(2)) == 0
    off = F.when(held, n).otherwise(F.lit(150.0))
    left = F.struct((F.col("x") + off).alias("x"), (F.col("y") + off).alias("y"))
    right = F.when(
        F.pmod("event_id", F.lit(3)) != 0, F.struct((F.col("x") + 90).alias("x"), (F.col("y") + 60).alias("y"))
    )
    available = F.col("source") != "unavailable"
    rows = f.withColumns({"left_wrist": left, "right_wrist": right})
    rows = velocity(rows, FRAME_SERIES, "y", "timestamp_sec", available, F.lit(TORSO_PX), "ball_vertical_velocity_norm")
    out = rows.select(
        "sid", "frame_index", "timestamp_sec",
        available.alias("ball_available"),
        F.when(available, F.col("x")).alias("ball_x"),
        F.when(available, F.col("y")).alias("ball_y"),
        F.when(available, min_distance(F.col("x"), F.col("y"), [F.col("left_wrist"), F.col("right_wrist")], F.lit(TORSO_PX))).alias("ball_hand_dist_norm"),
        "ball_vertical_velocity_norm",
        F.when(F.pmod("event_id", F.lit(11)) != 0, F.lit(180.0) - F.pmod(F.col("event_id") * 13, F.lit(60))).alias("knee_angle_deg"),
        F.lit(58.0).alias("shoulder_y"),
        F.when(F.pmod("event_id", F.lit(9)) != 0, F.pmod("event_id", F.lit(5)) * F.lit(0.9)).alias("hip_x_norm"),
        F.col("source").isin("detected", "interpolated").alias("ball_is_observed"),
        "left_wrist", "right_wrist",
        F.col("source").alias("ball_source"),
        "x", "y", "source", "confidence", "radius",
    )
    return stage(out) if staged else out


SIGNALS_SQL = f"""sframes AS (SELECT * REPLACE (x / 4 AS x, 60.0::DOUBLE - CASE WHEN frame_index % 12 >= 6 THEN 7.0::DOUBLE * (frame_index % 12 - 5) ELSE 0.0 END + y / 40 AS y) FROM frames),
sig0 AS (SELECT *, source <> 'unavailable' AS ok, lag(y) OVER w AS py, lag(timestamp_sec) OVER w AS pt, lag(source <> 'unavailable') OVER w AS pok,
  CASE WHEN (frame_index // 6) % 2 = 0 THEN (event_id % 7)::DOUBLE ELSE 150.0 END AS off FROM sframes WINDOW w AS (PARTITION BY sid ORDER BY frame_index)),
signals AS (SELECT sid, frame_index, timestamp_sec, ok AS ball_available, CASE WHEN ok THEN x END AS ball_x, CASE WHEN ok THEN y END AS ball_y,
  x + off AS lx, y + off AS ly, CASE WHEN event_id % 3 <> 0 THEN x + 90 END AS rx, CASE WHEN event_id % 3 <> 0 THEN y + 60 END AS ry,
  CASE WHEN ok THEN least(sqrt(pow(off, 2) + pow(off, 2)), CASE WHEN event_id % 3 <> 0 THEN sqrt(pow(90.0, 2) + pow(60.0, 2)) END) / {TORSO_PX} END AS dist,
  CASE WHEN ok AND pok AND timestamp_sec - pt > 1e-6 THEN (y - py) / (timestamp_sec - pt) / {TORSO_PX} END AS v,
  CASE WHEN event_id % 11 <> 0 THEN 180.0 - (event_id * 13) % 60 END::DOUBLE AS knee, 58.0::DOUBLE AS shoulder_y,
  CASE WHEN event_id % 9 <> 0 THEN (event_id % 5) * 0.9 END::DOUBLE AS hip, source IN ('detected', 'interpolated') AS observed, source, x, y, confidence, radius FROM sig0)"""

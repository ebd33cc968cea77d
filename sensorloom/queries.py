"""The operators as queries over the star tables, each with SQL that gives the same rows where SQL can.

``events`` stand for readings: a series is an event type or a user, its classes of equipment are dealt to the event types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .config import PROFILES, VALID_RANGES, DetectorConfig
from .functions import numbers as M
from .functions import text as X
from .functions import times as T
from .operators import clean as C
from .operators import clusters as K
from .operators import isoforest as I
from .operators import merge as G
from .operators import runs as R
from .operators import star as J
from .operators import summary as S
from .operators import suppress as P
from .operators import windows as N
from .plans import detect as D
from .sources import files as L
from .sources.scratch import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TYPE, USER, ORDER = ["event_type"], ["user_id"], ["ts", "event_id"]
BLOCKS = [*TYPE, "_block"]
#: The class of equipment that each event type stands for.
CLASSES = {"click": "Pressure", "view": "Flowrate", "purchase": "Conductivity", "signup": "Voltage", "error": "Temperature"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in CLASSES.items()], F.lit("Others"))
    return events(spark, sf_dir).select(kind.alias("Equipment"), F.concat(F.lit("Station-"), F.col("event_type")).alias("Description"), F.col("ts").alias("DateTime"), F.col("value").alias("CurrValue"), F.col("event_id").alias("Id"))


KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLASSES.items()) + " ELSE 'Others' END"
RANGE_SQL = "CASE " + " ".join(f"WHEN {{kind}} = '{k}' THEN {{v}} < {a} OR {{v}} > {b}" for k, (a, b) in VALID_RANGES.items()) + " ELSE false END"


def series_sql(key: str) -> str:
    return f"SELECT event_id, ts, user_id, event_type, value, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) - 1 AS rn, count(*) OVER (PARTITION BY {key}) AS n FROM events"


def robust_z_sql(key: str, low: str, high: str, source: str = "s") -> str:
    """CTEs m, d, z over the CTE ``source`` with rn, n, value; the frame reaches from low rows before to high rows after."""
    frame = f"OVER (PARTITION BY {key} ORDER BY rn ROWS BETWEEN {low} PRECEDING AND {high} FOLLOWING)"
    return f"""m AS (SELECT *, median(value) {frame} AS rz_median FROM {source}),
        d AS (SELECT *, median(abs(value - rz_median)) {frame} AS rz_mad FROM m),
        z AS (SELECT *, CASE WHEN rz_mad > 0 THEN 1.4826 * (value - rz_median) / rz_mad ELSE 0.0 END AS rz FROM d)"""


ZW, DW = "least(24, greatest(5, n // 10))", "least(24, greatest(6, n // 12))"


# --- windows ---------------------------------------------------------------------------------------------------


@query(f"WITH s AS ({series_sql('event_type')}), {robust_z_sql('event_type', '12', '11')} SELECT event_id, rz_median, rz_mad, rz FROM z")
def robust_z_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.own_rows(N.robust_z(N.in_blocks(N.indexed(events(spark, sf_dir), TYPE, ORDER)), BLOCKS, ORDER, "value", window=24))
    return rows.select("event_id", F.col("RZ_median").alias("rz_median"), F.col("RZ_mad").alias("rz_mad"), F.col("RZ").alias("rz"))


@query(f"WITH s AS ({series_sql('user_id')}), {robust_z_sql('user_id', f'({ZW}) // 2', f'({ZW}) - 1 - ({ZW}) // 2')} SELECT event_id, rz_median, rz_mad, rz FROM z")
def robust_z_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(N.indexed(events(spark, sf_dir), USER, ORDER), "numbered")
    rows = N.robust_z(rows, USER, ORDER, "value", window=N.z_window(F.col("n")))
    return rows.select("event_id", F.col("RZ_median").alias("rz_median"), F.col("RZ_mad").alias("rz_mad"), F.col("RZ").alias("rz"))


@query(
    f"""WITH s AS ({series_sql("event_type")}),
    a AS (SELECT *, coalesce(value - lag(value) OVER w, 0.0) AS f_diff, avg(value) OVER b AS f_mean, coalesce(stddev_samp(value) OVER b, 0.0) AS f_std FROM s
          WINDOW w AS (PARTITION BY event_type ORDER BY rn), b AS (PARTITION BY event_type ORDER BY rn ROWS 11 PRECEDING))
    SELECT event_id, f_diff, round(f_mean, 6) AS f_mean, round(f_std, 6) AS f_std, round(coalesce(f_mean - lag(f_mean) OVER (PARTITION BY event_type ORDER BY rn), 0.0), 6) + 0.0 AS f_slope FROM a"""
)
def rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.own_rows(N.rolling_features(N.in_blocks(N.indexed(events(spark, sf_dir), TYPE, ORDER)), BLOCKS, ORDER, "value"))
    return rows.select("event_id", "f_diff", F.round("f_mean", 6).alias("f_mean"), F.round("f_std", 6).alias("f_std"), (F.round("f_slope", 6) + F.lit(0.0)).alias("f_slope"))


@query(
    f"""WITH s AS ({series_sql("event_type")})
    SELECT event_id, CASE WHEN n >= 48 THEN abs(value - lag(value) OVER w) + abs(lag(value, 23) OVER w - lag(value, 24) OVER w) END AS dtw_dist FROM s WINDOW w AS (PARTITION BY event_type ORDER BY rn)"""
)
def dtw_shift_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.own_rows(N.shift_distance(N.in_blocks(N.indexed(events(spark, sf_dir), TYPE, ORDER)), BLOCKS, ORDER, "value", window=24))
    return rows.select("event_id", F.col("DTW_Dist").alias("dtw_dist"))


@query(
    f"""WITH s AS ({series_sql("user_id")}), k AS (SELECT *, {DW} AS w, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY rn)) AS step FROM s)
    SELECT a.event_id, CASE WHEN a.n >= 2 * a.w THEN a.step + b.step END AS dtw_dist FROM k a LEFT JOIN k b ON a.user_id = b.user_id AND b.rn = a.rn - a.w + 1"""
)
def dtw_dynamic_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(N.indexed(events(spark, sf_dir), USER, ORDER), "numbered")
    rows = N.shift_distance(rows, USER, ORDER, "value", window=N.dtw_window(F.col("n")))
    return rows.select("event_id", F.col("DTW_Dist").alias("dtw_dist"))


def scored_sql(key: str, source: str) -> str:
    """CTEs up to ``c`` with the scores, thresholds and flags, over the CTE ``source`` with value, rn, n and key columns."""
    z = robust_z_sql(key, f"({ZW}) // 2", f"({ZW}) - 1 - ({ZW}) // 2", source)
    return f"""{z},
        k AS (SELECT *, {DW} AS w, abs(value - lag(value) OVER (PARTITION BY {key} ORDER BY rn)) AS step FROM z),
        t AS (SELECT a.*, CASE WHEN a.n >= 2 * a.w THEN a.step + b.step END AS dtw FROM k a LEFT JOIN k b ON a.{key} = b.{key} AND b.rn = a.rn - a.w + 1),
        q AS (SELECT {key}, quantile_cont(abs(rz), 0.997) AS qz, quantile_cont(dtw, 0.997) AS qd, median(dtw) AS md FROM t GROUP BY {key}),
        x AS (SELECT t.{key}, median(abs(dtw - md)) AS mad FROM t JOIN q USING ({key}) GROUP BY t.{key}),
        h AS (SELECT q.{key}, greatest(2.5, qz, 4.5) AS z_thr, greatest(qd, md + 6.0 * mad) AS d_thr FROM q JOIN x USING ({key})),
        c AS (SELECT t.*, z_thr, d_thr, abs(rz) > z_thr AS z_flag, coalesce(dtw > d_thr, false) AS d_flag FROM t JOIN h USING ({key}))"""


@query(f"WITH s AS ({series_sql('event_type')}), {scored_sql('event_type', 's')} SELECT DISTINCT event_type, round(z_thr, 9) AS z_thr, round(d_thr, 9) AS d_thr FROM c")
def quantile_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.thresholds(rolled(spark, sf_dir, TYPE), TYPE)
    return rows.select("event_type", F.round("z_thr", 9).alias("z_thr"), F.round("d_thr", 9).alias("d_thr"))


def rolled(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    rows = written(N.indexed(events(spark, sf_dir), keys, ORDER), "numbered")
    return written(N.own_rows(N.scored_windows(N.in_blocks(rows), [*keys, "_block"], ORDER, "value")), "rolled")


def calibrated(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    return N.calibrated(rolled(spark, sf_dir, keys), keys)


@query(
    f"""WITH s AS ({series_sql("event_type")}), {robust_z_sql("event_type", "least(n, 24) // 2", "least(n, 24) - 1 - least(n, 24) // 2")},
    q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM s GROUP BY event_type)
    SELECT event_type, round(any_value(q1), 9) AS q1, round(any_value(q3), 9) AS q3,
           round(least(greatest(avg(CASE WHEN q3 = q1 THEN (abs(rz) > 3.5)::INT ELSE (value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1))::INT END) * 0.7, 0.005, 0.001), 0.05), 9) AS cont
    FROM z JOIN q USING (event_type) GROUP BY event_type"""
)
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.contamination(events(spark, sf_dir), TYPE, ORDER, "value").select("event_type", F.round("q1", 9).alias("q1"), F.round("q3", 9).alias("q3"), F.round("cont", 9).alias("cont"))


@query(
    f"""WITH s AS ({series_sql("event_type")}), {robust_z_sql("event_type", "12", "11")},
    f AS (SELECT *, value > 150 AS flag, avg((value > 150)::INT) OVER (PARTITION BY event_type) AS share, row_number() OVER (PARTITION BY event_type ORDER BY abs(rz) DESC, rn) AS r FROM z)
    SELECT event_id, flag AND (share <= 0.01 OR r <= ceil(0.01 * n)) AS flag FROM f"""
)
def iso_budget_topfraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large value stands for the model's flag, so that SQL can say the same."""
    rows = N.own_rows(N.robust_z(N.in_blocks(N.indexed(events(spark, sf_dir), TYPE, ORDER)), BLOCKS, ORDER, "value", window=24)).withColumn("flag", F.col("value") > 150)
    return N.within_budget(written(rows, "scores"), TYPE, "flag").select("event_id", "flag")


# --- runs ------------------------------------------------------------------------------------------------------

#: Flagged rows are those above a value, which gives runs of up to some ten rows.
FLAG = 30.0


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.indexed(events(spark, sf_dir), TYPE, ORDER).withColumn("flag", F.col("value") > FLAG)


def runs_sql(key: str, source: str, flag: str, out: str) -> str:
    return f"{out} AS (SELECT {key}, min(rn) AS s, max(rn) AS e FROM (SELECT *, rn - row_number() OVER (PARTITION BY {key} ORDER BY rn) AS g FROM {source} WHERE {flag}) GROUP BY {key}, g)"


def merged_sql(key: str, source: str, gap: int, out: str) -> str:
    return f"""{out} AS (SELECT {key}, min(s) AS s, max(e) AS e FROM (SELECT *, sum(a) OVER (PARTITION BY {key} ORDER BY s) AS g FROM
        (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY {key} ORDER BY s) - 1 <= {gap} THEN 0 ELSE 1 END AS a FROM {source})) GROUP BY {key}, g)"""


def cooled_sql(key: str, source: str, rows: int, out: str) -> str:
    """A recursion over the runs in order, with the last row that must stay clear."""
    return f"""{out}_r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY s) AS i FROM {source}),
        {out}_c AS (SELECT {key}, i, s, e, true AS kept, e + {rows} AS cut FROM {out}_r WHERE i = 1
            UNION ALL SELECT n.{key}, n.i, greatest(n.s, c.cut + 1), n.e, greatest(n.s, c.cut + 1) <= n.e, CASE WHEN greatest(n.s, c.cut + 1) <= n.e THEN n.e + {rows} ELSE c.cut END
            FROM {out}_c c JOIN {out}_r n ON n.{key} = c.{key} AND n.i = c.i + 1),
        {out} AS (SELECT {key}, s, e FROM {out}_c WHERE kept)"""


BASE = f"WITH RECURSIVE s AS ({series_sql('event_type')}), {runs_sql('event_type', 's', f'value > {FLAG}', 'r1')}"
SHOW = "SELECT event_type, s::INT AS s, e::INT AS e FROM"


@query(f"{BASE} {SHOW} r1")
def runs_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.runs_of(flagged(spark, sf_dir), TYPE, "flag")


@query(f"{BASE} {SHOW} r1 WHERE e - s + 1 >= 6")
def run_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.at_least_long(R.runs_of(flagged(spark, sf_dir), TYPE, "flag"), 6)


@query(f"{BASE}, r2 AS (SELECT * FROM r1 WHERE e - s + 1 >= 6), {merged_sql('event_type', 'r2', 3, 'r3')} {SHOW} r3")
def gap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merged(R.at_least_long(R.runs_of(flagged(spark, sf_dir), TYPE, "flag"), 6), TYPE, 3)


@query(f"{BASE}, r2 AS (SELECT * FROM r1 WHERE e - s + 1 >= 6), {merged_sql('event_type', 'r2', 3, 'r3')}, {cooled_sql('event_type', 'r3', 12, 'r4')} {SHOW} r4")
def cooldown_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.smoothed(flagged(spark, sf_dir), TYPE, "flag")


@query(f"WITH s AS ({series_sql('event_type')}), {scored_sql('event_type', 's')} SELECT event_id, z_flag, d_flag, (z_flag AND d_flag) OR abs(rz) > 8.0 AS base FROM c")
def vote_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calibrated(spark, sf_dir, TYPE)
    votes = F.col("Z_Flag").cast("int") + F.col("DTW_Flag").cast("int")
    return rows.select("event_id", F.col("Z_Flag").alias("z_flag"), F.col("DTW_Flag").alias("d_flag"), ((votes >= 2) | (F.abs("RZ") > 8.0)).alias("base"))


STEP = """{out} AS (SELECT r.*, b.m AS before, a.m AS after, coalesce(b.k >= 5 AND a.k >= 5 AND abs(b.m - a.m) / greatest(abs(b.m), abs(a.m), 1e-6) >= 0.10, false) AS is_step FROM {runs} r
    LEFT JOIN (SELECT r.{key}, r.s, median(p.value) AS m, count(*) AS k FROM {runs} r JOIN {points} p ON p.{key} = r.{key} AND p.rn BETWEEN r.s - 20 AND r.s - 1 GROUP BY ALL) b ON b.{key} = r.{key} AND b.s = r.s
    LEFT JOIN (SELECT r.{key}, r.s, median(p.value) AS m, count(*) AS k FROM {runs} r JOIN {points} p ON p.{key} = r.{key} AND p.rn BETWEEN r.e + 1 AND r.e + 20 GROUP BY ALL) a ON a.{key} = r.{key} AND a.s = r.s)"""
IMPACT = """{out} AS (SELECT r.{key}, r.s, r.e, count(*) AS length, max(abs(p.rz)) AS peak, avg(p.d_flag::INT) AS dtw_rate,
    abs(arg_max(p.value, p.rn) - arg_min(p.value, p.rn)) / any_value(CASE WHEN m.m > 1e-9 THEN m.m ELSE 1.0 END) AS jump
    FROM {runs} r JOIN {points} p ON p.{key} = r.{key} AND p.rn BETWEEN r.s AND r.e JOIN (SELECT {key}, median(abs(value)) AS m FROM {points} GROUP BY {key}) m ON m.{key} = r.{key} GROUP BY r.{key}, r.s, r.e)"""


@query(f"{BASE}, r2 AS (SELECT * FROM r1 WHERE e - s + 1 >= 6), {STEP.format(out='x', runs='r2', points='s', key='event_type')} SELECT event_type, s::INT AS s, e::INT AS e, before, after, is_step FROM x")
def step_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = flagged(spark, sf_dir)
    rows = R.with_steps(points, R.at_least_long(R.runs_of(points, TYPE, "flag"), 6), TYPE, "value")
    # A side without any row has no median; one with too few rows has, but does not count.
    return rows.select("event_type", "s", "e", "before", "after", "is_step")


@query(
    f"""WITH s AS ({series_sql("event_type")}), {scored_sql("event_type", "s")}, {runs_sql("event_type", "c", f"value > {FLAG}", "r1")}, {IMPACT.format(out="im", runs="r1", points="c", key="event_type")}
    SELECT event_type, s::INT AS s, e::INT AS e, length, peak, round(jump, 9) AS jump, round(dtw_rate, 9) AS dtw_rate FROM im WHERE length >= 6 AND (peak >= 5.5 OR jump >= 0.10 OR dtw_rate >= 0.20)"""
)
def impact_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = calibrated(spark, sf_dir, TYPE)
    rows = R.with_impact(points, R.runs_of(points, TYPE, F.col("value") > FLAG), TYPE, "value")
    kept = rows.filter((F.col("length") >= 6) & ((F.col("peak") >= 5.5) | (F.col("jump") >= 0.10) | (F.col("dtw_rate") >= 0.20)))
    return kept.select("event_type", "s", "e", "length", "peak", F.round("jump", 9).alias("jump"), F.round("dtw_rate", 9).alias("dtw_rate"))


# --- detector --------------------------------------------------------------------------------------------------

#: The tables hold no runs of six rows that vote, so single rows count; the model is left out where SQL is to say the same.
SHORT = DetectorConfig(iso_enabled=False, min_event_len=1, cooldown=2, suppress_steps=True)
ZS, DT = [k for k, p in PROFILES.items() if p.z], [k for k, p in PROFILES.items() if not p.dtw]
DETECT_SQL = f"""WITH RECURSIVE g AS (SELECT {KIND_SQL} AS equipment, 'Station-' || event_type AS description, ts, value, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    s AS (SELECT *, {RANGE_SQL.format(kind="equipment", v="value")} AS invalid FROM g WHERE n >= 48), {scored_sql("description", "s").replace("END AS dtw FROM", "END AS dtw0 FROM").replace("LEFT JOIN k b ON a.description = b.description AND b.rn = a.rn - a.w + 1),", "LEFT JOIN k b ON a.description = b.description AND b.rn = a.rn - a.w + 1), ", 1)}"""
DETECT_SQL = DETECT_SQL.replace("CASE WHEN a.n >= 2 * a.w THEN a.step + b.step END AS dtw0", f"CASE WHEN a.n >= 2 * a.w AND a.equipment NOT IN ({', '.join(repr(x) for x in DT)}) THEN a.step + b.step END AS dtw")
DETECT_SQL += f""", v AS (SELECT *, (z_flag AND d_flag) OR abs(rz) > 8.0 AS base FROM c),
    {runs_sql("description", "v", "base", "r1")}, {merged_sql("description", "r1", 3, "r3")}, {cooled_sql("description", "r3", 2, "r4")},
    y AS (SELECT v.*, r4.s IS NOT NULL AND NOT invalid AS ok FROM v LEFT JOIN r4 ON r4.description = v.description AND v.rn BETWEEN r4.s AND r4.e),
    {runs_sql("description", "y", "ok", "r5")}, {IMPACT.format(out="i", runs="r5", points="c", key="description")}, {STEP.format(out="st", runs="r5", points="c", key="description")},
    r6 AS (SELECT i.* FROM i JOIN st ON st.description = i.description AND st.s = i.s WHERE NOT st.is_step AND length >= 1 AND (peak >= 5.5 OR jump >= 0.10 OR dtw_rate >= 0.20)),
    p AS (SELECT v.*, r6.s IS NOT NULL AS anomaly, r6.s AS run FROM v LEFT JOIN r6 ON r6.description = v.description AND v.rn BETWEEN r6.s AND r6.e),
    ev AS (SELECT equipment, description, min(ts) AS start_time, max(ts) AS end_time, count(*) AS duration_pts, arg_min(value, rn) AS first_value, arg_max(value, rn) AS last_value, max(abs(rz)) AS max_rz,
           count_if(z_flag) AS z_points, count_if(d_flag) AS dtw_points, bool_or(invalid) AS rule_invalid FROM p WHERE anomaly GROUP BY equipment, description, run),
    su AS (SELECT p.equipment, p.description, count(*) AS total_points, count_if(anomaly) AS anomaly_points, round(100.0 * count_if(anomaly) / count(*), 2) AS anomaly_pct, any_value(k.k) AS num_events,
           min(ts) FILTER (anomaly) AS first_time, max(ts) FILTER (anomaly) AS last_time, count_if(anomaly AND z_flag) AS z_points, count_if(anomaly AND d_flag) AS dtw_points, max(abs(rz)) FILTER (anomaly) AS peak_rz,
           max(dtw) FILTER (anomaly) AS max_dtw, round(avg(value), 6) AS mean_value, median(value) AS median_value
           FROM p JOIN (SELECT description, count(*) AS k FROM r6 GROUP BY description) k ON k.description = p.description GROUP BY p.equipment, p.description)"""


def detected(spark: SparkSession, sf_dir: str, cfg: DetectorConfig = SHORT) -> DataFrame:
    return D.detect(readings(spark, sf_dir), cfg)


def summarised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sensor_summary(written(detected(spark, sf_dir), "detected"))


@query(DETECT_SQL + " SELECT event_id, rz, dtw AS dtw_dist, z_flag, d_flag, invalid, anomaly FROM p")
def detector_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(spark, sf_dir).select(
        F.col("Id").alias("event_id"), F.col("RZ").alias("rz"), F.col("DTW_Dist").alias("dtw_dist"), F.col("Z_Flag").alias("z_flag"), F.col("DTW_Flag").alias("d_flag"), F.col("Rule_Based_Invalid").alias("invalid"), F.col("Combined_Anomaly").alias("anomaly")
    )


@query(DETECT_SQL + " SELECT * FROM ev")
def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.event_table(detected(spark, sf_dir)).drop("ISO_Points")
    return rows.toDF("equipment", "description", "start_time", "end_time", "duration_pts", "first_value", "last_value", "max_rz", "z_points", "dtw_points", "rule_invalid")


def _summary(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("Equipment").alias("equipment"), F.col("Description").alias("description"), F.col("Total_Points").alias("total_points"), F.col("Anomaly_Points").alias("anomaly_points"), F.col("Anomaly_Pct").alias("anomaly_pct"),
        F.col("Num_Events").alias("num_events"), F.col("First_Anomaly_Time").alias("first_time"), F.col("Last_Anomaly_Time").alias("last_time"), F.col("Z_Points").alias("z_points"), F.col("DTW_Points").alias("dtw_points"),
        F.col("Peak_RZ").alias("peak_rz"), F.col("Max_DTW_Dist").alias("max_dtw"), F.round("Mean_Value", 6).alias("mean_value"), F.col("Median_Value").alias("median_value"),
    )


@query(DETECT_SQL + " SELECT * FROM su")
def sensor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(summarised(spark, sf_dir))


@query(DETECT_SQL + " SELECT * FROM su WHERE (z_points > 0)::INT + (dtw_points > 0)::INT >= 2 AND num_events > 0 ORDER BY (z_points > 0)::INT + (dtw_points > 0)::INT DESC, anomaly_pct DESC, peak_rz DESC, equipment, description LIMIT 10")
def top_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(S.top_sensors(summarised(spark, sf_dir)))


@query(DETECT_SQL + " SELECT count(*) AS abnormal_sensors, coalesce(sum(num_events), 0)::BIGINT AS events FROM su")
def anomaly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.totals(summarised(spark, sf_dir))


@query()
def full_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the forest; the ranked sensors and their suppression."""
    cfg = DetectorConfig(min_event_len=1, cooldown=0, suppress_steps=False)
    return D.report(readings(spark, sf_dir), cfg, output_dir="plots").top


@query()
def isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.indexed(events(spark, sf_dir), TYPE, ORDER)
    return I.isolation_flags(rows, TYPE, ORDER, "value")


@query()
def kmeans_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(detected(spark, sf_dir).filter("Combined_Anomaly"), "anomalies")
    return K.clustered(rows, ["RZ", "DTW_Dist", "CurrValue"]).select("Id", "RZ", "DTW_Dist", "CurrValue", "Cluster")


@query()
def kmeans_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.clustered(written(summarised(spark, sf_dir), "summary"), K.SENSOR_FEATURES).select("Equipment", "Description", "Cluster")


@query()
def pca_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on normal points, shown for all; the model of the cluster view."""
    rows = written(detected(spark, sf_dir), "detected")
    normal = rows.filter(~F.col("Combined_Anomaly"))
    shown = K.projected(rows, ["RZ", "DTW_Dist", "CurrValue"], fit_on=normal)
    return K.clustered(shown, ["RZ", "DTW_Dist", "CurrValue"], fit_on=normal).select("Id", "PC1", "PC2", "Cluster", "Combined_Anomaly")


@query(DETECT_SQL + " SELECT event_id, value, z_flag, d_flag, anomaly FROM p WHERE description IN (SELECT description FROM su)")
def series_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = written(detected(spark, sf_dir), "detected")
    rows = points.join(S.sensor_summary(points).select(*S.KEYS), S.KEYS, "left_semi")
    return rows.select(F.col("Id").alias("event_id"), F.col("CurrValue").alias("value"), F.col("Z_Flag").alias("z_flag"), F.col("DTW_Flag").alias("d_flag"), F.col("Combined_Anomaly").alias("anomaly"))


# --- sources and filters ---------------------------------------------------------------------------------------


def hourly_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hour of events with an even number of rows stands for a file."""
    hours = events(spark, sf_dir).groupBy(T.hour_floor(F.col("ts")).alias("hour")).agg(F.count("*").alias("k")).filter("k % 2 = 0")
    return hours.select(F.concat(F.lit("x/hts_2024_01_HISTORY_"), F.date_format("hour", "yyyyMMMdd-HHmmss"), F.lit(".csv")).alias("path"))


HOURS_SQL = "f AS (SELECT hour FROM (SELECT date_trunc('hour', ts) AS hour, count(*) AS k FROM events GROUP BY 1) WHERE k % 2 = 0), h AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-20 11:00:00' - INTERVAL 71 HOURS, TIMESTAMP '2024-01-20 11:00:00', INTERVAL 1 HOUR)) AS hour)"


def _now():
    from datetime import datetime

    return datetime(2024, 1, 20, 12, 10)


@query(
    f"""WITH {HOURS_SQL} SELECT count(*) AS expected, count(f.hour) AS found, count(*) FILTER (f.hour IS NULL) AS missing, min(h.hour) AS "start", max(h.hour) AS "end",
    100.0 * count(*) FILTER (f.hour IS NULL) / count(*) AS missing_percent FROM h LEFT JOIN f USING (hour)"""
)
def hourly_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = L.matching(hourly_files(spark, sf_dir), r"hts_\d{4}_\d{2}_HISTORY_")
    return L.coverage(files, L.expected_hours(spark, _now()))


@query(f"WITH {HOURS_SQL} SELECT 'hts_2024_01_HISTORY_' || strftime(hour, '%Y%b%d-%H%M%S') || '.csv' AS name, hour FROM f WHERE hour IN (SELECT hour FROM h)")
def wallclock_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = L.matching(hourly_files(spark, sf_dir), r"hts_\d{4}_\d{2}_HISTORY_")
    return L.in_window(files, L.expected_hours(spark, _now())).select("name", "hour")


@query(f"WITH {HOURS_SQL} SELECT hour FROM h WHERE hour NOT IN (SELECT hour FROM f)")
def missing_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = L.matching(hourly_files(spark, sf_dir), r"hts_\d{4}_\d{2}_HISTORY_")
    return L.missing_hours(files, L.expected_hours(spark, _now()))


@query(f"WITH {HOURS_SQL} SELECT hour FROM f WHERE hour >= (SELECT max(hour) FROM f) - INTERVAL 71 HOURS")
def latest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.latest_window(L.matching(hourly_files(spark, sf_dir), "hts_")).select("hour")


@query("SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAYS")
def recency_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.since_newest(events(spark, sf_dir), "ts", hours=168).select("event_id", "ts")


@query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 72 HOURS")
def recency_72h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.since_newest(events(spark, sf_dir), "ts", hours=72, inclusive=True).select("event_id", "ts")


@query("SELECT event_id, event_type FROM events WHERE event_type IS NULL OR event_type NOT IN ('error', 'signup')")
def category_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.without_kinds(events(spark, sf_dir), "event_type", ("error", "signup")).select("event_id", "event_type")


@query("SELECT event_type, count(*) AS rows, count(DISTINCT user_id) AS sensors FROM events WHERE event_type IN ('error', 'signup') GROUP BY event_type")
def category_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dropped_by_kind(events(spark, sf_dir), "event_type", ("error", "signup"), ("user_id",))


@query("SELECT event_id, user_id FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n >= 60")
def min_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.at_least(events(spark, sf_dir), USER, 60).select("event_id", "user_id")


HOLES = "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END"


@query(f"SELECT l_orderkey, l_linenumber, q FROM (SELECT l_orderkey, l_linenumber, {HOLES} AS q, l_extendedprice FROM lineitem) WHERE q IS NOT NULL AND l_extendedprice > -60000 AND l_extendedprice < 60000")
def null_and_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(HOLES).alias("q"), "l_extendedprice")
    return rows.na.drop("any").filter((F.col("l_extendedprice") < 60000) & (F.col("l_extendedprice") > -60000)).select("l_orderkey", "l_linenumber", "q")


@query(f"SELECT count(*) FILTER (q IS NULL) AS null_q, count(*) FILTER (l_shipdate IS NULL) AS null_l_shipdate FROM (SELECT {HOLES} AS q, l_shipdate FROM lineitem)")
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.null_counts(table(spark, sf_dir, "lineitem").select(F.expr(HOLES).alias("q"), "l_shipdate"), "q", "l_shipdate")


# --- derived columns -------------------------------------------------------------------------------------------


@query(
    """SELECT p_partkey, signal, CASE WHEN signal = 'Analog' THEN CASE WHEN contains(d, 'dissolved') THEN 'Dissolved Oxygen' WHEN contains(d, 'cond') THEN 'Conductivity' WHEN contains(d, 'temp') THEN 'Temperature'
        WHEN contains(d, 'press') THEN 'Pressure' WHEN contains(d, 'volt') THEN 'Voltage' WHEN contains(d, 'flow') THEN 'Flowrate' ELSE 'Others' END
        ELSE CASE WHEN contains(d, 'pump') THEN 'Pump' WHEN contains(d, 'valve') THEN 'Valve' WHEN contains(d, 'level') THEN 'LevelSensor' ELSE 'Digital Signal' END END AS equipment
    FROM (SELECT p_partkey, CASE WHEN p_size % 6 IN (1, 5) THEN 'Analog' ELSE 'Digital' END AS signal,
        lower(p_name || ' ' || ['Dissolved', 'Conductivity', 'TEMP', 'Pressure', 'voltage flow', 'Flow', 'pump valve', 'Valve', 'Level', 'none'][(p_partkey % 10 + 1)::INT]) AS d FROM part)"""
)
def classify_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*[F.lit(x) for x in ("Dissolved", "Conductivity", "TEMP", "Pressure", "voltage flow", "Flow", "pump valve", "Valve", "Level", "none")])
    rows = table(spark, sf_dir, "part").withColumn("d", F.concat_ws(" ", "p_name", F.get(words, (F.col("p_partkey") % 10).cast("int")))).withColumn("signal", X.signal_type(F.col("p_size") % 6))
    return rows.select("p_partkey", "signal", X.equipment(F.col("d"), F.col("signal")).alias("equipment"))


@query(
    """SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'old.*t') THEN 4221 WHEN regexp_matches(p_name, '(?i)GEAR') THEN 1007 WHEN contains(p_name, 'red') THEN 1002 WHEN contains(p_name, 'widget') THEN 1001 ELSE p_size END::BIGINT AS station FROM part"""
)
def ordered_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [(F.contains("p_name", F.lit("widget")), 1001), (F.contains("p_name", F.lit("red")), 1002), (F.rlike("p_name", F.lit("(?i)GEAR")), 1007), (F.rlike("p_name", F.lit("old.*t")), 4221)]
    return table(spark, sf_dir, "part").select("p_partkey", X.last_match(F.col("p_size"), rules).cast("long").alias("station"))


@query(f"SELECT event_id, {RANGE_SQL.format(kind=f'({KIND_SQL})', v='value')} AS invalid FROM events")
def range_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).select(F.col("Id").alias("event_id"), M.out_of_range(F.col("Equipment"), F.col("CurrValue")).alias("invalid"))


@query(
    f"""SELECT DISTINCT equipment, true AS z, equipment NOT IN ('Conductivity', 'Temperature', 'LevelSensor') AS iso, equipment NOT IN ('Voltage', 'Dissolved Oxygen', 'Temperature', 'LevelSensor') AS dtw, true AS steps
    FROM (SELECT {KIND_SQL} AS equipment FROM events)"""
)
def profile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("Equipment")
    return readings(spark, sf_dir).select(kind.alias("equipment"), M.profile(kind, "z").alias("z"), M.profile(kind, "iso").alias("iso"), M.profile(kind, "dtw").alias("dtw"), M.profile(kind, "suppress_steps").alias("steps")).distinct()


@query("SELECT o_orderkey, o_custkey::VARCHAR || o_orderkey::VARCHAR AS hkey, o_custkey::VARCHAR || o_orderkey::VARCHAR || strftime(o_orderdate, '%Y%m%d%H%M%S') AS hkey_time, strftime(o_orderdate, '%Y%m%d_%H%M') AS run_id FROM orders")
def composite_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("hkey", C.hkey("o_custkey", "o_orderkey"))
    return rows.select("o_orderkey", "hkey", F.concat("hkey", T.compact(F.col("o_orderdate"))).alias("hkey_time"), T.run_id(F.col("o_orderdate")).alias("run_id"))


@query(r"SELECT c_custkey, regexp_replace(c_name, '\D', '', 'g') AS digits, regexp_replace(trim('  ' || c_name || '   x  '), '\s+', ' ', 'g') AS tidy FROM customer")
def digits_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", X.digits_only(F.col("c_name")).alias("digits"), X.collapsed(F.concat(F.lit("  "), F.col("c_name"), F.lit("   x  "))).alias("tidy"))


@query(
    """SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS head, CASE WHEN contains(o_orderpriority, ' ') THEN regexp_extract(o_orderpriority, '^(.*) ([^ ]*)$', 1) END AS name,
    CASE WHEN contains(o_orderpriority, ' ') THEN regexp_extract(o_orderpriority, '^(.*) ([^ ]*)$', 2) END AS status FROM orders"""
)
def split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.before_first(p).alias("head"), X.before_last_space(p).alias("name"), X.after_last_space(p).alias("status"))


@query(r"""SELECT p_partkey, left(regexp_replace(p_type || '/' || p_name || '_' || p_brand || '?', '[<>:"/\\|?*]', '_', 'g'), 20) || '.png' AS file FROM part""")
def safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.safe_name(F.concat("p_type", F.lit("/"), "p_name"), F.concat("p_brand", F.lit("?")), length=20).alias("file"))


@query(
    """SELECT o_orderkey, try_cast(CASE WHEN o_orderkey % 7 = 0 THEN 'bad' ELSE o_totalprice::VARCHAR END AS DOUBLE) AS price,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE date_trunc('second', o_orderdate) END AS day FROM orders"""
)
def coercing_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and times as text, some of them unreadable, in two formats."""
    day = F.when(F.col("o_orderkey") % 5 == 0, F.lit("never")).when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    price = F.when(F.col("o_orderkey") % 7 == 0, F.lit("bad")).otherwise(F.col("o_totalprice").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", price.alias("price"), T.parsed(day).alias("day")).withColumn("price", F.expr("try_cast(price AS double)"))


@query("SELECT event_id, date_trunc('hour', ts) AS hour, time_bucket(INTERVAL 5 MINUTES, ts, TIMESTAMP '1970-01-01') AS block, ts + INTERVAL 8 HOURS AS local_ts FROM events")
def time_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", T.hour_floor(F.col("ts")).alias("hour"), T.minutes_floor(F.col("ts"), 5).alias("block"), T.to_zone(F.col("ts"), "Asia/Singapore").alias("local_ts"))


# --- joins and sets --------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_nationkey, n_name, r_name FROM customer LEFT JOIN (SELECT n_nationkey::VARCHAR AS k, n_name, n_regionkey FROM nation WHERE n_nationkey < 20) ON c_nationkey::VARCHAR = k LEFT JOIN region ON n_regionkey = r_regionkey")
def left_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("k"), "n_name", "n_regionkey")
    rows = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey").cast("string") == F.col("k"), "left")
    return rows.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "c_nationkey", "n_name", "r_name")


STAR_SQL = "SELECT {0} AS Hkey, p_name AS Description, p_type AS Equipment, p_size::BIGINT AS RTUNumber, p_brand AS Location FROM part"


@query(
    """SELECT p_type AS Equipment, p_name AS Description, l_shipdate AS DateTime, l_quantity AS CurrValue, p_partkey::VARCHAR AS Hkey, k AS HkeyDateTime FROM
    (SELECT l_partkey::VARCHAR || strftime(l_shipdate, '%Y%m%d%H%M%S') AS k, l_quantity FROM lineitem) i JOIN
    (SELECT DISTINCT l_partkey::VARCHAR || strftime(l_shipdate, '%Y%m%d%H%M%S') AS k, l_shipdate, l_partkey::VARCHAR AS Hkey FROM lineitem) l USING (k) JOIN part ON p_partkey::VARCHAR = Hkey"""
)
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("Hkey"), F.col("l_shipdate").cast("timestamp_ntz").alias("DateTime"), F.col("l_quantity").alias("CurrValue"))
    li = li.withColumn("HkeyDateTime", F.concat("Hkey", T.compact(F.col("DateTime"))))
    dim = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("Hkey"), F.col("p_name").alias("Description"), F.col("p_type").alias("Equipment"))
    return J.readings(li, li.select("HkeyDateTime", "DateTime", "Hkey").distinct(), dim).select("Equipment", "Description", "DateTime", "CurrValue", "Hkey", "HkeyDateTime")


BIG = "SELECT o_custkey FROM orders WHERE o_totalprice > 400000"


@query(f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN ({BIG})")
def semi_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return J.only_keys(table(spark, sf_dir, "customer"), big, ["c_custkey"]).select("c_custkey", "c_name")


@query(f"SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN ({BIG})")
def anti_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return J.not_keys(table(spark, sf_dir, "customer"), big, ["c_custkey"]).select("c_custkey", "c_name")


@query(f"SELECT c_custkey, c_custkey IN ({BIG}) AS is_abnormal FROM customer")
def mark_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return J.with_mark(table(spark, sf_dir, "customer"), big, ["c_custkey"], "is_abnormal").select("c_custkey", "is_abnormal")


@query("SELECT user_id, arg_min(value, (ts, event_id)) AS first_value FROM events GROUP BY user_id")
def first_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", F.col("value").alias("Longitude"), "ts", "event_id")
    return S.sensor_locations(rows, ("ts", "event_id"), USER).select("user_id", F.col("Longitude").alias("first_value"))


@query(r"SELECT DISTINCT regexp_replace(k, '\D', '', 'g') AS HkeyDateTime, t AS DateTime, h AS Hkey FROM (SELECT o_orderpriority || o_custkey AS k, o_orderdate AS t, o_custkey::VARCHAR AS h FROM orders UNION ALL SELECT o_custkey::VARCHAR, o_orderdate, o_custkey::VARCHAR FROM orders WHERE o_orderstatus = 'F')")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("Hkey", F.col("o_custkey").cast("string")).withColumn("DateTime", F.col("o_orderdate").cast("timestamp_ntz"))
    a = o.select(F.concat("o_orderpriority", "Hkey").alias("HkeyDateTime"), "DateTime", "Hkey")
    return C.link_table(a, o.filter("o_orderstatus = 'F'").select(F.col("Hkey").alias("HkeyDateTime"), "DateTime", "Hkey"))


@query('SELECT DISTINCT ts AS "DateTime", ts::DATE AS "Date", hour(ts)::INT AS "Hour", minute(ts)::INT AS "Minute" FROM events')
def date_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.date_dimension(events(spark, sf_dir), "ts")


# --- merges ----------------------------------------------------------------------------------------------------


def _merge(name: str, source: str, target: str) -> None:
    """Registers the merge of a table: source and target are SQL over the tables that both engines read alike."""
    m = G.MERGES[name]
    quoted = lambda cs: ", ".join(f'"{c}"' for c in cs)
    same = " AND ".join(f't."{k}" = x."{k}"' for k in m.keys)
    SQL[f"merge_{name.lower()}"] = f"WITH x AS (SELECT {'DISTINCT ' if m.distinct else ''}{quoted(m.columns)} FROM ({source})), t AS ({target}) SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM t WHERE {same})"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in ("orders", "lineitem", "events", "part", "customer"):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
        back = lambda s: spark.sql(s.replace('"', "`").replace("::VARCHAR", "::STRING").replace("::INT", "::INT"))
        return G.merge_into(back(source), back(target), name)

    run.__name__ = f"merge_{name.lower()}"
    QUERIES[run.__name__] = run


_merge("alarmevent", 'SELECT o_custkey::VARCHAR AS "HkeyDateTime", o_orderstatus AS "Status" FROM orders', "SELECT o_custkey::VARCHAR AS \"HkeyDateTime\", o_orderstatus AS \"Status\" FROM orders WHERE o_orderpriority = '5-LOW'")
_merge("data", 'SELECT l_returnflag AS "Equipment", l_partkey::VARCHAR AS "Description", l_shipdate AS "DateTime", l_quantity AS "CurrValue" FROM lineitem', 'SELECT l_returnflag AS "Equipment", l_partkey::VARCHAR AS "Description", l_shipdate AS "DateTime" FROM lineitem WHERE l_linenumber = 1')
_merge("dateDim", 'SELECT o_orderdate AS "DateTime", CAST(o_orderdate AS DATE) AS "Date", CAST(hour(o_orderdate) AS INT) AS "Hour", CAST(minute(o_orderdate) AS INT) AS "Minute" FROM orders', "SELECT o_orderdate AS \"DateTime\" FROM orders WHERE o_orderstatus = 'F'")
_merge(
    "dim",
    'SELECT p_partkey AS "IPAddress", CAST(p_size AS BIGINT) AS "RowId", p_name AS "Description", p_brand AS "Tagname", CAST(p_size AS BIGINT) AS "RTUNumber", CAST(p_size AS BIGINT) AS "RawType", p_type AS "Location", p_partkey::VARCHAR AS "Hkey", \'Analog\' AS "Signaltype", p_type AS "Equipment" FROM part',
    'SELECT p_partkey AS "IPAddress", CAST(p_size AS BIGINT) AS "RowId", p_brand AS "Tagname" FROM part WHERE p_size > 25',
)
_merge("inst", 'SELECT l_orderkey::VARCHAR AS "HkeyDateTime", l_quantity AS "CurrValue" FROM lineitem', 'SELECT l_orderkey::VARCHAR AS "HkeyDateTime" FROM lineitem WHERE l_linenumber = 5')
_merge("linktable", 'SELECT l_orderkey::VARCHAR AS "HkeyDateTime", l_shipdate AS "DateTime", l_partkey::VARCHAR AS "Hkey" FROM lineitem', 'SELECT l_orderkey::VARCHAR AS "HkeyDateTime", l_shipdate AS "DateTime", l_partkey::VARCHAR AS "Hkey" FROM lineitem WHERE l_linenumber > 3')
_merge("longlat", 'SELECT c_name AS "Location", c_acctbal AS "Longitude", CAST(c_nationkey AS DOUBLE) AS "Latitude" FROM customer', 'SELECT c_name AS "Location", c_acctbal AS "Longitude", CAST(c_nationkey AS DOUBLE) AS "Latitude" FROM customer WHERE c_nationkey < 12')


# --- suppression and alerts ------------------------------------------------------------------------------------


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's days: first and last event."""
    return events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("event_id").alias("id"), F.min("ts").alias("a"), F.max("ts").alias("b"))


@query(
    """WITH u AS (SELECT user_id, ts::DATE AS day, min(event_id) AS id, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1, 2)
    SELECT x.id, y.id AS peer FROM u x JOIN u y ON x.id <> y.id AND abs(date_diff('microsecond', x.a, y.a)) <= 1800000000 AND abs(date_diff('microsecond', x.b, y.b)) <= 1800000000"""
)
def near_time_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.near_time_pairs(spans(spark, sf_dir), id_col="id", start_col="a", end_col="b", minutes=30).select("id", "peer")


@query("SELECT a.p_partkey AS id, b.p_partkey AS peer FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND a.p_brand = b.p_brand AND length(a.p_name) >= 5 AND length(b.p_name) >= 5 AND left(a.p_name, 5) = left(b.p_name, 5)")
def prefix_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.prefix_pairs(table(spark, sf_dir, "part"), id_col="p_partkey", name_col="p_name", length=5, within_cols=["p_brand"])


#: Names that are alike only where they are equal, so that SQL can say the same.
STATIONS = ("Alpha north pump", "Bravo quay level", "Charlie mixer 12", "Delta outfall flow")


@query(
    f"""WITH u AS (SELECT user_id, ts::DATE AS day, min(event_id) AS id, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1, 2),
    x AS (SELECT id, a, b, list_extract({list(STATIONS)}, (user_id % 4)::INT + 1) AS name, epoch_us(a) // 300000000 AS sb, epoch_us(b) // 300000000 AS eb FROM u),
    f AS (SELECT x.id, arg_min(y.id, (y.sb, y.eb, y.id)) AS peer FROM x JOIN x y ON x.id <> y.id AND x.name = y.name AND abs(epoch_us(x.a) - epoch_us(y.a)) <= 300000000 AND abs(epoch_us(x.b) - epoch_us(y.b)) <= 300000000 GROUP BY x.id)
    SELECT x.id, a, b, name, peer IS NOT NULL AS "Suppressed", 'clustered_with: ' || peer AS "Suppression_Reason" FROM x LEFT JOIN f ON f.id = x.id"""
)
def suppression_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of users get names of four stations; alike ones that start and end together are suppressed."""
    rows = spans(spark, sf_dir).withColumn("name", F.get(F.array(*[F.lit(x) for x in STATIONS]), (F.col("user_id") % 4).cast("int")))
    return P.annotate_suppression(rows, start_col="a", end_col="b", description_col="name", id_col="id").select("id", "a", "b", "name", "Suppressed", "Suppression_Reason")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.select(
        F.col("o_orderkey").alias("Id"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("plots/"), F.col("o_orderkey").cast("string"))).alias("Plot_Path"), (F.col("o_orderkey") % 3 == 0).alias("Suppressed"),
        F.date_format("o_orderdate", "yyyyMM").alias("SnapshotRunId"), F.col("o_orderdate").cast("timestamp_ntz").alias("SnapshotAtSGT"), F.when(F.col("o_orderstatus") == "F", F.lit(1)).alias("AlertTriggered"),
    )


HISTORY_SQL = "hist AS (SELECT o_orderkey AS Id, CASE WHEN o_orderkey % 3 > 0 THEN 'plots/' || o_orderkey END AS Plot_Path, o_orderkey % 3 = 0 AS Suppressed, strftime(o_orderdate, '%Y%m') AS SnapshotRunId, o_orderdate AS SnapshotAtSGT, CASE WHEN o_orderstatus = 'F' THEN 1 END AS AlertTriggered FROM orders)"


@query(f"WITH {HISTORY_SQL} SELECT Id, Plot_Path FROM hist WHERE AlertTriggered IS NULL AND Plot_Path IS NOT NULL ORDER BY Id LIMIT 25")
def unsent_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A poll takes the oldest ones; the limit is the operator's."""
    return G.unsent(history(spark, sf_dir), 25).select("Id", "Plot_Path")


@query(
    """WITH log AS (SELECT l_orderkey AS Id, l_linenumber % 2 = 0 AS Success, l_partkey AS AlertMessageId, l_suppkey AS AlertResponseCode, l_shipdate AS "At" FROM lineitem)
    SELECT Id, Success, AlertMessageId, AlertResponseCode, "At" FROM (SELECT *, row_number() OVER (PARTITION BY Id ORDER BY "At" DESC, Success DESC, AlertMessageId DESC, AlertResponseCode DESC) AS r FROM log) WHERE r = 1"""
)
def alert_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("Id"), (F.col("l_linenumber") % 2 == 0).alias("Success"), F.col("l_partkey").alias("AlertMessageId"), F.col("l_suppkey").alias("AlertResponseCode"), F.col("l_shipdate").cast("timestamp_ntz").alias("At"))
    return G.latest_state(log)


@query(
    f"""WITH {HISTORY_SQL} SELECT SnapshotRunId, count(*) AS rows, count(Plot_Path) AS plots, count_if(Suppressed) AS suppressed, max(SnapshotAtSGT) AS last_write,
    count(Plot_Path) = 0 AND date_diff('minute', max(SnapshotAtSGT), TIMESTAMP '2025-01-01') >= 5 AS silent, count_if(Suppressed) = count(*) AS all_suppressed FROM hist GROUP BY 1 ORDER BY last_write DESC, SnapshotRunId DESC LIMIT 10"""
)
def heartbeat_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten runs; documented, not coded, where the other operators come from."""
    return G.run_report(history(spark, sf_dir), now=F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"))


@query("SELECT c_custkey, 'at ' || c_name AS caption FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").filter("c_acctbal > 0").orderBy(F.desc("c_acctbal"), "c_custkey").limit(10)
    return rows.select("c_custkey", F.format_string("at %s", "c_name").alias("caption"))


@query("SELECT n_nationkey, n_name, n_regionkey, TIMESTAMP '2024-02-01 06:00:00' AS \"SnapshotAtSGT\", '20240201_0600' AS \"SnapshotRunId\", (count(*) OVER (PARTITION BY n_nationkey, n_name, n_regionkey))::BIGINT AS alike FROM nation")
def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row hashes are Spark's own; what is compared is how many rows share one."""
    rows = G.snapshot(table(spark, sf_dir, "nation"), at=F.lit("2024-02-01 06:00:00").cast("timestamp_ntz"))
    return rows.withColumn("alike", F.count("*").over(W.partitionBy("RecordHash"))).drop("RecordHash")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

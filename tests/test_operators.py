"""Cleaning, joins, merges, suppression, summaries, sources and alerts."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sensorloom.config import PipelineConfig, required_env
from sensorloom.functions import numbers as M
from sensorloom.functions import text as X
from sensorloom.functions import times as T
from sensorloom.operators import clean as C
from sensorloom.operators import clusters as K
from sensorloom.operators import merge as G
from sensorloom.operators import star as J
from sensorloom.operators import summary as S
from sensorloom.operators.suppress import annotate_suppression
from sensorloom.plans import ingest
from sensorloom.schemas import HISTALMEVT, HISTCURR, HISTORY, LONGLAT, need, with_optional
from sensorloom.sources import files as L
from sensorloom.sources.cleanup import remove
from sensorloom.sources.database import Jdbc, Store
from sensorloom.sources.delimited import cast_or_null, read_csv, read_texts, write_table
from sensorloom.streaming import alerts as A
from sensorloom.streaming.readings import hourly_counts, on_time, read_stream, rule_alarms


def ts(text):
    return datetime.fromisoformat(text)


@pytest.fixture
def exports(spark):
    curr = [
        (ts("2025-01-01"), "X-S606-KAL-1", 1, 23, "ALPHA-Pump Pressure", 1, 9), (ts("2025-01-01"), "T2", 2, 5, "Rajah-Valve", 2, 9), (ts("2025-01-01"), "S606-KAL", 3, 5, "marinaRWPS S606 flow", 5, 9),
        (ts("2025-01-01"), "T4", 4, 5, "KranjiIPU xx CNF", 1, 9), (ts("2025-01-01"), "T5", 5, 5, "No station", 1, None),
    ]
    hist = [(1, 23, ts("2025-01-08 00:00:00"), 5.0), (2, 5, ts("2025-01-08 01:00:00"), 1e9), (3, 5, ts("2025-01-08 02:00:00"), -3.0), (4, 5, None, 1.0)]
    alm = [(ts("2025-01-08 00:00:00"), " 123 Stop "), (ts("2025-01-01 00:00:00"), "9 Old"), (ts("2025-01-07 00:00:00"), "Nospace"), (ts("2025-01-05 10:00:00"), "AB-1 x Open")]
    return spark.createDataFrame(curr, HISTCURR), spark.createDataFrame(hist, HISTORY), spark.createDataFrame(alm, HISTALMEVT)


def test_dimension(exports):
    got = {r.IPAddress: r for r in C.dimension(exports[0]).collect()}
    assert 5 not in got, "a row with a null goes before its station could be filled in"
    assert [got[i].RTUNumber for i in (1, 2, 3, 4)] == [1001, 1004, 1007, 4221]
    assert (got[1].Hkey, got[1].Location, got[1].Signaltype, got[1].Equipment) == ("123", "ALPHA", "Analog", "Pressure")
    assert (got[2].Signaltype, got[2].Equipment) == ("Digital", "Valve") and got[3].Equipment == "Flowrate" and got[4].Equipment == "Others"


def test_star(spark, exports):
    star = ingest.star(*exports)
    assert {r.HkeyDateTime for r in star.inst.collect()} == {"12320250108000000", "3520250108020000"}
    assert {(r.HkeyDateTime, r.Status) for r in star.alarmevent.collect()} == {("12320250108000000", "Stopped"), ("120250105100000", "Open")}
    assert [r.ALARMTEXT for r in star.bad_alarms.collect()] == ["Nospace"]
    assert star.linktable.filter("HkeyDateTime = '12320250108000000'").count() == 1, "an alarm and a reading of one key are one link"
    assert star.date_dim.filter("Hour = 10").first().Minute == 0
    places = spark.createDataFrame([(103.8, 1.3, "Kallang", "1001")], LONGLAT)
    rows = ingest.detector_input(star, places, excluded=("Others",))
    got = {r.Equipment: r for r in rows.collect()}
    assert rows.columns[:4] == J.CORE and got["Pressure"].GeoLocation == "Kallang" and got["Pressure"].Location == "ALPHA" and got["Flowrate"].Longitude is None


def test_missing_columns(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="missing columns"):
        need(df, "id", "x")
    assert with_optional(df, Longitude="double", id="int").dtypes == [("id", "bigint"), ("Longitude", "double")]


def test_recency(spark):
    rows = spark.createDataFrame([(ts("2025-01-01"),), (ts("2025-01-01 00:00:01"),), (ts("2025-01-08"),)], "t timestamp_ntz")
    assert C.since_newest(rows, "t", hours=168).count() == 2 and C.since_newest(rows, "t", hours=168, inclusive=True).count() == 3
    kinds = spark.createDataFrame([("a",), (None,), ("b",)], "k string")
    assert [r.k for r in C.without_kinds(kinds, "k", ("a",)).orderBy("k").collect()] == [None, "b"]


def test_text_and_times(spark):
    row = spark.createDataFrame([("  a b\t c ", "x y z", "none", ts("2025-01-02 03:04:05"))], "a string, b string, c string, t timestamp_ntz").select(
        X.collapsed(F.col("a")).alias("tidy"), X.before_last_space(F.col("b")).alias("head"), X.after_last_space(F.col("b")).alias("tail"), X.after_last_space(F.col("c")).alias("no"),
        X.safe_name(F.lit("A/B"), F.lit("c" * 200)).alias("file"), X.common_prefix_length(F.lit("abcd"), F.lit("abx")).alias("p"), X.common_prefix_length(F.lit(""), F.lit("a")).alias("p0"),
        T.minutes_floor(F.col("t"), 5).alias("m5"), T.hour_floor(F.col("t")).alias("h"), T.run_id(F.col("t")).alias("run"), T.parsed(F.lit("05/02/2025 01:02:03")).alias("d"), T.parsed(F.lit("x")).alias("bad"),
        T.within(F.col("t"), F.col("t") + F.expr("INTERVAL 5 MINUTES"), 5).alias("near"), T.within(F.col("t"), F.lit(None).cast("timestamp_ntz"), 5).alias("null"), T.to_zone(F.col("t"), "Asia/Singapore").alias("sg"),
        M.finite(F.lit(float("nan"))).alias("nan"), M.finite(F.lit(float("inf"))).alias("inf"), M.clipped(F.lit(9.0), 1, 5).alias("clip"),
    ).first()
    assert (row.tidy, row.head, row.tail, row.no, row.p, row.p0) == ("a b c", "x y", "z", None, 2, 0)
    assert row.file.startswith("A_B_ccc") and len(row.file) == 144
    assert (row.m5, row.h, row.run, row.d, row.bad) == (ts("2025-01-02 03:00:00"), ts("2025-01-02 03:00:00"), "20250102_0304", ts("2025-02-05 01:02:03"), None)
    assert row.near and not row.null and row.sg == ts("2025-01-02 11:04:05") and row.nan is None and row.inf is None and row.clip == 5


def test_config():
    assert PipelineConfig.from_env({}) == PipelineConfig()
    got = PipelineConfig.from_env({"SENSORLOOM_WINDOW_HOURS": "24", "SENSORLOOM_EXCLUDED_EQUIPMENT": "a, b", "SENSORLOOM_SUPPRESSION_ENABLED": "0"})
    assert (got.window_hours, got.excluded_equipment, got.suppression_enabled) == (24, ("a", "b"), False)
    with pytest.raises(ValueError, match="no int"):
        PipelineConfig.from_env({"SENSORLOOM_WINDOW_HOURS": "x"})
    with pytest.raises(KeyError):
        required_env("ABSENT", {})


def test_merge(spark):
    source = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.0), ("b", 1.0)], "HkeyDateTime string, CurrValue double")
    target = spark.createDataFrame([("b", 9.0)], "HkeyDateTime string, CurrValue double")
    assert sorted(map(tuple, G.merge_into(source, target, "inst").collect())) == [("a", 1.0), ("a", 2.0)], "both payloads of a new key"


def test_store(spark, exports, tmp_path):
    store, star = Store(str(tmp_path)), ingest.star(*exports)
    bad = spark.range(1)
    assert store.merge_all(spark, star.tables() | {"data": bad})["dim"] == "merged"
    again = store.merge_all(spark, star.tables())
    assert set(again.values()) == {"merged"} and store.read(spark, "dim", star.dim.schema).count() == star.dim.count(), "nothing is new the second time"
    assert store.merge_all(spark, {"data": bad})["data"].startswith("failed") and store.merge_all(spark, {"data": bad}, skip=True) == {"data": "skipped"}
    there = remove(spark, [store.path("dim"), store.path("none")])
    assert there == [store.path("dim")] and store.read(spark, "dim", star.dim.schema).count() > 0
    remove(spark, there, dry_run=False)
    assert store.read(spark, "dim", star.dim.schema).count() == 0


def test_password_is_not_shown():
    db = Jdbc("jdbc:x", "u", "hidden")
    assert "hidden" not in repr(db) and db.options()["password"] == "hidden"


#: Invented pairs of names, and whether they are alike: one letter apart, a common prefix of 15, and neither.
NAMES = [
    ("Orchard weir 3 outlet", "Orchard weir 4 outlet", True),
    ("Quarry basin no. 12 turbidity", "Quarry basin no. 7 level", True),
    ("Quarry basin n", "Quarry basin n, filter bed east", False),
    ("Mill lane pump A pressure", "Tannery dosing tank chlorine", False),
    ("north gate", "south gate lower sluice", False),
    ("", "", False),
    ("same", "same", True),
]


@pytest.mark.parametrize(("a", "b", "alike"), NAMES)
def test_names(spark, a, b, alike):
    t = ts("2025-01-01 00:04:59")
    rows = spark.createDataFrame([(1, a, t, t), (2, b, ts("2025-01-01 00:09:59"), t), (3, a or "z", ts("2025-01-01 00:15:01"), t)], "id int, n string, s timestamp_ntz, e timestamp_ntz")
    got = {r.id: (r.Suppressed, r.Suppression_Reason) for r in annotate_suppression(rows, start_col="s", end_col="e", description_col="n", id_col="id").collect()}
    assert got == {1: (alike, "clustered_with: 2" if alike else None), 2: (alike, "clustered_with: 1" if alike else None), 3: (False, None)}
    assert not annotate_suppression(rows, start_col="s", end_col="e", description_col="n", id_col="id", enabled=False).filter("Suppressed").count()


def summary_rows(spark):
    rows = [("Pump", "P1", 5, 2.0, 1, 1, 0, 9.0), ("Pump", "P2", 9, 3.0, 2, 1, 1, 8.0), ("Flow", "F1", 7, 3.0, 1, 1, 1, 8.5), ("Flow", "F2", 1, 9.0, 1, 0, 0, 99.0)]
    return spark.createDataFrame(rows, "Equipment string, Description string, Anomaly_Points int, Anomaly_Pct double, Num_Events int, Z_Points int, ISO_Points int, Peak_RZ double").withColumn("DTW_Points", F.lit(0))


def test_ranking(spark):
    rows = summary_rows(spark)
    assert [r.Description for r in S.top_sensors(rows, most=2).collect()] == ["F1", "P2"]
    assert [r.Description for r in S.by_anomalies(rows).collect()] == ["P2", "F1", "P1", "F2"]
    assert tuple(S.totals(rows).first()) == (4, 5) and tuple(S.totals(rows.limit(0)).first()) == (0, 0)


def test_locations(spark):
    rows = spark.createDataFrame([("a", "x", 2, "1.0"), ("a", "x", 1, "bad"), ("b", "y", 1, "2.5")], "Equipment string, Description string, DateTime int, Longitude string").withColumn("Latitude", F.lit("1"))
    places = S.sensor_locations(rows)
    assert {r.Description: (r.Longitude, r.Location) for r in places.collect()} == {"x": ("bad", None), "y": ("2.5", None)}
    assert [(r.Description, r.is_abnormal) for r in S.location_map(places, rows.filter("Description = 'y'")).collect()] == [("y", True)]


def test_clusters(spark):
    rows = spark.createDataFrame([(float(i), float(i % 2) * 100) for i in range(20)] + [(None, float("nan"))], "a double, b double")
    got = K.clustered(rows, ["a", "b"], k=2)
    assert {r.Cluster for r in got.collect()} == {0, 1} and got.columns == ["a", "b", "Cluster"]
    assert {r.Cluster for r in K.clustered(rows.limit(1), ["a", "b"]).collect()} == {0}
    pc = K.projected(rows, ["a", "b"]).agg(F.avg("PC1"), F.corr("PC1", "PC2")).first()
    assert abs(pc[0]) < 1e-9 and abs(pc[1]) < 1e-9


@pytest.fixture
def hours(tmp_path):
    for h in (9, 10, 12):
        (tmp_path / "sub").mkdir(exist_ok=True)
        (tmp_path / "sub" / f"hts_2025_01_HISTORY_x2025Jan02-{h:02}0500.csv").write_text(f"IPADDRESS;ROW_ID;DATETIME;CURRVALUE\n1;2;2025-01-02 {h:02}:00:00;{h}.5\n1;2;3;4;5;6\n")
    (tmp_path / "hts_2025_01_HISTORY_none.csv").write_text("x")
    (tmp_path / "other.txt").write_text("x")
    return str(tmp_path)


def test_files(spark, hours):
    now = ts("2025-01-02 12:40:00")
    files = L.matching(L.list_files(spark, hours), r"hts_\d{4}_\d{2}_HISTORY_")
    assert files.count() == 3
    slots = L.expected_hours(spark, now, 4, 30)
    assert [r.hour.hour for r in slots.collect()] == [9, 10, 11, 12] and [r.hour.hour for r in L.missing_hours(files, slots).collect()] == [11]
    found = L.gated_window(spark, hours, r"hts_\d{4}_\d{2}_HISTORY_", now, window_hours=4)
    assert len(found.paths) == 3 and found.info["missing_percent"] == 25.0
    with pytest.raises(L.StaleSourceError):
        L.gated_window(spark, hours, r"hts_\d{4}_\d{2}_HISTORY_", now, window_hours=8)
    with pytest.raises(L.StaleSourceError):
        L.gated_window(spark, hours, "absent", now)
    assert [r.stamp.hour for r in L.latest_window(files, 3).collect()] == [10, 12]
    assert L.newest_by_name(spark, hours, r"hts_.*\d\.csv").endswith("120500.csv")
    with pytest.raises(FileNotFoundError):
        L.newest_by_name(spark, hours, "absent")
    rows = read_csv(spark, found.paths, HISTORY, sep=";", malformed="DROPMALFORMED")
    assert sorted(r.CURRVALUE for r in rows.collect()) == [9.5, 10.5, 12.5]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        read_csv(spark, found.paths, HISTORY, sep=";", malformed="FAILFAST").collect()


def test_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿café\n".encode())
    (tmp_path / "b.csv").write_bytes("café\n".encode("latin-1"))
    assert {r.line for r in L.decoded_lines(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()} == {"café"}


def test_decoded_csv(spark, tmp_path):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("name string, v double")
    (tmp_path / "a.csv").write_bytes("\ufeffname,v\ncaf\u00e9,1.5\nNA,2\n".encode())
    (tmp_path / "b.csv").write_bytes("name,v\r\ncaf\u00e9,bad\r\n\"x,y\",3\r\n".encode("latin-1"))
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    got = {(r.name, r.v) for r in L.read_decoded(spark, paths, schema).collect()}
    assert got == {("caf\u00e9", 1.5), (None, 2.0), ("caf\u00e9", None), ("x,y", 3.0)}
    assert {r.v for r in L.read_decoded(spark, paths, schema, skip_malformed=True).collect()} == {1.5, 2.0, 3.0}
    (tmp_path / "c.csv").write_text("v,name\n1,x\n")
    with pytest.raises(ValueError, match="header"):
        L.read_decoded(spark, [str(tmp_path / "c.csv")], schema)


def test_database(spark, tmp_path):
    """A round trip through the embedded database that comes with Spark, and what is handed to it."""
    db = Jdbc(f"jdbc:derby:{tmp_path}/db;create=true", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    rows = spark.createDataFrame([(i, None if i % 2 else 1, f"p{i}") for i in range(40)], "Id long, AlertTriggered int, Plot_Path string")
    db.append(rows, "history")
    db.append(rows.limit(0), "history")
    assert sorted(map(tuple, db.read(spark, "history").collect())) == sorted(map(tuple, rows.collect()))
    unsent = db.unsent(spark, "history", 5)
    assert [r.Id for r in unsent.collect()] == [1, 3, 5, 7, 9]
    plan = unsent._jdf.queryExecution().executedPlan().toString()
    assert "IsNull(" in plan.replace(" ", "") or "IS NULL" in plan, plan
    db.replace(rows.limit(3), "history")
    assert db.read(spark, "history").count() == 3


def test_run(spark, tmp_path):
    """From a folder of exports to ranked sensors and merged tables; too few hours stop it."""
    from sensorloom.config import DetectorConfig
    from sensorloom.plans.run import run

    root, now = tmp_path / "in", ts("2025-01-04 00:40:00")
    root.mkdir()
    (root / "HISTCURR_1.csv").write_text("DATETIME,TAGNAME,IPADDRESS,ROW_ID,DESCRIPTION,RAWTYPE,RTUNUMBER\n2025-01-01 00:00:00,T1,1,23,ALPHA-Pump Pressure,1,9\n2025-01-01 00:00:00,T2,2,5,Beta total flow,1,9\n")
    (root / "LongLat_1.csv").write_text("Longitude,Latitude,Location,LKey\n103.8,1.3,Here,1009\n")
    for d in range(1, 4):
        for h in range(24):
            stamp, when = f"2025Jan{d:02}-{h:02}0500", f"2025-01-{d:02} {h:02}"
            lines = [f"{ip};{row};{when}:{m:02}:00;{5 + (m % 7) / 10 + (30 if ip == 2 and (d, h) == (2, 5) else 0)}" for ip, row in ((1, 23), (2, 5)) for m in range(0, 60, 6)]
            (root / f"hts_2025_01_HISTORY_{stamp}.csv").write_text("IPADDRESS;ROW_ID;DATETIME;CURRVALUE\n" + "\n".join(lines) + "\n1;2;3;4;5\n")
            (root / f"hts_2025_01_HISTALMEVT_{stamp}.csv").write_text(f"ALARMSETTIME;ALARMTEXT\n{when}:00:00;123 Stop\n")
    store = Store(str(tmp_path / "store"))
    done = run(spark, str(root), store, now, cfg=DetectorConfig(iso_trees=20, min_event_len=1), window_hours=73)
    assert done.coverage["missing"] == 1 and set(done.merged.values()) == {"merged"}, done.merged
    assert done.seen["rows"] == 3 * 24 * 2 * 10 and done.seen["excluded"] == done.seen["without_DateTime"] == 0, done.seen
    assert done.report.points.count() == 2 * 720 and done.report.failed.count() == 0
    assert {r.Description for r in done.report.summary.collect()} >= {"Beta total flow"}
    with pytest.raises(L.StaleSourceError):
        run(spark, str(root), store, ts("2025-01-09 00:40:00"))


def test_texts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\nNA,1\n,x\nok,NaN\n")
    got = cast_or_null(read_texts(spark, str(tmp_path / "a.csv"), ["a", "b"]), b="double").collect()
    assert [(r.a, r.b) for r in got] == [(None, 1.0), (None, None), ("ok", None)]
    from pyspark.sql.types import StructType

    kept = read_csv(spark, str(tmp_path / "a.csv"), StructType.fromDDL("a string, b string"), keep_empty=True).collect()
    assert [r.a for r in kept] == ["NA", "", "ok"]
    write_table(spark.range(0), str(tmp_path / "empty"))
    assert spark.read.parquet(str(tmp_path / "empty")).count() == 0


def alert_history(spark):
    rows = [(3, None, "p3"), (1, None, "p1"), (2, 1, "p2"), (4, None, None)]
    df = spark.createDataFrame(rows, "Id long, AlertTriggered int, Plot_Path string")
    return df.withColumns({"Equipment": F.lit("Pump"), "Description": F.lit(None).cast("string"), "Num_Events": F.lit(2), "Anomaly_Points": F.lit(7), "Anomaly_Pct": F.lit(1.5), "First_Anomaly_Time": F.lit("a"), "Last_Anomaly_Time": F.lit("b"), "SnapshotRunId": F.lit("r")})


def test_alerts(spark, tmp_path):
    store, slept = Store(str(tmp_path)), []
    sender = A.Recorder([A.Reply(429, retry_after=3.0), A.Reply(200, 11), A.Reply(500)])
    remember = lambda i, ok, m, c: store.remember(spark, i, ok, m, c)
    assert A.alert_once(alert_history(spark), sender, remember, workers=1, sleep=slept.append) == 1 and 3.0 in slept
    log = spark.read.parquet(store.path("alert_status"))
    assert {(r.Id, r.Success, r.AlertResponseCode) for r in log.collect()} == {(1, True, 200), (3, False, 500)}
    state = G.with_state(alert_history(spark), log)
    assert [r.Id for r in G.unsent(state).collect()] == [2, 3], "the log alone says what was sent"
    assert sender.sent[0][1] == "p1" and "Events: 2" in sender.sent[0][0]


def test_http_sender():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs

    seen, answers = [], [(429, b'{"parameters": {"retry_after": 2}}'), (200, b'{"result": {"message_id": 5}}'), (500, b"no json")]

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.headers["Authorization"], parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())))
            code, body = answers.pop(0)
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        sender, slept = A.HttpNotifier(f"http://127.0.0.1:{server.server_port}/send", "hidden"), []
        assert "hidden" not in repr(sender)
        assert A.send_once(sender, A.RateLimiter(1e9), "héllo & more", "plots/a.png", slept.append) == A.Reply(200, 5) and 2 in slept
        assert sender.send("x", None) == A.Reply(500)
    finally:
        server.shutdown()
    assert seen[0] == ("Bearer hidden", {"text": ["héllo & more"], "picture": ["plots/a.png"]}) and seen[2][1] == {"text": ["x"]}


def test_measure_in_sql(spark):
    X.register(spark)
    assert spark.sql("SELECT name_ratio('pump a', 'pump b') AS r").first().r == X.ratio("pump a", "pump b")


def test_rate():
    now, slept = [0.0], []
    limit = A.RateLimiter(2.0, clock=lambda: now[0], sleep=slept.append)
    for _ in range(3):
        limit.wait()
    assert slept == [0.5, 1.0]


def test_run_report(spark):
    rows = spark.createDataFrame([("r1", None, True, ts("2025-01-01 00:00:00")), ("r1", None, True, ts("2025-01-01 00:01:00")), ("r2", "p", False, ts("2025-01-01 06:00:00"))], "SnapshotRunId string, Plot_Path string, Suppressed boolean, SnapshotAtSGT timestamp_ntz")
    got = G.run_report(rows, now=F.lit("2025-01-01 06:01:00").cast("timestamp_ntz")).collect()
    assert [(r.SnapshotRunId, r.silent, r.all_suppressed, r.rows) for r in got] == [("r2", False, False, 1), ("r1", True, True, 2)]


def test_stream(spark, tmp_path):
    schema = "Equipment string, Description string, DateTime timestamp_ntz, CurrValue double"
    rows = [("Pressure", "P", ts(f"2025-01-01 0{h}:10:00"), float(v)) for h, v in ((0, 5), (0, 25), (1, 6), (3, 7))]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).write.parquet(path)
    from pyspark.sql.types import StructType

    stream = read_stream(spark, path, StructType.fromDDL(schema))
    q = hourly_counts(on_time(stream)).writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.start.hour, r.rows) for r in spark.table("counts").collect()) == [(0, 2), (1, 1)], "the last hour is still open"
    q = rule_alarms(stream).writeStream.format("memory").queryName("alarms").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.CurrValue for r in spark.table("alarms").collect()] == [25.0]
    sender, done = A.Recorder(), []
    q = A.start_alerts(stream, lambda: alert_history(spark), sender, lambda *x: done.append(x), checkpoint=str(tmp_path / "c3"), every="1 second", sleep=lambda _: None)
    q.processAllAvailable()
    q.stop()
    assert {d[0] for d in done} == {1, 3}

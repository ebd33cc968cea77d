"""Merges and alert states in the embedded database that comes with Spark, and exports of either encoding."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.operators.merge import MERGES, merge_into
from sensorloom.sources import files as L
from sensorloom.sources.database import Jdbc, merge_statement

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@pytest.fixture
def db(tmp_path):
    return Jdbc(f"jdbc:derby:{tmp_path}/db;create=true", driver=DRIVER)


def rows_of(spark, table: str, ids: range):
    """Rows whose values all come from a number; two of them are equal."""
    made = spark.createDataFrame([(i,) for i in [*ids, ids[0]]], "i int")
    return made.select(*[F.concat(F.lit(f"{c} "), "i").alias(c) for c in MERGES[table].columns])


def create(db, spark, table: str, frame) -> None:
    """Keys of a type that the database compares (its own text type is not)."""
    names = ", ".join(f'"{c}" VARCHAR(60)' for c in frame.columns)
    with db.transaction(spark) as work:
        for t in (table, f"{table}_staging"):
            work.run(f"CREATE TABLE {t} ({names})")


def told(df):
    return sorted(map(str, df.collect()))


def test_all_tables_merge_as_on_files(spark, db):
    first, second = ({t: rows_of(spark, t, ids) for t in MERGES} for ids in (range(0, 8), range(5, 12)))
    for t, frame in first.items():
        create(db, spark, t, frame)
    added = db.merge(spark, first)
    tables = {t: db.read(spark, t) for t in MERGES}
    for t, m in MERGES.items():
        assert added[t] == (8 if m.distinct else 9) and told(tables[t]) == told(merge_into(first[t], first[t].limit(0), t)), t
        assert db.read(spark, f"{t}_staging").count() == 0
    assert set(db.merge(spark, first).values()) == {0}, "nothing is added twice"
    # Of 5 to 11, and 5 again, those from 8 on are new.
    assert set(db.merge(spark, second).values()) == {4}
    assert all(db.read(spark, t).count() == (12 if m.distinct else 13) for t, m in MERGES.items())


def test_an_error_rolls_all_back(spark, db):
    tables = {t: rows_of(spark, t, range(4)) for t in ("longlat", "inst")}
    for t, frame in tables.items():
        create(db, spark, t, frame)
    with db.transaction(spark) as work:
        work.run("DROP TABLE inst")
    with pytest.raises(Exception, match="INST|inst"):
        db.merge(spark, tables)
    assert db.read(spark, "longlat").count() == 0, "the table before the one that failed is as it was"
    with pytest.raises(ValueError, match="missing"):
        db.merge(spark, {"longlat": tables["longlat"].drop("Latitude")})


def test_statement():
    assert merge_statement("alarmevent", "dbo.a", "dbo.b") == 'MERGE INTO dbo.a AS t USING dbo.b AS s ON t."HkeyDateTime" = s."HkeyDateTime" AND t."Status" = s."Status" WHEN NOT MATCHED THEN INSERT ("HkeyDateTime", "Status") VALUES (s."HkeyDateTime", s."Status")'


def test_alert_states(spark, db):
    with db.transaction(spark) as work:
        work.run('CREATE TABLE history ("Id" BIGINT, "AlertTriggered" INT, "AlertTriggeredAt" TIMESTAMP, "AlertMessageId" BIGINT, "AlertResponseCode" INT, "Plot_Path" VARCHAR(20))')
        for i in range(4):
            work.run('INSERT INTO history ("Id", "Plot_Path") VALUES (?, ?)', i, f"p{i}")
    assert db.remember(spark, [(0, True, 77, 200), (1, False, None, 500), (2, True, None, 200), (9, True, 1, 200)], datetime(2025, 1, 2, 3, 4, 5), "history") == 3
    got = {r.Id: (r.AlertTriggered, r.AlertMessageId, r.AlertResponseCode, str(r.AlertTriggeredAt)) for r in db.read(spark, "history").collect()}
    assert got == {0: (1, 77, 200, "2025-01-02 03:04:05"), 1: (None, None, 500, "None"), 2: (1, None, 200, "2025-01-02 03:04:05"), 3: (None, None, None, "None")}
    assert [r.Id for r in db.unsent(spark, "history").collect()] == [1, 3]


def test_exports_of_either_encoding(spark, tmp_path):
    """Latin-1, UTF-8 with its mark, line breaks in quoted fields, stray quotes, both kinds of line ends."""
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.DoubleType())])
    (tmp_path / "latin.csv").write_bytes('a;b\r\nCaf\xe9;1\r\n"two\r\nlines; one field";2\r\n'.encode("latin-1"))
    (tmp_path / "utf.csv").write_bytes("﻿a;b\n日本;3\n5\" pipe;4\n\"say \"\"hi\"\"\";5\nx;\n".encode())
    (tmp_path / "open.csv").write_bytes(b'a;b\n"never closed;6\nlast;7')
    paths = [str(tmp_path / x) for x in ("latin.csv", "utf.csv")]
    got = {r.b: r.a for r in L.read_decoded(spark, paths, schema, sep=";").collect()}
    assert got == {1.0: "Café", 2.0: "two\r\nlines; one field", 3.0: "日本", 4.0: '5" pipe', 5.0: 'say "hi"', None: "x"} or got[2.0].replace("\r", "") == "two\nlines; one field"
    assert [r.line for r in L.decoded_lines(spark, str(tmp_path / "open.csv"), ";").orderBy("number").collect()] == ["a;b", '"never closed;6', "last;7"]
    long = "a;b\n" + "\n".join(f'"{i}" x "{i}";{i}' for i in range(20_000))
    (tmp_path / "long.csv").write_text(long)
    assert L.decoded_lines(spark, str(tmp_path / "long.csv"), ";").count() == 20_001

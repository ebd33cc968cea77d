"""Tables over JDBC, and the same tables as Parquet. A driver's jar must be on the class path."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.merge import MERGES, merge_into
from ..operators.merge import unsent as unsent_rows
from ..schemas import need


@dataclass(frozen=True)
class Jdbc:
    """How to reach a database. The password is never shown."""

    url: str
    user: str | None = None
    password: str | None = field(default=None, repr=False)
    driver: str | None = None
    batch: int = 50_000

    def options(self) -> dict[str, str]:
        given = {"url": self.url, "user": self.user, "password": self.password, "driver": self.driver, "batchsize": str(self.batch), "fetchsize": str(self.batch)}
        return {k: v for k, v in given.items() if v is not None}

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.format("jdbc").options(**self.options()).option("dbtable", table).load()

    def append(self, df: DataFrame, table: str) -> None:
        df.write.format("jdbc").options(**self.options()).option("dbtable", table).mode("append").save()

    def replace(self, df: DataFrame, table: str) -> None:
        """Staging: the table is emptied and keeps its form."""
        df.write.format("jdbc").options(**self.options()).option("dbtable", table).option("truncate", True).mode("overwrite").save()

    def unsent(self, spark: SparkSession, table: str, limit: int | None = None) -> DataFrame:
        """Spark hands the filters, the order and the limit to the database."""
        return unsent_rows(self.read(spark, table), limit)


    @contextmanager
    def transaction(self, spark: SparkSession) -> Iterator[Transaction]:
        """One connection of the driver; what is done in it holds together, or is rolled back."""
        jvm = spark._jvm
        known = jvm.java.util.Properties()
        for k, v in (("user", self.user), ("password", self.password)):
            if v is not None:
                known.setProperty(k, v)
        if self.driver is None:
            connection = jvm.java.sql.DriverManager.getConnection(self.url, known)
        else:  # of a jar that was given to Spark
            made = jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass(self.driver).getDeclaredConstructor(spark._sc._gateway.new_array(jvm.java.lang.Class, 0))
            connection = made.newInstance(spark._sc._gateway.new_array(jvm.java.lang.Object, 0)).connect(self.url, known)
        try:
            connection.setAutoCommit(False)
            yield Transaction(connection)
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.close()

    def merge(self, spark: SparkSession, sources: Mapping[str, DataFrame], *, schema: str = "", suffix: str = "_staging", end: str = "") -> dict[str, int]:
        """Adds the rows whose keys are new to each table; the number of rows added.

        The executors fill the staging tables; then one transaction merges all of them and empties the staging tables, so an error leaves the
        tables as they were. ``end``: what a database wants after a statement. Two runs at once need staging tables of their own, by ``suffix``.
        """
        for table, source in sources.items():
            m = MERGES[table]
            need(source, *m.columns)
            rows = source.select(*m.columns)
            self.replace(rows.distinct() if m.distinct else rows, schema + table + suffix)
        with self.transaction(spark) as work:
            added = {}
            for table in sources:
                added[table] = work.run(merge_statement(table, schema + table, schema + table + suffix) + end)
                work.run(f"DELETE FROM {schema}{table}{suffix}{end}")
        return added

    def remember(self, spark: SparkSession, replies: Sequence[tuple[int, bool, int | None, int | None]], at: datetime, table: str) -> int:
        """Writes (Id, success, message id, response code) of sent alerts into their rows; the number of rows changed. A failure only keeps its code, so the row is tried again."""
        changed = 0
        with self.transaction(spark) as work:
            for row, success, message, code in replies:
                if success:
                    changed += work.run(f'UPDATE {table} SET "AlertTriggered" = 1, "AlertTriggeredAt" = ?, "AlertMessageId" = ?, "AlertResponseCode" = ? WHERE "Id" = ?', at, message, code, row)
                else:
                    changed += work.run(f'UPDATE {table} SET "AlertResponseCode" = ? WHERE "Id" = ?', code, row)
        return changed


class Transaction:
    """Statements over one open connection."""

    def __init__(self, connection):
        self.connection = connection

    def run(self, sql: str, *values: int | str | datetime | None) -> int:
        """The number of rows that the statement changed."""
        statement = self.connection.prepareStatement(sql)
        try:
            for i, v in enumerate(values, 1):
                statement.setString(i, str(v)) if isinstance(v, datetime) else statement.setObject(i, v) if v is not None else statement.setNull(i, NUMBER)
            return statement.executeUpdate()
        finally:
            statement.close()


#: The JDBC code of a number, for nulls.
NUMBER = -5


def merge_statement(table: str, target: str, source: str) -> str:
    """The insert-only MERGE of a table of the store, made from its keys and columns; names are quoted, as Spark's writer quotes them."""
    m = MERGES[table]
    on = " AND ".join(f't."{k}" = s."{k}"' for k in m.keys)
    names, values = (", ".join(f'{x}"{c}"' for c in m.columns) for x in ("", "s."))
    return f"MERGE INTO {target} AS t USING {source} AS s ON {on} WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({values})"


@dataclass(frozen=True)
class Store:
    """Append-only Parquet tables in a folder."""

    root: str

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def read(self, spark: SparkSession, table: str, schema: StructType) -> DataFrame:
        """The table, or no rows if it is not there yet."""
        try:
            return spark.read.schema(schema).parquet(self.path(table))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], schema)

    def append(self, df: DataFrame, table: str) -> None:
        df.write.mode("append").parquet(self.path(table))

    def merge(self, spark: SparkSession, source: DataFrame, table: str) -> None:
        """Adds the rows whose keys are new."""
        columns = MERGES[table].columns
        schema = source.select(*columns).schema
        self.append(merge_into(source, self.read(spark, table, schema), table), table)

    def merge_all(self, spark: SparkSession, sources: dict[str, DataFrame], skip: bool = False) -> dict[str, str]:
        """Merges table by table; one that fails is reported and does not stop the rest."""
        done = {}
        for table, source in sources.items():
            if skip:
                done[table] = "skipped"
                continue
            try:
                self.merge(spark, source, table)
                done[table] = "merged"
            except Exception as e:
                done[table] = f"failed: {type(e).__name__}: {str(e)[:300]}"
        return done

    def remember(self, spark: SparkSession, row_id: int, success: bool, message: int | None = None, code: int | None = None, table: str = "alert_status") -> None:
        """Appends an alert's state; the newest one counts."""
        row = spark.createDataFrame([(row_id, success, message, code)], "Id long, Success boolean, AlertMessageId long, AlertResponseCode int")
        self.append(row.withColumn("At", F.current_timestamp().cast("timestamp_ntz")), table)

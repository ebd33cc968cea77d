"""Schemas of the exports and of the tables made of them, and checks of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType

KINDS = {"long": LongType, "int": IntegerType, "double": DoubleType, "string": StringType, "boolean": BooleanType, "date": DateType, "timestamp_ntz": TimestampNTZType}


def schema_of(columns: str) -> StructType:
    """A schema from "name kind, ..."; unlike Spark's own parser it needs no session."""
    return StructType([StructField(name, KINDS[kind]()) for name, kind in (c.split() for c in columns.split(","))])


HISTCURR = schema_of("DATETIME timestamp_ntz, TAGNAME string, IPADDRESS long, ROW_ID long, DESCRIPTION string, RAWTYPE long, RTUNUMBER long")
HISTORY = schema_of("IPADDRESS long, ROW_ID long, DATETIME timestamp_ntz, CURRVALUE double")
HISTALMEVT = schema_of("ALARMSETTIME timestamp_ntz, ALARMTEXT string")
LONGLAT = schema_of("Longitude double, Latitude double, Location string, LKey string")
DIM = schema_of("IPAddress long, RowId long, Description string, Tagname string, RTUNumber long, RawType long, Location string, Hkey string, Signaltype string, Equipment string")
INST = schema_of("HkeyDateTime string, CurrValue double")
ALARMEVENT = schema_of("HkeyDateTime string, Status string")
LINKTABLE = schema_of("HkeyDateTime string, DateTime timestamp_ntz, Hkey string")
DATEDIM = schema_of("DateTime timestamp_ntz, Date date, Hour int, Minute int")
#: What the exports write for a missing value.
MISSING = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "#N/A")


def need(df: DataFrame, *columns: str) -> None:
    """Raise before planning when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def with_optional(df: DataFrame, **kinds: str) -> DataFrame:
    """Columns that may be absent, as null where they are."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items() if c not in df.columns})


def without_markers(df: DataFrame) -> DataFrame:
    """Text that marks a missing value becomes null."""
    return df.withColumns({c: F.when(~F.col(c).isin(*MISSING), F.col(c)) for c, kind in df.dtypes if kind == "string"})

"""Text expressions."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    return F.regexp_replace(stripped(text), r"\s+", " ")


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def before_first(text: Column, mark: str = "-") -> Column:
    return F.substring_index(text, mark, 1)


def before_last_space(text: Column) -> Column:
    """Null where there is no space."""
    return F.when(F.contains(text, F.lit(" ")), F.regexp_extract(text, r"(?s)^(.*) ([^ ]*)$", 1))


def after_last_space(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(" ")), F.regexp_extract(text, r"(?s)^(.*) ([^ ]*)$", 2))


def safe_name(*parts: Column, length: int = 140, suffix: str = ".png") -> Column:
    """A file name: characters that file systems refuse become _, cut to a length."""
    return F.concat(F.substring(F.regexp_replace(F.concat_ws("_", *parts), r'[<>:"/\\|?*]', "_"), 1, length), F.lit(suffix))


def first_match(choices: Sequence[tuple[Column, str]], otherwise: str | Column) -> Column:
    """The label of the first condition that holds."""
    other = F.lit(otherwise) if isinstance(otherwise, str) else otherwise
    return F.coalesce(*[F.when(c, F.lit(label)) for c, label in choices], other)


def last_match(column: Column, choices: Sequence[tuple[Column, int]]) -> Column:
    """``column`` overwritten by each condition in turn: the last that holds counts."""
    return F.coalesce(*[F.when(c, F.lit(value)) for c, value in reversed(choices)], column)


#: Keywords of analog and digital signals in order.
ANALOG = (("dissolved", "Dissolved Oxygen"), ("cond", "Conductivity"), ("temp", "Temperature"), ("press", "Pressure"), ("volt", "Voltage"), ("flow", "Flowrate"))
DIGITAL = (("pump", "Pump"), ("valve", "Valve"), ("level", "LevelSensor"))


def signal_type(raw_type: Column) -> Column:
    return F.when(raw_type.isin(1, 5), F.lit("Analog")).otherwise(F.lit("Digital"))


def equipment(description: Column, signal: Column) -> Column:
    low = F.lower(description)
    analog = first_match([(F.contains(low, F.lit(k)), v) for k, v in ANALOG], "Others")
    digital = first_match([(F.contains(low, F.lit(k)), v) for k, v in DIGITAL], "Digital Signal")
    return F.when(signal == "Analog", analog).otherwise(digital)


def same_prefix(a: Column, b: Column, length: int) -> Column:
    return (F.length(a) >= length) & (F.length(b) >= length) & (F.left(a, F.lit(length)) == F.left(b, F.lit(length)))


def common_prefix_length(a: Column, b: Column) -> Column:
    """How many leading characters two texts share."""
    shared = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b)))),
        F.lit(0),
        lambda n, i: F.when((n == i - 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), i).otherwise(n),
    )
    return F.when(F.least(F.length(a), F.length(b)) > 0, shared).otherwise(F.lit(0))


def ratio(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp similarity; it depends on the order of its arguments."""
    return difflib.SequenceMatcher(None, a or "", b or "").ratio()


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def similarity(a: Column, b: Column) -> Column:
    """Spark has no such measure (``levenshtein`` is another one), hence a vectorised function over the standard library's."""
    return F.pandas_udf(_ratios, "double")(a, b)


def register(spark: SparkSession, name: str = "name_ratio") -> None:
    """Makes the measure a function of SQL."""
    spark.udf.register(name, F.pandas_udf(_ratios, "double"))

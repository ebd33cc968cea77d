"""Helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import temporary as temporary
from ..sources.scratch import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that is neither an ASCII letter, a digit nor beyond ASCII; upper case counts as a letter here.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: ASCII white space, the separators of the plain words.
BLANK = r"[\x20\x09-\x0D]+"


def need(df: DataFrame, *columns: str) -> None:
    """Raise before planning when a column that the operator reads is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for each row.

    An expression that stands inside a lambda is evaluated for each element; a bound lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def free(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet: the given one, or the same with underscores."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Rows a Python worker gets at once: texts can be long, so their batches are kept short. The setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    if rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def kept(df: DataFrame, name: str, batch: int | None = None, keep: bool = False) -> DataFrame:
    """The rows, written to the shared folder and read back: lineage ends there and any executor can read them.

    ``batch``: rows that Python workers get at once. ``keep``: the table outlives the innermost ``temporary``, but not one around it.
    """
    with batches_of(df.sparkSession, batch):
        return written(df, name, keep)


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where a count proves that there are at most so many rows; otherwise Spark shuffles.

    The input should be a written table or cheap to compute, as it is counted.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else unchanged (``lower`` would also change letters beyond ASCII)."""
    return F.translate(text, UPPER, LOWER)


def squeezed(text: Column) -> Column:
    """Words (letters and digits, case kept) joined by one space; null counts as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), NOT_WORD, " "))


def count_parts(joined: Column) -> Column:
    """The number of parts in a string of parts joined by one space."""
    return let(joined, lambda s: F.when(s == "", F.lit(0)).otherwise(F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1)).cast("long")


def constants(values: list, kind: str = "string") -> Column:
    """An array of constants as one literal; Spark would analyse a list of hundreds of literals again in each step."""
    return F.split(F.lit("\x1f".join(map(str, values))), "\x1f", -1).cast(f"array<{kind}>")


def parts(joined: Column) -> Column:
    """The parts of a string of parts joined by one space, none for the empty string."""
    return let(joined, lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " ", -1)))


def scanned(xs: Column, zero: Column, step: Callable[[Column, Column], Column], block: int = 64) -> Column:
    """The fold's state before each element. Blocks keep the work far below the square of the length, which appending would cost."""

    def run(part: Column, begin: Column) -> Column:
        states = F.slice(F.array(begin), 1, 0)
        return F.aggregate(part, F.struct(begin.alias("at"), states.alias("out")), lambda a, x: F.struct(step(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda b: F.slice(xs, b * block + 1, block))
    none = F.slice(F.array(F.slice(F.array(zero), 1, 0)), 1, 0)
    whole = F.aggregate(
        blocks,
        F.struct(zero.alias("at"), none.alias("out")),
        lambda a, part: let(run(part, a["at"]), lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], F.array(r["out"])).alias("out"))),
        lambda a: F.flatten(a["out"]),
    )
    return F.when(F.size(xs) == 0, F.slice(F.array(zero), 1, 0)).otherwise(whole)


def spans(text: Column, pattern: Column, group: int | Column = 0) -> Column:
    """All matches of a pattern that never matches the empty string: array of (start, end, part).

    Positions count code points; ``part`` is the text of the given group. Built from the pieces between
    the matches, as Spark has no function that returns positions of all matches.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, pattern, 0)
    one = hits if isinstance(group, int) and group == 0 else F.regexp_extract_all(text, pattern, group)
    steps = F.zip_with(F.zip_with(hits, one, lambda h, p: F.struct(F.length(h).alias("n"), p.alias("part"))), gaps, lambda h, g: F.struct(F.length(g).alias("gap"), h["n"].alias("n"), h["part"].alias("part")))

    def placed(x: Column) -> Column:
        before = scanned(x, F.lit(0), lambda a, s: a + s["gap"] + s["n"])
        return let(before, lambda at: F.transform(x, lambda s, i: F.struct((F.get(at, i) + s["gap"]).alias("start"), (F.get(at, i) + s["gap"] + s["n"]).alias("end"), s["part"].alias("part"))))

    return let(F.filter(steps, lambda s: s["n"].isNotNull()), placed)

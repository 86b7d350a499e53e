"""Dates of any common shape, inferred from all values of a column.

Every value is reduced to its shape: digits become 9, month names, weekdays,
AM/PM and offsets become marks. The shapes of a column are few; they are counted
with the largest first and second number. From a shape follow the fields'
separators and widths; whether the day or the month comes first is decided for
the whole column by the numbers seen (a number above 12 is a day). Where they
leave it open the column is marked ambiguous and read month first, or as told.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellar.session import materialize

#: a longer value is no date; a column with more shapes has no dates only
MAX_LENGTH, MAX_SHAPES = 45, 200
# English names of months and weekdays.
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
_LONG = "|".join(m for m in MONTHS if len(m) > 3)
_SHORT = "|".join(m[:3] for m in MONTHS)
_DAY = "|".join(f"{d}|{d[:3]}" for d in WEEKDAYS)
#: marks that stand for names in a shape
LONG_MONTH, SHORT_MONTH, HALF, T_MARK, ZONE = "\u0001", "\u0002", "\u0003", "\u0004", "\u0005"


def plain(value: Column) -> Column:
    """The value without white space at its ends, doubled blanks and a weekday in front."""
    v = F.btrim(value, F.lit(" \t\n\x0b\f\r"))
    v = F.when(F.contains(v, F.lit("  ")), F.regexp_replace(v, " {2,}", " ")).otherwise(v)
    return F.regexp_replace(v, rf"(?i)^(?=[mtwfs])(?:{_DAY})[,.]? ", "")


def shape(v: Column) -> Column:
    """The shape of a ``plain`` value; null for one that holds no digit or is too long.

    Only a value with a letter is searched for names.
    """
    nines = lambda s: F.translate(s, "0123456789", "9" * 10)
    s = F.regexp_replace(v, rf"(?i)(?<!\p{{L}})(?=[jfmasond])(?:{_LONG})(?!\p{{L}})", LONG_MONTH)
    s = F.regexp_replace(s, rf"(?i)(?<!\p{{L}})(?=[jfmasond])(?:{_SHORT})(?!\p{{L}})", SHORT_MONTH)
    s = F.regexp_replace(s, r"(?i)(?<!\p{L})[ap]m$", HALF)
    s = F.regexp_replace(s, r"(?<=\d)T(?=\d)", T_MARK)
    s = F.regexp_replace(s, r"(?<=\d) ?(?:Z|[+-]\d{2}:?\d{2})$", ZONE)
    s = F.regexp_replace(nines(s), r"\p{L}", "a")
    plain_numbers = nines(F.regexp_replace(v, r"(?<=\d) ?[+-]\d{2}:?\d{2}$", ZONE))
    return F.when(v.rlike(r"\d") & (F.length(v) <= MAX_LENGTH), F.when(v.rlike(r"\p{L}"), s).otherwise(plain_numbers))


_NUMERIC = re.compile(r"(9{1,4})([-/. ])(9{1,2})\2(9{1,4})")
_NAMED = re.compile(rf"(?:(9{{1,2}})([-/. ]?)([{LONG_MONTH}{SHORT_MONTH}])(?:[.,]?)([-/. ]?)(9{{2,4}})|([{LONG_MONTH}{SHORT_MONTH}])(\.?) (9{{1,2}}),? (9{{4}})|([{LONG_MONTH}{SHORT_MONTH}]) (9{{4}}))")
_TIME = re.compile(rf"(9{{1,2}}):99(:99(?:[.,](9{{1,9}}))?)?( ?{HALF})?({ZONE})?$")


def _year(digits: str) -> str | None:
    return {2: "yy", 4: "yyyy"}.get(len(digits))


def _date_part(s: str, day_first: bool) -> tuple[str, int] | None:
    """Pattern and length of the date at the start of a shape."""
    if m := _NUMERIC.match(s):
        a, sep, b, c = m.groups()
        if len(a) == 4 and len(c) <= 2:
            fields = ["yyyy", "M" * len(b), "d" * len(c)]
        elif len(a) <= 2 and _year(c):
            fields = ["d" * len(a), "M" * len(b), _year(c)] if day_first else ["M" * len(a), "d" * len(b), _year(c)]
        else:
            return None
        return sep.join(fields), m.end()
    if m := _NAMED.match(s):
        text, out = m.group(0), ""
        for run in re.findall(rf"9+|[{LONG_MONTH}{SHORT_MONTH}]|.", text):
            if run == LONG_MONTH:
                out += "MMMM"
            elif run == SHORT_MONTH:
                out += "MMM"
            elif run[0] == "9":
                year = len(run) == 4 or (m.group(5) is not None and "d" in out)
                if year and not _year(run):
                    return None
                out += _year(run) if year else "d" * len(run)
            else:
                out += run
        return out, m.end()
    if m := re.match(r"9{8}(?!9)", s):
        return "yyyyMMdd", m.end()
    if re.fullmatch(r"9{4}", s):
        return "yyyy", 4
    return None


def pattern_of(s: str, day_first: bool = False) -> str | None:
    """Spark's datetime pattern for a shape, or null where the shape is no date."""
    if "a" in s or not (found := _date_part(s, day_first)):
        return None
    out, at = found
    if at == len(s):
        return out
    sep = next((x for x in (", ", " ", T_MARK) if s.startswith(x, at)), None)
    m = _TIME.match(s, at + len(sep)) if sep else None
    if not m:
        return None
    hours, seconds, fraction, half, zone = m.groups()
    out += "'T'" if sep == T_MARK else sep
    out += ("h" if half else "H") * len(hours) + ":mm"
    if seconds:
        out += ":ss" + (seconds[3] + "S" * len(fraction) if fraction else "")
    if half:
        out += half.replace(HALF, "a")
    return out + ("[ ]XXX" if zone else "")


def open_order(s: str) -> bool:
    """Whether a shape has two numbers that may be day and month in either order."""
    m = _NUMERIC.match(s)
    return bool(m) and len(m.group(1)) <= 2


@dataclass(frozen=True)
class Shapes:
    """What was inferred for a column: pattern by shape, and whether the order of day and month is a guess."""

    patterns: dict[str, str]
    ambiguous: bool


def _counted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, shape, n, first, second): shapes of non-null values, those in an open order with their largest first two numbers."""
    items = [F.struct(F.lit(c).alias("column"), plain(F.col(c)).alias("v")) for c in columns]
    rows = df.select(F.explode(F.array(*items)).alias("s")).select("s.*").where("v is not null")
    # only an ``open_order`` shape is asked for its numbers, and it starts with them
    number = lambda i: F.when(F.col("v").rlike(r"^\d{1,2}[-/. ]\d"), F.regexp_extract("v", r"^(\d+)" + r"\D+(\d+)" * i, i + 1).try_cast("int"))
    rows = rows.select("column", shape(F.col("v")).alias("shape"), number(0).alias("a"), number(1).alias("b"))
    return rows.groupBy("column", "shape").agg(F.count(F.lit(1)).alias("n"), F.max("a").alias("first"), F.max("b").alias("second"))


def infer_shapes(df: DataFrame, columns: Sequence[str], day_first: bool | None = None) -> dict[str, Shapes]:
    """Patterns per column, for columns whose every shape is a date; at most MAX_SHAPES rows a column reach the driver."""
    if not columns:
        return {}
    counted = materialize(_counted(df, columns))  # read twice
    sizes = counted.groupBy("column").agg(F.count(F.lit(1)).alias("k"), F.count("shape").alias("known"))
    few = sizes.where((F.col("k") <= MAX_SHAPES) & (F.col("k") == F.col("known"))).select("column")
    by_column: dict[str, list] = {}
    for r in counted.join(few, "column").collect():
        by_column.setdefault(r["column"], []).append(r)
    out = {}
    for c, rows in by_column.items():
        loose = [r for r in rows if open_order(r["shape"])]
        first, second = (max((r[k] for r in loose), default=0) for k in ("first", "second"))
        if first > 12 and second > 12:
            continue  # neither order reads all values
        ambiguous = bool(loose) and first <= 12 and second <= 12
        order = first > 12 or (ambiguous and bool(day_first))
        patterns = {r["shape"]: pattern_of(r["shape"], order) for r in rows}
        if all(patterns.values()):
            out[c] = Shapes(patterns, ambiguous and day_first is None)
    return out


def parse_columns(df: DataFrame, found: dict[str, Shapes]) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with helper columns, and for each column the timestamp of its value (null where it is no valid date of its shape).

    Offsets are applied; times without one are taken as they stand. The plain
    value and its shape are projections of their own, so that they are computed
    once a row and not once a pattern.
    """
    v = {c: f"__date_text_{i}" for i, c in enumerate(found)}
    s = {c: f"__date_shape_{i}" for i, c in enumerate(found)}
    df = df.select("*", *[plain(F.col(c)).alias(v[c]) for c in found])
    df = df.select("*", *[shape(F.col(v[c])).alias(s[c]) for c in found])
    out = {}
    for c, shapes in found.items():
        value = F.lit(None).cast("timestamp")
        for mark, pattern in shapes.patterns.items():
            text = F.regexp_replace(v[c], r"([+-]\d{2})(\d{2})$", "$1:$2") if "XXX" in pattern else F.col(v[c])
            value = F.when(F.col(s[c]) == mark, F.try_to_timestamp(text, F.lit(pattern))).otherwise(value)
        out[c] = value
    return df, out


def date_shapes(df: DataFrame, columns: Sequence[str], day_first: bool | None = None) -> DataFrame:
    """Report: column, pattern, n (values of the shapes read by it), ambiguous; columns that are no dates have no rows."""
    found = infer_shapes(df, columns, day_first)
    rows = [(c, s, p, f.ambiguous) for c, f in found.items() for s, p in f.patterns.items()]
    known = df.sparkSession.createDataFrame(rows, "column string, shape string, pattern string, ambiguous boolean")
    return _counted(df, list(found) or list(columns)[:1]).join(known, ["column", "shape"]).groupBy("column", "pattern", "ambiguous").agg(F.sum("n").alias("n"))

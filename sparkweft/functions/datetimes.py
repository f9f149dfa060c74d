"""Dates and times, in the two dialects' spellings, and their pattern languages."""

from __future__ import annotations

import re
from datetime import datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import INTEGERS, NUMBERS, TEXTS, Expr, expr, literal, made, require

MOMENTS = ("date", "timestamp", "timestamptz")
DAY = 86_400_000_000

#: Strftime letters and what they are in Java patterns.
STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "f": "ss.SSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "p": "a", "I": "hh", "y": "yy"}
#: PostgreSQL template words and what they are in Java patterns, longest first.
TO_CHAR = {"HH24": "HH", "HH12": "hh", "YYYY": "yyyy", "Month": "MMMM", "Day": "EEEE", "DDD": "DDD", "Mon": "MMM", "MON": "MMM", "Dy": "EEE", "HH": "hh", "MI": "mm", "SS": "ss", "MM": "MM", "DD": "dd", "YY": "yy", "MS": "SSS", "US": "SSSSSS", "AM": "a", "PM": "a", "Q": "q"}


def _moment(value: Any, what: str) -> tuple[Expr, Column]:
    """A temporal value, or text that holds one, as a timestamp without zone."""
    e = expr(value)
    require(e, (*MOMENTS, *TEXTS), what)
    return e, e.column.cast("timestamp_ntz")


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def current_date() -> Expr:
    return Expr(F.current_date(), "date", False, "constant")


def current_time() -> Expr:
    return Expr(F.date_format(F.current_timestamp(), "HH:mm:ss"), "time", False, "constant")


def current_timestamp() -> Expr:
    return Expr(F.current_timestamp(), "timestamptz", False, "constant")


now = current_timestamp
localtime = current_time


def localtimestamp() -> Expr:
    return Expr(F.localtimestamp(), "timestamp", False, "constant")


def clock_timestamp() -> Expr:
    """The wall clock at each call, unlike now(), which is one time per query."""
    tick = F.java_method(F.lit("java.lang.System"), F.lit("currentTimeMillis"))
    return Expr(F.timestamp_millis(tick.cast("long")), "timestamptz", False, "scalar")


def date(value: Any) -> Expr:
    e, c = _moment(value, "date")
    return made([e], F.date_format(c, "yyyy-MM-dd"), "text")


def time(value: Any) -> Expr:
    e, c = _moment(value, "time")
    return made([e], F.date_format(c, "HH:mm:ss"), "text")


def datetime_(value: Any) -> Expr:
    e, c = _moment(value, "datetime")
    return made([e], F.date_format(c, "yyyy-MM-dd HH:mm:ss"), "text")


def _quoted(text: str) -> str:
    """Literal text of a pattern: letters are quoted for Java."""
    return re.sub(r"[A-Za-z]+", lambda m: f"'{m.group()}'", text.replace("'", "''"))


def strftime(pattern: str, value: Any) -> Expr:
    """%s and %w, %J are computed; the other letters become one Java pattern."""
    e, c = _moment(value, "strftime")
    parts: list[Column] = []
    for letter, text in re.findall(r"%(.)|([^%]+)", pattern):
        if text:
            parts.append(F.lit(text))
        elif letter == "s":
            parts.append(F.floor(_micros(c) / 1_000_000).cast("string"))
        elif letter == "w":
            parts.append((F.dayofweek(c) - 1).cast("string"))
        elif letter == "J":
            parts.append((_micros(c) / DAY + 2440587.5).cast("string"))
        elif letter == "%":
            parts.append(F.lit("%"))
        elif letter in STRFTIME:
            parts.append(F.date_format(c, STRFTIME[letter]))
        else:
            raise ValueError(f"strftime: unknown letter %{letter}")
    return made([e], F.concat(*parts), "text")


def julianday(value: Any) -> Expr:
    e, c = _moment(value, "julianday")
    return made([e], _micros(c) / DAY + 2440587.5, "float8")


def unixepoch(value: Any) -> Expr:
    e, c = _moment(value, "unixepoch")
    return made([e], F.floor(_micros(c) / 1_000_000).cast("bigint"), "int8")


def date_trunc(unit: str, value: Any) -> Expr:
    e = expr(value)
    require(e, MOMENTS, "date_trunc")
    c = F.date_trunc(unit, e.column)
    return made([e], c.cast("timestamp_ntz") if e.type != "timestamptz" else c, "timestamptz" if e.type == "timestamptz" else "timestamp")


def extract(field: str, value: Any) -> Expr:
    e = expr(value)
    require(e, MOMENTS, "extract")
    c = e.column
    special = {
        "dow": lambda: F.dayofweek(c) - 1,
        "isodow": lambda: F.weekday(c) + 1,
        "epoch": lambda: _micros(c) / 1_000_000,
        "millisecond": lambda: F.date_part(F.lit("SECOND"), c) * 1000,
        "microsecond": lambda: F.date_part(F.lit("SECOND"), c) * 1_000_000,
        "decade": lambda: F.floor(F.year(c) / 10),
        "century": lambda: F.ceil(F.year(c) / 100),
        "isoyear": lambda: F.date_part(F.lit("YEAROFWEEK"), c),
    }
    got = special[field]() if field in special else F.date_part(F.lit(field), c)
    return made([e], got.cast("double"), "float8")


def age(later: Any, earlier: Any) -> Expr:
    """Months, days and microseconds between two moments, as a struct."""
    a, x = _moment(later, "age")
    b, y = _moment(earlier, "age")
    swap = x < y
    hi, lo = F.greatest(x, y), F.least(x, y)
    whole = F.floor(F.months_between(hi.cast("timestamp"), lo.cast("timestamp"), False)).cast("int")
    rest = _micros(hi) - _micros(_plus_months(lo, whole))
    # months_between takes last days of months as whole months; a symbolic age doesn't.
    months = F.when(rest < 0, whole - 1).otherwise(whole)
    rest = _micros(hi) - _micros(_plus_months(lo, months))
    s = F.when(swap, F.lit(-1)).otherwise(F.lit(1))
    return made([a, b], F.struct((s * months).cast("int").alias("months"), (s * F.floor(rest / DAY)).cast("int").alias("days"), (s * (rest % DAY)).cast("bigint").alias("micros")), "interval")


def _plus_months(c: Column, months: Column) -> Column:
    day = F.add_months(c.cast("date"), months)
    return F.timestamp_micros(_micros(day) + _micros(c) % DAY).cast("timestamp_ntz")


def _java(pattern: str) -> str:
    words = re.compile("|".join(TO_CHAR))
    out, at = "", 0
    for m in words.finditer(pattern):
        out += _quoted(pattern[at : m.start()]) + TO_CHAR[m.group()]
        at = m.end()
    return out + _quoted(pattern[at:])


def to_char(value: Any, pattern: str) -> Expr:
    e, c = _moment(value, "to_char")
    return made([e], F.date_format(c, _java(pattern)), "text")


def to_timestamp(seconds: Any) -> Expr:
    e = expr(seconds)
    require(e, NUMBERS, "to_timestamp")
    return made([e], F.timestamp_seconds(e.column), "timestamptz")


def to_date(value: Any, pattern: str) -> Expr:
    e = expr(value)
    require(e, TEXTS, "to_date")
    return made([e], F.to_date(e.column, _java(pattern)), "date")


def to_number(value: Any, pattern: str) -> Expr:
    """9, 0, G (,), D (.) and S patterns."""
    e = expr(value)
    require(e, TEXTS, "to_number")
    return made([e], F.to_number(F.trim(e.column), F.lit(pattern)).cast("decimal(38,18)"), "numeric")


def date_bin(stride: str, value: Any, origin: Any) -> Expr:
    """The start of the stride ('15 minutes', counted from origin) that value lies in."""
    e, c = _moment(value, "date_bin")
    o, from_ = _moment(origin, "date_bin")
    n, unit = re.fullmatch(r"(\d+)\s*(second|minute|hour|day|week)s?", stride).groups()
    width = int(n) * {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": DAY, "week": 7 * DAY}[unit]
    start = _micros(c) - F.pmod(_micros(c) - _micros(from_), F.lit(width))
    return made([e, o], F.timestamp_micros(start).cast("timestamp_ntz"), "timestamp")


def _whole(values: tuple, what: str) -> list[Expr]:
    items = [expr(v) for v in values]
    for i in items:
        require(i, INTEGERS, what)
    return items


def make_date(year: Any, month: Any, day: Any) -> Expr:
    items = _whole((year, month, day), "make_date")
    return made(items, F.make_date(*[i.column for i in items]), "date")


def make_timestamp(year: Any, month: Any, day: Any, hour: Any, minute: Any, second: Any) -> Expr:
    items = [*_whole((year, month, day, hour, minute), "make_timestamp"), expr(second)]
    require(items[-1], NUMBERS, "make_timestamp")
    return made(items, F.make_timestamp_ntz(*[i.column for i in items[:-1]], items[-1].column.cast("decimal(16,6)")), "timestamp")


def timediff(a: Any, b: Any) -> Expr:
    """SQLite's signed difference: +YYYY-MM-DD HH:MM:SS.SSS."""
    gap = age(a, b)
    g = gap.column
    months, days, micros = F.abs(g["months"]), F.abs(g["days"]), F.abs(g["micros"])
    sign = F.when((g["months"] < 0) | (g["days"] < 0) | (g["micros"] < 0), F.lit("-")).otherwise(F.lit("+"))
    text = F.format_string("%s%04d-%02d-%02d %02d:%02d:%06.3f", sign, (months / 12).cast("int"), months % 12, days, (micros / 3_600_000_000).cast("int"), ((micros / 60_000_000) % 60).cast("int"), (micros % 60_000_000) / 1_000_000.0)
    return made([gap], F.when(g["months"].isNotNull(), text), "text")


def moment(text: str) -> Expr:
    """A timestamp literal."""
    return literal(datetime.fromisoformat(text))



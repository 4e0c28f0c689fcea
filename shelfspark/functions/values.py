"""Score, date and number expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# List status -> implicit rating.
STATUS_WEIGHT = {"completed": 1.0, "watching": 0.7, "plan_to_watch": 0.2, "on_hold": 0.3, "dropped": 0.0}
# Three-point smiley score -> ten-point score.
POINT_3 = {1: 3, 2: 6, 3: 10}
SEASONS = ["winter", "spring", "summer", "fall"]


def try_int(c: Column) -> Column:
    """Text to int; empty or malformed text becomes null."""
    return F.nullif(F.trim(c), F.lit("")).try_cast("int")


def try_double(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit("")).try_cast("double")


def normalize_score(score: Column, fmt: Column) -> Column:
    """Any list score format to an int 1..10; 0, null and out-of-range become null.

    Halves round to even, so 85 of 100 is 8.
    """
    s = score.cast("double")
    three = F.create_map(*[F.lit(x) for kv in POINT_3.items() for x in kv])
    value = (
        F.when(fmt == "POINT_100", F.bround(s / 10, 0))
        .when(fmt == "POINT_10_DECIMAL", F.bround(s, 0))
        .when(fmt == "POINT_5", F.floor(s * 2))
        .when(fmt == "POINT_3", F.try_element_at(three, s.cast("int")))
        .otherwise(F.floor(s))
        .cast("int")
    )
    return F.when((s != 0) & value.between(1, 10), value)


def partial_date(date: Column, fallback: Column) -> Column:
    """struct(year, month, day) with gaps to a date: missing parts are 1, no year is ``fallback``."""

    def part(name: str) -> Column:
        c = date[name]
        return F.when(c.isNull() | (c == 0), F.lit(1)).otherwise(c)

    no_year = date.isNull() | date["year"].isNull() | (date["year"] == 0)
    return F.when(no_year, fallback).otherwise(F.make_date(date["year"], part("month"), part("day")))


def status_rating(status: Column, score: Column) -> Column:
    """Explicit score / 10, else the weight of the status; an unknown status is 0."""
    weight = F.create_map(*[F.lit(x) for kv in STATUS_WEIGHT.items() for x in kv])
    implied = F.coalesce(F.try_element_at(weight, status), F.lit(0.0))
    return F.when(score.isNotNull() & (score != 0), score.cast("double") / 10).otherwise(implied)


def season_name(date: Column) -> Column:
    """Calendar quarter as a season."""
    return F.element_at(F.array(*[F.lit(s) for s in SEASONS]), F.quarter(date))


def season_window(date: Column, n: int = 3) -> Column:
    """array<struct<year, season>>: the season of ``date`` and the n-1 after it."""
    start = F.trunc(date, "quarter")
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.struct(
            F.year(F.add_months(start, i * 3)).alias("year"), season_name(F.add_months(start, i * 3)).alias("season")
        ),
    )


def seconds_between(later: Column, earlier: Column) -> Column:
    """Difference in seconds, with microseconds."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def unit(a: Column) -> Column:
    """L2-normalised vector; a zero vector stays zero."""
    n = l2_norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def min_max(x: Column, low: Column, high: Column, eps: float = 1e-9) -> Column:
    return (x - low) / (high - low + F.lit(eps))

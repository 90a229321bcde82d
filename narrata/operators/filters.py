"""Filters and predicates: metadata filters, reader progress, status sets, ages."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stage states that end a stage, and those that let its children start.
TERMINAL = ("COMPLETED", "SKIPPED", "FAILED")
SATISFYING = ("COMPLETED", "SKIPPED")
UNBOUNDED_CHAPTER = 999_999


@dataclass(frozen=True)
class Filters:
    """Equality filters; a lower level without its upper level is dropped, blanks are unset."""

    universe: str | None = None
    series: str | None = None
    book_number: int | None = None
    chapter_number: int | None = None

    def resolved(self) -> Filters:
        universe = (self.universe or "").strip() or None
        series = ((self.series or "").strip() or None) if universe else None
        book = self.book_number if series else None
        return Filters(universe, series, book, self.chapter_number if book is not None else None)


def apply_filters(df: DataFrame, filters: Filters) -> DataFrame:
    for name in ("universe", "series", "book_number", "chapter_number"):
        value = getattr(filters, name)
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


@dataclass(frozen=True)
class SeriesProgress:
    series: str | None
    book: int
    chapter: int | None = None


@dataclass(frozen=True)
class Visibility:
    """How far a reader has read in a universe; `policy` says what happens to series that aren't listed."""

    universe: str
    progress: tuple[SeriesProgress, ...] = field(default_factory=tuple)
    policy: str = "HIDE"


def visible(v: Visibility | None) -> Column:
    """True for rows (universe, series, book_number, chapter_number) that the reader may see.

    A row without a universe (no chapter) is seen only if there is no progress to compare with.
    """
    if v is None or not v.progress:
        return F.lit(True)
    if v.policy not in ("HIDE", "SHOW"):
        raise ValueError(f"unknown policy {v.policy}")
    same_universe = F.col("universe") == v.universe
    read, listed = [], []
    for p in v.progress:
        same = same_universe & F.col("series").eqNullSafe(F.lit(p.series))
        limit = p.chapter if p.chapter is not None else UNBOUNDED_CHAPTER
        read.append(same & ((F.col("book_number") < p.book) | ((F.col("book_number") == p.book) & (F.col("chapter_number") <= limit))))
        listed.append(same)
    out = reduce(Column.__or__, read)
    if v.policy == "SHOW":
        out = out | (F.col("universe").isNotNull() & ~reduce(Column.__or__, listed))
    return F.coalesce(out, F.lit(False))


def unembedded(df: DataFrame) -> DataFrame:
    return df.filter(F.col("embedding").isNull() | F.col("embedding_hash").isNull())


def stale(df: DataFrame, expected: Column) -> DataFrame:
    return df.filter(F.col("embedding").isNotNull() & (F.col("embedding_hash") != expected))


def older(c: Column, as_of: Column, seconds: int) -> Column:
    return c < as_of - F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))


def check_request(top_k: int, threshold: float = 0.0, limit: int = 20, offset: int = 0, most: int = 50) -> None:
    """Bounds of request parameters."""
    if not 1 <= top_k <= most or not 0 <= threshold <= 1 or not 1 <= limit <= 100 or offset < 0:
        raise ValueError("a parameter is out of bounds")

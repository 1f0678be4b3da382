"""Score, severity and grade of a function."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def crap(cc: Column, coverage: Column) -> Column:
    """cc^2 (1 - coverage/100)^3 + cc, coverage held in 0..100; products, so that results are the same bit by bit."""
    held = F.when(coverage.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), coverage)))  # null stays null
    u = F.lit(1.0) - held / F.lit(100.0)
    return cc * cc * (u * u * u) + cc


def severity(score: Column, threshold: float) -> Column:
    return F.when(score > threshold, "crappy").otherwise("clean")


def grade(score: Column, threshold: float) -> Column:
    return F.when(score > threshold, "high").when(score > threshold / 3, "moderate").otherwise("low")


def assumed(coverage: Column, policy: str) -> Column:
    """Coverage to score with: null counts as 0 (pessimistic) or 100 (optimistic); skip leaves it null."""
    return {"pessimistic": F.coalesce(coverage, F.lit(0.0)), "optimistic": F.coalesce(coverage, F.lit(100.0)), "skip": coverage}[policy]

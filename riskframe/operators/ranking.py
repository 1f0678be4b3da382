"""Limits, orders, rollups and gates over scored entries (file, name, line, ord, crate, crap)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top(entries: DataFrame, n: int | None = None, least: float | None = None) -> DataFrame:
    """The n first by score (ties by ord), then those of at least `least`."""
    out = entries.orderBy(F.desc("crap"), "ord").limit(n) if n is not None else entries
    return out.filter(F.col("crap") >= least) if least is not None else out


def capped(entries: DataFrame, threshold: float, others: int = 10) -> DataFrame:
    """All entries over the threshold and the worst `others` of the rest."""
    rest = entries.filter(F.col("crap") <= threshold).orderBy(F.desc("crap"), "file", "name", "line", "ord").limit(others)
    return entries.filter(F.col("crap") > threshold).unionByName(rest)


def ordered(entries: DataFrame, by: str = "crap") -> DataFrame:
    """By score, the highest first, or by file, name and line; ties keep the order of the input (ord)."""
    if by not in ("crap", "file"):
        raise ValueError(f"unknown order {by!r}")
    return entries.orderBy(F.desc("crap"), "ord") if by == "crap" else entries.orderBy(F.replace("file", F.lit("\\"), F.lit("/")), "name", "line", "ord")


def pinned(delta: DataFrame, threshold: float, others: int = 10) -> DataFrame:
    """Rows for a reader: all over the threshold, all that regressed, and the worst `others` of the rest, in the order of the input."""
    must = (F.col("crap") > threshold) | (F.col("status") == "regressed")
    rest = delta.filter(~must).orderBy(F.desc("crap"), "file", "name", "line", "ord").limit(others)
    return delta.filter(must).unionByName(rest).orderBy("ord")


def per_bucket(rows: DataFrame, bucket: str, order: list, n: int) -> DataFrame:
    """The first n rows of each bucket, with the number of rows left out. A count and a bounded top-n, so no bucket is sorted whole."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(bucket).orderBy(*order))).filter(F.col("rank") <= n)
    left = rows.groupBy(bucket).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("left_out"))
    return ranked.join(left, bucket)


def rollup(entries: DataFrame, threshold: float) -> DataFrame:
    return entries.filter("crate IS NOT NULL").groupBy("crate").agg(F.count("*").alias("total"), F.count_if(F.col("crap") > threshold).alias("crappy"))


def summary(entries: DataFrame, threshold: float, by: str = "crap") -> DataFrame:
    """One row: totals, the first entry in the active order, gate and badge colour."""
    place = F.struct(-F.col("crap"), "ord") if by == "crap" else F.struct(F.replace("file", F.lit("\\"), F.lit("/")), "name", "line", "ord")
    worst = F.min_by(F.struct("crap", "file", "name"), place)
    out = entries.agg(F.count("*").alias("total"), F.count_if(F.col("crap") > threshold).alias("crappy"), worst.alias("w"))
    colour = F.when(F.col("crappy") == 0, "brightgreen").when(F.col("crappy") <= 5, "yellow").otherwise("red")
    return out.select("total", "crappy", F.col("w.file").alias("worst_file"), F.col("w.name").alias("worst_name"), F.col("w.crap").alias("worst_crap"), F.when(F.col("crappy") > 0, 1).otherwise(0).alias("exit_code"), colour.alias("colour"))

"""Spans of functions against coverage lines."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def span_coverage(functions: DataFrame, lines: DataFrame) -> DataFrame:
    """functions(ord, path, start_line, end_line, ...) with coverage: covered / executable lines inside the span in per cent, 100 without executable lines, null where the path has no coverage at all. The path is an equi key, the range a residual condition; paths are told apart by an aggregate before the join."""
    f, c = functions.alias("f"), lines.alias("c")
    inside = (F.col("f.path") == F.col("c.path")) & F.col("c.line").between(F.col("f.start_line"), F.col("f.end_line"))
    counted = f.join(c, inside).groupBy("f.ord").agg(F.count("*").alias("executable"), F.count_if(F.col("c.hits") > 0).alias("covered"))
    known = lines.select("path").distinct().withColumn("matched", F.lit(True))
    out = functions.join(counted, "ord", "left").join(known, "path", "left")
    pct = F.coalesce(F.col("covered").cast("double") / F.col("executable") * 100.0, F.lit(100.0))
    return out.withColumn("coverage", F.when(F.col("matched"), pct)).drop("executable", "covered", "matched")


def uncovered_ranges(functions: DataFrame, lines: DataFrame) -> DataFrame:
    """ord, first, last of maximal uncovered runs in each span: only a covered line ends a run."""
    f, c = functions.alias("f"), lines.alias("c")
    inside = (F.col("f.path") == F.col("c.path")) & F.col("c.line").between(F.col("f.start_line"), F.col("f.end_line"))
    rows = f.join(c, inside).select("f.ord", "c.line", "c.hits")
    before = Window.partitionBy("ord").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    island = rows.withColumn("island", F.count_if(F.col("hits") > 0).over(before)).filter("hits = 0")
    return island.groupBy("ord", "island").agg(F.min("line").alias("first"), F.max("line").alias("last")).drop("island")


def scope(functions: DataFrame, lines: DataFrame, examples: int = 10) -> DataFrame:
    """One row: files analysed, files with coverage, matched ones, and those on one side only, with the first few of either by name. A run without any coverage line has no diagnostics: see scope.scope_warning."""
    a, b = functions.select("path").distinct(), lines.select("path").distinct()
    kinds = a.withColumn("s", F.lit(1)).unionByName(b.withColumn("s", F.lit(2))).groupBy("path").agg(F.sum("s").alias("s"))
    total = kinds.agg(F.count_if(F.col("s") != 2).alias("analysed"), F.count_if(F.col("s") != 1).alias("reported"), F.count_if(F.col("s") == 3).alias("matched"), F.count_if(F.col("s") == 1).alias("source_only"), F.count_if(F.col("s") == 2).alias("report_only"))
    some = lambda s, name: kinds.filter(F.col("s") == s).orderBy("path").limit(examples).agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias(name))
    return total.join(some(1, "examples")).join(some(2, "report_examples"))

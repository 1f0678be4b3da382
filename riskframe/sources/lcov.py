"""Coverage reports in LCOV's text form."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reports(spark, path: str) -> DataFrame:
    """report, text of each file: the order of lines counts, so a report is read whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("report"), F.col("value").alias("text"))


def records(texts: DataFrame) -> DataFrame:
    """report, path, lines (its DA fields) of each record of reports(report, text). Nothing crosses a record's end, so a report is split there first and records are read apart."""
    parts = texts.select("report", F.explode(F.split("text", r"(?m)^\s*end_of_record\s*$")).alias("body"))
    lines = F.transform(F.split("body", "\r?\n"), lambda x: F.trim(x))
    rows = parts.select("report", lines.alias("raw"))
    # an SF inside a record starts another file: every file's fields run to the next SF
    marks = F.filter(F.transform("raw", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda m: m["x"].startswith("SF:"))
    rows = rows.select("report", "raw", marks.alias("marks")).select("report", "raw", "marks", F.posexplode("marks").alias("k", "mark"))
    end = F.coalesce(F.get(F.col("marks"), F.col("k") + 1)["i"], F.size("raw"))
    body = F.slice("raw", F.col("mark.i") + 2, F.greatest(end - F.col("mark.i") - 1, F.lit(0)))
    return rows.select("report", F.substring("mark.x", 4, 1 << 30).alias("path"), F.filter(body, lambda x: x.startswith("DA:")).alias("lines")).filter("path <> ''")


def files(texts: DataFrame) -> DataFrame:
    """report, path of every file that a report names, also one without lines."""
    return records(texts).select("report", "path").distinct()


def parsed(texts: DataFrame) -> DataFrame:
    """report, path, line, hits of reports(report, text). Hits of a repeated line add up; lines outside a record are dropped; unknown records are skipped; a malformed DA raises an error."""
    rows = records(texts).select("report", "path", F.explode("lines").alias("raw"))
    fields = F.split(F.substring("raw", 4, 1 << 30), ",")
    number: Column = F.get(fields, F.lit(0)).cast("int")
    return rows.groupBy("report", "path", number.alias("line")).agg(F.sum(F.get(fields, F.lit(1)).cast("decimal(20,0)")).alias("hits"))


#: What must be equal for a cached row to count, besides path, length and hash.
HEADER = ("format", "version", "program", "weight")


def incremental(files: DataFrame, cache: DataFrame, header: dict | None = None) -> DataFrame:
    """Files to parse anew: those without a cache row of the same path, length and hash, written under the same header (where one is given)."""
    for name in HEADER if header else ():
        cache = cache.filter(F.col(name).eqNullSafe(F.lit(header[name])))
    return files.join(cache, ["path", "length", "hash"], "left_anti")


def evicted(cache: DataFrame, walked: list[str], kept: list[str]) -> DataFrame:
    """Cache rows that stay after the roots in `walked` were read anew: the deepest root over a path decides, a tie is walked."""
    roots = sorted([(r, True) for r in walked] + [(r, False) for r in kept], key=lambda r: (len(r[0].split("/")), r[1]))
    walked_by = F.lit(False)
    for root, again in roots:
        walked_by = F.when((F.col("path") == root) | F.col("path").startswith(f"{root}/"), F.lit(again)).otherwise(walked_by)
    return cache.filter(~walked_by)

"""Path matching: longest suffix, longest prefix, globs."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def suffix_join(queries: DataFrame, needles: DataFrame) -> DataFrame:
    """queries(id, path) with needle: the longest needle that is a component suffix of the path. Each path's suffixes are exploded, so this is an equi-join; the longest is a max, so nothing is sorted."""
    q = queries.select("id", F.explode(paths.suffixes(F.col("path"))).alias("needle"))
    n = needles.select(F.array_join(paths.parts(F.col("needle")), "/").alias("needle")).filter("needle <> ''").distinct()
    best = q.join(n, "needle").groupBy("id").agg(F.max(F.struct(F.size(paths.parts(F.col("needle"))).alias("k"), "needle"))["needle"].alias("needle"))
    return queries.join(best, "id", "left")


def path_index(lines: DataFrame, canonical: DataFrame) -> DataFrame:
    """tier, key, line, hits of coverage lines(path, line, hits). canonical(path, canon) names the paths that could be resolved: they are the exact tier; all others are keyed by their components (suffix tier). Hits of spellings with one key add up; a path without components is left out."""
    norm = F.array_join(paths.parts(F.col("path")), "/")
    keyed = lines.join(canonical, "path", "left").select(F.when(F.col("canon").isNotNull(), "exact").otherwise("suffix").alias("tier"), F.coalesce("canon", norm).alias("key"), "line", "hits")
    return keyed.filter("key <> ''").groupBy("tier", "key", "line").agg(F.sum("hits").alias("hits"))


def resolved_paths(queries: DataFrame, index: DataFrame) -> DataFrame:
    """queries(id, path, canon) with tier and key: the exact tier's key equal to canon first, else the longest suffix of the path."""
    keys = index.select("tier", "key").distinct()
    exact = queries.join(keys.filter("tier = 'exact'").select(F.col("key").alias("canon"), F.col("key").alias("exact_key")), "canon", "left").select("id", "path", "exact_key")
    tail = suffix_join(queries.select("id", "path"), keys.filter("tier = 'suffix'").select(F.col("key").alias("needle"))).select("id", "needle")
    out = exact.join(tail, "id")
    tier = F.when(F.col("exact_key").isNotNull(), "exact").when(F.col("needle").isNotNull(), "suffix")
    return out.select("id", "path", tier.alias("tier"), F.coalesce("exact_key", "needle").alias("key"))


def prefix_join(queries: DataFrame, roots: DataFrame) -> DataFrame:
    """queries(id, path) with crate: that of the longest root (crate, root) that is a component prefix of the path."""
    p = paths.parts(F.col("path"))
    q = queries.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1))), lambda i: F.array_join(F.slice(p, 1, i), "/"))).alias("root"))
    best = q.join(roots, "root").groupBy("id").agg(F.max(F.struct(F.length("root").alias("k"), "crate"))["crate"].alias("crate"))
    return queries.join(best, "id", "left")


def matched_glob(path: Column, globs: list[str]) -> Column:
    """The first glob that a path matches, or null."""
    return F.coalesce(*[F.when(path.rlike(paths.glob_regex(g)), F.lit(g)) for g in globs], F.lit(None).cast("string"))


def allowed(path: Column, name: Column, globs: list[str]) -> Column:
    """Whether an allow list has an entry for it: globs with a slash or ** are tried on every suffix of the path, others on the name, where * crosses ::."""
    tests = []
    for g in globs:
        if "/" in g or "**" in g:
            tests.append(path.rlike(f"(^|/){paths.glob_regex(g)[1:]}"))
        else:
            tests.append(name.rlike("^" + ".*".join(paths.re.escape(x) for x in g.split("*")) + "$"))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def unmatched_globs(rows: DataFrame, column: str, globs: list[str]) -> DataFrame:
    """Globs that match no row: one aggregate over the rows."""
    found = rows.agg(*[F.coalesce(F.bool_or(F.col(column).rlike(paths.glob_regex(g))), F.lit(False)).alias(f"g{i}") for i, g in enumerate(globs)])
    return found.select(F.explode(F.array(*[F.struct(F.lit(g).alias("glob"), F.col(f"g{i}").alias("hit")) for i, g in enumerate(globs)])).alias("x")).filter("NOT x.hit").select("x.glob")



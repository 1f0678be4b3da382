"""Which files a run covers: excludes with their bases, recorded files, workspace members."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

#: What is left out when nothing is configured.
DEFAULT_EXCLUDES = ("tests/**", "benches/**", "examples/**")


def exclude_globs(flag: list[str] | None, configured: list[str] | None, extra: list[str], no_defaults: bool = False) -> list[str]:
    """The globs that hold: defaults, which a configured list replaces and a flag empties; `extra` and those of the command line are added."""
    base = [] if no_defaults else list(DEFAULT_EXCLUDES if configured is None else configured)
    return list(dict.fromkeys([*base, *extra, *(flag or [])]))


def excluded_by(below_root: Column, below_workspace: Column, member_globs: list[str], user_globs: list[str]) -> Column:
    """The first glob that leaves a file out, or null. Member globs are tried below the walked root only, user globs below it or the workspace's root."""
    tests = [F.when(below_root.rlike(paths.glob_regex(g)), F.lit(g)) for g in member_globs]
    tests += [F.when(below_root.rlike(paths.glob_regex(g)) | below_workspace.rlike(paths.glob_regex(g)), F.lit(g)) for g in user_globs]
    return F.coalesce(*tests, F.lit(None).cast("string"))


def below_deepest(file: Column, roots: list[str]) -> Column:
    """The file below the deepest root that holds it; whole where none does."""
    out = file
    for root in sorted(roots, key=lambda r: len([x for x in r.split("/") if x])):
        start = root.rstrip("/") + "/"
        out = F.when(file.startswith(start), F.substring(file, len(start) + 1, 1 << 30)).otherwise(out)
    return out


def baseline_kept(baseline: DataFrame, roots: list[str], globs: list[str], allowed: Column) -> DataFrame:
    """Recorded rows that this run's excludes and allow list would have left: the same tests, before the comparison."""
    hit = reduce(lambda a, b: a | b, [below_deepest(F.col("file"), roots).rlike(paths.glob_regex(g)) for g in globs], F.lit(False))
    return baseline.filter(~hit & ~allowed)


def member_scope(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The rows(id, file, ...) that belong to a selected member(name, dir, selected).

    The owner is the member with the deepest directory over the file. A file under none is claimed by the longest
    directory that is a run of its components; of several as long, one selected is enough. The root package (no
    directory) claims nothing that way. Prefixes and runs are exploded, so both are equi-joins.
    """
    p = paths.parts(F.col("file"))
    top = lambda c: F.when(F.replace(c, F.lit("\\"), F.lit("/")).startswith("/"), "/").otherwise("")
    d = paths.parts(F.col("dir"))
    sized = members.select(F.array_join(d, "/").alias("dir"), F.concat(top(F.col("dir")), F.array_join(d, "/")).alias("whole"), F.size(d).alias("k"), "selected")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(p)), lambda i: F.concat(top(F.col("file")), F.array_join(F.slice(p, 1, i), "/")))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.transform(F.sequence(F.lit(1), F.size(p) - i + 1), lambda n: F.array_join(F.slice(p, i, n), "/"))))

    def best(keys: Column, owners: DataFrame) -> DataFrame:
        owners = owners.groupBy("key", "k").agg(F.bool_or("selected").alias("selected"))
        found = rows.filter(F.size(p) > 0).select("id", F.explode(F.array_distinct(keys)).alias("key")).join(owners, "key")
        return found.groupBy("id").agg(F.max(F.struct("k", "selected")).alias("x")).select("id", F.col("x.selected").alias("kept"))

    own = best(prefixes, sized.withColumnRenamed("whole", "key")).withColumnRenamed("kept", "own")
    run = best(runs, sized.filter("k > 0").select(F.col("dir").alias("key"), "k", "selected")).withColumnRenamed("kept", "run")
    return rows.join(own, "id", "left").join(run, "id", "left").filter(F.coalesce("own", "run", F.lit(False))).drop("own", "run")


def select_packages(found: list[str], asked: list[str]) -> list[str]:
    """The asked packages in the order of discovery, each once; an unknown one is an error."""
    if unknown := sorted(set(asked) - set(found)):
        raise ValueError(f"no such package: {', '.join(unknown)}")
    return [x for x in dict.fromkeys(found) if x in set(asked)]


def nested_excludes(members: DataFrame) -> DataFrame:
    """name, glob: for each member(name, dir) a glob of every other member's directory below its own."""
    p = paths.parts(F.col("dir"))
    above = F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.struct(F.array_join(F.slice(p, 1, i), "/").alias("over"), F.array_join(F.slice(p, i + 1, F.size(p)), "/").alias("rest")))
    inner = members.filter(F.size(p) > 0).select(F.explode(above).alias("x")).select("x.over", "x.rest")
    return inner.join(members.select("name", F.array_join(p, "/").alias("over")), "over").select("name", F.concat("rest", F.lit("/**")).alias("glob")).distinct()


def scope_warning(row) -> str | None:
    """What to say about a row of coverage.scope(): nothing without strays or without a report."""
    if not row["reported"] or not (row["source_only"] or row["report_only"]):
        return None
    if not row["matched"]:
        return "no source file matches the coverage report; are the paths relative to another folder?"
    if 2 * row["matched"] < row["analysed"]:
        return f"only {row['matched']} of {row['analysed']} source files match the coverage report"
    return f"{row['source_only']} source files without coverage, {row['report_only']} reported files without source"

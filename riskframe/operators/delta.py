"""Comparison with a recorded baseline. Both sides: file, name, line, crap, ord."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions import paths


def classify(now: Column, before: Column, epsilon: float) -> Column:
    return F.when(now - before > epsilon, "regressed").when(before - now > epsilon, "improved").otherwise("unchanged")


def compare(current: DataFrame, baseline: DataFrame, epsilon: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """The current rows with status, baseline_crap and previous_file, and the removed baseline rows.

    First by (file, name, line), where the last baseline row of a key counts; then, among equal names, by the longest
    common path suffix where each is the other's only best; then by names left once on each side.
    """
    key = ["file", "name", "line"]
    b = baseline.select(F.col("file").alias("b_file"), F.col("name").alias("b_name"), F.col("line").alias("b_line"), F.col("crap").alias("b_crap"), F.col("ord").alias("b_ord"))
    last = b.groupBy("b_file", "b_name", "b_line").agg(F.max(F.struct("b_ord", "b_crap")).alias("x")).select("b_file", "b_name", "b_line", "x.b_crap")
    one = current.join(last, (F.col("file") == F.col("b_file")) & (F.col("name") == F.col("b_name")) & (F.col("line") == F.col("b_line")), "left")
    exact = one.filter("b_crap IS NOT NULL").select(*current.columns, F.col("b_crap").alias("baseline_crap"), F.lit(None).cast("string").alias("previous_file"), classify(F.col("crap"), F.col("b_crap"), epsilon).alias("status"))
    new = one.filter("b_crap IS NULL").select(*current.columns)
    left = b.join(current.select(*[F.col(c).alias(f"b_{c}") for c in key]).distinct(), [f"b_{c}" for c in key], "left_anti")

    new, left = shared.cut(new), shared.cut(left)
    suffix = shared.cut(suffix_pairs(new, left))
    suffix = new.join(suffix, "ord").select(*current.columns, "b_ord", F.col("b_crap").alias("baseline_crap"))
    second = suffix.select(*current.columns, "baseline_crap", F.lit(None).cast("string").alias("previous_file"), classify(F.col("crap"), F.col("baseline_crap"), epsilon).alias("status"))
    new, left = new.join(suffix.select("ord"), "ord", "left_anti"), left.join(suffix.select("b_ord"), "b_ord", "left_anti")

    once = new.groupBy("name").count().filter("count = 1").join(left.groupBy("b_name").count().withColumnRenamed("count", "c").filter("c = 1"), F.col("name") == F.col("b_name")).select("name")
    moved = new.join(once, "name", "left_semi").join(left, F.col("name") == F.col("b_name"))
    status = classify(F.col("crap"), F.col("b_crap"), epsilon)
    third = moved.select(*current.columns, F.col("b_crap").alias("baseline_crap"), F.col("b_file").alias("previous_file"), F.when(status == "unchanged", "moved").otherwise(status).alias("status"))
    new, left = new.join(once, "name", "left_anti"), left.join(once.withColumnRenamed("name", "b_name"), "b_name", "left_anti")
    rest = new.select(*current.columns, F.lit(None).cast("double").alias("baseline_crap"), F.lit(None).cast("string").alias("previous_file"), F.lit("new").alias("status"))
    return exact.unionByName(second).unionByName(third).unionByName(rest), left.select(F.col("b_file").alias("file"), F.col("b_name").alias("name"), F.col("b_line").alias("line"), F.col("b_crap").alias("baseline_crap"))


def suffix_pairs(new: DataFrame, left: DataFrame) -> DataFrame:
    """ord, b_ord, b_crap of rows with equal names whose files have the longest common tail, where each is the other's only best.

    Every file's tails are keys. A row's best key is the longest that the other side has; the other side's rows with it
    are its bests. So rows meet by key and number rows times path depth, however many share a name.
    """

    def keyed(rows: DataFrame, row: str, file: str, name: str) -> DataFrame:
        p = paths.parts(F.col(file))
        tails = F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.struct(i.alias("k"), F.array_join(F.slice(p, -i, i), "/").alias("tail")))
        out = rows.filter(F.size(p) > 0).select(F.col(row).alias("row"), F.col(name).alias("name"), F.explode(tails).alias("t"))
        return out.select("row", "name", "t.k", "t.tail")

    a, b = keyed(new, "ord", "file", "name"), keyed(left, "b_ord", "b_file", "b_name")
    count = lambda rows, as_name: rows.groupBy("name", "tail").agg(F.count("*").alias(as_name))
    shared_keys = shared.cut(count(a, "na").join(count(b, "nb"), ["name", "tail"]))
    best = lambda rows: rows.join(shared_keys, ["name", "tail"]).groupBy("row").agg(F.max(F.struct("k", "name", "tail", "na", "nb")).alias("x")).select("row", "x.name", "x.tail", "x.na", "x.nb")
    mine = best(a).filter("na = 1 AND nb = 1").select(F.col("row").alias("ord"), "name", "tail")
    theirs = best(b).filter("na = 1 AND nb = 1").select(F.col("row").alias("b_ord"), "name", "tail")
    return mine.join(theirs, ["name", "tail"]).join(left.select("b_ord", "b_crap"), "b_ord").select("ord", "b_ord", "b_crap")


def rebased(baseline: DataFrame, root: str) -> DataFrame:
    """Relative files of a recorded run joined to the workspace's root."""
    whole = F.col("file").startswith("/") | F.col("file").rlike(r"^[A-Za-z]:[\\\\/]")
    return baseline.withColumn("file", F.when(whole, F.col("file")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), "file")))


def changed_only(delta: DataFrame, show_unchanged: bool = False) -> DataFrame:
    return delta if show_unchanged else delta.filter("status <> 'unchanged'")


def mismatches(baseline: DataFrame, recorded_weight: float | None, weight: float, signals: list[str]) -> list[str]:
    """Warnings about a baseline that does not compare: another weight of a try (absent: 1), or no signals at all."""
    found = []
    if (1.0 if recorded_weight is None else recorded_weight) != weight:
        found.append(f"the baseline was recorded with try weight {1.0 if recorded_weight is None else recorded_weight:g}, this run has {weight:g}")
    if signals:
        row = baseline.agg(F.count("*").alias("n"), *[F.count(F.col(s)).alias(s) for s in signals]).first()
        if row["n"] and not any(row[s] for s in signals):
            found.append("the baseline has no signals; reasons other than the score are left out")
    return found


def counts(delta: DataFrame, removed: DataFrame) -> DataFrame:
    kinds = ("regressed", "improved", "new", "unchanged", "moved")
    return delta.agg(*[F.count_if(F.col("status") == k).alias(k) for k in kinds]).join(removed.agg(F.count("*").alias("removed")))


def restrict(delta: DataFrame, shown: DataFrame) -> DataFrame:
    """The rows of a whole comparison that a slice shows."""
    return delta.join(shown.select("file", "name", "line"), ["file", "name", "line"], "left_semi")


def reasons(rows: DataFrame, signals: list[str], limits: dict[str, int], gates: set[str]) -> DataFrame:
    """ord, rank, signal, value, baseline, gating of each reason: a regressed score first, then signals that rose, or of new rows exceed their limit. Baseline signals are <signal>_before; rows without any have none."""
    items = [F.struct(F.lit(0).alias("rank"), F.lit("crap").alias("signal"), F.lit(None).cast("long").alias("value"), F.lit(None).cast("long").alias("baseline"), F.lit(True).alias("gating"), (F.col("status") == "regressed").alias("holds"))]
    for i, s in enumerate(signals, 1):
        now, before, fresh = F.col(s), F.col(f"{s}_before"), F.col("status") == "new"
        holds = F.when(fresh, now > limits.get(s, 0)).otherwise(F.coalesce(now > before, F.lit(False)))
        gating = F.when(fresh & F.lit(s in limits), F.lit(True)).otherwise(F.lit(s in gates))
        items.append(F.struct(F.lit(i).alias("rank"), F.lit(s).alias("signal"), now.cast("long").alias("value"), before.cast("long").alias("baseline"), gating.alias("gating"), holds.alias("holds")))
    return rows.select("ord", F.explode(F.array(*items)).alias("x")).filter("x.holds").select("ord", "x.rank", "x.signal", "x.value", "x.baseline", "x.gating")



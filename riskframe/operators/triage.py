"""Advisory triage: what to ask, within a budget, and what to make of the answers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def question_key(first: Column, second: Column, model: str, provider: str, version: int) -> Column:
    """The cache key of a pair of bodies under a model, provider and set of questions."""
    return cache_key(first, second, F.lit(model), F.lit(provider), F.lit(str(version)))


def cache_key(*columns: Column) -> Column:
    """A digest of values, each with its length before it, so that no two lists of values give one text."""
    return F.sha2(F.concat(*[F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in columns]), 256)


def plan(asks: DataFrame, cache: DataFrame, budget: int) -> DataFrame:
    """asks(key, ord) with hit and asked: the first `budget` misses by ord are asked. Only a bounded top-n is sorted."""
    known = cache.select("key").distinct().withColumn("hit", F.lit(True))
    rows = asks.join(known, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    first = rows.filter("NOT hit").orderBy("ord").limit(budget).select("ord", F.lit(True).alias("asked"))
    return rows.join(F.broadcast(first), "ord", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))


def validated(value: Column, low: float, high: float, slack: float = 1e-9) -> Column:
    """value held in [low, high] if it is out by no more than slack; else null."""
    ok = value.between(low - slack, high + slack) & ~F.isnan(value)
    return F.when(ok, F.greatest(F.lit(low), F.least(F.lit(high), value)))


def verdict(kind: Column, confidence: Column, floor: float) -> Column:
    return F.when(confidence < floor, "uncertain").otherwise(kind)


def level(worth: Column) -> Column:
    """Half away from zero."""
    return F.round(worth).cast("long")


def ask_set(groups: DataFrame, compared: bool) -> DataFrame:
    """Groups(grp, status) to ask about: all of them, or in a comparison the new and grown ones."""
    return groups.filter(F.col("status").isin("new", "grown")) if compared else groups


#: Kinds of a verdict, the most urgent first.
KINDS = ("same_logic", "shared_shape", "coincidence", "uncertain")


def tally(verdicts: DataFrame, kinds: tuple = KINDS) -> DataFrame:
    """kind, level, n of verdicts(kind, worth), the most urgent first: by kind, then by level downwards."""
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    out = verdicts.groupBy("kind", level(F.col("worth")).alias("level")).agg(F.count("*").alias("n"))
    return out.orderBy(F.when(rank == 0, len(kinds) + 1).otherwise(rank), F.desc_nulls_last("level"))


class Stub:
    """A provider that answers without a network: by a function of the question."""

    name, model = "stub", "none"

    def __init__(self, answer):
        self.answer = answer

    def ask(self, questions: dict) -> dict:
        return {k: self.answer(q) for k, q in questions.items()}


def answered(provider, questions: list[dict], threads: int = 8, attempts: int = 3, pause: float = 0.5, longest: float = 10.0, sleep=None) -> list[dict | None]:
    """A provider's answers to at most a budget's questions, in their order; None where all attempts failed. Asked from the driver, as a retried task would ask (and pay) twice. An error with `retry` false is not tried again; `after` of an error, held to `longest` seconds, replaces the doubled pause."""
    import time
    from concurrent.futures import ThreadPoolExecutor

    sleep = sleep or time.sleep

    def one(question: dict) -> dict | None:
        for k in range(attempts):
            try:
                got = provider.ask(question)
                return got if set(got) == set(question) else None  # all or nothing
            except Exception as e:  # noqa: BLE001 - a provider may raise anything
                if not getattr(e, "retry", True) or k + 1 == attempts:
                    return None
                after = getattr(e, "after", None)
                sleep(pause * 2**k if after is None else min(after, longest))
        return None

    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(one, questions))

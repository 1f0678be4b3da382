"""Document fingerprints by I-Match with randomised lexicon subsets (operator 1, DataFrame functions only).

Terms are the lower-cased runs of letters and digits. The lexicon holds the terms that at least `low` and at most `high`
of the documents contain, a band of inverse document frequency. The documents of each 64-bit term hash are counted,
so membership is exact but for equal hashes. A text has some hundred terms, so in a large corpus at most that number divided
by `low` are in the band, whatever its size; the lexicon is sent as sorted hashes in buckets by their low bits.

A document's in-band terms are made distinct and sorted. Their hash is the classical signature. Besides it there is one for
each of a fixed set of randomised lexicon subsets, the same for every document: seed f draws for each term a number, and
the subset of rate 1/m has the terms whose number is a multiple of m. A signature is the hash of all of the document's
terms in the subset, sorted; a document without any has none there. Dense subsets tell whether texts are almost equal,
sparse ones still agree where many terms differ. The likeness of two fingerprints is the share of equal ones among the
signatures that either has. Documents without in-band terms use all their terms, those without terms their text.

Defined results. Null text: empty. Null doc_id: sorted first; equal doc_ids are ordered by text. A single document is its
own next one. Repeated rows: a row each. Long texts: whole. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Seeds, the rates of each seed's subsets (one in so many terms; each divides the next), hexadecimal digits of a signature.
SEEDS, RATES, DIGITS = 16, (16, 64, 128, 256), 6
SIGNATURES = 1 + SEEDS * len(RATES)
NONE = "-" * DIGITS


def term_hashes(text: Column) -> Column:
    """The distinct 64-bit hashes of the terms of a text."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""), lambda t: F.xxhash64(t)))


def lexicon(docs: DataFrame, low: float, high: float) -> tuple[list[int], list[int]]:
    """The hashes of the terms in the band, by bucket, and where each bucket starts (one more number than buckets, a power of two)."""
    count = docs.count()
    found = docs.select(F.explode(term_hashes(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    band = [r[0] for r in found.filter((F.col("n") >= max(2.0, low * count)) & (F.col("n") <= max(2.0, high * count))).select("term").collect()]
    mask = (1 << max(0, len(band).bit_length() - 2)) - 1
    starts = [0] * (mask + 2)
    for h in band:
        starts[(h & mask) + 1] += 1
    return sorted(band, key=lambda h: (h & mask, h)), list(accumulate(starts))


def constant(numbers: list[int]) -> Column:
    """An array that is folded to one constant."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>") if numbers else F.array().cast("array<bigint>")


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprint(text: Column, hashes: Column, starts: Column, buckets: int) -> Column:
    """SIGNATURES signatures of DIGITS characters in one string: the classical one, then those of each seed by rate."""

    def has(h: Column) -> Column:
        at = h.bitwiseAND(F.lit(buckets - 1)).cast("int")
        start = F.get(starts, at).cast("int")
        return F.array_contains(F.slice(hashes, start + 1, F.get(starts, at + 1).cast("int") - start), h)

    def chosen(known: Column) -> Column:
        either = lambda inside: F.when(F.size(inside) > 0, inside).otherwise(known)
        return F.when(F.size(known) > 0, F.array_sort(let(F.filter(known, has), either))).otherwise(F.array(F.xxhash64(text, F.lit("text"))))

    def signature(terms: Column) -> Column:
        return F.when(F.size(terms) > 0, F.right(F.lpad(F.hex(F.xxhash64(terms)), F.lit(16), F.lit("0")), F.lit(DIGITS))).otherwise(F.lit(NONE))

    def of_rates(terms: Column, seed: Column, rates: tuple) -> Column:
        inside = F.filter(terms, lambda t: F.xxhash64(t, seed).bitwiseAND(F.lit(rates[0] - 1)) == 0)
        # a sparser subset is part of the denser one
        return let(inside, lambda x: F.concat(signature(x), of_rates(x, seed, rates[1:])) if rates[1:] else signature(x))

    def all_of(terms: Column) -> Column:
        seeds = F.transform(F.sequence(F.lit(0), F.lit(SEEDS - 1)), lambda f: of_rates(terms, f, RATES))
        return F.concat(signature(terms), F.array_join(seeds, ""))

    return let(let(term_hashes(text), chosen), all_of)


def likeness(a: Column, b: Column) -> Column:
    """Equal signatures among those that either fingerprint has."""
    both = F.transform(F.sequence(F.lit(0), F.lit(SIGNATURES - 1)), lambda i: F.struct(F.substring(a, i * DIGITS + 1, F.lit(DIGITS)).alias("a"), F.substring(b, i * DIGITS + 1, F.lit(DIGITS)).alias("b")))
    present = lambda pairs: F.filter(pairs, lambda x: (x["a"] != NONE) | (x["b"] != NONE))
    return let(present(both), lambda p: F.size(F.filter(p, lambda x: x["a"] == x["b"])) / F.size(p).cast("double"))


def bounds(docs: DataFrame, rows_each: int) -> list[int]:
    """doc_ids that part the documents, the smallest first: one number for about rows_each rows."""
    n, least = docs.agg(F.count("doc_id"), F.min("doc_id")).first()
    if not n:
        return []
    parts = min(100_000, -(-n // rows_each))
    found = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else []
    return sorted({least, *found})


def with_next(rows: DataFrame, cuts: list[int], columns: list[str]) -> DataFrame:
    """rows with next_<column> of the row after it by doc_id (after the last: the first). Each range of doc_ids is a window; the first document of a range is also sent to the end of the range before it."""
    if not cuts:
        cuts = [0]
    step = max(1, int(len(cuts) ** 0.5))
    every, coarse = F.array(*[F.lit(c).cast("long") for c in cuts]), F.array(*[F.lit(c).cast("long") for c in cuts[::step]])
    doc = F.col("doc_id")
    block = F.greatest(F.size(F.filter(coarse, lambda c: c <= doc)) - 1, F.lit(0))
    inside = F.size(F.filter(F.slice(every, block * step + 1, F.lit(step)), lambda c: c <= doc))
    at = F.when(doc.isNull(), F.lit(0)).otherwise(F.greatest(block * step + inside - 1, F.lit(0)))
    own = rows.withColumns({"_at": at, "_copy": F.lit(False)})
    first = rows.filter(doc.isNull() | doc.isin(cuts)) if len(cuts) <= 1000 else rows.filter(doc.isNull() | F.array_contains(every, doc))
    heads = first.withColumns({"_at": F.pmod(at - 1, F.lit(len(cuts))), "_copy": F.lit(True)})
    order = Window.partitionBy("_at").orderBy("_copy", F.col("doc_id").asc_nulls_first(), *columns)
    named = {f"next_{c}": F.lead(c).over(order) for c in columns}
    return own.unionByName(heads).withColumns(named).filter(~F.col("_copy")).drop("_at", "_copy")


def fingerprints(docs: DataFrame, low: float = 0.0005, high: float = 0.2, rows_each: int = 2000) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select("doc_id", common.text_of().alias("text"))
    hashes, starts = lexicon(texts, low, high)
    known = (constant(hashes), constant(starts), len(starts) - 1)
    own = texts.withColumn("fingerprint", fingerprint(F.col("text"), *known))
    pairs = with_next(own, bounds(docs.select("doc_id"), rows_each), ["text", "fingerprint"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    done = pairs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    done = done.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "fingerprint", "next_fingerprint", fingerprint(F.col("edited"), *known).alias("edited_fingerprint"))
    return done.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def op1_imatch(spark, sf_dir: str) -> DataFrame:
    return fingerprints(common.read(spark, sf_dir, "documents"))

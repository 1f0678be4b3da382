"""Toxicity by a factorization machine over hashed terms (operator 9).

score = sigmoid(b + sum w_i + sum over pairs <v_i, v_j>) over the set of hashed terms of a text, so pairs of terms count
besides single ones. Terms are lower-cased words and their first four and five letters. Only the labelled rows outside the
held-out fold (crc32 of the id as text, modulo 5, is 0) are learnt from. The model is fitted on the driver on a sample of
bounded size, `per_class` rows of either label taken by hash of the id; the intercept is then moved to the label shares
of all learnable rows. Everything else covers all rows: each whole text is scored in one pass without a shuffle.

Terms kept in the model: in at least 3 sample texts, and either tied to the label (chi-square over 10), or among the
`common_terms` most frequent ones, or part of a pair that is tied to the label (chi-square over 30, and more than either
term is); pairs are counted among the `paired_terms` most frequent terms, so a term that is neutral alone is not lost.

Defined results. Null or empty text: no terms, the intercept's score. Null labels are not learnt from; a document with
several labels is toxic if any is. No labels, or one kind only: the score is the share of toxic ones (0 without any).
Repeated rows get equal scores. Null doc_id: never held out. Other columns never reach the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 20
#: ASCII characters that are neither letters nor digits part words.
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE).split())


def term_ids(word: bytes) -> tuple[int, ...]:
    import xxhash

    mask, text = (1 << BITS) - 1, word.decode("utf-8", "surrogatepass")
    stems = [f"{n}:{text[:n]}" for n in (4, 5) if len(text) >= n]
    return tuple(xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 9) & mask for x in (text, *stems))


class Model:
    """A factorization machine: `number` gives the row of a hashed term in w and v."""

    def __init__(self, number: dict[int, int], b: float, w: np.ndarray, v: np.ndarray):
        self.number, self.b, self.w, self.v = number, b, w, v
        self.seen: dict[bytes, tuple[int, ...]] = {}

    def rows(self, text: str | None) -> list[int]:
        out: set[int] = set()
        for word in terms(text):
            if (known := self.seen.get(word)) is None:
                if len(self.seen) > 200_000:
                    self.seen.clear()
                known = self.seen[word] = tuple(self.number[i] for i in term_ids(word) if i in self.number)
            out.update(known)
        return sorted(out)

    def score(self, text: str | None) -> float:
        z = self.b
        if rows := self.rows(text):
            v = self.v[rows]
            z += float(self.w[rows].sum()) + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def pair_terms(texts: list[np.ndarray], y: np.ndarray, often: np.ndarray, chi: np.ndarray, limit: float = 30.0) -> np.ndarray:
    """Those of the frequent terms that are in a pair which says more about the label than either of its terms."""
    often = np.sort(often)
    found = np.zeros((len(texts), len(often)), np.float32)
    for i, t in enumerate(texts):
        at = np.searchsorted(often, t)
        at[at == len(often)] = 0
        found[i, at[often[at] == t]] = 1
    n, n1 = len(y), float(y.sum())
    both, toxic = (found.T @ found).astype(float), (found[y > 0].T @ found[y > 0]).astype(float)
    expected = both * (n1 / n)
    tied = (toxic - expected) ** 2 / np.maximum(expected * (1 - n1 / n) * np.maximum(1 - both / n, 1e-9), 1e-9)
    alone = chi[often]
    strong = (both >= 10) & (tied > limit) & (tied > 1.5 * np.maximum(alone[:, None], alone[None, :]))
    np.fill_diagonal(strong, False)
    return often[strong.any(1)]


def fit(texts: list[np.ndarray], labels: np.ndarray, share: float, factors: int = 8, epochs: int = 12, common_terms: int = 300, paired_terms: int = 1200, seed: int = 1) -> Model:
    """Adagrad on the logistic loss. texts: the distinct hashed terms of each sample text; share: of toxic ones among all learnable rows."""
    n, n1 = len(labels), int(labels.sum())
    if not n or n1 in (0, n):
        p = min(max(share, 1e-9), 1 - 1e-9) if n else 1e-9
        return Model({}, float(np.log(p / (1 - p))), np.zeros(0), np.zeros((0, factors)))
    flat, y = np.concatenate(texts), labels.astype(float)
    of = np.repeat(y, [len(t) for t in texts])
    a, k1 = np.bincount(flat, minlength=1 << BITS), np.bincount(flat, weights=of, minlength=1 << BITS)
    expected = a * n1 / n
    chi = (k1 - expected) ** 2 / np.maximum(expected * (1 - n1 / n) * np.maximum(1 - a / n, 1e-9), 1e-9)
    often = np.zeros(1 << BITS, bool)
    often[np.argsort(-a, kind="stable")[:common_terms]] = True
    paired = np.zeros(1 << BITS, bool)
    paired[pair_terms(texts, y, np.argsort(-a, kind="stable")[:paired_terms], chi)] = True
    kept = np.flatnonzero((a >= 3) & ((chi > 10) | often | paired))
    number = np.full(1 << BITS, -1)
    number[kept] = np.arange(len(kept))
    rows = [(r := number[t])[r >= 0] for t in texts]
    draw = np.random.default_rng(seed)
    w, v, b = np.zeros(len(kept)), draw.normal(0, 0.01, (len(kept), factors)), float(np.log(n1 / (n - n1)))
    gw, gv, gb = np.full(len(kept), 1e-6), np.full((len(kept), factors), 1e-2), 1e-6
    for _ in range(max(epochs, 40_000 // n)):  # small samples need more rounds for as many steps
        for part in np.array_split(draw.permutation(n), max(1, n // 32)):
            idx = np.concatenate([rows[i] for i in part])
            doc = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            total = np.zeros((len(part), factors))
            np.add.at(total, doc, v[idx])
            square, linear = np.bincount(doc, (v[idx] ** 2).sum(1), len(part)), np.bincount(doc, w[idx], len(part))
            z = b + linear + 0.5 * ((total**2).sum(1) - square)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            u, back = np.unique(idx, return_inverse=True)
            dw = np.bincount(back, g[doc], len(u)) + 1e-4 * w[u]
            dv = np.zeros((len(u), factors))
            np.add.at(dv, back, g[doc][:, None] * (total[doc] - v[idx]))
            dv += 1e-3 * v[u]
            gw[u] += dw**2
            gv[u] += dv**2
            gb += g.sum() ** 2
            w[u] -= 0.1 * dw / np.sqrt(gw[u])
            v[u] -= 0.02 * dv / np.sqrt(gv[u])
            b -= 0.05 * g.sum() / np.sqrt(gb)
    shift = np.log(share / (1 - share)) - np.log(n1 / (n - n1))
    return Model({int(i): j for j, i in enumerate(kept)}, float(b + shift), w, v)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 3000) -> Model:
    """The model from at most per_class rows of either label."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64(F.col("doc_id"), F.lit(5))
    sample = known.filter("toxic = 1").orderBy(order).limit(per_class).unionByName(known.filter("toxic = 0").orderBy(order).limit(per_class))

    def make():
        cache: dict[bytes, tuple[int, ...]] = {}

        def ids(text: str | None) -> bytes:
            out: set[int] = set()
            for word in terms(text):
                if word not in cache:
                    cache[word] = term_ids(word)
                out.update(cache[word])
            return np.array(sorted(out), "<u4").tobytes()

        def work(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "ids": [ids(x) for x in batch.column("text").to_pylist()]}

        return work

    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")  # at most 2 * per_class rows
    rows = sorted(common.per_batch(chosen, make, "doc_id long, toxic int, ids binary").collect(), key=lambda r: (r[0], bytes(r[2])))
    total = sum(counts.values())
    model = fit([np.frombuffer(bytes(r[2]), "<u4").astype(np.int64) for r in rows], np.array([r[1] for r in rows], dtype=int), counts.get(1, 0) / total if total else 0.0)
    del rows
    common.settle(docs.sparkSession)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.number, model.b, model.w, model.v))

    def make():
        use = Model(*sent.value)
        return lambda batch: {"doc_id": batch.column("doc_id"), "score": [use.score(x) for x in batch.column("text").to_pylist()]}

    return common.per_batch(docs.select("doc_id", "text"), make, "doc_id long, score double")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose score is under 0.5."""
    common.prepare(docs.sparkSession)
    model = learn(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((model.number, model.b, model.w, model.v))

    def make():
        use = Model(*sent.value)
        return lambda texts: [use.score(x) < 0.5 for x in texts]

    return common.kept_rows(docs, "text", make)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs, labels = (common.read(spark, sf_dir, t) for t in ("documents", "labels"))
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

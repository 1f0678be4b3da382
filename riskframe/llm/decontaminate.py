"""Benchmark decontamination by Wu-Manber multi-pattern search over words (operator 5).

Patterns are windows of `window` consecutive words of the benchmark items (a shorter item is one pattern). Patterns of
one length are searched together: a block of the last words under the text window gives a shift; blocks that end no
pattern allow a jump, and a shift of 0 leads to the bucket of patterns that end with this block, which are compared
word by word after a test of their first block.

A benchmark is a stated query set; it is taken in blocks of `block_items` items, each sent to the workers as one
broadcast of bounded size, and documents are read once. Where there are several blocks, a worker holds one at a time, for a
batch of documents each. Nothing of the documents is shuffled.

Defined results. Null or empty text: no words, not contaminated. Items without words occur nowhere. Repeated
documents or items: each row is judged by itself; an item_id counts once. Null item_id: its windows hit, but it is not
counted among the items. Empty benchmark: nothing is hit. Long texts:
whole. Other columns stay as they are in `clean`, and are ignored in `report`.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Every ASCII byte but 0-9 and a-z parts words, A-Z become a-z; other bytes belong to words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Searcher:
    """Wu-Manber tables for patterns (tuples of words) of one length."""

    def __init__(self, patterns: dict[tuple, list], block: int = 3):
        self.patterns, self.m = patterns, len(next(iter(patterns)))
        self.b = min(block, self.m)
        self.most = self.m - self.b + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, list] = defaultdict(list)
        for p in patterns:
            for end in range(self.b, self.m + 1):
                key = p[end - self.b : end]
                self.shift[key] = min(self.shift.get(key, self.most), self.m - end)
            self.bucket[p[-self.b :]].append((p[: self.b], p))

    def find(self, text: list[bytes]):
        """(position, pattern) of each occurrence."""
        m, b, most, shift, n = self.m, self.b, self.most, self.shift.get, len(text)
        end = m
        while end <= n:
            if step := shift(block := tuple(text[end - b : end]), most):
                end += step
                continue
            at = end - m
            first = tuple(text[at : at + b])
            for prefix, p in self.bucket[block]:
                if prefix == first and tuple(text[at:end]) == p:
                    yield at, p
            end += 1


def searchers(items: list[tuple], window: int) -> list[Searcher]:
    by_length: dict[int, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        w = words(text)
        for at in range(max(1, len(w) - window + 1)):
            if p := tuple(w[at : at + window]):
                by_length[len(p)][p] += [] if item is None else [str(item)]
    return [Searcher(dict(p)) for p in by_length.values()]


def blocks(benchmark: DataFrame, window: int, block_items: int) -> list:
    """The benchmark's tables as broadcasts, a block of items each; only one block is on the driver at a time."""
    sc, rows, out = benchmark.sparkSession.sparkContext, benchmark.select("item_id", "text").toLocalIterator(), []
    while part := [(r[0], r[1]) for r in islice(rows, block_items)]:
        out.append(sc.broadcast(searchers(part, window)))
    return out


def held(tables: list):
    """In a task: the tables one after the other; with more than one, each is let go before the next is loaded."""
    for t in tables:
        yield t.value
        if len(tables) > 1:
            t.__dict__.pop("_value", None)


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_items: int = 20_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs."""
    common.prepare(docs.sparkSession)
    tables = blocks(benchmark, window, block_items)

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            texts = [words(x) for x in batch.column("text").to_pylist()]
            hits, items = [bytearray(len(w)) for w in texts], [set() for _ in texts]
            for table in held(tables):
                for s in table:
                    for w, hit, found in zip(texts, hits, items, strict=True):
                        for at, p in s.find(w):
                            hit[at : at + s.m] = b"\x01" * s.m
                            found.update(s.patterns[p])
            n_hit = [sum(x) for x in hits]
            sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
            return {"doc_id": batch.column("doc_id"), "n_words": [len(w) for w in texts], "n_hit": n_hit, "n_items": [len(x) for x in items], "items_sha256": sha, "contaminated": [x > 0 for x in n_hit]}

        return work

    return common.per_batch(docs.select("doc_id", "text"), make, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_items: int = 20_000) -> DataFrame:
    """The rows of docs, all columns, in whose text no window of the benchmark occurs."""
    common.prepare(docs.sparkSession)
    tables = blocks(benchmark, window, block_items)

    def free(texts: list) -> list[bool]:
        split = [words(x) for x in texts]
        out = [True] * len(split)
        for table in held(tables):
            for i, w in enumerate(split):
                out[i] = out[i] and not any(True for s in table for _ in s.find(w))
        return out

    return common.kept_rows(docs, "text", lambda: free)


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    return report(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))

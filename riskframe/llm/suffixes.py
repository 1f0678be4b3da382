"""Removal of repeated byte strings by bucket-pointer refinement (operator 10).

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller doc_id. To sort all
suffixes of a corpus is more than is needed: a string can only repeat where its anchor does. The anchor of a string is
the place of the smallest hash among its grams of `gram` bytes, so equal strings have equal anchors at the same place.

1. Each document gives its anchors: hash of the gram, the strings that have this anchor (consecutive starts), and a
   hash of the context, the bytes that these strings cover. Within a batch of documents, anchors with a context that an
   earlier document of the batch has are settled at once, so hot passages are thinned before the shuffle.
2. Anchors meet by gram, sorted by context and doc_id, and are read as a stream. Of equal contexts all but the smallest
   document's are repeats. The smallest document's stay open where another context of the gram agrees on the gram before
   or the one after the anchor, one of which any common string has.
3. The strings of open anchors are sorted by bucket-pointer refinement (see bucket_order). A gram with more than `hot` open
   anchors, of which a task could not hold all, is refined across tasks first (see split_hot): its bucket is parted by the
   q-gram at the next depth, again where a part is still too large, and each part that fits is refined in a task.
4. The repeats' spans are gathered per document and taken out of the text.

Defined results. Null text: empty. Texts under `length` bytes keep all. Null doc_id: smaller than any. Rows with one
doc_id are one document: none removes a string of another, equal ones lose the same. Different texts under one doc_id in
one partition of the input lose the places that any of them loses; ids should be unique. Judged on the input, not on
what is left. Empty table: no rows. Other columns are ignored. Text is UTF-8; what is left need not be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: code: 40 bits of the gram's hash, 8 bits for either side, then 1 for settled, 7 for the number of starts.
ANCHORS = "code long, context long, doc_id long, at int, part int"
_RANDOM = np.random.default_rng(20240101).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
#: Places are numbered within pieces of a text, in the low bits of a number whose high bits are a hash.
_PLACE = 24
#: Stands for a null doc_id, which is smaller than any.
_NULL = -(1 << 63)


def gram_keys(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each gram (a power of two long)."""
    h, width, p = _RANDOM[data], 1, _P
    while width < gram:
        h = h[:-width] * np.uint64(p) + h[width:]
        width, p = 2 * width, p * p & 0xFFFFFFFFFFFFFFFF
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def anchors(data: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """gram hash, first start, number of starts and sides of each anchor of a text.

    A string that starts `gram` bytes or more before its anchor has all of the gram before the anchor, any other one the
    gram after it (as length >= 3 * gram - 1). sides has 8 bits of either gram's hash, 0 where the anchor has no such string.
    """
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    window, step = length - gram + 1, (1 << _PLACE) - 4 * length
    parts = []
    for base in range(0, len(data) - length + 1, step):
        before = min(base, gram)
        piece = np.frombuffer(data, np.uint8, min(before + step + length - 1, len(data) - base + before), base - before)
        whole = gram_keys(piece, gram)
        keys = whole[before:] >> np.uint64(_PLACE)
        least, width = (keys << np.uint64(_PLACE)) | np.arange(len(keys), dtype=np.uint64), 1
        while 2 * width <= window:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if window > width:
            least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
        begins = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        counts = np.diff(np.append(begins, len(least)))
        place = (least[begins] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        side = (whole >> np.uint64(56)).astype(np.int64) | 1
        early, late = place - begins >= gram, place - (begins + counts - 1) < gram
        left = np.where(early, side[np.maximum(place + before - gram, 0)], 0)
        right = np.where(late, side[np.minimum(place + before + gram, len(side) - 1)], 0)
        parts.append(((least[begins] >> np.uint64(_PLACE)).astype(np.int64), begins + base, counts, left << 8 | right))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def found_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def make():
        import xxhash

        hashed = xxhash.xxh64_intdigest

        def work(batch: pa.RecordBatch) -> dict:
            parts, contexts, owners, numbers = [], [], [], []
            for doc, text, number in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part")), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                g, at, n, sides = anchors(data, length, gram)
                parts.append((g, at, n, sides))
                contexts += [hashed(data[a:e]) for a, e in zip(at.tolist(), (at + n + length - 1).tolist(), strict=True)]
                owners.append(np.full(len(g), _NULL if doc is None else doc, np.int64))
                numbers.append(np.full(len(g), number, np.int32))
            g, at, n, sides = (np.concatenate(x) for x in zip(*parts, strict=True))
            context, owner, part = np.array(contexts, np.uint64).view(np.int64), np.concatenate(owners), np.concatenate(numbers)
            order = np.lexsort((owner, context, g))
            g, at, n, sides, context, owner, part = (x[order] for x in (g, at, n, sides, context, owner, part))
            new = np.concatenate(([True], (g[1:] != g[:-1]) | (context[1:] != context[:-1]))) if len(g) else np.zeros(0, bool)
            first = owner[np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))] if len(g) else owner
            settled = owner > first
            # settled anchors are dealt out evenly, not by gram
            g = np.where(settled, (owner * 1_000_003 + at) & ((1 << (64 - _PLACE)) - 1), g)
            code = g.astype(np.uint64) << np.uint64(_PLACE) | (sides << 8 | settled.astype(np.int64) << 7 | n).astype(np.uint64)
            return {"code": code.view(np.int64), "context": context, "doc_id": owner, "at": at, "part": part}

        return work

    return common.per_batch(docs, make, ANCHORS)


OPEN = "gram long, doc_id long, at int, n int, part int, open boolean"
#: Rows of one gram that settle() holds at most; past it the gram's anchors stay open without the test of sides.
HELD = 200_000


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors sorted by code, context, doc_id: repeats (open false) and anchors that other contexts of their gram must be compared with (open true). Settled anchors are repeats. Only the last gram's rows are held."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())

    def batch_of(rows, chosen, opened):
        code, _, d, at, part = (x[chosen] for x in rows)
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((code >> _PLACE, d, at, code & 127, part, opened), kinds, strict=True)], names=[x.split()[0] for x in OPEN.split(", ")])

    def judge(rows: list[np.ndarray], last: tuple | None, whole: bool) -> tuple[pa.RecordBatch, tuple]:
        code, c, d = rows[:3]
        g = code >> _PLACE
        new_g = np.concatenate(([True], g[1:] != g[:-1]))
        new_c = new_g | np.concatenate(([True], c[1:] != c[:-1]))
        if goes_on := last is not None and (g[0], c[0]) == last[:2]:
            new_c[0] = False
        begin = np.maximum.accumulate(np.where(new_c, np.arange(len(g)), -1))
        owner = np.where(begin >= 0, d[np.maximum(begin, 0)], last[2] if goes_on else 0)
        repeat = d > owner
        if whole:
            heads, of, shared = np.flatnonzero(new_c), np.cumsum(new_g), np.zeros(len(g), bool)
            for shift in (16, 8):
                side = (code >> shift) & 255
                _, back, count = np.unique((of << 8 | side)[heads], return_inverse=True, return_counts=True)
                shared |= ((count[back] > 1) & (side[heads] > 0))[np.cumsum(new_c) - 1]
            out = repeat | shared
        else:
            out = np.ones(len(g), bool)
        return batch_of(rows, out, ~repeat[out]), (g[-1], c[-1], owner[-1])

    held, streaming, last = None, None, None  # rows of the last gram; the gram that is too large to hold, and its last row
    for batch in batches:
        rows = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        if (done := (rows[0] & 128) > 0).any():
            yield batch_of(rows, done, np.zeros(int(done.sum()), bool))
            rows = [x[~done] for x in rows]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            held = None
        if streaming is not None and len(rows[0]):
            if n := int(np.searchsorted(rows[0] >> _PLACE, streaming, "right")):
                out, last = judge([x[:n] for x in rows], last, False)
                yield out
                rows = [x[n:] for x in rows]
            if len(rows[0]):
                streaming = last = None
        if not len(rows[0]):
            continue
        cut = int(np.searchsorted(g := rows[0] >> _PLACE, g[-1]))
        if cut:
            yield judge([x[:cut] for x in rows], None, True)[0]
        held = [x[cut:] for x in rows]
        if len(held[0]) > HELD:
            streaming = held[0][0] >> _PLACE
            out, last = judge(held, None, False)
            yield out
            held = None
    if held is not None:
        yield judge(held, None, True)[0]


#: Bytes of the first buckets, and into how many parts the buckets of a group are dealt, each refined to its end before the next.
Q, PARTS = 8, 8


def bucket_order(data: np.ndarray, left: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A number for each place, in the order of the bytes from there to the end of its context, up to `length` bytes at least.

    Bucket-pointer refinement: a place's pointer is the rank of its bucket. The first buckets are Q-grams. A bucket whose
    places share `depth` bytes is refined by the pointers of the places `depth` further on, which moves its depth by that
    of the pointer's bucket; the new pointers hold at once, for its own parts, which are refined next, and for all buckets
    that come later. Buckets with less than two of the starts, or known to `length` bytes, are left alone.
    """
    n = len(left)
    words = np.lib.stride_tricks.sliding_window_view(data, Q)[:n].copy().view(">u8")[:, 0].astype(np.uint64)
    short = np.flatnonzero(left < Q)
    words[short] &= ~np.uint64(0) << (np.uint64(8) * (Q - left[short]).astype(np.uint64))
    size = np.minimum(left, Q)
    order = np.lexsort((size, words))
    new = np.concatenate(([True], (words[order][1:] != words[order][:-1]) | (size[order][1:] != size[order][:-1]))) if n else np.zeros(0, bool)
    pointer, depth = np.zeros(n, np.int64), size.astype(np.int16)
    pointer[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    is_start = np.zeros(n, bool)
    is_start[starts] = True

    def live(places: np.ndarray) -> np.ndarray:
        """Those of the places, whole buckets in order, whose bucket must be refined."""
        p = pointer[places]
        begin = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        counts = np.add.reduceat(is_start[places].astype(np.int64), begin)
        of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(p))))
        return places[(counts[of] > 1) & (depth[places] < length) & (depth[places] < left[places])]

    todo = live(order) if n else order
    edges = np.flatnonzero(np.concatenate(([True], pointer[todo][1:] != pointer[todo][:-1]))) if len(todo) else np.zeros(0, np.int64)
    cuts = np.unique(edges[np.searchsorted(edges, np.arange(1, PARTS) * len(todo) // PARTS).clip(max=len(edges) - 1)]) if len(edges) else edges
    for part in np.split(todo, cuts):
        while len(part):
            d = depth[part].astype(np.int64)
            ended = left[part] <= d
            at = np.where(ended, part, part + d)
            key, step = np.where(ended, -1, pointer[at]), np.where(ended, length, depth[at])
            own = pointer[part]
            by = np.lexsort((key, own))
            part, own, key = part[by], own[by], key[by]
            head = np.concatenate(([True], own[1:] != own[:-1]))
            fresh = head | np.concatenate(([True], key[1:] != key[:-1]))
            i = np.arange(len(part))
            first, sub = np.maximum.accumulate(np.where(head, i, 0)), np.maximum.accumulate(np.where(fresh, i, 0))
            pointer[part] = own + sub - first
            depth[part] = np.minimum(d[by] + step[by], length)
            part = live(part)
    return pointer


def refine(group: pd.DataFrame, length: int) -> pd.DataFrame:
    """Spans of the anchors' strings that a smaller document has too, among the anchors of the same group."""
    texts = group["bytes"].tolist()
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts) + bytes(Q), np.uint8)
    row = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.repeat(sizes, sizes) - inside  # bytes from a place to the end of its context
    starts = np.flatnonzero(left >= length)
    pointer = bucket_order(data, left, starts, length)
    starts = starts[np.argsort(pointer[starts], kind="stable")]
    p = pointer[starts]
    # a deeper pointer may part equal strings, which then are neighbours: they are compared
    new = np.concatenate(([True], p[1:] != p[:-1])) if len(p) else np.zeros(0, bool)
    heads = np.flatnonzero(new)[1:]
    strings = np.lib.stride_tricks.sliding_window_view(data, length) if len(data) >= length else None
    for at in range(0, len(heads), 100_000):
        h = heads[at : at + 100_000]
        new[h] = (strings[starts[h]] != strings[starts[h - 1]]).any(1)
    owners, b = group["doc_id"].to_numpy()[row[starts]], np.cumsum(new) - 1
    least = np.full(b[-1] + 1 if len(b) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, b, owners)
    gone = starts[owners > least[b]] if len(b) else starts
    start = group["at"].to_numpy()[row[gone]] + inside[gone]
    part = group["part"].to_numpy()[row[gone]]
    none = pd.DataFrame(columns=["doc_id", "begin", "stop", "part"]).astype({"doc_id": "int64", "begin": "int32", "stop": "int32", "part": "int32"})
    return pd.concat([none] + [runs(group["doc_id"].to_numpy()[row[gone]][part == k], start[part == k], start[part == k] + length).assign(part=np.int32(k)) for k in np.unique(part)])


def runs(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    """doc_id, begin, end with spans that touch joined."""
    if not len(doc):
        return pd.DataFrame({"doc_id": np.zeros(0, np.int64), "begin": np.zeros(0, np.int32), "stop": np.zeros(0, np.int32)})
    order = np.lexsort((end, begin, doc))
    doc, begin, end = doc[order], begin[order].astype(np.int64), end[order].astype(np.int64)
    out, k = [], 0
    bounds = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1], [True])))
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        reach = np.maximum.accumulate(end[lo:hi])
        first = np.concatenate(([True], begin[lo + 1 : hi] > reach[:-1]))
        k = np.flatnonzero(first)
        out.append((np.full(len(k), doc[lo]), begin[lo:hi][k], reach[np.append(k[1:] - 1, hi - lo - 1)]))
    d, b, e = (np.concatenate(x) for x in zip(*out, strict=True))
    return pd.DataFrame({"doc_id": d, "begin": b.astype(np.int32), "stop": e.astype(np.int32)})


def contexts(docs: DataFrame, opened: DataFrame, length: int) -> DataFrame:
    """gram, doc_id, at, part, bytes of open anchors, taken from the texts where they are read."""
    folder = common.write_beside(opened.select("doc_id", "gram", "at", "n", "part"))

    def make():
        def load(part: int) -> tuple:
            beside = common.rows_beside(folder, part)
            columns = {c: beside.column(c).to_numpy() for c in ("doc_id", "gram", "at", "n")} if beside is not None else {c: np.zeros(0, np.int64) for c in ("doc_id", "gram", "at", "n")}
            order = np.lexsort((columns["at"], columns["gram"], columns["doc_id"]))
            # rows of one doc_id are one document: its anchors count once
            ids, gram, at, n = (columns[c][order] for c in ("doc_id", "gram", "at", "n"))
            same = (ids[1:] == ids[:-1]) & (gram[1:] == gram[:-1]) & (at[1:] == at[:-1]) if len(ids) else np.zeros(0, bool)
            fresh = np.concatenate(([True], ~same)) if len(ids) else np.zeros(0, bool)
            return tuple(x[fresh] for x in (ids, gram, at, n))

        beside = common.Beside(load)

        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"gram": [], "doc_id": [], "at": [], "bytes": [], "part": []}
            for part, rows in common.by_part(batch):
                ids, gram, at, n = beside(part)
                owners = rows.column("doc_id").to_numpy(zero_copy_only=False)
                low, high = np.searchsorted(ids, owners), np.searchsorted(ids, owners, "right")
                for i in np.flatnonzero(high > low):
                    data = rows.column("text")[int(i)].as_py().encode("utf-8", "surrogatepass")
                    span = slice(low[i], high[i])
                    out["gram"] += gram[span].tolist()
                    out["doc_id"] += [int(owners[i])] * int(high[i] - low[i])
                    out["at"] += at[span].tolist()
                    out["bytes"] += [data[a : a + k + length - 1] for a, k in zip(at[span].tolist(), n[span].tolist(), strict=True)]
                    out["part"] += [part] * int(high[i] - low[i])
            return out

        return work

    return common.per_batch(docs, make, "gram long, doc_id long, at int, bytes binary, part int")


def parted(rows: DataFrame, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """rows of grams with up to `hot` rows, and the others (None if there are none)."""
    counted = rows.groupBy("gram").agg(F.count("*").alias("c"))
    heavy = common.cut(counted.filter(F.col("c") > hot).select("gram", F.lit(True).alias("warm")))
    if heavy.isEmpty():
        return rows, None
    marked = rows.join(F.broadcast(heavy), "gram", "left") if common.small(heavy, 500_000) else common.salted_join(rows, heavy, ["gram"], "doc_id", how="left")
    return marked.filter("warm IS NULL").drop("warm"), marked.filter("warm").drop("warm")


def refined(rows: DataFrame, length: int, parts: int) -> DataFrame:
    """Spans of the repeats among rows of one gram; grams are dealt out over `parts` tasks."""
    bucket = F.pmod(F.xxhash64("gram"), F.lit(parts))
    return rows.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(lambda g: refine(g, length), "doc_id long, begin int, stop int, part int")


def split_hot(warm: DataFrame, length: int, hot: int, parts: int) -> DataFrame:
    """Spans of the repeats of grams whose strings no task can hold.

    A bucket's identifier is refined by the q-gram at its depth, for all its strings, until at most `hot` of them are left in
    it; then a task sorts them to their end. The identifier is a hash, which only says what meets: strings are compared in
    the task. A bucket that is too large at its full depth has equal strings: nothing is left to sort, and its smallest
    document is an aggregate, which spreads. At most length / Q rounds.
    """
    begin = F.col("at") + F.col("i")
    strings = warm.select("gram", "doc_id", "at", "part", "bytes", F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - length)).alias("i"))
    strings = strings.select("gram", "doc_id", begin.cast("int").alias("at"), "part", F.substring("bytes", F.col("i") + 1, F.lit(length)).alias("bytes"))
    out, depth = warm.sparkSession.createDataFrame([], "doc_id long, begin int, stop int, part int"), 0
    while strings is not None and depth + Q <= length:
        finer = common.cut(strings.withColumn("gram", F.xxhash64("gram", F.substring("bytes", depth + 1, Q))))
        fitting, strings = parted(finer, hot)
        out, depth = out.unionByName(refined(fitting, length, parts)), depth + Q
    if strings is None:
        return out
    strings = common.cut(strings)
    first = strings.groupBy("bytes").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("most > least").select("bytes", "least")
    again = common.salted_join(strings, first, ["bytes"], "doc_id").filter("doc_id > least")
    return out.unionByName(again.select("doc_id", F.col("at").alias("begin"), (F.col("at") + length).cast("int").alias("stop"), "part"))


def repeated(docs: DataFrame, length: int = 50, gram: int = 16, hot: int = 20_000, bucket_rows: int = 40_000) -> DataFrame:
    """doc_id, begin, stop, part: byte spans of docs(doc_id, text, part) that go; they may overlap. part: any number that parts the rows of docs into pieces of a bounded size."""
    if gram & (gram - 1) or not 3 * gram - 1 <= length <= 127 + gram:
        raise ValueError("gram must be a power of two, length from 3 * gram - 1 to 127 + gram")
    tasks = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = found_anchors(docs, length, gram)
    streams = found.repartition(F.shiftright("code", _PLACE)).sortWithinPartitions("code", "context", "doc_id")
    judged = common.cut(streams.mapInArrow(settle, OPEN))
    span = lambda rows: rows.select("doc_id", F.col("at").alias("begin"), (F.col("at") + F.col("n") + F.lit(length - 1)).cast("int").alias("stop"), "part")
    texts = common.cut(contexts(docs, judged.filter("open"), length))
    parts = max(tasks, -(-texts.count() // bucket_rows))
    cold, warm = parted(texts, hot)
    found = span(judged.filter("NOT open")).unionByName(refined(cold, length, parts))
    return found if warm is None else found.unionByName(split_hot(warm, length, hot, parts))


def report(docs: DataFrame, length: int = 50, gram: int = 16) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row. The texts are written once, with the number of the partition they came from, so that later scans may split them in any way."""
    common.prepare(docs.sparkSession)
    texts = docs.select(F.coalesce("doc_id", F.lit(_NULL)).alias("doc_id"), common.text_of().alias("text"), F.spark_partition_id().alias("part"))
    texts = common.cut(texts, compression="zstd")
    folder = common.write_beside(repeated(texts, length, gram))

    def make():
        def load(part: int) -> tuple:
            beside = common.rows_beside(folder, part)
            columns = [beside.column(c).to_numpy() for c in ("doc_id", "begin", "stop")] if beside is not None else [np.zeros(0, np.int64)] * 3
            spans = runs(*columns)
            return tuple(spans[c].to_numpy() for c in ("doc_id", "begin", "stop"))

        beside = common.Beside(load)

        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
            for part, rows in common.by_part(batch):
                ids, begin, stop = beside(part)
                owners = rows.column("doc_id").to_numpy(zero_copy_only=False)
                low, high = np.searchsorted(ids, owners), np.searchsorted(ids, owners, "right")
                for doc, text, a, e in zip(owners.tolist(), rows.column("text").to_pylist(), low, high, strict=True):
                    data, keep, here, removed, n = text.encode("utf-8", "surrogatepass"), hashlib.sha256(), 0, 0, 0
                    for x, y in zip(begin[a:e].tolist(), stop[a:e].tolist(), strict=True):
                        if x < (y := min(y, len(data))):
                            keep.update(data[here:x])
                            removed, here, n = removed + y - x, y, n + 1
                    keep.update(data[here:])
                    for c, v in (("doc_id", None if doc == _NULL else doc), ("n_bytes", len(data)), ("n_removed", removed), ("n_spans", n), ("kept_sha256", keep.hexdigest())):
                        out[c].append(v)
            return out

        return work

    return common.per_batch(texts, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return report(common.read(spark, sf_dir, "documents"))

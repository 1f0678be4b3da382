"""Mixture-controlled packing by deficit round-robin over source queues (operator 7).

Every source is a queue of token ids in the order of the input's partitions. Its target share of each window is the one
that `targets` gives, else its share of all tokens, which is the mixture that every window can have until all is packed.
With other targets, queues run dry at different times; from then on the rest share the windows in proportion to their
targets. There is a queue for each source, however many there are; their totals and weights, two numbers each, reach the
driver and every worker. Token x of queue s, of weight w, is due at (2x + 1) / 2w. The rank of a token by that time, ties
by queue, is a closed form of the totals and weights, so any worker finds without others which superwindow (`windows`
windows) a token belongs to, and each superwindow has exactly the same number of tokens, however large a source or a
document is. Inside a superwindow each window is filled by deficit round-robin: the deficit of a queue that is not dry
grows by its share of the window, whole tokens are paid out, what is left is carried to the next window, and a superwindow
starts with the deficits with which the one before it ends.

Documents are cut freely; a sequence is full except the last one of all, so only that one is padded (where its length is
not a power of two). One shuffle carries the ids, as 16-bit numbers where the vocabulary allows.

Defined results. Null or empty text: one piece with the end id. Null source: a queue of its own. Null doc_id, repeated
rows: packed like any other row. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction
from heapq import heapify, heappop, heappush
from math import floor
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

SEGMENTS = "super long, queue int, at long, doc_id long, doc_tokens long, start long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: The queue of a null source, and the whole that weights of targets are parts of.
NONE, WHOLE = "\x00null", 1 << 30


def rank(totals: list[int], s: int, x: int, flat: np.ndarray | None = None, weights: list[int] | None = None) -> int:
    """How many tokens of all queues are due before token x of queue s. Whole numbers of any size, so exact. weights: the totals, where none are given. flat: the totals, and below them weights if given, as an array, for many queues; only products beyond 62 bits are then worked out one by one."""
    pull = weights or totals
    due, own, out, rest_of = 2 * x + 1, pull[s], x, range(len(totals))
    if flat is not None:
        most, pulls = np.atleast_2d(flat)[[0, -1]]
        large = pulls > (1 << 62) // due
        whole, rest = np.divmod(np.where(large, 0, pulls) * due - own, 2 * own)
        ahead = np.minimum(whole + ((rest > 0) | (np.arange(len(most)) < s)), most)
        ahead[s] = 0
        out, rest_of = out + int(ahead[whole >= 0].sum()), np.flatnonzero(large).tolist()
    for t in rest_of:
        if t != s and totals[t]:
            whole, rest = divmod(due * pull[t] - own, 2 * own)
            out += min(whole + (1 if t < s or rest else 0), totals[t]) if whole >= 0 else 0
    return out


def first_at(totals: list[int], s: int, least: int, low: int, high: int, flat: np.ndarray | None = None, weights: list[int] | None = None) -> int:
    """The smallest x in [low, high] whose rank is at least `least` (high if none)."""
    while low < high:
        mid = (low + high) // 2
        if rank(totals, s, mid, flat, weights) >= least:
            high = mid
        else:
            low = mid + 1
    return low


def deal(share: np.ndarray, deficit: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """One window: tokens to take from each queue. deficit and left are changed in place."""
    pull, grown = np.where(left > 0, share, 0), float(room)
    while grown > 1e-6 and (every := pull.sum()) > 0:  # what a queue that runs dry cannot use grows the others by their shares
        deficit += grown * pull / every
        over = np.where(pull > 0, np.maximum(deficit - left, 0), 0)
        deficit -= over
        pull, grown = np.where(deficit < left, pull, 0), over.sum()
    take = np.zeros(len(share), np.int64)
    for s in np.argsort(-deficit, kind="stable"):
        if not room or deficit[s] < 1:
            break
        take[s] = min(max(0, floor(deficit[s])), left[s], room)
        room -= take[s]
    ahead = [(take[s] - deficit[s], int(s)) for s in np.flatnonzero(left > take)] if room else []
    heapify(ahead)
    while room and ahead:
        _, s = heappop(ahead)
        more = min(max(1, floor(deficit[s] - take[s])), left[s] - take[s], room)
        take[s] += more
        room -= more
        if left[s] > take[s]:
            heappush(ahead, (take[s] - deficit[s], s))
    deficit -= take
    left -= take
    return take


def even(totals: list[int], weights: list[int], begun: int) -> tuple[int, int, int]:
    """Of the queues that are dry when `begun` tokens are dealt out by weight: the largest total / weight as its two numbers (-1, 1 if none), and their number of tokens."""
    dry, gone, pull = (-1, 1), 0, sum(weights)
    for total, weight in sorted(zip(totals, weights, strict=True), key=lambda x: Fraction(x[0], x[1] or 1)):
        if gone * weight + total * pull > begun * weight:
            break
        dry, gone, pull = (total, weight or 1), gone + total, pull - weight
    return *dry, gone


def fill(group: pd.DataFrame, totals: list[int], length: int, windows: int, kind: str, weights: list[int] | None = None) -> pd.DataFrame:
    """The pieces of one superwindow."""
    pull, number = weights or totals, int(group["super"].iloc[0])
    group = group.sort_values(["queue", "at"], kind="stable")
    queues = sorted(group["queue"].unique())
    segments = {q: list(g.itertuples(index=False)) for q, g in group.groupby("queue")}
    counts = {q: [len(x.ids) // np.dtype(kind).itemsize for x in segments[q]] for q in queues}
    left = np.array([sum(counts[q]) for q in queues], np.int64)
    begun = number * windows * length
    last, per, gone = even(totals, weights, begun) if weights else (-1, 1, 0)  # with their own shares none is dry before the end
    going = [totals[q] * per > last * pull[q] for q in queues]
    whole = sum(p for t, p in zip(totals, pull, strict=True) if t * per > last * p) or 1
    share = np.array([pull[q] / whole if on else 0.0 for q, on in zip(queues, going, strict=True)])
    deficit = np.array([((begun - gone) * pull[q] - segments[q][0].at * whole) / whole if on else float(n) for q, on, n in zip(queues, going, left.tolist(), strict=True)])
    blobs = {q: np.concatenate([np.frombuffer(x.ids, kind) for x in segments[q]]).astype("<u4").tobytes() for q in queues}
    place, spent, window = {q: (0, 0) for q in queues}, dict.fromkeys(queues, 0), 0
    rows: list[tuple] = []  # segment, its tokens before the piece, length, checksum, window, offset
    base = dict(zip(queues, np.cumsum([0, *(len(segments[q]) for q in queues[:-1])]).tolist(), strict=True))
    while left.sum():
        offset = 0
        for q, n in zip(queues, deal(share, deficit, left, min(length, int(left.sum()))).tolist(), strict=True):
            (i, used), sizes, blob, at, first = place[q], counts[q], blobs[q], spent[q], base[q]
            while n > 0:
                k = min(n, sizes[i] - used)
                rows.append((first + i, used, k, crc32(blob[4 * at : 4 * (at + k)]), window, offset))
                at, offset, n, used = at + k, offset + k, n - k, used + k
                if used == sizes[i]:
                    i, used = i + 1, 0
            place[q], spent[q] = (i, used), at
        window += 1
    segment, used, size, check, window_of, offsets = np.array(rows, np.int64).T
    ordered = [group[c].to_numpy() for c in ("doc_id", "start", "doc_tokens")]  # group is in the order of queues
    doc_id, start, doc_tokens = (c[segment] for c in ordered)
    columns = (doc_id, start + used, size, check, doc_tokens, number * windows + window_of, offsets)
    return pd.DataFrame(dict(zip([c.split()[0] for c in PIECES.split(", ")], columns, strict=True)))


def queue_of(docs: DataFrame, queues: int) -> tuple[DataFrame, list]:
    """docs with queue, the number of its source; the list of sources. One row a source reaches the driver. Up to `queues` names are in the plan, more in a joined table."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(NONE))
    names = sorted(r[0] for r in docs.select(source.alias("s")).distinct().collect())
    if len(names) > queues:
        table, rows = docs.sparkSession.createDataFrame(list(enumerate(names)), "queue int, _source string"), docs.withColumn("_source", source)
        found = rows.join(F.broadcast(table), "_source") if len(names) <= 200_000 else common.salted_join(rows, table, ["_source"], "doc_id")
        return found.drop("_source"), names
    number = F.array_position(F.array(*[F.lit(n) for n in names]), source).cast("int") - 1 if names else F.lit(0)
    return docs.withColumn("queue", number), names


def weights_of(names: list[str], totals: list[int], targets: dict[str | None, float]) -> list[int]:
    """Whole weights of the queues. Sources that targets leaves out have what it leaves of 1, in proportion to their tokens."""
    given = [targets.get(None if n == NONE else n) for n in names]
    rest, others = 1 - sum(targets.values()), sum(t for t, g in zip(totals, given, strict=True) if g is None)
    if any(v <= 0 for v in targets.values()) or rest < -1e-9 or (others and rest <= 1e-9):
        raise ValueError("targets must be positive, with a sum of at most 1, and leave something for the sources they do not name")
    return [max(1, round((rest * t / others if others else 0) * WHOLE if g is None else g * WHOLE)) for t, g in zip(totals, given, strict=True)]


def pack(docs: DataFrame, path: str, length: int = 2048, windows: int = 256, queues: int = 64, keep: int = tokens.KEEP, targets: dict[str | None, float] | None = None) -> DataFrame:
    """Pieces of all rows of docs(doc_id, text, source) in sequences of `length` tokens. keep: chunks that a worker's encoder holds; changes memory and time only. targets: shares of a window by source (None: a null source); without them each source has its share of all tokens."""
    spark = docs.sparkSession
    common.prepare(spark)
    dealt, names = queue_of(docs, queues)

    def make():
        from pyspark import TaskContext

        use, part, seen = tokens.encoder(path, keep), TaskContext.get().partitionId(), {}
        kind = "<u2" if use.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"

        def work(batch: pa.RecordBatch) -> dict:
            ids, n = use.encode([x or "" for x in batch.column("text").to_pylist()])
            ends, raw, queue, local = np.cumsum(n), ids.astype(kind), batch.column("queue").to_pylist(), []
            for q, k in zip(queue, n.tolist(), strict=True):
                local.append(seen.get(q, 0))
                seen[q] = local[-1] + k
            return {"part": [part] * len(n), "queue": queue, "local": local, "doc_id": batch.column("doc_id"), "doc_tokens": n, "ids": [raw[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)]}

        return work

    kind = tokens.id_kind(path)
    rows = common.cut(common.per_batch(dealt.select("doc_id", "text", "queue"), make, "part int, queue int, local long, doc_id long, doc_tokens long, ids binary"), compression="zstd")
    by_part = rows.groupBy("part", "queue").agg(F.sum("doc_tokens").alias("tokens"))
    found = {r[0]: r[1] for r in by_part.groupBy("queue").agg(F.sum("tokens")).collect()}  # a row a queue
    totals = [int(found.get(q, 0)) for q in range(max(1, len(names)))]
    weights = weights_of(names, totals, targets) if targets and names else None
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "queue", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    base = F.broadcast(base) if common.small(base, 500_000) else base
    placed = rows.join(base, ["part", "queue"]).withColumn("at", F.col("base") + F.col("local")).drop("part", "base", "local")
    span, size = windows * length, np.dtype(kind).itemsize

    def cut_up():
        def work(batch: pa.RecordBatch) -> dict:
            flat = np.array([totals, weights or totals], np.int64) if len(totals) > queues else None
            out: dict[str, list] = {c: [] for c in ("super", "queue", "at", "doc_id", "doc_tokens", "start", "ids")}
            for x in batch.to_pylist():
                q, at, end = x["queue"], x["at"], x["at"] + x["doc_tokens"]
                number, here = rank(totals, q, at, flat, weights) // span, at
                last = rank(totals, q, end - 1, flat, weights) // span
                while here < end:
                    stop = end if number >= last else first_at(totals, q, (number + 1) * span, here, end, flat, weights)
                    if stop > here:
                        for c, v in (("super", number), ("queue", q), ("at", here), ("doc_id", x["doc_id"]), ("doc_tokens", x["doc_tokens"]), ("start", here - at), ("ids", x["ids"][(here - at) * size : (stop - at) * size])):
                            out[c].append(v)
                    here, number = stop, number + 1
            return out

        return work

    return common.per_batch(placed, cut_up, SEGMENTS).groupBy("super").applyInPandas(lambda g: fill(g, totals, length, windows, kind, weights), PIECES)


def op7_pack(spark, sf_dir: str) -> DataFrame:
    return pack(common.read(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"))

"""Line dedup by winnowing over line hashes (operator 2).

Non-blank lines, without blanks at their ends, are the units. From each line on, the shortest run that has `least_lines`
lines or `least_words` words is a window. The smallest line hash of a window is its fingerprint: equal windows choose the
same place, so any repeated run of that length shares a fingerprint.

1. Only the chosen places are written, with their line hash, and those joined that have a hash at two places at least.
2. From each shared place the match is extended both ways over the texts: to every window that chose it, before and
   after it, and behind each window line by line, up to where the window of its next line ends. The runs found carry a
   128-bit hash of all their lines; of equal runs the earliest place (doc_id, line) is found by an aggregate.
3. Every run that starts at an earlier place too is deleted with all its lines.

So a line goes exactly if it lies in a run of lines that holds a window and starts at an earlier place too.

Defined results. Null text: no lines, stays null. Runs shorter than a window stay. Blank lines stay. Judged on the input,
not on what is left. Null doc_id: sorted before all others. Repeated rows with one doc_id: their lines count as one
document's, each row loses the same line numbers. Extra columns stay in `dedup`. Empty table: no rows.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PLACES, RUNS = "doc_id long, place int, mark long", "doc_id long, first int, last int, run binary"


def units(text: str | None) -> list[tuple[int, bytes]]:
    """(number, line) of the non-blank lines."""
    return [(i, x) for i, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")) if (x := line.strip())]


class Lines:
    """The units of a text: numbers, lines, words a line, hashes; and their windows."""

    def __init__(self, text: str | None, least_lines: int, least_words: int):
        import xxhash

        found = units(text)
        self.numbers, self.lines = [i for i, _ in found], [x for _, x in found]
        self.sizes, self.hashes = [len(x.split()) for x in self.lines], [xxhash.xxh64_intdigest(x) for x in self.lines]
        self.least_lines, self.least_words = least_lines, least_words

    def windows(self):
        """(first, last, place of the fingerprint) of each window."""
        for i in range(len(self.lines)):
            total, j = 0, i
            while j < len(self.lines):
                total += self.sizes[j]
                if total >= self.least_words or j - i + 1 >= self.least_lines:
                    yield i, j, min(range(i, j + 1), key=self.hashes.__getitem__)
                    break
                j += 1
            else:
                return

    def ends(self, first: int, last: int):
        """The last lines of a window and of the longer runs from its first line that the next line's window does not cover."""
        yield last
        while (last := last + 1) < len(self.lines) and last - first < self.least_lines and sum(self.sizes[first + 1 : last + 1]) < self.least_words:
            yield last


def places(docs: DataFrame, least_lines: int, least_words: int) -> DataFrame:
    """The chosen places of each document."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"doc_id": [], "place": [], "mark": []}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                known = Lines(text, least_lines, least_words)
                for k in sorted({k for _, _, k in known.windows()}):
                    h = known.hashes[k]
                    out["doc_id"].append(doc)
                    out["place"].append(known.numbers[k])
                    out["mark"].append(h - (1 << 64) if h >> 63 else h)
            return out

        return work

    return common.per_batch(docs.select("doc_id", "text"), make, PLACES)


def extended(docs: DataFrame, column: str, least_lines: int, least_words: int) -> DataFrame:
    """The runs over the shared places, which are in a column of docs (null: none)."""

    def make():
        import xxhash

        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"doc_id": [], "first": [], "last": [], "run": []}
            for doc, text, shared in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", column)), strict=True):
                shared = set(shared or ())
                known = Lines(text if shared else None, least_lines, least_words)
                for i, j, k in known.windows():
                    if known.numbers[k] in shared:
                        for end in known.ends(i, j):
                            for c, v in (("doc_id", doc), ("first", known.numbers[i]), ("last", known.numbers[end]), ("run", xxhash.xxh3_128_digest(b"\n".join(known.lines[i : end + 1])))):
                                out[c].append(v)
            return out

        return work

    return common.per_batch(docs.select("doc_id", "text", column), make, RUNS)


def beside(docs: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """docs with the arrays of found(doc_id, items) in a column of this name. Few items are sent to where the texts are; else both sides are shuffled."""
    found = common.cut(found)
    size = found.agg(F.count("*"), F.sum(F.size("items"))).first()
    few = size[0] <= 200_000 and (size[1] or 0) <= 1_000_000
    key = f"{column}_id"
    found = found.select(F.col("doc_id").alias(key), F.col("items").alias(column))
    return docs.join(F.broadcast(found) if few else found, docs["doc_id"].eqNullSafe(F.col(key)), "left").drop(key)


def repeats(docs: DataFrame, least_lines: int = 3, least_words: int = 40) -> DataFrame:
    """doc_id (never twice), items array<struct<first, last>>: the runs to delete from each document that has any."""
    chosen = common.cut(places(docs, least_lines, least_words))
    place = F.struct("doc_id", "place")
    shared = chosen.groupBy("mark").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter(~F.col("a").eqNullSafe(F.col("b"))).select("mark")
    held = common.salted_join(chosen, shared, ["mark"], "doc_id").groupBy("doc_id").agg(F.collect_set("place").alias("items"))
    near = common.cut(extended(beside(docs.select("doc_id", "text"), held, "shared_places"), "shared_places", least_lines, least_words))
    start = F.struct("doc_id", "first")
    earliest = near.groupBy("run").agg(F.min(start).alias("a"), F.max(start).alias("b")).filter(~F.col("a").eqNullSafe(F.col("b"))).select("run", "a")
    later = common.salted_join(near, earliest, ["run"], "doc_id").filter(~start.eqNullSafe(F.col("a")))
    return later.groupBy("doc_id").agg(F.collect_set(F.struct("first", "last")).alias("items"))


def kept(text: str | None, runs) -> tuple[str | None, int, int]:
    """What is left, lines, lines removed."""
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    blank = {i for i, x in enumerate(lines) if not x.strip(" \t\n\r\x0b\f")}
    gone = {i for r in (runs if runs is not None else []) for i in range(r["first"], r["last"] + 1)} - blank
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)


def dedup(docs: DataFrame, least_lines: int = 3, least_words: int = 40) -> DataFrame:
    """docs, all columns, texts without later repeated runs."""
    common.prepare(docs.sparkSession)
    runs = common.fresh(docs, "runs")

    @F.pandas_udf("string")
    def left_text(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([x if r is None else kept(x, r)[0] for x, r in zip(text, found, strict=True)], dtype=object)

    text = F.when(F.col(runs).isNull(), F.col("text")).otherwise(left_text("text", runs))
    return beside(docs, repeats(docs, least_lines, least_words), runs).withColumn("text", text).select(*docs.columns)


def report(docs: DataFrame, least_lines: int = 3, least_words: int = 40) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the UTF-8 text left; null: empty) of each row."""
    common.prepare(docs.sparkSession)

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            done = [kept(x or "", r) for x, r in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True)]
            return {"doc_id": batch.column("doc_id"), "n_lines": [x[1] for x in done], "n_removed": [x[2] for x in done], "kept_sha256": [hashlib.sha256(x[0].encode("utf-8", "surrogatepass")).hexdigest() for x in done]}

        return work

    rows = docs.select("doc_id", "text")
    return common.per_batch(beside(rows, repeats(rows, least_lines, least_words), "runs"), make, "doc_id long, n_lines long, n_removed long, kept_sha256 string")


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    return report(common.read(spark, sf_dir, "documents"))


SQL = r"""
WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
pos AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM raw),
line AS (SELECT doc_id, i, trim(line, E' \t\n\r\x0b\f') AS x, line FROM pos),
unit AS (SELECT doc_id, i, x, len(regexp_extract_all(x, '[^ \t\n\r\f\v]+')) AS w,
  lead(i, 1) OVER o AS i1, lead(i, 2) OVER o AS i2, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2
  FROM line WHERE x <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
sized AS (SELECT *, lead(w, 1) OVER (PARTITION BY doc_id ORDER BY i) AS w1 FROM unit),
win AS (SELECT doc_id, i AS first, i AS last, x AS body FROM sized WHERE w >= 40
  UNION ALL SELECT doc_id, i, i1, x || chr(10) || x1 FROM sized WHERE w + w1 >= 40
  UNION ALL SELECT doc_id, i, i2, x || chr(10) || x1 || chr(10) || x2 FROM sized WHERE i2 IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first) AS rn FROM win),
gone AS (SELECT DISTINCT l.doc_id, l.i FROM line l JOIN ranked r ON l.doc_id = r.doc_id AND r.rn > 1 AND l.i BETWEEN r.first AND r.last WHERE l.x <> '')
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(g.i)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(CASE WHEN g.i IS NULL THEN l.line END, chr(10) ORDER BY l.i), '')) AS kept_sha256
FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
"""

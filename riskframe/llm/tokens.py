"""Token ids of whole texts, and the Parquet token file (operator 3).

encode: a text is split before single blanks and line ends that stand between non-blank characters. No token of the
supported tokenizers spans such a place, so the ids of a text are those of its chunks in order; each worker keeps the ids
of chunks it has met, those of a chunk and of the marks it ends in apart, and only new ones go to the tokenizer, plain
words many at a time as one text.

Token file: Parquet with one row per document in ascending doc_id order, ids as a list column. The writer's second
format version gives integer lists dictionary pages and delta-packed pages where the dictionary grows too large; the
size of row groups and pages is set, page indexes are written, so single documents and the small columns can be read
without the ids.

Defined results. Null text: empty, only the end id. Null doc_id: sorted first. Repeated doc_ids: by n_tokens, then
ids_crc32. Empty table: an empty file set and no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

END_ID = 1
#: What \s is to Python, two in a row, for Arrow's expressions, which read a text several times faster.
_BLANKS = f"[{''.join(c for c in map(chr, range(0x3001)) if c.isspace())}]{{2}}"
_PLACES = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Marks that are no letters or digits to any supported tokenizer, and what a chunk inside a text begins with.
_MARKS, _LEADS = ".,;:!?#$%&*()\"", (" ", "\n")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks(texts: list[str]) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The number of chunks of each text, and the chunks of all."""
    kind = pa.large_string()
    if any("\x00" in x for x in texts):
        lists = pa.array([_PLACES.split(x) for x in texts], pa.list_(kind))
    else:
        apart = pc.match_substring_regex(pa.array(texts, kind), _BLANKS).to_pylist()
        marked = ["\x00".join(_PLACES.split(x)) if two else x.replace(" ", "\x00 ").replace("\n", "\x00\n") for x, two in zip(texts, apart, strict=True)]
        lists = pc.split_pattern(pa.array(marked, kind), "\x00")
    return lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().dictionary_encode()


def without_marks(names: pa.Array) -> tuple[pa.DictionaryArray, pa.DictionaryArray]:
    """Chunks without the marks they end in, and these marks. Marks after a letter or digit are tokens apart, so a chunk has the ids of the one and then of the other; all else stays whole."""
    cores = pc.utf8_rtrim(names, _MARKS)
    last = pc.utf8_slice_codeunits(cores, -1).dictionary_encode()
    after = pa.array([x.isalnum() for x in last.dictionary.to_pylist()], pa.bool_()).take(last.indices)
    cut = pc.and_(after, pc.not_equal(pc.binary_length(cores), pc.binary_length(names)))
    marks = pc.replace_substring_regex(pc.if_else(cut, names, ""), f"(?s)^.*[^{re.escape(_MARKS)}]", "")
    return pc.if_else(cut, cores, names).dictionary_encode(), marks.dictionary_encode()


class Codes(dict):
    """Numbers chunks as they are met; new ones are listed."""

    def __init__(self):
        self.new: list[str] = []

    def of(self, chunks: pa.DictionaryArray) -> np.ndarray:
        names = chunks.dictionary.to_numpy(zero_copy_only=False)
        codes = np.fromiter(map(self.get, names, repeat(-1)), np.int64, len(names))
        if len(at := np.flatnonzero(codes < 0)):
            codes[at] = np.arange(len(self), len(self) + len(at))
            new = names[at].tolist()
            self.update(zip(new, codes[at].tolist(), strict=True))
            self.new += new
        return codes[chunks.indices.to_numpy()]


class Encoder:
    """Ids of texts by a tokenizer file, with the ids of about `keep` chunks kept; beyond that the half that was used most stays."""

    def __init__(self, path: str, keep: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keep = keep
        # added tokens may span the places where texts are split: a text that could hold one goes to the library whole
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.whole = re.compile("|".join(sorted(added, key=len, reverse=True)), re.IGNORECASE).search if added else lambda text: None
        # words joined into one text are told apart by the tokens that end a word, or begin with the blank before it
        suffix = self.tokenizer.model.end_of_word_suffix
        self.at_end = bool(suffix)
        self.edge = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.edge[[i for t, i in self.tokenizer.get_vocab().items() if (t.endswith(suffix) if suffix else t[:1] in ("\u0120", "\u010a"))]] = True
        self.clear()

    def clear(self) -> None:
        self.known = Codes()
        self.flat, self.starts, self.lengths = array("I"), array("q"), array("q")
        self.uses = np.zeros(0, np.int64)

    def shrink(self) -> None:
        often = np.argsort(-self.uses, kind="stable")[: self.keep // 2]
        often = often[self.uses[often] > 1]
        names = list(self.known)
        ids, before = self.gather(often)
        self.clear()
        self.known.update((names[c], i) for i, c in enumerate(often.tolist()))
        self.flat.frombytes(ids.tobytes())
        self.starts.frombytes(before[:-1].astype(np.int64).tobytes())
        self.lengths.frombytes(np.diff(before).astype(np.int64).tobytes())

    def learn(self) -> None:
        """Ids of the new chunks."""
        known, words, codes, rest = self.known, [], [], []
        for code, c in enumerate(known.new, len(self.starts)):
            if c[1:].isalpha() and c[0] in _LEADS:
                words.append(c)
                codes.append(code)
            else:
                rest.append((c, code))
        more = bytes(8 * (len(known) - len(self.starts)))
        self.starts.frombytes(more)
        self.lengths.frombytes(more)
        starts, lengths = np.frombuffer(self.starts, np.int64), np.frombuffer(self.lengths, np.int64)
        of_words = np.array(codes, np.int64)
        for at in range(0, len(words), 64 * 256):
            places = range(at, min(at + 64 * 256, len(words)), 64)
            joined = ["".join(words[i : i + 64]) for i in places]
            for i, found in zip(places, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
                ids, group = np.array(found.ids, np.uint32), of_words[i : i + 64]
                marks = np.flatnonzero(self.edge[ids])
                if len(marks) == len(group):  # every word has an edge at least, so each has one
                    begin = np.append(0, marks[:-1] + 1) if self.at_end else marks
                    starts[group], lengths[group] = begin + len(self.flat), np.diff(begin, append=len(ids))
                    self.flat.frombytes(ids.tobytes())
                else:
                    rest.extend(zip(words[i : i + 64], group.tolist(), strict=True))
        for at in range(0, len(rest), 10_000):
            part = rest[at : at + 10_000]
            for (_, code), found in zip(part, self.tokenizer.encode_batch_fast([c for c, _ in part], add_special_tokens=False), strict=True):
                ids = found.ids
                starts[code], lengths[code] = len(self.flat), len(ids)
                self.flat.extend(ids)
        known.new.clear()

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks in a row, and how many of them are before each chunk and after all."""
        flat, starts, lengths = (np.frombuffer(x, t) for x, t in ((self.flat, np.uint32), (self.starts, np.int64), (self.lengths, np.int64)))
        n = lengths[codes]
        before = np.concatenate(([0], np.cumsum(n)))
        return flat[np.repeat(starts[codes] - before[:-1], n) + np.arange(before[-1])], before

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, END_ID after each text, and the number of ids of each text: those of the library, added tokens included."""
        if apart := [i for i, x in enumerate(texts) if self.whole(x)]:
            kept = set(apart)
            flat, n = self.encode_plain(["" if i in kept else x for i, x in enumerate(texts)])
            parts = np.split(flat, np.cumsum(n)[:-1])
            for i, found in zip(apart, self.tokenizer.encode_batch_fast([texts[i] for i in apart], add_special_tokens=False), strict=True):
                parts[i] = np.array([*found.ids, END_ID], np.uint32)
            return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return self.encode_plain(texts)

    def encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """encode() for texts without added tokens."""
        if len(self.known) > self.keep:
            self.shrink()
        count, found = chunks(texts)
        cores, marks = without_marks(found.dictionary)
        codes = np.stack((self.known.of(cores), self.known.of(marks)), 1)[found.indices.to_numpy()].ravel()
        if self.known.new:
            gc.disable()  # many short-lived objects, none of them in cycles
            try:
                self.learn()
            finally:
                gc.enable()
        uses = np.bincount(codes, minlength=len(self.known))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        ids, before = self.gather(codes)
        ends = before[2 * np.cumsum(count)]  # of each text, among ids
        return np.insert(ids, ends, END_ID).astype(np.uint32), np.diff(ends, prepend=0) + 1


_ENCODERS: dict[tuple[str, int], Encoder] = {}
#: Chunks that an encoder keeps; with 800 000 it takes about 180 MB, with 200 000 about 70 MB and a third more time.
KEEP = 800_000


def encoder(path: str, keep: int = KEEP) -> Encoder:
    """One per worker process, kept between tasks."""
    if (path, keep) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, keep] = Encoder(path, keep)
    return _ENCODERS[path, keep]


def id_kind(path: str) -> str:
    """The numpy type of an id. For the driver, which needs no encoder."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids.astype(np.int32)))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, n_tokens, ids_crc32 of every row of docs(doc_id, text), in the order of the rows."""

    def make():
        use = encoder(path)

        def work(batch: pa.RecordBatch) -> dict:
            ids, counts = use.encode([x or "" for x in batch.column("text").to_pylist()])
            ends = np.cumsum(counts)
            return {"doc_id": batch.column("doc_id"), "ids": lists(ids, counts), "n_tokens": counts, "ids_crc32": [crc(ids[e - n : e]) for e, n in zip(ends, counts, strict=True)]}

        return work

    return common.per_batch(docs.select("doc_id", "text"), make, "doc_id long, ids array<int>, n_tokens long, ids_crc32 long")


def write(docs: DataFrame, path: str, folder: str, partitions: int, row_group_mb: int = 8, page_kb: int = 256) -> None:
    """Write the token file of docs into folder. Files are ranges of doc_id; `part` numbers them in that order."""
    ordered = docs.select("doc_id", common.text_of().alias("text")).repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id")
    rows = encoded(ordered, path).withColumn("part", F.spark_partition_id())
    options = {
        "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.block.size": str(row_group_mb << 20), "parquet.page.size": str(page_kb << 10),
        "parquet.page.row.count.limit": "2000", "compression": "zstd",
    }
    rows.write.options(**options).mode("overwrite").parquet(folder)


SCHEMA = "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, part int"


def read_back(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as the file has them: the checksum is taken anew of the ids read.

    start is a prefix sum in two steps: each file's tokens before it (one row a file), and those before the document in
    its file; only numbers are shuffled.
    """

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            ids = batch.column("ids")
            flat, ends = ids.flatten().to_numpy(zero_copy_only=False).astype(np.uint32), np.cumsum(n := ids.value_lengths().to_numpy(zero_copy_only=False))
            return {"doc_id": batch.column("doc_id"), "n_tokens": n, "ids_crc32": [crc(flat[e - k : e]) for e, k in zip(ends, n, strict=True)], "part": batch.column("part")}

        return work

    file = spark.read.schema(SCHEMA).parquet(folder)
    seen = common.per_batch(file.select("doc_id", "ids", "part"), make, "doc_id long, n_tokens long, ids_crc32 long, part int")
    totals = file.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))  # one row a file
    base = totals.withColumn("base", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    in_file = Window.partitionBy("part").orderBy("doc_id", "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    rows = seen.withColumn("within", F.coalesce(F.sum("n_tokens").over(in_file), F.lit(0)))
    return rows.join(F.broadcast(base.select("part", "base")), "part").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_file(docs: DataFrame, path: str) -> DataFrame:
    spark = docs.sparkSession
    common.prepare(spark)
    folder = common.shared_folder(spark)
    write(docs, path, folder, max(2, docs.rdd.getNumPartitions()))
    return read_back(spark, folder)


def op3_token_file(spark, sf_dir: str) -> DataFrame:
    return token_file(common.read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))

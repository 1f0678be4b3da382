"""Recorded runs as JSON envelopes: reading, and writing whole files at once."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGES = "array<struct<start:int,end:int>>"
SIGNALS = "struct<nesting:bigint,lines:bigint,bumps:bigint,bool_ops:bigint,stubs:bigint,panics:bigint>"
ENTRY = f"struct<file:string,function:string,line:bigint,cyclomatic:double,coverage:double,crap:double,crate:string,uncovered:{RANGES},signals:{SIGNALS}>"
GROUPS = "array<struct<members:array<struct<file:string,name:string,start_line:bigint,end_line:bigint>>,score:double>>"
ENVELOPE = f"version string, entries array<{ENTRY}>, try_weight double, duplicate_groups {GROUPS}"


def envelope(spark: SparkSession, path: str) -> DataFrame:
    """One row a file; keys that are not known are ignored, absent ones are null (no groups is not the same as an empty list)."""
    return spark.read.schema(ENVELOPE).json(path, multiLine=True, mode="FAILFAST")


def entries(found: DataFrame) -> DataFrame:
    """The entries of envelopes, in their order (ord). Signals that a signals record leaves out read 0."""
    rows = found.select(F.posexplode("entries").alias("ord", "e")).select(F.col("ord").cast("long").alias("ord"), "e.*")
    filled = F.struct(*[F.coalesce(F.col(f"signals.{s}"), F.lit(0)).alias(s) for s in ("nesting", "lines", "bumps", "bool_ops", "stubs", "panics")])
    return rows.withColumn("signals", F.when(F.col("signals").isNotNull(), filled))


def try_weight(found: DataFrame) -> float:
    row = found.select(F.coalesce("try_weight", F.lit(1.0))).first()
    return row[0] if row else 1.0


def entry_json(rows: DataFrame) -> DataFrame:
    """ord, json of each entry: built where the rows are; null fields stay out, except the coverage, whose absence means unknown."""
    fields = [c for c in ("file", "function", "line", "cyclomatic", "coverage", "crap", "crate", "uncovered", "signals", "baseline_crap", "delta", "status", "previous_file", "reasons") if c in rows.columns]
    return rows.select("ord", F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("json"))


def write_report(rows: DataFrame, path: str, version: str, **more: object) -> None:
    """An envelope file of all entries in the order of ord. The rows are streamed through the driver, a partition at a time. `more`: further keys; those that are None stay out."""
    kept = {k: v for k, v in more.items() if v is not None}

    def pieces() -> Iterable[str]:
        yield '{\n  "version": ' + json.dumps(version) + ',\n  "entries": ['
        for k, row in enumerate(entry_json(rows).orderBy("ord").select("json").toLocalIterator()):
            yield (",\n    " if k else "\n    ") + row[0]
        yield "\n  ]" + "".join(f",\n  {json.dumps(k)}: {json.dumps(v)}" for k, v in kept.items()) + "\n}\n"

    write_whole(path, pieces())


def write_whole(path: str, pieces: Iterable[str]) -> None:
    """Write a local file so that a reader sees the old one or all of the new one."""
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with open(draft, "w", encoding="utf-8", newline="") as out:
            for piece in pieces:
                out.write(piece)
            out.flush()
            os.fsync(out.fileno())
        os.replace(draft, path)
    finally:
        if os.path.exists(draft):
            os.remove(draft)


def read_patiently(path: str, tries: int = 5, pause: float = 0.002) -> str:
    """A file's text; a denied read is tried again, as another process may be replacing the file."""
    for k in range(tries):
        try:
            with open(path, encoding="utf-8") as f:
                return f.read()
        except PermissionError:
            if k + 1 == tries:
                raise
            time.sleep(pause)
    raise AssertionError("unreachable")


def span_text(texts: DataFrame) -> DataFrame:
    """body of rows(text, start_line, end_line): those lines, line ends as LF. A span outside the text is an error."""
    lines = F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n")
    good = (F.col("start_line") >= 1) & (F.col("start_line") <= F.col("end_line")) & (F.col("end_line") <= F.size(lines))
    body = F.array_join(F.slice(lines, F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    wrong = F.raise_error(F.concat(F.lit("no such lines: "), F.col("start_line").cast("string"), F.lit(".."), F.col("end_line").cast("string")))
    return texts.withColumn("body", F.when(good, body).otherwise(wrong.cast("string")))

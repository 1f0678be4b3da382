"""Source files: the walk, and their functions, measures and shapes by the parser in `code`, a file a row."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import SIGNALS
from ..functions import paths

RANGES = "array<struct<start:int,end:int>>"
FUNCTIONS = (
    "name:string,start_line:int,end_line:int,decisions:bigint,tries:bigint,"
    f"signals:struct<{','.join(f'{s}:bigint' for s in SIGNALS)}>,spans:struct<{','.join(f'{s}:{RANGES}' for s in SIGNALS)}>"
)
SHAPES = "name:string,start_line:int,end_line:int,node_count:bigint,shapes:array<bigint>"


def walk(spark: SparkSession, root: str, ignored: list[str] = ()) -> DataFrame:
    """file, text of the .rs files below a folder: none under hidden folders, none that an ignore glob matches, below the root."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString().rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.rs").load(root)
    below = F.when(F.col("path").startswith(top), F.substring("path", len(top) + 1, 1 << 30)).otherwise(F.col("path"))
    hidden = F.exists(paths.parts(F.col("file")), lambda p: p.startswith("."))
    out = found.select(below.alias("file"), F.col("content").cast("string").alias("text")).filter(~hidden)
    for glob in ignored:
        out = out.filter(~F.col("file").rlike(paths.glob_regex(glob)))
    return out


class Pieces:
    """Rows of one file, in pieces of Arrow that go to a temporary file if they are many: a file may fail at its end, and then none counts."""

    def __init__(self, kind: pa.DataType, many: int = 1000, held: int = 16 << 20):
        self.kind, self.many, self.most, self.rows, self.schema = kind, many, held, [], pa.schema([("found", kind)])
        self.spool, self.writer = tempfile.SpooledTemporaryFile(held), None

    def put(self, row: dict) -> None:
        self.rows.append(row)
        if len(self.rows) == self.many:
            self.flush()

    def flush(self) -> None:
        self.writer = self.writer or pa.ipc.new_stream(self.spool, self.schema)
        self.writer.write_batch(pa.RecordBatch.from_arrays([pa.array(self.rows, self.kind)], schema=self.schema))
        self.rows = []

    def read(self) -> Iterator[pa.Array]:
        """The pieces in order, at least one."""
        if self.writer:
            self.writer.close()
            self.spool.seek(0)
            for batch in pa.ipc.open_stream(self.spool):
                yield batch.column(0)
        if self.rows or not self.writer:
            yield pa.array(self.rows, self.kind)


def per_file(files: DataFrame, read: Callable[[str, Callable[[dict], None]], None], item: str) -> DataFrame:
    """file, error, start, found of files(file, text): what read() puts, start rows before it, or why a text could not be read. A file that fails does not stop the others.

    A file's rows come in pieces, each a row here, so that a long file is held neither as tokens nor as one list.
    """
    struct = T._parse_datatype_string(f"file string, error string, start bigint, found array<struct<{item}>>")
    schema = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, names, errors, starts, found, held = schema.field(3).type, [], [], [], [], 0

        def out() -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, found))], pa.int32()), pa.concat_arrays(found)).cast(kind)
            return pa.RecordBatch.from_arrays([pa.array(names, schema.field(0).type), pa.array(errors, schema.field(1).type), pa.array(starts, schema.field(2).type), lists], schema=schema)

        for batch in batches:
            for name, text in zip(batch.column("file"), batch.column("text"), strict=True):
                pieces, error = Pieces(kind.value_type), None
                try:
                    read(text.as_py() or "", pieces.put)
                except (ValueError, RecursionError) as e:
                    pieces, error = Pieces(kind.value_type), str(e) or type(e).__name__
                start = 0
                for piece in pieces.read():
                    names.append(name.as_py())
                    errors.append(error)
                    starts.append(start)
                    found.append(piece)
                    start, held = start + len(piece), held + len(piece) + 1
                    if held > 1000:
                        yield out()
                        names, errors, starts, found, held = [], [], [], [], 0
        if names:
            yield out()

    return files.select("file", "text").mapInArrow(run, struct)


def parsed(files: DataFrame) -> DataFrame:
    """file, error, start, found (functions)."""

    def read(text: str, put: Callable[[dict], None]) -> None:
        from ..code.measures import each, function_rows

        def spread(f: dict) -> None:
            f["spans"] = {k: [{"start": a, "end": b} for a, b in v] for k, v in f["spans"].items()}
            put(f)

        each(text, function_rows, spread)

    return per_file(files, read, FUNCTIONS)


def measured(found: DataFrame, try_weight: Column | float = 1.0) -> DataFrame:
    """The functions of parsed() and their place in the file. The weight of a ? is applied here, so another weight needs no new parse."""
    rows = found.select("file", "start", F.posexplode("found").alias("at", "f")).select("file", (F.col("start") + F.col("at")).alias("place"), "f.*")
    weight = F.lit(try_weight) if isinstance(try_weight, int | float) else try_weight
    return rows.withColumn("cc", F.lit(1.0) + F.col("decisions") + weight * F.col("tries"))


def functions(found: DataFrame, try_weight: Column | float = 1.0) -> DataFrame:
    """measured() with ord, which follows file and place. The sort samples its input, so a parse before it is run twice; who needs no ord takes measured()."""
    return measured(found, try_weight).orderBy("file", "place").withColumn("ord", F.monotonically_increasing_id()).drop("place")


def warnings(found: DataFrame) -> DataFrame:
    return found.filter("error IS NOT NULL").select("file", "error")


def shapes(files: DataFrame) -> DataFrame:
    """file, name, start_line, end_line, node_count, shapes of every function, nested ones too."""

    def read(text: str, put: Callable[[dict], None]) -> None:
        from ..code.measures import each, shape_rows

        each(text, shape_rows, put)

    return per_file(files, read, SHAPES).select("file", F.explode("found").alias("f")).select("file", "f.*")

"""What the operators share: reading tables, the shared folder, cutting lineage, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts handed to Python at once; bounds a worker's memory together with the length of the texts.
BATCH_ROWS = 1000
#: The folder of a local session without spark.checkpoint.dir.
_LOCAL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, so that long texts do not pile up in a worker; the driver drops what the operator before left."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    settle(spark)


def settle(spark: SparkSession) -> None:
    """On the driver, between steps: give back the memory of finished queries, in Python and in the JVM. A collection there also lets Spark delete the broadcasts and shuffles that nothing refers to any more, on the executors too."""
    from py4j.protocol import Py4JJavaError

    release()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    jvm.java.lang.System.gc()
    # what planning and compiling took outside the Java heap: the JVM's own command, called by its public interface
    of_class, none = jvm.java.lang.Class.forName, gateway.new_array(jvm.java.lang.Object, 0)
    kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    types, given = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    for i, (kind, x) in enumerate(zip(kinds, (jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", none, gateway.new_array(jvm.java.lang.String, 0)), strict=True)):
        types[i], given[i] = of_class(kind), x
    try:
        of_class("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JJavaError:  # a JVM without that command keeps the memory
        pass


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that the driver and all executors share: spark.checkpoint.dir. Where that is unset, local mode takes a temporary one; a cluster has none, so it is an error there."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get("base")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _LOCAL["base"] = f"file://{tempfile.mkdtemp(prefix='riskframe-')}"
    return f"{base.rstrip('/')}/riskframe-{uuid.uuid4().hex}"


def cut(df: DataFrame, **options: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what cut() wrote for df, once nothing reads it any more."""
    if path := getattr(df, "written_to", None):
        jvm = df.sparkSession._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def per_batch(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """mapInArrow with one state per task: make() gives the function that turns a batch into columns."""
    struct = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                columns = work(batch)
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)
                del columns
        del work, batches
        release()

    return df.mapInArrow(run, struct)


def release() -> None:
    """At the end of a task: give the memory of its caches back to the system, as the worker process stays for other tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def kept_rows(df: DataFrame, column: str, make: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows of df, all columns, that make()'s function of the values of one column keeps. Batches go through as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(keep(batch.column(column).to_pylist()), pa.bool_()))
        del keep, batches
        release()

    return df.mapInArrow(run, df.schema)


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken or f"{name}_id" in taken:
        name += "_"
    return name


def text_of(column: str = "text"):
    """The text, empty for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def salted_join(big: DataFrame, keyed: DataFrame, keys: list[str], by: str, salts: int = 8, how: str = "inner") -> DataFrame:
    """big join keyed, where keyed has one row a key: it is repeated under every salt, so the rows of a hot key of big spread over `salts` tasks."""
    spread = keyed.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(spread, [*keys, "_salt"], how).drop("_salt")


def pyarrow_place(uri: str):
    """File system and path of a folder that Spark names; for workers, which read and write the shared folder with pyarrow."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = uri.replace("file:", "file://", 1)
    for spark_name, name in (("s3a://", "s3://"), ("s3n://", "s3://")):
        uri = name + uri[len(spark_name) :] if uri.startswith(spark_name) else uri
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_beside(rows: DataFrame) -> str:
    """Write rows that have a column part, which the rows of a table have too, a folder for each part."""
    folder = shared_folder(rows.sparkSession)
    rows.repartition("part").write.partitionBy("part").parquet(folder)
    return folder


def rows_beside(folder: str, part: int) -> pa.Table | None:
    """In a task: what write_beside() has for a part. Texts are thus joined with their rows where they are read, without a shuffle or a broadcast."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, top = pyarrow_place(folder)
    files = system.get_file_info(fs.FileSelector(f"{top}/part={part}", allow_not_found=True))
    tables = [pq.ParquetFile(system.open_input_file(f.path)).read() for f in files if f.path.endswith(".parquet")]
    return pa.concat_tables(tables) if tables else None


class Beside:
    """What load() gives for a part; the last one is held, as the rows of a part lie together."""

    def __init__(self, load: Callable[[int], tuple]):
        self.load, self.part, self.held = load, None, ()

    def __call__(self, part: int) -> tuple:
        if part != self.part:
            self.held = ()
            self.part, self.held = part, self.load(part)
        return self.held


def by_part(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The slices of a batch with one value of its column part."""
    import numpy as np

    parts = batch.column("part").to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield int(parts[a]), batch.slice(a, b - a)

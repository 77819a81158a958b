"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows and bytes in one Arrow batch. Texts average a few KB and may be far longer, so batches are kept small.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound an Arrow batch by rows and bytes, and with it the memory of a Python worker and of the JVM beside it.

    Spark reads these settings when the plan runs, which may be in the caller's hands, so they stay set.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def schema_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], ddl: str, binary: tuple[str, ...] = ()) -> DataFrame:
    """mapInArrow over column lists.

    ``make()`` is called once a task and returns the function of a batch (a dict of lists in, a dict of lists or
    arrays out). Columns in ``binary`` arrive as UTF-8 bytes without a detour over str.
    """
    small_batches(df.sparkSession)
    schema = schema_of(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if not b.num_rows:
                continue
            cols = {}
            for name, col in zip(b.schema.names, b.columns, strict=True):
                if name in binary:
                    col = col.cast(pa.binary()) if not pa.types.is_large_string(col.type) else col.cast(pa.large_binary())
                cols[name] = col.to_pylist()
            out = f(cols)
            yield pa.RecordBatch.from_arrays([pa.array(out[x.name], type=x.type) for x in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def crc32_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(m)


def filter_texts(df: DataFrame, text: str, make: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows whose text passes; ``make()`` gives a task's function from texts to whether each stays."""
    small_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(f(b.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go when the query ends; a retry within a query still finds them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Bytes of input for each key range, so that a range's keys fit a worker whatever the input.
RANGE_BYTES = 8 << 20


def input_bytes(docs: DataFrame) -> int | None:
    """The planner's size of what docs is read from; None where it has none, as for rows of the driver."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return None if size >= 1 << 50 else size


def key_ranges(docs: DataFrame) -> int:
    """The number of ranges that keys are dealt to: by the input's bytes, and spark.sql.shuffle.partitions at least."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(input_bytes(docs) or 0) // RANGE_BYTES))


def fresh_name(docs: DataFrame, name: str) -> str:
    """The name, or the name with underscores until no column of docs is called so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


class SharedTables:
    """Large intermediate results as Parquet in the shared folder, which cuts their lineage as a checkpoint does but
    compressed; ``drop`` deletes them when the result no longer needs them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tables-{uuid.uuid4()}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def drop(self, name: str | None = None) -> None:
        """One table, or the folder."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def even_labels(n: int) -> list[int]:
    """Numbers that ``repartition(n, column)`` puts one into each of n partitions, in the partitions' order.

    The rule is Spark's hash of an int (Murmur3 with seed 42), modulo n.
    """
    m = 0xFFFFFFFF

    def rotated(x: int, r: int) -> int:
        return (x << r | x >> (32 - r)) & m

    found: dict[int, int] = {}
    k = 0
    while len(found) < n:
        h = rotated(42 ^ (rotated(k * 0xCC9E2D51 & m, 15) * 0x1B873593 & m), 13) * 5 + 0xE6546B64 & m
        h ^= 4
        h = (h ^ h >> 16) * 0x85EBCA6B & m
        h = (h ^ h >> 13) * 0xC2B2AE35 & m
        h ^= h >> 16
        found.setdefault((h - (1 << 32) if h >> 31 else h) % n, k)
        k += 1
    return [found[p] for p in range(n)]

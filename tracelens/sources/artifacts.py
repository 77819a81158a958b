"""Run artifacts: summaries, samples and tokens as JSON, ragged caches, and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelens import schemas

CORRUPT = "_corrupt_record"


def _filesystem(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def artifact_paths(spark: SparkSession, root: str, name: str) -> list[str]:
    """Files of the name below a folder, and folders of it that Spark has written; one or two a run."""
    fs, where = _filesystem(spark, root)
    if not fs.exists(where):
        return []
    found, files = set(), fs.listFiles(where, True)
    while files.hasNext():
        path = files.next().getPath()
        if path.getName() == name:
            found.add(path.toString())
        elif path.getParent().getName() == name and path.getName().startswith("part-"):
            found.add(path.getParent().toString())
    return sorted(found)


def _json(spark: SparkSession, root: str, name: str, schema: StructType, multiline: bool = False) -> DataFrame:
    with_corrupt = StructType(list(schema.fields)).add(CORRUPT, "string")
    reader = spark.read.schema(with_corrupt).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", multiline)
    paths = artifact_paths(spark, root, name)
    if not paths:
        return spark.createDataFrame([], with_corrupt.add("file", "string"))
    return reader.json(paths).withColumn("file", F.col("_metadata.file_path"))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file, by the driver."""
    fs, where = _filesystem(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def load_summaries(spark: SparkSession, root: str) -> DataFrame:
    """The methods of every summary.json below a folder, with the file."""
    files = _json(spark, root, "summary.json", schemas.SUMMARY_FILE, multiline=True)
    return files.where("methods is not null").select("file", F.inline("methods"))


def load_samples(spark: SparkSession, root: str) -> DataFrame:
    """Well-formed lines of every samples.jsonl below a folder."""
    return _json(spark, root, "samples.jsonl", schemas.SAMPLES).where(f"{CORRUPT} is null and method is not null").drop(CORRUPT)


def load_tokens(spark: SparkSession, root: str, columns: list[str] | None = None) -> DataFrame:
    """Well-formed lines of every tokens.jsonl; only the columns asked for are parsed."""
    wanted = StructType([f for f in schemas.TOKENS.fields if columns is None or f.name in columns])
    return _json(spark, root, "tokens.jsonl", wanted).where(f"{CORRUPT} is null and method is not null").drop(CORRUPT)


def malformed_lines(spark: SparkSession, root: str, name: str = "tokens.jsonl") -> DataFrame:
    """(file, malformed) of files with lines that do not parse."""
    paths = artifact_paths(spark, root, name)
    if not paths:
        return spark.createDataFrame([], "file string, malformed long")
    lines = spark.read.text(paths).withColumn("file", F.col("_metadata.file_path"))
    parsed = F.try_parse_json("value") if hasattr(F, "try_parse_json") else F.from_json("value", "map<string,string>")
    return lines.where("value <> ''").groupBy("file").agg(F.count_if(parsed.isNull()).alias("malformed")).where("malformed > 0")


def sample_xy(samples: DataFrame, x: str, y: str) -> DataFrame:
    """(method, x, y) of rows that have both."""
    return samples.select("method", F.col(x).alias("x"), F.col(y).alias("y")).dropna(subset=["x", "y"])


def field(rows: DataFrame, name: str) -> DataFrame:
    """(method, value); raises for a column that is not there."""
    if name not in rows.columns:
        raise KeyError(name)
    return rows.select("method", F.col(name).alias("value"))


def artifact_folders(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(folder): folders named artifacts that hold a file of the name, in order."""
    found = sorted({p.rsplit("/", 1)[0] for p in artifact_paths(spark, root, name)})
    return spark.createDataFrame([(p,) for p in found if p.endswith("/artifacts")], "folder string")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_curve_csv(summaries: DataFrame, path: str) -> None:
    from tracelens.operators.reporting import curve_csv

    curve_csv(summaries, schemas.CURVE).write.mode("overwrite").option("header", True).csv(path)


def summary_document(summaries: DataFrame, metric: str = "logprob", normalize: bool = True) -> DataFrame:
    """(value): the summary file as one JSON text; one row a method goes into it."""
    methods = F.array_sort(F.collect_list(F.struct(*summaries.columns)))
    return summaries.agg(F.to_json(F.struct(F.lit(metric).alias("metric"), F.lit(normalize).alias("normalize_by_length"), methods.alias("methods"))).alias("value"))


def write_run(folder: str, samples: DataFrame, summaries: DataFrame, tokens: DataFrame | None = None, metric: str = "logprob", normalize: bool = True) -> None:
    """A run's artifacts: samples.jsonl, tokens.jsonl if given, and summary.json last, so that its presence says the run is whole.

    Rows are written by the tasks that score them; one row a method comes to the driver for the summary.
    """
    if tokens is not None:
        write_jsonl(tokens.select(*[f.name for f in schemas.TOKENS.fields if f.name in tokens.columns]), f"{folder}/artifacts/tokens.jsonl")
    write_jsonl(samples.select(*[f.name for f in schemas.SAMPLES.fields if f.name in samples.columns]), f"{folder}/artifacts/samples.jsonl")
    text = summary_document(summaries, metric, normalize).first()["value"]
    write_text(summaries.sparkSession, f"{folder}/artifacts/summary.json", text)


def token_statistics(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(moments, histogram, files with malformed lines) over all token files below a folder."""
    from tracelens.operators import summary

    rows = load_tokens(spark, root, ["method", "logprob"])
    return summary.moments(rows), summary.histogram(rows), malformed_lines(spark, root)


def save_entropies(series: DataFrame, path: str) -> None:
    """Ragged arrays as (sample_index, entropies, cot_length), ordered within files."""
    series.select("sample_index", F.col("entropies").cast("array<float>").alias("entropies"), F.size("entropies").alias("cot_length")).repartitionByRange("sample_index").sortWithinPartitions("sample_index").write.mode("overwrite").parquet(path)


def load_entropies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ENTROPIES).parquet(path)


def ragged_offsets(series: DataFrame, values: str = "entropies", key: str = "sample_index", width: int = 1024) -> DataFrame:
    """(key, len, off): lengths and running offsets of a flat layout, by key.

    Sums of ``width`` keys in a row, of ``width`` such sums and so on are added up level by level, so no window sees more
    than ``width`` groups, but for the last level over ``width`` ** 3 keys each.
    """
    from pyspark.sql import Window

    sizes = series.select(key, F.size(values).cast("long").alias("len"))
    rows = sizes.select(key, "len", *[F.floor(F.col(key) / F.lit(width**k)).cast("long").alias(f"_g{k}") for k in (1, 2, 3)])
    level = rows.groupBy("_g1", "_g2", "_g3").agg(F.sum("len").alias("_s"))
    running = lambda c, w: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(c)
    top = level.groupBy("_g3").agg(F.sum("_s").alias("_t")).withColumn("_o3", running("_t", Window.orderBy("_g3")))
    middle = level.groupBy("_g2", "_g3").agg(F.sum("_s").alias("_t")).withColumn("_o2", running("_t", Window.partitionBy("_g3").orderBy("_g2")))
    low = level.withColumn("_o1", running("_s", Window.partitionBy("_g2").orderBy("_g1")))
    before = low.join(middle.select("_g2", "_o2"), "_g2").join(top.select("_g3", "_o3"), "_g3").select("_g1", (F.col("_o1") + F.col("_o2") + F.col("_o3")).alias("_before"))
    own = rows.withColumn("_own", running("len", Window.partitionBy("_g1").orderBy(key)))
    return own.join(before, "_g1").select(key, "len", (F.col("_own") + F.col("_before")).cast("long").alias("off"))


def read_through(cache: DataFrame, wanted: DataFrame, compute, key: str = "sample_index") -> DataFrame:
    """Cached rows of the wanted keys, with the missing ones computed; the cache itself is left as it is."""
    missing = wanted.join(cache, key, "left_anti")
    return cache.join(wanted, key, "left_semi").unionByName(compute(missing))

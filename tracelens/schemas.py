"""Fixed schemas of the tables that the engine reads and writes."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType


def _fields(kind, *names: str) -> list[StructField]:
    return [StructField(n, kind) for n in names]


# The names and types of run artifacts.
CHAT = StructType([StructField("messages", ArrayType(StructType(_fields(StringType(), "role", "content")))), *_fields(StringType(), "dataset_source", "id")])
SAMPLES = StructType(
    [
        *_fields(StringType(), "method"),
        *_fields(LongType(), "sample_index"),
        *_fields(StringType(), "sample_id", "dataset_source"),
        *_fields(IntegerType(), "answer_tokens"),
        *_fields(DoubleType(), "logprob_sum", "logprob_mean"),
        *_fields(IntegerType(), "compressed_cot_tokens"),
        *_fields(DoubleType(), "compression_ratio"),
    ]
)
TOKENS = StructType([*_fields(StringType(), "method"), *_fields(LongType(), "sample_index"), *_fields(IntegerType(), "token_index", "token_id"), *_fields(DoubleType(), "logprob")])
SUMMARY = StructType(
    [
        *_fields(StringType(), "method", "method_family", "patching", "patching_param", "compression_param"),
        *_fields(IntegerType(), "samples", "skipped"),
        *_fields(DoubleType(), "mean_logprob", "std_logprob", "sem_logprob", "mean_logprob_sum", "mean_answer_tokens", "mean_compression_ratio", "std_compression_ratio", "mean_compressed_cot_tokens"),
    ]
)
SUMMARY_FILE = StructType([*_fields(StringType(), "metric"), *_fields(BooleanType(), "normalize_by_length"), StructField("methods", ArrayType(SUMMARY))])
ENTROPIES = StructType([*_fields(LongType(), "sample_index"), StructField("entropies", ArrayType(FloatType())), *_fields(IntegerType(), "cot_length")])
#: Columns of the compression-curve CSV, in order.
CURVE = ["method", "method_family", "patching", "patching_param", "mean_compression_ratio", "std_compression_ratio", "mean_compressed_cot_tokens", "mean_logprob", "sem_logprob", "samples"]

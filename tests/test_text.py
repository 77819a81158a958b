import pytest
from pyspark.sql import functions as F
from tracelens.functions import text as T
from tracelens.operators import corpus

def char_tokens(text, special):
    """Characters, with special tokens matched longest first."""
    out, at, names = [], 0, sorted(special, key=len, reverse=True)
    while at < len(text):
        hit = next((s for s in names if text.startswith(s, at)), text[at])
        out.append((hit, at, at + len(hit)))
        at += len(hit)
    return out


SCHEMA = "id int, messages array<struct<role:string,content:string>>"


def chats(spark, *messages):
    return spark.createDataFrame([(i, [tuple(x) for x in m] if m is not None else None) for i, m in enumerate(messages)], SCHEMA)


def test_valid_messages(spark):
    ok, empty, nobody, none, null = [("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "")], [("user", "a")], [], None
    got = [r[0] for r in chats(spark, ok, empty, nobody, none, null).orderBy("id").select(T.valid_messages(F.col("messages"))).collect()]
    assert got == [True, False, False, False, False]
    with pytest.raises(Exception):
        chats(spark, nobody).select(T.checked_messages(F.col("messages"))).collect()


@pytest.mark.parametrize("content,want", [("<think>Trace</think>\nAnswer", ("<think>Trace</think>", "Answer")), ("No trace", None), ("<think>x</think>", None), ("<think>x", None), ("</think><think>a</think> b", ("<think>a</think>", "b"))])
def test_trace_parts(spark, content, want):
    r = spark.createDataFrame([(content,)], "c string").select(T.trace_parts(F.col("c")).alias("p")).first().p
    assert (tuple(r) if r else None) == want


def test_replace_keeps_tags_and_other_messages(spark):
    df = chats(spark, [("user", "q"), ("assistant", "<think>Trace</think>\nAnswer")])
    out = df.select(T.replace_trace(F.col("messages"), F.lit(1), T.placeholders(F.lit(2))).alias("m")).first().m
    assert [tuple(x) for x in out] == [("user", "q"), ("assistant", "<think><|slot|><|slot|></think>\nAnswer")]


def test_answer_span_in_first_assistant_that_has_it(spark):
    df = chats(spark, [("user", "x"), ("assistant", "say Answer"), ("user", "y"), ("assistant", "<think>t</think> Answer")])
    r = df.withColumn("t", T.render(F.col("messages"))).select("t", T.answer_span(F.col("messages"), F.col("t"), F.lit("Answer")).alias("s"), T.last_assistant(F.col("messages")).alias("i")).first()
    assert r.t[r.s.start : r.s.end] == "Answer" and r.s.start < r.t.index("y\n") and r.i == 3


def test_answer_span_falls_back_to_the_last_occurrence(spark):
    df = spark.createDataFrame([([("assistant", "<think>a</think>Answer")], "<|assistant|>\n<think>\na\n</think>\nAnswer\n")], "messages array<struct<role:string,content:string>>, t string")
    r = df.select("t", T.answer_span(F.col("messages"), F.col("t"), F.lit("Answer")).alias("s"), T.answer_span(F.col("messages"), F.col("t"), F.lit("none")).alias("n")).first()
    assert r.t[r.s.start : r.s.end] == "Answer" and r.n is None


def test_places_in_long_texts_are_found_in_one_pass(spark):
    import time

    text = "wörd " * 200_000
    df = spark.createDataFrame([(text, [("user", "wörd wörd"), ("assistant", "wörd")])], "t string, m array<struct<role:string,content:string>>")
    begun = time.time()
    o = df.select(T.word_offsets(F.col("t")).alias("o")).first().o
    assert len(o) == 200_000 and tuple(o[7]) == ("wörd", 35, 39) and time.time() - begun < 60
    assert [tuple(x) for x in df.select(T.message_spans(F.col("m"), F.col("t")).alias("s")).first().s] == [("user", 0, 9), ("assistant", 10, 14)]


def test_a_missing_message_is_an_error(spark):
    df = spark.createDataFrame([([("assistant", "a"), ("user", "gone")], "<a>")], "m array<struct<role:string,content:string>>, t string")
    with pytest.raises(Exception, match="lacks a message"):
        df.select(T.assistant_spans(F.col("m"), F.col("t"))).collect()


def test_labels_mask_what_is_outside(spark):
    df = spark.createDataFrame([("ab cd ef",)], "t string").withColumn("o", T.word_offsets(F.col("t")))
    spans = F.array(F.struct(F.lit(3).alias("start"), F.lit(5).alias("end")))
    assert df.select(T.labels(F.col("o"), F.transform("o", lambda x, i: i), spans)).first()[0] == [-100, 1, -100]


def test_strip_left_takes_unicode_white_space(spark):
    assert spark.createDataFrame([("  \n x ",)], "t string").select(T.strip_left(F.col("t"))).first()[0] == "x "


def test_truncate_and_positions(spark):
    r = spark.range(1).select(T.truncate_left(F.array(*map(F.lit, [1, 2, 3])), 2).alias("a"), T.positions(F.array(*map(F.lit, [7, 1, 7])), F.lit(7)).alias("b")).first()
    assert r.a == [2, 3] and r.b == [0, 2]


def test_names():
    assert T.entropy_table_path("/c/", "Qwen/Qwen3 0.6B") == "/c/cot_entropies__Qwen__Qwen3_0.6B"
    assert T.method_name("simple_mean", "uniform_cr8") == "simple_mean_uniform_cr8"
    assert char_tokens("a<|x|>b", ["<|x|>"]) == [("a", 0, 1), ("<|x|>", 1, 6), ("b", 6, 7)]


def test_split_is_deterministic_disjoint_and_exact(spark):
    df = spark.range(10).withColumnRenamed("id", "doc_id")
    sizes = {"train": 4, "eval": 2, "test": 3}
    a = corpus.checked_split(df, sizes, 7).collect()
    b = corpus.checked_split(df.repartition(3), sizes, 7).collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and len({r.doc_id for r in a}) == 9
    assert {s: sum(r.split == s for r in a) for s in sizes} == sizes
    with pytest.raises(ValueError):
        corpus.checked_split(df, {"train": 11}, 7)


def test_load_or_build(spark, tmp_path):
    df = spark.range(10).withColumnRenamed("id", "doc_id")
    sizes, calls = {"train": 4, "eval": 2, "test": 3}, []

    def build():
        calls.append(1)
        return corpus.checked_split(df, sizes, 7)

    for _ in range(2):
        assert corpus.load_or_build(spark, str(tmp_path / "c"), build, sizes).count() == 9
    assert calls == [1]
    with pytest.raises(ValueError):
        corpus.load_or_build(spark, str(tmp_path / "c"), build, {"train": 5})


def test_places_are_made_in_bounded_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    texts = [None if k % 7 == 3 else " ".join(["ab", "c"] * (k % 5)) for k in range(3 * T.PLACED_ROWS + 5)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
    out = T.settled(df, o=T.word_offsets(F.col("t"))).orderBy("k").collect()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    for text, r in zip(texts, out, strict=True):
        assert r.o is None if text is None else [x.token for x in r.o] == text.split() and all(text[x.start : x.end] == x.token for x in r.o)

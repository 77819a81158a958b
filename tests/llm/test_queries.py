"""Every query of the subpackage as it is registered, and the pipeline, on a small fixture: brute force and SQL."""

import hashlib
import math
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from test_llm_small import brute_components, brute_hits, fill, rnd
from tracelens.llm import chat, langid, media, queries, tokens, toxicity, warc

TABLES = ("documents", "labels", "benchmark", "pages", "conversations")


def held_out(i, m=3, at=1):
    return zlib.crc32(str(i).encode()) % m == at


def documents():
    """(doc_id, text, lang, source, n_chars) and the labels of some."""
    rows, toxic = [], {}
    for k in range(60):
        rows.append((k, rnd(k, 100), "en"))
        toxic[k] = 0
    for k in range(60, 120):
        rows.append((k, f"{rnd(k, 20)} {('moron', 'scumbag')[k % 2]} {rnd(-k, 20)}", "en"))
        if k % 5:
            toxic[k] = 1
    for k in range(120, 130):  # near copies, then shared passages, then passages of the benchmark
        words = rnd(k - 120, 100).split()
        words[50] = "edit"
        rows.append((k, " ".join(words), "en"))
    for k in range(130, 140):
        rows.append((k, rnd(k, 30) + " ß " + " ".join(rnd(k - 130, 100).split()[20:50]) + " " + rnd(-k, 60), "de"))
    for k in range(140, 148):
        rows.append((k, rnd(k, 30) + " " + " ".join(rnd(770 + k, 20).split()[2:18]) + " " + rnd(-k, 20), "de"))
    rows += [(200, None, None), (201, "", "en"), (202, "one", "en"), (203, "one", "en")]
    return [(i, t, lang, ("b", "a", None, "z")[i % 4], None if t is None else len(t)) for i, t, lang in rows], toxic


BENCHMARK = [(1, rnd(900, 30)), (2, rnd(901, 13)), (None, "one"), (4, None), *((k, rnd(770 + k, 20)) for k in range(140, 148))]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows, toxic = documents()
    page = '<html><head><title>A &amp; B</title></head><body><a href="/q">go</a><p>One<br>two</body></html>'
    talk = [(c, t, ("user", "assistant")[t % 2] if t else "system", f"{rnd(c * 1000 + t, 5)}\nmore {'?' if t % 2 else ''}") for c in range(6) for t in range((3, 9, 600)[c % 3])]
    made = {
        "documents": (rows, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": (list(toxic.items()), "doc_id long, toxic int"),
        "benchmark": (BENCHMARK, "item_id long, text string"),
        "pages": ([(1, "http://a/", page), (2, None, None)], "page_id long, url string, html string"),
        "conversations": (talk + [(7, 0, None, None)], "conv_id long, turn long, role string, text string"),
    }
    for name, (data, ddl) in made.items():
        spark.createDataFrame(data, ddl).write.parquet(f"{d}/{name}.parquet")
    return d


def got(spark, sf, name):
    return queries.QUERIES[name](spark, sf).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet/*.parquet'")
    cur = con.execute(queries.ORACLE[name])
    cols, key = [d[0] for d in cur.description], lambda r: [str(x) for x in r]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(cols)
    mine, theirs = sorted(map(tuple, df.select(cols).collect()), key=key), sorted(cur.fetchall(), key=key)
    assert len(mine) == len(theirs) > 0
    for a, b in zip(mine, theirs):
        assert all(math.isclose(x, y, rel_tol=1e-12) if isinstance(x, float) else x == y for x, y in zip(a, b)), (a, b)


def scores(model, texts):
    kernel = toxicity.Kernel()
    return [float(model.probability(max(model.decide(kernel, w), default=-math.inf) if (w := toxicity.words_of(t)) else -math.inf)) for t in texts]


def test_op1(spark, sf):
    rows, toxic = documents()
    text = {i: t for i, t, *_ in rows}
    want = dict(zip(text, scores(toxicity.train([(text[i], y) for i, y in toxic.items() if not held_out(i)]), text.values())))
    out = got(spark, sf, "op1_toxicity")
    assert {r.doc_id for r in out} == set(text) and len(out) == len(rows)
    for r in out:
        assert r.held_out == held_out(r.doc_id) and math.isclose(r.score, want[r.doc_id], abs_tol=1e-9) and r.predicted == int(r.score >= 0.7)
        assert r.predicted == (60 <= r.doc_id < 120)


def test_op4_op6_op7(spark, sf):
    from tokenizers import Tokenizer

    rows, _ = documents()
    text = {i: t or "" for i, t, *_ in rows}
    tok = Tokenizer.from_file(tokens.tokenizer_path())
    n = {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in text.items()}
    assert {(r.doc_id, r.n_tokens, r.over_limit) for r in got(spark, sf, "op6_token_counts")} == {(i, x, x > tokens.LIMIT) for i, x in n.items()}
    p = {i: media.pad(t.encode()) for i, t in text.items()}
    want = {(i, len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-64:])) for i, x in p.items()}
    assert {(r.doc_id, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got(spark, sf, "op4_media_ts")} == want
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang, *_ in rows], "doc_id long, text string, lang string")
    learned = langid.profiles(spark.createDataFrame([(i, t, lang) for i, t, lang, *_ in rows if not held_out(i, 4, 2)], docs.schema))
    want = {(r.doc_id, held_out(r.doc_id, 4, 2), r.lang_pred, r.score) for r in langid.identify(docs, learned).collect()}
    assert {tuple(r[c] for c in ("doc_id", "held_out", "lang_pred", "score")) for r in got(spark, sf, "op7_language_id")} == want and len(want) == len(rows)


def test_held_out_accuracy(spark):
    """Rows that nothing was learned from, of the generated tables."""
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    out = [r for r in got(spark, sf, "op7_language_id") if r.held_out and lang[r.doc_id]]
    assert len(out) > 100 and sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.95 * len(out)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [r for r in got(spark, sf, "op1_toxicity") if r.held_out and r.doc_id in toxic]
    bad, good = ([r for r in out if toxic[r.doc_id] == y] for y in (1, 0))
    assert len(bad) > 10 and sum(r.predicted for r in bad) >= 0.7 * len(bad) and sum(r.predicted for r in good) <= 0.03 * len(good)


def test_op8(spark, sf):
    out = got(spark, sf, "op8_warc_derivatives")
    assert sorted((r.page_id, r.record_type) for r in out) == [(k, t) for k in (1, 2) for t in ("conversion", "metadata")]
    one = {r.record_type: r for r in out if r.page_id == 1}
    assert one["conversion"].content == "go\nOne\ntwo" and "title: A & B" in one["metadata"].content and "outlink: /q" in one["metadata"].content
    page = next(r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect() if r.page_id == 1)
    assert {r.source_payload_digest for r in one.values()} == {warc.digest(page.encode())}


def test_op10(spark, sf):
    rows = chat.raw_transcripts(spark.read.parquet(f"{sf}/conversations.parquet"))
    hmm, convs, known = chat.fit(chat.in_blocks(rows.where(~chat.held_out(rows.conv_id))).checkpoint()), {}, 0
    for r in sorted(rows.collect(), key=lambda r: (r.conv_id, r.turn)):
        convs.setdefault(r.conv_id, []).append((r.turn, *chat.symbols(r.text)))
    out = {}
    for r in sorted(got(spark, sf, "op10_chat_roles"), key=lambda r: (r.conv_id, r.block, r.at)):
        assert r.held_out == held_out(r.conv_id, 4, 2)
        out.setdefault(r.conv_id, []).append((r.turn, r.n_lines, r.roles, r.role))
    for c, run in convs.items():
        syms, enter = [s for _, x, _ in run for s in x], hmm.start - np.log(3)
        score = enter
        for s in syms:
            score = (score[:, None] + hmm.advance(s)).max(axis=0)
        found, want = [chat.ROLES[x] for x in chat.viterbi(hmm, syms, enter, int(score.argmax()))], []
        for t, x, _ in run:
            roles, found = found[: len(x)], found[len(x) :]
            want.append((t, len(x), ",".join(roles), roles[0]))
        assert out[c] == want
        known += 1
    assert known == len(out) == 7


def brute_cut(rows, n=50):
    """Texts without the bytes of strings of n bytes that a smaller document has."""
    least, out = {}, {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, d in data:
        for p in range(len(d) - n + 1):
            least[d[p : p + n]] = min(least.get(d[p : p + n], i), i)
    for i, d in data:
        gone = {q for p in range(len(d) - n + 1) if least[d[p : p + n]] < i for q in range(p, p + n)}
        out[i] = bytes(b for p, b in enumerate(d) if p not in gone).decode("utf-8", "ignore")
    return out


def test_pipeline_against_brute_force(spark, sf):
    rows, toxic = documents()
    text, row = {i: t for i, t, *_ in rows}, {r[0]: r for r in rows}
    model = toxicity.train([(text[i], y) for i, y in toxic.items()])
    kept = [i for i, s in zip(text, scores(model, text.values())) if s < 0.7]
    assert len(kept) < len(rows) - 50
    comp = brute_components([(i, text[i]) for i in kept], 5, 80)
    apart = [i for i in kept if comp[i][1] == i]
    assert len(apart) <= len(kept) - 11
    cut = brute_cut([(i, text[i]) for i in apart])
    cut = {i: None if text[i] is None else t for i, t in cut.items()}
    assert sum(cut[i] != text[i] for i in apart) >= 10
    hits = {i: brute_hits(cut[i], BENCHMARK) for i in apart}
    clean = [i for i in apart if not (hits[i][1] and 20 * hits[i][1] >= hits[i][0])]
    assert len(clean) <= len(apart) - 9
    sizes = {}
    for i in clean:
        sizes[row[i][3]] = sizes.get(row[i][3], 0) + len((cut[i] or "").split())
    order = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    target = fill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    want = []
    for i in clean:
        rate = min(2.0, target[row[i][3]] / sizes[row[i][3]])
        u = int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:13], 16) / 2**52
        n = math.floor(rate) + (u < rate - math.floor(rate))
        want += [(i, cut[i], row[i][2], row[i][3], None if cut[i] is None else len(cut[i]), k + 1) for k in range(n)]
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "mix_copy"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_pipeline_keeps_no_table_that_is_used_up(spark, sf, monkeypatch):
    import os

    from tracelens.llm.common import SharedTables

    seen, keep = [], SharedTables.keep

    def watched(self, df, name):
        out = keep(self, df, name)
        seen.append(sorted(os.listdir(self.folder.removeprefix("file:"))))
        return out

    monkeypatch.setattr(SharedTables, "keep", watched)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"s{k}", lambda spark, docs, sf_dir: docs) for k in range(5)])
    out = corpus_pipeline.run(spark, sf)
    assert seen == [["0-s0"], ["0-s0", "1-s1"], ["1-s1", "2-s2"], ["2-s2", "3-s3"]]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").collect()), key=str)

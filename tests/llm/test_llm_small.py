"""Small cases of each operator: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tracelens.llm import chat, decontam, jaccard, langid, media, mixing, suffix_dedup, tokens, toxicity, warc
from tracelens.llm.suffix_sort import suffix_arrays

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, spans string"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source); two columns with clashing names are added."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None, "x", "y") for r in rows]
    return spark.createDataFrame(full, DOCS)


def rnd(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(n))


EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, rnd(1, 4000)), (7, "ö" * 70), (None, "no id")]


# --- 1 -----------------------------------------------------------------------------------------------------------
def toxic_rows(seed, n=240):
    r, rows = random.Random(seed), []
    for _ in range(n):
        words = rnd(r.random(), 30).split()
        y = int(r.random() < 0.4)
        if y:
            words.insert(r.randrange(len(words)), r.choice(["moron", "scumbag", "worthless"]))
        rows.append((" ".join(words), y))
    return rows


@pytest.fixture(scope="module")
def model():
    return toxicity.train(toxic_rows(1))


def test_kernel_against_its_definition():
    k = toxicity.Kernel()

    def phi(w):
        w, out = "^" + w, {}
        c = k.codes([w], len(w))[0]
        for a in range(len(w)):
            for b in range(a + 1, len(w)):
                for d in range(b + 1, len(w)):
                    key = (c[a], c[b], c[d])
                    out[key] = out.get(key, 0) + k.decay ** (d - a + 1)
        return out

    words = ["moron", "mooron", "banana", "scum", "idiot"]
    dense = k.dense(words)
    got = k.against(words, dense)
    for i, x in enumerate(words):
        for j, y in enumerate(words):
            p, q = phi(x), phi(y)
            dot = lambda u, v: sum(z * v.get(key, 0) for key, z in u.items())
            assert math.isclose(got[i, j], dot(p, q) / math.sqrt(dot(p, p) * dot(q, q)), abs_tol=1e-5)


def test_toxicity_held_out_and_gaps(spark, model):
    test = toxic_rows(2)
    df = docs(spark, [(i, t) for i, (t, _) in enumerate(test)])
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    right = sum((got[i] >= 0.7) == bool(y) for i, (_, y) in enumerate(test))
    assert right >= 0.97 * len(test)
    odd = docs(spark, [(1, "you mo-ron"), (2, "you m o r o n"), (3, "you mor*on"), (4, "you moron!!")])
    assert all(r.score >= 0.7 for r in toxicity.score(odd, model).collect())


def test_toxicity_edges(spark, model):
    rows = toxicity.score(docs(spark, EDGE), model).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score < 0.1 for r in rows if r.doc_id in (1, 2, 3))
    assert toxicity.score(docs(spark, []), model).count() == 0
    assert [r.score for r in toxicity.score(docs(spark, [(1, "moron")]), toxicity.train([])).collect()] == [0.0]
    kept = toxicity.keep_clean(docs(spark, [(1, "a moron"), (2, "fine words")]), model)
    assert [r.doc_id for r in kept.collect()] == [2] and len(kept.columns) == 7


def many_words():
    """Good documents of many words seen once, some of them near insults; bad ones with insults, one of 18 characters."""
    r, letters = random.Random(9), "abcdefghijklmnopqrstuvwxyz"
    rare = [r.choice(["", "mo", "sc", "umb"]) + "".join(r.choice(letters) for _ in range(6)) for _ in range(14_000)]
    rows = [(" ".join([*rare[k * 140 : k * 140 + 140], "the", "otherwise"]), 0) for k in range(100)]
    rows += [(f"{r.choice(['moron', 'scumbag'])} the otherwise {rnd(k, 5)}", 1) for k in range(100)]
    return rows + [(f"the otherwise insufferablenitwit {rnd(k + 500, 5)}", 1) for k in range(40)]


def test_toxicity_leaves_no_word_unlearned(monkeypatch):
    learned, against = set(), toxicity.Kernel.against
    monkeypatch.setattr(toxicity.Kernel, "against", lambda self, words, *a, **b: learned.update(w.lstrip("^") for w in words) or against(self, words, *a, **b))
    rows, k = many_words(), toxicity.Kernel()
    m = toxicity.train(rows)
    clean = sorted({w for t, y in rows if not y for w in t.split()})
    z = m.decide(k, clean)
    # a good word that was never shown to the machine lies beyond its margin
    assert [w for w, x in zip(clean, z) if x > -1 + 1e-6 and w not in learned] == []
    assert (m.probability(z) < 0.7).all()
    assert (m.probability(m.decide(k, ["moron", "scumbag", "insufferablenitwit"])) >= 0.7).all()


def test_toxicity_is_trained_outside_the_driver(spark, monkeypatch):
    rows = toxic_rows(1, 120)
    sample = docs(spark, [(i, t) for i, (t, _) in enumerate(rows)]).repartition(3)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic long")
    a, b = toxicity.fit(sample, labels), toxicity.train(rows)
    k, words = toxicity.Kernel(), ["moron", "scumbag", "worthless", "otherwise", rnd(3, 1)]
    assert np.allclose(a.probability(a.decide(k, words)), b.probability(b.decide(k, words)), rtol=0, atol=1e-9)
    for none in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic = 1"), labels.where("false")):
        assert toxicity.fit(sample, none).v is None
    assert toxicity.fit(docs(spark, []), labels).v is None
    monkeypatch.setattr(toxicity, "train", lambda rows: toxicity.Model(np.array([os.getpid(), len(rows)], float), 1.0, 2.0, 3.0))
    m = toxicity.fit(sample, labels)
    assert m.v[0] != os.getpid() and m.v[1] == len(rows) and (m.bias, m.slope, m.shift) == (1.0, 2.0, 3.0)


# --- 2 -----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("letters,bad", [("абвгдежзиклмнопрстуфхцчшщъыьэюя", ["дурак", "подлец", "ослик"]), ("αβγδεζηθικλμνξοπρστυφχψω", ["βλακας", "ηλιθιος", "χαζος"])])
def test_toxicity_in_other_scripts(letters, bad):
    r = random.Random(8)
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(2, 8)))

    def rows(n):
        out = []
        for k in range(n):
            w = [word() for _ in range(30)]
            if k % 3 == 0:
                w[r.randrange(30)] = r.choice(bad)
            out.append((" ".join(w), int(k % 3 == 0)))
        return out

    m, kernel = toxicity.train(rows(300)), toxicity.Kernel()
    test = rows(300)
    found = [m.probability(m.decide(kernel, toxicity.words_of(t)).max()) >= 0.7 for t, _ in test]
    assert sum(f for f, (_, y) in zip(found, test) if y) >= 90 and sum(f for f, (_, y) in zip(found, test) if not y) <= 4
    gapped = [b[:2] + "*" + b[2:] for b in bad] + [b[:3] + b[2:] for b in bad] + [b.upper() for b in bad]
    assert all(m.probability(m.decide(kernel, toxicity.words_of(g)).max()) >= 0.7 for g in gapped)


def test_signs_keep_alphabets_apart():
    for lo, hi in ((0x430, 0x44F), (0x3B1, 0x3C9), (0x5D0, 0x5EA), (0x561, 0x584)):
        plain = {toxicity.unicodedata.normalize("NFD", chr(p))[0] for p in range(lo, hi + 1)}  # without accents
        assert len({toxicity.sign_of(ord(c)) for c in plain}) == len(plain) >= hi - lo
    assert [toxicity.sign_of(ord(c)) for c in "aÉ9^!ß"] == [1, 5, 36, 37, 0, 19] and toxicity.sign_of(ord("й")) == toxicity.sign_of(ord("и"))


def test_suffix_arrays_against_sorting():
    rng = np.random.default_rng(5)
    for _ in range(60):
        texts = [rng.integers(0, rng.integers(1, 5), rng.integers(0, 50)).astype(np.uint8) for _ in range(rng.integers(1, 9))]
        order, base = suffix_arrays(texts)
        for t, b in zip(texts, base):
            s = bytes(t.tolist())
            assert order[b : b + len(s)].tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def brute_spans(rows, n=50):
    least = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, d in data:
        if i is not None:
            for p in range(len(d) - n + 1):
                s = d[p : p + n]
                least[s] = min(least.get(s, i), i)
    out = []
    for i, d in data:
        covered = bytearray(len(d))
        for p in range(len(d) - n + 1 if i is not None else 0):
            if least[d[p : p + n]] < i:
                covered[p : p + n] = b"\x01" * n
        runs = [(m.start(), m.end()) for m in re.finditer(b"\x01+", bytes(covered))]
        kept = bytes(b for b, c in zip(d, covered) if not c)
        out.append((i if i is not None else -1, len(d), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def copies(seed=3):
    r = random.Random(seed)
    base = [rnd(k, 80) for k in range(6)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(10, 60):
        t = r.choice(base)
        words = t.split()
        for _ in range(r.randrange(4)):
            words[r.randrange(len(words))] = r.choice(["edit", "ß"])
        cut = r.randrange(len(words) // 2)
        rows.append((k, " ".join(words[cut:] + rnd(k + 100, r.randrange(10)).split() + words[:cut])))
    rows += [(70, "a" * 500), (71, "b" + "a" * 300), (72, "ab" * 200), (73, "ab" * 100 + "c")]
    return rows


def removed(spark, rows):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removals(docs(spark, rows)).collect())


@pytest.mark.parametrize("block,portion,slice_bytes", [(0, 1 << 19, 2 << 20), (200, 70, 2 << 20), (32_768, 500, 10)])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, tmp_path, block, portion, slice_bytes):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "PORTION", portion)
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", slice_bytes)
    rows = copies() + [(80, copies()[0][1] * 20)]  # a text of many portions
    docs(spark, rows).write.parquet(str(tmp_path / "d"))  # a plan of known size, so that there are many slices
    got = suffix_dedup.removals(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_spans(rows)


def test_suffix_dedup_rows_that_share_an_id(spark):
    one, two, three = rnd(31, 40), rnd(32, 40), rnd(33, 40)
    rows = [(1, one), (5, f"{one} {three}"), (5, f"x {two}"), (5, f"x {two}"), (6, two), (7, three), (None, one)]
    assert removed(spark, rows) == brute_spans(rows)
    kept = suffix_dedup.clean(docs(spark, rows).withColumnRenamed("score", "sd_spans").withColumnRenamed("spans", "sd_doc"))
    assert "sd_spans" in kept.columns and "sd_doc" in kept.columns
    want = [("1", one), ("5", f" {three}"), ("5", f"x {two}"), ("5", f"x {two}"), ("6", ""), ("7", ""), ("None", one)]
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == want


def test_suffix_dedup_edges(spark):
    rows = EDGE + [(8, rnd(1, 4000)[1000:3000]), (8, rnd(1, 4000)[1000:3000])]
    assert removed(spark, rows) == brute_spans(rows)
    assert removed(spark, []) == []
    kept = suffix_dedup.clean(docs(spark, [(1, "x" * 60), (2, "x" * 60 + "tail")]))
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert {r.doc_id: r.text for r in kept.collect()} == {1: "x" * 60, 2: "tail"}


# --- 3 -----------------------------------------------------------------------------------------------------------
def brute_hits(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = split(text), set(), set()
    for i, t in items:
        v = split(t)
        m = min(13, len(v))
        for s in range(len(v) - m + 1 if m else 0):
            for p in range(len(w) - m + 1):
                if w[p : p + m] == v[s : s + m]:
                    hit.update(range(p, p + m))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


ITEMS = [(1, rnd(900, 30)), (2, rnd(901, 13)), (3, "Short ÄÖ item"), (4, None), (5, "..."), (6, "solo"), (7, rnd(900, 30))]


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_decontamination_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    texts = [None, "", rnd(900, 30).upper(), "x " + " ".join(rnd(900, 30).split()[4:20]) + " y " + rnd(901, 13), "a short ÄÖ item, solo", rnd(5, 100), "short äö item"]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontam.decontaminate(docs(spark, list(enumerate(texts))), bench).collect()}
    assert got == {i: brute_hits(t, ITEMS) for i, t in enumerate(texts)}
    named = docs(spark, list(enumerate(texts)) + [(None, rnd(900, 30)), (None, "fine")]).withColumnsRenamed({"score": "dc_doc", "spans": "row"})
    assert sorted((r.text for r in decontam.keep_clean(named, bench).where("doc_id is null").collect())) == ["fine"]
    kept = {r.doc_id for r in decontam.keep_clean(docs(spark, list(enumerate(texts))), bench).collect()}
    assert kept == {i for i, t in enumerate(texts) for n, h, _ in [brute_hits(t, ITEMS)] if not (h and 20 * h >= n)}


def test_decontamination_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 for r in decontam.decontaminate(docs(spark, EDGE), none).collect())
    assert decontam.decontaminate(docs(spark, []), none).count() == 0


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_decontamination_null_item_ids(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    items = [(None, rnd(902, 20)), (None, "solo piece"), (2, "piece of"), (10, rnd(903, 15)), (None, None)]
    rows = docs(spark, [(1, "x " + rnd(902, 20)), (2, "a solo piece of it"), (3, rnd(903, 15)), (4, "nothing here"), (5, "of solo")])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontam.decontaminate(rows, bench).collect()}
    assert got == {1: (21, 20, [None]), 2: (5, 3, ["2", None]), 3: (15, 15, ["10"]), 4: (2, 0, []), 5: (2, 0, [])}
    assert {r.doc_id for r in decontam.keep_clean(rows, bench).collect()} == {4, 5}
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = decontam.op3_decontamination(spark, str(tmp_path))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    cur = con.execute(decontam.SQL)
    cols = [d[0] for d in cur.description]
    assert sorted(map(tuple, out.select(cols).collect())) == sorted(cur.fetchall())


# --- 4 -----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 170, 4095, 4096, 4097, 33_000])
def test_media_round_trip(size):
    data = random.Random(size).randbytes(size)
    payload = media.pad(data)
    s = media.read_stream(media.write_stream(payload))
    assert s.payload == payload and len(payload) % 64 == 0 and payload[:size] == data
    assert [u[0] for u in s.units] == [k * media.TICKS for k in range(len(s.units))]
    assert [u[1] for u in s.units] == [k % media.RAP_EVERY == 0 for k in range(len(s.units))]


def test_media_damage_is_found():
    m = bytearray(media.write_stream(media.pad(b"x" * 9000)))
    with pytest.raises(ValueError):
        media.read_stream(bytes(m[: 188 * 5] + m[188 * 6 :]))
    m[8] ^= 1
    with pytest.raises(ValueError):
        media.read_stream(bytes(m))


def test_media_reads_what_the_format_allows():
    payload = media.pad(random.Random(2).randbytes(40_000))
    m = media.write_stream(payload)
    packets = [m[i : i + 188] for i in range(0, len(m), 188)]
    null = bytes((0x47, 0x1F, 0xFF, 0x10)) + b"\xff" * 184
    assert media.read_stream(b"".join(packets[:3] + packets[2:5] + [null] + packets[5:])).payload == payload
    with pytest.raises(ValueError):
        media.read_stream(b"".join(packets[:3] + packets[2:3] * 2 + packets[3:]))
    # PES packets without a length
    start = [i for i, x in enumerate(packets) if x[1:3] == b"\x41\x01"]
    for i in start:
        at = packets[i].index(b"\x00\x00\x01\xbd", 4)
        packets[i] = packets[i][: at + 4] + b"\x00\x00" + packets[i][at + 6 :]
    assert media.read_stream(b"".join(packets)).payload == payload
    # a program map over two packets: 40 streams without descriptors and that of the data
    body = media.struct.pack(">HH", 0xE000 | media.DATA_PID, 0xF000) + b"".join(media.struct.pack(">BHH", 6, 0xE000 | pid, 0xF000) for pid in [*range(0x200, 0x228), media.DATA_PID])
    section = media._section(0x02, 1, body)
    two = [bytes((0x47, 0x41, 0x00, 0x10)) + b"\x00" + section[:183], (bytes((0x47, 0x01, 0x00, 0x11)) + section[183:]).ljust(188, b"\xff")]
    one = media.write_stream(payload[:64])
    s = media.read_stream(one[:188] + b"".join(two) + one[376:])
    assert s.payload == payload[:64] and len(s.program) == 41


def test_media_clock_and_wrap():
    wrap = (1 << 33) // media.TICKS
    m = media.write_stream(media.pad(b"x" * 40_000), wrap - 3)
    s = media.read_stream(m)
    assert [u[0] for u in s.units] == [(wrap - 3 + k) * media.TICKS % (1 << 33) for k in range(len(s.units))] and s.units[5][0] < s.units[0][0]
    clocks = []
    for i in range(0, len(m), 188):
        if m[i + 3] & 0x20 and m[i + 4] and m[i + 5] & 0x10:
            assert m[i + 5] & 0x40
            clocks.append(int.from_bytes(m[i + 6 : i + 12]) >> 15)
    assert clocks == [u[0] for u in s.units if u[1]]


def test_media_query_keeps_time_stamps(spark, tmp_path):
    docs(spark, [(1, "x" * 300_000), (2, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in media.op4_media_ts(spark, str(tmp_path)).collect()}
    assert rows[1].pts == [k * media.TICKS for k in range(74)] and rows[1].random_access == [k % 8 == 0 for k in range(74)]
    assert rows[2].payload_bytes == 64 and rows[2].pts == [0] and rows[2].feature.startswith("packets=3;units=1;random_access=1;")


def test_media_edges(spark):
    rows = media.features(media.store(docs(spark, EDGE))).collect()
    assert len(rows) == len(EDGE)
    for r, (i, t) in zip(sorted(rows, key=lambda r: str(r.doc_id)), sorted(EDGE, key=lambda r: str(r[0]))):
        p = media.pad((t or "").encode())
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert media.features(media.store(docs(spark, []))).count() == 0


# --- 5 -----------------------------------------------------------------------------------------------------------
def brute_components(rows, n, percent):
    sets, members = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        m = min(n, len(w))
        sets[i] = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if w else set()
        members[i] = i
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                lo, hi = sorted((members[a], members[b]))
                members = {k: lo if v == hi else v for k, v in members.items()}
    return {i: (len(sets[i]), members[i]) for i in ids}


def family(seed, n=90):
    r, rows = random.Random(seed), []
    for k in range(n):
        if k % 3 == 0 or not rows:
            rows.append((k, rnd((seed, k).__hash__(), r.choice([1, 2, 5, 20, 60, 120]))))
        else:
            w = r.choice(rows)[1].split()
            for _ in range(r.randrange(5)):
                w[r.randrange(len(w))] = "edit%d" % r.randrange(9)
            rows.append((k, " ".join(w).upper() if r.random() < 0.2 else " ".join(w)))
    return rows


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (2, 50)])
def test_jaccard_against_brute_force(spark, n, percent):
    rows = family(n)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs(spark, rows), n, percent).collect()}
    assert got == brute_components(rows, n, percent)


def test_jaccard_edges(spark):
    got = jaccard.near_duplicates(docs(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    assert {r.doc_id: r.component_id for r in got if r.doc_id} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}
    assert jaccard.near_duplicates(docs(spark, [])).count() == 0
    kept = jaccard.keep_one(docs(spark, EDGE))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "6", "7", "None"] and len(kept.columns) == 7


@pytest.mark.parametrize("percent", [50, 80, 90, 95])
def test_similar_sets_share_a_key_and_pass_the_sketch(percent):
    rng, bands = np.random.default_rng(percent), jaccard.Bands(percent)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        u = len(a) + int(rng.integers(0, len(a) * (100 - percent) // percent + 1))
        b = np.unique(np.r_[a, rng.integers(0, 2**63, u - len(a)).astype(np.uint64)])
        drop = int(rng.integers(0, len(b)))
        b = np.delete(b, rng.permutation(len(b))[: drop % max(1, len(b) // 5)])
        common = len(np.intersect1d(a, b))
        sets = jaccard.Sets(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]))
        x, y = sets.sketches()
        assert jaccard.hamming(x, y) <= len(a) + len(b) - 2 * common
        if len(b) and 100 * common >= percent * (len(a) + len(b) - common):
            owner, keys = jaccard.block_keys(sets, bands)
            assert np.intersect1d(keys[owner == 0], keys[owner == 1]).size


def test_sets_against_python():
    texts = [None, b"", b" one ", b"a b", b"A B", b"a b c a b c a b", b"x a b c"]
    sets = jaccard.Hasher(3).sets(texts)
    grams = []
    for t in texts:
        w = (t or b"").lower().split()
        grams.append({tuple(w[i : i + min(3, len(w))]) for i in range(len(w) - min(3, len(w)) + 1)} if w else set())
    for i, g in enumerate(grams):
        assert len(sets[i]) == len(g)
        for j, h in enumerate(grams):
            assert len(np.intersect1d(sets[i], sets[j])) == len(g & h)
    d = sets.digests().tolist()
    assert d[0] == d[1] == -1 and d[3] == d[4] and len(set(d)) == 5


def test_keys_survive_their_packing():
    k = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, np.uint64))
    assert (jaccard._from_planes(jaccard._planes(k)) == k >> np.uint64(8) << np.uint64(8)).all()


def test_jaccard_rows_that_share_an_id(spark):
    a, b = rnd(71, 80), rnd(72, 80)
    near = lambda t: t + " tail"
    rows = [(5, a), (5, b), (9, near(a)), (10, near(b)), (4, rnd(73, 80)), (5, a)]
    got = sorted((r.doc_id, r.component_id) for r in jaccard.near_duplicates(docs(spark, rows), 3, 90).collect())
    assert got == [(4, 4), (5, 5), (5, 5), (5, 5), (9, 5), (10, 5)]
    rows = [(5, a), (5, b), (3, near(a))]
    kept = jaccard.keep_one(docs(spark, rows).withColumnRenamed("score", "nd_doc").withColumnRenamed("spans", "nd_hash"), 3, 90)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(5, b), (3, near(a))])


def test_jaccard_crowded_keys(spark):
    """Texts that are half one shared passage, in pairs of near copies: keys of the passage hold many components."""
    shared, rows = rnd(80, 100), []
    for k in range(0, 40, 2):
        own = rnd(81 + k, 60 + k)
        rows += [(k, f"{shared} {own}"), (k + 1, f"{shared} edit {own}")]
    for n, percent in ((5, 80), (3, 90), (2, 50)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs(spark, rows), n, percent).collect()}
        assert got == brute_components(rows, n, percent)


def test_components_of_a_chain(spark):
    from tracelens.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r.cls: r.comp for r in jaccard.components(links).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


# --- 6 -----------------------------------------------------------------------------------------------------------
def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    texts = [None, "", " ", "a", "  two  spaces ", "line\n\nbreak \n x", "it's don't", "tab\tx", "end ", " <|endoftext|> y", "ö" * 500, " nb em x", "\x1c a \x1f b", rnd(4, 3000), "word " * 3000]
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs(spark, list(enumerate(texts)))).collect()}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}
    assert tokens.count_tokens(docs(spark, [])).count() == 0


def test_overlaps_widen_where_boundaries_are_far():
    c = tokens.Counter(tokens.tokenizer_path(), huge=50, chunk=200, overlap=8)
    texts = [rnd(1, 500), "x" * 3000, ("y" * 150 + " ") * 20, rnd(2, 200).replace(" ", "\n"), " " * 900 + rnd(3, 50), "é è " * 400, "<|endoftext|> " * 90]
    assert c.count(texts) == c.direct(texts) and c.widened > 0


def test_any_text_is_counted_in_proportion():
    r, c = random.Random(7), tokens.Counter(tokens.tokenizer_path(), huge=50, chunk=60, overlap=4)
    signs = ["中文，测试。", "abc", "123", " ", "  ", "\n", "'s", "'ll", "!", "?'", "é", "½", "Ⅷ", "\t ", "..", "'", "日本語", "🙂", "ß"]
    for _ in range(400):
        t = "".join(r.choice(signs) for _ in range(r.randrange(1, 100)))
        assert c.resync(t) == c.direct([t])[0], t
    c = tokens.Counter(tokens.tokenizer_path())
    for t in ("中文，测试。" * 30_000, "的一是不了人我在有他" * 15_000, "aB3xY9/" * 30_000):
        c.encoded = 0
        assert c.resync(t) == c.direct([t])[0] and c.encoded < 4 * len(t)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_get_whole_texts(name):
    c = tokens.Counter(tokens.tokenizer_path(name), huge=50, chunk=60, overlap=4)
    texts = [rnd(1, 300), "", None, "Some Words  here", "中文，测试。" * 50]
    assert not c.parts and c.count(texts) == [c.direct([t])[0] if t else 0 for t in texts]


# --- 7 -----------------------------------------------------------------------------------------------------------
def test_language_profiles(spark):
    en, de = "the cat and the dog were there with them " * 3, "der hund und die katze waren nicht zu hause " * 3
    rows = [(i, en + rnd(i, 3), "en") for i in range(6)] + [(10 + i, de + rnd(i, 3), "de") for i in range(6)] + [(30, "anything", None), (31, None, "en")]
    learned = langid.profiles(docs(spark, rows))
    assert sorted(learned) == ["de", "en"] and len(learned["en"]) <= langid.PROFILE
    ask = [(1, "the dog and the cat"), (2, "die katze und der hund"), (3, None), (4, "123 !?"), (5, "")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs(spark, ask), learned).collect()}
    assert (got[1][0], got[2][0]) == ("en", "de") and got[3] == got[4] == got[5] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    assert [r.lang_pred for r in langid.identify(docs(spark, [(1, "the")]), {}).collect()] == ["und"]
    assert langid.profiles(docs(spark, [])) == {}


def brute_grams(text):
    import unicodedata

    words = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower()).split()
    out = []
    for w in words:
        p = f" {w} "
        out += [*w, *[p[i : i + 2] for i in range(len(p) - 1)], *[p[i : i + 3] for i in range(len(p) - 2)]]
    return out


def test_language_against_brute_force(spark):
    from collections import Counter

    r = random.Random(3)
    letters = "aabbccdeé中½Ⅷ2_ ,\n"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(40)] + [None, "", "½ ² Ⅷ", "x" * 70_000, "same", "same"]
    g = langid.Grams()
    for t in texts:
        assert Counter(map(langid.name, g.of(t).tolist())) == Counter(brute_grams(t))
    rows = [(k, t, "abc"[k % 3] if k % 4 else None) for k, t in enumerate(texts)]
    got = langid.profiles(docs(spark, rows), 20)
    counts = {}
    for _, t, one in rows:
        if one:
            counts.setdefault(one, Counter()).update(brute_grams(t))
    assert got == {one: sorted(c, key=lambda x: (-c[x], x))[:20] for one, c in counts.items()}
    want = []
    for k, t, _ in rows:
        own = Counter(brute_grams(t))
        own = sorted(own, key=lambda x: (-own[x], x))[:20]
        d = sorted((sum(abs(i - got[one].index(x)) if x in got[one] else 20 for i, x in enumerate(own)), one) for one in got)
        want.append((k, d[0][1], (d[1][0] - d[0][0]) / d[1][0] if d[1][0] else 0.0) if own else (k, "und", 0.0))
    found = langid.identify(docs(spark, rows).withColumnRenamed("spans", "lang_pred"), got, 20).collect()
    assert sorted(map(tuple, found)) == want


# --- 8 -----------------------------------------------------------------------------------------------------------
def test_warc_derivatives(spark):
    page = '<html lang="en"><head><title>A &amp; B</title><script>x<y</script></head><body><a href="/q?a=1&amp;b=2">go</a><p>One<br>two &lt;3<!-- no --></body></html>'
    pages = spark.createDataFrame([(1, "http://a/", page, "z"), (2, None, None, "z"), (2, None, None, "z"), (3, "http://b\r\nX: y", "", "z")], "page_id long, url string, html string, content string")
    rows = warc.derivatives(warc.responses(pages)).collect()
    assert len(rows) == 8
    one = {r.record_type: r for r in rows if r.page_id == 1}
    assert one["conversion"].content == "go\nOne\ntwo <3" and "outlink: /q?a=1&b=2" in one["metadata"].content and "title: A & B" in one["metadata"].content
    ((head, block),) = warc.parse(warc.response("http://a/", page, page_id=1))
    assert one["conversion"].refers_to == head["WARC-Record-ID"] and one["metadata"].source_payload_digest == head["WARC-Payload-Digest"] == warc.digest(page.encode())
    for r in rows:
        ((h, b),) = warc.parse(bytes(r.warc))
        assert h["WARC-Refers-To"] == r.refers_to and b.decode() == r.content
    broken = bytearray(warc.response("http://a/", page))
    broken[-10] ^= 1
    with pytest.raises(ValueError):
        warc.parse(bytes(broken))
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_pages_are_read_without_loss():
    page = warc.Page
    assert page("<html><head><title>x</title><body><p>hello world</p><a href=y>z</a>").text == "hello world\nz"
    assert page("<html><head><title>x</title><body><a href=y>z</a>").title == "x"
    assert page("<noscript>a<p>b").text == "a\nb" and page("<noscript>a</noscript>b").text == "b"
    assert page("a<script>b<c</script >d<style>e").text == "a d"
    assert page("1 < 2 <3 <b>x</b> <").text == "1 < 2 <3 x <" and page("a <b").text == "a <b"
    assert page("<!-- a > b -->c<!-- d").text == "c" and page("<!DOCTYPE html><?xml ?>c").text == "c"
    assert page("<HTML LANG='de'><A class=\"x\" HREF = 'q>r'>l</A><a name=n><a href>").links == {"q>r": None, "": None}
    assert page('<html lang=fr><a href="open>text</a> more').text == "text more"
    assert page("it's <b>a</b> 'quote'").text == "it's a 'quote'" and page("İ<SCRIPT>x</SCRIPT>İ").text == "İ İ"


@pytest.mark.parametrize("piece", ["<a ", "<a href='", '<p x="', "<script>", "<!--", "<noscript>", "<", "&lt;", "</", "<a href=x ", "<a b=\"'\" ", "<title>", " \n", "<a =\""])
def test_pages_take_time_in_proportion(piece):
    import time

    text = piece * (1_000_000 // len(piece))
    begun = time.thread_time()
    warc.Page(text)
    warc.Page(text + ">")
    assert time.thread_time() - begun < 8


def test_warc_records_that_cannot_be_read(spark):
    good = warc.response("http://a/", "<p>x", page_id=1)
    no_digest = warc.re.sub(rb"WARC-Block-Digest: [^\r]*\r\n", b"", good).replace(b"WARC-Type: ", b"WARC-Type:")
    bad = [b"", None, b"junk", good[:-3], good.replace(b"WARC-Date: ", b"WARC-Date "), good.replace(b"response", b"resource", 1), good.replace(b"Content-Length: ", b"X: "), warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "x"), ("WARC-Date", "y")], b"no headers"), good + good]
    rows = warc.derivatives(spark.createDataFrame([(k, x and bytearray(x)) for k, x in enumerate([good, no_digest, *bad])], "page_id long, warc binary")).collect()
    assert [(r.page_id, r.record_type) for r in sorted(rows, key=lambda r: r.page_id) if r.page_id < 2] == [(k, t) for k in (0, 1) for t in ("metadata", "conversion")]
    assert sorted(r.page_id for r in rows if r.record_type == "error" and r.error) == list(range(2, 2 + len(bad)))
    meta = next(r for r in rows if r.page_id == 0 and r.record_type == "metadata")
    assert "http-status: HTTP/1.1 200 OK\r\nhttp-header: Content-Type: text/html; charset=utf-8\r\n" in meta.content
    ids = [r.record_id for r in warc.derivatives(warc.responses(spark.createDataFrame([(1, "u", "same"), (2, "u", "same"), (3, "v", "x" * 500_000)], "page_id long, url string, html string"))).collect()]
    assert len(set(ids)) == 6


# --- 9 -----------------------------------------------------------------------------------------------------------
def fill(sizes, weights, total, cap=2):
    """The excess reshared by weight, round by round."""
    out, open_, left = {}, dict(weights), total
    while open_:
        w = sum(open_.values())
        over = [k for k in open_ if cap * sizes[k] < left * open_[k] / w]
        if not over:
            return out | {k: left * x / w for k, x in open_.items()}
        for k in over:
            out[k] = cap * sizes[k]
            left -= out[k]
            del open_[k]
    return out


@pytest.mark.parametrize("broadcast", [0, 50_000])
def test_mixing_targets_and_copies(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", broadcast)
    r = random.Random(4)
    names = ["b", "a", "z", "m", None]
    rows = [(i, rnd(i, r.choice([1, 10, 50])), "en", r.choice(names[:3] if r.random() < 0.8 else names)) for i in range(600)] + [(9000, None, None, "empty"), (9001, "", None, "empty")]
    out = mixing.mix(docs(spark, rows)).collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = fill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    assert len(out) == len(rows)
    for x in out:
        assert x.mix_source_size == sizes[x.source] and math.isclose(x.mix_target, want[x.source], rel_tol=1e-9, abs_tol=1e-9) and x.mix_copies <= 2
    for s in ("a", "b", "z"):
        got = sum(x.mix_size * x.mix_copies for x in out if x.source == s)
        assert abs(got - want[s]) <= 0.25 * want[s]
    copies_ = mixing.emit(docs(spark, rows))
    assert copies_.count() == sum(x.mix_copies for x in out) and copies_.columns[-1] == "mix_copy"
    named = docs(spark, rows).withColumnsRenamed({"lang": "mix_size", "score": "mix_source", "spans": "mix_copy"})
    again = mixing.mix(named).collect()
    assert sorted((x.doc_id, x.mix_size_, x.mix_copies) for x in again) == sorted((x.doc_id, x.mix_size, x.mix_copies) for x in out)
    assert all((x.mix_size, x.mix_source, x.mix_copy) == ("en" if x.doc_id < 9000 else None, "x", "y") for x in again)
    assert mixing.emit(named).columns == [*named.columns, "mix_copy_"]
    assert mixing.mix(docs(spark, [])).count() == 0


# --- 10 ----------------------------------------------------------------------------------------------------------
def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    log = lambda x: np.log(x / x.sum(-1, keepdims=True))
    hmm = chat.Hmm(log(rng.random(3)), log(rng.random((2, 3, 3))), log(rng.random((3, chat.N_SYMBOLS))))
    syms = rng.integers(0, chat.N_SYMBOLS, 6).tolist()
    import itertools

    def score(path):
        s = max(hmm.start[r] - math.log(3) + hmm.advance(syms[0])[r, path[0]] for r in range(3))
        return s + sum(hmm.advance(y)[a, b] for y, a, b in zip(syms[1:], path, path[1:]))

    best = max(itertools.product(range(3), repeat=6), key=score)
    enter = hmm.start - math.log(3)
    m = chat._product(hmm.advance(s) for s in syms)
    leave = int((enter[:, None] + m).max(axis=0).argmax())
    assert chat.viterbi(hmm, syms, enter, leave) == list(best)


@pytest.mark.parametrize("line,mark,rest", [("User: hi", 1 + 1, "hi"), ("**Support agent**: x", 3, "x"), ("[human 2] y", 2, "y"), ("Maria:", 4, ""), ("> q", 5, "> q"), ("http://x", 0, "http://x"), ("a plain line", 0, "a plain line"), ("", 0, ""), ("note that: this", 0, "note that: this"), ("AI: z", 3, "z")])
def test_speaker_markers(line, mark, rest):
    s, left = chat.symbol(line)
    assert (s // 12, left) == (mark, rest)


def chat_rows(seed):
    r, rows = random.Random(seed), []
    for c in [*range(6), None]:
        for t in range(r.choice([1, 3, 20, 90])):
            role = r.choice([*chat.ROLES, *chat.ROLES, None, "tool"])
            text = "\n".join(r.choice(["", "User: ", "Bot: ", "> ", "Ann: "]) + r.choice(["x", "why?", "- item", "long " * 20]) for _ in range(r.randrange(1, 4)))
            rows.append((c, t, role, text, "x"))
    # without a turn, one turn throughout, repeated in full, null texts
    return rows + [(1, None, "system", None, "x"), (50, 0, None, "x", "x"), (50, 1, "user", "x", "x"), (51, None, "user", "", "x")] + [(52, 7, "user", f"t{k % 3}", "x") for k in range(9)]


def in_order(rows):
    convs = {}
    for c, t, role, text, _ in sorted(rows, key=lambda x: (str(x[0]), x[1] is not None, x[1] or 0, x[3] or "")):
        convs.setdefault(c, []).append((t, chat.ROLES.index(role) if role in chat.ROLES else -1, *chat.symbols(text)))
    return convs


@pytest.mark.parametrize("block,parts", [(2, 3), (256, 8)])
def test_chat_tables_and_roles_against_one_pass(spark, monkeypatch, block, parts):
    from tracelens.session import ensure_checkpoint_dir

    monkeypatch.setattr(chat, "BLOCK", block)
    ensure_checkpoint_dir(spark)
    rows = chat_rows(6)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, roles string").repartition(parts)
    blocks = chat.in_blocks(df).checkpoint()
    start, step, emit = np.ones(3), np.ones((2, 3, 3)), np.ones((3, chat.N_SYMBOLS))
    convs = in_order(rows)
    for run in convs.values():
        before = None
        for _, role, syms, _ in run:
            for s in syms:
                if role >= 0:
                    emit[role, s] += 1
                    if before is None:
                        start[role] += 1
                    elif before >= 0:
                        step[chat.marked(s), before, role] += 1
                before = role
    hmm = chat.fit(blocks)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    assert np.allclose(np.exp(hmm.start), norm(start)) and np.allclose(np.exp(hmm.step), norm(step)) and np.allclose(np.exp(hmm.emit), norm(emit))
    got = {}
    for r in sorted(chat.recover(blocks, hmm).collect(), key=lambda r: (r.block, r.at)):
        got.setdefault(r.conv_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for c, run in convs.items():
        syms, lines = [s for x in run for s in x[2]], [y for x in run for y in x[3]]
        enter = hmm.start - math.log(3)
        score = enter
        for s in syms:
            score = (score[:, None] + hmm.advance(s)).max(axis=0)
        roles = [chat.ROLES[x] for x in chat.viterbi(hmm, syms, enter, int(score.argmax()))]
        assert [x for r in got[c] for x in r.roles] == roles and [r.turn for r in got[c]] == [x[0] for x in run]
        starts = [k == 0 or roles[k] != roles[k - 1] or s // 12 in (1, 2, 3, 4) for k, s in enumerate(syms)]
        assert [x for r in got[c] for x in r.starts] == starts
        whole = "".join(r.rendered for r in got[c])
        assert whole == chat.render(roles, starts, lines)
        turns = re.findall(r"<\|(\w+)\|>\n(.*?)<\|end\|>\n", whole, re.S)
        assert len(turns) == sum(starts) and "".join(t for _, t in turns) == "".join(x + "\n" for x in lines)


def test_chat_edges(spark):
    df = spark.createDataFrame([(1, 0, None, "x"), (1, 1, "tool", None)], "conv_id long, turn long, role string, text string")
    assert {tuple(r.roles) for r in chat.parse_chats(df)[0].collect()} == {("system",)}
    assert chat.parse_chats(df.limit(0))[0].count() == 0


def test_chat_roles_of_conversations_held_out(spark):
    """Lines without a marker, of conversations that nothing was counted from, against a guess by place alone."""
    messages = chat.raw_transcripts(spark.read.parquet("/root/testdata/sf0.1/conversations.parquet"))
    out, blocks = chat.parse_chats(messages, ~chat.held_out(F.col("conv_id")))
    rows = out.join(blocks.select("conv_id", "block", "at", "role", "text"), ["conv_id", "block", "at"]).collect()
    place, lines, seen = {}, [], {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.block, r.at)):
        out_ = zlib.crc32(str(r.conv_id).encode()) % 4 == 2
        for found, line in zip(r.roles, r.text.split("\n")):
            k = seen[r.conv_id] = seen.get(r.conv_id, -1) + 1
            lines.append((out_, r.role, found, k, chat.marked(chat.symbol(line)[0])))
            if not out_:
                place.setdefault(k, {}).setdefault(r.role, []).append(1)
    bare = [x for x in lines if x[0] and not x[4]]
    guess = lambda k: max(place.get(k, {"user": [1]}).items(), key=lambda x: len(x[1]))[0]
    mine, theirs = (sum(f(x) == x[1] for x in bare) / len(bare) for f in (lambda x: x[2], lambda x: guess(x[3])))
    assert len(bare) > 1000 and mine > theirs and mine > 0.75, (mine, theirs)


def test_even_labels_fill_each_partition_once(spark):
    from tracelens.llm.common import even_labels

    for n in (1, 5, 37):
        df = spark.createDataFrame([(k,) for k in even_labels(n)], "bucket int").repartition(n, "bucket")
        assert [r.p for r in df.select("bucket", F.spark_partition_id().alias("p")).orderBy("p").collect()] == list(range(n))


def test_suffix_dedup_slices_get_equal_shares(spark):
    """Anchors are least hashes, yet no slice has more than its share of them; the keys' upper halves are enough to send."""
    import random

    import numpy as np

    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(200_000)).encode()
    key = suffix_dedup.Anchors().find([text])[3]
    slices = suffix_dedup.Slices(50, None)
    number = slices.of(key)
    shares = np.bincount(number, minlength=slices.count)
    assert shares.max() < 2 * shares.mean()
    back = np.concatenate([slices.key((key[number == k] >> np.uint64(32)).astype(np.uint32), k) for k in range(slices.count)])
    assert (slices.of(back) == np.sort(number)).all() and suffix_dedup.Slices(4, 1 << 30).tasks >= 128


@pytest.mark.parametrize("portion,flush", [(1 << 19, 400_000), (300, 50)])
def test_suffix_dedup_in_passes(spark, monkeypatch, tmp_path, portion, flush):
    """Each pass has its share of the anchors, and together they give the whole result."""
    monkeypatch.setattr(suffix_dedup, "PASS_BYTES", 0)
    monkeypatch.setattr(suffix_dedup, "PASSES", 3)
    monkeypatch.setattr(suffix_dedup, "PORTION", portion)
    monkeypatch.setattr(suffix_dedup, "FLUSH", flush)
    rows = copies() + [(80, copies()[0][1] * 5), (81, None), (None, copies()[0][1])]
    docs(spark, rows).write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    got = suffix_dedup.removals(read).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_spans(rows)
    numbered, slices = suffix_dedup._numbered(read), suffix_dedup.Slices(4, None)

    def sent(*part):
        return suffix_dedup.packed_anchors(numbered, slices, *part).select(F.sum(F.octet_length("span"))).first()[0]

    parts = [sent(k, 3) for k in range(3)]
    assert sum(parts) == sent() and max(parts) < 0.7 * sum(parts)


def test_suffix_dedup_fetches_no_context_for_its_anchor_alone(spark):
    """Texts that share an anchor of 20 bytes, as ever more do in a larger table, but no string of 50 bytes."""
    many = rnd(7, 2000).encode()
    found = suffix_dedup.Anchors().find([many])
    at = int(found[5][np.argmin(found[3])])
    core = many[at : at + suffix_dedup.CORE].decode()
    rows = [(k, rnd(1000 + k, 20) + core + rnd(5000 + k, 20)) for k in range(40)]
    shared = [(100, rnd(1, 20)[-25:] + core + rnd(5000, 20)), (101, rnd(1010, 20) + core + rnd(2, 20))]  # the right side of 0, the left one of 10
    slices = suffix_dedup.Slices(4, None)

    def asked(rows):
        packed = suffix_dedup.packed_anchors(suffix_dedup._numbered(docs(spark, rows)), slices)
        return {r.doc_id for r in suffix_dedup.settle(slices.deal(packed), slices).where("key is not null").collect()}

    assert len(asked(rows)) <= 20
    assert {0, 10, 100, 101} <= asked(rows + shared)
    assert removed(spark, rows + shared) == brute_spans(rows + shared)

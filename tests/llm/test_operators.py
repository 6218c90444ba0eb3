"""The operators against brute force, the public libraries, and rows that are hard to take."""

import hashlib
import itertools
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from pactframe.llm import bpe, minhash, mil, packing, quality_rules, secret_labels, secrets, topk, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
HARD = [None, "", " \t\n", "x", "It's 'S DON'T <|endoftext|> x", "İI ß ΣΑΣ é", "日本語 \U0001f600", "\x1c a\x85b\x00", "a" * 30_000, "ab " * 20_000, "  lead\n\n trail  "]


def shingle_set(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows, percent):
    sets, up = [(i, shingle_set(t)) for i, t in rows], {i: i for i, _ in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            low, high = sorted((top(i), top(j)))
            up[high] = low
    return {i: top(i) for i, _ in rows}


def near_rows():
    rng = random.Random(5)
    rows = []
    for m in range(40):  # one template, no two linked
        rows.append((m, " ".join([*(f"w{i}" for i in range(300)), *(f"x{m}_{j}" for j in range(60))])))
    words = [f"c{i}" for i in range(400)]
    for i in range(40):  # a chain: each is linked with its neighbours only
        words = list(words)
        for _ in range(2):
            words[rng.randrange(400)] = f"new{i}_{rng.random()}"
        rows.append((1000 + i, " ".join(words)))
    for i in range(60):  # edits of one base, some linked
        base = [f"b{j}" for j in range(80)]
        for _ in range(rng.randrange(3)):
            base[rng.randrange(80)] = f"e{i}"
        rows.append((2000 + i, " ".join(base)))
    return rows + [(3000, None), (3001, ""), (3002, "a b"), (3003, "A  b"), (3004, rows[0][1])]


def test_near_duplicates_against_brute_force(spark):
    rows = near_rows()
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
    want = brute_components(rows, 85)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(shingle_set(dict(rows)[r.doc_id])) and r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_document_of_each_group_stays(spark):
    rows = [(1, "a b c d e f", "x"), (2, "A b c d e f", "y"), (5, "q r s t u v", "z"), (5, "q r s t u v", "z"), (5, "other words of the same id here", "w"), (None, None, "n"), (7, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = minhash.keep(docs, percent=80)
    assert kept.columns == docs.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [rows[0], rows[2], rows[4], rows[5], rows[6]]))
    assert minhash.keep(docs.limit(0)).count() == 0


def test_transducer_against_tiktoken():
    import tiktoken

    content = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    c = bpe.Codec(content, public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.fst.ranks, special_tokens={})
    rng = random.Random(2)
    texts = [t or "" for t in HARD] + ["".join(rng.choice("abcdefgh é日") for _ in range(500)) for _ in range(20)]
    for text in texts:
        ids = list(array("I", c.encode(text)))
        assert ids == enc.encode_ordinary(text)
        assert "".join(c.decode(ids, chunk=3)) == text


def test_transducer_states_are_shared_and_bounded(monkeypatch):
    content = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    monkeypatch.setattr(bpe, "STATES", 50)
    fst = bpe.Transducer(bpe.read_ranks(content))
    for word in (b" qwertzuiop", b" asdfghjklq", b"x" * 5000):
        assert b"".join(fst.bytes_of[i] for i in fst.encode(word)) == word
    assert len(fst.states) <= 50


def test_packing_is_exact(spark):
    rows = [*enumerate(HARD), (100, "word " * 9000), (100, "word " * 9000), (None, "null id")]
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, size int"), path).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    want = Counter()
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        for at in range(0, len(ids), 4096):
            want[i, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        end = 0
        for at, n in sorted(own):
            assert at == end
            end += n
        assert end <= 4096
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


@pytest.mark.parametrize("sizes", [{}, {256: 7}, {3: 5, 200: 1}, {100: 90, 60: 40, 28: 1000}, {s: 10 for s in range(1, 257, 3)}])
def test_plan_holds_every_piece(sizes):
    patterns = packing.plan(sizes)
    held = Counter()
    for pattern, times in patterns:
        assert sum(s * k for s, k in pattern.items()) <= packing.UNITS
        for s, k in pattern.items():
            held[s] += k * times
    assert held == Counter(sizes)
    area = sum(s * n for s, n in sizes.items()) / packing.UNITS
    assert sum(n for _, n in patterns) <= area * 1.5 + 2


def test_secrets_of_unseen_findings(spark):
    forest = secrets.fit(spark)
    rows = secret_labels.labelled(seed=77, each=20)
    docs = spark.createDataFrame([(i, t, p, s) for i, (t, p, s) in enumerate(rows)], "doc_id long, text string, source string, secret boolean")
    got = secrets.candidates(docs, forest, path_col="source", keep_cols=["doc_id", "secret"]).collect()
    best = defaultdict(float)
    for r in got:
        best[r.doc_id, r.secret] = max(best[r.doc_id, r.secret], r.score)
    right = sum((score >= 0.5) == secret for (_, secret), score in best.items())
    assert right >= 0.97 * len(best)
    texts = {i: t for i, (t, _, _) in enumerate(rows)}
    assert all(texts[r.doc_id][r.start : r.start + r.length] == r.value for r in got)


def test_secret_candidates_against_python_patterns(spark):
    texts = [t for t, _, _ in secret_labels.labelled(seed=5, each=4)] + [t or "" for t in HARD]
    find = re.compile(secrets.FIND.replace("]{0,20}+", "]{0,20}+"), re.ASCII)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(list)
    for r in secrets.candidates(docs, secrets.Forest(np.zeros((0, 1)), np.zeros(0)), keep_cols=["doc_id"]).collect():
        got[r.doc_id].append((r.start + r.length, r.value))
    head = re.compile(secrets.HEAD, re.ASCII)
    for i, text in enumerate(texts):
        assert sorted(got[i]) == sorted((m.end(), head.sub("", m.group())) for m in find.finditer(text))


def test_redaction_keeps_rows_and_columns(spark):
    key = "AKIA" + "Q7W3E9R1T5Y8U2I4"
    rows = [(1, f"use {key} here", "src", 99, "k"), (2, "clean text only", "src", 15, None), (3, None, None, None, "x"), (4, "", "", 0, ""), (1, f"use {key} here", "src", 99, "k"), (5, f'token = "{"0a1b2c3d4e" * 4}" end', None, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, g string")
    out = secrets.redact(docs, path_col="source", length_col="n_chars")
    assert out.columns == docs.columns
    got = sorted(map(tuple, out.collect()), key=str)
    want = sorted([(1, "use [SECRET] here", "src", 17, "k"), rows[1], rows[2], rows[3], (1, "use [SECRET] here", "src", 17, "k"), (5, 'token = "[SECRET]" end', None, 22, None)], key=str)
    assert got == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype("float32").tolist()) for i in range(400)] + [(50, [None] * 8), (401, None), (402, [float("nan")] * 8), (None, [1.0] * 8), (403, [])]
    rows += [(500, [0.5] * 8), (501, [0.5] * 8), (502, [0.5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in topk.top_k(df, df.filter("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in good:
        if q % 50 == 0:
            assert got[q] == sorted(((i, int(v @ w)) for i, w in good if i != q), key=lambda x: (-x[1], x[0]))[:5]


def test_top_k_of_an_id_with_a_bad_vector_and_of_chunks(spark, monkeypatch):
    rows = [(50, [None, 1.0]), (50, [1.0, 1.0]), (100, [1.0, 0.0]), (3, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = topk.top_k(df, df.filter("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in whole if r.query_id == 50] == [3, 100]
    monkeypatch.setattr(topk, "CHUNK", 1)
    assert topk.top_k(df, df.filter("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect() == whole


def test_warc_round_trip(spark):
    rows = [(3, "http://a.org/", "<p>é</p>"), (1, "http://b.org/", "<p>é</p>"), (2, None, None), (4, "x", ""), (5, "y", "long " * 50_000)]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), min_bytes=0).collect()}
    import base64

    for i, _, html in rows:
        body = (html or "").encode()
        assert got[i].payload_bytes == len(body) and got[i].payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert (got[1].record_type, got[3].record_type, got[3].refers_to) == ("response", "revisit", 1)
    assert (got[2].record_type, got[4].refers_to) == ("response", 2)


def test_quality_rules_on_hard_rows(spark):
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None, "k") for i, t in enumerate(HARD)], "doc_id long, text string, lang string, kept string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    for i, text in enumerate(HARD):
        words = WORD.findall(text or "")
        assert (got[i].n_words, got[i].word_chars) == (len(words), sum(map(len, words)))
        assert got[i].n_symbols == sum((text or "").count(c) for c in "#*$%&|<>")
        assert got[i].kept == (not got[i].base_failed)
    assert quality_rules.keep(docs, labels).columns == docs.columns


def test_classifier_learns_and_takes_hard_rows(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["good", "words", "and", "more"]) for _ in range(80)) if i % 2 else "#$% " * rng.randrange(40, 90)) for i in range(120)]
    docs = spark.createDataFrame([*rows, *((1000 + i, t) for i, t in enumerate(HARD))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in mil.classify(docs, labels).collect()}
    held = [i for i, _ in rows if got[i].held_out]
    assert held and all(zlib.crc32(str(i).encode()) % 4 == 2 for i in held)
    assert sum((got[i].score >= 0.5) == bool(i % 2) for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_pipeline_on_rows_and_on_nothing(spark, tmp_path):
    import corpus_pipeline

    src = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{src}/documents.parquet"), spark.read.parquet(f"{src}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, src)
        if name != "packing":
            assert after.columns == docs.columns
            assert after.count() <= now.count()
        now = after
    assert now.select("doc_id").distinct().count() == after.select("doc_id").distinct().count() > 0
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

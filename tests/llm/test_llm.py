import math
from collections import Counter

import numpy as np
import public_tokenizers

from pactframe.llm.bpe import encode_decode
from pactframe.llm.minhash import near_duplicates
from pactframe.llm.quality_rules import RULES, binomial_tail, cutoffs, measure
from pactframe.llm.token_count import count_tokens
from pactframe.llm.urls import judge
from pactframe.llm import mil
from pactframe.llm.mil import encode, train

DOCS = "doc_id long, text string, lang string, id string"
ROWS = [(1, "a b c d e f g h i j", "en", "x"), (2, "A b c d e f g h i j", "en", "y"), (3, None, None, None), (4, "", "de", None), (5, "word " * 3000, "en", "z"), (None, "a b", "en", "q")]


def test_binomial_tail_is_exact():
    for n, p in ((10, 0.3), (40, 0.01)):
        for k in range(n):
            want = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
            assert abs(binomial_tail(k, n, p) - want) < 1e-12


def test_repeated_words_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        words = [f"w{x}" for x in rng.integers(0, 3, rng.integers(0, 40))]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        times, hit = Counter(windows), set()
        for i, w in enumerate(windows):
            if times[w] > 1:
                hit |= set(range(i, i + 5))
        assert measure(" ".join(words))["n_repeat_words"] == len(hit)


def test_attention_gradients():
    rng = np.random.default_rng(0)
    bags = [encode(t) for t in ["good words here " * 60, "BAD!! " * 200, "", "fine text again " * 9] * 4]
    model = train(bags, np.array([1, 0, 1, 1] * 4))
    assert 0 <= model.score(None) <= 1
    for name in ("c", "w"):
        model.parts[name] = rng.normal(0, 1, model.parts[name].shape)
    model.parts = {k: v.astype(np.float64) for k, v in model.parts.items()}
    x, bag, y = np.concatenate(bags[:4]).astype(float), np.repeat(range(4), [len(b) for b in bags[:4]]), np.array([1.0, 0, 1, 1])

    def loss():
        _, h, _, _, a = model.passages(x)
        z = [(np.exp(a[bag == i]) / np.exp(a[bag == i]).sum()) @ h[bag == i] for i in range(4)]
        p = 1 / (1 + np.exp(-(np.array(z) @ model.parts["c"] + model.parts["b"])))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    got = model.gradients(x, bag, y)
    for name in ("w", "c"):
        at, keep = 0, model.parts[name][0]
        model.parts[name][at] = keep + 1e-5
        up = loss()
        model.parts[name][at] = keep - 1e-5
        down = loss()
        model.parts[name][at] = keep
        assert abs((up - down) / 2e-5 - got[name][at]) < 1e-4


def test_near_duplicates_of_edge_rows(spark):
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(ROWS, DOCS), percent=85).collect()}
    assert got[2].component_id == 1 and not got[2].kept and got[1].kept
    assert got[3].n_shingles == got[4].n_shingles == 0 and got[3].kept and got[4].kept
    assert got[None].component_id is None
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_tokens_of_edge_rows(spark):
    import sentencepiece

    docs = spark.createDataFrame(ROWS, DOCS)
    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = {r[0]: r[1] or "" for r in ROWS}
    for r in count_tokens(docs, model).collect():
        assert r.n_tokens == len(sp.encode(texts[r.doc_id]))
    for r in encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True).collect():
        assert r.decoded == texts[r.doc_id]


def test_url_rules(spark):
    rows = [(1, "http://A.example.com/en/7x?q"), (2, None), (3, "no scheme"), (4, "https://org/es/#a"), (5, "http://xorg/es/")]
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("org", "/es/", "block")]
    got = {r.page_id: r for r in judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[2].host == got[3].path == "" and got[2].rule is None
    assert got[4].rule == "org/es/" and got[5].rule is None


def test_cutoffs_of_small_and_large_strata(spark):
    clean, junk, lines = (0.0, 0.0, 0.0, 5.0), (0.3, 0.0, 0.0, 5.0), (0.0, 0.9, 0.0, 5.0)
    rows = [(s, True, *clean) for s, n in (("a", 217), ("b", 216), ("c", 4000), (None, 300)) for _ in range(n)]
    rows += [(s, False, *junk) for s in ("a", "b", "c", None) for _ in range(9)]
    # in c, good texts break the first rule, and bad ones also the second
    rows += [("c", True, *junk) for _ in range(200)] + [("c", False, *lines) for _ in range(9)]
    got = {r.stratum: r for r in cutoffs(spark.createDataFrame(rows, "stratum string, good boolean, " + ", ".join(f"{r} double" for r in RULES))).collect()}
    # four strata: 217 good texts certify, 216 don't
    assert got["a"].symbols is not None and got["a"].symbols < 0.3 and got["a"].dup_lines is None
    assert got[None].symbols is not None
    assert all(got["b"][r] is None for r in RULES)
    assert got["c"].symbols is None and got["c"].dup_lines is not None


def test_undecided_urls_do_not_follow_the_rules(spark):
    spam, plain = ("poker-club.shop", "www.viagra-now.shop"), ("harbour.shop", "www.poetry.shop")
    hosts = [f"{h}.{s}" for s in ("com", "net", "org") for h in spam + plain]
    # rules that block all they decide of .org and allow all of .net
    rows = [*enumerate(f"https://{h}/en/{i}" for i, h in enumerate(hosts)), *((100 + i, f"http://h{i}.{s}/x/{i}") for i, s in enumerate(["org", "net"] * 200))]
    got = judge(spark.createDataFrame(rows, "page_id long, url string"), [("org", "/x/", "block"), ("net", "/x/", "allow")]).filter("page_id < 100").collect()
    assert len(got) == len(hosts) and all(r.rule is None for r in got)
    for r in got:
        assert r.verdict == ("block" if r.host.rsplit(".", 1)[0] in spam else "allow"), r


def test_fit_learns_from_every_passage(spark, monkeypatch):
    texts = ["good words here " * 9_000, "short text", "BAD!! " * 200, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i != 2)) for i in range(4)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(mil, "train", lambda bags, y, seed=7: seen.extend(np.array(b) for b in bags))
    mil.fit(docs, labels)
    assert len(seen[0]) > 64 and len(seen) == 4
    for got, text in zip(seen, texts):
        assert np.array_equal(got, encode(text).astype(np.float16))


def test_gradients_in_parts(monkeypatch):
    bags, y = [encode(t) for t in ["good words here " * 90, "BAD!! " * 200, "", "fine text " * 99]], np.array([1, 0, 1, 1])
    model = train(bags, y)
    whole = mil.batch_gradients(model, bags, y, np.array([2, 0, 3, 1]))
    monkeypatch.setattr(mil, "PART", 2)
    parts = mil.batch_gradients(model, bags, y, np.array([2, 0, 3, 1]))
    assert all(np.allclose(whole[k], parts[k], rtol=1e-3, atol=1e-5) for k in whole)


def test_every_operator_is_registered():
    from pactframe.llm.queries import queries

    assert {f"op{n}" for n in range(1, 11)} == {name.split("_")[0] for name in queries()}

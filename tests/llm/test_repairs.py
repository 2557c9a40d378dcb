"""Capitals with marks, hard vector sets, pipeline stages on odd rows."""

import random
from array import array

import numpy as np
import pytest

from tabsight.llm import graph_ann, mixing, rans_store
from tabsight.llm.common import fresh, tokenizer_path


def test_capitals_with_marks_equal_the_library():
    import unicodedata

    from tokenizers import Tokenizer
    path = tokenizer_path(rans_store.MODEL)
    lib, mine = Tokenizer.from_file(path), rans_store.ChunkTokens(path)
    marks = [chr(c) for c in range(0x300, 0x370)]
    texts = []
    for code in [*range(65, 91), *range(0xC0, 0x250), *range(0x386, 0x3D0), *range(0x400, 0x460), *range(0x1E00, 0x2000)]:
        c = chr(code)
        if c.lower() == c:
            continue
        for m in marks:
            if len(unicodedata.normalize("NFC", c.lower() + m)) < len(c.lower() + m):
                texts += [f"{c}{m}", f"word {c}{m}x end."]
    assert len(texts) > 500
    texts += ["Ϊ́ x", "J̌ x", "ΟΔΟΣ ΟΔΟΣ.", "İstanbul İ", "Ǻ B", "a B c\x1fd\x85e\x0bf"]
    for t in texts:
        got = array(mine.code, mine.encode([t])[0]).tolist()
        assert got == lib.encode(t, add_special_tokens=False).ids, ascii(t)


def _sets(rng):
    plain = rng.normal(size=(1500, 16))
    centres = rng.normal(size=(30, 16))
    clusters = centres[rng.integers(0, 30, 1500)] + 1e-4 * rng.normal(size=(1500, 16))
    return {"plain": plain, "shifted": plain + 1e4, "far": plain + 1e7, "huge": plain * 1e25, "tiny": plain * 1e-25,
            "clusters": clusters, "clusters far off": clusters + 100.0}


@pytest.mark.parametrize("kind", list(_sets(np.random.default_rng(0))))
def test_graph_recall_on_hard_sets(spark, kind):
    x = _sets(np.random.default_rng(7))[kind]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in graph_ann.nearest(df, every=50, shard_rows=800).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, len(x), 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits / (10 * len(got)) >= 0.9


def test_equal_vectors_and_one_row(spark):
    df = spark.createDataFrame([(i, [3.0, 4.0]) for i in range(60)], "vec_id long, embedding array<double>")
    got = graph_ann.nearest(df, every=50).collect()
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in got} == {
        (q, k + 1): v for q in (0, 50) for k, v in enumerate([i for i in range(12) if i != q][:10])}
    assert graph_ann.nearest(df.limit(1), every=1).count() == 0


def test_shards_of_the_mix(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(rng.randint(1, 30))), f"s{i % 3}") for i in range(900)] + [(900, None, None), (None, "a b", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix_documents(df, shards=4)
    by_shard = {r["mix_shard"]: r["count"] for r in mixed.groupBy("mix_shard").count().collect()}
    assert set(by_shard) == {0, 1, 2, 3}
    report = {r["doc_id"]: r for r in mixing.mix_report(df, shards=4).collect()}
    shown = {}
    for r in mixed.select("doc_id", "mix_shard").collect():
        shown.setdefault(r["doc_id"], []).append(r["mix_shard"])
    for i, r in report.items():
        assert r["shards"] == ",".join(map(str, sorted(shown.get(i, []))))
        assert r["taken"] == r["size"] * len(shown.get(i, []))
    dealt = mixing.deal_out(mixed)
    assert dealt.columns == df.columns and dealt.rdd.getNumPartitions() == 4
    sizes = [n for n in dealt.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()]
    assert sizes == [by_shard[k] for k in range(4)]
    order = mixed.where("mix_shard = 2").orderBy("mix_order").select("doc_id").collect()
    assert dealt.rdd.mapPartitionsWithIndex(lambda k, p: [r["doc_id"] for r in p] if k == 2 else []).collect() == [r[0] for r in order]


ODD = "doc_id long, text string, lang string, source string, n_chars long, mix_shard int, mix_order long, __id string, " \
      "__language map<string,int>, __pieces array<int>, __row string, id int, print string"


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(2)
    words = {"en": "the and of house water with".split(), "fr": "le été ça maison eau avec".split()}
    texts = [(k, " ".join(rng.choice(words[k]) for _ in range(rng.randint(8, 40)))) for _ in range(60) for k in words]
    rows = [(i, t, k, f"s{i % 3}") for i, (k, t) in enumerate(texts)]
    rows += [(300, None, "en", "s0"), (None, "the house of water " * 5, "en", None), (None, None, None, None), (301, "", None, "s1"),
             (302, "le maison zeb@mail.org", "fr", "s1"), (5, texts[5][1], "fr", "s2"), (5, texts[5][1], "fr", "s2"), (6, "other text", "en", "s2")]
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, "i", {"a": 1}, [1], "r", 3, "p") for r in rows], ODD)


def test_stages_on_odd_rows(spark, odd):
    import corpus_pipeline as P
    stages = dict(P.STAGES)
    for name, stage in P.STAGES:
        out = stage(spark, odd, "")
        rows = out.collect()
        if name != "pieces":
            assert out.columns == odd.columns, name
        if name == "personal data":
            assert len(rows) == odd.count() and sum(r["text"] is None for r in rows) == 2
            assert not any("zeb@mail.org" in (r["text"] or "") for r in rows)
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
        if name == "near-duplicates":
            ids = [r["doc_id"] for r in rows]
            assert ids.count(None) == 2 and ids.count(5) <= 1 and ids.count(6) <= 1 and {300, 301} <= set(ids)
        if name == "language ID":
            assert all(any(c.isalpha() for c in r["text"]) for r in rows) and len(rows) >= 120
        if name == "source mix":
            words = sum(len((r["text"] or "").split()) for r in rows)
            assert words == pytest.approx(1.5 * sum(len((r["text"] or "").split()) for r in odd.collect()), rel=0.1)
        if name == "pieces":
            assert len(rows) == odd.count() and all(r["n_tokens"] >= 2 for r in rows)
        empty = stages[name](spark, odd.limit(0), "")
        assert empty.count() == 0 and empty.columns == out.columns, name


def test_clean_short_documents_stay(spark, odd):
    import corpus_pipeline as P
    rows = [(1000 + i, t, None, "s", len(t)) for i, t in enumerate(["the house", "le maison", "water with", "été avec"])]
    labelled = odd.select("doc_id", "text", "lang", "source", "n_chars")
    docs = labelled.union(spark.createDataFrame(rows, labelled.schema))
    kept = {r["doc_id"] for r in P.identify_language(spark, docs, "").collect()}
    assert {1000, 1001, 1002, 1003} <= kept


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "A int, a_ int, b int")
    assert fresh(df, "a", "b", "b", "c") == ["a__", "b_", "b__", "c"]


def test_very_many_matches_in_one_text(spark):
    import time

    from tabsight.llm import pii
    n = 100_000
    text = " ".join(f"u{i}@h{i % 7}.org" for i in range(n))
    df = spark.createDataFrame([(1, text), (2, "plain"), (3, "9.9.9.9 " * 3)], "doc_id long, text string")
    began = time.time()
    rows = {r["doc_id"]: r for r in pii.span_report(df).collect()}
    assert rows[1]["n_email"] == n and rows[3]["n_ip"] == 3
    assert rows[1]["spans"].startswith("email:0:9,email:10:19,") and rows[1]["spans"].endswith(f":{len(text)}")
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert out[1] == " ".join(["[EMAIL]"] * n) and out[3] == "[IP] [IP] [IP] "
    assert time.time() - began < 120


def test_template_documents_cost_in_proportion(spark):
    """Pages of one template, linked with nothing, are not compared with each
    other: four times as many take nowhere near sixteen times as long."""
    import time

    from tabsight.llm import minhash_dedup
    rng = random.Random(3)
    template = " ".join(f"t{i}" for i in range(60))

    def pages(n):
        return spark.createDataFrame([(i, f"{template} " + " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(25))) for i in range(n)],
                                     "doc_id long, text string")
    took = {}
    for n in (1000, 4000):
        began = time.time()
        out = minhash_dedup.near_duplicates(pages(n))
        assert out.where("kept").count() == n
        took[n] = time.time() - began
    assert took[4000] < 4 * took[1000] + 5

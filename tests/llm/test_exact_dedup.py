"""Exact duplicates against a dictionary, with odd rows and a heavy group."""

import hashlib
import string

import pytest

from tabsight.llm import exact_dedup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
TEXTS = ["Same Text", "same text", "SAME TEXT ", None, "", "É", "é", "ÉA", "Éa", "İ", "K", "k", "K", "x" * 200_000,
         "X" * 200_000, "a\x00B", "a\x00b", "😀Z", "😀z"] + ["hot ROW"] * 40 + ["Hot row"] * 3 + [f"only {i}" for i in range(60)]
#: Columns whose names are those that the operator uses inside.
SCHEMA = "doc_id long, text string, id int, row string, digest string, size map<string,int>, best array<int>, kept int"


def _rows(texts):
    return [(i, t, 1, "r", "d", {"a": 1}, [1], 0) for i, t in enumerate(texts)]


def _want(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    return groups


@pytest.mark.parametrize("support", [0.001, 0.2, 0.9])  # most groups heavy, one heavy, none heavy
def test_groups_equal_a_dictionary(spark, support):
    rows = _rows(TEXTS)
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, SCHEMA).repartition(5), support=support).collect()
    assert len(got) == len(rows)
    groups = _want(rows)
    for r in got:
        text = (TEXTS[r["doc_id"]] or "").translate(LOWER)
        ids = groups[text]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(ids), len(ids), r["doc_id"] == max(ids))
        assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("support", [0.001, 0.9])
def test_null_and_repeated_ids(spark, support):
    rows = [(None, "a"), (None, "A"), (5, "a"), (5, "a"), (None, "b"), (None, "b"), (9, None), (9, ""), (2, "c"), (2, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.exact_groups(df, support=support).collect()
    digest = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("a", "b", "", "c", "d")}
    by = {t: [r for r in got if r["text_sha256"] == d] for t, d in digest.items()}
    assert {t: (len(r), r[0]["keep_id"], r[0]["group_size"]) for t, r in by.items()} == {
        "a": (4, 5, 4), "b": (2, None, 2), "": (2, 9, 2), "c": (1, 2, 1), "d": (1, 2, 1)}
    assert all(sum(r["kept"] for r in x) == 1 for x in by.values())
    assert next(r for r in by["a"] if r["kept"])["doc_id"] == 5


def test_deduplicate_keeps_all_columns(spark):
    rows = _rows(TEXTS)
    df = spark.createDataFrame(rows, SCHEMA)
    out = exact_dedup.deduplicate(df.union(df.limit(9)), support=0.2)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(max(i) for i in _want(rows).values())


def test_empty_and_heavy_bound(spark):
    df = spark.createDataFrame(_rows(TEXTS), SCHEMA)
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0 and exact_dedup.deduplicate(df.limit(0)).count() == 0
    rows = df.selectExpr("doc_id AS id", "doc_id AS row", "lower(coalesce(text, '')) AS digest")
    heavy = exact_dedup.heavy_hitters(rows, 0.1).collect()  # at most 10, and none that is not one
    assert [(r["digest"], r["size"], r["best"]["id"]) for r in heavy] == [("hot row", 43, TEXTS.index("Hot row") + 2)]


def test_no_python_on_its_path(spark):
    df = spark.createDataFrame(_rows(TEXTS), SCHEMA)
    plan = exact_dedup.exact_groups(df)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian", "BroadcastNestedLoop"))

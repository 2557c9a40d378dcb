"""No join broadcasts rows that an explode has made, whatever Spark takes their size to be."""

import random

import pytest

from tabsight.llm import common, components, minhash_dedup, pii


@pytest.fixture()
def plans(monkeypatch):
    """(name, plan before the run) of every table that is written."""
    seen = []

    def keep(df, name):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return common.keep(df, name)
    for module in (minhash_dedup, components, pii):
        monkeypatch.setattr(module, "keep", keep)
    return seen


def _broadcast_explodes(plan):
    """Lines with an explode below a broadcast."""
    out, open_ = [], []
    for line in plan.split("\n"):
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        open_ = [d for d in open_ if d < depth]
        if "BroadcastExchange" in line:
            open_.append(depth)
        elif open_ and "Generate explode" in line:
            out.append(line.strip())
    return out


def _docs(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(4000)}" for _ in range(60)) for _ in range(40)]
    texts += [f"{t} and {i} more" for i, t in enumerate(texts[:20])] + texts[:10]
    return spark.createDataFrame([(i, f"{t} zeb{i % 7}@mail.org", "en", "s", 1) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")


def test_near_duplicates_broadcast_no_exploded_keys(spark, plans):
    out = minhash_dedup.near_duplicates(_docs(spark))
    assert {r["n"]: r["count"] for r in out.groupBy((out["component_id"] == out["doc_id"]).alias("n")).count().collect()} == {
        True: 40, False: 30}
    assert {"buckets", "pairs", "links", "edges"} <= {n for n, _ in plans}
    assert not [x for _, p in plans for x in _broadcast_explodes(p)]


def test_pipeline_stages_broadcast_no_exploded_rows(spark, plans):
    import corpus_pipeline as P
    stages = dict(P.STAGES)
    kept = stages["near-duplicates"](spark, _docs(spark), "")
    assert kept.count() == 40
    assert not [x for _, p in plans for x in _broadcast_explodes(p)]
    stages["personal data"](spark, kept, "").count()
    entities = [p for n, p in plans if n == "entities"]
    assert entities and not [x for p in entities for x in _broadcast_explodes(p)]

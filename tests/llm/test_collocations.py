"""Phrase counts, scores and automata against plain dictionaries."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tabsight.llm import collocations
from tabsight.llm.count_transducer import DEPTH, CountTransducer, first_not_below, lower_bound, sum_paths

SCHEMA = "doc_id long, text string, lang string, k int, phrase string, f map<string,int>, range int, part string, rank int"


def _phrases(rows):
    counts, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            counts.update((lang, tuple(w[i:i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    return counts, n


def _want(rows, least, top):
    counts, n = _phrases(rows)
    longer = Counter()
    for (lang, p), f in counts.items():
        for k in range(2, len(p) if f >= least else 0):
            for i in range(len(p) - k + 1):
                longer[lang, p[i:i + k]] = max(f, longer[lang, p[i:i + k]])
    found = {}
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= least and 100 * longer[lang, p] < 80 * a:
            score, _, l, r = min((2000000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]])
                                 for k in range(1, len(p)))
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s)
            for lang, x in found.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top])}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = "a b the of é É ﬀ 😀 x\x00y New York \x1f \xa0 z-z".split(" ")
    texts = [None, "", " \t ", ".", "New York.", "a" * 100_000, ". ".join(["new YORK city hall"] * 50), "the " * 300]
    texts += [" ".join(rng.choices(words, [9, 8, 30, 20, 3, 3, 1, 1, 1, 4, 4, 1, 1, 2], k=rng.randint(1, 90)))
              .replace(" b ", rng.choice([" b. ", "\tb ", " b\n"])) for _ in range(150)]
    texts += [texts[20]] * 60  # a text of many rows
    return [(None if i % 11 == 3 else i, t, ("en", "fr", None, "und", "")[i % 5], 1, "p", {"a": 1}, 2, "q", 3)
            for i, t in enumerate(texts)]


def test_phrases_equal_plain_counting(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    counts, n = _phrases(rows)
    for range_words in (300, 1_000_000):  # many ranges, one range
        found, cuts = collocations.frequent_phrases(df, 30, range_words)
        assert (len(cuts) > 10) == (range_words == 300)
        got = {(r["lang"], tuple(r["phrase"].split(" "))): r["f"] for r in found.where("k > 0").collect()}
        assert got == {k: f for k, f in counts.items() if f >= 30}
        assert {r["lang"]: r["f"] for r in found.where("k = 0").collect()} == {k: v for k, v in n.items() if v}


@pytest.mark.parametrize("least, top, range_words", [(30, 2000, 1_000_000), (3, 40, 500)])
def test_collocations_equal_plain_counting(spark, rows, least, top, range_words, monkeypatch):
    monkeypatch.setattr(collocations, "QUESTIONS", 20)  # several tasks for a range
    monkeypatch.setattr(collocations, "SHARD_BYTES", 2000)
    df = spark.createDataFrame(rows, SCHEMA)
    got = collocations.collocations(df, least, top, range_words)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == _want(rows, least, top)


def test_no_rows_and_no_phrases(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert collocations.collocations(df.limit(0)).count() == 0
    assert collocations.collocations(df.limit(4)).count() == 0


def _random_paths(rng, words, n):
    ids = np.zeros((n, DEPTH), dtype=np.int64)
    for i in range(n):
        k = rng.integers(1, DEPTH + 1)
        ids[i, :k] = rng.integers(1, words, k)
    return sum_paths(ids, rng.integers(1, 5, n))


def test_automaton_round_trip_union_and_composition():
    rng = np.random.default_rng(1)
    words = [b""] + sorted(f"w{i}".encode() for i in range(1, 12))
    parts, total = [], Counter()
    for _ in range(5):
        ids, counts = _random_paths(rng, 12, 400)
        total.update({tuple(words[i] for i in row): n for row, n in zip(ids.tolist(), counts.tolist())})
        automaton = CountTransducer.from_bytes(CountTransducer.build(words, ids, counts).to_bytes())
        back = automaton.paths()
        assert (back[0] == ids).all() and (back[1] == counts).all()
        assert len(automaton.levels[3][0]) < len({tuple(r) for r in ids[:, :3].tolist()})  # equal states are one
        parts.append(automaton)
    whole = CountTransducer.union(parts)
    ids, counts = whole.paths()
    assert {tuple(whole.words[i] for i in r): n for r, n in zip(ids.tolist(), counts.tolist())} == total
    for d, (found, sums) in enumerate(whole.prefixes(0)):
        want = Counter()
        for p, n in total.items():
            if b"" not in p[:d]:
                want[p[:d]] += n
        assert {tuple(whole.words[i] for i in r): n for r, n in zip(found.tolist(), sums.tolist())} == want
    asked = {p: i for i, p in enumerate([*list(total)[:50], (b"w3", b"none", b"", b""), (b"zz", b"", b"", b"")])}
    question = CountTransducer.of_phrases([b" ".join(p).rstrip() for p in asked], list(asked.values()))
    which, weight = whole.compose(question)
    assert dict(zip(which.tolist(), weight.tolist())) == {i: total[p] for p, i in asked.items() if p in total}
    for p in [(b"w3", b"w5"), (b"w3", b"w55"), (b"a",), (b"zzz",), (b"w1", b"", b"", b"")]:
        at = first_not_below(ids, lower_bound(whole.words, p))
        rows = [tuple(whole.words[i] for i in r) for r in ids.tolist()]
        assert at == sum(r < p for r in rows)


def test_equal_prints_are_compared(monkeypatch):
    """States are told apart by their arcs when their prints are equal."""
    monkeypatch.setattr(np, "add", _Zero(np.add))
    rng = np.random.default_rng(2)
    ids, counts = np.unique(rng.integers(1, 5, (200, DEPTH)), axis=0), None
    counts = rng.integers(1, 3, len(ids))
    back = CountTransducer.build([b"", b"a", b"b", b"c", b"d"], ids, counts).paths()
    assert (back[0] == ids).all() and (back[1] == counts).all()


class _Zero:
    def __init__(self, add):
        self.add = add

    def __getattr__(self, name):
        return getattr(self.add, name)

    def __call__(self, *a, **b):
        return self.add(*a, **b)

    def reduceat(self, x, at):
        return np.zeros(len(at), dtype=np.uint64)

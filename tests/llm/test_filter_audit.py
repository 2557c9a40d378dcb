"""The filter audit against a plain simulation of every order."""

import re
from collections import Counter
from itertools import permutations

from tabsight.llm import filter_audit

LONG = " ".join(f"w{i}" for i in range(120))
TEXTS = [None, "", " \n", "short", "SHOUT LOUD", "50 % & more", LONG, LONG, "same " * 150, "SAME " * 150 + "#", LONG + " #",
         LONG.upper(), "é" * 9 + "A", "é" * 10 + "A", "a\xa0b " * 60, "a\x1fb " * 99, "x" * 300_000, "x\x0b" * 100, "short", "Short"]
SCHEMA = "doc_id long, text string, lang string, mask string, part int, id map<string,int>, good int, n int, first long"


def _docs(spark, texts):
    rows = [(i, t, ("en", "fr", "", None)[i % 4], "m", 3, {"a": 1}, 7, 8, 9) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def _fails(text, earlier):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {c for c, bad in zip("ABCDE", (
        len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        re.search(r"[#$%&*|]", text), earlier)) if bad}


def _simulate(rows, quality, toxic):
    out = Counter()
    for i, text, lang, *_ in rows:
        same = [r[0] for r in rows if (r[1] or "") == (text or "") and r[0] is not None]
        fails = _fails(text, i is not None and any(j < i for j in same))
        for order in permutations("ABCDE"):
            order, gone = "".join(order), False
            for step, name in enumerate(order, 1):
                def add(what, yes):
                    out[lang or "", order, step, what] += bool(yes)
                removed = name in fails and not gone
                add("kept", name not in fails and not gone)
                add("removed", removed)
                add("redundant", name in fails and gone)
                add("unique_fails", fails == {name})
                add("good_lost", removed and i in quality)
                add("toxic_lost", removed and i in toxic)
                out[lang or "", "shapley", name, ""] += removed
                gone = gone or name in fails
    return out


def _check(spark, rows, df, labels, quality, toxic):
    want = _simulate(rows, quality, toxic)
    got = filter_audit.interaction_audit(filter_audit.document_masks(df, labels)).collect()
    assert len(got) == 600 * len({r[2] or "" for r in rows})
    for r in got:
        for what in filter_audit.COUNTS:
            assert r[what] == want[r["part"], r["filter_order"], r["step"], what], (r, what)
        assert r["shapley"] == want[r["part"], "shapley", r["filter_order"][r["step"] - 1], ""]


def test_audit_equals_a_simulation(spark):
    rows, df = _docs(spark, TEXTS)
    labels = spark.createDataFrame([(4, 1, 0, 5), (4, 0, 1, 5), (6, 1, None, 5), (7, None, 1, 5), (None, 1, 1, 5), (99, 1, 1, 5), (8, 2, 2, 5)],
                                   "doc_id long, quality int, toxic int, good int")
    _check(spark, rows, df, labels, {4, 6}, {4, 7})


def test_null_and_repeated_ids(spark):
    rows = [(None, "same"), (3, "same"), (3, "same"), (4, "same"), (None, "same"), (5, None), (6, "")]
    rows = [(i, t, "en", "m", 3, {"a": 1}, 7, 8, 9) for i, t in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(3, 1, 1)], "doc_id long, quality long, toxic long")
    _check(spark, rows, df, labels, {3}, {3})
    assert filter_audit.interaction_audit(filter_audit.document_masks(df.limit(0), labels.limit(0))).count() == 0


def test_fields_do_not_overflow():
    big = (1 << 62) + 12345
    total = big * filter_audit.packed(0b00011, True, False) + big * filter_audit.packed(0, False, True)
    fields = filter_audit.unpack(total)
    assert fields.shape == (120, 5, 6)
    first = filter_audit.orders().index("ABCDE")
    assert fields[first, 0].tolist() == [big, big, 0, 0, big, 0] and fields[first, 1].tolist() == [big, 0, big, 0, 0, 0]

"""Small fixtures for every operator: brute force, round trips, edge cases."""

import hashlib
import math
import random
import re
import zlib
from array import array

import numpy as np
import pytest

from tabsight.llm import (bpe_counts, compact_windows, graph_ann, language_id, minhash_dedup, mixing, pii, piece_codec,
                          rans_store, topk_mtree)
from tabsight.llm.common import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size string, n string, u string"
ODD = [None, "", " ", "one", "two words", "x" * 30000, "1 2 3 4 5 6 7", "ΑΣ Σ İ é ́x", "<|endoftext|>a<|ENDOFTEXT|>",
       "a  b\t\nc ", "▁a▁▁ b", "😀 a\x00b"]


def _doc(rng, n=60):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def _docs(spark, texts, first=0):
    rows = [(first + i, t, ("en", "fr", None)[i % 3], (f"s{i % 4}", None)[i % 9 == 8], len(t or ""), 7, "x", "y", "z")
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [_doc(rng, rng.randint(30, 120)) for _ in range(40)]
    out = list(base)
    for t in base[:12]:  # copies, near copies, heavily edited copies
        words = t.split()
        out.append(t)
        out.append(" ".join(words[:-1] + ["edited"]))
        for k in range(0, len(words), 9):
            words[k] = "other" + str(rng.randint(0, 99))
        out.append(" ".join(words))
    return out + ODD + ["two words", "Two words"]


def _embeddings(spark, n=300, d=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[100:180] = x[100]  # a common vector
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    bad = [(n, None, 1), (n + 1, [float("nan")] + [0.0] * (d - 1), 1), (n + 2, [None] + [1.0] * (d - 1), 1),
           (None, rows[0][1], 1), (n + 3, [], 1), (n + 4, [1.0], 1), rows[5]]
    return x, spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, score int")


def test_top_k_equals_brute_force(spark):
    x, df = _embeddings(spark)
    v = np.floor(256 * x).astype(np.int64)
    want = set()
    for q in range(0, len(x), 50):
        s = v @ v[q]
        best = sorted((-int(s[i]), i) for i in range(len(x)) if i != q)[:5]
        want |= {(q, r + 1, i, -a) for r, (a, i) in enumerate(best)}
    for shard_rows in (10_000, 40):
        assert {tuple(r) for r in topk_mtree.top_k(df, shard_rows=shard_rows).collect()} == want
    assert topk_mtree.top_k(df.limit(0)).count() == 0


def test_graph_recall_and_exact_scores(spark):
    x, df = _embeddings(spark, 600, 12, 1)
    got = {}
    for r in graph_ann.nearest(df, shard_rows=200).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in range(0, len(x), 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = sorted((d[i], i) for i in range(len(x)) if i != q)[:10]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(math.isclose(m[2], d[m[1]], rel_tol=1e-12, abs_tol=1e-12) for m in mine)
        hits += len({m[1] for m in mine} & {i for _, i in best})
        total += 10
    assert hits / total >= 0.9
    assert graph_ann.nearest(df.limit(0)).count() == 0


def test_language_id_learns_and_rejects(spark):
    rng = random.Random(1)
    words = {"en": "the and of house water with".split(), "fr": "le été ça maison eau avec".split()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(20)), k) for i in range(200) for k in ("en", "fr")]
    rows = [(n, t, k) for n, (_, t, k) in enumerate(rows)] + [(None, "the house", "en"), (900, None, "en"), (901, "12 %", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    out = language_id.predict(df, model).select("doc_id", "lang", language_id.held_out().alias("h"), "language.*").collect()
    for r in out:
        if r["doc_id"] is not None and r["doc_id"] < 900:
            assert r["lang_pred"] == r["lang"] and 0.5 < r["score"] <= 1
            assert r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        elif r["doc_id"] in (900, 901):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    none = language_id.fit(df.limit(0))
    assert language_id.predict(df, none).select("language.lang_pred").distinct().collect()[0][0] == "und"


def test_temperature_and_bounds():
    y = np.array([0, 1] * 50)
    scores = np.where(np.arange(2) == y[:, None], 5.0, 0.0)
    scores[:20] = scores[:20, ::-1]
    assert language_id.fit_temperature(scores, y) > 2


def test_rans_store_round_trip(spark, texts, tmp_path):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(tokenizer_path(rans_store.MODEL))
    df = _docs(spark, texts, 1 << 60).union(_docs(spark, ["no id"]).selectExpr("CAST(NULL AS long)", *SCHEMA_REST))
    want, at = {}, 0
    order = [(None, "no id")] + [((1 << 60) + i, t) for i, t in enumerate(texts)]
    for i, t in order:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want[i] = (at, len(ids), array("I", ids).tobytes())
        at += len(ids)
    folder = rans_store.write_store(df, str(tmp_path / "store"), bucket_rows=10)
    got = {r["id"]: (r["start"], r["n_tokens"], bytes(r["ids"])) for r in rans_store.read_store(spark, folder).collect()}
    assert got == want
    empty = rans_store.write_store(df.limit(0), str(tmp_path / "none"))
    assert rans_store.read_store(spark, empty).count() == 0


SCHEMA_REST = [c.split()[0] for c in SCHEMA.split(", ")][1:]


def test_rans_checkpoints():
    rng = np.random.default_rng(0)
    blocks = [rng.zipf(1.3, n) % 3000 for n in (40000, 5, 0, 16384)]
    symbols, counts = np.unique(np.concatenate(blocks), return_counts=True)
    coder = rans_store.RansCoder(symbols, rans_store.shares(symbols, counts))
    payloads = coder.encode(blocks)
    assert all((a == b).all() for a, b in zip(coder.decode(payloads), blocks))
    assert (coder.decode(payloads[:1], [256])[0] == blocks[0][256 * rans_store.LANES:]).all()


def test_token_counts_and_pieces_equal_the_libraries(spark, texts):
    import sentencepiece
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(tokenizer_path(bpe_counts.MODEL))
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(piece_codec.MODEL))
    df = _docs(spark, texts)
    for r in bpe_counts.count_tokens(df, limit=100).collect():
        t = texts[r["doc_id"]] or ""
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 100)
    for r in piece_codec.encode_documents(df).select("doc_id", "pieces.*").collect():
        ids = sp.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert array("I", bytes(r["ids"])).tolist() == ids and r["decoded"] == sp.decode(ids)
    for op in (bpe_counts.count_tokens, piece_codec.encode_documents):
        assert op(df.limit(0)).count() == 0


def _sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def test_near_duplicates_equal_brute_force(spark, texts):
    sets = _sets(texts)
    root = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    df = _docs(spark, texts)
    got = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(df.union(df.limit(3))).collect()}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {
        i: (len(sets[i]), root[i], root[i] == i) for i in range(len(texts))}
    assert sum(r["n_rows"] for r in got.values()) == len(texts) + 3
    assert minhash_dedup.near_duplicates(df.limit(0)).count() == 0
    lone = minhash_dedup.near_duplicates(_docs(spark, ["a b"]).selectExpr("CAST(NULL AS long) doc_id", "text")).first()
    assert lone["component_id"] is None and lone["kept"]


def test_mix_targets_and_tree(spark, texts):
    sizes = [1000, 100, 5000, 0, 700]
    t = mixing.targets(sizes)
    assert math.isclose(sum(t), 1.5 * sum(sizes)) and all(x <= 2 * s + 1e-6 for x, s in zip(t, sizes))
    dealt = mixing.split_quotas(np.array([7, 0, 100, 3]), 8, 1)
    assert dealt.sum(axis=0).tolist() == [7, 0, 100, 3] and np.ptp(dealt.sum(axis=1)) <= 2
    df = _docs(spark, texts)
    rows = mixing.mix_report(df).collect()
    assert len(rows) == len(texts) and rows == mixing.mix_report(df).collect()
    by = {}
    for r in rows:
        assert r["taken"] <= 2 * r["size"] and r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or ""))
        e = by.setdefault((r["target"], r["source_size"]), [0, 0])
        e[0] += r["taken"]
    assert all(abs(taken - target) <= 0.1 * target + 5 for (target, _), (taken, _) in by.items())
    mixed = mixing.mix_documents(df)
    assert set(df.columns) < set(mixed.columns)
    assert sum(r["taken"] for r in rows) == sum(
        len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in mixed.select("text").collect())
    assert mixing.mix_report(df.limit(0)).count() == 0


PII = ["mail a.b+c@x-y.org. or a@b@c.d", "ip 1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 00255.0.0.1", "4111 1111 1111 1111 and 4111-1111-1111-1112",
       "+1 (743) 555-3824 x +12 3 +1234567890123456", "a" * 5000 + "@", "1" * 5000, "a@b" + ".c" * 3000, None, "",
       "é😀 q@r.st +49 30 1234567", "x@y.z%d@e.f"]


def test_base_spans_equal_plain_patterns(spark):
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}",
             "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}

    def ok(kind, m):
        d = re.sub(r"\D", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            s = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
            return 13 <= len(d) <= 19 and s % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    df = _docs(spark, PII)
    for r in pii.span_report(df).collect():
        t = PII[r["doc_id"]] or ""
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in rules.items() for m in re.finditer(p, t) if ok(k, m.group())]
        assert r["spans"] == ",".join(spans)
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
    assert pii.span_report(df.limit(0)).count() == 0


def test_revealing_terms_are_removed(spark):
    rng = random.Random(2)
    texts = [_doc(rng, 30) for _ in range(60)] + [f"{_doc(rng, 5)} Zebulon writes from zeb@mail.org today" for _ in range(4)]
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(_docs(spark, texts)).collect()}
    assert all(out[i] == texts[i] for i in range(60))
    assert all("Zebulon" not in out[i] and "[EMAIL]" in out[i] for i in range(60, 64))


def test_revealing_terms_anywhere_in_the_document(spark):
    rng = random.Random(4)

    def rest(n):  # words too long to be in three texts by accident
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))

    far = [f"Zebulon {rest(120)} zeb@mail.org {rest(120)} Zebulon {rest(9)} zebulon, {rest(5)}"
           for _ in range(4)]  # the nearest is some 500 characters away
    texts = [_doc(rng, 30) for _ in range(60)] + far
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(_docs(spark, texts)).collect()}
    report = {r["doc_id"]: r["all_spans"] for r in pii.span_report(_docs(spark, texts)).collect()}
    for i in range(60):
        assert out[i] == texts[i]
    for i in range(60, 64):
        assert out[i] == texts[i].replace("Zebulon", "").replace("zebulon", "").replace("zeb@mail.org", "[EMAIL]")
        names = [(s["start"], s["end"]) for s in report[i] if s["kind"] == "reveal"]
        assert names == [m.span() for m in re.finditer("zebulon", texts[i], re.I)] and names[0][1] + 400 < texts[i].index("@")


def test_revealing_terms_at_the_ends(spark):
    rng = random.Random(6)
    ends = [f"Zebulon {_doc(rng, 3)} mail zeb@mail.org" for _ in range(4)] + ["mail zeb@mail.org Zebulon" for _ in range(4)]
    rim = [f"{_doc(rng, 9)} Marigold {'x' * 50} mari@mail.org" for _ in range(4)]  # a word that begins 60 before
    texts = [_doc(rng, 30) for _ in range(80)] + ends + rim
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(_docs(spark, texts)).collect()}
    assert all(out[i] == texts[i] for i in range(80))
    assert all("Zebulon" not in out[i] for i in range(80, 88)) and all("Marigold" not in out[i] for i in range(88, 92))


def test_revealing_terms_short_with_digits_and_rare(spark):
    rng = random.Random(8)
    texts = [_doc(rng, 30) for _ in range(80)]
    texts += [f"Ng {_doc(rng, 9)} ng@mail.org {_doc(rng, 9)} 李明 k77x" for _ in range(4)]
    texts += [_doc(rng, 4) for _ in range(20_000)]
    pair = [f"{_doc(rng, 2)} Quux {_doc(rng, 2)} two@mail.org" for _ in range(2)]  # an entity of two documents
    once = [f"{_doc(rng, 2)} Solo one@mail.org"]
    copies = ["Twin Copy twin@mail.org"] * 2  # one text, so no evidence
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(_docs(spark, texts + pair + once + copies)).collect()}
    assert all(out[i] == texts[i] for i in [*range(80), *range(84, 20_084)])
    assert all(not {"Ng", "李明", "k77x"} & set(out[i].split()) for i in range(80, 84))
    assert all("Quux" not in out[i] and "[EMAIL]" in out[i] for i in (20_084, 20_085))
    assert "Solo" in out[20_086] and out[20_087] == out[20_088] == "Twin Copy [EMAIL]"


def test_compact_windows_cover_once():
    s = np.random.default_rng(0).integers(0, 1 << 62, 150).astype(np.uint64)
    found = compact_windows.windows(s, 1, 46)
    for i in range(0, 105, 13):
        for j in range(i + 45, 150, 11):
            assert sum(lo <= i <= c <= j <= hi for lo, c, hi in found) == 1
    assert len(compact_windows.windows(np.zeros(3000, np.uint64), 1, 46)) < 3000


def test_repeated_passages(spark):
    rng = random.Random(3)
    shared = _doc(rng, 60)
    edited = shared.split()
    edited[30] = "changed"
    texts = [f"{_doc(rng, 40)} {shared} {_doc(rng, 25)}", f"{_doc(rng, 10)} {shared}", f"{_doc(rng, 15)} {' '.join(edited)} {_doc(rng, 9)}",
             _doc(rng, 200), shared.split(" ", 20)[-1], " ".join(shared.split()[:30]) + " " + _doc(rng, 50), *ODD]
    df = _docs(spark, texts)
    got = {r["doc_id"]: r for r in compact_windows.repeated_passages(df).collect()}
    assert len(got) == len(texts)
    assert [got[i]["class_id"] for i in (0, 1, 2)] == [0, 0, 0]
    assert [tuple(p) for p in got[0]["passages"]] == [(40, 100)] and [tuple(p) for p in got[1]["passages"]] == [(10, 70)]
    assert got[3]["n_passages"] == 0 and got[4]["n_passages"] == 0 and got[5]["n_passages"] == 0
    assert compact_windows.repeated_passages(df.limit(0)).count() == 0


def test_pipeline_stages(spark, texts):
    import corpus_pipeline
    rng = random.Random(9)
    rows = [(i, t or "", ("en", "fr")[i % 2], f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, lang string, source string, n_chars long")
    names = docs.columns
    one = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    kept = [r["doc_id"] for r in one.collect()]
    assert one.columns == names and len(kept) == len(set(kept))
    private = corpus_pipeline.remove_personal_data(spark, docs, "")
    assert private.columns == names and private.count() == docs.count()
    assert corpus_pipeline.mix_sources(spark, docs, "").columns == names
    assert corpus_pipeline.identify_language(spark, docs, "").columns == names
    assert corpus_pipeline.encode_pieces(spark, docs.limit(0), "").count() == 0
    assert rng and len(corpus_pipeline.STAGES) == 5


def test_repeated_passages_through_a_third(spark):
    """Slices of one sequence: classes are those of shared runs of 50 words."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(40):
        a, n = int(rng.integers(0, 330)), int(rng.integers(20, 75))
        rows.append((i, " ".join([f"a{i}x{k}" for k in range(60)] + base[a:a + n] + [f"b{i}x{k}" for k in range(60)])))
    runs = [{tuple(t.split()[k:k + 50]) for k in range(len(t.split()) - 49)} for _, t in rows]
    root = list(range(40))
    for _ in range(40):
        for i in range(40):
            for j in range(40):
                if runs[i] & runs[j]:
                    root[i] = root[j] = min(root[i], root[j])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in compact_windows.repeated_passages(df).collect()}
    assert got == dict(enumerate(root))

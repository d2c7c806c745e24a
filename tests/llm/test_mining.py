"""Collocations, hard negatives and quality scores against brute force, and their odd rows."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from raresight.llm import collocations, hard_negatives, quality
from raresight.llm.queries import COLLOCATIONS_SQL, NEGATIVES_SQL, op11_collocations, op12_hard_negatives, op13_quality
from tests.compare import differences, oracle_connection

INF, NAN = float("inf"), float("nan")


def plain_collocations(rows, least, longest, top):
    """The definition, word for word."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    found = {x: c for x, c in f.items() if c >= least}
    out = set()
    for lang in n:
        scored = []
        for (where, p), a in found.items():
            if where != lang or len(p) < 2:
                continue
            if any(w == lang and len(q) > len(p) and c >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (w, q), c in found.items()):
                continue
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return out


def prose(n, seed=3):
    rng = random.Random(seed)
    words = ["the", "The", "of", "gnu", "general", "public", "é", "ü", "x", "中", *[f"w{i}" for i in range(30)]]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n"]) for _ in range(rng.randint(0, 60)))
        if i % 3 == 0:
            text += " the gnu general public x y z the gnu general public x"
        rows.append((rng.choice(["en", "fr", None]) if i % 2 else "en", text))
    return rows + [("fr", None), (None, ""), ("en", rows[0][1]), ("de", "a a a a a a a a a a a a")]


@pytest.mark.parametrize("least, shards, top", [(20, 4, 2000), (7, 2, 15), (1, 1, 50)])
def test_collocations(spark, docs_of, least, shards, top, monkeypatch):
    monkeypatch.setattr(collocations, "CELL_BITS", 18)
    rows = prose(160 if least > 1 else 25)
    docs = docs_of([(i, t, lang, "s") for i, (lang, t) in enumerate(rows)]).withColumnsRenamed({"size": "n", "target": "phrase", "copies": "shard", "fp": "a"})
    got = [tuple(r) for r in collocations.collocations(docs, least=least, shards=shards, top=top).collect()]
    assert set(got) == plain_collocations(rows, least, 5, top) and len(got) == len(set(got))


def test_collocations_shared_cells(spark, docs_of, monkeypatch):
    # few cells: phrases start early because others share theirs, and are counted for one full cycle all the same
    monkeypatch.setattr(collocations, "CELL_BITS", 6)
    rows = prose(60)
    got = collocations.collocations(docs_of([(i, t, lang, "s") for i, (lang, t) in enumerate(rows)]), least=9, shards=3).collect()
    assert {tuple(r) for r in got} == plain_collocations(rows, 9, 5, 2000)


@pytest.mark.parametrize("n, keys", [(1, 1), (1000, 30), (70_000, 2**40)])
def test_counts_travel_in_blocks(n, keys, monkeypatch):
    monkeypatch.setattr(collocations, "OUT", 1 << 10)
    rng = np.random.default_rng(n)
    a = rng.integers(0, keys, n).astype(np.uint64) * collocations.TURN
    b, count = rng.integers(0, 3, n).astype(np.uint32), rng.integers(1, 9, n)
    want = Counter()
    for x, y, z in zip(a.tolist(), b.tolist(), count.tolist()):
        want[x, y] += z
    whole = collocations.tallied([(a[:7], b[:7], count[:7]), (a[7:], b[7:], count[7:])])
    # keys that share their first hash alone are told apart, whatever their order, and equal ones are put together
    assert list(zip(*(x.tolist() for x in whole[:2]))) == sorted(want)
    for bits in (4, 9):
        rows = [x for batch in collocations.blocks_of(*whole, bits) for x in collocations.keys_in(batch)]
        assert len({part for part, _ in rows}) == len(rows)
        assert all((x >> np.uint64(64 - bits) == np.uint64(part)).all() for part, (x, _, _) in rows)
        assert {(x, y): z for _, block in rows for x, y, z in zip(*(c.tolist() for c in block))} == want


def test_collocations_of_one_document_each(spark, docs_of, monkeypatch):
    # all mentions of a phrase lie in one shard, the one that is named by a part of them too
    monkeypatch.setattr(collocations, "CELL_BITS", 18)
    rows = [("en", f"w{i} " * 300) for i in range(24)]
    got = collocations.collocations(docs_of([(i, t, lang, "s") for i, (lang, t) in enumerate(rows)])).collect()
    assert {tuple(r) for r in got} == plain_collocations(rows, 100, 5, 2000) and len(got) == 24 * 4


def test_collocations_of_odd_rows(spark, docs_of):
    # odd characters, languages and empty texts, with words that one document repeats
    rng = random.Random(2)
    words = ["the", "The", "\u00a0", "\u0085", "\u2028", "\x00", "\x1c", "\x7f", "\u0130", "\u212a", "\ufeff", "\U0001f600", "\uffff", "\\", "%", "'", "@", "[", *[f"w{i}" for i in range(8)]]
    gaps = [" ", " ", "\t", "  ", ", ", ".", "\n", "\x0b", "\x0d", " ; "]
    rows = [(rng.choice(["en", None, "", "und", "EN", "e\x00n"]), "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 80))) + " p q r s t u") for _ in range(600)]
    rows += [(rng.choice(["de", "en"]), f"rep{i} " * rng.randint(90, 700)) for i in range(20)] + [("en", None), (None, None), ("zz", ""), ("zz", " . ")]
    docs = docs_of([(i, t, lang, "s") for i, (lang, t) in enumerate(rows)]).repartition(7)
    got = [tuple(r) for r in collocations.collocations(docs).collect()]
    want = plain_collocations(rows, 100, 5, 2000)
    assert set(got) == want and len(got) == len(want) > 50
    con = duckdb.connect()
    con.execute("create table documents (lang varchar, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert set(con.execute(COLLOCATIONS_SQL).fetchall()) == want


def test_collocations_of_regular_words(spark, docs_of, monkeypatch):
    # Thue-Morse words and their complements: polynomials in any odd number, modulo 2^64, take one for the other
    monkeypatch.setattr(collocations, "CELL_BITS", 18)
    made = "a"
    while len(made) < 1024:
        made += made.translate({97: 98, 98: 97})
    odd = [made, made.translate({97: 98, 98: 97}), *("q" * i + end for i in (7, 8, 15, 16, 63, 64, 65) for end in ("", "\x00", "\x00\x00", "r"))]
    rng = random.Random(6)
    rows = [(rng.choice(["en", "fr"]), " ".join(["x", rng.choice(odd[:2]), "y", *rng.choices(odd, k=40)])) for _ in range(200)]
    got = [tuple(r) for r in collocations.collocations(docs_of([(i, t, lang, "s") for i, (lang, t) in enumerate(rows)]), least=9).collect()]
    want = plain_collocations(rows, 9, 5, 2000)
    assert set(got) == want and len(got) == len(want) > 50


def test_words_are_told_apart():
    rng = np.random.default_rng(4)
    some = {rng.integers(97, 99, n).astype(np.uint8).tobytes() for n in rng.integers(1, 140, 5000)} | {b"a" + bytes(i) for i in range(100)}
    some = sorted(some)
    data = np.frombuffer(b" ".join(some + some[::-1]), np.uint8)
    words = collocations.Words(data)
    for hashes in (words.a, words.b(np.arange(len(words.a)))):
        assert len(np.unique(hashes)) == len(some) and np.array_equal(hashes, hashes[::-1])
    assert np.array_equal(collocations.Words(data).b(np.arange(0, 900, 30)), hashes[:900:30])


def test_collocations_odd_tables(spark, docs_of, monkeypatch):
    monkeypatch.setattr(collocations, "CELL_BITS", 18)
    assert collocations.collocations(docs_of([]).limit(0)).count() == 0
    assert collocations.collocations(docs_of([(1, None, None, None), (None, "", "en", "s")])).count() == 0
    long = docs_of([(1, "ab cd " * 200_000, "en", "s"), (2, "x" * 3_000_000, "en", "s")])
    got = collocations.collocations(long).collect()
    assert {(r["phrase"], r["a"], r["n"]) for r in got} == {(p, 200_000 - i, 400_001) for p, i in (("ab cd", 0), ("ab cd ab cd", 1), ("ab cd ab cd ab", 2), ("cd ab cd ab cd", 2))}


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], "vec_id long, embedding array<float>, label int, score string, bits int")


def labelled(n=330, dims=13, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims)).astype("f4")
    x[60:120] = x[7]
    rows = [(i, v.tolist(), int(rng.integers(0, 4))) for i, v in enumerate(x)]
    odd = [(1000, None, 1), (1001, [1.0, None], 1), (1050, [NAN], 2), (1100, [INF, 1.0], 2), (1150, [1.0] * 13, None), (None, [1.0], 1), (1200, [0.5], 1), (1250, [], 2), (1300, [0.25] * 20, 3)]
    return rows + odd + [(5, [9.0] * 13, rows[5][2] + 1), (400, [-300.5, 80.25], 2)]


def plain_negatives(rows, is_anchor):
    one = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v):
            one[i] = min(one.get(i, (label, v)), (label, v))
    whole = {i: (label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, (label, v) in one.items()}
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = set()
    for q in filter(is_anchor, whole):
        scored = sorted((-dot(whole[q][1], w), i, label == whole[q][0]) for i, (label, w) in whole.items() if i != q)
        for p, pid, _ in [x for x in scored if x[2]][:5]:
            near = [x for x in scored if not x[2] and 50 * -p <= 100 * -x[0] <= 95 * -p][:3]
            out |= {(q, pid, rank, i, -p, -s) for rank, (s, i, _) in enumerate(near, 1)}
    return out


@pytest.mark.parametrize("a_block, c_block", [(1024, 4096), (2, 41)])
def test_hard_negatives(spark, a_block, c_block):
    want = plain_negatives(labelled(), lambda i: i % 50 == 0)
    got = hard_negatives.mine(frame(spark, labelled()), lambda c: c % 50 == 0, anchor_block=a_block, candidate_block=c_block).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 50


def test_bit_planes_give_exact_scores():
    rng = np.random.default_rng(5)
    for bits, dims in ((1, 3), (9, 64), (33, 17), (64, 9)):
        w = rng.integers(-(2 ** (bits - 1)), 2 ** (bits - 1) - 1, (40, dims), endpoint=True)
        planes = hard_negatives.pack_planes(w, bits)
        rows = {"id": list(range(40)), "label": [0] * 40, "bits": [bits] * 40, "planes": [x.tobytes() for x in planes]}
        anchors = np.zeros((7, planes.shape[1] * 8), np.int64)
        anchors[:, :dims] = rng.integers(-500, 500, (7, dims))
        table = hard_negatives.pa.table({k: hard_negatives.pa.array(v, {"bits": hard_negatives.pa.int32()}.get(k)) for k, v in rows.items()})
        got = hard_negatives.Candidates(table).scores(anchors)
        exact = w.astype(object) @ anchors[:, :dims].T.astype(object)
        assert (got == np.clip(exact, -(2**63), 2**63 - 1)).all()
        assert hard_negatives._bits(w).max() <= bits


def test_hard_negatives_odd_tables(spark):
    none = frame(spark, labelled()).limit(0)
    assert hard_negatives.mine(none, lambda c: c % 50 == 0).count() == 0
    huge = [(0, [3e38, 1.0], 1), (1, [3e38, 2.0], 1), (2, [1.0, 0.0], 2), (3, [-3e38, 0.0], 2), (50, [0.0, 0.0], 1), (51, [1.0, 1.0], 3)]
    got = {tuple(r) for r in hard_negatives.mine(frame(spark, huge), lambda c: c % 50 == 0).collect()}
    # scores past 64 bits are held at its limits; a zero anchor scores zero everywhere
    assert {r[:4] for r in got if r[0] == 50} == {(50, 0, 1, 2), (50, 0, 2, 3), (50, 0, 3, 51), (50, 1, 1, 2), (50, 1, 2, 3), (50, 1, 3, 51)}


@pytest.mark.parametrize("key, fn, sql", [("op11", op11_collocations, COLLOCATIONS_SQL), ("op12", op12_hard_negatives, NEGATIVES_SQL)])
def test_mining_queries_match_sql(key, fn, sql, spark):
    for sf in ("/root/testdata/sf0.001",) if key == "op11" else ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert differences(fn(spark, sf).toPandas(), oracle_connection(sf).execute(sql).df()) == ""


def plain_features(text):
    """Words, their n-grams with the blanks around them, and repeats, as strings."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [g for w in words for n in (3, 4, 5) for i in range(len(w) + 3 - n) for g in [f" {w} "[i : i + n]]]
    return len(words), len(grams), sum(a == b for a, b in zip(words, words[1:]))


def test_quality_features(monkeypatch):
    texts = ["a bb ccc\tdddd  eeeee", "", "é é é x", " one ", "w" * 30, "中文 中文", None, "tail tail"]
    monkeypatch.setattr(quality, "SLICE", 7)
    for t in texts:
        groups = [g for made in quality.features_of([t]) for g in [made.groups]]
        sizes = [sum(len(g[0][1]) for g in groups), sum(len(x[1]) for g in groups for x in g[2:]), sum(len(g[1][1]) for g in groups)]
        assert tuple(sizes) == plain_features(t or "")
    whole = lambda: [np.sort(np.concatenate([b for made in quality.features_of([t]) for _, b in made.groups] or [np.zeros(0, np.int64)])) for t in texts]
    cut = whole()
    monkeypatch.setattr(quality, "SLICE", 1 << 20)
    assert all(np.array_equal(a, b) for a, b in zip(cut, whole()))
    owners = [set(o.tolist()) for made in quality.features_of(texts) for o, _ in made.groups[:1]]
    assert owners == [{0, 2, 3, 4, 5, 7}]


def test_quality_gradient_and_scores():
    rng = np.random.default_rng(1)
    rows = [(rng.choice(500, 20, replace=False), np.full(20, 0.05, np.float32)) for _ in range(60)]
    y = np.array([int(b.min() < 20) for b, _ in rows])
    model = quality.train(rows, y, epochs=60)
    mean = lambda m, r: r[1] @ m.vectors[r[0]] @ m.output + m.bias
    assert all((mean(model, r).argmax() == t) for r, t in zip(rows, y))
    text = "some words words here"
    found = np.concatenate([b for made in quality.features_of([text]) for _, b in made.groups])
    margin = model.vectors[found].mean(axis=0) @ model.output + model.bias
    p = np.exp(margin[1]) / np.exp(margin).sum()
    assert model.scorer().score([text])[0] == pytest.approx(p, rel=1e-4)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = op13_quality(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().groupby("doc_id").quality.min()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and got.score.between(0, 1).all()
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()
    held = got[got.held_out].set_index("doc_id").join(labels, how="inner")
    assert (held.predicted == held.quality).mean() >= 0.97 and set(held.quality) == {0, 1}
    again = op13_quality(spark, sf).toPandas()
    assert got.sort_values("doc_id").score.tolist() == again.sort_values("doc_id").score.tolist()


def test_quality_odd_tables(spark, docs_of):
    docs = docs_of([(1, None, None, None), (2, "", "en", "s"), (None, "text", "en", "s"), (3, "x" * 3_000_000, "en", "s"), (4, "good words", "en", "s"), (4, "other words", "en", "s")])
    kind = "doc_id long, quality int, text string, good string"
    for rows, want in (([], 0.5), ([(4, 1, "a", "b"), (4, None, "a", "b"), (None, 0, "a", "b")], 1 - 1e-6)):
        model = quality.fit(docs, spark.createDataFrame(rows, kind))
        got = docs.select(quality.score(spark, model, quality.F.col("text")).alias("p")).collect()
        assert len(got) == 6 and all(r["p"] == pytest.approx(want) for r in got)
    model = quality.fit(docs, spark.createDataFrame([(4, 1, "", ""), (3, 0, "", ""), (1, 0, "", "")], kind))
    got = [r["p"] for r in docs.limit(0).select(quality.score(spark, model, quality.F.col("text")).alias("p")).collect()]
    assert got == []

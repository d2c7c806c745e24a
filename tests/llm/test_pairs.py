"""Line dedup and SimHash against brute force, and their odd rows."""

import random
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import xxhash

from raresight.llm import line_dedup, simhash
from raresight.llm.graph import components


def near_lines(rows):
    """(doc_id, line numbers that go), by comparing every two lines."""
    lines = sorted((-(2**63) if i is None else i, zlib.crc32((t or "").encode()), n, frozenset(x.encode().split()), k) for k, (i, t) in enumerate(rows) for n, x in enumerate((t or "").split("\n")))
    gone = defaultdict(set)
    for at, (i, crc, n, s, k) in enumerate(lines):
        for i2, crc2, n2, s2, _ in lines[:at]:
            if s and s2 and (i2, crc2, n2) != (i, crc, n) and 5 * len(s & s2) >= 4 * len(s | s2):
                gone[k].add(n)
                break
    return ["\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[k]) if t is not None else None for k, (_, t) in enumerate(rows)]


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 14))) for _ in range(25)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 6)):
            x = rng.choice(base).split()
            for _ in range(rng.randint(0, 2)):
                x[rng.randrange(len(x))] = rng.choice(words)
            lines.append(" ".join(x))
        rows.append((rng.choice([i, i, i, 3, None]), "\n".join(lines) if rng.random() > 0.05 else None))
    return rows + rows[:3]


@pytest.mark.parametrize("lags", [512, 1])
def test_lines_match_brute_force(docs_of, monkeypatch, lags):
    monkeypatch.setattr(line_dedup, "LAGS", lags)
    monkeypatch.setattr(line_dedup, "LIST_BLOCK", 5)
    rows = corpus(lags, 120)
    out = line_dedup.dedup(docs_of([(i, t, None, None) for i, t in rows])).collect()
    want = near_lines(rows)
    as_key = lambda x: sorted(map(repr, x))
    assert as_key((r["doc_id"], r["text"]) for r in out) == as_key((i, t) for (i, _), t in zip(rows, want))


def test_lines_by_text_keys(docs_of):
    rows = corpus(9, 60)
    named = lambda i: None if i is None else f"doc {i:05d}"
    docs = docs_of([(i, t, None, None) for i, t in rows]).selectExpr("'doc ' || lpad(doc_id, 5, '0') as doc_id", "text", "`a.b`", "key")
    out = line_dedup.dedup(docs).collect()
    want = near_lines(rows)
    assert sorted(repr((r["doc_id"], r["text"])) for r in out) == sorted(repr((named(i), t)) for (i, _), t in zip(rows, want))
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_picked_lines_are_those_of_all():
    rng = random.Random(4)
    for _ in range(300):
        texts = ["".join(rng.choices("ab \n\t\x0b\x08\x0e", k=rng.randint(0, 14))).encode() for _ in range(rng.randint(1, 6))]
        offsets = line_dedup.np.cumsum([0] + [len(x) for x in texts])
        data = line_dedup.np.frombuffer(b"".join(texts), line_dedup.np.uint8)
        pick = lambda doc, line: (doc + line) % 3 != 0
        every = line_dedup.Lines(line_dedup.np.arange(len(texts)), offsets, data)
        some = line_dedup.Lines(line_dedup.np.arange(len(texts)), offsets, data, pick)
        assert every.size.tolist() == [len(x.split()) for t in texts for x in t.split(b"\n")]
        keep = pick(every.doc, every.line)
        assert some.size.tolist() == every.size[keep].tolist() and some.line.tolist() == every.line[keep].tolist()
        assert some.tokens.tolist() == every.tokens[keep[every.owner]].tolist()


def test_lines_odd_rows(docs_of):
    long = " ".join(f"t{i}" for i in range(50_000))
    rows = [(1, None), (2, ""), (3, "\n \n"), (4, long), (5, long + " x\nkept"), (6, "same words here now\nsame words here now"), (7, "kept")]
    docs = docs_of([(i, t, "en", "s") for i, t in rows])
    out = {r["doc_id"]: r for r in line_dedup.dedup(docs).collect()}
    assert [out[i]["text"] for i in range(1, 8)] == [None, "", "\n \n", long, "kept", "same words here now", ""]
    assert [out[i]["n_removed"] for i in range(1, 8)] == [0, 0, 0, 0, 1, 1, 1]
    assert [out[i]["emptied"] for i in range(1, 8)] == [False] * 6 + [True]
    assert out[1]["n_lines"] == 0 and out[5]["n_lines"] == 2 and out[5]["a.b"] == 1
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_list_over_memory_goes_to_the_second_round(docs_of, monkeypatch):
    monkeypatch.setattr(line_dedup, "LIST_HELD", 8)
    monkeypatch.setattr(line_dedup, "SLICE", 300)
    monkeypatch.setattr(line_dedup, "SEGMENT", 40)
    rows = [(i, f"a b c d e f g h i j{i} k{i % 7}") for i in range(60)]
    out = line_dedup.dedup(docs_of([(i, t, None, None) for i, t in rows])).collect()
    assert {r["doc_id"]: r["text"] for r in out} == {i: t for (i, _), t in zip(rows, near_lines(rows))}


def test_first_set_after_a_cut_list_goes_to_the_second_round(monkeypatch):
    monkeypatch.setattr(line_dedup, "LAGS", 2)
    monkeypatch.setattr(line_dedup, "LIST_HELD", 4)
    names = [x.split()[0] for x in line_dedup.POSTING.split(", ")]

    def postings(docs):
        # one list of sets of five tokens whose bits tell neighbours apart
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([7] * len(docs), docs, [0] * len(docs), [5 << 31] * len(docs), docs, [1 << d for d in docs], [0] * len(docs))], names)

    found = [r for b in line_dedup.search_lists([postings([0, 1, 2, 3, 4]), postings([5])]) for r in b.to_pylist()]
    assert {r["x_doc"] for r in found if r["kind"] == 2} == {0, 1, 2, 3, 4, 5}


def test_open_lists_are_dealt_in_bounded_cells(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LIST_BLOCK", 20)
    # one place a hundred times over, as identical rows have it
    rows = [(1, d, 0) for d in range(200)] + [(1, 500, 0)] * 100 + [(2, d, 0) for d in range(3)]
    every = line_dedup.cut(spark.createDataFrame(rows, "token long, doc long, line long"))
    probes = spark.createDataFrame([r for r in set(rows) if r[1] != 1], "token long, doc long, line long")
    sides = [t.collect() for t in line_dedup.open_cells(every, probes)]
    cells = [defaultdict(list), defaultdict(list)]
    for held, side in zip(cells, sides):
        for r in side:
            held[r["token"], r["mine"], r["block"]].append(r["doc"])
        assert max(map(len, held.values())) <= 60
    met = Counter((cell[0], p, c) for cell, mine in cells[0].items() for p in mine for c in cells[1][cell])
    copies = Counter((t, d) for t, d, _ in rows)
    want = {(t, d, e): copies[t, d] * copies[t, e] for t, d, _ in set(rows) if d != 1 for u, e, _ in set(rows) if t == u}
    assert met == want


def fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, distance):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= distance and find(a) != find(b):
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("distance", [0, 1, 3, 4])
def test_links_match_brute_force(spark, distance):
    rng = random.Random(distance)
    prints = [rng.getrandbits(64) for _ in range(12)] + [0, 2**64 - 1]
    for p in list(prints):
        for _ in range(12):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                p ^= 1 << b
            prints.append(p)
    prints = sorted(set(prints))
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    got = {r["fp"] % 2**64: r["root"] % 2**64 for r in simhash.link(spark.createDataFrame([(p,) for p in signed], "fp long"), distance).collect()}
    want = groups(prints, distance)
    assert len(got) == len(prints)
    pairs = lambda m: {frozenset(p for p in prints if m[p] == r) for r in set(m.values())}
    assert pairs(got) == pairs(want)


def test_simhash_odd_rows(docs_of):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one TWO"), (6, "É a b c d"), (7, "x " * 70_000), (None, "one two"), (4, "One two")]
    docs = docs_of([(i, t, "en", "s") for i, t in rows])
    out = simhash.near_duplicates(docs).select("doc_id", simhash.hex_print(simhash.F.col("fp")).alias("f"), "component").collect()
    assert len(out) == len(rows)
    want = {i: f"{fingerprint(t):016x}" for i, t in rows}
    assert all(r["f"] == want[r["doc_id"]] for r in out)
    assert {r["doc_id"]: r["component"] for r in out} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, None: 4}
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 6, 7]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 == simhash.keep_first(docs.limit(0)).count()


def test_groups_of_null_keys_stay_apart(docs_of):
    texts = [f"{a} {b} {c} {d}" for a, b, c, d in zip("abcdef", "ghijkl", "mnopqr", "stuvwx")]
    prints = [fingerprint(t) for t in texts]
    assert all((p ^ q).bit_count() > 4 for i, p in enumerate(prints) for q in prints[:i])
    rows = [(None, t) for t in texts] + [(None, texts[0].upper()), (1, texts[1]), (2, "other words are here"), (3, "other words are here")]
    kept = simhash.keep_first(docs_of([(i, t, "en", "s") for i, t in rows])).collect()
    assert sorted(r["text"].lower() for r in kept if r["doc_id"] is None) == sorted(texts)
    assert [r["doc_id"] for r in kept if r["doc_id"] is not None] == [2]


def joins_in(df):
    """Join lines of the plan before it runs: what Spark chooses by its estimates alone."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.split("\n") if "Join" in x]


@pytest.mark.parametrize("rows", [64, 1000])
def test_variants_are_never_broadcast(spark, monkeypatch, rows):
    """64 rows a fingerprint are taken for one: the estimate stays under any limit that the table itself does."""
    rng = random.Random(rows)
    prints = [rng.getrandbits(64) - 2**63 for _ in range(rows)]
    prints += [p ^ 1 << rng.randrange(60) for p in prints[:20]]
    seen, real = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges: [seen.append(joins_in(edges)), real(edges)][1])
    got = simhash.link(spark.createDataFrame([(p,) for p in prints], "fp long").distinct(), 4).collect()
    assert len({r["root"] for r in got}) == len(set(prints)) - 20
    assert len(seen) == 2 and all(seen)
    assert not [x for found in seen for x in found if "Broadcast" in x]


def test_tables_of_lines_are_never_broadcast(docs_of, monkeypatch):
    """Places and lists of lines are written in a small part of the room they need, so estimates say little."""
    monkeypatch.setattr(line_dedup, "LAGS", 1)
    rows, seen, real = corpus(1, 120), [], line_dedup.cut
    monkeypatch.setattr(line_dedup, "cut", lambda df: [seen.append(joins_in(df)), real(df)][1])
    out = line_dedup.dedup(docs_of([(i, t, None, None) for i, t in rows]))
    places = [x for found in [*seen, joins_in(out)] for x in found if "], [doc#" in x or "], [__doc#" in x]
    assert len(places) == 2 and not [x for x in places if "Broadcast" in x]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(repr, ((i, t) for (i, _), t in zip(rows, near_lines(rows)))))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (900, 901), (901, 900)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {900: 900, 901: 900}


def test_fingerprint_of_many_shingles():
    text = " ".join(str(i) for i in range(300))
    old, simhash.HASHES_AT_ONCE = simhash.HASHES_AT_ONCE, 7
    try:
        assert simhash.simhash(text, 4) % 2**64 == fingerprint(text)
    finally:
        simhash.HASHES_AT_ONCE = old



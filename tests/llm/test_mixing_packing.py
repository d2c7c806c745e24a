"""Mixing and packing: targets, sampling, exact round trips, odd rows."""

import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from raresight.llm import mixing, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
WEIGHTS = (5, 2, 1)


def water(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, clamped = sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in clamped]
        level = (total - sum(3 * sizes[s] for s in clamped)) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in clamped else weight[s] * level for s in sizes}
        clamped |= over


def test_mix(docs_of):
    rng = random.Random(4)
    text = lambda n: " ".join("w" * rng.randint(1, 9) for _ in range(n))
    rows = [(i, text(rng.randint(0, 40)), None, rng.choice(["a", "b", "B", "é", None, "big", "big", "big"])) for i in range(1500)]
    rows += [(9000, None, None, "empty"), (9001, "one", None, "tiny"), (5, rows[5][1], None, rows[5][3]), (None, "x y", None, "a")]
    docs = docs_of(rows)
    out = mixing.mix(docs).collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = water(sizes)
    taken = Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        assert 0 <= r["copies"] <= 3 and r["root"] is not None and r["a.b"] == 1
        taken[r["source"]] += r["copies"] * r["size"]
    assert len(out) == len(rows)
    assert all(abs(taken[s] - want[s]) <= 45 for s in sizes)
    again = {(r["doc_id"], r["copies"]) for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in out}
    assert mixing.repeat(mixing.mix(docs)).count() == sum(r["copies"] for r in out)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_many_sources_are_not_broadcast(docs_of):
    """The plan has a row per source and salt, whose file is small however many they are."""
    rows = [(i, "a b c " * (1 + i % 4), None, f"s{i % 4500}") for i in range(5000)] + [(-1, "a b", None, None), (-2, None, None, "none")]
    last = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x][0]
    mixed = mixing.mix(docs_of(rows))
    assert "Broadcast" not in last(mixed)
    assert "Broadcast" in last(mixing.mix(docs_of(rows[:100])))
    out, sizes = mixed.collect(), Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    want = water(sizes)
    assert len(out) == len(rows)
    assert all(r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-9) for r in out)
    assert all(r["copies"] >= int(r["target"] // r["source_size"]) for r in out if r["source_size"])


def test_null_keys_are_no_unit(docs_of):
    # a null-key third of the large source, and a fraction of it to be met
    rows = [(i if i % 3 else None, f"a b c d e f g h i {i}", None, "big") for i in range(300)] + [(1000 + i, "x y z " * 30, None, "small") for i in range(10)]
    docs = docs_of(rows)
    operator = mixing.mix(docs).where("source = 'big'").selectExpr('sum(copies * size)').first()[0]
    assert abs(operator - water({"big": 3000, "small": 900})["big"]) <= 10
    out = corpus_pipeline.mix_sources(None, docs, None).collect()
    taken = sum(len(r["text"].split()) for r in out if r["source"] == "big")
    assert abs(taken - water({"big": 3000, "small": 900})["big"]) <= 10
    copies = Counter(r["text"] for r in out if r["doc_id"] is None and r["source"] == "big")
    assert len({copies[t] for i, t, _, s in rows if i is None}) == 2


def check_packing(rows, out, capacity=4096):
    encoder = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in rows:
        ids = np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for p, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want[i, p, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_pack_round_trip(spark, docs_of, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    monkeypatch.setattr(packing, "CALL", 200)
    monkeypatch.setattr(packing, "BLOCK", 4)
    rng = random.Random(3)
    words = ["the", "Word,", "naïve", "été", "été", "日本語", "a\tb", "<|endoftext|>", "it's", "́x", "ǅ", "ΟΔΟΣ", "x\r\ny", "12 3", "🎉!"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "  \n\n "), (903, "long text " * 6000), (3, rows[3][1]), (None, "no id")]
    out = packing.pack(spark, docs_of([(i, t, None, None) for i, t in rows]), PATH).collect()
    n = check_packing(rows, out)
    assert n <= -(-sum(r["length"] for r in out) // 4096) + 1
    assert packing.pack(spark, docs_of([]), PATH).count() == 0


def test_recipes_use_every_piece_once():
    rng = random.Random(1)
    for case in range(40):
        capacity = rng.choice([1, 2, 7, 64, 500])
        counts = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(0, 40))}
        plan = packing.recipes(counts, capacity)
        used = Counter()
        for parts, n in plan:
            assert sum(parts) <= capacity and n > 0
            for p in parts:
                used[p] += n
        assert used == Counter(counts), case
        least = -(-sum(k * v for k, v in counts.items()) // capacity)
        assert sum(n for _, n in plan) <= least * 1.7 + 1


def test_exact_complements_come_first():
    assert sum(n for _, n in packing.recipes({6: 2, 4: 2, 5: 1, 3: 1, 2: 1}, 10)) == 3
    assert sum(n for _, n in packing.recipes({7: 1, 1: 3, 9: 1}, 10)) == 2
    assert sum(n for _, n in packing.recipes({5: 1_000_000_000}, 10)) == 500_000_000

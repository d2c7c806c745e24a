"""Packing token pieces into full sequences: exact complements first, then best fit."""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from raresight.llm.common import carried, cut, run_hashes, small_batches, worker_state

CAPACITY = 4096
END = 1
#: Bytes of words and ids that a worker remembers, and ids of a word at most; others are encoded each time.
REMEMBERED, WORD_IDS = 40 << 20, 64
BASES = 0x27BB2EE687B0B0FD, 0x9FB21C651E98DF25
GAP = re.compile("[ \n]")
#: Code points that are encoded in one call, and rows of a piece table that share a rank block.
CALL, BLOCK = 1 << 20, 1 << 12
#: New words encoded in one call.
TOGETHER = 500
PIECE = "row long, piece int, start long, length int, ids_crc32 long"


class WordIds:
    """Ids of words, each encoded once and remembered by two 64-bit hashes.

    The tokenizer splits at white space before anything that looks beyond a word,
    so the ids of a text are those of its words in a row. The table is plain
    arrays, ``REMEMBERED`` bytes at most whatever the words are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.a, self.b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begin, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def held(self) -> int:
        return sum(x.nbytes for x in (self.a, self.b, self.begin, self.count, self.flat))

    def _encode(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of words, encoded together and told apart by where their tokens stand."""
        # words that normalisation changes could move places, they go alone
        stays = np.fromiter((w.isascii() or unicodedata.is_normalized("NFC", w) for w in fresh), bool, len(fresh))
        plain = list(compress(fresh, stays)) if not stays.all() else fresh
        found, counts = [], np.zeros(len(fresh), np.int64)
        sizes = []
        for lo in range(0, len(plain), TOGETHER):
            some = plain[lo : lo + TOGETHER]
            whole = self.encoder.encode(" ".join(some), add_special_tokens=False)
            edges = np.cumsum([0, *[len(w) + 1 for w in some]])
            at = np.searchsorted(np.array([x for x, _ in whole.offsets], np.int64), edges)
            found.append(np.array(whole.ids, np.uint32))
            sizes.append(np.diff(at))
        alone = list(compress(fresh, ~stays))
        each = [e.ids for e in self.encoder.encode_batch(alone, add_special_tokens=False)] if alone else []
        found += [np.array(x, np.uint32) for x in each]
        counts[stays] = np.concatenate(sizes) if sizes else 0
        counts[~stays] = [len(x) for x in each]
        order = np.concatenate((np.flatnonzero(stays), np.flatnonzero(~stays)))
        begin = np.zeros(len(fresh), np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        ids = np.concatenate(found) if found else np.zeros(0, np.uint32)
        shift = np.cumsum(counts) - counts
        return ids[np.arange(int(counts.sum())) + np.repeat(begin - shift, counts)], counts

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; long ones are taken in parts that end between words."""
        parts, owner = [], []
        for i, text in enumerate(texts):
            at = 0
            while True:
                gap = GAP.search(text, at + CALL) if len(text) - at > CALL else None
                parts.append(text[at : gap.start() if gap else len(text)].encode())
                owner.append(i)
                if not gap:
                    break
                at = gap.start()
        lo, out = 0, [[] for _ in texts]
        while lo < len(parts):
            hi, size = lo, 0
            while hi < len(parts) and (hi == lo or size + len(parts[hi]) <= 4 * CALL):
                size += len(parts[hi])
                hi += 1
            for i, found in zip(owner[lo:hi], self._part_ids(parts[lo:hi])):
                out[i].append(found)
            lo = hi
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def _part_ids(self, parts: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b"\n".join(parts), np.uint8)
        edge = np.diff(((data != 32) & (data != 10)).view(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        a, b = (run_hashes(data, starts, ends, base) for base in BASES)
        _, first, word = np.unique(a, return_index=True, return_inverse=True)
        if (b[first][word] != b).any():
            _, first, word = np.unique(np.stack((a, b), axis=1), axis=0, return_index=True, return_inverse=True)
            word = word.ravel()
        a, b = a[first], b[first]
        begin, count, flat = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), self.flat
        place = np.searchsorted(self.a, a)
        known = np.zeros(len(a), bool)
        if len(self.a):
            there = np.minimum(place, len(self.a) - 1)
            known = (self.a[there] == a) & (self.b[there] == b)
            begin[known], count[known] = self.begin[there[known]], self.count[there[known]]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            made, n = self._encode([data[s:e].tobytes().decode() for s, e in zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist())])
            begin[fresh], count[fresh] = len(flat) + np.cumsum(n) - n, n
            flat = np.concatenate((flat, made))
            self._remember(fresh, place, a, b, count, made, n)
        lengths = count[word]
        stop = np.cumsum(lengths)
        every = flat[np.arange(int(lengths.sum())) + np.repeat(begin[word] - (stop - lengths), lengths)]
        last = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in parts]))  # words up to the end of each part
        edges = np.concatenate(([0], stop))[last]
        return np.split(every, edges[:-1])

    def _remember(self, fresh, place, a, b, count, made, n) -> None:
        room = (REMEMBERED - self.held()) - np.cumsum(28 + 4 * np.minimum(n, WORD_IDS + 1))
        some = np.flatnonzero((n <= WORD_IDS) & (room > 0))
        if not len(some):
            return
        at, kept = place[fresh[some]], fresh[some]
        begin = len(self.flat) + np.cumsum(n[some]) - n[some]
        self.flat = np.concatenate((self.flat, made[np.repeat(np.isin(np.arange(len(n)), some), n)]))
        self.a, self.b = np.insert(self.a, at, a[kept]), np.insert(self.b, at, b[kept])
        self.begin, self.count = np.insert(self.begin, at, begin), np.insert(self.count, at, count[kept].astype(np.int32))


def slices(batch: pa.RecordBatch):
    """(rows, texts) of a batch, about ``CALL`` code points at a time."""
    rows, texts, held = [], [], 0
    for row, text in zip(batch.column(0), batch.column(1)):
        rows.append(row.as_py())
        texts.append(text.as_py() or "")
        held += len(texts[-1])
        if held >= CALL:
            yield rows, texts
            rows, texts, held = [], [], 0
    if rows:
        yield rows, texts


def token_pieces(path: str, capacity: int, end: int):
    """Arrow batches of (row, text) -> pieces of each document's ids."""

    def run(batches):
        words = worker_state("word_ids_" + re.sub(r"\W", "_", path), lambda: WordIds(path))
        for batch in batches:
            out = [[], [], [], [], []]
            for rows, texts in slices(batch):
                for row, body in zip(rows, words.ids(texts)):
                    ids = np.append(body, np.uint32(end)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        for column, value in zip(out, (row, piece, start, len(part), zlib.crc32(part.tobytes()))):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))], ["row", "piece", "start", "length", "ids_crc32"])

    return run


def recipes(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how often) that use up ``counts``, lengths in the order placed.

    For each length, longest first, sequences of the length and one, two or three
    others that sum to the capacity exactly are taken as often as the counts allow.
    What has no complement is placed by best fit, longest first. The work depends
    on the number of different lengths only.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    rest: dict[int, int] = {}

    def usable(parts: tuple[int, ...]) -> int:
        return min(int(left[p]) // parts.count(p) for p in parts)

    def pair(total: int, first: int | None) -> tuple[int, int] | None:
        """Two available lengths that sum to ``total``, the longer one longest; ``first`` is spent once already."""
        if total < 2:
            return None
        low = np.arange(1, total // 2 + 1)
        ok = (left[low] > 0) & (left[total - low] > 0)
        for x in low[ok].tolist():
            parts = (total - x, x)
            if usable((first, *parts) if first else parts):
                return parts
        return None

    def complement(length: int) -> tuple[int, ...] | None:
        gap = capacity - length
        if not gap:
            return ()
        if usable((length, gap)):
            return (gap,)
        if (two := pair(gap, length)) is not None:
            return two
        for x in np.flatnonzero(left[: gap - 1])[::-1].tolist():
            if usable((length, x)) and 3 * x >= gap:
                for y in np.flatnonzero(left[: gap - x])[::-1].tolist():
                    z = gap - x - y
                    if y <= x and z <= y and left[z] and usable((length, x, y, z)):
                        return (x, y, z)
                    if 2 * y < gap - x:
                        break
        return None

    for length in range(capacity, 0, -1):
        while left[length]:
            found = complement(length)
            if found is None:
                rest[length] = int(left[length])
                left[length] = 0
                break
            parts = (length, *found)
            n = usable(parts)
            for p in parts:
                left[p] -= n
            out.append((parts, n))
    gaps: list[int] = []  # open sequences by gap: best fit takes the smallest that holds the length
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(gap: int, parts: tuple[int, ...], n: int) -> None:
        if gap not in open_:
            bisect.insort(gaps, gap)
        open_.setdefault(gap, []).append((parts, n))

    for length, n in sorted(rest.items(), reverse=True):
        while n:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                parts, m = open_[gap].pop()
                used = min(n, m)
                if m > used:
                    open_[gap].append((parts, m - used))
                if not open_[gap]:
                    del open_[gap]
                    gaps.pop(at)
                put(gap - length, (*parts, length), used)
                n -= used
            else:
                each = min(n, capacity // length)
                fresh = n // each
                put(capacity - each * length, (length,) * each, fresh)
                n -= fresh * each
    return out + [(parts, n) for held in open_.values() for parts, n in held]


def placement(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, dict[str, np.ndarray]]:
    """length -> slots in the order its pieces fill them: first rank, sequence, offset, how often."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for parts, n in plan:
        at = 0
        for p in parts:
            slots.setdefault(p, []).append((base, at, n))
            at += p
        base += n
    out = {}
    for length, some in slots.items():
        table = np.array(some, np.int64)
        out[length] = {"rank": np.cumsum(table[:, 2]) - table[:, 2], "sequence": table[:, 0], "offset": table[:, 1]}
    return out


def pack(spark: SparkSession, docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end``; longer ones are cut at the capacity. A null
    or empty text is ``end`` alone; repeated rows are packed each. Sequences are
    gapless from 0. The driver sees the number of pieces of each length, at most
    ``capacity`` numbers, and plans on those; ranks within a length then lead
    every piece to its place.
    """
    small_batches(spark)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"), F.col(key).alias("key"))
    # the key goes along as a column of the task's own batch, not through Python values
    kind = dict(texts.dtypes)["key"]

    def run(batches):
        cutter = token_pieces(path, capacity, end)
        for batch in batches:
            keys = batch.column(2)
            first = batch.column(0)
            for made in cutter([batch]):
                at = pa.compute.index_in(made.column(0), value_set=first)
                yield pa.RecordBatch.from_arrays([keys.take(at), *made.columns], ["key", *made.schema.names])

    pieces = cut(texts.mapInArrow(run, f"key {kind}, {PIECE}"))
    pieces = cut(pieces.select("key", "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id().alias("uid")))
    block = pieces.withColumn("block", F.floor(F.col("uid") / BLOCK))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    places = spark.sparkContext.broadcast(placement(recipes(counts, capacity)))
    totals = block.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = block.withColumn("r", F.row_number().over(W.partitionBy("length", "block").orderBy("uid")) - 1)
    ranked = inside.join(offsets, ["length", "block"]).select("key", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("r") + F.col("before")).alias("rank"))

    def settle(batches):
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for each in np.unique(length).tolist():
                mine = np.flatnonzero(length == each)
                slot = places.value[each]
                at = np.searchsorted(slot["rank"], rank[mine], side="right") - 1
                sequence[mine] = slot["sequence"][at] + rank[mine] - slot["rank"][at]
                offset[mine] = slot["offset"][at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    placed = ranked.mapInArrow(settle, f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("key", key)


carried(__name__)

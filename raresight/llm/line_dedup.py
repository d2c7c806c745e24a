"""Near-duplicate lines by an exact set-similarity join with prefix, length and position filters."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegralType

from raresight.llm.common import carried, cut, own, range_rank, shuffled, small_batches, worker_state

#: Similarity as a fraction: 4 / 5.
NUM, DEN = 4, 5
#: Counters of the token frequencies; tokens that share one are ordered alike, which costs time but no result.
COUNTERS, CHUNK = 1 << 20, 1 << 14
#: Tasks whose counters are added up in one step.
TASKS = 256
#: Neighbours in a posting list that a set is compared with; what lies beyond is searched in the second round.
LAGS = 512
#: Sets of at most so many tokens match only their equals.
EQUALS = 3
FILTER_BITS = 24
#: Bytes of text taken at once, bytes hashed at once (so few that they stay in a core's cache), members of a list compared in one task.
SLICE, SEGMENT, LIST_BLOCK = 1 << 20, 1 << 16, 50_000
#: Postings of one list that are held at once.
LIST_HELD = 1 << 20
BASE = 0x27BB2EE687B0B0FD
NULL_KEY = -(2**63)
POSTING = "token long, doc long, line long, at long, sig long, bits long, bits2 long"
FOUND = "kind int, x_doc long, x_line long, y_doc long, y_line long, token long"
_TURN = np.uint64(0x9E3779B97F4A7C15)


def least_overlap(a, b):
    """Tokens that two sets of these sizes must share."""
    return -((-NUM * (a + b)) // (NUM + DEN))


def _powers(base: int) -> np.ndarray:
    return np.concatenate(([np.uint64(1)], np.full(SEGMENT, base, np.uint64))).cumprod(dtype=np.uint64)


def _hash_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2^64."""
    return worker_state("line_powers", lambda: (_powers(BASE), _powers(pow(BASE, -1, 1 << 64))))


def _token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs: a polynomial by running sums, moved to a common origin and mixed."""
    up, down = _hash_tables()
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, lo + SEGMENT, "right")))
        if int(ends[stop - 1]) - lo > SEGMENT:  # one token longer than a segment
            out[at] = xxhash.xxh64_intdigest(data[lo : ends[at]].tobytes())
            at += 1
            continue
        part = data[lo : ends[stop - 1]].astype(np.uint64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part + np.uint64(1)) * up[: len(part)], dtype=np.uint64)))
        s, e = starts[at:stop] - lo, ends[at:stop] - lo
        raw = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _TURN
        raw = (raw ^ (raw >> np.uint64(32))) * _TURN
        out[at:stop] = raw ^ (raw >> np.uint64(29))
        at = stop
    return out


class Lines:
    """Token hashes of the lines of some rows, line by line.

    ``offsets`` cut ``data``, the texts' UTF-8 bytes, into rows. Lines end at line
    feeds, tokens at ASCII white space. ``wanted`` picks lines by their places.
    """

    def __init__(self, docs: np.ndarray, offsets: np.ndarray, data: np.ndarray, wanted=None):
        offsets = offsets - offsets[0]
        # a line's place: the text's checksum tells rows of one key apart
        mark = np.array([zlib.crc32(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.int64) << 31
        feeds = np.flatnonzero(data == 10)
        first = np.searchsorted(feeds, offsets) + np.arange(len(offsets))
        count = np.diff(first)
        row = np.repeat(np.arange(len(docs)), count)
        self.doc, self.line = docs[row], mark[row] + np.arange(int(count.sum())) - first[row]
        begin = np.sort(np.concatenate((offsets[:-1], feeds + 1)))
        if wanted:
            # only the bytes of the lines picked are read on
            keep = wanted(self.doc, self.line)
            length = np.diff(np.append(begin, len(data)))
            data, length = data[np.repeat(keep, length)], length[keep]
            begin = np.cumsum(length) - length
            self.doc, self.line = self.doc[keep], self.line[keep]
        blank = (data == 32) | (data - np.uint8(9) < 5)
        edge = np.zeros(len(data) + 1, bool)
        edge[begin] = True
        before = np.concatenate(([True], blank))
        after = np.concatenate((blank, [True]))
        starts = np.flatnonzero(~after & (before | edge))
        edge[-1] = True
        ends = np.flatnonzero(~before & (after | edge))
        self.size = np.diff(np.append(np.searchsorted(starts, begin), len(starts)))
        self.owner = np.repeat(np.arange(len(begin)), self.size)
        self.tokens = _token_hashes(data, starts, ends)


def batches_of(batch: pa.RecordBatch):
    """(keys, offsets, bytes) of a batch's rows, about ``SLICE`` bytes at a time."""
    texts = batch.column(1)
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    docs = batch.column(0).to_numpy()
    at = 0
    while at < len(docs):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        held = texts.buffers()[2]
        data = np.frombuffer(held, np.uint8)[offsets[at] : offsets[stop]] if held is not None else np.zeros(0, np.uint8)
        yield docs[at:stop], offsets[at : stop + 1], data
        at = stop


def counter_of(tokens: np.ndarray) -> np.ndarray:
    return ((tokens * _TURN) >> np.uint64(64 - (COUNTERS.bit_length() - 1))).astype(np.int64)


def count_tokens(batches):
    """Frequencies of a task's tokens, in chunks of counters; ``part`` gathers the tasks that are added up first."""
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for rows in batches_of(batch):
            total += np.bincount(counter_of(Lines(*rows).tokens), minlength=COUNTERS)
    chunks = [i for i in range(COUNTERS // CHUNK) if total[i * CHUNK : (i + 1) * CHUNK].any()]
    data = [zlib.compress(total[i * CHUNK : (i + 1) * CHUNK].tobytes(), 1) for i in chunks]
    part = TaskContext.get().partitionId() // TASKS
    yield pa.RecordBatch.from_pydict({"chunk": pa.array(chunks, pa.int32()), "part": pa.array([part] * len(chunks), pa.int32()), "data": pa.array(data, pa.binary())})


def add_counts(rows: pa.Table) -> pa.Table:
    """The counters of a chunk added up."""
    total = np.zeros(CHUNK, np.int64)
    for data in rows["data"]:
        total += np.frombuffer(zlib.decompress(data.as_py()), np.int64)
    return pa.table({"chunk": rows["chunk"][:1], "part": rows["part"][:1], "data": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def token_levels(docs: DataFrame) -> np.ndarray:
    """Frequency level of each counter over all documents; a fixed number of bytes for any input."""
    kind = "chunk int, part int, data binary"
    parts = docs.mapInArrow(count_tokens, kind).groupBy("chunk", "part").applyInArrow(add_counts, kind)
    out = np.zeros(COUNTERS, np.uint8)
    for chunk, _, data in parts.groupBy("chunk").applyInArrow(add_counts, kind).collect():
        total = np.frombuffer(zlib.decompress(data), np.int64)
        # quarter steps of the logarithm are order enough
        out[chunk * CHUNK : (chunk + 1) * CHUNK] = np.minimum(255, 1 + np.round(4 * np.log2(np.maximum(total, 1))))
    return out


def line_postings(lines: Lines, levels: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Prefix tokens of the distinct sets of a slice (columns of POSTING), and the lines that repeat an earlier set of it."""
    # one key: line, frequency level, leading bits of the token
    key = (lines.owner.astype(np.uint64) << np.uint64(40)) | (levels[counter_of(lines.tokens)].astype(np.uint64) << np.uint64(32)) | (lines.tokens >> np.uint64(32))
    order = np.argsort(key)
    token, owner = lines.tokens[order], lines.owner[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner = token[new], owner[new]
    n = np.bincount(owner, minlength=len(lines.size))
    starts = np.cumsum(n) - n
    some = np.flatnonzero(n)
    mixed = (token ^ (token >> np.uint64(29))) * _TURN
    sig, bits, bits2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    if len(some):
        sig[some] = np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), starts[some])
        bit, half = np.uint64(1) << (mixed >> np.uint64(58)), (mixed & np.uint64(1 << 57)) > 0
        bits[some] = np.bitwise_xor.reduceat(np.where(half, bit, np.uint64(0)), starts[some])
        bits2[some] = np.bitwise_xor.reduceat(np.where(half, np.uint64(0), bit), starts[some])
    # sets of the slice: the earliest line of each stands for the others
    place = some[np.lexsort((lines.line[some], lines.doc[some], bits2[some], bits[some], sig[some], n[some]))]
    same = np.zeros(len(place), bool)
    same[1:] = (sig[place[1:]] == sig[place[:-1]]) & (bits[place[1:]] == bits[place[:-1]]) & (bits2[place[1:]] == bits2[place[:-1]]) & (n[place[1:]] == n[place[:-1]])
    lead = place[np.maximum.accumulate(np.where(same, 0, np.arange(len(place))))] if len(place) else place
    repeat = place[same & ((lines.doc[place] != lines.doc[lead]) | (lines.line[place] != lines.line[lead]))]
    keep = place[~same]
    prefix = np.where(n > EQUALS, n + (-NUM * n) // DEN + 1, 1)[keep]
    at = np.arange(int(prefix.sum())) - np.repeat(np.cumsum(prefix) - prefix, prefix)
    line = np.repeat(keep, prefix)
    columns = [token[starts[line] + at].view(np.int64), lines.doc[line], lines.line[line], (n[line] << 31) | at, sig[line].view(np.int64), bits[line].view(np.int64), bits2[line].view(np.int64)]
    return columns, lines.doc[repeat], lines.line[repeat]


def _posting_rows(levels):
    """Repeated lines go with size 0: they need no search and only pass through."""

    def run(batches):
        names = [x.split()[0] for x in POSTING.split(", ")]
        for batch in batches:
            for rows in batches_of(batch):
                columns, doc, line = line_postings(Lines(*rows), levels.value)
                none = np.zeros(len(doc), np.int64)
                spread = (doc.view(np.uint64) * _TURN).view(np.int64)
                columns = [np.concatenate(x) for x in zip(columns, [spread, doc, line, none, none, none, none])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


def _before(doc, line, doc2, line2):
    return (doc < doc2) | ((doc == doc2) & (line < line2))


def unlike(bits, bits2, other, other2):
    """Tokens that only one of two sets has, at least: their parity bits that differ."""
    return (np.bitwise_count((bits ^ other).view(np.uint64)) + np.bitwise_count((bits2 ^ other2).view(np.uint64))).astype(np.int64)


def may_match(n, at, n2, at2, apart):
    """Length, position and bit filters: False only for sets that can't be similar enough."""
    need = least_overlap(n, n2)
    length = DEN * np.minimum(n, n2) >= NUM * np.maximum(n, n2)
    return length & (np.minimum(n - at, n2 - at2) >= need) & (apart <= n + n2 - 2 * need) & (np.maximum(n, n2) > EQUALS)


def search_lists(batches):
    """Posting lists, sorted by (token, at, sig, doc, line), to candidate pairs, repeats and open searches.

    A list is walked in the order of set sizes. Equal sets are one set from its
    earliest line on. Each set is compared with ``LAGS`` neighbours on either side;
    kind 0 is a line to remove, 1 a pair (x the later line), 2 a set of this list
    with more possible partners than its two likest.
    """
    held: list[np.ndarray] | None = None
    last: list[int] | None = None

    def emit(kind, x_doc, x_line, y_doc=None, y_line=None, token=None):
        none = np.zeros(len(x_doc), np.int64)
        columns = [x_doc, x_line, *(none if c is None else c for c in (y_doc, y_line, token))]
        names = [c.split()[0] for c in FOUND.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x_doc), kind), pa.int32()), *(pa.array(c, pa.int64()) for c in columns)], names)

    def work(c: list[np.ndarray]):
        """Pairs of complete lists of distinct sets: the two likest earlier sets of each."""
        token, doc, line, packed, _, bits, bits2 = c
        n, at = packed >> 31, packed & (2**31 - 1)
        passed, more = np.zeros(len(token), np.int64), np.zeros(len(token), bool)
        best = np.full((2, len(token)), 1 << 40)
        partner = np.full((2, len(token)), -1)
        active = np.arange(1, len(token))
        for lag in range(1, LAGS + 2):
            active = active[active >= lag]
            # sizes only fall with the lag
            active = active[(token[active] == token[active - lag]) & (DEN * n[active - lag] >= NUM * n[active])]
            if not len(active):
                break
            j = active - lag
            if lag > LAGS:
                more[active], more[j] = True, True
                break
            apart = unlike(bits[active], bits2[active], bits[j], bits2[j])
            ok = may_match(n[active], at[active], n[j], at[j], apart)
            i, j, apart = active[ok], j[ok], apart[ok]
            swap = _before(doc[i], line[i], doc[j], line[j])
            for x, y, far in ((i[~swap], j[~swap], apart[~swap]), (j[swap], i[swap], apart[swap])):
                passed[x] += 1
                first = far < best[0, x]
                second = ~first & (far < best[1, x])
                best[1, x] = np.where(first, best[0, x], np.where(second, far, best[1, x]))
                partner[1, x] = np.where(first, partner[0, x], np.where(second, y, partner[1, x]))
                best[0, x], partner[0, x] = np.where(first, far, best[0, x]), np.where(first, y, partner[0, x])
        for y in partner:
            x = np.flatnonzero(y >= 0)
            if len(x):
                yield emit(1, doc[x], line[x], doc[y[x]], line[y[x]])
        m = np.flatnonzero((more | (passed > 2)) & (n > EQUALS))
        if len(m):
            yield emit(2, doc[m], line[m], token=token[m])

    for batch in batches:
        c = [batch.column(i).to_numpy() for i in range(7)]
        gone = c[3] == 0
        if gone.any():
            yield emit(0, c[1][gone], c[2][gone])
            c = [x[~gone] for x in c]
        if not len(c[0]):
            continue
        # equal sets stand together, also over the edge of a batch
        token, doc, line, packed, sig, bits, bits2 = c
        same = np.zeros(len(token), bool)
        same[1:] = (token[1:] == token[:-1]) & (packed[1:] == packed[:-1]) & (sig[1:] == sig[:-1]) & (bits[1:] == bits[:-1]) & (bits2[1:] == bits2[:-1])
        if last is not None:
            same[0] = [token[0], packed[0], sig[0], bits[0], bits2[0]] == [last[0], *last[3:]]
        lead = np.maximum.accumulate(np.where(same, -1, np.arange(len(token))))
        first_doc = np.where(lead >= 0, doc[lead], last[1] if last else 0)
        first_line = np.where(lead >= 0, line[lead], last[2] if last else 0)
        repeat = same & ((doc != first_doc) | (line != first_line)) & ((packed & (2**31 - 1)) == 0)
        if repeat.any():
            yield emit(0, doc[repeat], line[repeat])
        if lead[-1] >= 0:
            last = [int(x[lead[-1]]) for x in c]
        c = [x[~same] for x in c]
        if not len(c[0]):
            continue
        whole = [np.concatenate(x) for x in zip(held, c)] if held else c
        end = int(np.searchsorted(whole[0], whole[0][-1]))  # the last list may go on
        if not end and len(whole[0]) > LIST_HELD:
            # a list beyond memory: what is held is searched now, and all of it again in the second round
            yield from work(whole)
            m = np.flatnonzero((whole[3] >> 31) > EQUALS)
            yield emit(2, whole[1][m], whole[2][m], token=whole[0][m])
            # one more than is compared: the next set too must see whether its partners go on
            held = [x[-LAGS - 1 :] for x in whole]
            continue
        if end:
            yield from work([x[:end] for x in whole])
        held = [x[end:] for x in whole]
    if held:
        yield from work(held)


def filter_cells(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    mixed = (doc.view(np.uint64) * _TURN) ^ (line.view(np.uint64) + (line.view(np.uint64) >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9))
    mixed = (mixed ^ (mixed >> np.uint64(27))) * _TURN
    return (mixed >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def bit_filter(spark: SparkSession, places: DataFrame):
    """Broadcast bits of the cells of (a, b) places: of fixed size, exact only where a bit is off."""

    def mark(batches):
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[filter_cells(batch.column(0).to_numpy(), batch.column(1).to_numpy())] = True
        words = np.packbits(bits).view(">i8").astype(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at), "mask": pa.array(words[at])})

    mask = np.zeros(1 << (FILTER_BITS - 6), ">i8")
    for at, value in places.mapInArrow(mark, "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).collect():
        mask[at] = value
    return spark.sparkContext.broadcast(mask.tobytes())


def filter_hits(bits: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    cell = filter_cells(a, b)
    return (np.frombuffer(bits, np.uint8)[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0


def _sets(lines: Lines) -> pa.Array:
    """The distinct tokens of each line."""
    key = (lines.owner.astype(np.uint64) << np.uint64(40)) | (lines.tokens >> np.uint64(24))
    order = np.argsort(key)
    token, owner, key = lines.tokens[order], lines.owner[order], key[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    if (new[1:] & (key[1:] == key[:-1])).any():  # different tokens of one key
        order = np.lexsort((lines.tokens, lines.owner))
        token, owner = lines.tokens[order], lines.owner[order]
        new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    edges = np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=len(lines.size)))))
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(token[new].view(np.int64)))


def token_sets(spark: SparkSession, docs: DataFrame, places: DataFrame) -> DataFrame:
    """(doc, line, set) of the lines at ``places``, found by scanning the texts; some others may come along."""
    shared = bit_filter(spark, places)

    def run(batches):
        for batch in batches:
            for rows in batches_of(batch):
                lines = Lines(*rows, wanted=lambda doc, line: filter_hits(shared.value, doc, line))
                yield pa.RecordBatch.from_pydict({"doc": pa.array(lines.doc), "line": pa.array(lines.line), "set": _sets(lines)})

    return docs.mapInArrow(run, "doc long, line long, set array<long>").dropDuplicates(["doc", "line"])


def open_cells(every: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of lists to (token, mine, block): each block of a list's probes meets each block of its members.

    A row number deals them, so that rows of one place part too; either side of a
    cell holds about ``LIST_BLOCK`` rows at most.
    """
    turn = F.xxhash64(F.monotonically_increasing_id())
    last = F.floor(F.count(F.lit(1)) / LIST_BLOCK)
    asked = cut(every.join(probes, ["token", "doc", "line"], "left_semi").withColumn("turn", turn))
    blocks = every.groupBy("token").agg(last.alias("last")).join(asked.groupBy("token").agg(last.alias("last_mine")), "token")
    blocks = cut(blocks)
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c)))
    dealt = lambda c: F.pmod("turn", F.col(c) + 1)
    asked = asked.join(blocks, "token").withColumn("mine", dealt("last_mine")).withColumn("block", upto("last"))
    there = every.withColumn("turn", turn).join(blocks, "token").withColumn("block", dealt("last")).withColumn("mine", upto("last_mine"))
    return asked.drop("turn", "last", "last_mine"), there.drop("turn", "last", "last_mine")


def open_lists(spark: SparkSession, docs: DataFrame, probes: DataFrame, levels) -> DataFrame:
    """(doc, line) of probes (doc, line, token) that have an earlier similar line anywhere in their list.

    The lists are made again from the texts with whole sets, for tokens of a bit
    filter, dealt in blocks of bounded size, and each block of probes is compared
    with each block. Only matched probes are returned, so a list costs rows by its members.
    """
    shared = bit_filter(spark, probes.select("token", F.lit(0).cast("long")).distinct())

    def members(batches):
        for batch in batches:
            for rows in batches_of(batch):
                lines = Lines(*rows)
                (token, doc, line, packed, _, bits1, bits2), _, _ = line_postings(lines, levels.value)
                keep = np.flatnonzero(filter_hits(shared.value, token, np.zeros_like(token)) & (packed >> 31 > EQUALS))
                place = {(d, x): i for i, (d, x) in enumerate(zip(lines.doc.tolist(), lines.line.tolist()))}
                at = pa.array([place[d, x] for d, x in zip(doc[keep].tolist(), line[keep].tolist())], pa.int64())
                columns = [pa.array(c[keep]) for c in (token, doc, line, packed, bits1, bits2)]
                yield pa.RecordBatch.from_arrays([*columns, _sets(lines).take(at)], ["token", "doc", "line", "at", "bits", "bits2", "set"])

    every = docs.mapInArrow(members, "token long, doc long, line long, at long, bits long, bits2 long, set array<long>")
    every = cut(every.join(probes.select("token").distinct(), "token", "left_semi"))
    asked, there = open_cells(every, probes)

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        number = lambda t, c: t[c].to_numpy()
        packed, doc, line, bits1, bits2 = (number(b, c) for c in ("at", "doc", "line", "bits", "bits2"))
        n, at = packed >> 31, packed & (2**31 - 1)
        edges, tokens = _flat(b["set"])
        mine_edges, mine = _flat(a["set"])
        hits = []
        for k, (x, d, place, b1, b2) in enumerate(zip(*(number(a, c).tolist() for c in ("at", "doc", "line", "bits", "bits2")))):
            apart = unlike(bits1, bits2, np.int64(b1), np.int64(b2))
            some = np.flatnonzero(may_match(n, at, x >> 31, x & (2**31 - 1), apart) & _before(doc, line, d, place))
            own = mine[mine_edges[k] : mine_edges[k + 1]]
            for i in some.tolist():
                both = len(np.intersect1d(own, tokens[edges[i] : edges[i + 1]], assume_unique=True))
                if DEN * both >= NUM * (len(own) + int(n[i]) - both):
                    hits.append(k)
                    break
        return pa.table({"doc": a["doc"].take(pa.array(hits, pa.int64())), "line": a["line"].take(pa.array(hits, pa.int64()))})

    return asked.groupBy("token", "mine", "block").cogroup(there.groupBy("token", "mine", "block")).applyInArrow(cell, "doc long, line long").distinct()


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy()
    return (offsets, lists.values.to_numpy()) if len(lists) else (np.zeros(1, np.int64), np.zeros(0, np.int64))


def verified(spark: SparkSession, docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc, line) of the later lines of pairs whose sets are similar enough."""
    x, y = pairs.select(F.col("x_doc").alias("doc"), F.col("x_line").alias("line")), pairs.select(F.col("y_doc").alias("doc"), F.col("y_line").alias("line"))
    sets = cut(token_sets(spark, docs, x.union(y)))
    left = sets.select(F.col("doc").alias("x_doc"), F.col("line").alias("x_line"), F.col("set").alias("xs"))
    right = sets.select(F.col("doc").alias("y_doc"), F.col("line").alias("y_line"), F.col("set").alias("ys"))
    both = pairs.join(left, ["x_doc", "x_line"]).join(right, ["y_doc", "y_line"])
    shared = F.size(F.array_intersect("xs", "ys"))
    alike = both.where(DEN * shared >= NUM * (F.size("xs") + F.size("ys") - shared))
    return alike.select(F.col("x_doc").alias("doc"), F.col("x_line").alias("line")).distinct()


def numbered(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``__d``, a long in the order of the key: whole numbers stand for themselves, other keys are ranked; null comes first."""
    keys = docs.select(F.col(key).alias("__key"))
    if isinstance(keys.schema["__key"].dataType, IntegralType):
        return docs.withColumn("__d", F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)))
    ranks = range_rank(keys.where("__key is not null").distinct(), [F.col("__key")], name="__rank")
    joined = docs.join(ranks, F.col(key) == F.col("__key"), "left")
    return joined.select(*own(docs), F.coalesce("__rank", F.lit(NULL_KEY)).alias("__d"))


def later_matches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line) of every line that has an earlier line of Jaccard similarity 0.8 or more.

    Lines are sets of words; a line without words matches nothing. Earlier is by
    key, then by the text's checksum and the line's number; a null key comes first.
    Whether the earlier line goes itself makes no difference. ``line`` packs the
    checksum and the number; identical rows share their places and never match
    each other's equal places. ``doc`` is the key, or its rank if it is no whole number.
    """
    return _matches(numbered(docs, key), text)


def _matches(docs: DataFrame, text: str) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("__d").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    levels = spark.sparkContext.broadcast(token_levels(texts))
    postings = texts.mapInArrow(_posting_rows(levels), POSTING)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = postings.repartition(n, "token").sortWithinPartitions("token", "at", "sig", "bits", "bits2", "doc", "line")
    found = cut(dealt.mapInArrow(search_lists, FOUND))
    x = [F.col("x_doc").alias("doc"), F.col("x_line").alias("line")]
    gone = found.where("kind = 0").select(*x).distinct()
    pairs = found.where("kind = 1").select("x_doc", "x_line", "y_doc", "y_line").distinct()
    first = cut(gone.union(verified(spark, texts, cut(_without(pairs, gone)))).distinct())
    probes = cut(found.where("kind = 2").select(*x, "token").join(shuffled(first), ["doc", "line"], "left_anti").distinct())
    return first if probes.isEmpty() else first.union(open_lists(spark, texts, probes, levels)).distinct()


def _without(pairs: DataFrame, gone: DataFrame) -> DataFrame:
    done = gone.select(F.col("doc").alias("x_doc"), F.col("line").alias("x_line"))
    return pairs.join(done, ["x_doc", "x_line"], "left_anti")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with later near-duplicate lines taken out of ``text``, and n_lines, n_removed, emptied.

    ``n_lines`` counts the lines before; ``emptied`` says that no line with a word
    is left of a text that had one. Null texts stay null with no line, rows without
    a removal keep their text as it is. Columns of these names are replaced. Keys
    may be of any type with an order; a very long text is one batch of its own.
    """
    docs = docs.drop("n_lines", "n_removed", "emptied")
    ranked = numbered(docs, key)
    lines = _matches(ranked, text).groupBy("doc", F.shiftright("line", 31).alias("mark")).agg(F.collect_list(F.col("line").bitwiseAND(F.lit(2**31 - 1))).alias("__gone"))
    lines = cut(lines.withColumnsRenamed({"doc": "__doc", "mark": "__mark"}))
    marked = ranked.withColumn("__m", F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    # texts that surely keep all lines go past the join
    touched = bit_filter(docs.sparkSession, lines.select("__doc", "__mark"))

    def may_change(doc: pd.Series, mark: pd.Series) -> pd.Series:
        return pd.Series(filter_hits(touched.value, doc.to_numpy(), mark.to_numpy()))

    marked = marked.withColumn("__may", F.pandas_udf(may_change, "boolean")("__d", "__m"))
    # a written list of line numbers takes a small part of the room it needs
    changed = marked.where("__may").join(shuffled(lines), (F.col("__d") == F.col("__doc")) & (F.col("__m") == F.col("__mark")), "left")
    same = marked.where("not __may").withColumn("__gone", F.lit(None).cast("array<bigint>"))
    joined = changed.select(*own(docs), "__gone").union(same.select(*own(docs), "__gone"))

    def without(texts: pd.Series, gone: pd.Series) -> pd.Series:
        def one(t, numbers):
            if t is None or numbers is None:
                return None
            drop = set(numbers.tolist())
            return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop)

        return pd.Series([one(t, g) for t, g in zip(texts, gone)], dtype=object)

    hit = F.col("__gone").isNotNull()
    shorter = F.pandas_udf(without, "string")(F.when(hit, F.col(text)), F.col("__gone"))
    out = joined.withColumn("__text", shorter)
    words = F.length(F.translate(F.col("__text"), " \t\n\x0b\x0c\r", "")) > 0
    count = F.when(F.col(text).isNotNull(), F.octet_length(F.col(text)) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1).otherwise(0)
    return out.select(
        *[F.when(hit, F.col("__text")).otherwise(F.col(text)).alias(text) if name == text else c for name, c in zip(docs.columns, own(docs))],
        count.cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
        (hit & ~F.coalesce(words, F.lit(False))).alias("emptied"),
    )


carried(__name__)

"""Phrase collocations by dynamic itemset counting over cyclic shard scans."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from raresight.llm.common import TURN, carried, cut, mixed, small_batches
from raresight.session import drop_scratch, scratch_path

LEAST, LONGEST, TOP = 100, 5, 2000
#: Parts the documents are dealt into; a scan reads one of them.
SHARDS = 4
#: Cells of the activation table and of the filters, a byte or a bit each whatever the input.
CELL_BITS = 24
#: Bytes of text taken at once, phrases counted at once before they leave a task.
SLICE, HELD, OUT = 1 << 21, 3 << 20, 1 << 18
#: Slots in which a task keeps the phrases it has named; one that lost its slot is named again.
NAMED_BITS = 20
BASE_A, BASE_B = 0x27BB2EE687B0B0FD, 0x9FB21C651E98DF25
#: Bytes of a word up to which it is hashed side by side with others, eight of them at a time.
SIDE = 64
STEP_A, STEP_B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
#: Counts travel as blocks: a row has the sorted keys of one part, which is the first bits of ``a``.
COUNTS = "part int, a binary, b binary, n binary"
#: Bytes of stored texts a part is made for, and the fewest bits of parts.
PART, PART_BITS = 8 << 20, 4
#: Mentions of a phrase that the first naming scan passes on, about; a scan after it passes on all it is asked for.
MENTIONS = 16
#: What a byte is: 0 of a word, 1 between words, 2 between pieces.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """64-bit hashes of runs of ``data``, which has eight bytes more than its runs.

    Each eight bytes are scrambled before the next come in: sums of bytes by powers
    of a number are the same for some words of regular make, whatever the number.
    """
    eight, turn = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)), np.uint64(base)
    first = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
    size = ends - starts
    out = size.astype(np.uint64) * TURN
    live, done = np.flatnonzero(size <= SIDE), 0
    while len(live):
        left = size[live] - done
        x = out[live] ^ (eight[starts[live] + done] & first[np.minimum(left, 8)])
        x = (x ^ (x >> np.uint64(32))) * turn
        x = (x ^ (x >> np.uint64(29))) * turn
        out[live] = x ^ (x >> np.uint64(32))
        live, done = live[left > 8], done + 8
    for i in np.flatnonzero(size > SIDE).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]], base)
    return out


class Words:
    """Word hashes of a text, in two independent 64-bit words, and the piece each word is in."""

    def __init__(self, data: np.ndarray):
        self.data = LOWER[np.append(data, np.zeros(8, np.uint8))]
        kind = KIND[data]
        inside = np.zeros(len(data) + 2, bool)
        np.equal(kind, 0, out=inside[1:-1])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edge[::2], edge[1::2]
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), self.starts)
        self.a = word_hashes(self.data, self.starts, self.ends, BASE_A)
        self._b = None

    def b(self, at: np.ndarray) -> np.ndarray:
        """Second hashes of the words at some places; all are made once many are asked for."""
        if self._b is None and 4 * len(at) >= len(self.a):
            self._b = word_hashes(self.data, self.starts, self.ends, BASE_B)
        if self._b is not None:
            return self._b[at]
        some, where = np.unique(at, return_inverse=True)
        return word_hashes(self.data, self.starts[some], self.ends[some], BASE_B)[where]

    def phrase(self, at: int, length: int) -> str:
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[at : at + length], self.ends[at : at + length])).decode("utf-8", "replace")


def language_key(lang: str) -> np.uint64:
    """Spark's xxhash64 of the name."""
    return np.uint64(xxhash.xxh64_intdigest(lang.encode(), 42))


class Phrases:
    """Phrases of a text by growing length: places ``at`` and keys ``a``, which hold the language too."""

    def __init__(self, words: Words, lang: str):
        self.words, self.length = words, 1
        self.at = np.arange(len(words.a))
        self.a = mixed(words.a ^ language_key(lang))

    def grow(self, usable: np.ndarray) -> np.ndarray:
        """One word more, where the phrase and the one a word later are both ``usable``; returns where the former stood."""
        both = usable[:-1] & usable[1:] & (self.at[1:] == self.at[:-1] + 1)
        if self.length == 1:
            both &= self.words.piece[1:] == self.words.piece[:-1]
        kept = np.flatnonzero(both)
        self.at = self.at[kept]
        self.a = mixed(self.a[kept] * STEP_A + self.words.a[self.at + self.length])
        self.length += 1
        return kept

    def keys(self, some=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """(a, b): ``b`` is a second, independent hash of 29 bits before the length's three."""
        at = self.at[some]
        b = mixed(self.words.b(at))
        for i in range(1, self.length):
            b = mixed(b * STEP_B + self.words.b(at + i))
        return self.a[some], ((b >> np.uint64(35)) << np.uint64(3) | np.uint64(self.length)).astype(np.uint32)


def cell_of(a: np.ndarray) -> np.ndarray:
    return (a >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def texts_of(batch: pa.RecordBatch):
    """(language, words) of a batch of (lang, text), about ``SLICE`` bytes at a time."""
    langs = batch.column(0).to_numpy(zero_copy_only=False)
    for lang in sorted(set(langs)):
        some, held = [], 0
        for text in batch.column(1).filter(pa.array(langs == lang)):
            some.append(text.as_py())
            held += len(some[-1])
            if held >= SLICE:
                yield lang, Words(np.frombuffer("\n".join(some).encode(), np.uint8))
                some, held = [], 0
        if some:
            yield lang, Words(np.frombuffer("\n".join(some).encode(), np.uint8))


def tallied(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, equal ones put together and their counts added up."""
    a, b, n = (np.concatenate(x) for x in zip(*parts))
    # plain sorting is faster than sorting places: the last bits make way for the place and are put right after
    low = np.uint64(len(a).bit_length())
    order = (np.sort(a >> low << low | np.arange(len(a), dtype=np.uint64)) & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    found = a[order]
    if (found[1:] < found[:-1]).any():
        order = order[np.argsort(found, kind="stable")]
    a, b, n = a[order], b[order], n[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
    first = np.flatnonzero(np.append(True, ~same | (b[1:] != b[:-1]))) if len(a) else order
    return a[first], b[first], np.add.reduceat(n, first) if len(first) else n


def blocks_of(a: np.ndarray, b: np.ndarray, n: np.ndarray, bits: int):
    """Batches of ``COUNTS`` with sorted keys, a row for each part, about ``OUT`` keys at a time."""
    if not len(a):
        return
    of = (a >> np.uint64(64 - bits)).astype(np.int32)
    edge = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(a))
    rows = np.append(np.flatnonzero(np.diff(edge[:-1] // OUT, prepend=-1)), len(edge) - 1)
    for lo, hi in zip(rows[:-1], rows[1:]):
        cells = [[x[s:e].tobytes() for s, e in zip(edge[lo:hi], edge[lo + 1 : hi + 1])] for x in (a, b, n)]
        yield pa.RecordBatch.from_arrays([pa.array(of[edge[lo:hi]]), *(pa.array(x, pa.binary()) for x in cells)], ["part", "a", "b", "n"])


def keys_in(batch) -> list[tuple[int, tuple]]:
    """The (part, (a, b, n)) of each row of a batch of blocks."""
    part, *cells = (batch.column(i) for i in range(4))
    kinds = np.uint64, np.uint32, np.int64
    return [(p, tuple(np.frombuffer(c.as_buffer(), kind) for c, kind in zip(row, kinds))) for p, *row in zip(part.to_pylist(), *cells)]


def summed(blocks: DataFrame, bits: int, least: int = 0) -> DataFrame:
    """One block a part with its counts added up; only those of ``least`` and the languages."""

    def add(rows: pa.Table) -> pa.Table:
        a, b, n = tallied([x for _, x in keys_in(rows)])
        on = (n >= least) | (b == 0)
        made = list(blocks_of(a[on], b[on], n[on], bits))
        return pa.Table.from_batches(made) if made else rows.slice(0, 0)

    return blocks.groupBy("part").applyInArrow(add, COUNTS)


def counts_of(scan: int, shards: int, longest: int, started, bits: int):
    """Counts of the phrases that are open in a scan.

    ``started`` has, by cell, the scan after which a phrase reached the threshold.
    A phrase starts when its first and its last words but one have both reached it,
    and is counted in the ``shards`` scans that follow: one full cycle. Cells only
    ever get their first value, so each phrase keeps its start, whatever shares its cells.
    A language's own key, with no length, counts its words.
    """

    def run(batches):
        start = np.frombuffer(zlib.decompress(started.value), np.uint8)
        parts, held = [], 0

        for batch in batches:
            for lang, words in texts_of(batch):
                at = Phrases(words, lang)
                if scan <= shards:
                    parts.append((*at.keys(), np.ones(len(at.a), np.int64)))
                    parts.append((np.array([language_key(lang)]), np.zeros(1, np.uint32), np.array([len(at.a)])))
                    held += len(at.a)
                begun = np.zeros(len(at.a), np.uint8)
                for _ in range(2, longest + 1):
                    reached = start[cell_of(at.a)]
                    ready = np.where(reached > 0, np.maximum(reached, begun), 0)
                    kept = at.grow(ready > 0)
                    begun = np.maximum(ready[kept], ready[kept + 1])
                    open_ = np.flatnonzero(scan <= begun.astype(np.int64) + shards)
                    parts.append((*at.keys(open_), np.ones(len(open_), np.int64)))
                    held += len(open_)
                if held > HELD:
                    parts = [tallied(parts)]
                    held = len(parts[0][0])
                    if held > HELD // 2:
                        yield from blocks_of(*parts[0], bits)
                        parts, held = [], 0
        if parts:
            yield from blocks_of(*tallied(parts), bits)

    return run


def marked(blocks: DataFrame, chosen) -> np.ndarray:
    """Which cells the keys ``chosen`` by (b, n) fall in: a bit for each cell comes to the driver, whatever the input."""

    def mark(batches):
        bits = np.zeros(1 << CELL_BITS, bool)
        for batch in batches:
            for _, (a, b, n) in keys_in(batch):
                bits[cell_of(a[chosen(b, n)])] = True
        words = np.packbits(bits).view(">i8").astype(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at), "mask": pa.array(words[at])})

    mask = np.zeros(1 << (CELL_BITS - 6), ">i8")
    for at, value in blocks.mapInArrow(mark, "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).collect():
        mask[at] = value
    return np.unpackbits(mask.view(np.uint8)).view(bool)


def in_cells(blocks: DataFrame, cells: np.ndarray, bits: int) -> DataFrame:
    """The counts whose cells are on, and some more if they share them; those of languages always."""
    shared = blocks.sparkSession.sparkContext.broadcast(zlib.compress(np.packbits(cells).tobytes(), 1))

    def keep(batches):
        on = np.unpackbits(np.frombuffer(zlib.decompress(shared.value), np.uint8)).view(bool)
        for batch in batches:
            for _, (a, b, n) in keys_in(batch):
                some = on[cell_of(a)] | (b == 0)
                yield from blocks_of(a[some], b[some], n[some], bits)

    return blocks.mapInArrow(keep, COUNTS)


def frequent(table: str, spark, least: int, longest: int, shards: int, bits: int) -> DataFrame:
    """(a, b, n) of every phrase that occurs ``least`` times or more, and of every language, from the shards at ``table``.

    Scans go round the shards. Words are counted from the first scan on, longer
    phrases from when both subphrases have reached the threshold; the scans end
    when each phrase has completed its cycle. A phrase of ``least`` occurrences has
    a share of them in one scan at least, so only keys with such a share are added
    up over the scans, and of a scan that no open cycle holds any more only they stay.
    """
    started = np.zeros(1 << CELL_BITS, np.uint8)
    likely = np.zeros(1 << CELL_BITS, bool)
    share = -(-least // shards)
    parts, done, scan = [], [], 0
    while scan < shards or scan < int(started.max()) + shards:
        scan += 1
        texts = spark.read.parquet(f"{table}/shard={(scan - 1) % shards}").select("lang", "text")
        shared = spark.sparkContext.broadcast(zlib.compress(started.tobytes(), 1))
        found = texts.mapInArrow(counts_of(scan, shards, longest, shared, bits), COUNTS)
        parts.append(written(summed(found, bits)))
        shared.unpersist()
        likely |= marked(parts[-1][0], lambda b, n: n >= share)
        # a count that changed now has all its parts in the last cycle
        new = _totals([x for x, _ in parts], likely & (started == 0), least, bits)
        started[marked(new, lambda b, n: ((b & 7) > 0) & ((b & 7) < longest)) & (started == 0)] = scan
        if len(parts) == shards:
            old, path = parts.pop(0)
            done.append(cut(in_cells(old, likely, bits)))
            drop_scratch(spark, path)

    def rows(batches):
        for batch in batches:
            for _, (a, b, n) in keys_in(batch):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a.view(np.int64), b.view(np.int32), n)], ["a", "b", "n"])

    return _totals(done + [x for x, _ in parts], likely, least, bits).mapInArrow(rows, "a long, b int, n long")


def part_bits(table: str, spark) -> int:
    """Bits of parts for the texts stored at ``table``, so that a part stays small whatever the input."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    size = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return min(30, max(PART_BITS, (size // PART).bit_length()))


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """A table under the shared folder, and where it is."""
    path = scratch_path(df.sparkSession, "counts")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _totals(parts: list[DataFrame], cells: np.ndarray, least: int, bits: int) -> DataFrame:
    blocks = parts[0]
    for more in parts[1:]:
        blocks = blocks.union(more)
    return summed(in_cells(blocks, cells, bits), bits, least)


def levels_of(found: DataFrame) -> np.ndarray:
    """By cell, two more than the logarithm of the largest count of its keys; 0 without a key. The driver gets a byte a cell at most."""
    level = F.floor(F.log2(F.max("n"))) + 2
    cells = found.groupBy(F.shiftrightunsigned("a", 64 - CELL_BITS).cast("int").alias("cell")).agg(level.cast("byte").alias("level")).toArrow()
    out = np.zeros(1 << CELL_BITS, np.uint8)
    out[cells["cell"].to_numpy()] = cells["level"].to_numpy()
    return out


def mentions_of(levels, all_of_them: bool, shards: int, longest: int):
    """(a, b, phrase) of asked-for phrases of a scan, and of some that share their cells.

    ``levels`` is 0 where no phrase is asked for, 1 where one leads to longer ones
    alone, else ``levels_of``. A mention passes by a hash of key, batch and place, so often that about
    ``MENTIONS`` of an evenly spread phrase do, or ``all_of_them``; a task passes a phrase on again only if it lost its slot.
    """

    def run(batches):
        level = np.frombuffer(zlib.decompress(levels.value), np.uint8)
        known = np.zeros(1 << NAMED_BITS, np.uint64)
        slot_of = lambda a: (a & np.uint64((1 << NAMED_BITS) - 1)).astype(np.int64)
        for batch in batches:
            for lang, words in texts_of(batch):
                at, rows = Phrases(words, lang), []
                mark = mixed(np.array([zlib.crc32(words.data)], np.uint64))
                while True:
                    seen = level[cell_of(at.a)]
                    place = np.flatnonzero(seen > 1)
                    if not all_of_them:
                        often = np.minimum(1.0, MENTIONS * shards * 2.0 ** (2.0 - seen[place]))
                        place = place[(mixed(at.a[place] ^ mixed(at.at[place].astype(np.uint64) ^ mark)) >> np.uint64(11)) * 2.0**-53 < often]
                    place = place[known[slot_of(at.a[place])] != at.a[place]]
                    a, first = np.unique(at.a[place], return_index=True)
                    known[slot_of(a)] = a
                    place = place[first]
                    keys = at.keys(place)
                    rows += zip(keys[0].view(np.int64).tolist(), keys[1].view(np.int32).tolist(), [words.phrase(i, at.length) for i in at.at[place].tolist()])
                    if at.length == longest:
                        break
                    at.grow(seen > 0)
                if rows:
                    a, b, phrase = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array([lang] * len(a)), pa.array(phrase)], ["a", "b", "lang", "phrase"])

    return run


def named(table: str, found: DataFrame, longest: int, shards: int) -> DataFrame:
    """(lang, phrase, words, f) of the counted phrases ``found``, their words read off the texts.

    The first shard names nearly all by a part of its mentions; the next ones are read
    for those not met so far, at last the first one again, now with all its mentions.
    """
    spark, out, rest, every = found.sparkSession, None, found, levels_of(found) > 0
    for i in range(shards + 1):
        levels = levels_of(rest)
        if not levels.any():
            break
        levels = np.where(levels > 0, levels, every)
        shared = spark.sparkContext.broadcast(zlib.compress(levels.tobytes(), 1))
        texts = spark.read.parquet(f"{table}/shard={i % shards}").select("lang", "text")
        met = texts.mapInArrow(mentions_of(shared, i > 0, shards, longest), "a long, b int, lang string, phrase string")
        names = met.join(rest.select("a", "b", "n"), ["a", "b"]).groupBy("a", "b").agg(F.min("lang").alias("lang"), F.min("phrase").alias("phrase"), F.min("n").alias("f"))
        names = cut(names)
        out = names if out is None else out.union(names)
        rest = cut(rest.join(names, ["a", "b"], "left_anti"))
    kind = "lang string, phrase string, words int, f long"
    return spark.createDataFrame([], kind) if out is None else out.select("lang", "phrase", F.col("b").bitwiseAND(F.lit(7)).cast("int").alias("words"), "f")


def phrases(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases (lang, phrase, words, f) of 1 to ``longest`` words, and (lang, n) with all word occurrences.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends and
    those into words at spaces and tabs; phrases stay inside pieces. A null language
    is ``und``; null and empty texts have no words; repeated rows count each time.
    Tasks hold a few megabytes of texts, or one text if it is longer.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).where(F.length("text") > 0)
    table = scratch_path(spark, "shards")
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    dealt.write.partitionBy("shard").parquet(table)
    # shards of few documents may be empty: each has a folder all the same
    for i in range(shards):
        rows.limit(0).write.mode("append").parquet(f"{table}/shard={i}")
    found = cut(frequent(table, spark, least, longest, shards, part_bits(table, spark)))
    kept = cut(named(table, found.where(F.col("b") != 0), longest, shards))
    langs = rows.select("lang").distinct().withColumn("a", F.xxhash64("lang"))
    totals = cut(found.where((F.col("b") == 0) & (F.col("n") > 0)).join(langs, "a").select("lang", "n"))
    drop_scratch(spark, table)
    return kept, totals


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two words or more.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its weakest cut, and
    score is floor(1000 * a * n / (l * r)), in exact decimals. A phrase that is part
    of a longer one with the same count is left out: the phrases a word longer tell,
    since counts only fall with the length. No documents or no frequent phrase give no row.
    """
    found, totals = phrases(docs, lang, text, least, longest, shards)
    words = F.split("phrase", " ")
    part = lambda lo, n: F.array_join(F.slice(words, lo, n), " ")
    long = found.where(F.col("words") > 1)
    inner = long.where(F.col("words") > 2).select("lang", "f", F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))).alias("phrase")).distinct()
    free = long.join(inner, ["lang", "phrase", "f"], "left_anti")
    cuts = free.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"left": part(F.lit(1), F.col("k")), "right": part(F.col("k") + 1, F.col("words") - F.col("k"))})
    sides = found.select("lang", "phrase", "f")
    cuts = cuts.join(sides.toDF("lang", "left", "l"), ["lang", "left"]).join(sides.toDF("lang", "right", "r"), ["lang", "right"]).join(totals, "lang")
    scored = cuts.withColumn("score", F.expr("(1000 * cast(f as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"))
    weakest = scored.groupBy("lang", "phrase", F.col("f").alias("a"), "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    order = W.partitionBy("lang").orderBy(F.desc("x.score"), F.desc("a"), "phrase")
    best = weakest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "x.l", "x.r", "n", "x.score")


carried(__name__)

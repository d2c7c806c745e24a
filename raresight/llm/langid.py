"""Language identification by cross-parsing against suffix automata of labelled text."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from raresight.llm.common import carried, small_batches

#: Code points of labelled text a language's automaton is built from, and those of all languages together.
SAMPLE, SAMPLE_ALL = 24_000, 400_000
#: Code points a labelled text gives at most, so that a sample holds many texts.
PIECE = 2_000
#: Texts are parsed in pieces of this many code points, all pieces of a batch side by side, and mended where pieces meet.
STEP = 512
#: Pieces parsed at once, and code points of a text taken at once.
LANES, SLICE = 4096, 4096 * STEP
#: Most frequent symbols, whose transitions stand in a dense table; those of all others are looked up in a sorted one.
DENSE = 62
UNKNOWN = "und"
SCHEMA = "lang_pred string, score double"


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts exactly the substrings of ``codes``; state 0 starts."""
    goes, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(goes)
        goes.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in goes[at]:
            goes[at][c] = new
            at = link[at]
        if at >= 0:
            to = goes[at][c]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                copy = len(goes)
                goes.append(dict(goes[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and goes[at].get(c) == to:
                    goes[at][c] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return goes


class Parser:
    """Cross-parsing tables of all languages.

    A cell of ``table`` holds ``next_state_row * 4 + ended``: where the symbol doesn't
    go on, the phrase has ended and the next one starts with the symbol. Columns are
    the ``DENSE`` most frequent symbols of all samples; every other symbol of a
    sample has its transitions in ``edges`` (row and symbol, sorted) and ``to``.
    """

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        found, counts = np.unique(np.concatenate([_points(samples[x]) for x in self.langs] or [np.zeros(0, np.int64)]), return_counts=True)
        n = min(DENSE, len(found))
        self.width = n + 2  # 0: in no sample, last: padding
        rank = np.empty(len(found), np.int32)
        rank[np.lexsort((found, -counts))] = np.arange(len(found))
        # symbols beyond the dense ones are numbered on after the padding
        self.known, self.code = found, np.where(rank < n, rank + 1, rank + 2).astype(np.int32)
        self.kinds = len(found) + 2
        tables, roots, self.norm, base, edges = [], [], [], 0, []
        for lang in self.langs:
            codes = self.symbols(samples[lang])
            goes = suffix_automaton(codes.tolist())
            cells = np.full((len(goes), self.width), -1, np.int64)
            for state, by in enumerate(goes):
                for c, to in by.items():
                    if c < self.width:
                        cells[state, c] = to
                    else:
                        edges.append(((state + base) * self.width * self.kinds + c, (to + base) * self.width))
            start = np.where(cells[0] >= 0, cells[0], 0)
            rows = np.where(cells >= 0, cells, start[None, :])
            # a symbol that starts no phrase is one by itself, beside the one it ends
            ended = (cells < 0) * (1 + ((cells[0] < 0)[None, :] & (np.arange(len(goes)) > 0)[:, None]))
            out = (rows + base) * self.width * 4 + ended
            out[:, -1] = (np.arange(len(goes)) + base) * self.width * 4
            tables.append(out.astype(np.int32).ravel())
            roots.append(base * self.width)
            self.norm.append(np.log2(max(2, len(codes))))
            base += len(goes)
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.roots = np.array(roots, np.int32)[:, None]
        edges.sort()
        self.edges, self.to = np.array([e for e, _ in edges], np.int64), np.array([t for _, t in edges], np.int32)

    def symbols(self, text: str) -> np.ndarray:
        points = _points(text)
        if not len(self.known):
            return np.zeros(len(points), np.int32)
        at = np.minimum(np.searchsorted(self.known, points), len(self.known) - 1)
        return np.where(self.known[at] == points, self.code[at], np.int32(0))

    def phrases(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): phrases of the longest matches that make up each whole text."""
        out = np.zeros((len(texts), len(self.langs)))
        if not self.langs:
            return out
        pieces, owner, held = [], [], 0
        entry: np.ndarray | None = None  # where the text cut by the last flush stands
        for i, text in enumerate(texts):
            for lo in range(0, len(text), SLICE):
                codes = self.symbols(text[lo : lo + SLICE])
                fill = np.full(-len(codes) % STEP, self.width - 1, np.int32)
                pieces.append(np.concatenate((codes, fill)).reshape(-1, STEP))
                owner.append(np.full(len(pieces[-1]), i))
                held += len(pieces[-1])
                if held >= LANES:
                    entry = self._parse(np.concatenate(pieces), np.concatenate(owner), entry, out)
                    if lo + SLICE >= len(text):
                        out[i] += entry != self.roots[:, 0]  # the phrase the text breaks off
                        entry = None
                    pieces, owner, held = [], [], 0
        if held:
            last = self._parse(np.concatenate(pieces), np.concatenate(owner), entry, out)
            out[owner[-1][0]] += last != self.roots[:, 0]
        return out

    def _advance(self, state: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and ended phrases of (languages, lanes) on one symbol a lane."""
        rare = np.flatnonzero(column >= self.width)
        if not len(rare):
            cell = self.table.take(state + column)
            return cell >> 2, cell & 3
        cell = self.table.take(state + np.where(column < self.width, column, 0))
        after, ended = cell >> 2, cell & 3
        symbol, here = column[rare].astype(np.int64), state[:, rare]
        on, to = self._edge(here, symbol)
        first, start = self._edge(np.broadcast_to(self.roots, here.shape), symbol)
        after[:, rare] = np.where(on, to, np.where(first, start, self.roots))
        ended[:, rare] = ~on * (1 + (~first & (here != self.roots)))
        return after, ended

    def _edge(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = state.astype(np.int64) * self.kinds + symbol
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return self.edges[at] == key, self.to[at]

    def _walk(self, state: int, root: int, symbols: list[int]) -> tuple[int, int]:
        """State and ended phrases of one language after ``symbols``."""
        table, edges, to, ended = memoryview(self.table), memoryview(self.edges), memoryview(self.to), 0

        def edge(state: int, c: int) -> int:
            at = bisect_left(edges, state * self.kinds + c)
            return to[at] if at < len(edges) and edges[at] == state * self.kinds + c else -1

        for c in symbols:
            if c < self.width:
                cell = table[state + c]
                state, ended = cell >> 2, ended + (cell & 3)
                continue
            after = edge(state, c)
            if after < 0:
                after = edge(root, c)
                ended += 1 + (after < 0 and state != root)
            state = after if after >= 0 else root
        return state, ended

    def _parse(self, grid: np.ndarray, owner: np.ndarray, entry: np.ndarray | None, out: np.ndarray) -> np.ndarray:
        """Add the phrases of texts cut into pieces; gives the state after the last piece.

        All pieces are parsed from the start state at once. A piece that goes on with a
        text is then parsed again from the state before it, until both ways stand in
        the same state, from where they agree. Where they don't meet in a piece, as in
        periodic texts, the pieces after it are walked one by one, each once. Ends of
        all texts but the last are counted.
        """
        columns = np.ascontiguousarray(grid.T)
        state = np.repeat(self.roots, columns.shape[1], axis=1)
        ended = np.zeros(state.shape, np.int32)
        for column in columns:
            state, more = self._advance(state, column)
            ended += more
        count = ended.copy()
        follows = np.concatenate(([entry is not None], owner[1:] == owner[:-1]))
        asked = np.repeat(self.roots, len(owner), axis=1)
        asked[:, 1:] = np.where(follows[1:], state[:, :-1], self.roots)
        if entry is not None:
            asked[:, 0] = entry
        todo = np.flatnonzero((asked != self.roots).any(axis=0))
        true, guess, after = asked[:, todo], np.repeat(self.roots, len(todo), axis=1), state.copy()
        for column in columns:
            apart = np.flatnonzero((true != guess).any(axis=0))
            if len(apart) < len(todo):
                todo, true, guess = todo[apart], true[:, apart], guess[:, apart]
            if not len(todo):
                break
            true, more = self._advance(true, column[todo])
            guess, less = self._advance(guess, column[todo])
            count[:, todo] += more - less
        else:
            after[:, todo] = true
        state = after
        stale = follows[1:] & (state[:, :-1] != asked[:, 1:]).any(axis=0)
        for k in range(1 + int(stale.argmax()), len(owner)) if stale.any() else ():
            for x in np.flatnonzero(state[:, k - 1] != asked[:, k]).tolist() if follows[k] else ():
                state[x, k], count[x, k] = self._walk(int(state[x, k - 1]), int(self.roots[x, 0]), grid[k].tolist())
        closing = np.flatnonzero(owner[1:] != owner[:-1])
        count[:, closing] += state[:, closing] != self.roots
        np.add.at(out, owner, count.T)
        return state[:, -1]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language of fewest normalised phrases; the score is its share of the inverse counts."""
        usable = [bool(self.langs) and t is not None and any(map(str.isalpha, t)) for t in texts]
        cost = self.phrases([t if ok else "" for t, ok in zip(texts, usable)]) * np.array(self.norm)
        share = 1 / np.maximum(cost, 1e-9)
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
        best = cost.argmin(axis=1) if self.langs else np.zeros(len(texts), int)
        names = [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, usable)]
        return names, np.array([share[i, b] if ok else 0.0 for i, (b, ok) in enumerate(zip(best, usable))])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", seed: int = 3) -> Parser:
    """Automata of a bounded sample: ``SAMPLE`` code points a language, ``SAMPLE_ALL`` together.

    The texts of a language are drawn in the order of a seeded hash of their
    content, ``PIECE`` code points of each at most. Null languages and texts give
    nothing. The sample bounds the fit alone; texts to predict are parsed whole.
    """
    rows = labelled.where(F.col(lang).isNotNull() & (F.length(F.col(text)) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    cells = rows.withColumn("h", F.xxhash64("text", F.lit(seed)))
    found = {r[0]: r[1] for r in cells.groupBy("lang").agg(F.approx_count_distinct("h")).collect()}
    each = max(1_000, min(SAMPLE, SAMPLE_ALL // max(1, len(found))))
    wanted = -(-each // PIECE) * 8
    share = F.create_map(*[F.lit(x) for lang, n in found.items() for x in (lang, min(1.0, 2 * wanted / max(1, n)))]) if found else None
    few = cells.where(F.shiftrightunsigned("h", 11) * 2.0**-53 <= F.element_at(share, F.col("lang"))) if found else cells.limit(0)
    top = few.groupBy("lang", "h").agg(F.min(F.substring("text", 1, PIECE)).alias("text"))
    samples: dict[str, str] = {}
    for name, _, piece in sorted(map(tuple, top.select("lang", "h", "text").collect())):
        if len(samples.setdefault(name, "")) < each:
            samples[name] += (" " if samples[name] else "") + piece
    return Parser({k: v[:each] for k, v in samples.items()})


def identify(spark: SparkSession, parser: Parser, text: Column) -> Column:
    """struct(lang_pred, score) of each whole text; ``und`` and 0 for null, letterless or untrained ones.

    A very long text is parsed in slices of bounded memory, with the phrase counts of
    the whole text. Equal texts get equal answers; no column is added but the struct.
    """
    small_batches(spark)
    shared = spark.sparkContext.broadcast(parser)

    def each(texts: pd.Series) -> pd.DataFrame:
        names, scores = shared.value.predict([None if t is None else t for t in texts])
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return F.pandas_udf(each, SCHEMA)(text)


def held_out(key: Column) -> Column:
    """Rows whose labels are not learned from: crc32 of the key as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


carried(__name__)

"""Periodic runs of words: harmonic-grid candidates, extended by queries to a run-length grammar.

A run of period q and at least four periods is a stretch in which 3 q
consecutive words or more equal the word q further on, so it holds three
neighbouring multiples of q whose words equal those q further on. Comparing all
multiples of q for each q up to a quarter of a text costs n / 1 + n / 2 + ...
steps. Where three neighbours in a row agree, two longest common extensions,
one to each side, give the exact stretch.

Extensions are answered by a grammar made by recompression: in turn, blocks of
one repeated symbol and pairs of a left and a right symbol become symbols, the
same for the same content, until little is left. Equal passages get equal
symbols but for their ends, so a query climbs while its two places are at the
starts of symbols, moving over a rest of a block or half a pair where they are
not, and descends into the symbols that differ. Many texts share one grammar,
kept apart by a symbol of their own; all queries climb together as arrays.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.base import table

REPEATS = 4
LEAST = 6
#: Words of the texts that share a grammar; a longer text has one of its own.
CHUNK_WORDS = 1 << 16
#: Candidates that are extended at a time.
CANDIDATES = 1 << 18


class Grammar:
    """The levels of a run-length grammar over a sequence whose last symbol occurs once.

    `symbols[t]` is level t, `parent[t]` the place of each of its symbols in
    level t + 1, `first[t]` the place in level t where each symbol of level t + 1
    begins, with the length of level t at the end, and `blocks[t]` whether level
    t + 1 has blocks (or else pairs) as symbols.
    """

    def __init__(self, symbols: np.ndarray, enough: int = 8):
        self.symbols, self.parent, self.first, self.blocks = [symbols], [], [], []
        self.names = int(symbols.max(initial=-1)) + 1
        turn, idle = 0, 0
        while len(self.symbols[-1]) > enough and idle < 8:
            before = len(self.symbols[-1])
            self._blocks()
            self._pairs(turn)
            turn += 1
            idle = 0 if len(self.symbols[-1]) < before else idle + 1

    def _blocks(self) -> None:
        level = self.symbols[-1]
        first = np.concatenate(([0], np.flatnonzero(level[1:] != level[:-1]) + 1, [len(level)]))
        lengths = np.diff(first)
        if len(lengths) < len(level):
            self._add(first, lengths > 1, lengths, True)

    def _pairs(self, turn: int) -> None:
        level = self.symbols[-1]
        mixed = (level.astype(np.uint64) + np.uint64(turn * 2 + 1)) * np.uint64(0x9E3779B97F4A7C15)
        left = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63) == 1
        joined = left[:-1] & ~left[1:]
        if joined.any():
            first = np.append(np.flatnonzero(~np.concatenate(([False], joined))), len(level))
            pair = np.diff(first) > 1
            self._add(first, pair, level[first[1:] - 1], False)

    def _add(self, first: np.ndarray, renamed: np.ndarray, second: np.ndarray, blocks: bool) -> None:
        """A level of the symbols that begin at `first`; those `renamed` are named by their first symbol and `second`."""
        level = self.symbols[-1]
        above = level[first[:-1]]
        rules, names = np.unique(above[renamed] << 32 | second[renamed], return_inverse=True)
        above[renamed] = self.names + names
        self.names += len(rules)
        parent = np.repeat(np.arange(len(above)), np.diff(first))
        self.symbols.append(above)
        self.parent.append(parent)
        self.first.append(first)
        self.blocks.append(blocks)

    def mirrored(self) -> Grammar:
        """The same grammar read from right to left."""
        other = Grammar.__new__(Grammar)
        other.symbols = [s[::-1] for s in self.symbols]
        other.parent = [(len(above) - 1 - p)[::-1] for p, above in zip(self.parent, self.symbols[1:])]
        other.first = [(f[-1] - f)[::-1] for f in self.first]
        other.blocks, other.names = self.blocks, self.names
        return other

    def extensions(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from place `a` on equal those from place `b` on, a < b, for each pair."""
        start, a, b = a, a.copy(), b.copy()
        top = len(self.parent)
        stopped = np.full(len(a), top)
        climbing = np.arange(len(a))
        for t in range(top):
            level, parent, first = self.symbols[t], self.parent[t], self.first[t]
            x, y = a[climbing], b[climbing]
            held = (first[parent[x]] != x) | (first[parent[y]] != y)
            over = np.flatnonzero(held)
            if len(over):
                u, v = x[over], y[over]
                same = level[u] == level[v]
                if self.blocks[t]:
                    # The rest of the two blocks; if one is longer, they differ after the shorter.
                    m, n = first[parent[u] + 1] - u, first[parent[v] + 1] - v
                    step = np.where(same, np.minimum(m, n), 0)
                    going = same & (m == n)
                else:
                    # A right symbol: after it, both are at a start.
                    step = same.astype(np.int64)
                    going = same
                x[over] += step
                y[over] += step
                ended = climbing[over[~going]]
                a[ended], b[ended], stopped[ended] = x[over[~going]], y[over[~going]], t
                rest = np.ones(len(climbing), bool)
                rest[over[~going]] = False
                climbing, x, y = climbing[rest], x[rest], y[rest]
            a[climbing], b[climbing] = parent[x], parent[y]
            if not len(climbing):
                break
        level = self.symbols[top]
        while len(climbing):
            climbing = climbing[level[a[climbing]] == level[b[climbing]]]
            a[climbing] += 1
            b[climbing] += 1
        order = np.argsort(-stopped, kind="stable")
        bounds = np.searchsorted(-stopped[order], -np.arange(top), "left")
        for t in range(int(stopped.max(initial=0)) - 1, -1, -1):
            falling = order[: bounds[t]]
            level, first = self.symbols[t], self.first[t]
            u, v = a[falling], b[falling]
            x, y = first[u], first[v]
            step = (level[x] == level[y]).astype(np.int64)
            if self.blocks[t]:
                step *= np.minimum(first[u + 1] - x, first[v + 1] - y)
            a[falling], b[falling] = x + step, y + step
        return a - start


class _Chunk:
    """Some texts as one array of word numbers, the longest first."""

    def __init__(self, texts: list[list[bytes]]):
        numbers: dict[bytes, int] = {}
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.order = np.argsort(-self.sizes, kind="stable")
        self.sizes = self.sizes[self.order]
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.words = np.empty(int(self.starts[-1]), np.int64)
        for k, place in enumerate(self.order):
            named = (numbers.setdefault(w, len(numbers)) for w in texts[place])
            self.words[self.starts[k] : self.starts[k + 1]] = np.fromiter(named, np.int64, len(texts[place]))
        self.owner = np.repeat(np.arange(len(texts)), self.sizes)
        self.vocabulary = len(numbers)
        self.grammar: tuple[Grammar, Grammar, np.ndarray] | None = None

    def candidates(self, repeats: int) -> Iterator[tuple[np.ndarray, int]]:
        """(places, q): multiples of q from which repeats - 1 neighbours in a row have words that recur after q."""
        longest = int(self.sizes[0]) if len(self.sizes) else 0
        for q in range(1, longest // repeats + 1):
            until = self.starts[np.searchsorted(-self.sizes, -repeats * q, "right")]
            points = self.words[:until:q]
            equal = points[1:] == points[:-1]
            held = equal[: len(equal) - repeats + 2]
            for k in range(1, repeats - 1):
                held = held & equal[k : k + len(held)]
            places = np.flatnonzero(held) * q
            if len(places):
                places = places[self.owner[places] == self.owner[places + (repeats - 1) * q]]
                if len(places):
                    yield places, q

    def compressed(self, members: np.ndarray) -> tuple[Grammar, Grammar, np.ndarray]:
        """The grammar of some of the texts, its mirror image and how far each text is moved in it."""
        marks = self.vocabulary + np.arange(len(members) + 1)
        parts, moved, at = [marks[:1]], np.zeros(len(self.sizes), np.int64), 1
        for k, member in enumerate(members):
            parts += [self.words[self.starts[member] : self.starts[member + 1]], marks[k + 1 : k + 2]]
            moved[member] = at - self.starts[member]
            at += int(self.sizes[member]) + 1
        grammar = Grammar(np.concatenate(parts))
        return grammar, grammar.mirrored(), moved

    def extended(self, places: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the stretch of period q that holds each place and the one q further on."""
        forward, backward, moved = self.grammar
        here = places + moved[self.owner[places]]
        last = len(forward.symbols[0]) - 1
        after = forward.extensions(here, here + q)
        before = backward.extensions(last - (here + q) + 1, last - here + 1)
        return places - before, places + q + after

    def runs(self, repeats: int, least: int) -> np.ndarray:
        """(start, end, period) of all runs, in places of the chunk."""
        found = [np.zeros((0, 3), np.int64)]
        # The least period and the end of a run over each place.
        period, end = np.zeros(len(self.words), np.int64), np.zeros(len(self.words), np.int64)
        pending: list[tuple[np.ndarray, int]] = []

        def extend(everything: bool) -> None:
            places = np.concatenate([p for p, _ in pending])
            q = np.repeat([q for _, q in pending], [len(p) for p, _ in pending])
            pending.clear()
            # Inside a run whose period divides q the stretch is that run.
            new = ~((period[places] > 0) & (q % np.maximum(period[places], 1) == 0) & (places + q < end[places]))
            places, q = places[new], q[new]
            if not len(places):
                return
            if self.grammar is None:
                members = np.arange(len(self.sizes)) if everything else np.unique(self.owner[places])
                self.grammar = self.compressed(members)
            for low in range(0, len(places), CANDIDATES):
                q_low = q[low : low + CANDIDATES]
                start, stop = self.extended(places[low : low + CANDIDATES], q_low)
                long = stop - start >= np.maximum(least, repeats * q_low)
                rows = np.unique(np.stack([start[long], stop[long], q_low[long]], 1), axis=0)
                found.append(rows)
                for s, e, p in rows:
                    free = slice(s, e) if not period[s:e].any() else s + np.flatnonzero(period[s:e] == 0)
                    period[free], end[free] = p, e

        held = 0
        for places, q in self.candidates(repeats):
            pending.append((places, q))
            held += len(places)
            if held >= CANDIDATES:
                extend(True)
                held = 0
        if pending:
            extend(False)
        every = np.concatenate(found)
        every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
        # The same stretch with a multiple of its period is no run.
        first = np.ones(len(every), bool)
        first[1:] = (every[1:, :2] != every[:-1, :2]).any(1)
        return every[first]


def runs_of(texts: list[list[bytes]], repeats: int = REPEATS, least: int = LEAST) -> list[np.ndarray]:
    """(start, length, period) of every run of each text, by start, then period."""
    chunk = _Chunk(texts)
    found = chunk.runs(repeats, least)
    owner = chunk.owner[found[:, 0]]
    result: list[np.ndarray] = [np.zeros((0, 3), np.int64)] * len(texts)
    order = np.argsort(owner, kind="stable")
    edges = np.searchsorted(owner[order], np.arange(len(texts) + 1))
    for k, place in enumerate(chunk.order):
        own = found[order[edges[k] : edges[k + 1]]]
        if len(own):
            rows = np.stack([own[:, 0] - chunk.starts[k], own[:, 1] - own[:, 0], own[:, 2]], 1)
            result[place] = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return result


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run holds after its first period, joined by a space."""
    if not len(runs):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(compress(words, (np.cumsum(edges[:-1]) == 0).tolist()))


def periodic_runs(
    docs: DataFrame, repeats: int = REPEATS, least: int = LEAST, key: str = "doc_id", text: str = "text",
    change: Callable[[list[bytes], object], list[bytes]] | None = None, chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """One row per row of `docs`: key, n_words, runs (start, length, period; by start, then period) and text without them.

    A run is a stretch of words with least period q, of `repeats` (3 or more)
    periods and `least` words or more, that no word before or after continues.
    `change` may alter the words of a row, given its key, before they are
    searched. Null, empty and blank texts have no words and no runs. Overlapping
    runs of different periods are all listed. Repeated rows come out as often as
    they went in; other columns are not read; an empty table gives an empty
    result. A text is held whole, at about 150 bytes a word.
    """
    if repeats < 3:
        raise ValueError("the grid finds runs of three periods or more")

    def found(keys: list[pa.Scalar], texts: list[list[bytes]], kind: pa.DataType) -> pa.RecordBatch:
        runs = runs_of(texts, repeats, least)
        rows = np.concatenate([np.zeros((0, 3), np.int64), *runs])
        fields = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], ["start", "length", "period"])
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32)
        kept = pa.array([collapsed(w, r) for w, r in zip(texts, runs)], pa.string())
        sizes = pa.array([len(t) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, kind), sizes, pa.ListArray.from_arrays(pa.array(offsets), fields), kept], ["key", "n_words", "runs", "kept"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = batch.columns
            held: list[list[bytes]] = []
            low = total = 0
            for row in range(batch.num_rows):
                words = values[row].as_buffer().to_pybytes().split() if values[row].is_valid else []
                held.append(change(words, keys[row].as_py()) if change else words)
                total += len(words)
                if total >= chunk_words or row + 1 == batch.num_rows:
                    yield found(keys[low : row + 1].to_pylist(), held, keys.type)
                    held, low, total = [], row + 1, 0

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    made = rows.mapInArrow(run, f"key {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, kept string")
    return made.select(F.col("key").alias(key), "n_words", "runs", F.col("kept").alias("collapsed"))


def looped(words: list[bytes], key: int | None) -> list[bytes]:
    """The words of every tenth document, by the CRC-32 of its id, with a stretch repeated up to the end."""
    h = zlib.crc32(str(key).encode()) if key is not None else 0
    g, n = h // 10, len(words)
    if key is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    once = words[a : a + p]
    return words[:a] + (once * ((n - a) // p + 1))[: n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), change=looped)
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    best = found.select("doc_id", "runs", "collapsed", longest.alias("best"), lines.alias("lines"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op12_periodic_runs": op12_periodic_runs}

"""Runs of repeated words in a text, found by recompression.

A batch of texts is one array of symbols, with symbols of their own between the texts. Blocks of a repeated symbol and
pairs of neighbours are compressed in turn, until no symbol occurs twice: a run-length grammar in which equal stretches
are parsed alike but for their edges. How far two places agree is then told by few steps up and down its levels.

A run of period q and length of at least max(LEAST, 2 q) has two places q apart on a grid of step max(q, LEAST - q).
Over all q these grids are a harmonic sum; the places that hold equal words are extended by the grammar, both ways, to
the exact run. A run is then told by its start and end, and the smallest period found for them is its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import owned, quoted, release, small_batches
from .rolling import mix

#: Words of the shortest run; words that are searched together; candidates that are extended together.
LEAST, TOGETHER, CANDIDATES = 12, 1 << 19, 1 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


@dataclass
class Level:
    """symbols, and the way to the level above: the parent of each, and of each parent the first and last child.

    ahead and behind: how many symbols from here on are equal, where the next step compresses blocks.
    """

    symbols: np.ndarray
    parent: np.ndarray | None = None
    first: np.ndarray | None = None
    last: np.ndarray | None = None
    ahead: np.ndarray | None = None
    behind: np.ndarray | None = None


def closed(level: Level, starts: np.ndarray, blocks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Join the level's symbols from each start to the next; gives first children and counts."""
    m = len(level.symbols)
    level.first = np.flatnonzero(starts)
    level.last = np.append(level.first[1:], m) - 1
    level.parent = np.cumsum(starts) - 1
    if blocks:
        at = np.arange(m)
        level.ahead, level.behind = level.last[level.parent] - at + 1, at - level.first[level.parent] + 1
    return level.first, level.last - level.first + 1


def named(symbols: np.ndarray, chosen: np.ndarray, other: np.ndarray, following: int) -> tuple[np.ndarray, int]:
    """A new symbol for each different pair (symbol, other) of the chosen ones; the rest stay as they are."""
    out = symbols.copy()
    pairs = symbols[chosen] * (int(other.max()) + 1) + other
    kinds, which = np.unique(pairs, return_inverse=True)
    out[chosen] = following + which
    return out, following + len(kinds)


def grammar(symbols: np.ndarray) -> list[Level]:
    """Levels of the grammar, from the symbols (from 0 on, dense) to a level where each occurs once."""
    levels, following = [Level(symbols)], int(symbols.max()) + 1
    for k in range(10_000):
        now = levels[-1]
        if len(now.symbols) < 2 or np.bincount(now.symbols).max() < 2:
            return levels
        differs = np.append(True, now.symbols[1:] != now.symbols[:-1])
        if not differs.all():
            first, count = closed(now, differs, True)
            chosen = np.flatnonzero(count > 1)
            above, following = named(now.symbols[first], chosen, count[chosen], following)
            levels.append(now := Level(above))
        # each symbol is a left or a right one; of both ways to pair them the one with more pairs is taken
        left = (mix(now.symbols.astype(np.uint64) + np.uint64(k << 40)) & np.uint64(1)).astype(bool)
        one, two = left[:-1] & ~left[1:], ~left[:-1] & left[1:]
        heads = one if one.sum() >= two.sum() else two
        if heads.any():
            first, count = closed(now, np.append(True, ~heads), False)
            chosen = np.flatnonzero(count > 1)
            above, following = named(now.symbols[first], chosen, now.symbols[now.last[chosen]], following)
            levels.append(Level(above))
    raise RuntimeError("the grammar does not shrink")


def agreement(levels: list[Level], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many symbols from a and b on are equal, forwards or back; the outermost symbols must occur once.

    Up: equal symbols are passed until both places begin a symbol of the level above. Down: from the first difference
    on, symbols that are still equal are passed at each level below.
    """
    x, y, way = a.copy(), b.copy(), -1 if back else 1
    met: list[np.ndarray] = []
    going = np.arange(len(a))

    def passed(level: Level, who: np.ndarray) -> None:
        run = level.behind if back else level.ahead
        step = 1 if run is None else np.minimum(run[x[who]], run[y[who]])
        x[who] += way * step
        y[who] += way * step

    for level in levels:
        edge = level.last if back else level.first
        differ, climb = [], []
        while len(going):
            equal = level.symbols[x[going]] == level.symbols[y[going]]
            differ.append(going[~equal])
            going = going[equal]
            if edge is not None:
                p, q = level.parent[x[going]], level.parent[y[going]]
                aligned = (edge[p] == x[going]) & (edge[q] == y[going])
                up = going[aligned]
                x[up], y[up] = p[aligned], q[aligned]
                climb.append(up)
                going = going[~aligned]
            passed(level, going)
        met.append(np.concatenate(differ) if differ else going)
        going = np.concatenate(climb) if climb else going
    falling = met[-1]
    for level, differ in zip(levels[-2::-1], met[-2::-1]):
        edge = level.last if back else level.first
        x[falling], y[falling] = edge[x[falling]], edge[y[falling]]
        moving = falling
        while len(moving):
            moving = moving[level.symbols[x[moving]] == level.symbols[y[moving]]]
            passed(level, moving)
        falling = np.concatenate([falling, differ])
    return np.abs(x - a)


def exact_runs(levels: list[Level], at: np.ndarray, period: np.ndarray, least: int) -> np.ndarray:
    """start, end and period of the runs around candidates, each once; stretches that are too short go."""
    ahead = agreement(levels, at, at + period)
    behind = agreement(levels, at - 1, at + period - 1, back=True)
    long = ahead + behind >= np.maximum(period, least - period)
    start, period = (at - behind)[long], period[long]
    return np.unique(np.stack([start, start + (ahead + behind)[long] + period, period], 1), axis=0)


def flat_runs(symbols: np.ndarray, ends: np.ndarray, lengths: np.ndarray, least: int) -> np.ndarray:
    """start, end, period of all runs, in order. ends: where each text ends; texts come by falling length."""
    if len(lengths) == 0 or lengths[0] < least:
        return np.zeros((0, 3), np.int64)
    levels, found, places, periods, held = grammar(symbols), [], [], [], 0
    for q in range(1, int(lengths[0]) // 2 + 1):
        # texts of at least max(least, 2 q) words come first
        end = ends[np.searchsorted(-lengths, -max(least, 2 * q), side="right") - 1]
        step = max(q, least - q)
        hit = np.flatnonzero(symbols[step : end - q : step] == symbols[step + q : end : step])
        if len(hit):
            places.append((hit + 1) * step)
            periods.append(np.full(len(hit), q))
            held += len(hit)
        if held >= CANDIDATES:
            found.append(exact_runs(levels, np.concatenate(places), np.concatenate(periods), least))
            places, periods, held = [], [], 0
    if held:
        found.append(exact_runs(levels, np.concatenate(places), np.concatenate(periods), least))
    if not found:
        return np.zeros((0, 3), np.int64)
    runs = np.unique(np.concatenate(found), axis=0)
    # the smallest period of a stretch comes first
    return runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(1))[: len(runs)]]


def word_runs(texts: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """start, length, period of each text's runs, by start and period; texts are lists of words."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    known: dict[bytes, int] = {}
    total = sum(map(len, texts))
    symbols, ends, at = np.empty(total + len(texts) + 1, np.int64), np.empty(len(texts), np.int64), 1
    for place, k in enumerate(order):
        n = len(texts[k])
        symbols[at : at + n] = np.fromiter((known.setdefault(w, len(known)) for w in texts[k]), np.int64, n)
        ends[place] = at + n
        at += n + 1
    between = np.append(0, ends)
    symbols[between] = len(known) + np.arange(len(between))
    lengths = np.array([len(texts[k]) for k in order], np.int64)
    runs = flat_runs(symbols, ends, lengths, least)
    begins = ends - lengths
    owner = np.searchsorted(begins, runs[:, 0], side="right") - 1
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    for place, k in enumerate(order):
        own = runs[cuts[place] : cuts[place + 1]]
        if len(own):
            own = np.stack([own[:, 0] - begins[place], own[:, 1] - own[:, 0], own[:, 2]], 1)
            out[k] = own[np.lexsort((own[:, 2], own[:, 0]))]
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by spaces, less those behind the first period of a run."""
    if not len(runs):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    stay = np.cumsum(edges)[:-1] == 0
    return b" ".join([words[k] for k in np.flatnonzero(stay)])


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """docs with n_words, runs (start, length, period: word numbers from 0) and collapsed, the text less repetitions.

    Words stand between ASCII white space. A run is a longest stretch of consecutive words in which words `period`
    apart are equal, for its smallest period, of at least max(least, 2 * period) words. In collapsed each run keeps
    its first period, and words are joined by single spaces. Runs come by start, then period. A null or blank text has
    no words, no runs and an empty collapsed text. Rows are treated one by one, repeated ones alike; columns of the
    three names are replaced, others pass through, whatever their names. An empty table stays empty.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def found(texts: pa.Array) -> pa.Array:
        release()
        counts, offsets, flat, left = [], [0], [], []
        waiting: list[list[bytes]] = []

        def search() -> None:
            for words, runs in zip(waiting, word_runs(waiting, least)):
                counts.append(len(words))
                offsets.append(offsets[-1] + len(runs))
                flat.append(runs)
                left.append(collapsed(words, runs))
            waiting.clear()

        size = 0
        for value in texts:
            waiting.append(value.as_buffer().to_pybytes().split() if value.is_valid else [])
            size += len(waiting[-1])
            if size >= TOGETHER:
                search()
                size = 0
        search()
        rows = np.concatenate([np.zeros((0, 3), np.int64), *flat])
        runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], names=["start", "length", "period"])).cast(kind)
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), runs, pa.array(left, pa.binary()).cast(pa.string())], names=["n_words", "runs", "collapsed"])

    names, own = owned(small_batches(docs), ("n_words", "runs", "collapsed"), text)
    # declared nondeterministic so that a later filter doesn't make the optimizer evaluate it twice
    search = F.arrow_udf(found, f"n_words bigint, runs {RUNS}, collapsed string").asNondeterministic()
    body: Column = F.col(quoted(text))
    return docs.select(own, body.alias("body")).withColumn("found", search("body")).select(*names, "found.*")

"""Strings that stand anywhere else in the corpus, found over an enhanced suffix array and cut out.

Texts are read as symbols: their bytes, or their words (64 bits of each). A window of LENGTH symbols is repeated
if it also starts elsewhere, in the same document or another. Every window names an anchor, the smallest rolling
hash of GRAM symbols in it (the rightmost of equal ones), so equal windows name equal anchors at equal offsets.
Windows of one document with one anchor form a run; the symbols that its windows cover are its surroundings.

1. Only anchors that stand in two places matter. Runs with the same surroundings are one kind, with a count.
2. The surroundings of one run of each kind are gathered by anchor. The suffixes that start at the anchors are
   sorted (a kind that stands twice or more has two equal ones), neighbours' common prefixes give the enhanced
   suffix array, and a stack scan lists the intervals of its common-prefix tree.
3. The occurrences of an interval are told apart by what stands to their left: in the order of their reversed left
   sides a second scan lists the sets that agree on so many symbols and differ in the next. A set with such a
   left-extension diversity, which no child of the interval holds alone, is a maximal repeat with all its
   occurrences; those of LENGTH symbols or more are the result, and every covered symbol comes from one of them.
4. Anchors with more kinds than GROUP are first split by offset: an eighth of the offsets, and the symbols that all
   windows at those offsets have in common. Runs that share such a core stay together, the others part, and kinds
   that have become equal are counted as one; in groups that are still large, an eighth of these offsets, and so on.
   So no large group meets in one task.

A repeat is maximal within the surroundings of its anchor: a longer one comes as overlapping repeats, one for each
anchor on its way. Every shuffle is by a key whose groups are counted or bounded; lists are gathered per document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROWS, hot_keys, likely, owned, parted, quoted, salted_join, small_batches, trim, written
from .rolling import Prefix, winnow

#: The window and the gram in bytes, and those of passages in words.
LENGTH, GRAM = 400, 40
PASSAGE, PASSAGE_GRAM = 51, 8
#: Kinds of one anchor that are sorted in one task, and parts that the offsets of larger groups are split into.
GROUP, SPLIT = 128, 8
#: Windows of a document that are hashed at a time, bytes of small documents that are, and bytes of a very long word.
SLICE, TOGETHER, LONG_WORD = 1 << 19, 1 << 18, 1 << 16
#: Fixed value: the white space of ASCII.
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))

RUN = "h long, c long, pos long, left int, right int"
SHAPE = ["h", "c", "left", "right"]
KIND = ["h", "kind", "low", "high", "left", "copies", "data"]
KIND_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
KIND_SHAPE = "h long, kind long, low int, high int, left int, copies long, data binary"


def text_key(text: Column) -> list[Column]:
    """128 bits that tell texts apart, as ka and kb."""
    return [F.xxhash64(text).alias("ka"), F.xxhash64(text, F.lit(1)).alias("kb")]


def word_edges(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text's bytes start and end; white space of ASCII parts them."""
    inside = np.concatenate([[False], ~SPACE[raw], [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[::2], turns[1::2]


def word_hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64 bits of each word, from rolling hashes of SLICE bytes at a time; of a very long word from its bytes as a whole."""
    from xxhash import xxh3_64_intdigest

    out = np.zeros(len(start), np.uint64)
    edges = np.searchsorted(start, np.arange(0, len(raw) + SLICE, SLICE))
    for low, a, b in zip(range(0, len(raw), SLICE), edges, edges[1:]):
        short = np.flatnonzero(stop[a:b] - start[a:b] <= LONG_WORD) + a
        if len(short):
            out[short] = Prefix(raw[low : stop[short[-1]]]).ranges(start[short] - low, stop[short] - low)
    for k in np.flatnonzero(stop - start > LONG_WORD):
        out[k] = xxh3_64_intdigest(raw[start[k] : stop[k]].tobytes())
    return out


def symbols(raw: bytes, words: bool) -> np.ndarray:
    """A text's bytes, or 64 bits of each of its words."""
    values = np.frombuffer(raw, np.uint8)
    return word_hashes(values, *word_edges(values)) if words else values


def packed(values: np.ndarray) -> bytes:
    """Symbols as bytes, most significant first, so that bytes compare as symbols do."""
    return values.tobytes() if values.dtype == np.uint8 else values.astype(">u8").tobytes()


def runs_in(flat: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For texts that stand one after the other in flat, up to `ends`, per run: its text, and the columns of RUN.

    These are the anchor's hash, the hash of the surroundings, the anchor's position, the symbols before it, and the
    windows in the run less one. The windows of a run start at `left` symbols before the anchor.
    """
    if len(flat) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32))
    prefix = Prefix(flat)
    grams = prefix.windows(gram)
    anchor = winnow(grams, length - gram + 1)
    size = np.diff(ends, prepend=0)
    text = np.repeat(np.arange(len(ends)), size)[: len(anchor)]
    start = np.flatnonzero(ends[text] - np.arange(len(anchor)) >= length)
    own = anchor[start]
    first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)]) if len(start) else start
    last = start[np.r_[first[1:], len(start)] - 1] if len(start) else start
    first, at = start[first], own[first]
    text = text[first]
    return text, grams[at].view(np.int64), prefix.ranges(first, last + length).view(np.int64), at - (ends - size)[text], (at - first).astype(np.int32), (last - first).astype(np.int32)


def runs_of(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The columns of RUN for one text, SLICE windows at a time."""
    out = []
    for start in range(0, max(1, len(raw) - length + 1), SLICE):
        part = raw[start : start + SLICE + length - 1]
        _, h, c, pos, left, right = runs_in(part, np.array([len(part)]), length, gram)
        out.append((h, c, pos + start, left, right))
    return tuple(np.concatenate(x) for x in zip(*out))


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def intervals(lcp: list[int]) -> list[tuple[int, int, int]]:
    """(common prefix, first, last) of the intervals of a suffix array, by a scan with a stack. lcp[i]: of suffixes i-1 and i."""
    found, stack = [], [(0, 0)]
    for i in range(1, len(lcp) + 1):
        now, left = lcp[i] if i < len(lcp) else -1, i - 1
        while stack and now < stack[-1][0]:
            height, left = stack.pop()
            found.append((height, left, i - 1))
        if not stack or now > stack[-1][0]:
            stack.append((now, left))
    return found


def common_intervals(kinds: list[tuple[bytes, int, int]], length: int, unit: int):
    """For kinds (surroundings, symbols before the anchor, count) of one anchor, the intervals of its suffix array.

    Each as the symbols from the anchor on that its suffixes share, its suffixes in the order of their reversed left
    sides, what neighbours in that order share to the left, the kind of every suffix, and the array of common prefixes.
    Intervals without LENGTH symbols in common to both sides are left out.
    """
    # two equal suffixes stand for all occurrences of a kind
    entries = [k for k, (_, _, copies) in enumerate(kinds) for _ in range(2 if copies > 1 else 1)]
    right = [data[left * unit :] for data, left, _ in kinds]
    back = [np.frombuffer(data[: left * unit], f"V{unit}")[::-1].tobytes() for data, left, _ in kinds]
    order = sorted(entries, key=right.__getitem__)
    lcp = [0] + [common_prefix(right[a], right[b]) // unit for a, b in zip(order, order[1:])]
    most = max(len(x) for x in back) // unit
    for match, a, b in intervals(lcp):
        if b > a and match + most >= length:
            rows = sorted(range(a, b + 1), key=lambda x: back[order[x]])
            near = [0] + [common_prefix(back[order[x]], back[order[y]]) // unit for x, y in zip(rows, rows[1:])]
            if match + max(near) >= length:
                yield match, rows, near, order, lcp


def maximal_repeats(kinds: list[tuple[bytes, int, int]], length: int, unit: int = 1):
    """The maximal repeats over the anchor of kinds of `length` symbols or more, each as all its occurrences
    (kind, symbols before the anchor, symbols from it on)."""
    for match, rows, near, order, lcp in common_intervals(kinds, length, unit):
        for before, c, d in intervals(near):
            if d == c or match + before < length:
                continue
            # its occurrences have to differ in the symbol to the left, and to the right, where else one child has all of them
            members = rows[c : d + 1]
            if min(near[c + 1 : d + 1]) == before and min(lcp[min(members) + 1 : max(members) + 1]) == match:
                yield [(k, before, match) for k in dict.fromkeys(order[x] for x in members)]


def covers(kinds: list[tuple[bytes, int, int]], length: int, unit: int = 1) -> dict[int, list[tuple[int, int]]]:
    """By kind, the ranges (both ends included, from the anchor) that its maximal repeats cover together.

    In an interval, what a suffix shares most to the left with others, who differ beyond, covers what the larger sets
    around that do. So each suffix is taken once an interval, and no set is listed.
    """
    found: dict[int, dict[int, int]] = {}
    for match, rows, near, order, _ in common_intervals(kinds, length, unit):
        for at, row in enumerate(rows):
            before = max(near[at], near[at + 1] if at + 1 < len(near) else 0)
            if match + before >= length:
                own = found.setdefault(order[row], {})
                own[match] = max(own.get(match, 0), before)
    return {k: merged([(-before, match - 1) for match, before in own.items()]) for k, own in found.items()}


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges with both ends included, joined where they overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def long_enough(text: str, length: int, words: bool) -> Column:
    """Whether a text has bytes enough for a window."""
    return F.octet_length(F.col(quoted(text))) >= (2 * length - 1 if words else length)


def occurrences(docs: DataFrame, text: str, length: int, gram: int, words: bool) -> DataFrame:
    """ka, kb and the runs of every text of at least `length` symbols."""

    def together(raws: list[bytes]) -> tuple[np.ndarray, ...]:
        """The runs of texts that stand in one array, each with the number of its text."""
        data = np.frombuffer(b"\n".join(raws), np.uint8)
        ends = np.cumsum([len(raw) + 1 for raw in raws])
        if words:
            start, stop = word_edges(data)
            return runs_in(word_hashes(data, start, stop), np.searchsorted(start, ends), length, gram)
        return runs_in(np.frombuffer(b"".join(raws), np.uint8), ends - np.arange(1, len(raws) + 1), length, gram)

    def alone(raw: bytes) -> tuple[np.ndarray, ...]:
        columns = runs_of(symbols(raw, words), length, gram)
        return (np.zeros(len(columns[0]), np.int64), *columns)

    def run(batches):
        trim()
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in range(2)]
            size, cuts = 0, [0]
            raws = [x.as_buffer().to_pybytes() for x in batch.column(2)]
            for k, raw in enumerate(raws):
                size += len(raw)
                if size > TOGETHER:
                    cuts, size = [*cuts, k] if k > cuts[-1] else cuts, len(raw)
            for a, b in zip(cuts, [*cuts[1:], len(raws)]):
                text, *columns = alone(raws[a]) if b - a == 1 else together(raws[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(k[a:b][text]) for k in keys] + [pa.array(c) for c in columns], names=names)

    names = ["ka", "kb", "h", "c", "pos", "left", "right"]
    body = F.col(quoted(text))
    long = docs.where(long_enough(text, length, words))
    return long.select(*text_key(body), F.encode(body, "UTF-8").alias("raw")).mapInArrow(run, f"ka long, kb long, {RUN}")


def kinds_with_bytes(docs: DataFrame, text: str, kinds: DataFrame, length: int, words: bool) -> DataFrame:
    """The columns of KIND and n, the kinds of the anchor, of every kind: low and high are the offsets of its windows."""
    run = F.struct("kind", "h", F.col("one.pos").alias("pos"), "left", "right", "copies", "n")
    lists = written(kinds.groupBy(F.col("one.ka").alias("ka"), F.col("one.kb").alias("kb")).agg(F.collect_list(run).alias("runs")), "wanted")
    body = F.col(quoted(text))
    own = docs.where(long_enough(text, length, words)).select(*text_key(body), body.alias("text"))
    # one of the copies of a text is enough; first() drops the others before the shuffle
    one = likely(own, "ka", lists, "ka").groupBy("ka", "kb").agg(F.first("text").alias("text")).join(lists, ["ka", "kb"])

    def cut(batches):
        trim()
        for batch in batches:
            for raw, runs in zip(batch.column(0), batch.column(1).to_pylist()):
                values = symbols(raw.as_buffer().to_pybytes(), words)
                rows = [
                    (r["h"], r["kind"], r["left"] - r["right"], r["left"], r["left"], r["copies"], packed(values[r["pos"] - r["left"] : r["pos"] - r["left"] + r["right"] + length]), r["n"])
                    for r in runs
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [*KIND_TYPES, pa.int64()])], names=[*KIND, "n"])

    return one.select(F.encode("text", "UTF-8").alias("raw"), "runs").mapInArrow(cut, f"{KIND_SHAPE}, n long")


def split_by_offset(rows: DataFrame, width: int, length: int, unit: int) -> DataFrame:
    """Split kinds of large groups into those of `width` offsets each. The new group is the old one, the offsets, and the
    symbols that all of its windows share; `row` tells different ones of its kinds apart."""

    def digest(*parts: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "big", signed=True)

    def split(batches):
        trim()
        for batch in batches:
            out = []
            for h, kind, low, high, left, copies, data in zip(*(batch.column(c).to_pylist() for c in KIND)):
                for k in range(low // width, high // width + 1):
                    first, last = k * width, k * width + width - 1
                    a, b = max(low, first), min(high, last)
                    core = data[max(0, left - first) * unit : (left - last + length) * unit] if left - last + length > 0 else b""
                    group = digest(core, b"%d,%d,%d" % (h, width, k))
                    part = data[(left - b) * unit : (left - a + length) * unit]
                    out.append((group, kind, a, b, b, copies, part, digest(part, b"%d,%d,%d" % (group, a, b))))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate([*KIND_TYPES, pa.int64()])], names=[*KIND, "row"])

    return rows.select(*KIND).mapInArrow(split, f"{KIND_SHAPE}, row long")


def repeats_of_groups(rows: DataFrame, length: int, unit: int, each: bool) -> DataFrame:
    """kind, a, b (from the anchor, b excluded) of the maximal repeats of groups of at most GROUP rows.

    With each, a row for every repeat and occurrence, and `repeat`, 64 bits of its symbols; else the ranges that
    a kind's repeats cover together, and a null.
    """

    def scan(batches):
        held: list = []
        now = None
        for batch in batches:
            out = []
            for h, kind, left, copies, data in zip(*(batch.column(c).to_pylist() for c in ("h", "kind", "left", "copies", "data"))):
                if h != now:
                    out += decide(held)
                    now, held = h, []
                held.append((kind, data, left, copies))
            yield result(out)
        yield result(decide(held))

    def decide(group):
        if len(group) < 2 and not (group and group[0][3] > 1):
            return []
        kinds = [x[1:] for x in group]
        if not each:
            return [(group[k][0], a, b + 1, None) for k, own in covers(kinds, length, unit).items() for a, b in own]
        out = []
        for members in maximal_repeats(kinds, length, unit):
            k, before, match = members[0]
            data, left, _ = kinds[k]
            string = data[(left - before) * unit : (left + match) * unit]
            name = int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "big", signed=True)
            out += [(group[k][0], -before, match, name) for k, before, match in members]
        return out

    def result(out):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=["kind", "a", "b", "repeat"])

    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    dealt = rows.repartition("h").sortWithinPartitions("h", "kind")
    return dealt.select("h", "kind", "left", "copies", "data").mapInArrow(scan, "kind long, a int, b int, repeat long")


def placed_repeats(docs: DataFrame, text: str, length: int, gram: int, words: bool, each: bool = False) -> DataFrame:
    """ka, kb, a, b (in symbols, b excluded), repeat: where repeats stand in the distinct texts; see repeats_of_groups for each."""
    unit = 8 if words else 1
    runs = written(occurrences(docs, text, length, gram, words), "runs")
    often = runs.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    near = written(likely(runs, "h", often, "h"), "near")
    kinds = near.groupBy(*SHAPE).agg(F.min(F.struct("ka", "kb", "pos")).alias("one"), F.count("*").alias("copies"))
    kinds = written(kinds.withColumn("kind", F.monotonically_increasing_id()), "kinds")
    anchors = written(kinds.groupBy("h").agg(F.count("*").alias("n"), F.sum("copies").alias("all")).where("all > 1").select("h", "n"), "anchors")
    rows = written(kinds_with_bytes(docs, text, kinds.join(anchors, "h"), length, words), "bytes")
    found = repeats_of_groups(rows.where(F.col("n") <= GROUP), length, unit, each)
    rows, width = rows.where(F.col("n") > GROUP), length
    while many := rows.count():
        width = -(-width // SPLIT)
        split = written(split_by_offset(rows.coalesce(max(1, -(-many // ROWS))), width, length, unit), "split")
        # kinds that are equal at these offsets are one; where the width is 1, all kinds of a group are
        one = split.groupBy("h", "row").agg(*[F.first(c).alias(c) for c in ("low", "high", "left", "data")], F.sum("copies").alias("copies"))
        one = written(one.withColumnRenamed("row", "kind"), "distinct", SPLIT * many)
        told = one.groupBy("h").agg(F.count("*").alias("n"), F.sum("copies").alias("all")).where("all > 1").select("h", "n")
        some = repeats_of_groups(one.join(told.where(F.col("n") <= GROUP), "h"), length, unit, each)
        found = found.union(split.select("kind", "row").join(some.withColumnRenamed("kind", "row"), "row").select("kind", "a", "b", "repeat"))
        rows = split.join(told.where(F.col("n") > GROUP), "h").select(*KIND)
    ranges = written(found.join(kinds.select("kind", *SHAPE), "kind").select(*SHAPE, "a", "b", "repeat").distinct(), "ranges")
    return near.join(ranges, SHAPE).select("ka", "kb", (F.col("pos") + F.col("a")).alias("a"), (F.col("pos") + F.col("b")).alias("b"), "repeat").distinct()


def repeat_groups(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, words: bool = False) -> DataFrame:
    """repeat, size, ka, kb, start: the maximal repeats of `length` symbols or more, with all their occurrences.

    repeat: 64 bits of the string. ka, kb: the text, see text_key; equal texts are one. A repeat that stands once in
    one distinct text stands in two rows with that text. Positions and sizes are in bytes, or in words with words.
    Null texts count as empty and have no repeat; an empty table gives no rows.
    """
    found = placed_repeats(small_batches(docs), text, length, gram, words, each=True)
    return found.select("repeat", (F.col("b") - F.col("a")).alias("size"), "ka", "kb", F.col("a").alias("start"))


def covered(docs: DataFrame, text: str, length: int, gram: int, words: bool) -> DataFrame:
    """ka, kb, spans array<struct<a, b>>: ranges of symbols that repeats cover (b excluded, unmerged), of every distinct text that has any."""
    found = placed_repeats(docs, text, length, gram, words)
    return written(found.groupBy("ka", "kb").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "spans")


def cut_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, words: bool = False, passage: int = 0) -> DataFrame:
    """docs and n_bytes, n_removed, n_spans, kept_bytes: what is left without the repeated windows of `length` symbols.

    Symbols are bytes; with words, they are words, and white space around a removed passage stays. With passage, a
    column n_passage_words tells how many words stand in passages of so many words that are repeated; they are not
    removed for that. Windows are judged on the input, and all occurrences go. A null text has no bytes. Repeated rows
    count as occurrences of each other. Null and equal numbers don't matter: texts are told apart by 128 bits of hash.
    Columns of docs with these names are replaced, others pass through, whatever they are called. An empty table
    stays empty.
    """
    made = ["n_bytes", "n_removed", "n_spans", "kept_bytes"] + ["n_passage_words"] * bool(passage)
    docs = small_batches(docs)
    names, own = owned(docs, made, text)
    body = F.col(quoted(text))
    ka, kb = text_key(body)
    spans = covered(docs, text, length, gram, words)
    if passage:
        other = covered(docs, text, passage, PASSAGE_GRAM, True).withColumnRenamed("spans", "passages")
        spans = written(spans.join(other, ["ka", "kb"], "full"), "cover")
    else:
        spans = written(spans.withColumn("passages", F.lit(None).cast("array<struct<a:bigint,b:bigint>>")), "cover")

    clean, maybe = parted(docs.select(own, body.alias("body"), ka, kb), "ka", spans, "ka")
    raw = F.coalesce(F.encode(F.col("body"), "UTF-8"), F.lit(b"").cast("binary"))
    none = [F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), raw.alias("kept_bytes"), F.lit(0).cast("long").alias("n_passage_words")]
    clean = clean.select("own", "body", F.length(raw).cast("long").alias("n_bytes"), *none)
    # all copies of a text have one key
    maybe = salted_join(maybe, spans, ["ka", "kb"], hot_keys(maybe, ["ka", "kb"]))

    @F.pandas_udf("n_removed long, n_spans long, kept_bytes binary, n_passage_words long")
    def cut(raws, starts, stops, passage_starts, passage_stops):
        import pandas as pd

        rows = []
        for data, a, b, c, d in zip(raws, starts, stops, passage_starts, passage_stops):
            inside = sum(y + 1 - x for x, y in merged(list(zip(c.tolist(), (d - 1).tolist())))) if c is not None else 0
            cover = merged(list(zip(a.tolist(), (b - 1).tolist()))) if a is not None else []
            if words and cover:
                start, stop = word_edges(np.frombuffer(data, np.uint8))
                cover = [(int(start[x]), int(stop[y]) - 1) for x, y in cover]
            edges = [0, *(x for a, b in cover for x in (a, b + 1)), len(data)]
            rows.append((sum(b + 1 - a for a, b in cover), len(cover), b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])), inside))
        return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept_bytes", "n_passage_words"])

    done = maybe.select("own", "body", F.length(raw).cast("long").alias("n_bytes"), cut(raw, F.col("spans.a"), F.col("spans.b"), F.col("passages.a"), F.col("passages.b")).alias("cut"))
    done = done.select("own", "body", "n_bytes", "cut.n_removed", "cut.n_spans", "cut.kept_bytes", "cut.n_passage_words")
    return clean.union(done).select(*names, *made)


def removed_digest(cut: DataFrame, id_column: str = "doc_id") -> DataFrame:
    more = [c for c in cut.columns if c == "n_passage_words"]
    return cut.select(F.col(quoted(id_column)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"), *more)

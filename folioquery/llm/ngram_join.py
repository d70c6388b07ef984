"""Jaccard join of documents over word n-grams by prefix trees.

A document's set holds its distinct n-grams as 64-bit hashes; once ordered, 48 bits of them and their frequency are
compared. Sets are told apart by 128 bits, texts by 64. But for collisions of these the join is exact. Equal sets
are one node. Then:

1. Thin out. Of every set the first half in hash order is dealt by hash, and counted: a set that has a
   partner must share a quarter of its size there (see least_shared), and most sets don't. Nothing is
   paired yet; what moves is 4 bytes a hash.
2. Order. The sets that are left are ordered by document frequency, rarest n-gram first, counted exactly over
   them. Two sets with a link share an n-gram in their first n - ceil(3n/4) + 1.
3. Star. Of each such n-gram's sets the smallest is its hub; every other one is held against the hub, in
   a prefix tree of the members that the hub's set walks down. Links give first components.
4. Rest. Sets that n-grams with several components tie together are a family, joined in blocks: a prefix tree
   of one block, walked by all sets of another at once, skipping branches of the walkers' own components and
   branches that the remaining lengths rule out. A family beyond FAMILY is joined in blocks too, as a whole or
   n-gram by n-gram, whichever compares fewer pairs.

A large group of near copies is so joined through its hub, not in pairs. Rows that share an n-gram are never
gathered beyond BLOCK; larger ones take more blocks, none is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, likely, quoted, release, slots, small_batches, written
from .repeats import common_prefix
from .rolling import BASE, mix

WORDS = 5
#: Sets in one block of the last step; hashes in one part of the first; text characters hashed at a time.
BLOCK, PART, TOGETHER = 2048, 1 << 21, 8 << 20
#: Keys in one block, as long as that leaves it a quarter of its sets; bytes of the table of a block's walkers; sets in one tree of the star step.
KEYS, TABLE, STAR = 1 << 20, 32 << 20, 512
#: Hubs that a set is held against, so that what the star step moves stays in proportion to the sets.
HUBS = 8
#: Sets of a family that are joined as one group, in blocks; turns in which a larger one is held against other hubs first.
FAMILY, TURNS = 16 * BLOCK, 12
#: The threshold of 75 of 100: 7 * overlap >= 3 * (a + b) for sets of a and b. Keys of an edge that are looked up together, by one walker and by many.
EDGE, EDGES = 32, 255


def shingles(raw: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams: A-Z lower-cased, words between ASCII white space."""
    from xxhash import xxh3_64_intdigest

    parts = raw.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxh3_64_intdigest, parts), np.uint64, len(parts))
    if len(own) < words:
        whole = np.uint64(len(own))
        with np.errstate(over="ignore"):
            for x in own:
                whole = whole * BASE + x
        return mix(np.array([whole], np.uint64))
    total = own[: len(own) - words + 1].copy()
    for k in range(1, words):
        total *= BASE
        total += own[k : len(own) - words + 1 + k]
    return np.unique(mix(total))


def signature(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        a, b = mix(found).sum(dtype=np.uint64), mix(found ^ BASE).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def half(n: int) -> int:
    return min(n, -(-n // 2) + 1)


def least_shared(n: int) -> int:
    """Hashes of the first half that a set with a partner shares with others' first halves.

    Of two linked sets x and y let x's half end earlier in hash order. All of x's half that y has lies in y's
    half too, and x misses at most n_x - ceil(3 (n_x + n_y) / 7) of its hashes in y. With half = n/2 + 1 and sizes
    within 3:4 that leaves n_x/4 for x, and 3 n_y/7 - n_x/14 >= n_y/3 for y.
    """
    return max(1, -(-n // 4))


def deal(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (hashes % np.uint64(parts)).astype(np.int64)


def batch_of(columns: list, types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def by_part(batches):
    """(part, [(uid, data, aux)]) for rows ordered by part."""
    now, held = None, []
    for batch in batches:
        for part, uid, data, aux in zip(batch.column("part").to_pylist(), batch.column("uid").to_pylist(), batch.column("data"), batch.column("aux")):
            if part != now and held:
                yield now, held
                held = []
            now = part
            held.append((uid, data.as_buffer().to_pybytes(), aux.as_buffer().to_pybytes()))
    if held:
        yield now, held


def thinned(docs: DataFrame, text: str, words: int, parts: int, kept: list[str]) -> DataFrame:
    """The columns `kept` of docs and n, sa, sb, likely: size and signature of the set, and whether it may have a partner."""

    def halves(batches):
        """Parts below 0 carry the rows' own columns through, a part for each batch; the others hold hashes and, as (row, number) pairs, whose they are."""
        release()
        task, chunk = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column("raw")], np.int64)
            cuts = [0]
            for k in range(len(size)):
                if k - cuts[-1] >= 8192 or size[cuts[-1] : k].sum() > TOGETHER:
                    cuts.append(k)
            for a, b in zip(cuts, [*cuts[1:], len(size)]):
                uid, chunk = task << 32 | chunk, chunk + 1
                sets = [shingles(x.as_buffer().to_pybytes(), words) if x.is_valid else np.zeros(0, np.uint64) for x in batch.column("raw").slice(a, b - a)]
                firsts = [s[: half(len(s))] for s in sets]
                flat, row = np.concatenate(firsts), np.repeat(np.arange(len(sets)), [len(f) for f in firsts])
                part = deal(flat, parts)
                order = np.lexsort((row, part))
                flat, row, part = (flat // np.uint64(parts)).astype(np.uint32)[order], row[order], part[order]
                edges = np.searchsorted(part, np.arange(parts + 1))
                out = ([], [], [], [])
                for p in np.flatnonzero(np.diff(edges)):
                    rows, counts = np.unique(row[edges[p] : edges[p + 1]], return_counts=True)
                    for column, value in zip(out, (int(p), uid, flat[edges[p] : edges[p + 1]].tobytes(), np.stack([rows, counts], 1).astype("<u4").tobytes())):
                        column.append(value)
                yield batch_of(out, types, names)
                own = pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in kept] + [pa.array([len(s) for s in sets], pa.int64())] + [pa.array(x, pa.int64()) for x in zip(*map(signature, sets))], names=[*kept, "n", "sa", "sb"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema) as writer:
                    writer.write_batch(own)
                yield batch_of(([-1 - uid], [uid], [sink.getvalue().to_pybytes()], [b""]), types, names)

    def count(batches):
        for part, held in by_part(batches):
            if part < 0:
                yield batch_of(([part] * len(held), [u for u, _, _ in held], [d for _, d, _ in held], [b""] * len(held)), types, names)
                continue
            hashes = [np.frombuffer(d, "<u4") for _, d, _ in held]
            _, at, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            shared = np.split(n[at] > 1, np.cumsum([len(x) for x in hashes])[:-1])
            out = ([], [], [], [])
            for (uid, _, aux), hit in zip(held, shared):
                rows, counts = np.frombuffer(aux, "<u4").reshape(-1, 2).T
                number = np.add.reduceat(hit.astype(np.int64), np.cumsum(counts.astype(np.int64)) - counts)
                some = number > 0
                if some.any():
                    for column, value in zip(out, (part, uid, b"", np.stack([rows[some], number[some]], 1).astype("<u4").tobytes())):
                        column.append(value)
            yield batch_of(out, types, names)

    def gather(batches):
        for _, held in by_part(batches):
            own = next(d for _, d, _ in held if d)
            rows = pa.ipc.open_stream(own).read_all().combine_chunks().to_batches()[0]
            found = np.zeros(rows.num_rows, np.int64)
            for _, data, aux in held:
                if not data:
                    row, number = np.frombuffer(aux, "<u4").reshape(-1, 2).T
                    found[row] += number
            n = rows.column("n").to_numpy()
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array((n > 0) & (found >= np.maximum(1, -(-n // 4))))], names=[*rows.schema.names, "likely"])

    names, types = ["part", "uid", "data", "aux"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    shape = "part long, uid long, data binary, aux binary"
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    rows = docs.select(*kept, F.encode(F.col(quoted(text)), "UTF-8").alias("raw")).mapInArrow(halves, shape)
    counted = rows.repartition(slots(docs), "part").sortWithinPartitions("part", "uid").mapInArrow(count, shape)
    back = counted.select(F.col("uid").alias("part"), "uid", "data", "aux").repartition(slots(docs), "part").sortWithinPartitions("part")
    return back.mapInArrow(gather, f"{kinds}, n long, sa long, sb long, likely boolean")


def ordered_sets(chosen: DataFrame, words: int, parts: int) -> DataFrame:
    """node, n, keys: every set as big-endian keys (document frequency, capped at 65535, and 48 bits of hash), ascending.

    chosen: raw, and node, sa, sb. The frequency is counted over all chosen sets, by parts of the hashes.
    """

    def chunks(batches):
        task, chunk = TaskContext.get().partitionId(), 0
        nodes, sets, total = [], [], 0
        for batch in batches:
            for node, raw in zip(batch.column("node").to_pylist(), batch.column("raw")):
                nodes.append(node)
                sets.append(shingles(raw.as_buffer().to_pybytes(), words))
                total += len(sets[-1])
                if total > PART // 2:
                    yield chunk_row(task << 32 | chunk, nodes, sets)
                    nodes, sets, total, chunk = [], [], 0, chunk + 1
        if nodes:
            yield chunk_row(task << 32 | chunk, nodes, sets)

    def chunk_row(uid, nodes, sets):
        return batch_of(([uid], [np.array(nodes, "<i8").tobytes()], [np.array([len(s) for s in sets], "<i8").tobytes()], [np.concatenate(sets).astype("<u8").tobytes()]), [pa.int64(), pa.binary(), pa.binary(), pa.binary()], ["uid", "nodes", "sizes", "hashes"])

    def dealt(batches):
        for batch in batches:
            for uid, data in zip(batch.column("uid").to_pylist(), batch.column("hashes")):
                flat = np.frombuffer(data.as_buffer(), "<u8")
                part = deal(flat, parts)
                order = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[order], np.arange(parts + 1))
                flat = (flat // np.uint64(parts)).astype(np.uint32)[order]
                some = np.flatnonzero(np.diff(edges))
                yield batch_of((some.tolist(), [uid] * len(some), [flat[edges[p] : edges[p + 1]].tobytes() for p in some], [b""] * len(some)), types, names)

    def count(batches):
        for part, held in by_part(batches):
            hashes = [np.frombuffer(d, "<u4") for _, d, _ in held]
            _, at, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            seen = np.split(np.minimum(n[at], 65535).astype("<u2"), np.cumsum([len(x) for x in hashes])[:-1])
            yield batch_of(([part] * len(held), [u for u, _, _ in held], [s.tobytes() for s in seen], [b""] * len(held)), types, names)

    def order(_, chunk, counts):
        chunk = chunk.combine_chunks().to_batches()[0]
        nodes, sizes, flat = (np.frombuffer(chunk.column(c)[0].as_buffer(), t) for c, t in (("nodes", "<i8"), ("sizes", "<i8"), ("hashes", "<u8")))
        part = deal(flat, parts)
        own = np.argsort(part, kind="stable")
        seen = np.zeros(len(flat), np.uint64)
        told = dict(zip(counts.column("part").to_pylist(), counts.column("data").to_pylist()))
        seen[own] = np.concatenate([np.frombuffer(told[p], "<u2") for p in sorted(told)])
        keys = (seen << np.uint64(48)) | (flat >> np.uint64(16))
        row = np.repeat(np.arange(len(sizes)), sizes)
        keys = keys[np.lexsort((keys, row))].astype(">u8")
        edges = np.cumsum(sizes)
        return pa.table({"node": pa.array(nodes), "n": pa.array(sizes), "keys": pa.array([keys[e - s : e].tobytes() for e, s in zip(edges, sizes)], pa.binary())})

    names, types = ["part", "uid", "data", "aux"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    shape = "part long, uid long, data binary, aux binary"
    sets = written(chosen.select("node", "raw").mapInArrow(chunks, "uid long, nodes binary, sizes binary, hashes binary"), "sets")
    counted = sets.select("uid", "hashes").mapInArrow(dealt, shape).repartition(slots(chosen), "part").sortWithinPartitions("part", "uid").mapInArrow(count, shape)
    return sets.groupBy("uid").cogroup(counted.select("uid", "part", "data").groupBy("uid")).applyInArrow(order, "node long, n long, keys binary")


class Tree:
    """A prefix tree of ordered sets, its edges as runs of keys; branches know the sizes and components below."""

    __slots__ = ("edge", "depth", "branches", "members", "least", "most", "component")

    def __init__(self, sets: list[tuple[bytes, int, object]], depth: int = 0):
        """sets: (keys, index, component), ascending by keys; all share `depth` bytes."""
        first, last = sets[0][0], sets[-1][0]
        end = depth + common_prefix(first[depth:], last[depth:]) // 8 * 8 if len(sets) > 1 else len(first)
        self.edge = np.frombuffer(first[depth:end], ">u8").astype(np.uint64)
        self.depth = end // 8
        self.members = [(i, c) for k, i, c in sets if len(k) == end]
        self.branches, rest, start = [], [x for x in sets if len(x[0]) > end], 0
        for k in range(1, len(rest) + 1):
            if k == len(rest) or rest[k][0][end : end + 8] != rest[start][0][end : end + 8]:
                self.branches.append(Tree(rest[start:k], end))
                start = k
        sizes = [b.least for b in self.branches] + [self.depth] * bool(self.members)
        self.least, self.most = min(sizes), max([b.most for b in self.branches] + [self.depth] * bool(self.members))
        found = {c for _, c in self.members} | {b.component for b in self.branches}
        self.component = found.pop() if len(found) == 1 else None

    def walk(self, keys: np.ndarray, component, overlap: int = 0):
        """Yields (index, component) of the sets linked to `keys`, but for those of its own component."""
        if component is not None and self.component == component:
            return
        n = len(keys)
        for k in range(0, len(self.edge), EDGE):
            part = self.edge[k : k + EDGE]
            at = np.searchsorted(keys, part)
            overlap += int((keys[np.minimum(at, n - 1)] == part).sum())
            seen = self.depth - len(self.edge) + k + len(part)
            left = n - int(at[-1])
            # the best size below: as many keys to come as the walker has left
            size = min(max(seen + left, self.least), self.most)
            if 7 * (overlap + min(size - seen, left)) < 3 * (n + size):
                return
        for member in self.members:
            if 7 * overlap >= 3 * (n + self.depth) and (component is None or member[1] != component):
                yield member
        for branch in self.branches:
            yield from branch.walk(keys, component, overlap)


def numbers(keys: bytes) -> np.ndarray:
    return np.frombuffer(keys, ">u8").astype(np.uint64)


class Branches:
    """The prefix tree of a block's ordered sets as arrays, built from what neighbours share; no set is a branch of its own depth.

    A branch holds the keys start to end of the set `of`; below it are sets of least to most keys, of one component or of several (-1).
    """

    def __init__(self, sets: list[tuple[bytes, int, int]]):
        """sets: (keys, index, component), ascending by keys."""
        self.keys = [numbers(k) for k, _, _ in sets]
        self.start, self.end, self.of, self.below, self.members = [0], [0], [0], [[]], [[]]
        self.least, self.most, self.component = [1 << 62], [0], [None]
        path, before = [0], b""
        for k, (keys, index, component) in enumerate(sets):
            shared, last = common_prefix(before, keys) // 8, None
            while self.end[path[-1]] > shared:
                last = self.closed(last, path.pop())
            if self.end[path[-1]] < shared:
                path.append(self.added(shared, k - 1))
            self.closed(last, path[-1])
            if len(keys) // 8 > self.end[path[-1]]:
                path.append(self.added(len(keys) // 8, k))
            self.members[path[-1]].append((index, component))
            self.seen(path[-1], len(keys) // 8, len(keys) // 8, component)
            before = keys
        last = None
        while path:
            last = self.closed(last, path.pop())

    def added(self, end: int, of: int) -> int:
        for column, value in ((self.start, 0), (self.end, end), (self.of, of), (self.below, []), (self.members, []), (self.least, 1 << 62), (self.most, 0), (self.component, None)):
            column.append(value)
        return len(self.end) - 1

    def seen(self, branch: int, least: int, most: int, component: int) -> None:
        self.least[branch], self.most[branch] = min(self.least[branch], least), max(self.most[branch], most)
        self.component[branch] = component if self.component[branch] in (None, component) else -1

    def closed(self, branch: int | None, above: int) -> int:
        """Hang a finished branch under the one above it, which is returned."""
        if branch is not None:
            self.start[branch] = self.end[above]
            self.below[above].append(branch)
            self.seen(above, self.least[branch], self.most[branch], self.component[branch])
        return above

    def walk(self, walkers: list[np.ndarray], components: np.ndarray, root: np.ndarray):
        """Yields (index, component, numbers of the walkers that are linked to that set), but for walkers of its own component.

        components: the walkers'; root: what components are one by now, which may change between steps.
        """
        flat = np.concatenate(walkers)
        row = np.repeat(np.arange(len(walkers)), [len(w) for w in walkers])
        own = np.unique(np.concatenate(self.keys))
        both = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        common, at = np.unique(flat[both], return_inverse=True)
        if len(common) * len(walkers) > TABLE and len(walkers) > 1:
            half = len(walkers) // 2
            yield from self.walk(walkers[:half], components[:half], root)
            for index, component, found in self.walk(walkers[half:], components[half:], root):
                yield index, component, found + half
            return
        if not len(common):
            return
        table = np.zeros((len(common), len(walkers)), np.uint8)
        table[at, row[both]] = 1
        # of every 64th key, how many of the common ones each walker has from there on
        ahead = np.add.reduceat(table, np.arange(0, len(common), 64), axis=0, dtype=np.int32)[::-1].cumsum(axis=0)[::-1]
        ahead = np.concatenate([ahead, np.zeros((1, len(walkers)), ahead.dtype)])
        n = np.array([len(w) for w in walkers])
        todo = [(0, np.zeros(len(walkers), np.int64), np.ones(len(walkers), bool))]
        while todo:
            branch, overlap, alive = todo.pop()
            if self.component[branch] != -1:
                alive = alive & (root[components] != root[self.component[branch]])
            edge, seen = self.keys[self.of[branch]][self.start[branch] : self.end[branch]], self.start[branch]
            for k in range(0, max(1, len(edge)), EDGES):
                part = edge[k : k + EDGES]
                seen += len(part)
                place = np.searchsorted(common, part)
                known = place[common[np.minimum(place, len(common) - 1)] == part]
                if len(known):
                    overlap = overlap + np.add.reduce(table[known], axis=0, dtype=np.uint8)
                left = ahead[place[-1] // 64 if len(place) else 0]
                # the best size below: as many keys to come as the walker has left
                size = np.clip(seen + left, self.least[branch], self.most[branch])
                alive = alive & (7 * (overlap + np.minimum(size - seen, left)) >= 3 * (n + size))
                if not alive.any():
                    break
            else:
                for index, component in self.members[branch]:
                    found = np.flatnonzero(alive & (7 * overlap >= 3 * (n + self.end[branch])) & (root[components] != root[component]))
                    if len(found):
                        yield index, component, found
                todo += [(b, overlap, alive) for b in self.below[branch]]


def star_links(pairs: DataFrame) -> DataFrame:
    """a, b of the pairs (hub, hub_keys, node, keys) that are linked; rows of a hub come together."""

    def run(batches):
        for batch in batches:
            hubs = batch.column("hub").to_pylist()
            nodes, keys = batch.column("node").to_pylist(), batch.column("keys").to_pylist()
            out, start = [], 0
            for k in range(1, len(hubs) + 1):
                if k == len(hubs) or hubs[k] != hubs[start] or k - start == STAR:
                    tree = Tree(sorted((keys[i], i, None) for i in range(start, k)))
                    walker = numbers(batch.column("hub_keys")[start].as_py())
                    out += [(hubs[start], nodes[i]) for i, _ in tree.walk(walker, None)]
                    start = k
            yield batch_of(list(zip(*out)) or [[], []], [pa.int64(), pa.int64()], ["a", "b"])

    return pairs.sortWithinPartitions("hub").select("hub", "hub_keys", "node", "keys").mapInArrow(run, "a long, b long")


def block_links(rows: DataFrame) -> DataFrame:
    """a, b: a link of every two components that one has, within the groups (key, i, j) of rows node, component, keys, side."""

    def join(group):
        left = [k for k, x in enumerate(group) if x[3] != 1]
        right = [k for k, x in enumerate(group) if x[3] != 0]
        if not left or not right:
            return []
        nodes, linked = [x[0] for x in group], []
        names, own = np.unique([x[1] for x in group], return_inverse=True)
        root = np.arange(len(names))
        tree = Branches(sorted((group[k][2], k, int(own[k])) for k in left))
        for i, c, found in tree.walk([numbers(group[k][2]) for k in right], own[right], root):
            found = np.array(right)[found]
            while len(found := found[root[own[found]] != root[c]]):
                linked.append((nodes[found[0]], nodes[i]))
                root[root == root[own[found[0]]]] = root[c]
        return linked

    def run(batches):
        now, held = None, []
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("key", "i", "j", "node", "component", "keys", "side")]
            for key, i, j, *row in zip(*columns):
                if (key, i, j) != now:
                    out += join(held)
                    now, held = (key, i, j), []
                held.append(row)
            yield batch_of(list(zip(*out)) or [[], []], [pa.int64(), pa.int64()], ["a", "b"])
        out = join(held)
        yield batch_of(list(zip(*out)) or [[], []], [pa.int64(), pa.int64()], ["a", "b"])

    spread = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return spread.select("key", "i", "j", "node", "component", "keys", "side").mapInArrow(run, "a long, b long")


def heft() -> Column:
    """As how many sets the rows (n) of a group count: those with many keys count for more, for four at most."""
    return F.greatest(F.count("*"), F.least(4 * F.count("*"), F.ceil(F.sum("n") * BLOCK / KEYS))).alias("rows")


def in_blocks(rows: DataFrame) -> DataFrame:
    """rows (key, node, component, rows) for every pair of blocks i <= j of their group; side 0: of i, 1: of j, 2: of both."""
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(2)), blocks).cast("int")
    split = rows.select("key", "node", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return split.select("key", "node", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"))


def other_hubs(loose: DataFrame, turn: int, whole: DataFrame) -> DataFrame:
    """The sets of loose (key, node, component) beside a hub of another component that shares an n-gram, HUBS at most.

    Each n-gram's hub is another one every turn; rows as star_links takes them.
    """
    hubs = loose.groupBy("key").agg(F.min_by(F.struct("node", "component"), F.xxhash64("node", F.lit(turn))).alias("hub"))
    near = loose.join(hubs, "key").where("component <> hub.component")
    shared = near.groupBy(F.col("hub.node").alias("hub"), "node").agg(F.count("*").alias("shared"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.col("shared").desc(), "hub"))
    pairs = written(shared.withColumn("place", place).where(F.col("place") <= HUBS).select("hub", "node"), "pairs")
    return pairs.join(whole, "node").join(whole.select(F.col("node").alias("hub"), F.col("keys").alias("hub_keys")), "hub")


def links_of(sets: DataFrame) -> DataFrame:
    """node, component for the nodes of sets (node, n, keys) that have a link."""

    def prefixes(batches):
        for batch in batches:
            out = ([], [], [])
            for node, n, keys in zip(batch.column("node").to_pylist(), batch.column("n").to_pylist(), batch.column("keys").to_pylist()):
                first = numbers(keys)[: n - (3 * n + 3) // 4 + 1]
                first = first[first >= np.uint64(2 << 48)]
                out[0].append(first.view(np.int64))
                out[1].append(np.full(len(first), node))
                out[2].append(np.full(len(first), n))
            if out[0]:
                yield batch_of([np.concatenate(x) for x in out], [pa.int64()] * 3, ["key", "node", "n"])

    index = written(sets.mapInArrow(prefixes, "key long, node long, n long"), "index")
    hubs = index.groupBy("key").agg(F.min(F.struct("n", "node")).alias("hub"), F.count("*").alias("rows")).where("rows > 1")
    near = index.join(hubs, "key").where("node <> hub.node and 3 * n <= 4 * hub.n")
    # a set goes to the hubs it shares most n-grams with; links that its other hubs would show are found in the last step
    shared = near.groupBy(F.col("hub.node").alias("hub"), "node").agg(F.count("*").alias("shared"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.col("shared").desc(), "hub"))
    pairs = written(shared.withColumn("place", place).where(F.col("place") <= HUBS).select("hub", "node"), "pairs")
    whole = sets.select("node", "keys")
    both = pairs.join(whole, "node").join(whole.select(F.col("node").alias("hub"), F.col("keys").alias("hub_keys")), "hub")
    links = written(star_links(both), "stars")
    first = written(components(links), "first")

    for turn in range(TURNS + 1):
        placed = index.join(first, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        told = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("hub")).where("low <> high")
        open_ = written(placed.join(told.select("key", "hub"), "key"), "open")
        # sets that n-grams tie together, linked or not, travel once, as a family; only of overlarge families each n-gram's sets do
        family = components(open_.select(F.col("node").alias("a"), F.col("hub").alias("b")), name="family")
        family = written(open_.select("node", "component").distinct().join(family.toDF("node", "key"), "node"), "families")
        sizes = written(family.join(sets.select("node", "n"), "node").groupBy("key").agg(heft()), "sizes")
        overlarge = sizes.where(F.col("rows") > FAMILY)
        if turn == TURNS or not overlarge.limit(1).count():
            break
        loose = open_.drop("hub").join(family.join(overlarge, "key").select("node"), "node", "left_semi")
        more = written(star_links(other_hubs(loose, turn, whole)), "stars")
        if not more.limit(1).count():
            break
        links = written(links.union(more), "links")
        first = written(components(links), "first")
    small, large = sizes.where(F.col("rows") <= FAMILY), None
    if overlarge.limit(1).count():
        beyond = family.join(overlarge.select("key"), "key").select("node", F.col("key").alias("family"))
        large = written(open_.drop("hub").join(beyond, "node").join(sets.select("node", "n"), "node"), "large")
        groups = large.groupBy("family", "key").agg(heft(), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
        groups = written(groups.groupBy("family", "rows", "x", "y").agg(F.min("key").alias("key")), "groups")
        # near copies share most of their n-grams, so that these would pair them again and again; sets tied by few are not paired at all
        pairs = groups.groupBy(F.col("family").alias("key")).agg(F.sum(F.col("rows").cast("double") * F.col("rows")).alias("pairs"))
        whole_too = written(overlarge.join(pairs, "key").where(F.col("rows").cast("double") * F.col("rows") <= F.col("pairs")).select("key", "rows"), "whole_too")
        small = small.union(whole_too)
        apart = groups.join(whole_too.select(F.col("key").alias("family")), "family", "left_anti").select("key", "rows")
        large = large.select("key", "node", "component").join(apart, "key")
    found = block_links(in_blocks(family.join(small, "key")).join(whole, "node"))
    if large is not None:
        found = found.union(block_links(in_blocks(large).join(whole, "node")))
    more = written(found, "blocks")
    return written(components(links.union(more)), "classes")


def ngram_classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest number that links lead to from each row, its own included.

    A null or blank text has an empty set and no link. A text of fewer than `words` words is one n-gram.
    Rows with equal sets are linked; rows of one number with different texts are different nodes. A null number
    is never the smallest of its component; alone, its component is null. An empty table gives no rows.
    """
    rows = small_batches(docs).select(F.col(quoted(id_column)).cast("long").alias("doc_id"), F.xxhash64(F.col(quoted(text))).alias("key"), F.col(quoted(text)).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(slots(docs), -(-size // (12 * PART)))
    all_rows = written(thinned(rows, "text", words, parts, ["doc_id", "key"]), "thinned")
    nodes = all_rows.where("n > 0").groupBy("sa", "sb").agg(F.min("doc_id").alias("low"), F.min("key").alias("key"), F.max("likely").alias("likely"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    chosen = nodes.where("likely").select("node", "key")
    texts = likely(rows.select("key", "text"), "key", chosen, "key").groupBy("key").agg(F.first("text").alias("text"))
    sets = written(ordered_sets(texts.join(chosen, "key").select("node", F.encode("text", "UTF-8").alias("raw")), words, parts), "ordered")
    classes = links_of(sets)
    placed = nodes.join(classes, "node", "left").select("sa", "sb", "low", F.coalesce("component", "node").alias("component"))
    placed = written(placed, "placed")
    # written, so that the join on it can split a component that holds many of the rows
    lowest = written(placed.groupBy("component").agg(F.min("low").alias("component_id")), "lowest")
    of_set = written(placed.join(lowest, "component").select("sa", "sb", "component_id"), "of_set")
    found = all_rows.where("n > 0").join(of_set, ["sa", "sb"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.union(all_rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))

"""N-gram Jaccard join with count vectors in R-trees.

The set of a document is its distinct word shingles, as 64-bit hashes. Hashing shingles into groups and counting them
gives a point; the overlap of two sets is at most the sum, over the groups, of the smaller of both counts. Points are
packed into an R-tree whose nodes keep the largest count in each group, so the same sum bounds the overlap of a query
with everything below a node, and whole branches go unread. Pairs that survive are verified on the sets themselves.

A tree of all documents would not cut a join at this similarity down enough: points of unrelated texts of one length
lie near each other, and every query would walk most of it. So documents are first dealt into small trees such that
no linked pair is split:

* Documents with equal sets are one node.
* Large sets are cut into parts by a hash of the shingle: if two sets overlap enough, then so do both of some part of
  them, and small parts of unrelated sets are told apart by few groups.
* Shingles have a fixed order, common ones last (those seen often anywhere, from counts over all documents). Two parts
  that overlap enough share one of their first n - ceil(0.8 n) + 1 shingles. The parts that share such a shingle are a
  block, and a block's points are searched for pairs that the bound lets through (``Blocks``). Components of these
  pairs are the candidates' groups, so linked documents are always in the same group, and documents that share a
  passage only are hardly ever.
* A group of up to ``leaf_nodes`` nodes is one tree in one task. Larger ones are dealt by hash into leaves of that
  size. In a first pass each leaf is joined with itself and with one pivot of the group; copies of one text meet in the
  pivot. Only nodes that are not linked to the pivot that way are then run against the other leaves, in blocks.

Nodes already known to be connected are not compared again. What comes out is the component of every document; links
inside it are not expanded into pairs.

Defined cases: null, empty and wordless text has an empty set and is linked with nothing; fewer words than a shingle
has are one shingle; rows that share an id are one document with the links of all its texts (each row keeps its own
set size); repeated rows are copies; texts of any length are shingled whole, a MiB at a time; other columns of the
input play no part; an empty table gives an empty result; null ids stand for no document: they link, and get a null component where no other id is smaller; nodes are
64-bit hashes of sets, shingles 64-bit hashes of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.frequent import most_frequent
from ..operators.graph import connected_components
from ..session import materialise

WORDS = 5
#: Similarity as a fraction of integers, so that the limit itself counts.
NUMERATOR, DENOMINATOR = 4, 5
GROUPS = 64
FANOUT = 16
LEAF_NODES = 512
#: Most shingles treated as common; the table of them is broadcast, 8 bytes each.
COMMON = 200_000
#: A shingle is put forward as common by a task that meets it so often in CHUNK shingles.
COMMON_AT = 6
CHUNK = 2_000_000
#: Sets beyond this size are cut into parts by hash, a power of PARTING of them, for the search of blocks.
PART_SIZE, PARTING = 768, 4
BLOOM_BITS = 1 << 28
LAST = 2**63 - 1

_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_rng = np.random.default_rng(20_240_501)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = re.compile(rb"[ \t-\r]")
_PIECE = 1 << 20


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, _BASE, np.uint64))])


_POWERS = _powers(1 << 12)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word between white space, in order, A-Z taken as a-z, and where each word begins.

    The hash is a polynomial in the word's bytes, mixed; all of it is array work, so many texts are best given at once.
    """
    b = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(~_GAP[b])
    if not len(at):
        return np.zeros(0, np.uint64), at
    first = np.flatnonzero(at[1:] - at[:-1] > 1)
    first += 1
    first = np.concatenate([np.zeros(1, first.dtype), first])
    lengths = np.empty(len(first), np.int64)
    lengths[:-1] = first[1:] - first[:-1]
    lengths[-1] = len(at) - first[-1]
    starts = at[first]
    offset = at - np.repeat(starts, lengths)
    longest = int(lengths.max())
    powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
    h = _BYTE[b[at]]
    h *= powers[offset]
    h = np.add.reduceat(h, first)
    return _mix(h ^ lengths.astype(np.uint64)), starts


def _pieces(data: bytes) -> Iterator[bytes]:
    """Stretches of about _PIECE bytes that end at white space, so that long texts need no long arrays at once."""
    start = 0
    while len(data) - start > _PIECE:
        # Not the white space at start itself, where the piece before ended.
        cut = max(data.rfind(c, start + 1, start + _PIECE) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
        if cut <= start:  # a word longer than a piece
            found = _SPACE.search(data, start + _PIECE)
            cut = found.start() if found else len(data)
        yield data[start:cut]
        start = cut
    yield data[start:]


class Shingler:
    def __init__(self, k: int = WORDS):
        self.k = k

    def __call__(self, text: str | None) -> np.ndarray:
        """The sorted distinct shingle hashes of a text."""
        return next(self.many([text]))

    def many(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The sets of texts, in order; short texts are hashed together."""
        held, size = [], 0
        for t in texts:
            data = (t or "").encode("utf-8", "surrogatepass")
            if size + len(data) > _PIECE:
                yield from self._together(held)
                held, size = [], 0
            if len(data) > _PIECE:
                yield self._set(np.concatenate([word_hashes(p)[0] for p in _pieces(data)]))
            else:
                held.append(data)
                size += len(data) + 1
        yield from self._together(held)

    def _together(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if not texts:
            return
        h, starts = word_hashes(b" ".join(texts))
        ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])).tolist()
        runs = self._runs(h) if len(h) >= self.k else None
        low = 0
        for high in ends:
            yield self._set(h[low:high], None if runs is None else runs[low : max(low, high - self.k + 1)])
            low = high

    def _runs(self, h: np.ndarray) -> np.ndarray:
        n = len(h) - self.k + 1
        total = np.zeros(n, np.uint64)
        for j in range(self.k):
            total += h[j : n + j] * (_P[j % len(_P)] * np.uint64(2 * (j // len(_P)) + 1))
        return _mix(total)

    def _set(self, words: np.ndarray, runs: np.ndarray | None = None) -> np.ndarray:
        if not len(words):
            return words
        if len(words) < self.k:
            return np.array([xxhash.xxh64_intdigest(words.tobytes(), seed=len(words))], np.uint64)
        out = np.sort(self._runs(words) if runs is None else runs)
        new = out[1:] != out[:-1]
        return out if new.all() else np.concatenate([out[:1], out[1:][new]])


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) >> 1


def prefix_length(n: int) -> int:
    return n - -(-n * NUMERATOR // DENOMINATOR) + 1


def prefix(shingles: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the fixed order: others by hash, then common ones by rank. common is sorted."""
    need = prefix_length(len(shingles))
    if not len(common):
        return shingles[:need]
    upto = min(len(shingles), need + 16)
    while True:
        part = shingles[:upto]
        at = np.minimum(np.searchsorted(common, part), len(common) - 1)
        hot = common[at] == part
        out = part[~hot][:need]
        if len(out) == need or upto == len(shingles):
            break
        upto = min(len(shingles), 2 * upto)
    if len(out) < need:
        ordered = shingles[hot][np.argsort(rank[at[hot]], kind="stable")]
        out = np.concatenate([out, ordered[: need - len(out)]])
    return out


def parting(n: int) -> int:
    """Into how many parts a set of n shingles is cut."""
    parts = 1
    while n > PART_SIZE * parts:
        parts *= PARTING
    return parts


def parts_of(node: int, shingles: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(parting, part, shingles) for every parting that a pair of this set, as its larger or smaller one, is held by.

    A pair is held by the parting of its smaller set. If two sets overlap enough, so do both of some part of them.
    """
    n = len(shingles)
    for k in sorted({parting(n), parting(-(-n * NUMERATOR // DENOMINATOR))}):
        if k == 1:
            yield 1, node, shingles
            continue
        place = (shingles >> np.uint64(40)) & np.uint64(k - 1)
        for c in range(k):
            part = shingles[place == np.uint64(c)]
            if len(part):
                yield k, xxhash.xxh3_64_intdigest(b"%d.%d.%d" % (node, k, c)) >> 1, part


# --- within one tree ------------------------------------------------------------------------------------------------


def vectors(sets: list[np.ndarray], groups: int = GROUPS) -> np.ndarray:
    out = np.zeros((len(sets), groups), np.int32)
    for i, s in enumerate(sets):
        out[i] = np.bincount((s % np.uint64(groups)).astype(np.int64), minlength=groups)
    return out


def pack(point: np.ndarray) -> bytes:
    """A point in few bytes; counts beyond their width stand for any number, as the bound must never fall short."""
    return np.minimum(point, 65_535).astype("<u2").tobytes()


def unpack(data: bytes) -> np.ndarray:
    # Four bytes a count: sums of these are made in eight.
    point = np.frombuffer(data, "<u2").astype(np.int32)
    return np.where(point == 65_535, np.int32(1 << 24), point)


class RTree:
    """Points packed bottom-up in an order that keeps sizes together; every node knows the largest coordinates below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fanout: int = FANOUT):
        self.fanout = fanout
        self.order = np.lexsort((*(points[:, j] for j in range(min(4, points.shape[1]))), sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        high, low, big = self.points, self.sizes, self.sizes
        while len(high) > fanout:
            cuts = np.arange(0, len(high), fanout)
            high, low, big = np.maximum.reduceat(high, cuts, axis=0), np.minimum.reduceat(low, cuts), np.maximum.reduceat(big, cuts)
            self.levels.append((high, low, big))

    def search(self, point: np.ndarray, n: int) -> np.ndarray:
        """Indices of all points whose overlap with point, of n shingles, could make a link."""
        # overlap / (n + m - overlap) >= a/b  <=>  (a + b) * overlap >= a * (n + m)
        a, b = NUMERATOR, DENOMINATOR
        at = np.arange(len(self.levels[-1][0])) if self.levels else np.arange(len(self.points))
        for level in range(len(self.levels) - 1, -1, -1):
            high, low, big = self.levels[level]
            bound = np.minimum(high[at], point).sum(1)
            ok = ((a + b) * bound >= a * (n + np.maximum(low[at], -(-n * a // b)))) & (low[at] * a <= n * b) & (big[at] * b >= n * a)
            below = len(self.points) if level == 0 else len(self.levels[level - 1][0])
            at = (at[ok][:, None] * self.fanout + np.arange(self.fanout)).ravel()
            at = at[at < below]
        m = self.sizes[at]
        ok = ((a + b) * np.minimum(self.points[at], point).sum(1) >= a * (n + m)) & (m * a <= n * b) & (m * b >= n * a)
        return self.order[at[ok]]


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[max(i, j)] = min(i, j)


def join_local(sets: list[np.ndarray], queries: list[int] | None = None, known: list[int] | None = None) -> list[int]:
    """Roots of the linked parts of sets. queries: only pairs with one of these are looked at. known: equal labels are connected already."""
    n, union = len(sets), _Union(len(sets))
    if known is not None:
        first: dict[int, int] = {}
        for i, label in enumerate(known):
            j = union.find(first.setdefault(label, i))
            if (i := union.find(i)) != j:
                union.join(i, j)
    sizes = np.array([len(x) for x in sets])
    # Enough groups that unrelated sets of these sizes lie apart.
    groups = GROUPS
    while groups < 4096 and groups * 10 < sizes.max():
        groups *= 2
    points = vectors(sets, groups)
    tree = RTree(points, sizes)
    for i in range(n) if queries is None else queries:
        for j in map(int, tree.search(points[i], int(sizes[i]))):
            if i == j or (queries is None and j > i):
                continue
            a, b = union.find(i), union.find(j)
            if a != b and linked(sets[i], sets[j]):
                union.join(a, b)
    return [union.find(i) for i in range(n)]


class Blocks:
    """Spanning edges of the pairs that share a shingle and whose points could belong to linked sets.

    One instance sees all blocks of a task; pairs already connected there are not looked at again, and points are
    compared by the bound only. Pairs of parts that failed are remembered as parts: another part of the same two nodes
    may still pass. Small blocks are compared at once, large ones by an R-tree, after neighbours in order of size and
    first counts have been joined, so that a block of copies costs little more than its length.
    """

    def __init__(self):
        self.up: dict[int, int] = {}
        self.failed: set[tuple[int, int]] = set()

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y] if y in up else y
        return x

    def join(self, x: int, y: int) -> list[tuple[int, int]]:
        a, b = self.find(x), self.find(y)
        if a == b:
            return []
        self.up[max(a, b)] = min(a, b)
        return [(x, y)]

    def edges(self, nodes: list[int], sizes: list[int], points: list[bytes], parts: list[int] | None = None) -> list[tuple[int, int]]:
        """sizes and points are those of parts, which are the nodes themselves where not given."""
        roots = [self.find(x) for x in nodes]
        if len(set(roots)) == 1:
            return []
        if len(nodes) == 2:
            pair = (min(parts or nodes), max(parts or nodes))
            if pair in self.failed:
                return []
            if self._near(sizes[0], unpack(points[0]), sizes[1], unpack(points[1])):
                return self.join(min(nodes), max(nodes))
            if len(self.failed) > 2_000_000:
                self.failed.clear()
            self.failed.add(pair)
            return []
        grid, n = np.stack([unpack(p) for p in points]), np.array(sizes)
        out: list[tuple[int, int]] = []
        order = np.lexsort((grid[:, 0], n)).tolist()
        for i, j in zip(order, order[1:]):
            if self.find(nodes[i]) != self.find(nodes[j]) and self._near(sizes[i], grid[i], sizes[j], grid[j]):
                out += self.join(nodes[i], nodes[j])
        count: dict[int, int] = {}
        for x in nodes:
            r = self.find(x)
            count[r] = count.get(r, 0) + 1
        most = max(count, key=count.__getitem__)
        left = [i for i, x in enumerate(nodes) if self.find(x) != most]
        tree = RTree(grid, n) if left else None
        for i in left:
            for j in tree.search(grid[i], sizes[i]).tolist():
                out += self.join(nodes[i], nodes[j])
        return out

    @staticmethod
    def _near(n: int, x: np.ndarray, m: int, y: np.ndarray) -> bool:
        a, b = NUMERATOR, DENOMINATOR
        return n * b >= m * a and m * b >= n * a and (a + b) * int(np.minimum(x, y).sum()) >= a * (n + m)


def _block_edges(rows: DataFrame) -> DataFrame:
    """(src, dst) from rows (token, node, part, n, point); the rows of a token are one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, now, out = Blocks(), None, []
        nodes, sizes, points, parts = [], [], [], []
        for b in batches:
            for token, node, part, n, point in zip(*(b.column(c).to_pylist() for c in ("token", "node", "part", "n", "point"))):
                if token != now:
                    if len(nodes) > 1:
                        out += blocks.edges(nodes, sizes, points, parts)
                    now, nodes, sizes, points, parts = token, [], [], [], []
                if not nodes or node != nodes[-1]:
                    nodes.append(node)
                    sizes.append(n)
                    points.append(point)
                    parts.append(part)
        if len(nodes) > 1:
            out += blocks.edges(nodes, sizes, points, parts)
        for i in range(0, len(out), 50_000):
            a, b = zip(*out[i : i + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["src", "dst"])

    return rows.repartition("token").sortWithinPartitions("token", "node").mapInArrow(run, "src bigint, dst bigint")


# --- passes over the documents --------------------------------------------------------------------------------------


def _survey(docs: DataFrame) -> DataFrame:
    """(id, n, node) of every row, (part, n, node, point) of parts of sets, and (token, n) of frequent shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen, chunk, held = Shingler(), set(), [], 0
        names = ["id", "n", "node", "part", "point", "token"]

        def frequent() -> pa.RecordBatch:
            u, n = np.unique(np.concatenate(chunk), return_counts=True)
            u, n = u[n >= COMMON_AT], n[n >= COMMON_AT]
            none = pa.nulls(len(u), pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.array(n.astype(np.int64)), none, none, pa.nulls(len(u), pa.binary()), pa.array(u.view(np.int64))], names)

        for b in batches:
            sizes, nodes, parts = [], [], []
            for s in shingle.many(t.as_py() for t in b.column("text")):
                sizes.append(len(s))
                nodes.append(_node(s) if len(s) else None)
                if len(s) and nodes[-1] not in seen:
                    seen.add(nodes[-1])
                    parts += [(len(x), nodes[-1], part, pack(vectors([x])[0])) for _, part, x in parts_of(nodes[-1], s)]
                chunk.append(s)
                held += len(s)
                if held > CHUNK:
                    yield frequent()
                    chunk, held = [], 0
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), none, pa.nulls(len(sizes), pa.binary()), none], names)
            if parts:
                n, node, part, point = zip(*parts)
                none = pa.nulls(len(parts), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(part, pa.int64()), pa.array(point, pa.binary()), none], names)
        if chunk:
            yield frequent()

    return docs.mapInArrow(run, "id bigint, n bigint, node bigint, part bigint, point binary, token bigint")


def _prefixes(docs: DataFrame, common) -> DataFrame:
    """(token, part) for the first shingles of every part; tokens of each parting differ, and a task names a node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_sorted, rank = common.value
        shingle, seen = Shingler(), set()
        for b in batches:
            tokens, parts = [], []
            for s in shingle.many(t.as_py() for t in b.column("text")):
                if len(s) and (node := _node(s)) not in seen:
                    seen.add(node)
                    for k, part, x in parts_of(node, s):
                        p = prefix(x, tokens_sorted, rank)
                        tokens.append(p + np.full(1, k - 1, np.uint64) * _P[:1])
                        parts.append(np.full(len(p), part, np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(parts))], ["token", "part"])

    return docs.select("text").mapInArrow(run, "token bigint, part bigint")


def _bloom_places(ids: np.ndarray, size: int) -> list[np.ndarray]:
    x = _mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return [((x >> np.uint64(s)) % np.uint64(size)).astype(np.int64) for s in (0, 20)]


def _bloom(ids: DataFrame, n: int) -> np.ndarray:
    """A filter of some 16 bits for each of n ids, up to BLOOM_BITS: words of it are put together by the executors."""
    size = min(BLOOM_BITS, max(1 << 16, 1 << (16 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(_bloom_places(b.column("id").to_numpy(zero_copy_only=False), size)))
            slots, first = np.unique(at >> 6, return_index=True)
            masks = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(masks.view(np.int64), pa.int64())], ["slot", "mask"])

    words = ids.mapInArrow(run, "slot bigint, mask bigint").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words["slot"].to_numpy()] = words["mask"].to_numpy()
    return out


def _maybe_wanted(rows: DataFrame, words) -> DataFrame:
    """The rows whose id is in the filter, and a few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = words.value.view(np.uint64)
        for b in batches:
            kept = np.ones(b.num_rows, bool)
            for at in _bloom_places(b.column("id").to_numpy(zero_copy_only=False), 64 * len(bits)):
                kept &= (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            yield b.filter(pa.array(kept))

    return rows.mapInArrow(run, "id bigint, text string")


def _in_groups(rows: DataFrame, keys: list[str], work, ddl: str) -> DataFrame:
    """work(list of rows) for every group of keys; the rows of a group come together, in one task, one group at a time."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, out = None, [], []
        types = pa.schema([(x.split()[0], pa.int64()) for x in ddl.split(", ")])
        for b in batches:
            plain = [b.column(names.index(k)).to_pylist() for k in keys]
            for i in range(b.num_rows):
                key = tuple(c[i] for c in plain)
                if key != now:
                    if group:
                        out += work(group)
                    now, group = key, []
                    if len(out) > 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=types)
                        out = []
                group.append({n: b.column(j)[i] for j, n in enumerate(names)})
        if group:
            out += work(group)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=types)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, ddl)


def _sets(group: list[dict]) -> tuple[list[dict], list[int], list[np.ndarray]]:
    """Rows, nodes and sets of a group, a row a node; rows of another text under the node's id fall out."""
    seen, kept, nodes, sets = set(), [], [], []
    for r, x in zip(group, Shingler().many(r["text"].as_py() for r in group)):
        node = r["node"].as_py()
        role = (node, "query" in r and r["query"].as_py())
        if role not in seen and _node(x) == node:
            seen.add(role)
            kept.append(r)
            nodes.append(node)
            sets.append(x)
    return kept, nodes, sets


def _first_pass(group: list[dict]) -> list[tuple[int, int]]:
    """(node, root) in a leaf; the pivot, where it is, comes first and so is the root of what it is linked to."""
    rows, nodes, sets = _sets(sorted(group, key=lambda r: (not r["pivot"].as_py(), r["node"].as_py())))
    roots = join_local(sets) if sets else []
    return [(n, nodes[r]) for n, r in zip(nodes, roots)]


def _second_pass(group: list[dict]) -> list[tuple[int, int]]:
    """(node, node) edges between queries and a leaf's own nodes."""
    rows, nodes, sets = _sets(group)
    queries = [i for i, r in enumerate(rows) if r["query"].as_py()]
    if not queries or len(queries) == len(rows):
        return []
    roots = join_local(sets, queries, [r["root"].as_py() for r in rows])
    return [(nodes[i], nodes[r]) for i, r in enumerate(roots) if i != r]


def near_duplicate_groups(docs: DataFrame, *, leaf_nodes: int = LEAF_NODES, common: int = COMMON) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("id"), "text")
    survey = materialise(_survey(rows), "near-survey")
    members = survey.where(F.col("token").isNull() & F.col("part").isNull()).select("id", "n", "node")
    owners = members.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("id"))
    parts = survey.where(F.col("part").isNotNull()).groupBy("part").agg(*(F.first(c).alias(c) for c in ("node", "n", "point")))
    frequent = survey.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("n").alias("times"))
    top = most_frequent(frequent, "times", common).toArrow()
    tokens, times = top["token"].to_numpy().view(np.uint64), top["times"].to_numpy()
    by_rank = np.lexsort((tokens, times))
    rank = np.empty(len(tokens), np.int64)
    rank[by_rank] = np.arange(len(tokens))
    at = np.argsort(tokens)
    shared = spark.sparkContext.broadcast((tokens[at], rank[at]))

    # Only shingles that two parts share go on, with the points; most rows end here.
    extent = W.partitionBy("token")
    found = _prefixes(rows, shared).withColumns({"low": F.min("part").over(extent), "high": F.max("part").over(extent)})
    blocks = found.where("low < high").select("token", "part").join(parts, "part").select("token", "node", "part", "n", "point")
    groups = connected_components(materialise(_block_edges(blocks), "near-edges"))

    sizes = groups.groupBy("component").agg(F.count("*").alias("n_nodes"), F.min("node").alias("pivot"))
    placed = groups.join(sizes, "component").withColumn("leaves", F.ceil(F.col("n_nodes") / leaf_nodes).cast("bigint"))
    placed = materialise(placed.withColumn("leaf", F.pmod(F.xxhash64("node"), F.col("leaves"))), "near-groups")
    wanted = owners.join(placed, "node")
    sent = spark.sparkContext.broadcast(_bloom(wanted.select("id"), placed.count()))
    texts = _maybe_wanted(rows, sent).join(wanted, "id")
    texts = materialise(texts.select("node", "component", "leaves", "leaf", (F.col("node") == F.col("pivot")).alias("pivot"), "text"), "near-texts")

    extra = texts.where(F.col("pivot") & (F.col("leaves") > 1)).withColumn("leaf", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("leaves") - 1)))
    first = texts.unionByName(extra).select("component", "leaf", "node", "pivot", "text")
    first = materialise(_in_groups(first, ["component", "leaf"], _first_pass, "node bigint, root bigint"), "near-first")

    large = texts.where(F.col("leaves") > 1)
    roots = first.groupBy("node").agg(F.min("root").alias("root"))
    pivots = large.where("pivot").select("component", F.col("node").alias("pivot_node"))
    labelled = large.join(roots, "node").join(pivots, "component").withColumn("apart", F.col("root") != F.col("pivot_node"))
    # As many blocks as the nodes apart fill, so that a group with few of them is gone through once or so.
    shares = labelled.where("apart").groupBy("component").agg(F.ceil(F.count("*") / leaf_nodes).alias("blocks"))
    apart = labelled.where("apart").join(shares, "component").withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks"))).drop("blocks")
    blocks = apart.select("component", "block").distinct()
    asked = apart.withColumn("leaf", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("leaves") - 1)))
    asked = asked.select("component", "leaf", "block", "node", "root", F.lit(True).alias("query"), "text")
    held = labelled.join(blocks, "component").select("component", "leaf", "block", "node", "root", F.lit(False).alias("query"), "text")
    second = _in_groups(asked.unionByName(held), ["component", "leaf", "block"], _second_pass, "node bigint, root bigint")

    inside = first.select("node", "root").distinct()
    across = inside.join(large.select("node"), "node", "left_semi").unionByName(second)
    merged = connected_components(across, "node", "root")
    labels = inside.join(merged.withColumnRenamed("component", "whole"), "node", "left")
    labels = labels.groupBy("node").agg(F.min(F.coalesce("whole", "root")).alias("label"))

    known = owners.join(labels, "node", "left").select("node", "id", F.coalesce("label", "node").alias("label"))
    least = known.groupBy("label").agg(F.min("id").alias("component_id"))
    by_node = known.join(least, "label").select("node", "component_id")
    # Rows that share an id are one document.
    out = members.join(by_node, "node", "left").select("id", "n", F.coalesce("component_id", "id").alias("component_id"))
    back = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return out.select(back("id").alias("doc_id"), F.col("n").alias("n_shingles"), back("component_id").alias("component_id"))

"""Byte-level BPE: texts to token ids by a rank file, and ids back to bytes.

Pre-tokenisation uses no regular expression. Every code point has a class; a class moves a small automaton, and the
moves that can arise by running several are a finite set closed under composition, so a run over all texts of a batch
is a prefix scan over one byte a character with a multiplication table. From the states before, at and after a
character follows whether a piece begins there. The slices between go through a cache of merged pieces; their ids and
the byte at which each token begins come out as flat arrays. Decoding gathers the tokens' bytes.

What is cut is what the pattern of the rank files cuts: contractions, letters, digits and others with a space before
them at most, white space without its last character where something follows.

Defined cases: null is empty and has no ids; texts and pieces of any length are encoded whole (a long piece merges by a
heap); ties in rank go to the leftmost pair; equal rows are encoded each; an empty table gives an empty result; a
column named ``tokens`` (or ``decoded``) gives way to the result and all others pass through; ids outside the
vocabulary fail.
"""

from __future__ import annotations

import base64
import functools
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of text that are cut at once, and what the cache of pieces may hold.
CHUNK = 1 << 19
CACHE_BYTES, CACHE_PIECES = 1 << 22, 1 << 17
#: Pieces from here on are merged by a heap.
LONG_PIECE = 96
#: Stands for the rank of a pair that is no token.
NONE = 1 << 60

# Classes of characters: single letters matter after an apostrophe only.
SPACE, WHITE, LETTER, NUMBER, OTHER, APOSTROPHE, STMD, RV, E, L = range(10)
# States: what the piece that the last character belongs to may go on with.
BEGIN, IN_SPACE, IN_WHITE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, QUOTE, QUOTE_RV, QUOTE_L, CONTRACTED = range(10)


def _move(state: int, kind: int) -> int:
    """The state after a character of the class."""
    if kind == APOSTROPHE:  # one that begins a piece may begin a contraction
        return IN_OTHERS if state in (IN_SPACE, IN_OTHERS, QUOTE) else QUOTE
    if state == QUOTE and kind in (STMD, RV, L):
        return {STMD: CONTRACTED, RV: QUOTE_RV, L: QUOTE_L}[kind]
    if (state, kind) in ((QUOTE_RV, E), (QUOTE_L, L)):
        return CONTRACTED
    return {SPACE: IN_SPACE, WHITE: IN_WHITE, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}.get(kind, IN_LETTERS)


@functools.lru_cache(1)
def moves() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The classes' moves within the closed set, the same after a reset, the multiplication table, and the state that each ends in from BEGIN."""
    states = range(10)
    single = [tuple(_move(s, k) for s in states) for k in range(10)]
    fresh = [tuple(f[BEGIN] for _ in states) for f in single]
    after = lambda f, g: tuple(g[x] for x in f)
    known = list(dict.fromkeys([*single, *fresh]))
    at = 0
    while at < len(known):
        for g in (*single, *fresh):
            if (made := after(known[at], g)) not in known:
                known.append(made)
        at += 1
    place = {f: i for i, f in enumerate(known)}
    table = np.array([[place[after(f, g)] for g in known] for f in known], np.uint8)
    return np.array([place[f] for f in single], np.uint8), np.array([place[f] for f in fresh], np.uint8), table, np.array([f[BEGIN] for f in known], np.uint8)


def scan(elements: np.ndarray, width: int = 64) -> np.ndarray:
    """All prefix products of the elements: along rows of ``width``, then, by the same way, over the rows' products."""
    table = moves()[2]
    flat, size = table.ravel(), len(table)
    n = len(elements)
    if n <= width:
        out = elements.copy()
        for i in range(1, n):
            out[i] = table[out[i - 1], out[i]]
        return out
    rows = -(-n // width)
    grid = np.zeros((width, rows), np.uint8)  # column by column, so that a step works on neighbours in memory
    tail = np.full(rows * width - n, elements[-1], np.uint8)
    grid[:] = np.concatenate([elements, tail]).reshape(rows, width).T
    for i in range(1, width):
        grid[i] = flat[grid[i - 1].astype(np.uint16) * size + grid[i]]
    before = scan(grid[-1], width)[:-1].astype(np.uint16) * size
    grid[:, 1:] = flat[before[None, :] + grid[:, 1:]]
    return grid.T.ravel()[:n]


@functools.lru_cache(1)
def class_table() -> bytes:
    """The class of each code point as a byte, letters and numbers as the encoding library has them."""
    import tiktoken

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    single_bytes = {bytes([i]): i for i in range(256)}
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        encoding = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single_bytes, special_tokens={})
        out[list(map(ord, encoding.decode(encoding.encode_ordinary(every))))] = kind
    for kind, chars in ((SPACE, " "), (APOSTROPHE, "'"), (STMD, "stmd"), (RV, "rv"), (E, "e"), (L, "l")):
        out[list(map(ord, chars))] = kind
    return out.tobytes()


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and where each begins; those of broken sequences are of no class of their own."""
    lead = (data & 0xC0) != 0x80
    if len(data):
        lead[0] = True
    at = np.flatnonzero(lead)
    first = data[at]
    points = first.astype(np.int32)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        wide = np.flatnonzero((first >= low) & (first < high))
        value = (first[wide] & mask).astype(np.int32)
        for k in range(1, more + 1):
            value = (value << 6) | (padded[at[wide] + k] & 0x3F)
        points[wide] = np.minimum(value, 0x10FFFF)
    return points, at


def piece_starts(data: np.ndarray, text_starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The bytes at which pieces begin, in texts that lie one after another and begin at the given bytes."""
    if not len(data):
        return np.zeros(0, np.int64)
    single, fresh, _, ends = moves()
    points, at = code_points(data)
    kind = classes[points]
    first = np.zeros(len(data) + 1, bool)
    first[text_starts] = True
    first = first[:-1][at]
    state = ends[scan(np.where(first, fresh[kind], single[kind]))]
    before = np.concatenate([[BEGIN], state[:-1]])
    before[first] = BEGIN
    state_next = np.concatenate([state[1:], [BEGIN]])
    state_next[:-1][first[1:]] = BEGIN
    white, white_next, white_before = ((s == IN_SPACE) | (s == IN_WHITE) for s in (state, state_next, before))
    # White space begins a piece with its first character, and once more with its last where something follows.
    begins = white & (~white_before | (~white_next & (state_next != BEGIN)))
    # The rest goes on with a space, with its own kind, or with a contraction that is or becomes whole.
    same = ((before == IN_LETTERS) | (before == QUOTE_RV) | (before == QUOTE_L)) & (state == IN_LETTERS)
    same |= (before == IN_NUMBERS) & (state == IN_NUMBERS) | ((before == IN_OTHERS) | (before == QUOTE)) & (state == IN_OTHERS)
    pending = (state == QUOTE_RV) | (state == QUOTE_L)
    same |= (state == CONTRACTED) | pending & (state_next == CONTRACTED)
    begins |= ~white & ~same & (before != IN_SPACE)
    return at[begins | first]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: as a whole if it is a token, else neighbours joined by lowest rank, the leftmost first."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) >= LONG_PIECE:
        return _merge_long(piece, ranks)
    get, cuts = ranks.get, list(range(len(piece) + 1))
    pairs = [get(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) < NONE:
        i = pairs.index(least)
        del pairs[i], cuts[i + 1]
        if i:
            pairs[i - 1] = get(piece[cuts[i - 1] : cuts[i + 1]], NONE)
        if i < len(pairs):
            pairs[i] = get(piece[cuts[i] : cuts[i + 2]], NONE)
    return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs and a chain of parts: (rank, left, end) stands while both parts still end there."""
    n = len(piece)
    end = list(range(1, n + 1))  # where the part that begins here ends; 0 once it is joined to another
    prior = list(range(-1, n))  # the part before the one that begins here
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n and (r := ranks.get(piece[i : end[end[i]]])) is not None:
            heapq.heappush(heap, (r, i, end[end[i]]))

    while heap:
        _, i, stop = heapq.heappop(heap)
        if not end[i] or end[i] >= n or end[end[i]] != stop or end[i] == stop:
            continue
        end[end[i]], end[i] = 0, stop
        prior[stop] = i
        offer(prior[i])
        offer(i)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Pieces(dict):
    """Piece to its ids, as bytes; a generation that outgrows its bounds becomes the older one, which is looked up once a piece."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.older, self.held = ranks, {}, 0

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("i", merge(piece, self.ranks)).tobytes()
        self.held += len(piece)
        self[piece] = ids
        return ids

    def tidy(self) -> None:
        if self.held > CACHE_BYTES or len(self) > CACHE_PIECES:
            self.older, self.held = dict(self), 0
            self.clear()


def _gather(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices source[start : start + length], one after another."""
    ends = np.cumsum(lengths)
    n = int(ends[-1]) if len(ends) else 0
    return source[np.repeat(starts - ends + lengths, lengths) + np.arange(n)]


class Codec:
    """A vocabulary with its tables; one a process and vocabulary."""

    def __init__(self, ranks_file: bytes, classes: bytes):
        lines = (x.split() for x in ranks_file.splitlines() if x)
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.classes = np.frombuffer(classes, np.uint8)
        self.pieces = Pieces(self.ranks)
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, i in self.ranks.items():
            tokens[i] = token
        self.known = np.zeros(size, bool)
        self.known[list(self.ranks.values())] = True
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, data: bytes, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, the byte in data at which each token begins, and the number of ids before each text and in all."""
        self.pieces.tidy()
        cuts = piece_starts(np.frombuffer(data, np.uint8), text_starts, self.classes)
        bounds = cuts.tolist()
        found = list(map(self.pieces.__getitem__, [data[a:b] for a, b in zip(bounds, [*bounds[1:], len(data)])]))
        before = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)])
        ids = np.frombuffer(b"".join(found), np.int32)
        lengths = self.lengths[ids]
        return ids, np.cumsum(lengths) - lengths, before[np.searchsorted(cuts, np.append(text_starts, len(data)))]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids' bytes one after another, and the byte at which each begins (and the last ends)."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        lengths = self.lengths[ids]
        return _gather(self.bytes, self.starts[ids], lengths), np.concatenate([[0], np.cumsum(lengths)])


@functools.lru_cache(4)
def _codec(ranks_file: bytes, classes: bytes) -> Codec:
    return Codec(ranks_file, classes)


def vocabulary_file(path: str | None = None) -> bytes:
    """The bytes of a rank file, read on the driver (about 1 MB); of the installed one without a path."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        return f.read()


def _spans(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of ``most`` in all, or of one row."""
    ends = np.cumsum(sizes)
    a, before = 0, 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, before + most, "right")))
        yield a, b
        a, before = b, ends[b - 1]


def _with_column(batch: pa.RecordBatch, schema: pa.Schema, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], schema=schema)


def _appended(rows: DataFrame, name: str, kind: str, value, batch_of) -> DataFrame:
    """rows without a column of that name, and with the one that batch_of makes of every batch (and value, which is broadcast)."""
    rows = rows.drop(name)
    held = rows.sparkSession.sparkContext.broadcast(value)
    return rows.mapInArrow(lambda batches: (out for b in batches for out in batch_of(b, held.value)), _ddl(rows, name, kind))


def _ddl(rows: DataFrame, name: str, kind: str):
    from pyspark.sql.types import StructType

    return StructType([*rows.schema.fields, *StructType.fromDDL(f"{name} {kind}").fields])


def encode_texts(docs: DataFrame, text_col: str = "text", *, vocabulary: str | None = None, offsets: bool = True) -> DataFrame:
    """docs with ``tokens``: ids, and (with offsets) the byte of the text at which each token begins."""
    at = docs.columns.index(text_col)
    ints = pa.list_(pa.int32())
    kind = pa.struct([("ids", ints), ("starts", ints)] if offsets else [("ids", ints)])

    def batches_of(batch: pa.RecordBatch, files: tuple[bytes, bytes]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*files)
        schema = pa.schema([*batch.schema, pa.field("tokens", kind)])
        column = batch.column(at)
        column = (column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column).fill_null("")
        for a, b in _spans(np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]), CHUNK):
            bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset + a : column.offset + b + 1]
            data = column.buffers()[2].slice(bounds[0], bounds[-1] - bounds[0]).to_pybytes() if bounds[-1] > bounds[0] else b""
            starts = bounds - bounds[0]
            ids, begins, per_text = codec.encode(data, starts[:-1])
            lists = [pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), pa.array(ids, pa.int32()))]
            if offsets:
                begins = begins - np.repeat(starts[:-1], np.diff(per_text))
                lists.append(pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), pa.array(begins, pa.int32())))
            yield _with_column(batch.slice(a, b - a), schema, pa.StructArray.from_arrays(lists, fields=list(kind)))

    struct = "struct<ids: array<int>, starts: array<int>>" if offsets else "struct<ids: array<int>>"
    return _appended(docs, "tokens", struct, (vocabulary_file(vocabulary), class_table()), batches_of)


def decode_ids(rows: DataFrame, ids_col: str = "ids", *, vocabulary: str | None = None) -> DataFrame:
    """rows with ``decoded``, the bytes of the ids; null ids are empty."""
    at = rows.drop("decoded").columns.index(ids_col)

    def batches_of(batch: pa.RecordBatch, files: tuple[bytes, bytes]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*files)
        schema = pa.schema([*batch.schema, pa.field("decoded", pa.binary())])
        column = batch.column(at)
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        for a, b in _spans(sizes, CHUNK // 2):
            ids = column.slice(a, b - a).flatten().to_numpy()  # leaves out what stands under nulls
            data, begins = codec.decode(ids)
            bounds = begins[np.concatenate([[0], np.cumsum(sizes[a:b])])]
            out = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
            yield _with_column(batch.slice(a, b - a), schema, out)

    return _appended(rows, "decoded", "binary", (vocabulary_file(vocabulary), b""), batches_of)


def token_text(text: Column, starts: Column, token: Column | int) -> Column:
    """The bytes of a text that its token of that number (from 0) stands for, by the starts kept on encoding."""
    data = text.cast("binary")
    token = F.lit(token) if isinstance(token, int) else token
    begin, end = F.get(starts, token), F.coalesce(F.get(starts, token + 1), F.octet_length(data))
    return F.substring(data, begin + 1, end - begin)

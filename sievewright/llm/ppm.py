"""Scoring by prediction by partial matching (PPM) over bytes, with a unigram word model beside it.

The model is a trie of byte contexts up to ``ORDER`` bytes long. A symbol seen in the longest observed context has
probability (count - 1/2) / total; otherwise the escape, distinct / (2 total), leads to the context one byte shorter,
where all symbols already refused are excluded from counts and total, and so on down to equal shares of what is left.
``code_length`` walks such a trie text by text: adaptively (it learns as it goes) or with given counts.

Over a corpus nothing is walked and nothing is capped. A position's probability depends on its gram alone, the context
and the symbol, so it is worked out once for each distinct gram of the corpus:

1. Each task counts the distinct grams and words of its texts, and Spark adds them up. Grams that only held-out texts
   have are listed too, with a count of 0.
2. Grams are dealt by the last two bytes of their context; all contexts of two bytes and more nest in such a part.
   Shorter ones (at most 65,792 counts, whatever the corpus) go along as a broadcast. So each part works out the log
   probabilities of its grams for itself (``blend``).
3. Texts are scored by lookups. The ``head_grams`` and ``head_words`` most frequent ones (parameters, some 12 and 40
   bytes each) are broadcast; what a text has of the others goes through one shuffle join, a row for each text and gram
   or word. These are rare by choice, so no key is a hot one.

A task holds the grams and words it has counted, up to ``HELD_GRAMS`` and ``HELD_WORDS`` before it passes them on, and
looks at some ``CHUNK`` bytes of text at a time, however long one is and however many a batch has. Two tasks of an
executor thus stay within a few hundred MB besides the broadcast.

Defined cases: null or empty text has one token, the end; rows with a null id are held out; repeated rows each get
their row; texts of any length are scored whole, in time linear in their length; other columns of the input play no
part; an empty table gives an empty result; with no training texts all word counts are 0 and every byte has
probability 1/256.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.frequent import most_frequent
from ..session import materialise

ORDER = 5
END = b" end"
#: Bytes of text looked at in one go.
CHUNK = 2_000_000
#: Largest table for numbering grams by direct address, at five bytes a cell; beyond it they are sorted.
CELLS = 1 << 24
HEAD_GRAMS, HEAD_WORDS = 1_000_000, 400_000
#: Distinct grams and words a task holds before it passes its counts on, at some 64 bytes (while they are sorted) and 150.
HELD_GRAMS, HELD_WORDS = 1_000_000, 300_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0


# --- the trie, walked ---------------------------------------------------------------------------------------------


def train_trie(texts: list[bytes], order: int = ORDER) -> dict[bytes, Counter]:
    trie: dict[bytes, Counter] = defaultdict(Counter)
    for t in texts:
        data = b"\0" * order + t + b"\0"
        for i in range(order, len(data)):
            for k in range(order + 1):
                trie[data[i - k : i]][data[i]] += 1
    return trie


def code_length(text: bytes, trie: dict[bytes, Counter] | None = None, order: int = ORDER) -> float:
    """log10 probability of a text and its end; without a trie the model starts empty and learns from the text itself."""
    adaptive, total = trie is None, 0.0
    trie = defaultdict(Counter) if adaptive else trie
    data = b"\0" * order + text + b"\0"
    for i in range(order, len(data)):
        symbol, refused = data[i], set()
        for k in range(order, -1, -1):
            counts = trie.get(data[i - k : i])
            left = {s: n for s, n in counts.items() if s not in refused} if counts else {}
            if not left:
                continue
            weight, cut = sum(left.values()), 0.5 if len(refused) + len(left) < 256 else 0.0
            if symbol in left:
                total += math.log10((left[symbol] - cut) / weight)
                break
            total += math.log10(0.5 * len(left) / weight)
            refused |= left.keys()
        else:
            total -= math.log10(256 - len(refused))
        if adaptive:
            for k in range(order + 1):
                trie[data[i - k : i]][symbol] += 1
    return total


# --- grams of texts -----------------------------------------------------------------------------------------------


def _low(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def slices(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch in lower case, so many at a time that they have about size bytes; each with the first one's place."""
    at, held, n = 0, [], 0
    for t in column:
        held.append(_low(t.as_py()))
        n += len(held[-1])
        if n >= size:
            yield at, held
            at, held, n = at + len(held), [], 0
    if held:
        yield at, held


def segments(texts: Iterable[bytes], order: int = ORDER, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, places where each segment begins, number of its text), about chunk bytes at a time.

    A text has order zero bytes in front and one behind; a long one is cut into segments that overlap by order bytes,
    so every gram of order + 1 bytes lies in exactly one of them.
    """
    held, owners, size = [], [], 0

    def whole() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = np.cumsum([0, *(len(x) for x in held[:-1])])
        return np.frombuffer(b"".join(held), np.uint8), starts, np.array(owners)

    for number, text in enumerate(texts):
        data = b"\0" * order + text + b"\0"
        for at in range(0, len(data) - order, chunk):
            piece = data[at : at + chunk + order]
            if size and size + len(piece) > chunk + order:
                yield whole()
                held, owners, size = [], [], 0
            held.append(piece)
            owners.append(number)
            size += len(piece)
    if held:
        yield whole()


def _numbered(keys: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each key among the distinct ones, and these."""
    if cells > CELLS:
        known, rank = np.unique(keys, return_inverse=True)
        return rank.astype(np.int32), known
    seen = np.zeros(cells, bool)
    seen[keys] = True
    known = np.flatnonzero(seen)
    rank = np.empty(cells, np.int32)
    rank[known] = np.arange(len(known), dtype=np.int32)
    return rank[keys], known


def grams_of(b: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For every place with order more bytes behind it, the number of the gram there; and the grams by number."""
    n = len(b) - order
    seen = np.zeros(256, bool)
    seen[b] = True
    alphabet = np.flatnonzero(seen)
    width = len(alphabet)
    symbol = np.zeros(256, np.int32)
    symbol[alphabet] = np.arange(width)
    s = symbol[b]
    ids, codes = s[:n], alphabet.astype(np.int64)
    for j in range(1, order + 1):
        cells = len(codes) * width
        keys = (ids if cells < 1 << 31 else ids.astype(np.int64)) * width
        keys += s[j : n + j]
        if j < order and cells <= 1 << 18:  # few enough to go on without leaving any out
            ids, codes = keys, ((codes[:, None] << 8) | alphabet[None, :]).ravel()
            continue
        ids, known = _numbered(keys, cells)
        codes = (codes[known // width] << 8) | alphabet[known % width]
    return ids, codes


def _inside(n: int, starts: np.ndarray, order: int) -> np.ndarray:
    """Which of n places begin a gram within one segment."""
    out = np.ones(n, bool)
    for k in range(1, order + 1):
        out[starts[1:] - k] = False
    return out


# --- the trie, by gram --------------------------------------------------------------------------------------------


def _first_of_runs(codes: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])


def _looked_up(known: np.ndarray, values: np.ndarray, sought: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(sought))
    at = np.minimum(np.searchsorted(known, sought), len(known) - 1)
    return np.where(known[at] == sought, values[at], 0.0)


class Shorter:
    """Counts in contexts of no and of one byte; at most 65,792 of them."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray):
        """pairs: sorted codes of a byte and the one after it."""
        self.codes, self.n = {1: pairs}, {1: counts.astype(float)}
        self.codes[0], back = np.unique(pairs & 255, return_inverse=True)
        self.n[0] = np.bincount(back, weights=self.n[1], minlength=len(self.codes[0]))
        self.contexts, self.total, self.distinct = {}, {}, {}
        for k in (0, 1):
            self.contexts[k], back = np.unique(self.codes[k] >> 8, return_inverse=True)
            self.total[k] = np.bincount(back, weights=self.n[k], minlength=len(self.contexts[k]))
            self.distinct[k] = np.bincount(back, weights=self.n[k] > 0, minlength=len(self.contexts[k]))


def blend(grams: np.ndarray, counts: np.ndarray, shorter: Shorter, order: int = ORDER) -> np.ndarray:
    """log10 probability of the last byte of each gram after the others.

    grams: sorted and distinct; together they must have all training grams whose contexts end in the same two bytes.
    Those with a count of 0 are only asked for. As every symbol seen in a context was seen in the shorter ones too,
    what a longer context refuses is fully told by its number of symbols and by their counts one level below.
    """
    if not len(grams):
        return np.zeros(0)
    n, total, distinct, below = {}, {}, {}, {}
    codes, count, back = grams, counts.astype(float), np.arange(len(grams))
    for k in range(order, -1, -1):
        context = np.cumsum(np.r_[0, (codes[1:] >> 8) != (codes[:-1] >> 8)])
        first = _first_of_runs(codes >> 8)
        n[k] = count[back]
        if k >= 2:
            total[k] = np.add.reduceat(count, first)[context][back]
            distinct[k] = np.add.reduceat((count > 0).astype(float), first)[context][back]
        else:
            total[k], distinct[k] = (_looked_up(shorter.contexts[k], x[k], codes >> 8)[back] for x in (shorter.total, shorter.distinct))
        if k:
            cut, into = np.unique(codes & ((1 << 8 * k) - 1), return_inverse=True)
            fewer = np.bincount(into, weights=count, minlength=len(cut)) if k > 2 else _looked_up(shorter.codes[k - 1], shorter.n[k - 1], cut)
            below[k] = np.add.reduceat(np.where(count > 0, fewer[into], 0.0), first)[context][back]
            codes, count, back = cut, fewer, into[back]
    out, found = np.zeros(len(grams)), np.zeros(len(grams), bool)
    refused, mass = np.zeros(len(grams)), np.zeros(len(grams))
    for k in range(order, -1, -1):
        left = distinct[k] - refused
        live = ~found & (left > 0)
        weight, cut = total[k] - mass, np.where(distinct[k] < 256, 0.5, 0.0)
        hit, escape = live & (n[k] > 0), live & (n[k] == 0)
        out[hit] += np.log10((n[k][hit] - cut[hit]) / weight[hit])
        out[escape] += np.log10(0.5 * left[escape] / weight[escape])
        found |= hit
        if k:
            refused, mass = distinct[k], below[k]
    out[~found] -= np.log10(256 - distinct[0][~found])
    return out


# --- passes over the documents ------------------------------------------------------------------------------------


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """First place and end of every run of equal values."""
    cuts = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True])
    return zip(cuts[:-1].tolist(), cuts[1:].tolist())


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes and the sums of their counts; empties the lists, so that no part is held twice."""
    every, n = np.concatenate(codes), np.concatenate(counts)
    codes.clear()
    counts.clear()
    at = np.argsort(every, kind="stable")
    every, n = every[at], n[at]
    first = _first_of_runs(every)
    return every[first], np.add.reduceat(n, first)


def count_corpus(docs: DataFrame) -> DataFrame:
    """(word, gram, n) of (held_out, text): each word (gram null) and gram (word null), and how often training texts hold it, 0 included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        codes: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def of_words() -> Iterator[pa.RecordBatch]:
            keys, n = list(words.keys()), list(words.values())
            words.clear()
            for i in range(0, len(keys), 100_000):
                k = pa.array(keys[i : i + 100_000], pa.binary())
                yield pa.RecordBatch.from_arrays([k, pa.nulls(len(k), pa.int64()), pa.array(n[i : i + 100_000], pa.int64())], names)

        def of_grams() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(codes[0]) if codes else 0, 100_000):
                k = pa.array(codes[0][i : i + 100_000])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.binary()), k, pa.array(counts[0][i : i + 100_000])], names)

        def fold() -> None:
            if len(codes) > 1:
                u, n = _summed(codes, counts)
                codes[:], counts[:] = [u], [n]

        for b in batches:
            apart = b.column("held_out").to_numpy(zero_copy_only=False)
            for first, texts in slices(b.column("text")):
                out = apart[first : first + len(texts)]
                for t, aside in zip(texts, out):
                    if not aside:
                        words.update(t.split())
                        words[END] += 1
                if len(words) > HELD_WORDS:
                    yield from of_words()
                for data, starts, owners in segments(texts):
                    ids, known = grams_of(data)
                    kept = ids[_inside(len(ids), starts, ORDER)]
                    every = np.bincount(kept, minlength=len(known))
                    n = every
                    if out[owners].any():
                        n = np.bincount(kept[np.repeat(~out[owners], np.diff(np.r_[starts, len(data)]) - ORDER)], minlength=len(known))
                    codes.append(known[every > 0])
                    counts.append(n[every > 0].astype(np.int64))
                    if sum(map(len, codes)) > 1.5 * HELD_GRAMS:
                        fold()
                        if len(codes[0]) > HELD_GRAMS:
                            yield from of_grams()
                            codes.clear()
                            counts.clear()
        yield from of_words()
        fold()
        yield from of_grams()

    names = ["word", "gram", "n"]
    return docs.select("held_out", "text").mapInArrow(count, "word binary, gram bigint, n bigint")


def gram_logs(grams: DataFrame) -> DataFrame:
    """(gram, n, value) from (gram, n), n the count in all training texts: the log10 probability of the gram's last byte."""
    pairs = grams.where(F.col("n") > 0).groupBy(F.col("gram").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("n").alias("n")).orderBy("pair").toArrow()
    sent = grams.sparkSession.sparkContext.broadcast(Shorter(pairs["pair"].to_numpy(), pairs["n"].to_numpy()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, key = [], 0, None

        def done() -> pa.RecordBatch:
            codes, n = (np.concatenate(x) for x in zip(*held))
            at = np.argsort(codes, kind="stable")
            codes, n = codes[at], n[at]
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n), pa.array(blend(codes, n, sent.value).astype(np.float32))], ["gram", "n", "value"])

        for b in batches:
            codes, n = b.column("gram").to_numpy(), b.column("n").to_numpy()
            ends = (codes >> 8) & 0xFFFF
            for low, high in _runs(ends):
                if ends[low] != key and size > 200_000:  # parts are never cut, but small ones go together
                    yield done()
                    held, size = [], 0
                held.append((codes[low:high], n[low:high]))
                key, size = ends[low], size + high - low
        if held:
            yield done()

    dealt = grams.withColumn("ends", F.shiftright("gram", 8).bitwiseAND(0xFFFF)).repartition("ends").sortWithinPartitions("ends")
    return dealt.select("gram", "n").mapInArrow(work, "gram bigint, n bigint, value float")


def _gram_key(gram: int) -> bytes:
    """A word that no text can hold, and neither the end nor a text's own."""
    return b" g" + gram.to_bytes(ORDER + 1, "big")


class Scorer:
    """The frequent grams' and words' probabilities, and texts' scores by them."""

    def __init__(self, grams: np.ndarray, logs: np.ndarray, words: dict[bytes, float]):
        """grams: sorted."""
        self.grams, self.logs, self.words = grams, logs, words

    def of_words(self, text: bytes) -> tuple[int, int, float, Counter]:
        """Tokens, how many of them are frequent, the sum of their logs; and the other words."""
        tokens = text.split()
        tokens.append(END)
        got = [v for v in map(self.words.get, tokens) if v is not None]
        rest = Counter(w for w in tokens if w not in self.words) if len(got) < len(tokens) else Counter()
        return len(tokens), len(got), math.fsum(got), rest

    def of_grams(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each text's sum of logs over its frequent grams; of the others: the text's number, the gram, how often."""
        out, others = np.zeros(len(texts)), []
        for data, starts, owners in segments(texts):
            ids, known = grams_of(data)
            at = np.minimum(np.searchsorted(self.grams, known), max(len(self.grams) - 1, 0))
            here = self.grams[at] == known if len(self.grams) else np.zeros(len(known), bool)
            values = np.where(here, self.logs[at] if len(self.grams) else 0.0, 0.0).astype(np.float64)[ids]  # sums of doubles, however the texts are sliced
            inside = _inside(len(ids), starts, ORDER)
            values[~inside] = 0.0
            np.add.at(out, owners, np.add.reduceat(values, starts))
            rare = np.flatnonzero(~here[ids] & inside)
            if len(rare):
                owner = owners[np.searchsorted(starts, rare, side="right") - 1]
                pair, times = np.unique(owner.astype(np.int64) * len(known) + ids[rare], return_counts=True)
                others.append((pair // len(known), known[pair % len(known)], times))
        found = [np.concatenate(x) for x in zip(*others)] if others else [np.zeros(0, np.int64)] * 3
        return out, *found


def score_documents(docs: DataFrame, *, head_grams: int = HEAD_GRAMS, head_words: int = HEAD_WORDS) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    counts = materialise(count_corpus(rows).groupBy("word", "gram").agg(F.sum("n").alias("n")), "lm-counts")
    words = counts.where(F.col("word").isNotNull()).select("word", "n")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, denominator = int(totals["n"]), totals["n"] + 0.1 * (totals["v"] + 1)
    head = most_frequent(words, "n", head_words).toArrow()
    known = dict(zip(head["word"].to_pylist(), np.log10((head["n"].to_numpy() + 0.1) / denominator).tolist()))
    logs = materialise(gram_logs(counts.where(F.col("gram").isNotNull()).select("gram", "n")), "lm-grams")
    first = most_frequent(logs, "n", head_grams).select("gram", "value").toArrow()
    grams, values = first["gram"].to_numpy(), first["value"].to_numpy()
    at = np.argsort(grams)
    sent = spark.sparkContext.broadcast(Scorer(grams[at], values[at], known))
    key = F.concat(F.lit(b" g"), F.unhex(F.lpad(F.hex("gram"), 2 * ORDER + 2, "0")))
    lookup = words.select("word", "n", F.lit(None).cast("float").alias("value")).unionByName(logs.select(key.alias("word"), F.lit(None).cast("bigint").alias("n"), "value"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for first, texts in slices(b.column("text")):
                yield from of_texts(b.slice(first, len(texts)), texts, row)
                row += len(texts)

    def of_texts(b: pa.RecordBatch, texts: list[bytes], row: int) -> Iterator[pa.RecordBatch]:
        scorer = sent.value
        sums, owners, rare, often = scorer.of_grams(texts)
        n_tokens, n_known, base, others = zip(*map(scorer.of_words, texts))
        n, keys = len(texts), np.arange(row, row + len(texts))
        # A text's own row has a key that no text can hold, and so one that spreads over all tasks.
        own = [pa.array([b" %d" % k for k in keys.tolist()], pa.binary()), pa.array(keys), b.column("doc_id"), b.column("held_out"), pa.nulls(n, pa.int64())]
        yield pa.RecordBatch.from_arrays([*own, pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(sums)], names)
        at = np.repeat(np.arange(n), [len(x) for x in others])
        at = np.concatenate([at, owners]).astype(np.int64)
        sought = [w for x in others for w in x] + [_gram_key(g) for g in rare.tolist()]
        times = np.concatenate([np.array([k for x in others for k in x.values()], np.int64), often])
        for i in range(0, len(at), 50_000):
            part = at[i : i + 50_000]
            zeros = pa.array(np.zeros(len(part), np.int64))
            of_text = [pa.array(keys[part]), pa.nulls(len(part), b.column("doc_id").type), pa.nulls(len(part), pa.bool_()), pa.array(times[i : i + 50_000])]
            yield pa.RecordBatch.from_arrays([pa.array(sought[i : i + 50_000], pa.binary()), *of_text, zeros, zeros, pa.array(np.zeros(len(part))), pa.array(np.zeros(len(part)))], names)

    names = ["word", "row", "doc_id", "held_out", "times", "n_tokens", "n_known", "base", "score"]
    ddl = f"word binary, row bigint, doc_id {kind}, held_out boolean, times bigint, n_tokens bigint, n_known bigint, base double, score double"
    scored = rows.mapInArrow(score, ddl).join(lookup, "word", "left")
    count = F.coalesce("n", F.lit(0))
    of_word = F.when(F.col("times").isNull() | F.col("value").isNotNull(), F.lit(0.0)).otherwise(F.col("times") * F.log10((count + F.lit(0.1)) / F.lit(denominator)))
    of_gram = F.coalesce(F.col("times") * F.col("value").cast("double"), F.lit(0.0))
    return (
        scored.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.bool_or("held_out").alias("held_out"),
            F.sum("n_tokens").alias("n_tokens"),
            F.sum(F.col("n_known") + F.when(count > 0, F.coalesce("times", F.lit(0))).otherwise(F.lit(0))).alias("n_known"),
            F.lit(n_all).cast("bigint").alias("train_tokens"),
            F.sum(F.col("base") + of_word).alias("base_score"),
            F.sum(F.col("score") + of_gram).alias("score"),
        )
        .drop("row")
    )

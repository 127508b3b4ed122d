"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens. A window is one training sequence. In each round (window) a queue earns a quantum,
its share of the window, and spends whole tokens of what it has earned; what it couldn't spend, less than a token at
each split below, is its deficit and is carried to the next window. Splitting a window's tokens down a fixed binary
tree of queues keeps every allotment monotone and their sum exactly the window:

    of the first m tokens that reach a node, the left subtree takes floor(m * weight_left / weight_node)

so the deficit at a node after m tokens is the fraction dropped by that floor. It depends on m alone. Any task can
therefore start at any window with exactly the deficits that a sequential run would carry there: that is how they
cross partitions. When a queue runs dry its weight leaves the tree and the others go on with their deficits reset.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from itertools import accumulate, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.runtime import holds, ship, turn_to
from graphloom.storage import materialise

WINDOW = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker remembers, at about 45 bytes each.
REMEMBERED = 800_000
#: Bytes of text that are tokenised at a time (a longer text is taken by itself).
BATCH_BYTES = 2 << 20

# ---------------------------------------------------------------------------------------------------- tokenising

#: Keys of the two hashes that tell words apart.
_KEYS = ("graphloom-words0", "graphloom-words1")


class Words:
    """The ids of words that were met, in arrays: about 45 bytes a word.

    A word is known by two keyed 64-bit hashes. Beyond ``most`` words, those that weren't met again since the last
    clearing go.
    """

    def __init__(self, path: str, most: int) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.most = Tokenizer.from_file(path), most
        letters = [c for c in map(chr, range(128, 256)) if c.isalpha()]
        spelt = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelt = str.maketrans({c: spelt.pre_tokenize_str(c)[0][0] for c in letters})
        self.marks: dict[str, list[int]] = {}
        self.clear()

    def clear(self) -> None:
        self.key, self.check = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.start, self.length, self.used = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool)
        self.pool, self.filled = np.empty(1 << 16, np.uint32), 0

    @staticmethod
    def hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = words.to_numpy(zero_copy_only=False)
        return tuple(pd.util.hash_array(plain, hash_key=k, categorize=False) for k in _KEYS)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Where each word is, -1 for unknown ones; ``key`` in ascending order."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (self.check[at] == check), at, -1)

    def add(self, key: np.ndarray, check: np.ndarray, length: np.ndarray, ids: np.ndarray) -> None:
        """New words, in ascending order of ``key``."""
        if self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.filled], np.empty(max(len(ids), len(self.pool) // 2), np.uint32)])
        self.pool[self.filled : self.filled + len(ids)] = ids
        at = np.searchsorted(self.key, key)
        self.key, self.check = np.insert(self.key, at, key), np.insert(self.check, at, check)
        self.start = np.insert(self.start, at, np.cumsum(length, dtype=np.int64) - length + self.filled)
        self.length, self.used = np.insert(self.length, at, length), np.insert(self.used, at, False)
        self.filled += len(ids)

    def shrink(self) -> None:
        keep = np.flatnonzero(self.used) if self.used.sum() <= self.most // 2 else np.empty(0, np.int64)
        ids, length = _ranges(self.pool, self.start[keep], self.length[keep]), self.length[keep]
        self.key, self.check, self.length = self.key[keep], self.check[keep], length
        self.start, self.used = np.cumsum(length, dtype=np.int64) - length, np.zeros(len(keep), bool)
        self.pool, self.filled = ids, len(ids)

    def look_up(self, words: pa.Array) -> np.ndarray:
        """The places of distinct words, all of which are known from now on."""
        key, check = self.hashes(words)
        order = np.argsort(key)
        key, check = key[order], check[order]
        at = self.find(key, check)
        new = np.flatnonzero(at < 0)
        self.used[at[at >= 0]] = True
        if len(new):
            if len(self.key) + len(new) > self.most:
                self.shrink()
                new = np.flatnonzero(self.find(key, check) < 0)
            self.add(key[new], check[new], *self.learn(words.take(pa.array(order[new]))))
            at = self.find(key, check)
            if at.min() < 0:
                raise ValueError("two words share a 64-bit hash")
        out = np.empty(len(at), np.int64)
        out[order] = at
        return out

    def learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all their ids).

        A run of letters is a piece of its own for the tokenizer, and so is a run of marks; so the ids of letters with
        marks behind them are those of the letters and then those of the marks. Words are lower-cased, as the tokenizer
        does, where all their characters are Latin-1; others are left to it whole.
        """
        simple = _latin(words)
        split, whole, spelt, marks = self.whole.model.tokenize, self.whole.encode, self.spelt, self.marks
        ids: list[int] = []
        length = []
        for word, plain in zip(pc.if_else(simple, pc.utf8_lower(words), words).to_pylist(), simple.to_pylist(), strict=True):
            base = word.rstrip(_MARKS)
            if plain and base.isalpha():
                got = [t.id for t in split(base if base.isascii() else base.translate(spelt))]
                if len(base) < len(word):
                    tail = word[len(base) :]
                    if tail not in marks:
                        if len(marks) > 10_000:
                            marks.clear()
                        marks[tail] = whole(tail, add_special_tokens=False).ids
                    got += marks[tail]
            else:
                got = whole(word, add_special_tokens=False).ids
            ids += got
            length.append(len(got))
        return np.array(length, np.int32), np.array(ids, np.uint32)


#: Marks that don't begin a piece such as "'s" with letters.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _ranges(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """pool[start : start + length] of each range, one after the other."""
    ends = np.cumsum(length, dtype=np.int64)
    return pool[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]


def _latin(words: pa.Array) -> pa.Array:
    """Whether all characters are below U+0100: no byte of UTF-8 is above 0xC3."""
    if not len(words):
        return pa.array([], pa.bool_())
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    high = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] > 0xC3 if words.buffers()[2] else np.empty(0, bool)
    n = np.concatenate([[0], np.cumsum(high)])
    return pa.array(n[offsets[1:] - offsets[0]] == n[offsets[:-1] - offsets[0]])


_words: dict[str, Words] = {}


def _known(path: str, most: int) -> Words:
    if path not in _words:
        _words[path] = Words(path, most)
        holds("tokens", _words.clear)
    return _words[path]


def encode(texts: pa.Array, path: str, remembered: int = REMEMBERED) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each text, all their ids one after the other), ``END_ID`` last in each text; null is empty.

    This vocabulary drops white space before it splits words, so a text's ids are those of its words in turn. Each
    distinct word is tokenised once and its ids are remembered.
    """
    words = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    borders = np.asarray(words.offsets).astype(np.int64)
    flat = words.flatten().dictionary_encode()
    known = _known(path, remembered)
    at = known.look_up(flat.dictionary)
    codes = flat.indices.to_numpy()
    start, length = known.start[at][codes], known.length[at][codes]
    ends = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])[borders - borders[0]]
    ids = np.insert(_ranges(known.pool, start, length), ends[1:], np.uint32(END_ID))
    return np.diff(ends) + 1, ids


def tokenise(docs: DataFrame, tokenizer_path: str, text_col: str = "text", source_col: str = "source",
             remembered: int = REMEMBERED, block: Column | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, ids, block, before): ``before`` counts the source's tokens ahead in the same block.

    A block is what one task read, or rows that follow each other with the same value of ``block``, a string whose order
    is that of the blocks. Null texts count as empty: their only id is ``END_ID``.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("tokens")
        seen: dict = {}
        for part in (x for p in parts for x in by_bytes(p, "text", BATCH_BYTES)):
            n, ids = encode(part.column("text"), tokenizer_path, remembered)
            before = []
            for source, at, k in zip(part.column("source").to_pylist(), part.column("block").to_pylist(), n.tolist(), strict=True):
                before.append(seen.get((source, at), 0))
                seen[source, at] = before[-1] + k
            offsets = np.concatenate([[0], np.cumsum(4 * n)]).astype(np.int64)
            data = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("source"), pa.array(n, pa.int64()), data.cast(pa.binary()),
                 part.column("block"), pa.array(before, pa.int64())],
                ["doc_id", "source", "n_tokens", "ids", "block", "before"],
            )

    ship(docs.sparkSession)
    place = F.lpad(F.spark_partition_id().cast("string"), 10, "0") if block is None else block
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       F.col(text_col).cast("string").alias("text"), place.alias("block"))
    schema = "doc_id long, source string, n_tokens long, ids binary, block string, before long"
    return rows.mapInArrow(run, schema)


def by_bytes(part: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose column has about ``most`` bytes, or one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(part.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(part):
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + most, "right")))
        yield part.slice(at, end - at)
        at = end


# ------------------------------------------------------------------------------------------------------- schedule


@dataclass
class Schedule:
    """Which queue every token of the packed stream comes from, in closed form.

    sizes: tokens in each queue; weights: target shares (the sizes themselves unless given); lead: places of the first
    window that are taken already.
    """

    sizes: list[int]
    weights: list[int]
    lead: int = 0
    phases: list[tuple[int, list[int], list[int]]] = field(default_factory=list)  # first token, queues, used before

    def __post_init__(self) -> None:
        start, used = 0, [0] * len(self.sizes)
        queues = [j for j, n in enumerate(self.sizes) if n]
        while queues:
            self.phases.append((start, queues, list(used)))
            left = sum(self.sizes[j] - used[j] for j in queues)

            def fits(m: int, queues=queues, used=used) -> bool:
                return all(k <= self.sizes[j] - used[j] for j, k in zip(queues, self.split(queues, m), strict=True))

            low, high = 0, left
            while low < high:  # most tokens that no queue is too short for
                mid = (low + high + 1) // 2
                low, high = (mid, high) if fits(mid) else (low, mid - 1)
            for j, k in zip(queues, self.split(queues, low), strict=True):
                used[j] += k
            start += low
            rest = [j for j in queues if used[j] < self.sizes[j]]
            queues = rest  # at least one ran dry: one token more would not have fitted
        self.starts = [p[0] for p in self.phases]
        self.total = sum(self.sizes)
        self._cut: dict[int, tuple[list[int], list[int]]] = {}

    def split(self, queues: list[int], m: int) -> list[int]:
        """How the first m tokens fall on the queues, down the binary tree."""
        if len(queues) == 1:
            return [m]
        half = len(queues) // 2
        left, every = sum(self.weights[j] for j in queues[:half]), sum(self.weights[j] for j in queues)
        mine = m * left // every
        return self.split(queues[:half], mine) + self.split(queues[half:], m - mine)

    def used(self, token: int) -> list[int]:
        """Tokens of each queue among the first ``token`` of the stream."""
        token = min(token, self.total)
        if not self.phases:
            return [0] * len(self.sizes)
        start, queues, base = self.phases[bisect_right(self.starts, token) - 1]
        out = list(base)
        for j, k in zip(queues, self.split(queues, token - start), strict=True):
            out[j] += k
        return out

    def at(self, window: int) -> tuple[list[int], list[int]]:
        """Tokens of each queue before the window, and where each queue's tokens begin in it."""
        if window not in self._cut:
            if len(self._cut) > 50_000:
                self._cut.clear()
            a, b = (self.used(max(0, k * WINDOW - self.lead)) for k in (window, window + 1))
            self._cut[window] = a, [0, *accumulate(y - x for x, y in zip(a, b, strict=True))]
        return self._cut[window]

    def window_of(self, queue: int, token: int) -> int:
        """The window that holds the queue's token."""
        low, high = 0, -(-(self.lead + self.total) // WINDOW) - 1
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.used(max(0, mid * WINDOW - self.lead))[queue] <= token else (low, mid - 1)
        return low

    def pieces(self, queue: int, first: int, n: int, window: int | None = None) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, window, offset) of the pieces of a document that begins at the queue's token ``first``."""
        k, done = self.window_of(queue, first) if window is None else window, 0
        while done < n:
            before, begin = self.at(k)
            inside = first + done - before[queue]
            take = min(n - done, begin[queue + 1] - begin[queue] - inside)
            if take <= 0:
                k += 1
                continue
            yield done, take, k, begin[queue] + inside + (self.lead if k == 0 else 0)
            done += take


class Timeline:
    """Schedules of successive slices of the stream; each fills up the window in which the one before it ended."""

    def __init__(self, totals: list[tuple[int, str | None, int]], proportions: dict[str | None, float] | None) -> None:
        """totals: (slice, source, tokens) in order of slices."""
        self.slices: dict[int, tuple[int, Schedule, dict[str | None, int]]] = {}
        base = 0
        for number, rows in groupby(totals, key=lambda x: x[0]):
            queues = [(s, n) for _, s, n in rows]
            sizes = [n for _, n in queues]
            weights = [max(1, n) for n in sizes] if proportions is None else integer_weights([proportions.get(s, 0.0) for s, _ in queues])
            self.slices[number] = base, Schedule(sizes, weights, base % WINDOW), {s: j for j, (s, _) in enumerate(queues)}
            base += sum(sizes)
        self._last: dict[tuple, tuple[int, int]] = {}  # of a queue: token, window; the next document mostly begins there

    def pieces(self, number: int, source: str | None, first: int, n: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence_id, offset) of the pieces of a document that begins at its queue's token ``first``."""
        base, schedule, queue_of = self.slices[number]
        at, window = self._last.get((number, source), (None, None))
        found = list(schedule.pieces(queue_of[source], first, n, window if at == first else None))
        self._last[number, source] = first + n, found[-1][2]
        return [(start, length, base // WINDOW + k, offset) for start, length, k, offset in found]


def integer_weights(weights: list[float]) -> list[int]:
    parts = [Fraction(w).limit_denominator(10**9) for w in weights]
    common = 1
    for p in parts:
        common = common * p.denominator // np.gcd(common, p.denominator).item() if common < 2**62 else common
    return [max(1, int(p * common)) for p in parts]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    proportions: dict[str | None, float] | None = None,
    text_col: str = "text",
    source_col: str = "source",
    remembered: int = REMEMBERED,
    block: Column | None = None,
    slices: int = 1,
) -> DataFrame:
    """A row per piece: doc_id, source, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``proportions`` are the sources' target shares of every window; without them each source gets its share of all
    tokens, so that all queues end together and every window has the corpus's mixture to within a few tokens. Every
    window but the last is full. Null sources form one queue. Rows that repeat are packed as often as they occur; an
    empty table gives no piece; columns but the id, the text and the source are not looked at, whatever their names.

    ``block`` orders the rows (see ``tokenise``). With ``slices`` over 1 the blocks are cut in their order into so many
    parts of about equal length, which are packed one after the other, each by its own shares: the windows then follow a
    mixture that changes along that order.

    ``remembered`` trades a worker's memory (about 45 bytes a word) for time. Texts are tokenised once, into the shared
    folder. Only a total per (source, block) is prefix-summed; one number per slice and source goes to the driver.
    """
    tokens = materialise(tokenise(docs, tokenizer_path, text_col, source_col, remembered, block), "tokens")
    sums = materialise(tokens.groupBy("source", "block").agg(F.sum("n_tokens").alias("n")), "block_sums")
    if slices > 1:  # a row per block in one window
        every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        before = F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
        part = F.floor(F.coalesce(before, F.lit(0)) * slices / F.sum("n").over(every)).cast("int")
        parts = sums.groupBy("block").agg(F.sum("n").alias("n")).select(F.col("block").alias("_block"), part.alias("slice"))
        sums = sums.join(parts, F.col("block") == F.col("_block")).drop("_block")
    else:
        sums = sums.withColumn("slice", F.lit(0))
    ahead = Window.partitionBy("slice", "source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "slice", "n",
                        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("block_first"))
    first = materialise(first, "block_firsts")  # its size is known when the join is planned
    totals = first.groupBy("slice", F.col("_source").alias("source")).agg(F.sum("n").alias("n")).collect()
    totals = sorted(((r["slice"], r["source"], int(r["n"])) for r in totals), key=lambda x: (x[0], x[1] is None, x[1] or ""))

    met = F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))
    placed = tokens.join(first, met).withColumn("first", F.col("block_first") + F.col("before"))

    @F.arrow_udf("array<struct<start:long,length:long,sequence_id:long,offset:long>>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        line = Timeline(totals, proportions)
        for columns in batches:
            made = [line.pieces(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)]
            rows = np.array([x for pieces in made for x in pieces], np.int64).reshape(-1, 4)
            fields = [pa.array(rows[:, i]) for i in range(4)]
            ends = np.cumsum([0, *map(len, made)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, _PIECE))

    pieces = placed.withColumn("piece", F.explode(cut("slice", "source", "first", "n_tokens")))
    at, size = (F.col("piece.start") * 4 + 1).cast("int"), (F.col("piece.length") * 4).cast("int")
    return pieces.select("doc_id", "source", "piece.start", "piece.length", F.substring("ids", at, size).alias("ids"),
                         F.col("n_tokens").alias("doc_tokens"), "piece.sequence_id", "piece.offset")


_PIECE = ["start", "length", "sequence_id", "offset"]

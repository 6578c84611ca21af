"""Packing tokenised documents into sequences: Martello-Toth dominance reduction, then best fit.

Piece lengths are whole numbers up to the capacity, so the whole instance is a histogram of at most
`capacity` counts, however many documents there are. That histogram alone is solved, on the driver:

1. Reduction (Martello and Toth, 1990). For a length w, largest first, a set of at most three pieces
   with w is fixed for good if it dominates every other set that w could share a sequence with: a
   partner that fills the sequence exactly; the longest partner that fits, if no two others do; that
   same partner, if no three others do and it is at least as long as the best fitting pair; or that
   pair, if no three others do, it fills the sequence, its longer member is the longest partner and
   no two pieces longer than its shorter member fit.
   Fixed sets leave the instance, which may allow others, until none is left.
2. The remainder is packed best-fit decreasing, all equal lengths at a time: equal sequences are one
   group with a multiplicity, so the work follows the number of lengths, not of pieces.

The plan is a list of runs (length, first rank, pieces, first sequence, pieces per sequence, offset),
whose size is bounded by the capacity alone. Pieces learn their rank among those of equal length from
counts per (length, salt) and a row number inside one such group: a length with a third of all
pieces is dealt over as many salts as its share of the rows asks for.

Defined results: a null text is empty and holds the end id alone; equal rows are packed one by one;
an empty table needs no sequence.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.llm import _common as c

CAPACITY = 2048

#: About so many pieces get one salt, and are numbered in one task.
ROWS_PER_SALT = 20_000

#: Words of up to so many characters are cached, about so many to a worker. A full cache stays as it is, as the commonest
#: words come first, until it knows less than half of some texts' words.
CACHE_WORDS, WORD_CHARS = 500_000, 48

#: The library is asked for so many words at a time.
CALL_WORDS = 16_000

#: Texts are split into words together up to so many characters.
CALL_CHARS = 2_000_000

_BLANKS = frozenset("\t\n\x0b\x0c\r \xa0")


# -- tokens ------------------------------------------------------------------------------------


class ByteTokens:
    """Ids of a byte-level tokenizer file by the tokenizers library, asked once for each word.

    Byte-level BPE never merges across the words of its split pattern, so a text's ids are its words'
    ids. Texts of characters that any Unicode version classes alike (below U+0200) are split here and
    looked up; others, and those with a special token's string, go to the library whole.
    """

    def __init__(self, path: str):
        import unicodedata

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        spec = json.loads(self.library.to_str())
        split = spec["pre_tokenizer"] or {}
        # files that normalise or split in another way are given to the library text by text
        self.by_words = spec["normalizer"] is None and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) == ("ByteLevel", False, True) and spec["truncation"] is spec["padding"] is None
        self.library.no_truncation()
        self.library.no_padding()

        def of(kind: str) -> str:
            return "".join(f"\\u{p:04x}" for p in range(0x200) if unicodedata.category(chr(p))[0] == kind)

        letters, numbers, spaces = of("L"), of("N"), "\\u0009-\\u000d\\u0020\\u00a0"
        self.split = re.compile(
            f"'(?:[sdmt]|ll|ve|re)| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
        )
        self.odd = re.compile("[^\x00-\x1b\x20-\x84\x86-ǿ]")
        self.known: dict[str, bytes] = {}
        size = max(self.library.get_vocab().values()) + 1
        self.lengths = np.zeros(size, np.int64)  # of each token in bytes: a byte-level token has a character for each byte
        for token, i in self.library.get_vocab().items():
            self.lengths[i] = len(token)

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ask(self, words: list[str]) -> dict[str, bytes]:
        """Ids of many words by few calls; they come as one row, which is cut where the words' bytes end.

        Words that a blank begins stay apart when they are written one behind the other; others go as a list."""
        apart = [w for w in words if len(w) > 1 and w[0] == " " and w[1] not in _BLANKS]
        out: dict[str, bytes] = {}
        for at in range(0, len(apart), CALL_WORDS):
            some = apart[at : at + CALL_WORDS]
            out |= self._cut(some, self.library.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids)
        if len(apart) < len(words):
            some = [w for w in words if w not in out]
            out |= self._cut(some, self.library.encode_batch_fast([some], is_pretokenized=True, add_special_tokens=False)[0].ids)
        return out

    def _cut(self, words: list[str], found: list[int]) -> dict[str, bytes]:
        ids = np.array(found, "<u4")
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, words)), np.int64, len(words)))
        token_ends = np.cumsum(self.lengths[ids])
        cuts = np.searchsorted(token_ends, ends) + 1
        if cuts[-1] != len(ids) or not np.array_equal(token_ends[cuts - 1], ends):
            return {w: self._whole(w) for w in words}
        packed, to = ids.tobytes(), (4 * cuts).tolist()
        return dict(zip(words, map(packed.__getitem__, map(slice, [0, *to], to))))

    def encode(self, many: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_words:
            return [self._whole(t) for t in many]
        words = [None if self.odd.search(t) or any(s in t for s in self.special) else self.split.findall(t) for t in many]
        known = self.known
        every = set().union(*(w for w in words if w))
        new = self._ask(list(every.difference(known)))
        old = every.difference(new)
        here = dict(zip(old, map(known.__getitem__, old))) | new
        if len(known) >= CACHE_WORDS and 2 * len(new) > len(here):
            known.clear()  # other texts than those it was filled from
        if len(known) < CACHE_WORDS:
            known.update((w, ids) for w, ids in new.items() if len(w) <= WORD_CHARS)
        return [self._whole(t) if w is None else b"".join(map(here.__getitem__, w)) for t, w in zip(many, words)]


_loaded: dict[str, ByteTokens] = {}


def load(path: str) -> ByteTokens:
    if path not in _loaded:
        _loaded[path] = ByteTokens(path)
    return _loaded[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all but the first are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    tokens = load(path)
    end = end_id.to_bytes(4, "little")
    for whole in batches:
        many = c.texts(whole)
        for first, last in _spans(many):
            at, number, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(tokens.encode(many[first:last]), first):
                ids += end
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    at.append(row)
                    number.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * s : 4 * (s + n)]))
            yield pa.RecordBatch.from_arrays(
                [whole.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )


def _spans(many: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about CALL_CHARS characters, or one longer text."""
    first = total = 0
    for i, t in enumerate(many):
        if total and total + len(t) > CALL_CHARS:
            yield first, i
            first, total = i, 0
        total += len(t)
    if first < len(many):
        yield first, len(many)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each document; a pass without a shuffle."""
    c.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema[0], *(T.StructField(n, k) for n, k in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())))])
    return rows.mapInArrow(lambda it: _pieces(it, path, capacity, end_id), schema)


# -- the plan ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Run:
    """`count` pieces of one length from rank `first` on: `per` in each sequence from `sequence` on, at `offset` there."""

    length: int
    first: int
    count: int
    sequence: int
    per: int
    offset: int


class Instance:
    """Counts by length, and the runs planned so far."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {s: n for s, n in histogram.items() if n}
        self.sizes = sorted(self.left)
        self.rank: dict[int, int] = defaultdict(int)
        self.runs: list[Run] = []
        self.sequences = 0

    def place(self, size: int, count: int, sequence: int, per: int, offset: int) -> None:
        self.runs.append(Run(size, self.rank[size], count, sequence, per, offset))
        self.rank[size] += count
        self.left[size] -= count
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def largest(self, limit: int, used: tuple[int, ...] = ()) -> int:
        """The largest length up to the limit with a piece that `used` leaves; 0 if there is none."""
        i = bisect_left(self.sizes, limit + 1) - 1
        while i >= 0 and self.left[self.sizes[i]] <= used.count(self.sizes[i]):
            i -= 1
        return self.sizes[i] if i >= 0 else 0

    def smallest(self, n: int, used: tuple[int, ...], above: int = 0) -> int:
        """The sum of the n smallest pieces over `above` that `used` leaves; over the capacity if there are fewer."""
        total = 0
        for s in self.sizes[bisect_left(self.sizes, above + 1) :]:
            take = min(n, self.left[s] - used.count(s))
            total, n = total + max(0, take) * s, n - max(0, take)
            if not n:
                return total
        return self.capacity + 1

    def best_pair(self, limit: int, used: tuple[int, ...]) -> tuple[int, int]:
        """Of pairs whose sum is within the limit, that with the largest sum, then with the longest member; (0, 0) if none."""
        best = (0, 0)
        sizes = [s for s in self.sizes[: bisect_left(self.sizes, limit + 1)] if self.left[s] > used.count(s)]
        lo, hi = 0, len(sizes) - 1
        while lo <= hi:
            a, b = sizes[hi], sizes[lo]
            if a + b > limit:
                hi -= 1
                continue
            if (a != b or self.left[a] - used.count(a) > 1) and (a + b, a) > (sum(best), best[0]):
                best = (a, b)
            lo += 1
        return best

    def dominating(self, w: int) -> tuple[int, ...] | None:
        """A set with w that dominates every set w could be in, by the criteria above."""
        room = self.capacity - w
        v = self.largest(room, (w,))
        if not v:
            return (w,)
        if v == room or self.smallest(2, (w,)) > room:
            return (w, v)
        if self.smallest(3, (w,)) <= room:
            return None
        a, b = self.best_pair(room, (w,))
        if v >= a + b:
            return (w, v)
        if a + b == room and v == a and self.smallest(2, (w,), above=b) > room:
            return (w, a, b)
        return None

    def reduce(self) -> int:
        """Fix dominating sets until there is none; the number of sequences that they fill."""
        changed = True
        while changed:
            changed = False
            for w in sorted(self.left, reverse=True):
                while w in self.left and (found := self.dominating(w)):
                    times = min(self.left[s] // found.count(s) for s in found)
                    offset = 0
                    for s in sorted(set(found), reverse=True):
                        self.place(s, times * found.count(s), self.sequences, found.count(s), offset)
                        offset += s * found.count(s)
                    self.sequences += times
                    changed = True
        return self.sequences

    def best_fit(self) -> None:
        """Best-fit decreasing over what is left, in groups of equally filled sequences."""
        rooms: list[int] = []  # sorted, each room once
        groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, how many)

        def open_(room: int, first: int, many: int) -> None:
            if room and many:
                if not groups[room]:
                    insort(rooms, room)
                groups[room].append((first, many))

        for size in sorted(self.left, reverse=True):
            n = self.left[size]
            while n:
                i = bisect_left(rooms, size)
                if i < len(rooms):
                    room = rooms[i]
                    first, many = groups[room].pop()
                    if not groups[room]:
                        rooms.pop(i)
                else:
                    room, first = self.capacity, self.sequences
                    many = -(-n // (room // size))
                    self.sequences += many
                per = room // size
                full = min(many, n // per)
                if full:
                    self.place(size, full * per, first, per, self.capacity - room)
                    open_(room - per * size, first, full)
                    n -= full * per
                if full < many:
                    if n:
                        self.place(size, n, first + full, n, self.capacity - room)
                        open_(room - n * size, first + full, 1)
                        first, full, n = first + 1, full, 0
                        many -= 1
                    open_(room, first + full, many - full)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Runs that give every piece of the histogram its sequence and its offset, in as few sequences as the method finds."""
    if any(not 0 < s <= capacity for s in histogram):
        raise ValueError("a piece is empty or longer than a sequence")
    instance = Instance(histogram, capacity)
    instance.reduce()
    instance.best_fit()
    return instance.runs


# -- the pieces' places ------------------------------------------------------------------------


def _places(batches: Iterator[pa.RecordBatch], runs: list[Run]) -> Iterator[pa.RecordBatch]:
    table = np.array([(r.length, r.first, r.sequence, r.per, r.offset) for r in sorted(runs, key=lambda r: (r.length, r.first))], np.int64).reshape(-1, 5)
    step = int(table[:, 1].max(initial=0)) + 1
    keys = table[:, 0].astype(object) * step + table[:, 1] if step > 1 << 50 else table[:, 0] * step + table[:, 1]
    for b in batches:
        length, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
        run = table[np.searchsorted(keys, length * step + np.minimum(rank, step - 1), side="right") - 1]
        within = rank - run[:, 1]
        names = [n for n in b.schema.names if n != "rank"]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(b.schema.names.index(n)) for n in names), pa.array(run[:, 2] + within // run[:, 3]), pa.array(run[:, 4] + within % run[:, 3] * run[:, 0])],
            names=[*names, "sequence_id", "offset"],
        )


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, written: bool = False) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset. `cut_pieces` should be a written
    table, as it is read three times; its columns stay. `written`: it is a Parquet table just as it was read."""
    spark = cut_pieces.sparkSession
    c.ship(spark)
    histogram = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    runs = plan(histogram, capacity)
    salts = max(8, -(-sum(histogram.values()) // ROWS_PER_SALT))
    # rows without an id, or with one that repeats, are told apart by their place in the written table, which is the same whenever it is read
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index") if written else F.lit(0)
    salted = cut_pieces.select("*", place.alias("_place")).withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "_place"), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = salted.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32", "_place")))
    ranked = numbered.join(starts, ["length", "_salt"]).select(*cut_pieces.columns, (F.col("_before") + F.col("_row") - 1).alias("rank"))
    schema = T.StructType([*cut_pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(lambda it: _places(it, runs), schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(c.materialize(pieces(docs, path, capacity), "pieces"), capacity, written=True)

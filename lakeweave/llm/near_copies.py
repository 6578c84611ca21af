"""Near copies by exact similarity: two documents link if the Jaccard similarity of their sets of five-word shingles is 0.8 or more.

SimHash fingerprints of the sets come first: candidates of `simhash.near_pairs` (within 15 bits of up to a million fingerprints; those that
sizes and parities of 256 bits rule out go no further than their bucket) are compared exactly, and what they join is not compared again. The rest is found by the same covering scheme for another radius, as
a 64-bit fingerprint can't promise all: at a similarity of 0.8 about ten bits
differ, and covering fourteen takes 32,767 tables of masks. So the masks lie over the shingles themselves, a bit for each possible
hash: sets of similarity 0.8 differ in at most D bits, a number that a band of sizes bounds; the masks deal the bits to more than D
parts, so that some mask sees no difference, and every pair within the radius collides in some table. A key is what a mask sees, about
four shingles. A document with D or fewer non-empty parts also gives the shingles of its prefix (the least hashes, one of which any
partner shares), as the part without a difference could be an empty one; a pair needs that only if both have so few.

Documents with equal sets are one node. What collides is compared in this order:

1. Each node of a bucket with the least one, which joins a large group of copies in linear time. Parities come first: a set's hashes
   folded to a few hundred bits, in which two sets differ at least as little as in their shingles, so that no similar pair fails.
   Of the partners that are left each node is compared with the least by the whole sets.
2. Within buckets that still hold several components, nodes of different ones by their parities, in memory. A bucket of more than
   ``BUCKET_NODES`` is cut into blocks that meet two by two. Pairs that pass
   go on, once each, and are compared by the whole sets.

Members of a bucket are never gathered but in blocks, and only pairs that pass go on. Only candidates' sets are shuffled, no texts.

Defined results: words are those of simhash; fewer than five words make one shingle of the whole sequence; null and empty texts
have equal, empty sets; rows with equal ids are one document; rows whose id is null are no nodes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.llm import _common as c
from lakeweave.llm.components import components
from lakeweave.llm.simhash import SEED, _signed, keep_first, majority, near_pairs

#: Words to a shingle.
WIDTH = 5

#: Nodes of a bucket that are compared in one task's memory at once.
BUCKET_NODES = 2048

#: A set's parity as 256 bits, beside its fingerprint.
MARKS = [f"m{i}" for i in range(4)]

#: Pairs that a task remembers having told.
TOLD_PAIRS = 200_000

#: Largest size of each band from 4 shingles on; a set similar to one of a band has its size in that band or the next.
_TOPS = [5]
while _TOPS[-1] < 1 << 40:
    _TOPS.append((_TOPS[-1] + 1) * 5 // 4)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a whole text's word shingles, ascending."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    width = min(width, len(words))
    starts = [0, *ends[: len(words) - width].tolist()]
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())], np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys(found: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles: sets of similarity 0.8 or more that differ have one in common."""
    n = len(found)
    if n < 4:  # similar to none but itself
        return np.zeros(0, np.uint64)
    band, mixed, out, weak = bisect_left(_TOPS, n), _mix(found), [], False
    for scheme in range(max(0, band - 1), band + 1):
        differ = _TOPS[scheme] // 4  # of sizes a <= b <= 5a / 4, at most (a + b) / 9 shingles
        parts = (differ + 1) * 21 // 20 + 3
        part = (found >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        weak = weak or len(starts) <= differ
        out.append(_mix(np.add.reduceat(mixed, starts) + _mix(part[starts] + np.uint64((scheme + 1) << 40))))
    if weak:
        out.append(_mix(found[: n - -(-4 * n // 5) + 1] + np.uint64(1)))
    return np.concatenate(out)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in c.slices(whole):
            found = [shingles(t) for t in c.texts(b)]
            sets, sims = [xxhash.xxh3_128_digest(x.tobytes()) for x in found], [_signed(majority(x)) for x in found]
            n, bits = pa.array(list(map(len, found)), pa.int64()), list(map(parity, found))
            marks = np.stack([_folded(x, 8 * len(MARKS)) for x in bits]).view(np.int64)
            columns = [b.column(0), pa.array(sets, pa.binary()), pa.array(sims, pa.int64()), n, pa.array(bits, pa.binary()), *map(pa.array, marks.T.copy())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "fp", "sim", "n", "bits", *MARKS])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in c.slices(whole, 64):
            found = [keys(shingles(t)) for t in c.texts(b)]
            ids = np.repeat(b.column(0).to_numpy(), list(map(len, found)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(ids, pa.int64())], names=["key", "id"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in c.slices(whole, 64):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).view(np.int64) for t in c.texts(b)], pa.list_(pa.int64()))], names=["id", "found"])


def parity(found: np.ndarray) -> bytes:
    """For each of at least 2n bits, whether an odd number of the set's hashes fall on it. Halves of a longer one, one laid over the
    other, are the shorter one."""
    bits = max(256, 1 << (2 * len(found) - 1).bit_length() if len(found) else 0)
    odd = np.bincount((_mix(found) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(raw: bytes, size: int) -> np.ndarray:
    """A parity as `size` bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(raw, np.uint64).reshape(-1, size // 8), axis=0)


def may_be_similar(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sizes and short parities allow a similarity of 0.8; of rows (n, *MARKS)."""
    n, m, odd = x[..., 0], y[..., 0], (x[..., 1:] ^ y[..., 1:]).view(np.uint64)
    return (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (9 * np.bitwise_count(odd).sum(axis=-1, dtype=np.int64) <= n + m)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sizes and parities allow a similarity of 0.8."""
    for b in batches:
        keep = []
        for n, m, x, y in zip(*(b.column(k).to_pylist() for k in ("n", "m", "x", "y"))):
            size = min(len(x), len(y))
            keep.append(5 * min(n, m) >= 4 * max(n, m) and 9 * int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()) <= n + m)
        yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of two blocks of a bucket (or within one) the pairs of different components that are close; those lately told are not told again."""
    told: set[tuple[int, int]] = set()
    for b in batches:
        us, vs = [], []
        for row in b.column(0).to_pylist():
            row.sort(key=lambda m: m["id"])
            size = min(len(m["bits"]) for m in row)
            bits = np.stack([_folded(m["bits"], size) for m in row])
            ids, of, n, block = (np.array([m[k] for m in row]) for k in ("id", "component", "n", "block"))
            two = len(np.unique(block)) > 1
            for i in range(1, len(row)):
                at = np.flatnonzero((of[:i] != of[i]) & (5 * np.minimum(n[:i], n[i]) >= 4 * np.maximum(n[:i], n[i])) & ((block[:i] != block[i]) if two else True))
                if len(at):
                    at = at[9 * np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1, dtype=np.int64) <= n[at] + n[i]]
                    if len(told) > TOLD_PAIRS:
                        told.clear()
                    for pair in {(int(x), int(ids[i])) for x in ids[at]} - told:
                        told.add(pair)
                        us.append(pair[0])
                        vs.append(pair[1])
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


_PAIR = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def _ids(pairs: DataFrame) -> DataFrame:
    return c.materialize(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "near-wanted")


def _similar(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs whose sets have a similarity of 0.8 or more."""
    wanted = _ids(pairs)
    few = rows.join(c.guarded(wanted), "id", "left_semi").select("id", "text")
    sets = c.materialize(few.mapInArrow(_sets, "id long, found array<long>"), "near-sets")
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("found").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("found").alias("b")), "v")
    out = c.materialize(both.where("9 * size(array_intersect(a, b)) >= 4 * (size(a) + size(b))").select("u", "v").distinct(), "near-edges")
    for old in (wanted, sets):
        c.discard(old)
    return out


def _within(members: DataFrame, marks: DataFrame, linked: DataFrame, bucket_nodes: int) -> DataFrame:
    """The close pairs of different components within buckets; members: (key, id)."""
    placed = members.join(linked, members.id == linked.node, "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    same = [F.bit_xor(F.xxhash64(F.lit(i), "id")).alias(f"h{i}") for i in (0, 1)]  # buckets of the same nodes are one
    mixed = placed.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("component").alias("a"), F.max("component").alias("b"), *same).where("a <> b")
    mixed = mixed.groupBy("k", "h0", "h1").agg(F.min("key").alias("key"))
    mixed = c.materialize(mixed.select("key", F.ceil(F.col("k") / bucket_nodes).cast("int").alias("blocks")), "near-mixed")
    left = c.materialize(placed.join(c.guarded(mixed), "key"), "near-left")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = left.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = dealt.join(marks, "id").select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.struct("id", "component", "n", "bits", "block").alias("m"))
    met = rows.groupBy("key", "i", "j").agg(F.collect_list("m").alias("ms")).where("size(ms) > 1")  # two blocks at most
    out = c.materialize(met.select("ms").mapInArrow(_apart, _PAIR).distinct(), "near-rest")
    for old in (mixed, left):
        c.discard(old)
    return out


def _allowed(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs whose sizes and parities allow a similarity of 0.8; marks: (id, n, bits)."""
    both = pairs.join(marks.select(F.col("id").alias("u"), "n", F.col("bits").alias("x")), "u").join(marks.select(F.col("id").alias("v"), F.col("n").alias("m"), F.col("bits").alias("y")), "v")
    return both.mapInArrow(_close, _PAIR)


def _by_fingerprints(nodes: DataFrame, marks: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, sim, n, *MARKS) -> the pairs of a similarity of 0.8 or more whose fingerprints meet."""
    least = nodes.groupBy(F.col("sim").alias("fp")).agg(F.min(F.struct(F.col("id").alias("rep"), "n", *MARKS)).alias("l"))
    groups = c.materialize(least.select("fp", "l.*"), "near-fingerprints")
    pairs = near_pairs(groups, close=may_be_similar)
    equal = nodes.join(groups, nodes.sim == groups.fp).where("id <> rep").select(F.col("rep").alias("u"), F.col("id").alias("v"))
    near = c.materialize(_allowed(pairs.union(equal).distinct(), marks).distinct(), "near-pairs")
    out = _similar(near, rows)
    for old in (groups, pairs, near):
        c.discard(old)
    return out


def _across(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """The pairs whose ends are not joined yet."""
    one, two = linked.select(F.col("node").alias("u"), F.col("component").alias("a")), linked.select(F.col("node").alias("v"), F.col("component").alias("b"))
    return pairs.join(one, "u", "left").join(two, "v", "left").where("coalesce(a, u) <> coalesce(b, v)").select("u", "v")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_nodes: int = BUCKET_NODES) -> DataFrame:
    """(id, component_id) for each row whose id is not null."""
    c.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    prints = c.materialize(rows.mapInArrow(_prints, f"id long, fp binary, sim long, n long, bits binary, {', '.join(f'{m} long' for m in MARKS)}"), "near-prints")
    named = c.materialize(prints.join(prints.groupBy("fp").agg(F.min("id").alias("rep")), "fp").select("id", "rep", "sim", "n", "bits", *MARKS), "near-nodes")
    copies = c.materialize(named.groupBy("id").agg(F.bool_or(F.col("id") == F.col("rep")).alias("own")).where("not own").select("id"), "near-copies")
    marks = c.materialize(named.join(c.guarded(copies), "id", "left_anti").select("id", "n", "bits").distinct(), "near-marks")
    told = _by_fingerprints(named.where("id = rep").select("id", "sim", "n", *MARKS).distinct(), marks, rows)
    joined = c.materialize(components(told), "near-joined")
    keyed = rows.join(c.guarded(copies), "id", "left_anti").select("id", "text").mapInArrow(_keys, "key long, id long")
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("u"), F.max("id").alias("v")).where("u <> v")
    buckets = c.materialize(buckets, "near-buckets")
    more = c.materialize(buckets.where("k > 2").select("key", "u"), "near-more")  # all but pairs, which the buckets' table holds
    members = c.materialize(keyed.join(c.guarded(more), "key").select("key", "id", "u").distinct(), "near-members")
    stars = c.materialize(buckets.select("u", "v").union(members.select("u", F.col("id").alias("v")).where("u <> v")).distinct(), "near-stars")
    close = c.materialize(_across(_allowed(stars, marks), joined), "near-close")
    first = c.materialize(close.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), "near-first")
    edges = told.union(_similar(first, rows))
    linked = c.materialize(components(edges), "near-linked")
    rest = _across(close, linked).union(_within(members.select("key", "id"), marks, linked, bucket_nodes)).distinct().join(first, ["u", "v"], "left_anti")
    edges = edges.union(_similar(c.materialize(rest, "near-rest"), rows))
    equal = named.where("id <> rep").select(F.col("rep").alias("u"), F.col("id").alias("v"))
    final = c.materialize(components(edges.union(equal)), "near-components")
    for old in (joined, buckets, more, members, stars, marks, close, first, linked):
        c.discard(old)
    return prints.select("id").join(final, F.col("id") == final.node, "left").select(F.col("id").alias(id_col), F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each group of near copies; see simhash.keep_first."""
    return keep_first(docs, c.materialize(near_copies(docs, id_col, text_col), "near-marked"), id_col)

"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint's bit is the majority of that bit in the XXH64 values (seed 42) of the text's word
shingles. Two fingerprints link if at most ``radius`` = 3 bits differ. Candidates come from Pagh's
covering masks: every bit position i gets a non-zero vector m(i) of radius + 1 bits; table v (one
for each of the 2^(radius+1) - 1 = 15 non-zero vectors) keeps the positions with <m(i), v> = 1. The
vectors of any three differing positions leave some v orthogonal to all of them, so that any pair
within the radius agrees on all positions which that table keeps: no link can be missed.

Equal fingerprints are one node, so groups of copies cost nothing. In a table's bucket, nodes are
compared in memory while the bucket holds at most ``bucket_rows``, and only a spanning star of each
linked set goes on. A larger bucket is never gathered: each node meets the others at every point
within 2 flips of it outside the mask. If some node lies within 1 flip of a point, all that lie
within 2 are within 3 of that node, so the whole meeting is connected; and any two nodes within 3
have such a point. That is linear in the bucket, exact, and each meeting has a bounded size.

Defined results: a null text is empty; a text without words has fingerprint zero, which links like
any other; fewer words than a shingle make one shingle of the whole sequence; repeated rows are
rows of their own; rows with one id are one document, so their fingerprints link whatever they are; rows whose id is null get a fingerprint and link like others, so that they may
join groups of rows with ids; their component is the smallest id in reach, or null if there is none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.llm import _common as c
from lakeweave.llm.components import components

BITS, RADIUS, SEED = 64, 3, 42

#: Up to this many nodes a bucket is compared in one task's memory; larger ones take the linear way.
BUCKET_ROWS = 8192

#: Fingerprints that may share a key of near_pairs on average.
PART_NODES = 4096


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """The masks of the tables: 2^(radius+1) - 1 whole numbers of `bits` bits."""
    n = (1 << radius + 1) - 1
    return [sum(1 << i for i in range(bits) if ((i % n + 1) & v).bit_count() % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


MASKS = covering_masks()


def fingerprint(text: str, width: int) -> int:
    """The SimHash of one whole text; A-Z is lower-cased, words are runs without \\x20 and \\x09-\\x0D."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, seed, joined = xxhash.xxh64_intdigest, SEED, b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - width].tolist()]
    return majority([digest(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())])


def majority(hashes: list[int] | np.ndarray) -> int:
    """The number of which a bit is 1 if it is in over half the hashes; zero of none."""
    n = len(hashes)
    total = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch], id_col: str, width: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in c.slices(whole):
            found = pa.array([_signed(fingerprint(t, width)) for t in c.texts(b)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), found], names=[id_col, "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp long) for each row; a pass without a shuffle."""
    c.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _fingerprints(it, id_col, width), T.StructType([T.StructField(id_col, T.LongType()), T.StructField("fp", T.LongType())]))


def _reached(fps: np.ndarray, radius: int, allowed: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each of the fingerprints, the positions of the first one in its linked set and of one that it links to on the way there;
    links are those of `allowed` (positions of two nodes -> whether), if given."""
    label = np.arange(len(fps))
    by = np.arange(len(fps))
    rest = np.arange(len(fps))
    while len(rest):
        first, rest, queue = rest[0], rest[1:], [rest[0]]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(fps[rest] ^ fps[at]) <= radius
            if allowed:
                near[near] = allowed(rest[near], at)
            if near.any():
                found = rest[near]
                label[found] = first
                by[found] = at
                queue.extend(found.tolist())
                rest = rest[~near]
    return label, by


def linked_sets(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of the fingerprints, the position of the first one in its linked set."""
    return _reached(fps, radius)[0]


def _star(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    label = linked_sets(fps, radius)
    far = np.flatnonzero(label != np.arange(len(label)))
    return far, label[far]


def _pairs(fps: np.ndarray, radius: int, allowed: Callable | None) -> tuple[np.ndarray, np.ndarray]:
    """The positions of the allowed pairs within the radius, of each node that with the first one before it; if a node has more, also
    some that span the linked sets. So they are fewer than twice the nodes, however many are alike."""
    us, vs, more = [], [], False
    step = max(1, (1 << 19) // len(fps))
    for at in range(0, len(fps), step):
        u, v = np.nonzero(np.tril(np.bitwise_count(fps[at : at + step, None] ^ fps[: at + step]) <= radius, at - 1))
        if allowed:
            own = allowed(u + at, v)
            u, v = u[own], v[own]
        node, first = np.unique(u, return_index=True)
        more = more or len(node) < len(u)
        us.append(node + at)
        vs.append(v[first])
    if more:
        by = _reached(fps, radius, allowed)[1]
        far = np.flatnonzero(by != np.arange(len(by)))
        us.append(far)
        vs.append(by[far])
    return np.concatenate(us), np.concatenate(vs)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(0)
        rows, ends = lists.flatten(), np.asarray(lists.offsets)
        ends = ends - ends[0]
        fps, reps = np.asarray(rows.field(0)).view(np.uint64), np.asarray(rows.field(1))
        sizes = np.diff(ends)
        at = ends[:-1][sizes == 2]
        near = at[np.bitwise_count(fps[at] ^ fps[at + 1]) <= RADIUS]
        us, vs = [reps[near]], [reps[near + 1]]
        for i in np.flatnonzero(sizes > 2):
            own = slice(ends[i], ends[i + 1])
            far, first = _star(fps[own], RADIUS)
            us.append(reps[own][far])
            vs.append(reps[own][first])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])


def _met(batches: Iterator[pa.RecordBatch], radius: int, close: Callable | None) -> Iterator[pa.RecordBatch]:
    """The pairs of each bucket's rows (rep, fp, marks ...), taken by their reps, so that a group gives much the same ones in every table."""
    for b in batches:
        lists = b.column(0)
        ends = np.asarray(lists.offsets)
        ends = ends - ends[0]
        columns = [np.asarray(x) for x in lists.flatten().flatten()]
        order = np.lexsort((columns[0], np.repeat(np.arange(len(lists)), np.diff(ends))))
        reps, fps, *marks = (x[order] for x in columns)
        fps, marks = fps.view(np.uint64), np.stack(marks, axis=1) if close else None
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in zip(ends[:-1].tolist(), ends[1:].tolist()):
            u, v = _pairs(fps[i:j], radius, close and (lambda u, v, own=marks[i:j]: close(own[u], own[v])))
            us.append(reps[i:j][u])
            vs.append(reps[i:j][v])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])


def _flips(mask: int) -> list[int]:
    """All patterns of at most 2 flipped bits outside the mask."""
    free = [1 << i for i in range(BITS) if not mask >> i & 1]
    return [0, *free, *(a | b for a, b in combinations(free, 2))]


def _keyed(nodes: DataFrame, masks: list[int]) -> DataFrame:
    return nodes.select("*", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks))).alias("t", "key"))


def parted_masks(parts: int) -> list[int]:
    """The masks over each of 1, 2 or 4 equal parts of the bits: of fingerprints within 4 * parts - 1 bits one part differs in at most three."""
    own = BITS // parts
    return [m << own * i for i in range(parts) for m in covering_masks(own)]


def near_pairs(nodes: DataFrame, bucket_rows: int = BUCKET_ROWS, close: Callable | None = None) -> DataFrame:
    """(fp, rep, long marks ...) with distinct fp -> (u, v) of reps with u < v, candidates for a check of the texts: pairs within 15 bits of up
    to a million fingerprints, 7 bits of up to 500 million, else 3, as parts with more differences make keys of fewer bits. `close` (marks
    of some nodes, marks of as many others -> whether) keeps those that can't be similar from going on. In a bucket of at most
    `bucket_rows` each node goes on with the first one before it, and where there are more, with some that span what they link; in a
    larger one each node meets the least. So the pairs are in proportion to the nodes of the buckets, not to the squares of groups."""
    c.ship(nodes.sparkSession)
    n = nodes.count()
    parts = 4 if n <= PART_NODES << 8 else 2 if n <= PART_NODES << 17 else 1
    radius, keyed = 4 * parts - 1, _keyed(nodes, parted_masks(parts))
    shared = c.materialize(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("of"), F.min("rep").alias("least")).where("of > 1"), "simhash-shared")
    few, many = (shared.where(F.col("of") <= bucket_rows).select("t", "key"), shared.where(F.col("of") > bucket_rows))
    edge = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
    marks = [x for x in nodes.columns if x not in ("fp", "rep")]
    met = keyed.join(c.guarded(few), ["t", "key"]).groupBy("t", "key").agg(F.collect_list(F.struct("rep", "fp", *marks)).alias("rows"))
    found = met.select("rows").mapInArrow(lambda it: _met(it, radius, close), edge)
    stars = keyed.join(c.guarded(many), ["t", "key"]).select(F.col("least").alias("u"), F.col("rep").alias("v")).where("u <> v")
    out = c.materialize(found.union(stars).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "simhash-pairs")
    c.discard(shared)
    return out


def links(nodes: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(fp, rep) with distinct fp -> (u, v) of reps, spanning all nodes that are linked within a table's bucket."""
    spark = nodes.sparkSession
    c.ship(spark)
    keyed = _keyed(nodes, MASKS)
    # most buckets hold one node: they are counted with partial sums, and only nodes of the others move on
    shared = c.materialize(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-shared")
    meet = c.materialize(keyed.join(c.guarded(shared), ["t", "key"]), "simhash-buckets")
    edge = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
    small = meet.where(F.col("n") <= bucket_rows).groupBy("t", "key").agg(F.collect_list(F.struct("fp", "rep")).alias("rows"))
    found = small.select("rows").mapInArrow(lambda it: _stars(it), edge)
    big = meet.where(F.col("n") > bucket_rows)
    if big.isEmpty():
        return found
    flips = spark.createDataFrame([(t, _signed(x), x.bit_count() <= 1) for t, m in enumerate(MASKS) for x in _flips(m)], "t int, flip long, near boolean")
    points = big.join(F.broadcast(flips), "t").select("t", "rep", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), "near")
    meetings = points.groupBy("t", "point").agg(F.collect_list("rep").alias("reps"), F.bool_or("near").alias("near")).where("near and size(reps) > 1")
    return found.union(meetings.select(F.explode("reps").alias("u"), F.array_min("reps").alias("v")).where("u <> v"))


def near_duplicates(prints: DataFrame, id_col: str = "doc_id", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, fp) rows -> (id, fp, component_id); `prints` should be a written table, as it is read twice."""
    groups = c.materialize(prints.groupBy("fp").agg(F.min(id_col).alias("rep")), "simhash-nodes")
    # nodes are fingerprints: one whose rows have no id links its neighbours all the same
    found = links(groups.select("fp", F.col("fp").alias("rep")), bucket_rows)
    twice = prints.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_i")).agg(F.min("fp").alias("_f"), F.max("fp").alias("_l")).where("_f <> _l")
    twice = c.materialize(twice.select("_i", "_f"), "simhash-twice")
    one = prints.join(c.guarded(twice), F.col(id_col) == F.col("_i")).select(F.col("fp").alias("u"), F.col("_f").alias("v")).where("u <> v")
    linked = c.materialize(components(found.union(one)), "simhash-linked")
    members = c.materialize(groups.join(linked, groups.fp == linked.node).select("fp", "rep", "component"), "simhash-members")
    least = members.groupBy(F.col("component").alias("_c")).agg(F.min("rep").alias("component_id"))
    reached = members.join(least, F.col("component") == F.col("_c")).select(F.col("fp").alias("_fp"), "component_id")
    named = groups.join(reached, F.col("fp") == F.col("_fp"), "left").select("fp", F.when(F.col("_fp").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id"))
    named = c.materialize(named, "simhash-components")
    for old in (groups, twice, linked, members):
        c.discard(old)
    return prints.join(named, "fp", "left").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """docs without all but one row of each near-duplicate group; see keep_first."""
    return keep_first(docs, c.materialize(near_duplicates(c.materialize(fingerprints(docs, id_col, text_col, width), "simhash-prints"), id_col), "simhash-marked"), id_col)


def keep_first(docs: DataFrame, marked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without all but one row of each group that `marked` (id, component_id) names: the one with the smallest id stays (of equal
    ids, one; rows whose id is null all stay). Only ids that go or that are repeated meet the documents: while they are few, by
    broadcast, so that no text is shuffled."""
    ids = marked.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_found")).agg(F.count(F.lit(1)).alias("_n"), F.min("component_id").alias("_first"))
    told = c.materialize(ids.select("_found", (F.col("_found") != F.col("_first")).alias("_gone"), (F.col("_n") > 1).alias("_again")).where("_gone or _again"), "simhash-gone")
    rows = c.wrapped(docs, _id=F.col(id_col).cast("long"))
    joined = rows.join(c.guarded(told), F.col("_id") == F.col("_found"), "left")
    kept = joined.where("_found is null")
    again = told.where("_again and not _gone")
    if not again.isEmpty():
        kept = kept.unionByName(joined.where("_again and not _gone").dropDuplicates(["_id"]))
    return c.unwrapped(kept)

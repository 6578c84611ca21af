import random

import numpy as np
import pytest
import xxhash

from lakeweave.llm import queries, simhash
from lakeweave.llm.components import components


def plain_fingerprint(text, width=3):
    words = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or "")
    for ch in "\t\n\x0b\x0c\r":
        words = words.replace(ch, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def plain_components(rows):
    """(id, fp) -> {(id, fp): smallest id}, by comparing every pair."""
    fps = np.array([f for _, f in rows], np.uint64)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), k), k)
    return [least[root(i)] for i in range(len(rows))]


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks()
    assert len(masks) == 15 and all(28 <= m.bit_count() <= 36 for m in masks)
    rng = random.Random(5)
    for _ in range(20000):
        x = sum(1 << i for i in rng.sample(range(64), rng.randint(0, 3)))
        assert any(x & m == 0 for m in masks)


@pytest.mark.parametrize("bucket_rows", [8192, 3, 1])
def test_components_equal_brute_force(spark, bucket_rows):
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(260):  # chains and clouds around a few centres
        fps.append(rng.choice(fps[:3] + fps[-10:]) ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) % (1 << 64))
    rows = [(i * 3 + 1, f) for i, f in enumerate(fps)]
    rng.shuffle(rows)
    prints = spark.createDataFrame([(i, simhash._signed(f)) for i, f in rows], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(prints, bucket_rows=bucket_rows).collect()}
    assert got == {i: c for (i, _), c in zip(rows, plain_components(rows))}
    assert len(set(got.values())) > 5


def test_fingerprints_equal_the_definition():
    rng = random.Random(3)
    for text in ["", " \n\t", "One", "One two", "a b c", "Ärger\x0bÄRGER x\x1cy z", *(" ".join(rng.choice("aB cé the of Zz".split()) for _ in range(rng.randint(1, 80))) for _ in range(60))]:
        assert simhash.fingerprint(text, 3) == plain_fingerprint(text)


def test_query_equals_brute_force(spark, sf_dir):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.queries()["op10_simhash"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = [(d.doc_id, plain_fingerprint(d.text)) for d in docs]
    assert got == {i: (f"{f:016x}", c) for (i, f), c in zip(rows, plain_components(rows))}


def test_odd_rows(spark):
    rows = [(5, None, "a"), (3, "", "b"), (None, "", "c"), (9, "x " * 50000, "d"), (9, "x " * 50000, "d"), (None, "alone here now then", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(simhash.fingerprints(docs)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 3), (3, 3), (5, 3), (9, 9), (9, 9)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 3, 9]
    empty = docs.limit(0)
    assert simhash.keep_one(empty).count() == 0
    assert simhash.near_duplicates(simhash.fingerprints(empty)).count() == 0


def test_rows_without_an_id_link_their_neighbours(spark):
    """0 and 63 differ by 6 bits; 7, whose row has no id, lies between. A chain without any id has no component."""
    rows = [(1, 0), (None, 7), (2, 63), (None, 2**40 - 1), (None, 2**40 - 2), (5, -1), (6, 2**50), (6, 2**51 + 2**52 + 2**53 + 2**54)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
    assert {r.fp: r.component_id for r in got} == {0: 1, 7: 1, 63: 1, 2**40 - 1: None, 2**40 - 2: None, -1: 5, 2**50: 1, 2**51 + 2**52 + 2**53 + 2**54: 1}


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1000 + i) for i in range(1, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path + hub + [(7, 7), (3, 2)], "u long, v long")).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1200)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one_of_repeated_ids_either_way(spark, monkeypatch):
    from lakeweave.llm import _common as c

    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(12)]
    rows = [(rng.randrange(20), rng.choice(texts), "x") for _ in range(80)] + [(None, texts[0], "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, _found string")
    link = {}
    for i, t, _ in rows:  # rows with one id, or one text, are one group
        if i is not None:
            link.setdefault(("t", t), set()).add(i)
    groups = []
    for ids in link.values():
        ids = set(ids)
        for g in [g for g in groups if g & ids]:
            groups.remove(g)
            ids |= g
        groups.append(ids)
    want = sorted(min(g) for g in groups)
    for limit in (200_000, 0):
        monkeypatch.setattr(c, "BROADCAST_ROWS", limit)
        kept = simhash.keep_one(docs).collect()
        assert sorted(r.doc_id for r in kept if r.doc_id is not None) == want
        assert sum(r.doc_id is None for r in kept) == 2 and all(r._found == "x" for r in kept)

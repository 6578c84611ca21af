import random

import pytest

import corpus_pipeline
from lakeweave.llm import near_copies as nc


def plain(text):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_similar_sets_share_a_key():
    rng = random.Random(2)
    import numpy as np

    seen = 0
    for _ in range(6000):
        n = rng.choice([4, 5, 6, 8, 10, 15, 30, 70, 200])
        a = [rng.getrandbits(64) for _ in range(n)]
        b = a[rng.randint(0, n // 5) :] + [rng.getrandbits(64) for _ in range(rng.randint(0, n // 4))]
        common = len(set(a) & set(b))
        if 9 * common >= 4 * (len(a) + len(b)) and set(a) != set(b):
            seen += 1
            x, y = (nc.keys(np.unique(np.array(s, np.uint64))) for s in (a, b))
            assert set(x.tolist()) & set(y.tolist())
    assert seen > 1000


def test_stage_keeps_one_of_each_group_of_near_copies(spark):
    """Every pair compared; a change in the middle of a text moves its fingerprint by more than three bits."""
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([8, 9, 40, 120, 300]))]
        for _ in range(8):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += ["", None, "one two", "one two", "one two three"]
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    sets, least = {i: plain(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        return i if least[i] == i else root(least[i])

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and (a == b or 9 * len(a & b) >= 4 * (len(a) + len(b))):
                x, y = root(i), root(j)
                least[max(x, y)] = min(x, y)
    docs = spark.createDataFrame([*rows, (None, "one two")], "doc_id long, text string")
    kept = [r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()]
    assert kept.count(None) == 1 and sorted(k for k in kept if k) == sorted({root(i) for i in sets})
    assert 12 < len(kept) < 80


def test_parities_never_part_similar_sets():
    import numpy as np

    rng = random.Random(5)
    for _ in range(400):
        a = [rng.getrandbits(64) for _ in range(rng.choice([4, 40, 130, 600]))]
        b = a[rng.randint(0, len(a) // 3) :] + [rng.getrandbits(64) for _ in range(rng.randint(0, len(a) // 3))]
        x, y = (nc.parity(np.unique(np.array(s, np.uint64))) for s in (a, b))
        size = min(len(x), len(y))
        assert int(np.bitwise_count(nc._folded(x, size) ^ nc._folded(y, size)).sum()) <= len(set(a) ^ set(b))


def test_a_common_passage_in_large_buckets(spark):
    """Documents that share a long passage but are not similar, and among them chains of similar ones that no star joins."""
    rng = random.Random(6)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    passage = fresh(60)
    rows = []
    for _ in range(60):
        base = fresh(30) + passage + fresh(30)
        rows.append(base)
        for _ in range(rng.randint(0, 4)):
            words = list(rows[-1])
            words[rng.randrange(len(words))] = fresh(1)[0]
            rows.append(words)
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    sets, least = {i: plain(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        return i if least[i] == i else root(least[i])

    for i, a in sets.items():
        for j in range(i):
            b = sets[j]
            if 9 * len(a & b) >= 4 * (len(a) + len(b)):
                x, y = root(i), root(j)
                least[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for nodes in (2048, 7):
        got = {r.doc_id: r.component_id for r in nc.near_copies(docs, bucket_nodes=nodes).collect()}
        assert got == {i: root(i) for i in sets}


def test_fingerprints_find_similar_pairs(spark):
    """The stage's SimHash step against every pair: near copies whose fingerprints differ by up to 15 bits, most by more than three."""
    from lakeweave.llm import simhash

    rng = random.Random(8)
    fps = [rng.getrandbits(64) for _ in range(150)]
    fps += [x ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 17))) for x in fps]
    nodes = spark.createDataFrame([(simhash._signed(x), i) for i, x in enumerate(fps)], "fp long, rep long")
    got = {tuple(r) for r in simhash.near_pairs(nodes).collect()}
    want = {(i, j) for j, y in enumerate(fps) for i, x in enumerate(fps[:j]) if (x ^ y).bit_count() <= 15}
    assert got == want and sum((fps[i] ^ fps[j]).bit_count() > 3 for i, j in want) > 80
    least = {tuple(r) for r in simhash.near_pairs(nodes, bucket_rows=2).collect()}
    assert least and all(i < j for i, j in least)


def test_large_groups_give_few_candidates(spark, monkeypatch):
    """Near copies of one text, and documents that share a passage but are not similar: what leaves the fingerprints' buckets is counted."""
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    met, near_pairs = [], nc.near_pairs

    def counted(*given, **named):
        met.append(near_pairs(*given, **named).count())
        raise InterruptedError  # the rest of the stage is not looked at

    monkeypatch.setattr(nc, "near_pairs", counted)

    def candidates(texts):
        with pytest.raises(InterruptedError):
            nc.near_copies(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string"))
        return met[-1]

    base, passage = fresh(120), fresh(110)
    one = [[*base[:k], *fresh(1), *base[k + 1 :]] for k in (rng.randrange(len(base)) for _ in range(240))]
    assert len(one) // 2 < candidates(one) < 15 * len(one)
    apart = [[*fresh(22), *passage, *fresh(22)] for _ in range(240)]
    assert candidates(apart) < len(apart)

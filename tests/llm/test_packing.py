import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from lakeweave.llm import packing, queries


def spread(runs):
    """(length, rank) -> (sequence, offset) for every piece of the runs."""
    out = {}
    for r in runs:
        for k in range(r.count):
            assert (r.length, r.first + k) not in out
            out[r.length, r.first + k] = (r.sequence + k // r.per, r.offset + k % r.per * r.length)
    return out


def check(histogram, capacity, places):
    assert Counter(s for s, _ in places) == Counter({s: n for s, n in histogram.items() if n})
    assert all({k for s2, k in places if s2 == s} == set(range(n)) for s, n in histogram.items())
    by = {}
    for (size, _), (seq, at) in places.items():
        by.setdefault(seq, []).append((at, size))
    for seq, parts in by.items():
        at = 0
        for start, size in sorted(parts):
            assert start == at
            at += size
        assert at <= capacity
    return len(by)


def fewest(sizes, capacity):
    """The least number of sequences, by trying all."""
    best = [len(sizes)]

    def put(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in sorted({r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values()):
            put(i + 1, [r - sizes[i] * (j == k) for j, r in enumerate(rooms)])
        put(i + 1, [*rooms, capacity - sizes[i]])

    sizes.sort(reverse=True)
    put(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_valid_and_near_the_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 17, 30])
    sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
    histogram = Counter(sizes)
    used = check(histogram, capacity, spread(packing.plan(histogram, capacity)))
    assert used <= fewest(sizes, capacity) + 1


@pytest.mark.parametrize("seed", range(60))
def test_reduction_keeps_the_optimum(seed):
    rng = random.Random(seed)
    capacity = 12
    sizes = [rng.randint(1, capacity) for _ in range(9)]
    instance = packing.Instance(Counter(sizes), capacity)
    fixed = instance.reduce()
    rest = [s for s, n in instance.left.items() for _ in range(n)]
    assert fixed + (fewest(rest, capacity) if rest else 0) == fewest(sizes, capacity)


def test_plan_of_many_pieces_stays_small():
    rng = random.Random(1)
    histogram = {s: rng.randint(0, 10**9) for s in range(1, 2049)}
    runs = packing.plan(histogram)
    assert len(runs) < 20_000
    assert sum(r.count for r in runs) == sum(histogram.values())
    total = sum(s * n for s, n in histogram.items())
    assert max(r.sequence + -(-r.count // r.per) for r in runs) <= 1.02 * -(-total // 2048)
    with pytest.raises(ValueError):
        packing.plan({2049: 1})


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    own, library = packing.ByteTokens(path), Tokenizer.from_file(path)
    rng = random.Random(2)
    texts = ["", " ", "\n\n a  b\t", "<|endoftext|> x", "a\x1cb\x85c\xa0d e", "don't WE'LL", "x" * 5000, "日本語 😀", "é" * 100]
    texts += ["".join(rng.choice("abc éÀ'stre19 .,!\n\tİ日\x1c<|>") for _ in range(rng.randint(1, 50))) for _ in range(500)]
    for t, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_query_holds_every_id_once_and_without_gaps(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    rows = queries.queries()["op2_best_fit_packing"](spark, sf_dir).collect()
    docs = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == docs.keys()
    for k, ids in docs.items():
        at = 0
        for n, r in enumerate(sorted(by_doc[k], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at) and (r.length == 2048 or n == 0)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at <= 2048
    assert len(by_seq) <= 1.02 * -(-sum(map(len, docs.values())) // 2048) + 1


def test_odd_rows(spark):
    rows = [(1, None, "s"), (1, None, "s"), (None, "", "t"), (3, "word " * 30000, "u"), (4, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    path = queries.tokenizer_path("byte_bpe_50k.json")
    got = packing.pack_documents(docs, path).collect()
    assert sorted((r.doc_id or -1, r.length) for r in got if r.doc_id != 3) == [(-1, 1), (1, 1), (1, 1), (4, 3)]
    assert sum(r.length for r in got if r.doc_id == 3) == 30002
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_best_pair_equals_all_pairs():
    rng = random.Random(9)
    for _ in range(300):
        histogram = Counter(rng.randint(1, 15) for _ in range(rng.randint(1, 8)))
        instance, limit = packing.Instance(histogram, 15), rng.randint(2, 15)
        pieces = sorted(histogram.elements(), reverse=True)
        pairs = [(a, b) for a, b in combinations(pieces, 2) if a + b <= limit]
        assert sum(instance.best_pair(limit, ())) == max(map(sum, pairs), default=0)


def test_rows_without_an_id_are_dealt_over_the_salts(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_SALT", 50)
    docs = spark.createDataFrame([(None, "same text") for _ in range(3000)], "doc_id long, text string").repartition(3)
    rows = packing.pack_documents(docs, queries.tokenizer_path("byte_bpe_50k.json")).collect()
    assert len(rows) == 3000 == len({(r.sequence_id, r.offset) for r in rows})
    n = rows[0].length
    assert len({r.sequence_id for r in rows}) == -(-3000 // (2048 // n))


def test_other_ways_of_splitting_are_left_to_the_library(tmp_path):
    import json

    from tokenizers import Tokenizer

    spec = json.load(open(queries.tokenizer_path("byte_bpe_50k.json"), encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    texts = ["plain words", "", "Über 12 things", "x" * 300]
    want = [np.array(Tokenizer.from_file(str(path)).encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert packing.ByteTokens(str(path)).encode(texts) == want

import hashlib
import random

import numpy as np
import pytest

from lakeweave.llm import bpe, queries


@pytest.fixture(scope="module")
def model():
    return bpe.load(queries.tokenizer_path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))


HARD = [
    "", "  ", "\n", "<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "<|endoftext|", "ÀÉ İstanbul ΣΑΣ ΟΔΟΣ ß ﬁ 中文字 한국 ①②", "a\x1cb\x85c d\xa0e",
    "don't WE'LL I'M it's 's'", "é é " * 5, "x" * 1000, "ab" * 5000, "1234567890" * 50, "!!!???" * 100, "😀👍🏽", "Ⱥⱦ", "\0abc\x1f", "क्षि ", "ſtraße", "ŉ Ǆ ǅ",
]


def test_equals_the_library(model, library):
    rng = random.Random(5)
    texts = HARD + ["".join(rng.choice("abcé ñÀ'sStmldre19 .,!\n\tßİ中ﬁ\x1c\x85́<|>endoftext") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        packed, decoded = model.encode_packed(t)
        assert np.frombuffer(packed, "<u4").tolist() == want == model.encode(t)
        assert decoded.decode() == library.decode(want, skip_special_tokens=False) == model.decode(want)


def plain_merge(model, word):
    parts = list(word)
    parts[-1] += model.suffix
    while True:
        ranked = [(model.ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in model.ranks]
        if not ranked:
            return parts
        _, i = min(ranked)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_scan_and_heap_equal_the_definition(model):
    rng = random.Random(6)
    for _ in range(600):
        word = "".join(rng.choice("etaoinshrlu") for _ in range(rng.randint(1, 40)))
        assert model.merge(word) == plain_merge(model, word) == model._merge_long(word)
    long = "".join(rng.choice("thinger") for _ in range(bpe.SCAN_CHARS + 50))
    assert model.merge(long) == plain_merge(model, long)


def test_a_full_cache_starts_over(model, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    want = model.encode("one two three four five")
    for _ in range(3):
        model.encode("six seven eight nine")
        assert model.encode("one two three four five") == want
    assert len(model.packed) <= 16


def test_query_equals_the_library(spark, sf_dir, library):
    rows = {r.doc_id: r for r in queries.queries()["op4_bpe"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert tuple(rows[d.doc_id])[1:] == want


def test_odd_rows(spark, library):
    docs = spark.createDataFrame([(None, None, 5), (1, "", 6), (1, "", 6), (2, "The END " * 40_000, None)], "doc_id long, text string, n_tokens int")
    rows = bpe.encode(docs, queries.tokenizer_path("word_bpe_49k.json")).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, len(r.ids), len(r.decoded)) for r in rows) == [(-1, 0, 0, 0), (1, 0, 0, 0), (1, 0, 0, 0), (2, 80_000, 80_000, 40_000 * 16 - 1)]
    assert {r.ids_sha256 for r in rows if not r.n_tokens} == {hashlib.sha256(b"").hexdigest()}
    assert bpe.encode(docs.limit(0), queries.tokenizer_path("word_bpe_49k.json")).count() == 0


def test_decode_column(spark, library):
    path = queries.tokenizer_path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "Some words here"), (2, ""), (3, None)], "doc_id long, text string")
    encoded = bpe.encode(docs, path)
    back = {r.doc_id: r.decoded for r in bpe.decode(encoded, path).collect()}
    assert back == {r.doc_id: r.decoded for r in encoded.collect()} and back[2] == back[3] == ""
    odd = spark.createDataFrame([(None,), ([],), ([10**8, None, 320],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(odd, path).collect()] == [None, "", library.decode([320], skip_special_tokens=False)]


def test_files_that_split_in_another_way_are_refused(tmp_path):
    import json

    spec = json.load(open(queries.tokenizer_path("word_bpe_49k.json"), encoding="utf-8"))
    spec["normalizer"] = None
    (tmp_path / "other.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="not known"):
        bpe.Bpe(str(tmp_path / "other.json"))

import inspect
from collections import defaultdict

import duckdb
import numpy as np

import corpus_pipeline
from lakeweave.llm import _common as c
from lakeweave.llm import oracles, queries
from tests.llm import plain_classifier
from tests.llm.test_near_copies import plain


def test_stages_against_plain_versions(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = c.materialize(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == columns
        kept[name] = {r.doc_id: r for r in docs.collect()}

    # rules: the SQL of their query
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
        want = {i for i, k in con.sql(f"SELECT doc_id, kept FROM ({oracles.oracle_sql()['op3_quality_rules']})").fetchall() if k}
    assert set(kept["quality_rules"]) == want

    # classifier: one model, fed row by row in the order of the ids' hashes
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    model = plain_classifier.trained(spark, {i: r.text or "" for i, r in kept["quality_rules"].items()}, labels)
    if model is not None:
        scores = {i: model.score(r.text or "") for i, r in kept["quality_rules"].items()}
        assert not [x for x in scores.values() if abs(x - 0.3) < 1e-5]
        assert set(kept["quality_classifier"]) == {i for i, x in scores.items() if x >= 0.3}
    assert len(kept["quality_classifier"]) > 100

    # near-duplicates: every pair's sets of five-word shingles compared
    sets = {i: plain(r.text) for i, r in kept["quality_classifier"].items()}
    first = {i: i for i in sets}

    def root(i):
        return i if first[i] == i else root(first[i])

    for i, x in sets.items():
        for j, y in sets.items():
            if j < i and (x == y or 9 * len(x & y) >= 4 * (len(x) + len(y))):
                first[max(root(i), root(j))] = min(root(i), root(j))
    assert set(kept["simhash_dedup"]) == {root(i) for i in sets}

    # packing: every id once, without gaps, near the least number of sequences
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    sizes = {i: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in kept["simhash_dedup"].items()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    by_doc, by_seq = defaultdict(int), defaultdict(list)
    for r in packed:
        by_doc[r.doc_id] += r.length
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert by_doc == sizes
    for parts in by_seq.values():
        starts = np.cumsum([0, *(n for _, n in sorted(parts))])
        assert [s for s, _ in sorted(parts)] == starts[:-1].tolist() and starts[-1] <= 2048
    assert len(by_seq) <= 1.02 * -(-sum(sizes.values()) // 2048) + 1
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).drop("sequence_id", "offset").collect())) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)


def test_stages_on_odd_tables(spark, tmp_path):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, text(1), "en", "a", None, "x"), (1, text(1), "en", "a", 1, "x"), (2, text(1), None, None, 1, "y"), (None, text(2), "en", "a", 1, "z"), (3, None, None, None, None, None), (4, "", "en", "b", 0, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for given in (docs, docs.limit(0)):
        at = given
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = c.materialize(stage(spark, at, str(tmp_path)), f"odd-{name}")
            assert at.columns == docs.columns
        left = sorted(str(r.doc_id) for r in at.collect())
        assert left == (["1", "None"] if given is docs else [])
        packed = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).collect()
        assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed) == len(left)


def test_stages_are_named_functions():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "simhash_dedup", "best_fit_packing"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)
    assert corpus_pipeline.ORACLE_SQL is None


def test_every_operator_has_its_query():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(oracles.oracle_sql()) <= set(names)


def test_no_shared_folder_on_a_cluster_is_refused(monkeypatch):
    import pytest

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"
        applicationId = "a"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        c.shared_dir(Session())
    Context.master = "local[2]"
    assert c.shared_dir(Session()).startswith("file:///") and c.shared_dir(Session()).endswith("lakeweave-a")
    monkeypatch.setattr(Conf, "get", lambda self, key, default=None: "file:/shared/x/")
    assert c.shared_dir(Session()) == "file:///shared/x"

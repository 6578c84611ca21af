import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from lakeweave.llm import classifier, queries
from tests.llm import plain_classifier


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.queries()["op6_quality_classifier"](spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    held = [(r.quality, got[r.doc_id]) for r in labels if got[r.doc_id].held_out]
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    good = [r.score for q, r in held if q == 1]
    bad = [r.score for q, r in held if q == 0]
    assert len(good) > 20 and len(bad) > 4
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.97


def test_held_out_is_the_crc_of_the_id(spark):
    import zlib

    got = spark.range(50).select("id", classifier.remainder("id").alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 5 for r in got)


def test_held_out_labels_teach_nothing(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["a", "b", "c!"]) for _ in range(20))) for i in range(60)], "doc_id long, text string")
    marked = spark.range(60).select(classifier.remainder("id").alias("r"), "id")
    labels = marked.selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    flipped = marked.selectExpr("id as doc_id", "cast(case when r = 0 then 1 - id % 2 else id % 2 end as int) as quality")
    assert np.array_equal(classifier.train(docs, labels), classifier.train(docs, flipped))


def test_ftrl_step_by_step():
    settings = classifier.Ftrl(bits=4)
    model = classifier.Model(settings)
    z, n = [0.0] * 17, [0.0] * 17

    def weight(i):
        if abs(z[i]) <= settings.l1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * settings.l1) / ((settings.beta + n[i] ** 0.5) / settings.alpha + settings.l2)

    rng = random.Random(2)
    for _ in range(50):
        features = [rng.randrange(16) for _ in range(rng.randint(0, 6))]
        label = rng.randrange(2)
        model.learn(np.array(features, np.int64), label)
        x = {f: features.count(f) / max(1, len(features)) ** 0.5 for f in features} | {16: 1.0}
        p = classifier.sigmoid(sum(weight(i) * v for i, v in x.items()))
        for i, v in x.items():
            g, w = (p - label) * v, weight(i)
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / settings.alpha * w
            n[i] += g * g
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (None, "", "y"), (2, "word " * 50000, None), (2, "word", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    labels = spark.createDataFrame([(2, 1, "q"), (None, 0, "q"), (7, 0, "q"), (1, None, "q")], "doc_id long, quality int, text string")
    weights = classifier.train(docs, labels)
    got = classifier.with_score(docs, weights)
    assert got.columns == ["doc_id", "text", "label", "score"] and got.count() == 4
    assert len({r.score for r in got.where("doc_id is null or doc_id = 1").collect()}) == 1
    clash = docs.withColumnRenamed("label", "score")
    assert {r.score for r in classifier.filter_documents(clash, labels, threshold=0).collect()} == {"x", "y", None, "z"}
    nothing = classifier.train(docs.limit(0), labels.limit(0))
    assert classifier.score(nothing, classifier.Hasher(18).features("a b")) == 0.5
    assert classifier.with_score(docs.limit(0), weights).count() == 0


def test_one_text_of_an_id_teaches(spark):
    """The sample is bounded in rows, and no choice of an order decides which."""
    docs = spark.createDataFrame([(i % 3, f"text {i % 50} of {i % 3}") for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    one = classifier.train(docs, labels)
    two = classifier.train(docs.repartition(7).union(docs), labels)
    assert np.array_equal(one, two)
    order = {r.i: (r.r, r.h) for r in spark.range(3).selectExpr("id as i", "crc32(cast(cast(id as string) as binary)) % 5 as r", "xxhash64(cast(id as string)) as h").collect()}
    texts = {r.doc_id: r.t for r in docs.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("t")).collect()}
    hasher, model = classifier.Hasher(18), classifier.Model(classifier.Ftrl())
    kinds = [0, 0]
    for i in sorted((i for i in order if order[i][0]), key=lambda i: order[i][1]):
        model.learn(hasher.features(texts[i]), {0: 1, 1: 0, 2: 1}[i])
        kinds[{0: 1, 1: 0, 2: 1}[i]] += 1
    if all(kinds):
        assert np.array_equal(one, model.packed())


def test_query_equals_a_plain_version(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    model = plain_classifier.trained(spark, texts, labels)
    rows = queries.queries()["op6_quality_classifier"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = model.score(texts[r.doc_id])
        assert r.score == pytest.approx(want, abs=1e-5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.3)

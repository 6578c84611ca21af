import random

import pytest

from lakeweave.llm import quality_rules as q


def plain_counts(text):
    for ch in "\t\x0b\x0c\r":
        text = text.replace(ch, " ")
    words = [w for line in text.split("\n") for w in line.split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text), covered


@pytest.mark.parametrize("seed", range(40))
def test_counts_equal_the_definition(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["a", "b", "é", "#", " ", " ", "\n", "\x1c", "\xa0", "日"]) for _ in range(rng.randint(0, 120)))
    n, chars, symbols, covered = plain_counts(text)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    again = sum(x in lines[:i] for i, x in enumerate(lines))
    assert q.text_counts(text) == (n, chars, symbols, again, len(covered))


def test_shrinking_and_verdicts(spark):
    good, bad, short = "plain words here now " * 20 + "and ", "## $$ ** " * 20, "few"
    rng = random.Random(1)
    vary = lambda t, i: " ".join(f"{w}{i}{k}" for k, w in enumerate(t.split()))
    rows = [("spam", vary(bad, i)) for i in range(90)] + [("spam", vary(good, i)) for i in range(10)]
    rows += [("site", vary(good, i)) for i in range(300)] + [("tiny", vary(bad, 1)), ("tiny", short), (None, vary(good, 2)), ("site", None)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, h, "x") for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string, n_words string")
    got = q.judge(q.with_counts(docs)).collect()
    by = {}
    for r in got:
        by.setdefault((r.source, r.base_failed), set()).add((r.kept, r.host_blocked))
    assert by["spam", False] == {(False, True)}  # a host of junk goes as a whole
    assert by["site", False] == {(True, False)} and by["site", True] == {(False, False)}
    rates = {r._host: r for r in q.host_rates(q.with_counts(docs), "source").collect()}
    assert 0.6 < rates["spam"].symbols_rate < 0.95 and 0 < rates[""].symbols_rate < 1 and rates["site"].symbols_rate < 0.05
    assert q.filter_documents(docs).columns == docs.columns


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None, 1), (1, "", "", 2), (1, "", "", 2)], "doc_id long, text string, source string, kept int")
    got = q.judge(q.with_counts(docs.drop("kept"))).collect()
    assert len(got) == 3 and all(r.base_failed and not r.kept for r in got)
    assert q.filter_documents(docs).columns == docs.columns
    assert q.filter_documents(docs.limit(0)).count() == 0


def test_clashing_columns_survive(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "a", "keep me", "me too", "m3")], "doc_id long, text string, source string, kept string, base_failed string, n_words string")
    (row,) = q.filter_documents(docs).collect()
    assert (row.kept, row.base_failed, row.n_words) == ("keep me", "me too", "m3")


def test_the_host_step_decides_and_for_the_better(spark):
    """Ablation: verdicts of documents alone against verdicts with their hosts, on a corpus whose hosts differ."""
    rng = random.Random(7)
    text = lambda every: " ".join(f"w{rng.randrange(10**6)}" + ("#" if every and k % every == 0 else "") for k in range(120))
    rows = []
    for i in range(20):  # ordinary hosts: a few mild failures are sound, severe ones are not
        rows += [(f"h{i}", text(0), 1)] * 95 + [(f"h{i}", text(8), 1)] * 3 + [(f"h{i}", text(3), 0)] * 2
    rows += [("forum", text(8), 0)] * 120 + [("forum", text(0), 1)] * 180  # mild failures, far too many of them
    rows += [("farm", text(3), 0)] * 180 + [("farm", text(0), 0)] * 20  # all of it is made for search engines
    rows += [("manual", text(0), 1)] * 2990 + [("manual", text(3), 1)] * 3  # listings in a manual
    docs = spark.createDataFrame([(i, t, h, y) for i, (h, t, y) in enumerate(rows)], "doc_id long, text string, source string, label int")
    counted = q.with_counts(docs, drop_text=True).cache()
    right = {}
    for on in (True, False):
        got = q.judge(counted, policy=q.HostPolicy(hosts=on)).selectExpr("source", "kept", "label", "host_blocked").collect()
        right[on] = sum(r.kept == bool(r.label) for r in got)
        if on:
            assert {r.source for r in got if r.host_blocked} == {"farm"}
            assert all(r.kept for r in got if r.source == "manual") and not any(r.kept for r in got if r.source == "forum" and not r.label)
    counted.unpersist()
    assert right[True] == len(rows) and right[False] == len(rows) - 120 - 20 - 3


def test_hosts_that_differ_by_chance_only_are_ordinary(spark):
    rng = random.Random(8)
    rows = [(f"h{i % 20}", " ".join(f"w{rng.randrange(10**6)}" + ("#" if bad else "") for _ in range(60))) for i in range(4000) for bad in [rng.random() < 0.12]]
    docs = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    counted = q.with_counts(docs)
    got = {on: {r.doc_id for r in q.judge(counted, policy=q.HostPolicy(hosts=on)).where("kept").collect()} for on in (True, False)}
    assert got[True] == got[False] == {i for i, (_, t) in enumerate(rows) if "#" not in t}

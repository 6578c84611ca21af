import random
import re

import numpy as np
import pytest

from lakeweave.llm import license_scan as ls
from lakeweave.llm import queries


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return ls.train([" ".join(rng.choice("alpha beta of the and gamma".split()) for _ in range(12)) for _ in range(200)])


def found(model, text, threshold=0.5):
    ((_, out),) = ls.findings([text], model, ls.Windows(), threshold)
    return [(k, family, ok) for k, family, _, ok in out]


def test_families_and_unknown(model):
    assert found(model, "Released under the MIT License.") == [(0, "mit", True)]
    assert found(model, "x\n\nThis work is licensed under the GNU General Public License, version 3.\ny") == [(2, "gpl", True)]
    assert found(model, "Licensed under CC BY-SA 4.0.") == [(0, "cc-by-sa", True)]
    assert found(model, " ".join(f"q{i}" for i in range(60)) + " Licensed under the Apache License, Version 2.0. " + " ".join(f"r{i}" for i in range(60))) == [(0, "apache", True)]
    for text in ("Licensed under the Foo License.", "You need a licence to drive.", "the and of it", "", "word " * 500):
        assert not [f for f in found(model, text) if f[2]]


def test_every_family_of_a_line(model):
    filler = " ".join(f"q{i}" for i in range(60))
    both = f"Released under the MIT License. {filler} Licensed under the Apache License, Version 2.0."
    assert [f for f in found(model, both) if f[2]] == [(0, "apache", True), (0, "mit", True)]
    long = " ".join([filler, "Released under the MIT License."] * 200 + ["This work is licensed under the GNU General Public License, version 3."])
    assert [f for f in found(model, long) if f[2]] == [(0, "gpl", True), (0, "mit", True)]


def test_held_out_wordings(model):
    """Wordings that no template has."""
    right = 0
    cases = {f: names[0] for f, names in ls.NAMES.items()}
    for family, name in cases.items():
        right += any(f == family and ok for _, f, ok in found(model, f"The code in this folder can be used under {name}, as its authors say."))
    assert right >= len(cases) - 1


def test_windows_equal_a_plain_sum(model):
    rng = random.Random(3)
    lines = [[f"w{rng.randrange(30)}".encode() for _ in range(rng.choice([0, 1, 5, 10, 11, 20, 35, 40]))] for _ in range(60)]
    windows = ls.Windows()
    logits, line, _, _ = windows.logits(lines, model.weights)
    got = {}
    for row, k in zip(logits, line.tolist()):
        got.setdefault(k, []).append(row)
    for k, words in enumerate(lines):
        spans = [(0, len(words))] if 0 < len(words) <= ls.CHUNK else [(a, min(a + 2 * ls.CHUNK, len(words))) for a in range(0, len(words) - ls.CHUNK, ls.CHUNK)]
        assert len(got.get(k, [])) == len(spans)
        if words:
            single, pair, _, _ = windows.cut([words])
        for (a, b), row in zip(spans, got.get(k, [])):
            want = (model.weights[single[a:b]] + model.weights[pair[a:b]]).sum(axis=0) / np.sqrt(2 * (b - a) - 1) + model.weights[-1]
            assert np.allclose(row, want, atol=1e-3)


def test_query_finds_the_planted_lines_and_no_other(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.queries()["op8_license_scan"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    lines = {"gpl": "GNU General Public License, version 3", "cc-by-nc": "CC BY-NC 4.0", "mit": "MIT License", "apache": "Apache License, Version 2.0"}
    assert len(rows) == len(docs)
    for d in docs:
        want = sorted({f for f, name in lines.items() if re.search(f"(?i)licensed under .*{re.escape(name)}|released under .*{re.escape(name)}", d.text)})
        assert rows[d.doc_id].families == ",".join(want)
        assert rows[d.doc_id].n_paragraphs == len(re.findall(r"(?:[^\n]*[^ \t\n\x0b\x0c\r][^\n]*(?:\n|$))+", d.text))
    assert sum(bool(r.families) for r in rows.values()) > 10


def test_odd_rows(spark, model):
    docs = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (2, "Released under the MIT License.\n" * 3 + "z " * 100_000, "c"), (2, "MIT License", None)], "doc_id long, text string, findings string")
    rows = ls.scan(docs, model).collect()
    assert sorted((r.doc_id or -1, r.n_paragraphs, sum(f.confirmed for f in r.findings)) for r in rows) == [(-1, 0, 0), (1, 0, 0), (2, 1, 1), (2, 1, 1)]
    assert ls.scan(docs.limit(0), model).count() == 0 and ls.background(docs.limit(0)) == []
    assert all("MIT" not in x for x in ls.background(docs))


def test_names_that_grant_nothing_are_not_confirmed(model):
    for text in ("She studied at the MIT License office", "see the isc license plate", "The cc0 1.0 universal remote", "An Apache License plate was found in the desert by two hikers"):
        assert not [f for f in found(model, text) if f[2]], text


def wrapped(text, width):
    import textwrap

    return "\n".join(textwrap.wrap(text, width))


@pytest.mark.parametrize("width", [40, 70, 10_000])
def test_wrapped_texts_are_whole_paragraphs(model, width):
    """A licence's texts by their paragraphs, and all in one, at any width."""
    for family, texts in ls.TEXTS.items():
        text = "\n\n".join(wrapped(t, width) for t in texts)
        n, got = ls.findings([f"Some words before.\n\n{text}\n\nSome words after."], model, ls.Windows(), 0.5)[0]
        assert n == len(texts) + 2 and family in {f for _, f, _, ok in got if ok}, family
        assert {f for _, f, _, ok in got if ok} <= {family, "gpl", "lgpl", "agpl"} or family not in ("mit", "apache", "mpl", "epl"), (family, got)


def test_a_notice_cut_by_line_ends(model):
    assert [f for f in found(model, "first line here\nThis program is licensed under the Apache License, Version\n2.0, as are its\nmanuals and other texts") if f[2]] == [(0, "apache", True)]


def test_probabilities_are_calibrated(model):
    """Predictions on the sentences of another hand: as often right as they say, within what so few can tell."""
    windows, said, right = ls.Windows(), [], []
    for family, text in ls.CALIBRATION:
        logits, *_ = windows.logits([ls._words(text)], model.weights)
        for p in model.probabilities(logits):
            said.append(float(p.max()))
            right.append(model.classes[int(p.argmax())] == family)
    assert abs(np.mean(said) - np.mean(right)) < 0.12 and np.mean(right) > 0.75

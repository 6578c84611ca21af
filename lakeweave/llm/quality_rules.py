"""Host-level quality rules.

Every document gets whole-text counts and, for each rule, a failure in two degrees: it fails mildly or
severely. Failures are summed by host (map-side first, so a host with a third of the rows costs one
partial sum per task). A beta prior is fitted to all hosts by moments; its mean is the corpus's failure
rate, and its strength says how alike the hosts are. Each host's posterior is held against that mean:

* strict: the rate is above the corpus's, by `z` standard deviations. Mild failures of the rule go, too;
* trusted: the rate is below half of the corpus's by as much. Severe failures of the rule are forgiven;
* ordinary, all others: severe failures go;
* a host whose rate of a rule is above the corpus's and above one half by as much is blocked with all its documents.

Hosts that differ by no more than chance leave a strong prior, under which all are ordinary; then the
verdicts are those of the documents' own severe failures. Documents that fail a base rule go, whatever the host.

Defined results: a null text has no words (and so fails the base rule); a null host is the empty host;
repeated rows count and are judged one by one; an empty table gives an empty table; columns of the
input are kept, and counts go to the names in ``COUNTS`` (``with_counts`` replaces columns of those
names, ``filter_documents`` keeps all as they are).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.llm import _common as c

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

#: Rules over the counts; whole numbers only, so that every engine decides alike.
BASE_RULES = {
    "few_words": "n_words < 50",
    "repetition": "100 * n_repeat_words > 50 * n_words",
}
#: (mild, severe) failures. One symbol in ten words, and words of three to ten characters on average, are the usual limits
#: for web text; severe is twice as far off.
HOST_RULES = {
    "symbols": ("10 * n_symbols > n_words", "5 * n_symbols > n_words"),
    "repeated_lines": ("20 * n_dup_lines > n_words", "10 * n_dup_lines > n_words"),
    "word_length": ("word_chars > 10 * n_words or word_chars < 3 * n_words", "word_chars > 20 * n_words or 2 * word_chars < 3 * n_words"),
}


@dataclass(frozen=True)
class HostPolicy:
    """z: standard deviations that a host's posterior must lie off; the prior's strength in documents is kept within min/max.

    hosts=False leaves the host step out: every host is ordinary."""

    z: float = 3.0
    trusted: float = 0.5
    blocked: float = 0.5
    min_strength: float = 2.0
    max_strength: float = 10_000.0
    hosts: bool = True


def text_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() cuts at \x20 and \x09-\x0D, nothing else
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(end, i)
                end = i + 3
    return len(words), chars, symbols, dup_lines, repeated


def _counts(batches: Iterator[pa.RecordBatch], text_col: str, drop_text: bool) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in c.slices(whole):
            found = list(zip(*map(text_counts, c.texts(b, text_col)))) or [()] * len(COUNTS)
            names = [n for n in b.schema.names if not (drop_text and n == text_col)]
            arrays = [b.column(b.schema.names.index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(x, pa.int64()) for x in found)], names=[*names, *COUNTS])


def with_counts(docs: DataFrame, text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """docs and its COUNTS; a pass without a shuffle. drop_text leaves the text out."""
    c.ship(docs.sparkSession)
    docs = docs.drop(*COUNTS)
    fields = [f for f in docs.schema.fields if not (drop_text and f.name == text_col)]
    schema = T.StructType([*fields, *(T.StructField(n, T.LongType()) for n in COUNTS)])
    return docs.mapInArrow(lambda it: _counts(it, text_col, drop_text), schema)


def host_rates(counted: DataFrame, host_col: str, policy: HostPolicy = HostPolicy()) -> DataFrame:
    """A row for each host: _host, n, and for each rule <rule>_rate, the posterior mean under the beta prior of all hosts,
    <rule>_sd, its standard deviation, and <rule>_mean, the corpus's rate."""
    hosts = c.materialize(
        counted.groupBy(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("_host")).agg(
            F.count(F.lit(1)).alias("n"), *(F.count_if(F.expr(mild)).alias(f"{name}_failed") for name, (mild, _) in HOST_RULES.items())
        ),
        "hosts",
    )
    moments = [F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts")]
    for name in HOST_RULES:
        f = F.col(f"{name}_failed")
        moments += [F.sum(f).alias(f"{name}_sum"), F.sum(f * f / F.col("n")).alias(f"{name}_square")]
    m = hosts.agg(*moments).first()
    total = m["n"] or 0
    rates = []
    for name in HOST_RULES:
        mean, between = 0.0, 0.0
        if total:
            mean = m[f"{name}_sum"] / total
            noise = mean * (1 - mean) * m["hosts"] / total
            between = m[f"{name}_square"] / total - mean * mean - noise
        strength = mean * (1 - mean) / between - 1 if between > 1e-12 else policy.max_strength
        strength = min(max(strength, policy.min_strength), policy.max_strength)
        rate = (F.col(f"{name}_failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
        rates += [rate.alias(f"{name}_rate"), F.sqrt(rate * (1 - rate) / (F.col("n") + F.lit(strength + 1))).alias(f"{name}_sd"), F.lit(mean).alias(f"{name}_mean")]
    return hosts.select("_host", "n", *rates)


def standing(rule: str, policy: HostPolicy) -> Column:
    """A host's standing for one rule: 2 strict, 1 ordinary, 0 trusted."""
    rate, sd, mean = (F.col(f"{rule}_{x}") for x in ("rate", "sd", "mean"))
    return F.when(rate - policy.z * sd > mean, 2).when(rate + policy.z * sd < policy.trusted * mean, 0).otherwise(1)


def judge(counted: DataFrame, host_col: str = "source", policy: HostPolicy = HostPolicy()) -> DataFrame:
    """counted with base_failed, host_blocked and kept. The host table is broadcast only if it has been counted small."""
    base = F.expr(" or ".join(f"({x})" for x in BASE_RULES.values()))
    rows = counted.withColumn("_host", F.coalesce(F.col(host_col).cast("string"), F.lit("")))
    if policy.hosts:
        rates = host_rates(counted, host_col, policy)
        worst = F.lit(False)
        for r in HOST_RULES:
            worst = worst | (F.col(f"{r}_rate") - policy.z * F.col(f"{r}_sd") > F.greatest(F.col(f"{r}_mean"), F.lit(policy.blocked)))
        verdicts = rates.select("_host", worst.alias("_blocked"), *(standing(r, policy).alias(f"_standing_{r}") for r in HOST_RULES))
        rows = rows.join(c.guarded(verdicts), "_host", "left")
    else:
        rows = rows.withColumns({"_blocked": F.lit(False)} | {f"_standing_{r}": F.lit(1) for r in HOST_RULES})
    failed = F.lit(False)
    for name, (mild, severe) in HOST_RULES.items():
        at = F.coalesce(F.col(f"_standing_{name}"), F.lit(1))
        failed = failed | (F.expr(mild) & (at == 2)) | (F.expr(severe) & (at > 0))
    blocked = F.coalesce(F.col("_blocked"), F.lit(False))
    return (
        rows.withColumn("base_failed", base)
        .withColumn("host_blocked", blocked)
        .withColumn("kept", ~F.col("base_failed") & ~blocked & ~failed)
        .drop("_host", "_blocked", *(f"_standing_{r}" for r in HOST_RULES))
    )


def filter_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source", policy: HostPolicy = HostPolicy()) -> DataFrame:
    """The documents that stay, with the columns they came with."""
    rows = c.wrapped(docs, text=F.col(text_col), host=F.col(host_col))
    return c.unwrapped(judge(with_counts(rows, drop_text=True), "host", policy).where("kept"))

"""URL filters: host and path rules, and a path-template tree for the urls that no rule fits.

A rule (host, path prefix) fits its host and all subdomains; of those that fit, the longest wins.
What the rules say of urls is also what the tree learns from: a url that a rule fits is a label.

For each host a tree of path segments is built, level by level, on counts of distinct shaped paths:

1. Segments that vary by form are wildcards from the start: numbers, long hexadecimal names, slugs.
2. At a node with more than ``fanout`` children, those with under ``1 / fanout`` of its urls become one
   wildcard ``*``: no node keeps more than ``fanout`` + 1 branches.
3. Sibling branches are merged if they are statistically alike: what follows below them is alike (the
   distance of their profiles is within sampling noise), and so are their labels (block rates that a
   two-proportion test can't tell apart). A branch without labels of its own is tested with those that
   the same shaped path has on all hosts; one without any is told by its structure alone.

The leaf a url ends in is its template. A template is rejected if its labelled purity, the block rate
of its labels, is over ``limit``, smoothed by ``strength`` pseudo-counts towards what it inherits: the
block rates of its shaped paths over all hosts, each of which is smoothed in the same way towards that of the
path without its last segment, and so on up to the rate of all labels. So hosts that no rule speaks of
are judged by what the rules say of like paths elsewhere.

Counting merges map-side, so a host with a third of all urls is a few rows to a task; templates go
back to urls by broadcast only while there are few, else by a join that splits hot keys.

Defined results: a null url or one without ``://`` has an empty host and path, and the root template;
an empty path is not a path ``/``; repeated rows count and are judged one by one; without any label every
template is allowed; an empty table gives an empty table; no column but id and url is read.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm import _common as c


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TreePolicy:
    fanout: int = 20
    depth: int = 4
    noise: float = 0.1
    z: float = 1.96
    strength: float = 10.0
    limit: float = 0.8


#: What may follow a branch.
PROFILE = ("end", "number", "mixed", "word")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, by its name; null if none does. Of equally long ones that with the longer host wins."""
    found = None
    for r in sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, r.name) if found is None else found.when(fits, r.name)
    return F.lit(None).cast("string") if found is None else found


def shaped(segment: Column) -> Column:
    """A segment with what varies by form replaced: {h} for hexadecimal names, {s} for slugs, {n} for numbers."""
    slug = F.regexp_replace(segment, r"^[^.]*[-_][^-_.]+[-_][^.]*|^[^.]{41,}", "{s}")
    return F.when(segment.rlike(r"^[0-9a-fA-F-]{16,}$") & segment.rlike("[0-9]"), F.lit("{h}")).otherwise(F.regexp_replace(slug, "[0-9]+", "{n}"))


def segments(path: Column, depth: int) -> Column:
    """The shaped segments of a path; what is deeper than `depth` is one segment **."""
    parts = F.filter(F.split(path, "/", -1), lambda x: x != "")
    short = F.transform(F.slice(parts, 1, depth), shaped)
    return F.when(F.size(parts) > depth, F.concat(short, F.array(F.lit("**")))).otherwise(short)


def _kind(segment: Column) -> Column:
    return F.when(segment.isNull(), "end").when(segment == "{n}", "number").when(segment.contains("{"), "mixed").otherwise("word")


def _evidence(x: dict) -> tuple[float, float]:
    """(labels, blocked) of a branch: its own, or else those of its paths on all hosts."""
    return (x["labels"], x["blocked"]) if x["labels"] else (x["pooled"] / x["n"], x["pooled_blocked"] / x["n"])


def alike(a: dict, b: dict, policy: TreePolicy) -> bool:
    """Whether two sibling branches are statistically alike; a branch: _SUMS and the PROFILE counts."""
    distance = sum(abs(a[k] / a["n"] - b[k] / b["n"]) for k in PROFILE) / 2
    if distance > policy.noise + math.sqrt(len(PROFILE) / (2 * min(a["n"], b["n"]))) / 2:
        return False
    (m, x), (n, y) = _evidence(a), _evidence(b)
    if not m or not n:
        return True
    p = (x + y) / (m + n)
    return abs(x / m - y / n) <= policy.z * math.sqrt(max(0.0, p * (1 - p)) * (1 / m + 1 / n)) + 1e-9


def merge_siblings(branches: list[dict], policy: TreePolicy) -> dict[str, str]:
    """Each branch's name -> the name of its merged branch. Largest first, each joins the first group that it is like."""
    groups: list[tuple[list[str], dict]] = []
    for b in sorted(branches, key=lambda b: (-b["n"], b["branch"])):
        for names, total in groups:
            if alike(total, b, policy):
                names.append(b["branch"])
                for k in (*_SUMS, *PROFILE):
                    total[k] += b[k]
                break
        else:
            groups.append(([b["branch"]], dict(b)))
    return {n: "|".join(sorted(names)) for names, _ in groups for n in names}


#: Urls, labels, blocking labels; and, summed over urls, the labels and blocking labels of their shaped path on all hosts.
_SUMS = ("n", "labels", "blocked", "pooled", "pooled_blocked")


def _merge(batches: Iterator[pa.RecordBatch], policy: TreePolicy) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for host, template, branches in zip(*(b.column(n).to_pylist() for n in ("host", "template", "branches"))):
            rows += [(host, template, k, v) for k, v in merge_siblings(branches, policy).items()]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in columns], names=["host", "template", "branch", "merged"])


def inherit(paths: DataFrame, prior: float, policy: TreePolicy) -> DataFrame:
    """(host, segs, n, labels, blocked) rows -> the same with `above`, the labels and blocking labels that each beginning of the shaped
    path has on all hosts, and `inherited`, the smoothed block rate down to the whole of it."""
    begin = lambda k: F.array_join(F.slice("segs", 1, k), "/")
    known = paths.groupBy("segs").agg(F.sum("labels").alias("l"), F.sum("blocked").alias("b"))
    steps = c.materialize(known.where(F.size("segs") > 0).select("segs", "l", "b", F.explode(F.transform(F.sequence(F.lit(1), F.size("segs")), lambda k: F.struct(k.alias("k"), begin(k).alias("path")))).alias("p")).select("segs", "l", "b", "p.*"), "url-steps")
    pooled = c.materialize(steps.groupBy("k", "path").agg(F.sum("l").alias("pl"), F.sum("b").alias("pb")), "url-pooled")
    told = steps.join(c.guarded(pooled), ["k", "path"]).groupBy("segs").agg(F.array_sort(F.collect_list(F.struct("k", "pl", "pb"))).alias("above"))  # at most depth + 1
    smooth = F.aggregate("above", F.lit(float(prior)), lambda rate, x: (x["pb"] + F.lit(policy.strength) * rate) / (x["pl"] + F.lit(policy.strength)))
    told = c.materialize(told.withColumn("inherited", smooth), "url-told")
    out = paths.join(c.guarded(told), "segs", "left")
    return out.withColumn("inherited", F.coalesce("inherited", F.lit(float(prior))))


def templates(paths: DataFrame, policy: TreePolicy = TreePolicy()) -> DataFrame:
    """inherit()'s rows with distinct (host, segs) -> the same with `template`."""
    paths = c.materialize(paths.withColumn("template", F.lit("")), "url-paths")
    levels = paths.agg(F.max(F.size("segs"))).first()[0] or 0  # at most depth + 1
    for d in range(levels):
        here = paths.where(F.size("segs") > d).withColumn("seg", F.get("segs", F.lit(d))).withColumn("_next", _kind(F.get("segs", F.lit(d + 1))))
        here = here.withColumn("pooled", F.col("n") * F.col("above")[d]["pl"]).withColumn("pooled_blocked", F.col("n") * F.col("above")[d]["pb"])
        kinds = [F.sum(F.when(F.col("_next") == k, F.col("n")).otherwise(0)).alias(k) for k in PROFILE]
        kids = c.materialize(here.groupBy("host", "template", "seg").agg(*(F.sum(k).alias(k) for k in _SUMS), *kinds), "url-kids")
        nodes = c.materialize(kids.groupBy("host", "template").agg(F.count(F.lit(1)).alias("fan"), F.sum("n").alias("total")), "url-nodes")
        rare = (F.col("fan") > policy.fanout) & (F.col("n") * policy.fanout < F.col("total"))
        named = kids.join(c.guarded(nodes), ["host", "template"]).withColumn("branch", F.when(rare, "*").otherwise(F.col("seg")))
        sums = named.groupBy("host", "template", "branch").agg(*(F.sum(k).alias(k) for k in (*_SUMS, *PROFILE)))
        siblings = sums.groupBy("host", "template").agg(F.collect_list(F.struct("branch", *_SUMS, *PROFILE)).alias("branches"))  # at most fanout + 1
        merged = siblings.mapInArrow(lambda it: _merge(it, policy), "host string, template string, branch string, merged string")
        merged = c.materialize(merged, "url-merged")
        step = c.materialize(named.select("host", "template", "seg", "branch").join(c.guarded(merged), ["host", "template", "branch"]).select("host", "template", "seg", "merged"), "url-step")
        deeper = paths.withColumn("seg", F.get("segs", F.lit(d))).join(c.guarded(step), ["host", "template", "seg"], "left")
        further = c.materialize(
            deeper.withColumn("template", F.when(F.col("merged").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "merged"))).drop("seg", "merged"),
            "url-paths",
        )
        for old in (paths, kids, nodes, merged, step):
            c.discard(old)
        paths = further
    return paths


def judge(
    pages: DataFrame, rules: Sequence[Rule], policy: TreePolicy = TreePolicy(), id_col: str = "page_id", url_col: str = "url", taught: Column | None = None
) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity, tree_verdict) for each row; purity is the template's smoothed block rate and
    tree_verdict what the tree says, whether a rule fits or not. `taught` is true for the rows whose rules are labels (all)."""
    c.ship(pages.sparkSession)
    url = F.col(url_col)
    rows = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), (F.lit(True) if taught is None else F.coalesce(taught, F.lit(False))).alias("_taught"))
    rows = rows.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules)).withColumn("segs", segments(F.col("path"), policy.depth))
    blocking = [r.name for r in rules if r.verdict == "block"]
    said = F.when(F.col("rule").isin(blocking) if blocking else F.lit(False), "block").otherwise("allow")
    label = F.col("rule").isNotNull() & F.col("_taught")
    paths = c.materialize(
        rows.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), F.count_if(label).alias("labels"), F.count_if(label & (said == "block")).alias("blocked")), "url-counts"
    )
    total = paths.agg(F.sum("labels").alias("labels"), F.sum("blocked").alias("blocked")).first()
    prior = (total["blocked"] or 0) / total["labels"] if total["labels"] else 0.0
    leaves = templates(inherit(paths, prior, policy), policy)
    inherited = F.sum(F.col("n") * F.col("inherited")) / F.sum("n")
    purity = (F.sum("blocked") + F.lit(policy.strength) * inherited) / (F.sum("labels") + F.lit(policy.strength))
    rates = c.materialize(leaves.groupBy("host", "template").agg(purity.alias("purity")), "url-rates")
    told = c.materialize(leaves.select("host", "segs", "template").join(c.guarded(rates), ["host", "template"]), "url-templates")
    for old in (paths, leaves, rates):
        c.discard(old)
    tree = F.when(F.col("purity") > policy.limit, "block").otherwise("allow")
    verdict = F.when(F.col("rule").isNotNull(), said).otherwise(tree)
    return rows.join(c.guarded(told), ["host", "segs"], "left").select(id_col, "host", "path", "rule", verdict.alias("verdict"), "template", "purity", tree.alias("tree_verdict"))

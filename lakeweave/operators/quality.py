"""Rules as columns: which rows are refused and why, which are accepted with a warning, and the counts of all that."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lakeweave.contracts import Contract, ContractError, Rule
from lakeweave.functions.derive import flags, total

REJECTS, WARNINGS = "_rejects", "_warnings"


def _named(contract: Contract, severity: str) -> list[tuple[str, Column]]:
    return [(r.name, F.expr(contract.text(r.predicate))) for r in contract.rules if r.severity == severity]


def repeated_key(*keys: str) -> Column:
    """Whether a row's key occurs again, as a window count; null keys count as equal."""
    return F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1


def tag(shaped: DataFrame, contract: Contract) -> DataFrame:
    """The rows with _rejects and _warnings, arrays of rule names. Keys are counted over the rows that no rule refuses, so
    that a refused row can't take a sound one with it; all copies of a repeated key are refused, and null keys.

    Only keys are counted, with partial sums; the repeated ones meet the rows by a join that the planner may broadcast or split, so
    that neither a key with many rows nor the rows without a key meet in one task."""
    out = shaped.withColumns({REJECTS: flags(_named(contract, "reject")), WARNINGS: flags(_named(contract, "warn"))})
    if not contract.unique:
        return out
    name = "_".join(contract.unique)
    missing = F.lit(False)
    for k in contract.unique:
        missing = missing | F.col(k).isNull()
    out = out.withColumn(REJECTS, F.when(missing, F.array_append(REJECTS, F.lit(f"missing_{name}"))).otherwise(F.col(REJECTS)))
    sound, mark = F.size(REJECTS) == 0, f"_again{uuid.uuid4().hex[:8]}"
    keys = [f"{mark}_{i}" for i in range(len(contract.unique))]
    counted = out.where(sound).groupBy(*(F.col(f"`{k}`").alias(x) for k, x in zip(contract.unique, keys))).agg(F.count(F.lit(1)).alias(mark))
    same = F.lit(True)
    for k, x in zip(contract.unique, keys):
        same = same & (F.col(f"`{k}`") == F.col(x))
    both = out.join(counted.where(F.col(mark) > 1), same, "left")
    again = sound & F.col(mark).isNotNull()
    return both.withColumn(REJECTS, F.when(again, F.array_append(REJECTS, F.lit(f"duplicate_{name}"))).otherwise(F.col(REJECTS))).drop(mark, *keys)


def accepted(tagged: DataFrame) -> DataFrame:
    """The rows that stay, without their tags."""
    return tagged.where(F.size(REJECTS) == 0).drop(REJECTS, WARNINGS)


def quarantined(tagged: DataFrame) -> DataFrame:
    """The rows that are refused, with `quarantine_reason`, an array of rule names."""
    return tagged.where(F.size(REJECTS) > 0).withColumnRenamed(REJECTS, "quarantine_reason").drop(WARNINGS)


def counts(tagged: DataFrame, observation: Observation) -> DataFrame:
    """The same rows; once an action has run over them, the observation has rows_read, rows_accepted, rows_quarantined and
    rows_warned (accepted rows with a warning)."""
    good = F.size(REJECTS) == 0
    return tagged.observe(
        observation,
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(good).alias("rows_accepted"),
        F.count_if(~good).alias("rows_quarantined"),
        F.count_if(good & (F.size(WARNINGS) > 0)).alias("rows_warned"),
    )


def reconcile(metrics: dict[str, int], contract: Contract) -> None:
    """Refuse counts that don't add up, or that the contract doesn't expect."""
    if metrics["rows_read"] != metrics["rows_accepted"] + metrics["rows_quarantined"]:
        raise ContractError(f"{contract.key}: {metrics} don't add up")
    if contract.expected_rows is not None and metrics["rows_read"] != contract.expected_rows:
        raise ContractError(f"{contract.key}: {metrics['rows_read']} rows were read, {contract.expected_rows} are expected")


def rule_counts(tagged: DataFrame) -> DataFrame:
    """(severity, rule, rows) over all tags."""
    both = F.array(F.struct(F.lit("reject").alias("severity"), F.col(REJECTS).alias("names")), F.struct(F.lit("warn").alias("severity"), F.col(WARNINGS).alias("names")))
    return tagged.select(F.explode(both).alias("t")).select("t.severity", F.explode("t.names").alias("rule")).groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("rows"))


def warn(name: str, predicate: str) -> Rule:
    return Rule(name, predicate, "warn")


def share_out(rows: DataFrame, predicate: str) -> tuple[DataFrame, DataFrame]:
    """(rows for which the predicate is true, all others); null is not true."""
    return rows.where(total(predicate)), rows.where(~total(predicate))

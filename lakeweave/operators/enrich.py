"""Adding context to a fact table by lookups that can neither lose nor multiply its rows.

A lookup's key is proven unique once, by one aggregate over the dimension, which also counts its rows
and measures the bytes of the columns that are taken. A dimension within ``MAX_BROADCAST_ROWS`` and
``MAX_BROADCAST_BYTES`` is broadcast; a larger one is joined by a shuffle, whose skewed partitions the
adaptive planner splits. Each lookup leaves a match status.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lakeweave.contracts import ContractError
from lakeweave.functions.derive import match_status

#: Dimensions with more rows, or more bytes in the columns that are taken, are not broadcast.
MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES = 1_000_000, 64 << 20


@dataclass(frozen=True)
class Lookup:
    """Columns of a dimension for a fact's key, in one role.

    `columns` maps names in the dimension to names in the result, without the prefix. A fact row without a match stays
    with nulls ('keep'), makes the run fail ('fail'), or is refused ('quarantine').
    """

    name: str
    dimension: DataFrame
    fact_key: str
    dimension_key: str
    columns: dict[str, str] = field(default_factory=dict)
    prefix: str = ""
    on_miss: str = "keep"
    keep_key: str = ""

    @property
    def status(self) -> str:
        return f"{self.name}_match_status"


def prove_unique(dimension: DataFrame, key: str, name: str, columns: tuple[str, ...] = ()) -> tuple[int, int]:
    """The number of rows of a dimension, and the bytes of its key and those columns; an action. A key that occurs twice is refused,
    a null key joins nothing."""
    width = F.lit(0)
    for n in (key, *columns):
        kind = dimension.schema[n].dataType.typeName()
        width = width + (F.lit(16) if kind not in ("string", "binary", "array", "map", "struct") else F.coalesce(F.octet_length(F.col(n) if kind in ("string", "binary") else F.to_json(F.struct(n))), F.lit(0)) + 16)
    row = dimension.agg(F.count(key).alias("n"), F.count_distinct(key).alias("k"), F.sum(width.cast("long")).alias("b")).first()
    if row["n"] != row["k"]:
        raise ContractError(f"{name}: {row['n'] - row['k']} rows repeat a key of {key!r}")
    return row["n"], row["b"] or 0


def enrich(fact: DataFrame, lookups: list[Lookup], max_broadcast_rows: int = MAX_BROADCAST_ROWS, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """The fact's rows, each once, with every lookup's columns and its match status behind them."""
    out, statuses = fact, []
    mark = f"_{uuid.uuid4().hex[:8]}"  # no column of the fact or of a dimension has a name with it
    hits, found = [f"_hit{mark}_{i}" for i in range(len(lookups))], [f"_key{mark}_{i}" for i in range(len(lookups))]
    for i, look in enumerate(lookups):
        rows, size = prove_unique(look.dimension, look.dimension_key, look.name, tuple(look.columns))
        side = look.dimension.where(F.col(look.dimension_key).isNotNull()).select(
            F.col(look.dimension_key).alias(found[i]),
            *(F.col(s).alias(f"{look.prefix}{t}") for s, t in look.columns.items()),
            F.lit(True).alias(hits[i]),
        )
        small = rows <= max_broadcast_rows and size <= max_broadcast_bytes
        out = out.join(F.broadcast(side) if small else side, out[look.fact_key] == side[found[i]], "left")
        statuses.append(match_status(F.col(hits[i])).alias(look.status))
    kept = [c for c in out.columns if c not in hits and c not in found]
    keys = [F.col(found[i]).alias(look.keep_key) for i, look in enumerate(lookups) if look.keep_key]
    return out.select(*(F.col(f"`{c}`") for c in kept), *keys, *statuses)


def misses(lookups: list[Lookup], on_miss: str) -> Column:
    """Whether a row lacks a match in any lookup of that policy."""
    out = F.lit(False)
    for look in lookups:
        if look.on_miss == on_miss:
            out = out | (F.col(look.status) == "missing")
    return out


def observe(enriched: DataFrame, lookups: list[Lookup], observation: Observation) -> DataFrame:
    """The same rows; once an action has run, the observation has their number and each lookup's unmatched rows."""
    return enriched.observe(observation, F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(look.status) == "missing").alias(f"{look.name}_unmatched") for look in lookups))


def verify(metrics: dict[str, int], lookups: list[Lookup], fact_rows: int) -> None:
    """Refuse a result whose rows aren't the fact's, or that lacks a match that must be there."""
    if metrics["rows"] != fact_rows:
        raise ContractError(f"the joins made {metrics['rows']} rows of {fact_rows}")
    if bad := {look.name: n for look in lookups if look.on_miss == "fail" and (n := metrics[f"{look.name}_unmatched"])}:
        raise ContractError(f"rows without a match: {bad}")


def unmatched_keys(fact: DataFrame, fact_key: str, dimension: DataFrame, dimension_key: str) -> DataFrame:
    """The fact's distinct keys that the dimension lacks, null included."""
    mark = f"_key{uuid.uuid4().hex[:8]}"
    return fact.select(fact_key).distinct().join(dimension.select(F.col(dimension_key).alias(mark)), F.col(fact_key) == F.col(mark), "left_anti")

"""Declarative dataset contracts: what a source looks like, what its rows become, and which rows are refused.

A contract is data. Expressions are Spark SQL text over the shaped columns, so that a contract can be
kept in JSON or YAML; they are compiled to Catalyst columns by `lakeweave.operators`.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import types as T

#: Columns that every raw row gets.
LINEAGE = T.StructType(
    [
        T.StructField("_source_file", T.StringType(), False),
        T.StructField("_source_sha256", T.StringType(), False),
        T.StructField("_ingested_at", T.TimestampType(), False),
        T.StructField("_run_id", T.StringType(), False),
        T.StructField("_schema_version", T.StringType(), False),
    ]
)


class ContractError(ValueError):
    """A contract, a source or a run breaks what was declared."""


@dataclass(frozen=True)
class Field:
    """A column of the source: its name there, its type as DDL, and its name in the shaped table."""

    source: str
    type: str
    name: str = ""

    @property
    def target(self) -> str:
        return self.name or self.source


@dataclass(frozen=True)
class Rule:
    """Rows for which `predicate` is true are rejected, or accepted with a warning; null counts as false."""

    name: str
    predicate: str
    severity: str = "reject"


@dataclass(frozen=True)
class Grain:
    """Accepted rows are reduced to one row for each key; measures are (name, aggregate as SQL)."""

    keys: tuple[str, ...]
    measures: tuple[tuple[str, str], ...]
    expected_rows: int | None = None


@dataclass(frozen=True)
class Contract:
    """A dataset. `where` keeps rows of the source before anything else is counted; `derive` adds columns in order;
    keys in `unique` must name one accepted row (rows with a repeated or null key are rejected, all copies)."""

    key: str
    logical_name: str
    format: str
    fields: tuple[Field, ...]
    path: str = ""
    version: str = "1"
    where: str = ""
    derive: tuple[tuple[str, str], ...] = ()
    rules: tuple[Rule, ...] = ()
    unique: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    grain: Grain | None = None
    time_semantics: str = ""
    expected_rows: int | None = None
    parameters: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.format not in ("csv", "parquet"):
            raise ContractError(f"{self.key}: unknown format {self.format!r}")
        names = [f.target for f in self.fields] + [n for n, _ in self.derive]
        if twice := {n for n in names if names.count(n) > 1}:
            raise ContractError(f"{self.key}: columns declared twice: {sorted(twice)}")
        if odd := {r.severity for r in self.rules} - {"reject", "warn"}:
            raise ContractError(f"{self.key}: unknown severities {sorted(odd)}")

    def source_schema(self) -> T.StructType:
        """The declared schema of the source, in its own names and order."""
        return T.StructType([T.StructField(f.source, T.StructType.fromDDL(f"`x` {f.type}")["x"].dataType) for f in self.fields])

    def text(self, expression: str) -> str:
        """An expression with the contract's parameters put in."""
        for name, value in self.parameters.items():
            expression = expression.replace("{" + name + "}", value)
        return expression


class Registry:
    """Contracts by key."""

    def __init__(self, contracts: tuple[Contract, ...] = ()):
        self._by_key = {c.key: c for c in contracts}
        if len(self._by_key) < len(contracts):
            raise ContractError("a dataset key is used twice")

    def __getitem__(self, key: str) -> Contract:
        if key not in self._by_key:
            raise KeyError(f"no dataset {key!r}; there are: {', '.join(sorted(self._by_key))}")
        return self._by_key[key]

    def keys(self) -> list[str]:
        return sorted(self._by_key)

    def select(self, name: str) -> list[Contract]:
        """The contract of that key, or every one for 'all'."""
        return [self._by_key[k] for k in self.keys()] if name == "all" else [self[name]]

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps([asdict(self._by_key[k]) for k in self.keys()], indent=1))


def load(path: str | Path) -> Registry:
    """Contracts from a JSON file, or a YAML file where a YAML parser is installed."""
    text = Path(path).read_text()
    if str(path).endswith((".yml", ".yaml")):
        import yaml

        rows = yaml.safe_load(text)
    else:
        rows = json.loads(text)
    base = Path(path).resolve().parent
    return Registry(tuple(_contract(r, base) for r in rows))


def _contract(row: dict, base: Path) -> Contract:
    row = dict(row)
    row["fields"] = tuple(Field(**f) for f in row["fields"])
    row["derive"] = tuple((n, e) for n, e in row.get("derive", ()))
    row["rules"] = tuple(Rule(**r) for r in row.get("rules", ()))
    row["unique"], row["partition_by"] = tuple(row.get("unique", ())), tuple(row.get("partition_by", ()))
    if row.get("grain"):
        g = dict(row["grain"])
        row["grain"] = Grain(tuple(g["keys"]), tuple((n, e) for n, e in g["measures"]), g.get("expected_rows"))
    if row.get("path") and "://" not in row["path"] and not Path(row["path"]).is_absolute():
        row["path"] = str(base / row["path"])
    return Contract(**row)

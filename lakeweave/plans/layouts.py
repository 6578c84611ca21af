"""Comparing physical layouts of one table: write times, active files, query times, plans and result signatures."""

from __future__ import annotations

import contextlib
import hashlib
import io
import json
import statistics
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row

from lakeweave.contracts import ContractError
from lakeweave.sources.snapshots import Lake, Segment
from lakeweave.sources.storage import Store


@dataclass(frozen=True)
class Layout:
    """A way to keep a table: its partition columns, and the columns that files are clustered by."""

    name: str
    partition_by: tuple[str, ...] = ()
    cluster_by: tuple[str, ...] = ()
    files: int = 0


def materialize(lake: Lake, source: Callable[[], DataFrame], layout: Layout, compression: str = "snappy") -> dict:
    """Write the source in a layout; the time includes reading it. Only files of the new version count."""
    began = time.perf_counter()
    rows = source()
    if layout.cluster_by:
        keys = (*layout.partition_by, *layout.cluster_by)
        rows = (rows.repartitionByRange(layout.files, *keys) if layout.files else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    staged = lake.stage(rows, layout.partition_by, compression=compression)
    lake.table(layout.name).adopt([Segment(staged.path, staged.path)], staged.schema, layout.partition_by, mode="overwrite")
    seconds = time.perf_counter() - began
    return {"write_seconds": round(seconds, 3), "rows": lake.table(layout.name).read().count()} | lake.table(layout.name).active_stats()


def signature(rows: Iterable[Row]) -> str:
    """A digest of the rows that neither their order nor that of their columns changes."""
    lines = sorted(json.dumps({k: str(v) for k, v in r.asDict(recursive=True).items()}, sort_keys=True) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def plan_text(df: DataFrame) -> str:
    """The physical plan; once the frame has been executed, the one that was run."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def time_query(build: Callable[[], DataFrame], repeats: int = 3) -> dict:
    """One warm-up and `repeats` measured runs of a query whose result is small."""
    samples = []
    for _ in range(repeats + 1):
        df = build()
        began = time.perf_counter()
        rows = df.collect()
        samples.append(round((time.perf_counter() - began) * 1000, 3))
    return {"warm_up_ms": samples[0], "samples_ms": samples[1:], "median_ms": round(statistics.median(samples[1:]), 3), "rows": len(rows), "signature": signature(rows), "plan": plan_text(df)}


def compare(lake: Lake, source: Callable[[], DataFrame], layouts: list[Layout], queries: dict[str, Callable[[DataFrame], DataFrame]], repeats: int = 3, expected_rows: int | None = None) -> dict:
    """Every query over every layout; refuses layouts whose rows or results differ."""
    storage = {x.name: materialize(lake, source, x) for x in layouts}
    counts = {s["rows"] for s in storage.values()}
    if len(counts) > 1 or expected_rows is not None and counts != {expected_rows}:
        raise ContractError(f"the layouts hold {sorted(counts)} rows")
    timings = {x.name: {n: time_query(lambda q=q, x=x: q(lake.table(x.name).read()), repeats) for n, q in queries.items()} for x in layouts}
    for n in queries:
        if len({timings[x.name][n]["signature"] for x in layouts}) > 1:
            raise ContractError(f"the layouts disagree on {n}")
    return {"storage": storage, "queries": timings}


def write_report(store: Store, report: dict, folder: str) -> list[str]:
    """The report without plans, and the plans, as JSON files in a folder of any store."""
    plans = {f"{x}/{n}": q["plan"] for x, qs in report["queries"].items() for n, q in qs.items()}
    slim = report | {"queries": {x: {n: {k: v for k, v in q.items() if k != "plan"} for n, q in qs.items()} for x, qs in report["queries"].items()}}
    out = []
    for name, what in (("layout_report.json", slim), ("layout_plans.json", plans)):
        out.append(f"{folder.rstrip('/')}/{name}")
        store.delete(out[-1])
        store.create(out[-1], json.dumps(what, indent=2, sort_keys=True, default=str))
    return out

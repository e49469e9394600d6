"""Physical-plan inspection through the public ``explain`` output."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")
PAIR_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin")


def explain(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def python_nodes(plan: str) -> list[str]:
    return [n for n in PYTHON_NODES if n in plan]


def pair_nodes(plan: str) -> list[str]:
    return [n for n in PAIR_NODES if n in plan]


def pushed_filters(plan: str) -> list[str]:
    return re.findall(r"PushedFilters: (.*)$", plan, flags=re.M)


def read_schemas(plan: str) -> list[str]:
    return re.findall(r"ReadSchema: (struct<.*?>)", plan)


def exchanges(plan: str) -> int:
    """Number of shuffle exchanges in the initial physical plan."""
    return len(re.findall(r"^\(\d+\) Exchange", plan, flags=re.M))


def _tree(plan: str) -> list[tuple[int, str]]:
    """(depth, node text) for each node of a ``simple`` explain string."""
    nodes = []
    for line in plan.splitlines():
        if not line.strip() or line.startswith("=="):
            continue
        stripped = line.lstrip(" :|+-")
        depth = len(line) - len(stripped)
        nodes.append((depth, stripped))
    return nodes


def single_partition_inputs(plan: str) -> list[str]:
    """For every ``Exchange SinglePartition`` in a ``simple`` (non-adaptive) plan, the
    first operator below it that is an aggregate, an exchange or a scan, following the
    first child. A single-partition exchange is only safe at scale when that operator is
    an aggregate: then it moves grouped rows, not table rows."""
    nodes = _tree(plan)
    found = []
    for i, (depth, text) in enumerate(nodes):
        if not text.startswith("Exchange SinglePartition"):
            continue
        for d, t in nodes[i + 1 :]:
            if d <= depth:
                break
            head = re.sub(r"^\*\(\d+\)\s*", "", t)
            if head.startswith(("HashAggregate", "ObjectHashAggregate", "SortAggregate")):
                found.append("aggregate")
                break
            if head.startswith(("Exchange", "FileScan", "Scan", "BatchScan")):
                found.append(head)
                break
    return found

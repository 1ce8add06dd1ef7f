"""What a query did when it ran: the figures of each node of its final plan, and all executions of a piece of work."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Nodes that only hold others.
_WRAPPERS = ("AdaptiveSparkPlan", "WholeStageCodegen", "InputAdapter", "ResultQueryStage")
#: Spark's metrics by what is said of them here; times in milliseconds.
_ROWS, _FILES, _BYTES = "numOutputRows", "numFiles", ("filesSize", "dataSize", "shuffleBytesWritten")
_TIMES = {"scanTime": 1.0, "pipelineTime": 1.0, "aggTime": 1.0, "sortTime": 1.0, "collectTime": 1.0, "buildTime": 1.0, "broadcastTime": 1.0, "shuffleWriteTime": 1e-6, "fetchWaitTime": 1.0, "metadataTime": 1.0}


@dataclass(frozen=True)
class Node:
    """A node of a plan that ran; depth 0 is its root. Figures that Spark does not keep for it are None."""

    depth: int
    name: str
    text: str
    rows: int | None
    ms: float | None
    bytes: int | None
    files: int | None


def _children(node) -> list:
    """What a node stands on; of query stages, the plan that they ran, and subqueries after it."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return [node.executedPlan()]
    if name.endswith("QueryStageExec"):
        return [node.plan()]
    if name == "ReusedExchangeExec":
        return []
    found = node.children()
    return [found.apply(i) for i in range(found.size())]


def nodes(df: DataFrame) -> list[Node]:
    """The nodes of the plan of ``df`` as it was last run (with collect, or count of its rows), from the root down, depth first.

    Times are sums over tasks. Rows of a scan are those that filters left of the row groups and pages that were
    read, so what was skipped shows.
    """
    out: list[Node] = []

    def walk(node, depth: int) -> None:
        name = node.nodeName()
        if not name.startswith(_WRAPPERS):
            metrics = node.metrics()
            known, keys = {}, metrics.keys().iterator()
            while keys.hasNext():
                key = keys.next()
                known[key] = metrics.apply(key).value()
            times = [known[k] * by for k, by in _TIMES.items() if k in known]
            size = [max(known[k], 0) for k in _BYTES if k in known]
            out.append(Node(depth, name.strip(), node.simpleString(200), known.get(_ROWS, known.get("shuffleRecordsWritten")), round(sum(times), 3) if times else None, size[0] if size else None, known.get(_FILES)))
            depth += 1
        for child in _children(node):
            walk(child, depth)

    walk(df._jdf.queryExecution().executedPlan(), 0)
    return out


def scanned(df: DataFrame) -> tuple[int, int, int]:
    """Rows, bytes and files that the file scans of a query gave, once it has run."""
    scans = [n for n in nodes(df) if n.name.startswith("Scan ") and n.files is not None]
    return sum(n.rows or 0 for n in scans), sum(n.bytes or 0 for n in scans), sum(n.files or 0 for n in scans)


def table(found: list[Node]) -> str:
    """The figures as text, a line a node."""
    show = lambda x, form: "-" if x is None else format(x, form)
    lines = [f"{'rows':>12} {'ms':>10} {'bytes':>14} {'files':>6}  node"]
    lines += [f"{show(n.rows, ',d'):>12} {show(n.ms, ',.1f'):>10} {show(n.bytes, ',d'):>14} {show(n.files, ',d'):>6}  {'  ' * n.depth}{n.text}" for n in found]
    return "\n".join(lines)


@dataclass(frozen=True)
class Execution:
    """One execution of Spark: what called it, how long it took, its plan and its jobs."""

    id: int
    ms: float
    plan: str
    jobs: int


@dataclass
class Recorded:
    """The executions of a block, filled when it ends."""

    executions: list[Execution] = field(default_factory=list)

    @property
    def ms(self) -> float:
        return sum(e.ms for e in self.executions)


@contextlib.contextmanager
def recorded(spark: SparkSession) -> Iterator[Recorded]:
    """Records every execution that this thread starts in the block, with its time; those of other threads are not mixed in.

    A mark in the thread's job description tells them apart, and Spark's own store of executions is read at the end. It holds
    the last 1,000 by default (spark.sql.ui.retainedExecutions).
    """
    context, mark, out = spark.sparkContext, f"search {uuid.uuid4().hex}", Recorded()
    before = context.getLocalProperty("spark.job.description")
    context.setJobDescription(mark)
    try:
        yield out
    finally:
        context.setLocalProperty("spark.job.description", before)
        context._jsc.sc().listenerBus().waitUntilEmpty()
        listed = spark._jsparkSession.sharedState().statusStore().executionsList()
        for i in range(listed.size()):
            e = listed.apply(i)
            if e.description() == mark:
                ended = e.completionTime()
                ms = float(ended.get().getTime() - e.submissionTime()) if ended.isDefined() else float("nan")
                out.executions.append(Execution(e.executionId(), ms, e.physicalPlanDescription(), e.jobs().size()))

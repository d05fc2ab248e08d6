"""What queries did: rows and time of each operator, plans as text, and the planner's rules."""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import DataFrame

from .binding import Plans, items, kind

#: Kinds of operators by the names of Spark's nodes; the first that matches.
OPERATORS = [
    ("nested_loop_join", r"BroadcastNestedLoopJoin|CartesianProduct"),
    ("hash_join", r"HashJoin|SortMergeJoin"),
    ("aggregation", r"Aggregate"),
    ("spool", r"InMemoryTableScan|CTE|UnionLoop|ReusedExchange"),
    ("scan", r"Scan|Range"),
    ("filter", r"^Filter"),
    ("projection", r"^Project"),
    ("sort", r"Sort|TakeOrdered"),
    ("limit", r"Limit"),
]


def operator_of(name: str) -> str | None:
    return next((op for op, pattern in OPERATORS if re.search(pattern, name)), None)


def executed(df: DataFrame) -> list[dict]:
    """Nodes of the plan that ran, top first: depth, name, text, and Spark's metrics (rows, milliseconds, bytes)."""
    out: list[dict] = []

    def visit(node, depth: int) -> None:
        name = kind(node)
        if name == "AdaptiveSparkPlanExec":
            return visit(node.executedPlan(), depth)
        if name in ("WholeStageCodegenExec", "InputAdapter") or name.endswith("QueryStageExec"):
            below = [node.plan()] if name.endswith("QueryStageExec") else items(node.children())
            return [visit(x, depth) for x in below] and None
        metrics, found = {}, node.metrics().iterator()
        while found.hasNext():
            pair = found.next()
            metrics[pair._1()] = pair._2().value()
        out.append({"depth": depth, "name": node.nodeName().strip(), "text": node.simpleString(25), "metrics": metrics})
        for x in items(node.children()):
            visit(x, depth + 1)

    visit(df._jdf.queryExecution().executedPlan(), 0)
    return out


def with_figures(nodes: list[dict]) -> str:
    """The plan that ran, with rows and times."""
    lines = []
    for n in nodes:
        shown = {k: v for k, v in n["metrics"].items() if v and (k.startswith("num") or re.search("time", k, re.I) or k == "dataSize")}
        lines.append("  " * n["depth"] + n["text"][:160] + (f"  [{', '.join(f'{k}={v}' for k, v in sorted(shown.items()))}]" if shown else ""))
    return "\n".join(lines)


def logical(plans: Plans, df: DataFrame, names: dict[str, str]) -> str:
    """The optimised logical plan, one operator a line; names: of tables by the aliases that stand for them."""
    out: list[str] = []

    def texts(seq) -> str:
        return ", ".join(re.sub(r"#\d+L?", "", x.toString()) for x in items(seq))

    def visit(node, depth: int) -> None:
        name, say = kind(node), lambda x: out.append("  " * depth + x)
        below = items(node.children())
        if name in ("SubqueryAlias", "View"):
            table = names.get(node.alias() if name == "SubqueryAlias" else "")
            if table:
                return say(f"Scan table={table}")
            return visit(below[0], depth)
        if name == "Filter":
            say(f"Filter predicate={re.sub(r'#[0-9]+L?', '', node.condition().toString())}")
        elif name == "Join":
            on = node.condition()
            say(f"Join type={node.joinType().sql()}" + (f" predicate={re.sub(r'#[0-9]+L?', '', on.get().toString())}" if on.isDefined() else ""))
        elif name == "Project":
            say(f"Project columns=[{texts(node.projectList())}]")
        elif name == "Aggregate":
            say(f"Aggregate groups=[{texts(node.groupingExpressions())}] columns=[{texts(node.aggregateExpressions())}]")
        elif name == "Sort":
            say(f"Sort keys=[{texts(node.order())}]")
        else:
            say(name)
        for x in below:
            visit(x, depth + 1)

    visit(df._jdf.queryExecution().analyzed(), 0)
    return "\n".join(out)


def rules(df: DataFrame) -> dict:
    """Planner diagnostics: how often rules were tried and took effect, in all and by rule, and the estimated size."""
    qe, trace = df._jdf.queryExecution(), []
    size = qe.optimizedPlan().stats().sizeInBytes()
    found = qe.tracker().rules().iterator()
    while found.hasNext():
        pair = found.next()
        summary = pair._2()
        trace.append({"rule": pair._1().rsplit(".", 1)[-1], "tried": summary.numInvocations(), "applied": summary.numEffectiveInvocations()})
    trace.sort(key=lambda x: x["rule"])
    return {"rules_attempted": sum(x["tried"] for x in trace), "rules_applied": sum(x["applied"] for x in trace), "estimated_bytes": int(size), "trace": trace}


class Telemetry:
    """Counters of an engine: by operator (invocations, rows, milliseconds), by verb and of the parser."""

    def __init__(self) -> None:
        self.operators: dict[str, dict[str, int]] = defaultdict(lambda: {"invocations": 0, "rows": 0, "milliseconds": 0, "bytes": 0})
        self.verbs: dict[str, dict[str, float]] = defaultdict(lambda: {"attempted": 0, "succeeded": 0, "failed": 0, "seconds": 0.0})
        self.statements = {"parsed": 0, "rejected": 0}

    def ran(self, nodes: list[dict]) -> None:
        for n in nodes:
            if op := operator_of(n["name"]):
                held, m = self.operators[op], n["metrics"]
                held["invocations"] += 1
                held["rows"] += m.get("numOutputRows", 0)
                held["milliseconds"] += m.get("scanTime", 0) + m.get("aggTime", 0) + m.get("sortTime", 0) + m.get("buildTime", 0)
                held["bytes"] += m.get("filesSize", 0)

    def wrote(self, op: str, rows: int, size: int, seconds: float) -> None:
        held = self.operators[op]
        held["invocations"] += 1
        held["rows"] += rows
        held["bytes"] += size
        held["milliseconds"] += round(1000 * seconds)

    def verb(self, verb: str, ok: bool, seconds: float, rejected: bool) -> None:
        held = self.verbs[verb]
        held["attempted"] += 1
        held["succeeded" if ok else "failed"] += 1
        held["seconds"] += seconds
        self.statements["rejected" if rejected else "parsed"] += 1

    def snapshot(self) -> dict:
        return {"operators": {k: dict(v) for k, v in self.operators.items()}, "verbs": {k: dict(v) for k, v in self.verbs.items()}, "statements": dict(self.statements)}

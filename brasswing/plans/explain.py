"""EXPLAIN levels: plans as text, JSON and graphs, and figures of a run."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame

from brasswing.sources.sinks import discard

#: Levels shown in Spark's own words.
MODES = {"flounder": "codegen", "asm": "codegen"}


def text(df: DataFrame, mode: str = "formatted") -> str:
    """The plan of ``df`` in one of Spark's explain modes."""
    jvm = df.sparkSession._jvm
    return df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def logical(df: DataFrame) -> str:
    """The optimised logical plan as JSON."""
    return json.dumps(json.loads(df._jdf.queryExecution().optimizedPlan().toJSON()))


def _children(node) -> list:
    found, out = node.children().iterator(), []
    while found.hasNext():
        out.append(found.next())
    return out


def graph(root, staged: bool = False) -> str:
    """A plan as a dot graph whose edges run from producer to consumer; ``staged`` groups operators between exchanges."""
    labels, edges, stage_of = [], [], []

    def visit(node, stage: int) -> int:
        name = node.nodeName()
        number = len(labels)
        labels.append(name.replace('"', "'"))
        stage_of.append(stage)
        below = max(stage_of) + 1 if staged and "Exchange" in name else stage
        for child in _children(node):
            edges.append((visit(child, below), number))
        return number

    visit(root, 0)
    out = ["digraph plan {"]
    for stage in sorted(set(stage_of)):
        nodes = [f'n{i} [label="{labels[i]}"];' for i in range(len(labels)) if stage_of[i] == stage]
        out.append(f"subgraph cluster_{stage} {{ {' '.join(nodes)} }}" if staged else " ".join(nodes))
    return "\n".join([*out, *[f"n{a} -> n{b};" for a, b in edges], "}"])


def data_flow(df: DataFrame) -> str:
    """The optimised logical plan as a dot graph."""
    return graph(df._jdf.queryExecution().optimizedPlan())


def task_graph(df: DataFrame) -> str:
    """The physical plan as a dot graph, its operators grouped into the stages between exchanges."""
    plan = df._jdf.queryExecution().executedPlan()
    return graph(plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan, staged=True)


def phases(df: DataFrame) -> dict[str, int]:
    """Milliseconds of analysis, optimisation and planning."""
    execution = df._jdf.queryExecution()
    execution.executedPlan()
    out, found = {}, execution.tracker().phases().iterator()
    while found.hasNext():
        item = found.next()
        out[item._1()] = int(item._2().durationMs())
    return out


def stages(df: DataFrame) -> tuple[float, list[dict]]:
    """Run ``df`` into the empty sink: wall milliseconds, and figures of every stage that ran."""
    context = df.sparkSession.sparkContext
    group = f"explain-{uuid.uuid4().hex}"
    before = context.getLocalProperty("spark.jobGroup.id")
    context.setJobGroup(group, "EXPLAIN")
    began = time.perf_counter()
    try:
        discard(df)
    finally:
        wall = (time.perf_counter() - began) * 1000
        context.setLocalProperty("spark.jobGroup.id", before)
    context._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, kept = context.statusTracker(), context._jsc.sc().statusStore()
    numbers = sorted({s for j in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(j)) for s in info.stageIds})
    out = []
    for number in numbers:
        s = kept.lastStageAttempt(number)
        if s.status().toString() != "COMPLETE":
            continue
        out.append(
            {
                "stage": number,
                "tasks": s.numCompleteTasks(),
                "run_ms": s.executorRunTime(),
                "cpu_ms": s.executorCpuTime() // 1_000_000,
                "gc_ms": s.jvmGcTime(),
                "input_rows": s.inputRecords(),
                "input_bytes": s.inputBytes(),
                "shuffle_read_bytes": s.shuffleReadBytes(),
                "shuffle_write_bytes": s.shuffleWriteBytes(),
                "spilled_bytes": s.memoryBytesSpilled(),
            }
        )
    return round(wall, 3), out


def performance(df: DataFrame) -> dict[str, float]:
    """Totals of a run into the empty sink, over all stages, with the planning phases."""
    timed = phases(df)
    wall, ran = stages(df)
    totals = {k: sum(s[k] for s in ran) for k in ran[0] if k != "stage"} if ran else {}
    return {"execute_ms": wall, "stages": len(ran)} | totals | {f"{k}_ms": v for k, v in timed.items()}


def task_load(df: DataFrame) -> dict[str, float]:
    """Share of the session's cores that tasks kept busy during a run."""
    wall, ran = stages(df)
    cores, busy = df.sparkSession.sparkContext.defaultParallelism, sum(s["run_ms"] for s in ran)
    return {"execute_ms": wall, "cores": cores, "tasks": sum(s["tasks"] for s in ran), "busy_ms": busy, "load": round(busy / (wall * cores), 4)}


def lines(df: DataFrame, level: str) -> list[str]:
    """What EXPLAIN prints at a level; ValueError for hardware counters."""
    if level in MODES:
        return [text(df, MODES[level])]
    if level == "task traces":
        return [json.dumps(s) for s in stages(df)[1]]
    if level == "dram bandwidth":
        raise ValueError("hardware counters are not available on this engine")
    shown = {"plan": logical, "task graph": task_graph, "data flow": data_flow, "data flow graph": data_flow}
    if level in shown:
        return [shown[level](df)]
    return [json.dumps({"times": phases, "performance": performance, "task load": task_load}[level](df))]

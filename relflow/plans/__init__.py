"""Looking at plans: text, DOT graphs, options, and checks of a plan's shape."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from relflow.relation import Relation, relation


def plan_text(rel: Relation | DataFrame, mode: str = "formatted") -> str:
    """The plan as Spark prints it: simple, extended, codegen, cost or formatted."""
    df = relation(rel).df
    jvm = df.sparkSession._jvm
    return df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def write_plan(location: str, rel: Relation | DataFrame, mode: str = "formatted") -> str:
    """The plan's text, also written to a local file on the driver."""
    text = plan_text(rel, mode)
    with open(location, "w", encoding="utf-8") as out:
        out.write(text)
    return text


def graph(rel: Relation | DataFrame) -> str:
    """The optimised logical plan as a DOT graph."""
    lines = relation(rel).df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    nodes, edges, above = [], [], []
    for i, line in enumerate(x for x in lines if x.strip()):
        label = re.sub(r"^[\s:+|-]+", "", line)
        depth = len(line) - len(label)
        while above and above[-1][0] >= depth:
            above.pop()
        nodes.append(f'  n{i} [label="{label[:100].replace(chr(92), "/").replace(chr(34), chr(39))}"];')
        if above:
            edges.append(f"  n{i} -> n{above[-1][1]};")
        above.append((depth, i))
    return "\n".join(["digraph plan {", "  node [shape=box];", *nodes, *edges, "}"])


def set_options(spark: SparkSession, **options: Any) -> None:
    """Runtime settings; ``_`` stands for a dot in names given as keywords."""
    for k, v in options.items():
        spark.conf.set(k.replace("_", "."), str(v))


def add_resource(spark: SparkSession, path: str) -> None:
    """Makes a file available to all executors."""
    if path.endswith((".py", ".zip", ".egg")):
        spark.sparkContext.addPyFile(path)
    else:
        spark.sparkContext.addFile(path)


def operators_of(rel: Relation | DataFrame) -> list[str]:
    """Names of the physical operators, for assertions on a plan."""
    return re.findall(r"^[\s:+|*()\d-]*([A-Z]\w+)", plan_text(rel, "simple"), flags=re.M)

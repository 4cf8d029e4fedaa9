"""Plans as text and as a list of stages, for diagnosis."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """Catalyst's own explanation: simple, extended, codegen, cost or formatted."""
    jvm = df.sparkSession.sparkContext._jvm
    return df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: (\[[^\n]*\])", explain(df))


def stages(df: DataFrame) -> list[str]:
    """The physical plan cut at its exchanges, from the scans up."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    found: list[list[str]] = [[]]
    for line in plan.splitlines():
        name = re.sub(r"^[\s:+*()\-\d]*", "", line)
        if not name or name.startswith(("AdaptiveSparkPlan", "==")):
            continue
        if re.match(r"(Exchange|BroadcastExchange|ShuffleQueryStage)", name):
            found.append([])
        found[-1].append(name.split(" ")[0].split("(")[0])
    return [" <- ".join(s) for s in reversed(found) if s]

"""Intermediate tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import scratch_path

# What reading an input a second time means: another scan, the same work again, or perhaps other rows.
PLAIN, COSTLY, UNSTABLE = "plain", "costly", "unstable"
# Logical operators by class: what a scan consists of, and what may give other rows whenever it runs.
SCANS = {
    "Project", "Filter", "SubqueryAlias", "View", "LogicalRelation", "LocalRelation", "LogicalRDD", "ExternalRDD", "InMemoryRelation",
    "DataSourceV2Relation", "DataSourceV2ScanRelation", "HiveTableRelation", "Range", "OneRowRelation", "LogicalQueryStage",
}
DRAWS = {"Sample", "GlobalLimit", "LocalLimit", "Tail", "Offset"}


def nature(df: DataFrame) -> str:
    """Whether the optimised plan is a filtered scan, costs more than that, or is not sure to repeat its rows."""
    plan = df._jdf.queryExecution().optimizedPlan()
    found, open_ = PLAIN, [plan]
    while open_:
        node = open_.pop()
        kind = node.getClass().getSimpleName()
        if kind in DRAWS:
            return UNSTABLE
        if kind not in SCANS:
            found = COSTLY
        children = node.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return found if plan.deterministic() else UNSTABLE


def is_plain_scan(df: DataFrame) -> bool:
    """Whether the optimised plan only filters and projects a relation, with the same rows every time."""
    return nature(df) == PLAIN


def reusable(df: DataFrame, name: str) -> DataFrame:
    """For inputs that are read several times: a plain scan as it is, anything else stored once.

    Project to the needed columns first.
    """
    return df if is_plain_scan(df) else stored(df, name)


def steady(df: DataFrame, name: str) -> DataFrame:
    """Rows that are the same whenever they are read: stored only if they might not be, else nothing runs."""
    return stored(df, name) if nature(df) == UNSTABLE else df


def whole_sum(grouped: DataFrame, column: str) -> Column:
    """The sum of a column over all groups, as a scalar.

    It reads all columns, so that Spark finds the shuffle of ``grouped`` in the plan and reuses it.
    """
    others = [F.max(c).alias(f"_{i}") for i, c in enumerate(grouped.columns)]
    return grouped.agg(F.struct(F.sum(column).alias("sum"), *others).alias("all")).scalar()["sum"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""The shipped rules and weakness policy."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tracewright.operators.findings import Rule
from tracewright.operators.policy import policy_rows
from tracewright.sources.files import read_rules

FOLDER = os.path.dirname(os.path.abspath(__file__))


def shipped_rules() -> list[Rule]:
    return read_rules(FOLDER)


def shipped_policy(spark: SparkSession) -> DataFrame:
    """(cwe, category, severity, static, dynamic) of the shipped table, a fixed list that the driver reads."""
    with open(os.path.join(FOLDER, "policy.tsv"), encoding="utf-8") as f:
        return policy_rows(spark.createDataFrame([(i, line.rstrip("\n")) for i, line in enumerate(f)], "ord long, value string"))

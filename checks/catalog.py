"""Registered queries: each Spark job next to the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from checks.tables import Tables, sql, tidy


@dataclass(frozen=True)
class Check:
    build: Callable[[Tables], DataFrame]
    sql: str | None
    digits: int

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(self.build(Tables(spark, sf_dir)), self.digits)


CHECKS: dict[str, Check] = {}


def check(name: str, build: Callable[[Tables], DataFrame], body: str | None = None,
          *tables: str, digits: int = 4) -> None:
    if name in CHECKS:
        raise ValueError(f"query {name} is registered twice")
    CHECKS[name] = Check(build, None if body is None else sql(body, *tables), digits)


def load() -> dict[str, Check]:
    """Import every group of checks and return the full catalogue."""
    from checks import field_checks, filter_checks, join_checks, log_checks  # noqa: F401
    from checks import report_checks, rule_checks, source_checks, text_checks  # noqa: F401

    return CHECKS

"""All queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from eventloom.plans.proxies import Tables

FAMILIES = ["lookup", "statistics", "windows", "series", "cleaning", "texts", "locations", "matching", "graph", "quality", "files"]


class Family:
    """Collects the queries of one module."""

    def __init__(self):
        self.plans: dict[str, Callable[[Tables], DataFrame]] = {}
        self.checks: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def keep(plan: Callable[[Tables], DataFrame]):
            assert name not in self.plans, name
            self.plans[name] = plan
            if sql is not None:
                self.checks[name] = sql
            return plan

        return keep


def families() -> list[Family]:
    return [import_module(f"eventloom.plans.{name}").FAMILY for name in FAMILIES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(plan):
        return lambda spark, folder: plan(Tables(spark, folder))

    return {name: bind(plan) for family in families() for name, plan in family.plans.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in families() for name, sql in family.checks.items()}

"""Every query of the core, with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("text_queries", "web_queries", "page_queries", "whole_queries")


def _all(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(getattr(import_module(f"brookweave.plans.{m}"), name))
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")

"""Registered queries: every operator over the fixture tables, each with its SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .base import Registry


def _registries() -> list[Registry]:
    from . import annotation, catalog, imaging, jobs, matching, output, planning, scalar, solver

    return [m.REGISTRY for m in (scalar, planning, catalog, imaging, matching, solver, output, annotation, jobs)]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for r in _registries() for name, f in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for r in _registries() for name, sql in r.oracles.items()}

"""Runnable queries over the test tables, each with the SQL it is checked against."""

from __future__ import annotations

from studyframe.plans.catalog import (
    dosing, fits, preparation, scalars, smoothers, summaries)

_MODULES = (preparation, scalars, summaries, dosing, smoothers, fits)

QUERIES = {name: build for m in _MODULES for name, build in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}

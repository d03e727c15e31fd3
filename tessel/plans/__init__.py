"""Queries over the driver tables, one module per group of operators."""

from __future__ import annotations

import importlib

MODULES = ("nested", "texts", "records", "joins", "aggregates", "metrics", "retrieval", "files", "builders", "evaluation", "generators", "models", "streams", "rest")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"tessel.plans.{name}")

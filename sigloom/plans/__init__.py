"""Registered queries: one module per family, loaded on demand."""

from __future__ import annotations

import importlib

MODULES: list[str] = ["retrieval", "reducing", "shaping", "patterns", "texts", "profiling", "analytics", "media", "graph"]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"sigloom.plans.{name}")

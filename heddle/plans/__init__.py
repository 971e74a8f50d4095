"""Registered queries with their SQL equivalents."""

from __future__ import annotations

from importlib import import_module

from heddle.registry import Registry

MODULES = ("training", "scans", "texts", "ranking", "graphs", "lifecycles", "governing", "recalls", "clusters", "stores", "governed", "models")


def registries() -> list[Registry]:
    """The registry of every module of queries."""
    return [import_module(f"heddle.plans.{m}").REGISTRY for m in MODULES]

"""Which operator modules the driver entry registers."""

from __future__ import annotations

import importlib

MODULES = (
    "language_id",
    "packing",
    "decontamination",
    "pii",
    "jaccard_join",
    "substring_dedup",
    "quality_rules",
    "quality_classifier",
    "url_filter",
    "warc",
    "secret_scan",
    "whitening",
    "run_detection",
)


def _collect(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"varioflow.llm.{name}"), what)
    return found


def queries() -> dict:
    return _collect("QUERIES")


def oracles() -> dict:
    return _collect("ORACLES")

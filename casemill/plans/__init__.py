"""Named queries over the driver tables, grouped by area."""

from __future__ import annotations

import importlib

AREAS = ("decisions", "cases", "reviews", "checks", "risks", "texts", "parsers", "streams", "files")


def load_all() -> None:
    for area in AREAS:
        importlib.import_module(f"casemill.plans.{area}")

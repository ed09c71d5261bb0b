"""All registered queries."""

from __future__ import annotations

import importlib

from motionlake.catalog.registry import ENTRIES, Entry

MODULES = ("tracks", "poses", "distances", "scores", "notes", "streams", "jobs")


def entries() -> dict[str, Entry]:
    for module in MODULES:
        importlib.import_module(f"motionlake.catalog.{module}")
    return ENTRIES

"""Registered queries over the given tables, each with the SQL it is checked by.

The tables hold no observations or source files, so these are derived from
their rows. Remainders of ids shape what is derived (which side a hint is on,
what kind a site is, which file is broken); no query leaves rows out to be
cheaper.
"""

from __future__ import annotations


def all_queries() -> dict:
    """name → (function of session and table folder, SQL text or None)."""
    import importlib

    found = {}
    for part in ("reducing", "filtering", "scoring", "code", "streams"):
        module = importlib.import_module(f"siftmill.catalog.{part}")
        found.update(module.QUERIES)
    return found

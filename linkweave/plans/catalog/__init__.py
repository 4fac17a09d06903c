"""Query catalogue: name -> (Spark callable, oracle SQL or None)."""

from __future__ import annotations

from importlib import import_module

PARTS = ["scoring", "ledger", "texts", "candidates", "graphs", "logs", "evaluation", "functions"]


def entries() -> dict:
    out: dict = {}
    for part in PARTS:
        for name, entry in import_module(f"{__name__}.{part}").ENTRIES.items():
            if name in out:
                raise ValueError(f"query {name} is listed twice")
            out[name] = entry
    return out

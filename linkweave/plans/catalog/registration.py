"""How a catalogue part registers its queries."""

from __future__ import annotations

from pyspark.sql import functions as F


def registrar(entries: dict):
    def entry(name: str, sql: str | None = None):
        def register(fn):
            entries[name] = (fn, sql)
            return fn

        return register

    return entry


def rounded(name: str, places: int = 6):
    return F.round(F.col(name), places).alias(name)

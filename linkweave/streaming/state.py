"""Keyed state of the streaming jobs, kept in the RocksDB state store.

Each processor remembers a few values per key, whatever the length of the history: a batch
costs its own rows and one look into the state per key. The store is versioned by batch, so
a batch that is run again starts from the same state.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from linkweave import fixed

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession):
    """Queries that are started inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class FirstSeen(StatefulProcessor):
    """Marks the first row of each key over all batches; in a batch the least by ``order``.

    ``names`` are the columns' own names, which not all reach a processor unchanged.
    """

    def __init__(self, order: list[str], names: list[str]):
        self.order, self.names = order, names

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        known, best = self.seen.exists(), None
        for part in rows:
            part = part.set_axis(self.names, axis=1).sort_values(self.order, kind="stable")
            if known:
                yield part.assign(is_first=False)
                continue
            if best is not None:
                part = pd.concat([best, part]).sort_values(self.order, kind="stable")
            best = part.iloc[:1]
            if len(part) > 1:
                yield part.iloc[1:].assign(is_first=False)
        if best is not None:
            self.seen.update((True,))
            yield best.assign(is_first=True)

    def close(self) -> None:
        pass


def first_seen(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``is_first``, true for one row of each key in the whole stream."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy(*key).transformWithStateInPandas(
        FirstSeen(order, rows.columns), f"{schema}, is_first boolean", "Append", "None"
    )


class ChainWalk(StatefulProcessor):
    """Entries of one chain: position and hash of the last one are the state.

    The events that one batch brings for a chain are sorted together; a busy source has
    many chains, and the trigger bounds a batch.
    """

    def __init__(self, order: list[str], names: list[str]):
        self.order, self.names = order, names

    def init(self, handle) -> None:
        self.head = handle.getValueState("head", "seq long, entry_hash string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        seq, last = self.head.get() if self.head.exists() else (-1, fixed.GENESIS_HASH)
        part = pd.concat(list(rows)).set_axis(self.names, axis=1)
        part = part.sort_values(self.order, kind="stable")
        sep, seqs, before, hashes = fixed.FIELD_SEPARATOR, [], [], []
        for fields in part["_fields"]:
            seq += 1
            digest = hashlib.sha256(f"{seq}{sep}{last}{sep}{fields}".encode()).hexdigest()
            seqs.append(seq)
            before.append(last)
            hashes.append(digest)
            last = digest
        self.head.update((seq, last))
        yield part.assign(seq=seqs, prev_hash=before, entry_hash=hashes)

    def close(self) -> None:
        pass


class Sharing(StatefulProcessor):
    """Pages of one identifier: speaks up once a second page has it, then for each new one."""

    def init(self, handle) -> None:
        self.pages = handle.getMapState("pages", "page string", "seen boolean")
        self.count = handle.getValueState("count", "pages long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        before = self.count.get()[0] if self.count.exists() else 0
        told = [k[0] for k in self.pages.keys()] if before == 1 else []  # at most one page
        new = []
        for part in rows:
            for page in part["page"].drop_duplicates():
                if not self.pages.containsKey((page,)):
                    self.pages.updateValue((page,), (True,))
                    new.append(page)
        total = before + len(new)
        self.count.update((total,))
        if new and total > 1:
            pages = told + new
            yield pd.DataFrame(
                {"kind": key[0], "value": key[1], "page": pages, "pages": [total] * len(pages)}
            )

    def close(self) -> None:
        pass


class LinkSums(StatefulProcessor):
    """Sum and number of a link's active items, in exact units, changed by signed deltas.

    The rows bring the stored sum (``units_before, items_before``), which counts when the
    link is met for the first time; links that never change have no state.
    """

    def init(self, handle) -> None:
        self.sums = handle.getValueState("sums", "units long, items long, version long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        known = self.sums.exists()
        units, items, version = self.sums.get() if known else (0, 0, 0)
        for part in rows:
            if not known:
                units, items = int(part["units_before"].iloc[0]), int(part["items_before"].iloc[0])
                known = True
            units += int(part["units"].sum())
            items += int(part["items"].sum())
        self.sums.update((units, items, version + 1))
        yield pd.DataFrame(
            {"hypothesis_id": [key[0]], "units": [units], "items": [items], "version": [version + 1]}
        )

    def close(self) -> None:
        pass


def units(column: str):
    """A stored contribution, rounded to four places, as a whole number."""
    return F.round(F.col(column) * 10_000).cast("long")

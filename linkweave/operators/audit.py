"""Hash-chained audit log: canonical payloads, append, verification.

An entry commits to its own fields and to the entry before it. Verification needs only
each entry and its direct predecessor, which an equi-join on ``seq - 1`` supplies, so a
single chain of any length is checked by all tasks at once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave import fixed

ENTRY_COLUMNS = [
    "chain", "seq", "actor_user_id", "action", "resource_type", "resource_id", "payload",
    "payload_hash", "prev_hash", "entry_hash", "created_at",
]


def _canonical(payload: str | None) -> str:
    try:
        value = json.loads(payload) if payload else {}
    except ValueError:  # no JSON: the text itself, as a JSON string
        value = payload
    return json.dumps(
        {} if value is None else value, sort_keys=True, separators=(",", ":"), ensure_ascii=False
    )


def canonical_json(payload: Column) -> Column:
    """JSON text with sorted keys and no spaces; a missing or empty payload is ``{}``.

    Numbers keep their kind (``1.0`` is not ``1``), which the SQL JSON functions do not.
    """

    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: _canonical(None if pd.isna(x) else x)).astype(object)

    return canonical(payload)


def payload_hash(payload: Column) -> Column:
    return F.sha2(canonical_json(payload), 256)


def own_fields() -> Column:
    """The part of the hashed text that does not depend on the chain position."""
    empty = F.lit("")
    return F.concat_ws(
        fixed.FIELD_SEPARATOR,
        F.coalesce("actor_user_id", empty),
        F.coalesce("action", empty),
        F.coalesce("resource_type", empty),
        F.coalesce("resource_id", empty),
        F.coalesce("payload_hash", empty),
        F.unix_micros("created_at").cast("string"),
    )


def entry_hash() -> Column:
    return F.sha2(
        F.concat_ws(fixed.FIELD_SEPARATOR, F.col("seq").cast("string"), "prev_hash", own_fields()),
        256,
    )


def heads(log: DataFrame) -> DataFrame:
    """Last hash and length of every chain."""
    return log.groupBy("chain").agg(
        F.max_by("entry_hash", "seq").alias("head_hash"),
        F.max("seq").alias("head_seq"),
        F.count(F.lit(1)).alias("entries"),
    )


def _chain_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk sorted rows, carrying only the current chain, position and last hash."""
    chain, seq, last = None, 0, fixed.GENESIS_HASH
    sep = fixed.FIELD_SEPARATOR
    for batch in batches:
        seqs, prevs, hashes = [], [], []
        for key, start, head, fields in zip(
            batch["chain"], batch["_start"], batch["_head"], batch["_fields"]
        ):
            if key != chain:
                chain, seq, last = key, int(start), head
            digest = hashlib.sha256(f"{seq}{sep}{last}{sep}{fields}".encode()).hexdigest()
            seqs.append(seq)
            prevs.append(last)
            hashes.append(digest)
            seq, last = seq + 1, digest
        yield pd.DataFrame(
            {
                "chain": batch["chain"],
                "_row": batch["_row"],
                "seq": seqs,
                "prev_hash": pd.Series(prevs, dtype=object),
                "entry_hash": pd.Series(hashes, dtype=object),
            }
        )


def append(events: DataFrame, order: list[str], log: DataFrame | None = None) -> DataFrame:
    """New entries for ``events``, continuing the chains of ``log``.

    ``log`` needs ``chain, seq, entry_hash`` only; ``order`` must tell a chain's events
    apart.

    Each hash needs the one before, so a chain is walked in order; chains run beside
    each other. Payloads are canonicalised and hashed in parallel beforehand, and the
    walk streams narrow sorted rows, holding one hash in memory whatever the chain's
    length.
    """
    rows = (
        events.withColumn("payload", canonical_json(F.col("payload")))
        .withColumn("payload_hash", F.sha2("payload", 256))
        .withColumn("_fields", own_fields())
        .withColumn("_row", F.concat_ws("/", *[F.col(c).cast("string") for c in order]))
    )
    if log is None:
        started = rows.withColumn("_start", F.lit(0).cast("long")).withColumn(
            "_head", F.lit(fixed.GENESIS_HASH)
        )
    else:
        known = heads(log).select(
            "chain", (F.col("head_seq") + 1).alias("_start"), F.col("head_hash").alias("_head")
        )
        started = (
            rows.join(known, "chain", "left")
            .withColumn("_start", F.coalesce("_start", F.lit(0).cast("long")))
            .withColumn("_head", F.coalesce("_head", F.lit(fixed.GENESIS_HASH)))
        )
    walked = (
        started.select("chain", *order, "_row", "_start", "_head", "_fields")
        .repartition("chain")
        .sortWithinPartitions("chain", *order)
        .select("chain", "_row", "_start", "_head", "_fields")
        .mapInPandas(
            _chain_rows,
            "chain string, _row string, seq long, prev_hash string, entry_hash string",
        )
    )
    return rows.join(walked, ["chain", "_row"]).select(*ENTRY_COLUMNS)


def failures(log: DataFrame) -> DataFrame:
    """Positions that fail, with the first failed check and ``passed``, the entries there
    that come before the failing one.

    Every position holds one entry: a second one, however sound in itself, fails as
    ``sequence``. Comparisons are null-safe, so a missing hash fails too.
    """
    before = log.groupBy("chain", (F.col("seq") + 1).alias("seq")).agg(
        F.min("entry_hash").alias("_before"), F.lit(True).alias("_known")
    )
    seen = log.join(before, ["chain", "seq"], "left")
    first = F.col("seq") == 0
    expected = F.when(first, F.lit(fixed.GENESIS_HASH)).otherwise(F.col("_before"))
    differs = lambda a, b: ~a.eqNullSafe(b)
    check = (
        F.when(F.col("seq").isNull() | (F.col("seq") < 0) | (~first & F.col("_known").isNull()), "sequence")
        .when(differs(F.col("prev_hash"), expected), "prev_hash")
        .when(differs(payload_hash(F.col("payload")), F.col("payload_hash")), "payload_hash")
        .when(differs(entry_hash(), F.col("entry_hash")), "entry_hash")
    )
    sound = F.count_if(F.col("check").isNull())
    return (
        seen.withColumn("check", check)
        .groupBy("chain", "seq")
        .agg(
            F.when(sound == 0, F.min("check")).when(F.count(F.lit(1)) > 1, "sequence").alias("check"),
            F.when(sound > 0, 1).otherwise(0).alias("passed"),
        )
        .where("check IS NOT NULL")
    )


def verify(log: DataFrame) -> DataFrame:
    """Per chain: valid or not, entries checked, first failing entry and its check."""
    first = (
        failures(log)
        .groupBy("chain")
        .agg(F.min(F.struct("seq", "check", "passed")).alias("_f"))
        .select(
            "chain",
            F.col("_f.seq").alias("failed_seq"),
            F.col("_f.check").alias("check"),
            F.col("_f.passed").alias("_passed"),
        )
    )
    counted = log.select("chain", "seq").join(first, "chain", "left")
    good = F.col("check").isNull() | (F.col("seq") < F.col("failed_seq"))
    return counted.groupBy("chain").agg(
        F.count(F.lit(1)).alias("entries"),
        (F.count_if(good) + F.coalesce(F.max("_passed"), F.lit(0))).alias("entries_checked"),
        F.min("failed_seq").alias("failed_seq"),
        F.min("check").alias("check"),
    ).withColumn("valid", F.col("check").isNull())


def timeline(log: DataFrame, limit: int = 15) -> DataFrame:
    """The latest entries by position, with shortened hashes."""
    return (
        log.orderBy(F.desc("seq"), "chain")
        .limit(limit)
        .select(
            "chain", "seq", "action", "resource_type", "resource_id", "created_at",
            F.substring("entry_hash", 1, 16).alias("entry_hash"),
        )
    )

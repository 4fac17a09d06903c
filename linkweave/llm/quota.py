"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources share ``SHARE`` times all words by weight, but none more than ``MOST`` times its
own words; what is left over is shared again. A source's documents lie in hashed blocks
of about ``BLOCK_WORDS`` words. A target of, say, 1.3 times the source takes every block
once and then further blocks in a permuted order until its words are met; the block on the
edge gives documents in hashed order and the document on the edge gives its first words.
So every source meets its target to the word, and no document exceeds its target share
by more than one copy.

The drawn blocks are dealt to output shards exactly: a shard walks down a binary tree
from all shards to itself; at each node the block counts of all sources are split between
the halves by a multivariate hypergeometric draw seeded by the node. Shards compute their
walks independently, agree on every node, and know by it which positions of each source's
permuted sequence are theirs: draws are disjoint and use every block. Inside a shard rows
get a hashed order.

Scale: documents are read twice (sizes, then the mix); only (source, block) totals, at
most ``MAX_BLOCKS`` per source however large it is, are ordered in windows; a hot source
is spread over its blocks. The table of sources is broadcast behind a check of its bound
``MAX_SOURCES`` and grows with the number of sources, not of documents.

Nulls, ties: a null text has size 0 and is taken 0 times; a null source is a source of its
own, listed last; null ids are mixed like others; repeated rows count each. An empty table
gives no rows. Other columns pass through; names with a leading underscore and two letters
or more are reserved.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.llm import common
from linkweave.operators.ranking import running_totals

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 20_000
MAX_BLOCKS = 65_536
SHARD_WORDS = 4_000_000
MAX_SOURCES = 1_000_000
SEED = 8
_LARGE_PRIME = 2_147_483_647


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_size``, the number of words of the text."""
    return docs.withColumn(
        "_size", F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    )


def targets(docs: DataFrame) -> DataFrame:
    """``source, source_size, source_no, target`` for every source of sized documents."""
    totals = docs.groupBy("source").agg(F.sum("_size").alias("source_size"))
    rows = totals.select(
        "source",
        "source_size",
        F.col("source").isNull().alias("_last"),
        F.coalesce("source", F.lit("")).alias("_key"),
        F.lit(1).alias("_one"),
    )
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    numbered = common.stash(
        running_totals(rows, ["_last", "_key"], ["_one"]).select(
            "source",
            "source_size",
            F.col("_one_before").cast("long").alias("source_no"),
            F.element_at(weights, (F.col("_one_before") % len(WEIGHTS) + 1).cast("int")).alias("w"),
        ),
        "sources",
    )
    cap = F.col("source_size") * F.lit(float(MOST))
    level, capped = 0.0, -1
    n, total = numbered.agg(F.count(F.lit(1)), F.sum("source_size")).first()
    if n > MAX_SOURCES:
        raise ValueError(f"{n} sources; MAX_SOURCES is {MAX_SOURCES}")
    while n:
        above = (F.col("w") * level > cap) if capped >= 0 else F.lit(False)
        c, fixed, open_weight = numbered.agg(
            F.count_if(above),
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("w"))), F.lit(0.0)),
        ).first()
        if c == capped or not open_weight:
            break
        capped, level = c, (SHARE * total - fixed) / open_weight
    return numbered.select(
        "source", "source_size", "source_no", F.least(F.col("w") * level, cap).alias("target")
    )


def _plan(docs: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with their block, and per (source, block) what is taken of it."""
    n_blocks = F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / BLOCK_WORDS)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    facts = sources.select(
        F.col("source").alias("_source"),
        F.col("source_no").alias("_no"),
        n_blocks.cast("long").alias("_blocks"),
        whole.cast("long").alias("_whole"),
        (F.round("target").cast("long") - whole * F.col("source_size")).cast("long").alias("_rest"),
    )
    placed = docs.join(F.broadcast(facts), docs["source"].eqNullSafe(F.col("_source"))).withColumn(
        "_block", F.pmod(F.xxhash64("doc_id", "_size", F.lit(SEED)), F.col("_blocks"))
    )
    spin = F.xxhash64("_no", F.lit(SEED))
    blocks = (
        placed.groupBy("_no", "_block")
        .agg(
            F.sum("_size").alias("_words"),
            *[F.first(c).alias(c) for c in ("_blocks", "_whole", "_rest")],
        )
        # a large prime is coprime to the number of blocks: a permutation of them
        .withColumn(
            "_pos", F.pmod(F.col("_block") * F.lit(_LARGE_PRIME) + F.pmod(spin, F.col("_blocks")), F.col("_blocks"))
        )
    )
    order = Window.partitionBy("_no").orderBy("_pos")
    before = F.coalesce(F.sum("_words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("_seq", F.row_number().over(order) - 1).withColumn(
        "_part", F.greatest(F.lit(0), F.least(F.col("_words"), F.col("_rest") - before))
    )
    return placed, common.stash(blocks, "blocks")


def shard_quotas(counts: np.ndarray, n_shards: int, shards: np.ndarray) -> pd.DataFrame:
    """``_no, shard, start, count``: which run of each source's sequence a shard gets."""
    total = int(counts.sum())
    edge = [total * k // n_shards for k in range(n_shards + 1)]
    out = []
    for shard in shards:
        lo, hi, have, start = 0, n_shards, counts.copy(), np.zeros(len(counts), np.int64)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            draw = np.random.default_rng([SEED, lo, hi]).multivariate_hypergeometric(
                have, edge[mid] - edge[lo], method="marginals"
            )
            if shard < mid:
                hi, have = mid, draw
            else:
                lo, have, start = mid, have - draw, start + draw
        some = np.flatnonzero(have)
        out.append(
            pd.DataFrame({"_no": some, "_shard": int(shard), "start": start[some], "count": have[some]})
        )
    return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("_no", "_shard", "start", "count")})


def _shards(blocks: DataFrame) -> DataFrame:
    """``_no, _block, _copy, _shard`` of every drawn block."""
    spark = blocks.sparkSession
    per_source = blocks.groupBy("_no").agg(
        F.sum(F.col("_whole") + (F.col("_part") > 0).cast("long")).alias("drawn"),
        F.sum(F.col("_whole") * F.col("_words") + F.col("_part")).alias("words"),
        F.count(F.lit(1)).alias("n"),
    )
    found = per_source.orderBy("_no").collect()  # at most MAX_SOURCES rows
    counts = np.zeros(max([r["_no"] for r in found], default=-1) + 1, np.int64)
    for r in found:
        counts[r["_no"]] = r["drawn"]
    n_shards = max(1, -(-sum(r["words"] for r in found) // SHARD_WORDS))
    sent = spark.sparkContext.broadcast(counts)

    def walk(frames):
        for frame in frames:
            yield shard_quotas(sent.value, n_shards, frame["id"].to_numpy())

    runs = spark.range(n_shards).mapInPandas(walk, "_no long, _shard long, start long, count long")
    places = runs.select(
        "_no", "_shard", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("count") - 1)).alias("_at")
    )
    size = per_source.select("_no", F.col("n").alias("_n"))
    drawn = (
        blocks.join(F.broadcast(size), "_no")
        .select(
            "_no",
            "_block",
            F.explode(
                F.filter(
                    F.transform(
                        F.sequence(F.lit(0).cast("long"), F.col("_whole")),
                        lambda k: F.struct(
                            k.alias("copy"),
                            (k * F.col("_n") + F.col("_seq")).alias("at"),
                            ((k < F.col("_whole")) | (F.col("_part") > 0)).alias("taken"),
                        ),
                    ),
                    lambda x: x["taken"],
                )
            ).alias("d"),
        )
        .select("_no", "_block", F.col("d.copy").alias("_copy"), F.col("d.at").alias("_at"))
    )
    return drawn.join(places, ["_no", "_at"]).select("_no", "_block", "_copy", "_shard")


def draws(docs: DataFrame) -> DataFrame:
    """Sized ``docs`` with ``source_size, target, _copies``: the copies taken of each row.

    A copy has ``copy`` (from 0), ``words`` (from the start of the text) and ``shard``.
    """
    sources = targets(docs)
    placed, blocks = _plan(docs, sources)
    shards = (
        _shards(blocks)
        .groupBy("_no", "_block")
        .agg(F.map_from_entries(F.collect_list(F.struct("_copy", "_shard"))).alias("_shard_of"))
    )
    state = blocks.select("_no", "_block", "_part", "_words").join(shards, ["_no", "_block"], "left")
    inside = (
        Window.partitionBy("_no", "_block")
        .orderBy(F.xxhash64("doc_id", F.lit(SEED + 1)), "doc_id", "_size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum("_size").over(inside), F.lit(0))
    rows = placed.join(state, ["_no", "_block"]).withColumn(
        "_extra", F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_part") - before))
    )
    copies = F.filter(
        F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("_whole")),
            lambda k: F.struct(
                k.alias("copy"),
                F.when(k < F.col("_whole"), F.col("_size")).otherwise(F.col("_extra")).alias("words"),
                F.element_at("_shard_of", k).alias("shard"),
            ),
        ),
        lambda x: x["words"] > 0,
    )
    facts = sources.select(F.col("source_no").alias("_no2"), "source_size", "target")
    return (
        rows.withColumn("_copies", copies)
        .join(F.broadcast(facts), F.col("_no") == F.col("_no2"))
        .select(*docs.columns, "source_size", "target", "_copies")
    )


def mixture(docs: DataFrame) -> DataFrame:
    """The mix itself: a row per taken copy, ``docs`` plus ``copy, words, shard, position``.

    ``words`` is how many words from the start of the text belong to the mix; ``position``
    orders the rows of a shard. A new name that ``docs`` has already gets the prefix mix_.
    """
    plain = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "source", "text")
    rows = draws(sized(plain).drop("text")).withColumn("_c", F.explode("_copies"))
    position = F.xxhash64("doc_id", "_c.copy", "_c.shard", F.lit(SEED))
    new = {"copy": F.col("_c.copy"), "words": F.col("_c.words"), "shard": F.col("_c.shard"), "position": position}
    return rows.select(
        "_doc.*", *[c.alias(f"mix_{n}" if n in docs.columns else n) for n, c in new.items()]
    )


def taken(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``."""
    base = common.stash(sized(docs.select("doc_id", "source", "text")).drop("text"), "sizes")
    return draws(base).select(
        "doc_id",
        F.col("_size").alias("size"),
        "source_size",
        "target",
        F.aggregate("_copies", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("taken"),
    )

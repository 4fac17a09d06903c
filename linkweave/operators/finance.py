"""Transaction addresses: owner clusters, hop traces, risk, pair evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave import fixed
from linkweave.operators import graph
from linkweave.session import cut_lineage


def named_like(address: str, patterns: tuple[str, ...]) -> Column:
    low = F.lower(F.col(address))
    return reduce(lambda a, b: a | b, [low.contains(p) for p in patterns])


#: Inputs and outputs of a transaction; a missing list counts as an empty one.
ALL_ADDRESSES = (
    "concat(coalesce(inputs, CAST(array() AS array<string>)), "
    "coalesce(outputs, CAST(array() AS array<string>)))"
)
#: Transactions of one address in a slab of the stored adjacency.
SLAB = 100_000


def owner_clusters(tx: DataFrame) -> DataFrame:
    """``address, cluster_id``: all inputs of one transaction share an owner.

    Outputs are only registered. The cluster is named after its smallest address. Empty and
    missing addresses are no addresses and join nothing; a missing list is an empty one.
    """
    named = tx.selectExpr("filter(inputs, x -> x <> '') AS inputs").where("size(inputs) > 1")
    stars = named.selectExpr(
        "inputs[0] AS src", "explode(slice(inputs, 2, size(inputs) - 1)) AS dst"
    )
    seen = tx.selectExpr(f"explode({ALL_ADDRESSES}) AS node").where(
        "node IS NOT NULL AND node <> ''"
    )
    return graph.components(stars, seen).selectExpr(
        "node AS address", "concat('cluster_btc_', root) AS cluster_id"
    )


def adjacency(tx: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """``spends, pays, busy``: who spends in a transaction, whom it pays, both stored.

    Both are dealt once, by address and by transaction, sorted and written; joins with them
    shuffle and sort only the other side. The transactions of a busy address lie in slabs of about
    ``SLAB``; ``busy`` says in how many (None if there is no busy address).
    """
    n = int(tx.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spends = tx.selectExpr("txid", "tx_order", "explode(array_distinct(inputs)) AS address")
    busy = cut_lineage(
        spends.groupBy("address")
        .agg(F.ceil(F.count(F.lit(1)) / SLAB).alias("slabs"))
        .where("slabs > 1 AND address IS NOT NULL")
    )
    if busy.isEmpty():
        busy, spends = None, spends.withColumn("slab", F.lit(0).cast("long"))
    else:
        spends = spends.join(busy, "address", "left").withColumn(
            "slab", F.coalesce(F.pmod(F.xxhash64("txid"), F.col("slabs")), F.lit(0).cast("long"))
        ).drop("slabs")
    pays = tx.selectExpr("txid", "posexplode(outputs) AS (place, address)")
    return (
        cut_lineage(spends.repartition(n, "address", "slab").sortWithinPartitions("address", "slab")),
        cut_lineage(pays.repartition(n, "txid").sortWithinPartitions("txid")),
        busy,
    )


def trace_hops(tx: DataFrame, starts: DataFrame, max_hops: int = 5) -> DataFrame:
    """Breadth-first money trace from ``starts`` (``start``), first reach only.

    Rows: ``start, from_address, to_address, txid, hop_depth, is_mixer_hop``. A reached
    address keeps the parent the queue would have met first: paths are compared by the
    order of their transactions and output places. One level is two joins, through the
    transaction, with the stored adjacency, so inputs and outputs are never multiplied out
    and only the frontier is shuffled; each level is written out reliably.
    """
    spends, pays, busy = adjacency(tx)
    frontier = starts.selectExpr(
        "start", "start AS address", "CAST(array() AS array<struct<o:bigint,p:int>>) AS path"
    ).distinct()
    reached = frontier.select("start", "address")
    levels = []
    for depth in range(1, max_hops + 1):
        slab = F.lit(0).cast("long")
        if busy is not None:
            frontier = frontier.join(busy, "address", "left")
            slab = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("slabs", F.lit(1)) - 1))
        via = (
            spends.join(frontier.select("start", "address", "path", slab.alias("slab")), ["address", "slab"])
            .groupBy("start", "txid", "tx_order")
            .agg(F.min(F.struct("path", "address")).alias("f"))
        )
        steps = pays.join(via, "txid").selectExpr(
            "start",
            "address",
            "struct(concat(f.path, array(struct(tx_order AS o, place AS p))) AS path, "
            "f.address AS from_address, txid) AS s",
        )
        first = (
            steps.join(reached, ["start", "address"], "left_anti")
            .groupBy("start", "address")
            .agg(F.min("s").alias("s"))
        )
        level = cut_lineage(first.selectExpr("start", "address", "s.*"))
        if level.isEmpty():
            break
        levels.append(level.withColumn("hop_depth", F.lit(depth)))
        frontier = level.select("start", "address", "path")
        reached = reached.unionByName(level.select("start", "address"))
    if not levels:
        empty = "start string, from_address string, to_address string, txid string, " \
                "hop_depth int, is_mixer_hop boolean"
        return tx.sparkSession.createDataFrame([], empty)
    rows = reduce(DataFrame.unionByName, levels)
    return rows.select(
        "start",
        "from_address",
        F.col("address").alias("to_address"),
        "txid",
        "hop_depth",
        named_like("address", fixed.MIXER_PATTERNS).alias("is_mixer_hop"),
    )


def trace_summary(starts: DataFrame, trace: DataFrame) -> DataFrame:
    """Addresses reached and mixer contacts per start."""
    sums = trace.groupBy("start").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_mixer_hop").alias("m"),
        F.max("hop_depth").alias("deepest"),
    )
    return starts.select("start").distinct().join(sums, "start", "left").selectExpr(
        "start",
        "coalesce(n, 0L) + 1 AS total_addresses_reached",
        "coalesce(m, 0L) AS mixer_touchpoints_found",
        "coalesce(deepest, 0) AS deepest_hop",
    )


def cluster_risk(tx: DataFrame, cluster_ids: list[str]) -> DataFrame:
    """Risk profile of the asked clusters.

    Addresses are counted once with their number of mentions; each asked id is tested on
    that list in one pass. Volume and mixer mentions are those of all transactions.
    """
    addresses = (
        tx.selectExpr(f"explode({ALL_ADDRESSES}) AS address")
        .groupBy("address")
        .agg(F.count(F.lit(1)).alias("mentions"))
    )
    inside = [
        F.count_if(
            F.col("address").contains(c) | F.col("address").startswith("cluster_")
        ).alias(f"n{i}")
        for i, c in enumerate(cluster_ids)
    ]
    mixers = F.sum(
        F.when(named_like("address", fixed.RISK_MIXER_PATTERNS), F.col("mentions")).otherwise(0)
    ).alias("mixers")
    figures = addresses.agg(mixers, *inside).withColumn("_one", F.lit(1))
    volume = tx.agg(F.sum(F.coalesce("amount", F.lit(1.0))).alias("volume")).withColumn(
        "_one", F.lit(1)
    )
    listed = F.array(
        *[F.struct(F.lit(c).alias("cluster_id"), F.col(f"n{i}").alias("n"))
          for i, c in enumerate(cluster_ids)]
    )
    return (
        figures.join(volume, "_one")
        .select("mixers", "volume", F.explode(listed).alias("r"))
        .selectExpr(
            "r.cluster_id",
            "r.n AS total_addresses",
            "round(volume, 4) AS estimated_volume",
            "mixers AS mixer_exposure_count",
            "least(1D, mixers * 0.35D + r.n * 0.05D) AS risk",
        )
        .selectExpr(
            "cluster_id", "total_addresses", "estimated_volume", "mixer_exposure_count",
            "round(risk, 2) AS risk_score",
            "CASE WHEN risk > 0.6 THEN 'HIGH' WHEN risk > 0.3 THEN 'MEDIUM' ELSE 'LOW' END "
            "AS risk_level",
        )
    )


def pair_evidence(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Financial evidence for address pairs (``id, address_a, address_b``).

    Equal addresses, else equal clusters; no match and missing addresses abstain.
    """
    side = lambda n: clusters.select(
        F.col("address").alias(f"address_{n}"), F.col("cluster_id").alias(f"cluster_{n}"))
    rows = pairs.join(side("a"), "address_a", "left").join(side("b"), "address_b", "left")
    empty = "coalesce(address_a, '') = '' OR coalesce(address_b, '') = ''"
    kind = (
        f"CASE WHEN {empty} THEN 'EMPTY' WHEN address_a = address_b THEN 'DIRECT_ADDRESS_REUSE' "
        "WHEN cluster_a = cluster_b THEN 'UTXO_CO_INPUT_CLUSTER_MATCH' ELSE 'NO_MATCH' END"
    )
    reuse = "match_type IN ('EMPTY', 'DIRECT_ADDRESS_REUSE')"
    return rows.selectExpr("id", "address_a", "address_b", f"{kind} AS match_type").selectExpr(
        "*",
        f"CASE WHEN {reuse} THEN 'btc_address_reuse' ELSE 'btc_co_input_clustering' END "
        "AS feature_name",
        "'FINANCIAL' AS family",
        "'wallet_cluster_btc' AS dependence_group",
        f"CASE WHEN {reuse} THEN 0.95D ELSE 0.90D END AS m_i",
        f"CASE WHEN {reuse} THEN 0.00001D ELSE 0.0001D END AS u_i",
        "match_type IN ('EMPTY', 'NO_MATCH') AS abstain",
        "CASE WHEN match_type IN ('EMPTY', 'NO_MATCH') THEN 0D END AS llr",
    )


def classify_private_coin(rows: DataFrame) -> DataFrame:
    """Privacy grade of private-coin transactions (``address, ring_size, key_image``)."""
    ring = F.coalesce("ring_size", F.lit(0))
    valid = F.coalesce(F.col("address").rlike(fixed.PRIVATE_COIN_ADDRESS), F.lit(False))
    return rows.select(
        "*",
        valid.alias("valid_stealth_address"),
        (valid & F.col("address").startswith("8")).alias("is_subaddress"),
        (F.coalesce("key_image", F.lit("")) != "").alias("key_image_present"),
        F.when(ring >= 16, 0.95).when(ring >= 11, 0.85).when(ring > 0, 0.40).otherwise(0.10)
        .alias("privacy_score"),
        F.when(ring >= 16, "LOW").when(ring >= 11, "MEDIUM").when(ring > 0, "HIGH")
        .otherwise("CRITICAL").alias("decoy_risk_level"),
    )

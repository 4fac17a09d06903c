"""Reads over the ledger tables.

Every read works on whole tables; where the question is about one entity, the function
takes a frame of entity ids and answers for all of them in one job. Limited lists always
carry an id as tie-break. Lists of unbounded length come back as rows, not as one array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave import fixed
from linkweave.operators import ranking
from linkweave.functions import scoring
from linkweave.operators.nesting import nest


def contains_term(column: str | Column, term: str) -> Column:
    """Case-insensitive substring test; the term's own % and _ are plain characters."""
    col = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.lower(col).contains(term.strip().lower()), F.lit(False))


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    rest = [c for c in rows.columns if c not in keys]
    lead = F.struct(*order, *[c for c in rest if c not in order])
    return rows.groupBy(*keys).agg(F.min(lead).alias("_r")).select(
        *[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in rows.columns]
    )


# --- filters ------------------------------------------------------------------------


def actor_list(actors: DataFrame, category: str | None = None, q: str | None = None) -> DataFrame:
    out = actors
    if category:
        out = out.where(F.col("category") == category)
    if q:
        out = out.where(contains_term("primary_alias", q) | contains_term("category", q))
    return out


def review_list(hypotheses: DataFrame, status: str = "ALL") -> DataFrame:
    return hypotheses if status == "ALL" else hypotheses.where(F.upper("status") == status.upper())


# --- evidence and artifacts -----------------------------------------------------------


def evidence_with_artifacts(evidence: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Evidence rows with the digest of their artifact, NULL where it is missing."""
    digests = artifacts.select("artifact_id", F.col("sha256").alias("artifact_sha256"))
    return evidence.join(digests, "artifact_id", "left")


def evidence_provenance(
    evidence: DataFrame, artifacts: DataFrame, limit: int = 10, kind: str | None = None
) -> DataFrame:
    """The latest evidence, optionally of one extraction kind, with digests."""
    rows = evidence.where(contains_term("extraction_method", kind)) if kind else evidence
    latest = rows.orderBy(F.desc("created_at"), "evidence_id").limit(limit)
    return evidence_with_artifacts(latest, artifacts).select(
        "evidence_id",
        "value",
        "extraction_method",
        "dependence_group",
        F.round("confidence", 4).alias("confidence"),
        "source_uri",
        "artifact_sha256",
    )


# --- links ------------------------------------------------------------------------------


def _names(actors: DataFrame, id_col: str, name_col: str) -> DataFrame:
    return actors.select(F.col("actor_id").alias(id_col), F.col("primary_alias").alias(name_col))


def with_actor_names(rows: DataFrame, actors: DataFrame) -> DataFrame:
    """Adds ``subject`` and ``object``: actor names, or the ids of unknown actors."""
    return (
        rows.join(_names(actors, "subject_id", "_s"), "subject_id", "left")
        .join(_names(actors, "object_id", "_o"), "object_id", "left")
        .withColumn("subject", F.coalesce("_s", "subject_id"))
        .withColumn("object", F.coalesce("_o", "object_id"))
        .drop("_s", "_o")
    )


def directed_links(hypotheses: DataFrame) -> DataFrame:
    """Each link once per end: ``actor_id, counterpart_id`` and the link's columns."""
    ends = F.array_distinct(F.array("subject_id", "object_id"))
    rows = hypotheses.withColumn("actor_id", F.explode(ends))
    return rows.withColumn(
        "counterpart_id",
        F.when(F.col("actor_id") == F.col("subject_id"), F.col("object_id")).otherwise(
            F.col("subject_id")
        ),
    )


def _for(rows: DataFrame, ids: DataFrame | None, key: str = "actor_id") -> DataFrame:
    return rows if ids is None else rows.join(ids.select(key), key, "left_semi")


def actor_links(
    hypotheses: DataFrame, actors: DataFrame, actor_ids: DataFrame | None = None
) -> DataFrame:
    """The links of each actor with the counterpart's name."""
    rows = _for(directed_links(hypotheses), actor_ids)
    return (
        rows.join(_names(actors, "counterpart_id", "_n"), "counterpart_id", "left")
        .select(
            "actor_id",
            "hypothesis_id",
            "counterpart_id",
            F.coalesce("_n", "counterpart_id").alias("counterpart"),
            "calibrated_prob",
            "raw_log_lr",
            "status",
        )
    )


def link_headers(
    hypotheses: DataFrame,
    items: DataFrame,
    evidence: DataFrame,
    actors: DataFrame,
    users: DataFrame | None = None,
) -> DataFrame:
    """One row per link: names, tier, capped family totals of its active items.

    With ``users`` (and a column ``reviewer_id``) the reviewer's address is added.
    """
    if users is not None:
        reviewers = users.select(
            F.col("user_id").alias("reviewer_id"), F.col("email").alias("reviewer_email")
        )
        hypotheses = hypotheses.join(reviewers, "reviewer_id", "left")
    live = live_items(items, evidence)
    totals = (
        family_totals(live)
        .groupBy("hypothesis_id")
        .agg(
            # at most one entry per family
            F.array_sort(F.collect_list(F.struct("family", "capped_total"))).alias(
                "family_breakdown"
            )
        )
    )
    counts = live.groupBy("hypothesis_id").agg(
        F.count_if(~F.col("is_contradiction")).alias("supporting"),
        F.count_if("is_contradiction").alias("contradicting"),
    )
    zero = F.lit(0).cast("long")
    return (
        with_actor_names(hypotheses, actors)
        .join(totals, "hypothesis_id", "left")
        .join(counts, "hypothesis_id", "left")
        .withColumn("confidence_tier", scoring.confidence_tier("calibrated_prob"))
        .withColumn("supporting", F.coalesce("supporting", zero))
        .withColumn("contradicting", F.coalesce("contradicting", zero))
    )


def live_items(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """Items whose evidence is not withdrawn; a missing evidence row still shows."""
    gone = evidence.where("retracted_at IS NOT NULL").select("evidence_id")
    return items.join(gone, "evidence_id", "left_anti")


def link_items(
    items: DataFrame, evidence: DataFrame, artifacts: DataFrame | None
) -> DataFrame:
    """The shown items of every link with their provenance; without ``artifacts`` no digests.

    As in ``live_items``, but the evidence ledger, one row per id, is met once: an item
    whose row turns out to be withdrawn goes, one without a row stays.
    """
    source = evidence.select(
        "evidence_id",
        "artifact_id",
        "source_uri",
        "extraction_method",
        "value",
        F.col("dependence_group").alias("_group"),
        F.col("created_at").alias("timestamp"),
        F.col("retracted_at").alias("_gone"),
    )
    shown = items.join(source, "evidence_id", "left").where("_gone IS NULL").drop("_gone")
    if artifacts is None:
        traced = shown.withColumn("artifact_sha256", F.lit(None).cast("string"))
    else:
        traced = evidence_with_artifacts(shown, artifacts)
    return traced.select(
        "hypothesis_id",
        F.when(F.col("is_contradiction"), "contradicting").otherwise("supporting").alias("side"),
        "evidence_id",
        "family",
        F.coalesce("source_uri", F.lit("Unknown")).alias("source_uri"),
        F.coalesce("extraction_method", F.lit("N/A")).alias("extraction_method"),
        F.coalesce("value", F.lit("N/A")).alias("value"),
        F.col("reliability_weight").alias("reliability"),
        "raw_llr",
        "contribution",
        "is_contradiction",
        F.coalesce("_group", F.lit("DEP_NONE")).alias("dependence_group"),
        "timestamp",
        F.col("artifact_sha256").alias("sha256"),
    )


def link_items_nested(
    detail: DataFrame,
    fields: tuple[str, ...] = ("evidence_id", "family", "value", "contribution", "sha256"),
) -> DataFrame:
    return nest(detail, ["hypothesis_id", "side"], F.struct(*fields), "evidence_id")


def family_totals(items: DataFrame, caps: dict[str, float] | None = None) -> DataFrame:
    """Sum of the stored contributions per family, and the same under its cap."""
    cap = scoring.family_cap(caps or fixed.FAMILY_CAPS, None)
    return (
        items.where("NOT is_contradiction")
        .groupBy("hypothesis_id", "family")
        .agg(F.round(F.sum("contribution"), 4).alias("total"))
        .select(
            "hypothesis_id",
            "family",
            "total",
            cap.alias("cap"),
        )
        .select(
            "hypothesis_id",
            "family",
            "total",
            scoring.round_even("least(total, coalesce(cap, total))", 3).alias("capped_total"),
        )
    )


def review_queue(hypotheses: DataFrame, actors: DataFrame, limit: int = 10) -> DataFrame:
    top = (
        hypotheses.where(F.col("status") == "PROPOSED")
        .orderBy(F.desc("calibrated_prob"), "hypothesis_id")
        .limit(limit)
    )
    return with_actor_names(top, actors).select(
        "hypothesis_id", "subject", "object", "calibrated_prob", "raw_log_lr"
    )


def decisions(
    reviews: DataFrame, hypotheses: DataFrame, actors: DataFrame, limit: int | None = 15
) -> DataFrame:
    """Review decisions with a readable pair and the probability of the link."""
    rows = reviews
    if limit is not None:
        rows = rows.orderBy(F.desc("reviewed_at"), "review_id").limit(limit)
    named = with_actor_names(hypotheses, actors).select(
        "hypothesis_id",
        F.concat_ws(" <-> ", "subject", "object").alias("pair"),
        F.round("calibrated_prob", 4).alias("calibrated_prob"),
    )
    return rows.join(named, "hypothesis_id", "left").select(
        "review_id", "decision", "hypothesis_id", "pair", "calibrated_prob", "reviewed_at"
    )


def dashboard(hypotheses: DataFrame) -> DataFrame:
    return hypotheses.agg(
        F.count_if(F.col("status") == "PROPOSED").alias("open_links"),
        F.avg("calibrated_prob").alias("mean_probability"),
    )


# --- actor evidence ----------------------------------------------------------------------


def actor_evidence(
    hypotheses: DataFrame,
    items: DataFrame,
    evidence: DataFrame,
    artifacts: DataFrame,
    actor_ids: DataFrame | None = None,
) -> DataFrame:
    """Evidence cited by any link touching the actor, once per evidence row.

    Of the links only the ends are read, so links that were not scored may be given.
    """
    first = _cited(hypotheses, items, actor_ids)
    return first.join(evidence_with_artifacts(evidence, artifacts), "evidence_id").select(
        "actor_id",
        "evidence_id",
        "family",
        "value",
        "extraction_method",
        "source_uri",
        F.round("contribution", 4).alias("contribution"),
        "is_contradiction",
        "created_at",
        "artifact_sha256",
    )


def _cited(
    hypotheses: DataFrame, items: DataFrame, actor_ids: DataFrame | None = None
) -> DataFrame:
    """``actor_id, evidence_id`` with the first item that cites the evidence for the actor."""
    ends = hypotheses.select("hypothesis_id", "subject_id", "object_id")
    if actor_ids is None:
        cited = _doubled(items, ends)
    else:
        touching = _for(directed_links(ends), actor_ids).select("actor_id", "hypothesis_id")
        cited = items.join(touching, "hypothesis_id")
    cited = cited.select(
        "actor_id", "evidence_id", "hypothesis_id", "id", "family", "contribution",
        "is_contradiction",
    )
    return first_by(cited, ["actor_id", "evidence_id"], ["hypothesis_id", "id"])


def _doubled(items: DataFrame, ends: DataFrame) -> DataFrame:
    """Items once per end of their link.

    An item travels once with both ends to its evidence and is doubled there, where repeats are
    dropped and the evidence is met without a further shuffle.
    """
    return directed_links(items.join(ends, "hypothesis_id").repartition("evidence_id"))


def top_actor_evidence(rows: DataFrame, limit: int = 12) -> DataFrame:
    """The first ``limit`` evidence rows of each actor by id, ranked by weight."""
    by_id = Window.partitionBy("actor_id").orderBy("evidence_id")
    by_weight = Window.partitionBy("actor_id").orderBy(F.desc(F.abs("contribution")), "evidence_id")
    first = rows.withColumn("_n", F.row_number().over(by_id)).where(F.col("_n") <= limit)
    return first.withColumn("position", F.row_number().over(by_weight)).drop("_n")


def actor_timeline(hypotheses: DataFrame, items: DataFrame, evidence: DataFrame) -> DataFrame:
    """What any link of an actor cites, with its ``position`` in time order per actor, undated
    rows first. Which item cites it plays no part, so only ids meet.

    Range partitions: one busy actor spreads over several of them.
    """
    ends = hypotheses.select("hypothesis_id", "subject_id", "object_id")
    cited = _doubled(items.select("hypothesis_id", "evidence_id"), ends)
    dated = evidence.select("evidence_id", "extraction_method", "created_at")
    rows = cited.select("actor_id", "evidence_id").distinct().join(dated, "evidence_id")
    return ranking.positions(rows, "actor_id", ["created_at", "evidence_id"], {})


# --- shared identifiers ----------------------------------------------------------------


def shared_handles(aliases: DataFrame) -> DataFrame:
    """Handles used by more than one actor, case ignored."""
    one_each = aliases.select(
        F.lower("value").alias("handle_key"), "actor_id", "alias_id", "value"
    )
    per_owner = one_each.groupBy("handle_key", "actor_id").agg(
        F.min(F.struct("alias_id", "value")).alias("first")
    )
    return (
        per_owner.groupBy("handle_key")
        .agg(F.count(F.lit(1)).alias("actor_count"), F.min("first").alias("first"))
        .where("actor_count > 1")
        .select("handle_key", F.col("first.value").alias("handle"), "actor_count")
    )


def shared_handle_owners(
    aliases: DataFrame, actors: DataFrame, actor_ids: DataFrame | None = None
) -> DataFrame:
    """One row per shared handle and owner; optionally only handles some actor uses."""
    owners = aliases.select(F.lower("value").alias("handle_key"), "actor_id").distinct()
    shared = shared_handles(aliases)
    if actor_ids is not None:
        used = owners.join(actor_ids.select("actor_id"), "actor_id", "left_semi")
        shared = shared.join(used.select("handle_key"), "handle_key", "left_semi")
    return owners.join(shared, "handle_key").join(
        _names(actors, "actor_id", "_n"), "actor_id", "left"
    ).select("handle_key", "actor_count", "actor_id", F.coalesce("_n", "actor_id").alias("actor"))


def shared_wallet_clusters(wallets: DataFrame, actor_ids: DataFrame | None = None) -> DataFrame:
    """Wallet clusters of more than one actor: owners, addresses, chains in order."""
    rows = wallets.where("cluster_id IS NOT NULL")
    per_owner = rows.groupBy("cluster_id", "actor_id").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("chain").alias("chains")
    )
    out = (
        per_owner.groupBy("cluster_id")
        .agg(
            F.count("actor_id").alias("actor_count"),
            F.sum("n").alias("addresses"),
            # chains are a handful of names
            F.sort_array(F.array_distinct(F.flatten(F.collect_set("chains")))).alias("chains"),
        )
        .where("actor_count > 1")
    )
    if actor_ids is not None:
        used = rows.join(actor_ids.select("actor_id"), "actor_id", "left_semi")
        out = out.join(used.select("cluster_id"), "cluster_id", "left_semi")
    return out


def cluster_owners(wallets: DataFrame, actors: DataFrame) -> DataFrame:
    """One row per cluster and owner with that owner's first address."""
    first = (
        wallets.where("cluster_id IS NOT NULL")
        .groupBy("cluster_id", "actor_id")
        .agg(F.min("address").alias("address"))
    )
    return first.join(_names(actors, "actor_id", "actor"), "actor_id")


def wallet_holdings(wallets: DataFrame, actors: DataFrame) -> DataFrame:
    """Per actor: wallets, those in a cluster, and those in a cluster others share.

    The number of other owners follows from the owners per cluster, so wallets of one
    cluster are never paired with each other.
    """
    owners = cluster_owners(wallets, actors).groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("owners")
    )
    own = cluster_owners(wallets, actors).select(
        "cluster_id", "actor_id", F.lit(1).alias("is_owner")
    )
    rows = (
        wallets.join(owners, "cluster_id", "left")
        .join(own, ["cluster_id", "actor_id"], "left")
        .withColumn(
            "co_owners", F.coalesce("owners", F.lit(0)) - F.coalesce("is_owner", F.lit(0))
        )
    )
    return rows.groupBy("actor_id").agg(
        F.count(F.lit(1)).alias("wallet_count"),
        F.count("cluster_id").alias("clustered_count"),
        F.count_if(F.col("cluster_id").isNotNull() & (F.col("co_owners") > 0)).alias(
            "shared_cluster_count"
        ),
    ).join(_names(actors, "actor_id", "actor"), "actor_id")


TILE = 2_000


def wallet_co_owners(
    wallets: DataFrame, actors: DataFrame, actor_ids: DataFrame, tile: int = TILE
) -> DataFrame:
    """For the asked actors: each wallet and the other owners of its cluster.

    The pairs grow with the square of a cluster. They are made in tiles of about ``tile``
    wallets and as many owners, dealt over as many partitions as there are tiles.
    """
    asked = wallets.join(actor_ids.select("actor_id"), "actor_id", "left_semi").select(
        "actor_id", "address", "chain", "cluster_id"
    )
    others = cluster_owners(wallets, actors).select(
        "cluster_id",
        F.col("actor_id").alias("co_owner_id"),
        F.col("actor").alias("co_owner"),
        F.col("address").alias("co_owner_address"),
    )
    parts = F.ceil(F.count(F.lit(1)) / tile).cast("int")
    owned = others.groupBy("cluster_id").agg(
        parts.alias("_tiles"), F.min("co_owner_id").alias("_lo"), F.max("co_owner_id").alias("_hi")
    )
    held = asked.groupBy("cluster_id").agg(parts.alias("_strips"))
    sizes = owned.join(held, "cluster_id")
    n = sizes.agg(F.sum(F.col("_tiles").cast("long") * F.col("_strips"))).first()[0] or 1
    key = ["cluster_id", "_tile", "_strip"]
    sized = asked.join(sizes, "cluster_id", "left")
    left = (
        sized.withColumn("_tile", F.explode(F.expr("sequence(0, _tiles - 1)")))
        .withColumn("_strip", F.pmod(F.xxhash64("address", "actor_id"), "_strips").cast("int"))
        .select("actor_id", "address", "chain", *key)
        .repartition(n, *key)
    )
    right = (
        others.join(sizes, "cluster_id")
        .withColumn("_tile", F.pmod(F.xxhash64("co_owner_id"), "_tiles").cast("int"))
        .withColumn("_strip", F.explode(F.expr("sequence(0, _strips - 1)")))
        .select("co_owner_id", "co_owner", "co_owner_address", *key)
        .repartition(n, *key)
    )
    shown = ["actor_id", "address", "chain", "cluster_id", "co_owner_id", "co_owner",
             "co_owner_address"]
    none = F.lit(None).cast("string")
    alone = sized.where("_lo IS NULL OR (_lo = actor_id AND _hi = actor_id)").withColumns(
        {"co_owner_id": none, "co_owner": none, "co_owner_address": none}
    )
    pairs = left.join(right, key).where("co_owner_id <> actor_id")
    return pairs.select(*shown).unionByName(alone.select(*shown))


def wallets_and_cluster_owners(wallets: DataFrame, actors: DataFrame) -> DataFrame:
    """All wallets with their cluster, and each owner of a cluster once with their first address.

    A wallet's co-owners are the owners of its cluster other than its own actor; the pairs
    are not written out, as they grow with the square of a cluster.
    """
    own = wallets.select(
        F.lit("wallet").alias("kind"), "cluster_id", "actor_id", "address", "chain",
        F.lit(None).cast("string").alias("owner"),
    )
    owners = cluster_owners(wallets, actors).select(
        F.lit("owner").alias("kind"), "cluster_id", "actor_id", "address",
        F.lit(None).cast("string").alias("chain"), F.col("actor").alias("owner"),
    )
    return own.unionByName(owners)


def shared_infrastructure(services: DataFrame) -> DataFrame:
    """Favicon hashes and certificate digests on more than one service."""
    parts = [
        services.select(F.lit(kind).alias("kind"), F.col(column).cast("string").alias("value"))
        for kind, column in (("favicon", "favicon_hash"), ("tls", "tls_fingerprint"))
    ]
    return (
        reduce(DataFrame.unionByName, parts)
        .where("value IS NOT NULL")
        .groupBy("kind", "value")
        .agg(F.count(F.lit(1)).alias("service_count"))
        .where("service_count > 1")
    )


def listing(rows: DataFrame, key: str, limit: int) -> DataFrame:
    return rows.orderBy(key).limit(limit)


def latest(rows: DataFrame, when: str, key: str, limit: int) -> DataFrame:
    return rows.orderBy(F.desc(when), key).limit(limit)


def case_identifiers(attached: DataFrame) -> DataFrame:
    """The identifiers of each case with their ``position``, newest first."""
    micros = {"_newest": -F.unix_micros("created_at")}
    return ranking.positions(attached, "case_id", ["_newest", "identifier_id"], micros)


# --- rosters and profiles -----------------------------------------------------------------


def roster(actors: DataFrame, aliases: DataFrame, limit: int | None = 100) -> DataFrame:
    """Actors by confidence with the number of their aliases."""
    counts = aliases.groupBy("actor_id").agg(F.count(F.lit(1)).alias("alias_count"))
    rows = actors
    if limit is not None:
        rows = rows.orderBy(F.desc("confidence"), "actor_id").limit(limit)
    return rows.join(counts, "actor_id", "left").select(
        "actor_id",
        "primary_alias",
        "category",
        F.round("confidence", 4).alias("confidence"),
        F.coalesce("alias_count", F.lit(0).cast("long")).alias("alias_count"),
    )


def profile_sections(
    aliases: DataFrame, keys: DataFrame, wallets: DataFrame, accounts: DataFrame
) -> DataFrame:
    """Everything held about an actor as rows: ``actor_id, section, item_id, body``."""

    def section(rows: DataFrame, name: str, item_id: str, *fields: str) -> DataFrame:
        return rows.where("actor_id IS NOT NULL").select(
            "actor_id",
            F.lit(name).alias("section"),
            F.col(item_id).alias("item_id"),
            F.to_json(F.struct(*fields)).alias("body"),
        )

    return (
        section(aliases, "aliases", "alias_id", "value", "platform", "source", "confidence")
        .unionByName(section(keys, "pgp_keys", "key_row_id", "key_id", "fingerprint"))
        .unionByName(section(wallets, "wallets", "wallet_id", "address", "chain", "cluster_id"))
        .unionByName(section(accounts, "accounts", "account_id", "platform", "handle"))
    )


def actor_profiles(actors: DataFrame, sections: DataFrame) -> DataFrame:
    """Actor rows with their nested sections, large sections in several chunks."""
    nested = nest(sections, ["actor_id", "section"], F.col("body"), "item_id")
    head = actors.select(
        "actor_id", "primary_alias", "category", F.round("confidence", 4).alias("confidence"),
        "last_seen",
    )
    return head.join(nested, "actor_id", "left")


def ledger_stats(tables: dict[str, DataFrame], hypotheses: DataFrame, chain: DataFrame) -> DataFrame:
    """Row counts of the ledger tables and the state of the audit chain, as rows."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("figure"), "value")
        for name, df in tables.items()
    ]
    waiting = hypotheses.agg(F.count_if(F.col("status") == "PROPOSED").alias("value")).select(
        F.lit("hypotheses_awaiting_review").alias("figure"), "value"
    )
    log = chain.agg(
        F.sum("entries").alias("entries"), F.count_if(~F.col("valid")).alias("broken")
    ).select(
        F.explode(
            F.array(
                F.struct(F.lit("audit_records").alias("figure"), F.col("entries").alias("value")),
                F.struct(
                    F.lit("audit_chains_broken").alias("figure"), F.col("broken").alias("value")
                ),
            )
        ).alias("r")
    ).select("r.*")
    return reduce(DataFrame.unionByName, [*counts, waiting, log])


# --- lookup and search --------------------------------------------------------------------


def resolve_entity(actors: DataFrame, aliases: DataFrame, term: str) -> DataFrame:
    """Actors whose name, category or any alias holds the term, with those aliases.

    Only matching aliases are gathered per actor, in chunks. A blank term finds nobody.
    """
    if not term.strip():
        actors, aliases = actors.where("false"), aliases.where("false")
    direct = actor_list(actors, q=term).select("actor_id")
    hits = aliases.where(contains_term("value", term))
    found = direct.union(hits.select("actor_id")).distinct()
    matched = nest(hits, ["actor_id"], F.col("value"), "alias_id", "matched_aliases")
    return (
        actors.join(found, "actor_id", "left_semi")
        .join(matched, "actor_id", "left")
        .select(
            "actor_id",
            "primary_alias",
            "category",
            F.round("confidence", 4).alias("confidence"),
            F.coalesce("chunk", F.lit(0)).alias("chunk"),
            F.coalesce("matched_aliases", F.array().cast("array<string>")).alias(
                "matched_aliases"
            ),
        )
    )


def search_branches() -> list[tuple]:
    """Kind, table, searched fields, key, shown value, detail, and whether an actor owns the row."""
    cluster = F.coalesce("cluster_id", F.lit("unclustered"))
    return [
        ("actor", "actors", ["primary_alias", "category"], "actor_id", "primary_alias",
         F.col("category"), True),
        ("alias", "aliases", ["value"], "alias_id", "value", F.col("platform"), True),
        ("account", "accounts", ["handle", "platform"], "account_id", "handle",
         F.col("platform"), True),
        ("wallet", "wallets", ["address", "cluster_id", "chain"], "wallet_id", "address",
         F.concat(F.col("chain"), F.lit(", cluster "), cluster), True),
        ("pgp_key", "pgp_keys", ["key_id", "fingerprint"], "key_row_id", "key_id",
         F.col("fingerprint"), True),
        ("onion_service", "services", ["address", "title"], "service_id", "address",
         F.col("title"), False),
        ("server", "servers", ["ip_address", "asn", "provider"], "server_id", "ip_address",
         F.concat_ws(" / ", "asn", "provider"), False),
        ("evidence", "evidence", ["value", "extraction_method"], "evidence_id", "value",
         F.col("extraction_method"), False),
        ("case", "cases", ["title", "description"], "case_id", "title", F.col("status"), False),
    ]


def universal_search(ledger: dict[str, DataFrame], term: str, limit: int = 8) -> DataFrame:
    """Typed hits for a term over nine tables, ``limit`` per table, no repeats.

    Terms under three characters find nothing.
    """
    t = (term or "").strip()
    owner = _names(ledger["actors"], "actor_id", "actor")
    none = F.lit(None).cast("string")
    parts = []
    for rank, (kind, name, fields, key, value, detail, owned) in enumerate(search_branches()):
        rows = ledger[name]
        test = reduce(lambda a, b: a | b, [contains_term(f, t) for f in fields])
        if len(t) < 3:
            test = F.lit(False)
        shown = F.substring(value, 1, 120) if kind == "evidence" else F.col(value)
        hit = rows.where(test).orderBy(key).limit(limit).select(
            F.lit(rank).alias("branch"),
            F.lit(kind).alias("kind"),
            shown.alias("value"),
            F.col(key).alias("row_id"),
            (F.col("actor_id") if owned else none).alias("actor_id"),
            detail.alias("detail"),
        )
        parts.append(hit)
    hits = reduce(DataFrame.unionByName, parts)
    single = first_by(hits, ["branch", "kind", "value"], ["row_id"])
    return single.join(owner, "actor_id", "left").select(
        "kind", "value", "actor", "actor_id", "detail"
    )


def entity_search(ledger: dict[str, DataFrame], term: str, limit: int = 50) -> DataFrame:
    """Titled hits in five tables, in table order, ``limit`` overall."""
    t = term.strip()
    if not t:
        t = "\x00"  # an empty term finds nothing
    label = F.coalesce("_n", "actor_id")
    named = lambda rows: rows.join(_names(ledger["actors"], "actor_id", "_n"), "actor_id", "left")
    title = lambda text, col: F.concat(F.lit(text), F.col(col))

    def branch(rank, rows, key, kind, heading, snippet, confidence):
        return rows.select(
            F.lit(rank).alias("branch"), F.col(key).alias("entity_id"), F.lit(kind).alias("kind"),
            heading.alias("title"), snippet.alias("snippet"),
            confidence.cast("double").alias("confidence"),
        )

    def top(name, key, fields):
        test = reduce(lambda a, b: a | b, [contains_term(f, t) for f in fields])
        return ledger[name].where(test).orderBy(key).limit(limit)

    parts = [
        branch(0, top("actors", "actor_id", ["primary_alias", "category"]), "actor_id",
               "ACTOR_ALIAS", title("Actor: ", "primary_alias"),
               F.concat_ws(" ", "primary_alias", "category"),
               F.coalesce("confidence", F.lit(0.9))),
        branch(1, named(top("aliases", "alias_id", ["value"])), "alias_id", "ACTOR_ALIAS",
               title("Alias: ", "value"), F.concat_ws(" ", "value", "platform", label),
               F.coalesce("confidence", F.lit(0.85))),
        branch(2, named(top("pgp_keys", "key_row_id", ["fingerprint", "key_id"])), "key_row_id",
               "PGP_KEY", title("PGP Key: ", "key_id"),
               F.concat_ws(" ", "key_id", "fingerprint", label), F.lit(0.99)),
        branch(3, named(top("wallets", "wallet_id", ["address"])), "wallet_id", "CRYPTO_WALLET",
               F.concat(F.lit("Wallet ("), "chain", F.lit("): "), "address"),
               F.concat_ws(" ", "address", "chain", label), F.lit(0.95)),
        branch(4, top("evidence", "evidence_id", ["value"]), "evidence_id", "EVIDENCE",
               title("Evidence: ", "extraction_method"), F.concat_ws(" ", "value", "source_uri"),
               F.coalesce("confidence", F.lit(0.8))),
    ]
    hits = reduce(DataFrame.unionByName, parts)
    return hits.orderBy("branch", "entity_id").limit(limit)

"""The engine's input shapes, derived from the supplied tables.

Each function mirrors one common table expression in ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave import fixed
from linkweave.operators import evidence, fusion


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(col: str) -> Column:
    return F.col(col).cast("string")


# --- evidence and links -----------------------------------------------------------


def item_id() -> Column:
    return F.concat_ws(
        "-",
        text("l_orderkey"),
        text("l_linenumber"),
        text("l_partkey"),
        text("l_suppkey"),
        F.to_date("l_shipdate").cast("string"),
    )


def feature_of_part() -> Column:
    k = F.pmod("l_partkey", F.lit(40))
    names = F.array(*[F.lit(r[0]) for r in fixed.FEATURE_PRIORS])
    return (
        F.when(k == 37, "temporal_impossible_overlap")
        .when(k == 38, "pgp_key_conflict")
        .when(k == 39, "unlisted_feature")
        .otherwise(F.get(names, F.pmod(k, F.lit(11)).cast("int")))
    )


def evidence_rows(spark: SparkSession, d: str) -> DataFrame:
    """Raw evidence rows: one per line item, one link per order."""
    return table(spark, d, "lineitem").select(
        text("l_orderkey").alias("link_id"),
        item_id().alias("id"),
        feature_of_part().alias("feature_name"),
        F.when(F.col("l_tax") >= 0.08, F.lit(3.0)).alias("llr"),
        (F.col("l_quantity") < 6).alias("abstain"),
        (F.lit(1.0) - F.col("l_discount")).alias("source_reliability"),
        (F.lit(1.0) - F.col("l_tax")).alias("credibility_multiplier"),
    )


def evidence_items(spark: SparkSession, d: str) -> DataFrame:
    return evidence.normalise_rows(evidence_rows(spark, d))


def customer_count(spark: SparkSession, d: str) -> int:
    return table(spark, d, "customer").count()


def link_ends(spark: SparkSession, d: str) -> DataFrame:
    """Subject and object actor of each link."""
    n = customer_count(spark, d)
    return table(spark, d, "orders").select(
        text("o_orderkey").alias("link_id"),
        F.concat(F.lit("A"), text("o_custkey")).alias("subject_id"),
        F.concat(
            F.lit("A"),
            F.pmod(
                F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.col("o_custkey") * 7 + 1).otherwise(
                    F.col("o_custkey") + F.pmod("o_orderkey", F.lit(3))
                ),
                F.lit(n),
            ).cast("string"),
        ).alias("object_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def link_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The ends of all links, for reads that need no score; links without items among them."""
    return link_ends(spark, d).select(
        F.concat(F.lit("H"), "link_id").alias("hypothesis_id"), "subject_id", "object_id"
    )


def cited_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Which link cites which evidence: the keys of ``hypothesis_evidence`` without its figures."""
    return evidence_items(spark, d).select(
        F.concat(F.lit("H"), "link_id").alias("hypothesis_id"), F.col("id").alias("evidence_id")
    )


def hypotheses(spark: SparkSession, d: str, items: DataFrame | None = None) -> DataFrame:
    """Stored links: rounded score and probability, status from the decision.

    With ``items``, evidence items of some links, only those links.
    """
    scored = fusion.evaluate(evidence_items(spark, d) if items is None else items)
    return scored.join(link_ends(spark, d), "link_id").select(
        F.concat(F.lit("H"), "link_id").alias("hypothesis_id"),
        "subject_id",
        "object_id",
        F.round("final_llr", 4).alias("raw_log_lr"),
        F.round("posterior_probability", 4).alias("calibrated_prob"),
        _status().alias("status"),
        "decision",
        F.lit("v1.0-LLR").alias("model_version"),
        "created_at",
    )


def _status() -> Column:
    from linkweave.functions import scoring

    return scoring.decision_status("decision")


def hypothesis_evidence(
    spark: SparkSession, d: str, items: DataFrame | None = None
) -> DataFrame:
    """Stored items of the links: rounded contribution per evidence row."""
    return stored_items(fusion.contributions(evidence_items(spark, d) if items is None else items))


def stored_items(contributions: DataFrame) -> DataFrame:
    return contributions.select(
        F.concat(F.lit("HE-"), "evidence_id").alias("id"),
        F.concat(F.lit("H"), "link_id").alias("hypothesis_id"),
        "evidence_id",
        "family",
        F.round("raw_llr", 4).alias("raw_llr"),
        F.round("llr_contrib", 4).alias("contribution"),
        F.col("source_reliability").alias("reliability_weight")
        if "source_reliability" in contributions.columns
        else F.lit(1.0).alias("reliability_weight"),
        "is_contradiction",
    )


def stored_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence ledger rows of the line items, none of them retracted yet."""
    li = table(spark, d, "lineitem")
    return li.select(
        item_id().alias("evidence_id"),
        F.concat(F.lit("art-"), text("l_partkey")).alias("artifact_id"),
        F.concat(F.lit("ledger://orders/"), text("l_orderkey")).alias("source_uri"),
        feature_of_part().alias("extraction_method"),
        F.concat(F.lit("part "), text("l_partkey"), F.lit(" supplier "), text("l_suppkey")).alias(
            "value"
        ),
        (F.lit(1.0) - F.col("l_discount")).alias("confidence"),
        F.concat(F.lit("G"), text("l_suppkey")).alias("dependence_group"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("retracted_at"),
        F.lit(None).cast("string").alias("retracted_by"),
        F.lit(None).cast("string").alias("retraction_reason"),
    )


def retraction_requests(spark: SparkSession, d: str) -> DataFrame:
    """Returned items shipped in December are withdrawn; tax-free ones twice."""
    hit = (F.col("l_returnflag") == "R") & (F.month("l_shipdate") == 12)
    once = table(spark, d, "lineitem").where(hit)
    first = once.select(
        item_id().alias("evidence_id"),
        F.concat(F.lit("u"), text("l_suppkey")).alias("requested_by"),
        F.lit("returned").alias("reason"),
        F.lit(1).alias("request_no"),
        F.col("l_shipdate").cast("timestamp").alias("requested_at"),
    )
    again = once.where(F.col("l_tax") == 0.0).select(
        item_id().alias("evidence_id"),
        F.concat(F.lit("u"), text("l_partkey")).alias("requested_by"),
        F.lit("repeated").alias("reason"),
        F.lit(2).alias("request_no"),
        (F.col("l_shipdate").cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias("requested_at"),
    )
    return first.unionByName(again)


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """Review decisions on the links of urgent orders; some are reviewed twice."""
    urgent = table(spark, d, "orders").where(F.col("o_orderpriority").like("1-%"))
    verb = (
        F.when(F.pmod("o_orderkey", F.lit(3)) == 0, "ACCEPT")
        .when(F.pmod("o_orderkey", F.lit(3)) == 1, "REJECT")
        .otherwise("INSUFFICIENT")
    )
    first = urgent.select(
        F.concat(F.lit("R"), text("o_orderkey"), F.lit("-1")).alias("review_id"),
        F.concat(F.lit("H"), text("o_orderkey")).alias("hypothesis_id"),
        verb.alias("decision"),
        F.concat(F.lit("u"), F.pmod("o_custkey", F.lit(50)).cast("string")).alias("reviewer_id"),
        F.col("o_orderdate").cast("timestamp").alias("reviewed_at"),
    )
    second = urgent.where(F.pmod("o_orderkey", F.lit(4)) == 0).select(
        F.concat(F.lit("R"), text("o_orderkey"), F.lit("-2")).alias("review_id"),
        F.concat(F.lit("H"), text("o_orderkey")).alias("hypothesis_id"),
        F.lit("REJECT").alias("decision"),
        F.lit("u7").alias("reviewer_id"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 2 DAYS")).alias("reviewed_at"),
    )
    return first.unionByName(second)


# --- entities -----------------------------------------------------------------------


def actors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        F.concat(F.lit("A"), text("c_custkey")).alias("actor_id"),
        F.col("c_name").alias("primary_alias"),
        F.col("c_mktsegment").alias("category"),
        (F.pmod("c_custkey", F.lit(97)) / F.lit(100.0)).alias("confidence"),
        F.when(
            F.pmod("c_custkey", F.lit(9)) != 0,
            F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,cast(pmod(c_custkey,365) as int))"),
        ).alias("last_seen"),
    )


def aliases(spark: SparkSession, d: str) -> DataFrame:
    """The customer's name, and the names of the parts ordered (widely shared)."""
    own = table(spark, d, "customer").select(
        F.concat(F.lit("al-"), text("c_custkey"), F.lit("-0")).alias("alias_id"),
        F.concat(F.lit("A"), text("c_custkey")).alias("actor_id"),
        F.col("c_name").alias("value"),
        F.lit("registry").alias("platform"),
        F.lit("customer").alias("source"),
        F.lit(0.95).alias("confidence"),
    )
    ordered = (
        table(spark, d, "orders")
        .join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
        .join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select("o_custkey", "p_name")
        .distinct()
        .select(
            F.concat(F.lit("al-"), text("o_custkey"), F.lit("-"), "p_name").alias("alias_id"),
            F.concat(F.lit("A"), text("o_custkey")).alias("actor_id"),
            F.when(F.pmod("o_custkey", F.lit(2)) == 0, F.upper("p_name"))
            .otherwise(F.col("p_name"))
            .alias("value"),
            F.lit("market").alias("platform"),
            F.lit("orders").alias("source"),
            F.lit(0.80).alias("confidence"),
        )
    )
    return own.unionByName(ordered)


def accounts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        F.concat(F.lit("ac-"), text("c_custkey")).alias("account_id"),
        F.concat(F.lit("A"), text("c_custkey")).alias("actor_id"),
        F.lower("c_mktsegment").alias("platform"),
        F.concat(F.lit("acct_"), text("c_custkey")).alias("handle"),
    )


def pgp_keys(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where(F.pmod("c_custkey", F.lit(3)) == 0)
    digest = F.upper(F.substring(F.sha2(F.col("c_name"), 256), 1, 40))
    return c.select(
        F.concat(F.lit("k-"), text("c_custkey")).alias("key_row_id"),
        digest.alias("fingerprint"),
        F.substring(digest, 25, 16).alias("key_id"),
        F.when(
            F.pmod("c_custkey", F.lit(5)) != 0, F.concat(F.lit("A"), text("c_custkey"))
        ).alias("actor_id"),
    )


def wallets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(
        F.concat(F.lit("w-"), text("s_suppkey")).alias("wallet_id"),
        F.concat(F.lit("addr"), F.lpad(text("s_suppkey"), 8, "0")).alias("address"),
        F.when(F.pmod("s_suppkey", F.lit(3)) == 0, "BTC")
        .when(F.pmod("s_suppkey", F.lit(3)) == 1, "ETH")
        .otherwise("XMR")
        .alias("chain"),
        F.when(
            F.pmod("s_suppkey", F.lit(11)) != 0, F.concat(F.lit("CL_"), text("s_nationkey"))
        ).alias("cluster_id"),
        F.concat(F.lit("A"), F.floor(F.col("s_suppkey") / 2).cast("string")).alias("actor_id"),
    )


def services(spark: SparkSession, d: str) -> DataFrame:
    """Web services: one per page."""
    return table(spark, d, "pages").select(
        F.concat(F.lit("s-"), text("page_id")).alias("service_id"),
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("address"),
        F.when(
            F.pmod("page_id", F.lit(7)) != 0, F.concat(F.lit("Page "), text("page_id"))
        ).alias("title"),
        F.when(F.pmod("page_id", F.lit(4)) != 0, F.pmod(F.col("page_id") * 31, F.lit(97)))
        .cast("int")
        .alias("favicon_hash"),
        F.when(
            F.pmod("page_id", F.lit(3)) == 0,
            F.sha2(F.pmod("page_id", F.lit(60)).cast("string"), 256),
        ).alias("tls_fingerprint"),
    )


def servers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(
        F.concat(F.lit("sv-"), text("s_suppkey")).alias("server_id"),
        F.concat_ws(
            ".",
            F.lit("10"),
            text("s_nationkey"),
            F.floor(F.col("s_suppkey") / 250).cast("string"),
            F.pmod("s_suppkey", F.lit(250)).cast("string"),
        ).alias("ip_address"),
        F.concat(F.lit("AS"), (F.col("s_nationkey") + 64500).cast("string")).alias("asn"),
        F.col("s_name").alias("provider"),
    )


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.concat(F.lit("art-"), text("doc_id")).alias("artifact_id"),
        F.sha2("text", 256).alias("sha256"),
        F.octet_length("text").cast("long").alias("size"),
        F.concat(F.lit("doc://"), "source", F.lit("/"), text("doc_id")).alias("storage_uri"),
    )


def cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(
        F.concat(F.lit("C"), text("n_nationkey")).alias("case_id"),
        F.col("n_name").alias("title"),
        F.when(F.pmod("n_nationkey", F.lit(4)) == 0, "CLOSED").otherwise("OPEN").alias("status"),
        F.concat(F.lit("Region "), text("n_regionkey")).alias("description"),
        F.expr(
            "timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,cast(pmod(n_nationkey*5,17) as int))"
        ).alias("created_at"),
    )


def users(spark: SparkSession, d: str) -> DataFrame:
    """Accounts of the reviewers, one per customer; reviewer number 0 has none."""
    return table(spark, d, "customer").select(
        F.concat(F.lit("u"), text("c_custkey")).alias("user_id"),
        F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.org")).alias("email"),
        F.when(F.pmod("c_custkey", F.lit(9)) == 0, "ADMIN").otherwise("ANALYST").alias("role"),
    )


def identifier_requests(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers to attach to cases: repeated, blank and for unknown cases among them."""
    k = F.col("o_custkey")
    return table(spark, d, "orders").select(
        F.concat(F.lit("ID"), text("o_orderkey")).alias("identifier_id"),
        F.concat(F.lit("C"), F.pmod(k, F.lit(30)).cast("string")).alias("case_id"),
        F.when(F.pmod(k, F.lit(3)) == 0, "handle").otherwise("wallet").alias("id_type"),
        F.when(F.pmod("o_orderkey", F.lit(17)) == 0, "  ")
        .otherwise(F.concat(F.lit(" x"), F.floor(k / 40).cast("string"), F.lit(" ")))
        .alias("value"),
        F.concat(F.lit("u"), F.pmod(k, F.lit(50)).cast("string")).alias("added_by"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


# --- observations, events, transactions ----------------------------------------------


def raw_observations(spark: SparkSession, d: str) -> DataFrame:
    """Documents as observations; one basis in four is outside the closed set."""
    bases = F.array(*[F.lit(b) for b in (*fixed.LAWFUL_BASES, "unstated")])
    types = F.array(*[F.lit(t) for t in fixed.SOURCE_TYPES])
    return table(spark, d, "documents").select(
        F.concat(F.lit("obs-"), F.lpad(text("doc_id"), 12, "0")).alias("observation_id"),
        F.col("text").alias("raw_content"),
        F.col("source").alias("source_name"),
        F.get(types, F.pmod("doc_id", F.lit(4)).cast("int")).alias("source_type"),
        F.get(bases, F.pmod(F.floor(F.col("doc_id") / 3), F.lit(4)).cast("int")).alias(
            "lawful_basis"
        ),
        F.concat(F.lit("doc://"), "source").alias("source_uri"),
    )


def texts_with_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Documents and pages, each closed by identifiers made from its own digest."""
    docs = table(spark, d, "documents").select(
        F.concat(F.lit("d"), text("doc_id")).alias("text_id"),
        F.col("doc_id").alias("n"),
        F.col("text").alias("body"),
    )
    pages = table(spark, d, "pages").select(
        F.concat(F.lit("p"), text("page_id")).alias("text_id"),
        F.col("page_id").alias("n"),
        F.col("html").alias("body"),
    )
    both = docs.unionByName(pages).withColumn("h", F.sha2("body", 256))
    long_hex = F.concat("h", "h")
    base58 = F.translate(long_hex, "0", "g")
    base32 = F.translate(long_hex, "0189", "wxyz")
    k = F.pmod("n", F.lit(7))
    tail = (
        F.when(k == 0, F.upper(F.substring("h", 1, 40)))
        .when(k == 1, F.concat(F.lit("1"), F.substring(base58, 1, 33)))
        .when(k == 2, F.concat(F.lit("0x"), F.substring("h", 1, 40)))
        .when(k == 3, F.concat(F.lit("4A"), F.substring(base58, 1, 93)))
        .when(k == 4, F.concat(F.substring(base32, 1, 56), F.lit(".onion")))
        .when(k == 5, F.concat(F.lit("u"), text("n"), F.lit("@mail.example.org")))
        .otherwise(F.concat(F.lit("@user_"), text("n")))
    )
    return both.select("text_id", F.concat("body", F.lit(" "), tail).alias("body"))


def audit_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as log entries waiting to be chained, one chain per user."""
    return table(spark, d, "events").select(
        F.concat(F.lit("u"), text("user_id")).alias("chain"),
        F.concat(F.lit("u"), text("user_id")).alias("actor_user_id"),
        F.col("event_type").alias("action"),
        F.lit("EVENT").alias("resource_type"),
        text("event_id").alias("resource_id"),
        F.col("props").alias("payload"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("event_id").alias("order_id"),
    )


def access_log(spark: SparkSession, d: str) -> DataFrame:
    path = (
        F.when(
            F.col("event_type") == "purchase",
            F.concat(F.lit("/api/v1/hypotheses/"), text("user_id"), F.lit("/review")),
        )
        .when(
            F.col("event_type") == "signup", F.concat(F.lit("/api/v1/cases/"), text("user_id"))
        )
        .when(F.col("event_type") == "error", F.lit("/health"))
        .otherwise(F.concat(F.lit("/api/v1/actors/"), text("user_id")))
    )
    return table(spark, d, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type").isin("purchase", "signup"), "POST")
        .otherwise("GET")
        .alias("method"),
        path.alias("path"),
        F.when(F.col("value") > 100, 500).when(F.col("value") > 50, 404).otherwise(200).alias(
            "status"
        ),
        F.col("value").alias("duration"),
        F.col("event_type").alias("action"),
    )


def address(number: Column) -> Column:
    """Address of a number; one in 101 carries a mixer's name."""
    plain = F.concat(F.lit("a"), number.cast("string"))
    return F.when(F.pmod(number, F.lit(101)) == 0, F.concat(plain, F.lit("_wasabi"))).otherwise(
        plain
    )


def transactions(spark: SparkSession, d: str) -> DataFrame:
    """One transaction per order.

    Inputs are the part addresses of all its lines, so orders that share a part share an
    owner; the outputs are the customer's address and the one after the last part's. Every
    seventh order has an empty input besides, which is no address.
    """
    lines = (
        table(spark, d, "lineitem")
        .select(
            F.col("l_orderkey"),
            F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"),
                     F.col("l_suppkey").alias("s")).alias("line"),
        )
        .groupBy("l_orderkey")
        .agg(F.sort_array(F.collect_list("line")).alias("all"))  # seven lines at most
        .withColumn("z", F.element_at("all", -1))
    )
    blank = F.when(F.pmod("o_orderkey", F.lit(7)) == 0, F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    far = F.lit(10_000_000)
    return (
        table(spark, d, "orders")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .select(
            F.concat(F.lit("tx"), F.lpad(text("o_orderkey"), 12, "0")).alias("txid"),
            F.col("o_orderkey").alias("tx_order"),
            F.concat(blank, F.array_distinct(F.transform("all", lambda x: address(x["p"])))).alias("inputs"),
            F.array(address(F.col("o_custkey") + far), address(F.col("z.p") + 1)).alias("outputs"),
            F.col("o_totalprice").alias("amount"),
        )
    )


# --- vectors, handles, texts ------------------------------------------------------------


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vectors, each pulled towards the axis of its label so that labels cluster."""
    pulled = (
        "transform(embedding, (x, i) -> CAST(x AS DOUBLE) + CASE WHEN i = label THEN 1.4D "
        "ELSE 0D END)"
    )
    return table(spark, d, "embeddings").select(
        F.concat(F.lit("v"), F.lpad(text("vec_id"), 8, "0")).alias("vec_id"),
        F.col("vec_id").alias("n"),
        F.expr(pulled).alias("embedding"),
    )


def host_handles(spark: SparkSession, d: str) -> DataFrame:
    """Handles: the last label of a page's host before its domain."""
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return table(spark, d, "pages").select(
        F.concat(F.lit("s-"), text("page_id")).alias("actor_id"),
        F.regexp_extract(host, r"([a-z]+)\.example\.", 1).alias("handle"),
    )


def document_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each document with the next one."""
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("left_id"), (F.col("doc_id") + 1).alias("right_id")
    )


def document_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id"), F.col("text"))


def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation turn with the next turn of the same conversation."""
    t = table(spark, d, "conversations")
    a = t.select("conv_id", "turn", F.col("text").alias("text_a"))
    b = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("text_b"))
    return a.join(b, ["conv_id", "turn"]).select(
        F.concat_ws("-", text("conv_id"), text("turn")).alias("pair_id"), "text_a", "text_b"
    )


def activity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.concat(F.lit("u"), text("user_id")).alias("entity"), F.col("ts").cast("timestamp").alias("ts")
    )


def activity_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each active user with the user numbered one higher and the double."""
    users = table(spark, d, "events").select("user_id").distinct()
    one = users.select(F.col("user_id").alias("a"), (F.col("user_id") + 1).alias("b"))
    two = users.where("user_id > 1").select(
        F.col("user_id").alias("a"), (F.col("user_id") * 2).alias("b")
    )
    return one.unionByName(two).select(
        F.concat(F.lit("u"), text("a")).alias("a"), F.concat(F.lit("u"), text("b")).alias("b")
    )


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Customer and the parts they ordered, as an undirected pair list."""
    return (
        table(spark, d, "orders")
        .join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
        .select(
            F.concat(F.lit("A"), text("o_custkey")).alias("entity"),
            F.concat(F.lit("P"), text("l_partkey")).alias("neighbour"),
        )
        .distinct()
    )


def actor_edges(spark: SparkSession, d: str) -> DataFrame:
    """Undirected graph between actors from the links, no loops, no repeats."""
    e = link_ends(spark, d).where("subject_id <> object_id")
    return (
        e.select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"))
        .union(e.select("object_id", "subject_id"))
        .distinct()
    )


def link_list(spark: SparkSession, d: str) -> DataFrame:
    """Links with their observed, contradicting and abstained feature names."""
    names = F.array(*[F.lit(r[0]) for r in fixed.FEATURE_PRIORS])
    pick = lambda c: F.get(names, F.pmod(c, F.lit(11)).cast("int"))
    none = F.array().cast("array<string>")
    return table(spark, d, "orders").select(
        text("o_orderkey").alias("link_id"),
        F.array(
            pick(F.col("o_orderkey")),
            pick(F.floor(F.col("o_orderkey") / 11)),
            F.lit("no_such_feature"),
        ).alias("features"),
        F.when(F.pmod("o_orderkey", F.lit(10)) == 0, F.array(F.lit("pgp_key_conflict")))
        .otherwise(none)
        .alias("contradictions"),
        F.when(F.pmod("o_custkey", F.lit(3)) == 0, F.array(pick(F.col("o_custkey"))))
        .otherwise(none)
        .alias("abstained"),
    )


def eval_cases(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as cases; the score grows with the text's length."""
    from linkweave.functions import scoring

    cases = (
        table(spark, d, "labels")
        .join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
        .select(
            F.col("doc_id").alias("case_id"),
            F.col("quality").alias("truth"),
            ((F.col("n_chars") - 2000) / F.lit(500.0)).alias("final_llr"),
            (F.col("n_chars") < 600).alias("short_text"),
            (F.col("n_chars") < 300).alias("abstained"),
        )
        .withColumn("probability", scoring.posterior("final_llr"))
    )
    return cases.withColumn(
        "decision", scoring.decision("0", "final_llr", "probability")
    )


def ledger(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The entity tables a lookup reads."""
    return {
        "actors": actors(spark, d),
        "aliases": aliases(spark, d),
        "accounts": accounts(spark, d),
        "pgp_keys": pgp_keys(spark, d),
        "wallets": wallets(spark, d),
        "services": services(spark, d),
        "servers": servers(spark, d),
        "evidence": stored_evidence(spark, d),
        "cases": cases(spark, d),
    }


def withdrawn_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The evidence ledger after the retraction requests."""
    from linkweave.operators import ledger as ops

    updated, _, _ = ops.retract(
        stored_evidence(spark, d), retraction_requests(spark, d), hypothesis_evidence(spark, d)
    )
    return updated

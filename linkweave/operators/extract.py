"""Identifiers from texts, and page footprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave import fixed
from linkweave.functions import text, web


def extract_identifiers(
    texts: DataFrame, id_col: str = "text_id", body: str = "body"
) -> DataFrame:
    """One row per text, kind and distinct value, with its group and confidence.

    All kinds are found in the row that holds the text; nothing is shuffled.
    """
    found = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                F.lit(group).alias("dependence_group"),
                F.lit(confidence).alias("confidence"),
                text.identifiers(body, kind, pattern).alias("found"),
            )
            for kind, group, confidence, pattern in fixed.IDENTIFIER_PLAN
        ]
    )
    rows = texts.select(id_col, F.explode(found).alias("f"))
    return rows.select(
        id_col,
        "f.kind",
        F.explode("f.found").alias("value"),
        "f.dependence_group",
        "f.confidence",
        F.concat(F.lit("regex:"), F.lower("f.kind")).alias("extraction_method"),
    )


def extraction_summary(
    texts: DataFrame, id_col: str = "text_id", body: str = "body"
) -> DataFrame:
    """Per text the number of distinct values of each kind and the abstention flag.

    A text that names a private-coin address abstains from wallet conclusions.
    """
    counts = {k: F.size(text.identifiers(body, k, p)) for k, _, _, p in fixed.IDENTIFIER_PLAN}
    return texts.select(
        id_col,
        *[c.cast("long").alias(f"n_{k.lower()}") for k, c in counts.items()],
        (counts["XMR_ADDRESS"] > 0).alias("xmr_abstain"),
    )


def page_footprints(pages: DataFrame) -> DataFrame:
    """Leak tags of a page from its favicon hash, status markers, certificate, headers.

    Input: ``url, html, favicon_hash, headers map<string,string>, tls_pem``.
    """
    digest = web.certificate_digest("tls_pem")
    rows = pages.select(
        "*",
        web.status_exposed("html").alias("status_exposed"),
        web.header("headers", "server", "Unknown").alias("server_banner"),
        web.header("headers", "x-powered-by", "Unknown").alias("x_powered_by"),
        web.header("headers", "via", "").alias("via_proxy"),
        digest.alias("tls_sha256"),
        web.common_name("tls_pem").alias("tls_common_name"),
    )
    leaks = F.array_compact(
        F.array(
            F.when(
                F.coalesce("favicon_hash", F.lit(0)) != 0,
                F.concat(F.lit("FAVICON_MMH3_"), F.col("favicon_hash").cast("string")),
            ),
            F.when(F.col("status_exposed"), "SERVER_STATUS_PAGE_EXPOSED"),
            F.when(
                F.col("tls_sha256") != "",
                F.concat(F.lit("TLS_CERT_"), F.substring("tls_sha256", 1, 16)),
            ),
            F.when(
                F.col("server_banner") != "Unknown",
                F.concat(F.lit("SERVER_BANNER_"), "server_banner"),
            ),
        )
    )
    return rows.withColumn("leaks", leaks).withColumn("total_leaks", F.size("leaks"))

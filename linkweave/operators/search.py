"""Ranked text search over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.functions import text

K1, B = 1.2, 0.75


def _fuzz(term: str) -> int:
    """Edits a term may differ by: none up to two letters, one up to five, else two."""
    return 0 if len(term) < 3 else 1 if len(term) < 6 else 2


def scored_search(
    docs: DataFrame,
    terms: list[str],
    limit: int = 50,
    id_col: str = "doc_id",
    body: str = "text",
    source: str = "source",
) -> DataFrame:
    """Documents ranked by the terms: content counts three times the source name.

    A token matches a term within the edits its length allows. Tokens that match no term
    are dropped where the text is read, so only hits are shuffled. An exact digest as a
    term finds its document. The content score is the usual saturating one (BM25).
    """
    words = [t.strip().lower().replace("'", "") for t in terms if t.strip()]
    pairs = ", ".join(f"struct({i} AS term_no, '{w}' AS term, {_fuzz(w)} AS fuzz)"
                      for i, w in enumerate(words))
    close = [
        f"(length(tok) BETWEEN {len(w) - _fuzz(w)} AND {len(w) + _fuzz(w)} "
        f"AND levenshtein(tok, '{w}', {_fuzz(w)}) >= 0)"
        for w in words
    ]
    rows = docs.select(
        id_col, source, F.sha2(body, 256).alias("sha256"), text.tokens(body).alias("toks")
    ).withColumn("len", F.coalesce(F.size("toks"), F.lit(0)))
    shape = rows.agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"), F.lit(1).alias("_one")
    )
    hits = (
        rows.selectExpr(id_col, "len", "explode(toks) AS tok")
        .where(" OR ".join(close))
        .selectExpr(
            id_col,
            "len",
            f"explode(filter(array({pairs}), t -> levenshtein(tok, t.term, t.fuzz) >= 0)) AS t",
        )
        .groupBy(id_col, "len", F.col("t.term_no").alias("term_no"))
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    spread = hits.groupBy("term_no").agg(F.count(F.lit(1)).alias("df"))  # one row per term
    weight = (
        "ln(1D + (n_docs - df + 0.5D) / (df + 0.5D)) * tf * 2.2D "
        "/ (tf + 1.2D * (0.25D + 0.75D * len / avg_len))"
    )
    content = (
        hits.join(F.broadcast(spread), "term_no")
        .withColumn("_one", F.lit(1))
        .join(F.broadcast(shape), "_one")
        .groupBy(id_col)
        .agg(F.expr(f"sum({weight}) AS content_score"))
    )
    quoted = ", ".join(f"'{w}'" for w in words)
    named = rows.selectExpr(
        id_col,
        source,
        "sha256",
        f"coalesce(CAST(size(array_intersect({text.tokens_sql(source)}, array({quoted}))) AS DOUBLE), "
        "0D) AS source_score",
        f"CASE WHEN sha256 IN ({quoted}) THEN 1D ELSE 0D END AS digest_score",
    )
    return (
        named.join(content, id_col, "left")
        .selectExpr(
            id_col,
            "sha256",
            # rounded, so that equal texts tie whatever order their terms were added in
            "round(3D * coalesce(content_score, 0D) + source_score + digest_score, 9) AS score",
        )
        .where("score > 0")
        .orderBy(F.desc("score"), id_col)
        .limit(limit)
        .join(docs.selectExpr(id_col, f"substr({body}, 1, 150) AS snippet"), id_col)
    )

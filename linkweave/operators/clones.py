"""Near copies by 64-bit similarity fingerprints."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.functions import text

BITS = 64


def fingerprints(docs: DataFrame, id_col: str = "doc_id", body: str = "text") -> DataFrame:
    """Fingerprint per text: every token votes on each bit with its digest's bit.

    A text's tokens are counted by the task that reads it, so one row per text is
    shuffled. Texts without tokens get 0.
    """
    toks = docs.select(id_col, F.explode(text.tokens(body)).alias("tok")).select(
        id_col, F.expr("CAST(conv(substr(md5(tok), 1, 16), 16, -10) AS BIGINT) AS h")
    )
    votes = toks.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.expr(f"sum(shiftrightunsigned(h, {i}) & 1L) AS b{i}") for i in range(BITS)],
    )
    bits = " | ".join(
        f"(CASE WHEN 2 * b{i} > n THEN shiftleft(1L, {i}) ELSE 0L END)" for i in range(BITS)
    )
    found = votes.selectExpr(id_col, f"{bits} AS simhash")
    return docs.select(id_col).join(found, id_col, "left").select(
        id_col, F.coalesce("simhash", F.lit(0).cast("long")).alias("simhash")
    )


def similarity_sql(a: str, b: str) -> str:
    return f"round(1D - bit_count({a} ^ {b}) / {float(BITS)}D, 4)"


def compare_pairs(pairs: DataFrame, prints: DataFrame, key: str = "doc_id",
                  threshold: float = 0.95) -> DataFrame:
    """Similarity and clone flag of given pairs (``left_id, right_id``)."""
    a = prints.select(F.col(key).alias("left_id"), F.col("simhash").alias("simhash_a"))
    b = prints.select(F.col(key).alias("right_id"), F.col("simhash").alias("simhash_b"))
    return (
        pairs.join(a, "left_id")
        .join(b, "right_id")
        .selectExpr(
            "left_id", "right_id", f"{similarity_sql('simhash_a', 'simhash_b')} AS similarity"
        )
        .withColumn("is_clone", F.col("similarity") >= threshold)
    )


def distinct_prints(prints: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each fingerprint once, with its first text and the number of texts that share it."""
    return prints.groupBy("simhash").agg(
        F.min(key).alias("first_id"), F.count(F.lit(1)).alias("copies")
    )


def clone_pairs(prints: DataFrame, max_distance: int = 3, blocks: int = 6,
                key: str = "doc_id") -> DataFrame:
    """All pairs of distinct fingerprints at most ``max_distance`` bits apart.

    Exact copies are one fingerprint with a count, so a group of copies, however large,
    makes no pairs. With ``blocks`` bit blocks and d differing bits, some choice of
    ``blocks - d`` blocks agrees fully; fingerprints are joined on those. A pair is kept
    only under the first choice it agrees on, so no second pass removes repeats.
    """
    keep = blocks - max_distance
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), keep):
        mask = 0
        for c in chosen:
            mask |= ((1 << (edges[c + 1] - edges[c])) - 1) << edges[c]
        masks.append(mask - (1 << 64) if mask >= (1 << 63) else mask)
    table = ", ".join(f"struct({i} AS k, simhash & {m}L AS band)" for i, m in enumerate(masks))
    banded = distinct_prints(prints, key).selectExpr(
        "simhash", "first_id", "copies", f"explode(array({table})) AS e"
    ).selectExpr("simhash", "first_id", "copies", "e.k", "e.band")
    a, b = banded.alias("a"), banded.alias("b")
    agree = " ".join(
        f"WHEN (a.simhash ^ b.simhash) & {m}L = 0 THEN {i}" for i, m in enumerate(masks)
    )
    return (
        a.join(
            b,
            F.expr(
                "a.k = b.k AND a.band = b.band AND a.simhash < b.simhash "
                f"AND bit_count(a.simhash ^ b.simhash) <= {max_distance}"
            ),
        )
        .where(F.expr(f"a.k = CASE {agree} END"))
        .selectExpr(
            "a.simhash AS simhash_a",
            "b.simhash AS simhash_b",
            "a.first_id AS first_a",
            "b.first_id AS first_b",
            "a.copies AS copies_a",
            "b.copies AS copies_b",
            "bit_count(a.simhash ^ b.simhash) AS distance",
            f"{similarity_sql('a.simhash', 'b.simhash')} AS similarity",
        )
    )

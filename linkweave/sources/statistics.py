"""Background corpus statistics as one JSON document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave import fixed
from linkweave.operators.style import N_WORDS, vocabulary


def save(statistics: DataFrame, path: str) -> None:
    """Write means and deviations in word order, six decimals (174 rows become one)."""
    pick = lambda c: F.expr(
        f"transform(array_sort(collect_list(struct(pos, round({c}, 6) AS v))), x -> x.v)"
    )
    statistics.agg(
        F.max("num_documents").alias("num_documents"),
        F.count(F.lit(1)).alias("vocab_size"),
        pick("mean").alias("means"),
        pick("std_dev").alias("std_devs"),
    ).write.json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """``pos, word, mean, std_dev, num_documents`` for all function words.

    Vectors of another length are padded or cut to the vocabulary, and their zeros take
    the fill values. Deviations are never zero.
    """
    doc = spark.read.schema(
        "num_documents long, means array<double>, std_devs array<double>"
    ).option("multiLine", True).json(path)
    rows = doc.select(
        "num_documents",
        (F.size("means") != N_WORDS).alias("_fill_m"),
        (F.size("std_devs") != N_WORDS).alias("_fill_s"),
        "means",
        "std_devs",
        F.lit(1).alias("_one"),
    )
    at = lambda c: F.coalesce(F.get(F.col(c), F.col("pos")), F.lit(0.0))
    filled = (
        vocabulary(spark)
        .withColumn("_one", F.lit(1))
        .join(F.broadcast(rows), "_one")
        .select("pos", "word", "num_documents", "_fill_m", "_fill_s", at("means").alias("m"),
                at("std_devs").alias("s"))
    )
    return filled.selectExpr(
        "pos",
        "word",
        f"CASE WHEN _fill_m AND m = 0 THEN {fixed.STATS_MEAN_FILL}D ELSE m END AS mean",
        f"CASE WHEN _fill_s AND s = 0 THEN {fixed.STATS_STD_FILL}D "
        f"WHEN s = 0 THEN {fixed.STATS_STD_FLOOR}D ELSE s END AS std_dev",
        "coalesce(num_documents, 500L) AS num_documents",
    )

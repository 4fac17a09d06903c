"""A stored inverted index for the ranked search, and the search on it.

``build`` writes three tables once. Postings (field, term, document, count, length), dealt
into ``BUCKETS`` by the term's hash: content words, words of the source name, the digest.
Variants: every content term under each text that is left after deleting up to as many
letters as a search may differ by; two words within k edits share a variant after at most
k deletions each, so a search looks up the variants of its own words and verifies the
terms found. Terms longer than ``LONGEST`` have no variants: they lie by length and are
compared only with search words that are as long. Facts: the number and mean length of
documents, one row.

A search reads the buckets of its own variants and terms; texts are read for the snippets of
the documents it returns.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.functions import text
from linkweave.operators.search import _fuzz
from linkweave.session import cut_lineage

BUCKETS = 64
LONGEST = 32
#: Parts of a bucket when it is written, so that a frequent term is not one task's.
PARTS = 8


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])))
def term_counts(tokens: pd.Series) -> pd.Series:
    """Each different token of a text with how often it occurs."""
    found = [[] if t is None else [{"term": w, "tf": n} for w, n in Counter(t).items()] for t in tokens]
    return pd.Series(found, dtype=object)


def build(docs: DataFrame, root: str, id_col: str = "doc_id", body: str = "text", source: str = "source") -> None:
    """Writes the index of ``docs`` under ``root``.

    Words are counted inside the row, so postings travel once, to the bucket they are written
    to. Texts that share an id have postings of their own, which a search adds up.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        text.tokens(body).alias("toks"),
        F.array_distinct(text.tokens(source)).alias("named"),
        F.sha2(body, 256).alias("sha256"),
    ).withColumn("len", F.greatest(F.size("toks"), F.lit(0)))
    words = rows.select("doc_id", "len", F.explode(term_counts("toks")).alias("t")).select(
        F.lit("content").alias("field"), "t.term", "doc_id", "t.tf", "len"
    )
    one = F.lit(1).cast("long")
    named = rows.select(F.lit("source").alias("field"), F.explode("named").alias("term"), "doc_id", one.alias("tf"), "len")
    digests = rows.where("sha256 IS NOT NULL").select(
        F.lit("digest").alias("field"), F.col("sha256").alias("term"), "doc_id", one.alias("tf"), "len"
    )
    (
        words.unionByName(named).unionByName(digests)
        .withColumn("bucket", bucket(F.col("term")))
        .repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
        .sortWithinPartitions("bucket", "field", "term")  # equal terms are written once
        .write.partitionBy("bucket").parquet(f"{root}/postings")
    )
    rows.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len")).write.parquet(f"{root}/facts")

    terms = docs.sparkSession.read.parquet(f"{root}/postings").where("field = 'content'").select("term").distinct()
    n = F.length("term")
    cut = "concat(substr({0}, 1, i - 1), substr({0}, i + 1))"
    once = f"transform(sequence(1, length(term)), i -> {cut.format('term')})"
    again = (
        f"flatten(transform(once, x -> CASE WHEN length(x) = 0 THEN CAST(array() AS array<string>) "
        f"ELSE transform(sequence(1, length(x)), i -> {cut.format('x')}) END))"
    )
    short = (
        terms.where((n > 0) & (n <= LONGEST))
        .withColumn("once", F.expr(once))
        .select("term", F.explode(F.array_distinct(F.concat(F.array("term"), "once", F.expr(again)))).alias("variant"))
    )
    long = terms.where(n > LONGEST).select("term", F.concat(F.lit("#"), n.cast("string")).alias("variant"))
    (
        short.unionByName(long).withColumn("bucket", bucket(F.col("variant")))
        .repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/variants")
    )


def variants_of(word: str) -> list[str]:
    """Where a search word looks: itself with letters deleted, and long terms by length."""
    edits = _fuzz(word)
    found = {word}
    if len(word) <= LONGEST + 2:
        for k in range(1, min(edits, len(word)) + 1):
            for gone in combinations(range(len(word)), k):
                found.add("".join(c for i, c in enumerate(word) if i not in gone))
    return sorted(found) + [f"#{n}" for n in range(max(LONGEST + 1, len(word) - edits), len(word) + edits + 1)]


def _in_buckets(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """The part of a table that lies in the buckets of ``terms`` (a ``term`` column)."""
    numbers = [r[0] for r in terms.select(bucket(F.col("term"))).distinct().collect()]  # at most BUCKETS
    return spark.read.parquet(path).where(F.col("bucket").isin(numbers) if numbers else F.lit(False))


def search(
    docs: DataFrame, root: str, words: list[str], limit: int = 50, id_col: str = "doc_id", body: str = "text"
) -> DataFrame:
    """The ranking of ``search.scored_search`` from the stored index: ``doc_id, score, snippet``."""
    spark = docs.sparkSession
    asked = [t.strip().lower().replace("'", "") for t in words if t.strip()]
    looked = [(v, i, w, _fuzz(w)) for i, w in enumerate(asked) for v in variants_of(w)]
    shape = "variant string, term_no int, word string, fuzz int"
    probes = spark.createDataFrame(looked, shape)
    near = cut_lineage(
        _in_buckets(spark, f"{root}/variants", probes.select(F.col("variant").alias("term")))
        .join(F.broadcast(probes), "variant")  # rows follow from the search words alone
        .where("levenshtein(term, word, fuzz) >= 0")
        .select("term", "term_no")
        .distinct()
    )
    content = _in_buckets(spark, f"{root}/postings", near).where("field = 'content'")
    hits = (
        content.join(near, "term").groupBy("doc_id", "len", "term_no").agg(F.sum("tf").alias("tf"))
    )
    df = hits.groupBy("term_no").agg(F.count(F.lit(1)).alias("df"))  # a row per search word
    weight = (
        "ln(1D + (n_docs - df + 0.5D) / (df + 0.5D)) * tf * 2.2D "
        "/ (tf + 1.2D * (0.25D + 0.75D * len / avg_len))"
    )
    facts = spark.read.parquet(f"{root}/facts").first()
    scored = (
        hits.join(F.broadcast(df), "term_no")
        .withColumn("n_docs", F.lit(facts["n_docs"]))
        .withColumn("avg_len", F.lit(facts["avg_len"]).cast("double"))
        .groupBy("doc_id")
        .agg(F.expr(f"3D * sum({weight})").alias("score"))
    )
    exact = spark.createDataFrame([(w,) for w in dict.fromkeys(asked)], "term string")
    other = (
        _in_buckets(spark, f"{root}/postings", exact)
        .where("field IN ('source', 'digest')")
        .join(F.broadcast(exact), "term")
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).cast("double").alias("score"))
    )
    best = (
        scored.unionByName(other)
        .groupBy("doc_id")
        .agg(F.round(F.sum("score"), 9).alias("score"))
        .orderBy(F.desc("score"), "doc_id")
        .limit(limit)
    )
    snippets = docs.select(F.col(id_col).alias("doc_id"), F.substring(body, 1, 150).alias("snippet"))
    return snippets.join(F.broadcast(best), "doc_id").select("doc_id", "score", "snippet")  # limit rows

"""Writing style: features, background statistics, episodes, pair verdicts."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave import fixed
from linkweave.functions import scoring, text, vectors

_LIVE_WORDS = [w for w in fixed.FUNCTION_WORDS if "'" not in w]
N_WORDS = len(fixed.FUNCTION_WORDS)


def _word_list() -> str:
    quoted = ", ".join('"' + w + '"' for w in fixed.FUNCTION_WORDS)
    return f"array({quoted})"


def vocabulary(spark) -> DataFrame:
    """The function words with their positions."""
    return spark.range(1).selectExpr(f"posexplode({_word_list()}) AS (pos, word)")


def word_counts(docs: DataFrame, key: list[str], body: str = "text") -> DataFrame:
    """Per key: number of words and the counts of the function words found.

    Counts add up over the texts of a key, so an author's texts need not be joined into
    one string. A word with an apostrophe is never one token and never counts.
    """
    hits = ", ".join(f"'{w}'" for w in _LIVE_WORDS)
    # a row without a word carries the text's own length, so one pass yields both
    tallies = (
        f"concat(array(struct(CAST(NULL AS STRING) AS word, CAST(size(toks) AS LONG) AS n)), "
        f"transform(filter(toks, t -> t IN ({hits})), t -> struct(t AS word, 1L AS n)))"
    )
    found = (
        docs.select(*key, text.tokens(body).alias("toks"))
        .selectExpr(*key, f"explode({tallies}) AS e")
        .selectExpr(*key, "e.word", "e.n")
        .groupBy(*key, "word")
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    )
    return found.groupBy(*key).agg(
        F.expr("max(CASE WHEN word IS NULL THEN n END) AS word_count"),
        F.expr("max(CASE WHEN word IS NULL THEN k END) AS n_texts"),
        # at most one entry per function word
        F.expr(
            "map_from_entries(collect_list(CASE WHEN word IS NOT NULL THEN struct(word, n) END)) "
            "AS counts"
        ),
    )


def style_vectors(docs: DataFrame, key: list[str], body: str = "text") -> DataFrame:
    """Word count, abstention flag and the 174 function-word shares of each key."""
    share = (
        f"transform({_word_list()}, w -> CASE WHEN word_count = 0 OR counts IS NULL THEN 0D "
        "ELSE coalesce(element_at(counts, w), 0L) / word_count END)"
    )
    return word_counts(docs, key, body).select(
        *key,
        "n_texts",
        "word_count",
        (F.col("word_count") < fixed.MIN_EPISODE_WORDS).alias("abstain"),
        F.expr(share).alias("vector"),
    )


def function_word_shares(docs: DataFrame, key: list[str], body: str = "text") -> DataFrame:
    """Long form: one row per key and function word found in it."""
    counted = word_counts(docs, key, body)
    return counted.select(*key, "word_count", F.explode("counts").alias("word", "n")).select(
        *key, "word", (F.col("n") / F.col("word_count")).alias("share")
    )


def features(docs: DataFrame, id_col: str = "doc_id", body: str = "text") -> DataFrame:
    """Row features of a text: words, punctuation shares, sentence lengths."""
    rows = docs.select(
        id_col,
        F.expr(f"size({text.tokens_sql(body)})").alias("word_count"),
        text.punctuation_map(body).alias("punctuation"),
        F.expr(text.sentence_lengths_sql(body)).alias("lengths"),
    )
    rows = rows.withColumn("avg_sentence_len", F.expr(text.mean_sql("lengths")))
    return rows.select(
        id_col,
        "word_count",
        "punctuation",
        "avg_sentence_len",
        F.expr(text.deviation_sql("lengths", "avg_sentence_len")).alias("std_sentence_len"),
    )


def char_ngram_shares(
    docs: DataFrame, id_col: str = "doc_id", body: str = "text", low: int = 3, high: int = 5
) -> DataFrame:
    """Share of every character n-gram in its text.

    All n-grams of a text are counted by the task that reads it; only distinct
    (text, n-gram) pairs are shuffled.
    """
    length = f"length({text.collapsed_sql(body)})"
    total = " + ".join(f"greatest({length} - {n - 1}, 0)" for n in range(low, high + 1))
    # the total is fixed before the rows multiply
    grams = docs.select(id_col, body, F.expr(total).alias("total")).select(
        id_col, "total", F.explode(text.char_ngrams(body, low, high)).alias("gram")
    )
    return (
        grams.groupBy(id_col, "gram")
        .agg(F.count(F.lit(1)).alias("n"), F.max("total").alias("total"))
        .select(id_col, "gram", "n", (F.col("n") / F.col("total")).alias("share"))
    )


NGRAM_FIGURES = ["distinct_ngrams", "total_ngrams", "top_ngram_count"]


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in NGRAM_FIGURES]))
def ngram_figures(texts: pd.Series) -> pd.DataFrame:
    """Different character n-grams of length three to five, all of them, and the count of the top one.

    Grams of a text are numbers: three code points of 21 bits, then the place of the shorter
    gram among its text's and one code point more.
    """
    out = np.zeros((len(texts), 3), np.int64)
    for row, t in enumerate(texts):
        c = np.frombuffer((t or "").encode("utf-32-le"), np.uint32).astype(np.int64)
        grams = c[:-2] << 42 | c[1:-1] << 21 | c[2:]
        for n in (3, 4, 5):
            if n > 3:
                grams = place[:-1] << 21 | c[n - 1 :]  # noqa: F821
            if not len(grams):
                break
            kinds, place, times = np.unique(grams, return_inverse=True, return_counts=True)
            out[row] += len(kinds), len(grams), 0
            out[row, 2] = max(out[row, 2], times.max())
    return pd.DataFrame(out, columns=NGRAM_FIGURES)


def repeats(rows: DataFrame, key: str) -> bool:
    """Whether two rows share a key."""
    return not rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def bundle(docs: DataFrame, id_col: str = "doc_id", body: str = "text") -> DataFrame:
    """Everything about a text's style in one row, n-grams summed up.

    The texts are dealt by id once: all groupings and joins below are by id and need no
    further exchange. N-grams, several times the size of their text, are counted inside its
    row; only texts that share an id have theirs exploded and counted together.
    """
    together = repeats(docs, id_col)
    docs = docs.select(id_col, body).repartition(id_col)
    grams = _ngrams_by_id(docs, id_col, body) if together else docs.select(
        id_col, ngram_figures(F.expr(text.collapsed_sql(body))).alias("f")
    ).select(id_col, "f.*")
    zero = F.lit(0).cast("long")
    return (
        features(docs, id_col, body)
        .join(style_vectors(docs, [id_col], body).select(id_col, "vector"), id_col)
        .join(grams, id_col, "left")
        .withColumn("distinct_ngrams", F.coalesce("distinct_ngrams", zero))
        .withColumn("total_ngrams", F.coalesce("total_ngrams", zero))
        .withColumn("top_ngram_count", F.coalesce("top_ngram_count", zero))
    )


def _ngrams_by_id(docs: DataFrame, id_col: str, body: str) -> DataFrame:
    return (
        char_ngram_shares(docs, id_col, body)
        .groupBy(id_col)
        .agg(
            F.count(F.lit(1)).alias("distinct_ngrams"),
            F.sum("n").alias("total_ngrams"),
            F.max("n").alias("top_ngram_count"),
        )
    )

# --- background statistics --------------------------------------------------------------


def corpus_statistics(docs: DataFrame, id_col: str = "doc_id", body: str = "text") -> DataFrame:
    """Mean and population deviation of each function word's share over all texts.

    Texts without the word count as zero: they enter through their number, so no zero
    rows are made. A deviation of zero becomes a small floor.
    """
    spark = docs.sparkSession
    found = function_word_shares(docs, [id_col], body).groupBy("word").agg(
        F.count(F.lit(1)).alias("k"), F.avg("share").alias("m"), F.var_pop("share").alias("v")
    )
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("_one"))
    mean = "coalesce(k * m / n, 0D)"
    spread = (
        f"sqrt(coalesce((k * (v + (m - {mean}) * (m - {mean})) + (n - k) * {mean} * {mean}) / n,"
        " 0D))"
    )
    return (
        vocabulary(spark)
        .join(found, "word", "left")
        .withColumn("_one", F.lit(1))
        .join(total, "_one")
        .selectExpr(
            "pos",
            "word",
            "n AS num_documents",
            f"{mean} AS mean",
            f"CASE WHEN {spread} = 0 THEN {fixed.STATS_STD_FLOOR}D ELSE {spread} END AS std_dev",
        )
    )


def deviation_vector(statistics: DataFrame) -> DataFrame:
    """The deviations as one array in word order (174 rows in, one row out)."""
    return statistics.agg(
        F.expr(
            "transform(array_sort(collect_list(struct(pos, std_dev))), x -> x.std_dev)"
        ).alias("std_devs")
    )


# --- pairs of long texts ------------------------------------------------------------------


def delta_sql(a: str, b: str, std: str) -> str:
    """Mean difference of shares in units of the background deviation.

    Without usable deviations the plain differences count; unequal lengths give 2.
    """
    plain = f"aggregate(zip_with({a}, {b}, (x, y) -> abs(x - y)), 0D, (s, v) -> s + v)"
    gaps = f"zip_with({a}, {b}, (x, y) -> abs(x - y))"
    scaled = f"aggregate(zip_with({gaps}, {std}, (g, d) -> g / d), 0D, (s, v) -> s + v)"
    usable = f"{std} IS NOT NULL AND NOT exists({std}, d -> d = 0)"
    return (
        f"CASE WHEN size({a}) <> size({b}) THEN 2D "
        f"WHEN {usable} THEN {scaled} / size({a}) ELSE {plain} / size({a}) END"
    )


def verify_pairs(
    pairs: DataFrame, styles: DataFrame, statistics: DataFrame, key: str = "doc_id"
) -> DataFrame:
    """Style evidence for pairs of texts (``left_id, right_id``).

    Short texts abstain and are not compared; the rest get a distance, a cosine and the
    matching likelihoods.
    """
    one = deviation_vector(statistics).withColumn("_one", F.lit(1))
    side = lambda p: styles.select(
        F.col(key).alias(f"{p}_id"),
        F.col("word_count").alias(f"{p}_words"),
        F.col("abstain").alias(f"{p}_abstain"),
        F.col("vector").alias(f"{p}_vector"),
    )
    rows = (
        pairs.join(side("left"), "left_id")
        .join(side("right"), "right_id")
        .withColumn("_one", F.lit(1))
        .join(F.broadcast(one), "_one")
        .withColumn("abstain", F.col("left_abstain") | F.col("right_abstain"))
        .withColumn(
            "cosine",
            F.expr(
                "CASE WHEN NOT abstain THEN "
                f"{vectors.cosine_sql('left_vector', 'right_vector')} END"
            ),
        )
        .withColumn(
            "delta",
            F.expr(
                "CASE WHEN NOT abstain THEN "
                f"{delta_sql('left_vector', 'right_vector', 'std_devs')} END"
            ),
        )
    )
    near, mid = "cosine > 0.85 OR delta < 0.75", "cosine > 0.65 OR delta < 0.95"
    return rows.selectExpr(
        "left_id",
        "right_id",
        "'stylometry_burrows_delta' AS feature_name",
        "'STYLOMETRY' AS family",
        "'author_stylometry' AS dependence_group",
        "left_words",
        "right_words",
        "abstain",
        "cosine",
        "delta",
        f"CASE WHEN abstain THEN 0.82D WHEN {near} THEN 0.85D WHEN {mid} THEN 0.70D "
        "ELSE 0.20D END AS m_i",
        f"CASE WHEN abstain THEN 0.01D WHEN {near} THEN 0.02D WHEN {mid} THEN 0.05D "
        "ELSE 0.50D END AS u_i",
        "CASE WHEN abstain THEN 0D END AS llr",
    )


# --- pairs of short texts -----------------------------------------------------------------


def pair_features(pairs: DataFrame, prepared: str, features_of: str) -> DataFrame:
    """``pair_id, feature, a, b``: how often each side of a pair shows a feature.

    ``prepared`` is SQL over the column ``text``; ``features_of`` is SQL giving the
    feature array of the resulting column ``prep``. Both texts sit in the pair's row, so
    one task counts all of a pair's features before anything is shuffled.
    """
    sides = pairs.selectExpr(
        "pair_id",
        "explode(array(struct(text_a AS text, 1L AS a, 0L AS b), "
        "struct(text_b AS text, 0L AS a, 1L AS b))) AS s",
    ).selectExpr("pair_id", "s.text", "s.a", "s.b")
    return (
        sides.selectExpr("pair_id", "a", "b", f"{prepared} AS prep")
        .selectExpr("pair_id", "a", "b", f"explode({features_of}) AS feature")
        .groupBy("pair_id", "feature")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    )


SHORT_TEXT_TOKENS = text.ascii_tokens_sql("text")
# words, word pairs and character triples of the tokens, each with its kind
SHORT_TEXT_FEATURES = (
    "concat(transform(prep, t -> concat('w_', t)), "
    "zip_with(slice(prep, 1, greatest(size(prep) - 1, 0)), "
    "slice(prep, 2, greatest(size(prep) - 1, 0)), (x, y) -> concat('bg_', x, '_', y)), "
    f"transform({text.char_ngrams_sql('array_join(prep, chr(32))', 3)}, t -> concat('c3_', t)))"
)


def _cosine_by_pair(feats: DataFrame, weight: str) -> DataFrame:
    return feats.selectExpr("pair_id", f"a * {weight} AS wa", f"b * {weight} AS wb").groupBy(
        "pair_id"
    ).agg(
        F.expr("sum(wa * wb) AS dot"),
        F.expr("sqrt(sum(wa * wa)) AS norm_a"),
        F.expr("sqrt(sum(wb * wb)) AS norm_b"),
    )


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("dot", "norm_a", "norm_b")]))
def short_text_sums(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The sums behind the cosine of two token lists, given as tokens with a space between."""

    def counts(t):
        words = t.split(" ") if t else []
        whole = Counter("w_" + w for w in words)
        whole.update(map("bg_{}_{}".format, words, words[1:]))
        return whole, Counter(t[i : i + 3] for i in range(len(t) - 2))

    def product(x, y):
        if len(x) > len(y):
            x, y = y, x
        return sum(n * y[f] for f, n in x.items() if f in y)

    out = []
    for x, y in zip(a, b, strict=True):
        (wa, ca), (wb, cb) = counts(x), counts(y)
        out.append([product(p, q) + product(r, s) / 4 for p, q, r, s in (
            (wa, wb, ca, cb), (wa, wa, ca, ca), (wb, wb, cb, cb))])
    sums = np.array(out, np.float64).reshape(-1, 3)
    return pd.DataFrame({"dot": sums[:, 0], "norm_a": np.sqrt(sums[:, 1]), "norm_b": np.sqrt(sums[:, 2])})


def verify_short_pairs(
    pairs: DataFrame, threshold: float = fixed.SHORT_TEXT_MATCH_FROM
) -> DataFrame:
    """Authorship verdict for pairs of short texts (``pair_id, text_a, text_b``).

    Pairs with too few tokens abstain before any features are built. Features, many times the
    size of the texts, are counted inside the pair's row; only pairs that share an id have
    theirs exploded and counted together.
    """
    together = repeats(pairs, "pair_id")
    pairs = pairs.select("pair_id", "text_a", "text_b")
    sized = (pairs.repartition("pair_id") if together else pairs).selectExpr(
        "*",
        f"size({text.ascii_tokens_sql('text_a')}) AS tokens_a",
        f"size({text.ascii_tokens_sql('text_b')}) AS tokens_b",
    )
    enough = (
        f"tokens_a >= {fixed.MIN_SHORT_TEXT_TOKENS} AND tokens_b >= {fixed.MIN_SHORT_TEXT_TOKENS}"
    )
    if together:
        feats = pair_features(sized.where(enough), SHORT_TEXT_TOKENS, SHORT_TEXT_FEATURES)
        cosines = _cosine_by_pair(feats, "CASE WHEN feature LIKE 'c3\\\\_%' THEN 0.5D ELSE 1D END")
        rows = sized.select("pair_id", "tokens_a", "tokens_b").join(cosines, "pair_id", "left")
    else:
        sides = [
            F.expr(f"CASE WHEN {enough} THEN array_join({text.ascii_tokens_sql(c)}, ' ') ELSE '' END")
            for c in ("text_a", "text_b")
        ]
        rows = sized.withColumn("sums", short_text_sums(*sides)).select(
            "pair_id", "tokens_a", "tokens_b", "sums.*"
        )
    return (
        rows.selectExpr(
            "pair_id",
            "tokens_a",
            "tokens_b",
            f"{enough} AS enough",
            "CASE WHEN norm_a * norm_b > 0 THEN least(1D, greatest(0D, dot / (norm_a * norm_b))) "
            "ELSE 0D END AS similarity",
        )
        .selectExpr(
            "pair_id",
            "tokens_a",
            "tokens_b",
            "similarity",
            f"CASE WHEN NOT enough OR similarity < {fixed.SHORT_TEXT_ABSTAIN_BELOW} THEN 'ABSTAIN' "
            f"WHEN similarity >= {threshold} THEN 'MATCH' ELSE 'NO_MATCH' END AS verdict",
            "CASE WHEN NOT enough THEN 'INSUFFICIENT_TOKEN_COUNT' "
            f"WHEN similarity < {fixed.SHORT_TEXT_ABSTAIN_BELOW} THEN 'LOW_SIMILARITY_CONFIDENCE' "
            "ELSE 'HIGH_CONFIDENCE_EVALUATION' END AS reason",
        )
        .withColumn("_score", scoring.short_text_score("similarity"))
        .selectExpr(
            "pair_id",
            "tokens_a",
            "tokens_b",
            "verdict",
            "reason",
            "round(similarity, 4) AS similarity",
            "CASE WHEN verdict = 'ABSTAIN' THEN 0D ELSE _score END AS llr_score",
        )
    )


def hashed_ngram_pairs(pairs: DataFrame, buckets: int = 10000) -> DataFrame:
    """Style evidence for short texts from hashed character n-grams.

    The n-grams of length three to five fall into ``buckets`` by their digest; the cosine
    of the bucket counts picks the likelihoods. Empty texts abstain.
    """
    clean = f"trim({text.collapsed_sql('text')})"
    grams = ", ".join(text.char_ngrams_sql("prep", n) for n in (3, 4, 5))
    bucket = (
        "transform(concat({g}), g -> CAST(conv(substr(md5(g), 1, 8), 16, 10) AS BIGINT) "
        "% {m} + 1)"
    ).format(g=grams, m=buckets - 1)
    cosines = _cosine_by_pair(pair_features(pairs, clean, bucket), "1D")
    return (
        pairs.selectExpr(
            "pair_id", "trim(text_a) = '' OR trim(text_b) = '' AS abstain"
        )
        .join(cosines, "pair_id", "left")
        .selectExpr(
            "pair_id",
            "abstain",
            "CASE WHEN norm_a * norm_b > 0 THEN dot / (norm_a * norm_b) ELSE 0D END AS cosine",
        )
        .selectExpr(
            "pair_id",
            "'stylometry_neural_embedding' AS feature_name",
            "'author_stylometry_neural' AS dependence_group",
            "abstain",
            "round(cosine, 4) AS cosine",
            "CASE WHEN abstain THEN 0.80D WHEN cosine > 0.85 THEN 0.85D "
            "WHEN cosine > 0.65 THEN 0.70D ELSE 0.30D END AS m_i",
            "CASE WHEN abstain THEN 0.05D WHEN cosine > 0.85 THEN 0.01D "
            "WHEN cosine > 0.65 THEN 0.05D ELSE 0.40D END AS u_i",
        )
    )


def top_word_distance(pairs: DataFrame, top: int = 50) -> DataFrame:
    """Mean frequency difference over the pair's most frequent words, and its probability.

    Ties among words are broken by the word; a side without words gives 2.
    """
    sized = pairs.selectExpr(
        "*",
        f"size({text.tokens_sql('text_a')}) AS na",
        f"size({text.tokens_sql('text_b')}) AS nb",
    )
    feats = pair_features(sized.where("na > 0 AND nb > 0"), text.tokens_sql("text"), "prep")
    rates = feats.join(sized.select("pair_id", "na", "nb"), "pair_id").selectExpr(
        "pair_id", "feature", "a / na AS fa", "b / nb AS fb",
        # whole-number rank key: equal sums stay equal
        "CAST(a AS DECIMAL(19,0)) * nb + CAST(b AS DECIMAL(19,0)) * na AS weight",
    )
    ranked = rates.withColumn(
        "rn",
        F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("weight"), "feature")),
    ).where(F.col("rn") <= top)
    distance = ranked.groupBy("pair_id").agg(
        F.round(F.sum(F.abs(F.col("fa") - F.col("fb"))) / F.count(F.lit(1)), 4).alias("d")
    )
    return (
        sized.select("pair_id")
        .join(distance, "pair_id", "left")
        .selectExpr("pair_id", "coalesce(d, 2D) AS distance")
        .withColumn("probability", scoring.distance_probability("distance"))
    )

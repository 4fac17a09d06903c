"""Texts: tokens, style, extraction, near copies, ingest, footprints, search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from linkweave import fixed
from linkweave.functions import text, web
from linkweave.operators import clones, extract, observations, search, style, textindex
from linkweave.plans import derive as D
from linkweave.plans.catalog.registration import registrar, rounded
from linkweave.plans.oracle import CTES, with_ctes
from linkweave.session import shared_folder

ENTRIES: dict = {}
entry = registrar(ENTRIES)

_TOK = r"regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_]+')"


def toks(t: str) -> str:
    return _TOK.format(t=t)


def atoks(t: str) -> str:
    return f"list_filter({toks(t)}, lambda w: regexp_full_match(w, '[a-z0-9_]+'))"


# --- tokens and row features ---------------------------------------------------------------


@entry(
    "word_tokens",
    with_ctes("tokens", "SELECT doc_id, token, count(*) AS n FROM tokens GROUP BY ALL"),
)
def word_tokens(spark, d):
    docs = D.document_texts(spark, d)
    return docs.select("doc_id", F.explode(text.tokens("text")).alias("token")).groupBy(
        "doc_id", "token"
    ).agg(F.count(F.lit(1)).alias("n"))


@entry(
    "ascii_word_tokens",
    f"""SELECT conv_id, turn, len({atoks('text')}) AS n_tokens,
          array_to_string({atoks('text')}, ' ') AS tokens FROM conversations""",
)
def ascii_word_tokens(spark, d):
    t = D.table(spark, d, "conversations")
    return t.select(
        "conv_id", "turn", F.size(text.ascii_tokens("text")).cast("long").alias("n_tokens"),
        F.array_join(text.ascii_tokens("text"), " ").alias("tokens"),
    )


@entry(
    "char_ngram_shares",
    """SELECT gram, count(*) AS n_docs, sum(n) AS n, round(sum(share), 6) AS share_sum FROM (
         SELECT id, gram, count(*) AS n, count(*) / any_value(total) AS share FROM (
           SELECT id, total, unnest(grams) AS gram FROM (SELECT id, list_concat(
             [c[i:i + 2] FOR i IN range(1, length(c) - 1)],
             list_concat([c[i:i + 3] FOR i IN range(1, length(c) - 2)],
               [c[i:i + 4] FOR i IN range(1, length(c) - 3)])) AS grams,
             greatest(length(c) - 2, 0) + greatest(length(c) - 3, 0) + greatest(length(c) - 4, 0)
               AS total
           FROM (SELECT conv_id || '-' || turn AS id, regexp_replace(lower(text), '\\s+', ' ', 'g')
             AS c FROM conversations))) GROUP BY id, gram) GROUP BY gram""",
)
def char_ngram_shares(spark, d):
    """Character n-grams of all conversation turns, summed per n-gram."""
    t = D.table(spark, d, "conversations").select(
        F.concat_ws("-", D.text("conv_id"), D.text("turn")).alias("doc_id"), "text"
    )
    return style.char_ngram_shares(t).groupBy("gram").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n"),
        F.round(F.sum("share"), 6).alias("share_sum"),
    )


@entry(
    "function_word_shares",
    with_ctes(
        "tokens word_table",
        """SELECT t.doc_id, w.word, round(count(*) / any_value(z.n), 6) AS share FROM tokens t
           JOIN word_table w ON t.token = w.word JOIN (SELECT doc_id, count(*) AS n FROM tokens
             GROUP BY doc_id) z ON t.doc_id = z.doc_id GROUP BY t.doc_id, w.word""",
    ),
)
def function_word_shares(spark, d):
    return style.function_word_shares(D.document_texts(spark, d), ["doc_id"]).withColumn(
        "share", F.round("share", 6)
    )


_MARKS = ", ".join(
    "round((length(text) - length(replace(text, {q}, ''))) / greatest(length(text), 1) * 100.0, 6)"
    " AS p{i}".format(q="'" + m.replace("'", "''") + "'", i=i)
    for i, m in enumerate(fixed.PUNCTUATION)
)


@entry("punctuation_shares", f"SELECT doc_id, {_MARKS} FROM documents")
def punctuation_shares(spark, d):
    docs = D.document_texts(spark, d)
    return docs.select(
        "doc_id",
        *[
            F.round(text.punctuation_per_hundred("text", m), 6).alias(f"p{i}")
            for i, m in enumerate(fixed.PUNCTUATION)
        ],
    )


_SENT = (
    "[len(" + toks("s") + ") FOR s IN regexp_split_to_array(text, '[.!?]+') "
    r"IF regexp_matches(s, '[^\s]')]"
)


@entry(
    "sentence_lengths",
    f"""SELECT doc_id, CAST(len(l) AS BIGINT) AS n_sentences,
          round(coalesce(list_avg(l), 0), 6) AS avg_sentence_len,
          round(coalesce(list_stddev_pop(l), 0), 6) AS std_sentence_len
        FROM (SELECT doc_id, {_SENT} AS l FROM documents)""",
)
def sentence_lengths(spark, d):
    docs = D.document_texts(spark, d)
    n = docs.select("doc_id", F.expr(f"size({text.sentence_lengths_sql('text')})").cast("long")
                    .alias("n_sentences"))
    return style.features(docs).join(n, "doc_id").select(
        "doc_id", "n_sentences", rounded("avg_sentence_len"), rounded("std_sentence_len")
    )


@entry(
    "style_feature_bundle",
    f"""SELECT s.doc_id, s.word_count, s.avg_sentence_len, coalesce(g.distinct_ngrams, 0)
          AS distinct_ngrams, coalesce(g.total_ngrams, 0) AS total_ngrams,
          coalesce(g.top_ngram_count, 0) AS top_ngram_count, 174 AS vector_length
        FROM (SELECT doc_id, len({toks('text')}) AS word_count,
            round(coalesce(list_avg({_SENT}), 0), 6) AS avg_sentence_len FROM documents) s
        LEFT JOIN (SELECT doc_id, count(*) AS distinct_ngrams, CAST(sum(n) AS BIGINT)
            AS total_ngrams, max(n) AS top_ngram_count FROM (
          SELECT doc_id, gram, count(*) AS n FROM (SELECT doc_id,
            unnest([a || b || c, a || b || c || d, a || b || c || d || e]) AS gram FROM (SELECT doc_id, ch AS a, lead(ch, 1) OVER w AS b, lead(ch, 2) OVER w
              AS c, lead(ch, 3) OVER w AS d, lead(ch, 4) OVER w AS e FROM (
              SELECT doc_id, unnest(l) AS ch, generate_subscripts(l, 1) AS i FROM (
                SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '\\s+', ' ', 'g'),
                  '(?s).') AS l FROM documents)) WINDOW w AS (PARTITION BY doc_id ORDER BY i)))
          WHERE gram IS NOT NULL GROUP BY doc_id, gram) GROUP BY doc_id) g
        ON s.doc_id = g.doc_id""",
)
def style_feature_bundle(spark, d):
    return style.bundle(D.document_texts(spark, d)).select(
        "doc_id", "word_count", rounded("avg_sentence_len"), "distinct_ngrams", "total_ngrams",
        "top_ngram_count", F.size("vector").alias("vector_length"),
    )


CTES["fw_stats"] = (
    ("tokens", "word_table"),
    """SELECT w.pos, w.word, coalesce(sum(f.share) / any_value(n.n), 0.0) AS mean,
          sqrt(greatest(0.0, (coalesce(sum((f.share - m.m) * (f.share - m.m)), 0.0)
            + (any_value(n.n) - count(f.share)) * coalesce(any_value(m.m), 0.0)
            * coalesce(any_value(m.m), 0.0)) / any_value(n.n))) AS sd, any_value(n.n) AS n
        FROM word_table w LEFT JOIN (SELECT doc_id, token, count(*) / any_value(z) AS share
          FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS z FROM tokens)
          GROUP BY doc_id, token) f ON f.token = w.word
        LEFT JOIN (SELECT token, sum(share) / (SELECT count(*) FROM documents) AS m FROM (
          SELECT doc_id, token, count(*) / any_value(z) AS share
          FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS z FROM tokens)
          GROUP BY doc_id, token) GROUP BY token) m ON m.token = w.word
        CROSS JOIN (SELECT count(*) AS n FROM documents) n GROUP BY w.pos, w.word""",
)


@entry(
    "corpus_statistics",
    with_ctes(
        "fw_stats",
        """SELECT pos, word, n AS num_documents, round(mean, 6) AS mean,
             round(CASE WHEN sd = 0 THEN 1e-5 ELSE sd END, 6) AS std_dev FROM fw_stats""",
    ),
)
def corpus_statistics(spark, d):
    return style.corpus_statistics(D.document_texts(spark, d)).select(
        F.col("pos").cast("long").alias("pos"), "word", "num_documents", rounded("mean"),
        rounded("std_dev"),
    )


@entry(
    "corpus_statistics_stored",
    with_ctes(
        "fw_stats",
        """SELECT pos, word, round(mean, 6) AS mean,
             CASE WHEN round(CASE WHEN sd = 0 THEN 1e-5 ELSE sd END, 6) = 0 THEN 1e-5 ELSE
               round(CASE WHEN sd = 0 THEN 1e-5 ELSE sd END, 6) END AS std_dev FROM fw_stats""",
    ),
)
def corpus_statistics_stored(spark, d):
    """Statistics written as the JSON document and read back."""
    import uuid

    from linkweave.session import shared_folder
    from linkweave.sources import statistics

    path = f"{shared_folder(spark)}/statistics-{uuid.uuid4().hex}"
    statistics.save(style.corpus_statistics(D.document_texts(spark, d)), path)
    return statistics.load(spark, path).select(
        F.col("pos").cast("long").alias("pos"), "word", "mean", "std_dev"
    )


@entry(
    "style_episodes",
    f"""SELECT conv_id, role, count(*) AS n_texts, CAST(sum(len({toks('text')})) AS BIGINT)
          AS word_count, sum(len({toks('text')})) < 50 AS abstain
        FROM conversations GROUP BY conv_id, role""",
)
def style_episodes(spark, d):
    """An author's texts of one conversation as an episode."""
    t = D.table(spark, d, "conversations")
    return style.style_vectors(t, ["conv_id", "role"]).select(
        "conv_id", "role", "n_texts", "word_count", "abstain"
    )


CTES["fw_vec"] = (
    ("tokens", "word_table"),
    """SELECT t.doc_id, t.token AS word, count(*) / any_value(z.n) AS share FROM tokens t
        JOIN word_table w ON t.token = w.word JOIN (SELECT doc_id, count(*) AS n FROM tokens
          GROUP BY doc_id) z ON t.doc_id = z.doc_id GROUP BY t.doc_id, t.token""",
)
CTES["style_pairs"] = (
    ("fw_vec", "fw_stats", "document_pairs"),
    """SELECT p.left_id, p.right_id, any_value(a.n) AS left_words, any_value(b.n) AS right_words,
          sum(abs(coalesce(x.share, 0) - coalesce(y.share, 0))
            / CASE WHEN s.sd = 0 THEN 1e-5 ELSE s.sd END) / 174 AS delta,
          coalesce(sum(x.share * y.share), 0.0) AS dot, coalesce(sqrt(sum(x.share * x.share)), 0.0)
            AS na, coalesce(sqrt(sum(y.share * y.share)), 0.0) AS nb
        FROM document_pairs p
        JOIN (SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS n
          FROM documents) a ON a.doc_id = p.left_id
        JOIN (SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS n
          FROM documents) b ON b.doc_id = p.right_id
        CROSS JOIN fw_stats s
        LEFT JOIN fw_vec x ON x.doc_id = p.left_id AND x.word = s.word
        LEFT JOIN fw_vec y ON y.doc_id = p.right_id AND y.word = s.word
        GROUP BY p.left_id, p.right_id""",
)


@entry(
    "style_pair_evidence",
    with_ctes(
        "style_pairs",
        """SELECT left_id, right_id, left_words, right_words, abstain, round(c, 6) AS cosine,
             round(e, 6) AS delta, CASE WHEN abstain THEN 0.82 WHEN c > 0.85 OR e < 0.75 THEN 0.85
               WHEN c > 0.65 OR e < 0.95 THEN 0.7 ELSE 0.2 END::DOUBLE AS m_i,
             CASE WHEN abstain THEN 0.01 WHEN c > 0.85 OR e < 0.75 THEN 0.02
               WHEN c > 0.65 OR e < 0.95 THEN 0.05 ELSE 0.5 END::DOUBLE AS u_i
           FROM (SELECT *, CASE WHEN NOT abstain THEN CASE WHEN na * nb = 0 THEN 0.0
               ELSE dot / (na * nb) END END AS c, CASE WHEN NOT abstain THEN delta END AS e
             FROM (SELECT *, left_words < 50 OR right_words < 50 AS abstain FROM style_pairs))""",
    ),
)
def style_pair_evidence(spark, d):
    docs = D.document_texts(spark, d)
    out = style.verify_pairs(
        D.document_pairs(spark, d), style.style_vectors(docs, ["doc_id"]),
        style.corpus_statistics(docs),
    )
    return out.select(
        "left_id", "right_id", "left_words", "right_words", "abstain", rounded("cosine"),
        rounded("delta"), "m_i", "u_i",
    )


CTES["pair_feats"] = (
    ("turn_pairs",),
    f"""SELECT pair_id, side, unnest(list_concat(list_concat(['w_' || w FOR w IN tk],
          ['bg_' || tk[i] || '_' || tk[i + 1] FOR i IN range(1, len(tk))]),
          ['c3_' || j[i:i + 2] FOR i IN range(1, length(j) - 1)])) AS feature
        FROM (SELECT *, array_to_string(tk, ' ') AS j FROM (
          SELECT pair_id, 'a' AS side, {atoks('text_a')} AS tk FROM turn_pairs UNION ALL
          SELECT pair_id, 'b', {atoks('text_b')} FROM turn_pairs))""",
)
_SHORT = f"""SELECT p.pair_id, len({atoks('p.text_a')}) AS tokens_a, len({atoks('p.text_b')}) AS tokens_b,
    least(1.0, greatest(0.0, coalesce(c.cos, 0.0))) AS s FROM turn_pairs p LEFT JOIN (
      SELECT pair_id, sum(wa * wb) / (sqrt(sum(wa * wa)) * sqrt(sum(wb * wb))) AS cos FROM (
        SELECT pair_id, feature, CASE WHEN feature[1:3] = 'c3_' THEN 0.5 ELSE 1.0 END
            * count(*) FILTER (WHERE side = 'a') AS wa,
          CASE WHEN feature[1:3] = 'c3_' THEN 0.5 ELSE 1.0 END
            * count(*) FILTER (WHERE side = 'b') AS wb
        FROM pair_feats GROUP BY pair_id, feature) GROUP BY pair_id
      HAVING sum(wa * wa) > 0 AND sum(wb * wb) > 0) c ON p.pair_id = c.pair_id"""


@entry(
    "short_text_authorship",
    with_ctes(
        "turn_pairs pair_feats",
        f"""SELECT pair_id, CAST(tokens_a AS BIGINT) AS tokens_a, CAST(tokens_b AS BIGINT)
              AS tokens_b, verdict, reason, round(s, 4) AS similarity,
              CASE WHEN verdict = 'ABSTAIN' THEN 0.0 ELSE greatest(-5.0, least(10.0,
                round(log2((s + 0.01) / (1.01 - s)) * 2.5, 2))) END AS llr_score
            FROM (SELECT pair_id, tokens_a, tokens_b, CASE WHEN few THEN 0.0 ELSE s END AS s,
              CASE WHEN few OR s < 0.45 THEN 'ABSTAIN' WHEN s >= 0.65 THEN 'MATCH'
                ELSE 'NO_MATCH' END AS verdict,
              CASE WHEN few THEN 'INSUFFICIENT_TOKEN_COUNT' WHEN s < 0.45
                THEN 'LOW_SIMILARITY_CONFIDENCE' ELSE 'HIGH_CONFIDENCE_EVALUATION' END AS reason
              FROM (SELECT *, tokens_a < 10 OR tokens_b < 10 AS few FROM ({_SHORT})))""",
    ),
)
def short_text_authorship(spark, d):
    out = style.verify_short_pairs(D.turn_pairs(spark, d))
    return out.withColumn("tokens_a", F.col("tokens_a").cast("long")).withColumn(
        "tokens_b", F.col("tokens_b").cast("long")
    )


@entry(
    "short_text_vectors",
    with_ctes(
        "pair_feats",
        """SELECT pair_id, feature, count(*) FILTER (WHERE side = 'a') AS a,
             count(*) FILTER (WHERE side = 'b') AS b FROM pair_feats GROUP BY pair_id, feature""",
    ),
)
def short_text_vectors(spark, d):
    """Feature counts of both sides of each pair of turns."""
    return style.pair_features(
        D.turn_pairs(spark, d), style.SHORT_TEXT_TOKENS, style.SHORT_TEXT_FEATURES
    )


@entry(
    "hashed_ngram_evidence",
    with_ctes(
        "turn_pairs",
        r""", g AS (SELECT pair_id, side, CAST('0x' || substr(md5(gram), 1, 8) AS BIGINT) % 9999 + 1
               AS h FROM (SELECT pair_id, side, unnest(list_concat([c[i:i + 2] FOR i IN
                 range(1, length(c) - 1)], list_concat([c[i:i + 3] FOR i IN range(1, length(c) - 2)],
                 [c[i:i + 4] FOR i IN range(1, length(c) - 3)]))) AS gram FROM (
               SELECT pair_id, 'a' AS side, trim(regexp_replace(lower(text_a), '\s+', ' ', 'g')) AS c
               FROM turn_pairs UNION ALL SELECT pair_id, 'b', trim(regexp_replace(lower(text_b),
                 '\s+', ' ', 'g')) FROM turn_pairs))),
             k AS (SELECT pair_id, sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) AS cos FROM (
               SELECT pair_id, h, (count(*) FILTER (WHERE side = 'a'))::DOUBLE AS a,
                 (count(*) FILTER (WHERE side = 'b'))::DOUBLE AS b FROM g GROUP BY pair_id, h)
               GROUP BY pair_id HAVING sum(a) > 0 AND sum(b) > 0)
             SELECT p.pair_id, trim(text_a) = '' OR trim(text_b) = '' AS abstain,
               round(coalesce(cos, 0.0), 4) AS cosine,
               CASE WHEN cos > 0.85 THEN 0.85 WHEN cos > 0.65 THEN 0.7 ELSE 0.3 END::DOUBLE AS m_i
             FROM turn_pairs p LEFT JOIN k ON p.pair_id = k.pair_id""",
    ),
)
def hashed_ngram_evidence(spark, d):
    return style.hashed_ngram_pairs(D.turn_pairs(spark, d)).select(
        "pair_id", "abstain", "cosine", "m_i"
    )


@entry(
    "top_word_distance",
    with_ctes(
        "turn_pairs",
        f""", t AS (SELECT pair_id, 'a' AS side, unnest({toks('text_a')}) AS w FROM turn_pairs
               UNION ALL SELECT pair_id, 'b', unnest({toks('text_b')}) FROM turn_pairs),
             z AS (SELECT pair_id, count(*) FILTER (WHERE side = 'a') AS na,
               count(*) FILTER (WHERE side = 'b') AS nb FROM t GROUP BY pair_id),
             f AS (SELECT t.pair_id, w, count(*) FILTER (WHERE side = 'a') AS a,
               count(*) FILTER (WHERE side = 'b') AS b, any_value(na) AS na, any_value(nb) AS nb
               FROM t JOIN z ON t.pair_id = z.pair_id WHERE na > 0 AND nb > 0
               GROUP BY t.pair_id, w),
             r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY a * nb + b * na DESC,
               w) AS rn FROM f),
             d AS (SELECT pair_id, round(sum(abs(a / na - b / nb)) / count(*), 4) AS dist FROM r
               WHERE rn <= 50 GROUP BY pair_id)
             SELECT p.pair_id, coalesce(dist, 2.0) AS distance,
               round(1.0 / (1.0 + exp(-2.5 + 15.0 * coalesce(dist, 2.0))), 4) AS probability
             FROM turn_pairs p LEFT JOIN d ON p.pair_id = d.pair_id""",
    ),
)
def top_word_distance(spark, d):
    return style.top_word_distance(D.turn_pairs(spark, d))


# --- near copies ----------------------------------------------------------------------------------

_BITS = " + ".join(
    f"(CASE WHEN 2 * sum((h >> {i}) & 1) > count(*) THEN 1::UBIGINT << {i} ELSE 0::UBIGINT END)"
    for i in range(64)
)
CTES["prints"] = (
    ("tokens",),
    f"""SELECT d.doc_id, coalesce(s.simhash, 0::UBIGINT) AS simhash FROM documents d LEFT JOIN (
          SELECT doc_id, {_BITS} AS simhash FROM (SELECT doc_id,
            CAST('0x' || substr(md5(token), 1, 16) AS UBIGINT) AS h FROM tokens) GROUP BY doc_id) s
        ON d.doc_id = s.doc_id""",
)


@entry(
    "similarity_fingerprints",
    with_ctes(
        "prints",
        """SELECT doc_id, lower(lpad(to_hex(simhash), 16, '0')) AS simhash FROM prints""",
    ),
)
def similarity_fingerprints(spark, d):
    return clones.fingerprints(D.document_texts(spark, d)).select(
        "doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("simhash")
    )


@entry(
    "clone_check_of_pairs",
    with_ctes(
        "prints document_pairs",
        """SELECT left_id, right_id, round(1.0 - bit_count(xor(a.simhash, b.simhash)) / 64.0, 4)
             AS similarity, round(1.0 - bit_count(xor(a.simhash, b.simhash)) / 64.0, 4) >= 0.95
             AS is_clone FROM document_pairs p JOIN prints a ON p.left_id = a.doc_id
           JOIN prints b ON p.right_id = b.doc_id""",
    ),
)
def clone_check_of_pairs(spark, d):
    return clones.compare_pairs(
        D.document_pairs(spark, d), clones.fingerprints(D.document_texts(spark, d))
    )


@entry(
    "clone_pairs",
    with_ctes(
        "prints",
        """, u AS (SELECT simhash, min(doc_id) AS first_id, count(*) AS copies FROM prints
               GROUP BY simhash)
           SELECT least(a.first_id, b.first_id) AS first_low,
             greatest(a.first_id, b.first_id) AS first_high, a.copies + b.copies AS n_texts,
             CAST(bit_count(xor(a.simhash, b.simhash)) AS BIGINT) AS distance
           FROM u a JOIN u b ON a.simhash < b.simhash
             AND bit_count(xor(a.simhash, b.simhash)) <= 3""",
    ),
)
def clone_pairs(spark, d):
    out = clones.clone_pairs(clones.fingerprints(D.document_texts(spark, d)))
    return out.select(
        F.least("first_a", "first_b").alias("first_low"),
        F.greatest("first_a", "first_b").alias("first_high"),
        (F.col("copies_a") + F.col("copies_b")).alias("n_texts"),
        F.col("distance").cast("long").alias("distance"),
    )


@entry(
    "exact_copies",
    with_ctes(
        "prints",
        """SELECT min(doc_id) AS first_id, count(*) AS copies FROM prints GROUP BY simhash
           HAVING count(*) > 1""",
    ),
)
def exact_copies(spark, d):
    prints = clones.fingerprints(D.document_texts(spark, d))
    return clones.distinct_prints(prints).where("copies > 1").select("first_id", "copies")


# --- extraction and footprints ------------------------------------------------------------------------

KIND_QUERIES = []
for _kind, _group, _conf, _pattern in fixed.IDENTIFIER_PLAN:
    _flag = "(?i)" if _kind == "ONION_SERVICE" else ""
    _n = 1 if _kind in ("BTC_ADDRESS", "XMR_ADDRESS", "HANDLE") else 0
    _v = f"unnest(regexp_extract_all(body, '{_flag}{_pattern}', {_n}))"
    if _kind == "PGP_FINGERPRINT":
        _v = f"upper(regexp_replace({_v}, '\\s', '', 'g'))"
    KIND_QUERIES.append(
        f"SELECT DISTINCT text_id, '{_kind}' AS kind, {_v} AS value, '{_group}' AS "
        f"dependence_group, {_conf}::DOUBLE AS confidence FROM texts"
    )


@entry("identifier_extraction", with_ctes("texts", " UNION ALL ".join(KIND_QUERIES)))
def identifier_extraction(spark, d):
    return extract.extract_identifiers(D.texts_with_identifiers(spark, d)).drop(
        "extraction_method"
    )


@entry(
    "extraction_summary",
    with_ctes(
        "texts",
        ", x AS (" + " UNION ALL ".join(KIND_QUERIES) + """)
        SELECT t.text_id, count(x.value) FILTER (WHERE kind = 'PGP_FINGERPRINT') AS n_pgp,
          count(x.value) FILTER (WHERE kind = 'EMAIL') AS n_email,
          count(x.value) FILTER (WHERE kind = 'XMR_ADDRESS') > 0 AS xmr_abstain
        FROM texts t LEFT JOIN x ON t.text_id = x.text_id GROUP BY t.text_id""",
    ),
)
def extraction_summary(spark, d):
    return extract.extraction_summary(D.texts_with_identifiers(spark, d)).select(
        "text_id", F.col("n_pgp_fingerprint").alias("n_pgp"), F.col("n_email"), "xmr_abstain"
    )


def _footprint_input(spark, d):
    k = F.pmod("page_id", F.lit(5))
    headers = (
        F.when(k == 0, F.create_map(F.lit("Server"), F.lit("nginx/1.18"), F.lit("Via"),
                                    F.lit("1.1 proxy")))
        .when(k == 1, F.create_map(F.lit("SERVER"), F.lit("Apache"), F.lit("X-Powered-By"),
                                   F.lit("PHP/8")))
        .when(k == 2, F.create_map(F.lit("x-powered-by"), F.lit("Express")))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    marker = F.when(F.pmod("page_id", F.lit(11)) == 0, "<h1>Apache Server Status</h1>").when(
        F.pmod("page_id", F.lit(13)) == 0, "<h1>Nginx Status</h1>"
    ).otherwise("")
    pem = F.when(
        F.pmod("page_id", F.lit(3)) == 0,
        F.concat(F.lit("\nSubject: CN="), host, F.lit("/O=x\nIssuer: CN=ca\n")),
    )
    return D.table(spark, d, "pages").select(
        "page_id", "url", F.concat("html", marker).alias("html"),
        F.when(F.pmod("page_id", F.lit(4)) != 0, F.pmod(F.col("page_id") * 31, F.lit(97)))
        .cast("int").alias("favicon_hash"),
        headers.alias("headers"), pem.alias("tls_pem"),
    )


@entry(
    "page_footprints",
    r"""SELECT page_id, exposed AS status_exposed, banner AS server_banner,
          CASE k WHEN 1 THEN 'PHP/8' WHEN 2 THEN 'Express' ELSE 'Unknown' END AS x_powered_by,
          CASE k WHEN 0 THEN '1.1 proxy' ELSE '' END AS via_proxy,
          CASE WHEN page_id % 3 = 0 THEN host ELSE 'Unknown' END AS tls_common_name,
          array_to_string(list_filter([
            CASE WHEN page_id % 4 <> 0 AND (page_id * 31) % 97 <> 0
              THEN 'FAVICON_MMH3_' || CAST((page_id * 31) % 97 AS VARCHAR) END,
            CASE WHEN exposed THEN 'SERVER_STATUS_PAGE_EXPOSED' END,
            CASE WHEN page_id % 3 = 0 THEN 'TLS_CERT_' || substr(sha256('Subject: CN=' || host
              || '/O=x' || chr(10) || 'Issuer: CN=ca'), 1, 16) END,
            CASE WHEN banner <> 'Unknown' THEN 'SERVER_BANNER_' || banner END],
            lambda x: x IS NOT NULL), ',') AS leaks
        FROM (SELECT page_id, page_id % 5 AS k, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
          CASE page_id % 5 WHEN 0 THEN 'nginx/1.18' WHEN 1 THEN 'Apache' ELSE 'Unknown' END
            AS banner, page_id % 11 = 0 OR page_id % 13 = 0
            OR contains(html, 'Apache Server Status') OR contains(html, 'Nginx Status') AS exposed
          FROM pages)""",
)
def page_footprints(spark, d):
    return extract.page_footprints(_footprint_input(spark, d)).select(
        "page_id", "status_exposed", "server_banner", "x_powered_by", "via_proxy",
        "tls_common_name", F.array_join("leaks", ",").alias("leaks"),
    )


# --- ingest ------------------------------------------------------------------------------------------------


def _batch(spark, d):
    """Observations from honeypots are stored already; all others arrive now."""
    rows = observations.with_digest(observations.gate(D.raw_observations(spark, d))[0])
    return rows.where("source_type <> 'HONEYPOT'"), rows.where("source_type = 'HONEYPOT'")


@entry(
    "observations_accepted",
    with_ctes(
        "accepted",
        "SELECT observation_id, sha256, lawful_basis, source_type FROM accepted",
    ),
)
def observations_accepted(spark, d):
    accepted, _ = observations.gate(D.raw_observations(spark, d))
    return observations.with_digest(accepted).select(
        "observation_id", "sha256", "lawful_basis", "source_type"
    )


@entry(
    "observations_held_back",
    with_ctes(
        "raw_observations",
        """SELECT observation_id, CASE WHEN lawful_basis = 'unstated' THEN
             'lawful basis outside the closed list' ELSE 'content length' END AS held_because
           FROM raw_observations WHERE lawful_basis = 'unstated'
             OR length(raw_content) NOT BETWEEN 1 AND 200000""",
    ),
)
def observations_held_back(spark, d):
    _, held = observations.gate(D.raw_observations(spark, d))
    return held.select("observation_id", "held_because")


@entry(
    "observations_new",
    with_ctes(
        "accepted",
        """SELECT min(observation_id) AS observation_id, sha256 FROM accepted
           WHERE source_type <> 'HONEYPOT' AND sha256 NOT IN (SELECT sha256 FROM accepted
             WHERE source_type = 'HONEYPOT') GROUP BY sha256""",
    ),
)
def observations_new(spark, d):
    batch, stored = _batch(spark, d)
    return observations.novel(batch, stored).select("observation_id", "sha256")


@entry(
    "observations_duplicate",
    with_ctes(
        "accepted",
        """, f AS (SELECT sha256, first(observation_id ORDER BY source_type <> 'HONEYPOT',
               observation_id) AS prior FROM accepted GROUP BY sha256)
           SELECT a.observation_id, a.sha256, f.prior AS prior_observation_id FROM accepted a
           JOIN f ON a.sha256 = f.sha256 WHERE a.source_type <> 'HONEYPOT'
             AND a.observation_id <> f.prior""",
    ),
)
def observations_duplicate(spark, d):
    batch, stored = _batch(spark, d)
    return observations.duplicates(batch, stored)


@entry(
    "artifact_store",
    with_ctes(
        "accepted",
        """SELECT sha256, 'art-' || substr(sha256, 1, 32) AS artifact_id,
             first(source_uri ORDER BY observation_id) AS storage_uri, 'text/plain' AS content_type,
             CAST(any_value(strlen(raw_content)) AS BIGINT) AS size,
             substr(sha256, 1, 2) AS digest_prefix FROM accepted GROUP BY sha256""",
    ),
)
def artifact_store(spark, d):
    accepted, _ = observations.gate(D.raw_observations(spark, d))
    return observations.content_store(observations.with_digest(accepted))


@entry(
    "source_registry",
    with_ctes(
        "accepted",
        """SELECT source_name AS name, lawful_basis, first(source_type ORDER BY observation_id)
             AS source_type, any_value(source_uri) AS base_uri FROM accepted
           WHERE source_type <> 'HONEYPOT' AND (source_name, lawful_basis) NOT IN (SELECT
             (source_name, lawful_basis) FROM accepted WHERE source_type = 'HONEYPOT')
           GROUP BY source_name, lawful_basis""",
    ),
)
def source_registry(spark, d):
    batch, stored = _batch(spark, d)
    known = stored.select(F.col("source_name").alias("name"), "lawful_basis").distinct()
    return observations.new_sources(batch, known).select(
        "name", "lawful_basis", "source_type", "base_uri"
    )


_FRESHKIND_QUERIES = " UNION ALL ".join(
    k.replace("text_id", "observation_id").replace("FROM texts", "FROM fresh") for k in KIND_QUERIES
)


@entry(
    "observation_ingest",
    with_ctes(
        "accepted raw_observations",
        f""", batch AS (SELECT * FROM accepted WHERE source_type <> 'HONEYPOT'),
            fresh AS (SELECT *, raw_content AS body FROM batch WHERE observation_id IN (
              SELECT min(observation_id) FROM batch WHERE sha256 NOT IN (SELECT sha256
                FROM accepted WHERE source_type = 'HONEYPOT') GROUP BY sha256)),
            src AS (SELECT DISTINCT source_name, lawful_basis FROM batch EXCEPT
              SELECT source_name, lawful_basis FROM accepted WHERE source_type = 'HONEYPOT')
            SELECT 'held' AS table_name, count(*) FILTER (WHERE lawful_basis = 'unstated'
              OR length(raw_content) NOT BETWEEN 1 AND 200000) AS n_rows FROM raw_observations
              WHERE source_type <> 'HONEYPOT'
            UNION ALL SELECT 'sources', count(*) FROM src
            UNION ALL SELECT 'artifacts', count(*) FROM fresh
            UNION ALL SELECT 'observations', count(*) FROM fresh
            UNION ALL SELECT 'audit_events', count(*) FROM fresh
            UNION ALL SELECT 'evidence', count(*) FROM ({_FRESHKIND_QUERIES})""",
    ),
)
def observation_ingest(spark, d):
    """Rows a batch adds to each table."""
    from functools import reduce

    raw = D.raw_observations(spark, d)
    _, stored = _batch(spark, d)
    registry = stored.select(F.col("source_name").alias("name"), "lawful_basis").distinct()
    out = observations.ingest(raw.where("source_type <> 'HONEYPOT'"), stored, registry)
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
        for n, df in out.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


# --- search -----------------------------------------------------------------------------------------------------

_TERMS = [("the", 1), ("ention", 2), ("que", 1)]


_SEARCH_SQL = with_ctes(
    "tokens",
    r""", q AS (SELECT * FROM (VALUES ('the', 1), ('ention', 2), ('que', 1)) AS t(term, fuzz)),
       len AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id),
       h AS (SELECT t.doc_id, q.term, count(*) AS tf FROM tokens t JOIN q
         ON levenshtein(regexp_replace(t.token, '[^\x00-\x7F]', '~', 'g'), q.term) <= q.fuzz GROUP BY t.doc_id, q.term),
       s AS (SELECT (SELECT count(*) FROM documents) AS n_docs,
         (SELECT sum(n) FROM len) / (SELECT count(*) FROM documents) AS avg_len)
       SELECT h.doc_id, round(3 * sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2
         / (tf + 1.2 * (0.25 + 0.75 * len.n / avg_len))), 6) AS score
       FROM h JOIN (SELECT term, count(*) AS df FROM h GROUP BY term) f ON h.term = f.term
       JOIN len ON h.doc_id = len.doc_id CROSS JOIN s GROUP BY h.doc_id
       ORDER BY round(3 * sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2
         / (tf + 1.2 * (0.25 + 0.75 * len.n / avg_len))), 9) DESC, h.doc_id LIMIT 50""",
)


@entry("scored_text_search", _SEARCH_SQL)
def scored_text_search(spark, d):
    docs = D.table(spark, d, "documents").select("doc_id", "text", "source")
    return search.scored_search(docs, [t for t, _ in _TERMS], 50).select(
        "doc_id", rounded("score")
    )


@entry("indexed_text_search", _SEARCH_SQL)
def indexed_text_search(spark, d):
    """The same search on a stored inverted index of the documents."""
    docs = D.table(spark, d, "documents").select("doc_id", "text", "source")
    root = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    textindex.build(docs, root)
    return textindex.search(docs, root, [t for t, _ in _TERMS], 50).select(
        "doc_id", rounded("score")
    )


@entry(
    "truncated_labels",
    "SELECT doc_id, substr(text, 1, 16) || '...' AS label FROM documents",
)
def truncated_labels(spark, d):
    return D.document_texts(spark, d).select("doc_id", text.truncated("text", 16).alias("label"))


@entry(
    "iso_timestamps",
    """SELECT event_id, CASE event_id % 8 WHEN 3 THEN NULL WHEN 2 THEN epoch_us(ts) - 7200000000
         WHEN 4 THEN epoch_us(ts) // 1000000 * 1000000 - 7200000000
         WHEN 5 THEN epoch_us(ts) // 1000000 * 1000000
         WHEN 7 THEN epoch_us(date_trunc('day', ts)) ELSE epoch_us(ts) END AS micros FROM events""",
)
def iso_timestamps(spark, d):
    """Time stamps in eight spellings, read back: Z, none, two offsets, no separators, nine
    digits of a fraction, a week date, and unreadable."""
    ts = F.col("ts").cast("timestamp")
    shown = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    k = F.pmod("event_id", F.lit(8))
    thursday = F.date_add(F.trunc(ts, "week"), 3)
    week = F.concat(
        F.year(thursday).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"),
        F.lit("-"), (F.weekday(ts) + 1).cast("string"),
    )
    spelled = (
        F.when(k == 0, F.concat(shown, F.lit("Z")))
        .when(k == 1, shown)
        .when(k == 2, F.concat(shown, F.lit("+02:00")))
        .when(k == 3, F.concat(F.lit("about "), shown))
        .when(k == 4, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0200")))
        .when(k == 5, F.date_format(ts, "yyyyMMdd'T'HHmmss"))
        .when(k == 6, F.concat(shown, F.lit("789")))
        .otherwise(week)
    )
    rows = D.table(spark, d, "events").select("event_id", spelled.alias("t"))
    return rows.select("event_id", F.unix_micros(web.iso_timestamp("t")).alias("micros"))

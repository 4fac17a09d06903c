"""Evidence rows: priors, defaults, and the older row shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave import fixed

ROW_FIELDS = {
    "link_id": "string",
    "id": "string",
    "feature_name": "string",
    "family": "string",
    "dependence_group": "string",
    "m_i": "double",
    "u_i": "double",
    "llr": "double",
    "is_contradiction": "boolean",
    "contradiction_weight": "double",
    "abstain": "boolean",
    "source_reliability": "double",
    "credibility_multiplier": "double",
}


def prior_values_sql() -> str:
    """The built-in priors as one VALUES list, read alike by Spark and other engines."""
    rows = [
        f"('{n}', '{fam}', '{grp}', CAST({m!r} AS DOUBLE), CAST({u!r} AS DOUBLE), "
        f"CAST(NULL AS DOUBLE))"
        for n, fam, grp, m, u in fixed.FEATURE_PRIORS
    ]
    rows += [
        f"('{n}', '{fixed.CONTRADICTION_FAMILY}', '{fixed.CONTRADICTION_GROUP}', "
        f"CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST({w!r} AS DOUBLE))"
        for n, w in fixed.CONTRADICTION_PRIORS
    ]
    return ", ".join(rows)


PRIOR_COLUMNS = "feature_name, prior_family, prior_group, prior_m, prior_u, prior_weight"


def prior_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Priors per feature; contradictions carry ``prior_weight`` instead of m and u.

    ``path`` names a JSON-lines file with the same columns; a path that does not
    exist gives an empty table, so every feature takes the default values.
    """
    if path is None:
        return spark.sql(f"SELECT * FROM VALUES {prior_values_sql()} AS t({PRIOR_COLUMNS})")
    schema = (
        "feature_name string, prior_family string, prior_group string, "
        "prior_m double, prior_u double, prior_weight double"
    )
    if not _exists(spark, path):
        return spark.sql(f"SELECT * FROM VALUES {prior_values_sql()} AS t({PRIOR_COLUMNS})").where(
            "false"
        )
    return spark.read.schema(schema).json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def _complete(rows: DataFrame) -> DataFrame:
    """Add the row fields the caller left out, as NULL."""
    have = set(rows.columns)
    fields = [
        f"CAST({n if n in have else 'NULL'} AS {t}) AS {n}" for n, t in ROW_FIELDS.items()
    ]
    return rows.selectExpr(*fields, *[f"`{c}`" for c in rows.columns if c not in ROW_FIELDS])


def normalise_rows(
    rows: DataFrame, priors: DataFrame | None = None, defaults: str = "row"
) -> DataFrame:
    """Fill evidence rows from the priors.

    ``defaults="row"`` treats unknown features as free-form rows (their own family,
    group and m/u, or .90/.01); ``defaults="factory"`` gives them .80/.05 and the
    feature name as group. A contradiction taken from the priors ignores reliability.
    """
    rows = _complete(rows)
    if priors is None:
        priors = F.broadcast(prior_table(rows.sparkSession))  # 13 literal rows
    m_default, u_default = fixed.ROW_DEFAULTS[defaults]
    joined = rows.join(priors.selectExpr("*", "true AS known"), "feature_name", "left")

    conflict = "prior_weight IS NOT NULL"
    legal = ", ".join(f"'{f}'" for f in fixed.FAMILIES)
    if defaults == "row":
        family = f"CASE WHEN family IN ({legal}) THEN family ELSE '{fixed.DEFAULT_FAMILY}' END"
        group, own_m, own_u = "id", "m_i", "u_i"
    else:
        family = f"'{fixed.DEFAULT_FAMILY}'"
        group, own_m, own_u = "feature_name", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)"
    return joined.selectExpr(
        "link_id",
        "id",
        "coalesce(nullif(feature_name, ''), 'custom_evidence') AS feature_name",
        f"CASE WHEN known THEN prior_family ELSE {family} END AS family",
        "CASE WHEN known THEN coalesce(nullif(dependence_group, ''), prior_group) "
        f"ELSE coalesce(dependence_group, {group}) END AS dependence_group",
        f"CASE WHEN {conflict} THEN 0.90D WHEN known THEN prior_m "
        f"ELSE coalesce({own_m}, {m_default}D) END AS m_i",
        f"CASE WHEN {conflict} THEN 0.01D WHEN known THEN prior_u "
        f"ELSE coalesce({own_u}, {u_default}D) END AS u_i",
        "llr",
        f"coalesce(is_contradiction, {conflict}) AS is_contradiction",
        "coalesce(contradiction_weight, prior_weight, 0D) AS contradiction_weight",
        "coalesce(abstain, false) AS abstain",
        f"CASE WHEN {conflict} THEN 1D ELSE coalesce(source_reliability, 1D) END "
        "AS source_reliability",
        f"CASE WHEN {conflict} THEN 1D ELSE coalesce(credibility_multiplier, 1D) END "
        "AS credibility_multiplier",
        *[f"`{c}`" for c in rows.columns if c not in ROW_FIELDS],
    )


def family_code(label: Column) -> Column:
    """Display label ("Exact Identity", "Content / NLP") to family code."""
    folded = F.regexp_replace(F.upper(F.trim(label)), "[/ _]+", "_")
    return F.regexp_replace(folded, "^_|_$", "")


def adapt_legacy_rows(rows: DataFrame) -> DataFrame:
    """Older row shape to evidence rows.

    Family labels become codes, named contradictions become weights, provenance goes
    to ``metadata``. Rows whose label is no known family get ``family`` NULL, so the
    caller can divert them.
    """
    code = family_code(F.col("family"))
    weight = F.lit(fixed.LEGACY_CONTRADICTION_DEFAULT)
    for name, value in fixed.LEGACY_CONTRADICTION_WEIGHTS.items():
        weight = F.when(F.col("contradiction_type") == name, F.lit(value)).otherwise(weight)
    have = set(rows.columns)
    given = F.col("contradiction_weight") if "contradiction_weight" in have else F.lit(None)
    contradicts = F.coalesce(F.col("is_contradiction"), F.lit(False))
    value = F.coalesce(F.col("value"), F.lit(""))
    keep = ["value", "source_uri", "extraction_method", "timestamp", "sha256"]
    pairs = [x for n in keep if n in have for x in (F.lit(n), F.col(n).cast("string"))]
    return rows.select(
        "link_id",
        F.col("evidence_id").alias("id"),
        F.when(value == "", F.col("evidence_id")).otherwise(value).alias("feature_name"),
        F.when(code.isin(*fixed.FAMILIES), code).alias("family"),
        F.col("dependence_group"),
        F.coalesce(F.col("m_prob"), F.lit(0.90)).alias("m_i"),
        F.coalesce(F.col("u_prob"), F.lit(0.01)).alias("u_i"),
        F.lit(None).cast("double").alias("llr"),
        contradicts.alias("is_contradiction"),
        F.coalesce(
            given.cast("double"), F.when(contradicts, weight).otherwise(F.lit(0.0))
        ).alias("contradiction_weight"),
        F.coalesce(F.col("abstain"), F.lit(False)).alias("abstain")
        if "abstain" in have
        else F.lit(False).alias("abstain"),
        F.coalesce(F.col("source_reliability"), F.lit(1.0)).alias("source_reliability")
        if "source_reliability" in have
        else F.lit(1.0).alias("source_reliability"),
        F.lit(1.0).alias("credibility_multiplier"),
        F.create_map(*pairs).alias("metadata"),
    )


def rows_from_links(links: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """Links with feature arrays to evidence rows.

    Input: ``link_id, features, contradictions, abstained`` (arrays of feature
    names). Names without a prior are dropped. A contradiction counts against the
    exact identity family.
    """
    if priors is None:
        priors = F.broadcast(prior_table(links.sparkSession))

    def tagged(column: str, conflict: str, quiet: str) -> str:
        return (
            f"transform(coalesce({column}, array()), n -> named_struct('feature_name', "
            f"CAST(n AS STRING), 'is_contradiction', {conflict}, 'abstain', {quiet}))"
        )

    parts = ", ".join(
        [
            tagged("features", "false", "false"),
            tagged("contradictions", "true", "false"),
            tagged("abstained", "false", "true"),
        ]
    )
    return (
        links.selectExpr("link_id", f"posexplode(concat({parts})) AS (pos, f)")
        .selectExpr("link_id", "pos", "f.*")
        .join(priors, "feature_name")
        .where("is_contradiction = (prior_weight IS NOT NULL)")
        .selectExpr(
            "link_id",
            "concat_ws('-', link_id, CAST(pos AS STRING)) AS id",
            "feature_name",
            "CASE WHEN is_contradiction THEN 'EXACT_IDENTITY' ELSE prior_family END AS family",
            "CASE WHEN is_contradiction THEN concat('contradiction_', feature_name) "
            "ELSE prior_group END AS dependence_group",
            "coalesce(prior_m, 0.90D) AS m_i",
            "coalesce(prior_u, 0.01D) AS u_i",
            "CAST(NULL AS DOUBLE) AS llr",
            "is_contradiction",
            "coalesce(prior_weight, 0D) AS contradiction_weight",
            "abstain",
            "1D AS source_reliability",
            "1D AS credibility_multiplier",
        )
    )

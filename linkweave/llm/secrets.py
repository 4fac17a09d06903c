"""Secret scan with multipart credential linking, in DataFrame functions only.

Three strong kinds are reported wherever they stand: assigned secrets, access identifiers
and long hexadecimal runs. Three weak kinds (a named identifier, a mixed token or short
assigned value, an address of a service) say little alone: they are reported only if
complementary parts of a credential lie within ``SCOPE`` characters: an identifier needs a
secret, a secret needs an identifier or an address, an address needs both. Weak spans
that overlap a strong one are left out.

Places come from splitting a text at the matches: the lengths of gaps and matches add up to
code-point offsets in one running sum. The interval join is a sweep over a text's parts in
the order of their starts: the nearest complementary part before and after decides, so no
pairs are formed, however many parts a text holds. Whole texts are read; only the few
parts, and one narrow row per text, are shuffled, by a number given to each row (a hot
source or id is therefore spread).

Nulls, ties: a null or empty text has no spans and the digest of the empty string. Rows
are told apart by position, so null and repeated ids give a row each. Of equal starts the
kind listed first comes first. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.llm import common

SCOPE = 200
#: A short assigned value counts as a weak secret from this length, as a strong one from STRONG.
SHORT, STRONG = 6, 12
#: Up to so many texts with spans are broadcast when spans are masked.
FEW = 100_000
KINDS = ("assign", "access", "hex", "identifier", "key", "endpoint")
ASSIGN, ACCESS, HEX, IDENTIFIER, KEY, ENDPOINT = range(6)

# The patterns. Access and hex carry their least lengths: a shorter run
# cannot contain a longer one, so matching first and dropping afterwards is the same.
PATTERNS = (
    r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    r"AKIA[A-Z0-9]{14,}",
    r"[0-9a-f]{16,}",
    r"(?i:(access_?key(?:_?id)?|client_?id|account(?:_?id)?|user(?:_?name)?|login))[\"']?\x20*[:=]\x20*[\"']?"
    r"([A-Za-z0-9@+._-]{4,})",
    r"[A-Za-z0-9+/_=-]{20,}",
    r"(?:(?i:https?|s?ftp|s3|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^\x20\x09-\x0D\"'<>]+"
    r"|[0-9]{1,3}(?:\.[0-9]{1,3}){3}:[0-9]{2,5})",
)


def _matches(text: Column, kind: int) -> Column:
    """``kind, at, gap, size, value`` of every match: running sums give its place."""
    pattern = F.lit(PATTERNS[kind])
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(2)) if kind in (ASSIGN, IDENTIFIER) else whole
    parts = F.arrays_zip(
        F.split(text, PATTERNS[kind], -1).alias("gap"), whole.alias("whole"), value.alias("value")
    )
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")
    rows = F.transform(
        parts,
        lambda p, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("at"),
            F.length(p["gap"]).alias("gap"),
            F.length(p["whole"]).alias("size"),
            (mixed(p["value"]).cast("int") if kind == KEY else F.length(p["value"])).alias("value"),
        ),
    )
    # the last gap has no match after it
    found = F.filter(rows, lambda r: r["size"].isNotNull())
    return F.when(text.rlike(PATTERNS[kind]), found)


def parts(docs: DataFrame) -> DataFrame:
    """``row, doc_id, kind, start, end, value``; a text without any gives one row of nulls."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kind_type = "array<struct<kind:int,at:int,gap:int,size:int,value:int>>"
    lists = [F.coalesce(_matches(text, k), F.array()).cast(kind_type) for k in range(len(KINDS))]
    exploded = (
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
        .select("row", "doc_id", F.explode_outer(F.flatten(F.array(*lists))).alias("m"))
        .select("row", "doc_id", "m.*")
        .repartition("row")
    )
    running = (
        Window.partitionBy("row", "kind")
        .orderBy("at")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return exploded.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(running)).select(
        "row", "doc_id", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "value"
    )


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Keeps the strong parts and those weak ones whose complement lies within the scope."""
    kind, value = F.col("kind"), F.col("value")
    weak = ((kind == ASSIGN) & (value < SHORT)) | ((kind == KEY) & (value == 0))
    graded = found.select(
        "row",
        "doc_id",
        # what is no candidate stays as a row of nulls, so that no text is lost
        F.when(~weak, F.when((kind == ASSIGN) & (value < STRONG), KEY).otherwise(kind)).alias("kind"),
        *[F.when(~weak, F.col(c)).alias(c) for c in ("start", "end")],
    )
    strong = F.col("kind") <= HEX
    role = {
        "secret": F.col("kind").isin(ASSIGN, HEX, KEY),
        "id": F.col("kind").isin(ACCESS, IDENTIFIER),
        "place": F.col("kind") == ENDPOINT,
    }
    earlier = Window.unboundedPreceding, -1
    forth = Window.partitionBy("row").orderBy("start", "kind", "end").rowsBetween(*earlier)
    back = (
        Window.partitionBy("row")
        .orderBy(F.desc("start"), F.desc("kind"), F.desc("end"))
        .rowsBetween(*earlier)
    )
    near = {
        name: F.coalesce(F.col("start") - F.max(F.when(is_one, F.col("end"))).over(forth) <= scope, F.lit(False))
        | F.coalesce(F.min(F.when(is_one, F.col("start"))).over(back) - F.col("end") <= scope, F.lit(False))
        for name, is_one in role.items()
    }
    covered = F.coalesce(F.max(F.when(strong, F.col("end"))).over(forth) > F.col("start"), F.lit(False)) | F.coalesce(
        F.min(F.when(strong, F.col("start"))).over(back) < F.col("end"), F.lit(False)
    )
    marked = graded.withColumns({f"near_{n}": c for n, c in near.items()} | {"covered": covered})
    complement = (
        F.when(F.col("kind") == IDENTIFIER, F.col("near_secret"))
        .when(F.col("kind") == KEY, F.col("near_id") | F.col("near_place"))
        .otherwise(F.col("near_secret") & F.col("near_id"))
    )
    keep = F.col("kind").isNull() | strong | (~F.col("covered") & complement)
    # a text whose parts all go keeps a row of nulls
    return marked.select(
        "row",
        "doc_id",
        *[F.when(keep, F.col(c)).alias(c) for c in ("kind", "start", "end")],
    )


def spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id, kind, start, end`` of every reported span."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return (
        linked(parts(docs), scope)
        .where(F.col("kind").isNotNull())
        .select("doc_id", F.get(names, F.col("kind")).alias("kind"), "start", "end")
    )


def without(docs: DataFrame, scope: int = SCOPE, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``mask``."""
    names = docs.columns
    text = F.coalesce(docs["text"], F.lit(""))
    # spans depend on the text alone, so they come back by its digest
    by_text = docs.select(F.md5(text).alias("doc_id"), "text")
    found = linked(parts(by_text), scope).where(F.col("kind").isNotNull())
    # overlapping spans are one: a span starts a group if nothing before reaches it
    order = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = (
        found.withColumn("new", F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1)))
        .withColumn("grp", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("row", "doc_id", "grp")
        .agg(F.min("start").alias("a"), F.max("end").alias("b"))
    )
    # the kept pieces: from the end of a span to the start of the next
    pieces = merged.withColumn(
        "from", F.coalesce(F.lag("b").over(Window.partitionBy("row").orderBy("a")), F.lit(0))
    )
    lists = common.stash(
        pieces.groupBy("row", "doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("from", "a", "b"))).alias("_pieces"))
        .groupBy(F.col("doc_id").alias("_text"))
        .agg(F.first("_pieces").alias("_pieces")),
        "spans",
    )
    side = F.broadcast(lists) if lists.count() <= FEW else lists
    joined = docs.join(side, F.md5(text) == side["_text"], "left")
    found_in = side["_pieces"]
    body = F.concat(
        F.array_join(
            F.transform(
                found_in,
                lambda p: F.concat(
                    F.substring(text, (p["from"] + 1).cast("int"), (p["a"] - p["from"]).cast("int")),
                    F.lit(mask),
                ),
            ),
            "",
        ),
        F.substring(text, (F.element_at(found_in, -1)["b"] + 1).cast("int"), F.length(text)),
    )
    columns = {"text": F.when(found_in.isNull(), docs["text"]).otherwise(body)}
    if "n_chars" in names:
        columns["n_chars"] = F.when(found_in.isNull(), docs["n_chars"]).otherwise(
            F.length(body).cast("long")
        )
    return joined.select(*[columns.get(c, docs[c]).alias(c) for c in names])


def digest(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row of ``docs``."""
    names = F.array(*[F.lit(k) for k in KINDS])
    written = lambda items: F.array_join(
        F.transform(
            items,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
    found = linked(parts(docs), scope)
    one = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end"))
    return (
        found.groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            *[F.count_if(F.col("kind") == k).alias(f"n_{KINDS[k]}") for k in (ASSIGN, ACCESS, HEX)],
            F.sort_array(F.collect_list(one)).alias("all"),
        )
        .select(
            "doc_id",
            "n_assign",
            "n_access",
            "n_hex",
            F.sha2(written(F.filter("all", lambda s: s["kind"] <= HEX)), 256).alias("base_sha256"),
            written(F.col("all")).alias("spans"),
        )
    )


def _sql() -> str:
    quoted = [p.replace("'", "''") for p in PATTERNS]
    per_kind = "\nUNION ALL ".join(
        f"SELECT uid, {k} kind, i, length(gaps[i]) gap, length(ms[i]) size, "
        + (
            "(regexp_matches(ms[i], '[0-9]') AND regexp_matches(ms[i], '[A-Z]') AND regexp_matches(ms[i], '[a-z]'))::INT v "
            if k == KEY
            else "length(vs[i]) v "
        )
        + f"FROM (SELECT uid, gaps, ms, vs, unnest(range(1, len(ms) + 1)) i FROM (SELECT uid, string_split_regex(t, '{p}') gaps, "
        f"regexp_extract_all(t, '{p}', 0) ms, regexp_extract_all(t, '{p}', {2 if k in (ASSIGN, IDENTIFIER) else 0}) vs "
        f"FROM d WHERE regexp_matches(t, '{p}')))"
        for k, p in enumerate(quoted)
    )
    name = "['" + "','".join(KINDS) + "'][kind + 1]"
    near = ", ".join(
        f"(coalesce(s - max(CASE WHEN kind IN {ks} THEN e END) OVER f <= {SCOPE}, false) OR "
        f"coalesce(min(CASE WHEN kind IN {ks} THEN s END) OVER b - e <= {SCOPE}, false)) near_{n}"
        for n, ks in (("secret", "(0, 2, 4)"), ("id", "(1, 3)"), ("place", "(5)"))
    )
    return f"""
WITH d AS (SELECT row_number() OVER () uid, doc_id, coalesce(text, '') t FROM documents),
m AS ({per_kind}),
p AS (SELECT uid, kind, v, sum(gap + size) OVER (PARTITION BY uid, kind ORDER BY i) - size s,
  sum(gap + size) OVER (PARTITION BY uid, kind ORDER BY i) e FROM m),
g AS (SELECT uid, CASE WHEN kind = 0 AND v < {STRONG} THEN 4 ELSE kind END kind, s, e FROM p
  WHERE NOT (kind = 0 AND v < {SHORT}) AND NOT (kind = 4 AND v = 0)),
n AS (SELECT *, {near},
  coalesce(max(CASE WHEN kind <= 2 THEN e END) OVER f > s, false)
  OR coalesce(min(CASE WHEN kind <= 2 THEN s END) OVER b < e, false) covered
  FROM g WINDOW f AS (PARTITION BY uid ORDER BY s, kind, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  b AS (PARTITION BY uid ORDER BY s DESC, kind DESC, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT uid, kind, s, e, concat_ws(':', {name}, s, e) label FROM n
  WHERE kind <= 2 OR NOT covered AND CASE kind WHEN 3 THEN near_secret WHEN 4 THEN near_id OR near_place
  ELSE near_secret AND near_id END),
a AS (SELECT uid, count(*) FILTER (kind = 0) n_assign, count(*) FILTER (kind = 1) n_access,
  count(*) FILTER (kind = 2) n_hex, string_agg(label, ',' ORDER BY s, kind, e) FILTER (kind <= 2) base,
  string_agg(label, ',' ORDER BY s, kind, e) spans FROM k GROUP BY uid)
SELECT doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex,
  sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans FROM d LEFT JOIN a USING (uid)"""


ORACLE_SQL = _sql()

"""Audit chain, access log, topics, exports, streaming runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from linkweave import fixed
from linkweave.functions import web
from linkweave.operators import audit, metrics, reads
from linkweave.plans import derive as D
from linkweave.plans import registry
from linkweave.plans.catalog.registration import registrar
from linkweave.plans.oracle import CTES, with_ctes
from linkweave.session import shared_folder
from linkweave.sources import exports, tables, topics
from linkweave.plans.catalog.ledger import RESCORED
from linkweave.plans.catalog.texts import KIND_QUERIES
from linkweave.streaming import jobs

ENTRIES: dict = {}
entry = registrar(ENTRIES)

_ORDER = ["created_at", "order_id"]

CTES["entries0"] = (
    (),
    """SELECT 'u' || CAST(user_id AS VARCHAR) AS chain, row_number() OVER (PARTITION BY user_id
          ORDER BY ts, event_id) - 1 AS seq, CAST(event_id AS VARCHAR) AS resource_id,
          event_type AS action, CAST(json(props) AS VARCHAR) AS payload,
          sha256(CAST(json(props) AS VARCHAR)) AS payload_hash, epoch_us(ts) AS micros
        FROM events""",
)
_WALK = """, walk AS (SELECT chain, seq, resource_id, payload_hash, repeat('0', 64) AS prev_hash,
      sha256(CAST(seq AS VARCHAR) || chr(31) || repeat('0', 64) || chr(31) || chain || chr(31)
        || action || chr(31) || 'EVENT' || chr(31) || resource_id || chr(31) || payload_hash
        || chr(31) || CAST(micros AS VARCHAR)) AS entry_hash FROM entries0 WHERE seq = 0
    UNION ALL SELECT e.chain, e.seq, e.resource_id, e.payload_hash, w.entry_hash,
      sha256(CAST(e.seq AS VARCHAR) || chr(31) || w.entry_hash || chr(31) || e.chain || chr(31)
        || e.action || chr(31) || 'EVENT' || chr(31) || e.resource_id || chr(31)
        || e.payload_hash || chr(31) || CAST(e.micros AS VARCHAR))
      FROM walk w JOIN entries0 e ON e.chain = w.chain AND e.seq = w.seq + 1)"""


def _log(spark, d):
    return audit.append(D.audit_events(spark, d), _ORDER)


@entry(
    "audit_chain_entries",
    with_ctes(
        "entries0",
        _WALK + " SELECT chain, seq, resource_id, payload_hash, prev_hash, entry_hash FROM walk",
        recursive=True,
    ),
)
def audit_chain_entries(spark, d):
    return _log(spark, d).select(
        "chain", "seq", "resource_id", "payload_hash", "prev_hash", "entry_hash"
    )


@entry(
    "audit_chain_continued",
    with_ctes(
        "entries0",
        _WALK + " SELECT chain, seq, entry_hash FROM walk",
        recursive=True,
    ),
)
def audit_chain_continued(spark, d):
    """The log appended in two goes: events up to mid-January, then the rest."""
    events = D.audit_events(spark, d)
    early = F.col("created_at") < "2024-01-16"
    first = audit.append(events.where(early), _ORDER)
    second = audit.append(events.where(~early), _ORDER, first)
    return first.unionByName(second).select("chain", "seq", "entry_hash")


@entry(
    "audit_chain_heads",
    with_ctes(
        "entries0",
        _WALK + """ SELECT chain, arg_max(entry_hash, seq) AS head_hash, max(seq) AS head_seq,
          count(*) AS entries FROM walk GROUP BY chain""",
        recursive=True,
    ),
)
def audit_chain_heads(spark, d):
    return audit.heads(_log(spark, d))


@entry(
    "audit_chain_verified",
    with_ctes(
        "entries0",
        """SELECT chain, count(*) AS entries, count(*) AS entries_checked,
             CAST(NULL AS BIGINT) AS failed_seq, TRUE AS valid FROM entries0 GROUP BY chain""",
    ),
)
def audit_chain_verified(spark, d):
    return audit.verify(_log(spark, d)).drop("check")


@entry(
    "audit_chain_tampered",
    with_ctes(
        "entries0",
        """, c AS (SELECT chain, count(*) AS n, CAST(substr(chain, 2) AS BIGINT) % 7 AS k
             FROM entries0 GROUP BY chain),
           t AS (SELECT chain, n, k, CASE WHEN k = 5 THEN TRUE WHEN k = 4 THEN FALSE ELSE n > 5 END
             AS broken, CASE WHEN k = 3 AND n > 4 THEN n - 1 WHEN k = 5 THEN n + 1 ELSE n END
             AS entries FROM c)
           SELECT chain, entries, CASE WHEN NOT broken THEN entries WHEN k = 3 THEN 4
               WHEN k = 5 THEN n ELSE 5 END AS entries_checked,
             CASE WHEN broken THEN CASE WHEN k = 5 THEN n - 1 ELSE 5 END END AS failed_seq,
             CASE WHEN broken THEN CASE k WHEN 0 THEN 'payload_hash' WHEN 1 THEN 'entry_hash'
               WHEN 2 THEN 'prev_hash' WHEN 6 THEN 'entry_hash' ELSE 'sequence' END END AS check
           FROM t""",
    ),
)
def audit_chain_tampered(spark, d):
    """Chains broken six ways: payload, action or link of entry 5 edited, entry 4 removed, a
    second and sound last entry, and an edited entry 5 without a hash. Chains too short for
    it, and every seventh, stay valid."""
    k = F.pmod(F.substring("chain", 2, 20).cast("long"), F.lit(7))
    log = _log(spark, d)
    at5 = F.col("seq") == 5
    edited = (
        log.withColumn(
            "payload", F.when(at5 & (k == 0), '{"k":-1}').otherwise(F.col("payload")))
        .withColumn("action", F.when(at5 & k.isin(1, 6), "other").otherwise(F.col("action")))
        .withColumn(
            "prev_hash", F.when(at5 & (k == 2), "f" * 64).otherwise(F.col("prev_hash")))
        .withColumn("entry_hash", F.when(~(at5 & (k == 6)), F.col("entry_hash")))
        .where(~((F.col("seq") == 4) & (k == 3)))
    )
    last = log.groupBy("chain").agg(F.max("seq").alias("seq"))
    forged = (
        log.where(k == 5)
        .join(last, ["chain", "seq"], "left_semi")
        .withColumn("action", F.lit("forged"))
        .withColumn("entry_hash", audit.entry_hash())
    )
    return audit.verify(edited.unionByName(forged)).drop("valid")


@entry(
    "audit_timeline",
    with_ctes(
        "entries0",
        _WALK + """ SELECT w.chain, w.seq, w.resource_id, substr(w.entry_hash, 1, 16) AS entry_hash
          FROM walk w ORDER BY w.seq DESC, w.chain LIMIT 15""",
        recursive=True,
    ),
)
def audit_timeline(spark, d):
    return audit.timeline(_log(spark, d)).select("chain", "seq", "resource_id", "entry_hash")


@entry(
    "canonical_payloads",
    with_ctes(
        "entries0",
        """, p AS (SELECT resource_id, CASE CAST(resource_id AS BIGINT) % 4
             WHEN 1 THEN '{"a":"é' || resource_id || '","b":1.0,"c":[1,1e-07,-0.5]}'
             WHEN 2 THEN '{}' WHEN 3 THEN '"no json"' ELSE payload END AS payload FROM entries0)
           SELECT resource_id, payload, sha256(payload) AS payload_hash FROM p""",
    ),
)
def canonical_payloads(spark, d):
    """Payloads as stored, with floats and unsorted keys, blank, and no JSON at all."""
    k = F.pmod(F.col("order_id"), F.lit(4))
    floats = F.concat(
        F.lit('{"c": [1, 0.0000001, -5e-1], "b":1.0, "a": "\\u00e9'), F.col("resource_id"), F.lit('"}')
    )
    payload = F.when(k == 1, floats).when(k == 2, "").when(k == 3, "no json").otherwise(F.col("payload"))
    return D.audit_events(spark, d).select(
        "resource_id",
        audit.canonical_json(payload).alias("payload"),
        audit.payload_hash(payload).alias("payload_hash"),
    )


# --- access log ---------------------------------------------------------------------------------

_PATH = """CASE WHEN contains(path, '/api/v1/hypotheses/') AND contains(path, '/review')
    THEN '/api/v1/hypotheses/{id}/review' WHEN contains(path, '/api/v1/cases/')
    THEN '/api/v1/cases/{id}' WHEN contains(path, '/api/v1/actors/')
    THEN '/api/v1/actors/{id}' ELSE path END"""


@entry(
    "request_counters",
    with_ctes(
        "access_log",
        f"""SELECT method, {_PATH} AS path, status, count(*) AS requests,
              round(sum(duration), 2) AS seconds FROM access_log GROUP BY 1, 2, 3""",
    ),
)
def request_counters(spark, d):
    return metrics.request_counts(D.access_log(spark, d)).withColumn(
        "seconds", F.round("seconds", 2)
    )


@entry(
    "path_durations",
    with_ctes(
        "access_log",
        f"SELECT {_PATH} AS path, round(sum(duration), 2) AS seconds FROM access_log GROUP BY 1",
    ),
)
def path_durations(spark, d):
    return metrics.path_durations(D.access_log(spark, d)).withColumn(
        "seconds", F.round("seconds", 2)
    )


@entry(
    "action_counters",
    with_ctes("access_log", "SELECT action, count(*) AS events FROM access_log GROUP BY action"),
)
def action_counters(spark, d):
    return metrics.action_counts(D.access_log(spark, d))


@entry(
    "hourly_requests",
    with_ctes(
        "access_log",
        f"""SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, {_PATH} AS path,
              count(*) AS requests FROM access_log GROUP BY 1, 2""",
    ),
)
def hourly_requests(spark, d):
    return metrics.hourly_counts(D.access_log(spark, d)).select(
        F.unix_micros("hour").alias("hour_us"), "path", "requests"
    )


@entry(
    "normalised_paths",
    with_ctes("access_log", f"SELECT event_id, {_PATH} AS path FROM access_log"),
)
def normalised_paths(spark, d):
    return D.access_log(spark, d).select("event_id", web.normal_path("path").alias("path"))


# --- topics and exports -----------------------------------------------------------------------------


@entry(
    "topic_messages",
    """SELECT 'stream:page_collected' AS topic, id, '{"url":"' || url || '"}' AS payload FROM (
         SELECT lpad(CAST(page_id AS VARCHAR), 12, '0') AS id, url FROM pages ORDER BY id LIMIT 10)""",
)
def topic_messages(spark, d):
    """Pages published to their topic, the first ten read back."""
    root = f"{shared_folder(spark)}/topics-{uuid.uuid4().hex}"
    pages = D.table(spark, d, "pages").select(
        F.lpad(D.text("page_id"), 12, "0").alias("id"), "url",
        F.lit("2024-01-01 00:00:00").alias("at"),
    )
    topics.publish(topics.messages(pages, fixed.TOPICS[0], "id", "at", "url"), root)
    return topics.consume(topics.read(spark, root), fixed.TOPICS[0], 10).select(
        "topic", "id", "payload"
    )


def _detail(spark, d):
    return reads.link_items(
        D.hypothesis_evidence(spark, d), D.withdrawn_evidence(spark, d), D.artifacts(spark, d)
    )


@entry(
    "evidence_csv_export",
    with_ctes(
        "hyp_items retracted evidence artifacts",
        """SELECT l.evidence_id, l.family, coalesce(e.source_uri, 'Unknown') AS source_uri,
             coalesce(e.value, 'N/A') AS value, round(l.contribution, 4) AS contribution,
             CASE WHEN l.is_contradiction THEN 'true' ELSE 'false' END AS is_contradiction,
             a.sha256
           FROM hyp_items l LEFT JOIN evidence e ON l.evidence_id = e.evidence_id
           LEFT JOIN artifacts a ON e.artifact_id = a.artifact_id
           WHERE l.evidence_id NOT IN (SELECT evidence_id FROM retracted)""",
    ),
)
def evidence_csv_export(spark, d):
    """The export written as gzipped CSV and read back."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    exports.write_evidence_csv(_detail(spark, d), path, "gzip")
    return spark.read.option("header", True).csv(path).selectExpr(
        "`Evidence ID` AS evidence_id", "`Family` AS family", "`Source URI` AS source_uri",
        "`Value` AS value", "round(CAST(`Contribution` AS DOUBLE), 4) AS contribution",
        "`Is Contradiction` AS is_contradiction", "`SHA256 Hash` AS sha256",
    )


@entry(
    "link_bundles",
    with_ctes(
        "hypotheses actors aliases",
        """, names AS (SELECT actor_id, value, min(alias_id) AS alias_id FROM aliases GROUP BY ALL)
           SELECT hypothesis_id AS bundle_of, 'threat-actor--' || subject_id AS actor_ref,
             'identity--' || object_id AS target_ref, s.primary_alias AS known_as,
             CAST(trunc(calibrated_prob * 100) AS INTEGER) AS confidence, 4 AS objects
           FROM hypotheses h JOIN actors s ON subject_id = s.actor_id
           UNION ALL SELECT alias_id, 'threat-actor--' || actor_id, NULL, value, NULL, 1 FROM names
           WHERE actor_id IN (SELECT subject_id FROM hypotheses)""",
    ),
)
def link_bundles(spark, d):
    links = reads.with_actor_names(D.hypotheses(spark, d), D.actors(spark, d))
    out = exports.link_bundles(links, D.aliases(spark, d), "2024-01-01T00:00:00Z")
    shape = "struct<objects: array<struct<id: string, source_ref: string, confidence: int, aliases: array<string>>>>"
    rows = out.select("bundle_of", F.from_json("bundle", shape)["objects"].alias("o"))  # parsed once
    at = lambda n, f: F.get("o", F.lit(n))[f]
    either = lambda f: F.coalesce(at(1, f), at(0, f))
    return rows.select(
        "bundle_of",
        either("id").alias("actor_ref"),
        at(3, "source_ref").alias("target_ref"),
        F.array_join(either("aliases"), "|").alias("known_as"),
        at(3, "confidence").alias("confidence"),
        F.size("o").alias("objects"),
    )


@entry(
    "profile_export",
    with_ctes(
        "actors aliases pgp_keys wallets accounts",
        """SELECT section, count(*) AS records, sum(n) AS items FROM (
             SELECT actor_id, 'aliases' AS section, count(*) AS n FROM aliases GROUP BY 1
             UNION ALL SELECT actor_id, 'pgp_keys', count(*) FROM pgp_keys
               WHERE actor_id IS NOT NULL GROUP BY 1
             UNION ALL SELECT actor_id, 'wallets', count(*) FROM wallets GROUP BY 1
             UNION ALL SELECT actor_id, 'accounts', count(*) FROM accounts GROUP BY 1)
           WHERE actor_id IN (SELECT actor_id FROM actors) GROUP BY section""",
    ),
)
def profile_export(spark, d):
    """Profiles written as JSON lines, read back and counted."""
    path = f"{shared_folder(spark)}/profiles-{uuid.uuid4().hex}"
    sections = reads.profile_sections(
        D.aliases(spark, d), D.pgp_keys(spark, d), D.wallets(spark, d), D.accounts(spark, d)
    )
    exports.write_profiles(D.actors(spark, d), sections, path)
    back = spark.read.schema("actor_id string, section string, items array<string>").json(path)
    return back.where("section IS NOT NULL").groupBy("section").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.size("items")).alias("items")
    )


@entry(
    "evolved_table",
    """SELECT 'w-' || CAST(s_suppkey AS VARCHAR) AS wallet_id, s_suppkey % 2 = 0 AS is_new,
         CASE WHEN s_suppkey % 2 = 0 THEN 'checked' END AS note FROM supplier""",
)
def evolved_table(spark, d):
    """Old rows without a column beside new rows that have it."""
    w = D.table(spark, d, "supplier")
    even = F.pmod("s_suppkey", F.lit(2)) == 0
    shape = F.concat(F.lit("w-"), D.text("s_suppkey")).alias("wallet_id")
    old = w.where(~even).select(shape, even.alias("is_new"))
    new = w.where(even).select(shape, even.alias("is_new"), F.lit("checked").alias("note"))
    return tables.evolve(old, new.schema).unionByName(new)


@entry(
    "named_reads",
    with_ctes(
        "actors hypotheses",
        """SELECT 'list_actors' AS name, least(100, (SELECT count(*) FROM actors)) AS n_rows
           UNION ALL SELECT 'get_review_queue', least(10, (SELECT count(*) FROM hypotheses
             WHERE status = 'PROPOSED'))
           UNION ALL SELECT 'get_actor_links', (SELECT count(*) + count(*) FILTER
             (WHERE subject_id <> object_id) FROM hypotheses)""",
    ),
)
def named_reads(spark, d):
    """Three of the registered reads asked by name."""
    from functools import reduce

    t = D.ledger(spark, d) | {"hypotheses": D.hypotheses(spark, d)}
    parts = [
        registry.ask(t, name).agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("name"), "n_rows")
        for name in ("list_actors", "get_review_queue", "get_actor_links")
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


# --- streaming runs ---------------------------------------------------------------------------------------


def _fresh(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@entry(
    "streaming_ingest",
    with_ctes(
        "accepted",
        """SELECT min(observation_id) AS observation_id, sha256 FROM accepted GROUP BY sha256""",
    ),
)
def streaming_ingest(spark, d):
    """All observations written as files and streamed in."""
    root = _fresh(spark)
    D.raw_observations(spark, d).write.parquet(f"{root}/in")
    stream = jobs.read_files(spark, f"{root}/in", jobs.OBSERVATION_SCHEMA)
    jobs.ingest(stream, f"{root}/ledger", f"{root}/cp").awaitTermination()
    return spark.read.schema("observation_id string, sha256 string").parquet(
        f"{root}/ledger/observations"
    ).select("observation_id", "sha256")


@entry(
    "streaming_counters",
    with_ctes(
        "access_log",
        f"""SELECT method, {_PATH} AS path, status, count(*) AS requests
            FROM access_log GROUP BY 1, 2, 3""",
    ),
)
def streaming_counters(spark, d):
    root = _fresh(spark)
    D.access_log(spark, d).write.parquet(f"{root}/in")
    schema = spark.read.parquet(f"{root}/in").schema
    log = jobs.read_files(spark, f"{root}/in", schema, 2)
    jobs.running_counters(log, root, f"{root}/cp").awaitTermination()
    return jobs.current_counters(spark, root).select("method", "path", "status", "requests")


@entry(
    "streaming_chain_append",
    with_ctes(
        "entries0",
        _WALK + " SELECT chain, seq, entry_hash FROM walk",
        recursive=True,
    ),
)
def streaming_chain_append(spark, d):
    root = _fresh(spark)
    D.audit_events(spark, d).write.parquet(f"{root}/in")
    schema = spark.read.parquet(f"{root}/in").schema
    events = spark.readStream.schema(schema).parquet(f"{root}/in")
    jobs.chain_append(events, _ORDER, root, f"{root}/cp").awaitTermination()
    return spark.read.schema(jobs.LOG_SCHEMA).parquet(f"{root}/entries").select(
        "chain", "seq", "entry_hash"
    )


_SHARED_PAGES = " UNION ALL ".join(KIND_QUERIES)


@entry(
    "streaming_pipeline",
    f"""WITH texts AS (SELECT CAST(page_id AS VARCHAR) AS text_id, coalesce(html, '') || ' u'
          || CAST(page_id % 97 AS VARCHAR) || '@mail.example.org @user_'
          || CAST(page_id % 13 AS VARCHAR) AS body FROM pages),
        found AS ({_SHARED_PAGES}),
        shared AS (SELECT kind, value FROM found GROUP BY 1, 2 HAVING count(DISTINCT text_id) > 1),
        e AS (SELECT DISTINCT lower(kind) || '::' || value AS name, 'page::' || text_id AS page
          FROM found JOIN shared USING (kind, value))
        SELECT 'node' AS element, name AS id, NULL AS source, NULL AS target FROM e GROUP BY name
        UNION ALL SELECT 'node', page, NULL, NULL FROM e GROUP BY page
        UNION ALL SELECT 'edge', page || '->' || name, page, name FROM e""",
)
def streaming_pipeline(spark, d):
    """All pages, each with an address and a handle put behind it, streamed to the graph."""
    root = _fresh(spark)
    n = lambda k: F.pmod("page_id", F.lit(k)).cast("string")
    pages = D.table(spark, d, "pages").select(
        F.lit(fixed.TOPICS[0]).alias("topic"),
        D.text("page_id").alias("id"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("timestamp"),
        F.to_json(
            F.struct(
                F.concat(
                    F.coalesce("html", F.lit("")), F.lit(" u"), n(97),
                    F.lit("@mail.example.org @user_"), n(13),
                ).alias("html")
            )
        ).alias("payload"),
    )
    topics.publish(pages, f"{root}/pages")
    jobs.pipeline(topics.read_stream(spark, f"{root}/pages"), root, f"{root}/cp")
    get = lambda f: F.get_json_object("payload", f"$.{f}").alias(f)
    last = topics.read(spark, f"{root}/projected").where(F.col("topic") == fixed.TOPICS[3])
    return last.select(get("element"), "id", get("source"), get("target"))


@entry(
    "streaming_rescoring",
    with_ctes(
        "hypotheses active_items",
        RESCORED + """ WHERE h.hypothesis_id IN (SELECT hypothesis_id FROM hyp_items
            WHERE evidence_id IN (SELECT evidence_id FROM retracted))""",
    ),
)
def streaming_rescoring(spark, d):
    """The retraction requests streamed in three batches against the stored links."""
    root = _fresh(spark)
    asked = D.retraction_requests(spark, d)
    asked.repartition(3, "evidence_id").write.parquet(f"{root}/in")
    stored = {"items": D.hypothesis_evidence(spark, d), "links": D.hypotheses(spark, d)}
    for name, rows in stored.items():
        rows.write.parquet(f"{root}/{name}")
    items, links = (spark.read.parquet(f"{root}/{n}") for n in stored)
    evidence = D.stored_evidence(spark, d)
    jobs.stored_sums(items, evidence).write.parquet(f"{root}/sums")
    stream = jobs.read_files(spark, f"{root}/in", asked.schema, 1)
    jobs.rescoring(stream, evidence, items, links, spark.read.parquet(f"{root}/sums"), root, f"{root}/cp")
    return jobs.rescored_links(spark, root)

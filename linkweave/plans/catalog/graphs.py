"""Graph, transactions, walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkweave.functions import text
from linkweave.operators import finance, graph, spectral
from linkweave.plans import derive as D
from linkweave.plans.catalog.registration import registrar, rounded
from linkweave.plans.oracle import CTES, with_ctes
from linkweave.session import stored

ENTRIES: dict = {}
entry = registrar(ENTRIES)

# --- transactions -----------------------------------------------------------------------

# components by rounds of smallest labels: exact once a round changes nothing, and the graph of
# orders and parts is a few steps wide
_ROUNDS = 12
_STARS = (
    """named AS (SELECT list_filter(inputs, lambda x: x <> '') AS ins FROM tx),
  stars AS (SELECT ins[1] AS a, unnest(ins[2:]) AS b FROM named WHERE len(ins) > 1),
  arcs AS MATERIALIZED (SELECT a, b FROM stars WHERE a <> b UNION SELECT b, a FROM stars WHERE a <> b
    UNION SELECT a, a FROM stars UNION SELECT b, b FROM stars),
  r0 AS MATERIALIZED (SELECT DISTINCT a AS node, a AS root FROM arcs), """
    + ", ".join(
        f"r{k} AS MATERIALIZED (SELECT a AS node, min(root) AS root FROM arcs JOIN r{k - 1} ON b = node "
        "GROUP BY a)"
        for k in range(1, _ROUNDS + 1)
    )
    + f""", comp AS (SELECT node, root FROM r{_ROUNDS}),
  seen AS (SELECT DISTINCT address FROM (SELECT unnest(list_concat(inputs, outputs)) AS address FROM tx)
    WHERE address <> ''),
  clusters AS (SELECT address, 'cluster_btc_' || coalesce(root, address) AS cluster_id
    FROM seen LEFT JOIN comp ON address = node)"""
)


@entry(
    "owner_clusters",
    with_ctes("tx", f", {_STARS} SELECT address, cluster_id FROM clusters", recursive=True),
)
def owner_clusters(spark, d):
    return finance.owner_clusters(D.transactions(spark, d))


@entry(
    "owner_cluster_sizes",
    with_ctes(
        "tx",
        f""", {_STARS} SELECT cluster_id, count(*) AS n_addresses FROM clusters
            GROUP BY cluster_id HAVING count(*) > 1""",
        recursive=True,
    ),
)
def owner_cluster_sizes(spark, d):
    return finance.owner_clusters(D.transactions(spark, d)).groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n_addresses")
    ).where("n_addresses > 1")


def _levels(n: int) -> str:
    """Breadth-first levels, each address with its first parent."""
    parts = [
        "hop AS (SELECT txid, tx_order, i AS src, o AS dst, p AS place FROM (SELECT *, "
        "unnest(outputs) AS o, generate_subscripts(outputs, 1) AS p FROM tx), unnest(inputs) u(i))",
        "l0 AS (SELECT min(inputs[1]) AS node, [0] AS path FROM tx)",
    ]
    seen = "SELECT node FROM l0"
    for k in range(1, n + 1):
        parts.append(
            f"l{k} AS (SELECT dst AS node, first(src ORDER BY p) AS from_address, "
            f"first(txid ORDER BY p) AS txid, min(p) AS path FROM (SELECT h.dst, h.src, h.txid, "
            f"list_concat(l.path, [h.tx_order, h.place]) AS p FROM l{k - 1} l JOIN hop h "
            f"ON h.src = l.node WHERE h.dst NOT IN ({seen})) GROUP BY dst)"
        )
        seen += f" UNION ALL SELECT node FROM l{k}"
    return ", ".join(parts)


_TRACE = " UNION ALL ".join(
    f"SELECT from_address, node AS to_address, txid, {k} AS hop_depth, regexp_matches(node, "
    f"'mixer|tumbler|coinjoin|chipmixer|blender|wasabi|samourai') AS is_mixer_hop FROM l{k}"
    for k in range(1, 6)
)


def _transactions(spark, d):
    """The transactions, derived once and written for queries that read them more than once."""
    return stored(D.transactions(spark, d).select("txid", "tx_order", "inputs", "outputs"))


def _start(tx):
    return stored(tx.selectExpr("inputs[0] AS a").agg(F.min("a").alias("start")))


@entry("hop_trace", with_ctes("tx", f", {_levels(5)} {_TRACE}"))
def hop_trace(spark, d):
    """Money trace from the smallest first input over five hops."""
    tx = _transactions(spark, d)
    return finance.trace_hops(tx, _start(tx), 5).drop("start")


@entry(
    "hop_trace_summary",
    with_ctes(
        "tx",
        f""", {_levels(5)} SELECT count(*) + 1 AS total_addresses_reached,
             count(*) FILTER (WHERE is_mixer_hop) AS mixer_touchpoints_found FROM ({_TRACE})""",
    ),
)
def hop_trace_summary(spark, d):
    tx = _transactions(spark, d)
    start = _start(tx)
    return finance.trace_summary(start, finance.trace_hops(tx, start, 5)).drop(
        "start", "deepest_hop"
    )


_RISKY = ["a10", "wasabi", "a1000"]


@entry(
    "cluster_risk",
    with_ctes(
        "tx",
        ", m AS (SELECT unnest(list_concat(inputs, outputs)) AS address FROM tx), f AS ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS cluster_id, (SELECT count(DISTINCT address) FROM m WHERE "
            f"contains(address, '{c}') OR starts_with(address, 'cluster_')) AS total_addresses"
            for c in _RISKY
        )
        + """), x AS (SELECT count(*) AS k FROM m WHERE regexp_matches(address,
             'mixer|tumbler|coinjoin|wasabi'))
           SELECT cluster_id, total_addresses, round((SELECT sum(amount) FROM tx), 2)
             AS estimated_volume, k AS mixer_exposure_count,
             round(least(1.0, k * 0.35 + total_addresses * 0.05), 2)::DOUBLE AS risk_score,
             CASE WHEN least(1.0, k * 0.35 + total_addresses * 0.05) > 0.6 THEN 'HIGH'
               WHEN least(1.0, k * 0.35 + total_addresses * 0.05) > 0.3 THEN 'MEDIUM' ELSE 'LOW'
             END AS risk_level FROM f CROSS JOIN x""",
    ),
)
def cluster_risk(spark, d):
    return finance.cluster_risk(D.transactions(spark, d), _RISKY).withColumn(
        "estimated_volume", F.round("estimated_volume", 2)
    )


@entry(
    "wallet_pair_evidence",
    with_ctes(
        "tx",
        f""", {_STARS}, p AS (SELECT txid AS id, inputs[1] AS a, CASE tx_order % 5 WHEN 0
              THEN inputs[1] WHEN 1 THEN '' ELSE inputs[len(inputs)] END AS b FROM tx)
            SELECT id, CASE WHEN a = '' OR b = '' THEN 'EMPTY' WHEN a = b
                THEN 'DIRECT_ADDRESS_REUSE' WHEN x.cluster_id = y.cluster_id
                THEN 'UTXO_CO_INPUT_CLUSTER_MATCH' ELSE 'NO_MATCH' END AS match_type,
              CASE WHEN a = '' OR b = '' OR a = b THEN 0.95 ELSE 0.9 END::DOUBLE AS m_i,
              a = '' OR b = '' OR (a <> b AND x.cluster_id IS DISTINCT FROM y.cluster_id)
                AS abstain
            FROM p LEFT JOIN clusters x ON a = x.address LEFT JOIN clusters y ON b = y.address""",
        recursive=True,
    ),
)
def wallet_pair_evidence(spark, d):
    tx = _transactions(spark, d)
    k = F.pmod("tx_order", F.lit(5))
    pairs = tx.select(
        F.col("txid").alias("id"),
        F.col("inputs")[0].alias("address_a"),
        F.when(k == 0, F.col("inputs")[0]).when(k == 1, "").otherwise(
            F.element_at("inputs", -1)
        ).alias("address_b"),
    )
    return finance.pair_evidence(pairs, finance.owner_clusters(tx)).select(
        "id", "match_type", "m_i", "abstain"
    )


@entry(
    "private_coin_grades",
    """SELECT doc_id, regexp_full_match(address, '[48][0-9a-zA-B]{94,105}') AS
          valid_stealth_address, regexp_full_match(address, '[48][0-9a-zA-B]{94,105}')
          AND starts_with(address, '8') AS is_subaddress, ring_size,
          CASE WHEN ring_size >= 16 THEN 0.95 WHEN ring_size >= 11 THEN 0.85
            WHEN ring_size > 0 THEN 0.4 ELSE 0.1 END::DOUBLE AS privacy_score,
          CASE WHEN ring_size >= 16 THEN 'LOW' WHEN ring_size >= 11 THEN 'MEDIUM'
            WHEN ring_size > 0 THEN 'HIGH' ELSE 'CRITICAL' END AS decoy_risk_level
        FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '4' WHEN 1 THEN '8' ELSE '5' END
            || substr(sha256(text) || sha256(text), 1, 94) AS address,
          CAST(doc_id % 20 AS INTEGER) AS ring_size FROM documents)""",
)
def private_coin_grades(spark, d):
    h = F.sha2("text", 256)
    lead = F.when(F.pmod("doc_id", F.lit(3)) == 0, "4").when(
        F.pmod("doc_id", F.lit(3)) == 1, "8").otherwise("5")
    rows = D.table(spark, d, "documents").select(
        "doc_id", F.concat(lead, F.substring(F.concat(h, h), 1, 94)).alias("address"),
        F.pmod("doc_id", F.lit(20)).cast("int").alias("ring_size"),
        F.lit("").alias("key_image"),
    )
    return finance.classify_private_coin(rows).select(
        "doc_id", "valid_stealth_address", "is_subaddress", "ring_size", "privacy_score",
        "decoy_risk_level",
    )


# --- property graph -------------------------------------------------------------------------

_KNOWN = """known AS (SELECT * FROM hypotheses WHERE subject_id IN (SELECT actor_id FROM actors)
    AND object_id IN (SELECT actor_id FROM actors))"""
_LEDGER = "actors aliases pgp_keys wallets services hypotheses"


@entry(
    "graph_nodes",
    with_ctes(
        _LEDGER,
        """SELECT actor_id AS id, primary_alias AS label, 'Actor' AS type, category AS detail
             FROM actors
           UNION ALL SELECT alias_id, value, 'Alias', platform FROM aliases
             WHERE actor_id IN (SELECT actor_id FROM actors)
           UNION ALL SELECT key_row_id, key_id, 'PGPKey', fingerprint FROM pgp_keys
           UNION ALL SELECT wallet_id, address, 'Wallet', coalesce(cluster_id, 'Unclustered')
             FROM wallets
           UNION ALL SELECT service_id, coalesce(title, 'Onion Service'), 'OnionService',
             CAST(coalesce(favicon_hash, 0) AS VARCHAR) FROM services""",
    ),
)
def graph_nodes(spark, d):
    return graph.project(D.ledger(spark, d), D.hypotheses(spark, d))[0]


_PROJECTED = f"""{_KNOWN}, pe AS (
    SELECT 'uses:' || alias_id AS id, actor_id AS src, alias_id AS dst, 'ACTOR_USES_ALIAS' AS label,
      confidence FROM aliases WHERE actor_id IN (SELECT actor_id FROM actors)
    UNION ALL SELECT 'pgp:' || key_row_id, actor_id, key_row_id, 'ACCOUNT_USES_PGP', 0.99
      FROM pgp_keys WHERE actor_id IN (SELECT actor_id FROM actors)
    UNION ALL SELECT 'wallet:' || wallet_id, actor_id, wallet_id, 'ACCOUNT_USES_WALLET', 0.9
      FROM wallets WHERE actor_id IN (SELECT actor_id FROM actors)
    UNION ALL SELECT 'hyp:' || hypothesis_id, subject_id, object_id,
      'ACTOR_POSSIBLY_SAME_AS_ACTOR', calibrated_prob FROM known)"""


@entry(
    "graph_edges",
    with_ctes(
        _LEDGER,
        f""", {_PROJECTED} SELECT id, src, dst, label, round(confidence, 4)::DOUBLE AS confidence
            FROM pe""",
    ),
)
def graph_edges(spark, d):
    edges = graph.project(D.ledger(spark, d), D.hypotheses(spark, d))[1]
    return edges.withColumn("confidence", F.round("confidence", 4))


@entry(
    "graph_projection_counts",
    with_ctes(
        _LEDGER,
        f""", {_PROJECTED} SELECT label AS figure, count(*) AS n FROM pe GROUP BY label
            UNION ALL SELECT 'Actor', count(*) FROM actors UNION ALL SELECT 'Alias', count(*)
            FROM aliases WHERE actor_id IN (SELECT actor_id FROM actors) UNION ALL
            SELECT 'PGPKey', count(*) FROM pgp_keys UNION ALL SELECT 'Wallet', count(*)
            FROM wallets UNION ALL SELECT 'OnionService', count(*) FROM services""",
    ),
)
def graph_projection_counts(spark, d):
    """The projection written as two tables, read back and counted."""
    import uuid

    from linkweave.session import shared_folder
    from linkweave.sources import exports

    root = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    nodes, edges = exports.write_graph(D.ledger(spark, d), D.hypotheses(spark, d), root)
    return graph.projection_counts(nodes, edges)


_MAP = f"""{_KNOWN},
  al AS (SELECT *, lower(trim(value)) AS nv FROM aliases
    WHERE actor_id IN (SELECT actor_id FROM actors)),
  wl AS (SELECT * FROM wallets WHERE cluster_id IS NOT NULL
    AND actor_id IN (SELECT actor_id FROM actors)),
  hs AS (SELECT nv, count(DISTINCT actor_id) AS n, first(value ORDER BY alias_id) AS label
    FROM al GROUP BY nv),
  cs AS (SELECT cluster_id, count(DISTINCT actor_id) AS n, count(*) AS k,
    string_agg(DISTINCT chain, ', ' ORDER BY chain) AS chains FROM wl GROUP BY cluster_id)"""


@entry(
    "shared_map_nodes",
    with_ctes(
        _LEDGER,
        f""", {_MAP} SELECT actor_id AS id, 'Actor' AS type, 0 AS shared_by, category AS detail
              FROM actors
            UNION ALL SELECT 'handle::' || nv, 'SharedHandle', n, NULL FROM hs WHERE n > 1
            UNION ALL SELECT 'wallet::' || cluster_id, 'SharedWallet', n, k || ' addresses / '
              || chains FROM cs WHERE n > 1""",
    ),
)
def shared_map_nodes(spark, d):
    nodes, _ = graph.shared_map(D.ledger(spark, d), D.hypotheses(spark, d))
    return nodes.select("id", "type", "shared_by", "detail")


_MAP_EDGES = """SELECT 'e_h_' || alias_id AS id, actor_id AS src, 'handle::' || nv AS dst,
      'USES_HANDLE' AS label FROM al WHERE nv IN (SELECT nv FROM hs WHERE n > {n})
    UNION ALL SELECT DISTINCT 'e_w_' || cluster_id || '_' || actor_id, actor_id,
      'wallet::' || cluster_id, 'CONTROLS_WALLET_CLUSTER' FROM wl
      WHERE cluster_id IN (SELECT cluster_id FROM cs WHERE n > {n})
    UNION ALL SELECT 'hyp_' || hypothesis_id, subject_id, object_id, status FROM known"""


@entry("shared_map_edges", with_ctes(_LEDGER, f", {_MAP} {_MAP_EDGES.format(n=1)}"))
def shared_map_edges(spark, d):
    _, edges = graph.shared_map(D.ledger(spark, d), D.hypotheses(spark, d))
    return edges.select("id", "src", "dst", "label")


@entry(
    "shared_map_with_singletons",
    with_ctes(
        _LEDGER,
        f""", {_MAP} SELECT (SELECT count(*) FROM actors) AS actors,
              (SELECT count(*) FROM actors) + (SELECT count(*) FROM hs) + (SELECT count(*) FROM cs)
              + (SELECT count(*) FROM pgp_keys WHERE actor_id IS NOT NULL) AS nodes,
              (SELECT count(*) FROM ({_MAP_EDGES.format(n=0)}))
              + (SELECT count(*) FROM pgp_keys WHERE actor_id IS NOT NULL) AS edges""",
    ),
)
def shared_map_with_singletons(spark, d):
    return graph.map_stats(
        *graph.shared_map(D.ledger(spark, d), D.hypotheses(spark, d), include_singletons=True)
    )


_EGO = f"""{_KNOWN},
  dl AS (SELECT subject_id AS ego, object_id AS other, * FROM known UNION ALL
    SELECT object_id, subject_id, * FROM known WHERE subject_id <> object_id)"""


@entry(
    "ego_nodes",
    with_ctes(
        _LEDGER,
        f""", {_EGO}, n AS (SELECT actor_id AS ego, actor_id AS id, 'Actor' AS type FROM actors
              UNION ALL SELECT actor_id, alias_id, 'Alias' FROM aliases
              UNION ALL SELECT actor_id, key_row_id, 'PGPKey' FROM pgp_keys
                WHERE actor_id IS NOT NULL
              UNION ALL SELECT actor_id, wallet_id, 'Wallet' FROM wallets
              UNION ALL SELECT ego, other, 'LinkedActor' FROM dl)
            SELECT ego, id, min(type) AS type FROM n GROUP BY ego, id""",
    ),
)
def ego_nodes(spark, d):
    nodes, _ = graph.ego_views(D.ledger(spark, d), D.hypotheses(spark, d))
    return nodes.select("ego", "id", "type")


@entry(
    "ego_edges",
    with_ctes(
        _LEDGER,
        f""", {_EGO}, nb AS (SELECT DISTINCT ego, other FROM dl)
            SELECT actor_id AS ego, 'edge_' || alias_id AS id, actor_id AS src, alias_id AS dst
              FROM aliases
            UNION ALL SELECT actor_id, 'edge_' || key_row_id, actor_id, key_row_id FROM pgp_keys
              WHERE actor_id IS NOT NULL
            UNION ALL SELECT actor_id, 'edge_' || wallet_id, actor_id, wallet_id FROM wallets
            UNION ALL (SELECT ego, 'hyp_' || hypothesis_id, subject_id, object_id FROM dl
            UNION SELECT a.ego, 'hyp_' || k.hypothesis_id, k.subject_id, k.object_id FROM known k
              JOIN nb a ON k.subject_id = a.other JOIN nb b ON k.object_id = b.other
                AND a.ego = b.ego WHERE k.subject_id <> k.object_id)""",
    ),
)
def ego_edges(spark, d):
    _, edges = graph.ego_views(D.ledger(spark, d), D.hypotheses(spark, d))
    return edges.select("ego", "id", "src", "dst")


@entry(
    "peer_links",
    with_ctes(
        "hypotheses actors",
        f""", {_EGO}, nb AS (SELECT DISTINCT ego, other FROM dl WHERE ego <> other)
            SELECT DISTINCT a.ego, k.hypothesis_id FROM known k JOIN nb a ON k.subject_id = a.other
            JOIN nb b ON k.object_id = b.other AND a.ego = b.ego
            WHERE k.subject_id <> k.object_id""",
    ),
)
def peer_links(spark, d):
    return graph.peer_links(D.hypotheses(spark, d), D.actors(spark, d))


@entry(
    "edges_ranked_per_node",
    with_ctes(
        _LEDGER,
        f""", {_PROJECTED} SELECT node, peer, label, round(confidence, 4)::DOUBLE AS confidence,
              row_number() OVER (PARTITION BY node ORDER BY confidence DESC, id) AS position
            FROM (SELECT src AS node, dst AS peer, id, label, confidence FROM pe UNION ALL
              SELECT dst, src, id, label, confidence FROM pe WHERE src <> dst)""",
    ),
)
def edges_ranked_per_node(spark, d):
    _, edges = graph.project(D.ledger(spark, d), D.hypotheses(spark, d))
    return graph.ranked_edges(edges).select(
        "node", "peer", "label", rounded("confidence", 4), "position"
    )


@entry(
    "closed_neighbourhood",
    with_ctes(
        _LEDGER,
        f""", {_PROJECTED}, nn AS (SELECT actor_id AS id, primary_alias AS label, category AS detail
              FROM actors UNION ALL SELECT alias_id, value, platform FROM aliases
              UNION ALL SELECT key_row_id, key_id, fingerprint FROM pgp_keys
              UNION ALL SELECT wallet_id, address, coalesce(cluster_id, 'Unclustered') FROM wallets
              UNION ALL SELECT service_id, coalesce(title, 'Onion Service'),
                CAST(coalesce(favicon_hash, 0) AS VARCHAR) FROM services),
            hits AS (SELECT id FROM nn WHERE contains(lower(label), 'bolt')
              OR contains(lower(detail), 'bolt'))
            SELECT id, TRUE AS matched FROM hits UNION ALL SELECT DISTINCT id, FALSE FROM (
              SELECT dst AS id FROM pe WHERE src IN (SELECT id FROM hits) UNION ALL
              SELECT src FROM pe WHERE dst IN (SELECT id FROM hits))
            WHERE id NOT IN (SELECT id FROM hits)""",
    ),
)
def closed_neighbourhood(spark, d):
    nodes, edges = graph.project(D.ledger(spark, d), D.hypotheses(spark, d))
    return graph.closed_neighbourhood(nodes, edges, "bolt").select("id", "matched")


# --- walks, contexts, embeddings ----------------------------------------------------------------


def _draw(*salt: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('/', {', '.join(salt)})), 1, 15) AS BIGINT)"


CTES["numbered"] = (
    ("ends",),
    f"""SELECT src, dst, deg, row_number() OVER (PARTITION BY src ORDER BY {_draw("dst")} %
          CAST(ceil(deg / {graph.SLAB}) AS BIGINT), dst) - 1 AS idx FROM (SELECT *, count(*) OVER
          (PARTITION BY src) AS deg FROM (SELECT subject_id AS src, object_id AS dst FROM ends
          WHERE subject_id <> object_id UNION SELECT object_id, subject_id FROM ends
          WHERE subject_id <> object_id))""",
)


def _walked(walks: int, length: int, p: float = 1.0, q: float = 1.0, seed: int = 42) -> str:
    """Walks as a recursion: a row is a walker with its last draw; refused draws stay put."""
    key = (f"'{seed}'", "walk_id", "step", "attempt")
    weight = f"CASE WHEN m.dst = w.prev THEN {1 / p} WHEN k.dst IS NOT NULL THEN 1.0 ELSE {1 / q} END"
    luck = f"({_draw(*key, repr('accept'))} % 1000003 + 1) / 1000004.0"
    top = max(1.0, 1 / p, 1 / q)
    accept = f"(w.prev IS NULL OR m.deg = 1 OR {luck} * {top} < {weight})"
    if p == q == 1.0:
        accept, seen = "TRUE", ""
    else:
        seen = "LEFT JOIN numbered k ON k.src = w.prev AND k.dst = m.dst"
    return f""", degree AS (SELECT DISTINCT src, deg FROM numbered),
      w AS (SELECT src || '#' || n AS walk_id, src AS node, CAST(NULL AS VARCHAR) AS prev, 1 AS step,
          0 AS attempt, [src] AS path FROM degree, unnest(range(1, {walks + 1})) u(n)
        UNION ALL SELECT walk_id, CASE WHEN ok THEN dst ELSE node END, CASE WHEN ok THEN node ELSE prev
          END, CASE WHEN ok THEN step + 1 ELSE step END, CASE WHEN ok THEN 0 ELSE attempt + 1 END,
          CASE WHEN ok THEN list_append(path, dst) ELSE path END FROM (
            SELECT w.*, m.dst, {accept} AS ok FROM w JOIN degree g ON g.src = w.node
            JOIN numbered m ON m.src = w.node AND m.idx = {_draw(*key)} % g.deg {seen}
            WHERE step < {length})),
      walked AS (SELECT walk_id, path FROM w WHERE step = {length} AND attempt = 0)"""


_SHOWN = " SELECT walk_id, len(path) AS steps, array_to_string(path, '>') AS path FROM walked"


def _shown(walks):
    return walks.select(
        "walk_id", F.size("path").alias("steps"), F.array_join("path", ">").alias("path")
    )


@entry("random_walks", with_ctes("numbered", _walked(10, 20) + _SHOWN, recursive=True))
def random_walks(spark, d):
    return _shown(graph.random_walks(D.actor_edges(spark, d)))


@entry(
    "random_walks_weighted",
    with_ctes("numbered", _walked(10, 20, 4.0, 0.5, 7) + _SHOWN, recursive=True),
)
def random_walks_weighted(spark, d):
    """Walks that avoid turning back and stay near, in the second-order sense."""
    return _shown(graph.random_walks(D.actor_edges(spark, d), p=4.0, q=0.5, seed=7))


def _token_walks(spark, d):
    t = D.table(spark, d, "conversations")
    return t.select(text.tokens("text").alias("path")).where(F.size("path") > 0)


CTES["contexts"] = (
    (),
    r"""SELECT l[i] AS node, l[j] AS context FROM (SELECT regexp_extract_all(lower(text),
          '[\p{L}\p{N}_]+') AS l FROM conversations), unnest(range(1, len(l) + 1)) a(i),
          unnest(range(greatest(1, i - 3), least(len(l), i + 3) + 1)) b(j) WHERE i <> j""",
)


@entry(
    "walk_context_pairs",
    with_ctes("contexts", "SELECT node, context, count(*) AS n FROM contexts GROUP BY ALL"),
)
def walk_context_pairs(spark, d):
    """Contexts within three steps, with the words of each turn as a given walk."""
    return graph.context_pairs(_token_walks(spark, d)).groupBy("node", "context").agg(
        F.count(F.lit(1)).alias("n")
    )


def _embedded(contexts: str) -> str:
    dims = ", ".join(
        f"round(sum(CASE WHEN i = {i} THEN x END) / any_value(norm), 6)::DOUBLE AS d{i}" for i in range(64)
    )
    return f""", c AS (SELECT node, context, count(*) AS n, CAST('0x' || substr(md5(context), 1, 16)
          AS UBIGINT) AS h FROM {contexts} GROUP BY node, context),
        s AS (SELECT node, i, sum(n * (2 * CAST((h >> i) & 1 AS BIGINT) - 1)) AS x
          FROM c, unnest(range(0, 64)) r(i) GROUP BY node, i),
        z AS (SELECT node, nullif(sqrt(sum(x * x)), 0) AS norm FROM s GROUP BY node)
        SELECT s.node, {dims} FROM s JOIN z ON s.node = z.node GROUP BY s.node"""


def _dims(embedded):
    return embedded.select("node", *[F.round(F.col("vector")[i], 6).alias(f"d{i}") for i in range(64)])


@entry("walk_embeddings", with_ctes("contexts", _embedded("contexts")))
def walk_embeddings(spark, d):
    return _dims(graph.embed(_token_walks(spark, d)))


@entry(
    "actor_embeddings",
    with_ctes(
        "numbered",
        _walked(10, 20)
        + """, around AS (SELECT path[i] AS node, path[j] AS context FROM walked,
            unnest(range(1, len(path) + 1)) a(i),
            unnest(range(greatest(1, i - 3), least(len(path), i + 3) + 1)) b(j) WHERE i <> j)"""
        + _embedded("around"),
        recursive=True,
    ),
)
def actor_embeddings(spark, d):
    """Walks over the actor graph turned into vectors."""
    return _dims(graph.embed(graph.random_walks(D.actor_edges(spark, d))))


_PMI = """, k AS (SELECT node, context, count(*) AS n FROM contexts GROUP BY ALL),
        r AS (SELECT node, sum(n) AS n FROM k GROUP BY node),
        m AS (SELECT * FROM (SELECT k.node, k.context, ln(k.n::DOUBLE * (SELECT sum(n) FROM k)::DOUBLE
            / (a.n::DOUBLE * b.n::DOUBLE)) AS weight
          FROM k JOIN r a ON k.node = a.node JOIN r b ON k.context = b.node) WHERE weight > 0)"""


@entry(
    "context_information",
    with_ctes("contexts", _PMI + " SELECT node, context, round(weight, 9) AS weight FROM m"),
)
def context_information(spark, d):
    """Words that meet within three steps more often than by chance."""
    pairs = graph.context_pairs(_token_walks(spark, d))
    return spectral.positive_pmi(pairs).withColumn("weight", F.round("weight", 9))


@entry(
    "power_iteration_step",
    with_ctes(
        "contexts",
        _PMI
        + f""", v AS (SELECT node, i, 2 * CAST((h >> i) & 1 AS BIGINT) - 1 AS x FROM (SELECT node,
            CAST('0x' || substr(md5(node || '/0'), 1, 16) AS UBIGINT) AS h FROM r),
            unnest(range(0, 64)) u(i)),
          y AS (SELECT m.node, i, sum(weight * x) AS x FROM m JOIN v ON m.context = v.node GROUP BY ALL)
          SELECT r.node, {", ".join(f"round(coalesce(sum(x) FILTER (WHERE i = {i}), 0), 6) + 0.0 AS d{i}" for i in range(64))}
          FROM r LEFT JOIN y ON r.node = y.node GROUP BY r.node""",
    ),
)
def power_iteration_step(spark, d):
    """The first product of the fit: the matrix times the start vectors."""
    matrix = spectral.positive_pmi(graph.context_pairs(_token_walks(spark, d)))
    nodes = _token_walks(spark, d).select(F.explode("path").alias("node"), "path").where(
        F.size("path") > 1
    ).select("node").distinct()
    out = spectral.product(matrix, spectral.start(nodes))
    return _dims(out.withColumnRenamed("v", "vector"))


@entry("fitted_actor_embeddings", None)
def fitted_actor_embeddings(spark, d):
    """Walks over the actor graph, vectors fitted to them."""
    walks = graph.random_walks(D.actor_edges(spark, d))
    # a short walk makes a hundred pairs: walks are dealt by number, not by their few bytes
    walks = walks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _dims(spectral.fit(graph.context_pairs(walks)))


@entry(
    "node_pair_evidence",
    with_ctes(
        "vectors",
        """, p AS (SELECT vec_id AS a, 'v' || lpad(CAST(n + 1 AS VARCHAR), 8, '0') AS b
             FROM vectors)
           SELECT p.a, p.b, y.vec_id IS NULL AS abstain,
             round(list_cosine_similarity(x.embedding, y.embedding), 4) AS cosine_similarity,
             round(list_distance(x.embedding, y.embedding), 4) AS euclidean_distance,
             round((list_cosine_similarity(x.embedding, y.embedding) + 1) / 2, 4)
               AS link_probability,
             coalesce(list_cosine_similarity(x.embedding, y.embedding) >= 0.7, FALSE)
               AS link_detected,
             CASE WHEN y.vec_id IS NULL THEN 0.8 WHEN round(list_cosine_similarity(x.embedding,
               y.embedding), 4) >= 0.85 THEN 0.9 WHEN round(list_cosine_similarity(x.embedding,
               y.embedding), 4) >= 0.65 THEN 0.75 ELSE 0.2 END::DOUBLE AS m_i
           FROM p LEFT JOIN vectors x ON p.a = x.vec_id LEFT JOIN vectors y ON p.b = y.vec_id""",
    ),
)
def node_pair_evidence(spark, d):
    """Each vector's node with the next; the last has no partner and abstains."""
    v = D.vectors(spark, d)
    pairs = v.select(
        F.col("vec_id").alias("a"),
        F.concat(F.lit("v"), F.lpad((F.col("n") + 1).cast("string"), 8, "0")).alias("b"),
    )
    emb = v.selectExpr("vec_id AS node", "embedding AS vector")
    return graph.score_pairs(pairs, emb).select(
        "a", "b", "abstain", "cosine_similarity", "euclidean_distance", "link_probability",
        "link_detected", "m_i",
    )

"""Common table expressions of the derived inputs, in plain SQL for the oracle.

They are written apart from the DataFrame code: windows where that uses aggregates,
cross products where that uses joins, so agreement means something.
"""

from __future__ import annotations

from linkweave import fixed
from linkweave.operators.evidence import PRIOR_COLUMNS, prior_values_sql

_ITEM = (
    "CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || "
    "CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || '-' || "
    "strftime(l_shipdate, '%Y-%m-%d')"
)
_FEATURE = (
    "CASE l_partkey % 40 WHEN 37 THEN 'temporal_impossible_overlap' WHEN 38 THEN "
    "'pgp_key_conflict' WHEN 39 THEN 'unlisted_feature' ELSE list_extract(["
    + ", ".join(f"'{r[0]}'" for r in fixed.FEATURE_PRIORS)
    + "], CAST((l_partkey % 40) % 11 + 1 AS INTEGER)) END"
)
_CAPS = ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in fixed.FAMILY_CAPS.items())

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "priors": ((), f"SELECT * FROM (VALUES {prior_values_sql()}) AS t({PRIOR_COLUMNS})"),
    "caps": ((), f"SELECT * FROM (VALUES {_CAPS}) AS t(family, cap)"),
    "evidence_rows": (
        (),
        f"""SELECT CAST(l_orderkey AS VARCHAR) AS link_id, {_ITEM} AS id,
            {_FEATURE} AS feature_name,
            CASE WHEN l_tax >= 0.08 THEN CAST(3.0 AS DOUBLE) END AS llr, l_quantity < 6 AS abstain,
            1.0 - l_discount AS source_reliability, 1.0 - l_tax AS credibility_multiplier
            FROM lineitem""",
    ),
    "items": (
        ("priors", "evidence_rows"),
        """SELECT r.link_id, r.id, r.feature_name,
            coalesce(p.prior_family, 'CONTENT_NLP') AS family,
            coalesce(p.prior_group, r.id) AS dependence_group,
            CASE WHEN p.prior_m IS NOT NULL THEN p.prior_m ELSE CAST(0.9 AS DOUBLE) END AS m_i,
            CASE WHEN p.prior_u IS NOT NULL THEN p.prior_u ELSE CAST(0.01 AS DOUBLE) END AS u_i,
            r.llr, p.prior_weight IS NOT NULL AS is_contradiction,
            coalesce(p.prior_weight, CAST(0 AS DOUBLE)) AS contradiction_weight, r.abstain,
            CASE WHEN p.prior_weight IS NOT NULL THEN CAST(1 AS DOUBLE)
                 ELSE r.source_reliability END AS source_reliability,
            CASE WHEN p.prior_weight IS NOT NULL THEN CAST(1 AS DOUBLE)
                 ELSE r.credibility_multiplier END AS credibility_multiplier
            FROM evidence_rows r LEFT JOIN priors p ON r.feature_name = p.feature_name""",
    ),
    "effective": (
        ("items",),
        """SELECT *, NOT abstain AND NOT is_contradiction AS counts,
            CASE WHEN abstain OR is_contradiction THEN CAST(0 AS DOUBLE) ELSE
              coalesce(llr, ln(greatest(m_i, 1e-12) / greatest(u_i, 1e-12)))
              * greatest(0.0, least(1.0, source_reliability * credibility_multiplier)) END AS eff
            FROM items""",
    ),
    "ranked": (
        ("effective",),
        """SELECT *, row_number() OVER (PARTITION BY link_id, family, dependence_group
              ORDER BY eff DESC, id) AS rn FROM effective WHERE counts""",
    ),
    "discounted": (
        ("ranked",),
        """SELECT *, CASE WHEN rn = 1 THEN eff ELSE 0.25 * eff END AS part,
              rn > 1 AS is_discounted FROM ranked""",
    ),
    "family_sums": (
        ("discounted", "caps"),
        """SELECT d.link_id, d.family, sum(d.part) AS f_sum, max(c.cap) AS cap,
              least(sum(d.part), max(c.cap)) AS score
            FROM discounted d JOIN caps c ON d.family = c.family GROUP BY d.link_id, d.family""",
    ),
    "contribs": (
        ("effective", "discounted", "family_sums"),
        """SELECT e.link_id, e.id AS evidence_id, e.feature_name, e.family, e.dependence_group,
              e.eff AS raw_llr, e.source_reliability,
              CASE WHEN e.counts THEN d.part * CASE WHEN f.f_sum > f.cap THEN f.cap / f.f_sum
                    ELSE 1.0 END
                   WHEN e.is_contradiction AND NOT e.abstain THEN -e.contradiction_weight
                   ELSE 0.0 END AS llr_contrib,
              coalesce(d.is_discounted, FALSE) AS is_discounted,
              e.counts AND coalesce(f.f_sum > f.cap, FALSE) AS is_capped,
              e.is_contradiction, e.abstain
            FROM effective e
            LEFT JOIN discounted d ON e.id = d.id AND e.link_id = d.link_id
            LEFT JOIN family_sums f ON e.link_id = f.link_id AND e.family = f.family""",
    ),
    "fused": (
        ("effective", "family_sums"),
        """SELECT e.link_id, sum(e.eff) AS raw_llr, sum(CASE WHEN e.is_contradiction AND NOT e.abstain
                THEN e.contradiction_weight ELSE 0 END) AS contradiction_penalty,
              count(*) FILTER (WHERE e.abstain) AS abstained_items, count(*) AS total_items,
              coalesce(max(f.total), 0.0) AS total_capped_llr,
              coalesce(max(f.positive), 0) AS independent_families,
              coalesce(max(f.present), '') AS families_present
            FROM effective e LEFT JOIN (
              SELECT link_id, sum(score) AS total, count(*) FILTER (WHERE score > 0) AS positive,
                string_agg(family, ',' ORDER BY family) AS present
              FROM family_sums GROUP BY link_id) f ON e.link_id = f.link_id
            GROUP BY e.link_id""",
    ),
    "evaluated": (
        ("fused",),
        """SELECT *, CASE WHEN contradiction_penalty > 0 OR final_llr < 0
              THEN 'CONTRADICTION_REJECTED' WHEN posterior_probability >= 0.85
              THEN 'HIGH_CONFIDENCE_LINK' WHEN posterior_probability >= 0.5
              THEN 'LOW_CONFIDENCE_LINK' ELSE 'INSUFFICIENT_EVIDENCE' END AS decision
            FROM (SELECT *, 1.0 / (1.0 + exp(-greatest(-50.0, least(50.0, final_llr - 2.0))))
                AS posterior_probability
              FROM (SELECT *, total_capped_llr - contradiction_penalty AS final_llr FROM fused))""",
    ),
    "ends": (
        (),
        """SELECT CAST(o_orderkey AS VARCHAR) AS link_id, 'A' || CAST(o_custkey AS VARCHAR)
              AS subject_id, 'A' || CAST((CASE WHEN o_orderkey % 3 = 0 THEN o_custkey * 7 + 1
              ELSE o_custkey + o_orderkey % 3 END) % (SELECT count(*) FROM customer) AS VARCHAR)
              AS object_id, o_orderdate AS created_at FROM orders""",
    ),
    "hypotheses": (
        ("evaluated", "ends"),
        """SELECT 'H' || v.link_id AS hypothesis_id, e.subject_id, e.object_id,
              round(v.final_llr, 4) AS raw_log_lr,
              round(v.posterior_probability, 4) AS calibrated_prob,
              CASE v.decision WHEN 'HIGH_CONFIDENCE_LINK' THEN 'ACCEPTED'
                WHEN 'LOW_CONFIDENCE_LINK' THEN 'PROPOSED' ELSE 'INSUFFICIENT' END AS status,
              v.decision, e.created_at
            FROM evaluated v JOIN ends e ON v.link_id = e.link_id""",
    ),
    "hyp_items": (
        ("contribs",),
        """SELECT 'HE-' || evidence_id AS id, 'H' || link_id AS hypothesis_id, evidence_id, family,
              round(raw_llr, 4) AS raw_llr, round(llr_contrib, 4) AS contribution,
              source_reliability AS reliability_weight, is_contradiction FROM contribs""",
    ),
    "evidence": (
        (),
        f"""SELECT {_ITEM} AS evidence_id, 'art-' || CAST(l_partkey AS VARCHAR) AS artifact_id,
              'ledger://orders/' || CAST(l_orderkey AS VARCHAR) AS source_uri,
              {_FEATURE} AS extraction_method,
              'part ' || CAST(l_partkey AS VARCHAR) || ' supplier ' || CAST(l_suppkey AS VARCHAR)
                AS value, 1.0 - l_discount AS confidence,
              'G' || CAST(l_suppkey AS VARCHAR) AS dependence_group, l_shipdate AS created_at
            FROM lineitem""",
    ),
    "retraction_requests": (
        (),
        f"""SELECT {_ITEM} AS evidence_id, 'u' || CAST(l_suppkey AS VARCHAR) AS requested_by,
              'returned' AS reason, 1 AS request_no, l_shipdate AS requested_at FROM lineitem
            WHERE l_returnflag = 'R' AND month(l_shipdate) = 12
            UNION ALL
            SELECT {_ITEM}, 'u' || CAST(l_partkey AS VARCHAR), 'repeated', 2,
              l_shipdate + INTERVAL 1 DAY FROM lineitem
            WHERE l_returnflag = 'R' AND month(l_shipdate) = 12 AND l_tax = 0.0""",
    ),
    "retracted": (
        ("retraction_requests",),
        "SELECT DISTINCT evidence_id FROM retraction_requests",
    ),
    "active_items": (
        ("hyp_items", "evidence", "retracted"),
        """SELECT h.* FROM hyp_items h JOIN evidence e ON h.evidence_id = e.evidence_id
            WHERE h.evidence_id NOT IN (SELECT evidence_id FROM retracted)""",
    ),
    "reviews": (
        (),
        """SELECT 'R' || CAST(o_orderkey AS VARCHAR) || '-1' AS review_id,
              'H' || CAST(o_orderkey AS VARCHAR) AS hypothesis_id,
              CASE o_orderkey % 3 WHEN 0 THEN 'ACCEPT' WHEN 1 THEN 'REJECT' ELSE 'INSUFFICIENT' END
                AS decision, 'u' || CAST(o_custkey % 50 AS VARCHAR) AS reviewer_id,
              o_orderdate AS reviewed_at FROM orders WHERE o_orderpriority LIKE '1-%'
            UNION ALL
            SELECT 'R' || CAST(o_orderkey AS VARCHAR) || '-2', 'H' || CAST(o_orderkey AS VARCHAR),
              'REJECT', 'u7', o_orderdate + INTERVAL 2 DAY
            FROM orders WHERE o_orderpriority LIKE '1-%' AND o_orderkey % 4 = 0""",
    ),
    "users": (
        (),
        """SELECT 'u' || CAST(c_custkey AS VARCHAR) AS user_id,
              lower(replace(c_name, '#', '.')) || '@example.org' AS email,
              CASE WHEN c_custkey % 9 = 0 THEN 'ADMIN' ELSE 'ANALYST' END AS role
            FROM customer""",
    ),
    "identifier_requests": (
        (),
        """SELECT 'ID' || CAST(o_orderkey AS VARCHAR) AS identifier_id,
              'C' || CAST(o_custkey % 30 AS VARCHAR) AS case_id,
              CASE WHEN o_custkey % 3 = 0 THEN 'handle' ELSE 'wallet' END AS id_type,
              CASE WHEN o_orderkey % 17 = 0 THEN '  ' ELSE ' x' || CAST(o_custkey // 40 AS VARCHAR)
                || ' ' END AS value, 'u' || CAST(o_custkey % 50 AS VARCHAR) AS added_by,
              o_orderdate AS created_at FROM orders""",
    ),
    "actors": (
        (),
        """SELECT 'A' || CAST(c_custkey AS VARCHAR) AS actor_id, c_name AS primary_alias,
              c_mktsegment AS category, (c_custkey % 97) / 100.0 AS confidence,
              CASE WHEN c_custkey % 9 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00'
                + to_days(CAST(c_custkey % 365 AS INTEGER)) END AS last_seen FROM customer""",
    ),
    "aliases": (
        (),
        """SELECT 'al-' || CAST(c_custkey AS VARCHAR) || '-0' AS alias_id,
              'A' || CAST(c_custkey AS VARCHAR) AS actor_id, c_name AS value,
              'registry' AS platform, 'customer' AS source, CAST(0.95 AS DOUBLE) AS confidence
            FROM customer
            UNION ALL
            SELECT 'al-' || CAST(o_custkey AS VARCHAR) || '-' || p_name,
              'A' || CAST(o_custkey AS VARCHAR),
              CASE WHEN o_custkey % 2 = 0 THEN upper(p_name) ELSE p_name END, 'market', 'orders',
              CAST(0.80 AS DOUBLE)
            FROM (SELECT DISTINCT o_custkey, p_name FROM orders JOIN lineitem
              ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey)""",
    ),
    "accounts": (
        (),
        """SELECT 'ac-' || CAST(c_custkey AS VARCHAR) AS account_id,
              'A' || CAST(c_custkey AS VARCHAR) AS actor_id, lower(c_mktsegment) AS platform,
              'acct_' || CAST(c_custkey AS VARCHAR) AS handle FROM customer""",
    ),
    "pgp_keys": (
        (),
        """SELECT 'k-' || CAST(c_custkey AS VARCHAR) AS key_row_id,
              upper(substr(sha256(c_name), 1, 40)) AS fingerprint,
              substr(upper(substr(sha256(c_name), 1, 40)), 25, 16) AS key_id,
              CASE WHEN c_custkey % 5 <> 0 THEN 'A' || CAST(c_custkey AS VARCHAR) END AS actor_id
            FROM customer WHERE c_custkey % 3 = 0""",
    ),
    "wallets": (
        (),
        """SELECT 'w-' || CAST(s_suppkey AS VARCHAR) AS wallet_id,
              'addr' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS address,
              CASE s_suppkey % 3 WHEN 0 THEN 'BTC' WHEN 1 THEN 'ETH' ELSE 'XMR' END AS chain,
              CASE WHEN s_suppkey % 11 <> 0 THEN 'CL_' || CAST(s_nationkey AS VARCHAR) END
                AS cluster_id,
              'A' || CAST(s_suppkey // 2 AS VARCHAR) AS actor_id
            FROM supplier""",
    ),
    "services": (
        (),
        r"""SELECT 's-' || CAST(page_id AS VARCHAR) AS service_id,
              regexp_extract(url, '^https?://([^/]+)', 1) AS address,
              CASE WHEN page_id % 7 <> 0 THEN 'Page ' || CAST(page_id AS VARCHAR) END AS title,
              CASE WHEN page_id % 4 <> 0 THEN CAST((page_id * 31) % 97 AS INTEGER) END
                AS favicon_hash,
              CASE WHEN page_id % 3 = 0 THEN sha256(CAST(page_id % 60 AS VARCHAR)) END
                AS tls_fingerprint FROM pages""",
    ),
    "servers": (
        (),
        """SELECT 'sv-' || CAST(s_suppkey AS VARCHAR) AS server_id,
              '10.' || CAST(s_nationkey AS VARCHAR) || '.' || CAST(s_suppkey // 250 AS VARCHAR)
                || '.' || CAST(s_suppkey % 250 AS VARCHAR) AS ip_address,
              'AS' || CAST(s_nationkey + 64500 AS VARCHAR) AS asn, s_name AS provider
            FROM supplier""",
    ),
    "artifacts": (
        (),
        """SELECT 'art-' || CAST(doc_id AS VARCHAR) AS artifact_id, sha256(text) AS sha256,
              CAST(strlen(text) AS BIGINT) AS size,
              'doc://' || source || '/' || CAST(doc_id AS VARCHAR) AS storage_uri
            FROM documents""",
    ),
    "cases": (
        (),
        """SELECT 'C' || CAST(n_nationkey AS VARCHAR) AS case_id, n_name AS title,
              CASE WHEN n_nationkey % 4 = 0 THEN 'CLOSED' ELSE 'OPEN' END AS status,
              'Region ' || CAST(n_regionkey AS VARCHAR) AS description,
              TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST((n_nationkey * 5) % 17 AS INTEGER))
                AS created_at FROM nation""",
    ),
    "raw_observations": (
        (),
        """SELECT 'obs-' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS observation_id,
              text AS raw_content, source AS source_name,
              CASE doc_id % 4 WHEN 0 THEN 'PASSIVE_ONION' WHEN 1 THEN 'FORUM_CRAWL'
                WHEN 2 THEN 'HONEYPOT' ELSE 'SYNTHETIC' END AS source_type,
              CASE (doc_id // 3) % 4 WHEN 0 THEN 'passive_osint' WHEN 1 THEN 'synthetic_seed'
                WHEN 2 THEN 'honeypot' ELSE 'unstated' END AS lawful_basis,
              'doc://' || source AS source_uri FROM documents""",
    ),
    "accepted": (
        ("raw_observations",),
        """SELECT *, sha256(raw_content) AS sha256 FROM raw_observations
            WHERE lawful_basis IN ('passive_osint', 'synthetic_seed', 'honeypot')
              AND length(raw_content) BETWEEN 1 AND 200000""",
    ),
    "texts": (
        (),
        """SELECT text_id, body || ' ' || CASE n % 7
              WHEN 0 THEN upper(substr(h, 1, 40))
              WHEN 1 THEN '1' || substr(translate(h || h, '0', 'g'), 1, 33)
              WHEN 2 THEN '0x' || substr(h, 1, 40)
              WHEN 3 THEN '4A' || substr(translate(h || h, '0', 'g'), 1, 93)
              WHEN 4 THEN substr(translate(h || h, '0189', 'wxyz'), 1, 56) || '.onion'
              WHEN 5 THEN 'u' || CAST(n AS VARCHAR) || '@mail.example.org'
              ELSE '@user_' || CAST(n AS VARCHAR) END AS body
            FROM (SELECT *, sha256(body) AS h FROM (
              SELECT 'd' || CAST(doc_id AS VARCHAR) AS text_id, doc_id AS n, text AS body
              FROM documents UNION ALL
              SELECT 'p' || CAST(page_id AS VARCHAR), page_id, html FROM pages))""",
    ),
    "access_log": (
        (),
        """SELECT event_id, ts, CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST'
              ELSE 'GET' END AS method,
              CASE event_type WHEN 'purchase' THEN '/api/v1/hypotheses/' || CAST(user_id AS VARCHAR)
                || '/review' WHEN 'signup' THEN '/api/v1/cases/' || CAST(user_id AS VARCHAR)
                WHEN 'error' THEN '/health'
                ELSE '/api/v1/actors/' || CAST(user_id AS VARCHAR) END AS path,
              CASE WHEN value > 100 THEN 500 WHEN value > 50 THEN 404 ELSE 200 END AS status,
              value AS duration, event_type AS action FROM events""",
    ),
    "tx": (
        (),
        """SELECT 'tx' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS txid,
              o_orderkey AS tx_order,
              CASE WHEN o_orderkey % 7 = 0 THEN list_prepend('', ps) ELSE ps END AS inputs,
              [addr(o_custkey + 10000000), addr(z_p + 1)] AS outputs, o_totalprice AS amount
            FROM orders JOIN (SELECT l_orderkey, last(p ORDER BY n) AS z_p,
                list(addr(p) ORDER BY n) FILTER (again = 1) AS ps FROM (SELECT l_orderkey,
                  l_partkey AS p, row_number() OVER w AS n, row_number() OVER (PARTITION BY
                    l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey) AS again FROM lineitem
                  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
              GROUP BY l_orderkey) l ON o_orderkey = l_orderkey""",
    ),
    "vectors": (
        (),
        """SELECT 'v' || lpad(CAST(vec_id AS VARCHAR), 8, '0') AS vec_id, vec_id AS n,
              [CAST(embedding[i] AS DOUBLE) + CASE WHEN i - 1 = label THEN 1.4 ELSE 0.0 END
                FOR i IN range(1, len(embedding) + 1)] AS embedding FROM embeddings""",
    ),
    "document_pairs": ((), "SELECT doc_id AS left_id, doc_id + 1 AS right_id FROM documents"),
    "turn_pairs": (
        (),
        """SELECT CAST(a.conv_id AS VARCHAR) || '-' || CAST(a.turn AS VARCHAR) AS pair_id,
              a.text AS text_a, b.text AS text_b FROM conversations a JOIN conversations b
              ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
    ),
    "activity_pairs": (
        (),
        """SELECT 'u' || CAST(a AS VARCHAR) AS a, 'u' || CAST(b AS VARCHAR) AS b FROM (
              SELECT DISTINCT user_id AS a, user_id + 1 AS b FROM events UNION ALL
              SELECT DISTINCT user_id, user_id * 2 FROM events WHERE user_id > 1)""",
    ),
    "neighbours": (
        (),
        """SELECT DISTINCT 'A' || CAST(o_custkey AS VARCHAR) AS entity,
              'P' || CAST(l_partkey AS VARCHAR) AS neighbour
            FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    ),
    "tokens": (
        (),
        r"""SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token
            FROM documents""",
    ),
    "word_table": (
        (),
        "SELECT * FROM (VALUES "
        + ", ".join(
            "({}, '{}')".format(i, w.replace("'", "''")) for i, w in enumerate(fixed.FUNCTION_WORDS)
        )
        + ") AS t(pos, word)",
    ),
}


def _addr(arg: str) -> str:
    return (
        f"CASE WHEN ({arg}) % 101 = 0 THEN 'a' || CAST({arg} AS VARCHAR) || '_wasabi' "
        f"ELSE 'a' || CAST({arg} AS VARCHAR) END"
    )


def _expand_addr(sql: str) -> str:
    import re

    return re.sub(r"addr\(([^()]*)\)", lambda m: _addr(m.group(1)), sql)


def with_ctes(names: str, body: str, recursive: bool = False) -> str:
    """``body`` preceded by the named expressions and what they need, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in CTES[name][0]:
            visit(need)
        order.append(name)

    for name in names.split():
        visit(name)
    parts = [f"{n} AS ({_expand_addr(CTES[n][1])})" for n in order]
    head = "WITH RECURSIVE " if recursive else "WITH "
    if not parts:
        return (head + body) if recursive else body
    joiner = ",\n" if body.lstrip().startswith("--cte") else "\n"
    return head + ",\n".join(parts) + joiner + body.replace("--cte", "", 1)


_CHAIN = ("effective", "ranked", "discounted", "family_sums", "contribs", "fused", "evaluated")


def scoring_chain(source: str, suffix: str) -> None:
    """Register the scoring expressions once more over another item table."""
    import re

    names = {n: f"{n}_{suffix}" for n in _CHAIN} | {"items": source}
    pattern = re.compile(r"\b(" + "|".join(names) + r")\b")
    for n in _CHAIN:
        needs, sql = CTES[n]
        CTES[names[n]] = (
            tuple(names.get(x, x) for x in needs),
            pattern.sub(lambda m: names[m.group(1)], sql),
        )


_F = "[" + ", ".join(f"'{r[0]}'" for r in fixed.FEATURE_PRIORS) + "]"
CTES["link_list"] = (
    (),
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS link_id,
          [list_extract({_F}, CAST(o_orderkey % 11 + 1 AS INTEGER)),
           list_extract({_F}, CAST((o_orderkey // 11) % 11 + 1 AS INTEGER)), 'no_such_feature']
            AS features,
          CASE WHEN o_orderkey % 10 = 0 THEN ['pgp_key_conflict'] ELSE [] END AS contradictions,
          CASE WHEN o_custkey % 3 = 0 THEN [list_extract({_F}, CAST(o_custkey % 11 + 1 AS INTEGER))]
            ELSE [] END AS abstained FROM orders""",
)
CTES["link_items"] = (
    ("link_list", "priors"),
    """SELECT l.link_id, l.link_id || '-' || CAST(l.pos AS VARCHAR) AS id, l.feature_name,
          CASE WHEN conflict THEN 'EXACT_IDENTITY' ELSE p.prior_family END AS family,
          CASE WHEN conflict THEN 'contradiction_' || l.feature_name ELSE p.prior_group END
            AS dependence_group, coalesce(p.prior_m, 0.9) AS m_i, coalesce(p.prior_u, 0.01) AS u_i,
          CAST(NULL AS DOUBLE) AS llr, conflict AS is_contradiction,
          coalesce(p.prior_weight, 0.0) AS contradiction_weight, quiet AS abstain,
          CAST(1 AS DOUBLE) AS source_reliability, CAST(1 AS DOUBLE) AS credibility_multiplier
        FROM (SELECT link_id, features[i] AS feature_name, i - 1 AS pos, FALSE AS conflict,
                FALSE AS quiet FROM link_list, unnest(range(1, len(features) + 1)) r(i)
              UNION ALL SELECT link_id, contradictions[i], len(features) + i - 1, TRUE, FALSE
              FROM link_list, unnest(range(1, len(contradictions) + 1)) r(i)
              UNION ALL SELECT link_id, abstained[i], len(features) + len(contradictions) + i - 1,
                FALSE, TRUE FROM link_list, unnest(range(1, len(abstained) + 1)) r(i)) l
        JOIN priors p ON l.feature_name = p.feature_name
        WHERE conflict = (p.prior_weight IS NOT NULL)""",
)
scoring_chain("link_items", "batch")

CTES["eval_cases"] = (
    (),
    """SELECT d.doc_id AS case_id, l.quality AS truth, (d.n_chars - 2000) / 500.0 AS final_llr,
          1.0 / (1.0 + exp(-greatest(-50.0, least(50.0, (d.n_chars - 2000) / 500.0 - 2.0))))
            AS probability, d.n_chars < 600 AS short_text, d.n_chars < 300 AS abstained
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
)
CTES["cases_decided"] = (
    ("eval_cases",),
    """SELECT *, CASE WHEN final_llr < 0 THEN 'CONTRADICTION_REJECTED'
          WHEN probability >= 0.85 THEN 'HIGH_CONFIDENCE_LINK'
          WHEN probability >= 0.5 THEN 'LOW_CONFIDENCE_LINK' ELSE 'INSUFFICIENT_EVIDENCE' END
          AS decision FROM eval_cases""",
)

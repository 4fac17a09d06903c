import hashlib
import json
import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from linkweave import fixed
from linkweave.operators import audit, graph, ledger, reads
from linkweave.plans import catalog, derive, registry
from linkweave.sources import exports, tables, topics
from linkweave.streaming import jobs

AT = datetime(2026, 1, 1)
EVENT = ("chain string, actor_user_id string, action string, resource_type string, "
         "resource_id string, payload string, created_at timestamp, n long")


def events(spark, n=8, chain="c"):
    rows = [(chain, "u1", "EDIT", "LINK", f"r{i}", json.dumps({"b": i, "a": "x é"}), AT, i)
            for i in range(n)]
    return spark.createDataFrame(rows, EVENT)


def test_chain_equals_a_loop(spark):
    log = sorted(audit.append(events(spark), ["n"]).collect(), key=lambda r: r.seq)
    prev = "0" * 64
    micros = int(AT.replace(tzinfo=timezone.utc).timestamp() * 1_000_000)
    for i, r in enumerate(log):
        canon = json.dumps({"b": i, "a": "x é"}, sort_keys=True, separators=(",", ":"),
                           ensure_ascii=False)
        assert r.payload == canon
        ph = hashlib.sha256(canon.encode()).hexdigest()
        want = "\x1f".join([str(i), prev, "u1", "EDIT", "LINK", f"r{i}", ph, str(micros)])
        assert (r.seq, r.prev_hash, r.payload_hash) == (i, prev, ph)
        assert r.entry_hash == hashlib.sha256(want.encode()).hexdigest()
        prev = r.entry_hash


EDITS = {
    "payload": ("payload", '{"a":"y","b":3}', "payload_hash"),
    "action": ("action", "DELETE", "entry_hash"),
    "actor": ("actor_user_id", "u2", "entry_hash"),
    "time": ("created_at", datetime(2026, 1, 2), "entry_hash"),
    "link": ("prev_hash", "f" * 64, "prev_hash"),
    "hash": ("entry_hash", "e" * 64, "entry_hash"),
}


@pytest.mark.parametrize("edit", EDITS)
def test_edits_are_found(spark, edit):
    column, value, check = EDITS[edit]
    log = audit.append(events(spark), ["n"])
    bad = log.withColumn(column, F.when(F.col("seq") == 3, F.lit(value)).otherwise(F.col(column)))
    r = audit.verify(bad).first()
    assert (r.valid, r.failed_seq, r.check, r.entries_checked) == (False, 3, check, 3)


def test_deletion_is_found_but_a_cut_tail_is_not(spark):
    log = audit.append(events(spark), ["n"])
    r = audit.verify(log.where("seq <> 4")).first()
    assert (r.failed_seq, r.check, r.entries_checked) == (5, "sequence", 4)
    assert audit.verify(log.where("seq < 5")).first().valid
    assert audit.verify(log.where("seq > 0")).first().check == "sequence"


def test_chain_goes_on(spark):
    log = audit.append(events(spark, 8), ["n"])
    first = audit.append(events(spark, 8).where("n < 5"), ["n"])
    second = audit.append(events(spark, 8).where("n >= 5"), ["n"], first)
    both = first.unionByName(second)
    assert audit.verify(both).first().valid
    assert audit.heads(both).first().head_hash == audit.heads(log).first().head_hash


def _items(spark):
    return spark.createDataFrame(
        [("i1", "h1", "e1", "FINANCIAL", 3.0, False), ("i2", "h1", "e2", "TEMPORAL", 1.5, False),
         ("i3", "h2", "e1", "FINANCIAL", 2.5, False), ("i4", "h2", "gone", "FINANCIAL", 1.0, False)],
        "id string, hypothesis_id string, evidence_id string, family string, contribution double, "
        "is_contradiction boolean")


def _evidence(spark):
    return spark.createDataFrame(
        [("e1", None, None, None), ("e2", None, None, None)],
        "evidence_id string, retracted_at timestamp, retracted_by string, retraction_reason string")


def _links(spark):
    return spark.createDataFrame(
        [("h1", "a", "b", 4.5, 0.92, "PROPOSED"), ("h2", "b", "c", 2.5, 0.6, "ACCEPTED"),
         ("h3", "c", "d", 9.0, 0.99, "PROPOSED")],
        "hypothesis_id string, subject_id string, object_id string, raw_log_lr double, "
        "calibrated_prob double, status string")


def test_retraction_keeps_the_row_and_moves_the_score(spark):
    req = spark.createDataFrame(
        [("e1", AT, 1, "u1", "wrong"), ("e1", AT, 2, "u2", "again"), ("ghost", AT, 1, "u1", "?")],
        "evidence_id string, requested_at timestamp, request_no int, requested_by string, "
        "reason string")
    updated, refused, receipts = ledger.retract(_evidence(spark), req, _items(spark))
    assert updated.count() == 2
    assert updated.where("retracted_at IS NOT NULL").first().retracted_by == "u1"
    assert {(r.evidence_id, r.refusal) for r in refused.collect()} == {
        ("e1", "already retracted"), ("ghost", "unknown evidence")}
    assert receipts.first().cited_by == 2
    out = {r.hypothesis_id: r for r in ledger.rescore_affected(
        _links(spark), _items(spark), updated, receipts).collect()}
    assert set(out) == {"h1", "h2"}
    assert (out["h1"].raw_log_lr, out["h1"].status) == (1.5, "INSUFFICIENT")
    assert (out["h2"].raw_log_lr, out["h2"].status) == (0.0, "ACCEPTED")
    _, refused, receipts = ledger.retract(updated, req.where("request_no = 1"), _items(spark))
    assert receipts.count() == 0 and refused.count() == 2


def test_reviews(spark):
    rev = spark.createDataFrame(
        [("r1", "h1", "ACCEPT", "u1", AT), ("r2", "h1", "REJECT", "u2", datetime(2026, 1, 5))],
        "review_id string, hypothesis_id string, decision string, reviewer_id string, "
        "reviewed_at timestamp")
    out = {r.hypothesis_id: r.status for r in ledger.apply_reviews(_links(spark), rev).collect()}
    assert out == {"h1": "REJECTED", "h2": "ACCEPTED", "h3": "PROPOSED"}
    assert not set(out.values()) & set(fixed.REVIEW_STATUS)


def test_repair_leaves_no_dangling_rows(spark):
    items, ev, links = _items(spark), _evidence(spark), _links(spark).where("hypothesis_id <> 'h1'")
    row = ledger.integrity_report(items, ev, links).first()
    assert (row.dangling_evidence_citations, row.orphaned_join_rows, row.ok) == (1, 2, False)
    fixed_items = ledger.repair(items, ev, links)
    assert [r.id for r in fixed_items.collect()] == ["i3"]
    assert ledger.integrity_report(fixed_items, ev, links).first().ok


def test_peer_links_and_hub(spark):
    pairs = [("hub", f"n{i}") for i in range(30)] + [("n1", "n2"), ("n2", "n1"), ("n5", "n5")]
    links = spark.createDataFrame(
        [(f"h{i}", a, b, 1.0, 0.5, "PROPOSED") for i, (a, b) in enumerate(pairs)],
        _links(spark).schema)
    who = spark.createDataFrame([("hub", "Hub")] + [(f"n{i}", f"N{i}") for i in range(30)],
                                "actor_id string, primary_alias string")
    out = {(r.ego, r.hypothesis_id) for r in graph.peer_links(links, who).collect()}
    assert out == {("hub", "h30"), ("hub", "h31"), ("n1", "h1"), ("n1", "h1"), ("n1", "h2"),
                   ("n2", "h1")} - {("n1", "h1")}


def test_profile_of_a_busy_actor_comes_in_chunks(spark):
    al = spark.createDataFrame([(f"al{i:04d}", "a", f"name{i}") for i in range(2300)],
                               "alias_id string, actor_id string, value string")
    who = spark.createDataFrame([("a", "A", "cat", 0.5, None)],
                                "actor_id string, primary_alias string, category string, "
                                "confidence double, last_seen timestamp")
    got = reads.resolve_entity(who, al, "name").collect()
    assert len(got) == 3
    assert sum(len(r.matched_aliases) for r in got) == 2300
    links = spark.createDataFrame([("h1", "a", "b", "A", "B", 0.29, 1.0)],
                                  "hypothesis_id string, subject_id string, object_id string, "
                                  "subject string, object string, calibrated_prob double, "
                                  "raw_log_lr double")
    bundles = [json.loads(r.bundle) for r in exports.link_bundles(links, al, "t").collect()]
    names = [n for b in bundles for o in b["objects"] for n in o.get("aliases", [])]
    assert len(bundles) == len(names) == len(set(names)) == 2301
    main = next(b for b in bundles if b["id"] == "bundle--h1")
    assert [o["type"] for o in main["objects"]] == ["identity", "threat-actor", "identity",
                                                    "relationship"]
    assert main["objects"][3]["confidence"] == 28


def test_wallet_co_owners(spark):
    w = spark.createDataFrame(
        [("w1", "a1", "BTC", "C", "x"), ("w2", "a3", "BTC", "C", "y"), ("w3", "a2", "BTC", "C", "y"),
         ("w4", "a4", "XMR", None, "x"), ("w5", "a5", "BTC", "D", "x")],
        "wallet_id string, address string, chain string, cluster_id string, actor_id string")
    who = spark.createDataFrame([("x", "X"), ("y", "Y")], "actor_id string, primary_alias string")
    ask = who.where("actor_id = 'x'")
    out = {(r.address, r.co_owner_id, r.co_owner_address)
           for r in reads.wallet_co_owners(w, who, ask).collect()}
    assert ("a1", "y", "a2") in out and ("a4", None, None) in out
    assert ("a5", None, None) in out and len(out) == 3
    row = {r.actor_id: r for r in reads.wallet_holdings(w, who).collect()}["x"]
    assert (row.wallet_count, row.clustered_count, row.shared_cluster_count) == (3, 2, 1)


def test_co_owners_are_paired_in_tiles(spark):
    w = spark.createDataFrame(
        [(f"w{i}", f"a{i}", "BTC", "C" if i < 60 else "D", f"x{i % 45}") for i in range(61)],
        "wallet_id string, address string, chain string, cluster_id string, actor_id string")
    who = w.selectExpr("actor_id", "upper(actor_id) AS primary_alias").distinct()
    rows = reads.wallet_co_owners(w, who, who, tile=7)
    got = rows.collect()
    assert len(got) == len(set(got)) == 60 * 44 + 1
    assert [r.address for r in got if r.co_owner_id is None] == ["a60"]
    busy = rows.where("cluster_id = 'C'").groupBy(F.spark_partition_id()).count().collect()
    assert len(busy) > 10 and max(r["count"] for r in busy) < 60 * 44 // 4


def test_every_wallet_gets_its_co_owners(spark, small):
    from linkweave.plans import catalog
    from linkweave.plans import derive as D

    fn, _ = catalog.entries()["wallet_clusters_with_owners"]
    rows = fn(spark, small).collect()
    w, who = D.wallets(spark, small), D.actors(spark, small)
    assert sorted(str((r.cluster_id, r.actor_id, r.address, r.chain)) for r in rows if r.kind == "wallet") == sorted(
        str((r.cluster_id, r.actor_id, r.address, r.chain)) for r in w.collect()
    )
    owners = {}
    for r in rows:
        if r.kind == "owner":
            owners.setdefault(r.cluster_id, []).append((r.actor_id, r.owner, r.address))
    got = []
    for r in rows:
        if r.kind == "wallet":
            others = [o for o in owners.get(r.cluster_id, []) if o[0] != r.actor_id] or [(None, None, None)]
            got += [str((r.actor_id, r.address, r.chain, r.cluster_id, *o)) for o in others]
    want = reads.wallet_co_owners(w, who, w.select("actor_id").distinct()).collect()
    assert sorted(got) == sorted(str(tuple(r)) for r in want)
    asked = {r.actor_id for r in rows if r.kind == "wallet"}
    assert any(not a.endswith("1") for a in asked)


def test_search_takes_wildcards_literally(spark):
    who = spark.createDataFrame([("a", "100%_sure", "x"), ("b", "1000", "x")],
                                "actor_id string, primary_alias string, category string")
    assert [r.actor_id for r in reads.actor_list(who, q="0%_S").collect()] == ["a"]


def test_csv_has_twelve_headings(spark, folder):
    detail = spark.createDataFrame([("e1", "FINANCIAL", "a,b \"q\"", False)],
                                   "evidence_id string, family string, value string, "
                                   "is_contradiction boolean")
    exports.write_evidence_csv(detail, f"{folder}/csv")
    back = spark.read.option("header", True).option("escape", '"').csv(f"{folder}/csv")
    assert back.columns == [h for _, h in fixed.EVIDENCE_EXPORT_COLUMNS]
    assert len(back.columns) == 12


def test_csv_may_be_compressed(spark, folder):
    detail = spark.createDataFrame([("e1", "x" * 5000)], "evidence_id string, value string")
    exports.write_evidence_csv(detail, f"{folder}/csv", "gzip")
    assert spark.read.option("header", True).csv(f"{folder}/csv").first()["Value"] == "x" * 5000
    kept = [n for n in os.listdir(f"{folder}/csv") if n.startswith("part")]
    assert kept and all(n.endswith(".gz") for n in kept)


def test_link_items_meet_the_evidence_once(spark):
    asked = spark.createDataFrame([("e1", AT, 1, "u1", "wrong")], "evidence_id string, "
                                  "requested_at timestamp, request_no int, requested_by string, reason string")
    evidence = _evidence(spark).withColumns(
        {c: F.lit("x") for c in ("artifact_id", "source_uri", "extraction_method", "value", "dependence_group")}
    ).withColumn("created_at", F.lit(AT))
    items = _items(spark).withColumns({"family": F.lit("F"), "reliability_weight": F.lit(1.0),
                                       "raw_llr": F.lit(1.0), "is_contradiction": F.lit(False)})
    updated, _, _ = ledger.retract(evidence, asked, items)
    files = spark.createDataFrame([("x", "d")], "artifact_id string, sha256 string")
    rows = reads.link_items(items, updated, files)
    got = {(r.evidence_id, r.source_uri, r.sha256) for r in rows.collect()}
    assert got == {("e2", "x", "d"), ("gone", "Unknown", None)}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("Join ") == 3
    nested = reads.link_items_nested(reads.link_items(items, updated, None), ("evidence_id",))
    assert sorted(x["evidence_id"] for r in nested.collect() for x in r["items"]) == ["e2", "gone"]


def test_tables_round_trip(spark, folder, small):
    tables.append(derive.actors(spark, small), folder, "actors")
    back = tables.read(spark, folder, "actors")
    assert back.schema.fieldNames() == tables.schema("actors").fieldNames()
    assert back.count() == derive.actors(spark, small).count()
    assert len(tables.SCHEMAS) == 19


def test_sixteen_named_reads(spark, small):
    assert len(registry.REGISTRY) == 16
    t = derive.ledger(spark, small) | {
        "hypotheses": derive.hypotheses(spark, small),
        "hypothesis_evidence": derive.hypothesis_evidence(spark, small),
        "artifacts": derive.artifacts(spark, small),
        "reviews": derive.reviews(spark, small),
        "audit_log": audit.append(derive.audit_events(spark, small), ["created_at", "order_id"]),
        "sources": spark.createDataFrame([("s1", "n")], "source_id string, name string"),
        "observations": derive.raw_observations(spark, small),
    }
    hid = t["hypothesis_evidence"].first().hypothesis_id
    asks = {"resolve_entity": {"term": "red"}, "universal_search": {"term": "bolt"},
            "get_actor_profile": {"actor_id": "A1"}, "get_actor_links": {"actor_id": "A1"},
            "get_actor_evidence": {"actor_id": "A1"}, "get_hypothesis_evidence":
            {"hypothesis_id": hid}, "find_shared_identifiers": {"actor_id": "A1"}}
    for name in registry.REGISTRY:
        assert registry.ask(t, name, **asks.get(name, {})).limit(3).collect(), name
    assert registry.ask(t, "universal_search", term="re").count() == 0


def test_streaming_ingest_survives_restart(spark, folder, small):
    raw = derive.raw_observations(spark, small).limit(120).cache()
    raw.write.parquet(f"{folder}/in")

    def run(checkpoint):
        stream = jobs.read_files(spark, f"{folder}/in", jobs.OBSERVATION_SCHEMA, 1)
        jobs.ingest(stream, f"{folder}/out", checkpoint).awaitTermination()
        return spark.read.parquet(f"{folder}/out/observations").count()

    first = run(f"{folder}/cp")
    raw.write.mode("append").parquet(f"{folder}/in")  # the same contents arrive again
    assert run(f"{folder}/cp") == first > 0


def test_streaming_chain_verifies_over_batches(spark, folder):
    for lo in (0, 5, 9):
        events(spark, 14).where(f"n >= {lo} AND n < {lo + 5}").where(
            f"n < {5 if lo == 0 else 9 if lo == 5 else 14}").coalesce(1).write.mode(
            "append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(EVENT).parquet(f"{folder}/in")
        jobs.chain_append(stream, ["n"], folder, f"{folder}/cp").awaitTermination()
    log = spark.read.schema(jobs.LOG_SCHEMA).parquet(f"{folder}/entries")
    row = audit.verify(log).first()
    assert (row.valid, row.entries) == (True, 14)


PAGE = "topic string, id string, timestamp timestamp, payload string"


def test_pages_flow_to_the_last_topic(spark, folder):
    def collected(*pages):
        rows = [("stream:page_collected", k, AT, json.dumps({"html": text})) for k, text in pages]
        spark.createDataFrame(rows, PAGE).coalesce(1).write.mode("append").parquet(f"{folder}/pages")

    def run():
        pages = jobs.read_files(spark, f"{folder}/pages", PAGE)
        jobs.pipeline(pages, folder, f"{folder}/cp")
        rows = topics.read(spark, f"{folder}/projected").collect()
        assert all(r.topic == "stream:graph_projected" for r in rows)
        assert len({r.id for r in rows}) == len(rows)
        return {r.id for r in rows}

    collected(("1", "write to x@y.org"), ("4", "only q@y.org"))
    assert run() == set()  # nothing is shared yet
    collected(("2", "mail x@y.org or z@y.org"), ("2", "mail x@y.org again"))
    first = {"email::x@y.org", "page::1", "page::2", "page::1->email::x@y.org", "page::2->email::x@y.org"}
    assert run() == first
    collected(("3", "x@y.org and z@y.org"))
    later = {"page::3", "page::3->email::x@y.org", "email::z@y.org", "page::2->email::z@y.org", "page::3->email::z@y.org"}
    assert run() == first | later
    assert run() == first | later  # a restart without new pages adds nothing


REQUEST = "evidence_id string, requested_at timestamp, request_no int, requested_by string, reason string"


def test_streaming_rescoring(spark, folder):
    def ask(*rows):
        spark.createDataFrame([(e, AT, n, "u1", "x") for e, n in rows], REQUEST).coalesce(1).write.mode(
            "append").parquet(f"{folder}/req")

    def run():
        stream = jobs.read_files(spark, f"{folder}/req", REQUEST, 1)
        sums = jobs.stored_sums(_items(spark), _evidence(spark))
        jobs.rescoring(stream, _evidence(spark), _items(spark), _links(spark), sums, folder, f"{folder}/cp")
        return {r.hypothesis_id: (r.raw_log_lr, r.active_items, r.status)
                for r in jobs.rescored_links(spark, folder).collect()}

    ask(("e1", 1), ("e1", 2), ("ghost", 1))
    assert run() == {"h1": (1.5, 1, "INSUFFICIENT"), "h2": (0.0, 0, "ACCEPTED")}
    ask(("e1", 3), ("e2", 1))
    assert run() == {"h1": (0.0, 0, "INSUFFICIENT"), "h2": (0.0, 0, "ACCEPTED")}
    decided = [(r.evidence_id, r.request_no) for r in spark.read.parquet(f"{folder}/decided").where("accepted").collect()]
    assert sorted(decided) == [("e1", 1), ("e2", 1)]


def test_counters_survive_restarts(spark, folder):
    log = "method string, path string, status int, duration double"
    for k in range(3):
        rows = [("GET", "/a", 200, 0.5)] * (k + 1) + [("PUT", "/b", 201, 1.0)]
        spark.createDataFrame(rows, log).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = jobs.read_files(spark, f"{folder}/in", log, 1)
        jobs.running_counters(stream, folder, f"{folder}/cp").awaitTermination()
        got = {(r.method, r.path, r.status): (r.requests, r.seconds) for r in jobs.current_counters(spark, folder).collect()}
        n = (k + 1) * (k + 2) // 2
        assert got == {("GET", "/a", 200): (n, n / 2), ("PUT", "/b", 201): (k + 1, k + 1.0)}


def test_catalogue_is_sound():
    entries = catalog.entries()
    assert len(entries) > 120
    assert all(callable(fn) for fn, _ in entries.values())


def test_bundles_are_rendered_once_and_quoted(spark):
    links = spark.createDataFrame(
        [('h"1\\', "a", "b", 'A "x"\n', "B}", 0.5, 1.0), (None, "a", "b", "A", "B", None, 1.0)],
        "hypothesis_id string, subject_id string, object_id string, subject string, object string, "
        "calibrated_prob double, raw_log_lr double")  # fmt: skip
    al = spark.createDataFrame([("al}", "a", "né\"me")], "alias_id string, actor_id string, value string")
    out = exports.link_bundles(links, al, "t")
    assert "json_object" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.bundle_of: r.bundle and json.loads(r.bundle) for r in out.collect()}
    assert got[None] is None and got['h"1\\']["id"] == 'bundle--h"1\\'
    assert got['h"1\\']["objects"][1]["name"] == 'A "x"\n' and got['h"1\\']["objects"][2]["name"] == "B}"
    assert got["al}"]["objects"][0]["aliases"] == ['né"me'] and got["al}"]["spec_version"] == "2.1"

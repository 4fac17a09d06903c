"""Chains, addresses, times and cluster settings that a careless check would let through."""

import hashlib
import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from linkweave import session
from linkweave.functions import web
from linkweave.operators import audit, finance, graph, ledger, ranking, reads
from linkweave.plans import derive
from linkweave.streaming import state


@pytest.fixture(scope="module")
def log(spark):
    session.ship_code(spark)
    rows = [("c", "u", "A", "T", str(i), '{"b": 1.0, "a": %d}' % i, i) for i in range(9)]
    rows += [("d", "u", "A", "T", str(i), "", i) for i in range(3)]
    events = spark.createDataFrame(
        rows,
        "chain string, actor_user_id string, action string, resource_type string, resource_id string, "
        "payload string, order_id int",
    ).withColumn("created_at", F.timestamp_seconds(F.col("order_id") + 1_700_000_000))
    return session.cut_lineage(audit.append(events, ["order_id"]))


def _verdict(log):
    return {r.chain: r for r in audit.verify(log).collect()}


def test_a_sound_log_is_valid(log):
    got = _verdict(log)
    assert all(r.valid and r.entries == r.entries_checked for r in got.values())
    assert got["c"].entries == 9 and got["d"].entries == 3


def test_a_forked_tail_is_found(log):
    fork = log.where("chain = 'c' AND seq = 8").withColumn("action", F.lit("X")).withColumn(
        "entry_hash", audit.entry_hash()
    )
    r = _verdict(log.unionByName(fork))["c"]
    assert (r.valid, r.entries, r.entries_checked, r.failed_seq, r.check) == (False, 10, 9, 8, "sequence")


def test_missing_hashes_and_numbers_are_found(log):
    at = F.col("seq") == 4
    c = F.col("chain") == "c"
    for column, check in (("entry_hash", "entry_hash"), ("payload_hash", "payload_hash"), ("prev_hash", "prev_hash")):
        r = _verdict(log.withColumn(column, F.when(~(at & c), F.col(column))))["c"]
        assert (r.valid, r.failed_seq, r.check) == (False, 4, check)
    edited = log.withColumn("payload", F.when(at & c, '{"a":4,"b":1}').otherwise(F.col("payload")))
    assert _verdict(edited)["c"].check == "payload_hash"
    gap = log.where(~(at & c))
    r = _verdict(gap)["c"]
    assert (r.failed_seq, r.check, r.entries_checked) == (5, "sequence", 4)
    none = log.withColumn("seq", F.when(~(at & c), F.col("seq")))
    assert not _verdict(none)["c"].valid


def test_canonical_payloads_keep_numbers(spark):
    session.ship_code(spark)
    texts = ['{"b":1.0,"a":[1e-7,-0.50,12345678901234567890]}', "", None, "null", "{oops", '"é\\u00e9"', "1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(audit.canonical_json(F.col("t"))).collect()]
    want = ['{"a":[1e-07,-0.5,12345678901234567890],"b":1.0}', "{}", "{}", "{}", '"{oops"', '"éé"', "1"]
    assert got == want
    hashes = [r[0] for r in df.orderBy("i").select(audit.payload_hash(F.col("t"))).collect()]
    assert hashes[0] == hashlib.sha256(want[0].encode()).hexdigest()


def test_empty_addresses_join_nothing(spark):
    tx = spark.createDataFrame(
        [("1", ["", "a", "b"], ["x"]), ("2", ["", "c", "d"], [""]), ("3", [None, "e", "f"], []), ("4", [""], ["a"])],
        "txid string, inputs array<string>, outputs array<string>",
    )
    got = {r.address: r.cluster_id for r in finance.owner_clusters(tx).collect()}
    assert got["a"] == got["b"] != got["c"] == got["d"] and got["e"] == got["f"]
    assert set(got) == {"a", "b", "c", "d", "e", "f", "x"}


def test_a_blank_term_finds_nobody(spark):
    who = spark.createDataFrame(
        [("a", "A", "cat", 0.5, None)],
        "actor_id string, primary_alias string, category string, confidence double, last_seen timestamp",
    )
    names = spark.createDataFrame([("l", "a", "name")], "alias_id string, actor_id string, value string")
    for term in ("", "  "):
        assert reads.resolve_entity(who, names, term).count() == 0


def test_times_are_read_as_python_reads_them(spark):
    texts = [
        "2024-01-01T00:00:00+0200", "20240101T000000", "2024-01-01T10:20:30.1234567", "2024-01-01",
        "2024-01-01T10", "2024-01-01 10:20Z", "2024-W01-1", "2020W537", "2024-01-01T10:20:30,5-03:30", "20240229",
        "2023-02-29", "2024-13-01", "2024-01-01T25:00:00", "about now", "", "2024-01-01T10:20:30+05:30:10",
        "2024-1-1", "2024-01-01T10:20:30.5z", "2024-W54-1",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(F.unix_micros(web.iso_timestamp("t"))).collect()]
    for text, micros in zip(texts, got, strict=True):
        try:
            clean = text[:-1] + "+00:00" if text[-1:] in "zZ" and text else text
            when = datetime.fromisoformat(clean)
        except ValueError:
            assert micros is None, text
            continue
        when = when if when.tzinfo else when.replace(tzinfo=timezone.utc)
        want = round((when - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1_000_000)
        assert micros == want, text


def test_identifiers_are_attached_once(spark):
    cases = spark.createDataFrame([("c",)], "case_id string")
    rows = [("1", "c", "h", " x ", 1), ("2", "c", "h", "x", 2), ("3", "c", "w", "x", 3), ("4", "c", "h", " ", 4),
            ("5", "d", "h", "x", 5), ("6", "c", "h", "old", 6)]
    requests = spark.createDataFrame(
        rows, "identifier_id string, case_id string, id_type string, value string, t int"
    ).select("*", F.timestamp_seconds("t").alias("created_at"))
    old = spark.createDataFrame([("c", "h", "old")], "case_id string, id_type string, value string")
    added, refused = ledger.attach_identifiers(requests, cases, old)
    assert {r.identifier_id for r in added.collect()} == {"1", "3"}
    assert {r.identifier_id: r.reason for r in refused.collect()} == {
        "2": "already attached", "4": "blank value", "5": "unknown case", "6": "already attached",
    }
    listed = {r.identifier_id: r.position for r in reads.case_identifiers(added).collect()}
    assert listed == {"3": 1, "1": 2}


def test_positions_number_every_row(spark):
    rows = spark.createDataFrame([("k", i % 3) for i in range(50)] + [("z", None)], "key string, x int")
    got = ranking.positions(rows, "key", ["x"], {}).collect()
    mine = sorted((r.position, r.x) for r in got if r.key == "k")
    assert [p for p, _ in mine] == list(range(1, 51)) and [x for _, x in mine] == sorted(x for _, x in mine)


def test_positions_go_on_over_partitions_and_for_rows_without_a_key(spark):
    keys = [None] * 30 + ["a"] * 3 + ["b"] * 200 + ["c"] * 2
    rows = spark.createDataFrame([(k, i % 7, {"n": i % 2}) for i, k in enumerate(keys)],
                                 "key string, x int, m map<string,int>")
    got = ranking.positions(rows, "key", ["x"], {}).collect()
    assert len(got) == len(keys)
    for key in set(keys):
        mine = sorted((r.position, r.x) for r in got if r.key == key)
        assert [p for p, _ in mine] == list(range(1, keys.count(key) + 1))
        assert [x for _, x in mine] == sorted(x for _, x in mine)


def test_a_timeline_carries_nothing_it_does_not_show(spark, small):
    links, cited = derive.link_pairs(spark, small), derive.cited_evidence(spark, small)
    rows = reads.actor_timeline(links, cited, derive.stored_evidence(spark, small))
    assert set(rows.columns) == {"actor_id", "evidence_id", "extraction_method", "created_at", "position"}


def test_items_are_doubled_where_they_meet_their_evidence(spark, small):
    links, evidence = derive.link_pairs(spark, small), derive.stored_evidence(spark, small)
    items = derive.hypothesis_evidence(spark, small)
    shown = reads.actor_evidence(links, items, evidence, derive.artifacts(spark, small))
    timed = reads.actor_timeline(links, derive.cited_evidence(spark, small), evidence)
    for rows in (shown, timed):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(actor_id" not in plan
    want = set()
    cited = {(r.hypothesis_id, r.evidence_id) for r in items.collect()}
    ends = {r.hypothesis_id: {r.subject_id, r.object_id} for r in links.collect()}
    for link, evidence_id in cited:
        want |= {(actor, evidence_id) for actor in ends.get(link, ())}
    for rows in (shown, timed):
        got = [(r.actor_id, r.evidence_id) for r in rows.collect()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("p,q", [(1.0, 1.0), (4.0, 0.5)])
def test_walks_step_along_edges(spark, p, q):
    pairs = [("hub", f"n{i}") for i in range(90)] + [("n1", "n2"), ("n2", "n3")]
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src string, dst string")
    known = set(pairs) | {(b, a) for a, b in pairs}
    walks = [r.path for r in graph.random_walks(edges, 2, 6, p, q).collect()]
    assert len(walks) == 2 * 91
    for path in walks:
        assert len(path) == 6 and all(step in known for step in zip(path, path[1:], strict=False))


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Unset:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Unset())
    assert json.dumps(session.shared_folder(spark))


def test_only_links_that_change_get_state():
    assert "handleInitialState" not in vars(state.LinkSums)

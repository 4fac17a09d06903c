"""SQL table functions beside the named reads they stand for."""

from linkweave.plans import derive, registry, table_functions


def rows(frame, *columns):
    return sorted(str(tuple(r)) for r in frame.select(*columns).collect())


def test_functions_answer_like_the_registry(spark, small):
    t = derive.ledger(spark, small) | {
        "hypotheses": derive.hypotheses(spark, small).cache(),
        "hypothesis_evidence": derive.hypothesis_evidence(spark, small).cache(),
        "artifacts": derive.artifacts(spark, small),
        "reviews": derive.reviews(spark, small),
    }
    made = table_functions.register(spark, t)
    assert set(made) == set(registry.REGISTRY) - {"get_ledger_stats", "get_timeline", "get_sources"}
    link = t["hypotheses"].first()
    actor, hid = link.subject_id, link.hypothesis_id
    for name, args, kept, columns in (
        ("list_actors", {"limit": 7}, "7", ["actor_id", "alias_count"]),
        ("get_actor_links", {"actor_id": actor}, f"'{actor}'", ["hypothesis_id", "counterpart"]),
        ("get_actor_evidence", {"actor_id": actor, "limit": 3}, f"'{actor}', 3",
         ["evidence_id", "position"]),
        ("get_hypothesis_evidence", {"hypothesis_id": hid}, f"'{hid}'",
         ["evidence_id", "contribution", "family_total"]),
        ("universal_search", {"term": "10_"}, "'10_'", ["kind", "value", "actor_id"]),
        ("universal_search", {"term": "100", "limit": 2}, "'100', 2", ["kind", "value", "actor_id"]),
        ("get_evidence_provenance", {"limit": 4, "kind": "hash"}, "4, 'hash'", ["evidence_id", "artifact_sha256"]),
        ("get_review_queue", {}, "", ["hypothesis_id", "subject"]),
        ("get_decisions", {}, "", ["review_id", "pair"]),
        ("get_cases", {}, "", ["case_id"]),
    ):
        want = rows(registry.ask(t, name, **args), *columns)
        assert rows(spark.sql(f"SELECT * FROM {name}({kept})"), *columns) == want, name
    empty = ("resolve_entity(' ')", "resolve_entity(NULL)", "universal_search('10')", "list_actors(0)",
             "list_actors(NULL)", "get_actor_links(NULL)", "get_actor_profile('nobody')")
    for call in empty:
        assert spark.sql(f"SELECT * FROM {call}").isEmpty(), call


def test_arguments_reach_the_scan(spark, small, folder):
    for name, frame in derive.ledger(spark, small).items():
        frame.write.parquet(f"{folder}/{name}")
    stored = {n: spark.read.parquet(f"{folder}/{n}") for n in derive.ledger(spark, small)}
    table_functions.register(spark, stored, "stored_")
    plan = lambda sql: spark.sql(sql)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(actor_id,A7)" in plan("SELECT * FROM get_actor_profile('A7')")
    assert "TakeOrderedAndProject(limit=5" in plan("SELECT * FROM get_cases(5)")


def test_decision_without_a_link(spark):
    links = spark.createDataFrame([("h1", "a", "b", 0.5)],
                                  "hypothesis_id string, subject_id string, object_id string, calibrated_prob double")
    table_functions.register(spark, {
        "hypotheses": links.selectExpr("*", "'PROPOSED' AS status", "0D AS raw_log_lr"),
        "actors": spark.createDataFrame([("a", "Ann", "x", 0.5)],
                                        "actor_id string, primary_alias string, category string, confidence double"),
        "reviews": spark.createDataFrame([("r1", "ACCEPT", "h1", 1), ("r2", "REJECT", "gone", 2)],
                                         "review_id string, decision string, hypothesis_id string, reviewed_at int"),
    })
    got = {r.review_id: r.pair for r in spark.sql("SELECT * FROM get_decisions()").collect()}
    assert got == {"r1": "Ann <-> b", "r2": None}


def test_evidence_of_an_actor_needs_no_scored_links(spark, small):
    """With the ends of links at hand the scored links are not read."""
    ends = derive.link_pairs(spark, small)
    scored = ends.selectExpr("hypothesis_id", "raise_error('scored') AS subject_id", "object_id")
    tables = derive.ledger(spark, small) | {
        "hypotheses": scored.selectExpr("*", "'x' AS status", "0D AS raw_log_lr", "0D AS calibrated_prob"),
        "link_ends": ends,
        "hypothesis_evidence": derive.hypothesis_evidence(spark, small),
        "artifacts": derive.artifacts(spark, small),
    }
    table_functions.register(spark, tables, "ends_")
    actor = ends.first().subject_id
    got = spark.sql(f"SELECT * FROM get_actor_evidence('{actor}')").collect()
    assert got and [r.position for r in got] == list(range(1, len(got) + 1))

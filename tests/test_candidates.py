import difflib
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from linkweave.operators import activity, candidates, clones, finance, graph, similar


def test_similar_values_lose_nothing(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abcd_1") for _ in range(rng.randrange(0, 16))) for _ in range(260)}
    words |= {"silverfox", "silver_fox", "s1lverfox", "greenhill", "gr33nhill", ""}
    df = spark.createDataFrame([(w,) for w in words], "value string")
    got = {(r.a, r.b) for r in candidates.similar_values(df, df).collect()}
    want = {(a, b) for a in words for b in words
            if difflib.SequenceMatcher(None, a, b).ratio() >= 0.70}
    assert got == want


def test_long_values_share_a_neighbour_pair(spark):
    rng = random.Random(6)
    words = set()
    for _ in range(25):
        base = "".join(rng.choice("abcdefgh") for _ in range(24))
        words.add(base)
        for _ in range(4):
            chars = [c for c in base if rng.random() > 0.25]
            for _ in range(rng.randrange(0, 8)):
                chars.insert(rng.randrange(len(chars)), rng.choice("xyz"))
            words.add("".join(chars))
    df = spark.createDataFrame([(w,) for w in words], "value string")
    got = {(r.a, r.b) for r in candidates.similar_values(df, df).collect()}
    want = {(a, b) for a in words for b in words
            if difflib.SequenceMatcher(None, a, b).ratio() >= 0.70}
    assert got == want


def test_fingerprints_ignore_spaces_and_case(spark):
    s = spark.createDataFrame([("s1", "ab CD"), ("s2", "  ")], "source_id string, f string")
    c = spark.createDataFrame([("c1", "ABcd"), ("c2", "")], "actor_id string, f string")
    key = candidates.fingerprint_key("f")
    out = candidates.exact_matches(s, c, key, "EXACT_PGP_MATCH", "EXACT_IDENTITY").collect()
    assert [(r.source_id, r.candidate_id, r.score) for r in out] == [("s1", "c1", 1.0)]


def test_hash_as_number_and_text(spark):
    s = spark.createDataFrame([("s", -42)], "source_id string, h int")
    c = spark.createDataFrame([("c", " -42 "), ("d", "42")], "actor_id string, h string")
    key = candidates.hash_key("h")
    out = candidates.exact_matches(s, c, key, "FAVICON_MMH3_MATCH", "INFRASTRUCTURE").collect()
    assert [r.candidate_id for r in out] == ["c"]


@pytest.mark.parametrize("threshold", [0.25, 0.5, 0.9, 1.0])
def test_similar_values_are_complete_at_every_threshold(spark, threshold):
    rng = random.Random(7)
    words = {"".join(rng.choice("abcde1 é") for _ in range(rng.randrange(0, 12))) for _ in range(90)}
    words |= {"silverfox" * 4, "silver_fox" * 4, "x" * 90, "x" * 70 + "y", "ab", "ba", "a", ""}
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "value string")
    got = {(r.a, r.b) for r in similar.by_blocks(df, df, threshold).collect()}
    assert got == {(a, b) for a in words for b in words
                   if difflib.SequenceMatcher(None, a, b).ratio() >= threshold}
    got = {(r.a, r.b) for r in similar.by_edits(df, df, threshold).collect()}
    assert got == {(a, b) for a in words for b in words
                   if a == b or 1 - edits(a, b) / max(len(a), len(b)) >= threshold}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similar_values_of_nothing(spark):
    df = spark.createDataFrame([("",), (None,)], "value string")
    assert [(r.a, r.b, r.ratio) for r in similar.by_blocks(df, df, 0.7).collect()] == [("", "", 1.0)]
    assert similar.by_edits(df.where("false"), df, 0.7).count() == 0
    with pytest.raises(ValueError):
        similar.by_blocks(df, df, 0.0)


def test_near_vectors_compare_a_falling_share_of_clustered_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    shares = []
    for n in (300, 1500):
        rows = [(f"v{i}", (centres[i % 12] + 0.35 * rng.normal(size=24)).tolist()) for i in range(n)]
        s = spark.createDataFrame(rows, "source_id string, embedding array<double>")
        work = spark.sparkContext.accumulator(0)
        got = candidates.near_vectors(s, s.withColumnRenamed("source_id", "actor_id"), same_ids=False, compared=work)
        x = np.array([r[1] for r in rows])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        cosine = x @ x.T
        np.fill_diagonal(cosine, -2)
        want = np.minimum(10, (cosine >= 0.65).sum(1)).sum()
        assert got.count() == want
        shares.append(work.value / n**2)
    assert shares[1] < shares[0] < 0.6 and shares[1] < 0.25


@pytest.mark.parametrize("tile", [7, 4096])
def test_near_vectors_equal_brute_force(spark, tile):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 12))
    vecs = [centres[i % 6] + 0.5 * rng.normal(size=12) for i in range(150)]
    rows = [(f"v{i:03d}", [float(x) for x in v]) for i, v in enumerate(vecs)]
    rows += [("zero", [0.0] * 12), ("short", [1.0, 2.0])]
    s = spark.createDataFrame(rows, "source_id string, embedding array<double>")
    c = spark.createDataFrame(rows, "actor_id string, embedding array<double>")
    got = {(r.source_id, r.candidate_id, r.rank) for r in candidates.near_vectors(
        s, c, top_k=5, tile_rows=tile, same_ids=False).collect()}
    want = set()
    for a, u in rows:
        hits = []
        for b, v in rows:
            nu, nv = np.linalg.norm(u), np.linalg.norm(v)
            if a == b or nu == 0 or nv == 0 or len(u) != len(v):
                continue
            cos = float(np.dot(u, v) / (nu * nv))
            if cos >= 0.65:
                hits.append((-round(cos, 4), b))
        want |= {(a, b, i + 1) for i, (_, b) in enumerate(sorted(hits)[:5])}
    assert got == want


def test_neighbour_overlap(spark):
    n = spark.createDataFrame(
        [("a", x) for x in ("w1", "w2", "w3", "p1")] + [("b", x) for x in ("w2", "p1", "q", "r")],
        "entity string, neighbour string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "nobody"), ("x", "y")], "a string, b string")
    out = {(r.a, r.b): r for r in candidates.neighbour_overlap(pairs, n).collect()}
    assert round(out["a", "b"].jaccard, 4) == 0.3333 and out["a", "b"].topological_match
    assert out["a", "b"].shared_neighbour_count == 2
    assert out["a", "nobody"].total_unique_neighbours == 4
    assert out["x", "y"].jaccard == 0.0 and not out["x", "y"].topological_match


def _overlap(spark, a, b, bucket=activity.HOUR_US):
    rows = [("a", t) for t in a] + [("b", t) for t in b]
    df = spark.createDataFrame(rows, "entity string, ts timestamp")
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    return activity.overlap(pairs, df, bucket).first()


def test_activity_gaps(spark):
    t = datetime(2026, 1, 1)
    near = _overlap(spark, [t], [t + timedelta(minutes=15)])
    assert near.min_proximity_minutes == 15.0 and near.overlap_detected
    far = _overlap(spark, [t], [t + timedelta(days=45)])
    assert far.contradiction and not far.overlap_detected
    none = _overlap(spark, [t, None], [])
    assert none.min_proximity_minutes is None and none.num_events_a == 2
    assert not none.contradiction


@pytest.mark.parametrize("bucket", [60_000_000, activity.HOUR_US, 10**15])
def test_activity_equals_all_pairs(spark, bucket):
    rng = random.Random(11)
    t = datetime(2026, 1, 1)
    a = [t + timedelta(seconds=rng.randrange(900_000)) for _ in range(40)]
    b = [t + timedelta(seconds=rng.randrange(900_000)) for _ in range(90)] + a[:3] * 2
    gaps = [abs((x - y).total_seconds()) / 60 for x in a for y in b]
    out = _overlap(spark, a, b, bucket)
    assert out.min_proximity_minutes == round(min(gaps), 2)
    assert out.mean_proximity_minutes == pytest.approx(sum(gaps) / len(gaps), abs=0.006)
    assert (out.num_events_a, out.num_events_b) == (len(a), len(b))


def test_clone_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = set(base)
    for v in base:
        for d in range(1, 6):
            w = v
            for bit in rng.sample(range(64), d):
                w ^= 1 << bit
            values.add(w)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = [(i, v) for i, v in enumerate(signed)] + [(10_000 + i, signed[0]) for i in range(50)]
    prints = spark.createDataFrame(rows, "doc_id long, simhash long")
    got = {frozenset((r.simhash_a, r.simhash_b)) for r in clones.clone_pairs(prints).collect()}
    want = {frozenset((a, b)) for a in signed for b in signed
            if a != b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert got == want
    assert len(clones.clone_pairs(prints).collect()) == len(want)


def test_clone_flag(spark):
    text = "the quick brown fox jumps over the lazy dog again and again " * 8
    docs = spark.createDataFrame([(1, text), (2, text + " extra"), (3, "nothing alike here"), (4, "")],
                                 "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (4, 4)], "left_id long, right_id long")
    out = {(r.left_id, r.right_id): r for r in clones.compare_pairs(
        pairs, clones.fingerprints(docs)).collect()}
    assert out[1, 2].similarity > 0.85
    assert out[1, 3].similarity < 0.85
    assert out[4, 4].is_clone


def test_components_equal_union_find(spark):
    rng = random.Random(9)
    edges = [(f"n{rng.randrange(120):03d}", f"n{rng.randrange(120):03d}") for _ in range(90)]
    edges += [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)]  # a long chain
    edges += [("hub", f"leaf{i}") for i in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    nodes = sorted({x for e in edges for x in e} | {"alone"})
    for seed in (1, 2):
        shuffled = edges[:]
        random.Random(seed).shuffle(shuffled)
        out = graph.components(spark.createDataFrame(shuffled, "src string, dst string"),
                               spark.createDataFrame([(n,) for n in nodes], "node string"))
        assert {r.node: r.root for r in out.collect()} == {n: find(n) for n in nodes}


def _tx(spark, rows):
    return spark.createDataFrame(
        [(f"t{i}", i, ins, outs, amount) for i, (ins, outs, amount) in enumerate(rows)],
        "txid string, tx_order long, inputs array<string>, outputs array<string>, amount double")


def test_owner_clusters(spark):
    tx = _tx(spark, [(["b", "a"], ["x"], 1.0), (["b", "c"], ["y"], 2.0), (["z"], ["a"], 1.0)])
    out = {r.address: r.cluster_id for r in finance.owner_clusters(tx).collect()}
    assert out["a"] == out["b"] == out["c"] == "cluster_btc_a"
    assert out["x"] == "cluster_btc_x" and out["z"] == "cluster_btc_z"


def test_trace_follows_the_queue(spark):
    rng = random.Random(4)
    names = [f"n{i}" for i in range(30)] + ["a_wasabi"]
    rows = [(rng.sample(names, 2), rng.sample(names, 3), 1.0) for _ in range(25)]
    visited, queue, want = {"n0"}, [("n0", 0)], []
    while queue:
        cur, hop = queue.pop(0)
        if hop >= 3:
            continue
        for i, (ins, outs, _) in enumerate(rows):
            if cur in ins:
                for o in outs:
                    if o not in visited:
                        visited.add(o)
                        queue.append((o, hop + 1))
                        want.append((cur, o, f"t{i}", hop + 1, "wasabi" in o))
    starts = spark.createDataFrame([("n0",)], "start string")
    out = finance.trace_hops(_tx(spark, rows), starts, 3).drop("start").collect()
    assert sorted(tuple(r) for r in out) == sorted(want)
    summary = finance.trace_summary(starts, finance.trace_hops(_tx(spark, rows), starts, 3)).first()
    assert summary.total_addresses_reached == len(visited)


def test_trace_of_an_unknown_start(spark):
    starts = spark.createDataFrame([("none",)], "start string")
    assert finance.trace_hops(_tx(spark, [(["a"], ["b"], 1.0)]), starts).count() == 0


def test_risk_and_pairs(spark):
    tx = _tx(spark, [(["cluster_btc_a"], ["wasabi_mixer"], 1.5), (["q"], ["wasabi_mixer"], 2.5)])
    row = finance.cluster_risk(tx, ["cluster_btc_a"]).first()
    assert (row.estimated_volume, row.mixer_exposure_count, row.risk_level) == (4.0, 2, "HIGH")
    clusters = spark.createDataFrame([("a", "k"), ("b", "k"), ("c", "m")],
                                     "address string, cluster_id string")
    pairs = spark.createDataFrame([("1", "a", "a"), ("2", "a", "b"), ("3", "a", "c"), ("4", "", "a")],
                                  "id string, address_a string, address_b string")
    out = {r.id: (r.match_type, r.abstain) for r in finance.pair_evidence(pairs, clusters).collect()}
    assert out == {"1": ("DIRECT_ADDRESS_REUSE", False), "2": ("UTXO_CO_INPUT_CLUSTER_MATCH", False),
                   "3": ("NO_MATCH", True), "4": ("EMPTY", True)}


def test_private_coin(spark):
    rows = spark.createDataFrame([("8" + "A" * 94, 16, "k"), ("4" + "a" * 94, 11, ""), ("x", 0, None)],
                                 "address string, ring_size int, key_image string")
    out = finance.classify_private_coin(rows).collect()
    assert [(r.valid_stealth_address, r.is_subaddress, r.privacy_score, r.key_image_present)
            for r in out] == [(True, True, .95, True), (True, False, .85, False),
                              (False, False, .1, False)]


def _ring(spark, n=12, extra=()):
    pairs = [(f"n{i}", f"n{(i + 1) % n}") for i in range(n)] + list(extra)
    return spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src string, dst string")


def test_walks_stay_on_edges_and_repeat(spark):
    edges = _ring(spark, 12, [("hub", f"n{i}") for i in range(12)])
    known = {(r.src, r.dst) for r in edges.collect()}
    for kw in ({}, {"p": 4.0, "q": 0.5}):
        walks = {r.walk_id: r.path for r in graph.random_walks(
            edges, num_walks=2, walk_length=7, **kw).collect()}
        again = {r.walk_id: r.path for r in graph.random_walks(
            edges, num_walks=2, walk_length=7, **kw).collect()}
        assert walks == again and len(walks) == 26
        for path in walks.values():
            assert len(path) == 7
            assert all((a, b) in known for a, b in zip(path, path[1:]))


def test_return_weight_discourages_turning_back(spark):
    def backs(p):
        paths = [r.path for r in graph.random_walks(
            _ring(spark, 20), num_walks=12, walk_length=8, p=p, q=1.0, seed=1).collect()]
        return sum(a == c for w in paths for a, c in zip(w, w[2:])) / sum(len(w) - 2 for w in paths)

    assert backs(50.0) < 0.1 < 0.8 < backs(0.02)


def test_walkers_on_a_hub_draw_by_offer(spark, monkeypatch):
    monkeypatch.setattr(graph, "OFFERS", 2)  # several rounds of offers
    edges = _ring(spark, 10, [("hub", f"n{i}") for i in range(10)])
    known = {(r.src, r.dst) for r in edges.collect()}
    walks = graph.random_walks(edges, num_walks=1, walk_length=5, p=3.0, q=2.0).collect()
    assert len(walks) == 11
    assert all(len(r.path) == 5 and all(e in known for e in zip(r.path, r.path[1:])) for r in walks)


def test_neighbours_are_numbered_without_gaps_in_slabs(spark):
    edges = spark.createDataFrame([("h", f"x{i}") for i in range(97)], "src string, dst string")
    idx = sorted(r.idx for r in graph.indexed_neighbours(edges, slab=10).collect())
    assert idx == list(range(97))


def test_dead_ends_stop(spark):
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert [r.path for r in graph.random_walks(edges, 1, 5).collect()] == [["a", "b"]]
    assert [r.path for r in graph.random_walks(edges, 1, 5, 4.0, 0.5).collect()] == [["a", "b"]]


def test_embeddings_have_unit_length(spark):
    walks = graph.random_walks(_ring(spark), 2, 10)
    rows = graph.embed(walks).collect()
    assert len(rows) == 12
    assert all(math.isclose(sum(x * x for x in r.vector), 1.0) for r in rows)


def test_node_pairs(spark):
    emb = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.8, 0.6]), ("z", [0.0, 0.0])],
                                "node string, vector array<double>")
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "gone"), ("a", "z")],
                                  "a string, b string")
    out = {r.b: r for r in graph.score_pairs(pairs, emb).collect()}
    assert (out["a"].m_i, out["b"].m_i, out["z"].m_i) == (0.90, 0.75, 0.20)
    assert out["gone"].abstain and out["gone"].llr == 0.0 and out["gone"].link_probability is None
    assert out["z"].link_probability == 0.5 and out["z"].euclidean_distance == 2.0


def test_walks_keep_names_with_separators(spark):
    names = ["a\u0001b", "\u0002A", "", "\u0001", "x\u0002"]
    edges = spark.createDataFrame(
        [e for i, n in enumerate(names) for e in ((n, names[i - 1]), (names[i - 1], n))],
        "src string, dst string",
    )
    for p, q in ((1.0, 1.0), (4.0, 0.5)):
        walks = graph.random_walks(edges, 2, 6, p, q).collect()
        assert len(walks) == 2 * len(names)
        for r in walks:
            assert len(r.path) == 6 and set(r.path) <= set(names)
            assert r.walk_id.rsplit("#", 1)[0] == r.path[0]


def test_refused_walkers_arrive(spark):
    """Ways back and out weigh next to nothing: whole batches of offers are refused."""
    edges = spark.createDataFrame([(a, b) for a in "hub" for b in "hub" if a != b] + [
        (f"l{i}", "h") for i in range(40)] + [("h", f"l{i}") for i in range(40)], "src string, dst string")
    walks = graph.random_walks(edges, 3, 5, 50.0, 50.0).collect()
    assert len(walks) == 3 * 43 and {len(r.path) for r in walks} == {5}
    ways = {(r.src, r.dst) for r in edges.collect()}
    assert all(step in ways for r in walks for step in zip(r.path, r.path[1:]))


def test_earlier_walk_tables_are_removed(spark):
    import os

    from linkweave.session import shared_folder

    before = set(os.listdir(shared_folder(spark)))
    graph.random_walks(_ring(spark), 2, 12, 4.0, 0.5).collect()
    # the neighbours and the last round
    assert len(set(os.listdir(shared_folder(spark))) - before) == 2


def test_vectors_are_summed_without_counted_pairs(spark):
    walks = graph.random_walks(_ring(spark), 2, 10)
    plan = graph.embed(walks)._jdf.queryExecution().toString()
    assert "context" not in plan


@pytest.mark.parametrize("window", [1, 3, 4])
def test_digests_around_a_node_travel_as_counts(spark, window):
    import hashlib

    rng = random.Random(4)
    paths = [[rng.choice("abcdefg") for _ in range(n)] for n in (1, 2, 3, 9, 9, 30)] + [["lone"]]
    walks = spark.createDataFrame([(p,) for p in paths], "path array<string>")
    rows = graph.embed(walks, window)
    assert "around" not in rows._jdf.queryExecution().toString()
    want = {}
    for p in paths:
        for i, node in enumerate(p):
            for j in range(max(0, i - window), min(len(p), i + window + 1)):
                if j != i:
                    h = int(hashlib.md5(p[j].encode()).hexdigest()[:16], 16)
                    sums = want.setdefault(node, np.zeros(64))
                    sums += [2 * (h >> b & 1) - 1 for b in range(64)]
    got = {r.node: r.vector for r in rows.collect()}
    assert set(got) == set(want)
    for node, sums in want.items():
        assert got[node] == pytest.approx(sums / max(np.sqrt((sums**2).sum()), 1e-9))


def test_signals_of_busy_keys_are_never_gathered_by_pair(spark):
    rng = random.Random(9)
    kind = "string, fingerprint string, handle string, embedding array<double>, favicon_hash string"

    def profile(i):
        return (f"p{i:03d}", rng.choice(["ab CD", "ABCD", "x", "", None]),
                rng.choice(["silverfox", "silver_fox", " Silverfox", "greenhill", "", "  ", None]),
                rng.choice([None, [rng.random() - 0.5 for _ in range(6)]]), rng.choice(["0", "7", " 7", "-3", None]))

    rows = [profile(i) for i in range(60)]
    s = spark.createDataFrame(rows[:40], "source_id " + kind)
    c = spark.createDataFrame(rows[20:], "actor_id " + kind)
    got = candidates.multi_signal_search(s, c, 5, tile=3)
    want = candidates._gathered(s, c, candidates.near_vectors(s, c, 5).drop("rank"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan.split("Scan")[0] and "rangepartitioning" not in plan
    show = ["source_id", "candidate_id", "max_score", "n_matches", "matches"]
    assert sorted(map(repr, got.select(*show).collect())) == sorted(map(repr, want.select(*show).collect()))
    # an id with two profiles is one candidate
    twice = c.unionByName(spark.createDataFrame([("p020", "x", "greenhill", None, "7")], "actor_id " + kind))
    pairs = [(r.source_id, r.candidate_id) for r in candidates.multi_signal_search(s, twice, 5).collect()]
    assert len(pairs) == len(set(pairs))


def test_near_vectors_make_angles_and_visits_in_pieces(spark, monkeypatch):
    from linkweave.operators import nearest

    monkeypatch.setattr(nearest, "ANGLES", 64)
    rng = np.random.default_rng(3)
    pivots = nearest.Pivots(rng.normal(size=(20, 4)).tolist())
    rows = list(rng.normal(size=(50, 4)))
    pieces = [a.shape for _, _, a in pivots.angles(pd.Series(rows))]
    assert max(n * k for n, k in pieces) <= 64 and sum(n for n, _ in pieces) == 50


def test_near_vectors_keep_no_rows_as_objects(spark):
    """The first pass is written in columns, and its shuffle files go before the second."""
    rng = random.Random(2)
    s = spark.createDataFrame([(f"v{i}", [rng.random() - 0.5 for _ in range(6)]) for i in range(40)],
                              "source_id string, embedding array<double>")
    got = candidates.near_vectors(s, s.withColumnRenamed("source_id", "actor_id"), 3, same_ids=False)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "LogicalRDD" not in plan


def test_near_vectors_hand_on_few_of_many_copies(spark):
    from linkweave.operators import nearest

    rows = [(f"v{k:03d}", [1.0, 2.0, 3.0]) for k in range(150)] + [("w", [1.0, 2.0, 2.9]), ("x", [-1.0, 0.0, 0.0])]
    s = spark.createDataFrame(rows, "source_id string, embedding array<double>")
    c = s.withColumnRenamed("source_id", "actor_id")
    assert nearest.near_pairs(s, c, 3, 0.65, 4096, False).count() <= 2 * 152 * 12
    got = {(r.source_id, r.candidate_id, r.rank) for r in candidates.near_vectors(s, c, 3, same_ids=False).collect()}
    ids = [r[0] for r in rows[:150]]
    want = {(i, o, k) for i in ids for k, o in enumerate([o for o in ids if o != i][:3], 1)}
    assert got == want | {("w", o, k) for k, o in enumerate(ids[:3], 1)}


def test_transactions_are_derived_once_and_written(spark, monkeypatch):
    from linkweave.plans import derive
    from linkweave.plans.catalog import graphs

    made, seen = [], []
    derived, clusters, traced = derive.transactions, finance.owner_clusters, finance.trace_hops
    monkeypatch.setattr(derive, "transactions", lambda *a: made.append(a) or derived(*a))
    monkeypatch.setattr(finance, "owner_clusters", lambda tx: seen.append(tx) or clusters(tx))
    monkeypatch.setattr(finance, "trace_hops", lambda tx, *a: seen.append(tx) or traced(tx, *a))
    graphs.hop_trace_summary(spark, "/root/testdata/sf0.001")
    graphs.wallet_pair_evidence(spark, "/root/testdata/sf0.001")
    assert len(made) == 2 and all(hasattr(tx, "_working_path") for tx in seen)

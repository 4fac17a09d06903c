"""Property graph of the ledger: projection, shared-identifier map, ego views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.operators import ranking
from linkweave.operators.reads import first_by

NODE = ["id", "label", "type", "detail"]
EDGE = ["id", "src", "dst", "label", "confidence"]


def _nodes(rows: DataFrame, id_: str, label: str, kind: str, detail: str = "NULL") -> DataFrame:
    return rows.selectExpr(
        f"{id_} AS id", f"{label} AS label", f"'{kind}' AS type",
        f"CAST({detail} AS STRING) AS detail",
    )


def _edges(rows: DataFrame, id_: str, src: str, dst: str, label: str, conf: str) -> DataFrame:
    return rows.selectExpr(
        f"{id_} AS id", f"{src} AS src", f"{dst} AS dst", f"{label} AS label",
        f"CAST({conf} AS DOUBLE) AS confidence",
    )


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def project(ledger: dict[str, DataFrame], hypotheses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and typed edges of the whole ledger.

    An edge exists only where both of its ends do; an alias without its actor is not
    projected at all.
    """
    who = ledger["actors"].select("actor_id")
    aliases = ledger["aliases"].join(who, "actor_id", "left_semi")
    owned = lambda name: ledger[name].join(who, "actor_id", "left_semi")
    nodes = union(
        _nodes(ledger["actors"], "actor_id", "primary_alias", "Actor", "category"),
        _nodes(aliases, "alias_id", "value", "Alias", "coalesce(platform, 'Unknown')"),
        _nodes(ledger["pgp_keys"], "key_row_id", "key_id", "PGPKey", "fingerprint"),
        _nodes(ledger["wallets"], "wallet_id", "address", "Wallet",
               "coalesce(cluster_id, 'Unclustered')"),
        _nodes(ledger["services"], "service_id", "coalesce(title, 'Onion Service')",
               "OnionService", "coalesce(favicon_hash, 0)"),
    )
    ends = hypotheses.join(who.withColumnRenamed("actor_id", "subject_id"), "subject_id",
                           "left_semi").join(
        who.withColumnRenamed("actor_id", "object_id"), "object_id", "left_semi")
    edges = union(
        _edges(aliases, "concat('uses:', alias_id)", "actor_id", "alias_id",
               "'ACTOR_USES_ALIAS'", "confidence"),
        _edges(owned("pgp_keys"), "concat('pgp:', key_row_id)", "actor_id", "key_row_id",
               "'ACCOUNT_USES_PGP'", "0.99"),
        _edges(owned("wallets"), "concat('wallet:', wallet_id)", "actor_id", "wallet_id",
               "'ACCOUNT_USES_WALLET'", "0.90"),
        _edges(ends, "concat('hyp:', hypothesis_id)", "subject_id", "object_id",
               "'ACTOR_POSSIBLY_SAME_AS_ACTOR'", "calibrated_prob"),
    )
    return nodes, edges


def projection_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.groupBy(F.col("type").alias("figure")).agg(F.count(F.lit(1)).alias("n")).unionByName(
        edges.groupBy(F.col("label").alias("figure")).agg(F.count(F.lit(1)).alias("n"))
    )


def shared_map(
    ledger: dict[str, DataFrame], hypotheses: DataFrame, include_singletons: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Actors joined by the identifiers they share, identifiers merged by value."""
    keep = "true" if include_singletons else "shared_by > 1"
    who = ledger["actors"].select("actor_id")
    al = ledger["aliases"].join(who, "actor_id", "left_semi").withColumn(
        "node_value", F.lower(F.trim("value"))
    )
    per_owner = al.groupBy("node_value", "actor_id").agg(
        F.min(F.struct("alias_id", "value")).alias("f")
    )
    handles = per_owner.groupBy("node_value").agg(
        F.count(F.lit(1)).alias("shared_by"), F.min("f").alias("f")
    ).where(keep)
    wl = ledger["wallets"].where("cluster_id IS NOT NULL").join(who, "actor_id", "left_semi")
    per_holder = wl.groupBy("cluster_id", "actor_id").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("chain").alias("chains")
    )
    clusters = per_holder.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("shared_by"),
        F.sum("n").alias("n"),
        F.array_join(
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("chains")))), ", "
        ).alias("chains"),
    ).where(keep)
    nodes = union(
        _nodes(ledger["actors"], "actor_id", "primary_alias", "Actor", "category").selectExpr(
            "*", "0L AS shared_by"),
        handles.selectExpr(
            "concat('handle::', node_value) AS id", "f.value AS label",
            "CASE WHEN shared_by > 1 THEN 'SharedHandle' ELSE 'Alias' END AS type",
            "CAST(NULL AS STRING) AS detail", "shared_by"),
        clusters.selectExpr(
            "concat('wallet::', cluster_id) AS id", "cluster_id AS label",
            "CASE WHEN shared_by > 1 THEN 'SharedWallet' ELSE 'Wallet' END AS type",
            "concat(n, ' addresses / ', chains) AS detail", "shared_by"),
    )
    ends = hypotheses.join(who.withColumnRenamed("actor_id", "subject_id"), "subject_id",
                           "left_semi").join(
        who.withColumnRenamed("actor_id", "object_id"), "object_id", "left_semi")
    edges = union(
        _edges(al.join(handles.select("node_value"), "node_value", "left_semi"),
               "concat('e_h_', alias_id)", "actor_id", "concat('handle::', node_value)",
               "'USES_HANDLE'", "confidence"),
        _edges(per_holder.join(clusters.select("cluster_id"), "cluster_id", "left_semi"),
               "concat('e_w_', cluster_id, '_', actor_id)", "actor_id",
               "concat('wallet::', cluster_id)", "'CONTROLS_WALLET_CLUSTER'", "0.90"),
        _edges(ends, "concat('hyp_', hypothesis_id)", "subject_id", "object_id", "status",
               "calibrated_prob"),
    )
    if include_singletons:
        keys = ledger["pgp_keys"].join(who, "actor_id", "left_semi")
        nodes = union(nodes, _nodes(keys, "concat('pgp::', fingerprint)", "key_id",
                                    "PGPKey").selectExpr("*", "1L AS shared_by"))
        edges = union(edges, _edges(keys, "concat('e_k_', key_row_id)", "actor_id",
                                    "concat('pgp::', fingerprint)", "'USES_PGP'", "0.99"))
    return nodes, edges


def map_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.agg(
        F.count_if(F.col("type") == "Actor").alias("actors"), F.count(F.lit(1)).alias("nodes")
    ).withColumn("_one", F.lit(1))
    b = edges.agg(F.count(F.lit(1)).alias("edges")).withColumn("_one", F.lit(1))
    return a.join(b, "_one").drop("_one")


# --- ego views -------------------------------------------------------------------------------


def link_pairs(hypotheses: DataFrame, actors: DataFrame) -> DataFrame:
    """Undirected pairs of distinct known actors joined by some link: ``lo, hi``."""
    who = actors.select("actor_id")
    return (
        hypotheses.where("subject_id <> object_id")
        .selectExpr("least(subject_id, object_id) AS lo", "greatest(subject_id, object_id) AS hi")
        .distinct()
        .join(who.withColumnRenamed("actor_id", "lo"), "lo", "left_semi")
        .join(who.withColumnRenamed("actor_id", "hi"), "hi", "left_semi")
        .select("lo", "hi")
    )


def triangles(pairs: DataFrame) -> DataFrame:
    """All triangles ``x, y, z`` of an undirected pair list.

    Each pair points from its end of lower degree to the higher. A node then points to
    few others even if it is a hub, so the two-step paths stay near the number of pairs
    to the power 1.5 instead of the hub's degree squared.
    """
    ends = pairs.selectExpr("lo AS n").unionAll(pairs.selectExpr("hi AS n"))
    degree = ends.groupBy("n").agg(F.count(F.lit(1)).alias("d"))
    sized = pairs.join(degree.selectExpr("n AS lo", "d AS d_lo"), "lo").join(
        degree.selectExpr("n AS hi", "d AS d_hi"), "hi"
    )
    up = "d_lo < d_hi OR (d_lo = d_hi AND lo < hi)"
    arcs = sized.selectExpr(
        f"CASE WHEN {up} THEN lo ELSE hi END AS x", f"CASE WHEN {up} THEN hi ELSE lo END AS y"
    )
    wedges = arcs.join(arcs.selectExpr("x", "y AS z"), "x").where("y < z")
    return wedges.join(
        pairs.selectExpr("lo AS y", "hi AS z"), ["y", "z"], "left_semi"
    ).select("x", "y", "z")


def peer_links(hypotheses: DataFrame, actors: DataFrame) -> DataFrame:
    """Links between two neighbours of an actor: ``ego, hypothesis_id``."""
    t = triangles(link_pairs(hypotheses, actors))
    sides = union(
        t.selectExpr("x AS ego", "y AS lo", "z AS hi"),
        t.selectExpr("y AS ego", "least(x, z) AS lo", "greatest(x, z) AS hi"),
        t.selectExpr("z AS ego", "least(x, y) AS lo", "greatest(x, y) AS hi"),
    )
    keyed = hypotheses.selectExpr(
        "hypothesis_id", "least(subject_id, object_id) AS lo",
        "greatest(subject_id, object_id) AS hi",
    )
    return sides.join(keyed, ["lo", "hi"]).select("ego", "hypothesis_id")


def ego_views(
    ledger: dict[str, DataFrame], hypotheses: DataFrame, egos: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Ego graphs of the asked actors (``actor_id``), or of all actors in one job.

    An ego view holds the actor, its identifiers, the actors it is linked to, those
    links, and the links among its neighbours. Repeats are merged by id.
    """
    actors = ledger["actors"]

    def asked(rows: DataFrame, key: str = "actor_id") -> DataFrame:
        if egos is None:
            return rows
        return rows.join(egos.select(F.col("actor_id").alias(key)), key, "left_semi")

    def own(name: str, id_: str, label: str, kind: str, rel: str, conf: str):
        rows = asked(ledger[name].join(actors.select("actor_id"), "actor_id", "left_semi"))
        return (
            rows.selectExpr("actor_id AS ego", f"{id_} AS id", f"{label} AS label",
                            f"'{kind}' AS type"),
            rows.selectExpr("actor_id AS ego", f"concat('edge_', {id_}) AS id",
                            "actor_id AS src", f"{id_} AS dst", f"'{rel}' AS label",
                            f"CAST({conf} AS DOUBLE) AS confidence"),
        )

    from linkweave.operators.reads import directed_links

    links = asked(
        directed_links(hypotheses)
        .join(actors.select("actor_id"), "actor_id", "left_semi")
        .join(actors.selectExpr("actor_id AS counterpart_id", "primary_alias AS other"),
              "counterpart_id")
    )
    identifier = [
        own("aliases", "alias_id", "value", "Alias", "ACTOR_USES_ALIAS", "confidence"),
        own("pgp_keys", "key_row_id", "key_id", "PGPKey", "ACCOUNT_USES_PGP", "0.99"),
        own("wallets", "wallet_id", "concat(substr(address, 1, 10), '...')", "Wallet",
            "ACCOUNT_USES_WALLET", "0.90"),
    ]
    nodes = union(
        asked(actors).selectExpr("actor_id AS ego", "actor_id AS id", "primary_alias AS label",
                                 "'Actor' AS type"),
        *[n for n, _ in identifier],
        links.selectExpr("actor_id AS ego", "counterpart_id AS id", "other AS label",
                         "'LinkedActor' AS type").distinct(),
    )
    shape = ["'hyp_' || hypothesis_id AS id", "subject_id AS src", "object_id AS dst",
             "status AS label", "CAST(calibrated_prob AS DOUBLE) AS confidence"]
    peers = asked(peer_links(hypotheses, actors).withColumnRenamed("ego", "actor_id"))
    edges = union(
        *[e for _, e in identifier],
        links.selectExpr("actor_id AS ego", *shape),
        peers.join(hypotheses, "hypothesis_id").selectExpr("actor_id AS ego", *shape),
    )
    return first_by(nodes, ["ego", "id"], ["type"]), first_by(edges, ["ego", "id"], ["src"])


def ranked_edges(edges: DataFrame) -> DataFrame:
    """Each node's edges with their ``position``, strongest first; hubs are split as well."""
    both = union(
        edges.selectExpr("src AS node", "dst AS peer", "id", "label", "confidence"),
        edges.where("src <> dst").selectExpr("dst AS node", "src AS peer", "id", "label",
                                             "confidence"),
    )
    return ranking.positions(both, "node", ["_weight", "id"], {"_weight": -F.col("confidence")})


def closed_neighbourhood(nodes: DataFrame, edges: DataFrame, term: str) -> DataFrame:
    """Nodes whose label or detail holds the text, and everything next to them."""
    from linkweave.operators.reads import contains_term

    hits = nodes.where(contains_term("label", term) | contains_term("detail", term)).select("id")
    near = union(
        edges.join(hits.withColumnRenamed("id", "src"), "src", "left_semi").select(
            F.col("dst").alias("id")),
        edges.join(hits.withColumnRenamed("id", "dst"), "dst", "left_semi").select(
            F.col("src").alias("id")),
    ).distinct()
    marked = hits.withColumn("matched", F.lit(True)).unionByName(
        near.join(hits, "id", "left_anti").withColumn("matched", F.lit(False))
    )
    return nodes.join(marked, "id")


# --- components and traces ------------------------------------------------------------------------


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of each connected component.

    Alternating stars: every node hangs its larger neighbours on the smallest node it
    knows, then its smaller ones, until nothing changes. The number of rounds grows with
    the logarithm of the graph, not with its diameter; minima combine on the map side;
    each round is written out reliably.
    """
    from linkweave.session import stored

    e = stored(
        edges.selectExpr("greatest(src, dst) AS u", "least(src, dst) AS v").where("u <> v").distinct()
    )
    last = None
    while True:
        both = e.unionAll(e.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.join(low, "u").where("v > u").selectExpr("v AS u", "m AS v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").selectExpr("v AS u", "m AS v")
        e = stored(small.unionAll(least.selectExpr("u", "m AS v")).distinct(), e)
        now = e.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == last:
            break
        last = now
    return (
        nodes.select("node")
        .distinct()
        .join(e.selectExpr("u AS node", "v AS root"), "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )


# --- walks and embeddings ----------------------------------------------------------------------------

SLAB = 10_000


def indexed_neighbours(edges: DataFrame, slab: int = SLAB) -> DataFrame:
    """``src, idx, dst, deg, dst_deg``: every node's neighbours numbered from 0.

    Neighbours of a hub are numbered inside slabs of bounded size and the slabs are
    strung together, so no task sorts a hub's whole list.
    """
    from pyspark.sql import Window

    pairs = edges.select("src", "dst").distinct()
    degree = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    cut = pairs.join(degree, "src").withColumn(
        "slab", F.expr(f"pmod({draw('dst')}, CAST(ceil(deg / {slab}) AS BIGINT))")
    )
    inside = Window.partitionBy("src", "slab").orderBy("dst")
    sizes = cut.groupBy("src", "slab").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("src").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "src", "slab", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("o")
    )
    numbered = cut.withColumn("i", F.row_number().over(inside) - 1).join(offsets, ["src", "slab"])
    return numbered.join(
        degree.selectExpr("src AS dst", "deg AS dst_deg"), "dst", "left"
    ).selectExpr("src", "i + o AS idx", "dst", "deg", "dst_deg")


def draw(*salt: str) -> str:
    """SQL of a number from the digest of its salt: the same in every run and engine."""
    return f"CAST(conv(substr(md5(concat_ws('/', {', '.join(salt)})), 1, 15), 16, 10) AS BIGINT)"


def random_walks(
    edges: DataFrame,
    num_walks: int = 10,
    walk_length: int = 20,
    p: float = 1.0,
    q: float = 1.0,
    seed: int = 42,
) -> DataFrame:
    """``walk_id, path``: second-order random walks from every node with neighbours.

    A walker draws a neighbour's number and joins on (node, number), so walkers standing
    on a hub never meet its whole list. Draws come from digests of seed, walk, step and
    attempt: a task run again draws the same. With return and in-out weights a drawn
    step is accepted in proportion to its weight, and refused walkers draw again.
    """
    from linkweave.session import stored

    table = stored(indexed_neighbours(edges))
    walks = table.select("src", "deg").distinct().selectExpr(
        "src AS node", "deg", f"explode(sequence(1, {num_walks})) AS n"
    ).selectExpr("concat(node, '#', n) AS walk_id", "node", "deg", f"{_packed('node')} AS path")
    if p == q == 1.0:
        walks = _plain_steps(walks, table, walk_length, seed)
    else:
        walks = _weighted_steps(walks, table, walk_length, seed, p, q)
    return walks.selectExpr("walk_id", f"{_UNPACKED} AS path")


# A path travels as one string: a name of a few letters takes its letters and a separator, not
# 24 bytes of an array. Separators inside names are written as an escape and a letter.
_SEP, _ESC = r"'\u0001'", r"'\u0002'"


def _packed(name: str) -> str:
    return (
        f"replace(replace({name}, {_ESC}, concat({_ESC}, 'B')), {_SEP}, concat({_ESC}, 'A'))"
    )


_UNPACKED = (
    f"transform(split(path, {_SEP}, -1), x -> "
    f"replace(replace(x, concat({_ESC}, 'A'), {_SEP}), concat({_ESC}, 'B'), {_ESC}))"
)
_LONGER = f"concat(path, {_SEP}, {_packed('dst')})"


def _plain_steps(walks, table, walk_length, seed):
    from linkweave.session import stored

    step_table = table.selectExpr("src AS node", "idx", "dst", "dst_deg")
    kept = None
    for step in range(1, walk_length):
        drawn = walks.withColumn(
            "idx", F.expr(f"pmod({draw(repr(str(seed)), "walk_id", repr(str(step)), repr("0"))}, deg)")
        )
        # a walker on a node without ways out stays there
        walks = drawn.join(step_table, ["node", "idx"], "left").selectExpr(
            "walk_id", "coalesce(dst, node) AS node", "dst_deg AS deg",
            f"CASE WHEN dst IS NULL THEN path ELSE {_LONGER} END AS path",
        )
        if step % 5 == 0:
            walks = kept = stored(walks, kept)
    return walks


OFFERS = 32


def _weighted_steps(walks, table, walk_length, seed, p, q):
    """Second-order steps: weight 1/p back, 1 to a common neighbour, 1/q elsewhere.

    Drawn neighbours are accepted in proportion to their weights; an only neighbour is taken
    at once. A round makes one draw for every walker; the few refused ones get ``OFFERS`` more
    at the start of the next. Who is still refused then goes on from there, so walkers may be
    at different steps; rounds end when all have arrived. Every draw succeeds with a chance of
    at least the least weight over the largest. One table is written per round.
    """
    from linkweave.session import stored

    step_table = table.selectExpr("src AS node", "idx", "dst", "dst_deg")
    known = table.selectExpr("src AS prev", "dst", "true AS near")
    weight = f"CASE WHEN dst = prev THEN {1.0 / p}D WHEN near THEN 1D ELSE {1.0 / q}D END"
    key = [repr(str(seed)), "walk_id", "CAST(step AS STRING)", "CAST(attempt AS STRING)"]
    luck = f"(pmod({draw(*key, repr('accept'))}, 1000003) + 1) / 1000004D"
    taken = f"deg = 1 OR {luck} * {max(1.0, 1.0 / p, 1.0 / q)}D < {weight}"
    state = ["walk_id", "node", "deg", "prev", "path", "step", "attempt"]
    moved = ["walk_id", "dst AS node", "dst_deg AS deg", "node AS prev", f"{_LONGER} AS path",
             "step + 1 AS step", "0 AS attempt"]

    def drawn(rows):
        return rows.selectExpr("*", f"pmod({draw(*key)}, deg) AS idx").join(step_table, ["node", "idx"])

    first = walks.selectExpr("*", "CAST(NULL AS STRING) AS prev", "1 AS step", "0 AS attempt")
    if walk_length < 2:
        return first.select("walk_id", "path")
    # the first step has no way back: every draw is taken
    rows = kept = stored(drawn(first.where("deg IS NOT NULL")).selectExpr(*moved))
    # a walker on a node without ways out stays there
    arrived = f"step >= {walk_length} OR deg IS NULL"
    made = 1
    while made < walk_length - 1 or not rows.where(f"NOT ({arrived})").isEmpty():
        going = rows.where(f"NOT ({arrived})")
        refused = going.where("attempt > 0")
        offers = refused.selectExpr(
            *[c for c in state if c != "attempt"],
            f"explode(sequence(attempt, attempt + {OFFERS - 1})) AS attempt",
        )
        best = (
            drawn(offers)
            .join(known, ["prev", "dst"], "left")
            .where(taken)
            .groupBy("walk_id")
            .agg(F.expr("min_by(struct(dst, dst_deg), attempt) AS s"))
        )
        settled = refused.join(best, "walk_id", "left").selectExpr(
            *state[:-1], f"attempt + {OFFERS} AS attempt", "s.dst AS dst", "s.dst_deg AS dst_deg", "s"
        )
        done = settled.where("s IS NOT NULL").selectExpr(*moved)
        still = settled.where("s IS NULL").select(*state)
        ready = union(going.where("attempt = 0").select(*state), done, still)
        judged = (
            drawn(ready.where(f"NOT ({arrived})"))
            .join(known, ["prev", "dst"], "left")
            .selectExpr("*", f"coalesce({taken}, false) AS ok")
        )
        after = judged.selectExpr(
            "walk_id",
            "CASE WHEN ok THEN dst ELSE node END AS node",
            "CASE WHEN ok THEN dst_deg ELSE deg END AS deg",
            "CASE WHEN ok THEN node ELSE prev END AS prev",
            f"CASE WHEN ok THEN {_LONGER} ELSE path END AS path",
            "CASE WHEN ok THEN step + 1 ELSE step END AS step",
            "CASE WHEN ok THEN 0 ELSE attempt + 1 END AS attempt",
        )
        rows = kept = stored(
            union(after, ready.where(arrived), rows.where(arrived).select(*state)), kept
        )
        made += 1
    return rows


def context_pairs(walks: DataFrame, window: int = 3) -> DataFrame:
    """Node and neighbour within ``window`` steps, for every position of every walk."""
    around = (
        f"concat(slice(path, greatest(i - {window}, 1), i - greatest(i - {window}, 1)), "
        f"slice(path, i + 1, {window}))"
    )
    return walks.selectExpr(
        "explode(transform(sequence(1, size(path)), i -> "
        f"struct(element_at(path, i) AS node, {around} AS around))) AS s"
    ).selectExpr("s.node", "explode(s.around) AS context")


SLABS = 8


def embed(walks: DataFrame, window: int = 3) -> DataFrame:
    """``node, vector``: 64 unit-length dimensions from the company a node keeps.

    Counts of context nodes are projected on fixed random signs, one per bit of the
    context's digest, as in very sparse random projection. Nodes with like contexts get
    like vectors; nothing is trained on the driver and the result is repeatable.

    A position travels once, as the counts of ones in the digests around it, and is summed where
    it arrives, first per node and slab of its positions, so a hub's are spread over ``SLABS``
    tasks. The counts of 64 bits lie in a few whole numbers, their binary places: three for six
    digests. Pairs are never counted or shuffled, nor half-filled sums of every node from every task.
    """
    around = (
        f"concat(slice(h, greatest(i - {window}, 1), i - greatest(i - {window}, 1)), "
        f"slice(h, i + 1, {window}))"
    )
    digests = "transform(path, x -> CAST(conv(substr(md5(x), 1, 16), 16, -10) AS BIGINT)) AS h"
    places = range((2 * window).bit_length())
    carry, added = "x", []
    for k in places:
        added.append(f"a.p{k} ^ {carry} AS p{k}")
        carry = f"(a.p{k} & {carry})"
    zero = "struct(" + ", ".join(f"0L AS p{k}" for k in places) + ")"
    counted = f"aggregate({around}, {zero}, (a, x) -> struct({', '.join(added)}))"
    positions = walks.selectExpr("path", digests, "size(path) AS n").selectExpr(
        f"explode(transform(sequence(1, n), i -> struct(element_at(path, i) AS node, {counted} AS c, "
        f"least(i - 1, {window}) + least(n - i, {window}) AS near))) AS s"
    ).where("s.near > 0").selectExpr("s.node", "s.c.*", "s.near")
    slab = f"pmod(xxhash64({', '.join(f'p{k}' for k in places)}), {SLABS}) AS slab"
    ones = lambda i: " + ".join(f"(shiftrightunsigned(p{k}, {i}) & 1L) * {1 << k}" for k in places)
    sums = (
        positions.selectExpr("*", slab)
        .repartition("node", "slab")
        .groupBy("node", "slab")
        .agg(*[F.expr(f"sum(2 * ({ones(i)}) - near) AS d{i}") for i in range(64)])
    )
    dims = sums.groupBy("node").agg(*[F.expr(f"sum(d{i}) AS d{i}") for i in range(64)])
    raw = dims.selectExpr(
        "node", "array(" + ", ".join(f"CAST(d{i} AS DOUBLE)" for i in range(64)) + ") AS v"
    )
    return raw.selectExpr(
        "node", "v", "sqrt(aggregate(v, 0D, (a, x) -> a + x * x)) AS norm"
    ).selectExpr(
        "node", "CASE WHEN norm = 0 THEN v ELSE transform(v, x -> x / norm) END AS vector"
    )


def score_pairs(pairs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Link evidence for node pairs (``a, b``): similarity, distance, likelihoods.

    A missing vector abstains; vectors without length or of other sizes are neutral.
    """
    from linkweave.functions import vectors

    side = lambda n: embeddings.select(
        F.col("node").alias(n), F.col("vector").alias(f"v_{n}"))
    rows = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    unlike = (
        f"size(v_a) <> size(v_b) OR {vectors.norm_sql('v_a')} = 0 OR {vectors.norm_sql('v_b')} = 0"
    )
    return (
        rows.selectExpr("*", "v_a IS NULL OR v_b IS NULL AS abstain")
        .selectExpr("*", f"NOT abstain AND ({unlike}) AS neutral")
        .selectExpr(
            "a", "b", "abstain", "neutral",
            f"CASE WHEN neutral THEN 0D WHEN NOT abstain THEN {vectors.cosine_sql('v_a', 'v_b')} "
            "END AS cos",
            f"CASE WHEN neutral THEN 2D WHEN NOT abstain THEN {vectors.distance_sql('v_a', 'v_b')}"
            " END AS dist",
        )
        .selectExpr(
            "a", "b", "'graph_topological_distance' AS feature_name",
            "'INFRASTRUCTURE' AS family", "'graph_topology' AS dependence_group", "abstain",
            "round(cos, 4) AS cosine_similarity", "round(dist, 4) AS euclidean_distance",
            # least() and greatest() skip NULL
            "CASE WHEN cos IS NOT NULL THEN round(greatest(0D, least(1D, (cos + 1D) / 2D)), 4) "
            "END AS link_probability",
            "NOT neutral AND coalesce(cos >= 0.70, false) AS link_detected",
        )
        .selectExpr(
            "*",
            "CASE WHEN abstain THEN 0.80D WHEN cosine_similarity >= 0.85 THEN 0.90D "
            "WHEN cosine_similarity >= 0.65 THEN 0.75D ELSE 0.20D END AS m_i",
            "CASE WHEN abstain THEN 0.10D WHEN cosine_similarity >= 0.85 THEN 0.005D "
            "WHEN cosine_similarity >= 0.65 THEN 0.05D ELSE 0.40D END AS u_i",
            "CASE WHEN abstain THEN 0D END AS llr",
        )
    )

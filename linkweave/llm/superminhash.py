"""Near-duplicate documents by SuperMinHash, banding, verification and grouping.

A document's set holds its distinct word shingles. Every shingle walks through the
``PLACES`` places of the signature in an order of its own (a permutation, so its ranks are
correlated) and leaves rank + fraction wherever that is the least so far. After round j
all values below j + 1 are final, so a document stops as soon as its largest value is
below j + 1: about two rounds for a text of usual length.

Documents with equal sets form one class and go on as one representative. Bands of the
signature give buckets; inside a bucket each member meets two leaders, survivors are
compared on their full sets, and links become components. Then members of a bucket that
still lie in different components are compared as well, tile by tile inside a task and on
their full sets; a tile returns a spanning set of links, never its pairs. Pairs inside a
component cannot change the result.

Hot groups: copies collapse by an aggregate with a map-side combine; stars need one row
per member; skewed joins are split by AQE. Nothing is capped. The only loss is that of
banding, below 1e-5 for a pair just at the threshold. Hashes have 48 bits inside a
document and 128 bits per set.

Nulls, ties: a null or blank text has an empty set, is linked with nothing and kept. A
null id takes no part and is kept. Repeated rows get equal answers. Extra columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm import common
from linkweave.operators.graph import components

#: Places of a signature; a prime, so that b + a * j visits all of them.
PLACES = 331
MISS = 1e-5
#: Members in a tile of a large bucket, members dealt to a group, columns of a product.
TILE = 1_024
UNIT = 4_096
COLUMNS = 8_192


def layout(percent: int) -> tuple[int, int]:
    """``rows, bands``: the longest bands that miss a pair at the threshold below MISS."""
    for rows in range(16, 1, -1):
        bands = (PLACES - 1) // rows
        if (1 - (percent / 100) ** rows) ** bands <= MISS:
            return rows, bands
    return 1, PLACES - 1


def sets(data: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct ``row << 48 | shingle hash`` of a slice of texts."""
    low = common.LOWER[data]
    starts, ends, rows = common.word_spans(low, offsets)
    h, rows, _ = common.shingles(
        common.span_hashes(low, starts, ends), rows, len(offsets) - 1, size
    )
    return np.unique((rows.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))


def signatures(keys: np.ndarray, n_rows: int) -> np.ndarray:
    """SuperMinHash signatures (one row each) of the sets in ``keys``."""
    places = np.uint64(PLACES)
    sig = np.full(n_rows * PLACES, np.iinfo(np.uint64).max, np.uint64)
    h = common.mix64((keys & np.uint64((1 << 48) - 1)) + np.uint64(1))
    row = (keys >> np.uint64(48)).astype(np.int64)
    place = h % places
    step = np.uint64(1) + (h >> np.uint64(32)) % (places - np.uint64(1))
    for j in range(PLACES):
        fraction = common.mix64(h + np.uint64(j * 0xA0761D6478BD642F % (1 << 64)))
        np.minimum.at(
            sig,
            row * PLACES + place.astype(np.int64),
            (np.uint64(j) << np.uint64(54)) | (fraction >> np.uint64(10)),
        )
        going = sig.reshape(n_rows, PLACES).max(axis=1) >= np.uint64(j + 1) << np.uint64(54)
        more = going[row]
        if not more.any():
            break
        if not more.all():
            h, row, place, step = h[more], row[more], place[more], step[more]
        place = (place + step) % places
    return sig.reshape(n_rows, PLACES)


def sketches(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``doc_id, n, f1, f2, bands, marks``: set size, set fingerprint, band keys, low bytes."""
    rows_in_band, bands = layout(percent)
    weight = common.mix64(np.arange(1, rows_in_band + 1, dtype=np.uint64)) | np.uint64(1)
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()),
            ("bands", pa.list_(pa.int64())), ("marks", pa.binary()),
        ]
    )

    def run(batches):
        for batch in batches:
            for part, data, offsets in common.slices(batch, "text"):
                n = part.num_rows
                keys = sets(data, offsets, size)
                row = (keys >> np.uint64(48)).astype(np.int64)
                count = np.bincount(row, minlength=n)
                full = np.flatnonzero(count)
                f1, f2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                if len(full):
                    begin = np.searchsorted(row, full)
                    h = keys & np.uint64((1 << 48) - 1)
                    f1[full] = np.add.reduceat(common.mix64(h + np.uint64(7)), begin)
                    f2[full] = np.add.reduceat(common.mix64(h + np.uint64(1 << 60)), begin)
                sig = signatures(keys, n)
                cut = sig[:, : rows_in_band * bands].reshape(n, bands, rows_in_band)
                band = common.mix64(
                    (cut * weight).sum(axis=2, dtype=np.uint64)
                    + np.arange(bands, dtype=np.uint64)[None, :]
                )
                marks = (sig & np.uint64(255)).astype(np.uint8)
                yield common.tables(
                    {
                        "doc_id": part.column("doc_id"),
                        "n": count,
                        "f1": f1.view(np.int64),
                        "f2": f2.view(np.int64),
                        "bands": list(band.view(np.int64)),
                        "marks": [m.tobytes() for m in marks],
                    },
                    schema,
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n long, f1 long, f2 long, bands array<long>, marks binary"
    )


def _alike(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose signatures do not rule the threshold out.

    The share of equal low bytes must not fall more than 6.4 standard deviations of a
    plain MinHash estimate below the threshold.
    """
    t = percent / 100
    least = PLACES * t - 6.4 * (PLACES * t * (1 - t)) ** 0.5
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (common.flat(batch.column(c))[0].reshape(-1, PLACES) for c in ("ma", "mb"))
            ok = pa.array((left == right).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], schema=schema
            ).filter(ok)

    left = reps.selectExpr("doc_id AS a", "n AS na", "marks AS ma")
    right = reps.selectExpr("doc_id AS b", "n AS nb", "marks AS mb")
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb"))
        .select("a", "b", "ma", "mb")
        .mapInArrow(run, "a long, b long")
    )


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            left, right = (common.flat(batch.column(c)) for c in ("ta", "tb"))
            size_of = np.diff(left[1]) + np.diff(right[1])
            group = np.cumsum(size_of) // common.SLICE
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                x, y = (
                    sets(d[o[lo] : o[hi]], o[lo : hi + 1] - o[lo], size) for d, o in (left, right)
                )
                both = np.intersect1d(x, y, assume_unique=True)
                nx, ny, common_n = (
                    np.bincount((k >> np.uint64(48)).astype(np.int64), minlength=hi - lo)
                    for k in (x, y, both)
                )
                ok = pa.array(100 * common_n >= percent * (nx + ny - common_n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a").slice(lo, hi - lo), batch.column("b").slice(lo, hi - lo)],
                    schema=schema,
                ).filter(ok)

    left = texts.selectExpr("doc_id AS a", "text AS ta")
    right = texts.selectExpr("doc_id AS b", "text AS tb")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return joined.mapInArrow(run, "a long, b long").distinct()


def _links_inside(table: pa.Table, size: int, percent: int) -> pa.Table:
    """Links between members of different components, a spanning set for each bucket tile.

    Shingles that only one member has cannot be shared; the others give a small matrix whose
    product with itself counts all intersections at once.
    """
    table = table.sort_by([("key", "ascending"), ("t", "ascending"), ("u", "ascending")])
    key, t, u, own, doc, root = (
        table.column(c).to_numpy() for c in ("key", "t", "u", "own", "doc_id", "root")
    )
    data, offsets = common.flat(table.column("text").combine_chunks())
    edge = np.flatnonzero((key[1:] != key[:-1]) | (t[1:] != t[:-1]) | (u[1:] != u[:-1])) + 1
    out_a, out_b = [], []
    for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(key)], strict=True):
        if hi - lo < 2 or (root[lo:hi] == root[lo]).all():
            continue
        held = sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
        row = (held >> np.uint64(48)).astype(np.int64)
        n = np.bincount(row, minlength=hi - lo)
        _, column, times = np.unique(
            held & np.uint64((1 << 48) - 1), return_inverse=True, return_counts=True
        )
        shared = times[column] > 1
        row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
        both = np.zeros((hi - lo, hi - lo), np.float32)
        width = int(column.max()) + 1 if len(column) else 0
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for first in range(0, width, COLUMNS):
            a, b = np.searchsorted(column, [first, first + COLUMNS])
            part = np.zeros((hi - lo, min(COLUMNS, width - first)), np.float32)
            part[row[a:b], column[a:b] - first] = 1
            both += part @ part.T
        linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        linked &= root[lo:hi, None] != root[None, lo:hi]
        if t[lo] != u[lo]:
            linked &= own[lo:hi, None] != own[None, lo:hi]
        left, right = np.nonzero(np.triu(linked, 1))
        # only links that join components are needed
        parent = {r: r for r in root[lo:hi].tolist()}

        def find(x, parent=parent):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            x, y = find(int(root[lo + a])), find(int(root[lo + b]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out_a.append(int(min(doc[lo + a], doc[lo + b])))
                out_b.append(int(max(doc[lo + a], doc[lo + b])))
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def _apart(shared: DataFrame, known: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links ``a, b`` between members of a bucket that lie in different components.

    Large buckets are cut into tiles of about TILE members, each pair of tiles a unit of
    work of bounded size; units are dealt to tasks by a hash.
    """
    placed = shared.select("key", "doc_id", "c").join(
        known.withColumnRenamed("node", "doc_id"), "doc_id"
    )
    mixed = (
        placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    ).select("key")
    tiles = F.ceil(F.col("c") / TILE).cast("int")
    members = (
        placed.join(mixed, "key", "left_semi")
        .withColumn("own", F.pmod(F.xxhash64("doc_id"), tiles).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
        .select(
            "key", "own", "doc_id", "root",
            F.least("own", "other").alias("t"), F.greatest("own", "other").alias("u"),
        )
    )
    members = common.stash(members, "apart")
    units = max(1, -(-members.count() // UNIT))
    return (
        members.join(texts, "doc_id")
        .withColumn("grp", F.pmod(F.xxhash64("key", "t", "u"), F.lit(units)))
        .groupBy("grp")
        .applyInArrow(lambda table: _links_inside(table, size, percent), "a long, b long")
    )


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row for each row of ``docs``.

    Two documents are linked if their sets of ``size``-word shingles have a Jaccard
    similarity of at least ``percent`` per cent. ``component_id`` is the smallest id that
    links reach; the document with that id is kept.
    """
    sketch = common.stash(sketches(docs, size, percent), "sketches")
    reps = common.stash(
        sketch.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy("f1", "f2", "n")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.first("bands").alias("bands"),
            F.first("marks").alias("marks"),
        ),
        "representatives",
    )
    entries = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = common.stash(entries.join(buckets, "key"), "buckets")
    ids = shared.select("doc_id").distinct()
    texts = common.stash(
        docs.select(F.col("doc_id").cast("long"), "text")
        .join(ids, "doc_id", "left_semi")
        .dropDuplicates(["doc_id"]),
        "candidates",
    )
    # the member that shares most buckets with most others is likely what the rest was made from
    company = shared.groupBy("doc_id").agg(F.sum("c").alias("company"))
    leaders = (
        shared.join(company, "doc_id")
        .groupBy("key")
        .agg(
            F.max_by("doc_id", F.struct("company", -F.col("doc_id"))).alias("central"),
            F.min("doc_id").alias("least"),
        )
    )
    star = (
        shared.join(leaders, "key")
        .select("doc_id", F.explode(F.array("central", "least")).alias("leader"))
        .where("doc_id <> leader")
        .selectExpr("least(doc_id, leader) AS a", "greatest(doc_id, leader) AS b")
        .distinct()
    )
    links = common.stash(_verified(_alike(star, reps, percent), texts, size, percent), "links")
    nodes = ids.withColumnRenamed("doc_id", "node")
    known = common.stash(
        components(links.selectExpr("a AS src", "b AS dst"), nodes), "components"
    )
    # what shares a bucket and is still apart
    more = common.stash(_apart(shared, known, texts, size, percent), "more")
    root = components(
        links.unionByName(more).selectExpr("a AS src", "b AS dst"), nodes
    ).withColumnRenamed("node", "doc_id")
    classes = reps.join(root, "doc_id", "left").select(
        "f1", "f2", F.coalesce("root", "doc_id").alias("root")
    )
    return (
        sketch.drop("bands", "marks")
        .join(classes, ["f1", "f2"], "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("root"))).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents without their near duplicates: one of each component stays."""
    gone = (
        near_duplicates(docs, size, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_gone"))
    ).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")

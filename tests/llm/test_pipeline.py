import os
import sys
from collections import defaultdict
from itertools import combinations

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402

ITEM = "which of these twelve small boats left harbour first when the morning tide turned against them all"
SECRET = "here password=0123456789abcdef0 stands"


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _brute(rows):
    """The documents that the first four stages keep, with their texts."""
    rows = [r for r in rows if r["text"] and any(c.isalpha() for c in r["text"])]
    held = {r["doc_id"]: _shingles(r["text"]) for r in rows if r["doc_id"] is not None}
    root = {i: i for i in held}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(held), 2):
        both = len(held[a] & held[b])
        if 100 * both >= 80 * len(held[a] | held[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    rows = [r for r in rows if r["doc_id"] is None or find(r["doc_id"]) == r["doc_id"]]
    rows = [r for r in rows if ITEM not in r["text"]]
    return sorted(str((r["doc_id"], r["text"].replace("password=0123456789abcdef0", "[secret]"))) for r in rows)


def test_pipeline_equals_brute_force(awkward, spark, tmp_path):
    base = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    more = spark.createDataFrame(
        [(200, f"some words and then {ITEM} and an end", "en", "a", 0), (201, SECRET, "en", "b", 0), (202, SECRET + " too", "de", "b", 0)],
        base.schema,
    )
    docs = base.unionByName(more)
    root = str(tmp_path)
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    now = spark.read.parquet(f"{root}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        now = stage(spark, now, root)
        assert now.columns == docs.columns
        now.write.parquet(f"{root}/{k}-{name}")
        now = spark.read.parquet(f"{root}/{k}-{name}")
    got = sorted(str((r.doc_id, r.text)) for r in now.select("doc_id", "text").collect())
    assert got == _brute([r.asDict() for r in docs.collect()])
    # the whole run takes what the mix of these documents takes
    mix = corpus_pipeline.run(spark, root)
    assert mix.columns == [*docs.columns, "copy", "words", "shard", "position"]
    size, taken = defaultdict(int), defaultdict(int)
    for r in now.collect():
        size[r.source] += len(r.text.split())
    for r in mix.collect():
        taken[r.source] += r.words
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= len(size)
    assert all(taken[s] <= 2 * n for s, n in size.items())


def test_stages_take_an_empty_table(nothing, spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0

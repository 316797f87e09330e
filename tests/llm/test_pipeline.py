"""Decisions of the pipeline's stages that have to show in its result."""

import pytest

import corpus_pipeline
from inkprint.llm.mixing import mixed, mixed_slots
from inkprint.llm.queries import op7_near_duplicates
from inkprint.session import scratch_path


def by_shard(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r["shard"], r["slot"])):
        found.setdefault(r["shard"], []).append(r["doc_id"])
    return found


@pytest.mark.parametrize("files", [1, 7])
def test_slots_follow_the_schedule(spark, sf_dir, corpus, files):
    rows = [(i, "x" * (i * 37 % 300), "en", "a" if i % 3 else "b") for i in range(400)]
    weights = {"a": 1, "b": 2}
    docs = corpus(rows)
    at = {r["doc_id"]: (r["slot"], r["place"]) for r in mixed_slots(docs, weights, block_bytes=500).collect()}
    path = scratch_path(spark, "laid-out")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", files)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        mixed(docs, weights=weights, block_bytes=500).write.parquet(path)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    laid = spark.read.parquet(path)
    assert len(laid.inputFiles()) == files
    for table in (laid, mixed(docs, weights=weights, block_bytes=500)):
        found = corpus_pipeline.sharded(spark, table, sf_dir).collect()
        assert [r["slot"] for r in sorted(found, key=lambda r: (r["shard"], r["slot"]))] == [
            k for own in by_shard(found).values() for k in range(len(own))
        ]
        for own in by_shard(found).values():
            assert [at[i] for i in own] == sorted(at[i] for i in own)


def test_mixing_shows_in_the_result(spark, sf_dir, monkeypatch):
    light = lambda spark, docs, sf_dir: mixed(docs, weights={"src0": 1e-6, "other": 1.0}, block_bytes=2000)
    stages = dict(corpus_pipeline.STAGES)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, stages[n]) for n in ("mixing", "sharding")])
    one = by_shard(corpus_pipeline.run(spark, sf_dir).collect())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = {r["doc_id"]: (r["slot"], r["place"]) for r in mixed_slots(docs).collect()}
    assert all([at[i] for i in own] == sorted(at[i] for i in own) for own in one.values())
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("mixing", light), ("sharding", stages["sharding"])])
    other = by_shard(corpus_pipeline.run(spark, sf_dir).collect())
    assert {k: sorted(v) for k, v in one.items()} == {k: sorted(v) for k, v in other.items()}
    assert one != other


def test_shards_grow_with_the_input(spark, sf_dir, corpus, monkeypatch):
    docs = corpus([(i, "x" * 99) for i in range(400)])
    assert {r["shard"] for r in corpus_pipeline.sharded(spark, docs, sf_dir).collect()} == set(range(8))
    monkeypatch.setattr(corpus_pipeline, "TARGET_BYTES", 2_000)
    found = corpus_pipeline.sharded(spark, docs, sf_dir).collect()
    assert sorted({r["shard"] for r in found}) == list(range(20))
    assert max(sum(r["size"] for r in found if r["shard"] == k) for k in range(20)) <= 2_000 + 2 * 100


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_repeated_lines_count(spark, sf_dir, corpus, prose, tmp_path):
    line = " at noon the log has this line"
    texts = {1: prose(30, 1) + line * 40, 2: prose(30, 2) + line * 40, 3: "on and on it goes " * 30, 4: "on and on it goes " * 60}
    words = {i: [tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)] for i, t in texts.items()}
    near = lambda a, b: distance(words[a], words[b]) <= 0.2 * max(len(words[a]), len(words[b]))
    assert near(1, 2) and not near(3, 4) and not near(1, 3)
    docs = corpus(list(texts.items()))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = op7_near_duplicates(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in found) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    kept = corpus_pipeline.distinct_documents(spark, docs, sf_dir).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3, 4]

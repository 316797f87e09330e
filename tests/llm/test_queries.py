"""The registered queries over the smallest tables: against their SQL, or plain Python."""

import hashlib
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from checks.compare import duck, sorted_rows
from inkprint.llm.alignment import best_inside
from inkprint.llm.decontamination import normal, pieces_of
from inkprint.llm.mixing import EXPONENT, RESOLUTION, block_size, whole_shares
from inkprint.llm.oracle import ORACLE_SQL
from inkprint.llm.quality_model import ACCEPT
from inkprint.llm.queries import QUERIES
from tests.llm.test_mixing import simulated
from tests.llm.test_near_duplicates import brute as near_classes
from tests.llm.test_secrets import brute as base_spans


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()
    return {name: read(name) for name in ("documents", "benchmark", "labels")}


@pytest.fixture
def result(spark, sf_dir):
    return lambda name: QUERIES[name](spark, sf_dir).collect()


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    found = duck(sf_dir).execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted_rows(df.collect(), df.columns) == sorted_rows(found.fetchall(), columns)


def leaks(text, items):
    body = normal(text)
    return any(normal(t) in body for t in items)


def test_op1(tables, result):
    rows = {r["doc_id"]: r for r in result("op1_decontamination")}
    items = {b["item_id"]: b["text"] for b in tables["benchmark"]}
    assert set(rows) == {d["doc_id"] for d in tables["documents"]}
    for d in tables["documents"]:
        row, body = rows[d["doc_id"]], normal(d["text"])
        whole = {i for i, t in items.items() if normal(t) in body}
        assert whole <= set(row["item_ids"]) and row["contaminated"] == bool(row["item_ids"])
        for i in row["item_ids"]:
            pieces = pieces_of(str(i), items[i])
            assert any(best_inside(p.forward, len(p.text), body)[0] <= p.budget for p in pieces)


def test_op5(tables, result):
    rows = {r["doc_id"]: r for r in result("op5_language")}
    new = [d for d in tables["documents"] if held_out(d["doc_id"])]
    assert all(rows[d["doc_id"]]["held_out"] == held_out(d["doc_id"]) for d in tables["documents"])
    assert sum(rows[d["doc_id"]]["lang_pred"] == d["lang"] for d in new) >= 0.95 * len(new)
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_op6(spark, sf_dir):
    # The smallest tables hold out 19 labels, too few to measure accuracy.
    larger = sf_dir.replace("sf0.001", "sf0.01")
    rows = {r["doc_id"]: r for r in QUERIES["op6_quality"](spark, larger).collect()}
    labels = spark.read.parquet(f"{larger}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{larger}/documents.parquet").count()
    new = [x for x in labels if held_out(x["doc_id"])]
    assert sum(rows[x["doc_id"]]["predicted"] == x["quality"] for x in new) >= 0.9 * len(new)
    assert all(r["predicted"] == (r["score"] >= ACCEPT) for r in rows.values())
    assert all(r["held_out"] == held_out(i) for i, r in rows.items())


def test_op7(tables, result):
    expected = near_classes([(d["doc_id"], d["text"]) for d in tables["documents"]])
    assert sorted((r["doc_id"], r["class_id"]) for r in result("op7_near_duplicates")) == expected


def test_op8(tables, result):
    rows = {r["doc_id"]: r for r in result("op8_secrets")}
    for d in tables["documents"]:
        base, row = base_spans(d["text"]), rows[d["doc_id"]]
        assert row["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        kinds = Counter(s.split(":")[0] for s in base.split(",") if s)
        assert (row["n_assign"], row["n_access"], row["n_hex"]) == tuple(kinds[k] for k in ("assign", "access", "hex"))
        assert set(filter(None, base.split(","))) <= set(row["spans"].split(","))


def test_op9(tables, result):
    rows = result("op9_mixing")
    size = Counter()
    for d in tables["documents"]:
        size[d["source"]] += len((d["text"] or "").encode()) + 1
    order = sorted(size)
    shares = whole_shares({s: size[s] ** EXPONENT for s in order}, RESOLUTION)
    block = block_size(sum(size.values()), len(rows))
    blocks = {s: -(-size[s] // block) for s in order}
    assert len(blocks) >= 2 and max(blocks.values()) > 3  # sources take turns
    slots = simulated(shares, blocks)
    assert len(rows) == len(tables["documents"])
    assert all(r["slot"] == slots[r["source"], r["block"]] for r in rows)


def test_op10(tables, result):
    rows = {r["doc_id"]: r for r in result("op10_sharding")}
    for d in tables["documents"]:
        data = (d["text"] or "").encode()
        assert rows[d["doc_id"]]["size"] == len(data) + 1
        assert rows[d["doc_id"]]["text_crc32"] == zlib.crc32(data)
    total, largest = sum(r["size"] for r in rows.values()), max(r["size"] for r in rows.values())
    for shard in range(8):
        own = [r for r in rows.values() if r["shard"] == shard]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 8) <= 2 * largest
    assert {(r["law"], r["grown_shard"]) for r in rows.values()} == {("bytes", None)}


def test_pipeline(spark, sf_dir, tables):
    texts = {d["doc_id"]: d["text"] for d in tables["documents"]}
    score = {r["doc_id"]: r["score"] for r in QUERIES["op6_quality"](spark, sf_dir).collect()}
    kept = [i for i in sorted(texts) if score[i] >= ACCEPT]
    classes = near_classes([(i, texts[i]) for i in kept])
    firsts = [i for i, c in classes if i == c]
    items = [b["text"] for b in tables["benchmark"]]
    clean = [i for i in firsts if not leaks(texts[i], items)]
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == clean
    assert {r["shard"] for r in rows} == set(range(corpus_pipeline.SHARDS))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_handle_odd_rows(spark, sf_dir, corpus, prose, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(1, None, None, None), (2, "", "en", "a"), (2, "", "en", "a"), (None, "x", "en", None), (3, prose(3000, 1), "de", "b")]
    docs = corpus(rows, "_score _hits _node _slot")
    out = stage(spark, docs, sf_dir)
    found = out.collect()
    if name != "sharding":
        assert out.columns == docs.columns
    if name != "quality":
        assert len(found) == len(rows)
    assert stage(spark, corpus([]), sf_dir).collect() == []

"""One query for each operator of this package, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.functions.binding import let
from inkprint.llm.common import held_out, learnable, table
from inkprint.llm.decontamination import benchmark_hits
from inkprint.llm.host_reputation import host_of, judged_urls, path_of
from inkprint.llm.language import detected, fit_languages
from inkprint.llm.mixing import mixed_slots
from inkprint.llm.near_duplicates import near_duplicate_classes
from inkprint.llm.nearest import nearest_vectors
from inkprint.llm.periodic_runs import with_runs
from inkprint.llm.quality_model import ACCEPT, fit_quality, quality_score
from inkprint.llm.quality_rules import judged
from inkprint.llm.secrets import fit_ratios, secret_spans, spelled
from inkprint.llm.sharding import document_dimensions, kd_shards
from inkprint.llm.substrings import without_repeats
from inkprint.llm.token_links import link_counts, token_groups
from inkprint.session import materialize


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    hits = benchmark_hits(table(spark, sf_dir, "benchmark"), F.col("text"))
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item"].cast("long"))))
    return documents.select("doc_id", hits.alias("hits")).select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.size("hits").cast("long").alias("n_spans"),
        items.alias("item_ids"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = without_repeats(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"),
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose number is in its url, and has that document's label."""
    pages = table(spark, sf_dir, "pages")
    shown = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:[/.]|$)", 1)
    at = pages.select(host_of(F.col("url")).alias("host"), shown.try_cast("long").alias("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("bad"))
    return judged_urls(pages, at.join(labels, "doc_id").select("host", "bad"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    filters = fit_languages(documents.filter(learnable(F.col("doc_id"))))
    found = documents.select("doc_id", detected(filters, F.col("text"), spark).alias("found"))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(learnable(F.col("doc_id")))
    state = fit_quality(documents, labels)
    return documents.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        quality_score(state, F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicate_classes(table(spark, sf_dir, "documents"))
    return classes.select(
        "doc_id",
        F.col("class").alias("class_id"),
        (F.col("node") == F.col("class")).alias("kept"),
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = documents.select("doc_id", secret_spans(F.col("text"), fit_ratios(documents)).alias("found"))
    of_kind = lambda k: F.size(F.filter("found.base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        of_kind(0).alias("n_assign"),
        of_kind(1).alias("n_access"),
        of_kind(2).alias("n_hex"),
        F.sha2(spelled(F.col("found.base")), 256).alias("base_sha256"),
        spelled(F.col("found.spans")).alias("spans"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_slots(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return kd_shards(documents, document_dimensions(documents), shards=8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def made_periodic(doc_id: Column, text: Column) -> Column:
    """Every tenth text, by the hash of its id, from one of its words on repeats a few of them."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(
            F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + (i - a) % p))), " "
        )

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = text.rlike(r"[^\x20\x09-\x0D]")
    return F.when((h % 10 == 0) & some, let(words, repeated)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = with_runs(documents.select("doc_id", made_periodic(F.col("doc_id"), F.col("text")).alias("text")))
    ranked = F.transform(
        "runs",
        lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")),
    )
    spelled = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    longest = F.array_max(ranked)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-longest["start"]).alias("start"),
        longest["length"].alias("length"),
        (-longest["period"]).alias("period"),
        F.floor(1000 * longest["length"] / -longest["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(spelled, ""), 256).alias("runs_sha256"),
        F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )


def op12_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op13_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = token_groups(table(spark, sf_dir, "documents"))
    sha = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    written = materialize(linked.withColumn("groups_sha256", sha).drop("groups"))
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "groups_sha256"]
    return link_counts(written, kept)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_url_filter": op4_url_filter,
    "op5_language": op5_language,
    "op6_quality": op6_quality,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_secrets": op8_secrets,
    "op9_mixing": op9_mixing,
    "op10_sharding": op10_sharding,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_nearest_vectors": op12_nearest_vectors,
    "op13_token_links": op13_token_links,
}

import html
import random

import pytest
from pyspark.sql import functions as F

from inkprint.functions import text as tx
from inkprint.functions.entities import unescape


@pytest.fixture
def apply(docs):
    def run(function, *texts):
        rows = docs(*texts).select("id", function(F.col("text")).alias("out")).orderBy("id").collect()
        return [row["out"] for row in rows]

    return run


def test_word_tokens(apply):
    (tokens,) = apply(tx.word_tokens, "Don't stop... well-known, (or) -- 3,5 naïve x\ty!")
    assert tokens == [
        "Don't", "stop", "...", "well-known", ",", "(", "or", ")", "--", "3", ",", "5", "naïve",
        "x", "y", "!",
    ]


def test_no_tokens(apply):
    assert apply(tx.word_tokens, "", " \n ") == [[], []]


def test_punctuation_is_a_substring_test(spark):
    rows = spark.createDataFrame([(t,) for t in ["()", "...", "--", "***", ",", "a", ",-."]], "tok string")
    counted = {r.tok: r.c for r in rows.select("tok", tx.is_counted_word(F.col("tok")).alias("c")).collect()}
    assert counted == {
        "()": False, "...": True, "--": True, "***": True, ",": False, "a": True, ",-.": False
    }


def test_sentences(apply):
    assert apply(tx.sentences, "One two. Three?! Four", "...", "", "No.end here") == [
        ["One two.", "Three?!", "Four"], ["..."], [], ["No.end here"],
    ]


def test_words_split_like_python(apply):
    texts = ["a b\x1cc d", "  lead and trail  ", "x\x0by\x85z", "​zero"]
    assert apply(tx.words_in, *texts) == [len(t.split()) for t in texts]


def test_sentence_lengths(apply):
    assert apply(tx.sentence_lengths, "One two. Three?! Four five six", "", " . ") == [[2, 1, 3], [], [1]]


def test_markup(apply):
    page = (
        "<!DOCTYPE html><!-- <p>gone</p> --><style>p{a>b}</style><script>if (a<b) '</p>';</script>"
        "<template><b>no</b></template><p class='x>y'>A <b>bold</b><br/> claim &amp; 1 < 2</p>"
    )
    assert apply(tx.clean_text, page, "plain", "<p>a</p>b") == ["A bold claim & 1 < 2", "plain", "ab"]


def test_references_are_decoded_twice(apply):
    assert apply(tx.clean_text, "&amp;lt;", "&amp;amp;lt;", "&lt;b&gt;") == ["<", "&lt;", "<b>"]
    assert apply(unescape, "&amp;lt;") == ["&lt;"]


def test_unescape_like_the_standard(apply):
    texts = [
        "&amp;&lt;&gt;&quot;&nbsp;&copy;&middot;&apos;", "&#65;&#x41;&#X41;&#65", "&#0;&#x110000;&#xD800;",
        "&#128;&#x99;&#129;", "&#1;a&#11;b&#xFDD0;c&#xFFFE;", "&#x1F600; &#128512;", "&ampere &notit; &copyx",
        "&unknown; & && &; &#; &#x;", "a&NotEqualTilde;b&CounterClockwiseContourIntegral;", "",
        "&#99999999999999999999;", "&Aacute&aacute;", "tail &amp", "&#0065;&#x000041;", "&#13;&#10;",
    ]
    assert apply(unescape, *texts) == [html.unescape(t) for t in texts]


def test_unescape_random(apply):
    draw = random.Random(5)
    parts = ["&", "amp", ";", "lt", "#", "x", "41", "65", " ", "z", "not", "in", "copy", "ö"]
    texts = ["".join(draw.choices(parts, k=12)) for _ in range(400)]
    assert apply(unescape, *texts) == [html.unescape(t) for t in texts]


@pytest.mark.parametrize("length, count", [(0, 0), (1, 1), (10_000, 1), (10_001, 2), (20_000, 2)])
def test_chunk_edges(apply, length, count):
    text = "".join(chr(0x61 + i % 26) if i % 7 else "\n" for i in range(length))
    (pieces,) = apply(tx.chunks, text)
    assert len(pieces) == count and "".join(pieces) == text


def test_chunks_count_characters(apply):
    (pieces,) = apply(lambda t: tx.chunks(t, 3), "aé😀b\r\nc")
    assert pieces == ["aé😀", "b\r\n", "c"]


def test_file_stem(apply):
    assert apply(tx.file_stem, "./a/b.c.jsonl", "file:/x/y", "a\\b.json", "/x.d/") == ["b.c", "y", "b", ""]


def test_source_stem_is_that_of_a_folder_of_part_files(spark, docs, tmp_path):
    folder = str(tmp_path / "my docs.parquet")
    docs(*"abcdef").withColumn("lang", F.lit("en")).repartition(3).write.partitionBy("lang").parquet(folder)
    stems = spark.read.parquet(folder).groupBy(tx.source_stem(F.input_file_name())).count().collect()
    assert [tuple(r) for r in stems] == [("my%20docs", 6)]


def test_source_stem_of_files(apply):
    paths = ["file:/x/a.parquet", "file:/x/a.parquet/part-0001.parquet", "/x/part-list.txt", "s3://b/x/k=1/part-7-c0.json"]
    assert apply(tx.source_stem, *paths) == ["a", "a", "part-list", "x"]


def test_trigrams(apply):
    assert apply(tx.char_trigrams, "ab😀c", "ab", "") == [["ab😀", "b😀c"], [], []]


def test_pair_label_and_truncation(spark):
    row = spark.range(1).select(
        tx.pair_label(F.lit("a"), F.lit("b")).alias("p"),
        tx.first_tokens(F.array(*[F.lit(i) for i in range(6)]), 4).alias("t"),
    ).first()
    assert row.p == "a_b" and row.t == [0, 1, 2, 3]


def test_text_functions_run_on_a_stream(spark, docs, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    docs("<p>One two. Three!</p>", "&amp;lt;").write.json(source)
    stream = spark.readStream.schema("id long, text string").json(source)
    cleaned = stream.select("id", tx.clean_text(F.col("text")).alias("text"))
    out = cleaned.select("id", "text", tx.sentence_lengths(F.col("text")).alias("lengths"))
    query = (
        out.writeStream.format("json").option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start(target)
    )
    query.awaitTermination(120)
    rows = spark.read.schema("id long, text string, lengths array<int>").json(target).orderBy("id").collect()
    assert [(r.text, r.lengths) for r in rows] == [("One two. Three!", [2, 1]), ("<", [1])]

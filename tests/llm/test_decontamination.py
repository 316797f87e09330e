import random
import re

from pyspark.sql import functions as F

from inkprint.llm.alignment import best_inside, places
from inkprint.llm.decontamination import MIN_CHARS, benchmark_hits, normal, pieces_of, without_benchmark


def tables(spark, corpus, prose):
    draw = random.Random(1)
    items = [(i, prose(draw.randint(8, 50), 50 + i)) for i in range(12)] + [(90, None), (91, "Short \n one"), (92, "short one"), (93, " "), (None, prose(30, 77))]
    rows = []
    for i in range(60):
        text = prose(draw.randint(0, 200), 1000 + i)
        kind = i % 5
        passage = items[i % 12][1]
        if kind == 1:
            text += " " + passage + " " + prose(5, i)
        elif kind == 2:  # about one character in twenty is changed
            letters = list(passage)
            for k in draw.sample(range(len(letters)), len(letters) // 20):
                letters[k] = draw.choice(["z", "", letters[k] + "z"])
            text = prose(40, i) + "\n" + "".join(letters).upper() + "\n" + text
        elif kind == 3:  # words of a passage, out of order
            words = passage.split()
            draw.shuffle(words)
            text += " ".join(words)
        rows.append((i, text))
    rows += [(80, "(Short one), " + prose(9, 6)), (81, "shorter ones, short ones"), (82, "a\nshort   ONE")]
    rows += [(70, None), (71, ""), (72, prose(30, 77)), (None, prose(3000, 5) + items[3][1]), (1, rows[1][1])]
    return spark.createDataFrame(items, "item_id long, text string"), corpus(rows, "hits item"), items, rows


def brute(items, rows):
    pieces = [p for i, t in items if t for p in pieces_of(None if i is None else str(i), t)]
    out = []
    for doc_id, text in rows:
        body = normal(text or "")
        found = {p.item for p in pieces if best_inside(places(p.text), len(p.text), body)[0] <= p.budget}
        if re.search(r"\bshort one\b", body):
            found.add("91")
        out.append((doc_id, frozenset(found)))
    return sorted(out, key=str)


def test_brute_force(spark, corpus, prose):
    benchmark, df, items, rows = tables(spark, corpus, prose)
    expected = brute(items, rows)
    for block in (1 << 20, 300):
        hits = df.select("doc_id", benchmark_hits(benchmark, F.col("text"), block_chars=block).alias("h"))
        found = [(r["doc_id"], frozenset(h["item"] for h in r["h"])) for r in hits.collect()]
        assert sorted(found, key=str) == expected
    kept = without_benchmark(df, benchmark)
    assert kept.columns == df.columns
    assert sorted([r["doc_id"] for r in kept.collect()], key=str) == sorted([i for i, f in expected if f <= {"91"}], key=str)
    every = without_benchmark(df, benchmark, least_chars=1)
    assert sorted([r["doc_id"] for r in every.collect()], key=str) == sorted([i for i, f in expected if not f], key=str)
    assert sum(f == {"91"} for _, f in expected) == 2 and MIN_CHARS > len("short one")


def test_spans_are_places_in_the_text(spark, corpus, prose):
    passage = prose(40, 3)
    spaced = "İ é  " + prose(9, 4) + "\n\n" + passage.upper().replace(" ", "  \n") + " tail"
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    (hit,) = corpus([(1, spaced)]).select(benchmark_hits(benchmark, F.col("text")).alias("h")).first()["h"]
    assert normal(spaced[hit["start"] : hit["end"]]) == passage and hit["edits"] == 0


def test_empty_tables(spark, corpus, prose):
    none = spark.createDataFrame([], "item_id long, text string")
    assert without_benchmark(corpus([(1, "a")]), none).count() == 1
    some = spark.createDataFrame([(1, prose(40, 1))], "item_id long, text string")
    assert without_benchmark(corpus([]), some).count() == 0

"""DuckDB twins of the queries, over the same whole tables."""

from __future__ import annotations

from inkprint.functions import patterns as P
from inkprint.operators import lexicon
from inkprint.plans.features import feature_names

ORACLE_SQL: dict[str, str] = {}


def q(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def r6(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"


def tokens(text: str) -> str:
    return f"regexp_extract_all({text}, {q(P.WORD)})"


def marked(text: str) -> str:
    return f"regexp_replace({text}, {q(P.SENTENCE_END)}, '\\1' || chr(1), 'g')"


SENTENCES = (
    f"list_filter(string_split({marked('text')}, chr(1)), "
    f"lambda s: regexp_matches(s, {q(P.NON_SPACE)}))"
)
LENGTHS = (
    f"list_transform({SENTENCES}, lambda s: len(regexp_extract_all(s, {q(P.NON_SPACE)})))"
)
COUNTED = f"list_filter({tokens('lower(text)')}, lambda t: NOT contains({q(P.PUNCTUATION)}, t))"

TOKENS = f"""tokens AS MATERIALIZED (
  SELECT doc_id, unnest(t) AS tok, unnest(range(len(t))) AS pos, len(t) AS n
  FROM (SELECT doc_id, {tokens('lower(text)')} AS t FROM documents))"""
CASED = f"""cased AS (
  SELECT doc_id, unnest(t) AS tok, unnest(range(len(t))) AS pos
  FROM (SELECT doc_id, {tokens('text')} AS t FROM documents))"""
PAIRS = """pairs AS MATERIALIZED (
  SELECT * FROM (SELECT doc_id, n, pos, tok AS first,
    lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS second FROM tokens)
  WHERE second IS NOT NULL)"""
# Here the joins of the textbook form; the Spark side has windows instead.
COUNTED_PAIRS = """words AS MATERIALIZED (SELECT doc_id, tok, count(*) AS c FROM tokens GROUP BY ALL),
counted AS MATERIALIZED (
  SELECT p.doc_id, p.n, p.first, p.second, p.k, a.c AS c1, b.c AS c2
  FROM (SELECT doc_id, n, first, second, count(*) AS k FROM pairs GROUP BY ALL) p
  JOIN words a ON a.doc_id = p.doc_id AND a.tok = p.first
  JOIN words b ON b.doc_id = p.doc_id AND b.tok = p.second)"""
PMI = """scored AS (
  SELECT doc_id, k,
    ln((k / (n - 1)) / ((c1 / n) * (c2 / n))) AS pmi,
    CASE WHEN k = n - 1 THEN 0
         ELSE ln((k / (n - 1)) / ((c1 / n) * (c2 / n))) / -ln(k / (n - 1)) END AS npmi
  FROM counted),
pmi AS (SELECT doc_id, avg(pmi) AS avg_pmi, avg(npmi) AS avg_npmi FROM scored GROUP BY doc_id),
ranked AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) - 1 AS place
  FROM scored),
tops AS (SELECT doc_id, """ + ", ".join(
    f"max(k) FILTER (WHERE place = {i}) AS bigram{i}" for i in range(P.BIGRAM_SLOTS)
) + " FROM ranked GROUP BY doc_id)"
BIGRAMS = [f"bigram{i}" for i in range(P.BIGRAM_SLOTS)]


def add(name: str, select: str, *ctes: str) -> None:
    ORACLE_SQL[name] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + select


# ------------------------------------------------------------ sources and sinks

RECORD = "doc_id, lang, source, n_chars, md5(text) AS digest"
add("jsonl_round_trip", f"SELECT {RECORD} FROM documents")
add("tolerant_scan", "SELECT doc_id AS id, md5(text) AS digest FROM documents")
add("quarantined_lines", """
SELECT 'malformed' AS reason, count(*) AS n FROM pages
UNION ALL SELECT 'no id', count(*) FROM conversations""")
add("concatenated_files", """
SELECT doc_id, lang, NULL::BIGINT AS conv_id, NULL::BIGINT AS turn, NULL::VARCHAR AS role,
  md5(text) AS digest FROM documents
UNION ALL SELECT NULL, NULL, conv_id, turn, role, md5(text) FROM conversations""")
add("equal_parts", f"""
SELECT {RECORD}, (row_number() OVER (ORDER BY doc_id) - 1) // 300 AS part FROM documents""")
ORACLE_SQL["equal_part_files"] = ORACLE_SQL["equal_parts"]
add("head_rows", f"SELECT {RECORD} FROM documents ORDER BY doc_id LIMIT 25")
add("required_columns", "SELECT doc_id, quality FROM labels")

# -------------------------------------------------------- projections, predicates

add("rows_with_ids", """
SELECT l.doc_id::BIGINT AS id, d.lang, l.quality
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NOT NULL""")
add("over_length_texts", f"""
SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > {P.CHUNK_SIZE}""")
add("within_length_texts", f"""
SELECT doc_id, length(text) AS n FROM documents WHERE length(text) <= {P.CHUNK_SIZE}""")
add("filled_nulls", """
SELECT doc_id, lang, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic
FROM documents LEFT JOIN labels USING (doc_id)""")
_ALL = "FROM documents LEFT JOIN labels USING (doc_id)"
add("numeric_columns", f"""
SELECT doc_id, 'n_chars' AS feature, n_chars::DOUBLE AS value {_ALL}
UNION ALL SELECT doc_id, 'quality', quality::DOUBLE {_ALL}
UNION ALL SELECT doc_id, 'toxic', toxic::DOUBLE {_ALL}""")
add("other_columns", " UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS feature, md5({c}) AS digest FROM documents"
    for c in ("text", "lang", "source")
))
VALUES = """values_ AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS value, unnest(range(len(embedding))) AS slot, label
  FROM embeddings)"""
add("last_layers", """
SELECT vec_id, (slot // 16)::INT AS layer, (slot % 16)::INT AS pos, value FROM values_ WHERE slot < 32""",
    VALUES)
add("layer_file_round_trip", """
SELECT vec_id, (slot // 16)::INT AS layer, (slot % 16)::INT AS pos, value FROM values_""", VALUES)
_PRED = "pred AS (SELECT doc_id AS id, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS label FROM documents)"
_GOLD = "gold AS (SELECT doc_id AS id, quality AS label FROM labels)"


def names(labels) -> str:
    return "(VALUES " + ", ".join(f"({i}, {q(n)})" for i, n in labels.items()) + ") v(label, name)"


add("label_names", f"SELECT id, label, name FROM pred LEFT JOIN {names(P.LABELS_TWO_CLASS)} USING (label)",
    _PRED)
add("label_numbers", f"""
SELECT e.vec_id, v.name, v.label FROM embeddings e
JOIN {names(P.LABELS_SIX_CLASS)} ON v.label = e.label % 6""")
add("truncated_tokens", f"""
SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest
FROM (SELECT doc_id, {tokens('lower(text)')}[1:{P.MODEL_TOKENS}] AS t FROM documents)""")

# ------------------------------------------------------------------------- joins

add("joined_by_id", "SELECT doc_id, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)")
add("matched_predictions", """
SELECT id, p.label AS label_pred, g.label AS label_gold FROM pred p JOIN gold g USING (id)""",
    _PRED, _GOLD)
_SECOND = "CASE WHEN toxic = 0 THEN quality::DOUBLE END"
add("combined_features", f"""
SELECT d.doc_id AS id, n_chars::DOUBLE AS a,
  CASE WHEN l.doc_id IS NULL THEN 1.0 ELSE {_SECOND} END::DOUBLE AS b,
  length(source)::DOUBLE AS c
FROM documents d LEFT JOIN labels l USING (doc_id)""")
_SCALED_FEATURE = ("CASE WHEN {c} IS NOT NULL THEN "
                   "coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0) END")
add("combined_feature_file", "SELECT id, " + ", ".join(
    f"{r6(_SCALED_FEATURE.format(c=c))} AS {c}" for c in "abc"
) + " FROM combined", f"combined AS ({ORACLE_SQL['combined_features']})")
add("combined_feature_rows", f"""
SELECT doc_id AS id, 'a' AS feature, n_chars::DOUBLE AS value FROM documents
UNION ALL SELECT d.doc_id, 'b', CASE WHEN l.doc_id IS NULL THEN 1.0 ELSE {_SECOND} END
FROM documents d LEFT JOIN labels l USING (doc_id)
UNION ALL SELECT doc_id, 'c', length(source)::DOUBLE FROM documents""")
add("aligned_vectors", "SELECT vec_id, 4::BIGINT AS n_layers, label FROM embeddings")

DICTIONARY = f"""dictionary AS (
  SELECT DISTINCT word FROM (SELECT unnest({tokens('lower(text)')}) AS word FROM benchmark)
  WHERE regexp_matches(word, {q(P.HAS_LETTER)})),
unknown AS (
  SELECT DISTINCT doc_id, tok AS word FROM tokens
  WHERE tok NOT IN (SELECT word FROM dictionary)
    AND NOT (length(tok) = 1 AND contains({q(P.PUNCTUATION)}, tok))
    AND NOT regexp_matches(tok, {q(P.NUMBER_TOKEN)})),
errors AS (SELECT doc_id, count(*) AS n FROM unknown GROUP BY doc_id)"""
add("unknown_words", "SELECT doc_id, word FROM unknown", TOKENS, DICTIONARY)
add("spelling_errors", """
SELECT doc_id, coalesce(n, 0) AS spelling_error FROM documents LEFT JOIN errors USING (doc_id)""",
    TOKENS, DICTIONARY)
add("pair_word_counts", """
SELECT doc_id, first, second, k, c1::BIGINT AS c1, c2::BIGINT AS c2 FROM counted""",
    TOKENS, PAIRS, COUNTED_PAIRS)

# ------------------------------------------------------------------- aggregations

STYLE = f"""lengths AS (SELECT doc_id, {LENGTHS} AS s, list_transform({COUNTED}, lambda t: length(t)) AS w
  FROM documents),
style AS (
  SELECT doc_id, coalesce(list_stddev_pop(s), 0) AS variability,
    coalesce(list_avg(s), 0) AS avg_sentence_length,
    list_avg(w) AS avg_word_length,
    coalesce(list_max(s) - list_min(s), 0)::DOUBLE AS sentence_length_range
  FROM lengths)"""
for _column in ("variability", "avg_sentence_length", "sentence_length_range", "avg_word_length"):
    add(_column, f"SELECT doc_id, {r6(_column)} AS {_column} FROM style", STYLE)
for _column in ("avg_pmi", "avg_npmi"):
    add(_column, f"""
SELECT doc_id, {r6(f'coalesce({_column}, 0)')} AS {_column}
FROM documents LEFT JOIN pmi USING (doc_id)""", TOKENS, PAIRS, COUNTED_PAIRS, PMI)
add("highest_bigram_counts",
    "SELECT doc_id, " + ", ".join(f"coalesce({c}, 0)::DOUBLE AS {c}" for c in BIGRAMS)
    + " FROM documents LEFT JOIN tops USING (doc_id)", TOKENS, PAIRS, COUNTED_PAIRS, PMI)


def by_form(universal: bool) -> str:
    def name(tag):
        return q(lexicon.UNIVERSAL_BY_PENN[tag] if universal else tag)

    tests = {
        "like": lambda value: f"regexp_matches(tok, {q(value)})",
        "ends": lambda value: f"suffix(tok, {q(value)})",
        "one of": lambda value: "tok IN (" + ", ".join(map(q, value.split())) + ")",
    }
    rules = " ".join(
        f"WHEN {tests[test](value)} THEN {name(tag)}" for test, value, tag in lexicon.FORM_RULES
    )
    return f"CASE {rules} ELSE {name(lexicon.DEFAULT_TAG)} END"


def rows_of(entries) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(q, e)) + ")" for e in entries)


TAGGED = f"""tagged AS (
  SELECT doc_id, pos, tok, coalesce(w.tag, {by_form(False)}) AS tag
  FROM cased LEFT JOIN ({rows_of(lexicon.english_entries())}) w(word, tag) ON lower(tok) = w.word)"""


def universal_tagged(languages: str) -> str:
    return f"""tagged AS (
  SELECT doc_id, pos, tok, coalesce(w.tag, {by_form(True)}) AS tag
  FROM cased JOIN {languages} l USING (doc_id)
  LEFT JOIN ({rows_of(lexicon.universal_entries())}) w(lang, word, tag)
    ON lower(tok) = w.word
    AND w.lang = CASE WHEN l.lang IN ('en', 'de', 'es', 'fr') THEN l.lang ELSE 'en' END)"""


def shares(tags) -> str:
    columns = ", ".join(
        f"(count(*) FILTER (WHERE tag = {q(t)})) / count(*) AS {lexicon.tag_column(t)}" for t in tags
    )
    return f"shares AS (SELECT doc_id, {columns} FROM tagged GROUP BY doc_id)"


def all_rounded(columns) -> str:
    return ", ".join(f"{r6(c)} AS {c}" for c in columns)


def or_zero(tags) -> str:
    """The shares of every text, 0 where it has no token."""
    columns = map(lexicon.tag_column, tags)
    return ", ".join(f"{r6(f'coalesce({c}, 0)')} AS {c}" for c in columns)


add("tag_shares", f"SELECT doc_id, {or_zero(P.TAGS_MONO)} FROM documents LEFT JOIN shares USING (doc_id)",
    CASED, TAGGED, shares(P.TAGS_MONO))
add("universal_tag_shares",
    f"SELECT doc_id, {or_zero(P.TAGS_MULTI)} FROM documents LEFT JOIN shares USING (doc_id)",
    CASED, universal_tagged("documents"), shares(P.TAGS_MULTI))

_NUMBERS = """numbers AS (
  SELECT doc_id, n_chars::DOUBLE AS n_chars, 7::DOUBLE AS constant, quality::DOUBLE AS quality,
    toxic::DOUBLE AS toxic
  FROM documents LEFT JOIN labels USING (doc_id))"""
_SCALED = ("n_chars", "constant", "quality", "toxic")


def over_all(expression: str) -> str:
    return ", ".join(f"{r6(expression.format(c=c))} AS {c}" for c in _SCALED)


add("zscores", "SELECT doc_id, "
    + over_all("coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0), 0)")
    + " FROM numbers", _NUMBERS)
_KEEP_NULL = "CASE WHEN {c} IS NOT NULL THEN coalesce(%s, 0) END"
add("population_zscores", "SELECT doc_id, "
    + over_all(_KEEP_NULL % "({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0)")
    + " FROM numbers", _NUMBERS)
add("minmax_scores", "SELECT doc_id, "
    + over_all(_KEEP_NULL
               % "({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0)")
    + " FROM numbers", _NUMBERS)
add("maxabs_scores", f"""
SELECT doc_id, {r6('(n_chars - 3000)::DOUBLE / max(abs(n_chars - 3000)) OVER ()')} AS score
FROM documents""")
add("mean_by_id", f"""
SELECT conv_id, {r6('avg(length(text))')} AS score FROM conversations GROUP BY conv_id""")
add("tag_vocabulary", "SELECT DISTINCT tag FROM tagged", CASED, TAGGED)

_CASED_PAIRS = """cased_pairs AS (
  SELECT * FROM (SELECT doc_id, tok || '_' || lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS label
  FROM cased) WHERE label IS NOT NULL)"""
_BAG = "bag AS (SELECT doc_id, lower(label) AS bigram, count(*) AS n FROM cased_pairs GROUP BY ALL)"
add("bigram_bag", "SELECT doc_id, bigram, n FROM bag", CASED, _CASED_PAIRS, _BAG)
add("bigram_bag_strict", f"""
SELECT doc_id, bigram, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(label), {q(P.VECTORIZER_TOKEN)})) AS bigram
  FROM cased_pairs) GROUP BY ALL""", CASED, _CASED_PAIRS)
add("top_bigram_counts", """
SELECT doc_id, place::INT AS place, coalesce(n, 0) AS n
FROM documents CROSS JOIN range(least(10, (SELECT count(DISTINCT bigram) FROM bag))) r(place)
LEFT JOIN (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) - 1 AS place
  FROM bag) USING (doc_id, place)""", CASED, _CASED_PAIRS, _BAG)
_PLACES = """places AS MATERIALIZED (
  SELECT bigram, row_number() OVER (ORDER BY bigram) - 1 AS place, n_texts, total FROM (
    SELECT bigram, count(*) AS n_texts, sum(n)::BIGINT AS total FROM bag GROUP BY bigram))"""
add("bigram_vocabulary", "SELECT bigram, place, n_texts, total FROM places", CASED, _CASED_PAIRS, _BAG, _PLACES)
add("bigram_matrix", """
SELECT doc_id, (SELECT count(*) FROM places) AS size, count(place) AS n,
  md5(coalesce(string_agg(place || ':' || n, ',' ORDER BY place), '')) AS digest
FROM documents LEFT JOIN (SELECT doc_id, place, n FROM bag JOIN places USING (bigram)) USING (doc_id)
GROUP BY doc_id""", CASED, _CASED_PAIRS, _BAG, _PLACES)
add("highest_matrix_counts", ORACLE_SQL["top_bigram_counts"])
add("bigram_matrix_of_others", f"""
SELECT any_value(conv_id) AS conv_id, (SELECT count(*) FROM places) AS size,
  coalesce(string_agg(place::VARCHAR, ',' ORDER BY place), '') AS places,
  coalesce(string_agg(n::VARCHAR, ',' ORDER BY place), '') AS counts
FROM turns LEFT JOIN (
  SELECT turn_id, place, count(*) AS n FROM (
    SELECT turn_id, lower(tok || '_' || lead(tok) OVER (PARTITION BY turn_id ORDER BY pos)) AS bigram FROM (
      SELECT turn_id, unnest(t) AS tok, unnest(range(len(t))) AS pos
      FROM (SELECT turn_id, {tokens('text')} AS t FROM turns)))
  JOIN places USING (bigram) GROUP BY ALL) USING (turn_id)
GROUP BY turn_id""",
    "turns AS MATERIALIZED (SELECT row_number() OVER () AS turn_id, conv_id, text FROM conversations)",
    CASED, _CASED_PAIRS, _BAG, _PLACES)
add("token_stats", f"""
SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct,
  greatest(len(t) - 1, 0) AS n_pairs
FROM (SELECT doc_id, {tokens('lower(text)')} AS t FROM documents)""")

# ------------------------------------------------------- windows, sets, functions

add("adjacent_pairs", "SELECT doc_id, pos::INT AS pos, first, second FROM pairs", TOKENS, PAIRS)
add("scoring_window_bounds", """
SELECT doc_id, begin, least(begin + 256, n) AS "end",
  least(begin + 256, n) - CASE WHEN begin = 0 THEN 0 ELSE begin - 128 + 256 END AS trg_len
FROM (SELECT doc_id, n, unnest(range(0, n, 128)) AS begin
  FROM (SELECT doc_id, max(n) AS n FROM tokens GROUP BY doc_id))
WHERE begin = 0 OR begin - 128 + 256 < n""", TOKENS)
add("stratified_split", f"""
SELECT {RECORD}, rank <= ceil(n * 0.2) AS is_valid FROM (
  SELECT *, count(*) OVER (PARTITION BY lang) AS n,
    row_number() OVER (PARTITION BY lang
      ORDER BY ((doc_id % 2147483648) * 1103515245 + 12345) % 2147483648, doc_id) AS rank
  FROM documents)""")
add("class_argmax", """
SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS label FROM embeddings""")
_SLICES = f"""slices AS (
  SELECT doc_id, i::INT AS chunk_no, substring(text, (i * {P.CHUNK_SIZE} + 1)::BIGINT, {P.CHUNK_SIZE}) AS part
  FROM (SELECT doc_id, text, unnest(range((length(text) + {P.CHUNK_SIZE - 1}) // {P.CHUNK_SIZE})) AS i
    FROM documents))"""
add("split_over_length", f"""
SELECT doc_id, 0 AS chunk_no, lang, md5(text) AS digest FROM documents
WHERE length(text) <= {P.CHUNK_SIZE}
UNION ALL SELECT doc_id, chunk_no, NULL, md5(part) FROM slices
WHERE doc_id IN (SELECT doc_id FROM documents WHERE length(text) > {P.CHUNK_SIZE})""", _SLICES)
add("distinct_labels", "SELECT DISTINCT lang FROM documents")

# The references that occur in the pages; "&" last, so a pass decodes once.
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"),
             ("&nbsp;", " "), ("&#39;", "'"), ("&amp;", "&")]


def decoded(text: str) -> str:
    for entity, character in _ENTITIES:
        text = f"replace({text}, {q(entity)}, {q(character)})"
    return text


_CLEAN = f"regexp_replace(html, {q(P.MARKUP)}, '', 'g')"
add("markup_to_text", f"""
SELECT page_id, length(t) AS n, md5(t) AS digest
FROM (SELECT page_id, {decoded(decoded(_CLEAN))} AS t FROM pages)""")
add("entity_unescape", f"""
SELECT page_id, length(t) AS n, md5(t) AS digest
FROM (SELECT page_id, {decoded('html')} AS t FROM pages)""")
add("lower_case", "SELECT doc_id, md5(lower(text)) AS digest FROM documents")
add("word_tokens", "SELECT doc_id, pos::INT AS pos, tok FROM tokens", TOKENS)
add("sentences", f"""
SELECT doc_id, i::INT AS pos, md5(s) AS digest
FROM (SELECT doc_id, unnest(s) AS s, unnest(range(len(s))) AS i
  FROM (SELECT doc_id, {SENTENCES} AS s FROM documents))""")
add("words_per_sentence", f"""
SELECT doc_id, unnest(range(len(s)))::INT AS pos, unnest(s)::INT AS n
FROM (SELECT doc_id, {LENGTHS} AS s FROM documents)""")
add("text_chunks", "SELECT doc_id, chunk_no, length(part) AS n, md5(part) AS digest FROM slices",
    _SLICES)
add("pair_labels", "SELECT label, count(*) AS n FROM cased_pairs GROUP BY label", CASED, _CASED_PAIRS)
add("file_stems", r"""
SELECT page_id, regexp_replace(regexp_extract(replace(url, '\', '/'), '([^/]*)$', 1),
  '\.[^.]*$', '', 'g') AS stem FROM pages""")
add("source_file_rows", "SELECT 'documents' AS stem, count(*) AS n FROM documents")
add("flattened_layers", "SELECT vec_id, slot::INT AS pos, value FROM values_", VALUES)
add("softmax_scores", f"""
SELECT vec_id, slot::INT AS class, {r6('exp(value) / sum(exp(value)) OVER (PARTITION BY vec_id)')} AS p
FROM values_""", VALUES)
add("math_functions", f"""
SELECT lang, {r6('avg(ln(n_chars))')} AS mean_log, {r6('avg(exp(-n_chars / 1000))')} AS mean_exp,
  {r6('avg(abs(n_chars - 2000))')} AS mean_abs, {r6('stddev_pop(n_chars / 1000)')} AS std
FROM documents GROUP BY lang""")
add("nested_vectors", f"""
SELECT doc_id, unnest(range(len(v)))::INT AS pos, unnest(v) AS value FROM (
  SELECT doc_id, list_concat(list_concat([n_chars::DOUBLE, len(s)::DOUBLE], s::DOUBLE[]),
    [(lang = 'de')::INT::DOUBLE, (lang = 'en')::INT::DOUBLE, (lang = 'es')::INT::DOUBLE,
     (lang = 'fr')::INT::DOUBLE]) AS v
  FROM (SELECT doc_id, lang, n_chars, {LENGTHS} AS s FROM documents))""")

# ---------------------------------------------------------------------- model side

_EXTREMES = "[list_max(embedding)::DOUBLE, list_min(embedding)::DOUBLE]"
add("assembled_vectors", f"""
SELECT vec_id, unnest(range(len(v)))::INT AS pos, unnest(v) AS value
FROM (SELECT vec_id, list_concat(embedding[1:32]::DOUBLE[], {_EXTREMES}) AS v FROM embeddings)""")
add("assembled_vectors_with_id", f"""
SELECT vec_id, unnest(range(len(v)))::INT AS pos, unnest(v) AS value
FROM (SELECT vec_id,
    list_concat(list_concat(embedding::DOUBLE[], [vec_id::DOUBLE]), {_EXTREMES}) AS v
  FROM embeddings)""")
add("stored_layers", f"""
SELECT vec_id, (slot // 16)::INT AS layer, count(*) AS width, {r6('sum(value)')} AS total
FROM values_ GROUP BY vec_id, slot // 16""", VALUES)

MODEL = f"""words_ AS (
  SELECT item_id, unnest(t) AS tok, unnest(range(len(t))) AS pos
  FROM (SELECT item_id, {tokens('lower(text)')} AS t FROM benchmark)),
model_pairs AS (
  SELECT prev, tok, count(*) AS c_pair
  FROM (SELECT lag(tok) OVER (PARTITION BY item_id ORDER BY pos) AS prev, tok FROM words_)
  WHERE prev IS NOT NULL GROUP BY ALL),
contexts AS (SELECT prev, sum(c_pair) AS c_prev FROM model_pairs GROUP BY prev),
size_ AS (SELECT count(DISTINCT tok) AS v FROM words_)"""


def perplexities(source: str, stride: int, width: int, name: str) -> str:
    """Windows as intervals joined to the tokens they score."""
    return f"""{name}_tokens AS (
  SELECT doc_id, chunk_no, unnest(t) AS tok, unnest(range(len(t))) AS pos, len(t) AS n
  FROM (SELECT doc_id, chunk_no, {tokens('lower(part)')} AS t FROM {source})),
{name}_losses AS (
  SELECT doc_id, chunk_no, pos, n,
    -ln((coalesce(c_pair, 0) + 1) / (coalesce(c_prev, 0) + (SELECT v FROM size_) + 1)) AS loss
  FROM (SELECT *, lag(tok) OVER (PARTITION BY doc_id, chunk_no ORDER BY pos) AS prev FROM {name}_tokens)
  LEFT JOIN model_pairs USING (prev, tok) LEFT JOIN contexts USING (prev)),
{name}_windows AS (
  SELECT doc_id, chunk_no, begin, least(begin + {width}, n) AS stop,
    CASE WHEN begin = 0 THEN 0 ELSE begin - {stride} + {width} END AS start
  FROM (SELECT doc_id, chunk_no, n, unnest(range(0, n, {stride})) AS begin
    FROM (SELECT DISTINCT doc_id, chunk_no, n FROM {name}_tokens))
  WHERE begin = 0 OR begin - {stride} + {width} < n),
{name}_means AS (
  SELECT w.doc_id, w.chunk_no, w.begin, avg(loss) FILTER (WHERE l.pos > w.begin) AS loss
  FROM {name}_windows w JOIN {name}_losses l
    ON l.doc_id = w.doc_id AND l.chunk_no = w.chunk_no AND l.pos >= w.start AND l.pos < w.stop
  GROUP BY ALL),
{name} AS (
  SELECT doc_id, chunk_no,
    CASE WHEN count(loss) = count(*) THEN exp(avg(loss)) END AS perplexity
  FROM {name}_means GROUP BY ALL)"""


_WHOLE = "whole AS (SELECT doc_id, 0 AS chunk_no, text AS part FROM documents)"
_PIECES = f"""pieces AS (
  SELECT doc_id, 0 AS chunk_no, text AS part FROM documents WHERE length(text) <= {P.CHUNK_SIZE}
  UNION ALL SELECT s.doc_id, chunk_no, part FROM slices s JOIN documents d USING (doc_id)
  WHERE length(d.text) > {P.CHUNK_SIZE})"""
_BY_DOCUMENT = """by_document AS (
  SELECT doc_id, avg(perplexity) AS perplexity
  FROM documents LEFT JOIN chunk_scores USING (doc_id) GROUP BY doc_id)"""
add("text_perplexity", f"""
SELECT doc_id, {r6('perplexity')} AS perplexity FROM documents LEFT JOIN scores USING (doc_id)""",
    MODEL, _WHOLE, perplexities("whole", 128, 256, "scores"))
_DOCUMENT_SCORES = (MODEL, _SLICES, _PIECES,
                    perplexities("pieces", P.STRIDE, P.WINDOW_TOKENS, "chunk_scores"), _BY_DOCUMENT)
add("document_perplexity", f"SELECT doc_id, {r6('perplexity')} AS perplexity FROM by_document",
    *_DOCUMENT_SCORES)

LANGUAGE = """letters AS (SELECT doc_id, lang, lower(text) AS t FROM documents),
grams AS (
  SELECT doc_id, lang, substring(t, i, 3) AS gram
  FROM (SELECT doc_id, lang, t, unnest(range(1, length(t) - 1)) AS i FROM letters)),
profile AS (SELECT gram, lang, count(*) AS c FROM grams GROUP BY ALL),
totals AS (
  SELECT lang, sum(c) + (SELECT count(DISTINCT gram) FROM profile) + 1 AS total
  FROM profile GROUP BY lang),
text_grams AS (SELECT doc_id, gram, count(*) AS n FROM grams GROUP BY ALL),
language_scores AS (
  SELECT g.doc_id, t.lang, sum(n * ln((coalesce(p.c, 0) + 1) / t.total)) AS score
  FROM text_grams g CROSS JOIN totals t
  LEFT JOIN profile p ON p.gram = g.gram AND p.lang = t.lang GROUP BY ALL),
languages AS (
  SELECT d.doc_id, coalesce(s.lang, 'en') AS lang FROM documents d LEFT JOIN (
    SELECT doc_id, lang FROM language_scores
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1) s USING (doc_id))"""
add("detected_language", "SELECT doc_id, lang AS language FROM languages", LANGUAGE)
add("token_tags", "SELECT doc_id, pos::INT AS pos, tok, tag FROM tagged", CASED, TAGGED)


def feature_select(multilingual: bool) -> str:
    columns = feature_names(multilingual)
    scaled = ", ".join(
        r6(f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0), 0)") + f" AS {c}"
        for c in columns
    )
    return f"""
SELECT z.*, {r6('perplexity / (SELECT max(abs(perplexity)) FROM by_document)')} AS perplexity
FROM (SELECT doc_id, {scaled} FROM raw) z JOIN by_document USING (doc_id)"""


def raw(multilingual: bool) -> str:
    zero = {*BIGRAMS, "avg_pmi", "avg_npmi", *map(lexicon.tag_column, P.TAGS_MONO + P.TAGS_MULTI)}
    columns = ", ".join(
        "coalesce(errors.n, 0)::DOUBLE AS spelling_error" if c == "spelling_error"
        else f"coalesce({c}, 0)::DOUBLE AS {c}" if c in zero else f"{c}::DOUBLE AS {c}"
        for c in feature_names(multilingual)
    )
    errors = "" if multilingual else " LEFT JOIN errors USING (doc_id)"
    return f"""raw AS (
  SELECT doc_id, {columns} FROM style LEFT JOIN pmi USING (doc_id) LEFT JOIN tops USING (doc_id)
  LEFT JOIN shares USING (doc_id){errors})"""


add("feature_table", feature_select(False), TOKENS, PAIRS, COUNTED_PAIRS, PMI, STYLE, CASED, TAGGED,
    shares(P.TAGS_MONO), DICTIONARY, *_DOCUMENT_SCORES, raw(False))
add("multilingual_feature_table", feature_select(True), TOKENS, PAIRS, COUNTED_PAIRS, PMI, STYLE,
    CASED, LANGUAGE, universal_tagged("languages"), shares(P.TAGS_MULTI), *_DOCUMENT_SCORES,
    raw(True))

# ---------------------------------------------------------------------- evaluation

SCORED = """joined AS (SELECT id, p.label AS p, g.label AS g FROM pred p JOIN gold g USING (id)),
classes AS (
  SELECT label, count(*) FILTER (WHERE p = label AND g = label) AS tp,
    count(*) FILTER (WHERE p = label AND g <> label) AS fp,
    count(*) FILTER (WHERE g = label AND p <> label) AS fn
  FROM joined JOIN (SELECT p AS label FROM joined UNION SELECT g FROM joined)
    ON label = p OR label = g GROUP BY label),
scored_classes AS (
  SELECT label, tp, fp, fn, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
    coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
    coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, tp + fn AS support FROM classes)"""
_SUMMARY = f"""
SELECT {r6('avg(f1)')} AS macro_f1, {r6('sum(2 * tp) / sum(2 * tp + fp + fn)')} AS micro_f1,
  {r6('(SELECT avg((p = g)::INT) FROM joined)')} AS accuracy FROM scored_classes"""
add("two_class_scores", _SUMMARY, _PRED, _GOLD, SCORED)
add("validated_scores", _SUMMARY, _PRED, _GOLD, SCORED)
add("submission_file_scores", _SUMMARY, _PRED, _GOLD, SCORED)
add("rejected_submission", """
SELECT 0.0::DOUBLE AS macro_f1, 0.0::DOUBLE AS micro_f1, 0.0::DOUBLE AS accuracy FROM embeddings
WHERE (SELECT count(*) FROM embeddings WHERE label NOT BETWEEN 0 AND 5) = 0""")
_NUMBER = "list_position(['de', 'en', 'es', 'fr'], lang) - 1"
_LANGUAGE_LABELS = (
    LANGUAGE,
    f"pred AS (SELECT doc_id AS id, {_NUMBER} AS label FROM languages)",
    f"gold AS (SELECT doc_id AS id, {_NUMBER} AS label FROM documents)",
)
add("language_scores", _SUMMARY, *_LANGUAGE_LABELS, SCORED)
add("class_scores", f"""
SELECT label, tp, fp, fn, {all_rounded(('precision', 'recall', 'f1'))}, support
FROM scored_classes""", _PRED, _GOLD, SCORED)
_TOTAL = "sum(support)::BIGINT AS support"


def report_row(name: str, expression: str) -> str:
    columns = ", ".join(f"{r6(expression.format(c=c))} AS {c}" for c in ("precision", "recall", "f1"))
    return f"SELECT {q(name)} AS row, {columns}, {_TOTAL} FROM scored_classes"


add("classification_report", f"""
SELECT label::VARCHAR AS row, {all_rounded(('precision', 'recall', 'f1'))}, support FROM scored_classes
UNION ALL {report_row('accuracy', 'sum(tp) / sum(support)')}
UNION ALL {report_row('macro avg', 'avg({c})')}
UNION ALL {report_row('weighted avg', 'sum({c} * support) / sum(support)')}""", _PRED, _GOLD, SCORED)
_MATRIX = """
SELECT a.g::INT AS label_gold, b.g::INT AS label_pred, count(joined.id) AS n
FROM (SELECT DISTINCT label AS g FROM gold WHERE label IS NOT NULL) a
CROSS JOIN (SELECT DISTINCT label AS g FROM gold WHERE label IS NOT NULL) b
LEFT JOIN joined ON joined.g = a.g AND joined.p = b.g GROUP BY ALL"""
add("confusion_matrix", _MATRIX, _PRED, _GOLD, SCORED)
add("language_confusion_matrix", _MATRIX, *_LANGUAGE_LABELS, SCORED)
add("format_check", """
SELECT 1 AS check_no, 'id is null' AS "check", count(*) FILTER (WHERE vec_id IS NULL) AS n_bad,
  count(*) FILTER (WHERE vec_id IS NULL) = 0 AS ok FROM embeddings
UNION ALL SELECT 2, 'label is null', count(*) FILTER (WHERE label IS NULL),
  count(*) FILTER (WHERE label IS NULL) = 0 FROM embeddings
UNION ALL SELECT 3, 'unknown label', count(*) FILTER (WHERE label IS NULL OR label NOT BETWEEN 0 AND 5),
  count(*) FILTER (WHERE label IS NULL OR label NOT BETWEEN 0 AND 5) = 0 FROM embeddings""")
add("submitted_labels", "SELECT DISTINCT label FROM embeddings")
add("repeated_ids", """
SELECT conv_id AS id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1""")

ORACLE_SQL["feature_file"] = ORACLE_SQL["feature_table"]
add("submission_checks", """
SELECT 'good' AS file, * FROM (VALUES (0, 'malformed line', 0::BIGINT, true), (1, 'id is null', 0, true),
  (2, 'label is null', 0, true), (3, 'unknown label', 0, true)) v(check_no, "check", n_bad, ok)
UNION ALL SELECT 'other', * FROM (VALUES (0, 'malformed line', 0::BIGINT, true),
  (1, 'id is null', 0, true), (2, 'label is null', 0, true)) v(check_no, "check", n_bad, ok)
UNION ALL SELECT 'other', 3, 'unknown label', count(*), count(*) = 0
  FROM embeddings WHERE label NOT IN (0, 1)
UNION ALL SELECT 'absent', 0, 'file is missing', 1, false""")

# ------------------------------------------------------------- learning, as far as exact

_DRAWN = """drawn AS (
  SELECT vec_id FROM (
    SELECT vec_id, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label
      ORDER BY ((vec_id % 2147483648) * 1103515245 + 12345) % 2147483648, vec_id) AS rank
    FROM embeddings) WHERE rank <= ceil(n * 0.2))"""
# The optimum by another way: accelerated steps along the gradient, as short as the trace allows.
_STEPS, _WIDTH = 2500, 67
_SEARCH = f"""x AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS i, label,
    list_concat(list_concat(embedding::DOUBLE[], {_EXTREMES}), [1.0::DOUBLE]) AS v
  FROM embeddings ANTI JOIN drawn USING (vec_id)),
xt AS MATERIALIZED (SELECT j, list(v[j] ORDER BY i) AS col FROM x, range(1, {_WIDTH + 1}) r(j) GROUP BY j),
bounds AS MATERIALIZED (
  SELECT 1 + 2 * sum(list_dot_product(v, v)) AS steep, (sqrt(steep) - 1) / (sqrt(steep) + 1) AS momentum FROM x),
search AS (
  SELECT 0 AS step, label AS k, list_transform(range({_WIDTH}), lambda j: 0.0::DOUBLE) AS w,
    list_transform(range({_WIDTH}), lambda j: 0.0::DOUBLE) AS z
  FROM x GROUP BY label
  UNION ALL
  SELECT step + 1, k, u, list_transform(list_zip(u, w), lambda p: p[1] + momentum * (p[1] - p[2]))
  FROM (
    SELECT step, k, any_value(w) AS w, any_value(momentum) AS momentum,
      list(z[j] - (z[j] - 2 * list_dot_product(c, col)) / steep ORDER BY j) AS u
    FROM (
      SELECT step, k, any_value(w) AS w, any_value(z) AS z, list(y * greatest(0, 1 - y * s) ORDER BY i) AS c
      FROM (
        SELECT step, k, w, z, i, CASE WHEN label = k THEN 1 ELSE -1 END AS y, list_dot_product(z, v) AS s
        FROM search, x WHERE step < {_STEPS})
      GROUP BY step, k), xt, bounds
    GROUP BY step, k)),
found AS (SELECT k, w FROM search WHERE step = {_STEPS})"""
_PREDICTED = f"""pred AS (
  SELECT id, k AS label FROM (
    SELECT vec_id AS id, k, list_dot_product(w,
      list_concat(list_concat(embedding::DOUBLE[], {_EXTREMES}), [1.0::DOUBLE])) AS s
    FROM embeddings SEMI JOIN drawn USING (vec_id), found)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, k) = 1)"""
_TRUTH = "gold AS (SELECT vec_id AS id, label FROM embeddings SEMI JOIN drawn USING (vec_id))"


def searched(name: str, select: str, *ctes: str) -> None:
    add(name, select, _DRAWN, _SEARCH, *ctes)
    ORACLE_SQL[name] = ORACLE_SQL[name].replace("WITH ", "WITH RECURSIVE ", 1)


searched("support_vector_weights", f"""
SELECT k AS label, unnest(range({_WIDTH}))::INT AS pos, round(unnest(w), 4) + 0.0 AS weight FROM found""")
searched("predicted_labels", "SELECT id, label FROM pred", _PREDICTED)
searched("predicted_label_scores", _SUMMARY, _PREDICTED, _TRUTH, SCORED)
add("fixed_weight_labels", """
SELECT vec_id AS id, (list_position(s, list_max(s)) - 1)::INT AS label FROM (
  SELECT vec_id, list_transform(range(6), lambda c: list_sum(list_transform(range(64),
    lambda i: embedding[i + 1]::DOUBLE * ((31 * c + 17 * i) % 13 - 6) / 8))) AS s
  FROM embeddings)""")

# --------------------------------------------------------- texts under repeated ids

# Each turn is a document of its own here; the name hides the table.
_TURNS = """documents AS MATERIALIZED (
  SELECT row_number() OVER () AS doc_id, conv_id, text FROM conversations)"""
add("turn_coherence", f"""
SELECT conv_id, {r6('coalesce(avg_pmi, 0)')} AS avg_pmi, {r6('coalesce(avg_npmi, 0)')} AS avg_npmi, {", ".join(f"coalesce({c}, 0)::DOUBLE AS {c}" for c in BIGRAMS)}
FROM documents LEFT JOIN pmi USING (doc_id) LEFT JOIN tops USING (doc_id)""",
    _TURNS, TOKENS, PAIRS, COUNTED_PAIRS, PMI)
add("turn_bigram_counts", """
SELECT any_value(conv_id) AS conv_id, string_agg(coalesce(n, 0)::VARCHAR, ',' ORDER BY place) AS counts
FROM documents CROSS JOIN range(least(10, (SELECT count(DISTINCT bigram) FROM bag))) r(place)
LEFT JOIN (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) - 1 AS place
  FROM bag) USING (doc_id, place) GROUP BY doc_id""", _TURNS, CASED, _CASED_PAIRS, _BAG)
add("turn_tag_shares",
    f"SELECT conv_id, {or_zero(P.TAGS_MONO)} FROM documents LEFT JOIN shares USING (doc_id)",
    _TURNS, CASED, TAGGED, shares(P.TAGS_MONO))
add("turn_spelling_errors", """
SELECT conv_id, coalesce(n, 0) AS spelling_error FROM documents LEFT JOIN errors USING (doc_id)""",
    _TURNS, TOKENS, DICTIONARY)
add("turn_perplexity", f"""
SELECT conv_id, {r6('perplexity')} AS perplexity FROM documents LEFT JOIN scores USING (doc_id)""",
    _TURNS, MODEL, _WHOLE, perplexities("whole", 8, 16, "scores"))
add("turn_languages", """
SELECT t.conv_id, coalesce(s.lang, 'en') AS language FROM turns t LEFT JOIN (
  SELECT turn_id, lang FROM (
    SELECT g.turn_id, t.lang, sum(n * ln((coalesce(p.c, 0) + 1) / t.total)) AS score
    FROM (SELECT turn_id, gram, count(*) AS n FROM turn_grams GROUP BY ALL) g CROSS JOIN totals t
    LEFT JOIN profile p ON p.gram = g.gram AND p.lang = t.lang GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY score DESC, lang) = 1) s USING (turn_id)""",
    LANGUAGE.partition("totals AS (")[0].rstrip().rstrip(","),
    "totals AS (" + LANGUAGE.partition("totals AS (")[2].partition("text_grams AS")[0].rstrip().rstrip(","),
    """turns AS MATERIALIZED (SELECT row_number() OVER () AS turn_id, conv_id, lower(text) AS t FROM conversations),
turn_grams AS (
  SELECT turn_id, substring(t, i, 3) AS gram
  FROM (SELECT turn_id, t, unnest(range(1, length(t) - 1)) AS i FROM turns))""")

# ------------------------------------------------------------ perplexity of three words

# Kneser-Ney from its definition, level by level; the Spark side has final tables and lookups.
_D = 0.75
_TRIGRAMS = f"""kn_words AS (
  SELECT item_id, unnest(t) AS tok, unnest(range(len(t))) AS pos
  FROM (SELECT item_id, {tokens('lower(text)')} AS t FROM benchmark)),
kn3 AS MATERIALIZED (
  SELECT w1, w2, w3, count(*) AS n FROM (
    SELECT lag(tok, 2) OVER o AS w1, lag(tok) OVER o AS w2, tok AS w3 FROM kn_words
    WINDOW o AS (PARTITION BY item_id ORDER BY pos)) WHERE w1 IS NOT NULL GROUP BY ALL),
kn2 AS MATERIALIZED (SELECT w2, w3, count(DISTINCT w1) AS n FROM kn3 GROUP BY ALL),
kn1 AS MATERIALIZED (SELECT w3, count(DISTINCT w2) AS n FROM kn2 GROUP BY ALL),
kn0 AS (SELECT {_D} * count(*) / sum(n) / (1 + (SELECT count(DISTINCT tok) FROM kn_words)) AS p0, sum(n) AS t FROM kn1),
c2 AS (SELECT w2, sum(n) AS t2, {_D} * count(*) / sum(n) AS b2 FROM kn2 GROUP BY w2),
c3 AS (SELECT w1, w2, sum(n) AS t3, {_D} * count(*) / sum(n) AS b3 FROM kn3 GROUP BY ALL)"""


def _interpolated(rows: str) -> str:
    """Add p1, p2 and p3 to rows of (w1, w2, w3)."""
    share = lambda n, t: f"greatest(coalesce({n}, 0) - {_D}, 0) / {t}"
    return f"""(SELECT *, CASE WHEN t3 IS NULL THEN p2 ELSE {share('n3', 't3')} + b3 * p2 END AS p3 FROM (
    SELECT *, CASE WHEN t2 IS NULL THEN p1 ELSE {share('n2', 't2')} + b2 * p1 END AS p2 FROM (
      SELECT r.*, kn3.n AS n3, kn2.n AS n2, t3, b3, t2, b2,
        {share('kn1.n', 'kn0.t')} + p0 AS p1
      FROM {rows} r CROSS JOIN kn0
      LEFT JOIN kn1 ON kn1.w3 = r.w3
      LEFT JOIN kn2 ON kn2.w2 = r.w2 AND kn2.w3 = r.w3
      LEFT JOIN kn3 ON kn3.w1 = r.w1 AND kn3.w2 = r.w2 AND kn3.w3 = r.w3
      LEFT JOIN c2 ON c2.w2 = r.w2 LEFT JOIN c3 ON c3.w1 = r.w1 AND c3.w2 = r.w2)))"""


add("trigram_word_probabilities", f"""
SELECT word, n3, {r6('p1')} AS p1, {r6('p2')} AS p2, {r6('p3')} AS p3 FROM (
  SELECT w3 AS word, count(*) AS n3, sum(p3) AS p3, any_value(p1) AS p1 FROM {_interpolated('kn3')} GROUP BY w3)
JOIN (SELECT w3 AS word, sum(p2) AS p2 FROM {_interpolated("(SELECT NULL::VARCHAR AS w1, w2, w3 FROM kn2)")} GROUP BY w3)
  USING (word)""", _TRIGRAMS)


def trigram_perplexities(stride: int, width: int) -> str:
    return f"""kn_tokens AS MATERIALIZED (
  SELECT doc_id, unnest(t) AS tok, unnest(range(len(t))) AS pos, len(t) AS n
  FROM (SELECT doc_id, {tokens('lower(text)')} AS t FROM documents)),
kn_windows AS (
  SELECT doc_id, begin, least(begin + {width}, n) AS stop,
    CASE WHEN begin = 0 THEN 0 ELSE begin - {stride} + {width} END AS start
  FROM (SELECT doc_id, n, unnest(range(0, n, {stride})) AS begin FROM (SELECT DISTINCT doc_id, n FROM kn_tokens))
  WHERE begin = 0 OR begin - {stride} + {width} < n),
kn_rows AS (
  SELECT t.doc_id, begin, pos, CASE WHEN pos > begin + 1 THEN two END AS w1, one AS w2, tok AS w3
  FROM (SELECT *, lag(tok) OVER o AS one, lag(tok, 2) OVER o AS two FROM kn_tokens
    WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) t
  JOIN kn_windows w ON t.doc_id = w.doc_id AND pos >= start AND pos < stop),
kn_means AS (
  SELECT doc_id, begin, avg(-ln(p3)) FILTER (WHERE pos > begin) AS loss
  FROM {_interpolated('kn_rows')} GROUP BY ALL),
kn_scores AS (
  SELECT doc_id, CASE WHEN count(loss) = count(*) THEN exp(avg(loss)) END AS perplexity FROM kn_means GROUP BY ALL)"""


add("text_trigram_perplexity", f"""
SELECT doc_id, {r6('perplexity')} AS perplexity FROM documents LEFT JOIN kn_scores USING (doc_id)""",
    _TRIGRAMS, trigram_perplexities(128, 256))
add("turn_trigram_perplexity", f"""
SELECT conv_id, {r6('perplexity')} AS perplexity FROM documents LEFT JOIN kn_scores USING (doc_id)""",
    _TURNS, _TRIGRAMS, trigram_perplexities(8, 16))

"""DuckDB twins of the queries that SQL can express."""

from inkprint.llm.quality_rules import ALPHA, COST, DELTA, GRID, MIN_WORDS, RULES

_REPEATS = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13
), x AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS window_text FROM s
), f AS (
  SELECT window_text, min(doc_id) AS first_doc FROM x GROUP BY window_text
), c AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS k
  FROM x JOIN f USING (window_text) WHERE first_doc < doc_id
), g AS (
  SELECT doc_id, list(k) AS gone FROM c GROUP BY doc_id
), p AS (
  SELECT d.doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d
), k AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY k) AS kept
  FROM p ANTI JOIN c USING (doc_id, k) GROUP BY p.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""



_SCORES = {rule: text.replace(" div ", " // ") for rule, text in RULES.items()}
_COUNTS = ", ".join(
    f"sum((label = {label} AND {rule} > cutoff)::INT) AS {rule}_{kind}"
    for rule in RULES
    for label, kind in ((1, "good"), (0, "bad"))
)
_CHAINS = " UNION ALL ".join(
    f"SELECT stratum, {i} AS place, '{rule}' AS rule, step, cutoff, n_good, {rule}_good AS lost, {rule}_bad AS caught FROM counts"
    for i, rule in enumerate(RULES)
)
_OVER = " UNION ALL ".join(
    f"SELECT doc_id, place, c.rule FROM scored s JOIN chosen c ON s.stratum = c.stratum AND c.rule = '{rule}' AND s.{rule} > c.cutoff"
    for rule in RULES
)
#: Documents have ids of their own here, as in the test tables.
_RULES = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), runs AS (
  SELECT doc_id, i, w[i:i + 2] AS run FROM (
    SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)
), again AS (
  SELECT doc_id, i FROM runs QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM again)
  GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (
    SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT d.doc_id, stratum, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lines.n, 0)::BIGINT AS n_lines, coalesce(dup, 0)::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
    length(t) - length(replace(t, '!', '')) AS n_exclaims
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), scored AS MATERIALIZED (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    {", ".join(f"{text} AS {rule}" for rule, text in _SCORES.items())} FROM m
), grid AS (
  SELECT unnest({GRID}) AS cutoff, unnest(range({len(GRID)})) AS step
), counts AS MATERIALIZED (
  SELECT stratum, step, cutoff, sum((label = 1)::INT) AS n_good, {_COUNTS}
  FROM scored JOIN (SELECT doc_id, quality AS label FROM labels WHERE quality IN (0, 1)) USING (doc_id)
  CROSS JOIN grid WHERE NOT base_failed GROUP BY ALL
), chains AS ({_CHAINS}
), tests AS (
  SELECT *, n_good > 0 AND list_sum(list_transform(range(lost::BIGINT + 1), lambda i: exp(
      lgamma(n_good + 1) - CASE WHEN i > 0 THEN lgamma(i + 1) ELSE 0 END
      - CASE WHEN n_good > i THEN lgamma(n_good - i + 1) ELSE 0 END
      + i * ln({ALPHA} / {len(RULES)}) + (n_good - i) * ln(1 - {ALPHA} / {len(RULES)}))))
    <= {DELTA} / ((SELECT count(DISTINCT stratum) FROM counts) * {len(RULES)}) AS passed
  FROM chains
), certified AS (
  SELECT *, bool_and(passed) OVER (PARTITION BY stratum, rule ORDER BY step) AS sure,
    caught - {COST} * lost AS gain FROM tests
), chosen AS (
  SELECT stratum, place, rule, cutoff FROM certified WHERE sure AND gain > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, step) = 1
), rejected AS (
  SELECT doc_id, string_agg(rule, ',' ORDER BY place) AS rejected_by FROM ({_OVER}) GROUP BY doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rejected_by IS NULL AS kept, coalesce(rejected_by, '') AS rejected_by
FROM scored LEFT JOIN rejected USING (doc_id)
"""


def _strength(name: str, source: str) -> str:
    """Strength of a level from its groups (n, bad), as one row."""
    return f"""{name}_sums AS (
  SELECT count(*) AS k, sum(n) AS a, sum(n * n) AS squares,
    sum(n * (bad / n - m) * (bad / n - m)) AS between_, sum(n * (bad / n) * (1 - bad / n)) AS within_
  FROM (SELECT n::DOUBLE AS n, bad::DOUBLE AS bad, sum(bad) OVER () / sum(n) OVER () AS m
    FROM {source} WHERE n > 0)),
{name}_means AS (
  SELECT k, a, between_ / nullif(k - 1, 0) AS msb, within_ / nullif(a - k, 0) AS msw,
    (a - squares / a) / nullif(k - 1, 0) AS size FROM {name}_sums),
{name}_strength AS (
  SELECT (1 - rho) / rho AS s FROM (
    SELECT least(greatest(CASE WHEN k > 1 AND a > k AND msb + (size - 1) * msw > 0
      THEN (msb - msw) / (msb + (size - 1) * msw) ELSE 0.0 END, 0.001), 0.999) AS rho
    FROM {name}_means))"""


_URLS = rf"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), u AS (
  SELECT page_id, coalesce(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2), '') AS path,
    translate(coalesce(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
  FROM p
), o AS (
  SELECT host, 1 - quality AS bad FROM (
    SELECT host, try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:[/.]|$)', 1) AS BIGINT) AS doc_id FROM u)
  JOIN labels USING (doc_id) WHERE quality IS NOT NULL
), hosts AS (
  SELECT host, regexp_extract(host, '([^.]*\.)?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix,
    coalesce(c.n, 0) AS n, coalesce(c.bad, 0) AS bad
  FROM (SELECT DISTINCT host FROM u) LEFT JOIN
    (SELECT host, count(*) AS n, sum(bad) AS bad FROM o GROUP BY host) c USING (host)
), whole AS (SELECT sum(bad) / nullif(sum(n), 0) AS m FROM hosts),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY suffix),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
{_strength('suffix', 'suffixes')},
{_strength('domain', 'domains')},
{_strength('host', 'hosts')},
suffix_rates AS (SELECT suffix, (bad + s * m) / (n + s) AS m FROM suffixes, suffix_strength, whole),
domain_rates AS (
  SELECT domain, (bad + s * m) / (n + s) AS m FROM domains JOIN suffix_rates USING (suffix), domain_strength),
posterior AS (
  SELECT host, n, bad, bad + s * m AS a, n - bad + s * (1 - m) AS b
  FROM hosts JOIN domain_rates USING (domain), host_strength),
bounds AS (
  SELECT host, n, bad, a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS low
  FROM posterior),
rules(action, site, begin_) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'),
    ('allow', 'org', '/fr/')),
fits AS (
  SELECT page_id, arg_max(site || begin_, length(site || begin_)) AS rule,
    arg_max(action, length(site || begin_)) AS action
  FROM u JOIN rules ON (host = site OR suffix(host, '.' || site)) AND starts_with(path, begin_)
  GROUP BY page_id)
SELECT u.page_id, u.host, u.path, rule,
  coalesce(action, CASE WHEN low > 0.3 THEN 'block' ELSE 'allow' END) AS verdict,
  n::BIGINT AS n_labelled, bad::BIGINT AS n_bad
FROM u JOIN bounds USING (host) LEFT JOIN fits USING (page_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": _REPEATS,
    "op3_quality_rules": _RULES,
    "op4_url_filter": _URLS,
}

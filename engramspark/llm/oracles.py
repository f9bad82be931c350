"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from engramspark.llm.line_quality import BOILERPLATE, LineRules
from engramspark.llm.mixing import MARGINS, MixSettings

SPACE = "[ \\t-\\r]"


def line_quality_ctes(source: str, rules: LineRules = LineRules()) -> str:
    """CTEs up to ``judged``: every column of ``source``, the counts and the verdict of the line rules, and the clean text."""
    phrases = "|".join(p.replace("(", "\\(").replace(")", "\\)") for p in BOILERPLATE)
    return f"""
    split_up AS (
      SELECT *, coalesce(text, '') AS body, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS lines
      FROM {source}),
    windowed AS (
      SELECT *, list_transform(range(1, greatest(1, len(w) - 1)), lambda i: row(w[i], w[i + 1], w[i + 2])) AS grams FROM split_up),
    counted AS (
      SELECT *, [g.g FOR g IN [{{'g': k, 'n': map_extract(c, k)[1]}} FOR k IN map_keys(c)] IF g.n > 1] AS again
      FROM (SELECT *, coalesce(list_histogram(grams), MAP {{}}) AS c FROM windowed)),
    placed AS (
      SELECT *, [i FOR i IN range(1, len(grams) + 1) IF list_contains(again, grams[i])] AS spots,
             [l.l FOR l IN [{{'l': lines[i], 'w': string_split_regex(lines[i], '{SPACE}+')}} FOR i IN range(1, len(lines) + 1)
                            IF list_position(lines, lines[i]) = i]
                IF length(regexp_replace(l.l, '[^#*$%&|<>]', '', 'g')) * 100 <= length(l.l) * {rules.symbol_pct}
               AND length(regexp_replace(l.l, '[^!]', '', 'g')) * 100 <= length(l.l) * {rules.shout_pct}
               AND NOT (length(l.l) >= {rules.plain_chars} AND NOT regexp_matches(l.l, '[.,;:!?]'))
               AND NOT regexp_matches(l.l, '(?i){phrases}')
               AND len([i FOR i IN range(1, len(l.w) - 3) IF l.w[i] = l.w[i + 1] AND l.w[i] = l.w[i + 2]
                        AND l.w[i] = l.w[i + 3] AND l.w[i] = l.w[i + 4]]) = 0] AS passed
      FROM counted),
    measured AS (
      SELECT *, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             len(list_distinct(flatten(list_transform(spots, lambda i: [i, i + 1, i + 2]))))::BIGINT AS n_repeat_words,
             len(lines)::BIGINT AS n_lines, len(passed)::BIGINT AS n_kept_lines,
             length(array_to_string(lines, ''))::BIGINT AS line_chars, length(array_to_string(passed, ''))::BIGINT AS kept_chars,
             array_to_string(passed, chr(10)) AS clean_text
      FROM placed),
    judged AS (
      SELECT *, n_words < {rules.min_words} OR n_repeat_words * 100 > n_words * {rules.max_repeat_pct} AS base_failed,
             NOT (n_words < {rules.min_words} OR n_repeat_words * 100 > n_words * {rules.max_repeat_pct})
             AND NOT ((line_chars - kept_chars) * 100 > line_chars * {rules.max_loss_pct}) AS kept
      FROM measured)"""


def mixing_ctes(source: str, settings: MixSettings = MixSettings()) -> str:
    """CTEs up to ``drawn``: every column of ``source`` (names as src, lng), topic, tokens, rate and kept."""
    steps, last = [], "fit0"
    for i in range(settings.rounds * len(MARGINS)):
        m = MARGINS[i % len(MARGINS)]
        steps.append(
            f"fit{i + 1} AS MATERIALIZED (SELECT f.* REPLACE (fit * share / sum(fit) OVER (PARTITION BY f.{m}) AS fit) FROM {last} f JOIN target_{m} t ON f.{m} = t.value)"
        )
        last = f"fit{i + 1}"
    targets = ",".join(
        f"""
    target_{m} AS MATERIALIZED (SELECT {m} AS value, pow(sum(w)::DOUBLE, {p}) / sum(pow(sum(w)::DOUBLE, {p})) OVER () AS share FROM cells GROUP BY {m})"""
        for m, p in zip(MARGINS, settings.powers, strict=True)
    )
    fills, scale = [f"fill0 AS MATERIALIZED (SELECT {settings.budget} * sum(w)::DOUBLE AS s, {settings.budget} * sum(w)::DOUBLE AS budget FROM {last})"], "fill0"
    for i in range(settings.fills):
        fills.append(
            f"""fill{i + 1} AS MATERIALIZED (
      SELECT CASE WHEN rest > 0 THEN s * (budget - filled) / rest ELSE s END AS s, budget FROM (
        SELECT any_value(s) AS s, any_value(budget) AS budget, coalesce(sum(w::DOUBLE) FILTER (fit * s >= w), 0) AS filled,
               coalesce(sum(fit * s) FILTER (fit * s < w), 0) AS rest FROM {last}, {scale}))"""
        )
        scale = f"fill{i + 1}"
    return f"""
    named AS (
      SELECT *, coalesce(text, '') AS body, coalesce(source, '') AS src, coalesce(lang, '') AS lng FROM {source}),
    known AS (
      SELECT *, CASE WHEN contains(body, ' | ') THEN 'table' WHEN contains(body, '@') THEN 'contact' WHEN contains(body, '=') THEN 'code'
                     WHEN contains(lower(body), 'license') OR contains(lower(body), 'rights reserved') THEN 'legal'
                     WHEN length(body) >= 4000 THEN 'long' ELSE 'prose' END AS topic,
             greatest(1, ceil(strlen(body) / 4))::BIGINT AS tokens FROM named),
    cells AS MATERIALIZED (SELECT src AS source, lng AS lang, topic, sum(tokens)::BIGINT AS w FROM known GROUP BY ALL),{targets},
    fit0 AS MATERIALIZED (SELECT *, w / (SELECT sum(w) FROM cells)::DOUBLE AS fit FROM cells),
    {", ".join(steps)},
    {", ".join(fills)},
    rated AS (SELECT source, lang, topic, round(least(1.0, fit * s / w), 9) AS rate FROM {last}, {scale}),
    drawn AS (
      SELECT k.* EXCLUDE (topic), k.topic, rate,
             ('0x' || substr(md5('{settings.salt}' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < rate AS kept
      FROM known k JOIN rated r ON k.src = r.source AND k.lng = r.lang AND k.topic = r.topic)"""


BLOCK_SEARCH = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), asked AS (
  SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL
), total AS (
  SELECT count(*) AS nd, sum(len(terms))::BIGINT AS lt FROM d WHERE len(terms) > 0
), held AS (
  SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d
), tf AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM held WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), df AS (
  SELECT term, count(*) AS df FROM tf GROUP BY term
), parts AS (
  SELECT r, doc_id, term,
         floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
           * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nd) // lt)))) AS part
  FROM tf JOIN df USING (term), total
), scores AS (
  SELECT item_id, r, doc_id, sum(times * part)::BIGINT AS score FROM asked JOIN parts USING (term) GROUP BY ALL
), ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10"""

ORACLES: dict[str, str] = {
    "op2_raking": f"""
    WITH {mixing_ctes("documents")}
    SELECT doc_id, src AS source, lng AS lang, topic, tokens, rate, kept FROM drawn""",
    "op10_line_quality": f"""
    WITH {line_quality_ctes("documents")}
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_kept_lines,
           line_chars, kept_chars FROM judged""",
    "op11_block_search": BLOCK_SEARCH,
}

"""Independent SQL for the registered queries, written for DuckDB over the same tables."""

from __future__ import annotations

from opinara import lexicons
from opinara.catalog import adapters as a
from opinara.functions import text

ORACLE: dict[str, str] = {}


# ---- building blocks ---------------------------------------------------------------------------

def _r(expr: str, digits: int) -> str:
    """Round half even to ``digits`` decimals, without a negative zero."""
    factor = f"{10 ** digits}::DOUBLE"
    return f"(round_even(({expr}) * {factor}, 0) / {factor} + 0.0::DOUBLE)"


def _pct(part: str, whole: str) -> str:
    return f"(({part})::DOUBLE / nullif(({whole})::DOUBLE, 0.0::DOUBLE) * 100.0::DOUBLE)"


def _mean(expr: str) -> str:
    """Mean over whole millionths, so that the order of summation does not matter."""
    total = f"sum(round_even(({expr}) * 1000000.0::DOUBLE, 0)::BIGINT)::DOUBLE / 1000000.0::DOUBLE"
    return f"({total} / nullif(count({expr})::DOUBLE, 0.0::DOUBLE))"


def _share(condition: str) -> str:
    return _pct(f"count(*) FILTER (WHERE {condition})", "count(*)")


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _values_case(word: str, mapping) -> str:
    cases = " ".join(f"WHEN '{w}' THEN {v}::DOUBLE" for w, v in mapping.items())
    return f"(CASE {word} {cases} END)"


REVIEWS = """
reviews AS (
  SELECT doc_id AS review_id, source AS place_name, source AS place_id,
         (1 + n_chars % 5)::DOUBLE AS place_rating, lang AS place_category, lang AS area,
         'addr ' || source AS place_address, text AS review_text,
         (1 + doc_id % 5)::DOUBLE AS review_rating,
         TIMESTAMP '2024-01-01' + (doc_id % 365)::INTEGER * INTERVAL 1 DAY AS review_ts,
         strftime(TIMESTAMP '2024-01-01' + (doc_id % 365)::INTEGER * INTERVAL 1 DAY, '%Y-%m-%d') AS review_date,
         'user ' || (doc_id % 97) AS reviewer_name, doc_id % 7 AS reviewer_photos, doc_id % 11 AS review_likes,
         (doc_id % 8)::INTEGER AS batch
  FROM documents)"""

CLEAN = REVIEWS + r""",
cleaned AS (
  SELECT * FROM (
    SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      strip_accents(coalesce(review_text, '')), 'http\S+|www\S+|https\S+', '', 'g'), '\S+@\S+', '', 'g'),
      '[^\p{L}\p{N}_\s.,!?;:''"\-()&%$#@]', '', 'g'), '\s+', ' ', 'g')) AS clean_text
    FROM reviews)
  WHERE length(clean_text) >= 5)"""

_STOP = _list(a.STOP_WORDS)

WORDS = CLEAN + rf""",
worded AS (
  SELECT *, list_filter(regexp_extract_all(lower(clean_text), '[\p{{L}}\p{{N}}_]{{2,}}'),
                        lambda w: NOT list_contains({_STOP}, w)) AS words
  FROM cleaned)"""

PREPARED = WORDS + r""",
tokenised AS (
  SELECT * EXCLUDE (words), list_filter(words, lambda w: NOT regexp_full_match(w, '\p{Nd}+')) AS tokens,
         len(string_split(clean_text, ' '))::INTEGER AS word_count, words
  FROM worded),
prepared AS (
  SELECT *, len(tokens)::INTEGER AS token_count,
         CASE WHEN word_count <= 0 THEN NULL WHEN word_count <= 10 THEN 'very_short'
              WHEN word_count <= 30 THEN 'short' WHEN word_count <= 50 THEN 'medium'
              WHEN word_count <= 100 THEN 'long' WHEN word_count <= 500 THEN 'very_long'
              WHEN word_count <= 10000 THEN 'extremely_long' END AS review_length_bucket
  FROM tokenised)"""


def _labels(source: str, total: str) -> str:
    """CTEs from a table with a valence total to the three sentiment columns."""
    compound = _r(f"{total} / sqrt({total} * {total} + 15.0::DOUBLE)", 4)
    return f""",
compounded AS (SELECT *, {compound} AS compound FROM {source}),
scored AS (
  SELECT * EXCLUDE (compound),
         CASE WHEN compound >= 0.05::DOUBLE THEN 'positive' WHEN compound <= -0.05::DOUBLE THEN 'negative'
              ELSE 'neutral' END AS sentiment,
         CASE WHEN compound <= -0.05::DOUBLE THEN abs(compound) ELSE compound END AS sentiment_score,
         CASE WHEN compound >= 0.05::DOUBLE THEN 1 WHEN compound <= -0.05::DOUBLE THEN -1 ELSE 0
         END::INTEGER AS sentiment_label_num
  FROM compounded)"""


_TOKEN_VALUE = f"coalesce({_values_case('w', a.VALENCES)}, 0.0::DOUBLE)"
SCORED = PREPARED + f""",
summed AS (
  SELECT *, coalesce(list_sum(list_transform(tokens, lambda w: {_TOKEN_VALUE})), 0.0::DOUBLE) AS valence
  FROM prepared)""" + _labels("summed", "valence")

_ASPECT_CASES = ", ".join(
    f"CASE WHEN list_has_any(tokens, {_list(words)}) THEN '{name}' END" for name, words in a.ASPECTS.items()
)
ANALYSED = SCORED + f""",
analysed AS (
  SELECT *, list_filter([{_ASPECT_CASES}], lambda x: x IS NOT NULL) AS aspects FROM scored),
aspect_names AS (
  SELECT unnest({_list(a.ASPECTS)}) AS aspect, unnest(range({len(a.ASPECTS)})) AS aspect_order)"""

# Dense aspect measures, overall and per place.
def _measures(polarity: str | None = None) -> str:
    wanted = "" if polarity is None else f" AND sentiment = '{polarity}'"
    hit = f"list_contains(aspects, aspect){wanted}"
    return f"""
  count(*) AS reviews,
  count(*) FILTER (WHERE sentiment = 'negative') AS negative_reviews,
  count(*) FILTER (WHERE sentiment = 'positive') AS positive_reviews,
  count(*) FILTER (WHERE {hit}) AS mentions,
  count(*) FILTER (WHERE {hit} AND sentiment = 'positive') AS positive,
  count(*) FILTER (WHERE {hit} AND sentiment = 'negative') AS negative,
  count(*) FILTER (WHERE {hit} AND sentiment IS NOT NULL) AS labelled,
  {_mean(f"CASE WHEN {hit} THEN sentiment_score END")} AS score_mean,
  {_mean(f"CASE WHEN {hit} THEN review_rating END")} AS rating_mean"""


GRID = ANALYSED + f""",
grid AS (SELECT aspect, aspect_order, {_measures()} FROM analysed CROSS JOIN aspect_names GROUP BY ALL)"""
PLACE_GRID = ANALYSED + f""",
grid AS (
  SELECT place_name, aspect, aspect_order, {_measures()} FROM analysed CROSS JOIN aspect_names
  WHERE place_name IS NOT NULL GROUP BY place_name, aspect, aspect_order)"""


def _zero(expr: str) -> str:
    return f"coalesce({expr}, 0.0::DOUBLE)"


_COMPLAINTS = f""",
complaints AS (
  SELECT aspect, mentions AS complaint_count, {_r(_pct('mentions', 'negative_reviews'), 1)} AS pct_of_negative_reviews,
         {_r(_pct('mentions', 'reviews'), 1)} AS pct_of_all_reviews, {_r('rating_mean', 2)} AS avg_rating
  FROM (SELECT aspect, aspect_order, {_measures('negative')} FROM analysed CROSS JOIN aspect_names GROUP BY ALL)
  WHERE mentions > 0 AND negative_reviews >= 3)"""
COMPLAINTS = ANALYSED + _COMPLAINTS

_STRENGTHS = f""",
strengths AS (
  SELECT aspect, {_r(_pct('mentions', 'positive_reviews'), 1)} AS strength_score,
         mentions AS positive_review_count, {_r('rating_mean', 2)} AS avg_rating
  FROM (SELECT aspect, aspect_order, {_measures('positive')} FROM analysed CROSS JOIN aspect_names GROUP BY ALL)
  WHERE mentions > 0)"""

_SEVERITY = ("CASE WHEN pct_of_negative_reviews > 20 THEN 'critical' WHEN pct_of_negative_reviews > 10 THEN 'high' "
             "WHEN pct_of_negative_reviews > 5 THEN 'medium' ELSE 'low' END")
_TEMPLATE_ROWS = ", ".join(
    "('{}', '{}', {})".format(n, t.replace("'", "''"), _list(acts)) for n, (t, acts) in lexicons.RECOMMENDATIONS.items()
)
RECOMMENDED = COMPLAINTS + f""",
templates(aspect, title, actions) AS (VALUES {_TEMPLATE_ROWS}),
recommended AS (
  SELECT aspect AS category, {_SEVERITY} AS severity, title, actions, complaint_count AS negative_review_count,
         pct_of_all_reviews AS negative_review_pct, avg_rating
  FROM complaints JOIN templates USING (aspect)),
prioritised AS (
  SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1
                                        WHEN 'medium' THEN 2 ELSE 3 END,
                               negative_review_count DESC, category)::INTEGER AS priority
  FROM recommended),
roadmap AS (
  SELECT priority, severity, category, unnest(actions) AS action_item, category AS impact_area,
         'Medium' AS estimated_effort, 'Reduction in negative reviews about ' || category AS measure_of_success
  FROM prioritised)"""

_SUMMARY = f"""
  count(sentiment) AS total_reviews,
  {_r(_share("sentiment = 'positive'"), 2)} AS positive_pct,
  {_r(_share("sentiment = 'neutral'"), 2)} AS neutral_pct,
  {_r(_share("sentiment = 'negative'"), 2)} AS negative_pct,
  {_r(_mean('sentiment_score'), 2)} AS avg_sentiment_score,
  {_r(_mean('review_rating'), 2)} AS avg_review_rating"""
SUMMARY = SCORED + f""",
summary AS (SELECT place_name, {_SUMMARY} FROM scored WHERE place_name IS NOT NULL GROUP BY place_name)"""
HEALTH = SCORED + f""",
base AS (
  SELECT place_name, {_SUMMARY}, {_r(_mean('sentiment_label_num'), 2)} AS sentiment_label_avg
  FROM scored WHERE place_name IS NOT NULL GROUP BY place_name),
health AS (
  SELECT *, {_r('positive_pct * 0.6::DOUBLE + (100 - negative_pct) * 0.4::DOUBLE', 1)} AS sentiment_health_score
  FROM base),
ranking AS (
  SELECT place_name, row_number() OVER (ORDER BY sentiment_health_score DESC, place_name) AS rank,
         sentiment_health_score, positive_pct, negative_pct, avg_review_rating AS avg_rating, total_reviews
  FROM health)"""

PLACES = """
places AS (
  SELECT s_suppkey AS place_seq, 'src' || (s_suppkey % 25) AS title,
         CASE WHEN s_suppkey % 10 <> 0 THEN 2.9::DOUBLE + 0.01::DOUBLE * s_nationkey END AS latitude,
         101.6::DOUBLE + 0.01::DOUBLE * s_nationkey AS longitude, s_suppkey::VARCHAR AS place_id,
         'category ' || (s_suppkey % 4) AS category, 'street ' || s_suppkey AS address,
         (1 + s_suppkey % 5)::DOUBLE AS review_rating, s_suppkey % 60 AS review_count
  FROM supplier),
located AS (
  SELECT * FROM places WHERE latitude IS NOT NULL AND longitude IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY title ORDER BY place_seq) = 1)"""

RAW_REVIEWS = """
turns AS (
  SELECT conv_id, turn // 4 AS part, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS dialect, turn, role, text,
         (1 + turn % 5)::DOUBLE AS rating
  FROM conversations),
raw_reviews AS (
  SELECT conv_id * 1000000 + part AS place_seq,
         (row_number() OVER (PARTITION BY conv_id, part ORDER BY dialect, turn) - 1)::INTEGER AS pos,
         'conv ' || conv_id AS place_name, conv_id::VARCHAR AS place_id, 4.0::DOUBLE AS place_rating,
         'talk' AS place_category, 'nowhere' AS place_address, text AS review_text, rating AS review_rating,
         CASE WHEN dialect = 1 THEN 'turn ' || turn ELSE '' END AS review_date, role AS reviewer_name,
         0::BIGINT AS reviewer_photos, 0::BIGINT AS review_likes
  FROM turns),
extracted AS (SELECT * FROM raw_reviews WHERE regexp_matches(review_text, '\\S'))"""

_PREFIX = r"lower(regexp_replace(substr(review_text, 1, 100), '^\s+|\s+$', '', 'g'))"
_REVIEW_COLUMNS = ("place_name, place_id, place_rating, place_category, place_address, review_text, review_rating, "
                   "review_date, reviewer_name, reviewer_photos, review_likes")
COPIED = REVIEWS + ", copied AS (SELECT * REPLACE (area AS place_id) FROM reviews)"
LOG = """
log AS (
  SELECT 'clinic in area ' || o_custkey AS query,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'pending' END AS status,
         (o_orderkey % 4)::INTEGER AS attempts, o_orderkey AS position FROM orders),
listed AS (SELECT 'clinic in area ' || c_custkey AS query FROM customer)"""
BOXES = """
boxes AS (
  SELECT s_suppkey, 2.9::DOUBLE + 0.01::DOUBLE * s_nationkey AS min_lat,
         101.6::DOUBLE + 0.01::DOUBLE * s_nationkey AS min_lon FROM supplier)"""


def _add(name: str, ctes: str, body: str) -> None:
    ORACLE[name] = (f"WITH {ctes.strip()}\n" if ctes else "") + body.strip()


# ---- sources -----------------------------------------------------------------------------------

_add("scan_raw_places", RAW_REVIEWS, """
SELECT place_name, place_id, pos, review_text, review_rating, review_date, reviewer_name FROM extracted
UNION ALL
SELECT place_name, place_id, pos, review_text, review_rating, review_date, reviewer_name FROM extracted
WHERE place_seq % 3 = 0""")
_add("flatten_struct", "", """
SELECT event_id, json_extract(props, '$.k')::BIGINT AS "props.k" FROM events""")
_add("scan_reviews", REVIEWS, f"SELECT {_REVIEW_COLUMNS} FROM reviews")
_add("merged_sink", COPIED, """
SELECT copy, place_name, count(*) AS reviews, sum(length(reviewer_name))::BIGINT AS characters, sum(review_rating) AS ratings
FROM (SELECT * FROM copied WHERE regexp_matches(review_text, '\\S')
      QUALIFY row_number() OVER (PARTITION BY place_id, review_text ORDER BY batch, review_id) = 1),
     (VALUES ('parquet'), ('csv')) AS copies(copy)
GROUP BY copy, place_name""")
_add("scan_batches", REVIEWS, "SELECT review_id, place_name, review_rating, batch FROM reviews")
_add("scan_listed_batches", REVIEWS, """
SELECT review_id, place_name, CASE WHEN batch NOT BETWEEN 3 AND 5 THEN review_rating END AS review_rating,
       CASE WHEN batch < 3 THEN 0 WHEN batch < 6 THEN 1 ELSE 2 END::INTEGER AS batch
FROM reviews""")
_add("latest_run", REVIEWS, "SELECT review_id, place_name, 'second' AS run_id FROM reviews")
_add("scan_queries", "", """
SELECT url AS query FROM pages WHERE page_id % 5 <> 0 AND page_id % 7 <> 0""")
_add("place_coordinates", PLACES, """
SELECT title, latitude, longitude, place_id, category, address, review_rating,
       CASE WHEN place_seq % 2 = 1 THEN review_count END AS review_count
FROM places WHERE latitude IS NOT NULL AND longitude IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY title ORDER BY place_seq % 2, place_seq) = 1""")
_add("export_all_reviews", COPIED, f"""
SELECT {_REVIEW_COLUMNS} FROM (
  SELECT *, row_number() OVER (PARTITION BY place_id, review_text ORDER BY batch, review_id) AS n FROM copied)
WHERE n = 1 AND regexp_matches(review_text, '\\S')""")
_add("export_places_summary", REVIEWS, f"""
SELECT place_name, count(review_text) AS total_reviews, {_r(_mean('review_rating'), 2)} AS avg_rating,
       arg_min(place_category, review_id) FILTER (WHERE place_category IS NOT NULL) AS category,
       arg_min(place_address, review_id) FILTER (WHERE place_address IS NOT NULL) AS address
FROM reviews WHERE place_name IS NOT NULL GROUP BY place_name""")
_add("export_sentiment_by_place", SUMMARY, "SELECT * FROM summary")
_add("export_recommendations", RECOMMENDED, """
SELECT severity, category, title, unnest(actions) AS action, negative_review_count FROM recommended""")
_add("export_ranking", HEALTH, "SELECT * FROM ranking")
_add("roadmap_filtered", RECOMMENDED, "SELECT * FROM roadmap WHERE severity IN ('critical', 'high')")
_KPIS = f"""count(*) AS total_reviews, count(DISTINCT place_name) AS total_places,
       {_r(_mean('review_rating'), 2)} AS avg_rating"""
_LABELLED = {s: _pct(f"count(*) FILTER (WHERE sentiment = '{s}')", "count(sentiment)") for s in lexicons.SENTIMENTS}
_add("exec_kpis", SCORED, f"""
SELECT {_KPIS}, {_r(_LABELLED['positive'], 1)} AS positive_pct, {_r(_LABELLED['negative'], 1)} AS negative_pct
FROM scored""")
_add("exec_top_places", SUMMARY, f"""
SELECT row_number() OVER (ORDER BY positive_pct DESC, place_name)::INTEGER AS rank, place_name,
       {_r('positive_pct', 1)} AS positive_pct, {_r('negative_pct', 1)} AS negative_pct, avg_review_rating,
       total_reviews
FROM (SELECT * FROM summary ORDER BY positive_pct DESC, place_name LIMIT 10)""")
_TITLE = ("array_to_string(list_transform(string_split({0}, '_'), "
          "lambda w: upper(w[1]) || lower(w[2:])), ' ')")
_add("exec_top_complaints", COMPLAINTS, f"""
SELECT {_TITLE.format('aspect')} AS aspect, complaint_count, pct_of_all_reviews, avg_rating
FROM complaints ORDER BY complaint_count DESC, complaints.aspect LIMIT 10""")
_add("exec_recommendations", RECOMMENDED, f"""
SELECT row_number() OVER (ORDER BY negative_review_count DESC, category)::INTEGER AS priority,
       {_TITLE.format('category')} AS aspect, array_to_string(actions, '; ') AS action, severity
FROM (SELECT * FROM recommended ORDER BY negative_review_count DESC, category LIMIT 10)""")

# ---- projections and filters -------------------------------------------------------------------

_add("extract_reviews", RAW_REVIEWS, f"""
SELECT {_REVIEW_COLUMNS} FROM extracted
QUALIFY row_number() OVER (PARTITION BY place_id, {_PREFIX} ORDER BY place_seq, pos) = 1""")
_add("coalesce_text", "", """
SELECT doc_id, CASE WHEN doc_id % 3 = 2 OR text = '' OR text IS NULL THEN source ELSE text END AS review_text
FROM documents""")
_add("nonblank", "", r"""
SELECT doc_id, text FROM documents WHERE doc_id % 4 <> 0 AND regexp_matches(text, '\S')""")
_add("global_filter", SCORED, """
SELECT review_id, place_name, place_category, review_rating, sentiment FROM scored
WHERE review_rating >= 2 AND review_rating <= 4 AND sentiment <> 'neutral'
  AND place_name IN ('src1', 'src2', 'src3') AND place_category IN ('en', 'de')""")
_add("select_places", REVIEWS, """
SELECT review_id, place_name FROM reviews
WHERE place_name IN (SELECT DISTINCT place_name FROM reviews ORDER BY place_name LIMIT 6)""")
_add("filter_options", SCORED, """
SELECT DISTINCT 'sentiment' AS kind, sentiment AS value FROM scored WHERE sentiment IS NOT NULL
UNION ALL SELECT DISTINCT 'category', place_category FROM scored WHERE place_category IS NOT NULL
UNION ALL SELECT DISTINCT 'place', place_name FROM scored WHERE place_name IS NOT NULL""")

# ---- text --------------------------------------------------------------------------------------

_add("clean_text", CLEAN, "SELECT review_id, clean_text FROM cleaned")
_add("tokens", PREPARED, "SELECT review_id, array_to_string(tokens, ' ') AS tokens, token_count FROM prepared")


def _replaced(column: str, rules) -> str:
    """Nested replacements of all matches, groups written for DuckDB."""
    for pattern, replacement in rules:
        pattern, replacement = pattern.replace("'", "''"), replacement.replace("'", "''").replace("$", "\\")
        column = f"regexp_replace({column}, '{pattern}', '{replacement}', 'g')"
    return column


CONTRACTED = CLEAN.replace("text AS review_text", f"{_replaced('text', a.CONTRACTIONS)} AS review_text")
_HALVES = " ".join("WHEN '{}' THEN ['{}', '{}']".format(*(w.replace("'", "''") for w in (k, *v))) for k, v in text.TREEBANK_SPLITS.items())
_add("treebank_tokens", CONTRACTED + f""",
split AS (
  SELECT review_id, flatten(list_transform(
    list_filter(string_split({_replaced('lower(clean_text)', text.TREEBANK_RULES)}, ' '), lambda w: w <> ''),
    lambda w: CASE w {_HALVES} ELSE [w] END)) AS ws FROM cleaned),
kept AS (
  SELECT review_id, list_filter(ws, lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w) AND NOT regexp_full_match(w, '\\p{{Nd}}+')) AS tokens
  FROM split)""", """
SELECT review_id, array_to_string(tokens, ' ') AS tokens, len(tokens)::INTEGER AS token_count FROM kept""")
_add("preprocess", PREPARED, """
SELECT review_id, clean_text, array_to_string(tokens, '|') AS tokens, token_count, word_count,
       review_length_bucket FROM prepared""")
_add("length_bucket", PREPARED, f"""
SELECT review_length_bucket,
       list_position({_list(n for _, n in lexicons.LENGTH_BUCKETS)}, review_length_bucket)::INTEGER AS bucket_order,
       count(*) AS reviews
FROM prepared GROUP BY ALL""")
_add("ngrams", WORDS, """
SELECT review_id,
       array_to_string(list_transform(range(1, greatest(len(words), 1)), lambda i: words[i] || ' ' || words[i + 1]), '|')
         AS bigrams,
       greatest(len(words) - 2, 0)::INTEGER AS n_trigrams
FROM worded""")
_LABEL_COLUMNS = "review_id, sentiment, sentiment_score, sentiment_label_num"
_add("sentiment_label", SCORED, f"SELECT {_LABEL_COLUMNS} FROM scored")
_add("alert_level", SCORED, f"""
SELECT {_r('p', 1)} AS positive_pct, {_r('n', 1)} AS negative_pct,
       CASE WHEN n > 25 THEN 'critical' WHEN n > 15 THEN 'high' WHEN n > 8 THEN 'medium' ELSE 'low' END AS alert_level,
       p > 60 AS above_benchmark
FROM (SELECT {_LABELLED['positive']} AS p, {_LABELLED['negative']} AS n FROM scored)""")
_add("health_label", SCORED, f"""
SELECT {_r('p', 1)} AS positive_pct, {_r('n', 1)} AS negative_pct, {_r('p - n', 1)} AS health,
       CASE WHEN p - n > 30 THEN 'healthy' WHEN p - n > 10 THEN 'moderate' ELSE 'poor' END AS health_label
FROM (SELECT {_share("sentiment = 'positive'")} AS p, {_share("sentiment = 'negative'")} AS n FROM scored)""")
_add("aspect_tags", ANALYSED, """
SELECT review_id, array_to_string(aspects, ',') AS aspects, len(aspects)::INTEGER AS aspects_mentioned
FROM analysed""")

# The rule-based scorer as windows over exploded words.
_PUNCT = r"[!-/:-@\[-`{-~]"
_LAGS = ", ".join(
    f"lag({col}, {k}) OVER w AS {col}{k}" for k in (1, 2, 3) for col in ("known", "boost", "negates", "loud")
)


def _step(k: int, fade: float) -> str:
    """CTE: the valence after looking at the word ``k`` positions before."""
    v = f"v{k - 1}"
    push = f"(boost{k} + CASE WHEN loud{k} THEN 0.733::DOUBLE ELSE 0.0::DOUBLE END)"
    return f""",
step{k} AS (
  SELECT *, ({v} + CASE WHEN known{k} IS NOT NULL AND NOT known{k} AND boost{k} IS NOT NULL
                    THEN sign({v}) * {push} * {fade}::DOUBLE ELSE 0.0::DOUBLE END)
         * CASE WHEN NOT known{k} AND negates{k} THEN -0.74::DOUBLE ELSE 1.0::DOUBLE END AS v{k}
  FROM {'hits' if k == 1 else f'step{k - 1}'})"""


_ALL_VALENCES, _ALL_BOOSTERS = a.VALENCES | a.PHRASES, a.BOOSTERS | a.PHRASE_BOOSTERS
_ANY_PHRASE = "(?i)" + "|".join(
    " " + p.replace(" ", "  ") + " " for p in sorted([*a.PHRASES, *a.PHRASE_BOOSTERS], key=lambda p: -len(p.split())))
_add("lexicon_sentiment", CLEAN + rf""",
single AS (
  SELECT review_id, clean_text, list_transform(
    list_filter(string_split(clean_text, ' '), lambda w: length(w) > 1),
    lambda w: CASE WHEN length(regexp_replace(w, '^{_PUNCT}+|{_PUNCT}+$', '', 'g')) > 1
              THEN regexp_replace(w, '^{_PUNCT}+|{_PUNCT}+$', '', 'g') ELSE w END) AS ws
  FROM cleaned),
spaced AS (
  SELECT *, string_split_regex(' ' || array_to_string(ws, '  ') || ' ', '{_ANY_PHRASE}') AS pieces,
         regexp_extract_all(' ' || array_to_string(ws, '  ') || ' ', '{_ANY_PHRASE}') AS phrases FROM single),
split AS (
  SELECT review_id, clean_text, flatten(list_transform(range(1, len(pieces) + 1), lambda i: list_concat(
           list_filter(string_split_regex(pieces[i], ' +'), lambda w: w <> ''),
           CASE WHEN i <= len(phrases) THEN [trim(replace(phrases[i], '  ', ' '))] ELSE [] END))) AS ws
  FROM spaced),
exploded AS (SELECT review_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM split),
typed AS (
  SELECT review_id, i, lower(word) AS t, word = upper(word) AND regexp_matches(word, '\p{{Lu}}') AS capital FROM exploded),
mixed AS (
  SELECT review_id, bool_or(NOT capital) AS mixed, min(i) FILTER (WHERE t = 'but') AS but FROM typed GROUP BY review_id),
attributed AS (
  SELECT review_id, i, t, {_values_case('t', _ALL_VALENCES)} AS valence, {_values_case('t', _ALL_VALENCES)} IS NOT NULL AS known,
         {_values_case('t', _ALL_BOOSTERS)} AS boost, list_contains({_list(a.NEGATORS)}, t) AS negates,
         capital AND mixed AS loud, but
  FROM typed JOIN mixed USING (review_id)),
lagged AS (SELECT *, {_LAGS} FROM attributed WINDOW w AS (PARTITION BY review_id ORDER BY i)),
hits AS (
  SELECT *, valence + CASE WHEN loud THEN sign(valence) * 0.733::DOUBLE ELSE 0.0::DOUBLE END AS v0
  FROM lagged WHERE valence IS NOT NULL AND boost IS NULL)""" + _step(1, 1.0) + _step(2, 0.95) + _step(3, 0.9) + """,
totals AS (
  SELECT review_id, sum(v3 * CASE WHEN but IS NULL THEN 1.0::DOUBLE WHEN i < but THEN 0.5::DOUBLE
                             WHEN i > but THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END ORDER BY i) AS total
  FROM step3 GROUP BY review_id),
marked AS (
  SELECT cleaned.*, coalesce(total, 0.0::DOUBLE) AS total,
         least(length(regexp_replace(clean_text, '[^!]', '', 'g')), 4) * 0.292::DOUBLE AS loudness,
         length(regexp_replace(clean_text, '[^?]', '', 'g')) AS questions
  FROM cleaned LEFT JOIN totals USING (review_id)),
summed AS (
  SELECT *, total + sign(total) * (loudness + CASE WHEN questions <= 1 THEN 0.0::DOUBLE
                                   WHEN questions <= 3 THEN questions * 0.18::DOUBLE ELSE 0.96::DOUBLE END) AS valence
  FROM marked)""" + _labels("summed", "valence"), f"SELECT {_LABEL_COLUMNS} FROM scored")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_add("model_sentiment", CLEAN + f""",
marked AS (
  SELECT doc_id AS review_id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS label
  FROM labels WHERE doc_id % 5 <> 0 AND toxic IS NOT NULL),
names AS (SELECT unnest(['negative', 'neutral', 'positive']) AS label),
texts AS (
  SELECT names.label, count(marked.review_id) + 1 AS n
  FROM names LEFT JOIN (marked JOIN cleaned USING (review_id)) marked USING (label) GROUP BY ALL),
priors AS (SELECT label, round_even(ln(n / sum(n) OVER ()) * 1000000, 0)::BIGINT AS w FROM texts),
spoken AS (
  SELECT review_id, ('0x' || substr(md5(word), 1, 4))::INTEGER AS bucket
  FROM (SELECT review_id, unnest(string_split(translate(clean_text, '{_UPPER}', '{_LOWER}'), ' ')) AS word FROM cleaned)
  WHERE word <> ''),
tf AS MATERIALIZED (SELECT review_id, bucket, count(*) AS n FROM spoken GROUP BY ALL),
learned AS (SELECT label, bucket, sum(n) AS n FROM tf JOIN marked USING (review_id) GROUP BY ALL),
amounts AS (SELECT label, coalesce(sum(n), 0) + 65536 AS total FROM names LEFT JOIN learned USING (label) GROUP BY ALL),
weights AS MATERIALIZED (
  SELECT bucket, label, round_even(ln((coalesce(n, 0) + 1)::DOUBLE / total::DOUBLE) * 1000000, 0)::BIGINT AS w
  FROM (SELECT DISTINCT bucket FROM tf) CROSS JOIN amounts LEFT JOIN learned USING (label, bucket)),
sums AS (
  SELECT review_id, label, sum(tf.n * w)::BIGINT AS w, sum(tf.n)::BIGINT AS n FROM tf JOIN weights USING (bucket) GROUP BY ALL),
evidence AS (
  SELECT review_id, label, (priors.w + coalesce(sums.w, 0) * (least(coalesce(n, 0), 50)::DOUBLE / greatest(coalesce(n, 0), 1)::DOUBLE))
                           / 1000000.0::DOUBLE AS e
  FROM cleaned CROSS JOIN priors LEFT JOIN sums USING (review_id, label)),
judged AS (
  SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY e DESC, label) AS place,
         1.0::DOUBLE / sum(exp(e - m)) OVER (PARTITION BY review_id) AS p
  FROM (SELECT *, max(e) OVER (PARTITION BY review_id) AS m FROM evidence))""", f"""
SELECT review_id, label AS sentiment, {_r('p', 4)} AS sentiment_score,
       CASE label WHEN 'positive' THEN 1 WHEN 'neutral' THEN 0 ELSE -1 END::INTEGER AS sentiment_label_num
FROM judged WHERE place = 1""")

# ---- aggregates --------------------------------------------------------------------------------

_add("review_stats", PREPARED, f"SELECT {_KPIS}, {_r(_mean('word_count'), 1)} AS avg_word_count FROM prepared")
_add("rating_distribution", PREPARED, """
SELECT review_rating, count(*) AS reviews FROM prepared WHERE review_rating IS NOT NULL GROUP BY review_rating""")
_add("places_ranked", PREPARED, f"""
SELECT place_name, count(review_text) AS reviews, {_r(_mean('review_rating'), 6)} AS avg_rating
FROM prepared WHERE place_name IS NOT NULL GROUP BY place_name""")
_add("sentiment_summary", SUMMARY, "SELECT * FROM summary")
LABELLED = REVIEWS + """,
labelled AS (
  SELECT reviews.*, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive'
                         WHEN toxic IS NOT NULL THEN 'neutral' END AS sentiment,
         CASE WHEN toxic = 1 OR quality = 1 THEN 0.5::DOUBLE WHEN toxic IS NOT NULL THEN 0.0::DOUBLE END AS sentiment_score
  FROM reviews LEFT JOIN labels ON review_id = doc_id)"""
_add("labelled_summary", LABELLED, f"""
SELECT place_name, {_SUMMARY} FROM labelled WHERE place_name IS NOT NULL GROUP BY place_name""")
_SHARE = """
SELECT sentiment, count(*) AS reviews, {} AS pct FROM {} WHERE sentiment IS NOT NULL GROUP BY sentiment"""
_SHARE_PCT = _r(_pct("count(*)", "sum(count(*)) OVER ()"), 4)
_add("labelled_share", LABELLED, _SHARE.format(_SHARE_PCT, "labelled"))
_add("sentiment_share", SCORED, _SHARE.format(_SHARE_PCT, "scored"))
_add("compare_sentiment", HEALTH, "SELECT * FROM health")
_CROSS = ", ".join(f"{_r(_share(f'sentiment = {chr(39)}{s}{chr(39)}'), 4)} AS {s}" for s in lexicons.SENTIMENTS)
_add("rating_sentiment", SCORED, f"""
SELECT review_rating, {_CROSS} FROM scored WHERE review_rating IS NOT NULL AND sentiment IS NOT NULL
GROUP BY review_rating""")
_add("place_sentiment_top20", SCORED, f"""
SELECT place_name, {_CROSS} FROM scored WHERE place_name IS NOT NULL AND sentiment IS NOT NULL
GROUP BY place_name ORDER BY positive DESC, place_name LIMIT 20""")
_add("rating_by_place", PREPARED, f"""
SELECT place_name, {_r(_mean('review_rating'), 2)} AS mean, count(review_rating) AS count
FROM prepared WHERE place_name IS NOT NULL GROUP BY place_name""")
_add("net_health", SCORED, f"""
SELECT place_name, {_r(_share("sentiment = 'positive'") + ' - ' + _share("sentiment = 'negative'"), 1)} AS health_score
FROM scored WHERE place_name IS NOT NULL GROUP BY place_name""")
_add("dataset_stats", REVIEWS, f"""
SELECT count(*) AS reviews, count(DISTINCT place_name) AS places, {_r(_mean('review_rating'), 2)} AS avg_rating
FROM reviews""")
_add("top_places", REVIEWS, """
SELECT place_name, count(*) AS reviews FROM reviews WHERE place_name IS NOT NULL
GROUP BY place_name ORDER BY reviews DESC, place_name LIMIT 10""")
_add("top_places_volume", PREPARED, f"""
SELECT place_name, count(review_text) AS reviews, {_r(_mean('review_rating'), 2)} AS rating
FROM prepared WHERE place_name IS NOT NULL GROUP BY place_name ORDER BY reviews DESC, place_name LIMIT 15""")
_add("batch_stats", REVIEWS, """
SELECT batch, count(DISTINCT place_name) AS places, count(*) AS reviews FROM reviews GROUP BY batch""")
_add("query_progress", LOG, "SELECT status, count(DISTINCT query) AS queries FROM log GROUP BY status")
_ASPECT_SUMMARY = f"""
SELECT aspect, mentions AS total_mentions, {_zero(_r(_pct('mentions', 'reviews'), 1))} AS mention_rate,
       {_zero(_r(_pct('positive', 'labelled'), 1))} AS positive_pct,
       {_zero(_r(_pct('negative', 'labelled'), 1))} AS negative_pct,
       {_zero(_r(_pct('labelled - positive - negative', 'labelled'), 1))} AS neutral_pct,
       {_zero(_r('score_mean', 3))} AS avg_sentiment_score, {_r('rating_mean', 2)} AS avg_rating
FROM grid"""
_add("aspect_summary", GRID, _ASPECT_SUMMARY)
_add("export_aspect_summary", GRID, f"""
SELECT aspect, total_mentions, mention_rate AS mention_rate_pct, positive_pct, negative_pct,
       avg_sentiment_score AS avg_sentiment
FROM ({_ASPECT_SUMMARY}) WHERE total_mentions > 0""")
_add("place_aspect", PLACE_GRID, f"""
SELECT place_name, aspect, mentions, {_r(_pct('mentions', 'reviews'), 1)} AS mention_rate,
       {_zero(_r(_pct('positive', 'mentions'), 1))} AS positive_pct,
       {_zero(_r(_pct('negative', 'mentions'), 1))} AS negative_pct, {_zero(_r('score_mean', 3))} AS avg_sentiment
FROM grid""")
_POS, _NEG = _zero(_pct("positive", "mentions")), _zero(_pct("negative", "mentions"))
NET = PLACE_GRID + f""",
net AS (
  SELECT place_name, aspect, mentions, {_r(_pct('mentions', 'reviews'), 1)} AS mention_rate_pct,
         {_r(_POS, 1)} AS positive_pct, {_r(_NEG, 1)} AS negative_pct, {_r(f'{_POS} - {_NEG}', 1)} AS net_sentiment
  FROM grid)"""
_add("compare_aspects", NET, "SELECT * FROM net")
_add("aspect_coverage", PLACE_GRID, f"""
SELECT place_name, {_TITLE.format('aspect')} AS aspect, {_r(_pct('mentions', 'reviews'), 4)} AS coverage_pct FROM grid""")
_MATRIX = ", ".join(
    f"{_zero(f'max(net_sentiment) FILTER (WHERE place_name = {chr(39)}src{n}{chr(39)})')} AS src{n}" for n in range(6)
)
_add("aspect_matrix", NET, f"SELECT {_TITLE.format('aspect')} AS aspect, {_MATRIX} FROM net GROUP BY net.aspect")
_add("aspect_samples", ANALYSED, """
SELECT aspect, sentiment, sample_rank, review_id, clean_text AS sample_text FROM (
  SELECT aspect, sentiment, review_id, clean_text,
         row_number() OVER (PARTITION BY aspect, sentiment ORDER BY review_id)::INTEGER AS sample_rank
  FROM (SELECT *, unnest(aspects) AS aspect FROM analysed WHERE sentiment IN ('positive', 'negative')))
WHERE sample_rank <= 3""")
_add("map_places", PLACES + "," + SCORED, f"""
SELECT title AS place_name, {_r('latitude', 4)} AS latitude, {_r('longitude', 4)} AS longitude, category, address,
       located.review_rating, review_count AS claimed_review_count, collected_review_count,
       {_r('avg_rating', 4)} AS avg_rating, {_r('positive_pct', 4)} AS positive_pct
FROM located LEFT JOIN (
  SELECT place_name, {_mean('review_rating')} AS avg_rating, {_share("sentiment = 'positive'")} AS positive_pct,
         count(review_text) AS collected_review_count
  FROM scored GROUP BY place_name) s ON s.place_name = title""")
_add("map_centre", PLACES, f"""
SELECT {_r('median(latitude)', 6)} AS latitude, {_r('median(longitude)', 6)} AS longitude FROM places""")

# ---- insights and comparison -------------------------------------------------------------------

_add("complaint_totals", SCORED, f"""
SELECT * FROM (
  SELECT count(*) FILTER (WHERE sentiment = 'negative') AS total_negative_reviews,
         {_r(_share("sentiment = 'negative'"), 1)} AS negative_pct,
         {_r(_mean("CASE WHEN sentiment = 'negative' THEN review_rating END"), 2)} AS avg_negative_rating
  FROM scored) WHERE total_negative_reviews >= 3""")
_add("complaint_aspects", COMPLAINTS, "SELECT * FROM complaints")
_add("complaint_keywords", ANALYSED, """
SELECT * FROM (
  SELECT aspect, token, count(*) AS occurrences,
         row_number() OVER (PARTITION BY aspect ORDER BY count(*) DESC, token)::INTEGER AS rank
  FROM (SELECT aspect, unnest(tokens) AS token FROM (
    SELECT tokens, unnest(aspects) AS aspect FROM analysed WHERE sentiment = 'negative'))
  GROUP BY aspect, token)
WHERE rank <= 15 AND (SELECT count(*) FROM analysed WHERE sentiment = 'negative') >= 3""")
_add("strengths", ANALYSED + _STRENGTHS, "SELECT * FROM strengths")
_add("insight_overview", SCORED, f"""
SELECT *, {_r('positive_pct / greatest(negative_pct, 0.1::DOUBLE)', 1)} AS sentiment_ratio FROM (
  SELECT count(*) AS total_reviews, {_r(_mean('review_rating'), 2)} AS avg_rating,
         count(*) FILTER (WHERE sentiment = 'positive') AS positive_reviews,
         count(*) FILTER (WHERE sentiment = 'neutral') AS neutral_reviews,
         count(*) FILTER (WHERE sentiment = 'negative') AS negative_reviews,
         {_r(_share("sentiment = 'positive'"), 1)} AS positive_pct,
         {_r(_share("sentiment = 'negative'"), 1)} AS negative_pct
  FROM scored)""")
_add("recommendations", RECOMMENDED, "SELECT * REPLACE (array_to_string(actions, '|') AS actions) FROM recommended")
_add("improvement_roadmap", RECOMMENDED, "SELECT * FROM roadmap")
_add("comparison_ranking", HEALTH, "SELECT * FROM ranking")
_add("aspect_best_worst", NET, """
SELECT aspect, first(place_name ORDER BY net_sentiment DESC, place_name) AS best_place, max(net_sentiment) AS best_score,
       first(place_name ORDER BY net_sentiment, place_name) AS worst_place, min(net_sentiment) AS worst_score
FROM net GROUP BY aspect""")
_add("competitive_advantages", NET, f"""
SELECT place_name, array_to_string(list(aspect ORDER BY list_position({_list(a.ASPECTS)}, aspect)), ',') AS advantages
FROM (
  SELECT place_name, aspect, net_sentiment, mentions,
         row_number() OVER (PARTITION BY aspect ORDER BY net_sentiment DESC, place_name) AS n,
         coalesce(stddev_samp(net_sentiment) OVER (PARTITION BY aspect), 1.0::DOUBLE) AS spread
  FROM net)
WHERE n = 1 AND spread <> 0 AND net_sentiment > 10 AND mentions >= 3 GROUP BY place_name""")
_add("leaderboard", SUMMARY, """
SELECT rank, place_name, positive_pct, avg_review_rating,
       CASE rank WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' WHEN 3 THEN 'bronze' END AS medal
FROM (SELECT *, row_number() OVER (ORDER BY positive_pct DESC, place_name)::INTEGER AS rank FROM summary)
WHERE rank <= 10""")
_ENDS = "place_name, positive_pct, negative_pct, avg_review_rating, total_reviews"
_add("top_bottom", SUMMARY, f"""
(SELECT 'top' AS position, {_ENDS} FROM summary ORDER BY positive_pct DESC, place_name LIMIT 1)
UNION ALL
(SELECT 'bottom', {_ENDS} FROM summary ORDER BY positive_pct, place_name DESC LIMIT 1)""")
_add("priority_insights", COMPLAINTS, f"""
SELECT {_TITLE.format('aspect')} AS aspect, complaint_count, pct_of_all_reviews, avg_rating,
       CASE WHEN pct_of_negative_reviews > 20 THEN 'critical' WHEN pct_of_negative_reviews > 10 THEN 'high'
            ELSE 'medium' END AS severity
FROM complaints ORDER BY complaint_count DESC, complaints.aspect LIMIT 3""")
_add("complaint_cards", COMPLAINTS, f"""
SELECT {_TITLE.format('aspect')} AS aspect, complaint_count, pct_of_all_reviews, avg_rating, {_SEVERITY} AS severity
FROM complaints ORDER BY complaint_count DESC, complaints.aspect LIMIT 6""")
_add("strength_cards", ANALYSED + _STRENGTHS, f"""
SELECT {_TITLE.format('aspect')} AS aspect, strength_score, positive_review_count
FROM strengths ORDER BY strength_score DESC, strengths.aspect LIMIT 6""")
_add("top_reviews", SCORED, """
SELECT sentiment, rank, review_id, place_name, sentiment_score, substr(clean_text, 1, 500) AS excerpt FROM (
  SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY sentiment_score DESC, review_id)::INTEGER AS rank
  FROM scored WHERE sentiment IN ('positive', 'negative'))
WHERE rank <= 5""")

# ---- keywords ----------------------------------------------------------------------------------

_add("word_freq", PREPARED, """
SELECT word, count(*) AS occurrences FROM (SELECT unnest(tokens) AS word FROM prepared)
GROUP BY word ORDER BY occurrences DESC, word LIMIT 50""")
_add("phrase_freq", WORDS, """
SELECT phrase, count(*) AS occurrences FROM (
  SELECT review_id, unnest(list_transform(range(1, greatest(len(words) - 1, 1)),
                           lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) AS phrase
  FROM worded)
GROUP BY phrase
HAVING count(DISTINCT review_id) >= 2 AND count(DISTINCT review_id) <= (SELECT count(*) FROM worded) * 0.8::DOUBLE
ORDER BY occurrences DESC, phrase LIMIT 25""")

_add("topic_vocabulary", WORDS + """,
terms AS (
  SELECT review_id, unnest(list_concat(words, list_transform(
           range(1, greatest(len(words), 1)), lambda i: words[i] || ' ' || words[i + 1]))) AS term FROM worded)""", """
SELECT term, count(DISTINCT review_id) AS df, count(*) AS total, (row_number() OVER (ORDER BY count(*) DESC, term))::INTEGER AS rank
FROM terms GROUP BY term
HAVING count(DISTINCT review_id) BETWEEN 3 AND (SELECT count(*) FROM worded) * 0.8::DOUBLE AND (SELECT count(*) FROM worded) >= 10
ORDER BY total DESC, term LIMIT 3000""")
_add("topic_invariants", CLEAN, """
SELECT count(*) AS reviews, count(*) AS distinct_reviews, count(*) AS adding_up, count(*) AS dominant, 5::BIGINT AS topics,
       50::BIGINT AS topic_words, count(*) AS counted
FROM cleaned""")


def _tfidf(group: str, top_n: int) -> str:
    """CTEs up to ``keywords(grp, keyword, score, rank)``, fitted per value of ``group``."""
    return WORDS + f""",
terms AS (
  SELECT {group} AS grp, review_id, unnest(list_concat(words, list_transform(
           range(1, greatest(len(words), 1)), lambda i: words[i] || ' ' || words[i + 1]))) AS term
  FROM worded),
tf AS (SELECT grp, review_id, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT {group} AS grp, count(*) AS n FROM worded GROUP BY ALL),
stats AS (
  SELECT grp, term, n, count(*) AS df, sum(tf) AS total FROM tf JOIN sizes USING (grp) GROUP BY ALL
  HAVING count(*) >= 2 AND count(*) <= n * 0.85::DOUBLE),
vocabulary AS (
  SELECT grp, term, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0::DOUBLE AS idf FROM stats
  QUALIFY row_number() OVER (PARTITION BY grp ORDER BY total DESC, term) <= 2000),
weights AS (SELECT grp, review_id, term, tf * idf AS w FROM tf JOIN vocabulary USING (grp, term)),
normed AS (SELECT grp, term, w / sqrt(sum(w * w) OVER (PARTITION BY review_id)) AS x FROM weights),
totals AS (SELECT grp, term, {_r('sum(x)', 6)} AS score FROM normed GROUP BY ALL),
keywords AS (
  SELECT grp, term AS keyword, score,
         row_number() OVER (PARTITION BY grp ORDER BY score DESC, term)::INTEGER AS rank
  FROM totals QUALIFY rank <= {top_n})"""


_add("global_keywords", _tfidf("1", 30), "SELECT keyword, score, rank FROM keywords")
_add("place_keywords", _tfidf("place_name", 15), """
SELECT grp AS place_name, keyword, score, rank FROM keywords JOIN sizes USING (grp) WHERE n >= 3""")
_add("compare_keywords", _tfidf("place_name", 10), f"""
SELECT grp AS place_name, keyword, {_r('score', 3)} AS score FROM keywords JOIN sizes USING (grp) WHERE n >= 3""")
CORRELATION = SCORED + f""",
grams AS (
  SELECT sentiment, unnest(list_concat(words, list_transform(
           range(1, greatest(len(words), 1)), lambda i: words[i] || ' ' || words[i + 1]))) AS keyword
  FROM scored WHERE sentiment IN ('positive', 'negative')),
counted AS (SELECT sentiment, keyword, count(*) AS tf FROM grams GROUP BY ALL),
features AS (
  SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY tf DESC, keyword) AS n FROM counted QUALIFY n <= 2000),
weighted AS (
  SELECT *, tf::DOUBLE / sqrt((sum(tf * tf) OVER (PARTITION BY sentiment))::DOUBLE) AS score FROM features),
positives AS (SELECT keyword, score FROM weighted WHERE sentiment = 'positive' AND n <= 20),
negatives AS (SELECT keyword, score FROM weighted WHERE sentiment = 'negative' AND n <= 20),
correlation AS (
  SELECT coalesce(p.keyword, q.keyword) AS keyword, {_r('coalesce(p.score, 0)', 3)} AS positive_score,
         {_r('coalesce(q.score, 0)', 3)} AS negative_score,
         {_r('coalesce(p.score, 0) - coalesce(q.score, 0)', 3)} AS sentiment_bias
  FROM positives p FULL JOIN negatives q ON p.keyword = q.keyword)"""
_add("keyword_sentiment", CORRELATION, "SELECT * FROM correlation")
_add("negative_keywords", CORRELATION, "SELECT * FROM correlation ORDER BY sentiment_bias, keyword LIMIT 25")

# ---- phrases -----------------------------------------------------------------------------------

_DIMS, _TOP, _DIVERSITY = 64, 10, "0.3::DOUBLE"
VECTORS = WORDS + f""",
paired AS (
  SELECT unnest(list_zip(words, words[2:])) AS p FROM worded UNION ALL SELECT unnest(list_zip(words, words[3:])) FROM worded),
counted AS (SELECT p[1] AS l, p[2] AS r, count(*) AS n FROM paired WHERE p[1] IS NOT NULL AND p[2] IS NOT NULL GROUP BY ALL),
sided AS (SELECT l AS word, r AS other, n FROM counted UNION ALL SELECT r, l, n FROM counted),
hashed AS (
  SELECT word, n, ('0x' || substr(md5(other), 8 * k + 1, 8))::BIGINT AS h FROM sided, range(4) t(k)),
cells AS MATERIALIZED (
  SELECT word, (h // 2) % {_DIMS} AS dim, sum(n * (1 - 2 * (h % 2)))::DOUBLE AS v FROM hashed GROUP BY ALL),
near AS MATERIALIZED (SELECT word, sum(n)::DOUBLE AS n FROM sided GROUP BY word),
chance AS (SELECT dim, sum(v) AS t FROM cells GROUP BY dim),
beyond AS (
  SELECT word, d.dim, coalesce(c.v, 0.0::DOUBLE) - near.n * coalesce(t, 0.0::DOUBLE) / (SELECT sum(n) FROM near) AS x
  FROM near CROSS JOIN range({_DIMS}) d(dim) LEFT JOIN cells c USING (word, dim) LEFT JOIN chance ON chance.dim = d.dim),
topped AS (SELECT *, max(abs(x)) OVER (PARTITION BY word) AS top FROM beyond),
vectors AS MATERIALIZED (
  SELECT word, list(CASE WHEN top > 0 THEN floor(x * 127.0::DOUBLE / top + 0.5::DOUBLE) ELSE 0 END::INTEGER ORDER BY dim) AS vector
  FROM topped GROUP BY word)"""

_add("word_vectors", VECTORS, "SELECT word, array_to_string(vector, ',') AS vector FROM vectors")


def _greedy_choice() -> str:
    """One table for each choice: all phrases with their relevance, largest overlap with a chosen one, and whether they are chosen."""
    def cosine(other: str) -> str:
        scale = f"(size * {other}.size)"
        return f"CASE WHEN {scale} > 0 THEN list_dot_product(vec, {other}.vec) / {scale} ELSE 0.0::DOUBLE END"

    first = "row_number() OVER (PARTITION BY review_id ORDER BY {} phrase) = 1"
    steps = [f"""
related AS MATERIALIZED (
  SELECT p.*, {cosine('r').replace('vec,', 'p.vec,').replace('(size', '(p.size')} AS relevance
  FROM phrased p JOIN abouts r USING (review_id)),
step1 AS MATERIALIZED (
  SELECT *, NULL::DOUBLE AS overlap, {first.format('relevance DESC,')} AS newly, newly AS taken FROM related)"""]
    for k in range(2, _TOP + 1):
        steps.append(f"""
seen{k} AS (
  SELECT s.* EXCLUDE (overlap, newly),
         greatest(coalesce(s.overlap, -2.0::DOUBLE), {cosine('c').replace('vec,', 's.vec,').replace('(size', '(s.size')}) AS overlap
  FROM step{k - 1} s LEFT JOIN (SELECT * FROM step{k - 1} WHERE newly) c USING (review_id)),
gained{k} AS (SELECT *, (1 - {_DIVERSITY}) * relevance - {_DIVERSITY} * overlap AS gain FROM seen{k}),
step{k} AS MATERIALIZED (
  SELECT * EXCLUDE (taken, gain), NOT taken AND {first.format('taken, gain DESC,')} AS newly, taken OR newly AS taken
  FROM gained{k})""")
    return ",".join(steps)


_SIZE = "sqrt(list_dot_product(vec, vec))"
_add("mmr_keyphrases", VECTORS + f""",
grams AS (
  SELECT review_id, unnest(words) AS a, NULL AS b FROM worded
  UNION SELECT review_id, p[1], p[2] FROM (SELECT review_id, unnest(list_zip(words, words[2:])) AS p FROM worded)
  WHERE p[1] IS NOT NULL AND p[2] IS NOT NULL),
zeros AS (SELECT list(0::INTEGER) AS z FROM range({_DIMS})),
summed AS (
  SELECT review_id, concat_ws(' ', a, b) AS phrase,
         list_transform(list_zip(coalesce(v.vector, z), coalesce(w.vector, z)), lambda x: (x[1] + x[2])::DOUBLE) AS vec
  FROM grams LEFT JOIN vectors v ON a = v.word LEFT JOIN vectors w ON b = w.word CROSS JOIN zeros),
phrased AS (SELECT *, {_SIZE} AS size FROM summed),
spoken AS (
  SELECT review_id, i, sum(n * vector[i])::DOUBLE AS x
  FROM (SELECT review_id, word, count(*) AS n FROM (SELECT review_id, unnest(words) AS word FROM worded) GROUP BY ALL)
  JOIN vectors USING (word), range(1, {_DIMS} + 1) t(i) GROUP BY ALL),
told AS (SELECT review_id, list(x ORDER BY i) AS vec FROM spoken GROUP BY review_id),
abouts AS (
  SELECT review_id, coalesce(told.vec, list_transform(z, lambda x: x::DOUBLE)) AS vec, sqrt(list_dot_product(vec, vec)) AS size
  FROM worded LEFT JOIN told USING (review_id) CROSS JOIN zeros),{{greedy}}""".replace("{greedy}", _greedy_choice()), f"""
SELECT review_id, row_number() OVER (PARTITION BY review_id ORDER BY relevance DESC, phrase)::INTEGER AS rank, phrase,
       {_r('relevance', 4)} AS score FROM step{_TOP} WHERE taken""")

# ---- merging and deduplication -----------------------------------------------------------------

_add("union_batches", REVIEWS, """
SELECT review_id, place_name, review_rating, CASE WHEN batch % 2 = 1 THEN reviewer_name END AS reviewer_name, batch
FROM reviews""")
_add("dedupe_prefix", COPIED, f"""
SELECT review_id, place_id FROM copied
QUALIFY row_number() OVER (PARTITION BY place_id, {_PREFIX} ORDER BY batch, review_id) = 1""")
_MERGED = r"""
SELECT {} FROM (
  SELECT *, row_number() OVER (PARTITION BY place_id, review_text ORDER BY batch, review_id) AS n FROM copied)
WHERE n = 1 AND coalesce(regexp_matches(review_text, '\S'), true)"""
_add("merge_reviews", COPIED, _MERGED.format("review_id, place_id, review_text"))
_add("stream_merge", COPIED, _MERGED.format("review_id, place_id, review_text"))
_add("stream_extract", RAW_REVIEWS, """
SELECT place_id, pos, review_text, review_rating, review_date, reviewer_name FROM extracted""")
_add("stream_status", REVIEWS, """
SELECT batch, 'completed' AS status, count(DISTINCT place_name) AS places, count(*) AS reviews FROM reviews GROUP BY batch""")

# ---- query lists -------------------------------------------------------------------------------

_add("pending_queries", LOG, """
SELECT DISTINCT query, 'new' AS reason FROM listed
WHERE query NOT IN (SELECT query FROM log WHERE status IN ('completed', 'failed'))
UNION ALL
SELECT query, 'retry' FROM log WHERE status = 'failed' AND query NOT IN (SELECT query FROM log WHERE status = 'completed')
GROUP BY query HAVING max(attempts) < 3""")
ATTEMPTS = """
attempts AS (
  SELECT o_orderkey AS seq, 'clinic in area ' || o_custkey AS query,
         CASE WHEN o_orderkey % 997 = 0 THEN 'reset' WHEN o_orderstatus = 'F' THEN 'completed'
              WHEN o_orderkey % 3 = 0 THEN 'empty' ELSE 'error' END AS outcome,
         (o_orderkey % 50)::INTEGER AS last_batch, o_orderkey % 7 AS places, o_orderkey % 1000 AS reviews,
         'error ' || (o_orderkey % 5) AS error
  FROM orders),
since AS (
  SELECT * FROM attempts WHERE outcome <> 'reset' AND seq > coalesce((
    SELECT max(seq) FROM attempts WHERE outcome = 'reset' AND seq < (SELECT max(o_orderkey) / 8.0::DOUBLE FROM orders)), -1)),
done AS (SELECT query, max(seq) AS seq FROM since WHERE outcome = 'completed' GROUP BY query),
last_error AS (SELECT query, max(seq) AS seq FROM since WHERE outcome = 'error' GROUP BY query),
state AS (
  SELECT query, 'completed' AS status, NULL::INTEGER AS attempts, NULL::INTEGER AS failures, NULL AS error, last_batch, places, reviews
  FROM since JOIN done USING (query, seq)
  UNION ALL
  SELECT s.query, 'failed', count(*) FILTER (WHERE e.seq IS NULL OR s.seq >= e.seq)::INTEGER, count(*)::INTEGER,
         max(error) FILTER (WHERE s.seq = e.seq), NULL, NULL, NULL
  FROM since s LEFT JOIN last_error e ON s.query = e.query WHERE s.query NOT IN (SELECT query FROM done) GROUP BY s.query)"""
_add("attempt_state", ATTEMPTS, "SELECT * EXCLUDE (failures) FROM state")
_add("pending_attempts", LOG + "," + ATTEMPTS, """
SELECT DISTINCT query, 'new' AS reason FROM listed WHERE query NOT IN (SELECT query FROM state)
UNION ALL
SELECT query, 'retry' FROM state WHERE status = 'failed' AND failures < 3""")
_add("new_queries", LOG, """
SELECT DISTINCT query FROM (SELECT query FROM listed UNION ALL SELECT replace(query, 'clinic', 'bakery') FROM listed)
WHERE query NOT IN (SELECT query FROM log)""")
_add("distinct_queries", LOG, "SELECT query, min(position) AS first_position FROM log GROUP BY query")
_CROSSED = """
SELECT DISTINCT keyword || ' in ' || 'Area ' || c_custkey AS query
FROM customer CROSS JOIN (SELECT unnest({}) AS keyword)"""
_add("query_cross", "", _CROSSED.format(_list(lexicons.CLINIC_KEYWORDS)))
_add("query_expansion", "", _CROSSED.format(_list(w for ws in lexicons.NICHES.values() for w in ws)))
_add("query_max_coverage", BOXES, _CROSSED.format(_list(lexicons.CLINIC_KEYWORDS)) + """
UNION
SELECT printf('clinic @%.4f,%.4f,14z', min_lat, min_lon) FROM boxes""")
_add("grid_points", BOXES, f"""
SELECT s_suppkey, {_r('lat', 6)} AS lat, {_r('lon', 6)} AS lon, printf('clinic @%.5f,%.5f,14z', lat, lon) AS query
FROM (SELECT s_suppkey, min_lat + i * 0.02::DOUBLE AS lat, min_lon + j * 0.02::DOUBLE AS lon
      FROM boxes CROSS JOIN range(0, 3) r(i) CROSS JOIN range(0, 4) q(j))""")

# ---- growth and coverage -----------------------------------------------------------------------

_add("batch_yield", COPIED, """
SELECT batch, delivered, coalesce(fresh, 0) AS new_reviews,
       (sum(coalesce(fresh, 0)) OVER (ORDER BY batch))::BIGINT AS cumulative_reviews
FROM (SELECT batch, count(*) AS delivered FROM copied GROUP BY batch)
LEFT JOIN (
  SELECT batch, count(*) AS fresh FROM (SELECT min(batch) AS batch FROM copied GROUP BY place_id, review_text)
  GROUP BY batch) USING (batch)""")
_add("sentiment_trend", SCORED + f""",
monthly AS (
  SELECT place_name, date_trunc('month', review_ts)::DATE AS month, count(sentiment) AS reviews,
         {_r(_share("sentiment = 'positive'"), 2)} AS positive_pct,
         {_r(_share("sentiment = 'negative'"), 2)} AS negative_pct,
         {_r(_mean('sentiment_score'), 3)} AS avg_sentiment_score
  FROM scored WHERE place_name IS NOT NULL AND month(review_ts) % 5 <> 2 GROUP BY ALL),
calendar AS (
  SELECT place_name, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month
  FROM monthly GROUP BY place_name),
filled AS (
  SELECT place_name, month, coalesce(reviews, 0) AS reviews, positive_pct, negative_pct, avg_sentiment_score
  FROM calendar LEFT JOIN monthly USING (place_name, month))""", f"""
SELECT f.*, {_r('f.positive_pct - b.positive_pct', 2)} AS positive_change
FROM filled f LEFT JOIN filled b ON f.place_name = b.place_name AND b.month = f.month - INTERVAL 1 MONTH""")
_add("area_rollup", REVIEWS, """
SELECT area, grouping(area)::INTEGER AS is_total, count(*) AS reviews, count(DISTINCT place_name) AS places
FROM reviews GROUP BY ROLLUP (area)""")
CAPTURE = PLACES + "," + REVIEWS + f""",
captured AS (
  SELECT title AS place_name, review_count AS claimed, count(review_id) AS collected,
         {_pct('count(review_id)', 'review_count')} AS capture_pct
  FROM located LEFT JOIN reviews ON title = place_name GROUP BY title, review_count)"""
_add("capture_rate", CAPTURE, f"""
SELECT count(capture_pct) AS places, {_r(_mean('capture_pct'), 2)} AS avg_capture_pct FROM captured""")
_add("thin_places", CAPTURE, """
SELECT place_name, collected, CASE WHEN collected = 0 THEN 'none' ELSE 'few' END AS coverage
FROM captured WHERE collected < 10""")

# Tables of the cube equal those taken from the reviews themselves.
ORACLE.update({name: ORACLE[same] for name, (_, same) in a.CUBED.items()})

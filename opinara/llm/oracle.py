"""SQL for the registered queries that SQL can express, and constants it shares with nothing but fixed rules."""

from __future__ import annotations

from opinara.llm import licences, secrets


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def secret_scan() -> str:
    """Positions from the lengths of the pieces between matches and of the matches."""
    kinds = []
    for place, rule in enumerate(secrets.RULES):
        keep = f"regexp_full_match(m[i], {_sql_text(rule.keep.strip('^$'))})" if rule.keep else "true"
        kinds.append(f"""
    SELECT blob, {place} AS place, '{rule.kind}' AS kind, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
        'a': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0),
        'n': length(m[i]), 'k': {keep}}}), lambda s: s.k)) AS s
    FROM (SELECT blob, regexp_extract_all(t, {_sql_text(rule.pattern)}) AS m,
                 regexp_split_to_array(t, {_sql_text(rule.pattern)}) AS p FROM blobs)""")
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS blob FROM documents),
blobs AS (SELECT blob, any_value(t) AS t FROM docs GROUP BY blob),
spans AS ({" UNION ALL ".join(kinds)}),
named AS (SELECT blob, place, kind, s.a::BIGINT AS a, kind || ':' || s.a::BIGINT || ':' || (s.a + s.n)::BIGINT AS d FROM spans),
by_blob AS (
    SELECT blob, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
           count(*) FILTER (WHERE kind = 'hex') AS n_hex,
           string_agg(d, ',' ORDER BY a, place) FILTER (WHERE place < 3) AS base, string_agg(d, ',' ORDER BY a, place) AS spans
    FROM named GROUP BY blob)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN by_blob USING (blob)"""


def jaccard_links() -> str:
    """Sizes of all intersections from a join on shingles, one text of each kind."""
    return r"""
WITH split AS (
    SELECT text, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
sets AS MATERIALIZED (
    SELECT row_number() OVER () AS node, text, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
           ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g
    FROM split),
copies AS (SELECT node, count(*) AS n FROM documents JOIN sets USING (text) GROUP BY node),
grams AS MATERIALIZED (SELECT node, len(g) AS size, hash(unnest(g)) AS gram FROM sets),
shared AS (
    SELECT a.node AS a, b.node AS b, count(*) AS common, any_value(a.size + b.size) AS sizes
    FROM grams a JOIN grams b ON a.gram = b.gram AND a.node <> b.node GROUP BY ALL),
near AS (
    SELECT a AS node, sum(n)::BIGINT AS n FROM shared JOIN copies ON copies.node = b WHERE 100 * common >= 85 * (sizes - common) GROUP BY a)
SELECT doc_id, coalesce(len(g), 0)::BIGINT AS n_shingles,
       CASE WHEN coalesce(len(g), 0) = 0 THEN 0 ELSE copies.n - 1 + coalesce(near.n, 0) END::BIGINT AS n_links
FROM documents LEFT JOIN sets USING (text) LEFT JOIN copies USING (node) LEFT JOIN near USING (node)"""


def licence_scan() -> str:
    rows = ", ".join(
        f"({_sql_text(name)}, [{', '.join(_sql_text(b) for b in licences.notice_bigrams(text))}])"
        for name, text in sorted(licences.NOTICES.items()))
    return f"""
WITH notices(name, grams) AS (VALUES {rows}),
docs AS (
    SELECT doc_id, row_number() OVER () AS r,
           regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\\n]+', ' ', 'g') AS t
    FROM documents),
parts AS (
    SELECT DISTINCT r, trim(replace(unnest(string_split(t, chr(10)) || regexp_split_to_array(t, '\\n ?\\n') || [t]), chr(10), ' ')) AS part
    FROM docs),
words AS (SELECT r, part, list_filter(string_split(part, ' '), lambda x: x <> '') AS w FROM parts WHERE part <> ''),
grams AS (
    SELECT r, part, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
    FROM words WHERE len(w) > 1 AND len(w) < 5000),
scored AS (
    SELECT r, part, name, (2 * len(list_intersect(g, grams)))::DOUBLE / (len(g) + len(grams))::DOUBLE AS dice
    FROM grams JOIN notices ON len(g) BETWEEN len(grams) / 2 AND len(grams) * 2),
best AS (SELECT r, part, max(dice) AS dice, arg_min(name, (-dice, name)) AS name FROM scored WHERE dice >= 0.8 GROUP BY r, part)
SELECT doc_id, count(part)::BIGINT AS n_matches, arg_min(name, (-dice, name)) AS licence, max(dice) AS dice,
       coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS licences
FROM docs LEFT JOIN best USING (r) GROUP BY r, doc_id"""


def hard_negatives() -> str:
    """All scores of the anchors by brute force."""
    return """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scores AS (
    SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
    SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score
    FROM scores WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id))::INTEGER AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND n.label <> p.own
WHERE 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY rank <= 3"""

"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from jobloom.llm.license_texts import TEMPLATES
from jobloom.llm.licenses import openings

_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return rf"list_filter(string_split(trim(lower(regexp_replace(coalesce({text}, ''), '[^A-Za-z0-9]+', ' ', 'g'))), ' '), lambda w: w <> '')"


def _pairs(words: str) -> str:
    return f"list_transform(list_zip(({words})[1:-2], ({words})[2:]), lambda z: z[1] || ' ' || z[2])"


def _bigrams(text: str) -> str:
    return f"list_distinct({_pairs(_words(text))})"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LICENSE_SCAN = f"""
WITH templates(license, body) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in TEMPLATES.items())}),
sets AS (SELECT license, {_bigrams("body")} AS t FROM templates),
units AS (
  SELECT doc_id, -1 AS line, text AS unit_text FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS unit_text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL) WHERE len(l) > 1
),
grams AS (SELECT doc_id, line, {_bigrams("unit_text")} AS g FROM units),
scored AS (
  SELECT doc_id, line, license, 2.0::DOUBLE * len(list_intersect(g, t)) / (len(g) + len(t)) AS dice
  FROM grams, sets WHERE len(g) BETWEEN len(t) * 0.9 / 1.1 AND len(t) * 1.1 / 0.9
),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, license) AS nth FROM scored WHERE dice >= 0.9
),
heads(license, gram, place) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(g)}, {n})" for k, v in TEMPLATES.items() for g, n in openings(v, 0.9))}),
lengths AS (SELECT license, t, len({_words("body")}) AS n FROM templates JOIN sets USING (license)),
wordy AS (SELECT doc_id, {_words("text")} AS w FROM documents WHERE text IS NOT NULL),
pairs AS (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS gram FROM (SELECT doc_id, {_pairs("w")} AS p FROM wordy)),
starts AS (SELECT DISTINCT doc_id, license, greatest(i - place, 0) AS line FROM pairs JOIN heads USING (gram)),
cut AS (
  SELECT doc_id, license, line, t, list_distinct({_pairs("w[line + 1:line + n]")}) AS g FROM starts JOIN lengths USING (license) JOIN wordy USING (doc_id)
),
laid AS (SELECT doc_id, license, line, 2.0::DOUBLE * len(list_intersect(g, t)) / (len(g) + len(t)) AS dice FROM cut),
passages AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, line) AS nth FROM laid WHERE dice >= 0.9
),
whole AS (SELECT * FROM best WHERE nth = 1)
SELECT doc_id, CASE WHEN line < 0 THEN 'text' ELSE 'line' END AS unit, line::INTEGER AS line, license, round(dice, 6) AS dice FROM whole
UNION ALL
SELECT doc_id, 'passage' AS unit, line::INTEGER AS line, license, round(dice, 6) AS dice
FROM passages p WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM whole w WHERE w.doc_id = p.doc_id AND w.license = p.license)
"""

SOURCE_MIX = rf"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
    coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS key
  FROM documents
),
sources AS (SELECT skey, sum(size)::BIGINT AS source_size FROM sized GROUP BY skey),
weighted AS (
  SELECT *, 3 * source_size AS cap, (row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS weight FROM sources
),
filled AS (
  -- In order of cap per weight, the sources before the first that stays below its cap are capped.
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(cap) OVER o, 0)::BIGINT AS capped, (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::BIGINT AS rest
  FROM weighted WINDOW o AS (ORDER BY cap::DOUBLE / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
level AS (
  SELECT (total - capped)::DOUBLE AS words, rest::DOUBLE AS rest FROM filled
  WHERE cap >= weight * (total - capped)::DOUBLE / rest ORDER BY cap::DOUBLE / weight, skey LIMIT 1
),
targets AS (
  SELECT skey, source_size, CASE WHEN cap < weight * words / level.rest THEN cap::DOUBLE ELSE weight * words / level.rest END AS target
  FROM weighted, level
),
placed AS (
  SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS budget,
    coalesce(sum(size) OVER (PARTITION BY skey ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized JOIN targets USING (skey)
)
SELECT doc_id, size, source_size, target,
  ((budget // greatest(source_size, 1)) * size
    + greatest(0, least(size, budget % greatest(source_size, 1) - before)))::BIGINT AS taken
FROM placed
"""

MINHASH_DEDUP = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents
),
shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM words
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
),
links AS (
  SELECT x, y FROM shared JOIN sizes sx ON sx.doc_id = x JOIN sizes sy ON sy.doc_id = y WHERE 100 * c >= 80 * (sx.n + sy.n - c)
),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.y FROM reach r JOIN both_ways l ON l.x = r.other
),
roots AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM roots LEFT JOIN sizes USING (doc_id)
"""

LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
),
keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_SPACES})")} AS key FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
),
marked AS (
  SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.keeper AS dropped FROM keyed k LEFT JOIN frequent f USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_HEX5 = " || ".join(
    f"translate(lpad(to_base(('0x' || substr(h, {1 + 5 * k}, 5))::BIGINT, 32), 4, '0'), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"
    for k in range(8)
)
WARC_ROUNDTRIP = f"""
WITH digests AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
named AS (SELECT page_id, payload_bytes, {_HEX5} AS payload_digest FROM digests),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM named)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""

_FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

HARD_NEGATIVES = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND {_FINITE}
),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 3
"""


def centroid_clusters(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """One table of centroids and one of assigned rows for each round."""
    tables = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v"
        f" FROM embeddings WHERE len(embedding) = {dims} AND {_FINITE})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INTEGER AS j, v"
        f" FROM (SELECT v, sha256('{seed}:' || vec_id) AS h FROM kept ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        tables.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, k.v, j,"
            " list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d"
            f" FROM kept k, c{r} c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, j) = 1)"
        )
        tables.append(
            f"c{r + 1} AS MATERIALIZED (SELECT j, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN ("
            "SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM ("
            "SELECT j, i, sum(x)::BIGINT AS s, count(*) AS n"
            f" FROM (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY j, i) GROUP BY j) m USING (j))"
        )
    return (
        f"WITH {', '.join(tables[:-1])} SELECT vec_id, j AS cluster, d AS distance, sum(d) OVER (PARTITION BY j)::BIGINT AS cluster_inertia,"
        f" sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (j)"
    )


ORACLES: dict[str, str] = {
    "op1_license_scan": LICENSE_SCAN,
    "op4_source_mix": SOURCE_MIX,
    "op5_minhash_dedup": MINHASH_DEDUP,
    "op6_line_dedup": LINE_DEDUP,
    "op9_warc_roundtrip": WARC_ROUNDTRIP,
    "op12_hard_negatives": HARD_NEGATIVES,
    "op13_centroid_clusters": centroid_clusters(),
}

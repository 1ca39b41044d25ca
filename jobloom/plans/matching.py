"""Matching queries: coverage, TF-IDF, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.operators import analytics as A
from jobloom.operators import matching as M
from jobloom.operators import measure
from jobloom.plans.registry import query
from jobloom.session import settle, table
from jobloom.sources import bindings as B

def _sides(spark, sf_dir):
    """What active jobs ask for and all candidates have, as tables: both are read several times."""
    every = settle(B.job_skills(spark, sf_dir))
    active = A.active_jobs(B.jobs(spark, sf_dir)).select(F.col("id").alias("job_id"))
    return settle(every.join(active, "job_id", "left_semi")), settle(B.candidate_skills(spark, sf_dir, every))


_SIDES = f"""{B.with_tables('jobs', 'job_skills', 'candidate_skills')},
skills AS MATERIALIZED (SELECT * FROM job_skills WHERE job_id IN (SELECT id FROM jobs WHERE status = 'active')),
has AS MATERIALIZED (SELECT * FROM candidate_skills),
able AS (SELECT candidate_id FROM has GROUP BY 1 HAVING count(*) >= 3),
required AS (SELECT job_id, count(*) AS required FROM skills GROUP BY 1),
matched AS (SELECT candidate_id, job_id, count(*) AS matched FROM has JOIN able USING (candidate_id) JOIN skills USING (concept) GROUP BY 1, 2),
scored AS (SELECT candidate_id, job_id, matched, required, matched / required AS score FROM matched JOIN required USING (job_id)),
top AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, job_id)::INTEGER AS rank FROM scored QUALIFY rank <= 10)"""


def coverage_match_topk(spark, sf_dir):
    """The ten jobs that every candidate covers best."""
    return M.coverage_topk(*_sides(spark, sf_dir), 10).select("candidate_id", "job_id", "matched", "required", "score", "rank")


def coverage_explained(spark, sf_dir):
    """The five best jobs of every candidate with the concepts that match and that are missing."""
    skills, own = _sides(spark, sf_dir)
    out = M.explained(M.coverage_topk(skills, own, 5), skills, own)
    return out.select("candidate_id", "job_id", *[F.array_join(x, ";").alias(x) for x in ("matched_concepts", "missing_concepts")])


_EXPLAINED = f"""{_SIDES}, asked AS (SELECT t.candidate_id, t.job_id, s.concept, h.concept IS NOT NULL AS held
  FROM top t JOIN skills s USING (job_id) LEFT JOIN has h ON h.candidate_id = t.candidate_id AND h.concept = s.concept WHERE t.rank <= 5)
SELECT candidate_id, job_id, coalesce(string_agg(concept, ';' ORDER BY concept) FILTER (held), '') AS matched_concepts,
  coalesce(string_agg(concept, ';' ORDER BY concept) FILTER (NOT held), '') AS missing_concepts FROM asked GROUP BY 1, 2"""
_COVERED = f"{_SIDES} SELECT candidate_id, job_id, matched, required, score, rank FROM top"
for _name in ("coverage_match_topk", "coverage_match_topk_all"):
    query(_COVERED, _name)(coverage_match_topk)
for _name in ("coverage_explained", "coverage_explained_all"):
    query(_EXPLAINED, _name)(coverage_explained)


@query(f"{_SIDES} SELECT concept, count(*) AS df, round(ln((1 + (SELECT count(DISTINCT job_id) FROM skills)) / (1 + count(*))) + 1, 9) AS weight FROM skills GROUP BY concept")
def idf_weights(spark, sf_dir):
    return M.idf(_sides(spark, sf_dir)[0]).select("concept", "df", F.round("weight", 9).alias("weight"))


def tfidf_cosine(spark, sf_dir):
    """The ten jobs nearest to every candidate. Ranks aren't shown: scores that round alike may change places."""
    return M.cosine_topk(*_sides(spark, sf_dir), 10).select("candidate_id", "rank", "score")


_COSINES = f"""{_SIDES}, weights AS (SELECT concept, (ln((1 + (SELECT count(DISTINCT job_id) FROM skills)) / (1 + count(*))) + 1) ** 2 AS w2 FROM skills GROUP BY concept),
jn AS (SELECT job_id, sum(w2) AS jn FROM skills JOIN weights USING (concept) GROUP BY 1),
cn AS (SELECT candidate_id, sum(w2) AS cn FROM has JOIN weights USING (concept) GROUP BY 1),
dots AS (SELECT candidate_id, job_id, sum(w2) AS dot FROM has JOIN weights USING (concept) JOIN skills USING (concept) GROUP BY 1, 2)
SELECT candidate_id, row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC)::INTEGER AS rank, score
FROM (SELECT candidate_id, round(dot / (sqrt(jn) * sqrt(cn)), 6) AS score FROM dots JOIN jn USING (job_id) JOIN cn USING (candidate_id)) QUALIFY rank <= 10"""
for _name in ("tfidf_cosine", "tfidf_cosine_topk_all"):
    query(_COSINES, _name)(tfidf_cosine)


@query(
    """WITH graded AS (SELECT source AS query, doc_id AS item, quality AS grade, n_chars::DOUBLE AS score FROM labels JOIN documents USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS pos, row_number() OVER (PARTITION BY query ORDER BY grade DESC, item) AS best FROM graded),
sums AS (SELECT query, sum(CASE WHEN pos <= 5 THEN grade / log2(pos + 1) ELSE 0 END) AS dcg, sum(CASE WHEN best <= 5 THEN grade / log2(best + 1) ELSE 0 END) AS ideal,
  max(CASE WHEN pos = 1 AND grade > 0 THEN 1.0::DOUBLE ELSE 0 END) AS precision_at_1 FROM placed GROUP BY query)
SELECT query, round(dcg, 9) AS dcg, round(ideal, 9) AS ideal, precision_at_1, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 9) AS ndcg FROM sums"""
)
def ndcg_at_5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("query"), F.col("n_chars").cast("double").alias("score"))
    graded = table(spark, sf_dir, "labels").join(docs, "doc_id").select("query", F.col("doc_id").alias("item"), "score", F.col("quality").alias("grade"))
    out = M.ndcg(graded.select("query", "item", "score"), graded.select("query", "item", "grade"))
    return out.select("query", *[F.round(x, 9).alias(x) for x in ("dcg", "ideal")], "precision_at_1", F.round("ndcg", 9).alias("ndcg"))


@query(
    """WITH centre AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
mean AS (SELECT label, i, avg(v) AS m FROM centre GROUP BY 1, 2),
each AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT vec_id, label, round(sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m))), 5) AS score FROM each JOIN mean USING (label, i) GROUP BY vec_id, label"""
)
def centroid_cosine(spark, sf_dir):
    """Cosine of every vector with its label's centroid: the matcher that was only evaluated."""
    each = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    mean = each.groupBy("label", "i").agg(F.avg("v").alias("m"))
    dot = F.sum(F.col("v") * F.col("m")) / (F.sqrt(F.sum(F.col("v") * F.col("v"))) * F.sqrt(F.sum(F.col("m") * F.col("m"))))
    return each.join(mean, ["label", "i"]).groupBy("vec_id", "label").agg(F.round(dot, 5).alias("score"))


def _spans(spark, sf_dir, step: int, size: int):
    """Spans of ``size`` laid every ``step`` characters over whole documents; on every fourth, none in the middle half."""
    docs = table(spark, sf_dir, "documents").withColumn("n", F.coalesce(F.length("text"), F.lit(0)))
    at = F.explode(F.sequence(F.lit(0), F.col("n"), F.lit(step)))
    gone = (F.col("doc_id") % 4 == 0) & (F.col("start") * 4 > F.col("n")) & (F.col("start") * 4 < F.col("n") * 3)
    laid = docs.select("doc_id", "n", "lang", at.alias("start")).where(~gone | F.lit(size == GOLD[1]))
    return laid.select(F.col("doc_id").alias("posting"), "start", (F.col("start") + size).alias("end"), F.col("lang").alias("category"))


GOLD, FOUND, OTHER = (90, 10), (70, 12), (300, 40)
_CUT = "CASE WHEN doc_id % 4 = 0 AND start * 4 > n AND start * 4 < n * 3 THEN 1 ELSE 0 END = 0"
_LAID = "SELECT doc_id AS posting, start, start + {1} AS \"end\", lang AS category FROM (SELECT doc_id, n, lang, unnest(range(0, n + 1, {0})) AS start FROM sized) WHERE {2}"
_TOUCH = "EXISTS (SELECT 1 FROM {1} o WHERE o.posting = {0}.posting AND {0}.start < o.end AND o.start < {0}.end)"
_ARMS = f"""WITH sized AS (SELECT doc_id, lang, coalesce(length(text), 0) AS n FROM documents),
gold AS MATERIALIZED ({_LAID.format(*GOLD, "true")}), found AS MATERIALIZED ({_LAID.format(*FOUND, _CUT)}), other AS MATERIALIZED ({_LAID.format(*OTHER, _CUT)}),
g AS MATERIALIZED (SELECT gold.*, {_TOUCH.format("gold", "found")} AS hit, {_TOUCH.format("gold", "other")} AS hit2 FROM gold),
f AS MATERIALIZED (SELECT found.*, {_TOUCH.format("found", "gold")} AS right_ FROM found)"""


def span_overlap_precision_recall(spark, sf_dir):
    """Over whole documents."""
    scores = measure.span_scores(_spans(spark, sf_dir, *GOLD), _spans(spark, sf_dir, *FOUND))
    return measure.precision_recall(scores).select(F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


for _name in ("span_overlap_precision_recall", "span_overlap_all"):
    query(f"{_ARMS} SELECT round((SELECT avg(hit::INT) FROM g), 9) AS recall, round((SELECT avg(right_::INT) FROM f), 9) AS precision", _name)(span_overlap_precision_recall)


@query(
    f"""{_ARMS} SELECT category, count(*) AS gold, count(*) FILTER (NOT hit AND NOT hit2) AS missed FROM g GROUP BY category"""
)
def gold_tail(spark, sf_dir):
    """How much gold of each language no arm finds."""
    gold = _spans(spark, sf_dir, *GOLD)
    tail = measure.gold_tail(gold, _spans(spark, sf_dir, *FOUND), _spans(spark, sf_dir, *OTHER)).groupBy("category").agg(F.count("*").alias("missed"))
    every = gold.groupBy("category").agg(F.count("*").alias("gold"))
    return every.alias("e").join(tail.alias("t"), F.col("e.category").eqNullSafe(F.col("t.category")), "left").select("e.category", "gold", F.coalesce("missed", F.lit(0)).alias("missed"))


_SHORT = r"""SELECT doc_id AS posting, i, term FROM (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS i FROM
  (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents WHERE text IS NOT NULL))"""


@query(
    f"""WITH words AS (SELECT posting, i * 10 AS start, i * 10 + length(term) AS "end", term FROM ({_SHORT})),
gold AS MATERIALIZED (SELECT posting, i * 10 AS start, i * 10 + 2 AS "end" FROM ({_SHORT}) WHERE i % 3 = 0),
short AS MATERIALIZED (SELECT w.*, {_TOUCH.format("w", "gold")} AS right_ FROM words w WHERE length(term) <= 3)
SELECT count(*) AS short, count(*) FILTER (right_) AS "right", round(count(*) FILTER (right_) / count(*), 9) AS precision FROM short"""
)
def short_token_precision(spark, sf_dir):
    """Words of whole documents as found spans, one every ten places; every third is gold."""
    words = F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("i", "term")
    laid = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("posting"), words).withColumn("start", F.col("i") * 10)
    gold = laid.where("i % 3 = 0").withColumn("end", F.col("start") + 2)
    out = measure.short_token_precision(gold, laid.withColumn("end", F.col("start") + F.length("term")))
    return out.withColumn("precision", F.round("precision", 9))


ROUNDS = 10_000
_DRAW = f"(a + b * r % {measure.PRIME} + c * (r * r % {measure.PRIME}) % {measure.PRIME}) % {measure.PRIME}"
_TIMES = " + ".join(f"(d >= {t})::INT" for t in measure.poisson_steps())
_KEY = "(('0x' || substr(md5('20260823:' || posting), {0}, 8))::BIGINT % {1})"


@query(
    f"""{_ARMS}, cells AS (SELECT posting, count(*) AS gold, count(*) FILTER (hit) AS one, count(*) FILTER (hit2) AS two FROM g GROUP BY posting),
keys AS MATERIALIZED (SELECT *, {", ".join(f"{_KEY.format(1 + 8 * k, measure.PRIME)} AS {n}" for k, n in enumerate("abc"))} FROM cells),
sums AS MATERIALIZED (SELECT r, sum(w * one)::BIGINT AS one, sum(w * two)::BIGINT AS two, sum(w * gold)::BIGINT AS gold
  FROM (SELECT *, {_TIMES} AS w FROM (SELECT r, one, two, gold, {_DRAW} AS d FROM keys, range(1, {ROUNDS} + 1) x(r))) GROUP BY r),
drawn AS (SELECT unnest(['found', 'other', 'found minus other']) AS name, unnest([one / gold, two / gold, one / gold - two / gold]) AS v FROM sums WHERE gold > 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY v) AS n, count(*) OVER (PARTITION BY name) AS m FROM drawn),
ends AS (SELECT name, max(v) FILTER (n = floor(m * 0.025) + 1) AS low, max(v) FILTER (n = floor(m * 0.975)) AS high FROM placed GROUP BY name),
whole AS (SELECT unnest(['found', 'other', 'found minus other']) AS name, unnest([o / g, t / g, o / g - t / g]) AS e, unnest([g, g, NULL]) AS size
  FROM (SELECT sum(one) AS o, sum(two) AS t, sum(gold) AS g FROM cells))
SELECT name, round(e, 9) AS estimate, round(low, 9) AS low, round(high, 9) AS high,
  round(CASE WHEN size IS NULL THEN NULL WHEN e * (1 - e) > 0 THEN ((high - low) / 3.92::DOUBLE) ** 2 / (e * (1 - e) / size) ELSE 1 END, 6) AS design_effect FROM whole JOIN ends USING (name)"""
)
def bootstrap_interval(spark, sf_dir):
    """Intervals of the recall of two arms over whole documents and of their paired difference, from 10000 resamples."""
    gold = _spans(spark, sf_dir, *GOLD)
    one = measure.span_scores(gold, _spans(spark, sf_dir, *FOUND)).select("posting", "gold", F.col("hit").alias("one"))
    two = measure.span_scores(gold, _spans(spark, sf_dir, *OTHER)).select("posting", F.col("hit").alias("two"))
    out = measure.bootstrap(one.join(two, "posting"), {"found": ("one", "gold"), "other": ("two", "gold")}, [("found", "other")], ROUNDS)
    return out.select("name", *[F.round(c, 9).alias(c) for c in ("estimate", "low", "high")], F.round("design_effect", 6).alias("design_effect"))


@query(
    f"""{_SIDES} SELECT count(*) AS explanations_shown, round(avg(required), 6) AS mean_skills, round(avg((matched > 0)::INT), 6) AS share_naming_a_match
FROM top WHERE rank <= 5 AND score > 0"""
)
def explanation_summary(spark, sf_dir):
    out = M.explanation_summary(M.coverage_topk(*_sides(spark, sf_dir), 5))
    return out.select("explanations_shown", *[F.round(c, 6).alias(c) for c in ("mean_skills", "share_naming_a_match")])

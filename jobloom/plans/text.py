"""Text queries: markup, skills, candidates, samples, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.functions.sites import linked_subdomains, markup_title
from jobloom.functions.text import normal_text, plain_text
from jobloom.operators import boilerplate as P
from jobloom.operators import cvs as V
from jobloom.operators import extraction as X
from jobloom.operators import measure as S
from jobloom.plans.identity import TEMPLATED, stored_postings
from jobloom.plans.registry import query
from jobloom.session import table
from jobloom.sources import bindings as B
from jobloom.sources import versions

# A small vocabulary of its own over the test texts: forms, and the concepts they name.
FORMS = [
    ("the", "article"), ("of the", "genitive"), ("and", "conjunction"), ("der", "article"), ("die", "article"),
    ("apache license", "licence"), ("license", "licence"), ("gnu general public license", "licence"), ("in", "place"),
    ("in", "time"), ("mit license", "licence"),
]


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("employer"))


@query()
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", plain_text(F.col("html")).alias("text"))


def _placed(token: str, source: str) -> str:
    """SQL of (id, k, token, start, "end", gap): the tokens of each text of ``source`` with what stands before them."""
    return f"""SELECT id, k, tok AS token, place AS start, place + length(tok) AS "end", gap FROM (
  SELECT id, k, tok, gap, (sum(length(gap) + length(tok)) OVER (PARTITION BY id ORDER BY k) - length(tok))::BIGINT AS place FROM (
    SELECT id, unnest(range(1, len(t) + 1)) AS k, unnest(t) AS tok, unnest(g[1:len(t)]) AS gap
    FROM (SELECT id, regexp_extract_all(text, '{token}') AS t, regexp_split_to_array(text, '{token}') AS g FROM {source})))"""


_RAW = "raw AS (SELECT doc_id AS id, text, source AS employer FROM documents WHERE text IS NOT NULL)"
_LETTER = r"[\p{L}\p{N}]"
_TERM = rf"{_LETTER}(?:{_LETTER}|[+#]|[./]{_LETTER})*"
_LONGEST = max(len(X.token_forms(f)) for f, _ in FORMS)


def _mention_sql() -> str:
    known: dict[str, set] = {}
    for surface, concept in FORMS:
        known.setdefault(" ".join(X.token_forms(surface)), set()).add(concept)
    rows = ", ".join(f"('{f}', {'NULL' if len(c) > 1 else repr(min(c))}, {len(f.split())})" for f, c in sorted(known.items()))
    runs = " UNION ALL ".join(
        f"""SELECT id, k, {n} AS n, {" || ' ' || ".join(["form", *[f"lead(form, {j}) OVER w" for j in range(1, n)]])} AS form, start,
  {f'lead("end", {n - 1}) OVER w' if n > 1 else '"end"'} AS "end" FROM tokens WINDOW w AS (PARTITION BY id ORDER BY k)"""
        for n in range(1, _LONGEST + 1)
    )
    # None of these forms overlaps itself or another of its length, so a length's hits only yield to longer ones.
    steps, taken = [], []
    for n in range(_LONGEST, 0, -1):
        free = "".join(f" AND NOT EXISTS (SELECT 1 FROM t{m} t WHERE t.id = h.id AND h.k < t.k + {m} AND t.k < h.k + {n})" for m in taken)
        steps.append(f"t{n} AS MATERIALIZED (SELECT * FROM hits h WHERE n = {n}{free})")
        taken.append(n)
    every = " UNION ALL ".join(f"SELECT * FROM t{n}" for n in taken)
    return f"""WITH {_RAW}, tokens AS MATERIALIZED (SELECT *, replace(lower(token), 'ß', 'ss') AS form FROM ({_placed(_TERM, "raw")})),
known(form, concept, n) AS (VALUES {rows}), hits AS MATERIALIZED (SELECT r.*, concept FROM ({runs}) r JOIN known USING (form, n)), {", ".join(steps)}
SELECT id, substr(text, start + 1, "end" - start) AS surface_form, form, concept, start::INTEGER AS start, "end"::INTEGER AS "end" FROM ({every}) JOIN raw USING (id)"""


@query(_mention_sql())
def extract_mentions(spark, sf_dir):
    vocabulary = X.load_vocabulary(spark.createDataFrame(FORMS, "surface_form string, concept string"))
    return X.extract_mentions(_texts(spark, sf_dir), vocabulary)


_ANY = r"[\p{L}\p{N}_]"
_MARKED = rf"[A-Za-z]{_ANY}*(?:[./][A-Za-z]{_ANY}*)+|[A-Za-z]{_ANY}*[+#]+"
_CAPITAL = r"[A-ZÀ-Þ][\p{L}\p{N}_À-ɏ]*"
_FROM_RAW = rf"""dense AS (SELECT id, len(w) >= 30 AND len(list_filter(w, lambda x: upper(x[1]) = x[1] AND lower(x[1]) <> x[1])) > 0.25::DOUBLE * len(w) AS dense
  FROM (SELECT id, regexp_extract_all(text, '[A-Za-zÀ-ɏ][\p{{L}}\p{{N}}_À-ɏ]*') AS w FROM raw)),
tokens AS MATERIALIZED (SELECT t.*, dense, trim(regexp_replace(gap, '\s', ' ', 'g')) = '' AS touches,
    (regexp_full_match(token, '{_MARKED}') OR (NOT dense AND regexp_full_match(token, '{_CAPITAL}')))
      AND lower(token) NOT IN ({", ".join(f"'{w}'" for w in sorted(X.STOPWORDS))}) AS named FROM ({_placed(f"{_MARKED}|{_CAPITAL}|" + _ANY + "+", "raw")}) t JOIN dense USING (id)),
islands AS (SELECT *, sum(CASE WHEN named AND touches THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY k) AS island FROM tokens),
runs AS (SELECT i.*, count(*) OVER (PARTITION BY id, island ORDER BY k DESC) AS reach, substr(text, greatest(start - 40, 0) + 1, start - greatest(start - 40, 0)) AS before
  FROM islands i JOIN raw USING (id) WHERE named),
begun AS (SELECT *, regexp_matches(before, '[.!?:;)\]\n]\s*$') OR regexp_full_match(before, '\s*') AS opens FROM runs),
proposed AS (SELECT b.id, substr(text, b.start + 1, e."end" - b.start) AS surface_form, b.start::INTEGER AS start, e."end"::INTEGER AS "end"
  FROM begun b JOIN tokens e ON e.id = b.id AND e.k >= b.k AND e.k < b.k + least(b.reach, 4) AND (e.k > b.k OR NOT b.opens) JOIN raw ON raw.id = b.id)"""


_PROPOSED = f"{_RAW}, {_FROM_RAW}"


@query(f'WITH {_PROPOSED} SELECT id, surface_form, start, "end" FROM proposed')
def propose_candidates(spark, sf_dir):
    return X.propose_candidates(_texts(spark, sf_dir))


@query(
    f"""WITH {_PROPOSED} SELECT surface_form, count(DISTINCT employer) AS employers, count(*) AS mentions, count(DISTINCT id) AS postings, min(id) AS example
FROM proposed JOIN raw USING (id) WHERE employer IS NOT NULL GROUP BY 1 ORDER BY employers DESC, mentions DESC, surface_form LIMIT 50"""
)
def review_queue(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    return X.review_queue(X.propose_candidates(texts), texts.select("id", "employer"))


_STOPS = ", ".join(f"'{w}'" for w in sorted(w for w in X.STOPWORDS if w.isascii()))


@query(
    f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
grams AS (SELECT doc_id, unnest(list_distinct(flatten([
  list_transform(range(1, len(w) + 1), lambda i: CASE WHEN w[i] NOT IN ({_STOPS}) THEN w[i] END),
  list_transform(range(1, len(w)), lambda i: CASE WHEN w[i] NOT IN ({_STOPS}) AND w[i + 1] NOT IN ({_STOPS}) THEN w[i] || ' ' || w[i + 1] END),
  list_transform(range(1, len(w) - 1), lambda i: CASE WHEN w[i] NOT IN ({_STOPS}) AND w[i + 2] NOT IN ({_STOPS}) THEN w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END)]))) AS term FROM w)
SELECT term, count(*) AS df FROM grams WHERE term IS NOT NULL GROUP BY term HAVING count(*) >= 3 AND count(*) <= 0.25::DOUBLE * (SELECT count(*) FROM w)"""
)
def document_frequency_vocab(spark, sf_dir):
    return X.ngram_frequencies(_texts(spark, sf_dir))


@query(
    """SELECT source, count(*) AS postings, sum(length(text))::BIGINT AS characters, min(length(text)) AS shortest, max(length(text)) AS longest,
  sum(('0x' || substr(md5(doc_id::VARCHAR || chr(31) || text), 1, 8))::BIGINT)::BIGINT AS digest FROM documents WHERE text IS NOT NULL GROUP BY source"""
)
def corpus_manifest(spark, sf_dir):
    return S.manifest(_texts(spark, sf_dir).select("id", F.col("employer").alias("source"), F.col("text").alias("description")))


@query(
    """WITH s AS (SELECT lang AS stratum, count(*) AS size FROM documents GROUP BY 1), t AS (SELECT *, size * 80.0::DOUBLE / (SELECT sum(size) FROM s)::DOUBLE AS exact FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY exact - floor(exact) DESC, stratum) AS n, 80 - sum(floor(exact)) OVER () AS rest FROM t)
SELECT stratum, size, greatest(floor(exact)::BIGINT + CASE WHEN n <= rest THEN 1 ELSE 0 END, 1)::BIGINT AS quota FROM r"""
)
def stratified_sample_quota(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("stratum")).agg(F.count("*").alias("size"))
    return S.largest_remainder(sizes, 80).select("stratum", "size", "quota")


@query("SELECT source, lang, count(*) AS postings, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 9) AS share FROM documents GROUP BY source, lang")
def language_mix(spark, sf_dir):
    out = S.language_mix(table(spark, sf_dir, "documents"))
    return out.withColumn("share", F.round("share", 9))


_REWRITTEN = f"""{TEMPLATED}, topped AS (SELECT *, max(seen) OVER (PARTITION BY employer) AS most FROM counts),
gone AS (SELECT employer, fold FROM topped JOIN known USING (employer) WHERE n >= 5 AND (seen >= 0.6::DOUBLE * n OR (most >= 2 AND seen >= 0.9::DOUBLE * most))),
marked AS (SELECT e.*, g.fold IS NOT NULL AS gone FROM each e LEFT JOIN gone g USING (employer, fold)),
cut AS (SELECT posting_id, count(*) FILTER (gone) AS removed, string_agg(block, chr(10) ORDER BY pos) FILTER (NOT gone) AS description FROM marked GROUP BY 1),
changes AS MATERIALIZED (SELECT posting_id, c.description, removed AS removed_blocks, length(t.description) - length(c.description) AS removed_characters
  FROM cut c JOIN templated t USING (posting_id) WHERE removed > 0 AND c.description IS NOT NULL)"""


def _changes(spark, sf_dir):
    postings = stored_postings(spark, sf_dir)
    return postings, P.rewrites(postings, P.removable_stored(postings))


@query(
    f"""WITH {_REWRITTEN} SELECT (SELECT count(*) FROM templated) AS postings_read, count(*) AS postings_changed, coalesce(sum(removed_blocks), 0)::BIGINT AS blocks_removed,
  coalesce(sum(removed_characters), 0)::BIGINT AS characters_removed FROM changes"""
)
def backfill_report(spark, sf_dir):
    return P.backfill_report(*_changes(spark, sf_dir))


@query(f"WITH {_REWRITTEN} SELECT posting_id, md5(description) AS digest, removed_blocks, removed_characters FROM changes")
def backfill_rewrites(spark, sf_dir):
    """What a backfill would write: each changed posting with its text's digest."""
    return _changes(spark, sf_dir)[1].select("posting_id", F.md5(F.col("description").cast("binary")).alias("digest"), "removed_blocks", "removed_characters")


@query(
    f"""WITH {_REWRITTEN}, raw AS (SELECT posting_id * 2 AS id, description AS text FROM templated UNION ALL
  SELECT posting_id * 2 + 1, coalesce(c.description, t.description) FROM templated t LEFT JOIN changes c USING (posting_id)),
{_FROM_RAW}, terms AS (SELECT id % 2 AS v, trim(regexp_replace(surface_form, '\\s+', ' ', 'g')) AS term FROM proposed)
SELECT CASE v WHEN 0 THEN 'before' ELSE 'after' END AS version, count(term) AS observations, count(DISTINCT term) AS distinct_terms, any_value(characters)::BIGINT AS characters
FROM (SELECT id % 2 AS v, sum(length(text)) AS characters FROM raw GROUP BY 1) LEFT JOIN terms USING (v) GROUP BY v"""
)
def boilerplate_measured(spark, sf_dir):
    return P.measured(*_changes(spark, sf_dir), X.propose_candidates)


@query(
    f"""{B.with_tables("jobs", "job_provenance", "job_sources")}, corpus AS (SELECT j.id, c_name AS employer, published_at, title || ' ' || j.id AS description FROM jobs j JOIN customer ON c_custkey = company_id),
records AS (SELECT job_id, key AS source_key, job_id AS source_job_id, CASE WHEN source_id % 5 = 0 THEN 'board' || job_id % 7 END AS board FROM job_provenance JOIN job_sources USING (source_id)),
parts AS (SELECT md5(description) AS h FROM corpus UNION ALL SELECT md5(source_key || ':' || source_job_id) FROM records),
digest AS (SELECT sum(('0x' || substr(h, 1, 15))::BIGINT::HUGEINT) AS d FROM parts)
SELECT 'source' AS kind, source_key AS name, count(*)::VARCHAR AS value FROM records GROUP BY 2
UNION ALL SELECT 'board', board, count(*)::VARCHAR FROM records WHERE board IS NOT NULL GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'employer', employer, count(*)::VARCHAR FROM corpus GROUP BY 2 ORDER BY count(*) DESC, employer LIMIT 30)
UNION ALL SELECT 'total', unnest(['jobs', 'employers', 'jobs_with_two_sources', 'without_a_date', 'earliest', 'latest', 'digest']), unnest([count(*)::VARCHAR, count(DISTINCT employer)::VARCHAR,
  (SELECT count(*) FROM (SELECT job_id FROM records GROUP BY 1 HAVING count(DISTINCT source_key) > 1))::VARCHAR, count(*) FILTER (published_at IS NULL)::VARCHAR,
  min(published_at)::TIMESTAMP::VARCHAR, max(published_at)::TIMESTAMP::VARCHAR, (SELECT d FROM digest)::VARCHAR]) FROM corpus"""
)
def corpus_manifest_full(spark, sf_dir):
    """The whole manifest of the catalogue; every fifth source has boards."""
    companies = B.companies(spark, sf_dir).select(F.col("id").alias("company_id"), F.col("display_name").alias("employer"))
    jobs = B.jobs(spark, sf_dir).join(companies, "company_id")
    corpus = jobs.select("id", "employer", "published_at", F.concat_ws(" ", "title", F.col("id").cast("string")).alias("description"))
    sources = B.job_sources(spark, sf_dir).select("source_id", F.col("key").alias("source_key"))
    board = F.when(F.col("source_id") % 5 == 0, F.concat(F.lit("board"), F.col("job_id") % 7))
    records = B.job_provenance(spark, sf_dir).join(sources, "source_id").select("job_id", "source_key", F.col("job_id").alias("source_job_id"), board.alias("board"))
    return S.full_manifest(corpus, records)


_NEW_PARTS = "SELECT p_partkey, CASE WHEN p_partkey % 97 = 3 THEN upper(p_name) ELSE p_name END AS p_name FROM part WHERE p_partkey % 89 <> 5 UNION ALL SELECT 10000000 + n_nationkey, n_name FROM nation"


@query(
    f"""SELECT p_partkey, CASE WHEN a.p_name IS NULL THEN 'missing' WHEN b.p_name IS NULL THEN 'unexpected' ELSE 'changed' END AS difference
FROM part a FULL JOIN ({_NEW_PARTS}) b USING (p_partkey) WHERE a.p_name IS DISTINCT FROM b.p_name"""
)
def publication_differences(spark, sf_dir):
    """How a new table of parts differs from the published one, by key."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    name = F.when(F.col("p_partkey") % 97 == 3, F.upper("p_name")).otherwise(F.col("p_name"))
    more = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 10_000_000).cast("long").alias("p_partkey"), F.col("n_name").alias("p_name"))
    new = part.where("p_partkey % 89 <> 5").withColumn("p_name", name).unionByName(more)
    return versions.differences(part, new, ["p_partkey"])


_STEPS = "(['processing', 'processed', 'failed', 'pending', 'processing'])[event_id % 5 + 1]"


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS cv_id, {_STEPS} AS wanted, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
walk AS (SELECT DISTINCT cv_id, 0::BIGINT AS k, 'pending'::VARCHAR AS state, 0::BIGINT AS rejects FROM e
  UNION ALL
  SELECT e.cv_id, e.k, CASE WHEN ok THEN wanted ELSE state END, rejects + CASE WHEN ok THEN 0 ELSE 1 END
  FROM (SELECT e.*, w.state, w.rejects, (state, wanted) IN (('pending', 'processing'), ('processing', 'processed'), ('processing', 'failed'), ('failed', 'processing')) AS ok
    FROM walk w JOIN e ON e.cv_id = w.cv_id AND e.k = w.k + 1) e)
SELECT cv_id, arg_max(state, k) AS state, max(rejects) AS rejects FROM walk GROUP BY cv_id"""
)
def cv_states(spark, sf_dir):
    """The last legal state of every CV and the steps refused."""
    steps = F.array(*map(F.lit, ("processing", "processed", "failed", "pending", "processing")))
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("cv_id"), F.col("ts").alias("at"), "event_id", F.get(steps, (F.col("event_id") % 5).cast("int")).alias("state")
    )
    return V.states_after(V.steps_taken(events))


@query(
    f"""{B.with_tables("candidate_skills")}, stored AS (SELECT *, CASE WHEN length(concept) % 2 = 0 THEN 'cv' ELSE 'manual' END AS source FROM candidate_skills WHERE candidate_id % 3 <> 1),
fresh AS (SELECT DISTINCT c.candidate_id + 1 AS candidate_id, concept FROM candidate_skills c WHERE (c.candidate_id + 1) % 2 = 0)
SELECT * FROM stored WHERE source = 'manual' OR candidate_id % 2 <> 0
UNION ALL SELECT *, 'cv' FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.source = 'manual' AND s.candidate_id = f.candidate_id AND s.concept = f.concept)"""
)
def cv_skills_replaced(spark, sf_dir):
    """Every second candidate's CV read again, with the skills of the candidate before."""
    skills = B.candidate_skills(spark, sf_dir)
    stored = skills.where("candidate_id % 3 <> 1").withColumn("source", F.when(F.length("concept") % 2 == 0, "cv").otherwise("manual"))
    new = skills.withColumn("candidate_id", F.col("candidate_id") + 1)
    read = new.where("candidate_id % 2 = 0").select("candidate_id").unionByName(stored.where("candidate_id % 2 = 0").select("candidate_id"))
    return V.replaced_skills(stored, new, read)


@query(
    f"""WITH gold AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+')[1:3] AS labels FROM documents WHERE text IS NOT NULL),
hits AS (SELECT count(*) AS g, count(*) FILTER (list_has_any(list_transform(labels, lambda x: lower(x)), [{", ".join(f"'{f}'" for f, _ in FORMS)}])) AS r FROM gold)
SELECT g AS gold_mentions, r AS resolved_mentions, round(r / g, 9) AS rate FROM hits"""
)
def gold_resolution(spark, sf_dir):
    """The first three words of every text as the labels of a mention."""
    labels = F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), 1, 3)
    gold = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("mention"), labels.alias("labels"))
    vocabulary = X.load_vocabulary(spark.createDataFrame(FORMS, "surface_form string, concept string"))
    return X.gold_resolution(gold, vocabulary).withColumn("rate", F.round("rate", 9))


@query(
    """WITH concepts AS (SELECT p_partkey % 1500 AS concept FROM part), forms AS (SELECT p_partkey AS entry, CASE WHEN p_partkey % 50 = 0 THEN ' - ' ELSE p_name || ' ' || p_partkey % 700 END AS surface_form,
  CASE WHEN p_partkey % 60 = 1 THEN [] WHEN p_partkey % 45 = 2 THEN [p_partkey, p_partkey] ELSE [p_partkey % 1500, p_partkey % 1500 + 7] END AS concepts FROM part),
named AS (SELECT *, lower(surface_form) AS form FROM forms)
SELECT 'concept_repeated' AS problem, concept::VARCHAR AS value FROM concepts GROUP BY concept HAVING count(*) > 1
UNION ALL SELECT 'form_blank', entry::VARCHAR FROM named WHERE surface_form = ' - '
UNION ALL SELECT 'form_repeated', form FROM named WHERE surface_form <> ' - ' GROUP BY form HAVING count(*) > 1
UNION ALL SELECT 'entry_repeats_concept', entry::VARCHAR FROM named WHERE len(concepts) > len(list_distinct(concepts))
UNION ALL SELECT 'entry_without_concept', entry::VARCHAR FROM named WHERE len(concepts) = 0
UNION ALL SELECT 'unknown_concept', c::VARCHAR FROM (SELECT DISTINCT unnest(concepts) AS c FROM named) WHERE c NOT IN (SELECT concept FROM concepts)"""
)
def alias_problems(spark, sf_dir):
    """Parts as an alias table with every kind of fault."""
    part, n = table(spark, sf_dir, "part"), F.col("p_partkey")
    none = F.array().cast("array<bigint>")
    ids = F.when(n % 60 == 1, none).when(n % 45 == 2, F.array(n, n)).otherwise(F.array(n % 1500, n % 1500 + 7))
    surface = F.when(n % 50 == 0, " - ").otherwise(F.concat_ws(" ", "p_name", (n % 700).cast("string")))
    return X.alias_problems(part.select((n % 1500).alias("concept")), part.select(n.alias("entry"), surface.alias("surface_form"), ids.alias("concepts")))


@query(r"""SELECT page_id, trim(replace(replace(replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'si'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS title FROM pages WHERE regexp_matches(html, '<title[^>]*>\s*[^<\s]', 'i')""")
def site_titles(spark, sf_dir):
    """The title of every page that has one."""
    return table(spark, sf_dir, "pages").select("page_id", markup_title(F.col("html")).alias("title")).where("title is not null")


@query(
    """WITH links AS (SELECT page_id, regexp_extract_all('<a HREF="' || url || '">' || html, '(?i)(?:href|src)\\s*=\\s*["'']https?://([a-z0-9-]+)\\.example\\.com(?:[/"''?#]|$)', 1) AS found FROM pages WHERE html IS NOT NULL)
SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(found, lambda x: lower(x)), lambda x: x <> 'www' AND x <> ''))), ' ') AS tenants FROM links WHERE len(found) > 0"""
)
def linked_tenants(spark, sf_dir):
    """The subdomains of one host that a page links to, with a link to the page itself in front."""
    page = F.concat(F.lit('<a HREF="'), "url", F.lit('">'), "html")
    found = table(spark, sf_dir, "pages").select("page_id", linked_subdomains(page, "example.com").alias("found")).where(F.size("found") > 0)
    return found.select("page_id", F.array_join(F.array_sort("found"), " ").alias("tenants"))


@query("SELECT lower(trim(source)) AS employer, count(*) AS postings FROM documents WHERE source IS NOT NULL GROUP BY 1")
def employer_postings(spark, sf_dir):
    """Stored postings by the employer's normal name, however it is written."""
    docs = table(spark, sf_dir, "documents").where("source is not null")
    written = F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.concat(F.lit(" "), "source", F.lit("  ")))
    return docs.groupBy(normal_text(written).alias("employer")).agg(F.count("*").alias("postings"))

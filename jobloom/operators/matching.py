"""Matching candidates to jobs: coverage, TF-IDF cosine, and how well a ranking does."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobloom.session import settle

MIN_CONCEPTS = 3


def best_pairs(
    job_skills: DataFrame, candidate_skills: DataFrame, weights: DataFrame, norms: tuple[DataFrame, DataFrame] | None, limit: int,
    digits: int | None = None, first_jobs: int = 65_536, job_block: int = 65_536, candidate_block: int = 32_768,
) -> DataFrame:
    """(candidate_id, job_id, matched, score): every pair that can be among its candidate's ``limit`` best, and few others.

    A pair's score is the sum of ``weights`` (concept, u) over its common concepts, by the norms (job_id, norm) of its job
    and (candidate_id, own) of its candidate, which hang on their concepts only, rounded to ``digits``; higher ones come
    first, ties by job id. Without ``digits`` the weights are whole numbers, so that sums are exact. Without ``norms`` they are
    the roots of a side's own sums.

    Jobs with the same concepts stand for one another, as do candidates; only these kinds are compared. No pair scores more
    than its common weight can be, so kinds of jobs are gone through from the greatest such bound in rounds that grow
    fourfold from ``first_jobs``, and a candidate leaves once no kind that is left can change its best. In a round blocks of
    candidates meet blocks of jobs, and only what can be among the ``limit`` best so far goes on (``_best_of_blocks``).
    """
    job_norm, own_norm = norms or (None, None)
    spark = job_skills.sparkSession
    coded = settle(weights.withColumn("code", F.monotonically_increasing_id()))
    asked = job_skills.join(coded, "concept").groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("code", "u"))).alias("asks"), F.sum("u").alias("most"))
    same = lambda c: [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(1), c).alias("h2")]
    asked = asked.withColumn("norm", F.sqrt("most")) if job_norm is None else asked.join(job_norm, "job_id")
    asked = asked.select("job_id", "asks", "norm", "most", *same("asks.code"))
    alike = Window.partitionBy("h1", "h2").orderBy("job_id")
    asked = asked.withColumn("nth", F.row_number().over(alike)).withColumn("kind", F.first("job_id").over(alike)).where(F.col("nth") <= limit)
    asked = settle(asked.select("job_id", "kind", "norm", "most", F.when(F.col("nth") == 1, F.col("asks")).alias("asks")))
    jobs = settle(asked.where("asks is not null").select("kind", "norm", "most", F.col("asks.code").alias("asks"), F.col("asks.u").alias("u"), (F.col("most") / F.col("norm")).alias("bound")))
    held = candidate_skills.join(coded, "concept").groupBy("candidate_id").agg(F.array_sort(F.collect_list("code")).alias("held"), F.sum("u").alias("has"))
    held = held.withColumn("own", F.sqrt("has")) if own_norm is None else held.join(own_norm, "candidate_id")
    held = held.withColumns({"h1": same("held")[0], "h2": same("held")[1]})
    person = F.first("candidate_id").over(Window.partitionBy("h1", "h2").orderBy("candidate_id"))
    held = settle(held.withColumn("person", person).select("candidate_id", "person", "own", "has", F.when(F.col("person") == F.col("candidate_id"), F.col("held")).alias("held")))
    members = held.select("candidate_id", "person")
    empty = f"person {held.schema['person'].dataType.simpleString()}, kind {jobs.schema['kind'].dataType.simpleString()}, matched long, score double"
    open_ = held.where("held is not null").select("person", "own", "has", "held", F.lit(0.0).alias("floor"))
    done, found, rest, size = [], spark.createDataFrame([], empty), jobs, first_jobs
    while True:
        last = rest.count() <= 2 * size
        now = rest if last else rest.orderBy(F.desc("bound"), "kind").limit(size)
        now = settle(now)
        met = settle(_ranked_kinds(_met(now, open_, limit, digits, job_block, candidate_block).unionByName(found), limit))
        if last:
            done.append(met)
            break
        rest = settle(rest.join(now.select("kind"), "kind", "left_anti"))
        bounds = rest.agg(F.max("bound").alias("top"), F.min("norm").alias("least"), F.min("kind").alias("next")).first()
        slack = 0.0 if digits is None else 0.5 * 10.0**-digits + 1e-9
        most = F.least(F.lit(bounds["top"]), F.col("has") / F.lit(bounds["least"])) / F.col("own") * (1.0 if digits is None else 1 + 1e-9) + slack
        best = met.groupBy("person").agg(F.count("*").alias("n"), F.min("score").alias("floor"), F.max_by("kind", "rank").alias("last"))
        # Of equal scores the smaller job counts, so what is left must score more unless all its jobs come later.
        settled = (F.col("n") >= limit) & ((F.col("floor") > most) | ((F.col("floor") >= most) & (F.col("last") < F.lit(bounds["next"]))))
        left = open_.drop("floor").join(best, "person", "left")
        left = left.where(~F.coalesce(settled, F.lit(False))).select("person", "own", "has", "held", F.when(F.col("n") >= limit, F.col("floor")).otherwise(0.0).alias("floor"))
        open_ = settle(left)
        done.append(met.join(open_.select("person"), "person", "left_anti"))
        if open_.isEmpty():
            break
        found, size = met.join(open_.select("person"), "person", "left_semi").drop("rank"), 4 * size
    kinds = functools.reduce(DataFrame.unionByName, [d.drop("rank") for d in done])
    each = kinds.join(asked.select("kind", "job_id"), "kind")
    nth = F.row_number().over(Window.partitionBy("person").orderBy(F.desc("score"), "job_id"))
    each = each.withColumn("nth", nth).where(F.col("nth") <= limit)
    return each.join(members, "person").select("candidate_id", "job_id", "matched", "score")


def _ranked_kinds(scores: DataFrame, limit: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("person").orderBy(F.desc("score"), "kind"))
    return scores.withColumn("rank", nth).where(F.col("rank") <= limit)


def _met(jobs: DataFrame, candidates: DataFrame, limit: int, digits: int | None, job_block: int, candidate_block: int) -> DataFrame:
    """(person, kind, matched, score): of each block of ``jobs`` the ``limit`` best of every candidate that reach its ``floor``."""
    n_jobs, people = max(1, -(-jobs.count() // job_block)), candidates.count()
    # Each block of candidates gets the jobs, so there are few blocks, but enough for all cores.
    busy = 2 * jobs.sparkSession.sparkContext.defaultParallelism // n_jobs
    n_candidates = max(1, -(-people // candidate_block), min(-(-people // 1_024), busy))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = jobs.select("kind", "norm", "asks", "u", dealt("kind", n_jobs).alias("jb"), all_of(n_candidates).alias("cb"))
    right = candidates.select("person", "own", "has", "held", "floor", dealt("person", n_candidates).alias("cb"), all_of(n_jobs).alias("jb"))

    def run(jobs: pa.Table, candidates: pa.Table) -> pa.Table:
        columns = _best_of_blocks(jobs.combine_chunks(), candidates.combine_chunks(), limit, digits)
        return pa.table(columns, names=["person", "kind", "matched", "score"])

    kind = lambda df, c: f"{c} {df.schema[c].dataType.simpleString()}"
    schema = f"{kind(candidates, 'person')}, {kind(jobs, 'kind')}, matched long, score double"
    return left.groupBy("cb", "jb").cogroup(right.groupBy("cb", "jb")).applyInArrow(run, schema)


def _best_of_blocks(jobs: pa.Table, candidates: pa.Table, limit: int, digits: int | None, rows: int = 128, longest: int = 2_048) -> list:
    """The columns of ``_met`` for one block of jobs and one of candidates.

    Jobs are gone through from the greatest bound, some candidates by some jobs at a time. A set of concepts is also a mask of
    64 bits, each for one concept or several; a bit that a job has and a candidate hasn't is a concept that is missing, so
    the bits that are missing and a job's least weight tell what it scores at most. Only pairs that can be among the
    ``limit`` best by that are added up, concept by concept.
    """
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if jobs.num_rows and candidates.num_rows:
        order = pc.sort_indices(jobs.column("kind")).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        flat = lambda t, c: t.column(c).combine_chunks()
        norm, asks, u = jobs.column("norm").to_numpy(), flat(jobs, "asks"), flat(jobs, "u").flatten().to_numpy()
        n = asks.value_lengths().to_numpy().astype(np.int64)
        begins = np.cumsum(n) - n
        most, least = np.add.reduceat(u, begins), np.minimum.reduceat(u, begins)
        concepts = asks.flatten().dictionary_encode()
        codes, known = concepts.indices.to_numpy(), len(concepts.dictionary)
        bit = lambda c: np.left_shift(np.uint64(1), (c % 64).astype(np.uint64))
        mask = np.bitwise_or.reduceat(bit(codes), begins)
        by = np.lexsort((place, -(most / norm)))
        norm, n, begins, most, least, mask, place = (x[by] for x in (norm, n, begins, most, least, mask, place))
        bound = most / norm
        room, cost = (most / least).astype(np.float32), (norm / least).astype(np.float32)
        # Of the jobs from one on: the least norm and the first in the order of ids.
        tail = lambda x: np.minimum.accumulate(x[::-1])[::-1]
        norm_left, place_left = tail(norm), tail(place)
        slack = 0.0 if digits is None else 0.5 * 10.0**-digits + 1e-9

        mine = flat(candidates, "held")
        own, has, floor = (candidates.column(c).to_numpy() for c in ("own", "has", "floor"))
        wanted = pc.index_in(mine.flatten(), value_set=concepts.dictionary).fill_null(-1).to_numpy().astype(np.int64)
        who = np.repeat(np.arange(len(own)), mine.value_lengths().to_numpy())
        who, wanted = who[wanted >= 0], wanted[wanted >= 0]
        alike = np.argsort(-own, kind="stable")
        rows = max(1, min(rows, (1 << 24) // known))
        at = np.empty(len(own), np.int64)
        at[alike] = np.arange(len(own))
        who = at[who]
        sort = np.argsort(who, kind="stable")
        who, wanted = who[sort], wanted[sort]
        for first in range(0, len(own), rows):
            ids = alike[first : first + rows]
            a, b = np.searchsorted(who, [first, first + len(ids)])
            held = np.zeros((len(ids), known), bool)
            held[who[a:b] - first, wanted[a:b]] = True
            seen = np.zeros(len(ids), np.uint64)
            np.bitwise_or.at(seen, who[a:b] - first, bit(wanted[a:b]))
            absent, own_, has_, least_, last = ~seen, own[ids], has[ids], floor[ids].copy(), np.full(len(ids), len(norm))
            top = [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
            j, step = 0, 64
            while j < len(norm):
                reach = np.minimum(bound[j], has_ / norm_left[j]) / own_ * (1 + 1e-9) + slack
                # Of equal scores the smaller job counts.
                on = np.flatnonzero((reach > least_) | ((reach >= least_) & (place_left[j] < last)))
                if not len(on):
                    break
                k = slice(j, j + step)
                missing = np.bitwise_count(mask[k] & absent[on, None])
                may = ((least_[on] - slack) * own_[on]).astype(np.float32)
                r, c = np.nonzero(missing <= room[k] * np.float32(1 + 1e-5) + np.float32(1e-4) - may[:, None] * (cost[k] * np.float32(1 - 1e-5)))
                j, step, r, c = j + step, min(4 * step, longest), on[r], c + j
                if not len(r):
                    continue
                ends = np.cumsum(n[c])
                asked = np.repeat(begins[c] - ends + n[c], n[c]) + np.arange(ends[-1])
                has_it = held[np.repeat(r, n[c]), codes[asked]]
                starts = ends - n[c]
                matched = np.add.reduceat(has_it.astype(np.int64), starts)
                score = np.add.reduceat(np.where(has_it, u[asked], 0.0), starts) / (norm[c] * own_[r])
                score = score if digits is None else np.round(score, digits)
                good = (matched > 0) & (score >= least_[r])
                top = [np.concatenate([x, y[good]]) for x, y in zip(top, (r, c, matched, score), strict=True)]
                by_score = np.lexsort((place[top[1]], -top[3], top[0]))
                top = [x[by_score] for x in top]
                opens = np.searchsorted(top[0], np.arange(len(ids) + 1))
                nth = np.arange(len(top[0])) - opens[top[0]]
                top = [x[nth < limit] for x in top]
                full = np.flatnonzero(np.diff(opens) >= limit)
                ends = np.cumsum(np.minimum(np.diff(opens), limit))[full] - 1
                least_[full], last[full] = top[3][ends], place[top[1][ends]]
            best.append((ids[top[0]], by[top[1]], top[2], top[3]))
    person, kind, matched, score = (np.concatenate(x) for x in zip(*best, strict=True))
    return [candidates.column("person").take(pa.array(person)), jobs.column("kind").take(pa.array(kind)), pa.array(matched), pa.array(score)]


def coverage_topk(job_skills: DataFrame, candidate_skills: DataFrame, limit: int = 50) -> DataFrame:
    """``ranked(coverage(...), limit)``, without a row for each pair that shares a concept."""
    able = candidate_skills.groupBy("candidate_id").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_CONCEPTS)
    required = job_skills.groupBy("job_id").agg(F.count("*").alias("required"))
    weights = job_skills.select("concept", F.lit(1.0).alias("u")).distinct()
    norms = required.select("job_id", F.col("required").cast("double").alias("norm")), able.select("candidate_id", F.lit(1.0).alias("own"))
    return ranked(best_pairs(job_skills, candidate_skills, weights, norms, limit).join(required, "job_id"), limit)


def cosine_topk(job_skills: DataFrame, candidate_skills: DataFrame, limit: int = 50, digits: int = 6) -> DataFrame:
    """``ranked(tfidf_cosine(...), limit)`` by scores rounded to ``digits``, as sums differ in their last bits."""
    weights = settle(idf(job_skills).select("concept", (F.col("weight") * F.col("weight")).alias("u")))
    return ranked(best_pairs(job_skills, candidate_skills, weights, None, limit, digits), limit)


def coverage(job_skills: DataFrame, candidate_skills: DataFrame) -> DataFrame:
    """(candidate_id, job_id, matched, required, score): the share of a job's concepts that a candidate has.

    Only pairs that share a concept; only candidates with three concepts or more. Both sides meet on the concept, so
    the join's rows are the matches that are counted.
    """
    able = candidate_skills.groupBy("candidate_id").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_CONCEPTS)
    has = candidate_skills.join(able.select("candidate_id"), "candidate_id", "left_semi")
    required = job_skills.groupBy("job_id").agg(F.count("*").alias("required"))
    matched = has.join(job_skills, "concept").groupBy("candidate_id", "job_id").agg(F.count("*").alias("matched"))
    return matched.join(required, "job_id").withColumn("score", F.col("matched") / F.col("required"))


def explained(scores: DataFrame, job_skills: DataFrame, candidate_skills: DataFrame) -> DataFrame:
    """``scores`` with the matched and the missing concepts of each pair, sorted."""
    asks = job_skills.groupBy("job_id").agg(F.collect_set("concept").alias("asked"))
    has = candidate_skills.groupBy("candidate_id").agg(F.collect_set("concept").alias("held"))
    both = scores.join(asks, "job_id").join(has, "candidate_id")
    return (
        both.withColumn("matched_concepts", F.array_sort(F.array_intersect("asked", "held")))
        .withColumn("missing_concepts", F.array_sort(F.array_except("asked", "held")))
        .drop("asked", "held")
    )


def ranked(scores: DataFrame, limit: int = 50) -> DataFrame:
    """The ``limit`` best jobs of each candidate, ties by job id, with their rank."""
    nth = F.row_number().over(Window.partitionBy("candidate_id").orderBy(F.desc("score"), "job_id"))
    return scores.withColumn("rank", nth).where(F.col("rank") <= limit)


def idf(job_skills: DataFrame) -> DataFrame:
    """(concept, df, weight): ln((1 + N) / (1 + df)) + 1 over the jobs that name a concept."""
    total = job_skills.select("job_id").distinct().count()
    counted = job_skills.groupBy("concept").agg(F.count("*").alias("df"))
    return counted.select("concept", "df", (F.log(F.lit(1.0 + total) / (1 + F.col("df"))) + 1).alias("weight"))


def tfidf_cosine(job_skills: DataFrame, candidate_skills: DataFrame) -> DataFrame:
    """(candidate_id, job_id, score): cosine of binary term vectors under ``idf``; unseen concepts weigh nothing."""
    weights = idf(job_skills).select("concept", (F.col("weight") * F.col("weight")).alias("w2"))
    j = job_skills.join(weights, "concept")
    c = candidate_skills.join(weights, "concept")
    jn = j.groupBy("job_id").agg(F.sum("w2").alias("jn"))
    cn = c.groupBy("candidate_id").agg(F.sum("w2").alias("cn"))
    dot = c.join(job_skills, "concept").groupBy("candidate_id", "job_id").agg(F.sum("w2").alias("dot"))
    return (
        dot.join(jn, "job_id").join(cn, "candidate_id")
        .select("candidate_id", "job_id", (F.col("dot") / (F.sqrt("jn") * F.sqrt("cn"))).alias("score"))
    )


def ndcg(ranking: DataFrame, grades: DataFrame, k: int = 5) -> DataFrame:
    """(query, dcg, ideal, ndcg, precision_at_1) from (query, item, score) and (query, item, grade).

    Gain is the grade, discount log2(rank + 1); the ideal ranks all graded items. No relevant item gives 0.
    """
    joined = grades.join(ranking, ["query", "item"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    by_score = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item"))
    by_grade = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "item"))
    placed = joined.withColumn("at", by_score).withColumn("best", by_grade)
    gain = lambda at: F.sum(F.when(F.col(at) <= k, F.col("grade") / F.log2(F.col(at) + 1)).otherwise(0.0))
    out = placed.groupBy("query").agg(
        gain("at").alias("dcg"), gain("best").alias("ideal"),
        F.max(F.when((F.col("at") == 1) & (F.col("grade") > 0), 1.0).otherwise(0.0)).alias("precision_at_1"),
    )
    return out.withColumn("ndcg", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0))


def explanation_summary(top: DataFrame) -> DataFrame:
    """(explanations_shown, mean_skills, share_naming_a_match) of ranked pairs (matched, required, score): those with a score
    above 0 are shown. Without any, the mean and the share are 0."""
    shown = top.where("score > 0")
    told = shown.agg(F.count("*").alias("explanations_shown"), F.avg("required").alias("m"), F.avg((F.col("matched") > 0).cast("int")).alias("s"))
    return told.select("explanations_shown", F.coalesce("m", F.lit(0.0)).alias("mean_skills"), F.coalesce("s", F.lit(0.0)).alias("share_naming_a_match"))

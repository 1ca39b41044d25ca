"""Measuring the catalogue: manifests, samples, span scores, bootstrap intervals, audits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def manifest(postings: DataFrame) -> DataFrame:
    """(source, postings, characters, shortest, longest, digest) per source.

    The digest doesn't depend on row order: row hashes are summed modulo 2**64 per source, so no row list is gathered.
    """
    row = F.conv(F.substring(F.md5(F.concat_ws("\x1f", F.col("id").cast("string"), "description")), 1, 8), 16, 10).cast("long")
    return postings.groupBy("source").agg(
        F.count("*").alias("postings"),
        F.sum(F.length("description")).alias("characters"),
        F.min(F.length("description")).cast("long").alias("shortest"),
        F.max(F.length("description")).cast("long").alias("longest"),
        F.sum(row).alias("digest"),
    )


def full_manifest(jobs: DataFrame, records: DataFrame, largest: int = 30) -> DataFrame:
    """(kind, name, value) of a whole corpus: its counts by source, board and employer, its dates, and a digest.

    ``jobs`` has (id, employer, published_at, description), ``records`` (job_id, source_key, source_job_id, board), one row
    an account of a job; board is null where a source has none. Kinds: ``source`` and ``board`` count accounts, ``employer``
    counts jobs of the ``largest`` employers (ties by name), ``total`` has jobs, employers, jobs_with_two_sources,
    without_a_date, earliest, latest and digest. The digest adds up the rows' hashes, so partial sums merge in any order
    and no list of rows is gathered. An empty corpus has its totals, 0 or null.
    """
    counts = records.groupingSets([["source_key"], ["board"]], "source_key", "board").agg(F.grouping("source_key").alias("g"), F.count("*").alias("n"))
    name = F.when(F.col("g") == 0, F.col("source_key")).otherwise(F.col("board"))
    by = counts.select(F.when(F.col("g") == 0, "source").otherwise("board").alias("kind"), name.alias("name"), F.col("n").cast("string").alias("value")).where("name is not null")
    employers = jobs.groupBy("employer").agg(F.count("*").alias("n"))
    top = employers.orderBy(F.desc("n"), "employer").limit(largest).select(F.lit("employer").alias("kind"), F.col("employer").alias("name"), F.col("n").cast("string").alias("value"))
    part = lambda c: F.conv(F.substring(F.md5(c.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    of_jobs = part(F.coalesce("description", F.lit("")))
    of_records = part(F.concat_ws(":", "source_key", F.col("source_job_id").cast("string")))
    n_sources = records.groupBy("job_id").agg(F.count_distinct("source_key").alias("k"))
    a = jobs.agg(
        F.count("*").alias("jobs"), F.count_if(F.col("published_at").isNull()).alias("without_a_date"), F.min("published_at").alias("earliest"),
        F.max("published_at").alias("latest"), F.coalesce(F.sum(of_jobs), F.lit(0)).alias("d1"),
    )
    b = records.agg(F.coalesce(F.sum(of_records), F.lit(0)).alias("d2"))
    c = n_sources.agg(F.count_if(F.col("k") > 1).alias("jobs_with_two_sources"))
    d = employers.where("employer is not null").agg(F.count("*").alias("employers"))
    whole = a.join(b).join(c).join(d).withColumn("digest", (F.col("d1") + F.col("d2")).cast("decimal(38,0)"))
    names = ("jobs", "employers", "jobs_with_two_sources", "without_a_date", "earliest", "latest", "digest")
    totals = F.explode(F.array(*[F.struct(F.lit("total").alias("kind"), F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names]))
    return by.unionByName(top).unionByName(whole.select(totals.alias("x")).select("x.*"))


def largest_remainder(sizes: DataFrame, total: int) -> DataFrame:
    """(stratum, size, quota): ``total`` shared in proportion by largest remainders, at least 1 a stratum.

    Strata are few; remainders are ranked among them.
    """
    all_rows = sizes.agg(F.sum("size")).first()[0] or 1
    exact = F.col("size") * F.lit(float(total)) / F.lit(float(all_rows))
    floors = sizes.withColumn("base", F.floor(exact).cast("long")).withColumn("rest", exact - F.floor(exact))
    left = total - (floors.agg(F.sum("base")).first()[0] or 0)
    nth = F.row_number().over(Window.orderBy(F.desc("rest"), "stratum"))
    quota = F.greatest(F.col("base") + F.when(F.col("nth") <= left, 1).otherwise(0), F.lit(1))
    return floors.withColumn("nth", nth).select("stratum", "size", quota.alias("quota"))


def stratified_sample(rows: DataFrame, quotas: DataFrame, seed: str = "sample") -> DataFrame:
    """Each stratum's quota of rows, in the order of a seeded hash of their ids."""
    nth = F.row_number().over(Window.partitionBy("stratum").orderBy(F.md5(F.concat(F.lit(seed + ":"), F.col("id").cast("string"))), "id"))
    return rows.join(quotas.select("stratum", "quota"), "stratum").withColumn("_nth", nth).where(F.col("_nth") <= F.col("quota")).drop("_nth", "quota")


def contexts(mentions: DataFrame, per_form: int = 8, around: int = 60) -> DataFrame:
    """At most ``per_form`` contexts of a form, one an employer, in a fixed random order."""
    seeded = F.xxhash64("surface_form", "employer", "id", "start")
    one = F.row_number().over(Window.partitionBy("surface_form", "employer").orderBy(seeded))
    some = F.row_number().over(Window.partitionBy("surface_form").orderBy(seeded))
    picked = mentions.withColumn("_one", one).where("_one = 1").withColumn("_some", some).where(F.col("_some") <= per_form)
    begin = F.greatest(F.col("start") - around, F.lit(0))
    text = F.substr(F.col("text"), begin + 1, F.col("end") + around - begin)
    return picked.select("surface_form", "employer", "id", text.alias("context"))


BUCKET = 256  # characters of a position bucket; any width gives the same result


def in_buckets(spans: DataFrame, *more: str) -> DataFrame:
    """Distinct spans with ``n``, how often each stands there, once for each bucket of positions that they reach into."""
    last = F.greatest(F.col("end") - 1, F.col("start"))
    at = F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor(last / BUCKET)))
    return spans.groupBy("posting", "start", "end", *more).agg(F.count("*").alias("n")).withColumn("bucket", at)


def touching(spans: DataFrame, others: DataFrame) -> DataFrame:
    """Those of ``in_buckets``'s spans that overlap one of the others, each once: they meet on posting and bucket."""
    meet = (F.col("a.posting") == F.col("b.posting")) & (F.col("a.bucket") == F.col("b.bucket"))
    overlap = (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    hit = spans.alias("a").join(others.alias("b"), meet & overlap, "left_semi")
    return hit.select([c for c in spans.columns if c != "bucket"]).distinct()


def span_scores(gold: DataFrame, found: DataFrame) -> DataFrame:
    """(posting, gold, hit, found, right): gold spans that a found span overlaps, and found spans that overlap gold.

    Spans (posting, start, end) meet in buckets of positions, so a long posting doesn't compare all with all. Repeated
    spans count one by one; a span that ends where it starts overlaps what holds that place inside. Null posting: no row.
    """
    g, f = in_buckets(gold), in_buckets(found)
    total = lambda df, name: df.groupBy("posting").agg(F.sum("n").alias(name))
    count = lambda df, name: df.where("posting is not null").groupBy("posting").agg(F.count("*").alias(name))
    out = count(gold, "gold").join(count(found, "found"), "posting", "full_outer")
    out = out.join(total(touching(g, f), "hit"), "posting", "left").join(total(touching(f, g), "right"), "posting", "left")
    return out.select("posting", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("gold", "hit", "found", "right")])


def gold_tail(gold: DataFrame, *arms: DataFrame) -> DataFrame:
    """The gold spans (posting, start, end, category) that no arm's spans overlap."""
    spans = in_buckets(gold, "category")
    every = arms[0].select("posting", "start", "end")
    for arm in arms[1:]:
        every = every.union(arm.select("posting", "start", "end"))
    found = touching(spans, in_buckets(every))
    keys = ["posting", "start", "end"]
    return gold.join(found.select(*keys).distinct(), keys, "left_anti")


def short_token_precision(gold: DataFrame, found: DataFrame, longest: int = 3) -> DataFrame:
    """(short, right, precision) of the found spans whose ``term`` has ``longest`` characters at most; null without any."""
    short = in_buckets(found.where(F.length("term") <= longest))
    right = touching(short, in_buckets(gold)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("right"))
    all_ = found.where(F.length("term") <= longest).agg(F.count("*").alias("short"))
    return all_.join(right).select("short", "right", (F.col("right") / F.nullif(F.col("short"), F.lit(0))).alias("precision"))


def precision_recall(scores: DataFrame) -> DataFrame:
    return scores.agg(
        (F.sum("hit") / F.nullif(F.sum("gold"), F.lit(0))).alias("recall"),
        (F.sum("right") / F.nullif(F.sum("found"), F.lit(0))).alias("precision"),
    )


# The draws of the bootstrap: a polynomial over the round, whose coefficients are a posting's digest, modulo this prime.
PRIME = 2**31 - 1


def poisson_steps(most: int = 10) -> list[int]:
    """From which draw on a posting counts once, twice, and so on, under a Poisson law of mean 1."""
    steps, tail, mass = [], 0.0, math.exp(-1)
    for k in range(most):
        tail += mass
        steps.append(math.ceil(tail * PRIME))
        mass /= k + 1
    return steps


def bootstrap(
    scores: DataFrame, ratios: dict[str, tuple[str, str]], pairs: list[tuple[str, str]] = (), rounds: int = 10_000, level: float = 0.95, seed: int = 20260823
) -> DataFrame:
    """(name, estimate, low, high, design_effect) of each ratio of sums, and of the difference of each pair of ratios.

    Whole postings are resampled: in each round a posting counts as often as a Poisson draw of its own says, the same one
    for all ratios, so differences are paired. A task adds up its postings as one vector of ``rounds`` sums a column, and
    only these vectors meet: what is shuffled doesn't depend on the postings. The design effect is the variance that the
    interval implies by that of independent draws; 1 where the latter is 0, null for differences.

    Defined cases: ``scores`` has one row a posting and whole numbers; nulls count 0, and postings that are null are one.
    A round whose denominator is 0 is left out for a ratio; no rows give no rounds, and an estimate of null.
    """
    columns = sorted({c for r in ratios.values() for c in r})
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("posting").cast("string"), F.lit(""))).cast("binary"))
    parts = [(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") % PRIME).alias(f"_{k}") for k in range(3)]
    told = scores.select(*parts, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in columns])
    steps = np.array(poisson_steps(), np.int64)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = np.arange(1, rounds + 1, dtype=np.int64)
        total = np.zeros((len(columns), rounds), np.int64)
        for batch in batches:
            a, b, c, *values = (batch.column(k).to_numpy() for k in range(3 + len(columns)))
            for k in range(batch.num_rows):
                draw = (a[k] + b[k] * nth % PRIME + c[k] * (nth * nth % PRIME) % PRIME) % PRIME
                times = np.searchsorted(steps, draw, side="right")
                for j, v in enumerate(values):
                    if v[k]:
                        total[j] += times * v[k]
        yield pa.RecordBatch.from_arrays([pa.array(nth), *map(pa.array, total)], names=["round", *columns])

    each = told.mapInArrow(sums, ", ".join(f"{c} long" for c in ("round", *columns)))
    merged = each.groupBy("round").agg(*[F.sum(c).alias(c) for c in columns])
    ratio = lambda r: F.col(r[0]) / F.nullif(F.col(r[1]), F.lit(0))
    facts = lambda values: F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value"), s.alias("size")) for n, v, s in values]))
    named = [(n, ratio(r), F.col(r[1])) for n, r in ratios.items()]
    named += [(f"{a} minus {b}", ratio(ratios[a]) - ratio(ratios[b]), F.lit(None).cast("long")) for a, b in pairs]
    drawn = merged.select(facts(named).alias("x")).select("x.name", "x.value").where("value is not null")
    whole = told.agg(*[F.sum(c).alias(c) for c in columns]).select(facts(named).alias("x")).select("x.name", F.col("x.value").alias("estimate"), "x.size")
    edge, by_name = (1 - level) / 2, Window.partitionBy("name")
    placed = drawn.withColumn("nth", F.row_number().over(by_name.orderBy("value"))).withColumn("of", F.count("*").over(by_name))
    at = lambda n: F.max(F.when(F.col("nth") == n, F.col("value")))
    low, high = at(F.floor(F.col("of") * edge) + 1), at(F.greatest(F.floor(F.col("of") * (1 - edge)), F.lit(1)))
    interval = placed.groupBy("name").agg(low.alias("low"), high.alias("high"))
    naive = F.col("estimate") * (1 - F.col("estimate")) / F.col("size")
    spread = F.pow((F.col("high") - F.col("low")) / 3.92, 2)
    effect = F.when(F.col("size").isNull(), None).when(naive > 0, spread / naive).otherwise(1.0)
    return whole.join(interval, "name", "left").select("name", "estimate", "low", "high", effect.alias("design_effect"))


def form_audit(mentions: DataFrame) -> DataFrame:
    """(form, mentions, postings, employers, employer_rate) of (form, id, employer)."""
    employers = mentions.select("employer").distinct().count()
    return mentions.groupBy("form").agg(
        F.count("*").alias("mentions"), F.countDistinct("id").alias("postings"), F.countDistinct("employer").alias("employers")
    ).withColumn("employer_rate", F.col("employers") / F.lit(float(max(employers, 1))))


def language_mix(postings: DataFrame) -> DataFrame:
    """(source, lang, postings, share)."""
    counts = postings.groupBy("source", "lang").agg(F.count("*").alias("postings"))
    return counts.withColumn("share", F.col("postings") / F.sum("postings").over(Window.partitionBy("source")))

"""Offline halves of discovery: slugs, whose board it is, websites from postings, what is due."""

from __future__ import annotations

import unicodedata
from datetime import datetime, timedelta
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from jobloom.functions.text import hosts, normal_text
from jobloom.session import settle

OUTCOMES = ["confirmed", "unverifiable", "wrong_company", "unreachable", "not_found"]
RECHECK_DAYS = 90

# Hosts that postings name but that are never an employer's own, with all below them.
PLATFORM_HOSTS = (
    "greenhouse.io", "polymer.co", "pinpointhq.com", "arbeitnow.com", "lever.co", "ashbyhq.com", "workable.com", "recruitee.com", "personio.de", "smartrecruiters.com",
    "linkedin.com", "twitter.com", "x.com", "facebook.com", "instagram.com", "youtube.com", "glassdoor.com", "indeed.com", "google.com", "googleapis.com", "gstatic.com",
    "amazonaws.com", "cloudfront.net", "notion.site", "github.com", "wikipedia.org", "w3.org", "schema.org",
)

# Legal forms that end a name, and the punctuation that may stand round them.
LEGAL_SUFFIXES = [
    "gmbh & co kg", "gmbh", "ag", "se", "ug", "kg", "ohg", "inc", "llc", "ltd", "limited", "plc", "bv", "nv", "sa", "srl", "oy", "ab", "as",
]
TRAILING = r"[ \t.,;:-]+$"
LONGEST_SLUG = 63


@F.pandas_udf(StringType())
def ascii_text(values: pd.Series) -> pd.Series:
    """Accented letters as their base letters, other characters outside ASCII dropped; null stays null."""
    return values.map(lambda v: unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode(), na_action="ignore")


def core_name(name: Column) -> Column:
    """A name in normal text without the legal form at its end; empty for a null or blank one."""
    plain = F.regexp_replace(F.coalesce(normal_text(name), F.lit("")), TRAILING, "")
    return F.regexp_replace(F.regexp_replace(plain, f" (?:{'|'.join(LEGAL_SUFFIXES)})$", ""), TRAILING, "")


def candidate_slugs(name: Column) -> Column:
    """Up to three ordered guesses at a board's address: letters and digits joined, hyphenated, and the first word alone.

    Accents fold to their letters before anything is split; a guess left empty or longer than a host's label is none.
    """
    words = F.trim(F.regexp_replace(ascii_text(core_name(name)), r"\s+", " "))
    hyphenated = F.regexp_replace(words, "[^a-z0-9]+", "-")
    first = F.regexp_replace(F.substring_index(words, " ", 1), "[^a-z0-9-]+", "")
    tidy = lambda g: F.regexp_replace(F.regexp_replace(g, "-{2,}", "-"), "^-+|-+$", "")
    guesses = F.transform(F.array(F.regexp_replace(words, "[^a-z0-9]+", ""), hyphenated, first), tidy)
    return F.array_distinct(F.filter(guesses, lambda g: (g != "") & (F.length(g) <= LONGEST_SLUG)))


def belongs_to(found: Column, expected: Column) -> Column:
    """Whether two names have the same letters and digits before their legal forms."""
    letters = lambda n: F.regexp_replace(core_name(n), "[^a-z0-9]+", "")
    return letters(found) == letters(expected)


def discover(companies: DataFrame, boards: DataFrame) -> DataFrame:
    """(company, slug, outcome): the first slug that is confirmed, else the outcome that says most.

    ``boards`` has (slug, reachable, stated_company): what a visit to each slug gave. A board that states no company
    can't be verified and ends the search there; a wrong company says more than an unreachable board.
    """
    tries = companies.select(F.col("name").alias("company"), F.posexplode(candidate_slugs(F.col("name"))).alias("nth", "slug"))
    seen = tries.join(boards, "slug", "left")
    outcome = (
        F.when(F.col("reachable").isNull(), "not_found")
        .when(~F.col("reachable"), "unreachable")
        .when(F.col("stated_company").isNull(), "unverifiable")
        .when(belongs_to(F.col("stated_company"), F.col("company")), "confirmed")
        .otherwise("wrong_company")
    )
    judged = seen.withColumn("outcome", outcome)
    ends = F.col("outcome").isin("confirmed", "unverifiable")
    order = F.when(ends, F.struct(F.lit(0).alias("a"), F.col("nth").alias("b"))).otherwise(
        F.struct(F.lit(1).alias("a"), (F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col("outcome")).cast("int") * 100 + F.col("nth")).alias("b"))
    )
    best = judged.groupBy("company").agg(F.min_by(F.struct("slug", "outcome"), order).alias("x"))
    named = F.when(F.col("x.outcome") != "not_found", F.col("x.slug"))
    found = best.select("company", named.alias("slug"), F.col("x.outcome").alias("outcome"))
    return companies.select(F.col("name").alias("company")).distinct().join(found, "company", "left").select(
        "company", "slug", F.coalesce("outcome", F.lit("not_found")).alias("outcome")
    )


def host_votes(payloads: DataFrame) -> DataFrame:
    """(company, host, votes) of (company, hosts): a payload votes once for each host it names."""
    return payloads.select("company", F.explode(F.array_distinct("hosts")).alias("host")).groupBy("company", "host").agg(F.count("*").alias("votes"))


def top_host(votes: DataFrame, least: int = 2) -> DataFrame:
    """(company, host): the single most voted host with ``least`` votes; a tie names none."""
    nth = F.rank().over(Window.partitionBy("company").orderBy(F.desc("votes")))
    best = votes.withColumn("_r", nth).where("_r = 1").groupBy("company").agg(F.count("*").alias("n"), F.min("host").alias("host"), F.max("votes").alias("votes"))
    return best.where((F.col("n") == 1) & (F.col("votes") >= least)).select("company", "host", "votes")


def without_website(companies: DataFrame, now: datetime) -> DataFrame:
    """Companies without a website that weren't checked for 90 days."""
    cutoff = F.lit(now - timedelta(days=RECHECK_DAYS)).cast("timestamp_ntz")
    return companies.where(F.col("website_url").isNull() & (F.col("website_checked_at").isNull() | (F.col("website_checked_at") < cutoff)))


def due_for_website(companies: DataFrame, job_counts: DataFrame, now: datetime, budget: int) -> DataFrame:
    """Companies whose website is to be looked for: most jobs first, then by name, ``budget`` of them."""
    counted = without_website(companies, now).join(job_counts, "company_id", "left").withColumn("job_count", F.coalesce("job_count", F.lit(0)))
    return counted.orderBy(F.desc("job_count"), "display_name", "company_id").limit(budget)


def resolve_websites(
    companies: DataFrame, job_counts: DataFrame, payloads: DataFrame, entities: DataFrame, now: datetime, budget: int = 100
) -> tuple[DataFrame, DataFrame]:
    """(companies after the run, its one-row summary): ``budget`` due companies, each by its postings, else by public entities.

    ``companies`` has (company_id, display_name, website_url, website_source, website_checked_at), ``payloads`` (company_id,
    payload) the text of stored postings, and ``entities`` (company_id, label, business, website) what a search for a
    company's name gave. The host that most postings name is the website, if two or more do and no other as many. Of the
    entities, a business whose label is the company's name and that states a website counts, if it is the only one. Every
    company looked at is marked as checked then. The summary has seeded (all due), processed, postings, wikidata, unresolved
    and stopped_at_budget.

    Defined cases: null payloads name nothing; null labels, a null ``business`` and blank websites don't count; repeated
    entities are several; empty tables give a summary of zeros. Only the looked-at companies' payloads are searched.
    """
    due = settle(due_for_website(companies, job_counts, now, budget).select("company_id", "display_name"))
    ids = due.select("company_id")
    named = payloads.join(ids, "company_id", "left_semi").select(F.col("company_id").alias("company"), hosts(F.col("payload"), PLATFORM_HOSTS).alias("hosts"))
    voted = top_host(host_votes(named)).select(F.col("company").alias("company_id"), F.concat(F.lit("https://"), "host", F.lit("/")).alias("by_postings"))
    stated = entities.where(F.col("business") & (F.trim("website") != "")).join(due, "company_id")
    alike = stated.where(belongs_to(F.col("label"), F.col("display_name")) & F.col("label").isNotNull())
    only = alike.groupBy("company_id").agg(F.count("*").alias("n"), F.min("website").alias("by_entity")).where("n = 1").drop("n")
    found = settle(
        ids.join(voted, "company_id", "left").join(only, "company_id", "left").select(
            "company_id", F.coalesce("by_postings", "by_entity").alias("found"),
            F.when(F.col("by_postings").isNotNull(), "postings").when(F.col("by_entity").isNotNull(), "wikidata").alias("how"), F.lit(True).alias("looked_at"),
        )
    )
    checked = F.when(F.col("looked_at"), F.lit(now).cast("timestamp_ntz")).otherwise(F.col("website_checked_at"))
    after = companies.join(found, "company_id", "left").select(
        "company_id", "display_name", F.coalesce("website_url", "found").alias("website_url"), F.coalesce("how", "website_source").alias("website_source"),
        checked.alias("website_checked_at"),
    )
    n, how = F.count_if, F.col("how")
    seen = found.select(F.lit(True).alias("seen"), "how").unionByName(without_website(companies, now).select(F.lit(False).alias("seen"), F.lit(None).cast("string").alias("how")))
    tally = seen.agg(
        n(~F.col("seen")).alias("seeded"), n("seen").alias("processed"), n(how == "postings").alias("postings"), n(how == "wikidata").alias("wikidata"),
        n(F.col("seen") & how.isNull()).alias("unresolved"),
    )
    return after, tally.withColumn("stopped_at_budget", F.col("seeded") > F.col("processed"))


def due_for_discovery(companies: DataFrame, boards: DataFrame, now: datetime, days: dict[str, int]) -> DataFrame:
    """Companies to look for again: no board yet, or no settled one and every board past its status's recheck time."""
    age = F.create_map(*[F.lit(x) for kv in days.items() for x in kv])
    stale = F.col("last_checked_at") + F.make_interval(days=F.coalesce(F.try_element_at(age, F.col("status")), F.lit(0))) < F.lit(now).cast("timestamp_ntz")
    settled = F.col("pinned") | F.col("status").isin("confirmed", "named", "blocked")
    per = boards.groupBy("company_id").agg(F.some(settled).alias("settled"), F.every(F.coalesce(stale, F.lit(True))).alias("stale"))
    joined = companies.join(per, "company_id", "left")
    return joined.where(F.col("settled").isNull() | (~F.col("settled") & F.col("stale"))).drop("settled", "stale")


def polled_boards(boards: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Slugs of a source to poll, in order: confirmed, named or pinned ones, none that is blocked."""
    of_source = boards.join(sources.where(F.col("key") == key).select("source_id").limit(1), "source_id", "left_semi")
    wanted = (F.col("status").isin("confirmed", "named") | F.col("pinned")) & (F.col("status") != "blocked")
    return of_source.where(wanted).select("slug").orderBy("slug")


def taxonomy_reach(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth): everything below the roots of (parent, child) edges, at its least depth, a level a round.

    Rounds go on until one finds nothing new; cycles end there too.
    """
    known = settle(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = known
    for depth in count(1):
        below = frontier.join(edges, F.col("node") == F.col("parent")).select(F.col("child").alias("node")).distinct()
        frontier = settle(below.join(known.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        known = settle(known.unionByName(frontier))
    return known

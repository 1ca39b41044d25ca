"""Candidate profiles: who is ready to be matched, and the search for concepts to add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a complete profile may state, at least one of each.
WORKPLACES = ["remote", "hybrid", "onsite"]
EMPLOYMENTS = ["full-time", "part-time", "contract", "internship", "temporary"]
# Skills that a profile needs before it is matched, and hits that a concept search shows.
USABLE_SKILLS, SEARCH_HITS = 1, 10


def complete(name: Column, location: Column, workplaces: Column, employments: Column) -> Column:
    """Whether a profile has a name, a place, and one known workplace and employment at least; never null."""
    told = lambda c: F.trim(c) != ""
    some = lambda c, known: F.size(F.array_intersect(c, F.array(*map(F.lit, known)))) > 0
    return F.coalesce(told(name) & told(location) & some(workplaces, WORKPLACES) & some(employments, EMPLOYMENTS), F.lit(False))


def matching_ready(profiles: DataFrame, skills: DataFrame, minimum: int = USABLE_SKILLS) -> DataFrame:
    """``profiles`` that are complete and have ``minimum`` stored skills. Both sides have ``candidate_id``."""
    enough = skills.groupBy("candidate_id").agg(F.count("*").alias("n")).where(F.col("n") >= minimum)
    return profiles.where("complete").join(enough, "candidate_id", "left_semi")


def only_of(values: Column, allowed: list[str]) -> Column:
    """Whether an array holds nothing beyond ``allowed``; an empty one does, null gives null."""
    return F.size(F.array_except(values, F.array(*map(F.lit, allowed)))) == F.when(values.isNotNull(), 0)


def search_concepts(concepts: DataFrame, text: str, limit: int = SEARCH_HITS) -> DataFrame:
    """(id, label) of the concepts whose label holds ``text`` in any case: those that begin with it first, then by label.

    No character of ``text`` is a wildcard.
    """
    label, needle = F.lower("label"), F.lit(text.casefold())
    return concepts.where(F.contains(label, needle)).orderBy(~F.startswith(label, needle), label, "id").select("id", "label").limit(limit)


def added_skills(stored: DataFrame, requests: DataFrame, resolved: DataFrame, concepts: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((request_id, candidate_id, concept, outcome), the skills after them) of terms that candidates add to their profiles.

    ``requests`` has (request_id, candidate_id, term), ``resolved`` (term, outcome, concept) as ``extraction.resolve_terms``
    gives it, ``concepts`` (concept) what is stored, ``profiles`` and ``stored`` (candidate_id) and (candidate_id, concept). A
    request is refused without a profile (no_profile), for a term that means several concepts or none (ambiguous,
    unmapped), or whose concept isn't stored (unavailable), in this order. What is there already, or was asked for earlier
    in the same batch, is ``present``, so that doing it twice changes nothing. Defined cases: a null term is unmapped.
    """
    terms = resolved.select("term", F.col("outcome").alias("told"), "concept").dropDuplicates(["term"])
    known = concepts.select(F.col("concept").alias("_known")).distinct()
    people = profiles.select(F.col("candidate_id").alias("_profile")).distinct()
    asked = requests.join(terms, "term", "left").join(people, F.col("candidate_id") == F.col("_profile"), "left")
    asked = asked.join(known, F.col("concept") == F.col("_known"), "left")
    told = F.coalesce("told", F.lit("UNMAPPED"))
    refusal = F.when(F.col("_profile").isNull(), "no_profile").when(told != "RESOLVED", F.lower(told)).when(F.col("_known").isNull(), "unavailable")
    judged = asked.select("request_id", "candidate_id", F.when(refusal.isNull(), F.col("concept")).alias("concept"), refusal.alias("refusal"))
    first = judged.where("refusal is null").groupBy("candidate_id", "concept").agg(F.min("request_id").alias("_first"))
    held = stored.select("candidate_id", "concept").distinct().withColumn("_held", F.lit(True))
    both = judged.join(first, ["candidate_id", "concept"], "left").join(held, ["candidate_id", "concept"], "left")
    new = F.col("_held").isNull() & (F.col("request_id") == F.col("_first"))
    outcome = F.coalesce("refusal", F.when(new, "added").otherwise("present"))
    done = both.select("request_id", "candidate_id", "concept", outcome.alias("outcome"))
    return done, stored.select("candidate_id", "concept").unionByName(done.where("outcome = 'added'").select("candidate_id", "concept"))

"""Text that an employer repeats about itself: mining its blocks and stripping them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions.text import blocks, case_folded, employer_marker, folded
from jobloom.session import settle

MIN_POSTINGS, MIN_SHARE, MIN_IN_HAND, NEARLY_ALL = 5, 0.6, 2, 0.9


def _counts(postings: DataFrame) -> DataFrame:
    """(employer, fold, seen): postings that carry a block naming the employer; a block counts once a posting.

    Only blocks that hold the employer's marker somewhere are folded.
    """
    named = postings.withColumn("marker", employer_marker(F.col("employer"))).where("marker <> ''")
    each = named.select("employer", "posting_id", "marker", F.explode(blocks(F.col("description"))).alias("block"))
    each = each.where(F.contains(case_folded(F.col("block")), F.col("marker"))).withColumn("fold", folded(F.col("block")))
    once = each.where(F.contains("fold", F.concat(F.lit(" "), "marker", F.lit(" ")))).select("employer", "fold", "posting_id").distinct()
    return once.groupBy("employer", "fold").agg(F.count("*").alias("seen"))


def removable_in_run(postings: DataFrame, stored_counts: DataFrame | None = None) -> DataFrame:
    """(employer, fold, seen, in_hand): blocks that name the employer in 60 % of the postings in hand.

    At least two postings in hand, and five known: the greater of those in hand and those stored, never their sum.
    ``stored_counts`` has (employer, stored).
    """
    in_hand = postings.groupBy("employer").agg(F.countDistinct("posting_id").alias("in_hand"))
    known = F.col("in_hand")
    if stored_counts is not None:
        in_hand = in_hand.join(stored_counts, "employer", "left")
        known = F.greatest("in_hand", F.coalesce("stored", F.lit(0)))
    in_hand = in_hand.withColumn("known", known).where((F.col("in_hand") >= MIN_IN_HAND) & (F.col("known") >= MIN_POSTINGS))
    return (
        _counts(postings).join(in_hand, "employer")
        .where(F.col("seen") >= F.lit(MIN_SHARE) * F.col("in_hand"))
        .select("employer", "fold", "seen", "in_hand")
    )


def removable_stored(postings: DataFrame) -> DataFrame:
    """(employer, fold, seen): the rule for a stored population: 60 % of all postings, or 90 % of the employer's most
    carried block if two postings or more carry that."""
    counts = _counts(postings)
    known = postings.groupBy("employer").agg(F.countDistinct("posting_id").alias("n")).where(F.col("n") >= MIN_POSTINGS)
    most = F.max("seen").over(Window.partitionBy("employer"))
    joined = counts.withColumn("most", most).join(known, "employer")
    share = F.col("seen") >= F.lit(MIN_SHARE) * F.col("n")
    nearly = (F.col("most") >= MIN_IN_HAND) & (F.col("seen") >= F.lit(NEARLY_ALL) * F.col("most"))
    return joined.where(share | nearly).select("employer", "fold", "seen")


def _cut(postings: DataFrame, removable: DataFrame) -> DataFrame:
    """(posting_id, old, description, removed): texts before and after.

    What is removable is settled, so that a small table of it goes to the texts, which then aren't dealt out by employer.
    """
    gone = settle(removable.groupBy("employer").agg(F.collect_set("fold").alias("gone")))
    met = postings.join(gone, "employer", "left")
    # Blocks are cut and folded once a posting, through explode; later uses read the held arrays.
    pairs = F.transform(blocks(F.col("description")), lambda b: F.struct(b.alias("block"), folded(b).alias("fold")))
    held = met.select("posting_id", "description", "gone", F.explode(F.array(F.when(F.col("gone").isNotNull(), pairs))).alias("held"))
    stays = F.filter("held", lambda b: ~F.array_contains("gone", b["fold"]))
    both = held.select("*", F.explode(F.array(F.transform(stays, lambda b: b["block"]))).alias("kept"))
    removed = F.when(F.col("gone").isNull() | (F.size("kept") == 0), 0).otherwise(F.size("held") - F.size("kept"))
    return both.select(
        "posting_id", F.col("description").alias("old"),
        F.when(removed > 0, F.array_join("kept", "\n")).otherwise(F.col("description")).alias("description"),
        removed.cast("long").alias("removed"),
    )


def stripped(postings: DataFrame, removable: DataFrame) -> DataFrame:
    """(posting_id, description, removed): without the removable blocks; a text that would lose everything stays.

    Postings that lose nothing keep their description unchanged.
    """
    return _cut(postings, removable).drop("old")


def rewrites(postings: DataFrame, removable: DataFrame) -> DataFrame:
    """(posting_id, description, removed_blocks, removed_characters) of the postings that stripping changes.

    A backfill applies these rows by id; applying them twice changes nothing.
    """
    fewer = (F.length("old") - F.length("description")).cast("long")
    return _cut(postings, removable).where("removed > 0").select("posting_id", "description", F.col("removed").alias("removed_blocks"), fewer.alias("removed_characters"))


def backfill_report(postings: DataFrame, changes: DataFrame) -> DataFrame:
    """(postings_read, postings_changed, blocks_removed, characters_removed), one row."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    told = changes.agg(F.count("*").alias("postings_changed"), zero("removed_blocks").alias("blocks_removed"), zero("removed_characters").alias("characters_removed"))
    return postings.agg(F.count("*").alias("postings_read")).join(told)


BEFORE, AFTER = 1, 2


def measured(postings: DataFrame, changes: DataFrame, propose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(version, observations, distinct_terms, characters): what is proposed before and after a rewriting.

    ``propose`` gives (id, surface_form, ...) of (id, text). A posting that doesn't change is read once, for both versions;
    a term's mask says in which it occurs, so the terms of both versions are counted in one shuffle. Changes are settled, as
    they are read twice; the characters after are those before without the removed ones.
    """
    changes = settle(changes.select("posting_id", "description", "removed_characters"))
    new = changes.select("posting_id", F.col("description").alias("new"))
    both = postings.select("posting_id", "description").join(new, "posting_id", "left")
    versions = F.when(F.col("new").isNull(), F.array(F.struct(F.lit(BEFORE | AFTER).alias("mask"), F.col("description").alias("text")))).otherwise(
        F.array(F.struct(F.lit(BEFORE).alias("mask"), F.col("description").alias("text")), F.struct(F.lit(AFTER).alias("mask"), F.col("new").alias("text")))
    )
    texts = both.select(F.explode(versions).alias("v")).select(F.col("v.mask").alias("id"), "v.text")
    has = lambda c, m: F.col(c).bitwiseAND(F.lit(m)) != 0
    found = propose(texts).select(F.col("id").alias("mask"), F.trim(F.regexp_replace("surface_form", r"\s+", " ")).alias("term"))
    count = lambda df, m: F.sum(F.when(has("mask", m), F.col("n")).otherwise(0))
    terms = found.groupBy("term", "mask").agg(F.count("*").alias("n")).groupBy("term").agg(
        F.bit_or("mask").alias("mask"), *[count(None, m).alias(f"n{m}") for m in (BEFORE, AFTER)]
    )
    per = terms.agg(*[x for m in (BEFORE, AFTER) for x in (F.coalesce(F.sum(f"n{m}"), F.lit(0)).alias(f"o{m}"), F.count_if(has("mask", m)).alias(f"d{m}"))])
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    before = postings.agg(zero(F.length("description")).alias(f"c{BEFORE}"))
    size = before.join(changes.agg(zero("removed_characters").alias("fewer"))).select(f"c{BEFORE}", (F.col(f"c{BEFORE}") - F.col("fewer")).alias(f"c{AFTER}"))
    row = lambda name, m: F.struct(F.lit(name).alias("version"), F.col(f"o{m}").alias("observations"), F.col(f"d{m}").alias("distinct_terms"), F.col(f"c{m}").alias("characters"))
    return per.join(size).select(F.explode(F.array(row("before", BEFORE), row("after", AFTER))).alias("x")).select("x.*")

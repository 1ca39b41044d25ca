"""Walks over landed pages: which pages of a source or a board a run may use, and whether it came to the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_PAGES = 20


def walked(pages: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """The rows of ``pages`` that a walk from page 1 reaches: (scan, page, landed_at, failed, more, records).

    A page follows the one before it while that was read whole and says that there is ``more``; ``most`` pages are read at
    most. Of a page that landed several times the last counts. Defined cases: a null ``failed`` is false and a null ``more``
    says no more; pages numbered below 1 or beyond a gap aren't reached.
    """
    last = Window.partitionBy("scan", "page").orderBy(F.desc("landed_at"), F.desc(F.xxhash64("failed", "more", "records")))
    once = pages.where(F.col("page").between(1, most)).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    goes_on = ~F.coalesce("failed", F.lit(False)) & F.coalesce("more", F.lit(False))
    before = Window.partitionBy("scan").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    # Of the pages before number k, k - 1 must be there and go on; a scan has ``most`` rows here at most.
    steps = once.withColumn("_steps", F.coalesce(F.sum(F.when(goes_on, 1).otherwise(0)).over(before), F.lit(0)))
    return steps.where(F.col("_steps") == F.col("page") - 1).drop("_steps")


def scans(pages: DataFrame, wanted: DataFrame, most: int = MOST_PAGES, whole: bool = False) -> DataFrame:
    """(scan, pages, records, outcome, reached_the_end) of every ``wanted`` (scan).

    ``complete``: the last page read says that nothing follows. ``stopped_at_bound``: ``most`` pages were read and more
    would follow. ``failed``: a page failed, or one that should follow never landed. With ``whole``, as for a board, all
    or nothing counts: a scan that isn't complete gives no pages and no records, and a stop at the bound is a failure.
    """
    read = walked(pages, most)
    bad = F.coalesce("failed", F.lit(False))
    per = read.groupBy("scan").agg(
        F.count_if(~bad).alias("pages"), F.sum(F.when(~bad, F.col("records")).otherwise(0)).alias("records"), F.max("page").alias("last"),
        F.max_by(F.struct(bad.alias("failed"), F.coalesce("more", F.lit(False)).alias("more")), "page").alias("end"),
    )
    bound = F.lit("failed" if whole else "stopped_at_bound")
    outcome = (
        F.when(F.col("last").isNull() | F.col("end.failed"), "failed").when(~F.col("end.more"), "complete").when(F.col("last") == most, bound).otherwise("failed")
    )
    out = wanted.select("scan").distinct().join(per, "scan", "left").withColumn("outcome", outcome)
    counts = (F.lit(whole) & (F.col("outcome") != "complete")) | F.col("last").isNull()
    told = lambda c: F.when(counts, F.lit(0)).otherwise(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return out.select("scan", told("pages"), told("records"), "outcome", (F.col("outcome") == "complete").alias("reached_the_end"))


def usable(pages: DataFrame, most: int = MOST_PAGES, whole: bool = False) -> DataFrame:
    """The landed rows whose records a run takes: pages walked and not failed; with ``whole`` of complete scans only."""
    read = walked(pages, most).where(~F.coalesce("failed", F.lit(False)))
    if not whole:
        return read
    done = scans(pages, pages, most, whole).where("reached_the_end").select("scan")
    return read.join(done, "scan", "left_semi")

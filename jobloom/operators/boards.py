"""The registry of boards: what probes of them register, and what polls make of their standing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.operators.lifecycle import FAILURES_TO_INACTIVE
from jobloom.session import discard, settle

# Standings of a board, answers of a probe, and the tallies of a run.
OWNED, SETTLED = ("confirmed", "named"), ("blocked", "wrong_company")
STATED_NAME = ("site_title", "provider_name")
TALLIES = (
    "confirmed", "named", "wrong_company", "unverifiable", "not_found", "unreachable", "reactivated", "unchanged", "reverified",
    "demoted", "pinned_reported", "located",
)
# Tallies that an outcome counts under besides its own name.
COUNTED_AS = {"named_reactivated": ("reactivated", "named"), "located": ("located", "not_found"), "located_reactivated": ("located", "not_found", "reactivated")}

# By the row's standing towards the claimant, then by the answer: (status, evidence, failures start anew, outcome). A status
# or evidence of None stays. Rows that aren't listed under a standing are as under ``open``.
_FIRST = {
    "confirmed": ("confirmed", "provider_name", False, "confirmed"), "named": ("named", "site_title", False, "named"),
    "wrong_company": ("wrong_company", "provider_name", False, "wrong_company"), "unverifiable": ("candidate", "unverified", False, "unverifiable"),
    "not_found": ("not_found", "not_found", False, "not_found"), "unreachable": ("unreachable", "unreachable", False, "unreachable"),
}
_WAKING = {"confirmed": ("confirmed", "provider_name", True, "reactivated")}
PROBED = {
    "open": _FIRST,
    "asleep": _WAKING | {"named": ("named", "site_title", True, "named_reactivated")},
    "trusted": {
        "confirmed": ("confirmed", "provider_name", False, "reverified"), "named": (None, "site_title", False, "reverified"),
        "wrong_company": ("wrong_company", "provider_name", False, "demoted"), "unverifiable": ("candidate", "unverified", False, "demoted"),
        "not_found": (None, None, False, "unchanged"), "unreachable": (None, None, False, "unchanged"),
    },
}
NAMED_BY_ANOTHER = {"open": _FIRST, "asleep": _WAKING, "trusted": {}}


def standing(status: str | None, company: int | None, pinned: bool, claimant: int) -> str:
    """What a board's row is to the company that claims it."""
    if status in SETTLED or (status in OWNED and company is not None and company != claimant):
        return "shut"
    if pinned:
        return "pinned"
    if status in OWNED and company == claimant:
        return "trusted"
    return "asleep" if status == "inactive" else "open"


_ROW = ("status", "company_id", "kind", "pinned", "failures")


def _fold(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Events sorted by slug and order, with the board's row, if any, in front as part -1; only the row of the current slug is
    held, however many claims it has."""
    slug, row = None, None
    for batch in batches:
        out = []
        for e in batch.to_pylist():
            if e["slug"] != slug:
                slug, row = e["slug"], {c: e[c] for c in _ROW} | {"pinned": e["pinned"] or False, "failures": e["failures"] or 0}
            second, toward, outcome = e["part"] == 1, None, None
            if e["part"] >= 0:
                toward = standing(row["status"], row["company_id"], row["pinned"], e["claimant"])
            if toward in ("shut", "pinned") or (second and not e["allowed"]):
                outcome = "pinned_reported" if toward == "pinned" and not second else "unchanged"
            elif toward:
                ladder = NAMED_BY_ANOTHER if second else PROBED
                status, kind, anew, outcome = ladder[toward].get(e["answer"], _FIRST[e["answer"]])
                if outcome == "demoted" and e["answer"] == "unverifiable" and row["kind"] in STATED_NAME:
                    status = "named"
                row = {
                    "status": status or row["status"], "company_id": e["claimant"], "kind": kind or row["kind"], "pinned": row["pinned"],
                    "failures": 0 if anew else row["failures"],
                }
            out.append({c: e[c] for c in ("slug", "probe", "part", "claimant", "answer", "allowed")} | {"toward": toward, "outcome": outcome, **(row if toward else {c: e[c] for c in _ROW})})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def register(probes: DataFrame, boards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((probe, outcome), (slug, status, company_id, kind, pinned, failures)): probes applied in order, and the rows after them.

    ``probes`` has (probe, company_id, slug, answer, other_slug, other_answer): the company that claims the slug, what the
    visit gave, and the board that a verification named instead, if any. ``boards`` has the rows' columns. A settled row, one
    that belongs to another company, and a pinned one stay; a row that this company already holds is rechecked; any other is
    written. Another board is written only after an unverifiable answer, or after a first guess that found nothing, and
    where the guess's own row could be written.

    Claims on one slug are taken in the order of the probes. Whether a probe's other board is written hangs on another slug's
    row, so all slugs are gone through again until no such decision changes; each round settles at least the earliest open
    one. Rows and claims go through a round together and a probe's two claims meet in a window, so no table is joined or sent
    to the driver. The rows come back for the slugs that a probe named or that stood in ``boards``.

    Defined cases: probes are unique whole numbers and slugs not null; a null answer is ``unreachable``; another board equal to the
    guess, or with a null answer, isn't written.
    """
    fields = {"status": "string", "company_id": "long", "kind": "string", "pinned": "boolean", "failures": "long"}
    answer = F.coalesce("answer", F.lit("unreachable"))
    main = probes.select("slug", "probe", F.lit(0).alias("part"), F.col("company_id").cast("long").alias("claimant"), answer.alias("answer"), F.lit(True).alias("allowed"))
    leads = answer.isin("unverifiable", "not_found") & (F.col("other_slug") != F.col("slug")) & F.col("other_answer").isNotNull()
    other = probes.where(leads).select(
        F.col("other_slug").alias("slug"), "probe", F.lit(1).alias("part"), F.col("company_id").cast("long").alias("claimant"), F.col("other_answer").alias("answer"), F.lit(True).alias("allowed")
    )
    none = [F.lit(None).cast(t).alias(c) for c, t in fields.items()]
    held = boards.select("slug", *[F.col(c).cast(t).alias(c) for c, t in fields.items()])
    of_held = held.select(
        "slug", F.lit(None).cast("long").alias("probe"), F.lit(-1).alias("part"), F.lit(None).cast("long").alias("claimant"), F.lit(None).cast("string").alias("answer"),
        F.lit(True).alias("allowed"), *fields,
    )
    claims = main.unionByName(other).select("slug", F.col("probe").cast("long").alias("probe"), "part", "claimant", "answer", "allowed", *none)
    events = settle(claims.unionByName(of_held))
    schema = "slug string, probe long, part int, claimant long, answer string, allowed boolean, toward string, outcome string, " + ", ".join(f"{c} {t}" for c, t in fields.items())
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    arrow = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))])
    fold = lambda batches: _fold(batches, arrow)
    guess = lambda c: F.max(F.when(F.col("part") == 0, F.col(c))).over(Window.partitionBy("probe"))
    while True:
        done = settle(events.repartition("slug").sortWithinPartitions("slug", F.col("part") >= 0, "probe", "part").mapInArrow(fold, schema))
        met = done.where("part >= 0").withColumns({"first": guess("toward"), "guess": guess("answer")})
        may = ~F.col("first").isin("shut", "pinned") & ((F.col("guess") == "unverifiable") | (F.col("first") != "trusted"))
        again = met.select("slug", "probe", "part", "claimant", "answer", ((F.col("part") == 0) | may).alias("now"), "allowed")
        again = settle(again)
        if again.where("now <> allowed").isEmpty():
            discard(again, events)
            break
        discard(events, done)
        before = again.select("slug", "probe", "part", "claimant", "answer", F.col("now").alias("allowed"), *none)
        events = before.unionByName(of_held)
        events.settled_in = again.settled_in
    of = lambda c, part: F.max(F.when(F.col("part") == part, F.col(c)))
    both = done.where("part >= 0").groupBy("probe").agg(of("outcome", 0).alias("outcome"), of("answer", 0).alias("answer"), of("outcome", 1).alias("named"))
    located = F.when(F.col("named") == "reactivated", "located_reactivated").otherwise("located")
    result = F.when(F.coalesce("named", F.lit("unchanged")) == "unchanged", F.col("outcome")).when(F.col("answer") == "not_found", located).otherwise(F.col("named"))
    place = F.struct(F.col("part") >= 0, "probe", "part")
    rows = done.groupBy("slug").agg(F.max_by(F.struct(*fields), place).alias("row")).select("slug", "row.*").where("status is not null")
    return both.select("probe", result.alias("outcome")), rows


def tallied(outcomes: DataFrame) -> DataFrame:
    """One row with the twelve tallies of a run; a revival that is also a naming counts under both, as does a located board."""
    kinds = F.create_map(*[x for o, names in COUNTED_AS.items() for x in (F.lit(o), F.array(*map(F.lit, names)))])
    each = outcomes.select(F.explode(F.coalesce(F.try_element_at(kinds, F.col("outcome")), F.array("outcome"))).alias("tally"))
    return each.agg(*[F.count_if(F.col("tally") == t).alias(t) for t in TALLIES])


def earned(kind: Column, company: Column, pinned: Column) -> Column:
    """The status that a board answering again earns back: confirmed by evidence of a company or a pin, else candidate."""
    proven = kind.isNotNull() & (kind != "operator") & company.isNotNull()
    return F.when(proven | F.coalesce(pinned, F.lit(False)), "confirmed").otherwise("candidate")


def after_polls(polls: DataFrame, boards: DataFrame) -> DataFrame:
    """(slug, polls, failures, status) of each board of the registry that was polled, after all polls in order of time.

    ``polls`` has (slug, at, poll_id, failed). A success starts the count of failures anew and revives an inactive board to
    what it earned; three failures in a row, with those counted before, make a board inactive unless it is pinned. A poll of
    an unknown board changes nothing. Null ``failed`` is a success.
    """
    order = Window.partitionBy("slug").orderBy("at", "poll_id")
    failed = F.coalesce("failed", F.lit(False))
    runs = polls.select("slug", failed.alias("failed"), F.sum(F.when(failed, 0).otherwise(1)).over(order).alias("run"))
    streaks = runs.groupBy("slug", "run").agg(F.count_if("failed").alias("n"), F.count("*").alias("polls"))
    known = boards.select("slug", "status", "company_id", "kind", F.coalesce("pinned", F.lit(False)).alias("pinned"), F.coalesce("failures", F.lit(0)).alias("before"))
    met = streaks.join(known, "slug").withColumn("fails", F.col("n") + F.when(F.col("run") == 0, F.col("before")).otherwise(0))
    down = F.when((F.col("n") > 0) & (F.col("fails") >= FAILURES_TO_INACTIVE) & ~F.col("pinned"), F.col("run"))
    per = met.groupBy("slug", "status", "company_id", "kind", "pinned").agg(
        F.sum("polls").alias("polls"), F.max("run").alias("successes"), F.max_by("fails", "run").alias("failures"), F.min(down).alias("first"), F.max(down).alias("last")
    )
    woke = (F.col("successes") > 0) & ((F.col("status") == "inactive") | F.coalesce(F.col("first") < F.col("successes"), F.lit(False)))
    status = F.when(F.col("last") == F.col("successes"), "inactive").when(woke, earned(F.col("kind"), F.col("company_id"), F.col("pinned"))).otherwise(F.col("status"))
    return per.select("slug", "polls", F.col("failures").cast("long").alias("failures"), status.alias("status"))


# What an operator decides about a board, as (status, pinned, evidence, failures start anew); None stays.
DECISIONS = {"pin": ("confirmed", True, "operator", True), "block": ("blocked", False, "operator", False), "unblock": ("candidate", None, None, False)}


def decided(boards: DataFrame, decisions: DataFrame) -> DataFrame:
    """``boards`` (slug, status, company_id, kind, pinned, failures) after an operator's ``decisions`` (slug, at, decision).

    Pinning confirms a board over whatever discovery decided and clears its failures; blocking refuses it and takes a pin
    away; both make the row if there is none. Unblocking lets discovery decide again, and does nothing without a row. Of
    several decisions on a slug each field has the last one that sets it. Unknown decisions are ignored.
    """
    known = decisions.where(F.col("decision").isin(*DECISIONS)).select("slug", "at", "decision")
    makes = F.min(F.when(F.col("decision") != "unblock", F.col("at")))
    begun = known.groupBy(F.col("slug").alias("_slug")).agg(makes.alias("made"))
    old = boards.select("slug", *[F.col(c).alias(f"old_{c}") for c in ("status", "company_id", "kind", "pinned", "failures")])
    met = known.join(begun, F.col("slug") == F.col("_slug")).join(old, "slug", "left")
    # Before a row is made, there is nothing to unblock.
    met = met.where(F.col("old_status").isNotNull() | (F.col("at") >= F.col("made")))
    pick = lambda n: F.create_map(*[F.lit(x) for k, v in DECISIONS.items() for x in (k, v[n])])[F.col("decision")]
    last = lambda v: F.max_by(v, F.when(v.isNotNull(), F.col("at")))
    after = met.groupBy("slug").agg(
        last(pick(0)).alias("status"), last(pick(1)).alias("pinned"), last(pick(2)).alias("kind"), F.max(pick(3)).alias("anew"), F.first("old_company_id").alias("company_id"),
        F.first("old_kind").alias("old_kind"), F.first("old_pinned").alias("old_pinned"), F.first("old_failures").alias("old_failures"),
    )
    rows = after.select(
        "slug", "status", "company_id", F.coalesce("kind", "old_kind").alias("kind"), F.coalesce("pinned", "old_pinned", F.lit(False)).alias("pinned"),
        F.when(F.col("anew"), 0).otherwise(F.coalesce("old_failures", F.lit(0))).alias("failures"),
    )
    return boards.select(*rows.columns).join(rows.select("slug"), "slug", "left_anti").unionByName(rows)

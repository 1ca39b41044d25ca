"""Secret scan with corpus-wide ownership frequency.

Candidates are the fixed patterns plus bare tokens that look like keys. Their hashes are aggregated over the corpus
by distinct repositories and distinct owners. A value under many owners, or in many repositories of few owners, is a
copied example; a value of few repositories and owners is live-looking. Bare tokens become findings only where ownership says live-looking.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.text import map_rows
from jobloom.session import settle

# The base patterns, the group that holds the value, and its least length, in the order of kinds.
BASE = (
    (
        "assign",
        re.compile(
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
        ),
        2,
        6,
    ),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
BARE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
CLASSES = (re.compile(r"[a-z]"), re.compile(r"[A-Z]"), re.compile(r"[0-9]"))
LEAST_SYMBOLS = 8

SCHEMA = (
    "doc long, owner string, repo string, n_assign long, n_access long, n_hex long, base string, "
    "found array<struct<s:int,e:int,k:int,kind:string,value:binary>>"
)
_FOUND = pa.struct([("s", pa.int32()), ("e", pa.int32()), ("k", pa.int32()), ("kind", pa.string()), ("value", pa.binary())])
_ARROW = pa.schema(
    [("doc", pa.int64()), ("owner", pa.string()), ("repo", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64())]
    + [("n_hex", pa.int64()), ("base", pa.string()), ("found", pa.list_(_FOUND))]
)


def base_spans(text: str) -> list[tuple[int, int, int, str, str]]:
    """(start, end, rank, kind, value) of the base findings, by start and then kind."""
    found = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        for m in pattern.finditer(text):
            if len(m.group(group)) >= least:
                found.append((m.start(), m.end(), rank, kind, m.group(group)))
    return sorted(found)


def bare_tokens(text: str, taken: list[tuple]) -> list[tuple[int, int, int, str, str]]:
    """Key-like tokens outside the base spans: 16 characters or more, two character classes with a digit, 8 symbols."""
    # Base spans by end; the least start among those that end later tells whether any of them overlaps.
    taken = sorted(taken, key=lambda x: x[1])
    least = [len(text)] * (len(taken) + 1)
    for k in range(len(taken) - 1, -1, -1):
        least[k] = min(least[k + 1], taken[k][0])
    found, at = [], 0
    for m in BARE.finditer(text):
        value = m.group()
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at < len(taken) and least[at] < m.end():
            continue
        if not CLASSES[2].search(value) or not (CLASSES[0].search(value) or CLASSES[1].search(value)):
            continue
        if len(set(value)) >= LEAST_SYMBOLS:
            found.append((m.start(), m.end(), len(BASE), "bare", value))
    return found


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    def run(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            text = row.pop("text") or ""
            base = base_spans(text)
            count = [sum(x[2] == k for x in base) for k in range(len(BASE))]
            more = bare_tokens(text, base)
            yield row | {
                "n_assign": count[0],
                "n_access": count[1],
                "n_hex": count[2],
                "base": ",".join(f"{k}:{s}:{e}" for s, e, _, k, _ in base),
                "found": [
                    {"s": s, "e": e, "k": r, "kind": k, "value": hashlib.sha256(v.encode()).digest()[:16]}
                    for s, e, r, k, v in base + more
                ],
            }

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc"),
        F.col(owner_col).cast("string").alias("owner"),
        F.col(repo_col).cast("string").alias("repo"),
        F.col(text_col).alias("text"),
    )
    return map_rows(rows, run, SCHEMA, _ARROW)


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_repos, n_owners) of every candidate value: distinct counts built in three partial aggregates."""
    seen = found.select("owner", "repo", F.explode(F.array_distinct(F.transform("found", lambda x: x["value"]))).alias("value"))
    pairs = seen.groupBy("value", "owner", "repo").agg(F.lit(1).alias("one"))
    owners = pairs.groupBy("value", "owner").agg(F.count("*").alias("repos"))
    return owners.groupBy("value").agg(
        F.sum("repos").cast("long").alias("n_repos"), F.count("*").cast("long").alias("n_owners")
    )


def scan(
    docs: DataFrame,
    example_owners: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "doc_id",
    example_repos: int = 10,
) -> DataFrame:
    """(doc, n_assign, n_access, n_hex, base, spans, n_live, n_example, n_repos, n_owners) for every row of ``docs``.

    ``spans`` lists the base findings and the live-looking bare tokens as kind:start:end in code points, by start and
    then kind; ``n_repos`` and ``n_owners`` list, in the same order, how many distinct repositories and owners hold the
    value. A value is an example from ``example_owners`` distinct owners or ``example_repos`` distinct repositories
    on, live-looking below both. ``n_live`` and ``n_example`` count findings by that verdict.

    Defined cases: a null text is empty; a null owner or repository is one more owner or repository; a value counts
    once per repository however often it recurs; an empty table gives an empty result.
    """
    keyed = settle(candidates(docs, id_col, text_col, owner_col, repo_col).withColumn("row", F.monotonically_increasing_id()))
    live = (F.col("n_owners") < example_owners) & (F.col("n_repos") < example_repos)
    known = ownership(keyed).withColumn("live", live)
    each = keyed.where(F.size("found") > 0).select("row", F.explode("found").alias("x"))
    judged = each.join(known, each["x.value"] == known["value"]).select("row", "x", "live", "n_repos", "n_owners")
    listed = F.filter("xs", lambda x: (x["x"]["k"] < len(BASE)) | x["live"])
    per_row = (
        judged.groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("x.s", "x.k", "x.e", "x", "live", "n_repos", "n_owners"))).alias("xs"))
        .select("row", listed.alias("xs"))
        .select(
            F.col("row").alias("_row"),
            F.array_join(
                F.transform("xs", lambda x: F.concat_ws(":", x["x"]["kind"], x["x"]["s"].cast("string"), x["x"]["e"].cast("string"))),
                ",",
            ).alias("spans"),
            F.array_join(F.transform("xs", lambda x: x["n_repos"].cast("string")), ",").alias("n_repos"),
            F.array_join(F.transform("xs", lambda x: x["n_owners"].cast("string")), ",").alias("n_owners"),
            F.size(F.filter("xs", lambda x: x["live"])).cast("long").alias("n_live"),
            F.size(F.filter("xs", lambda x: ~x["live"])).cast("long").alias("n_example"),
        )
    )
    out = keyed.drop("found").join(per_row, F.col("row") == F.col("_row"), "left")
    return out.select(
        "doc", "n_assign", "n_access", "n_hex", "base",
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"),
        F.coalesce("n_repos", F.lit("")).alias("n_repos"),
        F.coalesce("n_owners", F.lit("")).alias("n_owners"),
    )

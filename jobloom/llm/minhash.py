"""MinHash near-duplicate detection with tensored banding.

Two small collections of ``m`` sub-keys are computed per document; a sub-key is ``a`` minhashes. Table keys are the
``m * m`` pairs of a sub-key from the one collection and one from the other, so ``2 * m * a`` minhashes stand for
``m * m`` bands of ``2 * a`` rows. A pair of similarity s meets in some table with probability
``(1 - (1 - s**a)**m)**2``; with a = 2 and m = 12 that is 0.99999 at s = 0.8. Every candidate is verified on the full
shingle sets.

Documents with equal shingle sets are one node from the start. A sub-key that a node shares with nobody gives no
table key. Within a table bucket, members are first compared with the member whose sub-keys most nodes hold, as the text
that a group's copies stem from has those of the majority; what that links is contracted, and a later round compares members of other components with one member of the bucket's first component.
Sets that then still share a bucket with another component are compared through their rarest shingles, an exact
filter: see ``_prefix_pairs``. So a large group of near copies, or of texts that share a passage, doesn't emit all its
pairs, and no candidate between components is left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.graph import components, renamed
from jobloom.llm.text import WordHash, map_rows, packed, scramble, shingle_hashes, unpacked
from jobloom.session import discard, settle

SUB_KEYS, SUB_ROWS = 12, 2
BROADCAST_ROWS = 100_000


def _shingles(text: str | None, words: WordHash, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text: A-Z lower-cased, words split at ASCII whitespace."""
    return np.unique(shingle_hashes(words.array((text or "").encode().lower().split()), width))


def _node(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, n, node, keys): set size, 128-bit identity of the set, and the sub-keys of both collections."""
    rng = np.random.default_rng(20)
    odd = rng.integers(1, 2**63, 2 * SUB_KEYS * SUB_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, 2 * SUB_KEYS * SUB_ROWS, dtype=np.uint64)

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        words = WordHash()
        for row in rows:
            found = _shingles(row["text"], words, width)
            out = {"doc": row["doc"], "th": row["th"], "n": len(found), "node": None, "keys": None}
            if len(found):
                lows = np.full(len(odd), np.uint64(2**64 - 1))
                for at in range(0, len(found), 2048):  # shingle hashes are well mixed: one odd factor each permutes them
                    np.minimum(lows, (odd[:, None] * found[None, at : at + 2048] + add[:, None]).min(1), out=lows)
                lows = lows.reshape(2 * SUB_KEYS, SUB_ROWS)
                acc = np.arange(2 * SUB_KEYS, dtype=np.uint64)
                for k in range(SUB_ROWS):
                    acc = scramble(acc + lows[:, k])
                out |= {"node": _node(found), "keys": acc.view(np.int64).tolist()}
            yield out

    arrow = pa.schema(
        [("doc", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("keys", pa.list_(pa.int64()))]
    )
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    return map_rows(rows, run, "doc long, th long, n long, node binary, keys array<long>", arrow)


def _sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of the ``wanted`` (doc, th, node) texts, from the texts themselves."""

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        words = WordHash()
        for row in rows:
            found = _shingles(row["text"], words, width)
            yield {"node": row["node"], "shingles": found.view(np.int64).tolist()}

    arrow = pa.schema([("node", pa.binary()), ("shingles", pa.list_(pa.int64()))])
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = rows.join(wanted, F.col("d").eqNullSafe(F.col("doc")) & (F.col("t") == F.col("th"))).select("node", "text")
    return map_rows(texts, run, "node binary, shingles array<long>", arrow, 500)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets meet the threshold, as 100 * intersection >= percent * union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    both = F.size("sa") + F.size("sb")
    return pairs.join(left, "a").join(right, "b").where(100 * shared >= percent * (both - shared)).select("a", "b")


def _table_keys(nodes: DataFrame) -> DataFrame:
    """(key, node, w): the table keys of every node, from sub-keys that it shares with another.

    w is the number of nodes that hold these sub-keys, over all of them: the members of a group that most others
    resemble have the largest.
    """
    subs = nodes.select("node", F.posexplode("keys").alias("slot", "sub"))
    shared = subs.groupBy("slot", "sub").agg(F.count("*").alias("m")).where("m > 1")
    met = subs.join(shared, ["slot", "sub"])
    mine = met.groupBy("node").agg(F.array_sort(F.collect_set(F.struct("slot", "sub"))).alias("subs"), F.sum("m").alias("w"))
    one = F.filter("subs", lambda s: s["slot"] < SUB_KEYS)
    two = F.filter("subs", lambda s: s["slot"] >= SUB_KEYS)
    keys = mine.select("node", "w", one.alias("one"), two.alias("two")).where((F.size("one") > 0) & (F.size("two") > 0))
    keys = keys.select("node", "w", "two", F.explode("one").alias("x")).select("node", "w", "x", F.explode("two").alias("y"))
    return keys.select(
        F.xxhash64("x.slot", "x.sub", "y.slot", "y.sub").alias("key"), "node", "w"
    )


def _prefix_pairs(sets: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the ``placed`` (node, root) sets that can reach the threshold, from different components.

    Shingles are put in one order, rare ones first. Sets of n <= m shingles that meet the threshold share at least
    need = percent * (n + m) / (100 + percent), so from their first common shingle on both have that many left. A set
    hence needs only its first shingles in the join, and the sizes and places of both ends decide there. The larger
    set's rows go to every size class that its partners can have; a shingle that only one set holds joins nothing.
    """
    t = percent / 100
    sized = sets.select("node", F.size("shingles").alias("n")).join(placed, "node")
    ids = settle(sized.select("node", "n", F.xxhash64("root").alias("r"), F.monotonically_increasing_id().alias("id")))
    tok = sets.join(ids, "node").select("id", F.explode("shingles").alias("s"))
    known = tok.groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    shared = tok.join(known, "s").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("all"))
    # A set's own shingles, which no other set holds, come first in the order: only their number counts.
    ranked = settle(
        shared.join(ids.select("id", "n", "r"), "id")
        .select("id", "n", "r", (F.col("n") - F.size("all")).alias("own"), F.floor(F.col("n") * (1 - t)).cast("int").alias("cut"), "all")
        .select("id", "n", "r", "own", F.posexplode(F.slice("all", F.lit(1), F.greatest(F.col("cut") + 2 - F.col("own"), F.lit(0)))).alias("k", "x"))
        .select("id", "n", "r", (F.col("own") + F.col("k")).alias("i"), "x.s")
    )
    size_class = lambda n: F.floor(F.log(n) / F.lit(math.log(1.05))).cast("int")
    small = ranked.select(F.col("id").alias("a"), F.col("r").alias("ra"), "n", "i", "s", size_class(F.col("n")).alias("z"))
    most = F.least(F.col("n").cast("double"), (F.col("n") - F.col("i")) * ((1 + t) / t) - F.col("n") + 1)
    low = F.greatest(F.lit(1.0), F.col("n") * t)
    large = (
        ranked.where(most >= low)
        .select(F.col("id").alias("b"), F.col("r").alias("rb"), F.col("n").alias("m"), F.col("i").alias("j"), "s", F.explode(F.sequence(size_class(low) - 1, size_class(most))).alias("z"))
    )
    need = F.ceil(F.lit(percent) * (F.col("n") + F.col("m")) / F.lit(100 + percent))
    fits = (F.col("ra") != F.col("rb")) & (100 * F.col("n") >= percent * F.col("m")) & (F.col("n") - F.col("i") >= need) & (F.col("m") - F.col("j") >= need)
    once = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b")))
    found = small.join(large, (small["s"] == large["s"]) & (small["z"] == large["z"]) & once & fits).select("a", "b").distinct()
    name = lambda end: ids.select(F.col("id").alias(end), F.col("node").alias(f"{end}_node"))
    return found.join(name("a"), "a").join(name("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    rounds: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc, th, n, component) for every row of ``docs``: linked rows share the smallest id of their component.

    Two texts are linked if 100 * intersection >= ``percent`` * union of their sets of ``width``-word shingles; a
    shorter text is one shingle. ``n`` is the size of the set.

    Defined cases: a null or empty text has an empty set, is linked with nothing and is its own component; each
    row is placed by its own text, also where ids recur; a null id never becomes the id of a component with other ids; an empty table
    gives an empty result.
    """
    return _placed(docs, width, percent, rounds, id_col, text_col).select("doc", "th", "n", "component")


def _placed(docs: DataFrame, width: int = 5, percent: int = 80, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``near_duplicates`` with the ``root`` of each row's component, which tells components apart where ids recur."""
    rows = settle(sketches(docs, width, id_col, text_col))
    full = rows.where("n > 0")
    nodes = settle(
        full.groupBy("node").agg(
            F.min("n").alias("n"), F.first("keys").alias("keys"), F.min(F.struct(F.col("doc").isNull(), "doc", "th")).alias("of")
        )
    )
    keys = _table_keys(nodes).join(nodes.select("node", "n"), "node")
    buckets = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    keys = settle(keys.join(buckets.select("key"), "key"))
    weights = settle(keys.select("node", "w").distinct())
    wanted = weights.select("node").join(nodes, "node")
    wanted = settle(wanted.select("node", F.col("of.doc").alias("doc"), F.col("of.th").alias("th")))
    sets = settle(_sets(docs, wanted, width, id_col, text_col).dropDuplicates(["node"]))

    near = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    members = keys.withColumn("root", F.col("node"))
    roots = nodes.select("node", F.col("node").alias("root")).limit(0)
    for nth in range(rounds):
        pick = F.struct("root", F.xxhash64(F.lit(nth), "key", "node")) if nth else F.struct(-F.col("w"), "node")
        firsts = members.groupBy("key").agg(
            F.min_by(F.struct(F.col("node").alias("b"), F.col("n").alias("m"), F.col("root").alias("rb")), pick).alias("r")
        )
        pairs = (
            members.join(firsts, "key")
            .select(F.col("node").alias("a"), "n", "root", "r.b", "r.m", "r.rb")
            .where((F.col("root") != F.col("rb")) & near)
        )
        roots = _linked(roots, _verified(pairs.select("a", "b").distinct(), sets, percent), None if nth else weights)
        members = _apart(keys, roots)
        if members.isEmpty():
            break
    else:
        left = members.select("node", "root").distinct()
        roots = _linked(roots, _verified(_prefix_pairs(sets, settle(left), percent), sets, percent))
    discard(keys, weights, wanted, sets)

    at = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.col("of.doc").alias("doc"))
    smallest = at.groupBy("root").agg(F.min("doc").alias("component"))
    of_node = at.join(smallest, "root").select(F.col("node").alias("_node"), "root", "component")
    linked = rows.drop("keys").join(of_node, F.col("node") == F.col("_node"), "left")
    return linked.select("doc", "th", "n", F.coalesce("component", "doc").alias("component"), "root")


def _linked(roots: DataFrame, edges: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``roots`` (node, root) after linking what ``edges`` join: edges are contracted to roots first."""
    names = roots.select(F.col("node").alias("from"), F.col("root").alias("to"))
    found = components(renamed(renamed(edges, "a", names), "b", names), weights)
    moved = renamed(roots, "root", found.select(F.col("node").alias("from"), F.col("root").alias("to")))
    return settle(moved.union(found))  # ends of contracted edges are roots, so no node comes twice


def _apart(keys: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the buckets that still hold two components or more, with their component's root."""
    placed = keys.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return settle(placed.join(apart.select("key"), "key"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the first by id, null ids last, and then by text hash.

    Of rows equal in id and text the smallest stays. Rows without words are in no group and all stay.
    """
    found = settle(_placed(docs, id_col=id_col, text_col=text_col, **how).where(F.col("root").isNotNull()).select("doc", "th", "root"))
    rank = F.struct(F.col("doc").isNull().alias("late"), "doc", "th")
    firsts = found.groupBy("root").agg(F.min(rank).alias("first"))
    places = found.groupBy("doc", "th", "root").agg(F.count("*").alias("times"))
    placed = places.join(firsts, "root").withColumn("kept", rank.eqNullSafe(F.col("first")))
    key = [F.col("doc").alias("_doc"), F.col("th").alias("_th")]
    here = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_at") == F.col("_th"))
    rows = packed(docs, _id=F.col(id_col).cast("long"), _at=F.xxhash64(text_col))
    rest = rows.join(placed.where("not kept").select(*key), here, "left_anti")
    again = settle(placed.where("kept and times > 1").select(*key))
    if not again.isEmpty():
        one = rest.join(again, here, "left_semi").groupBy("_id", "_at").agg(F.min("_row").alias("_row"))
        rest = rest.join(again, here, "left_anti").select("_row").union(one.select("_row"))
    return unpacked(rest, docs.columns)

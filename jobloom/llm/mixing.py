"""Mixing sources to target weights.

Each document gets a hash-random key. Within a source the keys are cut into ranges of equal width, sorted within
each range, and sizes are summed along the order: totals per range first, the ranges' running offsets next, and the
running sum inside a range last. No step needs a whole source in one task. The source's word budget is then cut
exactly where the running sum meets it, after as many whole epochs as the budget holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm.text import count_words, packed, unpacked
from jobloom.session import settle

RANGE_ROWS = 50_000


def source_key(c):
    """Sortable key of a source: code point order, null last."""
    return F.when(c.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), c))


def ranked(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add the 0-based rank of each row by ``column`` (distinct values), through ranges instead of one sorted task."""
    parts = settle(df.repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # as many rows as partitions
    before = sums.select(
        F.col("_part"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    return parts.join(before, "_part").withColumn(out, inner + F.col("_before")).drop("_part", "_before")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(skey, source_size, weight, target): all words shared by weight, no target above ``max_epochs`` times its source.

    Excess over a cap goes to the other sources by weight, again and again until none is above. Each round is one
    aggregate over the sources; only its two sums reach the driver.
    """
    sources = sized.groupBy("skey").agg(F.sum("size").cast("long").alias("source_size"))
    sources = ranked(sources, "skey", "rank")
    nth = F.array(*[F.lit(int(w)) for w in weights])
    sources = settle(
        sources.withColumn("weight", F.get(nth, (F.col("rank") % len(weights)).cast("int")))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .drop("rank")
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level: tuple[int, int] = (0, 1)
    full = F.lit(False)
    while True:
        rest = sources.where(~full).agg(F.sum("weight").alias("w")).first()["w"]
        taken = sources.where(full).agg(F.sum("cap").alias("c")).first()["c"] or 0
        if not rest:
            break
        level = (total - taken, rest)
        share = F.col("weight") * F.lit(level[0]).cast("double") / F.lit(level[1]).cast("double")
        now = full | (F.col("cap") < share)
        if sources.where(~full & (F.col("cap") < share)).limit(1).count() == 0:
            break
        full = now
    share = F.col("weight") * F.lit(level[0]).cast("double") / F.lit(level[1]).cast("double")
    return sources.withColumn("target", F.when(full, F.col("cap").cast("double")).otherwise(share)).drop("cap")


def mix_plan(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(doc, source, th, size, source_size, target, epochs, last, taken) for every row of ``docs``.

    ``epochs`` whole passes over the source take every document, ``last`` words of this document belong to the
    final, partial pass; ``taken`` = epochs * size + last, never above ``max_epochs`` * size. Budgets are the whole
    words of each target. Keys are ``md5`` of seed and id, or of the text where the id is
    null, so reruns agree.

    Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of its own, last
    in order; rows with the same id and text are cut one after the other; empty tables give empty results.
    """
    plan = _placed(docs, weights, max_epochs, seed, id_col, text_col, source_col)
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before"))).cast("long")
    return (
        plan.withColumn("last", last)
        .withColumn("taken", (F.col("epochs") * F.col("size") + F.col("last")).cast("long"))
        .select("doc", "source", "th", "size", "source_size", "target", "epochs", "last", "taken")
    )


def _placed(docs: DataFrame, weights, max_epochs, seed, id_col, text_col, source_col) -> DataFrame:
    """Every row with the words before it in its source's order, the source's whole passes, and the ``rest`` of its budget."""
    # Rows without an id are told apart, and so spread over the ranges, by their texts.
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    sized = settle(
        docs.select(
            F.col(id_col).alias("doc"),
            F.col(source_col).alias("source"),
            source_key(F.col(source_col)).alias("skey"),
            count_words(F.col(text_col)).alias("size"),
            F.xxhash64(text_col).alias("th"),
            F.md5(F.concat(F.lit(f"{seed}:"), key)).alias("key"),
        )
    )
    largest = sized.groupBy("skey").count().agg(F.max("count")).first()[0] or 0
    digits = 0
    while largest > RANGE_ROWS * 16**digits or (digits == 0 and largest > 64):
        digits += 1
    sized = sized.withColumn("range", F.substring("key", 1, digits))
    sums = sized.groupBy("skey", "range").agg(F.sum("size").alias("in_range"))
    along = Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("skey", "range", F.coalesce(F.sum("in_range").over(along), F.lit(0)).alias("offset"))
    targets = source_targets(sized, weights, max_epochs)
    cuts = offsets.join(targets, "skey")
    inside = Window.partitionBy("skey", "range").orderBy("key", "doc", "th").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sized.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(cuts, ["skey", "range"])
        .withColumn("before", F.col("before") + F.col("offset"))
    )
    budget = F.floor("target").cast("long")
    pass_size = F.greatest(F.col("source_size"), F.lit(1))
    return placed.withColumn("epochs", F.floor(budget / pass_size).cast("long")).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mixed corpus: one row per document and pass, columns of ``docs`` plus epoch, size and taken.

    The document at a source's cut gives its first words in the last pass; its text there is cut after them, and a
    column n_chars counts what is left. Columns of ``docs`` named epoch, size or taken are replaced.

    Defined cases: as in ``mix_plan``; rows equal in id, text and source stand one after the other in the order, and
    those of them that the cut leaves out are the last by the hash of their other columns.
    """
    plan = _placed(docs, weights, max_epochs, seed, id_col, text_col, source_col)
    groups = plan.where("size > 0 and (epochs > 0 or before < rest)").groupBy(
        F.col("doc").alias("_doc"), F.col("th").alias("_th"), F.col("skey").alias("_source"),
        F.col("size").alias("_size"), F.col("epochs").alias("_epochs"), F.col("rest").alias("_rest"),
    ).agg(F.min("before").alias("_before"), F.count("*").alias("_times"))
    groups = settle(groups)
    rows = packed(docs, _id=F.col(id_col), _text=F.col(text_col), _at=F.xxhash64(text_col), _skey=source_key(F.col(source_col)))
    here = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_at") == F.col("_th")) & (F.col("_skey") == F.col("_source"))
    # Only in a group of equal rows that the cut goes through do their numbers matter.
    through = (F.col("_times") > 1) & (F.col("_rest") > F.col("_before")) & (F.col("_rest") < F.col("_before") + F.col("_times") * F.col("_size"))
    joined = rows.join(groups, here).withColumn("_before", F.when(~through, F.col("_before")))
    if not groups.where(through).isEmpty():
        joined = joined.where("_before is not null").unionByName(_numbered(rows.join(groups.where(through), here)))
    last = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_rest") - F.col("_before")))
    one = lambda e, n: F.struct(e.cast("long").alias("epoch"), n.cast("long").alias("words"))
    whole = F.when(F.col("_epochs") > 0, F.sequence(F.lit(1), F.col("_epochs"))).otherwise(F.array().cast("array<bigint>"))
    passes = F.concat(
        F.transform(whole, lambda e: one(e, F.col("_size"))),
        F.filter(F.array(one(F.col("_epochs") + 1, last)), lambda p: p["words"] > 0),
    )
    each = joined.select("_row", "_text", "_size", F.explode(passes).alias("_pass"))
    words = F.regexp_extract_all("_text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    full = F.col("_pass.words") >= F.col("_size")
    text = F.when(full, F.col("_text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("_pass.words").cast("int")), ""))
    new = {text_col: text, "epoch": F.col("_pass.epoch"), "size": F.col("_size"), "taken": F.col("_pass.words")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(full, F.col("_row.n_chars")).otherwise(F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return unpacked(each, docs.columns, **new)


def _numbered(tied: DataFrame) -> DataFrame:
    """Rows of groups of equal rows, ``_before`` moved on by the rows of the group that come before."""
    group = ["_doc", "_th", "_source"]
    held = settle(tied.withColumn("_nth", F.monotonically_increasing_id()))
    place = F.struct("_source", F.col("_doc").isNull(), "_doc", "_th", F.xxhash64(F.to_json("_row")), "_nth")
    order = settle(ranked(held.select(*group, "_nth", place.alias("_place")), "_place", "_rank").drop("_place"))
    firsts = order.groupBy(*(F.col(c).alias(f"{c}0") for c in group)).agg(F.min("_rank").alias("_first"))
    same = F.col("_doc").eqNullSafe(F.col("_doc0")) & (F.col("_th") == F.col("_th0")) & (F.col("_source") == F.col("_source0"))
    number = order.join(firsts, same).select(F.col("_nth").alias("_n"), (F.col("_rank") - F.col("_first")).alias("_k"))
    moved = held.join(number, F.col("_nth") == F.col("_n")).withColumn("_before", F.col("_before") + F.col("_k") * F.col("_size"))
    return moved.drop("_nth", "_n", "_k")

"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams.

A text is compared as a whole, by its lines, and by passages as long as a template, so that a licence is also found
that stands over several lines of a longer file or beside other words. For Dice d between sets of sizes x and y,
d <= 2 min(x, y) / (x + y); so a unit of size x can only reach threshold t with templates of size between x t / (2 - t)
and x (2 - t) / t, and it holds all but a share (2 - 2 t) / (2 - t) of the template's bigrams. Hence a few words that
more bigrams than that contain stand in every text with a licence: other texts are passed over unread. Hence too, of a
template's first bigrams, one more than it may lack, one stands in the passage: passages are laid where such a bigram puts
them. The template list is small and fixed, and sits in the plan as a literal. Only native functions run here.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm.license_texts import TEMPLATES
from jobloom.llm.line_dedup import split_lines
from jobloom.llm.text import hold
from jobloom.session import settle


def normal_words(text: str) -> list[str]:
    """Template-side normalisation: runs of ASCII letters and digits, lower-cased."""
    return [w.lower() for w in re.findall(r"[A-Za-z0-9]+", text)]


def bigram_set(text: str) -> list[str]:
    words = normal_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def words_of(c: Column) -> Column:
    """The same normalisation as a column: null and texts without letters or digits give no words."""
    plain = F.btrim(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]+", " ")))
    return F.filter(F.split(plain, " ", -1), lambda w: w != "")


def bigrams_of(words: Column) -> Column:
    """Distinct neighbouring word pairs."""
    last = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(
        F.zip_with(F.slice(words, F.lit(1), last), F.slice(words, F.lit(2), last), lambda a, b: F.concat(a, F.lit(" "), b))
    )


def bounds(size: int, threshold: float) -> tuple[float, float]:
    return size * threshold / (2 - threshold), size * (2 - threshold) / threshold


def may_lack(size: int, threshold: float) -> int:
    """How many of a template's ``size`` bigrams a unit within the threshold may be without."""
    return int(size * (2 - 2 * threshold) / (2 - threshold) + 1e-9)


def telling_words(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which every unit within the threshold of some template holds one at least, long ones first."""
    out: set[str] = set()
    for text in templates.values():
        grams = bigram_set(text)
        left = [g for g in grams if not out & set(g.split())]
        while len(grams) - len(left) <= may_lack(len(grams), threshold):
            words = {w for g in left for w in g.split()}
            best = max(words, key=lambda w: (len(w) > 4, len(w) * sum(w in g.split() for g in left), w))
            out.add(best)
            left = [g for g in left if best not in g.split()]
    return sorted(out, key=lambda w: (-len(w), w))


def openings(text: str, threshold: float) -> list[tuple[str, int]]:
    """(bigram, word number) of a template's first bigrams, one more of them than a unit may lack."""
    words = normal_words(text)
    first: dict[str, int] = {}
    for k, (a, b) in enumerate(zip(words, words[1:])):
        first.setdefault(f"{a} {b}", k)
    return list(first.items())[: may_lack(len(first), threshold) + 1]


def scan(
    docs: DataFrame,
    threshold: float = 0.9,
    templates: dict[str, str] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc, th, unit, line, license, dice): every licence found, for each row of ``docs`` and unit of its text.

    ``unit`` is ``text`` for the whole text (``line`` -1), ``line`` with its 0-based number, or ``passage`` with the
    0-based number of its first word. A text or line gives its most similar template; of equals, the first by name. A
    text of one line is compared once, as a whole. A passage has as many words as its template, or ends with the text;
    each template gives the most similar one, of equals the first, unless the text or a line of it gave that template.

    Defined cases: null and empty texts and texts of fewer than two words give no row; repeated rows give their
    rows again; an empty table gives an empty result.
    """
    told = F.lit(False)
    for word in telling_words(templates, threshold):
        told = told | F.contains("lowered", F.lit(word))
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    rows = hold(rows, "lowered", F.lower("text")).where(told).select("doc", F.xxhash64("text").alias("th"), "text")
    sets = {name: bigram_set(text) for name, text in sorted(templates.items())}
    found = settle(_units(rows, sets, threshold))
    known = found.select(F.col("doc").alias("_doc"), F.col("th").alias("_th"), F.col("license").alias("_license"))
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th")) & (F.col("license") == F.col("_license"))
    return found.unionByName(_passages(rows, sets, templates, threshold).join(known, same, "left_anti"))


def _start_at(heads: list[tuple[str, int]]):
    """Where a passage starts that has the bigram at a word number in the same place as the template; else null."""

    def start(gram: Column, at: Column) -> Column:
        out = F.lit(None).cast("int")
        for head, k in reversed(heads):
            out = F.when(gram == head, F.greatest(at - k, F.lit(0))).otherwise(out)
        return out

    return start


def _place_of(name: str, length: int):
    return lambda at: F.struct(F.lit(name).alias("license"), at.alias("at"), F.lit(length).alias("n"))


def _passages(rows: DataFrame, sets: dict[str, list[str]], templates: dict[str, str], threshold: float) -> DataFrame:
    held = hold(rows.select("doc", "th", F.monotonically_increasing_id().alias("row"), "text"), "words", words_of(F.col("text"))).drop("text")
    last = F.greatest(F.size("words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("words", F.lit(1), last), F.slice("words", F.lit(2), last), lambda a, b: F.concat(a, F.lit(" "), b))
    held = hold(held, "pairs", pairs)
    places = []
    for name in sets:
        starts = F.array_distinct(F.array_compact(F.transform("pairs", _start_at(openings(templates[name], threshold)))))
        places.append(F.transform(starts, _place_of(name, len(normal_words(templates[name])))))
    each = held.select("doc", "th", "row", "words", F.explode(F.concat(*places)).alias("p"))
    cut = hold(each, "grams", bigrams_of(F.slice("words", F.col("p.at") + 1, F.col("p.n"))))
    grams = F.create_map(*[x for name, g in sets.items() for x in (F.lit(name), F.array(*map(F.lit, g)))])
    of_template = F.element_at(grams, F.col("p.license"))
    dice = 2.0 * F.size(F.array_intersect("grams", of_template)) / (F.size("grams") + F.size(of_template))
    near = hold(cut, "dice", dice).where(F.col("dice") >= threshold)
    best = near.groupBy("doc", "th", "row", F.col("p.license").alias("license")).agg(F.max("dice").alias("dice"), F.min_by("p.at", F.struct(-F.col("dice"), "p.at")).alias("line"))
    return best.select("doc", "th", F.lit("passage").alias("unit"), "line", "license", "dice")


def _units(rows: DataFrame, sets: dict[str, list[str]], threshold: float) -> DataFrame:
    """Licences of whole texts and lines."""
    least = min(bounds(len(s), threshold)[0] for s in sets.values())
    most = max(bounds(len(s), threshold)[1] for s in sets.values())
    lines = split_lines(F.col("text"))
    several = F.size(lines) > 1
    each = F.when(several, F.transform(lines, lambda x, i: F.struct(i.alias("line"), x.alias("unit_text")))).otherwise(
        F.array().cast("array<struct<line:int,unit_text:string>>")
    )
    units = rows.select(
        "doc", "th", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("line"), F.col("text").alias("unit_text"))), each)).alias("u")
    ).select("doc", "th", "u.line", "u.unit_text")
    units = hold(units, "words", words_of(F.col("unit_text")))
    # n words make at most n - 1 bigrams. Distinct words bound the bigrams from below.
    able = units.where((F.size("words") - 1 >= least) & (F.size(F.array_distinct("words")) - 1 <= most))
    sized = hold(able, "grams", bigrams_of(F.col("words"))).where(F.size("grams").between(least, most))
    n = F.size("grams")
    scores = []
    for name, grams in sets.items():
        low, high = bounds(len(grams), threshold)
        shared = F.size(F.array_intersect("grams", F.array(*map(F.lit, grams))))
        scores.append(
            F.when(n.between(low, high), F.struct((-2.0 * shared / (n + len(grams))).alias("minus"), F.lit(name).alias("license")))
        )
    best = F.array_min(F.array_compact(F.array(*scores)))
    return (
        hold(sized, "best", best)
        .where(-F.col("best.minus") >= threshold)
        .select(
            "doc", "th", F.when(F.col("line") < 0, "text").otherwise("line").alias("unit"), "line",
            F.col("best.license").alias("license"), (-F.col("best.minus")).alias("dice"),
        )
    )

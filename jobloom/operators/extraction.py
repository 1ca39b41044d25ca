"""Skills in text: vocabulary, spans, candidates, and what a posting's plan of skills is."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from jobloom.functions.text import normal_text
from jobloom.session import settle

# Token shapes and the words that never name a skill.
PUNCTUATED = r"[A-Za-z]\w*(?:[./][A-Za-z]\w*)+|[A-Za-z]\w*[+#]+"
CAPITALISED = r"[A-ZÀ-Þ][\wÀ-ɏ]*"
# Words that no proposed term starts or ends with.
STOPWORDS = frozenset([
    "a", "an", "and", "as", "at", "but", "by", "for", "from", "if", "in", "is", "it", "of", "on", "or", "our",
    "the", "to", "we", "with", "you", "your", "der", "die", "das", "und", "mit", "für", "von", "im", "wir",
    "du",
])
# What parts the words of a form, and the punctuation that may surround it.
_SEPARATORS, _SURROUNDING = re.compile(r"[\s_\-\u2010-\u2015]+"), " \t\r\n.,;:!?()[]{}\"'"
MAX_TOKENS, GRAMMATICAL, MEASURABLE = 4, 0.25, 30


def plain_form(value: str) -> str:
    """A surface form's normal form: NFKC, case folded, surrounding punctuation off, runs of spaces, dashes and underscores
    as one space."""
    same = value.lower() if value.isascii() else unicodedata.normalize("NFKC", value).casefold()
    return _SEPARATORS.sub(" ", same.strip(_SURROUNDING)).strip()


@F.pandas_udf(StringType())
def form(values: pd.Series) -> pd.Series:
    return values.map(plain_form, na_action="ignore")


def load_vocabulary(surface_forms: DataFrame) -> DataFrame:
    """(form, concept, words): concept is null where a form names several concepts. A form without a term raises."""
    named = settle(surface_forms.select("surface_form", "concept", form(F.col("surface_form")).alias("form")))
    blank = named.where(F.coalesce(F.col("form"), F.lit("")) == "").select("surface_form").first()
    if blank is not None:
        raise ValueError(f"surface form without a term: {blank[0]!r}")
    grouped = named.groupBy("form").agg(F.count_distinct("concept").alias("n"), F.min("concept").alias("one"))
    return grouped.select("form", F.when(F.col("n") == 1, F.col("one")).alias("concept"), F.size(F.split("form", " ")).alias("words"))


def alias_problems(concepts: DataFrame, surface_forms: DataFrame) -> DataFrame:
    """(problem, value) of an alias table: ``concepts`` (concept) and ``surface_forms`` (entry, surface_form, concepts array).

    ``concept_repeated`` for an id that stands there twice, ``form_blank`` for a form without a term, ``form_repeated`` for one
    that several entries have in normal form, ``entry_repeats_concept``, ``entry_without_concept`` and ``unknown_concept``.
    """
    told = lambda df, problem, value: df.select(F.lit(problem).alias("problem"), F.col(value).cast("string").alias("value"))
    twice = concepts.groupBy("concept").agg(F.count("*").alias("n")).where("n > 1")
    named = surface_forms.withColumn("form", F.coalesce(form(F.col("surface_form")), F.lit("")))
    many = named.where("form <> ''").groupBy("form").agg(F.count("*").alias("n")).where("n > 1")
    size = F.size(F.coalesce("concepts", F.array()))
    unknown = named.select(F.explode("concepts").alias("concept")).distinct().join(concepts.select("concept").distinct(), "concept", "left_anti")
    parts = [
        told(twice, "concept_repeated", "concept"), told(named.where("form = ''"), "form_blank", "entry"), told(many, "form_repeated", "form"),
        told(named.where(size > F.size(F.array_distinct("concepts"))), "entry_repeats_concept", "entry"), told(named.where(size == 0), "entry_without_concept", "entry"),
        told(unknown, "unknown_concept", "concept"),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def checked_aliases(concepts: DataFrame, surface_forms: DataFrame) -> DataFrame:
    """The vocabulary (form, concept, words) of an alias table; raises with its first problem if it has any."""
    first = alias_problems(concepts, surface_forms).orderBy("problem", "value").first()
    if first is not None:
        raise ValueError(f"alias table: {first['problem']}: {first['value']}")
    return load_vocabulary(surface_forms.select("surface_form", F.explode("concepts").alias("concept")))


def gold_resolution(gold: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(gold_mentions, resolved_mentions, rate) of ``gold`` (mention, labels array): a mention resolves if one of its labels is a
    form of the vocabulary, ambiguous or not. Without mentions the rate is 0."""
    labels = settle(gold.select("mention", F.explode("labels").alias("term")))
    # Labels are brought to their normal form once each, however often they occur.
    terms = settle(labels.select("term").distinct()).withColumn("form", form(F.col("term")))
    known = terms.join(vocabulary.select("form"), "form", "left_semi").select("term")
    hit = labels.join(known, "term", "left_semi").select("mention").distinct()
    told = gold.agg(F.count("*").alias("gold_mentions")).join(hit.agg(F.count("*").alias("resolved_mentions")))
    return told.withColumn("rate", F.when(F.col("gold_mentions") > 0, F.col("resolved_mentions") / F.col("gold_mentions")).otherwise(0.0))


def resolve_terms(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, outcome, concept): RESOLVED, AMBIGUOUS or UNMAPPED."""
    v = vocabulary.select(F.col("form").alias("_form"), "concept")
    joined = terms.withColumn("_key", form(F.col("term"))).join(v, F.col("_key") == F.col("_form"), "left")
    outcome = F.when(F.col("_form").isNull(), "UNMAPPED").when(F.col("concept").isNull(), "AMBIGUOUS").otherwise("RESOLVED")
    return joined.select("term", outcome.alias("outcome"), "concept")


# Fixed value: what counts as one token of a text.
_WORD_TOKEN = re.compile(r"[^\W_](?:[^\W_]|[+#]|[./](?=[^\W_]))*")
HELD_FORMS = 200_000


def token_forms(value: str) -> list[str]:
    """The normal forms of a text's tokens; what lies between them plays no part."""
    return [plain_form(t) for t in _WORD_TOKEN.findall(value)]


@F.pandas_udf(ArrayType(StringType()))
def tokens_of(values: pd.Series) -> pd.Series:
    return values.map(token_forms, na_action="ignore")


def term_entries(vocabulary: DataFrame) -> DataFrame:
    """(tokens, form, concept) of a vocabulary (form, concept): each form as its tokens, and as these joined by spaces.

    Raises if a form has no token, or if two forms have the same tokens and name different concepts.
    """
    cut = vocabulary.select(tokens_of(F.coalesce(F.col("form"), F.lit(""))).alias("tokens"), "concept", F.col("form").alias("given"))
    entries = cut.groupBy("tokens").agg(
        F.first("concept").alias("concept"), F.min("given").alias("given"), (F.count_distinct("concept") + F.max(F.col("concept").isNull().cast("int"))).alias("n")
    )
    wrong = entries.where((F.size("tokens") == 0) | (F.col("n") > 1)).select("given", "tokens").first()
    if wrong is not None:
        raise ValueError(f"surface form without a term: {wrong[0]!r}" if not wrong[1] else f"surface forms conflict as {' '.join(wrong[1])!r}")
    return entries.select("tokens", F.array_join("tokens", " ").alias("form"), "concept")


def phrases(docs: DataFrame, longest: int) -> DataFrame:
    """(id, words, first, start, end, surface_form, tokens): every run of 1 to ``longest`` tokens of a text, with offsets in
    code points, end exclusive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"], batch["text"]):
                at = [m.span() for m in _WORD_TOKEN.finditer(text or "")]
                own = [plain_form(text[a:b]) for a, b in at]
                for n in range(1, longest + 1):
                    for k in range(len(at) - n + 1):
                        start, end = at[k][0], at[k + n - 1][1]
                        rows.append((i, n, k, start, end, text[start:end], own[k : k + n]))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    names = ["id", "words", "first", "start", "end", "surface_form", "tokens"]
    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInPandas(run, f"id {kind}, words int, first int, start int, end int, surface_form string, tokens array<string>")


def extract_mentions(docs: DataFrame, vocabulary: DataFrame, held_forms: int = HELD_FORMS) -> DataFrame:
    """(id, surface_form, form, concept, start, end): phrases of the vocabulary, longest first over the whole text.

    A phrase is its tokens, one after another, whatever stands between them. All phrases of n tokens are taken before any
    of n - 1, left to right, and a phrase must not overlap one taken before. A vocabulary of ``held_forms`` forms at most
    goes to the tasks, which match each text in one pass; a larger one meets the texts' phrases in a join. The
    vocabulary's longest form bounds the phrases, nothing else does. A vocabulary with a form that has no token, or with
    two that conflict, raises.
    """
    forms = term_entries(vocabulary)
    if forms.count() <= held_forms:
        return _matched(docs, forms)
    longest = forms.agg(F.max(F.size("tokens"))).first()[0] or 0
    hits = phrases(docs, longest).join(forms, "tokens")

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["words", "first"], ascending=[False, True])
        keep = _free(list(zip(rows["first"], rows["words"])))
        return rows[keep][["id", "surface_form", "form", "concept", "start", "end"]].sort_values("start")

    return hits.drop("tokens").groupBy("id").applyInPandas(take, _mention_schema(docs, vocabulary))


def _mention_schema(docs: DataFrame, vocabulary: DataFrame) -> str:
    kind, concept = (x.dataType.simpleString() for x in (docs.schema["id"], vocabulary.schema["concept"]))
    return f"id {kind}, surface_form string, form string, concept {concept}, start int, end int"


def _free(runs: list[tuple[int, int]]) -> list[bool]:
    """Of (first token, tokens) in order of preference, which ones overlap none that was kept before."""
    taken: set[int] = set()
    keep = []
    for first, n in runs:
        own = range(first, first + n)
        keep.append(taken.isdisjoint(own))
        if keep[-1]:
            taken.update(own)
    return keep


def _matched(docs: DataFrame, forms: DataFrame) -> DataFrame:
    """Mentions by one pass over each text with the forms held by the task, looked up from their first token."""
    rows = [(tuple(r["tokens"]), r["form"], r["concept"]) for r in forms.collect()]
    held = docs.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries = {tokens: (name, concept) for tokens, name, concept in held.value}
        lengths: dict[str, set[int]] = {}
        for tokens in entries:
            lengths.setdefault(tokens[0], set()).add(len(tokens))
        plain: dict[str, str] = {}
        for batch in batches:
            out = []
            for i, text in zip(batch["id"], batch["text"]):
                at = [m.span() for m in _WORD_TOKEN.finditer(text or "")]
                own = []
                for a, b in at:
                    token = text[a:b]
                    if token not in plain:
                        if len(plain) > 400_000:
                            plain.clear()
                        plain[token] = plain_form(token)
                    own.append(plain[token])
                hits = [
                    (-n, k, entries[key])
                    for k, token in enumerate(own)
                    for n in lengths.get(token, ())
                    if (key := tuple(own[k : k + n])) in entries
                ]
                hits.sort(key=lambda h: h[:2])
                kept = [h for h, free in zip(hits, _free([(k, -n) for n, k, _ in hits])) if free]
                for n, k, named in sorted(kept, key=lambda h: h[1]):
                    start, end = at[k][0], at[k - n - 1][1]
                    out.append((i, text[start:end], *named, start, end))
            yield pd.DataFrame(out, columns=["id", "surface_form", "form", "concept", "start", "end"])

    return docs.select("id", "text").mapInPandas(run, _mention_schema(docs, forms))


def plan_skills(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(skills, unresolved): a concept once per posting under its first spelling; unresolved forms with their spans."""
    skills = mentions.where("concept is not null").groupBy("id", "concept").agg(F.min_by("surface_form", "start").alias("surface_form"))
    loose = mentions.where("concept is null").groupBy("id", "surface_form").agg(
        F.count("*").alias("occurrences"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")
    )
    return skills, loose


# The next token that punctuation or a capital may name, past all others, or the text's end, and the same where
# capitals name nothing; the first letters of words where capitals are counted; and what ends a sentence.
_OTHERS = rf"(?:{{0}}[\wÀ-ɏ]*+(?![./+#])|(?!{{1}}{PUNCTUATED})[\wÀ-ɏ]+|[^\wÀ-ɏ]+)*+(?:({PUNCTUATED})|{{2}}\Z)"
_NAMES = re.compile(_OTHERS.format("[a-zß-ɏ_0-9]", "[A-ZÀ-Þ]|", f"({CAPITALISED})|"))
_MARKS = re.compile(_OTHERS.format(r"[\wÀ-ɏ]", "", ""))
_FIRSTS = re.compile(r"([A-Za-zÀ-ɏ])[\wÀ-ɏ]*")
ENDS, LOOKED_BACK = ".!?:;)]", 40


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Runs of one to four adjacent named tokens; a sentence's first word alone never counts.

    A token is named by its punctuation, or by a capital where capitals are rare, and never if it is a stopword. From the
    end of the text each token learns how many named ones follow it without a break; a proposal is a token with a
    reach of that many at most.
    """
    firsts = _FIRSTS.findall(text)
    dense = len(firsts) >= MEASURABLE and sum(map(str.isupper, firsts)) > GRAMMATICAL * len(firsts)
    spans = []
    for m in (_MARKS if dense else _NAMES).finditer(text):
        kind = m.lastindex
        if kind and m.group(kind).casefold() not in STOPWORDS:
            spans.append(m.span(kind))
    # What stands between two named tokens is blank only if they are neighbours.
    reach, after, follows = [], 0, len(text)
    for begin, end in reversed(spans):
        after = 1 + after * (after > 0 and not text[end:follows].strip())
        follows = begin
        reach.append(after)
    reach.reverse()
    found = []
    for k, (begin, _) in enumerate(spans):
        before = text[max(0, begin - LOOKED_BACK) : begin]
        said = before.rstrip()
        opens = not said or said[-1] in ENDS or "\n" in before[len(said) :]
        ends = [spans[k + n][1] for n in range(opens, min(reach[k], MAX_TOKENS))]
        found += [(text[begin:end], begin, end) for end in ends]
    return found


def propose_candidates(docs: DataFrame) -> DataFrame:
    """(id, surface_form, start, end): proposed terms of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                piece = batch.slice(at, 1_000)
                rows = [(k, *p) for k, text in enumerate(piece.column("text").to_pylist()) if text for p in proposals(text)]
                k, *found = zip(*rows) if rows else ((),) * 4
                columns = [piece.column("id").take(pa.array(k, pa.int32())), *map(pa.array, found, (pa.string(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "surface_form", "start", "end"])

    return docs.select("id", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, surface_form string, start int, end int")


def unknown_terms(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates whose form, whitespace collapsed and case folded, no vocabulary form equals."""
    return (
        candidates.withColumn("_key", normal_text(F.col("surface_form")))
        .join(known.select(F.col("form").alias("_key")), "_key", "left_anti")
        .drop("_key")
    )


def review_queue(candidates: DataFrame, owners: DataFrame, limit: int = 50) -> DataFrame:
    """(surface_form, employers, mentions, postings, example): the terms most employers use, then most mentioned."""
    return (
        candidates.join(owners, "id")
        .groupBy("surface_form")
        .agg(
            F.countDistinct("employer").alias("employers"),
            F.count("*").alias("mentions"),
            F.countDistinct("id").alias("postings"),
            F.min("id").alias("example"),
        )
        .orderBy(F.desc("employers"), F.desc("mentions"), "surface_form")
        .limit(limit)
    )


# What a word of an n-gram is, and how many terms a task holds before it passes their counts on.
_ASCII_WORD, HELD_TERMS = re.compile("[a-z0-9]+"), 300_000


def _counted_terms(batches: Iterator[pa.RecordBatch], longest: int, held: int) -> Iterator[pa.RecordBatch]:
    """(term, n) of lower-cased texts: of the n-grams that don't start or end on a stopword, how many texts have them. A term
    comes again whenever ``held`` were passed on."""
    told = lambda: pa.RecordBatch.from_pydict({"term": pa.array(counts, pa.string()), "n": pa.array(counts.values(), pa.int64())})
    counts: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            words = _ASCII_WORD.findall(text or "")
            ends = [None if w in STOPWORDS else w for w in words]
            runs, seen = ends, set(ends)
            for n in range(1, longest):
                runs = [r and f"{r} {w}" for r, w in zip(runs, words[n:])]
                seen.update([r for r, last in zip(runs, ends[n:]) if last])
            seen.discard(None)
            counts.update(seen)
            if len(counts) >= held:
                yield told()
                counts = Counter()
    yield told()


def ngram_frequencies(docs: DataFrame, longest: int = 3, least: int = 3, share: float = 0.25, held: int = HELD_TERMS) -> DataFrame:
    """(term, df): n-grams of 1 to ``longest`` ASCII tokens, not starting or ending on a stopword, in at least
    ``least`` documents and at most ``share`` of them.

    A task counts its texts' terms and passes the counts on, ``held`` terms at a time.
    """
    total = docs.count()
    found = docs.select(F.lower("text").alias("text")).mapInArrow(lambda batches: _counted_terms(batches, longest, held), "term string, n long")
    # Dealt out by term first: adding up once more before the shuffle would find few equal terms.
    counts = found.repartition("term").groupBy("term").agg(F.sum("n").alias("df"))
    return counts.where((F.col("df") >= least) & (F.col("df") <= F.lit(share * total)))

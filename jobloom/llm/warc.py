"""WARC archives: writing pages, and reading records back by boundary-chain verification.

Writing: of equal payloads the page with the smallest id is a response record, the others are revisit records
without the payload. Every file begins with a warcinfo record. Spark's text writer writes the records, each closed by
the blank lines that end a record; the files bear its extension.

Reading: tasks cut the archives at the record magic and emit, for every place where it occurs, the offset of the
candidate record and of its successor, as its header states the length. Pointer jumping from each file's start then
keeps the records that the chain of successors reaches. Magic inside a payload starts no reachable record. A payload
that holds magic spans several pieces; these are put together again, and are known by file and content hash, which
stay the same however a later scan cuts the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobloom.llm.text import hold
from jobloom.session import settle

# The format's magic and line ends, and the base-32 alphabet.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROW_OF_TASK = (1 << 33) - 1


def sha1_base32(c: Column) -> Column:
    """Upper-case base-32 SHA-1."""
    return base32(F.sha1(c))


def base32(hexed: Column) -> Column:
    """Forty hex digits in upper-case base 32: every five hex digits are four base-32 digits."""
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), DIGITS32, BASE32)


def with_origin(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(page, digest, bytes, origin): origin is the page whose payload a revisit repeats, null for a response.

    The digests are grouped without the payloads. Null ids come last, so they are responses only where all are null.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = settle(
        pages.select(
            F.col(id_col).cast("long").alias("page"), sha1_base32(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes")
        )
    )
    firsts = rows.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n"))
    firsts = firsts.where("n > 1").select(F.col("digest").alias("_digest"), "first")
    revisit = (F.col("bytes") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    return rows.join(firsts, F.col("digest") == F.col("_digest"), "left").select(
        "page", "digest", "bytes", F.when(revisit, F.col("first")).alias("origin")
    )


def record_text(url: Column, page: Column, payload: Column, digest: Column, size: Column, origin: Column, date: str) -> Column:
    """One record without its closing blank lines. The block of a revisit has the HTTP header alone."""
    response = origin.isNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))
    block = F.when(response, F.concat(http, payload)).otherwise(http)
    uri = F.regexp_replace(F.coalesce(url, F.lit("urn:none")), r"[\r\n]", "")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">\r\n"))
    return F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(response, F.lit("response")).otherwise(F.lit("revisit")),
        F.lit("\r\nWARC-Record-ID: "), name(page), F.lit(f"WARC-Date: {date}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), digest, F.lit("\r\n"),
        F.when(response, F.lit("")).otherwise(F.concat(F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: "), name(origin))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit(END), block,
    )


def info_text(date: str) -> Column:
    """The warcinfo record that a file begins with, without its closing blank lines; its id is new for every task."""
    fields = "format: WARC File Format 1.1\r\nsoftware: jobloom\r\n"
    return F.concat(
        F.lit(f"{MAGIC}WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:archive-part:"), F.spark_partition_id().cast("string"),
        F.lit(f">\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(fields)}{END}{fields}"),
    )


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    html_col: str = "html",
    url_col: str = "url",
    min_bytes: int = 0,
    broadcast_rows: int = 50_000,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write ``pages`` as WARC files under ``path``, a record per row and a warcinfo record first in each file.

    Only the revisits' origins are joined to the pages: broadcast if they are ``broadcast_rows`` at most, else by a
    shuffle. ``date`` is the time of capture that all records state, as pages bear none.

    Defined cases: a null html is an empty payload, a null url is ``urn:none``; rows that share an id and a payload
    are records of one name, all of them responses or all revisits; of equal payloads whose ids are all null each is a
    response; an empty table may give no file or one without pages.
    """
    origins = settle(with_origin(pages, id_col, html_col, min_bytes).where("origin is not null").select("digest", "origin", F.col("page").alias("_page")).distinct())
    if origins.count() <= broadcast_rows:
        origins = F.broadcast(origins)
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), payload.alias("payload"), sha1_base32(payload).alias("d"), F.octet_length(payload).alias("size")
    ).join(origins, F.col("page").eqNullSafe(F.col("_page")) & (F.col("d") == F.col("digest")), "left")
    record = record_text(*map(F.col, ("url", "page", "payload", "d", "size", "origin")), date)
    first = F.monotonically_increasing_id().bitwiseAND(ROW_OF_TASK) == 0
    text = F.concat(F.when(first, F.concat(info_text(date), F.lit(END))).otherwise(F.lit("")), record)
    rows.select(text.alias("value")).write.option("lineSep", END).mode("overwrite").text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block_start, mid, piece): the text after every magic, in file order; what precedes the first is the piece
    at the file's very start and usually empty. ``mid`` holds within one job only."""
    return (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("mid"),
            F.col("value").alias("piece"),
        )
    )


def _header(top: Column, name: str) -> Column:
    """A header field of the text before a record's first blank line; null where absent or empty."""
    return F.nullif(F.regexp_extract(F.concat(F.lit("\r\n"), top), rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def reachable(candidates: DataFrame, stretch: int = 64 << 20) -> DataFrame:
    """The (file, at) of ``candidates`` (file, at, next) that the chain from each file's offset 0 reaches.

    Within ``stretch`` bytes of a file, a run of candidates of which each points to the following one is one segment:
    what enters it at some offset reaches all of it from there on. Pointer jumping goes over the segments: every round
    doubles the stride of all pointers and adds what the reached segments point to, with the offset of entry.
    """
    along = Window.partitionBy("file", "part").orderBy("at")
    start = F.when(F.lag("next").over(along).eqNullSafe(F.col("at")), F.lit(None)).otherwise(F.col("at"))
    cut = candidates.withColumn("part", F.floor(F.col("at") / stretch)).withColumn("start", start)
    members = settle(cut.select("file", "at", "next", F.last("start", True).over(along).alias("seg")))
    ends = members.groupBy("file", "seg").agg(F.max("next").alias("next")).select("file", F.col("seg").alias("_from"), "next")
    entry = members.select(F.col("file"), F.col("at").alias("next"), F.col("seg").alias("to"))
    jump = settle(ends.join(entry, ["file", "next"]).where("to > _from").select("file", "_from", "to", F.col("next").alias("land")))
    known = settle(members.where("at = 0").select("file", "seg", F.col("at").alias("land")))
    while not jump.isEmpty():
        new = known.select("file", F.col("seg").alias("_from")).join(jump, ["file", "_from"]).select("file", F.col("to").alias("seg"), "land")
        known = settle(known.union(new).distinct())
        far = jump.select("file", F.col("_from").alias("to"), F.col("to").alias("_far"), F.col("land").alias("_land"))
        jump = settle(jump.join(far, ["file", "to"]).select("file", "_from", F.col("_far").alias("to"), F.col("_land").alias("land")))
    return members.join(known, ["file", "seg"]).where("at >= land").select("file", "at")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, type, record_id, refers_to, stated_digest, payload_bytes, payload_digest) of every record but warcinfo.

    Digest and length of a response are taken of the payload that was read. A revisit states both in its header.
    Records with a length that points past the file, or without one, end their file's chain. Files without magic
    at their start give no records.
    """
    # Each of these is computed once a piece: conditions and later columns would otherwise repeat it.
    pieces = hold(_pieces(spark, path), "top", F.substring_index("piece", END, 1))
    pieces = hold(pieces, "length", F.try_to_number(_header(F.col("top"), "Content-Length"), F.lit("999999999999")).cast("long"))
    pieces = pieces.withColumn("head", F.octet_length("top") + F.lit(len(END)))
    whole = F.octet_length("piece") == F.col("head") + F.col("length") + len(END)
    pieces = pieces.withColumn("whole", whole)
    raw = F.col("piece").cast("binary")
    block = F.substring(raw, F.col("head") + 1, F.greatest(F.octet_length("piece") - F.col("head") - len(END), F.lit(0)))
    pieces = hold(pieces, "block", block.cast("string"))
    pieces = hold(pieces, "http", F.substring_index("block", END, 1))
    framed = F.octet_length("http") < F.octet_length("block")
    payload = F.when(framed, F.substring(F.col("block").cast("binary"), F.octet_length("http") + len(END) + 1, F.octet_length("block"))).otherwise(F.col("block").cast("binary"))
    pieces = hold(pieces, "payload", payload)
    pieces = hold(pieces, "hexed", F.when(F.col("whole"), F.sha1("payload")))
    rows = settle(
        pieces.select(
            "file", "block_start", "mid", "length", "head", F.octet_length("piece").alias("bytes"), "whole", *_content(F.col("piece")),
            F.lower(_header(F.col("top"), "WARC-Type")).alias("type"),
            _header(F.col("top"), "WARC-Record-ID").alias("record_id"),
            _header(F.col("top"), "WARC-Refers-To").alias("refers_to"),
            _header(F.col("top"), "WARC-Payload-Digest").alias("stated_digest"),
            F.when(F.col("whole"), F.octet_length("payload")).cast("long").alias("payload_bytes"),
            base32(F.col("hexed")).alias("payload_digest"),
            F.nullif(F.regexp_extract("http", r"(?i)\r\nContent-Length:[ \t]*(\d+)", 1), F.lit("")).alias("http_length"),
        ).withColumnRenamed("block_start", "block")
    )
    # Offsets: sums inside a block of the file first, then over the file's blocks. Every piece but the first of a
    # file follows a magic.
    step = F.col("bytes") + len(MAGIC)
    blocks = rows.groupBy("file", "block").agg(F.sum(step).alias("sum"))
    before = blocks.select(
        F.col("file"), F.col("block"), F.coalesce(F.sum("sum").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("file", "block").orderBy("mid").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum(step).over(inside), F.lit(0))).join(before, ["file", "block"])
    # The piece at a file's start precedes its first magic, which stands at its end.
    placed = settle(placed.withColumn("at", F.col("at") + F.col("before") - len(MAGIC)).drop("before"))
    found = placed.where("at >= 0").withColumn("next", F.col("at") + len(MAGIC) + F.col("head") + F.col("length") + len(END))
    kept = reachable(found.where("length is not null").select("file", "at", "next"))
    records = found.join(kept, ["file", "at"]).select(
        "file", "at", "next", "type", "record_id", "refers_to", "stated_digest", "whole", "payload_bytes", "payload_digest", "http_length", "head", "length"
    )
    records = records.where(~F.col("type").eqNullSafe("warcinfo"))
    done = records.where("whole")
    split = records.where("not whole")
    parts = _spanning(spark, path, placed, split)
    joined = split.drop("payload_bytes", "payload_digest").join(parts, ["file", "at"])
    return done.unionByName(joined).select(
        "file", "at", "type", "record_id", "refers_to",
        F.regexp_replace("stated_digest", "^sha1:", "").alias("stated_digest"),
        F.when(F.col("type") == "revisit", F.col("http_length").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(F.col("type") == "revisit", F.regexp_replace("stated_digest", "^sha1:", "")).otherwise(F.col("payload_digest")).alias("payload_digest"),
    )


def _content(piece: Column) -> list[Column]:
    """(c0, c1): 128 bits of a piece's content, by which another scan finds its text again."""
    return [F.xxhash64(piece).alias("c0"), F.xxhash64(F.lit(7), piece).alias("c1")]


def _spanning(spark: SparkSession, path: str, placed: DataFrame, split: DataFrame) -> DataFrame:
    """(file, at, payload_bytes, payload_digest) of the records whose block holds magic, from their pieces."""
    spans = settle(split.select("file", "at", "next"))
    # A piece belongs to the last reachable record at or before it; only files with such records are looked at.
    marks = placed.select("file", F.col("at").alias("p"), "c0", "c1").join(spans.select("file").distinct(), "file", "left_semi")
    owner = spans.withColumn("p", F.col("at")).select("file", "p", "at", "next")
    both = marks.join(owner, ["file", "p"], "left")
    run = Window.partitionBy("file").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    mine = both.withColumn("at", F.last("at", True).over(run)).withColumn("next", F.last("next", True).over(run)).where("p < next")
    mine = settle(mine.select("file", "p", "at", "c0", "c1"))
    wanted = mine.select("c0", "c1").distinct()
    texts = _pieces(spark, path).select(*_content(F.col("piece")), "piece").join(wanted, ["c0", "c1"]).dropDuplicates(["c0", "c1"])
    whole = mine.join(texts, ["c0", "c1"]).groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("p", "piece"))).alias("ps"))
    text = F.array_join(F.transform("ps", lambda x: x["piece"]), MAGIC)
    whole = whole.select("file", "at", text.alias("piece"))
    body = F.expr("substr(piece, length(substring_index(piece, '\r\n\r\n', 1)) + 5)")
    block = F.left(body, F.greatest(F.char_length(body) - len(END), F.lit(0)))
    http_at = F.instr(block, END)
    payload = F.when(http_at > 0, F.substr(block, http_at + len(END))).otherwise(block)
    return whole.select("file", "at", F.octet_length(payload).cast("long").alias("payload_bytes"), sha1_base32(payload).alias("payload_digest"))

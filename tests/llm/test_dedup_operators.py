"""Mixing, near-duplicate, line, decontamination, archive and substring operators against plain Python."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

from corpus_cases import CASES, SCHEMA, clashing
from jobloom.llm import decontaminate, graph, line_dedup, minhash, mixing, queries, substring_dedup, warc
from jobloom.llm.text import SPACES
from jobloom.session import table


def near_copies(seed=5, groups=6, copies=12):
    """Texts in groups: copies of a base with more and more words changed, so that links are a few of all pairs."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(60, 160))]
        for c in range(copies):
            text = list(base)
            for _ in range(c):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text))
    rows += [" ".join([word() for _ in range(15)] + passage + [word() for _ in range(15)]) for _ in range(20)]
    rows += [rows[0], rows[0].upper(), "a b", "A  b", "a b c", "", None, "\t "]
    rng.shuffle(rows)
    return list(enumerate(rows))


def plain_components(rows, width, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_near_duplicates_equal_brute_force(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for width, rounds in ((4, 2), (5, 1)):
        got = {r["doc"]: (r["n"], r["component"]) for r in minhash.near_duplicates(docs, width=width, rounds=rounds).collect()}
        assert got == plain_components(rows, width, 80)


def test_prefix_pairs_lose_no_link(spark):
    rows = [r for r in near_copies(seed=8) if r[1] and r[1].strip()]
    sets = {d: sorted({hash(tuple(w[k : k + 4])) for k in range(max(1, len(w) - 3))}) for d, w in ((d, t.lower().split()) for d, t in rows)}
    frame = spark.createDataFrame([(d.to_bytes(4, "big"), s) for d, s in sets.items()], "node binary, shingles array<long>")
    placed = frame.select("node", frame["node"].alias("root"))
    pairs = minhash._verified(minhash._prefix_pairs(frame, placed, 80), frame, 80)
    got = {tuple(sorted((int.from_bytes(r["a"], "big"), int.from_bytes(r["b"], "big")))) for r in pairs.collect()}
    want = set()
    for a in sets:
        for b in sets:
            both = len(set(sets[a]) & set(sets[b]))
            if a < b and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                want.add((a, b))
    assert got == want and want


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (None, 3), (7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got.get(k, k) for k in range(1, 41)}) == 1 and len({got.get(k, k) for k in range(100, 160)}) == 1
    assert 200 not in got


def plain_lines(rows):
    held = defaultdict(set)
    key = lambda line: re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(SPACES))
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(d)
    drop = {k: max(v) for k, v in held.items() if len(v) >= 3}
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in drop or drop[key(x)] == d]
        out[d] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_line_dedup_equals_plain_python(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in queries.op6_line_dedup(spark, sf_dir).collect()}
    assert got == plain_lines(rows)
    assert sum(v[1] for v in got.values()) > 0


def test_line_dedup_bitmaps_and_hot_lines(spark):
    hot = "this line is in every single document of all"
    rows = [(k, f"own line {k} that nobody else has at all\n{hot.upper() if k % 2 else '  ' + hot}\nend {k}\n{hot}") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    maps = {r["doc"]: r["keep_runs"] for r in line_dedup.keep_bitmaps(docs).collect()}
    assert maps[3] == [1, 1, 1, 1] and 1499 not in maps and len(maps) == 1499
    plan = line_dedup.drop_repeated_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_mixing_meets_every_target(spark, sf_dir):
    got = queries.op4_source_mix(spark, sf_dir).collect()
    source = {r["doc_id"]: r["source"] for r in table(spark, sf_dir, "documents").collect()}
    taken, target = Counter(), {}
    for r in got:
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(0 <= target[s] - taken[s] < 1 for s in target)
    again = queries.op4_source_mix(spark, sf_dir).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_mixing_caps_small_sources(spark):
    rows = [(k, "a b c d e f g h i j", "big") for k in range(40)] + [(100, "x y", "small"), (101, "z", None), (102, None, "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {r["doc"]: r for r in mixing.mix_plan(docs).collect()}
    assert plan[100]["target"] == 6.0 and plan[101]["target"] == 3.0 and plan[0]["target"] == 403 - 9
    assert plan[100]["taken"] == 6 and plan[101]["taken"] == 3 and plan[102]["taken"] == 0
    mixed = mixing.mix(docs).collect()
    assert sum(len(r["text"].split()) for r in mixed) == 403
    assert sum(r["taken"] for r in mixed) == 403


def test_rows_without_an_id_spread_over_the_ranges(spark):
    rows = [(None, f"a b {k}", "s") for k in range(400)] + [(k, "a b", None) for k in range(5)]
    placed = mixing._placed(spark.createDataFrame(rows, "doc_id long, text string, source string"), (1, 2, 3), 3, "mix", "doc_id", "text", "source")
    per = Counter(r["range"] for r in placed.where("source = 's'").collect())
    assert len(per) == 16 and max(per.values()) < 60
    ends = sorted((r["before"], r["before"] + r["size"]) for r in placed.where("source = 's'").collect())
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_mix_keeps_to_its_budget_where_rows_repeat(spark):
    ten, four = " ".join("abcdefghij"), "k l m n"
    rows = [(1, ten, "a", k % 3, len(ten)) for k in range(30)] + [(None, ten, "b", k, len(ten)) for k in range(30)]
    rows += [(100 + k, f"{four} {k}", "a", 0, 0) for k in range(12)] + [(1, ten, "c", 0, len(ten)), (None, None, "c", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra long, n_chars long")
    plan = mixing.mix_plan(docs).collect()
    want = Counter()
    for r in plan:
        want[r["source"]] += r["taken"]
    for _ in range(2):
        got, passes = Counter(), Counter()
        for r in mixing.mix(docs).collect():
            assert len(r["text"].split()) == r["taken"] and (r["taken"] == r["size"] or r["n_chars"] == len(r["text"]))
            got[r["source"]] += r["taken"]
            passes[r["source"], r["doc_id"], r["extra"], r["epoch"]] += 1
        assert got == want and 0 <= sum(r["size"] for r in plan) - sum(got.values()) < 3
    assert max(v for (s, *_), v in passes.items() if s == "b") == 1


def test_decontamination_finds_planted_items(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((8, 30, 60, 3, 120))]
    pad = lambda n: " ".join(word() for _ in range(n))
    rows = [(k, f"{pad(50)} {t.upper()}. {pad(70)}") for k, t in items]
    changed = items[4][1].split()
    changed[60] = "other"
    rows += [(10, f"{pad(20)} {' '.join(changed)} {pad(9)}"), (11, pad(400)), (12, ""), (13, None), (14, items[1][1][:60])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items + [(90, ""), (91, None)], "item_id long, text string")
    found = decontaminate.contaminated(docs, bench)
    assert {(r["doc"], r["item"]) for r in found.collect()} == {(k, k) for k in range(5)} | {(10, 4)}
    for bound in ({"block_chars": 300}, {"block_items": 2}):  # several passes find the same
        some = decontaminate.contaminated(docs, bench, **bound)
        assert {tuple(r) for r in some.collect()} == {tuple(r) for r in found.collect()}
    assert {r["doc_id"] for r in decontaminate.without_contaminated(docs, bench).collect()} == {11, 12, 13, 14}


def test_decontamination_equals_all_windows(spark, sf_dir):
    """Every window of an item's size, without the index."""
    import numpy as np

    bench = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    words = decontaminate.WordHash()
    items = [(k, words.array(decontaminate.tokens(t))) for k, t in bench]
    bags = {k: decontaminate.shingle_hashes(w, decontaminate.WIDTH) for k, w in items}
    count = Counter(s for bag in bags.values() for s in set(bag.tolist()))
    weights = {s: decontaminate.shingle_weight(len(items), c) for s, c in count.items()}
    other = decontaminate.shingle_weight(len(items), 0)
    want = set()
    for r in table(spark, sf_dir, "documents").collect():
        doc = words.array(decontaminate.tokens(r["text"] or ""))
        all_shingles = decontaminate.shingle_hashes(doc, decontaminate.WIDTH)
        for k, item in items:
            if not np.isin(bags[k], all_shingles).any():
                continue  # similarity 0 everywhere
            n = min(len(item), len(doc))
            for at in range(len(doc) - n + 1):
                window = decontaminate.shingle_hashes(doc[at : at + n], decontaminate.WIDTH)
                if np.isin(bags[k], window).any() and decontaminate.weighted_similarity(window, bags[k], weights, other, 0.0) >= 0.8:
                    want.add((r["doc_id"], k))
                    break
    got = {(r["doc_id"], r["item_id"]) for r in queries.op7_benchmark_decontamination(spark, sf_dir).collect()}
    print(len(got), len(want))
    assert got <= want and len(got) >= 0.95 * len(want) and want


def test_block_index_finds_all_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    index = decontaminate.BlockIndex(prints)
    for p in prints[:40]:
        flips = rng.choice(64, decontaminate.RADIUS, replace=False)
        value = p ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64))
        assert set(index.near(value)) == set(np.flatnonzero(np.bitwise_count(prints ^ value) <= decontaminate.RADIUS))


def test_windows_lose_none_that_reaches_the_threshold():
    import numpy as np

    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(list("abcdefghij"), n)) for n in (3, 6, 9, 14, 14, 25)]
    known = decontaminate.Items(list(enumerate(texts)), {}, len(texts))
    doc = decontaminate.tokens(" ".join(rng.choice(list("abcdefghij"), 20)) + f" {texts[3]} {texts[5][:30]} k {texts[5][34:]} {texts[0]}")
    words = decontaminate.WordHash().array(doc)
    able = set(zip(*(x.tolist() for x in known.windows(words, 0.6))))
    for g, n in enumerate(known.sizes.tolist()):
        for start in range(len(words) - n + 1):
            bag = decontaminate.shingle_hashes(words[start : start + n], decontaminate.WIDTH)
            for k, item in enumerate(known.shingles):
                if len(known.hashes[k]) == n and decontaminate.weighted_similarity(bag, item, {}, known.other, known.one) >= 0.6:
                    assert (start, g) in able
    assert len(able) < sum(len(words) - n + 1 for n in known.sizes.tolist())
    starts, groups = known.windows(words, 0.0)
    sizes = known.sizes[groups]
    plain = [decontaminate.simhash(words[None, a : a + n])[0] for a, n in zip(starts, sizes)]
    assert known.prints(words, starts, sizes).tolist() == plain


def test_archives_give_the_pages_back(spark, tmp_path):
    magic = "x WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n y"
    pages = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, None), (4, "http://a/4", magic), (5, "u\r\nv", ""), (6, "http://a/6", "éè\r\n\r\nWARC/1.1\r\n"), (7, "http://a/7", magic), (8, "b", "z" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"))
    got = {int(re.search(r"-?\d+", r["record_id"]).group()): r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    first = {}
    for p, _, html in pages:
        raw = (html or "").encode()
        first.setdefault(raw, p)
        assert got[p]["payload_bytes"] == len(raw)
        assert got[p]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert got[p]["type"] == ("response" if first[raw] == p else "revisit")
        assert got[p]["refers_to"] == (None if first[raw] == p else f"<urn:page:{first[raw]}>")
    assert len(got) == len(pages)


def plain_records(raw):
    """Headers and blocks of a WARC file by its stated lengths alone."""
    at, out = 0, []
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:stop].decode().split("\r\n")
        assert version == "WARC/1.1"
        head = dict(x.split(": ", 1) for x in lines)
        at = stop + 4 + int(head["Content-Length"])
        assert raw[at : at + 4] == b"\r\n\r\n"
        out.append((head, raw[stop + 4 : at]))
        at += 4
    return out


def test_archives_are_read_by_another_reader(spark, sf_dir, tmp_path):
    warc.write_archives(table(spark, sf_dir, "pages"), str(tmp_path / "w"))
    pages = {f"<urn:page:{r['page_id']}>": (r["html"] or "").encode() for r in table(spark, sf_dir, "pages").collect()}
    seen = 0
    for file in (tmp_path / "w").glob("part-*"):
        records = plain_records(file.read_bytes())
        assert [h["WARC-Type"] for h, _ in records].count("warcinfo") == 1 and records[0][0]["WARC-Type"] == "warcinfo"
        for head, block in records:
            assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", head["WARC-Date"]) and head["WARC-Record-ID"] and head["Content-Type"]
            if head["WARC-Type"] == "warcinfo":
                continue
            seen += 1
            payload = pages[head["WARC-Record-ID"]]
            assert head["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if head["WARC-Type"] == "revisit":
                assert head["WARC-Profile"].endswith("identical-payload-digest") and pages[head["WARC-Refers-To"]] == payload
            else:
                assert block.split(b"\r\n\r\n", 1)[1] == payload
    assert seen == len(pages)


def test_archives_survive_other_splits_between_scans(spark, tmp_path, monkeypatch):
    magic = "x WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    pages = [(k, "http://a", f"{k} {magic} {k}" if k % 3 == 0 else f"page {k} " * (k % 7)) for k in range(60)]
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2), str(tmp_path / "w"))
    scan, sizes = warc._pieces, iter(("900", "2k"))

    def other(spark, path):
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
        return scan(spark, path)

    monkeypatch.setattr(warc, "_pieces", other)
    try:
        got = {r["record_id"]: r["payload_digest"] for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"<urn:page:{k}>": base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for k, _, t in pages}


def test_archives_of_pages_with_one_id_or_none(spark, tmp_path):
    pages = [(None, "u", "same"), (None, "u", "same"), (1, "u", "a"), (1, "u", "a"), (1, "u", "b"), (2, "u", "b"), (2, None, None)]
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = Counter((r["record_id"], r["type"], r["payload_bytes"], r["refers_to"]) for r in warc.read_archives(spark, str(tmp_path / "w")).collect())
    one, two, none = ("<urn:page:%s>" % k for k in (1, 2, "null"))
    assert got == {(none, "response", 4, None): 2, (one, "response", 1, None): 3, (two, "revisit", 1, one): 1, (two, "response", 0, None): 1}


def test_archive_chain_ignores_what_no_record_points_to(spark):
    rows = [("f", 0, 10), ("f", 4, 6), ("f", 6, 10), ("f", 10, 30), ("f", 30, 31), ("g", 5, 9), ("h", 0, 7)]
    got = {tuple(r) for r in warc.reachable(spark.createDataFrame(rows, "file string, at long, next long")).collect()}
    assert got == {("f", 0), ("f", 10), ("f", 30), ("h", 0)}


def plain_spans(rows, least=25):
    """(level, doc, start, end, words, kept_in) by brute force: lines, paragraphs, and runs of windows of ``least`` words."""
    rows, out = sorted(r for r in rows if r[1]), []
    shapes = {"line": r"[^\n]+", "paragraph": r"(?:[^\n]*\S[^\n]*(?:\n|\Z)){2,}"}
    for level, shape in shapes.items():
        first = {}
        for d, t in rows:
            for m in re.finditer(shape, t):
                words = m.group().lower().split()
                if len(words) >= least:
                    s = m.start() + len(m.group()) - len(m.group().lstrip())
                    keeper = first.setdefault(tuple(words), d)
                    if first.get((tuple(words), "at"), (d, s)) != (d, s):
                        out.append((level, d, s, m.start() + len(m.group().rstrip()), len(words), keeper))
                    first.setdefault((tuple(words), "at"), (d, s))
    seen = {}
    for d, t in rows:
        at = [(m.start(), m.end()) for m in re.finditer(r"\S+", t)]
        words = [t[s:e].lower() for s, e in at]
        run = []
        for k in range(len(words) - least + 2):
            window = tuple(words[k : k + least])
            if len(window) == least and seen.setdefault(window, (d, k)) != (d, k):
                run.append((k, seen[window][0]))
                continue
            if run:
                out.append(("window", d, at[run[0][0]][0], at[run[-1][0] + least - 1][1], len(run) + least - 1, min(x for _, x in run)))
            run = []
    return sorted(out)


def test_substring_spans_equal_plain_python(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    got = queries.op10_substring_dedup(spark, sf_dir).collect()
    assert sorted((r["level"], r["doc_id"], r["start"], r["end"], r["n_words"], r["kept_in"]) for r in got) == plain_spans(rows)
    assert {r["level"] for r in got} >= {"line", "window"} and all(r["n_units"] == 1 for r in got if r["level"] != "window")


def test_lines_and_paragraphs_keep_their_earliest_place(spark):
    line = lambda k, n=26: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [
        (3, f"{line(0)}\n\n  {line(1)}\n{line(2, 9)}\n \nend"), (4, f"intro\n{line(0).upper()} \n\n{line(1)}\n\t{line(2, 9)}"), (5, f"{line(2, 9)}\n{line(1)}\n\n{line(0)}"),
        (5, f"{line(2, 9)}\n{line(1)}\n\n{line(0)}"), (None, line(0)), (None, line(0)), (None, None), (6, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substring_dedup.repeated_spans(docs, ("line", "paragraph")).collect()
    assert sorted(((r["level"], r["doc"], r["n_words"], r["kept_in"]) for r in got), key=str) == sorted(
        [("line", 4, 26, 3), ("line", 4, 26, 3), ("line", 5, 26, 3), ("line", 5, 26, 3), ("line", None, 26, 3), ("paragraph", 4, 35, 3)], key=str
    )
    only = substring_dedup.repeated_spans(docs, ("paragraph",)).collect()
    assert [(r["doc"], rows[1][1][r["start"] : r["end"]]) for r in only] == [(4, f"{line(1)}\n\t{line(2, 9)}")]
    left = {(r["doc_id"], r["text"]) for r in substring_dedup.remove_spans(docs, substring_dedup.repeated_spans(docs)).collect()}
    assert left == {(3, rows[0][1]), (4, "intro\n"), (5, f"{line(2, 9)}\n\n\n"), (None, ""), (None, None), (6, "")}


def test_one_row_of_each_group_stays_where_ids_recur_or_are_null(spark):
    rng = random.Random(4)
    base, other, third = ([f"w{rng.randrange(10**6)}" for _ in range(100)] for _ in range(3))
    near = base[:-1] + ["changed"]
    a, copy, b, c = (" ".join(x) for x in (base, near, other, third))
    rows = [(3, a), (5, copy), (5, b), (None, a), (None, copy), (7, c), (7, c), (None, "alone here"), (None, "alone here"), (8, ""), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in minhash.keep_one_of_each(docs).collect()]
    want = [(3, a), (5, b), (7, c), (None, "alone here"), (8, ""), (8, "")]
    assert sorted(got, key=str) == sorted(want, key=str)


def word_windows(rows, size=25):
    """Code points of every word that lies in a window of ``size`` words which an earlier place holds, by brute force."""
    seen, out = set(), {}
    for d, t in sorted(r for r in rows if r[1]):
        at = [(m.start(), m.end()) for m in re.finditer(r"\S+", t)]
        words = [t[s:e].lower() for s, e in at]
        for k in range(len(words) - size + 1):
            window = tuple(words[k : k + size])
            if window in seen:
                out.setdefault(d, set()).update(range(at[k][0], at[k + size - 1][1]))
            seen.add(window)
    return out


def spanned(spans):
    out = {}
    for r in spans.collect():
        out.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    return out


def test_substring_finds_whole_passages_wherever_they_stand(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    plain = [word() for _ in range(150)]  # no mark at all
    clipped = [w + "." if k % 2 else w for k, w in enumerate(word() for _ in range(60))]  # clauses of two words
    rows, want = [], {}
    for k, passage in enumerate([plain, clipped, plain[40:90], clipped[5:30], plain[:24]]):
        for again in (False, True):
            head, tail = [[word() for _ in range(rng.randint(3, 30))] for _ in range(2)]
            text = [" ".join(x.upper() if again else x for x in (" ".join(head), (" \n" if again else " ").join(passage), " ".join(tail)))]
            rows.append((10 * k + again, text[0]))
            start = len(" ".join(head)) + 1
            if len(passage) >= 25 and (again or k in (2, 3)):
                want[10 * k + again] = set(range(start, len(text[0]) - len(" ".join(tail)) - 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.repeated_spans(docs, ("window",)).withColumnRenamed("doc", "doc_id")
    assert spanned(got) == want
    assert {r["doc_id"]: r["n_words"] for r in got.collect()} == {1: 150, 11: 60, 20: 50, 21: 50, 30: 25, 31: 25}


def test_substring_covers_all_windows_that_recur(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    assert spanned(queries.op10_substring_dedup(spark, sf_dir)) == word_windows(rows)


def test_substring_counts_words_of_equal_rows_once(spark):
    passage = " ".join(f"word{k}" for k in range(30))
    docs = spark.createDataFrame([(1, passage), (2, passage), (2, passage)], "doc_id long, text string")
    for level in ("window", "line"):
        assert [(r["doc"], r["n_words"]) for r in substring_dedup.repeated_spans(docs, (level,)).collect()] == [(2, 30)]


def test_substring_cuts_keep_the_rest(spark):
    passage = "Here is a long passage, with commas; and sixteen words or more of text. It goes on, for a good while longer, until it ends at last somewhere."
    docs = spark.createDataFrame([(1, f"Start one. {passage} End one."), (2, f"Begin two. {passage} Finish two."), (3, None)], "doc_id long, text string")
    spans = substring_dedup.repeated_spans(docs)
    left = {r["doc_id"]: r["text"] for r in substring_dedup.remove_spans(docs, spans).collect()}
    assert left[1] == f"Start one. {passage} End one." and left[2] == "Begin two.  Finish two." and left[3] is None


def test_dedup_operators_take_odd_rows(spark, tmp_path):
    docs = clashing(spark.createDataFrame(CASES, SCHEMA))
    bench = spark.createDataFrame([(1, "a b c d e f"), (None, None)], "item_id long, text string")
    for df in (docs, docs.limit(0)):
        n = df.count()
        assert minhash.near_duplicates(df).count() == n
        assert minhash.keep_one_of_each(df).columns == docs.columns
        assert line_dedup.drop_repeated_lines(df).columns == docs.columns and line_dedup.drop_repeated_lines(df).count() == n
        assert decontaminate.without_contaminated(df, bench).count() == n
        assert decontaminate.without_contaminated(df, bench.limit(0)).columns == docs.columns
        assert mixing.mix_plan(df).count() == n
        assert set(mixing.mix(df).columns) == set(docs.columns)
        assert substring_dedup.remove_spans(df, substring_dedup.repeated_spans(df)).columns == docs.columns
        pages = df.selectExpr("doc_id page_id", "lang url", "text html", "doc", "th", "size")
        path = str(tmp_path / f"w{n}")
        warc.write_archives(pages, path)
        assert warc.read_archives(spark, path).count() == n

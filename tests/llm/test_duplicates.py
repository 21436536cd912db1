"""Operators 1, 3, 4 and 9 beside brute force."""

import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from cartulary.llm import decontaminate, lines, simhash, substrings
from cartulary.llm.components import connected_components

from .fixtures import documents, empty, keyed, prose, texts


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    counts = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def groups_of(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_simhash(spark):
    docs = keyed(spark)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts())}
    linked = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    labels = groups_of(fps, linked)
    assert got == {i: (f"{fps[i]:016x}", labels[i]) for i in fps}
    assert sorted(r["doc_id"] for r in simhash.first_of_each_group(docs).collect()) == sorted({labels[i] for i in fps})
    assert sorted(r["doc_id"] for r in simhash.first_of_each_group(documents(spark)).collect()) == sorted({labels[i] for i in fps})
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.near_duplicates(documents(spark)).count() == len(texts()) + 2


def test_different_texts_under_one_key_stay(spark):
    rows = [(1, prose(40, 80)), (5, prose(41, 80)), (5, prose(42, 80)), (5, prose(42, 80)), (6, prose(42, 80)), (7, prose(41, 80))]
    got = simhash.first_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(set(rows[:4]))


def test_ball_links_connect_all_within_three_bits(spark):
    import random

    r = random.Random(5)
    values = set()
    for _ in range(60):
        x = r.getrandbits(64)
        values.add(x)
        for _ in range(3):
            for _ in range(r.randint(1, 4)):
                x ^= 1 << r.randrange(64)
            values.add(x)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame(list(zip(signed, range(len(values)))), "fp long, node long")
    found = [(row.a, row.b) for row in simhash.ball_links(nodes).collect()]
    assert all((values[a] ^ values[b]).bit_count() <= 3 for a, b in found)
    true = [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 3]
    assert groups_of(range(len(values)), found) == groups_of(range(len(values)), true)


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(50, 90)]
    got = dict(connected_components(spark.createDataFrame([*path, *star, (3, 3), *star], "a long, b long")).collect())
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in [7, *range(50, 90)]}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def near(a, b):
    if a == b:
        return True
    x, y = a.split(" "), b.split(" ")
    if (len(x) < lines.MIN_WORDS) != (len(y) < lines.MIN_WORDS):
        return False
    if len(x) < lines.MIN_WORDS:
        if min(len(a), len(b)) < lines.MIN_CHARS:
            return False
        x, y = list(a), list(b)
    if abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(u != v for u, v in zip(x, y)) <= 1
    short, long = sorted((x, y), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def test_line_dedup(spark):
    extra = [
        (103, "a heading of 21 chars\na heading of 22 chars\nheading of 21 chars\nheading of 31 chars\nten chars1\nten chars2\nA heading of 21 chäрs\nA heading of 21 chäрz"),
        (104, "a heading of 21 char\nnine words that differ by one of them only\nnine words that differ by two of them only\nseven words that differ by one here"),
        (105, "seven words that differ by one there\nseven words that differ by one her\nseven words that differ by a here"),
        (-7, "a negative key comes first\nshort of words and a negative key"), (-6, "a negative key comes first\nshort of words and a negative kay\nx"),
        (100, prose(13, 9) + "\n" + prose(12, 12).replace(" ", " more ", 1)), (101, prose(12, 12) + "\nshort\n\nshort"), (102, prose(12, 12).split(" ", 1)[1]),
    ]
    rows = [*enumerate(texts()), *extra]
    docs = keyed(spark).select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    seen, want = [], {}
    for i, t in sorted(rows):
        kept = []
        for line in (t or "").split("\n"):
            gone = line.strip(" ") != "" and any(near(line, s) for s in seen)
            kept += [] if gone else [line]
            seen += [line] if line.strip(" ") else []
        n = len(t.split("\n")) if t is not None else 0
        want[i] = (n, n - len(kept) if t is not None else 0, None if t is None else "\n".join(kept))
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in lines.dedup_lines(docs).collect()}
    assert got == want
    assert any(w[1] for w in want.values())
    assert lines.dedup_lines(empty(spark)).count() == 0
    all_rows = lines.dedup_lines(documents(spark))
    clash = documents(spark).withColumn("gone", F.lit("own")).withColumn("k", F.lit(1)).withColumn("n_lines", F.lit("own"))
    assert lines.dedup_lines(clash, counts=("x", "y")).select(*clash.columns).where("gone = 'own' AND k = 1 AND n_lines = 'own'").count() == len(texts()) + 2
    assert all_rows.count() == len(texts()) + 2 and all_rows.columns == [*documents(spark).columns, "n_lines", "n_removed"]


def test_lines_of_rows_that_share_a_key(spark):
    rows = [(1, "first line\nunique precious line"), (1, "first line\nanother"), (1, "first line\nanother"), (2, "another\nlast"), (None, "last\nfirst line")]
    got = [tuple(r)[:2] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    kept = "\n".join(t for k, t in got if k == 1).split("\n")
    assert len(got) == 5 and {"first line", "unique precious line", "another"} == set(kept) and kept.count("unique precious line") == 1
    assert (2, "last") in got and (None, "last\nfirst line") in got


def test_a_document_of_many_lines(spark):
    import time

    text = "\n".join(f"line {i % 60_000} of a long document that has many of them" for i in range(80_000))
    began = time.perf_counter()
    got = lines.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["n_lines"] == 80_000 and got["text"] == text.split("\n")[0] and time.perf_counter() - began < 40


def test_wide_line_dedup(spark):
    def changed(line, at):
        words = line.split(" ")
        return " ".join(f"new{i}" if i in at else w for i, w in enumerate(words))

    hub = prose(30, 40)
    rows = [
        (1, "\n".join([prose(31, 19), prose(32, 20), prose(33, 32), "a short line of words", "tiny line", hub])),
        (2, "\n".join([changed(prose(31, 19), {2, 9}), changed(prose(32, 20), {0, 19}), changed(prose(33, 32), {3, 11, 30}), "a short line of word", "tiny lime"])),
        (3, "\n".join([changed(prose(32, 20), {1, 9, 17}), changed(prose(33, 32), {1, 9, 17, 25}), "a short tine of words", "a short time of word"])),
        # Far from the earliest line of their first segment, near to each other.
        (4, changed(hub, set(range(12, 30))) + "\n" + changed(hub, {5, *range(12, 30)})),
        (5, changed(hub, {*range(12, 30), 33, 35, 37})),
    ]

    def goes(line, earlier):
        if line in earlier or any(near(line, e) for e in earlier):
            return True
        words = line.split(" ")
        same = [sum(x != y for x, y in zip(words, e.split(" "))) for e in earlier if len(e.split(" ")) == len(words)]
        bound = 3 if len(words) >= 32 else 2 if len(words) >= 20 else 0
        return bool(bound) and any(d <= bound for d in same)

    seen, want = [], {}
    for i, t in rows:
        want[i] = []
        for line in t.split("\n"):
            want[i] += [] if goes(line, seen) else [line]
            seen.append(line)
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), wide=True).collect()}
    assert got == {i: "\n".join(kept) for i, kept in want.items()}
    # The 20-character line goes, as do two and three replaced words; the earliest of each segment does not decide alone.
    assert [len(want[i]) for i in (1, 2, 3, 4, 5)] == [6, 2, 3, 1, 0]
    assert lines.dedup_lines(empty(spark), wide=True).count() == 0


def plain_windows(rows, window=35):
    words = {i: (t or "").encode().split() for i, t in rows}
    starts = {}
    for i, w in words.items():
        for s in range(len(w) - window + 1):
            starts.setdefault(tuple(w[s : s + window]), []).append((i, s))
    gone = {i: set() for i in words}
    for places in starts.values():
        if len(places) > 1:
            for i, s in places:
                gone[i].update(range(s, s + window))
    return {i: (len(w), len(gone[i]), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone[i])).hexdigest()) for i, w in words.items()}


def test_substrings(spark):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.substring_report(keyed(spark)).collect()}
    want = plain_windows(list(enumerate(texts())))
    assert got == want and sum(w[1] > 0 for w in want.values()) >= 6
    assert substrings.substring_report(empty(spark)).count() == 0
    repeated = {r["doc_id"]: r["n_removed"] for r in substrings.dedup_substrings(documents(spark)).collect()}
    assert repeated[0] == 50  # the row stands twice


def test_grounds_are_the_same_wherever_the_words_are():
    shared = prose(20, 200).split(" ")
    one = [w.encode() for w in prose(21, 50).split(" ") + shared]
    two = [w.encode() for w in shared + prose(22, 70).split(" ")]
    text, low, length, key = substrings.grounds([one, [], two])
    inside = lambda t, shift: {(a - shift, n, k) for i, a, n, k in zip(text, low, length, key) if i == t and a >= shift and a + n <= shift + 200}
    assert inside(0, 50) == inside(2, 0) and len(inside(2, 0)) > 10


@pytest.mark.parametrize("block_words", [500_000, 30])
def test_decontamination(spark, block_words):
    shared = prose(2, 60).split(" ")
    items = [(1, " ".join(shared[:20])), (2, "two WORDS"), (3, None), (4, "..."), (5, " ".join(shared[10:40])), (6, "one"), (1, " ".join(shared[:20]))]
    W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: W.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for k, t in items:
        w = words(t)
        m = min(13, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(str(k))
    want = {}
    for i, t in enumerate(texts()):
        w, hit, found = words(t), set(), set()
        for m in {len(x) for x in windows}:
            for s in range(len(w) - m + 1):
                if keys := windows.get(tuple(w[s : s + m])):
                    hit.update(range(s, s + m))
                    found |= keys
        want[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    table = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.decontaminate(keyed(spark), table, block_words=block_words, clean=True).collect()
    assert {r["doc_id"]: tuple(r)[1:6] for r in out} == want
    assert any(w[1] for w in want.values())
    assert all(r["clean_text"] == texts()[r["doc_id"]] for r in out if not r["n_hit"])
    kept = decontaminate.contaminated_keys_gone(keyed(spark), table)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, w in want.items() if not w[4])
    assert decontaminate.decontaminate(keyed(spark), table.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(empty(spark), table).count() == 0


def test_short_lines_are_compared_as_one_likes(spark):
    docs = spark.createDataFrame([(1, "one two three\nab\nq"), (2, "one two tree\nac\nq"), (3, "one two other")], "doc_id long, text string")
    left = lambda **options: [r["text"] for r in lines.dedup_lines(docs, **options).orderBy("doc_id").collect()]
    assert left() == ["one two three\nab\nq", "one two tree\nac", "one two other"]
    assert left(units=(8, 2)) == ["one two three\nab\nq", "", "one two other"]
    assert left(units=(2, 0))[1:] == ["", ""]

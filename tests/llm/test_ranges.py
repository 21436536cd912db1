"""Operators 11, 12 and 13, which sort and sweep ranges, beside plain versions of themselves."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartulary.llm import merkle, tries, urls

from .fixtures import documents, empty


@pytest.fixture(params=[1, 13])
def ranges(spark, request):
    """So few and so many ranges."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", was)


# --- operator 11: URL filters ------------------------------------------------------------------------------------------


def parts_of(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]


def plain_verdict(url, rules, default="allow"):
    host, path = parts_of(url)
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, default)


AWKWARD = [
    None, "", "no scheme", "http://", "http:///x", "HTTP://Example.NET/EN/a", "http://example.net/en/a?b=://c", "http://a.example.net:80/en/", "http://u@example.net/en/", "http://example.net", "http://net", "http://net/",
    "http://xnet/", "http://a.b.c.d.example.net/en/1#f", "http://example.com/de", "http://example.com/de/", "http://x.org/fr/?q", "http://x.org?/fr/", "http://..net/", "http://net./", "x://y://example.com/de/1", "http://example.net/en/" + "q" * 3000,
    "http://" + "a." * 2000 + "example.net/en/", "http://ÉÀ.net/é", "http://ex\nample.net/\nen/",
]


def test_urls_by_hand(spark, ranges):
    rows = [(None if i % 6 == 5 else i % 9, u, f"h{i}", "own") for i, u in enumerate(AWKWARD * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, key string")
    got = urls.filter_urls(pages, spark.createDataFrame(urls.RULES, "host string, path string, verdict string"))
    assert got.columns == ["page_id", "url", "key", "host", "path", "rule", "verdict"]
    want = Counter((r[0], r[1], "own", *plain_verdict(r[1], urls.RULES)) for r in rows)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert urls.url_report(pages.limit(0)).count() == 0


def test_nested_rules_of_hosts_and_paths(spark, ranges):
    r = random.Random(7)
    label, step = ["a", "b", "a-b", "0", "é"], ["x", "y", "xy", "%2F"]
    host = lambda n: ".".join(r.choice(label) for _ in range(r.randint(1, n)))
    path = lambda n: "/" + "/".join(r.choice(step) for _ in range(r.randint(0, n)))
    rules = list({(host(3), path(2)[: r.randint(0, 5)]): r.choice(["allow", "block"]) for _ in range(150)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    rows = [(i, f"http://{host(4)}{path(3)}?{i % 3}") for i in range(700)] + [(i, "http://b.a/x/y") for i in range(400)]
    given_rules = [*rules, *[(h.upper() if h.isascii() else h, p, "allow") for h, p, v in rules[:20]], (None, "/", "block"), ("nowhere", None, "block")]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(given_rules, "host string, path string, verdict string"), default="block").collect()
    want = Counter((i, *plain_verdict(u, rules, "block")) for i, u in rows)
    assert Counter((x["page_id"], x["host"], x["path"], x["rule"], x["verdict"]) for x in got) == want
    assert len({x["rule"] for x in got}) > 30


def test_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    got = urls.filter_urls(pages, spark.createDataFrame([], "host string, path string, verdict string")).first()
    assert (got["rule"], got["verdict"]) == (None, "allow")


# --- operator 12: prefix trie ------------------------------------------------------------------------------------------


def plain_arrays(rows, hundred=100, heads=6):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        out[c] = [*own.get(c - c % hundred, [])[:h], *turns[h:]]
    return out


def plain_trie(arrays):
    members, ends = defaultdict(set), defaultdict(list)
    for c, s in arrays.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].add(c)
        ends[tuple(s)].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()
    )


def talk(r, n_convs, n_texts, longest):
    rows = []
    for c in range(n_convs):
        conv = r.choice([c, c + 100, c * 7 + 3])
        rows += [(conv, t, r.choice(["user", "assistant"]), f"é{r.randrange(n_texts)}") for t in range(r.randint(1, longest))]
    return list({(c, t): (c, t, role, text) for c, t, role, text in rows}.values())


@pytest.mark.parametrize("texts, block", [(2, 1), (2, 1 << 16), (40, 3)])
def test_trie_beside_a_plain_one(spark, ranges, texts, block):
    rows = talk(random.Random(texts), 260, texts, 7)
    rows += [(5000 + i, t, "user", "é0") for i in range(60) for t in range(3)]  # a hot conversation
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = tries.trie(tries.rebuilt(df), block).collect()
    assert Counter(tuple(r) for r in got) == plain_trie(plain_arrays(rows))
    assert list(got[0].asDict()) == tries.COLUMNS


def test_trie_of_awkward_turns(spark, ranges):
    rows = [
        (1, None, "user", "first"), (1, 0, None, "second"), (1, 1, "user", None), (1, 2, "", ""), (100, 5, "user", "x" * 50_000), (101, 5, "user", "x" * 50_000), (101, 5, "user", "x" * 50_000), (-3, 0, "a", "b"),
        (203, 0, "gone", "no base"), (None, 0, "user", "nobody's"), (200, 0, "a1", "b"), (300, 0, "a", "1b"), (9, 0, None, None),
    ]
    df = spark.createDataFrame([(*r, 1, "own") for r in rows], "conv_id long, turn long, role string, text string, depth int, key string")
    rows[7:8] = []  # the remainder of a negative number is that of SQL
    got = Counter(tuple(r) for r in tries.trie_report(df.where("conv_id IS NULL OR conv_id >= 0")).collect())
    assert got == plain_trie(plain_arrays(rows))
    assert (1, 0, None, len(plain_arrays(rows)), *[x for x in next(k for k in got if k[1] == 0)[4:]]) in got
    assert tries.trie_report(df).where("depth = 0").first()["conv_id"] == -3
    assert tries.trie_report(df.limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(a=st.lists(st.integers(0, 2), max_size=9), b=st.lists(st.integers(0, 2), max_size=9))
def test_common_symbols(a, b):
    to = lambda s: b"".join(bytes([x]) * tries.SYMBOL for x in s)
    want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert tries.common(to(a), to(b)) == want


# --- operator 13: Merkle manifest --------------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(fields):
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields])


def plain_tree(leaves):
    """Levels, and per leaf the (left, right) siblings on the way up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for nodes in levels[:-1]:
            run = i // 3 * 3
            path.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
            i //= 3
        paths.append(path)
    return levels[-1][0], paths


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        made[s] = plain_tree([plain_leaf(r) for r in groups[s]])
    root, tops = plain_tree([made[s][0] for s in names])
    out = Counter()
    for s, top in zip(names, tops):
        for r, path in zip(groups[s], made[s][1]):
            whole, leaf = [*path, *top], plain_leaf(r)
            now = plain_leaf((*r[:4], r[4].replace("\n", ""))) if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else leaf
            for left, right in whole:
                now = H(left, now, right)
            out[(r[0], leaf, made[s][0], root, H(*[x for p in whole for x in p]), now, now == root)] += 1
    return out


def manifest_of(docs):
    return Counter(tuple(r) for r in merkle.manifest_report(docs).collect())


def test_manifest_of_awkward_documents(spark, ranges):
    docs = documents(spark)
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()]
    got = manifest_of(docs)
    assert got == plain_manifest(rows) and {v for *_, v in got} == {True, False}
    assert merkle.manifest_report(empty(spark)).collect() == []


@pytest.mark.parametrize("sizes", [[1], [28], [1, 3, 10, 27], [400, 1, 9, 1, 1, 82], [2] * 40])
def test_manifests_of_any_size(spark, ranges, sizes):
    r = random.Random(len(sizes))
    rows = [(r.randrange(400), None if g == 1 else f"é{g}", None, i, f"text {i % 5}\nmore") for g, n in enumerate(sizes) for i in range(n)]
    r.shuffle(rows)
    assert manifest_of(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")) == plain_manifest(rows)


def test_rows_of_one_key_are_dealt_out(spark, ranges):
    rows = [(7, "s", "en", 1, "same")] * 300 + [(7, "s", "en", 2, "other")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert manifest_of(docs) == plain_manifest(rows)


@pytest.mark.parametrize("total", [1, 2, 9, 10, 100])
def test_nodes_beside_a_segment(total):
    """Whatever the segment, what it makes and what it asks for is all that its paths need."""
    leaves = [H(str(i)).encode() for i in range(total)]
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([merkle.digest(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    root, paths = plain_tree([x.decode() for x in leaves])
    for start in range(0, total, 1 if total < 20 else 7):
        for n in {1, 2, 5, 13, total - start}:
            if 0 < n <= total - start:
                beside = {(level, i): levels[level][i] for level, i in merkle.Segment.wanted(start, n, total)} if n < total else {}
                assert len(beside) <= 4 * len(levels)
                segment = merkle.Segment(start, leaves[start : start + n], total, beside)
                for i in range(start, start + n):
                    assert [(a.decode(), b.decode()) for a, b in segment.path(i)] == paths[i]
                    assert merkle.fold(leaves[i], segment.path(i)).decode() == root


def test_subroots_change_only_where_a_row_does(spark):
    docs = documents(spark)
    other = docs.withColumn("text", F.when(F.col("doc_id") == 1, "changed").otherwise(F.col("text")))
    before, after = ({r["doc_id"]: r for r in merkle.manifest(d).collect()} for d in (docs, other))
    same = {k for k in before if before[k]["subroot"] == after[k]["subroot"]}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    assert same == {k for k in before if source[k] != source[1]} and before[0]["root"] != after[0]["root"]

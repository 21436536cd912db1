"""Operators 2, 6, 7 and 8 beside plain versions of themselves, and the pipeline on awkward rows."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from cartulary.llm import bpe, decontaminate, gif, language, pipeline, quality, shards

from .fixtures import documents, empty, prose, texts


# --- operator 2: k-d tree --------------------------------------------------------------------------------------------


def plain_tree(rows, dimensions, shards_wanted=None, target=None):
    """rows: (key, weight, values by dimension) -> leaf of each key, by sorting every cell."""
    whole = {d: max(max(r[2][d] for r in rows) - min(r[2][d] for r in rows), 1) for d in dimensions}

    def split(cell, parts):
        weight = sum(r[1] for r in cell)
        if target is not None:
            parts = 2 * (weight > target)
        if parts < 2 or len(cell) < 2:
            return [cell]
        by = max(dimensions, key=lambda d: (max(r[2][d] for r in cell) - min(r[2][d] for r in cell)) / whole[d])
        cell = sorted(cell, key=lambda r: (r[2][by], r[0]))
        wanted, sums = weight * (parts // 2) / parts, list(itertools.accumulate(r[1] for r in cell))
        at = next(i for i, s in enumerate(sums) if s >= wanted)  # the row that reaches the wanted weight
        before = sums[at - 1] if at else 0
        cut = at + 1 if sums[at] - wanted <= wanted - before else at
        return split(cell[:cut], parts // 2) + split(cell[cut:], parts - parts // 2)

    return {r[0]: i for i, leaf in enumerate(split(rows, shards_wanted or 0)) for r in leaf}


@pytest.mark.parametrize("options", [{"shards": 8}, {"shards": 5}, {"shards": None, "target_bytes": 900}])
def test_medians_of_the_tree(spark, options):
    r = random.Random(11)
    made = [(i, "x" * int(r.paretovariate(1.1) * 20 % 700), r.choice(["en", "fr", "de"]), f"s{min(int(r.expovariate(0.5)), 6)}") for i in range(240)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    crc = lambda s: zlib.crc32(s.encode())
    rows = [(i, len(t) + 1, {"size": len(t) + 1, "source": crc(s), "lang": crc(lang), "place": i}) for i, t, lang, s in made]
    want = plain_tree(rows, ["size", "source", "lang", "place"], options.get("shards"), options.get("target_bytes"))
    got = shards.assign(docs, **options).collect()
    assert {x["doc_id"]: x["shard"] for x in got} == want
    for shard in set(want.values()):
        own = sorted((x["slot"], x["doc_id"]) for x in got if x["shard"] == shard)
        assert [s for s, _ in own] == list(range(len(own))) and [d for _, d in own] == sorted(d for _, d in own)


# --- operator 6: GIF written by other means --------------------------------------------------------------------------


def plain_lzw(pixels, size, defer=False):
    """Codes of growing width, one bit after the other; with defer the full table stays, else it is cleared."""
    clear, end = 1 << size, (1 << size) + 1
    bits, width, table = [], size + 1, {}

    def put(code):
        bits.extend(code >> i & 1 for i in range(width))

    def fresh():
        return {(i,): i for i in range(1 << size)}

    put(clear)
    table, free, run = fresh(), end + 1, ()
    for p in pixels:
        if (*run, p) in table:
            run = (*run, p)
            continue
        put(table[run])
        if free < 4096:
            table[*run, p] = free
            free += 1
            if free - 1 == 1 << width and width < 12:
                width += 1
        elif not defer:
            put(clear)
            table, free, width = fresh(), end + 1, size + 1
        run = (p,)
    put(table[run])
    free += 1
    if free - 1 == 1 << width and width < 12 and free <= 4096:
        width += 1
    put(end)
    bits += [0] * (-len(bits) % 8)
    return bytes(sum(b << i for i, b in enumerate(bits[k : k + 8])) for k in range(0, len(bits), 8))


def plain_gif(pixels, width, height, size, interlaced=False, defer=False):
    palette = bytes(x for i in range(1 << size) for x in (i % 256, 255 - i % 256, 7))
    rows = [pixels[y * width : (y + 1) * width] for y in range(height)]
    if interlaced:
        rows = [rows[y] for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, height, step)]
    stream = plain_lzw([p for r in rows for p in r], size, defer)
    blocks = b"".join(bytes([len(stream[i : i + 255])]) + stream[i : i + 255] for i in range(0, len(stream), 255)) + b"\0"
    head = b"GIF89a" + width.to_bytes(2, "little") + height.to_bytes(2, "little") + bytes([0x80 | size - 1, 0, 0]) + palette
    return head + b"\x2c" + b"\0\0\0\0" + width.to_bytes(2, "little") + height.to_bytes(2, "little") + bytes([0x40 * interlaced, size]) + blocks + b"\x3b"


@pytest.mark.parametrize("size", [2, 3, 5, 7, 8])
@pytest.mark.parametrize("interlaced", [False, True])
def test_gifs_of_all_code_sizes(size, interlaced):
    r = random.Random(size)
    width, height = 31, 29
    pixels = [r.randrange(1 << size) if r.random() < 0.6 else 1 for _ in range(width * height)]
    (frame,) = gif.parse(plain_gif(pixels, width, height, size, interlaced))[2]
    assert frame.pixels.ravel().tolist() == pixels


@pytest.mark.parametrize("defer", [False, True])
def test_full_tables_with_and_without_clear_codes(defer):
    r = random.Random(3)
    width, height = 200, 150
    pixels = [r.randrange(256) for _ in range(width * height)]
    data = plain_gif(pixels, width, height, 8, defer=defer)
    (frame,) = gif.parse(data)[2]
    assert frame.pixels.ravel().tolist() == pixels
    ((_, canvas),) = gif.shown(data)
    assert canvas[0, :3].tolist() == [[p, 255 - p, 7, 255] for p in pixels[:3]]


def test_hostile_and_broken_gifs_are_rows_with_errors(spark):
    good = plain_gif([1] * 16, 4, 4, 2)
    huge = good[:6] + b"\xff\xff\xff\xff" + good[10:]
    frame = good.replace(b"\x2c\0\0\0\0\x04\0\x04\0", b"\x2c\0\0\0\0\xff\xff\xff\xff")
    rows = [(1, good), (2, huge), (3, frame), (4, good[:18]), (5, good[:13]), (6, b""), (7, None), (8, good[:-1])]
    got = gif.frames_of(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert {r["doc_id"]: r["error"] is None for r in got} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 8: True}


def test_frames_are_told_by_the_report(spark):
    docs = spark.createDataFrame([(1, prose(1, 9000)), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in gif.media_report(docs).collect()}
    size = got[1]["payload_bytes"]
    assert len(got[1]["frames"]) == -(-size // (192 * 64)) and sum(sum(f["grey"]) for f in got[1]["frames"]) == size
    assert [f["start_ms"] for f in got[1]["frames"]] == [100 * i for i in range(len(got[1]["frames"]))] and len(got[2]["frames"]) == 1


# --- operator 7: rules and lasso -------------------------------------------------------------------------------------


def test_rules_hold_as_their_comparisons_say():
    r = np.random.default_rng(5)
    x = r.random((300, len(quality.STATISTICS)))
    y = ((x[:, 1] > 0.4) ^ (x[:, 3] > 0.6)).astype(float)
    rules = quality.grow_rules(x, y)
    assert rules and all(1 <= len(rule.terms) <= 2 * quality.DEPTH for rule in rules)
    for rule in rules[:40]:
        want = [all((row[i] > t) == greater for i, greater, t in rule.terms) for row in x.tolist()]
        assert rule.holds(x).tolist() == want


def test_lasso_weights_are_where_no_step_helps():
    """Within the penalty where the weight is zero, and at it elsewhere, in the scale that the penalty is set in."""
    r = np.random.default_rng(6)
    z = (r.random((500, 30)) < 0.4).astype(float)
    y = (1 / (1 + np.exp(-(3 * z[:, 0] - 2 * z[:, 1]))) > r.random(500)).astype(float)
    penalty = 0.02
    intercept, weights = quality.lasso(z, y, penalty)
    centre, scale = z.mean(axis=0), np.maximum(z.std(axis=0), 0.05)
    error = 1 / (1 + np.exp(-(z @ weights + intercept))) - y
    slope = ((z - centre) / scale).T @ error / len(y)
    assert abs(error.mean()) < 1e-3 and np.abs(slope).max() <= penalty + 1e-3
    kept = np.abs(weights) > 1e-3
    assert kept[0] and kept[1] and 2 <= kept.sum() < 25
    assert np.allclose(slope[kept], -penalty * np.sign(weights[kept]), atol=1e-3)


def test_learning_takes_one_text_a_key(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = [(i, prose(i, 30) if i % 2 else f"| {i} | {i} |" * 20) for i in range(60)]
    once = quality.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    many = quality.learn(spark.createDataFrame(rows + rows[:30] * 3, "doc_id long, text string"), labels)
    assert once == many and once.rules


# --- operator 8: mixtures --------------------------------------------------------------------------------------------


def plain_mixture(word_logs, languages):
    """Penalised log-likelihood and proportions of the best set of languages, by trying them all."""
    n = len(word_logs)
    best = None
    for size in range(1, languages + 1):
        for chosen in itertools.combinations(range(languages), size):
            share = dict.fromkeys(chosen, 1 / size)
            for _ in range(language.ROUNDS):
                parts = []
                for w in word_logs:
                    top = max(w)
                    odds = {c: share[c] * math.exp(w[c] - top) for c in chosen}
                    whole = max(sum(odds.values()), 1e-30)
                    parts.append({c: v / whole for c, v in odds.items()})
                share = {c: sum(p[c] for p in parts) / n for c in chosen}
            fit = sum(math.log(max(sum(share[c] * math.exp(w[c] - max(w)) for c in chosen), 1e-30)) for w in word_logs)
            fit -= size * language.PRICE * math.log(n + 1)
            if best is None or fit > best[0] + 1e-3:
                best = (fit, share)
    return best[1]


def test_sets_of_languages_are_the_best_of_all_sets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    some = {r["lang"]: r["text"].split() for r in docs.where("n_chars > 3000").collect()}
    names = model.names
    made = [" ".join(some[n][:60]) for n in names] + [" ".join(some[a][:40] + some[b][40:90]) for a, b in itertools.combinations(names, 2)] + [" ".join(sum((some[n][:50] for n in names[:3]), []))]
    best, share, size = model.infer(made)
    for i, t in enumerate(made):
        logs, _, _ = model.word_logs([t])
        want = plain_mixture(logs.astype(float).tolist(), len(names))
        main = max(want, key=want.get)
        assert size[i] == len(want) and best[i] == main and abs(share[i] - want[main]) < 1e-3


def test_words_are_the_same_in_any_block():
    made = ["one", "", "Two words", None, "  ", "x", "last Éé", "123 !"]
    cells, starts, bounds = language.trigram_cells(made)
    ends = np.append(starts, len(cells))
    for i, t in enumerate(made):
        own, s, b = language.trigram_cells([t])
        e = np.append(s, len(own))
        assert [own[e[k] : e[k + 1]].tolist() for k in range(b[1])] == [cells[ends[k] : ends[k + 1]].tolist() for k in range(bounds[i], bounds[i + 1])]
        words = [w for w in "".join(c if c.isalpha() else " " for c in (t or "")).lower().split()]
        assert [e[k + 1] - e[k] for k in range(b[1])] == [len(w.encode()) for w in words]


def test_scores_are_posteriors(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs)
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    scores = [r["score"] for r in got.values() if r["lang_pred"] != "und"]
    assert len(set(scores)) > len(scores) // 2 and all(0 < s <= 1 for s in scores)
    some = next(r["text"] for r in got.values() if r["text"] and 300 < len(r["text"]) < 3000)
    logs, _, _ = model.word_logs([some])
    best = model.infer([some])[0][0]
    plain = [math.exp(w[best]) / sum(map(math.exp, w)) for w in (logs - logs.max(axis=1, keepdims=True)).astype(float).tolist()]
    assert abs(model.judge([some])[3][0] - sum(plain) / len(plain)) < 1e-5


def test_hundreds_of_languages(spark):
    rows = [(i, f"word{i:03d}a word{i:03d}b zz{i:03d}", f"l{i:03d}") for i in range(300)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.names) == 300 and model.logs.size <= language.MODEL_CELLS
    letters = [(i, " ".join(chr(97 + i // 26) + chr(97 + i % 26) + c for c in "abcdefgh"), f"l{i:03d}") for i in range(270)]
    model = language.fit(spark.createDataFrame(letters, "doc_id long, text string, lang string"))
    best, _, _ = model.infer([t for _, t, _ in letters])
    assert np.mean([model.names[b] == lang for b, (_, _, lang) in zip(best, letters)]) > 0.95


# --- the pipeline ----------------------------------------------------------------------------------------------------


def test_last_stages_beside_plain_versions(spark):
    items = spark.createDataFrame([(1, prose(2, 60)), (2, "one two three")], "item_id long, text string")
    docs = documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    kept = decontaminate.contaminated_keys_gone(docs, items, block_words=20)
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    out = {r["doc_id"]: r for r in pipeline.token_stage(spark, kept, "").collect()}
    judged = {r["doc_id"]: r["contaminated"] for r in decontaminate.decontaminate(docs, items).collect()}
    assert set(out) == {k for k, bad in judged.items() if not bad} and any(judged.values())
    for k, r in out.items():
        ids = tik.encode_ordinary(texts()[k] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_pipeline_of_awkward_rows(spark, tmp_path):
    docs = documents(spark).withColumn("lang", F.coalesce("lang", F.lit("en"))).withColumn("n_removed", F.lit("own")).withColumn("gone", F.lit(7)).withColumn("k", F.lit("own")).withColumn("spans", F.lit(1.5))
    more = [(7001, prose(2, 60) + "\n" + prose(50, 30)), (7001, prose(51, 40)), (None, prose(52, 40)), (None, prose(51, 40)), (7002, prose(53, 40)), (7002, prose(53, 40))]
    rows = spark.createDataFrame(more, "doc_id long, text string")
    docs = docs.unionByName(rows, allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(2, 60)), (2, None), (3, "...")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage, at = dict(pipeline.STAGES), spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name in ("language", "lines", "near_duplicates", "benchmark"):
        after = stage[name](spark, at, str(tmp_path))
        assert after.columns == docs.columns
        at = spark.createDataFrame(after.collect(), docs.schema)
    left = [(r["doc_id"], r["text"]) for r in at.collect()]
    assert all(r["n_removed"] in ("own", None) and r["score"] in ("own", None) for r in at.collect())
    # The contaminated one goes, both texts of the others under one key are judged, the repeated row stands once, and a null key stays
    # unless a keyed document has its text.
    assert (7001, prose(51, 40)) in left and (7001, more[0][1]) not in left and left.count((7002, prose(53, 40))) == 1
    assert (None, prose(52, 40)) in left and (None, prose(51, 40)) not in left
    assert pipeline.run(spark, str(tmp_path)).count() == len(left)
    empty(spark).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_repetitive_items_cost_steps_in_proportion():
    """No chain of links is walked for a window: twice the words take about twice the time."""
    import time

    def seconds(n):
        words = [b"same"] * n
        made = decontaminate.Automaton([("a", words), ("b", [b"same"] * 5)])
        began = time.perf_counter()
        assert made.match(words) == ([(0, n)], {"a", "b"})
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(40_000) < 25 * max(seconds(4_000), 1e-3)

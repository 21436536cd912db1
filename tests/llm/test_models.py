"""Operators 2, 6, 7 and 8, and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from cartulary.llm import gif, language, quality, shards

from .fixtures import documents, empty, keyed, texts

SF = "/root/testdata/sf0.01"


def test_shards_are_even_and_gapless(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "repeat('ab ', cast(id % 50 AS INT)) AS text", "'en' AS lang", "concat('s', id % 3) AS source")
    got = shards.shard_report(docs).toPandas()
    assert sorted(got["doc_id"]) == list(range(500)) and set(got["shard"]) == set(range(8))
    sums = got.groupby("shard")["size"].sum()
    assert sums.max() - sums.min() <= 2 * got["size"].max()
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    by_target = shards.assign(docs, shards=None, target_bytes=4000).toPandas()
    assert by_target.groupby("shard")["size"].sum().max() <= 4000


def test_shards_of_awkward_rows(spark):
    got = shards.assign(documents(spark)).collect()
    assert len(got) == len(texts()) + 2
    sizes = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got}
    assert all(sizes[i] == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in enumerate(texts()))
    assert shards.shard_report(empty(spark)).count() == 0


def test_shards_are_written_once_a_row(spark, tmp_path):
    docs = documents(spark).union(spark.createDataFrame([(3, "another text", None, None, 12, "own"), (None, "a second null key", None, None, 17, "own")], documents(spark).schema))
    path = shards.write_shards(docs, f"file://{tmp_path}/out", shards=4)
    got = spark.read.parquet(path).collect()
    whole = lambda rows: sorted(((r["doc_id"], r["text"], r["lang"], r["source"]) for r in rows), key=repr)
    assert whole(got) == whole(docs.collect())
    for shard in range(4):
        own = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert own == list(range(len(own)))


def test_gif_payloads_come_back(spark):
    got = {r["doc_id"]: r for r in gif.media_report(keyed(spark)).collect()}
    for i, t in enumerate(texts()):
        data = (t or "").encode()
        payload = data + b" " * (-len(data) % 192 or 192 * (not data))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(gif.encode(payload)), hashlib.sha256(gif.encode(payload)).hexdigest())
    assert gif.media_report(empty(spark)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 192, 12288, 60000])
def test_lzw(n):
    r = random.Random(n)
    for data in (bytes(r.randrange(256) for _ in range(n)), b"a" * n, (b"the quick brown fox " * n)[:n]):
        assert gif.lzw_decode(gif.lzw_encode(data), 8, n) == data


def _image(left, top, width, height, pixels, disposal, transparent=None, palette=None):
    control = b"\x21\xf9\x04" + bytes([disposal << 2 | (transparent is not None)]) + b"\x05\x00" + bytes([transparent or 0]) + b"\0"
    flags = 0x80 | 7 if palette is not None else 0
    place = b"\x2c" + b"".join(x.to_bytes(2, "little") for x in (left, top, width, height)) + bytes([flags]) + (palette or b"")
    return control + place + b"\x08" + gif._blocks(gif.lzw_encode(bytes(pixels)))


def test_gif_disposal_transparency_and_palettes(spark):
    grey = bytes(x for i in range(256) for x in (i, i, i))
    red = bytes(x for i in range(256) for x in (i, 0, 0))
    head = b"GIF89a\x02\x00\x01\x00" + bytes([0xF7, 0, 0]) + grey
    data = head + _image(0, 0, 2, 1, [10, 20], 1) + _image(1, 0, 1, 1, [99], 3, palette=red) + _image(0, 0, 2, 1, [7, 30], 2, transparent=7) + _image(0, 0, 1, 1, [5], 0) + b"\x3b"
    seen = [canvas[0].tolist() for _, canvas in gif.shown(data)]
    g = lambda v: [v, v, v, 255]
    assert seen == [[g(10), g(20)], [g(10), [99, 0, 0, 255]], [g(10), g(30)], [g(5), [0, 0, 0, 0]]]
    rows = gif.frames_of(spark.createDataFrame([(1, data), (2, b"no gif"), (3, None)], "doc_id long, media binary")).collect()
    assert [(r["doc_id"], r["frame"], r["start_ms"], r["n_clear"]) for r in rows] == [(1, 0, 0, 0), (1, 1, 50, 0), (1, 2, 100, 0), (1, 3, 150, 1), (2, None, None, None)]
    assert rows[4]["error"] and rows[1]["red"][99 >> 4] == 1 and sum(rows[1]["red"]) == 2


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(got) == docs.count() and (held["lang_pred"] == held["lang"]).mean() > 0.98
    assert got["score"].between(0, 1).all()


def test_language_mixture_and_awkward_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    some = {r["lang"]: r["text"] for r in docs.where("n_chars > 3000").collect()}
    best, share, size = model.infer([some["de"][:1500] + " " + some["es"][:1500], some["fr"], None, "", "123 !"])
    # Some French documents quote a line of another language, so only the share of the main one is certain.
    assert size[0] == 2 and size[2:].tolist() == [0, 0, 0] and 0.3 < share[0] < 0.7 and share[1] > 0.9 and model.names[best[1]] == "fr" and best[2:].tolist() == [-1, -1, -1]
    out = language.predict(documents(spark), model)
    assert out.columns == [*(c for c in documents(spark).columns if c != "score"), "lang_pred", "score", "n_langs"]
    assert {r["lang_pred"] for r in out.where("text IS NULL OR trim(text) = ''").collect()} == {"und"}
    assert language.identify(empty(spark)).count() == 0
    assert {r["lang_pred"] for r in language.predict(keyed(spark), language.fit(empty(spark))).collect()} == {"und"}


def test_four_languages_in_one_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    some = {r["lang"]: r["text"] for r in docs.where("n_chars > 3000").collect()}
    parts = {name: " ".join(some[name].split()[:200]) for name in model.names}
    best, share, size = model.infer([" ".join(parts.values()), " ".join([parts[n] for n in model.names[:3]]), parts["de"], None])
    assert len(parts) == 4 and size[:3].tolist() == [4, 3, 1] and 0.2 < share[0] < 0.3 and 0.3 < share[1] < 0.45 and share[2] == 1 and best[3] == -1


def test_pipeline_language_stage_rejects_and_keeps(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "n_chars")
    some = {r["lang"]: r["text"].split()[:200] for r in docs.where("n_chars > 3000").collect()}
    names, r = sorted(some), random.Random(1)
    junk = " ".join("".join(r.choice("qxzjkvwpyghf") for _ in range(r.randint(5, 9))) for _ in range(600))
    other = "текст на языке которого здесь никто не учил " * 40
    made = [
        (-1, " ".join(sum((some[n] for n in names), []))), (-2, junk), (-3, other), (-4, "123 !"), (-5, None),
        (-6, " ".join(sum((some[n] for n in names[:3]), []))), (-7, " ".join(sum((some[n] for n in names[1:]), []))), (-8, " ".join(some["de"])),
    ]
    rows = spark.createDataFrame([(i, t, None, len(t or "")) for i, t in made], "doc_id long, text string, lang string, n_chars long")
    kept = corpus_pipeline.language_stage(spark, docs.union(rows), SF).select("doc_id")
    assert sorted(x[0] for x in kept.where("doc_id < 0").collect()) == [-8, -7, -6]
    assert kept.where("doc_id >= 0").count() == docs.count()


def test_quality_on_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.quality_report(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.95 and got["score"].between(0, 1).all()
    assert ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()


def test_quality_column_is_the_model(spark):
    r = np.random.default_rng(3)
    x = r.random((400, len(quality.STATISTICS)))
    y = ((x[:, 2] > 0.5) & (x[:, 5] <= 0.7)).astype(float)
    model = quality.fit(x, y)
    own = 1 / (1 + np.exp(-(model.intercept + sum(w * rule.holds(x) for rule, w in zip(model.rules, model.weights)))))
    rows = spark.createDataFrame([tuple(map(float, v)) for v in x[:50]], ", ".join(f"{s} double" for s in quality.STATISTICS))
    assert np.allclose([v[0] for v in rows.select(model.column()).collect()], own[:50]) and ((own >= 0.5) == y).mean() > 0.97


def test_quality_of_awkward_rows(spark):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (999, 1, 0), (2, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality_report(documents(spark), labels).count() == len(texts()) + 2
    assert quality.quality_report(empty(spark), labels).count() == 0
    assert {r["score"] for r in quality.quality_report(keyed(spark), labels.limit(0)).collect()} == {0.5}


def test_pipeline_stage_by_stage(spark):
    import re

    import corpus_pipeline

    from .test_duplicates import groups_of, near, plain_fingerprint

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    after_lang = stage["language"](spark, docs, "/root/testdata/sf0.001")
    assert after_lang.columns == docs.columns
    before = sorted(after_lang.collect(), key=lambda r: r["doc_id"])
    after_lines = stage["lines"](spark, after_lang, "/root/testdata/sf0.001")
    seen, index, want = set(), {}, {}
    for r in before:
        kept = []
        for line in r["text"].split("\n"):
            words = line.split(" ")
            fuzzy, by_words = len(words) >= 8 or len(line) >= 20, len(words) >= 8
            units, sep = (words, " ") if by_words else (list(line), "")
            keys = [("", line)] + ([(i, sep.join(units[:i] + units[i + 1 :])) for i in range(len(units))] if fuzzy else [])
            close = [c for k in keys for c in index.get(k[1], ())] if fuzzy else []
            gone = line.strip(" ") != "" and (line in seen or any(near(line, c) for c in close))
            kept += [] if gone else [line]
            if line.strip(" "):
                seen.add(line)
                for _, k in keys if fuzzy else []:
                    index.setdefault(k, []).append(line)
        want[r["doc_id"]] = "\n".join(kept)
    lines_out = {r["doc_id"]: r for r in after_lines.collect()}
    assert {k: r["text"] for k, r in lines_out.items()} == want and all(r["n_chars"] == len(r["text"]) for r in lines_out.values())
    kept_docs = {r["doc_id"] for r in stage["near_duplicates"](spark, after_lines, "").collect()}
    fps = {k: plain_fingerprint(t) for k, t in want.items()}
    labels = groups_of(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3])
    assert kept_docs == set(labels.values())
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() <= len(kept_docs)


def test_a_model_of_many_languages_has_the_same_likelihoods():
    r = np.random.default_rng(3)
    texts = ["".join(chr(97 + x % 26) if x % 7 else " " for x in r.integers(0, 26 * (i % 4 + 1), 900)) for i in range(30)]
    counted = [np.unique(language.trigram_cells([t], 4096)[0], return_counts=True) for t in texts]
    cells, n = [c for c, _ in counted], [x.astype(np.float32) for _, x in counted]
    names = [f"l{i:02}" for i in range(30)]
    whole, sparse = (language.model_of(names, cells, n, 4096, most) for most in (1 << 26, 0))
    assert isinstance(sparse.logs, language.Sparse) and not isinstance(whole.logs, language.Sparse)
    asked = [*texts[:5], texts[1][:200] + texts[2][:200], None, "", "123", "a", "unseen words here"]
    for a, b in zip(whole.word_logs(asked), sparse.word_logs(asked)):
        assert np.allclose(a, b, rtol=1e-5, atol=1e-3)
    for a, b in zip(whole.judge(asked), sparse.judge(asked)):
        assert np.allclose(a, b, atol=1e-3)


def test_likelihoods_are_held_for_runs_of_texts():
    model = language.Model(["a", "b"], np.zeros((8, 2), np.float32))
    texts = ["x" * n for n in (5, 0, 1 << 24, 3, (1 << 24) - 2, 7)] + [None]
    runs = list(model.runs(texts))
    assert [(s.start, s.stop) for s in runs] == [(0, 2), (2, 3), (3, 4), (4, 5), (5, 7)]
    assert list(model.runs([])) == [slice(0, 0)]

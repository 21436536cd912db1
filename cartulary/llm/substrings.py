"""Operator 4: substring dedup by recompression.

A window is WINDOW consecutive words of one document. Words under a window whose words also start anywhere else go.

Recompression names runs of one symbol and pairs of two symbols, round by round, by hashes of what they are made of:
a name is the same wherever the same words stand, in any document and on any machine, so the rounds need no exchange of
dictionaries. In a pair round a hash of each symbol decides whether it may be the first or the second of a pair. Along
with its words, each symbol carries its ground: the words that decided how it came about, neighbours that it didn't join
included. Equal windows hold the same symbols on the same grounds, wherever a ground lies inside the window.

1. Each document sends the symbols of the last round whose ground fits a window, by the hash of the ground's words. One
   aggregation finds the symbols that stand in one place only: no window around such a ground has an equal anywhere.
2. Windows that hold no such ground may have an equal. Those are sent, by 128 bits of hash of all their words, and the
   same aggregation finds the ones that stand alone after all.
3. What is left are the repeated windows, and their words go.

Copies of a whole text are one text from the start, known by 128 bits of hash, and whoever has copies is repeated.
Both aggregations keep the least and greatest place of a key, so their rows are combined before the shuffle and a key
that a third of all rows hold is one row a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_blocks

WINDOW = 35
#: Rounds of pairs, and those of them that a round of runs precedes. After six rounds a symbol spans 5 words or so.
ROUNDS, RUNS = 6, (0,)
_ONE, _BASE = np.uint64(1), np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2**64."""
    if len(_powers.get(int(base), ())) < n:
        factors = np.full(max(n, 1 << 16), base, np.uint64)
        factors[0] = _ONE
        _powers[int(base)] = np.cumprod(factors, dtype=np.uint64)
    return _powers[int(base)][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] of each range, the same wherever the same values stand."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_INVERSE, len(values)), out=sums[1:], dtype=np.uint64)
    return _mix((sums[ends] - sums[starts]) * _power(_BASE, len(values) + 1)[starts] + (ends - starts).astype(np.uint64))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode(errors="surrogatepass").split()


def grounds(texts: list[list[bytes]], window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the last round's symbols whose ground fits a window: text, first word and number of words of the ground, and
    hash of its words. Line feeds, which no word holds, part the texts."""
    data = np.frombuffer(b"\n" + b"".join([b" " + b" ".join(x) + b" \n" if x else b" \n" for x in texts]), np.uint8).copy()
    spaces = np.flatnonzero(data == 32)
    starts, ends = np.concatenate(([0], spaces + 1)), np.append(spaces, len(data))
    wall = data[starts] == 10
    words = _range_hashes(data.astype(np.uint64) + _ONE, starts, ends)
    n = len(words)
    symbol, low, high, part = words.copy(), np.arange(n), np.arange(1, n + 1), wall
    for r in range(rounds):
        if r in RUNS:
            symbol, low, high, part = _runs(symbol, low, high, part)
        symbol, low, high, part = _pairs(symbol, low, high, part, r)
    walls = np.cumsum(wall)
    fits = ~part & (high - low <= window) & (walls[low] == walls[np.maximum(high - 1, 0)]) & ~wall[low]
    low, high = low[fits], high[fits]
    text = walls[low] - 1
    return text, low - np.flatnonzero(wall)[text] - 1, high - low, _range_hashes(words, low, high)


def _runs(symbol, low, high, part):
    """Runs of one symbol become one; that a run is not longer depends on both neighbours."""
    first = np.ones(len(symbol), bool)
    first[1:] = (symbol[1:] != symbol[:-1]) | part[1:] | part[:-1]
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(symbol)) - 1
    length = (last - at + 1).astype(np.uint64)
    name = np.where(length > 1, _mix(symbol[at] + length * _INVERSE), symbol[at])
    return name, low[np.maximum(at - 1, 0)], high[np.minimum(last + 1, len(symbol) - 1)], part[at]


def _pairs(symbol, low, high, part, r: int):
    """A symbol of the left half and one of the right half after it become one; that a symbol of the left (right) half
    stays alone depends on the next (last) symbol."""
    left = (_mix(symbol + np.uint64((r + 1) * int(_BASE) % (1 << 64))) & _ONE).astype(bool)
    n = len(symbol)
    joins = np.zeros(n, bool)
    joins[:-1] = left[:-1] & ~left[1:] & ~part[:-1] & ~part[1:]
    gone = np.zeros(n, bool)
    gone[1:] = joins[:-1]
    after, before = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
    name = np.where(joins, _mix(_mix(symbol + np.uint64(r)) + symbol[after]), symbol)
    low = np.where(joins | left, low, low[before])
    high = np.where(joins | left, high[after], high)
    stay = ~gone
    return name[stay], low[stay], high[stay], part[stay]


def candidates(n_words: int, low: np.ndarray, length: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Starts of the windows that hold none of the grounds."""
    if n_words < window:
        return np.zeros(0, np.int64)
    n = n_words - window + 1
    first, last = np.maximum(low + length - window, 0), np.minimum(low, n - 1)
    change = np.bincount(first, minlength=n + 1) - np.bincount(last + 1, minlength=n + 1)
    return np.flatnonzero(np.cumsum(change[:n]) == 0)


def _spans(batches, window: int):
    """(key, t, t2, p) of the grounds of each text that the task has not met before; p is first word * 64 + words."""
    seen: set = set()
    for batch in text_blocks(batches):
        rows = [(t, u, words_of(x)) for t, u, x in zip(*(c.to_pylist() for c in batch.columns)) if (t, u) not in seen and not seen.add((t, u))]
        rows = [r for r in rows if len(r[2]) >= window]
        if rows:
            text, low, length, key = grounds([w for _, _, w in rows], window)
            ids = np.array([r[:2] for r in rows], np.int64)[text]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), ids[:, 0], ids[:, 1], low * 64 + length)], names=["key", "t", "t2", "p"])


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column; null rows have nothing."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    empty = values[:0]
    return [values[a:b] if ok else empty for a, b, ok in zip(offsets, offsets[1:], column.is_valid().to_pylist())]


def _new_rows(batches, seen: set):
    """Batches of (t, t2, text, lists...) as rows of words and arrays, each text once."""
    for batch in text_blocks(batches):
        lists = [_lists(c) for c in batch.columns[4:]]
        for t, u, text, clash, *more in zip(*(c.to_pylist() for c in batch.columns[:4]), *lists):
            if (t, u) not in seen:
                seen.add((t, u))
                yield t, u, words_of(text), clash, more


def _starts(words: list[bytes], spans: np.ndarray, clash: bool, window: int) -> np.ndarray:
    spans = spans[:0] if clash else spans
    return candidates(len(words), spans >> 6, spans & 63, window)


def _windows(batches, window: int):
    """(h1, h2, t, t2, s) of the windows that no ground has shown to stand alone."""
    out: list[list] = [[], [], [], []]

    def batch():
        hashes = np.frombuffer(b"".join(out[0]), ">i8").reshape(-1, 2).astype(np.int64)
        made = [hashes[:, 0], hashes[:, 1], *(np.concatenate(x) for x in out[1:])]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["h1", "h2", "t", "t2", "s"])

    for t, u, words, clash, (spans,) in _new_rows(batches, set()):
        at = _starts(words, spans, clash, window)
        for part in (at[i : i + 50_000] for i in range(0, len(at), 50_000)):
            data = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            begins = np.concatenate(([0], ends[:-1]))
            out[0].append(b"".join([xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(begins[part].tolist(), (ends[part + window - 1] - 1).tolist())]))
            for k, x in enumerate((np.full(len(part), t), np.full(len(part), u), part)):
                out[k + 1].append(x.astype(np.int64))
            if sum(map(len, out[3])) >= 50_000:
                yield batch()
                out = [[], [], [], []]
    if out[0]:
        yield batch()


def _kept(batches, window: int, texts: bool):
    """(t, t2, n_words, n_removed, kept_sha256) of each text, with texts also kept: the words that no repeated window
    covers."""
    rows: list[tuple] = []
    held = 0

    def batch():
        names = ["t", "t2", "n_words", "n_removed", "kept_sha256"] + ["kept"] * texts
        types = [pa.int64()] * 4 + [pa.string()] * (1 + texts)
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), types)], names=names)

    for t, u, words, clash, (spans, alone, copies) in _new_rows(batches, set()):
        n = len(words)
        if copies[0] > 1 and n >= window:
            kept = []
        else:
            starts = np.setdiff1d(_starts(words, spans, clash, window), alone, assume_unique=True)
            change = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + window, n), minlength=n + 1)
            gone = np.cumsum(change[:n]) > 0
            kept = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
        left = b" ".join(kept)
        rows.append((t, u, n, n - len(kept), hashlib.sha256(left).hexdigest(), *[left.decode()] * texts))
        held += len(left) * texts
        if held > 4 << 20 or len(rows) >= 5000:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


def _distinct_in_task(batches):
    """Copies that a task holds become one row before the shuffle, so however many copies a text has, a task of the
    next stage gets one from each task of this one."""
    seen: set = set()
    for batch in batches:
        new = [(t, u) not in seen and not seen.add((t, u)) for t, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield batch.filter(pa.array(new, pa.bool_()))


def _alone(rows: DataFrame, by: list[str], place: str) -> DataFrame:
    """Per text (t, t2): the places of the keys that stand in one place of one text only."""
    both = [f(c).alias(f"{f.__name__}_{c}") for c in ("t", place) for f in (F.min, F.max)]
    alone = rows.groupBy(*by).agg(*both, F.min("t2").alias("t2"), F.max("t2").alias("max_t2")).where(f"min_t = max_t AND t2 = max_t2 AND min_{place} = max_{place}")
    return alone.select(F.col("min_t").alias("t"), "t2", F.col(f"min_{place}").alias(place)).groupBy("t", "t2").agg(F.collect_list(place).alias(f"{place}s"))


def dedup_substrings(docs: DataFrame, key: str = "doc_id", column: str = "text", window: int = WINDOW, texts: bool = True) -> DataFrame:
    """Per row of docs: key, n_words, n_removed, kept_sha256 and, with texts, kept (the words left, joined by one space).

    Null and empty texts have no words. Texts of fewer words than a window lose nothing. Copies of a text lose every
    word, repeated rows included. Texts are used whole: a long one is split into blocks nowhere, and its windows are
    sent in runs. Other columns of docs are not read. An empty table gives an empty result."""
    text = F.coalesce(F.col(column), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias(key), F.xxhash64(text).alias("t"), F.xxhash64(F.lit("again"), text).alias("t2"), text.alias("text"))
    whole = rows.select("t", "t2", "text")
    copies = rows.groupBy("t", "t2").agg(F.count("*").alias("copies"))
    clash = copies.groupBy("t").agg((F.count("*") > 1).alias("clash"))
    copies = materialise(copies.join(clash, "t").select("t", "t2", "copies", "clash"), "copies")

    spans = whole.mapInArrow(lambda b: _spans(b, window), "key long, t long, t2 long, p long")
    spans = materialise(_alone(spans, ["key"], "p"), "grounds")

    def joined(*more: DataFrame) -> DataFrame:
        """The texts with what is known of them. Joins are by sort and merge, which spill, and adaptive execution chooses and
        splits their partitions; what is joined to the texts is small and is put together first."""
        known = copies
        for df in more:
            known = known.join(df, ["t", "t2"], "left")
        return whole.mapInArrow(_distinct_in_task, whole.schema).join(known, ["t", "t2"])

    windows = joined(spans).select("t", "t2", "text", "clash", "ps").mapInArrow(lambda b: _windows(b, window), "h1 long, h2 long, t long, t2 long, s long")
    alone = materialise(_alone(windows, ["h1", "h2"], "s"), "windows")
    done = joined(spans, alone).select("t", "t2", "text", "clash", "ps", "ss", F.array("copies").alias("copies"))
    schema = "t long, t2 long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    done = materialise(done.mapInArrow(lambda b: _kept(b, window, texts), schema), "kept")
    return rows.select(key, "t", "t2").join(done, ["t", "t2"]).drop("t", "t2")


def substring_report(docs: DataFrame) -> DataFrame:
    """dedup_substrings() with the columns of the contract."""
    return dedup_substrings(docs, texts=False)


SQL = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, s, md5(array_to_string(w[s:s + {WINDOW - 1}], ' ')) AS g
         FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS s FROM docs WHERE len(w) >= {WINDOW})),
twice AS (SELECT g FROM wins GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + {WINDOW})) AS p FROM wins JOIN twice USING (g))),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM docs) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) :: BIGINT AS n_words, coalesce(n, 0) :: BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id)
"""

"""Operator 9: benchmark decontamination with a generalised suffix automaton of the normalised test items.

Documents stream through the automaton word by word; at each word it knows the longest run of words, ending there,
that occurs in an item. A run of WINDOW words or more is an occurrence of windows, and all its words are hit.

Items are read in blocks of at most ``block_words`` words (or one item, if that is longer), each of which becomes one
automaton that is sent to the executors. Further blocks are further passes over the same rows, so any number of items is
handled without a shuffle of documents. One automaton is alive at a time: what a pass has found is written along with
the rows before the next block is read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import extended, materialise, text_blocks

WINDOW = 13
#: Words of items in one automaton: about 300 bytes each.
BLOCK_WORDS = 500_000
_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 32 for b in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """A-Z in lower case; words are runs of digits, letters a-z and characters beyond ASCII. Null has none."""
    return (text or "").encode(errors="surrogatepass").translate(_NORMAL).split()


class Automaton:
    """Suffix automaton of several items. Words are numbered; a state is an index into next, link and length."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        numbered = [(key, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for key, words in items if words]
        for _, item in numbered:
            last = 0
            for w in item:
                last = self._append(last, w)
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        #: Of a state: that of its last ``window`` words, so that no chain of links is walked for it.
        self.cut = list(range(len(self.link)))
        for state in order:
            if self.length[self.link[state]] >= window:
                self.cut[state] = self.cut[self.link[state]]
        #: Of a state: the items that hold its last ``window`` words; and (length, item) of short items that are a suffix of it.
        self.holders: dict[int, set] = {}
        self.short: dict[int, list[tuple[int, object]]] = {}
        for key, item in numbered:
            state = 0
            for i, w in enumerate(item):
                state = self.next[state][w] if w in self.next[state] else 0
                if i + 1 >= window:
                    state = self.cut[state]
                    self.holders.setdefault(state, set()).add(key)
            if len(item) < window:
                self.short.setdefault(state, []).append((len(item), key))
        #: Of a state: itself, or the next one up its links, that a short item ends in; 0 if there is none.
        self.ends = [0] * len(self.link)
        for state in order:
            self.ends[state] = state if state in self.short else self.ends[self.link[state]]
        self.least = min((min(len(item), window) for _, item in numbered), default=window)

    def _append(self, last: int, w: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        if (q := nexts[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = self._state({}, -1, length[last] + 1)
        while last != -1 and w not in nexts[last]:
            nexts[last][w] = new
            last = link[last]
        if last == -1:
            link[new] = 0
        else:
            q = nexts[last][w]
            link[new] = q if length[q] == length[last] + 1 else self._split(last, w, q)
        return new

    def _state(self, nexts: dict, link: int, length: int) -> int:
        self.next.append(nexts)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, last: int, w: int, q: int) -> int:
        half = self._state(dict(self.next[q]), self.link[q], self.length[last] + 1)
        self.link[q] = half
        while last != -1 and self.next[last].get(w) == q:
            self.next[last][w] = half
            last = self.link[last]
        return half

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans [start, end) of hit words, overlapping ones joined, and the items that have an occurring window."""
        known = bytes(map(self.vocabulary.__contains__, words))
        sought, spans, found, at = b"\1" * self.least, [], set(), 0
        while (at := known.find(sought, at)) >= 0:  # only runs of words of the items can hold a window
            end = known.find(b"\0", at)
            end = len(known) if end < 0 else end
            self._match_run(words, at, end, spans, found)
            at = end
        return spans, found

    def _match_run(self, words: list[bytes], at: int, end: int, spans: list, found: set) -> None:
        state = matched = 0
        for i in range(at, end):
            w = self.vocabulary[words[i]]
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if w in self.next[state]:
                state, matched = self.next[state][w], matched + 1
            hit = 0
            if matched >= self.window:
                hit = matched
                found |= self.holders[self.cut[state]]
            if self.short:
                up = self.ends[state]
                while up > 0:
                    for n, key in self.short[up]:
                        if n <= matched:
                            hit = max(hit, n)
                            found.add(key)
                    up = self.ends[self.link[up]]
            if hit:
                start = i + 1 - hit
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))


def item_blocks(items: DataFrame, key: str, column: str, block_words: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items without words are left out. Rows come to the driver one partition at a time."""
    block, held = [], 0
    for row in items.select(key, column).toLocalIterator():
        if words := words_of(row[1]):
            if held and held + len(words) > block_words:
                yield block
                block, held = [], 0
            block.append((row[0], words))
            held += len(words)
    if block:
        yield block


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from the first to the last word of each span."""
    data = text.encode(errors="surrogatepass")
    places, out, at = [m.span() for m in _WORD.finditer(data.translate(_NORMAL))], [], 0
    for a, b in spans:
        out.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, data[at:]]).decode(errors="surrogatepass")


def _with_hits(docs: DataFrame, items: DataFrame, finish, schema, column: str, item_key: str, item_column: str, window: int, block_words: int) -> DataFrame:
    """finish(batch, rows of (words, hit spans, items)) over docs. The passes before the last one write their hits as
    columns of docs, under names that no column of docs has."""
    spark, names, at = docs.sparkSession, docs.columns, docs.columns.index(column)
    own = [_free(names, "__spans"), _free(names, "__items")]
    with_hits = extended(docs, **{own[0]: T.BinaryType(), own[1]: T.ArrayType(T.StringType())})

    def one_pass(df: DataFrame, sent, last: bool) -> DataFrame:
        first = len(df.columns) == len(names)

        def run(batches):
            automaton = sent.value
            for batch in text_blocks(batches, column):
                texts = batch.column(at).to_pylist()
                before = [(b"", ())] * len(texts) if first else zip(*(c.to_pylist() for c in batch.columns[-2:]))
                rows = []
                for text, (spans, items) in zip(texts, before):
                    words = words_of(text)
                    new, found = automaton.match(words)
                    rows.append((words, joined([*map(tuple, np.frombuffer(spans, "<i8").reshape(-1, 2).tolist()), *new]), {*items, *map(str, found)}))
                columns = batch.columns[: len(names)]
                if last:
                    yield finish(pa.RecordBatch.from_arrays(columns, names=names), rows)
                else:
                    spans = pa.array([np.array(s, "<i8").tobytes() for _, s, _ in rows], pa.binary())
                    yield pa.RecordBatch.from_arrays([*columns, spans, pa.array([sorted(i) for _, _, i in rows], pa.list_(pa.string()))], names=[*names, *own])

        return df.mapInArrow(run, schema if last else with_hits)

    blocks, df = item_blocks(items, item_key, item_column, block_words), docs
    block = next(blocks, [])
    while (after := next(blocks, None)) is not None:
        sent = spark.sparkContext.broadcast(Automaton(block, window))
        df = materialise(one_pass(df, sent, False), "hits")
        sent.destroy()
        block = after
    return one_pass(df, spark.sparkContext.broadcast(Automaton(block, window)), True)


def _free(names: list[str], name: str) -> str:
    while name in names:
        name += "_"
    return name


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", column: str = "text", item_key: str = "item_id", item_column: str = "text", window: int = WINDOW, share: int = 20, clean: bool = False, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of docs: key, n_words, n_hit, n_items, items_sha256 (ids of items with occurring windows, sorted as
    strings, comma-joined), contaminated (some word is hit, and ``share`` times the hit words are all words at least);
    with clean, also clean_text: the text without the hit spans.

    Null and empty texts have no words and are not contaminated. Repeated rows stay, each judged alone. Without items
    (or with only null or wordless ones) nothing is hit; items of one id count once. Long texts are streamed, one
    document at a time. Other columns of docs are not read, so their names can't clash. An empty table gives an empty
    result."""
    names = [key, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"] + ["clean_text"] * clean

    def finish(batch: pa.RecordBatch, rows: list) -> pa.RecordBatch:
        n = [len(w) for w, _, _ in rows]
        hit = [sum(b - a for a, b in s) for _, s, _ in rows]
        out = [batch.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(i) for _, _, i in rows], pa.int64())]
        out.append(pa.array([hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for _, _, i in rows], pa.string()))
        out.append(pa.array([h > 0 and share * h >= w for h, w in zip(hit, n)], pa.bool_()))
        if clean:
            out.append(pa.array([without_spans(t, s) if s else t for t, (_, s, _) in zip(batch.column(1).to_pylist(), rows)], pa.string()))
        return pa.RecordBatch.from_arrays(out, names=names)

    schema = f"{key} long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" + ", clean_text string" * clean
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(column).alias("text"))
    return _with_hits(texts, items, finish, schema, "text", item_key, item_column, window, block_words)


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contaminated_keys_gone(docs: DataFrame, items: DataFrame, column: str = "text", item_key: str = "item_id", item_column: str = "text", window: int = WINDOW, share: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the contaminated ones, as decontaminate() judges them; the others stay as they are. The judgement is
    made row by row within the same passes, so nothing is joined or shuffled."""

    def finish(batch: pa.RecordBatch, rows: list) -> pa.RecordBatch:
        hit = [sum(b - a for a, b in s) for _, s, _ in rows]
        return batch.filter(pa.array([not (h > 0 and share * h >= len(w)) for h, (w, _, _) in zip(hit, rows)], pa.bool_()))

    return _with_hits(docs, items, finish, docs.schema, column, item_key, item_column, window, block_words)

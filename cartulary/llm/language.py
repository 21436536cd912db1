"""Operator 8: language identification by multilingual mixture inference.

A language is a distribution of byte trigrams of lower-cased words, counted over every learning document. A document
is a mixture of languages: expectation-maximisation over its words (whose likelihoods are products of those of their
trigrams) estimates the proportions. The set of languages starts with the one that explains the document best and grows
by the one that helps most while the penalised likelihood improves, up to all languages of the model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import extended, text_blocks

#: Trigrams are hashed to so many cells a language, whatever the corpus and the number of languages. A model of MODEL_CELLS numbers (256 MB) or
#: less is a matrix; a larger one holds the cells that its languages have and what all others of a language have in common, which
#: gives the same likelihoods. More than MODEL_ENTRIES of those (1 GB) are an error, not another model.
CELLS, MODEL_CELLS, MODEL_ENTRIES = 1 << 18, 1 << 26, 1 << 27
#: Words x languages that likelihoods are held for at once, besides one text that has more.
MOST_LIKELIHOODS = 1 << 24
SMOOTH, ROUNDS = 0.1, 6
#: Price of one more language in a document, in units of the logarithm of its number of words.
PRICE = 2.0
_SPACED = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def trigram_cells(texts: list[str | None], of: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of the texts, one after the other: cells of trigrams, where each word's trigrams start, and where
    each text's words start (one entry more than texts). A trigram starts at the space before a word, or at one of its
    bytes but the last, so no trigram reaches into the next word or text."""
    data = [b" " + b" ".join(((x or "").lower().encode(errors="surrogatepass")).translate(_SPACED).split()) for x in texts]
    whole = np.frombuffer(b"".join(data) + b"  ", np.uint8).astype(np.uint32)
    first = whole == 32
    first[-2:] = False
    first[:-1] &= whole[1:] != 32  # a text without words leaves a lone space
    starts = np.flatnonzero(first)
    lengths = np.array([len(x) for x in data], np.int64)
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
    inside = whole[1:-1] != 32  # a trigram whose second byte is a space would join two words
    starts = (np.cumsum(inside) - 1)[starts]
    h = (whole[:-2] * np.uint32(0x9E3779B1)) ^ (whole[1:-1] * np.uint32(0x85EBCA77)) ^ (whole[2:] * np.uint32(0xC2B2AE3D))
    return ((h ^ (h >> np.uint32(15))) & np.uint32(of - 1)).astype(np.int32)[inside], starts, bounds


def count_trigrams(docs: DataFrame, column: str = "text", lang: str = "lang", of: int = CELLS) -> DataFrame:
    """(lang, cell, n) over all rows with a lang: each task counts its own, then the tasks' counts are added. A task hands
    on what it has counted when its languages hold MODEL_CELLS cells."""

    def counted(counts: dict[str, np.ndarray]):
        for name, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["lang", "cell", "n"])

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in text_blocks(batches):
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in {*langs} - {None}:
                cells, starts, _ = trigram_cells([x for x, y in zip(texts, langs) if y == name], of)
                if len(starts):
                    counts.setdefault(name, np.zeros(of, np.int64))[:] += np.bincount(cells, minlength=of)
                if len(counts) * of > MODEL_CELLS // 2:
                    yield from counted(counts)
                    counts = {}
        yield from counted(counts)

    return docs.where(F.col(lang).isNotNull()).select(column, lang).mapInArrow(run, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


class Sparse:
    """Logarithms by cell where a language has it: of cell c, languages langs[first[c]:first[c + 1]] and what each has over base."""

    def __init__(self, base: np.ndarray, cells: np.ndarray, langs: np.ndarray, logs: np.ndarray, of: int) -> None:
        order = np.argsort(cells, kind="stable")
        self.base, self.langs = base, langs[order]
        self.over = (logs - base[langs])[order].astype(np.float32)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(cells, minlength=of))))

    def __len__(self) -> int:
        return len(self.first) - 1

    @property
    def size(self) -> int:
        return self.over.size + self.base.size

    def sums(self, cells: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of each word the sums over its trigrams, words x languages."""
        k, sizes = len(self.base), np.diff(np.append(starts, len(cells)))
        out = sizes[:, None] * self.base.astype(np.float64)
        count = self.first[cells + 1] - self.first[cells]
        word = np.repeat(np.repeat(np.arange(len(starts)), sizes), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[cells], count)
        out += np.bincount(word * k + self.langs[at], self.over[at], len(starts) * k).reshape(len(starts), k)
        return out.astype(np.float32)


class Model:
    def __init__(self, names: list[str], logs: np.ndarray | Sparse):
        self.names, self.logs = names, logs

    @property
    def cells(self) -> int:
        return len(self.logs)

    def word_logs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihoods, words x languages, where each text's words start, and how many trigrams each word has."""
        cells, starts, bounds = trigram_cells(texts, self.cells)
        if not len(starts):
            return np.zeros((0, len(self.names)), np.float32), bounds, np.zeros(0, np.int64)
        sums = self.logs.sums(cells, starts) if isinstance(self.logs, Sparse) else np.add.reduceat(self.logs[cells], starts, axis=0)
        return sums, bounds, np.diff(np.append(starts, len(cells)))

    def runs(self, texts: list[str | None]) -> Iterator[slice]:
        """Runs of texts whose likelihoods are held at once; a word takes two bytes of its text at least, with the space."""
        start = held = 0
        for i, x in enumerate(texts):
            n = len(x or "") * len(self.names) // 2
            if held and held + n > MOST_LIKELIHOODS:
                yield slice(start, i)
                start, held = i, 0
            held += n
        yield slice(start, len(texts))

    def infer(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: index of the main language (-1: no letters), its proportion in the chosen set, size of that set."""
        return self._infer(len(texts), *self.word_logs(texts)[:2])

    def judge(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """infer(), the posterior of the main language, and the share of words that some language explains better than
        chance, that is, better than trigrams drawn evenly from all cells. The posterior is that of a word of the text
        on average, all languages being as likely beforehand: close words of two languages lower it, length doesn't
        raise it."""
        logs, bounds, sizes = self.word_logs(texts)
        best, share, chosen = self._infer(len(texts), logs, bounds)
        n_words = np.diff(bounds)
        if not len(logs) or not self.names:
            return best, share, chosen, np.zeros(len(texts)), np.zeros(len(texts))
        peak = logs.max(axis=1)
        own = logs[np.arange(len(logs)), np.repeat(np.maximum(best, 0), n_words)]
        each = np.exp(own - peak) / np.exp(logs - peak[:, None]).sum(axis=1)
        sums = [np.append(0, np.cumsum(x, dtype=np.float64)) for x in (each, peak > -np.log(self.cells) * sizes)]
        posterior, known = ((s[bounds[1:]] - s[bounds[:-1]]) / np.maximum(n_words, 1) for s in sums)
        return best, share, chosen, posterior, known

    def _infer(self, n: int, logs: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k, count = len(self.names), np.diff(bounds)
        best, share, chosen = np.full(n, -1), np.zeros(n), np.zeros(n, int)
        some = np.flatnonzero(count)
        if not len(some) or not k:
            return best, share, chosen
        starts, count = bounds[:-1][some], count[some]
        peak = logs.max(axis=1, keepdims=True)
        odds = np.exp(logs - peak)
        whole = np.add.reduceat(logs - peak, starts, axis=0).astype(np.float64)  # log-likelihood of each language alone, up to a constant
        best[some], share[some], chosen[some] = whole.argmax(axis=1), 1.0, 1
        score = whole.max(axis=1) - PRICE * np.log(count + 1)
        allowed = np.eye(k, dtype=bool)[best[some]]
        proportions = allowed.astype(np.float64)
        for size in range(2, k + 1):
            mixed = (np.repeat(proportions.astype(np.float32), count, axis=0) * odds).sum(axis=1, keepdims=True)
            with_one = np.add.reduceat(np.log(np.maximum(mixed * ((size - 1) / size) + odds / size, 1e-30)), starts, axis=0)
            allowed[np.arange(len(some)), np.where(allowed, -np.inf, with_one).argmax(axis=1)] = True
            proportions, mixed = self._expect(odds, starts, count, allowed)
            penalised = mixed - size * PRICE * np.log(count + 1)
            better = penalised > score
            if not better.any():
                break
            # Only the texts that want one more language go on.
            odds = odds[np.repeat(better, count)]
            some, count, score, allowed, proportions = some[better], count[better], penalised[better], allowed[better], proportions[better]
            starts = np.cumsum(count) - count
            best[some], share[some], chosen[some] = proportions.argmax(axis=1), proportions.max(axis=1), size
        return best, share, chosen

    def _expect(self, odds: np.ndarray, starts: np.ndarray, count: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions (texts x languages) after some rounds of expectation-maximisation, and their log-likelihoods."""
        proportions = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(ROUNDS):
            weighed = np.repeat(proportions.astype(np.float32), count, axis=0) * odds
            weighed /= np.maximum(weighed.sum(axis=1, keepdims=True), 1e-30)
            proportions = np.add.reduceat(weighed, starts, axis=0) / count[:, None]
        weighed = (np.repeat(proportions.astype(np.float32), count, axis=0) * odds).sum(axis=1)
        return proportions, np.add.reduceat(np.log(np.maximum(weighed, 1e-30)), starts).astype(np.float64)


def fit(docs: DataFrame, column: str = "text", lang: str = "lang") -> Model:
    """The model of every language that docs name and that has words. The driver gets one row a language, of at most CELLS cells, one
    after the other."""
    counts = count_trigrams(docs, column, lang).groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))
    names, cells, counted, entries = [], [], [], 0
    for row in counts.select("lang", F.col("cells.cell").alias("cell"), F.col("cells.n").alias("n")).toLocalIterator():
        names.append(row["lang"])
        cells.append(np.array(row["cell"], np.int32))
        counted.append(np.array(row["n"], np.float32))
        entries += len(cells[-1])
        if entries > MODEL_ENTRIES:
            raise ValueError(f"more than {MODEL_ENTRIES} cells of languages: {len(names)} languages so far")
    order = sorted(range(len(names)), key=names.__getitem__)
    return model_of([names[i] for i in order], [cells[i] for i in order], [counted[i] for i in order])


def model_of(names: list[str], cells: list[np.ndarray], counted: list[np.ndarray], of: int = CELLS, most: int = MODEL_CELLS) -> Model:
    """The model of languages whose cells have been counted."""
    if of * len(names) <= most:
        n = np.full((of, max(len(names), 1)), SMOOTH, np.float32)
        for i, (c, x) in enumerate(zip(cells, counted)):
            n[c, i] += x
        return Model(names, np.log(n / n.sum(axis=0, dtype=np.float64)).astype(np.float32))
    totals = np.array([x.sum(dtype=np.float64) + SMOOTH * of for x in counted])
    langs = np.repeat(np.arange(len(names), dtype=np.int32), [len(c) for c in cells])
    logs = np.log((np.concatenate(counted).astype(np.float64) + SMOOTH) / totals[langs])
    return Model(names, Sparse(np.log(SMOOTH / totals), np.concatenate(cells), langs, logs, of))


def predict(docs: DataFrame, model: Model, column: str = "text", of_all: bool = False, names: tuple[str, str, str] = ("lang_pred", "score", "n_langs")) -> DataFrame:
    """docs with lang_pred (`und`: null text, no letter, or nothing learned), score (posterior of that language for a word
    of the text on average, 0 for `und`) and n_langs (languages in the chosen set), under these or other names. Columns
    of those names in docs are replaced, all others stay; repeated rows stay; an empty table gives an empty result.
    Texts of any length are used whole. Of languages that explain a text equally well the first by name is taken. With
    ``of_all`` the score is the proportion of the language among all words, those that no language explains better than
    chance too."""
    docs = docs.drop(*names)
    own_names, at, sent = docs.columns, docs.columns.index(column), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = sent.value
        for batch in text_blocks(batches, column):
            texts = [x if x and any(map(str.isalpha, x)) else None for x in batch.column(at).to_pylist()]
            parts = [own.judge(texts[run]) for run in own.runs(texts)]
            best, share, chosen, posterior, known = (np.concatenate(x) for x in zip(*parts))
            score = np.where(best >= 0, share * known if of_all else posterior, 0)
            made = [pa.array([own.names[b] if b >= 0 else "und" for b in best], pa.string()), pa.array(np.clip(score, 0, 1), pa.float64()), pa.array(chosen, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*own_names, *names])

    return docs.mapInArrow(run, extended(docs, **dict(zip(names, (T.StringType(), T.DoubleType(), T.IntegerType())))))


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def identify(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Learns from the rows of docs that are not held out, and predicts all: key, held_out, lang_pred, score, n_langs."""
    model = fit(docs.where(~F.coalesce(held_out(key), F.lit(True))))
    texts = docs.select(F.col(key).cast("long").alias(key), "text", F.coalesce(held_out(key), F.lit(True)).alias("held_out"))
    return predict(texts, model).drop("text")

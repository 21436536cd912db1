"""Operators 10 and 5 share this: byte-level BPE of whole texts through the tokenizers library, over Arrow batches.

All texts of a block are cut at once where the split pattern of byte-level BPE surely cuts, by looking at the kinds of
neighbouring bytes. Each distinct piece of a block is looked up in a bounded table of answers, and only pieces that
aren't in it go to the library: to its model if the piece is one match of the pattern, else to the whole tokenizer. The
ids of the texts are then gathered from those of the distinct pieces, and decoding gathers bytes by id, with numpy.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, decoders, models, pre_tokenizers

from .common import extended, map_texts

#: Pieces in each generation of the table of answers that a worker keeps.
KEPT = 300_000
#: Text bytes that are cut and looked up at once, and characters of the longest piece whose answer is kept.
BLOCK_BYTES, LONGEST_KEPT = 4 << 20, 64
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Pieces that are one match of the split pattern.
_ONE = re.compile(rf" ?(?:[{_LETTER}]+|[0-9]+|[!-&(-/:-@\[-`{{-~]+)|[\t\v\f\r]")

# Kinds of bytes. Letters are ASCII and Latin ones (lead bytes 0xC3 to 0xC8, less two signs); of all other characters
# beyond ASCII, and of control characters, nothing is said.
_L, _N, _S, _A, _SP, _W, _U = range(7)  # letter, digit, sign, apostrophe, space, other white space, unknown
_KIND = np.full(256, _U, np.uint8)
_KIND[33:127] = _S
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = _L
_KIND[48:58], _KIND[39], _KIND[32], _KIND[9:14] = _N, _A, _SP, _W
_INK = np.array([True] * 4 + [False] * 3)
#: Whether the pattern cuts between two kinds, whatever stands around them: letters, digits and signs are different
#: matches, but an apostrophe may belong to signs before it or to letters after it; and white space never follows ink
#: within a match. An entry a pair, the first kind times eight.
_CUTS = np.zeros(64, bool)
for _a, _next in ((_L, (_N, _S, _A, _SP, _W)), (_N, (_L, _S, _A, _SP, _W)), (_S, (_L, _N, _SP, _W)), (_A, (_N, _SP, _W))):
    _CUTS[[_a * 8 + _b for _b in _next]] = True


def byte_characters() -> list[str]:
    """The character that byte-level BPE shows for each byte: printable Latin-1 characters stand for themselves, and
    the other bytes take the characters from 256 on, in order."""
    shown, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            shown.append(chr(b))
        else:
            shown.append(chr(free))
            free += 1
    return shown


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def parts_of(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What is left of a token when every merge of a lower rank is made, lowest first and leftmost first."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= own:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def tokenizer_of_ranks(path: str) -> Tokenizer:
    """A Tokenizer whose ids are the ranks of a tiktoken file: each token of two parts or more becomes the merge of
    its last two parts, in the order of the ranks."""
    ranks, shown = read_ranks(path), byte_characters()
    show = lambda token: "".join(shown[b] for b in token)
    merges = []
    for token in sorted(ranks, key=ranks.get):
        if len(token) > 1 and len(parts := parts_of(token, ranks)) == 2:
            merges.append((show(parts[0]), show(parts[1])))
    made = Tokenizer(models.BPE({show(t): r for t, r in ranks.items()}, merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    made.decoder = decoders.ByteLevel()
    return made


def tokenizer_of_json(path: str) -> Tokenizer:
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    made.no_padding()
    made.no_truncation()
    return made


def kinds_of(data: np.ndarray) -> np.ndarray:
    """Kinds of the bytes of UTF-8 texts."""
    kinds = _KIND[data]
    at = np.flatnonzero((kinds == _U) & (data >= 0xC0))
    for _ in range(3):  # the other bytes of characters that nothing is said of
        at = at[at + 1 < len(data)] + 1
        at = at[(data[at] & 0xC0) == 0x80]
        kinds[at] = _U
    at = np.flatnonzero(data[:-1] == 0xC3)
    at = at[(data[at + 1] == 0x97) | (data[at + 1] == 0xB7)]  # the two signs among the Latin letters
    kinds[at] = kinds[at + 1] = _U
    return kinds


def pieces_of(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places where texts (of which starts has the first bytes) are cut, so that no match of the split pattern lies across."""
    kinds = kinds_of(data)
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = _CUTS[kinds[:-1] * np.uint8(8) + kinds[1:]]
    first = np.zeros(len(data) + 1, bool)
    first[starts] = True
    # A tab or line end that stands alone between ink, or between the start of a text and ink, is a match of its own.
    after = np.flatnonzero(kinds[:-1] == _W) + 1
    alone = _INK[kinds[after]] & (first[after - 1] | _INK[kinds[np.maximum(after - 2, 0)]])
    cut[after[alone]] = True
    cut |= first
    return np.flatnonzero(cut[:-1])


def gathered(values: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of values, the k-th of which ends at ends[k]: the runs that ``which`` names, one after the other, and their lengths."""
    lengths = np.diff(ends, prepend=0)
    sizes = lengths[which]
    stops = np.cumsum(sizes)
    shift = (ends - lengths)[which] - (stops - sizes)
    kind = np.int32 if max(len(values), int(stops[-1]) if len(stops) else 0) < 1 << 31 else np.int64
    places = np.repeat(shift.astype(kind), sizes)
    places += np.arange(len(places), dtype=kind)
    return values[places], sizes


def runs(values: Iterable[bytes], kind: str = "u1") -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as runs for ``gathered``."""
    values = list(values)
    flat = np.frombuffer(b"".join(values), kind)
    return flat, np.cumsum(np.fromiter(map(len, values), np.int64, len(values))) // flat.itemsize


class Answers:
    """A bounded table of answers in two generations: when the young one is full it becomes the old one."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key: str) -> bytes | None:
        if (out := self.young.get(key)) is None and (out := self.old.get(key)) is not None:
            self.young[key] = out
        return out

    def put(self, new: dict[str, bytes]) -> None:
        self.young |= new
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}


#: Ids as little-endian unsigned 32-bit integers.
_PACKED: list[bytes] = []


class Encoder:
    """Ids of texts."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.shown = str.maketrans({chr(i): c for i, c in enumerate(byte_characters())})
        while len(_PACKED) <= tokenizer.get_vocab_size():
            _PACKED.append(len(_PACKED).to_bytes(4, "little"))
        self.kept = Answers(KEPT)

    def encode(self, text: str) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit integers."""
        return self.encode_all(pa.array([text], pa.string()))[0].astype("<u4").tobytes()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has. Nulls have none."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        offsets = offsets - offsets[0]
        places = pieces_of(data, offsets[:-1])
        pieces = pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(np.append(places, len(data)).astype(np.int64)), pa.py_buffer(data))
        coded = pieces.dictionary_encode()
        flat, ends = runs(self.answers(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), "<u4")
        ids, sizes = gathered(flat, ends, coded.indices.to_numpy())
        before = np.concatenate(([0], np.cumsum(sizes)))
        return ids, np.diff(before[np.searchsorted(places, offsets)])

    def answers(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces. Those of one match of the split pattern go to the library's model, as the characters
        of their bytes; others go to the whole tokenizer."""
        found = list(map(self.kept.get, pieces))
        asked = [p for p, x in zip(pieces, found) if x is None]
        single = list(filter(_ONE.fullmatch, asked))
        new = {p: self.whole(p) for p in set(asked).difference(single)}
        tokenize, packed = self.model.tokenize, _PACKED
        # None of these holds a line feed, so they are turned into characters of bytes together.
        shown = "\n".join(single).encode().decode("latin-1").translate(self.shown).split(self.shown[10]) if single else ()
        new |= {p: b"".join([packed[t.id] for t in tokenize(s)]) for p, s in zip(single, shown)}
        self.kept.put({p: x for p, x in new.items() if len(p) <= LONGEST_KEPT})
        return [new[p] if x is None else x for p, x in zip(pieces, found)]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


_MADE: dict[tuple[str, str], Encoder] = {}


def encoder(kind: str, path: str) -> Encoder:
    """One for each worker process: building the merges takes a second."""
    if (kind, path) not in _MADE:
        _MADE[kind, path] = Encoder({"ranks": tokenizer_of_ranks, "json": tokenizer_of_json}[kind](path))
    return _MADE[kind, path]


_TABLES: dict[str, list[bytes]] = {}


def decode_table(kind: str, path: str) -> list[bytes]:
    """Bytes of each id: the shown characters of a token, turned back by the reversed byte table. A character of the
    text that is split over tokens comes together again when their bytes are joined."""
    if path not in _TABLES:
        back = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = encoder(kind, path).tokenizer.get_vocab()
        found = [b""] * (max(vocabulary.values()) + 1)
        for shown, i in vocabulary.items():
            found[i] = bytes(back[c] for c in shown) if all(c in back for c in shown) else shown.encode()
        _TABLES[path] = found
    return _TABLES[path]


def offsets(ids: list[int], table: list[bytes]) -> list[tuple[int, int]]:
    """Character offsets of each token: from the character that holds its first byte to after the one that holds its
    last, so tokens within one character share it."""
    data = np.frombuffer(b"".join(table[i] for i in ids), np.uint8)
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    ends = np.cumsum([len(table[i]) for i in ids], dtype=np.int64)
    starts = np.concatenate(([0], ends))[:-1]
    return [(int(max(begins[a + 1] - 1, 0)), int(begins[b])) if b > a else (int(begins[a]), int(begins[a])) for a, b in zip(starts, ends)]


def encode_texts(docs: DataFrame, path: str, kind: str = "ranks", column: str = "text") -> DataFrame:
    """docs with ``ids`` (array<int>), and ``token_starts`` and ``token_ends`` (character offsets). Null texts count as empty. Columns of
    these names in docs are replaced; all others stay."""
    docs = docs.drop("ids", "token_starts", "token_ends")
    names = docs.columns

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        own, table = encoder(kind, path), decode_table(kind, path)
        flat, counts = own.encode_all(block.column(column))
        ids = [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] if len(counts) else []
        spans = [offsets(x, table) for x in ids]
        made = [pa.array(ids, pa.list_(pa.int32()))] + [pa.array([[s[k] for s in x] for x in spans], pa.list_(pa.int32())) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*block.columns, *made], names=[*names, "ids", "token_starts", "token_ends"])

    ints = T.ArrayType(T.IntegerType())
    return map_texts(docs, run, extended(docs, ids=ints, token_starts=ints, token_ends=ints), column)


def decode_ids(df: DataFrame, path: str, kind: str = "ranks", column: str = "ids") -> DataFrame:
    """df with ``decoded`` (binary): the bytes of the ids in column. Null ids decode to no bytes."""
    df = df.drop("decoded")
    names = df.columns

    def run(batches):
        table = decode_table(kind, path)
        for batch in batches:
            out = [b"".join([table[i] for i in x or ()]) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*names, "decoded"])

    return df.mapInArrow(run, extended(df, decoded=T.BinaryType()))


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Per row: key, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (bytes decoded from the ids).

    Null and empty texts: no tokens, both digests of nothing. Repeated rows stay. A text of any length is one unit;
    its ids are held as 4 bytes each. Other columns of docs are not read. An empty table gives an empty result."""

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        ids, n = encoder("ranks", path).encode_all(block.column(column))
        table = decode_table("ranks", path)
        commas, n_decimals = gathered(*_decimals(len(table)), ids)
        decoded, n_bytes = gathered(*_decode_runs(path, table), ids)
        ends = np.cumsum(n)
        sha = lambda data, sizes, less: [hashlib.sha256(data[a : max(a, b - less)]).hexdigest() for a, b in _spans(sizes, ends, n)]
        return pa.RecordBatch.from_arrays([block.column(key), pa.array(n, pa.int64()), pa.array(sha(commas, n_decimals, 1)), pa.array(sha(decoded, n_bytes, 0))], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_texts(docs.select(F.col(key).cast("long").alias(key), column), run, f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string", column, BLOCK_BYTES)


def _spans(sizes: np.ndarray, ends: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    """Where the bytes of each text lie, if each of its ids has so many."""
    before = np.concatenate(([0], np.cumsum(sizes)))
    return list(zip(before[ends - n].tolist(), before[ends].tolist()))


_RUNS: dict[object, tuple[np.ndarray, np.ndarray]] = {}


def _decode_runs(path: str, table: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    if path not in _RUNS:
        _RUNS[path] = runs(table)
    return _RUNS[path]


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each id as a decimal and a comma."""
    if n not in _RUNS:
        _RUNS[n] = runs(b"%d," % i for i in range(n))
    return _RUNS[n]

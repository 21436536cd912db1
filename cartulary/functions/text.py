"""Column expressions on text: folding, tokens, similarity, search scores, snippets. All stay in the JVM."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

def _accents() -> tuple[str, str]:
    """Lower-case Latin letters that decompose to one of a to z and combining marks, and those letters."""
    pairs = [(chr(i), unicodedata.normalize("NFKD", chr(i))) for i in (*range(0xE0, 0x250), *range(0x1E00, 0x1F00))]
    kept = [(c, d[0]) for c, d in pairs if c.islower() and "a" <= d[0] <= "z" and len(d) > 1 and all(map(unicodedata.combining, d[1:]))]
    return "".join(c for c, _ in kept), "".join(d for _, d in kept)


ACCENTED, PLAIN = _accents()
_ACCENT, _PLAIN_OF = re.compile(f"[{ACCENTED}]"), dict(zip(ACCENTED, PLAIN))


def unaccented(low: str) -> str:
    """A lower-case text as accent_fold has it, for functions that read it in Python: only the accents cost time, not every letter of their text."""
    return low if low.isascii() else _ACCENT.sub(lambda found: _PLAIN_OF[found[0]], low)


def lit_or_col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def accent_fold(text) -> Column:
    """Trimmed lower case without the accents of Latin letters. Plain ASCII has none and is left as it is."""
    low = F.lower(F.trim(lit_or_col(text)))
    return F.when(F.length(low) == F.octet_length(low), low).otherwise(F.translate(low, ACCENTED, PLAIN))


def tokens(text) -> Column:
    """Runs of a-z and digits of the folded text, in order, repeats included."""
    return F.regexp_extract_all(accent_fold(text), F.lit("([a-z0-9]+)"), 1)


def collapse_spaces(text) -> Column:
    return F.trim(F.regexp_replace(lit_or_col(text), r"\s+", " "))


def trim_marks(text) -> Column:
    """Collapsed, without marks of lists and labels at either end."""
    return F.regexp_replace(collapse_spaces(text), r"^[-:|,.; ]+|[-:|,.; ]+$", "")


def cut_at(text, stops: list[str]) -> Column:
    """What stands before the first of the stop words."""
    return trim_marks(F.regexp_extract(lit_or_col(text), rf"(?iuUs)^(.*?)(?:\b(?:{'|'.join(stops)})\b.*)?$", 1))


def identity_text(name) -> Column:
    """Letters of a name without courtesy titles, for comparing identities."""
    bare = F.regexp_replace(F.lower(lit_or_col(name)), r"\b(dra?|sra?)\b\.?", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^\p{L} ]+", " "), r"\s+", " "))


def relation_name(name) -> Column:
    """Lower-case letters a-z and digits; all else, accented letters too, vanishes."""
    return F.regexp_replace(F.lower(lit_or_col(name)), "[^a-z0-9]+", "")


def holds_any(text: Column, terms: list[str]) -> Column:
    """Whether a text holds one of the terms as it is written: faster than a pattern of alternatives, which is tried at each place."""
    return functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms])


def overlap_of_smaller(a: Column, b: Column) -> Column:
    """Shared distinct elements, as a share of the smaller set; 0 where either is empty."""
    smaller = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def search_score(corpus: Column, query: str) -> Column:
    """Share of the query's words that the corpus has, and a quarter more where it has the whole phrase; at most 1.
    Repeated query words count each time. The corpus is folded and cut into words once, whatever the query."""
    phrase = query.strip().lower().translate(str.maketrans(ACCENTED, PLAIN))
    wanted = Counter(re.findall("[a-z0-9]+", phrase))
    if not wanted:
        return F.lit(0.0)
    folded, hits = accent_fold(corpus), F.lit(0)
    for word, times in wanted.items():  # each is sought until its first place; the words of the corpus are never listed
        hits = hits + F.when(folded.rlike(rf"(?<![a-z0-9]){word}(?![a-z0-9])"), times).otherwise(0)
    return F.coalesce(F.least(F.lit(1.0), hits / F.lit(wanted.total()) + F.when(F.contains(folded, F.lit(phrase)), 0.25).otherwise(0.0)), F.lit(0.0))


def snippet(text: Column, found: Column, before: int = 60, size: int = 240) -> Column:
    """A window of the text around the first place of a phrase, with ellipses where it is cut; without the phrase, the
    head of the text."""
    at = F.instr(F.lower(text), F.lower(found))
    start = F.greatest(at - 1 - before, F.lit(0))
    window = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(text, start + 1, F.lit(size)), F.when(start + size < F.length(text), "…").otherwise(""))
    head = F.when(F.length(text) <= size, text).otherwise(F.concat(F.substring(text, 1, size - 1), F.lit("…")))
    return F.when(at > 0, window).otherwise(head)


def text_quality(text, hints: list[str] = ()) -> Column:
    """How readable a text is: length, letters and digits count for it, odd signs against it. Counts are weighted before they
    are divided: the products are exact, so a score that should meet a bound isn't rounded below it twice."""
    t = lit_or_col(text)
    n = F.greatest(F.length(t), F.lit(1))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    digits = F.length(F.regexp_replace(t, r"[^0-9]", ""))
    odd = F.length(F.regexp_replace(t, r"[\p{L}0-9\s.,;:!?()/%'\"-]", ""))
    score = F.least(F.length(t) / 300.0, F.lit(4.0)) + 3.0 * letters / n + 0.5 * digits / n - 2.0 * odd / n
    for hint in hints:
        score = score + F.when(F.contains(F.lower(t), F.lit(hint)), 0.5).otherwise(0.0)
    return F.when(F.length(F.trim(t)) == 0, 0.0).otherwise(score)

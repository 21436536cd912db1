"""Operator 3: line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Lines are the parts of a text between line feeds. A line is a sequence of units: of words (the parts between single
spaces) if it has ``MIN_WORDS`` of them, else of characters. A line is removed if an equal line stands earlier, in a
document of a smaller key or further up in the same document, or if a line of the same kind of units that is one
inserted, deleted or replaced unit away does. Lines of characters are compared from ``MIN_CHARS`` on: in shorter ones
(a number in a heading, say) one character is a difference of its own. This is judged on the input, not on what is left.

1. Occurrences are reduced to distinct lines (128 bits of hash) with their earliest place.
2. Two lines within one edit share their first or their last half: lines that share neither with any other line have
   no neighbour and are done. This only spares work, no pair is lost.
3. Each other line emits itself and all its variants with one unit deleted, as hashed keys made from running
   exclusive ors, so the keys of a line of n units cost n steps and not n squared. Lines that meet at a variant deleted
   at the same position differ by one replaced unit; a line that equals another's variant differs by one deleted unit.
   A key is reduced to the earliest line at it, so a group of any size yields one link a member and no pairs.
4. The edit distance of each line and its earliest neighbour is verified on their units.

With ``wide``, a line also goes if an earlier one of as many words has at most two replaced words (lines of 20 words or
more) or three (32 or more). Lines within r replaced words share one of r + 1 segments, so no such pair is lost. What
meets is compared with the earliest line at its segment first; only lines that this leaves are compared with the others
there. Two or three inserted or deleted words are not found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialise

#: Words from which on a line is compared by words; characters from which on a shorter one is compared by characters.
MIN_WORDS, MIN_CHARS = 8, 20
#: Replaced words in lines of so many words at least, for ``wide``.
REPLACED = ((32, 3), (20, 2))
_PLACE = T.DecimalType(38, 0)
#: Bits of a place for the line, and for the hash of the text that tells rows of one key apart.
_LINE_BITS, _TEXT_BITS = 31, 28
_ROW = 1 << (_LINE_BITS + _TEXT_BITS)
#: What a place is made of: key, hash of the text, line.
AT = ("k", "t", "no")


def _place() -> Column:
    """Order of places as one number: key, hash of the text, line."""
    inner = F.shiftleft(F.col("t"), _LINE_BITS) + F.col("no")
    return (F.col("k").cast(_PLACE) * F.lit(_ROW).cast(T.DecimalType(18, 0)) + inner).cast(_PLACE)


def _with_parts(df: DataFrame) -> DataFrame:
    """df(place) with what its places are made of."""
    inner = F.pmod(F.col("place"), F.lit(_ROW).cast(T.DecimalType(18, 0))).cast("long")
    # Decimal division rounds; the inner part is taken off first, so the quotient is whole.
    df = df.withColumn("__inner", inner).withColumn("k", F.expr(f"(place - __inner) div {_ROW}").cast("long"))
    df = df.withColumn("t", F.shiftright("__inner", _LINE_BITS))
    return df.withColumn("no", F.col("__inner").bitwiseAND(F.lit((1 << _LINE_BITS) - 1).cast("long")).cast("int")).drop("__inner")


def _rows(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(k, t, text)"""
    text = F.coalesce(F.col(column), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("k"), _text_hash(column).alias("t"), text.alias("text"))


def _text_hash(column: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(column), F.lit(""))).bitwiseAND(F.lit((1 << _TEXT_BITS) - 1).cast("long"))


def _units(min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> Column:
    """Units of a line: words as a positive number, characters as a negative one, 0 for lines that are not compared."""
    words = F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1
    size = F.length("line")
    return F.when(words >= min_words, words).when(size >= min_chars, -size).otherwise(0).cast("int")


def _unit_list() -> Column:
    return F.when(F.col("n") > 0, F.split("line", " ", -1)).otherwise(F.split("line", ""))


def _half(side: str, units: Column) -> Column:
    """Key of the first or last so many units, of lines that are compared."""
    words = F.call_function("substring_index", F.col("line"), F.lit(" "), units if side == "P" else -units)
    characters = (F.left if side == "P" else F.right)(F.col("line"), units)
    return F.when(F.col("n") > 0, F.xxhash64(F.lit(side), units, words)).when(F.col("n") < 0, F.xxhash64(F.lit(side + "c"), units, characters))


def _segments(n: Column, count: int) -> Column:
    """Keys of so many segments that make up the line."""
    ends = [F.floor(n * i / count).cast("int") for i in range(count + 1)]
    cut = lambda a, b: F.call_function("substring_index", F.call_function("substring_index", F.col("line"), F.lit(" "), b), F.lit(" "), a - b)
    return F.array(*[F.xxhash64(F.lit(i), n, cut(ends[i], ends[i + 1])) for i in range(count)])


def occurrences(docs: DataFrame, key: str, column: str, wide: bool = False, units: tuple[int, int] = (MIN_WORDS, MIN_CHARS)) -> DataFrame:
    """(k, t, no, place, h1, h2, n, three keys of halves, and with wide those of segments) of every line that isn't blank."""
    n, segments = F.col("n"), None
    for least, replaced in REPLACED:
        segments = (F if segments is None else segments).when(n >= least, _segments(n, replaced + 1))
    half, odd = F.floor(F.abs("n") / 2).cast("int"), n % 2 != 0
    return (
        _rows(docs, key, column)
        .select("k", "t", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
        .where(F.trim("line") != "")
        .withColumn("n", _units(*units))
        .select(
            *AT, _place().alias("place"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("again"), "line").alias("h2"), "n",
            _half("P", half).alias("p0"),
            F.when(odd, _half("P", half + 1)).otherwise(_half("S", half)).alias("p1"),
            _half("S", half + 1).alias("s0"),
            *([segments.alias("segments")] if wide else []),
        )
    )


def _flags(numbers: str) -> Column:
    """An array of booleans: whether each number from 0 to the greatest is in the array of numbers. In steps of n log n."""
    others = F.array_except(F.sequence(F.lit(0), F.array_max(numbers)), numbers)
    marked = F.concat(
        F.transform(numbers, lambda i: F.struct(i.alias("i"), F.lit(True).alias("yes"))),
        F.transform(others, lambda i: F.struct(i.alias("i"), F.lit(False).alias("yes"))),
    )
    return F.transform(F.sort_array(marked), lambda x: x["yes"])


def _lines_at(docs: DataFrame, places: DataFrame, key: str, column: str) -> DataFrame:
    """(k, t, no, line) of the places (k, t, no)."""
    sought = places.groupBy("k", "t").agg(F.collect_set("no").alias("nos")).select("k", "t", _flags("nos").alias("flags"))
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("no"), x.alias("line")))
    return _rows(docs, key, column).join(sought, ["k", "t"]).select("k", "t", F.inline(F.filter(lines, lambda x: F.get("flags", x["no"]))))


def _neighbours(docs: DataFrame, types: DataFrame, key: str, column: str, units: tuple[int, int] = (MIN_WORDS, MIN_CHARS)) -> DataFrame:
    """(place, near): earliest places of distinct lines, and those of their earliest neighbours within one edit."""
    halves = types.where("n <> 0").select(*AT, F.explode(F.array("p0", "p1", "s0")).alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("c")).where("c > 1")
    lines = _lines_at(docs, halves.join(shared, "half", "left_semi"), key, column).withColumn("n", _units(*units))
    words = materialise(lines.select(*AT, _place().alias("place"), F.signum("n").cast("int").alias("kind"), _unit_list().alias("words")), "line-words")

    # The few lines that are left are dealt out before they become words, so the window below needs no further shuffle.
    each = words.repartition(*AT).select(*AT, "place", "kind", F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    each = each.select(*AT, "place", "kind", "n", "i", F.xxhash64("word", "i").alias("stay"), F.xxhash64("word", F.col("i") - 1).alias("move"))
    line = Window.partitionBy(*AT).orderBy("i")
    to_here = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_of = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    each = each.select("place", "kind", "n", "i", "stay", F.bit_xor("stay").over(to_here).alias("stays"), F.bit_xor("move").over(to_here).alias("moves"), F.bit_xor("move").over(all_of).alias("all_moves"))
    before = F.col("stays").bitwiseXOR(F.col("stay"))
    rest = before.bitwiseXOR(F.col("all_moves")).bitwiseXOR(F.col("moves"))
    whole = F.when(F.col("i") == F.col("n") - 1, F.struct(F.lit(-1).alias("i"), F.col("stays").alias("rest"), (F.col("kind") * F.col("n")).alias("m")))
    variants = each.select("place", F.explode(F.array_compact(F.array(F.struct("i", rest.alias("rest"), (F.col("kind") * (F.col("n") - 1)).alias("m")), whole))).alias("v")).select("place", "v.*")
    variants = materialise(variants, "line-variants")

    by_position = variants.where("i >= 0").groupBy("rest", "m", "i").agg(F.min("place").alias("near"), F.count("*").alias("c")).where("c > 1").drop("c")
    by_rest = (
        variants.groupBy("rest", "m")
        .agg(F.min(F.when(F.col("i") < 0, F.col("place"))).alias("whole"), F.min(F.when(F.col("i") >= 0, F.col("place"))).alias("part"))
        .where("whole IS NOT NULL AND part IS NOT NULL")
        .select("rest", "m", F.explode(F.array(F.struct(F.lit(False).alias("is_whole"), F.col("whole").alias("near")), F.struct(F.lit(True).alias("is_whole"), F.col("part").alias("near")))).alias("e"))
        .select("rest", "m", "e.*")
    )
    own = variants.select("place", "rest", "m", "i", (F.col("i") < 0).alias("is_whole"))
    met = own.join(by_position, ["rest", "m", "i"]).select("place", "near").union(own.join(by_rest, ["rest", "m", "is_whole"]).select("place", "near"))
    nearest = met.where("near < place").groupBy("place").agg(F.min("near").alias("near"))

    pairs = nearest.join(words.select("place", "words"), "place").withColumnRenamed("words", "a").join(words.select(F.col("place").alias("near"), F.col("words").alias("b")), "near")
    return pairs.where(within_one_edit(F.col("a"), F.col("b"))).select("place", "near")


def _wide_neighbours(docs: DataFrame, types: DataFrame, key: str, column: str) -> DataFrame:
    """(place, near): distinct lines with an earlier one within the wide bound."""
    each = types.where("segments IS NOT NULL").select("place", *AT, F.explode("segments").alias("segment"))
    shared = each.groupBy("segment").agg(F.count("*").alias("c"), F.min("place").alias("earliest")).where("c > 1").drop("c")
    met = materialise(each.join(shared, "segment"), "line-segments")
    lines = materialise(_lines_at(docs, met, key, column).select(_place().alias("place"), "line"), "line-texts")

    def close(pairs: DataFrame) -> DataFrame:
        both = pairs.distinct().join(lines, "place").join(lines.select(F.col("place").alias("near"), F.col("line").alias("other")), "near")
        return both.where(within_wide_bound("line", "other")).select("place", "near")

    first = materialise(close(met.where("earliest < place").select("place", F.col("earliest").alias("near"))), "line-earliest")
    left = met.where("earliest < place").join(first, "place", "left_anti").select("segment", "place", "earliest")
    others = met.select("segment", F.col("place").alias("near"))
    return first.union(close(left.join(others, "segment").where("near < place AND near > earliest").select("place", "near")))


def within_wide_bound(line: str, other: str) -> Column:
    """Whether two lines are of as many words and within the replaced words of that length."""
    a, b = F.split(line, " ", -1), F.split(other, " ", -1)
    replaced = F.size(F.filter(F.zip_with(a, b, lambda u, v: ~u.eqNullSafe(v)), lambda x: x))
    bound = F.when(F.size(a) != F.size(b), -1)
    for least, most in REPLACED:
        bound = bound.when(F.size(a) >= least, most)
    return replaced <= bound.otherwise(-1)


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether arrays of words are at edit distance 1 at most: their common head and tail leave no more than one word."""

    def common(x: Column, y: Column) -> Column:
        differs = F.array_position(F.zip_with(x, y, lambda u, v: u.eqNullSafe(v)), False)
        return F.when(differs == 0, F.least(F.size(x), F.size(y))).otherwise(differs - 1)

    return common(a, b) + common(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1


def removed_lines(docs: DataFrame, key: str = "doc_id", column: str = "text", wide: bool = False, units: tuple[int, int] = (MIN_WORDS, MIN_CHARS)) -> DataFrame:
    """(k, t, gone): the numbers, from 0, of the lines that go, for every row of docs that loses any."""
    own = occurrences(docs, key, column, wide, units)
    first = ("n", "p0", "p1", "s0", *(["segments"] if wide else []))
    types = own.groupBy("h1", "h2").agg(F.min("place").alias("place"), *[F.first(c).alias(c) for c in first])
    types = materialise(_with_parts(types), "line-types")
    near = materialise(_neighbours(docs, types, key, column, units), "line-near")
    if wide:
        near = near.union(_wide_neighbours(docs, types, key, column))
    copies = own.select(*AT, "place", "h1", "h2").join(types.select("h1", "h2", F.col("place").alias("first")), ["h1", "h2"]).where("place <> first").select(*AT)
    changed = types.join(near, "place", "left_semi").select(*AT)
    return copies.union(changed).groupBy("k", "t").agg(F.collect_set("no").alias("gone"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", column: str = "text", wide: bool = False, counts: tuple[str, str] = ("n_lines", "n_removed"), units: tuple[int, int] = (MIN_WORDS, MIN_CHARS)) -> DataFrame:
    """docs with the text of column without its removed lines, and two counts, n_lines and n_removed or other names
    (columns of these names in docs are replaced, all others stay as they are). ``units``: the words from which on lines are compared
    by words, and the characters from which on shorter ones are by characters; (1, 0) compares every line by its words.

    A null text stays null and has no lines; an empty text has one blank line. Documents that lose every line stay,
    with an empty text. Rows that repeat key and text count as one place: a line of theirs goes from all of them or
    from none. Rows that repeat a key with other texts are places of their own, in the order of a hash of their texts (28
    bits; rows whose hashes agree share what goes by line). Keys that are null keep their texts. A text of any length is one row, and
    its lines cost n log n steps. An empty table gives an empty result."""
    docs = docs.drop(*counts)
    gone = removed_lines(docs.where(F.col(key).isNotNull()), key, column, wide, units)
    gone = gone.select(F.col("k").alias("__line_k"), F.col("t").alias("__line_t"), F.size("gone").alias("__line_n"), _flags("gone").alias("__line_gone"))
    out = docs.withColumn("__line_k", F.col(key).cast("long")).withColumn("__line_t", _text_hash(column)).join(gone, ["__line_k", "__line_t"], "left")
    lines = F.split(column, "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.coalesce(F.get("__line_gone", i), F.lit(False)))
    n_removed = F.when(F.col(column).isNull(), 0).otherwise(F.coalesce("__line_n", F.lit(0))).cast("long")
    return out.select(
        *[F.when(F.col("__line_n").isNull(), F.col(c)).otherwise(F.array_join(kept, "\n")).alias(c) if c == column else c for c in docs.columns],
        F.when(F.col(column).isNull(), 0).otherwise(F.size(lines)).cast("long").alias(counts[0]),
        n_removed.alias(counts[1]),
    )


def line_report(docs: DataFrame, key: str = "doc_id", column: str = "text", wide: bool = False) -> DataFrame:
    """Per document: key, n_lines, n_removed, kept_sha256 of the text that is left (null: of nothing)."""
    kept = dedup_lines(docs.select(F.col(key).cast("long").alias(key), column), key, column, wide)
    return kept.select(key, "n_lines", "n_removed", F.sha2(F.coalesce(F.col(column), F.lit("")), 256).alias("kept_sha256"))


#: Everything at once in DuckDB: the variants as texts instead of hashes.
SQL = f"""
WITH occ AS (SELECT doc_id, unnest(range(0, len(ls))) AS no, unnest(ls) AS line
             FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
types AS (SELECT line, min({{'d': doc_id, 'n': no}}) AS place FROM occ WHERE trim(line, ' ') <> '' GROUP BY line),
fuzzy AS (SELECT line, place, len(string_split(line, ' ')) >= {MIN_WORDS} AS by_words,
                 CASE WHEN len(string_split(line, ' ')) >= {MIN_WORDS} THEN string_split(line, ' ') ELSE string_split(line, '') END AS w
          FROM types WHERE len(string_split(line, ' ')) >= {MIN_WORDS} OR length(line) >= {MIN_CHARS}),
parts AS (SELECT line, by_words, place, i, CASE WHEN by_words THEN array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') ELSE array_to_string(list_concat(w[1:i - 1], w[i + 1:]), '') END AS rest
          FROM (SELECT line, by_words, place, w, unnest(range(1, len(w) + 1)) AS i FROM fuzzy)),
pos AS (SELECT by_words, rest, i, min(place) AS near FROM parts GROUP BY by_words, rest, i HAVING count(*) > 1),
per AS (SELECT by_words, rest, min(place) AS near FROM parts GROUP BY by_words, rest),
met AS (SELECT p.line FROM parts p JOIN pos ON p.by_words = pos.by_words AND p.rest = pos.rest AND p.i = pos.i AND pos.near < p.place
        UNION SELECT p.line FROM parts p JOIN fuzzy f ON p.by_words = f.by_words AND p.rest = f.line AND f.place < p.place
        UNION SELECT f.line FROM fuzzy f JOIN per ON per.by_words = f.by_words AND per.rest = f.line AND per.near < f.place),
gone AS (SELECT occ.doc_id, occ.no FROM occ JOIN types USING (line) LEFT JOIN met USING (line)
         WHERE {{'d': occ.doc_id, 'n': occ.no}} <> types.place OR met.line IS NOT NULL)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END :: BIGINT AS n_lines,
       coalesce(g.n, 0) :: BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY no) AS kept FROM occ ANTI JOIN gone USING (doc_id, no) GROUP BY doc_id) k USING (doc_id)
"""

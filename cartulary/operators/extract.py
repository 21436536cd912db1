"""Entities by regular expressions: one row a match, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shapes of Brazilian identifiers, money, codes of diseases and medical registrations.
CPF = r"(\d{3}\.\d{3}\.\d{3}-\d{2})"
CNPJ = r"(\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2})"
MONEY = r"R\$\s*(\d{1,3}(?:\.\d{3})*,\d{2})"
CID = r"\b([A-TV-Z]\d{2}(?:\.\d)?)\b"
CRM = r"(?i)\bCRM(?:\s*[/-]?\s*[A-Z]{2})?\s*[:nº.]*\s*(\d{4,7})"
DATE = r"\b(\d{2}/\d{2}/\d{4})\b"

SEMANTIC = {"cpf": CPF, "cnpj": CNPJ, "money": MONEY, "cid": CID, "crm": CRM}


def matches(df: DataFrame, keep: list[str], text: str, patterns: dict[str, str]) -> DataFrame:
    """(keep, kind, ord, value): every match of the first group of each pattern, repeats included."""

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), 1), lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("ord"), v.alias("value")))

    found = [of(k, p) for k, p in patterns.items()]
    return df.select(*keep, F.explode(F.flatten(F.array(*found))).alias("m")).select(*keep, "m.*")


def money(value: Column) -> Column:
    """`1.234,56` as a decimal."""
    return F.try_to_number(F.replace(F.replace(value, F.lit("."), F.lit("")), F.lit(","), F.lit(".")), F.lit("99999999999999.99")).cast("decimal(18,2)")


def code_context_ok(text: Column, literal: Column, good: list[str], bad: list[str]) -> Column:
    """Whether the line of a code's first occurrence speaks for it: some good term or no bad one."""
    at = F.instr(text, literal)
    head = F.substring_index(F.left(text, at - 1), "\n", -1)
    line = F.lower(F.concat(head, F.substring_index(F.substring(text, at, F.length(text)), "\n", 1)))
    has = lambda terms: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(line, t))
    return (at > 0) & (has(good) | ~has(bad))


def leave(text: Column) -> Column:
    """struct(stay_start, stay_end, leave_days) of sick notes: `internado do dia D1 ao dia D2`, `afastado por N dias`."""
    span = r"(?iu)internad[oa](?:\(a\))?[^\n]*?do dia\s+(\d{2}/\d{2}/\d{4})\s+ao dia\s+(\d{2}/\d{2}/\d{4})"
    day = lambda i: F.try_to_date(F.nullif(F.regexp_extract(text, span, i), F.lit("")), "dd/MM/yyyy")
    days = F.nullif(F.regexp_extract(text, r"(?iu)afastad[oa](?:\(a\))?[^\n]*?por\s+(\d{1,4})\s+dias?", 1), F.lit("")).cast("int")
    return F.struct(day(1).alias("stay_start"), day(2).alias("stay_end"), days.alias("leave_days"))


def matching_lines(df: DataFrame, keep: list[str], text: str, groups: dict[str, str], most: int = 50) -> DataFrame:
    """(keep, block, line_no, line): distinct lines that match the pattern of a block, the first so many of each."""
    from .ranking import best, keep_first

    lines = df.select(*keep, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    hits = None
    for block, pattern in groups.items():
        own = lines.where(F.col("line").rlike(pattern)).withColumn("block", F.lit(block))
        hits = own if hits is None else hits.unionByName(own)
    distinct = keep_first(hits, [*keep, "block", "line"], ["line_no"])
    return best(distinct, [*keep, "block"], [F.col("line_no").asc()], most)


def near_lines(df: DataFrame, keep: list[str], text: str, mark: str, reach: int = 3) -> DataFrame:
    """(keep, mark_no, line_no, line): lines within reach of a line that matches mark."""
    lines = df.select(*keep, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    marks = lines.where(F.col("line").rlike(mark)).select(*keep, F.col("line_no").alias("mark_no"), F.explode(F.sequence(F.col("line_no") - reach, F.col("line_no") + reach)).alias("line_no"))
    return marks.join(lines, [*keep, "line_no"])

"""Dates of documents: strings in several formats, validated only where that is asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Portuguese months, with and without accent.
MONTHS = {"janeiro": 1, "fevereiro": 2, "março": 3, "marco": 3, "abril": 4, "maio": 5, "junho": 6, "julho": 7, "agosto": 8, "setembro": 9, "outubro": 10, "novembro": 11, "dezembro": 12}


def parse_day(text: Column) -> Column:
    """dd/MM/yyyy, else yyyy-MM-dd at the start; null where it is no day of the calendar."""
    day_first = F.try_to_date(F.when(text.rlike(r"^\d{2}/\d{2}/\d{4}$"), text), "dd/MM/yyyy")
    return F.coalesce(day_first, F.try_to_date(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10)), "yyyy-MM-dd"))


def iso_of_day_first(text: Column) -> Column:
    """dd/MM/yyyy turned round, whether or not it is a day of the calendar; null for other shapes."""
    parts = [F.regexp_extract(text, r"(\d{2})/(\d{2})/(\d{4})", i) for i in (3, 2, 1)]
    return F.when(text.rlike(r"\d{2}/\d{2}/\d{4}"), F.concat_ws("-", *parts))


def textual_day(text: Column) -> Column:
    """`10 de março de 2024` as a date."""
    shape = r"(?iu)(\d{1,2})\s+de\s+(\p{L}+)\s+de\s+(\d{4})"
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    month = F.try_element_at(months, F.lower(F.regexp_extract(text, shape, 2)))
    day, year = F.regexp_extract(text, shape, 1), F.regexp_extract(text, shape, 3)
    return F.when(month.isNotNull(), F.try_to_date(F.format_string("%s-%02d-%s", year, month, F.lpad(day, 2, "0")), "yyyy-MM-dd"))


def plus_days(start: Column, days: Column) -> Column:
    """The day so many days after another one; null without either."""
    return F.date_add(start.cast("date"), days.cast("int"))


def floor_days(start: Column, end: Column) -> Column:
    """Whole days from start to end, rounded down, so two hours over midnight are 0 and back again are -1."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("long")


def display(timestamp: Column, raw: Column) -> Column:
    return F.coalesce(F.date_format(timestamp, "dd/MM/yyyy HH:mm"), raw)

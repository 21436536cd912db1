"""Checksums and shapes of identifiers, as column expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import let


def check_digit(digits: Column, weights: list[int]) -> Column:
    """Modulo 11: what is missing to 11 of the weighted sum, and 0 where that is 10 or more. The digits are named once,
    so nested uses don't multiply the expression."""
    each = F.transform(F.split(digits, ""), lambda d: d.try_cast("int"))
    products = F.zip_with(each, F.array(*[F.lit(w) for w in weights]), lambda d, w: d * w)
    rest = lambda total: 11 - total % 11
    return F.aggregate(products, F.lit(0), lambda a, x: a + x, lambda total: F.when(rest(total) >= 10, 0).otherwise(rest(total)))


#: Weights of the two check digits of a person's and of a company's number.
CPF_WEIGHTS = ([*range(10, 1, -1)], [*range(11, 1, -1)])
CNPJ_WEIGHTS = ([5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2], [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])


def with_check_digits(base: Column, weights: tuple[list[int], list[int]]) -> Column:
    longer = lambda digits, w: let(digits, lambda d: F.concat(d, check_digit(d, w).cast("string")))
    return longer(longer(base, weights[0]), weights[1])


def _valid(number: Column, size: int, weights) -> Column:
    def right(digits: Column) -> Column:
        same = digits == F.repeat(F.substring(digits, 1, 1), F.lit(size))
        return (F.length(digits) == size) & ~same & (digits == with_check_digits(F.substring(digits, 1, size - 2), weights))

    return F.coalesce(let(F.regexp_replace(number, "[^0-9]", ""), right), F.lit(False))


def cpf_valid(number: Column) -> Column:
    return _valid(number, 11, CPF_WEIGHTS)


def cnpj_valid(number: Column) -> Column:
    return _valid(number, 14, CNPJ_WEIGHTS)


def phone(digits: Column) -> Column:
    """(dd) dddd-dddd or (dd) 9dddd-dddd; other shapes are null."""
    d = F.regexp_replace(digits, "[^0-9]", "")
    return F.when(F.length(d) == 10, F.format_string("(%s) %s-%s", F.substring(d, 1, 2), F.substring(d, 3, 4), F.substring(d, 7, 4))).when(
        (F.length(d) == 11) & (F.substring(d, 3, 1) == "9"), F.format_string("(%s) %s-%s", F.substring(d, 1, 2), F.substring(d, 3, 5), F.substring(d, 8, 4))
    )


#: Words that no name of a person has.
NO_NAME_WORDS = r"(?iu)\b(?:medicamentos?|subst[âa]ncias?|emitente|fornecedor|comprador|identifica[cç][aã]o|estado)\b"


def person_name(name: Column, least: int = 2, most: int = 8, stops: list[str] = (), never: str | None = NO_NAME_WORDS) -> Column:
    """Whether a string looks like a person's name: so many words, no digits, none of the stop phrases, and no word of the
    pattern ``never``."""

    def fits(clean: Column) -> Column:
        ok = let(F.size(F.split(clean, " ")), lambda n: (n >= least) & (n <= most)) & ~clean.rlike("[0-9]") & (F.length(clean) > 0)
        if never:
            ok = ok & ~clean.rlike(never)
        if stops:
            ok = ok & let(F.lower(clean), lambda low: ~functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(s)) for s in stops]))
        return ok

    return F.coalesce(let(F.trim(F.regexp_replace(name, r"\s+", " ")), fits), F.lit(False))

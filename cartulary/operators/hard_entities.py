"""Hard entities of a document: checked numbers, codes in context, money, dates with roles, stays and leaves, each with the
anchor that shows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks, dates, text
from ..functions.values import let
from . import extract, page_entities
from .ranking import best, keep_first

#: Terms that speak for and against a code near them, and how far near is.
GOOD_CODE_TERMS = ["cid", "diagnost", "hipótese", "hipotese", "doença", "doenca", "patologia", "lesão", "lesao", "f32", "f41"]
BAD_CODE_TERMS = ["rua", "avenida", "cep", "endereço", "endereco", "sala", "bloco", "apto", "lote", "telefone", "fone"]
NEAR = 120
STAY = r"(?isu)internad[oa](?:\(a\))?.{0,80}?do dia\s+(\d{2}/\d{2}/\d{4})\s+ao dia\s+(\d{2}/\d{2}/\d{4})"
LEAVE = r"(?isu)afastad[oa](?:\(a\))?.{0,80}?por\s+(\d{1,4})\s+dia"
#: Confidence of an entity that no anchor shows.
ALONE = {"cpf": 0.95, "cnpj": 0.95, "crm": 0.92, "cid": 0.95, "birth_date": 0.90, "attendance_date": 0.95, "internacao_inicio": 0.97, "internacao_fim": 0.97, "document_date": 0.84, "boxed_date": 0.97}


def code_matches(value: Column) -> Column:
    """array of struct(code, window, line): every code of a text with the characters around it and its line. The text
    is cut at its codes, so the n-th code stands between the n-th and the next part."""
    t = F.coalesce(value, F.lit(""))
    found = F.regexp_extract_all(t, F.lit(extract.CID), 1)
    between = lambda parts: F.transform(
        found,
        lambda code, i: F.struct(
            code.alias("code"), F.concat(F.right(F.get(parts, i), F.lit(NEAR)), code, F.left(F.get(parts, i + 1), F.lit(NEAR))).alias("window"),
            F.concat(F.substring_index(F.get(parts, i), "\n", -1), code, F.substring_index(F.get(parts, i + 1), "\n", 1)).alias("line"),
        ),
    )
    return let(F.split(t, extract.CID, -1), between)


def codes_in_context(value: Column) -> Column:
    """The codes whose surroundings speak for them: a good term near or in the line, or no bad term in either."""
    has = lambda c, terms: let(F.lower(c), lambda low: text.holds_any(low, terms))
    good = lambda m: has(m["window"], GOOD_CODE_TERMS) | has(m["line"], GOOD_CODE_TERMS)
    bad = lambda m: has(m["window"], BAD_CODE_TERMS) | has(m["line"], BAD_CODE_TERMS)
    return page_entities.distinct_ci(F.transform(F.filter(code_matches(value), lambda m: good(m) | ~bad(m)), lambda m: m["code"]))


def anchor_of(values: DataFrame, anchors: DataFrame, key: str, label: Column, exact_first: bool = True) -> DataFrame:
    """values(key, ord, value, label) with the page, box, snippet and confidence of an anchor of the document: one of that value, else
    the first whose value holds it or is held by it.

    anchors(key, anchor_ord, label, value, page, bbox, snippet, confidence). Both sides are joined on document and label."""
    a = anchors.select(F.col(key).alias("__k"), F.col("label").alias("__label"), F.col("value").alias("__value"), "anchor_ord", "page", "bbox", F.col("snippet").alias("anchor_snippet"), F.col("confidence").alias("anchor_confidence"))
    met = values.join(a, (F.col(key) == F.col("__k")) & (label == F.col("__label")), "left")
    exact = F.coalesce(F.col("__value") == F.col("value"), F.lit(False))
    near = exact | F.contains("__value", F.col("value")) | F.contains(F.col("value"), F.col("__value"))
    met = met.withColumn("__far", F.when(exact, 0).when(near, 1).otherwise(2))
    fits = lambda c: F.when(F.col("__far") < 2, F.col(c)).alias(c)
    chosen = best(met, [key, "ord"], [F.col("__far") if exact_first else F.lit(0), F.col("anchor_ord").asc_nulls_last()])
    return chosen.select(*values.columns, *[fits(c) for c in ("page", "bbox", "anchor_snippet", "anchor_confidence")])


def date_anchor(candidates: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """candidates(key, ord, date_iso, literal) with the box of the first date anchor of that value or of that snippet."""
    days = anchors.where("label = 'date'").select(F.col(key).alias("__k"), F.col("value").alias("__v"), F.col("snippet").alias("__s"), "anchor_ord", "page", "bbox")
    by_value = candidates.join(days, (F.col(key) == F.col("__k")) & (F.col("date_iso") == F.col("__v")))
    by_snippet = candidates.join(days, (F.col(key) == F.col("__k")) & (F.col("literal") == F.col("__s")))
    found = by_value.unionByName(by_snippet).groupBy(key, "ord").agg(F.min_by(F.struct("page", "bbox"), "anchor_ord").alias("__a"))
    return candidates.join(found, [key, "ord"], "left").select(*candidates.columns, F.col("__a.page").alias("page"), F.col("__a.bbox").alias("bbox"))


def best_person(pages: DataFrame, key: str, role: str) -> DataFrame:
    """(key, value, confidence, page): the most confident name of a role over the pages, the first of equals."""
    rows = pages.select(key, "page", F.try_element_at("people", F.lit(role)).alias("p")).where("p.name IS NOT NULL")
    return best(rows, [key], [F.col("p.confidence").desc(), F.col("page")]).select(key, F.col("p.name").alias("value"), F.col("p.confidence").alias("confidence"), "page")


def dated_roles(value: Column, literal: Column, snippet: Column) -> Column:
    """What a date of a page is, by the page and the snippet that shows it."""
    birth = F.contains(F.lower(value), F.lit("nascimento")) & F.contains(value, literal)
    return F.when(birth, "birth_date").when(F.lower(F.coalesce(snippet, literal)).rlike("são paulo|sao paulo"), "document_issue_date").otherwise("document_date_candidate")


def stay(value: Column) -> Column:
    """struct(start, end) of a stay, as literals."""
    part = lambda i: F.nullif(F.regexp_extract(value, STAY, i), F.lit(""))
    return F.struct(part(1).alias("start"), part(2).alias("end"))


def hard_entities(documents: DataFrame, pages: DataFrame, anchors: DataFrame, key: str = "document_id") -> DataFrame:
    """documents(key, text), pages(key, page, text, people, basic, clinical, dates as page_entities gives them) and
    anchors -> (key, type, role, value, value_iso, value_number, page, bbox, snippet, confidence), each entity once.

    Numbers have right check digits, codes a context that speaks for them. Dates have roles: birth, attendance, stay,
    issue; a leave of some days starts at the day of issue, else of attendance."""
    t = F.coalesce("text", F.lit(""))
    item = lambda kind, role, v, iso=None: F.struct(F.lit(kind).alias("type"), F.lit(role).cast("string").alias("role"), v.alias("value"), (F.lit(None) if iso is None else iso).cast("string").alias("value_iso"))
    digits = lambda x: F.regexp_replace(x, r"\D", "")
    numbers = [
        F.transform(F.filter(F.transform(F.regexp_extract_all(t, F.lit(page_entities.MANY["cpf"]), 1), digits), checks.cpf_valid), lambda v: item("cpf", None, v)),
        F.transform(F.filter(F.regexp_extract_all(t, F.lit(extract.CNPJ), 1), checks.cnpj_valid), lambda v: item("cnpj", None, v)),
        F.transform(F.regexp_extract_all(t, F.lit(page_entities.MANY["crm"]), 1), lambda v: item("crm", None, v)),
        F.transform(codes_in_context(t), lambda v: item("cid", None, v)),
        F.transform(F.regexp_extract_all(t, F.lit(extract.MONEY), 1), lambda v: item("valor_monetario", None, v)),
    ]
    span = stay(t)
    day = lambda c: dates.parse_day(c).cast("string")
    stays = F.filter(F.array(item("date", "internacao_inicio", span["start"], day(span["start"])), item("date", "internacao_fim", span["end"], day(span["end"]))), lambda x: x["value_iso"].isNotNull())
    own = documents.select(key, F.lit(0).alias("src"), F.posexplode(F.concat(*numbers, stays)).alias("n", "e"), F.lit(None).cast("int").alias("on_page"))

    birth = F.filter(F.array(item("date", "birth_date", F.col("basic.birth_date"), day(F.col("basic.birth_date"))), item("date", "attendance_date", F.col("clinical.attendance.date"), day(F.col("clinical.attendance.date")))), lambda x: x["value_iso"].isNotNull())
    said = F.transform("dates", lambda d: F.struct(F.lit("date").alias("type"), dated_roles(F.col("text"), d["literal"], d["literal"]).alias("role"), d["literal"].alias("value"), d["date_iso"].alias("value_iso")))
    dated = pages.select(key, F.lit(1).alias("src"), F.posexplode(F.concat(birth, said)).alias("n", "e"), F.col("page").cast("int").alias("on_page"))

    rows = own.unionByName(dated).select(key, "src", "n", "on_page", "e.*")
    rows = keep_first(rows, [key, "type", "role", "value", "value_iso"], ["src", "on_page", "n"])
    rows = rows.withColumn("ord", F.struct("src", "on_page", "n"))
    label = F.when(F.col("type") == "date", "date").otherwise(F.col("type"))
    shown = anchor_of(rows, anchors, key, label)
    alone = F.create_map(*[F.lit(x) for kv in ALONE.items() for x in kv])
    default = F.coalesce(F.try_element_at(alone, F.coalesce("role", "type")), F.when(F.col("bbox").isNotNull(), ALONE["boxed_date"]).otherwise(ALONE["document_date"]))
    found = shown.select(
        key, "type", "role", "value", "value_iso", F.when(F.col("type") == "valor_monetario", extract.money(F.col("value"))).alias("value_number"), F.coalesce("page", "on_page").alias("page"), "bbox",
        F.coalesce("anchor_snippet", "value").alias("snippet"), F.coalesce("anchor_confidence", default).cast("double").alias("confidence"),
    )
    return found.unionByName(_people(pages, key)).unionByName(_leaves(documents, found, key))


def _people(pages: DataFrame, key: str) -> DataFrame:
    out = None
    for role in ("patient", "mother", "provider"):
        df = best_person(pages, key, role).select(key, F.lit(f"{role}_name").alias("type"), F.lit(None).cast("string").alias("role"), "value", *_nothing("value_iso", "value_number"), F.col("page").cast("int").alias("page"), *_nothing("bbox"), F.col("value").alias("snippet"), F.col("confidence").cast("double").alias("confidence"))
        out = df if out is None else out.unionByName(df)
    return out


_TYPES = {"value_iso": "string", "value_number": "decimal(18,2)", "bbox": "array<double>", "page": "int"}


def _nothing(*names: str) -> list[Column]:
    return [F.lit(None).cast(_TYPES[n]).alias(n) for n in names]


def _leaves(documents: DataFrame, found: DataFrame, key: str) -> DataFrame:
    days = F.nullif(F.regexp_extract(F.coalesce("text", F.lit("")), LEAVE, 1), F.lit("")).cast("int")
    base = found.where("role IN ('document_issue_date', 'attendance_date')").groupBy(key).agg(F.min_by("value_iso", F.struct((F.col("role") == "attendance_date").alias("r"), F.coalesce("page", F.lit(999)).alias("p"), "value_iso")).alias("base"))
    rows = documents.select(key, days.alias("days")).where("days IS NOT NULL").join(base, key)
    end = F.date_add(F.to_date("base"), F.col("days"))
    item = lambda kind, role, v, iso, n, sure: F.struct(F.lit(kind).alias("type"), F.lit(role).alias("role"), v.cast("string").alias("value"), iso.cast("string").alias("value_iso"), n.cast("decimal(18,2)").alias("value_number"), F.lit(sure).alias("confidence"))
    none = F.lit(None)
    made = F.array(item("date", "afastamento_inicio", F.col("base"), F.col("base"), none, 0.86), item("date", "afastamento_fim_estimado", F.date_format(end, "dd/MM/yyyy"), end, none, 0.78), item("duration_days", "afastamento_dias", F.col("days"), none, F.col("days"), 0.90))
    return rows.select(key, F.inline(made)).select(key, "type", "role", "value", "value_iso", "value_number", *_nothing("page", "bbox"), F.col("value").alias("snippet"), "confidence")

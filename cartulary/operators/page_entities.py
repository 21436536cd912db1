"""What a page says about people, places, numbers, codes and medicines: one struct of columns a page.

Labels and shapes are patterns, each applied once to the text of a page. Names are candidates with scores that depend on
the lines around them, and the best candidate of each role is chosen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks, dates, text
from ..functions.values import let
from ..session import kept
from . import confidence_of

# --- fixed values: shapes of labels and numbers ----------------------------------------------------------------------

_NAME = r"([A-ZÁÀÃÂÉÊÍÓÔÕÚÇ][A-ZÁÀÃÂÉÊÍÓÔÕÚÇ\s]{5,}?)"
_PATIENT_ENDS = r"(?=\s+(?:Nome\s+da\s+m[aã]e|M[aã]e|Genitora|Filia[cç][aã]o|Nascimento|Sexo|RGHC|RG|CPF|Data(?:/Hora)?|Idade|Prontu[aá]rio|Prestador)[:;\s]|\n|$)"
#: The first group of each is the value.
SINGLE = {
    "patient_name": rf"(?iu)(?:nome\s+paciente|nome\s+do\s+paciente|paciente|nome(?!\s+da\s+m[aã]e))[:;\s]+(?:(?:sr(?:a)?|sr\.?\(a\)?|sra\.?)\.?\s+)?{_NAME}{_PATIENT_ENDS}",
    "mother_name": rf"(?iu)nome\s+da\s+m[aã]e[:;\s]+{_NAME}(?=\s+\||\s+Nome\s+paciente|\n|$)",
    "birth_date": r"(?iu)nascimento[:;\s]+(\d{2}/\d{2}/\d{4})",
    "sex": r"(?iu)sexo[:;\s]+([A-Za-zÀ-ÿ]+)",
    "age": r"(?iu)\bidade[:;\s]+(\d{1,3})\b",
    "rghc": r"(?iu)\bRGHC[:;\s]+([A-Z0-9]+)\b",
    "address_line": r"(?iu)((?:Avenida|Av\.|Rua|R\.|Travessa|Praça)\s+[A-Za-zÀ-ÿ0-9\s]+,\s*\d+.*?)(?=\n|CEP|Telefone|Fone|$)",
    "cep": r"\b(\d{5}-?\d{3})\b",
    # What follows the letters is none of them, so a shorter run never fits: nothing is tried again.
    "city": r"\b([A-Za-zÀ-ÿ\s]++)-\s*+(?:[A-Z]{2})\b",
    "uf": r"\b(?:[A-Za-zÀ-ÿ\s]++)-\s*+([A-Z]{2})\b",
    "provider_label": rf"(?iu)prestador[:;\s]+{_NAME}(?=\s+Servico[:;\s]|\s+Serviço[:;\s]|\s+Especialidade[:;\s]|\n|$)",
    "specialty_label": r"(?iu)especialidade[:;\s]+([A-Za-zÀ-ÿ\s]{3,}?)(?=\n|Prestador|Servico|Serviço|$)",
    "service_label": r"(?iu)servi[cç]o[:;\s]+([A-Za-zÀ-ÿ\s]{3,}?)(?=\s+Especialidade[:;\s]|\n|$)",
    "attendance_date": r"(?iu)data/hora\s+atendimento[:;\s]+(\d{2}/\d{2}/\d{4})\s+(?:\d{2}:\d{2})",
    "attendance_time": r"(?iu)data/hora\s+atendimento[:;\s]+(?:\d{2}/\d{2}/\d{4})\s+(\d{2}:\d{2})",
}
#: All matches count.
MANY = {
    "cpf": r"((?=\d)(?:\b\d{3}\.\d{3}\.\d{3}-\d{2}\b|(?<![A-Za-z])\d{11}(?![\d-]|[A-Za-z])))",
    "cnpj": r"(\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b)",
    "crm": r"(?i)\bCRM(?:\s*[-:/]?\s*[A-Z]{0,2})?\s*[-:]?\s*(\d{4,8})\b",
    "dates": r"(\b\d{2}/\d{2}/\d{4}\b)",
    "phones": r"((?=[(\d])(?<!\w)(?:\(?\d{2}\)?\s*)?(?:9?\d{4})-?\d{4}(?!\w))",
    "cids": r"\b([A-TV-Z][0-9]{2}(?:\.[0-9A-Z]{1,2})?)\b",
    "posology": r"(?isu)((?:tomar|usar|aplicar)\s+.+?)(?=\n\n|\n[A-Z]{2,}|$)",
    "prescription_numbers": r"(\b01-\s*\d{6}\b)",
}
#: A name has at most 41 characters, none of them a sign or a digit, and spaces and a digit follow: elsewhere nothing is tried.
MEDICINE = r"(?iu)(?:\d+\)\s*)?(?-iu:(?=[^0-9:;,.()/\[\]]{3,41}+\s*+[0-9]))([A-ZÁÀÃÂÉÊÍÓÔÕÚÇa-zà-ÿ][A-ZÁÀÃÂÉÊÍÓÔÕÚÇa-zà-ÿ\s\-]{2,40}?)\s+(\d+(?:,\d+)?\s*(?:mg|mcg|g|ml))\b"
NO_MEDICINES = ["numero", "quantidade", "telefone", "endereco"]
ORGANISATIONS = [
    r"(?iu)(Instituto\s+Perdizes\s+do\s+Hospital\s+das\s+Clinicas)",
    r"(?iu)(Faculdade\s+de\s+Medicina\s+da\s+Universidade\s+de\s+Sao\s+Paulo)",
    r"(?iu)(AMA/UBS\s+INTEGRADA\s+SITIO\s+DA\s+CASA\s+PINTADA)",
    r"(?iu)(PREFEITURA\s+DE\s+SAO\s+PAULO)",
    r"(?iu)(SECRETARIA\s+MUNICIPAL\s+DA\s+SAUDE)",
    r"(?iu)(PMSP\s*-\s*UNIDADE\s+DE\s+SAUDE)",
    r"(?iu)\b((?:Hospital|Cl[ií]nica|Instituto|Unidade|Centro|Santa\s+Casa)\s+[A-ZÁÀÃÂÉÊÍÓÔÕÚÇa-zà-ÿ0-9][A-ZÁÀÃÂÉÊÍÓÔÕÚÇa-zà-ÿ0-9\s\-]{2,80})",
]
#: Each of the patterns above needs one of these words.
_ORGANISATION_WORDS = r"(?iu)hospital|cl[ií]nica|instituto|unidade|centro|santa\s|faculdade|AMA/UBS|prefeitura|secretaria"
_ORGANISATION_TAILS = [r"(?iu)\s+(?:CRM|CNPJ|Telefone|Fone|CEP)\b.*$", r"(?iu)\s+(?:Rua|R\.|Avenida|Av\.|Travessa|Praça)\b.*$", r"\s+\d{1,6}\b.*$"]
_WORD = r"[A-ZÁÀÃÂÉÊÍÓÔÕÚÇ][A-Za-zÁÀÃÂÉÊÍÓÔÕÚÇáàãâéêíóôõúç'\-]+"
NAME_LINE = rf"^{_WORD}(?:\s+{_WORD}){{1,5}}$"
#: A digit, or such a sign between letters, is still there when a line is cleaned, and no name has one.
_SIGN_WITHIN = r"\d|\p{L}[^\n]*[:;|/,][^\n]*\p{L}"
NO_NAME_LINE = r"(?iu)\b(?:crm|cpf|cnpj|cid|cep|telefone|fone|rua|avenida|hospital)\b"
PROVIDER_BEFORE_CRM = rf"(?iu)({_WORD}(?:\s+{_WORD}){{1,5}})\s*\(?CRM\s*[-:]?\s*\d{{4,8}}\)?"
PROVIDER_TITLE = rf"(?iu)\b(?:dr\.?|dra\.?)\s+({_WORD}(?:\s+{_WORD}){{1,5}})"
SPECIALTIES = r"(?iu)\b(cirurgia\s+geral|urologia|neurologia|ortopedia|psiquiatria|psicologia|cardiologia|cl[ií]nica\s+m[eé]dica)\b"
PROFESSIONS = r"(?iu)\b(m[eé]dico\s+cl[ií]nico|psiquiatr[aia]|psicolog[oa]|neurolog[iaa]|ortoped[iaa])\b"
#: Terms that make a piece of text core evidence.
CORE_TERMS = ["paciente", "mãe", "mae", "prestador", "crm", "cid", "data", "serviço", "servico", "especialidade"]
#: What anchors are called in snippets.
ANCHOR_NAMES = {"patient": "Paciente", "mother": "Mãe", "provider": "Prestador", "service": "Serviço", "specialty": "Especialidade", "crm": "CRM", "cid": "CID"}


# --- small parts -----------------------------------------------------------------------------------------------------


def clean(value: Column) -> Column:
    """Collapsed, without marks at the ends and courtesy titles at the start; null if nothing is left."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(value, r"\s+", " ")), r"^[ |:;,.\t]+|[ |:;,.\t]+$", "")
    return let(F.trim(F.regexp_replace(bare, r"(?iu)^(?:sr(?:a)?|sr\.?\(a\)?|sra\.?)\.?\s+", "")), lambda x: F.when(x != "", x))


def distinct_ci(values: Column) -> Column:
    """The values in order, each once whatever its case; nulls go."""
    seen = lambda have, v: F.exists(have, lambda k: F.lower(k) == F.lower(v))
    empty = F.array().cast("array<string>")
    return F.aggregate(F.coalesce(values, empty), empty, lambda have, v: F.when(v.isNull() | seen(have, v), have).otherwise(F.array_append(have, v)))


def first_of(value: Column, pattern: str, group: int = 1) -> Column:
    return clean(F.regexp_extract(value, pattern, group))


def all_of(value: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(value, F.lit(pattern), F.lit(group))


def crm_parts(value: Column) -> Column:
    """struct(number, uf, display) of a medical registration."""
    number = F.nullif(F.regexp_extract(value, r"(\d{4,8})", 1), F.lit(""))
    uf = F.nullif(F.regexp_extract(F.upper(value), r"CRM\s*[-/:]?\s*([A-Z]{2})\b|\b([A-Z]{2})\s*$", 1), F.lit(""))
    uf = F.coalesce(uf, F.nullif(F.regexp_extract(F.upper(value), r"\d\s*[-/]?\s*([A-Z]{2})\s*$", 1), F.lit("")))
    return F.when(number.isNotNull(), F.struct(number.alias("number"), uf.alias("uf"), F.concat_ws(" ", F.lit("CRM"), number, uf).alias("display")))


def name_and_role(value: Column) -> Column:
    """struct(name, role): a provider's line is parted before the last word that names the profession."""
    words = F.split(text.collapse_spaces(value), " ")
    marks = F.transform(words, lambda w, i: F.when(F.lower(w).rlike("m[eé]dic|cl[ií]nic"), i))
    at = F.array_max(marks)
    first = F.array_min(marks)
    name = F.when(at.isNull(), F.array_join(words, " ")).when(first > 0, F.array_join(F.slice(words, F.lit(1), first), " "))
    role = F.when(at.isNotNull(), F.array_join(F.slice(words, first + 1, F.size(words)), " "))
    return F.struct(F.nullif(name, F.lit("")).alias("name"), role.alias("role"))


def specialty_fallback(value: Column) -> Column:
    return F.coalesce(first_of(value, SPECIALTIES), first_of(value, PROFESSIONS))


def service_fallback(value: Column) -> Column:
    has = lambda *terms: F.upper(value).rlike("|".join(terms))
    psychology = has("PSICOLOGIA")
    return F.when(psychology & has("ENCAMINHAMENTO"), "encaminhamento para psicologia").when(psychology, "psicologia").when(has("ATESTADO", "AFASTADO", "INTERNADO"), "atendimento médico")


def signal_zone(snippet: Column) -> Column:
    """core_probative where a snippet names what the case turns on, else institutional_context."""
    return F.when(let(F.lower(F.coalesce(snippet, F.lit(""))), lambda low: text.holds_any(low, CORE_TERMS)), "core_probative").otherwise("institutional_context")


# --- entities --------------------------------------------------------------------------------------------------------


def _organisations(value: Column) -> Column:
    def bare(x: Column) -> Column:
        x = clean(x)
        for tail in _ORGANISATION_TAILS:
            x = F.trim(F.regexp_replace(x, tail, ""))
        return F.nullif(F.regexp_replace(x, r"^[ \-|,.;]+|[ \-|,.;]+$", ""), F.lit(""))

    return F.when(value.rlike(_ORGANISATION_WORDS), distinct_ci(F.transform(F.flatten(F.array(*[all_of(value, p) for p in ORGANISATIONS])), bare))).otherwise(F.array().cast("array<string>"))


def _lines(value: Column) -> Column:
    """The lines of a text that aren't blank, trimmed."""
    return F.filter(F.transform(F.split(value, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def name_lines(value: Column) -> Column:
    """Lines that are nothing but a name of two to six words."""
    return distinct_ci(F.filter(F.transform(F.filter(_lines(value), lambda x: ~x.rlike(_SIGN_WITHIN)), clean), lambda x: x.rlike(NAME_LINE) & ~x.rlike(NO_NAME_LINE)))


def _mother_fallback(value: Column, patient: Column) -> Column:
    """Beside or below the first line that speaks of the mother, unless that is the patient."""
    return let(_lines(value), lambda lines: _beside_mother(lines, patient))


def _beside_mother(lines: Column, patient: Column) -> Column:
    other = lambda x: F.when(F.lower(x) != F.lower(F.coalesce(patient, F.lit(""))), x)
    says = lambda x: F.lower(x).rlike("mãe|mae|filiação|filiacao")
    found = F.transform(
        F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), F.get(lines, i + 1).alias("next"))), lambda s: says(s["x"])),
        lambda s: F.coalesce(other(clean(F.nullif(F.regexp_extract(s["x"], r"^[^:]*:(.*)$", 1), F.lit("")))), other(clean(s["next"]))),
    )
    return F.get(F.array_compact(found), F.lit(0))


def basic_entities(value: Column) -> Column:
    """struct of people, numbers, dates, phones, organisations and place of a page. Numbers with wrong check digits
    are left out."""
    t = F.coalesce(value, F.lit(""))
    single = {n: first_of(t, SINGLE[n]) for n in ("patient_name", "mother_name", "birth_date", "sex", "age", "rghc", "address_line", "city", "uf")}
    single["mother_name"] = F.coalesce(single["mother_name"], let(single["patient_name"], lambda p: _mother_fallback(t, p)))
    digits = lambda x: F.regexp_replace(x, r"\D", "")
    cep = digits(F.regexp_extract(t, SINGLE["cep"], 1))
    single["cep"] = F.when(F.length(cep) == 8, F.concat_ws("-", F.left(cep, F.lit(5)), F.right(cep, F.lit(3))))
    lists = {
        "cpf": distinct_ci(F.filter(F.transform(all_of(t, MANY["cpf"]), digits), checks.cpf_valid)),
        "cnpj": distinct_ci(all_of(t, MANY["cnpj"])),
        "crm": distinct_ci(all_of(t, MANY["crm"])),
        "dates": distinct_ci(all_of(t, MANY["dates"])),
        "phones": distinct_ci(F.transform(all_of(t, MANY["phones"]), lambda x: checks.phone(digits(x)))),
        "organizations": _organisations(t),
        "person_candidates": name_lines(t),
    }
    return F.struct(*[c.alias(n) for n, c in {**single, **lists}.items()])


def clinical_entities(value: Column) -> Column:
    """struct of codes, medicines, posology, provider, specialty, service, prescription numbers and attendance."""
    t = F.coalesce(value, F.lit(""))
    low = F.lower(t)
    codes = F.filter(all_of(t, MANY["cids"]), lambda c: ~((c == "S30") & low.rlike("sao paulo|s30 paulo")))
    part = lambda m, group: clean(F.regexp_extract(m, MEDICINE, group))  # noqa: E731  # a match by itself matches in the same way
    pairs = F.transform(all_of(t, MEDICINE, 0), lambda m: F.struct(part(m, 1).alias("name"), part(m, 2).alias("dose")))
    real = F.filter(pairs, lambda m: m["name"].isNotNull() & m["dose"].isNotNull() & ~F.lower(m["name"]).isin(NO_MEDICINES))
    same = lambda k, m: (F.lower(k["name"]) == F.lower(m["name"])) & (F.lower(k["dose"]) == F.lower(m["dose"]))
    none = F.array().cast("array<struct<name:string,dose:string>>")
    medicines = F.aggregate(real, none, lambda have, m: F.when(F.exists(have, lambda k: same(k, m)), have).otherwise(F.array_append(have, m)))
    provider = F.coalesce(first_of(t, SINGLE["provider_label"]), first_of(t, PROVIDER_BEFORE_CRM), first_of(t, PROVIDER_TITLE))
    day, hour = first_of(t, SINGLE["attendance_date"]), first_of(t, SINGLE["attendance_time"])
    return F.struct(
        distinct_ci(F.transform(codes, clean)).alias("cids"), medicines.alias("medications"), distinct_ci(F.transform(all_of(t, MANY["posology"]), clean)).alias("posology"), provider.alias("provider_name"),
        F.coalesce(first_of(t, SINGLE["specialty_label"]), specialty_fallback(t)).alias("specialty"), F.coalesce(first_of(t, SINGLE["service_label"]), service_fallback(t)).alias("service"),
        distinct_ci(F.transform(all_of(t, MANY["prescription_numbers"]), clean)).alias("prescription_numbers"), F.when(day.isNotNull(), F.struct(day.alias("date"), hour.alias("time"))).alias("attendance"),
    )


def date_candidates(value: Column) -> Column:
    """array of struct(literal, date_iso, kind): numeric days, days in words, then time stamps. Of equal ones the last
    kind counts, at the first place."""
    t = F.coalesce(value, F.lit(""))
    item = lambda literal, iso, kind: F.struct(literal.alias("literal"), iso.cast("string").alias("date_iso"), F.lit(kind).alias("kind"))
    numeric = F.transform(all_of(t, r"(\b\d{2}/\d{2}/\d{4}\b)"), lambda x: item(x, dates.iso_of_day_first(x), "numeric"))
    words = F.transform(all_of(t, r"(?iu)(\b\d{1,2}\s+de\s+\p{L}+\s+de\s+\d{4}\b)"), lambda x: item(x, dates.textual_day(x), "textual_pt"))
    stamps = F.transform(all_of(t, r"\b(\d{4}-\d{2}-\d{2})(?=[T\s]\d{2}:\d{2})"), lambda x: item(x, x, "timestamp"))
    found = F.filter(F.concat(numeric, words, stamps), lambda x: x["date_iso"].isNotNull())
    same = lambda a, b: (a["literal"] == b["literal"]) & (a["date_iso"] == b["date_iso"])
    none = F.array().cast("array<struct<literal:string,date_iso:string,kind:string>>")
    put = lambda have, x: F.transform(have, lambda k: F.when(same(k, x), x).otherwise(k))
    return F.aggregate(found, none, lambda have, x: F.when(F.exists(have, lambda k: same(k, x)), put(have, x)).otherwise(F.array_append(have, x)))


# --- names and their scores ------------------------------------------------------------------------------------------

#: Words around a name that speak for or against a role.
PATIENT_LABEL = r"(?iu)\bnome\s+paciente\b|\bpaciente\s*:|\bnome\s*:"
PATIENT_CONTEXT = r"(?iu)\b(?:paciente|internado|internada|afastado|afastada|sr\(a\)|sra?\.)"
MOTHER_CONTEXT = r"(?iu)\b(?:m[aã]e|filia[cç][aã]o|genitora)\b"
MOTHER_LABEL = r"(?iu)nome\s+da\s+m[ãa]e"
DOCTOR_CONTEXT = r"(?iu)crm|dra|dr\.|m[ée]dico"
PRESCRIPTION_CONTEXT = r"(?iu)uso oral|medicamentos|subst[âa]ncias|emitente|estado de"
PROVIDER_LABEL = r"(?iu)\b(prestador|m[eé]dico|emitente|profissional)\s*:"
NO_PATIENT = r"(?iu)\b(?:estado|emitente|medicamentos?|subst[âa]ncias?|fornecedor|comprador)\b"
NO_PROVIDER = r"(?iu)\b(?:medicamentos?|subst[âa]ncias?|emitente|fornecedor|comprador|identifica[cç][aã]o|estado)\b"
#: A character that stands for a name in a text.
MARK = "\x01"
NO_PERSON = ["hospital", "prefeitura", "secretaria", "receituário", "receituario", "atestado", "são paulo", "sao paulo", "universidade", "instituto", "faculdade"]


def candidate_rows(pages: DataFrame, keep: list[str], candidates: dict[str, Column], value: str = "text") -> DataFrame:
    """pages -> (keep, role, name, around): each role's candidates that look like names, with a struct of the name, the first line that
    holds it, its number, the lines next to it as a window, and the text in lower case with a mark in place of the name, so that
    patterns around names are the same for all. A page's candidates are few, so its lines are searched in place."""
    lines = _lines(F.coalesce(F.col(value), F.lit("")))
    of_role = lambda role: lambda n: F.struct(F.lit(role).alias("role"), n.alias("name"))
    each = F.concat(*[F.transform(distinct_ci(c), of_role(role)) for role, c in candidates.items()])
    rows = pages.select(*keep, F.col(value).alias("page_text"), lines.alias("__lines"), F.inline(each)).where(checks.person_name(F.col("name")))
    places = F.transform("__lines", lambda x, i: F.when(F.contains(F.lower(x), F.lower(F.col("name"))), i))
    marked = F.replace(F.lower("page_text"), F.lower("name"), F.lit(MARK))

    def around(n: Column) -> Column:
        at = lambda shift: F.when(n + shift >= 0, F.get("__lines", n + shift))
        return F.struct(F.col("name").alias("name"), n.alias("line_no"), at(0).alias("line"), F.concat_ws(" ", at(-1), at(0), at(1)).alias("window"), marked.alias("marked"))

    return rows.select(*keep, "role", "name", let(F.array_min(places), around).alias("around"))


def _points(*terms: tuple[Column, float]) -> Column:
    out = F.lit(0.0)
    for condition, points in terms:
        out = out + F.when(F.coalesce(condition, F.lit(False)), points).otherwise(0.0)
    return out


def patient_score(around: Column) -> Column:
    there, window, line, name = _parts(around)
    beside = _beside(around)
    said = [
        (there & line.rlike(PATIENT_LABEL), 12.0), (there & window.rlike(PATIENT_CONTEXT), 5.0), (there & window.rlike(MOTHER_CONTEXT), -6.0), (there & window.rlike(DOCTOR_CONTEXT), -6.0),
        (there & line.rlike(PRESCRIPTION_CONTEXT), -12.0), (there & (around["line_no"] <= 6), 1.0), (beside("", rf"(?<!\w{MARK})(?!\w)"), 1.0),
        (beside(r"(?:nome\s+paciente|paciente|nome(?!\s+da\s+m[ãa]e))\s*[:\-]?\s*"), 10.0), (beside(r"(?:esteve\s+internado\(a\)|afastado\(a\)|paciente|sr\.?\(a\)?)\D{0,20}"), 6.0),
        (beside("", r"\D{0,20}(?:esteve\s+internado\(a\)|afastado\(a\))"), 6.0), (beside("", r"\s+(?:nascimento|sexo|rghc|cpf)\b"), 2.0),
    ]
    return F.when(_is_no_person(name), -20.0).when(name.rlike(NO_PATIENT), -15.0).otherwise(_points(*said))


def mother_score(around: Column) -> Column:
    there, window, _, _ = _parts(around)
    close = _beside(around)(r"(?:m[aã]e|filia[cç][aã]o|genitora)\D{0,20}")
    return _points((there & window.rlike(MOTHER_CONTEXT), 6.0), (there & window.rlike(PATIENT_CONTEXT), -5.0), (there & window.rlike(MOTHER_LABEL), 8.0), (close, 6.0))


def provider_score(around: Column) -> Column:
    there, window, line, name = _parts(around)
    beside = _beside(around)
    said = [
        (there & line.rlike(PROVIDER_LABEL), 10.0), (there & window.rlike("(?i)crm"), 5.0), (there & window.rlike(MOTHER_CONTEXT), -8.0), (there & window.rlike(PATIENT_CONTEXT), -6.0),
        (beside(r"(?:prestador|m[eé]dico|emitente|profissional)\s*[:\-]?\s*"), 8.0), (beside("", r"\D{0,20}crm"), 4.0),
    ]
    return F.when(_is_no_person(name), -20.0).when(name.rlike(NO_PROVIDER), -15.0).otherwise(_points(*said))


def _parts(around: Column) -> tuple[Column, Column, Column, Column]:
    return around["line_no"].isNotNull(), around["window"], around["line"], around["name"]


def _beside(around: Column) -> Callable[..., Column]:
    """Whether the page has the name right after a pattern and right before another one."""
    return lambda before, after="": around["marked"].rlike(f"(?u){before}{MARK}{after}")


def _is_no_person(name: Column) -> Column:
    return let(F.lower(name), lambda low: text.holds_any(low, NO_PERSON))


SCORES = {"patient": patient_score, "mother": mother_score, "provider": provider_score}


def page_people(pages: DataFrame, keep: list[str], value: str = "text") -> DataFrame:
    """pages(keep, text) -> (keep, role, name, raw_score, confidence, review_state) of patient, mother and provider. A
    mother's name doesn't share four fifths of the patient's words."""
    t = F.col(value)
    return people_of(pages.select(*keep, t.alias("text"), basic_entities(t).alias("basic"), clinical_entities(t).alias("clinical")), keep)


def people_of(own: DataFrame, keep: list[str]) -> DataFrame:
    """page_people() of pages whose entities are known: own(keep, text, basic, clinical)."""
    return best_people(own, keep).select(*keep, F.inline(F.array_compact(F.array("patient", "mother", "provider"))))


def best_people(own: DataFrame, keep: list[str]) -> DataFrame:
    """own(keep, text, basic, clinical) -> (keep, patient, mother, provider): a row a page that has candidates, with a struct(role,
    name, raw_score, confidence, review_state) of each role, or null.

    A role's name has the highest score above 0, of equal ones the last by name. All candidates of a page are scored in one pass and
    meet once, with no more than their scores and names."""
    titled = all_of(F.coalesce("text", F.lit("")), PROVIDER_TITLE)
    label = {"patient": F.array("basic.patient_name"), "mother": F.array("basic.mother_name"), "provider": F.concat(F.array("clinical.provider_name"), titled)}
    rows = candidate_rows(own, keep, {role: F.concat(F.transform(first, clean), F.col("basic.person_candidates")) for role, first in label.items()})
    role = F.col("role")
    score = let(F.col("around"), lambda a: F.when(role == "patient", patient_score(a)).when(role == "mother", mother_score(a)).otherwise(provider_score(a)))
    scored = rows.select(*keep, "role", F.struct(score.alias("raw_score"), "name").alias("c"))
    met = scored.groupBy(*keep).agg(F.max(F.when(role == "patient", F.col("c"))).alias("patient"), F.collect_list(F.when(role == "mother", F.col("c"))).alias("mothers"), F.max(F.when(role == "provider", F.col("c"))).alias("provider"))
    met = met.withColumn("patient", F.when(F.col("patient.raw_score") > 0, F.col("patient")))
    words = lambda c: F.filter(F.split(F.lower(c), " "), lambda w: F.length(w) >= 2)
    other = lambda m: F.coalesce(text.overlap_of_smaller(words(m["name"]), words(F.col("patient.name"))) < 0.8, F.lit(True))
    met = met.withColumn("mother", F.array_max(F.filter("mothers", other)))

    def person(role: str) -> Column:
        c = F.col(role)
        sure = confidence_of.raw_score(role, c["raw_score"])
        row = F.struct(F.lit(role).alias("role"), c["name"].alias("name"), c["raw_score"].alias("raw_score"), sure.alias("confidence"), confidence_of.review(sure, 0.82).alias("review_state"))
        return F.when(c["raw_score"] > 0, row).alias(role)

    return met.select(*keep, *[person(r) for r in ("patient", "mother", "provider")])


# --- anchors and zones -----------------------------------------------------------------------------------------------


def anchors(pages: DataFrame, keep: list[str]) -> DataFrame:
    """pages(keep, patient, mother, provider, service, specialty, crms, cids, dates as in date_candidates) -> (keep, ord,
    label, value, literal, snippet): each value once, in the order of the labels."""
    one = lambda label, c: F.array(F.struct(F.lit(label).alias("label"), F.col(c).alias("value"), F.col(c).alias("literal"), F.concat(F.lit(f"{ANCHOR_NAMES[label]}: "), F.col(c)).alias("snippet")))
    many = lambda label, c: F.transform(c, lambda v: F.struct(F.lit(label).alias("label"), v.alias("value"), v.alias("literal"), F.concat(F.lit(f"{ANCHOR_NAMES[label]}: "), v).alias("snippet")))
    days = F.transform("dates", lambda d: F.struct(F.lit("date").alias("label"), d["date_iso"].alias("value"), d["literal"].alias("literal"), d["literal"].alias("snippet")))
    made = F.concat(*[one(x, x) for x in ("patient", "mother", "provider", "service", "specialty")], many("crm", "crms"), many("cid", "cids"), days)
    there = F.array_distinct(F.filter(made, lambda a: F.trim(a["value"]) != ""))
    return pages.select(*keep, F.posexplode(there).alias("ord", "a")).select(*keep, "ord", "a.*")


def place_anchors(anchor_rows: DataFrame, spans: DataFrame, keep: list[str]) -> DataFrame:
    """Anchors with the box of the span of their page that matches them best, or none.

    spans(keep, span_ord, text, bbox). Pairs are those of one page, so their number is bounded by what a page holds."""
    from . import ranking

    value, said = F.lower(text.collapse_spaces("literal")), F.lower(text.collapse_spaces("text"))
    score = F.when(value == said, 20.0).otherwise(0.0) + F.when(F.contains(said, value), 10.0).otherwise(0.0)
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: F.length(w) >= 2))
    score = score + 10.0 * text.overlap_of_smaller(words(value), words(said))
    boxed = spans.select(*keep, "span_ord", "text", "bbox")
    found = ranking.best_match(anchor_rows, boxed, keep, [*keep, "ord"], score, 8.0, ["span_ord"]).select(*keep, "ord", "bbox")
    return anchor_rows.join(found, [*keep, "ord"], "left")


def zones(anchor_rows: DataFrame) -> DataFrame:
    """Anchors as signal zones: kind of zone, confidence, review state and provenance."""
    boxed = F.col("bbox").isNotNull()
    base = F.when(F.col("label").isin("patient", "mother", "provider"), 0.78).when(F.col("label").isin("crm", "cid", "date"), 0.84).otherwise(0.68)
    sure = F.round(F.when(boxed, F.least(base + 0.12, F.lit(0.99))).otherwise(base), 3)
    rows = anchor_rows.withColumn("zone", signal_zone(F.coalesce("snippet", "value"))).withColumn("confidence", sure)
    return rows.withColumn("review_state", confidence_of.review(F.col("confidence"), 0.82)).withColumn("provenance_status", F.when(boxed, "exact").otherwise("missing"))


def analyse(pages: DataFrame, keep: list[str], value: str = "text", spans: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole of a page: (evidence, zones).

    evidence(keep, text, page_type, type_confidence, people, basic, clinical, dates); zones as above, placed on spans if
    there are any."""
    from . import medico_legal

    t = F.col(value)
    own = kept(pages.select(*keep, t.alias("text"), medico_legal.page_type(t).alias("__t"), basic_entities(t).alias("basic"), clinical_entities(t).alias("clinical"), date_candidates(t).alias("dates")), "pages")
    found = F.array_compact(F.array("patient", "mother", "provider"))
    people = best_people(own, keep).where(F.size(found) > 0).select(*keep, F.map_from_entries(F.transform(found, lambda p: F.struct(p["role"].alias("role"), F.struct(p["name"].alias("name"), p["confidence"].alias("confidence"), p["review_state"].alias("review_state"))))).alias("people"))
    evidence = own.join(people, keep, "left").select(*keep, "text", F.col("__t.value").alias("page_type"), F.col("__t.confidence").alias("type_confidence"), "people", "basic", "clinical", "dates")
    evidence = kept(evidence, "evidence")
    named = lambda role: F.try_element_at("people", F.lit(role))["name"].alias(role)
    found = evidence.select(*keep, named("patient"), named("mother"), named("provider"), F.col("clinical.service").alias("service"), F.col("clinical.specialty").alias("specialty"), F.col("basic.crm").alias("crms"), F.col("clinical.cids").alias("cids"), "dates")
    rows = anchors(found, keep)
    rows = rows.withColumn("bbox", F.lit(None).cast("array<double>")) if spans is None else place_anchors(rows, spans, keep)
    return evidence, kept(zones(rows), "zones")

"""Legal fields, facts and alerts of a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import floor_days, parse_day


def fields(df: DataFrame, key: str, named: dict[str, Column], lists: dict[str, Column] | None = None) -> DataFrame:
    """(key, field, ord, value): one row for each field that has a value, and one for each value of list fields."""
    single = [F.struct(F.lit(n).alias("field"), F.lit(0).alias("ord"), c.cast("string").alias("value")) for n, c in named.items()]

    def each(name: str, values: Column) -> Column:
        return F.transform(values, lambda v, i: F.struct(F.lit(name).alias("field"), i.alias("ord"), v.cast("string").alias("value")))

    many = [each(n, c) for n, c in (lists or {}).items()]
    rows = F.array(*single)
    for m in many:
        rows = F.concat(rows, F.coalesce(m, F.array().cast("array<struct<field:string,ord:int,value:string>>")))
    return df.select(key, F.explode(rows).alias("f")).select(key, "f.*").where(F.col("value").isNotNull())


def field_rows(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """fields back to one row a key: the last value of each field."""
    return df.groupBy(key).agg(*[F.max_by(F.when(F.col("field") == n, F.col("value")), F.when(F.col("field") == n, F.col("ord"))).alias(n) for n in names])


def facts(extracted: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Fields that map to a fact type and read as a day: (key, fact_type, date)."""
    return extracted.join(mapping, "field").withColumn("date", parse_day(F.col("value"))).where(F.col("date").isNotNull()).select(key, "fact_type", "date")


def having(case: DataFrame, key: str, *present: DataFrame) -> DataFrame:
    for p in present:
        case = case.join(p.select(key).distinct(), key, "left_semi")
    return case


def lacking(case: DataFrame, key: str, absent: DataFrame) -> DataFrame:
    return case.join(absent.select(key).distinct(), key, "left_anti")


def pair_alert(a: DataFrame, b: DataFrame, key: str, condition: Column, name: str) -> DataFrame:
    """One alert for each pair of rows of a case for which the condition holds."""
    return a.alias("a").join(b.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}")).where(condition).select(F.col(f"a.{key}").alias(key), F.lit(name).alias("alert"))


def gap_alert(rows: DataFrame, key: str, ts: str, days: int, bad: Column, name: str) -> DataFrame:
    """Cases with a bad row, or with a gap of more than so many days between rows that follow each other."""
    w = Window.partitionBy(key).orderBy(ts)
    seen = rows.withColumn("__gap", floor_days(F.lag(ts).over(w), F.col(ts)))
    found = seen.groupBy(key).agg(F.max("__gap").alias("max_gap"), F.count_if(bad).alias("n_bad"))
    return found.where((F.col("max_gap") > days) | (F.col("n_bad") > 0)).withColumn("alert", F.lit(name))


#: Codes of the seven alerts.
ALERTS = (
    "ALERTA_PRESCRICAO_SUSPENSAO_B92", "ALERTA_LIMBO_PREVIDENCIARIO", "ALERTA_CONCAUSA_AGRAVAMENTO", "ALERTA_EPI_IRREGULAR", "ALERTA_CONFLITO_NEXO_B31", "ALERTA_LOAS_TRABALHO_INFORMAL",
    "ALERTA_ACIDENTE_TRAJETO_POS_REFORMA",
)


def case_alerts(rows: DataFrame, today: Column, case: str = "case_id") -> DataFrame:
    """rows(case, doc_type, fields map<string,string>, cids array<string>) -> (case, alert), one row for each alert of a
    case; the first two once for each pair of documents. All codes of a document count, not its last one alone."""
    field = lambda name: F.try_element_at("fields", F.lit(name))
    day = lambda name: parse_day(field(name))
    of = lambda *types: rows.where(F.col("doc_type").isin(*types))
    species = F.upper(field("Especie_Beneficio"))
    says = lambda *terms: F.exists(F.map_values("fields"), lambda v: F.lower(v).rlike("|".join(terms)))
    coded = lambda *prefixes: F.exists("cids", lambda c: F.upper(c).rlike(f"^({'|'.join(prefixes)})"))
    named = lambda df, i: df.select(case, F.lit(ALERTS[i]).alias("alert"))
    cases, grants = rows.select(case).distinct(), of("PREV_CARTA_CONCESSAO")

    dismissed = of("TRAB_TRCT").where(day("Data_Demissao") < F.date_sub(today, 730)).select(case)
    first = named(dismissed.join(grants.where(species == "B92").select(case), case), 0)

    ended = of("PREV_CARTA_CONCESSAO", "PREV_LAUDO_SABI").select(case, day("DCB").alias("dcb"))
    unfit = of("SST_ASO_RETORNO").where(F.lower(field("Resultado_ASO")) == "inapto").select(case, day("Data_ASO").alias("aso"))
    second = named(ended.join(unfit, case).where("aso >= dcb"), 1)

    hired = of("TRAB_CTPS", "TRAB_FICHA_REGISTRO").withColumn("hired", day("Data_Admissao")).groupBy(case).agg(F.max("hired").alias("hired"))
    exams = of("MED_EXAME_IMAGEM").join(hired, case).select(case, "hired", day("Data_Documento").alias("seen"), F.lower(field("Conclusao_Exame")).alias("found"))
    before = exams.where(F.col("found").contains("degenerativo") & (F.col("seen") < F.col("hired")))
    after = exams.where(F.col("found").rlike("grave|incapacitante|extrusão discal|extrusao discal") & (F.col("seen") >= F.col("hired")))
    third = named(lacking(having(cases, case, before, after), case, of("SST_AET")), 2)

    gear = of("SST_FICHA_EPI").select(case, day("Data_Entrega_EPI").cast("timestamp").alias("ts"), F.coalesce(field("Numero_CA_EPI"), F.lit("")).alias("ca"))
    deaf = having(cases, case, of("MED_ATESTADO", "MED_AUDIOMETRIA").where(coded("H90")))
    irregular = gap_alert(gear, case, "ts", 180, F.col("ca") == "", "x").select(case).union(lacking(deaf, case, gear))
    fourth = named(having(deaf, case, irregular), 3)

    psychic = having(cases, case, grants.where(species == "B31"), of("MED_ATESTADO").where(coded("F32", "F41", "Z73")))
    fifth = named(lacking(psychic, case, of("SST_PCMSO").where(says("psicossoc"))), 4)

    exposed = of("MED_LAUDO_ASSISTENTE_TECNICO", "MED_PRONTUARIO_CLINICO", "MED_EXAME_IMAGEM").where(says("agrotóxicos", "agrotoxicos", "exposição", "silica", "ruído", "ruido"))
    informal = having(cases, case, of("PREV_CNIS"), grants.where(species.isin("B87", "LOAS")), exposed)
    sixth = named(lacking(informal, case, of("TRAB_CTPS")), 5)

    seventh = named(having(cases, case, of("PREV_CAT"), of("PROVA_BOLETIM_OCORRENCIA").where(says("trajeto"))), 6)
    out = first
    for df in (second, third, fourth, fifth, sixth, seventh):
        out = out.unionByName(df)
    return out

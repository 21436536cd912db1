"""Queries on canonical records: parsed literals, lines around marks, resolved people and dates, read models, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import canonical, extract, legal, medico_legal, ranking, timeline
from ..sources import signals, sinks
from .registry import query, table


@query("SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders")
def money_parse(spark, sf):
    """Amounts rendered as `R$ 1.234,56`, found and read back."""
    whole = F.format_string("%,d", F.floor(F.round(F.col("o_totalprice") * 100) / 100).cast("long"))
    shown = F.concat(F.lit("valor de R$ "), F.replace(whole, F.lit(","), F.lit(".")), F.lit(","), F.lpad((F.round(F.col("o_totalprice") * 100).cast("long") % 100).cast("string"), 2, "0"), F.lit(" pago"))
    found = extract.matches(table(spark, sf, "orders").select("o_orderkey", shown.alias("t")), ["o_orderkey"], "t", {"money": extract.MONEY})
    return found.select("o_orderkey", (extract.money(F.col("value")) * 100).cast("long").alias("cents"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def textual_dates(spark, sf):
    """Days written as words, every seventh in a month that doesn't exist."""
    names = F.array(*[F.lit(m) for m in ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")])
    month = F.when(F.col("o_orderkey") % 7 == 0, F.lit("brumário")).otherwise(F.element_at(names, F.month("o_orderdate")))
    shown = F.concat(F.lit("Recife, "), F.dayofmonth("o_orderdate").cast("string"), F.lit(" DE "), F.upper(month), F.lit(" de "), F.year("o_orderdate").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", dates.textual_day(shown).cast("string").alias("day"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS stay_start, CAST(CAST(CAST(o_orderdate AS DATE) + 5 AS DATE) AS VARCHAR) AS stay_end, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey % 90 AS INT) END AS leave_days,
          CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(CAST(o_orderdate AS DATE) + 5 + CAST(o_custkey % 90 AS INT) AS DATE) AS VARCHAR) END AS leave_end FROM orders""")
def leave_parse(spark, sf):
    day = lambda c: F.date_format(c, "dd/MM/yyyy")
    start = F.col("o_orderdate").cast("date")
    leave = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" e afastado(a) do trabalho por "), (F.col("o_custkey") % 90).cast("string"), F.lit(" dia(s)"))).otherwise("")
    note = F.concat(F.lit("Esteve INTERNADO(a) neste hospital do dia "), day(start), F.lit(" ao dia "), day(F.date_add(start, 5)), leave)
    found = table(spark, sf, "orders").select("o_orderkey", extract.leave(note).alias("l"))
    return found.select("o_orderkey", F.col("l.stay_start").cast("string").alias("stay_start"), F.col("l.stay_end").cast("string").alias("stay_end"), "l.leave_days", F.date_add("l.stay_end", F.col("l.leave_days")).cast("string").alias("leave_end"))


_LINES = "SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"


@query(f"""WITH l AS ({_LINES}), h AS (SELECT doc_id, 'shouting' AS block, i, line FROM l WHERE contains(line, '!!') UNION ALL SELECT doc_id, 'listing', i, line FROM l WHERE contains(line, ' | ')),
 d AS (SELECT doc_id, block, line, min(i) AS i FROM h GROUP BY ALL) SELECT doc_id, block, CAST(i AS INT) AS line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, block ORDER BY i) AS rn FROM d) WHERE rn <= 3""")
def block_lines(spark, sf):
    """Distinct lines of two blocks, the first three of each."""
    return extract.matching_lines(table(spark, sf, "documents"), ["doc_id"], "text", {"shouting": "!!", "listing": r" \| "}, 3).select("doc_id", "block", "line_no", "line")


@query(f"WITH l AS ({_LINES}) SELECT m.doc_id, CAST(m.i AS INT) AS mark_no, CAST(l.i AS INT) AS line_no, length(l.line) :: INT AS size FROM l m JOIN l ON l.doc_id = m.doc_id AND l.i BETWEEN m.i - 3 AND m.i + 3 WHERE contains(m.line, '@')")
def lines_near_mark(spark, sf):
    return extract.near_lines(table(spark, sf, "documents"), ["doc_id"], "text", "@").select("doc_id", "mark_no", "line_no", F.length("line").alias("size"))


@query("""SELECT user_id, event_id, rn :: INT AS rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events WHERE event_type IN ('click', 'error')) WHERE rn <= 2""")
def core_zones_top2(spark, sf):
    """Zones of a page as those of a user: the events of core kinds, the first two by value."""
    core = table(spark, sf, "events").where("event_type IN ('click', 'error')")
    first = ranking.best(core, ["user_id"], [F.col("value").desc(), F.col("event_id").asc()], 2)
    return timeline.in_order(first, ["user_id"], [F.col("value").desc(), F.col("event_id").asc()], "rank").select("user_id", "event_id", "rank")


@query("""SELECT o_custkey AS document_id, arg_min(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END) AS first_value FROM orders WHERE o_orderkey % 3 = 0 GROUP BY o_custkey""")
def first_present_value(spark, sf):
    value = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority"))
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), "o_orderkey", value.alias("first_value"))
    return ranking.first_present(rows, "document_id", "first_value", "o_orderkey")


@query("""WITH c AS (SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS literal, strftime(o_orderdate, '%Y-%m-%d') AS date_iso, o_orderkey % 4 = 0 AS boxed, o_orderkey % 5 = 0 AS birth, o_orderkey % 3 = 0 AS issued, o_orderstatus = 'F' AS medical FROM orders),
 s AS (SELECT *, 0.70 + CASE WHEN boxed THEN 0.20 ELSE 0 END + CASE WHEN medical THEN 0.05 ELSE 0 END + CASE WHEN issued THEN 0.45 ELSE 0 END AS score FROM c WHERE NOT birth)
 SELECT o_custkey, date_iso, literal FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY NOT boxed, score DESC, o_orderkey) AS rn FROM s) WHERE rn = 1""")
def document_date_argmax(spark, sf):
    """Every order of a customer as a candidate on a page of its own, some beside a birth date, some on the line of issue."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "dd/MM/yyyy")
    line = F.concat(F.when(k % 5 == 0, "nascimento ").when(k % 3 == 0, "Emissão em ").otherwise("dia "), day)
    rows = table(spark, sf, "orders").select(
        "o_custkey", k.cast("int").alias("page"), F.when(F.col("o_orderstatus") == "F", "laudo_medico").otherwise("x").alias("page_type"), F.concat(F.lit("cabeçalho\n"), line, F.lit("\nfim")).alias("page_text"), k.alias("ord"), day.alias("literal"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_iso"), F.when(k % 4 == 0, F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))).alias("bbox"), F.lit(None).cast("string").alias("snippet"),
    )
    return canonical.document_dates(rows, ["o_custkey"]).select("o_custkey", "date_iso", "literal")


_NAMES = "SELECT s_nationkey, s_suppkey, s_acctbal, CASE s_suppkey % 3 WHEN 0 THEN 'patient' WHEN 1 THEN 'mother' ELSE 'provider' END AS role, CASE s_suppkey % 4 WHEN 0 THEN 'Ana Maria Souza' WHEN 1 THEN 'Bia Costa Lima' WHEN 2 THEN 'Rua 7' ELSE 'Caio Reis Melo' END AS name FROM supplier"


@query(f"""WITH c AS (SELECT *, round(0.5 + s_acctbal / 50000, 4) + CASE WHEN role = 'patient' THEN 0.06 ELSE 0 END - CASE WHEN role = 'provider' THEN 0.09 ELSE 0.12 END AS score FROM ({_NAMES}) WHERE name <> 'Rua 7'),
 p AS (SELECT s_nationkey, name FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY score DESC, s_suppkey, name) AS rn FROM c WHERE role = 'patient') WHERE rn = 1),
 o AS (SELECT c.s_nationkey, c.role, c.name, row_number() OVER (PARTITION BY c.s_nationkey, c.role ORDER BY c.score DESC, c.s_suppkey, c.name) AS rn FROM c LEFT JOIN p ON p.s_nationkey = c.s_nationkey WHERE c.role <> 'patient' AND (p.name IS NULL OR p.name <> c.name))
 SELECT s_nationkey, 'patient' AS role, name FROM p UNION ALL SELECT s_nationkey, role, name FROM o WHERE rn = 1""")
def people_resolution(spark, sf):
    """Three roles for each nation; mother and provider are never who the patient is."""
    i = F.col("s_suppkey")
    role = F.when(i % 3 == 0, "patient").when(i % 3 == 1, "mother").otherwise("provider")
    name = F.when(i % 4 == 0, "Ana Maria Souza").when(i % 4 == 1, "Bia Costa Lima").when(i % 4 == 2, "Rua 7").otherwise("Caio Reis Melo")
    rows = table(spark, sf, "supplier").select("s_nationkey", i.cast("int").alias("page"), F.lit("x").alias("page_type"), role.alias("role"), name.alias("name"), F.round(0.5 + F.col("s_acctbal") / 50000, 4).alias("confidence"), F.lit(None).cast("array<double>").alias("bbox"), F.lit(None).cast("string").alias("snippet"), F.lit(None).cast("string").alias("crm"))
    return canonical.people(rows, ["s_nationkey"]).select("s_nationkey", "role", "name")


@query("""SELECT c.c_custkey, replace(lower(c_mktsegment), '_', ' ') || ' - ' || c_name AS title, replace(lower(c_mktsegment), '_', ' ') || '; Paciente: ' || c_name || coalesce('; Data: ' || d, '') AS summary, coalesce(d[1:7], '') AS period_label, coalesce(n, 0) :: BIGINT AS n_events
          FROM customer c LEFT JOIN (SELECT o_custkey, min(strftime(o_orderdate, '%Y-%m-%d')) AS d, count(*) AS n FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey""")
def read_model_projection(spark, sf):
    orders = table(spark, sf, "orders")
    key = F.col("c_custkey").cast("string").alias("document_id")
    first = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date_canonical"))
    none = F.lit(None).cast("string")
    docs = table(spark, sf, "customer").join(first, "c_custkey", "left").select(key, F.lit("documento").alias("media"), F.lower("c_mktsegment").alias("doc_type"), F.col("c_name").alias("patient"), none.alias("provider"), "date_canonical", F.lit(None).cast("array<string>").alias("codes"), none.alias("text"))
    events = orders.select(F.col("o_custkey").cast("string").alias("document_id"), F.col("o_orderstatus").alias("event_type"))
    models = canonical.read_model(docs, events, events.where("event_type = 'P'"))
    return models.select(F.col("document_id").cast("long").alias("c_custkey"), "title", "summary", F.coalesce("period_label", F.lit("")).alias("period_label"), F.col("n_events").cast("long").alias("n_events"))


@query("""SELECT o_custkey, arg_max(o_orderkey, epoch_us(o_orderdate) // 1000000 * 1000000 + o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey""")
def latest_version_wins(spark, sf):
    version = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) * 1000000 + F.col("o_orderkey")
    return sinks.latest(table(spark, sf, "orders").withColumn("v", version), "o_custkey", "v").select("o_custkey", "o_orderkey")


@query("""SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","missing":null}' AS contract FROM nation""")
def contract_json(spark, sf):
    nations = table(spark, sf, "nation").withColumn("missing", F.lit(None).cast("string"))
    return signals.contract(nations, "n_nationkey", "n_name", "missing")


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_id % 11 <> 0""")
def signal_decode(spark, sf):
    """Signals of which every eleventh is broken; the others give a typed row."""
    raw = table(spark, sf, "events").select(F.col("event_id").alias("document_id"), F.lit("props").alias("key"), F.when(F.col("event_id") % 11 == 0, "{broken").otherwise(F.col("props")).alias("value"))
    rows, _ = signals.decode(raw, "props", "struct<k:string>")
    return rows.where("item.k IS NOT NULL").select(F.col("document_id").alias("event_id"), "item.k")


@query("SELECT count(*) AS n FROM events WHERE event_id % 11 = 0")
def signal_warnings(spark, sf):
    raw = table(spark, sf, "events").select(F.col("event_id").alias("document_id"), F.lit("props").alias("key"), F.when(F.col("event_id") % 11 == 0, "{broken").otherwise(F.col("props")).alias("value"))
    _, warnings = signals.decode(raw, "props", "struct<k:string>")
    return warnings.agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, event_a, event_b FROM (SELECT a.o_custkey, a.o_orderkey AS event_a, b.o_orderkey AS event_b, a.o_orderdate AS ta, b.o_orderdate AS tb FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderpriority = b.o_orderpriority)
          WHERE ta < tb""")
def domain_same_code_links(spark, sf):
    """The rule of the same code in a later document, through the domain's own registry of six rules."""
    events = table(spark, sf, "orders").select(F.col("o_custkey").alias("scope_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("event_id"), F.lit("diagnostico").alias("event_type"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("cid"), F.lit(None).cast("string").alias("provider_activity"))
    found = medico_legal.causal_links(events, []).where("rule_id = 'rule_mesmo_cid_multiplos_documentos'")
    return found.select(F.col("scope_id").alias("o_custkey"), "event_a", "event_b")


@query("""SELECT DISTINCT a.o_custkey AS case_id, 'ALERTA_LIMBO_PREVIDENCIARIO' AS alert, count(*) OVER (PARTITION BY a.o_custkey) AS n FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey
          WHERE a.o_orderpriority = '1-URGENT' AND b.o_orderpriority = '5-LOW' AND b.o_orderdate >= a.o_orderdate AND b.o_orderstatus = 'F'""")
def domain_limbo_alert(spark, sf):
    """The second of the seven alerts on orders: ends of benefit and later unfit returns of the same case."""
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    ended, back = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "5-LOW"
    fields = F.when(ended, F.create_map(F.lit("DCB"), day)).otherwise(F.create_map(F.lit("Data_ASO"), day, F.lit("Resultado_ASO"), F.when(F.col("o_orderstatus") == "F", "Inapto").otherwise("apto")))
    rows = table(spark, sf, "orders").where(ended | back).select(F.col("o_custkey").alias("case_id"), F.when(ended, "PREV_LAUDO_SABI").otherwise("SST_ASO_RETORNO").alias("doc_type"), fields.alias("fields"), F.array().cast("array<string>").alias("cids"))
    return legal.case_alerts(rows, F.lit("2024-01-01").cast("date")).groupBy("case_id", "alert").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g')) AS relation_name, length(regexp_replace(c_name, '[^a-zA-Z]', '', 'g')) > 0 AS has_letters FROM customer")
def relation_names(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", text.relation_name("c_name").alias("relation_name"), (F.length(text.identity_text("c_name")) > 0).alias("has_letters"))

"""Queries on cases: causal graphs, legal fields, facts and alerts, benchmark scores, processing logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import causal, legal, scoring
from .registry import query, table

_E = "SELECT user_id, event_id, event_id AS pos, ts, event_type, json_extract_string(props, '$.k') AS code FROM events"
_PAIRS = f"SELECT a.user_id, a.event_id AS event_a, b.event_id AS event_b, a.ts AS ts_a, b.ts AS ts_b, a.code AS code_a, b.code AS code_b, a.event_type AS type_a, b.event_type AS type_b, CAST(floor((epoch_us(b.ts) - epoch_us(a.ts)) / 86400000000) AS BIGINT) AS days FROM ({_E}) a JOIN ({_E}) b ON a.user_id = b.user_id AND a.pos < b.pos"


def _events(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_id", F.col("event_id").alias("pos"), "ts", "event_type", F.get_json_object("props", "$.k").alias("code"))


def _one_rule(spark, sf, name, condition, confidence):
    found = causal.links(_events(spark, sf), ["user_id"], [causal.Rule(name, condition, confidence)])
    return found.select("user_id", "event_a", "event_b", "rule_id", "confidence")


@query(f"SELECT user_id, count(*) AS pairs, count(*) FILTER (ts_a < ts_b) AS ordered FROM ({_PAIRS}) GROUP BY user_id")
def causal_pairs(spark, sf):
    from ..operators.relations import pairs

    return pairs(_events(spark, sf), ["user_id"], "pos").select(F.col("a.user_id").alias("user_id"), (F.col("a.ts") < F.col("b.ts")).alias("o")).groupBy("user_id").agg(F.count("*").alias("pairs"), F.count_if("o").alias("ordered"))


@query(f"SELECT user_id, event_a, event_b, 'same_code' AS rule_id, 0.82 :: DOUBLE AS confidence FROM ({_PAIRS}) WHERE code_a = code_b AND ts_a < ts_b")
def causal_same_code(spark, sf):
    return _one_rule(spark, sf, "same_code", causal.same_code(), 0.82)


@query(f"SELECT user_id, event_a, event_b, 'conflict' AS rule_id, 0.0 :: DOUBLE AS confidence FROM ({_PAIRS}) WHERE code_a = code_b AND abs(days) > 6")
def causal_conflict(spark, sf):
    return _one_rule(spark, sf, "conflict", causal.conflict(6), 0.0)


@query(f"SELECT user_id, count(*) AS n FROM ({_PAIRS}) WHERE type_b = 'purchase' AND days > 3 GROUP BY user_id")
def causal_gap(spark, sf):
    return _one_rule(spark, sf, "late", causal.later_than(3, "purchase"), 0.85).groupBy("user_id").agg(F.count("*").alias("n"))


PROGRESSION = [("1", "2"), ("2", "3"), ("10", "20"), ("30", "31"), ("50", "55")]


@query(f"SELECT user_id, event_a, event_b, 'progression' AS rule_id, 0.78 :: DOUBLE AS confidence FROM ({_PAIRS}) WHERE ts_a < ts_b AND (code_a, code_b) IN ({', '.join(map(str, PROGRESSION))})")
def causal_progression(spark, sf):
    return _one_rule(spark, sf, "progression", causal.progression(PROGRESSION), 0.78)


def _rules():
    return [causal.Rule("same_code", causal.same_code(), 0.82), causal.Rule("progression", causal.progression(PROGRESSION), 0.78), causal.Rule("confirms", causal.confirms("purchase"), 0.88), causal.Rule("conflict", causal.conflict(6), 0.0)]


_LINKS = f"""SELECT user_id, event_a, event_b, rule_id, confidence FROM (
 SELECT *, 'same_code' AS rule_id, 0.82 AS confidence FROM ({_PAIRS}) WHERE code_a = code_b AND ts_a < ts_b
 UNION ALL SELECT *, 'progression', 0.78 FROM ({_PAIRS}) WHERE ts_a < ts_b AND (code_a, code_b) IN ({', '.join(map(str, PROGRESSION))})
 UNION ALL SELECT *, 'confirms', 0.88 FROM ({_PAIRS}) WHERE type_b = 'purchase' AND code_a = code_b AND ts_a < ts_b
 UNION ALL SELECT *, 'conflict', 0.0 FROM ({_PAIRS}) WHERE code_a = code_b AND abs(days) > 6)"""


@query(f"""SELECT user_id, count(*) AS total_links, floor(CAST(sum(CAST(floor(CAST(confidence AS DOUBLE) * 100 + 0.5) AS BIGINT)) AS DOUBLE) * 100.0 :: DOUBLE / count(*) + 0.5) / 10000.0 :: DOUBLE AS mean_confidence, count(*) FILTER (confidence = 0) AS n_conflict, count(*) FILTER (confidence >= 0.8) AS n_strong,
 count(*) FILTER (confidence >= 0.6 AND confidence < 0.8) AS n_medium, count(*) FILTER (confidence > 0 AND confidence < 0.6) AS n_weak FROM ({_LINKS}) GROUP BY user_id""")
def causal_metadata(spark, sf):
    return causal.metadata(causal.links(_events(spark, sf), ["user_id"], _rules()), ["user_id"])


@query(f"""WITH l AS ({_LINKS}), g AS (SELECT user_id, max(gap) AS max_gap FROM (SELECT user_id, CAST(floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 86400000000) AS BIGINT) AS gap FROM events) GROUP BY user_id),
 c AS (SELECT user_id, count(DISTINCT nullif(lower(trim(event_type)), '')) >= 2 AS conflicting FROM events GROUP BY user_id)
 SELECT l.user_id, count(*) AS total_links, floor(CAST(sum(CAST(floor(CAST(confidence AS DOUBLE) * 100 + 0.5) AS BIGINT)) AS DOUBLE) * 100.0 :: DOUBLE / count(*) + 0.5) / 10000.0 :: DOUBLE AS mean_confidence, any_value(g.max_gap) AS max_gap, any_value(coalesce(g.max_gap > 2, false)) AS has_gap, any_value(c.conflicting) AS conflicting
 FROM l JOIN g ON g.user_id = l.user_id JOIN c ON c.user_id = l.user_id GROUP BY l.user_id""")
def causal_case_graph(spark, sf):
    """The flagship: links of every case by four rules, weakened by gaps and conflicts of the case, and summed up."""
    events = _events(spark, sf)
    totals = causal.metadata(causal.links(events, ["user_id"], _rules()), ["user_id"]).select("user_id", "total_links", "mean_confidence")
    return totals.join(causal.gaps(events, ["user_id"], "ts", 2), "user_id").join(causal.conflicting_values(events, ["user_id"], "event_type"), "user_id")


_DIM = [("ring", "#1"), ("widget", "#2"), ("gear", "5"), ("red", "#7")]


@query(f"SELECT p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM (VALUES {', '.join(map(str, _DIM))}) t(activity, fragment) WHERE contains(lower(p.p_name), t.activity) AND contains(p.p_brand, t.fragment))")
def ntep_presumption(spark, sf):
    return causal.presumption(table(spark, sf, "part"), spark.createDataFrame(_DIM, "activity string, fragment string"), "p_name", "p_brand").select("p_partkey")


@query("""WITH g AS (SELECT o_custkey, CAST(floor((epoch_us(o_orderdate) - epoch_us(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))) / 86400000000) AS BIGINT) AS gap FROM orders)
 SELECT o.o_custkey, concat_ws(',', CASE WHEN max(g.m) > 730 THEN 'gap' END, CASE WHEN count(DISTINCT o_orderpriority) >= 2 THEN 'conflicting' END, CASE WHEN date_diff('day', min(o_orderdate), max(o_orderdate)) > 1825 THEN 'late' END) AS factors
 FROM orders o JOIN (SELECT o_custkey, max(gap) AS m FROM g GROUP BY o_custkey) g ON g.o_custkey = o.o_custkey GROUP BY o.o_custkey""")
def weakening_factors(spark, sf):
    orders = table(spark, sf, "orders")
    late = orders.groupBy("o_custkey").agg((F.datediff(F.max("o_orderdate"), F.min("o_orderdate")) > 1825).alias("late"))
    all_of = causal.gaps(orders, ["o_custkey"], "o_orderdate", 730).join(causal.conflicting_values(orders, ["o_custkey"], "o_orderpriority"), "o_custkey").join(late, "o_custkey")
    return all_of.select("o_custkey", F.concat_ws(",", F.when(F.col("has_gap"), "gap"), F.when(F.col("conflicting"), "conflicting"), F.when(F.col("late"), "late")).alias("factors"))


@query("""SELECT c_custkey, field, value FROM (SELECT c_custkey, 'Nome' AS field, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'Segmento', CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END FROM customer UNION ALL SELECT c_custkey, 'Nacao', CAST(c_nationkey AS VARCHAR) FROM customer) WHERE value IS NOT NULL""")
def legal_fields_unpivot(spark, sf):
    named = {"Nome": F.col("c_name"), "Segmento": F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")), "Nacao": F.col("c_nationkey")}
    return legal.fields(table(spark, sf, "customer"), "c_custkey", named).select("c_custkey", "field", "value")


@query("SELECT c_custkey, c_name AS Nome, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS Segmento FROM customer")
def legal_fields_pivot(spark, sf):
    named = {"Nome": F.col("c_name"), "Segmento": F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))}
    return legal.field_rows(legal.fields(table(spark, sf, "customer"), "c_custkey", named), "c_custkey", ["Nome", "Segmento"])


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'abertura' ELSE 'encerramento' END AS fact_type, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderkey % 5 <> 0")
def legal_facts(spark, sf):
    shown = F.when(F.col("o_orderkey") % 5 == 0, "99/99/2024").when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("field"), shown.alias("value"))
    mapping = spark.createDataFrame([("O", "abertura"), ("F", "encerramento")], "field string, fact_type string")
    return legal.facts(rows, mapping, "o_orderkey").withColumn("date", F.col("date").cast("string"))


@query("""SELECT a.o_custkey, count(*) AS n FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'P' AND a.o_orderdate <= b.o_orderdate GROUP BY a.o_custkey""")
def alert_pair_theta(spark, sf):
    orders = table(spark, sf, "orders")
    found = legal.pair_alert(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'P'"), "o_custkey", F.col("a.o_orderdate") <= F.col("b.o_orderdate"), "LIMBO")
    return found.groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS o_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT') AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '5-LOW')
          AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P' AND o_orderpriority = '2-HIGH')""")
def alert_has_hasnot(spark, sf):
    orders, cases = table(spark, sf, "orders"), table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    have = legal.having(cases, "o_custkey", orders.where("o_orderpriority = '1-URGENT'"), orders.where("o_orderpriority = '5-LOW'"))
    return legal.lacking(have, "o_custkey", orders.where("o_orderstatus = 'P' AND o_orderpriority = '2-HIGH'"))


@query("""SELECT o_custkey, max(gap) AS max_gap, count(*) FILTER (o_totalprice < 1000) AS n_bad, 'EPI' AS alert FROM (SELECT o_custkey, o_totalprice, CAST(floor((epoch_us(o_orderdate) - epoch_us(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))) / 86400000000) AS BIGINT) AS gap FROM orders)
          GROUP BY o_custkey HAVING max(gap) > 180 OR count(*) FILTER (o_totalprice < 1000) > 0""")
def alert_gap(spark, sf):
    return legal.gap_alert(table(spark, sf, "orders"), "o_custkey", "o_orderdate", 180, F.col("o_totalprice") < 1000, "EPI")


_CHECKS = """SELECT d.source AS case_id, 'entidades' AS axis, l.quality = CAST(NOT contains(d.text, ' | ') AS INT) AS ok FROM documents d JOIN labels l ON l.doc_id = d.doc_id
 UNION ALL SELECT d.source, 'eventos', d.n_chars >= 200 FROM documents d UNION ALL SELECT d.source, 'evidencia', contains(d.text, '.') FROM documents d UNION ALL SELECT d.source, 'confiabilidade', d.lang <> 'es' FROM documents d"""
_CASES = f"""SELECT case_id, {', '.join(f"coalesce(100.0 * avg(CAST(ok AS INT)) FILTER (axis = '{a}'), 0.0) AS {a}" for a in scoring.AXES)}, count(*) FILTER (NOT ok) AS regressions FROM ({_CHECKS}) GROUP BY case_id"""
_MEAN = f"({' + '.join(scoring.AXES)}) / 5"


def _checks(spark, sf):
    docs = table(spark, sf, "documents")
    check = lambda df, axis, ok: df.select(F.col("source").alias("case_id"), F.lit(axis).alias("axis"), ok.alias("ok"))
    labelled = docs.join(table(spark, sf, "labels"), "doc_id")
    rows = check(labelled, "entidades", F.col("quality") == (~F.contains("text", F.lit(" | "))).cast("int"))
    for axis, ok in (("eventos", F.col("n_chars") >= 200), ("evidencia", F.contains("text", F.lit("."))), ("confiabilidade", F.col("lang") != "es")):
        rows = rows.unionByName(check(docs, axis, ok))
    return rows


@query(f"SELECT case_id, {', '.join(f'round({a}, 2) AS {a}' for a in scoring.AXES)}, round({_MEAN}, 2) AS score, regressions FROM ({_CASES})")
def bench_axes(spark, sf):
    return scoring.case_scores(_checks(spark, sf))


@query(f"""WITH c AS (SELECT case_id, round({_MEAN}, 2) AS score, regressions FROM ({_CASES}))
 SELECT 'src' || i AS case_id, 'clean' AS role, coalesce(c.score >= 70 AND c.regressions <= 0, false) AS ok FROM range(0, 3) t(i) LEFT JOIN c ON c.case_id = 'src' || i
 UNION ALL SELECT 'src' || i, 'sentinel', coalesce(c.regressions > 0, false) FROM range(3, 6) t(i) LEFT JOIN c ON c.case_id = 'src' || i""")
def bench_gate(spark, sf):
    named = lambda a, b: spark.range(a, b).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("case_id"))
    return scoring.gate(scoring.case_scores(_checks(spark, sf)), named(0, 3), named(3, 6), 70.0)


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def processing_log_tumbling(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", "total")

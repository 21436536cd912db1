"""Queries on resolution and timelines: candidates, consolidation, relation graphs, seeds, events, reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import confidence, dates, hashing
from ..operators import ranking, readmodel, relations, timeline
from .registry import query, table


def _scored_lines(spark, sf):
    """Line items as candidates: a supplier for each part, with a score and an order."""
    items = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", F.round(F.col("l_quantity") * (1 - F.col("l_discount")), 2).alias("score"))
    return items


_CANDIDATES = "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, round(l_quantity * (1 - l_discount), 2) AS score FROM lineitem"
_ORDER = "score DESC, l_suppkey, l_orderkey, l_linenumber"


def _order():
    return [F.col("score").desc(), F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_linenumber")]


@query(f"SELECT l_partkey, l_suppkey, l_orderkey, score FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {_ORDER}) AS rn FROM ({_CANDIDATES})) WHERE rn = 1")
def candidate_argmax(spark, sf):
    return ranking.best(_scored_lines(spark, sf), ["l_partkey"], _order()).select("l_partkey", "l_suppkey", "l_orderkey", "score")


@query(f"""WITH c AS ({_CANDIDATES}), f AS (SELECT l_partkey, l_suppkey AS first_supp FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {_ORDER}) AS rn FROM c) WHERE rn = 1),
 s AS (SELECT c.l_partkey, c.l_suppkey AS second_supp, row_number() OVER (PARTITION BY c.l_partkey ORDER BY c.score DESC, c.l_suppkey, c.l_orderkey, c.l_linenumber) AS rn FROM c JOIN f ON c.l_partkey = f.l_partkey AND c.l_suppkey <> f.first_supp)
 SELECT f.l_partkey, first_supp, second_supp FROM f LEFT JOIN (SELECT * FROM s WHERE rn = 1) s ON s.l_partkey = f.l_partkey""")
def forbidden_identity_argmax(spark, sf):
    rows = _scored_lines(spark, sf)
    first = ranking.best(rows, ["l_partkey"], _order()).select("l_partkey", "l_suppkey")
    second = ranking.best_without(rows, ["l_partkey"], "l_suppkey", first, _order()).select("l_partkey", F.col("l_suppkey").alias("second_supp"))
    return first.withColumnRenamed("l_suppkey", "first_supp").join(second, "l_partkey", "left")


@query("SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1")
def keep_first_dedup(spark, sf):
    return ranking.keep_first(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def last_wins_first_position(spark, sf):
    return ranking.last_value_first_place(table(spark, sf, "events"), ["user_id", "event_type"], "value", "event_id")


_K = "json_extract_string(props, '$.k')"


@query(f"""SELECT user_id, code, event_id, round(score :: DOUBLE, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id, code ORDER BY score DESC, event_id) AS rn FROM
 (SELECT user_id, {_K} AS code, event_id, round(CASE WHEN event_type = 'error' THEN 0.9 ELSE 0.7 END - 0.03 * (event_id % 5), 4) AS score FROM events)) WHERE rn = 1""")
def cid_consolidation(spark, sf):
    events = table(spark, sf, "events").withColumn("code", F.get_json_object("props", "$.k"))
    score = F.round(F.when(F.col("event_type") == "error", 0.9).otherwise(0.7) - 0.03 * (F.col("event_id") % 5), 4)
    return ranking.consolidate(events, ["user_id"], "code", score, ["event_id"]).select("user_id", "code", "event_id", "score")


@query("""SELECT c_custkey, round(CASE WHEN n > 0 THEN s / n END, 3) AS mean FROM (SELECT c_custkey, CAST(a > 0 AS INT) + CAST(b > 0 AS INT) + CAST(c > 0 AS INT) AS n, greatest(a, 0) + greatest(b, 0) + greatest(c, 0) AS s
          FROM (SELECT c_custkey, c_acctbal / 10000.0 AS a, (c_custkey % 5) / 7.0 AS b, (c_nationkey - 10) / 30.0 AS c FROM customer))""")
def confidence_summary(spark, sf):
    scores = [F.col("c_acctbal") / 10000.0, (F.col("c_custkey") % 5) / 7.0, (F.col("c_nationkey") - 10) / 30.0]
    return table(spark, sf, "customer").select("c_custkey", confidence.mean_of_positive(*scores).alias("mean"))


def _bucket_sql(bound):
    return f"SELECT state, count(*) AS n FROM (SELECT CASE WHEN c >= 0.95 THEN 'auto_confirmed' WHEN c >= {bound} THEN 'review_recommended' ELSE 'needs_review' END AS state FROM (SELECT round(l_quantity / 50.0, 2) AS c FROM lineitem)) GROUP BY state"


def _bucketed(spark, sf, bound):
    c = F.round(F.col("l_quantity") / 50.0, 2)
    return table(spark, sf, "lineitem").select(confidence.review_state(c, bound).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


@query(_bucket_sql(0.80))
def review_bucket_a(spark, sf):
    return _bucketed(spark, sf, 0.80)


@query(_bucket_sql(0.82))
def review_bucket_b(spark, sf):
    return _bucketed(spark, sf, 0.82)


@query("""SELECT event_id, round(least(greatest(coalesce(nullif(seed, 0.0), 0.7), CASE WHEN event_type IN ('purchase') THEN 0.92 WHEN doc IN ('error') THEN 0.84 WHEN doc IS NOT NULL THEN 0.76 ELSE 0.0 END)
          + CASE WHEN event_id % 2 = 0 THEN 0.03 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 0.02 ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN 0.02 ELSE 0 END, 1.0) :: DOUBLE, 3) AS confidence
          FROM (SELECT event_id, event_type, (event_id % 11) / 10.0 :: DOUBLE AS seed, CASE WHEN event_type <> 'view' THEN event_type END AS doc FROM events)""")
def event_confidence(spark, sf):
    i = F.col("event_id")
    doc = F.when(F.col("event_type") != "view", F.col("event_type"))
    c = confidence.event_confidence((i % 11) / 10.0, F.col("event_type"), doc, i % 2 == 0, i % 3 == 0, i % 5 == 0, ["purchase"], ["error"])
    return table(spark, sf, "events").select("event_id", c.alias("confidence"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def date_parse_fallback(spark, sf):
    """Days rendered in two formats, one that isn't in the calendar, and no day at all."""
    k = F.col("o_orderkey") % 4
    shown = F.when(k == 0, F.lit("31/02/2024")).when(k == 1, F.lit("no day")).when(k == 2, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm"))
    return table(spark, sf, "orders").select("o_orderkey", dates.parse_day(shown).cast("string").alias("day"))


@query("""SELECT event_id, CAST(floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY event_id))) / 86400000000) AS BIGINT) AS days FROM events""")
def floor_days(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf, "events").select("event_id", dates.floor_days(F.lag("ts").over(w), F.col("ts")).alias("days"))


@query("SELECT o_orderkey, CAST(CAST(CAST(o_orderdate AS DATE) + CAST(o_custkey % 90 AS INT) AS DATE) AS VARCHAR) AS estimated_end FROM orders")
def leave_estimated_end(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", dates.plus_days(F.col("o_orderdate"), F.col("o_custkey") % 90).cast("string").alias("estimated_end"))


@query("""WITH p AS (SELECT a.o_custkey, a.o_orderkey AS source, b.o_orderkey AS target, a.o_orderstatus = b.o_orderstatus AS same, abs(date_diff('day', a.o_orderdate, b.o_orderdate)) <= 30 AS close, a.o_orderpriority <> b.o_orderpriority AS differ, a.o_orderkey % 3 = 0 OR b.o_orderkey % 3 = 0 AS gap
          FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey),
 e AS (SELECT o_custkey, source, target, 'same_patient' AS relation_type FROM p WHERE same UNION ALL SELECT o_custkey, source, target, 'same_episode' FROM p WHERE close AND same UNION ALL SELECT o_custkey, source, target, 'conflict' FROM p WHERE close AND differ
       UNION ALL SELECT o_custkey, source, target, 'unknown' FROM p WHERE gap AND NOT same AND NOT (close AND differ))
 SELECT o_custkey, relation_type, count(*) AS n FROM e GROUP BY 1, 2""")
def relation_graph(spark, sf):
    pairs = relations.pairs(table(spark, sf, "orders"), ["o_custkey"], "o_orderkey")
    same = F.col("a.o_orderstatus") == F.col("b.o_orderstatus")
    close = F.abs(F.datediff("a.o_orderdate", "b.o_orderdate")) <= 30
    kinds = [("same_patient", same, 0.97), ("same_episode", close & same, 0.90), ("conflict", close & (F.col("a.o_orderpriority") != F.col("b.o_orderpriority")), 0.98)]
    gap = (F.col("a.o_orderkey") % 3 == 0) | (F.col("b.o_orderkey") % 3 == 0)
    edges = relations.edges(pairs, [F.col("a.o_custkey"), F.col("a.o_orderkey").alias("source"), F.col("b.o_orderkey").alias("target")], kinds, (gap, 0.35))
    return edges.groupBy("o_custkey", "relation_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, left(sha256(strftime(ts, '%Y-%m-%d') || '|' || event_type || '|' || CASE WHEN event_id % 3 = 0 THEN 'None' ELSE CAST(event_id % 7 AS VARCHAR) END || '|' || CAST(user_id AS VARCHAR) || '|' || props || '|path'), 16) AS seed_id FROM events")
def seed_ids(spark, sf):
    page = F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 7)
    return table(spark, sf, "events").select("event_id", hashing.seed_id(F.date_format("ts", "yyyy-MM-dd"), F.col("event_type"), page, F.col("user_id"), F.col("props"), F.lit("path")).alias("seed_id"))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, 0 AS source_ord FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders WHERE o_orderpriority = '2-HIGH' UNION ALL SELECT o_custkey, o_orderkey, 2 FROM orders)
 SELECT o_custkey, o_orderkey, CAST(source_ord AS INT) AS source_ord FROM (SELECT *, min(source_ord) OVER (PARTITION BY o_custkey) AS m FROM s) WHERE source_ord = m""")
def seeds_first_source_wins(spark, sf):
    orders = table(spark, sf, "orders")
    of = lambda p: orders.where(F.col("o_orderpriority") == p).select("o_custkey", "o_orderkey")
    return ranking.first_source_wins([of("1-URGENT"), of("2-HIGH"), orders.select("o_custkey", "o_orderkey")], "o_custkey")


_EV = "SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS date, 'e' || event_id AS evidence, event_id AS place FROM events WHERE event_id % 3 <> 0"
_SE = "SELECT user_id, event_type, strftime(ts + INTERVAL 1 DAY * (event_id % 2), '%Y-%m-%d') AS date, 's' || event_id AS evidence, event_id AS place FROM events WHERE event_id % 3 <> 1"


@query(f"""WITH e AS ({_EV}), s AS ({_SE}), n AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = s.user_id AND e.event_type = s.event_type AND e.date = s.date)),
 h AS (SELECT user_id, event_type, max(place) AS last FROM e WHERE event_type IN ('signup', 'error') GROUP BY 1, 2),
 p AS (SELECT user_id, event_type, max({{'d': date, 'p': place, 'x': evidence}}) AS b FROM n WHERE event_type IN ('signup', 'error') GROUP BY 1, 2)
 SELECT e.user_id, e.event_type, CASE WHEN p.b IS NOT NULL AND e.place = h.last THEN p.b.d ELSE e.date END AS date, CASE WHEN p.b IS NOT NULL AND e.place = h.last THEN p.b.x ELSE e.evidence END AS evidence, CASE WHEN p.b IS NOT NULL AND e.place = h.last THEN 'patched' ELSE 'event' END AS origin
 FROM e LEFT JOIN h ON e.user_id = h.user_id AND e.event_type = h.event_type LEFT JOIN p ON e.user_id = p.user_id AND e.event_type = p.event_type
 UNION ALL SELECT n.user_id, n.event_type, n.date, n.evidence, 'seed' FROM n WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.user_id = n.user_id AND h.event_type = n.event_type)""")
def timeline_reconcile(spark, sf):
    events = table(spark, sf, "events")
    row = lambda df, day, mark: df.select("user_id", "event_type", F.date_format(day, "yyyy-MM-dd").alias("date"), F.concat(F.lit(mark), F.col("event_id").cast("string")).alias("evidence"), F.col("event_id").alias("place"))
    moved = F.expr("ts + make_dt_interval(cast(event_id % 2 AS INT))")
    return timeline.reconcile(row(events.where("event_id % 3 <> 0"), F.col("ts"), "e"), row(events.where("event_id % 3 <> 1"), moved, "s"), ["user_id"], ["signup", "error"])


@query("""WITH a AS (SELECT user_id, list_sort(list(strftime(ts, '%Y-%m-%d') || event_type)) AS l FROM events WHERE user_id % 3 <> 0 GROUP BY user_id),
 b AS (SELECT user_id, list_sort(list(strftime(ts, '%Y-%m-%d') || event_type)) AS l FROM events WHERE user_id % 3 = 1 OR event_id % 10 <> 0 GROUP BY user_id)
 SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(len(a.l), 0) :: BIGINT AS n_a, coalesce(len(b.l), 0) :: BIGINT AS n_b, coalesce(a.l, []) = coalesce(b.l, []) AS consistent FROM a FULL JOIN b ON a.user_id = b.user_id""")
def timeline_consistency(spark, sf):
    rows = table(spark, sf, "events").withColumn("v", F.concat(F.date_format("ts", "yyyy-MM-dd"), F.col("event_type")))
    return timeline.consistency(rows.where("user_id % 3 <> 0"), rows.where("user_id % 3 = 1 OR event_id % 10 <> 0"), "user_id", "v")


@query("""SELECT user_id, count(*) AS total, count(*) FILTER (event_id % 4 <> 0 AND event_id % 3 = 0) AS anchored, count(*) FILTER (value / 50.0 < 0.95) AS needs_review, count(*) FILTER (lvl = 'observed') AS observed, count(*) FILTER (lvl = 'inferred') AS inferred, count(*) FILTER (lvl = 'unknown') AS unknown
          FROM (SELECT *, CASE WHEN event_id % 3 = 0 AND event_type = 'click' THEN 'observed' WHEN event_type IN ('view', 'error') THEN 'inferred' ELSE 'unknown' END AS lvl FROM events) GROUP BY user_id""")
def timeline_summary(spark, sf):
    box = F.col("event_id") % 3 == 0
    provenance = F.when(F.col("event_type") == "click", "exact").when(F.col("event_type") == "view", "inferred").when(F.col("event_type") == "error", "estimated").otherwise("other")
    rows = table(spark, sf, "events").select("user_id", F.when(F.col("event_id") % 4 != 0, F.col("event_id")).alias("page"), box.alias("has_bbox"), confidence.review_state(F.col("value") / 50.0).alias("review_state"), confidence.assertion_level(box, provenance).alias("assertion_level"))
    return timeline.summary(rows, "user_id")


@query("""WITH u AS (SELECT event_id, ts, user_id, 0 AS doc_ord FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, ts + INTERVAL 1 HOUR, user_id, 1 FROM events WHERE event_id % 3 = 0
  UNION ALL SELECT event_id, ts, user_id, 2 FROM events),
 k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY doc_ord) AS rn FROM u)
 SELECT user_id, event_id, CAST(doc_ord AS INT) AS doc_ord, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) :: INT AS merged_pos FROM k WHERE rn = 1""")
def case_merge(spark, sf):
    """Three documents of a case: one of even ids, one that has every third event an hour later, and one with all of them."""
    events = table(spark, sf, "events").select("event_id", "ts", "user_id")
    later = events.where("event_id % 3 = 0").withColumn("ts", F.expr("ts + INTERVAL 1 HOUR"))
    merged = timeline.merge([events.where("event_id % 2 = 0"), later, events], "event_id", "ts")
    return timeline.in_order(merged, ["user_id"], [F.col("ts").asc_nulls_last(), F.col("event_id")]).select("user_id", "event_id", "doc_ord", "merged_pos")


@query("""SELECT source, count(*) AS n, CAST(sum(item) AS BIGINT) AS ids FROM (
 SELECT 'events' AS source, event_id AS item FROM events WHERE event_type IN ('error') UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'labels', doc_id FROM labels WHERE quality = 0
 UNION ALL SELECT 'pages', page_id FROM pages WHERE NOT contains(html, '<title>')) GROUP BY source""")
def review_queue(spark, sf):
    item = lambda df, c: df.select(F.col(c).alias("item"))
    queue = readmodel.review_queue([("events", item(table(spark, sf, "events").where("event_type = 'error'"), "event_id")), ("orders", item(table(spark, sf, "orders").where("o_orderstatus = 'P'"), "o_orderkey")), ("labels", item(table(spark, sf, "labels").where("quality = 0"), "doc_id")), ("pages", item(table(spark, sf, "pages").where(~F.contains("html", F.lit("<title>"))), "page_id"))], ["item"])
    return queue.groupBy("source").agg(F.count("*").alias("n"), F.sum("item").alias("ids"))


@query("""WITH f AS (SELECT user_id, event_type AS kind, event_id AS ord, CASE WHEN event_id % 4 <> 0 THEN json_extract_string(props, '$.k') END AS value FROM events),
 d AS (SELECT user_id, kind, value, min(ord) AS ord FROM f WHERE value IS NOT NULL GROUP BY 1, 2, 3)
 SELECT g.user_id, g.kind, first_value, coalesce(all_values, '') AS all_values FROM (SELECT DISTINCT user_id, kind FROM f) g LEFT JOIN (SELECT user_id, kind, arg_min(value, ord) AS first_value, string_agg(value, ',' ORDER BY ord) AS all_values FROM d GROUP BY 1, 2) x ON x.user_id = g.user_id AND x.kind = g.kind""")
def entity_summary(spark, sf):
    value = F.when(F.col("event_id") % 4 != 0, F.get_json_object("props", "$.k"))
    return readmodel.entity_summary(table(spark, sf, "events").select("user_id", F.col("event_type").alias("kind"), F.col("event_id").alias("ord"), value.alias("value")), "user_id")


_RM = """SELECT o.o_orderkey AS document_id, lower(c.c_name || ' ' || c.c_mktsegment) AS search_text, strftime(o_orderdate, '%Y-%m') AS period_label, [o.o_orderpriority, o.o_orderstatus] AS tags, strftime(o_orderdate, '%Y-%m-%d') AS date_canonical, c.c_name AS patient FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""


def _read_models(spark, sf):
    both = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return both.select(F.col("o_orderkey").alias("document_id"), F.lower(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("search_text"), F.date_format("o_orderdate", "yyyy-MM").alias("period_label"), F.array("o_orderpriority", "o_orderstatus").alias("tags"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_canonical"), F.col("c_name").alias("patient"))


@query(f"SELECT document_id, date_canonical FROM ({_RM}) WHERE contains(search_text, 'machinery') AND list_contains(tags, '1-URGENT') AND date_canonical >= '1996-01-01' AND date_canonical <= '1999-12-31' AND contains(lower(patient), '00')")
def readmodel_filter(spark, sf):
    return _read_models(spark, sf).where(readmodel.matches(q="Machinery", tags=["1-URGENT"], start="1996-01-01", end="1999-12-31", patient="00")).select("document_id", "date_canonical")


@query(f"SELECT document_id, date_canonical FROM ({_RM}) ORDER BY date_canonical DESC, document_id LIMIT 20 OFFSET 40")
def readmodel_page(spark, sf):
    return readmodel.page(_read_models(spark, sf), "date_canonical", "document_id", 40, 20).select("document_id", "date_canonical")


@query("SELECT user_id FROM events GROUP BY user_id HAVING list_has_all(list(DISTINCT event_type), ['click', 'purchase', 'signup'])")
def tags_superset(spark, sf):
    tags = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("tags"))
    return tags.where(readmodel.has_all(F.col("tags"), ["click", "purchase", "signup"])).select("user_id")

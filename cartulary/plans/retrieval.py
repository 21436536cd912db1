"""Queries on files and search: printed documents read again, literals beside their spans, an inverted index, dates of models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.patterns import literal_pairs
from ..operators import process, stages
from ..operators.search_index import Index
from ..sources import pdf
from .documents import _FOLD, QUERY
from .registry import query, table

#: Characters of a printed line.
COLUMNS = 100
_LINES = f"""l AS (SELECT doc_id, n, unnest(range(0, greatest((length(line) + {COLUMNS - 1}) // {COLUMNS}, 1))) AS k, line
                 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)),
 p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, k) - 1 AS i, rtrim(substr(line, k * {COLUMNS} + 1, {COLUMNS}), ' ') AS line FROM l)"""


def printed_lines(docs):
    """documents(doc_id, text) -> doc_id, line_no, line: lines of at most COLUMNS characters."""
    cut = lambda line: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(line) / COLUMNS), F.lit(1)).cast("int") - 1), lambda k: F.substring(line, k * COLUMNS + 1, F.lit(COLUMNS)))
    return docs.select("doc_id", F.posexplode(F.flatten(F.transform(F.split("text", "\n", -1), cut))).alias("line_no", "line"))


@query(f"""WITH {_LINES} SELECT doc_id, CAST(i // {pdf.LINES_A_PAGE} + 1 AS INTEGER) AS page, count(*) AS n_lines, sha256(string_agg(line, chr(10) ORDER BY i)) AS text_sha256,
           CAST({pdf.HEIGHT} - ({pdf.HEIGHT - pdf.EDGE - pdf.FONT} - {pdf.LEAD} * min(i % {pdf.LINES_A_PAGE})) - {pdf.FONT * 8 // 10} AS DOUBLE) AS top FROM p WHERE line <> '' GROUP BY 1, 2""")
def pdf_page_texts(spark, sf):
    """Every document printed as a PDF file and read again: lines, text and the upper edge of each page that has text."""
    printed = pdf.write_documents(printed_lines(table(spark, sf, "documents")), "doc_id")
    lines = pdf.lines(pdf.spans(pdf.pages(printed.withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id")))
    rows = lines.groupBy("path", "page").agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"), F.min(F.col("bbox")[1]).alias("top"))
    return rows.select(F.col("path").cast("long").alias("doc_id"), "page", "n_lines", F.sha2(F.array_join(F.transform("l", lambda x: x["text"]), "\n"), 256).alias("text_sha256"), "top")


_WORD_PARTS = "list_distinct(list_filter(list_transform(list_slice(regexp_extract_all(text, '[A-Za-z0-9]+'), 1, 8), lambda w: substr(w, 2, 4)), lambda w: w <> ''))"


@query(f"""WITH c AS (SELECT doc_id, unnest({_WORD_PARTS}) AS literal FROM documents),
 s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS span_ord FROM documents)
 SELECT doc_id, literal, CAST(span_ord AS INTEGER) AS span_ord FROM c JOIN s USING (doc_id) WHERE contains(line, literal)""")
def layout_literals(spark, sf):
    """Each document's lines that hold parts of its first words, wherever in a word that is: all pairs, found in one pass over the lines."""
    docs = table(spark, sf, "documents")
    parts = F.array_distinct(F.filter(F.transform(F.slice(F.regexp_extract_all("text", F.lit("([A-Za-z0-9]+)"), 1), 1, 8), lambda w: F.substring(w, 2, 4)), lambda w: w != ""))
    candidates = docs.select("doc_id", F.posexplode(parts).alias("ord", "literal"))
    spans = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("span_ord", "text"))
    return literal_pairs(candidates, spans, "doc_id").select("doc_id", "literal", "span_ord")


@query(f"""WITH s AS (SELECT doc_id, text, {_FOLD} AS f FROM documents), t AS (SELECT doc_id, text, f, regexp_extract_all(f, '([a-z0-9]+)', 1) AS c FROM s),
 r AS (SELECT doc_id, text, least(1.0, len(list_filter(['the', 'and', 'die', 'les', 'missing'], lambda w : list_contains(c, w))) / 5.0 + CASE WHEN contains(f, '{QUERY}') THEN 0.25 ELSE 0 END) AS score FROM t)
 SELECT doc_id, round(score :: DOUBLE, 6) AS score, CASE WHEN length(text) <= 240 THEN text ELSE substr(text, 1, 239) || '…' END AS snippet FROM r WHERE score >= 0.15 ORDER BY score DESC, doc_id LIMIT 25""")
def indexed_search(spark, sf):
    """text_search_topk by an inverted index: the postings of five words are read, and the texts of 25 documents."""
    index = Index.build(table(spark, sf, "documents"), "doc_id", "text")
    return index.search(QUERY, 25).withColumnRenamed("key", "doc_id")


@query(f"""WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all({_FOLD}, '([a-z0-9]+)', 1)) AS t FROM documents),
 q AS (SELECT item_id, list_distinct(regexp_extract_all({_FOLD}, '([a-z0-9]+)', 1)) AS u FROM benchmark),
 r AS (SELECT item_id, doc_id, len(list_intersect(t, u)) / len(u) AS score FROM d, q WHERE len(u) > 0),
 k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score >= 0.15)
 SELECT item_id, doc_id, round(score :: DOUBLE, 6) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5""")
def indexed_search_of_items(spark, sf):
    """The five documents that hold most of the words of each benchmark item."""
    index = Index.build(table(spark, sf, "documents"), "doc_id", "text")
    return index.search_many(table(spark, sf, "benchmark"), "item_id", "text", 5).select(F.col("query").alias("item_id"), F.col("key").alias("doc_id"), "score", "rank")


@query(f"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page FROM orders),
 n AS (SELECT c_custkey AS c, c_nationkey % 4 AS how FROM customer),
 s AS (SELECT o.c, o.page, o.d, (how + page) % 3 = 0 AS birth FROM o JOIN n USING (c)),
 f AS (SELECT c, min(d) FILTER (WHERE birth) AS born, arg_min(d, page) FILTER (WHERE NOT birth) AS first, max(d) FILTER (WHERE NOT birth) AS last, max(d) AS taken FROM s GROUP BY c),
 b AS (SELECT DISTINCT c, d FROM s WHERE birth)
 SELECT f.c AS document_id, CASE WHEN how = 0 AND born IS NOT NULL AND born NOT IN (SELECT d FROM b WHERE b.c = f.c) THEN strftime(born, '%Y-%m-%d') WHEN how = 2 AND last IS NOT NULL AND last NOT IN (SELECT d FROM b WHERE b.c = f.c) THEN strftime(last, '%Y-%m-%d') WHEN how = 1 THEN strftime(taken, '%Y-%m-%dT10:20:30') ELSE strftime(first, '%Y-%m-%d') END AS date_canonical FROM f JOIN n USING (c)""")
def model_dates(spark, sf):
    """The date of each customer's papers, an order a page: an inferred date counts unless it is a birth, then that of a picture, then the first day
    that doesn't stand in a line about a birth."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("d"))
    orders = orders.withColumn("page", F.row_number().over(Window.partitionBy("document_id").orderBy("k")))
    how = table(spark, sf, "customer").select(F.col("c_custkey").alias("document_id"), (F.col("c_nationkey") % 4).alias("how"))
    day = F.date_format("d", "dd/MM/yyyy")
    birth = (F.col("how") + F.col("page")) % 3 == 0
    said = F.when(birth, F.concat(F.lit("Paciente\nData de nascimento: "), day, F.lit("\nfim"))).otherwise(F.concat(F.lit("Nascimento em outra linha\nEmitido em "), day))
    pages = orders.join(how, "document_id").withColumn("birth", birth).withColumn("text", said).withColumn("dates", F.array(F.struct(day.alias("literal"), F.date_format("d", "yyyy-MM-dd").alias("date_iso"))))
    own = lambda f, c: F.date_format(f(F.when(c, F.col("d"))), "yyyy-MM-dd")
    facts = pages.groupBy("document_id", "how").agg(own(F.min, F.col("birth")).alias("born"), own(F.max, ~F.col("birth")).alias("last"), F.date_format(F.max("d"), "yyyyMMdd' 102030'").alias("taken"))
    docs = facts.select("document_id", F.when(F.col("how") == 0, F.col("born")).when(F.col("how") == 2, F.col("last")).alias("inferred_date"), F.lit(None).cast("string").alias("estimated_date"), process.exif_date(F.when(F.col("how") == 1, F.col("taken"))).alias("exif_date"), F.lit(None).cast("struct<date_iso:string>").alias("document_date"), F.lit(None).cast("string").alias("document_type"), F.array().cast("array<string>").alias("codes"))
    docs = docs.join(stages.candidate_dates(pages.select("document_id", "page", "text", "dates")), "document_id")
    nowhere = F.struct(F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("uf")).alias("basic")
    return stages.normalised(docs, pages.select("document_id", "page", nowhere), lambda d: F.coalesce(F.array_contains("births", d), F.lit(False))).select("document_id", "date_canonical")


@query(f"""WITH {_LINES} SELECT doc_id, count(DISTINCT i // {pdf.LINES_A_PAGE}) AS n_pages, count(*) AS n_spans, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM p WHERE line <> '' GROUP BY 1""")
def printed_spans_sql(spark, sf):
    """The spans of every document printed as a PDF file, by a table function in SQL."""
    from ..sources import table_functions

    table_functions.register(spark)
    printed = pdf.write_documents(printed_lines(table(spark, sf, "documents")), "doc_id")
    return spark.sql("SELECT doc_id, count(DISTINCT s.page) AS n_pages, count(s.text) AS n_spans, sum(length(rtrim(s.text))) AS n_chars FROM {printed} f, LATERAL pdf_spans(f.content) s WHERE s.text IS NOT NULL GROUP BY doc_id", printed=printed)


@query("SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents")
def records_round_trip(spark, sf):
    """Every document as a record in the format ``records``, written by one job and read by runs of bytes."""
    from ..session import kept_path
    from ..sources import connector

    connector.register(spark)
    docs, at = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", "text"), kept_path(spark, "records")
    docs.write.format("records").option("key", "doc_id").mode("append").save(at)
    read = spark.read.format("records").schema(docs.schema).option("key", "doc_id").option("bytes", 1 << 20).load(at)
    return read.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))

"""Queries on documents: ingestion, strategies, segmentation, classification, extraction, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks, hashing, text
from ..operators import classify, extract, meeting, readmodel, segment
from .registry import query, table

_FROM, _TO = text.ACCENTED, text.PLAIN
_FOLD = f"translate(lower(trim(text)), '{_FROM}', '{_TO}')"


@query("SELECT doc_id, sha256(text) AS content_sha256, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents")
def ingest_content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", hashing.content_hash(F.col("text")).alias("content_sha256"), F.octet_length("text").cast("long").alias("size_bytes"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS content_sha256, count(*) AS copies FROM documents GROUP BY text")
def ingest_dedup_keep_first(spark, sf):
    """Keep-first by content hash, as an aggregation: it combines before the shuffle, which a window does not."""
    docs = table(spark, sf, "documents").select("doc_id", hashing.content_hash(F.col("text")).alias("content_sha256"))
    return docs.groupBy("content_sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT doc_id FROM documents d WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 2 = 0 AND e.text = d.text)")
def ingest_dedup_probe(spark, sf):
    """New arrivals (odd ids) whose content is not among those already stored (even ids)."""
    docs = table(spark, sf, "documents").select("doc_id", hashing.content_hash(F.col("text")).alias("h"))
    return docs.where("doc_id % 2 = 1").join(docs.where("doc_id % 2 = 0").select("h"), "h", "left_anti").select("doc_id")


@query("""SELECT CASE WHEN m LIKE 'image/%' THEN 'imagem' WHEN m LIKE 'audio/%' THEN 'audio' WHEN m LIKE 'video/%' THEN 'video' ELSE 'documento' END AS media, count(*) AS n
          FROM (SELECT CASE page_id % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'audio/wav' WHEN 2 THEN 'video/mp4' ELSE 'application/pdf' END AS m FROM pages) GROUP BY 1""")
def media_type_mix(spark, sf):
    mime = F.when(F.col("page_id") % 5 == 0, "image/png").when(F.col("page_id") % 5 == 1, "audio/wav").when(F.col("page_id") % 5 == 2, "video/mp4").otherwise("application/pdf")
    return table(spark, sf, "pages").select(classify.media_type(mime).alias("media")).groupBy("media").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN media IN ('audio', 'video') THEN 'forensic' WHEN media <> 'documento' THEN 'standard' WHEN pages <= 2 AND native AND NOT rotated THEN 'fast' WHEN rotated THEN 'forensic' ELSE 'standard' END AS mode,
          CASE WHEN media IN ('audio', 'video') THEN 'time_based_media' WHEN media <> 'documento' THEN 'non_document' WHEN pages <= 2 AND native AND NOT rotated THEN 'short_native_pdf' WHEN rotated THEN 'rotated_pdf' WHEN NOT native THEN 'no_native_text' ELSE 'default' END AS reason,
          CASE WHEN media IN ('audio', 'video') THEN 0.95 WHEN media <> 'documento' THEN 0.90 WHEN pages <= 2 AND native AND NOT rotated THEN 0.95 WHEN rotated THEN 0.93 WHEN NOT native THEN 0.92 ELSE 0.90 END :: DOUBLE AS confidence
          FROM (SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'audio' WHEN 1 THEN 'video' WHEN 2 THEN 'imagem' ELSE 'documento' END AS media, n_chars // 2000 + 1 AS pages, n_chars >= 400 AS native, doc_id % 7 = 0 AS rotated FROM documents)""")
def preflight_mode(spark, sf):
    i = F.col("doc_id") % 10
    media = F.when(i == 0, "audio").when(i == 1, "video").when(i == 2, "imagem").otherwise("documento")
    mode = classify.processing_mode(media, F.expr("n_chars div 2000 + 1"), F.col("n_chars") >= 400, F.col("doc_id") % 7 == 0, F.lit(True))
    return table(spark, sf, "documents").select("doc_id", mode.alias("m")).select("doc_id", "m.mode", "m.reason", "m.confidence")


_QUALITY = """CASE WHEN length(trim({t}, ' ')) = 0 THEN 0.0 ELSE least(length({t}) / 300.0, 4.0)
 + 3.0 * length(regexp_replace({t}, '[^\\p{{L}}]', '', 'g')) / greatest(length({t}), 1) + 0.5 * length(regexp_replace({t}, '[^0-9]', '', 'g')) / greatest(length({t}), 1)
 - 2.0 * length(regexp_replace({t}, '[\\p{{L}}0-9\\s.,;:!?()/%''"-]', '', 'g')) / greatest(length({t}), 1) END"""


@query(f"""SELECT doc_id, round(q, 4) AS quality, CASE WHEN q >= 2.5 AND length(text) >= 80 THEN 'native_text' WHEN length(text) = 0 THEN 'image_only' WHEN q >= 1.2 THEN 'ocr_light' ELSE 'ocr_heavy' END AS strategy
           FROM (SELECT doc_id, text, {_QUALITY.format(t='text')} AS q FROM documents)""")
def page_strategy(spark, sf):
    docs = table(spark, sf, "documents").withColumn("q", text.text_quality("text"))
    return docs.select("doc_id", F.round("q", 4).alias("quality"), segment.page_strategy(F.col("q"), F.length("text"), F.lit(1)).alias("strategy"))


@query("""SELECT doc_id, n_pages, total_chars, empty_pages, good_pages, CASE WHEN total_chars < 40 OR good_pages = 0 THEN 'ocr' WHEN good_pages = n_pages THEN 'native' ELSE 'hybrid' END AS strategy
          FROM (SELECT doc_id, count(*) AS n_pages, CAST(sum(length(l)) AS BIGINT) AS total_chars, count(*) FILTER (length(l) = 0) AS empty_pages, count(*) FILTER (length(l) >= 40) AS good_pages
                FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id)""")
def doc_strategy(spark, sf):
    pages = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.length("line").alias("n"))
    return segment.document_strategy(pages, "doc_id", "n")


@query(f"""WITH l AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
 n AS (SELECT doc_id, i // 2 AS page, t AS nt FROM l WHERE i % 2 = 0), o AS (SELECT doc_id, i // 2 AS page, t AS ot FROM l WHERE i % 2 = 1),
 b AS (SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.page, o.page) AS page, coalesce(nt, '') AS nt, coalesce(ot, '') AS ot FROM n FULL JOIN o ON n.doc_id = o.doc_id AND n.page = o.page)
 SELECT source, count(*) AS n FROM (SELECT CASE WHEN {_QUALITY.format(t='nt')} >= 2.5 AND length(nt) >= greatest(20, 0.6 * length(ot)) THEN 'native' WHEN {_QUALITY.format(t='ot')} > 0 THEN 'ocr' WHEN length(nt) > 0 THEN 'native' ELSE 'none' END AS source FROM b) GROUP BY source""")
def page_merge_quality(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t")).withColumn("page", F.expr("i div 2"))
    native = lines.where("i % 2 = 0").select("doc_id", "page", F.col("t").alias("native_text"))
    ocr = lines.where("i % 2 = 1").select("doc_id", "page", F.col("t").alias("ocr_text"))
    return segment.merge_readings(native, ocr, ["doc_id", "page"], text.text_quality).groupBy("source").agg(F.count("*").alias("n"))


_RUNS = """SELECT {by}, {order}, {kind}, CAST(1 + sum(opens) OVER (PARTITION BY {by} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment
 FROM (SELECT *, CASE WHEN rn > 1 AND {kind} <> '{absorb}' AND {kind} <> coalesce(cur, '{absorb}') THEN 1 ELSE 0 END AS opens
       FROM (SELECT {by}, {order}, {kind}, row_number() OVER w AS rn, last_value(nullif({kind}, '{absorb}') IGNORE NULLS) OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur
             FROM {table} WINDOW w AS (PARTITION BY {by} ORDER BY {order})))"""
_TURNS = _RUNS.format(by="conv_id", order="turn", kind="role", absorb="system", table="conversations")


@query(_TURNS)
def segment_page_runs(spark, sf):
    return segment.page_runs(table(spark, sf, "conversations"), "conv_id", ["turn"], "role", "system").select("conv_id", "turn", "role", F.col("segment").cast("long").alias("segment"))


@query(_RUNS.format(by="user_id", order="event_id", kind="event_type", absorb="view", table="events"))
def segment_event_runs(spark, sf):
    return segment.page_runs(table(spark, sf, "events"), "user_id", ["event_id"], "event_type", "view").select("user_id", "event_id", "event_type", F.col("segment").cast("long").alias("segment"))


@query(f"""SELECT r.conv_id, format('subdoc_{{:03d}}', r.segment) AS subdoc_id, min(r.turn) AS first_place, count(*) AS n_pages, sha256(string_agg(c.text, chr(10) ORDER BY r.turn)) AS text_sha256
           FROM ({_TURNS}) r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.turn GROUP BY 1, 2""")
def subdoc_grouping(spark, sf):
    runs = segment.page_runs(table(spark, sf, "conversations"), "conv_id", ["turn"], "role", "system").withColumn("subdoc_id", segment.subdoc_id(F.col("segment")))
    return segment.grouped_text(runs, ["conv_id", "subdoc_id"], "turn", "text").select("conv_id", "subdoc_id", "first_place", "n_pages", F.sha2("full_text", 256).alias("text_sha256"))


#: Words of the corpus languages, as a stand-in vocabulary.
SETS = {"english": ["the ", " and ", " of "], "french": [" les ", " est ", " des "], "german": [" und ", " die ", " der "], "spanish": [" los ", " que ", " las "], "shouting": ["!!", "of!!"], "listing": [" | "], "markup": ["<", ">"], "mail": ["@", ".com"]}


def _score_sql(words):
    return "(" + " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in words) + ")"


_SCORES = ", ".join(f"{_score_sql(w)} AS {k}" for k, w in SETS.items())
_TOP = f"greatest({', '.join(SETS)})"
_FIRST = "CASE " + " ".join(f"WHEN {k} = {_TOP} AND {k} > 0 THEN '{k}'" for k in SETS) + " ELSE 'unknown' END"


@query(f"""SELECT doc_id, CASE WHEN active >= 2 THEN 'composite' WHEN top >= 2 THEN first WHEN contains(lower(text), 'th') THEN 'generic' ELSE 'unknown' END AS value,
           round(CASE WHEN active >= 2 THEN 0.92 WHEN top >= 2 THEN least(0.70 + 0.08 * top, 0.95) WHEN contains(lower(text), 'th') THEN 0.55 ELSE 0.20 END :: DOUBLE, 4) AS confidence
           FROM (SELECT doc_id, text, {_TOP} AS top, {_FIRST} AS first, {' + '.join(f'CAST({k} >= 2 AS INT)' for k in SETS)} AS active FROM (SELECT doc_id, text, {_SCORES} FROM documents))""")
def keyword_taxonomy(spark, sf):
    found = classify.taxonomy(F.lower("text"), SETS, ["th"])
    return table(spark, sf, "documents").select("doc_id", found.alias("t")).select("doc_id", "t.value", F.round("t.confidence", 4).alias("confidence"))


@query(f"SELECT doc_id, {_FIRST} AS label, CAST({_TOP} AS BIGINT) AS score, round(CASE WHEN {_TOP} > 0 THEN least(0.50 + 0.10 * {_TOP}, 0.97) ELSE 0.10 END :: DOUBLE, 4) AS confidence FROM (SELECT doc_id, {_SCORES} FROM documents)")
def keyword_argmax_first_wins(spark, sf):
    scores = [(k, classify.keyword_score(F.lower("text"), w)) for k, w in SETS.items()]
    top = F.greatest(*[s for _, s in scores])
    return table(spark, sf, "documents").select("doc_id", classify.first_best(scores, "unknown").alias("label"), top.cast("long").alias("score"), F.round(F.when(top > 0, F.least(0.50 + 0.10 * top, F.lit(0.97))).otherwise(0.10), 4).alias("confidence"))


@query("""SELECT doc_id, CASE WHEN contains(text, ' | ') THEN 'listing' WHEN contains(text, '@') THEN 'contact' WHEN n_chars < 300 THEN 'short' END AS label,
          CASE WHEN contains(text, ' | ') THEN 0.90 WHEN contains(text, '@') THEN 0.88 WHEN n_chars < 300 THEN 0.82 END :: DOUBLE AS confidence FROM documents""")
def rule_engine_best(spark, sf):
    rules = [classify.Rule("short", F.col("n_chars") < 300, 0.82), classify.Rule("listing", F.contains("text", F.lit(" | ")), 0.90), classify.Rule("contact", F.contains("text", F.lit("@")), 0.88)]
    return table(spark, sf, "documents").select("doc_id", classify.best_rule(rules).alias("r")).select("doc_id", "r.label", "r.confidence")


_PATTERNS = {"ipv4": r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b", "email": r"([A-Za-z0-9._+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", "phone": r"(\(?\d{3}\)?[ -]\d{3}-\d{4})", "card": r"\b(\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4})\b"}


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, CAST(unnest(range(0, len(v))) AS BIGINT) AS ord, unnest(v) AS value FROM (SELECT doc_id, regexp_extract_all(text, '{p}', 1) AS v FROM documents)" for k, p in _PATTERNS.items()))
def regex_entities(spark, sf):
    return extract.matches(table(spark, sf, "documents"), ["doc_id"], "text", _PATTERNS).withColumn("ord", F.col("ord").cast("long"))


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html[^>]*lang="([a-z]+)"', 1) AS lang, regexp_extract(html, 'href="([^"]*)"', 1) AS first_href,
           CAST(len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS BIGINT) AS n_links FROM pages""")
def html_fields(spark, sf):
    one = lambda p: F.regexp_extract("html", p, 1)
    return table(spark, sf, "pages").select("page_id", one("<title>([^<]*)</title>").alias("title"), one('<html[^>]*lang="([a-z]+)"').alias("lang"), one('href="([^"]*)"').alias("first_href"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).cast("long").alias("n_links"))


def _digit_sql(base: str, weights: list[int]) -> str:
    total = " + ".join(f"CAST(substr({base}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(weights))
    return f"CASE WHEN 11 - ({total}) % 11 >= 10 THEN 0 ELSE 11 - ({total}) % 11 END"


def _check_sql(table_name: str, key: str, size: int, weights) -> str:
    one = f"SELECT {key}, b, b || CAST({_digit_sql('b', weights[0])} AS VARCHAR) AS d FROM (SELECT {key}, lpad(CAST({key} * 7919 + 123456 AS VARCHAR), {size}, '0') AS b FROM {table_name})"
    return f"SELECT {key}, number, {key} % 3 <> 0 AS valid FROM (SELECT {key}, d || CAST({_digit_sql('d', weights[1])} AS VARCHAR) AS number FROM ({one}))"


def _checked(df, key, size, weights, valid):
    number = checks.with_check_digits(F.lpad((F.col(key) * 7919 + 123456).cast("string"), size, "0"), weights)
    wrong = F.concat(F.substring(number, 1, size + 1), ((F.substring(number, size + 2, 1).cast("int") + 1) % 10).cast("string"))
    return df.select(key, number.alias("number"), valid(F.when(F.col(key) % 3 == 0, wrong).otherwise(number)).alias("valid"))


@query(_check_sql("customer", "c_custkey", 9, checks.CPF_WEIGHTS))
def cpf_checksum(spark, sf):
    """Check digits of a number made of each key; every third number gets a wrong one, which must be found."""
    return _checked(table(spark, sf, "customer"), "c_custkey", 9, checks.CPF_WEIGHTS, checks.cpf_valid)


@query(_check_sql("supplier", "s_suppkey", 12, checks.CNPJ_WEIGHTS))
def cnpj_checksum(spark, sf):
    return _checked(table(spark, sf, "supplier"), "s_suppkey", 12, checks.CNPJ_WEIGHTS, checks.cnpj_valid)


@query("""SELECT c_custkey, CASE WHEN length(d) = 10 THEN '(' || d[1:2] || ') ' || d[3:6] || '-' || d[7:10] WHEN length(d) = 11 AND d[3:3] = '9' THEN '(' || d[1:2] || ') ' || d[3:7] || '-' || d[8:11] END AS phone
          FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN lpad(CAST(c_custkey + 1100000000 AS VARCHAR), 10, '0') WHEN 1 THEN CAST(c_custkey + 11900000000 AS VARCHAR) ELSE CAST(c_custkey + 11500000000 AS VARCHAR) END AS d FROM customer)""")
def phone_format(spark, sf):
    k = F.col("c_custkey")
    digits = F.when(k % 3 == 0, (k + 1100000000).cast("string")).when(k % 3 == 1, (k + 11900000000).cast("string")).otherwise((k + 11500000000).cast("string"))
    return table(spark, sf, "customer").select("c_custkey", checks.phone(digits).alias("phone"))


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens_sha256 FROM (SELECT doc_id, regexp_extract_all({_FOLD}, '([a-z0-9]+)', 1) AS t FROM documents)")
def accent_fold_tokens(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", text.tokens("text").alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))


@query(f"""WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all({_FOLD}, '([a-z0-9]+)', 1)) AS t FROM documents),
 b AS (SELECT item_id, list_distinct(regexp_extract_all({_FOLD}, '([a-z0-9]+)', 1)) AS u FROM benchmark),
 p AS (SELECT doc_id, item_id, len(t) AS n, len(u) AS m, len(list_intersect(t, u)) AS c FROM d, b)
 SELECT doc_id, item_id, round((c / least(n, m)) :: DOUBLE, 6) AS overlap, round((c / (n + m - c)) :: DOUBLE, 6) AS jaccard FROM p WHERE c > 0""")
def token_pairs_by_content(spark, sf):
    """Every document beside every item that shares a token with it: the overlap of the smaller set, and Jaccard's. Shared
    tokens are counted in the task that reads the document, for all items at once."""
    one = lambda name, key, to: table(spark, sf, name).select(F.col(key).alias(to), F.lower(F.trim("text")).alias("text"))
    shared = meeting.shared_words(one("documents", "doc_id", "key"), one("benchmark", "item_id", "item"))
    # Six digits by whole numbers: as round() has them, which makes a decimal of every row.
    share = lambda of: F.expr(f"((2000000L * c + {of}) div (2L * {of})) / 1000000D")
    return shared.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), share("least(n, m)").alias("overlap"), share("(n + m - c)").alias("jaccard"))


QUERY = "the and die les missing"


@query(f"""WITH s AS (SELECT doc_id, text, {_FOLD} AS f FROM documents), t AS (SELECT doc_id, text, f, regexp_extract_all(f, '([a-z0-9]+)', 1) AS c FROM s),
 r AS (SELECT doc_id, text, least(1.0, len(list_filter(['the', 'and', 'die', 'les', 'missing'], lambda w : list_contains(c, w))) / 5.0 + CASE WHEN contains(f, '{QUERY}') THEN 0.25 ELSE 0 END) AS score FROM t)
 SELECT doc_id, round(score :: DOUBLE, 6) AS score, CASE WHEN length(text) <= 240 THEN text ELSE substr(text, 1, 239) || '…' END AS snippet FROM r WHERE score >= 0.15 ORDER BY score DESC, doc_id LIMIT 25""")
def text_search_topk(spark, sf):
    return readmodel.search(table(spark, sf, "documents"), "doc_id", "text", QUERY, 25)


@query("""SELECT doc_id, CASE WHEN i > 0 THEN (CASE WHEN s > 0 THEN '…' ELSE '' END) || substr(text, s + 1, 240) || (CASE WHEN s + 240 < length(text) THEN '…' ELSE '' END)
          WHEN length(text) <= 240 THEN text ELSE substr(text, 1, 239) || '…' END AS snippet FROM (SELECT doc_id, text, instr(lower(text), 'anth') AS i, greatest(instr(lower(text), 'anth') - 61, 0) AS s FROM documents)""")
def search_snippet(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.snippet(F.col("text"), F.lit("anth")).alias("snippet"))


_WORDS_SQL = "list_filter(list_distinct(string_split(lower({}), ' ')), lambda w : w <> '')"


@query(f"""SELECT item_id, doc_id, line_no, round(score :: DOUBLE, 4) AS score FROM (
   SELECT item_id, doc_id, line_no, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, line_no) AS rn FROM (
     SELECT b.item_id, l.doc_id, l.line_no, CASE WHEN lower(b.text) = lower(l.line) THEN 20 WHEN contains(lower(b.text), lower(l.line)) OR contains(lower(l.line), lower(b.text)) THEN 10 ELSE 0 END
        + 10 * len(list_intersect(bt, lt)) / least(len(bt), len(lt)) AS score
     FROM (SELECT item_id, text, {_WORDS_SQL.format("text")} AS bt FROM benchmark) b
     JOIN (SELECT doc_id, i AS line_no, ls[i + 1] AS line, {_WORDS_SQL.format("ls[i + 1]")} AS lt FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))) l ON len(list_intersect(bt, lt)) > 0)
   WHERE score >= 8) WHERE rn = 1""")
def span_best_line_of_all(spark, sf):
    """For each item the line of all documents that matches it best, from a score of 8 on, if they share a word."""
    one = lambda name, key, to: table(spark, sf, name).select(F.col(key).alias(to), F.lower("text").alias("text"))
    best = meeting.best_lines(one("documents", "doc_id", "key"), one("benchmark", "item_id", "item"))
    return best.select(F.col("item").alias("item_id"), F.col("key").alias("doc_id"), "line_no", F.round("score", 4).alias("score"))

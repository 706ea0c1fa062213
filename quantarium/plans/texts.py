"""Queries over texts and scalar expressions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import table
from ..functions import columns as C
from ..operators import documents as D
from ..operators import metrics as M
from .registry import query, r4

rnd = C.round_half_up


@query("strip_html_simple", r"SELECT page_id, trim(regexp_replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'gs'), '&nbsp;', ' '), '\s+', ' ', 'g')) AS text, regexp_matches(html, '(?i)<(html|body|div|p|br|table|span|a)\b[^>]*>') AS markup FROM pages")
def strip_html_simple(spark, d):
    return table(spark, d, "pages").select("page_id", D.strip_html("html").alias("text"), D.looks_html("html").alias("markup"))


def _html_sql(html: str) -> str:
    """SQL of a page's text; the engine's patterns have no references back, so each element that goes is named."""
    gone = "|".join(rf"<{e}\b.*?</{e}\s*>" for e in ("script", "style", "noscript", "svg"))
    t = f"regexp_replace({html}, '{gone}|<!--.*?-->', ' ', 'gis')"
    t = rf"regexp_replace({t}, '<br\s*/?>|</(p|div|li|tr|h[1-6]|section|article|table|ul|ol|title)\s*>', chr(10), 'gi')"
    t = f"regexp_replace({t}, '<[^>]*>', ' ', 'gs')"
    for name, char in D.ENTITIES:
        t = f"replace({t}, '&{name};', chr({ord(char)}))"
    t = rf"regexp_replace({t}, '[ \t\r\f\x0b\x{{a0}}]+', ' ', 'g')"
    return rf"regexp_replace(regexp_replace(regexp_replace({t}, ' ?\n ?', chr(10), 'g'), '\n{{2,}}', chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query("html_to_text", f"SELECT page_id, {_html_sql('html')} AS text FROM pages")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", D.html_to_text("html").alias("text"))


@query("url_public_filter", r"""WITH u AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'https://10.0.0.' || page_id % 200 || '/x' WHEN page_id % 5 = 1 THEN 'https://user@host.example.com/' WHEN page_id % 5 = 2 THEN 'https://localhost/a' ELSE url END AS url FROM pages)
 SELECT page_id, url, url LIKE 'https://%' AND page_id % 5 >= 3 AS public FROM u""")
def url_public_filter(spark, d):
    p = table(spark, d, "pages")
    m = F.col("page_id") % 5
    url = F.when(m == 0, F.concat(F.lit("https://10.0.0."), F.col("page_id") % 200, F.lit("/x"))).when(m == 1, "https://user@host.example.com/").when(m == 2, "https://localhost/a").otherwise(F.col("url"))
    u = p.select("page_id", url.alias("url"))
    return u.withColumn("public", C.is_public_https("url"))


@query("strip_accents_normalize", r"SELECT doc_id, md5(trim(regexp_replace(strip_accents(lower(text)), '\s+', ' ', 'g'))) AS digest FROM documents")
def strip_accents_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(C.plain_text("text").cast("binary")).alias("digest"))


@query("content_hash_key", "SELECT doc_id, sha256(text) AS sha256, source || ':' || doc_id AS dedup_key FROM documents")
def content_hash_key(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.concat_ws(":", "source", "doc_id").alias("dedup_key"))


@query("truncate_head_tail", "SELECT doc_id, md5(CASE WHEN length(text) > 1000 THEN substr(text, 1, 497) || chr(10) || '[...]' || chr(10) || right(text, 496) ELSE text END) AS digest FROM documents")
def truncate_head_tail(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(D.head_tail("text", 1000).cast("binary")).alias("digest"))


@query("keyword_flag", "SELECT doc_id, regexp_matches(strip_accents(lower(text)), 'licensed under|general public') AS flag FROM documents")
def keyword_flag(spark, d):
    return table(spark, d, "documents").select("doc_id", D.keyword_flag("text", "licensed under|general public").alias("flag"))


@query("token_overlap_similarity", r"""WITH t AS (SELECT item_id, list_distinct(list_filter(string_split_regex(strip_accents(lower(text)), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ('the', 'and'))) AS t FROM benchmark)
 SELECT a.item_id AS a, b.item_id AS b, floor(coalesce(len(list_intersect(a.t, b.t)) / nullif(least(len(a.t), len(b.t)), 0), 0) * 1e4 + 0.5) / 1e4 AS score FROM t a JOIN t b ON b.item_id = a.item_id + 1""")
def token_overlap(spark, d):
    t = table(spark, d, "benchmark").select("item_id", C.tokens("text", 3, ("the", "and")).alias("t"))
    b = t.select(F.col("item_id").alias("b"), F.col("t").alias("u"), (F.col("item_id") - 1).alias("a"))
    return t.withColumnRenamed("item_id", "a").join(b, "a").select("a", "b", rnd(C.overlap("t", "u"), 4).alias("score"))


_REL = r"""pg AS (SELECT doc_id AS doc, CAST(k AS BIGINT) AS page, list_distinct(string_split_regex(lower(line), '[^a-z]+')) AS tokens FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)),
 per AS (SELECT doc, page, unnest(tokens) AS token FROM pg), df AS (SELECT doc, token, count(DISTINCT page) AS df FROM per GROUP BY 1, 2), n AS (SELECT doc, count(*) AS n FROM pg GROUP BY 1),
 terms AS (SELECT query, token FROM (VALUES ('q1', 'the'), ('q1', 'and'), ('q1', 'erthat'), ('q2', 'tion'), ('q2', 'ing')) v(query, token)), sz AS (SELECT query, count(*) AS nt FROM terms GROUP BY 1),
 sc AS (SELECT p.doc, t.query, p.page, sum(ln((n.n + 1) / (df.df + 1)) + 1) + 5.0 * count(*) / max(sz.nt) AS score, count(*) AS matches FROM per p JOIN terms t USING (token) JOIN df ON df.doc = p.doc AND df.token = p.token JOIN n ON n.doc = p.doc JOIN sz ON sz.query = t.query GROUP BY 1, 2, 3)"""


def _scored(spark, d):
    docs = table(spark, d, "documents")
    pages = docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("page", "line")).select("doc", (F.col("page") + 1).cast("long").alias("page"), F.array_distinct(F.split(F.lower("line"), "[^a-z]+")).alias("tokens"))
    terms = spark.createDataFrame([("q1", "the"), ("q1", "and"), ("q1", "erthat"), ("q2", "tion"), ("q2", "ing")], "query string, token string")
    return D.page_relevance(pages, terms)


@query("page_relevance_idf", f"WITH {_REL} SELECT doc, query, page, {r4('score')} AS score, matches FROM sc")
def page_relevance(spark, d):
    return M.rounded(_scored(spark, d))


@query("topk_pages_per_query", f"""WITH {_REL}, rk AS (SELECT *, row_number() OVER (PARTITION BY doc, query ORDER BY floor(score * 1e6) DESC, matches DESC, page) AS rank FROM sc), b AS (SELECT doc, page, min((rank, query)) AS first FROM rk WHERE rank <= 6 GROUP BY 1, 2)
 SELECT doc, page, place FROM (SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY first, page) AS place FROM b) WHERE place <= 12""")
def topk_pages(spark, d):
    return D.top_pages(_scored(spark, d), 2)


@query("table_rows_from_positions", "SELECT doc, page, y, n FROM (SELECT l_orderkey % 500 AS doc, l_linenumber AS page, round(l_quantity, 2) AS y, count(*) AS n FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) >= 3) QUALIFY count(*) OVER (PARTITION BY doc, page) >= 2")
def table_rows(spark, d):
    items = table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("doc"), F.col("l_linenumber").alias("page"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), F.col("l_extendedprice").cast("string").alias("text"))
    return D.table_rows(items).select("doc", "page", "y", F.size("cells").cast("long").alias("n"))


@query("json_key_pattern_extract", """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def json_key_pattern(spark, d):
    m = F.from_json("props", "map<string,string>")
    first = F.get(F.filter(F.map_entries(m), lambda e: e["key"].rlike("^(k|n|nr|num)") & e["value"].rlike(r"^\d+$")), F.lit(0))["value"]
    return table(spark, d, "events").select("event_id", first.cast("int").alias("k"))


@query("json_object_from_text", """SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN props END AS body FROM events""")
def json_object_from_text(spark, d):
    e = table(spark, d, "events")
    t = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("no object: "), F.substring("props", 2, 3))).otherwise(F.concat(F.lit("Here:\n```json\n"), F.replace("props", F.lit("}"), F.lit(",}")), F.lit("\n```\nbye")))
    return e.select("event_id", D.json_from_text(t).alias("body"))


@query("longest_text_field", "SELECT p_partkey, CASE WHEN length(p_name) >= length(p_brand) AND length(p_name) >= length(p_type) THEN p_name WHEN length(p_brand) >= length(p_type) THEN p_brand ELSE p_type END AS longest FROM part")
def longest_text_field(spark, d):
    best = F.greatest(*[F.struct(F.length(c), F.lit(-k), F.col(c).alias("t")) for k, c in enumerate(("p_name", "p_brand", "p_type"))])
    return table(spark, d, "part").select("p_partkey", best["t"].alias("longest"))


@query("detect_format_magic", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' WHEN 2 THEN 'zip' ELSE 'text' END AS format FROM pages")
def detect_format(spark, d):
    m = F.col("page_id") % 4
    content = F.when(m == 0, F.col("html").cast("binary")).when(m == 1, F.concat(F.lit("%PDF-1.7 "), "url").cast("binary")).when(m == 2, F.concat(F.unhex(F.lit("504B030414")), F.col("url").cast("binary"))).otherwise(F.col("url").cast("binary"))
    return table(spark, d, "pages").select("page_id", D.format_of(content).alias("format"))


@query("declared_format", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'html' WHEN page_id % 3 = 1 THEN 'pdf' ELSE 'unknown' END AS format FROM pages")
def declared_format(spark, d):
    m = F.col("page_id") % 3
    return table(spark, d, "pages").select("page_id", D.declared_format(F.when(m == 0, "text/html; charset=utf-8"), F.when(m == 1, F.concat("page_id", F.lit(".PDF")))).alias("format"))


@query("format_mix_report", "SELECT CASE page_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' WHEN 2 THEN 'zip' ELSE 'text' END AS detected, CASE WHEN page_id % 3 = 0 THEN 'html' WHEN page_id % 3 = 1 THEN 'pdf' ELSE 'unknown' END AS declared, count(*) AS n FROM pages GROUP BY 1, 2")
def format_mix(spark, d):
    both = detect_format(spark, d).withColumnRenamed("format", "detected").join(declared_format(spark, d).withColumnRenamed("format", "declared"), "page_id")
    return both.groupBy("detected", "declared").agg(F.count("*").alias("n"))


#: A page as a stored document: some are other formats by their address, some were tried before, some have no content.
_STORED = """CASE WHEN url LIKE '%utm_%' THEN '%PDF-1.7 ' || url WHEN url LIKE '%/de/%' THEN '{"url":  "' || url || '"}' WHEN url LIKE '%/fr/1%' THEN '' WHEN url LIKE '%/fr/2%' THEN '<!DOCTYPE html><p> </p>' ELSE html END"""
_TRIED = """CASE WHEN length(html) % 4 = 0 THEN 'ok' WHEN length(html) % 4 = 1 THEN 'failed' WHEN length(html) % 4 = 2 THEN 'pending' END"""
_PARSE_SQL = rf"""WITH s AS (SELECT page_id, {_STORED} AS c, {_TRIED} AS state, length(html) % 3 AS tried_by FROM pages), w AS (SELECT *, CASE WHEN c = '' THEN 'empty' WHEN starts_with(c, '%PDF') THEN 'pdf' WHEN starts_with(c, '{{') THEN 'json' ELSE 'html' END AS format FROM s WHERE state IS NULL OR state = 'pending' OR (state = 'failed' AND tried_by < 2)),
 t AS (SELECT page_id, format, CASE format WHEN 'json' THEN regexp_replace(c, '  +', ' ', 'g') WHEN 'html' THEN {_html_sql('c')} END AS text FROM w)
 SELECT page_id, format, CASE WHEN format = 'pdf' THEN 'unsupported' WHEN coalesce(text, '') = '' THEN 'failed' ELSE 'ok' END AS state, CASE WHEN format = 'empty' THEN 'content_required' WHEN format = 'pdf' THEN 'format_pdf' WHEN text = '' THEN 'text_empty' END AS error, sha256(nullif(text, '')) AS text_sha256, 2 AS parser_version FROM t"""


@query("parse_pending_batch", _PARSE_SQL)
def parse_pending(spark, d):
    """Stored pages that wait, or failed under an older parser, with their state, error and text."""
    docs = table(spark, d, "pages").select("page_id", F.expr(_STORED).cast("binary").alias("content"), F.expr(_TRIED).alias("state"), (F.length("html") % 3).alias("parser_version"))
    return D.parse_pending(docs, 2).select("page_id", "format", "state", "error", F.sha2("text", 256).alias("text_sha256"), "parser_version")


@query("universe_gate", "SELECT doc_id, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'lang' WHEN length(text) < 100 THEN 'length' WHEN NOT regexp_matches(source, '^src[0-9]$') THEN 'source' END AS reject FROM documents")
def universe_gate(spark, d):
    why = C.reasons(("lang", ~F.col("lang").isin("en", "de", "fr")), ("length", F.length("text") < 100), ("source", ~F.col("source").rlike("^src[0-9]$")))
    return table(spark, d, "documents").select("doc_id", F.get(why, F.lit(0)).alias("reject"))


@query("evidence_audit", "SELECT l.doc_id, CASE WHEN quality = 1 AND d.lang IN ('en', 'fr') THEN 'resolved' ELSE 'open' END AS state FROM labels l JOIN documents d USING (doc_id)")
def evidence_audit(spark, d):
    allowed = table(spark, d, "documents").where(F.col("lang").isin("en", "fr")).select("doc_id", F.lit(True).alias("allowed"))
    have = table(spark, d, "documents").select("doc_id")
    g = table(spark, d, "labels").join(have, "doc_id").join(allowed, "doc_id", "left")
    return g.select("doc_id", F.when((F.col("quality") == 1) & F.col("allowed"), "resolved").otherwise("open").alias("state"))


@query("expected_gap_merge", "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type) FILTER (value > 20) || ['focus'])), ',') AS gaps FROM events GROUP BY 1".replace("list(event_type) FILTER (value > 20)", "coalesce(list(event_type) FILTER (value > 20), [])"))
def expected_gap(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 20, F.col("event_type"))).alias("open"))
    return e.select("user_id", F.array_join(F.slice(F.sort_array(F.array_union("open", F.array(F.lit("focus")))), 1, 8), ",").alias("gaps"))


# -- scalar expressions -------------------------------------------------------


@query("round_half_up_js", "SELECT s_suppkey, floor(-s_acctbal * 10 + 0.5) / 10 AS r1, floor(s_acctbal + 0.5) AS r0 FROM supplier")
def round_half_up(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", rnd(-F.col("s_acctbal"), 1).alias("r1"), rnd("s_acctbal", 0).alias("r0"))


@query("to_number", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer")
def to_number(spark, d):
    m = F.col("c_custkey") % 5
    t = F.when(m == 0, " ").when(m == 1, F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(","))).otherwise(F.concat(F.lit(" "), F.col("c_acctbal").cast("string")))
    return table(spark, d, "customer").select("c_custkey", C.to_number(t).alias("v"))


@query("parse_number_br", "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 6 = 1 THEN -abs(c_acctbal) ELSE abs(c_acctbal) END AS v FROM customer")
def parse_number_br(spark, d):
    m = F.col("c_custkey") % 6
    br = F.translate(F.format_number(F.abs("c_acctbal"), 2), ",.", ".,")
    t = F.when(m == 0, "--").when(m == 1, F.concat(F.lit("("), br, F.lit(")"))).otherwise(F.concat(F.lit("R$ "), br))
    return table(spark, d, "customer").select("c_custkey", C.parse_number_br(t).alias("v"))


@query("parse_localized_number", "SELECT c_custkey, abs(c_acctbal) AS v, 2 AS n FROM customer")
def parse_localized(spark, d):
    en = F.format_number(F.abs("c_acctbal"), 2)
    t = F.when(F.col("c_custkey") % 2 == 0, en).otherwise(F.translate(en, ",.", ".,"))
    return table(spark, d, "customer").select("c_custkey", C.parse_localized_number(t).alias("v"), F.size(C.extract_prices(F.concat(F.lit("from "), t, F.lit(" to "), t))).alias("n"))


@query("scale_and_sign", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal * 1000 WHEN c_custkey % 3 = 1 THEN c_acctbal END AS v FROM customer")
def scale_and_sign(spark, d):
    m = F.col("c_custkey") % 3
    return table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") * C.scale_factor(F.when(m == 0, " mil").when(m == 1, "UNIDADE").otherwise("X"))).alias("v"))


@query("safe_arith", f"SELECT s_suppkey, {r4('(s_acctbal - nullif(s_nationkey, 0)) / nullif(s_nationkey, 0) * 100')} AS pct, {r4('s_acctbal / nullif(s_nationkey, 0)')} AS ratio, {r4('s_acctbal - abs(s_nationkey)')} AS fcf FROM supplier")
def safe_arith(spark, d):
    s = table(spark, d, "supplier")
    return M.rounded(s.select("s_suppkey", C.pct_change("s_acctbal", "s_nationkey").alias("pct"), C.safe_divide("s_acctbal", "s_nationkey").alias("ratio"), C.free_cash_flow("s_acctbal", "s_nationkey").alias("fcf")))


@query("pick_first_non_null", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey AS DOUBLE) END) AS v FROM customer")
def pick_first(spark, d):
    return table(spark, d, "customer").select("c_custkey", C.pick_first(F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey"))).alias("v"))


@query("date_br_iso", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day, o_orderkey % 4 <> 0 AS iso_ok FROM orders")
def date_br_iso(spark, d):
    day = F.to_date("o_orderdate")
    bad = F.col("o_orderkey") % 4 == 0
    return table(spark, d, "orders").select("o_orderkey", C.date_br(F.when(bad, "31/02/2001").otherwise(F.date_format(day, "dd/MM/yyyy"))).alias("day"), C.is_iso_date(F.when(bad, "2001-02-31").otherwise(F.date_format(day, "yyyy-MM-dd"))).alias("iso_ok"))


@query("years_between_36525", f"SELECT o_orderkey, {r4('''date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') / 365.25''')} AS years FROM orders")
def years_between(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.years_between(F.to_date("o_orderdate"), F.lit("2002-01-01").cast("date")).alias("years"))


@query("business_days_between", "SELECT o_orderkey, CAST((SELECT count(*) FROM range(1, 41) r(i) WHERE i <= o_orderkey % 40 AND isodow(CAST(o_orderdate AS DATE) + CAST(i AS INTEGER)) <= 5) AS INTEGER) AS n FROM orders")
def business_days(spark, d):
    a = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", C.business_days_between(a, F.date_add(a, (F.col("o_orderkey") % 40).cast("int"))).alias("n"))


@query("is_month_end", "SELECT o_orderkey, CAST(o_orderdate AS DATE) = last_day(CAST(o_orderdate AS DATE)) AS month_end FROM orders")
def is_month_end(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.is_month_end(F.to_date("o_orderdate")).alias("month_end"))


@query("period_months", "SELECT o_orderkey, CASE WHEN floor((n + 1) / 30.4375 + 0.5) IN (3, 6, 9, 12) AND abs(n + 1 - floor((n + 1) / 30.4375 + 0.5) * 30.4375) <= 5 THEN CAST(floor((n + 1) / 30.4375 + 0.5) AS INTEGER) END AS months FROM (SELECT o_orderkey, o_orderkey % 400 AS n FROM orders)")
def period_months(spark, d):
    a = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", C.period_months(a, F.date_add(a, (F.col("o_orderkey") % 400).cast("int"))).alias("months"))


@query("normalize_ticker_key", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'AB' || s_suppkey END AS ticker, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code FROM supplier")
def normalize_ticker(spark, d):
    t = F.when(F.col("s_suppkey") % 3 == 0, "a b!").otherwise(F.concat(F.lit(" ab"), "s_suppkey", F.lit(" ")))
    return table(spark, d, "supplier").select("s_suppkey", C.ticker_key(t).alias("ticker"), C.regulator_code("s_suppkey").alias("code"))


@query("route_market", "SELECT s_suppkey, CASE WHEN s_suppkey < 100 AND s_suppkey % 2 = 0 THEN 'b3' ELSE 'international' END AS route FROM supplier")
def route_market(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", C.market_route(F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("petr"), "s_suppkey")).otherwise("AAPL")).alias("route"))


@query("date_range_chunks", "SELECT s_suppkey, CAST(DATE '1995-01-01' + to_years(CAST(2 * k AS INTEGER)) AS DATE) AS start, least(CAST(DATE '1995-01-01' + to_years(CAST(2 * k + 2 AS INTEGER)) AS DATE) - 1, DATE '2001-06-30' + CAST(s_suppkey % 5 AS INTEGER)) AS stop FROM supplier, range(0, 4) r(k)")
def date_range_chunks(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.date_add(F.lit("2001-06-30").cast("date"), (F.col("s_suppkey") % 5).cast("int")).alias("last"))
    x = s.select("s_suppkey", "last", F.explode(F.expr("sequence(DATE'1995-01-01', last, INTERVAL 2 YEARS)")).alias("start"))
    return x.select("s_suppkey", "start", F.least(F.date_sub(F.add_months("start", 24), 1), "last").alias("stop"))

"""Text jobs over documents and pages of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, plain_text

#: Named references that occur in filings' pages.
ENTITIES = (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("copy", "©"), ("middot", "·"), ("amp", "&"))


def html_to_text(html) -> Column:
    """Text of a page: scripts, styles and markup go, line breaks and block ends are lines, references are decoded,
    white space is squeezed and blank lines go."""
    t = F.regexp_replace(col(html), r"(?is)<(script|style|noscript|svg)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|section|article|table|ul|ol|title)\s*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(f"&{name};"), F.lit(char))
    t = F.regexp_replace(t, r"[ \t\r\f\x0b ]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r" ?\n ?", "\n"), r"\n{2,}", "\n"), r"^\s+|\s+$", "")


def strip_html(html) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(col(html), r"(?s)<[^>]*>", " "), "&nbsp;", " "), r"\s+", " "))


def looks_html(text) -> Column:
    return col(text).rlike(r"(?i)<(html|body|div|p|br|table|span|a)\b[^>]*>")


def format_of(content) -> Column:
    """The format by the first bytes of binary content."""
    b = F.substring(col(content), 1, 8192)
    head = F.hex(F.substring(b, 1, 8))
    text = F.ltrim(F.lower(F.decode(F.substring(b, 1, 512), "ISO-8859-1")))
    control = F.length(F.regexp_replace(F.decode(b, "ISO-8859-1"), r"[^\x00-\x08\x0e-\x1f]", ""))
    return (
        F.when(F.length(b) == 0, "empty").when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304") | head.startswith("504B0506"), "zip").when(head.startswith("D0CF11E0A1B11AE1"), "ole")
        .when(head.startswith("7B5C727466"), "rtf").when(head.startswith("1F8B"), "gzip").when(text.rlike(r"^<!doctype html|^<html"), "html").when(text.startswith("<?xml"), "xml").when(text.rlike(r"^[\[{]"), "json")
        .when(control * 20 < F.length(b), "text").otherwise("other")
    )


def declared_format(content_type, file_name) -> Column:
    kind = F.lower(F.coalesce(col(content_type), F.lit("")))
    ext = F.lower(F.regexp_extract(F.coalesce(col(file_name), F.lit("")), r"\.([A-Za-z0-9]{2,5})$", 1))
    return F.when(kind.contains("pdf") | (ext == "pdf"), "pdf").when(kind.contains("html") | ext.isin("html", "htm"), "html").when(kind.contains("zip") | (ext == "zip"), "zip").when(kind.contains("json") | (ext == "json"), "json").when(kind.contains("xml") | (ext == "xml"), "xml").when(kind.contains("text") | (ext == "txt"), "text").otherwise("unknown")


#: Formats that are read as text; the others wait for a codec.
READABLE = ("html", "text", "xml", "json")


def tidy_text(text) -> Column:
    """No NULs, no blanks around line ends, at most one empty line, single blanks, trimmed."""
    t = F.regexp_replace(F.regexp_replace(col(text), "\x00", ""), r"[ \t]*\n[ \t]*", "\n")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "), r"^\s+|\s+$", "")


def parse_pending(docs: DataFrame, version: int, content: str = "content", state: str = "state", parsed_by: str = "parser_version") -> DataFrame:
    """One row a document that is still to be parsed, with ``format``, ``state``, ``text``, ``error`` and ``parser_version``.

    Waiting are those without a state or pending, and those that failed or had no codec under an older parser; the others go.
    The format comes from the first bytes. html, text, xml and json become text (state ok), other formats are unsupported, and
    what has no content or no text fails; a bad document is a row with its error and never stops the others. Bytes that are no
    UTF-8 become replacement characters."""
    waits = F.col(state).isNull() | (F.col(state) == "pending") | (F.col(state).isin("failed", "unsupported") & (F.coalesce(parsed_by, F.lit(0)) < version))
    t = docs.where(waits).withColumn("format", F.when(col(content).isNull(), "empty").otherwise(format_of(content)))
    text = F.make_valid_utf8(col(content).cast("string"))
    t = t.withColumn("text", F.when(F.col("format") == "html", tidy_text(html_to_text(text))).when(F.col("format").isin(*READABLE), tidy_text(text)))
    error = F.when(F.col("format") == "empty", "content_required").when(~F.col("format").isin(*READABLE), F.concat(F.lit("format_"), "format")).when(F.col("text") == "", "text_empty")
    t = t.withColumn("error", error).withColumn(state, F.when(F.col("error").isNull(), "ok").when(F.col("error").startswith("format_"), "unsupported").otherwise("failed"))
    return t.withColumn("text", F.when(F.col(state) == "ok", F.col("text"))).withColumn(parsed_by, F.lit(version))


def head_tail(text, limit: int, marker: str = "\n[...]\n") -> Column:
    """The text, or its first and last parts around a marker where it is longer than ``limit`` code points."""
    t = col(text)
    half = (limit - len(marker)) // 2
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - len(marker) - half), F.lit(marker), F.right(t, F.lit(half)))).otherwise(t)


def keyword_flag(text, pattern: str) -> Column:
    return F.coalesce(plain_text(text).rlike(pattern), F.lit(False))


def page_relevance(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """pages (doc, page, tokens) by terms (query, token): the sum of ln((N + 1) / (df + 1)) + 1 over matched tokens, plus
    five times the share of the query's tokens found; with the number of matches."""
    wanted = terms.select("token").distinct()
    per = pages.select("doc", "page", F.explode("tokens").alias("token")).join(wanted, "token", "left_semi")
    df = per.groupBy("doc", "token").agg(F.count_distinct("page").alias("df"))
    n = pages.groupBy("doc").agg(F.count("*").alias("n_pages"))
    size = terms.groupBy("query").agg(F.count("*").alias("n_terms"))
    hit = per.join(terms, "token").join(df, ["doc", "token"]).join(n, "doc").join(size, "query")
    idf = F.ln((F.col("n_pages") + 1) / (F.col("df") + 1)) + 1
    g = hit.groupBy("doc", "query", "page").agg(F.sum(idf).alias("s"), F.count("*").alias("matches"), F.max("n_terms").alias("n_terms"))
    return g.select("doc", "query", "page", (F.col("s") + 5.0 * F.col("matches") / F.col("n_terms")).alias("score"), "matches")


def top_pages(scored: DataFrame, n_queries: int, cap: int = 12) -> DataFrame:
    """Per document and query the best max(2, ceil(cap / queries)) pages; distinct pages by best rank, at most ``cap``."""
    k = max(2, -(-cap // max(1, n_queries)))
    w = Window.partitionBy("doc", "query").orderBy(F.desc(F.floor(F.col("score") * 1e6)), F.desc("matches"), "page")
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).groupBy("doc", "page").agg(F.min(F.struct("rank", "query")).alias("first"))
    o = Window.partitionBy("doc").orderBy("first", "page")
    return best.withColumn("place", F.row_number().over(o)).where(F.col("place") <= cap).select("doc", "page", "place")


def table_rows(items: DataFrame) -> DataFrame:
    """Rows of text items (doc, page, x, y, text): items of one height (two decimals), by x; three cells and a digit at
    least, and two such rows a page."""
    rows = items.groupBy("doc", "page", F.round("y", 2).alias("y")).agg(F.sort_array(F.collect_list(F.struct("x", "text"))).alias("c"))
    rows = rows.select("doc", "page", "y", F.transform("c", lambda s: s["text"]).alias("cells")).where((F.size("cells") >= 3) & F.exists("cells", lambda t: t.rlike(r"\d")))
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("doc", "page"))).where("n >= 2").drop("n")


def json_from_text(text) -> Column:
    """The outermost {...} of a free text without code fences and trailing commas, as JSON text; null if it is none."""
    t = F.regexp_replace(col(text), r"```(json)?", "")
    a, b = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
    body = F.regexp_replace(F.substr(t, a, b - a + 1), r",\s*([}\]])", "$1")
    return F.when((a > 0) & (b > a) & F.try_parse_json(body).isNotNull(), body)

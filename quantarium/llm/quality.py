"""Line-first quality rules, in DataFrame functions only.

Every line with a word is held against punctuation, navigation, symbol, shouting, repetition and boilerplate rules,
and against earlier equal lines. Failing lines are removed; a document that keeps too small a share of its words is
rejected. All work stays inside a row, so there is no shuffle and no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

#: Characters that count as symbols, ends of a finished line, separators of menus, boilerplate phrases.
SYMBOLS = "#*$%&|<>"
LINE_END = r"""[.!?:;…。！？"'”’»)\]]\s*$"""
MENU = r"(^|\s)[|»›>·•/]+(\s|$)"
BOILERPLATE = (
    r"(?i)(all rights reserved|cookie|javascript|terms of (use|service)|privacy policy|lorem ipsum|click here"
    r"|read more|sign up|log ?in|subscribe|skip to (main )?content|licensed under|general public license|copyright ©|©)"
)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def line_fails(line: Column, words: Column) -> Column:
    """Whether a line with at least one word fails a rule."""
    n = F.size(words)
    finished = line.rlike(LINE_END)
    menu = F.size(F.filter(words, lambda w: w.isin("|", "»", "›", ">", "·", "•", "/")))
    return (
        (~finished & (n < 6))  # headings and menu items
        | ((menu >= 2) & (menu * 5 >= n))  # navigation: separators between a few words each
        | (_count_of(line, SYMBOLS) * 5 > n)  # noise: over one symbol to five words
        | ((n >= 4) & (line == F.upper(line)) & (line != F.lower(line)))  # shouting
        | ((n >= 10) & (F.size(F.array_distinct(words)) * 10 < n * 3))  # one phrase over and over
        | ((n < 25) & line.rlike(BOILERPLATE))
    )


def line_quality(docs: DataFrame, min_words: int = 50, min_kept_percent: int = 60, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, kept and clean_text.

    Words are runs of characters other than the six ASCII white-space ones; lines are split at \\n. n_dup_lines counts
    lines with a word that equal an earlier line; n_repeat_words counts words inside a 3-word window found at least
    twice in the text. base_failed: under ``min_words`` words, or over half of them repeated. kept: not base_failed,
    and the lines that pass hold ``min_kept_percent`` % of the words or more. clean_text: the text without failing
    and repeated lines. A null text counts as one without words (base_failed, empty clean_text); an empty table gives
    an empty one; repeated rows each get their own result. Columns of ``docs`` with one of these names are replaced.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text"]
    base = docs.drop(*own)
    row = F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("_row")
    a = base.select(row, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    a = a.select("_row", "_t", _words(F.col("_t")).alias("_w"), F.split("_t", "\n").alias("_all"))
    a = a.select("_row", "_t", "_w", "_all", F.filter("_all", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    a = a.withColumn("_once", F.array_distinct("_lines"))
    n = F.size("_w")
    a = a.withColumn("_h", F.expr("CASE WHEN size(_w) >= 3 THEN transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) ELSE array() END"))
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    a = a.withColumn("_s", F.when(again, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("_s", lambda s, k: F.coalesce(F.get("_s", k - 1)["h"] == s["h"], F.lit(False)) | F.coalesce(F.get("_s", k + 1)["h"] == s["h"], F.lit(False)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2)))))
    a = a.withColumn("_rep", F.when(F.col("_s").isNotNull(), covered).otherwise(0).cast("long")).drop("_h", "_s")
    a = a.withColumn("_split", F.transform("_once", lambda x: F.struct(x.alias("line"), _words(x).alias("w"))))
    a = a.withColumn("_good", F.filter("_split", lambda s: ~line_fails(s["line"], s["w"])))
    kept_words = F.aggregate("_good", F.lit(0), lambda acc, s: acc + F.size(s["w"]))
    a = a.select(
        "_row", n.cast("long").alias("n_words"), F.length(F.translate("_t", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"), _count_of(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size("_once")).cast("long").alias("n_dup_lines"), F.col("_rep").alias("n_repeat_words"), kept_words.alias("_kw"), F.array_join(F.transform("_good", lambda s: s["line"]), "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (100 * F.col("_kw") >= min_kept_percent * F.col("n_words"))
    # One row each from a generator: a later filter on these columns stays above it, instead of being inlined below.
    found = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "clean_text")
    return a.select("_row", F.explode(F.array(found)).alias("_found")).select("_row.*", "_found.*")

"""Column expressions over numbers, dates, texts and codes.

Null is data: what can't be read is null, never zero. Everything is a built-in expression inside code generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and their base letters, for accent-free comparison.
ACCENTED = "àâäáãåçéèêëíìïîñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÏÎÑÓÒÔÖÕÚÙÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- numbers ------------------------------------------------------------------


def round_half_up(x, digits: int = 0) -> Column:
    """Halves go towards plus infinity (-2.5 becomes -2), unlike Spark's round."""
    scale = 10.0**digits
    return F.floor(col(x) * scale + 0.5) / scale


def finite(x) -> Column:
    """The double, or null where it is null, not a number or infinite."""
    v = col(x).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def to_number(text) -> Column:
    """A finite double from text, blank or unreadable text being null; a comma may be the decimal mark."""
    return finite(F.regexp_replace(F.trim(col(text).cast("string")), ",", ".").try_cast("double"))


def parse_number_br(text) -> Column:
    """1.234,56 with points for thousands; brackets or a leading minus are negative; '-', '--' and junk are null."""
    t = F.regexp_replace(F.trim(col(text).cast("string")), r"[R$%\s]", "")
    negative = t.rlike(r"^\(.*\)$") | t.startswith("-")
    body = F.regexp_replace(t, r"[()\-]", "")
    br = F.when(body.contains(","), F.regexp_replace(F.regexp_replace(body, r"\.", ""), ",", ".")).otherwise(F.when(body.rlike(r"^\d{1,3}(\.\d{3})+$"), F.regexp_replace(body, r"\.", "")).otherwise(body))
    value = F.when(br.rlike(r"^\d+(\.\d+)?$"), br.try_cast("double"))
    return F.when(negative, -value).otherwise(value)


def parse_localized_number(text) -> Column:
    """The last separator is the decimal mark: 1.234,5 and 1,234.5 are equal."""
    t = F.trim(col(text).cast("string"))
    last_comma, last_point = F.length(t) - F.instr(F.reverse(t), ","), F.length(t) - F.instr(F.reverse(t), ".")
    comma = t.contains(",") & (~t.contains(".") | (last_comma > last_point))
    plain = F.when(comma, F.regexp_replace(F.regexp_replace(t, r"\.", ""), ",", ".")).otherwise(F.regexp_replace(t, ",", ""))
    return F.when(plain.rlike(r"^\d+(\.\d*)?$"), plain.try_cast("double"))


def extract_prices(text) -> Column:
    """All numbers of a free text, read as localized ones."""
    return F.filter(F.transform(F.regexp_extract_all(col(text), F.lit(r"(\d[\d.,]*\d|\d)"), 1), parse_localized_number), lambda x: x.isNotNull())


def scale_factor(unit) -> Column:
    """MIL is a thousand, UNIDADE one; any other unit is unknown."""
    u = F.upper(F.trim(col(unit)))
    return F.when(u == "MIL", F.lit(1000.0)).when(u == "UNIDADE", F.lit(1.0))


def percent_to_fraction(x) -> Column:
    return round_half_up(col(x) / 100, 4)


def pct_change(now, before) -> Column:
    """(now - before) / before in percent; null on a missing or zero base."""
    return F.try_divide(col(now) - col(before), col(before)) * 100


def safe_divide(a, b) -> Column:
    return F.try_divide(col(a), col(b))


def free_cash_flow(operating, capex) -> Column:
    """Operating cash flow less spending, which sources give with either sign; null if one is missing."""
    return col(operating) - F.abs(col(capex))


def pick_first(*columns) -> Column:
    return F.coalesce(*[finite(c) for c in columns])


# -- dates --------------------------------------------------------------------


def date_br(text) -> Column:
    """dd/mm/yyyy as a date, null where the calendar has no such day."""
    t = F.trim(col(text))
    return F.when(t.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(t, "dd/MM/yyyy"))


def is_iso_date(text) -> Column:
    t = col(text)
    return F.coalesce(t.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(t, "yyyy-MM-dd").isNotNull(), F.lit(False))


def years_between(start, end) -> Column:
    return round_half_up(F.datediff(col(end), col(start)) / 365.25, 4)


def business_days_between(start, end) -> Column:
    """Mondays to Fridays after start up to end; null if end is before start. Closed form: no day list is built."""
    weekday = lambda d: F.pmod(F.datediff(d, F.lit("1970-01-05").cast("date")), F.lit(7))  # noqa: E731  Monday is 0
    upto = lambda d: F.floor(F.datediff(d, F.lit("1970-01-05").cast("date")) / 7) * 5 + F.least(weekday(d) + 1, F.lit(5))
    return F.when(col(end) >= col(start), upto(col(end)) - upto(col(start))).cast("int")


def is_month_end(date) -> Column:
    return col(date) == F.last_day(col(date))


def period_months(start, end) -> Column:
    """3, 6, 9 or 12 if the days, both ends included, are within five of so many months; else null."""
    days = F.datediff(col(end), col(start)) + 1
    months = F.floor(days / 30.4375 + 0.5)
    return F.when(months.isin(3, 6, 9, 12) & (F.abs(days - months * 30.4375) <= 5), months.cast("int"))


# -- texts and codes ----------------------------------------------------------


def plain_text(text) -> Column:
    """Lower case without accents, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.regexp_replace(col(text), r"\p{M}+", "")), ACCENTED, PLAIN), r"\s+", " "))


def ticker_key(text) -> Column:
    t = F.upper(F.trim(col(text)))
    return F.when(t.rlike(r"^[A-Z0-9.\-]{2,16}$"), t)


def company_key(text) -> Column:
    d = F.regexp_replace(col(text), r"\D", "")
    return F.when(F.length(d) == 14, d)


def regulator_code(text) -> Column:
    d = F.regexp_replace(col(text).cast("string"), r"\D", "")
    return F.when(F.length(d) > 0, F.lpad(d, 6, "0"))


def market_route(ticker) -> Column:
    """The home exchange's code pattern (four letters, one or two digits), or international."""
    return F.when(F.upper(F.trim(col(ticker))).rlike(r"^[A-Z]{4}\d{1,2}F?$"), F.lit("b3")).otherwise(F.lit("international"))


def is_public_https(url) -> Column:
    """https, no credentials, and a host that is no literal private, loopback or link-local address."""
    u = col(url)
    host = F.lower(F.coalesce(F.try_parse_url(u, F.lit("HOST")), F.lit("")))
    p = F.transform(F.split(host, r"\."), lambda x: x.try_cast("int"))
    a, b = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    is_ip = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    private = is_ip & (a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127)) | (a >= 224))
    local = host.isin("localhost", "") | host.endswith(".localhost") | host.endswith(".local") | host.endswith(".internal") | host.startswith("[")
    return F.coalesce(u.rlike(r"^(?i)https://") & ~u.rlike(r"^[^/]*//[^/?#]*@") & ~local & ~F.coalesce(private, F.lit(False)), F.lit(False))


def tokens(text, least: int = 3, stop: tuple[str, ...] = ()) -> Column:
    """Distinct accent-free words of at least so many letters or digits, without stop words."""
    words = F.filter(F.split(plain_text(text), r"[^a-z0-9]+"), lambda w: F.length(w) >= least)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*stop)) if stop else words)


def overlap(a, b) -> Column:
    """Shared tokens over the smaller set; zero if one is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(col(a), col(b))), F.least(F.size(col(a)), F.size(col(b)))), F.lit(0.0))


def reasons(*rules: tuple[str, Column]) -> Column:
    """The names of the rules that are broken, in order."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))


def band(x, *steps: tuple[float, object], otherwise=None) -> Column:
    """The value of the first step whose limit x reaches."""
    first = F.when(col(x) >= steps[0][0], F.lit(steps[0][1]))
    out = reduce(lambda acc, s: acc.when(col(x) >= s[0], F.lit(s[1])), steps[1:], first)
    return out if otherwise is None else out.otherwise(F.lit(otherwise))

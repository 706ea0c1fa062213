"""Main text of web pages by equivalence-class template deduction.

Pages of one host come from few templates. A token is an element at its path (names, classes and ids on the way) or a
text block at its path; tokens that occur equally often on each of the host's pages (the same occurrence vector) form a
class. Tokens that most of a host's pages hold are its template: elements that occur once a page nest into a tree of
slots, and text blocks among them are fixed text. What is left in the slots is free text. On each page the
tree is followed down from the root while one element holds all free text that is not marked as a menu, an advert and the
like, so that nothing is left behind; only an article or main element is followed although other text stays outside. The
element reached is the slot; its blocks are extracted, fixed ones among them (a byline that all pages share is content).

What goes from a slot: elements marked by name or class (see :func:`_role`), fixed text in elements whose class only holds
such a word (``share price`` may be content, ``share us`` is on every page), fixed blocks at the edges of a slot that is a
whole page, and, beside the text in a slot without an article element, elements that hold nothing but like elements in a
number that varies from page to page (readers' replies).

Vectors are never built: each page adds a hash of (page, count) to its tokens' signatures, so a host's vectors are
sums with partial aggregation, and a host with a third of all pages is no hot task. A host's template is bounded by
the tokens of about two pages and the elements of ten, because each is on so large a share of the host's pages.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Fixed: element names by their role in HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "select", "object", "canvas", "audio", "video")
OUTSIDE = frozenset("nav footer aside form menu dialog button head".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
MAIN = frozenset(("article", "main"))
#: Fixed: words of class and id attributes that mark what is no article, words that say where or in what form it stands,
#: and words that only say that a page has it.
MARKS = frozenset(
    "ad ads adbox advert advertisement adverts banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation"
    " newsletter notice notification popup promo recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar widget".split()
)
FORMS = frozenset(
    "area bar block body bottom box button buttons center column container content count first form global group head heading icon icons inner item items label last leaderboard left line link links list main"
    " module outer page panel primary region right row secondary section site skyscraper slot small text title top unit wrap wrapper zone".split()
)
STATES = frozenset("has have is no not off on with without".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Blocks that end an open paragraph.
ENDS_P = BLOCKS - {"body", "html", "head", "title", "option", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Elements that repeat as records: others repeat inside any text.
RECORDS = frozenset(("div", "li", "article"))
#: Shares of a host's pages that a token of the template, and an element that may repeat, must be on.
SUPPORT, SOME = 0.5, 0.1

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""", re.S)
_MARK = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_END_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_DIGITS = re.compile(r"[0-9]+")
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
#: RECORD: an element that may repeat as a reply does; DOUBT: a class holds a word that marks, among others.
ROOT, OTHER, HEADING, ARTICLE, OUT, TEXT, RECORD, DOUBT, HEADER = 0, 0, 1, 2, 3, 4, 5, 6, 7


def host(url: str | None) -> str:
    m = re.match(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m.group(1).lower() if m else ""


def token(up: int, kind: str, what: str) -> int:
    """A token from its parent's token: paths of any depth cost the same."""
    return xxhash.xxh64_intdigest(f"{up}\x00{kind}\x00{what}".encode("utf-8", "surrogatepass"), 7) - (1 << 63)


def _marked(value: str) -> int:
    """OUT, DOUBT or OTHER by a class or id. A word marks by what its last part says, form words left aside
    (``comment-list`` is comments, ``comment-letter`` is a letter); a class marks if each of its words marks or is a form."""
    marks, others, any_part = 0, 0, False
    for word in value.split():
        parts = [x.lower() for x in _PARTS.findall(word)]
        any_part = any_part or not MARKS.isdisjoint(parts) or "header" in parts
        said = [x for x in parts if x not in FORMS and not x.isdigit()]
        if said and said[-1] in MARKS and STATES.isdisjoint(parts):
            marks += 1
        elif said:
            others += 1
    return OUT if marks and not others else DOUBT if any_part else OTHER


def _role(name: str, marks: list[tuple[str, str]]) -> int:
    """The role of an element by its name, and by class, id and role attributes. A header is the article's inside one and
    in doubt elsewhere."""
    by = [_marked(v) for k, v in marks if k != "role"]
    roles = {v.lower() for k, v in marks if k == "role"}
    if name in OUTSIDE or OUT in by or not OUTSIDE_ROLES.isdisjoint(roles):
        return OUT
    if name in MAIN or "main" in roles:
        return ARTICLE
    if name in ("h1", "h2", "h3"):
        return HEADING
    if DOUBT in by or name == "header":
        return DOUBT if DOUBT in by else HEADER
    return RECORD if name in RECORDS else OTHER


class Page:
    """A parsed page. up, tokens, roles, names: of each element its parent's number, token, role and name, the root first; blocks: of
    each text block its element's number, its text and whether it is mostly linked. Open elements and stray ends are
    tolerated."""

    def __init__(self, source: str):
        self.up, self.tokens, self.roles, self.names = [-1], [token(0, "root", "")], [OTHER], [""]
        self.blocks: list[tuple[int, str, bool]] = []
        self._parse(source)

    def _parse(self, source):
        stack = [("", 0)]  # (name, element)
        opened: dict[str, int] = {}
        pieces, linked, links = [], 0, 0

        def flush():
            nonlocal linked
            text = " ".join("".join(pieces).split())
            if text:
                self.blocks.append((stack[-1][1], text, linked * 2 > len(text)))
            pieces.clear()
            linked = 0

        def add(raw):
            nonlocal linked
            if raw:
                text = entities.unescape(raw) if "&" in raw else raw
                pieces.append(text)
                linked += len(text) * (links > 0)

        def pop(k):
            nonlocal links
            for name, _ in stack[k:]:
                opened[name] -= 1
                links -= name == "a"
            del stack[k:]

        at, last = 0, source.rfind(">") + 1
        hidden = source.find("<!--", last)
        n = len(source) if hidden < 0 else hidden
        while at < n:
            m = _TAG.search(source, at, last)
            if not m:
                add(source[at:n])
                break
            add(source[at : m.start()])
            at = m.end()
            name = (m.group(2) or "").lower()
            if not name:
                continue
            if name == "br":
                pieces.append(" ")
                continue
            if m.group(1):  # an end
                if name in BLOCKS:
                    flush()
                if opened.get(name):
                    pop(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name))
                continue
            if name in BLOCKS:
                flush()
                wanted = CLOSES.get(name, ())
                if any(opened.get(x) for x in (*wanted, "p")):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] in wanted or (name in ENDS_P and stack[k][0] == "p"):
                            pop(k)
                            break
                        if stack[k][0] in BLOCKS:
                            break
            if name in VOID or m.group(3).endswith("/"):
                continue
            if name in RAW:
                end = _END_RAW[name].search(source, at)
                at = end.end() if end else n
                continue
            marks = [(g.group(1).lower(), g.group(2) or g.group(3) or g.group(4) or "") for g in _MARK.finditer(m.group(3))] if m.group(3) else []
            parent = stack[-1][1]
            if name in BLOCKS or marks or name in MAIN:
                self.up.append(parent)
                self.tokens.append(token(self.tokens[parent], "<", name + _DIGITS.sub("0", "".join(f" {k}={v}" for k, v in marks))))
                self.roles.append(_role(name, marks))
                self.names.append(name)
                parent = len(self.up) - 1
            stack.append((name, parent))  # a plain inline element belongs to the one around it
            opened[name] = opened.get(name, 0) + 1
            links += name == "a"
        flush()

    def block_token(self, k: int) -> int:
        return token(self.tokens[self.blocks[k][0]], "t", self.blocks[k][1])

    def chars(self) -> list[int]:
        """Characters of the text inside each element, but for blocks that are mostly links."""
        out = [0] * len(self.up)
        for e, text, linked in self.blocks:
            out[e] += len(text) * (not linked)
        for e in range(len(out) - 1, 0, -1):
            out[self.up[e]] += out[e]
        return out


_TOKENS = "host string, token long, up long, role int, n long, chars long, page long"


def _token_batches(batches):
    for b in batches:
        cols = ([], [], [], [], [], [], [])
        for page_id, url, source in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html").to_pylist()):
            page = Page(source)
            seen: dict[int, list[int]] = {ROOT: [0, OTHER, 1, 0]}  # the page itself
            for e, n in enumerate(page.chars()):
                got = seen.setdefault(page.tokens[e], [page.tokens[page.up[e]] if e else 0, page.roles[e], 0, 0])
                got[2] += 1
                got[3] += n
            for k, (e, text, linked) in enumerate(page.blocks):
                got = seen.setdefault(page.block_token(k), [page.tokens[e], TEXT, 0, 0])
                got[2] += 1
                got[3] += len(text) * (not linked)
            at = xxhash.xxh64_intdigest(f"{page_id}\x00{source}".encode("utf-8", "surrogatepass"))
            rows = [(t, *v, xxhash.xxh64_intdigest(f"{at}:{v[2]}") >> 24) for t, v in seen.items()]  # 40 bits: sums stay far below 64
            cols[0].extend([host(url)] * len(rows))
            for c, values in zip(cols[1:], zip(*rows)):
                c.extend(values)
        types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["host", "token", "up", "role", "n", "chars", "page"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, pages, template: array of (token, up, role, chars, on, single, varies, every)): the tokens on at least
    ``SUPPORT`` of a host's pages, and elements on ``SOME`` of them, on two pages at least. up: the parent's token; chars: of
    the text inside, over all pages; on: pages that have it; single: once on each of these; varies: not as often on each of
    these; every: in the class of the page itself, once on every page. A null html must have been made empty; an empty table
    gives none."""
    tokens = pages.mapInArrow(_token_batches, _TOKENS)
    sums = [F.count("*").alias("on"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum("page").alias("signature"), F.sum("chars").alias("chars"), F.max("up").alias("up"), F.max("role").alias("role")]
    signed = stored(tokens.groupBy("host", "token").agg(*sums).where("`on` >= 2"), "tokens")
    pages_of = signed.where(F.col("token") == ROOT).select("host", F.col("on").alias("pages"), F.col("signature").alias("whole"))
    share = F.when(F.col("role") == TEXT, SUPPORT).otherwise(SOME)
    both = signed.where(F.col("token") != ROOT).join(pages_of, "host").where(F.col("on") >= F.col("pages") * share)
    single, varies = F.col("n") == F.col("on"), F.col("squares") * F.col("on") != F.col("n") * F.col("n")
    rows = F.struct("token", "up", "role", "chars", "on", single.alias("single"), varies.alias("varies"), (F.col("signature") == F.col("whole")).alias("every"))
    return both.groupBy("host").agg(F.max("pages").alias("pages"), F.collect_list(rows).alias("template"))


class Template:
    """What a host's pages share. fixed: tokens of text blocks on most pages; tree: tokens of elements once a page on most
    pages; replies: tokens of elements beside repeated paragraphs that hold only like elements in varying number."""

    def __init__(self, fixed: frozenset[int], tree: frozenset[int], replies: frozenset[int]):
        self.fixed, self.tree, self.replies = fixed, tree, replies

    @classmethod
    def of(cls, pages: int, rows: list[tuple]) -> "Template":
        """rows: (token, up, role, chars, on, single, varies, every)."""
        up, role, free, varies, fixed, tree = {}, {}, {}, set(), set(), set()
        for t, u, r, chars, on, single, varying, _ in rows:
            up[t], role[t] = u, r
            if r == TEXT:
                fixed.add(t)
                continue
            free[t] = free.get(t, 0) + chars
            if single and on >= SUPPORT * pages:
                tree.add(t)
            if varying:
                varies.add(t)
        inside: dict[int, list[int]] = {}
        for t in free:
            inside.setdefault(up[t], []).append(t)
        down = [t for t in free if up[t] not in free]
        for t in down:  # elements, each after the one around it; grows as it is read
            down.extend(inside.get(t, ()))
        same = dict.fromkeys(free, 0)  # fixed text is not free, in all elements around it
        for t, u, r, chars, *_ in rows:
            if r == TEXT and u in same:
                same[u] += chars
        for t in reversed(down):
            free[t] -= same[t]
            if up[t] in same:
                same[up[t]] += same[t]
        return cls(frozenset(fixed), frozenset(tree), _replies(up, role, free, tree, varies, inside, down))

    def to_bytes(self) -> bytes:
        return np.array([len(self.tree), len(self.replies), *sorted(self.tree), *sorted(self.replies), *sorted(self.fixed)], np.int64).tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "Template":
        n, m, *rest = np.frombuffer(raw, np.int64).tolist()
        return cls(frozenset(rest[n + m :]), frozenset(rest[:n]), frozenset(rest[n : n + m]))


def _replies(up, role, free, tree, varies, inside, down) -> frozenset[int]:
    """Elements all of whose free text is in records directly inside, in varying number and without a heading, beside an
    element that holds paragraphs in varying number which are in no such record."""
    deep: dict[int, bool] = {}  # whether an element around varies in number
    text, heads, records = set(), set(), {}  # elements with such paragraphs, with headings; free text of records directly inside
    for t in down:
        deep[t] = deep.get(up[t], False) or up[t] in varies
        if role[t] == RECORD and t in varies:
            records[up[t]] = records.get(up[t], 0) + free[t]
    for t in reversed(down):
        if t in text or role[t] == OTHER and t in varies and free[t] > 0 and not deep[t]:
            text.add(up[t])
        if t in heads or role[t] == HEADING and free[t] > 0:
            heads.add(up[t])
    found = [c for c in tree if free[c] > 0 and records.get(c, 0) >= free[c] and c not in heads]
    return frozenset(c for c in found if any(d in text and d != c for d in inside[up[c]]))


class _Reading:
    """A page's blocks, and the way from its root to the slot of the article."""

    def __init__(self, page: Page, template: Template | None):
        self.page, self.template = page, template
        n = len(page.up)
        fixed = template.fixed if template else ()
        self.same = [bool(fixed) and page.block_token(k) in fixed for k in range(len(page.blocks))]
        self.linked = [linked and page.names[e] != "p" for e, _, linked in page.blocks]
        chars, named = page.chars(), [False] * n  # an article with text, here or inside
        for e in range(n - 1, -1, -1):  # parents come first: here, last
            named[e] = named[e] or page.roles[e] == ARTICLE and chars[e] > 0
            if e and named[e]:
                named[page.up[e]] = True
        self.named, self.hidden = named, [False] * n
        replies = template.replies if template else ()
        for e in range(1, n):
            self.hidden[e] = self.hidden[page.up[e]] or not named[e] and (page.roles[e] == OUT or page.tokens[e] in replies)

    def slot(self) -> int:
        page, n = self.page, len(self.page.up)
        prose, heads, inside = [0] * n, [0] * n, [[] for _ in range(n)]  # free text that isn't marked, and of headings
        for k, (e, text, _) in enumerate(page.blocks):
            if not (self.same[k] or self.linked[k] or self.hidden[e]):
                prose[e] += len(text)
                heads[e] += len(text) * (page.roles[e] == HEADING)
        for e in range(n - 1, 0, -1):
            u = page.up[e]
            prose[u] += prose[e]
            heads[u] += heads[e]
            inside[u].append(e)
        at = 0
        while True:
            near = [c for c in inside[at] if not self.hidden[c]]
            named = [c for c in near if self.named[c]]
            whole = [c for c in near if prose[c] and prose[c] == prose[at] and (self.template is None or page.tokens[c] in self.template.tree)]
            if page.names[at] != "article" and len(named) == 1 and (heads[named[0]] or not heads[at]):
                at = named[0]
            elif whole and page.roles[at] != ARTICLE:
                at = whole[0]
            else:
                return at


def extract(source: str, template: Template | None) -> str:
    """The article's blocks, joined by newlines, given the template of the page's host (None: nothing is known).

    On a page of an unknown host no text is known to be fixed. Pages of any length are read whole, in time linear in it.
    """
    page = Page(source)
    reading = _Reading(page, template)
    slot, n = reading.slot(), len(page.up)
    inside, doubt, part, article, around = [False] * n, [False] * n, [-1] * n, False, slot == 0
    e = slot
    while e >= 0:  # in an article, whatever element of it the slot is
        article, e = article or page.roles[e] == ARTICLE, page.up[e]
    unsure = (DOUBT,) if article else (DOUBT, HEADER)
    for e in range(slot, n):  # parents come first
        u = page.up[e]
        if e == slot:
            inside[e] = True
            continue
        inside[e] = inside[u]
        doubt[e] = page.roles[e] in unsure or doubt[u]
        part[e] = part[u] if part[u] >= 0 else e  # the element directly in the slot
        around = around or inside[e] and page.roles[e] == OUT  # the slot holds menus and the like
    blocks = []
    for k, (e, text, _) in enumerate(page.blocks):
        if inside[e] and not reading.hidden[e] and not (reading.same[k] and doubt[e]):
            blocks.append((part[e], text, reading.same[k], reading.linked[k]))
    if article or not around:
        return "\n".join(text for _, text, _, _ in blocks)
    # A slot that is a whole page: links in blocks of their own, and fixed text outside the first and the last free text, go.
    blocks = [x for x in blocks if not x[3]]
    own = {p for p, _, same, _ in blocks if not same and p >= 0}
    free = [k for k, (p, _, same, _) in enumerate(blocks) if not same or p in own]
    return "\n".join(text for _, text, _, _ in blocks[free[0] : free[-1] + 1]) if free else "\n".join(x[1] for x in blocks)


def _packed_batches(batches):
    """What a page needs of its host's template, as bytes, so that a page carries one value."""
    for b in batches:
        out = []
        for n, rows in zip(b.column("pages").to_pylist(), b.column("template").to_pylist()):
            flat = [(r["token"], r["up"], r["role"], r["chars"], r["on"], r["single"], r["varies"], r["every"]) for r in sorted(rows, key=lambda r: r["token"])]
            out.append(Template.of(n, flat).to_bytes())
        yield pa.RecordBatch.from_arrays([b.column("host"), b.column("pages"), pa.array(out, pa.binary())], ["host", "pages", "template"])


def _extract_batches(batches):
    held: dict[bytes, Template] = {}
    for b in batches:
        out = []
        for h, raw in zip(b.column("html").to_pylist(), b.column("template").to_pylist()):
            if raw is not None and raw not in held:
                if len(held) >= 256:
                    held.clear()
                held[raw] = Template.from_bytes(raw)
            out.append(extract(h, held[raw] if raw is not None else None))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, salt_pages: int = 1024, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    White space inside a block becomes one space, blocks are joined by one newline, references are decoded. A null
    html is empty (empty text); a null url, or one without a host, belongs to the host ''; a page that is alone on its
    host has no template and is read by its elements only; repeated rows each give a row; an empty table gives none.

    Templates are a written table: where Spark finds it small it is broadcast, and pages are not shuffled; else pages
    meet their host's template by host and salt, one for each ``salt_pages`` pages of the host.
    """
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    keyed = base.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    known = stored(templates(base).mapInArrow(_packed_batches, "host string, pages long, template binary"), "templates")
    salts = known.select("host", F.ceil(F.col("pages") / salt_pages).cast("int").alias("salts"))
    spread = known.join(salts, "host").select("host", "template", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    spread = stored(spread, "salted")
    salted = keyed.join(salts, "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("salts", F.lit(1))).cast("int"))
    joined = salted.join(spread, ["host", "salt"], "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(_extract_batches, "page_id long, url string, text string, n_chars long")

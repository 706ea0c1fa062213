"""Personal data: rule-checked spans, and more spans from candidates judged by gradient-boosted trees.

Four kinds have exact rules (email, ip, card, phone); their spans always stay. High-recall generators propose further,
overlapping spans (written-out addresses, numbers in other shapes, keys and bank accounts). Boosted trees score each
from its format and context; a kind's threshold is calibrated on held-out examples for precision, and of accepted
spans that overlap, the best stays. The trees are trained here on labelled examples generated from a seed.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gives_back

#: Fixed: kinds in the order in which spans with one start are listed; the first four have base rules.
KINDS = ("email", "ip", "card", "phone", "secret", "iban")
#: Documented bounds of the training: examples, trees, least held-out precision of an accepted score.
N_EXAMPLES, N_TREES, PRECISION, SEED = 6000, 40, 0.995, 11

# -- base rules ---------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # inside a run of digits it would fail as before it
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[(\[{] ?(?:at|AT) ?[)\]}]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * d - 9 * (d > 4) for d in map(int, even))) % 10 == 0


def _emails(text: str):
    """As the pattern finds them, but linear: an address is sought around each @, from the end of the one before."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted, of the four exact kinds."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# -- candidates and features --------------------------------------------------

_AT, _DOT = r"(?: ?[(\[{] ?(?:at|AT) ?[)\]}] ?)", r"(?:\.| ?[(\[{] ?(?:dot|DOT) ?[)\]}] ?)"
_GENERATORS = (
    (0, re.compile(rf"\b[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}})+")),
    (2, re.compile(r"(?<![0-9A-Za-z.])[0-9](?:[ -]?[0-9]){11,18}(?![0-9A-Za-z])")),
    (3, re.compile(r"(?<![0-9A-Za-z+.])\(?[0-9]{2,5}\)?(?:[ .-][0-9]{2,5}){1,5}(?![0-9A-Za-z])")),
    (4, re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{16,128}(?![A-Za-z0-9+/_=-])")),
    (5, re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
)
_CUES = tuple(
    re.compile(p, re.I)
    for p in (
        r"(token|key|secret|passw|credential|bearer|auth)\w*\W*$",
        r"(tel|phone|call|mobile|fax|cell|ring|numéro|telefon|teléfono)\w*\W*$",
        r"(card|visa|credit|debit|karte|carte|tarjeta|pan)\w*\W*$",
        r"(mail|contact|write to|reach)\w*\W*$",
        r"(iban|account|konto|compte|cuenta)\w*\W*$",
        r"(version|v\.?|isbn|issn|order|no\.?|page|pp\.?|section|id|ref|build|commit|sha|part|model|serial)\W*$",
        r"[=:]\s*[\"']?$",
    )
)


def candidates(text: str):
    for kind, pattern in _GENERATORS:
        for m in pattern.finditer(text):
            yield m.start(), kind, m.end()


def _iban_ok(span: str) -> bool:
    s = span.replace(" ", "")
    return len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    span, before = text[start:end], text[max(0, start - 24) : start]
    digits = [c for c in span if c in "0123456789"]
    groups = re.findall(r"[0-9]+", span)
    letters = [c for c in span if c.isascii() and c.isalpha()]
    turns = sum((a in "0123456789") != (b in "0123456789") for a, b in zip(span, span[1:]))
    n = len(span)
    shares = np.unique(list(span), return_counts=True)[1] / n
    return [
        *(float(kind == k) for k in (0, 2, 3, 4, 5)), n, len(digits), len(letters), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        turns / n, float(-(shares * np.log2(shares)).sum()), float("(" in span), span.count("-"), span.count(" "), span.count("."), float(bool(digits) and luhn("".join(digits))),
        float(kind == 5 and _iban_ok(span)), float(all(c in "0123456789abcdefABCDEF" for c in span)), float(any(c.isupper() for c in letters) and any(c.islower() for c in letters)), float(len(set(span)) <= 6),
        *(float(bool(p.search(before))) for p in _CUES), float(text[end : end + 1] in ("%", "€", "$")),
    ]


# -- training -----------------------------------------------------------------


def examples(n: int, seed: int) -> list[tuple[str, int, int, int, int]]:
    """Labelled (text, start, kind, end, 0/1), generated: personal data and look-alikes in running text."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choices("0123456789", k=k))
    word = lambda: "".join(r.choices("aeioulnrstdm", k=r.randint(2, 8)))
    words = lambda k: " ".join(word() for _ in range(k))

    def card():
        s = r.choice("3456") + digits(r.choice((13, 14, 14, 14)))
        s += next(c for c in "0123456789" if luhn(s + c))
        return r.choice(("{}", "{}", "-", " ")).format(s) if r.random() < 0.5 else r.choice(" -").join(s[i : i + 4] for i in range(0, len(s), 4))

    def iban():
        body = digits(4 * r.randint(3, 4) + 2)
        check = next(f"{k:02d}" for k in range(2, 99) if _iban_ok(f"DE{k:02d}{body}"))
        s = "DE" + check + body
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if r.random() < 0.5 else s

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{digits(2)} {digits(3)} {digits(2)} {digits(2)}", f"0{digits(3)} {digits(6)[:5]}"))

    key_letters = ("0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    good = {
        0: (lambda: f"{word()}.{word()}{r.choice((' [at] ', '(at)', ' (at) ', '[at]'))}{word()}{r.choice(('.', ' [dot] ', '(dot)'))}{r.choice(('com', 'org', 'net'))}", ("mail: ", "contact ", "write to ", "")),
        2: (card, ("card ", "card number: ", "visa ", "paid by ", "")),
        3: (phone, ("call ", "tel. ", "phone: ", "mobile ", "fax ", "call me at ")),
        4: (lambda: "".join(r.choices(r.choice(key_letters), k=r.choice((24, 32, 40, 40, 48, 64)))), ('token = "', "api_key=", "secret: ", "key = ", 'password="', "Bearer ")),
        5: (iban, ("IBAN ", "account ", "", "pay to ")),
    }
    bad = {
        0: (lambda: f"{word()} (at) {r.choice('123456789')}.{digits(1)}", ("met ", "sold ", "")),
        2: (lambda: digits(r.choice((12, 13, 16, 18))), ("order no. ", "serial ", "id ", "isbn ", "ref ", "")),
        3: (lambda: r.choice((f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(10, 28)}.{r.randint(10, 12)}.{r.randint(1900, 2030)}", f"{digits(2)} {digits(3)}", f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}", f"{digits(3)}.{digits(3)}", f"{digits(3)}-{digits(2)}-{digits(3)}", f"{digits(2)} {digits(2)}")), ("on ", "version ", "pages ", "about ", "section ", "", "")),
        4: (lambda: r.choice((f"{word()}-{word()}-{word()}-{digits(2)}", f"{word()}/{word()}/{word()}{digits(1)}x", f"{word()}_{word()}_{word()}_{digits(3)}", "=" * 16 + digits(1), digits(18), f"{word()}{word()}{word()}{digits(1)}")), ("see ", "path ", "build ", "model ", "", "commit ")),
        5: (lambda: f"{r.choice(('AB', 'XY', 'MO'))}{digits(2)} {digits(4)} {digits(4)}", ("model ", "part ", "serial ", "")),
    }
    out = []
    while len(out) < n:
        kind, label = r.choice((0, 2, 3, 4, 5)), r.random() < 0.5
        make, cues = (good if label else bad)[kind]
        cue = r.choice(cues) if r.random() < 0.9 else ""
        span, lead = make(), words(r.randint(0, 4)) + " "
        text = f"{lead}{cue}{span}{r.choice((' ', '. ', '\" ', ', ', '\n'))}{words(3)}"
        start = len(lead) + len(cue)
        if any(c == (start, kind, start + len(span)) for c in candidates(text)):
            out.append((text, start, kind, start + len(span), int(label)))
    return out


def _fit_tree(x, g, h, cuts, depth):
    """Nested (feature, cut, left, right) or a leaf's value, by gain of the second-order loss."""
    value = float(g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 40:
        return value
    best, at = 1e-6, None
    for j, points in enumerate(cuts):
        for c in points:
            left = x[:, j] <= c
            if 20 <= left.sum() <= len(g) - 20:
                a, b, p, q = g[left].sum(), g[~left].sum(), h[left].sum(), h[~left].sum()
                gain = a * a / (p + 1) + b * b / (q + 1) - (a + b) ** 2 / (p + q + 1)
                if gain > best:
                    best, at = gain, (j, float(c), left)
    if at is None:
        return value
    j, c, left = at
    return j, c, _fit_tree(x[left], g[left], h[left], cuts, depth - 1), _fit_tree(x[~left], g[~left], h[~left], cuts, depth - 1)


def _score_tree(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def score(model, row: list[float]) -> float:
    return 1 / (1 + math.exp(-sum(_score_tree(t, row) for t in model[0])))


@lru_cache(maxsize=1)
def train() -> tuple[list, dict[int, float], dict[str, float]]:
    """Trees, a threshold for each kind, and the held-out figures (precision, recall) at these thresholds."""
    rows = examples(N_EXAMPLES, SEED)
    x = np.array([features(*e[:4]) for e in rows])
    y = np.array([e[4] for e in rows], float)
    fit = np.arange(len(rows)) % 3 > 0
    cuts = [np.unique(np.quantile(x[fit, j], np.linspace(0.05, 0.95, 12))) for j in range(x.shape[1])]
    f, trees = np.zeros(len(rows)), []
    for _ in range(N_TREES):
        p = 1 / (1 + np.exp(-f))
        tree = _fit_tree(x[fit], (y - p)[fit], (p * (1 - p))[fit], cuts, 3)
        tree = _scaled(tree, 0.3)
        trees.append(tree)
        f += np.array([_score_tree(tree, r) for r in x])
    p = 1 / (1 + np.exp(-f))
    limits, hits, taken, real = {}, 0, 0, 0
    for kind in (0, 2, 3, 4, 5):
        own = ~fit & (np.array([e[2] for e in rows]) == kind)
        s, t = p[own], y[own]
        order = np.argsort(-s)
        precise = np.cumsum(t[order]) / (1 + np.arange(len(order)))
        ok = np.flatnonzero(precise >= PRECISION)
        limits[kind] = max(0.5, float(s[order][ok[-1]])) if len(ok) else 1.01
        hits, taken, real = hits + int(t[s >= limits[kind]].sum()), taken + int((s >= limits[kind]).sum()), real + int(t.sum())
    return trees, limits, {"precision": hits / max(1, taken), "recall": hits / max(1, real)}


def _scaled(tree, by):
    return (*tree[:2], _scaled(tree[2], by), _scaled(tree[3], by)) if isinstance(tree, tuple) else tree * by


# -- spans --------------------------------------------------------------------


def find_spans(text: str, model) -> tuple[list, list]:
    """Base spans, and all spans, as sorted (start, kind, end)."""
    if not _ANY.search(text):
        return [], []
    base = base_spans(text)
    scored = []
    for s, k, e in candidates(text):
        p = score(model, features(text, s, k, e))
        if p >= model[1][k]:
            scored.append((-p, s, k, e))
    taken, starts, ends = list(base), [], []  # starts, ends: what is covered, as sorted stretches
    for s, _, e in base:
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s), ends.append(e)
    for _, s, k, e in sorted(scored):
        at = bisect.bisect_right(ends, s)  # the first stretch that ends behind s
        if at == len(starts) or e <= starts[at]:
            taken.append((s, k, e))
            starts.insert(at, s), ends.insert(at, e)
    return base, sorted(taken)


def span_text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans) -> str:
    """Each span, or run of overlapping spans, gives way to the first one's kind in brackets."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += (text[at:s], f"[{KINDS[k].upper()}]")
        at = max(at, e)
    return "".join(out) + text[at:] if spans else text


@gives_back
def _span_batches(batches, model, with_text, keep):
    for b in batches:
        cols = [[] for _ in range(7)]
        for t in b.column("_text").to_pylist():
            base, spans = find_spans(t, model)
            counts = [sum(k == kind for _, k, _ in base) for kind in range(4)]
            for c, v in zip(cols, (*counts, hashlib.sha256(span_text(base).encode()).hexdigest(), span_text(spans), redact(t, spans) if with_text else None)):
                c.append(v)
        types = [pa.int64()] * 4 + [pa.string()] * 3
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(c, t) for c, t in zip(cols, types))], [*keep, *OWN])


#: Fixed: the columns this adds.
OWN = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted")


def personal_data(docs: DataFrame, with_text: bool = True, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Per row: the columns in ``keep``, counts of the base kinds, base_sha256, spans (``kind:start:end`` by start,
    comma-joined, in code points, end exclusive) and redacted (the text with spans replaced; null without ``with_text``).

    A null text is empty and has no spans; rows that repeat, and null ids, each keep their row; an empty table gives
    an empty one. A column in ``keep`` that has the name of one that is added (OWN) gives way to it.
    """
    keep = tuple(c for c in keep if c not in OWN)
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    own = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), own])
    return chosen.mapInArrow(partial(_span_batches, model=train(), with_text=with_text, keep=list(keep)), schema)

"""Personal data behind disguises, as spans of the source text (operator 12).

The plain patterns give the base spans.  Then the text runs through transducers, each of which
rewrites one kind of disguise and remembers which characters of its input every character of its
output stands for: lookalike and wide characters and invisible ones, character references,
bracketed at/dot, digits spelled in words, spelled at/dot between words, letters in place of
digits.  Identifiers found in what comes out whose characters were rewritten somewhere are mapped
back through all transducers to positions of the source, and are added to the base spans; an added
span that meets a base span of its kind is kept only if it holds all of it and more.

A plain " at " is a disguise only where a spelled dot and a known top-level domain follow, and spelled
digits count only in runs of seven or more of at least three values (or four with three dots): ordinary sentences stay alone.

Defined results: null and empty texts have no spans.  Positions are code points, ends exclusive.
Every text is read whole; no pattern goes back over what it has read, so a text takes time in
proportion to its length.  Spans are sorted by start, kind and end.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clash_free, tuned

KINDS = ("email", "ip", "card", "phone")

# ---- plain patterns: [0-9]++ doesn't go back, and a run of digits is tried from its first digit only (looked at once it is read, so that the search can skip to digits)

_LOCAL = "".join(map(chr, (*range(48, 58), *range(65, 91), *range(97, 123)))) + "._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def emails(text: str):
    """Local parts are looked for backwards from each at sign that a domain follows."""
    last = 0
    for m in _DOMAIN.finditer(text):
        before = text[max(last, text.rfind("@", last, m.start()) + 1) : m.start()]
        start = m.start() - len(before) + len(before.rstrip(_LOCAL))
        if start < m.start():
            yield start, m.end()
            last = m.end()


def ips(text: str):
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d - 9 * (d > 9) for d in (2 * int(x) for x in digits[-2::-2]))) % 10 == 0


def cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:  # 19 digits and what stands between them
            digits = "".join(_DIGITS.findall(m.group()))
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15:
            yield m.span()


_FINDERS = dict(zip(KINDS, (emails, ips, cards, phones)))


def found(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of the plain patterns' matches, sorted."""
    return sorted((a, k, b) for k, kind in enumerate(KINDS) for a, b in _FINDERS[kind](text))


# ---- transducers


class Rewritten:
    """A text after one transducer, and the way back to the positions before it.

    ``edits``: (start, end, source start, source end) of each rewritten piece, in order; all between is unchanged.
    """

    def __init__(self, text: str, pieces: list[tuple[int, int, str]]):
        """``pieces``: start, end and new text of what is rewritten, in order and apart."""
        out, self.edits, at, length = [], [], 0, 0
        for a, b, new in pieces:
            out += text[at:a], new
            length += a - at
            self.edits.append((length, length + len(new), a, b))
            length += len(new)
            at = b
        self.text = "".join([*out, text[at:]])
        self._starts = [e[0] for e in self.edits]

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source's range behind characters start to end, and whether any of it was rewritten."""
        i = bisect_right(self._starts, start) - 1
        first = start
        if i >= 0:
            a, b, s, e = self.edits[i]
            first = s if start < b else e + start - b
        j = bisect_right(self._starts, end - 1) - 1
        last = end
        if j >= 0:
            a, b, s, e = self.edits[j]
            last = e if end - 1 < b else e + end - b
        touched = j > i or i >= 0 and start < self.edits[i][1]
        return first, last, touched


# Letters of other scripts that look like Latin ones.
_LOOKALIKES = dict(zip(
    "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝһӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲ",
    "ABESIJKMHOPCTYXaesijopcyxdqwhlABEZHIKMNOPTYXoc",
    strict=True,
))
# Characters without width, dashes, full stops.
_INVISIBLE = "­͏᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
_DASHES = "‐‑‒–—―−﹘﹣－"
_DOTS = "․。．｡﹒"


@lru_cache(maxsize=4096)
def plain(c: str) -> str | None:
    """What a character outside ASCII stands for in identifiers; None: itself."""
    if c in _INVISIBLE:
        return ""
    if c in _DASHES:
        return "-"
    if c in _DOTS:
        return "."
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    if unicodedata.category(c) == "Zs":
        return " "
    wide = unicodedata.normalize("NFKC", c)
    return wide if len(wide) == 1 and wide.isascii() else None


def characters(text: str) -> Rewritten | None:
    """Lookalike, wide and invisible characters."""
    known = [c for c in set(text) if c > "\x7f" and plain(c) is not None]
    if not known:
        return None
    pieces = []
    for m in re.finditer("[" + "".join(map(re.escape, known)) + "]", text):
        pieces.append((m.start(), m.end(), plain(m.group())))
    return Rewritten(text, pieces)


_REFERENCE = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|commat|period|plus|nbsp|hyphen|dash|lowbar|zwnj|zwj|shy);")


def references(text: str) -> Rewritten | None:
    """Character references such as ``&#64;``, read as the plain character that they stand for."""
    if "&" not in text:
        return None
    pieces = []
    for m in _REFERENCE.finditer(text):
        c = html.unescape(m.group())
        new = (c if c <= "\x7f" else plain(c)) if len(c) == 1 else None
        if new is not None:
            pieces.append((*m.span(), new))
    return Rewritten(text, pieces) if pieces else None


_AT = r"(?:at|arroba|arobase|klammeraffe|ät|@)"
_DOT = r"(?:dot|punkt|punto|point|\.)"
_BRACKETED = re.compile(rf"(?i)[\x20\t]{{0,3}}(?:\([\x20\t]{{0,3}}(?:{_AT}|{_DOT})[\x20\t]{{0,3}}\)|\[[\x20\t]{{0,3}}(?:{_AT}|{_DOT})[\x20\t]{{0,3}}\]|\{{[\x20\t]{{0,3}}(?:{_AT}|{_DOT})[\x20\t]{{0,3}}\}}|<[\x20\t]{{0,3}}(?:{_AT}|{_DOT})[\x20\t]{{0,3}}>)[\x20\t]{{0,3}}")
_OPENING = re.compile(r"[(\[{<]")


def bracketed(text: str) -> Rewritten | None:
    """``(at)``, ``[dot]``, ``{punkt}``, ``<@>`` and the like, with spaces around and within."""
    pieces, after = [], 0
    for o in _OPENING.finditer(text):  # spaces before it are few, so each opening bracket is looked at once
        start = o.start()
        while start > max(after, o.start() - 3) and text[start - 1] in " \t":
            start -= 1
        m = _BRACKETED.match(text, start)
        if m:
            inner = m.group().strip(" \t()[]{}<>").lower()
            pieces.append((*m.span(), "." if re.fullmatch(_DOT, inner) else "@"))
            after = m.end()
    return Rewritten(text, pieces) if pieces else None


# Digits as words in English, German, Spanish and French.
_SPELLED = {w: str(d) for d, names in enumerate((
    "zero oh null nul cero zéro", "one eins uno un", "two zwei zwo dos deux", "three drei tres trois", "four vier cuatro quatre",
    "five fünf cinco cinq", "six sechs seis", "seven sieben siete sept", "eight acht ocho huit", "nine neun nueve neuf",
)) for w in names.split()}
_REPEAT = {"double": 2, "triple": 3}
_POINTS = ("dot", "punkt", "punto", "point")
_WORD = re.compile(r"[^\W\d_]+")
_BETWEEN = re.compile(r"[\x20\t]?[-,/()]?[\x20\t]?\n?")
LEAST_SPELLED = 7
LEAST_VALUES = 3
#: As many do where at least three dots stand between them, as in an address of four numbers.
LEAST_DOTTED = 4


def spelled_digits(text: str) -> Rewritten | None:
    """Runs of digits in words, such as ``plus four nine`` ... or ``one two seven dot zero`` ...; plain digits may stand between.

    Only runs of at least seven spelled digits of at least three values are rewritten, or four digits with three dots.
    """
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    seen = [w for w in _WORD.findall(low) if w in _SPELLED]
    if len(seen) < LEAST_DOTTED or len({_SPELLED[w] for w in seen}) < LEAST_VALUES and not any(w in low for w in _POINTS):
        return None
    pieces, run = [], []  # run: start, end, new text, spelled digits

    def close() -> None:
        while run and run[-1][3] == "" and not run[-1][2].isdigit():
            run.pop()
        while run and run[0][2] == ".":
            del run[0]
        digits = "".join(r[3] for r in run)
        least = LEAST_SPELLED if sum(r[2] == "." for r in run) < 3 else LEAST_DOTTED
        if len(digits) >= least and len(set(digits)) >= (LEAST_VALUES if least > LEAST_DOTTED else 1):
            pieces.append((run[0][0], run[-1][1], "".join(r[2] for r in run)))
        run.clear()

    times = 1
    for m in _CANDIDATE.finditer(low):
        word = m.group()
        digit = _SPELLED.get(word)
        if run and not _BETWEEN.fullmatch(low, run[-1][1], m.start()):
            close()
            times = 1
        if digit is not None:
            start = run.pop()[0] if times > 1 and run and run[-1][2] == "" else m.start()
            run.append((start, m.end(), digit * times, digit * times))
            times = 1
        elif word in _REPEAT:
            times = _REPEAT[word]
            run.append((m.start(), m.end(), "", ""))
        elif word in ("plus", "+"):
            close()
            times = 1
            run.append((m.start(), m.end(), "+", ""))
        elif word[0] in "0123456789":
            if run:
                run.append((m.start(), m.end(), word, ""))
        elif run:
            run.append((m.start(), m.end(), ".", ""))
    close()
    return Rewritten(text, pieces) if pieces else None


_CANDIDATE = re.compile(r"(?<![^\W_])(?:" + "|".join(sorted([*_SPELLED, *_REPEAT, "plus", *_POINTS], key=len, reverse=True)) + r")(?![^\W_])|(?<![^\W_])[0-9]+(?![^\W_])|\+")

# Top-level domains that a spelled dot may lead to.
_TOP = frozenset("com net org edu gov mil int info biz name io ai app dev co me tv eu de at ch fr be lu es mx ar cl pe uk ie us ca au nz it pt br nl dk se no fi pl cz ru ua cn jp kr in za example test invalid".split())
_SMALL = frozenset("the a an this that these those his her their our your my der die das dem den ein eine el la los las un una le les une".split())
_SPELLED_AT = re.compile(r"(?i)(?<=[A-Za-z0-9])[\x20\t]+(?:at|arroba|arobase|klammeraffe|ät)[\x20\t]+([A-Za-z0-9-]+(?:[\x20\t]+(?:dot|punkt|punto|point)[\x20\t]+[A-Za-z0-9-]+)+)")
_SPELLED_DOT = re.compile(r"(?i)[\x20\t]+(?:dot|punkt|punto|point)[\x20\t]+")
_LOCAL_WORDS = re.compile(r"(?i)[A-Za-z0-9_%+-]+(?:[\x20\t]+(?:dot|punkt|punto|point|underscore|dash|hyphen|minus)[\x20\t]+[A-Za-z0-9_%+-]+)*\Z")
_LOCAL_JOINT = re.compile(r"(?i)[\x20\t]+(dot|punkt|punto|point|underscore|dash|hyphen|minus)[\x20\t]+")
#: Longest local part of an address (RFC 5321) and the words that stand for its dots.
LOCAL_WINDOW = 64 + 5 * 13


def spelled_signs(text: str) -> Rewritten | None:
    """``name dot other at host dot com``."""
    low = text.lower()
    if not any(w in low for w in _POINTS):
        return None
    pieces, after = [], 0
    for m in _SPELLED_AT.finditer(text):
        labels = [x.lower() for x in _SPELLED_DOT.split(m.group(1))]
        most = max((i for i in range(1, len(labels)) if labels[i] in _TOP), default=0)
        if not most or labels[0] in _SMALL:
            continue
        floor = max(after, m.start() - LOCAL_WINDOW)
        window = text[floor : m.start()]
        joints = list(_LOCAL_JOINT.finditer(window))
        start = 0
        for a, b in zip([None, *joints], [*joints, None]):  # from the last break between words that no joint covers
            gap = window[a.end() if a else 0 : b.start() if b else len(window)]
            cut = max((gap.rfind(x) for x in " \t\n\r"), default=-1)
            if cut >= 0:
                start = (a.end() if a else 0) + cut + 1
        for j in joints:
            if j.start() > start:
                pieces.append((floor + j.start(), floor + j.end(), {"underscore": "_", "dash": "-", "hyphen": "-", "minus": "-"}.get(j.group(1).lower(), ".")))
        pieces.append((m.start(), m.start(1), "@"))
        for n, d in enumerate(_SPELLED_DOT.finditer(m.group(1))):
            if n < most:
                pieces.append((m.start(1) + d.start(), m.start(1) + d.end(), "."))
                after = m.start(1) + d.end()
    return Rewritten(text, pieces) if pieces else None


# Letters that are written for digits.
_LETTER_DIGITS = {"O": "0", "o": "0", "l": "1", "I": "1", "S": "5", "B": "8"}
_MIX = re.compile(r"[0-9](?:[OolISB]|(?<=[OolISB][0-9]))")
_MIXED = re.compile(r"(?<![A-Za-z0-9])(?=[0-9]*[OolISB])(?=[OolISB]*[0-9])[0-9OolISB]{3,64}(?![A-Za-z0-9])")


def letter_digits(text: str) -> Rewritten | None:
    """``4929 3483 8524 63O5``: tokens of digits with at most as many letters that look like digits."""
    if not _MIX.search(text):
        return None
    pieces = []
    for m in _MIXED.finditer(text):
        letters = [i for i, c in enumerate(m.group(), m.start()) if c in _LETTER_DIGITS]
        if 2 * len(letters) <= m.end() - m.start():
            pieces += [(i, i + 1, _LETTER_DIGITS[text[i]]) for i in letters]
    return Rewritten(text, pieces) if pieces else None


TRANSDUCERS = (references, characters, bracketed, spelled_digits, spelled_signs, letter_digits)


def disguised(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` in the source of identifiers that show only after rewriting."""
    chain, now = [], text
    for rewrite in TRANSDUCERS:
        step = rewrite(now)
        if step is not None:
            chain.append(step)
            now = step.text
    if not chain:
        return []
    out = []
    for a, k, b in found(now):
        hidden = False
        for step in reversed(chain):
            a, b, touched = step.source(a, b)
            hidden |= touched
        if hidden:
            out.append((a, k, b))
    return out


def spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, each ``start, kind, end`` in order."""
    if not text:
        return [], []
    base = found(text)
    extra = disguised(text)
    if not extra:
        return base, base
    own = [[(a, b) for a, kind, b in base if kind == k] for k in range(len(KINDS))]
    return base, sorted({*base, *(s for s in extra if _adds(s, own[s[1]]))})


def _adds(span: tuple[int, int, int], base: list[tuple[int, int]]) -> bool:
    """Whether a span meets no base span of its kind, or holds all it meets and more."""
    start, _, end = span
    i = bisect_right(base, start, key=lambda x: x[1])  # the first that ends after the start
    while i < len(base) and base[i][0] < end:
        a, b = base[i]
        if not (start <= a and b <= end) or (start, end) == (a, b):
            return False
        i += 1
    return True


def in_words(found_spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found_spans)


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without the text, with ``base`` and ``spans`` (texts ``kind:start:end``) and, for each kind, ``n_<kind>``: the number of its base spans."""
    tuned(df.sparkSession)
    h = clash_free(df)
    made = ["base", "spans", *(f"n_{k}" for k in KINDS)]
    names = [c for c in df.columns if c != text and c not in made]
    body = f"{h}text"

    def run(source):
        for batch in source:
            both = [spans(t.as_py()) for t in batch.column(body)]
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in both], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([in_words(b) for b, _ in both], pa.string()), pa.array([in_words(a) for _, a in both], pa.string()), *counts], names=[*names, *made])

    schema = df.select(*names).schema.add("base", "string").add("spans", "string")
    for k in KINDS:
        schema = schema.add(f"n_{k}", "long")
    return df.select(*names, F.col(text).alias(body)).mapInArrow(run, schema)


def masked(text: str | None) -> str | None:
    """The text with every span, base and added, replaced by its kind in brackets; spans that meet become one."""
    if not text:
        return text
    out, at = [], 0
    for a, k, b in spans(text)[1]:
        if a >= at:
            out += text[at:a], f"[{KINDS[k]}]"
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the personal data of ``text`` masked; null stays null."""
    tuned(df.sparkSession)

    def run(source):
        for batch in source:
            at = batch.schema.names.index(text)
            yield batch.set_column(at, text, pa.array([masked(t.as_py()) for t in batch.column(at)], pa.string()))

    return df.mapInArrow(run, df.schema)

import random
import re

import pytest

from helixframe.llm import pii

from .util import AWKWARD, clashing, documents, empty

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits_of(x):
    return [int(c) for c in x if c in "0123456789"]


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(reversed(d))) % 10 == 0


def brute(text):
    """The four patterns as they are written down."""
    out = []
    for kind, pattern, good in (
        ("email", EMAIL, lambda x: True),
        ("ip", IP, lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", CARD, lambda x: 12 <= len(digits_of(x)) <= 19 and luhn(digits_of(x))),
        ("phone", PHONE, lambda x: 9 <= len(digits_of(x)) <= 15),
    ):
        out += [(m.start(), pii.KINDS.index(kind), m.end()) for m in pattern.finditer(text) if good(m.group())]
    return sorted(out)


def card(r, n=16):
    body = [r.randrange(10) for _ in range(n - 1)]
    return "".join(map(str, [*body, next(d for d in range(10) if luhn([*body, d]))]))


def shown(text, kind):
    return [text[a:b] for a, k, b in pii.spans(text)[1] if pii.KINDS[k] == kind]


def test_patterns_on_random_texts():
    r = random.Random(5)
    pieces = ["a", "Z9", "@", ".", "..", "-", " ", "+", "(", ")", "1", "12", "255", "256", "0001", "1.2.3.4", "a@b.c", "+1 (017) 555-7713", "4", "é", "%", "x@y", "\n", "٣", card(r), card(r, 13), "4539-1488-0343-6467", "999.1.1.1.1.1"]
    for _ in range(4000):
        text = "".join(r.choices(pieces, k=r.randrange(1, 25)))
        assert pii.found(text) == brute(text), text


@pytest.mark.parametrize(
    ("disguise", "kind"),
    [
        ("anna.smith@mail7.example.com", "email"), ("anna dot smith at mail7 dot example dot com", "email"), ("anna (at) example (dot) com", "email"), ("anna[at]example.com", "email"),
        ("anna { AT } mail { DOT } example { DOT } org", "email"), ("anna<@>example<.>de", "email"), ("аnnа@ехample.com", "email"), ("ａｎｎａ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email"), ("anna&#64;example&#x2e;com", "email"),
        ("hans (ät) web (punkt) de", "email"), ("maria arroba correo punto es", "email"), ("jean arobase poste point fr", "email"), ("anna underscore smith at gmail dot com", "email"),
        ("192.168.10.1", "ip"), ("192[.]168[.]10[.]1", "ip"), ("192 (dot) 168 (dot) 10 (dot) 1", "ip"), ("one nine two dot one six eight dot one zero dot one", "ip"), ("١٩٢.١٦٨.١٠.١", "ip"),
        ("4539148803436467", "card"), ("4539‑1488‑0343‑6467", "card"), ("４５３９ １４８８ ０３４３ ６４６７", "card"), ("4539 1488 O343 6467", "card"), ("four five three nine one four eight eight zero three four three six four six seven", "card"), ("4539​1488​0343​6467", "card"),
        ("+1 (017) 555-7713", "phone"), ("＋１ ０１７ ５５５ ７７１３", "phone"), ("plus one zero one seven, five five five, seven seven one three", "phone"), ("plus vier neun eins sieben sechs fünf fünf fünf drei zwei", "phone"), ("plus three double three, six one two, three four five", "phone"),
    ],
)
def test_disguises(disguise, kind):
    for before, after in (("", ""), ("Write to ", " today."), ("ünïcode 東京\n", "\nend"), ("x " * 500, " x" * 500)):
        text = before + disguise + after
        assert disguise in shown(text, kind), (text, pii.spans(text))
        base, both = pii.spans(text)
        assert set(base) <= set(both) and base == brute(text)


@pytest.mark.parametrize(
    "text",
    [
        "The dot at noon looked at the dot com boom.", "Visit us at example.com or at shop.example.org", "un un un un un un un un un un un un un un un un", "one two three four five six seven eight nine", "Meet at point two dot three at four",
        "He was born at home (at night) and stayed at the lake [dot]", "pi is three point one four one five nine two six five", "Серый кот сидит на окне и смотрит", "éèñ ÓÜ ß at dot at dot", "version 1.2.3 of 2024-05-06, 100 000 000", "null null null null null null null null null null null null",
        "dos tres dos tres dos tres dos tres", "a|b|l0|O1 S5 B8",
    ],
)
def test_clean_texts_stay_alone(text):
    assert pii.spans(text) == (brute(text), brute(text))
    assert pii.spans(text)[1] == [] or "100" in text


def test_positions_map_back():
    """Random disguises between random words: each is found at its own place."""
    r = random.Random(11)
    swap = dict(zip("aceopx", "асеорх"))
    for _ in range(300):
        text, want = "", []
        for _ in range(r.randrange(1, 6)):
            text += " ".join(r.choices(["la", "casa", "über", "éclair", "dot", "the", "東", "­", "word."], k=r.randrange(1, 8))) + r.choice([" : ", "\n", "; "])
            name, host = "".join(r.choices("abcdexop", k=5)), "".join(r.choices("abcdexop", k=4))
            form = r.randrange(4)
            if form == 0:
                hidden = f"{name} (at) {host} (dot) com"
            elif form == 1:
                hidden = "".join(swap.get(c, c) for c in name) + "@" + host + ".com"
                if hidden.isascii():
                    continue
            elif form == 2:
                hidden = f"{name}​@{host}⁠.com"
            else:
                hidden = "".join(chr(ord(c) + 0xFEE0) if c != "@" else "＠" for c in f"{name}@{host}.net")
            want.append((len(text), 0, len(text) + len(hidden)))
            text += hidden + r.choice([" .", ", ", "!\n"])
        assert set(want) <= set(pii.spans(text)[1]), (text, want, pii.spans(text))


def test_very_long_texts_take_little_time():
    for unit in ("a", "1", "1.", "a@", "+1", "1 ", " at", "(", "( ", "one ", "&#", "０", "dot ", "a.b ", "O1", "​", " at a dot", "+", "a@b.c "):
        text = unit * (300_000 // len(unit))
        base, both = pii.spans(text)
        assert set(base) <= set(both)
    text = "x" * 200_000 + " anna(at)example.com " + "1" * 200_000
    assert (200_001, 0, 200_020) in pii.spans(text)[1]


def test_find(spark):
    rows = [*AWKWARD, (20, "a@b.com and 10.0.0.1 or 10.0.0.256"), (20, "a@b.com and 10.0.0.1 or 10.0.0.256"), (None, "call +1 (017) 555-7713"), (21, "4539148803436467 x (at) y.org")]
    got = pii.find(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = sorted((str(r["doc_id"]), r["base"], r["spans"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in got)
    want = []
    for i, t in rows:
        base, both = pii.spans(t)
        assert base == brute(t or "")
        want.append((str(i), pii.in_words(base), pii.in_words(both), *(sum(s[1] == k for s in base) for k in range(4))))
    assert by == sorted(want)
    assert ("21", "card:0:16", "card:0:16,email:17:29", 0, 0, 1, 0) in by
    assert pii.find(empty(spark)).collect() == []
    wide = pii.find(clashing(documents(spark, rows)).selectExpr("*", "'own' AS _htext"))
    assert {"ids", "score", "_htext", "spans"} <= set(wide.columns) and wide.count() == len(rows)
    assert pii.find(documents(spark, rows).selectExpr("doc_id", "text", "1 AS spans", "2 AS n_ip")).filter("spans = '1'").count() == 0


def test_mask(spark):
    rows = [(1, "mail anna (at) example.com or 10.0.0.1."), (2, None), (3, ""), (4, "nothing here")]
    got = {r["doc_id"]: r["text"] for r in pii.mask(documents(spark, rows)).collect()}
    assert got == {1: "mail [email] or [ip].", 2: None, 3: "", 4: "nothing here"}

"""Texts of a megabyte and more that make a repeated group or a lazy scan fail."""

import random
import re
import time

from pyspark.sql import functions as F

from caseloc.llm import langid, pii, secret_scan
from caseloc.llm.common import ship_package

SCHEMA = "doc_id long, text string"


def test_capitalised_words_and_names(spark):
    rng = random.Random(1)
    words = " ".join("".join(rng.choice("abcde") for _ in range(8)).capitalize() for _ in range(100_000))
    texts = [
        f"Mr John Smith met. {words} John Smith",
        "Mr O'Neil; O'NEIL left, O'Neil's too. Mrs D'Angelo-Smith and Dr Jean-Luc Picard, Mr T.",
        "Mr J. Smith, Mr J. R. Smith and Dr K.L. Brown, Ms John R. Doe; J. alone",
        "hosts 2001:db8::ff00:42:8329 and 2001:DB8:0:0:0:FF00:42:8329, not 12:30:45, std::dec or ::1",
        "Miss I think. Mr A and Mrs Élodie Ångström",
    ]
    out = {r.doc_id: r.text for r in pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    given, family = re.match(r"Mr (\w+) (\w+) met\. ", out[0]).groups()
    assert out[0] == f"Mr {given} {family} met. {words} {given} {family}"
    m = re.fullmatch(r"Mr (\w+); (\w+) left, (\w+)'s too\. Mrs (\w+) and Dr (\w+) (\w+), Mr (\w+)\.", out[1])
    assert m[2] == m[1].upper() and m[3] == m[1] and not re.search("O'N|D'A|Jean|Picard", out[1]) and m[7] != "T"
    m = re.fullmatch(r"Mr (\w)\. (\w+), Mr (\w)\. (\w)\. (\w+) and Dr (\w)\.(\w)\. (\w+), Ms (\w+) (\w)\. (\w+); J\. alone", out[2])
    assert m[1] == m[3] != "J" and m[2] == m[5] == family and m[4] == m[10] != "R" and m[6] != "K" and len({m[1], m[4], m[6], m[7]}) == 4
    one, two = re.fullmatch(r"hosts (\S+) and (\S+), not 12:30:45, std::dec or ::1", out[3]).groups()
    assert re.fullmatch(r"[0-9a-f]{4}:[0-9a-f]{4}::[0-9a-f]{4}:[0-9a-f]{4}:[0-9a-f]{4}", one) and re.fullmatch(r"([0-9A-F]{4}:){7}[0-9A-F]{4}", two)
    assert "Miss I think. Mr A and Mrs " in out[4] and "Ångström" not in out[4]


def test_brute_force_of_titled_names(spark):
    rng = random.Random(8)
    families = ["O'Neil", "D'Angelo", "McDonald", "Smith-Jones", "O’Brien", "Zeta", "Петров", "Δήμου"]
    texts = []
    for _ in range(300):
        given = rng.choice(["", "Ann ", "J. ", "J.R. ", "Jean-Luc "])
        texts.append(f"seen {rng.choice(['Mr', 'Mrs', 'Dr'])} {given}{rng.choice(families)} here")
    out = {r.doc_id: r.text for r in pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    by_name = {}
    for i, text in enumerate(texts):
        a, b = text.split(), out[i].split()
        assert len(a) == len(b) and a[:2] == b[:2] and a[-1] == b[-1] and all(x != y for x, y in zip(a[2:-1], b[2:-1])), (text, out[i])
        by_name.setdefault(a[-2], set()).add(b[-2])
    assert all(len(v) == 1 for v in by_name.values()) and len({x for v in by_name.values() for x in v}) == len(families)


def test_a_token_of_very_many_parts(spark):
    long = "x1234567890123456789" + ".abcd" * 200_000
    texts = [long, f"key {long}.ab.cdef end", "x1234567890123456789.py and x1234567890123456789.", "see x1234567890123456789.abcd.efgh.i.jklm"]
    rows = secret_scan.findings(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    values = {}
    for r in rows:
        values.setdefault(r.doc_id, []).append((r.start, r.value))
    assert values[0] == [(0, long)] and values[1] == [(4, long)]
    assert values[2] == [(0, "x1234567890123456789"), (28, "x1234567890123456789")] and values[3] == [(4, "x1234567890123456789.abcd.efgh")]


def slow_page_text(html):
    bare = re.sub(r"(?is)<(script|style|noscript|nav|head)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ", html)
    return re.sub(r"(?a)&(?:#\d+|#x[0-9A-Fa-f]+|\w+);", " ", re.sub(r"(?s)<[^>]*>", " ", bare))


def test_page_text_equals_patterns_and_is_linear(spark):
    rng = random.Random(4)
    parts = ["<script>", "</script >", "<script a='<'", ">", "<style x>", "</STYLE>", "<!--", "-->", "<nav>", "</nav>", "<header>", "a", " b", "&amp;", "<p>", "<"]
    for _ in range(5_000):
        html = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert langid.page_text(html) == slow_page_text(html), html
    for bad in ("<script", "<script>", "<!--", "<nav></nav", "<", "<script></script", "&a", "<html lang "):
        began = time.time()
        langid.page_text(bad * (5_000_000 // len(bad)))
        assert time.time() - began < 10, bad
    ship_package(spark)
    docs = spark.createDataFrame([(1, "the thing " * 30, "en"), (2, "der ung " * 30, "de"), (3, "dirt", "zz")], f"{SCHEMA}, lang string")
    pages = spark.createDataFrame([(1, "http://a.b/", "<html lang=en " * 300_000 + "der ung")], "page_id long, url string, html string")
    assert langid.identify(pages, docs, languages=2).first().lang == "de"
    assert {r.lang: r.used for r in langid.labels(docs, 2).collect()} == {"en": True, "de": True, "zz": False} or langid.labels(docs, 2).where(~F.col("used")).count() == 1

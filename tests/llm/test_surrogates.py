"""Surrogates in full formats, untitled names, odd texts."""

import random
import re

from pyspark.sql import functions as F

from caseloc.llm import pii

SCHEMA = "doc_id long, text string"


def test_more_addresses_than_half_a_format(spark):
    docs = spark.range(33_000).select(F.col("id").alias("doc_id"), F.format_string("from 192.168.%d.%d on", F.expr("id div 256"), F.col("id") % 256).alias("text"))
    out = {r.doc_id: r.text for r in pii.pseudonymize(docs).collect()}
    assert len(out) == len(set(out.values())) == 33_000
    assert all(re.fullmatch(r"from 192\.168\.\d{1,3}\.\d{1,3} on", t) for t in out.values())
    assert not [d for d, t in out.items() if t == f"from 192.168.{d // 256}.{d % 256} on"]


def test_permutation_of_a_format_is_one(spark):
    keys = spark.range(100_000).select(F.concat(F.lit("phone|"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("key"))
    moved = keys.select("key", pii.permuted(F.col("key"), "k").alias("to")).collect()
    assert len({r.to for r in moved}) == 100_000 and all(len(r.to) == 5 and not r.key.endswith(r.to) for r in moved)
    some = ["number|4111111111111111", "number|4111111111111112", "iban|DE89370400440532013000", "iban|GB82WEST12345698765432"]
    rows = {r.key: r.to for r in spark.createDataFrame([(k,) for k in some], "key string").select("key", pii.permuted(F.col("key"), "k").alias("to")).collect()}

    def luhn(s):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10

    assert luhn(rows[some[0]]) == 0 and luhn(rows[some[1]]) == luhn(some[1].split("|")[1]) != 0
    for key in some[2:]:
        to = rows[key]
        assert to[:2] == key[5:7] and int("".join(str(int(c, 36)) for c in to[4:] + to[:4])) % 97 == 1
        assert [c.isdigit() for c in to] == [c.isdigit() for c in key.split("|")[1]] and to != key.split("|")[1]


def test_a_name_keeps_its_surrogate_without_title_and_with_another(spark):
    texts = [
        "Mr John Smith met Dr John Smith. John Smith left. Then John Smith, JOHN SMITH, Smith's and Smithson; Ann Smith.",
        "Dr John Smith again, but no Jonas.",
        "John Smith has no title here.",
        "Mail John.Smith@acme.org with Frau John.",
    ]
    out = {r.doc_id: r.text for r in pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), SCHEMA), count="n").collect()}
    given, family = re.match(r"Mr (\S+) (\w+) met", out[0]).groups()
    upper = f"{given} {family}".upper()
    assert out[0] == (
        f"Mr {given} {family} met Dr {given} {family}. {given} {family} left. Then {given} {family}, {upper}, {family}'s and Smithson; Ann {family}."
    )
    assert out[1] == f"Dr {given} {family} again, but no Jonas." and out[2] == texts[2]
    assert "John.Smith" not in out[3] and "Frau John" not in out[3]


def test_brute_force_of_mentions_in_random_texts(spark):
    """Every planted entity goes, all else stays, and one entity has one surrogate."""
    rng = random.Random(3)
    made = {
        "ip": lambda: f"{rng.randrange(12, 99)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}",
        "email": lambda: f"{''.join(rng.choices('abcdef', k=6))}@{rng.choice(('acme', 'corp'))}.org",
        "ssn": lambda: f"{rng.randrange(100, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}",
    }
    pool = [(k, f()) for k, f in made.items() for _ in range(30)]
    words = "alpha beta gamma delta the of and".split()
    rows, plans = [], {}
    for d in range(200):
        parts = []
        for _ in range(rng.randrange(0, 12)):
            parts.append(rng.choice(pool) if rng.random() < 0.4 else ("", rng.choice(words)))
        plans[d] = parts
        rows.append((d, " ".join(p for _, p in parts)))
    got = {r.doc_id: r for r in pii.pseudonymize(spark.createDataFrame(rows, SCHEMA), count="n").collect()}
    seen = {}
    for d, parts in plans.items():
        out = got[d].text.split(" ") if got[d].text else []
        assert len(out) == len(parts) and got[d].n == sum(bool(k) for k, _ in parts)
        for (kind, old), new in zip(parts, out):
            if kind:
                assert seen.setdefault((kind, old), new) == new and new != old
            else:
                assert new == old
    assert len(set(seen.values())) == len(seen) and not {o for _, o in seen} & set(seen.values())


def test_odd_texts(spark):
    long = "word " * 200_000 + "a@b.org"
    rows = [(1, None, 1, "x"), (1, None, 1, "x"), (2, "", 2, "y"), (None, f"{pii.MARK} Mr Lee {pii.MARK}", 3, None), (3, long, 4, "z"), (4, "999.1.1.1", 5, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long, _row string")
    out = pii.pseudonymize(docs)
    got = out.collect()
    assert out.columns == docs.columns and len(got) == 6
    by = {r._id: r for r in got}
    assert by[1].text is None and by[2].text == "" and by[5].text == "999.1.1.1" and by[5]._row == "w"
    assert re.fullmatch(rf"{pii.MARK} Mr \w+ {pii.MARK}", by[3].text) and "Lee" not in by[3].text
    assert by[4].text.startswith("word word") and len(by[4].text) == len(long) and not by[4].text.endswith("a@b.org")
    assert pii.pseudonymize(docs.limit(0)).count() == 0

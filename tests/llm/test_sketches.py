"""Fingerprints of texts and edited texts against a brute-force version."""

import hashlib
import random

import pytest

from caseloc.llm import sketch

SCHEMA = "doc_id long, text string"


def edited(rows):
    """(doc_id, n_chars, sha of the edited text, edited text, next text) in order, by the contract's words."""
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        n = len(t) // 4
        text = t[: len(t) - n] + after[:n]
        yield d, len(t), hashlib.sha256(text.encode()).hexdigest(), text, after, t


def grams(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("cuts,per_range", [(1_024, 2_048), (4, 3)])
def test_edits_equal_brute_force(spark, monkeypatch, cuts, per_range):
    monkeypatch.setattr(sketch, "CUTS", cuts)
    whole = sketch.with_next
    monkeypatch.setattr(sketch, "with_next", lambda *a, **k: whole(*a, **{"rows_per_range": per_range} | k))
    rng = random.Random(cuts)
    say = lambda n: " ".join(f"w{rng.randrange(60)}" + rng.choice(("", ".", "é😀")) for _ in range(n))
    rows = [(rng.randrange(10**9) ** 2, say(rng.randrange(60))) for _ in range(120)]
    rows += [(5, "b"), (5, "a b c d e f"), (5, "b"), (None, "none"), (None, None), (-7, ""), (6, None), (7, "word " * 50_000)]
    tables = [rows, rows[:1], [(1, "x y"), (1, "x y")], [(None, "p q"), (None, "a")], [(3, "a b c d e f g h"), (None, None)]]
    for table in tables if per_range == 3 else tables[:2]:
        got = sorted(map(tuple, sketch.fingerprint_edits(spark.createDataFrame(table, SCHEMA)).select("doc_id", "n_chars", "edited_sha256").collect()), key=str)
        assert got == sorted(((d, n, h) for d, n, h, *_ in edited(table)), key=str)
    out = sketch.fingerprint_edits(spark.createDataFrame(rows, SCHEMA)).collect()
    prints, near = {}, {(r.edited_sha256, r.doc_id): r for r in out}
    for d, _, h, text, after, own in edited(rows):
        if (d, own) == (5, "b"):  # a repeated row: its two places have different neighbours
            continue
        r = near[h, d]
        assert prints.setdefault(own, r.fingerprint) == r.fingerprint
        a, b, c = grams(own), grams(text), grams(after)
        if max(map(len, (a | b, a | c))) <= sketch.K:  # then sketches are whole and likeness is exact
            assert r.near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
            assert r.near_next == pytest.approx(len(a & c) / len(a | c) if a | c else 1.0)
    assert sketch.fingerprint_edits(spark.createDataFrame([], SCHEMA)).count() == 0

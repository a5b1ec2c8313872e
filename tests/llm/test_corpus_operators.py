"""Corpus operators against brute force, and on nulls, empties, ties and clashes."""

import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from caseloc.llm import decontaminate, encoding, langid, packing, pii, quality, secret_scan, simhash, sketch, token_store, toxicity, words
from caseloc.llm.common import connected_components, new_path, ship_package

SCHEMA = "doc_id long, text string"
ODD = [(None, "odd one"), (1, None), (2, ""), (3, "   \n "), (4, "one"), (4, "one"), (5, "one two"), (6, "A b\tC  d\n\neé 中文 x"), (7, "word " * 30_000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, repeated and very long texts, and columns that clash."""
    ship_package(spark)
    extra = "fp long, ring string, _row string, _key string, score double, at int, n_chars long"
    return spark.createDataFrame([(*r, 1, "r", "x", "k", 0.5, 2, 3) for r in ODD], f"{SCHEMA}, {extra}")


@pytest.fixture(scope="module")
def nothing(spark):
    ship_package(spark)
    return spark.createDataFrame([], f"{SCHEMA}, lang string, source string, n_chars long")


def prose(rng, n, vocabulary=3_000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_words_do_not_depend_on_place():
    texts = ["a bb  ccc", None, "", "ccc bb", "\n", "x" * 50, "tail " * 300_000, "ccc"]
    found = list(words.word_hashes(texts))
    assert [len(x) for x in found] == [3, 0, 0, 2, 0, 1, 300_000, 1]
    assert found[0][2] == found[3][0] == found[7][0] and len(set(found[6].tolist())) == 1


# --- token store ------------------------------------------------------------


def test_encoder_equals_the_library():
    path = encoding.default_tokenizer_path()
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    fast = encoding.WordEncoder(path, keep=50)
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab1 ,'\n\t.é  s　中!²\x1c|") for _ in range(rng.randrange(30))) for _ in range(3_000)]
    for text in [*texts, "don't  we'll \n\n x", "<|endoftext|> a<|endoftext|>"]:
        assert np.frombuffer(fast.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_token_store_keeps_special_tokens(spark):
    texts = ["<|endoftext|>", "a<|endoftext|>b", "a <|endoftext|> b", "<|endoftext|><|endoftext|>\n x", "<|endoftext| >", "plain  words"]
    path, name = new_path(spark, "tokens"), encoding.default_tokenizer_path()
    token_store.write_tokens(spark.createDataFrame(list(enumerate(texts)), SCHEMA), path, name, partitions=2)
    rows = sorted(map(tuple, token_store.checksums(spark, path).collect()))
    plain, at = Tokenizer.from_file(name), 0
    for (doc_id, text), row in zip(enumerate(texts), rows, strict=True):
        ids = plain.encode(text, add_special_tokens=False).ids + [0]
        assert row == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert plain.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]


def test_token_store_reads_back(spark, odd, nothing):
    path = new_path(spark, "tokens")
    token_store.write_tokens(odd, path, encoding.default_tokenizer_path(), partitions=3)
    rows = sorted(map(tuple, token_store.checksums(spark, path).collect()), key=lambda r: r[1])
    plain, at = Tokenizer.from_file(encoding.default_tokenizer_path()), 0
    wanted = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for (doc_id, text), row in zip(wanted, rows, strict=True):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        assert row == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    some = token_store.read_tokens(spark, path, 4, 5)
    assert sorted(r.doc_id for r in some.collect()) == [4, 4, 5]
    plan = some._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(doc_id,4)" in plan
    slim = token_store.read_metadata(spark, path)
    assert "ids" not in slim.columns and "ReadSchema: struct<part:int,doc_id:bigint,local_start:bigint,n_tokens:bigint>" in slim._jdf.queryExecution().toString()
    empty = new_path(spark, "tokens")
    token_store.write_tokens(nothing, empty, encoding.default_tokenizer_path())
    assert token_store.checksums(spark, empty).count() == 0


# --- SimHash --------------------------------------------------------------------


def brute_fingerprint(text, k=3):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(found[i : i + k]), 42) for i in range(max(1, len(found) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, limit):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= limit:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("cap", [64, 2])
def test_hamming_components_equal_brute_force(spark, cap):
    rng = random.Random(5)
    values = [0]
    for _ in range(25):
        center = rng.getrandbits(64)
        values += [center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(12)]
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.hamming_links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2, bucket_cap=cap)
    found = {r.node: r.root for r in connected_components(links).collect()}
    want = brute_components(values, 2)
    groups = {}
    for v, s, w in zip(values, signed, want):
        groups.setdefault(w, set()).add(found.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)
    for r in links.collect():
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2


def test_fingerprints_and_components(spark, odd, nothing):
    rows = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.fingerprint_components(odd).collect()}
    ids = sorted({d for d, _ in ODD if d is not None})
    fps = {(d, brute_fingerprint(t)) for d, t in ODD}
    assert {(d, f"{v:016x}") for d, v in fps} == {r[:2] for r in rows}
    assert {r[2] for r in rows if r[0] in (1, 2, 3)} == {1} and ids[0] == 1
    assert simhash.fingerprint_components(nothing).count() == 0


def test_near_duplicates_find_edited_copies(spark, odd, nothing):
    rng = random.Random(7)
    rows, edits = [], []
    for base in range(40):
        text = prose(rng, 300).split()
        rows.append((base, " ".join(text)))
        copy = list(text)
        for p in rng.sample(range(300), 4):
            copy[p] = f"z{rng.randrange(999)}"
        edits.append((100 + base, " ".join(copy)))
    similar = lambda a, b: len(a & b) / len(a | b)
    cut = lambda t: {tuple(t.split()[i : i + 5]) for i in range(296)}
    assert all(similar(cut(a[1]), cut(b[1])) >= 0.8 for a, b in zip(rows, edits))
    docs = spark.createDataFrame([*rows, *edits, (500, rows[0][1])], SCHEMA)
    kept = sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect())
    assert kept[:40] == list(range(40)) and len(kept) <= 42  # recall of 0.95 and more
    blocks = sorted(r.doc_id for r in simhash.drop_near_duplicates(docs, bucket_cap=1).collect())
    assert blocks == kept
    out = simhash.drop_near_duplicates(odd)
    assert out.columns == odd.columns
    left = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert left == sorted([r for r in dict.fromkeys(ODD) if r not in ((2, ""), (3, "   \n "))], key=str)
    assert simhash.drop_near_duplicates(nothing).count() == 0


def _groups_by_brute_force(rows, limit=0.8, width=5):
    def cut(text):
        w = text.lower().split()
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}

    sets = {d: cut(t) for d, t in rows}
    root = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and root[a] != root[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= limit:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return root


@pytest.mark.parametrize("cap", [1_024, 3])
def test_near_duplicates_equal_brute_force(spark, cap):
    rng = random.Random(11)
    rows, line = [], prose(rng, 12)
    add = lambda text: rows.append((len(rows), text))
    for base in range(30):  # a passage appended, replaced or cut: similarity 0.74 to 0.86
        text = prose(rng, 200).split()
        add(" ".join(text))
        for n in (35, 40, 46, 48, 50, 60):
            add(" ".join(text) + " " + prose(rng, n))
        add(" ".join(text[:90]) + " " + prose(rng, 18) + " " + " ".join(text[108:]))
        add(" ".join(text[40:]))
        add(line + " " + " ".join(text[:60]) + " " + line)
    for n in (3, 5, 8, 9, 10):  # short texts and one word more
        text = prose(rng, n)
        add(text)
        add(text + " more")
    centre = prose(rng, 300).split()  # a large group, not all within reach of its first
    for i in range(40):
        copy = list(centre)
        for p in rng.sample(range(300), rng.randrange(14)):
            copy[p] = f"z{rng.randrange(9_999)}"
        add(" ".join(copy))
    found = {r.doc_id: r.keep_id for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), bucket_cap=cap).collect()}
    assert found == _groups_by_brute_force(rows)


# --- sketches ------------------------------------------------------------------


def test_sketch_estimates_and_merges(spark, odd, nothing):
    rng = random.Random(9)
    texts = [prose(rng, n) for n in (3, 40, 400, 4_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    cut = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    got = {r.doc_id: r for r in sketch.fingerprint_edits(docs).collect()}
    for i, text in enumerate(texts):
        nxt = texts[(i + 1) % 4]
        m = len(text) // 4
        edited = text[: len(text) - m] + nxt[:m]
        want = len(cut(text) & cut(edited)) / len(cut(text) | cut(edited))
        assert got[i].n_chars == len(text) and abs(got[i].near_edited - want) < 0.16
        assert abs(got[i].n_shingles - len(cut(text))) <= 0.4 * len(cut(text)) + 1e-9
    parts = sketch.with_sketch(docs, "text", "sketch").selectExpr("doc_id % 2 AS half", "sketch")
    merged = {r.half: r.sketch for r in sketch.merge_sketches(parts, ["half"]).collect()}
    for half in (0, 1):
        union = sorted({h for r in parts.where(f"half = {half}").collect() for h in r.sketch})[: sketch.K]
        assert merged[half] == union
    rows = sketch.fingerprint_edits(odd).collect()
    assert len(rows) == len(ODD) and {r.fingerprint for r in rows if r.doc_id in (1, 2, 3)} == {""}
    assert sketch.fingerprint_edits(nothing).count() == 0


def test_next_document_over_many_ranges(spark):
    rng = random.Random(1)
    ids = rng.sample(range(10**6), 300)
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], SCHEMA)
    got = {r.doc_id: r.next_text for r in sketch.with_next(docs, ["text"], rows_per_range=7).collect()}
    order = sorted(ids)
    assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1])}


# --- packing --------------------------------------------------------------------


def test_packing_is_tight_and_whole(spark, odd, nothing):
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 2_000, 3_000)
    costs = {c: packing.bin_cost(c) for c in packing.CAPACITIES}
    bins, offsets, capacity = packing.pack_lengths(lengths, costs)
    used = np.bincount(bins, weights=lengths)
    size = np.zeros(len(used))
    size[bins] = capacity
    assert (used <= size).all() and all(size[b] == min(c for c in costs if c >= used[b]) for b in range(len(used)))
    assert used.sum() / size.sum() > 0.98
    for b in range(0, len(used), 97):
        own = np.argsort(offsets[bins == b])
        assert (np.cumsum(lengths[bins == b][own]) - lengths[bins == b][own] == offsets[bins == b][own]).all()
    cost = sum(costs[int(c)] for c in size)
    single = {8192: packing.bin_cost(8192)}
    b1, _, c1 = packing.pack_lengths(lengths, single)
    assert cost <= len(np.unique(b1)) * single[8192]
    rows = packing.pack_documents(odd, capacities=(16, 64), shard_tokens=10_000).collect()
    by_doc = {}
    for r in rows:
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.piece_len
    encoder = encoding.WordEncoder(encoding.default_tokenizer_path())
    want = {}
    for d, t in ODD:
        want[d] = want.get(d, 0) + len(encoder.encode(t or "")) // 4 + 1
    assert by_doc == want
    filled = {}
    for r in rows:
        filled.setdefault(r.bin_id, []).append((r.bin_offset, r.piece_len, r.bin_capacity))
    for parts in filled.values():
        parts.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:])) and parts[-1][0] + parts[-1][1] <= parts[0][2]
    none = spark.createDataFrame([(0, 0, 9, None), (0, 1, 8, 0)], "part int, row long, doc_id long, length long")
    assert {(r.doc_id, r.piece_len, r.bin_id) for r in packing.pack(none).collect()} == {(9, 0, None), (8, 0, None)}
    assert packing.pack_documents(nothing).count() == 0


# --- decontamination ----------------------------------------------------------------


@pytest.mark.parametrize("broadcast_bytes", [1 << 24, 0])
def test_contamination_equals_brute_force(spark, odd, nothing, broadcast_bytes):
    rng = random.Random(11)
    items = [(i, prose(rng, rng.choice((2, 4, 9, 20, 45, 90)))) for i in range(40)] + [(98, None), (99, "  ")]
    docs = []
    for d in range(120):
        own = prose(rng, rng.choice((3, 50, 900))).split()
        for _ in range(rng.randrange(3)):
            part = items[rng.randrange(40)][1].split()
            if rng.random() < 0.4 and len(part) > 9:
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(own) + 1)
            own[at:at] = part
        docs.append((d, " ".join(own)))

    def cut(text, width):
        w = text.split()
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}

    want = {}
    for i, item in items:
        if item and item.split():
            width = min(5, len(item.split()))
            for d, text in docs:
                share = len(cut(item, width) & cut(text, width)) / len(cut(item, width))
                if share >= 0.8:
                    want[d, i] = share
    docs_df, items_df = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.contaminated(docs_df, items_df, broadcast_bytes=broadcast_bytes).collect()}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) > 30
    assert all(math.isclose(got[k], want[k]) for k in got)
    clean = {r.doc_id for r in decontaminate.drop_contaminated(docs_df, items_df, broadcast_bytes=broadcast_bytes).collect()}
    assert clean == set(range(120)) - {d for d, _ in got}
    assert decontaminate.drop_contaminated(odd, items_df, broadcast_bytes=broadcast_bytes).count() == len(ODD)
    assert decontaminate.contaminated(nothing, items_df, broadcast_bytes=broadcast_bytes).count() == 0
    assert decontaminate.contaminated(docs_df, items_df.limit(0), broadcast_bytes=broadcast_bytes).count() == 0


# --- personal data --------------------------------------------------------------------


def test_surrogates_keep_type_format_and_coreference(spark, odd, nothing):
    texts = [
        "Mail jo.doe7@acme.example.org or JO.DOE7@ACME.EXAMPLE.ORG, +1 (743) 555-3824 and 743-555-3824.",
        "Mr. John Smith met Frau Anna Müller; Mr. Smith left. Господин Иван Петров stayed.",
        "Card 4111 1111 1111 1111, plain 4111111111111111, IP 192.168.3.4 and 8.8.4.4, not 999.1.1.1.",
        "IBAN DE89 3704 0044 0532 0130 00 and SSN 123-45-6789.",
        "No data here.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    out = {r.doc_id: r.text for r in pii.pseudonymize(docs, "k1").collect()}
    again = {r.doc_id: r.text for r in pii.pseudonymize(docs, "k1").collect()}
    other = {r.doc_id: r.text for r in pii.pseudonymize(docs, "k2").collect()}
    assert out == again and out[0] != other[0] and out[4] == texts[4]
    mails = re.findall(r"\S+@\S+?(?=,| )", out[0])
    assert mails[0].upper() == mails[1] and mails[0] != "jo.doe7@acme.example.org" and re.fullmatch(r"[a-z]{2}\.[a-z]{3}\d@[a-z]{4}\.[a-z]{7}\.org", mails[0])
    phones = re.findall(r"\+1 \((\d{3})\) (\d{3})-(\d{4}) and (\d{3})-(\d{3})-(\d{4})", out[0])[0]
    assert phones[:3] == phones[3:] and "".join(phones[:3]) != "7435553824"
    names = re.match(r"Mr\. (\w+) (\w+) met Frau (\w+) (\w+); Mr\. (\w+) left\. \S+ (\w+) (\w+) stayed", out[1])
    assert names[2] == names[5] != "Smith" and names[1] in pii.GIVEN["latin", "m"] and names[3] in pii.GIVEN["latin", "f"]
    assert names[6] in pii.GIVEN["cyrillic", "m"] and re.fullmatch("[Ѐ-ӿ]+", names[7])
    cards = re.match(r"Card ((?:\d{4} ){3}\d{4}), plain (\d{16}), IP (192\.168\.\d+\.\d+) and ([\d.]+), not 999\.1\.1\.1", out[2])
    digits = cards[1].replace(" ", "")
    assert digits == cards[2] != "4111111111111111" and digits[0] == "4"
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    assert total % 10 == 0 and cards[3] != "192.168.3.4" and cards[4] != "8.8.4.4"
    iban = re.match(r"IBAN (DE\d\d(?: \d{4}){4} \d\d) and SSN (\d{3}-\d{2}-\d{4})\.", out[3])
    plain = iban[1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 and iban[2] != "123-45-6789"
    same = pii.pseudonymize(odd)
    assert same.columns == odd.columns and sorted(map(str, same.collect())) == sorted(map(str, odd.collect()))
    assert pii.pseudonymize(nothing).count() == 0


def test_surrogates_are_distinct_even_in_a_small_space(spark):
    mails = [f"{a}@x.io" for a in "abcdefghijklmnopqrstuvwxyz"]
    keys = spark.createDataFrame([(f"email|{m}",) for m in mails] + [(f"ip|10.0.0.{i}",) for i in range(200)], "key string")
    rows = {r.key: r.surrogate for r in pii.surrogates(keys).collect()}
    assert len(rows) == 226 and len(set(rows.values())) == 226
    assert not {k.split("|")[1] for k in rows} & set(rows.values())


def test_main_path_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a@b.cd")], SCHEMA)
    for df in (pii.pseudonymize(docs), sketch.fingerprint_edits(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


# --- classifiers ------------------------------------------------------------------


def test_toxicity_learns_sentences_from_document_labels(spark, odd, nothing):
    rng = random.Random(13)
    rows, labels = [], []
    for d in range(1_200):
        lines = [prose(rng, 12, 400) + "." for _ in range(rng.randrange(1, 9))]
        bad = d % 5 == 0
        if bad:
            at = rng.randrange(len(lines))
            lines[at] = lines[at].replace(" ", f" {rng.choice(('vile', 'rotten', 'nasty'))} ", 1)
        rows.append((d, " ".join(lines)))
        labels.append((d, 1, int(bad)))
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    unseen = [d for d, r in got.items() if r.held_out]
    assert unseen and all(zlib.crc32(str(d).encode()) % 5 == 0 for d in unseen)
    assert sum(got[d].predicted == labels[d][2] for d in unseen) / len(unseen) > 0.97
    spans = [(d, s) for d in unseen if labels[d][2] for s in got[d].offending]
    text = dict(rows)
    assert spans and sum(bool(re.search("vile|rotten|nasty", text[d][s.start : s.end])) for d, s in spans) / len(spans) > 0.95
    out = toxicity.toxicity(odd, marks.where("doc_id is null")).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.toxicity(nothing, marks).count() == 0


def test_quality_rejects_junk_without_labels(spark, odd, nothing):
    rng = random.Random(17)
    good = [" ".join(rng.choice(("the", "of", "and", f"word{rng.randrange(500)}")) for _ in range(80)) for _ in range(400)]
    make = [
        lambda: " ".join(f"w{rng.randrange(300)}{rng.choice(('***', '%%%', '&&&'))}" for _ in range(60)),
        lambda: " ".join(f"WORD{rng.randrange(300)}!!" for _ in range(60)),
        lambda: " | ".join(f"item{rng.randrange(300)}" for _ in range(60)),
        lambda: " ".join(w for _ in range(9) for w in [f"rep{rng.randrange(99)}"] * 7),
    ]
    junk = [make[i % 4]() for i in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + junk)], SCHEMA)
    got = {r.doc_id: r.keep for r in quality.classify(docs).collect()}
    assert all(got[i] for i in range(400)) and sum(got[i] for i in range(400, 480)) <= 4
    model = quality.train(docs)
    accuracy = quality.labeller_accuracy(model)
    assert all(accuracy[k] > 0.95 for k in ("symbols", "capitals", "separators", "doubled_marks"))
    assert quality.keep_good(odd).columns == odd.columns
    scores = {r.doc_id: r.score for r in quality.classify(odd).collect()}
    assert scores[1] == scores[2] == scores[3] == 0
    assert quality.classify(nothing).count() == 0


def test_secret_forest_removes_false_positives(spark, odd, nothing):
    rng = random.Random(19)
    rows = []
    for d in range(150):
        secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        number = "".join(rng.choice("0123456789") for _ in range(16))
        rows.append((d, f"plain words before token = \"{secret}\" after, call {number} and commit = \"{secret[::-1]}\" too", "src/app.py", "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    found = secret_scan.scan(docs).collect()
    assert len(found) == 450
    by = lambda name: [r.is_secret for r in found if r["name"] == name]
    assert all(by("token")) and not any(by("commit")) and not any(by(""))
    for r in found[:20]:
        assert rows[r.doc_id][1][r.start : r.start + r.length][:1].isalnum()
    assert secret_scan.scan(odd).count() == 0 and secret_scan.scan(nothing).count() == 0


def test_language_fuses_evidence(spark, nothing):
    rng = random.Random(23)
    stems = {"en": ("the", "thing", "with", "would"), "de": ("der", "ung", "schaft", "nicht"), "fr": ("eaux", "tion", "une", "elle")}
    say = lambda lang, n: " ".join("".join(rng.choices(stems[lang], k=2)) for _ in range(n))
    docs = spark.createDataFrame([(i, say(lang, 60), lang) for i, lang in enumerate(list(stems) * 30)], "doc_id long, text string, lang string")
    pages = [(i, f"http://{lang}.site.example/{lang}/{i}", f"<html lang='{lang}'><body><p>{say(lang, 20)}</p></body></html>") for i, lang in enumerate(list(stems) * 20)]
    pages += [(100, "http://de.site.example/x", None), (101, None, None), (102, "http://fr.site.example/y", "<html lang=en><p>" + say("fr", 30) + "</p></html>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.lang for r in langid.identify(df, docs).collect()}
    assert all(got[i] == lang for i, lang in enumerate(list(stems) * 20))
    assert got[100] == "de" and got[101] in stems and got[102] == "fr" and len(got) == 63
    assert {r.lang for r in langid.identify(df, nothing).collect()} == {None}
    assert langid.identify(df.limit(0), docs).count() == 0

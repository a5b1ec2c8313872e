"""The pipeline's stages, one after another, on planted cases."""

import random

import corpus_pipeline
from caseloc.llm import registry


def corpus(rng):
    say = lambda n: " ".join(rng.choice(("the", "of", "and", f"w{rng.randrange(2_000)}", f"w{rng.randrange(2_000)}")) for _ in range(n))
    item = say(40)
    rows = [(i, say(200)) for i in range(60)]
    rows += [(100, rows[0][1]), (101, rows[1][1] + " more"), (102, say(80) + " " + item + " " + say(80)), (103, " ".join(["X9!! ***"] * 50))]
    rows += [(104, say(60) + " write to jane.roe@mail.example.com now"), (105, None), (None, say(100)), (106, ""), (7, rows[7][1])]
    return rows, item


def test_stages_in_order(spark, tmp_path):
    rows, item = corpus(random.Random(29))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(d, t, "en", "src0", len(t or "")) for d, t in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path)).cache()
        seen[name] = now
        if name != "best_fit_packing":
            assert now.columns == docs.columns
    ids = lambda name: sorted(r.doc_id for r in seen[name].collect() if r.doc_id is not None)
    quality = ids("quality_classifier")
    assert 103 not in quality and set(range(60)) <= set(quality) and {100, 101, 102, 104} <= set(quality)
    dedup = ids("simhash_near_dedup")
    assert dedup.count(7) == 1 and not {100, 101} & set(dedup) and set(range(60)) <= set(dedup)
    clean = ids("benchmark_decontamination")
    assert set(dedup) - set(clean) == {102}
    text = {r.doc_id: r.text for r in seen["pii_surrogates"].collect()}
    assert "jane.roe" not in text[104] and text[5] == rows[5][1] and sorted(k for k in text if k is not None) == clean
    packed = seen["best_fit_packing"].collect()
    assert {r.doc_id for r in packed} == set(text) and all(r.bin_offset + r.piece_len <= r.bin_capacity for r in packed)
    assert {"bin_id", "doc_id"} <= set(corpus_pipeline.run(spark, str(tmp_path)).columns)


def test_registry_names_each_operator_once():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]


def test_near_copies_are_linked_by_fingerprints_too(spark):
    """Few distinct shingles that repeat: fingerprints are the same, sets of shingles are not alike."""
    from caseloc.llm import simhash

    said = "x y z " * 100
    own = " ".join(f"w{i}" for i in range(60))
    rows = [(1, said + "one two three four five"), (2, said + "six seven eight nine ten"), (3, own), (5, own + " more"), (6, "x y z"), (None, said + "one two three four five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.near_duplicates(docs).where("doc_id in (1, 2)").select("group_id").distinct().count() == 2
    near = {r.doc_id: r.fingerprint for r in simhash.fingerprint_components(docs).collect()}
    assert bin(int(near[1], 16) ^ int(near[2], 16)).count("1") <= 2
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == [1, 3, 6]

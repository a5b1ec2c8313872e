"""Long texts over blocks, dirty labels, odd rows through the pipeline's stages."""

import ast
import random
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from caseloc.llm import decontaminate, langid, packing, toxicity, words


def test_sentences_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(1)
    say = lambda n, p: "".join("ab" * rng.randrange(1, 4) + rng.choice("xé") + (rng.choice(".!\n?") if rng.random() < p else "") + " " for _ in range(n))
    texts = ["a b. c", say(20_000, 0.0005), None, say(30_000, 0), "", say(20_000, 0.2), "tail one. two"]
    seen = []
    for block in (1 << 26, 1 << 12):
        monkeypatch.setattr(words, "BLOCK", block)
        words._tables.clear()
        s = toxicity.sentences(texts)
        order = np.lexsort((s.buckets, s.sentence))
        seen.append((s.buckets[order], s.sentence[order], s.docs, s.starts, s.ends))
    words._tables.clear()
    assert all(np.array_equal(a, b) for a, b in zip(*seen))


def test_dirty_language_labels(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    rows = [(i, ("the thing " if i % 2 else "der ung ") * 20, ("en" if i % 2 else "de") if i < 60 else f"dirt{i}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    long = "<html><p>" + "the thing " * 100_000 + "</p></html>"
    pages = [(1, "http://a.b/", long), (1, "http://a.b/", long), (2, None, "<p>der ung der ung</p>"), (3, "x", None)]
    df = spark.createDataFrame([(*p, "h", 1.0) for p in pages], "page_id long, url string, html string, host string, soft double")
    got = sorted((r.page_id, r.lang) for r in langid.identify(df, docs).collect())
    assert got[:3] == [(1, "en"), (1, "en"), (2, "de")] and got[3][1] in ("en", "de")


def test_contaminated_on_odd_rows(spark):
    item = " ".join(f"q{i}" for i in range(20))
    rows = [(None, item), (1, None), (2, ""), (3, item), (3, item), (4, "z " * 100_000 + item), (5, "q1 q2")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, row string")
    items = spark.createDataFrame([(7, item), (8, None), (9, " ")], "item_id long, text string")
    for size in (1 << 20, 0):
        got = [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items, broadcast_bytes=size).collect()]
        assert sorted(got, key=str) == [(3, 7), (3, 7), (4, 7), (None, 7)]


def test_shards_lose_little():
    rng = np.random.default_rng(4)
    costs = {c: packing.bin_cost(c) for c in packing.CAPACITIES}
    lengths = np.minimum(rng.lognormal(6, 1.2, 4_000).astype(np.int64) + 1, 8_192)
    cut = np.array_split(lengths, max(1, int(lengths.sum() // packing.SHARD_TOKENS)))
    fill = lambda parts: sum(p.sum() for p in parts) / sum(_capacity(p, costs) for p in parts)
    assert fill(cut) > fill([lengths]) - 0.02


def _capacity(lengths, costs):
    bins, _, capacity = packing.pack_lengths(lengths, costs)
    size = np.zeros(bins.max() + 1)
    size[bins] = capacity
    return size.sum()


@pytest.mark.parametrize("rows", [[], [(None, None), (1, ""), (1, ""), (2, "word " * 60_000), (3, "one two"), (4, "one two")]])
def test_stages_on_empty_and_odd_tables(spark, tmp_path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, label int, at int"
    docs = spark.createDataFrame([(*r, "en", "s", 1, "x", 2, 3) for r in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "never found item text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns and out.count() <= now.count(), name
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert len({r.doc_id for r in packed}) == len({r[0] for r in rows})


def test_no_name_is_defined_twice():
    for path in Path(packing.__file__).parents[1].rglob("*.py"):
        names = [n.name for n in ast.parse(path.read_text()).body if isinstance(n, (ast.FunctionDef, ast.ClassDef))]
        assert len(names) == len(set(names)), path

"""The written token files: encodings, row groups, page indexes."""

import glob
import random

import pyarrow.parquet as pq

from caseloc.llm import encoding, token_store
from caseloc.llm.common import new_path


def test_files_have_delta_lists_and_indexes(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(9999)}" for _ in range(300))) for i in range(1_200)], "doc_id long, text string")
    path = new_path(spark, "tokens")
    token_store.write_tokens(docs, path, encoding.default_tokenizer_path(), partitions=2, row_group_bytes=1 << 16, page_bytes=1 << 12, page_rows=50)
    files = [pq.ParquetFile(f) for f in sorted(glob.glob(f"{path.removeprefix('file:')}/*.parquet"))]
    assert len(files) == 2 and sum(f.metadata.num_rows for f in files) == 1_200 and max(f.metadata.num_row_groups for f in files) > 1
    for f in files:
        for g in range(f.metadata.num_row_groups):
            group = f.metadata.row_group(g)
            columns = {group.column(c).path_in_schema: group.column(c) for c in range(group.num_columns)}
            assert all(c.has_column_index and c.has_offset_index for c in columns.values())
            ids = columns["ids.list.element"]
            assert "DELTA_BINARY_PACKED" in ids.encodings and not any("DICTIONARY" in e for e in ids.encodings)
            own = columns["doc_id"].statistics
            assert own.has_min_max and own.min <= own.max
    bounds = [(f.metadata.row_group(g).column(1).statistics.min, f.metadata.row_group(g).column(1).statistics.max) for f in files for g in range(f.metadata.num_row_groups)]
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))

"""Queries against their SQL where rows are empty, null or come twice."""

import shutil

import duckdb

from caseloc.plans import registry

SMALL = "/root/testdata/sf0.001"


def documents(spark, folder, rows):
    shutil.copytree(SMALL, folder)
    (folder / "documents.parquet").chmod(0o644)
    folder.chmod(0o755)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) AS n_chars")
    frame.toPandas().to_parquet(folder / "documents.parquet")
    return str(folder)


def compared(spark, name, data):
    """(rows, rows of the SQL) as text, in order."""
    con = duckdb.connect()
    for table in ("documents", "benchmark", "part"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    found = registry.queries()[name](spark, data)
    want = con.sql(registry.oracle_sql()[name])
    got = found.select(*want.columns).collect()
    return sorted(map(str, map(tuple, got))), sorted(map(str, want.fetchall()))


def test_empty_and_repeated_files_are_merged_as_in_the_sql(spark, tmp_path):
    rows = [(1, "", "en", "web"), (2, None, "en", "web"), (4, "", "en", "web"), (8, None, "de", "web"), (3, "a", "en", "code"), (3, "b", "en", "code"), (3, "", "en", "code")]
    rows += [(12, "x", "de", "web"), (12, "y", "de", "web"), (5, "z", None, "web"), (6, "z", "fr", "code")]
    got, want = compared(spark, "e19_merge_source_files", documents(spark, tmp_path / "odd", rows))
    assert got == want and len(got) == len(rows)

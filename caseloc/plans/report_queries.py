"""Report queries, changed lines and files on disk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.session import shared_path
from ..operators import metrics as M
from ..operators import reports as R
from ..sources import readers
from .policy_queries import COMP_SQL, _totals
from .search_queries import A25_SQL, _gold, a25_metric_summary, w14_rank_metrics
from .views import load


def e16_changed_lines(spark, sf_dir):
    # Only keys are grouped; patches are written out where they are read.
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("item")).repartition("l_orderkey")
    hunk = lambda x: F.concat(F.lit("@@ -1,3 +"), (x["l_linenumber"] * 10).cast("string"), F.lit(",3 @@ x\n same\n-old\n+new\n+more"))
    chunks = F.transform(F.array_sort(F.collect_list("item")), hunk)
    head = F.concat(F.lit("--- a/o.py\n+++ b/src/o"), F.col("l_orderkey").cast("string"), F.lit(".py\n"))
    patches = li.groupBy("l_orderkey").agg(F.array_join(chunks, "\n").alias("body")).select(F.col("l_orderkey").alias("instance_id"), F.concat(head, "body").alias("patch"))
    return M.changed_lines(patches)


E16_SQL = """SELECT DISTINCT l_orderkey AS instance_id, 'src/o' || l_orderkey || '.py' AS path, l_linenumber * 10 + k AS line FROM lineitem, range(1, 3) AS r(k)"""


def r2_failure_rows(spark, sf_dir):
    metrics = w14_rank_metrics(spark, sf_dir).where("instance_id <> 'src3' AND instance_id <> 'src7'").select("instance_id", "gold_count", "acc@1", "mrr@15")
    failures = load(spark, sf_dir, "documents").select(F.col("source").alias("instance_id"))
    return R.zero_rows(failures, metrics, _gold(spark, sf_dir))


R2_SQL = """SELECT d.source AS instance_id, CAST(count(DISTINCT CASE WHEN quality = 1 THEN d.doc_id END) AS DOUBLE) AS gold_count, 0.0 AS "acc@1", 0.0 AS "mrr@15"
FROM documents d LEFT JOIN labels USING (doc_id) WHERE d.source IN ('src3', 'src7') GROUP BY d.source"""


def r3_metric_report(spark, sf_dir):
    return R.percent_table(a25_metric_summary(spark, sf_dir))


def j23_seed_penalty(spark, sf_dir):
    ranked = _totals(spark, sf_dir)
    return R.seed_penalty(ranked, ranked.where("path LIKE '%7.py'").select("instance_id", "path"))


J23_SQL = f"""WITH {COMP_SQL}, t AS (SELECT instance_id, path, round(sum(score), 6) AS s FROM comp GROUP BY ALL),
x AS (SELECT instance_id, path, round(CASE WHEN path LIKE '%7.py' THEN s * 0.7 ELSE s END, 6) AS score FROM t)
SELECT instance_id, path, score, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, path) AS rank FROM x"""


def s3_read_files(spark, sf_dir):
    """Whole documents written as files of a few lines, read back as files."""
    path = shared_path(spark, "tree")
    docs = load(spark, sf_dir, "documents").select("source", F.to_json(F.struct("doc_id", "text")).alias("value"))
    # Files of at most 64 documents, so that a hot source is many files and none is large.
    docs.write.partitionBy("source").option("maxRecordsPerFile", 64).text(path)
    found = readers.read_files(spark, path, (".txt",), max_bytes=64 << 20)
    each = found.select(F.explode(F.split(F.rtrim("text", F.lit("\n")), "\n")).alias("line"))
    doc = F.from_json("line", "doc_id long, text string")
    return each.select(doc["doc_id"].alias("doc_id"), F.md5(doc["text"]).alias("text_md5"))


QUERIES = {
    "e16_changed_lines": (e16_changed_lines, E16_SQL),
    "r2_failure_rows": (r2_failure_rows, R2_SQL),
    "r3_metric_report": (
        r3_metric_report,
        f"SELECT split_part(metric, '@', 1) AS family, split_part(metric, '@', 2) AS k, printf('%.2f', mean * 100) AS percent FROM ({A25_SQL}) WHERE contains(metric, '@')",
    ),
    "j23_seed_penalty": (j23_seed_penalty, J23_SQL),
    "s3_read_files": (s3_read_files, "SELECT doc_id, md5(text) AS text_md5 FROM documents"),
}

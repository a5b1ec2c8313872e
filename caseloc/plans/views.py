"""Views that bind the library's operators to the given tables, and the same
views as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Sentences that a report may end with: links of every kind, images, symbols
#: and words that decide labels. A document gets the one at doc_id modulo their
#: number, so all rules are met at every size.
TAILS = (
    "Crash with traceback, see https://github.com/acme/tool/pull/12/files and (https://github.com/acme/tool/issues/7).",
    "We should add support for a new option `max_retries`; docs at https://docs.acme.org/en/api/options.html?version=2&name=retry.",
    "Regression since https://github.com/acme/tool/commit/abc123def: `Parser.parse()` fails.",
    "Code is in https://github.com/acme/tool/blob/main/src/core/parser.py#L42-L50, please refactor `parse_all`.",
    "Playground: https://playground.acme.dev/?code=let+x&config=strict shows a wrong layout margin.",
    "Screenshot https://user-images.githubusercontent.com/1/legend.png with the chart legend and tooltip.",
    "![plot](https://cdn.acme.org/img/plot.svg?raw=1) The canvas does not render. See https://www.chart.example/docs/samples/legend/events",
    "Button click on the form does not submit; state in redux store is stale. https://shop.acme.wordpress.com/checkout?step=pay",
    "Nothing to add.",
    "Compare https://github.com/acme/tool/compare/v1...v2.diff, https://github.com/acme/tool.",
    "The pdf font wrap is incorrect: https://files.acme.org/a/b/report.jpeg, https://stackblitz.com/edit/demo-1",
    "`onLeave` and `legend` hooks; URL https://developer.acme.org/reference/onLeave and again https://developer.acme.org/reference/onLeave.",
    "Rename `SelectorCache` to cleanup types.\n[Adapter Note] chart canvas legend render",
)


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instance_id, repo, issue_text) from documents."""
    docs = load(spark, sf_dir, "documents")
    tail = F.get(F.array(*map(F.lit, TAILS)), (F.col("doc_id") % len(TAILS)).cast("int"))
    return docs.select(
        F.col("doc_id").alias("instance_id"),
        F.concat_ws("/", "source", F.concat("lang", F.lit("-tool"))).alias("repo"),
        F.concat("text", F.lit("\n"), tail).alias("issue_text"),
    )


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


ISSUES_SQL = f"""issues AS (
  SELECT doc_id AS instance_id, source || '/' || lang || '-tool' AS repo,
         text || chr(10) || list_extract({sql_list(TAILS)}, CAST(doc_id % {len(TAILS)} AS INT) + 1) AS issue_text
  FROM documents)"""


def files(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """(path, text, doc_id, more): documents as files under source and language."""
    return load(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text", "doc_id", *more
    )


FILES_SQL = "files AS (SELECT source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, text, doc_id FROM documents)"

"""Source, sink and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.session import shared_path
from ..sources import readers, writers
from ..streaming import events as V
from .views import ISSUES_SQL, issues, load


def _stream(spark, sf_dir):
    rows = V.event_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def t2_current_state(spark, sf_dir):
    return V.run_available(V.current_state(_stream(spark, sf_dir)), "state", "complete")


def t3_phase_durations(spark, sf_dir):
    return V.run_available(V.phase_durations(_stream(spark, sf_dir), "signup", "purchase"), "phases")


def t4_throughput(spark, sf_dir):
    return V.run_available(V.throughput(_stream(spark, sf_dir)), "rate", "complete")


def t4_sliding_throughput(spark, sf_dir):
    return V.run_available(V.throughput(_stream(spark, sf_dir), "1 hour", "15 minutes"), "sliding", "complete")


def t5_stall_alert(spark, sf_dir):
    return V.run_available(V.stalls(_stream(spark, sf_dir)), "stalls").withColumn("stalled_from", F.col("stalled_from").cast("timestamp"))


def t6_activity_sessions(spark, sf_dir):
    return V.run_available(V.sessions(_stream(spark, sf_dir)), "sessions", "complete")


def t7_dedupe_attempts(spark, sf_dir):
    return V.run_available(V.first_seen(_stream(spark, sf_dir), ["user_id", "event_type"]), "first")


def t8_resume_stream(spark, sf_dir):
    done = load(spark, sf_dir, "events").where("event_type = 'purchase' AND value > 90")
    left = V.unfinished(_stream(spark, sf_dir).select("event_id", "user_id"), done)
    return V.run_available(left, "resume").groupBy("user_id").agg(F.count("*").alias("n"))


def t9_late_events(spark, sf_dir):
    rows = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    delayed = F.when(F.col("event_id") % 17 == 0, F.col("ts") - F.expr("INTERVAL 3 HOURS")).otherwise(F.col("ts"))
    return V.late_events(rows.withColumn("ts", delayed))


T9_SQL = """WITH e AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN ts - INTERVAL 3 HOUR ELSE ts END AS ts FROM events),
s AS (SELECT *, max(ts) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e)
SELECT event_id, (epoch_us(seen) - epoch_us(ts)) / 1e6 AS late_seconds FROM s WHERE epoch_us(seen) - epoch_us(ts) > 3600000000"""


# --- sources and sinks ---------------------------------------------------------------


def s1_read_issues(spark, sf_dir):
    path = shared_path(spark, "issues")
    own = issues(spark, sf_dir)
    odd = F.col("instance_id") % 2 == 1
    rows = own.select(
        F.when(odd, F.col("instance_id").cast("string")).alias("instance_id"),
        F.when(~odd, F.col("instance_id").cast("string")).alias("id"),
        F.when(odd, F.col("repo")).alias("repo"),
        F.when(~odd, F.col("repo")).alias("repository"),
        F.col("issue_text").alias("problem_statement"),
    )
    writers.write_jsonl(rows, path)
    found = readers.read_issues(spark, path)
    return found.select("instance_id", "repo", F.md5("issue_text").alias("text_md5"))


def s2_gold_files_field(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    listed = F.to_json(F.array(name, F.concat(name, F.lit(".py"))))
    lines = F.concat(F.lit(" "), name, F.lit(" \n\n"), name, F.lit(".js"))
    rows = docs.select(F.col("doc_id").alias("instance_id"), F.when(F.col("doc_id") % 3 == 0, listed).when(F.col("doc_id") % 3 == 1, lines).alias("files"))
    return readers.gold_files(rows)


S2_SQL = """WITH n AS (SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) AS name FROM documents)
SELECT doc_id AS instance_id, name AS item FROM n WHERE doc_id % 3 < 2
UNION ALL SELECT doc_id, name || CASE doc_id % 3 WHEN 0 THEN '.py' ELSE '.js' END FROM n WHERE doc_id % 3 < 2"""


def s4_read_snapshots(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("source", "lang", "doc_id", "text")
    path = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"))
    snapshot = docs.where("doc_id % 4 = 0").select(F.col("source").alias("snapshot_id"), F.to_json(F.create_map(path, F.struct(F.col("text").alias("text")))).alias("structure"))
    checkout = docs.select(F.col("source").alias("snapshot_id"), path.alias("path"), F.lit("checkout").alias("text"))
    rows = readers.snapshot_files(snapshot, checkout)
    return rows.select("snapshot_id", "path", F.md5("text").alias("text_md5"))


S4_SQL = """SELECT source AS snapshot_id, lang || '/' || CAST(doc_id AS VARCHAR) AS path, md5(CASE WHEN doc_id % 4 = 0 THEN text ELSE 'checkout' END) AS text_md5
FROM documents"""


def s5_write_snapshots(spark, sf_dir):
    path = shared_path(spark, "snapshots")
    files = load(spark, sf_dir, "documents").select(F.col("source").alias("snapshot_id"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "text")
    entities = files.select("snapshot_id", "path", F.lit("class").alias("kind"), F.lit("Doc").alias("name"), F.lit(1).alias("start_line"), F.length("text").alias("end_line"))
    writers.write_snapshots(files, entities, path)
    back = spark.read.parquet(path)
    return back.groupBy("snapshot_id").agg(F.count("*").alias("files"), F.sum(F.element_at("entities", 1)["end_line"]).alias("chars"))


def s7_write_metrics_csv(spark, sf_dir):
    path = shared_path(spark, "metrics")
    part = load(spark, sf_dir, "part")
    first = part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("acc"))
    second = part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("recall"))
    writers.write_csv([first, second], path)
    back = spark.read.option("header", True).schema("id long, acc int, recall double").csv(path)
    return back.groupBy("id").agg(F.count("*").alias("n"), F.max("acc").alias("acc"), F.round(F.max("recall"), 4).alias("recall"))


def s8_append_results(spark, sf_dir):
    path = shared_path(spark, "results")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    for status in ("F", "O"):
        writers.append_results(orders.where(F.col("o_orderstatus") == status), path)
    back = readers.read_results(spark, path, "o_orderkey long, o_orderstatus string", strict=True)
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total"))


def s9_read_result_logs(spark, sf_dir):
    path = shared_path(spark, "logs")
    orders = load(spark, sf_dir, "orders")
    row = F.to_json(F.struct("o_orderkey", "o_totalprice"))
    orders.select(F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("{broken "), row)).otherwise(row).alias("value")).write.text(path)
    return readers.read_results(spark, path, "o_orderkey long, o_totalprice double")


def s10_read_images(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    wide = F.lpad(F.hex("p_size"), 8, "0")
    tall = F.lpad(F.hex(F.col("p_partkey") % 5_000), 8, "0")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), wide, tall)
    content = (
        F.when(F.col("p_partkey") % 4 == 0, F.unhex(png))
        .when(F.col("p_partkey") % 4 == 1, F.unhex(F.concat(F.lit("474946383961"), F.substring(F.lpad(F.hex("p_size"), 2, "0"), 1, 2), F.lit("000A00"))))
        .when(F.col("p_partkey") % 4 == 2, F.encode(F.lit("<svg xmlns='x'/>"), "UTF-8"))
        .otherwise(F.encode(F.lit(""), "UTF-8"))
    )
    return readers.image_headers(part.select(F.col("p_partkey").cast("string").alias("path"), content.alias("content")))


S10_SQL = """SELECT CAST(p_partkey AS VARCHAR) AS path, CASE p_partkey % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'gif' WHEN 2 THEN 'svg' ELSE 'unknown' END AS format,
CASE p_partkey % 4 WHEN 0 THEN 24 WHEN 1 THEN 10 WHEN 2 THEN 16 ELSE 0 END AS size,
CASE WHEN p_partkey % 4 < 2 THEN p_size END AS width, CASE p_partkey % 4 WHEN 0 THEN CAST(p_partkey % 5000 AS INT) WHEN 1 THEN 10 END AS height,
p_partkey % 4 < 2 AS processable, CASE p_partkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'vector_image' ELSE 'empty_file' END AS reason FROM part"""

QUERIES = {
    "s1_read_issues": (s1_read_issues, f"WITH {ISSUES_SQL} SELECT CAST(instance_id AS VARCHAR) AS instance_id, repo, md5(issue_text) AS text_md5 FROM issues"),
    "s2_gold_files_field": (s2_gold_files_field, S2_SQL),
    "s4_read_snapshots": (s4_read_snapshots, S4_SQL),
    "s5_write_snapshots": (s5_write_snapshots, "SELECT source AS snapshot_id, count(*) AS files, sum(length(text)) AS chars FROM documents GROUP BY source"),
    "s7_write_metrics_csv": (s7_write_metrics_csv, "SELECT p_partkey AS id, 2 AS n, p_size AS acc, round(p_retailprice, 4) AS recall FROM part"),
    "s8_append_results": (s8_append_results, "SELECT o_orderstatus, count(*) AS n, sum(o_orderkey) AS total FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderstatus"),
    "s9_read_result_logs": (s9_read_result_logs, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0"),
    "s10_read_images": (s10_read_images, S10_SQL),
    "t2_current_state": (
        t2_current_state,
        "SELECT user_id, ts AS last_update, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    ),
    "t3_phase_durations": (
        t3_phase_durations,
        """SELECT a.user_id, a.event_id AS start_id, b.event_id AS end_id, (epoch_us(b.ts) - epoch_us(a.ts)) / 1e6 AS seconds FROM events a JOIN events b
ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR""",
    ),
    "t4_throughput": (
        t4_throughput,
        "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    ),
    "t4_sliding_throughput": (
        t4_sliding_throughput,
        """SELECT time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value
FROM events, range(4) AS r(k) GROUP BY ALL""",
    ),
    "t5_stall_alert": (
        t5_stall_alert,
        """SELECT user_id, prev AS stalled_from, (epoch_us(ts) - epoch_us(prev)) / 1e6 AS gap_seconds FROM (
SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events) WHERE epoch_us(ts) - epoch_us(prev) > 7200000000""",
    ),
    "t6_activity_sessions": (
        t6_activity_sessions,
        """WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""",
    ),
    "t7_dedupe_attempts": (t7_dedupe_attempts, "SELECT DISTINCT user_id, event_type FROM events"),
    "t8_resume_stream": (
        t8_resume_stream,
        "SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90) GROUP BY user_id",
    ),
    "t9_late_events": (t9_late_events, T9_SQL),
}

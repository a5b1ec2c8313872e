"""Search, ranking and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.session import kept
from ..operators import metrics as M
from ..operators import search as S
from .views import FILES_SQL, files, load

# --- flagship: find benchmark passages in documents, and score the rankings ----


def _passages(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def search_files(spark, sf_dir):
    return S.search_files(_passages(spark, sf_dir), files(spark, sf_dir), 15)


TOKENIZE_SQL = r"""qm AS (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_.$-]*')) AS m FROM benchmark),
qt AS (SELECT item_id, token, 1 + least(1.0, log2(count(*)) * 0.25) AS weight FROM (
  SELECT item_id, regexp_replace(lower(m), '^[._$-]+|[._$-]+$', '', 'g') AS token FROM qm
  UNION ALL SELECT item_id, unnest(string_split(lower(regexp_replace(m, '([a-z0-9])([A-Z])', '\1 \2', 'g')), ' ')) FROM qm)
  WHERE length(token) >= 2 GROUP BY item_id, token)"""
RANKED_SQL = f"""{FILES_SQL}, {TOKENIZE_SQL},
low AS (SELECT path, lower(path) AS lp, lower(text) AS lt FROM files),
td AS (SELECT token, path, CASE WHEN contains(lp, token) THEN 8 ELSE 0 END + least(12, (length(lt) - length(replace(lt, token, ''))) // length(token)) AS times
  FROM (SELECT DISTINCT token FROM qt), low WHERE contains(lt, token) OR contains(lp, token)),
sc AS (SELECT item_id, path, weight * times AS s FROM qt JOIN td USING (token)
  UNION ALL SELECT item_id, path, 5.0 FROM benchmark b, low WHERE length(trim(lower(b.text))) > 4 AND contains(lt, trim(lower(b.text)))),
tot AS (SELECT item_id AS query_id, path, round(sum(s), 6) AS score FROM sc GROUP BY ALL),
ranked AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank, path, score FROM tot) WHERE rank <= 15)"""


def flagship(spark, sf_dir):
    """Each passage's files ranked and scored against the files that hold it."""
    passages, corpus = _passages(spark, sf_dir), files(spark, sf_dir)
    best, whole = S.search_and_hold(passages, corpus, 15)
    ranked = best.select(F.col("query_id").alias("instance_id"), "rank", F.col("path").alias("item"))
    ranked = kept(ranked, "ranked")
    holding = kept(whole.select(F.col("query_id").alias("instance_id"), F.col("path").alias("item")), "gold")
    instances = passages.select(F.col("query_id").alias("instance_id"))
    scores = M.rank_metrics(instances, ranked, holding)
    return scores.select("instance_id", "gold_count", "pred_count", "acc@1", "acc@5", "recall@15", "mrr@15", "map@15", "set_f1@10")


FLAGSHIP_SQL = f"""WITH {RANKED_SQL},
gold AS (SELECT DISTINCT item_id AS query_id, path FROM benchmark b, low WHERE contains(lt, trim(lower(b.text)))),
h AS (SELECT r.query_id, rank, CASE WHEN g.path IS NULL THEN 0 ELSE 1 END AS hit FROM ranked r LEFT JOIN gold g ON r.query_id = g.query_id AND r.path = g.path),
c AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) AS found FROM h),
a AS (SELECT query_id, count(*) AS p, sum(hit) FILTER (WHERE rank <= 1) AS h1, sum(hit) FILTER (WHERE rank <= 5) AS h5, sum(hit) AS h15,
  sum(hit) FILTER (WHERE rank <= 10) AS h10, count(*) FILTER (WHERE rank <= 10) AS n10,
  min(rank) FILTER (WHERE hit = 1) AS first, sum(hit * found / rank) AS prec FROM c GROUP BY query_id),
gc AS (SELECT query_id, count(*) AS g FROM gold GROUP BY query_id),
j AS (SELECT b.item_id AS instance_id, coalesce(g, 0) AS g, coalesce(p, 0) AS p, coalesce(h1, 0) AS h1, coalesce(h5, 0) AS h5, coalesce(h15, 0) AS h15,
  coalesce(h10, 0) AS h10, coalesce(n10, 0) AS n10, first, coalesce(prec, 0) AS prec
  FROM benchmark b LEFT JOIN a ON b.item_id = a.query_id LEFT JOIN gc ON b.item_id = gc.query_id)
SELECT instance_id, CAST(g AS DOUBLE) AS gold_count, CAST(p AS DOUBLE) AS pred_count,
  CASE WHEN g > 0 AND h1 > 0 THEN 1.0 ELSE 0.0 END AS "acc@1", CASE WHEN g > 0 AND h5 > 0 THEN 1.0 ELSE 0.0 END AS "acc@5",
  CASE WHEN g > 0 THEN round(h15 / g, 6) ELSE 0.0 END AS "recall@15",
  CASE WHEN g > 0 AND first IS NOT NULL THEN round(1.0 / first, 6) ELSE 0.0 END AS "mrr@15",
  CASE WHEN g > 0 THEN round(prec / g, 6) ELSE 0.0 END AS "map@15",
  CASE WHEN g > 0 AND h10 > 0 THEN round(2 * (h10 / g) * (h10 / n10) / (h10 / g + h10 / n10), 6) ELSE 0.0 END AS "set_f1@10" FROM j"""


# --- rankings of documents within a source, against quality labels -------------


def _ranked(spark, sf_dir):
    from pyspark.sql.window import Window

    docs = load(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    order = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    ranked = docs.withColumn("rank", F.row_number().over(order)).where("rank <= 40")
    return ranked.select(F.col("source").alias("instance_id"), "rank", F.concat(F.lit("./d/"), F.col("doc_id").cast("string")).alias("item"))


def _gold(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    good = docs.select("source", "doc_id").join(labels.where("quality = 1").select("doc_id"), "doc_id")
    return good.select(F.col("source").alias("instance_id"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("item"))


def w14_rank_metrics(spark, sf_dir):
    ranked = _ranked(spark, sf_dir)
    return M.rank_metrics(ranked.select("instance_id"), ranked, _gold(spark, sf_dir))


RG_SQL = """r AS (SELECT * FROM (SELECT source AS instance_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 40),
g AS (SELECT DISTINCT source AS instance_id, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
h AS (SELECT r.instance_id, rank, CASE WHEN g.doc_id IS NULL THEN 0 ELSE 1 END AS hit FROM r LEFT JOIN g USING (instance_id, doc_id)),
c AS (SELECT *, sum(hit) OVER (PARTITION BY instance_id ORDER BY rank) AS found FROM h)"""


def _metrics_sql() -> str:
    top = ", ".join(f"sum(CASE WHEN rank <= {k} THEN hit ELSE 0 END) AS h{k}" for k in M.KS)
    cut = lambda c: "TRUE" if c == "all" else f"rank <= {c}"
    cuts = ", ".join(f"sum(CASE WHEN {cut(c)} THEN 1 ELSE 0 END) AS n_{c}, sum(CASE WHEN {cut(c)} THEN hit ELSE 0 END) AS s_{c}" for c in M.CUTOFFS)
    out = []
    for k in M.KS:
        out += [
            f'CASE WHEN g > 0 AND h{k} > 0 THEN 1.0 ELSE 0.0 END AS "acc@{k}"',
            f'CASE WHEN g > 0 AND h{k} = g THEN 1.0 ELSE 0.0 END AS "strict_acc@{k}"',
            f'CASE WHEN g > 0 THEN round(h{k} / g, 6) ELSE 0.0 END AS "recall@{k}"',
        ]
    for c in M.CUTOFFS:
        out += [
            f'CASE WHEN g > 0 AND s_{c} = g THEN 1.0 ELSE 0.0 END AS "set_sl@{c}"',
            f'CASE WHEN g > 0 THEN round(s_{c} / g, 6) ELSE 0.0 END AS "set_rec@{c}"',
            f'CASE WHEN g > 0 AND n_{c} > 0 THEN round(s_{c} / n_{c}, 6) ELSE 0.0 END AS "set_pre@{c}"',
            f'CASE WHEN g > 0 AND s_{c} > 0 THEN round(2 * (s_{c} / g) * (s_{c} / n_{c}) / (s_{c} / g + s_{c} / n_{c}), 6) ELSE 0.0 END AS "set_f1@{c}"',
        ]
    return f"""{RG_SQL},
a AS (SELECT instance_id, count(*) AS p, min(CASE WHEN hit = 1 AND rank <= 15 THEN rank END) AS first,
  sum(CASE WHEN hit = 1 AND rank <= 15 THEN found / rank ELSE 0 END) AS prec, {top}, {cuts} FROM c GROUP BY instance_id),
gc AS (SELECT instance_id, count(*) AS g FROM g GROUP BY instance_id),
j AS (SELECT a.*, coalesce(gc.g, 0) AS g FROM a LEFT JOIN gc USING (instance_id)),
m AS (SELECT instance_id, CAST(g AS DOUBLE) AS gold_count, CAST(p AS DOUBLE) AS pred_count, {', '.join(out)},
  CASE WHEN g > 0 AND first IS NOT NULL THEN round(1.0 / first, 6) ELSE 0.0 END AS "mrr@15",
  CASE WHEN g > 0 THEN round(prec / g, 6) ELSE 0.0 END AS "map@15" FROM j)"""


def a25_metric_summary(spark, sf_dir):
    return M.metric_summary(w14_rank_metrics(spark, sf_dir))


_A25_COLS = ["gold_count", "pred_count", *[f"{a}@{k}" for k in M.KS for a in ("acc", "strict_acc", "recall")],
             *[f"set_{a}@{c}" for c in M.CUTOFFS for a in ("sl", "rec", "pre", "f1")], "mrr@15", "map@15"]
A25_SQL = f"WITH {_metrics_sql()} " + " UNION ALL ".join(
    [f"SELECT '{c}' AS metric, round(avg(\"{c}\"), 6) AS mean FROM m" for c in _A25_COLS]
    + ["SELECT 'empty', round(avg(CASE WHEN pred_count <= 0 THEN 1.0 ELSE 0.0 END), 6) FROM m"]
)


# --- attempts: orders as attempts at customers' issues -------------------------


def _attempts(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "P", "partial").otherwise("error")
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("instance_id"), status.alias("status"), F.col("o_totalprice").alias("elapsed_seconds")
    )


ATTEMPTS_SQL = """attempts AS (SELECT o_orderkey AS seq, o_custkey AS instance_id,
  CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'P' THEN 'partial' ELSE 'error' END AS status, o_totalprice AS elapsed_seconds FROM orders),
latest AS (SELECT instance_id, seq, status, elapsed_seconds FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY (status = 'ok') DESC, seq DESC) AS n FROM attempts) WHERE n = 1)"""


def w13_latest_attempt(spark, sf_dir):
    return M.latest_attempt(_attempts(spark, sf_dir))


def a28_status_counts(spark, sf_dir):
    attempts = _attempts(spark, sf_dir)
    latest = M.status_counts(M.latest_attempt(attempts)).drop("elapsed_seconds")
    # Seconds are of all attempts, the counts of the latest ones: one row each.
    return latest.crossJoin(M.status_counts(attempts).select("elapsed_seconds"))


def j7_resume_pending(spark, sf_dir):
    issues = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("instance_id"), "c_mktsegment")
    return M.pending(issues, _attempts(spark, sf_dir))


def j9_failure_only(spark, sf_dir):
    attempts = _attempts(spark, sf_dir)
    return M.failure_rows(attempts.where("status = 'error'"), attempts.where("status <> 'error'"))


def r5_select_issues(spark, sf_dir):
    issues = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("instance_id"), "c_name")
    return M.select_issues(issues, None, 100, 250)


# --- range joins and gold: lines of orders as code lines ------------------------


def _entities(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").cast("string").alias("path"),
        F.when(F.col("l_returnflag") == "A", "class").when(F.col("l_returnflag") == "N", "function").otherwise("method").alias("kind"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"),
        F.col("l_linenumber").alias("start_line"),
        (F.col("l_linenumber") + F.floor(F.col("l_quantity") / 10)).cast("int").alias("end_line"),
    )


ENTITIES_SQL = """entities AS (SELECT CAST(l_orderkey AS VARCHAR) AS path, CASE l_returnflag WHEN 'A' THEN 'class' WHEN 'N' THEN 'function' ELSE 'method' END AS kind,
  'p' || CAST(l_partkey AS VARCHAR) AS name, l_linenumber AS start_line, CAST(l_linenumber + floor(l_quantity / 10) AS INT) AS end_line FROM lineitem)"""


def _lines(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") % 997).alias("instance_id"), F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").alias("line")
    ).distinct()


LINES_SQL = "lines AS (SELECT DISTINCT l_orderkey % 997 AS instance_id, CAST(l_orderkey AS VARCHAR) AS path, l_linenumber AS line FROM lineitem)"


def j5_line_in_entity(spark, sf_dir):
    found = M.lines_in_entities(_lines(spark, sf_dir), _entities(spark, sf_dir), 4)
    return found.select("path", "line", "kind", "name", "start_line", "end_line")


def e6_entity_for_line(spark, sf_dir):
    return M.innermost_entity(_lines(spark, sf_dir).select("path", "line").distinct(), _entities(spark, sf_dir))


def w16_gold_sets(spark, sf_dir):
    return M.gold_sets(_lines(spark, sf_dir), _entities(spark, sf_dir))


GOLD_SQL = f"""{ENTITIES_SQL}, {LINES_SQL},
held AS (SELECT l.instance_id, e.* FROM lines l JOIN entities e ON l.path = e.path AND l.line BETWEEN e.start_line AND e.end_line),
mods AS (SELECT DISTINCT instance_id, path, path || '::' || kind || ':' || name AS item FROM held WHERE kind = 'class'),
fl AS (SELECT DISTINCT instance_id, path FROM lines),
gold AS (SELECT instance_id, 'file' AS level, path AS item FROM fl UNION ALL SELECT instance_id, 'module', item FROM mods
  UNION ALL SELECT instance_id, 'module', path || '::module:__file__' FROM fl WHERE NOT EXISTS (SELECT 1 FROM mods m WHERE m.instance_id = fl.instance_id AND m.path = fl.path)
  UNION ALL SELECT DISTINCT instance_id, 'function', path || '::' || kind || ':' || name FROM held WHERE kind IN ('function', 'method'))"""


def w17_applicability(spark, sf_dir):
    return M.applicability(w16_gold_sets(spark, sf_dir), _lines(spark, sf_dir))


# --- fusion of channels: parts ranked by price, size and name --------------------


def _hits(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    base = part.select(F.col("p_brand").alias("instance_id"), F.col("p_name"), F.col("p_partkey").cast("string").alias("item"), "p_retailprice", "p_size")
    pairs = F.array(
        F.struct(F.lit("price").alias("channel"), (F.col("p_retailprice") / 10).alias("score")),
        F.struct(F.lit("size").alias("channel"), F.col("p_size").cast("double").alias("score")),
        F.struct(F.lit("name").alias("channel"), F.when(F.length("p_name") % 3 == 0, F.length("p_name").cast("double")).alias("score")),
    )
    return base.select("instance_id", "item", F.inline(pairs)).where("score is not null")


HITS_SQL = """hits AS (SELECT p_brand AS instance_id, CAST(p_partkey AS VARCHAR) AS item, 'price' AS channel, p_retailprice / 10 AS score FROM part
  UNION ALL SELECT p_brand, CAST(p_partkey AS VARCHAR), 'size', CAST(p_size AS DOUBLE) FROM part
  UNION ALL SELECT p_brand, CAST(p_partkey AS VARCHAR), 'name', CAST(length(p_name) AS DOUBLE) FROM part WHERE length(p_name) % 3 = 0),
lanes AS (SELECT *, row_number() OVER (PARTITION BY instance_id, channel ORDER BY score DESC, item) AS rank FROM hits)"""


def a21_channel_fusion(spark, sf_dir):
    return S.channel_fusion(_hits(spark, sf_dir))


def a22_seed_fusion(spark, sf_dir):
    return S.seed_fusion(_hits(spark, sf_dir), {"price": 1.8, "size": 1.2, "name": 0.7}, ("name",), 10)


def a20_merge_hits(spark, sf_dir):
    return S.merge_hits(_hits(spark, sf_dir))


def w9_beam_prune(spark, sf_dir):
    return S.beam_prune(_hits(spark, sf_dir), {"name": 4, "size": 6, "price": 6}, 24)


W9_SQL = f"""WITH {HITS_SQL}, tot AS (SELECT instance_id, item, round(sum(score), 6) AS score FROM hits GROUP BY ALL),
best AS (SELECT instance_id, item, n, CASE WHEN n <= 8 THEN 0 ELSE 4 END AS lane FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, item) AS n FROM tot)),
own AS (SELECT instance_id, item, rank AS n, CASE channel WHEN 'name' THEN 1 WHEN 'size' THEN 2 ELSE 3 END AS lane FROM lanes
  WHERE rank <= CASE channel WHEN 'name' THEN 4 ELSE 6 END),
u AS (SELECT instance_id, item, min((lane * 1000000) + n) AS place FROM (SELECT * FROM best UNION ALL SELECT * FROM own) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY place, item) AS k FROM u)
SELECT instance_id, item, score FROM k JOIN tot USING (instance_id, item) WHERE k <= 24"""


def w7_same_dir_neighbors(spark, sf_dir):
    corpus = files(spark, sf_dir)
    seeds = load(spark, sf_dir, "labels").join(corpus, "doc_id").where("toxic = 1").select((F.col("doc_id") % 50).alias("query_id"), "path")
    return S.same_dir_neighbors(seeds, corpus)


W7_SQL = f"""WITH {FILES_SQL}, d AS (SELECT path, regexp_replace(path, '/?[^/]*$', '') AS dir, doc_id FROM files),
few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY path) AS n FROM d) WHERE n <= 6),
seeds AS (SELECT d.doc_id % 50 AS query_id, path, dir FROM d JOIN labels USING (doc_id) WHERE toxic = 1),
near AS (SELECT DISTINCT s.query_id, f.path FROM (SELECT DISTINCT query_id, dir FROM seeds) s JOIN few f USING (dir)
  WHERE NOT EXISTS (SELECT 1 FROM seeds x WHERE x.query_id = s.query_id AND x.path = f.path))
SELECT query_id, path FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY path) AS n FROM near) WHERE n <= 40"""


def w5_path_probe(spark, sf_dir):
    corpus = files(spark, sf_dir)
    return S.path_probe(_probes(corpus), corpus, 20)


def _probes(corpus):
    """Whole paths, beginnings, ends, stems and loose words of every file whose id is divisible by 50."""
    asked = corpus.where("doc_id % 50 = 0").withColumn("parts", F.split("path", "/"))
    part = lambda i: F.get("parts", F.lit(i))
    forms = F.array(
        F.col("path"), F.concat(part(0), F.lit("/"), part(1)), F.concat(part(1), F.lit("/"), part(2)), part(2), F.regexp_replace("path", "txt$", "md"),
        F.concat(part(0), F.lit("/txt/"), part(1), F.lit(".none")), F.concat_ws(" ", part(0), F.lit("some text file")),
    )
    return asked.select(F.col("doc_id").alias("query_id"), F.explode(forms).alias("query"))


_TOKENS = r"""list_filter(flatten(list_transform(regexp_extract_all(probe, '[A-Za-z_][A-Za-z0-9_.$-]*'), lambda m: [regexp_replace(lower(m), '^[._$-]+|[._$-]+$', '', 'g')] || string_split(lower(regexp_replace(m, '([a-z0-9])([A-Z])', '\1 \2', 'g')), ' '))), lambda t: length(t) >= 3)"""
_EXT = r"\.[a-z0-9]{1,5}$"
W5_SQL = rf"""WITH {FILES_SQL}, a AS (SELECT doc_id AS query_id, path, split_part(path, '/', 1) AS p0, split_part(path, '/', 2) AS p1, split_part(path, '/', 3) AS p2 FROM files WHERE doc_id % 50 = 0),
q AS (SELECT query_id, lower(unnest([path, p0 || '/' || p1, p1 || '/' || p2, p2, regexp_replace(path, 'txt$', 'md'), p0 || '/txt/' || p1 || '.none', p0 || ' some text file'])) AS probe FROM a),
w AS (SELECT DISTINCT query_id, probe, {_TOKENS} AS t FROM q),
p AS (SELECT * FROM w WHERE contains(probe, '/') OR regexp_matches(probe, '\.[a-z0-9]{{1,5}}\b') OR (len(list_distinct(list_filter(t, lambda x: length(x) >= 4))) BETWEEN 3 AND 8 AND length(probe) <= 120)),
x AS (SELECT query_id, path, probe, t, lower(path) AS low, len(list_filter(t, lambda k: contains(lower(path), k))) AS n FROM p, files),
c AS (SELECT query_id, path, n, contains(probe, '/') AS slash, CASE WHEN low = probe THEN 0 WHEN starts_with(low, probe) THEN 1 WHEN contains(low, probe) THEN 2
  WHEN length(regexp_replace(probe, '{_EXT}', '')) >= 8 AND contains(regexp_replace(low, '{_EXT}', ''), regexp_replace(probe, '{_EXT}', '')) THEN 3
  WHEN len(t) > 0 AND n >= CASE WHEN contains(probe, '/') THEN least(4, greatest(2, len(t) - 1)) ELSE least(4, greatest(3, len(list_distinct(t)) - 1)) END THEN 4 END AS tier FROM x),
s AS (SELECT query_id, path, tier, CASE tier WHEN 0 THEN 96.0 WHEN 1 THEN 82.0 WHEN 2 THEN 62.0 WHEN 3 THEN 42.0 ELSE CASE WHEN slash THEN 12.0 + 4 * n ELSE 18.0 + 6 * n END END AS score FROM c WHERE tier IS NOT NULL),
b AS (SELECT query_id, path, max(score) AS score, arg_max(CASE tier WHEN 0 THEN 'exact' WHEN 1 THEN 'prefix' WHEN 2 THEN 'substring' WHEN 3 THEN 'stem' ELSE 'overlap' END, score * 10 - tier) AS reason FROM s GROUP BY ALL)
SELECT query_id, rank, path, score, reason FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM b) WHERE rank <= 20"""

QUERIES = {
    "flagship": (flagship, FLAGSHIP_SQL),
    "w2_search_files": (search_files, f"WITH {RANKED_SQL} SELECT query_id, rank, path, score FROM ranked"),
    "w5_path_probe": (w5_path_probe, W5_SQL),
    "w7_same_dir_neighbors": (w7_same_dir_neighbors, W7_SQL),
    "w9_beam_prune": (w9_beam_prune, W9_SQL),
    "w13_latest_attempt": (w13_latest_attempt, f"WITH {ATTEMPTS_SQL} SELECT * FROM latest"),
    "w14_rank_metrics": (w14_rank_metrics, f"WITH {_metrics_sql()} SELECT * FROM m"),
    "w16_gold_sets": (w16_gold_sets, f"WITH {GOLD_SQL} SELECT * FROM gold"),
    "w17_applicability": (
        w17_applicability,
        f"""WITH {GOLD_SQL} SELECT *, CASE WHEN n_file = 0 THEN 'no_gold' WHEN n_function = 0 THEN 'no_function_covers_the_change' ELSE 'applicable' END AS reason FROM (
  SELECT instance_id, count(*) FILTER (WHERE level = 'file') AS n_file, count(*) FILTER (WHERE level = 'module') AS n_module,
  count(*) FILTER (WHERE level = 'function') AS n_function FROM gold GROUP BY instance_id)""",
    ),
    "a20_merge_hits": (
        a20_merge_hits,
        f"WITH {HITS_SQL} SELECT instance_id, item, max(score) AS score, string_agg(channel, ',' ORDER BY channel) AS reasons FROM hits GROUP BY ALL",
    ),
    "a21_channel_fusion": (
        a21_channel_fusion,
        f"WITH {HITS_SQL} SELECT instance_id, item, round(sum(least(score, 120.0) * 0.16 + 18.0 / (rank + 2)), 6) AS score FROM lanes GROUP BY ALL",
    ),
    "a22_seed_fusion": (
        a22_seed_fusion,
        f"""WITH {HITS_SQL}, t AS (SELECT instance_id, item, round(sum(CASE channel WHEN 'price' THEN 1.8 WHEN 'size' THEN 1.2 ELSE 0.7 END / (12 + rank)
  + CASE WHEN channel = 'name' THEN 8.0 / rank ELSE 0 END), 6) AS score, bool_or(channel = 'name') AS anchor FROM lanes GROUP BY ALL)
SELECT * FROM (SELECT instance_id, row_number() OVER (PARTITION BY instance_id ORDER BY anchor DESC, score DESC, item) AS rank, item, score, anchor FROM t) WHERE rank <= 10""",
    ),
    "a25_metric_summary": (a25_metric_summary, A25_SQL),
    "a28_status_counts": (
        a28_status_counts,
        f"""WITH {ATTEMPTS_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'partial') AS partial,
  count(*) FILTER (WHERE status = 'error') AS failed, (SELECT round(sum(elapsed_seconds), 2) FROM attempts) AS elapsed_seconds FROM latest""",
    ),
    "j5_line_in_entity": (
        j5_line_in_entity,
        f"WITH {ENTITIES_SQL}, {LINES_SQL} SELECT l.path, line, kind, name, start_line, end_line FROM lines l JOIN entities e ON l.path = e.path AND line BETWEEN start_line AND end_line",
    ),
    "e6_entity_for_line": (
        e6_entity_for_line,
        f"""WITH {ENTITIES_SQL}, {LINES_SQL} SELECT path, line, kind, name FROM (SELECT l.path, line, kind, name,
  row_number() OVER (PARTITION BY l.path, line ORDER BY end_line - start_line, start_line, kind, name) AS n
  FROM (SELECT DISTINCT path, line FROM lines) l JOIN entities e ON l.path = e.path AND line BETWEEN start_line AND end_line) WHERE n = 1""",
    ),
    "j7_resume_pending": (
        j7_resume_pending,
        f"WITH {ATTEMPTS_SQL} SELECT c_custkey AS instance_id, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT instance_id FROM attempts WHERE status = 'ok')",
    ),
    "j9_failure_only": (
        j9_failure_only,
        f"WITH {ATTEMPTS_SQL} SELECT instance_id, max(seq) AS seq FROM attempts GROUP BY instance_id HAVING bool_and(status = 'error')",
    ),
    "r5_select_issues": (r5_select_issues, "SELECT c_custkey AS instance_id, c_name FROM customer ORDER BY c_custkey LIMIT 250 OFFSET 100"),
}

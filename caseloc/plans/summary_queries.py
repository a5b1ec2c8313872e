"""Queries of small tables over evidence, rankings, rounds, flows and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.session import shared_path
from ..operators import evidence as E
from ..operators import flows as L
from ..operators import search as S
from ..operators import summaries as Y
from ..sources import readers, writers
from .evidence_queries import P6_SQL, URLS_SQL
from .flow_queries import CHAIN_SQL, TERMS_SQL, _chain, _corpus, _starts, _steps
from .policy_queries import COMP_SQL, _components
from .search_queries import ATTEMPTS_SQL, HITS_SQL, RG_SQL, _attempts, _gold, _hits, _metrics_sql, _ranked, w14_rank_metrics
from .stream_queries import V, _stream
from .views import ISSUES_SQL, issues, load


def _links(spark, sf_dir):
    return E.extract_urls(issues(spark, sf_dir)).withColumn("is_image", E.is_image_url(F.col("url")))


_IMAGE = f"(contains(lower(url), '{E.IMAGE_HOST}') OR " + " OR ".join(f"ends_with(split_part(lower(url), '?', 1), '{x}')" for x in E.IMAGE_EXTENSIONS) + ")"


def a6_modality(spark, sf_dir):
    return Y.evidence_modality(issues(spark, sf_dir), _links(spark, sf_dir))


A6_SQL = f"""WITH {URLS_SQL}, s AS (SELECT instance_id, count(*) FILTER (WHERE NOT {_IMAGE}) AS urls, count(*) FILTER (WHERE {_IMAGE}) AS images FROM urls GROUP BY 1)
SELECT instance_id, urls, images, CASE WHEN urls > 0 AND images > 0 THEN 'image_and_url' WHEN images > 0 THEN 'image_only' WHEN urls > 0 THEN 'url_only' ELSE 'text_only' END AS modality
FROM (SELECT DISTINCT i.instance_id, coalesce(urls, 0) AS urls, coalesce(images, 0) AS images FROM issues i LEFT JOIN s USING (instance_id))"""


def a27_elapsed_totals(spark, sf_dir):
    attempts = _attempts(spark, sf_dir)
    return Y.elapsed_totals(attempts, attempts.where("status = 'error'"))


def w1_ordered_dedupe(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("instance_id"), F.col("event_id").alias("at"), F.lower("props").alias("item"))
    return E.ordered_distinct(rows, "item", 12)


def j6_gold_prediction(spark, sf_dir):
    return Y.gold_hits(_ranked(spark, sf_dir), _gold(spark, sf_dir))


def w15_set_metrics(spark, sf_dir):
    return Y.set_metrics(_ranked(spark, sf_dir), _gold(spark, sf_dir))


W15_SQL = f"""WITH {RG_SQL}, k AS (SELECT unnest([8, 10, 15, NULL]) AS cut), gc AS (SELECT instance_id, count(*) AS gold FROM g GROUP BY 1),
s AS (SELECT instance_id, cut, count(*) AS size, sum(hit) AS hits FROM h, k WHERE cut IS NULL OR rank <= cut GROUP BY ALL),
m AS (SELECT s.*, coalesce(gold, 0) AS gold FROM s LEFT JOIN gc USING (instance_id)),
z AS (SELECT *, CASE WHEN gold > 0 THEN hits / gold ELSE 0 END AS rc, CASE WHEN gold > 0 THEN hits / size ELSE 0 END AS pr FROM m)
SELECT instance_id, cut, CASE WHEN gold > 0 AND hits = gold THEN 1.0 ELSE 0.0 END AS sl, round(rc, 6) AS recall, round(pr, 6) AS precision, CASE WHEN rc + pr > 0 THEN round(2 * rc * pr / (rc + pr), 6) ELSE 0.0 END AS f1 FROM z"""


def _signatures(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("instance_id"), F.col("l_linenumber").alias("round_no"), F.concat(F.lit("i"), (F.col("l_quantity").cast("int") % 40).cast("string")).alias("item"))


def u4_evidence_gain(spark, sf_dir):
    return Y.evidence_gain(_signatures(spark, sf_dir))


U4_SQL = """WITH s AS (SELECT l_suppkey AS instance_id, l_linenumber AS round_no, list(DISTINCT 'i' || CAST(l_quantity AS INT) % 40) AS items FROM lineitem GROUP BY ALL),
p AS (SELECT *, coalesce(lag(items) OVER (PARTITION BY instance_id ORDER BY round_no), []) AS prev FROM s),
g AS (SELECT instance_id, round_no, len(list_filter(items, lambda x: NOT list_contains(prev, x))) AS gained FROM p),
i AS (SELECT *, count(*) FILTER (WHERE gained > 0) OVER (PARTITION BY instance_id ORDER BY round_no) AS island FROM g)
SELECT instance_id, round_no, gained, count(*) FILTER (WHERE gained = 0) OVER (PARTITION BY instance_id, island ORDER BY round_no) AS stale FROM i"""


def u6_overlap_tokens(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    return part.select("p_partkey", F.array_join(Y.overlap_tokens(F.col("p_name"), F.concat_ws(" ", "p_type", "p_brand", "p_name")), ",").alias("tokens"))


_W = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[a-z_][a-z0-9_]{{2,}}'))"
U6_SQL = f"""SELECT p_partkey, array_to_string(list_sort(list_intersect({_W('p_name')}, {_W("p_type || ' ' || p_brand || ' ' || p_name")})), ',') AS tokens FROM part"""


def j1_term_file_match(spark, sf_dir):
    terms, files = _corpus(spark, sf_dir)
    return S.file_counts(terms.select(F.col("term").alias("token")), files)


def j2_term_entity_match(spark, sf_dir):
    terms, files = _corpus(spark, sf_dir)
    named = _starts(files).select(F.concat_ws("::", "path", "kind", "name").alias("path"), F.col("name").alias("text")).distinct()
    found = S.file_counts(terms.select(F.col("term").alias("token")), named)
    return found.select("token", F.col("path").alias("entity"), "n")


def a16_flow_reasoning(spark, sf_dir):
    return Y.relation_summary(_chain(spark, sf_dir)[1])


A16_SQL = f"""WITH {CHAIN_SQL}, s AS (SELECT relation, count(*) AS edges, count(DISTINCT term) AS terms, round(sum(weight), 3) AS weight FROM ce GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY edges DESC, relation) AS rank FROM s"""


def a30_round_observation(spark, sf_dir):
    return Y.round_observation(_chain(spark, sf_dir)[1], ("relation", "symbol"))


def a18_target_path_support(spark, sf_dir):
    return Y.target_support(*_chain(spark, sf_dir))


A18_SQL = f"""WITH {CHAIN_SQL}, x AS (SELECT term, path, 'role:' || role AS reason FROM st WHERE role NOT IN ('reproduction_or_example', 'test_or_fixture', 'reference_api')
  UNION SELECT term, unnest([source, target]), 'edge:' || relation FROM ce) SELECT term, path, string_agg(reason, ',' ORDER BY reason) AS reasons FROM (SELECT DISTINCT * FROM x) GROUP BY ALL"""


def w23_role_order(spark, sf_dir):
    return Y.role_order(_steps(spark, sf_dir)[0])


W23_SQL = f"""WITH {CHAIN_SQL} SELECT * FROM (SELECT term, row_number() OVER (PARTITION BY term ORDER BY rank, path) AS rank, path, role FROM (SELECT DISTINCT term, path, role, rank FROM rk
  WHERE role NOT IN ('reproduction_or_example', 'test_or_fixture', 'reference_api'))) WHERE rank <= 16"""


def a24_merged_reviews(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    reviews = li.select(
        F.col("l_suppkey").alias("instance_id"), (F.col("l_partkey") % 40).alias("path"), F.col("l_orderkey").alias("round_no"), (F.col("l_returnflag") == "A").alias("mechanism_verified"),
        (F.col("l_linestatus") == "O").alias("grounded"), F.col("l_discount").cast("double").alias("confidence"), F.col("l_linenumber").alias("axes"),
    )
    return Y.merged_reviews(reviews)


A24_SQL = """SELECT instance_id, path, round_no, mechanism_verified, grounded, confidence, axes FROM (SELECT *, row_number() OVER (PARTITION BY instance_id, path
  ORDER BY mechanism_verified DESC, grounded DESC, confidence DESC, axes DESC, round_no) AS n FROM (SELECT l_suppkey AS instance_id, l_partkey % 40 AS path, l_orderkey AS round_no,
  l_returnflag = 'A' AS mechanism_verified, l_linestatus = 'O' AS grounded, CAST(l_discount AS DOUBLE) AS confidence, l_linenumber AS axes FROM lineitem)) WHERE n = 1"""


def a26_patch_set_summary(spark, sf_dir):
    comp = _components(spark, sf_dir)
    rows = comp.groupBy("instance_id").agg(F.countDistinct(F.when(F.col("score") > 24, F.col("path"))).alias("final_patch_count"), F.avg("score").alias("coverage"))
    return Y.patch_set_summary(rows)


A26_SQL = f"""WITH {COMP_SQL}, r AS (SELECT instance_id, count(DISTINCT CASE WHEN score > 24 THEN path END) AS k, avg(score) AS coverage FROM comp GROUP BY 1)
SELECT count(*) AS samples, round(avg(k), 6) AS mean_size, round(avg(coverage), 6) AS mean_coverage FROM r WHERE k > 0"""


def j22_seed_paths(spark, sf_dir):
    links = E.classify_url(E.extract_urls(issues(spark, sf_dir)))
    code = E.parse_github_url(links)
    return Y.seed_paths(code.select("instance_id", "role", F.coalesce("gh_path", F.lit("")).alias("path")))


J22_SQL = f"SELECT DISTINCT instance_id, gh_path AS path FROM ({P6_SQL}) WHERE github_kind = 'code' AND gh_path IS NOT NULL"


def j21_resolve_code_url(spark, sf_dir):
    own = issues(spark, sf_dir)
    code = E.parse_github_url(E.extract_urls(own)).where("github_kind = 'code'")
    links = code.select("instance_id", "url", F.col("gh_repo").alias("repo"), F.col("gh_path").alias("path"), F.col("gh_line").alias("line"))
    repos = own.select("instance_id", F.when(F.col("instance_id") % 2 == 0, F.lit("acme/tool")).otherwise(F.col("repo")).alias("repo"))
    files = repos.select("repo", F.lit("src/core/parser.py").alias("path"), F.lit(60).alias("lines")).distinct()
    return Y.resolve_code_urls(links, repos, files)


J21_SQL = f"""WITH x AS ({P6_SQL}), u AS (SELECT instance_id, pos, url FROM (WITH {URLS_SQL} SELECT * FROM urls)),
c AS (SELECT x.*, u.url, x.instance_id % 2 = 0 AS own FROM x JOIN u USING (instance_id, pos) WHERE github_kind = 'code'),
s AS (SELECT *, CASE WHEN coalesce(gh_path, '') = '' THEN 'missing_path' WHEN NOT own THEN 'repo_mismatch' WHEN gh_path <> 'src/core/parser.py' THEN 'file_not_found'
  WHEN gh_line IS NULL THEN 'resolved_file' WHEN gh_line > 60 THEN 'line_out_of_range' ELSE 'resolved_lines' END AS status FROM c)
SELECT instance_id, url, gh_path AS path, CASE WHEN status = 'resolved_lines' THEN greatest(1, gh_line - 40) ELSE 1 END AS first,
  CASE WHEN gh_path = 'src/core/parser.py' THEN least(60, CASE WHEN status = 'resolved_lines' THEN gh_line + 40 ELSE 60 END) END AS last, status FROM s"""


def x3_custom_fusion(spark, sf_dir):
    order = Window.partitionBy("instance_id", "channel").orderBy(F.desc("score"), "item")
    return Y.custom_fusion(_hits(spark, sf_dir).withColumn("rank", F.row_number().over(order)), {"price": "least(score, 150) * 0.2", "size": "10.0 / (rank + 1)"})


X3_SQL = f"""WITH {HITS_SQL} SELECT instance_id, item, round(sum(CASE channel WHEN 'price' THEN least(score, 150) * 0.2 WHEN 'size' THEN 10.0 / (rank + 1) ELSE 0 END), 6) AS score FROM lanes GROUP BY ALL"""


def r4_reevaluate(spark, sf_dir):
    rows = Y.reevaluated(w14_rank_metrics(spark, sf_dir))
    return rows.select("instance_id", "status", "acc@1", "mrr@15", "set_f1@10")


def a15_flow_coverage(spark, sf_dir):
    rows, _ = _steps(spark, sf_dir)
    number = F.regexp_extract("term", r"(\d+)$", 1)
    states = F.array(F.concat(F.lit("run"), number), F.concat(F.lit("call of "), F.col("term")), F.concat(F.lit("y"), number, F.lit(" value")), F.lit("deleted variable"))
    wanted = rows.select("term").distinct().select("term", F.explode(states).alias("state"))
    words = rows.select("term", F.explode(F.concat("defs", "uses")).alias("word"))
    return Y.flow_coverage(wanted, words)


A15_SQL = rf"""WITH {CHAIN_SQL}, t AS (SELECT DISTINCT term, regexp_extract(term, '(\d+)$', 1) AS k FROM st), w AS (SELECT term, unnest(['run' || k, 'call of ' || term, 'y' || k || ' value', 'deleted variable']) AS state FROM t),
words AS (SELECT DISTINCT term, unnest(uses || CASE WHEN def <> '' THEN [def] ELSE [] END) AS word FROM st),
p AS (SELECT term, state, unnest(list_filter(regexp_split_to_array(lower(state), '[^a-z0-9_]+'), lambda x: length(x) >= 3)) AS word FROM w),
h AS (SELECT term, state, bool_or(words.word IS NOT NULL) AS hit FROM p LEFT JOIN words USING (term, word) GROUP BY ALL),
a AS (SELECT w.term, w.state, coalesce(hit, FALSE) AS hit FROM w LEFT JOIN h USING (term, state))
SELECT term, coalesce(string_agg(state, ',' ORDER BY state) FILTER (WHERE hit), '') AS covered, coalesce(string_agg(state, ',' ORDER BY state) FILTER (WHERE NOT hit), '') AS missing, round(avg(CAST(hit AS DOUBLE)), 3) AS share FROM a GROUP BY term"""


def w24_obligation_check(spark, sf_dir):
    terms, files = _corpus(spark, sf_dir)
    found = L.term_files(terms, files, 40).withColumn("words", F.array(F.col("term"), F.lit("return"), F.lit("src"), F.lit("no"), F.lit("import")))
    return Y.obligation_check(found.withColumnRenamed("file_rank", "pos"), files)


_TIMES = "(length(hay) - length(replace(hay, w, ''))) // length(w)"
W24_SQL = f"""WITH {TERMS_SQL}, f AS (SELECT * FROM (SELECT term, path, row_number() OVER (PARTITION BY term ORDER BY path) AS k FROM hits) WHERE k <= 30),
x AS (SELECT term, path, lower(path) AS low, lower(path || chr(10) || text) AS hay, list_filter([term, 'return', 'src', 'no', 'import'], lambda w: length(w) >= 3) AS ws FROM f JOIN code USING (path))
SELECT term, path, round(CAST(list_sum(list_transform(ws, lambda w: CASE WHEN contains(low, w) THEN 5.0 ELSE 0.0 END + 0.8 * least(({_TIMES}), 6))) AS DOUBLE), 3) AS score, array_to_string(list_filter(ws, lambda w: contains(hay, w)), ',') AS matched FROM x"""


def s6_write_jsonl(spark, sf_dir):
    """Rows written as JSON lines, read back; the count comes from the write."""
    path = shared_path(spark, "jsonl")
    rows = load(spark, sf_dir, "benchmark").select("item_id", "text")
    n = writers.write_jsonl(rows, path)
    back = readers.read_results(spark, path, "item_id long, text string", strict=True)
    return back.select("item_id", F.md5("text").alias("text_md5"), F.lit(n).cast("long").alias("written"))


def t1_event_source(spark, sf_dir):
    return V.run_available(_stream(spark, sf_dir).select("event_id", "user_id", "event_type"), "source")


QUERIES = {
    "a6_modality": (a6_modality, A6_SQL),
    "a27_elapsed_totals": (a27_elapsed_totals, f"WITH {ATTEMPTS_SQL} SELECT round(CAST(sum(elapsed_seconds) + sum(CASE WHEN status = 'error' THEN elapsed_seconds ELSE 0 END) AS DOUBLE), 2) AS elapsed_seconds FROM attempts"),
    "w1_ordered_dedupe": (w1_ordered_dedupe, """SELECT * FROM (SELECT instance_id, row_number() OVER (PARTITION BY instance_id ORDER BY first_at) - 1 AS pos, item FROM (
  SELECT user_id AS instance_id, lower(props) AS item, min(event_id) AS first_at FROM events GROUP BY ALL)) WHERE pos < 12"""),
    "j6_gold_prediction": (j6_gold_prediction, f"WITH {RG_SQL} SELECT r.instance_id, rank, 'd/' || doc_id AS item, row_number() OVER (PARTITION BY r.instance_id ORDER BY rank) AS found FROM r JOIN g USING (instance_id, doc_id)"),
    "w15_set_metrics": (w15_set_metrics, W15_SQL),
    "u4_evidence_gain": (u4_evidence_gain, U4_SQL),
    "u6_overlap_tokens": (u6_overlap_tokens, U6_SQL),
    "j1_term_file_match": (j1_term_file_match, f"WITH {TERMS_SQL} SELECT term AS token, path, CAST((length(lower(text)) - length(replace(lower(text), term, ''))) // length(term) AS BIGINT) AS n FROM terms, code WHERE contains(lower(text), term)"),
    "j2_term_entity_match": (j2_term_entity_match, f"""WITH {TERMS_SQL} SELECT term AS token, entity, CAST((length(low) - length(replace(low, term, ''))) // length(term) AS BIGINT) AS n
  FROM terms, (SELECT DISTINCT path || '::' || kind || '::' || name AS entity, lower(name) AS low FROM entities) WHERE contains(low, term)"""),
    "a16_flow_reasoning": (a16_flow_reasoning, A16_SQL),
    "a30_round_observation": (a30_round_observation, f"WITH {CHAIN_SQL} SELECT term, 'relation' AS facet, relation AS value, count(*) AS n FROM ce GROUP BY ALL UNION ALL SELECT term, 'symbol', symbol, count(*) FROM ce GROUP BY ALL"),
    "a18_target_path_support": (a18_target_path_support, A18_SQL),
    "w23_role_order": (w23_role_order, W23_SQL),
    "a24_merged_reviews": (a24_merged_reviews, A24_SQL),
    "a26_patch_set_summary": (a26_patch_set_summary, A26_SQL),
    "j22_seed_paths": (j22_seed_paths, J22_SQL),
    "j21_resolve_code_url": (j21_resolve_code_url, J21_SQL),
    "x3_custom_fusion": (x3_custom_fusion, X3_SQL),
    "r4_reevaluate": (r4_reevaluate, f"""WITH {_metrics_sql()} SELECT instance_id, CASE WHEN gold_count > 0 THEN 'scored' ELSE 'skipped' END AS status, CASE WHEN gold_count > 0 THEN "acc@1" END AS "acc@1",
  CASE WHEN gold_count > 0 THEN "mrr@15" END AS "mrr@15", CASE WHEN gold_count > 0 THEN "set_f1@10" END AS "set_f1@10" FROM m"""),
    "a15_flow_coverage": (a15_flow_coverage, A15_SQL),
    "w24_obligation_check": (w24_obligation_check, W24_SQL),
    "s6_write_jsonl": (s6_write_jsonl, "SELECT item_id, md5(text) AS text_md5, count(*) OVER () AS written FROM benchmark"),
    "t1_event_source": (t1_event_source, "SELECT event_id, user_id, event_type FROM events"),
}

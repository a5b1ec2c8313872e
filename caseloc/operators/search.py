"""Search over files: a vocabulary index, scored retrieval, fusion of channels.

A query token matches anywhere inside a word, so there is no equality to join
on. Texts are cut once into maximal runs of the characters that tokens hold; a
token can't span two runs, so the counts in distinct runs, times how often each
run occurs in a file, add up to the count in the whole text. Tokens meet the
distinct runs by an equality on their first letters, verified by ``contains``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.session import dealt, kept
from ..functions.text import occurrences, tokens
from . import tops
from .terms import STOP_QUERY_TOKENS
from .tops import RUN, SENT

GRAM = 4
#: Beginnings of tokens that are looked up before substrings become rows, at most.
HEADS = 20_000
#: Lengths of tokens that are sent to all tasks, at most.
LENGTHS = 12
#: Values that a plan names one by one, at most: the driver holds each as an expression.
LISTED = 1_000
#: Files of a block that has one bound for each token.
BLOCK = 64


def postings(files: DataFrame, text: str = "text") -> DataFrame:
    """(path, run, n): how often each run occurs in each file."""
    runs = files.select("path", F.explode(F.regexp_extract_all(F.lower(text), F.lit(RUN), F.lit(0))).alias("run"))
    return runs.groupBy("path", "run").agg(F.count("*").alias("n"))


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, token, weight) of queries (query_id, query): weight is
    1 + min(1, log2(occurrences) / 4) over all texts of a query_id."""
    each = queries.select("query_id", F.explode(tokens("query")).alias("token"))
    counted = each.groupBy("query_id", "token").agg(F.count("*").alias("n"))
    return counted.select("query_id", "token", (1 + F.least(F.lit(1.0), F.log2("n") * 0.25)).alias("weight"))


def met_by_few(few: DataFrame, many: DataFrame, *on: str) -> DataFrame:
    """Their join: ``few`` is sent to all tasks if it has at most ``SENT`` rows, else
    both are shuffled. Spark judges by the size of files, which says little of rows
    that come from compressed lists of names, and would send those to the driver."""
    few = kept(few, "few")
    if few.limit(SENT + 1).count() <= SENT:
        return many.join(F.broadcast(few), list(on))
    return many.hint("merge").join(few, list(on))


def token_runs(wanted: DataFrame, runs: DataFrame) -> DataFrame:
    """(token, run, k): distinct runs that hold a token, k times without overlap.

    wanted (token) and runs (run) are distinct values. A run is indexed by its
    substrings of 2 to GRAM letters, of which a token's first letters are one.
    """
    size = F.least(F.length("token"), F.lit(GRAM))
    heads = wanted.withColumn("gram", F.substring(F.col("token"), F.lit(1), size))
    starts = F.sequence(F.lit(1), F.greatest(F.length("run") - 1, F.lit(1)))
    grams = F.flatten(F.transform(starts, lambda i: F.array(*[F.substring(F.col("run"), i, F.lit(g)) for g in range(2, GRAM + 1)])))
    # If they are few, only substrings that begin a token are made into rows.
    known = [r.gram for r in heads.select("gram").distinct().limit(HEADS + 1).collect()]
    if len(known) <= LISTED:
        grams = F.filter(grams, lambda g: g.isin(known))
    elif len(starts := sorted({g[:2] for g in known})) <= LISTED and len(known) <= HEADS:
        grams = F.filter(grams, lambda g: F.substring(g, 1, 2).isin(starts))
    indexed = runs.select("run", F.explode(F.array_distinct(grams)).alias("gram"))
    return (
        met_by_few(heads, indexed, "gram")
        .where(F.col("run").contains(F.col("token")))
        .select("token", "run", occurrences(F.col("run"), F.col("token")).alias("k"))
    )


def token_counts(wanted: DataFrame, posted: DataFrame) -> DataFrame:
    """(token, path, n): occurrences of each token in each file that has it."""
    found = token_runs(wanted, posted.select("run").distinct())
    return met_by_few(found, posted, "run").groupBy("token", "path").agg(F.sum(F.col("k") * F.col("n")).alias("n"))


def file_counts(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(token, path, n): ``token_counts`` over the postings of files. Where tokens
    are at most ``SENT``, of few lengths, they are sent to the files: the pieces of
    a run that begin like a token meet them there, and only matches are shuffled."""
    wanted = wanted.select("token").distinct()
    sizes = [r[0] for r in wanted.select(F.length("token")).distinct().limit(LENGTHS + 1).collect()]
    heads = [r[0] for r in wanted.select(F.substring("token", 1, 2)).distinct().limit(HEADS + 1).collect()]
    if len(sizes) > LENGTHS or min(sizes, default=2) < 2 or len(heads) > HEADS or wanted.count() > SENT:
        return token_counts(wanted, postings(files))
    begins = _begins(heads)
    if begins is None:
        return token_counts(wanted.where("false"), postings(files))
    # Runs without the beginning of a token are left out before any is cut.
    runs = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(RUN), F.lit(0)), lambda r: r.rlike(begins))
    cut = F.regexp_extract_all("run", F.lit(f"(?=((?:{begins})[a-z0-9_.$-]{{0,{max(sizes) - 2}}}))"), F.lit(1))
    pieces = F.flatten(F.transform(cut, lambda c: F.array(*[F.substring(c, F.lit(1), F.lit(k)) for k in sizes])))
    each = files.select("path", F.explode(runs).alias("run"))
    met = each.select("path", "run", F.explode(F.array_distinct(pieces)).alias("token")).join(F.broadcast(wanted), "token")
    return met.groupBy("token", "path").agg(F.sum(occurrences(F.col("run"), F.col("token"))).alias("n"))


def _begins(heads: list[str]) -> str | None:
    """A pattern of two letters that are one of ``heads``; none if no run holds one."""
    after: dict[str, set[str]] = {}
    for h in heads:
        if re.fullmatch(RUN, h):
            after.setdefault(h[0], set()).add(h[1])
    return "|".join(f"{re.escape(a)}[{''.join(re.escape(b) for b in sorted(bs))}]" for a, bs in sorted(after.items())) or None


def text_counts(queries: DataFrame, files: DataFrame) -> DataFrame:
    """(token, path, n) for all tokens of the queries: the part of a search that
    can be shared, written once for several uses."""
    return kept(token_counts(query_tokens(queries).select("token").distinct(), postings(files)), "token-counts")


def size_blocks(files: DataFrame) -> DataFrame:
    """(path, block): files in blocks of about ``BLOCK``, the longest together, so
    that what a block may score at most differs as much as it can."""
    sized = files.select("path", F.length("text").alias("size")).orderBy(F.desc("size"), "path").withColumn("id", F.monotonically_increasing_id())
    return kept(sized.select("path", F.floor(F.col("id") / BLOCK).alias("block")), "blocks")


def top_scores(wanted: DataFrame, hits: DataFrame, extra: DataFrame, blocks: DataFrame, limit: int) -> DataFrame:
    """(query_id, rank, path, score): the best ``limit`` files of each query by the
    sum of weight (wanted: query_id, token, weight) x times (hits: token, path,
    times) and of extra (query_id, path, score); ties by path.

    A token's best times in a block of files bound what any file of the block can
    score. The two blocks with the highest bound are scored first; the ``limit``-th
    score there is a threshold, and only blocks whose bound reaches it are scored
    after them. All others can't hold a file of the answer.
    """
    placed = kept(hits.groupBy("token", "path").agg(F.sum("times").alias("times")).join(blocks, "path"), "hits")
    more = kept(extra.groupBy("query_id", "path").agg(F.sum("score").alias("score")).join(blocks, "path"), "extra")
    most = placed.groupBy("token", "block").agg(F.max("times").alias("most"))
    bound = wanted.join(most, "token").select("query_id", "block", (F.col("weight") * F.col("most")).alias("bound"))
    bound = bound.unionByName(more.groupBy("query_id", "block").agg(F.max("score").alias("bound")))
    bounds = kept(bound.groupBy("query_id", "block").agg(F.sum("bound").alias("bound")), "bounds")

    def scored(chosen: DataFrame) -> DataFrame:
        asked = chosen.join(wanted, "query_id").join(placed, ["token", "block"])
        rows = asked.select("query_id", "path", (F.col("weight") * F.col("times")).alias("score"))
        rows = rows.unionByName(more.join(chosen, ["query_id", "block"], "left_semi").select("query_id", "path", "score"))
        return rows.groupBy("query_id", "path").agg(F.round(F.sum("score"), 6).alias("score"))

    highest = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path")
    placed_bounds = bounds.withColumn("n", F.row_number().over(highest))
    first = kept(scored(placed_bounds.where("n <= 2").select("query_id", "block")), "first-scores")
    least = first.withColumn("n", F.row_number().over(order)).where(F.col("n") == limit).select("query_id", F.col("score").alias("least"))
    others = placed_bounds.where("n > 2").join(least, "query_id", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - 1e-5)
    total = first.unionByName(scored(others.select("query_id", "block")))
    return total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "rank", "path", "score")


def search_files(queries: DataFrame, files: DataFrame, limit: int = 20, counts: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, path, score): the best files for each query_id.

    8 x weight for a token in the path, weight x min(12, count) for one in the
    text, 5 for each query text of over 4 letters that the file has whole. Ties
    go to the smaller path. Queries that can be sent to all tasks are scored
    beside the texts, others by joins.
    """
    wanted = kept(query_tokens(queries), "query-tokens")
    if counts is None and (sent := tops.asked(queries, wanted)):
        found = tops.file_matches(sent, queries, files, limit, False)
        return tops.ranked(found, limit, "path").select("query_id", "rank", "path", "score")
    distinct = wanted.select("token").distinct()
    counts = text_counts(queries, files) if counts is None else counts
    in_text = counts.select("token", "path", F.least("n", F.lit(12)).cast("double").alias("times"))
    in_path = token_counts(distinct, postings(files.select("path", F.col("path").alias("text")))).select(
        "token", "path", F.lit(8.0).alias("times")
    )
    phrases = phrase_hits(queries, files, counts).select("query_id", "path", F.lit(5.0).alias("score"))
    return top_scores(wanted, in_text.unionByName(in_path), phrases, size_blocks(files), limit)


def search_and_hold(queries: DataFrame, files: DataFrame, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """``search_files``, and (query_id, path) of files that hold a query text whole;
    what both read is made once."""
    if sent := tops.asked(queries, query_tokens(queries)):
        found = kept(tops.file_matches(sent, queries, files, limit, True), "matches")
        best = tops.ranked(found.where("score is not null"), limit, "path").select("query_id", "rank", "path", "score")
        return best, found.where("score is null").select("query_id", "path")
    counts = text_counts(queries, files)
    return search_files(queries, files, limit, counts), phrase_hits(queries, files, counts).select("query_id", "path")


def phrase_hits(queries: DataFrame, files: DataFrame, counts: DataFrame, rarest: int = 3) -> DataFrame:
    """(query_id, phrase, path): files that hold a whole query text. Only files
    with the ``rarest`` tokens of a text (counts: token, path) are opened."""
    phrases = queries.select("query_id", F.trim(F.lower("query")).alias("phrase")).where(F.length("phrase") > 4)
    each = phrases.select("phrase", F.explode(F.array_distinct(tokens("phrase"))).alias("token")).distinct()
    held = counts.groupBy("token").agg(F.count("*").alias("files"))
    order = Window.partitionBy("phrase").orderBy(F.coalesce("files", F.lit(0)), "token")
    few = each.join(held, "token", "left").withColumn("n", F.row_number().over(order)).where(F.col("n") <= rarest).select("phrase", "token")
    need = few.groupBy("phrase").agg(F.count("*").alias("need"))
    have = few.join(counts.select("token", "path"), "token").groupBy("phrase", "path").agg(F.count("*").alias("have"))
    likely = have.join(need, "phrase").where("have = need").select("phrase", "path")
    found = likely.join(files.select("path", "text"), "path").where(F.lower("text").contains(F.col("phrase"))).select("phrase", "path")
    return phrases.join(found, "phrase").select("query_id", "phrase", "path")


def scoped_terms(queries: DataFrame, most: int = 48) -> DataFrame:
    """(query_id, terms): the commonest tokens of three letters or more of all
    texts of a query_id, without words that say nothing; ties by the alphabet."""
    each = queries.select("query_id", F.explode(tokens("query")).alias("token"))
    good = each.where((F.length("token") >= 3) & ~F.col("token").isin(*STOP_QUERY_TOKENS) & ~F.col("token").rlike(r"^\d+$"))
    counted = good.groupBy("query_id", "token").agg(F.count("*").alias("n"))
    order = Window.partitionBy("query_id").orderBy(F.desc("n"), "token")
    few = counted.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    return few.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "token"))), lambda x: x["token"]).alias("terms"))


def _term_sum(terms: Column, score) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + score(t))


def _of_pools(rows: DataFrame, pool: DataFrame) -> DataFrame:
    """Rows whose path is in some pool: others are left out before any is shuffled."""
    return rows.join(pool.select("path").distinct(), "path", "left_semi")


def scoped_search_files(queries: DataFrame, pool: DataFrame, files: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, rank, path, score) over the files of each query's pool (query_id,
    path) alone: 8 for a term in the path, min(10, count) for one in the first
    120,000 letters, 4 for each query text of over 4 letters there. Queries without
    a known file in their pool search all files."""
    # Written in lower case: an expression inside the sums below would be computed anew for each term.
    low, text = F.lower("path"), F.lower(F.substring("text", 1, 120_000))
    held = kept(dealt(_of_pools(files, pool).select("path", low.alias("low"), text.alias("body")), "path"), "held-files")
    asked = kept(pool.select("query_id", "path").distinct().join(scoped_terms(queries), "query_id"), "pool-terms")
    rows = held.join(asked, "path")
    phrases = queries.select("query_id", F.trim(F.lower("query")).alias("p")).where(F.length("p") > 4).groupBy("query_id").agg(F.collect_list("p").alias("phrases"))
    one = lambda t: F.when(F.contains(F.col("low"), t), 8.0).otherwise(0.0) + F.least(occurrences(F.col("body"), t), F.lit(10))
    whole = 4.0 * F.size(F.filter(F.coalesce("phrases", F.array().cast("array<string>")), lambda p: F.contains(F.col("body"), p)))
    scored = rows.join(phrases, "query_id", "left").select("query_id", "path", (_term_sum(F.col("terms"), one) + whole).alias("score")).where("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path")
    own = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "rank", "path", "score")
    known = pool.select("query_id", "path").join(held.select("path"), "path", "left_semi")
    open_ = queries.join(known.select("query_id").distinct(), "query_id", "left_anti")
    return own.unionByName(search_files(open_, files, limit))


def scoped_search_entities(queries: DataFrame, pool: DataFrame, entities: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, rank, path, name, score) over the entities (path, name, text) of
    each query's pool: 10 for a term in the name, 4 in the path, min(8, count) in
    the first 30,000 letters. Queries without a pool search all entities."""
    low, called, body = F.lower("path"), F.lower("name"), F.lower(F.substring("text", 1, 30_000))
    own = _of_pools(entities, pool).select("path", "name", "text").distinct().select("path", "name", low.alias("low"), called.alias("called"), body.alias("body"))
    held = kept(dealt(own, "path"), "held-entities")
    rows = held.join(kept(pool.select("query_id", "path").distinct().join(scoped_terms(queries), "query_id"), "pool-terms"), "path")
    hit = lambda c, t, v: F.when(F.contains(F.col(c), t), v).otherwise(0.0)
    one = lambda t: hit("called", t, 10.0) + hit("low", t, 4.0) + F.least(occurrences(F.col("body"), t), F.lit(8))
    scored = rows.select("query_id", "path", "name", _term_sum(F.col("terms"), one).alias("score")).where("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path", "name")
    own = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "rank", "path", "name", "score")
    open_ = queries.join(pool.select("query_id").distinct(), "query_id", "left_anti")
    return own.unionByName(search_entities(open_, entities, limit))


def search_entities(queries: DataFrame, entities: DataFrame, limit: int = 30) -> DataFrame:
    """(query_id, rank, path, name, score) over entities (path, name, text).

    30 for an exact distinctive name, 10 x weight for a token in the name,
    4 x weight for one in the path (24 at most), weight x min(8, count) for one
    in path, name and text together (36 at most). Ties by path and name. Queries
    with the same texts are searched for once, beside the entities if they can be sent
    to all tasks.
    """
    texts = queries.groupBy("query_id").agg(F.sort_array(F.collect_list("query")).alias("texts"))
    texts = kept(texts.select("query_id", F.xxhash64("texts").alias("same"), "texts"), "query-texts")
    once = texts.groupBy("same", "texts").agg(F.min("query_id").alias("first"))
    found = _search_entities(once.select(F.col("first").alias("query_id"), F.explode("texts").alias("query")), entities, limit)
    each = texts.join(once, ["same", "texts"]).select("query_id", "first")
    return each.join(found.withColumnRenamed("query_id", "first"), "first").select("query_id", "rank", "path", "name", "score")


def _search_entities(queries: DataFrame, entities: DataFrame, limit: int) -> DataFrame:
    wanted = kept(query_tokens(queries), "query-tokens")
    if sent := tops.asked(queries, wanted):
        exact = exact_names(queries).limit(SENT + 1).collect()
        if len(exact) <= SENT:
            found = tops.entity_matches(sent, [tuple(r) for r in exact], queries, entities, limit)
            return tops.ranked(found, limit, "path", "name").select("query_id", "rank", "path", "name", "score")
    distinct = wanted.select("token").distinct()
    keyed = entities.select(F.xxhash64("path", "name", "text").cast("string").alias("key"), "path", "name", "text").dropDuplicates(["key"])

    def counted(text: Column, cap: int, factor: float) -> DataFrame:
        found = token_counts(distinct, postings(keyed.select(F.col("key").alias("path"), text.alias("text"))))
        hits = wanted.join(found, "token").select("query_id", F.col("path").alias("key"), (F.col("weight") * F.least("n", F.lit(cap)) * factor).alias("s"))
        return hits.groupBy("query_id", "key").agg(F.sum("s").alias("s"))

    names = counted(F.col("name"), 1, 10.0)
    paths = counted(F.col("path"), 1, 4.0).withColumn("s", F.least("s", F.lit(24.0)))
    bodies = counted(F.concat_ws(" ", "path", "name", "text"), 8, 1.0).withColumn("s", F.least("s", F.lit(36.0)))
    exact = exact_names(queries).join(keyed.select("key", F.lower("name").alias("name")), "name").select("query_id", "key", F.lit(30.0).alias("s"))
    total = names.unionByName(paths).unionByName(bodies).unionByName(exact).groupBy("query_id", "key").agg(F.round(F.sum("s"), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path", "name")
    ranked = total.join(keyed.select("key", "path", "name"), "key").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= limit).select("query_id", "rank", "path", "name", "score")


def exact_names(queries: DataFrame) -> DataFrame:
    """(query_id, name): identifiers distinctive enough for an exact match: six
    letters, an inner capital, an underscore or dollar, or a call."""
    each = queries.select("query_id", "query", F.explode(F.regexp_extract_all("query", F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0))).alias("m"))
    m = F.col("m")
    good = (F.length(m) >= 6) | m.rlike("^.[^A-Z]*[A-Z]") | m.contains("_") | m.contains("$") | F.col("query").contains(F.concat(m, F.lit("(")))
    return each.where(good).select("query_id", F.lower("m").alias("name")).distinct()


def path_probe(queries: DataFrame, files: DataFrame, limit: int = 80, head: int = 12) -> DataFrame:
    """(query_id, rank, path, score, reason) for path-like queries; the best query
    of each path counts.

    A query is 96 for the whole path, 82 for its beginning, 62 inside it, 42 if it
    is inside without extensions (8 letters or more), else 12 + 4n (18 + 6n
    without a slash) if n of its tokens, of three letters or more, are in the
    path and n is all but one of them, up to four. Paths and queries meet at a
    piece of at most ``head`` letters that begins the query; tokens as in
    ``token_runs``.

    A query is looked for once, whoever asks it, and gives its best ``limit`` paths.
    Queries with the same tokens, of those that paths hold, share one list of paths
    by n; each takes as many as it can need, and what it holds itself is left out.
    """
    text = F.lower(F.regexp_replace(F.regexp_replace(F.trim("query"), "^['\"`]+|['\"`]+$", ""), r"^(?:\./)+", ""))
    words = F.array_distinct(F.filter(tokens("probe"), lambda t: F.length(t) >= 4))
    like = F.col("probe").contains("/") | F.col("probe").rlike(r"\.[a-z0-9]{1,5}\b") | (F.size(words).between(3, 8) & (F.length("probe") <= 120))
    probes = kept(queries.select("query_id", text.alias("probe")).where("probe <> ''").where(like).distinct(), "probes")
    low = files.select("path", F.lower("path").alias("low")).distinct()
    bare = lambda c: F.regexp_replace(c, r"\.[a-z0-9]{1,5}$", "")

    def inside(probe: Column, hay: Column, least: int) -> DataFrame:
        """(probe, path) where the one is in the other."""
        wanted = probes.select("probe", probe.alias("part")).distinct().where(F.length("part") >= least).withColumn("piece", F.substring("part", 1, head))
        sizes = sorted(r[0] for r in wanted.select(F.length("piece")).distinct().collect())
        known = [r.piece for r in wanted.select("piece").distinct().limit(LISTED + 1).collect()]
        starts = F.sequence(F.lit(1), F.greatest(F.length("hay"), F.lit(1)))
        pieces = F.flatten(F.transform(starts, lambda i: F.array(*[F.substring(F.col("hay"), i, F.lit(k)) for k in sizes]))) if sizes else F.array().cast("array<string>")
        if len(known) <= LISTED:
            pieces = F.filter(pieces, lambda x: x.isin(known)) if known else pieces
        # Pieces that begin no query are not shuffled if the queries can be sent to the paths.
        wanted = F.broadcast(wanted) if wanted.limit(SENT + 1).count() <= SENT else wanted
        cut = low.select("path", "low", hay.alias("hay"))
        return cut.select("*", F.explode(F.array_distinct(pieces)).alias("piece")).join(wanted, "piece").where(F.col("hay").contains(F.col("part"))).select("probe", "part", "path", "low")

    probe, path = F.col("probe"), F.col("low")
    whole = inside(probe, path, 1).select("probe", "path", F.when(path == probe, 0).when(path.startswith(probe), 1).otherwise(2).alias("tier"))
    stems = inside(bare(probe), bare(path), 8).select("probe", "path", F.lit(3).alias("tier"))
    held = kept(whole.unionByName(stems).groupBy("probe", "path").agg(F.min("tier").alias("tier")), "probe-holders")
    shared = _shared_tokens(probes.select("probe").distinct(), low, held, limit)
    first = held.select("probe", "path", "tier", F.lit(0).alias("n")).unionByName(shared.select("probe", "path", F.lit(4).alias("tier"), F.col("n").cast("int").alias("n")))
    score = (
        F.when(F.col("tier") == 4, F.when(probe.contains("/"), 12.0 + 4.0 * F.col("n")).otherwise(18.0 + 6.0 * F.col("n")))
        .otherwise(F.get(F.array(*map(F.lit, (96.0, 82.0, 62.0, 42.0))), F.col("tier")))
    )
    label = F.get(F.array(*map(F.lit, ("exact", "prefix", "substring", "stem", "overlap"))), F.col("tier"))
    # A path that is not among the best of a query has ``limit`` better ones, whatever else is asked.
    by_probe = Window.partitionBy("probe").orderBy(F.desc("score"), "path")
    few = first.withColumn("score", score).withColumn("k", F.row_number().over(by_probe)).where(F.col("k") <= limit)
    rows = probes.join(few, "probe").withColumn("reason", label)
    best = rows.groupBy("query_id", "path").agg(F.max_by("reason", F.struct("score", -F.col("tier"))).alias("reason"), F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "rank", "path", "score", "reason")


def _shared_tokens(probes: DataFrame, low: DataFrame, held: DataFrame, limit: int) -> DataFrame:
    """(probe, path, n): the best ``limit`` paths (path, low) of each probe (probe) by
    shared tokens, but those that hold it (held: probe, path); ties by path."""
    probe = F.col("probe")
    each = probes.select("probe", F.explode(F.filter(tokens("probe"), lambda t: F.length(t) >= 3)).alias("token")).groupBy("probe", "token").agg(F.count("*").alias("m"))
    found = kept(token_counts(each.select("token").distinct(), postings(low.select("path", F.col("low").alias("text")))).select("token", "path"), "path-tokens")
    need = F.when(probe.contains("/"), F.least(F.lit(4), F.greatest(F.lit(2), F.sum("m") - 1))).otherwise(F.least(F.lit(4), F.greatest(F.lit(3), F.count("*") - 1)))
    met = F.sort_array(F.collect_list(F.when(F.col("met"), F.struct("token", "m"))))
    asked = each.join(found.select("token", F.lit(True).alias("met")).distinct(), "token", "left").groupBy("probe").agg(need.alias("need"), met.alias("tokens"))
    key = F.concat_ws(" ", F.col("need").cast("string"), F.transform("tokens", lambda x: F.concat_ws(" ", x["token"], x["m"].cast("string"))))
    asked = kept(asked.where(F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x["m"]) >= F.col("need")).withColumn("key", key), "probe-tokens")
    once = asked.select("key", "need", "tokens").distinct().select("key", "need", F.inline("tokens"))
    sums = once.join(found, "token").groupBy("key", "need", "path").agg(F.sum("m").alias("n")).where(F.col("n") >= F.col("need"))
    listed = kept(sums.select("key", "path", "n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "path")).alias("k")), "probe-lists")
    long = listed.groupBy("key").agg(F.max("k").alias("long"))
    own = held.groupBy("probe").agg(F.count("*").cast("int").alias("own"))
    places = asked.select("probe", "key").join(own, "probe", "left").join(long, "key")
    places = places.select("probe", "key", F.explode(F.sequence(F.lit(1), F.least(F.col("long"), limit + F.coalesce("own", F.lit(0))))).alias("k"))
    return places.join(listed, ["key", "k"]).join(held.select("probe", "path"), ["probe", "path"], "left_anti").select("probe", "path", "n")


def same_dir_neighbors(seeds: DataFrame, files: DataFrame, per_dir: int = 6, cap: int = 40) -> DataFrame:
    """(query_id, path): files beside the seeds (query_id, path): the first of
    each directory in order, taken before the seeds themselves are removed."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    first = Window.partitionBy("dir").orderBy("path")
    few = files.select("path", folder.alias("dir")).withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_dir)
    near = seeds.select("query_id", folder.alias("dir")).distinct().join(few.select("dir", "path"), "dir")
    others = near.join(seeds.select("query_id", "path"), ["query_id", "path"], "left_anti").select("query_id", "path").distinct()
    order = Window.partitionBy("query_id").orderBy("path")
    return others.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).drop("n")


def exact_symbol_lane(symbols: DataFrame, entities: DataFrame, per_symbol: int | None = None) -> DataFrame:
    """(query_id, symbol, path, name): entities whose name is the symbol; all of
    them, or the first ``per_symbol`` by path and name."""
    named = entities.select("path", "name", F.lower("name").alias("symbol"))
    if per_symbol is not None:
        # A symbol's first entities are the same for every query, so they are picked before queries meet them.
        order = Window.partitionBy("symbol").orderBy("path", "name")
        named = named.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_symbol)
    else:
        # Few names may have most entities, and each meets all queries of its name.
        named = dealt(named, "path")
    asked = symbols.select("query_id", F.lower("symbol").alias("symbol")).distinct()
    return asked.join(named, "symbol").select("query_id", "symbol", "path", "name")


# --- fusion -------------------------------------------------------------------


def channel_fusion(hits: DataFrame) -> DataFrame:
    """(instance_id, item, score) of hits (instance_id, channel, item, score): the
    sum over channels of min(score, 120) x 0.16 + 18 / (rank + 2), rank from 1 by
    score and item in each channel."""
    order = Window.partitionBy("instance_id", "channel").orderBy(F.desc("score"), "item")
    ranked = hits.withColumn("rank", F.row_number().over(order))
    part = F.least("score", F.lit(120.0)) * 0.16 + 18.0 / (F.col("rank") + 2)
    return ranked.groupBy("instance_id", "item").agg(F.round(F.sum(part), 6).alias("score"))


def seed_fusion(hits: DataFrame, weights: dict[str, float], anchors: tuple[str, ...], keep: int = 10) -> DataFrame:
    """(instance_id, rank, item, score): weighted reciprocal ranks w / (12 + rank),
    and 8 / rank in anchor channels; anchored items come first."""
    order = Window.partitionBy("instance_id", "channel").orderBy(F.desc("score"), "item")
    ranked = hits.withColumn("rank", F.row_number().over(order))
    w = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("channel"))
    anchored = F.col("channel").isin(*anchors)
    part = F.coalesce(w, F.lit(1.0)) / (12 + F.col("rank")) + F.when(anchored, 8.0 / F.col("rank")).otherwise(0.0)
    total = ranked.groupBy("instance_id", "item").agg(F.round(F.sum(part), 6).alias("score"), F.max(anchored).alias("anchor"))
    final = Window.partitionBy("instance_id").orderBy(F.desc("anchor"), F.desc("score"), "item")
    return total.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= keep).select("instance_id", "rank", "item", "score", "anchor")


def merge_hits(hits: DataFrame, reasons: int = 10) -> DataFrame:
    """(instance_id, item, score, reasons): the best score of an item and its
    channels in order, at most ``reasons``."""
    merged = hits.groupBy("instance_id", "item").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("channel")).alias("all"))
    return merged.select("instance_id", "item", "score", F.array_join(F.slice("all", 1, reasons), ",").alias("reasons"))


def beam_prune(hits: DataFrame, lanes: dict[str, int], budget: int) -> DataFrame:
    """(instance_id, item, score): the best items overall, then those of each
    lane up to its own limit, until the budget is full; best score first.

    A third of the budget goes to the overall beam; later lanes only fill what
    is left, so an item that leads in one channel alone is not lost.
    """
    total = hits.groupBy("instance_id", "item").agg(F.round(F.sum("score"), 6).alias("score"))
    overall = Window.partitionBy("instance_id").orderBy(F.desc("score"), "item")
    best = total.withColumn("n", F.row_number().over(overall)).withColumn(
        "lane", F.when(F.col("n") <= max(8, budget // 3), F.lit(0)).otherwise(F.lit(len(lanes) + 1))
    )
    by_lane = Window.partitionBy("instance_id", "channel").orderBy(F.desc("score"), "item")
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in lanes.items() for x in kv]), F.col("channel"))
    number = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(lanes) for x in (k, i + 1)]), F.col("channel"))
    own = hits.withColumn("n", F.row_number().over(by_lane)).where(F.col("n") <= limit).select("instance_id", "item", "n", number.alias("lane"))
    first = best.select("instance_id", "item", "n", "lane").unionByName(own).groupBy("instance_id", "item").agg(F.min(F.struct("lane", "n")).alias("place"))
    fill = Window.partitionBy("instance_id").orderBy("place", "item")
    full = first.withColumn("k", F.row_number().over(fill)).where(F.col("k") <= budget)
    return full.join(total, ["instance_id", "item"]).select("instance_id", "item", "score")


def scoped(files: DataFrame, scope: DataFrame) -> DataFrame:
    """Files whose path is in the scope (path)."""
    return files.join(scope.select("path").distinct(), "path", "left_semi")


def candidate_pool(groups: dict[str, DataFrame], cap: int = 160) -> DataFrame:
    """(instance_id, pos, item): ordered union of groups (instance_id, pos, item)."""
    rows = None
    for i, g in enumerate(groups.values()):
        part = g.select("instance_id", F.struct(F.lit(i).alias("g"), F.col("pos").cast("long").alias("p")).alias("place"), "item")
        rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy("instance_id", "item").agg(F.min("place").alias("place"))
    order = Window.partitionBy("instance_id").orderBy("place", "item")
    return first.withColumn("pos", F.row_number().over(order) - 1).where(F.col("pos") < cap).select("instance_id", "pos", "item")


def read_context(lines: DataFrame, terms: tuple[str, ...], snippets: int = 3, before: int = 3, after: int = 5) -> DataFrame:
    """(path, line_no, first, last, snippet): the first matching lines of each file
    with the lines around them, numbered. terms: in lower case, a parameter of the
    search. A line joins the snippets that it is near by its distance alone."""
    low = F.lower("line")
    hit = lines.where(F.exists(F.array(*map(F.lit, terms)), lambda t: low.contains(t)))
    order = Window.partitionBy("path").orderBy("line_no")
    few = hit.withColumn("n", F.row_number().over(order)).where(F.col("n") <= snippets).select("path", "line_no")
    near = few.select("path", F.col("line_no").alias("hit"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("line_no") - before), F.col("line_no") + after)).alias("line_no"))
    shown = near.join(lines, ["path", "line_no"])
    numbered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: F.concat_ws(": ", x["line_no"].cast("string"), x["line"])), "\n")
    texts = shown.groupBy("path", F.col("hit").alias("line_no")).agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), numbered.alias("snippet"))
    return texts.select("path", "line_no", "first", "last", "snippet")

"""Reviews of candidates: objects recovered from answers that may be cut off, and
checked against the code that the reviewer was shown; events of a result log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.session import kept
from ..functions.text import any_of, collapse, normalize_path

# Roles and entity kinds of a review, words of a gap that keeps a search going, axes, and the events of a log.
ROLES = ("patch_target", "supporting_target", "navigation_only", "reproduction_only", "test_or_docs", "unlikely")
KINDS = ("function", "method", "class", "module")
CRITICAL = ("actual source", "implementation", "caller", "consumer", "call flow", "data flow", "def-use", "runtime behavior")
AXES = ("call", "flow", "program", "behavior")
MARKER = r'"candidates"\s*:\s*\['
#: A string (the last may be open), a brace, or a run of anything else: together they are the text.
PIECE = r'"(?:[^"\\]++|\\.)*+"?|[{}]|[^"{}]++'
EVENT_KEYS = (("llm_raw", "react_or_controller_raw"), ("raw_response", "llm_response"), ("_llm_response_id", "llm_parsed_output"))
EVENT_ENDS = (
    ("llm_understanding", "llm_evidence_understanding"), ("llm_planning", "llm_evidence_planning"), ("llm_followup", "llm_followup_planning"),
)
CONTENT = ("content", "llm_raw", "analysis", "decision")


def balanced_objects(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, at, object): the complete outermost {...} of each text, in order. Braces
    within strings don't count; an object that is cut off gives nothing.

    A text is cut into strings, braces and the rest; the depth is a running sum over
    the pieces, and an object is the pieces from one opening at depth 0 to its end.
    """
    pieces = rows.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(PIECE), F.lit(0))).alias("at", "piece"))
    step = F.when(F.col("piece") == "{", 1).when(F.col("piece") == "}", -1).otherwise(0)
    run = Window.partitionBy(*keys).orderBy("at")
    # A closing brace with nothing open is stray: the depth starts again below it.
    sums = pieces.withColumn("step", step).withColumn("sum", F.sum("step").over(run))
    low = F.least(F.lit(0), F.coalesce(F.min("sum").over(run.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    deep = sums.withColumn("depth", F.col("sum") - low)
    opened = deep.withColumn("starts", ((F.col("piece") == "{") & (F.col("depth") == 1)).cast("int"))
    inside = opened.withColumn("object_no", F.sum("starts").over(run)).where((F.col("depth") > 0) | ((F.col("piece") == "}") & (F.col("step") == -1) & (F.col("depth") == 0)))
    # Behind the end of an object the depth is 0 until the next one starts.
    held = inside.groupBy(*keys, "object_no").agg(
        F.min("at").alias("at"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "").alias("object"),
        F.min("depth").alias("end"),
    )
    return held.where("end = 0 and object_no > 0").select(*keys, "at", "object")


def review_objects(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heads, candidates) of responses (instance_id, response).

    heads (instance_id, mode, continue_search, missing): mode is complete_json if
    the answer, or the first object in it, parses and has a list of candidates;
    partial_candidate_recovery if complete objects follow the mark of that list;
    else invalid. candidates (instance_id, pos, item): the objects, as variants.
    """
    text = F.trim(F.regexp_replace(F.trim(F.coalesce("response", F.lit(""))), r"(?is)^```(?:json)?\s*|\s*```$", ""))
    rows = kept(responses.select("instance_id", text.alias("text")), "responses")
    first = balanced_objects(rows.where("text not like '{%'"), "text", ["instance_id"])
    first = first.groupBy("instance_id").agg(F.min_by("object", "at").alias("object"))
    bodies = rows.join(first, "instance_id", "left").withColumn("body", F.when(F.col("text").startswith("{"), F.col("text")).otherwise(F.col("object")))
    parsed = bodies.select("instance_id", "text", F.try_parse_json("body").alias("v"))
    listed = F.coalesce(F.schema_of_variant(F.try_variant_get("v", "$.candidates", "variant")).startswith("ARRAY"), F.lit(False))
    whole, cut = parsed.where(listed), parsed.where(~listed)
    items = F.try_variant_get("v", "$.candidates", "array<variant>")
    complete = whole.select("instance_id", F.posexplode(items).alias("pos", "item"))
    tail = F.regexp_extract("text", rf"(?s){MARKER}(.*)$", 1)
    broken = cut.where(F.col("text").rlike(MARKER)).select("instance_id", "text", tail.alias("tail"))
    found = balanced_objects(broken, "tail", ["instance_id"]).select("instance_id", F.col("at").cast("int").alias("pos"), F.try_parse_json("object").alias("item"))
    has = lambda name: F.coalesce(F.try_variant_get("item", f"$.{name}", "string"), F.lit("")) != ""
    saved = kept(found.where(F.col("item").isNotNull() & has("path") & has("role")), "recovered")
    got = saved.select("instance_id").distinct().withColumn("saved", F.lit(True))
    goes_on = F.lower(F.regexp_extract("text", r'(?i)"continue_search"\s*:\s*(true|false)', 1)) == "true"
    heads = whole.select(
        "instance_id", F.lit("complete_json").alias("mode"), F.coalesce(F.try_variant_get("v", "$.continue_search", "boolean"), F.lit(False)).alias("continue_search"),
        F.coalesce(F.try_variant_get("v", "$.missing_evidence", "array<string>"), F.array().cast("array<string>")).alias("missing"),
    ).unionByName(
        cut.join(got, "instance_id", "left").select(
            "instance_id", F.when(F.col("saved"), "partial_candidate_recovery").otherwise("invalid").alias("mode"),
            F.coalesce(F.col("saved") & goes_on, F.lit(False)).alias("continue_search"), F.array().cast("array<string>").alias("missing"),
        )
    )
    return heads, complete.unionByName(saved.select("instance_id", "pos", "item"))


def _deduped(values: Column, most: int) -> Column:
    """Texts with blanks collapsed, the first spelling of each, ``most`` of them."""
    clean = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), collapse), lambda x: x != "")
    first = F.filter(clean, lambda x, i: F.array_position(F.transform(clean, F.lower), F.lower(x)) == i + 1)
    return F.slice(first, 1, most)


def validated_reviews(candidates: DataFrame, allowed: DataFrame, contexts: DataFrame) -> DataFrame:
    """(instance_id, pos, path, role, confidence, evidence_quote, grounded,
    quote_supported, entity_supported, mechanism_verified, axes, entities):
    candidates of allowed paths (instance_id, path), the first of each path.

    A quote of 8 letters or more, and the names of all entities, must be in the
    context of the path (contexts: instance_id, path, text) with blanks collapsed;
    a mechanism counts if both are and it is told.
    """
    get = lambda name, kind="string": F.try_variant_get("item", f"$.{name}", kind)
    role = F.lower(F.trim(F.coalesce(get("role"), F.lit(""))))
    names = F.coalesce(get("entities", "array<variant>"), F.array().cast("array<variant>"))
    entity = F.transform(
        names,
        lambda e: F.struct(
            F.lower(F.trim(F.coalesce(F.try_variant_get(e, "$.kind", "string"), F.lit("")))).alias("kind"), F.trim(F.coalesce(F.try_variant_get(e, "$.name", "string"), F.lit(""))).alias("name")
        ),
    )
    truth = F.lower(F.coalesce(get("mechanism_verified"), F.lit("")))
    rows = candidates.select(
        "instance_id", "pos", normalize_path(F.coalesce(get("path"), F.lit(""))).alias("path"), F.when(role.isin(*ROLES), role).otherwise("unlikely").alias("role"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.expr("try_cast(try_variant_get(item, '$.confidence', 'string') as double)"), F.lit(0.0)))), 4).alias("confidence"),
        F.substring(collapse(F.coalesce(get("evidence_quote"), F.lit(""))), 1, 300).alias("evidence_quote"),
        ((~truth.isin("", "false", "0", "0.0")) & (collapse(F.coalesce(get("patch_mechanism"), F.lit(""))) != "")).alias("told"),
        _deduped(get("matched_issue_axes", "array<string>"), 8).alias("axes"), F.filter(entity, lambda e: e["kind"].isin(*KINDS) & (e["name"] != "")).alias("entities"),
    )
    own = rows.join(allowed.select("instance_id", "path").distinct(), ["instance_id", "path"])
    order = Window.partitionBy("instance_id", "path").orderBy("pos")
    once = own.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    shown = contexts.groupBy("instance_id", "path").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("text"))
    seen = once.join(shown.select("instance_id", "path", F.lower(collapse("text")).alias("context")), ["instance_id", "path"], "left")
    context = F.coalesce("context", F.lit(""))
    quote = (F.length("evidence_quote") >= 8) & F.contains(context, F.lower("evidence_quote"))
    named = (F.size("entities") > 0) & F.forall("entities", lambda e: F.contains(context, F.lower(e["name"])))
    grounded = F.col("context").isNotNull()
    return seen.select(
        "instance_id", "pos", "path", "role", "confidence", "evidence_quote", grounded.alias("grounded"), quote.alias("quote_supported"), named.alias("entity_supported"),
        (F.col("told") & grounded & quote & named).alias("mechanism_verified"), "axes", F.slice("entities", 1, 8).alias("entities"),
    )


def review_stops(heads: DataFrame, reviews: DataFrame) -> DataFrame:
    """(instance_id, mode, candidates, continue_search, critical, stop_ready): a
    search may stop if the first patch or supporting target is grounded, verified,
    sure (0.85) and named, touches the concern and a flow, and no critical gap is
    left."""
    target = F.col("role").isin("patch_target", "supporting_target")
    sure = F.col("grounded") & F.col("mechanism_verified") & (F.col("confidence") >= 0.85) & (F.size("entities") > 0)
    sure = sure & F.array_contains("axes", "concern") & F.arrays_overlap("axes", F.array(*map(F.lit, AXES)))
    best = reviews.groupBy("instance_id").agg(F.count("*").alias("candidates"), F.min_by(F.when(target, sure), F.struct(~target, "pos")).alias("sure"))
    critical = F.filter(_deduped(F.col("missing"), 10), lambda x: any_of(F.lower(x), CRITICAL))
    rows = heads.join(best, "instance_id", "left").na.fill(0, ["candidates"]).withColumn("critical", F.size(critical))
    return rows.select("instance_id", "mode", "candidates", "continue_search", "critical", (F.coalesce("sure", F.lit(False)) & (F.col("critical") == 0)).alias("stop_ready"))


# --- events of a result ---------------------------------------------------------------


def _object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _truthy(v: Column) -> Column:
    """The text of a value; null if it is missing, empty, zero or false."""
    shown = F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
    return F.when(~shown.isin("", "0", "0.0", "false", "null", "[]", "{}"), shown)


def llm_events(results: DataFrame, cut: int = 2_000, depth: int = 64) -> DataFrame:
    """(instance_id, event_no, path, event_type, response_id, content, usage): the
    model answers in nested results (instance_id, result variant), in the order of
    a walk from the top: keys by name, lists by position.

    An object with llm_raw, raw_response or _llm_response_id is an event, else one
    that is not empty at a path that ends with an evidence step. What is below
    raw_response is not walked. One step of the walk opens a level of all results.
    """
    level = results.select("instance_id", F.lit("").alias("path"), F.array().cast("array<int>").alias("place"), F.col("result").alias("v"))
    found = None
    for _ in range(depth):
        level = kept(level, "level")
        if level.isEmpty():
            break
        objects = level.where(_object(F.col("v")))
        has = lambda key: F.try_variant_get("v", f"$.{key}", "variant").isNotNull() | F.contains(F.schema_of_variant("v"), F.lit(f"{key}: VOID"))
        kind = None
        for key, name in EVENT_KEYS:
            kind = F.when(has(key), name) if kind is None else kind.when(has(key), name)
        for end, name in EVENT_ENDS:
            kind = kind.when(F.col("path").endswith(end) & (F.schema_of_variant("v") != "OBJECT<>"), name)
        own = objects.withColumn("event_type", kind).where("event_type is not null").select("instance_id", "path", "place", "event_type", "v")
        found = own if found is None else found.unionByName(own)
        inner = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer())).where("key is null or key <> 'raw_response'")
        dotted = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("key"))
        level = inner.select(
            "instance_id", dotted.otherwise(F.concat("path", F.lit("."), "key")).alias("path"), F.concat("place", F.array(F.col("pos").cast("int"))).alias("place"), F.col("value").alias("v")
        )
    raw = lambda p: F.try_variant_get("v", p, "variant")
    content = F.coalesce(*[_truthy(raw(f"$.{k}")) for k in CONTENT], F.to_json("v"))
    usage = F.coalesce(*[F.when(_object(raw(p)), _truthy(raw(p))) for p in ("$.usage", "$.token_usage", "$.raw_response.usage")], F.lit("{}"))
    number = F.coalesce(_truthy(raw("$._llm_response_id")), _truthy(raw("$.raw_response.id")), F.lit(""))
    order = Window.partitionBy("instance_id").orderBy("place")
    short = F.when(F.length("content") > cut, F.concat(F.substring("content", 1, cut), F.lit("...<truncated>"))).otherwise(F.col("content"))
    rows = found.select("instance_id", "place", "path", "event_type", number.alias("response_id"), content.alias("content"), usage.alias("usage"))
    return rows.select("instance_id", F.row_number().over(order).alias("event_no"), "path", "event_type", "response_id", short.alias("content"), "usage")


def compact_traces(results: DataFrame) -> DataFrame:
    """(instance_id, status, elapsed_seconds, modality, urls, images, flows,
    backends, flow_types, top_files): a row for each result (instance_id, result
    variant); counts of flows by backend and type as maps, the first 15 files."""
    get = lambda path, kind="string": F.try_variant_get("result", path, kind)
    empty = F.array().cast("array<variant>")
    many = lambda *paths: F.coalesce(*[get(p, "array<variant>") for p in paths], empty)
    packet = ("$.evidence.evidence_packet", "$.evidence.packet")
    of = lambda flow, name: F.coalesce(F.when(F.try_variant_get(flow, f"$.{name}", "string") != "", F.try_variant_get(flow, f"$.{name}", "string")), F.lit("unknown"))

    def counted(name: str) -> Column:
        values = F.transform("flow_list", lambda f: of(f, name))
        return F.map_from_arrays(F.array_sort(F.array_distinct(values)), F.transform(F.array_sort(F.array_distinct(values)), lambda v: F.size(F.filter(values, lambda x: x == v))))

    rows = results.withColumn("flow_list", many("$.localization.flow_traces"))
    return rows.select(
        "instance_id", F.coalesce(get("$.status"), F.lit("")).alias("status"), F.coalesce(get("$.elapsed_seconds", "double"), F.lit(0.0)).alias("elapsed_seconds"),
        F.coalesce(*[get(f"{p}.modality") for p in packet], F.lit("")).alias("modality"), F.size(many(*[f"{p}.url_inspections" for p in packet])).alias("urls"),
        F.size(many(*[f"{p}.image_inspections" for p in packet])).alias("images"), F.size("flow_list").alias("flows"), F.to_json(counted("backend")).alias("backends"),
        F.to_json(counted("flow_type")).alias("flow_types"),
        F.array_join(F.transform(F.slice(many("$.localization.ranked_locations"), 1, 15), lambda x: F.coalesce(F.try_variant_get(x, "$.path", "string"), F.lit(""))), "|").alias("top_files"),
    )

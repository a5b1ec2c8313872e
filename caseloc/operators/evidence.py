"""Evidence in issue texts: links, images, symbols, keywords, labels.

Every function takes a DataFrame of issues (instance_id, repo, issue_text) or of
links (url, ...) and adds or returns columns; nothing is looped or collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ADAPTER_MARKERS, any_of, collapse, first_of, matching, tokens

URL = r"https?://[^\s<>()\[\]\"']+"

# Extensions, hosts and keywords that decide labels.
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg")
IMAGE_HOST = "user-images.githubusercontent.com"
REPRODUCTION_HOSTS = ("play.net", "playground", "codesandbox", "stackblitz", "jsfiddle", "codepen")
TOOL_PLAYGROUNDS = (*REPRODUCTION_HOSTS, "typescriptlang.org", "babeljs.io", "prettier.io")
DOCS_HOSTS = ("readthedocs", "docs.", "developer.", "api.", "devdocs")
PRODUCT_HOSTS = ("wordpress.com", "prettier.io", "babeljs.io")
FLOW_WORDS = {
    "url_builder_or_route_flow": ("redirect", "url", "link", "route", "href"),
    "parameter_or_config_flow": ("parameter", "argument", "option", "config", "flag"),
    "state_selector_flow": ("state", "selector", "redux", "store", "cache"),
    "ui_event_flow": ("click", "button", "submit", "form", "dialog"),
    "symbol_or_type_flow": ("type", "typing", "class", "method", "interface"),
    "render_style_pipeline_flow": ("layout", "render", "style", "css", "margin", "font"),
}
TASK_WORDS = {
    "feature_request": (
        "feature request", "we should", "should make it", "make it so", "i propose", "add support", "allow changing",
        "enable ", "new option", "new feature",
    ),
    "refactor_or_maintenance": ("refactor", "cleanup", "clean up", "rename", "deprecate"),
    "bug_fix": ("bug", "regression", "crash", "incorrect", "does not", "doesn't", "fails", "error"),
}
IMAGE_WORDS = {
    "layout_or_pdf_render": ("pdf", "layout", "margin", "font", "text measurement", "wrap"),
    "chart_or_canvas_render": ("canvas", "chart", "chart.js", "chartjs", "plot", "legend", "dataset"),
    "web_ui_screenshot": ("screenshot", "screen shot", "ui", "button", "dialog", "page", "form", "owner box", "purchase"),
    "text_or_markdown_render": ("markdown", "mdx", "syntax highlight", "html"),
    "error_or_failure_screenshot": ("traceback", "error", "exception", "failed", "failure"),
}
IMAGE_LAYERS = {
    "web_ui_screenshot": ("route", "component", "state", "event_handler", "form_or_guard"),
    "chart_or_canvas_render": ("chart_config", "scale", "layout", "plugin", "canvas_renderer"),
    "layout_or_pdf_render": ("style_expand", "style_resolve", "layout_engine", "renderer"),
    "text_or_markdown_render": ("parser", "tokenizer", "renderer", "syntax_highlight"),
    "error_or_failure_screenshot": ("error_message", "exception_path", "runtime_state"),
    "svg_or_vector": ("asset_reference", "style", "documentation_or_logo"),
    "generic_visual": ("visual_symptom", "rendering_or_ui_layer"),
}
IMAGE_QUERY_WORDS = ("tooltip", "axis", "legend", "margin", "font", "button", "redirect")
IMAGE_TYPE_QUERIES = {
    "web_ui_screenshot": ("component", "route", "state"),
    "chart_or_canvas_render": ("canvas", "render", "scale"),
    "layout_or_pdf_render": ("layout", "style", "resolve"),
    "text_or_markdown_render": ("markdown", "render", "html"),
}
PROBLEM_WORDS = {
    "ui_or_event_flow": ("click", "hover", "leave", "button", "form", "submit"),
    "config_or_parameter_flow": ("option", "config", "parameter", "flag"),
    "render_or_layout_flow": ("render", "layout", "style", "canvas", "chart", "pdf"),
    "symbol_or_type_flow": ("type", "class", "method", "interface", "attribute"),
}
CONCERN_STOPWORDS = (
    "the", "and", "for", "with", "that", "this", "from", "into", "when", "where", "should", "could", "would", "have",
    "has", "not", "are", "but", "you", "your", "their", "then", "than", "will", "can",
)


# --- links --------------------------------------------------------------------


def extract_urls(issues: DataFrame) -> DataFrame:
    """(instance_id, pos, url): links in order of first appearance, from 0."""
    found = issues.select("instance_id", F.posexplode(F.regexp_extract_all("issue_text", F.lit(URL), F.lit(0))).alias("at", "raw"))
    return ordered_distinct(found.select("instance_id", "at", F.rtrim("raw", F.lit(".,;:")).alias("url")).where("url <> ''"), "url")


def ordered_distinct(rows: DataFrame, value: str, cap: int | None = None, order: tuple[str, ...] = ("at",)) -> DataFrame:
    """(instance_id, pos, value): the first of equal values in order, numbered
    from 0 in each instance, at most ``cap``."""
    first = rows.groupBy("instance_id", value).agg(F.min(F.struct(*order)).alias("_first"))
    out = first.withColumn("pos", F.row_number().over(Window.partitionBy("instance_id").orderBy("_first")) - 1)
    if cap is not None:
        out = out.where(F.col("pos") < cap)
    return out.select("instance_id", "pos", value)


def merge_urls(*groups: DataFrame) -> DataFrame:
    """Ordered union of groups (instance_id, pos, url): group, then position."""
    rows = None
    for n, g in enumerate(groups):
        part = g.select("instance_id", F.lit(n).alias("group_no"), F.col("pos").alias("at"), F.rtrim(F.trim("url"), F.lit(".,;:")).alias("url"))
        rows = part if rows is None else rows.unionByName(part)
    return ordered_distinct(rows.where("url <> ''"), "url", order=("group_no", "at"))


def is_image_url(url: Column) -> Column:
    low = F.lower(url)
    return low.contains(IMAGE_HOST) | _ends(F.substring_index(low, "?", 1), IMAGE_EXTENSIONS)


def _ends(text: Column, tails: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for t in tails:
        out = out | text.endswith(t)
    return out


def url_parts(url: Column) -> dict[str, Column]:
    """Parts by pattern, so odd links give empty parts and never an error."""
    return {
        "domain": F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)),
        "path": F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1),
        "query": F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1),
        "fragment": F.regexp_extract(url, r"^[^#]*#(.*)$", 1),
    }


def classify_url(links: DataFrame) -> DataFrame:
    """``links`` with domain, url_type, role and leakage_risk; first rule wins."""
    url = F.col("url")
    parts = url_parts(url)
    domain, path = parts["domain"], F.lower(parts["path"])
    github = domain.contains("github.com")
    kind = first_of(
        {
            "image_asset": domain.contains(IMAGE_HOST) | _ends(path, IMAGE_EXTENSIONS),
            "github_pr": github & path.contains("/pull/"),
            "github_commit": github & (path.contains("/commit/") | path.contains("/commits/")),
            "github_diff": github & (path.contains("/compare/") | path.contains("/files") | _ends(path, (".diff", ".patch"))),
            "github_code": github & path.contains("/blob/"),
            "github_issue": github & path.contains("/issues/"),
            "github_repo_or_search": github,
            "reproduction_playground": any_of(domain, REPRODUCTION_HOSTS) | F.lower(url).contains("playground"),
            "docs_reproduction_sample": path.contains("/docs/") & path.contains("/samples/"),
            "docs_api": any_of(domain, DOCS_HOSTS) | path.contains("/docs"),
            "product_or_repro_page": _ends(domain, PRODUCT_HOSTS),
        },
        "external_page",
    )
    role = (
        F.when(kind == "image_asset", "visual_evidence")
        .when(kind.isin("github_pr", "github_commit", "github_diff"), "leakage_risk")
        .when(kind == "github_code", "code_evidence_seed")
        .when(kind == "github_issue", "historical_discussion")
        .when(kind == "github_repo_or_search", "repository_context")
        .when(kind.isin("reproduction_playground", "docs_reproduction_sample", "product_or_repro_page"), "reproduction_entry")
        .when(kind == "docs_api", "spec_or_api_semantics")
        .otherwise("weak_context")
    )
    risk = F.when(role == "leakage_risk", "high").when(kind.isin("github_code", "github_issue"), "medium").otherwise("low")
    return links.select("*", domain.alias("domain"), kind.alias("url_type"), role.alias("role"), risk.alias("leakage_risk"))


def parse_github_url(links: DataFrame) -> DataFrame:
    """``links`` with github_kind, gh_repo, gh_ref, gh_path and gh_line."""
    parts = url_parts(F.col("url"))
    p = F.filter(F.transform(F.split(parts["path"], "/"), lambda x: F.url_decode(x)), lambda x: x != "")
    third, n = F.get(p, F.lit(2)), F.size(p)
    kind = (
        F.when((n >= 4) & (third == "blob"), "code")
        .when((n >= 3) & (third == "issues"), "issue")
        .when((n >= 3) & (third == "pull"), "pull_request")
        .when((n >= 3) & third.isin("commit", "commits"), "commit")
        .when((n >= 3) & (third == "compare"), "diff_or_compare")
        .otherwise("unknown")
    )
    line = F.regexp_extract(parts["fragment"], r"L(\d+)", 1)
    code = kind == "code"
    return links.select(
        "*",
        kind.alias("github_kind"),
        F.when(n >= 2, F.concat_ws("/", F.get(p, F.lit(0)), F.get(p, F.lit(1)))).alias("gh_repo"),
        F.when(code, F.get(p, F.lit(3))).alias("gh_ref"),
        F.when(code & (n > 4), F.array_join(F.slice(p, F.lit(5), F.greatest(n - 4, F.lit(0))), "/")).alias("gh_path"),
        F.when(code & (line != ""), line.cast("int")).alias("gh_line"),
    )


def inspect_url(links: DataFrame) -> DataFrame:
    """``links`` with kind, role, risk, tool and use: the routing of a link."""
    parts = url_parts(F.col("url"))
    domain, path = parts["domain"], F.lower(parts["path"])
    sample = path.contains("/docs/") & path.contains("/samples/")
    kind = first_of(
        {
            "github": domain.endswith("github.com"),
            "playground": any_of(domain, TOOL_PLAYGROUNDS),
            "product_or_repro_page": _ends(domain, PRODUCT_HOSTS),
            "docs_sample": sample,
            "docs": any_of(domain, DOCS_HOSTS) | path.contains("/docs"),
        },
        "web",
    )
    rows = parse_github_url(links.withColumn("kind", kind))
    gh = lambda *names: (F.col("kind") == "github") & F.col("github_kind").isin(*names)
    of = lambda name: F.col("kind") == name
    image = (F.col("kind") == "web") & _ends(path, IMAGE_EXTENSIONS)
    leak = gh("pull_request", "commit", "diff_or_compare")
    routes = (
        (leak, "leakage_skip", "high", "skip_for_localization", "do_not_use"),
        (gh("code"), "code_evidence_seed", "medium", "repo_seed_expand", "use_as_seed_not_target"),
        (gh("issue"), "historical_discussion", "medium", "web_snapshot", "extract_issue_terms_without_patch_links"),
        (of("playground"), "reproduction_entry", "low", "reproduction_extractor", "extract_input_config_behavior"),
        (of("product_or_repro_page"), "reproduction_entry", "low", "web_snapshot", "extract_route_query_business_entities_and_reproduction_behavior"),
        (of("docs_sample"), "reproduction_entry", "low", "reproduction_extractor", "extract_docs_sample_api_behavior_and_event_config"),
        (of("docs"), "spec_or_api_semantics", "low", "web_snapshot", "extract_api_names_and_behavior_rules"),
        (image, "visual_evidence", "low", "image_inspector", "extract_visual_symptom"),
    )
    default = ("weak_context", "low", "web_snapshot", "semantic_context")
    cols = []
    for i, name in enumerate(("inspect_role", "inspect_risk", "tool", "localization_use")):
        out = None
        for test, *values in routes:
            out = F.when(test, values[i]) if out is None else out.when(test, values[i])
        cols.append(out.otherwise(default[i]).alias(name))
    return rows.select("*", *cols)


def route_terms(url: Column) -> Column:
    """Up to 24 words of a link: path parts, then query keys and values."""
    parts = url_parts(url)
    from_path = F.filter(
        F.split(F.url_decode(parts["path"]), r"[/_.\-]+"),
        lambda t: (F.length(t) >= 3) & ~t.rlike(r"^\d+$") & ~F.lower(t).isin("http", "https", "www", "com"),
    )
    pairs = F.filter(F.split(parts["query"], "&"), lambda x: x.rlike("^[^=]+=.+"))
    from_query = F.flatten(
        F.transform(
            pairs,
            lambda x: F.array(F.substring_index(x, "=", 1), F.url_decode(F.regexp_extract(x, "=(.*)$", 1))),
        )
    )
    kept = F.filter(from_query, lambda t: (F.length(t) >= 3) & (F.length(t) <= 80))
    return F.slice(F.array_distinct(F.concat(from_path, kept)), 1, 24)


def semantic_terms(url: Column, kind: Column, role: Column) -> Column:
    """Up to 32 words: those of the route, of the role and of the host."""
    host = F.filter(
        F.split(url_parts(url)["domain"], r"[.\-]+"), lambda t: (F.length(t) >= 3) & ~t.isin("www", "com", "org", "net")
    )
    none = F.array().cast("array<string>")
    of_role = (
        F.when(role == "spec_or_api_semantics", F.array(*map(F.lit, ("api", "docs", "option", "parameter", "behavior"))))
        .when(role == "reproduction_entry", F.array(*map(F.lit, ("reproduction", "example", "runtime", "config"))))
        .otherwise(none)
    )
    few = F.when(kind == "github", F.slice(host, 1, 2)).otherwise(F.slice(host, 1, 4))
    return F.slice(F.array_distinct(F.concat(route_terms(url), of_role, few)), 1, 32)


# --- images -------------------------------------------------------------------


def body_text(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for marker in ADAPTER_MARKERS:
        out = F.substring_index(out, marker, 1)
    return out


def classify_image(url: Column, text: Column) -> tuple[Column, Column, Column]:
    """(image_type, role, extension) of an image and the issue it is in."""
    extension = F.regexp_extract(F.substring_index(F.lower(url), "?", 1), r"[^/.](\.[^./]+)$", 1)
    low = F.lower(body_text(text))
    rules = {"svg_or_vector": extension == ".svg"} | {k: any_of(low, v) for k, v in IMAGE_WORDS.items()}
    role = F.when(extension == ".svg", "non_raster_or_auxiliary").otherwise("visual_evidence")
    return first_of(rules, "generic_visual"), role, extension


def _words(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def image_layers(image_type: Column) -> Column:
    out = None
    for kind, layers in IMAGE_LAYERS.items():
        out = F.when(image_type == kind, _words(layers)) if out is None else out.when(image_type == kind, _words(layers))
    return out.otherwise(_words(IMAGE_LAYERS["generic_visual"]))


def image_queries(image_type: Column, text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    of_type = F.lit(None).cast("array<string>")
    for kind, words in IMAGE_TYPE_QUERIES.items():
        of_type = F.when(image_type == kind, _words(words)).otherwise(of_type)
    own = matching({w: low.contains(w) for w in IMAGE_QUERY_WORDS})
    return F.slice(F.array_distinct(F.concat(own, F.coalesce(of_type, _words(())))), 1, 12)


# Fixed values: (keywords, layers, entities, queries, symptom) of each rule.
IMAGE_HINTS = (
    (("chart", "legend", "canvas", "tooltip", "pie", "bar"), ("chart_plugin", "canvas_render", "event_handler"), ("chart", "legend", "canvas"),
     ("legend", "tooltip", "onHover", "onLeave", "plugin.legend"), "chart/canvas visual behavior or rendering symptom"),
    (("pdf", "layout", "margin", "font", "wrap", "text measurement"), ("layout_engine", "stylesheet_resolver", "text_measurement"), ("layout", "text", "style"),
     ("layout", "margin", "font", "resolveStyles", "processBoxModel"), "layout or PDF/text rendering difference"),
    (("button", "form", "dialog", "page", "screen", "screenshot", "click"), ("route", "component", "ui_state", "event_handler"), ("page", "button", "form"),
     ("component", "route", "state", "onClick", "submit"), "web UI state or interaction symptom"),
    (("error", "exception", "traceback", "warning", "failed"), ("error_handling", "validation", "diagnostics"), ("error message", "stack trace"),
     ("error", "exception", "warning", "diagnostic"), "error/failure screenshot"),
)


def image_heuristic(issues: DataFrame) -> DataFrame:
    """``issues`` with layers, entities, queries and symptom: rules add up and
    the last that holds names the symptom."""
    low = F.lower(F.coalesce(F.col("issue_text"), F.lit("")))
    none = F.array().cast("array<string>")
    lists = [[], [], []]
    symptom = F.lit("visual evidence needs VLM inspection")
    for words, *values, name in IMAGE_HINTS:
        test = any_of(low, words)
        for out, v in zip(lists, values):
            out.append(F.when(test, _words(v)).otherwise(none))
        symptom = F.when(test, name).otherwise(symptom)
    repo = F.slice(F.filter(F.split(F.replace("repo", F.lit("-"), F.lit("/")), "/"), lambda p: F.length(p) > 2), 1, 4)
    layers, entities, queries = (F.array_distinct(F.concat(*x)) for x in (lists[0], lists[1], [*lists[2], repo]))
    return issues.select("*", layers.alias("layers"), entities.alias("entities"), F.slice(queries, 1, 30).alias("queries"), symptom.alias("symptom"))


# --- words and labels -----------------------------------------------------------


def symbol_queries(text: Column) -> Column:
    """Up to 12 backticked symbols of 2 to 120 characters."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("`([^`]{2,120})`"), F.lit(1)), lambda s: F.trim(s))
    kept = F.filter(found, lambda s: ~(s.rlike(r"[ \n\t]") & (F.length(s) > 60)))
    return F.slice(F.array_distinct(kept), 1, 12)


def flow_hypotheses(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return matching({k: any_of(low, v) for k, v in FLOW_WORDS.items()})


def task_type(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return first_of({k: any_of(low, v) for k, v in TASK_WORDS.items()}, "behavior_change")


def modality(urls: Column, images: Column) -> Column:
    return (
        F.when((urls > 0) & (images > 0), "image_and_url").when(images > 0, "image_only").when(urls > 0, "url_only").otherwise("text_only")
    )


def sketches(issues: DataFrame) -> DataFrame:
    """One row for each issue: counts of links and images by kind, modality and
    problem types. Links are classified once and gathered by issue."""
    links = classify_url(extract_urls(issues)).withColumn("image", is_image_url(F.col("url")))
    per_issue = links.groupBy("instance_id").agg(
        F.count_if(~F.col("image")).alias("url_count"),
        F.count_if(F.col("image")).alias("image_count"),
        F.max(~F.col("image") & (F.col("role") == "reproduction_entry")).alias("reproduces"),
        F.max(~F.col("image") & (F.col("leakage_risk") == "high")).alias("leaks"),
    )
    rows = issues.join(per_issue, "instance_id", "left").na.fill({"url_count": 0, "image_count": 0, "reproduces": False, "leaks": False})
    low = F.lower("issue_text")
    types = matching(
        {
            "multimodal_visual_issue": F.col("image_count") > 0,
            "url_grounded_issue": F.col("url_count") > 0,
            "reproduction_driven_issue": F.col("reproduces"),
            "contains_leakage_url": F.col("leaks"),
        }
        | {k: any_of(low, v) for k, v in PROBLEM_WORDS.items()}
    )
    return rows.select(
        "instance_id",
        "url_count",
        "image_count",
        modality(F.col("url_count"), F.col("image_count")).alias("modality"),
        types.alias("problem_types"),
    )


def concern_queries(issues: DataFrame, cap: int = 16) -> DataFrame:
    """(instance_id, rank, word, n): the most frequent words of an issue; the
    parts of the repository's name count twice more; ties by first appearance."""
    words = issues.select(
        "instance_id", F.posexplode(F.regexp_extract_all("issue_text", F.lit("[A-Za-z_][A-Za-z0-9_.$/-]{2,}"), F.lit(0))).alias("at", "raw")
    ).select("instance_id", "at", F.lit(1).alias("n"), F.regexp_replace(F.lower("raw"), "^[_./-]+|[_./-]+$", "").alias("word"))
    words = words.where((F.length("word") >= 4) & ~F.col("word").isin(*CONCERN_STOPWORDS) & ~F.col("word").startswith("http"))
    parts = issues.select("instance_id", F.posexplode(F.split("repo", r"[/_.\-]+")).alias("at", "raw")).where(F.length("raw") > 2)
    later = parts.select("instance_id", (F.col("at") + 1_000_000_000).alias("at"), F.lit(2).alias("n"), F.lower("raw").alias("word"))
    counted = words.unionByName(later).groupBy("instance_id", "word").agg(F.sum("n").alias("n"), F.min("at").alias("first"))
    order = Window.partitionBy("instance_id").orderBy(F.desc("n"), "first", "word")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap).select("instance_id", "rank", "word", "n")


def grounded_queries(queries: DataFrame, issues: DataFrame, least: int = 4) -> DataFrame:
    """(instance_id, query): guesses that share a token of ``least`` letters with
    the issue, or look like a path."""
    long = lambda c: F.array_distinct(F.filter(tokens(c), lambda t: F.length(t) >= least))
    own = issues.select("instance_id", long("issue_text").alias("_own"))
    rows = queries.join(own, "instance_id")
    is_path = F.col("query").contains("/") & ~F.col("query").contains(" ")
    return rows.where(is_path | F.arrays_overlap(long("query"), F.col("_own"))).select("instance_id", "query")


def evidence_summary(links: DataFrame, facets: tuple[str, ...] = ("url_type", "role", "leakage_risk")) -> DataFrame:
    """(facet, value, n): one pass over classified links for all facets."""
    long = links.select(F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.coalesce(F.col(f), F.lit("unknown")).alias("value")) for f in facets])).alias("x"))
    return long.groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def url_distribution(links: DataFrame, examples: int = 3) -> DataFrame:
    """(url_type, n, example_no, url): counts, and the first examples in order of
    (instance_id, pos)."""
    counts = links.groupBy("url_type").agg(F.count("*").alias("n"))
    first = Window.partitionBy("url_type").orderBy("instance_id", "pos")
    few = links.withColumn("example_no", F.row_number().over(first)).where(F.col("example_no") <= examples)
    return few.join(counts, "url_type").select("url_type", "n", "example_no", "url")


def planned_summary(text: Column, limit: int = 480) -> Column:
    whole = collapse(text)
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(F.rtrim(F.substring(whole, 1, limit - 3)), F.lit("...")))

"""Links to live reproductions: what their addresses carry, decoded without a way to
fail, and what the code in them names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, collapse, first_of
from .evidence import url_parts

# Keys of code and of settings, words that code has, platforms by what their address holds, and their layers.
CODE_KEYS = ("code", "input", "source", "text", "ts", "js", "python", "gist")
CONFIG_KEYS = ("parser", "plugins", "flags", "python", "mypy", "version", "printWidth", "tabWidth", "semi", "singleQuote", "trailingComma")
QUERY_KEYS = ("parser", "flags", "python", "mypy", "version")
CODE_WORDS = ("function", "class", "import", "const", "def ", "from ")
PLATFORMS = {
    "mypy_play": "mypy-play", "prettier_playground": "prettier", "typescript_playground": "typescriptlang", "babel_repl": "babeljs",
    "codesandbox": "codesandbox", "stackblitz": "stackblitz", "codepen": "codepen", "jsfiddle": "jsfiddle",
}
LIVE = ("codesandbox", "stackblitz", "codepen", "jsfiddle")
LAYERS = {
    "mypy_play": ("type_checker", "binder", "symbol_table", "semantic_analyzer"), "prettier_playground": ("parser", "printer", "format_options", "doc_builder"),
    "typescript_playground": ("parser", "transformer", "compiler_option", "code_generator"), "babel_repl": ("parser", "transformer", "compiler_option", "code_generator"),
    **dict.fromkeys(LIVE, ("runtime_reproduction", "component", "configuration", "browser_behavior")),
    "chartjs_docs_sample": ("docs_sample", "chart_plugin", "legend_plugin", "event_handler"),
}
IMPORT = r"""(?:import\s+(?:[^'"]+\s+from\s+)?|require\()\s*['"]([^'"]+)['"]"""
SYMBOL = r"\b[A-Za-z_$][A-Za-z0-9_$]{2,}\b"
NO_SYMBOL = ("function", "return", "const", "let", "var", "class", "import", "from", "export", "default")
OPTION_WORDS = ("option", "config", "parser", "plugin", "legend", "scale")
ROUTE_PARAM = r"[?&#/]([A-Za-z_][A-Za-z0-9_-]{2,})(?:=|/|$)"
_NONE = "array<string>"


def decoded(text: Column, plus: bool = True) -> Column:
    """Percent codes decoded; a text with a broken one stays as it is."""
    safe = text if plus else F.replace(text, F.lit("+"), F.lit("%2B"))
    blank = F.replace(text, F.lit("+"), F.lit(" ")) if plus else text
    return F.coalesce(F.try_url_decode(safe), blank)


def code_of_base64(text: Column) -> Column:
    """The text that url-safe base64 stands for, if it is valid, is UTF-8 and has a
    word of code; else null."""
    bare = F.regexp_replace(text, "=+$", "")
    padded = F.rpad(F.translate(bare, "-_", "+/"), (F.ceil(F.length(bare) / 4) * 4).cast("int"), "=")
    bytes_ = F.try_to_binary(F.when((F.length(text) >= 12) & bare.rlike("^[A-Za-z0-9_-]+$") & (F.length(bare) % 4 != 1), padded), F.lit("base64"))
    plain = F.try_validate_utf8(bytes_.cast("string"))
    return F.when(any_of(plain, CODE_WORDS), plain)


def _pairs(query: Column, prefix: str) -> Column:
    """(key, value) of each key of a query string, in order, with its last value."""
    parts = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: p != "")
    pair = F.transform(
        parts,
        lambda p: F.struct(
            F.concat(F.lit(prefix), decoded(F.substring_index(p, "=", 1))).alias("key"),
            F.when(F.contains(p, F.lit("=")), decoded(decoded(F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p))), False)).otherwise("").alias("value"),
        ),
    )
    keys = F.array_distinct(F.transform(pair, lambda x: x["key"]))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(pair, lambda x: x["key"] == k), -1)["value"].alias("value")))


def platform(domain: Column, path: Column) -> Column:
    low = F.lower(F.concat(domain, path))
    sample = F.contains(low, F.lit("chartjs.org")) & F.contains(low, F.lit("/docs/")) & F.contains(low, F.lit("/samples/"))
    return first_of({"chartjs_docs_sample": sample} | {name: F.contains(low, F.lit(word)) for name, word in PLATFORMS.items()}, "generic_playground")


def _first(values: Column, most: int) -> Column:
    return F.slice(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != ""))), 1, most)


def code_features(snippets: Column) -> dict[str, Column]:
    """imports, symbols, event_terms and option_terms of texts (an array), in order,
    24, 40, 20 and 20 at most."""
    every = lambda pattern, group: F.flatten(F.transform(snippets, lambda s: F.regexp_extract_all(s, F.lit(pattern), F.lit(group))))
    symbols = F.filter(every(SYMBOL, 0), lambda s: ~s.isin(*NO_SYMBOL))
    return {
        "imports": _first(every(IMPORT, 1), 24),
        "symbols": _first(symbols, 40),
        "event_terms": _first(F.filter(symbols, lambda s: s.startswith("on") & (F.length(s) > 3)), 20),
        "option_terms": _first(F.filter(symbols, lambda s: any_of(F.lower(s), OPTION_WORDS)), 20),
    }


def reproductions(links: DataFrame) -> DataFrame:
    """links (url, ...) with platform, fields, config (a map), snippets (field,
    value, encoding), imports, symbols, event_terms, option_terms, layers, queries
    (24 at most), sandbox_id and needs_browser.

    Fields are those of the query, then of the fragment. A code field gives its
    decoded text or its value, any other field only decoded code. Queries are
    settings, a file, the first three snippets (the path if there is nothing),
    then words of the route and of the code. A null or empty url gives empty lists.
    """
    bits = url_parts(F.coalesce("url", F.lit("")))
    path, domain = F.coalesce(bits["path"], F.lit("")), F.lower(F.coalesce(bits["domain"], F.lit("")))
    query = F.regexp_extract("url", r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract("url", r"^[^#]*#(.*)$", 1)
    rows = links.withColumns({"path": path, "domain": domain, "own": _pairs(query, ""), "all": F.concat(_pairs(query, ""), _pairs(fragment, "fragment."))})
    bare = lambda k: F.substring_index(k, ".", -1)
    code = F.transform("all", lambda x: F.struct(x["key"].alias("field"), x["value"].alias("raw"), code_of_base64(x["value"]).alias("code"), bare(x["key"]).isin(*CODE_KEYS).alias("is_code")))
    kept = F.filter(code, lambda x: (x["is_code"] & (x["raw"] != "")) | x["code"].isNotNull())
    snippets = F.transform(
        kept, lambda x: F.struct(x["field"].alias("field"), F.coalesce(x["code"], x["raw"]).alias("value"), F.when(x["code"].isNotNull(), "base64-url").otherwise("plain-or-urlencoded").alias("encoding"))
    )
    settings = F.filter("all", lambda x: bare(x["key"]).isin(*CONFIG_KEYS) & (x["value"] != ""))
    names = F.array_distinct(F.transform(settings, lambda x: bare(x["key"])))
    config = F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(settings, lambda x: bare(x["key"]) == k), -1)["value"]))
    rows = rows.withColumns({"platform": platform(F.col("domain"), F.col("path")), "snippets": snippets, "config": config})
    texts = F.transform("snippets", lambda s: s["value"])
    rows = rows.withColumns(code_features(texts))
    style = F.exists("all", lambda x: F.contains(F.lower(x["key"]), F.lit("css")) | F.contains(F.lower(x["value"]), F.lit("style")))
    layers = F.coalesce(F.element_at(F.create_map(*[x for k, v in LAYERS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("platform")), F.array().cast(_NONE))
    layers = F.concat(layers, F.when(style, F.array(F.lit("style_pipeline"))).otherwise(F.array().cast(_NONE)))
    told = F.array(*[F.concat_ws(" ", "platform", F.lit(k), F.element_at("config", k)) for k in QUERY_KEYS])
    asked = F.filter(F.zip_with(told, F.array(*[F.element_at("config", k) for k in QUERY_KEYS]), lambda q, v: F.when(v.isNotNull(), q)), lambda q: q.isNotNull())
    file = F.get(F.filter("own", lambda x: x["key"] == "file"), F.lit(0))["value"]
    named = F.when(file.isNotNull(), F.array(F.concat_ws(" ", "platform", F.lit("file"), file))).otherwise(F.array().cast(_NONE))
    shown = F.filter(F.transform(F.slice(texts, 1, 3), lambda t: F.substring(collapse(t), 1, 160)), lambda t: t != "")
    first = F.concat(asked, named, shown)
    steps = F.array_join(F.filter(F.split("path", "/"), lambda p: p != ""), " ")
    first = F.when(F.size(first) > 0, first).when(steps != "", F.array(F.concat_ws(" ", "platform", steps))).otherwise(F.array().cast(_NONE))
    words = F.filter(F.split(decoded(F.col("path"), False), r"[/_.\-]+"), lambda w: (F.length(w) >= 3) & ~w.rlike(r"^\d+$"))
    keys = F.filter(F.transform("own", lambda x: x["key"]), lambda k: F.length(k) >= 3)
    route = _first(F.concat(words, keys, F.regexp_extract_all(F.coalesce("url", F.lit("")), F.lit(ROUTE_PARAM), F.lit(1))), 24)
    eight = lambda c: F.slice(c, 1, 8)
    queries = _first(F.concat(first, eight(route), eight(F.col("imports")), eight(F.col("event_terms")), eight(F.col("option_terms"))), 24)
    last = F.try_element_at(F.filter(F.split("path", "/"), lambda p: p != ""), F.lit(-1))
    sandbox = F.when(F.col("domain").endswith(".csb.app"), F.substring_index("domain", ".", 1)).when(F.contains("domain", F.lit("codesandbox")), F.substring_index(last, "-", -1))
    out = rows.withColumns({"layers": layers, "queries": queries, "sandbox_id": sandbox, "needs_browser": (F.size("snippets") == 0) & F.col("platform").isin(*LIVE)})
    return out.withColumn("fields", F.array_sort(F.transform("all", lambda x: x["key"]))).drop("path", "domain", "own", "all")

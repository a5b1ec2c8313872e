"""Lines, entities, calls and imports of source files, as corpus jobs.

Patterns are applied line by line, never to whole files, so a long file costs
in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.session import kept
from ..functions.text import resolve_dots

# Languages by extension, and words that are never a callee.
LANGUAGES = {
    "javascript/typescript": (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".vue", ".svelte"),
    "python": (".py", ".pyi"),
    "java": (".java",),
    "style": (".css", ".scss", ".less"),
    "config": (".json", ".yaml", ".yml", ".toml"),
    "documentation": (".md", ".mdx"),
}
CONTROL_WORDS = ("if", "for", "while", "switch", "catch", "function", "return", "typeof", "new")
IMPORT_SUFFIXES = (
    "", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".py", ".java", ".css", ".scss", ".json",
    "/index.js", "/index.jsx", "/index.ts", "/index.tsx", "/__init__.py",
)

# Fixed values: (language, kind, what a line must hold for the pattern to be tried, pattern of one line with the name as its group).
# Rows may be added for further languages.
ENTITY_RULES = (
    ("javascript/typescript", "class", "class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][A-Za-z0-9_$]*)"),
    ("javascript/typescript", "function", "function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][A-Za-z0-9_$]*)\s*\("),
    ("javascript/typescript", "function", "=>", r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][A-Za-z0-9_$]*)\s*=>"),
    ("javascript/typescript", "method", "{", r"^\s+(?:async\s+)?(?:static\s+)?([A-Za-z_$][A-Za-z0-9_$]*)\s*\([^)]*\)\s*\{"),
    ("python", "class", "class", r"^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("python", "function", "def", r"^(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("python", "method", "def", r"^\s+(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("java", "class", "", r"^\s*(?:(?:public|private|protected|abstract|final|static)\s+)*(?:class|interface|enum)\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("java", "method", "(", r"^\s+(?:(?:public|private|protected|static|final|synchronized|abstract)\s+)+[A-Za-z0-9_<>\[\], ?]+\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("),
)


def language(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for name, tails in LANGUAGES.items() for tail in tails for x in (tail, name)])
    return F.coalesce(F.element_at(known, extension), F.lit("other"))


def lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line), numbered from 1."""
    return files.select("path", F.posexplode(F.split("text", "\n")).alias("n", "line")).select("path", (F.col("n") + 1).alias("line_no"), "line")


def entity_starts(rows: DataFrame) -> DataFrame:
    """(path, kind, name, start_line): declarations found line by line; the
    first rule of a line's language wins."""
    return declarations(rows).distinct()


def declarations(rows: DataFrame) -> DataFrame:
    """``entity_starts`` of lines that are there once: nothing is shuffled."""
    placed = rows.select("path", "line_no", "line", language(F.col("path")).alias("lang"))
    each = placed.select("path", F.col("line_no").alias("start_line"), F.explode(F.array_compact(F.array(_declared()))).alias("x"))
    return each.select("path", F.substring_index("x", " ", 1).alias("kind"), F.substring_index("x", " ", -1).alias("name"), "start_line")


def _declared() -> Column:
    """Kind and name, with a blank between, of what a row (line, lang) declares."""

    def found(language_: str, kind: str, mark: str, pattern: str) -> Column:
        names = F.filter(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)), lambda n: (n != "") & ~n.isin(*CONTROL_WORDS))
        return F.when((F.col("lang") == language_) & F.col("line").contains(mark), F.concat(F.lit(f"{kind} "), F.get(names, F.lit(0))))

    return F.coalesce(*[found(*rule) for rule in ENTITY_RULES])


def depths(rows: DataFrame) -> DataFrame:
    """lines with opened (braces on it), before and after (depth around it)."""
    opened = F.length("line") - F.length(F.replace("line", F.lit("{"), F.lit("")))
    closed = F.length("line") - F.length(F.replace("line", F.lit("}"), F.lit("")))
    run = Window.partitionBy("path").orderBy("line_no")
    with_net = rows.withColumn("opened", opened).withColumn("net", opened - closed)
    return with_net.withColumn("after", F.sum("net").over(run)).withColumn("before", F.col("after") - F.col("net"))


def _next_at(begin: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """begin (keys, start_line, from_line, ...) with next_line: the first line of
    ``marks`` (keys, line_no) at or after from_line, by one sorted pass."""
    none = F.lit(None).cast("int")
    columns = [c for c in begin.columns if c not in keys]
    both = begin.select(*keys, F.col("from_line").alias("_at"), F.lit(0).alias("_side"), F.struct(*columns).alias("_row"), none.alias("_mark")).unionByName(
        marks.select(*keys, F.col("line_no").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(begin.select(F.struct(*columns)).schema[0].dataType).alias("_row"), F.col("line_no").cast("int").alias("_mark"))
    )
    # From below: a frame that ends with the partition is read anew for each row.
    ahead = Window.partitionBy(*keys).orderBy(F.desc("_at"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("next_line", F.last("_mark", True).over(ahead)).where("_side = 0").select(*keys, "_row.*", "next_line")


def brace_entities(starts: DataFrame, rows: DataFrame, fallback: int = 80) -> DataFrame:
    """starts with end_line: the first line at or after the start where a brace
    has been opened and the depth is back at that before the start; without one
    the start plus ``fallback``.

    A line closes the levels between its deepest point and the depth after it, so
    the end of a start is the next line that closes its level: a sorted pass over
    both, in proportion to the braces of a file.
    """
    deep = depths(rows)
    begin = starts.join(deep.select("path", F.col("line_no").alias("start_line"), F.col("before").alias("level"), F.col("opened").alias("own")), ["path", "start_line"])
    begin = begin.withColumn("from_line", F.col("start_line") + F.when(F.col("own") > 0, 0).otherwise(1))
    peak = F.col("before") + F.col("opened")
    marks = deep.where(F.col("line").contains("}") & (peak > F.col("after"))).select("path", "line_no", F.explode(F.sequence(F.col("after"), peak - 1)).alias("level"))
    ends = _next_at(begin, marks, ["path", "level"])
    end = F.when(F.col("next_line") > F.col("start_line"), F.col("next_line")).otherwise(F.col("start_line") + fallback)
    return ends.select(*starts.columns, end.cast("int").alias("end_line"))


def indent_entities(starts: DataFrame, rows: DataFrame, fallback: int = 80) -> DataFrame:
    """starts with end_line: the last line before the next one that is not blank
    and not indented further; the file's last line if there is none.

    A line ends the levels between its indent and that of the solid line before
    it, so ends come from a sorted pass over both, in proportion to the text.
    """
    solid = rows.where(F.trim("line") != "").withColumn("indent", F.length("line") - F.length(F.ltrim("line")))
    last = rows.groupBy("path").agg(F.max("line_no").alias("last_line"))
    before = F.lag("indent").over(Window.partitionBy("path").orderBy("line_no"))
    closing = solid.withColumn("before", before).where("before >= indent")
    marks = closing.select("path", "line_no", F.explode(F.sequence("indent", "before")).alias("level"))
    begin = starts.join(solid.select("path", F.col("line_no").alias("start_line"), F.col("indent").alias("level")), ["path", "start_line"])
    ends = _next_at(begin.withColumn("from_line", F.col("start_line") + 1), marks, ["path", "level"])
    ends = ends.select("path", "kind", "name", "start_line", (F.col("next_line") - 1).alias("end_line"))
    out = starts.join(ends, ["path", "kind", "name", "start_line"], "left").join(last, "path")
    return out.withColumn("end_line", F.coalesce("end_line", "last_line").cast("int")).drop("last_line")


def _ends(rows: DataFrame, begin: Column, marks: Column) -> DataFrame:
    """(path, kind, name, start_line, last_line, next_line): what rows (path,
    line_no, decl, last_line) declare, with the first line at or after ``begin``
    (level, from_line) that has its level among the levels ``marks``. Rows that
    are dealt out by path stay where they are: no join and no shuffle."""
    row = lambda level, at, side, decl: F.struct(level.cast("int").alias("level"), at.cast("int").alias("at"), F.lit(side).alias("side"), decl.alias("decl"))
    none = F.lit(None).cast("string")
    own = F.when(F.col("decl").isNotNull(), F.array(row(begin["level"], begin["from_line"], 0, F.col("decl"))))
    closed = F.transform(marks, lambda level: row(level, F.col("line_no"), 1, none))
    both = F.concat(*[F.coalesce(x, F.array().cast("array<struct<level:int,at:int,side:int,decl:string>>")) for x in (own, closed)])
    each = rows.select("path", "line_no", "last_line", F.inline(both))
    ahead = Window.partitionBy("path", "level").orderBy(F.desc("at"), F.desc("side")).rowsBetween(Window.unboundedPreceding, 0)
    told = each.withColumn("next_line", F.last(F.when(F.col("side") == 1, F.col("line_no")), True).over(ahead)).where("side = 0")
    kind, name = F.substring_index("decl", " ", 1), F.substring_index("decl", " ", -1)
    return told.select("path", kind.alias("kind"), name.alias("name"), F.col("line_no").alias("start_line"), "last_line", "next_line")


def _numbered(files: DataFrame, masked: bool) -> DataFrame:
    """(path, lang, line_no, line, last_line, decl) of files, dealt out by path."""
    dealt = files.select("path", "text").repartition("path")
    rows = (masked_lines(dealt) if masked else lines(dealt)).withColumn("lang", language(F.col("path")))
    return rows.select("*", _declared().alias("decl"))


def braced_entities(files: DataFrame, fallback: int = 80) -> DataFrame:
    """``brace_entities`` of the declarations of files (path, text) without their
    comments: texts go through one shuffle, lines through none."""
    deep = depths(_numbered(files, True)).withColumn("last_line", F.lit(None).cast("int"))
    begin = F.struct(F.col("before").alias("level"), (F.col("line_no") + F.when(F.col("opened") > 0, 0).otherwise(1)).alias("from_line"))
    peak = F.col("before") + F.col("opened")
    marks = F.when(F.col("line").contains("}") & (peak > F.col("after")), F.sequence(F.col("after"), peak - 1))
    end = F.when(F.col("next_line") > F.col("start_line"), F.col("next_line")).otherwise(F.col("start_line") + fallback)
    return _ends(deep, begin, marks).select("path", "kind", "name", "start_line", end.cast("int").alias("end_line"))


def indented_entities(files: DataFrame) -> DataFrame:
    """``indent_entities`` of the declarations of files (path, text): texts go
    through one shuffle, lines through none."""
    rows = _numbered(files, False).withColumn("last_line", F.max("line_no").over(Window.partitionBy("path")))
    solid = rows.where(F.trim("line") != "").withColumn("indent", F.length("line") - F.length(F.ltrim("line")))
    solid = solid.withColumn("before", F.lag("indent").over(Window.partitionBy("path").orderBy("line_no")))
    begin = F.struct(F.col("indent").alias("level"), (F.col("line_no") + 1).alias("from_line"))
    ends = _ends(solid, begin, F.when(F.col("before") >= F.col("indent"), F.sequence("indent", "before")))
    return ends.select("path", "kind", "name", "start_line", F.coalesce(F.col("next_line") - 1, "last_line").cast("int").alias("end_line"))


#: A string on one line, a closed block comment, a block comment that stays open, or a line comment. Groups repeat possessively:
#: Java would call itself for each turn of another one, and lines may have megabytes.
STRINGS = r"""\"(?:[^\"\\]++|\\.)*+\"|'(?:[^'\\]++|\\.)*+'|`(?:[^`\\]++|\\.)*+`"""
COMMENTS = rf"""({STRINGS})|/\*.*?\*/|(/\*.*$)|//.*$"""


def _bare(line: Column) -> Column:
    """(line, opened): a line without the comments that end on it, and the block
    comment that stays open."""
    marked = F.contains(line, F.lit("/*"))
    opened = F.when(marked, F.array_join(F.regexp_extract_all(line, F.lit(COMMENTS), F.lit(2)), "")).otherwise("")
    bare = F.when(marked | F.contains(line, F.lit("//")), F.regexp_replace(line, COMMENTS, "$1$2")).otherwise(line)
    return F.struct(bare.alias("line"), opened.alias("opened"))


def _outside(line: Column, opened: Column, inside: Column) -> Column:
    """What of a bare line is no block comment over several lines."""
    closes = F.contains(line, F.lit("*/"))
    return (
        F.when(inside & ~closes, F.lit(""))
        .when(inside, F.substring(line, F.instr(line, "*/") + 2, F.length(line)))
        .when(opened != "", F.substring(line, F.lit(1), F.length(line) - F.length(opened)))
        .otherwise(line)
    )


def mask_comments(rows: DataFrame) -> DataFrame:
    """lines without // and /* */ comments; strings stay and so do line numbers.

    Comments within a line go by one pattern that steps over strings; a block
    comment over several lines is told by the marks that are still open. Cost is
    in proportion to a line's length.
    """
    bare = rows.select("path", "line_no", _bare(F.col("line")).alias("x")).select("path", "line_no", "x.*")
    run = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    state = F.last(F.when(F.col("opened") != "", F.lit(1)).when(F.col("line").contains("*/"), F.lit(0)), True).over(run)
    held = bare.withColumn("inside", F.coalesce(state, F.lit(0)) == 1)
    return held.select("path", "line_no", _outside(F.col("line"), F.col("opened"), F.col("inside")).alias("line"))


def masked_lines(files: DataFrame) -> DataFrame:
    """``mask_comments`` of the lines of files (path, text), without a shuffle or a
    sort: a file has one letter for each line, whether it opens or closes a block
    comment, and those after an open one are told in one pass over the letters."""
    parts = files.select("path", F.transform(F.split("text", "\n"), _bare).alias("parts"))
    letter = lambda x: F.when(x["opened"] != "", "o").when(F.contains(x["line"], F.lit("*/")), "c").otherwise("-")
    before = F.substring(F.concat(F.lit("-"), F.array_join(F.transform("parts", letter), "")), F.lit(1), F.size("parts"))
    states = F.split(F.regexp_replace(before, r"(?<=o)-|(?!^)\G-", "i"), "")
    lines_ = F.zip_with("parts", states, lambda x, s: _outside(x["line"], x["opened"], s.isin("o", "i")))
    return parts.select("path", F.posexplode(lines_).alias("n", "line")).select("path", (F.col("n") + 1).alias("line_no"), "line")


def enclosing_symbol(wanted: DataFrame, starts: DataFrame) -> DataFrame:
    """wanted (path, line) with the last declaration at or above each line: a
    running value over the union, not a join."""
    both = wanted.select("path", F.col("line").alias("at"), F.lit(None).cast("string").alias("decl"), F.lit(1).alias("side")).unionByName(
        starts.select("path", F.col("start_line").alias("at"), F.col("name").alias("decl"), F.lit(0).alias("side"))
    )
    run = Window.partitionBy("path").orderBy("at", "side", "decl").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("name", F.last("decl", True).over(run))
    return seen.where("side = 1").select("path", F.col("at").alias("line"), "name")


def enclosing_declaration(files: DataFrame, wanted: Column, kinds: tuple[str, ...]) -> DataFrame:
    """``enclosing_symbol`` of the lines of files (path, text) for which ``wanted``
    holds, by declarations of some kinds: texts go through one shuffle."""
    name = F.when(F.substring_index("decl", " ", 1).isin(*kinds), F.substring_index("decl", " ", -1))
    run = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = _numbered(files, False).select("path", "line_no", wanted.alias("wanted"), name.alias("name"))
    return rows.withColumn("name", F.last("name", True).over(run)).where("wanted").select("path", F.col("line_no").alias("line"), "name")


def calls(rows: DataFrame) -> DataFrame:
    """(path, line_no, callee): names before an opening bracket."""
    found = rows.select("path", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*)\s*\("), F.lit(1))).alias("callee"))
    return found.where(~F.col("callee").isin(*CONTROL_WORDS))


def imports(rows: DataFrame, cap: int = 80) -> DataFrame:
    """(path, ref): distinct imports of each file in order, at most ``cap``."""
    lang = language(F.col("path"))
    js = F.regexp_extract("line", r"""(?:\bfrom\s*|\brequire\s*\(\s*|^\s*import\s+)["']([^"']+)["']""", 1)
    py = F.regexp_extract("line", r"^\s*(?:from\s+([A-Za-z_.][A-Za-z0-9_.]*)\s+import|import\s+([A-Za-z_][A-Za-z0-9_.]*))", 1)
    py2 = F.regexp_extract("line", r"^\s*import\s+([A-Za-z_][A-Za-z0-9_.]*)", 1)
    java = F.regexp_extract("line", r"^\s*import\s+(?:static\s+)?([A-Za-z_][A-Za-z0-9_.]*);", 1)
    ref = F.when(lang == "javascript/typescript", js).when(lang == "python", F.when(py != "", py).otherwise(py2)).when(lang == "java", java).otherwise("")
    found = rows.withColumn("ref", ref).where("ref <> ''").groupBy("path", "ref").agg(F.min("line_no").alias("at"))
    order = Window.partitionBy("path").orderBy("at", "ref")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).select("path", "ref")


def resolve_imports(found: DataFrame, files: DataFrame) -> DataFrame:
    """(path, ref, target): relative imports with the first suffix that names a
    file. An equality join on the candidates, not a search."""
    base = F.regexp_replace("path", "/?[^/]*$", "")
    candidate = resolve_dots(F.concat_ws("/", base, "ref"))
    tries = found.where(F.col("ref").startswith(".")).select("path", "ref", candidate.alias("base"))
    # A file is reached by its path without each suffix that it has: few rows, where each import would make one for every suffix.
    stem = lambda tail: F.substring(F.col("target"), F.lit(1), F.length("target") - len(tail))
    named = [F.when(F.col("target").endswith(tail), F.struct(stem(tail).alias("base"), F.lit(i).alias("prio"))) for i, tail in enumerate(IMPORT_SUFFIXES)]
    each = files.select(F.col("path").alias("target")).select("target", F.inline(F.array_compact(F.array(*named))))
    hit = tries.join(each, "base")
    return hit.groupBy("path", "ref").agg(F.min_by("target", "prio").alias("target"))


def source_tree_summary(files: DataFrame, top: int = 12) -> DataFrame:
    """(extension, files, bytes, rank): extensions by total size."""
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    sums = files.groupBy(extension.alias("extension")).agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))
    order = Window.orderBy(F.desc("bytes"), "extension")
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)  # one row for each extension


def statements(rows: DataFrame, terms: tuple[str, ...], cap: int = 80) -> DataFrame:
    """(path, term, line_no, kind, defined, code): lines that hold one of
    ``terms`` (in lower case, a parameter), at most ``cap`` of each file and term."""
    low = F.lower("line")
    hit = rows.select("*", F.explode(F.filter(F.array(*map(F.lit, terms)), lambda t: low.contains(t))).alias("term"))
    order = Window.partitionBy("path", "term").orderBy("line_no")
    few = hit.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap)
    code = F.trim("line")
    defined = F.regexp_extract("line", r"^\s*(?:const|let|var)?\s*([A-Za-z_$][A-Za-z0-9_$.]*)\s*(?:[+\-*/|&]?=)[^=>]", 1)
    kind = (
        F.when(code.startswith("import") | code.contains("require("), "import")
        .when(code.rlike(r"^(?:export\s+)?(?:async\s+)?(?:function|class|def)\b"), "declaration")
        .when(code.startswith("return"), "return")
        .when(code.rlike(r"^(?:if|else|while|for|switch)\b"), "condition")
        .when(defined != "", "assignment")
        .when(code.contains("("), "call")
        .otherwise("other")
    )
    return few.select("path", "term", "line_no", kind.alias("kind"), defined.alias("defined"), F.substring(code, 1, 500).alias("code"))


#: Beginnings of defined names that uses are compared with before they are shuffled, at most.
HEADS = 20_000


def def_use(rows: DataFrame, per_def: int = 12) -> DataFrame:
    """(symbol, path, def_line, use_path, use_line, relation) from statements
    (path, line_no, defined, code): the first uses of each definition by path and
    line; in one file a use comes after its definition.

    Whatever the definition, its uses in other files are among the first
    ``per_def`` of the first ``per_def`` + 1 files that have some, and those in
    its own file are the next ones by position. So a definition meets a bounded
    number of uses even of a symbol that all files hold. Names go through one
    shuffle; uses are picked beside the definition, without a row for each pair.
    """
    rows = kept(rows.select("path", "line_no", "defined", "code"), "statements")
    head = lambda s: F.substring(s, 1, 2)
    known = [r[0] for r in rows.where("defined <> ''").select(head(F.col("defined"))).distinct().limit(HEADS + 1).collect()]
    words = F.array_distinct(F.regexp_extract_all("code", F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0)))
    if len(known) <= HEADS:
        words = F.filter(words, lambda w: head(w).isin(known))
    named = lambda s, use: F.struct(s.alias("symbol"), F.lit(use).alias("use"))
    defined = F.filter(F.array(F.col("defined")), lambda d: d != "")
    marks = F.concat(F.transform(words, lambda w: named(w, True)), F.transform(defined, lambda d: named(d, False)))
    placed = rows.select("path", "line_no", F.inline(marks)).repartition("symbol")
    lines_of = lambda test: F.array_sort(F.array_distinct(F.collect_list(F.when(test, F.col("line_no")))))
    in_file = placed.groupBy("symbol", "path").agg(lines_of(F.col("use")).alias("uses"), lines_of(~F.col("use")).alias("defs"))
    # Files are counted where they have uses; those with definitions alone come along.
    by_path = Window.partitionBy("symbol").orderBy("path")
    numbered = in_file.withColumn("f", F.count(F.when(F.size("uses") > 0, 1)).over(by_path))
    first = numbered.where((F.size("uses") > 0) & (F.col("f") <= per_def + 1))
    shared = first.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("path", F.slice("uses", 1, per_def).alias("at")))).alias("files"))
    defs = in_file.where(F.size("defs") > 0).select("symbol", F.col("path").alias("def_path"), "uses", F.explode("defs").alias("def_line"))
    met = defs.join(shared, "symbol")
    own = F.array(F.struct(F.col("def_path").alias("path"), F.slice(F.filter("uses", lambda u: u > F.col("def_line")), 1, per_def).alias("at")))
    around = F.concat(F.filter("files", lambda x: x["path"] < F.col("def_path")), own, F.filter("files", lambda x: x["path"] > F.col("def_path")))
    pairs = F.flatten(F.transform(around, lambda x: F.transform(x["at"], lambda at: F.struct(x["path"].alias("use_path"), at.alias("use_line")))))
    few = met.select("symbol", "def_path", "def_line", F.inline(F.slice(pairs, 1, per_def)))
    same = F.col("def_path") == F.col("use_path")
    return few.select("symbol", "def_path", "def_line", "use_path", "use_line", F.when(same, "local_def_use").otherwise("cross_file_def_use").alias("relation"))

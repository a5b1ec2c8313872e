"""Readers: issues, result logs, code files, snapshots, image headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ISSUE_SCHEMA = """instance_id STRING, id STRING, repo STRING, repository STRING, problem_statement STRING, language STRING,
base_commit STRING, patch STRING, files STRING, _bad STRING"""

# Files that are read as code, folders that are not entered.
TEXT_EXTENSIONS = (
    ".py", ".pyi", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".java", ".c", ".h", ".css", ".scss", ".less", ".json",
    ".yaml", ".yml", ".md", ".mdx", ".html", ".vue", ".svelte",
)
SKIPPED_FOLDERS = (".git", "node_modules", ".cache", "dist", "build", "coverage", ".next", "__pycache__", "target", ".tox", ".venv")


def read_issues(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(instance_id, repo, issue_text, language, base_commit, patch, files) from
    JSON lines. ``id`` and ``repository`` stand in for missing names. A bad line
    or a row without an id is an error that names the file, raised by the action
    that meets it; with ``strict`` off such rows are left out."""
    raw = spark.read.schema(ISSUE_SCHEMA).option("columnNameOfCorruptRecord", "_bad").json(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("_file"))
    key = F.coalesce("instance_id", "id")
    wrong = F.col("_bad").isNotNull() | key.isNull()
    if strict:
        why = F.concat(F.lit("bad issue in "), F.col("_file"), F.lit(": "), F.substring(F.coalesce("_bad", F.lit("no instance_id")), 1, 80))
        key = F.when(wrong, F.raise_error(why).cast("string")).otherwise(key)
    else:
        raw = raw.where(~wrong)
    return raw.select(
        key.alias("instance_id"),
        F.coalesce("repo", "repository").alias("repo"),
        F.coalesce("problem_statement", F.lit("")).alias("issue_text"),
        "language",
        "base_commit",
        "patch",
        "files",
    )


def gold_files(issues: DataFrame) -> DataFrame:
    """(instance_id, item) of the field ``files``: a JSON list as it is, a string
    by lines, trimmed, without blanks."""
    listed = F.from_json("files", "array<string>")
    lines = F.filter(F.transform(F.split("files", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return issues.where("files is not null").select(
        "instance_id", F.explode(F.when(F.ltrim("files").startswith("["), listed).otherwise(lines)).alias("item")
    )


def read_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = TEXT_EXTENSIONS, max_bytes: int = 1_000_000) -> DataFrame:
    """(path, text) of the code files under ``root``. Name and size decide
    before any content is decoded."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    wanted = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*extensions)
    kept = found.where((F.col("length") <= max_bytes) & wanted & ~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED_FOLDERS))))
    return kept.select("path", F.decode("content", "UTF-8").alias("text")).where("text <> ''")


def read_results(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Stored result rows: bad lines are left out, or an error if ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def snapshot_files(snapshots: DataFrame, checkout: DataFrame | None = None) -> DataFrame:
    """(snapshot_id, path, text) of snapshots (snapshot_id, structure: JSON map of
    path to {text, ...}). A snapshot's file wins over the checkout's."""
    nodes = F.from_json("structure", "map<string, struct<text: string>>")
    own = snapshots.select("snapshot_id", F.explode(nodes).alias("path", "node")).select("snapshot_id", "path", F.col("node.text").alias("text"))
    if checkout is None:
        return own
    rest = checkout.join(own.select("snapshot_id", "path"), ["snapshot_id", "path"], "left_anti")
    return own.unionByName(rest.select("snapshot_id", "path", "text"))


# --- images -----------------------------------------------------------------------


def _number(content: Column, at: int, size: int, little: bool = False) -> Column:
    """An unsigned integer of ``size`` bytes at a place counted from 1."""
    digits = F.hex(F.substring(content, at, size))
    if little:
        digits = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.conv(digits, 16, 10).cast("int")


def image_headers(images: DataFrame) -> DataFrame:
    """images (path, content) with format, width, height, processable and reason,
    told by the first bytes; width and height where the header has them at a
    fixed place (png, gif)."""
    head = F.hex(F.substring("content", 1, 12))
    kind = (
        F.when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("47494638"), "gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
        .when(F.lower(F.decode(F.substring("content", 1, 256), "ISO-8859-1")).contains("<svg"), "svg")
        .otherwise("unknown")
    )
    rows = images.select("path", "content", kind.alias("format"), F.length("content").alias("size"))
    width = F.when(F.col("format") == "png", _number(F.col("content"), 17, 4)).when(F.col("format") == "gif", _number(F.col("content"), 7, 2, True))
    height = F.when(F.col("format") == "png", _number(F.col("content"), 21, 4)).when(F.col("format") == "gif", _number(F.col("content"), 9, 2, True))
    raster = F.col("format").isin("png", "jpeg", "gif", "webp")
    reason = F.when(F.col("size") == 0, "empty_file").when(raster, "ok").when(F.col("format") == "svg", "vector_image").otherwise("unknown_format")
    return rows.select("path", "format", "size", width.alias("width"), height.alias("height"), (raster & (F.col("size") > 0)).alias("processable"), reason.alias("reason"))


def image_folder(spark: SparkSession, root: str) -> DataFrame:
    return image_headers(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content"))

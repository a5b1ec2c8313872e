"""Secret scan: candidate strings, then a random forest that removes false
positives.

Candidates are values assigned to a name and long opaque strings, of any length.
A finding is described by its length, its character transitions, the share of it
that dictionary words cover, its path (source) and the words beside it. The
forest is trained on labelled findings and scores every candidate.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ship_package, table, written
from .labelled_findings import invented

#: Labelled findings that train the forest, at most (about).
SAMPLE = 20_000

# Words that name a secret or an identifier that is none.
SECRET_WORDS = "token|secret|password|passwd|pwd|api_?key|access_?key|auth|credential|private_?key|encryption_?key|bearer"
HARMLESS_WORDS = "sha|sha1|sha256|md5|commit|digest|checksum|uuid|id|hash|etag|version|revision|integrity|example|test|placeholder|dummy"
KNOWN_FORMS = (
    r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_.-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----)$"
)

_NAME = r"[\p{L}_][\p{L}\p{N}_.\-]{0,60}+"
_SIGN = r"[\"']? ?(?::=|=>|[=:]) ?"
#: A value assigned to a name of a secret (quoted, of 4 letters or more, or the run up to a blank), to any name (quoted,
#: of 8 or more, or an unquoted run of 8 or more with a digit), and an opaque run of 16 or more with a digit, with what
#: follows its dots (``_dotted`` keeps the parts of 4 letters or more). A run may be as long as it is: no group repeats
#: without a bound, as Java calls itself for each turn of one.
CANDIDATE = "|".join(
    (
        rf"(?<![\p{{L}}\p{{N}}_.\-])(?=[\p{{L}}\p{{N}}_.\-]{{0,60}}?(?i:{SECRET_WORDS})){_NAME}{_SIGN}(?:\"[^\"\n]{{4,}}+\"|'[^'\n]{{4,}}+'|[^\s\"',;]{{4,}}+)",
        rf"(?<![\p{{L}}\p{{N}}_.\-]){_NAME}{_SIGN}(?:\"[^\"\s]{{8,}}+\"|'[^'\s]{{8,}}+'|(?=[^\s\"',;0-9]*[0-9])[^\s\"',;]{{8,}}+)",
        r"(?<![A-Za-z0-9_+/\-=@.])(?=[A-Za-z_+/\-]*[0-9])[A-Za-z0-9_+/\-]{16,}+={0,2}(?:\.[A-Za-z0-9_.\-]*+)?(?![A-Za-z0-9_+/\-@])",
        r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
    )
)
_BESIDE = 40
#: Stands at the cuts of a text; a text that has it is cut by a slower way.
MARK = "\ufdd0"


def _cut(text: Column) -> Column:
    """The text cut at the candidates: gap, candidate, gap, ..., gap."""
    quick = F.split(F.regexp_replace(text, f"({CANDIDATE})", f"{MARK}$1{MARK}"), MARK, -1)
    gaps, found = F.split(text, CANDIDATE, -1), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    slow = F.flatten(F.zip_with(gaps, found, lambda g, m: F.when(m.isNull(), F.array(g)).otherwise(F.array(g, m))))
    return F.when(text.contains(MARK), slow).otherwise(quick)


def _dotted(run: Column) -> Column:
    """A run up to the first part behind a dot that is shorter than 4 letters."""
    parts = F.split(run, r"\.")
    short = F.array_position(F.transform(parts, lambda p, i: (i > 0) & (F.length(p) < 4)), F.lit(True)).cast("int")
    return F.when(short > 0, F.array_join(F.slice(parts, F.lit(1), F.greatest(short - 1, F.lit(1))), ".")).otherwise(run)


def findings(docs: DataFrame, path: str = "source") -> DataFrame:
    """(doc_id, path, start, value, name, before, after): every candidate of
    every whole text, start in code points from 0.

    Only a candidate and ``_BESIDE`` letters on either side leave a text, so a
    very long text with very many candidates costs in proportion. A missing path
    column or value counts as an empty path; null and empty texts have none;
    repeated rows have theirs each. Other columns are ignored.
    """
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), where.alias("path"), _cut(F.col("text").cast("string")).alias("parts"))
    beside = lambda p, i: F.struct(
        F.length(F.get("parts", i - 1)).alias("gap"),
        p.alias("match"),
        F.substring(F.get("parts", i - 1), -_BESIDE, _BESIDE).alias("before"),
        F.substring(F.get("parts", i + 1), 1, _BESIDE).alias("after"),
    )
    each = rows.select(
        "row", "doc_id", "path", F.posexplode(F.filter(F.transform("parts", lambda p, i: F.when(i % 2 == 1, beside(p, i))), lambda x: x.isNotNull())).alias("n", "x")
    ).select("row", "doc_id", "path", "n", "x.*")
    each = written(each, "secret-matches")
    run = Window.partitionBy("row").orderBy("n")
    placed = each.withColumn("at", F.sum((F.col("gap") + F.length("match")).cast("long")).over(run) - F.length("match"))
    assigned = rf"^({_NAME}){_SIGN}([\"']?)(?=.)"
    named = F.col("match").rlike(rf"^{_NAME}{_SIGN}") & ~F.col("match").rlike(KNOWN_FORMS)
    head = F.length(F.regexp_extract("match", rf"^{_NAME}{_SIGN}[\"']?", 0))
    body = F.when(named, F.substring(F.col("match"), head + 1, F.length("match"))).otherwise(F.col("match"))
    quoted = F.regexp_extract("match", assigned, 2) != ""
    value = F.when(named & quoted, F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(F.regexp_replace(body, r"[.:!?)]+$", ""))
    opaque = ~named & ~F.col("match").startswith("-----")
    value = F.when(opaque, _dotted(F.col("match"))).otherwise(value)
    return placed.select(
        "doc_id",
        "path",
        (F.col("at") + F.when(named, head).otherwise(0)).alias("start"),
        value.alias("value"),
        F.when(named, F.lower(F.regexp_extract("match", assigned, 1))).otherwise("").alias("name"),
        "before",
        "after",
    )


def _count(s: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(s, F.lit(pattern), F.lit(0))).cast("double")


def _transitions(s: Column) -> Column:
    """Changes between digits, capitals, small letters and the rest, for each
    pair of neighbours."""
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[a-z]", "l"), "[A-Z]", "u"), r"\d", "d")
    runs = F.length(F.regexp_replace(F.regexp_replace(classes, r"[^lud]", "o"), r"(.)\1+", "$1"))
    return (runs - 1) / F.greatest(F.length(s) - 1, F.lit(1))


FEATURES = ("known", "size", "distinct", "transitions", "digits", "hex", "capitals", "words", "assigned", "secret_name", "harmless_name", "secret_near", "harmless_near", "path_test", "path_code", "mark_near", "marks", "capped_words", "key_name")


def describe(found: DataFrame, dictionary: list[str]) -> DataFrame:
    """``found`` with the columns of ``FEATURES``. dictionary: common words, for
    the share of the value that they cover."""
    v = F.col("value")
    n = F.greatest(F.length(v), F.lit(1))
    covered = n - F.length(F.regexp_replace(F.lower(v), "(?:" + "|".join(sorted(dictionary, key=len, reverse=True)) + ")", ""))
    beside = F.lower(F.concat_ws(" ", "before", "after"))
    near = lambda words: beside.rlike(rf"(?<![\p{{L}}_])(?:{words})(?![\p{{L}}])").cast("double")
    named = lambda words, edge: F.col("name").rlike(rf"(?:^|{edge})(?:{words})(?:$|{edge})").cast("double")
    return found.select(
        "*",
        v.rlike(KNOWN_FORMS).cast("double").alias("known"),
        F.length(v).cast("double").alias("size"),
        (F.size(F.array_distinct(F.regexp_extract_all(v, F.lit("(?s)."), F.lit(0)))) / n).alias("distinct"),
        _transitions(v).alias("transitions"),
        (_count(v, r"\d") / n).alias("digits"),
        v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double").alias("hex"),
        (_count(v, "[A-Z]") / n).alias("capitals"),
        (covered / n).alias("words"),
        (F.col("name") != "").cast("double").alias("assigned"),
        F.col("name").rlike(SECRET_WORDS).cast("double").alias("secret_name"),
        named(HARMLESS_WORDS, r"[_.\-]").alias("harmless_name"),
        near(SECRET_WORDS).alias("secret_near"),
        near(HARMLESS_WORDS).alias("harmless_near"),
        F.lower("path").rlike("test|example|fixture|mock|sample").cast("double").alias("path_test"),
        F.lower("path").rlike(r"\.(?:py|js|ts|java|go|rb|env|ya?ml|json|ini|cfg|conf|tf)$").cast("double").alias("path_code"),
        F.coalesce(_count(F.concat_ws(" ", "before", "after"), r"[^\p{L}\p{N}\s]") / 80, F.lit(0.0)).alias("mark_near"),
        (_count(v, r"[^\p{L}\p{N}]") / n).alias("marks"),
        _count(v, r"\p{Lu}\p{Ll}{2}").alias("capped_words"),
        F.col("name").rlike(r"key\d*$").cast("double").alias("key_name"),
    )


def common_words(docs: DataFrame, n: int = 500, least: int = 4) -> list[str]:
    """The most frequent words of the corpus: the dictionary. n bounds what the
    driver sees; ties go to the smaller word."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"(?<![a-z])[a-z]{{{least},12}}(?![a-z])"), F.lit(0))).alias("w"))
    return [r.w for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(n).collect()]


def invented_findings(spark: SparkSession, dictionary: list[str]) -> DataFrame:
    """Described findings with a label, from the invented texts: for sessions
    without a reviewer's labels. Their number is fixed and small."""
    texts = spark.createDataFrame(invented(), "doc_id long, text string, source string, wanted string, label double")
    found = describe(findings(texts), dictionary)
    return found.join(texts.select("doc_id", F.col("wanted").alias("value"), "label"), ["doc_id", "value"])


def fit_forest(labelled: DataFrame, sample: int = SAMPLE, trees: int = 40, depth: int = 9, seed: int = 7):
    """A forest from described findings with a column label (0 or 1); None if
    either label is missing. About ``sample`` findings are used, by their hash."""
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    total = sum(counts.values())
    if total > sample:
        share = int((1 << 30) * sample / total)
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id", "start", "value"), F.lit(1 << 30)) < share)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(labelled.select("label", *FEATURES))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label")
    return forest.fit(vectors)


def score_findings(described: DataFrame, forest) -> DataFrame:
    if forest is None:
        return described.withColumn("score", F.lit(None).cast("double"))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(described)
    forest = forest.copy().setFeaturesCol("_features").setProbabilityCol("_probability").setRawPredictionCol("_raw").setPredictionCol("_prediction")
    return forest.transform(vectors).withColumn("score", vector_to_array("_probability")[1]).drop("_features", "_probability", "_raw", "_prediction")


def scan(docs: DataFrame, labels: DataFrame | None = None, path: str = "source", threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, length, value_sha256, name, path, score, is_secret), one
    row for each candidate; the value itself is not returned.

    labels (doc_id, start, label) are reviewed findings of ``docs``; without them
    ``invented_findings`` train the forest. Repeated rows of ``docs`` give
    repeated findings. An empty table gives none. Labels of one kind only give
    null scores, and then known key formats alone are secrets.
    """
    spark = docs.sparkSession
    ship_package(spark)
    dictionary = common_words(docs) or ["the"]
    described = written(describe(findings(docs, path), dictionary), "findings")
    if labels is None:
        labelled = invented_findings(spark, dictionary)
    else:
        own = labels.select(F.col("doc_id").cast("long"), F.col("start").cast("long"), F.col("label").cast("double")).dropDuplicates(["doc_id", "start"])
        labelled = described.join(own, ["doc_id", "start"])
    scored = score_findings(described, fit_forest(written(labelled.select("doc_id", "start", "value", "label", *FEATURES), "labelled")))
    secret = F.coalesce(F.col("score") >= threshold, F.col("value").rlike(KNOWN_FORMS))
    return scored.select(
        "doc_id",
        F.col("start").cast("long"),
        F.length("value").alias("length"),
        F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"),
        "name",
        "path",
        F.round("score", 6).alias("score"),
        secret.alias("is_secret"),
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))

"""Column helpers for paths, tokens and short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z_][A-Za-z0-9_.$-]*"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Whether ``text`` contains one of ``words``; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def matching(rules: dict[str, Column]) -> Column:
    """Labels of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(label)) for label, test in rules.items()]))


def first_of(rules: dict[str, Column], otherwise: str) -> Column:
    """Label of the first rule that holds."""
    out = None
    for label, test in rules.items():
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(otherwise)


def normalize_path(path: Column | str) -> Column:
    """Slashes forward, blanks trimmed, then every leading dot and slash cut."""
    return F.regexp_replace(F.trim(F.replace(col(path), F.lit("\\"), F.lit("/"))), "^[./]+", "")


def strip_dot_slash(path: Column | str) -> Column:
    """Only literal ``./`` prefixes are cut."""
    return F.regexp_replace(F.trim(F.replace(col(path), F.lit("\\"), F.lit("/"))), r"^(?:\./)+", "")


def resolve_dots(path: Column | str) -> Column:
    """``a/./b/../c`` becomes ``a/c``: a fold over the parts."""
    parts = F.filter(F.split(col(path), "/"), lambda p: (p != "") & (p != "."))
    up = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            (p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)
        ).otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(up, "/")


def tokens(text: Column | str) -> Column:
    """Identifiers of a text: each whole in lower case without edge marks, then
    its parts at camel humps; two letters or more. A plain word comes twice."""
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(TOKEN), F.lit(0))
    both = F.transform(
        found,
        lambda m: F.concat(
            F.array(F.regexp_replace(F.lower(m), r"^[._$-]+|[._$-]+$", "")),
            F.split(F.lower(F.regexp_replace(m, "([a-z0-9])([A-Z])", "$1 $2")), " "),
        ),
    )
    return F.filter(F.flatten(both), lambda t: F.length(t) >= 2)


def occurrences(text: Column, part: Column) -> Column:
    """Occurrences of ``part`` in ``text`` that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def collapse(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", " "))


def summarize(text: Column | str, limit: int) -> Column:
    """White space collapsed; beyond ``limit``: cut, right-trimmed and dotted."""
    whole = collapse(text)
    cut = F.concat(F.rtrim(F.substring(whole, 1, limit - 3)), F.lit("..."))
    return F.when(F.length(whole) <= limit, whole).otherwise(cut)


def clean_issue(text: Column | str) -> Column:
    """The body: up to the first adapter marker, without images and labels."""
    out = F.coalesce(col(text), F.lit(""))
    for marker in ADAPTER_MARKERS:
        out = F.substring_index(out, marker, 1)
    out = F.regexp_replace(out, r"!\[[^\]]*\]\([^)]*\)", "")
    return F.trim(F.regexp_replace(out, r"\[Original Issue\]\s*", ""))


# Text that adapters append to an issue begins with one of these.
ADAPTER_MARKERS = ("\n[Multimodal Context - Compact]", "\n[Adapter Note]", "\n[adapter_fallback=")

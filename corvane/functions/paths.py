"""Path predicates and classifiers as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folder names and suffixes that tell a file's role.
TEST_FOLDERS = ["__tests__", "test", "tests", "spec", "specs", "fixtures"]
DOC_FOLDERS = ["doc", "docs", "documentation"]
DOC_SUFFIXES = [".md", ".mdx", ".rst", ".adoc"]


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def slashed(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def basename(path: Column) -> Column:
    return F.regexp_extract(slashed(path), r"([^/]*)$", 1)


def role(path: Column) -> Column:
    """test before doc before source."""
    parts = F.split(F.lower(slashed(path)), "/")
    base = basename(path)
    test = base.rlike(r"(?i)\.(?:test|spec|bench)\.[a-z0-9]+$") | F.arrays_overlap(parts, F.array(*map(F.lit, TEST_FOLDERS)))
    doc = _any([F.lower(base).endswith(s) for s in DOC_SUFFIXES]) | F.arrays_overlap(parts, F.array(*map(F.lit, DOC_FOLDERS)))
    return F.when(test, "test").when(doc, "doc").otherwise("source")


# Content types in the order in which they are tried, each by a pattern of the path or of its base name.
CONTENT_TYPES = [
    ("readme", "base", r"^readme"),
    ("test", "base", r"^(test|tests|__tests__|spec|specs|__spec__)\b|\.(test|spec)\.[^.]+$"),
    ("documentation", "path", r"(^|/)((docs?|documentation|guides?|manual|tutorial)s?)(/|$)"),
    ("configuration", "path", r"(^|/)((config|conf|configuration|settings|env)s?)(/|$)"),
    ("configuration", "base", r"\.(config|conf)\.[^.]+$"),
    ("source", "path", r"(^|/)(src|source|lib|packages?|modules?)(/|$)"),
    ("build", "path", r"(^|/)(ci|cd|\.github|\.gitlab|build|deploy|scripts?)(/|$)"),
    ("example", "path", r"(^|/)(examples?|samples?|demos?)(/|$)"),
]


def content_type(path: Column) -> Column:
    """readme, test, documentation, configuration, source, build, example or nothing."""
    p = F.lower(slashed(path))
    of = {"path": p, "base": basename(p)}
    out = F.lit("")
    for name, part, pattern in reversed(CONTENT_TYPES):
        out = F.when(of[part].rlike(pattern), name).otherwise(out)
    return out


def glob_regex(pattern: str) -> str:
    """``**`` crosses folders, ``*`` and ``?`` don't; anchored."""
    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", pattern):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return f"^{out}$"


def glob(path: Column, patterns: list[str]) -> Column:
    return _any([path.rlike(glob_regex(p)) for p in patterns])


def glob_like(path: Column, patterns: list[str]) -> Column:
    """The SQL stores' form: any star crosses folders."""
    like = lambda p: p.replace("**", "*").replace("*", "%").replace("?", "_")
    return _any([path.like(like(p)) for p in patterns])


def extensions(given: list[str]) -> list[str]:
    """Trimmed, lower-cased, with one leading dot, without repeats or blanks."""
    out = ["." + e.strip().lower().lstrip(".") for e in given]
    return list(dict.fromkeys(e for e in out if e != "."))


def has_extension(path: Column, given: list[str]) -> Column:
    """True for an empty list."""
    wanted = extensions(given)
    return _any([F.lower(path).endswith(e) for e in wanted]) if wanted else F.lit(True)


def excluded(path: Column, names: list[str], globs: list[str]) -> Column:
    """A path segment has one of the names, or the base name or path fits a glob; case doesn't matter."""
    p = F.lower(slashed(path))
    by_name = F.arrays_overlap(F.split(p, "/"), F.array(*[F.lit(n.lower()) for n in names])) if names else F.lit(False)
    plain = [g.lower() for g in globs]
    return by_name | _any([(p if "/" in g else basename(p)).rlike(glob_regex(g)) for g in plain])


def included(path: Column, globs: list[str]) -> Column:
    """The path or a folder above it fits a root-anchored glob; an empty list has all."""
    return _any([F.lower(path).rlike(glob_regex(g.lower())[:-1] + "(/.*)?$") for g in globs]) if globs else F.lit(True)


def metadata_filter(
    path: Column, language: Column, kind: Column, paths: list[str] = (), languages: list[str] = (), kinds: list[str] = (), file_extensions: list[str] = ()
) -> Column:
    """All given keys hold; a key holds if any of its values does."""
    out = F.lit(True)
    if paths:
        out &= glob(path, list(paths))
    if languages:
        out &= language.isin(*languages)
    if kinds:
        out &= kind.isin(*kinds)
    return out & has_extension(path, list(file_extensions))


def query_shape(query: Column) -> Column:
    q = F.trim(query)
    one = r"^[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*$"
    return F.when((F.length(q) <= 60) & q.rlike(one), "symbol").otherwise("natural-language")

"""Parsers and builders of short texts."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import paths


def namespace(raw: Column, decomposed: bool = False) -> Column:
    """Runs of other than [A-Za-z0-9_] as one underscore, outer ones off, 40 characters; 'default' for nothing.

    decomposed: ``raw`` is in NFKD already; Spark has no normaliser, so accented
    letters become underscores otherwise.
    """
    out = F.regexp_replace(F.regexp_replace(raw, "[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")
    return F.when(out == "", "default").otherwise(F.substring(out, 1, 40))


def title(path: Column, text: Column) -> Column:
    """A Markdown file's first heading of level 1 to 3, else the base name in title case; 80 characters."""
    base = F.regexp_replace(paths.basename(path), r"\.[^.]*$", "")
    named = F.regexp_replace(base, "[-_]+", " ")
    cased = F.array_join(F.transform(F.split(named, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), " ")
    head = F.trim(F.regexp_extract(text, r"(?m)^#{1,3}\s+(.+)$", 1))
    return F.substring(F.when(F.lower(path).rlike(r"\.mdx?$") & (head != ""), head).otherwise(cased), 1, 80)


def metadata_header(path: Column, text: Column, language: Column) -> Column:
    """[type] [top folder] [content type] title; empty parts are left out."""
    tag = lambda c: F.when(c != "", F.concat(F.lit("["), c, F.lit("]")))
    top = F.when(path.contains("/"), F.split_part(path, F.lit("/"), F.lit(1))).otherwise("")
    return F.concat_ws(" ", tag(language), tag(top), tag(paths.content_type(path)), title(path, text))


def embed_text(path: Column, header: Column, description: Column, content: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), path, F.lit("\n\n"), F.concat_ws("\n", header, description, content))


def labelled_lines(text: Column) -> Column:
    """A map from label to text of ``label: text`` lines; the first of a label wins."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^[A-Za-z0-9_.-]+:\s*\S"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([^:]+):", 1).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]+:\s*(.+)$", 1)).alias("v")))
    keys = F.transform(pairs, lambda p: p["k"])
    firsts = F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1)
    return F.map_from_entries(firsts)


def extracted(text: Column, kinds: list[str], most: int = 200) -> Column:
    """Structs (kind, content) of ``kind|content`` lines of known kinds and at most ``most`` characters."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    split = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^|]+)\|", 1)).alias("kind"), F.trim(F.regexp_extract(x, r"^[^|]+\|(.*)$", 1)).alias("content")))
    return F.filter(split, lambda p: p["kind"].isin(*kinds) & (F.length(p["content"]) > 0) & (F.length(p["content"]) <= most))


def review_date(raw: Column) -> Column:
    """The timestamp of an ISO date with or without a time; null for placeholders and other texts."""
    return F.try_to_timestamp(F.regexp_extract(F.trim(raw), r"^(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?)", 1))


def argmax(probabilities: Column) -> Column:
    """The key of the largest value of a map; the first of equals."""
    e = F.map_entries(probabilities)
    top = F.array_max(F.map_values(probabilities))
    return F.filter(e, lambda x: x["value"] == top)[0]["key"]


def decided(probability: Column) -> Column:
    """(yes, confidence) of a yes-or-no question: yes from one half, and how likely the answer is that is given."""
    yes = probability >= 0.5
    return F.struct(yes.alias("yes"), F.when(yes, probability).otherwise(1 - probability).alias("confidence"))


def chosen(probabilities: Column) -> Column:
    """(choice, confidence) of a map of probabilities: the largest, the first of equals."""
    return F.struct(argmax(probabilities).alias("choice"), F.array_max(F.map_values(probabilities)).alias("confidence"))


def level(score: Column, levels: Column) -> Column:
    """The one of an array of levels that a score from 0 rounds to, halves up, the last one beyond; null of no levels."""
    at = F.least(F.size(levels) - 1, F.greatest(F.lit(0), F.floor(score + 0.5).cast("int")))
    return F.when(score.isNotNull() & (F.size(levels) > 0), F.try_element_at(levels, F.greatest(at, F.lit(0)) + 1))


def ignore_lists(content: str) -> tuple[list[str], list[str]]:
    """Folder and file patterns of an ignore file, each without repeats in any case, sorted."""
    found: dict[str, dict[str, str]] = {"dirs": {}, "files": {}}
    for raw in content.splitlines():
        rule = raw.strip()
        if not rule or rule[0] in "#!":
            continue
        rule = rule[1:] if rule[:2] in ("\\#", "\\!") else rule
        folder = rule.endswith("/")
        rule = rule.removesuffix("/")
        if rule.startswith("**/"):
            folder, rule = True, rule[3:]
        rule = rule.removeprefix("/")
        for tail in ("/**", "/*"):
            if rule.endswith(tail):
                folder, rule = True, rule.removesuffix(tail)
                break
        if not rule:
            continue
        magic = any(c in rule for c in "*?[")
        to = ["dirs"] if folder or rule.endswith("**") else ["files"] if magic or ("/" not in rule and "." in rule) else ["dirs", "files"]
        for kind in to:
            found[kind].setdefault(rule.lower(), rule)
    return tuple(sorted(found[k].values(), key=str.lower) for k in ("dirs", "files"))  # type: ignore[return-value]


def _bare(value: str) -> str:
    """Without outer blanks and one pair of like quotes."""
    v = value.strip()
    return v[1:-1].strip() if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v


def _reviewed(raw: str) -> tuple[datetime | None, str | None]:
    """The time that a lastReviewed value tells, in UTC where it names no zone, or what is wrong with it."""
    v = _bare(raw)
    if not v:
        return None, "lastReviewed is empty"
    if v[0] == "<" and v[-1] == ">":
        return None, f'lastReviewed is an unreplaced placeholder ("{v}")'
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2})?(Z|[+-]\d{2}:?\d{2})?)?", v):
        for form in ("%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%d %b %Y", "%Y/%m/%d", "%m/%d/%Y"):
            try:
                return datetime.strptime(v, form).replace(tzinfo=timezone.utc), None
            except ValueError:
                pass
        return None, f'lastReviewed is not a date ("{v}")'
    try:
        at = datetime.fromisoformat(v)
    except ValueError:
        return None, f'lastReviewed is not a real date ("{v}")'
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc), None


def frontmatter(text: str) -> dict:
    """title, tags, source_refs and last_reviewed of a page's leading block, and what is wrong with it.

    The block starts with a first line --- and ends with --- or ...; without an end it
    reaches over the whole page. Of a key that comes again the last counts. A list
    stands in brackets, with commas, or in indented lines with hyphens below its key.
    """
    out: dict = {"present": False, "title": None, "tags": [], "source_refs": [], "last_reviewed": None, "issues": []}
    lines = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if lines[0].strip() != "---":
        return out
    out["present"] = True
    end = next((k for k, x in enumerate(lines) if k and x.strip() in ("---", "...")), None)
    if end is None:
        out["issues"].append("frontmatter block is never closed")
    keys: dict[str, tuple[str, list[str]]] = {}  # each key's last value, and the list below it
    key = None
    for line in lines[1:end]:
        item, pair = re.match(r"\s+-\s+(.*)$", line), re.match(r"([A-Za-z][\w-]*):[ \t]*(.*)$", line)
        if item and key:
            keys[key][1].append(_bare(item[1]))
        elif pair:
            key = pair[1]
            if key in keys:
                out["issues"].append(f'duplicate key "{key}" (last one wins)')
            keys[key] = (pair[2].strip(), [])
            if pair[2].strip():  # only a key without a value may have a list below it
                key = None
        else:
            key = None
    out["title"] = _bare(keys["title"][0]) or None if "title" in keys else None
    for name, to in (("tags", "tags"), ("sourceRefs", "source_refs")):
        value, below = keys.get(name, ("", []))
        inner = value[1:-1] if value[:1] == "[" and value[-1:] == "]" else value
        out[to] = below or [v for v in map(_bare, inner.split(",")) if v]
    if "lastReviewed" in keys:
        out["last_reviewed"], issue = _reviewed(keys["lastReviewed"][0])
        out["issues"] += [issue] if issue else []
    return out

"""Settings in layers, and the checked map from extensions to chunkers."""

from __future__ import annotations

import copy

from corvane.operators.chunking import REGISTRY


def layered(*layers: dict) -> dict:
    """Later layers over earlier ones: mappings are merged key by key, anything else is replaced; nothing given is changed.

    In order: defaults, the user's, the workspace's, what is set while running. A layer
    that leaves a part out keeps what is below; a null replaces.
    """
    out: dict = {}
    for layer in layers:
        for key, value in layer.items():
            both = isinstance(value, dict) and isinstance(out.get(key), dict)
            out[key] = layered(out[key], value) if both else copy.deepcopy(value)
    parsers = out.get("chunking", {}).get("parsers") if isinstance(out.get("chunking"), dict) else None
    if isinstance(parsers, dict):
        out["chunking"]["parsers"] = parser_overrides(parsers)
    return out


def extension_key(raw: object) -> str:
    """Trimmed, in lower case, with a leading dot; nothing for what is no extension."""
    key = raw.strip().lower() if isinstance(raw, str) else ""
    if not key or "/" in key or "\\" in key:
        return ""
    return key if key.startswith(".") else "." + key


def parser_overrides(given: object) -> dict[str, str]:
    """The valid entries of a map from extensions to languages, normalised."""
    if not isinstance(given, dict):
        return {}
    pairs = ((extension_key(k), v.strip().lower()) for k, v in given.items() if isinstance(v, str))
    return {k: v for k, v in pairs if k and v}


def parser_warnings(given: object) -> list[str]:
    """What is wrong with a map from extensions to languages, an entry a line."""
    if given is None:
        return []
    if not isinstance(given, dict):
        return ["the parsers must map file extensions to parser names"]
    known = {name for name, _ in REGISTRY.values()}
    out = []
    for key, value in given.items():
        if not extension_key(key):
            out.append(f"{key!r} is not a file extension")
        elif not isinstance(value, str) or not value.strip():
            out.append(f"{key!r} needs a parser name")
        elif value.strip().lower() not in known:
            out.append(f"{key!r}: {value.strip().lower()!r} is not a known parser; known are {', '.join(sorted(known))}")
    return out

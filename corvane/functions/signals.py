"""Rules over messages: what may be remembered, whether an output tells of a failure, and why it failed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import text as tx

# Patterns of texts that are not remembered.
BLOCKED = [
    r"(?i)\bskip\s+(?:\S+\s+)*?tests?\b", r"(?i)\bdisable\s+(lint|typecheck|strict)", r"(?i)\bignore\s+(all\s+)?errors", r"\brm\s+-rf\b",
    r"\bforce\s+push\b", r"\bgit\s+push\s+--force\b", r"(?i)\bdelete\s+.+\.git", r"(?i)\btouch\s+(?:\.env|withheld)", r"(?i)\bbypass\s+(?:security|review|check)",
]

# Classes of causes, the first that fits applies, and what is said of each.
CAUSES = [
    ("unknown-tool", r"(?i)unknown tool|no such tool|tool .*not found|not a registered tool"),
    ("schema", r"(?i)expected .*(received|but got)|invalid argument|invalid type|schema|must be (a|an|string|number|boolean|object|array)"),
    ("permissions", r"(?i)eacces|permission denied"),
    ("path", r"(?i)enoent|no such file or directory|cannot find module"),
    ("rate-limit", r"(?i)\b429\b|rate limit|too many requests"),
    ("timeout", r"(?i)timed? ?out|timeout|etimedout"),
    ("runtime", r"(?im)traceback \(most recent call last\)|^(?:type|reference|syntax|range|uri)error:"),
    ("tooling", r"(?i)npm err!|eresolve|peer dep"),
    ("crash", r"(?i)segmentation fault|core dumped|panic:"),
    ("exit-code", r"(?i)exited with code|command failed"),
]
ADVICE = {
    "unknown-tool": "the tool name may be wrong, or the tool is not available in this session",
    "schema": "the arguments do not match the tool's schema",
    "permissions": "the path may need different permissions",
    "path": "the path or module name may be wrong",
    "rate-limit": "the request was rate limited — retry later",
    "timeout": "the operation timed out",
    "runtime": "the program raised an unhandled exception",
    "tooling": "the package manager rejected the operation",
    "crash": "the process crashed",
    "exit-code": "the command exited with a non-zero status",
}

# Classes of signals in an output; the tools whose whole output is searched, and the one rule for others.
SIGNALS = [
    ("permissions", r"\b(EACCES|EPERM)\b"),
    ("path", r"\b(ENOENT|ENOTFOUND|EISDIR|ENOTDIR|EEXIST|ELOOP|ENOTEMPTY|ENAMETOOLONG)\b"),
    ("runtime", r"Traceback \(most recent call last\)"),
    ("runtime", r"(?m)^(?:Type|Reference|Syntax|Range|URI)Error:"),
    ("tooling", r"(?m)^npm ERR!"),
    ("crash", r"(?m)Segmentation fault|core dumped|panic:|Killed$"),
    ("exit-code", r"(?i)Command failed"),
    ("path", r"(?i)^Could not read file:"),
    ("exit-code", r"(?i)(?:^|\n)\s*(?:Error:\s*)?Exited with code\s+0*[1-9]"),
]
COMMAND_TOOLS = ["shell", "bash", "sh", "run", "exec", "command"]
READ_FAILURE = [("path", r"(?i)^Could not read file:")]
WARNED_OF = ["unknown-tool", "schema", "permissions", "path"]
ERROR_TAG, TOOL_TAG, CAUSE_TAG = "tool-error", "tool:", "cause:"


def allowed(text: Column) -> Column:
    """False where a blocked pattern is found; a null text is allowed."""
    return ~F.coalesce(tx.any_match(text, BLOCKED), F.lit(False))


def cause(text: Column) -> Column:
    """The class of a failure's cause, null where none fits."""
    return tx.first_match(text, CAUSES)


def signal(output: Column, command: Column | None = None, exit_code: Column | None = None, most: int = 20_000) -> Column:
    """The class of the failure that an output's last ``most`` characters tell of, null for none.

    A known exit code decides alone. command: whether a command made the output; other
    tools return files, whose text tells of nothing but that the file could not be read.
    """
    tail = F.regexp_replace(F.when(F.length(output) > most, F.substring(output, -most, most)).otherwise(output), "\u001b\\[[0-9;]*m", "")
    found = tx.first_match(tail, SIGNALS)
    if command is not None:
        found = F.when(command, found).otherwise(tx.first_match(tail, READ_FAILURE))
    if exit_code is not None:
        found = F.when(exit_code == 0, F.lit(None)).when(exit_code.isNotNull(), "exit-code").otherwise(found)
    return F.when(F.trim(output) != "", found)


def flat(error: Column, most: int = 400) -> Column:
    """White space collapsed, at most ``most`` characters."""
    return F.substring(F.trim(F.regexp_replace(error, r"\s+", " ")), 1, most)


def error_query(tool: Column, error: Column) -> Column:
    """What is searched for after a tool's failure."""
    return F.concat(F.lit('Tool "'), tool, F.lit('" failed: '), flat(error))


def lesson(tool: Column, error: Column, most: int = 300) -> Column:
    """What is remembered of a tool's failure: the error and, where its class is known, the advice."""
    kind = cause(error)
    said = F.lit(None)
    for name, advice in ADVICE.items():
        said = F.when(kind == name, F.lit(f" — {advice}")).otherwise(said)
    return F.substring(F.concat(F.lit("Tool `"), tool, F.lit("` failed: "), flat(error), F.coalesce(said, F.lit(""))), 1, most)


def worth_recording(error: Column, least: int = 15) -> Column:
    return F.length(flat(error, 1_000_000)) >= least


def tag_value(tags: Column, prefix: str) -> Column:
    """What follows the prefix in the first tag that has it; null for none."""
    return F.substring(F.try_element_at(F.filter(tags, lambda t: t.startswith(prefix)), F.lit(1)), len(prefix) + 1, 1000)


def stale(observed: Column, now: Column, half_life_days: float = 30) -> Column:
    """Whether something is older than twice its half-life; null of unknown age."""
    return (F.unix_timestamp(now) - F.unix_timestamp(observed)) / 86400 > 2 * half_life_days

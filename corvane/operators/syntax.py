"""Declarations of source texts: where they start and end, of what kind, and their names.

No grammar files are needed: strings and comments are blanked first, with every other
character in place, and declarations are told by the words before a block, whose braces
are then matched. Nested declarations are found too; ``outermost`` leaves them out.
Texts that do not parse give what can be told.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Unit:
    """A declaration: its places in the text, its kind and name."""

    start: int
    end: int
    kind: str
    name: str


@dataclass(frozen=True)
class Lexis:
    """What a language's comments and strings look like."""

    line: tuple[str, ...] = ("//",)
    block: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    quotes: str = "\"'"
    triple: bool = False  # three quotes open a string of several lines
    template: bool = False  # back quotes do, too
    char: bool = False  # single quotes hold one character only
    raw: str = ""  # a pattern of strings without escapes
    regex: bool = False  # slashes may hold a pattern


def _pattern(x: Lexis) -> re.Pattern:
    parts = [f"(?P<c{k}>{re.escape(a)}.*?(?:{re.escape(b)}|\\Z))" for k, (a, b) in enumerate(x.block)]
    parts += [f"(?P<l{k}>{a if a[0] == '(' else re.escape(a)}[^\\n]*)" for k, a in enumerate(x.line)]
    if x.raw:
        parts.append(f"(?P<r>{x.raw})")
    if x.triple:
        parts.append(r"(?P<t>\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z))")
    if x.template:
        parts.append(r"(?P<q>`(?:\\.|[^`\\])*(?:`|\Z))")
    if x.char:
        parts.append(r"(?P<h>'(?:\\.[^'\n]*|[^'\\\n])')")
    for k, q in enumerate(x.quotes):
        if not (x.char and q == "'"):
            parts.append(f"(?P<s{k}>{q}(?:\\\\.|[^{q}\\\\\\n])*(?:{q}|(?=\\n)|\\Z))")
    if x.regex:
        parts.append(r"(?P<x>(?:(?<=[=(,:\[!&|?{};\n])|(?<=\breturn))[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/)")
    return re.compile("|".join(parts), re.S)


_PATTERNS: dict[Lexis, re.Pattern] = {}


def masked(text: str, lexis: Lexis) -> str:
    """The text with comments blanked and strings' insides too; every line and place stays."""
    if lexis not in _PATTERNS:
        _PATTERNS[lexis] = _pattern(lexis)

    def blank(m: re.Match) -> str:
        s = m.group()
        return re.sub(r"[^\n]", " ", s) if m.lastgroup[0] in "clx" else s[0] + re.sub(r"[^\n]", " ", s[1:-1]) + s[-1:] if len(s) > 1 else s

    return _PATTERNS[lexis].sub(blank, text)


def closing(mask: str) -> dict[int, int]:
    """The place of each bracket's partner; an open one's is the end of the text."""
    pairs, held = {}, []
    for m in re.finditer(r"[(){}\[\]]", mask):
        c, i = m.group(), m.start()
        if c in "({[":
            held.append((c, i))
        else:
            want = {")": "(", "}": "{", "]": "["}[c]
            while held and held[-1][0] != want and want == "{":
                held.pop()  # a brace closes what was left open within
            if held and held[-1][0] == want:
                pairs[held.pop()[1]] = i
    return pairs | {i: len(mask) - 1 for _, i in held}


# A word before brackets and a block; what stands between the brackets and the block is tried apart.
_CALL = re.compile(r"([~#$\w.:\]\[\"']+)\s*(?:<[^;{}()]*>)?\s*$")
_NO_CALL = {
    "if", "for", "while", "switch", "catch", "return", "sizeof", "foreach", "using", "lock", "synchronized", "with", "elif", "else", "do", "try", "new",
    "function", "await", "typeof", "super", "this", "when", "unless", "until", "guard", "match", "fixed", "async", "yield", "throw", "delete", "in", "of", "and", "or", "not",
}


def _called(mask: str, low: int, brace: int, after: str) -> tuple[str, int] | None:
    """(name, start of the name) of a callable whose brackets stand before the block; ``after`` is what may stand between."""
    close, found = mask.rfind(")", low, brace), None
    while close >= 0:  # the leftmost that fits: what follows it may have brackets
        if re.fullmatch(after, mask[close + 1 : brace], re.S):
            depth, i = 0, close
            while i >= low:
                depth += (mask[i] == ")") - (mask[i] == "(")
                if not depth:
                    break
                i -= 1
            m = _CALL.search(mask[low:i]) if i > low else None
            if m and m[1].split(".")[-1] not in _NO_CALL and not m[1][0].isdigit():
                found = m[1], low + m.start(1)
        close = mask.rfind(")", low, close)
    return found


@dataclass(frozen=True)
class Rule:
    """A kind of declaration. head: tried on what stands before a block, from the last fit on;
    None for callables. start: words that belong to a callable's start. tail: a pattern of declarations
    without a block, in lines; its group ``n`` is the name."""

    kind: str
    head: str | None = None
    tail: str | None = None
    start: str = r"[\w<>\[\],.?*&: \t@]*"
    after: str = r"[^;{}()=]*"
    least: str | None = None  # what the callable's start must fit
    until: str = ";"  # what ends it besides its block: ; takes one that follows


@dataclass(frozen=True)
class Braced:
    lexis: Lexis
    rules: tuple[Rule, ...]
    bounds: str = ";{}"
    skip: str | None = None  # lines that are blanked: directives
    types: bool = False  # braces may stand in types

    def units(self, text: str) -> list[Unit]:
        mask = masked(text, self.lexis)
        if self.skip:
            mask = re.sub(self.skip, lambda m: re.sub(r"[^\n]", " ", m.group()), mask)
        pairs, out = closing(mask), []
        typed = set()
        for m in re.finditer(r"[<:|&]\s*(?=\{)", mask) if self.types else ():
            if re.match(r"\s*(?:[>{|&\[]|=>)", mask[pairs[m.end()] + 1 : pairs[m.end()] + 40]):
                typed |= {m.end(), pairs[m.end()]}
        bounds, within, held = [], [], []  # within: the brackets around each bound, the innermost
        for m in re.finditer(f"[(){re.escape(self.bounds)}]", mask):
            if m.group() == "(":
                held.append(m.start())
            elif m.group() == ")":
                held = held[:-1]
            elif m.start() not in typed:
                bounds.append(m.start())
                within.append(held[-1] if held else -1)
        for m in re.finditer(r"\{", mask):
            brace = m.start()
            if brace in typed:
                continue
            k = bisect_right(bounds, brace - 1) - 1
            while k >= 0 and within[k] >= 0 and pairs.get(within[k], len(mask)) < brace:  # in brackets that close before the block
                k = bisect_right(bounds, within[k] - 1) - 1
            low = bounds[k] + 1 if k >= 0 else 0
            found = self._of(mask, low, brace)
            if found:
                rule, name, start = found
                end = pairs[brace] + 1
                if rule.until == "typedef":
                    stop = mask.find(";", end)
                    end = stop + 1 if stop >= 0 else end
                out.append(Unit(start, end, rule.kind, name))
        for rule in self.rules:
            if rule.tail:
                out += [Unit(m.start("u"), m.end("u"), rule.kind, m["n"]) for m in re.finditer(rule.tail, mask if rule.kind != "preproc_def" else text)]
        return sorted(set(out), key=lambda u: (u.start, -u.end))

    def _of(self, mask: str, low: int, brace: int) -> tuple[Rule, str, int] | None:
        head = mask[low:brace]
        for rule in self.rules:
            if rule.head is not None:
                last = None
                for last in re.finditer(rule.head, head):  # noqa: B007
                    pass
                if last:
                    named = next((g for g in last.groups() if g), "")
                    return rule, named, low + last.start()
            elif rule.tail is None or rule.least is not None or rule.start:
                called = _called(mask, low, brace, rule.after)
                if called:
                    name, at = called
                    before = re.search(rf"{rule.start}$", mask[low:at])
                    start = low + before.start() if before else at
                    start += len(mask[start:at]) - len(mask[start:at].lstrip())
                    if rule.least is None or re.search(rule.least, mask[start:at]):
                        return rule, name.split("::")[-1] if "::" in name else name, start
        return None


_SLASHED = Lexis(char=True)
_SCRIPT = Lexis(template=True, regex=True)

#: TypeScript and JavaScript: methods by name and brackets, arrows by what stands before their block.
_ARROW = Rule("arrow_function", r"(?:async\s+)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|[\w$]+)\s*(?::[^={}()]+)?\s*=>\s*$")
_ARROW_TAIL = Rule("arrow_function", tail=r"(?P<n>)(?P<u>(?:\basync\s+)?(?:\([^(){};]*(?:\([^()]*\)[^(){};]*)*\)|\b[\w$]+)[ \t]*(?::[^={}()\n;]+)?[ \t]*=>[ \t]*(?![\s{])(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|[^\n;,(){}\[\]])+)", start="")
_METHOD = Rule("method_definition", start=r"(?:\b(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*(?:\*\s*)?", after=r"\s*(?::(?:[^;={}]|\{[^{}]*\})*)?")
_SCRIPT_RULES = (
    Rule("interface_declaration", r"\binterface\s+([\w$]+)[^;{}]*$"),
    Rule("enum_declaration", r"\b(?:const\s+)?enum\s+([\w$]+)\s*$"),
    Rule("class_declaration", r"(?:\babstract\s+)?\bclass\b\s*([\w$]*)[^;{}()=]*$"),
)


def _script(kinds: tuple[str, ...]) -> tuple[Rule, ...]:
    function = Rule("function_declaration", r"(?<![=(,:?&|!]\s)(?<![=(,:?&|!])(?:\basync\s+)?\bfunction\b\s*\*?\s*([\w$]+)(?:[^{}]|\{[^{}]*\})*$")
    inner = Rule("function_expression", r"(?:\basync\s+)?\bfunction\b\s*\*?\s*([\w$]*)(?:[^{}]|\{[^{}]*\})*$")
    alias = Rule("type_alias_declaration", tail=r"(?m)(?:^|(?<=[;{}]))[ \t]*(?:export[ \t]+)?(?:declare[ \t]+)?(?P<u>\btype[ \t]+(?P<n>[\w$]+)[^;={}\n]*=(?:[^;{}]|\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\})*?(?:;|(?=\n\s*(?:\n|export\b|type\b|interface\b|const\b|let\b|function\b|class\b|import\b|//|$))|\Z))", start="")
    every = (*[r for r in _SCRIPT_RULES if r.kind in kinds], function, inner, _ARROW, _METHOD, _ARROW_TAIL)
    return (*every, alias) if "type_alias_declaration" in kinds else every


_TS = Braced(_SCRIPT, _script(("interface_declaration", "enum_declaration", "class_declaration", "type_alias_declaration")), types=True)
_JS = Braced(_SCRIPT, _script(("class_declaration",)))

#: A type before a method's name: a constructor has words of its own only.
_TYPED = r"(?:^|\s)(?!(?:public|private|protected|internal|static|final|abstract|synchronized|native|default|virtual|override|sealed|async|unsafe|extern|partial|new)\s)(?!@)[\w<>\[\],.?()]+\s+$"
_JAVA_WORDS = r"(?:@\w+(?:\([^()]*\))?\s*|\b(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*"
_JAVA = Braced(
    Lexis(char=True, triple=True),
    (
        Rule("interface_declaration", rf"{_JAVA_WORDS}@?\binterface\s+(\w+)[^;{{}}()]*$"),
        Rule("enum_declaration", rf"{_JAVA_WORDS}\benum\s+(\w+)[^;{{}}()]*$"),
        Rule("class_declaration", rf"{_JAVA_WORDS}\b(?:class|record)\s+(\w+)[^;{{}}]*$"),
        Rule("method_declaration", start=r"(?:@\w+(?:\([^()]*\))?\s*)*(?:<[^;{}()]*>\s*)?[\w<>\[\],.?& \t\n]*", after=r"\s*(?:throws\s+[\w., \t\n]+)?", least=_TYPED,
             tail=r"(?m)^[ \t]*(?P<u>(?:(?:public|protected|abstract|static|native|default)[ \t]+)+[\w<>\[\],.? \t]+?[ \t](?P<n>\w+)[ \t]*\([^;{}()]*\)[ \t]*(?:throws [\w., ]+)?;)"),
    ),
)
_CS_WORDS = r"(?:\b(?:public|private|protected|internal|static|abstract|sealed|partial|readonly|unsafe|new|virtual|override|async|ref)\s+)*"
_CS = Braced(
    Lexis(char=True, raw=r'@\"(?:\"\"|[^\"])*\"|\"\"\".*?\"\"\"'),
    (
        Rule("interface_declaration", rf"{_CS_WORDS}\binterface\s+(\w+)[^;{{}}()]*$"),
        Rule("enum_declaration", rf"{_CS_WORDS}\benum\s+(\w+)[^;{{}}()]*$"),
        Rule("record_declaration", rf"{_CS_WORDS}\brecord\s+(?:class\s+|struct\s+)?(\w+)[^;{{}}]*$", tail=rf"(?m)(?P<u>{_CS_WORDS}\brecord[ \t]+(?:class[ \t]+|struct[ \t]+)?(?P<n>\w+)[^;{{}}]*;)", start=""),
        Rule("struct_declaration", rf"{_CS_WORDS}\bstruct\s+(\w+)[^;{{}}()]*$"),
        Rule("class_declaration", rf"{_CS_WORDS}\bclass\s+(\w+)[^;{{}}]*$"),
        Rule("namespace_declaration", r"\bnamespace\s+([\w.]+)\s*$"),
        Rule("method_declaration", start=r"[\w<>\[\],.?() \t\n]*", after=r"\s*(?:where\s[^;{}]*)?", least=_TYPED,
             tail=r"(?m)(?:^|(?<=[;{}]))[ \t]*(?P<u>(?:(?:public|private|protected|internal|static|abstract|virtual|override|async|sealed|extern|partial)[ \t]+)+[\w<>\[\],.? \t]+?[ \t](?P<n>\w+)[ \t]*(?:<[^;{}()]*>)?\([^;{}()]*\)[ \t]*(?:=>[^;{}]*)?;)"),
    ),
)
_GO = Braced(
    Lexis(template=True, char=True),
    (
        Rule("method_declaration", r"\bfunc\s*\([^()]*\)\s*(\w+)\s*[\[(][^{}]*$"),
        Rule("function_declaration", r"\bfunc\s+(\w+)\s*[\[(][^{}]*$"),
        Rule("type_spec", r"(?<=\btype)\s+(\w+)\s*(?:\[[^\]]*\])?\s*(?:struct|interface)\s*$"),
    ),
)
_DIRECTIVE = r"(?m)^[ \t]*#(?:[^\n\\]|\\\n|\\.)*"
_C_TAIL = Rule("preproc_def", tail=r"(?m)^(?P<u>[ \t]*#[ \t]*define[ \t]+(?P<n>\w+)(?!\()(?:[^\n\\]|\\\n|\\.)*)", start="")
_C_CALL = Rule("function_definition", start=r"[\w*&<>:,~\[\] \t\n]*", after=r"\s*(?:(?:const|noexcept|override|final|volatile|mutable|&|&&|try|throw\s*\(\s*\))\s*)*(?:->[^;{}]*)?(?::[^;{}]*)?")
_C = Braced(
    _SLASHED,
    (
        Rule("type_definition", r"\btypedef\s+(?:struct|enum|union)\b\s*(\w*)\s*$", until="typedef"),
        Rule("struct_specifier", r"\bstruct\s+(\w+)\s*$"), Rule("enum_specifier", r"\benum\s*(\w*)\s*$"), Rule("union_specifier", r"\bunion\s+(\w+)\s*$"),
        _C_CALL, Rule("type_definition", tail=r"(?m)(?P<u>\btypedef\b(?!\s*(?:struct|enum|union)\b[^;{}]*\{)[^;{}]*?(?P<n>\w+)\s*(?:\[[^\]]*\]|\)[^;{}]*)?;)", start=""), _C_TAIL,
    ),
    skip=_DIRECTIVE,
)
_CPP = Braced(
    Lexis(char=True, raw=r'R\"\(.*?\)\"'),
    (
        Rule("struct_specifier", r"\bstruct\s+(\w+)[^;{}()]*$"), Rule("enum_specifier", r"\benum\s*(?:class\s+|struct\s+)?(\w*)[^;{}()]*$"), Rule("union_specifier", r"\bunion\s+(\w+)\s*$"),
        Rule("class_specifier", r"\bclass\s+(\w+)[^;{}()]*$"), Rule("namespace_definition", r"\bnamespace\s*([\w:]*)\s*$"), _C_CALL,
    ),
    skip=_DIRECTIVE + r"|\b(?:public|private|protected|signals)\b[ \t]*:(?!:)",
)
_RUST_WORDS = r"(?:\bpub(?:\([^()]*\))?\s+)?(?:\b(?:async|const|unsafe|default)\s+|\bextern\s+(?:\"[^\"]*\"\s+)?)*"
_RUST = Braced(
    Lexis(char=True, quotes='"', raw=r'r#\".*?\"#|r\"[^\"]*\"'),
    (
        Rule("function_item", rf"{_RUST_WORDS}\bfn\s+(\w+)[^{{}}]*$"), Rule("struct_item", rf"{_RUST_WORDS}\bstruct\s+(\w+)[^;{{}}]*$", tail=rf"(?P<u>{_RUST_WORDS}\bstruct\s+(?P<n>\w+)[^;{{}}]*;)"),
        Rule("enum_item", rf"{_RUST_WORDS}\benum\s+(\w+)[^;{{}}]*$"), Rule("trait_item", rf"{_RUST_WORDS}\btrait\s+(\w+)[^;{{}}]*$"),
        Rule("impl_item", r"(?:\bunsafe\s+)?\bimpl\b\s*(?:<[^;{}]*?>)?\s*([^;{}]*?)\s*$"), Rule("type_item", tail=rf"(?P<u>{_RUST_WORDS}\btype\s+(?P<n>\w+)[^;{{}}]*;)", start=""), Rule("mod_item", rf"{_RUST_WORDS}\bmod\s+(\w+)\s*$"),
    ),
)
_KT_WORDS = r"(?:@\w+(?:\([^()]*\))?\s+|\b(?:public|private|protected|internal|open|override|abstract|final|suspend|inline|operator|infix|tailrec|external|companion|data|sealed|lateinit|const|annotation|inner|enum|value)\s+)*"
_KT = Braced(
    Lexis(char=True, triple=True),
    (
        Rule("object_declaration", rf"{_KT_WORDS}\bobject\b\s*(\w*)[^;{{}}=]*$"), Rule("class_declaration", rf"{_KT_WORDS}\b(?:class|interface)\s+(\w+)[^;{{}}]*$"),
        Rule("function_declaration", rf"{_KT_WORDS}\bfun\s+(?:<[^;{{}}()]*>\s*)?(?:[\w<>?.]+\.)?(\w+)\s*\([^{{}}]*$",
             tail=rf"(?m)(?P<u>{_KT_WORDS}\bfun[ \t]+(?:<[^;{{}}()]*>[ \t]*)?(?:[\w<>?.]+\.)?(?P<n>\w+)[ \t]*\([^(){{}}]*\)[ \t]*(?::[^={{}}\n]+)?(?:=[^\n{{}}]+|$))"),
        Rule("property_declaration", tail=rf"(?m)^[ \t]*(?P<u>{_KT_WORDS}\b(?:val|var)[ \t]+(?P<n>\w+)[^\n]*)", start=""),
    ),
    bounds=";{}\n",
)
_SW_WORDS = r"(?:@\w+(?:\([^()]*\))?\s+|\b(?:public|private|fileprivate|internal|open|static|class|override|final|mutating|nonmutating|required|convenience|lazy|weak|unowned|indirect)\s+)*"
_SW = Braced(
    Lexis(triple=True, quotes='"'),
    (
        Rule("enum_declaration", rf"{_SW_WORDS}\benum\s+(\w+)[^;{{}}]*$"), Rule("protocol_declaration", rf"{_SW_WORDS}\bprotocol\s+(\w+)[^;{{}}]*$"), Rule("struct_declaration", rf"{_SW_WORDS}\bstruct\s+(\w+)[^;{{}}]*$"),
        Rule("function_declaration", rf"{_SW_WORDS}\bfunc\s+([\w+*/<>=!&|^~-]+)[^;{{}}]*$"), Rule("class_declaration", r"(?:\b(?:public|open|final|private)\s+)*\b(?:class|actor|extension)\s+(\w+)[^;{}()]*$"),
        Rule("variable_declaration", tail=rf"(?m)^[ \t]*(?P<u>{_SW_WORDS}\b(?:let|var)[ \t]+(?P<n>\w+)[^\n;]*)", start=""),
    ),
)
_PHP = Braced(
    Lexis(line=("//", "#"), quotes="\"'"),
    (
        Rule("class_declaration", r"(?:\b(?:abstract|final|readonly)\s+)*\b(?:class|interface|trait|enum)\s+(\w+)[^;{}()]*$"),
        Rule("method_declaration", r"(?:\b(?:abstract|final|public|protected|private|static)\s+)+function\s+&?\s*(\w+)[^{}]*$"), Rule("function_definition", r"\bfunction\s+&?\s*(\w+)\s*\([^{}]*$"),
    ),
)
_BASH = Braced(Lexis(line=(r"(?:(?<=\s)|(?<=\A)|(?<=;))#",), block=()), (Rule("function_definition", r"(?:\bfunction\s+([\w:.-]+)\s*(?:\(\s*\))?|([\w:.-]+)\s*\(\s*\))\s*$"),))
_PS = Braced(Lexis(line=("#",), block=(("<#", "#>"),)), (Rule("function_statement", r"(?i)\b(?:function|filter)\s+([\w:-]+)[^;{}]*$"), Rule("class_statement", r"(?i)\bclass\s+(\w+)[^;{}]*$")))


def python_units(text: str) -> list[Unit]:
    """By the language's own parser; nothing where that fails."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines = text.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)

    def place(line: int, column: int) -> int:
        return starts[line - 1] + len(lines[line - 1].encode()[:column].decode("utf-8", "ignore"))

    out = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class_definition" if isinstance(node, ast.ClassDef) else "function_definition"
            end = place(node.end_lineno, node.end_col_offset)
            out.append(Unit(place(node.lineno, node.col_offset), end, kind, node.name))
            if node.decorator_list:
                first = node.decorator_list[0]
                out.append(Unit(text.rfind("@", 0, place(first.lineno, first.col_offset) + 1), end, "decorated_definition", node.name))
    return sorted(out, key=lambda u: (u.start, -u.end))


def json_units(text: str) -> list[Unit]:
    """The pairs of objects, those of nested ones too."""
    mask = masked(text, Lexis(block=(("/*", "*/"),), quotes='"'))
    pairs, out = closing(mask), []
    for m in re.finditer(r"\"([^\"\n]*)\"\s*:\s*", mask):
        i = m.end()
        if i < len(mask) and mask[i] in "{[":
            end = pairs.get(i, len(mask) - 1) + 1
        else:
            stop = re.compile(r"[,}\]]").search(mask, i)
            end = stop.start() if stop else len(mask)
            end = i + len(text[i:end].rstrip())
        out.append(Unit(m.start(), end, "pair", text[m.start(1) : m.end(1)]))
    return out


def xml_units(text: str) -> list[Unit]:
    """Elements, those within others too."""
    mask = re.sub(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<\?.*?\?>|<![^<>]*>", lambda m: re.sub(r"[^\n]", " ", m.group()), text, flags=re.S)
    held, out = [], []
    for m in re.finditer(r"<(/?)([\w:.-]+)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*?)(/?)>", mask):
        if m[1]:
            while held:
                name, start = held.pop()
                if name == m[2]:
                    out.append(Unit(start, m.end(), "element", name))
                    break
        elif m[4]:
            out.append(Unit(m.start(), m.end(), "element", m[2]))
        else:
            held.append((m[2], m.start()))
    return sorted(out, key=lambda u: (u.start, -u.end))


def html_units(text: str) -> list[Unit]:
    return [Unit(m.start(), m.end(), f"{m[1].lower()}_element", m[1].lower()) for m in re.finditer(r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)", text)]


def css_units(text: str) -> list[Unit]:
    """Rules and at-rules, those within others too."""
    mask = masked(text, Lexis(line=()))
    pairs, out = closing(mask), []
    for m in re.finditer(r"([^{};]*)\{", mask):
        head = m[1].strip()
        start = m.start() + len(m[1]) - len(m[1].lstrip())
        word = re.match(r"@[\w-]+", head)
        kind = {"@media": "media_statement", "@keyframes": "keyframes_statement"}.get(word[0], "at_rule") if word else "rule_set"
        out.append(Unit(start, pairs[m.end() - 1] + 1, kind, re.sub(r"\s+", " ", head)))
    frames = [u for u in out if u.kind == "keyframes_statement"]
    out = [u if not any(f.start < u.start < f.end for f in frames) else Unit(u.start, u.end, "keyframe_block", u.name) for u in out]
    out += [Unit(m.start(1), m.end(1), "at_rule", m[2]) for m in re.finditer(r"(?:^|(?<=[;{}]))\s*((@[\w-]+)[^{};]*;)", mask)]
    return sorted(out, key=lambda u: (u.start, -u.end))


def toml_units(text: str) -> list[Unit]:
    """Tables with what is below them, and the pairs before the first."""
    mask = masked(text, Lexis(line=("#",), block=(), triple=True))
    heads = [m for m in re.finditer(r"(?m)^[ \t]*(\[\[?)([^\]\n]*)\]", mask)]
    first = heads[0].start() if heads else len(mask)
    out = []
    pairs = closing(mask)
    at = 0
    for m in re.finditer(r"(?m)^[ \t]*([\w.\"'-]+)[ \t]*=[ \t]*", mask[:first]):
        if m.start() < at:
            continue
        i = m.end()
        end = pairs[i] + 1 if i < len(mask) and mask[i] in "[{" and i in pairs else (mask.find("\n", i) if mask.find("\n", i) >= 0 else len(mask))
        if text[i : i + 3] in ('"""', "'''"):
            end = text.find(text[i : i + 3], i + 3) + 3 or len(text)
        at = end
        out.append(Unit(m.start(1), end, "pair", m[1]))
    for k, m in enumerate(heads):
        stop = heads[k + 1].start() if k + 1 < len(heads) else len(mask)
        out.append(Unit(m.start(1), m.start(1) + len(text[m.start(1) : stop].rstrip()), "table_array_element" if m[1] == "[[" else "table", text[m.start(2) : m.end(2)].strip()))
    return out


Finder = Callable[[str], list[Unit]]

#: Each language's finder, the kinds that are chunks, and those that an outline lists.
LANGUAGES: dict[str, tuple[Finder, tuple[str, ...], tuple[str, ...]]] = {
    "typescript": (_TS.units, ("function_declaration", "method_definition", "arrow_function", "interface_declaration", "type_alias_declaration"),
                   ("function_declaration", "method_definition", "class_declaration", "interface_declaration", "type_alias_declaration", "enum_declaration")),
    "javascript": (_JS.units, ("function_declaration", "method_definition", "arrow_function"), ("function_declaration", "method_definition", "class_declaration", "arrow_function")),
    "python": (python_units, ("function_definition", "decorated_definition"), ("function_definition", "class_definition")),
    "java": (_JAVA.units, ("method_declaration", "interface_declaration", "enum_declaration"), ("class_declaration", "method_declaration", "interface_declaration", "enum_declaration")),
    "go": (_GO.units, ("function_declaration", "method_declaration"), ("function_declaration", "method_declaration", "type_spec")),
    "c": (_C.units, ("function_definition", "struct_specifier", "enum_specifier", "union_specifier", "type_definition", "preproc_def"), ("function_definition", "struct_specifier", "enum_specifier")),
    "cpp": (_CPP.units, ("function_definition", "struct_specifier", "enum_specifier", "union_specifier"), ("function_definition", "class_specifier", "struct_specifier", "enum_specifier")),
    "csharp": (_CS.units, ("method_declaration", "interface_declaration", "struct_declaration", "record_declaration", "enum_declaration"),
               ("class_declaration", "struct_declaration", "interface_declaration", "enum_declaration", "record_declaration", "method_declaration")),
    "rust": (_RUST.units, ("function_item", "struct_item", "enum_item", "trait_item", "impl_item", "type_item"), ("function_item", "struct_item", "enum_item", "impl_item", "trait_item", "type_item")),
    "kotlin": (_KT.units, ("function_declaration", "object_declaration", "property_declaration"), ("function_declaration", "class_declaration", "object_declaration")),
    "swift": (_SW.units, ("function_declaration", "enum_declaration", "protocol_declaration", "variable_declaration"),
              ("function_declaration", "class_declaration", "struct_declaration", "enum_declaration", "protocol_declaration")),
    "php": (_PHP.units, ("function_definition", "method_declaration"), ("function_definition", "method_declaration", "class_declaration")),
    "bash": (_BASH.units, ("function_definition",), ("function_definition",)),
    "powershell": (_PS.units, ("function_statement",), ("function_statement", "class_statement")),
    "css": (css_units, ("rule_set", "at_rule", "media_statement", "keyframes_statement"), ("rule_set",)),
    "html": (html_units, ("script_element", "style_element"), ("script_element", "style_element")),
    "xml": (xml_units, ("element",), ("element",)),
    "json": (json_units, ("pair",), ("pair",)),
    "toml": (toml_units, ("table", "table_array_element", "pair"), ("table", "table_array_element")),
}

# Kinds that can be called.
CALLABLE = {"function_declaration", "method_definition", "arrow_function", "function_expression", "function_definition", "method_declaration", "function_item", "function_statement"}


def outermost(units: list[Unit]) -> list[Unit]:
    """Without those within others."""
    out: list[Unit] = []
    for u in sorted(units, key=lambda u: (u.start, -u.end)):
        if not out or u.start >= out[-1].end:
            out.append(u)
    return out


def described(text: str, unit: Unit, comment: str = r"(?://|/\*|\*|#|--|<!--|;|%)") -> str:
    """The comment lines right above a declaration, without their marks, and a Python declaration's doc string."""
    rows = text[: unit.start].split("\n")[:-1]
    held: list[str] = []
    while rows and re.match(rf"\s*{comment}", rows[-1]) and not re.match(r"\s*#\s*(?:include|define|if|endif|pragma|!)", rows[-1]):
        held.insert(0, rows.pop())
    said = [re.sub(r"^\s*(?:/\*+|\*+/|\*|//+|#+|--+|<!--|;+|%+)[ \t]?|\s*(?:\*+/|-->)\s*$", "", x).strip() for x in held]
    doc = re.match(r"(?:@[^\n]*\n\s*)*(?:async\s+)?(?:def|class)\b[^\n]*(?:\n[^\n]*?)*?:\s*\n\s*(?:\"\"\"(.*?)\"\"\"|'''(.*?)''')", text[unit.start : unit.end], re.S)
    if doc and text[unit.start : unit.start + doc.start(1 if doc[1] is not None else 2)].count(":") < 40:
        said.append((doc[1] or doc[2] or "").strip())
    return "\n".join(x for x in said if x)


def chunks(language: str) -> Callable[[str], list[tuple[int, int, str, str]]]:
    """(first line, last line, text, description) of a text's outermost declarations of the language's kinds."""
    find, kinds, _ = LANGUAGES[language]

    def run(text: str) -> list[tuple[int, int, str, str]]:
        out = []
        for u in outermost([u for u in find(text) if u.kind in kinds]):
            body = text[u.start : u.end]
            line = text.count("\n", 0, u.start) + 1
            out.append((line, line + body.count("\n"), body, described(text, u)))
        return out

    return run


def outline(language: str, text: str) -> list[tuple[str, str, int, int]] | None:
    """(kind, name, first line, last line) of the declarations that an outline lists, within others too.

    A callable within a callable is left out, a type's members are not. None for a
    language without declarations.
    """
    if language not in LANGUAGES:
        return None
    find, _, kinds = LANGUAGES[language]
    out, held = [], []
    for u in find(text):
        if u.kind not in kinds:
            continue
        while held and held[-1].end < u.end:
            held.pop()
        if not (u.kind in CALLABLE and held and held[-1].kind in CALLABLE):
            line = text.count("\n", 0, u.start) + 1
            out.append((u.kind, u.name or text[u.start : u.end].split("\n")[0][:80], line, line + text.count("\n", u.start, u.end)))
        held.append(u)
    return out

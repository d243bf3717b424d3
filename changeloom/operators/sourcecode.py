"""Facts that need source text parsed: health, lines of code, functions and
their complexity, token streams, tests, collection literals.

Python is parsed with the standard library; nested functions belong to the
outermost one. TypeScript, JavaScript and Rust have no parser here: they are
tokenised by rule, and what needs a tree is reported `parse-degraded`, never
guessed. All run as mapInPandas over a table of files, a file at a time."""

from __future__ import annotations

import ast
import io
import keyword
import re
import tokenize
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from changeloom.functions.scalars import LANGUAGES

#: Parts of a called name that make it an assertion.
ASSERTIONS = ["expect", "assert", "should", "verify", "raises", "throws", "rejects", "resolves", "matchsnapshot"]


def language(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    return LANGUAGES.get(name.rsplit(".", 1)[-1]) if "." in name else None


def decode(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    try:
        return bytes(raw).decode("utf-8").removeprefix("﻿")
    except UnicodeDecodeError:
        return None


def parse(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


# Tokens ------------------------------------------------------------------------

_C_TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*[\s\S]*?\*/)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)"""
    r"""|(?P<number>\d[\w.]*)|(?P<name>[A-Za-z_$][\w$]*)|(?P<op>=>|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|\S)|(?P<blank>\s+)"""
)
_JS_WORDS = frozenset(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new of return static super switch this throw try typeof var void while with yield async await".split()
)


def python_tokens(text: str) -> list[tuple[str, int]] | None:
    """(symbol, line); names are ID, numbers NUM, strings STR; comments and
    imports are left out. None where the text can't be tokenised."""
    out: list[tuple[str, int]] = []
    importing = False
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type in (tokenize.NEWLINE, tokenize.ENDMARKER):
                importing = False
            if t.type == tokenize.NAME and t.string in ("import", "from") and (not out or out[-1][1] != t.start[0]):
                importing = True
            if importing or t.type in (tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER, tokenize.ENCODING):
                continue
            symbol = t.string
            if t.type == tokenize.NAME and not keyword.iskeyword(symbol):
                symbol = "ID"
            elif t.type == tokenize.NUMBER:
                symbol = "NUM"
            elif t.type == tokenize.STRING:
                symbol = "STR"
            out.append((symbol, t.start[0]))
    except (tokenize.TokenError, IndentationError, SyntaxError):
        return None
    return out


def script_tokens(text: str) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    line, skipping = 1, False
    for t in _C_TOKEN.finditer(text):
        kind, said = t.lastgroup, t.group()
        if kind == "name" and said == "import" and (not out or out[-1][1] < line):
            skipping = True
        if kind not in ("comment", "blank") and not skipping:
            out.append(({"string": "STR", "number": "NUM", "name": said if said in _JS_WORDS else "ID"}.get(kind, said), line))
        line += said.count("\n")
        if skipping and (said == ";" or "\n" in said):
            skipping = False
    return out


def token_stream(path: str, text: str) -> list[tuple[str, int]] | None:
    kind = language(path)
    if kind is None or kind == "rust":
        return None
    return python_tokens(text) if kind == "python" else script_tokens(text)


# Lines of code -----------------------------------------------------------------


def sloc(path: str, text: str) -> int:
    """Lines with something other than blanks outside comments."""
    kind = language(path)
    if kind == "python":
        bare = re.sub(r"""("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|#[^\n]*""", lambda m: m.group(1) or "", text)
    elif kind == "rust":
        bare = rust_bare(text)
    elif kind:
        bare = "".join(" \n" * t.group().count("\n") if t.lastgroup == "comment" else t.group() for t in _C_TOKEN.finditer(text))
    else:
        bare = text
    return sum(bool(x.strip()) for x in bare.split("\n"))


def rust_bare(text: str) -> str:
    """Rust text without comments; block comments nest, raw strings don't end at
    a quote alone."""
    out, at = [], 0
    token = re.compile(r"""//[^\n]*|/\*|r(#*)"|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])'""")
    while found := token.search(text, at):
        out.append(text[at : found.start()])
        said = found.group()
        if said == "/*":
            depth, k = 1, found.end()
            while depth and (step := re.compile(r"/\*|\*/").search(text, k)):
                depth += 1 if step.group() == "/*" else -1
                k = step.end()
            k = len(text) if depth else k
            out.append("\n" * text.count("\n", found.start(), k))
            at = k
        elif said.startswith("r"):
            end = text.find('"' + found.group(1), found.end())
            at = len(text) if end < 0 else end + 1 + len(found.group(1))
            out.append(text[found.start() : at])
        else:
            out.append("" if said.startswith("//") else said)
            at = found.end()
    return "".join([*out, text[at:]])


# Functions ---------------------------------------------------------------------

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def functions(tree: ast.Module) -> list[tuple[str, ast.AST]]:
    """(name, node) of outermost functions; methods as Class.method. Equal names
    on equal lines get @column."""
    out: list[tuple[str, ast.AST]] = []
    stack: list[tuple[str, ast.AST]] = [("", n) for n in reversed(tree.body)]
    while stack:
        prefix, node = stack.pop()
        if isinstance(node, FUNCTIONS):
            out.append((prefix + node.name, node))
        elif isinstance(node, ast.ClassDef):
            stack += [(f"{prefix}{node.name}.", n) for n in reversed(node.body)]
        else:
            stack += [(prefix, n) for n in reversed(list(ast.iter_child_nodes(node)))]
    keys = [(name, n.lineno, n.end_lineno) for name, n in out]
    return [(f"{name}@{n.col_offset}" if keys.count(key) > 1 else name, n) for (name, n), key in zip(out, keys, strict=True)]


def cyclomatic(function: ast.AST) -> int:
    """1 + decisions."""
    total = 1
    for n in ast.walk(function):
        if isinstance(n, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp)):
            total += 1
        elif isinstance(n, ast.BoolOp):
            total += len(n.values) - 1
        elif isinstance(n, ast.comprehension):
            total += 1 + len(n.ifs)
        elif isinstance(n, ast.match_case):
            wild = isinstance(n.pattern, ast.MatchAs) and n.pattern.pattern is None and n.guard is None
            total += not wild
    return total


def cognitive(function: ast.AST) -> int:
    """Breaks in the flow, weighted by nesting; a run of one boolean operator is
    one; recursion counts once. A worklist, no recursion."""
    total, recursive = 0, False
    name = getattr(function, "name", None)
    stack: list[tuple[ast.AST, int]] = [(n, 0) for n in ast.iter_child_nodes(function)]
    while stack:
        n, depth = stack.pop()
        deeper = depth
        if isinstance(n, ast.If):
            chained = getattr(n, "_chained", False)
            total += 1 if chained else 1 + depth
            for x in n.orelse:
                if isinstance(x, ast.If) and len(n.orelse) == 1:
                    x._chained = True
                    stack.append((x, depth))
                else:
                    stack.append((x, depth + 1))
            if n.orelse and not (len(n.orelse) == 1 and isinstance(n.orelse[0], ast.If)):
                total += 1
            stack += [(n.test, depth), *((x, depth + 1) for x in n.body)]
            continue
        if isinstance(n, (ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Match)):
            total += 1 + depth
            deeper = depth + 1
        elif isinstance(n, ast.BoolOp):
            total += 1
        elif isinstance(n, (*FUNCTIONS, ast.Lambda)):
            deeper = depth + 1
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id == name:
            recursive = True
        stack += [(x, deeper) for x in ast.iter_child_nodes(n)]
    return total + recursive


# Tables of facts ---------------------------------------------------------------


def _rows(files: DataFrame, emit: Callable[..., Iterable[tuple]], columns: list[str], schema: str) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for part in parts:
            yield pd.DataFrame([row for said in part[columns].itertuples(index=False) for row in emit(*said)], columns=names)

    return files.select(*columns).mapInPandas(run, schema)


def faults(path: str, text: str | None) -> int:
    """Parse faults of a text: 0 or 1 for Python; unread or foreign texts of a
    known language that aren't balanced count 1."""
    kind = language(path)
    if kind is None or text is None:
        return 0
    if kind == "python":
        return int(parse(text) is None)
    depth = {c: 0 for c in "([{"}
    for symbol, _ in script_tokens(text):
        if symbol in "([{":
            depth[symbol] += 1
        elif symbol in ")]}":
            depth["([{"[")]}".index(symbol)]] -= 1
    return sum(map(abs, depth.values()))


def health(files: DataFrame) -> DataFrame:
    """(path, base_faults, head_faults)."""
    return _rows(files, lambda p, b, h: [(p, faults(p, decode(b)), faults(p, decode(h)))], ["path", "base", "head"], "path string, base_faults long, head_faults long")


def file_facts(files: DataFrame) -> DataFrame:
    """(path, language, completeness, sloc, functions) of files(path, content);
    functions are (name, line, end_line, sloc, cyclomatic, cognitive). Without a
    parser, completeness is parse-degraded and functions are null."""

    def emit(path: str, raw: bytes):
        text, kind = decode(raw), language(path)
        if kind is None:
            return
        if text is None:
            yield path, kind, "unwitnessed", None, None
            return
        tree = parse(text) if kind == "python" else None
        if tree is None:
            yield path, kind, "parse-degraded", sloc(path, text), None
            return
        lines = text.split("\n")
        found = [(name, n.lineno, n.end_lineno, sloc(path, "\n".join(lines[n.lineno - 1 : n.end_lineno])), cyclomatic(n), cognitive(n)) for name, n in functions(tree)]
        names = ("name", "line", "end_line", "sloc", "cyclomatic", "cognitive")
        yield path, kind, "complete", sloc(path, text), [dict(zip(names, f, strict=True)) for f in found]

    return _rows(
        files,
        emit,
        ["path", "content"],
        "path string, language string, completeness string, sloc long, functions array<struct<name:string,line:int,end_line:int,sloc:long,cyclomatic:long,cognitive:long>>",
    )


def streams(files: DataFrame) -> DataFrame:
    """(file, symbols, lines) of files(path, content): normalised tokens."""

    def emit(path: str, raw: bytes):
        text = decode(raw)
        tokens = token_stream(path, text) if text is not None else None
        if tokens is not None:
            yield path, [s for s, _ in tokens], [n for _, n in tokens]

    return _rows(files, emit, ["path", "content"], "file string, symbols array<string>, lines array<int>")


_CASE = re.compile(r"""(?<![\w.])(x?it|x?test|x?describe)((?:\.\w+)*)\s*(?:\([^()]*\))?\s*\(\s*(?:"([^"\n]*)"|'([^'\n]*)'|`([^`]*)`)""")


def test_cases(path: str, text: str | None) -> list[tuple[str, int, bool, bool]]:
    """(name, line, skipped, asserts) of the test cases in a text."""
    kind = language(path)
    if text is None or kind not in ("python", "typescript", "javascript"):
        return []
    if kind == "python":
        tree = parse(text)
        if tree is None:
            return []
        out = []
        for name, node in functions(tree):
            if not name.rsplit(".", 1)[-1].startswith("test"):
                continue
            marks = [ast.unparse(d).lower() for d in node.decorator_list]
            said = [ast.unparse(n.func).lower() for n in ast.walk(node) if isinstance(n, ast.Call)]
            asserts = any(isinstance(n, (ast.Assert, ast.Raise)) for n in ast.walk(node)) or any(h in s for s in said for h in ASSERTIONS)
            out.append((name, node.lineno, any("skip" in m or "xfail" in m for m in marks), asserts))
        return out
    out = []
    bare = "".join(re.sub(r"[^\n]", " ", t.group()) if t.lastgroup == "comment" else t.group() for t in _C_TOKEN.finditer(text))
    cases = list(_CASE.finditer(bare))
    for found, after in zip(cases, [*cases[1:], None], strict=True):
        word, mods = found.group(1), found.group(2)
        if "describe" in word:
            continue
        body = bare[found.end() : after.start() if after else len(bare)].lower()
        calls = re.findall(r"[\w.]+(?=\s*\()", body)
        skipped = word.startswith("x") or ".skip" in mods or ".todo" in mods
        name = next(g for g in found.groups()[2:] if g is not None)
        out.append((name, bare.count("\n", 0, found.start()) + 1, skipped, any(h in c for c in calls for h in ASSERTIONS)))
    return out


def tests(files: DataFrame) -> DataFrame:
    """(path, side, name, line, skipped, asserts) for both sides of changed files."""

    def emit(path: str, base, head):
        for side, raw in (("base", base), ("head", head)):
            yield from ((path, side, *case) for case in test_cases(path, decode(raw)))

    return _rows(files, emit, ["path", "base", "head"], "path string, side string, name string, line int, skipped boolean, asserts boolean")


def table_sizes(path: str, text: str | None) -> list[tuple[int, int]]:
    """(line, elements) of collection literals inside functions."""
    if text is None:
        return []
    if language(path) == "python":
        tree = parse(text)
        if tree is None:
            return []
        return [
            (n.lineno, len(n.keys) if isinstance(n, ast.Dict) else len(n.elts))
            for _, f in functions(tree)
            for n in ast.walk(f)
            if isinstance(n, (ast.List, ast.Tuple, ast.Set, ast.Dict))
        ]
    if language(path) not in ("typescript", "javascript"):
        return []
    # brackets in functions: a frame is (kind, line, commas, is a function's body)
    out, frames, last = [], [], ""
    for symbol, line in script_tokens(text):
        if symbol in ("(", "[", "{"):
            body = symbol == "{" and last in (")", "=>")
            frames.append([symbol, line, 0, body, False])
        elif symbol in (")", "]", "}") and frames:
            kind, start, commas, body, some = frames.pop()
            if kind != "(" and not body and some and any(f[3] for f in frames):
                out.append((start, commas + (last != ",")))
        elif symbol == "," and frames:
            frames[-1][2] += 1
        if frames and symbol not in ("[", "{", "("):
            frames[-1][4] = True
        elif len(frames) > 1:
            frames[-2][4] = True
        last = symbol
    return out


def tables(files: DataFrame) -> DataFrame:
    """(path, side, line, elements)."""

    def emit(path: str, base, head):
        for side, raw in (("base", base), ("head", head)):
            yield from ((path, side, *t) for t in table_sizes(path, decode(raw)))

    return _rows(files, emit, ["path", "base", "head"], "path string, side string, line int, elements int")

"""Symbols and imports of Lua, Python and JavaScript or TypeScript sources.

Python is read by the ast module. The other two are cut into tokens, in which neither strings nor comments can pass for
code, and definitions are read from the tokens, so that a signature may run over lines.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate, takewhile

SYMBOL_SCHEMA = "name string, full_name string, symbol_type string, exported boolean, module string, line int, arity int, vararg boolean, docstring string"


@dataclass
class Parsed:
    symbols: list[dict] = field(default_factory=list)
    imports: list[tuple[str, int]] = field(default_factory=list)

    def add(self, name: str, full: str, kind: str, exported: bool, line: int, parameters: tuple[int, bool] = (0, False), docstring: str = "", module: str | None = None) -> None:
        self.symbols.append(dict(name=name, full_name=full, symbol_type=kind, exported=exported, module=module, line=line, arity=parameters[0], vararg=parameters[1], docstring=docstring))


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    line: int


class Tokens:
    """The tokens of a source without its comments, and the comment text of each line that has nothing else."""

    def __init__(self, source: str, pattern: re.Pattern, literal: Callable[[str, int, Token | None], int] | None = None, marks: str = ""):
        """literal: where a literal ends that begins, with one of marks, at a place behind a token, which a pattern can't tell; the place itself if none does."""
        self.all: list[Token] = []
        self.comments: dict[int, str] = {}
        line, coded, at = 1, 0, 0
        while at < len(source):
            end = literal(source, at, self.all[-1] if self.all else None) if source[at] in marks else at
            m = None if end > at else pattern.match(source, at)
            kind, text = ("string", source[at:end]) if m is None else (m.lastgroup or "other", m[0])
            at += len(text)
            if kind == "comment" and coded != line:
                self.comments |= {line + i: x for i, x in enumerate(text.split("\n"))}
            elif kind not in ("comment", "space"):
                self.all.append(Token(kind, text, line))
            line += text.count("\n")
            if kind not in ("comment", "space"):
                coded = line
        #: Brackets that are open before each token.
        self.depth = list(accumulate(((t.text in OPEN) - (t.text in CLOSE) for t in self.all), initial=0))

    def texts(self, at: int, n: int) -> list[str]:
        return [t.text for t in self.all[at : at + n]]

    def is_name(self, at: int) -> bool:
        return at < len(self.all) and self.all[at].kind == "name"

    def is_text(self, at: int, text: str) -> bool:
        return 0 <= at < len(self.all) and self.all[at].text == text

    def closing(self, at: int) -> int:
        """The place of the bracket that closes the one at a place, or the end."""
        depth = 0
        for i in range(at, len(self.all)):
            depth += self.all[i].text in OPEN
            depth -= self.all[i].text in CLOSE
            if not depth:
                return i
        return len(self.all)

    def parameters(self, at: int) -> tuple[int, bool]:
        """The number of named parameters in the brackets at a place, and whether any number may follow."""
        depth, parts = 0, [[]]
        for t in self.all[at + 1 : self.closing(at)]:
            depth += (t.text in OPEN) - (t.text in CLOSE)
            if t.text == "," and not depth:
                parts.append([])
            else:
                parts[-1].append(t.text)
        return sum(part not in ([], ["..."]) for part in parts), any(part[:1] == ["..."] for part in parts)

    def docstring(self, line: int) -> str:
        """The comments right above a line; of each its words, where it has any."""
        block = takewhile(lambda at: at in self.comments, range(line - 1, 0, -1))
        words = [self.comments[at].strip().strip("-/* \t") for at in block]
        return " ".join(w for w in reversed(words) if any(c.isascii() and c.isalnum() for c in w))


OPEN, CLOSE = frozenset("([{"), frozenset(")]}")
LUA = re.compile(
    r"(?P<comment>--\[(?P<c>=*)\[[\s\S]*?(?:\](?P=c)\]|\Z)|--[^\n]*)|(?P<string>\[(?P<s>=*)\[[\s\S]*?\](?P=s)\]|\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\[\s\S]|[^'\\\n])*')|(?P<space>\s+)|(?P<name>[A-Za-z_]\w*)|(?P<other>\.\.\.|\.\.|[\s\S])"
)
JAVASCRIPT = re.compile(
    r"(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\[\s\S]|[^'\\\n])*')|(?P<space>\s+)|(?P<name>[#\w$]+)|(?P<other>\.\.\.|=>|[\s\S])"
)

#: A regular expression between slashes; words behind which a slash begins one, and signs behind which it doesn't.
PATTERN = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
BEFORE_PATTERN = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split())
NOT_BEFORE_PATTERN = frozenset(")]}<")


def javascript_literal(source: str, at: int, before: Token | None) -> int:
    """The end of the template, or of the regular expression, that begins at a place."""
    if source[at] == "`":
        return template_end(source, at)
    value = before is not None and (before.kind == "string" or before.kind == "name" and before.text not in BEFORE_PATTERN or before.text in NOT_BEFORE_PATTERN)
    found = None if value else PATTERN.match(source, at)
    return found.end() if found else at


def template_end(source: str, at: int) -> int:
    """Behind the backtick that closes the one at a place; code inside it may hold braces, strings and further templates."""
    open_ = ["`"]  # templates, and the braces of code in them
    at += 1
    while at < len(source) and open_:
        c = source[at]
        if c == "\\":
            at += 2
            continue
        if open_[-1] == "`":
            if c == "`":
                open_.pop()
            elif source.startswith("${", at):
                open_.append("{")
                at += 1
        elif c in "`{":
            open_.append(c)
        elif c == "}":
            open_.pop()
        elif c in "\"'" and (m := QUOTED.match(source, at)):
            at = m.end() - 1
        at += 1
    return min(at, len(source))


QUOTED = re.compile(r"\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\[\s\S]|[^'\\\n])*'")


def lua(source: str) -> Parsed:
    out, tokens = Parsed(), Tokens(source, LUA)
    module = next((name for at in range(len(tokens.all)) for local, name, equals, value in [(tokens.texts(at, 4) + [""] * 4)[:4]] if local == "local" and equals == "=" and value in ("{", "setmetatable") and name[0].isupper()), None)
    for at, token in enumerate(tokens.all):
        if token.text == "require":
            given = at + 1 + tokens.is_text(at + 1, "(")
            if given < len(tokens.all) and tokens.all[given].kind == "string":
                out.imports.append((tokens.all[given].text.strip("\"'[]="), token.line))
        if token.text != "function":
            continue
        if tokens.is_name(at + 1):  # function a.b:c ( ... )
            path = "".join(t.text for t in takewhile(lambda t: t.text != "(", tokens.all[at + 1 : at + 12]))
            begins, opens = at - tokens.is_text(at - 1, "local"), at + 1 + len(re.findall(r"\w+|[.:]", path))
        elif tokens.is_text(at - 1, "=") and tokens.is_name(at - 2):  # a.b = function ( ... )
            begins = at - 2
            while tokens.is_text(begins - 1, ".") and tokens.is_name(begins - 2):
                begins -= 2
            path, opens = "".join(tokens.texts(begins, at - 1 - begins)), at + 1
            begins -= tokens.is_text(begins - 1, "local")
        else:
            continue
        *owner, name = re.split(r"[.:]", path)
        if owner:
            exported = ".".join(owner) == module
        else:
            exported = module is None and tokens.is_text(at - 1, "=") and not tokens.is_text(begins, "local")
        line = tokens.all[max(begins, 0)].line
        out.add(name, path, "method" if ":" in path else "function", exported, line, tokens.parameters(opens), tokens.docstring(line), module)
    return out


def javascript(source: str) -> Parsed:
    out, tokens = Parsed(), Tokens(source, JAVASCRIPT, javascript_literal, "`/")
    classes: list[tuple[int, str, int]] = []  # first and last place of the body, name; the innermost last
    for at, token in enumerate(tokens.all):
        while classes and at > classes[-1][2]:
            classes.pop()
        given = at + 1 + tokens.is_text(at + 1, "(") if token.text in ("require", "import") else at + 1
        if token.text in ("from", "require", "import") and given < len(tokens.all) and tokens.all[given].kind == "string":
            out.imports.append((tokens.all[given].text[1:-1], token.line))
        exported = any(tokens.is_text(at - i, "export") for i in (1, 2, 3) if all(x in MODIFIERS for x in tokens.texts(at - i, i)))
        line = tokens.all[at - next(i for i in range(at + 1) if i == at or tokens.all[at - i - 1].text not in MODIFIERS)].line
        if token.text == "class" and tokens.is_name(at + 1) and not tokens.is_text(at - 1, "."):
            name = tokens.all[at + 1].text
            body = next((i for i in range(at + 2, len(tokens.all)) if tokens.is_text(i, "{")), len(tokens.all))
            classes.append((body, name, tokens.closing(body)))
            out.add(name, name, "class", exported or name[0] != "_", line, docstring=tokens.docstring(line))
        elif token.text == "function" and tokens.is_name(named := at + 1 + tokens.is_text(at + 1, "*")) and not tokens.is_text(at - 1, "="):
            name, opens = tokens.all[named].text, next((i for i in range(named, len(tokens.all)) if tokens.is_text(i, "(")), len(tokens.all))
            out.add(name, name, "function", exported, line, tokens.parameters(opens), tokens.docstring(line))
        elif token.text in ("const", "let", "var") and tokens.is_name(at + 1) and (parameters := _function_value(tokens, at + 2)):
            name = tokens.all[at + 1].text
            out.add(name, name, "function", exported, line, parameters, tokens.docstring(line))
        elif classes and at > classes[-1][0] and token.kind == "name" and tokens.is_text(at + 1, "(") and _inside(tokens, classes[-1][0], at) and _body_follows(tokens, at + 1):
            owner = classes[-1][1]
            out.add(token.text, f"{owner}.{token.text}", "method", token.text[0] not in "_#", line, tokens.parameters(at + 1), tokens.docstring(line))
    return out


#: Words that stand before a definition.
MODIFIERS = frozenset("export default public private protected static async get set abstract override readonly".split())


def _function_value(tokens: Tokens, at: int) -> tuple[int, bool] | None:
    """The parameters of a function that is what a name is set to; at is the place after the name."""
    while at < len(tokens.all) and tokens.all[at].text not in ("=", ";", "{", ")"):
        at += 1  # over a type
    at += 1 + tokens.is_text(at + 1, "async")
    if tokens.is_text(at, "function"):
        opens = next((i for i in range(at, min(at + 4, len(tokens.all))) if tokens.is_text(i, "(")), len(tokens.all))
        return tokens.parameters(opens)
    if tokens.is_name(at) and tokens.is_text(at + 1, "=>"):
        return 1, False
    if tokens.is_text(at, "("):
        after = tokens.closing(at) + 1
        while after < len(tokens.all) and tokens.all[after].line == tokens.all[after - 1].line and tokens.all[after].text not in ("=>", ";"):
            after += 1  # over the type of the result
        return tokens.parameters(at) if tokens.is_text(after, "=>") else None
    return None


def _inside(tokens: Tokens, opens: int, at: int) -> bool:
    """Whether a place lies right in a body, in no further bracket, and begins a member."""
    before = tokens.all[at - 1].text
    return tokens.depth[at] == tokens.depth[opens] + 1 and (before in ("{", "}", ";", "*") or before in MODIFIERS or tokens.all[at - 1].line < tokens.all[at].line)


def _body_follows(tokens: Tokens, at: int) -> bool:
    after = tokens.closing(at) + 1
    while after < len(tokens.all) and tokens.all[after].text not in ("{", ";", "}", "="):
        after += 1
    return tokens.is_text(after, "{")


def python(source: str) -> Parsed:
    """A source that isn't valid Python gives what its longest valid beginning has."""
    out = Parsed()
    for node, owner in _definitions(_tree(source), None):
        if isinstance(node, ast.ImportFrom):
            out.imports.append(("." * node.level + (node.module or ""), node.lineno))
        elif isinstance(node, ast.Import):
            out.imports += [(x.name, node.lineno) for x in node.names]
        else:
            doc = next((x.strip() for x in (ast.get_docstring(node) or "").split("\n") if x.strip()), "")
            own = isinstance(node, ast.ClassDef)
            given = (0, False) if own else _parameters(node.args)
            full = f"{owner}.{node.name}" if owner and not own else node.name
            out.add(node.name, full, "class" if own else "method" if owner else "function", node.name[0] != "_", node.lineno, given, doc)
    return out


def _tree(source: str) -> ast.Module:
    while source:
        try:
            return ast.parse(source)
        except SyntaxError as e:
            lines = source.split("\n")
            source = "\n".join(lines[: max(0, min((e.lineno or 1) - 1, len(lines) - 1))])
        except ValueError:
            source = source.replace("\0", "")
    return ast.Module([], [])


def _definitions(node: ast.AST, owner: str | None) -> Iterator[tuple[ast.AST, str | None]]:
    for x in ast.iter_child_nodes(node):
        if isinstance(x, (ast.Import, ast.ImportFrom, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            yield x, owner
        inner = x.name if isinstance(x, ast.ClassDef) else None if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)) else owner
        yield from _definitions(x, inner)


def _parameters(a: ast.arguments) -> tuple[int, bool]:
    more = [x for x in (a.vararg, a.kwarg) if x]
    return len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + len(more), bool(more)


LANGUAGES = {lua: (".lua",), python: (".py",), javascript: (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx")}


def grammar_of(path: str):
    return next((read for read, suffixes in LANGUAGES.items() if path.endswith(suffixes)), None)


def parse(source: str, path: str) -> Parsed:
    """What the language of the path's suffix defines and imports; nothing for other suffixes."""
    read = grammar_of(path)
    return read(source.replace("\r\n", "\n").replace("\r", "\n")) if read else Parsed()


def first_line(source: str) -> str:
    """The first line that is neither blank nor a comment."""
    lines = (line.strip() for line in source.splitlines())
    return next((x for x in lines if x and not x.startswith(("--", "#", "//", "/*", "*"))), "")

"""Declarations of source texts in other languages than Python: a scanner of tokens with one stack of scopes.

A text is read once as tokens; comments and strings are single tokens, so what stands in them opens nothing. At the first token of each line the heads that
the language knows are tried on the tokens that follow. A head waits for its block; blocks and, where a language closes them by a word, bodies live on one
stack, which gives every declaration its last line and every member the containers around it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Symbol:
    name: str
    kind: str
    start: int
    end: int
    sig: str


#: Words that never are names of declarations; lines longer than this declare nothing.
RESERVED = frozenset("if for while switch catch return else do try new throw sizeof typeof await function constructor super delete case".split())
LONG_LINE = 300
#: Kinds of declarations that members belong to, kinds of one line.
CONTAINERS = frozenset("class impl type module".split())
ONE_LINE = frozenset("macro table declaration registration".split())
#: Macros that register a class in a table of a framework.
REGISTERING = re.compile(r"add\w*ToRunTimeSelectionTable|define\w*TypeName\w*|defineRunTimeSelectionTable|declareRunTimeSelectionTable|make[A-Z]\w*")
#: By language, the words that declare something and its kind; words that may stand in front.
KEYWORDS = {
    "javascript": {"function": "function", "class": "class"},
    "typescript": {"function": "function", "class": "class", "interface": "type", "type": "type", "enum": "type"},
    "rust": {"fn": "function", "struct": "type", "enum": "type", "trait": "type", "union": "type", "impl": "impl", "mod": "module"},
    "java": {"class": "class", "interface": "class", "enum": "class", "record": "class"},
    "kotlin": {"class": "class", "interface": "class", "object": "class", "fun": "function"},
    "csharp": {"class": "class", "interface": "class", "struct": "class", "enum": "class", "record": "class"},
    "swift": {"class": "class", "struct": "class", "enum": "class", "protocol": "class", "extension": "class", "func": "function"},
    "php": {"class": "class", "interface": "class", "trait": "class", "enum": "class", "function": "function"},
    "scala": {"class": "class", "object": "class", "trait": "class", "def": "function"},
    "dart": {"class": "class"},
    "ruby": {"class": "class", "module": "class", "def": "function"},
    "lua": {"function": "function"},
    "elixir": {"defmodule": "module", "def": "function", "defp": "function"},
    "proto": {"message": "type", "service": "type", "enum": "type", "rpc": "method"},
    "cpp": {"class": "class", "struct": "class"},
}
MODIFIERS = {
    "javascript": "export default async abstract", "typescript": "export default declare async abstract", "rust": "pub async unsafe const", "kotlin": "public private internal override open suspend inline abstract data sealed enum",
    "java": "public private protected static final abstract sealed", "csharp": "public private protected internal static sealed abstract partial", "swift": "public private internal open static override final",
    "php": "abstract final public private protected static", "scala": "case abstract sealed final override private protected", "dart": "abstract", "lua": "local",
}
MEMBER_MODIFIERS = {
    "javascript": "static async get set public private protected", "typescript": "public private protected static readonly async abstract override",
    "java": "public private protected static final abstract synchronized native default", "csharp": "public private protected internal static virtual override async abstract", "cpp": "virtual static inline explicit friend constexpr",
}
END_WORD = frozenset(["ruby", "lua", "elixir"])
SAME_AS = {"vue": "javascript", "svelte": "javascript", "objc": "c"}
LANGUAGES = frozenset([*KEYWORDS, *SAME_AS, "go", "c", "shell", "sql"])

_COMMENTS = {"ruby": "#", "shell": "#", "elixir": "#", "lua": "--", "sql": "--", "php": "//|#"}
#: What a line begins with that goes on with the head of the line before, and what the line before then ends with.
_GOES_ON = frozenset("{ ( : , extends implements where with throws const noexcept override final permits -> => = &&".split())
_UNFINISHED = frozenset(", = => ( : -> && || | & < +".split())


@dataclass(slots=True)
class Token:
    kind: str  # word, string, number, mark
    text: str
    at: int
    end: int
    line: int


@dataclass(slots=True)
class Scope:
    """An open block: the declaration it is the body of, if any, and where that began."""

    symbol: Symbol | None
    indent: int = 0
    container: bool = False


def _lexer(lang: str) -> re.Pattern[str]:
    comment = _COMMENTS.get(lang, "//")
    block = "" if lang in ("ruby", "shell", "elixir", "lua") else r"/\*.*?(?:\*/|\Z)|"
    quote = r"'(?:\\.|[^'\\\n])'" if lang == "rust" else r"'(?:\\.|[^'\\\n])*'"
    tick = "" if lang in ("ruby", "shell") else r"|`(?:\\.|[^`\\])*`"
    hashed = r"|(?P<directive>^[ \t]*#\w*)" if lang in ("c", "cpp") else ""
    return re.compile(
        rf"(?P<comment>{block}(?:{comment})[^\n]*){hashed}|(?P<string>\"(?:\\.|[^\"\\\n])*\"|{quote}{tick})|(?P<line>\n)|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>::|=>|->|&&|\|\||[^\s\w])",
        re.S | re.M,
    )


_LEXERS: dict[str, re.Pattern[str]] = {}


@dataclass
class Scanner:
    """One pass over a text; ``symbols`` are its declarations in order."""

    text: str
    lang: str
    symbols: list[Symbol] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.lines = self.text.split("\n")
        if self.lang not in _LEXERS:
            _LEXERS[self.lang] = _lexer(self.lang)
        self.tokens: list[Token] = []
        line = 1
        for m in _LEXERS[self.lang].finditer(self.text):
            kind = m.lastgroup
            if kind == "line":
                line += 1
            elif kind == "comment":
                line += m.group().count("\n")
            else:
                self.tokens.append(Token(kind, m.group(), m.start(), m.end(), line))
                line += m.group().count("\n") if kind == "string" else 0
        self.scopes: list[Scope] = []
        self.keywords = KEYWORDS.get(self.lang, {})
        self.modifiers = frozenset(MODIFIERS.get(self.lang, "").split())
        self.member_modifiers = frozenset(MEMBER_MODIFIERS.get(self.lang, "").split())
        self.recognise: Callable[[int], tuple[str, str] | None] = getattr(self, f"_head_{self.lang}", self._head)

    # tokens

    def word(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "word"

    def joined(self, i: int, marks: str) -> str:
        """The name at token ``i`` with what follows it without a blank: words and the given marks."""
        out, at = "", self.tokens[i].at if i < len(self.tokens) else -1
        while i < len(self.tokens) and self.tokens[i].at == at and (self.tokens[i].kind in ("word", "number") or self.tokens[i].text in marks.split()):
            out += self.tokens[i].text
            at = self.tokens[i].end
            i += 1
        return out

    def closing(self, i: int, open_: str, close: str) -> int:
        """The token that closes the bracket at ``i``; -1 if none does."""
        depth = 0
        for j in range(i, len(self.tokens)):
            text = self.tokens[j].text
            depth += (text == open_) - (text == close)
            if not depth:
                return j
        return -1

    def after_generics(self, i: int) -> int:
        return j + 1 if self.word(i) == "<" and (j := self.closing(i, "<", ">")) > 0 else i

    def on_line(self, i: int) -> list[Token]:
        """The tokens from ``i`` to the end of its line."""
        j = i
        while j < len(self.tokens) and self.tokens[j].line == self.tokens[i].line:
            j += 1
        return self.tokens[i:j]

    def indent(self, i: int) -> int:
        t = self.tokens[i]
        return t.at - (self.text.rfind("\n", 0, t.at) + 1)

    # heads: (name, kind) or None for the token a line begins with

    def _head(self, i: int) -> tuple[str, str] | None:
        first = i
        while self.word(i) in self.modifiers:
            i += 1
            if self.lang == "rust" and self.word(i) == "(":
                i = self.closing(i, "(", ")") + 1
        if self.lang == "java" and self.word(i) == "@" and self.word(i + 1) == "interface":
            i += 1
        kind = self.keywords.get(self.word(i))
        if kind and (self.is_name(i + 1) or kind == "impl" or (self.lang, self.word(i + 1)) in (("javascript", "*"), ("kotlin", "<"))):
            return self._named(i, kind)
        return self._member(first)

    def _named(self, i: int, kind: str) -> tuple[str, str] | None:
        lang, i = self.lang, i + 1
        if kind == "impl":
            i = self.after_generics(i)
            rest = [t.text for t in self.on_line(i)]
            i += rest.index("for") + 1 if "for" in rest[: rest.index("{") if "{" in rest else None] else 0
            name = self.joined(i, "::")
            return (name, kind) if name else None
        if kind == "module" and lang == "rust" and self.word(i + 1) != "{":
            return None
        if self.word(i) == "*":
            i += 1
        if lang == "kotlin" and kind == "function":
            i = self.after_generics(i)
            while self.word(k := self.after_generics(i + 1)) == ".":  # a receiver
                i = k + 1
            return self.word(i), kind
        if lang == "ruby":
            name = self.joined(i, ":: . ? ! =")
            return (name.removeprefix("self.") if kind == "function" else name.split("?")[0]), kind
        if lang in ("lua", "elixir"):
            return self.joined(i, ". : ? !" if kind != "module" else "."), kind
        return self.word(i), kind

    def _member(self, i: int) -> tuple[str, str] | None:
        """Methods of the languages that declare them by modifiers, types and parentheses alone."""
        if self.lang not in self._MEMBERS or self.indent(i) < 1:
            return None
        return self._MEMBERS[self.lang](self, i)

    def _method_after_type(self, i: int) -> tuple[str, str] | None:
        j = i
        while self.word(j) in self.member_modifiers:
            j += 1
        line = self.on_line(j)
        paren = next((k for k, t in enumerate(line) if t.text == "("), 0)
        typed = all(t.kind == "word" or t.text in "<>[],?" for t in line[:paren])
        return (line[paren - 1].text, "method") if j > i and paren >= 2 and typed and line[paren - 1].kind == "word" else None

    def _script_method(self, i: int) -> tuple[str, str] | None:
        if self.indent(i) < 2:
            return None
        j = i
        while self.word(j) in self.member_modifiers or self.word(j) in MEMBER_MODIFIERS["javascript"].split() and self.is_name(j + 1):
            j += 1
        if not self.is_name(j) or self.word(k := self.after_generics(j + 1)) != "(":
            return None
        if self.lang == "typescript" and j > i:
            return self.word(j), "method"
        close = self.closing(k, "(", ")")
        line = self.tokens[i].line
        if close < 0 or self.tokens[close].line != line:
            return None
        rest = [t.text for t in self.on_line(close)[1:]]
        body = rest.index("{") if "{" in rest else -1
        return (self.word(j), "method") if body == 0 or body > 1 and rest[0] == ":" and not {"=", ";"} & set(rest[:body]) else None

    _MEMBERS = {"java": _method_after_type, "csharp": _method_after_type, "javascript": _script_method, "typescript": _script_method}

    def _head_javascript(self, i: int) -> tuple[str, str] | None:
        j = i + (self.word(i) == "export")
        if self.word(j) in ("const", "let", "var") and self.is_name(j + 1) and self.word(j + 2) == "=":
            k = j + 3 + (self.word(j + 3) == "async")
            arrow = self.closing(k, "(", ")") + 1 if self.word(k) == "(" else k + 1
            return (self.word(j + 1), "function") if self.word(k) == "function" or arrow > 0 and self.word(arrow) == "=>" else None
        return self._head(i)

    _head_typescript = _head_javascript

    def _head_go(self, i: int) -> tuple[str, str] | None:
        if self.indent(i):
            return None
        if self.word(i) == "func" and self.word(i + 1) == "(":
            close = self.closing(i + 1, "(", ")")
            own = [t.text for t in self.tokens[i + 2 : close] if t.kind == "word"]
            return (f"{own[1] if len(own) > 1 else own[0]}.{self.word(close + 1)}", "method") if own and self.is_name(close + 1) else None
        if self.word(i) == "func" and self.is_name(i + 1):
            return self.word(i + 1), "function"
        return (self.word(i + 1), "type") if self.word(i) == "type" and self.word(i + 2) in ("struct", "interface") else None

    def _head_dart(self, i: int) -> tuple[str, str] | None:
        found = self._head(i)
        line = self.on_line(i)
        paren = next((k for k, t in enumerate(line) if t.text == "("), 0)
        if found or paren < 2 or line[-1].text != "{" or any(t.text == ";" for t in line):
            return found
        typed = all(t.kind == "word" or t.text in "<>?," for t in line[:paren])
        return (line[paren - 1].text, "function") if typed and line[paren - 1].kind == "word" else None

    def _head_shell(self, i: int) -> tuple[str, str] | None:
        j = i + (self.word(i) == "function")
        name = self.joined(j, "-")
        k = next((k for k in range(j, min(j + 12, len(self.tokens))) if self.word(k) == "("), -1)
        return (name, "function") if name and k > 0 and self.word(k + 1) == ")" and self.word(k + 2) == "{" and self.tokens[k + 2].line == self.tokens[i].line else None

    def _head_sql(self, i: int) -> tuple[str, str] | None:
        words = [t.text.lower() for t in self.tokens[i : i + 8]]
        if words[:1] != ["create"]:
            return None
        k = 3 if words[1:3] == ["or", "replace"] else 1
        if words[k : k + 1] and words[k] in ("table", "view", "function", "procedure", "index"):
            k += 4 if words[k + 1 : k + 4] == ["if", "not", "exists"] else 1
            name = self.joined(i + k, ".") or (self.word(i + k) if i + k < len(self.tokens) and self.tokens[i + k].kind == "string" else "")
            return (name, "table") if name else None
        return None

    def _head_c(self, i: int) -> tuple[str, str] | None:
        if self.indent(i) and self.tokens[i].kind != "directive":
            return None
        if self.word(i).strip() == "#define" and not self.indent(i):
            return self.word(i + 1), "macro"
        j = i + (self.word(i) == "typedef")
        if self.word(j) == "struct" and self.is_name(j + 1) and self.word(j + 2) == "{":
            return self.word(j + 1), "type"
        line = self.on_line(i)
        paren = next((k for k, t in enumerate(line) if t.text == "("), 0)
        typed = all(t.kind == "word" or t.text == "*" for t in line[:paren])
        whole = not any(t.text == ";" for t in line)
        return (line[paren - 1].text, "function") if paren >= 2 and typed and whole and self.is_name(i) and line[paren - 1].kind == "word" else None

    def _head_cpp(self, i: int) -> tuple[str, str] | None:
        line = self.on_line(i)
        texts = [t.text for t in line]
        if self.indent(i) <= 4 and REGISTERING.fullmatch(texts[0]) and texts[1:2] == ["("] and not {"{", "}"} & set(texts) and texts.count(";") <= 1 and (texts[-1] == ")" or texts[-2:] == [")", ";"]):
            inside = any(s.symbol is not None and s.symbol.kind in ("method", "function") for s in self.scopes)
            return None if inside else (re.sub(r"\s+", " ", self.lines[self.tokens[i].line - 1]).strip().rstrip(";").strip(), "registration")
        found = self._head_c(i)
        if found:
            return found
        j = i
        if texts[0] == "template":
            j = self.after_generics(i + 1)
            if j >= len(self.tokens) or self.tokens[j].line != self.tokens[i].line:
                return None
        if self.word(j) in self.keywords and self.is_name(j + 1):
            return None if ";" in texts else (self.word(j + 1), "class")
        return self._definition(i, line) if not self.indent(i) else self._declaration(i, line)

    def _definition(self, i: int, line: list[Token]) -> tuple[str, str] | None:
        """A qualified name before a parameter list, which may stand on the next line; template arguments aren't part of the name."""
        bare, depth = [], 0
        for t in line:
            if t.text == "(" and not depth and not (bare and bare[-1].text == "operator"):
                break
            depth += (t.text == "<") - (t.text == ">") if not any(b.text == "operator" for b in bare) else 0
            if depth == 0 and t.text != ">" or any(b.text == "operator" for b in bare):
                bare.append(t)
        else:
            if self.word(i + len(line)) != "(":
                return None
        k = len(bare)
        name = ""
        start = next((n for n, b in enumerate(bare) if b.text == "operator"), k - 1)
        if start < 0 or start == k - 1 and bare and bare[-1].kind != "word":
            return None
        name = "".join(b.text for b in bare[start:])
        n = start - 1
        if n >= 0 and bare[n].text == "~":
            name, n = "~" + name, n - 1
        if n < 1 or bare[n].text != "::":
            return None
        while n >= 1 and bare[n].text == "::" and bare[n - 1].kind == "word":
            name, n = f"{bare[n - 1].text}::{name}", n - 2
        return (name, "method") if all(b.kind == "word" or b.text in ("::", "*", "&", ",") for b in bare[: n + 1]) else None

    def _declaration(self, i: int, line: list[Token]) -> tuple[str, str] | None:
        """A member declared on one line inside a class: a type before its name, or the name of the class."""
        box = next((s.symbol for s in reversed(self.scopes) if s.container), None)
        texts = [t.text for t in line]
        if box is None or not self.scopes[-1].container or texts[-1:] != [";"] or "{" in texts or "(" not in texts or texts[0] in RESERVED:
            return None
        paren = texts.index("(")
        name = texts[paren - 1] if paren else ""
        before = [t for t in texts[: paren - 1] if t not in self.member_modifiers and t != "~"]
        if not paren or line[paren - 1].kind != "word" or any(t in ("=", ".", "->", "return") for t in texts[:paren]):
            return None
        if name in RESERVED or not before and name != box.name.rsplit(".", 1)[-1]:
            return None
        tilde = "~" if paren > 1 and texts[paren - 2] == "~" else ""
        return f"{box.name}.{tilde}{name}", "declaration"

    # the pass

    def run(self) -> list[Symbol]:
        """The declarations of the text."""
        waiting: Symbol | None = None
        depth = base = 0
        templates = 0  # the first of the template lines just before
        for i, t in enumerate(self.tokens):
            fresh = i == 0 or self.tokens[i - 1].line < t.line
            if fresh:
                if waiting and depth <= base and t.text not in _GOES_ON and self.word(i - 1) not in _UNFINISHED:
                    waiting = None
                if self.lang in END_WORD and t.text == "end":
                    self._end(i)
                elif depth == 0 or depth <= base:
                    symbol = self._declared(i)
                    if symbol is not None:
                        symbol.start = templates or symbol.start
                        waiting, base = (symbol, depth) if symbol.kind not in ONE_LINE else (None, depth)
                        if self.lang in END_WORD:
                            self.scopes.append(Scope(symbol, self.indent(i), symbol.kind in CONTAINERS))
                            waiting = None
                if self.lang == "cpp":
                    templates = (templates or t.line) if t.text == "template" else 0
            if t.kind != "mark" or self.lang in END_WORD:
                continue
            if t.text in "([":
                depth += 1
            elif t.text in ")]":
                depth = max(0, depth - 1)
            elif t.text == "{":
                mine = waiting if depth <= base else None
                self.scopes.append(Scope(mine, depth, mine is not None and mine.kind in CONTAINERS))
                waiting, depth, base = (None, 0, 0) if mine is not None or depth == 0 else (waiting, depth, base)
            elif t.text == "}" and self.scopes:
                scope = self.scopes.pop()
                if scope.symbol is not None:
                    scope.symbol.end = t.line
                depth = scope.indent
            elif t.text == ";" and waiting and depth <= base:
                waiting.end, waiting = t.line, None
        return self.symbols

    def _end(self, i: int) -> None:
        """A line with the closing word alone closes the declaration that began at its indent."""
        rest = "".join(x.text for x in self.on_line(i)[1:])
        at = next((k for k in range(len(self.scopes) - 1, -1, -1) if self.scopes[k].indent == self.indent(i)), -1)
        if rest in ("", ")", ",") and at >= 0:
            self.scopes[at].symbol.end = self.tokens[i].line
            del self.scopes[at:]

    def _declared(self, i: int) -> Symbol | None:
        line = self.tokens[i].line
        text = self.lines[line - 1]
        if len(text) > LONG_LINE:
            return None
        found = self.recognise(i)
        if found is None or not found[0] or found[0] in RESERVED:
            return None
        name, kind = found
        around = [s.symbol.name for s in reversed(self.scopes) if s.container]
        if kind in ("function", "method") and "." not in name and around:
            name, kind = ".".join([*around, name]), "method"  # the inner containers first
        symbol = Symbol(name, kind, line, line, re.sub(r"\s+", " ", text.strip())[:200])
        self.symbols.append(symbol)
        return symbol


def declarations(text: str, lang: str) -> list[Symbol]:
    """The declarations of a text in a language of ``LANGUAGES``; none in others."""
    lang = SAME_AS.get(lang, lang)
    return Scanner(text, lang).run() if lang in LANGUAGES else []

"""Symbols, calls and imports of JavaScript, TypeScript, Java and Go, without grammars: a scanner that honours strings, comments
and brackets, and for each language the few forms of declaration that matter.

A file becomes tokens in one pass of one pattern; brackets are matched with a stack, so that any declaration's end is known.
Nothing recurses, and text that is no program gives what can be recognised, never an error. Not recognised: methods of
anonymous classes and object literals; a regular expression that follows a closing bracket; JSX text counts as code.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from cairn.operators.parse import EDGES, SYMBOLS, per_file

#: What a source is made of, in the order of trial; a slash begins a regular expression only where an operand may begin.
_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?(?:\*/|$))"""
    r'''|(?P<string>"""(?:[^\\]|\\.)*?(?:"""|$)|"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?)'''
    r"""|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>=>|:=|\?\.|\.\.\.|&&|\|\||.)""",
    re.S,
)
_REGEX = re.compile(r"/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_OPERAND_FOLLOWS = set("( , = : [ ! & | ? { } ; + - * % < > ~ ^ => && || return typeof case in of".split())
_PAIRS = {")": "(", "]": "[", "}": "{"}
_OPENING = frozenset("([{")

#: Words before a bracket that are no calls.
_NO_CALL = {
    "javascript": frozenset("if for while switch catch function return typeof await super constructor with void delete in of import".split()),
    "java": frozenset("if for while switch catch synchronized try return super this assert throw new".split()),
    "go": frozenset("func if for switch select return go defer range case interface struct map chan import var type const".split()),
}


#: Go's raw strings know no escapes.
_GO_TOKEN = re.compile(_TOKEN.pattern.replace(r"`(?:[^`\\]|\\.)*`?", "`[^`]*`?"), re.S)


def tokens(source: str, language: str) -> tuple[list[str], list[str], list[int], list[int]]:
    """Kinds and texts of the tokens, and the lines on which they begin and end."""
    kinds, texts, lines, lasts, at, line = [], [], [], [], 0, 1
    pattern = _GO_TOKEN if language == "go" else _TOKEN
    while at < len(source):
        for m in pattern.finditer(source, at):
            kind, text, at = m.lastgroup, m[0], m.end()
            # what begins with a slash and is no comment
            literal = text == "/" and language == "javascript" and (not texts or texts[-1] in _OPERAND_FOLLOWS) and _REGEX.match(source, m.start())
            if literal:
                kind, text, at = "string", literal[0], literal.end()
            if kind == "space":
                line += text.count("\n")
                continue
            kinds.append(kind)
            texts.append(text)
            lines.append(line)
            if kind == "string":
                line += text.count("\n")
            lasts.append(line)
            if literal:
                break
    return kinds, texts, lines, lasts


class Source:
    """Tokens with matched brackets: ``close`` of an opening one, ``open`` of a closing one, ``depth`` of each token."""

    def __init__(self, text: str, language: str):
        self.kinds, self.texts, self.lines, self.lasts = tokens(text, language)
        self.n = len(self.texts)
        self.close, self.open, self.depth, stack, stray = {}, {}, [], [], False
        for k, x in enumerate(self.texts):
            if x in _PAIRS:
                if stack and self.texts[stack[-1]] == _PAIRS[x]:
                    self.open[k] = stack[-1]
                    self.close[stack.pop()] = k
                else:
                    stray = True
            self.depth.append(len(stack))
            if x in _OPENING:
                stack.append(k)
        self.broken = stray or bool(stack)
        for k in stack:  # never closed: to the end of the file
            self.close[k] = self.n - 1

    def text(self, k: int) -> str:
        return self.texts[k] if 0 <= k < self.n else ""

    def word(self, k: int) -> bool:
        return 0 <= k < self.n and self.kinds[k] == "word"

    def skip(self, k: int, until: str, stop: str = "") -> int:
        """The next token at this depth that is one of ``until``, brackets passed over; the file's length if there is none, or one
        of ``stop`` comes first."""
        while k < self.n:
            if self.kinds[k] == "sign":
                if self.texts[k] in until:
                    return k
                if self.texts[k] in stop or self.texts[k] in _PAIRS:
                    break
                if self.texts[k] in "([{":
                    k = self.close[k]
            k += 1
        return self.n

    def end(self, k: int) -> int:
        return self.lasts[min(k, self.n - 1)]


def _statement_end(s: Source, k: int) -> int:
    """The last token of a statement without braces of its own: at a semicolon, or at a line's end where nothing is open."""
    depth = s.depth[k]
    while True:
        if s.kinds[k] == "sign" and s.text(k) in ("(", "[", "{"):
            k = s.close[k]
        if s.text(k) == ";" or k + 1 >= s.n or s.depth[k + 1] < depth:
            return k
        ahead = s.texts[k + 1]
        goes_on = s.kinds[k] == "sign" and s.text(k) not in (")", "]", "}")
        taken_up = s.kinds[k + 1] == "sign" and ahead not in ("{", "(", "[", ";", "}", "@", "#")
        if s.lines[k + 1] > s.lasts[k] and not goes_on and not taken_up:
            return k
        k += 1


_DECLARE = frozenset(("class", "function", "const", "let", "var"))


def _javascript(s: Source) -> list[tuple]:
    found, k = [], 0
    bodies: list[int] = []  # ends of class bodies that are open
    while k < s.n:
        while bodies and k > bodies[-1]:
            bodies.pop()
        if s.texts[k] not in _DECLARE and not (bodies and s.depth[k] == s.depth[bodies[-1]] + 1):
            k += 1
            continue
        before = s.text(k - 1)
        declares = s.kinds[k] == "word" and (k == 0 or before in (";", "}", "{", ")", "export", "default", "async", "abstract") or (s.lasts[k - 1] < s.lines[k] and before not in _OPERAND_FOLLOWS and before != "."))
        start = s.lines[k]
        back = k - 1
        while back >= 0 and s.text(back) in ("async", "abstract"):
            start, back = s.lines[back], back - 1
        if declares and s.text(k) == "class" and s.word(k + 1):
            body = s.skip(k + 2, "{", ";")
            if body < s.n:
                found.append((s.text(k + 1), "class", start, s.end(s.close[body])))
                bodies.append(s.close[body])
                k = body + 1
                continue
        elif declares and s.text(k) == "function":
            name = k + 1 + (s.text(k + 1) == "*")
            body = s.skip(s.close.get(name + 1, s.n) + 1, "{", ";")
            if s.word(name) and body < s.n:
                found.append((s.text(name), "function", start, s.end(s.close[body])))
                k = body + 1
                continue
        elif declares and s.depth[k] == 0 and s.text(k) in ("const", "let", "var") and before not in ("export", "default"):
            end, name = _statement_end(s, k), k + 1
            while name <= end:
                if s.word(name):
                    found.append((s.text(name), "variable", start, s.end(end)))
                name = s.skip(name, ",", ";") + 1
            k = end + 1
            continue
        elif bodies and s.depth[k] == s.depth[bodies[-1]] + 1:
            member = _method(s, k, bodies[-1])
            if member:
                found.append((member[0], "function", start, s.end(member[1])))
                k = member[1] + 1
                continue
            end = _statement_end(s, k)  # a field, or a sign
            k = max(k + 1, min(end + 1, bodies[-1]))
            continue
        k += 1
    return found


def _method(s: Source, k: int, limit: int) -> tuple[str, int] | None:
    """(name, last token) of a method that begins at ``k``, with modifiers before its name."""
    while k < limit and (s.text(k) in ("static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "*", "#") and s.text(k + 1) not in ("(", "=")):
        k += 1
    if not (s.word(k) or s.kinds[k] in ("string", "number")):
        return None
    name, k = s.text(k), k + 1
    if s.text(k) == "<":  # type parameters
        while k < limit and s.text(k) != "(":
            k += 1
    if s.text(k) != "(":
        return None
    body = s.skip(s.close[k] + 1, "{", ";=")
    return (name, s.close[body]) if body < limit else None


_TYPES = frozenset(("class", "interface", "enum", "record"))


def _java(s: Source) -> list[tuple]:
    found, k = [], 0
    while k < s.n:
        if s.texts[k] in _TYPES and s.word(k + 1) and s.text(k - 1) != ".":
            body = s.skip(k + 2, "{", ";")
            if body < s.n:
                if s.text(k) == "class":
                    found.append((s.text(k + 1), "class", s.lines[_from(s, k)], s.end(s.close[body])))
                found += _java_members(s, body, s.text(k + 1), s.text(k) == "enum")
        k += 1
    return sorted(found, key=lambda f: (f[2], -f[3]))


def _from(s: Source, k: int) -> int:
    """The first token of the declaration that ``k`` is part of: what follows the last end of another, annotations included."""
    while k > 0 and not (s.kinds[k - 1] == "sign" and s.text(k - 1) in (";", "{", "}")):
        k -= 1
        if s.text(k) == ")" and k in s.open:
            k = s.open[k]
    return k


def _java_members(s: Source, body: int, owner: str, enum: bool) -> list[tuple]:
    found, k, end = [], body + 1, s.close[body]
    if enum:
        k = s.skip(k, ";") + 1
    while k < end:
        first, name, call = k, None, None
        while k < end and (x := s.texts[k]) not in (";", "=", "{"):
            if x == "@" and s.word(k + 1):  # an annotation, perhaps with arguments
                k += 2
                while s.text(k) == ".":
                    k += 2
                k = s.close[k] + 1 if s.text(k) == "(" else k
                continue
            if x in _TYPES and s.word(k + 1):
                name, call = None, -1
            if x == "(" and call is None:
                call, name = k, s.text(k - 1)
                k = s.close[k]
            elif x in ("(", "["):
                k = s.close[k]
            elif call is None and s.word(k):
                name = x
            k += 1
        sign = s.text(k)
        if k >= end:
            break
        last = s.close[k] if sign == "{" else s.skip(k, ";") if sign == "=" else k
        if call is not None and call >= 0 and name and (k - first > 1) and (call - first > 1 or name == owner):
            found.append((name, "function", s.lines[first], s.end(last)))
        elif call is None and name and sign in (";", "=") and k - first > 1 and s.text(first) not in ("import", "package"):
            found.append((name, "variable", s.lines[first], s.end(last)))
        k = min(last, end) + 1
    return found


def _go(s: Source) -> list[tuple]:
    found, k = [], 0
    while k < s.n:
        if s.texts[k] not in ("func", "type", "var"):
            k += 1
            continue
        if s.depth[k] == 0 and s.text(k) == "func":
            name = s.close[k + 1] + 1 if s.text(k + 1) == "(" else k + 1
            body = s.skip(name + 1, "{")
            while body < s.n and s.text(body - 1) in ("interface", "struct"):  # a type without a name among the results
                body = s.skip(s.close[body] + 1, "{")
            if s.word(name):
                last = s.close[body] if body < s.n and s.lines[body] <= s.end(s.close.get(name + 1, name)) + 1 else s.close.get(name + 1, name)
                found.append((s.text(name), "function", s.lines[k], s.end(last)))
                k = last
        elif s.text(k) == "type" and (s.word(k + 1) or s.text(k + 1) == "("):
            group = s.text(k + 1) == "("
            last = s.close[k + 1] if group else None
            for x in range(k + 1, last if group else k + 2):
                if s.word(x) and s.text(x + 1) == "struct" and s.text(x + 2) == "{":
                    found.append((s.text(x), "class", s.lines[k], s.end(last if group else s.close[x + 2])))
        elif s.depth[k] == 0 and s.text(k) == "var":
            if s.text(k + 1) == "(":
                last = s.close[k + 1]
                names = [x for x in range(k + 2, last) if s.word(x) and s.depth[x] == 1 and s.lines[x] > s.lasts[x - 1]]
            else:
                names, last = [k + 1] * s.word(k + 1), _statement_end(s, k)
            found += [(s.text(x), "variable", s.lines[k], s.end(last)) for x in names]
            k = last
        k += 1
    return found


_SYMBOLS = {"javascript": _javascript, "typescript": _javascript, "java": _java, "go": _go}
LANGUAGES = frozenset(_SYMBOLS)


def _source(source: str, language: str) -> Source:
    return Source(source, "javascript" if language == "typescript" else language)


def symbols(path: str, source: str, language: str, own: Source | None = None) -> list[tuple]:
    """Rows of SYMBOLS."""
    own = own or _source(source, language)
    return [(path, k, *f) for k, f in enumerate(_SYMBOLS[language](own))] if own.n else []


def rows(path: str, source: str, language: str, references: bool = True) -> list[tuple]:
    """Symbols and (if wanted) references of a file, scanned once: (path, ord, kind, name, first line, last line); where brackets do not match, also a row of
    kind broken."""
    if language not in _SYMBOLS:
        return []
    own = _source(source, language)
    found = [(p, k, kind, name, a, b) for p, k, name, kind, a, b in symbols(path, source, language, own)]
    found += [(p, k, kind, target, line, line) for p, k, kind, target, line in edges(path, source, language, own)] if references else []
    return [*found, (path, -1, "broken", None, 0, 0)] if own.broken else found


def _callee(s: Source, k: int) -> int:
    """The first token of what is called where a bracket opens at ``k``: names joined by dots, calls and indexes among them."""
    at = k - 1
    while at > 0:
        if s.text(at) in (")", "]") and at in s.open:
            at = s.open[at] - 1
        elif s.text(at - 1) in (".", "?."):
            at -= 2
        else:
            break
    return at


def edges(path: str, source: str, language: str, own: Source | None = None) -> list[tuple]:
    """Rows of EDGES: calls and imports with their lines."""
    kind = "javascript" if language == "typescript" else language
    s, found = own or _source(source, language), []
    for k, (word, after) in enumerate(zip(s.texts, [*s.texts[1:], ""])):
        if word == "import" and s.kinds[k] == "word" and s.text(k - 1) != "." and (after != "(" or kind == "go"):
            found += _imports(s, k, kind)
        if after != "(" or not s.word(k) or word in _NO_CALL[kind] or s.text(k - 1) in ("function", "func", "new", "@", "*"):
            continue
        close = s.close.get(k + 1, s.n)
        if kind != "go" and s.text(k - 1) not in (".", "?.") and _is_declaration(s, k, close, kind):
            continue
        if kind == "go" and s.text(k - 1) == ")" and s.text(s.open.get(k - 1, 0) - 1) == "func":
            continue
        start = _callee(s, k + 1)
        made = "new " * (s.text(start - 1) == "new")  # a method of what was just made
        found.append(("call", made + "".join(s.texts[start : k + 1]), s.lines[start]))
    return [(path, n, *f) for n, f in enumerate(sorted(found, key=lambda f: (f[2], f[0], f[1])))]


def _is_declaration(s: Source, k: int, close: int, kind: str) -> bool:
    """Whether a name with brackets is a method's head: a body or (Java) a throws clause follows, and no operator comes before."""
    if s.text(close + 1) == "{" or (kind == "javascript" and s.text(close + 1) == ":" and s.text(s.skip(close + 2, "{", ";,)")) == "{"):
        return s.text(k - 1) not in ("=", "(", ",", "return", "=>", "&&", "||", "!", "?", ":")
    return kind == "java" and (s.text(close + 1) == "throws" or (s.word(k - 1) and s.text(k - 1) not in ("return", "throw", "else", "do", "case", "yield", "assert")) or s.text(k - 1) in (">", "]"))


def _imports(s: Source, k: int, kind: str) -> list[tuple]:
    line = s.lines[k]
    if kind == "java":
        end, parts = s.skip(k, ";"), []
        for x in range(k + 1, min(end, s.n)):
            if s.text(x) != "static":
                parts.append(s.text(x))
        names = "".join(parts).split(".")
        if len(names) > 1 and names[-1][:1].islower():  # a method of the class before it
            names.pop()
        return [("import", ".".join(names), line)] if names[0] else []
    if kind == "go":
        last = s.close[k + 1] if s.text(k + 1) == "(" else k + 2
        return [("import", s.text(x)[1:-1], line) for x in range(k + 1, min(last + 1, s.n)) if s.kinds[x] == "string"]
    for x in range(k + 1, min(k + 400, s.n)):
        if s.kinds[x] == "string":
            return [("import", s.text(x)[1:-1], line)]
        if s.text(x) in (";", "=", "("):
            break
    return []


def parse_symbols_braces(files: DataFrame) -> DataFrame:
    """Symbols of files (path, content, language) in one of the languages above; others give none."""
    return per_file(files, lambda path, source, language: symbols(path, source, language) if language in _SYMBOLS else [], SYMBOLS, "language")


def extract_edges_braces(files: DataFrame) -> DataFrame:
    """Imports and calls of files (path, content, language), with their lines."""
    return per_file(files, lambda path, source, language: edges(path, source, language) if language in _SYMBOLS else [], EDGES, "language")

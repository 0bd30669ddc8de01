"""A tolerant parser for Java declarations and calls.

It reads what the tables need: package, imports, the first type's header, all methods, fields, annotations and method calls of a file,
nested types included. Bodies are scanned for calls and local variables rather than fully parsed. A file that can't be read gives an error
text and no components; nothing is carried over from one file to the next.
"""

from __future__ import annotations

import re
from typing import NamedTuple

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<text>\"\"\".*?(?<!\\)\"\"\"|"(?:\\.|[^"\\\n])*")|(?P<char>'(?:\\.|[^'\\\n])+')"""
    r"""|(?P<num>\.?\d[\w.]*)|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<op>->|::|\.\.\.|>>>=|<<=|>>=|[-+*/%&|^!=<>]=|&&|\|\||\+\+|--|<<|.)""",
    re.S,
)
MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed", "non-sealed"}
KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "new", "else", "do", "try", "throw", "synchronized", "assert", "case", "super", "this", "instanceof", "yield", "throws", "finally", "break", "continue", "default"}
PRIMITIVES = {"int", "long", "short", "byte", "char", "boolean", "float", "double", "void", "var"}
REST_OWNER = "WebClient"


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    start: int
    end: int


class ParseError(ValueError):
    pass


def tokenize(source: str) -> list[Token]:
    out, line, at = [], 1, 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        text = m.group()
        if m.lastgroup != "skip":
            if text == '"' or text == "'":
                raise ParseError(f"line {line}: literal isn't closed")
            out.append(Token(m.lastgroup, text, line, at, m.end()))
        line += text.count("\n")
        at = m.end()
    return out


def unescape(literal: str) -> str:
    if literal.startswith('"""'):
        return literal[3:-3].lstrip("\n")
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), literal[1:-1])


class Parser:
    def __init__(self, source: str):
        self.source = source
        self.tokens = tokenize(source)
        self.pair = self._brackets()
        self.package, self.imports = "", []
        self.types: list[dict] = []
        self.methods: list[dict] = []
        self.fields: list[dict] = []
        self.calls: list[dict] = []
        self.annotations: list[dict] = []

    # -- tokens

    def _brackets(self) -> dict[int, int]:
        closing, stack, pair = {")": "(", "]": "[", "}": "{"}, [], {}
        for i, t in enumerate(self.tokens):
            if t.kind != "op":
                continue
            if t.text in "([{" and len(t.text) == 1:
                stack.append(i)
            elif t.text in closing:
                if not stack or self.tokens[stack[-1]].text != closing[t.text]:
                    raise ParseError(f"line {t.line}: {t.text} without partner")
                pair[stack.pop()] = i
        if stack:
            raise ParseError(f"line {self.tokens[stack[-1]].line}: {self.tokens[stack[-1]].text} isn't closed")
        return pair

    def at(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def is_word(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "word"

    def text(self, a: int, b: int) -> str:
        """Source text of the tokens a..b-1 with single spaces where the source has white space."""
        return re.sub(r"\s+", " ", self.source[self.tokens[a].start : self.tokens[b - 1].end]) if b > a else ""

    def place(self, a: int, b: int) -> dict:
        return {"start_line": self.tokens[a].line, "end_line": self.tokens[max(a, b - 1)].line}

    def qualified(self, i: int) -> tuple[str, int]:
        name = self.at(i)
        i += 1
        while self.at(i) == "." and (self.is_word(i + 1) or self.at(i + 1) == "*"):
            name += "." + self.at(i + 1)
            i += 2
        return name, i

    def generic(self, i: int) -> int:
        """The place after a <...> that begins at i."""
        depth = 0
        while i < len(self.tokens):
            x = self.at(i)
            if x in ("<", "<<", ">", ">>"):
                depth += x.count("<") - x.count(">")
            elif x == "(" or x == "[":
                i = self.pair[i]
            elif x in (";", "{", "}", ")"):
                break
            i += 1
            if depth <= 0:
                break
        return i

    def type_at(self, i: int) -> int:
        """The place after a type that begins at i, or i if there is none."""
        start = i
        i = self.skip_annotations(i)
        if not self.is_word(i) or self.at(i) in KEYWORDS or self.at(i) in MODIFIERS:
            return start
        while True:
            _, i = self.qualified(i)
            if self.at(i) == "<":
                i = self.generic(i)
            if self.at(i) == "." and self.is_word(i + 1):
                i += 1
                continue
            break
        while self.at(i) == "[" and self.at(i + 1) == "]":
            i += 2
        return i

    # -- annotations

    def skip_annotations(self, i: int) -> int:
        while self.at(i) == "@" and self.at(i + 1) != "interface":
            _, i = self.qualified(i + 1)
            if self.at(i) == "(":
                i = self.pair[i] + 1
        return i

    def annotation(self, i: int) -> tuple[dict, int]:
        first = i
        name, i = self.qualified(i + 1)
        name = name.rsplit(".", 1)[-1]
        attributes: dict[str, str] = {}
        if self.at(i) == "(":
            end = self.pair[i]
            if end > i + 1:
                if self.is_word(i + 1) and self.at(i + 2) == "=":
                    for a, b in self.split(i + 1, end):
                        if self.is_word(a) and self.at(a + 1) == "=":
                            attributes[self.at(a)] = self.value(a + 2, b)
                elif end == i + 2 and self.tokens[i + 1].kind == "text":
                    attributes["default"] = unescape(self.at(i + 1))
                elif end > i + 1 and self.at(i + 1) == "{" and end == self.pair[i + 1] + 1:
                    attributes["default"] = self.value(i + 1, end)
            i = end + 1
        return {"name": name, "attributes": attributes, "location": self.place(first, i)}, i

    def value(self, a: int, b: int) -> str:
        """An attribute's value: a string literal's content, else source text; a one-element array counts as its element."""
        if self.at(a) == "{" and b == self.pair[a] + 1 and len(list(self.split(a + 1, b - 1))) == 1:
            a, b = a + 1, b - 1
        return unescape(self.at(a)) if b == a + 1 and self.tokens[a].kind == "text" else self.text(a, b)

    def split(self, a: int, b: int, sep: str = ","):
        """Ranges between separators at the top level of a..b-1."""
        start, i, depth = a, a, 0
        while i < b:
            x = self.at(i)
            if i in self.pair:
                i = self.pair[i]
            elif x == "<" and self.is_word(i - 1) and (self.at(i - 1)[:1].isupper() or depth):
                end = self.generic(i)
                if self.at(end - 1) in (">", ">>") and end <= b:
                    i = end - 1
            elif x == sep:
                yield start, i
                start = i + 1
            i += 1
        if b > start:
            yield start, b

    def modifiers(self, i: int) -> tuple[list[dict], set[str], int]:
        found, words = [], set()
        while True:
            if self.at(i) == "@" and self.at(i + 1) != "interface":
                a, i = self.annotation(i)
                found.append(a)
            elif self.at(i) == "non" and self.at(i + 1) == "-" and self.at(i + 2) == "sealed":
                i += 3
            elif self.at(i) in MODIFIERS and not (self.at(i) == "default" and self.at(i + 1) in (":", "->")):
                words.add(self.at(i))
                i += 1
            else:
                return found, words, i

    def note(self, found: list[dict], kind: str, owner: str) -> None:
        for a in found:
            self.annotations.append({"ordinal": len(self.annotations), "owner_kind": kind, "owner_id": owner, **a})

    # -- declarations

    def parse(self) -> Parser:
        i = 0
        found, words, i = self.modifiers(i)
        if self.at(i) == "package":
            self.package, i = self.qualified(i + 1)
            i += 1
            found, words, i = self.modifiers(i)
        while self.at(i) == "import" and not found and not words:
            first = i
            static = self.at(i + 1) == "static"
            name, i = self.qualified(i + 1 + static)
            package, _, obj = name.rpartition(".")
            self.imports.append({"ordinal": len(self.imports), "package": package, "object": obj, "is_static": static, "location": self.place(first, i)})
            i += self.at(i) == ";"
        start = self._before_modifiers(i, found, words)
        self.members(start, len(self.tokens), "", None)
        return self

    def _before_modifiers(self, i: int, found: list[dict], words: set[str]) -> int:
        """Where the modifiers in front of i begin, so that they are read again as part of their declaration."""
        if not found and not words:
            return i
        j = 0
        if self.at(0) == "package" or self.package:
            while self.at(j) != ";":
                j += 1
            j += 1
        return j

    def members(self, i: int, end: int, owner: str, kind: str | None) -> None:
        while i < end:
            if self.at(i) in (";", ","):
                i += 1
                continue
            first = i
            found, words, i = self.modifiers(i)
            x = self.at(i)
            if x == "@" and self.at(i + 1) == "interface":
                i = self.type_declaration(i + 1, first, found, words, end)
            elif x in ("class", "interface", "enum") or (x == "record" and self.is_word(i + 1) and self.at(i + 2) in ("(", "<")):
                i = self.type_declaration(i, first, found, words, end)
            elif x == "{":
                self.body(i + 1, self.pair[i], owner, "<init>", {})
                i = self.pair[i] + 1
            elif owner and self.is_word(i) or x == "<":
                i = self.member(i, first, found, words, owner, kind, end)
            else:
                i += 1

    def type_declaration(self, i: int, first: int, found: list[dict], words: set[str], end: int) -> int:
        kind = {"class": "CLASS", "interface": "INTERFACE", "enum": "ENUM", "record": "RECORD"}.get(self.at(i), "CLASS")
        name = self.at(i + 1)
        if not self.is_word(i + 1):
            return i + 1
        i += 2
        i = self.generic(i) if self.at(i) == "<" else i
        own: dict = {"name": name, "class_type": kind, "words": words, "annotations": found, "extended": [], "implemented": [], "constants": [], "location": None}
        self.types.append(own)
        self.note(found, "class", name)
        if kind == "RECORD" and self.at(i) == "(":
            for a, b in self.split(i + 1, self.pair[i]):
                p = self.parameter(a, b)
                if p:
                    self.field(p["name"], p["parameter_type"], {"private", "final"}, None, a, b, name)
            i = self.pair[i] + 1
        while i < end and self.at(i) != "{":
            if self.at(i) in ("extends", "implements", "permits"):
                target = {"extends": own["extended"], "implements": own["implemented"]}.get(self.at(i), [])
                i += 1
                while True:
                    j = self.type_at(i)
                    if j == i:
                        break
                    target.append(re.sub(r"<.*", "", self.text(self.skip_annotations(i), j)).strip().rsplit(".", 1)[-1])
                    i = j
                    if self.at(i) != ",":
                        break
                    i += 1
            else:
                i += 1
        if i >= end:
            return end
        close, i = self.pair[i], i + 1
        own["location"] = self.place(first, close + 1)
        if kind == "ENUM":
            i = self.constants(i, close, own, name)
        self.members(i, close, name, kind)
        return close + 1

    def constants(self, i: int, close: int, own: dict, name: str) -> int:
        while i < close and self.at(i) != ";":
            i = self.skip_annotations(i)
            if self.is_word(i):
                own["constants"].append(self.at(i))
                i += 1
                if self.at(i) == "(":
                    self.body(i + 1, self.pair[i], name, "<init>", {})
                    i = self.pair[i] + 1
                if self.at(i) == "{":
                    self.members(i + 1, self.pair[i], name, "CLASS")
                    i = self.pair[i] + 1
            else:
                i += 1
        return i

    def parameter(self, a: int, b: int) -> dict | None:
        found, _, a = self.modifiers(a)
        j = self.type_at(a)
        if j == a:
            return None
        kind, extra, _ = self.text(a, j), [], None
        if self.at(j) == "@":
            extra, _, j = self.modifiers(j)
        varargs = self.at(j) == "..."
        j += varargs
        if not self.is_word(j) or j >= b:
            return None
        kind += self.text(j + 1, b).replace(" ", "") if self.at(j + 1) == "[" else ""
        return {"name": self.at(j), "parameter_type": kind, "is_varargs": varargs, "annotations": found + extra}

    def field(self, name: str, kind: str, words: set[str], init: str | None, a: int, b: int, owner: str, interface: bool = False) -> None:
        self.fields.append({"ordinal": len(self.fields), "name": name, "field_type": kind, "protection": protection(words), "is_static": interface or "static" in words, "is_final": interface or "final" in words, "initializer": init, "location": self.place(a, b), "owner": owner})

    def member(self, i: int, first: int, found: list[dict], words: set[str], owner: str, kind: str | None, end: int) -> int:
        if self.at(i) == "<":
            i = self.generic(i)
        t = i
        i = self.type_at(i)
        if i == t:
            return i + 1
        if self.at(i) == "(":  # a constructor: its calls count, itself it is no method
            self.note(found, "constructor", owner)
            scope = {p["name"]: p["parameter_type"] for a, b in self.split(i + 1, self.pair[i]) if (p := self.parameter(a, b))}
            i = self.pair[i] + 1
            while i < end and self.at(i) not in ("{", ";"):
                i += 1
            if self.at(i) == "{":
                self.body(i + 1, self.pair[i], owner, self.text(t, t + 1), scope)
                return self.pair[i] + 1
            return i + 1
        if self.at(i) == "{" and self.text(t, i) == owner:  # a compact record constructor
            self.body(i + 1, self.pair[i], owner, owner, {})
            return self.pair[i] + 1
        if not self.is_word(i):
            return i + 1
        returns, name = self.text(t, i), self.at(i)
        if self.at(i + 1) == "(":
            return self.method(i, first, found, words, returns, name, owner, kind, end)
        self.note(found, "field", f"{owner}&{name}")
        while i < end:
            name, a = self.at(i), i
            i += 1
            suffix = ""
            while self.at(i) == "[":
                suffix, i = suffix + "[]", self.pair[i] + 1
            init = None
            if self.at(i) == "=":
                s = i + 1
                i = next((b for _, b in self.split_until(s, end)), end)
                init = self.text(s, i)
                self.body(s, i, owner, "", {})
            self.field(name, returns + suffix, words, init, a, max(i, a + 1), owner, kind == "INTERFACE")
            if self.at(i) != ",":
                break
            i += 1
        return i + 1

    def split_until(self, a: int, end: int):
        """The range up to the next , or ; at the top level."""
        i = a
        while i < end:
            if i in self.pair:
                i = self.pair[i]
            elif self.at(i) == "<" and self.is_word(i - 1):
                j = self.generic(i)
                if self.at(j - 1) in (">", ">>"):
                    i = j - 1
            elif self.at(i) in (",", ";"):
                break
            i += 1
        yield a, i

    def method(self, i: int, first: int, found: list[dict], words: set[str], returns: str, name: str, owner: str, kind: str | None, end: int) -> int:
        close = self.pair[i + 1]
        parameters = [p for a, b in self.split(i + 2, close) if (p := self.parameter(a, b))]
        self.note(found, "method", f"{owner}&{name}")
        for p in parameters:
            self.note(p["annotations"], "parameter", f"{owner}&{name}&{p['name']}")
        i = close + 1
        thrown: list[str] = []
        while i < end and self.at(i) not in ("{", ";"):
            if self.at(i) == "throws":
                j = i + 1
                while j < end and self.at(j) not in ("{", ";"):
                    j += 1
                thrown = [self.text(a, b) for a, b in self.split(i + 1, j)]
                i = j
            else:
                i += 1
        has_body = self.at(i) == "{"
        stop = self.pair[i] + 1 if has_body else min(i + 1, len(self.tokens))
        self.methods.append({
            "ordinal": len(self.methods), "name": name, "return_type": returns, "protection": protection(words), "is_static": "static" in words, "is_final": "final" in words,
            "is_abstract": "abstract" in words, "thrown": thrown, "parameters": parameters, "annotations": found, "location": self.place(first, stop), "owner": owner,
        })
        if has_body:
            self.body(i + 1, stop - 1, owner, name, {p["name"]: p["parameter_type"] for p in parameters})
        return stop

    # -- bodies

    def body(self, a: int, b: int, owner: str, method: str, scope: dict[str, str]) -> None:
        """Calls in the tokens a..b-1, innermost scope last; local variables are known from their declaration on."""
        scope = dict(scope)
        found: list[tuple[int, dict]] = []
        i = a
        while i < b:
            x = self.at(i)
            if x in ("class", "interface", "enum", "record") and self.is_word(i + 1) and self.at(i - 1) != "." and self.at(i + 2) in ("{", "extends", "implements", "(", "<"):
                i = self.type_declaration(i, i, [], set(), b)
                continue
            if x == "new":
                j = self.type_at(i + 1)
                if self.at(j) == "(" and self.at(self.pair[j] + 1) == "{":
                    inner = self.pair[j] + 1
                    self.body(j + 1, self.pair[j], owner, method, scope)
                    self.members(inner + 1, self.pair[inner], self.text(i + 1, j), "CLASS")
                    i = self.pair[inner] + 1
                    continue
                i = max(j, i + 1)
                continue
            if self.is_word(i) and x not in KEYWORDS and self.at(i - 1) not in (".", "::", "new"):
                j = self.type_at(i)
                if j > i and self.is_word(j) and self.at(j) not in KEYWORDS and self.at(j + 1) in ("=", ";", ":", ",", ")") and x not in ("return", "throw"):
                    kind = self.text(i, j)
                    if kind == "var" and self.at(j + 1) == "=" and self.at(j + 2) == "new":
                        kind = self.text(j + 3, self.type_at(j + 3))
                    elif kind == "var" and self.at(j + 2) == REST_OWNER and self.at(j + 3) == "." and self.at(j + 4) in ("create", "builder"):
                        kind = REST_OWNER
                    scope[self.at(j)] = kind
            if self.is_word(i) and self.at(i + 1) == "(" and x not in KEYWORDS:
                found.append((i, dict(scope)))
            i += 1
        for i, known in found:
            self.call(i, owner, method, known, a)

    def receiver(self, i: int, low: int) -> int:
        """Where the expression before the dot at i - 1 begins."""
        back = {v: k for k, v in self.pair.items()}
        j = i - 1
        while j > low and self.at(j) == ".":
            j -= 1
            while j >= low and self.at(j) in (")", "]"):
                j = back[j] - 1
            if self.at(j) in (">",):  # explicit type arguments
                while j > low and self.at(j) != "<":
                    j -= 1
                j -= 1
            if not (self.is_word(j) or self.tokens[j].kind == "text"):
                j += 1
                break
            if self.at(j - 1) == "new":
                j -= 1
            j -= 1
        else:
            j += 1
        return max(j, low)

    def call(self, i: int, owner: str, method: str, scope: dict[str, str], low: int) -> None:
        close = self.pair[i + 1]
        arguments = list(self.split(i + 2, close))
        name, object_name, object_type = self.at(i), "", ""
        if self.at(i - 1) == ".":
            r = self.receiver(i, low)
            object_type = self.type_of(r, i - 1, scope)
            if r == i - 2 and self.is_word(r) and self.at(r) not in ("this", "super"):
                object_name = self.at(r)
        chosen = arguments[0] if arguments else None
        if object_type == REST_OWNER:
            chosen = None
            if self.at(close + 1) == "." and self.is_word(close + 2) and self.at(close + 3) == "(":
                chosen = next(iter(self.split(close + 4, self.pair[close + 3])), None)
        url = self.url(*chosen) if chosen else ""
        self.calls.append({
            "ordinal": len(self.calls), "name": name, "object_name": object_name, "object_type": object_type, "called_from": method,
            "arguments": ",".join(self.text(a, b) for a, b in arguments), "url_argument": url, "location": self.place(i, close + 1), "owner": owner,
        })

    def type_of(self, a: int, b: int, scope: dict[str, str]) -> str:
        """Simple type name of the receiver a..b-1, '' if it isn't known. An unknown name with a capital is a type, as in static calls."""
        if self.at(a) == "new":
            return simple(self.text(a + 1, self.type_at(a + 1)))
        i, current = a, None
        if self.at(i) == "this" and self.at(i + 1) == ".":
            i += 2
            scope = {}
        if self.is_word(i) and self.at(i + 1) != "(":
            name = self.at(i)
            kind = scope.get(name) or next((f["field_type"] for f in self.fields if f["name"] == name), None) or self._field_ahead(name)
            current = simple(kind) if kind else (name if name[:1].isupper() else "")
            i += 1
        elif self.tokens[i].kind == "text":
            current, i = "String", i + 1
        elif self.is_word(i) and self.at(i + 1) == "(":
            returns = next((m["return_type"] for m in self.methods if m["name"] == self.at(i)), None)
            current, i = simple(returns) if returns else "", self.pair[i + 1] + 1
        elif self.at(i) == "(":
            inner = self.type_at(i + 1)
            current, i = (simple(self.text(i + 1, inner)) if inner == self.pair[i] and self.at(i + 1)[:1].isupper() else ""), self.pair[i] + 1
        if i >= b or current is None:
            return current or ""
        static = current if current == REST_OWNER or current == "RestTemplate" else ""
        if static and self.at(i) == "." and self.at(i + 1) in ("create", "builder"):
            return REST_OWNER if static == REST_OWNER and b - i <= self.pair.get(i + 2, b) + 1 - i else ""
        return ""

    def _field_ahead(self, name: str) -> str | None:
        """The type of a field that is declared further down: a declaration ``Type name =|;`` after a modifier or at a line's start."""
        for i, t in enumerate(self.tokens):
            if t.text == name and self.at(i + 1) in ("=", ";", ",") and i and (self.is_word(i - 1) or self.at(i - 1) in (">", "]")):
                j = i - 1
                while j > 0 and self.at(j - 1) not in (";", "{", "}", ")") and self.at(j - 1) not in MODIFIERS:
                    j -= 1
                if (self.at(j - 1) in MODIFIERS or self.at(j - 1) in (";", "{", "}", ")")) and self.type_at(j) == i:
                    return self.text(j, i)
        return None

    # -- addresses

    def url(self, a: int, b: int) -> str:
        return clean_url(self.fold(a, b))

    def fold(self, a: int, b: int) -> str:
        """The address that an expression makes: literals and concatenation folded, names and calls as placeholders."""
        if a >= b:
            return ""
        if self.at(a) == "(" and self.pair[a] == b - 1:
            return self.fold(a + 1, b - 1)
        inner = a + 2 if (self.at(a), self.at(a + 1)) == ("new", "String") else a + 3 if (self.at(a), self.at(a + 1), self.at(a + 2)) == ("String", ".", "valueOf") else -1
        if inner > 0 and self.pair.get(inner) == b - 1:
            return self.fold(inner + 1, b - 1)
        summands = list(self.split(a, b, "+"))
        if len(summands) > 1:
            return "".join(self.fold(x, y) for x, y in summands)
        if b == a + 1:
            t = self.tokens[a]
            if t.kind == "text":
                return unescape(t.text)
            if t.kind == "word":
                return "" if "uri" in t.text or "url" in t.text else "{?}"
        if self.is_word(b - 1) and self.at(b - 2) == "." and self.at(a) != "new" and all(self.is_word(k) or self.at(k) == "." for k in range(a, b)):
            init = next((f["initializer"] for f in self.fields if f["name"] == self.at(b - 1)), None)
            return re.sub(r'^"(.*)"$', r"\1", init, flags=re.S) if init else ""
        found = literal_url(self.text(a, b))
        is_call = self.at(b - 1) == ")" and self.at(a) != "new"
        return found or ("{?}" if is_call else "")


def clean_url(url: str) -> str:
    url = url.replace("http://", "").replace("https://", "")
    at = url.find("/")
    url = url[at:] if at > 0 else url
    url = url.removesuffix('"')
    return url.removesuffix("/")


def literal_url(text: str) -> str:
    found = re.search(r'".*(/.+?)"', text)
    return clean_url(re.sub("%[sdif]", "{?}", found[0].replace('"', ""))) if found else ""


def simple(kind: str) -> str:
    return re.sub(r"<.*|\[.*", "", kind, flags=re.S).strip().rsplit(".", 1)[-1]


def protection(words: set[str]) -> str:
    return next((w.upper() for w in ("public", "protected", "private") if w in words), "PACKAGE_PRIVATE")


def parse_java(source: str) -> dict:
    """One row of ``schema.CLASS``: header of the file's main type (classes and interfaces before enums before records), and all components."""
    empty: dict = {"package": None, "name": None, "class_type": None, "parse_error": None}
    try:
        p = Parser(source).parse()
    except (ParseError, RecursionError, IndexError, KeyError) as e:
        return empty | {"parse_error": f"{type(e).__name__}: {e}"}
    order = {"CLASS": 0, "INTERFACE": 0, "ENUM": 1, "RECORD": 2}
    main = min(p.types, key=lambda t: order[t["class_type"]], default=None)
    if main is None:
        return empty | {"package": p.package, "parse_error": "no type declared"}
    top = f"{p.package}.{main['name']}" if p.package else main["name"]
    bare = [{"name": a["name"], "attributes": a["attributes"]} for a in main["annotations"]]
    methods = []
    for m in p.methods:
        methods.append(m | {
            "component_id": f"{top}&{m['name']}", "parent_component_id": top, "annotations": [{"name": a["name"], "attributes": a["attributes"]} for a in m["annotations"]],
            "parameters": [q | {"ordinal": i, "annotations": [{"name": a["name"], "attributes": a["attributes"]} for a in q["annotations"]]} for i, q in enumerate(m["parameters"])],
        })
    return {
        "package": p.package, "name": main["name"], "class_type": main["class_type"], "protection": protection(main["words"]),
        "is_static": "static" in main["words"] or main["class_type"] == "ENUM", "is_final": "final" in main["words"] or main["class_type"] in ("ENUM", "RECORD"), "is_abstract": "abstract" in main["words"],
        "extended_types": main["extended"] if main["class_type"] == "INTERFACE" else main["extended"][:1], "implemented_types": main["implemented"], "enum_constants": main["constants"],
        "class_annotations": bare, "annotations": p.annotations, "imports": p.imports, "methods": methods,
        "fields": [f | {"component_id": f"{top}&{f['name']}"} for f in p.fields],
        "calls": [c | {"component_id": f"{top}&{c['called_from']}&{c['name']}" if c["called_from"] else f"{top}&{c['name']}", "parent_component_id": f"{top}&{c['called_from']}" if c["called_from"] else top} for c in p.calls],
        "parse_error": None,
    }

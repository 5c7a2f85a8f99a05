"""Symbols of a TypeScript or JavaScript file, by a tokenizer and bracket matching.

There is no compiler here, so structure is read from tokens: strings, templates, regular
expressions and comments are told apart, brackets are matched, and declarations are found
by their keywords.  Known limits: type arguments that hold arrow types with braces, and
regular expressions after a closing bracket, may be misread; JSX text is read as code.
"""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass

_SPACE = re.compile(r"[\s﻿]+|//[^\n]*|/\*.*?\*/", re.S)
_NAME = re.compile(r"[A-Za-z_$#\u0080-￿][\w$\u0080-￿]*")
_NUMBER = re.compile(r"\d[\w.]*")
_STRING = re.compile(r"'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?", re.S)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_SIGN = re.compile(r"=>|\.\.\.|\?\.|[=!]==?|[<>]=|&&|\|\||\?\?|.", re.S)
_BEFORE_REGEX = set("(,=:[!&|?{};+-*%<>~^") | {"=>", "&&", "||", "??", "==", "===", "!=", "!==", "return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw", "new", "await", "yield"}
# Words that are followed by a bracket without being called.
_WORDS = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "import", "super", "await", "new", "constructor", "do", "else", "void", "delete", "throw", "in", "of", "instanceof", "yield", "async", "get", "set"}
_MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "override", "declare", "async", "get", "set", "accessor", "export", "default"}


@dataclass
class Token:
    kind: str  # name, number, string, template, regex or sign
    text: str
    start: int
    end: int


def _template_end(text: str, at: int) -> int:
    """Position after a template literal that begins at ``at``; nested expressions may hold templates."""
    at += 1
    while at < len(text):
        if text[at] == "\\":
            at += 2
        elif text[at] == "`":
            return at + 1
        elif text.startswith("${", at):
            depth, at = 1, at + 2
            while at < len(text) and depth:
                if text[at] == "`":
                    at = _template_end(text, at)
                    continue
                if text[at] in "'\"":
                    at = _STRING.match(text, at).end()
                    continue
                depth += (text[at] == "{") - (text[at] == "}")
                at += 1
        else:
            at += 1
    return len(text)


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    at = 0
    while at < len(text):
        if m := _SPACE.match(text, at):
            at = m.end()
            continue
        if text[at] == "`":
            end = _template_end(text, at)
            out.append(Token("template", text[at:end], at, end))
        elif m := _STRING.match(text, at):
            out.append(Token("string", m[0], at, m.end()))
        elif m := _NAME.match(text, at):
            out.append(Token("name", m[0], at, m.end()))
        elif m := _NUMBER.match(text, at):
            out.append(Token("number", m[0], at, m.end()))
        elif text[at] == "/" and (not out or out[-1].text in _BEFORE_REGEX) and (m := _REGEX.match(text, at)):
            out.append(Token("regex", m[0], at, m.end()))
        else:
            m = _SIGN.match(text, at)
            out.append(Token("sign", m[0], at, m.end()))
        at = out[-1].end
    return out


def _matches(found: list[Token]) -> dict[int, int]:
    """Index of the closing bracket for each opening one; an unclosed one ends with the file."""
    pairs, open_ = {}, []
    closes = {")": "(", "]": "[", "}": "{"}
    for i, t in enumerate(found):
        if t.kind == "sign" and t.text in "([{":
            open_.append(i)
        elif t.kind == "sign" and t.text in closes:
            while open_ and found[open_[-1]].text != closes[t.text]:
                pairs[open_.pop()] = i
            if open_:
                pairs[open_.pop()] = i
    return pairs | {i: len(found) - 1 for i in open_}


class _File:
    def __init__(self, text: str, path: str) -> None:
        self.text, self.path = text, path
        self.t = tokens(text)
        self.close = _matches(self.t)
        self.lines = text.split("\n")
        self.breaks = [i for i, c in enumerate(text) if c == "\n"]
        self.out: list[dict] = []

    def line(self, at: int) -> int:
        import bisect

        return bisect.bisect_left(self.breaks, at) + 1

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.t) and self.t[i].text in texts and self.t[i].kind in ("name", "sign")

    def skip(self, i: int) -> int:
        """Index after token i, or after its bracket."""
        return self.close[i] + 1 if i in self.close else i + 1

    def statement_end(self, i: int, stop: int) -> int:
        """Index after a statement: at a semicolon, or where a line ends and the next can't go on."""
        while i < stop:
            if self.is_(i, ";"):
                return i + 1
            if self.is_(i, "}"):
                return i
            after = self.skip(i)
            if after < stop and self.text.count("\n", self.t[after - 1].end, self.t[after].start):
                here, following = self.t[after - 1], self.t[after]
                ends = here.kind != "sign" or here.text in ")]}"
                goes_on = following.kind == "sign" and following.text not in "{[(@#" or following.text in ("in", "of", "instanceof", "as", "satisfies")
                if ends and not goes_on and not self.is_(after - 1, "=>", "="):
                    return after
            i = after
        return stop

    def skip_types(self, i: int) -> int:
        """Index after type arguments that begin at i."""
        if not self.is_(i, "<"):
            return i
        depth = 0
        while i < len(self.t):
            if self.is_(i, "<"):
                depth += 1
            elif self.is_(i, ">"):
                depth -= 1
                if not depth:
                    return i + 1
            elif self.is_(i, "("):
                i = self.close[i]
            i += 1
        return i

    def body(self, i: int, stop: int) -> int | None:
        """Index of the brace that opens a function's body, from its parameters on."""
        while i < stop and not self.is_(i, "("):
            i += 1
        i = self.skip(i) if i < stop else stop
        in_type = self.is_(i, ":")
        while i < stop and not self.is_(i, ";"):
            if self.is_(i, "{"):
                if not in_type or not self.is_(i - 1, ":", "|", "&", "<", ",", "=>"):
                    return i
            i = self.skip(i) if not self.is_(i, "<") else self.skip_types(i)
        return None

    def called(self, start: int, end: int) -> list[str]:
        names = []
        for i in range(start, end):
            t = self.t[i]
            if t.kind == "name" and t.text not in _WORDS and not self.is_(i - 1, ".", "?.", "function"):
                after = self.skip_types(i + 1) if self.is_(i + 1, "<") else i + 1
                if self.is_(after, "(") and not (self.is_(self.close[after] + 1, "{") and not self.is_(i - 1, "new", "(", "=", "return", "await", ",")) or self.is_(i - 1, "new"):
                    names.append(t.text)
        return list(dict.fromkeys(names))

    def add(self, name: str, kind: str, start: int, end: int, code: str | None = None, calls: bool = True, last_line: int | None = None) -> None:
        first, last = self.line(self.t[start].start), last_line or self.line(self.t[end - 1].end - 1)
        text = "\n".join(self.lines[first - 1 : last]) if code is None else code
        self.out.append({"name": name, "kind": kind, "start": first, "end": last, "code": text, "called": self.called(start, end) if calls else []})

    def function_value(self, i: int) -> bool:
        """Whether an arrow function or a function expression begins at i."""
        if self.is_(i, "async"):
            i += 1
        if self.is_(i, "function"):
            return True
        i = self.skip_types(i)
        if self.is_(i, "("):
            i = self.skip(i)
            if self.is_(i, ":"):
                while i < len(self.t) and not self.is_(i, "=>", ";", ","):
                    i = self.skip_types(i) if self.is_(i, "<") else self.skip(i)
            return self.is_(i, "=>")
        return i < len(self.t) and self.t[i].kind == "name" and self.is_(i + 1, "=>")

    def declarations(self, i: int, end: int) -> list[tuple[int, int | None]]:
        """(name, initialiser) of each declaration of a const, let or var statement."""
        found, at = [], i + 1
        while at < end:
            name, value = at, None
            at = self.skip(at)
            while at < end and not self.is_(at, ",", ";"):
                if self.is_(at, "=") and value is None:
                    value = at + 1
                at = self.skip_types(at) if self.is_(at, "<") and value is None else self.skip(at)
            found.append((name, value))
            at += 1
        return found

    def class_members(self, name: str, start: int, keyword: int, brace: int) -> None:
        end, i = self.close[brace], brace + 1
        fields, methods = [], []
        while i < end:
            if self.is_(i, ";", ","):
                i += 1
                continue
            first = i
            while self.is_(i, "@"):
                i += 2
                while self.is_(i, "."):
                    i += 2
                i = self.skip(i) if self.is_(i, "(") else i
            while self.t[i].text in _MODIFIERS and not self.is_(i + 1, "(", "=", ":", ";", "?", "}", "<"):
                i += 1
            if self.is_(i, "*"):
                i += 1
            label = self.text[self.t[i].start : self.t[self.close.get(i, i)].end]
            after = self.skip(i)
            while self.is_(after, "?", "!"):
                after += 1
            opens = self.skip_types(after)
            if self.is_(i, "static") or self.is_(i, "{"):
                i = self.skip(after if self.is_(after, "{") else i)
            elif self.is_(opens, "("):
                brace_at = self.body(opens, end)
                stop = self.skip(brace_at) if brace_at is not None else self.statement_end(opens, end)
                methods.append((label, first, stop))
                i = stop
            else:
                stop = self.statement_end(i, end)
                value = next((k for k in range(after, stop) if self.is_(k, "=")), None)
                (methods if value is not None and self.function_value(value + 1) else fields).append((label, first, stop))
                i = max(stop, i + 1)
        head = re.sub(r"\s+", " ", self.text[self.t[start].start : self.t[brace].end])
        shown = [f"  {self.text[self.t[a].start : self.t[b - 1].end]}" for _, a, b in fields]
        last = max([self.line(self.t[start].start), *(self.line(self.t[b - 1].end - 1) for _, _, b in fields)])
        self.add(name, "class", start, brace + 1, "\n".join([head, *shown, "}"]), False, last)
        for label, a, b in methods:
            self.add(f"{name}.{label}", "method", a, b)

    def visit(self) -> None:
        for i, t in enumerate(self.t):
            if t.kind != "name" or self.is_(i - 1, ".", "?."):
                continue
            start = i
            while self.t[start - 1].text in ("export", "default", "async", "abstract", "declare") and start:
                start -= 1
            named = i + 1 < len(self.t) and self.t[i + 1].kind == "name"
            if t.text == "function":
                at = i + 2 if self.is_(i + 1, "*") else i + 1
                opens = start == 0 or self.is_(start - 1, "{", "}", ";", ")") or bool(self.text.count("\n", self.t[start - 1].end, self.t[start].start)) and not self.is_(start - 1, "=", "(", ",", "=>", ":", "return")
                if at < len(self.t) and self.t[at].kind == "name" and opens:
                    brace = self.body(at, len(self.t))
                    self.add(self.t[at].text, "function", start, self.skip(brace) if brace is not None else self.statement_end(at, len(self.t)))
            elif t.text == "class" and named and not self.is_(start - 1, "=", "(", ",", "return", ":"):
                brace = i + 2
                while brace < len(self.t) and not self.is_(brace, "{"):
                    brace = self.skip_types(brace) if self.is_(brace, "<") else self.skip(brace)
                if brace < len(self.t):
                    self.class_members(self.t[i + 1].text, start, i, brace)
            elif t.text == "interface" and named:
                brace = next((k for k in range(i + 2, len(self.t)) if self.is_(k, "{")), None)
                if brace is not None:
                    self.add(self.t[i + 1].text, "interface", start, self.skip(brace))
            elif t.text in ("const", "let", "var") and i + 1 < len(self.t) and not self.is_(i - 1, "("):
                end = self.statement_end(i, len(self.t))
                for name, value in self.declarations(i, end):
                    if self.t[name].kind == "name" and value is not None and self.function_value(value):
                        self.add(self.t[name].text, "const-function", start, end)

    def top_level(self):
        """Statements of the file: index of the first token and after the last."""
        i = 0
        while i < len(self.t):
            words = [self.t[k].text for k in range(i, min(i + 5, len(self.t)))]
            while words and words[0] in ("export", "default", "async", "abstract", "declare"):
                words = words[1:]
            end = self.statement_end(i, len(self.t))
            if words and words[0] in ("function", "class", "interface", "enum", "namespace", "module") or words[:2] == ["const", "enum"]:
                brace = next((k for k in range(i, len(self.t)) if self.is_(k, "{")), None)
                if words[0] == "function":
                    brace = self.body(i, len(self.t))
                end = self.skip(brace) if brace is not None else end
            yield i, max(end, i + 1), words
            i = max(end, i + 1)


def resolved_alias(spec: str, aliases: list[tuple[str, str]]) -> str | None:
    """Where an import points by the first alias pattern (exact, or with one star) that fits."""
    for pattern, target in aliases:
        if "*" not in pattern:
            if spec == pattern:
                return target
        else:
            head, tail = pattern.split("*", 1)
            if spec.startswith(head) and spec.endswith(tail) and len(spec) >= len(head) + len(tail):
                return target.replace("*", spec[len(head) : len(spec) - len(tail)], 1)
    return None


def symbols(content: str, file_path: str, aliases: list[tuple[str, str]] = ()) -> list[dict]:
    """Functions, classes with their members, interfaces, constant functions, the module header, or the whole file."""
    if not content.strip():
        return []
    f = _File(content, file_path)
    f.visit()
    header, imports = [], {}
    for start, end, words in f.top_level():
        text = content[f.t[start].start : f.t[end - 1].end]
        if f.is_(start, "import") and not f.is_(start + 1, "("):
            header.append(text)
            spec = next((f.t[k].text.strip("'\"") for k in range(end - 1, start, -1) if f.t[k].kind == "string"), None)
            if spec is None:
                continue
            path = posixpath.normpath(posixpath.join(posixpath.dirname(file_path), spec)) if spec.startswith(".") else resolved_alias(spec, list(aliases))
            if path is None:
                continue
            path = re.sub(r"\.(ts|tsx|js|jsx)$", "", path)
            at = start + 2 if f.is_(start + 1, "type") and not f.is_(start + 2, "from", ",") else start + 1
            if f.t[at].kind == "name" and f.t[at].text != "from":
                imports[f.t[at].text] = (path, f.t[at].text)
            if (brace := next((k for k in range(at, end) if f.is_(k, "{")), None)) is not None:
                for part in re.split(r",", content[f.t[brace].end : f.t[f.close[brace]].start]):
                    names = re.findall(r"[\w$]+", re.sub(r"^\s*type\s+(?=[\w$])", "", part))
                    if names:
                        imports[names[-1]] = (path, names[0])
        elif f.is_(start, "export") and f.is_(start + 1, "{", "*") or f.is_(start, "export") and f.is_(start + 1, "type") and f.is_(start + 2, "{"):
            header.append(text)
        elif words and words[0] in ("const", "let", "var") and words[1:2] != ["enum"]:
            at = next(k for k in range(start, end) if f.t[k].text in ("const", "let", "var"))
            if not any(v is not None and f.function_value(v) for _, v in f.declarations(at, end)):
                header.append(text)
        elif words and (words[0] in ("type", "enum") and f.t[min(start + 1, end - 1)].kind == "name" or words[:2] == ["const", "enum"]):
            header.append(text)
    ids = {s["name"]: f"{file_path}::{s['name']}" for s in f.out}
    out = []
    for s in f.out:
        own = f"{file_path}::{s['name']}"
        refs = [ids[c] for c in s["called"] if c in ids and ids[c] != own]
        outside = [imports[c] for c in s["called"] if c not in ids and c in imports]
        out.append({k: s[k] for k in ("name", "kind", "start", "end", "code")} | {"refs": refs, "ext_refs": [f"{p}::{n}" for p, n in outside]})
    if header:
        out.append({"name": "__module__", "kind": "module", "start": 1, "end": len(f.lines), "code": "\n".join(header), "refs": [], "ext_refs": []})
    if not out:
        out.append({"name": "__file__", "kind": "file", "start": 1, "end": len(f.lines), "code": content, "refs": [], "ext_refs": []})
    return out

"""Structure and metrics of one Java source: a tokenizer and a declaration scanner, run in Arrow batches.

The scanner reads declarations exactly and bodies only as far as the metrics need: calls, accessed fields,
branches and nesting. What it can't read raises ScanError, and the caller falls back to regular expressions.
"""

from __future__ import annotations

import gc
import re
import signal
import threading
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from itertools import accumulate, compress

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.schemas import CONSTRAINTS, PARSED_FIELDS, STEREOTYPES, UNCOUPLED

from . import regex_extract

#: A token or comment.
_TOKEN = re.compile(r'''
 (?P<comment>//[^\n]*|/\*.*?\*/)
|(?P<string>"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])+')
|(?P<number>\.?\d(?:[\w.]|(?<=[eEpP])[+-])*)
|(?P<word>[^\W\d][\w$]*|\$[\w$]*)
|(?P<mark>->|::|&&|\|\||\.\.\.|[-+*/%&|^=!<>]=|\+\+|--|[@(){}\[\];,.<>=!~?:+\-*/&|^%])
''', re.X | re.S)  # fmt: skip
#: Space, the commonest tokens, any token or comment, or all that is left where none begins; a source's pieces make up all of it.
_PIECE = re.compile(r"[ \t\r\n\f]++|[A-Za-z_][A-Za-z0-9_$]*+(?![^\x00-\x7f])|[@(){}\[\];,]|" + re.sub(r"\?P<\w+>", "?:", _TOKEN.pattern) + r"|.++", re.X | re.S)
MODIFIERS = set("abstract default final native private protected public sealed static strictfp synchronized transient volatile".split())
_NOT_CALLED = {"if", "for", "while", "switch", "catch", "synchronized", "return", "throw", "new", "this", "super", "assert", "try", "do", "else", "case", "yield", "instanceof"}
_BEFORE_CALL = _NOT_CALLED | {"else", "do", "in"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


class ScanError(ValueError):
    pass


class _Kinds(dict):
    """Kind of a piece: empty for space and comments, None for what is no token. Those of short pieces are kept."""

    def __missing__(self, piece: str) -> str | None:
        m = _TOKEN.match(piece)
        kind = ("" if m.lastgroup == "comment" else m.lastgroup) if m else None if piece.strip(" \t\r\n\f") else ""
        if len(piece) <= 64:
            if len(self) >= 20_000:
                self.clear()
            self[piece] = kind
        return kind


_KINDS = _Kinds()


class Java:
    def __init__(self, source: str):
        self.source = source
        pieces = _PIECE.findall(source)
        kinds = list(map(_KINDS.__getitem__, pieces))
        if kinds and kinds[-1] is None:
            raise ScanError(f"unreadable at {len(source) - len(pieces[-1])}")
        self.t, self.kind = list(compress(pieces, kinds)), list(filter(None, kinds))
        self.at = list(compress(accumulate(map(len, pieces), initial=0), kinds))
        self.ends = [m.start() for m in re.finditer("\n", source)]
        self.mate: dict[int, int] = {}
        stack: list[int] = []
        for k, x in enumerate(self.t):
            if x in _OPEN:
                stack.append(k)
            elif x in _CLOSE:
                if not stack or self.t[stack[-1]] != _CLOSE[x]:
                    raise ScanError(f"unbalanced {x}")
                self.mate[stack[-1]] = k
                self.mate[k] = stack.pop()
        if stack:
            raise ScanError("unclosed bracket")

    def peek(self, k: int) -> str:
        return self.t[k] if 0 <= k < len(self.t) else ""

    def line(self, k: int) -> int:
        return bisect_left(self.ends, self.at[k]) + 1

    def last_line(self, k: int) -> int:
        return self.line(k) + self.t[k].count("\n")

    def text(self, a: int, b: int) -> str:
        """Source of tokens a to b (exclusive) on one line."""
        if a >= b:
            return ""
        raw = self.source[self.at[a] : self.at[b - 1] + len(self.t[b - 1])]
        if "//" in raw or "/*" in raw:
            raw = " ".join(self.t[a:b])
        return re.sub(r"\s*\n\s*(?=[.)])|(?<=[(])\s*\n\s*", "", raw).replace("\n", " ") if "\n" in raw else raw

    def name(self, k: int) -> tuple[str, int]:
        """Dotted name at k and the place after it."""
        if self.kind[k] != "word":
            raise ScanError(f"name expected, not {self.peek(k)}")
        out = self.t[k]
        k += 1
        while self.peek(k) == "." and k + 1 < len(self.t) and self.kind[k + 1] == "word":
            out, k = f"{out}.{self.t[k + 1]}", k + 2
        return out, k

    def angle(self, k: int) -> int:
        """Place after a balanced <...> at k."""
        depth = 0
        while k < len(self.t):
            x = self.t[k]
            depth += (x == "<") - (x == ">")
            if x in ("(", "[", "{"):
                k = self.mate[k]
            elif x in (";", ")", "}"):
                raise ScanError("unclosed type arguments")
            k += 1
            if depth == 0:
                return k
        raise ScanError("unclosed type arguments")

    def type_(self, k: int) -> tuple[str, int]:
        """Type at k, written with ', ' between arguments, and the place after it."""
        _, k = self.annotations(k)
        start, out = k, ""
        out, k = self.name(k)
        while True:
            if self.peek(k) == "<":
                end = self.angle(k)
                inner = "".join(", " if x == "," else f" {x} " if x in ("extends", "super", "&") else x for x in self.t[k:end])
                out, k = out + re.sub(r" +", " ", inner), end
            elif self.peek(k) == "." and self.kind[k + 1] == "word":
                out, k = f"{out}.{self.t[k + 1]}", k + 2
            else:
                break
        while self.peek(k) == "[" and self.peek(k + 1) == "]":
            out, k = out + "[]", k + 2
        if k == start:
            raise ScanError("type expected")
        return out, k

    def annotations(self, k: int) -> tuple[list[tuple[str, list[tuple[str, str]]]], int]:
        """[(name, [(key, raw value)])] at k; a single value has the key '' ."""
        out = []
        while self.peek(k) == "@" and self.peek(k + 1) != "interface":
            name, k = self.name(k + 1)
            pairs = []
            if self.peek(k) == "(":
                end, a = self.mate[k], k + 1
                while a < end:
                    b = self.stop(a, end, {","})
                    key = self.t[a] if self.peek(a + 1) == "=" and self.kind[a] == "word" else ""
                    pairs.append((key, self.text(a + 2 if key else a, b)))
                    a = b + 1
                k = end + 1
            out.append((name, pairs))
        return out, k

    def stop(self, a: int, end: int, marks: set[str]) -> int:
        """First of the marks from a on outside brackets and type arguments, or end."""
        depth = 0
        while a < end:
            x = self.t[a]
            if x in _OPEN and self.kind[a] == "mark":
                a = self.mate[a]
            elif x in marks and depth <= 0 and self.kind[a] == "mark":
                return a
            elif x == "<" and self.generic(a, end):
                a = self.angle(a) - 1
            a += 1
        return end

    def generic(self, k: int, end: int) -> bool:
        """Whether a < opens type arguments rather than compares."""
        if k == 0 or not (self.kind[k - 1] == "word" or self.t[k - 1] == "."):
            return False
        j, depth = k, 0
        while j < end:
            x = self.t[j]
            if x == "<":
                depth += 1
            elif x == ">":
                depth -= 1
                if depth == 0:
                    return True
            elif not (self.kind[j] == "word" or x in (",", ".", "?", "&", "[", "]", "@")):
                return False
            j += 1
        return False

    def prefix(self, k: int):
        """Annotations and modifiers in any order."""
        tags, modifiers = [], []
        while True:
            x = self.peek(k)
            if x == "@" and self.peek(k + 1) != "interface":
                more, k = self.annotations(k)
                tags += more
            elif x == "non" and self.peek(k + 1) == "-" and self.peek(k + 2) == "sealed":
                k += 3
            elif x in MODIFIERS and not (x == "default" and self.peek(k + 1) in (":", "->")):
                if not (x == "sealed" and self.kind[k + 1] != "word"):
                    modifiers.append(x)
                k += 1
            else:
                return tags, modifiers, k


def _strip(raw: str) -> str:
    return raw.removeprefix('"').removesuffix('"')


def _values(tags, name: str, *keys: str) -> list[str]:
    """Raw values under the keys ('' for a single value) of the first annotation of that name."""
    for tag, pairs in tags:
        if tag == name:
            return [v for k, v in pairs if k in keys]
    return []


def _kind_at(j: Java, k: int) -> str | None:
    x = j.peek(k)
    if x == "@" and j.peek(k + 1) == "interface":
        return "annotation_type"
    if x in ("class", "interface", "enum") and k + 1 < len(j.t) and j.kind[k + 1] == "word":
        return x
    if x == "record" and k + 2 < len(j.t) and j.kind[k + 1] == "word" and j.peek(k + 2) in ("(", "<"):
        return "record"
    return None


def _header(j: Java, k: int, kind: str) -> dict:
    k += 2 if kind == "annotation_type" else 1
    out = {"name": j.t[k], "extends": [], "implements": [], "components": []}
    k += 1
    if j.peek(k) == "<":
        k = j.angle(k)
    if kind == "record":
        if j.peek(k) != "(":
            raise ScanError("record components expected")
        out["components"] = [{"name": p["name"], "type": p["type"]} for p in _parameters(j, k)]
        k = j.mate[k] + 1
    while j.peek(k) in ("extends", "implements", "permits"):
        word = j.t[k]
        while True:
            name, k = j.type_(k + 1)
            out.setdefault(word, []).append(re.sub(r"<.*", "", name))
            if j.peek(k) != ",":
                break
    if j.peek(k) != "{":
        raise ScanError("body expected")
    return out | {"open": k, "close": j.mate[k]}


def _binding(tags) -> dict | None:
    for name, kind in (("PathVariable", "path"), ("RequestParam", "query"), ("RequestBody", "body"), ("RequestHeader", "header"), ("ModelAttribute", "model_attribute")):
        own = next((pairs for tag, pairs in tags if tag == name), None)
        if own is None:
            continue
        out = {"default_value": None, "kind": kind, "name": None} | {"required": True}
        for key, raw in own:
            value = _strip(raw)
            if key in ("", "value", "name"):
                out["name"] = value
            elif key == "required":
                out["required"] = value.lower() == "true"
            elif key == "defaultValue":
                out["default_value"] = value
        return out
    return None


def _http(tags) -> dict | None:
    verbs = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": None}
    names = [tag for tag, _ in tags]
    for name, verb in verbs.items():
        if name in names:
            out = {"method": verb, "path": ""}
            for key, raw in next(pairs for tag, pairs in tags if tag == name):
                if key in ("", "value", "path"):
                    out["path"] = _strip(raw)
                elif key == "method":
                    out["method"] = next((v for v in "GET POST PUT DELETE PATCH".split() if v in raw), out["method"])
            return out
    return None


def _parameters(j: Java, k: int) -> list[dict]:
    out, a, end = [], k + 1, j.mate[k]
    while a < end:
        tags, _, a = j.prefix(a)
        declared, a = j.type_(a)
        if j.peek(a) == "...":
            a += 1
        if j.peek(a) == "this":
            a = j.stop(a, end, {","}) + 1
            continue
        name, a = j.name(a)
        while j.peek(a) == "[":
            declared, a = declared + "[]", a + 2
        names = [t for t, _ in tags]
        out.append({"name": name, "type": declared, "validate": "Valid" in names or "Validated" in names, "constraints": [n for n in names if n in CONSTRAINTS], "binding": _binding(tags)})
        if a < end and j.peek(a) != ",":
            raise ScanError("parameter expected")
        a += 1
    return out


class Body:
    """Facts about the tokens of a method body, braces included."""

    def __init__(self, j: Java, a: int, b: int):
        self.j, self.a, self.b, self.score = j, a, b, 0

    def cyclomatic(self) -> int:
        j, n = self.j, 1
        for k in range(self.a, self.b):
            x = j.t[k]
            if j.kind[k] == "word":
                n += x in ("if", "for", "while", "catch", "case")
            elif x in ("&&", "||"):
                n += 1
            elif x == "?":
                n += not (j.peek(k - 1) in ("<", ",") and j.peek(k + 1) in (">", ",", "extends", "super"))
        return n

    def cognitive(self) -> int:
        self.score = 0
        self._list(self.a + 1, self.b - 1, 0)
        return self.score

    def _list(self, k: int, end: int, depth: int):
        while k < end:
            k = self._statement(k, end, depth)

    def _if(self, k: int, end: int, depth: int) -> int:
        """A chain: the first if costs its nesting, each else one. Conditions aren't looked at."""
        first = True
        while self.j.peek(k) == "if":
            self.score += 1 + depth if first else 1
            first = False
            k = self._inside(self.j.mate[k + 1] + 1, end, depth + 1)
            if self.j.peek(k) != "else" or k >= end:
                return k
            k += 1
        self.score += 1
        return self._inside(k, end, depth + 1)

    def _inside(self, k: int, end: int, depth: int) -> int:
        """Only what a branch holds; a branch that is itself a bare if or loop isn't counted."""
        j = self.j
        if j.peek(k) == "if":
            self._expression(k + 2, j.mate[k + 1], depth)
            k = self._statement(j.mate[k + 1] + 1, end, depth)
            return self._statement(k + 1, end, depth) if j.peek(k) == "else" and k < end else k
        if j.peek(k) in ("for", "while", "switch", "do"):
            return self._loop(k, end, depth, 0)
        return self._statement(k, end, depth)

    def _loop(self, k: int, end: int, depth: int, cost: int) -> int:
        j, word = self.j, self.j.t[k]
        self.score += cost
        inner = depth + (cost > 0)
        if word == "do":
            k = self._statement(k + 1, end, inner)
            close = j.mate[k + 1]
            self._expression(k + 2, close, inner)
            return close + 2
        close = j.mate[k + 1]
        self._expression(k + 2, close, inner)
        if word == "switch":
            self._entries(close + 1, inner)
            return j.mate[close + 1] + 1
        return self._statement(close + 1, end, inner)

    def _entries(self, k: int, depth: int):
        j, end = self.j, self.j.mate[k]
        k += 1
        while k < end:
            if j.t[k] in ("case", "default") and j.kind[k] == "word":
                k = j.stop(k, end, {":", "->"}) + 1
            else:
                k = self._statement(k, end, depth)

    def _statement(self, k: int, end: int, depth: int) -> int:
        j = self.j
        if k >= end:
            return end
        x = j.t[k]
        if x == "{":
            self._list(k + 1, j.mate[k], depth)
            return j.mate[k] + 1
        if x == "if":
            return self._if(k, end, depth)
        if x in ("for", "while", "do") or x == "switch" and j.peek(k + 1) == "(":
            return self._loop(k, end, depth, 1 + depth)
        if x == "try":
            k += 1
            if j.peek(k) == "(":
                self._expression(k + 1, j.mate[k], depth)
                k = j.mate[k] + 1
            k = self._statement(k, end, depth)
            while j.peek(k) == "catch":
                self.score += 1 + depth
                k = self._statement(j.mate[k + 1] + 1, end, depth + 1)
            return self._statement(k + 1, end, depth) if j.peek(k) == "finally" else k
        if x == "synchronized" and j.peek(k + 1) == "(":
            self._expression(k + 2, j.mate[k + 1], depth)
            return self._statement(j.mate[k + 1] + 1, end, depth)
        if j.kind[k] == "word" and j.peek(k + 1) == ":" and x not in ("case", "default"):
            return self._statement(k + 2, end, depth)
        if _kind_at(j, k) or x in ("final", "abstract", "static") and _kind_at(j, k + 1):
            open_ = next(i for i in range(k, end) if j.t[i] == "{")
            self._members(open_, depth)
            return j.mate[open_] + 1
        stop = j.stop(k, end, {";"})
        self._expression(k, stop, depth)
        return stop + 1

    def _members(self, open_: int, depth: int):
        """Bodies within a class body, at the depth around it."""
        j, k = self.j, open_ + 1
        while k < j.mate[open_]:
            if j.t[k] == "{":
                self._list(k + 1, j.mate[k], depth)
                k = j.mate[k] + 1
            elif j.t[k] == "(":
                k = j.mate[k] + 1
            elif j.t[k] == "=":
                stop = j.stop(k, j.mate[open_], {";"})
                self._expression(k + 1, stop, depth)
                k = stop + 1
            else:
                k += 1

    def _expression(self, k: int, end: int, depth: int):
        """Logical runs, one each per bracket level and operator, and lambdas, which deepen what they hold."""
        j, ors, ands = self.j, False, False

        def close():
            nonlocal ors, ands
            self.score += ors + ands
            ors = ands = False

        while k < end:
            x = j.t[k]
            mark = j.kind[k] == "mark"
            if mark and x == "->":
                close()
                self.score += 1
                if j.peek(k + 1) == "{":
                    self._list(k + 2, j.mate[k + 1], depth + 1)
                    k = j.mate[k + 1] + 1
                    continue
                stop = j.stop(k + 1, end, {",", ";"})
                self._expression(k + 1, stop, depth + 1)
                k = stop
                continue
            if x == "switch" and j.peek(k + 1) == "(":
                self._expression(k + 2, j.mate[k + 1], depth)
                self._entries(j.mate[k + 1] + 1, depth)
                k = j.mate[j.mate[k + 1] + 1] + 1
                continue
            if mark and x == "{":
                if j.peek(k - 1) == ")":
                    self._members(k, depth)
                else:
                    self._expression(k + 1, j.mate[k], depth)
                k = j.mate[k] + 1
                continue
            if mark and x in ("(", "["):
                self._expression(k + 1, j.mate[k], depth)
                k = j.mate[k] + 1
                continue
            if mark and x == "&&":
                ands = True
            elif mark and x == "||":
                self.score += ands
                ors, ands = True, False
            elif mark and x in (",", ";", "?", ":", "=", "+=", "-=", "&=", "|=", "^="):
                close()
            k += 1
        close()

    def calls(self) -> list[str]:
        """Text of every call with its receiver, outer ones first."""
        j, found = self.j, []
        for k in range(self.a, self.b - 1):
            if j.kind[k] != "word" or j.t[k + 1] != "(" or j.t[k] in _NOT_CALLED:
                continue
            before = j.peek(k - 1)
            start = k
            if before == ">" and k - 1 > self.a:
                d, i = 0, k - 1
                while i > self.a:
                    d += (j.t[i] == ">") - (j.t[i] == "<")
                    if d == 0:
                        break
                    i -= 1
                if j.peek(i - 1) != ".":
                    continue
                start = i
                before = "."
            if before == "new" or (j.kind[k - 1] == "word" and before not in _BEFORE_CALL):
                continue
            while j.peek(start - 1) == ".":
                i = start - 2
                while j.peek(i) in (")", "]"):
                    i = j.mate[i] - 1
                    if j.kind[i] == "mark" and j.peek(i) not in (")", "]"):
                        i += 1
                        break
                start = i
                if j.peek(start - 1) == "new":
                    start -= 1
                    break
                if j.peek(start) == "(":
                    break
            if j.peek(start - 1) == "new" and start != k:
                start -= 1
            elif j.peek(start - 1) == "new":
                continue
            found.append((start, -j.mate[k + 1]))
        # a dotted constructor such as new a.B(..) isn't a call
        return [j.text(a, -b + 1) for a, b in sorted(found) if not (j.t[a] == "new" and j.mate.get(next((i for i in range(a, -b) if j.t[i] == "("), -1)) == -b)]

    def accessed(self, fields: list[str]) -> list[str]:
        j, known, out = self.j, set(fields), {}
        for k in range(self.a, self.b):
            if j.kind[k] == "word" and j.t[k] in known and j.peek(k + 1) != "(" and not (j.kind[k - 1] == "word" and j.t[k - 1] not in _NOT_CALLED) and j.peek(k - 1) not in ("::", "@"):
                out[j.t[k]] = None
        return list(out)


def _method(fqcn: str, name: str, returns: str, tags, modifiers, parameters, lines, constructor=False, synthesised=False) -> dict:
    names = [t for t, _ in tags]
    status = next(iter(_values(tags, "ResponseStatus", "", "value", "code")), None)
    return {
        "id": f"{fqcn}#{name}({','.join(p['type'] for p in parameters)})", "name": name, "return_type": returns, "modifiers": modifiers, "annotations": names, "is_constructor": constructor, "line_range": lines, "parameters": parameters,
        "is_bean_factory": not constructor and "Bean" in names, "exception_handler": not constructor and "ExceptionHandler" in names, "response_body": not constructor and "ResponseBody" in names, "response_status": None if constructor else status,
        "http_metadata": None if constructor else _http(tags), "method_loc": None, "cognitive_complexity": None, "cyclomatic_complexity": None, "calls": [], "accessed_fields": [], "is_synthesised": synthesised,
    }


def _members(j: Java, head: dict, fqcn: str, kind: str):
    """(fields, methods, constructors, elements) of a body; nested types aren't entered."""
    fields, methods, constructors, elements, bodies = [], [], [], [], []
    k, end = head["open"] + 1, head["close"]
    if kind == "enum":
        stop = j.stop(k, end, {";"})
        head["constants"] = []
        a = k
        while a < stop:
            _, a = j.annotations(a)
            if a < stop and j.kind[a] == "word":
                head["constants"].append(j.t[a])
            a = j.stop(a, stop, {","}) + 1
        k = stop + 1
    while k < end:
        if j.t[k] == ";":
            k += 1
            continue
        begin = k
        tags, modifiers, k = j.prefix(k)
        if (j.peek(k) == "{") or (j.peek(k) == "static" and j.peek(k + 1) == "{"):
            k = j.mate[k if j.t[k] == "{" else k + 1] + 1
            continue
        if inner := _kind_at(j, k):
            k = _header(j, k, inner)["close"] + 1
            continue
        if j.peek(k) == "<":
            k = j.angle(k)
        compact = kind == "record" and j.peek(k) == head["name"] and j.peek(k + 1) == "{"
        if j.peek(k) == head["name"] and j.peek(k + 1) == "(" or compact:
            name, returns, constructor, k = j.t[k], head["name"], True, k + 1
        else:
            returns, k = j.type_(k)
            if k >= end or j.kind[k] != "word":
                raise ScanError("member name expected")
            name, constructor, k = j.t[k], False, k + 1
        if j.peek(k) == "(" or compact:
            parameters = [] if compact else _parameters(j, k)
            k = k if compact else j.mate[k] + 1
            while j.peek(k) == "[":
                returns, k = returns + "[]", k + 2
            if j.peek(k) == "throws":
                k = next(i for i in range(k, end) if j.t[i] in ("{", ";"))
            default = None
            if j.peek(k) == "default":
                stop = j.stop(k, end, {";"})
                default, k = j.text(k + 1, stop), stop
            body = None
            if j.peek(k) == "{":
                body, k = (k, j.mate[k] + 1), j.mate[k]
            elif j.peek(k) != ";":
                raise ScanError("body expected")
            elements.append({"name": name, "type": returns, "default_value": default})
            m = _method(fqcn, name, returns, tags, modifiers, parameters, [j.line(begin), j.last_line(k)], constructor)
            (constructors if constructor else methods).append(m)
            if body:
                bodies.append((m, Body(j, *body)))
                m["method_loc"] = m["line_range"][1] - m["line_range"][0] + 1
            k += 1
            continue
        stop = j.stop(k, end, {";"})
        names = [t for t, _ in tags]
        wired = "Autowired" in names or "Inject" in names
        column = None
        if own := next((pairs for tag, pairs in tags if tag == "Column" and any(key for key, _ in pairs)), None):
            given = {key: _strip(raw) for key, raw in own}
            length = given.get("length", "")
            column = {"name": given.get("name"), "nullable": given["nullable"].lower() == "true" if "nullable" in given else None, "length": int(length) if re.fullmatch(r"[+-]?\d{1,9}", length) else None}
        while True:
            declared = returns
            while j.peek(k) == "[":
                declared, k = declared + "[]", k + 2
            fields.append({"id": f"{fqcn}.{name}", "name": name, "type": declared, "modifiers": modifiers, "annotations": names, "is_autowired": wired, "is_id": "Id" in names, "injection_type": "field" if wired else None, "qualifier": next((_strip(v) for v in _values(tags, "Qualifier", "", "value")), None), "generation": next(iter(_values(tags, "GeneratedValue", "strategy")), None), "column": column, "constraints": [n for n in names if n in CONSTRAINTS]})
            k = j.stop(k, stop, {","})
            if k >= stop:
                break
            name, k = j.name(k + 1)
        k = stop + 1
    known = [f["name"] for f in fields]
    for m, body in bodies:
        m["cyclomatic_complexity"], m["cognitive_complexity"] = body.cyclomatic(), body.cognitive()
        m["calls"], m["accessed_fields"] = body.calls(), body.accessed(known)
    return fields, methods, constructors, elements


def lombok(tags: set[str], name: str, fqcn: str, fields: list[dict], methods: list[dict], constructors: list[dict]):
    """Append the members that Lombok annotations stand for, unless one of that name and arity is there."""
    has = lambda n, arity: any(m["name"] == n and len(m["parameters"]) == arity for m in methods)

    def add(target: list[dict], n: str, returns: str, parameters=(), modifiers=("public",)):
        whole = [{"binding": None, "constraints": [], "name": p, "type": t, "validate": False} for p, t in parameters]
        m = _method(fqcn, n, returns, [("Synthesised", [])], list(modifiers), whole, [0, 0], target is constructors, True)
        target.append(m | {"cyclomatic_complexity": 1, "cognitive_complexity": 0, "method_loc": 0})

    own = [f for f in fields if "static" not in f["modifiers"]]
    for f in own:
        title = f["name"][:1].upper() + f["name"][1:]
        getter = ("is" if f["type"] == "boolean" else "get") + title
        if (tags & {"Getter", "Data", "Value"} or "Getter" in f["annotations"]) and not has(getter, 0):
            add(methods, getter, f["type"])
        settable = (tags & {"Setter", "Data"} or "Setter" in f["annotations"]) and "final" not in f["modifiers"] and "Value" not in tags
        if settable and not has("set" + title, 1):
            add(methods, "set" + title, "void", [(f["name"], f["type"])])
    wanted = []
    if "NoArgsConstructor" in tags:
        wanted.append([])
    if tags & {"AllArgsConstructor", "Value"}:
        wanted.append(own)
    if tags & {"RequiredArgsConstructor", "Data"}:
        wanted.append([f for f in own if "final" in f["modifiers"] or "NonNull" in f["annotations"]])
    for arguments in wanted:
        if not any(len(c["parameters"]) == len(arguments) for c in constructors):
            add(constructors, name, name, [(f["name"], f["type"]) for f in arguments])
    if "Data" in tags:
        for n, returns, parameters in (("toString", "String", []), ("equals", "boolean", [("o", "Object")]), ("hashCode", "int", [])):
            if not has(n, len(parameters)):
                add(methods, n, returns, parameters)
    if "Builder" in tags and not has("builder", 0):
        add(methods, "builder", f"{name}.Builder", modifiers=("public", "static"))


def lcom4(methods: list[dict]) -> int | None:
    """Groups of non-static methods that share fields or call each other by name."""
    own = [m for m in methods if "static" not in m["modifiers"]]
    if not own:
        return None
    root = list(range(len(own)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    first: dict[str, int] = {}
    by_name: dict[str, list[int]] = {}
    for k, m in enumerate(own):
        by_name.setdefault(m["name"], []).append(k)
    for k, m in enumerate(own):
        for f in m["accessed_fields"]:
            root[find(k)] = find(first.setdefault(f, k))
        for c in m["calls"]:
            for other in by_name.get(c.split("(", 1)[0].rsplit(".", 1)[-1].strip(), []):
                root[find(k)] = find(other)
    return len({find(k) for k in range(len(own))})


def scan(path: str, source: str) -> dict:
    """Parsed facts of the file's primary type: the public one named as the file, else the first."""
    j = Java(source)
    k, package, imports, types = 0, "", [], []
    _, after = j.annotations(0)
    if j.peek(after) == "package":
        package, k = j.name(after + 1)
    while k < len(j.t):
        if j.t[k] == ";":
            k += 1
        elif j.t[k] == "import":
            name, k = j.name(k + 2 if j.peek(k + 1) == "static" else k + 1)
            imports.append(name)
            k = j.stop(k, len(j.t), {";"}) + 1
        else:
            begin = k
            tags, modifiers, k = j.prefix(k)
            kind = _kind_at(j, k)
            if not kind:
                raise ScanError(f"declaration expected, not {j.peek(k)}")
            head = _header(j, k, kind) | {"kind": kind, "tags": tags, "modifiers": modifiers, "begin": begin}
            types.append(head)
            k = head["close"] + 1
    if not types:
        raise ScanError("no type")
    stem = re.sub(r".*[/\\]|\.java$", "", path)
    head = next((t for t in types if "public" in t["modifiers"] and t["name"] == stem), types[0])
    kind, name = head["kind"], head["name"]
    fqcn = f"{package}.{name}" if package else name
    names = [t for t, _ in head["tags"]]
    out = dict.fromkeys(PARSED_FIELDS)
    out |= {"kind": kind, "id": fqcn, "name": name, "source_file": path, "extraction_mode": "ast", "annotations": names, "imports": imports, "line_range": [j.line(head["begin"]), j.last_line(head["close"])], "modifiers": head["modifiers"], "fqcn_resolved": True}
    fields, methods, constructors, elements = _members(j, head, fqcn, kind)
    if kind == "class":
        lombok(set(names), name, fqcn, fields, methods, constructors)
        every = methods + constructors
        table = None
        if "Entity" in names:
            given = _values(head["tags"], "Table", "", "name")
            table = _strip(given[0]) if given else name.lower()
        coupled = {re.sub(r"<.*", "", x).strip() for x in [re.sub(r"(\[\])+$", "", f["type"]) for f in fields] + [m["return_type"] for m in methods] + [p["type"] for m in every for p in m["parameters"]]}
        weights = [m["cyclomatic_complexity"] or 0 for m in every]
        out |= {"stereotype": next((n for n in names if n in STEREOTYPES), None), "superclass": next(iter(head["extends"]), None), "implements": head["implements"], "is_inner_class": False, "table_name": table, "entry_point": "SpringBootApplication" in names, "wmc": sum(weights) if weights else None, "cbo": len(coupled - UNCOUPLED - {""}), "lcom4": lcom4(every), "fields": fields, "methods": every}
    elif kind == "interface":
        out |= {"extends_interfaces": head["extends"], "methods": methods}
    elif kind == "enum":
        out |= {"implements": head["implements"], "constants": head["constants"], "fields": [], "methods": []}
    elif kind == "record":
        out |= {"implements": head["implements"], "components": head["components"]}
    else:
        out |= {"elements": elements}
    return out


@contextmanager
def at_most(seconds: float):
    """Raise ScanError in the main thread of a worker when its time is up; elsewhere there is no limit."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_):
        raise ScanError(f"more than {seconds:g} seconds")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


@contextmanager
def uncollected():
    """No search for cycles meanwhile: facts are trees of many small objects, which it would walk again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


#: Files whose facts a worker holds as Python objects at once.
AT_ONCE = 256


def _scan_batches(schema: pa.Schema, seconds: float):
    kind = schema.field("ast").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, AT_ONCE) for whole in batches for a in range(0, whole.num_rows, AT_ONCE)):
            names, columns = batch.schema.names, batch.columns
            path, text = names.index("path"), names.index("text")
            sources, rows = columns[text].to_pylist(), []
            with uncollected():
                for k, (name, source) in enumerate(zip(columns[path].to_pylist(), sources, strict=True)):
                    try:
                        with at_most(seconds):
                            rows.append(scan(name, source) if source is not None else None)
                            sources[k] = None
                    except (ScanError, StopIteration, KeyError, IndexError, RecursionError):
                        rows.append(None)
                facts = pa.array(rows, kind)
                rows.clear()
            columns[text] = pa.array(sources, columns[text].type)
            yield pa.RecordBatch.from_arrays([*columns, facts], names=[*names, "ast"])

    return run


def extract(files: DataFrame, seconds: float = 30.0, columns: Sequence[str] = tuple(PARSED_FIELDS)) -> DataFrame:
    """Parsed rows of ``files(path, text, ...)``, or some ``columns`` of them: scanned, or by regular expressions where
    that fails or takes more than ``seconds`` for a file.

    Files are scanned in Arrow batches without a shuffle; only the columns asked for leave the worker. The fallback is
    an expression on the same row, which has a text left only where it is needed.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = files.sparkSession.createDataFrame([], ", ".join(f"{k} {PARSED_FIELDS[k]}" for k in columns)).schema
    schema = T.StructType([*files.schema.fields, T.StructField("ast", struct)])
    scanned = files.mapInArrow(_scan_batches(to_arrow_schema(schema), seconds), schema)
    rest = [c for c in files.columns if c not in ("path", "text")]
    both = regex_extract.extract(scanned).select(*rest, "ast", *(F.col(k).alias(f"__r_{k}") for k in columns))
    return both.select(*rest, *(F.when(F.col("ast").isNotNull(), F.col(f"ast.{k}")).otherwise(F.col(f"__r_{k}")).alias(k) for k in columns))

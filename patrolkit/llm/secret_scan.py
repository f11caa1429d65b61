"""Secret scans: assignment-aware lexing of source and configuration text.

The text is searched for assignment signs (``name = value``, ``name: value``, ``"name": value``, ``:=``, ``=>``, ``+=``,
``<-``; ``x["name"]`` and several names before one sign too), ``<name>value</name>``, ``--name value``, ``setName(value)``
and ``call("name", value)``; a name such as key with a name such as value behind it is a pair as well; from each the value is lexed over as many lines as it takes: quoted, triple-quoted and
backtick strings, joins by ``+``, brackets with what they hold, arguments of calls, indented blocks and lists, values on the next line,
and bare values to the end of their run. Names are looked up among all constants assigned earlier in the same text, so a
literal reaches every name that it is given to in the end; what a bracket holds also reaches the name outside. A literal
scores by how sensitive its target names are and by its length, its kinds of characters and its entropy. Fixed patterns
(assignments by keyword, access keys, long hex runs) are always kept. One pass moves only forwards, but for names, which
are read backwards from their sign, and strings, which are searched once more inside.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import with_batches

KINDS = ("assign", "access", "hex", "literal")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: Literals that score at or over this are reported.
CUT = 0.6


def _either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_ASSIGN = re.compile(
    "(?:" + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key") + ")"
    + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(f"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}")  # a run that is too short holds no longer match
_HEX = re.compile(f"[0-9a-f]{{{LEAST_HEX},}}")  # runs are matched whole, so only their length decides

_NAME = r"[A-Za-z_$][\w.$-]*"
_NAMED = re.compile(_NAME + r"\Z")
_MARK = re.compile(r"[=:(]|<(?=[A-Za-z_-])|--(?=[A-Za-z])")
_TAG = re.compile(rf"<({_NAME})[ \t]*+>[ \t]*+([^<>\s][^<>\n]*+)</")
_BRACKET = re.compile(r"[()\[\]{}]")
_SIGN = re.compile(r"[ \t]*(?:(?P<add>\+)=(?!=)|:=|=>|=(?![=>])|:(?!:)|<-(?!-))")
#: A name in quotes with a comma behind it, as the first argument of a call; an option whose value is the next word.
_KEYED = re.compile(rf"""\(\s*(?P<q>["'])(?P<key>{_NAME})(?P=q)\s*,\s*(?=\S)""")
_OPTION = re.compile(r"--([A-Za-z][\w-]*)[ \t]+(?=[^\s-])")
_NEW = re.compile(r"(?:new|await)[ \t]+(?=[A-Za-z_$])")
#: What a setter's name begins with; the rest names what it sets. Calls with such a name give a value to a name.
_SETTER = re.compile(r"(?:[Ss]et|[Ww]ith)(?=[A-Z_])_?")
_GIVES = re.compile(r"(?i)set|put|def|add|assign|insert|store|save|export|register|update")
#: Names of pairs that are written apart: what the first one holds is the name of what the second one holds.
_KEYS, _VALUES = frozenset(("key", "name", "id")), frozenset(("value", "val", "default", "content"))
#: Characters between the two at most; user information of an address at most.
_APART = 200
_USER_INFO = re.compile(r"""://[^\s/:@"'<>]{0,256}:(?!\$?\{)([^\s/:@"'<>]{6,1024})@""")
_STRING = re.compile(
    r"""[rRbBuUfF]{0,2}(?:(?P<q>\"""|\''')(?P<long>[\s\S]*?)(?:(?P=q)|\Z)|"(?P<two>(?:[^"\\\n]|\\.)*+)"|'(?P<one>(?:[^'\\\n]|\\.)*+)'|`(?P<tick>[^`]*+)`)"""
)
_OPEN_STRING = re.compile(r"""["']([^\s"']+)""")
_CALL = re.compile(rf"({_NAME})([(\[])")
_BLOCK = re.compile(r"[|>][+-]?\d?[ \t]*(?:#[^\n]*)?(?=\r?\n)")
_LINE_END = re.compile(r"[ \t]*\\?[ \t]*(?:(?:#|//)[^\n]*)?\r?\n")
_DASH = re.compile(r"[ \t]*-[ \t]+")
_BARE = re.compile(r"""(?:[^\s"'`<]|<(?!/))+""")
_BARE_INSIDE = re.compile(r"""(?:[^\s"'`<,;()\[\]{}]|<(?!/))+""")
_NEXT_PAIR = re.compile(rf"[;,&](?=[\"']?{_NAME}[\"']?[=:])")
_SCHEME = re.compile(r"(?:[Bb]earer|[Bb]asic|[Tt]oken)[ \t]+(?=\S)")
_JOIN = re.compile(r"""[ \t]*(?:\\\r?\n[ \t]*)?(?:\+(?!=)|\|\||\?\?|\bor\b|\.{1,2}(?=[ \t"']))[ \t]*(?:\\?\r?\n[ \t]*)?""")
_BESIDE = re.compile(r"""[ \t]*(?:\\\r?\n[ \t]*)?(?=["'])""")
_TYPED = re.compile(r"[ \t]*=(?![=>])")
_METHOD = re.compile(r"\.[A-Za-z_]\w*\(")
_INSIDE = re.compile(rf"""(?P<space>\s+)|(?P<call>{_NAME}[(\[])|(?P<word>{_NAME})|(?P<open>[(\[{{])|(?P<shut>[)\]}}])|(?P<other>[^\s"'`(\[{{)\]}}A-Za-z_$]+|.)""")
_SHUT = {"(": ")", "[": "]", "{": "}"}
#: Calls with such a name look a value up by their arguments, which are no values themselves.
_LOOKUP = re.compile(r"(?i)get|env|load|read|fetch|find|lookup|input|prompt|require|import|open")
#: Weights of the parts of a target name: fixed values.
_SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "auth": 0.6, "authorization": 0.8, "bearer": 0.8, "private": 0.6, "signing": 0.5, "key": 0.5,
    "access": 0.4, "api": 0.4, "client": 0.2, "session": 0.3, "cookie": 0.4, "salt": 0.5, "pin": 0.4,
}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def sensitivity(name: str) -> float:
    """0 to 1: how much the parts of a name (camel case, underscores, dots) speak of a secret."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    joined = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    weights = sorted((_SENSITIVE.get(p) or _SENSITIVE.get(p.removesuffix("s"), 0.0) for p in parts + joined), reverse=True)[:2]
    return min(1.0, sum(weights))


def strength(value: str) -> float:
    """0 to 1: how much a literal looks like a made-up key: length, kinds of characters and entropy in bits."""
    if len(value) < LEAST_VALUE or any(c.isspace() for c in value):
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(any(test(c) for c in value) for test in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value)
    return min(1.0, 0.15 * min(n, 20) / 20 + 0.2 * (kinds - 1) + 0.5 * min(entropy, 4.0) / 4.0)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` of the fixed patterns, leftmost and non-overlapping within a kind."""
    found = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return in_order(found)


def in_order(spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    return sorted(set(spans), key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


class Assignments:
    """The assignments of one text, in order, as numbers: where each name and each literal stands, and the references.

    A reference leads from an assignment to the earlier one whose value its right side names, so a literal is held once
    however often it is handed on.
    """

    def __init__(self) -> None:
        self.names = array("q")  # start, end of each assignment's name
        self.literals = array("q")  # assignment, start, end of each literal
        self.references = array("q")  # assignment, earlier assignment


@dataclass(slots=True)
class _Frame:
    """An open value (``shut`` empty) or an open bracket; literals inside go to assignment ``number`` (none: -1)."""

    number: int
    shut: str
    name: str = ""
    sign: str = ""
    given: bool = False
    fresh: bool = True  # no item of the value was read yet
    after_string: bool = False


class _Lexer:
    def __init__(self, text: str):
        self.text, self.out = text, Assignments()
        self.known: dict[str, int] = {}
        self.key: tuple[int, int] | None = None  # the last literal that a name such as "key" holds
        self._pairs: dict[int, int] | None = None

    @property
    def pairs(self) -> dict[int, int]:
        """Where each bracket that is closed at all is closed."""
        if self._pairs is None:
            self._pairs, open_ones, count = {}, [], Counter()
            for found in _BRACKET.finditer(self.text):
                mark = found[0]
                if mark in _SHUT:
                    open_ones.append((found.start(), _SHUT[mark]))
                    count[_SHUT[mark]] += 1
                elif count[mark]:
                    while open_ones[-1][1] != mark:
                        count[open_ones.pop()[1]] -= 1
                    count[mark] -= 1
                    self._pairs[open_ones.pop()[0]] = found.start()
        return self._pairs

    def search(self, at: int, end: int, nested: bool = False) -> None:
        """Lexes the assignments of ``text[at:end]``; ``nested`` within a string."""
        self.end, self.nested = end, nested
        self.stack: list[_Frame] = []
        self.open_brackets = Counter()
        strings: list[tuple[int, int]] = []
        self.strings = strings
        while at < end:
            if not self.stack:
                mark = _MARK.search(self.text, at, end)
                if mark is None:
                    break
                at = self._begin_at(mark.start(), at)
            elif self.stack[-1].shut:
                at = self._inside(at)
            else:
                at = self._value(at)
        while self.stack:
            self._close()
        if not nested:
            for a, b in strings:
                self.search(a, b, True)

    def _begin_at(self, mark: int, low: int) -> int:
        """Opens the assignment of the sign or tag at ``mark``, if there is one; returns where to go on."""
        text = self.text
        if text[mark] == "(":
            first = mark
            while first > low and (text[first - 1].isalnum() or text[first - 1] in "_.$"):
                first -= 1
            return self._given_by_call(first, mark) or mark + 1
        if text[mark] == "-":
            option = _OPTION.match(text, mark, self.end)
            if option is None:
                return mark + 2
            self._begin(option[1], *option.span(1))
            return option.end()
        if text[mark] == "<" and text[mark + 1 : mark + 2] != "-":
            tag = _TAG.match(text, mark, self.end)
            if tag is None:
                return mark + 1
            self._begin(tag[1], tag.start(1), tag.end(1))
            self._literal(tag.start(2), tag.start(2) + len(tag[2].rstrip()))
            self._close()
            return tag.end()
        stop = mark - 1 if mark > low and text[mark] == "=" and text[mark - 1] == "+" else mark
        sign = _SIGN.match(text, stop, self.end)
        if sign is None or (mark > low and text[mark] == "=" and text[mark - 1] in "!<>="):
            return mark + 2 if text[mark : mark + 2] in ("==", "::") else mark + 1
        last = stop
        while last > low and text[last - 1] in " \t":
            last -= 1
        subscript = last > low and text[last - 1] == "]"
        last -= subscript
        quote = text[last - 1] if last > low and text[last - 1] in "\"'" else ""
        last -= len(quote)
        first = last
        while first > low and (text[first - 1].isalnum() or text[first - 1] in "_.$-"):
            first -= 1
        while first < last and not (text[first].isalpha() or text[first] in "_$"):
            first += 1
        if not _NAMED.match(text, first, last) or (quote and text[first - 1 : first] != quote) or (subscript and text[first - 2 : first - 1] != "["):
            return sign.end()
        if text[mark] == "=" and not quote and (end := self._several(first, last, low, sign.end())):
            return end
        self._begin(text[first:last], first, last, sign)
        return sign.end()

    def _several(self, first: int, last: int, low: int, at: int) -> int | None:
        """The end of ``a, b = 1, "x"``, where as many plain items stand behind the sign as names before it; else None."""
        text, names, start = self.text, [(first, last)], first
        while True:
            while start > low and text[start - 1] in " \t":
                start -= 1
            if start <= low or text[start - 1] != ",":
                break
            start -= 1
            while start > low and text[start - 1] in " \t":
                start -= 1
            end = start
            while start > low and (text[start - 1].isalnum() or text[start - 1] in "_.$-"):
                start -= 1
            if not _NAMED.match(text, start, end):
                return None
            names.append((start, end))
        if len(names) < 2:
            return None
        names.reverse()
        items: list[tuple[re.Match | None, int, int]] = []
        while True:
            while at < self.end and text[at] in " \t":
                at += 1
            string = _STRING.match(text, at, self.end)
            run = string or _BARE_INSIDE.match(text, at, self.end)
            if run is None or len(items) == len(names):
                return None
            items.append((string, at, run.end()))
            at = run.end()
            while at < self.end and text[at] in " \t":
                at += 1
            if at >= self.end or text[at] != ",":
                break
            at += 1
        if len(items) != len(names) or at < self.end and text[at] not in "\r\n;#":
            return None
        for (a, b), (string, low, high) in zip(names, items, strict=True):
            self._begin(text[a:b], a, b)
            if string:
                self._string(string)
            elif not self._refer(text[low:high]):
                self._literal(low, high)
            self._close()
        return at

    def _given_by_call(self, first: int, bracket: int) -> int | None:
        """Opens what a call gives to a name: ``setName(value`` or ``call("name", value``; returns where to go on."""
        text = self.text
        called = text[first:bracket]
        if not called or bracket not in self.pairs:
            return None
        keyed = _KEYED.match(text, bracket, self.end)
        method = called.rfind(".") + 1
        setter = _SETTER.match(called, method)
        if keyed and (_GIVES.match(called, method) or not _LOOKUP.search(called, method)):
            name, at = keyed.span("key"), keyed.end()
        elif setter and setter.end() < len(called) and not keyed:
            name, at = (first + setter.end(), bracket), bracket + 1
        else:
            return None
        self._begin(text[slice(*name)], *name)
        self.stack[-1].fresh = False
        self._open(")", self.stack[-1].number)
        return at

    def _begin(self, name: str, first: int, last: int, sign: re.Match | None = None) -> None:
        number = len(self.out.names) // 2
        if self.key and name.lower() in _VALUES and 0 < first - self.key[1] <= _APART and not re.search(r"[<>{}]|\n[ \t]*\r?\n", self.text[self.key[1] : first]):
            first, last = self.key
        self.out.names.extend((first, last))
        self.stack.append(_Frame(number, "", name, sign[0].strip() if sign else ""))
        if sign and sign["add"]:
            self._refer(name)

    def _close(self) -> None:
        """Closes the innermost frame; a value that was given becomes its name's constant and reaches the frame outside."""
        frame = self.stack.pop()
        if frame.shut:
            self.open_brackets[frame.shut] -= 1
            return
        if frame.given:
            self.known[frame.name] = frame.number
        else:
            self.known.pop(frame.name, None)
        if frame.given and self.stack and self.stack[-1].number >= 0:
            self.out.references.extend((self.stack[-1].number, frame.number))
            self._mark_given()

    def _mark_given(self) -> None:
        for frame in reversed(self.stack):
            if not frame.shut or frame.given:
                frame.given = True
                return
            frame.given = True

    def _literal(self, start: int, end: int) -> None:
        if self.stack[-1].number >= 0 and start < end:
            number = self.stack[-1].number
            self.out.literals.extend((number, start, end))
            self._mark_given()
            if self.text[slice(*self.out.names[2 * number : 2 * number + 2])].lower() in _KEYS:
                self.key = (start, end) if end - start <= _APART and _NAMED.match(self.text, start, end) else None

    def _refer(self, name: str) -> bool:
        if name not in self.known or self.stack[-1].number < 0:
            return False
        self.out.references.extend((self.stack[-1].number, self.known[name]))
        self._mark_given()
        return True

    def _open(self, shut: str, number: int) -> None:
        self.stack.append(_Frame(number, shut))
        self.open_brackets[shut] += 1

    def _string(self, found: re.Match) -> None:
        """A string's content as literals, line by line, and later searched for assignments of its own."""
        start, end = next(found.span(g) for g in ("long", "two", "one", "tick") if found[g] is not None)
        if "\n" in found[0]:
            for line in re.finditer(r"[^\s](?:[^\n]*[^\s])?", self.text[start:end]):
                self._literal(start + line.start(), start + line.end())
        else:
            self._literal(start, end)
        if not self.nested and _MARK.search(self.text, start, end):
            self.strings.append((start, end))

    def _value(self, at: int) -> int:
        """One step of an open value: its next item, or its end."""
        frame, text, end = self.stack[-1], self.text, self.end
        if not frame.fresh:
            method = _METHOD.match(text, at, end)
            if method:
                self._open(")", -1)
                return method.end()
            join = _JOIN.match(text, at, end) or (frame.after_string and _BESIDE.match(text, at, end))
            if not join:
                self._close()
                return at
            at = join.end()
        else:
            while at < end and text[at] in " \t":
                at += 1
        first, frame.fresh, frame.after_string = frame.fresh, False, False
        if made := _NEW.match(text, at, end):
            at = made.end()
        if first and (newline := _LINE_END.match(text, at, end)):
            return self._next_lines(newline.end())
        string = _STRING.match(text, at, end)
        if string:
            self._string(string)
            frame.after_string = True
            return string.end()
        config = frame.sign == ":" and len(self.stack) == 1  # a line of configuration, not an expression
        if text[at : at + 1] in _SHUT and at in self.pairs and not (config and text[at] == "("):
            self._open(_SHUT[text[at]], frame.number)
            return at + 1
        if first and (block := _BLOCK.match(text, at, end)):
            return self._block(block.end())
        call = None if config else _CALL.match(text, at, end)
        if call and (shut := self.pairs.get(call.end() - 1)) and not re.match(r"[\w!@#$%^&*/-]", text[shut + 1 : shut + 2]):
            self._refer(call[1])
            self._open(_SHUT[call[2]], -1 if call[2] == "[" or _LOOKUP.search(call[1]) else frame.number)
            return call.end()
        return self._bare(at, first)

    def _bare(self, at: int, first: bool) -> int:
        """A run without quotes: names of constants, or, directly behind the sign, a literal as in configuration files."""
        text, end = self.text, self.end
        if (broken := _OPEN_STRING.match(text, at, end)) and first:  # a quote that its line does not close
            self._literal(*broken.span(1))
            return broken.end()
        scheme = _SCHEME.match(text, at, end) if first else None
        at = scheme.end() if scheme else at
        inside = len(self.stack) > 1
        run = (_BARE_INSIDE if inside else _BARE).match(text, at, end)
        if run is None:
            self._close()
            return at
        pair = _NEXT_PAIR.search(text, at, run.end())
        stop = pair.start() if pair else run.end()
        last = stop
        while last > at and text[last - 1] in ",;":
            last -= 1
        value = text[at:last]
        key = value.removeprefix("${").removeprefix("$").removesuffix("}")
        parts = key.split("+")
        if key in self.known:
            self._refer(key)
        elif len(parts) > 1 and all(p in self.known for p in parts):
            for p in parts:
                self._refer(p)
        elif first and self.stack[-1].sign == ":" and (typed := _TYPED.match(text, stop, end)):  # a type before the value
            self.stack[-1].fresh, self.stack[-1].sign = True, "="
            return typed.end()
        elif first:
            extra = {shut: value.count(shut) - value.count(mark) for mark, shut in _SHUT.items()}
            while last > at and extra.get(text[last - 1], 0) > 0:  # brackets that close what stands before the run
                extra[text[last - 1]] -= 1
                last -= 1
            self._literal(at, last)
        return stop

    def _indent(self, at: int) -> int:
        """Columns of white space in front of the line that holds ``at``."""
        start = self.text.rfind("\n", 0, at) + 1
        return len(self.text[start:at]) - len(self.text[start:at].lstrip(" \t"))

    def _block(self, at: int) -> int:
        """The lines of an indented block, each a literal."""
        text = self.text
        least = self._indent(self.out.names[-2]) + 1
        while at < self.end:
            stop = text.find("\n", at + 1, self.end)
            stop = self.end if stop < 0 else stop
            line = text[at + 1 : stop]
            body = line.strip()
            if body and len(line) - len(line.lstrip(" \t")) < least:
                break
            if body:
                start = at + 1 + line.index(body[0])
                self._literal(start, start + len(body))
            at = stop
        self._close()
        return at

    def _next_lines(self, at: int) -> int:
        """A value that starts on the line after its sign: list items, or one item unless that line is an assignment."""
        text, end = self.text, self.end
        listed = False
        while dash := _DASH.match(text, at, end):
            stop = text.find("\n", dash.end(), end)
            stop = end if stop < 0 else stop
            if _MARK.search(text, dash.end(), stop) and not _STRING.match(text, dash.end(), stop):
                break  # the item holds assignments of its own
            string = _STRING.match(text, dash.end(), stop)
            run = _BARE.match(text, dash.end(), stop)
            if string:
                self._string(string)
            elif run and not self._refer(run[0]):
                self._literal(*run.span())
            listed, at = True, min(end, stop + 1)
        if not listed:
            while at < end and text[at] in " \t":
                at += 1
            stop = text.find("\n", at, end)
            own = _MARK.search(text, at, end if stop < 0 else stop)
            if not own or _STRING.match(text, at, end) and not self._names(at):
                self.stack[-1].fresh = True
                return at if at < end and text[at] not in "\r\n" else self._end_here(at)
        self._close()
        return at

    def _end_here(self, at: int) -> int:
        self._close()
        return at

    def _names(self, at: int) -> bool:
        """Whether the string at ``at`` is a name with a sign behind it."""
        string = _STRING.match(self.text, at, self.end)
        return bool(_SIGN.match(self.text, string.end(), self.end))

    def _inside(self, at: int) -> int:
        """One token inside a bracket."""
        text, end, frame = self.text, self.end, self.stack[-1]
        string = _STRING.match(text, at, end)
        if string:
            span = next(string.span(g) for g in ("long", "two", "one", "tick") if string[g] is not None)
            sign = _SIGN.match(text, string.end(), end)
            if sign and _NAMED.match(text, *span):
                self._begin(text[span[0] : span[1]], *span, sign)
                return sign.end()
            self._string(string)
            return string.end()
        token = _INSIDE.match(text, at, end)
        if token is None:
            return at + 1
        kind, value = token.lastgroup, token[0]
        if kind == "call" and token.end() - 1 in self.pairs:
            if value[-1] == "(" and (within := self._given_by_call(at, token.end() - 1)):
                return within
            self._refer(value[:-1])
            self._open(_SHUT[value[-1]], -1 if value[-1] == "[" or _LOOKUP.search(value) else frame.number)
        elif kind == "word":
            sign = _SIGN.match(text, token.end(), end)
            if sign:
                self._begin(value, *token.span(), sign)
                return sign.end()
            self._refer(value)
        elif kind == "open" and at in self.pairs:
            self._open(_SHUT[value], frame.number)
        elif kind == "shut" and self.open_brackets[value]:
            while self.stack[-1].shut != value:
                self._close()
            self._close()
        return token.end()


def assignments(text: str) -> Assignments:
    """Every assignment of the text with the literals and the names on its right side.

    A name on the right side stands for the value that it was last given; unknown names stand for nothing. A bare
    run directly behind the sign that is no known name is a literal itself, as in configuration files.
    """
    lexer = _Lexer(text)
    lexer.search(0, len(text))
    return lexer.out


def secret_literals(text: str) -> list[tuple[int, int, float, str]]:
    """``(start, end, score, target)`` of literals whose best target name makes them a likely secret.

    The most sensitive name that an assignment's value reaches (the first of equal ones) is passed on from the last
    assignment to the first, so no list of a name's literals is ever laid out.
    """
    made = assignments(text)
    names, literals, references = made.names, made.literals, made.references
    weight = array("d", (sensitivity(text[a:b]) for a, b in zip(names[::2], names[1::2], strict=True)))
    target = array("q", range(len(weight)))
    for k in range(len(references) - 2, -1, -2):
        later, earlier = target[references[k]], references[k + 1]
        now = target[earlier]
        if weight[later] > weight[now] or weight[later] == weight[now] and later < now:
            target[earlier] = later
    out = []
    for k in range(0, len(literals), 3):
        best, start, end = target[literals[k]], literals[k + 1], literals[k + 2]
        if weight[best] >= CUT:
            score = weight[best] * strength(text[start:end])
            if score >= CUT:
                out.append((start, end, score, text[names[2 * best] : names[2 * best + 1]]))
    if "://" in text:  # the password of an address needs no name
        held = {(a, b) for a, b, *_ in out}
        out += [(*m.span(1), max(CUT, strength(m[1])), "://") for m in _USER_INFO.finditer(text) if m.span(1) not in held]
    return sorted(out)


def spans_of(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]], list[float]]:
    """``(base spans, all spans, scores of all spans)``; a base span's score is one."""
    base = base_spans(text)
    by = {(a, "literal", b): s for a, b, s, _ in secret_literals(text)} if _MARK.search(text) else {}
    every = in_order(base + list(by))
    return base, every, [by.get(s, 1.0) for s in every]


def redact(text: str, spans: list[tuple[int, str, int]], mark: str = "[SECRET]") -> str:
    """The text with the union of the spans replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in sorted(spans, key=lambda s: (s[0], s[2])):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def written_spans(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, text: str = "text", *, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base_sha256, spans and scores of every row's whole text.

    Null counts as empty: no spans and the digest of nothing. Texts of any length are scanned whole. Equal spans count
    once; spans of one start come in the order of the kinds. Rows, repeated ones too, and other columns stay; an empty
    table gives an empty table; columns that have the new names stay, and the new ones get underscores in front.
    """

    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            counts, digests, spans, scores = [], [], [], []
            for value in column.to_pylist():
                base, every, weights = spans_of(value or "")
                by = Counter(kind for _, kind, _ in base)
                counts.append([by[k] for k in KINDS[:3]])
                digests.append(hashlib.sha256(written_spans(base).encode()).hexdigest())
                spans.append(written_spans(every))
                scores.append(weights)
            return [*[pa.array([c[k] for c in counts], pa.int64()) for k in range(3)], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(scores, pa.list_(pa.float64()))]

        return work

    fields = [T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")]
    fields += [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("span_scores", T.ArrayType(T.DoubleType()))]
    return with_batches(docs, text, fields, make, drop_source=not keep_text)


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of :func:`scan` replaced in ``text``; null stays null. Columns keep their order.

    Overlapping spans get one mark. Repeated rows are redacted alike; an empty table stays empty; other columns stay,
    whatever their names.
    """

    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            return [pa.array([None if v is None else redact(v, spans_of(v)[1]) for v in column.to_pylist()], pa.string())]

        return work

    changed = with_batches(docs, text, [T.StructField("clean_text", T.StringType())], make, drop_source=True)
    made = changed.columns[-1]
    return changed.select(*[F.col(f"`{made}`").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])

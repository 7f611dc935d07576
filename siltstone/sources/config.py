"""Settings of a synchronisation."""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass, field

#: Workers when none are given.
WORKERS = 8


@dataclass
class Source:
    src: str
    dest: str


@dataclass
class Pair:
    """Two folders to reconcile; an empty conflict strategy means the default one."""

    left: str
    right: str
    conflict: str = ""


@dataclass
class Config:
    target_root: str = ""
    workers: int = WORKERS
    verify: bool | None = None
    verify_small_files: bool | None = None
    metadata_fast_skip: bool | None = None
    sources: list[Source] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    mode: str = ""
    bisync: Pair | None = None

    def on(self, name: str) -> bool:
        """A switch that nobody set is on."""
        v = getattr(self, name)
        return True if v is None else v

    def override_verify(self, verify: bool = False, no_verify: bool = False) -> None:
        """Command-line switches; switching off wins."""
        if no_verify:
            self.verify = False
        elif verify:
            self.verify = True


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "e": "\x1b", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}
_NUMBER = re.compile(r"[-+]?\d+\Z")
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s"'\[\]{},#&*!|>%@`-][^#]*?|-[^\s#][^#]*?)\s*:(?:\s+|\Z)""")


class _Reader:
    """Reads the YAML that settings are written in: nested mappings and lists, in block or flow style, plain and quoted scalars.

    Anchors, tags, block scalars, several documents and tabs as indentation are refused rather than misread.
    """

    def __init__(self, text: str):
        self.lines: list[tuple[int, str, int]] = []
        for number, raw in enumerate(text.lstrip("\ufeff").splitlines(), 1):
            line = self._uncommented(raw).rstrip()
            if line.strip() and not (line == "---" and not self.lines):
                body = line.lstrip(" ")
                if body.startswith("\t") or line in ("---", "..."):
                    raise ValueError(f"line {number}: tabs as indentation and further documents are not supported")
                self.lines.append((len(line) - len(body), body, number))
        self.at = 0

    @staticmethod
    def _uncommented(line: str) -> str:
        quote, i = "", 0
        while i < len(line):
            c = line[i]
            if quote == '"' and c == "\\":
                i += 1
            elif quote:
                quote = "" if c == quote else quote
            elif c in "\"'" and (not line[:i].strip() or line[i - 1] in " \t[{,:"):
                quote = c
            elif c == "#" and (i == 0 or line[i - 1].isspace()):
                return line[:i]
            i += 1
        return line

    def document(self):
        if not self.lines:
            return None
        value = self._block(self.lines[0][0])
        if self.at < len(self.lines):
            raise ValueError(f"line {self.lines[self.at][2]}: unexpected {self.lines[self.at][1]!r}")
        return value

    def _block(self, indent: int):
        body = self.lines[self.at][1]
        if body == "-" or body.startswith("- "):
            return self._list(indent)
        return self._mapping(indent) if _KEY.match(body) else self._value(body)

    def _list(self, indent: int) -> list:
        out = []
        while self.at < len(self.lines) and self.lines[self.at][0] == indent and (self.lines[self.at][1] == "-" or self.lines[self.at][1].startswith("- ")):
            _, body, number = self.lines[self.at]
            rest = body[1:].lstrip()
            if not rest:
                self.at += 1
                out.append(self._below(indent))
            elif rest.startswith("- ") or _KEY.match(rest):
                inner = indent + len(body) - len(rest)
                self.lines[self.at] = (inner, rest, number)
                out.append(self._block(inner))
            else:
                out.append(self._value(rest))
        return out

    def _mapping(self, indent: int) -> dict:
        out: dict = {}
        while self.at < len(self.lines) and self.lines[self.at][0] == indent:
            _, body, number = self.lines[self.at]
            m = _KEY.match(body)
            if not m:
                raise ValueError(f"line {number}: expected 'key: value'")
            key, rest = str(_scalar(m[1], number)), body[m.end() :].strip()
            if key in out:
                raise ValueError(f"line {number}: {key!r} twice")
            if rest:
                out[key] = self._value(rest)
            else:
                self.at += 1
                same = self.at < len(self.lines) and self.lines[self.at][0] == indent and (self.lines[self.at][1] + " ").startswith("- ")
                out[key] = self._list(indent) if same else self._below(indent)
        return out

    def _below(self, indent: int):
        if self.at < len(self.lines) and self.lines[self.at][0] > indent:
            return self._block(self.lines[self.at][0])
        return None

    def _value(self, text: str):
        """A scalar or a flow value, which may go on over further lines; the line it starts on is used up."""
        number = self.lines[self.at][2]
        self.at += 1
        if text[0] not in "[{":
            return _scalar(text, number)
        while True:
            try:
                value, end = _flow(text, 0, number)
                break
            except IndexError:
                if self.at == len(self.lines):
                    raise ValueError(f"line {number}: no end of {text[0]!r}") from None
                text += " " + self.lines[self.at][1]
                self.at += 1
        if text[end:].strip():
            raise ValueError(f"line {number}: unexpected {text[end:].strip()!r}")
        return value


def _flow(text: str, at: int, number: int):
    """(value, position after it); IndexError where the text ends too early."""
    def blank(i: int) -> int:
        while text[i].isspace():
            i += 1
        return i

    at = blank(at)
    if text[at] == "[":
        out, at = [], blank(at + 1)
        while text[at] != "]":
            value, at = _flow(text, at, number)
            out.append(value)
            at = blank(at)
            if text[at] == ",":
                at = blank(at + 1)
            elif text[at] != "]":
                raise ValueError(f"line {number}: expected ',' or ']'")
        return out, at + 1
    if text[at] == "{":
        found: dict = {}
        at = blank(at + 1)
        while text[at] != "}":
            key, at = _flow(text, at, number)
            at = blank(at)
            if text[at] != ":":
                raise ValueError(f"line {number}: expected ':'")
            at = blank(at + 1)
            found[str(key)], at = (None, at) if text[at] in ",}" else _flow(text, at, number)
            at = blank(at)
            if text[at] == ",":
                at = blank(at + 1)
            elif text[at] != "}":
                raise ValueError(f"line {number}: expected ',' or '}}'")
        return found, at + 1
    start = at
    if text[at] in "\"'":
        quote, at = text[at], at + 1
        while text[at] != quote or (quote == "'" and text[at + 1] == "'"):
            at += 2 if (quote == '"' and text[at] == "\\") or text[at] == quote else 1
        return _scalar(text[start : at + 1], number), at + 1
    while text[at] not in ",]}[{" and not (text[at] == ":" and text[at + 1] in " ,]}"):
        at += 1
    return _scalar(text[start:at], number), at


def _scalar(text: str, number: int):
    t = text.strip()
    if t[:1] == '"':
        if len(t) < 2 or not re.fullmatch(r'"(?:[^"\\]|\\.)*"', t):
            raise ValueError(f"line {number}: no end of {t!r}")
        unescaped = lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uxU" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1])
        return re.sub(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|U[0-9a-fA-F]{8}|.)", unescaped, t[1:-1])
    if t[:1] == "'":
        if not re.fullmatch(r"'(?:[^']|'')*'", t):
            raise ValueError(f"line {number}: no end of {t!r}")
        return t[1:-1].replace("''", "'")
    if t[:1] in tuple("&*!|>%@`") or (t[:1] in ("?", "-") and t[1:2] in ("", " ")):
        raise ValueError(f"line {number}: {t!r} must be quoted")
    if t in ("true", "True", "TRUE"):
        return True
    if t in ("false", "False", "FALSE"):
        return False
    if t in ("", "~", "null", "Null", "NULL"):
        return None
    if re.search(r":(\s|\Z)", t):
        raise ValueError(f"line {number}: {t!r} must be quoted")
    return int(t) if _NUMBER.match(t) else t


def parse(text: str) -> dict:
    """The mapping that YAML settings hold; ValueError for anything else."""
    out = _Reader(text).document()
    if out is None:
        return {}
    if not isinstance(out, dict):
        raise ValueError("settings must be a mapping")
    return out


def _taken(raw: dict, name: str, kind: type, what: str):
    v = raw.get(name)
    if v is not None and (not isinstance(v, kind) or (kind is int and isinstance(v, bool))):
        raise ValueError(f"{name} must be {what}, not {v!r}")
    return v


def _switch(raw: dict, name: str) -> bool | None:
    v = raw.get(name)
    if isinstance(v, str) and v.lower() in ("yes", "on", "no", "off"):
        return v.lower() in ("yes", "on")
    return _taken(raw, name, bool, "true or false")


def _text(raw: dict, name: str) -> str:
    v = raw.get(name)
    if isinstance(v, (dict, list)):
        raise ValueError(f"{name} must be text, not {v!r}")
    return "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def _absolute(path: str) -> bool:
    return path.startswith("/") or (len(path) > 2 and path[1] == ":" and path[2] in "/\\") or path.startswith("\\\\")


def load(text: str) -> Config:
    """Settings from YAML text, defaults filled in, slashes of destinations normalised, checked."""
    raw = parse(text)
    workers, exclude, sources = _taken(raw, "workers", int, "a number"), _taken(raw, "exclude", list, "a list") or [], _taken(raw, "sources", list, "a list") or []
    for each in exclude:
        if not isinstance(each, (str, int)):
            raise ValueError(f"exclude must list patterns, not {each!r}")
    for each in sources:
        if not isinstance(each, dict):
            raise ValueError(f"sources must list src and dest, not {each!r}")
    pair = _taken(raw, "bisync", dict, "a mapping")
    c = Config(
        target_root=_text(raw, "target_root"), workers=WORKERS if workers is None else workers,
        verify=_switch(raw, "verify"), verify_small_files=_switch(raw, "verify_small_files"), metadata_fast_skip=_switch(raw, "metadata_fast_skip"),
        sources=[Source(_text(s, "src"), _text(s, "dest").replace("\\", "/")) for s in sources],
        exclude=[str(e) for e in exclude], mode=_text(raw, "mode"),
        bisync=None if pair is None else Pair(_text(pair, "left"), _text(pair, "right"), _text(pair, "conflict")),
    )
    for s in c.sources:
        s.dest = posixpath.normpath(s.dest) if s.dest else s.dest
    if not c.workers:
        c.workers = WORKERS
    check(c)
    return c


def check(c: Config) -> None:
    if not c.target_root:
        raise ValueError("target_root is required")
    if not _absolute(c.target_root):
        raise ValueError("target_root must be absolute")
    if not c.sources:
        raise ValueError("at least one source is required")
    for s in c.sources:
        if not _absolute(s.src):
            raise ValueError(f"src must be absolute: {s.src!r}")
        if not s.dest or s.dest == ".":
            raise ValueError("dest is required")
        if _absolute(s.dest) or ".." in s.dest.split("/"):
            raise ValueError(f"dest must be relative and stay below the target: {s.dest!r}")
    if c.workers < 1:
        raise ValueError("workers must be at least 1")

"""A reader for relaxed JSON documents: bare names and words, comments, commas left out between lines."""

from __future__ import annotations

import json
import re

_SKIP = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/|#[^\n]*)*", re.S)
_NAME = re.compile(r"[^\s:,{}\[\]\"']+")
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?$")
MAX_DEPTH = 64


class DocumentError(ValueError):
    pass


class _Reader:
    def __init__(self, text: str):
        self.s, self.at = text, 0

    def skip(self, commas: bool = False) -> str:
        self.at = _SKIP.match(self.s, self.at).end()
        while commas and self.s[self.at : self.at + 1] == ",":
            self.at = _SKIP.match(self.s, self.at + 1).end()
        return self.s[self.at : self.at + 1]

    def value(self, depth: int = 0):
        if depth > MAX_DEPTH:
            raise DocumentError("nested too deeply")
        c = self.skip()
        if c == "{":
            self.at += 1
            return self.members("}", depth)
        if c == "[":
            self.at += 1
            out = []
            while self.skip(commas=True) != "]":
                if not self.s[self.at : self.at + 1]:
                    raise DocumentError("a list without an end")
                out.append(self.value(depth + 1))
            self.at += 1
            return out
        if c in "\"'" and c:
            return self.text()
        end = re.compile(r"[,\n\]}]|//|/\*").search(self.s, self.at)
        word = self.s[self.at : end.start() if end else len(self.s)].strip()
        self.at += len(word) if word else 0
        if not word:
            raise DocumentError(f"a value is missing at {self.at}")
        if word in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[word]
        if _NUMBER.match(word):
            return json.loads(word)
        return word

    def text(self) -> str:
        s = self.s
        if s.startswith("'''", self.at):
            end = s.index("'''", self.at + 3)
            body, self.at = s[self.at + 3 : end], end + 3
            return body.strip("\n")
        quote, i = s[self.at], self.at + 1
        while i < len(s) and s[i] != quote:
            i += 2 if s[i] == "\\" else 1
        if i >= len(s):
            raise DocumentError("a text without an end")
        raw, self.at = s[self.at + 1 : i], i + 1
        if quote == "'":
            raw = raw.replace('\\"', '"').replace('"', '\\"').replace("\\'", "'")
        return json.loads(f'"{raw}"')

    def members(self, close: str, depth: int) -> dict:
        out = {}
        while (c := self.skip(commas=True)) != close:
            if not c:
                if close:
                    raise DocumentError("an object without an end")
                break
            if c in "\"'":
                name = self.text()
            else:
                m = _NAME.match(self.s, self.at)
                if not m:
                    raise DocumentError(f"a name is missing at {self.at}")
                name, self.at = m[0], m.end()
            if self.skip() != ":":
                raise DocumentError(f"':' is missing after {name}")
            self.at += 1
            if name in out:
                raise DocumentError(f"{name} comes twice")
            out[name] = self.value(depth + 1)
        self.at += 1
        return out


def read(text: str):
    """The document's value; members without braces are an object."""
    r = _Reader(text)
    if r.skip() in ("{", "["):
        out = r.value()
        if r.skip():
            raise DocumentError(f"something follows the document at {r.at}")
        return out
    return r.members("", 0)

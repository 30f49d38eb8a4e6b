"""Reading source code: blocks, balanced delimiters and documented symbols.

The scanners are line- or sign-wise state machines, which column expressions
can't hold; they run as Arrow-batched functions over whole files. Blocks and
symbols come back as arrays of structs, to be exploded in the JVM.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Keywords that open a block, in the order they are tried, with the kind they give.
WRITE_PATH = {
    "rust": (("fn ", "function"), ("struct ", "struct"), ("enum ", "enum"), ("trait ", "trait"), ("impl ", "impl")),
    "python": (("def ", "function"), ("class ", "class")),
    "javascript": (("function ", "function"), ("class ", "class")),
    "typescript": (("function ", "function"), ("class ", "class")),
    "go": (("func ", "function"), ("type ", "type")),
}
INDENTED = ("python",)

BLOCK = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("content_hash", T.StringType()),
    ]
)


def code_lines(code: str) -> list[str]:
    """Lines without their ends; a last line feed opens no further line."""
    lines = [line.removesuffix("\r") for line in code.split("\n")]
    return lines[:-1] if lines and lines[-1] == "" else lines


def declared(line: str, keyword: str) -> str | None:
    """The identifier after the first occurrence of a keyword."""
    _, found, rest = line.partition(keyword)
    name = re.match(r"\w*", rest.strip())[0] if found else ""
    return name or None


def braces_end(lines: list[str], start: int) -> int:
    """Index of the line that closes the first brace opened from ``start`` on, else the last."""
    depth, opened = 0, False
    for at in range(start, len(lines)):
        opened = opened or "{" in lines[at]
        depth += lines[at].count("{") - lines[at].count("}")
        if opened and depth <= 0:
            return at
    return len(lines) - 1


def indent_of(line: str) -> int:
    return len(line) - len(line.lstrip(" \t"))


def indent_end(lines: list[str], start: int) -> int:
    """Index of the last line indented deeper than ``start`` before one that isn't; blank lines don't count."""
    end = start
    for at in range(start + 1, len(lines)):
        if lines[at].strip():
            if indent_of(lines[at]) <= indent_of(lines[start]):
                break
            end = at
    return end


def find_blocks(code: str, language: str, general: bool = False) -> list[tuple]:
    """(kind, name, start_line, end_line, source, content_hash) of top-level blocks; what lies in a block is passed over.

    ``general`` is the reader of the embedding worker: Rust and Python by name or
    extension, a Python keyword only at the start of a line or after a blank, and
    ``function`` in any language.
    """
    if general:
        language = {"rs": "rust", "py": "python"}.get(language, language)
        rules = (WRITE_PATH[language] if language in ("rust", "python") else ()) + (("function ", "function"),)
    else:
        rules = WRITE_PATH.get(language, ())
    lines, found, at = code_lines(code), [], 0
    while at < len(lines):
        line = lines[at].strip()
        for keyword, kind in rules:
            indented = language in INDENTED and keyword != "function "
            if general and indented and not (line.startswith(keyword) or f" {keyword}" in line):
                continue
            name = declared(line, keyword)
            if name:
                end = indent_end(lines, at) if indented else braces_end(lines, at)
                source = "\n".join(lines[at : end + 1])
                found.append((kind, name, at + 1, end + 1, source, hashlib.sha256(source.encode()).hexdigest()))
                at = end
                break
        at += 1
    return found


@pandas_udf(T.ArrayType(BLOCK))
def code_blocks(code: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([find_blocks(c or "", lang or "") for c, lang in zip(code, language)])


@pandas_udf(T.ArrayType(BLOCK))
def code_blocks_general(code: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([find_blocks(c or "", lang or "", general=True) for c, lang in zip(code, language)])


#: What is read as one piece: comments, strings and single delimiters.
_PIECE = re.compile(r"//[^\n]*|/\*|#[^\n]*|[\"'()\[\]{}]")
_CLOSES = {")": "(", "]": "[", "}": "{"}


def syntax_error(code: str, language: str) -> str | None:
    """What is wrong with delimiters, strings and comments (or with JSON), null if nothing."""
    if language == "json":
        try:
            json.loads(code, parse_constant=_refuse)
        except ValueError as error:
            return f"JSON syntax error: {error}"
        return None
    place = lambda i: f"{code.count(chr(10), 0, i) + 1}:{i - code.rfind(chr(10), 0, i)}"
    line = lambda i: code.count("\n", 0, i) + 1
    open_, at = [], 0
    while found := _PIECE.search(code, at):
        start, piece = found.start(), found[0]
        at = found.end()
        if piece[0] == "#" and language != "python":
            at = start + 1
        elif piece == "/*":
            end = code.find("*/", at)
            if end < 0:
                return f"Unclosed block comment at line {line(start)}"
            at = end + 2
        elif piece in "\"'":
            while True:
                if at >= len(code) or (code[at] == "\n" and language != "python"):
                    return f"Unclosed string literal at line {line(start)}"
                if code[at] == piece:
                    at += 1
                    break
                at += 2 if code[at] == "\\" and at + 1 < len(code) else 1
        elif piece in "([{":
            open_.append((piece, start))
        elif piece in _CLOSES:
            if not open_:
                return f"Unexpected closing '{piece}' at line {place(start)}"
            other, other_at = open_.pop()
            if other != _CLOSES[piece]:
                return f"Mismatched closing '{piece}' at line {place(start)} for '{other}' from line {place(other_at)}"
    return f"Unclosed delimiter '{open_[-1][0]}' opened at line {place(open_[-1][1])}" if open_ else None


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON value")


@pandas_udf(T.StringType())
def syntax_problem(code: pd.Series, language: pd.Series) -> pd.Series:
    """Null where the code is well formed."""
    return pd.Series([syntax_error(c or "", lang or "") for c, lang in zip(code, language)], dtype=object)


SYMBOL = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("doc_summary", T.StringType()),
    ]
)

# Fixed value: how a doc comment names the id of its item.
_ID = re.compile(r"@id:\s*([0-9a-fA-F-]{36})")
#: Words between ``pub`` and the word that says what is declared, and the kinds those words give.
_QUALIFIERS = frozenset(("async", "const", "unsafe", "extern"))
_KINDS = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait"}
#: Rust source as a sequence of pieces; a gap is an empty line.
_RUST = re.compile(
    r"""(?P<doc>///[^\n]*)|(?P<note>//[^\n]*)|(?P<comment>/\*)|(?P<raw>\br(?P<hashes>\#*)")|(?P<text>"(?:[^"\\]|\\.)*"?)|(?P<sign>'(?:\\[^\n]+?|[^'\\\n])')"""
    r"""|(?P<attribute>\#!?\[)|(?P<gap>\n[ \t\r]*(?=\n))|(?P<word>\w+)|(?P<arrow>[-=]>)|(?P<mark>[^\s\w])""",
    re.S | re.X,
)
_OPENS = {"(": ")", "[": "]", "{": "}", "<": ">", "#[": "]", "#![": "]"}


@dataclass(frozen=True)
class _Piece:
    kind: str
    text: str
    start: int
    line: int
    leads: bool  # nothing but blanks before it in its line


def _pieces(source: str) -> list[_Piece]:
    """The pieces of a source; strings and comments are one each, so what they hold is never code."""
    out, at, line, counted, last = [], 0, 1, 0, 0
    while found := _RUST.search(source, at):
        start, at = found.span()
        if found.lastgroup == "comment" or found["raw"]:
            close = "*/" if not found["raw"] else '"' + found["hashes"]
            end = source.find(close, at)
            at = len(source) if end < 0 else end + len(close)
        line, counted = line + source.count("\n", counted, start), start
        kind = "raw" if found["raw"] else found.lastgroup
        out.append(_Piece(kind, found[0], start, line, not out or source.find("\n", last, start) >= 0))
        last = at
    return out


class _Symbols:
    """Reads items off the pieces of one source, with the doc comment and attributes before each."""

    def __init__(self, source: str):
        self.source, self.pieces = source, _pieces(source)

    def text(self, at: int) -> str:
        own = self.pieces[at] if at < len(self.pieces) else None
        return own.text if own and own.kind in ("word", "mark", "attribute") else ""

    def past(self, at: int) -> int:
        """The place after the bracket that closes the one at ``at``; brackets of other sorts nest."""
        close, depth = _OPENS[self.text(at)], 0
        sorts = {o for o, c in _OPENS.items() if c == close}
        while at < len(self.pieces):
            depth += (self.text(at) in sorts) - (self.text(at) == close)
            at += 1
            if depth == 0:
                break
        return at

    def item(self, at: int) -> tuple[str, str] | None:
        """(kind, name) of the public item or impl block that begins at a piece."""
        if self.text(at) == "pub":
            at += 1
            if self.text(at) == "(":
                at = self.past(at)
            while self.text(at) in _QUALIFIERS or (at < len(self.pieces) and self.pieces[at].kind == "text"):
                at += 1
            kind, name = _KINDS.get(self.text(at)), self.text(at + 1)
            return (kind, name) if kind and name.isidentifier() else None
        at += self.text(at) == "unsafe"
        if self.text(at) != "impl":
            return None
        at += 1
        if self.text(at) == "<":
            at = self.past(at)
        target = at
        while at < len(self.pieces) and self.text(at) not in ("{", ";", "where"):
            if self.text(at) == "<":
                at = self.past(at)
                continue
            at += 1
            if self.text(at - 1) == "for" and self.text(at) != "<":
                target = at
        body = next((self.text(i) for i in range(at, len(self.pieces)) if self.text(i) in ("{", ";")), "")
        if body != "{" or target >= at:
            return None
        return "impl_block", re.compile(r"[^<\s{]*").match(self.source, self.pieces[target].start)[0]

    def found(self) -> Iterator[tuple]:
        docs: list[str] = []
        attributes = testing = False
        at = 0
        while at < len(self.pieces):
            own, text = self.pieces[at], self.text(at)
            at += 1
            if own.kind == "doc":
                docs = [own.text] if attributes else [*docs, own.text]
                attributes = False
            elif own.kind == "note":
                continue
            elif own.kind == "attribute":
                end = self.past(at - 1)
                testing = testing or "".join(p.text for p in self.pieces[at : end - 1]) == "cfg(test)"
                attributes, at = True, end
            elif own.kind == "gap":
                docs, attributes = [], False
            elif testing and (text == "mod" or (text == "pub" and self.text(at) == "mod")):
                while at < len(self.pieces) and self.text(at) not in ("{", ";"):
                    at += 1
                at = self.past(at) if self.text(at) == "{" else at
                docs, attributes, testing = [], False, False
            else:
                if own.leads and text in ("pub", "unsafe", "impl") and (item := self.item(at - 1)):
                    yield (*item, own.line, *_told(docs))
                docs, attributes, testing = [], False, False


def _told(docs: list[str]) -> tuple[str | None, str | None]:
    """The id that doc lines name, and the first of them that says something else."""
    said = [d[3:].strip() for d in docs]
    summary = next((s for s in said if s and not s.startswith("@id:")), None)
    for found in filter(None, map(_ID.search, said)):
        try:
            return str(uuid.UUID(found[1])), summary
        except ValueError:
            continue
    return None, summary


def find_symbols(source: str) -> list[tuple]:
    """(kind, name, line, id, doc_summary) of public items and impl blocks that begin a line, outside comments, strings and test modules."""
    return list(_Symbols(source).found())


@pandas_udf(T.ArrayType(SYMBOL))
def symbols_of(source: pd.Series) -> pd.Series:
    return source.map(lambda s: find_symbols(s or ""))

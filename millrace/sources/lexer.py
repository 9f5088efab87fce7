"""Tokens of script (JavaScript, TypeScript) and Java sources, with matched brackets."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    """``kind``: word, number, string, template, regex or mark; ``start`` and ``end`` are character offsets."""

    kind: str
    text: str
    line: int
    start: int
    end: int


_SKIP = re.compile(r"(?:\s|//[^\n]*|/\*(?:.*?\*/|.*))+", re.S)
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?", re.S)
_TEXT_BLOCK = re.compile(r'"""(?:[^\\]|\\.)*?"""', re.S)
_WORD = re.compile(r"#?[^\W\d][\w$]*|#?\$[\w$]*")
_NUMBER = re.compile(r"\d[\w.]*(?:(?<=[eE])[+-]\d+)?|\.\d[\w]*")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_MARK = re.compile(r"=>|\.\.\.|\?\.(?!\d)|::|.", re.S)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
#: After these words a slash begins a regular expression.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"}
_OPEN = {"(": ")", "[": "]", "{": "}", "${": "}"}


def tokens(source: str, script: bool) -> list[Token]:
    """All tokens but white space and comments. A template is cut at its substitutions,
    whose own tokens stand between ``${`` and ``}``; unclosed literals end with their line."""
    out: list[Token] = []
    templates: list[int] = []  # for each open substitution, the braces open in it
    at, line, size = 0, 1, len(source)

    def add(kind: str, end: int) -> None:
        nonlocal at, line
        text = source[at:end]
        out.append(Token(kind, text, line, at, end))
        line += text.count("\n")
        at = end

    def template(opening: bool) -> None:
        """The part of a template up to its next substitution or its end."""
        end = _TEMPLATE.match(source, at + opening).end()
        add("template", min(size, end + (source[end : end + 1] == "`")))
        if source.startswith("${", at):
            add("mark", at + 2)
            templates.append(0)

    while at < size:
        gap = _SKIP.match(source, at)
        if gap:
            line += source.count("\n", at, gap.end())
            at = gap.end()
            continue
        c = source[at]
        if c == '"' and not script and (block := _TEXT_BLOCK.match(source, at)):
            add("string", block.end())
        elif c in "\"'":
            add("string", _STRING.match(source, at).end())
        elif c == "`" and script:
            template(True)
        elif word := _WORD.match(source, at):
            add("word", word.end())
        elif number := _NUMBER.match(source, at):
            add("number", number.end())
        elif c == "/" and script and _expression_begins(out) and (found := _REGEX.match(source, at)):
            add("regex", found.end())
        else:
            mark = _MARK.match(source, at)
            if templates and c == "{":
                templates[-1] += 1
            if templates and c == "}":
                if not templates[-1]:
                    templates.pop()
                    add("mark", at + 1)
                    template(False)
                    continue
                templates[-1] -= 1
            add("mark", mark.end())
    return out


def _expression_begins(before: list[Token]) -> bool:
    if not before:
        return True
    last = before[-1]
    if last.kind == "mark":
        return last.text not in (")", "]", "}")
    return last.kind == "word" and last.text in _BEFORE_REGEX


def brackets(found: list[Token]) -> dict[int, int]:
    """Index of the bracket that closes each opening one; the last token's for those never closed."""
    pairs: dict[int, int] = {}
    opened: list[int] = []
    for i, t in enumerate(found):
        if t.kind == "mark":
            if t.text in _OPEN:
                opened.append(i)
            elif t.text in (")", "]", "}"):
                for k in range(len(opened) - 1, -1, -1):
                    if _OPEN[found[opened[k]].text] == t.text:
                        pairs[opened[k]] = i
                        for lost in opened[k + 1 :]:
                            pairs[lost] = i
                        del opened[k:]
                        break
    for i in opened:
        pairs[i] = len(found) - 1
    return pairs

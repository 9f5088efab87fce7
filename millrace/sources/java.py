"""Declarations of Java files."""

from __future__ import annotations

from collections.abc import Iterator

from . import finding as rows
from .lexer import brackets, tokens

_TYPES = {"class", "interface", "enum"}
_MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "strictfp", "transient", "volatile", "default", "sealed"}
_NOT_CALLED = {"if", "for", "while", "switch", "catch", "synchronized", "return", "throw", "assert", "try", "new", "super", "this", "case", "else", "do", "instanceof", "yield"}


class Java:
    """One file's tokens and what is read of them: the package, imports and top-level
    classes, interfaces and enums; methods and constructors of classes and interfaces.
    Nested types, records and annotation types are skipped with all that is in them."""

    def __init__(self, source: str, module: str) -> None:
        self.source, self.module = source, module
        self.found = tokens(source, script=False)
        self.pairs = brackets(self.found)

    def mark(self, i: int) -> str:
        return self.found[i].text if 0 <= i < len(self.found) and self.found[i].kind == "mark" else ""

    def word(self, i: int) -> str:
        return self.found[i].text if 0 <= i < len(self.found) and self.found[i].kind == "word" else ""

    def text(self, i: int, j: int) -> str:
        return self.source[self.found[i].start : self.found[j].end] if i <= j else ""

    def lines(self, i: int, j: int) -> tuple[int, int]:
        return self.found[i].line, self.found[j].line

    def dotted(self, i: int) -> int:
        """Index after the dotted name at i."""
        i += 1
        while self.mark(i) == "." and self.word(i + 1):
            i += 2
        return i

    def angles(self, i: int) -> int:
        """Index after the type parameters or arguments at i, if there are any."""
        if self.mark(i) != "<":
            return i
        depth, k = 0, i
        while k < len(self.found):
            depth += (self.mark(k) == "<") - (self.mark(k) == ">")
            k += 1
            if not depth:
                break
        return k

    def modifiers(self, i: int) -> tuple[int, str]:
        """(index after modifiers and annotations, visibility)."""
        seen = set()
        while True:
            if self.mark(i) == "@" and self.word(i + 1) != "interface":
                i = self.dotted(i + 1)
                i = self.pairs[i] + 1 if self.mark(i) == "(" else i
            elif self.word(i) in _MODIFIERS:
                seen.add(self.word(i))
                i += 1
            elif self.word(i) == "non" and self.mark(i + 1) == "-":
                i += 3
            else:
                return i, next((v for v in ("public", "private", "protected") if v in seen), "package-private")

    def findings(self) -> Iterator[tuple]:
        package, i, stop = None, 0, len(self.found)
        imports: list[tuple[str, str, bool]] = []
        types: list[tuple[int, int, str]] = []
        while i < stop:
            start = i
            i, visibility = self.modifiers(i)
            if self.word(i) == "package" and package is None and self.word(i + 1):
                end = self.dotted(i + 1)
                package = self.text(i + 1, end - 1)
                yield rows.symbol(package, package, "namespace", "public", self.lines(start, min(end, stop - 1)))
                i = end + 1
            elif self.word(i) == "import":
                static = self.word(i + 1) == "static"
                end = self.dotted(i + 1 + static)
                name = self.text(i + 1 + static, end - 1)
                while end < stop and self.mark(end) != ";":
                    end += 1
                imports.append((self.text(i, min(end, stop - 1)), name, static))
                i = end + 1
            elif self.word(i) in _TYPES and self.word(i + 1):
                types.append((start, i, visibility))
                i = self.skip(i) + 1
            else:
                i = self.skip(i) + 1
        for statement, name, static in imports:
            yield rows.imported(statement, name, [], kind="static_import" if static else "import")
            yield rows.relation("imports", package or self.module, name)
        for start, at, visibility in types:
            yield from self.type_(start, at, visibility, package)

    def skip(self, i: int) -> int:
        """Last token of the member or type at i: its semicolon or closing brace."""
        while i < len(self.found) - 1:
            if self.mark(i) == "{":
                end = self.pairs[i]
                if self.mark(end + 1) not in (",", ";", ".", ")"):
                    return end
                i = end  # the braces of an array or an anonymous class in a field
            elif self.mark(i) in ("(", "["):
                i = self.pairs[i]
            elif self.mark(i) == ";":
                return i
            i += 1
        return i

    def names(self, i: int, stop: int) -> Iterator[str]:
        """Simple and generic type names of a list; dotted ones count if they have arguments."""
        while i < stop:
            after = self.dotted(i)
            end = self.angles(after)
            if self.word(i) and (after == i + 1 or end > after):
                yield self.text(i, end - 1)
            while end < stop and self.mark(end) != ",":
                end = max(end + 1, self.angles(end))
            i = end + 1

    def type_(self, start: int, i: int, visibility: str, package: str | None) -> Iterator[tuple]:
        kind, name = self.word(i), self.word(i + 1)
        named = f"{package}.{name}" if package else name
        at = self.angles(i + 2)
        clauses: dict[str, list[str]] = {}
        while at < len(self.found) and self.mark(at) != "{":
            clause, end = self.word(at), at + 1
            while end < len(self.found) and self.mark(end) != "{" and self.word(end) not in ("implements", "permits", "extends"):
                end = max(end + 1, self.angles(end))
            clauses[clause] = list(self.names(at + 1, end))
            at = end
        end = self.pairs.get(at, len(self.found) - 1)
        yield rows.symbol(name, named, kind, visibility, self.lines(start, end))
        for base in clauses.get("extends", []):
            yield rows.relation("extends", named, base)
        for base in clauses.get("implements", []) if kind != "interface" else []:
            yield rows.relation("implements", named, base)
        if package:
            yield rows.relation("belongs_to", named, package)
        if kind != "enum":
            yield from self.members(at + 1, end, named)

    def members(self, i: int, stop: int, owner: str) -> Iterator[tuple]:
        while i < stop:
            start = i
            i, visibility = self.modifiers(i)
            if self.mark(i) in (";", ""):
                if self.mark(i) == ";":
                    i += 1
                    continue
            if self.word(i) in _TYPES or self.mark(i) == "@" or self.word(i) == "record" and self.word(i + 1) and self.mark(self.angles(i + 2)) == "(":
                while i < stop and self.mark(i) != "{":
                    i = self.pairs[i] + 1 if self.mark(i) == "(" else i + 1
                i = self.pairs.get(i, stop) + 1
                continue
            first = self.angles(i)
            at = first
            while at < stop and (self.word(at) or self.mark(at) in (".", "<", "[", "?", "@", "&")) and self.mark(at + 1) != "(":
                at = self.angles(at) if self.mark(at) == "<" else self.pairs[at] + 1 if self.mark(at) == "[" else at + 1
            if at < stop and self.word(at) and self.mark(at + 1) == "(":
                name, opens = self.word(at), at + 1
                closes = self.pairs[opens]
                end = closes + 1
                while end < stop and self.mark(end) not in ("{", ";"):
                    end = self.pairs[end] + 1 if self.mark(end) in ("(", "[") else end + 1
                last = min(self.pairs[end] if self.mark(end) == "{" else end, stop)
                parameters = self.text(opens, closes)
                yield rows.symbol(name, f"{owner}.{name}", "method", visibility, self.lines(start, last), f"{parameters} : {self.text(first, at - 1)}" if at > first else parameters, owner)
                yield rows.relation("belongs_to", f"{owner}.{name}", owner)
                if self.mark(end) == "{":
                    yield from self.calls(end, last, f"{owner}.{name}")
                i = last + 1
            else:
                i = self.skip(i) + 1

    def calls(self, opens: int, closes: int, caller: str) -> Iterator[tuple]:
        """Calls without a receiver or on ``this``, both of the own class's methods. Methods
        of anonymous and local classes in the block are not the caller's."""
        k = opens + 1
        while k < closes:
            if self.word(k) in _TYPES and self.word(k + 1) and self.mark(k - 1) != ".":
                while k < closes and self.mark(k) != "{":
                    k += 1
                k = self.pairs.get(k, k) + 1
                continue
            name = self.word(k)
            if name and name not in _NOT_CALLED and self.mark(k + 1) == "(" and self.mark(k - 1) not in ("@", "::") and self.word(k - 1) != "new":
                after = self.pairs[k + 1] + 1
                if self.word(after) == "throws":
                    while after < closes and self.mark(after) not in ("{", ";"):
                        after += 1
                if self.mark(after) == "{" and not self.created(k):
                    k = self.pairs[after] + 1
                    continue
                if self.mark(k - 1) != ".":
                    if not self.created(k):
                        yield rows.call(caller, name, True)
                elif self.word(k - 2) == "this" and self.mark(k - 3) != ".":
                    yield rows.call(caller, name, True)
            k += 1

    def created(self, k: int) -> bool:
        """Whether the dotted name that ends at k follows ``new``."""
        while self.mark(k - 1) == "." and self.word(k - 2):
            k -= 2
        return self.word(k - 1) == "new"


def java_findings(source: str, module: str) -> Iterator[tuple]:
    yield from Java(source, module).findings()

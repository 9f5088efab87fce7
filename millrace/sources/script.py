"""Declarations of JavaScript and TypeScript files."""

from __future__ import annotations

from collections.abc import Iterator

from . import finding as rows
from .lexer import Token, brackets, tokens

_NOT_CALLED = {
    "if", "for", "while", "switch", "catch", "with", "return", "typeof", "await", "delete", "void", "throw", "new", "in", "of", "instanceof", "case", "do", "else",
    "yield", "function", "super", "import", "this", "async",
}
#: A statement goes on after a token of these, or before one of these on the next line.
_OPEN_ENDED = set("=+-*/%&|^~!?:<>,.([{") | {"=>", "?.", "..."}
_GOES_ON = set("=+-*/%&|^?:<>,.([") | {"=>", "?."}
_MODIFIERS = {"static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "accessor", "declare", "abstract"}


class Script:
    """One file's tokens and what is read of them. ``typed``: TypeScript. Abstract classes,
    generators and ambient declarations are no symbols; neither are a class's fields."""

    def __init__(self, source: str, module: str, typed: bool) -> None:
        self.source, self.module, self.typed = source, module, typed
        self.found = tokens(source, script=True)
        self.pairs = brackets(self.found)

    # -- tokens

    def mark(self, i: int) -> str:
        return self.found[i].text if 0 <= i < len(self.found) and self.found[i].kind == "mark" else ""

    def word(self, i: int) -> str:
        return self.found[i].text if 0 <= i < len(self.found) and self.found[i].kind == "word" else ""

    def text(self, i: int, j: int) -> str:
        """Source of the tokens i to j, both included."""
        return self.source[self.found[i].start : self.found[j].end] if i <= j else ""

    def lines(self, i: int, j: int) -> tuple[int, int]:
        last: Token = self.found[j]
        return self.found[i].line, last.line + last.text.count("\n")

    def angles(self, i: int) -> int:
        """Index after type arguments that open at i; i itself if they do not close as such."""
        if self.mark(i) != "<":
            return i
        depth, k = 0, i
        while k < len(self.found):
            mark = self.mark(k)
            if mark == "<":
                depth += 1
            elif mark == ">":
                depth -= 1
                if not depth:
                    return k + 1
            elif mark in ("(", "[", "{"):
                k = self.pairs[k]
            elif mark in (";", ")", "]", "}"):
                return i
            k += 1
        return i

    def statement_end(self, i: int, stop: int) -> int:
        """Last token of the statement that begins at i: its semicolon, or where a line ends and nothing goes on."""
        k = i
        while k < stop:
            mark = self.mark(k)
            if mark == ";":
                return k
            if mark in ("(", "[", "{", "${"):
                k = self.pairs[k]
            nxt = k + 1
            if nxt >= stop:
                return k
            ends = self.lines(k, k)[1]
            if self.found[nxt].line > ends and self.mark(nxt) not in _GOES_ON and (self.mark(k) not in _OPEN_ENDED or self.mark(k) == "") and self.word(nxt) not in ("instanceof", "in", "as", "satisfies") and self.word(k) not in _NOT_CALLED - {"this", "super"}:
                return k
            k = nxt
        return stop - 1

    def type_end(self, i: int, stop: int, ends: set[str]) -> int:
        """Index of the first mark of ``ends`` after the type that begins at i."""
        k = i
        while k < stop:
            mark = self.mark(k)
            if mark in ends and not (mark == "{" and k == i):
                return k
            if mark in ("(", "[", "{"):
                k = self.pairs[k]
            elif mark == "<":
                k = max(k, self.angles(k) - 1)
            k += 1
        return stop

    # -- declarations

    def findings(self) -> Iterator[tuple]:
        yield from self.body(0, len(self.found), self.module)
        yield from self.imports()
        yield from self.exports()
        yield from self.requires()

    def body(self, i: int, stop: int, owner: str) -> Iterator[tuple]:
        """The statements of a file or namespace."""
        while i < stop:
            start = i
            while self.mark(i) == "@":  # a decorator
                i = self.after_decorator(i)
            if self.word(i) == "export":
                i += 1
                while self.mark(i) == "@":
                    i = self.after_decorator(i)
                start = i
                if self.word(i) == "default":
                    start = i = i + 1
                    if not (self.word(i) in ("class", "function", "async") and self.named_declaration(i)) and self.word(i) not in ("interface", "abstract"):
                        i = self.statement_end(i, stop) + 1
                        continue
            end = yield from self.declaration(start, i, stop, owner)
            i = max(end, i + 1)

    def named_declaration(self, i: int) -> bool:
        if self.word(i) == "async":
            i += 1
        return self.found[i + 1].kind == "word" and self.word(i + 1) not in ("extends", "implements") if i + 1 < len(self.found) else False

    def after_decorator(self, i: int) -> int:
        i += 2
        while self.mark(i) == ".":
            i += 2
        return self.pairs[i] + 1 if self.mark(i) == "(" else i

    def declaration(self, start: int, i: int, stop: int, owner: str) -> Iterator[tuple]:
        """Rows of the statement at i; returns the index after it. ``start``: its first token, a decorator perhaps."""
        word = self.word(i)
        if word == "class" and self.word(i + 1):
            return (yield from self.class_(start, i, stop, owner))
        if word == "function" or word == "async" and self.word(i + 1) == "function" and self.found[i + 1].line == self.found[i].line:
            at = i + (word == "async") + 1
            generator = self.mark(at) == "*"
            name = self.word(at + generator)
            opens = self.angles(at + generator + 1)
            if name and self.mark(opens) == "(":
                closes = self.pairs[opens]
                block = self.type_end(closes + 2, stop, {"{", ";"}) if self.mark(closes + 1) == ":" else closes + 1
                if self.mark(block) == "{":
                    end = self.pairs[block]
                    if not generator:
                        yield rows.symbol(name, f"{owner}.{name}", "function", self.hidden(name), self.lines(i, end), self.text(opens, closes))
                        yield from self.calls(block, end, f"{owner}.{name}")
                    return end + 1
        if word in ("const", "let", "var") and not (self.typed and self.word(i + 1) == "enum"):
            return (yield from self.variables(i, stop, owner))
        if self.typed:
            enum = i + (word == "const")
            if self.word(enum) == "enum" and self.word(enum + 1) and self.mark(enum + 2) == "{":
                end = self.pairs[enum + 2]
                yield rows.symbol(self.word(enum + 1), f"{owner}.{self.word(enum + 1)}", "enum", "public", self.lines(i, end))
                return end + 1
            if word == "interface" and self.word(i + 1):
                return (yield from self.interface(i, stop, owner))
            if word in ("namespace", "module") and self.word(i + 1):
                at = i + 2
                while self.mark(at) == ".":
                    at += 2
                if self.mark(at) == "{":
                    end, name = self.pairs[at], self.text(i + 1, at - 1)
                    yield rows.symbol(name, f"{owner}.{name}", "namespace", "public", self.lines(i, end))
                    yield from self.body(at + 1, end, f"{owner}.{name}")
                    return end + 1
            if word in ("declare", "abstract"):
                block = self.type_end(i + 1, self.statement_end(i, stop) + 1, {"{"})
                return (self.pairs[block] if self.mark(block) == "{" else self.statement_end(i, stop)) + 1
        if self.mark(i) == "{":
            return self.pairs[i] + 1
        if word in ("if", "for", "while", "switch", "try", "do", "else", "finally", "catch", "with"):  # its parts follow as statements; none is a declaration of the file
            at = i + 1 + (self.word(i + 1) == "await")
            at = self.pairs[at] + 1 if self.mark(at) == "(" else at
            if self.mark(at) == "{":
                return self.pairs[at] + 1
            return self.statement_end(at, stop) + 1 if at < stop and self.word(at) not in ("if", "for", "while") else at
        return self.statement_end(i, stop) + 1

    def hidden(self, name: str) -> str:
        return "private" if name.startswith("#") else "public"

    def names(self, i: int, stop: int, dotted: bool, arguments: bool) -> Iterator[str]:
        """The names of a list of types: dotted ones or not, with their arguments or without."""
        while i < stop:
            end = self.type_end(i, stop, {","})
            after = i + 1
            while self.mark(after) == "." and self.word(after + 1):
                after += 2
            closed = self.angles(after)
            if self.word(i) and closed == end and (dotted or after == i + 1):
                yield self.text(i, (closed if arguments else after) - 1)
            i = end + 1

    def class_(self, start: int, i: int, stop: int, owner: str) -> Iterator[tuple]:
        name = self.word(i + 1)
        named = f"{owner}.{name}"
        at = self.angles(i + 2)
        bases: list[str] = []
        met: list[str] = []
        while at < stop and self.mark(at) != "{":
            clause = self.word(at)
            end = at + 1
            while end < stop and self.mark(end) != "{" and self.word(end) != "implements":
                end = self.pairs[end] + 1 if self.mark(end) in ("(", "[") else max(end + 1, self.angles(end))
            if clause == "extends":
                bases = list(self.names(at + 1, end, dotted=True, arguments=False))
            elif clause == "implements" and self.typed:
                met = list(self.names(at + 1, end, dotted=False, arguments=True))
            at = end
        end = self.pairs.get(at, stop - 1)
        yield rows.symbol(name, named, "class", self.hidden(name), self.lines(start, end), f"extends {', '.join(bases)}" if bases else None)
        for base in bases:
            yield rows.relation("extends", named, base)
        for base in met:
            yield rows.relation("implements", named, base)
        yield rows.relation("belongs_to", named, owner)
        yield from self.methods(at + 1, end, named)
        return end + 1

    def methods(self, i: int, stop: int, owner: str) -> Iterator[tuple]:
        while i < stop:
            if self.mark(i) == ";":
                i += 1
                continue
            start = i
            while self.mark(i) == "@":
                i = self.after_decorator(i)
            if self.typed:
                start = i
            access = "public"
            while self.word(i) in _MODIFIERS and self.mark(i + 1) not in ("(", "=", ";", "?", "!", ":", "<", "}"):
                access = self.word(i) if self.word(i) in ("public", "private", "protected") and self.typed else access
                i += 1
            if self.word(i) == "static" and self.mark(i + 1) == "{":
                i = self.pairs[i + 1] + 1
                continue
            i += self.mark(i) == "*"
            last = self.pairs[i] if self.mark(i) == "[" else i
            opens = self.angles(last + 1 + (self.mark(last + 1) == "?"))
            if self.mark(opens) == "(" and i < stop:
                closes = self.pairs[opens]
                block = self.type_end(closes + 2, stop, {"{", ";", "}"}) if self.mark(closes + 1) == ":" else closes + 1
                if self.mark(block) == "{":
                    name, end = self.text(i, last), self.pairs[block]
                    yield rows.symbol(name, f"{owner}.{name}", "method", "private" if name.startswith("#") and access == "public" else access, self.lines(start, end), self.text(opens, closes), owner)
                    yield rows.relation("belongs_to", f"{owner}.{name}", owner)
                    yield from self.calls(block, end, f"{owner}.{name}")
                    i = end + 1
                    continue
            i = max(i, self.statement_end(i, stop)) + 1

    def interface(self, i: int, stop: int, owner: str) -> Iterator[tuple]:
        name = self.word(i + 1)
        at = self.angles(i + 2)
        bases: list[str] = []
        if self.word(at) == "extends":
            end = self.type_end(at + 1, stop, {"{"})
            bases = list(self.names(at + 1, end, dotted=False, arguments=True))
            at = end
        end = self.pairs.get(at, at)
        yield rows.symbol(name, f"{owner}.{name}", "interface", "public", self.lines(i, min(end, len(self.found) - 1)), f"extends {', '.join(bases)}" if bases else None)
        for base in bases:
            yield rows.relation("extends", f"{owner}.{name}", base)
        return end + 1

    def variables(self, i: int, stop: int, owner: str) -> Iterator[tuple]:
        end = self.statement_end(i, stop)
        k, last = i + 1, end + (self.mark(end) != ";")
        while k < last:
            name = self.word(k)
            at = k + 1 if name else self.pairs.get(k, k) + 1
            at += self.mark(at) == "!"
            if self.mark(at) == ":":
                at = self.type_end(at + 1, last, {"=", ","})
            value = at + 1 if self.mark(at) == "=" else None
            after = at if value is None else self.value_end(value, last)
            if name:
                signature = None if value is None else self.function_value(value, after)
                yield rows.symbol(name, f"{owner}.{name}", "variable" if signature is None else "function", self.hidden(name), self.lines(i, end), signature)
            k = max(after, k) + 1
        return end + 1

    def value_end(self, i: int, stop: int) -> int:
        """Index of the comma after the expression at i, or ``stop``."""
        k = i
        while k < stop and self.mark(k) != ",":
            if self.mark(k) in ("(", "[", "{", "${"):
                k = self.pairs[k]
            elif self.typed and self.mark(k) == "<" and self.mark(self.angles(k)) == "(":
                k = self.angles(k) - 1
            k += 1
        return k

    def function_value(self, i: int, stop: int) -> str | None:
        """Parameters of an expression that is an arrow function or a function, else None;
        empty for a single parameter without brackets."""
        if self.word(i) == "async" and self.mark(i + 1) != "=>" and i + 1 < stop:
            i += 1
        if self.word(i) == "function":
            at = self.angles(i + 1 + bool(self.word(i + 1)))
            if self.mark(at) == "(":
                block = self.type_end(self.pairs[at] + 2, stop, {"{"}) if self.mark(self.pairs[at] + 1) == ":" else self.pairs[at] + 1
                if self.pairs.get(block) == stop - 1:
                    return self.text(at, self.pairs[at])
            return None
        if self.word(i) and self.mark(i + 1) == "=>":
            return ""
        at = self.angles(i)
        return self.text(at, self.pairs[at]) if self.mark(at) == "(" and self.arrow(at, stop) else None

    def arrow(self, i: int, stop: int) -> int:
        """Index of the arrow after the parameters that open at i; 0 if none follows."""
        after = self.pairs[i] + 1
        if self.typed and self.mark(after) == ":":
            after = self.type_end(after + 1, stop, {"=>", ",", ";", ")", "]", "}", "=", "?"})
        return after if after < stop and self.mark(after) == "=>" else 0

    # -- calls and imports

    def nested(self, k: int, stop: int, functions: bool = True) -> int:
        """Index after the nested function, class or method that begins at k; 0 if none does."""
        word, mark = self.word(k), self.mark(k)
        behind = self.mark(k - 1)
        if behind in (".", "?."):
            return 0
        arrow = k + 1 if word and self.mark(k + 1) == "=>" else self.arrow(k, stop) if mark == "(" else 0
        if arrow:
            return self.pairs[arrow + 1] + 1 if self.mark(arrow + 1) == "{" else self.expression_end(arrow + 1, stop)
        if word == "function" and functions:
            at = k + 1
            if self.mark(at) == "*":
                return 0
            at = self.angles(at + bool(self.word(at)))
            if self.mark(at) == "(":
                block = self.type_end(self.pairs[at] + 2, stop, {"{"}) if self.mark(self.pairs[at] + 1) == ":" else self.pairs[at] + 1
                return self.pairs.get(block, block) + 1
        if word == "class" and mark == "":
            at = k + 1
            while at < stop and self.mark(at) != "{":
                at = self.pairs[at] + 1 if self.mark(at) in ("(", "[") else at + 1
            return self.pairs.get(at, at) + 1
        if word and word not in _NOT_CALLED and self.mark(k + 1) == "(" and self.mark(self.pairs[k + 1] + 1) == "{" and behind in ("{", ",", "*", "") and self.word(k - 1) in ("", "get", "set", "async"):
            return self.pairs[self.pairs[k + 1] + 1] + 1
        return 0

    def expression_end(self, i: int, stop: int) -> int:
        k = i
        while k < stop and self.mark(k) not in (",", ";", ")", "]", "}"):
            if self.mark(k) in ("(", "[", "{", "${"):
                k = self.pairs[k]
            ends = self.lines(k, k)[1]
            if k + 1 < stop and self.found[k + 1].line > ends and self.mark(k) not in _OPEN_ENDED and self.mark(k + 1) not in _GOES_ON:
                return k + 1
            k += 1
        return k

    def calls(self, opens: int, closes: int, caller: str) -> Iterator[tuple]:
        """Calls of plain names and of ``this`` in a block, without those in nested scopes."""
        k = opens + 1
        while k < closes:
            skip = self.nested(k, closes)
            if skip:
                k = max(skip, k + 1)
                continue
            name = self.word(k)
            if name and name not in _NOT_CALLED:
                at = k + 1 + (self.mark(k + 1) == "?." and self.mark(k + 2) == "(")
                if self.typed:
                    at = self.angles(at) if self.mark(self.angles(at)) == "(" else at
                if self.mark(at) == "(" or at < closes and self.found[at].kind == "template" and self.found[at].text.startswith("`"):
                    if self.mark(k - 1) not in (".", "?."):
                        if self.word(k - 1) not in ("new", "function") and not name.startswith("#"):
                            yield rows.call(caller, name, False)
                    elif self.word(k - 2) == "this" and self.mark(k - 3) not in (".", "?.") and self.word(k - 3) != "new":
                        yield rows.call(caller, name, True)
            k += 1

    def imports(self) -> Iterator[tuple]:
        k, stop = 0, len(self.found)
        while k < stop:
            skip = self.nested(k, stop, functions=self.statement_begins(k))
            if skip:
                k = max(skip, k + 1)
                continue
            if self.word(k) == "import" and self.mark(k + 1) not in ("(", ".") and self.mark(k - 1) != ".":
                end = k
                while end < stop and self.found[end].kind != "string" and self.mark(end) != ";":
                    end = self.pairs[end] + 1 if self.mark(end) in ("(", "{") else end + 1
                if end >= stop:
                    return
                target = self.found[end].text.strip("\"'") if self.found[end].kind == "string" else ""
                names = self.clause(k + 1, end)
                if self.word(end + 1) in ("with", "assert") and self.mark(end + 2) == "{":
                    end = self.pairs[end + 2]
                end += self.mark(end + 1) == ";"
                yield rows.imported(self.text(k, end), target, names, target.startswith("."))
                yield rows.relation("imports", self.module, target)
                k = end
            k += 1

    def clause(self, i: int, stop: int) -> list[str]:
        """Names that an import binds: those in braces, then the namespace, then the default."""
        inner: list[str] = []
        spaces: list[str] = []
        defaults: list[str] = []
        i += self.word(i) in ("type", "typeof") and self.mark(i + 1) != "," and self.word(i + 1) != "from" and i + 1 < stop
        while i < stop:
            if self.mark(i) == "{":
                inner += self.listed(i)
                i = self.pairs[i]
            elif self.mark(i) == "*":
                spaces.append(self.word(i + 2))
                i += 2
            elif self.word(i) == "from" and self.mark(i + 1) != ",":
                break
            elif self.word(i):
                defaults.append(self.word(i))
            i += 1
        return inner + spaces + defaults

    def listed(self, opens: int) -> list[str]:
        out, k, closes = [], opens + 1, self.pairs[opens]
        while k < closes:
            end = k
            while end < closes and self.mark(end) != ",":
                end += 1
            if end > k:
                out.append(self.text(k, end - 1))
            k = end + 1
        return out

    def statement_begins(self, k: int) -> bool:
        """Whether a function at k is a declaration: only those hide imports and requires."""
        return k == 0 or self.mark(k - 1) in (";", "}", "{") or self.word(k - 1) in ("export", "default", "async")

    def exports(self) -> Iterator[tuple]:
        k, stop = 0, len(self.found)
        while k < stop:
            skip = self.nested(k, stop, functions=self.statement_begins(k))
            if skip:
                k = max(skip, k + 1)
                continue
            if self.word(k) == "export" and self.mark(k - 1) != ".":
                if self.word(k + 1) == "default" and not (self.word(k + 2) in ("class", "function", "async") and self.named_declaration(k + 2)) and self.word(k + 2) not in ("interface", "abstract"):
                    end = self.statement_end(k + 2, stop)
                    last = end - (self.mark(end) == ";")
                    yield rows.imported(self.text(k, end), "default", [self.text(k + 2, last)], kind="export")
                    k = end
                else:
                    opens = k + 1 + (self.word(k + 1) == "type")
                    if self.mark(opens) == "{":
                        closes = self.pairs[opens]
                        source = self.found[closes + 2].text if self.word(closes + 1) == "from" and closes + 2 < stop else ""
                        for name in self.listed(opens):
                            yield rows.imported(name, source, [name], kind="export")
                        k = closes
            k += 1

    def requires(self) -> Iterator[tuple]:
        k, stop = 0, len(self.found)
        while k < stop:
            skip = self.nested(k, stop, functions=self.statement_begins(k))
            if skip:
                k = max(skip, k + 1)
                continue
            if self.word(k) == "require" and self.mark(k + 1) == "(" and self.mark(k - 1) not in (".", "?."):
                closes, at = self.pairs[k + 1], k + 2
                while at < closes:
                    if self.found[at].kind == "string" and self.mark(at - 1) in ("(", ",") and self.mark(at + 1) in (")", ","):
                        target = self.found[at].text.strip("\"'")
                        yield rows.imported(self.text(k, closes), target, [], target.startswith("."))
                        yield rows.relation("imports", self.module, target)
                        break
                    at = self.pairs[at] + 1 if self.mark(at) in ("(", "[", "{") else at + 1
            k += 1


def script_findings(source: str, module: str, typed: bool) -> Iterator[tuple]:
    yield from Script(source, module, typed).findings()

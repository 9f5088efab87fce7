"""Source files to tables of symbols, relations, imports and calls.

A table function parses one file and gives one row a finding; a lateral join applies it
to a table of files, each in the task that holds it. Python is read with its own syntax
tree. Script and Java files are read by declarations over matched tokens: what stands in
a nested function, class or method is not the outer one's. A file that cannot be read
gives one row with its error and no other file suffers.

A file is parsed whole, however long; null and empty texts have no symbols, equal rows
are parsed each by itself, and files of other languages give no rows.
"""

from __future__ import annotations

import ast
import io
import tokenize
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.text import strings
from .finding import FINDING, call, imported, relation, symbol
from .java import java_findings
from .script import script_findings

#: Base classes that make a class an enumeration, receivers of a call to the own class.
ENUM_BASES = {"Enum", "IntEnum", "Flag", "IntFlag", "StrEnum"}
SELF_NAMES = {"self", "cls"}
#: File endings by language.
ENDINGS = {"python": [".py", ".pyi"], "javascript": [".js", ".jsx", ".mjs", ".cjs"], "typescript": [".ts", ".tsx"], "java": [".java"]}


def _hidden(name: str) -> str:
    if name.startswith("__"):
        return "public" if name.endswith("__") else "private"
    return "protected" if name.startswith("_") else "public"


class _Headers:
    """What stands between the name and the colon of a ``def`` or ``class``: the syntax
    tree has no place for it, so it is taken from the tokens."""

    def __init__(self, source: str) -> None:
        self.lines = source.split("\n")
        self.found = [t for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type not in (tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE)]
        self.at = {t.start: i for i, t in enumerate(self.found)}

    def text(self, start: tuple[int, int], end: tuple[int, int]) -> str:
        rows = self.lines[start[0] - 1 : end[0]]
        rows[-1] = rows[-1][: end[1]]
        rows[0] = rows[0][start[1] :]
        return "\n".join(rows)

    def of(self, node: ast.stmt) -> tuple[str, str]:
        """(the bracketed part, the type after the arrow), empty if there is none."""
        first = self.lines[node.lineno - 1]
        i = self.at[node.lineno, len(first.encode()[: node.col_offset].decode())]
        depth, opened, part, arrow = 0, None, "", None
        while True:
            t = self.found[i]
            if t.string == ":" and not depth:
                return part, self.text(arrow, self.found[i - 1].end) if arrow else ""
            if t.string in ("(", "[", "{"):
                if not depth and t.string == "(" and not part:
                    opened = t.start
                depth += 1
            elif t.string in (")", "]", "}"):
                depth -= 1
                if not depth and opened:
                    part, opened = self.text(opened, t.end), None
            elif t.string == "->" and not depth:
                arrow = self.found[i + 1].start
            i += 1


def python_findings(source: str, module: str) -> Iterator[tuple]:
    """Module-level and nested classes, functions, methods, plain assignments, imports and calls."""
    source = source.replace("\r\n", "\n").replace("\r", "\n")
    tree, headers = ast.parse(source), _Headers(source)
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)

    def inside(nodes: list[ast.AST], stop: tuple[type, ...]) -> Iterator[ast.AST]:
        for n in nodes:
            yield n
            if not isinstance(n, stop):
                yield from inside(list(ast.iter_child_nodes(n)), stop)

    def calls(node: ast.stmt, caller: str) -> Iterator[tuple]:
        for n in inside([s for s in node.body if not isinstance(s, (*functions, ast.ClassDef))], (*functions, ast.ClassDef)):
            if isinstance(n, ast.Call):
                if isinstance(n.func, ast.Name):
                    yield call(caller, n.func.id, False)
                elif isinstance(n.func, ast.Attribute) and isinstance(n.func.value, ast.Name) and n.func.value.id in SELF_NAMES:
                    yield call(caller, n.func.attr, True)

    def walk(body: list[ast.stmt], owner: str, in_class: bool) -> Iterator[tuple]:
        for n in body:
            if isinstance(n, ast.ClassDef):
                named = f"{owner}.{n.name}"
                bases = [ast.get_source_segment(source, b) for b in n.bases if isinstance(b, (ast.Name, ast.Attribute))]
                enum = bool(ENUM_BASES & set(bases))
                yield symbol(n.name, named, "enum" if enum else "class", _hidden(n.name), (n.lineno, n.end_lineno), headers.of(n)[0] or None, owner if in_class else None)
                for b in bases:
                    yield relation("extends", named, b)
                yield relation("belongs_to", named, owner)
                if not enum:
                    yield from walk(n.body, named, True)
            elif isinstance(n, functions):
                named = f"{owner}.{n.name}"
                parameters, result = headers.of(n)
                yield symbol(n.name, named, "method" if in_class else "function", _hidden(n.name), (n.lineno, n.end_lineno), f"{parameters} -> {result}" if result else parameters, owner if in_class else None)
                yield relation("belongs_to", named, owner)
                yield from calls(n, named)
            elif not in_class and isinstance(n, (ast.Assign, ast.AnnAssign)):
                target = n.targets[0] if isinstance(n, ast.Assign) else n.target
                if isinstance(target, ast.Name):
                    yield symbol(target.id, f"{owner}.{target.id}", "variable", _hidden(target.id), (n.lineno, n.end_lineno))

    yield from walk(tree.body, module, False)
    for n in inside(tree.body, (*functions, ast.ClassDef)):
        if isinstance(n, ast.Import):
            for a in n.names:
                target = ast.get_source_segment(source, a)
                yield imported(ast.get_source_segment(source, n), target, [])
                yield relation("imports", module, target)
        elif isinstance(n, ast.ImportFrom) and n.module != "__future__":
            target = "." * n.level + (n.module or "")
            names = [ast.get_source_segment(source, a) for a in n.names if a.name != "*"]
            yield imported(ast.get_source_segment(source, n), target, names, n.level > 0)
            yield relation("imports", module, target)


_BY_ENDING: dict[str, Callable[[str, str], Iterator[tuple]]] = {
    ending: {"python": python_findings, "java": java_findings}.get(language) or (lambda s, m, typed=language == "typescript": script_findings(s, m, typed))
    for language, endings in ENDINGS.items() for ending in endings
}


def findings(path: str | None, text: str | None) -> Iterator[tuple]:
    """Rows of one file by the ending of its path; an error row if it cannot be read."""
    name = (path or "").rsplit("/", 1)[-1]
    stem, dot, ending = (path or "").rpartition(".") if "." in name else (path or "", "", "")
    parse = _BY_ENDING.get((dot + ending).lower())
    if parse is None:
        return
    try:
        yield from list(parse(text or "", stem.replace("/", ".")))
    except (SyntaxError, ValueError, RecursionError, IndexError, tokenize.TokenError) as e:
        yield ("error", *[None] * 11, f"{type(e).__name__}: {e}")


class _ParseSource:
    """``parse_source(path, text)`` in SQL."""

    def eval(self, path: str, text: str) -> Iterator[tuple]:
        yield from findings(path, text)


parse_source = udtf(_ParseSource, returnType=FINDING)


def parse(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``files`` with every finding of their texts joined to them, without the text; other
    columns stay, but for those named as a finding's. Only files with a known ending are read."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    known = F.exists(strings([e for endings in ENDINGS.values() for e in endings]), lambda e: F.endswith(name, e))
    taken = {c.split()[0] for c in FINDING.split(", ")}
    kept = [c for c in files.columns if c != text and c.lower() not in taken]
    source = files.where(known).select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_source_text"))
    return source.lateralJoin(parse_source(F.col(f"`{path}`").outer(), F.col("_source_text").outer())).drop("_source_text")


def symbols(found: DataFrame, *keys: str) -> DataFrame:
    return found.where("kind = 'symbol'").select(*keys, "name", "qualified_name", "symbol_type", "visibility", "start_line", "end_line", "signature", F.col("parent").alias("parent_qualified_name"))


def relations(found: DataFrame, *keys: str) -> DataFrame:
    return found.where("kind = 'relation'").select(*keys, F.col("qualified_name").alias("source"), "target", F.col("name").alias("relationship_type"))


def imports(found: DataFrame, *keys: str) -> DataFrame:
    return found.where("kind = 'import'").select(*keys, F.col("name").alias("kind"), F.col("target").alias("module"), F.col("names").alias("imported_names"), F.col("flag").alias("is_relative"), F.col("signature").alias("statement"))


def calls(found: DataFrame, *keys: str) -> DataFrame:
    return found.where("kind = 'call'").select(*keys, F.col("qualified_name").alias("caller"), F.col("target").alias("callee"), F.col("flag").alias("to_self"))


def failures(found: DataFrame, *keys: str) -> DataFrame:
    return found.where("kind = 'error'").select(*keys, "error")

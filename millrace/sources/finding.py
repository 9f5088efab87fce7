"""Rows that the parsers give."""

from __future__ import annotations

#: A finding: symbol rows fill name to parent, relation rows name (kind), qualified_name
#: (source) and target, import rows signature (statement), target, names and flag (relative),
#: call rows qualified_name (caller), target and flag (to itself).
FINDING = "kind string, name string, qualified_name string, symbol_type string, visibility string, start_line int, end_line int, signature string, parent string, target string, names array<string>, flag boolean, error string"

def symbol(name: str, qualified: str, kind: str, visibility: str, lines: tuple[int, int], signature: str | None = None, parent: str | None = None) -> tuple:
    return ("symbol", name, qualified, kind, visibility, *lines, signature, parent, None, None, None, None)


def relation(kind: str, source: str, target: str) -> tuple:
    return ("relation", kind, source, None, None, None, None, None, None, target, None, None, None)


def imported(statement: str, target: str, names: list[str], relative: bool = False, kind: str = "import") -> tuple:
    return ("import", kind, None, None, None, None, None, statement, None, target, names, relative, None)


def call(caller: str, callee: str, to_self: bool) -> tuple:
    return ("call", None, caller, None, None, None, None, None, None, callee, None, to_self, None)

"""Source files, each around the text of a document, to symbols, relations, imports and calls.

The SQL does not parse: it lists what the written declarations must give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import corpus
from ..sources import parsers
from .registry import query

#: What a file of each ending says; ``@ID@`` is its document's id, ``@TEXT@`` the text, in a comment.
SOURCES = {
    ".py": '''import os, json as j
from ..m@ID@ import (Base as B,
    other)
# @TEXT@
LIMIT_@ID@: int = 3
@wrap
class Store_@ID@(B, abc.ABC, metaclass=M):
    def __get(self, key: "str" = ")") -> dict[str, int]:
        def inner(): hidden()
        return self.load(read(key))
    class _Part: pass
class Mode_@ID@(Enum):
    def no(self): hidden()
async def run_@ID@(): return [go(x) for x in cls.all()]
''',
    ".js": '''import base, { pick as take } from './m@ID@';
/* @TEXT@ */
const rule_@ID@ = /["'`{]\\/[/"]*/g, join_@ID@ = (a, b) => hidden(a);
export class Box_@ID@ extends base.Part {
  #seal(x) { return this.open(`${take(x)} }`); }
  static async open(x) {
    const inner = () => hidden(x);
    return run_@ID@(inner);
  }
}
function run_@ID@(f) { function nested() { hidden(); } return f ? take(f) : { m() { hidden(); } }; }
export default Box_@ID@;
if (rule_@ID@) { require("late_@ID@"); }
''',
    ".ts": '''import type { Kind } from "kinds";
/* @TEXT@ */
export interface Shape_@ID@<T> extends Kind, Sized<T> { size(): number }
@mark({ a: "}" })
export class Room_@ID@<T> extends Hall<T> implements Shape_@ID@<T>, Kind {
  private open(a: Map<string, T>): Promise<void> { return this.close(a) }
  close(a: string): void;
  protected close(a: any): void { make<T>(a); }
}
export namespace Deep_@ID@ { export function make<T>(a: T): T { return call(a); } enum Mode { On } }
export const pick = <T,>(a: T): T => a; let rest: Map<string, number>, more = 2
''',
    ".java": '''package org.m@ID@;
import java.util.Map;
import static org.Help.*;
/* @TEXT@ */
@Tag(name = "}{")
public final class Tool_@ID@<T extends Comparable<T>> extends Base<T> implements Runnable, Sink<T> {
  private int[] sizes = { 1, 2 };
  Tool_@ID@(int a) { this.start(a); new Thread(() -> stop()).start(); }
  @Override
  protected <V> Map<String, V> start(final int a) throws Fault {
    Object o = new Object() { void inner() { hidden(); } };
    return other.call(start(a, "x(")); }
  Map<String, T> start(int a, String b) { return super.start(a); }
  enum Inner { A; void no() { hidden(); } }
}
interface Sink<T> { void put(T t); }
''',
}
#: (ending, name, qualified name, type, visibility, first line, last line, signature, parent); lines count on after the text.
_SYMBOLS = [
    (".py", "LIMIT_@ID@", "@M@.LIMIT_@ID@", "variable", "public", 5, 5, None, None),
    (".py", "Store_@ID@", "@M@.Store_@ID@", "class", "public", 7, 11, "(B, abc.ABC, metaclass=M)", None),
    (".py", "__get", "@M@.Store_@ID@.__get", "method", "private", 8, 10, '(self, key: "str" = ")") -> dict[str, int]', "@M@.Store_@ID@"),
    (".py", "_Part", "@M@.Store_@ID@._Part", "class", "protected", 11, 11, None, "@M@.Store_@ID@"),
    (".py", "Mode_@ID@", "@M@.Mode_@ID@", "enum", "public", 12, 13, "(Enum)", None),
    (".py", "run_@ID@", "@M@.run_@ID@", "function", "public", 14, 14, "()", None),
    (".js", "rule_@ID@", "@M@.rule_@ID@", "variable", "public", 3, 3, None, None),
    (".js", "join_@ID@", "@M@.join_@ID@", "function", "public", 3, 3, "(a, b)", None),
    (".js", "Box_@ID@", "@M@.Box_@ID@", "class", "public", 4, 10, "extends base.Part", None),
    (".js", "#seal", "@M@.Box_@ID@.#seal", "method", "private", 5, 5, "(x)", "@M@.Box_@ID@"),
    (".js", "open", "@M@.Box_@ID@.open", "method", "public", 6, 9, "(x)", "@M@.Box_@ID@"),
    (".js", "run_@ID@", "@M@.run_@ID@", "function", "public", 11, 11, "(f)", None),
    (".ts", "Shape_@ID@", "@M@.Shape_@ID@", "interface", "public", 3, 3, "extends Kind, Sized<T>", None),
    (".ts", "Room_@ID@", "@M@.Room_@ID@", "class", "public", 5, 9, "extends Hall", None),
    (".ts", "open", "@M@.Room_@ID@.open", "method", "private", 6, 6, "(a: Map<string, T>)", "@M@.Room_@ID@"),
    (".ts", "close", "@M@.Room_@ID@.close", "method", "protected", 8, 8, "(a: any)", "@M@.Room_@ID@"),
    (".ts", "Deep_@ID@", "@M@.Deep_@ID@", "namespace", "public", 10, 10, None, None),
    (".ts", "make", "@M@.Deep_@ID@.make", "function", "public", 10, 10, "(a: T)", None),
    (".ts", "Mode", "@M@.Deep_@ID@.Mode", "enum", "public", 10, 10, None, None),
    (".ts", "pick", "@M@.pick", "function", "public", 11, 11, "(a: T)", None),
    (".ts", "rest", "@M@.rest", "variable", "public", 11, 11, None, None),
    (".ts", "more", "@M@.more", "variable", "public", 11, 11, None, None),
    (".java", "org.m@ID@", "org.m@ID@", "namespace", "public", 1, 1, None, None),
    (".java", "Tool_@ID@", "org.m@ID@.Tool_@ID@", "class", "public", 5, 15, None, None),
    (".java", "Tool_@ID@", "org.m@ID@.Tool_@ID@.Tool_@ID@", "method", "package-private", 8, 8, "(int a)", "org.m@ID@.Tool_@ID@"),
    (".java", "start", "org.m@ID@.Tool_@ID@.start", "method", "protected", 9, 12, "(final int a) : Map<String, V>", "org.m@ID@.Tool_@ID@"),
    (".java", "start", "org.m@ID@.Tool_@ID@.start", "method", "package-private", 13, 13, "(int a, String b) : Map<String, T>", "org.m@ID@.Tool_@ID@"),
    (".java", "Sink", "org.m@ID@.Sink", "interface", "package-private", 16, 16, None, None),
    (".java", "put", "org.m@ID@.Sink.put", "method", "package-private", 16, 16, "(T t) : void", "org.m@ID@.Sink"),
]
#: (ending, source, target, type)
_RELATIONS = [
    (".py", "@M@.Store_@ID@", "B", "extends"), (".py", "@M@.Store_@ID@", "abc.ABC", "extends"), (".py", "@M@.Store_@ID@", "@M@", "belongs_to"), (".py", "@M@.Store_@ID@.__get", "@M@.Store_@ID@", "belongs_to"),
    (".py", "@M@.Store_@ID@._Part", "@M@.Store_@ID@", "belongs_to"), (".py", "@M@.Mode_@ID@", "Enum", "extends"), (".py", "@M@.Mode_@ID@", "@M@", "belongs_to"), (".py", "@M@.run_@ID@", "@M@", "belongs_to"),
    (".py", "@M@", "os", "imports"), (".py", "@M@", "json as j", "imports"), (".py", "@M@", "..m@ID@", "imports"),
    (".js", "@M@.Box_@ID@", "base.Part", "extends"), (".js", "@M@.Box_@ID@", "@M@", "belongs_to"), (".js", "@M@.Box_@ID@.#seal", "@M@.Box_@ID@", "belongs_to"), (".js", "@M@.Box_@ID@.open", "@M@.Box_@ID@", "belongs_to"),
    (".js", "@M@", "./m@ID@", "imports"), (".js", "@M@", "late_@ID@", "imports"),
    (".ts", "@M@.Shape_@ID@", "Kind", "extends"), (".ts", "@M@.Shape_@ID@", "Sized<T>", "extends"), (".ts", "@M@.Room_@ID@", "Hall", "extends"), (".ts", "@M@.Room_@ID@", "Shape_@ID@<T>", "implements"), (".ts", "@M@.Room_@ID@", "Kind", "implements"),
    (".ts", "@M@.Room_@ID@", "@M@", "belongs_to"), (".ts", "@M@.Room_@ID@.open", "@M@.Room_@ID@", "belongs_to"), (".ts", "@M@.Room_@ID@.close", "@M@.Room_@ID@", "belongs_to"), (".ts", "@M@", "kinds", "imports"),
    (".java", "org.m@ID@.Tool_@ID@", "Base<T>", "extends"), (".java", "org.m@ID@.Tool_@ID@", "Runnable", "implements"), (".java", "org.m@ID@.Tool_@ID@", "Sink<T>", "implements"), (".java", "org.m@ID@.Tool_@ID@", "org.m@ID@", "belongs_to"),
    (".java", "org.m@ID@.Tool_@ID@.Tool_@ID@", "org.m@ID@.Tool_@ID@", "belongs_to"), (".java", "org.m@ID@.Tool_@ID@.start", "org.m@ID@.Tool_@ID@", "belongs_to"),
    (".java", "org.m@ID@.Sink", "org.m@ID@", "belongs_to"), (".java", "org.m@ID@.Sink.put", "org.m@ID@.Sink", "belongs_to"), (".java", "org.m@ID@", "java.util.Map", "imports"), (".java", "org.m@ID@", "org.Help", "imports"),
]
#: (ending, caller, callee, to itself)
_CALLS = [
    (".py", "@M@.Store_@ID@.__get", "load", True), (".py", "@M@.Store_@ID@.__get", "read", False), (".py", "@M@.run_@ID@", "go", False), (".py", "@M@.run_@ID@", "all", True),
    (".js", "@M@.Box_@ID@.#seal", "open", True), (".js", "@M@.Box_@ID@.#seal", "take", False), (".js", "@M@.Box_@ID@.open", "run_@ID@", False), (".js", "@M@.run_@ID@", "take", False),
    (".ts", "@M@.Room_@ID@.open", "close", True), (".ts", "@M@.Room_@ID@.close", "make", False), (".ts", "@M@.Deep_@ID@.make", "call", False),
    (".java", "org.m@ID@.Tool_@ID@.Tool_@ID@", "start", True), (".java", "org.m@ID@.Tool_@ID@.Tool_@ID@", "stop", True), (".java", "org.m@ID@.Tool_@ID@.start", "start", True),
]
#: (ending, kind, module, names, relative, statement)
_IMPORTS = [
    (".py", "import", "os", "", False, "import os, json as j"), (".py", "import", "json as j", "", False, "import os, json as j"), (".py", "import", "..m@ID@", "Base as B, other", True, "from ..m@ID@ import (Base as B,\n    other)"),
    (".js", "import", "./m@ID@", "pick as take, base", True, "import base, { pick as take } from './m@ID@';"), (".js", "export", "default", "Box_@ID@", False, "export default Box_@ID@;"), (".js", "import", "late_@ID@", "", False, 'require("late_@ID@")'),
    (".ts", "import", "kinds", "Kind", False, 'import type { Kind } from "kinds";'),
    (".java", "import", "java.util.Map", "", False, "import java.util.Map;"), (".java", "static_import", "org.Help", "", False, "import static org.Help.*;"),
]


def _literal(x: object) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def _expected(columns: str, rows: list[tuple], names: list[str], lines: tuple[str, ...] = ()) -> str:
    """SQL of the listed rows, once for each file of their ending."""
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    shown = ", ".join(
        f"(v.{n} + CASE WHEN v.{n} > 3 OR s.ending IN ('.js', '.ts') AND v.{n} > 2 THEN breaks ELSE 0 END)::INTEGER AS {n}" if n in lines
        else f"replace(replace(v.{n}, '@M@', s.module), '@ID@', s.id) AS {n}" if n not in ("to_self", "is_relative") else f"v.{n}"
        for n in names
    )
    return corpus.sql(f""", sources AS (SELECT file_id, path, file_id::VARCHAR AS id, replace(regexp_replace(path, '\\.[^./]*$', ''), '/', '.') AS module,
  regexp_extract(path, '\\.[^./]*$') AS ending, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS breaks FROM files)
SELECT file_id, path, {shown} FROM sources s JOIN (VALUES {values}) AS v({columns}) ON s.ending = v.e""", "files")


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, path, text): what ``SOURCES`` says for the path's ending, around the document's text."""
    files = corpus.files(spark, sf_dir).select("file_id", "path", F.coalesce("text", F.lit("")).alias("said"))
    plain = F.translate("said", "\r\x00", "  ")
    comment = F.replace(plain, F.lit("*/"), F.lit("* /"))

    def filled(ending: str) -> Column:
        said = F.replace(plain, F.lit("\n"), F.lit("\n# ")) if ending == ".py" else comment
        return F.replace(F.replace(F.lit(SOURCES[ending]), F.lit("@ID@"), F.col("file_id").cast("string")), F.lit("@TEXT@"), said)

    text = F.col("said")
    for ending in SOURCES:
        text = F.when(F.endswith("path", F.lit(ending)), filled(ending)).otherwise(text)
    return files.select("file_id", "path", text.alias("text"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.parse(source_files(spark, sf_dir))


@query(_expected("e, name, qualified_name, symbol_type, visibility, start_line, end_line, signature, parent_qualified_name", _SYMBOLS, ["name", "qualified_name", "symbol_type", "visibility", "start_line", "end_line", "signature", "parent_qualified_name"], ("start_line", "end_line")))
def parse_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.symbols(_found(spark, sf_dir), "file_id", "path")


@query(_expected("e, source, target, relationship_type", _RELATIONS, ["source", "target", "relationship_type"]))
def parse_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each relation once, as a repository keeps them, however often a file states it."""
    return parsers.relations(_found(spark, sf_dir), "file_id", "path").distinct()


@query(_expected("e, caller, callee, to_self", _CALLS, ["caller", "callee", "to_self"]))
def parse_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.calls(_found(spark, sf_dir), "file_id", "path")


@query(_expected("e, kind, module, imported_names, is_relative, statement", _IMPORTS, ["kind", "module", "imported_names", "is_relative", "statement"]))
def parse_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parsers.imports(_found(spark, sf_dir), "file_id", "path")
    return found.withColumn("imported_names", F.array_join("imported_names", ", "))

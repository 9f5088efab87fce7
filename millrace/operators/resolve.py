"""Resolution of imports and calls to modules and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

#: Endings tried, in order, for a relative script import.
SCRIPT_ENDINGS = ["", ".js", ".jsx", ".ts", ".tsx", "/index.js", "/index.jsx", "/index.ts", "/index.tsx"]


def visibility(language: Column, name: Column, modifier: Column) -> Column:
    """Visibility by language: leading underscores, ``#``, or a modifier."""
    python = F.when(name.startswith("__") & name.endswith("__"), "public").when(name.startswith("__"), "private").when(name.startswith("_"), "protected").otherwise("public")
    script = F.when(name.startswith("#"), "private").otherwise("public")
    return F.when(language == "Python", python).when(language == "JavaScript", script).when(language == "TypeScript", F.coalesce(modifier, script)).when(language == "Java", F.coalesce(modifier, F.lit("package-private"))).otherwise("public")


def parents(symbols: DataFrame) -> DataFrame:
    """(symbol_id, parent_id): a method's class of the same file and scope, the last if several."""
    classes = symbols.where("symbol_type = 'class'").groupBy("file_id", "scope").agg(F.max("symbol_id").alias("parent_id"))
    return symbols.where("symbol_type = 'method'").join(classes, ["file_id", "scope"]).select("symbol_id", "parent_id")


def python_candidates(module: Column, target: Column) -> Column:
    """Modules a Python import may name, best first: relative to the importer's package
    for leading dots, else absolute; the module itself, then its ``__init__``."""
    dots = F.length(F.regexp_extract(target, r"^(\.*)", 1))
    rest = F.regexp_replace(target, r"^\.+", "")
    package = F.split(module, r"\.")
    depth = F.size(package) - dots
    anchor = F.array_join(F.slice(package, F.lit(1), F.greatest(depth, F.lit(0))), ".")
    absolute = F.when(dots == 0, target).when((rest == "") | (depth < 0), None).when(anchor == "", rest).otherwise(F.concat_ws(".", anchor, rest))
    return F.when(absolute.isNotNull(), F.array(absolute, F.concat(absolute, F.lit(".__init__"))))


def script_base(path: Column, target: Column) -> Column:
    """Path that a relative script import names, without ending; null for a package import.
    Steps up at its beginning are cut off the folder as text; whatever else there is, is normalized."""
    folder, lead = F.regexp_replace(path, r"/?[^/]*$", ""), F.regexp_extract(target, r"^((?:\.\.?/)*)", 1)
    rest = F.substr(target, F.length(lead) + 1)
    depth = F.length(folder) - F.length(F.replace(folder, F.lit("/"), F.lit(""))) + 1
    ups = F.regexp_count(lead, F.lit(r"\.\./"))
    plain = (ups < depth) & ~F.concat(F.lit("/"), folder, F.lit("/"), rest, F.lit("/")).rlike(r"/\.{0,2}/")
    cut = F.concat(F.call_function("substring_index", folder, F.lit("/"), (depth - ups).cast("int")), F.lit("/"), rest)
    return F.when(target.startswith("."), F.when(plain, cut).otherwise(paths.normalized_path(F.concat_ws("/", folder, target))))


def script_candidates(path: Column, target: Column) -> Column:
    """Paths a relative script import may name, best first; null for a package import."""
    base = script_base(path, target)
    return F.when(base.isNotNull(), F.array(*[F.concat(base, F.lit(e)) for e in SCRIPT_ENDINGS]))


def java_candidates(target: Column) -> Column:
    """Types a Java import may name: itself, then without its last part; null for a wildcard."""
    return F.when(~target.endswith(".*"), F.array(target, F.regexp_replace(target, r"\.[^.]*$", "")))


def _names(files: DataFrame) -> DataFrame:
    """(by_path, name, hit): the best file (at, found) for each name that a single look-up may
    ask for. A file is entered under its path less each ending that a script may leave out,
    under its module, and as a package under its ``__init__`` module's."""
    path, module = F.col("path"), paths.module_path(F.col("path"))
    named = lambda by_path, name, at: F.struct(F.lit(by_path).alias("by_path"), name.alias("name"), F.lit(at).alias("at"))
    scripts = [F.when(path.endswith(e), named(True, F.left(path, F.length(path) - len(e)), at)) for at, e in enumerate(SCRIPT_ENDINGS)]
    package = F.when(module.endswith(".__init__"), named(False, F.left(module, F.length(module) - len(".__init__")), 1))
    entries = files.select("path", F.explode(F.array_compact(F.array(*scripts, named(False, module, 0), package))).alias("e"))
    return entries.groupBy("e.by_path", "e.name").agg(F.min(F.struct("e.at", F.col("path").alias("found"))).alias("hit"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(source, target): distinct paths of importing and imported files, self-imports left out.

    ``imports`` (path, language, target), ``files`` (path). Endings and packages are tried on
    the side of the files, which are few, so an import is one row that asks for one name
    (two in Java) and only what is found goes on.
    """
    path, target, language = F.col("path"), F.col("target"), F.col("language")
    by_path = language.isin("JavaScript", "TypeScript")
    python = F.transform(F.slice(python_candidates(paths.module_path(path), target), 1, 1), lambda c: F.struct(F.lit(0).alias("place"), c.alias("name")))
    script = F.when(target.startswith("."), F.array(F.struct(F.lit(0).alias("place"), script_base(path, target).alias("name"))))
    java = F.transform(java_candidates(target), lambda c, i: F.struct(i.alias("place"), c.alias("name")))
    asked = F.when(language == "Python", python).when(by_path, script).when(language == "Java", java)
    tried = imports.select("path", F.when(language == "Java", target).alias("target"), by_path.alias("by_path"), F.explode(asked).alias("a")).select("path", "target", "by_path", "a.*")
    names = _names(files)
    # Java takes modules as they are named, so a package's name finds nothing there.
    found = tried.join(names, ["by_path", "name"]).where("target IS NULL OR hit.at = 0")
    one = found.where("target IS NULL").select(F.col("path").alias("source"), F.col("hit.found").alias("target"))
    java_hits = found.where("target IS NOT NULL").groupBy("path", "target").agg(F.min(F.struct("place", "hit.found")).alias("hit")).select("path", "hit.found")
    return one.union(java_hits).where("source <> target").distinct()


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(caller, callee): self-calls go to a method of the caller's scope in its file, bare
    ones to a function of its file; the rest is dropped. ``calls`` (caller, name, to_self)."""
    callers = symbols.select(F.col("symbol_id").alias("caller"), "file_id", "scope")
    asked = calls.join(callers, "caller")
    methods = symbols.where("symbol_type = 'method'").select("file_id", "scope", "name", F.col("symbol_id").alias("callee"))
    functions = symbols.where("symbol_type = 'function'").select("file_id", "name", F.col("symbol_id").alias("callee"))
    own = asked.where("to_self").join(methods, ["file_id", "scope", "name"]).select("caller", "callee")
    bare = asked.where("NOT to_self").join(functions, ["file_id", "name"]).select("caller", "callee")
    return own.union(bare).distinct()

"""Column functions over file paths and dotted module names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strings

#: Directories that a scan does not enter.
IGNORED_DIRECTORIES = [
    ".git", ".hg", ".svn",
    "node_modules", "bower_components", "vendor", "vendor-bin",
    ".venv", "venv", "env", ".tox", "site-packages", "__pypackages__",
    "Pods", ".gradle", ".m2", "packages",
    "dist", "build", "out", "target", "bin", "obj", ".next", ".nuxt",
    ".turbo", ".svelte-kit", "cdk.out", ".serverless",
    "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache",
    ".idea", ".vscode", ".vs", ".DS_Store",
    "coverage", "htmlcov", ".nyc_output",
    ".terraform",
]
#: File names that a scan leaves out.
IGNORED_NAMES = [
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml",
    "composer.lock", "Gemfile.lock", "poetry.lock", "Pipfile.lock",
    "go.sum", "Cargo.lock", "mix.lock", "flake.lock",
    ".DS_Store", "Thumbs.db", "desktop.ini",
]
#: Endings that a scan leaves out.
IGNORED_SUFFIXES = [
    ".min.js", ".min.css", ".map",
    ".pyc", ".pyo", ".class", ".o", ".obj", ".so", ".dll", ".dylib", ".exe",
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".webp",
    ".mp3", ".mp4", ".mov", ".avi", ".wav", ".flac",
    ".zip", ".tar", ".gz", ".tgz", ".rar", ".7z", ".whl", ".jar", ".war",
    ".pdf", ".woff", ".woff2", ".ttf", ".eot",
    ".db", ".sqlite", ".sqlite3",
]
MAX_FILE_BYTES = 5_000_000
MAX_EMBED_BYTES = 512_000
#: Language of each extension.
LANGUAGES = {
    ".py": "Python", ".pyi": "Python",
    ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript",
    ".ts": "TypeScript", ".tsx": "TypeScript",
    ".go": "Go", ".rs": "Rust", ".java": "Java", ".kt": "Kotlin", ".kts": "Kotlin", ".rb": "Ruby", ".php": "PHP",
    ".c": "C", ".h": "C", ".cpp": "C++", ".cc": "C++", ".cxx": "C++", ".hpp": "C++", ".cs": "C#", ".swift": "Swift",
    ".m": "Objective-C", ".scala": "Scala", ".sh": "Shell", ".bash": "Shell", ".sql": "SQL", ".html": "HTML", ".htm": "HTML",
    ".css": "CSS", ".scss": "SCSS", ".less": "Less", ".json": "JSON", ".yaml": "YAML", ".yml": "YAML", ".toml": "TOML",
    ".md": "Markdown", ".mdx": "Markdown", ".xml": "XML", ".vue": "Vue", ".dart": "Dart", ".lua": "Lua", ".r": "R",
    ".pl": "Perl", ".ex": "Elixir", ".exs": "Elixir", ".hs": "Haskell", ".proto": "Protocol Buffers",
}
#: File names at which a program starts.
ENTRY_POINTS = [
    "main.py", "__main__.py", "__init__.py", "app.py", "manage.py", "setup.py", "wsgi.py", "asgi.py",
    "index.js", "index.jsx", "index.ts", "index.tsx", "main.js", "main.ts", "server.js", "server.ts",
    "Main.java", "Application.java",
]
#: Names and endings of documentation and configuration, marks of persistence code.
DOC_NAMES = ["readme.md", "readme.rst", "readme.txt", "contributing.md", "architecture.md"]
CONFIG_NAMES = [
    "dockerfile", "docker-compose.yml", "docker-compose.yaml", ".env.example", "pyproject.toml", "requirements.txt",
    "package.json", "setup.py", "setup.cfg", "alembic.ini", "pytest.ini",
]
CONFIG_SUFFIXES = [".ini", ".cfg", ".toml", ".yaml", ".yml"]
PERSISTENCE_MARKS = ["model", "schema", "migration", "repository", "db", "database", "orm"]
#: Extensions that a module name sheds.
MODULE_EXTENSIONS = [
    "py", "pyi", "js", "jsx", "mjs", "cjs", "ts", "tsx", "java", "kt", "go", "rs", "rb", "php", "c", "h",
    "cpp", "cc", "cs", "json", "yaml", "yml", "toml", "md", "mdx", "txt", "cfg", "ini", "sql", "html",
    "htm", "css", "xml", "sh",
]
#: Segments of test and example modules.
TEST_SEGMENTS = ["tests", "test", "testing", "__tests__", "spec", "specs", "fuzzers", "benchmarks", "benchmark", "e2e"]
EXAMPLE_SEGMENTS = ["examples", "example", "samples", "sample", "demo", "demos", "docs", "doc", "tutorials"]


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]*)$", 1))


def language(path: Column) -> Column:
    """Language by name and extension, null if unknown."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.when(F.lower(file_name(path)) == "dockerfile", "Dockerfile").otherwise(F.try_element_at(known, extension(path)))


def is_hidden(path: Column) -> Column:
    return file_name(path).startswith(".")


def in_ignored_directory(path: Column) -> Column:
    """Whether a directory above the file is one that scans do not enter."""
    return F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), strings(IGNORED_DIRECTORIES))


def any_of(text: Column, marks: list[str], how: str = "contains") -> Column:
    """Whether the text contains, starts with or ends with one of the marks."""
    one = "(?:" + "|".join(re.escape(m) for m in marks) + ")"
    return text.rlike({"contains": one, "startswith": "^" + one, "endswith": one + r"\z"}[how])


def exclusion_reason(path: Column, size: Column, ignored: Column | None = None, most: int = MAX_FILE_BYTES) -> Column:
    """First rule that leaves the file out, null if it is kept. ``ignored``: gitignore verdict."""
    name = file_name(path)
    out = F.when(name.isin(IGNORED_NAMES), "filename_rule").when(any_of(name, IGNORED_SUFFIXES, "endswith"), "suffix_rule")
    if ignored is not None:
        out = out.when(ignored, "gitignore")
    return out.when(size > most, "max_file_size")


def _class(p: str, at: int) -> tuple[str, int] | None:
    """The character class that opens at ``at`` as a regular expression, and the place after it."""
    end = at + 1 + (p[at + 1 : at + 2] in ("!", "^"))
    negated, first = end > at + 1, end
    parts = ""
    while end < len(p) and (p[end] != "]" or end == first):
        c = p[end]
        if c == "\\" and end + 1 < len(p):
            end += 1
            c = p[end]
        elif c == "-" and first < end and p[end + 1 : end + 2] not in ("", "]"):
            parts, end = parts + "-", end + 1
            continue
        parts, end = parts + (c if c.isalnum() else "\\" + c), end + 1
    return (f"(?!/)[{'^' if negated else ''}{parts}]", end + 1) if end < len(p) and parts else None


def gitignore_rule(line: str) -> tuple[str, bool] | None:
    """(regular expression, whether a match is ignored) of one line; None if it says nothing.

    Blank lines and comments say nothing. ``!`` takes back, a backslash makes the next
    character plain, trailing spaces fall away unless escaped. A slash before the end ties
    the pattern to the root, one at the end asks for a folder. ``*``, ``?`` and ``[...]`` stay
    within a name, ``**`` between slashes is any number of folders. What is in a folder that
    matches matches too.
    """
    p = line.rstrip("\r\n")
    while p.endswith(" ") and not p.endswith("\\ "):
        p = p[:-1]
    if not p or p.startswith("#"):
        return None
    keep = p.startswith("!")
    p = p[1:] if keep else p
    inside, p = p.endswith("/"), p.rstrip("/")
    anchored, p = "/" in p, p.lstrip("/")
    if not p:
        return None
    body, at = "", 0
    while at < len(p):
        c = p[at]
        if p.startswith("**/", at) and (at == 0 or p[at - 1] == "/"):
            body, at = body + "(?:[^/]+/)*", at + 3
        elif p[at:] == "**" and at and p[at - 1] == "/":
            body, at = body + ".+", at + 2
        elif c == "*":
            body, at = body + "[^/]*", at + 1
        elif c == "?":
            body, at = body + "[^/]", at + 1
        elif c == "[" and (found := _class(p, at)):
            body, at = body + found[0], found[1]
        else:
            if c == "\\" and at + 1 < len(p):
                at += 1
                c = p[at]
            body, at = body + (c if c.isalnum() or c in "/_" else "\\" + c), at + 1
    return ("^" if anchored else "^(?:.*/)?") + body + ("/" if inside else "(?:/.*)?$"), not keep


def gitignore_verdict(path: Column, patterns: list[str]) -> Column:
    """Whether the last matching pattern of a root gitignore file ignores the path."""
    out = F.lit(False)
    for rule in map(gitignore_rule, patterns):
        if rule:
            out = F.when(path.rlike(rule[0]), F.lit(rule[1])).otherwise(out)
    return out


def module_path(path: Column) -> Column:
    """Path without its last extension, segments joined by dots."""
    return F.replace(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("/"), F.lit("."))


def module_of(path: Column, depth: int = 1) -> Column:
    """First ``depth`` segments of a path or dotted name without a known extension, or ``root``."""
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\.(?:" + "|".join(MODULE_EXTENSIONS) + ")$", "")
    parts = F.filter(F.split(F.replace(plain, F.lit("."), F.lit("/")), "/"), lambda s: s != "")
    head = F.array_join(F.slice(parts, 1, depth), ".")
    return F.when(head == "", "root").otherwise(head)


def is_test_for_search(path: Column) -> Column:
    return any_of(F.concat(F.lit("/"), F.lower(path)), ["test_", "_test.py", "test.py", "tests.py", "/test/", "/tests/", "/__tests__/", ".test.", ".spec."])


def is_test_for_summary(path: Column) -> Column:
    lowered = F.lower(path)
    name = file_name(lowered)
    return any_of(F.concat(F.lit("/"), lowered), ["/test/", "/tests/", "/__tests__/"]) | name.startswith("test_") | any_of(name, ["_test.py", ".test.js", ".test.ts", ".spec.js", ".spec.ts", "test.java"], "endswith")


def is_test_for_reports(path: Column) -> Column:
    lowered = F.lower(path)
    return file_name(lowered).isin("tests.py", "test.py", "conftest.py") | any_of(lowered, ["test_", "_test.", "/tests/", "\\tests\\", "/test/", "\\test\\"])


def module_kind(module: Column, external: Column | None = None) -> Column:
    """``external``, ``test``, ``example`` or ``source`` by the segments of a dotted name."""
    parts = F.split(module, r"\.")
    base = F.element_at(parts, -1)
    test = F.arrays_overlap(parts, strings(TEST_SEGMENTS)) | base.startswith("test_") | base.endswith("_test") | (base == "conftest")
    out = F.when(F.lit(False) if external is None else external, "external")
    return out.when(test, "test").when(F.arrays_overlap(parts, strings(EXAMPLE_SEGMENTS)), "example").otherwise("source")


def is_doc(path: Column) -> Column:
    return F.lower(file_name(path)).isin(DOC_NAMES) | F.lower(path).startswith("docs/")


def is_config(path: Column) -> Column:
    name = F.lower(file_name(path))
    return name.isin(CONFIG_NAMES) | any_of(name, CONFIG_SUFFIXES, "endswith")


def is_persistence(path: Column) -> Column:
    return any_of(F.lower(path), PERSISTENCE_MARKS)


def is_entry_point(path: Column) -> Column:
    return file_name(path).isin(ENTRY_POINTS)


def embed_eligible(path: Column, size: Column) -> Column:
    """Whether a file with a language is worth chunking: no noise file, not too large."""
    name = file_name(path)
    return language(path).isNotNull() & ~name.isin(IGNORED_NAMES) & ~any_of(name, IGNORED_SUFFIXES, "endswith") & (size <= MAX_EMBED_BYTES)


def normalized_path(path: Column) -> Column:
    """Path with ``.`` and ``..`` segments resolved; leading ``..`` stay."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    push = lambda acc, s: F.when((s == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), push), "/")


def prefixes(name: Column, sep: str = ".") -> Column:
    """All proper prefixes of a separated name, shortest first; empty for a single segment."""
    parts = F.split(name, "\\" + sep if sep == "." else sep)
    ends = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: i < F.size(parts))
    return F.transform(ends, lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep))

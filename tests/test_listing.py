"""Scans of small source trees."""

import re

import pytest

from millrace.functions import paths
from millrace.sources import listing


@pytest.fixture
def write(tmp_path):
    def run(path, content="x"):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content)

    return run


def scanned(spark, root, **options):
    files, figures = listing.scan_tree(spark, str(root), "r", **options)
    rows = files.collect()
    return {r.path for r in rows if r.reason is None}, {r.path: r.reason for r in rows if r.reason}, figures.first()


def test_folders_that_are_not_entered_are_never_seen(spark, tmp_path, write):
    for p in ("src/app.py", "src/deep/er/b.ts", "node_modules/pkg/index.js", "src/node_modules/x.js", ".git/HEAD", "dist/bundle.min.js", "docs/README.md"):
        write(p)
    (tmp_path / "empty").mkdir()
    kept, out, figures = scanned(spark, tmp_path)
    assert kept == {"src/app.py", "src/deep/er/b.ts", "docs/README.md"} and out == {}
    assert figures.folder_count == 5 and figures.total_files == 3 and figures.excluded_count == 0 and figures.repository_size_bytes == 3
    tree = {(r.path, r.kind) for r in listing.list_tree(spark, str(tmp_path)).collect()}
    assert ("empty", "folder") in tree and not any("node_modules" in p or p.startswith((".git/", "dist")) for p, _ in tree)


def test_reasons(spark, tmp_path, write):
    write("package-lock.json", "{}")
    write("src/bundle.min.js")
    write("src/app.js")
    write("data/huge.json", "x" * 1000)
    write("generated/output.py")
    write("secrets.local.yaml")
    write("note.bak")
    kept, out, figures = scanned(spark, tmp_path, most=100, more_directories=("generated",), more_names=("secrets.local.yaml",), more_suffixes=(".bak",))
    assert kept == {"src/app.js"} and figures.supported_files == 1 and figures.folder_count == 2
    assert out == {"package-lock.json": "filename_rule", "src/bundle.min.js": "suffix_rule", "data/huge.json": "max_file_size", "secrets.local.yaml": "filename_rule", "note.bak": "suffix_rule"}


def test_gitignore(spark, tmp_path, write):
    write(".gitignore", "*.local.json\nscratch/\n!keep.local.json\n")
    for p in ("config.local.json", "keep.local.json", "scratch/notes.txt", "src/scratch/x.py", "src/app.py"):
        write(p)
    kept, out, _ = scanned(spark, tmp_path)
    assert kept == {".gitignore", "keep.local.json", "src/app.py"} and set(out.values()) == {"gitignore"}
    assert "config.local.json" in scanned(spark, tmp_path, respect_gitignore=False)[0]
    (tmp_path / ".gitignore").write_text("")
    assert "config.local.json" in scanned(spark, tmp_path)[0]


def test_an_empty_or_missing_root(spark, tmp_path):
    assert scanned(spark, tmp_path) == (set(), {}, ("r", 0, 0, 0, 0, 0))
    with pytest.raises(Exception):
        listing.list_tree(spark, str(tmp_path / "none"))


CASES = {
    "*.py": (["a.py", "x/a.py", "a.py/b"], ["a.pyc"]), "/a": (["a", "a/b"], ["x/a", "ab"]), "a/": (["a/b", "x/a/b"], ["a", "xa/b"]), "a/b": (["a/b", "a/b/c"], ["x/a/b"]),
    "**/a/b": (["a/b", "x/y/a/b"], ["xa/b"]), "a/**/b": (["a/b", "a/x/b", "a/x/y/b"], ["ab", "a/xb"]), "a/**": (["a/x", "a/x/y"], ["a", "b/a/x"]), "f?o": (["foo", "fxo"], ["fo", "f/o"]),
    "[abc].x": (["a.x", "d/b.x"], ["d.x"]), "[!a-c].x": (["d.x"], ["b.x", "/.x"]), "[^a].x": (["b.x"], ["a.x"]), "[]-].x": (["].x", "-.x"], ["a.x"]), "a[/]b": ([], ["a/b"]), "[a\\]]x": (["]x", "ax"], ["bx"]), "[.&&]y": (["&y", ".y"], ["ay"]),
    "\\#a": (["#a"], ["a"]), "\\!a": (["!a"], ["a"]), "a\\ ": (["a "], ["a"]), "a  ": (["a"], ["a "]), "a\\*": (["a*"], ["ab"]), "[a": (["[a"], ["a"]), "a+(b)": (["a+(b)"], ["aab"]), "*": (["a", "a/b"], []), "dir/*": (["dir/a", "dir/a/b"], ["x/dir/a"]),
}


def test_patterns(spark):
    for line, (hit, miss) in CASES.items():
        rule, ignores = paths.gitignore_rule(line)
        assert ignores and all(re.search(rule, p) for p in hit) and not any(re.search(rule, p) for p in miss), line
    assert [paths.gitignore_rule(x) for x in ("", "# c", "   ", "/", "!")] == [None] * 5 and not paths.gitignore_rule("!a")[1]
    df = spark.createDataFrame([(line, p, p in hit) for line, (hit, miss) in CASES.items() for p in hit + miss], "line string, path string, want boolean")
    for line in CASES:
        rows = df.where(df.line == line).select("want", paths.gitignore_verdict(df.path, [line]).alias("got")).collect()
        assert all(r.want == r.got for r in rows), line

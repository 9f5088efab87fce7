"""DuckDB expressions that state the column functions once more, for the SQL side."""

from __future__ import annotations

from ..functions import paths, text


def listed(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def array(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def any_of(column: str, marks: list[str], how: str = "contains") -> str:
    function = {"contains": "contains", "endswith": "ends_with", "startswith": "starts_with"}[how]
    return "(" + " OR ".join(f"{function}({column}, '" + m.replace("'", "''") + "')" for m in marks) + ")"


def file_name(path: str) -> str:
    return f"string_split({path}, '/')[-1]"


def extension(path: str) -> str:
    return f"lower(regexp_extract({file_name(path)}, '.(\\.[^.]*)$', 1))"


def language(path: str) -> str:
    known = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.LANGUAGES.items())
    return f"CASE WHEN lower({file_name(path)}) = 'dockerfile' THEN 'Dockerfile' ELSE CASE {extension(path)} {known} END END"


def reason(path: str, size: str) -> str:
    name = file_name(path)
    return f"CASE WHEN {name} IN {listed(paths.IGNORED_NAMES)} THEN 'filename_rule' WHEN {any_of(name, paths.IGNORED_SUFFIXES, 'endswith')} THEN 'suffix_rule' WHEN {size} > {paths.MAX_FILE_BYTES} THEN 'max_file_size' END"


def pruned(path: str) -> str:
    return f"len(list_intersect(string_split({path}, '/')[1:-2], {array(paths.IGNORED_DIRECTORIES)})) > 0"


def module_path(path: str) -> str:
    return f"replace(regexp_replace({path}, '\\.[^./]*$', ''), '/', '.')"


def module_of(path: str, depth: int) -> str:
    plain = f"regexp_replace(replace({path}, '\\', '/'), '\\.(?:{'|'.join(paths.MODULE_EXTENSIONS)})$', '')"
    head = f"array_to_string(list_filter(string_split(replace({plain}, '.', '/'), '/'), lambda s: s <> '')[1:{depth}], '.')"
    return f"CASE WHEN {head} = '' THEN 'root' ELSE {head} END"


def test_search(path: str) -> str:
    return any_of(f"('/' || lower({path}))", ["test_", "_test.py", "test.py", "tests.py", "/test/", "/tests/", "/__tests__/", ".test.", ".spec."])


def test_summary(path: str) -> str:
    name = f"lower({file_name(path)})"
    return f"({any_of(f'(chr(47) || lower({path}))', ['/test/', '/tests/', '/__tests__/'])} OR starts_with({name}, 'test_') OR {any_of(name, ['_test.py', '.test.js', '.test.ts', '.spec.js', '.spec.ts', 'test.java'], 'endswith')})"


def test_reports(path: str) -> str:
    return f"(lower({file_name(path)}) IN ('tests.py', 'test.py', 'conftest.py') OR {any_of(f'lower({path})', ['test_', '_test.', '/tests/', chr(92) + 'tests' + chr(92), '/test/', chr(92) + 'test' + chr(92)])})"


def module_kind(module: str) -> str:
    parts, base = f"string_split({module}, '.')", f"string_split({module}, '.')[-1]"
    return (
        f"CASE WHEN len(list_intersect({parts}, {array(paths.TEST_SEGMENTS)})) > 0 OR starts_with({base}, 'test_') OR ends_with({base}, '_test') OR {base} = 'conftest' THEN 'test' "
        f"WHEN len(list_intersect({parts}, {array(paths.EXAMPLE_SEGMENTS)})) > 0 THEN 'example' ELSE 'source' END"
    )


def is_doc(path: str) -> str:
    return f"(lower({file_name(path)}) IN {listed(paths.DOC_NAMES)} OR starts_with(lower({path}), 'docs/'))"


def is_config(path: str) -> str:
    return f"(lower({file_name(path)}) IN {listed(paths.CONFIG_NAMES)} OR {any_of(f'lower({file_name(path)})', paths.CONFIG_SUFFIXES, 'endswith')})"


def is_persistence(path: str) -> str:
    return any_of(f"lower({path})", paths.PERSISTENCE_MARKS)


def is_entry(path: str) -> str:
    return f"{file_name(path)} IN {listed(paths.ENTRY_POINTS)}"


def embed_eligible(path: str, size: str) -> str:
    name = file_name(path)
    return f"(({language(path)}) IS NOT NULL AND {name} NOT IN {listed(paths.IGNORED_NAMES)} AND NOT {any_of(name, paths.IGNORED_SUFFIXES, 'endswith')} AND {size} <= {paths.MAX_EMBED_BYTES})"


def trigrams(column: str) -> str:
    return (
        f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({column}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), "
        "lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
    )


def normalized(column: str) -> str:
    return f"trim(regexp_replace({column}, '\\s+', ' ', 'g'), ' ')"


def tokens(column: str, most: int = 6) -> str:
    named = f"list_filter(regexp_extract_all({normalized(column)}, '[A-Za-z_][A-Za-z0-9_]*'), lambda w: length(w) >= 3 AND lower(w) NOT IN {listed(text.STOPWORDS)})"
    return f"list_filter({named}, lambda w, i: list_position(list_transform({named}, lambda x: lower(x)), lower(w)) = i)[1:{most}]"


def intent(column: str) -> str:
    lowered = f"lower({normalized(column)})"
    return "CASE " + " ".join(f"WHEN {any_of(lowered, keywords)} THEN '{name}'" for name, keywords in text.INTENT_RULES) + " ELSE 'general' END"

"""Whole reports as rows of sections, for all repositories at once.

A section is (repository_id, ordinal, heading, content, confidence, findings); it is made
of aggregates of one repository, lists in it are cut to the lengths that a report shows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reports import HIGH_RISK_FROM

#: Entries that a list of a section shows: hotspots, largest files and callees, and orphans.
SHOWN, SHOWN_ORPHANS = 10, 15
#: Fixed texts of the reports.
NOT_COMPUTED_RISK = "Repository intelligence has not been computed yet — dependency/risk analysis is unavailable."
NOT_COMPUTED = "Repository intelligence has not been computed yet — this metric is unavailable."
NO_HOTSPOTS, NO_CYCLES, NO_ORPHANS = "No dependency hotspots were detected.", "No circular dependencies were detected.", "No orphan files were detected."
NO_LANGUAGES, NO_SIZES, NO_CONCENTRATION = "Language distribution unavailable.", "No module size data is available.", "No dependency concentration data is available."
NO_FILES, NO_DOCS, NO_ORPHAN_COUNT = "No files to assess.", "No conventional documentation files (README, docs/) were found.", "No orphan files detected."


@dataclass
class Facts:
    """Tables that reports are made of, each with repository_id: ``repositories`` (name,
    computed: whether graphs were analysed), ``files`` (path, language, is_test, is_doc),
    ``symbols`` (path), ``edges`` (source, target) between modules, ``cycles`` (place, path),
    ``orphans`` (path), ``calls`` (source, target), ``inheritance`` (one row a relation)."""

    repositories: DataFrame
    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    cycles: DataFrame
    orphans: DataFrame
    calls: DataFrame
    inheritance: DataFrame


def _counts(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("repository_id").agg(F.count("*").alias(name))


def _top(rows: DataFrame, by: str, name: str, most: int = SHOWN) -> DataFrame:
    """(repository_id, ``name``): the values of ``by`` that most rows have, (value, n), most first, ties by value."""
    counts = rows.groupBy("repository_id", by).agg(F.count("*").alias("n"))
    order = Window.partitionBy("repository_id").orderBy(F.desc("n"), by)
    first = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return first.groupBy("repository_id").agg(F.array_sort(F.collect_list(F.struct("place", F.col(by).alias("value"), "n"))).alias(name))


def _listed(rows: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    return rows.groupBy("repository_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), value.alias("value")))), lambda x: x.value).alias(name))


def _joined(facts: Facts, *tables: DataFrame) -> DataFrame:
    out = facts.repositories
    for table in tables:
        out = out.join(table, "repository_id", "left")
    return out


def _said(values: Column, form, none: str, before: str = "") -> Column:
    """``before`` and the values in ``form``, with commas; ``none`` where there are no values."""
    return F.when(F.size(F.coalesce(values, F.array())) > 0, F.concat(F.lit(before), F.array_join(F.transform(values, form), ", "))).otherwise(none)


def _rows(repositories: DataFrame, sections: list[tuple[str, Column, Column, Column, Column]]) -> DataFrame:
    """One row for each section (heading, shown, content, confidence, findings) that is shown."""
    made = F.array(*[
        F.when(shown, F.struct(F.lit(heading).alias("heading"), content.alias("content"), confidence.alias("confidence"), F.coalesce(findings, F.array().cast("array<string>")).alias("findings")))
        for heading, shown, content, confidence, findings in sections
    ])
    placed = repositories.select("repository_id", "name", "summary", F.posexplode(F.array_compact(made)).alias("at", "s"))
    return placed.select("repository_id", "name", "summary", (F.col("at") + 1).alias("ordinal"), "s.*")


#: How sure a section is.
_VERIFIED, _DERIVED, _INSUFFICIENT = "verified", "derived", "insufficient_evidence"


def _none() -> Column:
    return F.array().cast("array<string>")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("string")


def dependency_risk(facts: Facts) -> DataFrame:
    """Hotspots with their risk, cycles, orphans and most-called symbols of each repository.

    A module of a listed cycle that HIGH_RISK_FROM or more import is of high risk, one of
    either kind of medium risk. Cycles and orphans are findings, all of them.
    """
    cyclic = facts.cycles.select("repository_id", F.explode("path").alias("module")).distinct().withColumn("cyclic", F.lit(True))
    incoming = facts.edges.distinct().groupBy("repository_id", F.col("target").alias("module")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("repository_id").orderBy(F.desc("n"), "module")
    hot = incoming.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SHOWN).join(cyclic, ["repository_id", "module"], "left")
    knot, much = F.coalesce("cyclic", F.lit(False)), F.col("n") >= HIGH_RISK_FROM
    hot = hot.withColumn("risk", F.when(knot & much, "high").when(knot | much, "medium").otherwise("low"))
    hot = hot.groupBy("repository_id").agg(F.array_sort(F.collect_list(F.struct("place", "module", "n", "risk"))).alias("hot"))
    chains = _listed(facts.cycles, "place", F.array_join("path", " -> "), "chains")
    orphans = _listed(facts.orphans, "path", F.col("path"), "orphans")
    called = _top(facts.calls, "target", "called")
    all_ = _joined(facts, hot, chains, orphans, called, _counts(facts.edges.distinct(), "edges"))
    size = lambda c: F.size(F.coalesce(F.col(c), _none()))
    count = lambda c: size(c).cast("string")
    high = F.transform(F.filter(F.coalesce("hot", F.expr("cast(array() AS array<struct<place:int,module:string,n:bigint,risk:string>>)")), lambda h: h.risk == "high"), lambda h: F.concat(h.module, F.lit(" is high-risk (heavily depended-on and part of a dependency cycle).")))
    summary = F.concat("name", F.lit(": "), _text("edges"), F.lit(" dependency edge(s), "), count("chains"), F.lit(" circular dependency chain(s), "), count("orphans"), F.lit(" orphan file(s), "), F.size(high).cast("string"), F.lit(" high-risk module(s)."))
    done, verified = F.col("computed"), F.lit(_VERIFIED)
    hot_said = _said(F.col("hot"), lambda h: F.concat(h.module, F.lit(" ("), h.n.cast("string"), F.lit(", risk="), h.risk, F.lit(")")), NO_HOTSPOTS, "Modules ranked by incoming dependency count: ")
    chains_said = F.when(size("chains") > 0, F.concat(count("chains"), F.lit(" circular dependency chain(s) detected: "), F.array_join("chains", "; "))).otherwise(NO_CYCLES)
    orphans_said = F.when(size("orphans") > 0, F.concat(count("orphans"), F.lit(" file(s) are never imported/depended on by any other resolved file: "), F.array_join(F.slice("orphans", 1, SHOWN_ORPHANS), ", "))).otherwise(NO_ORPHANS)
    called_said = _said(F.col("called"), lambda c: F.concat(c.value, F.lit(" ("), c.n.cast("string"), F.lit(" caller(s))")), "", "Most-called symbols: ")
    return _rows(all_.withColumn("summary", summary), [
        ("Dependency Hotspots", done, hot_said, verified, high), ("Dependency Hotspots", ~done, F.lit(NOT_COMPUTED_RISK), F.lit(_INSUFFICIENT), _none()),
        ("Circular Dependencies", done, chains_said, verified, F.col("chains")), ("Orphan Files", done, orphans_said, verified, F.col("orphans")),
        ("Call Relationships", F.col("called").isNotNull(), called_said, verified, _none()),
    ])


def health(facts: Facts) -> DataFrame:
    """Sizes, languages, concentration, structure, tests and documents of each repository."""
    files = facts.files.groupBy("repository_id").agg(F.count("*").alias("files"), F.count_if("is_test").alias("tests"), F.count_if("is_doc").alias("docs"))
    languages = facts.files.where("language IS NOT NULL").groupBy("repository_id", "language").agg(F.count("*").alias("n"))
    languages = languages.groupBy("repository_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("place"), F.col("language").alias("value"), "n"))).alias("languages"))
    all_ = _joined(
        facts, files, languages, _counts(facts.symbols, "symbols"), _top(facts.symbols, "path", "largest"), _top(facts.edges.distinct(), "target", "hot"),
        _counts(facts.cycles.where("path IS NOT NULL"), "chains"), _counts(facts.inheritance, "inherits"), _counts(facts.calls, "calls"), _counts(facts.orphans, "orphans"),
    )
    done, verified, derived = F.col("computed"), F.lit(_VERIFIED), F.lit(_DERIVED)
    pair = lambda x: F.concat(x.value, F.lit(" ("), x.n.cast("string"), F.lit(")"))
    first = F.try_element_at(F.col("hot"), F.lit(1))
    concentration = F.when(first.isNotNull(), F.concat(F.lit("Top dependency hotspot: "), first["value"], F.lit(" with "), first["n"].cast("string"), F.lit(" incoming dependencies."))).otherwise(NO_CONCENTRATION)
    structure = F.concat(_text("chains"), F.lit(" circular dependency chain(s); "), _text("inherits"), F.lit(" inheritance relationship(s); "), _text("calls"), F.lit(" call relationship(s)."))
    some = F.coalesce("files", F.lit(0)) > 0
    share = F.concat(F.bround(F.try_divide(F.col("tests") * 100, F.col("files")), 0).cast("int").cast("string"), F.lit("%"))
    tests = F.when(some, F.concat(_text("tests"), F.lit(" test-related file(s) found ("), share, F.lit(" of files)."))).otherwise(NO_FILES)
    docs = F.when(F.coalesce("docs", F.lit(0)) > 0, F.concat(_text("docs"), F.lit(" documentation file(s) found."))).otherwise(NO_DOCS)
    orphans = F.when(F.coalesce("orphans", F.lit(0)) > 0, F.concat(_text("orphans"), F.lit(" orphan file(s) detected."))).otherwise(NO_ORPHAN_COUNT)
    chains = F.when(done, F.concat(F.lit(", "), _text("chains"), F.lit(" circular dependency chain(s)"))).otherwise("")
    summary = F.concat("name", F.lit(": "), _text("files"), F.lit(" files, "), _text("symbols"), F.lit(" symbols, "), _text("tests"), F.lit(" test file(s), "), _text("docs"), F.lit(" documentation file(s)"), chains, F.lit("."))
    return _rows(all_.withColumn("summary", summary), [
        ("Repository Size", F.lit(True), F.concat(_text("files"), F.lit(" file(s), "), _text("symbols"), F.lit(" symbol(s).")), verified, _none()),
        ("Languages", done, _said(F.col("languages"), pair, NO_LANGUAGES), verified, _none()),
        ("Largest Modules", done, _said(F.col("largest"), pair, NO_SIZES, "Largest modules by symbol count: "), verified, _none()),
        ("Dependency Concentration", done, concentration, verified, _none()),
        ("Structural Complexity Signals", done, structure, verified, _none()), ("Structural Complexity Signals", ~done, F.lit(NOT_COMPUTED), F.lit(_INSUFFICIENT), _none()),
        ("Orphan Files", done, orphans, verified, _none()), ("Test-Related Structure", F.lit(True), tests, derived, _none()), ("Documentation Signals", F.lit(True), docs, derived, _none()),
    ])

"""Report facts: hotspots, risk, diagrams, latest and stale reports, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: From this in-degree on a module counts as much depended on.
HIGH_RISK_FROM = 5
#: Characters that a diagram label may not hold.
LABEL_ESCAPES = {'"': "&quot;", "[": "&#91;", "]": "&#93;", "|": "&#124;", "{": "&#123;", "}": "&#125;", "<": "&lt;", ">": "&gt;"}
#: Evidence confidence of each verification status.
CONFIDENCE = {"supported": "derived", "partially_supported": "partial", "insufficient_evidence": "insufficient_evidence", "contradicted": "insufficient_evidence"}
#: Share of the arc that shows a confidence.
ARC_PERCENT = {"supported": 92, "partially_supported": 55, "insufficient_evidence": 15, "contradicted": 20, "verified": 92, "derived": 78, "partial": 55}


def area_edges(edges: DataFrame, depth: int = 2) -> DataFrame:
    """(source, target, weight): edges between the first ``depth`` segments of the modules, without loops."""
    area = lambda c: F.array_join(F.slice(F.split(c, r"\."), 1, depth), ".")
    pairs = edges.select(area("source").alias("source"), area("target").alias("target")).where("source <> target")
    return pairs.groupBy("source", "target").agg(F.count("*").alias("weight"))


def hotspots(edges: DataFrame, most: int = 10) -> DataFrame:
    """(module, incoming): the modules with most incoming edges, ties by name."""
    counts = edges.select("source", "target").distinct().groupBy(F.col("target").alias("module")).agg(F.count("*").alias("incoming"))
    return counts.orderBy(F.desc("incoming"), "module").limit(most)


def risk(hot: DataFrame, tangled: DataFrame) -> DataFrame:
    """``hot`` with risk: high if in a tangle and much depended on, medium if either, else low."""
    knots = tangled.select(F.col("node").alias("module"), F.lit(True).alias("tangled"))
    much, knot = F.col("incoming") >= HIGH_RISK_FROM, F.coalesce("tangled", F.lit(False))
    return hot.join(knots, "module", "left").select("module", "incoming", F.when(much & knot, "high").when(much | knot, "medium").otherwise("low").alias("risk"))


def diagram_nodes(weighted: DataFrame, most: int = 25) -> DataFrame:
    """(node, weight): the heaviest nodes, ties by name."""
    ends = weighted.select(F.col("source").alias("node"), "weight").union(weighted.select("target", "weight"))
    return ends.groupBy("node").agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "node").limit(most)


def node_slug(name: Column) -> Column:
    slug = F.btrim(F.regexp_replace(name, "[^A-Za-z0-9_]", "_"), F.lit("_"))
    return F.concat(F.lit("n_"), F.when(slug == "", "node").otherwise(slug))


def node_ids(nodes: DataFrame) -> DataFrame:
    """``nodes`` (node) with a diagram id each: the slug, numbered where several share it."""
    slugs = nodes.withColumn("slug", node_slug(F.col("node")))
    place = F.row_number().over(Window.partitionBy("slug").orderBy("node"))
    return slugs.withColumn("place", place).withColumn("id", F.when(F.col("place") == 1, F.col("slug")).otherwise(F.concat_ws("_", "slug", F.col("place").cast("string")))).drop("slug", "place")


def label(name: Column, most: int = 60) -> Column:
    out = F.when(F.length(name) <= most, name).otherwise(F.concat(F.substring(name, 1, most - 1), F.lit("…")))
    for char, safe in LABEL_ESCAPES.items():
        out = F.replace(out, F.lit(char), F.lit(safe))
    return out


def diagram_text(weighted: DataFrame, most: int = 25) -> DataFrame:
    """(diagram, edges): one text of the heaviest nodes and the edges among them."""
    nodes = node_ids(diagram_nodes(weighted, most))
    ids = nodes.select("node", "id")
    drawn = weighted.join(F.broadcast(ids.select(F.col("node").alias("source"), F.col("id").alias("a"))), "source").join(F.broadcast(ids.select(F.col("node").alias("target"), F.col("id").alias("b"))), "target")
    boxes = nodes.select(F.lit(1).alias("part"), F.col("node").alias("x"), F.lit("").alias("y"), F.concat(F.lit("    "), "id", F.lit('["'), label(F.col("node")), F.lit('"]')).alias("line"))
    arrows = drawn.select(F.lit(2), "source", "target", F.concat(F.lit("    "), "a", F.lit(" -->|"), F.col("weight").cast("string"), F.lit("| "), "b"))
    body = boxes.union(arrows).agg(F.array_sort(F.collect_list(F.struct("part", "x", "y", "line"))).alias("l"))
    return body.select(F.concat(F.lit("graph LR\n"), F.array_join(F.transform("l", lambda r: r.line), "\n")).alias("diagram"), F.size(F.filter("l", lambda r: r.part == 2)).cast("long").alias("edges"))


def hotspot_nodes(edges: DataFrame, hot: int = 15, most: int = 25) -> DataFrame:
    """(node, incoming): the hotspots, and of their neighbours as many as fit, by name."""
    top = hotspots(edges, hot).withColumnRenamed("module", "node")
    a = edges.join(F.broadcast(top.select(F.col("node").alias("source"))), "source", "left_semi").select(F.col("target").alias("node"))
    b = edges.join(F.broadcast(top.select(F.col("node").alias("target"))), "target", "left_semi").select(F.col("source").alias("node"))
    near = a.union(b).distinct().join(F.broadcast(top), "node", "left_anti").orderBy("node").limit(max(0, most - hot))
    return top.unionByName(near.withColumn("incoming", F.lit(None).cast("long")))


def hotspot_diagram(edges: DataFrame, most: int = 15) -> DataFrame:
    """(diagram): one text of the hotspots with their numbers of incoming edges, their
    neighbours as far as ``most`` nodes allow, and the edges among these that touch a hotspot."""
    top = hotspots(edges, most)
    shown = node_ids(hotspot_nodes(edges, most, most))
    ids = shown.select("node", "id", F.col("incoming").isNotNull().alias("hot"))
    a, b = (ids.select(F.col("node").alias(end), F.col("id").alias(end + "_id"), F.col("hot").alias(end + "_hot")) for end in ("source", "target"))
    drawn = edges.select("source", "target").distinct().join(F.broadcast(a), "source").join(F.broadcast(b), "target").where("source_hot OR target_hot")
    text = F.concat(label(F.col("node")), F.coalesce(F.concat(F.lit(" ("), F.col("incoming").cast("string"), F.lit(" deps)")), F.lit("")))
    boxes = shown.select(F.lit(1).alias("part"), F.col("node").alias("x"), F.lit("").alias("y"), F.concat(F.lit("    "), "id", F.lit('["'), text, F.lit('"]')).alias("line"))
    arrows = drawn.select(F.lit(2), "source", "target", F.concat(F.lit("    "), "source_id", F.lit(" --> "), "target_id"))
    empty = top.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(1), F.lit(""), F.lit(""), F.lit("    %% no dependency hotspots available"))
    body = boxes.union(arrows).union(empty).agg(F.array_sort(F.collect_list(F.struct("part", "x", "y", "line"))).alias("l"))
    return body.select(F.concat(F.lit("flowchart TD\n"), F.array_join(F.transform("l", lambda r: r.line), "\n")).alias("diagram"))


def rendered(sections: DataFrame) -> DataFrame:
    """(report_id, content): a report's title, summary and sections as one text. ``sections``
    (report_id, title, summary, ordinal, heading, content, findings), a few for each report."""
    findings = F.when(F.size("findings") > 0, F.array_join(F.transform("findings", lambda f: F.concat(F.lit("- "), f)), "\n"))
    block = F.concat_ws("\n\n", F.concat(F.lit("## "), "heading", F.lit("\n\n"), "content"), findings)
    head = F.concat_ws("\n\n", F.concat(F.lit("# "), F.first("title")), F.nullif(F.first("summary"), F.lit("")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", block.alias("block")))), lambda s: s.block)
    return sections.groupBy("report_id").agg(F.concat_ws("\n\n", head, F.array_join(listed, "\n\n")).alias("content"))


def latest(reports: DataFrame) -> DataFrame:
    """The newest report of each repository and type, ties to the higher id."""
    order = Window.partitionBy("repository_id", "report_type").orderBy(F.desc("created_at"), F.desc("report_id"))
    return reports.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def history(reports: DataFrame) -> DataFrame:
    """Per repository and type: the newest ready report, and whether the newest of all failed."""
    stamp = F.struct("created_at", "report_id")
    return reports.groupBy("repository_id", "report_type").agg(
        F.max_by(F.when(F.col("status") == "ready", F.col("report_id")), F.when(F.col("status") == "ready", stamp)).alias("latest_ready"),
        (F.max_by("status", stamp) == "failed").alias("newest_failed"), F.count("*").alias("attempts"),
    )


def mapped(value: Column, table: dict, otherwise) -> Column:
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(known, value), F.lit(otherwise))

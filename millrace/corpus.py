"""The data model as views over the given tables.

Each view is a plain projection (at most a window or a distinct) of one table,
in Spark and, under the same name, as a DuckDB common table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import strings

BUCKETS = ["src", "app", "lib", "tests", "docs", "db", ".cfg"]
SYMBOL_TYPES = ["class", "function", "method", "variable", "interface", "enum", "namespace"]
EDGE_TYPES = ["depends_on", "calls", "imports", "extends", "implements", "belongs_to"]
QUESTIONS = [
    "Where is the session token validated in", "Who calls the parser for", "What breaks if I change the schema of", "Which tests cover",
    "How is configuration loaded for", "Is there an injection risk in", "Which database tables store", "Why does the exception occur in",
    "Give an architecture overview of", "How does the algorithm rank", "Find the definition of", "Tell me about",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_of(spark: SparkSession, sf_dir: str, id_: Column) -> Column:
    """The file that what has this id is dealt to: all files in turn, as ids of documents run from zero."""
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n")).scalar()
    return F.try_mod(id_, n)


#: The same in SQL.
FILE_OF = "{} % (SELECT count(*) FROM documents)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, repository_id, path, size_bytes, content_hash, text): one file a document."""
    docs = table(spark, sf_dir, "documents")
    ext = F.when(F.col("lang") == "en", "py").when(F.col("lang") == "de", "js").when(F.col("lang") == "fr", "ts").otherwise("java")
    bucket = F.element_at(strings(BUCKETS), (F.col("doc_id") % 7 + 1).cast("int"))
    kind, id_ = F.floor(F.col("doc_id") / 7) % 10, F.col("doc_id").cast("string")
    name = (
        F.when(kind == 0, F.concat(F.lit("main."), ext)).when(kind == 1, F.concat(F.lit("test_doc_"), id_, F.lit("."), ext)).when(kind == 2, "package-lock.json")
        .when(kind == 3, F.concat(F.lit("bundle_"), id_, F.lit(".min.js"))).when(kind == 4, "README.md").when(kind == 5, F.concat(F.lit("settings_"), id_, F.lit(".toml"))).otherwise(F.concat(F.lit("doc_"), id_, F.lit("."), ext))
    )
    path = F.concat_ws("/", "source", bucket, F.concat(F.lit("m"), id_), name)
    return docs.select(F.col("doc_id").alias("file_id"), F.col("source").alias("repository_id"), path.alias("path"), F.octet_length("text").cast("long").alias("size_bytes"), F.sha2("text", 256).alias("content_hash"), "text")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, line_no, line), one-based; an empty last line does not count."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.posexplode(split_lines(F.col("text"))).alias("at", "line")).select("file_id", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, n): how many ``lines`` a file has, those with one at least."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.size(split_lines(F.col("text"))).cast("long").alias("n")).where("n > 0")


def split_lines(text):
    parts = F.split(text, "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol_id, file_id, name, scope, qualified_name, symbol_type, start_line, end_line)."""
    part = table(spark, sf_dir, "part")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    return part.select(
        F.col("p_partkey").alias("symbol_id"), file_of(spark, sf_dir, F.col("p_partkey")).alias("file_id"), name.alias("name"), F.col("p_brand").alias("scope"),
        F.concat_ws(".", "p_brand", "p_type", F.concat_ws("_", name, F.col("p_partkey").cast("string"))).alias("qualified_name"),
        F.element_at(strings(SYMBOL_TYPES), (F.col("p_size") % 7 + 1).cast("int")).alias("symbol_type"),
        F.col("p_size").cast("long").alias("start_line"), (F.col("p_size") + F.col("p_partkey") % 10).cast("long").alias("end_line"),
    )


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(module_key, repository_id, module_id): dotted ids, some of tests and examples."""
    area = F.when(F.col("p_type") == "SMALL", "tests").when(F.col("p_type") == "MEDIUM", "examples").otherwise(F.lower("p_type"))
    name = F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("module_key"), F.col("p_brand").alias("repository_id"), F.concat_ws(".", F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), area, name).alias("module_id"))


#: Rows of ``lineitem`` for each task that sorts or gathers what comes from them.
TASK_ROWS = 500_000


def dealt(spark: SparkSession, sf_dir: str, rows: DataFrame, *keys: str) -> DataFrame:
    """``rows``, about as many as ``lineitem`` has, dealt by ``keys`` to so many tasks that
    none gets more of them on larger tables, whatever the session's number of partitions."""
    n = table(spark, sf_dir, "lineitem").count()
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS)), *keys)


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, relationship_type): pairs of consecutive parts of an order, each as often as it is there."""
    item = dealt(spark, sf_dir, table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    kind = F.element_at(strings(EDGE_TYPES), (F.col("l_linenumber") % 6 + 1).cast("int"))
    return item.select(F.lag("l_partkey").over(order).alias("source"), F.col("l_partkey").alias("target"), kind.alias("relationship_type")).where("source IS NOT NULL")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, relationship_type): distinct pairs of consecutive parts of an order."""
    return dealt(spark, sf_dir, steps(spark, sf_dir), "source", "target").distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target): distinct relations of any kind, without loops."""
    return dealt(spark, sf_dir, steps(spark, sf_dir).where("source <> target").select("source", "target"), "source", "target").distinct()


def joined_ends(spark: SparkSession, sf_dir: str, of: DataFrame) -> DataFrame:
    """(source_key, target_key, source, target): edges with the structs that ``of`` (module_key, end) has for both ends."""
    pairs = edges(spark, sf_dir).select(F.col("source").alias("source_key"), F.col("target").alias("target_key"))
    a, b = of.select(F.col("module_key").alias("source_key"), F.col("end").alias("source")), of.select(F.col("module_key").alias("target_key"), F.col("end").alias("target"))
    return dealt(spark, sf_dir, dealt(spark, sf_dir, pairs, "source_key").join(a, "source_key"), "target_key").join(b, "target_key")


def module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repository_id, source, target): edges between modules of one repository, by module id."""
    within = joined_ends(spark, sf_dir, modules(spark, sf_dir).select("module_key", F.struct("repository_id", "module_id").alias("end")))
    return within.where("source.repository_id = target.repository_id").select("source.repository_id", F.col("source.module_id").alias("source"), F.col("target.module_id").alias("target"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, question): templates before the first words of what users said."""
    said = table(spark, sf_dir, "conversations").where("role = 'user'")
    text = F.concat_ws(" ", F.element_at(strings(QUESTIONS), (F.col("conv_id") % 12 + 1).cast("int")), F.col("text"))
    return said.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), text.alias("question"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(answer_id, answer): replies with planted citations, by ``turn`` and ``conv_id``:
    a known file, an unknown file, both, none, a decline, a symbol with lines."""
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    known = F.concat(F.lit("src/m"), F.col("conv_id").cast("string"), F.lit("/main.py"))
    unknown = F.concat(F.lit("ghost/x"), F.col("conv_id").cast("string"), F.lit(".py"))
    case = (F.col("conv_id") + F.col("turn")) % 6
    cited = (
        F.when(case == 0, F.concat(F.lit("See "), known, F.lit(" for it."))).when(case == 1, F.concat(F.lit("See "), unknown, F.lit(" for it.")))
        .when(case == 2, F.concat(F.lit("Both "), known, F.lit(" and "), unknown, F.lit("."))).when(case == 3, F.lit("No file is named."))
        .when(case == 4, F.lit("There is insufficient evidence here.")).otherwise(F.concat(F.lit("Call blue_bolt() at lines 3-"), (F.col("conv_id") % 60 + 3).cast("string"), F.lit(".")))
    )
    return said.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), cited.alias("answer"), "text")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report_id, repository_id, report_type, status, created_at, version)."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "ready").otherwise("pending")
    return o.select(F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("repository_id"), F.col("o_orderpriority").alias("report_type"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.concat(F.lit("v"), (F.col("o_orderkey") % 3).cast("string")).alias("version"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, repository_id, status, attempts, available_at, lease_expires_at, created_at)."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("cancelled")
    ts = F.col("ts")
    return e.select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("repository_id"), status.alias("status"), (F.col("event_id") % 4).cast("int").alias("attempts"),
        (ts + F.expr("make_dt_interval(0, 0, 0, (event_id % 4) * 10)")).alias("available_at"), F.when(status == "running", ts + F.expr("INTERVAL 120 SECOND")).alias("lease_expires_at"), ts.alias("created_at"),
    )


SQL = {
    "files": """files AS (
  SELECT file_id, repository_id, repository_id || '/' || bucket || '/m' || file_id || '/' ||
         CASE kind WHEN 0 THEN 'main.' || ext WHEN 1 THEN 'test_doc_' || file_id || '.' || ext WHEN 2 THEN 'package-lock.json'
              WHEN 3 THEN 'bundle_' || file_id || '.min.js' WHEN 4 THEN 'README.md' WHEN 5 THEN 'settings_' || file_id || '.toml'
              ELSE 'doc_' || file_id || '.' || ext END AS path,
         octet_length(encode(text))::BIGINT AS size_bytes, sha256(text) AS content_hash, text
  FROM (SELECT doc_id AS file_id, source AS repository_id, text, (doc_id // 7) % 10 AS kind,
               (['src','app','lib','tests','docs','db','.cfg'])[(doc_id % 7 + 1)::INTEGER] AS bucket,
               CASE lang WHEN 'en' THEN 'py' WHEN 'de' THEN 'js' WHEN 'fr' THEN 'ts' ELSE 'java' END AS ext FROM documents))""",
    "lines": """lines AS (
  SELECT doc_id AS file_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[1:-2] ELSE p END AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)))""",
    "symbols": """symbols AS (
  SELECT p_partkey AS symbol_id, p_partkey % (SELECT count(*) FROM documents) AS file_id, replace(p_name, ' ', '_') AS name, p_brand AS scope,
         p_brand || '.' || p_type || '.' || replace(p_name, ' ', '_') || '_' || p_partkey AS qualified_name,
         (['class','function','method','variable','interface','enum','namespace'])[(p_size % 7 + 1)::INTEGER] AS symbol_type,
         p_size::BIGINT AS start_line, p_size + p_partkey % 10 AS end_line FROM part)""",
    "modules": """modules AS (
  SELECT p_partkey AS module_key, p_brand AS repository_id,
         lower(replace(p_brand, '#', '')) || '.' || CASE p_type WHEN 'SMALL' THEN 'tests' WHEN 'MEDIUM' THEN 'examples' ELSE lower(p_type) END
         || '.' || replace(p_name, ' ', '_') || '_' || p_partkey AS module_id FROM part)""",
    "relations": """relations AS (
  SELECT DISTINCT source, target, relationship_type FROM (
    SELECT lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS source, l_partkey AS target,
           (['depends_on','calls','imports','extends','implements','belongs_to'])[(l_linenumber % 6 + 1)::INTEGER] AS relationship_type FROM lineitem)
  WHERE source IS NOT NULL)""",
    "edges": "edges AS (SELECT DISTINCT source, target FROM relations WHERE source <> target)",
    "module_edges": """module_edges AS (
  SELECT a.repository_id, a.module_id AS source, b.module_id AS target FROM edges e
  JOIN modules a ON a.module_key = e.source JOIN modules b ON b.module_key = e.target AND a.repository_id = b.repository_id)""",
    "questions": "questions AS (SELECT conv_id * 1000 + turn AS question_id, ([" + ", ".join(f"'{q}'" for q in QUESTIONS) + "])[(conv_id % 12 + 1)::INTEGER] || ' ' || text AS question FROM conversations WHERE role = 'user')",
    "answers": """answers AS (
  SELECT conv_id * 1000 + turn AS answer_id, text,
         CASE (conv_id + turn) % 6 WHEN 0 THEN 'See src/m' || conv_id || '/main.py for it.' WHEN 1 THEN 'See ghost/x' || conv_id || '.py for it.'
              WHEN 2 THEN 'Both src/m' || conv_id || '/main.py and ghost/x' || conv_id || '.py.' WHEN 3 THEN 'No file is named.'
              WHEN 4 THEN 'There is insufficient evidence here.' ELSE 'Call blue_bolt() at lines 3-' || (conv_id % 60 + 3) || '.' END AS answer
  FROM conversations WHERE role = 'assistant')""",
    "reports": """reports AS (
  SELECT o_orderkey AS report_id, o_custkey AS repository_id, o_orderpriority AS report_type,
         CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'ready' ELSE 'pending' END AS status, o_orderdate AS created_at, 'v' || (o_orderkey % 3) AS version FROM orders)""",
    "jobs": """jobs AS (
  SELECT event_id AS job_id, user_id AS repository_id,
         CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status,
         (event_id % 4)::INTEGER AS attempts, ts + to_seconds((event_id % 4) * 10) AS available_at,
         CASE WHEN event_type = 'click' THEN ts + INTERVAL 120 SECOND END AS lease_expires_at, ts AS created_at FROM events)""",
}
_NEEDS = {"edges": ["relations"], "module_edges": ["relations", "edges", "modules"]}


def sql(body: str, *views: str) -> str:
    """``body`` after a WITH of the named views; it may go on with ``, name AS (...)``."""
    wanted: list[str] = []
    for v in views:
        wanted += [x for x in [*_NEEDS.get(v, []), v] if x not in wanted]
    text = ",\n".join(SQL[v] for v in wanted)
    lead = "WITH RECURSIVE " if "RECURSIVE" in body else "WITH "
    body = body.replace("/*RECURSIVE*/", "")
    return (lead + text + ("" if body.lstrip().startswith(",") else "\n") + body) if text else body

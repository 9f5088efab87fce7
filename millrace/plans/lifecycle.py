"""Index runs, queue transitions, retries, prompts, caches, owners and rendered reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import corpus
from ..functions import text
from ..operators import answers, graph, lifecycle, reports
from ..sources import readers, store
from ..sources.scratch import scratch_path
from . import answering
from . import fragments as s
from .operations import _NOW, _now
from .registry import query

_BATCHES = """WITH batches AS (
  SELECT l_suppkey AS run_id, l_orderkey * 10 + l_linenumber AS place, l_linenumber AS files, l_quantity AS chunking_ms, l_partkey % 50 AS chunks_from_cache, l_orderkey % 7 AS chunks_embedded_fresh,
         CASE WHEN l_orderkey % 997 = 5 THEN 'abort' WHEN l_returnflag = 'R' THEN 'failed' ELSE 'ok' END AS outcome FROM lineitem)
"""


@query(_BATCHES + """, stops AS (SELECT run_id, min(place) AS stop FROM batches WHERE outcome = 'abort' GROUP BY 1)
SELECT run_id, bool_or(stop IS NOT NULL) AS aborted, coalesce(sum(files) FILTER (outcome = 'failed' AND (stop IS NULL OR place < stop)), 0)::BIGINT AS files_failed,
  coalesce(sum(chunking_ms) FILTER (outcome = 'ok' AND (stop IS NULL OR place < stop)), 0) AS chunking_ms,
  coalesce(sum(chunks_from_cache) FILTER (outcome = 'ok' AND (stop IS NULL OR place < stop)), 0)::BIGINT AS chunks_from_cache,
  coalesce(sum(chunks_embedded_fresh) FILTER (outcome = 'ok' AND (stop IS NULL OR place < stop)), 0)::BIGINT AS chunks_embedded_fresh
FROM batches LEFT JOIN stops USING (run_id) GROUP BY 1""")
def index_run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that failed or aborted a run, and what the others add up to."""
    outcome = F.when(F.col("l_orderkey") % 997 == 5, "abort").when(F.col("l_returnflag") == "R", "failed").otherwise("ok")
    batches = corpus.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("run_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), F.col("l_linenumber").alias("files"), F.col("l_quantity").alias("chunking_ms"),
        (F.col("l_partkey") % 50).alias("chunks_from_cache"), (F.col("l_orderkey") % 7).alias("chunks_embedded_fresh"), outcome.alias("outcome"),
    )
    return lifecycle.run_counters(batches, ["chunking_ms", "chunks_from_cache", "chunks_embedded_fresh"])


@query("SELECT user_id AS request_id, event_type AS stage, round(sum(value), 2) AS ms, count(*) AS spans FROM events GROUP BY ALL")
def stage_timer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time of each stage of each user's requests, over all the times it was entered."""
    spans = corpus.table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    return lifecycle.stage_totals(spans).select("request_id", "stage", F.round("ms", 2).alias("ms"), "spans")


@query("""SELECT l_returnflag AS kind, round(sum(l_quantity), 2) AS retrieve, round(sum(l_discount + l_tax), 2) AS evidence, round(sum(l_extendedprice), 2) AS reason, sum(l_linenumber)::BIGINT AS verify,
  sum(l_orderkey % 5 + l_partkey % 3)::BIGINT AS overhead FROM lineitem GROUP BY 1""")
def latency_ribbon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latencies as the four stages shown and the overhead, summed by kind of request."""
    c = F.col
    stages = corpus.table(spark, sf_dir, "lineitem").select(
        c("l_returnflag").alias("request_id"), c("l_quantity").alias("retrieval_ms"), c("l_discount").alias("evidence_selection_ms"), c("l_tax").alias("context_construction_ms"), c("l_extendedprice").alias("llm_ms"),
        c("l_linenumber").alias("verification_ms"), (c("l_orderkey") % 5).alias("intent_ms"), (c("l_partkey") % 3).alias("formatting_ms"),
    )
    sums = lifecycle.ribbon(stages).groupBy(c("request_id").alias("kind"))
    return sums.agg(*[F.round(F.sum(n), 2).alias(n) for n in ("retrieve", "evidence", "reason")], F.sum("verify").alias("verify"), F.sum("overhead").alias("overhead"))


@query("SELECT p_partkey, least(coalesce(nullif(CASE WHEN p_size % 5 <> 1 THEN p_size * 2 - 20 END, 0), 10), 50)::INTEGER AS top_k FROM part")
def top_k_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many results are given where a number, none or zero is asked for."""
    asked = F.when(F.col("p_size") % 5 != 1, F.col("p_size") * 2 - 20)
    return corpus.table(spark, sf_dir, "part").select("p_partkey", lifecycle.clamped_top_k(asked).cast("int").alias("top_k"))


_STEP = f"""CASE WHEN status IN ('queued', 'running') AND repository_id % 10 = 7 THEN 'cancel' WHEN status = 'running' AND lease_expires_at < {_NOW} AND attempts >= 3 THEN 'reap'
  WHEN status = 'running' AND NOT lease_expires_at < {_NOW} AND job_id % 3 = 0 THEN 'release' WHEN status = 'running' AND NOT lease_expires_at < {_NOW} AND job_id % 3 = 1 THEN 'renew' ELSE 'keep' END"""


@query(corpus.sql(f"""SELECT job_id, step, CASE step WHEN 'cancel' THEN 'cancelled' WHEN 'reap' THEN 'failed' WHEN 'release' THEN 'queued' ELSE status END AS status,
  CASE step WHEN 'release' THEN greatest(attempts - 1, 0) ELSE attempts END AS attempts, CASE step WHEN 'release' THEN {_NOW} ELSE available_at END AS available_at,
  CASE WHEN step IN ('cancel', 'reap', 'release') THEN NULL WHEN step = 'renew' THEN {_NOW} + INTERVAL 120 SECOND ELSE lease_expires_at END AS lease_expires_at FROM (SELECT *, {_STEP} AS step FROM jobs)""", "jobs"))
def queue_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every job after one round: cancelled, reaped, handed back with its attempt, or renewed."""
    now = _now(spark, sf_dir).scalar()
    rows = lifecycle.transitions(corpus.jobs(spark, sf_dir), now, F.col("job_id") % 3 == 0, F.col("repository_id") % 10 == 7, F.col("job_id") % 3 == 1)
    return rows.select("job_id", "step", "status", "attempts", "available_at", "lease_expires_at")


@query(corpus.sql("""SELECT job_id, CASE WHEN ends THEN 'failed' ELSE 'queued' END AS status, CASE WHEN ends THEN available_at ELSE created_at + to_seconds(attempts * 10) END AS available_at
FROM (SELECT *, attempts >= 3 OR repository_id % 11 = 0 AS ends FROM jobs WHERE status = 'failed')""", "jobs"))
def queue_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When failed attempts are due again; errors of some repositories last."""
    failed = corpus.jobs(spark, sf_dir).where("status = 'failed'")
    return lifecycle.after_failure(failed, F.col("created_at"), F.col("repository_id") % 11 == 0).select("job_id", "status", "available_at")


@query("""WITH shown AS (SELECT user_id AS family, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rotated_at, event_id FROM events)
SELECT family, min(rotated_at + to_seconds(event_id % 40 - 10)) FILTER (event_id % 40 - 10 > 10) AS revoked_at, count(*) FILTER (rotated_at IS NOT NULL AND event_id % 40 - 10 BETWEEN 0 AND 10) AS refused FROM shown GROUP BY 1""")
def token_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token families with a rotated token shown again: within the grace it is refused, later the family ends."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    tokens = corpus.table(spark, sf_dir, "events").select(F.col("user_id").alias("family"), F.lead("ts").over(order).alias("rotated_at"), "event_id")
    return lifecycle.token_families(tokens.withColumn("shown_at", lifecycle.later(F.col("rotated_at"), F.col("event_id") % 40 - 10)))


@query("""SELECT event_id AS item_id, CASE WHEN user_id % 2 = 0 AND row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3 THEN -1 ELSE user_id END AS owner_id FROM events""")
def reassign_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of the oldest items of every other owner go to a new one."""
    owned = corpus.table(spark, sf_dir, "events").select(F.col("user_id").alias("owner_id"), F.col("event_id").alias("item_id"), F.col("ts").alias("created_at"))
    return lifecycle.reassigned(owned, F.col("owner_id") % 2 == 0, F.lit(-1).cast("long"), 3).select("item_id", "owner_id")


@query("""WITH stored AS (SELECT event_id AS result_id, event_type AS key, ts AS stored_at FROM events WHERE event_id % 2 = 0),
lookups AS (SELECT event_id AS lookup_id, event_type AS key, ts AS asked_at FROM events WHERE event_id % 2 = 1)
SELECT lookup_id, (SELECT arg_max(result_id, (stored_at, result_id)) FROM stored s WHERE s.key = l.key AND stored_at <= asked_at AND asked_at < stored_at + INTERVAL 300 SECOND) AS result_id FROM lookups l""")
def result_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-ups of results by key: hits are the newest stored within the last 300 seconds."""
    events = corpus.table(spark, sf_dir, "events")
    stored = events.where("event_id % 2 = 0").select(F.col("event_id").alias("result_id"), F.col("event_type").alias("key"), F.col("ts").alias("stored_at"))
    lookups = events.where("event_id % 2 = 1").select(F.col("event_id").alias("lookup_id"), F.col("event_type").alias("key"), F.col("ts").alias("asked_at"))
    return lifecycle.cache_lookups(lookups, stored)


_ROUTED = f"""SELECT question_id, intent, CASE WHEN question_id % 3 = 0 THEN '{answers.ALL_SOURCES}' ELSE {answering._case('intent', answers.SOURCES, answers.ALL_SOURCES)} END AS sources,
  CASE WHEN question_id % 3 = 0 THEN greatest({answering._case('intent', answers.TOP_K, 10)}, 20) ELSE {answering._case('intent', answers.TOP_K, 10)} END AS top_k FROM (SELECT question_id, {s.intent('question')} AS intent FROM questions)"""


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = corpus.questions(spark, sf_dir).select("question_id", "question", text.intent(F.col("question")).alias("intent"))
    return asked.withColumns(answers.routed(F.col("intent"), F.when(F.col("question_id") % 3 == 0, 1).otherwise(0)))


@query(corpus.sql(_ROUTED, "questions"))
def retry_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and result counts of all questions, a third of them asked again."""
    return _routed(spark, sf_dir).select("question_id", "intent", "sources", "top_k")


@query(corpus.sql(f"""SELECT question_id, array_to_string(list_filter(string_split(sources, ','), lambda x: NOT list_contains(failed, x)), ',') AS sources_used, array_to_string(list_filter(string_split(sources, ','), lambda x: list_contains(failed, x)), ',') AS sources_failed
FROM (SELECT *, CASE question_id % 4 WHEN 0 THEN ['semantic'] WHEN 1 THEN ['lexical', 'structural'] ELSE [] END AS failed FROM ({_ROUTED}))""", "questions"))
def partial_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources answer each question where the vector store or the database is down for some."""
    at = F.col("question_id") % 4
    failed = F.when(at == 0, text.strings(["semantic"])).when(at == 1, text.strings(["lexical", "structural"])).otherwise(F.array().cast("array<string>"))
    return _routed(spark, sf_dir).withColumns(answers.source_report(F.split("sources", ","), failed)).select("question_id", "sources_used", "sources_failed")


_CONTRADICTED = answers.CONTRADICTED_TEXT.replace("'", "''")
_NO_EVIDENCE = answers.NO_EVIDENCE_TEXT.replace("'", "''")


@query(corpus.sql(answering._CLAIMS + f"""SELECT answer_id, status NOT IN ('supported', 'insufficient_evidence') AND answer_id % 5 <> 0 AND answer_id % 2 < 1 AS retry,
  CASE WHEN status = 'contradicted' THEN '{_CONTRADICTED}' WHEN status = 'insufficient_evidence' AND shown = '' THEN '{_NO_EVIDENCE}' ELSE shown END AS shown
FROM (SELECT judged.*, CASE WHEN answer_id % 7 = 0 THEN '' ELSE answer END AS shown FROM judged JOIN answers USING (answer_id))""", *answering._CLAIM_VIEWS))
def answer_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of each answer, and which are sought once more."""
    said = corpus.answers(spark, sf_dir).select("answer_id", F.when(F.col("answer_id") % 7 == 0, "").otherwise(F.col("answer")).alias("said"))
    rows = answering.verify_status(spark, sf_dir).join(said, "answer_id")
    retry = answers.retries_left(F.col("status"), F.col("answer_id") % 2, F.col("answer_id") % 5 == 0)
    return rows.select("answer_id", retry.alias("retry"), answers.final_text(F.col("status"), F.col("said")).alias("shown"))


_RULES, _AGAIN = "Answer from the evidence only.", "\nCite nothing else."
_INSTRUCTIONS = {"testing": "Name the tests.", "architecture_overview": "Describe the parts.", "general": "Be brief."}


@query(corpus.sql(f"""SELECT question_id, '{_RULES}' || chr(10) || chr(10) || {answering._case('intent', _INSTRUCTIONS, _INSTRUCTIONS['general'])} || CASE WHEN question_id % 3 = 0 THEN '{_AGAIN}' ELSE '' END AS system_prompt,
  '{answers.EVIDENCE_BEGIN}' || chr(10) || intent || chr(10) || '{answers.EVIDENCE_END}' || chr(10) || chr(10) || 'Question: ' || question AS user_prompt
FROM (SELECT question_id, question, {s.intent('question')} AS intent FROM questions)""", "questions"))
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System and user prompts of all questions, with the intent as evidence."""
    rows = _routed(spark, sf_dir)
    system = answers.system_prompt(_RULES, _INSTRUCTIONS, F.col("intent"), F.col("question_id") % 3 == 0, _AGAIN)
    return rows.select("question_id", system.alias("system_prompt"), answers.user_prompt(F.col("intent"), F.col("question")).alias("user_prompt"))


@query(corpus.sql(""", e AS (SELECT DISTINCT source, target FROM module_edges WHERE source <> target),
threes AS (SELECT a.source AS x, a.target AS y, b.target AS z FROM e a JOIN e b ON a.target = b.source JOIN e c ON b.target = c.source AND c.target = a.source)
SELECT a.source, a.target FROM e a JOIN e b ON a.source = b.target AND a.target = b.source UNION SELECT x, y FROM threes WHERE x <> z AND y <> z""", "module_edges"))
def cycle_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of all cycles of two and three modules, ways back included."""
    cycles = graph.short_cycles(corpus.module_edges(spark, sf_dir))
    return graph.cycle_edges(cycles.select(F.array_compact(F.array("a", "b", "c")).alias("nodes")))


_HOT_DIAGRAM = """, e AS (SELECT DISTINCT source, target FROM module_edges),
hot AS (SELECT target AS node, count(*) AS incoming FROM e GROUP BY 1 ORDER BY incoming DESC, node LIMIT 15),
lines AS (SELECT 1 AS part, node AS a, '' AS b, '    n_' || trim(regexp_replace(node, '[^A-Za-z0-9_]', '_', 'g'), '_') || '["' || node || ' (' || incoming || ' deps)"]' AS line FROM hot
UNION ALL SELECT 2, source, target, '    n_' || trim(regexp_replace(source, '[^A-Za-z0-9_]', '_', 'g'), '_') || ' --> n_' || trim(regexp_replace(target, '[^A-Za-z0-9_]', '_', 'g'), '_') FROM e WHERE source IN (SELECT node FROM hot) AND target IN (SELECT node FROM hot))
SELECT 'flowchart TD' || chr(10) || string_agg(line, chr(10) ORDER BY part, a, b) AS diagram FROM lines"""


@query(corpus.sql(_HOT_DIAGRAM, "module_edges"))
def hotspot_diagram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diagram around the fifteen hotspots as one text."""
    return reports.hotspot_diagram(corpus.module_edges(spark, sf_dir))


_HEALTH = f"""SELECT repository_id, count(*) AS files, count(*) FILTER ({s.test_reports('path')}) AS tests, count(*) FILTER ({s.is_doc('path')}) AS docs, count(*) FILTER ({s.is_config('path')}) AS configs FROM files GROUP BY 1"""


@query(corpus.sql(f"""SELECT repository_id AS report_id, '# Health of ' || repository_id || chr(10) || chr(10) || files || ' files' || chr(10) || chr(10) ||
  '## Tests' || chr(10) || chr(10) || tests || ' of ' || files || ' files are tests.' || CASE WHEN tests = 0 THEN chr(10) || chr(10) || '- There are no tests.' ELSE '' END || chr(10) || chr(10) ||
  '## Documents' || chr(10) || chr(10) || docs || ' documents, ' || configs || ' settings.' || CASE WHEN docs = 0 AND configs = 0 THEN chr(10) || chr(10) || '- There is no document.' || chr(10) || '- There are no settings.'
    WHEN docs = 0 THEN chr(10) || chr(10) || '- There is no document.' WHEN configs = 0 THEN chr(10) || chr(10) || '- There are no settings.' ELSE '' END AS content FROM ({_HEALTH})""", "files"))
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The health report of each repository, assembled of sections and written out."""
    facts = answering.health_metrics(spark, sf_dir)
    string = lambda c: F.col(c).cast("string")
    finding = lambda c, said: F.when(F.col(c) == 0, said)

    def section(ordinal: int, heading: str, content, *findings) -> DataFrame:
        return facts.select(F.col("repository_id").alias("report_id"), F.concat(F.lit("Health of "), "repository_id").alias("title"), F.concat(string("files"), F.lit(" files")).alias("summary"), F.lit(ordinal).alias("ordinal"), F.lit(heading).alias("heading"), content.alias("content"), F.array_compact(F.array(*findings)).alias("findings"))

    tests = section(1, "Tests", F.concat(string("tests"), F.lit(" of "), string("files"), F.lit(" files are tests.")), finding("tests", "There are no tests."))
    docs = section(2, "Documents", F.concat(string("docs"), F.lit(" documents, "), string("configs"), F.lit(" settings.")), finding("docs", "There is no document."), finding("configs", "There are no settings."))
    return reports.rendered(tests.union(docs))


@query("""SELECT vec_id, CASE WHEN vec_id % 7 = 1 THEN -1 ELSE label END AS label FROM embeddings WHERE vec_id % 5 <> 0
UNION ALL SELECT -1 - vec_id, label FROM embeddings WHERE vec_id % 11 = 0""")
def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of vectors after an upsert of changed and new ones and the removal of others."""
    path = scratch_path(spark, "vector-store")
    vectors = corpus.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    store.create_store(vectors, path, "vec_id", buckets=16)
    changed = vectors.where("vec_id % 7 = 1").withColumn("label", F.lit(-1))
    new = vectors.where("vec_id % 11 = 0").withColumn("vec_id", -1 - F.col("vec_id"))
    store.upsert(path, changed.union(new), "vec_id")
    store.delete(path, vectors.where("vec_id % 5 = 0"), "vec_id")
    return store.read_store(spark, path).select("vec_id", "label")


@query(corpus.sql(""", gone AS (SELECT DISTINCT repository_id FROM files WHERE file_id % 17 = 0), kept AS (SELECT file_id FROM files WHERE repository_id NOT IN (SELECT * FROM gone)),
symbols_left AS (SELECT symbol_id FROM symbols WHERE file_id IN (SELECT * FROM kept))
SELECT 'files' AS name, count(*) AS n FROM kept UNION ALL SELECT 'symbols', count(*) FROM symbols_left UNION ALL SELECT 'relations', count(*) FROM relations WHERE source IN (SELECT * FROM symbols_left)""", "files", "symbols", "relations"))
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left in the stores of relations, symbols and files once repositories go."""
    files = corpus.files(spark, sf_dir).select("file_id", "repository_id")
    relation = F.concat_ws("|", F.col("source").cast("string"), F.col("target").cast("string"), "relationship_type").alias("relation_id")
    tables = {"files": (files, "file_id"), "symbols": (corpus.symbols(spark, sf_dir).select("symbol_id", "file_id"), "symbol_id"), "relations": (corpus.relations(spark, sf_dir).select(relation, "source"), "relation_id")}
    folder = {name: scratch_path(spark, f"{name}-store") for name in tables}
    for name, (rows, key) in tables.items():
        store.create_store(rows, folder[name], key, buckets=8)
    held = {name: store.read_store(spark, path) for name, path in folder.items()}
    going = files.where("file_id % 17 = 0").select("repository_id").distinct()
    left = readers.drop_repositories(held, going, {"symbols": ("files", "file_id", "file_id"), "relations": ("symbols", "source", "symbol_id")})
    gone = {name: held[name].join(left[name].select(key), key, "left_anti") for name, (_, key) in tables.items()}
    store.cascade([(folder[name], gone[name], tables[name][1]) for name in ("relations", "symbols", "files")])
    counts = [store.read_store(spark, path).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, path in folder.items()]
    return counts[0].union(counts[1]).union(counts[2])

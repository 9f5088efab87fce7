"""Questions, evidence, citation checks and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import corpus
from ..functions import paths, text
from ..operators import answers, chunking, reports
from . import fragments as s
from . import retrieval
from .registry import query


@query(corpus.sql(f"SELECT question_id, {s.intent('question')} AS intent FROM questions", "questions"))
def classify_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.questions(spark, sf_dir).select("question_id", text.intent(F.col("question")).alias("intent"))


def _case(column: str, table: dict, otherwise) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {show(v)}" for k, v in table.items()) + f" ELSE {show(otherwise)} END"


@query(corpus.sql(f"SELECT question_id, intent, {_case('intent', answers.SOURCES, answers.ALL_SOURCES)} AS sources, {_case('intent', answers.TOP_K, 10)} AS top_k FROM (SELECT question_id, {s.intent('question')} AS intent FROM questions)", "questions"))
def intent_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = corpus.questions(spark, sf_dir).select("question_id", text.intent(F.col("question")).alias("intent"))
    intent = F.col("intent")
    return asked.select("question_id", "intent", answers.mapped(intent, answers.SOURCES, answers.ALL_SOURCES).alias("sources"), answers.mapped(intent, answers.TOP_K, 10).alias("top_k"))


_SELECTED = retrieval._HYBRID + f""", capped AS (SELECT r.*, row_number() OVER (PARTITION BY r.query_id, path ORDER BY rank) AS in_path, {s.intent('question')} = 'implementation' AS deeper FROM ranked r JOIN asked USING (query_id)),
selected AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS item FROM capped WHERE in_path <= CASE WHEN deeper THEN 4 ELSE 2 END) WHERE item <= 8)
"""


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = retrieval.hybrid(spark, sf_dir)
    return answers.select_evidence(ranked, text.intent(F.col("question")) == "implementation")


@query(corpus.sql(_SELECTED + "SELECT query_id, item, key, path FROM selected", *retrieval._HYBRID_VIEWS))
def select_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir).select("query_id", "item", "key", "path")


@query(corpus.sql(retrieval._HYBRID + f"SELECT query_id, count(key) AS results, round(max(final_score), 4) AS best, coalesce(max(final_score), 0) >= {answers.LEAST_SCORE} AS sufficient FROM asked LEFT JOIN ranked USING (query_id) GROUP BY 1", *retrieval._HYBRID_VIEWS))
def evidence_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = retrieval.asked(spark, sf_dir).select("query_id")
    best = retrieval.hybrid(spark, sf_dir).groupBy("query_id").agg(F.count("key").alias("n"), F.max("final_score").alias("top"))
    return asked.join(best, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("results"), F.round("top", 4).alias("best"), (F.coalesce("top", F.lit(0.0)) >= answers.LEAST_SCORE).alias("sufficient"))


_EVIDENCE = """, split_files AS (SELECT file_id, path, CASE WHEN p[-1] = '' THEN p[1:-2] ELSE p END AS l FROM (SELECT file_id, path, string_split(text, chr(10)) AS p FROM files)),
bodies AS (SELECT symbol_id, y.file_id, path, symbol_type, name, start_line, end_line, (symbol_id % 100) / 100.0::DOUBLE AS score,
  CASE WHEN start_line <= len(l) THEN substring(array_to_string(l[start_line:least(end_line, len(l))], chr(10)), 1, 2500) ELSE '' END AS body FROM symbols y JOIN split_files USING (file_id)),
blocks AS (SELECT *, '[Evidence 1] ' || path || ' (' || symbol_type || ': ' || name || '), lines ' || start_line || '-' || end_line || ' — score ' || printf('%.2f', score) || ' (source: lexical)' AS header FROM bodies)
"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = corpus.files(spark, sf_dir).where("text IS NOT NULL").select("file_id", "path", corpus.split_lines(F.col("text")).alias("lines"))
    located = corpus.symbols(spark, sf_dir).join(lines, "file_id")
    body = F.when(F.col("start_line") <= F.size("lines"), F.substring(chunking.line_text(F.col("lines"), F.col("start_line"), F.col("end_line")), 1, answers.ITEM_CHARS)).otherwise("")
    return located.withColumn("body", body).withColumn("score", (F.col("symbol_id") % 100) / 100.0)


def _block(body) -> F.Column:
    c = F.col
    return answers.evidence_block(F.lit(1), c("path"), c("symbol_type"), c("name"), c("start_line"), c("end_line"), c("score"), F.lit("lexical"), body)


@query(corpus.sql(_EVIDENCE + "SELECT symbol_id, header || CASE WHEN body = '' THEN chr(10) || '(source text unavailable)' ELSE chr(10) || '```' || chr(10) || body || chr(10) || '```' END AS block FROM blocks", "files", "symbols"))
def evidence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("symbol_id", _block(F.col("body")).alias("block"))


@query(corpus.sql("/*RECURSIVE*/" + _EVIDENCE + """, items AS (SELECT file_id AS query_id, row_number() OVER (PARTITION BY file_id ORDER BY symbol_id) AS item, length(header) AS header_chars, length(body) AS text_chars FROM blocks),
fold(query_id, item, n, chars, stopped) AS (
  SELECT DISTINCT query_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, FALSE FROM items
  UNION ALL SELECT f.query_id, i.item, f.n + CASE WHEN f.stopped OR 12000 - f.chars <= 0 OR header_chars + least(text_chars, 2500, 12000 - f.chars) > 12000 - f.chars THEN 0 ELSE 1 END,
    f.chars + CASE WHEN f.stopped OR 12000 - f.chars <= 0 OR header_chars + least(text_chars, 2500, 12000 - f.chars) > 12000 - f.chars THEN 0 ELSE header_chars + least(text_chars, 2500, 12000 - f.chars) END,
    f.stopped OR 12000 - f.chars <= 0 OR header_chars + least(text_chars, 2500, 12000 - f.chars) > 12000 - f.chars
  FROM fold f JOIN items i ON i.query_id = f.query_id AND i.item = f.item + 1)
SELECT query_id, max(n) AS items, max(chars) AS chars FROM fold GROUP BY 1""", "files", "symbols"))
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context of each file's symbols, in id order, within the character budget."""
    rows = _evidence(spark, sf_dir)
    header = F.length(F.regexp_extract(_block(F.lit("")), r"^([^\n]*)", 1)).cast("long")
    items = rows.select(F.col("file_id").alias("query_id"), F.col("symbol_id").alias("item"), header.alias("header_chars"), F.length("body").cast("long").alias("text_chars"))
    return answers.context(items)


_PATHS = """(SELECT DISTINCT answer_id, unnest(list_distinct(regexp_extract_all(answer, '""" + text.FILE_PATH + """'))) AS claim FROM answers)"""
_CLAIMS = f""", cited AS (SELECT * FROM {_PATHS}),
path_claims AS (SELECT answer_id, 'path' AS kind, claim, EXISTS (SELECT 1 FROM files WHERE path = claim OR ends_with(path, '/' || claim) OR ends_with(claim, '/' || path)) AS valid FROM cited),
symbol_claims AS (SELECT answer_id, 'symbol' AS kind, claim, claim IN (SELECT name FROM symbols) AS valid FROM (SELECT answer_id, unnest(list_distinct(regexp_extract_all(answer, '{text.SYMBOL_CALL}', 1))) AS claim FROM answers)),
line_claims AS (SELECT answer_id, 'lines' AS kind, claim, EXISTS (SELECT 1 FROM symbols WHERE start_line <= a AND b <= end_line) AS valid FROM (
  SELECT answer_id, claim, regexp_extract(claim, '{text.LINE_RANGE}', 1)::BIGINT AS a, coalesce(nullif(regexp_extract(claim, '{text.LINE_RANGE}', 2), ''), regexp_extract(claim, '{text.LINE_RANGE}', 1))::BIGINT AS b
  FROM (SELECT answer_id, unnest(list_distinct(regexp_extract_all(answer, '{text.LINE_RANGE}'))) AS claim FROM answers))),
claims AS (SELECT * FROM path_claims UNION ALL SELECT * FROM symbol_claims UNION ALL SELECT * FROM line_claims),
judged AS (SELECT answer_id, n, v, CASE WHEN n = 0 AND {s.any_of('lower(answer)', text.DECLINE_PHRASES)} THEN 'insufficient_evidence' WHEN n = v THEN 'supported' WHEN v = 0 THEN 'contradicted' ELSE 'partially_supported' END AS status
  FROM (SELECT answer_id, answer, coalesce(n, 0) AS n, coalesce(v, 0) AS v FROM answers LEFT JOIN (SELECT answer_id, count(*) AS n, count(*) FILTER (valid) AS v FROM claims GROUP BY 1) USING (answer_id)))
"""
_CLAIM_VIEWS = ("answers", "files", "symbols")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    said, symbols = corpus.answers(spark, sf_dir), corpus.symbols(spark, sf_dir)
    return answers.path_citations(said, corpus.files(spark, sf_dir).select("path")).union(answers.symbol_citations(said, symbols.select("name"))).union(answers.line_citations(said, symbols.select("start_line", "end_line")))


@query(corpus.sql(_CLAIMS + "SELECT * FROM path_claims", *_CLAIM_VIEWS))
def verify_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.path_citations(corpus.answers(spark, sf_dir), corpus.files(spark, sf_dir).select("path"))


@query(corpus.sql(_CLAIMS + "SELECT * FROM line_claims", *_CLAIM_VIEWS))
def verify_line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.line_citations(corpus.answers(spark, sf_dir), corpus.symbols(spark, sf_dir).select("start_line", "end_line"))


@query(corpus.sql(_CLAIMS + "SELECT answer_id, n AS claims, v AS valid, status FROM judged", *_CLAIM_VIEWS))
def verify_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.statuses(corpus.answers(spark, sf_dir), _claims(spark, sf_dir))


@query(corpus.sql(_CLAIMS + f"SELECT answer_id, {_case('status', reports.CONFIDENCE, 'insufficient_evidence')} AS confidence, {_case('status', reports.ARC_PERCENT, 15)} AS arc FROM judged", *_CLAIM_VIEWS))
def confidence_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("status")
    return verify_status(spark, sf_dir).select("answer_id", reports.mapped(status, reports.CONFIDENCE, "insufficient_evidence").alias("confidence"), reports.mapped(status, reports.ARC_PERCENT, 15).alias("arc"))


@query(corpus.sql(_CLAIMS + """SELECT answer_id, string_agg(DISTINCT claim, ',' ORDER BY claim) FILTER (kind = 'path') AS files, string_agg(DISTINCT claim, ',' ORDER BY claim) FILTER (kind = 'symbol') AS symbols FROM claims WHERE valid GROUP BY 1""", *_CLAIM_VIEWS))
def answer_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files and symbols that each answer cites rightly."""
    named = lambda k: F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("claim")))), ",")
    out = _claims(spark, sf_dir).where("valid").groupBy("answer_id").agg(named("path").alias("files"), named("symbol").alias("symbols"))
    return out.select("answer_id", F.nullif("files", F.lit("")).alias("files"), F.nullif("symbols", F.lit("")).alias("symbols"))


@query(corpus.sql(r"""SELECT answer_id, regexp_replace(regexp_replace(regexp_replace(replace('## Answer' || chr(10) || '**Note:** ' || text || ' `done`', chr(13) || chr(10), chr(10)), '\*\*([^*]+)\*\*', '\1', 'g'), '`([^`]+)`', '\1', 'g'), '(?m)^#{1,6}\s+', '', 'g') AS plain FROM answers""", "answers"))
def answer_plaintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("## Answer\n**Note:** "), F.col("text"), F.lit(" `done`"))
    return corpus.answers(spark, sf_dir).select("answer_id", text.plain_text(marked).alias("plain"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE (props->>'k')::BIGINT END AS k FROM events""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON object in replies that are one, fence one, surround one, or hold none."""
    at, props = F.col("event_id") % 4, F.col("props")
    reply = F.when(at == 0, props).when(at == 1, F.concat(F.lit("Here:\n```json\n"), props, F.lit("\n```\nend"))).when(at == 2, F.concat(F.lit("so "), props, F.lit(" it is"))).otherwise("none at all")
    return corpus.table(spark, sf_dir, "events").select("event_id", F.get_json_object(text.json_object(reply), "$.k").cast("long").alias("k"))


@query(corpus.sql(f"""SELECT repository_id, count(*) AS files, count(*) FILTER ({s.test_reports('path')}) AS tests, count(*) FILTER ({s.is_doc('path')}) AS docs, count(*) FILTER ({s.is_config('path')}) AS configs,
  round(count(*) FILTER ({s.test_reports('path')}) / count(*)::DOUBLE, 4) AS test_ratio FROM files GROUP BY 1""", "files"))
def health_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    tests = F.count_if(paths.is_test_for_reports(path))
    return corpus.files(spark, sf_dir).groupBy("repository_id").agg(F.count("*").alias("files"), tests.alias("tests"), F.count_if(paths.is_doc(path)).alias("docs"), F.count_if(paths.is_config(path)).alias("configs"), F.round(tests / F.count("*"), 4).alias("test_ratio"))


@query(corpus.sql("SELECT repository_id, report_type, report_id, status FROM (SELECT *, row_number() OVER (PARTITION BY repository_id, report_type ORDER BY created_at DESC, report_id DESC) AS place FROM reports) WHERE place = 1", "reports"))
def latest_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.latest(corpus.reports(spark, sf_dir)).select("repository_id", "report_type", "report_id", "status")


@query(corpus.sql("""SELECT repository_id, report_type, arg_max(report_id, (created_at, report_id)) FILTER (status = 'ready') AS latest_ready, arg_max(status, (created_at, report_id)) = 'failed' AS newest_failed, count(*) AS attempts FROM reports GROUP BY ALL""", "reports"))
def report_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.history(corpus.reports(spark, sf_dir))


@query(corpus.sql("""SELECT repository_id, report_type, report_id, version IS DISTINCT FROM 'v1' AS stale FROM (SELECT *, row_number() OVER (PARTITION BY repository_id, report_type ORDER BY created_at DESC, report_id DESC) AS place FROM reports WHERE status = 'ready') WHERE place = 1""", "reports"))
def report_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each latest ready report is of another corpus version than the current one."""
    ready = reports.latest(corpus.reports(spark, sf_dir).where("status = 'ready'"))
    return ready.select("repository_id", "report_type", "report_id", (~F.col("version").eqNullSafe("v1")).alias("stale"))

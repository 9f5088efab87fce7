"""Evaluation, queue, quotas, logs, and a few relational staples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import corpus
from ..operators import jobs
from . import answering, retrieval
from . import fragments as s
from .registry import query

_TRIGRAM = retrieval._lexical_sql(f", tokens AS (SELECT DISTINCT symbol_id AS query_id, substring(name, 1, length(name) - 1) AS token FROM symbols WHERE symbol_id % {retrieval.ASKS} = 0)")


@query(corpus.sql(_TRIGRAM + """, hits AS (SELECT t.query_id, min(rank) FILTER (l.symbol_id % 64 = t.query_id % 64) AS rank FROM tokens t LEFT JOIN lexical l USING (query_id) GROUP BY 1)
SELECT count(*) AS questions, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_5, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 4) AS mrr, median(rank)::DOUBLE AS median_rank FROM hits""", "symbols"))
def eval_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and reciprocal rank of name searches, where symbols of the asker's residue class are expected."""
    found = retrieval.trigram_search(spark, sf_dir)
    asked = corpus.symbols(spark, sf_dir).where(F.col("symbol_id") % retrieval.ASKS == 0).select(F.col("symbol_id").alias("query_id"))
    hits = found.where(F.col("symbol_id") % 64 == F.col("query_id") % 64).groupBy("query_id").agg(F.min("rank").alias("rank"))
    ranks = asked.join(hits, "query_id", "left")
    return ranks.agg(F.count("*").alias("questions"), F.round(F.avg(F.when(F.col("rank") <= 5, 1.0).otherwise(0.0)), 4).alias("recall_at_5"), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 4).alias("mrr"), F.median("rank").alias("median_rank"))


@query(corpus.sql(answering._CLAIMS + """SELECT count(*) AS answers, round(avg(CASE WHEN status = 'supported' THEN 1.0 ELSE 0.0 END), 4) AS grounded, round(avg(CASE WHEN status IN ('contradicted', 'insufficient_evidence') THEN 1.0 ELSE 0.0 END), 4) AS unsupported FROM judged""", *answering._CLAIM_VIEWS))
def eval_groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    status = F.col("status")
    return answering.verify_status(spark, sf_dir).agg(F.count("*").alias("answers"), share(status == "supported").alias("grounded"), share(status.isin("contradicted", "insufficient_evidence")).alias("unsupported"))


_NOW = "(SELECT max(ts) - INTERVAL 60 SECOND FROM events)"


def _now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "events").agg((F.max("ts") - F.expr("INTERVAL 60 SECOND")).alias("now"))


@query(corpus.sql(f"""SELECT job_id, repository_id, status FROM jobs WHERE ((status = 'queued' AND available_at <= {_NOW}) OR (status = 'running' AND lease_expires_at < {_NOW})) AND attempts < 3 ORDER BY created_at, job_id LIMIT 1""", "jobs"))
def queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = jobs.claimable(corpus.jobs(spark, sf_dir), _now(spark, sf_dir))
    return due.orderBy("created_at", "job_id").limit(1).select("job_id", "repository_id", "status")


@query(corpus.sql(f"""SELECT count(*) AS due, count(*) FILTER (status = 'running') AS expired, count(DISTINCT repository_id) AS repositories FROM jobs
WHERE ((status = 'queued' AND available_at <= {_NOW}) OR (status = 'running' AND lease_expires_at < {_NOW})) AND attempts < 3""", "jobs"))
def queue_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many jobs could be claimed, and how many of them for an expired lease."""
    due = jobs.claimable(corpus.jobs(spark, sf_dir), _now(spark, sf_dir))
    return due.agg(F.count("*").alias("due"), F.count_if(F.col("status") == "running").alias("expired"), F.count_distinct("repository_id").alias("repositories"))


@query(corpus.sql(f"""SELECT min(date_diff('microsecond', {_NOW}, due_at)) / 1e6::DOUBLE AS seconds FROM (SELECT available_at AS due_at FROM jobs WHERE status = 'queued' UNION ALL SELECT lease_expires_at FROM jobs WHERE status = 'running') WHERE due_at > {_NOW}""", "jobs"))
def queue_next_wake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.next_wake(corpus.jobs(spark, sf_dir), _now(spark, sf_dir))


@query("SELECT strftime(ts, '%Y%m%d') AS day, user_id, count(*) AS used, count(*) > 3 AS over FROM events GROUP BY ALL")
def quota_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.daily_use(corpus.table(spark, sf_dir, "events"), 3)


@query("""WITH lines AS (SELECT ts AS said_at, CASE WHEN event_id % 5 = 0 THEN 'plain ' || event_type ELSE props END AS line FROM events),
last AS (SELECT * FROM lines ORDER BY said_at DESC, line DESC LIMIT 50) SELECT line, (CASE WHEN json_valid(line) THEN line END->>'k')::BIGINT AS k, CASE WHEN NOT json_valid(line) THEN line END AS raw FROM last""")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("plain "), "event_type")).otherwise(F.col("props"))
    lines = corpus.table(spark, sf_dir, "events").select(F.col("ts").alias("at"), line.alias("line"))
    return jobs.log_tail(lines, 50).select("line", F.get_json_object("line", "$.k").cast("long").alias("k"), "raw")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS discounted, round(avg(l_quantity), 4) AS mean_quantity, count(*) AS items
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: priced items by flag and status."""
    item = corpus.table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return item.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.round(F.sum(net), 2).alias("discounted"), F.round(F.avg("l_quantity"), 4).alias("mean_quantity"), F.count("*").alias("items"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY revenue DESC, n_name LIMIT 10""")
def nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the ten nations whose customers' orders earn most."""
    t = lambda n: corpus.table(spark, sf_dir, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return joined.groupBy("n_name").agg(F.round(F.sum(net), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("orders")).orderBy(F.desc("revenue"), "n_name").limit(10)

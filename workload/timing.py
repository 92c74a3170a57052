"""Queries of the throttle, the debounce and the streaming forms."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus import schemas
from lynceus.operators import events as E
from lynceus.operators.debounce import debounce
from lynceus.operators.throttle import throttle
from lynceus.plans.scan import as_files, scan
from lynceus.scale import work_dir
from lynceus.streaming.debounce import debounce_stream
from lynceus.streaming.events import catch_up, write_events, write_finding_events
from lynceus.streaming.events import feed as feed_of
from lynceus.streaming.scan import read_file_stream, scan_stream, start_scan_job
from lynceus.streaming.throttle import throttle_stream
from workload.base import CODE_COLUMNS, NOW, code_files, corpus, corpus_sql, dealt_stream, query, table
from workload.rules_sql import SNIPPET, findings_cte
from workload.scanning import LINE_ENGINES

DAY = 24 * 3600 * 1_000_000
HOUR = 3600 * 1_000_000


def throttle_sql(window: str, limit: int, select: str) -> str:
    """One step per request of a user, in order: the window and its count travel along."""
    return f"""WITH RECURSIVE r AS (
        SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
      walk AS (
        SELECT user_id, event_id, ts, rn, ts AS start, 1 AS used, true AS allowed FROM r WHERE rn = 1
        UNION ALL
        SELECT r.user_id, r.event_id, r.ts, r.rn,
          CASE WHEN r.ts >= w.start + INTERVAL {window} THEN r.ts ELSE w.start END,
          CASE WHEN r.ts >= w.start + INTERVAL {window} THEN 1 WHEN w.used < {limit} THEN w.used + 1 ELSE w.used END,
          r.ts >= w.start + INTERVAL {window} OR w.used < {limit}
        FROM walk w JOIN r ON r.user_id = w.user_id AND r.rn = w.rn + 1)
      {select}"""


FLAGS = "SELECT user_id, event_id, allowed FROM walk"
PER_USER = "SELECT user_id, count(*) FILTER (WHERE allowed) AS allowed, count(*) FILTER (WHERE NOT allowed) AS rejected FROM walk GROUP BY user_id"


@query("throttle", throttle_sql("1 DAY", 3, FLAGS))
def throttled(spark, sf):
    got = throttle(table(spark, sf, "events"), "user_id", "ts", "event_id", 3, DAY, block_times=64)
    return got.select("user_id", "event_id", "allowed")


@query("throttle_hours", throttle_sql("12 HOUR", 1, PER_USER))
def throttle_hours(spark, sf):
    got = throttle(table(spark, sf, "events"), "user_id", "ts", "event_id", 1, 12 * HOUR, block_times=16)
    return got.groupBy("user_id").agg(
        F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("rejected")
    )


def one_client_sql(window: str, limit: int) -> str:
    return throttle_sql(window, limit, FLAGS).replace("SELECT user_id, event_id, ts, row_number()", "SELECT 0 AS user_id, event_id, ts, row_number()").replace("PARTITION BY user_id ORDER", "ORDER")


@query("throttle_one_client", one_client_sql("6 HOUR", 10).replace(FLAGS, "SELECT event_id, allowed FROM walk"))
def throttle_one_client(spark, sf):
    """All requests from a single client; its blocks are decided in parallel."""
    rows = table(spark, sf, "events").withColumn("client", F.lit("one"))
    return throttle(rows, "client", "ts", "event_id", 10, 6 * HOUR, block_times=256).select("event_id", "allowed")


BURSTS = """SELECT event_id, user_id, event_type AS code FROM (
   SELECT *, lead(ts) OVER (PARTITION BY {key} ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NULL OR nxt - ts > INTERVAL {gap}"""


def changes(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("code"))


@query("debounce", BURSTS.format(key="user_id", gap="8 HOUR"))
def debounced(spark, sf):
    return debounce(changes(spark, sf), "user_id", "ts", "event_id", 8 * HOUR).select("event_id", "user_id", "code")


@query("debounce_one_file", BURSTS.format(key="1", gap="5 MINUTE"))
def debounce_one_file(spark, sf):
    """Every change is of the same file."""
    rows = changes(spark, sf).withColumn("path", F.lit("a.py"))
    return debounce(rows, "path", "ts", "event_id", 300_000_000).select("event_id", "user_id", "code")


# Streaming ------------------------------------------------------------------------


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there and read what it wrote."""
    path = work_dir(stream.sparkSession, name)
    query_ = write_events(stream, f"{path}/out", f"{path}/checkpoint")
    query_.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def event_stream(spark, sf) -> DataFrame:
    schema = table(spark, sf, "events").schema
    # A pattern, because a stream takes a plain path for a folder.
    return spark.readStream.schema(schema).parquet(f"{sf}/events.[p]arquet")


@query("throttle_stream", throttle_sql("1 DAY", 3, FLAGS))
def throttled_stream(spark, sf):
    got = throttle_stream(event_stream(spark, sf), "user_id", "ts", "event_id", 3, DAY)
    return run_to_table(got, "throttle").select("user_id", "event_id", "allowed")


LATEST = "(SELECT max(ts) FROM events)"


@query(
    "debounce_stream",
    "SELECT event_id, user_id, code FROM (SELECT b.*, ts FROM ("
    + BURSTS.format(key="user_id", gap="8 HOUR")
    + f") b JOIN events USING (event_id)) WHERE ts + INTERVAL 8 HOUR <= {LATEST} - INTERVAL 10 SECOND",
)
def debounced_stream(spark, sf):
    """Bursts that the watermark has closed; later ones stay in state."""
    rows = event_stream(spark, sf).select("event_id", "user_id", "ts", F.col("event_type").alias("code"))
    got = debounce_stream(rows, "user_id", "ts", "event_id", 8 * HOUR)
    return run_to_table(got, "debounce").select("event_id", "user_id", "code")


def file_stream(spark, sf, name: str) -> DataFrame:
    """A corpus written as files that a stream then picks up."""
    path = work_dir(spark, "incoming")
    corpus(spark, sf, name).select("path", "code", "language").write.parquet(path)
    return read_file_stream(spark, path, "parquet")


@query("scan_stream", f"WITH {findings_cte()} SELECT engine, rule_id, path AS file_path, line_no AS line_start FROM found")
def scanned_stream(spark, sf):
    """Findings of arriving files, made of the rows as they arrive; equal to the batch scan."""
    files = code_files(dealt_stream(spark, sf, "lineitem", CODE_COLUMNS))
    got = scan_stream(files, LINE_ENGINES, "info", detected_at=NOW)
    return run_to_table(got.select("engine", "rule_id", "file_path", "line_start"), "scan")


# Micro-batches of the event feed, where the files are so many.
MICRO_BATCHES = 3
# Texts of one file, so that a micro-batch has files for all cores.
FILE_RECORDS = 5_000
FEED_RULES = f"WITH {findings_cte('documents')} SELECT 'finding' AS type, rule_id, count(*) AS n, true AS numbered FROM found GROUP BY rule_id"


@query("event_feed", FEED_RULES)
def event_feed(spark, sf):
    """Finding events of a stream of several micro-batches; a scan's numbers are all different."""
    path = work_dir(spark, "feed")
    incoming = work_dir(spark, "incoming")
    files = corpus(spark, sf, "documents").select("path", "code", "language")
    files.write.option("maxRecordsPerFile", FILE_RECORDS).parquet(incoming)
    per_batch = -(-len(spark.read.schema(files.schema).parquet(incoming).inputFiles()) // MICRO_BATCHES)
    found = scan_stream(read_file_stream(spark, incoming, "parquet", files_per_batch=per_batch), LINE_ENGINES, "info", detected_at=NOW)
    write_finding_events(found, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    events = feed_of(spark, f"{path}/out")
    twice = events.groupBy("scan_id", "seq").agg(F.count("*").alias("times")).agg(F.max("times").alias("most"))
    by_rule = events.groupBy("type", F.get_json_object("data", "$.rule_id").alias("rule_id")).agg(F.count("*").alias("n"))
    return by_rule.join(F.broadcast(twice.select((F.col("most") == 1).alias("numbered"), F.lit("finding").alias("of"))), F.col("type") == F.col("of")).drop("of")


EVENT_NUMBERS = f"""WITH {findings_cte('conversations')},
    named AS (SELECT *, concat('scan-', CAST(length(path) % 3 AS STRING)) AS scan_id FROM found)
    SELECT scan_id, count(*) + 5 AS events, CAST(1 AS BIGINT) AS lowest, count(*) + 5 AS highest, count(*) + 5 AS different,
      CAST(4 AS BIGINT) AS before_findings, CAST(count(*) AS BIGINT) AS resumed FROM named GROUP BY scan_id"""


@query("event_numbers", EVENT_NUMBERS)
def event_numbers(spark, sf):
    """Events of scans, numbered from 1 without gaps: progress, findings, completion; and what is behind a number."""
    files = corpus(spark, sf, "conversations").withColumn("scan_id", F.concat(F.lit("scan-"), (F.length("path") % 3).cast("string")))
    found = scan(files, LINE_ENGINES, "info", detected_at=NOW, keep=("scan_id",))
    scans = files.select("scan_id").distinct()
    events = E.numbered_events(E.scan_events(scans, found, LINE_ENGINES))
    kind = F.get_json_object("event", "$.type")
    return events.groupBy("scan_id").agg(
        F.count("*").alias("events"), F.min("seq").alias("lowest"), F.max("seq").alias("highest"), F.count_distinct("seq").alias("different"),
        F.max(F.when(kind == "progress", F.col("seq"))).alias("before_findings"),
        F.count_if((F.col("seq") > 4) & (kind == "finding")).alias("resumed"),
    ).where("resumed > 0")


@query("completion_summary", f"WITH {findings_cte('documents')} SELECT severity, count(*) AS n FROM found GROUP BY severity")
def completion_summary(spark, sf):
    """Each micro-batch stores its findings and their counts; the counts add up to the scan's."""
    path = work_dir(spark, "job")
    job = start_scan_job(
        file_stream(spark, sf, "documents"), f"{path}/out", f"{path}/checkpoint",
        engines=LINE_ENGINES, min_severity="info", detected_at=NOW,
    )
    job.awaitTermination()
    scans = spark.read.parquet(f"{path}/out/scans")
    return scans.select(F.explode("severity_counts").alias("severity", "n")).groupBy("severity").agg(F.sum("n").alias("n"))


# Replay: the events of a user are one scan; its last error or purchase completes it ----

FEED = (
    "concat('scan-', CAST(user_id AS STRING)) AS scan_id",
    "event_id AS seq",
    "CASE event_type WHEN 'error' THEN 'complete' ELSE 'progress' END AS type",
    "props AS data",
)
REPLAY_AT = datetime(2024, 1, 30, 12)
REPLAY_TTL = 2 * 24 * 3600
LIVE = f"""WITH feed AS (SELECT {', '.join(FEED)}, ts AS at_ FROM events),
   done AS (SELECT scan_id, max(at_) AS done_at FROM feed WHERE type = 'complete' GROUP BY scan_id)
   SELECT scan_id, seq, type FROM feed WHERE scan_id NOT IN (
     SELECT scan_id FROM done WHERE TIMESTAMP '2024-01-30 12:00:00' - done_at >= INTERVAL {REPLAY_TTL} SECOND)"""


def feed(spark, sf):
    return table(spark, sf, "events").selectExpr(*FEED, "CAST(ts AS TIMESTAMP) AS at")


@query("live_events", LIVE)
def live_events(spark, sf):
    return E.live_events(feed(spark, sf), REPLAY_AT, REPLAY_TTL).select("scan_id", "seq", "type")


@query("late_subscriber", LIVE.replace("WHERE scan_id NOT IN", "WHERE scan_id = 'scan-7' AND scan_id NOT IN").replace(f"{REPLAY_TTL} SECOND", "30 DAY"))
def late_subscriber(spark, sf):
    """Events of one scan, read back from a feed folder in order."""
    path = work_dir(spark, "events")
    feed(spark, sf).write.parquet(path)
    return catch_up(spark, path, "scan-7", REPLAY_AT, 30 * 24 * 3600).select("scan_id", "seq", "type")

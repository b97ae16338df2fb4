"""The job stream: events to jobs, runs, retries (B-07, B-08, B-13, H-01 to H-07)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import retry_delay_ms
from ..operators.relational import distinct_on
from ..session import dealt

JOB = "job_id string, org_id string, service_id string, commit_sha string, job_type string, attempt int, enqueued_at timestamp, next_retry_at timestamp"
RUN_EVENT = "job_id string, service_id string, event string, attempt int, at timestamp"
MOST_ATTEMPTS = 3
#: Topics and their partitions.
TOPICS = {"pr": 12, "batch": 6, "dlq": 3}


def kafka_jobs(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """B-07: jobs from a topic; needs the Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), JOB).alias("job")).select("job.*")


def kafka_sink(jobs: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    """B-08: keyed by service, so that a service's jobs keep their order."""
    rows = jobs.select(F.col("service_id").alias("key"), F.to_json(F.struct("*")).alias("value"))
    return rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def file_jobs(spark: SparkSession, folder: str, schema: str = JOB) -> DataFrame:
    """The same stream from landed JSON files."""
    return spark.readStream.schema(schema).json(folder)


def accepted(events: DataFrame) -> DataFrame:
    """H-02: pull requests that open or change, and pushes to branches."""
    pull = (F.col("event") == "pull_request") & F.col("action").isin("opened", "synchronize", "reopened")
    return events.filter(pull | ((F.col("event") == "push") & F.startswith("ref", F.lit("refs/heads/"))))


def decompose(events: DataFrame, services: DataFrame) -> DataFrame:
    """H-01: ``event_id, service_id, files``: each changed file to the first service, by position, with a root above it.

    Roots are matched by equality with the folders above a file, not by
    comparing every root with every file.  An event becomes many rows, which
    stay in its task until they are its services' files, so events are dealt.
    """
    files = dealt(events, "event_id").select("event_id", "repo", F.explode("changed_files").alias("file"))
    parts = F.split("file", "/")
    above = files.withColumn("root", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))))
    roots = services.select("repo", "service_id", "position", F.explode("source_roots").alias("root")).withColumn("root", F.regexp_replace("root", "/$", ""))
    owner = distinct_on(above.join(roots, ["repo", "root"]), ["event_id", "file"], [F.asc("position"), F.asc("service_id")])
    return owner.groupBy("event_id", "service_id").agg(F.sort_array(F.collect_set("file")).alias("files"))


def snapshot_type(job_type: Column | str) -> Column:
    """H-06."""
    c = F.col(job_type) if isinstance(job_type, str) else job_type
    return F.when(c.isin("NIGHTLY", "MANUAL"), "BASELINE").otherwise("DELTA")


#: What an event makes of a run, and how far along a state is.
STATES = ("QUEUED", "RUNNING", "FAILED", "COMPLETE", "DLQ")


def fold_runs(events: DataFrame) -> DataFrame:
    """H-04: the state of each job from all its events, in any order, repeated or not.

    The latest attempt counts, and of its events the furthest state.
    """
    rank = F.array_position(F.array(*(F.lit(s) for s in STATES)), F.col("event"))
    last = events.withColumn("rank", rank).groupBy("job_id").agg(F.max(F.struct("attempt", "rank", "at", "service_id")).alias("l"), F.min("at").alias("enqueued_at"))
    return last.select("job_id", "l.service_id", F.element_at(F.array(*(F.lit(s) for s in STATES)), F.col("l.rank").cast("int")).alias("status"), "l.attempt", "enqueued_at", F.col("l.at").alias("changed_at"))


def run_states(events: DataFrame) -> DataFrame:
    """H-04 on a stream: the state of a job after each batch, held by Spark's state store."""
    import pandas as pd

    def update(key, batches, state):
        best = state.get if state.exists else (0, 0)
        service = ""
        for pdf in batches:
            for event, attempt, sid in zip(pdf["event"], pdf["attempt"], pdf["service_id"]):
                best, service = max(tuple(best), (int(attempt), STATES.index(event) + 1)), sid
        state.update(best)
        yield pd.DataFrame({"job_id": [key[0]], "service_id": [service], "status": [STATES[best[1] - 1]], "attempt": [best[0]]})

    return events.groupBy("job_id").applyInPandasWithState(update, "job_id string, service_id string, status string, attempt int", "attempt int, state int", "update", "NoTimeout")


def after_failure(jobs: DataFrame, now: Column, base_ms: int = 30_000) -> tuple[DataFrame, DataFrame]:
    """H-05: failed jobs again with the next attempt and the time it is due, and those that have failed too often.

    The delay is that of the attempt to come, so the first retry waits twice the base.
    """
    again = jobs.filter(F.col("attempt") < MOST_ATTEMPTS).withColumn("attempt", F.col("attempt") + 1)
    due = F.timestamp_micros(F.unix_micros(now) + retry_delay_ms("attempt", base_ms) * 1000)
    return again.withColumn("next_retry_at", due), jobs.filter(F.col("attempt") >= MOST_ATTEMPTS)


def due(jobs: DataFrame, now: Column) -> DataFrame:
    """H-05: jobs to run now."""
    return jobs.filter(F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))


DONE_PARTS = 256


def run_stream(jobs: DataFrame, handle: Callable[[DataFrame], None], done: str, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """H-03, H-07, B-13: each batch is handled, then its jobs are noted in ``done``.

    At least once: a batch that fails comes again.  Jobs already noted are passed
    over, so handling is repeated only for a batch that broke off between the
    two.  Notes lie in :data:`DONE_PARTS` folders by a hash of the job; a batch
    reads only those of its own jobs, however long the history.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        fresh = df.dropDuplicates(["job_id", "attempt"]).withColumn("part", F.pmod(F.xxhash64("job_id"), F.lit(DONE_PARTS)).cast("int"))
        parts = [r[0] for r in fresh.select("part").distinct().collect()]
        try:
            noted = spark.read.parquet(done).filter(F.col("part").isin(parts))
            fresh = fresh.join(noted.select("job_id", "attempt"), ["job_id", "attempt"], "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        handle(fresh.drop("part"))
        fresh.select("job_id", "attempt", F.lit(batch_id).alias("batch_id"), "part").write.mode("append").partitionBy("part").parquet(done)

    writer = jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def dead_letter_depth(runs: DataFrame) -> DataFrame:
    """H-07, A-22: how many dead-lettered jobs each service has."""
    return runs.filter("status = 'DLQ'").groupBy("service_id").agg(F.count("*").alias("depth"))

"""A queue of jobs drained with Structured Streaming, its state kept by upserts."""

from __future__ import annotations

import json
from collections.abc import Callable
from hashlib import sha256
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import latest

JOB = "id string, key string, phase string, seq long"


def drain(spark: SparkSession, source: str, state: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Read what is new in source (Parquet files of JOB), leave out ids that were seen before, work the rest, append the outcome.

    Progress and the ids seen live in checkpoint: a second call reads only new files, and of the ids a batch looks up
    its own in the state store, however many were seen before. Each batch is written under its own number, so a batch
    that is run again after a failure replaces what it wrote: work may run twice for a batch and must give the same
    then. Rows without id or key go to quarantine, all of them.
    """
    good = F.col("id").isNotNull() & F.col("key").isNotNull()

    def run(rows: Callable[[DataFrame], DataFrame], made: Callable[[DataFrame], DataFrame], to: str, progress: str) -> None:
        def step(batch: DataFrame, number: int) -> None:
            made(batch).write.mode("overwrite").parquet(f"{to}/batch={number}")

        stream = rows(spark.readStream.schema(JOB).parquet(source))
        stream.writeStream.foreachBatch(step).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()

    run(lambda rows: rows.where(good).dropDuplicates(["id"]), work or (lambda batch: batch), state, checkpoint)
    run(lambda rows: rows.where(~good), lambda batch: batch, f"{state}-quarantine", f"{checkpoint}-quarantine")


def _files(spark: SparkSession, place: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


#: A job of the queue; what must not be empty in it.
QUEUED = "id string, agent string, session_id string, project_id string, cwd string, transcript string, reason string, queued_at long, phase string, detail string, updated_at long"
REQUIRED = ("id", "agent", "session_id", "project_id", "cwd", "transcript")


def job_id(digest: str, session: str, project: str) -> str:
    """What a job is known by: the digest of its transcript, its session and project."""
    return sha256("\0".join((project, session, digest)).encode()).hexdigest()


def enqueue(spark: SparkSession, folder: str, transcript: str, agent: str, session: str, project: str, cwd: str, reason: str, at: int) -> str:
    """A job with a copy of its transcript; the same content again is the same job and changes nothing. Its id.

    A task works out the digest, and the copy is made from file to file in one step at its end, so no transcript passes
    through the driver's Python.
    """
    digest = spark.read.format("binaryFile").load(transcript).select(F.sha2("content", 256)).first()[0]
    name = job_id(digest, session, project)
    place = f"{folder}/transcripts/{name}.jsonl"
    copied(spark, transcript, place)
    job = {"id": name, "agent": agent, "session_id": session, "project_id": project, "cwd": cwd, "transcript": place, "reason": reason, "queued_at": at, "phase": "queued", "detail": "", "updated_at": at}
    write_once(spark, f"{folder}/jobs/{name}.json", json.dumps(job, ensure_ascii=False))
    return name


def copied(spark: SparkSession, source: str, place: str) -> None:
    """A private copy of a file; what is there already stays, as it has the same content."""
    to, path = _files(spark, place)
    if to.exists(path):
        return
    jvm = spark.sparkContext._jvm
    here, there = _files(spark, source)
    to.mkdirs(path.getParent())
    beside = jvm.org.apache.hadoop.fs.Path(f"{place}.{uuid4().hex}.tmp")
    jvm.org.apache.hadoop.fs.FileUtil.copy(here, there, to, beside, False, spark.sparkContext._jsc.hadoopConfiguration())
    to.rename(beside, path)


def write_once(spark: SparkSession, place: str, text: str) -> bool:
    """A small file whole or not at all, made by one writer only; False for all others.

    It is written beside its place and then put there in one step that fails where a file is: a link on a local file
    system, a rename on others (as HDFS does it; a store without such a rename needs a lock of its own).
    """
    fs, path = _files(spark, place)
    if fs.exists(path):
        return False
    jvm = spark.sparkContext._jvm
    fs.mkdirs(path.getParent())
    beside = jvm.org.apache.hadoop.fs.Path(f"{place}.{uuid4().hex}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode("utf-8", "surrogatepass")))
    out.close()
    if fs.getUri().getScheme() != "file":
        return fs.rename(beside, path) or (fs.delete(beside, False) and False)
    local = lambda p: jvm.java.nio.file.Path.of(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
    try:
        jvm.java.nio.file.Files.createLink(local(path), local(beside))
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.toString():
            raise
        return False
    finally:
        fs.delete(beside, False)


def jobs_of(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The jobs of a queue's folder, and the files (file) that are none: no JSON, or a required field without text."""
    fs, path = _files(spark, f"{folder}/jobs")
    if not fs.exists(path):
        return spark.createDataFrame([], QUEUED), spark.createDataFrame([], "file string")
    read = spark.read.text(f"{folder}/jobs", wholetext=True, pathGlobFilter="*.json").select(F.input_file_name().alias("file"), F.from_json("value", QUEUED).alias("job"))
    whole = F.col("job").isNotNull()
    for c in REQUIRED:
        whole = whole & (F.coalesce(F.trim(F.col("job")[c]), F.lit("")) != "")
    return read.where(whole).select("job.*"), read.where(~whole).select("file")


def marked(spark: SparkSession, folder: str, job: str, phase: str, detail: str, at: int) -> None:
    """Note a phase of a job: completed and failed are kept beside the queue, one file for each change."""
    write_once(spark, f"{folder}/marks/{job}-{at:012d}-{phase}.json", json.dumps({"id": job, "phase": phase, "detail": detail, "updated_at": at}, ensure_ascii=False))


def runs(spark: SparkSession, folder: str, limit: int = 0) -> DataFrame:
    """The jobs with their last phase, pending and completed ones together, newest first; 20 if limit is not within 1 and 100."""
    jobs, _ = jobs_of(spark, folder)
    fs, path = _files(spark, f"{folder}/marks")
    marks = spark.read.schema("id string, phase string, detail string, updated_at long").json(f"{folder}/marks") if fs.exists(path) else spark.createDataFrame([], "id string, phase string, detail string, updated_at long")
    return newest_runs(*with_phases(jobs, marks), limit)


def with_phases(jobs: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pending and completed jobs: each with the phase, detail and time of its last mark, if it has any."""
    last = marks.groupBy("id").agg(F.max_by(F.struct("phase", "detail", "updated_at"), F.struct("updated_at", "phase")).alias("m"))
    met = jobs.join(last, "id", "left").select(*[F.coalesce(F.col(f"m.{c}"), F.col(c)).alias(c) if c in ("phase", "detail", "updated_at") else F.col(c) for c in jobs.columns])
    done = F.coalesce(F.col("phase"), F.lit("")) == "completed"
    return met.where(~done), met.where(done)


def newest_runs(pending: DataFrame, completed: DataFrame, limit: int = 0, newest: str = "updated_at") -> DataFrame:
    kind = lambda df, name: df.withColumn("kind", F.lit(name))
    return kind(pending, "pending").unionByName(kind(completed, "completed")).orderBy(F.desc(newest), F.desc("id")).limit(limit if 0 < limit <= 100 else 20)


#: Seconds for which a worker holds a job, and jobs that it looks at at a time.
STALE, ROUND = 3600, 64


def lease(spark: SparkSession, folder: str, job: str, worker: str, at: int, seconds: int = STALE) -> str | None:
    """Hold a job for so many seconds: the lease's file, or nothing if another worker holds it or was quicker.

    Leases of a job are numbered, and each number can be made once only; one that has run out is followed by the next.
    """
    fs, top = _files(spark, f"{folder}/leases")
    found = fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/leases/{job}-*.json")) or []
    last = max((s.getPath().getName() for s in found), default=None)
    if last is not None:
        held = _content(spark, f"{folder}/leases/{last}")
        if held is not None and json.loads(held)["until"] > at:
            return None
    number = 0 if last is None else int(last.removesuffix(".json").rpartition("-")[2]) + 1
    place = f"{folder}/leases/{job}-{number:06d}.json"
    return place if write_once(spark, place, json.dumps({"id": job, "worker": worker, "until": at + seconds})) else None


def _content(spark: SparkSession, place: str) -> str | None:
    """The text of a small file; nothing if it is gone."""
    fs, path = _files(spark, place)
    try:
        stream = fs.open(path)
    except Py4JJavaError as error:
        if "FileNotFound" not in error.java_exception.toString():
            raise
        return None
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def is_done(spark: SparkSession, folder: str, job: str) -> bool:
    fs, _ = _files(spark, folder)
    return len(fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/marks/{job}-*-completed.json")) or []) > 0


def process(spark: SparkSession, folder: str, work: Callable[[dict], str], at: int, worker: str | None = None) -> dict[str, int]:
    """Work pending jobs in the order of queueing; the counts of completed, failed and quarantined, and of those that other workers hold.

    Any number of workers may do so at once: a job is worked by who gets its lease, and a lease that has run out is
    taken over. A job that fails stays with its error and is tried again by the next call; a file that is no job is
    moved to quarantine. Jobs are read ROUND at a time.
    """
    worker = worker or uuid4().hex
    counts = {"completed": 0, "failed": 0, "quarantined": 0, "held": 0}
    fs, _ = _files(spark, folder)
    while rows := jobs_of(spark, folder)[1].orderBy("file").limit(ROUND).collect():
        fs.mkdirs(_files(spark, f"{folder}/quarantine")[1])
        moved = [fs.rename(there, _files(spark, f"{folder}/quarantine/{there.getName()}")[1]) for there in (_files(spark, row.file)[1] for row in rows) if fs.exists(there)]
        counts["quarantined"] += sum(moved)
        if not any(moved):
            break
    after = None
    while True:
        waiting = jobs_of(spark, folder)[0].join(runs_done(spark, folder), "id", "left_anti")
        if after is not None:
            waiting = waiting.where((F.col("queued_at") > after[0]) | ((F.col("queued_at") == after[0]) & (F.col("id") > after[1])))
        some = waiting.orderBy("queued_at", "id").limit(ROUND).collect()
        if not some:
            return counts
        for job in some:
            after = (job.queued_at, job.id)
            held = lease(spark, folder, job.id, worker, at)
            if held is None:
                counts["held"] += 1
                continue
            try:
                if not is_done(spark, folder, job.id):
                    detail = work(job.asDict())
                    marked(spark, folder, job.id, "completed", detail or "", at)
                    counts["completed"] += 1
            except Exception as error:  # noqa: BLE001  whatever work raises is the job's failure
                marked(spark, folder, job.id, "failed", str(error), at)
                counts["failed"] += 1
            finally:
                fs.delete(_files(spark, held)[1], False)


def runs_done(spark: SparkSession, folder: str) -> DataFrame:
    fs, path = _files(spark, f"{folder}/marks")
    if not fs.exists(path):
        return spark.createDataFrame([], "id string")
    return spark.read.schema("id string, phase string").json(f"{folder}/marks").where("phase = 'completed'").select("id").distinct()


def current(spark: SparkSession, state: str) -> DataFrame:
    """The last phase of each key over all batches."""
    return latest(spark.read.parquet(state).select("key", "id", "phase", "seq"), ["key"], F.struct("seq", "id"))

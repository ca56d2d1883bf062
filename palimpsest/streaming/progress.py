"""Progress of transcription jobs: watchdog, calibration, projected time, in batch and as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

#: Bounds of the device factor, reading time of the last step in seconds.
LEAST_FACTOR, MOST_FACTOR, TAIL_SECONDS = 0.3, 20.0, 0.3


def silent_gaps(messages: DataFrame, seconds: int) -> DataFrame:
    """Messages (job, seq, ts) that come more than `seconds` after the job's last one, with the gap."""
    w = Window.partitionBy("job").orderBy("ts", "seq")
    gap = F.unix_timestamp("ts") - F.lag(F.unix_timestamp("ts")).over(w)
    return messages.withColumn("gap", gap).where(F.col("gap") > seconds)


def calibrate(paces: DataFrame) -> DataFrame:
    """Per device the running factor over (ts, seq): the first clamped pace, then the mean of old and new."""
    factor = F.greatest(F.lit(LEAST_FACTOR), F.least(F.lit(MOST_FACTOR), F.col("pace")))
    newest = Window.partitionBy("device").orderBy(F.desc("ts"), F.desc("seq"))
    numbered = paces.select("device", factor.alias("f"), F.row_number().over(newest).alias("back"), F.count("*").over(Window.partitionBy("device")).alias("n"))
    # halving again and again gives the k-th newest the weight 1/2^k, and the oldest that of the one after it; beyond 64 nothing counts
    weight = F.pow(F.lit(0.5), F.least(F.col("back"), F.col("n") - 1).cast("double"))
    return numbered.where("back <= 64").groupBy("device").agg(F.sum(F.col("f") * weight).alias("factor"))


def eta(messages: DataFrame, total: int) -> DataFrame:
    """Per job: messages done, elapsed seconds, projected seconds in all at the pace so far."""
    seconds = F.unix_timestamp("ts")
    j = messages.groupBy("job").agg(F.count("*").alias("done"), (F.max(seconds) - F.min(seconds)).alias("elapsed"))
    return j.withColumn("eta", F.col("elapsed") + (total - F.col("done")) * F.col("elapsed") / F.col("done") + TAIL_SECONDS)


def latest_only(messages: DataFrame, key: str, job: str) -> DataFrame:
    """Messages of each key's latest job; stale ones are dropped."""
    return messages.withColumn("_last", F.max(job).over(Window.partitionBy(key))).where(F.col(job) == F.col("_last")).drop("_last")


def stream_counts(messages: DataFrame, delay: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Streaming: messages per job and window of event time, late ones dropped after the delay."""
    return messages.withWatermark("ts", delay).groupBy(F.window("ts", every), "job").agg(F.count("*").alias("n"))


def read_arriving(spark, folder: str, glob: str = "*", most: int = 1000):
    """Streaming source of image files as they arrive, so many a batch at most."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return files.option("pathGlobFilter", glob).option("maxFilesPerTrigger", most).load(folder)


def for_each_batch(stream: DataFrame, read: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Read every arriving batch with `read` and append the result to Parquet, then stop."""
    return stream.writeStream.foreachBatch(lambda df, _: read(df).write.mode("append").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Seconds of silence after which a job is given up, and for detailed images.
PATIENCE, PATIENCE_DETAIL = 120, 180
FIRED = "job string, messages long, fired boolean"


def watch(key, batches, state, seconds: int = PATIENCE):
    """One job of the watchdog: counts its messages, and fires when none comes for so many seconds."""
    import pandas as pd

    seen = state.get[0] if state.exists else 0
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame({"job": [key[0]], "messages": [seen], "fired": [True]})
        return
    seen += sum(len(b) for b in batches)
    state.update((seen,))
    state.setTimeoutDuration(seconds * 1000)
    yield pd.DataFrame({"job": [key[0]], "messages": [seen], "fired": [False]})


def watchdog(messages: DataFrame, seconds: int = PATIENCE) -> DataFrame:
    """Streaming: per job the number of messages so far, and a row with fired when it has been silent too long."""

    def run(key, batches, state):
        return watch(key, batches, state, seconds)

    return messages.groupBy("job").applyInPandasWithState(run, FIRED, "seen long", "update", "ProcessingTimeTimeout")


def run_watchdog(messages: DataFrame, out: str, checkpoint: str, seconds: int = PATIENCE, every: str = "1 second"):
    """Start the watchdog on a stream of messages (job): what it tells is kept in out, one folder a batch; returns the running query.

    Counts and timers live in the checkpoint, so a query that is stopped, or whose executors are lost, goes on where it was: a job that fell
    silent meanwhile fires once, and a batch that is done again overwrites its own folder.
    """
    told = watchdog(messages, seconds)
    keep = lambda df, number: df.write.mode("overwrite").json(f"{out}/batch={number}")
    return told.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def phases(lines: DataFrame) -> DataFrame:
    """Progress rows (job, seq, phase, i, total) of pages with their lines: prepare, lines, then one row a line."""
    whole = lines.groupBy("job").agg(F.count("*").cast("int").alias("total"))
    start = whole.select("job", F.lit(0).alias("seq"), F.lit("prepare").alias("phase"), F.lit(0).alias("i"), "total")
    found = whole.select("job", F.lit(1).alias("seq"), F.lit("lines").alias("phase"), F.lit(0).alias("i"), "total")
    number = F.row_number().over(Window.partitionBy("job").orderBy("line"))
    each = lines.select("job", number.alias("i")).join(whole, "job").select("job", (F.col("i") + 1).alias("seq"), F.lit("line").alias("phase"), "i", "total")
    return start.unionByName(found).unionByName(each)

"""Queue operations as table transforms: picking, claiming, retrying, repairing, cleaning.

A single driver assigns work, so claiming is a read followed by an upsert of the claimed rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapframe.operators.upsert import upsert

# The stages in their order.
STAGES = (
    "metadata", "download", "authenticity_check", "whistle_detection", "frame_extraction", "motion_compensation", "play_detection", "detection",
    "tracking", "pose", "torso_crop", "role_classification", "jersey_ocr", "rep_extraction", "biomechanics", "complete",
)
MAX_RETRIES = 3
RETRYABLE_ERRORS = ("FirestoreError", "DependencyError", "QueueError")


def stage_rank(stage: Column, stages: Sequence[str] = STAGES) -> Column:
    """Position in the stage order; unknown stages come last."""
    return F.coalesce(F.create_map(*(F.lit(x) for i, s in enumerate(stages) for x in (s, i)))[stage], F.lit(len(stages)))


def next_stage(stage: Column, enabled: Sequence[str] = STAGES) -> Column:
    """The enabled stage after a stage; null after the last."""
    following = dict(zip(enabled, enabled[1:], strict=False))
    return F.create_map(*(F.lit(x) for kv in following.items() for x in kv))[stage]


def pick_next(queue: DataFrame, group: Sequence[str], rank: str, priority: str, created: str, tie: str, n: int = 1) -> DataFrame:
    """Earliest stage of each group, then highest priority, then oldest: the first n."""
    first = F.row_number().over(Window.partitionBy(*group).orderBy(rank, F.desc(priority), created, tie))
    heads = queue.withColumn("_first", first).filter("_first = 1").drop("_first")
    return heads.orderBy(F.desc(priority), created, tie).limit(n)


def siblings(queue: DataFrame, where: Column, order: Sequence[str], n: int) -> DataFrame:
    return queue.filter(where).orderBy(*order).limit(n)


def with_status(rows: DataFrame, status: str, created: str, tie: str, n: int = 50) -> DataFrame:
    """The n oldest rows of a status."""
    return rows.filter(F.col("status") == status).orderBy(created, tie).limit(n)


def by_priority(queue: DataFrame, priority: int, created: str, tie: str, n: int = 10) -> DataFrame:
    """The n oldest jobs of a priority."""
    return queue.filter(F.col("priority") == priority).orderBy(created, tie).limit(n)


def clamp_priority(priority: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(10), priority))


def batches(df: DataFrame, keys: Sequence[str], order: str, most: int = 6) -> DataFrame:
    """Number the jobs of each group, at most `most` rows to a job."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return df.withColumn("batch", F.floor(i / most).cast("int"))


def after_failure(retries: Column, most: Column) -> Column:
    """(status, retries) after a failed attempt: queued again until retries are used up."""
    used = retries + 1
    return F.struct(F.when(used >= most, "failed").otherwise("queued").alias("status"), used.alias("retry_count"))


def is_retryable(error: Column) -> Column:
    """Whether an error's exact kind is a passing one; null kinds are not."""
    return F.coalesce(error.isin(*RETRYABLE_ERRORS), F.lit(False))


def count_attempts(attempts: DataFrame, tries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, attempt: every row of `tries` adds one to its key, null keys being equal."""
    every = attempts.select(*keys, "attempt").unionByName(tries.select(*keys, F.lit(1).alias("attempt")))
    return every.groupBy(*keys).agg(F.sum("attempt").alias("attempt"))


def mark_completed(queue: DataFrame, done: DataFrame, key: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """The finished jobs, with status and time set, and the queue without them.

    Both come from the same keys, so no completed row stays in the queue. Ids that the queue
    lacks change nothing.
    """
    ids = done.select(key).distinct()
    finished = queue.join(ids, key, "left_semi").withColumn("status", F.lit("completed")).withColumn("completed_at", at)
    return finished.select(*queue.columns, *{"status", "completed_at"}.difference(queue.columns)), queue.join(ids, key, "left_anti")


def propagate_failures(failed: DataFrame, stages: DataFrame, plays: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stages, plays and videos after jobs (video_id, stage_name, play_index, error) failed for good.

    The job's stage fails, or is added as failed; then its play, or, for a job without play, its
    video. Columns of stages: video_id, stage_name, play_index, status, error; of plays: video_id,
    play_index, status; of videos: video_id, status. Further columns are kept.
    """
    keys = ["video_id", "stage_name", "play_index"]
    status = F.lit("failed").alias("status")
    changes = failed.groupBy(*keys).agg(F.max("error").alias("error")).withColumn("status", F.lit("failed"))
    of_plays = failed.filter("play_index IS NOT NULL").select("video_id", "play_index").distinct()
    of_videos = failed.filter("play_index IS NULL").select("video_id").distinct()
    mark = lambda df, keys, gone: df.join(gone.withColumn("_gone", F.lit(True)), keys, "left").withColumn("status", F.when(F.col("_gone"), status).otherwise(F.col("status"))).select(*df.columns)
    return upsert(stages, changes, keys[:2], keys[2:]), mark(plays, ["video_id", "play_index"], of_plays), mark(videos, ["video_id"], of_videos)


def settle_failures(failed: DataFrame, stages: DataFrame, plays: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As propagate_failures, and a video whose last unresolved play has failed is completed by those that did not fail.

    Only videos of the failed jobs are looked at; one that has failed itself stays failed.
    """
    stages, plays, videos = propagate_failures(failed, stages, plays, videos)
    hit = failed.filter("play_index IS NOT NULL").select("video_id").distinct()
    over = finalise(plays.join(hit, "video_id", "left_semi"), "video_id", "status").select("video_id", F.lit(True).alias("_over"))
    done = F.when(F.coalesce("_over", F.lit(False)) & ~F.col("status").eqNullSafe("failed"), "completed").otherwise(F.col("status"))
    return stages, plays, videos.join(over, "video_id", "left").withColumn("status", done).select(*videos.columns)


def repairs(videos: DataFrame, queue: DataFrame) -> DataFrame:
    """Jobs that a watchdog adds for videos without any queue entry: video_id, stage, priority, reason.

    A pending video starts over with its metadata; one that stopped after its download, or while it was
    processed, is downloaded again. Completed and failed videos need nothing.
    """
    stuck = videos.join(queue.select("video_id").distinct(), "video_id", "left_anti")
    stage = F.when(F.col("status") == "pending", "metadata").when(F.col("status").isin("downloaded", "processing"), "download")
    reason = F.when(F.col("status") == "pending", "pending with no queue entry").otherwise(F.concat(F.lit("orphaned ("), F.col("status"), F.lit(")")))
    return stuck.select("video_id", stage.alias("stage"), F.lit(7).alias("priority"), reason.alias("reason")).filter("stage IS NOT NULL")


def cleanup(videos: DataFrame, queue: DataFrame, now: Column, minutes: float = 60, dry_run: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is done about videos pending for more than `minutes` (video_id, age_minutes, queue_exists, action), and the videos and queue left.

    A dry run leaves both as they are. Videos without a creation time are left alone.
    """
    age = (F.unix_micros(now) - F.unix_micros("created_at")) / 60_000_000
    old = videos.filter(F.col("status") == "pending").select("video_id", F.round(age, 1).alias("age_minutes"), age.alias("_age")).filter(F.col("_age") > minutes).drop("_age")
    entries = queue.select("video_id", F.lit(True).alias("queue_exists")).distinct()
    found = old.join(entries, "video_id", "left").select("video_id", "age_minutes", F.coalesce("queue_exists", F.lit(False)).alias("queue_exists"), F.lit("would_delete" if dry_run else "deleted").alias("action"))
    if dry_run:
        return found, videos, queue
    gone = found.select("video_id")
    return found, videos.join(gone, "video_id", "left_anti"), queue.join(gone, "video_id", "left_anti")


def unclaimed(videos: DataFrame, claimed: str, created: str, now: Column, hours: float) -> DataFrame:
    """Videos that nobody has claimed within `hours`."""
    return stale(videos, F.col(claimed).isNull(), created, now, hours * 60)


def backoff_seconds(attempt: Column) -> Column:
    return 0.1 * F.pow(F.lit(2.0), attempt - 1)


def stalled(df: DataFrame, stage: str, started: str, now: Column, timeouts: Mapping[str, int], default: int) -> DataFrame:
    """Processing rows that have outrun their stage's time limit in seconds."""
    limit = F.coalesce(F.create_map(*(F.lit(x) for kv in timeouts.items() for x in kv))[F.col(stage)], F.lit(default)) if timeouts else F.lit(default)
    return df.filter((F.unix_micros(now) - F.unix_micros(F.col(started))) / 1_000_000 > limit)


def stale(df: DataFrame, status: Column, created: str, now: Column, minutes: float) -> DataFrame:
    return df.filter(status & (F.unix_micros(now) - F.unix_micros(F.col(created)) > minutes * 60_000_000))


def ingest_decision(status: Column, queued: Column) -> Column:
    """What a new submission leads to, from the video's status (null if unknown) and its queue entry."""
    return (
        F.when(status.isNull(), "queued")
        .when(status == "completed", "already_processed")
        .when(status == "processing", "already_queued")
        .when((status == "pending") & queued, "already_queued")
        .when(status == "pending", "recovery_enqueue")
        .when(status == "failed", "retry_enqueue")
        .otherwise("queued")
    )


def finalise(plays: DataFrame, video: str, status: str, resolved: Sequence[str] = ("completed", "failed")) -> DataFrame:
    """Videos of which no play with a known status is still unresolved."""
    left = F.count_if(F.col(status).isNotNull() & ~F.col(status).isin(*resolved))
    return plays.groupBy(video).agg(left.alias("unresolved"), F.count(F.lit(1)).alias("plays")).filter("unresolved = 0").drop("unresolved")


def archive(videos: DataFrame, completed: str, now: Column, days: int) -> DataFrame:
    """archived set on videos completed more than `days` ago."""
    old = F.unix_micros(now) - F.unix_micros(F.col(completed)) > days * 86_400_000_000
    return videos.withColumn("archived", F.coalesce(old, F.lit(False)))


def bottlenecks(stages: DataFrame, name: str, seconds: str) -> DataFrame:
    """Stages by falling time, with their share of the total and a tier."""
    share = F.col(seconds) / F.sum(seconds).over(Window.partitionBy()) * 100
    rank = F.rank().over(Window.orderBy(F.desc(seconds)))
    tier = F.when(F.col("share_pct") >= 30, "critical").when(F.col("share_pct") >= 10, "major").otherwise("minor")
    return stages.select(name, seconds, share.alias("share_pct"), rank.alias("rank")).withColumn("tier", tier)

"""From pose frames to graded reps, and the read views over the results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapframe.functions.geometry import is_spike, torso_centre
from snapframe.functions.scores import letter
from snapframe.operators import features, joins, rollup, sequences
from snapframe.sources.buckets import BucketTable

TRACK = ["video_id", "play_index", "track_id"]
REP = [*TRACK, "rep_index"]
FPS = 15


def extract_reps(pose: DataFrame) -> DataFrame:
    """Reps of every track: its path is cut at its transitions; frames are those of the rows at the cuts."""
    keyed = pose.withColumn("play_key", F.coalesce("play_index", F.lit(-1))).withColumn("track_key", F.coalesce("track_id", F.lit(-1)))
    keys = ["video_id", "play_key", "track_key"]
    rows = sequences.position(keyed.withColumn("c", torso_centre(F.col("landmarks"))).select(*keys, "frame_index", F.col("c.x").alias("x"), F.col("c.y").alias("y")), keys, "frame_index", "i")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    cuts = sequences.transitions(rows.drop("i"), keys, "frame_index", "x", "y")
    spans = sequences.segments_between(cuts.join(sizes, keys).filter(F.col("position") < F.col("n")).drop("n"), sizes, keys)
    at = lambda c, n: rows.select(*keys, F.col("i").cast("long").alias(c), F.col("frame_index").alias(n))
    named = spans.join(at("start", "start_frame"), [*keys, "start"]).join(at("end", "end_frame"), [*keys, "end"])
    null = lambda c: F.when(F.col(c) >= 0, F.col(c))
    return named.select(
        "video_id", F.col("segment_index").alias("rep_index"), null("track_key").alias("track_id"), null("play_key").alias("play_index"), "start_frame", "end_frame",
        (F.col("end") - F.col("start") + 1).cast("int").alias("duration_frames"), ((F.col("end") - F.col("start") + 1) / FPS).alias("duration_seconds"),
    )


def analyse(reps: DataFrame, pose: DataFrame) -> DataFrame:
    """Traits, buckets and grade of every rep; the frames of all reps come from one range join."""
    return _scored(reps, features.rep_features(_frames(reps, pose), REP))


def _frames(reps: DataFrame, pose: DataFrame) -> DataFrame:
    return joins.frames_of_reps(reps.select(*REP, "start_frame", "end_frame"), pose.select("video_id", "play_index", "track_id", "frame_index", "landmarks"))


def _scored(reps: DataFrame, found: DataFrame) -> DataFrame:
    """Every rep scored, those without features too."""
    keyed = found.select(*(F.col(k).alias(f"f_{k}") for k in REP), "features")
    on = [reps["video_id"] == keyed["f_video_id"], reps["rep_index"] == keyed["f_rep_index"], reps["play_index"].eqNullSafe(keyed["f_play_index"]), reps["track_id"].eqNullSafe(keyed["f_track_id"])]
    joined = reps.join(keyed, on[0] & on[1] & on[2] & on[3], "left").select(*(reps[k] for k in REP), "features")
    return features.score_reps(joined, REP)


class RunningAnalysis:
    """The analysis of given reps as their frames arrive, from a state of sums, extremes and the last frame of each rep.

    A batch of frames is summed up by rep, with each rep's last frame before it to step from, and
    merged into the states of those reps alone; frames seen before are not read again. After
    every batch `current` equals `analyse` over all frames so far. A rep's frames must arrive in order
    from batch to batch. The states are a bucketed table whose versions are the batch numbers, so a
    batch that is repeated after a crash counts once.
    """

    def __init__(self, reps: DataFrame, path: str):
        keys = ", ".join(f"{k} {reps.schema[k].dataType.simpleString()}" for k in REP)
        self.reps = reps
        self.states = BucketTable(reps.sparkSession, path, f"{keys}, {features.PARTIALS}, batch long", ["video_id", "rep_index"], ["play_index", "track_id"])

    def update(self, frames: DataFrame, batch: int) -> None:
        """Count a batch of pose frames; fits foreachBatch."""
        names = [p for p in self.states.read().columns if p not in (*REP, "batch")]
        states = self.states.read().select(*REP, F.struct(*names).alias("_old"))
        fresh = _frames(self.reps, frames).select(*REP, "frame_index", "landmarks", F.lit(False).alias("_seen"))
        touched = joins.existing_in(states, fresh.select(*REP).distinct(), ["video_id", "rep_index"], ["play_index", "track_id"])
        carried = touched.select(*REP, F.col("_old.last.frame_index").alias("frame_index"), F.col("_old.last.landmarks").alias("landmarks"), F.lit(True).alias("_seen"))
        partials = features.rep_partials(fresh.unionByName(carried), REP, "_seen")
        named = partials.select(*(F.col(k).alias(f"n_{k}") for k in REP), F.struct(*names).alias("_new"))
        on = (F.col("video_id") == F.col("n_video_id")) & (F.col("rep_index") == F.col("n_rep_index")) & F.col("play_index").eqNullSafe(F.col("n_play_index")) & F.col("track_id").eqNullSafe(F.col("n_track_id"))
        merged = named.join(states, on, "left").select(*(F.col(f"n_{k}").alias(k) for k in REP), *features.merge_partials("_old", "_new"), F.lit(batch).cast("long").alias("batch"))
        self.states.upsert(merged, batch, "batch")

    def current(self) -> DataFrame:
        """Traits, buckets and grade of every rep from the frames so far; reps without any score 0."""
        return _scored(self.reps, features.finished_features(self.states.read(), REP))


def grade_videos(analysis: DataFrame) -> DataFrame:
    return rollup.grade_of(analysis, ["video_id"], "overall_grade")


def provisional(pose: DataFrame) -> DataFrame:
    """The analysis of whatever frames are there so far; the final one is the same over all frames."""
    return analyse(extract_reps(pose), pose)


def play_boundaries(camera: DataFrame, reads: DataFrame, lasts: DataFrame, near: float = 3 * FPS, merge: float = 5 * FPS) -> DataFrame:
    """Plays of each video as contiguous frame ranges from camera spikes and scoreboard changes.

    `camera` has video_id, frame_index, translation_x/y, rotation_deg and low_confidence; `reads`
    video_id, frame_index, down_distance, quarter and seconds; `lasts` video_id and last.
    """
    spikes = camera.filter(is_spike(F.col("translation_x"), F.col("translation_y"), F.col("rotation_deg"), F.col("low_confidence")))
    cuts = sequences.thin(spikes.select("video_id", "frame_index"), ["video_id"], "frame_index", near)
    changes = sequences.debounce(reads, ["video_id"], "frame_index", "down_distance")
    changes = sequences.reject_replays(changes, ["video_id"], "frame_index", "quarter", "seconds").select("video_id", "frame_index")
    merged = sequences.merge_candidates([cuts, changes], ["video_id"], "frame_index", merge)
    return sequences.ranges(merged, lasts, ["video_id"], "frame_index").withColumnRenamed("index", "play_index")


def analysis_view(analysis: DataFrame, reps: DataFrame, players: DataFrame, track_id: int | None = None, player_id: str | None = None) -> DataFrame:
    """Analyses with frames and player, of one player or track if given; the player takes precedence."""
    view = joins.join_players(joins.join_analysis(analysis, reps), players).withColumn("letter", letter(F.col("overall_grade")))
    if player_id is not None:
        return view.filter(F.col("player_id") == player_id)
    return view.filter(F.col("track_id") == track_id) if track_id is not None else view


def plays_view(plays: DataFrame, video_id: str) -> DataFrame:
    """Plays of a video in order, with the address of those clips that are ready."""
    address = F.when(F.col("clip_ready"), F.format_string("/videos/%s/plays/%d/clip", "video_id", "play_index"))
    return plays.filter(F.col("video_id") == video_id).withColumn("clip_url", address).orderBy("play_index")


def route(tracks: DataFrame, track_id: int) -> DataFrame:
    """Ground path of a track; malformed boxes are skipped."""
    box = F.col("bbox")
    rows = tracks.filter((F.col("track_id") == track_id) & (F.size("bbox") == 4))
    return rows.select("video_id", "frame_index", (F.col("frame_index") / FPS).alias("timestamp"), ((box[0] + box[2]) / 2).alias("x"), box[3].alias("y")).orderBy("video_id", "frame_index")

"""Null-safe, range, fallback and matching joins.

Two readings of null must not be mixed up: in a composite key null equals null; on the rep side
of a range join null means "no filter".
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapframe.functions.geometry import iou
from snapframe.session import cut


def same(left: DataFrame, right: DataFrame, keys: Sequence[str], nullable: Sequence[str] = ()) -> Column:
    """Join condition: equal keys, and nullable keys equal with null equal to null."""
    parts = [left[k] == right[k] for k in keys] + [left[k].eqNullSafe(right[k]) for k in nullable]
    return reduce(lambda a, b: a & b, parts)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, nulls being equal: the first by `order`."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_first", first).filter("_first = 1").drop("_first")


def join_analysis(analysis: DataFrame, reps: DataFrame) -> DataFrame:
    """rep_analysis with the frames and duration of its rep.

    Matched null-safely on video, rep, track and play. An analysis without track that finds none
    takes the rep of its index alone, the one of the greatest play and track. track_id null
    becomes 0.
    """
    keyed = reps.select(
        "video_id", "rep_index", "track_id", "play_index", F.struct("start_frame", "end_frame", "duration_seconds").alias("exact")
    )
    legacy = latest(reps, ["video_id", "rep_index"], [F.col("play_index").desc_nulls_last(), F.col("track_id").desc_nulls_last(), F.col("start_frame").desc()])
    legacy = legacy.select("video_id", "rep_index", F.struct("start_frame", "end_frame", "duration_seconds").alias("legacy"))
    a = analysis.join(keyed, same(analysis, keyed, ["video_id", "rep_index"], ["track_id", "play_index"]), "left").select(analysis["*"], "exact")
    b = a.join(legacy, same(a, legacy, ["video_id", "rep_index"]), "left").select(a["*"], "legacy")
    rep = F.coalesce("exact", F.when(F.col("track_id").isNull(), F.col("legacy")))
    return b.withColumn("_rep", rep).withColumn("track_id", F.coalesce("track_id", F.lit(0))).select(*analysis.columns, "_rep.*")


def find_reps(wanted: DataFrame, reps: DataFrame) -> DataFrame:
    """The wanted keys (video_id, rep_index, track_id, play_index) with the rep of exactly that key: null only meets null.

    Of several reps of a key the one that starts first counts; the rep's columns are null where there is none.
    """
    rest = [c for c in reps.columns if c not in ("video_id", "rep_index", "track_id", "play_index")]
    first = latest(reps, ["video_id", "rep_index", "track_id", "play_index"], [F.col("start_frame").asc_nulls_last()])
    return wanted.join(first, same(wanted, first, ["video_id", "rep_index"], ["track_id", "play_index"]), "left").select(*(wanted[c] for c in wanted.columns), *(first[c] for c in rest))


def join_players(analysis: DataFrame, players: DataFrame) -> DataFrame:
    """player_id by (video, track, play), or track_0_x."""
    joined = analysis.join(players, same(analysis, players, ["video_id", "track_id"], ["play_index"]), "left")
    return joined.select(analysis["*"], F.coalesce(players["player_id"], F.lit("track_0_x")).alias("player_id"))


SLOT_BITS = 3
SLOT_LEVELS = 11  # 8 ** 11 frames


def slots_of_range(low: Column, high: Column) -> Column:
    """The aligned slots, as structs (level, slot), that make up low..high exactly; none if a bound is null or low > high.

    A slot of level l holds 8 ** l frames. A range of n frames has at most 14 slots in each of
    its log8(n) levels: each level takes the ends that the level above leaves over.
    """
    low, high = low.cast("long"), high.cast("long")
    upto = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))

    def level(n: int) -> Column:
        first = lambda bits: F.shiftright(low + ((1 << bits) - 1), bits)
        after = lambda bits: F.shiftright(high + 1, bits)
        bits, wider = SLOT_BITS * n, SLOT_BITS * (n + 1)
        a, b, up, down = first(bits), after(bits), F.shiftleft(first(wider), SLOT_BITS), F.shiftleft(after(wider), SLOT_BITS)
        own = F.when(first(wider) < after(wider), F.concat(upto(a, up), upto(down, b))).otherwise(upto(a, b)) if n + 1 < SLOT_LEVELS else upto(a, b)
        return F.transform(own, lambda s: F.struct(F.lit(n).alias("level"), s.alias("slot")))

    every = F.concat(*(level(n) for n in range(SLOT_LEVELS)))
    return F.when(low.isNotNull() & high.isNotNull() & (low <= high), every)


def frames_of_reps(reps: DataFrame, pose: DataFrame) -> DataFrame:
    """Every pose frame within a rep's range; a rep without play or track takes all of them.

    Ranges are cut into aligned slots and frames look up their own slot of each level, so both
    sides meet on equal keys only and no pair is made that is not in the result. Play and track are
    part of the key where the rep has them. Only frames' keys look up slots, each distinct one once, for the
    levels and the kinds of keys that the reps use; the rows themselves are joined to the keys that were
    found, so they are shuffled once whatever the number of levels. The levels and kinds are collected first, at most 4 * SLOT_LEVELS rows. The join is a
    sort-merge join: slots are many more than the file that the reps come from lets the engine
    expect, and a broadcast of them would go through the driver.
    """
    kind = F.when(F.col("play_index").isNotNull(), 1).otherwise(0) + F.when(F.col("track_id").isNotNull(), 2).otherwise(0)
    none = F.lit(None).cast("long")
    key = lambda used, c: F.when(used, F.col(c).cast("long")).otherwise(none)
    cut = reps.withColumn("_kind", kind).withColumn("_slot", F.explode(slots_of_range(F.col("start_frame"), F.col("end_frame"))))
    used = [(r["_kind"], r["level"]) for r in cut.select("_kind", "_slot.level").distinct().collect()]
    cells = [F.struct(F.lit(k).alias("kind"), F.lit(n).alias("level"), F.shiftright(F.col("frame_index").cast("long"), SLOT_BITS * n).alias("slot")) for k, n in sorted(used)]
    fits = lambda c: ((c["kind"].bitwiseAND(1) == 0) | F.col("play_index").isNotNull()) & ((c["kind"].bitwiseAND(2) == 0) | F.col("track_id").isNotNull())
    rest = [c for c in pose.columns if c not in reps.columns]
    cells = F.filter(F.array(*cells), fits) if cells else F.array().cast("array<struct<kind:int,level:int,slot:bigint>>")
    point = ["video_id", "frame_index", "play_index", "track_id"]
    points = pose.select(*point).distinct().withColumn("_cell", F.explode(cells)).select(
        *(F.col(c).alias(f"_at_{c}") for c in point), F.col("_cell.kind").alias("_k"), F.col("_cell.level").alias("_l"), F.col("_cell.slot").alias("_s"),
        key(F.col("_cell.kind").bitwiseAND(1) > 0, "play_index").alias("_p"), key(F.col("_cell.kind").bitwiseAND(2) > 0, "track_id").alias("_t"),
    )
    met = (F.col("video_id") == F.col("_at_video_id")) & (F.col("_kind") == F.col("_k")) & (F.col("_slot.level") == F.col("_l")) & (F.col("_slot.slot") == F.col("_s"))
    met = met & F.col("play_index").cast("long").eqNullSafe(F.col("_p")) & F.col("track_id").cast("long").eqNullSafe(F.col("_t"))
    held = points.join(cut.hint("merge"), met).select(*reps.columns, *(f"_at_{c}" for c in point))
    frames = pose.select(*rest, *(F.col(c).alias(f"_of_{c}") for c in point))
    here = reduce(lambda x, y: x & y, (F.col(f"_of_{c}").eqNullSafe(F.col(f"_at_{c}")) if c in point[2:] else F.col(f"_of_{c}") == F.col(f"_at_{c}") for c in point))
    return frames.join(held.hint("merge"), here).select(*reps.columns, *rest)


def missing_from(left: DataFrame, right: DataFrame, keys: Sequence[str], nullable: Sequence[str] = ()) -> DataFrame:
    """Rows of `left` without a partner: what heals, what is new, what was missed."""
    return left.join(right, same(left, right, keys, nullable), "left_anti")


def existing_in(left: DataFrame, right: DataFrame, keys: Sequence[str], nullable: Sequence[str] = ()) -> DataFrame:
    return left.join(right, same(left, right, keys, nullable), "left_semi")


def existence(left: DataFrame, right: DataFrame, key: str, left_name: str, right_name: str) -> DataFrame:
    """Every key of either side and whether each side has it."""
    a = left.select(key).distinct().withColumn(left_name, F.lit(True))
    b = right.select(key).distinct().withColumn(right_name, F.lit(True))
    return a.join(b, key, "full_outer").select(key, *(F.coalesce(c, F.lit(False)).alias(c) for c in (left_name, right_name)))


PAIRS = 1 << 22  # that one piece of a cell compares


def in_pieces(left: DataFrame, right: DataFrame, cell: Sequence[str], pairs: int = PAIRS) -> DataFrame:
    """Rows that share a cell joined on it (an inner join), a crowded cell dealt over as many tasks as its pairs fill pieces.

    The left rows of a cell are dealt to its pieces by hash, its right rows go to each of them. Pieces are shuffled
    by number and not by size: the rows are few, but not the pairs that they make. Both inputs are
    read twice.
    """
    cell = list(cell)
    count = lambda df, name: df.groupBy(*cell).agg(F.count(F.lit(1)).alias(name))
    sizes = count(left, "_l").join(count(right, "_r"), cell).select(*cell, F.least(F.col("_l"), F.ceil(F.col("_l") * F.col("_r") / pairs)).alias("_pieces"))
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.join(sizes, cell).withColumn("_piece", F.pmod(F.xxhash64(*(c for c in left.columns if c not in cell)), F.col("_pieces"))).drop("_pieces")
    given = right.join(sizes, cell).withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))).drop("_pieces")
    keys = [*cell, "_piece"]
    return dealt.repartition(parts, *keys).join(given.repartition(parts, *keys).hint("merge"), keys).drop("_piece")


def within_radius(points: DataFrame, others: DataFrame, keys: Sequence[str], x: str, y: str, radius: float) -> DataFrame:
    """Pairs at most `radius` apart, met over a grid of cells as wide as the radius.

    Points go to their own cell, the others to the nine cells around theirs, so each pair meets once.
    The work of crowded cells is dealt over tasks (`in_pieces`).
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    a = points.select(*(F.col(k) for k in keys), *(F.col(c).alias(f"a_{c}") for c in points.columns if c not in keys), cell(x).alias("_cx"), cell(y).alias("_cy"))
    near = F.sequence(F.lit(-1), F.lit(1))
    b = others.select(*(F.col(k) for k in keys), *(F.col(c).alias(f"b_{c}") for c in others.columns if c not in keys), cell(x).alias("_bx"), cell(y).alias("_by"))
    b = b.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near)).withColumn("_cx", F.col("_bx") + F.col("_dx")).withColumn("_cy", F.col("_by") + F.col("_dy"))
    apart = F.sqrt(F.pow(F.col(f"a_{x}") - F.col(f"b_{x}"), 2) + F.pow(F.col(f"a_{y}") - F.col(f"b_{y}"), 2))
    joined = in_pieces(a, b, [*keys, "_cx", "_cy"]).withColumn("distance", apart).filter(F.col("distance") <= radius)
    return joined.drop("_cx", "_cy", "_bx", "_by", "_dx", "_dy")


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], box: str, other: str, cell: float = 64.0) -> DataFrame:
    """Pairs of a key whose boxes overlap in an area, with the columns of both sides.

    Boxes meet over the grid cells that they cover. A pair counts in the cell of its overlap's
    lower corner only, so each is met once, and the columns besides `keys` must differ.
    """
    span = lambda c, lo, hi: F.explode(F.sequence(F.floor(F.col(c)[lo] / cell), F.floor(F.col(c)[hi] / cell)))
    filled = lambda c: (F.col(c)[2] > F.col(c)[0]) & (F.col(c)[3] > F.col(c)[1])
    on_grid = lambda df, c: df.filter(filled(c)).withColumn("_cx", span(c, 0, 2)).withColumn("_cy", span(c, 1, 3))
    low = [F.greatest(F.col(box)[i], F.col(other)[i]) for i in (0, 1)]
    high = [F.least(F.col(box)[i], F.col(other)[i]) for i in (2, 3)]
    here = (F.floor(low[0] / cell) == F.col("_cx")) & (F.floor(low[1] / cell) == F.col("_cy"))
    met = on_grid(left, box).join(on_grid(right, other), [*keys, "_cx", "_cy"])
    return met.filter(here & (low[0] < high[0]) & (low[1] < high[1])).drop("_cx", "_cy")


def with_roles(boxes: DataFrame, tracks: DataFrame, keys: Sequence[str] = ("video_id", "track_id")) -> DataFrame:
    """Boxes with the role of their track in their play; null where the track is unknown."""
    roles = tracks.groupBy(*keys, "play_index").agg(F.max("role").alias("role"))
    return boxes.join(roles, same(boxes, roles, keys, ["play_index"]), "left").select(boxes["*"], roles["role"])


def with_jerseys(tracks: DataFrame, jerseys: DataFrame, keys: Sequence[str] = ("video_id", "track_id")) -> DataFrame:
    """Tracks with the jersey read in their play, else with the one read for the whole video."""
    read = jerseys.groupBy(*keys, "play_index").agg(F.max("jersey_number").alias("jersey_number"))
    whole = read.filter("play_index IS NULL").select(*keys, F.col("jersey_number").alias("_whole"))
    own = tracks.join(read, same(tracks, read, keys, ["play_index"]), "left").select(tracks["*"], read["jersey_number"].alias("_own"))
    return own.join(whole, list(keys), "left").withColumn("jersey_number", F.coalesce("_own", "_whole")).drop("_own", "_whole")


def players_of_tracks(reps: DataFrame, roster: DataFrame, order: str = "rep_index") -> DataFrame:
    """video_id, track_id, player_id: the roster's name of the jersey, else the jersey itself.

    Of a track's reps with a jersey the last by `order` counts. The roster has one row a jersey;
    it is small, and the engine broadcasts it if its measured size allows.
    """
    worn = reps.filter("track_id IS NOT NULL AND jersey_number <> ''").groupBy("video_id", "track_id").agg(F.max_by("jersey_number", F.struct(order, "jersey_number")).alias("jersey_number"))
    return worn.join(roster.select("jersey_number", "name"), "jersey_number", "left").select("video_id", "track_id", F.coalesce("name", "jersey_number").alias("player_id"))


def frames_with_pose(frames: DataFrame, pose: DataFrame, keys: Sequence[str] = ("video_id", "frame_index")) -> DataFrame:
    """Poses with their frame's columns; poses of frames that are missing are left out."""
    return pose.join(frames.select(*keys, *(c for c in frames.columns if c not in pose.columns)), list(keys))


def tracks_by_frame(tracks: DataFrame, keys: Sequence[str] = ("video_id", "frame_index")) -> DataFrame:
    """Tracks of each frame as one array of (track_id, bbox), by track."""
    return tracks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("track_id", "bbox"))).alias("tracks"))


# --------------------------------------------------------------------------- one-to-one matching


def match_greedily(pairs: DataFrame, keys: Sequence[str], left: str, right: str, order: Sequence[str], ascending: Sequence[bool]) -> DataFrame:
    """Of candidate pairs, best first by numeric columns, those whose two sides are both still free.

    A pair that is the best of both its sides is taken whatever happens elsewhere; pairs that share a side
    with a taken one go. This is repeated until every pair is taken or gone, so the work is split by
    side and not by key, and a key of any size is shared by all tasks. The pairs left are written
    after every other round; as many rounds are needed as pairs wait for one another.
    """
    by = [*((F.col(c) if up else -F.col(c)) for c, up in zip(order, ascending, strict=True)), F.col(left), F.col(right)]
    rank = F.struct(*(c.alias(f"r{i}") for i, c in enumerate(by)))
    left_side, right_side = Window.partitionBy(*keys, left), Window.partitionBy(*keys, right)

    def turn(df: DataFrame) -> DataFrame:
        best = df.withColumn("_left", F.min("_rank").over(left_side)).withColumn("_right", F.min("_rank").over(right_side))
        taken = best.withColumn("_taken", (F.col("_rank") == F.col("_left")) & (F.col("_rank") == F.col("_right")))
        taken = taken.withColumn("_by_right", F.max("_taken").over(right_side)).withColumn("_by_left", F.max("_taken").over(left_side))
        return taken.filter(F.col("_taken") | ~(F.col("_by_left") | F.col("_by_right"))).drop("_left", "_right", "_by_left", "_by_right")

    free, done = pairs.withColumn("_rank", rank).withColumn("_taken", F.lit(False)), []
    while True:
        left_over = cut(turn(turn(free)), "matching")
        done.append(left_over.filter("_taken").select(*pairs.columns))
        free = left_over.filter("NOT _taken")
        if free.isEmpty():
            return reduce(DataFrame.unionByName, done)


def match_boxes(poses: DataFrame, tracks: DataFrame, keys: Sequence[str], least: float = 0.3) -> DataFrame:
    """Pose boxes and track boxes of a frame matched one to one by falling overlap of more than `least`."""
    joined = overlapping(poses.select(*keys, "pose_id", F.col("bbox").alias("_pose")), tracks.select(*keys, "track_id", F.col("bbox").alias("_track")), keys, "_pose", "_track")
    pairs = joined.select(*keys, "pose_id", "track_id", iou(F.col("_pose"), F.col("_track")).alias("iou")).filter(F.col("iou") > least)
    return match_greedily(pairs, keys, "pose_id", "track_id", ["iou", "pose_id", "track_id"], [False, True, True])


def match_times(candidates: DataFrame, truths: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """Candidates, in time order, each matched to the nearest free truth within `tolerance`.

    Both sides have the keys and `at`. The interval join runs over slots of the tolerance's width.
    """
    slot = lambda c: F.floor(c / tolerance)
    a = candidates.select(*keys, F.col("at").alias("candidate"), slot(F.col("at")).alias("_slot"))
    b = truths.select(*keys, F.col("at").alias("truth"), F.explode(F.sequence(slot(F.col("at")) - 1, slot(F.col("at")) + 1)).alias("_slot"))
    pairs = a.join(b, [*keys, "_slot"]).select(*keys, "candidate", "truth", F.abs(F.col("candidate") - F.col("truth")).alias("apart")).filter(F.col("apart") <= tolerance)
    return match_greedily(pairs, keys, "candidate", "truth", ["candidate", "apart", "truth"], [True, True, True])

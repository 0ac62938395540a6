"""Sequence operators over the events of each user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapframe.operators import audio, sequences
from snapframe.plans.registry import query
from snapframe.session import cut, scratch, table
from snapframe.streaming.audio import whistle_stream

KEYS = ["user_id"]
STATIC = 250.0


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select("event_id", "user_id", micros.alias("micros"), "event_type", "value")


def of_type(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return events(spark, sf_dir).filter(F.col("event_type") == kind)


@query("SELECT event_id, user_id, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) > 100, false) AS moving FROM events")
def motion_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.motion_mask(events(spark, sf_dir), KEYS, "event_id", "value", 100.0).select("event_id", "user_id", "moving")


@query("""
    WITH f AS (SELECT user_id, event_id, value < 250 AS s FROM events),
    c AS (SELECT *, CASE WHEN s IS DISTINCT FROM lag(s) OVER w THEN 1 ELSE 0 END AS ch, row_number() OVER w AS rn FROM f WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    r AS (SELECT *, sum(CASE WHEN rn = 1 THEN 1 ELSE ch END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM c)
    SELECT user_id, s AS static, min(event_id) AS first, max(event_id) AS last, count(*) AS rows FROM r GROUP BY user_id, run, s""")
def static_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.islands(events(spark, sf_dir).withColumn("static", F.col("value") < STATIC), KEYS, "event_id", "static")


@query("""
    WITH RECURSIVE f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value < 400 AS s FROM events),
    n AS (SELECT user_id, count(*) AS n FROM f GROUP BY ALL),
    w AS (
        SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS start, CASE WHEN s THEN 1 ELSE 0 END AS run, NULL::BIGINT AS a, NULL::BIGINT AS b FROM f WHERE i = 0
        UNION ALL
        SELECT f.user_id, f.i, CASE WHEN f.s AND (w.run + 1) % 5 = 0 THEN f.i ELSE w.start END, CASE WHEN f.s THEN w.run + 1 ELSE 0 END,
               CASE WHEN f.s AND (w.run + 1) % 5 = 0 AND f.i - w.start >= 4 AND w.start < f.i - 5 THEN w.start END, CASE WHEN f.s AND (w.run + 1) % 5 = 0 THEN f.i - 5 END
        FROM w JOIN f ON f.user_id = w.user_id AND f.i = w.i + 1),
    seg AS (
        SELECT user_id, a AS start, b AS "end" FROM w WHERE a IS NOT NULL
        UNION ALL SELECT w.user_id, w.start, w.i FROM w JOIN n ON w.user_id = n.user_id AND w.i = n.n - 1 WHERE w.i - w.start >= 4)
    SELECT user_id, start, "end", "end" - start + 1 AS duration FROM seg WHERE "end" - start + 1 BETWEEN 4 AND 300""")
def static_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("static", F.col("value") < 400)
    found = sequences.static_segments(rows, KEYS, "event_id", "static", gap=5, least=4)
    return found.select("user_id", *(F.col(c).cast("long").alias(c) for c in ("start", "end", "duration")))


@query("""
    WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value AS x, CAST(floor(epoch(ts)) AS BIGINT) % 1000 AS y FROM events),
    d AS (SELECT user_id, i, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) AS d FROM p WINDOW w AS (PARTITION BY user_id ORDER BY i)),
    s AS (SELECT user_id, i, abs(d - sum(d) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5) AS off FROM d WHERE d IS NOT NULL),
    l AS (SELECT *, avg(off) OVER (PARTITION BY user_id) + stddev_pop(off) OVER (PARTITION BY user_id) AS lim FROM s)
    SELECT user_id, i + 2 AS position FROM l WHERE off > lim""")
def path_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "event_id", F.col("value").alias("x"), (F.floor(F.col("micros") / 1_000_000) % 1000).cast("double").alias("y"))
    return sequences.transitions(rows, KEYS, "event_id", "x", "y").select("user_id", F.col("position").cast("long").alias("position"))


@query("""
    WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, event_type FROM events),
    n AS (SELECT user_id, count(*) AS n FROM p GROUP BY ALL),
    b AS (SELECT user_id, 0 AS "at" FROM n UNION SELECT user_id, n - 1 FROM n UNION SELECT user_id, i FROM p WHERE event_type = 'error'),
    c AS (SELECT user_id, "at" AS start, lead("at") OVER (PARTITION BY user_id ORDER BY "at") AS "end" FROM b),
    k AS (SELECT c.* FROM c JOIN n USING (user_id) WHERE "end" IS NOT NULL AND "end" - start + 1 >= 6 AND n >= 6),
    f AS (SELECT * FROM k UNION ALL SELECT user_id, 0, n - 1 FROM n WHERE user_id NOT IN (SELECT user_id FROM k))
    SELECT user_id, start, "end", row_number() OVER (PARTITION BY user_id ORDER BY start) - 1 AS segment_index FROM f""")
def rep_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences.position(events(spark, sf_dir), KEYS, "event_id", "i")
    sizes = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    cuts = rows.filter(F.col("event_type") == "error").select("user_id", F.col("i").alias("position"))
    return sequences.segments_between(cuts, sizes, KEYS, least=6).withColumn("segment_index", F.col("segment_index").cast("long"))


def _thin_sql(source: str, gap: int) -> str:
    return f"""
    WITH RECURSIVE c AS ({source}),
    k AS (
        SELECT user_id, min("at") AS "at" FROM c GROUP BY user_id
        UNION ALL
        SELECT user_id, "at" FROM (SELECT c.user_id, min(c."at") AS "at" FROM k JOIN c ON c.user_id = k.user_id AND c."at" - k."at" > {gap} GROUP BY c.user_id, k."at"))
    SELECT user_id, "at" FROM k"""


@query(_thin_sql('''SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS "at" FROM events WHERE event_type = 'error' ''', 86400))
def thinned_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = of_type(spark, sf_dir, "error").select("user_id", F.floor(F.col("micros") / 1_000_000).alias("at"))
    return sequences.thin(rows, KEYS, "at", 86400)


@query(_thin_sql('''SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS "at" FROM events WHERE event_type IN ('error', 'signup')''', 50000))
def merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = [of_type(spark, sf_dir, k).select("user_id", F.floor(F.col("micros") / 1_000_000).alias("at")) for k in ("error", "signup")]
    return sequences.merge_candidates(lists, KEYS, "at", 50000)


@query("""
    WITH l AS (SELECT user_id, max(event_id) AS last FROM events GROUP BY ALL), p AS (SELECT user_id, event_id AS "at" FROM events WHERE event_type = 'signup')
    SELECT l.user_id, row_number() OVER w - 1 AS index, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE "at" END AS start, coalesce(lead("at") OVER w - 1, last) AS "end"
    FROM l LEFT JOIN p USING (user_id) WINDOW w AS (PARTITION BY l.user_id ORDER BY "at")""")
def play_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lasts = events(spark, sf_dir).groupBy("user_id").agg(F.max("event_id").alias("last"))
    points = of_type(spark, sf_dir, "signup").select("user_id", F.col("event_id").alias("at"))
    return sequences.ranges(points, lasts, KEYS, "at").withColumn("index", F.col("index").cast("long"))


@query("""
    WITH v AS (SELECT user_id, event_id, CASE WHEN event_type <> 'view' THEN CASE WHEN event_type IN ('click', 'signup') THEN 'a' ELSE 'b' END END AS v FROM events),
    m AS (SELECT *, row_number() OVER w > 1 AND v IS NOT DISTINCT FROM lag(v) OVER w AS sure FROM v WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    g AS (SELECT *, count(*) FILTER (sure) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM m),
    n AS (SELECT *, first(v) OVER (PARTITION BY user_id, g ORDER BY event_id) AS fv FROM g),
    s AS (SELECT *, CASE WHEN g > 0 THEN fv END AS now FROM n),
    b AS (SELECT *, lag(now) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM s)
    SELECT user_id, event_id, v FROM b WHERE now IS NOT NULL AND now IS DISTINCT FROM before""")
def debounced_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_type") != "view", F.when(F.col("event_type").isin("click", "signup"), "a").otherwise("b"))
    return sequences.debounce(events(spark, sf_dir).select("user_id", "event_id", v.alias("v")), KEYS, "event_id", "v")


@query("""
    WITH c AS (SELECT user_id, event_id, CASE WHEN event_type <> 'view' THEN event_id // 2500 END AS q, CASE WHEN event_type <> 'view' THEN 900 - CAST(floor(value) AS INT) END AS s FROM events),
    k AS (SELECT *, q * 10000 - s AS key FROM c),
    m AS (SELECT *, max(key) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM k)
    SELECT user_id, event_id FROM m WHERE key IS NULL OR latest IS NULL OR key >= latest""")
def replays_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = F.col("event_type") != "view"
    rows = events(spark, sf_dir).select("user_id", "event_id", F.when(read, F.floor(F.col("event_id") / 2500)).alias("q"), F.when(read, 900 - F.floor("value").cast("int")).alias("s"))
    return sequences.reject_replays(rows, KEYS, "event_id", "q", "s").select("user_id", "event_id")


@query("""
    WITH h AS (SELECT user_id, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS slot, min(value) AS v FROM events GROUP BY ALL),
    s AS (SELECT user_id, unnest(generate_series(min(slot), max(slot))) AS slot FROM h GROUP BY user_id)
    SELECT s.user_id, s.slot, last_value(h.v IGNORE NULLS) OVER (PARTITION BY s.user_id ORDER BY s.slot) AS v, h.v IS NOT NULL AS known FROM s LEFT JOIN h USING (user_id, slot)""")
def held_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("micros") / 21_600_000_000).alias("slot")).agg(F.min("value").alias("v"))
    return sequences.hold_last(slots, KEYS, "slot", "v")


@query("""
    WITH h AS (SELECT user_id, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS slot FROM events GROUP BY ALL),
    s AS (SELECT user_id, max(slot) - min(slot) + 1 AS n, count(*) AS k FROM h GROUP BY ALL)
    SELECT user_id, round(k / n, 6) AS coverage, k / n >= 0.4 AS usable FROM s""")
def box_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.coverage(held_values(spark, sf_dir), KEYS, 0.4).withColumn("coverage", F.round("coverage", 6))


@query("""
    WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, event_id FROM p WHERE n <= 10 OR list_contains([k * n // 10 FOR k IN range(10)], i)""")
def sampled_evenly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.sample_evenly(events(spark, sf_dir), KEYS, "event_id", 10).select("user_id", "event_id")


@query("SELECT user_id, event_id FROM events QUALIFY (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 4 = 0")
def sampled_by_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.sample_stride(events(spark, sf_dir), KEYS, "event_id", 18.0, 4.0).select("user_id", "event_id")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 86400) ORDER BY ts) = 1")
def sampled_by_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("seconds", F.col("micros") / 1_000_000)
    return sequences.sample_rate(rows, KEYS, "seconds", 1 / 86400).select("user_id", "event_id")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS smooth FROM events")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.moving_average(events(spark, sf_dir), KEYS, "event_id", "value").select("event_id", F.round("smooth", 6).alias("smooth"))


@query("""
    WITH h AS (SELECT user_id, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS slot, min(value) AS v FROM events GROUP BY ALL)
    SELECT user_id, slot, CASE WHEN lag(slot) OVER w = slot - 1 THEN greatest(0, lag(v) OVER w - v) END AS shrink FROM h WINDOW w AS (PARTITION BY user_id ORDER BY slot)""")
def gap_shrinkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("micros") / 21_600_000_000).alias("slot")).agg(F.min("value").alias("v"))
    return sequences.shrinkage(slots, KEYS, "slot", "v").select("user_id", "slot", "shrink")


@query("""
    WITH RECURSIVE f AS (
        SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CASE WHEN event_type <> 'view' THEN value END AS v FROM events),
    w AS (
        SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0 AS streak, 7 AS since, false AS hit FROM (SELECT DISTINCT user_id FROM f)
        UNION ALL
        SELECT f.user_id, f.i, f.event_id,
               CASE WHEN v IS NULL THEN streak WHEN v <= 300 THEN streak + 1 ELSE 0 END,
               CASE WHEN v >= 400 AND streak >= 2 AND since + 1 >= 7 THEN 0 ELSE since + 1 END,
               coalesce(v >= 400 AND streak >= 2 AND since + 1 >= 7, false)
        FROM w JOIN f ON f.user_id = w.user_id AND f.i = w.i + 1)
    SELECT user_id, event_id FROM w WHERE hit""")
def calm_then_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("v"))
    return sequences.bursts(rows, KEYS, "event_id", "v", calm=300, burst=400, streak=2, cooldown=7)


@query("""
    WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value - 250 AS v FROM events)
    SELECT user_id, CAST(i // 8 AS BIGINT) AS frame, round(avg(v * v), 8) AS energy FROM p GROUP BY ALL HAVING count(*) = 8""")
def short_time_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences.position(events(spark, sf_dir), KEYS, "event_id", "i").withColumn("v", F.col("value") - 250)
    return audio.short_time_energy(rows, KEYS, "i", "v", 8).withColumn("energy", F.round("energy", 8))


@query("""
    WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value - 250 AS v FROM events),
    e AS (SELECT user_id, CAST(i // 8 AS BIGINT) AS frame, round(avg(v * v), 8) AS energy FROM p GROUP BY ALL HAVING count(*) = 8),
    l AS (SELECT user_id, greatest(quantile_cont(energy, 0.75), 15000) AS lim FROM e GROUP BY ALL),
    k AS (SELECT e.*, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS run FROM e JOIN l USING (user_id) WHERE energy > lim)
    SELECT user_id, min(frame) AS first, max(frame) AS last, count(*) AS rows FROM k GROUP BY user_id, run""")
def energy_peak_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.peak_runs(audio.energy_peaks(short_time_energy(spark, sf_dir), KEYS, 0.75, 15000.0), KEYS, "frame")


@query("""
    SELECT event_id, round(least(1, greatest(0, 0.40::DOUBLE * (value / 500) + 0.35::DOUBLE * (event_type = 'error')::INT + 0.25::DOUBLE * (value * 10 BETWEEN 2000 AND 4000)::INT)), 6) AS confidence FROM events""")
def fused_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    loud = (F.col("event_type") == "error").cast("double")
    return events(spark, sf_dir).select("event_id", F.round(audio.fuse(F.col("value") / 500, loud, F.col("value") * 10), 6).alias("confidence"))


@query("SELECT event_id FROM events WHERE value / 490 >= 0.5 AND (event_id % 50) / 20.0 BETWEEN 0.05 AND 2.0")
def plausible_whistles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", (F.col("value") / 490).alias("confidence"), (F.col("event_id") % 50 / F.lit(20.0)).alias("duration"))
    return audio.plausible(rows).select("event_id")


def _merge_sql(source: str, gap: float) -> str:
    """Events folded in order of time, each into the last one if it is near."""
    near, half = f"e.timestamp - w.timestamp <= {gap}::DOUBLE", lambda c: f"CASE WHEN e.timestamp - w.timestamp <= {gap}::DOUBLE THEN (w.{c} + e.{c}) / 2 ELSE e.{c} END AS {c}"
    order = "timestamp, confidence, onset_strength, spectral_centroid, duration"
    return f"""
    WITH RECURSIVE s AS ({source}),
    e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS i FROM s),
    w AS (
        SELECT user_id, i, {order}, 1 AS g FROM e WHERE i = 1
        UNION ALL
        SELECT e.user_id, e.i, CASE WHEN {near} AND e.confidence <= w.confidence THEN w.timestamp ELSE e.timestamp END AS timestamp,
               CASE WHEN {near} THEN least(1, greatest(0, (w.confidence + e.confidence) / 2)) ELSE e.confidence END AS confidence, {half("onset_strength")}, {half("spectral_centroid")},
               CASE WHEN {near} THEN greatest(w.duration, e.duration) ELSE e.duration END AS duration, CASE WHEN {near} THEN w.g ELSE w.g + 1 END AS g
        FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
    SELECT user_id, round(timestamp, 6) AS timestamp, round(confidence, 6) AS confidence, round(onset_strength, 6) AS onset_strength, round(spectral_centroid, 6) AS spectral_centroid, round(duration, 6) AS duration
    FROM w QUALIFY i = max(i) OVER (PARTITION BY user_id, g)"""


def _rounded_events(found: DataFrame) -> DataFrame:
    return found.select("user_id", *(F.round(c, 6).alias(c) for c in audio.EVENT))


@query(_merge_sql("SELECT user_id, epoch_us(ts) / 1000000 AS timestamp, value / 500 AS confidence, value AS onset_strength, value * 10 AS spectral_centroid, (event_id % 10) / 10.0::DOUBLE AS duration FROM events", 3600))
def merged_whistles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(
        "user_id", (F.col("micros") / 1_000_000).alias("timestamp"), (F.col("value") / 500).alias("confidence"), F.col("value").alias("onset_strength"), (F.col("value") * 10).alias("spectral_centroid"), (F.col("event_id") % 10 / F.lit(10.0)).alias("duration")
    )
    return _rounded_events(audio.merge_events(rows, KEYS, gap=3600.0))


HOP, RATE, LOUD, FULL, NEAR = 4, 8.0, 20000.0, 40000.0, 1.0  # samples a block and a second, energies, seconds


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a recording: user_id, i, v and the event time `at`."""
    rows = sequences.position(events(spark, sf_dir), KEYS, "event_id", "i")
    return rows.select("user_id", F.col("i").cast("long").alias("i"), (F.floor("value") - 250).cast("double").alias("v"), F.timestamp_seconds(1_000_000 + F.col("i") / RATE).alias("at"))  # an event time at the epoch itself counts as late


_WHISTLES = _merge_sql(f"""
    SELECT user_id, min(frame) * {HOP / RATE}::DOUBLE AS timestamp, least(1, greatest(0, 0.40::DOUBLE * least(1, greatest(0, max(energy) / {FULL}::DOUBLE)) + 0.35::DOUBLE)) AS confidence, max(energy) AS onset_strength, 0.0::DOUBLE AS spectral_centroid, count(*) * {HOP / RATE}::DOUBLE AS duration
    FROM (SELECT *, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS run FROM (
        SELECT user_id, i // {HOP} AS frame, avg(v * v) AS energy FROM (SELECT user_id, floor(value) - 250 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events) GROUP BY ALL HAVING count(*) = {HOP}) WHERE energy > {LOUD})
    GROUP BY user_id, run""", NEAR)


@query(_WHISTLES)
def whistles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_events(audio.whistles(samples(spark, sf_dir), KEYS, "i", "v", HOP, RATE, LOUD, FULL, NEAR))


@query(_WHISTLES)
def whistle_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same whistles from a stream that gets every recording in chunks cut at odd places."""
    folder = scratch(spark, "chunks")
    rows = cut(samples(spark, sf_dir), "samples")
    most = rows.agg(F.max("i")).first()[0] or 0
    ends = rows.groupBy("user_id").agg((F.max("i") + 1).alias("i"), F.lit(None).cast("double").alias("v"), F.max("at").alias("at"))
    step = most // 4 + 3
    for n, low in enumerate(range(0, most + 2, step)):
        chunk = rows.unionByName(ends).filter(F.col("i").between(low, low + step - 1))
        chunk.coalesce(1).write.parquet(f"{folder}/in/chunk={n}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    found = whistle_stream(stream, KEYS, "i", "v", HOP, RATE, LOUD, FULL, NEAR)
    found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _rounded_events(spark.read.schema(found.schema).parquet(f"{folder}/out"))

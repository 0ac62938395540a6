"""Quality rules with thresholds that adapt to each language and source.

A metric's distribution in a (language, source) group is held as a log-bucket quantile sketch:
counts, and the words or lines behind them, by bucket ceil(log(value) / log(GAMMA)), zeros apart.
Quantiles read from it are within 1 % of exact ones, and sketches merge by adding up, which a
grouped sum does with map-side combining, so a hot source costs no more than any other. All
thresholds are read from the sketches; no metric has a cutoff of its own.

Where a metric is above 0 in a good part of the documents, its fence lies FENCE interquartile
ranges above the third quartile, or at the TAIL quantile if that is higher. Where even that quantile
is 0, most documents have nothing of the kind, and the fence is the rate at which a document is
as likely to be one of the others: between the median rate of the documents above 0 and the rate that
the documents at 0, by all their words, still allow. A group's fences are averaged with its language's (high
ones by their logarithms), with the weight of its documents against that of PRIOR ones, so that a
small group leans on its language.

Documents are filtered by a null-safe join with their group's fences. A count is tested against
the fence times the document's length, and of a count x, SIGMAS times its square root is forgiven
as chance, so some symbols in a long text are no offence where most texts have none.

Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapframe.llm.common import let, materialise

BREAKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
GAMMA = 1.02
PRIOR = 200
FENCE = 5.0
TAIL = 0.9
SIGMAS = 3.0
# Metric: its count, what it is a share of, and how many of the count one event makes.
SHARES = {"symbol_ratio": ("n_symbols", "n_words", 1), "repeat_ratio": ("n_repeat_words", "n_words", WINDOW), "dup_line_ratio": ("n_dup_lines", "n_lines", 1)}
METRICS = (*SHARES, "word_length")
LOW_SIDE = {"word_length"}


def _repeated_words(hashes: Column) -> Column:
    """Words lying in windows of WINDOW words that occur twice or more."""

    def windows(h):
        ends = F.sequence(F.lit(0), F.size(h) - WINDOW)
        each = F.transform(ends, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
        return F.when(F.size(h) >= WINDOW, each).otherwise(F.array().cast("array<bigint>"))

    def repeated_starts(s):
        at = lambda j: F.get(s, j)["h"]
        same = lambda j: F.coalesce(at(j) == at(j - 1), F.lit(False)) | F.coalesce(at(j) == at(j + 1), F.lit(False))
        starts = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.when(same(j), F.get(s, j)["i"]))
        return F.sort_array(F.array_compact(starts))

    def covered(starts):
        first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("total"))
        step = lambda a, i: F.struct(i.alias("last"), (a["total"] + F.least(F.lit(WINDOW), i - a["last"])).alias("total"))
        return F.aggregate(starts, first, step, lambda a: a["total"])

    def count(g):
        ordered = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        heavy = let(ordered, lambda s: covered(repeated_starts(s)))
        return F.when(F.size(g) == F.size(F.array_distinct(g)), F.lit(0).cast("long")).otherwise(heavy)

    return let(hashes, lambda h: let(windows(h), count))


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text; null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, BREAKS), lambda w: w != "")
    counted = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            _repeated_words(F.transform(w, lambda x: F.xxhash64(x))).alias("n_repeat_words"),
        ),
    )
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lined = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    read = docs.select(
        "doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), counted.alias("w"), lined.alias("l"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols")
    )
    return read.select("doc_id", "lang", "source", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")


def with_metrics(stats: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return stats.select(
        "*",
        failed.alias("base_failed"),
        per_word("n_symbols").alias("symbol_ratio"),
        per_word("n_repeat_words").alias("repeat_ratio"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_ratio"),
        per_word("word_chars").alias("word_length"),
    )


def sketches(metrics: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n, size over the rows that pass the base rules; bucket null is zero.

    size adds up what the metric is a share of.
    """
    of = {**{m: SHARES[m][1] for m in SHARES}, "word_length": "n_words"}
    values = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.col(of[m]).cast("long").alias("size")) for m in METRICS))
    stacked = metrics.filter(~F.col("base_failed")).select("lang", "source", F.explode(values).alias("m"))
    bucket = F.when(F.col("m.value") > 0, F.ceil(F.log(F.col("m.value")) / F.log(F.lit(GAMMA))).cast("int"))
    return stacked.groupBy("lang", "source", F.col("m.metric").alias("metric"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("m.size").alias("size"))


def fences(sketch: DataFrame, group: list[str]) -> DataFrame:
    """Per group and metric: the number of documents and the low and high fence.

    The low fence lies FENCE interquartile ranges below the first quartile. The high one is null where a
    mostly-zero metric is 0 in all documents of the group.
    """
    merged = sketch.groupBy(*group, "metric", "bucket").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    whole = Window.partitionBy(*group, "metric")
    ranked = merged.withColumn("upto", F.sum("n").over(whole.orderBy(F.col("bucket").asc_nulls_first()))).withColumn("total", F.sum("n").over(whole))
    ranked = ranked.withColumn("zeros", F.coalesce(F.sum(F.when(F.col("bucket").isNull(), F.col("n"))).over(whole), F.lit(0)))
    value = F.coalesce(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1), F.lit(0.0))
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), value))
    above = F.col("bucket").isNotNull() & (F.col("upto") - F.col("zeros") >= 0.5 * (F.col("total") - F.col("zeros")))
    read = ranked.groupBy(*group, "metric").agg(
        F.max("total").alias("total"), quartile(0.25).alias("q1"), quartile(0.75).alias("q3"), quartile(TAIL).alias("tail"), F.min(F.when(above, value)).alias("rate"), F.sum(F.when(F.col("bucket").isNull(), F.col("size"))).alias("clean")
    )
    reach = FENCE * (F.col("q3") - F.col("q1"))
    low = F.when(F.col("metric").isin(*LOW_SIDE), F.col("q1") - reach)
    event = reduce(lambda e, m: F.when(F.col("metric") == m, SHARES[m][2]).otherwise(e), SHARES, F.lit(1))
    allowed = event / F.greatest(F.col("clean"), F.lit(1))
    even = F.when(F.col("rate") > allowed, (F.col("rate") - allowed) / F.log(F.col("rate") / allowed)).otherwise(F.col("rate"))
    high = F.when(F.col("tail") > 0, F.greatest(F.col("q3") + reach, F.col("tail"))).otherwise(even)
    return read.select(*group, "metric", "total", low.alias("low"), high.alias("high"))


def thresholds(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """One row per (lang, source): the fences of each metric as columns low_<m> and high_<m>.

    A fence that the group lacks is its language's; null where that lacks it too.
    """
    own = fences(sketch, ["lang", "source"])
    language = fences(sketch, ["lang"]).select(F.col("lang").alias("l"), F.col("metric").alias("m"), F.col("low").alias("llow"), F.col("high").alias("lhigh"))
    both = own.join(language, F.col("lang").eqNullSafe(F.col("l")) & (F.col("metric") == F.col("m")))
    share = F.col("total") / (F.col("total") + prior)
    blend = lambda a, b: F.coalesce(share * a + (1 - share) * b, a, b)
    chosen = both.select("lang", "source", "metric", blend(F.col("low"), F.col("llow")).alias("low"), F.exp(blend(F.log("high"), F.log("lhigh"))).alias("high"))
    take = lambda side, m: F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{side}_{m}")
    return chosen.groupBy("lang", "source").agg(*(take(side, m) for m in METRICS for side in ("low", "high")))


def judge(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """One row per input row: doc_id, the counts, base_failed, kept and the metrics.

    Null text counts as empty and fails the base rule; null languages and sources are groups of
    their own. Only documents that pass the base rules make fences, and only they can be kept; a
    metric that is 0 in all of them rejects none. Ties with a fence are kept. Repeated rows are judged alike.
    Empty input gives an empty result; extra columns are ignored.
    """
    metrics = materialise(with_metrics(text_statistics(docs)), "quality-metrics")
    limits = thresholds(sketches(metrics), prior).withColumnRenamed("lang", "t_lang").withColumnRenamed("source", "t_source")
    joined = metrics.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    fits = []
    for m in METRICS:
        if m in SHARES:
            count, of, unit = SHARES[m]
            events = F.col(count) / unit
            fits.append((events - SIGMAS * F.sqrt(events)) * unit <= F.col(f"high_{m}") * F.col(of))
        else:
            fits.append(F.col(m) <= F.col(f"high_{m}"))
        if m in LOW_SIDE:
            fits.append(F.col(m) >= F.col(f"low_{m}"))
    kept = reduce(lambda a, b: a & b, (F.coalesce(f, F.lit(True)) for f in fits), ~F.col("base_failed"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "lang", "source", *METRICS)

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from snapframe.llm import ordinal_quality, quality_rules


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            repeated.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), base


EDGE = [None, "", " \n\t ", "a", "x\ny\nx\n\nx ", "a b c d e f g h " * 3, "w " * 30_000, "é#ß <b> 漢字 | " * 9, "one\x0btwo\x0cthree\rfour", " nbsp em", "a b c d e f g h i a b c d e f g h"]


def test_counts_match_brute_force(make_docs, documents):
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "s") for i, t in enumerate(EDGE)] + [(1, "a"), (1, "a"), (None, "b")]
    found = quality_rules.judge(make_docs(*rows)).collect()
    got = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
    assert got == sorted(counts(r[1]) for r in rows)
    assert not any(r.kept for r in found if r.base_failed)
    text = {r.doc_id: r.text for r in documents.collect()}
    for r in quality_rules.judge(documents).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(text[r.doc_id])


def test_thresholds_adapt_and_keep_clean_text(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_rules.judge(docs).join(labels, "doc_id").filter("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.98
    assert sum(bad) / len(bad) < 0.2


def bucket_value(x):
    return 2 * 1.02 ** math.ceil(math.log(x) / math.log(1.02)) / 2.02 if x > 0 else 0.0


def plain_verdicts(rows, prior):
    """kept by doc_id: the fences of each group from sorted bucket values, then the rule for each document."""
    stats = {}
    for doc_id, text, lang, source in rows:
        n, chars, symbols, dups, repeats, base = counts(text)
        lines = len([x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
        ratios = (symbols / max(n, 1), repeats / max(n, 1), dups / max(lines, 1), chars / max(n, 1))
        stats[doc_id] = ((lang, source), base, ratios, ((symbols, n, 1), (repeats, n, 8), (dups, lines, 1), (chars, n, 1)))

    def limits(keep, i):
        chosen = [s for s in stats.values() if keep(s) and not s[1]]
        values = sorted(bucket_value(s[2][i]) for s in chosen)
        at = lambda v, q: v[math.ceil(q * len(v)) - 1]
        reach = 5 * (at(values, 0.75) - at(values, 0.25))
        above = [v for v in values if v > 0]
        if at(values, 0.9) > 0:
            high = max(at(values, 0.75) + reach, at(values, 0.9))
        elif above:
            rate, allowed = at(above, 0.5), chosen[0][3][i][2] / max(1, sum(s[3][i][1] for s in chosen if s[2][i] == 0))
            high = (rate - allowed) / math.log(rate / allowed) if rate > allowed else rate
        else:
            high = None
        return at(values, 0.25) - reach, high, len(values)

    kept, known = {}, {}
    for doc_id, (group, base, ratios, shares) in stats.items():
        kept[doc_id] = not base
        for i in range(4 if not base else 0):
            if (group, i) not in known:
                own, wide = limits(lambda s: s[0] == group, i), limits(lambda s: s[0][0] == group[0], i)
                share = own[2] / (own[2] + prior)
                low = share * own[0] + (1 - share) * wide[0]
                high = wide[1] if own[1] is None else own[1] if wide[1] is None else own[1] ** share * wide[1] ** (1 - share)
                known[group, i] = low, high
            low, high = known[group, i]
            if i == 3:
                kept[doc_id] &= low <= ratios[3] <= high
            elif high is not None:
                x, of, unit = shares[i]
                kept[doc_id] &= (x / unit - 3 * math.sqrt(x / unit)) * unit <= high * of
    return kept


def test_verdicts_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    found = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    assert found == plain_verdicts(rows, quality_rules.PRIOR)
    assert len(set(found.values())) == 2
    rng = random.Random(5)
    made = []
    for i in range(400):
        n, rate = rng.choice((30, 300, 2000)), rng.choice((0, 0, 0.02, 0.1)) if i % 3 else 0
        words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 9))) + ("#" if rng.random() < rate else "") for _ in range(n)]
        made.append((i, "\n".join(" ".join(words[j : j + 7]) for j in range(0, n, 7)), "en", "s" if i % 4 else "t"))
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    assert {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()} == plain_verdicts(made, quality_rules.PRIOR)


def clean_words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def test_length_and_group_decide(spark):
    """Ten symbols stay in 20,000 words and go in 40; what is common in a source stays there and goes elsewhere."""
    rng = random.Random(8)
    text = lambda n, symbols: " ".join(w + "#" * (i < symbols) for i, w in enumerate(clean_words(rng, n)))
    rows = [(i, text(100, 0), "en", "plain") for i in range(300)] + [(300 + i, text(100, 60), "en", "plain") for i in range(15)]
    rows += [(1000 + i, text(100, 5 + i % 40), "en", "code") for i in range(300)]
    rows += [(2000, text(20_000, 10), "en", "plain"), (2001, text(20_000, 40), "en", "plain"), (2002, text(40, 30), "en", "plain"), (2003, text(100, 45), "en", "plain"), (2004, text(100, 45), "en", "code")]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert kept[2000] and kept[2001] and not kept[2002]
    assert not kept[2003] and kept[2004]
    assert all(kept[i] for i in range(300)) and not any(kept[300 + i] for i in range(15)) and all(kept[1000 + i] for i in range(300))


def test_groups_of_other_spread_get_other_fences(spark):
    rng = random.Random(3)
    rows = [(lang, "s", False, *(rng.uniform(0, width) for _ in range(3)), 4 + rng.uniform(0, width)) for lang, width in (("a", 0.01), ("b", 0.2)) for _ in range(300)]
    frame = spark.createDataFrame(rows, "lang string, source string, base_failed boolean, symbol_ratio double, repeat_ratio double, dup_line_ratio double, word_length double").withColumns({"n_words": F.lit(100), "n_lines": F.lit(10)})
    narrow, wide = sorted(quality_rules.thresholds(quality_rules.sketches(frame)).collect(), key=lambda r: r.lang)
    for metric in quality_rules.METRICS:
        assert wide[f"high_{metric}"] > narrow[f"high_{metric}"] * (1.1 if metric == "word_length" else 5)
    assert wide.low_word_length < narrow.low_word_length


def test_sketches_merge_and_bound_quantiles(spark):
    rows = [("en", "s" if i % 3 else "t", False, *[float(i % 101 + 1)] * 4) for i in range(3000)]
    frame = spark.createDataFrame(rows, "lang string, source string, base_failed boolean, symbol_ratio double, repeat_ratio double, dup_line_ratio double, word_length double").withColumns({"n_words": F.lit(100), "n_lines": F.lit(10)})
    whole = quality_rules.fences(quality_rules.sketches(frame), ["lang"]).filter("metric = 'word_length'").first()
    q1, q3 = 26, 76
    reach = quality_rules.FENCE * (q3 - q1)
    assert q3 + reach > 91
    assert abs(whole.high - (q3 + reach)) < 0.02 * (q3 + reach + reach)
    assert whole.total == 3000


def test_empty_tables(make_docs, spark):
    docs = make_docs((1, "a")).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.judge(docs).count() == 0
    assert ordinal_quality.grade_documents(docs, labels).count() == 0
    ungraded = ordinal_quality.grade_documents(make_docs((1, "a"), (2, None)), labels).collect()
    assert all(r.expected_grade is None and r.selected for r in ungraded)


def test_ordinal_grades_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = ordinal_quality.grade_documents(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.selected == (r.quality == 1) for r in rows) / len(rows) > 0.97
    assert sum(r.selected for r in rows if r.quality == 1) / sum(r.quality for r in rows) > 0.99
    mean = lambda keep: (lambda v: sum(v) / len(v))([r.expected_grade for r in rows if keep(r)])
    assert mean(lambda r: r.quality == 0) < mean(lambda r: r.quality == 1 and r.toxic == 1) < mean(lambda r: r.quality == 1 and r.toxic == 0)


def test_ordinal_edge_texts(make_docs, spark):
    docs = make_docs(*[(i, t) for i, t in enumerate(EDGE)], (0, EDGE[0]), (None, "x"))
    labels = spark.createDataFrame([(i, i % 2, None if i == 3 else 0) for i in range(len(EDGE))] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    rows = ordinal_quality.grade_documents(docs, labels).collect()
    assert len(rows) == len(EDGE) + 2
    assert all(0 <= r.p_best <= r.p_usable <= 1 for r in rows)

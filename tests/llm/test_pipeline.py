import hashlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from snapframe.llm import language_id, queries
from test_ngram_join import brute


def test_stage_order_and_columns(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "source_mix", "bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert [c for c in docs.columns if c != "position"] == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)


def test_run_equals_plain_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.learn(docs.filter((language_id.fold(4) != 2) & F.col("lang").isNotNull()))
    rows = []
    for r in docs.collect():
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        (name,), score = model.predict(raw, np.array([0, len(raw)]))
        if name != "und" and score[0] >= 1.2 / len(model.languages):
            rows.append(r)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    last = {}
    for r in rows:
        key = (r.text or "").translate(lower)
        last[key] = max(last.get(key, r), r, key=lambda x: x.doc_id)
    rows = list(last.values())
    components = {d: c for d, _, c in brute([(r.doc_id, r.text) for r in rows], 5, 80)}
    rows = [r for r in rows if components[r.doc_id] == r.doc_id]
    documents = spark.createDataFrame(rows, docs.schema).toPandas()  # noqa: F841  DuckDB reads it by name
    want, tokenizer = [], Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    tokenizer.no_truncation()
    text = {r.doc_id: r.text for r in rows}
    for doc_id, size, taken, first in duckdb.sql(f"SELECT doc_id, size, taken, first_time FROM ({queries.ORACLES['op3_source_mix']})").fetchall():
        ids = tokenizer.encode(text[doc_id], add_special_tokens=False).ids
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want += [(doc_id, len(ids), digest, round(first or 0, 6))] * (size and (2 * taken >= size)) + [(doc_id, len(ids), digest, None)] * (size and (2 * taken >= 3 * size))
    found, copies = [], set()
    for r in sorted(corpus_pipeline.run(spark, sf_dir).collect(), key=lambda r: r.position):
        assert len(r.ids) == r.n_tokens and 0 <= r.position <= 1
        found.append((r.doc_id, r.n_tokens, r.ids_sha256, None if r.doc_id in copies else round(r.position, 6)))
        copies.add(r.doc_id)
    assert sorted(found, key=str) == sorted(want, key=str)


def test_stages_take_an_empty_table(spark, tmp_path, documents):
    documents.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_and_a_clashing_position(spark, tmp_path):
    """Nulls, repeated rows and an input column named position: the training time is told apart from it."""
    words = "the quick brown fox jumps over the lazy dog near the river bank while children play in the warm summer evening light".split()
    text = lambda i: " ".join(words[(i * 7 + j * (i + 3)) % len(words)] for j in range(60))
    rows = [(i, text(i), "en", "a" if i % 3 else None, -7.0, 1) for i in range(60)] + [(None, text(70), "en", "b", -7.0, 1), (None, None, None, None, None, None), (5, text(5), "en", "a", -7.0, 1), (61, None, "en", "b", -7.0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, position double, POSITION_ int")
    with_case = spark.conf.get("spark.sql.caseSensitive")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert with_case == spark.conf.get("spark.sql.caseSensitive")
    assert found and all(0 <= r.position <= 1 for r in found) and len({r.position for r in found}) > len(found) // 2
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    texts = {hashlib.sha256(" ".join(map(str, tokenizer.encode(r[1], add_special_tokens=False).ids)).encode()).hexdigest() for r in rows if r[1]}
    assert {r.ids_sha256 for r in found} <= texts


def test_registered_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)

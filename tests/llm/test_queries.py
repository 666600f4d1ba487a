"""The registered queries on the small tables, and the pipeline against a brute-force version of its stages."""

import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from test_operators import brute_fingerprint, classes, targets, words

import __spark_entry__ as entry
import corpus_pipeline
from millrace.llm import chunks, mixing, quality, queries, toxicity

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

COLUMNS = {
    "op1_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op2_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op3_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op4_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op6_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op8_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op9_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op10_langid": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_contract(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = df.collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").count()
    if name not in ("op5_packing", "op8_topk"):
        assert len(rows) == docs
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        want = con.execute(f"SELECT {', '.join(COLUMNS[name])} FROM ({queries.ORACLE_SQL[name]})").fetchall()
        norm = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
        assert sorted(map(norm, want)) == sorted(norm([r[c] for c in COLUMNS[name]]) for r in rows)


def test_registered():
    assert set(COLUMNS) | {"pipeline"} <= set(entry.queries()) and "pipeline" not in entry.oracle_sql()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "mixing", "packing"]


def test_pipeline(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    pieces = corpus_pipeline.run(spark, DATA).collect()

    def only(df, ids):
        return df.where(df.doc_id.isin(sorted(ids)))

    good = {r.doc_id for r in quality.score_quality(docs, labels).collect() if r.score >= 0.3}
    clean = {r.doc_id for r in toxicity.score_toxicity(only(docs, good), labels).collect() if r.score < 0.3}
    left = sorted((r.doc_id, r.text, r.source) for r in only(docs, clean).collect())
    fps = [brute_fingerprint(t) for _, t, _ in left]
    group = classes(len(left), [(a, b) for a in range(len(left)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    single = [x for i, x in enumerate(left) if group[i] == i]
    sizes = Counter()
    for _, t, s in single:
        sizes[s] += len(words(t))
    want_sizes, copies = targets(sizes), Counter()
    for r in mixing.mix_counts(only(docs, {i for i, _, _ in single})).collect():
        assert r.target == pytest.approx(want_sizes[r.source])
        copies[r.doc_id] = r.copies
    tk = chunks.tokenizer(chunks.place("word_bpe_49k.json"))
    want = Counter({i: copies[i] * (len(tk.encode(t, add_special_tokens=False).ids) + 1) for i, t, _ in single if copies[i]})
    got = Counter()
    for r in pieces:
        got[r.doc_id] += r.length
    assert got == want
    by_sequence = Counter()
    for r in pieces:
        by_sequence[r.sequence_id] += r.length
        assert r.offset + r.length <= 2048
    assert max(by_sequence.values()) <= 2048 and sum(by_sequence.values()) == sum(want.values())
    texts = {i: t for i, t, _ in single}
    for r in pieces[:50]:
        ids = tk.encode(texts[r.doc_id], add_special_tokens=False).ids + [1]
        assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids)


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls in any column, repeated rows, empty texts, extra columns; then empty tables."""
    words_ = "alpha beta gamma delta of the".split()
    rows = [(i, " ".join(words_[(i * k) % 6] + str(i % 3) for k in range(30)), "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, i) for i in range(60)]
    rows += [rows[0], rows[0], (None, None, None, None, None), (70, "", "en", "s1", 1), (71, " \n", None, None, 2), (72, None, "de", "s2", 3), (None, rows[5][1], None, "s0", 4)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 2)] + [(None, 1, 1), (3, None, None)]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data, known in (("odd", rows, labels), ("unlabelled", rows, []), ("empty", [], [])):
        spark.createDataFrame(data, shape).selectExpr("*", "1 AS copies", "2 AS text_key", "3 AS fp").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, docs, f"{tmp_path}/{name}")
            assert left.columns == docs.columns
        found = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(found) == (name == "unlabelled") or name == "odd"
        ids = {r.doc_id for r in found}
        assert ids <= {r[0] for r in data}

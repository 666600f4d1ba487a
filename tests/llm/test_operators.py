"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeats and clashing names."""

import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from millrace.llm import chunks, common, components, langid, mixing, mtree, packing, quality, queries, rules, sharding, simhash, token_counts, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "row long, doc_id long, text string, lang string, source string, size string, text_key string, TEXT string, key string, part string, fp string, label string, copies string, host string"


def texts(n=120, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    make = lambda k: " ".join(rng.choice(words) for _ in range(k))
    out = [make(rng.randint(1, 60)) for _ in range(n)]
    out += [out[0]] * 40 + [out[1] + " x"] * 2 + [out[2].replace(" ", "\n")]
    out += [None, None, "", " \n\t", "a", "a b", "A B", " ", "x\x1fy z", "!!! ???", "word " * 3000, "z" * 5000, make(9000), "same same same same same same same same", "<|endoftext|> it's <|endoftext|>", "中文 字 \U0001f600"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = []
    for i, t in enumerate(texts()):
        source = None if i % 11 == 0 else f"s{i % 3}" if i % 5 else "hot"
        rows.append((7, i if i % 29 else None, t, rng.choice(["en", "de", None]), source, *["clash"] * 9))
    rows += rows[:5]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def plain(docs):
    return [(r[1], r[2], r[4]) for r in docs.collect()]


def words(t):
    return WORD.findall(t or "")


def duck(spark, docs, sql, **more):
    con = duckdb.connect()
    data = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).selectExpr("c1 AS doc_id", "c2 AS text", "c3 AS lang", "c4 AS source")
    con.register("documents", data.toArrow())
    for name, df in more.items():
        con.register(name, df.toArrow())
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def duck_of(df, sql):
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def same(df, found, digits=9):
    columns, rows = found
    assert sorted(columns) == sorted(df.columns)
    norm = lambda v: round(v, digits) if isinstance(v, float) else v
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = sorted((tuple(map(norm, r)) for r in rows), key=repr)
    assert got == want


# 1


@pytest.mark.parametrize("n_shards", [1, 3, 8])
def test_sharding(docs, n_shards):
    rows = sharding.shard_by_bytes(docs, n_shards, group_share=0.02).collect()
    size = lambda t: len((t or "").encode()) + 1
    want = Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, _ in plain(docs))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert all(r.law == "bytes" and r.grown_shard is None for r in rows)
    total, target = sum(r["size"] for r in rows), sum(r["size"] for r in rows) / n_shards
    largest = max(r["size"] for r in rows)
    for s in range(n_shards):
        mine = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - target) <= largest + 0.02 * total
    bytes_of = Counter()
    for r in rows:
        bytes_of[r.text_crc32] += r["size"]
    for crc, b in bytes_of.items():
        if b * n_shards <= 0.02 * total:
            assert len({r.shard for r in rows if r.text_crc32 == crc}) == 1


def test_sharding_hot_group_and_empty(spark, empty):
    assert sharding.shard_by_bytes(empty, 8).count() == 0
    hot = spark.range(4000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'same text here', concat('t', id)) AS text")
    n = Counter(r.shard for r in sharding.shard_by_bytes(hot, 8).collect())
    assert len(n) == 8
    nulls = spark.range(16).selectExpr("cast(null AS long) AS doc_id", "cast(null AS string) AS text")
    assert Counter(r.shard for r in sharding.shard_by_bytes(nulls, 8, group_share=0).collect()) == Counter({s: 2 for s in range(8)})


# 2


def targets(sizes, weights=(3, 1, 2), budget=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = budget * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] >= cap * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mixing(spark, docs, empty):
    mixed = mixing.mix_counts(docs)
    rows = mixed.collect()
    sizes = Counter()
    for _, t, s in plain(docs):
        sizes[s] += len(words(t))
    want = targets(sizes)
    assert len(rows) == docs.count()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        rate = want[r.source] / sizes[r.source]
        assert r.copies in (math.floor(rate), math.floor(rate) + 1) and r.copies <= 2
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert sorted(map(repr, mixing.mix_counts(docs.repartition(3)).collect())) == sorted(map(repr, rows))
    taken = mixed.selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken")
    same(taken, duck(spark, docs, queries.OP2_SQL))
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in rows)
    assert mixing.mix_counts(empty).count() == mixing.mix_documents(empty).count() == 0


def test_mixing_comes_near_and_stands_still(spark):
    many = spark.range(30_000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 9 AS int)) AS text", "if(id % 3 = 0, 'hot', concat('s', id % 5)) AS source")
    rows = mixing.mix_counts(many).groupBy("source").agg({"target": "max"}).withColumnRenamed("max(target)", "target").collect()
    taken = {r.source: r.t for r in mixing.mix_counts(many).selectExpr("source", "size * copies AS taken").groupBy("source").sum("taken").toDF("source", "t").collect()}
    for r in rows:
        assert taken[r.source] == pytest.approx(r.target, rel=0.05)
    wordless = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {(r.target, r.copies) for r in mixing.mix_counts(wordless).collect()} == {(0.0, 0)}


# 3


@pytest.mark.parametrize("dictionary", [1 << 18, 50])
def test_token_counts(docs, empty, dictionary):
    tk = chunks.tokenizer(chunks.place("byte_bpe_50k.json"))
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, dictionary=dictionary).collect())
    want = Counter()
    for i, t, _ in plain(docs):
        n = len(tk.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 1024)] += 1
    assert got == want
    assert token_counts.count_tokens(empty).count() == 0


def test_chunks_agree_with_the_library():
    rng = random.Random(2)
    letters = [*"aB1's é., !", "<|endoftext|>", "<|startoftext|>", "'s", "́", "\x1c", "\x85", "\xa0", " ", "​", "\n", "\t", "  ", "Σ", "İ", "ﬁ", "中", "\U0001f600", "\x00", "²", "ª"]
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    path = chunks.place("word_bpe_49k.json")
    whole, ids = chunks.tokenizer(path), chunks.WordIds(path)(made)
    assert all(np.frombuffer(b, "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids for t, b in zip(made, ids, strict=True))
    path = chunks.place("byte_bpe_50k.json")
    whole, cut = chunks.tokenizer(path), token_counts.PreTokens(path)
    for t in made:
        found, n = cut.chunks(t)
        pre = [p for c in found for p in cut.of(c)]
        assert n + sum(len(whole.model.tokenize(chunks.marked(p))) for p in pre) == len(whole.encode(t, add_special_tokens=False).ids), t


def test_marks_after_words():
    # Words that end in marks are made of a word and its marks; the whole tokeniser sees only the marks.
    ids, asked = chunks.WordIds(chunks.place("word_bpe_49k.json")), []
    whole = ids.whole
    ids.whole = SimpleNamespace(encode=lambda p, **more: asked.append(p) or whole.encode(p, **more))
    marks = ["".join(m) for n in (1, 2, 3) for m in itertools.product(chunks.SYMBOLS, repeat=n)]
    made = [f"{w}{m}" for w in ("qzword", "Qzñé", "qzß") for m in marks]
    assert all(np.frombuffer(b, "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids for t, b in zip(made, ids(made), strict=True))
    assert set(asked) <= set(marks)


# 4


def test_isotonic():
    rng = np.random.default_rng(1)
    v, w = rng.normal(size=30).cumsum() * 0.1 + rng.normal(size=30), rng.uniform(0.5, 2, 30)
    got = quality.isotonic(v, w)
    assert (np.diff(got) >= -1e-12).all()
    # max-min form of the same fit
    mean = lambda a, b: np.average(v[a : b + 1], weights=w[a : b + 1])
    assert np.allclose(got, [max(min(mean(a, b) for b in range(i, 30)) for a in range(i + 1)) for i in range(30)])


def test_calibration():
    best = lambda v, w: [max(min(np.average(v[a : b + 1], weights=w[a : b + 1]) for b in range(i, len(v))) for a in range(i + 1)) for i in range(len(v))]
    rng = np.random.default_rng(7)
    counts = rng.integers(1, 9, 40).astype(float)
    positive = np.floor(counts * np.clip(np.linspace(-0.3, 1.3, 40) + rng.normal(size=40) * 0.2, 0, 1))
    pooled, rate = np.array(best(positive / counts, counts)), positive.sum() / counts.sum()
    weight = np.array([counts[np.isclose(pooled, v)].sum() for v in pooled])
    want = best((pooled * weight + rate) / (weight + 1), counts)
    assert np.allclose(quality.smoothed(positive, counts), want)
    # Perfectly ranked: however few rows a bin has, those of label 0 stay low.
    low, high = np.array([0.0] * 10), np.array([1.0] * 60)
    got = quality.smoothed(np.concatenate((low, high)), np.ones(70))
    assert got[:10].max() < 0.1 and got[10:].min() > 0.9


@pytest.mark.parametrize("fan", [16, 2])
def test_quality_fit(spark, monkeypatch, fan):
    monkeypatch.setattr(quality, "FAN", fan)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, len(quality.NAMES))) * rng.uniform(0.1, 3, len(quality.NAMES))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(float)
    df = spark.createDataFrame([(bytearray(a.tobytes()), float(b)) for a, b in zip(x, y, strict=True)], "stats binary, y double").repartition(7)
    model = quality.fit(df, width=40, ridge=1e-3, bins=32)
    z = model.features(x)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0) + 1e-6)
    # Ridge as least squares with a row more for each weight.
    weight = 1e-3 * 300 / 41
    want = np.linalg.lstsq(np.concatenate((z, np.sqrt(weight) * np.eye(41))), np.concatenate((y, np.zeros(41))), rcond=None)[0]
    assert np.allclose(model.beta, want, atol=1e-6)
    at = np.clip(((z @ model.beta + 0.5) / 2 * 32).astype(int), 0, 31)
    bins = np.unique(at)
    cured = quality.smoothed(np.array([y[at == b].sum() for b in bins]), np.array([(at == b).sum() for b in bins], float))
    assert np.allclose(model.raw, (bins + 0.5) / 16 - 0.5) and np.allclose(model.cured, cured)
    assert quality.fit(df.limit(0)) is None


def test_statistics():
    t = "Ab cd cd!\n\nx1 AB\nx1 AB"
    got = dict(zip(quality.NAMES, quality.statistics(t), strict=True))
    raw, w, lines = t.encode(), words(t), [x for x in t.split("\n") if x]
    p = np.array(list(Counter(raw).values())) / len(raw)
    want = {"upper": sum(c.isupper() for c in t) / len(raw), "digit": 2 / len(raw), "newline": 3 / len(raw), "shout": 1 / len(raw), "beyond": 0}
    want |= {"entropy": -(p * np.log2(p)).sum() / 8, "log_words": np.log1p(len(w)) / 10, "word_length": np.mean([len(x) for x in w]) / 10}
    want |= {"longest_word": np.log1p(3) / 10, "short_words": 1, "different_words": len(set(w)) / len(w), "top_word": 2 / len(w), "runs": 0}
    want |= {"different_lines": 2 / 3, "words_a_line": np.log1p(len(w) / len(lines)) / 10, "top_line": 2 / 3, "ended_words": 1 / len(w)}
    assert all(got[k] == pytest.approx(v) for k, v in want.items())
    assert not quality.statistics(None).any() and np.isfinite(quality.statistics(" ")).all() and np.isfinite(quality.statistics("z" * 10_000)).all()


def test_fourier_features_near_the_kernel():
    s = quality.Scorer(np.zeros(4), np.ones(4), 4096, 2.0, 1)
    x = np.random.default_rng(2).normal(size=(20, 4))
    z = s.features(x)[:, :-1]
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-d2 / 8)).max() < 0.1


def test_quality(spark, docs, empty):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) + ("." if rng.random() < 0.1 else "") for _ in range(rng.randint(20, 90))) for _ in range(150)]
    bad = [" ".join([rng.choice(["spam", "buy"])] * rng.randint(20, 90)) + "!!!$$$" for _ in range(60)]
    data = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(210)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score_quality(data, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert all(r.predicted == int(r.doc_id < 150) for r in held) and len({r.predicted for r in held}) == 2
    kept = quality.keep_good(data, labels)
    assert kept.columns == data.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.predicted}
    odd = quality.score_quality(docs, labels)
    assert odd.count() == docs.count() and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.score_quality(empty, labels).count() == quality.keep_good(empty, labels).count() == 0
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}


# 5


def test_hilbert():
    for dims, bits in ((2, 3), (3, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = packing.hilbert_keys(points, bits)
        assert sorted(keys) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("capacity", [2048, 7])
def test_packing(docs, empty, capacity):
    tk = chunks.tokenizer(chunks.place("word_bpe_49k.json"))
    rows = packing.pack_documents(docs, capacity=capacity).collect()
    sequences = defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.length > 0
        sequences[r.sequence_id].append(r)
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [0, *itertools.accumulate(r.length for r in s)][:-1] and sum(r.length for r in s) <= capacity
    # Pieces of one document are laid one after the other, in the order of sequences.
    whole, current = Counter(), []
    for key in sorted(sequences):
        for r in sequences[key]:
            if r.start == 0:
                current = []
            ids = np.frombuffer(r.ids, "<u4").tolist()
            assert r.start == len(current)
            current = current + ids
            if len(current) == r.doc_tokens:
                whole[(r.doc_id, tuple(current))] += 1
    assert whole == Counter((i, tuple(tk.encode(t or "", add_special_tokens=False).ids + [1])) for i, t, _ in plain(docs))
    full = sum(sum(r.length for r in s) == capacity for s in sequences.values())
    assert len(sequences) - full <= 5
    digests = packing.piece_digests(packing.pack_documents(docs, capacity=capacity))
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in digests.collect()) == Counter((r.doc_id, r.start, zlib.crc32(r.ids)) for r in rows)
    assert packing.pack_documents(empty).count() == 0


def test_packing_memory(spark):
    # Long documents side by side: the work on them is bounded in bytes, and so is what goes to a worker at once.
    rng = np.random.default_rng(6)
    long = [rng.integers(0, 49_000, 26_000).astype("<u2") for _ in range(256)]
    curve = packing.Curve(3, 10, 23)
    tracemalloc.start()
    keys = curve.keys(long)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6 and (keys == np.concatenate([curve.keys([x]) for x in long])).all()

    sizes = [0, 10, None, *rng.integers(1, 5000, 2000), 3_000_000, 5, *[300_000] * 30]
    batch = pa.RecordBatch.from_pydict({"n": range(len(sizes)), "t": ["x" * n if n is not None else None for n in sizes]})
    parts = list(packing.blocks(iter([batch, batch.slice(0, 0), batch.slice(2000)]), "t"))
    assert [n for p in parts for n in p.column("n").to_pylist()] == [*range(len(sizes)), *range(2000, len(sizes))]
    used = [(p.num_rows, sum(len(t or "") for t in p.column("t").to_pylist())) for p in parts]
    assert all(0 < rows <= packing.BLOCK and (rows == 1 or n <= packing.BLOCK_BYTES) for rows, n in used) and len(parts) < 40

    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.get_total_buffer_size()]})

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(0, 1000, 1, 1).selectExpr("repeat('x', 20000) AS t")
    for own, most in (None, 6e6), ("1m", 2e6):
        if own:
            spark.conf.set(key, own)
        with common.small_batches(spark):
            rows = texts.mapInArrow(held, "n long, bytes long").collect()
        assert sum(r.n for r in rows) == 1000 and max(r.bytes for r in rows) < most
        assert spark.conf.getAll.get(key) == own
    spark.conf.unset(key)


def test_packing_long(spark):
    tk = chunks.tokenizer(chunks.place("word_bpe_49k.json"))
    names = [f"Name{i} of" for i in range(12)]
    times = {i: 1_000_000 if i == 4 else 30_000 for i in range(12)}
    rows = [(i, n) for i, n in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, name string").coalesce(1)
    docs = docs.selectExpr("doc_id", "repeat(concat(name, ' '), IF(doc_id = 4, 1000000, 30000)) AS text")
    pieces = defaultdict(list)
    for r in packing.pack_documents(docs).collect():
        pieces[r.doc_id].append((r.start, r.ids, r.doc_tokens))
    for i, name in enumerate(names):
        want = np.array(tk.encode(name, add_special_tokens=False).ids * times[i] + [1], "<u4")
        found = sorted(pieces[i])
        assert b"".join(x for _, x, _ in found) == want.tobytes() and {n for _, _, n in found} == {len(want)}


# 6


def test_field_marginals():
    rng = np.random.default_rng(4)
    field = toxicity.Field({}, 0.0, rng.normal(size=(2, 2)), rng.normal(size=2))
    lengths = np.array([4, 0, 1, 6, 3])
    e, weights = rng.normal(size=int(lengths.sum())) * 2, rng.uniform(0.5, 2, 5)
    got, pairs, at, joint = field.marginals(e, lengths), field.pairs(e, lengths, np.repeat(weights, lengths)), 0, np.zeros((2, 2))
    for n, weight in zip(lengths, weights, strict=True):
        z, up, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for states in itertools.product((0, 1), repeat=int(n)) if n else []:
            p = math.exp(field.start[states[0]] + sum(e[at + i] * s for i, s in enumerate(states)) + sum(field.steps[a, b] for a, b in zip(states, states[1:], strict=False)))
            z += p
            up += p * np.array(states)
            for a, b in zip(states, states[1:], strict=False):
                two[a, b] += p
        if n:
            assert np.allclose(got[at : at + n], up / z)
            joint += two / z * weight
        at += n
    assert np.allclose(pairs, joint)


def test_training_step(monkeypatch):
    """The gradient against differences of the likelihood, worked out over all labellings."""
    monkeypatch.setattr(toxicity, "TOKENS", 4)
    rng = np.random.default_rng(9)
    corpus = toxicity.Corpus(["aaa bbb aaa ccc", "bbb ccc ddd", "ddd"], [True, False, False])
    tags = [np.array([1, 0, 1, 0]), np.array([0, 0, 0]), np.array([0])]
    data = toxicity.Sequences(corpus, [(corpus.texts[i], tags[i], 1.0 + i) for i in range(3)])
    w, l2 = rng.normal(size=len(corpus.names)), 0.7
    field = toxicity.Field({}, 0.3, rng.normal(size=(2, 2)), rng.normal(size=2))
    often = Counter(j for i in range(3) for j in corpus.features_of(corpus.texts[i])[1])

    def loss(w, bias, steps, start):
        out = 0.5 * l2 * ((w**2).sum() + (steps**2).sum() + (start**2).sum())
        for i, text in enumerate(corpus.texts):
            place, f = corpus.features_of(text)
            e = bias + np.bincount(place, [w[j] if often[j] >= 2 else 0.0 for j in f], len(text))
            score = lambda y: start[y[0]] + sum(e[k] * y[k] for k in range(len(y))) + sum(steps[a, b] for a, b in zip(y, y[1:], strict=False))  # noqa: B023, E731
            out += (1.0 + i) * (np.logaddexp.reduce([score(y) for y in itertools.product((0, 1), repeat=len(text))]) - score(tags[i].tolist()))
        return out

    got = data.gradient(field, w, l2)
    here = [w, np.array(field.bias), field.steps, field.start]
    for part, g in enumerate(got):
        for at in np.ndindex(here[part].shape):
            ends = []
            for move in (1e-5, -1e-5):
                x = [p.copy() for p in here]
                x[part][at] += move
                ends.append(loss(*x))
            assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(np.asarray(g)[at], abs=1e-6)


def test_token_labels():
    rng = random.Random(4)
    plain_ = ["alpha", "beta", "gamma", "delta", "of", "the"]
    made = []
    for i in range(200):
        t = [rng.choice(plain_) for _ in range(30)]
        if i % 5 == 0:  # toxic: words of one stem; clean ones have the stem itself, or "vilest"
            t[3:3] = [f"vile{rng.choice('abcdefgh')}", f"vile{rng.choice('abcdefgh')}"]
        elif i % 5 == 1:
            t[3:3] = [rng.choice(["vile", "vilest"])]
        made.append((" ".join(t), i % 5 == 0))
    made += [("copied words here only copied words here only", True)] * 30
    corpus = toxicity.Corpus([t for t, _ in made], [y for _, y in made])
    every = np.arange(len(made))
    marks, safe = toxicity.token_labels(corpus, every)
    found = {corpus.names[f] for f in np.flatnonzero(marks)}
    harmless = {corpus.names[corpus.cols[corpus.starts[i]]] for i in np.flatnonzero(safe)}
    assert "^vile" in found and not found & {f"={x}" for x in [*plain_, "vile", "copied", "words"]}
    assert {"=vile", "=vilest", *(f"={x}" for x in plain_)} <= harmless and "=vilea" not in harmless
    bad, good = corpus.documents(every, np.zeros(corpus.n_words, bool))
    for f, name in enumerate(corpus.names):
        for y, n in ((True, bad[f]), (False, good[f])):
            texts_ = {t for t, z in made if z == y}
            if name[0] in "=^":
                assert n <= sum(any(name in toxicity.features(w) for w in t.split()) for t in texts_) == n + sum(any(name in toxicity.features(w) for w in made[i][0].split()) for i in every if not corpus.single[i] and made[i][1] == y and made[i][0] not in {made[k][0] for k in range(i)})
    assert toxicity.token_labels(corpus, every[[not y for _, y in made]])[0].sum() == 0


def test_segments():
    for centres, n in (([], 5), ([3], 4), ([0, 20, 200, 210, 299], 300)):
        near = {k for c in centres for k in range(max(0, c - toxicity.MARGIN), min(n, c + toxicity.MARGIN + 1))}
        found = toxicity.segments(np.array(centres, int), n)
        assert sorted(k for a, b in found for k in range(a, b)) == sorted(near) and all(b - a <= toxicity.RUN for a, b in found)


def test_logistic():
    rng = np.random.default_rng(3)
    x, weights = rng.uniform(0, 8, 300), rng.uniform(0.5, 3, 300)
    y = rng.uniform(size=300) < 1 / (1 + np.exp(-(1.2 * x - 4)))
    slope, offset = toxicity.logistic(x, y, weights)
    p = 1 / (1 + np.exp(-(slope * x + offset)))
    assert abs((weights * (p - y)).sum()) < 1e-3 and abs((weights * (p - y) * x).sum() + 0.01 * slope) < 1e-3
    assert toxicity.logistic(x, ~y, weights)[0] == 0
    slope, offset = toxicity.logistic(np.array([0.2, 5.0]), np.array([False, True]), np.ones(2))
    assert 0.2 < -offset / slope < 5


def test_training_texts(spark):
    rows = [(i, f"text {i % 50} {'x' * (i % 7)}") for i in range(100)] + [(200 + i, "one copied text") for i in range(50)] + [(300, None)]
    data = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    args = ((4, 2), "doc_id", "text", "toxic")
    want = defaultdict(bool)
    for i, t in rows:
        if t is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            want[t] |= i % 3 == 0
    texts_, toxic, prior = toxicity.training_texts(data, labels, 1000, 1000, 1 << 20, *args)
    assert dict(zip(texts_, toxic, strict=True)) == want and len(texts_) == len(want) and prior == 1
    texts_, toxic, prior = toxicity.training_texts(data, labels, 10, 5, 1 << 20, *args)
    assert (sum(toxic), len(toxic)) == (10, 15) and prior == pytest.approx(10 / sum(want.values()) / (5 / sum(not y for y in want.values())))
    texts_, toxic, _ = toxicity.training_texts(data, labels, 1000, 1000, 300, *args)
    assert 0 < sum(len(t.encode()) for t, y in zip(texts_, toxic, strict=True) if y) <= 100 and 0 < sum(toxic) < len(toxic)
    assert toxicity.training_texts(data, labels.limit(0), 10, 5, 1 << 20, *args) == ([], [], 1.0)


def test_toxicity(spark, docs, empty):
    rng = random.Random(1)
    base = ["alpha", "beta", "gamma", "delta", "of", "the", "losing", "their"]
    rows = []
    for i in range(400):
        t = [rng.choice(base) for _ in range(rng.randint(5, 60))]
        if i % 4 == 0:
            for w in rng.sample(["vileworda", "vilewordb", "vilewordc", "grubby"], 2):
                t.insert(rng.randint(0, len(t)), w)
        rows.append((i, " ".join(t)))
    data = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    found = toxicity.score_toxicity(data, labels).collect()
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) == int(r.doc_id % 4 == 0), r
        spans = [rows[r.doc_id][1][s.start : s.end] for s in r.spans]
        assert sorted(spans) == sorted(w for w in rows[r.doc_id][1].split() if w[:4] in ("vile", "grub"))
    assert {r.doc_id for r in toxicity.keep_clean(data, labels).collect()} == {i for i in range(400) if i % 4}
    odd = toxicity.score_toxicity(docs, labels)
    assert odd.count() == docs.count() and odd.where("score is null or score < 0 or score > 1").count() == 0
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    assert toxicity.score_toxicity(empty, labels).count() == toxicity.keep_clean(empty, labels).count() == 0
    assert toxicity.score_toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0


# 7


def brute_fingerprint(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def classes(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(docs, empty):
    data = plain(docs)
    fps = [brute_fingerprint(t) for _, t, _ in data]
    group = classes(len(data), [(a, b) for a in range(len(data)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    least = {}
    for g, (i, _, _) in zip(group, data, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = Counter((i, fp, least.get(g)) for (i, _, _), fp, g in zip(data, fps, group, strict=True))
    got = Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.simhash_components(docs).collect())
    assert got == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group))
    assert simhash.simhash_components(empty).count() == simhash.drop_near_duplicates(empty).count() == 0


def test_vantage_links(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64) << np.uint64(1)
    close = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 4), replace=False))) for b in base for _ in range(5)]
    ball = [np.uint64(sum(1 << int(k) for k in rng.choice(20, 3, replace=False))) for _ in range(600)]
    fps = np.unique(np.concatenate((base, np.array(close, np.uint64), np.array(ball, np.uint64))))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(4)
    labels = {r.node: r.label for r in components.components(simhash.linked(df, 3, sample=256, leaf=100, depth=4)).collect()}
    made = []
    lower = simhash.lower_tree

    def watched(*args):
        made.append(lower(*args))
        return made[-1]

    monkeypatch.setattr(simhash, "lower_tree", watched)
    divided = {r.node: r.label for r in components.components(simhash.linked(df, 3, sample=2048, leaf=4000, depth=1, least=16)).collect()}
    assert divided == labels
    # Some leaves are divided by trees; a ball that none divides is dealt in blocks.
    solved = simhash.linked(df, 3, sample=2048, leaf=4000, depth=6, least=16)
    assert {r.node: r.label for r in components.components(solved).collect()} == labels
    assert any(t is not None for t in made) and any(t is None for t in made)
    links = [(a, int(b)) for a in range(len(fps)) for b in np.flatnonzero(np.bitwise_count(fps[:a] ^ fps[a]) <= 3)]
    group = classes(len(fps), links)
    signed = fps.view(np.int64).tolist()
    best = defaultdict(list)
    for g, x in zip(group, signed, strict=True):
        best[g].append(x)
    assert all(labels.get(x, x) == min(best[g]) for g, x in zip(group, signed, strict=True))
    found = simhash.Classes(len(fps))
    simhash.link_leaf(fps, np.arange(len(fps)), np.arange(0), 3, found, np.random.default_rng(1), small=64)
    found.flatten()
    assert found.parent.tolist() == group


def test_lower_trees():
    rng = np.random.default_rng(5)
    spread = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    ball = np.append(np.uint64(1) << np.arange(64, dtype=np.uint64), np.uint64(0))
    assert simhash.lower_tree(ball, 8, 3) is None and simhash.lower_tree(spread[:10], 8, 3) is None
    tree = simhash.VantageTree(spread, 3, 3)
    router = simhash.Router(tree)
    router.below = {2: simhash.VantageTree(spread, 2, 3), 5: simhash.VantageTree(spread, 1, 3)}
    near = spread[:500] ^ np.uint64(0b10100001)
    words_ = np.concatenate((spread[:500], near))
    row, leaf, home = router.route(words_)
    assert sorted(row[home]) == list(range(1000))  # at home in one leaf
    where = defaultdict(set)
    for r, x in zip(row.tolist(), leaf.tolist(), strict=True):
        where[r].add(x)
    at = dict(zip(row[home].tolist(), leaf[home].tolist(), strict=True))
    assert all(at[i] in where[500 + i] or at[500 + i] in where[i] for i in range(500))


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(500, 600)] + [(9, 9)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    group = classes(700, links)
    assert got == {i: group[i] for i in {x for a, b in links if a != b for x in (a, b)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
    star = [(5000, i) for i in range(3000)]
    assert {r.label for r in components.components(spark.createDataFrame(star, "u long, v long")).collect()} == {0}


# 8


def test_top_k(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(700)] + [(1000 + i, [0.5] * 6) for i in range(300)]
    rows += [(50, [9.0] * 6), (3000, None), (3050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (3100, [float("nan")] * 6), (3150, [float("inf")] * 6), (3200, []), (3250, [1.0, 2.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    vectors = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v)]
    want, asked = [], {}
    for i, v in vectors:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, v), v)
    for i, q in asked.items():
        best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in vectors if j != i)[:5]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    for shard, most in ((4096, 4096), (64, 2)):
        assert sorted(map(tuple, mtree.top_k(df, shard=shard, most_queries=most).collect())) == sorted(want)
    clashing = df.selectExpr("1 AS shard", "2 AS Vec_Id", "vec_id", "3 AS v", "embedding", "4 AS score", "5 AS vec_id")
    assert sorted(map(tuple, mtree.top_k(clashing).collect())) == sorted(want)
    assert mtree.top_k(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in mtree.top_k(few).orderBy("rank").collect()] == [(0, 1, 1, 256 * 512), (0, 2, 2, 256 * 512)]


def test_tree_spares_work():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8)) * 50
    v = np.floor(centres[rng.integers(0, 20, 4000)] * 10 + rng.normal(size=(4000, 8)))
    tree = mtree.MTree(v, np.arange(4000), page=64)
    asked = np.arange(0, 4000, 200)
    want = []
    for i in asked:
        s = v @ v[i]
        want += [(i, int(b), int(-a)) for a, b in sorted((-s[j], j) for j in range(4000) if j != i)[:5]]
    query, ids, scores = tree.search(v[asked], asked, 5, np.full(20, -np.inf))
    assert list(zip(asked[query], ids, scores, strict=True)) == want
    assert tree.computed < 20 * 4000 * 0.5
    # What can't reach a bar may be missing, nothing else.
    query, ids, scores = tree.search(v[asked], asked, 5, np.array([want[5 * n + 2][2] for n in range(20)], float))
    assert {(asked[q], i, s) for q, i, s in zip(query, ids, scores, strict=True)} >= {x for n in range(20) for x in want[5 * n : 5 * n + 3]}
    few = mtree.MTree(v[:3], np.arange(3)).search(v[:1], np.array([0]), 5, np.array([-np.inf]))
    assert len(few[0]) == 2 and not len(mtree.MTree(v[:0], np.arange(0)).search(v[:1], np.array([0]), 5, np.array([-np.inf]))[0])


# 9


def test_rules(spark, docs, empty):
    shared = "Shared line of the host, which is long enough to matter here."
    more = [(7, 500 + i, f"{shared}\nown words {i} " + " ".join(f"w{i}{k}" for k in range(12)), "en", "hot", *["clash"] * 9) for i in range(40)]
    more += [(7, 600 + i, f"{shared}\n{shared.upper()}\n x{i}", "en", "hot", *["clash"] * 9) for i in range(3)]
    both = docs.union(spark.createDataFrame(more, SCHEMA))
    rows = rules.quality_rules(both)
    same(rows, duck(spark, both, queries.OP9_SQL))
    by = {r.doc_id: r for r in rows.collect()}
    assert by[500].kept and by[500].n_frequent_words == 12 and not by[600].kept and not by[600].base_failed
    for i, t, _ in plain(both):
        if i is None or i in (0, 1, 2, 3, 4):
            continue
        w, r = words(t), by[i]
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + d for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for d in range(5)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered)), i
    cleaned = rules.remove_frequent_lines(both)
    assert cleaned.columns == both.columns and cleaned.count() == both.count()
    texts_ = {r[1]: r[2] for r in cleaned.collect()}
    assert texts_[500].startswith("own words 0") and texts_[600] == " x0"
    assert rules.quality_rules(empty).count() == 0


def test_rules_copies(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(20))
    rows = [(i, own(0), "host") for i in range(11)] + [(20 + i, own(1), "host") for i in range(10)] + [(40 + i, own(2), f"host{i % 2}") for i in range(20)]
    rows += [(60, own(3), "host")] * 30 + [(None, own(4), "host")] * 30 + [(i, own(5), None) for i in range(70, 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = rules.quality_rules(df)
    assert {r.doc_id for r in found.collect() if not r.kept} == {*range(11), *range(70, 90)}
    same(found, duck_of(df, queries.OP9_SQL))
    assert rules.quality_rules(df, by_text=True).where("not kept").count() == 0


def test_rules_hot_host(spark):
    line = "A line that sixty texts of the host have."
    rows = [(i, f"{line if i < 60 else f'line {i}'}\n" + " ".join(f"w{i}x{k}" for k in range(20)), "hot") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = {r.doc_id: r for r in rules.quality_rules(df).collect()}
    assert {i for i, r in by.items() if r.n_frequent_words} == set(range(60)) and by[0].n_frequent_words == 9
    same(rules.quality_rules(df), duck_of(df, queries.OP9_SQL))


def test_rules_few_words_left(spark):
    line = "Eight words that many texts of it have."
    rows = [(i, f"{line}\n" + " ".join(f"w{i}x{k}" for k in range(4 + i)), "host") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = {r.doc_id: r for r in rules.quality_rules(df).collect()}
    same(rules.quality_rules(df), duck_of(df, queries.OP9_SQL))
    assert all(r.n_frequent_words == 8 and not r.base_failed for r in by.values())
    assert {i for i, r in by.items() if r.kept} == set(range(6, 12))


# 10


def distribution(counts, lang, context):
    """Chances of all bytes after ``context``, straight from the definition."""
    c = np.zeros(256)
    for b, n in counts[lang][context].items():
        c[b] = n
    n, d = c.sum(), (c > 0).sum()
    below = distribution(counts, lang, context[1:]) if context else np.full(256, 1 / 256)
    if not n:
        return below
    rest = below * (c == 0)
    return np.where(c > 0, c / (n + (d if d < 256 else 0)), d / (n + d) * rest / max(rest.sum(), 1e-300))


def test_trees(monkeypatch):
    monkeypatch.setattr(langid, "STEP", 7)  # steps end within texts
    every = bytes(range(256)) * 3
    made = {"a": [b"abracadabra", b"banana band", "déjà vu".encode()], "b": [b"xyzzy zyx", b"abba"], "c": [every]}
    order = 3
    trees = langid.ContextTrees({lang: langid.count_contexts(t, order) for lang, t in made.items()}, order)
    seen = {lang: defaultdict(Counter) for lang in made}
    for lang, ts in made.items():
        for t in ts:
            for i in range(len(t)):
                for k in range(min(i, order) + 1):
                    seen[lang][t[i - k : i]][t[i]] += 1
    for lang in made:
        assert distribution(seen, lang, b"ab").sum() == pytest.approx(1)
    asked = [b"banana", b"", b"zyxab", b"q", b"abra\xff\x00\x00\x00", every[:300], b""]
    got = langid.Coder(trees).code_lengths(asked)
    small = langid.Coder(trees)
    small.shift, small.keys, small.known = 62, np.zeros(4, np.int64), np.zeros((3, 4), np.float32)  # all meet in four slots
    assert np.allclose(small.code_lengths(asked), got)
    for i, text in enumerate(asked):
        for j, lang in enumerate(trees.langs):
            bits = -sum(math.log2(distribution(seen, lang, text[max(0, k - order) : k])[text[k]]) for k in range(len(text)))
            assert got[i, j] == pytest.approx(bits, rel=1e-4)
    assert trees.size() == 12 * sum(len(x) + len({y[:-1] for y in x}) for lang in made for k in range(order + 1) for x in [{t[i - k : i + 1] for t in made[lang] for i in range(k, len(t))}])


def test_language(spark, docs, empty):
    rng = random.Random(1)
    tongues = {"aa": ["lorem", "ipsum", "dolor", "sit"], "bb": ["wörter", "über", "straße", "und"], "cc": ["qué", "niño", "él", "años"]}
    rows = [(i, " ".join(rng.choice(tongues[x]) for _ in range(rng.randint(1, 40))), x) for i, x in enumerate(rng.choice(list(tongues)) for _ in range(300))]
    rows += [(900, None, "aa"), (901, "123 !!", "aa"), (902, "", "aa"), (903, "lorem ipsum", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify_held_out(df).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert all(got[i].lang_pred == x for i, _, x in rows[:300]) and got[903].lang_pred == "aa"
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    odd = langid.identify_held_out(docs)
    assert odd.count() == docs.count() and {r.lang_pred for r in odd.collect()} <= {"en", "de", "und"}
    assert langid.identify_held_out(empty).count() == 0


def test_language_sample_of_copies(spark, monkeypatch):
    made = []
    monkeypatch.setattr(langid, "ContextTrees", lambda counts, *_: made.append(counts))
    rows = [(f"{i:05d} text", "many") for i in range(300)] + [(f"hot {k} text", "many") for k in range(2) for _ in range(4000)]
    rows += [(f"{i % 8:05d} rare", "few") for i in range(8000)]
    langid.train(spark.createDataFrame(rows, "text string, lang string"), docs_per_lang=100)
    assert {lang: int(c[0][1].sum()) for lang, c in made[0].items()} == {"many": 100 * 10, "few": 8 * 10}


def test_language_bounds(spark):
    df = spark.createDataFrame([("abcabd", "aa"), ("abxaby", "bb")], "text string, lang string")
    with pytest.raises(ValueError, match="over 1 languages"):
        langid.train(df, most_langs=1)
    with pytest.raises(ValueError, match="order"):
        langid.train(df, order=7)

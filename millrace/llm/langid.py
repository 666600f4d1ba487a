"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_remainder, pick

#: Bytes of text that are counted at a time.
BLOCK = 1 << 20
#: Places of text that are scored at a time.
STEP = 1 << 18
#: Bytes of a worker's memory of code lengths.
REMEMBERED = 24 << 20
#: Longest context: with its length, the context and the next byte fill 64 bits.
MOST_ORDER = 6


def codes(joined: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    """Of each place of ``joined``: its byte, before it up to ``order`` bytes of its text, above them a 1 for their number.

    ``place`` numbers the bytes within their text (any number of ``order`` or more is as good as ``order``).
    """
    wide = joined.astype(np.int64)
    code, length = wide.copy(), np.minimum(place, order)
    for k in range(1, order + 1):
        has = np.flatnonzero(length >= k)
        code[has] |= wide[has - k] << (8 * k)
    return code | (np.int64(1) << 8 * (length + 1))


def count_contexts(texts: list[bytes], order: int) -> list[np.ndarray]:
    """For k = 0..order: counts of (k bytes of context, next byte) as rows (code, count); code has the context's bytes first."""
    joined = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    place = np.arange(len(joined)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    code, out = codes(joined, place, order), []
    for k in range(order + 1):
        found, counts = np.unique(code[place >= k] & ((1 << 8 * (k + 1)) - 1), return_counts=True)
        out.append(np.stack([found, counts.astype(np.int64)]))
    return out


def look_up(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``sorted_``, whether it is there) of each of ``wanted``."""
    if not len(sorted_):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return at, sorted_[at] == wanted


class ContextTree:
    """Frozen statistics of one language, as sorted arrays: a row for each byte seen in a context, one for each context.

    A context is 0 to ``order`` bytes. The longest one seen predicts a byte: with c / (n + d) if it was seen there, c
    being its count, n the context's and d the number of different bytes in it; else the tree escapes with d / (n + d)
    to the context that is one byte shorter, where the bytes seen in the longer one are excluded. Below the empty
    context all bytes are alike. Nothing is left out, and the arrays have a row for each different (context, byte).
    """

    def __init__(self, counts: list[np.ndarray]) -> None:
        #: Of each length of context: codes of (context, byte) and their bits; contexts and the bits of their escape.
        self.seen: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        shorter = np.zeros(0)
        for k, (code, count) in enumerate(counts):
            context, first, which = np.unique(code >> 8, return_index=True, return_inverse=True)
            n = np.bincount(which, count, len(context))
            d = np.diff(np.append(first, len(code))).astype(float)
            # What the shorter context gives to the bytes that are seen here: it has seen them too.
            below = np.full(len(code), 1 / 256) if k == 0 else shorter[look_up(counts[k - 1][0], code & ((1 << 8 * k) - 1))[0]]
            full = d == 256  # nothing is left to escape to
            rest = np.maximum(1 - np.bincount(which, below, len(context)), 1e-15)
            shorter = count / (n + np.where(full, 0, d))[which]
            escape = np.where(full, 0, -np.log2(d / (n + d) / rest))
            self.seen.append((code, (-np.log2(shorter)).astype(np.float32), context, escape.astype(np.float32)))

    def bits(self, code: np.ndarray) -> np.ndarray:
        """Code length of the byte of each of ``code``, as :func:`codes` makes them."""
        out, todo = np.zeros(len(code)), np.arange(len(code))
        for k in range(len(self.seen) - 1, -1, -1):
            seen, bits, contexts, escapes = self.seen[k]
            here = todo[code[todo] >> (8 * (k + 1)) > 0]
            short = code[here] & ((1 << 8 * (k + 1)) - 1)
            at, found = look_up(seen, short)
            out[here[found]] += bits[at[found]]
            here, short = here[~found], short[~found]
            at, known = look_up(contexts, short >> 8)
            out[here[known]] += escapes[at[known]]
            todo = np.union1d(here, todo[code[todo] >> (8 * (k + 1)) == 0])
        out[todo] += 8
        return out


class ContextTrees:
    """A tree for each language, in the order of their names."""

    def __init__(self, counts: dict[str, list[np.ndarray]], order: int) -> None:
        self.langs, self.order = sorted(counts), order
        self.trees = [ContextTree(counts[lang]) for lang in self.langs]

    def size(self) -> int:
        """Bytes of all arrays."""
        return sum(x.nbytes for tree in self.trees for rows in tree.seen for x in rows)


class Coder:
    """Code lengths under frozen trees; a worker remembers those of places met before, in ``REMEMBERED`` bytes."""

    def __init__(self, trees: ContextTrees) -> None:
        self.trees, n = trees, len(trees.langs)
        self.shift = 64 - max(10, int(np.log2(REMEMBERED / (8 + 4 * n))))
        self.keys = np.zeros(1 << (64 - self.shift), np.int64)
        self.known = np.zeros((n, len(self.keys)), np.float32)

    def places(self, code: np.ndarray) -> np.ndarray:
        """(language, place): bits of each place."""
        slot = (code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.shift)).astype(np.int64)
        new = np.flatnonzero(self.keys[slot] != code)
        out = self.known[:, slot]
        if len(new):
            fresh, which = np.unique(code[new], return_inverse=True)
            bits = np.stack([tree.bits(fresh) for tree in self.trees.trees]).astype(np.float32)
            out[:, new] = bits[:, which]
            _, last = np.unique(slot[new][::-1], return_index=True)  # one of those that meet in a slot
            last = len(new) - 1 - last
            self.keys[slot[new[last]]] = code[new[last]]
            self.known[:, slot[new[last]]] = bits[:, which[last]]
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """(text, language): bits that the whole text takes."""
        out = np.zeros((len(texts), len(self.trees.langs)))
        filled = np.array([i for i, t in enumerate(texts) if t], np.int64)
        if not len(filled):
            return out
        lengths = np.array([len(texts[i]) for i in filled])
        joined = np.frombuffer(b"".join(texts), np.uint8)
        firsts, order = np.cumsum(lengths) - lengths, self.trees.order
        for a in range(0, len(joined), STEP):
            b = min(a + STEP, len(joined))
            early = max(0, a - order)
            first, last = np.searchsorted(firsts, a, side="right") - 1, np.searchsorted(firsts, b)
            owner = np.searchsorted(firsts, np.arange(early, b), side="right") - 1
            code = codes(joined[early:b], np.minimum(np.arange(early, b) - firsts[owner], np.arange(b - early)), order)[a - early :]
            starts = np.maximum(firsts[first:last], a) - a
            out[filled[first:last]] += np.add.reduceat(self.places(code), starts, axis=1, dtype=np.float64).T
        return out


def sample(labelled: DataFrame, docs_per_lang: int, most_langs: int, seed: int) -> DataFrame:
    """(lang, text): of each language the ``docs_per_lang`` different texts of least hash, or all that it has.

    An estimate of the number of different texts gives a bound on the hash that about twice as many pass, so that no
    task has to order all the texts of a hot language. Texts whose 64-bit hashes are equal count as one.
    """
    usable = labelled.where("text is not null and lang is not null and text <> ''").select("text", F.col("lang").cast("string").alias("lang"))
    usable = usable.withColumn("h", F.xxhash64(F.lit(seed), "text"))
    totals = usable.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).limit(most_langs + 1).collect()
    if len(totals) > most_langs:
        raise ValueError(f"over {most_langs} languages")
    bounds = [(r.lang, min(1.0, (2 * docs_per_lang + 100) / r.n)) for r in totals]
    bounds = labelled.sparkSession.createDataFrame(bounds, "lang string, share double")  # most_langs rows at most
    below = F.pmod(F.col("h"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    drawn = usable.join(F.broadcast(bounds), "lang").where(below).groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.pmod(F.col("h"), F.lit(1 << 30)), "h")
    return drawn.withColumn("at", F.row_number().over(order)).where(F.col("at") <= docs_per_lang).select("lang", "text")


def train(labelled: DataFrame, order: int = 3, docs_per_lang: int = 1500, seed: int = 5, most_langs: int = 1000) -> ContextTrees | None:
    """Trees from (text, lang): at most ``docs_per_lang`` different texts of each language, those of least hash.

    That number, a parameter, bounds what is learned from; drawn texts count whole, and once, however many copies there
    are. Counts are summed in partitions, then by language. All contexts of the sample are kept: a tree has 12 bytes for
    each different (context, byte) and 12 for each context, so memory is in proportion to the languages, of which over
    ``most_langs`` are an error. None if no row has both a text and a language.
    """
    if not 0 <= order <= MOST_ORDER:
        raise ValueError(f"order must be 0 to {MOST_ORDER}")
    drawn = sample(labelled, docs_per_lang, most_langs, seed)

    def counted(texts: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        for lang, mine in texts.items():
            for k, (code, count) in enumerate(count_contexts(mine, order)):
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(code), "k": pa.array([k] * len(code), pa.int32()), "code": code, "n": count})

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for t, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                texts.setdefault(lang, []).append(t.encode("utf-8", "surrogatepass"))
                size += len(texts[lang][-1])
                if size >= BLOCK:
                    yield from counted(texts)
                    texts, size = {}, 0
        yield from counted(texts)

    parts = drawn.mapInArrow(partial, "lang string, k int, code long, n long")
    summed = parts.groupBy("lang", "k", "code").agg(F.sum("n").alias("n")).orderBy("lang", "k", "code").toArrow()
    if not summed.num_rows:
        return None
    langs, ks = summed.column("lang").combine_chunks().dictionary_encode(), summed.column("k").to_numpy()
    code, n, which = summed.column("code").to_numpy(), summed.column("n").to_numpy(), langs.indices.to_numpy()
    counts = {}
    for j, lang in enumerate(langs.dictionary.to_pylist()):
        here = [np.flatnonzero((which == j) & (ks == k)) for k in range(order + 1)]
        counts[lang] = [np.stack([code[x], n[x]]) for x in here]
    return ContextTrees(counts, order)


def identify(docs: DataFrame, trees: ContextTrees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row: the language that codes the whole text in the fewest bits.

    score is that language's share when each weighs 2 to the power of minus its bits; ties go to the first language
    by name. ``und`` with score 0 if the text is null, empty or without a letter, or if nothing was learned.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select("doc_id", F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    if trees is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, coder = shared.value.langs, Coder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column("text").to_pylist()
                bits = coder.code_lengths([(t or "").encode("utf-8", "surrogatepass") for t in texts])
                best = bits.argmin(axis=1)
                score = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                preds = [langs[b] if t is not None else "und" for b, t in zip(best, texts, strict=True)]
                scores = [float(s) if t is not None else 0.0 for s, t in zip(score, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify_held_out(docs: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows whose crc32(id as text) mod 4 is not 2, identify all: doc_id, held_out, lang_pred, score."""
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    trees = train(rows.where(crc_remainder(F.col("doc_id"), 4) != 2), order)
    found = identify(rows, trees)
    return found.select("doc_id", (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")

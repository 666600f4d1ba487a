"""Toxic spans by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, crc_remainder, keep_where, pick

#: Words that a worker remembers, and the longest of them, in bytes.
MOST_WORDS, LONGEST = 200_000, 60
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Marginals from here on count for a document's score.
FLOOR = 0.2
#: What the largest marginal counts for in a text without any from there on.
FAINT = 0.05
#: Evidence beyond this makes no difference to a score.
MOST_EVIDENCE = 10.0
#: Tokens of context around what is trained on, and the longest stretch of it that is one sequence.
MARGIN, RUN = 8, 64
#: Tokens of training material that are worked on at a time.
TOKENS = 1 << 17


def features(word: str) -> list[str]:
    """Of a token, marks around it taken off, in lower case: itself, its beginnings and its end."""
    core = word.lower()
    if not core.isalpha():
        core = re.sub(r"^[\W_]+|[\W_]+$", "", core)
    return [f"={core}", *[f"^{core[:k]}" for k in range(3, 7) if len(core) >= k], f"{core[-3:]}$"]


def copies(texts: list[str]) -> list[np.ndarray]:
    """Two numberings of the texts in which copies, and most near copies, share a number: least shingle hashes."""
    least = np.zeros((2, len(texts)), np.uint64)
    for i, t in enumerate(texts):
        words = t.encode("utf-8", "surrogatepass").lower().split()
        shingles = [b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))]
        for s in (0, 1):
            least[s, i] = min(xxhash.xxh64_intdigest(x, s) for x in shingles)
    return [np.unique(row, return_inverse=True)[1] for row in least]


class Corpus:
    """A bounded sample of labelled texts: their words as numbers, and the features of each different word."""

    def __init__(self, texts: list[str], toxic: list[bool]) -> None:
        number: defaultdict[str, int] = defaultdict(count().__next__)
        self.texts = [np.fromiter((number[m[0]] for m in WORDS.finditer(t)), np.int32) for t in texts]
        self.toxic, self.n_words = np.array(toxic, bool), len(number)
        index: defaultdict[str, int] = defaultdict(count().__next__)
        cols, width = array("i"), array("i")
        for w in number:
            found = features(w)
            cols.extend([index[f] for f in found])
            width.append(len(found))
        del number
        #: Features of word i: cols from starts[i], width[i] of them; the first is the word itself, the last its end.
        self.cols, self.width = np.array(cols, np.int32), np.array(width, np.int32)
        self.starts = np.cumsum(self.width, dtype=np.int64) - self.width
        self.owner = np.repeat(np.arange(self.n_words, dtype=np.int32), self.width)
        self.names = list(index)
        numbers = copies(texts)
        self.single, self.half = np.ones(len(texts), bool), np.zeros(len(texts), np.int64)
        for group in numbers:
            self.single &= np.isin(np.arange(len(texts)), np.unique(group, return_index=True)[1])
            self.half = group % 2

    def features_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``words``, feature) for all features of each."""
        size = self.width[words]
        place = np.repeat(np.arange(len(words)), size)
        return place, self.cols[self.starts[words][place] + np.arange(len(place)) - (np.cumsum(size) - size)[place]]

    def documents(self, chosen: np.ndarray, without: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Toxic and clean texts among ``chosen`` that have each feature (ends of words not counted), copies once."""
        out = []
        for y in (True, False):
            mine = [i for i in chosen if self.single[i] and self.toxic[i] == y]
            total = np.zeros(len(self.names), np.int64)
            for i in mine:
                words = np.unique(self.texts[i])
                place, f = self.features_of(words[~without[words]])
                last = np.append(np.diff(place) > 0, True) if len(place) else np.zeros(0, bool)
                total[np.unique(f[~last])] += 1
            out.append(total)
        return out[0], out[1]


def token_labels(corpus: Corpus, chosen: np.ndarray, prior: float = 1.0, purity: float = 0.6, doubt: float = 0.05, harmless: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """(features that mark toxic tokens, words that are harmless in spite of them), learned from the labels of texts.

    A word is harmless if clean texts are a share of ``harmless`` of those that have it, and two at least. A word or
    beginning marks if, harmless words left out, at least ``purity`` of all texts that have it are toxic, three at least,
    and so many that chance gives as much to any candidate with a probability below ``doubt`` (a Chernoff bound). A clean
    text counts ``prior`` times, to make up for its rate of sampling. Texts that share a least shingle hash count once,
    so words that copies of a toxic text share don't pass for marks.
    """
    nothing = np.zeros(corpus.n_words, bool)
    bad, good = corpus.documents(chosen, nothing)
    itself = corpus.cols[corpus.starts]
    safe = (good[itself] >= 2) & (prior * good[itself] >= harmless * (bad[itself] + prior * good[itself]))
    n_bad = int((corpus.toxic & corpus.single)[chosen].sum())
    n_good = prior * int((~corpus.toxic & corpus.single)[chosen].sum())
    if not n_bad:
        return np.zeros(len(corpus.names), bool), safe
    base = min(n_bad / (n_bad + n_good), 0.999)
    bad, good = corpus.documents(chosen, safe)
    total = np.maximum(bad + prior * good, 1)
    share = bad / total
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = share * np.log(share / base) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - base)), 0)
    candidates = bad >= 3
    return candidates & (share >= purity) & (share > base) & (total * gap >= np.log(max(int(candidates.sum()), 1) / doubt)), safe


class Field:
    """Two states, 0 and 1 (toxic); a token's features weigh for state 1, and pairs of states have weights."""

    def __init__(self, weights: dict[str, float], bias: float, steps: np.ndarray, start: np.ndarray) -> None:
        self.weights, self.bias, self.steps, self.start = weights, bias, steps, start
        #: Slope and offset of the score by evidence.
        self.calibration = (1.0, -1.0)

    def emission(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))

    def passes(self, emissions: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward shares of state 1 at every token of sequences that lie one after the other.

        All sequences take a step at a time; the longest are first, so those that have ended drop off the end.
        """
        firsts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        first, length = firsts[order], lengths[order]
        odds = np.exp(np.clip(emissions, -40, 40))
        t, s = np.exp(self.steps), np.exp(self.start)
        forward, backward = np.zeros(len(emissions)), np.zeros(len(emissions))
        longest = int(length[0]) if len(length) else 0
        active = np.searchsorted(-length, -np.arange(longest), side="left")  # sequences longer than step
        p = np.zeros(0)
        for i in range(longest):
            at = first[: active[i]] + i
            up, down = (s[1], s[0]) if i == 0 else (p[: len(at)] * t[1, 1] + (1 - p[: len(at)]) * t[0, 1], p[: len(at)] * t[1, 0] + (1 - p[: len(at)]) * t[0, 0])
            up = up * odds[at]
            p = up / (up + down)
            forward[at] = p
        p = np.zeros(0)
        for i in range(longest - 1, -1, -1):
            at = first[: active[i]] + i
            b = np.full(len(at), 0.5)
            b[: len(p)] = p  # those that have a later token
            backward[at] = b
            up, down = b * odds[at], 1 - b
            to1, to0 = t[1, 1] * up + t[1, 0] * down, t[0, 1] * up + t[0, 0] * down
            p = to1 / (to1 + to0)
        return forward, backward

    def marginals(self, emissions: np.ndarray, lengths: np.ndarray, passed: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Probability of state 1 at every token."""
        forward, backward = passed or self.passes(emissions, lengths)
        joint1, joint0 = forward * backward, (1 - forward) * (1 - backward)
        return joint1 / (joint1 + joint0)

    def pairs(self, emissions: np.ndarray, lengths: np.ndarray, weights: np.ndarray, passed: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Expected number of each pair of neighbouring states; a pair weighs what its second token weighs."""
        forward, backward = passed or self.passes(emissions, lengths)
        inner = np.ones(len(emissions), bool)
        inner[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
        at = np.flatnonzero(inner)
        odds, t = np.exp(np.clip(emissions[at], -40, 40)), np.exp(self.steps)
        left = (1 - forward[at - 1], forward[at - 1])
        right = (1 - backward[at], backward[at] * odds)
        joint = [left[i] * right[j] * t[i, j] for i in (0, 1) for j in (0, 1)]
        share = weights[at] / (joint[0] + joint[1] + joint[2] + joint[3])
        return np.array([share @ x for x in joint]).reshape(2, 2)


def segments(centres: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Runs of the places 0..n-1 that lie within ``MARGIN`` of one of ``centres``, in parts of ``RUN`` at most."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.maximum(centres - MARGIN, 0), 1)
    np.add.at(change, np.minimum(centres + MARGIN + 1, n), -1)
    inside = np.concatenate(([0], np.cumsum(change[:-1]) > 0, [0]))
    ends = np.flatnonzero(np.diff(inside)).reshape(-1, 2).tolist()
    return [(k, min(k + RUN, b)) for a, b in ends for k in range(a, b, RUN)]


class Sequences:
    """Training material: words and tags of sequences that lie one after the other, their lengths and weights."""

    def __init__(self, corpus: Corpus, made: list[tuple[np.ndarray, np.ndarray, float]]) -> None:
        words, self.tags = np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made]).astype(np.int8)
        self.lengths = np.array([len(m[0]) for m in made], np.int64)
        self.each = np.repeat(np.array([m[2] for m in made], np.float32), self.lengths)
        self.met, words = np.unique(words, return_inverse=True)
        self.words = words.astype(np.int32)
        self.owner, self.cols = corpus.features_of(self.met)
        often = np.bincount(self.cols, np.bincount(self.words, minlength=len(self.met))[self.owner], len(corpus.names)) >= 2
        self.owner, self.cols = self.owner[often[self.cols]], self.cols[often[self.cols]]
        firsts = np.cumsum(self.lengths) - self.lengths
        inner = np.ones(len(self.tags), bool)
        inner[firsts] = False
        second = np.flatnonzero(inner)
        pair = 2 * self.tags[second - 1] + self.tags[second]
        self.seen = np.bincount(pair, self.each[second], 4).reshape(2, 2)
        #: (first and last sequence, first and last token) of blocks of about ``TOKENS``.
        cuts = np.append(np.unique(firsts // TOKENS, return_index=True)[1], len(self.lengths))
        ends = np.append(firsts, len(self.tags))
        self.blocks = [(a, b, ends[a], ends[b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def gradient(self, field: Field, w: np.ndarray, l2: float) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
        """Of the weighted negative log-likelihood and the penalty: by feature weights, bias, steps and start."""
        by_word, by_pair, lead = np.zeros(len(self.met)), -self.seen, 0.0
        emissions = field.bias + np.bincount(self.owner, w[self.cols], len(self.met))
        for a, b, first, last in self.blocks:
            words, lengths, each = self.words[first:last], self.lengths[a:b], self.each[first:last]
            e = emissions[words]
            passed = field.passes(e, lengths)
            delta = (field.marginals(e, lengths, passed) - self.tags[first:last]) * each
            by_word += np.bincount(words, delta, len(self.met))
            by_pair = by_pair + field.pairs(e, lengths, each, passed)
            lead += delta[np.cumsum(lengths) - lengths].sum()
        return (
            np.bincount(self.cols, by_word[self.owner], len(w)) + l2 * w,
            by_word.sum(),
            by_pair + l2 * field.steps,
            np.array([-lead, lead]) + l2 * field.start,
        )


def learn(corpus: Corpus, chosen: np.ndarray, prior: float, epochs: int, rate: float, l2: float, plain: int, seed: int) -> tuple[Field, np.ndarray] | None:
    """A field from the texts ``chosen``, and its weights by feature; None where no token can be labelled as toxic."""
    marks, safe = token_labels(corpus, chosen, prior)
    names = corpus.names
    alike = {names[f][1:4] for f in np.flatnonzero(marks)}
    marked = np.bincount(corpus.owner, marks[corpus.cols], corpus.n_words) > 0
    looks = np.array([n[0] in "=^" and n[1:4] in alike for n in names])
    like = np.bincount(corpus.owner, looks[corpus.cols], corpus.n_words) > 0
    sizes = np.array([0 if corpus.toxic[i] else len(corpus.texts[i]) for i in chosen], np.int64)
    ends = np.cumsum(sizes)
    total = int(sizes.sum())
    drawn = np.sort(np.random.default_rng(seed).integers(0, max(total, 1), min(plain, total)))
    made = []
    for i, size, end in zip(chosen, sizes, ends, strict=True):
        words = corpus.texts[i]
        if corpus.toxic[i]:
            tags = marked[words] & ~safe[words]
            centres = np.flatnonzero(tags)
        else:
            tags = np.zeros(len(words), bool)
            centres = np.concatenate((np.flatnonzero(like[words]), drawn[np.searchsorted(drawn, end - size) : np.searchsorted(drawn, end)] - (end - size)))
        made += [(words[a:b], tags[a:b], 1.0 if corpus.toxic[i] else prior) for a, b in segments(centres, len(words))]
    if not any(m[1].any() for m in made):
        return None
    data, field, w = Sequences(corpus, made), Field({}, -2.0, np.zeros((2, 2)), np.zeros(2)), np.zeros(len(names))
    past = [np.ones(x.shape) for x in (w, np.zeros(()), field.steps, field.start)]
    for _ in range(epochs):
        moves = []
        for g, p in zip(data.gradient(field, w, l2), past, strict=True):
            p += np.square(g)
            moves.append(rate * g / np.sqrt(p))
        w -= moves[0]
        field.bias -= float(moves[1])
        field.steps, field.start = field.steps - moves[2], field.start - moves[3]
    field.weights = {names[f]: float(w[f]) for f in np.flatnonzero(np.abs(w) > 1e-3)}
    return field, w


def evidence(p: np.ndarray, lengths: np.ndarray, floor: float) -> np.ndarray:
    """Of each text, the sum of -log(1 - p) over the marginals p of its tokens that are ``floor`` or more."""
    out, high = np.zeros(len(lengths)), np.flatnonzero(p >= floor)
    np.add.at(out, np.searchsorted(np.cumsum(lengths), high, side="right"), -np.log1p(-np.minimum(p[high], 1 - 1e-12)))
    return out


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, l2: float = 0.01, steps: int = 50) -> tuple[float, float]:
    """(slope, offset) of the chance of 1 by ``x``; the slope is penalised, and not below 0."""
    z, beta = np.stack((x, np.ones(len(x))), axis=1), np.zeros(2)
    penalty = np.diag([l2, 1e-6])

    def loss(b: np.ndarray) -> float:
        return float((weights * np.logaddexp(0, np.where(y, -1, 1) * (z @ b))).sum() + 0.5 * b @ penalty @ b)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -40, 40)))
        move = np.linalg.solve((z * (weights * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (weights * (p - y)) + penalty @ beta)
        while loss(beta - move) > loss(beta) and np.abs(move).max() > 1e-9:
            move /= 2
        beta = beta - move
    return max(float(beta[0]), 0.0), float(beta[1])


def fit(texts: list[str], toxic: list[bool], prior: float = 1.0, epochs: int = 60, rate: float = 0.3, l2: float = 1.0, plain: int = 20_000, seed: int = 11) -> Field:
    """A field, and how a text's evidence becomes a score.

    Tokens are labelled by :func:`token_labels`; the field is trained on stretches around all toxic ones, around all
    tokens of clean texts that begin as toxic ones do, wherever they are in the text, and around ``plain`` places more,
    drawn from the whole of the clean texts. Stretches of clean texts weigh ``prior``. AdaGrad on the conditional
    likelihood. The score's calibration needs evidence that a text itself hasn't shaped: that of each half of the texts
    (near copies in the same half) under a field from the other half, with half the epochs. Texts without evidence have no part in it; one
    toxic and one clean case are added, which keep it in bounds where either kind is missing.
    """
    corpus = Corpus(texts, toxic)
    every = np.arange(len(texts))
    learned = learn(corpus, every, prior, epochs, rate, l2, plain, seed)
    if learned is None:
        return Field({}, -4.0, np.zeros((2, 2)), np.zeros(2))
    x, y = [FLOOR, 5.0], [False, True]
    for half in (0, 1):
        rest, mine = every[corpus.half != half], every[corpus.half == half]
        part = learn(corpus, rest, prior, epochs // 2, rate, l2, plain // 2, seed)
        if part is not None and len(mine):
            field, w = part
            by_word = field.bias + np.bincount(corpus.owner, w[corpus.cols], corpus.n_words)
            lengths = np.array([len(corpus.texts[i]) for i in mine])
            p = field.marginals(by_word[np.concatenate([corpus.texts[i] for i in mine])], lengths)
            found = evidence(p, lengths, FLOOR)
            x += np.minimum(found[found > 0], MOST_EVIDENCE).tolist()
            y += corpus.toxic[mine][found > 0].tolist()
    field = learned[0]
    field.calibration = logistic(np.array(x), np.array(y), np.where(y, 1.0, prior))
    return field


def training_texts(docs: DataFrame, labels: DataFrame, most_toxic: int, most_clean: int, most_bytes: int, hold_out: tuple[int, int], id_col: str, text_col: str, label_col: str) -> tuple[list[str], list[bool], float]:
    """(texts, labels, prior): different texts of labelled ids that aren't held out, at most so many of each label.

    Those of least hash, copies once; toxic ones up to a third of ``most_bytes`` and clean ones up to the rest (one at least). Only
    hashes and sizes are ordered; the drawn hashes are few enough to broadcast. A text with both labels is toxic. prior
    is how many times as thinly clean texts are drawn as toxic ones.
    """
    spark = docs.sparkSession
    known = pick(labels, label_id="doc_id", y=label_col).where("y in (0, 1) and label_id is not null")
    known = known.where(crc_remainder(F.col("label_id"), hold_out[0]) != hold_out[1]).groupBy("label_id").agg(F.max("y").alias("y"))
    rows = pick(docs, doc_id=id_col, text=text_col).where("text is not null").withColumn("h", F.xxhash64(F.lit(7), "text"))
    found = rows.select("doc_id", "h", F.octet_length("text").alias("n")).join(known, F.col("doc_id") == F.col("label_id"))
    found = checkpoint(found.groupBy("h").agg(F.max("n").alias("n"), F.max("y").alias("y")))
    totals = {r.y: r["count"] for r in found.groupBy("y").count().collect()}
    drawn: dict[int, int] = {}
    rates = {}
    for y, most, room in ((1, most_toxic, most_bytes // 3), (0, most_clean, most_bytes - most_bytes // 3)):
        least = found.where(F.col("y") == y).orderBy("h").limit(most).select("h", "n").collect()
        fits = np.cumsum([r.n for r in least]) <= room
        mine = [r.h for i, r in enumerate(least) if i == 0 or fits[i]]
        drawn |= dict.fromkeys(mine, y)
        rates[y] = len(mine) / max(totals.get(y, 0), 1)
    if not drawn:
        return [], [], 1.0
    wanted = spark.createDataFrame(list(drawn.items()), "h long, y int")
    texts = rows.select("h", "text").join(F.broadcast(wanted), "h").groupBy("h").agg(F.min("text").alias("text"), F.max("y").alias("y")).orderBy("h").toArrow()
    prior = rates[1] / rates[0] if rates[0] and rates[1] else 1.0
    return texts.column("text").to_pylist(), [bool(y) for y in texts.column("y").to_pylist()], prior


class Tagger:
    """Scores of texts, for the life of a task: words' emissions are remembered."""

    def __init__(self, field: Field, floor: float) -> None:
        self.field, self.floor, self.known = field, floor, {}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score of each text, marginal of each token of all, first token of each text)."""
        lengths, values, known = np.zeros(len(texts), np.int64), array("d"), self.known
        for i, t in enumerate(texts):
            pieces = (t or "").encode("utf-8", "surrogatepass").split()
            lengths[i] = len(pieces)
            for w in pieces:
                e = known.get(w)
                if e is None:
                    e = self.field.emission(w.decode("utf-8", "surrogatepass"))
                    if len(known) < MOST_WORDS and len(w) <= LONGEST:
                        known[w] = e
                values.append(e)
        p = self.field.marginals(np.frombuffer(values), lengths) if values else np.zeros(0)
        firsts, filled, scores = np.cumsum(lengths) - lengths, lengths > 0, np.zeros(len(texts))
        if len(p):
            scores[filled] = FAINT * np.maximum.reduceat(p, firsts[filled])
        found = evidence(p, lengths, self.floor)
        slope, offset = self.field.calibration
        scores[found > 0] = 1 / (1 + np.exp(-(slope * np.minimum(found[found > 0], MOST_EVIDENCE) + offset)))
        return scores, p, firsts


def tag_documents(docs: DataFrame, field: Field, floor: float = FLOOR, mark: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, spans) for every row: whole texts, every token.

    The evidence of a text is the sum of -log(1 - p) over its tokens' marginals p of ``floor`` or more, which is -log of
    the chance that none is toxic, as if they were independent; score is its calibrated chance. Without such tokens it is
    a small part of the largest marginal, and 0 for a text that is null or without words. spans are the tokens with a
    marginal of ``mark`` or more: start and end in characters, and the marginal.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(field)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value, floor)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column("text").to_pylist()
                scores, p, firsts = tagger(texts)
                spans = [[] for _ in texts]
                for i in sorted(set((np.searchsorted(firsts, np.flatnonzero(p >= mark), side="right") - 1).tolist())):
                    for k, m in enumerate(WORDS.finditer(texts[i] or "")):
                        if p[firsts[i] + k] >= mark:
                            spans[i].append({"start": m.start(), "end": m.end(), "marginal": float(p[firsts[i] + k])})
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores), pa.array(spans, span)], ["doc_id", "score", "spans"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double, spans array<struct<start:int,end:int,marginal:double>>")


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    most_toxic: int = 1500,
    most_clean: int = 3000,
    most_bytes: int = 16 << 20,
    hold_out: tuple[int, int] = (4, 2),
    cut: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) for every row.

    Learns from labelled rows whose crc32(id as text) mod ``hold_out[0]`` is not ``hold_out[1]``: at most ``most_toxic``
    and ``most_clean`` different texts, of ``most_bytes`` together (see :func:`training_texts`); the driver holds these,
    and fits the field. Without toxic labels no text scores high. Null and empty texts score 0. Rows alike are scored
    alike; an empty table gives an empty result; other columns are ignored.
    """
    model = fit(*training_texts(docs, labels, most_toxic, most_clean, most_bytes, hold_out, id_col, text_col, label_col))
    tagged = tag_documents(docs, model, id_col=id_col, text_col=text_col)
    held_out = crc_remainder(F.col("doc_id"), hold_out[0]) == hold_out[1]
    return tagged.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "spans")


def keep_clean(
    docs: DataFrame,
    labels: DataFrame,
    most_toxic: int = 1500,
    most_clean: int = 3000,
    most_bytes: int = 16 << 20,
    hold_out: tuple[int, int] = (4, 2),
    cut: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """``docs``, all columns, without the rows whose text scores ``cut`` or more; learning as in :func:`score_toxicity`.

    Null and empty texts score 0 and stay.
    """
    model = fit(*training_texts(docs, labels, most_toxic, most_clean, most_bytes, hold_out, id_col, text_col, label_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    taggers: dict[int, Tagger] = {}  # one for each task's copy of this function

    def clean(texts: list) -> np.ndarray:
        if not taggers:
            taggers[0] = Tagger(shared.value, FLOOR)
        return taggers[0](texts)[0] < cut

    return keep_where(docs, text_col, clean, 512)

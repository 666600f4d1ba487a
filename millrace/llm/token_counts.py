"""Token counts without ids: pieces are counted once for each different pre-token."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ENDINGS, LONGEST, LOOSE, marked, place, plain, tokenizer
from .common import pick, stored

#: Different chunks that a task gathers before it hands on what it has counted.
MOST_CHUNKS = 250_000


class PreTokens:
    """Pre-tokens of byte-level BPE, by chunks: text between spaces, with the space that leads it."""

    def __init__(self, path: str) -> None:
        self.whole = tokenizer(path)
        self.cut = self.whole.pre_tokenizer
        self.specials = sorted((t.content for t in self.whole.get_added_tokens_decoder().values()), key=len, reverse=True)

    def segments(self, text: str) -> tuple[list[str], int]:
        """Text between special tokens, and how many of those there are."""
        parts = [text]
        for s in self.specials:
            if s in text:
                parts = [x for p in parts for x in p.split(s)]
        return [p for p in parts if p], len(parts) - 1

    def chunks(self, text: str) -> tuple[list[str], int]:
        """Chunks whose pre-tokens, one chunk after the other, are those of the text; the number of special tokens."""
        parts, n = self.segments(text)
        out: list[str] = []
        for p in parts:
            if LOOSE.search(p):
                out.append(p)
                continue
            first, *rest = p.split(" ")
            if first:
                out.append(first)
            out += [" " + x for x in rest]
        return out, n

    def of(self, chunk: str) -> list[str]:
        body = chunk[1:] if chunk[:1] == " " else chunk
        core = body.rstrip(ENDINGS)
        if plain(core):
            lead = chunk[: len(chunk) - len(body)]
            return [lead + core, body[len(core) :]] if len(core) < len(body) else [chunk]
        return [chunk[a:b] for _, (a, b) in self.cut.pre_tokenize_str(chunk)]


def least_frequency(vocabulary: DataFrame, most: int) -> int:
    """A frequency that at most ``most`` pre-tokens reach, from a histogram of a few hundred steps: no global sort."""
    step = F.floor(F.log2("n") * 16)
    left, least = most, 1 << 62
    for r in vocabulary.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).orderBy(F.col("step").desc()).collect():
        left -= r.k
        if left < 0:
            break
        least = r.least
    return least


def count_tokens(
    docs: DataFrame,
    tokenizer_name: str = "byte_bpe_50k.json",
    limit: int = 1024,
    dictionary: int = 1 << 18,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``, as the tokenizer counts its whole text.

    1. Each task counts its different pre-tokens; the counts are summed by pre-token. 2. A pre-token's pieces are
    counted once. 3. The most frequent pre-tokens, ``dictionary`` of them at most, are broadcast (so none that
    is left is hot); each document's frequencies of those are joined where it is read, and its frequencies of all
    others are joined to the table of pieces by a shuffle. 4. The sums meet by row. Ids are never made.

    The tokenizer must be byte-level BPE without a normalizer. A special token's string inside a text is one token, as
    the library has it by default. Null and empty texts have no bytes and no tokens; rows alike are counted alike; an
    empty table gives an empty result; other columns are ignored.
    """
    path = place(tokenizer_name)
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, seen = PreTokens(path), Counter()

        def summed() -> pa.RecordBatch:
            total: Counter = Counter()
            for chunk, n in seen.items():
                for p in cutter.of(chunk):
                    total[p] += n
            seen.clear()
            return pa.RecordBatch.from_pydict({"pre": list(total), "n": pa.array(list(total.values()), pa.int64())})

        for batch in batches:
            for t in batch.column("text").to_pylist():
                seen.update(cutter.chunks(t)[0])
                if len(seen) > MOST_CHUNKS:
                    yield summed()
        if seen:
            yield summed()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path).model
        for batch in batches:
            counts = [len(model.tokenize(marked(p))) for p in batch.column("pre").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("pre"), batch.column("n"), pa.array(counts, pa.int32())], ["pre", "n", "pieces"])

    freq = rows.select("text").mapInArrow(gather, "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n"))
    vocabulary = stored(freq.mapInArrow(pieces, "pre string, n long, pieces int"))
    top = vocabulary.where(F.col("n") >= least_frequency(vocabulary, dictionary)).select("pre", "pieces").toArrow()
    frequent = dict(zip(top.column("pre").to_pylist(), top.column("pieces").to_pylist(), strict=True))
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, known = PreTokens(path), shared.value
        sums: dict[str, int] = {}
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, known_sums, rare, times = [], [], [], []
            for t in batch.column("text").to_pylist():
                chunks, total = cutter.chunks(t)
                others: Counter = Counter()
                for c in chunks:
                    got = sums.get(c)
                    if got is None:
                        pre = cutter.of(c)
                        left = [p for p in pre if p not in known]
                        got = sum(known[p] for p in pre if p in known)
                        others.update(left)
                        if not left and len(sums) < MOST_CHUNKS and len(c) <= LONGEST:
                            sums[c] = got
                    total += got
                ids.append(row)
                row += 1
                known_sums.append(total)
                rare.append(list(others))
                times.append(list(others.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), batch.column("doc_id"), batch.column("n_bytes"), pa.array(known_sums, pa.int64()), pa.array(rare, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))],
                ["row", "doc_id", "n_bytes", "known", "rare", "times"],
            )

    sized = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    found = stored(sized.mapInArrow(per_document, f"row long, doc_id {kind}, n_bytes long, known long, rare array<string>, times array<long>"))
    pairs = found.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("pre"), F.col("x.times").alias("times"))
    rest = pairs.join(vocabulary.select("pre", "pieces").hint("shuffle_hash"), "pre").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("rest"))
    total = F.col("known") + F.coalesce("rest", F.lit(0))
    counted = found.select("row", "doc_id", "n_bytes", "known").join(rest, "row", "left")
    return counted.select("doc_id", "n_bytes", total.cast("long").alias("n_tokens"), (total > limit).alias("over_limit"))

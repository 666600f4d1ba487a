"""Quality rules: repetition within a text, and lines that too many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, checkpoint, pick

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Keys of frequent lines up to which they are broadcast: 16 bytes each.
MOST_BROADCAST = 1_000_000


def normalised(line: Column) -> Column:
    """A line as it is compared across documents: lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def _lines(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def base_rules(rows: DataFrame, window: int = 5) -> DataFrame:
    """``rows`` (text not null, ...) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and ``lines``.

    A window that occurs again is found by its 64-bit hash: hashes are made distinct, and sorted with their places only
    in a text that has any twice, so a long text costs n log n.
    """
    rows = rows.withColumn("words", F.transform(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda x: F.xxhash64(x)))
    rows = rows.withColumn("lines", _lines(F.col("text"))).withColumn("n_words", F.size("words").cast("long"))
    places = F.sequence(F.lit(0), F.size("words") - window)
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(window)]))
    rows = rows.withColumn("grams", F.when(F.col("n_words") >= window, hashes))
    rows = rows.withColumn("twice", F.size(F.array_distinct("grams")) < F.size("grams"))
    rows = rows.withColumn("sorted", F.when(F.col("twice"), F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))

    def again(x: Column, i: Column) -> Column:
        before, after = F.when(i > 0, F.get("sorted", i - 1)), F.get("sorted", i + 1)
        return F.coalesce(before["g"] == x["g"], F.lit(False)) | F.coalesce(after["g"] == x["g"], F.lit(False))

    rows = rows.withColumn("hits", F.sort_array(F.transform(F.filter("sorted", again), lambda x: x["i"])))
    covered = F.transform("hits", lambda p, i: F.least(F.coalesce(F.get("hits", i + 1) - p, F.lit(window)), F.lit(window)))
    return rows.select(
        "*",
        (F.length("text") - F.coalesce(F.regexp_count("text", F.lit(r"[\x20\x09-\x0D]")), F.lit(0))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
    ).drop("words", "grams", "twice", "sorted", "hits")


def _keyed(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    rows = pick(docs, doc_id=id_col, text=text_col, host=host_col).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumn("host_key", F.xxhash64("host")).withColumn("text_key", F.xxhash64("text"))


def frequent_lines(base: DataFrame, min_docs: int, by_text: bool = False) -> DataFrame:
    """(line_key): lines that more than ``min_docs`` different documents of a host have, however large the host is.

    ``base`` has doc_id, host_key, text_key and line_keys. Rows alike in id and text are one document. ``by_text`` counts
    different texts in their place, so that copies of a text count once for a host.
    """
    one = ["host_key", "text_key"] if by_text else ["host_key", "doc_id", "text_key"]
    docs = base.select(*one, F.array_distinct("line_keys").alias("keys")).dropDuplicates(one)
    counts = docs.select("host_key", F.explode("keys").alias("line_key")).groupBy("host_key", "line_key").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > min_docs).select("line_key")


def quality_rules(
    docs: DataFrame,
    min_words: int = 10,
    most_repeated: int = 20,
    min_docs: int = 10,
    least_left: float = 0.3,
    by_text: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """Every row with its counts and a verdict.

    base_failed: fewer than ``min_words`` words, or over ``most_repeated`` % of them in 5-word windows found twice.
    A normalised line is frequent if over ``min_docs`` different documents of its host have it: so are all lines of a text
    with more copies than that, and its copies are depleted, unless ``by_text`` makes copies count once for a host.
    Frequent lines go; a document is depleted if fewer than ``min_words`` words or less than ``least_left`` of its
    words are left. kept: neither. A null text has no words, so it fails; a null host is a host of its own; rows alike
    get the same verdict; an empty table gives an empty result.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_frequent_words (words in frequent
    lines), base_failed, kept. Texts are read once and never moved: only hashes of lines are counted.
    """
    scored, removed = _scored(docs, min_docs, by_text, id_col, text_col, host_col)
    scored = scored.join(removed, ["host_key", "text_key"], "left").withColumn("n_frequent_words", F.coalesce("gone", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated)
    left = F.col("n_words") - F.col("n_frequent_words")
    enough = (left >= min_words) & (left >= F.col("n_words") * F.lit(float(least_left)))
    metrics = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_frequent_words"]
    return scored.select("doc_id", *metrics, failed.alias("base_failed"), (~failed & enough).alias("kept"))


def _scored(docs: DataFrame, min_docs: int, by_text: bool, id_col: str, text_col: str, host_col: str) -> tuple[DataFrame, DataFrame]:
    """Base counts of every row, and (host_key, text_key, gone, keys): words in frequent lines, and those lines."""
    rows = base_rules(_keyed(docs, id_col, text_col, host_col))
    rows = rows.withColumn("clean", F.transform("lines", normalised))
    base = checkpoint(
        rows.select(
            "doc_id", "host_key", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            F.transform("clean", lambda x: F.xxhash64(F.col("host_key"), x)).alias("line_keys"),
            F.transform("clean", lambda x: F.size(F.split(x, " "))).alias("line_words"),
        )
    )
    frequent = checkpoint(frequent_lines(base, min_docs, by_text))
    if frequent.count() <= MOST_BROADCAST:
        frequent = F.broadcast(frequent)
    each = base.select("host_key", "text_key", F.posexplode("line_keys").alias("i", "line_key"), "line_words").select(
        "host_key", "text_key", "line_key", "i", F.get("line_words", F.col("i")).alias("w")
    )
    hits = each.join(frequent, "line_key").dropDuplicates(["host_key", "text_key", "i"])
    removed = hits.groupBy("host_key", "text_key").agg(F.sum("w").alias("gone"), F.collect_set("line_key").alias("keys"))
    return base.drop("line_keys", "line_words"), removed


def remove_frequent_lines(docs: DataFrame, min_docs: int = 10, by_text: bool = False, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``docs`` with its texts rid of frequent lines (see :func:`quality_rules`); all rows and columns stay."""
    _, removed = _scored(docs, min_docs, by_text, id_col, text_col, host_col)
    names = docs.columns
    flat = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    text, host = f"_c{names.index(text_col)}", f"_c{names.index(host_col)}"
    flat = flat.withColumn("host_key", F.xxhash64(host)).withColumn("text_key", F.xxhash64(F.coalesce(text, F.lit(""))))
    joined = flat.join(removed, ["host_key", "text_key"], "left")
    left = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("keys", F.xxhash64(F.col("host_key"), normalised(x))))
    cleaned = F.when(F.col("keys").isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    return joined.withColumn(text, cleaned).select(*flat.columns[: len(names)]).toDF(*names)

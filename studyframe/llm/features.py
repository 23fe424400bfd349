"""Text statistics as built-in Spark functions, shared by the two quality operators.

Words are runs of characters other than space and U+0009 to U+000D. Null text counts as empty; every statistic of an empty text is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

#: Statistics the models may use. Counts are given as shares of the text, so that a long text isn't judged by its length.
STATISTICS = ["n_words", "mean_word_chars", "symbol_share", "bar_share", "mark_share", "upper_share", "digit_share",
              "line_words", "dup_line_share", "distinct_share"]
#: Needs the word windows, which only the rule operator computes anyway.
REPEAT = "repeat_share"


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the plain counts. ``_words`` stays in the frame as the word array for what follows."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (df.withColumn("_words", F.array_remove(F.split(body, SPACE), ""))
            .withColumn("_lines", lines)
            .withColumn("n_words", F.size("_words").cast("long"))
            .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
            .withColumn("n_symbols", F.regexp_count(body, F.lit(SYMBOLS)).cast("long"))
            .withColumn("n_lines", F.size("_lines").cast("long"))
            .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
            .drop("_lines"))


def with_repeats(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: the words inside 5-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hash. Only texts with a repeated window sort their windows; the words covered are then the steps between
    successive repeated positions, each at most the window's length. Columns are built step by step because a column named inside a lambda must
    be a finished value: inlined, it would be computed again for every element.
    """
    words, count = F.col("_words"), F.size("_words")
    window = F.xxhash64
    hashes = F.when(count >= WINDOW, F.transform(F.sequence(F.lit(0), count - WINDOW),
                                                 lambda i: window(*[F.get(words, i + j) for j in range(WINDOW)])))
    keys, order, spots = F.col("_keys"), F.col("_order"), F.col("_spots")
    repeated = F.size(F.array_distinct(keys)) < F.size(keys)
    at = lambda i: F.get(order, i).getField("key")
    same = F.transform(F.sequence(F.lit(0), F.size(order) - 1), lambda i: F.when(
        at(i).eqNullSafe(at(i - 1)) | at(i).eqNullSafe(at(i + 1)), F.get(order, i).getField("pos")))
    covered = F.aggregate(F.sequence(F.lit(1), F.size(spots) - 1), F.lit(WINDOW),
                          lambda n, i: n + F.least(F.lit(WINDOW), F.get(spots, i) - F.get(spots, i - 1)))
    return (df.withColumn("_keys", F.coalesce(hashes, F.array().cast("array<bigint>")))
            .withColumn("_order", F.when(repeated, F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("pos"))))))
            .withColumn("_spots", F.when(F.size(order) > 0, F.sort_array(F.filter(same, lambda x: x.isNotNull()))))
            .withColumn("n_repeat_words", F.when(F.size(spots) > 1, covered).otherwise(F.lit(0)).cast("long"))
            .drop("_keys", "_order", "_spots"))


def with_statistics(df: DataFrame, text: str = "text", repeats: bool = False) -> DataFrame:
    """Adds the columns of STATISTICS (and REPEAT) to a frame that has the plain counts."""
    body = F.coalesce(F.col(text), F.lit(""))
    chars, n = F.col("word_chars"), F.col("n_words")
    count = lambda pattern: F.regexp_count(body, F.lit(pattern))
    out = (df.withColumn("mean_word_chars", _share(chars, n))
           .withColumn("symbol_share", _share(F.col("n_symbols"), chars))
           .withColumn("bar_share", _share(count(r"\|"), chars))
           .withColumn("mark_share", _share(count(r"[!?]"), chars))
           .withColumn("upper_share", _share(count(r"\p{Lu}"), chars))
           .withColumn("digit_share", _share(count(r"[0-9]"), chars))
           .withColumn("line_words", _share(n, F.col("n_lines")))
           .withColumn("dup_line_share", _share(F.col("n_dup_lines"), F.col("n_lines")))
           .withColumn("distinct_share", _share(F.size(F.array_distinct("_words")), n)))
    return out.withColumn(REPEAT, _share(F.col("n_repeat_words"), n)) if repeats else out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents (doc_id, text, label), the same ones in every run: those with the lowest hash of their id.

    Ids that are a multiple of five by ``id_remainder`` are left for measuring. The id list is bounded by ``rows``, so it is broadcast.
    """
    from studyframe.llm.work import id_remainder
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (id_remainder(F.col("doc_id"), 5) != 0))
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

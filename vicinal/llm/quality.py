"""Quality rules: base rules on each text, and lines that too many documents of a host share. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm.base import row_key, table, words, written

#: A line goes when more documents of its host have it than the first number and this share of the host's documents, or than
#: the last number. The share decides for hosts of 2,000 to 20,000 documents; below and beyond that a fixed count does.
MIN_DOCS, MIN_SHARE, MAX_DOCS = 10, 0.005, 100
#: A document that keeps less than this share of its words once its frequent lines are gone is depleted.
MIN_LEFT = 0.5
#: Limits of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def line_hash(line: Column) -> Column:
    """Hash of a normalised line: lower case, digits as 0, one space between words, none at the ends."""
    return F.xxhash64(F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\d", "0"), r"[\x20\x09-\x0D]+", " ")))


def host() -> Column:
    """The source as a host's name; a null source is a host that no string names."""
    return F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source"))).alias("host")


def measured(docs: DataFrame) -> DataFrame:
    """One row per row of docs: key, host, base metrics, a hash of the whole text, and its lines as (hash, words).

    Rows of equal text count as one document, so a passage isn't called boilerplate because its one document was copied often.
    """
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", *row_key(), host(), text.alias("text"))
    df = df.withColumn("w", words("text")).withColumn("raw", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_words", F.size("w").cast("long")).withColumn("word_chars", F.length(F.array_join("w", "")).cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long")).withColumn("n_dup_lines", (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long"))
    lines = F.transform("raw", lambda x: F.struct(line_hash(x).alias("line"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("words")))
    grams = F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_words") - 3, F.lit(0)).cast("int")), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.expr("array()").cast("array<bigint>"))
    df = df.withColumn("lines", lines).withColumn("grams", grams).withColumn("copy", F.xxhash64("text"))
    # windows in hash order; those with an equal neighbour are found twice or more
    df = df.withColumn("sorted", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn("at", F.array_sort(F.transform(F.filter("sorted", lambda x, k: F.coalesce(F.get("sorted", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("sorted", k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(F.transform("at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return df.select("doc_id", "k1", "k2", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "copy", "lines")


def frequent_lines(measured_docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, line): lines above the limits. Both counts are of documents with different texts.

    The first grouping is by host, line and text, so one line that all documents have is dealt out; the second gets one row
    for each key and task.
    """
    lines = F.array_distinct(F.transform("lines", lambda x: x["line"]))
    one = measured_docs.select("host", "copy", F.explode(lines).alias("line")).groupBy("host", "line", "copy").agg(F.lit(1).alias("one"))
    by_line = one.groupBy("host", "line").agg(F.sum("one").alias("n")).filter(F.col("n") > min_docs)
    by_host = measured_docs.groupBy("host", "copy").agg(F.lit(1).alias("one")).groupBy("host").agg(F.sum("one").alias("total"))
    return by_line.join(by_host, "host").filter((F.col("n") > min_share * F.col("total")) | (F.col("n") > max_docs)).select("host", "line")


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, min_left: float = MIN_LEFT, max_docs: int = MAX_DOCS) -> tuple[DataFrame, DataFrame]:
    """The verdicts, one row for each row of docs, and the frequent lines (host, line).

    A document is an id, a text and a host: the same id and text under two hosts is judged under each. Null text counts as empty
    (fails the base rules); null source is a host of its own; repeated rows get a row each; texts of any length are judged whole,
    an empty table gives no rows, and columns other than doc_id, text and source are ignored.
    """
    base = written(measured(docs), "quality")
    often = written(frequent_lines(base, min_docs, min_share, max_docs), "quality-lines")
    hit = base.select("k1", "k2", "host", F.posexplode("lines").alias("pos", "x")).select("k1", "k2", "host", "pos", F.col("x.line").alias("line"), F.col("x.words").alias("words")).distinct()
    lost = hit.join(often, ["host", "line"]).groupBy("k1", "k2", "host").agg(F.sum("words").alias("gone"), F.count("pos").alias("n_frequent_lines"), F.collect_set("line").alias("frequent"))
    out = base.join(lost, ["k1", "k2", "host"], "left").withColumns({"gone": F.coalesce("gone", F.lit(0)).cast("long"), "n_frequent_lines": F.coalesce("n_frequent_lines", F.lit(0)).cast("long"), "frequent": F.coalesce("frequent", F.expr("array()").cast("array<bigint>"))})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("n_words") - F.col("gone") >= min_left * F.col("n_words")) & (F.col("n_words") > F.col("gone")))
    return out.select("doc_id", "k1", "k2", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("gone").alias("n_frequent_words"), "n_frequent_lines", "frequent"), often


def clean(docs: DataFrame) -> DataFrame:
    """docs without the rejected rows, and without the frequent lines of the others; columns as they are, n_chars anew.

    One join by document key brings the verdict to the text; the text is shuffled once.
    """
    verdicts, _ = judge(docs)
    said = verdicts.filter("kept").select("k1", "k2", "host", "frequent").dropDuplicates(["k1", "k2", "host"])
    row = docs.select(F.struct(*docs.columns).alias("row"), *row_key(), host())
    out = row.join(said, ["k1", "k2", "host"])
    gone = lambda x: x.rlike(r"[^\x20\x09-\x0D]") & F.array_contains("frequent", line_hash(x))
    text = F.when(F.size("frequent") > 0, F.array_join(F.filter(F.split("row.text", "\n", -1), lambda x: ~gone(x)), "\n")).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))[0].drop("k1", "k2", "host", "frequent")

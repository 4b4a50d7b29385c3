"""Quality rules whose cutoffs adapt to each language and source.

Every document gets four integer measures. A sketch of each measure counts the documents in each bucket of a fixed
grid, for each language and source; such sketches merge by adding counts, are exact for these measures, and have a
bounded number of rows. A quantile is exact on the grid, so it is off by less than one bucket: 0.001 of a share, 0.1
letter of a mean word length; shares of 1 and more, and mean lengths of 100 and more, are one bucket. Quantiles set the cutoffs; groups with few documents borrow those of their
language, or of everything. The cutoffs are joined to the documents. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, let
from .skew import counted, spread_join

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
#: Groups of fewer documents borrow the cutoffs of a larger group.
LEAST_GROUP = 100
#: A cutoff lies this many spreads (upper quartile minus median) beyond the upper quartile.
SPREADS = 5
#: Up to so many rows of cutoffs are broadcast; beyond, they are joined by a shuffle that splits large groups.
MOST_BROADCAST = 20_000
#: measure -> (buckets of its grid, least spread). All are per thousand, but for word length, in tenths.
MEASURES = {"symbols": (1000, 18), "word_length": (1000, 8), "dup_lines": (1000, 60), "repeats": (1000, 25)}


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def repeated_words(ws: Column) -> Column:
    """How many of the words lie in a 5-word window that the text holds twice or more; ws is a bound lambda variable."""

    def count(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(at: Column) -> Column:
            reach = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
            return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

        def starts(s: Column) -> Column:
            same = lambda e, other: F.coalesce(other["h"] == e["h"], F.lit(False))
            marked = F.transform(s, lambda e, k: F.when(same(e, F.get(s, k - 1)) | same(e, F.get(s, k + 1)), e["i"]))
            return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(let(ordered, starts), covered))

    windows = F.transform(F.sequence(F.lit(1), F.size(ws) - WINDOW + 1), lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))
    return F.when(F.size(ws) < WINDOW, F.lit(0)).otherwise(let(windows, count))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column `_m`: counts, base verdict, and the measures. A null text has no words and fails."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(ws: Column) -> Column:
        return F.struct(F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"), repeated_words(ws).cast("long").alias("n_repeat_words"))

    def of_lines(ls: Column) -> Column:
        return F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))

    symbols = F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long")

    def struct(parts: Column) -> Column:
        w, n, s = parts["w"], parts["n"], parts["s"]
        per = lambda a, b, unit: F.least(F.floor(a * unit / F.greatest(b, F.lit(1))), F.lit(1000)).cast("int")
        failed = (w["n_words"] < LEAST_WORDS) | (100 * w["n_repeat_words"] > MOST_REPEATED_PERCENT * w["n_words"])
        return F.struct(
            w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), s.alias("n_symbols"), n["n_dup_lines"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"),
            per(s, w["word_chars"], 1000).alias("symbols"), per(w["word_chars"], w["n_words"], 10).alias("word_length"), per(n["n_dup_lines"], n["n_lines"], 1000).alias("dup_lines"), per(w["n_repeat_words"], w["n_words"], 1000).alias("repeats"),
        )

    parts = F.struct(let(words(whole), of_words).alias("w"), let(lines, of_lines).alias("n"), symbols.alias("s"))
    return docs.withColumn("_m", let(parts, struct))


def sketches(table: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, measure, bucket, n): the documents of each bucket; base failures don't count."""
    pairs = F.explode(F.map_from_arrays(F.array(*map(F.lit, MEASURES)), F.array(*(F.col(f"_m.{k}") for k in MEASURES)))).alias("measure", "bucket")
    # A filter before the aggregation would be pushed below the measures and evaluate them twice.
    some = table.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.col("_m.base_failed").alias("failed"), pairs)
    return some.groupBy("lang", "source", "measure", "bucket").agg(F.count(F.when(~F.col("failed"), 1)).alias("n")).where("n > 0")


def quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """The quartiles and the number of documents of each measure in the sketches merged by keys."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    upto = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranked = merged.select(*keys, "measure", "bucket", upto.alias("upto"), F.sum("n").over(group).alias("docs"))
    at = lambda percent: F.min(F.when(F.col("upto") * 100 >= F.col("docs") * percent, F.col("bucket")))
    return ranked.groupBy(*keys, "measure").agg(at(25).alias("low"), at(50).alias("mid"), at(75).alias("high"), F.max("docs").alias("docs"))


def cutoffs(sketch: DataFrame) -> DataFrame:
    """One row for each language and source: `least` and `most` as structs of the measures."""
    by_pair, by_lang, overall = quantiles(sketch, "lang", "source"), quantiles(sketch, "lang"), quantiles(sketch)
    named = lambda df, tag: df.select(*[c for c in df.columns if c in ("lang", "source", "measure")], F.struct("low", "mid", "high", "docs").alias(tag))
    pair, one, all_ = named(by_pair, "q2"), named(by_lang, "q1").withColumnRenamed("lang", "lang1").withColumnRenamed("measure", "measure1"), named(overall, "q0")
    both = pair.join(one, F.col("lang").eqNullSafe(F.col("lang1")) & (F.col("measure") == F.col("measure1"))).join(all_, "measure")
    q = F.when(F.col("q2.docs") >= LEAST_GROUP, F.col("q2")).when(F.col("q1.docs") >= LEAST_GROUP, F.col("q1")).otherwise(F.col("q0"))
    spread = F.lit(0)
    for k, (_, least) in MEASURES.items():
        spread = F.when(F.col("measure") == k, F.greatest(F.col("q.high") - F.col("q.mid"), F.col("q.mid") - F.col("q.low"), F.lit(least))).otherwise(spread)
    table = both.select("lang", "source", "measure", q.alias("q")).withColumn("spread", spread)
    only = lambda k, c: F.max(F.when(F.col("measure") == k, c))
    return table.groupBy("lang", "source").agg(
        F.struct(*(only(k, F.col("q.low") - SPREADS * F.col("spread")).alias(k) for k in MEASURES)).alias("_least"),
        F.struct(*(only(k, F.col("q.high") + SPREADS * F.col("spread")).alias(k) for k in MEASURES)).alias("_most"),
    )


def judged(table: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """table with `_kept`; only word length has a lower cutoff."""
    group = lambda a, b: F.to_json(F.struct(a.alias("a"), b.alias("b")))
    limits = cut(limits.select(group(F.col("lang"), F.col("source")).alias("_group"), "_least", "_most"))
    grouped = table.withColumn("_group", group(F.col(lang), F.col(source)))
    if limits.count() <= MOST_BROADCAST:
        joined = grouped.join(F.broadcast(limits), "_group", "left")
    else:
        joined = spread_join(grouped, limits, ["_group"], how="left", sizes=cut(counted(grouped.select("_group"), ["_group"])))
    inside = F.col("_m.word_length") >= F.col("_least.word_length")
    for k in MEASURES:
        inside &= F.col(f"_m.{k}") <= F.col(f"_most.{k}")
    return joined.withColumn("_kept", F.when(F.col("_m.base_failed"), F.lit(False)).otherwise(F.coalesce(inside, F.lit(True)))).drop("_group", "_least", "_most")


def rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row for each row of docs: counts, base_failed and kept.

    Null and empty texts have no words and so fail. Null languages and sources form groups of their own. Repeated rows
    are separate documents; an empty table gives an empty result; other columns aren't read.
    """
    table = cut(measured(docs, text).select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), "_m"))
    out = judged(table, cutoffs(sketches(table)))
    return out.select("doc_id", *(f"_m.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")), F.col("_kept").alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns.

    The measures are found twice, for the cutoffs and for the rows, so no text is written in between and nothing has to
    be removed later. Repeated rows are separate documents; an empty table gives an empty result.
    """
    table = measured(docs, text)
    limits = cutoffs(cut(sketches(table.select(lang, source, "_m"), lang, source)))
    return judged(table, limits, lang, source).where("_kept").select(*(F.col(c) for c in docs.columns))

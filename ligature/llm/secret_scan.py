"""Secret scans: three base patterns, and character Markov models that tell random strings from ordinary words.

The base patterns label their own samples: the values they match are random strings, the words of documents without
any match are ordinary identifiers. Two first-order models over one alphabet are counted from three quarters of these
samples. The last quarter, held out, sets the cut: the least mean log-likelihood ratio a step that no more than one in
MOST_FALSE long ordinary words reaches. A token is reported from the cut on, whatever symbols it is made of. DataFrame
functions only: positions come from the lengths of matches and of the gaps between them, and the models are one array.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs below the required length never pass, and no part of such a run does, so the length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST_VALUE = 12

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
#: Tokens that the models judge.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
WORD = r"[A-Za-z0-9+/_.=-]{4,}"
#: One in so many held-out ordinary words may reach the cut, which is never below LEAST_RATIO (nats a step).
MOST_FALSE = 2000
LEAST_RATIO = 0.7
#: Held-out words of at least so many symbols set the cut; shorter ones spread more than the tokens that are judged.
LONG_WORD = 10
#: The cut is found on a grid of this width.
GRID = 0.05
SMOOTHING = 1.0

SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def matches(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """The spans of the leftmost non-overlapping matches as (start, kind, end, value of the group)."""
    spans = F.zip_with(
        F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("n"))),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
        lambda p, v: F.struct(p["gap"].alias("gap"), p["n"].alias("n"), v.alias("value")),
    )
    found = F.filter(spans, lambda s: s["n"].isNotNull())
    none = F.from_json(F.lit("[]"), SPAN)
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(a: Column, s: Column) -> Column:
        begin = a["at"] + s["gap"]
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + s["n"]).alias("end"), s["value"].alias("value"))
        return F.struct((begin + s["n"]).alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(found, start, step, lambda a: a["out"])).otherwise(none)


def base_spans(text: Column) -> Column:
    assign = F.filter(matches(text, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= LEAST_VALUE)
    return F.sort_array(F.concat(assign, matches(text, ACCESS, 1), matches(text, HEX, 2)))


def tokens(text: Column, base: Column) -> Column:
    """Tokens that no base span touches."""
    free = lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    return F.filter(matches(text, TOKEN, 3), free)


def steps(strings: DataFrame) -> DataFrame:
    """(pair, n): how often each pair of neighbouring symbols occurs in the column `s`, counted n times each."""
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring(F.col("s"), i, F.lit(2)))).alias("pair")
    return strings.where(F.length("s") > 1).select(pair, "n").groupBy("pair").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios, random against ordinary, of the steps between two symbols; and the cut for their mean."""

    ratios: list[float]
    cut: float


def samples(docs: DataFrame, text: str = "text") -> DataFrame:
    """(random, s, n, held): labelled strings and how often they count; a hash of the string holds out a quarter."""
    whole = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    any_base = F.col("t").rlike(ASSIGN) | F.col("t").rlike(ACCESS) | F.col("t").rlike(HEX)
    values = whole.where(any_base).select(F.explode(base_spans(F.col("t"))["value"]).alias("s")).groupBy("s").agg(F.lit(1).cast("long").alias("n"))
    # Copies of a text count once, so that no group of copies outweighs the others.
    some = whole.where(~any_base).dropDuplicates(["t"])
    words = some.select(F.explode(F.regexp_extract_all("t", F.lit(WORD), F.lit(0))).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    both = values.select(F.lit(True).alias("random"), "s", "n").unionByName(words.select(F.lit(False).alias("random"), "s", "n"))
    return both.withColumn("held", F.pmod(F.xxhash64("s"), F.lit(4)) == 3)


def fit(docs: DataFrame, text: str = "text") -> Model:
    """The models and their cut.

    Random values and ordinary words come from all documents. At most one number for each pair of symbols, and one for
    each step of the grid, reaches the driver.
    """
    rows = cut(samples(docs, text))
    train = rows.where("not held")
    both = steps(train.where("random")).withColumn("random", F.lit(True)).unionByName(steps(train.where("not random")).withColumn("random", F.lit(False)))
    counts = {(r["random"], r["pair"]): float(r["n"]) for r in both.collect()}
    size = len(ALPHABET)
    from_ = {(kind, a): sum(counts.get((kind, a + b), 0.0) for b in ALPHABET) for kind in (True, False) for a in ALPHABET}

    def log(kind: bool, a: str, b: str) -> float:
        return math.log((counts.get((kind, a + b), 0.0) + SMOOTHING) / (from_[kind, a] + SMOOTHING * size))

    ratios = [log(True, a, b) - log(False, a, b) for a in ALPHABET for b in ALPHABET]
    held = rows.where(F.col("held") & ~F.col("random") & (F.length("s") >= LONG_WORD))
    step = F.floor(ratio(F.col("s"), ratios) / GRID).cast("int").alias("step")
    # A word counts once: how often it is used says nothing about others like it.
    return Model(ratios, chosen_cut({r["step"]: r["n"] for r in held.select(step).groupBy("step").agg(F.count("*").alias("n")).collect()}))


def chosen_cut(held: dict[int, int]) -> float:
    """The least grid value from LEAST_RATIO on that at most one in MOST_FALSE of the held-out words reaches."""
    total, above = sum(held.values()), 0
    for step in sorted(held, reverse=True):
        above += held[step]
        if above * MOST_FALSE > total and above > 1:
            return max(LEAST_RATIO, (step + 1) * GRID)
    return LEAST_RATIO


def ratio(value: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of the steps of value."""
    table = F.split(F.lit(" ".join(f"{x:.6f}" for x in ratios)), " ").cast("array<double>")
    places = F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.instr(F.lit(ALPHABET), F.substring(value, i, F.lit(1))) - 1)

    def mean(p: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.get(table, F.get(p, i - 1) * len(ALPHABET) + F.get(p, i)))
        return F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / (F.size(p) - 1)

    return let(places, mean)


def spans(text: Column, model: Model) -> Column:
    """struct(base, all): the base spans and all spans, each by start, then kind."""

    def both(base: Column) -> Column:
        more = F.filter(tokens(text, base), lambda t: ratio(t["value"], model.ratios) >= model.cut)
        return F.struct(base.alias("base"), F.sort_array(F.concat(base, more)).alias("all"))

    return let(base_spans(text), both)


def written(found: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs with the numbers of base spans, their digest, and all spans as text.

    Positions count code points, ends are exclusive. Null and empty texts have no spans. Repeated rows are scanned
    separately; an empty table gives an empty result; other columns aren't read.
    """
    model = fit(docs, text)
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    table = whole.select("doc_id", spans(F.col("t"), model).alias("s"))
    count = lambda k: F.size(F.filter("s.base", lambda x: x["kind"] == k)).cast("long")
    return table.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(F.col("s.base")).cast("binary"), 256).alias("base_sha256"), written(F.col("s.all")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with mark in place of every span; spans that overlap are replaced together. Null texts stay null."""
    model = fit(docs, text)
    t = F.col(text)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        put = F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)).alias("out"))
        return F.when(s["start"] >= a["at"], put).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))

    def masked(found: Column) -> Column:
        whole = F.aggregate(found, start, step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
        return F.when(F.size(found) == 0, t).otherwise(whole)

    clean = F.when(t.isNotNull(), let(spans(t, model)["all"], masked))
    return docs.select(*(clean.alias(c) if c == text else F.col(c) for c in docs.columns))

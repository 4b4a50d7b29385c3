"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. The probability of a text is the sum over
all its segmentations into pieces, found by a forward algorithm. No piece spans a word boundary, so the sum factors
into words, and a word met before is looked up. The probabilities are fitted by expectation maximisation on word
counts of a bounded sample of the labelled documents: executors run forward and backward over their words, and only
expected counts of pieces, bounded by the vocabulary and the number of languages, reach the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .pieces import default_path
from .segments import expected, log_words, table

#: The fit reads about this many different labelled texts of each language, chosen by their hash.
SAMPLE_DOCUMENTS = 400
ROUNDS = 3
#: This part of every language's probability is shared out evenly over all pieces, so unseen pieces favour none.
FLOOR = 0.01
UNDETERMINED = "und"
#: The first words that a worker meets are remembered, up to this number.
MEMO_WORDS = 150_000
#: Likelihoods are tempered to those of this many words for the score.
SCORE_WORDS = 10.0
RUN = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """The runs of letters (Unicode category L) of text; other numeric signs, such as fractions, aren't letters."""
    runs = RUN.findall(text)
    if all(map(str.isalpha, runs)):
        return runs
    return ["".join(g) for w in runs for k, g in groupby(w, str.isalpha) if k]


def words_of(text: str | None) -> Counter:
    """Runs of letters in lower case, whole however long."""
    return Counter(letter_runs(text.lower())) if text else Counter()


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


class Model:
    """Sorted languages and their piece probabilities, piece x language, 0 for no piece."""

    def __init__(self, languages: list[str], p: np.ndarray) -> None:
        self.languages, self.p = languages, p


def fit(labelled: DataFrame, path: str | None = None, rounds: int = ROUNDS, sample: int = SAMPLE_DOCUMENTS, text: str = "text", lang: str = "lang") -> Model:
    """Piece probabilities of each language of labelled; rows without text or language don't count."""
    path = path or default_path()
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    # Copies of a text count once, so that no group of copies fills the sample.
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Model([], np.zeros((0, 0)))
    share = F.lit(0)
    for k in languages:
        share = F.when(F.col("lang") == k, F.lit(min(1_000_000, 1_000_000 * sample // totals[k]))).otherwise(share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w, n in words_of(t).items():
                    found[k, w] += n
            yield pa.record_batch([pa.array([k for k, _ in found], pa.string()), pa.array([w for _, w in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share).dropDuplicates(["lang", "text"])
    counts = cut(some.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    size, none, lone = table(path).size, table(path).none, table(path).mark
    p = np.full((size, len(languages)), 1.0 / size)
    p[none] = 0.0
    for _ in range(rounds):
        shared = labelled.sparkSession.sparkContext.broadcast((languages, p))

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, old = shared.value
            total = np.zeros_like(old)
            for batch in batches:
                frame = batch.to_pandas()
                for k, part in frame.groupby("lang"):
                    j = names.index(k)
                    total[:, j] += expected(table(path), part["word"].tolist(), part["n"].to_numpy(np.float64), np.ascontiguousarray(old[:, j]))
            piece, j = np.nonzero(total)
            yield pa.record_batch([pa.array(j.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[piece, j])], ["lang", "piece", "n"])

        sums = counts.mapInArrow(expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow().to_pandas()
        p = np.zeros((size, len(languages)))
        p[sums["piece"].to_numpy(), sums["lang"].to_numpy()] = sums["n"].to_numpy()
        # The mark of a word's start alone is equally likely in all languages: it says nothing about letters.
        mark = float(np.mean(p[lone] / np.maximum(p.sum(axis=0), 1e-300)))
        p[lone] = 0.0
        p = (1 - FLOOR - mark) * p / np.maximum(p.sum(axis=0), 1e-300) + FLOOR / (size - 2)
        p[lone], p[none] = max(mark, FLOOR / size), 0.0
    return Model(languages, p)


class Scorer:
    """Log probabilities of words under a model; the first words met are remembered."""

    def __init__(self, model: Model, path: str) -> None:
        self.model, self.path, self.row = model, path, {}
        self.known = np.zeros((0, len(model.languages)))

    def texts(self, counts: list[Counter]) -> np.ndarray:
        """[text, language]: log probabilities."""
        new = list({w for c in counts for w in c}.difference(self.row))
        scored = log_words(table(self.path), new, self.model.p) if new else np.zeros((0, self.known.shape[1]))
        scores, at = np.concatenate([self.known, scored]), {w: len(self.known) + i for i, w in enumerate(new)}
        out = np.zeros((len(counts), scores.shape[1]))
        for i, c in enumerate(counts):
            if c:
                rows = [at[w] if w in at else self.row[w] for w in c]
                out[i] = np.fromiter(c.values(), np.float64, len(c)) @ scores[rows]
        if room := MEMO_WORDS - len(self.known):
            self.known = scores[: len(self.known) + room]
            self.row |= {w: r for w, r in at.items() if r < len(self.known)}
        return out


_SCORERS: dict[int, Scorer] = {}


def predict(docs: DataFrame, model: Model, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the posterior for equal priors, of tempered likelihoods)."""
    path = path or default_path()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = id(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(fitted, path)
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                counts = [words_of(t) for t in batch.column(1).to_pylist()]
                names, scores = [UNDETERMINED] * len(counts), [0.0] * len(counts)
                if fitted.languages:
                    logs = _SCORERS[key].texts(counts)
                    for i, c in enumerate(counts):
                        if c:
                            row = (logs[i] - logs[i].max()) * min(1.0, SCORE_WORDS / sum(c.values()))
                            best = int(row.argmax())
                            names[i], scores[i] = fitted.languages[best], float(1.0 / np.exp(row).sum())
                yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score.

    Only documents that aren't held out and have a language are learned from. A text that is null or has no letters
    is `und` with score 0, and so is everything if nothing is labelled. Ties go to the first language by name.
    Repeated rows are judged separately; other columns aren't read.
    """
    model = fit(docs.where(~held_out(F.col(doc_id))), path, text=text, lang=lang)
    return predict(docs, model, path, doc_id, text).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

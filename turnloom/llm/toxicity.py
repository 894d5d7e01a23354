"""Toxicity by weak supervision.

1. Lexicon mining: words and word beginnings (4, 5 and 6 bytes) that labelled toxic documents have far more often than
   labelled clean ones. Counts run over all labelled training rows, and every value is tested: an entry is in at least
   `least_documents` toxic documents, more often than chance would bring about one value to be, and is toxic in at least
   the share `least_precision` of its documents (lower end of a 95 % interval). There is no limit on their number.
2. Voters: lexicons of each kind of entry (words and the three beginnings), a kind's entries dealt into several of
   different entries and about equal strength; patterns of punctuation and repetition; and the given labels. A voter
   fires or not.
3. Generative label model: EM over the voters' votes with one rate of firing for each class and voter, in which a
   voter's evidence is divided by one plus the correlations with the others that the classes leave unexplained.
4. A linear classifier over the mined entries and patterns, fitted to the label model's posterior.

Training rows are those labels whose crc32 of doc_id mod 4 is not 2. Steps 3 and 4 fit on at most FIT_ROWS of them, taken
by a hash of doc_id and text, rows that agree in both once; everything else covers all rows. Entries stay in a table, and
the model has only those that the rows of the fit have (others would weigh nothing). Scores use the text alone.

Defined results: null and empty texts have no entries and get the score of a text without any; null labels, null ids and
labels without a document teach nothing; repeated rows are scored each; without any toxic or any clean training row
every score is the training rows' share of toxic ones (0 without rows); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.rows import packed_row
from turnloom.llm.tokens_np import ALNUM, _powers, mixed, pieces
from turnloom.llm.tokens_np import _BYTE_VALUE as BYTE_VALUE
from turnloom.session import written

FIT_ROWS = 60_000
#: Labelled rows that tasks get as a table (16 bytes each), and mined entries that they get as an array (8 bytes each);
#: more are joined by a shuffle, with the same results.
MOST_SENT = 1_000_000
#: Of the documents with an entry at least so many are toxic, at the lower end of a 95 % interval.
LEAST_PRECISION = 0.5
#: Fewer toxic documents never pass that test.
LEAST_DOCUMENTS = 3
THRESHOLD = 0.3
_BEGINNINGS = (4, 5, 6)
#: Each kind of entry has so many lexicons, of different entries.
_LEXICONS = 6
LEXICON_VOTERS = (1 + len(_BEGINNINGS)) * _LEXICONS
_PATTERNS = ("!!", "???", "***", "###")
_FILTER_BITS = 20


def held_out(doc_id: Column) -> Column:
    """Whether a document's label may not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row of the batch, value and kind of every word and word beginning, with repeats, piece by piece."""
    for piece in pieces(column, ALNUM, lower=True):
        if not len(piece.starts):
            continue
        rows = piece.rows[0] + piece.owner()
        up, down = _powers(len(piece.data) + 1)
        prefix = np.zeros(len(piece.data) + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUE[piece.data] * up[: len(piece.data)], out=prefix[1:])
        size, all_rows, values = piece.ends - piece.starts, [rows], [piece.hashes()]
        for n in _BEGINNINGS:
            long = size > n
            at = piece.starts[long]
            all_rows.append(rows[long])
            values.append(mixed((prefix[at + n] - prefix[at]) * down[at] + np.uint64(1 << 40 | n)))
        kinds = np.repeat(np.arange(len(values), dtype=np.int8), list(map(len, values)))
        yield np.concatenate(all_rows), np.concatenate(values), kinds


class Index:
    """Positions of values in a sorted array, with a bit table before the search."""

    def __init__(self, values: np.ndarray):
        self.values = np.sort(values.astype(np.uint64))
        self.table = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.table[self.values >> np.uint64(64 - _FILTER_BITS)] = True

    def find(self, rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, position) of the values that the array has."""
        if not len(self.values):
            return rows[:0], rows[:0]
        some = np.flatnonzero(self.table[values >> np.uint64(64 - _FILTER_BITS)])
        at = np.minimum(np.searchsorted(self.values, values[some]), len(self.values) - 1)
        good = self.values[at] == values[some]
        both = np.unique(rows[some][good] * np.int64(len(self.values)) + at[good])
        return both // len(self.values), both % len(self.values)


def _patterns(texts: list[str | None]) -> np.ndarray:
    """Which patterns each text has: runs of marks, and mostly capital letters."""
    out = np.zeros((len(texts), len(_PATTERNS) + 1), dtype=bool)
    for i, text in enumerate(texts):
        if text:
            out[i, :-1] = [p in text for p in _PATTERNS]
            out[i, -1] = text.isupper()
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and clean documents of a piece each value is."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy() == 1
        for rows, values, kinds in _features(batch.column("text")):
            order = np.lexsort((rows, values))
            r, v, k = rows[order], values[order], kinds[order]
            new = np.ones(len(r), dtype=bool)
            new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
            r, v, k = r[new], v[new], k[new]
            first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            c1 = np.add.reduceat(toxic[r].astype(np.int64), first)
            n = np.diff(np.append(first, len(v)))
            yield pa.RecordBatch.from_arrays([pa.array(v[first].astype(np.int64)), pa.array(k[first]), pa.array(c1), pa.array(n - c1)], ["value", "kind", "c1", "c0"])


def _entries(values: np.ndarray | None):
    """Rows with the values among these that their text has (all of its values if None), and its patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None if values is None else Index(values)
        for batch in batches:
            rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for r, v, _ in _features(batch.column("text")):
                if index is not None:
                    r, at = index.find(r, v)
                    v = index.values[at]
                rows.append(r)
                found.append(v)
            row, value = np.concatenate(rows), np.concatenate(found)
            order = np.lexsort((value, row))
            row, value = row[order], value[order]
            new = np.ones(len(row), dtype=bool)
            new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
            offsets = np.searchsorted(row[new], np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, value[new].view(np.int64))
            marks = pa.array(_patterns(batch.column("text").to_pylist()).tolist(), pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("toxic"), lists, marks], ["key", "toxic", "entries", "patterns"])

    return run


def _sampled(sampled: DataFrame, good: DataFrame) -> pa.Table:
    """Of the sampled rows (key, text, toxic), those of one key once: toxic, the good entries that the text has, its patterns."""
    shape = "key long, toxic int, entries array<long>, patterns array<boolean>"
    if good.count() <= MOST_SENT:
        rows = sampled.mapInArrow(_entries(good.select("value").toArrow().column("value").to_numpy().view(np.uint64)), shape)
        rows = rows.groupBy("key").agg(*[F.first(c).alias(c) for c in ("toxic", "entries", "patterns")])
    else:
        rows = written(sampled.mapInArrow(_entries(None), shape).groupBy("key").agg(*[F.first(c).alias(c) for c in ("toxic", "entries", "patterns")]), "toxic-sample")
        met = rows.select("key", F.explode("entries").alias("value")).join(good.select("value"), "value", "left_semi")
        met = met.groupBy(F.col("key").alias("of")).agg(F.sort_array(F.collect_list("value")).alias("found"))
        none = F.array().cast("array<bigint>")
        rows = rows.join(met, F.col("key") == F.col("of"), "left").select("key", "toxic", F.coalesce("found", none).alias("entries"), "patterns")
    return rows.toArrow().sort_by("key")


def _strengths(good: DataFrame, values: np.ndarray):
    """value, kind and strength of these entries, by ascending unsigned value."""
    if good.count() > MOST_SENT:
        wanted = good.sparkSession.createDataFrame(pa.table({"of": values.view(np.int64)}))
        good = good.join(wanted, F.col("value") == F.col("of"), "left_semi")
    rows = good.toArrow().to_pandas()  # three numbers for each entry
    rows = rows[np.isin(rows["value"].to_numpy().view(np.uint64), values)]
    return rows.iloc[np.argsort(rows["value"].to_numpy().view(np.uint64))].reset_index(drop=True)


# -- models ----------------------------------------------------------------------------------------------------------


def likelihood_ratio(c1: np.ndarray, c0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Signed root of the likelihood ratio statistic of counts in n1 and n0 documents; positive if c1 has the greater share."""
    part = lambda k, n, p: k * np.log(np.maximum(p, 1e-300)) + (n - k) * np.log(np.maximum(1 - p, 1e-300))
    p1, p0, p = c1 / n1, c0 / n0, (c1 + c0) / (n1 + n0)
    twice = 2 * (part(c1, n1, p1) + part(c0, n0, p0) - part(c1, n1, p) - part(c0, n0, p))
    return np.sign(p1 - p0) * np.sqrt(np.maximum(twice, 0))


def surely(hits: np.ndarray, n: np.ndarray, z: float = 1.96) -> np.ndarray:
    """The lower end of Wilson's interval for the share hits / n."""
    n = np.maximum(n, 1e-9)
    share = hits / n
    return (share + z * z / (2 * n) - z * np.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _likelihood_ratio(n1: int, n0: int) -> Column:
    """likelihood_ratio() of columns c1 and c0."""

    def part(k: Column, n: int, p: Column) -> Column:
        return k * F.log(F.greatest(p, F.lit(1e-300))) + (F.lit(float(n)) - k) * F.log(F.greatest(1 - p, F.lit(1e-300)))

    c1, c0 = F.col("c1").cast("double"), F.col("c0").cast("double")
    p1, p0, p = c1 / n1, c0 / n0, (c1 + c0) / (n1 + n0)
    twice = 2 * (part(c1, n1, p1) + part(c0, n0, p0) - part(c1, n1, p) - part(c0, n0, p))
    return F.signum(p1 - p0) * F.sqrt(F.greatest(twice, F.lit(0.0)))


def _surely(z: float = 1.96) -> Column:
    """surely() of c1 among c1 + c0."""
    n = (F.col("c1") + F.col("c0")).cast("double")
    share = F.col("c1") / n
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def label_model(votes: np.ndarray, prior: float, rounds: int = 25) -> np.ndarray:
    """Posterior of the positive class for rows of 0/1 votes; the given labels are one voter, the last, of unknown accuracy.

    The classes start from the lexicon's votes and the given labels. Rates of firing by class and the posterior are then
    found in turn; correlations between voters within the classes shrink their evidence.
    """
    votes = votes.astype(np.float64)
    lexicon = votes[:, :LEXICON_VOTERS].sum(axis=1)
    posterior = np.clip(0.02 + 0.3 * np.minimum(lexicon, 2) + 0.36 * votes[:, -1], 0, 1)
    for _ in range(rounds):
        rates = []
        for p in (posterior, 1 - posterior):
            rates.append((votes.T @ p + 0.5) / (p.sum() + 1.0))
        expected = posterior[:, None] * rates[0] + (1 - posterior)[:, None] * rates[1]
        rest = votes - expected
        spread = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        links = np.abs(rest.T @ rest / len(rest) / np.outer(spread, spread))
        np.fill_diagonal(links, 0)
        weight = 1 / (1 + np.where(links > 0.1, links, 0).sum(axis=1))
        share = min(max(posterior.mean(), prior / 2, 1e-4), max(2 * prior, 1e-3), 0.9)
        fired, silent = np.log(rates[0] / rates[1]), np.log((1 - rates[0]) / (1 - rates[1]))
        odds = np.log(share / (1 - share)) + votes @ (weight * fired) + (1 - votes) @ (weight * silent)
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return posterior


def linear_classifier(rows: np.ndarray, at: np.ndarray, goal: np.ndarray, size: int, rounds: int = 300, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression on 0/1 features with soft goals, the last one the intercept (Adam, full batches)."""
    weights, m, v = (np.zeros(size + 1) for _ in range(3))
    share = min(max(goal.mean(), 1e-3), 0.999)
    weights[-1] = np.log(share / (1 - share))
    for step in range(1, rounds + 1):
        score = np.bincount(rows, weights[at], minlength=len(goal)) + weights[-1]
        error = 1 / (1 + np.exp(-score)) - goal
        slope = np.append(np.bincount(at, error[rows], minlength=size), error.sum()) / len(goal)
        slope[:-1] += decay * weights[:-1]
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        weights -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return weights


@dataclass
class Model:
    """Entries (sorted values), and weights of entries, patterns and intercept."""

    values: np.ndarray
    weights: np.ndarray


def _constant(share: float) -> Model:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Model(np.zeros(0, np.uint64), np.append(np.zeros(len(_PATTERNS) + 1), np.log(share / (1 - share))))


def _taught(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and toxic of all training rows."""
    lessons = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    lessons = lessons.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = lessons.count() <= MOST_SENT
    return documents.select("doc_id", "text").join(F.broadcast(lessons) if few else lessons, "doc_id").select("doc_id", "text", "toxic")


def fit(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, least_precision: float = LEAST_PRECISION, least_documents: int = LEAST_DOCUMENTS) -> Model:
    """Mines entries, fits the label model and the classifier."""
    taught = _taught(documents, labels)
    totals = {r[0]: r[1] for r in taught.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return _constant(n1 / max(1, n1 + n0))
    counts = taught.select("text", "toxic").mapInArrow(_counts, "value long, kind tinyint, c1 long, c0 long")
    counted = counts.groupBy("value", "kind").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0")).where(F.col("c1") >= least_documents)
    counted = written(counted, "toxic-counts")
    # Chance alone would let about one entry pass the first test. The second asks that the entry, wherever it stands, speaks
    # for toxicity: long clean texts have many entries that are only commoner in toxic ones.
    least = float(np.sqrt(2 * np.log(max(2, counted.count()))))
    good = counted.withColumn("strength", _likelihood_ratio(n1, n0)).where((F.col("strength") > least) & (_surely() >= least_precision))
    good = written(good.groupBy("value").agg(F.min(F.struct("kind", "strength")).alias("of")).select("value", "of.kind", "of.strength"), "toxic-entries")
    share = min(1.0, fit_rows / (n1 + n0))
    key = F.xxhash64("doc_id", "text")
    sampled = taught.where(F.pmod(key, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(key.alias("key"), "text", "toxic")
    sample = _sampled(sampled, good).slice(0, fit_rows)
    column = sample.column("entries").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    of, found = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())), column.flatten().to_numpy().view(np.uint64)
    # An entry that no row of the sample has would get the weight 0, so the model grows with the sample alone.
    passed = _strengths(good, np.unique(found))
    values = passed["value"].to_numpy().view(np.uint64)
    size = len(values) + len(_PATTERNS) + 1
    rank = passed.sort_values(["strength", "value"], ascending=[False, True]).groupby("kind").cumcount().reindex(passed.index)
    lexicon = passed["kind"].to_numpy().astype(np.int64) * _LEXICONS + rank.to_numpy() % _LEXICONS
    turn = np.append(lexicon, LEXICON_VOTERS + np.arange(len(_PATTERNS) + 1))
    marks = np.argwhere(np.array(sample.column("patterns").to_pylist(), dtype=bool).reshape(len(column), len(_PATTERNS) + 1))
    of, at = np.concatenate([of, marks[:, 0]]), np.concatenate([np.searchsorted(values, found), marks[:, 1] + len(values)])
    votes = np.zeros((len(column), LEXICON_VOTERS + len(_PATTERNS) + 2), dtype=bool)
    votes[of, turn[at]] = True
    votes[:, -1] = sample.column("toxic").to_numpy() == 1
    prior = n1 / (n1 + n0)
    return Model(values, linear_classifier(of, at, label_model(votes, prior), size))


def _scores(model: Model):
    """The scores of a column of texts; rows stay with Spark, only their texts go to Python."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index, weights = Index(model.values), model.weights
        n = len(model.values)
        for column in texts:
            score = np.full(len(column), weights[-1])
            for rows, values, _ in _features(column):
                found, at = index.find(rows, values)
                score += np.bincount(found, weights[at], minlength=len(column))
            score += _patterns(column.to_pylist()) @ weights[n:-1]
            yield pa.array(1 / (1 + np.exp(-np.clip(score, -50, 50))))

    return F.arrow_udf(run, "double")


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    scores = documents.select("doc_id", _scores(model)(F.col("text").cast("string")).alias("score"))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below the threshold, with all their columns."""
    model = fit(documents, labels)
    packed = documents.select(packed_row(documents), _scores(model)(F.col("text").cast("string")).alias("score"))
    return packed.where(F.col("score") < THRESHOLD).select("row.*")


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on the labelled training rows and scores every document."""
    return scored(documents, fit(documents, labels))

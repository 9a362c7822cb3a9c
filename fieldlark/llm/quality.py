"""Quality classifier: a label model over weak labellers trains a hashed linear scorer.

Two tasks share the code: ``junk`` (text that is no prose: symbol noise, shouting, tables,
loops) and ``toxic`` (insults).  Per task

1. overlapping heuristic labellers vote bad, good or abstain on every document;
2. expectation-maximisation over the counts of all vote patterns estimates how often each
   labeller votes what under each hidden class, and with it a posterior per pattern;
3. the posteriors of a bounded sample of documents train a linear scorer on hashed
   features, which judges every document.

Labellers that know words take them from a bounded sample of labelled documents: of low
quality for the first task, toxic for the second.  Both samples are the rows with the
smallest hash of their id.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.llm.common import give_back, released, returns
from fieldlark.llm.words import FOLDED, PLAIN, Words, mix, owner, windows

#: Bounds of the samples: labelled documents for the word lists, documents for the scorer.
LABELLED_SAMPLE, TRAINING_SAMPLE = 5_000, 5_000
BITS = 22
#: Words added to the length of a text when occurrences are weighed, and the largest weight.
SMOOTH, MOST = 60, 3.0
ABSTAIN, BAD, GOOD = 0, 1, 2
_CHUNK = 2 << 20

#: name -> (bad at or above, good at or below); between them a labeller abstains
RATIOS = {
    "symbols per byte": (0.05, 0.01),
    "words that end in a symbol": (0.3, 0.05),
    "capitals per letter": (0.3, 0.1),
    "exclamation marks per word": (0.3, 0.05),
    "bars per word": (0.15, 0.02),
    "words without letter or digit": (0.2, 0.05),
    "words that repeat the last one": (0.1, 0.04),
    "words that repeat one of the four before": (0.35, 0.2),
    "bytes per word": (9.0, 7.5),
}
INSULTS = "idiot moron stupid loser pathetic scum trash clown worthless disgusting dumb imbecile filth vermin retard bastard".split()
#: Value of the occurrences less half a one: bad at or above, good at or below.
WORD_RATES = (0.7, 0.5)
JUNK_VOTERS = (*RATIOS, "learnt words")
TOXIC_VOTERS = ("insult list", "learnt words", "learnt 6-byte stems", "learnt 4-byte stems")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*@^~=+<>{}[]\\_|"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_SOLID = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


def _value(n, length):
    """Weight of n occurrences in a text: against the spread of chance hits, which grows with the
    root of its length."""
    return np.minimum(10.0 * n / np.sqrt(length + SMOOTH), MOST)


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds."""
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


class Features:
    """Ratios and hashed word features of a slice of texts."""

    def __init__(self, texts: pa.Array):
        plain = Words(texts, PLAIN)
        self.n_texts = len(texts)
        h, n, doc = plain.hashes(), np.maximum(plain.counts(), 1), owner(plain.first)
        data, size = plain.data, np.maximum(np.diff(plain.offsets), 1)
        by_byte = lambda flags: _per_text(flags[data], plain.offsets)
        by_word = lambda flags: _per_text(flags, plain.first)
        last = data[plain.ends - 1] if len(doc) else np.zeros(0, np.uint8)
        solid = np.concatenate(([0], np.cumsum(_SOLID[data])))
        bare = solid[plain.ends] == solid[plain.starts]
        again = np.zeros(len(h), bool)
        near = np.zeros(len(h), bool)
        for lag in (1, 2, 3, 4):
            same = np.zeros(len(h), bool)
            if len(h) > lag:
                same[lag:] = (h[lag:] == h[:-lag]) & (doc[lag:] == doc[:-lag])
            near |= same
            if lag == 1:
                again = same
        bang, bar = np.zeros(256, bool), np.zeros(256, bool)
        bang[33], bar[124] = True, True
        self.ratios = np.stack(
            [
                by_byte(_SYMBOL) / size,
                by_word(_SYMBOL[last] & ~bare) / n,
                by_byte(_UPPER) / np.maximum(by_byte(_LETTER), 1),
                by_byte(bang) / n,
                by_byte(bar) / n,
                by_word(bare) / n,
                by_word(again) / n,
                by_word(near) / n,
                by_word(plain.ends - plain.starts) / n,
            ],
            axis=1,
        )
        self.empty = plain.counts() == 0
        words = Words(texts, FOLDED)
        self.words, self.word_hash, self.n_words = words, words.hashes(), words.counts()
        length = words.ends - words.starts
        stem = np.zeros(words.n, dtype=np.uint64)
        buckets = [mix(self.word_hash ^ np.uint64(1)) >> np.uint64(64 - BITS)]
        for j in range(6):
            inside = np.flatnonzero(length > j)
            stem[inside] |= words.fold[words.data[words.starts[inside] + j]].astype(np.uint64) << np.uint64(8 * j)
            if j in (3, 5):
                buckets.append((mix(stem ^ np.uint64(j << 56)) >> np.uint64(64 - BITS)) + np.uint64(len(buckets) << BITS))
        self.doc = owner(words.first)
        self.buckets = [b.astype(np.int32) for b in buckets]

    def ratio_levels(self) -> np.ndarray:
        """Per text a hashed feature for the level of each ratio, over the word buckets."""
        out = np.empty(self.ratios.shape, dtype=np.int32)
        for k, (bad, good) in enumerate(RATIOS.values()):
            edges = [good * 0.5, good, (good + bad) / 2, bad, bad * 2]
            out[:, k] = (3 << BITS) + k * 8 + np.searchsorted(edges, self.ratios[:, k], "right")
        return out

    def known(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text, feature) pairs of word features in ``table`` (flags by bucket), and their values."""
        docs, feats = [], []
        for b in self.buckets:
            at = np.flatnonzero(table[b])
            docs.append(self.doc[at])
            feats.append(b[at])
        pair, n = np.unique(np.concatenate(docs).astype(np.int64) << 32 | np.concatenate(feats), return_counts=True)
        d = pair >> 32
        return d, (pair & 0xFFFFFFFF).astype(np.int32), _value(n, self.n_words[d])

    def all(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Distinct features of each text, and their values."""
        levels = self.ratio_levels()
        ids, values = [], []
        for i in range(self.n_texts):
            a, b = self.words.first[i], self.words.first[i + 1]
            f, n = np.unique(np.concatenate([x[a:b] for x in self.buckets]), return_counts=True)
            ids.append(np.concatenate((f, levels[i])))
            values.append(np.concatenate((_value(n, b - a), np.ones(levels.shape[1]))).astype(np.float32))
        return ids, values

    def sketches(self) -> list[list[int]]:
        """Three min-hashes of each text's 5-word sequences, to know copies by."""
        out = []
        for i in range(self.n_texts):
            h = self.word_hash[self.words.first[i] : self.words.first[i + 1]]
            x = windows(h, 5) if len(h) >= 5 else h
            out.append([int((mix(x ^ np.uint64(k)) >> np.uint64(1)).min()) for k in (11, 22, 33)] if len(x) else [-1, -1, -1])
        return out


class WordLists(NamedTuple):
    """Hashed words and stems of toxic documents, and words of low-quality ones."""

    words: np.ndarray
    stems6: np.ndarray
    stems4: np.ndarray
    junk: np.ndarray


def _flags(ids: np.ndarray) -> np.ndarray:
    t = np.zeros(4 << BITS, dtype=bool)
    t[ids] = True
    return t


def _insult_buckets() -> np.ndarray:
    return Features(pa.array([" ".join(INSULTS)])).buckets[0]


class Voters:
    """The labellers of both tasks: votes (text, labeller)."""

    def __init__(self, lists: WordLists):
        self.insults = _flags(_insult_buckets())
        self.learnt = [_flags(x) for x in lists]
        self.has = [bool(len(x)) for x in lists]

    @staticmethod
    def _rate(f: Features, flags: np.ndarray, kind: int) -> np.ndarray:
        n = _value(np.maximum(_per_text(flags[f.buckets[kind]], f.words.first) - 0.5, 0), f.n_words)
        return np.where(n >= WORD_RATES[0], BAD, np.where(n <= WORD_RATES[1], GOOD, ABSTAIN))

    def _learnt(self, f: Features, which: int, kind: int) -> np.ndarray:
        return self._rate(f, self.learnt[which], kind) if self.has[which] else np.full(f.n_texts, ABSTAIN)

    def junk(self, f: Features) -> np.ndarray:
        bad, good = (np.array(x) for x in zip(*RATIOS.values()))
        votes = np.where(f.ratios >= bad, BAD, np.where(f.ratios <= good, GOOD, ABSTAIN))
        votes[f.empty] = BAD
        return np.column_stack((votes, self._learnt(f, 3, 0)))

    def toxic(self, f: Features) -> np.ndarray:
        return np.stack([self._rate(f, self.insults, 0), *(self._learnt(f, which, kind) for which, kind in ((0, 0), (1, 2), (2, 1)))], axis=1)


class LabelModel(NamedTuple):
    """P(vote | class) per labeller, and the prior of the bad class."""

    votes: np.ndarray  # (class, labeller, vote)
    prior: float

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        cols = np.arange(patterns.shape[1])
        logs = [np.log(self.votes[c, cols, patterns]).sum(axis=1) for c in (0, 1)]
        odds = logs[1] - logs[0] + np.log(self.prior) - np.log1p(-self.prior)
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))

    def accuracy(self) -> np.ndarray:
        """Per labeller: how often its votes, where it votes, agree with the hidden class."""
        right = self.prior * self.votes[1, :, BAD] + (1 - self.prior) * self.votes[0, :, GOOD]
        return right / (self.prior * (1 - self.votes[1, :, ABSTAIN]) + (1 - self.prior) * (1 - self.votes[0, :, ABSTAIN]))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over vote patterns, from the start that two bad votes, or
    one without a good one, are bad."""
    bad, good = (patterns == BAD).sum(axis=1), (patterns == GOOD).sum(axis=1)
    p = np.where((bad >= 2) | ((bad == 1) & (good == 0)), 0.95, np.where(bad == 1, 0.3, 0.02))
    model = None
    for _ in range(rounds):
        table = np.empty((2, patterns.shape[1], 3))
        for c, weight in ((1, p * counts), (0, (1 - p) * counts)):
            for k in range(patterns.shape[1]):
                got = np.bincount(patterns[:, k], weights=weight, minlength=3) + 0.1
                table[c, k] = got / got.sum()
        prior = float(np.clip((p * counts).sum() / max(counts.sum(), 1), 1e-4, 1 - 1e-4))
        model = LabelModel(table, prior)
        new = model.posterior(patterns)
        if np.abs(new - p).max(initial=0) < 1e-9:
            break
        p = new
    return model


class Scorer(NamedTuple):
    """A linear score over hashed features: bad if above 0."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, f: Features, flags: np.ndarray) -> np.ndarray:
        """``flags``: the features as a table, made once per task."""
        out = np.full(f.n_texts, self.bias)
        if len(self.features):
            d, feats, x = f.known(flags)
            np.add.at(out, d, self.weights[np.searchsorted(self.features, feats)] * x)
            levels = f.ratio_levels()
            at = np.minimum(np.searchsorted(self.features, levels), len(self.features) - 1)
            out += np.where(self.features[at] == levels, self.weights[at], 0.0).sum(axis=1)
        return out


def _contrast(feats: np.ndarray, rows: np.ndarray, x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per feature: its number, mean value under bad and good, z-score of their difference,
    and the number of bad texts that have it."""
    ids, inv = np.unique(feats, return_inverse=True)
    nb, ng = max(p.sum(), 1e-9), max((1 - p).sum(), 1e-9)
    mean, square = [], []
    for w, n in ((p, nb), (1 - p, ng)):
        mean.append(np.bincount(inv, weights=w[rows] * x, minlength=len(ids)) / n)
        square.append(np.bincount(inv, weights=w[rows] * x * x, minlength=len(ids)) / n)
    # one more text of the mean kind on either side, lest a feature without spread stand out
    spread = (square[0] - mean[0] ** 2 + 0.3 / nb) / nb + (square[1] - mean[1] ** 2 + 0.3 / ng) / ng
    return ids, mean[0], mean[1], (mean[0] - mean[1]) / np.sqrt(spread), np.bincount(inv, weights=p[rows], minlength=len(ids))


def train(features: list[np.ndarray], values: list[np.ndarray], p: np.ndarray, z_least: float = 4.5, ratio: float = 4.0, most: int = 4000, rounds: int = 600) -> Scorer:
    """Logistic regression on soft labels over the features that stand out in one class."""
    if not len(features) or p.max() < 0.5 or p.min() > 0.5:
        return Scorer(np.zeros(0, np.int32), np.zeros(0), 1.0 if len(p) and p.min() > 0.5 else -1.0)
    rows, feats, x = np.repeat(np.arange(len(features)), [len(f) for f in features]), np.concatenate(features), np.concatenate(values).astype(float)
    ids, bad, good, z, _ = _contrast(feats, rows, x, p)
    z = np.where(np.maximum(bad, good) >= ratio * np.minimum(bad, good), z, 0.0)
    strong = np.argsort(-np.abs(z), kind="stable")[:most]
    chosen = np.sort(ids[strong[np.abs(z[strong]) >= z_least]])
    at = np.minimum(np.searchsorted(chosen, feats), max(len(chosen) - 1, 0))
    use = chosen[at] == feats if len(chosen) else np.zeros(len(feats), bool)
    rows, at, x = rows[use], at[use], x[use]
    w, bias = np.zeros(len(chosen)), float(np.log(p.mean() / (1 - p.mean())))
    balance = np.full(len(p), 1 / len(p))
    square, square_bias = np.full(len(w), 1e-8), 1e-8
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(bias + np.bincount(rows, weights=w[at] * x, minlength=len(p)), -60, 60)))
        gap = (q - p) * balance
        g, gb = np.bincount(at, weights=gap[rows] * x, minlength=len(w)) + 1e-6 * w, gap.sum()
        square, square_bias = square + g * g, square_bias + gb * gb
        w -= 0.5 * g / np.sqrt(square)
        bias -= 0.5 * gb / np.sqrt(square_bias)
    return Scorer(chosen.astype(np.int32), w, float(bias))


def choose_words(features: list[np.ndarray], values: list[np.ndarray], p: np.ndarray) -> list[np.ndarray]:
    """Words, 6-byte and 4-byte stems that are frequent in bad texts and rare in others."""
    if not len(features):
        return [np.zeros(0, np.int32)] * 3
    rows, feats, x = np.repeat(np.arange(len(features)), [len(f) for f in features]), np.concatenate(features), np.concatenate(values).astype(float)
    ids, bad, good, z, n = _contrast(feats, rows, x, p)
    ids = ids[(bad >= 5 * good) & (z >= 3.8) & (n >= 6)]
    return [ids[ids >> BITS == kind] for kind in (0, 2, 1)]


class Model(NamedTuple):
    lists: WordLists
    label_models: dict[str, LabelModel]
    scorers: dict[str, Scorer]


def _slices(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + _CHUNK, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _collect_features(batches):
    for b in _slices(batches):
        f = Features(b.column(1))
        ids, values = f.all()
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32())), pa.array(f.sketches(), pa.list_(pa.int64()))], names=["id", "features", "vals", "sketch"]
        )


def _encode(votes: np.ndarray) -> np.ndarray:
    return votes @ (3 ** np.arange(votes.shape[1], dtype=np.int64))


def _decode(codes: np.ndarray, n: int) -> np.ndarray:
    return codes[:, None] // (3 ** np.arange(n, dtype=np.int64)) % 3


def _smallest(ids: DataFrame, n: int) -> DataFrame:
    return ids.orderBy(F.xxhash64("id"), "id").limit(n)


def _one_each(rows: DataFrame) -> DataFrame:
    """One row per id, the text of least hash: a sample has no more rows than ids, however often one comes."""
    return rows.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def _once(sketches: list[list[int]]) -> np.ndarray:
    """Rows that are no copy of a row before: none of their min-hashes was met."""
    met: set[tuple[int, int]] = set()
    keep = []
    for s in sketches:
        keys = {(k, v) for k, v in enumerate(s)}
        keep.append(not keys & met)
        met |= keys
    return np.array(keep, dtype=bool)


def learn_words(docs: DataFrame, labels: DataFrame, sample: int = LABELLED_SAMPLE) -> WordLists:
    """Words and stems that stand in toxic, or low-quality, documents of the labelled sample
    only.  Copies of a document count once, or all words of a much-copied one would stand out."""
    marked = labels.where("id is not null and (toxic is not null or quality is not null)").groupBy("id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    marked = _smallest(marked, sample)
    rows = _one_each(docs.join(F.broadcast(marked.select("id")), "id"))
    got = rows.mapInArrow(released(_collect_features), returns("features array<int>, vals array<float>, sketch array<bigint>", id=rows.schema["id"].dataType)).toArrow().sort_by("id")
    known = {r.id: r for r in marked.collect()}
    keep = np.flatnonzero(_once(got.column("sketch").to_pylist()))
    ids = got.column("id").to_pylist()

    def words(bad) -> list[np.ndarray]:
        at = [i for i in keep.tolist() if bad(known[ids[i]]) is not None]
        return choose_words(_lists(got, "features", at), _lists(got, "vals", at), np.array([float(bad(known[ids[i]])) for i in at]))

    # insults say nothing about quality and junk nothing about insults: each is learnt beside the clean rest
    junk = words(lambda r: None if r.quality is None or r.toxic else r.quality <= 0)
    give_back()
    return WordLists(*words(lambda r: None if r.toxic is None else r.toxic > 0), junk[0])


def _lists(got: pa.Table, name: str, keep: list[int] | np.ndarray) -> list[np.ndarray]:
    column = got.column(name).combine_chunks()
    return [column[int(i)].values.to_numpy() for i in keep]


def fit(docs: DataFrame, labels: DataFrame, labelled_sample: int = LABELLED_SAMPLE, training_sample: int = TRAINING_SAMPLE) -> Model:
    """``docs`` (id, text), ``labels`` (id, toxic, quality) -> the model.

    What comes to the driver is bounded: word lists and hashed features of the two samples, one
    text for each of their ids, and counts of the vote patterns of each task (at most 3 to the
    number of its labellers).
    """
    sc = docs.sparkSession.sparkContext
    lists = learn_words(docs, labels, labelled_sample)
    give_back()
    shared = sc.broadcast(lists)
    sizes = {"junk": len(JUNK_VOTERS), "toxic": len(TOXIC_VOTERS)}

    def vote(batches):
        voters = Voters(shared.value)
        for b in _slices(batches, 0):
            f = Features(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(_encode(voters.junk(f)), pa.int64()), pa.array(_encode(voters.toxic(f)), pa.int64())], names=["junk", "toxic"])

    votes = docs.select("text").mapInArrow(released(vote), "junk bigint, toxic bigint")
    each = F.explode(F.array(*[F.struct(F.lit(task).alias("task"), F.col(task).alias("code")) for task in sizes]))
    counted = votes.select(each.alias("v")).groupBy("v.task", "v.code").agg(F.count(F.lit(1)).alias("n")).collect()
    models = {}
    for task in sizes:
        tally = {r.code: r.n for r in counted if r.task == task}
        codes = np.array(sorted(tally), dtype=np.int64)
        models[task] = estimate(_decode(codes, sizes[task]), np.array([tally[c] for c in codes.tolist()], dtype=float))

    chosen = _smallest(docs.select("id").where("id is not null"), training_sample)

    def sample(batches):
        voters = Voters(shared.value)
        for b in _slices(batches):
            f = Features(b.column(1))
            ids, values = f.all()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32())), pa.array(f.sketches(), pa.list_(pa.int64())), pa.array(_encode(voters.junk(f)), pa.int64()), pa.array(_encode(voters.toxic(f)), pa.int64())],
                names=["id", "features", "vals", "sketch", "junk", "toxic"],
            )

    rows = _one_each(docs.join(F.broadcast(chosen.distinct()), "id", "left_semi"))
    got = rows.mapInArrow(released(sample), returns("features array<int>, vals array<float>, sketch array<bigint>, junk bigint, toxic bigint", id=rows.schema["id"].dataType)).toArrow().sort_by("id")
    scorers = {}
    keep = np.flatnonzero(_once(got.column("sketch").to_pylist()))
    features, values = _lists(got, "features", keep), _lists(got, "vals", keep)
    for task in sizes:
        codes = np.array(got.column(task).to_pylist(), dtype=np.int64)[keep]
        scorers[task] = train(features, values, models[task].posterior(_decode(codes, sizes[task])))
        give_back()
    del got, features, values
    give_back()
    return Model(lists, models, scorers)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(id, text) -> (id, junk_score, toxic_score); a score above 0 rejects.  ``id`` may be of any type."""
    shared = docs.sparkSession.sparkContext.broadcast(model.scorers)

    def run(batches):
        scorers = [(shared.value[task], _flags(shared.value[task].features)) for task in ("junk", "toxic")]
        for b in _slices(batches):
            f = Features(b.column(1))
            junk, toxic = (scorer.score(f, flags) for scorer, flags in scorers)
            junk[f.empty] = np.maximum(junk[f.empty], 1.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(junk, pa.float64()), pa.array(toxic, pa.float64())], names=["id", "junk_score", "toxic_score"])

    return docs.mapInArrow(released(run), returns("junk_score double, toxic_score double", id=docs.schema["id"].dataType))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", toxic_col: str = "toxic", quality_col: str = "quality", row_col: str | None = None
) -> DataFrame:
    """(id, ``junk_score``, ``toxic_score``, ``keep``) of every row; with ``row_col``, that column of the row in place of the id.

    Edge cases: texts without words (null, empty, blank) are junk; without labels, or
    without one of the two label columns, the word lists learnt from them are empty and
    their labellers abstain; null labels are left out, and of repeated labels the worse
    counts; rows with equal ids are scored each by their text; texts of any length are
    scored whole; an empty table gives an empty table; other columns are ignored; ids of any
    type that can be ordered are kept as they are.  No shuffle of texts but those of the samples.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    mark = lambda c, name: (F.col(c) if c in labels.columns else F.lit(None).cast("int")).alias(name)
    marks = labels.select(F.col(label_id).alias("id"), mark(toxic_col, "toxic"), mark(quality_col, "quality"))
    scored = score(docs.select(F.col(row_col).alias("id"), F.col(text_col).alias("text")) if row_col else d, fit(d, marks))
    return scored.select(F.col("id").alias(row_col or id_col), "junk_score", "toxic_score", ((F.col("junk_score") <= 0) & (F.col("toxic_score") <= 0)).alias("keep"))

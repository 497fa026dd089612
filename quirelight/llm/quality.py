"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every pair of features interacts through the inner product of two short vectors.  The sum over all
pairs is half of (square of the sum minus sum of the squares), so a score takes time linear in the
features of a text.  Features are the words of the whole text, hashed; statistics of its structure, as
numbers and as the bin they fall in; and its lengths as metadata.  Labels, language, source and id
are never among them.

The machine is fitted on the driver on at most `sample` labelled rows (where there are more, those with
the least hash of their id, 95 in 100 of `sample` on average), a bound that does not grow with the corpus;
scoring is one pass without a shuffle.

Defined cases: null and empty texts have the statistics of an empty text and get a score like any
other; rows without a label are only scored; of labels that repeat an id the smallest counts; with no
labelled rows, or of one kind only, all scores are that share of label 1 (0.5 without any); a text is
read whole, however long; an empty table gives no rows; a column with the name of the score is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.llm.common import crc_fold, cut_lineage, freed

BUCKETS = 1 << 15
FACTORS = 8
CUTS = 8
_MEMO = 50_000

_CLASSES = [
    [*range(65, 91)],  # upper case
    [*range(97, 123)],  # lower case
    [*range(48, 58)],
    [ord(c) for c in "%$&*#@^~_=<>{}\\"],
    [ord(c) for c in "!?"],
    [ord(c) for c in ".,;:"],
    [ord(c) for c in "|"],
    [ord(c) for c in "\"'()[]+-/"],
    [10],
    [9, 13, 32],
    [*range(128, 256)],
]
N_STATS = len(_CLASSES) + 9
_CLASS_SUMS = np.zeros((256, len(_CLASSES)))
for _k, _bytes in enumerate(_CLASSES):
    _CLASS_SUMS[_bytes, _k] = 1


class Features:
    """Word buckets and statistics of texts, with a bounded memo of words; one a task."""

    def __init__(self, buckets: int = BUCKETS):
        from xxhash import xxh32_intdigest

        self.buckets, self._hash, self._known = buckets, xxh32_intdigest, {}

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of the distinct words, their weights (unit length together), and the statistics."""
        raw = np.frombuffer(text.encode(), np.uint8)
        words = text.split()
        uses = Counter(words)
        known = self._known
        if len(known) > _MEMO:
            known.clear()
        for word in [w for w in uses if w not in known]:
            known[word] = self._hash(word.encode()) % self.buckets
        at = np.fromiter(map(known.__getitem__, uses), np.int32, len(uses))
        count = np.fromiter(uses.values(), np.float64, len(uses))
        weight = np.log1p(count)
        weight /= max(1.0, float(np.sqrt((weight * weight).sum())))
        return at, weight.astype(np.float32), self._stats(text, raw, len(words), count)

    @staticmethod
    def _stats(text: str, raw: np.ndarray, n: int, count: np.ndarray) -> np.ndarray:
        shares = np.bincount(raw, minlength=256) @ _CLASS_SUMS / max(1, len(raw))
        lines = [line for line in text.split("\n") if line]
        some = max(1, n)
        more = [
            np.log1p(len(text)),
            np.log1p(n),
            len(raw) / max(1, len(text)),
            len(text) / some,
            len(count) / some,
            count.max() / some if n else 0.0,
            float((count * count).sum()) / (some * some),
            len(set(lines)) / max(1, len(lines)),
            np.log1p(n / max(1, len(lines))),
        ]
        return np.concatenate([shares, more])


@dataclass
class Machine:
    """w0, the linear weights and the vectors of the features; features of the statistics come after the words."""

    bias: float
    linear: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    cuts: np.ndarray
    buckets: int

    def row(self, at: np.ndarray, weight: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values of one text's features."""
        number = np.clip((stats - self.mean) / self.scale, -3, 3) * 0.5
        first = self.buckets + np.arange(N_STATS) * (CUTS + 1)
        bins = first + 1 + (stats[:, None] > self.cuts).sum(axis=1)
        return np.concatenate([at, first, bins]), np.concatenate([weight, number, np.full(N_STATS, 0.5)])

    def score(self, at: np.ndarray, value: np.ndarray) -> float:
        moved = self.vectors[at] * value[:, None]
        pairs = 0.5 * float((moved.sum(axis=0) ** 2).sum() - (moved * moved).sum())
        return float(1 / (1 + np.exp(-np.clip(self.bias + float(self.linear[at] @ value) + pairs, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, buckets: int = BUCKETS, epochs: int = 8, batch: int = 128, rate: float = 0.08, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Logistic loss by stochastic gradients with step sizes of their own for each weight."""
    size = buckets + N_STATS * (CUTS + 1)
    rng = np.random.default_rng(seed)
    stats = np.array([r[2] for r in rows]).reshape(-1, N_STATS)
    share = float(labels.mean()) if len(labels) else 0.5
    mean, scale = (stats.mean(axis=0), stats.std(axis=0)) if len(rows) else (np.zeros(N_STATS), np.ones(N_STATS))
    cuts = np.quantile(stats, np.arange(1, CUTS) / CUTS, axis=0).T if len(rows) else np.zeros((N_STATS, CUTS - 1))
    machine = Machine(0.0, np.zeros(size), np.zeros((size, FACTORS)), mean, np.where(scale > 1e-9, scale, 1.0), cuts, buckets)
    share = min(max(share, 1e-6), 1 - 1e-6)
    machine.bias = float(np.log(share / (1 - share)))
    if not 0 < labels.sum() < len(labels):
        return machine
    machine.vectors = rng.normal(0, 0.02, (size, FACTORS))
    # all rows' features one after another, and where each row's begin
    more = 2 * N_STATS
    ends = np.cumsum([0, *(len(r[0]) + more for r in rows)])
    all_at, all_x = np.empty(ends[-1], np.int32), np.empty(ends[-1], np.float32)
    for r, lo, hi in zip(rows, ends[:-1], ends[1:], strict=True):
        all_at[lo:hi], all_x[lo:hi] = machine.row(*r)
    del stats
    seen_linear, seen_vectors, seen_bias = np.full(size, 1e-3), np.full((size, FACTORS), 1e-3), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            at = np.concatenate([all_at[ends[i] : ends[i + 1]] for i in part])
            x = np.concatenate([all_x[ends[i] : ends[i + 1]] for i in part]).astype(np.float64)
            sizes = ends[part + 1] - ends[part]
            starts = np.cumsum(sizes) - sizes
            moved = machine.vectors[at] * x[:, None]
            sums = np.add.reduceat(moved, starts)
            pairs = 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((moved * moved).sum(axis=1), starts))
            z = machine.bias + np.add.reduceat(machine.linear[at] * x, starts) + pairs
            slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(part)
            each = np.repeat(slope, sizes)
            used, place = np.unique(at, return_inverse=True)
            g_linear = np.bincount(place, each * x, len(used)) + decay * machine.linear[used]
            g_each = each[:, None] * x[:, None] * (np.repeat(sums, sizes, axis=0) - moved)
            g_vectors = np.stack([np.bincount(place, g_each[:, f], len(used)) for f in range(FACTORS)], axis=1) + decay * machine.vectors[used]
            seen_linear[used] += g_linear**2
            seen_vectors[used] += g_vectors**2
            seen_bias += slope.sum() ** 2
            machine.linear[used] -= rate * g_linear / np.sqrt(seen_linear[used])
            machine.vectors[used] -= rate * g_vectors / np.sqrt(seen_vectors[used])
            machine.bias -= rate * slope.sum() / np.sqrt(seen_bias)
    return machine


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, sample: int = 20_000
) -> Machine:
    """Fits on at most `sample` labelled rows outside fold 0.

    The rows are those below a bound on their hash.  The bound lets 95 in 100 of `sample` through on average,
    seven standard deviations below it at 20,000, and nothing is sorted or sent to the driver for it but a count.
    """
    chosen = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (crc_fold(F.col(id_col), folds) != 0))
    chosen = chosen.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # labels of rows that are gone do not use up the sample
    there = cut_lineage(chosen.join(texts.select("id"), "id", "left_semi"))
    n = there.count()
    if n > sample:
        there = there.filter(F.xxhash64("id") < int((0.95 * sample / n - 0.5) * 2**64))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [features.of(t.as_py() or "") for t in batch.column("text")]
            kinds = (pa.list_(pa.int32()), pa.list_(pa.float32()), pa.list_(pa.float64()))
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *columns], names=["id", "label", "at", "weight", "stats"])

    joined = texts.join(F.broadcast(there), "id")  # `sample` ids and labels at most
    made = joined.mapInArrow(freed(run), f"id {kind}, label int, at array<int>, weight array<float>, stats array<double>").dropDuplicates(["id"])
    held = made.toArrow()  # columns stay as they came; rows are views into them
    order = sorted(range(held.num_rows), key=[str(i) for i in held.column("id").to_pylist()].__getitem__)
    data = [tuple(held.column(c)[i].values.to_numpy() for c in ("at", "weight", "stats")) for i in order]
    labels_of = held.column("label").to_numpy()[order] > 0 if order else np.zeros(0)
    return fit(data, labels_of.astype(np.float64))


def with_scores(docs: DataFrame, machine: Machine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of docs and the score of each text, 0 to 1; a column of that name is replaced."""
    docs = docs.drop(score_col)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{score_col}` double"])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model = Features(shared.value.buckets), shared.value
        for batch in batches:
            scores = [model.score(*model.row(*features.of(t.as_py() or ""))) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(freed(run), schema)

"""Subword lattice likelihood.

The pieces of an existing vocabulary get probabilities; a word's probability is the sum over all its
segmentations into pieces, found by a forward recursion in log space, and a text's is the product over
its words and one end.  Pieces begin at word borders or inside words, never across them, so the
lattice of a text falls apart into those of its words and each distinct word is summed once.

The vocabulary's own scores give the first piece probabilities (its scores are ranks, so by Zipf's law);
expected counts over the training words, by forward and backward sums, replace them.  Beside it stands
the base model: smoothed counts of whole words.

The words of all texts, with their training counts and lattice sums, are one table that grows with the
corpus.  The most frequent words, `head` at most, go to every task; the words of a text that are
not among them are joined with the table.

Defined cases: null and empty texts are one end; characters outside the vocabulary are spelled in its
bytes; with no training rows all counts are zero and the vocabulary's scores stay; repeated rows count
each; ids may be null (they fall in the fold of the empty text).  Texts are scored whole, however long; an empty
table gives no rows; further columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.llm.common import crc_fold, cut_lineage
from quirelight.llm.spm import SPACE, model_bytes

#: Distinct words that a task adds up before it hands counts on.
_FLUSH = 200_000
#: Words whose lattices are summed together; longer ones than _LONG characters are summed alone.
_TOGETHER, _LONG = 5000, 100


def tokens(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words in UTF-8, cut at \\x20 and \\x09 to \\x0D, which is how bytes are lower-cased and cut."""
    return text.encode().lower().split()


class Lattice:
    """Natural-log piece probabilities of one vocabulary and the sums over segmentations."""

    def __init__(self, proto: bytes, logs: np.ndarray | None = None):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        size = model.get_piece_size()
        usable = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i))]
        self.usable = np.array(usable)
        byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in usable if model.is_byte(i)}
        self.byte_ids = np.array([byte_ids[b] for b in range(256)])
        pieces = {model.id_to_piece(i): i for i in usable if not model.is_byte(i)}
        if logs is None:
            order = sorted(usable, key=lambda i: (-model.get_score(i), i))
            weights = 1 / (np.arange(len(order)) + 2)
            logs = np.full(size, -np.inf)
            logs[order] = np.log(weights / weights.sum())
        self.logs = logs
        self.length = np.ones(size, np.int64)
        self.automaton = ahocorasick.Automaton()
        for piece, i in pieces.items():
            if piece.strip(SPACE) or len(piece) == 1:  # runs of spaces never occur inside a word
                self.length[i] = len(piece)
                self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.unknown = re.compile("[^\n" + re.escape("".join(p for p in pieces if len(p) == 1)) + "]")

    def _edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """The lattices of all words, one after another: start and end node, piece and log of each edge, the depth
        of each node in its word, and the last node of each word.  An edge of bytes has the piece -1 - (its character)."""
        text = "\n".join([SPACE + w for w in words])
        flat = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        end, piece = flat[:, 0] + 1, flat[:, 1]
        start, log = end - self.length[piece], self.logs[piece]
        if odd := [(m.start(), m[0]) for m in self.unknown.finditer(text)]:
            at = np.array([a for a, _ in odd])
            spelled = np.array([self.logs[self.byte_ids[list(c.encode())]].sum() for _, c in odd])
            code = np.array([-1 - ord(c) for _, c in odd])
            start, end = np.concatenate([start, at]), np.concatenate([end, at + 1])
            piece, log = np.concatenate([piece, code]), np.concatenate([log, spelled])
        sizes = np.array([len(w) + 2 for w in words])  # nodes of a word: one more than its characters and its space
        first = np.cumsum(sizes) - sizes
        depth = np.arange(sizes.sum()) - np.repeat(first, sizes)
        return start, end, piece, log, depth, first + sizes - 1

    @staticmethod
    def _sums(into: np.ndarray, out_of: np.ndarray, log: np.ndarray, depth: np.ndarray, known: np.ndarray, falling: bool) -> None:
        """known[node] = log of the sum over edges of exp(log + known[other end]), depth by depth."""
        order = np.lexsort((into, -depth[into] if falling else depth[into]))
        into, out_of, log = into[order], out_of[order], log[order]
        heads = np.flatnonzero(np.r_[True, into[1:] != into[:-1]])
        level = depth[into[heads]]
        cuts = np.r_[np.flatnonzero(np.r_[True, level[1:] != level[:-1]]), len(heads)]
        heads = np.r_[heads, len(into)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            lo, hi = heads[a], heads[b]
            at = heads[a:b] - lo
            terms = known[out_of[lo:hi]] + log[lo:hi]
            top = np.maximum.reduceat(terms, at)
            spread = np.repeat(top, np.diff(np.r_[at, hi - lo]))
            known[into[lo:hi][at]] = top + np.log(np.add.reduceat(np.exp(terms - spread), at))

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's sum over all segmentations."""
        return self._by_part(words, lambda part, _: self._forward(part)[0])

    def _by_part(self, words: list[str], work, weights: np.ndarray | None = None) -> np.ndarray:
        """Works through the words in bounded parts, very long ones alone."""
        out = np.zeros(len(words))
        short = [i for i, w in enumerate(words) if len(w) <= _LONG]
        parts = [short[k : k + _TOGETHER] for k in range(0, len(short), _TOGETHER)]
        for part in chain(parts, ([i] for i, w in enumerate(words) if len(w) > _LONG)):
            out[part] = work([words[i] for i in part], None if weights is None else weights[part])
        return out

    def _forward(self, words: list[str]) -> tuple:
        start, end, piece, log, depth, last = edges = self._edges(words)
        alpha = np.zeros(len(depth))
        self._sums(end, start, log, depth, alpha, False)
        return alpha[last], alpha, edges

    def expected(self, words: list[str], counts: np.ndarray, uses: np.ndarray) -> None:
        """Adds to uses, by piece, the expected uses in words that stand `counts` times."""

        def work(part: list[str], weight: np.ndarray) -> np.ndarray:
            total, alpha, (start, end, piece, log, depth, last) = self._forward(part)
            beta = np.zeros(len(depth))
            self._sums(start, end, log, depth, beta, True)
            word = np.searchsorted(last, end)
            share = weight[word] * np.exp(alpha[start] + log + beta[end] - total[word])
            whole = piece >= 0
            uses[:] += np.bincount(piece[whole], share[whole], len(uses))
            for code, x in zip(piece[~whole].tolist(), share[~whole].tolist(), strict=True):
                for b in chr(-1 - code).encode():
                    uses[self.byte_ids[b]] += x
            return total

        self._by_part(words, work, counts)


_LATTICES: dict[tuple, Lattice] = {}


def _lattice(proto: bytes, logs: np.ndarray | None) -> Lattice:
    """One lattice a worker and model; the last two are kept."""
    key = (proto, None if logs is None else logs.tobytes())
    if key not in _LATTICES:
        while len(_LATTICES) > 1:
            _LATTICES.pop(next(iter(_LATTICES)))
        _LATTICES[key] = Lattice(proto, logs)
    return _LATTICES[key]


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c) over columns text and train: every word of all texts with its uses in the training texts.

    Words are added up in the tasks before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text, train in zip(batch.column("text"), batch.column("train").to_pylist(), strict=True):
                found = tokens(text.as_py() or "")
                if train:
                    seen.update(found)
                else:
                    for word in found:
                        if word not in seen:
                            seen[word] = 0
                if len(seen) >= _FLUSH:
                    yield _counted(seen)
                    seen = Counter()
        yield _counted(seen)

    return rows.select("text", "train").mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def _counted(seen: Counter) -> pa.RecordBatch:
    words = pa.array(list(seen), pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([words, pa.array(list(seen.values()), pa.int64())], names=["word", "c"])


def _columns(**columns: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in columns.values()], names=list(columns))


def learn(words: DataFrame, proto: bytes, train_docs: int, rounds: int = 1) -> tuple[np.ndarray | None, float]:
    """Piece logs (None: the vocabulary's own) and the log of an end, from (word, c)."""
    logs, end = None, math.log(0.5)
    for _ in range(rounds if train_docs else 0):

        def run(batches: Iterator[pa.RecordBatch], logs: np.ndarray | None = logs) -> Iterator[pa.RecordBatch]:
            lattice = _lattice(proto, logs)
            uses = np.zeros(len(lattice.logs))
            for batch in batches:
                lattice.expected(batch.column("word").to_pylist(), batch.column("c").to_numpy(), uses)
            used = np.flatnonzero(uses)
            yield _columns(piece=(used, pa.int32()), n=(uses[used], pa.float64()))

        spread = words.filter("c > 0").mapInArrow(run, "piece int, n double")
        found = spread.groupBy("piece").agg(F.sum("n").alias("n")).collect()  # as many rows as the vocabulary at most
        start = Lattice(proto)
        uses = np.full(len(start.logs), -np.inf)
        uses[start.usable] = 0.1
        for r in found:
            uses[r.piece] += r.n
        total = uses[start.usable].sum() + train_docs + 0.1
        logs, end = np.log(np.maximum(uses, 0) / total, where=uses > 0, out=np.full(len(uses), -np.inf)), math.log((train_docs + 0.1) / total)
    return logs, end


def with_lattice_sums(words: DataFrame, proto: bytes, logs: np.ndarray | None) -> DataFrame:
    """(word, c, log10 of the word's lattice sum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(proto, logs)
        for batch in batches:
            sums = lattice.log_probabilities(batch.column("word").to_pylist()) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(sums)], names=["word", "c", "p"])

    return words.select("word", "c").mapInArrow(run, "word string, c bigint, p double")


def _frequent(words: DataFrame, head: int) -> list:
    """The rows of the most frequent words, `head` at most.

    Words are counted by classes of their logarithm, some hundreds, and whole classes are taken from the
    top; a sorted limit would send the driver `head` rows of every partition.
    """
    size = F.floor(F.log2(F.col("c") + F.lit(1)) * 16).cast("int")
    least, taken = None, 0
    for r in sorted(words.groupBy(size.alias("class")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["class"]):
        taken += r.n
        if taken > head:
            break
        least = r["class"]
    return [] if least is None else words.filter(size >= least).collect()


def lattice_scores(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, head: int = 100_000, rounds: int = 1
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; learns from the rows that are not held out."""
    spark = docs.sparkSession
    held_out = crc_fold(F.col(id_col), folds) == 0
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), held_out.alias("held_out"), (~held_out).alias("train"))
    proto = model_bytes(model_path)
    counts = cut_lineage(word_counts(rows))
    stats = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    train_docs = rows.filter("train").count()
    n, v = (stats[0] or 0) + train_docs, stats[1] + (1 if train_docs else 0)  # each text has an end
    logs, end = learn(counts, proto, train_docs, rounds)
    words = cut_lineage(with_lattice_sums(counts, proto, logs))
    top = _frequent(words.filter(F.length("word") <= 64), head)
    places = {r.word.encode(): i for i, r in enumerate(top)}
    about = np.array([(math.log10(r.c + 0.1), r.p, r.c > 0) for r in top], np.float64).reshape(-1, 3)
    shared = spark.sparkContext.broadcast((places, about))
    base, end_base, end_p, end_known = math.log10(n + 0.1 * (v + 1)), math.log10(train_docs + 0.1), end / math.log(10), int(train_docs > 0)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, about = shared.value[0].get, shared.value[1]
        for batch in batches:
            sums: list[np.ndarray] = []
            lengths: list[int] = []
            ends, rare_words, rare_uses = [0], [], []
            for text in batch.column("text"):
                uses = Counter(tokens(text.as_py() or ""))
                at = np.fromiter(map(place, uses, repeat(-1)), np.int64, len(uses))
                times = np.fromiter(uses.values(), np.int64, len(uses))
                there = at >= 0
                sums.append(times[there] @ about[at[there]])
                lengths.append(int(times.sum()) + 1)
                rare_words += compress(uses, ~there)
                rare_uses.append(times[~there])
                ends.append(len(rare_words))
            made = np.array(sums).reshape(-1, 3)
            words_of = pa.array(rare_words, pa.binary()).cast(pa.string())
            uses_of = pa.array(np.concatenate(rare_uses) if rare_uses else [], pa.int64()).cast(pa.int32())
            rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([words_of, uses_of], names=["word", "uses"]))
            known = made[:, 2].astype(np.int64) + end_known
            columns = [pa.array(lengths, pa.int64()), pa.array(known), pa.array(made[:, 0] + end_base), pa.array(made[:, 1] + end_p), rare]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), *columns], names=["id", "held_out", "n_tokens", "n_head", "base_sum", "p_sum", "rare"]
            )

    scanned = rows.select("id", "held_out", "text").mapInArrow(
        run, f"id {kind}, held_out boolean, n_tokens bigint, n_head bigint, base_sum double, p_sum double, rare array<struct<word: string, uses: int>>"
    )
    # row numbers tie sums to rows, whatever ids repeat or are null; the checkpoint fixes them
    scanned = cut_lineage(scanned.withColumn("row", F.monotonically_increasing_id()))
    rare = scanned.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.uses")
    sums = (
        rare.join(words, "word")
        .groupBy("row")
        .agg(
            F.sum(F.col("uses") * F.log10(F.col("c") + F.lit(0.1))).alias("rare_base"),
            F.sum(F.col("uses") * F.col("p")).alias("rare_p"),
            F.sum(F.when(F.col("c") > 0, F.col("uses")).otherwise(0)).alias("n_rare"),
        )
    )
    joined = scanned.drop("rare").join(sums, "row", "left").na.fill(0, ["rare_base", "rare_p", "n_rare"])
    return joined.select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.col("n_rare")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_sum") + F.col("rare_base") - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (F.col("p_sum") + F.col("rare_p")).alias("score"),
    )

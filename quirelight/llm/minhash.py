"""One-permutation MinHash with optimal densification and packed low-order bits.

Each shingle of five words is hashed once; the top bits of the hash choose a bin, the rest is its
value there, and a bin keeps its least value.  An empty bin takes the value of the first filled bin on
its own fixed, random walk over the bins (so two texts that share filled bins fill alike).  Of each
bin only the lowest bits are kept, packed.  Two texts agree by chance in 2**-bits of the bins, which
the likeness takes out again.

Defined cases: a text of fewer than five words is one shingle; one of none (null, empty, blank) has the
empty fingerprint, alike only to another such; equal texts have equal fingerprints, and likeness 1.
In `neighbour_likeness`, ties of the id follow in the order of the texts' hashes, null ids come
last, and a table of one row is its own neighbour.  Texts are read whole, however long; an empty table gives no
rows; further columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirelight.llm.common import cut_lineage, shuffle_width

SHINGLE = 5
BINS = 256
BITS = 4
_MEMO = 300_000
_LOW = np.uint64((1 << 56) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly (xor, shift and multiply rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_WALK: dict[int, np.ndarray] = {}


def _walk(bins: int) -> np.ndarray:
    """For each bin, the bins that it asks in turn: steps x bins; every bin comes up with near certainty."""
    if bins not in _WALK:
        steps = np.arange(32 * bins, dtype=np.uint64)[:, None] * np.uint64(bins) + np.arange(bins, dtype=np.uint64)[None, :]
        _WALK[bins] = (_mix(steps + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bins)).astype(np.int32)
    return _WALK[bins]


class Hasher:
    """Word hashes with a bounded memo; one a task."""

    def __init__(self, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE):
        if bins & (bins - 1) or bins * bits % 8:
            raise ValueError("bins must be a power of two, and bins * bits whole bytes")
        from xxhash import xxh64_intdigest

        self.bins, self.bits, self.shingle = bins, bits, shingle
        self._hash = xxh64_intdigest
        self._known: dict[str, int] = {}

    def _words(self, words: list[str]) -> np.ndarray:
        known = self._known
        if len(known) > _MEMO:
            known.clear()
        for word in words:
            if word not in known:
                known[word] = self._hash(word.encode())
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def shingles(self, text: str) -> np.ndarray:
        """Hashes of the text's shingles; lower case, cut at white space."""
        words = text.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        each = self._words(words)
        n = min(self.shingle, len(each))
        total = np.zeros(len(each) - n + 1, np.uint64)
        for i in range(n):
            total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + each[i : i + len(total)])
        return total

    def bins_of(self, text: str) -> np.ndarray | None:
        """The densified value of each bin; None without shingles."""
        hashes = self.shingles(text)
        if not len(hashes):
            return None
        values = np.full(self.bins, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(values, (hashes >> np.uint64(64 - self.bins.bit_length() + 1)).astype(np.int64), hashes & _LOW)
        empty = np.flatnonzero(values == np.iinfo(np.uint64).max)
        if len(empty):
            filled = values != np.iinfo(np.uint64).max
            donors = _walk(self.bins)
            source = np.full(len(empty), -1)
            left = np.arange(len(empty))
            for step in range(0, len(donors), 64):
                asked = donors[step : step + 64, empty[left]]
                there = filled[asked]
                found = there.any(axis=0)
                source[left[found]] = asked[there.argmax(axis=0)[found], np.flatnonzero(found)]
                left = left[~found]
                if not len(left):
                    break
            source[left] = np.flatnonzero(filled)[0]  # after 32 rounds per bin; one in e^32 texts of a single shingle
            values[empty] = values[source]
        return values

    def pack(self, values: np.ndarray | None) -> str:
        if values is None:
            return ""
        low = (_mix(values) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        raw = np.unpackbits(low[:, None], axis=1)[:, 8 - self.bits :]
        return base64.b64encode(np.packbits(raw.ravel()).tobytes()).decode()

    def fingerprint(self, text: str) -> str:
        return self.pack(self.bins_of(text))

    def likeness(self, a: str, b: str) -> float:
        """Estimated share of common shingles, 0 to 1."""
        if a == b:
            return 1.0
        if not a or not b:
            return 0.0
        x, y = (np.frombuffer(base64.b64decode(s), np.uint8) for s in (a, b))
        differs = np.unpackbits(x ^ y).reshape(self.bins, self.bits).any(axis=1)
        chance = 2.0**-self.bits
        return float(max(0.0, (1 - differs.mean() - chance) / (1 - chance)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """(id, fingerprint) for every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(bins, bits, shingle)
        for batch in batches:
            made = [hasher.fingerprint(t.as_py() or "") for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.string())], names=["id", "fingerprint"])

    return rows.mapInArrow(run, f"id {kind}, fingerprint string")


def spliced(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the start of the following one."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def neighbour_likeness(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE
) -> DataFrame:
    """Every text against an edited copy of itself and against its neighbour, the next by falling id.

    Rows are dealt out once by ranges of the id and walked in order, so a neighbour is the next row; only
    the first and the last row of each range meet again, in a table of two rows a range.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    order = [F.col("id").desc_nulls_last(), F.col("tie")]
    walked = rows.repartitionByRange(shuffle_width(docs.sparkSession), *order).sortWithinPartitions(*order)
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    made_kinds = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    schema = f"id {kind}, {made_kinds}, end string, text string"
    arrow = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.string()]

    def judge(hasher: Hasher, text: str, print_: str, following: str, next_print: str) -> tuple:
        edited = spliced(text, following)
        other = hasher.fingerprint(edited)
        digest = hashlib.sha256(edited.encode()).hexdigest()
        return len(text), digest, print_, other, hasher.likeness(print_, other), hasher.likeness(print_, next_print)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(bins, bits, shingle)
        before: tuple | None = None
        id_kind = None
        first_sent = False
        for batch in batches:
            id_kind = batch.schema.field("id").type
            out: list[tuple] = []
            for key, value in zip(batch.column("id"), batch.column("text"), strict=True):
                row = (key.as_py(), value.as_py(), None)
                row = (row[0], row[1], hasher.fingerprint(row[1]))
                if not first_sent:
                    out.append((row[0], len(row[1]), None, row[2], None, None, None, "first", row[1]))
                    first_sent = True
                if before is not None:
                    out.append((before[0], *judge(hasher, before[1], before[2], row[1], row[2]), None, None))
                before = row
            yield _batch(out, id_kind)
        if before is not None:
            yield _batch([(before[0], len(before[1]), None, before[2], None, None, None, "last", before[1])], id_kind)

    def _batch(out: list[tuple], id_kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[] for _ in range(9)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [id_kind, *arrow], strict=True)], names=[*names, "end", "text"])

    walk = cut_lineage(walked.mapInArrow(run, schema).withColumn("range", F.spark_partition_id()))
    ends = walk.filter("end IS NOT NULL").select("range", "end", "id", "fingerprint", "text")
    firsts = ends.filter("end = 'first'").select(F.col("range").alias("at"), F.col("fingerprint").alias("next_print"), F.col("text").alias("next_text"))
    # one row a range: ranges in their order, the last one followed by the first
    order_of = firsts.select("at").withColumn("next", F.coalesce(F.lead("at").over(Window.orderBy("at")), F.min("at").over(Window.partitionBy())))
    pairs = ends.filter("end = 'last'").join(order_of, F.col("range") == F.col("at")).drop("at").join(firsts, F.col("next") == F.col("at"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(bins, bits, shingle)
        for batch in batches:
            rows = batch.to_pylist()
            out = [(r["id"], *judge(hasher, r["text"], r["fingerprint"], r["next_text"], r["next_print"]), None, None) for r in rows]
            yield _batch(out, batch.schema.field("id").type).select(names)

    closed = pairs.select("id", "text", "fingerprint", "next_text", "next_print").mapInArrow(close, f"id {kind}, {made_kinds}")
    return walk.filter("end IS NULL").select(*names).unionByName(closed)

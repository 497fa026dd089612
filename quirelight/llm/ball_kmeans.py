"""Vectors as short codes, with codebooks learned by ball k-means.

A vector is scaled to integers and cut into consecutive parts; each part position has a codebook, and a
part's code is its nearest entry.  Rounds of Lloyd's method move the entries.  The first assignment
compares a part with every entry.  From then on an entry and its parts are a ball: its radius bounds how far
its parts are from it, and only entries at most twice the radius away are its neighbours.  A part nearer to its
entry than half way to the nearest neighbour is in the stable core and is done; any other lies in a ring
between the halves of two neighbour distances, and is compared with the neighbours inside that ring only.  All of it
is done on integers, so what is left out can neither be nearer nor tie: codes and errors are exact.

Every pass is a scan: a task adds up its parts by position and entry, and one grouped sum gives the driver
(positions x entries) sums and greatest distances, whatever the number of rows.  Only codebooks and their
neighbour lists, which have that fixed size too, are broadcast.  Hot vectors or labels move no rows.

Defined cases: vectors that are null, or hold a null, a NaN or an infinity, are dropped; so are those of another
length than the one with the smallest id.  Lengths that the number of parts does not divide give the first parts one
component more; empty vectors have the distance zero everywhere.  Of equal ids the lesser vector is first among the starting entries, null ids are last;
fewer vectors than entries give as many entries as there are vectors.  Null labels are one label.  Repeated rows are kept.  Components whose
scaled value passes 2**24 end in a ValueError, as their squares would not be whole in 64 bits.  An empty table gives no rows, and
further columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelight.llm.common import cut_lineage

LARGEST = 1 << 24
#: Bytes of label sums up to which they are broadcast; beyond it, they are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


@dataclass
class Codebooks:
    """Entries of each part position, and what a ball needs to know of its neighbours."""

    edges: list[int]  # where the parts begin, and the end
    entries: list[np.ndarray]  # one (entries, width) array a position
    order: list[list[np.ndarray]] | None = None  # neighbours of each entry, nearest first
    gaps: list[list[np.ndarray]] | None = None  # and the squared distances to them

    def decimals(self) -> str:
        """All components by part, entry and place, joined by commas."""
        return ",".join(str(x) for part in self.entries for x in part.ravel().tolist())

    def parts(self, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for p, entries in enumerate(self.entries):
            yield p, vectors[:, self.edges[p] : self.edges[p + 1]], entries

    def nearest_of_all(self, vectors: np.ndarray) -> np.ndarray:
        """The code of every part, by its distances to all entries."""
        code = np.zeros((len(vectors), len(self.entries)), np.uint8)
        for p, part, entries in self.parts(vectors):
            apart = (entries * entries).sum(axis=1)[None, :] - 2 * (part @ entries.T)
            code[:, p] = apart.argmin(axis=1)  # the first of equals
        return code

    def distances(self, vectors: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Squared distances of all parts to their entries."""
        found = np.zeros(code.shape, np.int64)
        for p, part, entries in self.parts(vectors):
            away = part - entries[code[:, p]]
            found[:, p] = (away * away).sum(axis=1)
        return found

    def reassigned(self, vectors: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distances) after parts have gone to their nearest entries, from the codes before."""
        apart, code = self.distances(vectors, code), code.copy()
        for p, part, entries in self.parts(vectors):
            own, d = code[:, p].astype(np.int64), apart[:, p]
            core = np.array([g[0] if len(g) else np.iinfo(np.int64).max for g in self.gaps[p]])
            ring = np.flatnonzero(4 * d >= core[own])
            if not len(ring):
                continue
            ring = ring[np.argsort(own[ring], kind="stable")]
            present, first = np.unique(own[ring], return_index=True)
            reach = np.zeros(len(ring), np.int64)
            for entry, lo, hi in zip(present, first, [*first[1:], len(ring)], strict=True):
                # the neighbours that half way to is no further than the part's own entry
                reach[lo:hi] = np.searchsorted(self.gaps[p][entry], 4 * d[ring[lo:hi]], side="right")
            ends = np.cumsum(reach)
            row = np.repeat(np.arange(len(ring)), reach)
            place = np.arange(ends[-1]) - np.repeat(ends - reach, reach)
            start = np.cumsum([0, *(len(o) for o in self.order[p])])
            candidate = np.concatenate(self.order[p])[start[own[ring[row]]] + place]
            away = part[ring[row]] - entries[candidate]
            # distance and index in one number: of equal distances the lower index is the least
            key = (away * away).sum(axis=1) * len(entries) + candidate
            best = np.minimum(np.minimum.reduceat(key, ends - reach), d[ring] * len(entries) + own[ring])
            code[ring, p], apart[ring, p] = best % len(entries), best // len(entries)
        return code, apart


def moved(books: Codebooks, sums: list[np.ndarray], counts: np.ndarray, furthest: np.ndarray) -> Codebooks:
    """The codebooks with every used entry at the floor of the mean of its parts, and the neighbours by the new balls.

    A ball's radius is at most the old one and the way that its entry moved.
    """
    entries, order, gaps = [], [], []
    for p, old in enumerate(books.entries):
        new = old.copy()
        used = counts[p] > 0
        new[used] = sums[p][used] // counts[p][used][:, None]
        entries.append(new)
        way = ((new - old) ** 2).sum(axis=1)
        between = ((new[:, None, :] - new[None, :, :]) ** 2).sum(axis=2)
        order.append([])
        gaps.append([])
        for i in range(len(new)):
            radius = math.isqrt(int(furthest[p, i])) + 1 + math.isqrt(int(way[i])) + 1
            near = np.flatnonzero(between[i] <= 4 * radius * radius)
            near = near[near != i]
            near = near[np.argsort(between[i][near], kind="stable")]
            order[p].append(near)
            gaps[p].append(between[i][near])
    return Codebooks(books.edges, entries, order, gaps)


def _finite(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def scaled(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, vector) of the rows that are kept: floor(scale * x) of every component."""
    # a component is a float; doubles hold its product with a power of two exactly
    number = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), number.alias("v")).filter(F.col("v").isNotNull() & _finite(F.col("v")))
    return rows.select("id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("bigint")).alias("vector"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), parts)


def _summed(assigned: DataFrame, books: Codebooks, dim: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(sums, counts, greatest squared distance) by part position and entry, over all rows."""
    shared = assigned.sparkSession.sparkContext.broadcast(books)
    parts, k = len(books.entries), len(books.entries[0])
    widths = np.diff(books.edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        sums = [np.zeros((k, w), np.int64) for w in widths]
        counts, furthest = np.zeros((parts, k), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            vectors, code = _matrix(batch.column("vector"), dim), _codes(batch.column("code"), parts)
            apart = books.distances(vectors, code)
            for p, part, _ in books.parts(vectors):
                counts[p] += np.bincount(code[:, p], minlength=k)
                np.maximum.at(furthest[p], code[:, p], apart[:, p])
                np.add.at(sums[p], code[:, p], part)
        slots, places, values = [], [], []
        for p in range(parts):
            used = np.flatnonzero(counts[p])
            for place, value in ((-2, furthest[p]), (-1, counts[p]), *enumerate(sums[p].T)):
                slots.append(p * k + used)
                places.append(np.full(len(used), place))
                values.append(value[used])
        columns = [pa.array(np.concatenate(x).astype(t)) for x, t in ((slots, np.int32), (places, np.int32), (values, np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["slot", "place", "value"])

    each = assigned.select("vector", "code").mapInArrow(run, "slot int, place int, value bigint")
    total = each.groupBy("slot", "place").agg(F.sum("value").alias("total"), F.max("value").alias("most")).toArrow()
    sums = [np.zeros((k, w), np.int64) for w in widths]
    counts, furthest = np.zeros((parts, k), np.int64), np.zeros((parts, k), np.int64)
    for slot, place, value, most in zip(*(total.column(c).to_pylist() for c in ("slot", "place", "total", "most")), strict=True):
        p, entry = divmod(slot, k)
        if place == -2:
            furthest[p, entry] = most
        elif place == -1:
            counts[p, entry] = value
        else:
            sums[p][entry, place] = value
    return sums, counts, furthest


def _assigned(rows: DataFrame, books: Codebooks, dim: int, errors: bool = False) -> DataFrame:
    """The rows with their codes by these codebooks; with errors, without the vectors but with the squared distances added up."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts = len(books.entries)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            vectors = _matrix(batch.column("vector"), dim)
            if len(vectors) and dim and max(int(vectors.max()), -int(vectors.min())) > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST} once scaled")
            if books.order is None:
                code = books.nearest_of_all(vectors)
                apart = books.distances(vectors, code) if errors else None
            else:
                code, apart = books.reassigned(vectors, _codes(batch.column("code"), parts))
            packed = pa.array([row.tobytes() for row in code], pa.binary())
            if errors:
                columns = {"code": packed, "error": pa.array(apart.sum(axis=1), pa.int64())}
            else:
                columns = {"vector": batch.column("vector"), "code": packed}
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *columns.values()], names=["id", "label", *columns])

    own = "code binary, error bigint" if errors else "vector array<bigint>, code binary"
    return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, {own}")


def compressed(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256
) -> tuple[DataFrame, Codebooks | None]:
    """((id, label, code, error), codebooks): a code has a byte a part; the error is the sum of the squared distances to the last entries.

    At most 256 entries a codebook; these start as the parts of the vectors with the smallest ids.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code of a byte has 256 entries at most")
    rows = scaled(vectors, id_col, vector_col, label_col, scale)
    start = rows.orderBy(F.col("id").asc_nulls_last(), F.col("vector")).limit(1).collect()
    if not start:
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        return rows.sparkSession.createDataFrame([], f"id {kinds['id']}, label {kinds['label']}, code binary, error bigint"), None
    dim = len(start[0]["vector"])
    rows = rows.filter(F.size("vector") == dim)
    first = rows.orderBy(F.col("id").asc_nulls_last(), F.col("vector")).limit(entries).select("vector").collect()
    vectors_of = np.array([r["vector"] for r in first], np.int64).reshape(len(first), dim)
    edges = [0, *np.cumsum([dim // parts + (p < dim % parts) for p in range(parts)]).tolist()]
    books = Codebooks(edges, [vectors_of[:, edges[p] : edges[p + 1]] for p in range(parts)])
    assigned = rows
    for _ in range(rounds):
        assigned = cut_lineage(_assigned(assigned, books, dim))
        books = moved(books, *_summed(assigned, books, dim))
    return cut_lineage(_assigned(assigned, books, dim, errors=True)), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the errors of all rows of the same label added up; null is a label too."""
    sums = cut_lineage(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    size = sums.agg(F.count("*") * 32 + F.coalesce(F.sum(F.octet_length(F.col("_label").cast("string"))), F.lit(0))).first()[0]
    sums = F.broadcast(sums) if size <= BROADCAST_BYTES else sums
    return coded.join(sums, coded["label"].eqNullSafe(sums["_label"])).drop("_label")

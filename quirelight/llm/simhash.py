"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared in groups that lose no link (see links and similar_documents for what makes a
group).  In every group, a fingerprint without another one whose population count is within the radius is
left out.  A group is then cut into tiles of at most `tile` fingerprints: a small group is one tile, a
large one is cut by population count and hash.  Numpy compares tile with tile by exclusive-or and bit
counts; pairs of tiles, and inside tiles pairs of blocks, whose population counts differ by more than the
radius are skipped, as they can't hold a link.  Each comparison returns a spanning forest of its links,
nearest pairs first, never all pairs; components join the forests.

near_duplicates links fingerprints within a radius; equal fingerprints are one node, so copies cost
nothing.  similar_documents links texts by the Jaccard similarity of their distinct shingles; sizes and bitmaps of
the shingles, which lose no pair, screen the pairs there, and an exact check confirms them.

Defined cases: null and empty texts have the fingerprint zero and link like any other (in similar_documents
they are equal to each other and like no other text); texts are read whole, however long; rows with a null
id get a component by the others of their group (null if there are none); repeated rows are kept; an
empty table gives no rows; further columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirelight.llm.common import cut_lineage, freed, shuffle_width
from quirelight.llm.components import component_roots

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SPACES = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})
#: Hashes whose bits are added up at once, for bounded memory on long texts.
_BLOCK = 8192
_MEMO = 50_000
#: Shingles a side that a comparison of whole sets holds on average.
_CELL = 1 << 19
#: Words of 64 bits in the bitmap of a text's shingles, at least.
_BITMAP = 16
#: Bytes of wanted rows up to which they are broadcast; beyond it, they are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def shingle_hashes(text: str, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of `shingle` words, repeats included; of the whole sequence where it is shorter."""
    from xxhash import xxh64_intdigest

    words = [w for w in text.translate(_LOWER).translate(_SPACES).split(" ") if w]
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        shingles = [" ".join(words)]
    else:
        shingles = map(" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.fromiter((xxh64_intdigest(s.encode(), seed) for s in shingles), np.uint64)


def _majority(hashes: np.ndarray) -> int:
    """64 bits, each set where over half the hashes have it; as a signed integer."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = hashes[at : at + _BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def simhash(text: str, shingle: int = 3, seed: int = 42) -> int:
    """64 bits, each set where over half the shingles' XXH64 have it; as a signed integer."""
    return _majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): the SimHash of every row's text."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(t.as_py() or "", shingle, seed) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(found, pa.int64())], names=["id", "fp"])

    return rows.mapInArrow(run, f"id {kind}, fp bigint")


def _masks(blocks: int, radius: int) -> list[int]:
    """The bits of every choice of blocks that must agree, as signed 64-bit numbers."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    chosen = [sum(part[i] for i in c) for c in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in chosen]


def _forest(a: np.ndarray, b: np.ndarray | None, radius: int, rows: int = 1024) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links inside a (b None) or between a and b, as pairs of places in a and b, one after the other.

    Blocks of a meet only those of a or b whose population counts come within the radius.
    """
    n = len(a) if b is None else len(a) + len(b)
    first = np.argsort(np.bitwise_count(a), kind="stable")
    sorted_a, ones_a = a[first], np.bitwise_count(a)[first].astype(np.int64)
    if b is None:
        second, sorted_b, ones_b = first, sorted_a, ones_a
    else:
        second = np.argsort(np.bitwise_count(b), kind="stable")
        sorted_b, ones_b, second = b[second], np.bitwise_count(b)[second].astype(np.int64), second + len(a)
    label, out = np.arange(n), []
    for at in range(0, len(a), rows):
        end = min(at + rows, len(a))
        lo, hi = np.searchsorted(ones_b, [ones_a[at] - radius, ones_a[end - 1] + radius + 1])
        if b is None:
            lo = at  # the pairs before it have been compared
        if lo >= hi:
            continue
        apart = np.bitwise_count(sorted_a[at:end, None] ^ sorted_b[None, lo:hi])
        p, q = np.nonzero(apart <= radius)
        far = apart[p, q]
        i, j = first[p + at], second[q + lo]
        kept = (i != j) if b is not None else (p + at < q + lo)
        i, j, far = i[kept], j[kept], far[kept]
        for step in np.unique(far):  # nearest pairs first
            _join(label, i[far == step], j[far == step], out)
    return out


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray, out: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Merges the trees of i and j in label, and puts the links that did it into out."""
    while len(i):
        p, q = label[i], label[j]
        apart = p != q
        i, j, p, q = i[apart], j[apart], p[apart], q[apart]
        if not len(i):
            break
        high, low = np.maximum(p, q), np.minimum(p, q)
        # every root that links to a smaller one takes one such link, so no cycle can close
        roots, first = np.unique(high, return_index=True)
        out.append((i[first], j[first]))
        label[roots] = low[first]
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def links(nodes: DataFrame, radius: int = 3, blocks: int = 5, tile: int = 2048) -> DataFrame:
    """(a, b): links between the distinct fingerprints in nodes.fp that join all those within the radius.

    Fingerprints within a radius of r bits agree wholly on some choice of (blocks - r) out of `blocks` blocks
    of bits; those that share such a choice are a group.
    """
    masks = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _masks(blocks, radius)])
    return _compared(nodes.select(F.col("fp").alias("node"), "fp", F.posexplode(masks).alias("mask", "part")), radius, tile)


def _compared(members: DataFrame, radius: int, tile: int) -> DataFrame:
    """(a, b): nodes whose links join all fingerprints within the radius in each group, from (mask, part, node, fp); mask and part name the group."""
    cells = _cells(members, radius, tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _whole_cells(batches):
            fp, node, side = (table.column(c).to_numpy() for c in ("fp", "node", "side"))
            values, found = fp.view(np.uint64), []
            starts, ends = np.array(bounds[:-1], np.int64), np.array(bounds[1:], np.int64)
            two = starts[ends - starts == 2]  # by far the most common
            two = two[np.bitwise_count(values[two] ^ values[two + 1]) <= radius]
            if len(two):
                found.append((two, two + 1))
            larger = ends - starts > 2
            for lo, hi in zip(starts[larger].tolist(), ends[larger].tolist(), strict=True):
                cut = lo + int(np.searchsorted(side[lo:hi], 1))
                first, second = values[lo:cut], values[cut:hi]
                found += [(i + lo, j + lo) for i, j in _forest(first, second if len(second) else None, radius)]
            if found:
                pairs = np.sort(np.stack([node[np.concatenate([f[i] for f in found])] for i in (0, 1)]), axis=0)
                pairs = np.unique(pairs, axis=1)  # the same texts share several groups
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], names=["a", "b"])

    return cells.mapInArrow(run, "a bigint, b bigint")


def _cells(members: DataFrame, radius: int, tile: int) -> DataFrame:
    """The members, once for every comparison (mask, part, cell, and side 0 or 1 of it) that they take part in, sorted by these; it holds at most `tile` members a side on average."""
    columns = [c for c in members.columns if c not in ("mask", "part")]
    spread = members.withColumn("ones", F.bit_count("fp").cast("int"))
    per_count = spread.groupBy("mask", "part", "ones").agg(F.count("*").alias("rows"))
    cut = F.struct("ones", "rows", F.ceil(F.col("rows") / tile).cast("int").alias("k"))
    # at most 65 entries a list
    groups = per_count.groupBy("mask", "part").agg(F.sum("rows").alias("size"), F.collect_list(cut).alias("cuts"))
    held = spread.join(groups.filter("size > 1"), ["mask", "part"])
    reach = f"filter(cuts, c -> abs(c.ones - ones) <= {int(radius)})"
    held = held.filter(F.expr(f"aggregate({reach}, 0L, (sum, c) -> sum + c.rows) > 1"))
    alone = held.filter(F.col("size") <= tile).select("mask", "part", F.lit("").alias("cell"), F.lit(0).alias("side"), *columns)
    own = F.expr("filter(cuts, c -> c.ones = ones)[0].k")
    large = held.filter(F.col("size") > tile).withColumn("piece", F.pmod(F.xxhash64("node"), own).cast("int"))
    partners = F.expr(f"flatten(transform({reach}, c -> transform(sequence(0, c.k - 1), p -> struct(c.ones AS ones, p AS piece))))")
    large = large.withColumn("other", F.explode(partners))
    name: Column = F.when(
        F.struct("ones", "piece") <= F.struct("other.ones", "other.piece"),
        F.concat_ws(":", "ones", "piece", "other.ones", "other.piece"),
    ).otherwise(F.concat_ws(":", "other.ones", "other.piece", "ones", "piece"))
    side = (F.struct("ones", "piece") > F.struct("other.ones", "other.piece")).cast("int")
    large = large.select("mask", "part", name.alias("cell"), side.alias("side"), *columns)
    return alone.unionByName(large).repartition(shuffle_width(members.sparkSession), "mask", "part", "cell").sortWithinPartitions("mask", "part", "cell", "side")


def _whole_cells(batches: Iterator[pa.RecordBatch], names: tuple[str, ...] = ("mask", "part", "cell")) -> Iterator[tuple[pa.Table, list[int]]]:
    """Rows of whole comparisons, and the places where each begins, with the end."""
    rest: pa.Table | None = None
    for batch in _then_none(batches):
        table = pa.Table.from_batches([batch]) if batch is not None else None
        if rest is not None:
            table = rest if table is None else pa.concat_tables([rest, table])
        if table is None or not table.num_rows:
            continue
        table = table.combine_chunks()
        new = np.zeros(table.num_rows - 1, bool)
        for name in names:
            own = table.column(name)
            if pa.types.is_string(own.type):
                own = own.dictionary_encode().combine_chunks()
                own = (own.chunk(0) if isinstance(own, pa.ChunkedArray) else own).indices
            own = own.to_numpy()
            new |= own[1:] != own[:-1]
        bounds = [0, *(np.flatnonzero(new) + 1).tolist(), table.num_rows]
        if batch is not None:  # the last cell may go on in the next batch
            rest, bounds = table.slice(bounds[-2]), bounds[:-1]
        yield table, bounds


def _against_others(members: DataFrame, load: Column) -> DataFrame:
    """(part, cell, one, other, ...): the members, from (part, node, root, ...), dealt to comparisons in which those of other roots than a part's most frequent one meet all of it.

    The rest of a part is joined already, so it need not meet itself.  A comparison has a load of about 1 a side; a part within
    that is one comparison, and its rows are there once.  In larger ones, rows are there once for every piece of the other side.
    """
    per_root = members.groupBy("part", "root").agg(F.sum(load).alias("load"), F.count("*").alias("rows"))
    parts = per_root.groupBy("part").agg(F.max_by("root", F.struct("rows", "root")).alias("most"), F.sum("load").alias("all"), F.max_by("load", F.struct("rows", "root")).alias("joined"), F.count("*").alias("roots"))
    parts = parts.filter("roots > 1").withColumns({"k": F.ceil("all").cast("int"), "k_one": F.ceil(F.greatest(F.col("all") - F.col("joined"), F.lit(1e-9))).cast("int")})
    held = members.join(parts.select("part", "most", "k", "k_one"), "part").withColumn("one", F.col("root") != F.col("most"))
    columns = members.columns
    alone = held.filter("k = 1").select(*columns, F.lit(0).alias("cell"), "one", F.lit(True).alias("other"))
    large = held.filter("k > 1").withColumns({"i": F.pmod(F.xxhash64("node"), F.col("k_one")).cast("int"), "j": F.pmod(F.xxhash64("node", F.lit(1)), F.col("k")).cast("int")})
    ones = large.filter("one").select(*columns, F.explode(F.expr("transform(sequence(0, k - 1), x -> i * k + x)")).alias("cell"), "one", F.lit(False).alias("other"))
    others = large.select(*columns, F.explode(F.expr("transform(sequence(0, k_one - 1), x -> x * k + j)")).alias("cell"), F.lit(False).alias("one"), F.lit(True).alias("other"))
    return alone.unionByName(ones).unionByName(others)


def _dealt(cells: DataFrame) -> DataFrame:
    return cells.repartition(shuffle_width(cells.sparkSession), "part", "cell").sortWithinPartitions("part", "cell", F.desc("one"))


def _survivors(members: DataFrame, tile: int, similarity: float, dense: int) -> DataFrame:
    """(a, b, part): nodes of different roots in a part, from (part, node, root, n, bits), that may be alike; or only part, where a comparison has over `dense` such pairs a member."""
    cells = _dealt(_against_others(members, F.lit(1.0 / tile)))
    share = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _whole_cells(batches, ("part", "cell")):
            node, root, n, part = (table.column(c).to_numpy() for c in ("node", "root", "n", "part"))
            bits = table.column("bits").combine_chunks()
            one, other = (table.column(c).to_numpy(zero_copy_only=False) for c in ("one", "other"))
            found, full = [], []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                first, second = lo + np.flatnonzero(one[lo:hi]), lo + np.flatnonzero(other[lo:hi])
                second = second[np.argsort(n[second], kind="stable")]
                first, sizes, own, count = first[np.argsort(n[first], kind="stable")], n[second], [], 0
                for at in range(0, len(first), 256):
                    block = first[at : at + 256]
                    # sets that differ more in size are not alike
                    a, b = np.searchsorted(sizes, [math.ceil(similarity * n[block[0]] - 1e-9), math.floor(n[block[-1]] / similarity + 1e-9) + 1])
                    row, column = block[:, None], second[None, a:b]
                    fits = (root[row] != root[column]) & (np.minimum(n[row], n[column]) >= similarity * np.maximum(n[row], n[column]) - 1e-9)
                    i, j = np.nonzero(fits)
                    i, j = block[i], second[a:b][j]
                    # every shingle that only one of them has changes one bit at most
                    near = _odd_bits(bits, i, j) <= share * (n[i] + n[j]) + 1e-9
                    own.append((i[near], j[near]))
                    count += int(near.sum())
                    if count > dense * (hi - lo):
                        break
                if count > dense * (hi - lo):
                    full.append(int(part[lo]))
                else:
                    found += own
            if found or full:
                pairs = np.zeros((2, 0), np.int64)
                if found:
                    pairs = np.sort(np.stack([node[np.concatenate([x[k] for x in found])] for k in (0, 1)]), axis=0)
                    pairs = np.unique(pairs, axis=1)
                none = [None] * len(full)
                columns = [pa.array([*x.tolist(), *none], pa.int64()) for x in pairs] + [pa.array([None] * pairs.shape[1] + full, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "part"])

    return cells.mapInArrow(freed(run), "a bigint, b bigint, part bigint")


def _like_sets(members: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): nodes whose links join all of a part whose sets are alike, from (part, node, root, n) and (node, text); nodes of one root are joined already.

    Inside a comparison, lists of who has each shingle give the size of the intersection of one set with all others.  Texts are carried, as they are
    smaller than their shingles.
    """
    cells = _dealt(cut_lineage(_against_others(members, F.greatest(F.col("n") / _CELL, F.lit(1.0 / 2048)))).join(texts, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Shingles(shingle)
        for table, bounds in _whole_cells(batches, ("part", "cell")):
            node, root = (table.column(c).to_numpy() for c in ("node", "root"))
            one = table.column("one").to_numpy(zero_copy_only=False)
            text, out = table.column("text"), []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                _, first, of_root = np.unique(root[lo:hi], return_index=True, return_inverse=True)
                if len(first) > 1:
                    own = [np.unique(hashes.of(text[k].as_py())) for k in range(lo, hi)]
                    at = np.cumsum([0, *map(len, own)])
                    found = _like(np.concatenate(own), at, first[of_root], int(np.count_nonzero(one[lo:hi])), similarity)
                    out += [(i + lo, j + lo) for i, j in found]
            if out:
                pairs = np.sort(np.stack([node[np.concatenate([x[k] for x in out])] for k in (0, 1)]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(pairs, axis=1)], names=["a", "b"])

    return cells.mapInArrow(run, "a bigint, b bigint")


def _alike_in_stars(rays: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, other): the rays, and the centres, whose sets of shingles are alike, from (star, centre, node, text); a star's text of the centre comes once.

    A star is read as a stream, its centre first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, star, middle, heart = _Shingles(shingle), None, None, None
        for batch in batches:
            out: tuple[list[int], list[int]] = ([], [])
            for key, centre, node, text in zip(*(batch.column(c).to_pylist() for c in ("star", "centre", "node")), batch.column("text"), strict=True):
                if centre:
                    star, middle, heart = key, node, np.unique(hashes.of(text.as_py()))
                elif star == key:
                    own = np.unique(hashes.of(text.as_py()))
                    common = len(own) + len(heart) - len(np.union1d(own, heart))
                    if common >= similarity * (len(own) + len(heart) - common) - 1e-9:
                        out[0].append(node)
                        out[1].append(middle)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["node", "other"])

    dealt = rays.repartition(shuffle_width(rays.sparkSession), "star").sortWithinPartitions("star", F.desc("centre"), "node")
    return dealt.mapInArrow(freed(run), "node bigint, other bigint")


def _like(shingles: np.ndarray, at: np.ndarray, label: np.ndarray, rows: int, similarity: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join sets by their similarity where their labels differ: set i is shingles[at[i]:at[i+1]]; the first `rows` sets meet all."""
    sizes, out = np.diff(at), []
    _, ids = np.unique(shingles, return_inverse=True)
    who = np.repeat(np.arange(len(sizes)), sizes)[np.argsort(ids, kind="stable")]
    count = np.bincount(ids)
    start = np.cumsum(count) - count
    for i in range(rows):
        mine = ids[at[i] : at[i + 1]]
        each = count[mine]
        lists = np.repeat(start[mine] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        common = np.bincount(who[lists], minlength=len(sizes))
        j = np.flatnonzero((common >= similarity * (sizes[i] + sizes - common) - 1e-9) & (label != label[i]))
        if len(j):
            _join(label, np.full(len(j), i), j, out)
    return out


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, blocks: int = 5, tile: int = 2048
) -> DataFrame:
    """(id, fp, component): component is the smallest id that links reach, its own included."""
    prints = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = component_roots(links(nodes.select("fp"), radius, blocks, tile))
    joined = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("least").alias("component"))
    of_print = joined.select("fp", "root").join(least, "root").select("fp", "component")
    return prints.join(of_print, "fp", "left").select("id", "fp", "component")


class _Shingles:
    """Hashes of runs of words, mixed from the hashes of the words, which a bounded memo keeps; one a task."""

    def __init__(self, size: int):
        from xxhash import xxh64_intdigest

        self.size, self._hash, self._known = size, xxh64_intdigest, {}

    def of(self, text: str | None) -> np.ndarray:
        """A hash for every run, repeats included; of the whole sequence where it is shorter; words are cut and lower-cased as in shingle_hashes."""
        words, known = (text or "").encode().lower().split(), self._known
        if not words:
            return np.zeros(0, np.uint64)
        if len(known) > _MEMO:
            known.clear()
        for word in set(words).difference(known):
            known[word] = self._hash(word)
        each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.size, len(each))
        mixed = np.full(len(each) - n + 1, n, np.uint64)
        for i in range(n):
            mixed = (mixed ^ each[i : i + len(mixed)]) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
        return mixed


def _bucket_counts(texts: DataFrame, shingle: int, buckets: int) -> DataFrame:
    """(bucket, n): how many texts' shingles fall in each of `buckets` buckets of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, n, hashes = np.zeros(buckets, np.int64), [], 0, _Shingles(shingle)
        for batch in batches:
            for text in batch.column("text"):
                held.append((np.unique(hashes.of(text.as_py())) % np.uint64(buckets)).astype(np.int64))
                n += len(held[-1])
                if n > 4 * buckets:
                    seen += np.bincount(np.concatenate(held), minlength=buckets)
                    held, n = [], 0
        if held:
            seen += np.bincount(np.concatenate(held), minlength=buckets)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(freed(run), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def _bitmap(own: np.ndarray, least: int = _BITMAP) -> np.ndarray:
    """Whether an odd number of shingles fell on each bit; at least as many bits as shingles, and a power of two."""
    words = max(least, 1 << max(0, (len(own) - 1) // 64).bit_length())
    mixed = (own ^ (own >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    odd = np.bincount((mixed >> np.uint64(32)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _odd_bits(bits: pa.Array, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits the bitmaps of rows i and j differ; a longer one is folded first, which gives the bitmap of that length."""
    bits = bits.combine_chunks() if isinstance(bits, pa.ChunkedArray) else bits
    flat, ends = bits.values.to_numpy().view(np.uint64), bits.offsets.to_numpy().astype(np.int64)
    words = np.diff(ends)
    found, width = np.zeros(len(i), np.int64), np.minimum(words[i], words[j])
    for w in np.unique(width):
        pairs = np.flatnonzero(width == w)
        rows, at = np.unique(np.concatenate([i[pairs], j[pairs]]), return_inverse=True)
        folded = np.empty((len(rows), w), np.uint64)
        same = words[rows] == w
        folded[same] = flat[ends[rows[same]][:, None] + np.arange(w)]
        for k in np.flatnonzero(~same):
            folded[k] = np.bitwise_xor.reduce(flat[ends[rows[k]] : ends[rows[k] + 1]].reshape(-1, w), axis=0)
        for lo in range(0, len(pairs), 65536):
            part = slice(lo, lo + 65536)
            one, two = at[: len(pairs)][part], at[len(pairs) :][part]
            found[pairs[part]] = np.bitwise_count(folded[one] ^ folded[two]).sum(axis=1, dtype=np.int64)
    return found


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, tile: int = 2048, dense: int = 8, buckets: int = 1 << 17
) -> DataFrame:
    """(id, component): the components of similar_rows."""
    return similar_rows(docs, id_col, text_col, shingle, similarity, tile, dense, buckets).select("id", "component")


def similar_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, tile: int = 2048, dense: int = 8, buckets: int = 1 << 17
) -> DataFrame:
    """(id, component, text_hash, root): component is the smallest id that links reach, its own included; texts link where the Jaccard
    similarity of their distinct shingles is `similarity` or more.  text_hash is the XXH64 of the text, and root tells components without an id apart.

    Two such texts share a shingle among the first n - ceil(similarity n) + 1 of each, in any one order of all
    shingles; those that share one are a part.  The order is from rare to frequent (by counts of `buckets`
    buckets, a table of fixed size), so passages that many texts hold make no large parts; of parts with the same members, one is kept.

    A pair can be alike only if its numbers of shingles differ by no more than that ratio, and if the bitmaps of their shingles differ in no more bits than
    shingles may be in one text only.  Neither loses a pair.

    First every text meets the one that it shares most parts with among the least of each part in a random order, and where a part still has several components, the
    same in two other orders; components of the links that the exact check confirms are joined.  That leaves few parts with several components; there,
    the texts outside a part's largest component meet all of it in tiles, and the pairs that may be alike go to the exact check.  Where these are over `dense` a text,
    whole sets of shingles are compared inside the tiles instead, which are bounded by their shingles too.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = cut_lineage(_bucket_counts(rows, shingle, buckets))
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / buckets
    # of buckets that are fuller than most, how many times: a byte each
    full = counts.filter(F.col("n") > 2 * mean).toArrow()
    rank = np.zeros(buckets, np.uint8)
    rank[full.column("bucket").to_numpy()] = np.log2(full.column("n").to_numpy() / max(mean, 1e-9)).astype(np.uint8)
    shared = spark.sparkContext.broadcast(rank)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ranks = _Shingles(shingle), shared.value
        for batch in batches:
            keys, bitmaps, sizes, prefixes = [], [], [], []
            for text in batch.column("text"):
                own = np.unique(hashes.of(text.as_py()))
                keys.append(blake2b(own.tobytes(), digest_size=16).digest())
                bitmaps.append(_bitmap(own))
                sizes.append(len(own))
                order = np.argsort(ranks[(own % np.uint64(buckets)).astype(np.int64)], kind="stable")
                prefixes.append(own[order[: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1]].view(np.int64))
            columns = [batch.column("id"), batch.column("text_hash"), pa.array(keys, pa.binary()), pa.array(bitmaps, pa.list_(pa.int64())), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text_hash", "key", "bits", "n", "prefix"])

    schema = f"id {kind}, text_hash bigint, key binary, bits array<bigint>, n int, prefix array<bigint>"
    prints = cut_lineage(rows.select("id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(freed(run), schema))
    same = [F.any_value(c).alias(c) for c in ("bits", "n")]
    # one row stands for all with the same shingles; copies of it, id and all, are read once more where they are
    row = F.min(F.struct("text_hash", F.col("id").alias("row_id"))).alias("row")
    nodes = prints.groupBy("key").agg(F.min("id").alias("least"), row, *same).select("key", "least", "row.*", "bits", "n")
    nodes = cut_lineage(nodes.withColumn("node", F.monotonically_increasing_id()))
    facts = nodes.select("node", "n", "bits")

    def at_rows(table: DataFrame, wanted: DataFrame) -> DataFrame:
        """table (with id and text_hash) where one of the rows wanted (node, ...) stands, with its columns."""
        wanted = cut_lineage(wanted.join(nodes.select("node", "row_id", F.col("text_hash").alias("_hash")), "node"))
        wanted = F.broadcast(wanted) if wanted.count() * 48 <= BROADCAST_BYTES else wanted
        return table.join(wanted, (F.col("text_hash") == F.col("_hash")) & F.col("id").eqNullSafe(F.col("row_id"))).drop("id", "text_hash", "_hash", "row_id")

    texts = rows.withColumn("text_hash", F.xxhash64("text"))
    # most shingles are in one text only; the others are a small share, and many of those have the same members
    members = at_rows(prints.select("id", "text_hash", "prefix"), nodes.select("node")).select(F.explode("prefix").alias("part"), "node")
    size = F.count("*").over(Window.partitionBy("part"))
    # a row that stands there more than once has its shingles more than once
    parts = cut_lineage(members.withColumn("size", size).filter("size > 1").select("part", "node").distinct())
    digests = [F.expr(f"bit_xor(xxhash64(node, {k}))").alias(f"digest_{k}") for k in (0, 1)]
    several = parts.groupBy("part").agg(F.count("*").alias("size"), *digests).groupBy("size", "digest_0", "digest_1").agg(F.min("part").alias("part"))
    parts = cut_lineage(parts.join(several.select("part"), "part", "left_semi"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (node, other) whose sets are alike; each side of a pair is read with its text, in stars of at most some hundred rays round `other`."""
        sizes = pairs.groupBy("other").agg(F.ceil(F.count("*") / 256).cast("int").alias("k"))
        dealt = cut_lineage(pairs.join(sizes, "other").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("k"))))
        star = F.struct("other", "salt").alias("star")
        rays = dealt.select(star, F.lit(False).alias("centre"), "node").unionByName(dealt.select(star, F.lit(True).alias("centre"), F.col("other").alias("node")).distinct())
        return cut_lineage(_alike_in_stars(at_rows(texts, rays.select("star.*", "centre", "node")).select(F.concat_ws(":", "other", "salt").alias("star"), "centre", "node", "text"), shingle, similarity).distinct())

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, n = batch.num_rows, [batch.column(f"{side}_n").to_numpy() for side in ("node", "other")]
            both = pa.concat_arrays([batch.column("node_bits"), batch.column("other_bits")])
            near = _odd_bits(both, np.arange(k), np.arange(k, 2 * k)) <= (1 - similarity) / (1 + similarity) * (n[0] + n[1]) + 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near)) for c in ("node", "other")], names=["node", "other"])

    def may_be_alike(pairs: DataFrame) -> DataFrame:
        """The pairs (node, other) that sizes and bitmaps leave."""
        for side in ("node", "other"):
            pairs = pairs.join(facts.select(*[F.col(c).alias(side if c == "node" else f"{side}_{c}") for c in facts.columns]), side)
        fits = F.least("node_n", "other_n") >= similarity * F.greatest("node_n", "other_n") - 1e-9
        return cut_lineage(pairs.filter(fits).select("node", "other", "node_n", "other_n", "node_bits", "other_bits").mapInArrow(weighed, "node bigint, other bigint"))

    def met(members: DataFrame, orders: range) -> DataFrame:
        """(node, other): of the members (part, node, root), each with those of other roots that are the least, in a random order, of most of its parts."""
        least = [F.min(F.struct(F.xxhash64("node", F.lit(k)), "node", "root")).alias(f"p{k}") for k in orders]
        each = members.join(members.groupBy("part").agg(*least), "part").select("node", "root", F.posexplode(F.array(*[f"p{k}" for k in orders])).alias("order", "p"))
        times = each.filter("root != p.root").groupBy("node", "order", F.col("p.node").alias("other")).agg(F.count("*").alias("times"))
        return times.groupBy("node", "order").agg(F.max_by("other", F.struct("times", "other")).alias("other")).select("node", "other").distinct()

    def mixed_parts(roots: DataFrame) -> DataFrame:
        """(part, node, root) of the parts whose members have several roots."""
        found = parts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = found.groupBy("part").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
        return cut_lineage(found.join(mixed.select("part"), "part", "left_semi").select("part", "node", "root"))

    # every text is joined to one other at most, so these links are trees; some steps up bring most texts of a tree together
    links = confirmed(may_be_alike(met(parts.withColumn("root", F.col("node")), range(1))))
    roots = links.withColumnRenamed("other", "root")
    for _ in range(3):
        roots = cut_lineage(roots.join(roots.select(F.col("node").alias("root"), F.col("root").alias("_up")), "root", "left").select("node", F.coalesce("_up", "root").alias("root")))
    left, done = mixed_parts(roots), False
    if not left.isEmpty():
        links = cut_lineage(links.unionByName(confirmed(may_be_alike(met(left, range(1, 3))))))
        roots = component_roots(links, "node", "other")
        left, done = mixed_parts(roots), True
    if not left.isEmpty():
        found = cut_lineage(_survivors(left.join(facts, "node"), tile, similarity, dense))
        more = confirmed(found.filter("part IS NULL").select(F.col("a").alias("node"), F.col("b").alias("other")).distinct())
        links = cut_lineage(links.unionByName(more))
        dense_parts, done = cut_lineage(found.filter("part IS NOT NULL").select("part").distinct()), more.isEmpty()
        if not dense_parts.isEmpty():
            left = mixed_parts(component_roots(links, "node", "other")).join(dense_parts, "part", "left_semi")
            wanted = at_rows(texts, left.select("node").distinct()).dropDuplicates(["node"])
            more = _like_sets(left.join(facts.select("node", "n"), "node"), wanted, shingle, similarity).withColumnsRenamed({"a": "node", "b": "other"})
            links, done = cut_lineage(links.unionByName(more)), False
    roots = roots if done else component_roots(links, "node", "other")
    joined = nodes.select("key", "node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = joined.groupBy("root").agg(F.min("least").alias("component"))
    return prints.select("id", "text_hash", "key").join(joined.join(smallest, "root").select("key", "component", "root"), "key").select("id", "component", "text_hash", "root")

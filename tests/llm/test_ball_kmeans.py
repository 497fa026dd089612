"""Codes by ball k-means against every part with every entry."""

import hashlib
import math
import random

import numpy as np
import pytest

from quirelight.llm import ball_kmeans, queries


def plain(rows, parts=16, entries=64, rounds=2):
    """(id, label) with code and error, and the digest of the codebooks, by comparing all with all."""
    kept = [(i, e, lab) for i, e, lab in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    ints = [[math.floor(256 * x) for x in e] for _, e, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, ints[k]))
    w = len(ints[0]) // parts
    cut = lambda v: [tuple(v[p * w : p * w + w]) for p in range(parts)]
    books = [[cut(ints[k])[p] for k in order[:entries]] for p in range(parts)]

    def assign():
        found = []
        for v in ints:
            best = [min((sum((a - b) ** 2 for a, b in zip(part, c, strict=True)), i) for i, c in enumerate(book)) for part, book in zip(cut(v), books, strict=True)]
            found.append(best)
        return found

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for i in range(len(books[p])):
                own = [cut(v)[p] for v, c in zip(ints, codes, strict=True) if c[p][1] == i]
                if own:
                    books[p][i] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    codes = assign()
    out = sorted((str(k[0]), str(k[2]), "".join(f"{c[1]:02x}" for c in code), sum(c[0] for c in code)) for k, code in zip(kept, codes, strict=True))
    return out, hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()


def test_query_against_all_distances(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, [rng.choice((-1, 0, 1)) * 0.5 + rng.gauss(0, 0.1) for _ in range(32)], rng.choice((None, 1, 2, 3))) for i in range(400)]
    rows += [(500 + i, rows[7][1], 1) for i in range(40)]  # many copies
    rows += [(600, None, 1), (601, [None] * 32, 2), (602, [math.nan] + [0.0] * 31, 2), (603, [0.0] * 31 + [math.inf], None), (None, rows[3][1], None), (3, rows[9][1], 2)]
    rows += [(700 + i, [0.25 * ((i + k) % 3) for k in range(32)], 3) for i in range(30)]  # ties
    odd = [(*r, "x") for r in rows]
    spark.createDataFrame(odd, "vec_id long, embedding array<float>, label int, code string").write.parquet(f"{tmp_path}/embeddings.parquet")
    exact = [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e], lab) for i, e, lab in rows]
    expected, digest = plain(exact)
    found = queries.op11_vector_codes(spark, str(tmp_path)).collect()
    label = {}
    for i, e, lab in exact:
        label.setdefault(str(i), set()).add(str(lab))
    assert sorted((str(r.vec_id), r.code, r.error) for r in found) == sorted((i, code, error) for i, _, code, error in expected)
    assert {r.codebooks_sha256 for r in found} == {digest}
    totals = {}
    for _, lab, _, error in expected:
        totals[lab] = totals.get(lab, 0) + error
    assert all(r.label_error in {totals[lab] for lab in label[str(r.vec_id)]} for r in found)
    assert len({r.label_error for r in found}) == len(totals)


def test_rings_leave_out_only_what_is_no_nearer():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-40, 40, (3000, 8))
    books = ball_kmeans.Codebooks([0, 4, 8], [vectors[:30, :4].copy(), vectors[:30, 4:].copy()])
    code = books.nearest_of_all(vectors)
    for _ in range(4):
        apart = books.distances(vectors, code)
        sums, counts, furthest = [np.zeros((30, 4), np.int64) for _ in range(2)], np.zeros((2, 30), np.int64), np.zeros((2, 30), np.int64)
        for p, part, _ in books.parts(vectors):
            np.add.at(sums[p], code[:, p], part)
            counts[p] = np.bincount(code[:, p], minlength=30)
            np.maximum.at(furthest[p], code[:, p], apart[:, p])
        books = ball_kmeans.moved(books, sums, counts, furthest)
        code, apart = books.reassigned(vectors, code)
        assert (code == books.nearest_of_all(vectors)).all()
        assert (apart == books.distances(vectors, code)).all()


def test_stable_cores_and_rings_skip_work():
    """Clusters far apart have no neighbours; so no part is compared with any other entry."""
    centres = np.array([[0, 0], [1000, 0], [0, 1000]])
    vectors = np.concatenate([c + np.array([[i % 5, i % 3] for i in range(50)]) for c in centres])
    books = ball_kmeans.Codebooks([0, 2], [centres])
    code = books.nearest_of_all(vectors)
    apart = books.distances(vectors, code)
    furthest = np.array([[int(apart[code[:, 0] == i].max()) for i in range(3)]])
    sums = [np.array([vectors[code[:, 0] == i].sum(axis=0) for i in range(3)])]
    after = ball_kmeans.moved(books, sums, np.array([[50, 50, 50]]), furthest)
    assert all(len(near) == 0 for near in after.order[0])


def test_empty_few_and_odd_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    coded, books = ball_kmeans.compressed(spark.createDataFrame([], kind))
    assert coded.count() == 0 and books is None
    coded, books = ball_kmeans.compressed(spark.createDataFrame([(1, None, 1), (2, [math.nan], 1)], kind))
    assert coded.count() == 0 and books is None
    coded, books = ball_kmeans.compressed(spark.createDataFrame([(1, [0.5, 1.0, 2.0], 1), (2, [0.5, 1.0, 2.0], None), (3, [1.0], 1)], kind), parts=2)
    assert [(r.id, bytes(r.code), r.error) for r in coded.orderBy("id").collect()] == [(1, b"\0\0", 0), (2, b"\0\0", 0)]
    with pytest.raises(Exception, match="once scaled"):
        ball_kmeans.compressed(spark.createDataFrame([(1, [1e30], 1)], kind))

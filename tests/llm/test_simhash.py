"""Fingerprints and components against plain versions over all pairs."""

import random
from pathlib import Path

import pytest
from xxhash import xxh64_intdigest

from quirelight.llm.common import shared_folder
from quirelight.llm.components import component_roots
from quirelight.llm.simhash import near_duplicates, similar_documents


def plain_print(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdeÉß", k=rng.randint(1, 6)))
    out = [None, "", " \n", "one", "One", "two words"]
    for _ in range(25):
        base = [word() for _ in range(rng.randint(40, 400))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):  # copies of copies, so that components are chains
            base[rng.randrange(len(base))] = word()
            out.append(" ".join(base))
    return out + out[-3:]


@pytest.mark.parametrize("tile", [3, 2048])
def test_components_are_those_of_all_pairs(spark, tile):
    rows = list(enumerate(texts(), 100))
    prints = {i: plain_print(t) for i, t in rows}
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3 and top(i) != top(j):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile).collect()
    assert {r.id: r.fp & (1 << 64) - 1 for r in found} == prints
    assert {r.id: r.component for r in found} == {i: top(i) for i in prints}
    assert 5 < len({top(i) for i in prints}) < len(prints) - 10


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def jaccard_components(rows, size, least):
    """Components over all pairs of texts."""
    sets = {}
    for i, text in rows:
        words = (text or "").lower().split()
        sets[i] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            same = sets[i] == sets[j] or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]))
            if i < j and same and top(i) != top(j):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in sets}


@pytest.mark.parametrize(("tile", "dense"), [(3, 8), (2048, 8), (2048, 0)])
def test_similar_documents_are_those_of_all_pairs(spark, tile, dense):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcde", k=rng.randint(1, 6)))
    passage = [word() for _ in range(60)]
    out = [None, "", " \n", "one", "One", "two words", "a b c d e", "a b c d e f"]
    for k in range(40):
        base = [word() for _ in range(rng.randint(30, 200))]
        base = passage + base if k % 2 else base  # a passage that half of all texts hold
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            for _ in range(rng.randint(1, 4)):
                base[rng.randrange(len(base))] = word()
            out.append(" ".join(base))
    rows = list(enumerate(out + out[-2:], 100))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, node int")
    found = {r.id: r.component for r in similar_documents(docs, tile=tile, dense=dense).collect()}
    want = jaccard_components(rows, 5, 0.8)
    assert found == want
    assert 5 < len(set(want.values())) < len(want) - 10


@pytest.mark.parametrize("tile", [16, 2048])
def test_links_behind_nearer_pairs_that_fail(spark, tile):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(90)]
    out = []
    for _ in range(140):  # one large group, with similarities on both sides of 0.8
        text = list(base)
        for at in rng.sample(range(20, 90, 5), rng.randint(1, 4)):
            text[at] = rng.choice("xyz")
        out.append(" ".join(text))
    rows = list(enumerate(out))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.id: r.component for r in similar_documents(docs, tile=tile, dense=0).collect()}
    assert found == jaccard_components(rows, 5, 0.8)


def test_repeated_lines_do_not_hide_similar_texts(spark):
    """Links go by distinct runs, so what a text repeats has no more weight than once."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = " ".join(word() for _ in range(300))
    out = [base, base + " foo" * 1500, base + " bar" * 1500]
    for _ in range(60):
        shared = [word() for _ in range(200)]
        for _ in range(2):
            line = " ".join(word() for _ in range(8))
            out.append(" ".join([*shared, *[line] * 40]))
    rows = list(enumerate(out))
    found = {r.id: r.component for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {0: 0, 1: 0, 2: 0} | {i: i - (i + 1) % 2 for i in range(3, 123)}


def test_no_screen_loses_a_pair(spark):
    """Four of five shingles are shared, while the texts' SimHashes differ in 39 of 64 bits."""
    text = "w958 w763 w1669 w918 w1085 w808 w1319 w839"
    docs = spark.createDataFrame([(1, text), (2, f"{text} x11022"), (3, "w958 w763 w1669")], "doc_id long, text string")
    assert {r.id: r.component for r in similar_documents(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_one_text_and_many_chains(spark):
    """Components that only a way over many links joins, in one part."""
    base = [f"w{k}" for k in range(100)]
    out = []
    for step in range(0, 60, 2):
        out.append(" ".join([*(f"v{k}" for k in range(step)), *base[step:]]))
    rows = list(enumerate(out))
    found = {r.id: r.component for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), tile=4).collect()}
    assert found == jaccard_components(rows, 5, 0.8)


def test_similar_documents_without_ids_or_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "A b"), (None, "c")], "doc_id long, text string")
    assert sorted(map(str, ((r.id, r.component) for r in similar_documents(docs).collect()))) == ["(3, 3)", "(None, 3)", "(None, 3)", "(None, None)"]
    assert similar_documents(docs.limit(0)).count() == 0


def test_population_counts_only_skip_what_cannot_link():
    import numpy as np

    from quirelight.llm.simhash import _forest

    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(1 << 40), rng.integers(0, 1 << 8, 30, dtype=np.uint64)])
    rng.shuffle(near)
    for a, b in ((near, None), (near[:70], near[70:])):
        whole = a if b is None else np.concatenate([a, b])
        for rows in (7, 1024):
            root = list(range(len(whole)))

            def top(i, root=root):
                while root[i] != i:
                    i = root[i]
                return i

            for i, j in ((int(i), int(j)) for x in _forest(a, b, 3, rows) for i, j in zip(*x, strict=True)):
                assert (int(whole[i]) ^ int(whole[j])).bit_count() <= 3
                assert top(i) != top(j)  # a forest
                root[top(i)] = top(j)
            for i in range(len(whole)):
                for j in range(i):
                    if (int(whole[i]) ^ int(whole[j])).bit_count() <= 3 and (b is None or (j < len(a)) != (i < len(a))):
                        assert top(i) == top(j)


def test_rounds_over_few_links_take_few_tasks(spark):
    links = [(0, k) for k in range(1, 40)] + [(k, k + 1) for k in range(100, 160)]
    width, merged = (spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"))
    spark.conf.set("spark.sql.shuffle.partitions", 37)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        roots = component_roots(spark.createDataFrame(links, "a long, b long"))
        found = sorted(map(tuple, roots.collect()))
        folders = sorted(Path(shared_folder(spark).removeprefix("file:")).glob("rdd-*"), key=lambda f: int(f.name[4:]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
    assert found == [(k, 0) for k in range(40)] + [(k, 100) for k in range(100, 161)]
    # every task of a shuffle leaves files, so a round's links lie in no more parts than there are cores
    assert len(list(folders[-1].glob("part-*"))) <= spark.sparkContext.defaultParallelism

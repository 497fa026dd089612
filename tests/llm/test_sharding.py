"""Sharding against a heap that takes the groups one by one."""

import heapq
import random
import zlib
from collections import defaultdict

from quirelight.llm.sharding import lay_out, shard_documents


def one_by_one(sizes, shards):
    heap = [(0, s) for s in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, s = heap[0]
        heapq.heapreplace(heap, (load + size, s))
    return sorted(load for load, _ in heap)


def test_levels_give_the_loads_of_the_heap():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.choice((1, 2, 7, 7, 7, 30, 1000)) for _ in range(rng.randint(0, 400))]
        shards = rng.randint(1, 9)
        classes = [(s, sizes.count(s), s * sizes.count(s)) for s in sorted(set(sizes), reverse=True)]
        taken = lay_out(classes, shards)
        loads = [sum(k * n[s] for k, n in taken.items()) for s in range(shards)]
        assert sorted(loads) == one_by_one(sizes, shards)
        assert all(sum(taken[k]) == c for k, c, _ in classes)


def test_groups_stay_together_and_slots_have_no_gaps(spark):
    rng = random.Random(5)
    texts = ["x" * rng.randint(0, 60) for _ in range(300)] + ["hot text"] * 200 + [None, "", "é" * 20000]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "x", 1), (3, texts[3], 1)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string, shard long"), shards=5).collect()
    assert len(got) == len(rows)
    by_text, slots, loads = defaultdict(set), defaultdict(list), defaultdict(int)
    for r in got:
        by_text[r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = defaultdict(int)
    for _, t, _ in rows:
        sizes[t or ""] += len((t or "").encode()) + 8
    assert sorted(loads.values()) == one_by_one(sizes.values(), 5)
    row = next(r for r in got if r.id == len(texts) - 1)
    assert (row.size, row.text_crc32) == (40008, zlib.crc32(("é" * 20000).encode()))


def test_empty_table(spark):
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0

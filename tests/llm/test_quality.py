"""The factorisation machine: its identity, held-out accuracy and edge cases."""

import random
import zlib

import numpy as np

from quirelight.llm.quality import Features, fit, learn, with_scores


def corpus(n, seed):
    rng = random.Random(seed)
    good = [f"{a}{b}" for a in ("lo", "ra", "mi", "tes", "quo") for b in ("rem", "ton", "la", "sit", "ne", "dor")]
    rows = []
    for i in range(n):
        words = rng.choices(good, k=rng.randint(3, 80))
        label = i % 4 > 0
        if not label:
            words = rng.choice([[w.upper() + "!!" for w in words], [f"{w}$$$" for w in words], [words[0]] * len(words)])
        rows.append((i, " ".join(words), int(label)))
    return rows


def test_score_is_the_sum_over_all_pairs():
    rows, features = corpus(60, 1), Features(64)
    data = [features.of(t) for _, t, _ in rows]
    machine = fit(data, np.array([float(y) for _, _, y in rows]), buckets=64, epochs=2)
    at, value = machine.row(*data[0])
    z = machine.bias + sum(machine.linear[i] * x for i, x in zip(at, value, strict=True))
    z += sum(machine.vectors[at[i]] @ machine.vectors[at[j]] * value[i] * value[j] for i in range(len(at)) for j in range(i))
    assert abs(machine.score(at, value) - 1 / (1 + np.exp(-z))) < 1e-9


def test_held_out_accuracy_and_edge_cases(spark):
    rows = corpus(600, 2)
    extra = [(None, "no id", None), (9001, None, None), (9002, "", None), (9003, "w " * 40000, None), (5, rows[5][1], None)]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(i, t, "s") for i, t, _ in extra], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(7, None), (None, 1), (123456, 0)], "doc_id long, quality int")
    got = with_scores(docs, learn(docs, labels)).collect()
    assert len(got) == 605 and all(0 <= r.score <= 1 for r in got)
    held = [(r.score >= 0.3) == bool(rows[r.doc_id][2]) for r in got if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean(held) > 0.95
    again = {r.doc_id: r.score for r in with_scores(docs, learn(docs.repartition(7), labels)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-12 for r in got)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert with_scores(docs, learn(docs, none)).first().score == 0.5
    assert with_scores(docs.limit(0), learn(docs.limit(0), none)).count() == 0


def test_memo_of_words_stays_small():
    features = Features()
    texts = [" ".join(f"w{i}" for i in range(k, k + 100)) for k in range(0, 120_000, 100)]
    found = [features.of(t)[0].tolist() for t in texts]
    assert len(features._known) <= 50_000 + 100
    assert found[0] == Features().of(texts[0])[0].tolist() == features.of(texts[0])[0].tolist()

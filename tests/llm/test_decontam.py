"""Decontamination against a plain search for windows."""

import random
import re

from quirelight.llm.decontam import Index, contamination, proximity_matches


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def plain(docs, items, window):
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for item, item_text in items:
            it = words(item_text)
            size = min(window, len(it))
            for k in range(max(0, len(it) - size + 1) if it else 0):
                for at in range(len(own) - size + 1):
                    if own[at : at + size] == it[k : k + size]:
                        hit |= set(range(at, at + size))
                        found.add(str(item))
        out.append((doc_id, len(own), len(hit), sorted(found)))
    return sorted(out, key=str)


def test_windows_are_those_of_a_plain_search(spark):
    rng = random.Random(11)
    vocabulary = ["the", "of", "Ä", "ß9", "éclair", "x", "y", "z1", "Q", "tail"] + [f"w{i}" for i in range(30)]
    text = lambda n: rng.choice([" ", ", ", "--"]).join(rng.choices(vocabulary, weights=[20, 15] + [2] * 38, k=n))
    items = [(i, text(rng.randint(3, 25))) for i in range(12)] + [(12, None), (13, "..."), (14, "the of"), (14, "the the the"), (None, "x y z1")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)]
    for i in range(40, 70):  # passages of items, whole and in part, repeated too
        part = words(rng.choice(items[:12])[1])
        at = rng.randint(0, len(part) // 2)
        docs.append((i, f"{text(5)} {' '.join(part[at : at + 14]).upper() if rng.random() < 0.5 else ' '.join(part)} {text(4)} {' '.join(part[:6])}"))
    docs += [(70, None), (71, ""), (5, "the of the of"), (5, docs[45][1]), (5, docs[45][1]), (None, docs[50][1])]
    named = [(d, t, "k", 1) for d, t in docs]
    left = spark.createDataFrame(named, "doc_id long, text string, words string, doc int")
    right = spark.createDataFrame([(i, t, "k") for i, t in items], "item_id long, text string, term string")
    for window in (10, 4):
        got = contamination(left, right, window=window).collect()
        # ids of items that are null have no string and are not listed
        want = plain(docs, [(i, t) for i, t in items if i is not None], window)
        got = sorted([(r.id, r.n_words, r.n_hit, r["items"]) for r in got], key=str)
        without = plain(docs, items, window)
        assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want]
        assert [g[2] for g in got] == [w[2] for w in without]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.id, r.n_words, r.n_hit, r.n_items) for r in contamination(docs, none).collect()] == [(1, 3, 0, 0)]
    assert contamination(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_proximity_needs_the_rarest_terms_near_each_other(spark):
    filler = " ".join(["lorem"] * 30)
    docs = [(1, f"gamma x beta y alpha {filler}"), (2, f"alpha {filler} beta {filler} gamma"), (3, f"{filler} beta alpha lorem gamma"), (4, None)]
    index = Index(
        spark.createDataFrame(docs, "id long, text string"),
        spark.createDataFrame([(7, "lorem alpha lorem beta lorem gamma lorem")], "item long, text string"),
        "id", "text", "item", "text", 10,
    )
    found = proximity_matches(index, terms=3, within=5).join(index.docs, "doc").collect()
    assert sorted((r.id, r["item"]) for r in found) == [(1, 7), (3, 7)]

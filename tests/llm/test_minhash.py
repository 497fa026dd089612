"""MinHash likeness against true shares of shingles, and neighbours against a plain walk."""

import hashlib
import random

import numpy as np

from quirelight.llm.minhash import Hasher, fingerprints, neighbour_likeness


def test_likeness_is_unbiased_and_densified_bins_agree():
    rng = random.Random(4)
    hasher = Hasher()
    for n, share in ((40, 0.5), (400, 0.5), (400, 0.0), (1500, 0.8)):
        errors = []
        for _ in range(40):
            words = [str(rng.getrandbits(40)) for _ in range(2 * n)]
            cut = int(n * (2 * share / (1 + share)))
            a, b = " ".join(words[:n]), " ".join(words[:cut] + words[n : 2 * n - cut])
            x, y = set(hasher.shingles(a).tolist()), set(hasher.shingles(b).tolist())
            errors.append(hasher.likeness(hasher.fingerprint(a), hasher.fingerprint(b)) - len(x & y) / len(x | y))
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.12
    one = hasher.bins_of("a single shingle")
    assert len(set(one.tolist())) == 1
    assert hasher.fingerprint("  ") == "" and hasher.likeness("", "") == 1 and hasher.likeness("", hasher.fingerprint("a")) == 0


def test_neighbours_follow_by_falling_id(spark):
    rng = random.Random(9)
    word = lambda: rng.choice(["über", "a", "bb", "c\n", "🙂"]) + str(rng.randint(0, 50))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60))), 1) for i in rng.sample(range(1000), 90)]
    rows += [(5000, None, 1), (5001, "", 1), (None, "no id", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, range int").repartition(5)
    got = {r.id: r for r in neighbour_likeness(df).collect()}
    ordered = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    hasher = Hasher()
    assert len(got) == len(rows)
    for (i, text, _), (_, following, _) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        text, following = text or "", following or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (hasher.fingerprint(text), hasher.fingerprint(edited))
        assert r.near_next == hasher.likeness(r.fingerprint, hasher.fingerprint(following))
        assert r.near_edited == hasher.likeness(r.fingerprint, r.edited_fingerprint)
    single = neighbour_likeness(df.filter("doc_id = 5001")).collect()
    assert len(single) == 1 and single[0].near_next == 1
    assert neighbour_likeness(df.limit(0)).count() == 0
    twice = df.union(df)
    assert neighbour_likeness(twice).count() == 2 * len(rows)
    prints = {r.id: r.fingerprint for r in fingerprints(df).collect()}
    assert all(got[i].fingerprint == p for i, p in prints.items())

"""The search for near fingerprints finds near copies, and all of them within its radius."""

import random

from groundshift.llm import simhash


def test_search_at_a_wide_radius_equals_brute_force(spark):
    rnd, rows = random.Random(6), []
    for _ in range(20):
        x = rnd.getrandbits(128)
        for bits in (0, 1, 5, 12, 20, 24, 25, 40):
            y = x
            for b in rnd.sample(range(128), bits):
                y ^= 1 << b
            rows.append(tuple(v - 2**64 if v >= 2**63 else v for v in (y >> 64, y & (2**64 - 1))))
    frame = spark.createDataFrame([*rows, (0, 0), (0, 0)], "fp_hi long, fp_lo long")
    whole = lambda r: (r[0] % 2**64) << 64 | r[1] % 2**64
    every = {*rows, (0, 0)}
    want = {(a, b, d) for a in every for b in every if (d := (whole(a) ^ whole(b)).bit_count()) <= simhash.NEAR_BITS}
    for at_once in (1000, 50):
        got = simhash.within_any_radius(frame, frame, simhash.NEAR_BITS, at_once).collect()
        assert sorted(((r["q_hi"], r["q_lo"]), (r["fp_hi"], r["fp_lo"]), r["distance"]) for r in got) == sorted(want)
        assert next(r for r in got if r["fp_hi"] == r["fp_lo"] == r["q_hi"] == 0)["copies"] == 2


def test_near_copies_are_counted(spark):
    rnd, rows = random.Random(7), []
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9)))
    for i in range(0, 1000, 50):
        words = [word() for _ in range(300)]
        edited = words.copy()
        for j in rnd.sample(range(300), 5):  # 25 of some 296 shingles at most: Jaccard above 0.8
            edited[j] = word()
        rows += [(i, " ".join(words)), (i + 1, " ".join(edited)), (i + 2, " ".join(word() for _ in range(300)))]
    got = {r["doc_id"]: r["n_within_radius"] for r in simhash.op5(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 1 for i in range(0, 1000, 50))

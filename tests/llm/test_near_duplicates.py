"""Groups of alike texts against all pairs."""

import random

import numpy as np
from heddle.llm import near_duplicates as N
from heddle.operators.graph import components
from heddle.llm.words import words


def texts(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    common = ["the", "and", "of", "in", "that", "with", "a", "after"]
    out = []
    for g in range(150):
        base = rng.sample(vocabulary, 24) + common
        for c in range(rng.choice([1, 1, 2, 3])):
            own = list(base)
            for _ in range(c * 3):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rng.shuffle(own)
            out.append((len(out), " ".join(own).upper() if c else ", ".join(own)))
    return out


def brute(rows, least=0.6):
    sets = {i: set(words(t)) for i, t in rows if t and len(set(words(t))) >= 8}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {(i, j) for i in sets for j in sets if i < j and find(i) == find(j)}


def found(spark, rows, params=None):
    df = spark.createDataFrame(rows, "id long, text string")
    return {tuple(r) for r in N.pairs_of_groups(N.groups(df, params)).collect()}


def test_all_pairs(spark):
    rows = texts()
    want = brute(rows)
    got = found(spark, rows)
    assert len(want) > 60 and got <= want and len(got) >= 0.98 * len(want)


def test_long_table_rows_are_linked_by_blocks(spark):
    base = " ".join(f"b{i}" for i in range(30))
    rows = [(i, f"{base} x{i}") for i in range(60)]
    assert found(spark, rows, N.MultiIndex(block=8)) == {(i, j) for i in range(60) for j in range(i + 1, 60)}


def test_pairs_of_frequent_words_with_rare_edits(spark):
    rng = random.Random(12)
    pool, vocabulary = [f"often{i}" for i in range(40)], [f"v{i}" for i in range(3000)]
    rows = []
    for pair in range(150):
        base = rng.sample(pool, 24)
        for side in "ab":
            rows.append((len(rows), " ".join(base + [f"rare{pair}{side}{e}" for e in range(5 + pair % 4)])))
    rows += [(len(rows) + i, " ".join(rng.sample(vocabulary, 30))) for i in range(600)]
    want = brute(rows)
    got = found(spark, rows)
    assert len(want) == 150 and got <= want and len(got) >= 0.98 * len(want)


def test_shared_words():
    rng = random.Random(2)
    sets = [np.array(sorted(rng.sample(range(60), rng.randrange(1, 40))), np.uint32) for _ in range(30)]
    packed = [s.tobytes() for s in sets]
    for width in (7, 4096):
        assert N.shared_words(packed[:12], packed[12:], width).tolist() == [[len({*x.tolist()} & {*y.tolist()}) for y in sets[12:]] for x in sets[:12]]


def test_edge_cases(spark):
    long = " ".join(f"l{i}" for i in range(20000))
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "a b c d e f g"), (5, "a b c d e f g h"), (6, "A, b; c d e f g h!"), (6, "A, b; c d e f g h!"), (None, "a b c d e f g h"), (7, long), (8, long + " more")]
    assert found(spark, rows) == {(5, 6), (7, 8)}
    assert found(spark, []) == set()


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(5, 5), (1, 0)], "a long, b long")
    assert {tuple(r) for r in components(df).collect()} == {(i, 0) for i in range(61)}

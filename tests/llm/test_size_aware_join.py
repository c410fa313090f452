"""The size-aware join against all pairs, its parts against their definitions, and its edges."""

import itertools

import numpy as np
import pytest

from riskweave.llm import size_aware_join as join

SCHEMA = "doc_id long, text string, n long, key string, id long, component string"


def sets(texts, width):
    out = []
    for text in texts:
        words = (text or "").lower().split()
        out.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    return out


def brute(texts, width, percent):
    own, component = sets(texts, width), list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(own[a] & own[b])
        if both and 100 * both >= percent * (len(own[a]) + len(own[b]) - both):
            one, two = component[a], component[b]
            component = [min(one, two) if c in (one, two) else c for c in component]
    return {i: (len(own[i]), component[i]) for i in range(len(texts))}


def edited(random, words, changes):
    words = list(words)
    for _ in range(changes):
        at = int(random.integers(0, len(words)))
        kind = random.random()
        if kind < 0.5:
            words[at] = f"x{random.integers(0, 40)}"
        elif kind < 0.75 and len(words) > 2:
            del words[at]
        else:
            words.insert(at, f"y{random.integers(0, 40)}")
    return words


def corpus(seed):
    random = np.random.default_rng(seed)
    passage = [f"p{i}" for i in range(40)]
    texts = [None, "", " \t", "one", "one two", "One  TWO", "one two three"]
    for size in (2, 5, 9, 12, 15, 20, 25, 31, 40, 80, 200):
        for _ in range(3):
            base = [f"w{random.integers(0, 400)}" for _ in range(size)]
            for _ in range(12):
                texts.append(" ".join(edited(random, base, int(random.integers(0, 1 + size // 12 + 1)))))
            # A passage that many share, and a text that is mostly the passage.
            texts.append(" ".join(base + passage))
            texts.append(" ".join(passage + base[:2]))
    return texts


@pytest.mark.parametrize(("width", "percent", "cell"), [(1, 85, 2)])
def test_components_against_all_pairs(spark, monkeypatch, width, percent, cell):
    monkeypatch.setattr(join, "CELL", cell)
    texts = corpus(width + percent + cell)
    docs = spark.createDataFrame([(i, t, 1, "k", 2, "c") for i, t in enumerate(texts)], SCHEMA)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in join.linked_sets(docs, width, percent).collect()}
    expected = brute(texts, width, percent)
    assert found == expected and len({c for _, c in expected.values()}) < len(texts) - 50


@pytest.mark.parametrize("below", [12])
def test_every_boundary_gives_the_same(spark, monkeypatch, below):
    monkeypatch.setattr(join, "boundary", lambda sizes, percent: below)
    texts = corpus(7)
    docs = spark.createDataFrame([(i, t, 1, "k", 2, "c") for i, t in enumerate(texts)], SCHEMA)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in join.linked_sets(docs, 1, 90).collect()}
    assert found == brute(texts, 1, 90)


def test_what_a_link_needs():
    for n, m in itertools.product(range(1, 60), repeat=2):
        least = next((o for o in range(min(n, m) + 1) if 100 * o >= 90 * (n + m - o)), None)
        assert (least is None) == (join.needed(n, m) > min(n, m)) and (least is None or join.needed(n, m) == least)
        if least is not None:
            assert least in join.subset_sizes(n, 60) and least in join.subset_sizes(m, 60)
            # Even if all that is shared comes last in both orders, one posted member is shared.
            assert least + join.posted(n) > n and least + join.posted(m) > m


def test_subsets_are_named_by_their_members():
    members = np.sort(np.random.default_rng(1).integers(0, 2**63, 8).astype(np.uint64))
    for size in (5, 6, 7, 8):
        names = join.subsets(members, size)
        assert len({tuple(x) for x in names.T}) == len(list(itertools.combinations(range(8), size)))
        one = join.subsets(members[:size], size)[:, 0]
        assert (names.T == one).all(axis=1).sum() == 1


def test_the_boundary_follows_the_cost():
    dear_lists = {n: (10, 10**9) for n in range(5, 30)}
    dear_subsets = {n: (10**6, 1) for n in range(5, 30)}
    assert join.boundary(dear_lists) >= 28 and join.boundary(dear_subsets) < 12 and join.boundary({}) == 1


def test_maps_never_differ_more_than_sets():
    random = np.random.default_rng(2)
    for _ in range(300):
        pool = random.integers(0, 2**63, 600).astype(np.uint64)
        a = np.unique(random.choice(pool, int(random.integers(1, 500))))
        b = np.unique(random.choice(pool, int(len(a) * random.uniform(0.95, 1.05)) + 1))
        maps = [join.parity_map(s).view(np.uint64) for s in (a, b)]
        width = np.array([len(m) for m in maps])
        differ = int(join._differing(maps, width, np.array([0]), np.array([1]))[0])
        assert differ <= len(np.setxor1d(a, b)) and width.max() <= 2 * width.min()
        if width[0] != width[1]:
            # Halving a map gives that of half the width.
            wide, small = (a, b) if width[0] > width[1] else (b, a)
            own, folded = join.parity_map(wide).view(np.uint64), join._differing(maps, width, np.array([0]), np.array([1]))
            bits = np.bincount((join.mixed(wide) >> np.uint64(40)).astype(np.int64) % (32 * len(own)), minlength=32 * len(own)) & 1
            half = np.packbits(bits.astype(np.uint8)).view(np.uint64)
            assert (half == (own[: len(half)] ^ own[len(half) :])).all() and len(small) and folded >= 0


def test_the_sketch_counts_all_texts(spark):
    docs = spark.createDataFrame([(i, "a b c d") for i in range(50)] + [(60, None), (61, "a b")], "doc_id long, text string").repartition(7)
    counters = join.sketch(docs)
    assert counters.sum() == 101 and sorted(counters[counters > 0]) == [1, 50, 50]


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert join.linked_sets(empty).count() == 0
    long = " ".join(f"w{i}" for i in range(100_000))
    rows = [(5, long), (9, long + " end"), (2, "other " + long), (None, long), (None, None), (7, None), (8, "a b c"), (8, "a b c"), (4, "a b c")]
    rows += [(20, "left alone"), (20, "x y z " * 9), (21, "x y z " * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, join.linked_sets(docs).collect()), key=str)
    assert found == sorted([
        (5, 99_998, 2), (9, 99_999, 2), (2, 99_999, 2), (None, 99_998, None), (None, 0, None), (7, 0, 7), (8, 1, 4), (8, 1, 4), (4, 1, 4),
        (20, 1, 20), (20, 3, 20), (21, 3, 20),
    ], key=str)


def test_a_filter_over_ids_loses_none(spark):
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(3000)] + [(5, "t5"), (5, "other"), (None, "n")], "doc_id long, text string")
    ids = spark.range(0, 3000, 50).toDF("id")
    found = [tuple(r) for r in join.in_question(texts, ids).select("id", "text").collect()]
    wanted = {(i, f"t{i}") for i in range(0, 3000, 50)}
    assert wanted <= set(found) and len(found) == len(set(found)) < 100
    with_five = join.in_question(texts, spark.range(5, 6).toDF("id")).select("id", "text").collect()
    assert sorted(map(tuple, with_five)) == [(5, "other"), (5, "t5")]

"""Runs of words against brute force, and the edges of the operator."""

import hashlib
import zlib

import numpy as np

from riskweave.llm import word_runs


def brute(words, times=4, least=6):
    found, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(least, times * q):
                found[start, length] = min(q, found.get((start, length), q))
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def sequences(count, seed):
    random = np.random.default_rng(seed)
    for _ in range(count):
        n, kinds = int(random.integers(0, 60)), int(random.integers(1, 4))
        words = random.integers(0, kinds, n).tolist()
        if n > 3 and random.random() < 0.5:
            p = int(random.integers(1, 7))
            words = words[:5] + [words[i % min(p, n)] for i in range(n)] + words[:7]
        yield words


def test_runs_against_brute_force():
    for words in sequences(1500, 1):
        for times, least in ((4, 6), (2, 2), (3, 5)):
            assert word_runs.runs_of(words, times, least) == brute(words, times, least)


def test_cutting_loses_no_run():
    for words in sequences(1500, 2):
        for times, least in ((4, 6), (2, 2)):
            runs, left = word_runs.collapsed(" ".join(map(str, words)), times, least)
            assert runs == brute(words, times, least)
            gone = {i for s, n, q in runs for i in range(s + q, s + n)}
            assert left == " ".join(str(w) for i, w in enumerate(words) if i not in gone)


def test_long_texts_in_linear_time():
    words = ["again"] * 200_000 + [f"w{i % 5000}" for i in range(60_000)]
    runs, left = word_runs.collapsed("\n".join(words))
    assert runs == [(0, 200_000, 1), (200_000, 60_000, 5000)] and len(left.split()) == 5001


def test_edges(spark):
    texts = [None, "", " \t\n", "a b c", "x " * 6, "x " * 5, "a b " * 4, "a b " * 4, "é é " * 7 + "end", "A a " * 9]
    rows = [(i, t, "clash", 5) for i, t in enumerate(texts)] + [(None, "q " * 8, "clash", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed int")
    out = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in word_runs.collapse_runs(docs).collect()}
    assert out[0] == out[1] == out[2] == ([], "") and out[3] == ([], "a b c")
    assert out[4] == ([(0, 6, 1)], "x") and out[5] == ([], "x x x x x")
    assert out[6] == out[7] == ([(0, 8, 2)], "a b")
    # A no-break space is no end of a word.
    assert out[8] == ([(0, 7, 1)], "é é end") and out[9] == ([(0, 18, 2)], "A a") and out[None] == ([(0, 8, 1)], "q")
    empty = spark.createDataFrame([], docs.schema)
    assert word_runs.collapse_runs(empty).count() == 0 and word_runs.period_runs(empty).count() == 0


def test_digest_rows_against_brute_force(spark):
    random = np.random.default_rng(5)
    texts = {i: " ".join(random.choice(list("abcdef"), int(random.integers(0, 80)))) for i in range(300)} | {300: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    seen = 0
    for row in word_runs.period_runs(docs).collect():
        h, words = zlib.crc32(str(row["doc_id"]).encode()), (texts[row["doc_id"]] or "").split()
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        seen += len(runs)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        assert row["n_runs"] == len(runs) and (row["start"], row["length"], row["period"]) == (best or (None,) * 3)
        assert row["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        left = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert row["collapsed_sha256"] == hashlib.sha256(left.encode()).hexdigest()
    assert seen > 10


def test_the_greatest_run_by_exact_ratio(spark):
    run = "struct<start: long, length: long, period: long>"
    big = 3_000_000_000
    rows = [([(0, 9, 2), (20, 18, 4), (40, 9, 2)],), ([],), ([(5, big * 4 + 1, big), (9, 8, 2)],), ([(1, 8, 2), (1, 12, 3)],)]
    out = spark.createDataFrame(rows, f"runs array<{run}>").select(word_runs.greatest(word_runs.F.col("runs")).alias("g")).collect()
    assert [r["g"] and tuple(r["g"]) for r in out] == [(0, 9, 2), None, (5, big * 4 + 1, big), (1, 8, 2)]

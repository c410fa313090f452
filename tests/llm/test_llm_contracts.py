"""Registered queries on whole small tables: against their SQL, or against brute force where SQL can't say it."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def held(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus == 2


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas()


def words(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("name", [n for n in ORACLES if n.startswith("op")])
def test_query_agrees_with_its_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, QUERIES[name], ORACLES[name]) is None


def test_languages_of_held_out_documents(spark, documents):
    found = QUERIES["op2_language_id"](spark, FOLDER).toPandas()
    assert list(found.columns[:4]) == ["doc_id", "held_out", "lang_pred", "score"] and len(found) == len(documents)
    both = documents.merge(found, on="doc_id")
    assert (both["held_out"] == both["doc_id"].map(lambda i: held(i, 4))).all() and both["score"].between(0, 1).all()
    assert (both[both["held_out"]]["lang"] == both[both["held_out"]]["lang_pred"]).mean() > 0.97


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op3_quality_classifier"](spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    assert found["score"].between(0, 1).all() and (found["predicted"] == (found["score"] >= 0.7)).all()
    both = labels.merge(found, on="doc_id")
    both = both[both["held_out"]]
    assert (both["predicted"] == both["quality"]).mean() > 0.95


def test_language_model_against_counting(spark, documents):
    found = QUERIES["op5_lm_scoring"](spark, FOLDER).toPandas().set_index("doc_id")
    tokens = {i: [*words((t or "").encode().lower().decode()), b""] for i, t in zip(documents["doc_id"], documents["text"], strict=True)}
    counts = Counter(token for i, own in tokens.items() if not held(i, 7) for token in own)
    total, kinds = sum(counts.values()), len(counts)
    for i, own in tokens.items():
        row = found.loc[i]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own)
        assert (row["n_tokens"], row["n_known"]) == (len(own), sum(counts[w] > 0 for w in own))
        assert row["train_tokens"] == total and row["held_out"] == held(i, 7) and math.isclose(row["base_score"], base, rel_tol=1e-9)
    apart = found[found["held_out"]]
    assert apart["score"].sum() > apart["base_score"].sum() and (found["score"] < 0).all()


def test_mix_meets_its_targets(spark, documents):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").toPandas()
    found = QUERIES["op8_source_mixing"](spark, folder).toPandas()
    again = QUERIES["op8_source_mixing"](spark, folder).toPandas()
    assert found.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    both = docs.merge(found, on="doc_id")
    assert (both["size"] == both["text"].map(lambda t: len(words(t)))).all() and (both["taken"] <= 3 * both["size"]).all()
    by = both.groupby("source").agg(size=("size", "sum"), given=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    total, wanted, open_ = int(by["size"].sum()), {}, {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(by.index))}
    left = float(total)
    while open_:
        unit = left / sum(open_.values())
        above = [s for s, w in open_.items() if unit * w > 3 * by["size"][s]]
        for s in above or list(open_):
            wanted[s] = 3 * by["size"][s] if above else unit * open_[s]
        left -= sum(wanted[s] for s in above)
        open_ = {s: w for s, w in open_.items() if s not in wanted}
    for source, row in by.iterrows():
        assert row["size"] == row["given"] and math.isclose(row["target"], wanted[source], rel_tol=1e-9)
        assert abs(row["taken"] - row["target"]) <= 0.05 * row["target"]


def test_packing_round_trip(spark, documents):
    from tokenizers import Tokenizer

    from riskweave.llm.packing_mbs import tokenizer_path

    tokenizer = Tokenizer.from_file(tokenizer_path())
    found = QUERIES["op10_packing"](spark, FOLDER).toPandas()
    pieces = {i: part.sort_values("start") for i, part in found.groupby("doc_id")}
    for i, text in zip(documents["doc_id"], documents["text"], strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for start, length, crc, tokens in pieces[i][["start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False):
            assert start == at and tokens == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    padding = 0
    for _, part in found.groupby("sequence_id"):
        part, at = part.sort_values("offset"), 0
        for offset, length in zip(part["offset"], part["length"], strict=True):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 1024


def test_pipeline(spark, documents):
    import corpus_pipeline

    found = QUERIES["pipeline"](spark, FOLDER).toPandas()
    kept = set(found["doc_id"])
    assert kept and kept <= set(documents["doc_id"])
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "quality_classifier", "near_dedup", "source_mixing", "packing",
    ]
    ledger = QUERIES["op7_quality_rules"](spark, FOLDER).toPandas()
    assert not kept & set(ledger[~ledger["kept"]]["doc_id"])
    sets = defaultdict(set)
    for i, text in zip(documents["doc_id"], documents["text"], strict=True):
        own = words((text or "").lower())
        sets[i] = {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))}
    left = sorted(kept)
    for at, a in enumerate(left):
        for b in left[at + 1 :]:
            both = len(sets[a] & sets[b])
            assert both < 0.8 * (len(sets[a]) + len(sets[b]) - both)


def test_pipeline_stages_take_empty_and_odd_tables(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, hash string, failed string, copies int"
    none = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, FOLDER)
        assert out.columns == none.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, none, FOLDER).count() == 0
    good = "the quick brown fox jumps over a lazy dog while seven wizards watch quietly from hills"
    rows = [
        (1, good, None, None, None, 1, "h", "f", 2), (2, None, "en", "s", 0, None, None, None, None),
        (3, good + " again", None, "s", 5, 1, "h", "f", 2), (4, "", "en", "s", 0, 1, "h", "f", 2),
    ]
    odd = spark.createDataFrame(rows, schema)
    passed = corpus_pipeline.quality_rules(spark, odd, FOLDER)
    assert passed.columns == odd.columns and sorted(r["doc_id"] for r in passed.collect()) == [1, 3]
    assert [r["failed"] for r in passed.collect()] == ["f", "f"]
    mixed = corpus_pipeline.source_mixing(spark, passed, FOLDER)
    assert mixed.columns == odd.columns and {r["hash"] for r in mixed.collect()} <= {"h"}


def test_pipeline_keeps_one_of_repeated_rows(spark):
    import corpus_pipeline

    texts = [" ".join(f"{name}{i}" for i in range(40)) for name in "abcd"]
    rows = [(1, texts[0])] * 3 + [(None, texts[1])] * 3 + [(None, texts[2]), (7, texts[2]), (5, texts[2]), (5, texts[2])]
    rows += [(9, texts[3]), (9, texts[0] + " more"), (9, "another text under the id of two others"), (4, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.near_dedup(spark, docs, FOLDER)
    assert left.columns == docs.columns
    found = Counter((r["doc_id"], r["text"]) for r in left.collect())
    assert found == Counter([
        (1, texts[0]), (None, texts[1]), (5, texts[2]), (9, texts[3]), (9, "another text under the id of two others"),
        (4, None), (4, None),
    ])

"""Near duplicates: a worker turns few texts at a time into strings, and pairs are confirmed without carrying two texts a row."""

import tracemalloc

import pyarrow as pa

from riskweave.llm import bbit_minhash

SCHEMA = pa.schema([("b", pa.int64()), ("part", pa.int32()), ("of", pa.int64()), ("a", pa.int64()), ("text", pa.string())])
NEAR, FAR = " ".join(f"w{i}" for i in range(100)), " ".join(f"v{i}" for i in range(100))


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


def pairs_of(rows: list[tuple], size: int) -> list[tuple]:
    made = bbit_minhash.met((batch(rows[at : at + size]) for at in range(0, len(rows), size)), 3, 85)
    return [tuple(r.values()) for out in made for r in out.to_pylist()]


def test_a_key_may_go_on_in_the_next_batch():
    rows = [(1, 0, 7, None, NEAR), (1, 0, 7, 2, NEAR + " x"), (1, 0, 7, 3, FAR), (1, 0, 9, None, FAR), (1, 0, 9, 2, NEAR + " x"), (1, 0, 9, 3, FAR)]
    rows += [(4, 0, 7, None, NEAR), (4, 0, 7, None, NEAR), (4, 0, 7, 5, NEAR), (4, 1, 7, None, NEAR), (4, 1, 7, 6, FAR)]
    for size in (1, 2, 3, len(rows)):
        assert pairs_of(rows, size) == [(2, 1), (3, 1), (5, 4)]


def test_no_rows_are_no_pairs():
    assert pairs_of([], 1) == []


def test_a_large_batch_is_never_strings_at_once():
    long = "lorem ipsum " * 2000
    rows = batch([(1, 0, 7, None, long)] + [(1, 0, 7, i, f"{long} {i}") for i in range(2, 2002)])
    tracemalloc.start()
    try:
        found = sum(len(out) for out in bbit_minhash.met(iter([rows]), 3, 85))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # 48 MB of text; a slice is 6 MB of it.
    assert found == 0 and peak < 20 << 20


def test_texts_of_an_id_are_met_one_by_one(spark):
    rows = [(1, NEAR), (1, FAR), (2, NEAR + " x"), (3, FAR + " x"), (4, "other words of no one else"), (5, None), (1, None), (6, NEAR + " y")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.component_id) for r in bbit_minhash.near_duplicates(documents).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 1)}

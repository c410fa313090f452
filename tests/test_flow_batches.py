"""Files reach and leave Python in batches of many files: none by itself, none cut."""

import pyarrow as pa

from riskweave.operators import file_flow, python_facts

TYPES = {"line": pa.int64(), "safe_for": pa.list_(pa.string())}
SCHEMA = pa.schema([(n, TYPES.get(n, pa.string())) for n in ("file", *file_flow.TAGGED)])


def rows_of(file: str, origin: str) -> list[tuple]:
    return [
        (file, "node", f"{file}|x", None, origin, 3, []), (file, "edge", f"{file}|x", f"{file}|y", None, 0, ["html"]),
        (file, "sink", f"{file}|y", None, "path", 0, []), (file, "sink", f"{file}|y", None, "html", 0, []),
    ]


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


def test_many_files_of_a_task_are_solved_in_one_pass():
    rows = [row for i in range(50) for row in rows_of(f"f{i:02}", "opaque" if i % 2 else "input")]
    expected = {(f"f{i:02}|y", "path", *(("unknown", None) if i % 2 else ("tainted", 3))) for i in range(50)}
    expected |= {(f"f{i:02}|y", "html", "clean", None) for i in range(50)}
    for size in (1, 3, 7, len(rows)):
        made = list(file_flow._file_by_file(batch(rows[at : at + size]) for at in range(0, len(rows), size)))
        assert len(made) == 1
        assert sorted(map(tuple, (r.values() for r in made[0].to_pylist())), key=str) == sorted(expected, key=str)


def test_no_rows_are_no_levels():
    assert sum(len(b) for b in file_flow._file_by_file(iter(()))) == 0


def test_facts_of_many_files_share_a_batch():
    files = pa.RecordBatch.from_pylist([{"repository_id": 1, "path": f"f{i}.py", "text": f"x = {i}\nopen(x)\n"} for i in range(200)])
    made = list(python_facts._batches(iter([files, files.slice(0, 0)])))
    assert len(made) == 1
    rows = made[0].to_pylist()
    assert {r["path"] for r in rows} == {f"f{i}.py" for i in range(200)}
    assert [r["fact"] for r in rows if r["path"] == "f7.py"] == ["assign", "call"]
    assert dict(next(r["kwargs"] for r in rows if r["fact"] == "call"))["#args"] == "1"

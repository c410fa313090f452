import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import chunking, retrieval


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(4)
    sections = ["Risk", "Description", "Fix", "Mitigations"]
    # A third of all passages and queries share one CWE.
    cwe = lambda i: "CWE-1" if i % 3 == 0 else f"CWE-{i % 7 + 2}"
    chunks = [
        (i, cwe(i), f"R{i % 4}" if i % 11 == 0 else None, f"A0{i % 5}", sections[0 if i % 3 == 0 and i % 30 else i % 4], rng.normal(size=8).tolist())
        for i in range(400)
    ]
    queries = [
        (1000 + i, cwe(i) if i % 8 else None, f"R{i % 4}" if i % 8 else None, f"A0{i % 9}" if i % 8 else None, rng.normal(size=8).tolist())
        for i in range(60)
    ]
    return chunks, queries


def brute(chunks, queries, k, least):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    out = set()
    for q, cwe, rule, owasp, qv in queries:
        scored = []
        for c, c_cwe, c_rule, c_owasp, section, cv in chunks:
            if c_rule is not None and c_rule != rule:
                continue
            tier = 0 if c_rule == rule and rule else 1 if c_cwe == cwe and cwe else 2 if c_owasp == owasp and owasp else 3
            scored.append((tier, -round(float(unit(qv) @ unit(cv)), 6), c, section))
        ranked = sorted(s for s in scored if s[0] < 3)
        chosen = ranked[:k]
        fixes = ("Fix", "Mitigations")
        if chosen and not any(s[3] in fixes for s in chosen):
            later = [s for s in ranked[k:] if s[3] in fixes]
            chosen = chosen[:-1] + later[:1] if later else chosen
        more = [s for s in sorted(s for s in scored if s[0] == 3) if -s[1] >= least]
        chosen += more[: k - len(chosen)]
        out |= {(q, s[2], n + 1) for n, s in enumerate(chosen)}
    return out


def test_retrieval_equals_brute_force_in_small_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "PASSAGE_BLOCK", 11)
    chunks, queries = corpus
    c = spark.createDataFrame(chunks, "chunk_id bigint, cwe_id string, rule_id string, owasp_category string, section string, embedding array<double>")
    q = spark.createDataFrame(queries, "query_id bigint, cwe_id string, rule_id string, owasp_category string, vector array<double>")
    got = retrieval.retrieve(retrieval.prepare_queries(q), retrieval.prepare_chunks(c, 8), k=5, threshold=0.35)
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in got.collect()} == brute(chunks, queries, 5, 0.35)


def test_a_malformed_vector_is_dropped_and_counted(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None)], "chunk_id bigint, embedding array<double>")
    assert tuple(retrieval.vector_codec_check(c, 2).first()) == (3, 1, 1)


def packed(text, limit):
    """Greedy packing written plainly, to compare with the fold."""
    import re

    def join(parts, by):
        out, now = [], ""
        for part in parts:
            if not now:
                now = part
            elif len(now) + len(by) + len(part) <= limit:
                now += by + part
            else:
                out, now = [*out, now], part
        return [*out, now] if now else out

    def words(sentence):
        cut = [w[i : i + limit] for w in sentence.split(" ") for i in range(0, len(w), limit)]
        return [sentence] if len(sentence) <= limit else join(cut, " ")

    def fit(p):
        return [p] if len(p) <= limit else join([w for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", p) for w in words(s)], " ")

    paragraphs = [p for p in (" ".join(x.split()) for x in re.split(r"\n\s*\n", text)) if p]
    return join([f for p in paragraphs for f in fit(p)], "\n\n")


def test_chunking_equals_plain_packing(spark):
    texts = [
        "One. Two three. Four!\n\nFive six seven. Eight", "word " * 400, "x" * 950 + " tail", "A. " * 300 + "\n \n" + "B c. " * 90, "", " \n\n ",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunking.split_text(F.col("t"), F.lit(220)).alias("p")).collect()
    for row in rows:
        assert row.p == packed(texts[row.i], 220), row.i


def test_heading_is_inside_the_budget(spark):
    doc = spark.createDataFrame([("k", "T" * 40, [("Body", "Aa bb. " * 400), ("Fix", "Do it.")])], "external_id string, title string, sections array<struct<name:string,text:string>>")
    rows = chunking.chunk_documents(doc, 300).orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(len(rows))) and max(len(r.text) for r in rows) <= 300
    assert rows[-1].section == "Fix"

"""Knowledge base and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions import vectors
from riskweave.functions.paths import owasp_code
from riskweave.operators import aggregates, chunking, retrieval
from riskweave.plans.adapters import Tables
from riskweave.plans.registry import query
from riskweave.plans.views import squash

DIMENSIONS = 64


def prepared(t: Tables):
    return retrieval.prepare_queries(t.queries), retrieval.prepare_chunks(t.chunks, DIMENSIONS)


def as_documents(t: Tables):
    section = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("text"))
    return t.documents.select(
        F.col("source"), F.col("doc_id").cast("string").alias("external_id"),
        F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"),
        F.array(section("Body", F.col("text")), section("Blank", F.lit(" \n ")), section("Origin", F.col("lang"))).alias("sections"),
    )


@query("chunk_documents")
def chunk_documents(t: Tables):
    return chunking.chunk_documents(as_documents(t)).select("external_id", "ordinal", "section", "text")


@query("chunk_invariants", f"""SELECT doc_id::VARCHAR AS external_id, sha256({squash('text')}) AS body, 0 AS too_long FROM documents""")
def chunk_invariants(t: Tables):
    """Passages put together again are the document, and none is longer than allowed."""
    rows = chunking.chunk_documents(as_documents(t)).filter("section = 'Body'")
    body = F.regexp_replace("text", r"^[^\n]*\n", "")
    # A word longer than the limit would be cut; the given texts hold none, so a blank joins.
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", body.alias("b")))), lambda x: x["b"]), " ")
    return rows.groupBy("external_id").agg(
        F.sha2(joined, 256).alias("body"), F.count_if(F.length("text") > 1200).alias("too_long")
    )


@query("drop_empty_sections", f"SELECT doc_id::VARCHAR AS external_id, 'Body,Origin' AS names, sha256({squash('text')}) AS body FROM documents")
def drop_empty_sections(t: Tables):
    rows = chunking.drop_empty_sections(as_documents(t))
    return rows.select(
        "external_id", F.array_join(F.transform("sections", lambda s: s["name"]), ",").alias("names"),
        F.sha2(F.get("sections", F.lit(0))["text"], 256).alias("body"),
    )


@query("incremental_build_plan", """SELECT source, doc_id::VARCHAR AS external_id, CASE WHEN doc_id % 9 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'changed' WHEN doc_id % 5 = 0 THEN 'model_changed' ELSE 'unchanged' END AS action FROM documents""")
def incremental_build_plan(t: Tables):
    n = F.col("doc_id")
    keys = ["source", n.cast("string").alias("external_id")]
    incoming = t.documents.select(*keys, F.sha2("text", 256).alias("content_hash"))
    older = F.when(n % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    stored = t.documents.filter("doc_id % 9 <> 0").select(*keys, F.sha2(older, 256).alias("content_hash"))
    chunks = t.documents.filter("doc_id % 9 <> 0").select(*keys, F.when(n % 5 == 0, "old").otherwise("new").alias("embedding_model"))
    return chunking.incremental_build_plan(incoming, stored, chunks, "new").drop("content_hash")


@query("embed_passages", "SELECT doc_id::VARCHAR AS external_id, 64 AS dimensions, 'hashed-words' AS embedding_model, CASE WHEN regexp_matches(text, '\\w') THEN 1.0 ELSE 0.0 END AS length FROM documents")
def embed_passages(t: Tables):
    rows = retrieval.embed_passages(t.documents.select(F.col("doc_id").cast("string").alias("external_id"), "text"))
    return rows.select(
        "external_id", F.size("embedding").alias("dimensions"), "embedding_model",
        F.round(F.sqrt(vectors.dot(F.col("embedding"), F.col("embedding"))), 3).alias("length"),
    )


@query("normalise_vector", "SELECT vec_id, round(u[1], 9) AS first, round(u[64], 9) AS last, round(list_dot_product(u, u), 9) AS square FROM v_unit")
def normalise_vector(t: Tables):
    unit = t.read("embeddings").select("vec_id", vectors.normalise(F.col("embedding")).alias("u"))
    return unit.select(
        "vec_id", F.round(F.get("u", F.lit(0)), 9).alias("first"), F.round(F.element_at("u", -1), 9).alias("last"),
        F.round(vectors.dot(F.col("u"), F.col("u")), 9).alias("square"),
    )


@query("vector_codec_check", "SELECT count(*) AS chunks, count(*) FILTER (WHERE vec_id % 13 <> 0 AND vec_id % 17 <> 0) AS readable, count(*) FILTER (WHERE vec_id % 13 <> 0 AND vec_id % 17 = 0) AS unreadable FROM embeddings WHERE vec_id % 10 <> 0")
def vector_codec_check(t: Tables):
    n = F.col("chunk_id")
    spoiled = F.when(n % 13 == 0, None).when(n % 17 == 0, F.slice("embedding", 1, 60)).otherwise(F.col("embedding"))
    return retrieval.vector_codec_check(t.chunks.withColumn("embedding", spoiled), DIMENSIONS)


@query("cosine_similarity", """SELECT query_id, chunk_id, score, rank FROM (SELECT q.query_id, c.chunk_id, round(list_dot_product(q.q, c.u), 6) AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_dot_product(q.q, c.u), 6) DESC, c.chunk_id) AS rank
 FROM v_queries q JOIN v_chunks c ON c.cwe_id = q.cwe_id AND (c.rule_id IS NULL OR c.rule_id = q.rule_id)) WHERE rank <= 10""")
def cosine_similarity(t: Tables):
    queries, chunks = prepared(t)
    return retrieval.cosine_similarity(queries, chunks, "cwe_id", 10).select("query_id", "chunk_id", "score", "rank")


@query("match_priority", """SELECT tier, count(*) AS pairs FROM (SELECT CASE WHEN coalesce(c.rule_id = f.rule_id, false) THEN 'rule' WHEN coalesce(c.cwe_id = f.cwe_id, false) THEN 'cwe' WHEN coalesce(c.owasp = f.owasp, false) THEN 'owasp' ELSE 'semantic' END AS tier
 FROM v_findings_ids f JOIN c ON c.key = f.key) GROUP BY 1""".replace("v_findings_ids", "(SELECT event_id % 997 AS key, rule_id, cwe_id, substr(owasp_category, 1, 8) AS owasp FROM (SELECT id AS event_id, * FROM v_findings))").replace(
    "JOIN c ON", "JOIN (SELECT vec_id % 997 AS key, 'PY00' || (label % 9) AS rule_id, ['CWE-95','CWE-78','CWE-327','CWE-89','CWE-22'][label % 5 + 1] AS cwe_id, 'A0' || (label % 5 + 1) || ':2021' AS owasp FROM embeddings) c ON"))
def match_priority(t: Tables):
    label = F.col("label")
    told = t.read("embeddings").select(
        (F.col("vec_id") % 997).alias("key"), F.concat(F.lit("PY00"), (label % 9).cast("string")).alias("c_rule"),
        F.element_at(F.array(*[F.lit(c) for c in ("CWE-95", "CWE-78", "CWE-327", "CWE-89", "CWE-22")]), label % 5 + 1).alias("c_cwe"),
        F.concat(F.lit("A0"), (label % 5 + 1).cast("string"), F.lit(":2021")).alias("c_owasp"),
    )
    asked = t.findings.select((F.col("id") % 997).alias("key"), "rule_id", "cwe_id", owasp_code(F.col("owasp_category")).alias("owasp"))
    tier = retrieval.match_priority(*[F.col(c) for c in ("c_rule", "rule_id", "c_cwe", "cwe_id", "c_owasp", "owasp")])
    return asked.join(told, "key").groupBy(tier.alias("tier")).agg(F.count("*").alias("pairs"))


@query("knowledge_candidates", """SELECT DISTINCT f.rule_id, f.cwe_id, f.owasp, c.chunk_id, CASE WHEN coalesce(c.rule_id = f.rule_id, false) THEN 'rule' WHEN coalesce(c.cwe_id = f.cwe_id, false) THEN 'cwe' ELSE 'owasp' END AS matched_by
 FROM (SELECT DISTINCT rule_id, cwe_id, substr(owasp_category, 1, 8) AS owasp FROM v_findings) f JOIN (SELECT vec_id AS chunk_id, CASE WHEN vec_id % 11 = 0 THEN 'PY00' || (label % 9) END AS rule_id, ['CWE-95','CWE-78','CWE-327','CWE-89','CWE-22'][label % 5 + 1] AS cwe_id,
 'A0' || (label % 5 + 1) || ':2021' AS owasp FROM embeddings) c ON (c.rule_id = f.rule_id OR c.cwe_id = f.cwe_id OR c.owasp = f.owasp) AND (c.rule_id IS NULL OR c.rule_id = f.rule_id)""")
def knowledge_candidates(t: Tables):
    label = F.col("label")
    told = t.read("embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.when(F.col("vec_id") % 11 == 0, F.concat(F.lit("PY00"), (label % 9).cast("string"))).alias("rule_id"),
        F.element_at(F.array(*[F.lit(c) for c in ("CWE-95", "CWE-78", "CWE-327", "CWE-89", "CWE-22")]), label % 5 + 1).alias("cwe_id"),
        F.concat(F.lit("A0"), (label % 5 + 1).cast("string"), F.lit(":2021")).alias("owasp_category"), "embedding",
    )
    asked = t.findings.select("rule_id", "cwe_id", owasp_code(F.col("owasp_category")).alias("owasp"))
    return retrieval.knowledge_candidates(asked, told)


@query("rank_passages", "SELECT query_id, chunk_id, tier, score, rank FROM v_ranked WHERE rank <= 5 OR rank = first_remedy")
def rank_passages(t: Tables):
    queries, chunks = prepared(t)
    # Beyond rank 5 only the order among kept rows is meaningful; the first remedy keeps its rank
    # when it is within the first five.
    return retrieval.rank_passages(queries, chunks).select("query_id", "chunk_id", "tier", "score", "rank")


@query("reserve_remediation_slot", "SELECT query_id, chunk_id, section, tier, score, rank FROM v_selected")
def reserve_remediation_slot(t: Tables):
    queries, chunks = prepared(t)
    ranked = retrieval.rank_passages(queries, chunks)
    return retrieval.reserve_remediation_slot(ranked).select("query_id", "chunk_id", "section", "tier", "score", "rank")


@query("semantic_top_up", "SELECT query_id, chunk_id, section, tier, score, rank FROM v_topup")
def semantic_top_up(t: Tables):
    queries, chunks = prepared(t)
    selected = retrieval.reserve_remediation_slot(retrieval.rank_passages(queries, chunks))
    return retrieval.semantic_top_up(queries, chunks, selected)


@query("retrieve", "SELECT query_id, chunk_id, section, tier, score, rank FROM v_selected UNION ALL SELECT query_id, chunk_id, section, tier, score, rank FROM v_topup")
def retrieve(t: Tables):
    queries, chunks = prepared(t)
    return retrieval.retrieve(queries, chunks).select("query_id", "chunk_id", "section", "tier", "score", "rank")


@query("embedding_model_guard", "SELECT count(DISTINCT m) AS models, count(*) AS chunks, 'more than one embedding model' AS problem FROM (SELECT CASE WHEN vec_id % 7 = 0 THEN 'old' ELSE 'new' END AS m FROM embeddings WHERE vec_id % 10 <> 0)")
def embedding_model_guard(t: Tables):
    model = F.when(F.col("chunk_id") % 7 == 0, "old").otherwise("new")
    return retrieval.embedding_model_guard(t.chunks.withColumn("embedding_model", model), "new")


@query("retrieval_eval", """SELECT q.query_id, e AS expected_cwe, count(r.chunk_id) AS passages, coalesce(bool_or(c.cwe_id = e), false) AS has_cwe, coalesce(bool_or(r.section IN ('Fix','Mitigations')), false) AS has_fix
 FROM (SELECT vec_id AS query_id, 'CWE-' || label AS e FROM v_unit WHERE vec_id % 10 = 0) q LEFT JOIN (SELECT query_id, chunk_id, section FROM v_selected UNION ALL SELECT query_id, chunk_id, section FROM v_topup) r USING (query_id)
 LEFT JOIN v_chunks c ON c.chunk_id = r.chunk_id GROUP BY 1, 2""")
def retrieval_eval(t: Tables):
    queries, chunks = prepared(t)
    expected = t.read("embeddings").filter("vec_id % 10 = 0").select(
        F.col("vec_id").alias("query_id"), F.concat(F.lit("CWE-"), F.col("label").cast("string")).alias("expected_cwe")
    )
    rows = retrieval.retrieval_eval(retrieval.retrieve(queries, chunks), expected, chunks)
    return rows.select("query_id", "expected_cwe", "passages", "has_cwe", "has_fix")


@query("knowledge_status", """SELECT d.source, d.documents, d.versions, d.built_at, coalesce(c.chunks, 0) AS chunks, coalesce(c.embedded, 0) AS embedded, coalesce(c.models, 0) AS models FROM (SELECT lang AS source, count(*) AS documents, count(DISTINCT source) AS versions, max(doc_id) AS built_at FROM documents GROUP BY 1) d
 LEFT JOIN (SELECT lang AS source, count(*) AS chunks, count(*) FILTER (WHERE doc_id % 3 <> 0) AS embedded, count(DISTINCT CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END) AS models FROM documents JOIN labels USING (doc_id) GROUP BY 1) c USING (source)""")
def knowledge_status(t: Tables):
    n = F.col("doc_id")
    documents = t.documents.select(F.col("lang").alias("source"), F.col("source").alias("source_version"), n.alias("updated_at"))
    chunks = t.documents.join(t.read("labels"), "doc_id").select(
        F.col("lang").alias("source"), F.when(n % 3 != 0, n).alias("embedding"), F.when(n % 2 == 0, "a").otherwise("b").alias("embedding_model")
    )
    return aggregates.knowledge_status(documents, chunks)



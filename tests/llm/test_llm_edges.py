"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import (
    bbit_minhash,
    block_knn,
    chat_snapshots,
    language_id,
    mixing_flow,
    ngram_trie,
    packing_mbs,
    quality_fm,
    quality_ledger,
    url_filters,
)
from riskweave.llm.components import components
from riskweave.llm.elias_fano import EliasFano

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string"
SENTENCE = "one two three four five six seven eight nine ten eleven twelve "


def docs(spark, texts, langs=None):
    rows = [(i, t, (langs or [None] * len(texts))[i], "s", None, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# ---- url filters


def judged(spark, urls, rules=url_filters.CONTRACT_RULES):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = url_filters.judge(pages, url_filters.rule_table(spark, rules)).collect()
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out}


def test_urls(spark):
    out = judged(
        spark,
        [
            None, "no scheme", "", "http://WWW.Example.COM/en/1?q#f", "http://a.example.com/en/1", "https://example.com",
            "http://net/es/x", "x://b.net/fr/", "http://b.net/frx/", "http://notexample.com/en/", "http://b.net?u=://c.com/",
        ],
    )
    assert out[0] == out[1] == out[2] == ("", "", None, "allow")
    assert out[3] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert out[4] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert out[5] == ("example.com", "", None, "allow")
    assert out[6][2:] == ("net/es/", "block") and out[7][2:] == ("net/fr/", "block") and out[8][2:] == (None, "allow")
    assert out[9][2:] == ("com/", "allow") and out[10] == ("b.net", "", None, "allow")


def test_nested_rules_against_brute_force(spark):
    random = np.random.default_rng(3)
    labels, steps = ["a", "b", "ab", "c"], ["/", "/a", "/ab", "/ab/c", "/b/", "/a/b"]
    host = lambda: ".".join(random.choice(labels, random.integers(1, 5)))
    rules = [(host(), str(random.choice(steps)), str(random.choice(["allow", "block"]))) for _ in range(60)]
    urls = [f"http://{host()}{random.choice(steps)}{random.choice(['', 'x', '/b'])}" for _ in range(300)]
    out = judged(spark, urls, rules)
    for i, url in enumerate(urls):
        h, _, p = url[7:].partition("/")
        p = "/" + p
        fits = [(len(a + b), len(a), v == "block", a + b, v) for a, b, v in rules if (h == a or h.endswith("." + a)) and p.startswith(b)]
        best = max(fits, default=(0, 0, 0, None, "allow"))
        assert out[i][2:] == best[3:], url


def test_urls_of_an_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.judge(pages, url_filters.rule_table(spark)).count() == 0
    assert judged(spark, ["http://a.com/", "http://a.com/"], [("b.com", "/", "block")])[1][3] == "allow"


# ---- language


def test_language_codes():
    for n in (2, 3, 4, 6, 9, 20):
        code = language_id.codewords(n)
        apart = (len(code) - code.T @ code) / 2
        assert code.shape[1] == n and apart[~np.eye(n, dtype=bool)].min() >= 1
    assert language_id.grams("").sum() == 1 and (language_id.grams("Ab, c!") == language_id.grams("ab c")).all()


def test_pieces_of_long_texts_count_alike(monkeypatch):
    text = "alpha beta gamma " * 40
    whole = language_id.grams(text)
    monkeypatch.setattr(language_id, "PIECE", 64)
    assert (language_id.grams(text) == whole).all()


def test_language_edges(spark):
    texts = ["the cat and the dog", "der hund und die katze", None, "", "123 !!", "the dog", "der hund", "the dog"] * 4
    langs = ["en", "de", "en", None, None, None, None, None] * 4
    out = {r["doc_id"]: r for r in language_id.language_id(docs(spark, texts, langs)).collect()}
    assert len(out) == 32 and all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (2, 3, 4))
    assert out[5]["lang_pred"] == out[7]["lang_pred"] == "en" and out[6]["lang_pred"] == "de"
    none = language_id.language_id(docs(spark, ["a text"], [None])).collect()[0]
    assert (none["lang_pred"], none["score"]) == ("und", 0.0)
    assert language_id.language_id(spark.createDataFrame([], DOCS)).count() == 0
    one = language_id.language_id(docs(spark, ["a text"] * 9, ["xx"] * 9)).collect()
    assert {r["lang_pred"] for r in one} == {"xx"}


# ---- quality classifier


def test_machine_is_the_sum_over_pairs():
    random = np.random.default_rng(0)
    machine = quality_fm.Machine(0.3, random.normal(size=quality_fm.SIZE), random.normal(size=(quality_fm.SIZE, 3)))
    index, value = np.array([5, 9, 9, 40]), np.array([0.5, 1.0, 2.0, -1.0])
    pairs = sum(
        machine.factors[index[a]] @ machine.factors[index[b]] * value[a] * value[b] for a in range(4) for b in range(a + 1, 4)
    )
    expected = 0.3 + machine.linear[index] @ value + pairs
    assert np.isclose(machine.raw(index, value, np.array([0]))[0], expected)


def test_classifier_edges(spark):
    texts = [SENTENCE, "### $$$ %%% &&&", None, ""] * 10
    table = docs(spark, texts)
    labels = spark.createDataFrame(
        [(i, 1 if i % 4 == 0 else 0 if i % 4 == 1 else None) for i in range(40)] * 2, "doc_id long, quality int"
    )
    out = {r["doc_id"]: r for r in quality_fm.quality_classifier(table, labels).collect()}
    assert len(out) == 40 and all(0 <= r["score"] <= 1 for r in out.values())
    assert out[0]["predicted"] == 1 and out[1]["predicted"] == 0 and out[2]["score"] == out[3]["score"]
    nothing = quality_fm.quality_classifier(table, labels.filter("false")).collect()
    assert {r["score"] for r in nothing} == {0.5} and {r["predicted"] for r in nothing} == {0}
    assert quality_fm.quality_classifier(spark.createDataFrame([], DOCS), labels).count() == 0


# ---- chat


def test_chat_snapshots(spark):
    def turns(conv, texts, role="user"):
        return [(conv, i, role, t) for i, t in enumerate(texts)]

    rows = turns(1, ["a"]) + turns(2, ["a", "b"]) + turns(3, ["a", "b", "c"]) + turns(4, ["a", "b", "c"]) + turns(5, ["a", "x"])
    rows += turns(5, ["a"]) + [(None, 0, "user", "lost"), (6, None, None, None)]
    out = chat_snapshots.chat_documents(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {r["conv_id"]: r for r in out}
    assert set(by) == {3, 5, 6} and by[3]["copies"] == 2 and by[3]["n_turns"] == 3 and by[5]["n_turns"] == 2
    assert by[5]["text"] == "<|user|>\na\n<|end|>\n<|user|>\nx\n<|end|>\n" and by[6]["text"] == "<|unknown|>\n\n<|end|>\n"
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_snapshots.chat_documents(none).count() == 0


def test_long_chats_come_in_segments(spark, monkeypatch):
    monkeypatch.setattr(chat_snapshots, "BLOCK", 4)
    monkeypatch.setattr(chat_snapshots, "SEGMENT", 5)
    rows = [(c, i, "user", str(i)) for c, n in ((1, 11), (2, 12)) for i in range(n)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = sorted(chat_snapshots.chat_documents(table).collect(), key=lambda r: r["segment"])
    assert [(r["conv_id"], r["segment"]) for r in out] == [(2, 0), (2, 1), (2, 2)]
    assert "".join(r["text"] for r in out) == "".join(f"<|user|>\n{i}\n<|end|>\n" for i in range(12))


# ---- language model


def test_elias_fano():
    random = np.random.default_rng(0)
    for n, universe in ((0, 1), (1, 1), (5, 100), (1000, 10**6), (5000, 5001), (3000, 2**40)):
        values = np.sort(random.integers(0, universe, n)).astype(np.uint64)
        data, header = EliasFano.build(values, universe)
        sequence = EliasFano(data, header | {"offset": 0})
        if n:
            assert (sequence.access(np.arange(n)) == values).all()
            wanted = random.integers(0, universe + 2, 500).astype(np.uint64)
            found = sequence.successor(np.zeros(500), np.full(500, n), wanted)
            assert (found == np.searchsorted(values, wanted)).all()


def test_trie_finds_what_was_counted():
    random = np.random.default_rng(1)
    context, successor = random.integers(0, 50, 2000).astype(np.uint64) << np.uint64(15), random.integers(0, 40, 2000).astype(np.uint32)
    trie = ngram_trie.mapped(*ngram_trie.Trie.build(context, successor, np.ones(2000, np.int64)))
    for c, s in zip(context[:200], successor[:200], strict=True):
        n = ((context == c) & (successor == s)).sum()
        assert abs(ngram_trie.restored(trie.find(np.array([c]), np.array([s])))[0] - n) < 0.01
    assert trie.find(np.array([7], np.uint64), np.array([1], np.uint32))[0] == 0


@pytest.mark.parametrize("shards", [12, 2500])
def test_successors_of_a_hot_context_keep_their_own_keys(shards):
    words = [b"hot", *[b"w%d" % i for i in range(300_000)]]
    hashes = ngram_trie.word_hashes(words)
    codes = np.arange(1, len(words), dtype=np.uint64)  # "hot" before every word
    order, shard, key = ngram_trie.placed(hashes, codes, shards)
    assert len(np.unique(shard)) == shards and (np.sort(order) == np.arange(len(codes))).all()
    assert (np.diff(shard) >= 0).all() and (key[1:] >= key[:-1])[shard[1:] == shard[:-1]].all()
    shared = ((shard[1:] == shard[:-1]) & (key[1:] == key[:-1])).sum()
    assert shared <= 3


def test_language_model_edges(spark, monkeypatch):
    out = {r["doc_id"]: r for r in ngram_trie.score(docs(spark, [None, "", "a b a", "A  b\ta", "a b a"])).collect()}
    assert out[0]["n_tokens"] == out[1]["n_tokens"] == 1 and out[2]["score"] == out[3]["score"] == out[4]["score"]
    assert ngram_trie.score(spark.createDataFrame([], DOCS)).count() == 0
    texts = docs(spark, [SENTENCE * 9, "one two", "three"])
    whole = {r["doc_id"]: r for r in ngram_trie.score(texts).collect()}
    monkeypatch.setattr(ngram_trie, "BLOCK_TOKENS", 10)
    parts = {r["doc_id"]: r for r in ngram_trie.score(texts).collect()}
    for i in whole:
        assert np.isclose(whole[i]["score"], parts[i]["score"]) and whole[i]["n_tokens"] == parts[i]["n_tokens"]


# ---- nearest neighbours


def test_neighbour_edges(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]),
        (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (20, [-1.0, 1e-3]), (None, [1.0, 1.0]),
    ]
    table = spark.createDataFrame([(*r, "q") for r in rows], "vec_id long, embedding array<float>, rank string")
    out = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in block_knn.nearest(table).collect())
    assert out == [(0, 1, 1), (0, 2, 2), (0, 3, 20), (20, 1, 0), (20, 2, 1), (20, 3, 2)]
    assert block_knn.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("dims", [3, 64])
def test_cell_is_exact(dims):
    random = np.random.default_rng(dims)
    vectors = np.repeat(random.normal(size=(900, dims)).astype(np.float32).astype(float), 4, axis=0)
    ids = np.arange(len(vectors))
    found = block_knn.best_of_cell(ids[:30], vectors[:30], ids, vectors, 10)
    for q in range(30):
        scores = block_knn.exact(np.repeat(vectors[q : q + 1], len(ids), axis=0), vectors)
        best = sorted((-s, i) for s, i in zip(scores, ids, strict=True) if i != q)[:10]
        assert sorted((-s, c) for a, s, c in found if a == q) == best


# ---- quality ledger


def test_ledger_edges(spark):
    texts = [None, "", SENTENCE, "a b c d e a b c d e x y", "l\nl\nl\n \nm " + SENTENCE, "#$ " * 20]
    out = {r["doc_id"]: r for r in quality_ledger.apply_policy(quality_ledger.ledger(docs(spark, texts))).collect()}
    assert (out[0]["n_words"], out[1]["n_words"], out[0]["kept"]) == (0, 0, False)
    assert out[2]["kept"] and out[2]["failed"] == 0
    assert (out[3]["n_repeat_words"], out[3]["n_words"]) == (10, 12) and not out[3]["kept"]
    assert out[4]["n_dup_lines"] == 2 and out[5]["n_symbols"] == 40
    assert quality_ledger.quality_ledger(spark.createDataFrame([], DOCS)).count() == 0


def test_ablation_counts_masks(spark):
    entries = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,)], "failed long")
    out = {(r["policy"], r["rule"]): r for r in quality_ledger.ablation(entries).collect()}
    row = out["base", "few_words"]
    assert (row["documents"], row["rejected"], row["failing"], row["only_this_rule"]) == (5, 3, 3, 2)
    assert out["2", "symbols"]["only_this_rule"] == 1


# ---- mixing


def test_targets_share_the_excess():
    wanted = mixing_flow.targets({"a": 10, "b": 100, None: 1000}, 1110)
    assert [float(wanted[s]) for s in ("a", "b", None)] == [30, 300, 780]
    assert mixing_flow.targets({}, 0) == {} and mixing_flow.targets({"a": 0, "b": 5}, 5) == {"a": 0, "b": 5}


def test_flow_spreads_repetition_over_overlapping_sources():
    patterns = [(("a",), 10), (("a", "b"), 10), (("b",), 10)]
    given = mixing_flow.min_cost_flow(patterns, {"a": 25, "b": 5})
    assert sum(g.get("a", 0) for g in given) == 25 and sum(g.get("b", 0) for g in given) == 5
    # b has its own words for its quota, so both patterns of a serve a: 20 once and 5 twice.
    assert given[2] == {"b": 5} and all(sum(g.values()) <= 15 for g in given)


def test_mix_edges(spark):
    rows = [(i, SENTENCE if i % 3 else None, None, None if i % 2 else "s", None, "x", "y") for i in range(60)]
    out = mixing_flow.mixing(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == 60 and all(r["taken"] == 0 for r in out if r["size"] == 0)
    assert mixing_flow.mixing(spark.createDataFrame([], DOCS)).count() == 0


def test_mix_fills_the_gap_before_a_long_document(spark, monkeypatch):
    # One long document and many short ones: the seeded cut stops before the long one, far from the target.
    monkeypatch.setattr(mixing_flow, "OFFERED", 8)
    texts = {i: 200 + i % 3 for i in range(1, 301)}
    for long_id in (0, 1000):
        lengths = texts | {long_id: 50_000}
        rows = [(i, "w " * n, "s") for i, n in lengths.items()]
        sizes = mixing_flow.materialise(mixing_flow.sized(spark.createDataFrame(rows, "doc_id long, text string, source string"), F.array("source")))
        for rest in (30_000, 55_000):
            uses = spark.createDataFrame([('["s"]', 0, rest)], "pattern string, whole long, rest long")
            out = mixing_flow.copies(sizes, mixing_flow._cuts(sizes, uses)).collect()
            taken, unused = sum(r["size"] * r["copies"] for r in out), [r["size"] for r in out if not r["copies"]]
            assert len(out) == 301 and taken <= rest and rest - taken < min(unused), (long_id, rest)


# ---- near duplicates


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 103), (7, 7)]
    out = {r["id"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(41)) and all(out[i] == 100 for i in range(100, 104))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signature_estimates():
    assert bbit_minhash.bands_for(0.85) == (25, 5) and bbit_minhash.bands_for(0.8) == (32, 4)
    random = np.random.default_rng(0)
    pool = random.integers(0, 2**63, 1500).astype(np.uint64)
    one, two = bbit_minhash.minima(pool[:1000]), bbit_minhash.minima(pool[500:])
    assert abs((one == two).mean() - 1 / 3) < 0.13


def test_near_duplicate_edges(spark):
    base = " ".join(f"w{i}" for i in range(100))
    chain = [base + "".join(f" x{k}" for k in range(n)) for n in range(0, 40, 8)]
    texts = [None, "", "hello", "Hello", "hello there", *chain, *chain, "a completely different text of some words"]
    out = {r["doc_id"]: r for r in bbit_minhash.near_duplicates(docs(spark, texts)).collect()}
    assert all(out[i]["component_id"] == i and out[i]["kept"] for i in (0, 1, 2, 4)) and out[3]["component_id"] == 2
    assert {out[i]["component_id"] for i in range(5, 15)} == {5} and out[15]["kept"]
    assert out[0]["n_shingles"] == 0 and out[2]["n_shingles"] == 1
    assert bbit_minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_buckets_of_many_components(spark, monkeypatch):
    # One common bucket, groups whose links don't touch the bucket's least id, and cells smaller than the bucket.
    monkeypatch.setattr(bbit_minhash, "CHUNK", 4)
    monkeypatch.setattr(bbit_minhash, "GROUP_ROWS", 10)
    monkeypatch.setattr(bbit_minhash, "band_keys", lambda least, bands, rows: np.zeros(bands, np.int64) + np.arange(bands))
    monkeypatch.setattr(bbit_minhash, "floor_of", lambda threshold: 0.0)
    texts = [" ".join(f"g{g}w{i}" for i in range(60)) + f" tail{k}" for k in range(3) for g in range(5)]
    out = {r["doc_id"]: r["component_id"] for r in bbit_minhash.near_duplicates(docs(spark, texts)).collect()}
    assert out == {i: i % 5 for i in range(15)}


def test_groups_of_cells_stay_bounded(spark, monkeypatch):
    # One bucket of many components: its rows are copied to many cells, and so are the texts of those that are near.
    monkeypatch.setattr(bbit_minhash, "CHUNK", 4)
    monkeypatch.setattr(bbit_minhash, "GROUP_ROWS", 16)
    monkeypatch.setattr(bbit_minhash, "GROUP_CHARS", 4000)
    asked, plain = [], bbit_minhash.groups_for
    monkeypatch.setattr(bbit_minhash, "groups_for", lambda *n: asked.append((n, plain(*n))) or asked[-1][1])
    n = 60
    members = spark.createDataFrame([(7, 0, i, i) for i in range(n)], "key long, band int, id long, component long")
    marks = spark.createDataFrame([(i, [0] * 8, [i], 500) for i in range(n)], "id long, signature array<long>, bands array<long>, chars long")
    texts = spark.createDataFrame([(i, f"a{i // 2} b{i // 2} c{i // 2}") for i in range(n)], "id long, text string")
    out = {(r["a"], r["b"]) for r in bbit_minhash.between_components(members, marks, texts, 3, 85).collect()}
    assert out == {(i + 1, i) for i in range(0, n, 2)}
    (first, groups), (second, text_groups) = asked
    assert first == (59 * 15 + 60 * 15,) and first[0] / groups <= 16
    assert second[1] == 500 * second[0] and second[1] / text_groups <= 4000


# ---- packing


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing_mbs.tokenizer_path())
    odd = ["", " ", "  a", "a  b", "a b ", "it's a  dog\n\n next\tline \u00a0x \u2003y", "a<|endoftext|> b", "été ça 123 $%^ \x00 z\x1c q"]
    encoder = packing_mbs.Ids(*packing_mbs.default_tokenizer())
    for text, found in zip(odd * 2, encoder.encode(odd * 2), strict=True):
        assert np.frombuffer(found, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("space", [" ", "\t", "\n", "\r", " \n"])
def test_long_runs_of_white_space_are_encoded(space):
    # The ranked encoder's pattern overflows its stack beyond a million.
    encoder = packing_mbs.Ids(*packing_mbs.default_tokenizer())
    text = "x" + space * (1_200_000 // len(space)) + "y"
    ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == ids
    assert encoder.plain("x" + space * 1000 + "y") and encoder.plain("word " * 50_000)


@pytest.mark.parametrize(
    "counts", [{700: 1000}, {1024: 3}, {5: 1}, {512: 3, 100: 7}, {1023: 50, 1: 3}, {n: n % 7 for n in range(1, 1024)}, {}]
)
def test_plan_places_every_piece_once(counts):
    plan = packing_mbs.Plan(counts)
    fill = {}
    for length, n in counts.items():
        for rank in range(n):
            at = 0
            for start, cut, sequence, offset in plan.places(length, rank):
                assert start == at and cut > 0
                at += cut
                fill.setdefault(sequence, []).append((offset, cut))
            assert at == length
    short = 0
    for spans in fill.values():
        at = 0
        for offset, cut in sorted(spans):
            assert offset == at
            at += cut
        assert at <= 1024
        short += at < 1024
    assert short <= 1 and len(fill) == plan.sequences


def test_packing_edges(spark):
    out = packing_mbs.packing(docs(spark, [None, "", "hello world", "hello world", "word " * 3000])).toPandas()
    by = out.groupby("doc_id")["length"].sum()
    assert by[0] == by[1] == 1 and by[2] == by[3] == 3 and by[4] == out[out["doc_id"] == 4]["doc_tokens"].iloc[0]
    assert packing_mbs.packing(spark.createDataFrame([], DOCS)).count() == 0
    ids = packing_mbs.pack(docs(spark, ["hello world"])).select(F.hex("ids")).first()[0]
    assert ids == np.array([31373, 995, 0], "<u4").tobytes().hex().upper()

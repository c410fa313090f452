"""Language-model scoring with an Elias-Fano n-gram trie, sharded.

The model is a word bigram model over the training words and one class of unknown words, so it shares its event
space with the add-one base: ``p(w | h) = (c(h w) + mu p(w)) / (c(h) + mu)`` with ``p(w) = (c(w) - D) / N`` for a word seen
``c(w)`` times and ``p(unknown) = D V / N``; ``D = n1 / (n1 + 2 n2)``.  ``mu`` is the one of ``MASSES`` under which the
training texts, each token left out of the counts in turn, are likeliest.

Counts of n-grams lie in tries.  A trie has a level of contexts and a level of successors.  A context's
successors are one range of their level; the ranges are an Elias-Fano sequence of monotone pointers, and the
successors, each raised by its context's number times the size of a symbol, are one monotone Elias-Fano sequence.
A lookup finds the context by successor search, then the word by successor search relative to its context.
The smoothed logarithm of every n-gram is quantised to 16 bits.  What is stored is its numerator: the denominator
``c(h) + mu`` and ``p(w)`` belong to words, and are added where the words' own counts are.  The levels
are written to a file that is mapped into memory.

Neither counts nor tries are ever broadcast.  Texts are read once, in blocks of bounded size.  A block
numbers its distinct words and word pairs and sends each shard its part, with the training counts; a shard adds up
what all blocks sent, builds its trie, and answers every block's words and pairs in the order they came; the
block's documents are scored against the answers.  So a block's list is contribution and query in one, and
each n-gram crosses the network once per block.  A word goes to the shard of its hash; a pair to that of its
context's hash and its successor's, so that a context with a third of all tokens is spread over all shards.  There are
as many shards as the texts need.

Counts of words are exact (by the words themselves).  An n-gram is known to its shard by ``CONTEXT_BITS`` and
``SUCCESSOR_BITS`` of 64-bit hashes of its two words.  Two n-grams of one context are taken for one only if they lie in
one shard and agree in the successor's 32 bits: of ``D`` distinct successors about ``D / (S * 2^32)`` share a key, where
``S`` is the number of shards (at least 12, and rising with the text).  For the hottest context that is 2 in 100,000 at 1
million successors on 12 shards; of a shard of ``n`` n-grams of other contexts about ``n / 2^54`` more.  A block sends its
sorted n-grams in Elias-Fano form as well.

Defined results: a null text is an empty one and scores its end token; where nothing was learnt, base and
score are 0; rows are scored one by one, repeats too; null ids are not held out; a document longer than a block
is scored in parts; other columns are not read.
"""

from __future__ import annotations

import json
import mmap
import tempfile
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.elias_fano import EliasFano
from riskweave.llm.text import Numbers, encoded, held_out, mixed
from riskweave.session import materialise

BLOCK_TOKENS = 3_000_000
BLOCK_WORDS = 500_000
#: Characters of text per shard, and the fewest shards.
SHARD_CHARS, LEAST_SHARDS = 12_000_000, 12
STEP = 12 / 65000
MASSES = (1.0, 4.0, 16.0, 64.0, 256.0, 1024.0, 4096.0)
#: Tokens of a block scored at once.
TOGETHER = 300_000
#: The end of a text; as a context, its start.
END = b""
CONTEXT_BITS, SUCCESSOR_BITS = 22, 32
KEY_BITS = CONTEXT_BITS + SUCCESSOR_BITS
#: Block counts up to this are one byte; larger ones follow in a list.
SMALL = 255


class Trie:
    """Contexts, their successors, and quantised logarithms of counts, over one buffer."""

    def __init__(self, buffer, header: dict):
        self.contexts = EliasFano(buffer, header["contexts"])
        self.pointers = EliasFano(buffer, header["pointers"])
        self.successors = EliasFano(buffer, header["successors"])
        self.codes = np.frombuffer(buffer, np.uint16, header["n"], header["codes"])

    @staticmethod
    def build(context: np.ndarray, successor: np.ndarray, count: np.ndarray) -> tuple[bytes, dict]:
        """Levels from n-grams ``(context, successor)`` with positive counts; repeats are added up."""
        order = np.lexsort((successor, context))
        context, successor, count = context[order], successor[order], count[order]
        new = np.ones(len(order), bool)
        new[1:] = (context[1:] != context[:-1]) | (successor[1:] != successor[:-1])
        starts = np.flatnonzero(new)
        context, successor = context[starts], successor[starts]
        count = np.add.reduceat(count, starts) if len(starts) else count
        names, parent = np.unique(context, return_inverse=True)
        raised = parent.astype(np.uint64) << np.uint64(SUCCESSOR_BITS) | successor.astype(np.uint64)
        begins = np.searchsorted(parent, np.arange(len(names) + 1))
        data, header = bytearray(), {"n": len(starts)}
        for name, values, universe in (
            ("contexts", names, 1 << CONTEXT_BITS), ("pointers", begins, len(starts) + 1), ("successors", raised, max(len(names), 1) << SUCCESSOR_BITS),
        ):
            part, header[name] = EliasFano.build(values, universe)
            header[name]["offset"] = len(data)
            data += part
        header["codes"] = len(data)
        data += quantised(count).tobytes()
        return bytes(data), header

    def find(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Codes of n-grams; 0 where one is not stored."""
        out = np.zeros(len(context), np.uint16)
        if not len(self.codes):
            return out
        names, of = np.unique(context, return_inverse=True)  # a context is looked for once
        everywhere = np.zeros(len(names), np.int64)
        node = self.contexts.successor(everywhere, everywhere + self.contexts.n, names)
        stored = node < self.contexts.n
        stored[stored] = self.contexts.access(node[stored]) == names[stored]
        live = np.flatnonzero(stored[of])
        node = node[of[live]]
        begin, end = self.pointers.access(node).astype(np.int64), self.pointers.access(node + 1).astype(np.int64)
        wanted = node.astype(np.uint64) << np.uint64(SUCCESSOR_BITS) | successor[live].astype(np.uint64)
        at = self.successors.successor(begin, end, wanted)
        hit = np.flatnonzero(at < end)
        hit = hit[self.successors.access(at[hit]) == wanted[hit]]
        out[live[hit]] = self.codes[at[hit]]
        return out


def quantised(count: np.ndarray) -> np.ndarray:
    """16-bit codes of log10 of positive counts; 0 means none."""
    return (1 + np.rint(np.log10(np.maximum(count, 1)) / STEP).clip(0, 65000)).astype(np.uint16)


def restored(code: np.ndarray) -> np.ndarray:
    """Counts of codes."""
    return np.where(code > 0, np.rint(10 ** ((np.maximum(code, 1) - 1.0) * STEP) * 1000) / 1000, 0.0)


def mapped(data: bytes, header: dict) -> Trie:
    """A trie over a memory map of an unnamed file, which goes when the map does."""
    with tempfile.TemporaryFile() as file:
        file.write(data)
        file.flush()
        return Trie(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ), header)


def pair_codes(sequence: np.ndarray, kinds: int) -> np.ndarray:
    """Numbers of the word pairs of a document, which starts with its first context."""
    return sequence[:-1].astype(np.uint64) * np.uint64(kinds) + sequence[1:].astype(np.uint64)


def placed(hashes: np.ndarray, codes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's word pairs: the order by shard and key, and in that order the shards and the keys."""
    kinds = np.uint64(len(hashes))
    with np.errstate(over="ignore"):
        context, successor = mixed(hashes), mixed(hashes ^ np.uint64(0x5851F42D4C957F2D))
        left, right = (codes // kinds).astype(np.int64), (codes % kinds).astype(np.int64)
        # The successors of one context are dealt evenly over all shards.
        shard = ((context % np.uint64(shards))[left] + (successor % np.uint64(shards))[right]) % np.uint64(shards)
    key = context[left] >> np.uint64(64 - CONTEXT_BITS) << np.uint64(SUCCESSOR_BITS)
    key |= successor[right] >> np.uint64(64 - SUCCESSOR_BITS)
    order = np.argsort(key, kind="stable")
    shard = shard.astype(np.uint16 if shards <= 1 << 16 else np.uint64)
    order = order[np.argsort(shard[order], kind="stable")]
    return order, shard[order].astype(np.int64), key[order]


def small(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as bytes, and those that do not fit, in order, as 32-bit numbers."""
    return np.minimum(counts, SMALL).astype(np.uint8).tobytes(), counts[counts >= SMALL].astype(np.uint32).tobytes()


def counted(one: bytes, rest: bytes) -> np.ndarray:
    counts = np.frombuffer(one, np.uint8).astype(np.int64)
    counts[counts == SMALL] = np.frombuffer(rest, np.uint32)
    return counts


def squeezed(numbers: np.ndarray) -> bytes:
    """32-bit numbers by byte place, compressed."""
    import zstandard

    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def restored_numbers(data: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


PART = {
    "kind": pa.string(), "block": pa.int64(), "shard": pa.int32(),
    **{name: pa.binary() for name in "abcdefg"}, "header": pa.string(),
}
PART_DDL = (
    "kind string, block long, shard int, a binary, b binary, c binary, d binary, e binary, f binary, g binary, header string"
)


def blocks(documents: DataFrame, shards: int) -> DataFrame:
    """Texts read once.  Rows of kind ``doc`` (documents of a block: ``a`` word numbers, each after its first context, ``b``
    lengths, ``c`` rows, ``d`` ids, ``e`` 1 if held out, 2 if without id), ``layout`` (``a``: hashes of the block's
    words) and ``part`` (what a shard gets), written once.
    """

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*[(*row, *[None] * (len(PART) - len(row))) for row in rows], strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, PART.values(), strict=True)], list(PART))

    def flush(block: int, known: Numbers, docs: list) -> Iterator[pa.RecordBatch]:
        words, kinds = list(known), len(known)
        hashes = word_hashes(words)
        codes = np.unique(np.concatenate([pair_codes(sequence, kinds) for _, _, _, sequence in docs]))
        pair_n, word_n = np.zeros(len(codes), np.uint32), np.zeros(kinds, np.uint32)
        learnt = [sequence for _, _, held, sequence in docs if not held]
        if learnt:
            found, n = np.unique(np.concatenate([pair_codes(s, kinds) for s in learnt]), return_counts=True)
            pair_n[np.searchsorted(codes, found)] = n
            word_n += np.bincount(np.concatenate([s[1:] for s in learnt]), minlength=kinds).astype(np.uint32)
        for at in range(0, len(docs), 1000):
            rows, ids, flags, sequences = zip(*docs[at : at + 1000], strict=True)
            flags = [bool(held) + 2 * (doc_id is None) for held, doc_id in zip(flags, ids, strict=True)]
            about = (
                np.array(list(map(len, sequences)), np.uint32), np.array(rows, np.int64), np.array([i or 0 for i in ids], np.int64),
                np.array(flags, np.uint8),
            )
            yield batch_of([("doc", block, None, squeezed(np.concatenate(sequences)), *[x.tobytes() for x in about])])
        yield batch_of([("layout", block, None, hashes.tobytes())])
        order, pair_shard, keys = placed(hashes, codes, shards)
        pair_n = pair_n[order]
        word_shard = (hashes % np.uint64(shards)).astype(np.int64)
        word_order = np.argsort(word_shard, kind="stable")
        word_ends = np.searchsorted(word_shard[word_order], np.arange(shards + 1))
        pair_ends = np.searchsorted(pair_shard, np.arange(shards + 1))
        rows = []
        for shard in range(shards):
            w, p = word_order[word_ends[shard] : word_ends[shard + 1]], slice(pair_ends[shard], pair_ends[shard + 1])
            mine = [words[i] for i in w]
            if not mine and p.start == p.stop:
                continue
            data, header = EliasFano.build(keys[p], 1 << KEY_BITS)
            lengths = small(np.fromiter(map(len, mine), np.int64, len(mine)))
            header = json.dumps(header | {"offset": 0, "pairs": int(p.stop - p.start)})
            pair_counts = b"".join(small(pair_n[p]))
            rows.append(("part", block, shard, b"".join(mine), *lengths, *small(word_n[w]), data, pair_counts, header))
        yield batch_of(rows)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, row = TaskContext.get().partitionId(), 0, 0
        known, docs, tokens = Numbers(), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for doc_id, held, text in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns], strict=True):
                    words = [END, *encoded(text).lower().split(), END]
                    for start in range(0, len(words) - 1, BLOCK_TOKENS):
                        part = words[start : start + BLOCK_TOKENS + 1]
                        docs.append((task << 40 | row, doc_id, held, np.fromiter(map(known.__getitem__, part), np.uint32, len(part))))
                        tokens += len(part)
                        if tokens >= BLOCK_TOKENS or len(known) >= BLOCK_WORDS:
                            yield from flush(task << 32 | number, known, docs)
                            known, docs, tokens, number = Numbers(), [], 0, number + 1
                    row += 1
        if docs:
            yield from flush(task << 32 | number, known, docs)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 7).alias("held_out"), "text")
    return materialise(rows.mapInArrow(read, PART_DDL), compression="zstd")


ANSWER = "block long, shard int, counts binary, codes binary, tokens long, kinds long, once long, twice long"


def answered(parts: pd.DataFrame) -> pd.DataFrame:
    """One shard: totals of what all blocks sent, its trie, and the answer to every block."""
    totals: Counter = Counter()
    lists, keys, counts = [], [], []
    for part in parts.itertuples():
        ends = np.cumsum(counted(part.b, part.c)).tolist()
        words = [part.a[start:end] for start, end in zip([0, *ends], ends, strict=False)]
        for word, n in zip(words, counted(part.d, part.e).tolist(), strict=True):
            totals[word] += n
        lists.append(words)
        header = json.loads(part.header)
        keys.append(EliasFano(part.f, header).access(np.arange(header["pairs"])) if header["pairs"] else np.zeros(0, np.uint64))
        counts.append(counted(part.g[: header["pairs"]], part.g[header["pairs"] :]))
    ends = np.cumsum([0, *map(len, keys)])
    unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(inverse, np.concatenate(counts), minlength=len(unique))
    context, successor = unique >> np.uint64(SUCCESSOR_BITS), unique & np.uint64((1 << SUCCESSOR_BITS) - 1)
    seen = count > 0
    trie = mapped(*Trie.build(context[seen], successor[seen], count[seen]))
    codes = trie.find(context, successor)[inverse]
    values = np.fromiter(totals.values(), np.int64, len(totals))
    facts = [int(values.sum()), int((values > 0).sum()), int((values == 1).sum()), int((values == 2).sum())]
    rows = []
    for at, (block, words) in enumerate(zip(parts["block"], lists, strict=True)):
        own = np.fromiter(map(totals.__getitem__, words), np.uint64, len(words))
        rows.append((block, parts["shard"].iloc[0], own.tobytes(), codes[ends[at] : ends[at + 1]].tobytes(), *facts))
        facts = [0, 0, 0, 0]  # a shard's facts stand on its first row alone
    return pd.DataFrame(rows, columns=[name.split()[0] for name in ANSWER.split(", ")])


@dataclass(frozen=True)
class Facts:
    """Training tokens, distinct ones, and the discount."""

    tokens: int
    kinds: int
    discount: float

    @staticmethod
    def of(answers: DataFrame) -> Facts:
        names = ("tokens", "kinds", "once", "twice")
        row = answers.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first()
        discount = row["once"] / (row["once"] + 2 * row["twice"]) if row["once"] and row["twice"] else 0.5
        return Facts(row["tokens"], row["kinds"], discount)

    def base_logs(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1.0) / (self.tokens + 1.0 * (self.kinds + 1)))

    def word_share(self, count: np.ndarray) -> np.ndarray:
        """p(w) of words seen so often; of the unknown class where never."""
        if not self.tokens:
            return np.ones(len(count))
        unknown = self.discount * self.kinds / self.tokens
        return np.where(count > 0, (count - self.discount) / self.tokens, unknown)


def block_scores(docs: pd.DataFrame, answers: pd.DataFrame, facts: Facts, shards: int) -> pd.DataFrame:
    """Scores of a block's documents under every mass, and of the training ones with each token left out."""
    hashes = np.frombuffer(docs[docs["kind"] == "layout"]["a"].iloc[0], np.uint64)
    answers = answers.sort_values("shard")
    sequences, about = [], []
    for part in docs[docs["kind"] == "doc"].itertuples():
        ends = np.cumsum(np.frombuffer(part.b, np.uint32), dtype=np.int64)
        sequences += np.split(restored_numbers(part.a), ends[:-1])
        fields = (np.frombuffer(part.c, np.int64), np.frombuffer(part.d, np.int64), np.frombuffer(part.e, np.uint8))
        about += zip(*[x.tolist() for x in fields], strict=True)
    codes, inverse = np.unique(np.concatenate([pair_codes(s, len(hashes)) for s in sequences]), return_inverse=True)
    count, code = np.empty(len(hashes), np.int64), np.empty(len(codes), np.uint16)
    sent = np.argsort((hashes % np.uint64(shards)).astype(np.int64), kind="stable")
    count[sent] = np.concatenate([np.frombuffer(x, np.uint64) for x in answers["counts"]]).astype(np.int64)
    code[placed(hashes, codes, shards)[0]] = np.concatenate([np.frombuffer(x, np.uint16) for x in answers["codes"]])
    pair_count = restored(code)
    base, share, less = facts.base_logs(count), facts.word_share(count), facts.word_share(np.maximum(count - 1, 0))
    out, done, at = [], 0, 0
    while at < len(sequences):
        # Documents of about ``TOGETHER`` tokens at once.
        end, tokens = at, 0
        while end < len(sequences) and (end == at or tokens < TOGETHER):
            tokens += len(sequences[end]) - 1
            end += 1
        part = sequences[at:end]
        starts = np.concatenate([[0], np.cumsum([len(s) - 1 for s in part])[:-1]])
        word, context = np.concatenate([s[1:] for s in part]), count[np.concatenate([s[:-1] for s in part])]
        pair = pair_count[inverse[done : done + tokens]]
        grid = _logs(pair, share[word], context, starts)
        loo = _logs(np.maximum(pair - 1, 0), less[word], np.maximum(context - 1, 0), starts)
        known, bases = np.add.reduceat((count[word] > 0).astype(np.int64), starts), np.add.reduceat(base[word], starts)
        for i, (row, doc_id, flags) in enumerate(about[at:end]):
            held = bool(flags & 1)
            left_out = None if held else loo[i].tolist()
            facts_of = (len(part[i]) - 1, int(known[i]), float(bases[i]), grid[i].tolist(), left_out)
            out.append((row, None if flags & 2 else doc_id, held, *facts_of))
        done, at = done + tokens, end
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "grid", "loo"]
    return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})


def _logs(pair: np.ndarray, share: np.ndarray, context: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """log10 probabilities of documents (rows) under every mass (columns)."""
    return np.stack([np.add.reduceat(np.log10((pair + mass * share) / (context + mass)), starts) for mass in MASSES], axis=1)


def score(documents: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row."""
    chars = documents.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(LEAST_SHARDS, 1 + chars // SHARD_CHARS)
    read = blocks(documents, shards)
    parts = read.filter("kind = 'part'").select("block", "shard", *"abcdefg", "header")
    answers = materialise(parts.groupBy("shard").applyInPandas(answered, ANSWER), compression="zstd")
    facts = Facts.of(answers)
    docs = read.filter("kind <> 'part'").select("kind", "block", *"abcde")
    back = answers.select(F.col("block").alias("of"), "shard", "counts", "codes")

    def add(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return block_scores(left, right, facts, shards)

    schema = (
        "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, grid array<double>, "
        "loo array<double>"
    )
    scored = materialise(docs.groupBy("block").cogroup(back.groupBy("of")).applyInPandas(add, schema))
    sums = scored.agg(*[F.sum(F.get("loo", F.lit(i))).alias(f"m{i}") for i in range(len(MASSES))]).first()
    best = max(range(len(MASSES)), key=lambda i: sums[i] if sums[i] is not None else 0.0)
    # A document longer than a block comes in parts.
    parts = scored.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", F.get("grid", F.lit(best)).alias("score"))
    whole = parts.groupBy("row", "doc_id", "held_out").agg(*[F.sum(n).alias(n) for n in ("n_tokens", "n_known", "base_score", "score")])
    return whole.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(facts.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )

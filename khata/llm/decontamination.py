"""Benchmark decontamination: a BM25 index of test items, queried with every training passage by block-max WAND.

Items are indexed in pieces of PIECE_WORDS words that overlap by half; impacts are divided by the piece's own threshold,
so a passage retrieves a piece from 1 on. Pieces lie in small blocks; each posting list keeps its maximal impact in every
block that it has. A passage whose words' maxima have no pivot, as they do not sum to 1, is skipped whole; of the others
every block is skipped in which the words' block maxima cannot reach 1, and only the postings of what is left are
scored. This is done for a run of passages at a time, as sums over sparse lists. Passages overlap by half
and are twice as long as a piece, so a copied piece always lies whole in one. What is retrieved is verified on word
trigrams, for the question and the answer apart. Items too short for an index are found by their exact word sequence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.llm.common import Rolling, Words, as_bytes, chunks, cut, mix64, table

PIECE_WORDS = 64
#: A passage retrieves a piece at this share of the piece's score for itself.
RETRIEVE = 0.5
#: Shares of trigrams that a leak has: of the piece, and of its question and its answer.
OVERLAP = 0.6
PART_OVERLAP = 0.3
GRAM = 3
#: Items with fewer words are not indexed but looked for as an exact sequence of words.
LEAST_WORDS = 8
BLOCK_PIECES = 8
K1, B = 1.2, 0.75
#: Bytes of one index, which the driver builds and every task holds, and of each item word in it at most; a larger
#: benchmark is taken in so many passes.
INDEX_BYTES, WORD_BYTES = 128 << 20, 128
#: List entries and bounds that are held together for a run of passages, about.
ENTRIES = 1 << 21
_ALMOST = 1 - 1e-9

# Words are compared without case and ASCII punctuation.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PARTS = re.compile(r"(?s)(.*(?:\?|\banswer\s*:|\n))(.*\S.*)", re.I)


def _words(texts: list[bytes]) -> Words:
    return Words([(t if t.isascii() else t.decode("utf-8", "replace").lower().encode()).translate(_FOLD) for t in texts])


def _grams(words: np.ndarray) -> np.ndarray:
    if len(words) < GRAM:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - GRAM + 1].copy()
    for k in range(1, GRAM):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - GRAM + 1 + k])
    return np.unique(out)


@dataclass
class Index:
    items: np.ndarray  # item of each piece
    grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # trigrams of each piece: all, question, answer
    terms: np.ndarray  # sorted word hashes
    highest: np.ndarray  # maximal impact of each term
    start: np.ndarray  # of each term's postings
    piece: np.ndarray
    impact: np.ndarray
    blocks: int
    entry: np.ndarray  # term * blocks + block of each term's blocks, sorted
    block: np.ndarray  # of each entry
    first: np.ndarray  # of each term's entries
    posting: np.ndarray  # of each entry's postings
    top: np.ndarray  # maximal impact of each entry
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # of items with few words, by their number: hashes, items
    asking: set[int]  # items with an answer of their own whose question, and whose answer, is in the index
    answering: set[int]


def _sequences(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words on end."""
    at = np.arange(len(words) - n + 1)
    return Rolling(words, 0xA0761D6478BD642F).of(at, at + n)


@dataclass
class Weights:
    """What the retrieval counts over all items of a benchmark, of which an index may hold a part."""

    pieces: int
    words: int
    terms: np.ndarray  # sorted word hashes, those of the index at least
    df: np.ndarray  # pieces that hold each term


def _pieces(items: list[tuple[int, str]]) -> tuple[list, list, list, dict, set]:
    """(item of each piece, its words, its trigrams; items with few words by their number, items with an answer)."""
    of, pieces, grams, short, apart = [], [], [], {}, set()
    for item, text in items:
        match = _PARTS.match(text)
        parts = [match[1], match[2]] if match else [text, ""]
        q, a = (_words([p.encode()]).hash for p in parts)
        if len(a) < GRAM or len(q) < GRAM:  # no answer of its own: the last quarter stands for it
            both = np.concatenate([q, a])
            q, a = both[: len(both) - len(both) // 4], both[len(both) - len(both) // 4 :]
        else:
            apart.add(item)
        words = np.concatenate([q, a])
        if len(words) < LEAST_WORDS:
            if len(words):
                short.setdefault(len(words), []).append((_sequences(words, len(words))[0], item))
            continue
        last = max(0, len(words) - PIECE_WORDS)
        for i in [*range(0, last, PIECE_WORDS // 2), last]:
            end = i + PIECE_WORDS
            of.append(item)
            pieces.append(words[i:end])
            grams.append((_grams(words[i:end]), _grams(q[i:end]), _grams(a[max(0, i - len(q)) : max(0, end - len(q))])))
    return of, pieces, grams, short, apart


def build_index(items: list[tuple[int, str]], weights: Weights | None = None) -> Index | None:
    """Postings of the items' pieces with normalised impacts; None where no item has a word.

    weights: of all items, where these are a part of them.
    """
    of, pieces, grams, short, apart = _pieces(items)
    if not pieces and not short:
        return None
    n = len(pieces)
    length = np.array([len(p) for p in pieces], dtype=np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *pieces])
    terms, term_of = np.unique(flat, return_inverse=True)
    pairs, tf = np.unique(term_of * max(n, 1) + np.repeat(np.arange(n), length), return_counts=True)
    term, piece = pairs // max(n, 1), pairs % max(n, 1)
    if weights is None:
        weights = Weights(n, int(length.sum()), terms, np.bincount(term, minlength=len(terms)))
    df = weights.df[np.searchsorted(weights.terms, terms)]
    idf = np.log(1 + (weights.pieces - df + 0.5) / (df + 0.5))
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[piece] * (weights.pieces / max(weights.words, 1))))
    impact /= RETRIEVE * np.bincount(piece, weights=impact, minlength=n)[piece]
    start = np.searchsorted(term, np.arange(len(terms) + 1))
    blocks = -(-n // BLOCK_PIECES)
    entry, posting = np.unique(term * blocks + piece // BLOCK_PIECES, return_index=True)
    highest, top = (np.maximum.reduceat(impact, at) if len(at) else np.zeros(0) for at in (start[:-1], posting))
    few = {k: (np.array([h for h, _ in v], dtype=np.uint64), np.array([i for _, i in v], dtype=np.int64)) for k, v in short.items()}
    return Index(np.array(of, dtype=np.int64), grams, terms, highest, start, piece, impact, blocks, entry, entry % max(blocks, 1), np.searchsorted(entry, np.arange(len(terms) + 1) * blocks), np.append(posting, len(piece)), top, few, {i for i, g in zip(of, grams) if len(g[1])} & apart, {i for i, g in zip(of, grams) if len(g[2])} & apart)


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place) of every place of the ranges begin..end."""
    size = end - begin
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) + np.repeat(begin - (np.cumsum(size) - size), size)


def retrieve(index: Index, words: Words) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, first word, end word, piece, score) of every passage and piece whose score reaches 1."""
    half = PIECE_WORDS
    at = np.minimum(np.searchsorted(index.terms, words.hash), max(len(index.terms) - 1, 0))
    known = np.flatnonzero(index.terms[at] == words.hash) if len(index.terms) else at[:0]
    if not len(known):
        return
    term = at[known]
    text = np.searchsorted(words.bounds, known, side="right") - 1
    # Half passages, numbered through all texts; passage h holds the halves h and h + 1 of one text.
    halves = np.maximum(1, -(-np.diff(words.bounds) // half))
    first_half = np.concatenate([[0], np.cumsum(halves)])
    h = first_half[text] + (known - words.bounds[text]) // half
    later = h > first_half[text]
    pairs = np.unique(np.concatenate([h, h[later] - 1]) * len(index.terms) + np.concatenate([term, term[later]]))
    passage, term = pairs // len(index.terms), pairs % len(index.terms)
    begin = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    end = np.append(begin[1:], len(term))
    # Without a pivot, where all its words' maxima do not sum to 1, a passage reaches no piece.
    alive = np.flatnonzero(np.add.reduceat(index.highest[term], begin) >= _ALMOST)
    lists = np.add.reduceat(index.first[term + 1] - index.first[term], begin)[alive]
    for run in np.split(alive, np.flatnonzero(np.diff(np.cumsum(lists + index.blocks) // ENTRIES)) + 1):
        if not len(run):
            continue
        who, word = _ranges(begin[run], end[run])
        which, entry = _ranges(index.first[term[word]], index.first[term[word] + 1])
        bound = np.bincount(who[which] * index.blocks + index.block[entry], weights=index.top[entry], minlength=len(run) * index.blocks)
        meeting = np.flatnonzero(bound >= _ALMOST)
        mine, word = _ranges(begin[run[meeting // index.blocks]], end[run[meeting // index.blocks]])
        key = term[word] * index.blocks + meeting[mine] % index.blocks
        entry = np.minimum(np.searchsorted(index.entry, key), len(index.entry) - 1)
        mine, entry = mine[index.entry[entry] == key], entry[index.entry[entry] == key]
        which, posting = _ranges(index.posting[entry], index.posting[entry + 1])
        found, inverse = np.unique(meeting[mine[which]] // index.blocks * len(index.items) + index.piece[posting], return_inverse=True)
        score = np.bincount(inverse, weights=index.impact[posting], minlength=len(found))
        for pair, value in zip(found[score >= 1].tolist(), score[score >= 1].tolist()):
            number = int(passage[begin[run[pair // len(index.items)]]])
            t = int(np.searchsorted(first_half, number, side="right")) - 1
            first = int(words.bounds[t] + (number - first_half[t]) * half)
            yield t, first, int(min(first + 2 * half, words.bounds[t + 1])), pair % len(index.items), value


def exact(index: Index, words: Words) -> Iterator[tuple[int, int]]:
    """(text, item) of every item with few words whose words stand on end in a text."""
    for n, (hashes, items) in index.short.items():
        if len(words.hash) < n:
            continue
        own = _sequences(words.hash, n)
        at = np.flatnonzero(np.isin(own, hashes))
        text = np.searchsorted(words.bounds, at, side="right") - 1
        inside = at + n <= words.bounds[text + 1]
        for t, h in zip(text[inside].tolist(), own[at[inside]]):
            yield from ((t, int(i)) for i in items[hashes == h])


def _shared(of: np.ndarray, among: np.ndarray) -> float:
    return float(np.isin(of, among).mean()) if len(of) else 0.0


def leaks(texts: list[bytes], index: Index) -> list[tuple[int, int, float, float]]:
    """(text, item, best score, best overlap) of verified leaks, once for each text and item.

    A piece that is shared holds its own share of the question or the answer, or both; an item is a leak if among the
    pieces that a text shares one verifies the question and one the answer, so a long question alone is none. Of an item
    without an answer of its own any piece that is shared counts.
    """
    best: dict[tuple[int, int], tuple[float, float, bool, bool]] = {}
    words = _words(texts)
    for text, first, end, piece, score in retrieve(index, words):
        here = _grams(words.hash[first:end])
        whole, question, answer = (_shared(g, here) for g in index.grams[piece])
        if whole < OVERLAP or any(0 < len(g) and x < PART_OVERLAP for g, x in zip(index.grams[piece][1:], (question, answer))):
            continue
        key = (text, int(index.items[piece]))
        have = best.get(key, (0.0, 0.0, False, False))
        best[key] = (max(have[0], score * RETRIEVE), max(have[1], whole), have[2] or question > 0, have[3] or answer > 0)
    found = {key: v[:2] for key, v in best.items() if (v[2] or key[1] not in index.asking) and (v[3] or key[1] not in index.answering)}
    found |= {key: (1.0, 1.0) for key in exact(index, words)}
    return [(t, i, *v) for (t, i), v in sorted(found.items())]


def _counted(items: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """(item, term: the words of each item; term, df: the pieces that hold it; pieces and words of all) of all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for item, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pieces = _pieces([(item, t)])[1]
                terms, held = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(np.unique, pieces)]), return_counts=True)
                rows.append((item, None, len(pieces), sum(map(len, pieces))))
                rows += [(item, x, n, 0) for x, n in zip(terms.view(np.int64).tolist(), held.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], names=["item", "term", "pieces", "words"])

    rows = cut(items.mapInArrow(run, "item long, term long, pieces long, words long"))
    held = cut(rows.where("term is not null").groupBy("term").agg(F.sum("pieces").alias("df")))
    pieces, words = rows.where("term is null").agg(F.sum("pieces"), F.sum("words")).first()
    return rows.where("term is not null").select("item", "term"), held, pieces or 0, words or 0


def _weights(counted: tuple[DataFrame, DataFrame, int, int], part) -> Weights:
    """The counts over all items of the words of a part, which are no more than its index has."""
    rows, held, pieces, words = counted
    some = rows.where(part).select("term").distinct().join(held, "term").toArrow()
    terms, df = some["term"].to_numpy().view(np.uint64), some["df"].to_numpy()
    order = np.argsort(terms)
    return Weights(pieces, words, terms[order], df[order])


def indexes(benchmark: DataFrame, text: str, item: str) -> Iterator[Broadcast]:
    """Broadcast indexes of at most about INDEX_BYTES each, which together hold all items."""
    items = benchmark.where(F.col(text).isNotNull() & F.col(item).isNotNull()).select(F.col(item).cast("long").alias("item"), F.col(text).alias("t")).distinct()
    # A word stands in two pieces at most: postings, block maxima and trigrams take WORD_BYTES.
    total = items.agg(F.coalesce(F.sum(F.regexp_count("t", F.lit(r"[0-9A-Za-z\x80-\uFFFF]+"))), F.lit(0))).first()[0]
    passes = max(1, -(-total * WORD_BYTES // INDEX_BYTES))
    # By item, so that all texts of one item are verified together, whatever the number of passes.
    part = F.pmod(F.xxhash64("item"), F.lit(passes))
    counted = _counted(items) if passes > 1 else None
    for k in range(passes):
        weights = _weights(counted, part == k) if passes > 1 else None
        index = build_index(sorted((r["item"], r["t"]) for r in items.where(part == k).collect()), weights)
        if index is not None:
            yield benchmark.sparkSession.sparkContext.broadcast(index)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """docs less the rows in which a test item is found (see find_leaks); narrow, all columns stay.

    Null and empty texts hold no item. Repeated rows go or stay together; an empty benchmark drops nothing.
    """
    place = docs.columns.index(text)
    for shared in indexes(benchmark, "text", item):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for start, block in chunks(as_bytes(batch.column(place))):
                    clean[[start + t for t, *_ in leaks(block, shared.value)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """doc_id, item_id, score, overlap: one row per document row and test item found in it; clean documents give none.

    score: BM25 as a share of the piece's own, overlap: share of its trigrams, both of the best passage. Null or empty
    texts and items match nothing. An item under LEAST_WORDS words is found where its words stand on end (score and
    overlap 1). Narrow: every task holds the index, whose size is checked; a larger benchmark is taken in passes by a
    hash of the item, with word weights counted over all items, so that rows and scores are those of one pass.
    """
    schema = f"{id_} long, item_id long, score double, overlap double"
    out = None
    for shared in indexes(benchmark, text, item):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = as_bytes(batch.column(1))
                found = [(start + t, *rest) for start, block in chunks(texts) for t, *rest in leaks(block, shared.value)]
                ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([f[c] for f in found], kind) for c, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64())))], names=[id_, "item_id", "score", "overlap"])

        rows = docs.select(F.col(id_).cast("long").alias(id_), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)
        out = rows if out is None else out.unionByName(rows)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

"""Cross-tokenizer alignment: a two-pointer merge of cumulative token ends.

Both tokenizers split at a single space between words, so the merge is done once for each distinct unit (a space and what
follows up to the next such space) and the units' groups are laid end to end. A link ties two tokens whose bytes end
together, so one's bytes are the end of the other's: the distinct pairs are bounded by the bytes of both vocabularies,
whatever the corpus. Their counts and maxima are a broadcast table of that bound.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from khata.llm.common import cut, table
from khata.llm.token_counts import _byte_letters

#: Units that a worker remembers in each of two generations; longer ones are not kept. Characters of texts in a block.
MEMO_UNITS, MEMO_LENGTH = 150_000, 64
BLOCK_CHARS = 4 << 20
#: A unit begins at a single space between two characters that are no white space.
_UNIT = re.compile(r"(?<=\S)(?= \S)")
_BYTE_PIECE = re.compile(r"<0x([0-9A-Fa-f]{2})>")
#: A pair of ids as one number: a * SIDE + b.
SIDE = 1 << 20

#: Ids of the texts, tokenized one by one, and the bytes of each id.
Side = tuple[Callable[[list[str]], list[list[int]]], list[bytes]]


def byte_level(path: str) -> Side:
    """A byte-level vocabulary of the tokenizers library; special strings in texts are plain text."""
    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    model.encode_special_tokens = True
    letters = {c: b for b, c in _byte_letters().items()}
    of = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in model.get_vocab(with_added_tokens=True).items()}
    return lambda texts: [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)], [of.get(i, b"") for i in range(max(of) + 1)]


def pieces(path: str) -> Side:
    """A sentencepiece vocabulary with byte fallback, which adds the space before a text itself."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def of(piece: str) -> bytes:
        byte = _BYTE_PIECE.fullmatch(piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    return lambda texts: model.encode([t[1:] for t in texts], num_threads=1), [of(model.id_to_piece(i)) for i in range(model.get_piece_size())]


def merged(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int]]:
    """How many tokens of each side lie before each byte offset at which both sides end one, by two pointers that go
    on together: the groups' bounds. Both lists rise to the same last offset."""
    out, i, j, n, m = [], 0, 0, len(ends_a), len(ends_b)
    while i < n and j < m:
        a, b = ends_a[i], ends_b[j]
        if a == b:
            i += 1
            j += 1
            out.append((i, j))
        elif a < b:
            i += 1
        else:
            j += 1
    return out


#: What a unit adds to its text: n_a, n_b, n_groups, groups (None where a side does not give the unit back), links.
Unit = tuple[int, int, int, str | None, bytes]


class Aligner:
    def __init__(self, first: Side, second: Side):
        (self.encode_a, self.bytes_a), (self.encode_b, self.bytes_b) = first, second
        # Units may be merged alone only if no token runs across the space between them.
        if any(_UNIT.search(x.decode(errors="replace")) for side in (self.bytes_a, self.bytes_b) for x in side):
            raise ValueError("a vocabulary joins words")
        self.names_a, self.names_b = [str(i) for i in range(len(self.bytes_a))], [f"|{i}" for i in range(len(self.bytes_b))]
        self.memo: dict[str, Unit] = {}
        self.older: dict[str, Unit] = {}

    def _unit(self, text: str, a: list[int], b: list[int]) -> Unit:
        raw, parts_a, parts_b = text.encode(), [self.bytes_a[x] for x in a], [self.bytes_b[x] for x in b]
        if b"".join(parts_a) != raw or b"".join(parts_b) != raw:
            return 0, 0, 0, None, b""
        i = j = 0
        groups, links, names_a, names_b = [], array("q"), self.names_a, self.names_b
        for to_i, to_j in merged(list(accumulate(map(len, parts_a))), list(accumulate(map(len, parts_b)))):
            links.append(a[to_i - 1] * SIDE + b[to_j - 1])
            if to_i - i == to_j - j == 1:
                groups.append(names_a[a[i]] + names_b[b[j]])
            else:
                groups.append(f"{','.join(map(str, a[i:to_i]))}|{','.join(map(str, b[j:to_j]))}")
            i, j = to_i, to_j
        return len(a), len(b), len(groups), ";".join(groups), links.tobytes()

    def _learn(self, units: set[str]) -> None:
        # Two generations, so that frequent units outlive the others.
        if len(self.memo) > MEMO_UNITS:
            self.memo, self.older = {}, self.memo
        new = units.difference(self.memo)
        kept = new.intersection(self.older)
        self.memo.update((u, self.older[u]) for u in kept)
        fresh = list(new - kept)
        for i in range(0, len(fresh), 4096):
            some = fresh[i : i + 4096]
            self.memo.update((u, self._unit(u, a, b)) for u, a, b in zip(some, self.encode_a(some), self.encode_b(some)))

    def align(self, texts: list[str]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """n_a, n_b, n_groups, groups, links (pairs of ids) of each text; texts without tokens give zeros."""
        rows = [_UNIT.split(" " + t) if t else [] for t in texts]
        distinct = set().union(*rows)
        self._learn(distinct)
        for row in rows:
            units = [self.memo[u] for u in row]
            if not units:
                yield 0, 0, 0, "", np.zeros(0, dtype=np.int64)
                continue
            n_a, n_b, n_groups, parts, links = zip(*units)
            if None in parts:
                yield 0, 0, 0, "", np.zeros(0, dtype=np.int64)
                continue
            yield sum(n_a), sum(n_b), sum(n_groups), ";".join(parts), np.frombuffer(b"".join(links), dtype=np.int64)
        for u in distinct:
            if len(u) > MEMO_LENGTH:
                del self.memo[u]


@functools.lru_cache(maxsize=2)
def _aligner(first: str, second: str) -> Aligner:
    """One per worker process, so that its memo serves the tasks that follow."""
    return Aligner(byte_level(first), pieces(second))


def align(docs: DataFrame, first: str, second: str, text: str = "text", id_: str = "doc_id", digest: bool = False) -> DataFrame:
    """uid, doc_id, n_a, n_b, n_groups, groups, links (pair: a * SIDE + b, n) of every whole text.

    first: path of a byte-level vocabulary (tokenizers), read with a space before the text; second: of a sentencepiece
    one. groups: `a1,a2|b1;a3|b2,b3`, or its SHA-256 with digest. A text that is null or empty, or whose tokens' bytes
    on either side are not the text's with that space, has no tokens: zeros, '' and no links. Repeated rows each give a
    row, told apart by uid; extra columns are not read. Narrow; memory as a block of texts and the longest one.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner, uid = _aligner(first, second), TaskContext.get().partitionId() << 40
        for frame in frames:
            texts = [t if isinstance(t, str) else "" for t in frame["t"]]
            # A block of texts at a time: within a frame, runs of about BLOCK_CHARS.
            block = np.cumsum([len(t) for t in texts]) // BLOCK_CHARS
            for k in np.unique(block):
                at = np.flatnonzero(block == k)
                rows = list(aligner.align([texts[i] for i in at]))
                found = [np.unique(r[4], return_counts=True) for r in rows]
                groups = [r[3] if not digest or not r[3] else hashlib.sha256(r[3].encode()).hexdigest() for r in rows]
                yield pd.DataFrame({
                    "uid": uid + np.arange(len(at)), "id": frame["id"].iloc[at].to_numpy(), "n_a": [r[0] for r in rows], "n_b": [r[1] for r in rows], "n_groups": [r[2] for r in rows],
                    "groups": groups, "pairs": [f[0] for f in found], "times": [f[1] for f in found],
                })
                uid += len(at)

    source = docs.select(docs[id_].cast("long").alias("id"), docs[text].cast("string").alias("t"))
    out = source.mapInPandas(run, "uid long, id long, n_a long, n_b long, n_groups long, groups string, pairs array<long>, times array<long>")
    links = F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("n"))
    return out.select("uid", F.col("id").alias(id_), "n_a", "n_b", "n_groups", "groups", links.cast("array<struct<pair: long, n: long>>").alias("links"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, a, b, n (links that hold the pair, over the corpus), most_a and most_b (the highest n of its a, of its b)."""
    counts = aligned.select(F.explode("links").alias("x")).groupBy("x.pair").agg(F.sum("x.n").alias("n"))
    counts = counts.select("pair", F.floor(F.col("pair") / SIDE).alias("a"), (F.col("pair") % SIDE).alias("b"), "n")
    most_a = counts.groupBy("a").agg(F.max("n").alias("most_a"))
    most_b = counts.groupBy("b").agg(F.max("n").alias("most_b"))
    return counts.join(most_a, "a").join(most_b, "b")


def most_pairs(first: str, second: str) -> int:
    """How many distinct pairs there can be: one token's bytes end the other's, so each token has, on the other side, one
    partner a length at most among its own ends, or two where a byte has a piece of its own."""
    return 2 * sum(len(x) for side in (byte_level(first), pieces(second)) for x in side[1])


def scored(aligned: DataFrame, counts: DataFrame, most: int, id_: str = "doc_id") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of every row of align(): its links among the corpus.

    counts: a written table of pair_counts(); most: the bound of its rows (see most_pairs), checked before it is sent to
    all executors. A row's links are summed where they are, so only a row a document is shuffled.
    """
    if counts.count() > most:
        raise ValueError("more pairs than two vocabularies can have")
    known = counts.select("pair", F.col("n").alias("count"), F.col("most_b"))
    each = aligned.select("uid", F.explode("links").alias("x")).select("uid", "x.pair", "x.n").join(F.broadcast(known), "pair")
    n = F.col("n")
    sums = each.groupBy("uid").agg(F.sum("n").alias("n_links"), F.sum(F.when(F.col("count") == F.col("most_b"), n).otherwise(0)).alias("n_best"), F.sum(n * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return aligned.drop("links").join(sums, "uid", "left").select(id_, "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), "groups")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligned = cut(align(table(spark, sf_dir, "documents"), *files, digest=True))
    return scored(aligned, cut(pair_counts(aligned)), most_pairs(*files)).withColumnRenamed("groups", "groups_sha256")

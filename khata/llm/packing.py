"""Packing token sequences: Karmarkar-Karp multiway differencing over blocks of pieces.

A text's tokens are cut at every window; what is left of it is cut into pieces of at most CUT tokens. A task gathers
pieces until they nearly fill WINDOWS windows, and deals them by differencing: partial partitions, one sum a window, are
merged two at a time, those of the greatest imbalance first, the largest sums of one with the smallest of the other.
The windows come out nearly equal; while one holds more than its capacity, their number rises by one. What a task has
left at its end is cut at powers of two, which need no padding. Nothing is shuffled.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from khata.llm.common import as_bytes, chunks, table
from khata.llm.token_counts import BLOCK_BYTES, ENCODE_BYTES, MEMO_LENGTH, MEMO_PIECES, _CUTS, _byte_letters

WINDOW = 2048
#: Windows that are dealt together, tokens that a window of a block is left short, and the longest piece of a remainder.
WINDOWS, SLACK, CUT = 64, 24, 512
#: Token after every text.
END = 1
_BYTES = 4


#: A piece on a line of its own, ASCII letters in lower case: letters and punctuation (see token_counts), or anything.
_LINES = re.compile(rb"([a-z]*+(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][a-z]*+)*+)([!-&(-/:;=>?@\[-`{-~]*+)\n|[^\n]*\n")


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, by the vocabulary's library.

    The vocabulary must be of the kind of word_bpe_49k.json: lower case, white space dropped, letter runs, single digits
    and runs of other characters apart, a mark on each run's last token. Then ids add up over white-space pieces, and
    over the letters and the punctuation of a plain one; a long piece is cut at its digits. A block's distinct pieces
    are found and put in their places by Arrow; those not seen before go to the library together.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.runs_only = Tokenizer(self.tokenizer.model)
        self.runs_only.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()} | {" ": " "})
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(names.values()) + 1, dtype=bool)
        self.last[[i for name, i in names.items() if name.endswith(self.tokenizer.model.end_of_word_suffix)]] = True
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.runs: dict[bytes, bytes] = {b"": b""}

    def _runs(self, runs: list[bytes]) -> None:
        for _, some in chunks(runs, ENCODE_BYTES):
            joined = b" ".join(some).decode().lower().encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.runs_only.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (_BYTES * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) != len(some):
                raise ValueError("the vocabulary does not mark the last token of each run")
            flat = ids.tobytes()
            self.runs.update((run, flat[i:j]) for run, i, j in zip(some, [0, *ends], ends))

    def _whole(self, pieces: list[bytes]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces that are not remembered."""
        if len(self.runs) > MEMO_PIECES:
            self.runs = {b"": b""}
        split = _LINES.findall(b"\n".join([*pieces, b""]).lower())
        rest = [i for i, ((head, tail), piece) in enumerate(zip(split, pieces)) if not (head or tail) or len(piece) > MEMO_LENGTH]
        for i in rest:
            split[i] = (b"", b"")
        self._runs(list(set().union(*split).difference(self.runs)))
        known = self.runs
        out = [known[head] + known[tail] for head, tail in split]
        parts = [_CUTS.findall(p) if len(p) > MEMO_LENGTH else [p] for p in map(pieces.__getitem__, rest)]
        flat: list[bytes] = []
        for _, some in chunks([x for p in parts for x in p], ENCODE_BYTES):
            flat += self._whole(some)
        at = 0
        for i, p in zip(rest, parts):
            out[i] = b"".join(flat[at : at + len(p)])
            at += len(p)
        return out

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        # Two generations, so that frequent pieces outlive the others.
        if len(self.memo) > MEMO_PIECES // 2:
            self.memo, self.older = {}, self.memo
        out = list(map(self.memo.get, pieces))
        older = self.older.get
        missed = [i for i, ids in enumerate(out) if ids is None]
        new = []
        for i in missed:
            ids = out[i] = older(pieces[i])
            if ids is None:
                new.append(i)
        for i, ids in zip(new, self._learn([pieces[i] for i in new])):
            out[i] = ids
        self.memo.update((pieces[i], out[i]) for i in missed if len(pieces[i]) <= MEMO_LENGTH)
        return out

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        for _, block in chunks(texts, BLOCK_BYTES):
            words = pc.ascii_split_whitespace(pa.array(block, pa.large_string()))
            found = words.values.dictionary_encode()
            ids = pa.array(self._ids(found.dictionary.cast(pa.large_binary()).to_pylist()), pa.large_binary()).take(found.indices)
            _, ends, data = ids.buffers()
            at = np.frombuffer(ends, dtype=np.int64)[words.offsets.to_numpy()].tolist()
            flat = memoryview(data or b"")
            for i, j in zip(at, at[1:]):
                yield flat[i:j].tobytes()


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One per worker process, so that its memo serves the tasks that follow."""
    return Encoder(path)


def differenced(sizes: list[int], ways: int) -> tuple[int, list[list[int]]]:
    """(largest sum, items of each way) of a partition of the sizes into `ways`, by multiway differencing."""
    n = len(sizes)
    after = np.full(n, -1)
    heap = []
    for i, size in enumerate(sizes):
        sums, head = np.zeros(ways, dtype=np.int64), np.full(ways, -1)
        sums[0], head[0] = size, i
        heap.append((-size if ways > 1 else 0, i, sums, head, head.copy()))
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        _, _, sums, head, tail = heapq.heappop(heap)
        _, _, other, head2, tail2 = heap[0]
        # Sums fall in the one and rise in the other.
        sums, head2, tail2 = sums + other[::-1], head2[::-1], tail2[::-1]
        both = (head >= 0) & (head2 >= 0)
        after[tail[both]] = head2[both]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        tail = np.where(tail2 >= 0, tail2, tail)[order]
        head = np.where(head >= 0, head, head2)[order]
        heapq.heapreplace(heap, (int(sums[-1] - sums[0]), made, sums, head, tail))
        made += 1
    if not heap:
        return 0, [[] for _ in range(ways)]
    _, _, sums, head, _ = heap[0]
    out = []
    for at in head.tolist():
        items = []
        while at >= 0:
            items.append(at)
            at = int(after[at])
        out.append(items)
    return int(sums[0]), out


def partition(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items of nearly equal windows, as few as hold them: their number rises while one exceeds the capacity."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        largest, out = differenced(sizes, ways)
        if largest <= capacity:
            return [w for w in out if w]
        ways += 1


Piece = tuple[int, int, bytes]


class Packer:
    """Pieces (document row, start, ids) of one task into sequences."""

    def __init__(self, window: int, windows: int, slack: int, first: int):
        self.window, self.windows, self.slack, self.next = window, windows, min(slack, window - 1), first
        self.held: list[Piece] = []
        self.size = 0

    def _sequence(self, pieces: list[Piece]) -> Iterator[tuple]:
        at = 0
        for row, start, ids in pieces:
            yield row, start, ids, self.next, at
            at += len(ids) // _BYTES
        self.next += 1

    def _take(self, size: int) -> list[Piece]:
        """The held pieces up to `size` tokens, the last one cut there."""
        out = []
        while size:
            row, start, ids = self.held[len(out)]
            if len(ids) > _BYTES * size:
                self.held[len(out)] = (row, start + size, ids[_BYTES * size :])
                ids, size = ids[: _BYTES * size], 0
                self.held.insert(len(out), (row, start, ids))
            else:
                size -= len(ids) // _BYTES
            out.append((row, start, ids))
        del self.held[: len(out)]
        self.size -= sum(len(p[2]) for p in out) // _BYTES
        return out

    def _block(self, windows: int) -> Iterator[tuple]:
        """So many windows' tokens, less the slack, dealt by differencing."""
        pieces = self._take(windows * (self.window - self.slack))
        for items in partition([len(p[2]) // _BYTES for p in pieces], self.window):
            yield from self._sequence([pieces[i] for i in items])

    def add(self, row: int, ids: bytes, cut: int) -> Iterator[tuple]:
        n, start = len(ids) // _BYTES, 0
        while n - start >= self.window:
            yield from self._sequence([(row, start, ids[_BYTES * start : _BYTES * (start + self.window)])])
            start += self.window
        self.size += n - start
        while start < n:
            end = min(n, start + cut)
            self.held.append((row, start, ids[_BYTES * start : _BYTES * end]))
            start = end
        while self.size >= self.windows * self.window:
            yield from self._block(self.windows)

    def finish(self) -> Iterator[tuple]:
        """The rest: whole windows, then sequences of the powers of two that its length is the sum of."""
        if self.size >= self.window:
            yield from self._block(self.size // self.window)
        while self.size:
            yield from self._sequence(self._take(1 << (self.size.bit_length() - 1)))


def pack(docs: DataFrame, vocabulary: str, text: str = "text", id_: str = "doc_id", end: int = END, window: int = WINDOW, windows: int = WINDOWS, slack: int = SLACK, cut: int = CUT) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset of every piece.

    A document is its text's ids and then `end`; each id lies in one piece. A sequence holds at most `window` tokens and
    is to be padded to it, unless its length is a power of two. A null or empty text is the end token alone. Repeated
    rows and null ids are packed as rows of their own, extra columns are not read, an empty table gives no row.
    sequence_id holds the task's number in its upper bits: a task that is run again over the same rows gives the same.
    Memory: a block of windows and the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, stop = _encoder(vocabulary), np.array([end], dtype="<u4").tobytes()
        packer = Packer(window, windows, slack, TaskContext.get().partitionId() << 32)
        ids, tokens, base, rows = [], [], 0, []

        def flush() -> pa.RecordBatch:
            row, start, piece, sequence, offset = zip(*rows)
            sizes = [len(p) // _BYTES for p in piece]
            columns = [pa.array([ids[r - base] for r in row], pa.int64()), pa.array(start, pa.int64()), pa.array(sizes, pa.int64()), pa.array(piece, pa.binary()), pa.array([tokens[r - base] for r in row], pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=[id_, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            # Of documents that are out only those with pieces still held are remembered: rows that name others go first.
            if rows:
                yield flush()
                rows = []
            oldest = packer.held[0][0] if packer.held else base + len(ids)
            ids, tokens, base = ids[oldest - base :], tokens[oldest - base :], oldest
            ids += batch.column(0).to_pylist()
            for encoded in encoder.encode(as_bytes(batch.column(1))):
                tokens.append(len(encoded) // _BYTES + 1)
                rows += packer.add(base + len(tokens) - 1, encoded + stop, cut)
                if len(rows) >= 1024:
                    yield flush()
                    rows = []
        rows += packer.finish()
        if rows:
            yield flush()

    source = docs.select(docs[id_].cast("long").alias(id_), docs[text].cast("string").alias(text))
    return source.mapInArrow(run, f"{id_} long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

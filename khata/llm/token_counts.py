"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries (ASCII white space, where the tokenizer splits words in any case), so no long text
is encoded whole; a long piece without any is cut at its digits. The distinct pieces of a byte-balanced block of rows are
encoded together and only their lengths are kept; a bounded memo serves pieces seen before.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from khata.llm.common import as_bytes, chunks, table

#: Bytes of text in a block, and of new pieces in one call of the encoder.
BLOCK_BYTES = 4 << 20
ENCODE_BYTES = 256 << 10
#: Distinct pieces that a worker remembers before it starts afresh; longer pieces are not kept.
MEMO_PIECES = 600_000
MEMO_LENGTH = 128
LIMIT_TOKENS = 2048


def _encoder(path: str):
    """piece list -> token counts, by the library of the vocabulary file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


#: Latin letters, then ASCII punctuation that the word tokenizer takes as one run. The apostrophe (contractions) and
#: the opener of special strings are left to the whole tokenizer, as is any longer piece.
_PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]){0,64})([!-&(-/:;=>?@\[-`{-~]{0,64})")


_CUTS = re.compile(rb"[0-9]|[^0-9]+")


def _byte_letters() -> dict[int, str]:
    """The usual byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Counter:
    """Counts of texts by the vocabulary's library.

    words: the tokenizer lower-cases, drops white space and splits letter runs from punctuation, so counts add up over
    white-space pieces, and a plain piece (Latin letters, then ASCII punctuation) over its two runs; its byte-pair
    model takes those runs directly. Any other piece goes through the whole tokenizer. Other vocabularies take whole texts.
    """

    def __init__(self, path: str):
        self.memo: dict[bytes, int] = {}
        self.runs: dict[bytes, int] = {}
        self.whole = _encoder(path)
        self.words = self.special = False
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
            pattern = next((s.get("pattern", {}).get("Regex", "") for s in steps if s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert")), "")
            normal = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
            self.words = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in pattern and "NFC" in normal and "Lowercase" in normal and all(x["content"].startswith("<") and not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in spec["added_tokens"])
            self.model = Tokenizer.from_file(path).model if self.words else None
            self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})

    def run(self, run: bytes) -> int:
        n = self.runs[run] = len(self.model.tokenize(run.decode().lower().encode().decode("latin-1").translate(self.letters)))
        return n

    def learn(self, new: set[bytes]) -> dict[bytes, int]:
        """Counts of pieces: runs by the model, the rest in encoder calls of about ENCODE_BYTES."""
        found, rest, plain = {}, [], _PLAIN.fullmatch
        if len(self.runs) > MEMO_PIECES:
            self.runs = {}
        known, run = self.runs.get, self.run
        for piece in new:
            match = plain(piece)
            if match is None:
                rest.append(piece)
                continue
            head, tail = match.groups()
            n = 0
            if head:
                head = head.lower()
                n = known(head) or run(head)
            if tail:
                n += known(tail) or run(tail)
            found[piece] = n
        # Digits are tokens of their own, so a long piece is cut at them.
        cuts = [_CUTS.findall(p) if len(p) > MEMO_LENGTH else [p] for p in rest]
        flat: list[int] = []
        for _, part in chunks([x for c in cuts for x in c], ENCODE_BYTES):
            flat += self.whole([p.decode("utf-8") for p in part])
        at = 0
        for piece, c in zip(rest, cuts):
            found[piece] = sum(flat[at : at + len(c)])
            at += len(c)
        return found

    def counts(self, texts: list[bytes]) -> list[int]:
        out: list[int] = []
        for _, block in chunks(texts, BLOCK_BYTES):
            if not self.words:
                for _, part in chunks(block, ENCODE_BYTES):
                    out += self.whole([t.decode("utf-8") for t in part])
                continue
            pieces = [t.split() for t in block]
            distinct = set().union(*pieces)
            if len(self.memo) > MEMO_PIECES:
                self.memo = {}
            self.memo |= self.learn(distinct.difference(self.memo))
            out += [sum(map(self.memo.__getitem__, row)) for row in pieces]
            for p in distinct:
                if len(p) > MEMO_LENGTH:
                    del self.memo[p]
        return out


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> _Counter:
    """One per worker process, so that its memo serves the tasks that follow."""
    return _Counter(path)


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", id_: str = "doc_id", limit: int = LIMIT_TOKENS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every whole text; no shuffle, one narrow pass.

    vocabulary: path of a .json (tokenizers) or .model (sentencepiece) file, read by the workers. A null or empty text
    has 0 bytes and 0 tokens. Special strings inside texts count as the library counts them by default. Repeated rows
    each give a row; extra columns are not read. Where the tokenizer keeps white space, texts are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in batches:
            texts = as_bytes(batch.column(1))
            tokens = counter.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())],
                names=[id_, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(docs[id_].cast("long").alias(id_), docs[text].cast("string").alias(text)).mapInArrow(run, f"{id_} long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

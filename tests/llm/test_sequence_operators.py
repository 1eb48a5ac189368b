"""Periodic runs, packing and token alignment against brute force."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from khata.llm import packing, periodic_runs, token_alignment
from khata.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_by_definition(w, least=6, times=4):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, times * q) and all(any(w[k] != w[k + p] for k in range(s, i + q - p)) for p in range(1, q)):
                out.append((s, i + q - s, q))
    return sorted(out)


def test_runs_of_random_words_against_the_definition():
    rng = random.Random(5)
    for _ in range(1500):
        n = rng.choice([5, 6, 20, 60, 150])
        w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            p, a = rng.randrange(1, max(2, n // 5)), rng.randrange(n)
            for i in range(a + p, min(n, a + rng.randrange(1, n - a + 1))):
                w[i] = w[i - p]
        assert periodic_runs.find_runs(np.array(w)) == runs_by_definition(w)
    with pytest.raises(ValueError):
        periodic_runs.find_runs(np.zeros(9, int), times=2)


def test_long_loops_take_linear_time():
    n = 300_000
    loops = np.concatenate([np.arange(n) % 7, np.zeros(n, int), 9 + np.arange(n) % (n // 5)])
    assert periodic_runs.find_runs(loops) == [(0, n, 7), (n - 1, n + 1, 1), (2 * n, n, n // 5)]


def test_op11_against_the_contract(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert set(got) == set(docs)
    some = 0
    for doc_id, text in docs.items():
        w = WORD.findall(text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        runs = runs_by_definition(w)
        kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + length for s, length, q in runs)]
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
        r, some = got[doc_id], some + len(runs)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()
    assert some


ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "a " * 400), (4, "a " * 400), (None, "x y " * 9), (5, "é é é é é é b"), (6, "word"), (7, "  " * 8), (8, "q" * 300_000), (9, "1a-" * 40_000)]


def test_runs_of_odd_rows(spark):
    df = spark.createDataFrame([(*r, 0) for r in ODD], "doc_id long, text string, runs int")
    rows = periodic_runs.periodic_runs(df).collect()
    got = Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"][:9]) for r in rows)
    assert got == Counter([(1, 0, (), ""), (2, 0, (), ""), (3, 0, (), ""), *[(4, 400, ((0, 400, 1),), "a")] * 2, (None, 18, ((0, 18, 2),), "x y"), (5, 7, ((0, 6, 1),), "é b"), (6, 1, (), "word"), (7, 8, ((0, 8, 1),), " "), (8, 1, (), "q" * 9), (9, 1, (), "1a-1a-1a-")])
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


def test_differencing_is_a_partition_and_nearly_equal():
    rng = random.Random(3)
    for n, ways in ((0, 2), (1, 3), (7, 3), (300, 40), (50, 1)):
        sizes = [rng.randrange(1, 500) for _ in range(n)]
        largest, out = packing.differenced(sizes, ways)
        assert sorted(i for w in out for i in w) == list(range(n)) and len(out) == ways
        sums = [sum(sizes[i] for i in w) for w in out]
        assert largest == max(sums)
        if n == 300:
            assert max(sums) - min(sums) < 150
    # The number of windows rises where the fewest do not hold the items.
    out = packing.partition([6, 6, 6], 10)
    assert len(out) == 3 and sorted(i for w in out for i in w) == [0, 1, 2]


def check_packed(rows, docs, most_padding):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(docs)
    for doc_id, text in docs.items():
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = total = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        total, padding = total + at, padding + (0 if at & (at - 1) == 0 else 2048 - at)
    assert padding <= most_padding * total


def test_op12_against_the_library(spark):
    sf = SF.replace("0.001", "0.01")
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check_packed(QUERIES["op12_packing"](spark, sf).collect(), docs, 0.03)


def test_packing_over_many_batches_of_one_task(spark):
    from pyspark.sql import functions as F

    texts = {i: "word " * (i * 7 % 900) for i in range(600)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        check_packed(packing.pack(df, public_tokenizers.path("word_bpe_49k.json")).withColumn("ids_crc32", F.crc32("ids")).collect(), texts, 0.03)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_packing_of_odd_rows(spark):
    from pyspark.sql import functions as F

    texts = {1: None, 2: "", 3: "a", 4: "x" * 50_000, 5: "1a-" * 3000, 6: "it's <|endoftext|> don't''s n'T <|startoftext|>5", 7: "  É é 日本語 ｆ", 8: "word " * 6000}
    df = spark.createDataFrame([(i, t, 7) for i, t in texts.items()], "doc_id long, text string, start int").coalesce(1)
    rows = packing.pack(df, public_tokenizers.path("word_bpe_49k.json")).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_packed(rows, texts, 0.03)
    again = packing.pack(df.unionByName(df).union(df.withColumn("doc_id", F.lit(None).cast("long"))), public_tokenizers.path("word_bpe_49k.json"))
    assert again.agg(F.sum("length")).first()[0] == 3 * sum(r["length"] for r in rows)
    assert packing.pack(df.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def aligned_by_definition(docs):
    """The contract's row of each document, by sets of ends."""
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    a_model, b_model = Tokenizer.from_file(files[0]), sentencepiece.SentencePieceProcessor(model_file=files[1])
    a_model.encode_special_tokens = True
    bytes_a, bytes_b = token_alignment.byte_level(files[0])[1], token_alignment.pieces(files[1])[1]
    found, count, best = {}, Counter(), Counter()
    for i, (key, text) in enumerate(docs):
        a, b = (a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if b"".join(bytes_a[x] for x in a) != whole or b"".join(bytes_b[x] for x in b) != whole:
            a, b = [], []
        ends_a = {e: k + 1 for k, e in enumerate(np.cumsum([len(bytes_a[x]) for x in a]).tolist())}
        ends_b = {e: k + 1 for k, e in enumerate(np.cumsum([len(bytes_b[x]) for x in b]).tolist())}
        at = [0, 0]
        groups, links = [], []
        for e in sorted(set(ends_a) & set(ends_b)):
            groups.append(f"{','.join(map(str, a[at[0] : ends_a[e]]))}|{','.join(map(str, b[at[1] : ends_b[e]]))}")
            at = [ends_a[e], ends_b[e]]
            links.append((a[at[0] - 1], b[at[1] - 1]))
        count.update(links)
        found[i] = (key, len(a), len(b), groups, links)
    for (x, y), n in count.items():
        best[y] = max(best[y], n)
    return Counter((key, n_a, n_b, len(g), len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for key, n_a, n_b, g, ls in found.values())


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_op13_against_the_definition(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = Counter(tuple(r[c] for c in NAMES) for r in QUERIES["op13_token_alignment"](spark, SF).collect())
    assert got == aligned_by_definition(docs)


def test_alignment_of_odd_rows(spark, tmp_path):
    texts = [None, "", " ", "a", " a", "a ", "  a  b ", "x\n\ny \t z\r\n", "ﬁ é é", "▁a b", "a▁b c", "a\x00b", "日本 語", "<|endoftext|> a <s> b </s>", "<unk> a <0x0A> b", "don't 've  it's 12345 67", "😀 😀😀", "     x", "\x1c a \x1d b", "z" * 20_000, "word " * 3000]
    docs = [(i % 15, t) for i, t in enumerate(texts)] + [(None, "the end"), (3, "a")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r[c] for c in NAMES) for r in QUERIES["op13_token_alignment"](spark, str(tmp_path)).collect())
    want = aligned_by_definition(docs)
    assert got == want and sum(w[1] == 0 for w in want.elements()) >= 4
    df.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert QUERIES["op13_token_alignment"](spark, str(tmp_path / "none")).count() == 0


def test_new_pieces_go_to_the_library_together():
    """Before, each distinct run of letters or punctuation was a call of its own."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnoprstuvwéß", k=9)) for _ in range(20_000)]
    texts = [" ".join(words[i : i + 400]).encode() for i in range(0, len(words), 400)]
    encoder, calls = packing.Encoder(public_tokenizers.path("word_bpe_49k.json")), Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([arg.__name__]) if event == "c_call" else None)
    try:
        got = list(encoder.encode(texts))
    finally:
        sys.setprofile(None)
    assert 0 < calls["tokenize"] + calls["encode"] + calls["encode_batch"] + calls["encode_batch_fast"] < 100
    want = encoder.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)
    assert got == [np.array(x.ids, dtype="<u4").tobytes() for x in want]


def test_ids_of_odd_pieces_against_the_library():
    rng = random.Random(9)
    letters = ["a", "B", "é", "É", "ß", "ÿ", "×", "÷", "İ", "ſ", "é", "日", "1", "²", "'", "'s", "<", "|", "-", "...", "\x1c", "\x85", "\xa0", " ", "😀", " ", "\n", "\x0b", "\x00", "z" * 130, "!" * 130]
    texts = [None, "", " ", "\n a", "a\n", *("".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(3000))]
    encoder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(2):
        got = list(encoder.encode([(t or "").encode() for t in texts]))
        assert got == [np.array(x.ids, dtype="<u4").tobytes() for x in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]

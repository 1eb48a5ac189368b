"""Dealt operators on documents against brute force, with nulls, empty and long texts, repeated rows and odd columns."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from khata.llm import anchors, decontamination, minhash_dedup, mixing, substring_dedup, suffix_array, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = "uid long, id string, row long, seed long, key string, spans string, component long, _text string, score double, n long, sig string, size long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def texts(seed: int = 1) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["été", "naïve", "Ünder"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = prose(30)
    out: list[tuple[int, str | None]] = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "a" * 300), (7, "ab " * 200)]
    base = prose(80)
    for i in range(10, 22):
        words = base.split()
        for _ in range(i - 10):
            words[rng.randrange(len(words))] = "changed"
        out.append((i, " ".join(words)))
    out += [(i, prose(20) + " " + shared + "\n" + prose(15)) for i in range(30, 36)]
    out += [(40, base), (41, base), (42, prose(6_000)), (43, "x y " + shared)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None if i and i % 3 == 0 else "s" + str((i or 0) % 4), None, *[None] * 12) for i, t in rows], SCHEMA)


def words_gone(rows, window):
    seen, gone = set(), {}
    for i, text in sorted(rows):
        words = WORD.findall(text or "")
        flags = [False] * len(words)
        for p in range(len(words) - window + 1):
            w = tuple(words[p : p + window])
            if w in seen:
                flags[p : p + window] = [True] * window
            seen.add(w)
        gone[i] = (len(words), sum(flags), hashlib.sha256(" ".join(w for w, f in zip(words, flags) if not f).encode()).hexdigest())
    return gone


def bytes_gone(rows, window):
    count = defaultdict(int)
    for _, text in rows:
        t = (text or "").encode()
        for p in range(len(t) - window + 1):
            count[t[p : p + window]] += 1
    out = {}
    for i, text in rows:
        t = (text or "").encode()
        flags = bytearray(len(t))
        for p in range(len(t) - window + 1):
            if count[t[p : p + window]] > 1:
                flags[p : p + window] = b"\1" * window
        kept = bytes(b for b, f in zip(t, flags) if not f)
        out[i] = (len(t), sum(flags), len(re.findall(b"\1+", bytes(flags))), hashlib.sha256(kept).hexdigest())
    return out


def shingle_set(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*(words[j:] for j in range(k)))) if len(words) >= k else frozenset([tuple(words)] if words else [])


def near_components(rows, k):
    sets = {i: shingle_set(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


@pytest.mark.parametrize("window,seed", [(5, 3), (20, 8)])
def test_substring_dedup(spark, window, seed):
    rows = texts()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup_substrings(frame(spark, rows), window, seed).collect()}
    assert got == words_gone(rows, window)


@pytest.mark.parametrize("window,seed,hot", [(40, 8, 5_000), (40, 8, 2), (400, 64, 5_000)])
def test_suffix_array(spark, monkeypatch, window, seed, hot):
    monkeypatch.setattr(anchors, "LEAST_HOT", hot)
    rows = texts()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_array.remove_repeats(frame(spark, rows), window, seed).collect()}
    assert got == bytes_gone(rows, window)


def test_suffix_array_splits_large_groups(spark):
    rng = random.Random(5)
    core = "".join(rng.choice("abcdef") for _ in range(30))
    rows = [(i, "".join(rng.choice("ab") for _ in range(20)) + core + "".join(rng.choice("ab") for _ in range(20))) for i in range(60)]
    docs = suffix_array.with_uid(frame(spark, rows), "doc_id", "text").select("uid", "text")
    spans = {r["uid"]: r["spans"] for r in suffix_array.repeat_spans(docs, 40, 8, group=10).collect()}
    want = bytes_gone(rows, 40)
    for i, text in rows:
        gone = sum(b - a for a, b in suffix_array.merged_spans(suffix_array.np.array(spans[i]), 40)) if i in spans else 0
        assert gone == want[i][1]


@pytest.mark.parametrize("shingle", [2, 5])
def test_minhash_dedup(spark, shingle):
    rows = texts()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(frame(spark, rows), shingle).collect()}
    assert got == near_components(rows, shingle)


def test_minhash_tiles(spark, monkeypatch):
    """Buckets over many tiles: many near copies of one text."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randrange(12)):
            words[rng.randrange(150)] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(minhash_dedup, "TILE", 30)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(frame(spark, rows), 2).collect()}
    assert got == near_components(rows, 2)


def half_similar(n: int, length: int = 60, own: int = 8) -> list[tuple[int, str]]:
    """Texts of one stock of words with words of their own: most pairs are within the radius, none is a link."""
    rng = random.Random(4)
    rows = []
    for i in range(n):
        words = [f"w{j}" for j in range(length)]
        for j in rng.sample(range(length), own):
            words[j] = f"own{i}x{j}"
        rows.append((i, " ".join(words)))
    return rows


def test_minhash_dense_groups(spark, monkeypatch):
    """Groups compared tile by tile, with many tiles of either kind: near copies of two stocks beside half-similar texts."""
    rng = random.Random(6)
    rows = half_similar(40)
    for i in range(60):
        words = rows[i % 2][1].split()
        for j in rng.sample(range(60), rng.randrange(12)):
            words[j] = f"x{rng.randrange(30)}"
        rows.append((100 + i, " ".join(words)))
    monkeypatch.setattr(minhash_dedup, "DENSE", 0)
    monkeypatch.setattr(minhash_dedup, "TILE", 20)
    monkeypatch.setattr(minhash_dedup, "TILE_BYTES", 30_000)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(frame(spark, rows), 1).collect()}
    assert got == near_components(rows, 1)


def test_minhash_rows_of_a_half_similar_group(spark):
    """5,000 half-similar texts have over a million pairs within the radius; what leaves the tiles grows with the texts."""
    docs = minhash_dedup.with_uid(frame(spark, half_similar(5_000)), "doc_id", "text").select("uid", "text")
    sigs = minhash_dedup.cut(minhash_dedup.features(docs, 1)).select("uid", F.col("uid").alias("c"), "n", "sig")
    keys = sigs.select("uid", "sig").mapInArrow(minhash_dedup._keys, "key long, place byte, uid long")
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = minhash_dedup.cut(minhash_dedup.meetings(keys.join(shared, "key"), sigs, 80))
    assert met.where("dense").count() > 0
    assert met.count() < 100 * 5_000
    assert minhash_dedup.group_links(minhash_dedup.components(met.where("dense").select("a", "b")), sigs, docs, 1, 80).count() == 0


def test_keep_one_judges_each_text_of_an_id(spark):
    text = "one two three four five six seven eight nine"
    docs = frame(spark, [(1, text), (2, text), (2, "other words that nobody else has written down here"), (3, None), (3, None)])
    kept = sorted((r["doc_id"], r["text"] or "") for r in minhash_dedup.keep_one(docs).collect())
    assert kept == [(1, text), (2, "other words that nobody else has written down here"), (3, "")]


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words than those"), (None, "a b c d e f"), (None, None)]
    docs = frame(spark, rows)
    assert substring_dedup.dedup_substrings(docs, 3, 2).count() == 5
    assert suffix_array.remove_repeats(docs, 5, 3).count() == 5
    assert minhash_dedup.near_duplicates(docs).count() == 5
    assert mixing.mix(docs).count() == 5
    assert minhash_dedup.keep_one(docs).columns == docs.columns


def test_empty_tables(spark):
    docs = frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (substring_dedup.dedup_substrings(docs), suffix_array.remove_repeats(docs), suffix_array.strip_repeats(docs), minhash_dedup.near_duplicates(docs), minhash_dedup.keep_one(docs), mixing.mix(docs), decontamination.find_leaks(docs, bench), decontamination.drop_leaks(docs, bench)):
        assert df.count() == 0
    assert decontamination.find_leaks(frame(spark, texts()), bench).count() == 0


def test_strip_repeats_keeps_characters_and_columns(spark):
    rows = [(1, "ééé" * 30 + "one"), (2, "ééé" * 30 + "two"), (3, None)]
    out = suffix_array.strip_repeats(frame(spark, rows), 50, 16)
    assert out.columns == frame(spark, rows).columns
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    # The first text's own windows repeat from its second letter on.
    assert got == {1: ("éone", 4), 2: ("two", 3), 3: (None, None)}


@pytest.mark.parametrize("group", [20_000, 3])
def test_strip_repeats_keeps_the_first(spark, monkeypatch, group):
    """Against brute force: a window goes where an equal one starts before, in a smaller id or earlier in the text."""
    rows = [(i, t and t.encode("ascii", "replace").decode()) for i, t in texts() if i != 42]
    seen, want = set(), {}
    for i, text in sorted(rows):
        flags = bytearray(len(text or ""))
        for p in range(len(text or "") - 39):
            if text[p : p + 40] in seen:
                flags[p : p + 40] = b"\1" * 40
            seen.add(text[p : p + 40])
        want[i] = text if text is None else "".join(c for c, f in zip(text, flags) if not f)
    spans = suffix_array.repeat_spans
    monkeypatch.setattr(suffix_array, "repeat_spans", lambda *a, **k: spans(*a, **{**k, "group": group}))
    assert {r["doc_id"]: r["text"] for r in suffix_array.strip_repeats(frame(spark, rows), 40, 8).collect()} == want


def test_token_counts_match_the_library(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [*texts(), (90, "It's <|endoftext|> naïve!!  1234 中文 don't stop"), (91, "z" * 5_000)]
    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    want = {i: (len((t or "").encode()), n := len(whole.encode(t or "", add_special_tokens=False)), n > 2048) for i, t in rows}
    assert {r["doc_id"]: tuple(r)[1:] for r in token_counts.count_tokens(frame(spark, rows), path).collect()} == want


def test_mixing_meets_targets(spark):
    rows = [r for r in texts() if r[0] != 42]
    docs = frame(spark, rows)
    out = [r.asDict() for r in mixing.mix(docs, block_words=64, shard_words=300).collect()]
    size = {i: len(WORD.findall(t or "")) for i, t in rows}
    source = {i: None if i % 3 == 0 else "s" + str(i % 4) for i, _ in rows}
    assert {r["doc_id"]: r["size"] for r in out} == size
    order = sorted(set(source.values()) - {None}) + [None]
    total = {s: sum(size[i] for i in size if source[i] == s) for s in order}
    weight, target = dict(zip(order, [5, 2, 1, 5, 2, 1, 5])), {}
    free, left = list(order), float(sum(total.values()))
    while free:  # water filling
        level = left / sum(weight[s] for s in free)
        capped = [s for s in free if weight[s] * level > 3 * total[s]]
        target |= {s: 3.0 * total[s] if s in capped else weight[s] * level for s in capped or free}
        left -= sum(3.0 * total[s] for s in capped)
        free = [s for s in free if s not in capped] if capped else []
    taken = defaultdict(int)
    for r in out:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        assert r["source_size"] == total[s] and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 3 * r["size"]
        assert sum(min(r["size"], r["taken"] - k * r["size"]) for k in range(len(r["shards"]))) == r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    again = {r["doc_id"]: (r["taken"], r["shards"]) for r in mixing.mix(docs, block_words=64, shard_words=300).collect()}
    assert again == {r["doc_id"]: (r["taken"], r["shards"]) for r in out}


def test_decontamination_retrieves_all_above_threshold(spark):
    rng = random.Random(9)
    words = [f"t{i}" for i in range(400)]
    item = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, f"Question: {item(25)}? Answer: {item(12)}") for k in range(20)] + [(77, "too short"), (78, None), (None, item(20))]
    clean = [(i, item(300)) for i in range(100, 140)]
    leaked = [(200 + k, item(150) + " " + items[k][1].upper() + " " + item(150)) for k in range(20)]
    docs = frame(spark, [*clean, *leaked, *texts(), (300, item(20_000) + " " + items[0][1])])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs, bench).collect()}
    assert got == {(200 + k, k) for k in range(20)} | {(300, 0)}
    kept = {r["doc_id"] for r in decontamination.drop_leaks(docs, bench).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()} - {d for d, _ in got}


def test_decontamination_of_short_and_long_items(spark):
    """Short items by their exact words; of a long item any quote of 60 words, wherever its pieces are cut."""
    rng = random.Random(12)
    words = [f"t{i}" for i in range(3_000)]
    long = [rng.choice(words) for _ in range(400)]
    bench = spark.createDataFrame([(1, "Who wrote it? Ann Lee"), (2, " ".join(long)), (3, "..."), (4, "t1 t2 t1")], "item_id long, text string")
    rows = [(k, " ".join([*rng.choices(words, k=90), *long[k : k + 60], *rng.choices(words, k=90)])) for k in range(0, 340, 10)]
    rows += [(900, "x who WROTE it: Ann Lee, y"), (901, "who wrote it Ann"), (902, "who wrote it"), (903, "Ann Lee"), (904, "a t1 t2"), (905, "t1 b t1 t2 t1")]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(frame(spark, rows), bench).collect()}
    assert got == {(k, 2) for k in range(0, 340, 10)} | {(900, 1), (905, 4)}


def test_decontamination_in_passes(spark, monkeypatch):
    """Rows and scores are those of one pass: words are weighed over all items, of which each pass has a part."""
    rng = random.Random(13)
    # Frequent and rare words, items of one piece and of several, an item with two texts, one too short for the index.
    words = rng.choices(range(500), weights=[1 / (1 + w) for w in range(500)], k=4_000)
    item = lambda n: " ".join(f"t{w}" for w in rng.sample(words, n))
    items = [(k, item(30 + 10 * (k % 9))) for k in range(30)] + [(3, item(40)), (99, "only five words of it")]
    docs = frame(spark, [(k, f"{item(50)} {text} {item(50)}") for k, (_, text) in enumerate(items)] + [(200 + k, item(300)) for k in range(30)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted((r["doc_id"], r["item_id"], round(r["score"], 9), r["overlap"]) for r in decontamination.find_leaks(docs, bench).collect())
    whole = rows()
    assert {r[:2] for r in whole} == {(k, i) for k, (i, _) in enumerate(items)}
    for size, least in ((80_000, 2), (20_000, 8)):
        monkeypatch.setattr(decontamination, "INDEX_BYTES", size)
        assert len(list(decontamination.indexes(bench, "text", "item_id"))) >= least
        assert rows() == whole


def test_block_max_bounds_skip_nothing():
    """WAND's result is that of scoring every piece."""
    rng = random.Random(4)
    words = [f"t{i}" for i in range(80)]
    index = decontamination.build_index([(k, " ".join(rng.choice(words) for _ in range(rng.randrange(8, 90)))) for k in range(40)])
    passage = decontamination._words([" ".join(rng.choice(words) for _ in range(700)).encode()])
    found = {(first, piece) for _, first, _, piece, _ in decontamination.retrieve(index, passage)}
    want = set()
    for first in range(0, 700, 64):
        terms = {int(x) for x in index.terms.searchsorted(passage.hash[first : first + 128])}
        score = [0.0] * len(index.items)
        for t in terms:
            for p in range(index.start[t], index.start[t + 1]):
                score[index.piece[p]] += index.impact[p]
        want |= {(first, piece) for piece, s in enumerate(score) if s >= 1}
    assert found == want and len(want) > 3
    fewer = decontamination.ENTRIES
    try:
        decontamination.ENTRIES = 50
        assert {(first, piece) for _, first, _, piece, _ in decontamination.retrieve(index, passage)} == want
    finally:
        decontamination.ENTRIES = fewer


def test_a_long_question_alone_is_no_leak(spark, monkeypatch):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    items = [(i, " ".join(word() for _ in range(150)) + "? " + " ".join(word() for _ in range(20))) for i in range(12)]
    items += [(i + 20, " ".join(word() for _ in range(30)) + "? " + " ".join(word() for _ in range(9))) for i in range(12)]
    # Some items have a second text.
    items += [(i, " ".join(word() for _ in range(40)) + "? " + " ".join(word() for _ in range(12))) for i in range(6)]
    docs, want = [], set()
    for k, (item, text) in enumerate(items):
        question, answer = text.split("? ")
        docs += [(3 * k, f"{word()} {text} {word()}"), (3 * k + 1, " ".join(question.split()[:120])), (3 * k + 2, f"{word()} {answer} {word()}")]
        want.add((3 * k, item))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = lambda: sorted((r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(df, bench).collect())
    assert found() == sorted(want)
    # One row a document and item in any number of passes.
    monkeypatch.setattr(decontamination, "INDEX_BYTES", 60_000)
    assert found() == sorted(want)

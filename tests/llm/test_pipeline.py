"""The corpus pipeline from end to end over planted documents, and the shards that it mixes into."""

import random
from collections import Counter, defaultdict

import pytest

from khata.llm import mixing

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_planted_documents_through_all_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fit = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").select("doc_id")
    words = sorted({w for r in docs.where("lang = 'en'").join(fit, "doc_id").limit(200).collect() for w in (r["text"] or "").split() if w.isalpha()})
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(8).collect()]
    clean = {50_000 + k: text(150) for k in range(20)}
    plant = dict(clean)
    insults = ("idiot", "moron", "worthless", "clown")
    toxic = {51_000 + k: " ".join(w for i in range(10) for w in (text(12), insults[i % 4])) for k in range(8)}
    exact = {52_000 + k: clean[50_000 + k % 3] for k in range(9)}
    near = {53_000 + k: clean[50_003 + k].rsplit(" ", 1)[0] + " otherend" for k in range(5)}
    leaked = {54_000 + k: f"{text(80)} {item} {text(80)}" for k, item in enumerate(items)}
    passage = text(70)
    repeated = {55_000 + k: f"{text(100)} {passage} {text(100)}" for k in range(6)}
    for some in (toxic, exact, near, leaked, repeated):
        plant |= some
    rows = [(i, t, "en", "planted", len(t)) for i, t in plant.items()]
    odd = [(56_000, None, None, None, None), (56_001, "", "en", "planted", 0), (None, text(90), None, "planted", None), (56_002, text(60), "en", None, None)]
    sf = written(spark, tmp_path, docs.unionByName(spark.createDataFrame(rows + odd, SCHEMA)))
    out = corpus_pipeline.run(spark, sf).collect()
    size = {r["doc_id"]: r["size"] for r in out}
    assert len(out) == len(size)  # one row for each document that stays
    assert not (toxic.keys() | exact.keys() | near.keys()) & size.keys()
    # Items of passage length that an earlier document holds too are cut from the planted one before leaks are sought.
    had = {i for i, item in zip(leaked, items) if len(item.encode()) >= corpus_pipeline.PASSAGE_BYTES and not docs.where(docs["text"].contains(item)).isEmpty()}
    assert leaked.keys() & size.keys() <= had and len(had) < len(leaked)
    assert all(158 <= size[i] <= 162 for i in had & size.keys())
    assert {i: size.get(i) for i in clean} == dict.fromkeys(clean, 150)
    # The passage stays in the first document that has it; a word may be cut where the repeat ends.
    assert repeated.keys() <= size.keys() and size[55_000] == 270
    assert all(198 <= size[i] <= 202 for i in repeated if i != 55_000)
    assert (size[56_000], size[56_001], size[None], size[56_002]) == (0, 0, 90, 60)
    # The mix keeps to its targets over what the other stages left.
    of = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()}
    taken, target = Counter(), {}
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] <= r["size"] * len(r["shards"])
        taken[of[r["doc_id"]]] += r["taken"]
        target[of[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_pipeline_over_no_documents(spark, tmp_path):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, written(spark, tmp_path, spark.createDataFrame([], SCHEMA))).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_shards_hold_what_the_mix_takes(spark, seed):
    """Every repeat lies in one shard, the words of the shards are the words taken, and each shard has its own order."""
    rng = random.Random(seed)
    rows = [(i, "w " * rng.randrange(1, 120), "abcd"[min(3, int(rng.expovariate(1)))]) for i in range(3_000)] + [(5_000, None, "a"), (5_001, "", None)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), seed=seed, block_words=400, shard_words=20_000)
    taken = {r["doc_id"]: r["taken"] for r in mixed.collect()}
    held, shards = Counter(), defaultdict(list)
    for r in mixing.shard_rows(mixed, seed).collect():
        assert r["words"] >= 0
        held[r["doc_id"]] += r["words"]
        shards[r["shard"]].append((r["order"], r["doc_id"], r["words"]))
    assert {i: n for i, n in taken.items() if n} == {i: n for i, n in held.items() if n}
    words = [sum(w for *_, w in s) for s in shards.values()]
    assert len(words) > 5 and max(words) < 1.5 * sum(words) / len(words)
    assert all(len({o for o, *_ in s}) == len(s) for s in shards.values())
    assert [i for _, i, _ in sorted(shards[0])] != sorted(i for _, i, _ in shards[0])

"""Pages, vectors, classifiers and the pipeline."""

import math
import random

import numpy as np
import pytest

from khata.llm import embedding_dedup, html_extraction, quality, toxicity

SF = "/root/testdata/sf0.1"


def test_main_text_of_pages(spark):
    body = "<p>The first paragraph, with a <a href='#'>link</a>; it is long enough &amp; has marks.</p><p>The\n second  one, which goes on, and on.</p>"
    page = f"""<html><head><title>T</title><style>p {{}}</style></head><body><header>Site</header><nav><ul><li><a>Home</a></li></ul></nav>
    <div class="content"><h1>Heading</h1>{body}<ul><li>An item of the text.</li></ul></div>
    <div class="cookie-notice">We use cookies.</div><aside>Read more</aside><form><input>Mail</form><div id="comments"><p>First comment, and a long one at that, really.</p></div>
    <script>var x = "<p>no</p>";</script><footer>Imprint</footer></body></html>"""
    rows = [(1, "a", page, 5), (2, "b", None, 5), (3, "c", "", 5), (4, None, "<p>cut off <b>here", 5), (1, "a", page, 5), (5, "e", "x" * 200_000, 5)]
    out = html_extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text long")).collect()
    got = {r["page_id"]: r["text"] for r in out}
    assert len(out) == 6 and all(r["n_chars"] == len(r["text"]) for r in out)
    assert got[1] == "Heading The first paragraph, with a link; it is long enough & has marks. The second one, which goes on, and on. An item of the text."
    assert (got[2], got[3], got[4], len(got[5])) == ("", "", "cut off here", 200_000)
    assert html_extraction.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_selected_paths_and_the_fullest_article_give_the_main_text():
    long = "<p>A long paragraph of the story, with commas, and marks; it goes on for a good while, as paragraphs of stories do.</p>" * 6
    teasers = "".join(f"<article><h3>Story {i}</h3><p>A teaser, of one line.</p></article>" for i in range(4))
    reader = "<article><p>I liked this, thanks.</p></article>"
    rows = "".join(f"<div><div><span>{i}</span></div><div><span>views</span></div><div><ul><li><i>x{i}</i></li></ul></div></div>" for i in range(8))
    text = html_extraction.extract_main_text(f"<body><main><h1>Head</h1><article>{long}{reader}<section><table><tr><td><div>{rows}</div></td></tr></table></section></article>{teasers}</main></body>")
    assert text.startswith("Head A long paragraph") and text.count("A long paragraph") == 6
    assert not any(x in text for x in ("Story", "teaser", "I liked", "views", "x3"))
    two = html_extraction.extract_main_text(f"<body><article>{long}</article><article>{long}</article></body>")
    assert two.count("A long paragraph") == 12


def test_embedding_links_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + rng.standard_normal(16) * rng.choice([0.05, 0.25, 0.4])).tolist(), int(i % 3)) for i in range(240)]
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 16, 1), (303, [math.nan] + [1.0] * 15, 1), (304, [None] + [1.0] * 15, 1), (305, rows[0][1], None), (306, [math.inf] * 16, 1)]
    rows += [(400, rows[0][1], 0), (401, rows[0][1], 0), (402, [1.0, 2.0], 0), (403, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "vec_id long, embedding array<double>, label int, id string, cid string")
    good = [r for r in rows if r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    links, root = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, v, a) in enumerate(good):
        for j, w, b in good[n + 1 :]:
            if a == b and len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                links[i] += 1
                links[j] += 1
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(df, block=64, window=16, tile=20).collect()}
    assert got == {i: (links[i], top(i), top(i) == i) for i in links}
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("mean", [0.0, 0.8])
def test_embedding_recall_in_a_label_far_larger_than_a_block(spark, mean):
    """Isolated pairs just above the threshold, round a mean or none; 3,750 blocks of 8."""
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(unit(rng.standard_normal((30_000, 64))) + mean * unit(np.ones((1, 64))))
    side = rng.standard_normal((2_000, 64))
    side = unit(side - (side * x[:2_000]).sum(axis=1, keepdims=True) * x[:2_000])
    x[2_000:4_000] = 0.935 * x[:2_000] + math.sqrt(1 - 0.935**2) * side
    links = {(int(i) + at, int(j)) for at in range(0, 30_000, 3_000) for i, j in zip(*np.nonzero(x[at : at + 3_000] @ x.T >= 0.93)) if i + at < j}
    assert len(links) >= 2_000
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    component = {r["vec_id"]: r["component_id"] for r in embedding_dedup.near_vectors(df, block=8, window=2).collect()}
    recall = sum(component[i] == component[j] for i, j in links) / len(links)
    print(f"recall {recall:.4f} of {len(links)}")
    assert recall >= 0.95


def test_embedding_recall_in_clusters(spark):
    """Planted pairs in 20 clusters of cosine 0.83, which no one pass tells apart; 3,750 blocks of 8."""
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centre = unit(rng.standard_normal((20, 64)))
    x = unit(math.sqrt(0.83) * centre[rng.integers(20, size=30_000)] + math.sqrt(0.17) * unit(rng.standard_normal((30_000, 64))))
    side = rng.standard_normal((2_000, 64))
    side = unit(side - (side * x[:2_000]).sum(axis=1, keepdims=True) * x[:2_000])
    x[2_000:4_000] = 0.935 * x[:2_000] + math.sqrt(1 - 0.935**2) * side
    links = {(int(i) + at, int(j)) for at in range(0, 30_000, 3_000) for i, j in zip(*np.nonzero(x[at : at + 3_000] @ x.T >= 0.93)) if i + at < j}
    assert len(links) >= 2_000
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    component = {r["vec_id"]: r["component_id"] for r in embedding_dedup.near_vectors(df, block=32, window=8).collect()}
    recall = sum(component[i] == component[j] for i, j in links) / len(links)
    print(f"recall {recall:.4f} of {len(links)}")
    assert recall >= 0.95


def test_passes_go_on_until_the_probes_have_met():
    more = embedding_dedup.more_passes
    assert more(8, 0, 0, 8) == 0  # no rows
    assert more(8, 1_990, 2_000, 8) == 0 and more(8, 1_990, 2_000, 10) == 2
    assert 1 <= more(8, 1_950, 2_000, 8) <= more(8, 1_500, 2_000, 8) <= more(8, 0, 2_000, 8) == embedding_dedup.PASSES


def accuracy(spark, query, label):
    scores = {r["doc_id"]: (r["score"], r["predicted"]) for r in query(spark, SF).where("held_out").collect()}
    known = [(scores[r["doc_id"]], r[label]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["doc_id"] in scores and r[label] is not None]
    assert all(0 <= s <= 1 and p == int(s >= 0.3) for (s, p), _ in known)
    one, other = [s for (s, _), y in known if y], [s for (s, _), y in known if not y]
    return sum((a > b) + 0.5 * (a == b) for a in one for b in other) / (len(one) * len(other))


def test_toxicity_on_the_held_out_fold(spark):
    assert accuracy(spark, toxicity.op5_toxicity, "toxic") >= 0.9


def test_quality_on_the_held_out_fold(spark):
    assert accuracy(spark, quality.op9_quality, "quality") >= 0.75


def test_counterfactual_penalty_lowers_false_positives(spark):
    rng = random.Random(1)
    plain = "the a market weather river garden morning train letter music bread winter".split()
    sentence = lambda *extra: " ".join(rng.sample([*rng.choices(plain, k=10), *extra], 10 + len(extra))) + "."
    rows = [(sentence("muslims", "rotten", "vermin"), 1) for _ in range(120)] + [(sentence("rotten", "vermin"), 1) for _ in range(10)] + [(sentence(), 0) for _ in range(300)]
    sample = spark.createDataFrame(rows, "text string, label int")
    free, held = toxicity.fit(sample, penalty=0.0), toxicity.fit(sample)
    neutral = [sentence("muslims").encode() for _ in range(50)]
    assert held.score(neutral).mean() < free.score(neutral).mean()
    assert held.score([sentence("rotten", "vermin").encode()])[0] > 0.5 > held.score([b""])[0]


def test_counterfactuals_swap_terms():
    pairs = toxicity.counterfactuals(b"Some women sing. No term here! Gay men read.")
    assert len(pairs) == 4 and pairs[0] == (b"Some women sing", b"Some people sing")


def test_counterfactuals_have_no_cap_and_four_languages():
    text = " ".join(f"Women sing {i}. Die Frauen lesen. Les étrangers dorment. Las mujeres leen." for i in range(40))
    pairs = toxicity.counterfactuals(text.encode())
    assert len(pairs) == 2 * 4 * 40
    assert pairs[2] == (" Die Frauen lesen".encode(), " Die Menschen lesen".encode()) and pairs[5][1] == " Les réfugiés dorment".encode()



def test_one_class_or_no_labels(spark):
    assert toxicity.fit(spark.createDataFrame([("a b", 0)], "text string, label int")).score([b"", b"x"]).tolist() == pytest.approx([1e-3] * 2, rel=1e-3)
    assert quality.fit(spark.createDataFrame([], "text string, label int")) is None
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (None, "abc", 7), (1, None, 7)], "doc_id long, text string, score int")
    out = toxicity.score_texts(docs, quality.Constant(0.5), ["doc_id"]).collect()
    assert len(out) == 4 and all(r["score"] == 0.5 and r["predicted"] == 1 for r in out)
    assert [r["doc_id"] for r in toxicity.reject(docs, quality.Constant(0.2), 0.5).orderBy("doc_id").collect()] == [None, 1, 1, 2]


CASES = {
    "empty": ([], []),
    "no labels": ([(1, "a b", 0), (2, None, 0), (None, "x", 0)], []),
    "one class": ([(1, "a b", 0)], [(1, 1, 1)]),
    "nulls": ([(1, "a b", 0), (2, "c d", 0), (3, "", 0), (3, "", 0), (None, None, 0)], [(1, 1, 1), (2, 0, 0), (None, 1, 1), (3, None, None)]),
}


@pytest.mark.parametrize("case", CASES)
def test_classifier_queries_on_small_tables(spark, tmp_path, case):
    docs, labels = CASES[case]
    spark.createDataFrame(docs, "doc_id long, text string, score int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for query in (toxicity.op5_toxicity, quality.op9_quality):
        out = query(spark, str(tmp_path)).collect()
        assert sorted(str(r["doc_id"]) for r in out) == sorted(str(d[0]) for d in docs)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] is not None for r in out)


def test_class_prior():
    rng = np.random.default_rng(0)
    positive = rng.normal(2, 1, 4_000)
    web = np.concatenate([rng.normal(2, 1, 1_200), rng.normal(-2, 1, 2_800)])
    assert quality.class_prior(positive, web) == pytest.approx(0.3, abs=0.06)


class ByLength:
    def __init__(self, most):
        self.most = most

    def score(self, texts):
        return np.array([min(len(t) / self.most, 1.0) for t in texts])


def test_class_prior_counts_every_document_that_is_not_learned_from(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randrange(100)) for i in range(3_000)] + [(7, "y" * 90)] * 3 + [(None, "z" * 40)] * 500 + [(5_000, None), (5_001, "")]
    known = [(i,) for i in range(0, 3_000, 3)]
    models = [ByLength(100), ByLength(120)]
    texts = [(t or "").encode() for i, t in rows if (i,) not in set(known)]
    half = quality._half(texts)
    positive = [np.linspace(0.4, 0.9, 50), np.linspace(0.3, 0.8, 70)]
    web = [models[h].score([t for t, own in zip(texts, half) if own == h]) for h in (0, 1)]
    cuts = [np.quantile(p, np.linspace(0, 1 - quality.LEAST_MASS, 60)) for p in positive]
    ratios = [(sum((w >= c[k]).sum() for w, c in zip(web, cuts)) / len(texts)) / (sum((p >= c[k]).sum() for p, c in zip(positive, cuts)) / 120) for k in range(60)]
    share = min(r for r, k in zip(ratios, range(60)) if sum((p >= c[k]).sum() for p, c in zip(positive, cuts)) / 120 >= quality.LEAST_MASS)
    share -= 2 * math.sqrt(share * (1 - share) / len(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = quality.corpus_prior(docs, spark.createDataFrame(known, "doc_id long"), models, positive)
    assert got == pytest.approx(share, abs=1e-9)


def test_pipeline_stages(spark):
    """Each stage's decisions on its own input, against a plain version of them where there is one."""
    import corpus_pipeline
    from tests.llm.test_text_operators import near_components

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "minhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "mixing"]
    stages, sf = dict(corpus_pipeline.STAGES), "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = stages["toxicity"](spark, docs, sf)
    assert clean.columns == docs.columns and 0.8 * docs.count() < clean.count() <= docs.count()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = stages["minhash_near_dedup"](spark, docs, sf)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, (_, _, stays) in near_components(rows, 5).items() if stays}
    stripped = stages["suffix_array_dedup"](spark, docs, sf)
    assert stripped.columns == docs.columns and stripped.count() == docs.count()
    assert stages["benchmark_decontamination"](spark, docs, sf).columns == docs.columns
    assert stages["mixing"](spark, docs, sf).count() == docs.count()
    assert stages["mixing"](spark, docs.limit(0), sf).count() == 0


def test_pipeline_rejects_what_is_predicted_toxic(spark):
    """Held-out texts planted under new ids: the toxic ones go, the clean ones stay, as op5_toxicity predicts."""
    import corpus_pipeline

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    fold = {r["doc_id"]: r["toxic"] for r in labels.where(toxicity.held_out("doc_id", 4, 2) & labels["toxic"].isNotNull()).collect()}
    predicted = {r["doc_id"]: r["predicted"] for r in toxicity.op5_toxicity(spark, SF).collect()}
    plant = docs.join(labels.select("doc_id").where(toxicity.held_out("doc_id", 4, 2)), "doc_id").withColumn("doc_id", -docs["doc_id"] - 1)
    stage = dict(corpus_pipeline.STAGES)["toxicity"]
    kept = {r["doc_id"] for r in stage(spark, docs.unionByName(plant.select(docs.columns)), SF).select("doc_id").collect()}
    # Two fits differ in the last digits; at a score of 0.5 it would be 33 documents.
    assert len({i for i, p in predicted.items() if not p} ^ {i for i in kept if i >= 0}) <= 3
    found = {k: [(-i - 1 in kept) for i, y in fold.items() if y == k and i in predicted] for k in (0, 1)}
    print(f"toxic gone {found[1].count(False)} of {len(found[1])}, clean gone {found[0].count(False)} of {len(found[0])}")
    assert found[1].count(False) >= 0.8 * len(found[1]) and found[0].count(True) >= 0.97 * len(found[0])

"""Steps whose work grew faster than their input, or was done more than once."""

import pytest

from khata.functions import gating, masking
from khata.operators import chains, settlement
from khata.plans import links, queries, streams  # noqa: F401  (register their queries)
from khata.plans.inputs import load

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_links_into_a_circle_do_not_keep_all_links_going(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(chains, "written", lambda df, write=chains.written: tables.append(df) or write(df))
    rows = [(f"c{i}", f"c{(i + 1) % 3}") for i in range(3)] + [("d", "c0"), ("e", "d")] + [(f"x{i}", f"y{i}") for i in range(500)] + [(f"z{i}", f"z{i + 1}") for i in range(7)]
    got = {r[0]: (r[1], r[2]) for r in chains.roots(spark.createDataFrame(rows, "child string, parent string")).collect()}
    want = {k: (None, None) for k in ("c0", "c1", "c2", "d", "e")} | {f"x{i}": (f"y{i}", 1) for i in range(500)} | {f"z{i}": ("z7", 7 - i) for i in range(7)}
    # Chains of seven links take three rounds, and one more shows that the rest are circles'.
    assert got == want and len(tables) <= 5
    tables.clear()
    circle = spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string")
    assert {tuple(r) for r in chains.roots(circle).collect()} == {("a", None, None), ("b", None, None)} and len(tables) == 2


@pytest.mark.parametrize("name", ["match_refunds", "suspected_emi", "code_links"])
def test_windows_read_each_row_once(spark, name):
    """A frame up to the last row is gone through again for each row of its key."""
    assert "unboundedfollowing" not in plan(queries.QUERIES[name](spark, SF)).replace(" ", "")


def test_what_follows_next_is_found_backwards(spark):
    t = lambda s: f"timestamp_seconds({s})"
    codes = spark.sql(f"SELECT * FROM VALUES ('k1', 1L, 5L, {t(10)}), ('k2', 1L, 5L, {t(20)}), ('k3', 1L, 5L, {t(40)}), ('k4', 2L, 5L, {t(10)}) AS v(id, user_id, amount_paise, received_at)")
    spends = spark.sql(f"SELECT *, 'EXPENSE' AS direction FROM VALUES ('s1', 1L, 5L, {t(20)}, 1L), ('s0', 1L, 5L, {t(20)}, 0L), ('s2', 1L, 5L, {t(5)}, 2L), ('s3', 2L, 5L, {t(700)}, 3L) AS v(id, user_id, amount_paise, received_at, seq)")
    assert sorted(map(tuple, settlement.code_links(codes, spends).collect())) == [("k1", "s0"), ("k2", "s0")]


def test_the_gate_looks_once_at_a_body(spark):
    m = load(spark, SF, "messages").select("seq", "user_id", "sender", "body")
    denied = spark.createDataFrame([(1, "KOTAKB-X")], "user_id long, entity string")
    for gated in (gating.gate(m), gating.gate(m, denied)):
        assert plan(gated.select("seq", "gate")).count("one time password") == 1


def test_masks_look_behind_a_character_that_may_begin_a_match():
    assert not [p for p, _ in masking.REWRITES if p.lstrip("(?:").startswith(("(?<", "<"))]


def test_a_batch_of_a_stream_is_read_by_all_cores(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    stream = queries._stream(spark.range(1000).toDF("n"), str(tmp_path))
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    assert len(list((tmp_path / "in").glob("part-*"))) == 4 * cores
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 4 and spark.read.parquet(f"{tmp_path}/out").count() == 1000


@pytest.mark.parametrize("module, take", [(queries, lambda s, at: queries.code_links(s, SF)), (streams, lambda s, at: streams._codes_and_spends(s, SF, at))])
def test_codes_and_spends_are_kept_without_bodies(spark, tmp_path, monkeypatch, module, take):
    kept = []
    monkeypatch.setattr(module, "written", lambda df, write=module.written: kept.append(df.columns) or write(df))
    take(spark, f"{tmp_path}/at")
    assert len(kept) == 1 and not {"body", "x_amt"} & set(kept[0])


def test_a_stream_learns_from_messages_that_were_not_masked_before(spark, monkeypatch):
    came = []
    monkeypatch.setattr(links, "_stream", lambda df, at, stream=links._stream: came.append(df) or stream(df, at))
    assert links.stream_templates(spark, SF).count() > 0
    assert "khata-" not in "".join(came[0].inputFiles()) and came[0].columns == ["seq", "body", "issuer"]

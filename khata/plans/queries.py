"""The registered queries of the ledger's operators, each with DuckDB SQL for its rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from khata.functions import amounts, classify, gating, ids, interest, masking, payees, senders
from khata.functions.dates import parse_sms_date
from khata.operators import aggregation, ledger, multipart, reconciliation, settlement, templates
from khata.plans import dashboard as reports
from khata.plans.inputs import MERCHANTS, SHAPES, SKELETON, by_shape, load, quoted, with_inputs
from khata.plans.pipeline import build_entries
from khata.sources.space import new_folder, written
from khata.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *inputs: str):
    """Registers a query under its function's name, with its SQL over the named inputs."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_inputs(sql, *inputs) if inputs else sql
        return f

    return put


# Senders, gate, masks -------------------------------------------------------------------------------------------

_CLEAN = "regexp_replace(regexp_replace(regexp_replace(trim(sender), '[\\s-]', '', 'g'), '^\\+?91', ''), '^\\+', '')"
_PARTS = "list_filter(string_split(upper(trim(sender)), '-'), lambda x: x <> '')"
_LED = f"CASE WHEN len({_PARTS}) > 1 AND regexp_full_match({_PARTS}[1], '[A-Z]{{2}}') THEN list_slice({_PARTS}, 2, 99) ELSE {_PARTS} END"
_ENTITY = f"CASE WHEN regexp_full_match({_CLEAN}, '[0-9]{{10}}') THEN NULL WHEN len({_LED}) > 1 AND ({_LED})[-1] IN ('S', 'T', 'P', 'G') THEN array_to_string(list_slice({_LED}, 1, len({_LED}) - 1), '-') ELSE array_to_string({_LED}, '-') END"


@query(f"SELECT seq, CASE WHEN regexp_full_match({_CLEAN}, '[0-9]{{10}}') THEN 'personal' ELSE 'dlt' END AS kind, {_ENTITY} AS entity FROM messages", "messages")
def sender_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = senders.normalise_sender(F.col("sender"))
    return load(spark, sf_dir, "messages").select("seq", s["kind"].alias("kind"), s["entity"].alias("entity"))


_WORDS = "debited|credited|spent|withdrawn|transferred|transfer|paid|received|sent|purchase|deducted|debit|credit|added|loaded|load|will be debited|scheduled|due on|autopay|e-mandate|standing instruction|emi due|has requested|requesting|collect request|payment request|blocked|on hold|hold of|pre-auth|authorization|mandate created|mandate registered|autopay set up|refund|refunded|reversal of|credited back|returned|declined|could not|unsuccessful|reversed"


@query(
    f"""SELECT seq, reason, reason = 'admit' AS admit, reason = 'otp' AS buffered FROM (SELECT seq, CASE WHEN trim(body) = '' THEN 'empty'
    WHEN regexp_full_match({_CLEAN}, '[0-9]{{10}}') THEN 'personal' WHEN user_id % 5 = 0 AND {_ENTITY} = 'KOTAKB-X' THEN 'denylist'
    WHEN regexp_matches(body, '(?i)\\botp\\b|one time password|do not share|code is') THEN 'otp'
    WHEN regexp_matches(body, '(?i)\\b(offer|sale|win|won|discount|expires|click|claim|shop now|flat \\d+%|\\d+% off)\\b|\\bcashback\\b') THEN 'promo'
    WHEN regexp_matches(body, '(?i)(rs\\.?|inr|₹)\\s*[0-9]') AND regexp_matches(body, '(?i)\\b({_WORDS})\\b') THEN 'admit' ELSE 'balance_only' END AS reason FROM messages)""",
    "messages",
)
def message_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "messages")
    denied = m.where("user_id % 5 = 0").select("user_id", F.lit("KOTAKB-X").alias("entity")).distinct()
    return gating.gate(m, denied).select("seq", "gate.reason", "gate.admit", "gate.buffered")


@query(f"SELECT skeleton, sha256(skeleton) AS fingerprint, count(*) AS n, min(seq) AS first_seq FROM (SELECT seq, {SKELETON} AS skeleton FROM messages) GROUP BY skeleton", "messages")
def mask_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = templates.shape(load(spark, sf_dir, "messages").select("seq", "body"))
    return m.groupBy("skeleton", "fingerprint").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


_LEAKS = "regexp_matches(lower(body), '(rs\\.?|inr|₹|rupees)\\s*[0-9]') OR regexp_matches(body, '[0-9]{3}')"


@query(f"SELECT shape, count(*) AS n, 0 AS leaks, count(*) FILTER (WHERE {_LEAKS}) AS body_leaks FROM messages GROUP BY shape", "messages")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "messages").withColumn("skeleton", masking.redact(F.col("body")))
    return m.groupBy("shape").agg(F.count("*").alias("n"), F.count_if(masking.leak(F.col("skeleton")).isNotNull()).cast("int").alias("leaks"), F.count_if(masking.leak(F.col("body")).isNotNull()).alias("body_leaks"))


# Amounts and money -----------------------------------------------------------------------------------------------

_PAISE = f"CAST({by_shape(lambda s: s.paise)} AS BIGINT)"


@query(f"SELECT seq, {_PAISE} AS paise, CASE WHEN {_PAISE} IS NULL THEN 'low' ELSE 'high' END AS confidence FROM messages", "messages")
def parse_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = amounts.parse_amount(F.col("body"))
    return load(spark, sf_dir, "messages").select("seq", a["paise"].alias("paise"), a["confidence"].alias("confidence"))


@query(f"SELECT seq, {by_shape(lambda s: ' || chr(44) || '.join(f'CAST({a} AS STRING)' for a in s.amounts) or quoted(''))} AS amounts FROM messages", "messages")
def extract_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "messages").select("seq", F.array_join(amounts.extract_amounts(F.col("body")), ",").alias("amounts"))


@query(
    """SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(28,10)) * 100, 0) AS BIGINT) AS paise,
    '₹' || CASE WHEN length(w) <= 3 THEN w WHEN length(w) <= 5 THEN substr(w, 1, length(w) - 3) || ',' || right(w, 3)
      ELSE substr(w, 1, length(w) - 5) || ',' || substr(w, length(w) - 4, 2) || ',' || right(w, 3) END || '.' || lpad(CAST(CAST(round(CAST(o_totalprice AS DECIMAL(28,10)) * 100, 0) AS BIGINT) % 100 AS STRING), 2, '0') AS shown
    FROM (SELECT *, CAST(CAST(round(CAST(o_totalprice AS DECIMAL(28,10)) * 100, 0) AS BIGINT) // 100 AS STRING) AS w FROM orders)"""
)
def money_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", amounts.rupees_to_paise(F.col("o_totalprice")).alias("paise"))
    return o.withColumn("shown", amounts.format_paise(F.col("paise")))


# Classification -----------------------------------------------------------------------------------------------------


@query(
    f"SELECT seq, {by_shape(lambda s: quoted(s.modality))} AS modality, {by_shape(lambda s: quoted(s.verb))} AS verb, {by_shape(lambda s: str(s.topup))} AS topup, {by_shape(lambda s: str(s.reversal))} AS reversal FROM messages",
    "messages",
)
def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("body")
    return load(spark, sf_dir, "messages").select("seq", classify.modality(b).alias("modality"), classify.verb_direction(b).alias("verb"), classify.is_topup(b).alias("topup"), classify.is_reversal_notice(b).alias("reversal"))


@query(
    """SELECT id, CASE WHEN ordinal % 9 = 0 THEN 'TOPUP' WHEN upper(issuer) = 'PAYTM' THEN 'TRANSFER' WHEN ordinal % 2 = 0 THEN 'EXPENSE' ELSE 'INCOME' END AS money_type,
    direction IN ('EXPENSE', 'INCOME') AND modality = 'actual' AND coalesce(net_status, 'active') <> 'is_reversal' AS counted FROM entries""",
    "entries",
)
def money_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = classify.money_type(F.when(F.col("ordinal") % 2 == 0, "out").otherwise("in"), classify.is_own_node(F.col("issuer")), F.col("ordinal") % 9 == 0)
    return load(spark, sf_dir, "entries").select("id", kind.alias("money_type"), classify.is_counted(F.col("direction"), F.col("modality"), F.col("net_status")).alias("counted"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_custkey AS STRING), 10, '9') ELSE lower(c_name) END AS payee_key, c_custkey % 3 = 0 AS phone,
    CASE WHEN c_custkey % 5 = 0 THEN 'Travel' WHEN c_custkey % 5 = 1 THEN 'Food' END AS hint,
    CASE WHEN c_custkey % 5 < 2 THEN 'merchant' WHEN c_custkey % 3 = 0 THEN 'person' ELSE 'unknown' END AS counterparty,
    CASE c_custkey % 5 WHEN 0 THEN 'expense' WHEN 1 THEN 'expense' WHEN 2 THEN 'receivable' WHEN 3 THEN 'debt_repayment' ELSE 'transfer' END AS routed FROM customer"""
)
def payee_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    vpa = F.concat(F.when(F.col("c_custkey") % 3 == 0, F.lpad(F.col("c_custkey").cast("string"), 10, "9")).otherwise(F.col("c_name")), F.lit("@okbank"))
    text = F.when(F.col("c_custkey") % 5 == 0, "Chocolate Shop").when(F.col("c_custkey") % 5 == 1, "SWIGGY order").otherwise("Corner store")
    reason = F.element_at(F.array(*map(F.lit, ("my_share", "rent", "lending", "repaying", "transfer"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return c.select("c_custkey", payees.vpa_key(vpa).alias("payee_key"), payees.is_phone_vpa(vpa).alias("phone"), payees.category_hint(text).alias("hint"), payees.counterparty(vpa, text).alias("counterparty"), payees.person_reason(reason).alias("routed"))


@query(
    """WITH p AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part), q AS (SELECT *, CASE WHEN length(a) < length(b) THEN a ELSE b END AS s, CASE WHEN length(a) < length(b) THEN b ELSE a END AS l FROM p)
    SELECT p_partkey, levenshtein(a, b) AS distance, CASE WHEN a = b THEN 1.0::DOUBLE WHEN contains(l, s) THEN 0.9::DOUBLE ELSE greatest(
      len(list_filter(range(1, length(s) + 1), lambda i: substr(s, 1, i) = substr(l, 1, i)))::DOUBLE / length(s), 1.0::DOUBLE - levenshtein(a, b)::DOUBLE / length(l)) END AS score FROM q"""
)
def tag_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", F.levenshtein(F.lower("p_name"), F.lower("p_type")).cast("long").alias("distance"), payees.similarity(F.col("p_name"), F.col("p_type")).cast("double").alias("score"))


@query(
    """WITH e AS (SELECT DISTINCT p_size % 10 AS user_id, p_brand AS tag, CAST(substr(p_brand, 7) AS INT) AS pos FROM part), n AS (SELECT DISTINCT p_size % 10 AS user_id, substr(p_brand, 1, 7) || 'x' AS name FROM part),
    s AS (SELECT n.user_id, name, tag, pos, greatest(len(list_filter(range(1, least(length(name), length(tag)) + 1), lambda i: substr(lower(name), 1, i) = substr(lower(tag), 1, i)))::DOUBLE / least(length(name), length(tag)), 1 - levenshtein(lower(name), lower(tag))::DOUBLE / greatest(length(name), length(tag))) AS score FROM n JOIN e USING (user_id))
    SELECT user_id, name, arg_max(CASE WHEN score >= 0.6 THEN tag END, CASE WHEN score >= 0.6 THEN score * 1000000 + pos END) AS suggestion FROM s GROUP BY user_id, name"""
)
def suggest_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("user_id", F.col("p_size") % 10)
    old = p.select("user_id", F.col("p_brand").alias("name"), F.substr("p_brand", F.lit(7)).cast("int").alias("pos")).distinct()
    new = p.select("user_id", F.concat(F.substr("p_brand", F.lit(1), F.lit(7)), F.lit("x")).alias("name")).distinct()
    return ledger.suggest_tags(new, old)


# Dates and ids ---------------------------------------------------------------------------------------------------------


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 AND (d > 31 OR m > 12) THEN NULL ELSE CAST(make_date(2000 + o_orderkey % 50, 1, 1) + to_months(CAST(m - 1 AS INT)) + to_days(CAST(d - 1 AS INT)) AS DATE) END AS day FROM
    (SELECT o_orderkey, CAST(o_orderkey % 33 AS INT) AS d, CAST(CASE WHEN o_orderkey % 4 < 2 THEN o_custkey % 14 ELSE o_custkey % 12 + 1 END AS INT) AS m FROM orders)"""
)
def sms_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    d, y = (F.col("o_orderkey") % 33).cast("string"), F.lpad((F.col("o_orderkey") % 50).cast("string"), 2, "0")
    name = F.element_at(F.array(*map(F.lit, "January Feb march APR may June jul Aug Sept Oct nov December".split())), (F.col("o_custkey") % 12 + 1).cast("int"))
    m, sep = (F.col("o_custkey") % 14).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "-").otherwise("/")
    raw = F.when(F.col("o_orderkey") % 4 < 2, F.concat(d, sep, m, sep, y)).otherwise(F.concat(d, F.lit(" "), name, F.lit("-"), F.concat(F.lit("20"), y)))
    return o.select("o_orderkey", parse_sms_date(F.concat(F.lit(" "), raw), F.timestamp_seconds(F.lit(0)))["date"].alias("day"))


_NAME = "CASE WHEN ref IS NOT NULL THEN u || '|HDFCBK|ref:' || ref ELSE u || '|HDFCBK|out|' || CAST(paise AS STRING) || '|' || CAST(t_sec // 10 AS STRING) END"


@query(
    f"""SELECT seq, ref AS reference, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST('0x' || substr(h, 17, 1) AS INT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS entry_id
    FROM (SELECT seq, ref, sha1(unhex('b9f8a4e21c3d4f5a9b6e7d8c9a0b1c2d') || encode({_NAME})) AS h FROM (SELECT *, CAST(user_id AS STRING) AS u, {by_shape(lambda s: 'x_ref' if s.reference else 'NULL')} AS ref FROM messages))""",
    "messages",
)
def entry_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "messages").withColumn("reference", ids.extract_reference(F.col("body")))
    return m.select("seq", "reference", ids.entry_id(F.col("user_id").cast("string"), F.lit("HDFCBK"), F.lit("out"), F.col("paise"), F.col("t_sec"), F.col("reference")).alias("entry_id"))


@query(
    """SELECT id, CASE WHEN days < 28 THEN 'since you installed' ELSE 'this month' END AS label, days < 28 AS is_thin, days FROM
    (SELECT id, CAST(greatest(0, floor((2592000 - t_sec * 40.0) / 86400)) AS BIGINT) AS days FROM entries)""",
    "entries",
)
def period_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = classify.period_label(F.timestamp_seconds(F.col("t_sec") * 40), F.timestamp_seconds(F.lit(2_592_000)))
    return load(spark, sf_dir, "entries").select("id", p["label"].alias("label"), p["is_thin"].alias("is_thin"), p["days"].alias("days"))


@query(
    """SELECT id, e AS expected_paise, CASE WHEN ordinal % 3 = 0 THEN 'ask' WHEN e <= 0 THEN 'flag' WHEN abs(amount_captured_paise % 100 - e)::DOUBLE / e <= 0.5 THEN 'absorb' ELSE 'flag' END AS verdict,
    CASE WHEN balance_after_paise <= 0 THEN 0.0 ELSE (amount_captured_paise % 100)::DOUBLE / balance_after_paise END AS learned
    FROM (SELECT *, CAST(floor(balance_after_paise::DOUBLE * 0.0001 + 0.5) AS BIGINT) AS e FROM entries WHERE balance_after_paise IS NOT NULL)""",
    "entries",
)
def interest_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "entries").where("balance_after_paise is not null")
    b, credit, rate = F.col("balance_after_paise"), F.col("amount_captured_paise") % 100, F.lit(0.0001)
    return e.select("id", interest.expected_interest(b, rate).alias("expected_paise"), interest.verdict(b, credit, F.col("ordinal") % 3 != 0, rate).alias("verdict"), interest.learn_rate(credit, b).alias("learned"))


# Aggregations ------------------------------------------------------------------------------------------------------------

_BASES = """, legs AS (SELECT DISTINCT settle_entry_id FROM settlements WHERE settle_entry_id IS NOT NULL),
back AS (SELECT base_entry_id, sum(coalesce(settled_amount_paise, 0)) AS r FROM settlements WHERE status IN ('settled', 'partial') GROUP BY 1),
bases AS (SELECT e.*, amount_effective_paise - coalesce(r, 0) AS c FROM entries e LEFT JOIN back ON e.id = base_entry_id
  WHERE is_counted AND coalesce(net_status, 'active') <> 'is_reversal' AND NOT EXISTS (SELECT 1 FROM legs WHERE legs.settle_entry_id = e.id)) """


def _on_bases(sql: str) -> str:
    return with_inputs("", "entries", "settlements").rstrip() + _BASES + sql


def _ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, sf_dir, "entries"), load(spark, sf_dir, "settlements")


_SUMS = "CAST(coalesce(sum(CASE WHEN direction = 'INCOME' THEN c END), 0) AS BIGINT) AS income_paise, CAST(coalesce(sum(CASE WHEN direction = 'EXPENSE' THEN c END), 0) AS BIGINT) AS expense_paise, CAST(coalesce(sum(CASE WHEN direction = 'INCOME' THEN c END), 0) - coalesce(sum(CASE WHEN direction = 'EXPENSE' THEN c END), 0) AS BIGINT) AS savings_paise"


@query(_on_bases(f"SELECT {_SUMS} FROM bases"))
def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregation.headline(*_ledger(spark, sf_dir))


@query(_on_bases(f"SELECT user_id, {_SUMS} FROM bases GROUP BY user_id"))
def headline_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregation.headline(*_ledger(spark, sf_dir), by=("user_id",))


@query(_on_bases("SELECT coalesce(category_id, -1) AS category_id, CAST(sum(c) AS BIGINT) AS amount_paise FROM bases WHERE direction = 'EXPENSE' GROUP BY 1"))
def by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregation.by_category(*_ledger(spark, sf_dir))


@query(_on_bases("SELECT coalesce(tag_id, '__untagged__') AS tag_id, CAST(sum(c) AS BIGINT) AS amount_paise FROM bases WHERE direction = 'EXPENSE' GROUP BY 1"))
def by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregation.by_tag(*_ledger(spark, sf_dir))


@query(_on_bases("SELECT line_id, CAST(sum(c) AS BIGINT) AS amount_paise FROM bases WHERE direction = 'EXPENSE' GROUP BY 1"))
def by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregation.by_line(*_ledger(spark, sf_dir))


_X = "FROM bases WHERE direction = 'EXPENSE'"


@query(
    _on_bases(
        f"""SELECT 'category' AS kind, CAST(coalesce(category_id, -1) AS STRING) AS key, CAST(sum(c) AS BIGINT) AS amount_paise {_X} GROUP BY 2 UNION ALL SELECT 'tag', coalesce(tag_id, '__untagged__'), CAST(sum(c) AS BIGINT) {_X} GROUP BY 2
        UNION ALL SELECT 'line', line_id, CAST(sum(c) AS BIGINT) {_X} GROUP BY 2 UNION ALL SELECT 'total', NULL, CAST(sum(c) AS BIGINT) {_X}"""
    )
)
def breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregation.breakdowns(*_ledger(spark, sf_dir))


@query(_on_bases("SELECT id, c AS contribution_paise FROM bases"))
def effective_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregation.contributions(*_ledger(spark, sf_dir)).select("id", "contribution_paise")


@query("SELECT base_entry_id, CAST(sum(coalesce(settled_amount_paise, 0)) AS BIGINT) AS realised_paise FROM settlements WHERE status IN ('settled', 'partial') GROUP BY 1", "settlements")
def realised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregation.realised(load(spark, sf_dir, "settlements"))


@query(_on_bases("SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS amount_paise FROM bases WHERE direction = 'EXPENSE'"))
def breakdown_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregation.sum_of(aggregation.by_tag(*_ledger(spark, sf_dir)))


def _payees(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("id"), (F.col("s_suppkey") % 12 + 1).cast("int").alias("default_category_id"), F.concat(F.lit("t"), (F.col("s_suppkey") % 4).cast("string")).alias("default_tag_id"))


@query(
    """SELECT e.id, coalesce(category_id, CAST(s_suppkey % 12 + 1 AS INT)) AS effective_category_id, coalesce(tag_id, 't' || CAST(s_suppkey % 4 AS STRING)) AS effective_tag_id
    FROM entries e LEFT JOIN supplier ON payee_id = 'p' || CAST(s_suppkey AS STRING)""",
    "entries",
)
def effective_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregation.resolve_labels(load(spark, sf_dir, "entries"), _payees(spark, sf_dir)).select("id", "effective_category_id", "effective_tag_id")


@query("SELECT id, ordinal FROM entries WHERE t_sec >= 10000 AND t_sec < 50000 AND direction = 'EXPENSE' AND category_id = 3", "entries")
def ledger_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregation.in_period(load(spark, sf_dir, "entries"), F.timestamp_seconds(F.lit(10_000)), F.timestamp_seconds(F.lit(50_000)), direction="EXPENSE", category_id=3).select("id", "ordinal")


# Chains --------------------------------------------------------------------------------------------------------------------


def _gaps(order: str) -> str:
    return f""", r AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY {order} t_sec, ordinal) AS rn, count(*) OVER (PARTITION BY line_id) AS n FROM chain WHERE coalesce(source, 'sms') = 'sms'),
    g AS (SELECT *, balance_after_paise - lag(balance_after_paise) OVER (PARTITION BY line_id ORDER BY rn) - CASE direction WHEN 'credit' THEN amount_paise WHEN 'debit' THEN -amount_paise ELSE 0 END AS gap FROM r WHERE rn = 1 OR NOT is_hold) """


def _on_chain(sql: str, order: str = "") -> str:
    return with_inputs("", "chain").rstrip() + _gaps(order) + sql


_FOUND = "SELECT line_id, id AS entry_id, CASE WHEN gap < 0 THEN 'missing_outflow' ELSE 'missing_inflow' END AS type, abs(gap) AS gap_paise FROM g WHERE rn > 1 AND gap <> 0"


@query(_on_chain(_FOUND))
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconciliation.discrepancies(load(spark, sf_dir, "chain"))


@query(_on_chain(_FOUND, "balance_after_paise DESC,"))
def reconcile_implied_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconciliation.discrepancies(load(spark, sf_dir, "chain"), implied_order=True)


@query(_on_chain("SELECT line_id, min(CASE WHEN rn = 1 THEN id END) AS anchor_id, count(*) FILTER (WHERE rn > 1 AND gap <> 0) AS breaks, greatest(0.0, 1.0 - count(*) FILTER (WHERE rn > 1 AND gap <> 0)::DOUBLE / greatest(1, max(n) - 1)) AS confidence FROM g GROUP BY line_id"))
def chain_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconciliation.chain_confidence(load(spark, sf_dir, "chain"))


@query(_on_chain("SELECT type, count(*) AS n, CAST(sum(abs(gap)) AS BIGINT) AS gap_paise FROM (SELECT *, CASE WHEN gap < 0 THEN 'missing_outflow' ELSE 'missing_inflow' END AS type FROM g WHERE rn > 1 AND gap <> 0) GROUP BY type"))
def open_discrepancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.open_discrepancies(reconciliation.discrepancies(load(spark, sf_dir, "chain")).withColumn("status", F.lit("open")))


@query("SELECT line_id, arg_max(balance_after_paise, t_sec * 100000000 + ordinal) AS balance_paise, arg_min(balance_after_paise, t_sec * 100000000 + ordinal) AS anchor_balance_paise FROM entries WHERE balance_after_paise IS NOT NULL GROUP BY line_id", "entries")
def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "entries")
    return reconciliation.latest_balances(e).join(reconciliation.anchor_balances(e), "line_id")


@query("SELECT line_id, id, CAST(sum(amount_captured_paise) OVER (PARTITION BY line_id ORDER BY t_sec, ordinal ROWS UNBOUNDED PRECEDING) AS BIGINT) AS accrued_paise FROM entries", "entries")
def accrued_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconciliation.accrued(load(spark, sf_dir, "entries"), "amount_captured_paise").select("line_id", "id", "accrued_paise")


# Ledger tables --------------------------------------------------------------------------------------------------------------


@query(
    """SELECT a.id AS a, b.id AS b FROM entries a JOIN entries b ON a.line_id = b.line_id AND a.amount_captured_paise = b.amount_captured_paise
    AND coalesce(a.merchant_text, '') = coalesce(b.merchant_text, '') AND a.ordinal < b.ordinal AND abs(a.t_sec - b.t_sec) <= 3600""",
    "entries",
)
def near_duplicate_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.near_duplicates(load(spark, sf_dir, "entries"), 3600)


@query("SELECT CAST(ordinal // 3 AS STRING) AS id, min(ordinal) AS seq, arg_max(amount_captured_paise, ordinal) AS amount_captured_paise, arg_max(direction, ordinal) AS direction FROM entries GROUP BY 1", "entries")
def upsert_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "entries").select(F.expr("ordinal DIV 3").cast("string").alias("id"), F.col("ordinal").alias("seq"), "amount_captured_paise", "direction")
    return ledger.upsert(e)


@query("SELECT CAST(ordinal // 3 AS STRING) AS id, min(ordinal) AS seq, arg_max_null(category_id, CASE WHEN ordinal % 2 = 0 THEN ordinal END) AS category_id FROM entries GROUP BY 1", "entries")
def patch_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "entries").select(F.expr("ordinal DIV 3").cast("string").alias("id"), F.col("ordinal").alias("seq"), "category_id", (F.col("ordinal") % 2 == 0).alias("set_category_id"))
    return ledger.patch(e, ("category_id",))


@query("SELECT id, amount_captured_paise, CASE WHEN ordinal % 10 = 0 THEN ordinal * 3 ELSE amount_effective_paise END AS amount_effective_paise FROM entries", "entries")
def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "entries")
    c = e.where("ordinal % 10 = 0").select("id", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.col("ordinal").alias("paise")), F.struct(F.lit(2).alias("seq"), (F.col("ordinal") * 3).alias("paise")))).alias("w")).select("id", "w.*")
    return ledger.correct(e, c).select("id", "amount_captured_paise", "amount_effective_paise")


@query("SELECT DISTINCT id FROM (SELECT CASE WHEN base_entry_id LIKE '%3' THEN 'x' ELSE '' END || base_entry_id AS id FROM settlements) WHERE id NOT IN (SELECT id FROM entries)", "settlements", "entries")
def unknown_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, s = _ledger(spark, sf_dir)
    return ledger.unknown_corrections(e, s.select(F.concat(F.when(F.col("base_entry_id").like("%3"), "x").otherwise(""), F.col("base_entry_id")).alias("id")))


def _pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 20).alias("user_id"), F.when(F.col("c_custkey") % 4 == 0, "bank").otherwise("credit_pool").alias("kind"), F.when(F.col("c_nationkey") % 5 != 0, (F.col("c_nationkey") % 5).cast("string")).alias("issuer"), F.when(F.col("c_custkey") % 9 != 0, (F.abs("c_acctbal").cast("bigint") % 50)).alias("available_credit_paise"))


@query(
    """WITH p AS (SELECT c_custkey AS id, c_custkey % 20 AS user_id, CASE WHEN c_custkey % 4 = 0 THEN 'bank' ELSE 'credit_pool' END AS kind, CASE WHEN c_nationkey % 5 <> 0 THEN c_nationkey % 5 END AS issuer,
      CASE WHEN c_custkey % 9 <> 0 THEN CAST(floor(abs(c_acctbal)) AS BIGINT) % 50 END AS credit FROM customer)
    SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.user_id = b.user_id AND a.issuer IS NOT DISTINCT FROM b.issuer AND a.credit = b.credit AND a.id < b.id AND a.kind = 'credit_pool' AND b.kind = 'credit_pool'"""
)
def shared_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.shared_pools(_pools(spark, sf_dir))


def _uuid(name: str) -> str:
    """SQL of the version 5 id of a name."""
    h = f"sha1(unhex('b9f8a4e21c3d4f5a9b6e7d8c9a0b1c2d') || encode({name}))"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', CAST('0x' || substr({h}, 17, 1) AS INT) % 4 + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


_KIND = "CASE ordinal % 4 WHEN 0 THEN 'bank' WHEN 1 THEN 'credit_pool' WHEN 2 THEN 'wallet' ELSE 'unattributed' END"


@query(
    f"""SELECT {_uuid("CAST(user_id AS STRING) || '|' || key")} AS id, true AS is_own_node, user_id, key, CASE WHEN k = 'unattributed' THEN 'bank' ELSE k END AS kind, issuer, CASE WHEN k = 'unattributed' THEN 'Unattributed at ' || issuer END AS display_name, k IN ('wallet', 'unattributed') AS balance_is_soft
    FROM (SELECT DISTINCT user_id, issuer, {_KIND} AS k, CASE ordinal % 4 WHEN 0 THEN 'bank|' || issuer || '|' || coalesce(tag_id, '?') WHEN 1 THEN 'credit|' || issuer || '|' || coalesce(tag_id, 'pool') WHEN 2 THEN 'wallet|' || issuer ELSE 'unattributed|' || issuer END AS key FROM entries)""",
    "entries",
)
def discover_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("bank", "credit_pool", "wallet", "unattributed"))), (F.col("ordinal") % 4 + 1).cast("int"))
    detail = F.when(F.col("ordinal") % 4 == 1, F.coalesce("tag_id", F.lit("pool"))).otherwise(F.col("tag_id"))
    s = load(spark, sf_dir, "entries").select("user_id", kind.alias("kind"), "issuer", detail.alias("detail"), F.col("ordinal").alias("seq"))
    return ledger.discover_lines(s)


@query(
    f"""SELECT {_uuid("user_id || '|' || kind || '|' || identity")} AS id, user_id, kind, arg_min(issuer, ordinal) AS issuer, arg_min(line_id, ordinal) AS line_id, count(DISTINCT 1) AS one FROM
    (SELECT *, CASE WHEN ordinal % 2 = 0 THEN 'upi' ELSE 'debit_card' END AS kind, CASE WHEN ordinal % 2 = 0 AND coalesce(merchant_text, '') <> '' THEN 'vpa|' || merchant_text ELSE 'card|' || issuer || '|' || coalesce(tag_id, '') END AS identity FROM entries)
    GROUP BY user_id, kind, identity""",
    "entries",
)
def discover_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "entries")
    s = e.select("user_id", F.when(F.col("ordinal") % 2 == 0, "upi").otherwise("debit_card").alias("kind"), "issuer", F.col("tag_id").alias("last4"), F.when(F.col("ordinal") % 2 == 0, F.col("merchant_text")).alias("vpa"), F.lit(None).cast("string").alias("holder"), "line_id", F.col("ordinal").alias("seq"))
    return ledger.discover_instruments(s).select("id", "user_id", "kind", "issuer", "line_id", F.lit(1).cast("long").alias("one"))


@query("SELECT id, CASE WHEN line_id LIKE '%-2' THEN user_id || '-1' ELSE line_id END AS line_id FROM entries", "entries")
def merge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "entries")
    lines = e.select(F.col("line_id").alias("id"), "user_id").distinct()
    merges = lines.where("id like '%-2'").select(F.col("id").alias("gone"), F.concat("user_id", F.lit("-1")).alias("keep"))
    return ledger.merge_lines(lines, e.select("id", "line_id", F.lit(False).alias("is_confirmed")), e, merges)[2].select("id", "line_id")


@query("SELECT child.id, child.reverses_entry_id FROM entries child WHERE reverses_entry_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM entries p WHERE p.id = child.reverses_entry_id)", "entries")
def orphan_reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "entries")
    return ledger.orphans(e, "reverses_entry_id", e).select("id", "reverses_entry_id")


@query("SELECT c.id, p.amount_effective_paise AS reversed_paise FROM entries c LEFT JOIN entries p ON c.reverses_entry_id = p.id", "entries")
def reversed_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.with_reversed(load(spark, sf_dir, "entries")).select("id", "reversed_paise")


@query("SELECT payee_id, count(*) AS n FROM entries WHERE category_id IS NULL AND tag_id IS NULL AND payee_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, payee_id LIMIT 20", "entries")
def unlabelled_payees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.unlabelled_payees(load(spark, sf_dir, "entries"))


@query("SELECT id, CASE tag_id WHEN 't1' THEN 't2' WHEN 't3' THEN NULL ELSE tag_id END AS tag_id FROM entries", "entries")
def retag(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.createDataFrame([("t1", "t2"), ("t3", None)], "tag_id string, to string")
    return ledger.retag(load(spark, sf_dir, "entries"), gone).select("id", "tag_id")


# Settlements ------------------------------------------------------------------------------------------------------------------


@query(
    """SELECT s.id AS settlement_id, arg_min(c.id, c.t_sec * 100000000 + c.ordinal) AS credit_id FROM settlements s JOIN entries c ON c.direction = 'INCOME' AND c.user_id = s.user_id AND c.amount_captured_paise = s.expected_amount_paise
    AND (s.expected_sec IS NULL OR c.t_sec >= s.expected_sec - 86400) WHERE s.status = 'pending' GROUP BY s.id""",
    "entries",
    "settlements",
)
def match_refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, s = _ledger(spark, sf_dir)
    return settlement.match_refunds(e.where("direction = 'INCOME'").withColumn("amount_paise", F.col("amount_captured_paise")), s.where("status = 'pending'"))


@query("SELECT id, CASE WHEN base_entry_id LIKE '%7' THEN 'written_off' ELSE status END AS status FROM settlements", "settlements")
def write_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "settlements")
    return settlement.write_off(s, s.where("base_entry_id like '%7'").select("id")).select("id", "status")


@query(
    """SELECT CASE WHEN days < 5 THEN 'fresh' WHEN days <= 30 THEN 'aging' ELSE 'overdue' END AS bucket, count(*) AS n, CAST(sum(expected_amount_paise) AS BIGINT) AS expected_paise FROM
    (SELECT *, 40 - CAST(floor(expected_sec * 40.0 / 86400) AS BIGINT) AS days FROM settlements WHERE status = 'pending' AND expected_sec IS NOT NULL) GROUP BY 1""",
    "settlements",
)
def refund_aging(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "settlements").where("expected_sec is not null").withColumn("expected_at", F.timestamp_seconds(F.col("expected_sec") * 40))
    return settlement.refund_aging(s, F.timestamp_seconds(F.lit(40 * 86_400)))


@query(
    """SELECT DISTINCT node FROM (SELECT unnest(['PAYTM','AMZNPE','AMAZONPAY','PHONEPE','MOBIKWIK','FREECHARGE','SLICE','JUPITER','FI','OLAMONEY','AIRTELMONEY','JIOMONEY','AMAZONPAYLATER','LAZYPAY','SIMPL']) AS node
    UNION ALL SELECT upper(issuer) FROM entries WHERE id IN (SELECT settle_entry_id FROM settlements WHERE kind = 'self_transfer'))""",
    "entries",
    "settlements",
)
def own_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, s = _ledger(spark, sf_dir)
    return settlement.own_nodes(s, e)


@query(
    """SELECT id, principal_paise, paid_paise, greatest(0, principal_paise - paid_paise) AS remaining_paise, CASE WHEN forgiven THEN 'forgiven' WHEN principal_paise <= paid_paise THEN 'closed' WHEN paid_paise > 0 THEN 'partial' ELSE 'open' END AS status FROM
    (SELECT 'd' || CAST(s_suppkey AS STRING) AS id, s_suppkey * 3000 AS principal_paise, s_suppkey % 7 = 0 AS forgiven FROM supplier) d LEFT JOIN LATERAL (SELECT CAST(coalesce(sum(coalesce(settled_amount_paise, 0)), 0) AS BIGINT) AS paid_paise FROM settlements WHERE status IN ('settled', 'partial') AND personal_debt_id = d.id) ON true""",
    "settlements",
)
def debts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("d"), F.col("s_suppkey").cast("string")).alias("id"), (F.col("s_suppkey") * 3000).alias("principal_paise"), F.when(F.col("s_suppkey") % 7 == 0, "forgiven").otherwise("open").alias("status"))
    return settlement.debts(d, load(spark, sf_dir, "settlements"))


@query(
    """SELECT CAST(c_custkey AS STRING) AS id, least(n, 6) AS paid_installments, 6 - least(n, 6) AS remaining_installments FROM (SELECT c_custkey, (SELECT count(*) FROM entries WHERE is_counted AND direction = 'EXPENSE'
    AND line_id = CAST(c_custkey % 100 AS STRING) || '-0' AND amount_effective_paise = c_custkey % 400) AS n FROM customer)""",
    "entries",
)
def liabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    due = c.select(F.col("c_custkey").cast("string").alias("id"), F.concat((F.col("c_custkey") % 100).cast("string"), F.lit("-0")).alias("line_id"), (F.col("c_custkey") % 400).alias("installment_paise"), F.lit(6).cast("long").alias("tenure_months"))
    return settlement.liability_payments(due, load(spark, sf_dir, "entries"))


@query(
    """SELECT c.id AS credit_id, arg_max(d.id, d.t_sec * 100000000 + d.ordinal) AS debit_id FROM entries d JOIN entries c ON d.direction = 'EXPENSE' AND c.direction = 'INCOME' AND d.user_id = c.user_id
    AND d.merchant_text = c.merchant_text AND d.amount_captured_paise = c.amount_captured_paise AND c.t_sec > d.t_sec AND c.t_sec <= d.t_sec + 30 * 86400 GROUP BY c.id""",
    "entries",
)
def suspected_refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settlement.suspected_refunds(load(spark, sf_dir, "entries"))


@query(
    """SELECT user_id, 'm' || CAST(user_id % 9 AS STRING) AS merchant_text, user_id * 10 AS amount_paise, count(*) AS n, avg(gap) AS gap_days FROM (SELECT user_id, d - lag(d) OVER (PARTITION BY user_id ORDER BY d, o_orderkey) AS gap
    FROM (SELECT o_custkey AS user_id, o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 20 ELSE 30 END * row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + o_orderkey % 5 AS d FROM orders)) GROUP BY user_id HAVING count(*) >= 3 AND min(gap) >= 25 AND max(gap) <= 35"""
)
def recurring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as monthly payments, a third of them every twenty days."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.when(F.col("o_custkey") % 3 == 0, 20).otherwise(30) * F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) + F.col("o_orderkey") % 5
    e = o.select(F.col("o_custkey").alias("user_id"), F.concat(F.lit("m"), (F.col("o_custkey") % 9).cast("string")).alias("merchant_text"), (F.col("o_custkey") * 10).alias("amount_captured_paise"), F.timestamp_seconds(day * 86_400).alias("txn_time"), F.col("o_orderkey").alias("ordinal"), F.lit("EXPENSE").alias("direction"))
    return settlement.recurring(e)


@query(
    """, m AS (SELECT line_id, id, t_sec * 40 // 86400 AS d, balance_after_paise % 9 - lag(balance_after_paise % 9) OVER (PARTITION BY line_id ORDER BY t_sec * 40, ordinal) AS move FROM entries WHERE balance_after_paise IS NOT NULL)
    SELECT DISTINCT d.line_id, d.id AS entry_id, u.move AS drop_paise FROM m d JOIN m u ON d.line_id = u.line_id AND d.move = -u.move AND d.move < 0 AND u.d - d.d BETWEEN 25 AND 35""",
    "entries",
)
def suspected_emi(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "entries").where("balance_after_paise is not null")
    return settlement.suspected_emi(e.withColumn("balance_after_paise", F.col("balance_after_paise") % 9).withColumn("txn_time", F.timestamp_seconds(F.col("t_sec") * 40)))


@query(
    f"""SELECT CAST(o.seq AS STRING) AS code_id, CAST(arg_min(e.seq, e.t_sec * 100000000 + e.seq) AS STRING) AS entry_id FROM (SELECT * FROM messages WHERE shape = 4) o
    JOIN (SELECT * FROM messages WHERE {by_shape(lambda s: str(s.verb == 'out' and s.reason == 'admit'))}) e ON o.user_id % 50 = e.user_id % 50 AND o.paise % 300 = e.paise % 300 AND e.t_sec BETWEEN o.t_sec AND o.t_sec + 86400 GROUP BY o.seq""",
    "messages",
)
def code_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and expenses of fewer users and amounts than there are, so that they meet."""
    gated = gating.gate(load(spark, sf_dir, "messages").withColumn("sender", F.lit("VM-YESBNK")))
    # Written without bodies: what is read from them is read once, for codes and expenses.
    rows = gated.select(F.col("seq").cast("string").alias("id"), "seq", (F.col("user_id") % 50).alias("user_id"), (F.col("paise") % 300).alias("amount_paise"), F.timestamp_seconds("t_sec").alias("received_at"), "gate", F.when(classify.verb_direction(F.col("body")) == "out", "EXPENSE").alias("direction"), amounts.has_amount(F.col("body")).alias("named"))
    rows = written(rows)
    return settlement.code_links(rows.where("gate.buffered and named"), rows.where("gate.admit"), 86_400)


@query(
    """SELECT line_id, count(*) AS credits, CAST(sum(credit) AS BIGINT) AS income_paise FROM (SELECT line_id, amount_captured_paise % 100 AS credit, CAST(floor(balance_after_paise::DOUBLE * 0.0001 + 0.5) AS BIGINT) AS e, ordinal FROM entries WHERE balance_after_paise IS NOT NULL)
    WHERE ordinal % 3 <> 0 AND e > 0 AND abs(credit - e)::DOUBLE / e <= 0.5 GROUP BY line_id""",
    "entries",
)
def interest_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "entries").where("balance_after_paise is not null")
    return settlement.interest_income(e.select("line_id", F.col("balance_after_paise").alias("balance_before_paise"), (F.col("amount_captured_paise") % 100).alias("credit_paise"), (F.col("ordinal") % 3 != 0).alias("confirmed"), F.lit(0.0001).alias("rate_daily")))


@query(_on_chain("SELECT line_id, id AS entry_id, CASE WHEN length(id) % 3 = 0 THEN 'ignored' WHEN length(id) % 3 = 1 THEN 'resolved' ELSE 'open' END AS status, CASE WHEN length(id) % 3 = 0 THEN 'ignored' WHEN length(id) % 3 = 1 THEN 'manual_added' END AS resolution FROM g WHERE rn > 1 AND gap <> 0"))
def resolved_discrepancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reconciliation.discrepancies(load(spark, sf_dir, "chain"))
    given = found.select("line_id", "entry_id", F.when(F.length("entry_id") % 3 == 0, "ignored").when(F.length("entry_id") % 3 == 1, "manual_added").alias("resolution")).where("resolution is not null")
    return settlement.resolve_discrepancies(found, given).select("line_id", "entry_id", "status", "resolution")


_IN = f"{_X} AND t_sec >= 10000 AND t_sec < 50000"


@query(
    _on_bases(
        f"""SELECT 'category' AS kind, CAST(coalesce(category_id, -1) AS STRING) AS key, CAST(sum(c) AS BIGINT) AS amount_paise {_IN} GROUP BY 2 UNION ALL SELECT 'tag', coalesce(tag_id, '__untagged__'), CAST(sum(c) AS BIGINT) {_IN} GROUP BY 2
        UNION ALL SELECT 'line', line_id, CAST(sum(c) AS BIGINT) {_IN} GROUP BY 2 UNION ALL SELECT 'total', NULL, CAST(sum(c) AS BIGINT) {_IN}"""
    )
)
def breakdowns_of_a_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, s = _ledger(spark, sf_dir)
    return aggregation.breakdowns(e.where((F.col("txn_time") >= F.timestamp_seconds(F.lit(10_000))) & (F.col("txn_time") < F.timestamp_seconds(F.lit(50_000)))), s)


@query("SELECT seq FROM messages WHERE t_sec >= least(900000 - 5 * 86400, (SELECT max(t_sec) FROM messages) - 2 * 86400)", "messages")
def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five days, and in any case the last two before the last message."""
    m = load(spark, sf_dir, "messages", deal=False).withColumn("received_at", F.timestamp_seconds("t_sec"))
    return reports.backfill(m, F.timestamp_seconds(F.lit(900_000)), 5, before_last=2).select("seq")


# Parts, templates, the whole pipeline, streams -------------------------------------------------------------------------------------


@query(
    """SELECT CAST(l_orderkey AS STRING) AS ref_id, count(DISTINCT l_linenumber) FILTER (WHERE l_linenumber <= 4) = 4 AS complete, CASE WHEN count(DISTINCT l_linenumber) FILTER (WHERE l_linenumber <= 4) = 4 THEN
    arg_max(l_partkey, l_suppkey * 10000000 + l_partkey) FILTER (WHERE l_linenumber = 1) || '|' || arg_max(l_partkey, l_suppkey * 10000000 + l_partkey) FILTER (WHERE l_linenumber = 2) || '|' || arg_max(l_partkey, l_suppkey * 10000000 + l_partkey) FILTER (WHERE l_linenumber = 3) || '|' || arg_max(l_partkey, l_suppkey * 10000000 + l_partkey) FILTER (WHERE l_linenumber = 4) || '|' END AS body,
    CAST(4 - count(DISTINCT l_linenumber) FILTER (WHERE l_linenumber <= 4) AS INT) AS n_missing FROM lineitem GROUP BY l_orderkey"""
)
def reassemble_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = li.select(F.col("l_orderkey").cast("string").alias("ref_id"), F.col("l_linenumber").cast("int").alias("part_index"), F.lit(4).alias("total_parts"), F.concat(F.col("l_partkey").cast("string"), F.lit("|")).alias("text"), (F.col("l_suppkey") * 10_000_000 + F.col("l_partkey")).alias("ordinal"))
    return multipart.reassemble(parts).select("ref_id", "complete", "body", F.size("missing").alias("n_missing"))


def _issued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages under one issuer but for those of none."""
    return load(spark, sf_dir, "messages").select("seq", "body", F.when(F.col("shape") != 2, F.lit("YESBNK")).alias("issuer"))


def _shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, masked once."""
    return written(templates.shape(_issued(spark, sf_dir)))


_TRUSTED, _READ = by_shape(lambda s: s.trusted), f"CAST({by_shape(lambda s: s.read)} AS BIGINT)"


@query(
    f"""SELECT CASE WHEN shape = 2 THEN '' ELSE 'YESBNK' END AS issuer, sha256({SKELETON}) AS fingerprint, CASE WHEN bool_and({_TRUSTED}) THEN 'trusted' ELSE 'flagged' END AS trust_state,
    CASE WHEN bool_and({_TRUSTED}) THEN 5 ELSE 0 END AS validation_runs FROM messages GROUP BY 1, 2""",
    "messages",
)
def induce_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.induce(_shaped(spark, sf_dir)).drop("pattern", "groups", "reading")


@query(f"SELECT seq, {_READ} AS amount_paise, CAST({by_shape(lambda s: s.balance)} AS BIGINT) AS balance_paise, {by_shape(lambda s: s.merchant)} AS merchant FROM messages", "messages")
def apply_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _shaped(spark, sf_dir)
    return templates.apply_templates(m, templates.induce(m)).select("seq", "amount_paise", "balance_paise", "merchant")


_CATEGORY = "CASE x_merchant " + " ".join(f"WHEN '{m}' THEN {quoted(c)}" for m, c in MERCHANTS) + " END"
_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST('0x' || substr(h, 17, 1) AS INT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query(
    f""", e AS (SELECT seq, user_id, {_ENTITY} AS issuer, {by_shape(lambda s: quoted(s.modality))} AS modality, {by_shape(lambda s: quoted(s.verb))} AS verb, {by_shape(lambda s: str(s.topup))} AS topup, {by_shape(lambda s: 'x_tail' if s.tail else 'NULL')} AS tail,
      CAST(coalesce(CASE WHEN {_TRUSTED} THEN {by_shape(lambda s: s.read)} END, {by_shape(lambda s: s.amounts[0] if s.amounts else 'NULL')}) AS BIGINT) AS amount_paise, CAST({by_shape(lambda s: s.balance)} AS BIGINT) AS balance_after_paise,
      CASE WHEN {_TRUSTED} THEN {by_shape(lambda s: s.merchant)} END AS merchant_text, CASE WHEN {_TRUSTED} AND {by_shape(lambda s: str('x_merchant' in s.merchant))} THEN {_CATEGORY} END AS category, {by_shape(lambda s: 'x_ref' if s.reference else 'NULL')} AS reference,
      {by_shape(lambda s: "split_part(x_vpa, '@', 1)" if 'vpa' in s.body else 'NULL')} AS vpa, t_sec, {by_shape(lambda s: "CAST(epoch(strptime(x_day, '%d-%m-%y')) AS BIGINT)" if s.day else 't_sec')} AS txn_sec
      FROM messages WHERE {by_shape(lambda s: str(s.reason == 'admit'))} AND sender NOT LIKE '+%'),
    k AS (SELECT *, issuer = 'PAYTM' AS wallet, CASE WHEN issuer = 'PAYTM' THEN 'wallet|' || issuer WHEN tail IS NOT NULL THEN 'bank|' || issuer || '|' || tail ELSE 'unattributed|' || issuer END AS line_key,
      CASE WHEN topup THEN 'TOPUP' WHEN issuer = 'PAYTM' AND verb = 'in' THEN 'TRANSFER' WHEN coalesce(verb, 'out') = 'out' THEN 'EXPENSE' ELSE 'INCOME' END AS direction FROM e),
    n AS (SELECT *, sha1(unhex('b9f8a4e21c3d4f5a9b6e7d8c9a0b1c2d') || encode(CAST(user_id AS STRING) || '|' || line_key || '|' || CASE WHEN reference IS NOT NULL THEN 'ref:' || reference ELSE direction || '|' || CAST(amount_paise AS STRING) || '|' || CAST(t_sec // 10 AS STRING) END)) AS h,
      coalesce(vpa, lower(merchant_text)) AS payee_key, direction IN ('EXPENSE', 'INCOME') AND modality = 'actual' AS is_counted FROM k)
    SELECT {_UUID} AS id, min(seq) AS seq, {', '.join(f'arg_max_null({c}, n.seq) AS {c}' for c in ('user_id', 'issuer', 'line_key', 'direction', 'modality', 'amount_paise', 'balance_after_paise', 'merchant_text', 'category', 'payee_key', 'reference', 'txn_sec', 'is_counted'))} FROM n GROUP BY 1""",
    "messages",
)
def ledger_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages to ledger: templates are induced from all messages that become entries, gated and masked once."""
    m = load(spark, sf_dir, "messages").select("seq", "user_id", "sender", "body", F.timestamp_seconds("t_sec").alias("received_at"))
    # Gated, written and only then filtered: the filter would bring the whole gate into the stage a second time.
    m = written(templates.shape(written(gating.gate(m)).where("gate.admit")))
    learned = written(templates.induce(m.withColumn("issuer", F.col("gate.entity"))))
    return build_entries(m, learned).withColumn("txn_sec", F.unix_seconds("txn_time")).drop("txn_time")


@query(
    _on_bases(
        f"""SELECT user_id, {_SUMS}, any_value(cat) AS top_category_id, any_value(pay) AS top_payee_id, any_value(net) AS net_position_paise FROM bases
        LEFT JOIN (SELECT user_id, arg_min(category_id, -s * 1000 + category_id) AS cat FROM (SELECT user_id, category_id, sum(c) AS s FROM bases WHERE direction = 'EXPENSE' AND category_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1) USING (user_id)
        LEFT JOIN (SELECT user_id, first(payee_id ORDER BY s DESC, payee_id) AS pay FROM (SELECT user_id, payee_id, sum(c) AS s FROM bases WHERE direction = 'EXPENSE' AND payee_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1) USING (user_id)
        LEFT JOIN (SELECT user_id, CAST(sum(b) AS BIGINT) AS net FROM (SELECT user_id, line_id, arg_max(balance_after_paise, t_sec * 100000000 + ordinal) AS b FROM entries WHERE balance_after_paise IS NOT NULL GROUP BY 1, 2) GROUP BY 1) USING (user_id)
        GROUP BY user_id"""
    )
)
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dashboard(*_ledger(spark, sf_dir))


@query("SELECT CAST(ordinal // 3 AS STRING) AS id, min(ordinal) AS seq, arg_max(amount_captured_paise, ordinal) AS amount_captured_paise FROM entries GROUP BY 1", "entries")
def stream_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries' writes in four files, one a batch, into a ledger."""
    at = new_folder(spark)
    writes = load(spark, sf_dir, "entries").select(F.expr("ordinal DIV 3").cast("string").alias("id"), F.col("ordinal").alias("seq"), "amount_captured_paise")
    ingest.drain(_stream(writes, at), f"{at}/ledger", f"{at}/checkpoint").awaitTermination()
    return ingest.read_ledger(spark, f"{at}/ledger", writes.schema)


def _stream(rows: DataFrame, at: str) -> DataFrame:
    """The rows as a stream of four batches, each of a file a core, as one task reads a file."""
    files = rows.sparkSession.sparkContext.defaultParallelism
    rows.repartition(4 * files).write.parquet(f"{at}/in")
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/in")


def _ran(stream: DataFrame, at: str) -> DataFrame:
    """What a stream appends, once it has run through."""
    stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


@query(f"SELECT seq FROM messages WHERE {by_shape(lambda s: str(s.reason == 'otp'))} AND sender NOT LIKE '+%'", "messages")
def stream_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_folder(spark)
    return _ran(ingest.buffered(_stream(load(spark, sf_dir, "messages").select("user_id", "sender", "body", "seq"), at)).select("seq"), at)


@query("SELECT DISTINCT ordinal // 3 AS entry_id FROM entries", "entries")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each id three times, as retries come."""
    at = new_folder(spark)
    rows = load(spark, sf_dir, "entries").select(F.expr("ordinal DIV 3").alias("entry_id"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("received_at"))
    return _ran(ingest.once(_stream(rows, at)).select("entry_id"), at)


@query(
    """SELECT DISTINCT s.id AS settlement_id, c.id AS credit_id FROM settlements s JOIN entries c ON c.direction = 'INCOME' AND c.user_id = s.user_id AND c.amount_captured_paise = s.expected_amount_paise
    AND (s.expected_sec IS NULL OR c.t_sec >= s.expected_sec - 86400) WHERE s.status = 'pending'""",
    "entries",
    "settlements",
)
def stream_refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_folder(spark)
    e, s = _ledger(spark, sf_dir)
    credits = e.where("direction = 'INCOME'").select("id", "user_id", F.col("amount_captured_paise").alias("amount_paise"), "txn_time")
    return _ran(ingest.match_refunds(_stream(credits, at), s.where("status = 'pending'").select("id", "user_id", "expected_amount_paise", "expected_at")), at)


@query(f"SELECT seq FROM messages WHERE {by_shape(lambda s: str(s.reason == 'admit'))} AND sender NOT LIKE '+%'", "messages")
def stream_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_folder(spark)
    return _ran(ingest.admitted(_stream(load(spark, sf_dir, "messages").select("user_id", "sender", "body", "seq"), at)).select("seq"), at)

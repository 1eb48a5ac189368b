"""Streams whose keys hold state with event-time timers: parts, balance chains, one-time codes, refunds.

Rows may come in any order within the watermark; what a stream gives is what the batch operator of the same name gives
over all rows that came in time. State is kept in RocksDB, and a key that has nothing to wait for holds none.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from khata.operators.settlement import EARLY

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state needs it; queries that are already under way keep the store that they began with."""
    if spark.conf.get(_PROVIDER, None) != _ROCKSDB:
        spark.conf.set(_PROVIDER, _ROCKSDB)


def _rows(frames: Iterator[pd.DataFrame]) -> list[tuple]:
    """Plain tuples; a column of numbers with nulls, which pandas holds as floats, as whole numbers again."""
    plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) else v
    return [tuple(map(plain, r)) for frame in frames for r in frame.itertuples(index=False, name=None)]


def _micros(column: str) -> Any:
    return F.unix_micros(F.col(column).cast("timestamp"))


class _Held:
    """Rows or a dictionary of one key as one value: read and written at once, where a list takes a call of the store a row."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, empty: type = list):
        self.value, self.empty = handle.getValueState(name, "rows binary"), empty

    def get(self) -> Any:
        # Without a value the store gives none.
        found = self.value.get()
        return self.empty() if found is None else pickle.loads(found[0])

    def put(self, rows: Any) -> None:
        if rows:
            self.value.update((pickle.dumps(rows, pickle.HIGHEST_PROTOCOL),))
        elif self.value.exists():
            self.value.clear()


class _Keyed(StatefulProcessor):
    """A processor with one timer at most, at the next moment that matters."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def close(self) -> None:
        pass

    def wait_until(self, micros: int | None) -> None:
        """The timer fires once the watermark has passed the moment."""
        wanted = None if micros is None else micros // 1000
        for timer in list(self.handle.listTimers()):
            if timer == wanted:
                return
            self.handle.deleteTimer(timer)
        if wanted is not None:
            self.handle.registerTimer(wanted)


#: Keys that the references of messages in parts are dealt to.
BUCKETS = 512

# Messages in parts --------------------------------------------------------------------------------------------------------


class _Parts(_Keyed):
    """A bucket of messages: parts of those that wait, and until when those that have been given are remembered."""

    def __init__(self, wait: int, forget: int):
        self.wait, self.forget = wait, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.parts, self.closed = _Held(handle, "parts", dict), _Held(handle, "closed", dict)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        parts, closed, came, out = self.parts.get(), self.closed.get(), {}, []
        for ref, *r in _rows(rows):
            came.setdefault(ref, []).append(tuple(r))
        for ref, new in came.items():
            if ref in closed:
                new = [r for r in new if r[4] > closed[ref]]
                if not new:
                    continue
                del closed[ref]
            held = parts.pop(ref, []) + new
            first = min(r[4] for r in held)
            within = [r for r in held if r[4] <= first + self.wait]
            total, texts = self._read(within)
            if all(i in texts for i in range(1, total + 1)):
                out.append((ref, True, "".join(texts[i] for i in range(1, total + 1)), []))
                closed[ref] = first + self.forget
            else:
                parts[ref] = within
        yield from self._keep(parts, closed, out)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        parts, watermark, out = self.parts.get(), timerValues.getCurrentWatermarkInMs(), []
        closed = {ref: until for ref, until in self.closed.get().items() if until // 1000 >= watermark}
        for ref, held in list(parts.items()):
            first = min(r[4] for r in held)
            if (first + self.wait) // 1000 < watermark:
                total, texts = self._read(parts.pop(ref))
                out.append((ref, False, None, [i for i in range(1, total + 1) if i not in texts]))
                closed[ref] = first + self.forget
        yield from self._keep(parts, closed, out)

    def _read(self, held: list[tuple]) -> tuple[int, dict[int, str]]:
        """The least ordinal says how many parts there are; of a repeated one the last counts."""
        ordered = sorted(held, key=lambda r: r[3])
        return ordered[0][1], {r[0]: r[2] for r in ordered}

    def _keep(self, parts: dict, closed: dict, out: list[tuple]) -> Iterator[pd.DataFrame]:
        self.parts.put(parts)
        self.closed.put(closed)
        moments = [min(r[4] for r in held) + self.wait for held in parts.values()]
        self.wait_until(min([*moments, *closed.values()], default=None))
        if out:
            refs, complete, bodies, missing = map(list, zip(*out))
            yield pd.DataFrame({"ref_id": refs, "complete": complete, "body": bodies, "missing": missing})


def assemble(parts: DataFrame, late: str, wait_seconds: int, forget_seconds: int, buckets: int = BUCKETS) -> DataFrame:
    """ref_id, complete, body, missing: one row a message, when its last part comes or, incomplete, when the watermark
    passes `wait_seconds` after its first part.

    parts: ref_id string, part_index int, total_parts int, text string, ordinal long, received_at timestamp; late: the
    watermark's delay. Parts that come for a message that has been given are ignored until `forget_seconds` after its
    first part; then the reference may be used anew. Messages without a total of one or more are complete and empty.
    References are dealt to `buckets` keys, whose state is read and written once a batch and not once a message; a
    bucket's messages that wait or are remembered must fit in memory.
    """
    use_rocksdb(parts.sparkSession)
    rows = parts.withWatermark("received_at", late).select(F.pmod(F.xxhash64("ref_id"), F.lit(buckets)).alias("bucket"), "ref_id", F.col("part_index").alias("part"), F.col("total_parts").alias("total"), "text", "ordinal", _micros("received_at").alias("t"), "received_at")
    processor = _Parts(wait_seconds * 1_000_000, forget_seconds * 1_000_000)
    return rows.groupBy("bucket").transformWithStateInPandas(_Trimmed(processor, 1, 6), "ref_id string, complete boolean, body string, missing array<int>", "Append", "EventTime")


class _Trimmed(StatefulProcessor):
    """Gives a processor the columns `start` to `start + n` of its rows: without key and watermark columns."""

    def __init__(self, inner: _Keyed, start: int, n: int):
        self.inner, self.start, self.n = inner, start, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.inner.init(handle)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        yield from self.inner.handleInputRows(key, (f.iloc[:, self.start : self.start + self.n] for f in rows), timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self.inner.handleExpiredTimer(key, timerValues, expiredTimerInfo)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: Any) -> None:
        self.inner.handleInitialState(key, initialState, timerValues)

    def close(self) -> None:
        self.inner.close()


# Balance chains ------------------------------------------------------------------------------------------------------------


class _Chain(_Keyed):
    """open: entries that an earlier one may still come before, each with the gap given for it. base: the balance before them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = _Held(handle, "open")
        self.base = handle.getValueState("base", "balance long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.open.get()
        base = (True, self.base.get()[0]) if self.base.exists() else (False, None)
        chain = sorted([*held, *((*r, None) for r in _rows(rows))], key=lambda r: (r[0], r[1]))
        out, told, (anchored, before) = [], [], base
        for t, ordinal, id_, delta, balance, hold, gap in chain:
            # A hold does not move the balance, unless it is the anchor.
            now = None
            if not anchored or not hold:
                if anchored and balance is not None and before is not None and balance - before != delta:
                    now = balance - before - delta
                anchored, before = True, balance
            out += [(id_, g, c) for g, c in ((gap, -1), (now, 1)) if g is not None and gap != now]
            told.append((t, ordinal, id_, delta, balance, hold, now))
        self._settle(told, base, timerValues.getCurrentWatermarkInMs() * 1000)
        if out:
            ids, gaps, changes = zip(*out)
            yield pd.DataFrame({"line_id": key[0], "entry_id": ids, "gap_paise": gaps, "change": changes})

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = self.open.get()
        self._settle(held, (True, self.base.get()[0]) if self.base.exists() else (False, None), timerValues.getCurrentWatermarkInMs() * 1000)
        return
        yield

    def _settle(self, chain: list[tuple], base: tuple[bool, int | None], watermark: int) -> None:
        """Entries before the watermark are final: of them only the last balance stays."""
        anchored, before = base
        final = [r for r in chain if r[0] < watermark]
        for _, _, _, _, balance, hold, _ in final:
            if not anchored or not hold:
                anchored, before = True, balance
        rest = chain[len(final) :]
        if final:
            self.base.update((before,))
        self.open.put(rest)
        self.wait_until(rest[-1][0] + 1000 if rest else None)


def chain_gaps(entries: DataFrame, late: str) -> DataFrame:
    """line_id, entry_id, gap_paise, change (1: found, -1: taken back) as entries come in any order within the watermark.

    entries: line_id string, id string, delta_paise long (signed), balance_after_paise long, is_hold boolean, txn_time
    timestamp, ordinal long. An entry that comes between two others takes back the gap of the later one and gives both
    anew. The sum of changes by entry and gap leaves what operators.reconciliation.discrepancies finds. A line's state
    is its entries from the watermark on and the balance before them.
    """
    use_rocksdb(entries.sparkSession)
    rows = entries.withWatermark("txn_time", late).select("line_id", _micros("txn_time").alias("t"), "ordinal", "id", F.col("delta_paise").alias("delta"), F.col("balance_after_paise").alias("balance"), F.coalesce("is_hold", F.lit(False)).alias("hold"), "txn_time")
    return rows.groupBy("line_id").transformWithStateInPandas(_Trimmed(_Chain(), 1, 6), "line_id string, entry_id string, gap_paise long, change int", "Append", "EventTime")


# Codes and spends ----------------------------------------------------------------------------------------------------------


class _Codes(_Keyed):
    """Codes (kind 0) that wait for their spend, and spends (kind 1) that an earlier code may still come before."""

    def __init__(self, life: int):
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = _Held(handle, "held")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        yield from self._go([*self.held.get(), *_rows(rows)], timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._go(self.held.get(), timerValues.getCurrentWatermarkInMs() * 1000)

    def _go(self, held: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        out, stay, after, moments = [], [], None, []
        # Backwards, so that each code knows the spend that follows it next.
        for row in sorted(held, reverse=True):
            t, kind, _, id_ = row
            if kind == 1:
                after = row
                if t >= watermark:
                    stay.append(row)
                    moments.append(t)
                continue
            match = after if after is not None and after[0] - t <= self.life else None
            # Final once nothing can come in between, or the code's life is over.
            final = t + self.life if match is None else match[0]
            if final >= watermark:
                stay.append(row)
                moments.append(final)
            elif match is not None:
                out.append((id_, match[3]))
        self.held.put(stay)
        self.wait_until(min(moments) + 1000 if stay else None)
        if out:
            codes, entries = zip(*out)
            yield pd.DataFrame({"code_id": codes, "entry_id": entries})


def code_links(codes: DataFrame, spends: DataFrame, late: str, seconds: int = 600) -> DataFrame:
    """code_id, entry_id as operators.settlement.code_links, when no earlier spend can come any more.

    codes, spends: id string, user_id long, amount_paise long, received_at timestamp, seq long, both streams. A code
    lives `seconds`; linked or not, nothing is left of it once the watermark has passed its life.
    """
    use_rocksdb(codes.sparkSession)

    def side(df: DataFrame, kind: int) -> DataFrame:
        return df.where("amount_paise is not null").select("user_id", "amount_paise", _micros("received_at").alias("t"), F.lit(kind).alias("kind"), F.col("seq").cast("long").alias("o"), F.col("id").cast("string").alias("id"), "received_at")

    both = side(codes, 0).unionByName(side(spends, 1)).withWatermark("received_at", late)
    return both.groupBy("user_id", "amount_paise").transformWithStateInPandas(_Trimmed(_Codes(seconds * 1_000_000), 2, 4), "code_id string, entry_id string", "Append", "EventTime")


def code_spends(codes: DataFrame, spends: DataFrame, late: str, seconds: int = 600) -> DataFrame:
    """code_id, entry_id, received_at: every spend of a code's user and amount within `seconds` after it, by a
    stream-stream outer join; a code without any comes once, with null, when the watermark has passed its life."""
    c = codes.where("amount_paise is not null").select(F.col("id").alias("code_id"), F.col("user_id").alias("c_user"), F.col("amount_paise").alias("c_amount"), F.col("received_at").alias("c_at")).withWatermark("c_at", late)
    s = spends.select(F.col("id").alias("entry_id"), F.col("user_id").alias("s_user"), F.col("amount_paise").alias("s_amount"), F.col("received_at").alias("s_at")).withWatermark("s_at", late)
    on = F.expr(f"c_user = s_user and c_amount = s_amount and s_at >= c_at and s_at <= c_at + interval {seconds} seconds")
    return c.join(s, on, "left_outer").select("code_id", "entry_id", F.col("c_at").alias("received_at"))


# Refunds -------------------------------------------------------------------------------------------------------------------


class _Refunds(_Keyed):
    """waiting: refunds that no credit has settled, in the order in which they are served; credits: those whose time the
    watermark has not passed, so that they are dealt in the order of their times."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting, self.credits = _Held(handle, "waiting"), _Held(handle, "credits")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: Any) -> None:
        # A key's first state comes in as many frames as it fills.
        self.waiting.put(sorted([*self.waiting.get(), *_rows(iter([initialState[["t", "settlement_id"]]]))]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if self.waiting.value.exists():
            yield from self._go([*self.credits.get(), *_rows(rows)], timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._go(self.credits.get(), timerValues.getCurrentWatermarkInMs() * 1000)

    def _go(self, credits: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        waiting, at, out = self.waiting.get(), 0, []
        credits.sort()
        passed = [c for c in credits if c[0] < watermark]
        for t, _, id_ in passed:
            if at < len(waiting) and waiting[at][0] <= t:
                out.append((waiting[at][1], id_))
                at += 1
        rest = credits[len(passed) :] if at < len(waiting) else []
        self.waiting.put(waiting[at:])
        self.credits.put(rest)
        self.wait_until(rest[0][0] + 1000 if rest else None)
        if out:
            refunds, ids = zip(*out)
            yield pd.DataFrame({"settlement_id": refunds, "credit_id": ids})


def settle_refunds(credits: DataFrame, pending: DataFrame, late: str) -> DataFrame:
    """settlement_id, credit_id as operators.settlement.settle_refunds, as credits come in any order within the watermark.

    credits: a stream of id string, user_id, amount_paise long, txn_time timestamp, ordinal long; pending: a table of id,
    user_id, expected_amount_paise, expected_at, which is the keys' first state.
    """
    use_rocksdb(credits.sparkSession)
    first = pending.select(F.col("user_id").cast("string").alias("user_id"), F.col("expected_amount_paise").alias("amount_paise"), F.coalesce(F.unix_micros((F.col("expected_at") - F.expr(EARLY)).cast("timestamp")), F.lit(-(1 << 62))).alias("t"), F.col("id").cast("string").alias("settlement_id"))
    rows = credits.withWatermark("txn_time", late).select(F.col("user_id").cast("string").alias("user_id"), "amount_paise", _micros("txn_time").alias("t"), F.col("ordinal").cast("long").alias("o"), F.col("id").cast("string").alias("id"), "txn_time")
    return rows.groupBy("user_id", "amount_paise").transformWithStateInPandas(_Trimmed(_Refunds(), 2, 3), "settlement_id string, credit_id string", "Append", "EventTime", first.groupBy("user_id", "amount_paise"))

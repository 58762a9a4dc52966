"""A memory with a time to live: of repeats of a key, which rows pass.

A row passes if its key isn't remembered; it is then remembered for the time to live from that moment on, which repeats don't
prolong. So a key's passing times are a greedy chain: the first, then the first more than the time to live behind it, and so on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SPAN = 64  # times to live in one slice of time


class Memory:
    """Remembered keys with the time at which each passed, oldest first; of at most `most` keys (None: any number) the oldest go."""

    def __init__(self, ttl: int, most: int | None = None, known: dict[str, int] | None = None):
        self.ttl, self.most, self.known = ttl, most, dict(known or {})

    def expire(self, now: int) -> None:
        while self.known and now - (oldest := next(iter(self.known.items())))[1] > self.ttl:
            del self.known[oldest[0]]

    def passes(self, key: str, now: int) -> bool:
        """Times come in order; an earlier one counts as that of the last."""
        self.expire(now)
        if key in self.known:
            return False
        while self.most and len(self.known) >= self.most:
            del self.known[next(iter(self.known))]
        self.known[key] = max(now, next(reversed(self.known.values()), now))
        return True


def _whole_groups(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables that end with a group, and where each of their groups begins."""
    held: list[pa.RecordBatch] = []

    def firsts(table: pa.Table) -> np.ndarray:
        new = np.ones(table.num_rows, bool)
        if table.num_rows > 1:
            new[1:] = False
            for c in columns:
                own = table[c].combine_chunks()
                new[1:] |= pc.not_equal(own.slice(1), own.slice(0, len(own) - 1)).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        begin = firsts(table)
        if begin[-1]:
            yield table.slice(0, int(begin[-1])), begin[:-1]
        held = table.slice(int(begin[-1])).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, firsts(table)


class _Chains:
    """Of sorted groups of one slice of time each: the next row that passes after each row, all groups at a time."""

    def __init__(self, table: pa.Table, begin: np.ndarray, ttl: int):
        self.begin, self.end = begin, np.append(begin[1:], table.num_rows)
        self.group = np.repeat(np.arange(len(begin)), self.end - begin)
        self.at = table["us"].to_numpy()
        self.start = table["slice"].to_numpy()[begin] * (SPAN * ttl)
        self.wide = (SPAN + 2) * ttl + 2
        self.line = self.group * self.wide + (self.at - self.start[self.group])
        self.next = self.first_behind(self.group, self.at + ttl)

    def first_behind(self, group: np.ndarray, time: np.ndarray) -> np.ndarray:
        """The first row of each group behind a time; the group's end without one."""
        ahead = np.clip(time - self.start[group], -1, self.wide - 2)
        return np.minimum(np.searchsorted(self.line, group * self.wide + ahead, "right"), self.end[group])


def let_through(rows: DataFrame, keys: list[str], at: str, *, ttl: float) -> DataFrame:
    """The rows of a table that pass, each with its columns; of rows equal in keys and time one.

    at: a timestamp; rows without one or with a null key don't pass. ttl: seconds, more than 0. Equal (keys, time) become one before
    anything is sorted. A key may hold any share of the rows: its rows are dealt out by slices of SPAN times to live. Each slice gives the
    last passing time as a function of the one before the slice, a few steps; those are followed per key, one row a slice; then each slice marks its rows.
    """
    step = round(ttl * 1_000_000)
    if step <= 0:
        raise ValueError("the time to live must be positive")
    named = rows.select(F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys])).alias("key"), F.unix_micros(F.col(f"`{at}`").cast("timestamp")).alias("us"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    for k in keys:
        named = named.filter(F.col(f"row.`{k}`").isNotNull())
    one = named.filter("us is not null").groupBy("key", "us").agg(F.first("row").alias("row"))
    one = one.withColumn("slice", F.expr(f"us div {SPAN * step}L - if(us % {SPAN * step}L < 0, 1, 0)"))
    dealt = one.repartition("key", "slice").sortWithinPartitions("key", "slice", "us")

    steps_schema = pa.schema([("key", pa.string()), ("slice", pa.int64()), ("upto", pa.list_(pa.int64())), ("last", pa.list_(pa.int64()))])

    def summarise(batches):
        for table, begin in _whole_groups(batches, "key", "slice"):
            c = _Chains(table, begin, step)
            last = np.where(c.next == c.end[c.group], np.arange(len(c.at)), c.next)
            while True:
                further = last[last]
                if (further == last).all():
                    break
                last = further
            # Whatever passed before the slice, the first row that passes stands within the time to live from its start, or first behind that.
            stop = np.minimum(c.first_behind(np.arange(len(begin)), c.start + step - 1) + 1, c.end)
            upto, exits = [], []
            for a, b in zip(begin.tolist(), stop.tolist(), strict=True):
                run = np.flatnonzero(np.append(last[a + 1 : b] != last[a : b - 1], True)) + a
                upto.append(c.at[run])
                exits.append(c.at[last[run]])
            heads = table.take(pa.array(begin))
            yield pa.RecordBatch.from_arrays([heads["key"].combine_chunks(), heads["slice"].combine_chunks(), pa.array(upto, pa.list_(pa.int64())), pa.array(exits, pa.list_(pa.int64()))], schema=steps_schema)

    entry_schema = pa.schema([("key", pa.string()), ("slice", pa.int64()), ("entry", pa.int64())])

    def follow(batches):
        key, passed = None, None
        for batch in batches:
            entries = []
            for own, upto, last in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if own != key:
                    key, passed = own, None
                entries.append(passed)
                for edge, exit_ in zip(upto, last, strict=True):
                    if passed is None or passed + step < edge:
                        passed = exit_
                        break
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(entries, pa.int64())], schema=entry_schema)

    steps = dealt.select("key", "slice", "us").mapInArrow(summarise, "key string, slice long, upto array<long>, last array<long>")
    entries = steps.repartition("key").sortWithinPartitions("key", "slice").mapInArrow(follow, "key string, slice long, entry long")
    # A key's slices in which something passed before; the rest begin afresh.
    both = one.join(entries.filter("entry is not null"), ["key", "slice"], "left").select("key", "slice", "us", "entry", "row")
    kept_schema = to_arrow_schema(both.select("row").schema)

    def mark(batches):
        for table, begin in _whole_groups(batches, "key", "slice"):
            c = _Chains(table, begin, step)
            entry = table["entry"].combine_chunks().take(pa.array(begin))
            behind = np.where(np.asarray(entry.is_null()), c.start - 1, pc.fill_null(entry, 0).to_numpy(zero_copy_only=False) + step)
            at = c.first_behind(np.arange(len(begin)), behind)
            kept = np.zeros(table.num_rows, bool)
            going = np.flatnonzero(at < c.end)
            while len(going):  # SPAN + 1 rounds at most
                kept[at[going]] = True
                at[going] = c.next[at[going]]
                going = going[at[going] < c.end[going]]
            for batch in table.select(["row"]).filter(pa.array(kept)).to_batches():
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(kept_schema.field("row").type)], schema=kept_schema)

    passed = both.repartition("key", "slice").sortWithinPartitions("key", "slice", "us").mapInArrow(mark, both.select("row").schema)
    return passed.select("row.*")


def let_through_limited(rows: DataFrame, account: list[str], keys: list[str], at: str, *, ttl: float, most: int = 1000) -> DataFrame:
    """let_through() with a memory of at most `most` keys for each account, the oldest forgotten first: (account, keys, at).

    What is forgotten depends on all of an account's rows in their order (by time, then key), so an account is one task's; that task
    goes through its rows one by one and holds `most` keys.
    """
    step = round(ttl * 1_000_000)
    columns = [*account, *[k for k in keys if k not in account], at]
    whole = rows.select(*columns)
    text = lambda names: F.to_json(F.struct(*[F.col(f"`{k}`") for k in names]))
    named = whole.select(text(account).alias("account"), text(keys).alias("key"), F.unix_micros(F.col(f"`{at}`").cast("timestamp")).alias("us"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    for k in keys:
        named = named.filter(F.col(f"row.`{k}`").isNotNull())
    one = named.filter("us is not null").groupBy("account", "key", "us").agg(F.first("row").alias("row"))
    schema = to_arrow_schema(one.select("row").schema)

    def go(batches):
        account, memory = None, Memory(step, most)
        for batch in batches:
            kept = []
            for own, key, us in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if own != account:
                    account, memory = own, Memory(step, most)
                kept.append(memory.passes(key, us))
            got = pa.Table.from_batches([batch]).select(["row"]).filter(pa.array(kept, pa.bool_()))
            for part in got.to_batches():
                yield pa.RecordBatch.from_arrays([part.column(0).cast(schema.field("row").type)], schema=schema)

    return one.repartition("account").sortWithinPartitions("account", "us", "key").mapInArrow(go, one.select("row").schema).select("row.*")


def let_through_stream(rows: DataFrame, account: list[str], keys: list[str], at: str, *, ttl: float, delay: str, most: int | None = None, in_order: bool = True) -> DataFrame:
    """The same of a stream, as (keys as one JSON text `key`, at).

    in_order: a row waits until the watermark (latest time seen less `delay`) has passed it, so what comes out is what let_through()
    gives of the whole table, in whatever order rows up to `delay` late arrived; later ones are lost. Else rows are judged as
    they come, each micro-batch by time, and a row earlier than what passed counts as a repeat. State: of each account the keys
    remembered, dropped once the watermark is beyond the time to live, and with in_order the rows that wait.
    """
    step = round(ttl * 1_000_000)
    text = lambda names: F.to_json(F.struct(*[F.col(f"`{k}`") for k in names]))
    ready = rows.select(text(account).alias("account"), text(keys).alias("key"), F.col(f"`{at}`").cast("timestamp").alias("at"), *[F.col(f"`{k}`").isNotNull().alias(f"there_{i}") for i, k in enumerate(keys)])
    for i in range(len(keys)):
        ready = ready.filter(f"there_{i}")
    ready = ready.filter("at is not null").withWatermark("at", delay).select("account", "key", "at", F.unix_micros("at").alias("us"))

    def judge(group, frames, state: GroupState):
        known, waiting = json.loads(state.get[0]) if state.exists else ({}, [])
        if not state.hasTimedOut:
            waiting += [(int(us), key) for frame in frames for us, key in zip(frame["us"], frame["key"], strict=True)]
        seen = state.getCurrentWatermarkMs() * 1000
        memory, now = Memory(step, most, known), sorted(map(tuple, waiting))
        if in_order:
            now, waiting = [w for w in now if w[0] <= seen], [w for w in now if w[0] > seen]
        else:
            waiting = []
        out = [(key, us) for us, key in now if memory.passes(key, us)]
        memory.expire(min([seen, *(w[0] for w in waiting)]))
        if memory.known or waiting:
            state.update((json.dumps([memory.known, waiting]),))
            nearest = waiting[0][0] if waiting else min(memory.known.values()) + step
            state.setTimeoutTimestamp(max(nearest, seen) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "us"]).astype({"key": object, "us": "int64"})

    found = ready.groupBy("account").applyInPandasWithState(judge, "key string, us long", "state string", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("key", F.timestamp_micros("us").alias(at))

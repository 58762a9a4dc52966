"""Exact removal of byte strings that stand earlier in the corpus, by suffix arrays.

1. Every window of `length` bytes names an anchor, the k-gram of smallest hash in it, so equal
   windows name equal anchors. Runs of windows with one anchor make a snippet, which travels
   as hashes (anchor, contents, both sides of the anchor), document and place. A task marks the
   snippets that it has seen in an earlier place itself, so an anchor that stands everywhere
   sends a row a task, not a row a document.
2. By anchor: snippets whose contents stand earlier are removed whole. Only those go on, one of each
   kind, that share the anchor and one of its sides with a snippet of other contents: a window is
   longer than the anchor by two sides, so equal windows hold one of them whole.
3. Those snippets' bytes are dealt out by anchor. A task sorts its suffixes shard by shard
   (Larsson-Sadakane refinement), finds the windows' common prefixes (Kasai), and looks the windows of an
   anchor that an earlier shard began up in that shard's sorted windows by binary search.
4. What is removed comes back to each document as ranges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from interlake.llm._spark import Documents, by_batch, checkpointed, free_shuffles
from interlake.llm._text import mix, prefix_hash, span_hash

GRAM = 24  # bytes of an anchor
SHARD = 1 << 20  # bytes of which one suffix array is made
STRETCH = 1 << 24  # hashes whose places fit beside them
HOT = 20_000  # snippets of one anchor that one task takes
GROUP = 1 << 18  # bytes of texts that are hashed together
SEEN = 18  # bits of the table of snippets that a task has seen
_U = np.uint64


def snippets(data: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(row, first window, number of windows, hash of the anchor, hash of the contents, hashes of the sides) of every snippet.

    A side is the (length - anchor) / 2 bytes before or behind the anchor, with the anchor; 0 if no window of the
    snippet holds it. 16 bits of each make one number: they only tell apart what has one anchor.
    """
    sizes = np.array([len(d) for d in data], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    joined = b"".join(data)
    text = np.frombuffer(joined, np.uint8)
    n, gram = len(text), min(GRAM, length)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    prefix = prefix_hash(text)
    at = np.arange(n - gram + 1)
    grams = span_hash(prefix, at, at + gram)
    wide = length - gram + 1
    # A place has 24 bits, so a longer text is gone through in stretches that overlap by a window.
    place = np.concatenate([a + _first_smallest(grams[a : a + STRETCH], wide) for a in range(0, len(grams) - wide + 1, STRETCH - wide + 1)])
    row = np.repeat(np.arange(len(data)), sizes)[: len(place)]
    inside = np.arange(len(place)) + length <= offsets[row + 1]
    fresh = np.ones(len(place), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(fresh & inside)
    stop = np.flatnonzero(np.concatenate([(fresh | ~inside)[1:], [True]]) & inside) + 1
    anchor, end, side = place[start], stop + length - 1, (length - gram) // 2
    before, behind = anchor - start >= side, end - anchor - gram >= side
    sides = np.where(before, _part(span_hash(prefix, np.where(before, anchor - side, anchor), anchor + gram)), _U(0)) << _U(16)
    sides |= np.where(behind, _part(span_hash(prefix, anchor, np.where(behind, anchor + gram + side, anchor + gram))), _U(0))
    digest = xxhash.xxh3_64_intdigest
    contents = np.fromiter((digest(joined[i:j]) for i, j in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(start))
    return row[start], start - offsets[row[start]], stop - start, grams[anchor], contents, sides


def anchors(data: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """snippets() without the sides."""
    return snippets(data, length)[:5]


def _part(h: np.ndarray) -> np.ndarray:
    """16 bits of each hash, never 0."""
    return np.maximum(h >> _U(48), _U(1))


class Seen:
    """Snippets that a task has gone through, as many as the table holds: tells those that stand in an earlier place, with misses but no errors."""

    def __init__(self, bits: int):
        self.mask = _U((1 << bits) - 1)
        self.h, self.same = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.doc, self.lo = np.full(1 << bits, np.iinfo(np.int64).max), np.zeros(1 << bits, np.int64)

    def later(self, h: np.ndarray, same: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """True where a snippet of equal hashes, of these or of earlier calls, has a smaller (doc, lo)."""
        out = np.zeros(len(h), bool)
        by = np.lexsort((lo, doc, same, h))
        new = np.ones(len(by), bool)
        new[1:] = (h[by[1:]] != h[by[:-1]]) | (same[by[1:]] != same[by[:-1]])
        head = by[np.flatnonzero(new)][np.cumsum(new) - 1]  # of each the first of its kind
        out[by] = (doc[by] != doc[head]) | (lo[by] != lo[head])
        first = by[new]
        slot = (h[first] & self.mask).astype(np.int64)
        known = (self.h[slot] == h[first]) & (self.same[slot] == same[first])
        after = known & ((self.doc[slot] < doc[first]) | ((self.doc[slot] == doc[first]) & (self.lo[slot] < lo[first])))
        out[first[after]] = True
        put, slot = first[~after], slot[~after]
        self.h[slot], self.same[slot], self.doc[slot], self.lo[slot] = h[put], same[put], doc[put], lo[put]
        return out


def _first_smallest(grams: np.ndarray, wide: int) -> np.ndarray:
    """Place of the smallest of every `wide` hashes in a row, by their upper 40 bits; of equal ones the first."""
    low = _U((1 << 24) - 1)
    best = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    have = 1
    while have * 2 <= wide:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    if have < wide:
        best = np.minimum(best[: len(best) - (wide - have)], best[wide - have :])
    return (best & low).astype(np.int64)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in their order.

    Larsson-Sadakane: suffixes are sorted by their first 8 bytes; then only groups that
    are still equal are refined, by the group of the suffix h bytes on, and h doubles.
    """
    n = len(text)
    key = _eights(text, 0)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    # A suffix of under 8 bytes is told from one that goes on with zero bytes by its end, which sorts below them.
    group = np.zeros(n + 1, np.int64)  # of each suffix the place of the last of its group; after the end -1
    group[n] = -1
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if n else np.zeros(0, bool)
    short = np.flatnonzero(order > n - 8)
    for i in short[np.argsort(-order[short])].tolist():  # of equal keys the shorter suffix first
        a = np.searchsorted(ordered, ordered[i], "left")
        b = np.searchsorted(ordered, ordered[i], "right")
        own = order[a:b]
        own = np.concatenate([np.sort(own[own > n - 8])[::-1], own[own <= n - 8]])
        order[a:b] = own
        fresh[a : a + np.count_nonzero(own > n - 8) + 1][: b - a] = True
    _regroup(order, fresh, np.arange(n), group)
    open_places = np.flatnonzero(group[order] != np.arange(n))  # all places of open groups but the last of each
    h = 8
    while len(open_places):
        is_open = np.zeros(n, bool)
        is_open[open_places] = True
        is_open[group[order[open_places]]] = True
        places = np.flatnonzero(is_open)
        suffixes = order[places]
        both = group[suffixes] * (n + 1) + group[np.minimum(suffixes + h, n)] + 1
        by = np.argsort(both)
        both, suffixes = both[by], suffixes[by]
        order[places] = suffixes
        new = np.ones(len(by), bool)
        new[1:] = both[1:] != both[:-1]
        _regroup(suffixes, new, places, group)
        open_places = places[group[suffixes] != places]
        h *= 2
    return order


def _eights(text: np.ndarray, fill: int) -> np.ndarray:
    """The 8 bytes from each place on as one number in the bytes' order; behind the end `fill`."""
    padded = np.concatenate([text, np.full(8, fill, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(text)]).view(">u8").ravel().astype(np.uint64)


def _regroup(suffixes: np.ndarray, new: np.ndarray, places: np.ndarray, group: np.ndarray) -> None:
    """Give each suffix the last place of its group; new: where a group begins."""
    begin = np.flatnonzero(new)
    last = np.append(begin[1:] - 1, len(new) - 1)
    group[suffixes] = np.repeat(places[last], np.diff(np.append(begin, len(new))))


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, `most` at most, of each window with the window before it in the order; -1 for what is no window.

    Windows are starts[i] + 0 .. counts[i] - 1; order holds the suffixes that are windows, in their order. Kasai: the common
    prefix of the next suffix is shorter by one at most, if the suffix behind its neighbour is a window, too. All runs go side by side.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    window = np.zeros(n + 1, bool)
    window[order] = True
    eights = _eights(text, 0)
    out = np.full(n, -1, np.int64)
    have, last = np.zeros(len(starts), np.int64), np.full(len(starts), n - 1, np.int64)
    for step in range(int(counts.max(initial=0))):
        live = np.flatnonzero(counts > step)
        i = starts[live] + step
        j = before[i]
        size = np.where((j >= 0) & window[last[live] + 1], np.maximum(have[live] - 1, 0), 0)
        going = np.flatnonzero((j >= 0) & (size < most))
        while len(going):  # eight bytes at a time, as long as both texts have them
            a, b = i[going] + size[going], j[going] + size[going]
            there = np.maximum(a, b) <= n - 8
            going, a, b = going[there], a[there], b[there]
            going = going[eights[a] == eights[b]]
            size[going] += 8
            going = going[size[going] < most]
        going = np.flatnonzero((j >= 0) & (size < most))
        while len(going):
            a, b = i[going] + size[going], j[going] + size[going]
            same = (a < n) & (b < n)
            same[same] = text[a[same]] == text[b[same]]
            going = going[same]
            size[going] += 1
            going = going[size[going] < most]
        size = np.minimum(size, most)
        out[i] = have[live] = size
        last[live] = np.where(j >= 0, j, n - 1)
    return out


class _Earlier:
    """Sorted windows of an anchor that earlier shards have gone through."""

    def __init__(self, length: int):
        self.key, self.windows = None, np.empty(0, f"S{length + 1}")

    def known(self, key, windows: np.ndarray) -> np.ndarray:
        if key != self.key or not len(self.windows):
            return np.zeros(len(windows), bool)
        at = np.minimum(np.searchsorted(self.windows, windows), len(self.windows) - 1)
        return self.windows[at] == windows

    def add(self, key, windows: np.ndarray) -> None:
        self.windows = np.unique(np.concatenate([self.windows, windows]) if key == self.key else windows)
        self.key = key


def _repeats(rows: list[tuple], length: int, earlier: _Earlier, cut_key) -> list[tuple[int, int, int]]:
    """(doc, first window, number) of the windows of a shard that stand earlier, here or in `earlier`.

    rows: (key, doc, first window, number of windows, bytes), sorted. cut_key: the key that goes on in the next shard, if any.
    """
    data = [r[4] for r in rows]
    sizes, counts = np.array([len(d) for d in data]), np.array([r[3] for r in rows])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    text = np.frombuffer(b"".join(data), np.uint8)
    owner = np.repeat(np.arange(len(rows)), sizes)
    within = np.arange(len(text)) - starts[owner]
    window = within < counts[owner]
    at_text = suffix_array(text)
    at_text = at_text[window[at_text]]
    group = np.cumsum(common_prefixes(text, at_text, starts, counts, length)[at_text] < length)
    docs, firsts = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
    place = firsts[owner[at_text]] + within[at_text]
    by = np.lexsort((place, docs[owner[at_text]], group))
    new = np.ones(len(by), bool)
    new[1:] = group[by][1:] != group[by][:-1]
    # Equal places (repeated rows) are one occurrence.
    d, p, g = docs[owner[at_text]][by], place[by], np.cumsum(new) - 1
    head = np.flatnonzero(new)[g]
    gone = np.zeros(len(text), bool)
    gone[at_text[by]] = (d != d[head]) | (p != p[head])
    for key in dict.fromkeys(k for k in (earlier.key, cut_key) if k is not None):  # first the one that earlier shards began
        own = [i for i, r in enumerate(rows) if r[0] == key]
        if own:
            spots = np.concatenate([starts[i] + np.arange(counts[i]) for i in own])
            plain = _as_strings(np.lib.stride_tricks.sliding_window_view(text, length)[spots])
            gone[spots[earlier.known(key, plain)]] = True
            if key == cut_key:
                earlier.add(key, plain)
    out = []
    edge = np.diff(np.concatenate([[0], (gone & window).astype(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        while a < b:  # a run may go over several snippets
            i = owner[a]
            stop = min(b, int(starts[i] + sizes[i]))
            out.append((int(docs[i]), int(firsts[i] + a - starts[i]), stop - a))
            a = stop
    return out


def _as_strings(windows: np.ndarray) -> np.ndarray:
    """Rows of bytes as sortable strings; a 1 after each keeps zero bytes at its end."""
    wide = np.ones((len(windows), windows.shape[1] + 1), np.uint8)
    wide[:, :-1] = windows
    return wide.view(f"S{wide.shape[1]}").ravel()


def _text_bytes(value: str | None) -> bytes:
    return (value or "").encode("utf-8", "surrogatepass")


def repeated_ranges(docs: DataFrame, *, length: int = 100) -> DataFrame:
    """(doc_id, lo, nw): windows lo .. lo + nw - 1 of a document that stand earlier in the corpus. docs: (doc_id long, text)."""
    names = ("h", "same", "sides", "doc_id", "lo", "nw")
    arrow = pa.schema([*((c, pa.int32() if c in ("sides", "lo", "nw") else pa.int64()) for c in names), ("later", pa.bool_())])

    def scan(batches):
        seen = Seen(SEEN)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_pylist()
            held, first, size = [], 0, 0
            for i, value in enumerate(texts):
                held.append(_text_bytes(value))
                size += len(held[-1])
                if size > GROUP or i == len(texts) - 1:
                    row, lo, nw, h, same, sides = snippets(held, length)
                    if len(row):
                        doc = ids[first + row]
                        later = seen.later(h, same, doc, lo)
                        h = np.where(later, mix(h ^ mix(doc.astype(np.uint64) + mix(lo.astype(np.uint64)))), h)  # these need no company, only a place
                        columns = (h.view(np.int64), same.view(np.int64), sides.astype(np.uint32).view(np.int32), doc, lo, nw, later)
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)
                    held, first, size = [], i + 1, 0

    found = docs.mapInArrow(scan, "h long, same long, sides int, doc_id long, lo int, nw int, later boolean").repartition("h")
    by_anchor = Window.partitionBy("h")
    found = found.withColumn("n", F.count(F.lit(1)).over(by_anchor)).filter("n > 1 or later").drop("n")
    kinds = Window.partitionBy("h", "same")
    where = F.struct("doc_id", "lo")
    found = found.withColumn("first", F.min(where).over(kinds)).withColumn("kinds", F.min("same").over(by_anchor) != F.max("same").over(by_anchor))
    found = checkpointed(found.withColumn("later", F.col("later") | (where > F.col("first"))).filter("later or kinds").select("h", "same", "sides", "doc_id", "lo", "nw", "later"))
    free_shuffles(docs.sparkSession)  # of a row for each snippet
    copies = found.filter("later").select("doc_id", "lo", "nw")

    some = found.filter("not later").drop("later").distinct()
    own = F.xxhash64("doc_id", "lo")  # what has no side meets nothing there
    for side, value in (("before", F.shiftrightunsigned("sides", 16)), ("behind", F.col("sides").bitwiseAND(F.lit(0xFFFF)))):
        some = some.withColumn(side, F.when(value != 0, value.cast("long")).otherwise(own))
        alike = Window.partitionBy("h", side)
        some = some.withColumn(f"met_{side}", F.min("same").over(alike) != F.max("same").over(alike))
    some = checkpointed(some.filter("met_before or met_behind").select("h", "doc_id", "lo", "nw"))
    hot = some.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("subs")).filter("subs > 1")
    wanted = some.join(hot, "h", "left").groupBy("doc_id").agg(F.collect_list(F.struct("h", "lo", "nw", F.coalesce("subs", F.lit(1)).alias("subs"))).alias("cuts"))
    snippet = pa.schema([("h", pa.int64()), ("sub", pa.int32()), ("doc_id", pa.int64()), ("lo", pa.int32()), ("nw", pa.int32()), ("data", pa.binary())])

    def take(batches):
        for batch in batches:
            rows = []
            for doc, value, cuts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = _text_bytes(value)
                for c in cuts:
                    lo, nw = c["lo"], c["nw"]
                    if c["subs"] == 1:
                        rows.append((c["h"], 0, doc, lo, nw, data[lo : lo + nw + length - 1]))
                        continue
                    # Windows of a hot anchor are dealt out by their ends; equal ones stay together.
                    raw = np.frombuffer(data, np.uint8)
                    head = np.array([int.from_bytes(data[i : i + 8], "little") for i in range(lo, lo + nw)], np.uint64)
                    back = np.array([int.from_bytes(data[i + length - 8 : i + length], "little") for i in range(lo, lo + nw)], np.uint64)
                    subs = (mix(head ^ mix(back)) % _U(c["subs"])).astype(int)
                    edges = [0, *(np.flatnonzero(np.diff(subs)) + 1).tolist(), nw]
                    for a, b in zip(edges[:-1], edges[1:], strict=True):
                        rows.append((c["h"], int(subs[a]), doc, lo + a, b - a, raw[lo + a : lo + b + length - 1].tobytes()))
            for first in range(0, len(rows), 20_000):
                part = rows[first : first + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), type=f.type) for x, f in zip(zip(*part, strict=True), snippet, strict=True)], schema=snippet)

    pieces = docs.join(wanted, "doc_id").select("doc_id", "text", "cuts").mapInArrow(take, "h long, sub int, doc_id long, lo int, nw int, data binary")
    removed = pa.schema([("doc_id", pa.int64()), ("lo", pa.int32()), ("nw", pa.int32())])

    def sort(batches):
        earlier = _Earlier(length)
        held, size = [], 0

        def shard(next_key):
            cut_key = held[-1][0] if held[-1][0] == next_key else None
            out = _repeats(held, length, earlier, cut_key)
            if out:
                return pa.RecordBatch.from_arrays([pa.array(list(x), type=f.type) for x, f in zip(zip(*out, strict=True), removed, strict=True)], schema=removed)
            return None

        for batch in batches:
            h, sub, doc, lo, nw, data = (batch.column(i).to_pylist() for i in range(6))
            for row in zip(zip(h, sub, strict=True), doc, lo, nw, data, strict=True):
                if size > SHARD:
                    got = shard(row[0])
                    held, size = [], 0
                    if got is not None:
                        yield got
                held.append(row)
                size += len(row[4])
        if held:
            got = shard(None)
            if got is not None:
                yield got

    dealt = pieces.repartition("h", "sub").sortWithinPartitions("h", "sub", "doc_id", "lo")
    return copies.union(dealt.mapInArrow(sort, "doc_id long, lo int, nw int"))


def drop_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of every row.

    Removed is each byte under a string of `length` bytes that also starts earlier: in a document of
    smaller doc_id, or before in the same one. Strings are judged on the input. Null texts are
    empty. doc_id may be of any type that sorts; null counts as the smallest and comes back as null. Rows with equal doc_id and text are
    one document; of rows with equal doc_id (or none) and other texts, that of the smaller hash of its text counts as earlier. What is
    kept may end within a character, so it is binary.
    """
    found = Documents(docs, doc_id, text, nulls_first=True)
    base = found.rows.select(F.col("doc").alias("doc_id"), "text")  # as the snippets' texts are dealt out: one exchange serves both
    ranges = repeated_ranges(base, length=length).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "nw")).alias("cuts"))
    both = base.join(ranges, "doc_id", "left").select("doc_id", "text", "cuts")
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def cut(batch):
        sizes, removed, spans, kept = [], [], [], []
        for value, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = _text_bytes(value)
            sizes.append(len(data))
            if not cuts:
                removed.append(0)
                spans.append(0)
                kept.append(data)
                continue
            edge = np.zeros(len(data) + 1, np.int32)
            lo = np.array([c["lo"] for c in cuts])
            np.add.at(edge, lo, 1)
            np.add.at(edge, lo + np.array([c["nw"] for c in cuts]) + length - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed.append(int(gone.sum()))
            spans.append(int(gone[:1].sum() + np.count_nonzero(gone[1:] & ~gone[:-1])))
            kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
        return {"doc_id": batch.column(0), "n_bytes": sizes, "n_removed": removed, "n_spans": spans, "kept": kept}

    rows = both.mapInArrow(by_batch(cut, arrow), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return found.named(rows, "doc_id").select(F.col("doc_id").cast(docs.schema[doc_id].dataType).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")

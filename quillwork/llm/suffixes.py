"""Repeated byte strings across documents, by suffix arrays of linear grouping construction.

Which 100-byte strings occur twice is a question about all documents at once, so
the suffixes are dealt out first. Every 100-byte window is filed under its anchor,
the leftmost smallest hash of a 32-byte string in it; equal windows have equal
anchors. Windows next to each other with one anchor form a stretch. A stretch whose
anchor occurs once repeats nothing. Equal stretches are counted in one aggregate: all
but the first are removed whole. What is left are anchors with several different
stretches; the stretches of such an anchor make one small text, whose suffix array
tells which of their windows are equal.

The suffix arrays of many such texts are built side by side. Construction is by
grouping: suffixes start in groups by their first symbol; the groups are processed
in descending order, and each splits the groups that hold the previous smaller
suffixes of its members, until every group holds the suffixes with one Lyndon prefix.
A second sweep, upwards, puts the members of each group in order by following the
same pointers. Nothing is renamed and nothing recurses.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm.hashing import _EXACT, _POWERS, mix, signed, text_buffers, text_chunks
from quillwork.session import materialise

LENGTH = 100  # bytes that have to repeat
GRAM = 32  # bytes of an anchor
LANE = 2_048  # different stretches of an anchor that share a suffix array; more are dealt out by window
LANE_BYTES = 1_000_000  # text of suffix arrays that are built side by side
PIECE_BYTES = 1_000_000  # stretches that a task hands on at once
LOOK_BYTES = 250_000  # bytes of stretches whose surroundings of anchors are compared together
AROUND = 9  # places of the anchor in a window that are looked at together, before suffixes are ordered


def lyndon_groups(text: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group start of every suffix, previous smaller suffix of every suffix) after the downward sweep.

    `text` holds the texts of all lanes one after the other, `lanes` where each starts,
    with the total at the end. A lane ends in a symbol that is its only smallest.
    Groups are named by their first place in the lane's order; places are counted
    over all lanes, so whatever belongs to an earlier lane counts as smaller.
    """
    n = text.size
    lane_of = np.repeat(np.arange(lanes.size - 1), np.diff(lanes))
    order = np.lexsort((text, lane_of))
    first = np.ones(n, bool)
    first[1:] = (text[order][1:] != text[order][:-1]) | (lane_of[order][1:] != lane_of[order][:-1])
    starts = np.flatnonzero(first)
    place = np.empty(n, np.int64)  # of each suffix
    place[order] = np.arange(n)
    group = np.empty(n, np.int64)
    group[order] = np.repeat(starts, np.diff(np.r_[starts, n]))
    size = np.zeros(n, np.int64)
    size[starts] = np.diff(np.r_[starts, n])
    before = np.full(n, -1, np.int64)
    moves = np.zeros(n, bool)
    low, end = lanes[:-1].copy(), lanes[1:] - 1  # end: last place of the group to process
    while low.size:
        begin = group[order[end]]
        spans = end - begin + 1
        shift = np.cumsum(spans) - spans
        places = np.arange(spans.sum()) + np.repeat(begin - shift, spans)
        members = order[places]
        own, floor = np.repeat(begin, spans), np.repeat(low, spans)
        # previous smaller suffix: hop over those in this group and in higher ones
        before[members] = members - 1
        hop = np.arange(members.size)
        while hop.size:
            at = before[members[hop]]
            inside = at >= floor[hop]
            hop, at = hop[inside], at[inside]
            higher = group[at] >= own[hop]
            hop, at = hop[higher], at[higher]
            before[members[hop]] = before[at]
        smaller = before[members]
        smaller = smaller[smaller >= floor]
        if smaller.size:
            # how often each was named; it goes above the rest of its group, the more the higher
            named, times = np.unique(smaller, return_counts=True)
            old = group[named]
            by = np.lexsort((times, old))
            named, times, old = named[by], times[by], old[by]
            head = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
            count = np.diff(np.r_[head, old.size])
            stop = old[head] + size[old[head]]
            target = np.arange(old.size) + np.repeat(stop - count - head, count)
            # those in the way change places with those that move up
            moves[named] = True
            evicted = order[target]
            evicted = evicted[~moves[evicted]]
            in_tail = place[named] >= np.repeat(stop - count, count)
            vacant = place[named[~in_tail]]
            moves[named] = False
            # both lists run through the same groups in the same order
            order[vacant] = evicted
            place[evicted] = vacant
            order[target] = named
            place[named] = target
            fresh = np.flatnonzero(np.r_[True, (old[1:] != old[:-1]) | (times[1:] != times[:-1])])
            sizes = np.diff(np.r_[fresh, old.size])
            size[old[head]] -= count
            group[named] = np.repeat(target[fresh], sizes)
            size[target[fresh]] = sizes
        end = begin - 1
        live = end >= low
        low, end = low[live], end[live]
    return group, before


def order_groups(group: np.ndarray, before: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    """Suffix arrays of all lanes, one after the other, by the upward sweep."""
    n = group.size
    out = np.full(n, -1, np.int64)
    placed = np.zeros(n, bool)
    fill = np.arange(n)  # next free place of the group that starts there
    low, high = lanes[:-1].copy(), lanes[1:]
    last = high - 1
    out[low] = last
    placed[last] = True
    fill[low] += 1
    read, now = low.copy(), last - 1
    while low.size:
        waiting = now >= low
        waiting[waiting] = ~placed[now[waiting]]
        put = now[waiting]
        spot = fill[group[put]]
        out[spot] = put
        placed[put] = True
        fill[group[put]] = spot + 1
        now[waiting] = before[put]
        idle = ~waiting
        read[idle] += 1
        live = read < high
        if not live.all():
            low, high, read, now, idle = low[live], high[live], read[live], now[live], idle[live]
        now[idle] = out[read[idle]] - 1
    return out


def suffix_arrays(text: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    """Suffix arrays of the lanes of `text`, as positions in `text`. Each lane ends in its only smallest symbol."""
    return order_groups(*lyndon_groups(text, lanes), lanes)


def anchors_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor hash, stretch hash) of every stretch of windows with one anchor."""
    size = data.size
    none = np.empty(0, np.int64)
    if size < LENGTH:
        return none, none, none, np.empty(0, np.uint64), np.empty(0, np.uint64)
    up, down = _POWERS.upto(size + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_EXACT[data] * up[:size])])
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: size - GRAM + 1])
        # leftmost smallest of LENGTH - GRAM + 1 neighbouring hashes, by doubling
        least, where, width = grams, np.arange(grams.size, dtype=np.int32), 1
        wanted = LENGTH - GRAM + 1
        while width < wanted:
            step = min(width, wanted - width)
            right = least[step:] < least[:-step]
            where = np.where(right, where[step:], where[:-step])
            least = np.where(right, least[step:], least[:-step])
            width += step
        owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
        windows = np.flatnonzero(owner[: size - LENGTH + 1] == owner[LENGTH - 1 :])
        if not windows.size:
            return none, none, none, np.empty(0, np.uint64), np.empty(0, np.uint64)
        at = where[windows].astype(np.int64)
        cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[windows[1:]] != owner[windows[:-1]])])
        low, count, at = windows[cut], np.diff(np.r_[cut, windows.size]), at[cut]
        whole = (sums[low + count + LENGTH - 1] - sums[low]) * down[low]
        shape = (at - low).astype(np.uint64) * np.uint64(1 << 20) + count.astype(np.uint64)
        text = owner[low].astype(np.int64)
        return text, low - offsets[text], count, grams[at], mix(whole ^ mix(shape))


def stretches(df: DataFrame, with_hash: bool) -> DataFrame:
    """(id, low, n, anchor[, stretch]) of the texts of (id, text)."""
    names = ["id", "low", "n", "anchor", *["stretch"] * with_hash]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_chunks(batch.column(1)):
                text, low, count, anchor, stretch = anchors_of(data, offsets)
                columns = [
                    batch.column(0).slice(row, end - row).take(pa.array(text)),
                    pa.array(low.astype(np.int32)),
                    pa.array(count.astype(np.int32)),
                    pa.array(signed(anchor)),
                    pa.array(signed(stretch)),
                ]
                yield pa.RecordBatch.from_arrays(columns[: len(names)], names=names)

    return df.mapInArrow(run, "id long, low int, n int, anchor long" + ", stretch long" * with_hash)


def packed(df: DataFrame) -> DataFrame:
    """(id, body): the bytes of each text, compressed, as they are moved twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            bodies = [pack.compress(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], names=["id", "body"])

    return df.mapInArrow(run, "id long, body binary")


def cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, id, low, n, bytes) from (id, body, wanted), about `PIECE_BYTES` at a time, whatever comes in at once."""
    unpack = zstandard.ZstdDecompressor()

    def out(keys: list[int], at: list[int], pieces: list[bytes]) -> pa.RecordBatch:
        columns = [pa.array(anchor[at]), pa.array(keys, pa.int64()), pa.array(low[at]), pa.array(n[at])]
        return pa.RecordBatch.from_arrays([*columns, pa.array(pieces, pa.binary())], names=["anchor", "id", "low", "n", "bytes"])

    for batch in batches:
        wanted = batch.column(2)
        first = np.cumsum([0, *wanted.value_lengths().to_pylist()])
        anchor, low, n = (np.asarray(c) for c in wanted.flatten().flatten())
        keys, at, pieces, size = [], [], [], 0
        for i, key in enumerate(batch.column(0).to_pylist()):
            body = batch.column(1)[i].as_py()
            raw = unpack.decompress(body) if body else b""
            for j in range(first[i], first[i + 1]):
                piece = raw[low[j] : low[j] + n[j] + LENGTH - 1]
                if len(piece) == n[j] + LENGTH - 1:
                    keys.append(key)
                    at.append(j)
                    pieces.append(piece)
                    size += len(piece)
                if size >= PIECE_BYTES:
                    yield out(keys, at, pieces)
                    keys, at, pieces, size = [], [], [], 0
        if at:
            yield out(keys, at, pieces)


def _bodies(df: DataFrame) -> DataFrame:
    """(anchor, id, low, n, bytes) from (id, body, wanted), `wanted` a list of (anchor, low, n)."""
    return df.mapInArrow(cut_pieces, "anchor long, id long, low int, n int, bytes binary")


def repeats_in_lanes(groups: list[list[tuple[int, int, int, bytes]]]) -> list[tuple[int, int, int]]:
    """Removed spans (id, from, to) from groups of different stretches (id, low, n, bytes).

    The windows of a group are ordered by its suffix array; equal neighbours are the
    same window, and all but the one that starts first are removed.
    """
    parts, marks, lanes, at = [], [], [0], 0
    for group in groups:
        for key, low, n, body in group:
            marks.append((key, low, n, at))
            parts.append(np.frombuffer(body, np.uint8).astype(np.int16) + 2)
            parts.append(np.ones(1, np.int16))
            at += len(body) + 1
        parts[-1] = np.zeros(1, np.int16)
        lanes.append(at)
    text = np.concatenate(parts)
    key, low, n, start = (np.array(c, np.int64) for c in zip(*marks, strict=True))
    order = suffix_arrays(text, np.array(lanes))
    stretch = np.repeat(np.arange(start.size), np.diff(np.r_[start, text.size]))
    lane = np.repeat(np.arange(len(lanes) - 1), np.diff(lanes))
    own = stretch[order]
    offset = order - start[own]
    window = offset < n[own]  # suffixes with LENGTH bytes in their stretch that the anchor files here
    order, own, offset = order[window], own[window], offset[window]
    same = np.zeros(order.size, bool)
    view = np.lib.stride_tricks.sliding_window_view(text, LENGTH)
    for i in range(1, order.size, 50_000):
        a, b = order[i - 1 : i + 49_999], order[i : i + 50_000]
        a = a[: b.size]
        same[i : i + b.size] = (lane[a] == lane[b]) & (view[a] == view[b]).all(axis=1)
    head = np.flatnonzero(~same)
    rank = np.unique(key, return_inverse=True)[1]
    begins = rank[own] * np.int64(1 << 40) + low[own] + offset
    least = np.repeat(np.minimum.reduceat(begins, head), np.diff(np.r_[head, order.size]))
    gone = begins != least
    own, offset = own[gone], offset[gone]
    by = np.lexsort((offset, own))
    own, offset = own[by], offset[by]
    if not own.size:
        return []
    cut = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (offset[1:] != offset[:-1] + 1)])
    stop = np.r_[cut[1:], own.size] - 1
    begin = low[own[cut]] + offset[cut]
    end = low[own[stop]] + offset[stop] + LENGTH
    return list(zip(key[own[cut]].tolist(), begin.tolist(), end.tolist(), strict=True))


def may_repeat(
    data: np.ndarray, ends: np.ndarray, lane: np.ndarray, anchor: np.ndarray, n: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, first window, windows) of the part of each stretch that another one of its lane may have, too.

    `data` holds the bytes of all stretches one after the other, `ends` where each stops.
    Equal windows have their anchor at the same place, so windows that hold it between
    a and b bytes from their start are equal only if what is around the anchor in all
    of them is. Stretches that have nothing of that in common with another have no repeat.
    """
    size = data.size
    starts = np.r_[0, ends[:-1]]
    up, down = _POWERS.upto(size + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_EXACT[data] * up[:size])])
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: size - GRAM + 1])
        owner = np.repeat(np.arange(ends.size), ends - starts)
        place = np.flatnonzero(grams == anchor[owner[: grams.size]])
        # the leftmost that ends inside
        place = place[place + GRAM <= ends[owner[place]]]
        own, at = np.unique(owner[place], return_index=True)
        at = place[at]
        most = at - starts[own]  # bytes before the anchor in the first window, and in the last
        least = most - n[own] + 1
        a = np.arange(0, LENGTH - GRAM + 1, AROUND)
        b = np.minimum(a + AROUND, LENGTH - GRAM + 1) - 1
        row, k = np.nonzero((a <= most[:, None]) & (b >= least[:, None]))
        low, high = at[row] - a[k], at[row] + LENGTH - b[k]
        around = (sums[high] - sums[low]) * down[low]
        key = mix(around ^ mix(lane[own[row]].astype(np.uint64) * np.uint64(a.size) + k.astype(np.uint64)))
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    shared = times[back] > 1
    row, k = row[shared], k[shared]
    head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: row.size])
    last = np.r_[head[1:], row.size][: head.size] - 1
    row, most, least = row[head], np.minimum(most[row[head]], b[k[last]]), np.maximum(least[row[head]], a[k[head]])
    return own[row], at[row] - most - starts[own[row]], most - least + 1


def _lane_spans(df: DataFrame) -> DataFrame:
    """(id, low, high) from (anchor, rows), `rows` a bounded list of different stretches."""

    def flush(groups):
        # texts of like length are built side by side
        spans = repeats_in_lanes(sorted(groups, key=lambda g: sum(len(r[3]) for r in g)))
        kinds = (pa.int64(), pa.int32(), pa.int32())
        columns = zip(*spans, strict=True) if spans else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            anchors = np.asarray(batch.column(0)).view(np.uint64)
            count = np.asarray(batch.column(1).value_lengths())
            key, low, n, body = batch.column(1).flatten().flatten()
            key, low, n = np.asarray(key), np.asarray(low), np.asarray(n)
            body = body.cast(pa.large_binary())
            _, ends, data = body.buffers()
            ends, data = np.frombuffer(ends, np.int64)[body.offset : body.offset + len(body) + 1], np.frombuffer(data, np.uint8)
            lane = np.repeat(np.arange(count.size), count)
            first = np.r_[0, np.cumsum(count)]  # of the stretches of a lane
            at = 0
            while at < count.size:
                stop = int(np.searchsorted(ends[first], ends[first[at]] + LOOK_BYTES, side="right")) - 1
                stop = min(max(stop, at + 1), count.size)
                a, b = first[at], first[stop]
                own = slice(a, b)
                raw = data[ends[a] : ends[b]]
                found = may_repeat(raw, ends[a + 1 : b + 1] - ends[a], lane[own], anchors[lane[own]], n[own])
                before = -1
                for i, skip, windows in zip((found[0] + a).tolist(), *(c.tolist() for c in found[1:]), strict=True):
                    if lane[i] != before:
                        if size >= LANE_BYTES:
                            yield flush(held)
                            held, size = [], 0
                        held.append([])
                        before = lane[i]
                    begin = ends[i] + skip
                    piece = data[begin : begin + windows + LENGTH - 1].tobytes()
                    held[-1].append((int(key[i]), int(low[i]) + skip, windows, piece))
                    size += len(piece)
                at = stop
        if held:
            yield flush(held)

    return df.mapInArrow(run, "id long, low int, high int")


def _windows(df: DataFrame) -> DataFrame:
    """(id, start, one, two): every window of stretches, named by 128 bits of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[], [], [], []]
            for key, low, n, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for i in range(n):
                    name = hashlib.blake2b(body[i : i + LENGTH], digest_size=16).digest()
                    one, two = np.frombuffer(name, np.int64).tolist()
                    for out, value in zip(rows, (key, low + i, one, two), strict=True):
                        out.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], names=["id", "start", "one", "two"]
            )

    return df.select("id", "low", "n", "bytes").mapInArrow(run, "id long, start int, one long, two long")


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, low, high): byte spans whose 100-byte strings also start earlier; spans of one id may overlap.

    Earlier is a smaller key, or an earlier place in the same document. Rows that
    repeat a key are one document. A null text is empty; rows with a null key take no
    part. The key is a whole number.
    """
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.where("id is not null")
    twice = stretches(rows, False).groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor")
    found = materialise(stretches(rows, True).join(twice, "anchor", "left_semi"))
    first = materialise(
        found.groupBy("anchor", "stretch").agg(
            F.min(F.struct("id", "low", "n")).alias("first"),
            # a stretch that one document repeats in place has equal ends
            F.min(F.struct("id", "low")).alias("least"), F.max(F.struct("id", "low")).alias("most"),
        )
    )
    again = first.where("least <> most").select("anchor", "stretch", "least")
    copies = (
        found.join(again, ["anchor", "stretch"])
        .where(F.struct("id", "low") != F.col("least"))
        .select("id", "low", (F.col("low") + F.col("n") + (LENGTH - 1)).alias("high"))
    )
    several = first.groupBy("anchor").agg(F.count("*").alias("different")).where("different > 1")
    split = first.select("anchor", "first.*").join(several, "anchor")
    wanted = split.groupBy("id").agg(
        F.collect_list(F.struct("anchor", "low", "n")).alias("wanted")
    )  # as many as the document has stretches
    hot = F.col("different") > LANE
    bodies = materialise(
        _bodies(packed(rows).dropDuplicates(["id"]).join(wanted, "id")).join(several, "anchor").select("*", hot.alias("hot"))
    )
    lanes = bodies.where("not hot").groupBy("anchor").agg(
        F.collect_list(F.struct("id", "low", "n", "bytes")).alias("rows")
    )  # LANE rows at most
    ordered = _lane_spans(lanes.select("anchor", "rows"))
    windows = materialise(_windows(bodies.where("hot")))
    earliest = windows.groupBy("one", "two").agg(F.min(F.struct("id", "start")).alias("least"), F.count("*").alias("times"))
    dealt = windows.join(earliest.where("times > 1"), ["one", "two"]).where(F.struct("id", "start") != F.col("least"))
    dealt = dealt.select("id", F.col("start").alias("low"), (F.col("start") + LENGTH).alias("high"))
    return materialise(copies.union(ordered).union(dealt))


def cut_spans(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(what remains, bytes removed, maximal removed runs)."""
    parts, at, removed, runs, end = [], 0, 0, 0, -1
    for low, high in sorted(spans):
        low, high = min(low, len(raw)), min(high, len(raw))
        if low >= high:
            continue
        if low > end:
            runs += 1
            parts.append(raw[at:low])
            removed += high - low
            at = end = high
        elif high > end:
            removed += high - end
            at = end = high
    parts.append(raw[at:])
    return b"".join(parts), removed, runs


def _span_lists(df: DataFrame, key: str, text: str) -> DataFrame:
    """(__id, __spans): all spans of a document, as many as its text has room for."""
    lists = repeated_spans(df, key, text).groupBy("id").agg(F.collect_list(F.struct("low", "high")).alias("__spans"))
    return lists.withColumnRenamed("id", "__id")


def repeat_digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    The digest is of the remaining bytes, which may split a character. A null text
    is empty. A row with a null key keeps all its bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for body, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = unpack.decompress(body.as_py())
                kept, removed, runs = cut_spans(raw, [(s["low"], s["high"]) for s in spans or ()])
                rows.append((len(raw), removed, runs, hashlib.sha256(kept).hexdigest()))
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    lists = _span_lists(df, key, text)
    joined = packed(rows).join(lists, F.col("id") == F.col("__id"), "left").select("id", "body", "__spans")
    out = joined.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("id", key)


def drop_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`df` with repeated strings cut from its texts; what is left of a split character goes as well.

    A document of which nothing remains is left out, unless it was empty before. Rows
    with a null key, and null texts, stay as they are. Columns are as in `df`.
    """
    names = df.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for value, spans in zip(batch.column(at), batch.column(len(names)).to_pylist(), strict=True):
                value = value.as_py()
                if value and spans:
                    kept, *_ = cut_spans(value.encode(), [(s["low"], s["high"]) for s in spans])
                    value = kept.decode(errors="ignore")
                    keep.append(bool(value))
                else:
                    keep.append(True)
                texts.append(value)
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    lists = _span_lists(df, key, text)
    joined = df.join(lists, F.col(f"`{key}`").cast("long") == F.col("__id"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in names], "__spans").mapInArrow(run, df.schema)

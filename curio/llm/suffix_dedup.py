"""Removal of long repeated strings by a hash-compared suffix sort (operator 2).

A byte goes if a ``LENGTH``-byte string that covers it starts anywhere else as well, in the same
document or another.  All such strings are found, without a suffix array of the whole corpus:

1. *Anchors.*  Of the ``GRAM``-byte grams in each window of ``LENGTH`` bytes, the one of least hash (the
   leftmost of equals) is the window's anchor.  Equal windows have equal anchors at equal offsets, so
   only windows with one anchor hash need to meet.  Windows of one anchor are consecutive; together
   they are a *segment*, about one in 85 bytes, of which hashes and places are shuffled.
2. Segments that are equal as a whole are repeats without more ado.  Each task settles those among its
   own texts first and sends one of them on, and of an anchor that very many different segments have
   one witness; the others take path 4 at once.  So no line or passage gathers in one task.
3. *Suffix sort.*  Where segments of one anchor differ, their bytes are fetched (one segment of each kind)
   and the suffixes that begin their windows are sorted by a mergesort whose comparisons find the
   longest common extension by binary search over prefix polynomial hashes: eight probes a comparison,
   whole arrays of comparisons at a time.  Neighbours that agree in ``LENGTH`` bytes are verified byte by byte.
4. Anchors of more than ``CROWD`` different segments (a frequent line in many surroundings) are spread out:
   their windows meet by two independent hashes of all ``LENGTH`` bytes, 96 bits together.

Definedness: null texts are empty; texts shorter than ``LENGTH`` keep everything; rows that repeat an
id are documents of their own, and equal rows count as two; very long texts are cut like others, whole; of equal
windows none is preferred, all go; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curio.llm import common

LENGTH, GRAM, CROWD = 200, 32, 48
U64 = np.uint64
_VALUES, _SECOND = common.byte_values(2_003, fold_case=False), common.byte_values(2_017, fold_case=False)
ENTRY = np.dtype([("h", "<u8"), ("s", "<u8"), ("rid", "<u8"), ("lo", "<u4"), ("n", "<u2"), ("off", "<u2"), ("flag", "u1")])
SETTLED, CROWDED, WITNESS = 2, 3, 1


def anchors(prefix: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor's hash, place of the first window, number of windows, anchor's offset from it) of each segment of the rows."""
    total = len(prefix) - 1
    none = np.empty(0, np.int64)
    if total < LENGTH:
        return none, np.empty(0, U64), none, none, none
    start = np.arange(total - GRAM + 1)
    value = common.span_hash(prefix, start, start + GRAM)
    place = start.astype(np.int32)
    grams, width = LENGTH - GRAM + 1, 1
    least = value
    while 2 * width <= grams:
        right = least[width:] < least[:-width]
        place = np.where(right, place[width:], place[:-width])
        least = np.where(right, least[width:], least[:-width])
        width *= 2
    if gap := grams - width:
        right = least[gap:] < least[:-gap]
        place = np.where(right, place[gap:], place[:-gap])
    # windows that lie in one row
    room = np.maximum(np.diff(at) - LENGTH + 1, 0)
    window = common.ranges(at[:-1], room)
    row = np.repeat(np.arange(len(room)), room)
    anchor = place[window]
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(window)))
    lo, anchor = window[first], anchor[first].astype(np.int64)
    return row[first], value[anchor], lo, n, anchor - lo


def _groups(keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(order by the keys, the last one first; offsets of runs of equal keys)."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, np.append(np.flatnonzero(new), len(order))


def _local(e: np.ndarray) -> np.ndarray:
    """A task's entries after pre-aggregation: repeats settled but for one of each, crowds cut to a witness."""
    order, at = _groups((e["s"], e["h"]))
    e = e[order]
    first = at[:-1]
    size = np.diff(at)
    again = np.ones(len(e), bool)
    again[first] = False
    e["flag"][again] = SETTLED
    many = np.repeat(size > 1, size)
    kept = ~again
    # the one that is sent on is a repeat itself
    own = e[kept & many].copy()
    own["flag"] = SETTLED
    heads = np.flatnonzero(kept)
    h_at = common.runs(e["h"][heads])
    classes = np.repeat(np.diff(h_at), np.diff(h_at))
    lead = np.zeros(len(heads), bool)
    lead[h_at[:-1]] = True
    crowd = classes > CROWD
    e["flag"][heads[crowd & lead]] = WITNESS
    e["flag"][heads[crowd & ~lead]] = CROWDED
    return np.concatenate((e, own))


def candidates(docs: DataFrame, flush: int = 400_000) -> DataFrame:
    """(rid, kind, lo, n, off, h) for rows (rid, text): SETTLED segments, segments to fetch (0; 1 if settled too), and CROWDED ones."""
    buckets = common.shuffle_parts(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        waiting = 0

        def out() -> pa.RecordBatch:
            e = _local(np.concatenate(held))
            spread = np.where(e["flag"] >= SETTLED, e["rid"] + e["lo"].astype(U64), e["h"])
            bucket = common.bucket_of(common.mix(spread), buckets)
            order = np.argsort(bucket, kind="stable")
            e, bucket = e[order], bucket[order]
            to = common.by_bucket(bucket, buckets)
            some = np.flatnonzero(np.diff(to))
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([e[to[k] : to[k + 1]].tobytes() for k in some], pa.binary())], names=["bucket", "e"])

        for part, data, at in common.slices(batches):
            prefix = common.prefix_hash(data, _VALUES)
            row, h, lo, n, off = anchors(prefix, at)
            if not len(row):
                continue
            e = np.zeros(len(row), ENTRY)
            rid = np.asarray(part.column(part.schema.get_field_index("rid"))).view(U64)
            e["h"], e["rid"], e["lo"], e["n"], e["off"] = h, rid[row], lo - at[row], n, off
            e["s"] = common.mix(common.span_hash(prefix, lo, lo + n - 1 + LENGTH) + off.astype(U64))
            held.append(e)
            waiting += len(e)
            if waiting >= flush:
                yield out()
                held, waiting = [], 0
        if waiting:
            yield out()

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        e = np.concatenate([np.frombuffer(x, ENTRY) for x in rows["e"]])
        done = e[e["flag"] >= SETTLED]
        e = e[e["flag"] < SETTLED]
        order, at = _groups((e["lo"].astype(np.int64), e["rid"], e["s"], e["h"]))
        e = e[order]
        order, at = _groups((e["s"], e["h"]))
        e = e[order]
        size = np.diff(at)
        repeated = np.repeat(size > 1, size)
        settled = e[repeated].copy()
        settled["flag"] = SETTLED
        head = np.zeros(len(e), bool)
        head[at[:-1]] = True
        witness = np.logical_or.reduceat(e["flag"] == WITNESS, at[:-1]) if len(e) else np.zeros(0, bool)
        kinds, own = e[head].copy(), repeated[head]
        h_at = common.runs(kinds["h"])
        count = np.repeat(np.diff(h_at), np.diff(h_at))
        crowd = (np.repeat(np.logical_or.reduceat(witness, h_at[:-1]), np.diff(h_at)) if len(kinds) else count > 0) | (count > CROWD)
        kinds["flag"] = np.where(crowd, CROWDED, own)
        out = np.concatenate((done, settled, kinds[crowd | (count > 1)]))
        return pd.DataFrame({"rid": out["rid"].view(np.int64), "kind": out["flag"].astype(np.int32), "lo": out["lo"].astype(np.int64), "n": out["n"].astype(np.int32), "off": out["off"].astype(np.int32), "h": np.ascontiguousarray(out["h"]).view(np.int64)})

    return docs.select("rid", "text").mapInArrow(pieces, "bucket int, e binary").groupBy("bucket").applyInPandas(meet, "rid long, kind int, lo long, n int, off int, h long")


class Suffixes:
    """Comparisons of LENGTH-byte strings at places of a buffer, many at a time."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate((data, np.zeros(8, np.uint8)))
        self.prefix = common.prefix_hash(data, _VALUES)
        self.inverse = common.powers(len(self.prefix), common.BASE_INV)
        self.words = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))

    def _same(self, a: np.ndarray, b: np.ndarray, n) -> np.ndarray:
        p, v = self.prefix, self.inverse
        return (p[a + n] - p[a]) * v[a] == (p[b + n] - p[b]) * v[b]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix, LENGTH at most, by binary search over the hashes."""
        low = np.where(self._same(a, b, LENGTH), LENGTH, 0)
        i = np.flatnonzero(low == 0)
        a, b = a[i], b[i]
        lo, hi = np.zeros(len(i), np.int64), np.full(len(i), LENGTH - 1)
        while len(i) and (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = self._same(a, b, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        low[i] = lo
        return low

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: bool) -> np.ndarray:
        n = self.extension(a, b)
        full = n >= LENGTH
        return np.where(full, or_equal, self.data[a + np.where(full, 0, n)] < self.data[b + np.where(full, 0, n)])

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Byte by byte."""
        out = np.ones(len(a), bool)
        for k in range(0, LENGTH, 8):
            out &= self.words[a + k] == self.words[b + k]
        return out

    def sort(self, place: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the strings at ``place`` within their groups (ascending, together): a bottom-up mergesort of all groups at once."""
        n = len(place)
        order = np.arange(n)
        at = common.runs(group)
        begin, size = np.repeat(at[:-1], np.diff(at)), np.repeat(np.diff(at), np.diff(at))
        spot = np.arange(n) - begin
        width, largest = 1, int(np.diff(at).max()) if n else 0
        while width < largest:
            run = spot // width
            mate = run ^ 1
            lo = np.minimum(mate * width, size)
            hi = np.minimum(lo + width, size)
            live = np.flatnonzero(lo < hi)
            own = place[order]
            # how many of the mate run come first: all below, and equals of an earlier run
            left, right = (begin + lo)[live], (begin + hi)[live]
            equal = (mate < run)[live]
            base = left.copy()
            todo = np.arange(len(live))
            while len(todo):
                mid = (left[todo] + right[todo]) // 2
                x = own[live[todo]]
                y = own[mid]
                first = np.where(equal[todo], self.less(y, x, True), self.less(y, x, False))
                left[todo] = np.where(first, mid + 1, left[todo])
                right[todo] = np.where(first, right[todo], mid)
                todo = todo[left[todo] < right[todo]]
            rank = np.zeros(n, np.int64)
            rank[live] = left - base
            to = begin + np.minimum(run, mate) * width + spot % width + rank
            moved = np.empty_like(order)
            moved[to] = order
            order = moved
            width *= 2
        return order


def _repeats(data: np.ndarray, start: np.ndarray, n: np.ndarray, off: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each window of the segments, whether another segment with the same anchor hash has it; ``start``: where segments lie in data."""
    segment = np.repeat(np.arange(len(n)), n)
    step = common.ranges(np.zeros(len(n), np.int64), n)
    place, offset = start[segment] + step, off[segment] - step
    order, at = _groups((offset, h[segment]))
    out = np.zeros(len(place), bool)
    much = np.repeat(np.diff(at) > 1, np.diff(at))
    group = np.repeat(np.arange(len(at) - 1), np.diff(at))[much]
    item = order[much]
    if not len(item):
        return out
    s = Suffixes(data)
    item = item[s.sort(place[item], group)]
    near = np.flatnonzero(group[1:] == group[:-1])
    same = near[s.extension(place[item[near]], place[item[near + 1]]) >= LENGTH]
    same = same[s.equal(place[item[same]], place[item[same + 1]])]
    out[item[same]] = out[item[same + 1]] = True
    return out


def _runs_of(sorted_values: np.ndarray) -> Iterator[tuple[int, slice]]:
    at = common.runs(sorted_values)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield int(sorted_values[a]), slice(a, b)


def _as_ranges(rid: np.ndarray, first: np.ndarray) -> pd.DataFrame:
    """Windows (document, place) as maximal ranges of covered bytes."""
    if not len(rid):
        return pd.DataFrame({"rid": [], "a": [], "b": []}).astype("int64")
    order = np.lexsort((first, rid))
    rid, first = rid[order], first[order]
    new = np.ones(len(rid), bool)
    new[1:] = (rid[1:] != rid[:-1]) | (first[1:] > first[:-1] + LENGTH)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(rid)) - 1
    return pd.DataFrame({"rid": rid[head].view(np.int64), "a": first[head].astype(np.int64), "b": first[last].astype(np.int64) + LENGTH})


def settle(packed: DataFrame, requests: DataFrame, flush: int = 6_000_000) -> DataFrame:
    """(rid, a, b): ranges of repeats among the segments to fetch and the crowded ones."""
    buckets = common.shuffle_parts(packed.sparkSession)
    segment = np.dtype([("h", "<u8"), ("rid", "<u8"), ("lo", "<u4"), ("n", "<u2"), ("off", "<u2"), ("own", "u1")])
    window = np.dtype([("h", "<u8"), ("g", "<u4"), ("rid", "<u8"), ("lo", "<u4")])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        crowd: list[np.ndarray] = []
        waiting = 0

        def out() -> Iterator[pa.RecordBatch]:
            rows: list[tuple[int, int, bytes, bytes]] = []
            if held:
                e, data = (np.concatenate(x) for x in zip(*held, strict=True))
                size = e["n"].astype(np.int64) + LENGTH - 1
                start = np.cumsum(size) - size
                bucket = common.bucket_of(common.mix(e["h"]), buckets)
                order = np.argsort(bucket, kind="stable")
                to = common.by_bucket(bucket[order], buckets)
                for k in np.flatnonzero(np.diff(to)):
                    i = order[to[k] : to[k + 1]]
                    rows.append((int(k), 0, e[i].tobytes(), data[common.ranges(start[i], size[i])].tobytes()))
            if crowd:
                w = np.concatenate(crowd)
                bucket = common.bucket_of(w["h"], buckets)
                order = np.argsort(bucket, kind="stable")
                to = common.by_bucket(bucket[order], buckets)
                rows += [(int(k), 1, w[order[to[k] : to[k + 1]]].tobytes(), b"") for k in np.flatnonzero(np.diff(to))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "kind", "e", "data"])

        codec = pa.Codec("zstd")
        for batch in batches:
            for rid, n_bytes, z, wanted in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                data = np.frombuffer(codec.decompress(z, n_bytes), np.uint8)
                ask = np.array([(x["kind"], x["lo"], x["n"], x["off"], x["h"]) for x in wanted], np.int64)
                seg = ask[ask[:, 0] != CROWDED]
                if len(seg):
                    e = np.zeros(len(seg), segment)
                    e["own"], e["lo"], e["n"], e["off"], e["h"] = seg[:, 0], seg[:, 1], seg[:, 2], seg[:, 3], seg[:, 4].view(U64)
                    e["rid"] = np.int64(rid).view(U64)
                    held.append((e, data[common.ranges(seg[:, 1], seg[:, 2] + LENGTH - 1)]))
                    waiting += len(held[-1][1])
                far = ask[ask[:, 0] == CROWDED]
                if len(far):
                    p = common.ranges(far[:, 1], far[:, 2])
                    w = np.zeros(len(p), window)
                    w["h"] = common.span_hash(common.prefix_hash(data, _VALUES), p, p + LENGTH)
                    w["g"] = common.span_hash(common.prefix_hash(data, _SECOND), p, p + LENGTH).astype(np.uint32)
                    w["rid"], w["lo"] = np.int64(rid).view(U64), p
                    crowd.append(w)
                    waiting += w.nbytes
                if waiting >= flush:
                    yield from out()
                    held, crowd, waiting = [], [], 0
        yield from out()

    def sort(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        mine = rows[rows["kind"] == 0]
        if len(mine):
            e = np.concatenate([np.frombuffer(x, segment) for x in mine["e"]])
            data = np.concatenate([np.frombuffer(x, np.uint8) for x in mine["data"]])
            size = e["n"].astype(np.int64) + LENGTH - 1
            start = np.cumsum(size) - size
            order = np.argsort(e["h"], kind="stable")
            ends = common.runs(e["h"][order])[1:]
            done = 0
            while done < len(order):  # whole anchors, some thousand segments at a time
                last = int(ends[min(np.searchsorted(ends, done + 3_000), len(ends) - 1)])
                i = order[done:last]
                done = last
                n = e["n"][i].astype(np.int64)
                part = data[common.ranges(start[i], size[i])]
                hit = _repeats(part, np.cumsum(size[i]) - size[i], n, e["off"][i].astype(np.int64), e["h"][i])
                hit &= np.repeat(e["own"][i] == 0, n)  # others are settled already
                found.append(_as_ranges(np.repeat(e["rid"][i], n)[hit], (np.repeat(e["lo"][i].astype(np.int64), n) + common.ranges(np.zeros(len(i), np.int64), n))[hit]))
        mine = rows[rows["kind"] == 1]
        if len(mine):
            w = np.concatenate([np.frombuffer(x, window) for x in mine["e"]])
            order, at = _groups((w["g"], w["h"]))
            much = np.repeat(np.diff(at) > 1, np.diff(at))
            w = w[order][much]
            found.append(_as_ranges(np.ascontiguousarray(w["rid"]), w["lo"].astype(np.int64)))
        got = pd.concat(found) if found else pd.DataFrame({"rid": [], "a": [], "b": []}).astype("int64")
        # a row for each bucket of documents, not for each range: windows of one document are scattered here
        place = common.bucket_of(common.mix(got["rid"].to_numpy(np.int64).view(U64)), buckets)
        order = np.argsort(place, kind="stable")
        to = common.by_bucket(place[order], buckets)
        table = got.to_numpy(np.int64)[order]
        return pd.DataFrame([(int(k), table[to[k] : to[k + 1]].tobytes()) for k in np.flatnonzero(np.diff(to))], columns=["bucket", "ranges"])

    def gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Ranges of each document that meet or overlap as one."""
        x = np.concatenate([np.frombuffer(r, np.int64).reshape(-1, 3) for r in rows["ranges"]])
        x = x[np.lexsort((x[:, 1], x[:, 0]))]
        new = np.ones(len(x), bool)
        for _, at in _runs_of(x[:, 0]):
            reach = np.maximum.accumulate(x[at, 2])
            new[at][1:] = x[at, 1][1:] > reach[:-1]
        head = np.flatnonzero(new)
        return pd.DataFrame({"rid": x[head, 0], "a": x[head, 1], "b": np.maximum.reduceat(x[:, 2], head)})

    asked = requests.groupBy("rid").agg(F.collect_list(F.struct("kind", "lo", "n", "off", "h")).alias("wanted"))  # as many as a document has segments
    joined = packed.join(asked, "rid").select("rid", "n_bytes", "z", "wanted").mapInArrow(fetch, "bucket int, kind int, e binary, data binary")
    ranges_ = joined.groupBy("bucket").applyInPandas(sort, "bucket int, ranges binary")
    return ranges_.groupBy("bucket").applyInPandas(gather, "rid long, a long, b long")


def _pack(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, n_bytes, z): texts compressed for the shuffles, one row for each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for part, data, at in common.slices(batches):
            raw = memoryview(data.tobytes())
            z = [codec.compress(raw[a:b], asbytes=True) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(at)), pa.array(z, pa.binary())], names=["rid", "doc_id", "n_bytes", "z"])

    return docs.select("rid", "doc_id", "text").mapInArrow(rows, "rid long, doc_id long, n_bytes long, z binary")


def ranges(docs: DataFrame) -> DataFrame:
    """(rid, a, b): byte ranges [a, b) of repeats; rid is xxhash64(doc_id, text)."""
    named = _named(docs)
    found = common.cut(candidates(named), "suffix-candidates")
    common.release(docs.sparkSession)
    settled = found.where(F.col("kind") == SETTLED).select("rid", F.col("lo").alias("a"), (F.col("lo") + F.col("n") + (LENGTH - 1)).alias("b"))
    fetched = found.where(F.col("kind") != SETTLED).distinct()
    # equal rows fetch their text once
    once = _pack(named).dropDuplicates(["rid"])
    sorted_ = common.cut(settle(once, fetched), "suffix-ranges")
    common.release(docs.sparkSession)
    # every window of equal rows is a repeat, whatever their shared rid made of their requests
    rows = named.groupBy("rid").agg(F.count("*").alias("c"), F.max(F.octet_length("text")).cast("long").alias("b"))
    equal = rows.where((F.col("c") > 1) & (F.col("b") >= LENGTH)).select("rid", F.lit(0).cast("long").alias("a"), "b")
    return settled.unionByName(sorted_).unionByName(equal)


def _named(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))


def remove(docs: DataFrame, texts: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): what stays of each text, ``kept`` its bytes (null unless ``texts``)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for n, z, spans in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                data = np.frombuffer(codec.decompress(z, n), np.uint8) if n else np.empty(0, np.uint8)
                edge = np.zeros(n + 1, np.int64)
                if spans:
                    ab = np.array([(s["a"], s["b"]) for s in spans], np.int64)
                    np.add.at(edge, ab[:, 0], 1)
                    np.add.at(edge, ab[:, 1], -1)
                gone = np.cumsum(edge)[:n] > 0
                kept = data[~gone].tobytes()
                begins = int((gone[1:] & ~gone[:-1]).sum() + (n > 0 and bool(gone[0])))
                for column, x in zip(out, (n, int(gone.sum()), begins, hashlib.sha256(kept).hexdigest(), kept if texts else None), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    spans = ranges(docs).groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    joined = _pack(_named(docs)).join(spans, "rid", "left").select("doc_id", "n_bytes", "z", "spans")
    return joined.mapInArrow(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(common.read(spark, sf_dir, "documents"), texts=False).drop("kept")

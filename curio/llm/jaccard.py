"""N-gram Jaccard join by set relations (operator 5): exact classes of near-duplicate documents.

A document's set: hashes of its distinct ``SHINGLE``-word shingles (the whole sequence where it has
fewer words).  Two link when 100 * intersection >= ``PERCENT`` * union.

1. *Copies first.*  One pass makes each document's set fingerprint and packs its text; documents of one
   set are one class, and only classes are joined.  Classes that share a 64-bit fingerprint show by a
   second one and take that instead.  The pass also finds shingles that many classes have.
2. *Index.*  Sets are ordered with frequent shingles last, the most frequent ones at the end.  A linked pair shares one of the first
   n - ceil(0.8 n) + 1, and at the first shared one as much as a link needs must still follow: that bounds
   the positions.  Lists are sorted by size, then position, and cut into blocks of ``LIST_BLOCK`` entries;
   the sizes and positions of two blocks tell whether any pair of them can link, else both are skipped.
3. *Hubs.*  The entry of least position in a list has the fewest rare shingles, so in a group of near
   copies it is the one that most others resemble: the list's hub.  Members are compared with it first;
   those linked with it are one component, and pairs within a component are never compared.
4. *Answers from similar sets.*  In long lists members only meet the hub, and very long ones never gather in one place.
   All long lists of a hub Q are one family, whose members' overlaps with Q bound every other pair,
   |R n S| <= min(|R n Q|, |S n Q|) + min(|R - Q|, |S - Q|).  Families are dealt into blocks by size and
   overlap (``FAMILY_BLOCK`` shingles at most), and only pairs of blocks that this bound and the components
   leave open are compared, each pair of blocks in a group of its own: by sketches first, then by whole sets.

No pair is lost: each is either compared by whole sets, ruled out by a bound, or joined through a common
hub.  Sketches (counts of the set's hashes in ``CELLS`` cells) bound the difference of two sets from below
and save comparisons.

Definedness: null, empty and blank texts have empty sets, link with nothing and are their own component;
very long texts are one set like others, compared whole; ties among hubs go to the least class; rows that
repeat an id are documents of their own; a null id never becomes a component id unless the whole component
has none; extra columns are ignored, and kept whatever their names by :func:`deduplicate`; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curio.llm import common

SHINGLE, PERCENT = 5, 80
U64 = np.uint64
CELLS = 256
#: Bound of the broadcast set of frequent shingles; it orders sets and names long lists, and loses no pair.
MAX_FREQUENT = 300_000
#: Lists of more members are resolved by families, shorter ones in blocks of so many entries; lists that are
#: known to have more than DEALT_LIST are not even gathered to find their hub.
LONG_LIST, LIST_BLOCK, DEALT_LIST = 8, 4, 2_000
#: Shingles in a block of a family (one document may have more), its members, and members that meet their hub in one group.
FAMILY_BLOCK, FAMILY_ROWS, HUB_GROUP = 400_000, 4_096, 256
#: Members of one side whose overlaps with the other side are held at once.
OVERLAP_ROWS = 256
#: Long lists whose hubs are broadcast, and classes whose ids are (some 64 MB); more are joined by a shuffle.
BROADCAST_HUBS, BROADCAST_CLASSES = 500_000, 2_000_000
_SALT, _TWIN = U64(0x8CB92BA72F3D8DD7), U64(0x5851F42D4C957F2D)
#: Bits of a class fingerprint that are used (tests take few).
_MARK = U64(0xFFFFFFFFFFFFFFFF)


def shingles(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the rows' distinct shingles, sorted by row and hash."""
    size = np.diff(at)
    row = common.row_of(at)
    n = len(words)
    h = words.copy()
    for k in range(1, SHINGLE):
        nxt = np.zeros(n, U64)
        if n > k:
            nxt[:-k] = words[k:]
        # past the row's last word nothing is added: short rows hash their whole sequence
        inside = (np.arange(n) + k) < at[1:][row]
        h = np.where(inside, common.mix(h * U64(0x9E3779B97F4A7C15) + nxt + U64(k)), h)
    first = np.arange(n) - at[:-1][row]
    keep = first < np.maximum(size[row] - SHINGLE + 1, 1)
    h, row = h[keep], row[keep]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def _sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, n+1 offsets, fingerprint of each row's set, and the one that serves where two sets share that)."""
    row, h = shingles(*common.word_hashes(data, at))
    offsets = np.searchsorted(row, np.arange(len(at)))
    size = np.diff(offsets)
    mark, twin = np.zeros(len(size), U64), np.zeros(len(size), U64)
    if len(h):
        some = size > 0
        mark[some] = np.add.reduceat(common.mix(h ^ _SALT), offsets[:-1][some])
        twin[some] = np.add.reduceat(common.mix(h * _TWIN + _SALT), offsets[:-1][some])
    mark = common.mix(mark + size.astype(U64))
    return row, h, offsets, mark & _MARK, common.mix(mark ^ common.mix(twin))


def _classes(mark: np.ndarray, twin: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Class ids: fingerprints, or twins where sets share a fingerprint."""
    return np.where(np.isin(mark, shared), twin, mark) if len(shared) else mark


def _required(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least intersection of linked sets of sizes a and b: 100 i >= P (a + b - i)."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def _need(a: Column, b: Column) -> Column:
    """As :func:`_required`."""
    return F.ceil(PERCENT * (a + b) / F.lit(100 + PERCENT))


def _rid() -> Column:
    """Names a row: rows that share an id, or have none, differ by their texts."""
    return F.xxhash64("doc_id", "text").alias("rid")


def describe(docs: DataFrame, flush: int = 4_000_000) -> DataFrame:
    """A row a document (rid, doc_id, n, mark, twin, sketch, z: its packed text), and rows of ``shingle``: shingles with the classes of a task that have them."""
    names = ["rid", "doc_id", "n", "mark", "twin", "sketch", "n_bytes", "z", "shingle", "seen"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        codec = pa.Codec("zstd", compression_level=1)

        def frequent() -> pa.RecordBatch:
            mark, h = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((mark, h))
            mark, h = mark[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (mark[1:] != mark[:-1])
            h = h[new]  # a class counts once
            at = common.runs(h)
            count = np.diff(at)
            often = count >= 3
            arrays = [pa.nulls(1, k) for k in kinds[:8]] + [pa.array([x], k) for x, k in zip((h[at[:-1][often]].view(np.int64), count[often]), kinds[8:], strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for part, data, at in common.slices(batches):
            row, h, offsets, mark, twin = _sets(data, at)
            size = np.diff(offsets)
            cells = np.bincount(row * CELLS + (h & U64(CELLS - 1)).astype(np.int64), minlength=CELLS * len(size))
            sketch = [x.tobytes() for x in np.minimum(cells, 255).astype(np.uint8).reshape(-1, CELLS)]
            raw = memoryview(data.tobytes())
            z = [codec.compress(raw[a:b], asbytes=True) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            doc = part.column(part.schema.get_field_index("doc_id")).cast(pa.int64())
            rid = part.column(part.schema.get_field_index("rid"))
            arrays = [rid, doc, pa.array(size), pa.array(mark.view(np.int64)), pa.array(twin.view(np.int64)), pa.array(sketch, pa.binary()), pa.array(np.diff(at)), pa.array(z, pa.binary())]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.nulls(len(size), k) for k in kinds[8:])], names=names)
            held.append((mark[row], h))
            waiting += len(h)
            if waiting >= flush:
                yield frequent()
                held, waiting = [], 0
        if waiting:
            yield frequent()

    return docs.select("doc_id", "text", _rid()).mapInArrow(rows, "rid long, doc_id long, n long, mark long, twin long, sketch binary, n_bytes long, z binary, shingle array<long>, seen array<long>")


def frequent_shingles(described: DataFrame, least: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of at most MAX_FREQUENT shingles, those that most classes have, and how many those are."""
    counts = described.where("shingle is not null").select(F.explode(F.arrays_zip("shingle", "seen")).alias("x")).groupBy("x.shingle").agg(F.sum("x.seen").alias("c")).where(F.col("c") >= least)
    counts = common.cut(counts, "jaccard-frequent")
    levels = counts.groupBy(F.floor(F.log2("c") * 4).alias("level")).count().orderBy(F.desc("level")).collect()  # some hundred rows at most
    total, level = 0, None
    for r in levels:
        total += r["count"]
        if total > MAX_FREQUENT:
            break
        level = r["level"]
    if level is None:
        return np.empty(0, U64), np.empty(0, np.int64)
    got = counts.where(F.floor(F.log2("c") * 4) >= level).toPandas()  # MAX_FREQUENT rows at most
    h, c = got["shingle"].to_numpy(np.int64).view(U64), got["c"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def _once(h: np.ndarray, mark: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries of each shingle once a class, sorted by shingle and class."""
    order = np.lexsort((mark, h))
    h, mark, n, pos = h[order], mark[order], n[order], pos[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (mark[1:] != mark[:-1])
    return h[new], mark[new], n[new], pos[new]


def _may_link(na, nb, pa_, pb):
    """Whether sets of these sizes whose first common shingle stands at these positions can link."""
    need = _required(na, nb)
    return np.minimum(na - pa_, nb - pb) >= need


def block_pairs(list_at: np.ndarray, n: np.ndarray, pos: np.ndarray, chunk: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of entries of one list that sizes and positions leave open; whole pairs of blocks are skipped first.

    Entries are sorted by list, size and position; ``list_at`` are the lists' offsets.
    """
    size = np.diff(list_at)
    blocks = -(-size // LIST_BLOCK)
    of = np.repeat(np.arange(len(size)), blocks)
    begin = list_at[:-1][of] + LIST_BLOCK * common.ranges(np.zeros(len(size), np.int64), blocks)
    end = np.minimum(begin + LIST_BLOCK, list_at[1:][of])
    if not len(begin):
        return
    least, most = n[begin], n[end - 1]
    first = np.minimum.reduceat(pos, begin)
    room = most - first
    live = np.arange(len(begin))
    for gap in range(int(blocks.max())):
        live = live[live + gap < len(begin)]
        live = live[of[live + gap] == of[live]]
        live = live[PERCENT * least[live + gap] <= 100 * most[live]]  # sizes ascend: what follows is farther still
        if not len(live):
            break
        open_ = live[np.minimum(room[live], room[live + gap]) >= _required(least[live], least[live + gap])]
        wide = (end - begin)[open_] * (end - begin)[open_ + gap]
        cuts = np.searchsorted(np.cumsum(wide), np.arange(0, int(wide.sum()) + 1, chunk), "right") if len(wide) else np.zeros(1, np.int64)
        for a, b in zip(cuts, [*cuts[1:], len(open_)], strict=True):
            x = open_[a:b]
            y = x + gap
            right = (end - begin)[y]
            k = common.ranges(np.zeros(len(x), np.int64), wide[a:b])
            own = np.repeat(np.arange(len(x)), wide[a:b])
            i, j = begin[x][own] + k // right[own], begin[y][own] + k % right[own]
            ok = (i < j) & _may_link(n[i], n[j], pos[i], pos[j])
            yield i[ok], j[ok]


_FOUND = ("kind", "a", "b", "na", "nb", "list")


def index(described: DataFrame, frequent: tuple[np.ndarray, np.ndarray], shared: np.ndarray, flush: int = 2_000_000) -> DataFrame:
    """Rows (kind, a, b, na, nb, list).

    Kind 0: a hub and a member of a short list, 1: other pairs of short lists, 2: members (a) of dealt lists with their
    position ``nb``, 3: a hub (a) of long lists and a member.
    """
    spark = described.sparkSession
    buckets = common.shuffle_parts(spark)
    often_, count_ = frequent
    held_frequent = spark.sparkContext.broadcast((often_, count_, often_[count_ > DEALT_LIST]))  # at most MAX_FREQUENT hashes each

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times, long_ = held_frequent.value
        held: list[tuple[np.ndarray, ...]] = []
        waiting = 0

        def pieces() -> pa.RecordBatch:
            h, mark, n, pos = _once(*(np.concatenate(x) for x in zip(*held, strict=True)))  # copies within the task go as one
            many = np.isin(h, long_)
            # members of lists known to be long are dealt by class: no task has such a list
            bucket = 2 * common.bucket_of(common.mix(np.where(many, mark, h)), buckets) + many
            order = np.argsort(bucket, kind="stable")
            h, mark, n, pos, bucket = h[order], mark[order], n[order], pos[order], bucket[order]
            to = common.by_bucket(bucket, 2 * buckets)
            some = np.flatnonzero(np.diff(to))
            blobs = [[x[to[k] : to[k + 1]].tobytes() for k in some] for x in (h, mark, n.astype("<u4"), pos.astype("<u4"))]
            return pa.RecordBatch.from_arrays([pa.array((some // 2).astype(np.int32)), pa.array((some % 2).astype(np.int32)), *(pa.array(b, pa.binary()) for b in blobs)], names=["bucket", "many", "h", "m", "n", "p"])

        for data, at in common.unpacked(batches):
            row, h, offsets, mark, twin = _sets(data, at)
            if not len(h):
                continue
            mark = _classes(mark, twin, shared)
            if len(often):
                i = np.minimum(np.searchsorted(often, h), len(often) - 1)
                order = np.lexsort((h, np.where(often[i] == h, times[i], 0), row))
                h = h[order]
            n = np.diff(offsets)[row]
            pos = np.arange(len(h)) - offsets[:-1][row]
            keep = pos < n - (-(-PERCENT * n // 100)) + 1
            held.append((h[keep], mark[row[keep]], n[keep], pos[keep]))
            waiting += int(keep.sum())
            if waiting >= flush:
                yield pieces()
                held, waiting = [], 0
        if waiting:
            yield pieces()

    def entries(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
        h, mark = (np.concatenate([np.frombuffer(x, np.uint64) for x in rows[c]]) for c in ("h", "m"))
        n, pos = (np.concatenate([np.frombuffer(x, "<u4") for x in rows[c]]).astype(np.int64) for c in ("n", "p"))
        return _once(h, mark, n, pos)

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = []

        def put(kind: int, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, name: np.ndarray | None = None) -> None:
            swap = (a > b) & (kind < 2)
            columns = np.where(swap, b, a).view(np.int64), np.where(swap, a, b).view(np.int64), np.where(swap, nb, na), np.where(swap, na, nb), (name if name is not None else np.zeros(len(a), U64)).view(np.int64)
            out.append(pd.DataFrame(dict(zip(_FOUND, (kind, *columns), strict=True))))

        if (long_ := rows["many"] == 1).any():
            h, mark, n, pos = entries(rows[long_])
            put(2, mark, mark, n, pos, h)
        if not long_.all():
            h, mark, n, pos = entries(rows[~long_])
            at = common.runs(h)
            size = np.repeat(np.diff(at), np.diff(at))
            if (more := size > LONG_LIST).any():
                which, m, k, p = (x[more] for x in (np.repeat(np.arange(len(at) - 1), np.diff(at)), mark, n, pos))
                hub = np.repeat(np.lexsort((m, p, which))[common.runs(which)[:-1]], np.diff(common.runs(which)))
                other = np.flatnonzero(hub != np.arange(len(hub)))
                put(3, m[hub[other]], m[other], k[hub[other]], k[other])
            short = (size > 1) & ~more
            h, mark, n, pos = h[short], mark[short], n[short], pos[short]
            order = np.lexsort((pos, n, h))
            h, mark, n, pos = h[order], mark[order], n[order], pos[order]
            at = common.runs(h)
            if len(h):
                which = np.repeat(np.arange(len(at) - 1), np.diff(at))
                hub = np.lexsort((mark, pos, which))[at[:-1]]
                for i, j in block_pairs(at, n, pos):
                    first = ((hub[which[i]] == i) | (hub[which[i]] == j)).astype(np.int64)
                    for kind in (0, 1):
                        x, y = i[first == 1 - kind], j[first == 1 - kind]
                        put(kind, mark[x], mark[y], n[x], n[y])
        got = pd.concat(out) if out else pd.DataFrame({c: np.empty(0, np.int64) for c in _FOUND})
        return got.drop_duplicates()

    packed = described.where("n > 0").select("n_bytes", "z")
    pieces = packed.mapInArrow(prefixes, "bucket int, many int, h binary, m binary, n binary, p binary")
    return pieces.groupBy("bucket").applyInPandas(join, "kind int, a long, b long, na long, nb long, list long")


def _bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``pairs`` with ``most``: what their sketches leave of an intersection."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16) for k in (4, 5))
            na, nb = (np.asarray(batch.column(k)) for k in (2, 3))
            # a symmetric difference of d leaves an intersection of (na + nb - d) / 2 at most
            most = np.minimum((na + nb - np.abs(x - y).sum(axis=1, dtype=np.int64)) // 2, np.minimum(na, nb))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(most)], names=["a", "b", "na", "nb", "most"])

    s = classes.select("class", "sketch")
    got = pairs.join(s.select(F.col("class").alias("a"), F.col("sketch").alias("x")), "a").join(s.select(F.col("class").alias("b"), F.col("sketch").alias("y")), "b")
    return got.select("a", "b", "na", "nb", "x", "y").mapInArrow(bound, "a long, b long, na long, nb long, most long")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b, na, nb) with a < b."""
    swap = F.col("a") > F.col("b")
    one = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return pairs.select(one("a", "b").alias("a"), one("b", "a").alias("b"), one("na", "nb").alias("na"), one("nb", "na").alias("nb")).distinct()


def _overlaps(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, na, nb, both): the exact intersections of ``pairs`` (a, b).

    A pair carries the text of ``b``; that of ``a`` travels once for each HUB_GROUP of its pairs.
    """
    crowded = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_GROUP).alias("k")).where("k > 1")
    dealt = pairs.select("a", "b").join(crowded, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("k", F.lit(1))).alias("s"))
    dealt = common.cut(dealt, "jaccard-dealt")
    left = dealt.select("a", "s").distinct().join(texts.withColumnRenamed("class", "a"), "a").select("a", "s", F.lit(None).cast("long").alias("b"), "n_bytes", "z")
    right = dealt.join(texts.withColumnRenamed("class", "b"), "b").select("a", "s", "b", "n_bytes", "z")
    met = left.unionByName(right).repartition("a", "s").sortWithinPartitions("a", "s", F.col("b").asc_nulls_first())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.empty(0, U64)
        for part, data, at in common.unpacked(batches, rows=True):
            _, h, offsets, _, _ = _sets(data, at)
            a, b = part.column(0).to_pylist(), part.column(2).to_pylist()
            out: list[tuple] = []
            for k in range(len(a)):
                own = h[offsets[k] : offsets[k + 1]]
                if b[k] is None:
                    hub = own
                else:
                    spot = np.minimum(np.searchsorted(hub, own), len(hub) - 1)
                    out.append((a[k], b[k], len(hub), len(own), int((hub[spot] == own).sum())))
            table = np.array(out, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(table[:, k])) for k in range(5)], names=["a", "b", "na", "nb", "both"])

    return met.mapInArrow(count, "a long, b long, na long, nb long, both long")


def _linked(found: DataFrame) -> DataFrame:
    return found.where(100 * F.col("both") >= PERCENT * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _with_component(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs of different components."""
    c = comps.select("id", "component_id")
    got = pairs.join(c.select(F.col("id").alias("a"), F.col("component_id").alias("ca")), "a", "left").join(c.select(F.col("id").alias("b"), F.col("component_id").alias("cb")), "b", "left")
    return got.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def families(found: DataFrame) -> DataFrame:
    """(hub, nhub, a, na): the other members of the long lists that have one hub; ``found`` is an :func:`index`."""
    members = found.where("kind = 2").select("list", "a", "na", F.col("nb").alias("pos"))
    hubs = common.cut(members.groupBy("list").agg(F.min(F.struct("pos", F.col("a").alias("hub"), F.col("na").alias("nhub"))).alias("h")).select("list", "h.hub", "h.nhub"), "jaccard-list-hubs")
    few = hubs.limit(BROADCAST_HUBS + 1).count() <= BROADCAST_HUBS
    dealt = members.join(F.broadcast(hubs) if few else hubs, "list").where("a <> hub").select("hub", "nhub", "a", "na")
    return dealt.unionByName(found.where("kind = 3").select(F.col("a").alias("hub"), F.col("na").alias("nhub"), F.col("b").alias("a"), F.col("nb").alias("na"))).distinct()


def _placed(family: DataFrame, bounds: DataFrame, compared: DataFrame, comps: DataFrame) -> DataFrame:
    """(hub, i, j, block, a, n, in_hub, most, comp): members of each unit to compare, block i of a family with block j.

    A family of at most FAMILY_BLOCK shingles and FAMILY_ROWS members is one unit; of larger ones, pairs of blocks that the bounds leave open.
    """
    ends = (F.least("hub", "a").alias("a"), F.greatest("hub", "a").alias("b"))
    pair = family.select("hub", F.col("a").alias("member"), F.col("na").alias("n"), *ends)
    state = pair.join(bounds.select("a", "b", "most"), ["a", "b"]).join(compared.select("a", "b", "both"), ["a", "b"], "left")
    state = state.select("hub", F.col("member").alias("a"), "n", F.coalesce("both", F.lit(0)).alias("in_hub"), F.coalesce("both", "most").alias("most"))
    state = state.join(comps.select(F.col("id").alias("a"), "component_id"), "a", "left").withColumn("comp", F.coalesce("component_id", "a")).drop("component_id")
    state = common.cut(state, "jaccard-state")
    # more members than one, in more components than one
    several = state.groupBy("hub").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("n").alias("whole"), F.count("*").alias("members")).where("lo <> hi").select("hub", ((F.col("whole") > FAMILY_BLOCK) | (F.col("members") > FAMILY_ROWS)).alias("dealt"))
    state = state.join(several, "hub")
    whole = state.where("not dealt").select("hub", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("block"), "a", "n", "in_hub", "most", "comp")
    # members alike in size and overlap with the hub share blocks
    key = ["hub", "size", "share"]
    large = state.where("dealt").withColumn("size", F.floor(F.log("n") / F.log(F.lit(1.12))).cast("int")).withColumn("share", F.floor(16 * F.col("in_hub") / F.col("n")).cast("int"))
    parts = large.groupBy(*key).agg(F.greatest(F.ceil(F.sum("n") / FAMILY_BLOCK), F.ceil(F.count("*") / FAMILY_ROWS)).alias("k")).where("k > 1")
    large = large.join(parts, key, "left").withColumn("block", F.xxhash64("size", "share", F.pmod(F.xxhash64("a"), F.coalesce("k", F.lit(1)))))
    large = common.cut(large.select("hub", "block", "a", "n", "in_hub", "most", "comp"), "jaccard-blocks")
    blocks = large.groupBy("hub", "block").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.max("most").alias("m"), F.max(F.col("n") - F.col("in_hub")).alias("r"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    blocks = common.cut(blocks, "jaccard-block-bounds")
    two = blocks.withColumnsRenamed({c: f"{c}_" for c in ("block", "n0", "n1", "m", "r", "c0", "c1")})
    open_ = (
        (PERCENT * F.greatest("n0", "n0_") <= 100 * F.least("n1", "n1_"))
        & (F.least("m", "m_") + F.least("r", "r_") >= _need(F.col("n0"), F.col("n0_")))
        & ~((F.col("c0") == F.col("c1")) & (F.col("c0") == F.col("c0_")) & (F.col("c0") == F.col("c1_")))
    )
    pairs = common.cut(blocks.join(two, "hub").where("block <= block_").where(open_).select("hub", F.col("block").alias("i"), F.col("block_").alias("j")), "jaccard-block-pairs")
    places = pairs.select("hub", "i", "j", F.col("i").alias("block")).unionByName(pairs.where("i <> j").select("hub", "i", "j", F.col("j").alias("block")))
    return whole.unionByName(large.join(places, ["hub", "block"]).select(*whole.columns))


def _sides(unit: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rows of block i and of block j of a unit."""
    i, j, block = (np.asarray(unit.column(k)) for k in (1, 2, 3))
    return np.flatnonzero(block == i), np.flatnonzero(block == j)


def _open_members(placed: DataFrame, classes: DataFrame) -> DataFrame:
    """(hub, i, j, block, a, comp): members of a unit that may link with another one there, of another component."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in common.groups(batches, 3):
            left, right = _sides(unit)
            n, in_hub, most, comp = (np.asarray(unit.column(k)) for k in (5, 6, 7, 8))
            cells = np.frombuffer(b"".join(unit.column(9).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16)
            rest = n - in_hub
            stay = np.zeros(len(n), bool)
            step = max(1, 50_000 // max(1, len(right)))
            for low in range(0, len(left), step):
                x = left[low : low + step][:, None]
                need = _required(n[x], n[right])
                ok = (comp[x] != comp[right]) & (np.minimum(n[x], n[right]) >= need) & (np.minimum(most[x], most[right]) + np.minimum(rest[x], rest[right]) >= need)
                u, v = np.nonzero(ok)
                need = need[u, v]
                u, v = x[u, 0], right[v]
                hit = (n[u] + n[v] - np.abs(cells[u] - cells[v]).sum(axis=1, dtype=np.int64)) // 2 >= need
                stay[u[hit]] = stay[v[hit]] = True
            if stay.any():
                yield unit.select([0, 1, 2, 3, 4, 8]).filter(pa.array(stay))

    sketched = placed.join(classes.select(F.col("class").alias("a"), "sketch"), "a").select(*placed.columns, "sketch")
    return sketched.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j").mapInArrow(keep, "hub long, i long, j long, block long, a long, comp long")


def _across(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links of members of one unit and different components, one at least for each two components that have any."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in common.groups(batches, 3):
            left, right = _sides(unit)
            a, comp = np.asarray(unit.column(4)), np.asarray(unit.column(5))
            data, at = common.unpack(unit.column(6).to_pylist(), unit.column(7).to_pylist())
            row, h, offsets, _, _ = _sets(data, at)
            n = np.diff(offsets)
            _, which, times = np.unique(h, return_inverse=True, return_counts=True)
            spot = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[which]  # shingles of one row only meet nothing
            row, spot = row[spot >= 0], spot[spot >= 0]
            order = np.argsort(spot, kind="stable")
            row, spot = row[order], spot[order]
            width, spots = 2_048, int(spot[-1]) + 1 if len(spot) else 0

            def marked(rows: np.ndarray, low: int) -> np.ndarray:
                """Which of ``width`` shared shingles from ``low`` on each row has."""
                place = np.full(len(a), -1)
                place[rows] = np.arange(len(rows))
                some = slice(*np.searchsorted(spot, (low, low + width)))
                own = place[row[some]] >= 0
                has = np.zeros((len(rows), min(width, spots - low)), np.float32)
                has[place[row[some]][own], spot[some][own] - low] = 1
                return has

            for first in range(0, len(left), OVERLAP_ROWS):
                some = left[first : first + OVERLAP_ROWS]
                both = np.zeros((len(some), len(right)), np.float32)
                for low in range(0, spots, width):
                    both += marked(some, low) @ marked(right, low).T
                both = both.astype(np.int64)
                hit = 100 * both >= PERCENT * (n[some][:, None] + n[right] - both)
                x, y = np.nonzero(hit & (comp[some][:, None] != comp[right]))
                x, y = some[x], right[y]
                _, one = np.unique(np.column_stack((comp[x], comp[y])), axis=0, return_index=True)
                if len(one):
                    yield pa.RecordBatch.from_arrays([pa.array(a[x[one]]), pa.array(a[y[one]])], names=["a", "b"])

    sent = members.join(texts.withColumnRenamed("class", "a"), "a").select("hub", "i", "j", "block", "a", "comp", "n_bytes", "z")
    return sent.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j").mapInArrow(compare, "a long, b long")


def _resolved(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (rid, doc_id, n, class), classes (class, first, doc_id, ...; ``first``: its least row) and components of linked classes."""
    spark = docs.sparkSession
    described = common.cut(describe(docs), "jaccard-sets")
    frequent = frequent_shingles(described)
    known = described.where("mark is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")

    def grouped(rows: DataFrame) -> DataFrame:
        of = rows.where("n > 0").groupBy("class").agg(first, F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("twin").alias("lo"), F.max("twin").alias("hi"))
        return common.cut(of.withColumn("doc_id", F.col("first.doc_id")), "jaccard-classes")

    rows = known.withColumn("class", F.col("mark"))
    classes = grouped(rows)
    # different sets of one fingerprint: none is expected below some billion classes
    shared = [r["class"] for r in classes.where("lo <> hi").select("class").collect()]
    if shared:
        rows = known.withColumn("class", F.when(F.col("mark").isin(shared), F.col("twin")).otherwise(F.col("mark")))
        classes = grouped(rows)
    classes = classes.drop("lo", "hi")
    found = common.cut(index(described, frequent, np.array(shared, np.int64).view(U64)), "jaccard-index")
    common.release(spark)

    columns = ("a", "b", "na", "nb")
    family = common.cut(families(found), "jaccard-families")
    hubs = found.where("kind = 0").select(*columns).unionByName(_ordered(family.select(F.col("hub").alias("a"), F.col("a").alias("b"), F.col("nhub").alias("na"), F.col("na").alias("nb"))))
    bounds = common.cut(_bounded(hubs.distinct(), classes), "jaccard-hubs")
    others = common.cut(_bounded(found.where("kind = 1").select(*columns).distinct(), classes).where(F.col("most") >= _need(F.col("na"), F.col("nb"))), "jaccard-others")
    near = bounds.where(F.col("most") >= _need(F.col("na"), F.col("nb")))

    def texts_of(named: DataFrame) -> DataFrame:
        """Packed texts of the classes, one of each; copies go as one before the shuffle."""
        named = common.cut(named.distinct(), "jaccard-named")
        few = named.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES
        single = rows.where("n > 0").select("class", "n_bytes", "z").dropDuplicates(["class"])
        found_ = common.cut(single.join(F.broadcast(named) if few else named, "class", "left_semi"), "jaccard-texts")
        common.release(spark)
        return found_

    either = F.explode(F.array("a", "b")).alias("class")
    texts = texts_of(near.select(either).unionByName(others.select(either)))

    compared = common.cut(_overlaps(near, texts), "jaccard-overlaps")
    common.release(spark)
    comps = common.cut(common.components(_linked(compared)), "jaccard-components")

    def joined_with(links: DataFrame) -> DataFrame:
        edges = comps.select(F.col("id").alias("a"), F.col("component_id").alias("b")).unionByName(links)
        return common.cut(common.components(edges), "jaccard-components") if links.limit(1).count() else comps

    if family.limit(1).count():
        open_ = common.cut(_open_members(_placed(family, bounds, compared, comps), classes), "jaccard-open")
        common.release(spark)
        if open_.limit(1).count():
            comps = joined_with(common.cut(_across(open_, texts_of(open_.select(F.col("a").alias("class")))), "jaccard-across"))
    left = common.cut(_with_component(others, comps), "jaccard-left")
    if left.limit(1).count():
        comps = joined_with(_linked(common.cut(_overlaps(left, texts), "jaccard-late")))
    return rows.select("rid", "doc_id", "n", "class"), classes, comps


def classes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id): class_id names a set, component_id the smallest id reachable over links."""
    rows, classes, comps = _resolved(docs)
    least = comps.join(classes.select(F.col("class").alias("id"), "doc_id"), "id").groupBy("component_id").agg(F.min("doc_id").alias("least"))
    root = comps.join(least, "component_id").select(F.col("id").alias("class"), "least")
    own = classes.select("class", F.col("doc_id").alias("own")).join(root, "class", "left").select("class", F.coalesce("least", "own").alias("least"))
    joined = rows.select("doc_id", "n", "class").join(own, "class", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class")).alias("class_id"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each component, the one with the smallest id (of equal ids the least ``rid``); all rows without shingles.

    Where the ids of the rows that stay can be broadcast, only texts of rows that repeat are shuffled.
    """
    rows, classes, comps = _resolved(docs)
    root = comps.select(F.col("id").alias("class"), "component_id")
    chosen = classes.select("class", "first").join(root, "class", "left").groupBy(F.coalesce("component_id", "class")).agg(F.min("first").alias("first"))
    # rows without words are components of their own, however many share an id and a text
    blank = F.coalesce(F.btrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), F.lit("")) == ""
    name, more = common.unused(docs.columns, "_rid", "_more")
    times = rows.where("n > 0").groupBy("rid").agg((F.count("*") > 1).alias("more"))
    stay = common.cut(chosen.select("first.rid").distinct().join(times, "rid").select(F.col("rid").alias(name), F.col("more").alias(more)), "jaccard-kept")
    common.release(docs.sparkSession)
    own = docs.where(~blank).withColumn(name, _rid())
    if stay.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES:
        met = own.join(F.broadcast(stay), name)
        kept = met.where(~F.col(more)).unionByName(met.where(F.col(more)).dropDuplicates([name]))
    else:
        kept = own.join(stay, name).dropDuplicates([name])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return kept.select(*columns).unionByName(docs.where(blank).select(*columns))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes_of(common.read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")

"""Near-duplicate vectors by NN-descent (operator 3).

Vectors link when their labels are equal (and not null) and their cosine, in double precision, is at
least the threshold.  Vectors that are null, zero or hold null or non-finite components link with nothing.

1. Bit-equal vectors of a label are one node with a count, so a very common vector costs one node.
2. *Start.*  A few tables of random hyperplanes through the mean of each label (a direction that all vectors share
   parts nothing) cut it into leaves of some ``LEAF`` nodes, larger ones by further hyperplanes, then by a hash of
   the id into blocks of at most ``BLOCK``; the nodes of a block are compared in numpy.  Each node keeps its
   ``NEIGHBOURS`` best, however similar; what is linked within a block is joined whether it is among them or not.
3. *Descent.*  At each node its neighbours, and those whose neighbour it is, meet each other: pairs of which one is
   new there are compared by vectors of a byte a component, and those that would enter a list of either are its
   candidates, in every pass.  What may be over the threshold is compared in double precision.
4. *Enlarging.*  Where links fill a list it is as long again for others.  Edges over the threshold make components, within
   which pairs need no more finding; in the end all members of a component are compared, block by block, so a
   component of any size is dealt over tasks and only counts of links leave them.
5. *Audit.*  A number of nodes, dealt over those without links and in small and large components, is compared with
   all: more of them until some links are seen.  Until nodes of few links and nodes of many both have their
   share, further passes follow, each with twice as many tables.

Definedness: ties among neighbours go to the smaller node; one row a vector; rows that repeat an id are vectors of their own (they share the id in
components); extra columns are ignored; an empty table gives no rows.  Vectors of unequal length never link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curio.llm import common

THRESHOLD = 0.93
NEIGHBOURS, LEAF, BLOCK = 12, 1_024, 2_048
#: Tables of the first pass, and the most that are worked on at once.
TABLES, AT_ONCE = 4, 8
#: Neighbours that a node's list gets from one table, and that meet at a node in each direction.
FROM_TABLE, MEETING = 5, 6
#: How far comparisons by bytes may be off.
MARGIN = 0.02
#: Nodes in a block of a component whose links are counted, and rows of a product that are held at once.
COUNTED, HELD = 8_192, 1_024
#: Nodes of each kind that are asked at first and at most, and the links that must be seen among them.
AUDIT, AUDIT_MOST, AUDIT_SEEN = 800, 12_800, 20
RECALL, DESCENTS = 0.995, 1
#: Further hyperplanes for leaves of more than BLOCK nodes.
DEEP = 16
#: In place of a cosine: the two are linked over nodes of their block.
JOINED = 2.0
_EDGE = "u long, v long, sim double"
_FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("sim", pa.float64())])


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nodes_of(vectors: DataFrame) -> DataFrame:
    """(node, space, vec, copies, least): distinct usable vectors; ``space`` names label and length."""
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    same = vectors.where(sound).select("vec_id", F.struct("label", F.size("embedding").alias("n")).alias("space"), _plain(vectors).alias("vec"))
    grouped = same.groupBy("space", "vec").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    return grouped.select(F.xxhash64("space", "vec").alias("node"), F.xxhash64("space").alias("space"), "vec", "copies", "least")


def _plain(vectors: DataFrame) -> Column:
    """The vectors with minus zero as zero, in their own precision; all cosines are in double precision."""
    of = vectors.schema["embedding"].dataType.elementType
    return F.transform("embedding", lambda x: x + F.lit(0.0).cast(of))


def _bits(n: int) -> int:
    """Hyperplanes of a table over n nodes; what fits in a block needs none."""
    return 0 if n <= BLOCK else int(np.ceil(np.log2(n / LEAF)))


def spaces_of(nodes: DataFrame) -> DataFrame:
    """(space, n, mean): how many nodes a space has, and the mean of their directions."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, tuple] = {}
        for rows in batches:
            for (space, _), part in rows.groupby([rows["space"], rows["vec"].map(len)]):
                n, s = total.get(space, (0, 0.0))
                total[space] = n + len(part), s + _unit(part["vec"]).sum(axis=0)
        if total:
            yield pd.DataFrame({"space": list(total), "n": [n for n, _ in total.values()], "total": [s.tolist() for _, s in total.values()]})

    def mean(part: pd.DataFrame) -> pd.DataFrame:
        n = part["n"].sum()
        return pd.DataFrame({"space": [part["space"].iloc[0]], "n": [n], "mean": [(np.stack(part["total"].map(np.asarray)).sum(axis=0) / n).tolist()]})

    partial = nodes.select("space", "vec").mapInPandas(sums, "space long, n long, total array<double>")
    return partial.groupBy("space").applyInPandas(mean, "space long, n long, mean array<double>")


def _leaves(nodes: DataFrame, spaces: DataFrame, low: int, high: int) -> DataFrame:
    """(space, t, leaf, deep, node): each node in tables ``low`` to ``high``; a space that fits in a block has one table alone."""
    sized = nodes.select("node", "space", "vec").join(spaces, "space")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for (space, n), part in rows.groupby([rows["space"], rows["n"]]):
                bits = _bits(n)
                x = _unit(part["vec"]) - np.asarray(part["mean"].iloc[0])
                length = x.shape[1]
                for t in range(low, high if bits else min(high, 1)):
                    planes = np.random.default_rng([t, length]).normal(size=(length, bits + DEEP))
                    side = (x @ planes) > 0
                    code = side[:, :bits] @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), np.int64)
                    deep = side[:, bits:] @ (1 << np.arange(DEEP, dtype=np.int64))
                    yield pd.DataFrame({"space": space, "t": t, "leaf": code, "deep": deep, "node": part["node"].to_numpy()})

    return sized.mapInPandas(cut, "space long, t int, leaf long, deep long, node long")


def _blocks(leaves: DataFrame) -> DataFrame:
    """(space, block, node): leaves, the larger ones in blocks of about BLOCK nodes."""
    key = ["space", "t", "leaf"]
    large = leaves.groupBy(*key).agg(F.count("*").alias("c")).where(F.col("c") > BLOCK)
    more = large.select(*key, F.least(F.lit(DEEP), F.ceil(F.log2(F.col("c") / BLOCK))).cast("int").alias("more"))
    # hyperplanes first: they part near nodes far less often than a hash does
    parted = leaves.join(more, key, "left").withColumn("part", F.expr("deep & (shiftleft(1L, coalesce(more, 0)) - 1)")).drop("deep", "more")
    key.append("part")
    large = parted.groupBy(*key).agg(F.count("*").alias("c")).where(F.col("c") > BLOCK)
    dealt = parted.join(large, key, "left").withColumn("k", F.pmod(F.xxhash64("node", "t"), F.ceil(F.coalesce("c", F.lit(1)) / BLOCK)))
    return dealt.select("space", F.xxhash64("t", "leaf", "part", "k").alias("block"), "node")


def start(nodes: DataFrame, spaces: DataFrame, low: int, high: int) -> DataFrame:
    """Edges (u, v, sim) of the best neighbours in each block of the tables, and of nodes that are JOINED there."""
    blocks = _blocks(common.cut(_leaves(nodes, spaces, low, high), "nn-leaves"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) < 2:
            return pd.DataFrame({"u": [], "v": [], "sim": []}).astype({"u": "int64", "v": "int64", "sim": "float64"})
        x, node = _unit(rows["vec"]), rows["node"].to_numpy()
        s = x @ x.T
        np.fill_diagonal(s, -2)
        k = min(FROM_TABLE, len(node) - 1)
        best = np.argpartition(s, -k, axis=1)[:, -k:]
        u, v = np.repeat(np.arange(len(node)), k), best.ravel()
        got = pd.DataFrame({"u": node[u], "v": node[v], "sim": s[u, v]})
        hit = s >= THRESHOLD
        if not hit.any():
            return got
        del s
        np.fill_diagonal(hit, True)
        root = np.arange(len(node))
        while True:
            least = np.array([root[row].min() for row in hit])
            if (least == root).all():
                break
            root = least
        far = np.flatnonzero(root != np.arange(len(node)))
        return pd.concat((got, pd.DataFrame({"u": node[far], "v": node[root[far]], "sim": JOINED})))

    return blocks.join(nodes.select("node", "vec"), "node").select("space", "block", "node", "vec").groupBy("space", "block").applyInPandas(compare, _EDGE)


def best_of(edges: DataFrame) -> DataFrame:
    """(u, v, sim, new, r): each node's NEIGHBOURS best without repeats, and as many below the threshold where links fill the list.

    ``new`` unless an entry was in a list before; ``r`` is the place in the list.
    """
    # one shuffle by u serves the repeats as well as the list
    once = edges.repartition("u").groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    of = Window.partitionBy("u")
    ranked = once.withColumn("r", F.row_number().over(of.orderBy(F.desc("sim"), "v"))).withColumn("links", F.count(F.when(F.col("sim") >= THRESHOLD, 1)).over(of))
    other = F.col("r") - F.when(F.col("links") >= NEIGHBOURS, F.col("links")).otherwise(0)
    kept = ranked.where(F.when(F.col("sim") >= THRESHOLD, F.col("r")).otherwise(other) <= NEIGHBOURS)
    return kept.select("u", "v", "sim", "new", "r")


def bytes_of(nodes: DataFrame) -> DataFrame:
    """(w, q, scale): unit vectors of a byte a component."""

    def small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for _, part in rows.groupby(rows["vec"].map(len)):
                x = _unit(part["vec"])
                scale = np.abs(x).max(axis=1) / 127
                q = np.rint(x / scale[:, None]).astype(np.int8)
                yield pd.DataFrame({"w": part["node"].to_numpy(), "q": [r.tobytes() for r in q], "scale": scale})

    return nodes.select("node", "vec").mapInPandas(small, "w long, q binary, scale double")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (u, v, sim) among the members (g, w, new, q, scale, least, comp) of each g, which come together."""
    held: list[pa.RecordBatch] = []

    def compared(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        g, w, new, scale, least, comp = (np.asarray(rows.column(c)) if c != "new" else np.asarray(rows.column(c).cast(pa.int8())).astype(bool) for c in ("g", "w", "new", "scale", "least", "comp"))
        at = common.runs(g)
        ends = np.repeat(at[1:], np.diff(at))
        # every later member of the same group
        later = ends - np.arange(len(g)) - 1
        i = np.repeat(np.arange(len(g)), later)
        j = common.ranges(np.arange(len(g)) + 1, later)
        keep = (new[i] | new[j]) & (comp[i] != comp[j])
        i, j = i[keep], j[keep]
        q = rows.column("q").to_pylist()
        width = np.array([len(x) for x in q])
        offset = np.concatenate(([0], np.cumsum(width)))[:-1]
        data = np.frombuffer(b"".join(q), np.int8)
        out = []
        for k in range(0, len(i), 100_000):
            a, b = i[k : k + 100_000], j[k : k + 100_000]
            sim = np.full(len(a), -2.0)
            for d in np.unique(width[a]).tolist():  # members of a group are of one length
                of = np.flatnonzero(width[a] == d)
                x, y = (data[offset[n[of]][:, None] + np.arange(d)].astype(np.float32) for n in (a, b))
                sim[of] = np.einsum("ij,ij->i", x, y) * scale[a[of]] * scale[b[of]]
            good = (sim > np.minimum(least[a], least[b])) | (sim >= THRESHOLD - MARGIN)
            out.append((w[a[good]], w[b[good]], sim[good]))
        if not out:
            return None
        u, v, sim = (np.concatenate(c) for c in zip(*out, strict=True))
        u, v = np.minimum(u, v), np.maximum(u, v)
        order = np.lexsort((v, u))  # a pair of this batch once
        u, v, sim = u[order], v[order], sim[order]
        first = np.ones(len(u), bool)
        first[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
        return pa.RecordBatch.from_arrays([pa.array(u[first]), pa.array(v[first]), pa.array(sim[first])], schema=_FOUND)

    for batch in batches:
        if not batch.num_rows:
            continue
        g = np.asarray(batch.column("g"))
        last = int(np.searchsorted(g, g[-1])) if (g[1:] >= g[:-1]).all() else int(common.runs(g)[-2])
        if last:
            held.append(batch.slice(0, last))
            if (found := compared(pa.Table.from_batches(held).combine_chunks().to_batches()[0])) is not None:
                yield found
            held = []
        held.append(batch.slice(last))
    if held and (found := compared(pa.Table.from_batches(held).combine_chunks().to_batches()[0])) is not None:
        yield found


def descend(small: DataFrame, graph: DataFrame, comps: DataFrame) -> DataFrame:
    """Candidates (u, v, sim; u < v) among neighbours that meet at a node, of different components, by vectors of bytes; some more than once."""
    r = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))
    back = graph.withColumn("r", r).where(F.col("r") <= MEETING).select(F.col("v").alias("g"), F.col("u").alias("w"), "new")
    members = graph.where(F.col("r") <= MEETING).select(F.col("u").alias("g"), F.col("v").alias("w"), "new").unionByName(back)
    # the least that a candidate must exceed to enter a full list
    lists = graph.groupBy("u").agg(F.when(F.count("*") >= NEIGHBOURS, F.min("sim")).alias("least")).withColumnRenamed("u", "w")
    of = comps.select(F.col("id").alias("w"), F.col("component_id").alias("comp"))
    known = small.join(lists, "w", "left").join(of, "w", "left").select("w", "q", "scale", F.coalesce("least", F.lit(-2.0)).alias("least"), F.coalesce("comp", "w").alias("comp"))
    met = members.join(known, "w").select("g", "w", "new", "q", "scale", "least", "comp")
    return met.repartition("g").sortWithinPartitions("g").mapInArrow(_met, _EDGE)


def exact(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b): those of the pairs (u, v) whose cosine, in double precision, is at least the threshold."""
    vec = nodes.select("node", "vec")
    both = pairs.select("u", "v").join(vec.select(F.col("node").alias("v"), F.col("vec").alias("y")), "v").join(vec.select(F.col("node").alias("u"), F.col("vec").alias("x")), "u")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for k in range(0, len(rows), 5000):
                part = rows.iloc[k : k + 5000]
                same = part[part["x"].map(len) == part["y"].map(len)]
                if len(same):
                    sim = np.concatenate([np.einsum("ij,ij->i", _unit(p["x"]), _unit(p["y"])) for _, p in same.groupby(same["x"].map(len))])
                    order = np.concatenate([p.index for _, p in same.groupby(same["x"].map(len))])
                    good = same.loc[order[sim >= THRESHOLD]]
                    yield pd.DataFrame({"a": good["u"], "b": good["v"]})

    return both.select("u", "v", "x", "y").mapInPandas(compare, "a long, b long")


def audit(nodes: DataFrame, linked: DataFrame, rows: int | None = None) -> float | None:
    """The mean share of its links that a node has in its component of ``linked``: of nodes with few links or with many, the lesser.

    Nodes without links, of small and of large components are compared with all, some of each kind, and weigh as many
    nodes as they stand for.  A node in no component has none of its links: of those without links so many are asked
    that some would show if a share of 1 - RECALL of the linked nodes were among them.  Where fewer than AUDIT_SEEN of
    those asked have a link, four times as many are asked.  AUDIT_MOST bounds both; None if no link is seen even then.
    """
    rows = AUDIT if rows is None else rows
    sizes = linked.groupBy("component_id").agg(F.count("*").alias("c"))
    placed = nodes.select("node").join(linked.select(F.col("id").alias("node"), "component_id"), "node", "left").join(sizes, "component_id", "left")
    stratum = F.when(F.col("c").isNull(), 0).when(F.col("c") <= NEIGHBOURS, 1).otherwise(2)
    placed = common.cut(placed.select("node", F.coalesce("component_id", "node").alias("comp"), stratum.alias("stratum")), "nn-placed")
    kinds = {r["stratum"]: r["count"] for r in placed.groupBy("stratum").count().collect()}  # three at most
    with_links = sum(n for stratum, n in kinds.items() if stratum)
    alone = int(3 * kinds.get(0, 0) / ((1 - RECALL) * with_links)) if with_links else 0
    while True:
        got, weight = _asked(nodes, placed, kinds, {0: max(rows, min(AUDIT_MOST, alone)), 1: rows, 2: rows})
        if len(got) >= AUDIT_SEEN or rows >= min(AUDIT_MOST, max(kinds.values(), default=0)):
            break
        rows *= 4
    if not len(got):
        return None
    w, share, few = got["node"].map(weight).to_numpy(float), (got["hit"] / got["n"]).to_numpy(float), got["n"].to_numpy() <= NEIGHBOURS
    return min(float(np.average(share[of], weights=w[of])) for of in (few, ~few) if of.any())


def _asked(nodes: DataFrame, placed: DataFrame, kinds: dict[int, int], rows: dict[int, int]) -> tuple[pd.DataFrame, dict[int, float]]:
    """(node, n, hit) of the asked nodes that have links: how many, and how many of them in their component; and the nodes' weights."""
    vecs = nodes.select("node", "space", "vec")
    parts, weight = [], {}
    for stratum, count in kinds.items():
        chosen = placed.where(F.col("stratum") == stratum).orderBy(F.xxhash64("node", F.lit(3)), "node").limit(rows[stratum])
        parts.append(vecs.join(F.broadcast(chosen), "node").toPandas())  # ``rows`` at most
        weight |= dict.fromkeys(parts[-1]["node"].tolist(), count / max(1, len(parts[-1])))
    if not parts:
        return pd.DataFrame({"node": [], "n": [], "hit": []}), {}
    by = {space: (part["node"].to_numpy(), part["comp"].to_numpy(), _unit(part["vec"])) for space, part in pd.concat(parts).groupby("space")}

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows_ in batches:
            for space, part in rows_.groupby("space"):
                if space not in by:
                    continue
                q, comp, x = by[space]
                for k in range(0, len(part), 1000):
                    some = part.iloc[k : k + 1000]
                    true = (x @ _unit(some["vec"]).T >= THRESHOLD) & (q[:, None] != some["node"].to_numpy())
                    n = true.sum(axis=1)
                    hit = (true & (comp[:, None] == some["comp"].to_numpy())).sum(axis=1) if n.any() else n
                    yield pd.DataFrame({"node": q, "n": n, "hit": hit})[n > 0]

    counted = vecs.join(placed, "node").select("node", "space", "vec", "comp").mapInPandas(meet, "node long, n long, hit long")
    return counted.groupBy("node").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit")).toPandas(), weight  # as many as were asked at most


def count_links(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """(node, links): copies of other nodes over the threshold in a node's component, compared block by block."""
    inside = nodes.select("node", "vec", "copies").join(comps.select(F.col("id").alias("node"), "component_id"), "node")
    sizes = comps.groupBy("component_id").agg(F.count("*").alias("c"))
    parts = F.ceil(F.col("c") / COUNTED).cast("int")
    placed = inside.join(sizes, "component_id").withColumn("k", parts).withColumn("b", F.pmod(F.xxhash64("node", F.lit(8)), F.col("k")).cast("int"))
    # block b meets each other block once: as the first of the pair or as the second
    meets = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j")))
    dealt = placed.select("component_id", "node", "vec", "copies", "b", F.explode(meets).alias("m"))
    # small components share a group, so that there are not as many groups as components
    shared = F.when(F.col("m.j") == 0, F.pmod(F.xxhash64("component_id"), F.lit(8 * common.shuffle_parts(nodes.sparkSession)))).otherwise(F.col("component_id"))
    dealt = dealt.select(shared.alias("g"), F.col("m.i").alias("i"), F.col("m.j").alias("j"), "component_id", "node", "vec", "copies", "b")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in rows.groupby("component_id"):
            i, j = part["i"].iloc[0], part["j"].iloc[0]
            x, n = _unit(part["vec"]), part["copies"].to_numpy()
            of = part["b"].to_numpy()
            left, right = np.flatnonzero(of == i), np.flatnonzero(of == j)
            node = part["node"].to_numpy()
            there = np.zeros(len(right), np.int64)
            for low in range(0, len(left), HELD):
                some = left[low : low + HELD]
                hit = x[some] @ x[right].T >= THRESHOLD
                if i == j:
                    hit &= some[:, None] != right
                out.append(pd.DataFrame({"node": node[some], "links": hit @ n[right]}))
                there += hit.T @ n[some]
            if i != j:
                out.append(pd.DataFrame({"node": node[right], "links": there}))
        return pd.concat(out) if out else pd.DataFrame({"node": [], "links": []}).astype("int64")

    counted = dealt.groupBy("g", "i", "j").applyInPandas(compare, "node long, links long")
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, label, embedding)."""
    spark = vectors.sparkSession
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    source = vectors.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("embedding"), "label")
    nodes = common.cut(nodes_of(source), "nn-nodes")
    spaces = common.cut(spaces_of(nodes), "nn-spaces")
    graph = comps = small = None

    def joined_with(pairs: DataFrame) -> DataFrame:
        """Components of all links so far and of ``pairs`` (a, b)."""
        if comps is not None:
            pairs = pairs.unionByName(comps.select(F.col("id").alias("a"), F.col("component_id").alias("b")))
        return common.cut(common.components(pairs, "nn-components"), "nn-components")

    def listed(new: DataFrame) -> DataFrame:
        new = new.select("u", "v", "sim").withColumn("new", F.lit(True))
        return common.cut(best_of(new if graph is None else graph.drop("r").withColumn("new", F.lit(False)).unionByName(new)), "nn-graph")

    largest = spaces.agg(F.max("n")).first()[0] or 0
    tables = TABLES if _bits(largest) else 1
    done = 0
    waiting = None  # candidates that no list has taken up yet
    while True:
        near = linked = None
        for low in range(done, done + tables, AT_ONCE):
            found = common.cut(start(nodes, spaces, low, min(done + tables, low + AT_ONCE)), "nn-found")
            edges, pairs = found.where(F.col("sim") < JOINED), found.where(F.col("sim") == JOINED).select(F.col("u").alias("a"), F.col("v").alias("b"))
            near = edges if near is None else near.unionByName(edges)
            linked = pairs if linked is None else linked.unionByName(pairs)
            common.release(spark)
        done += tables
        if not _bits(largest):  # every pair has met
            comps = joined_with(linked)
            break
        graph = listed(near if waiting is None else near.unionByName(waiting))
        # who is joined to one node, in a block or a component, need not meet; what else is one component shows at the end of the pass
        roots = linked if comps is None else linked.unionByName(comps.select(F.col("id").alias("a"), F.col("component_id").alias("b")))
        roots = common.cut(roots.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component_id")), "nn-roots")
        small = common.cut(bytes_of(nodes), "nn-bytes") if small is None else small
        across = linked
        for k in range(DESCENTS):
            met = common.cut(descend(small, graph, roots), "nn-met")
            across = across.unionByName(exact(nodes, met.where(F.col("sim") >= THRESHOLD - MARGIN)))
            waiting = met.select("u", "v", "sim").unionByName(met.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim"))
            common.release(spark)
            if k + 1 < DESCENTS:
                graph, waiting = listed(waiting), None
                if (graph.agg(F.mean(F.col("new").cast("int"))).first()[0] or 0) <= 0.01:
                    break
        comps = joined_with(across)
        recall = audit(nodes, comps)
        # no link seen among many nodes, after a second pass as well: there are too few to ask for
        if recall is not None and recall >= RECALL or recall is None and done > TABLES:
            break
        tables = done
    links = count_links(nodes, comps)
    least = comps.join(nodes.select(F.col("node").alias("id"), "least"), "id").groupBy("component_id").agg(F.min("least").alias("root"))
    root = comps.join(least, "component_id").select(F.col("id").alias("node"), "root")
    known = nodes.select("node", "copies", "least").join(root, "node", "left").join(links, "node", "left")
    known = known.select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("root", "least").alias("root"))
    rows = source.select("vec_id", F.xxhash64(F.struct("label", F.size("embedding").alias("n")), _plain(source)).alias("node"))
    joined = rows.join(known, "node", "left")
    component = F.coalesce("root", "vec_id")
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "embeddings"))

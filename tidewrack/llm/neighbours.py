"""Approximate nearest neighbours by NN-descent and greedy graph search.

Nearness is the inner product. Vectors are brought to one length by an extra component (and divided by the
largest length), after which a larger inner product is a smaller angle, so a graph of near neighbours serves
inner products of vectors of any lengths. The graph works on eight-bit codes of these vectors; what a search
returns is scored again in double precision on the vectors themselves.

Building: random hyperplanes cut the vectors into blocks, several times, and each block's nearest start the
lists. Blocks lie in order along one more direction and are dealt by ranges of it, so that a block of many near
vectors is split over tasks; a large one is compared in overlapping windows of that order. Then rounds of joins: each
node brings its neighbours and a sample of the nodes that name it together, and every pair of them of which one
is new is offered to both. The sample is those least by a hash; each task keeps no more of a node's than the sample
takes, so a node that very many name stays small. Lists keep the ``k`` nearest.

Searching: a query starts at an entry of the graph, itself if it is one of the rows; each hop joins the best
nodes that aren't expanded yet with their lists, and what is new with the codes, and keeps the best ``width``. A
search ends when all of its best ``settled`` nodes are expanded, after as many hops as that takes.

Equal vectors are one node, which stands for the smallest ``k_results`` + 1 of their ids, so a group of copies
costs one node; its result lists the ids in order. Vectors that are null, zero, of another length than most (of the
smaller one, if two are as frequent) or hold a null or a number that isn't finite take no part. An empty table gives an empty result.

All steps between joins are mapInArrow over sorted partitions that hold one chunk of rows at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions.arrow import bound_batches
from tidewrack.llm.wordhash import mixed
from tidewrack.plans.lineage import cut, release

#: Rows that a task works on together, about: of lists, each has some dozens of entries, and every two may be offered.
CHUNK = 5_000


def usable(vec: Column) -> Column:
    """Neither null nor zero, and all components finite numbers."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(ok & F.exists(vec, lambda x: x != 0), F.lit(False))


def _keyed(key: str, handle: Callable, overlap: int | None = None) -> Callable:
    """A mapInArrow function: ``handle`` gets the columns of whole runs of equal keys, in chunks of about CHUNK rows.

    The partition must be sorted by the key. A key's rows are bounded by what was dealt to it before, or, with
    ``overlap``, come in chunks of which each starts with so many of the last rows of the one before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows < CHUNK:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            keys = t.column(key).to_numpy()
            end = int(np.searchsorted(keys, keys[-1], "left"))
            if end:
                yield from handle(t.slice(0, end))
            elif overlap is not None:
                yield from handle(t)
                end = t.num_rows - overlap
            held, rows = t.slice(end).to_batches(), t.num_rows - end
        if held:
            yield from handle(pa.Table.from_batches(held).combine_chunks())

    return run


def _matrix(column: pa.ChunkedArray, kind: str, width: int) -> np.ndarray:
    """Equal-sized binaries as rows."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(c, pa.ChunkedArray):
        c = pa.concat_arrays(c.chunks)
    offsets = np.frombuffer(c.buffers()[1], "<i4")[c.offset : c.offset + len(c) + 1]
    raw = np.frombuffer(c.buffers()[2], "u1")[offsets[0] : offsets[-1]]
    return raw.view(kind).reshape(len(c), width)


def _joined(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(all values of the binaries, how many each has)."""
    c = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(c.buffers()[1], "<i4")[c.offset : c.offset + len(c) + 1]
    raw = np.frombuffer(c.buffers()[2] or b"", "u1")[offsets[0] : offsets[-1]].view(kind)
    return raw, np.diff(offsets) // np.dtype(kind).itemsize


def _runs(keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal keys."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def _drawn(owner: np.ndarray, member: np.ndarray, seed: int, most: int) -> np.ndarray:
    """Places of the ``most`` members of each owner that are least by a hash of the two."""
    salt = mixed(np.array([seed], np.uint64))
    h = mixed(mixed(member.astype("i8").view("u8") ^ salt) + owner.astype("i8").view("u8"))
    order = np.lexsort((h, owner))
    sorted_ = owner[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_, sorted_, "left") < most]


NEIGHBOUR = np.dtype([("id", "<i8"), ("sim", "<f4"), ("new", "u1")])


def _top(owner: np.ndarray, got: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest distinct ids of each owner, ties to the smaller id; of equal ids the one not new stays."""
    order = np.lexsort((got["new"], got["id"], -got["sim"], owner))
    owner, got = owner[order], got[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (got["id"][1:] != got["id"][:-1])
    owner, got = owner[keep], got[keep]
    first = np.searchsorted(owner, owner, "left")
    keep = np.arange(len(owner)) - first < k
    return owner[keep], got[keep]


def _lists(owner: np.ndarray, got: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """(owner, binary of its entries) with owners sorted."""
    bounds = _runs(owner) if len(owner) else np.zeros(1, np.int64)
    raw = got.tobytes()
    offsets = pa.py_buffer((bounds * got.dtype.itemsize).astype("<i4").tobytes())
    lists = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(raw)])
    return pa.record_batch([pa.array(owner[bounds[:-1]], pa.int64()), lists], names)


class NeighbourIndex:
    """The graph of ``vectors`` (vec_id, vec array<double>), a node for each distinct usable vector."""

    def __init__(self, vectors: DataFrame, k: int = 48, reverse: int = 24, trees: int = 10, leaf: int = 512, rounds: int = 3, copies: int = 21, seed: int = 1):
        self.spark = vectors.sparkSession
        bound_batches(self.spark)
        self.k, self.reverse, self.trees, self.leaf, self.rounds, self.seed = k, reverse, trees, leaf, rounds, seed
        rows = vectors.where(usable(F.col("vec")) & F.col("vec_id").isNotNull()).select("vec_id", "vec")
        rank = Window.partitionBy("vec").orderBy("vec_id")
        named = rows.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= copies)
        nodes = named.groupBy("vec").agg(F.min("vec_id").alias("id"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
        self.nodes = cut(nodes.select("id", "vec", "ids"))
        norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
        size = self.nodes.agg(F.max(norm).alias("m"), F.count("*").alias("n"), F.mode(F.size("vec"), deterministic=True).alias("d")).first()
        self.n, self.largest, self.dims = size.n, size.m or 1.0, (size.d or 0)
        self.codes = cut(self.nodes.where(F.size("vec") == self.dims).select("id", self._code()("vec").alias("code")))
        self.graph = self._built()

    def _code(self) -> Callable:
        """Codes: the vector over the largest length, and the component that makes its length one."""
        largest = float(self.largest)

        @F.pandas_udf("binary")
        def code(vecs):
            import pandas as pd

            x = np.stack(vecs.to_numpy()) / largest
            x = np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]], axis=1)
            scale = np.abs(x).max(axis=1) / 127
            c = np.round(x / scale[:, None]).astype("i1")
            return pd.Series([s.tobytes() + r.tobytes() for s, r in zip(scale.astype("<f4"), c)])

        return code

    @property
    def width(self) -> int:
        return 4 + self.dims + 1

    def _parts(self, rows: int) -> int:
        """Partitions for so many rows of codes."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), rows // 400_000)

    # building

    def _built(self) -> DataFrame:
        if not self.n:
            return self.spark.createDataFrame([], "id long, list binary")
        graph = cut(self._merged(self._blocks(), None))
        for i in range(self.rounds):
            graph = cut(self._merged(self._offers(graph, i), graph), graph)
            release(self.spark)
        return graph

    def _merged(self, offers: DataFrame, graph: DataFrame | None) -> DataFrame:
        """(id, list) with the nearest ``k`` of old lists and offers; entries of offers are new."""
        k = self.k

        def merge(t: pa.Table) -> Iterator[pa.RecordBatch]:
            got, n = _joined(t.column("list"), "u1")
            entries = got.view(NEIGHBOUR)
            owner = np.repeat(t.column("id").to_numpy(), n // NEIGHBOUR.itemsize)
            yield _lists(*_top(owner, entries, k), ["id", "list"])

        rows = offers
        if graph is not None:
            old = graph.mapInArrow(_aged, "id long, list binary")
            rows = offers.union(old)
        rows = rows.repartition(self._parts(self.n * 8), "id").sortWithinPartitions("id")
        return rows.mapInArrow(_keyed("id", merge), "id long, list binary")

    def _blocks(self) -> DataFrame:
        """Each tree's blocks, and in each block every node's nearest."""
        levels = max(0, int(np.ceil(np.log2(max(1, self.n) / self.leaf))))
        rng = np.random.default_rng(self.seed)
        planes = self.spark.sparkContext.broadcast(rng.standard_normal((self.trees, self.dims + 1, levels + 1)).astype("f4"))
        width, k, leaf, trees = self.width, max(8, self.k // 2), self.leaf, self.trees

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = _matrix(b.column(1), "i1", width)[:, 4:].astype("f4")
                for t in range(trees):
                    y = x @ planes.value[t]
                    block = (y[:, :levels] > 0) @ (1 << np.arange(levels, dtype=np.int64)) + (t << 48)
                    yield pa.record_batch([pa.array(block.astype(np.int64)), pa.array(y[:, levels]), b.column(0), b.column(1)], ["block", "along", "id", "code"])

        def nearest(t: pa.Table) -> Iterator[pa.RecordBatch]:
            keys, ids = t.column("block").to_numpy(), t.column("id").to_numpy()
            x = _vectors(t.column("code"), width)
            bounds = _runs(keys)
            for a, b in zip(bounds[:-1], bounds[1:]):
                whole = b - a <= 4 * leaf
                for at in range(a, b, b - a if whole else leaf):  # a large block is compared in windows
                    s = slice(at, b if whole else min(b, at + 2 * leaf))
                    own, v = ids[s], x[s]
                    if len(own) < 2:
                        continue
                    sim = _nearness(v)
                    np.fill_diagonal(sim, -9)
                    top = min(k, len(own) - 1)
                    j = np.argpartition(-sim, top - 1, axis=1)[:, :top]
                    got = np.zeros(len(own) * top, NEIGHBOUR)
                    got["id"], got["sim"], got["new"] = own[j].ravel(), np.take_along_axis(sim, j, 1).ravel(), 1
                    yield _lists(np.repeat(own, top), got, ["id", "list"])

        parts = self._parts(self.n * self.trees)
        rows = self.codes.mapInArrow(dealt, "block long, along float, id long, code binary")
        rows = rows.repartitionByRange(parts, "block", "along").sortWithinPartitions("block", "along")
        return rows.select("block", "id", "code").mapInArrow(_keyed("block", nearest, overlap=leaf), "id long, list binary")

    def _offers(self, graph: DataFrame, round_: int) -> DataFrame:
        """Join of neighbours of neighbours: pairs of which one is new, offered to those whose list they improve."""
        width, k, most = self.width, self.k, self.reverse
        seed = self.seed + 17 * round_

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """(centre, member, new) of the lists and, a sample for each centre, of those that name it."""

            def rows(centre, member, new, back):
                return pa.record_batch([pa.array(centre), pa.array(member), pa.array(new.astype(bool)), pa.array(np.full(len(centre), back))], ["centre", "member", "new", "back"])

            held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "u1")]
            for b in batches:
                raw, n = _joined(b.column(1), "u1")
                got = raw.view(NEIGHBOUR)
                owner = np.repeat(b.column(0).to_numpy(), n // NEIGHBOUR.itemsize)
                yield rows(owner, got["id"], got["new"], False)
                held = [np.concatenate(x) for x in zip(held, (got["id"], owner, got["new"]))]
                if len(held[0]) > 100 * CHUNK:
                    kept = _drawn(held[0], held[1], seed, most)
                    held = [x[kept] for x in held]
            kept = _drawn(held[0], held[1], seed, most)
            for at in range(0, len(kept), CHUNK):
                yield rows(*(x[kept[at : at + CHUNK]] for x in held), True)

        def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """(id, the similarity that an offer must beat)."""
            for b in batches:
                raw, n = _joined(b.column(1), "u1")
                got, n = raw.view(NEIGHBOUR), n // NEIGHBOUR.itemsize
                last = got["sim"][np.cumsum(n) - 1]
                yield pa.record_batch([b.column(0), pa.array(np.where(n < k, -9, last).astype("f4"))], ["id", "bar"])

        def offered(t: pa.Table) -> Iterator[pa.RecordBatch]:
            centre, ids, new = t.column("centre").to_numpy(), t.column("member").to_numpy(), t.column("new").to_numpy()
            back, bar, x = t.column("back").to_numpy(), t.column("bar").to_numpy(), _vectors(t.column("code"), width)
            own, others = np.flatnonzero(~back), np.flatnonzero(back)
            order = np.concatenate([own, others[_drawn(centre[others], ids[others], seed, most)]])
            order = order[np.argsort(centre[order], kind="stable")]
            centre, ids, new, bar, x = centre[order], ids[order], new[order], bar[order], x[order]
            owners, got = [], []
            bounds = _runs(centre)
            for a, b in zip(bounds[:-1], bounds[1:]):
                f = new[a:b]
                if not f.any():
                    continue
                sim = _nearness(x[a:b])
                i, j = np.nonzero((sim > bar[a:b, None]) & (f[:, None] | f[None, :]))
                i, j = i[ids[a + i] != ids[a + j]], j[ids[a + i] != ids[a + j]]
                e = np.zeros(len(i), NEIGHBOUR)
                e["id"], e["sim"], e["new"] = ids[a + j], sim[i, j], 1
                owners.append(ids[a + i])
                got.append(e)
            if owners:
                yield _lists(*_top(np.concatenate(owners), np.concatenate(got), k), ["id", "list"])

        pairs = graph.mapInArrow(named, "centre long, member long, new boolean, back boolean")
        bars = graph.mapInArrow(least, "id long, bar float")
        attached = self.codes.join(bars, "id").withColumnRenamed("id", "member")
        rows = pairs.join(attached, "member").select("centre", "member", "new", "back", "bar", "code")
        rows = rows.repartition(self._parts(self.n * (k + most)), "centre").sortWithinPartitions("centre")
        return rows.mapInArrow(_keyed("centre", offered), "id long, list binary")

    # searching

    def search(self, queries: DataFrame, results: int = 20, width: int = 128, expand: int = 48, settled: int = 48) -> DataFrame:
        """(query_id, rank, vec_id, score): the nearest rows found for rows of the index, all but the query's own.

        ``queries`` has query_id, the vec_id of an indexed row. The best ``width`` nodes are kept in each hop and
        the best ``expand`` of those not expanded yet are expanded, until the best ``settled`` all are.
        """
        out = "query_id long, rank int, vec_id long, score double"
        if not self.n:
            return self.spark.createDataFrame([], out)
        members = self.nodes.select("id", F.explode("ids").alias("vec_id"))
        entry = cut(self._entries(queries, members))
        state, entries = self._first(entry)
        ended: list[DataFrame] = []
        while True:
            state = cut(self._hop(state, width, expand, settled, None if ended else entries))
            release(self.spark)
            ended.append(state.where("not open"))
            state = state.where("open")
            if state.isEmpty():
                return self._scored(reduce(DataFrame.union, ended), entry, results)

    def _entries(self, queries: DataFrame, members: DataFrame) -> DataFrame:
        """(query_id, node) by the query's vector: also of copies that the node doesn't list."""
        by_vec = queries.where(usable(F.col("vec")) & F.col("query_id").isNotNull()).select("query_id", "vec").join(
            self.nodes.select("id", "vec"), "vec"
        )
        return by_vec.select("query_id", F.col("id").alias("node")).distinct()

    #: Nodes of the longest vectors, where every search also starts: large inner products are mostly theirs.
    ENTRIES = 16
    STATE = "node long, query_code binary, kept binary, seen binary, open boolean"

    def _first(self, entry: DataFrame) -> tuple[DataFrame, np.ndarray]:
        """One search for each distinct query vector: (node, query_code, kept, seen), itself kept, not expanded.

        A query's code has its own scale and an extra component of zero, so its similarity to a code orders as the
        inner product does.
        """
        long = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
        longest = np.array([r.id for r in self.nodes.orderBy(long.desc(), "id").limit(self.ENTRIES).collect()], np.int64)

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cols = []
                for i, vec in zip(b.column(0).to_pylist(), b.column(1)):
                    q = vec.values.to_numpy()
                    scale = np.abs(q).max() / 127
                    code = np.float32(1 / 127).tobytes() + np.round(q / scale).astype("i1").tobytes() + b"\0"
                    first = np.concatenate([[i], longest[longest != i]])
                    e = np.zeros(len(first), NEIGHBOUR)
                    e["id"], e["sim"], e["new"] = first, 1e30, 1
                    cols.append((i, code, e.tobytes(), first.astype("<i8").tobytes()))
                cols = list(zip(*cols)) if cols else [[]] * 4
                yield pa.record_batch([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:]), pa.array([True] * len(cols[0]))], ["node", "query_code", "kept", "seen", "open"])

        nodes = entry.select("node").distinct()
        rows = nodes.join(self.nodes, nodes.node == self.nodes.id).where(F.size("vec") == self.dims).select("node", "vec")
        return rows.mapInArrow(start, self.STATE), longest

    def _hop(self, state: DataFrame, width: int, expand: int, settled: int, entries: np.ndarray | None) -> DataFrame:
        size, first = self.width, entries is not None

        def frontier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """(node, at): what each search expands now."""
            for b in batches:
                nodes, ats = [], []
                for node, kept in zip(b.column(0).to_pylist(), b.column(1)):
                    e = np.frombuffer(kept.as_buffer(), NEIGHBOUR)
                    at = e["id"][np.flatnonzero(e["new"])[:expand]]
                    nodes.append(np.full(len(at), node))
                    ats.append(at)
                cat = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]))
                yield pa.record_batch([cat(nodes), cat(ats)], ["node", "at"])

        def fresh(t: pa.Table) -> Iterator[pa.RecordBatch]:
            """(node, candidate) that the search hasn't met."""
            node = t.column("node").to_numpy()
            bounds = _runs(node)
            lists, seen = t.column("list").combine_chunks(), t.column("seen").combine_chunks()
            lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
            seen = pa.concat_arrays(seen.chunks) if isinstance(seen, pa.ChunkedArray) else seen
            nodes, found = [], []
            for a, b in zip(bounds[:-1], bounds[1:]):
                got = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), NEIGHBOUR)["id"] for x in lists[a:b] if x.is_valid] or [np.zeros(0, np.int64)]))
                old = [np.frombuffer(x.as_buffer(), "<i8") for x in seen[a:b] if x.is_valid]
                got = np.union1d(got, np.append(entries, node[a])) if first else np.setdiff1d(got, np.concatenate(old or [np.zeros(0, np.int64)]))
                nodes.append(np.full(len(got), node[a]))
                found.append(got)
            cat = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]))
            yield pa.record_batch([cat(nodes), cat(found)], ["node", "candidate"])

        def kept(t: pa.Table) -> Iterator[pa.RecordBatch]:
            """The search's state with the candidates."""
            node, ids = t.column("node").to_numpy(), t.column("candidate")
            is_state = t.column("kept").is_valid().to_numpy(zero_copy_only=False)
            ids = ids.to_numpy(zero_copy_only=False)
            codes, qs, olds, seens = (t.column(c).combine_chunks() for c in ("code", "query_code", "kept", "seen"))
            pick = lambda c: pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c
            codes, qs, olds, seens = map(pick, (codes, qs, olds, seens))
            bounds = _runs(node)
            out = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                s = a + int(np.flatnonzero(is_state[a:b])[0])
                rows = a + np.flatnonzero(~is_state[a:b])
                old = np.frombuffer(olds[s].as_buffer(), NEIGHBOUR).copy()
                old["new"][np.flatnonzero(old["new"])[:expand]] = 0
                old = old[old["sim"] < 1e30]  # what the search starts from is offered again, with its similarity
                q = _vectors(qs.slice(s, 1), size)[0]
                e = np.zeros(len(rows), NEIGHBOUR)
                if len(rows):
                    e["id"] = ids[rows].astype(np.int64)
                    e["sim"], e["new"] = _vectors(codes.take(pa.array(rows)), size) @ q, 1
                every = np.concatenate([old, e])
                best = every[np.lexsort((every["id"], -every["sim"]))[:width]]
                seen = np.concatenate([np.frombuffer(seens[s].as_buffer(), "<i8"), e["id"]])
                goes_on = bool(best["new"][:settled].any())
                out.append((node[a], qs[s].as_py(), best.tobytes(), seen.tobytes() if goes_on else b"", goes_on))
            cols = list(zip(*out))
            yield pa.record_batch([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:4]), pa.array(cols[4], pa.bool_())], ["node", "query_code", "kept", "seen", "open"])

        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        at = state.select("node", "kept").mapInArrow(frontier, "node long, at long")
        lists = at.join(self.graph, at.at == self.graph.id).select("node", "list", F.lit(None).cast("binary").alias("seen"))
        lists = lists.union(state.select("node", F.lit(None).cast("binary"), "seen")).repartition(parts, "node").sortWithinPartitions("node")
        new = lists.mapInArrow(_keyed("node", fresh), "node long, candidate long")
        void = F.lit(None).cast("binary")
        rows = new.join(self.codes, new.candidate == self.codes.id).select("node", "candidate", "code", void.alias("query_code"), void.alias("kept"), void.alias("seen"))
        rows = rows.union(state.select("node", F.lit(None).cast("long"), void, "query_code", "kept", "seen"))
        rows = rows.repartition(self._parts(self.n * 8), "node").sortWithinPartitions("node")
        return rows.mapInArrow(_keyed("node", kept), self.STATE)

    def _scored(self, state: DataFrame, entry: DataFrame, results: int) -> DataFrame:
        """The kept nodes' members, scored in double precision on the vectors."""
        margin = 2 * results + 8

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                nodes, found = [], []
                for node, kept in zip(b.column(0).to_pylist(), b.column(1)):
                    e = np.frombuffer(kept.as_buffer(), NEIGHBOUR)["id"][:margin]
                    nodes.append(np.full(len(e), node))
                    found.append(e)
                cat = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]))
                yield pa.record_batch([cat(nodes), cat(found)], ["node", "found"])

        pairs = state.select("node", "kept").mapInArrow(best, "node long, found long")
        q = self.nodes.select(F.col("id").alias("node"), F.col("vec").alias("q"))
        c = self.nodes.select(F.col("id").alias("found"), F.col("vec").alias("c"), "ids")
        score = F.aggregate(F.zip_with("q", "c", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        near = pairs.join(c, "found").join(q, "node").select("node", score.alias("score"), "ids")
        per_node = near.groupBy("node").agg(F.collect_list(F.struct("score", "ids")).alias("near"))  # at most ``margin`` entries
        flat = F.flatten(F.transform("near", lambda s: F.transform(s["ids"], lambda i: F.struct((-s["score"]).alias("s"), i.alias("i")))))
        rows = entry.join(per_node, "node").select("query_id", flat.alias("all"))
        own = F.slice(F.array_sort(F.filter("all", lambda x: x["i"] != F.col("query_id"))), 1, results)
        rows = rows.select("query_id", F.posexplode(own).alias("p", "x"))
        return rows.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))


def _vectors(column, width: int) -> np.ndarray:
    """Decoded codes as rows of 32-bit floats."""
    raw = _matrix(column, "u1", width)
    return raw[:, 4:].view("i1").astype("f4") * raw[:, :4].copy().view("<f4")


def _nearness(v: np.ndarray) -> np.ndarray:
    """Minus half the squared distance of every two rows: among near copies codes differ in length by more than that."""
    half = (v * v).sum(1) / 2
    return v @ v.T - half[:, None] - half[None, :]


def _aged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists with no entry new."""
    for b in batches:
        raw, _ = _joined(b.column(1), "u1")
        got = raw.copy().view(NEIGHBOUR)
        got["new"] = 0
        c = b.column(1)
        offsets = np.frombuffer(c.buffers()[1], "<i4")[c.offset : c.offset + len(c) + 1]
        lists = pa.Array.from_buffers(pa.binary(), len(c), [None, pa.py_buffer((offsets - offsets[0]).astype("<i4").tobytes()), pa.py_buffer(got.tobytes())])
        yield pa.record_batch([b.column(0), lists], ["id", "list"])


def nearest_neighbours(embeddings: DataFrame, every: int = 20, results: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose vec_id ``every`` divides, against all other rows."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    index = NeighbourIndex(rows, copies=results + 1)
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vec").dropDuplicates(["query_id", "vec"])
    return index.search(queries, results)

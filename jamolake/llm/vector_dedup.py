"""Near-duplicate vectors by hierarchical navigable small-world graphs.

Equal vectors are one point. Points are dealt to shards, each shard builds a graph, and every
shard is asked for every block of points: beams widen until all they hold are hits no longer, and
until two audits find no less than the recall asked for. One asks every shard with queries planted at
cosines from the threshold to 1 around points of its own, so that there is something to find however few
links a table has. The other holds drawn points against brute force in all shards; it counts no
point's hit on itself, averages over points that have other hits, and draws more while it has tested few. Cosines are verified in double precision, and a task returns counts
and a spanning forest of its links, so that a group of thousands of copies does not become millions
of pairs.

Queries travel to graphs: a task opens the graph of one shard once and streams the blocks that ask
it. Of two points of a shard the one with the lesser number asks, of two shards one asks the other, so a link is
decided once and counts for both. Shards have a fixed size, so what a task holds does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import pack, unpack
from ._common import Scratch, table
from ._components import components

#: Points of a shard, about (a worker holds a shard's graph and, twice, its vectors in doubles), shards at least, points
#: of a block that asks.
SHARD_POINTS, LEAST_SHARDS, ASK = 25_000, 4, 2048
DEGREE, BUILD_BEAM, FIRST_BEAM, RECALL = 16, 48, 24, 0.99
#: Points that the audit against brute force draws at first, and points with hits besides themselves that
#: it wants to test: it draws four times as many until it has, has drawn all, or has drawn MOST_AUDIT.
AUDIT, TESTED, MOST_AUDIT = 1024, 256, 16_384
#: Queries planted in all shards together (one in each at least).
PLANTED = 4096
#: A beam wider than this share of a shard costs more than looking at every point, which is exact.
WIDEST = 1 / 16
EVERY = 2**30  # a beam that no shard allows
NEAR = 1e-5  # single precision finds candidates this far below the threshold
#: Numbers of one array that are worked on at once: larger steps are cut into rows that need no more.
ROOM = 1 << 22


def _slices(n: int, each: int) -> Iterator[slice]:
    """Rows 0 to n in slices, with `each` numbers a row."""
    step = max(1, ROOM // max(1, each))
    return (slice(a, a + step) for a in range(0, n, step))


def _search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int, threshold: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of one layer for many queries at once: (nodes, similarities), best first, -1
    where a beam is not full. Ends when every beam's members have been expanded."""
    q, n = len(queries), len(vectors)
    ids = np.full((q, beam), -1, dtype=np.int64)
    sims = np.full((q, beam), -np.inf, dtype=np.float32)
    first = np.einsum("qd,qd->q", queries, vectors[entry])
    ids[:, 0], sims[:, 0] = entry, first
    expanded = np.zeros((q, beam), dtype=bool)
    seen = np.zeros((q, n), dtype=bool)
    seen[np.arange(q), entry] = True
    width = 4  # members of a beam expanded in a step
    while True:
        open_ = np.where((ids >= 0) & ~expanded, sims, -np.inf)
        pick = np.argpartition(-open_, min(width, beam) - 1, axis=1)[:, :width]
        live = np.take_along_axis(open_, pick, axis=1) > -np.inf
        rows, cols = np.nonzero(live)
        if not len(rows):
            return ids, sims
        slots = pick[rows, cols]
        expanded[rows, slots] = True
        near = links[ids[rows, slots]]
        r = np.repeat(rows, near.shape[1])
        c = near.ravel()
        ok = c >= 0
        r, c = r[ok], c[ok]
        new = ~seen[r, c]
        r, c = r[new], c[new]
        if not len(r):
            continue
        pair = np.unique(r * n + c)
        r, c = pair // n, pair % n
        seen[r, c] = True
        s = np.einsum("kd,kd->k", queries[r], vectors[c])
        better = s > sims[r, -1]
        r, c, s = r[better], c[better], s[better]
        if not len(r):
            continue
        touched, at = np.unique(r, return_inverse=True)
        start = np.searchsorted(r, touched)
        place = np.arange(len(r)) - start[at]
        most = int(place.max()) + 1
        more_ids = np.full((len(touched), most), -1, dtype=np.int64)
        more_sims = np.full((len(touched), most), -np.inf, dtype=np.float32)
        more_ids[at, place], more_sims[at, place] = c, s
        all_ids = np.concatenate([ids[touched], more_ids], axis=1)
        all_sims = np.concatenate([sims[touched], more_sims], axis=1)
        all_exp = np.concatenate([expanded[touched], np.zeros_like(more_ids, dtype=bool)], axis=1)
        best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[touched] = np.take_along_axis(all_ids, best, axis=1)
        sims[touched] = np.take_along_axis(all_sims, best, axis=1)
        expanded[touched] = np.take_along_axis(all_exp, best, axis=1)


def _spread(vectors: np.ndarray, base: np.ndarray, cand: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates (best first) those nearer to the row's base than to any chosen
    one, then the best of the rest, up to degree."""
    q, k = cand.shape
    chosen = np.full((q, degree), -1, dtype=np.int64)
    count = np.zeros(q, dtype=np.int64)
    taken = np.zeros((q, k), dtype=bool)
    rows = np.arange(q)
    for j in range(k):
        c = cand[:, j]
        ok = (c >= 0) & (count < degree)
        kept = chosen[ok]
        if not len(kept):
            continue
        between = np.einsum("qkd,qd->qk", vectors[np.maximum(kept, 0)], vectors[c[ok]])
        between[kept < 0] = -np.inf
        good = rows[ok][between.max(axis=1) < sims[ok, j]]
        chosen[good, count[good]] = c[good]
        taken[good, j] = True
        count[good] += 1
    for j in range(k):
        ok = (cand[:, j] >= 0) & ~taken[:, j] & (count < degree)
        chosen[rows[ok], count[ok]] = cand[ok, j]
        count[ok] += 1
    return chosen


class Graph:
    """A small-world graph over unit vectors, layer upon layer of ever fewer nodes. Nodes join in
    batches no larger than what stands already."""

    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors, self.layers = vectors, layers  # lowest first: (node numbers, links between their places)
        self.stray = self._unreached()

    def _unreached(self) -> np.ndarray:
        """Nodes of the lowest layer to which no path leads from the nodes of the next: every
        query looks at them besides."""
        links = self.layers[0][1]
        reached = np.zeros(len(links), dtype=bool)
        new = self.layers[1][0] if len(self.layers) > 1 else np.arange(min(1, len(links)))
        while len(new):
            reached[new] = True
            near = np.unique(links[new])
            near = near[near >= 0]
            new = near[~reached[near]]
        return np.flatnonzero(~reached)

    @classmethod
    def build(cls, vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM) -> Graph:
        n = len(vectors)
        layers, nodes = [], np.arange(n)
        # a node's height comes from its place in a fixed shuffle, one in `degree` a layer
        shuffled = np.random.default_rng(7).permutation(n)
        while True:
            layers.append((nodes, cls._layer(vectors[nodes], degree * 2 if not layers else degree, beam)))
            if len(nodes) <= degree * 4:
                return cls(vectors, layers)
            nodes = np.sort(shuffled[: len(nodes) // degree])

    @staticmethod
    def _layer(v: np.ndarray, degree: int, beam: int) -> np.ndarray:
        n = len(v)
        links = np.full((n, degree), -1, dtype=np.int64)
        done = min(n, 256)
        sims = v[:done] @ v[:done].T
        np.fill_diagonal(sims, -np.inf)
        order = np.argsort(-sims, axis=1)[:, : min(beam, max(done - 1, 0))]
        if done > 1:
            links[:done] = _spread(v, np.arange(done), order, np.take_along_axis(sims, order, axis=1), degree)
        rng = np.random.default_rng(11)
        while done < n:
            to = min(n, done * 2, done + 2048)
            new = np.arange(done, to)
            entries = rng.integers(0, done, size=32)
            best = (v[new] @ v[entries].T).argmax(axis=1)
            parts = [_search(v[:done], links[:done], v[new[at]], entries[best[at]], beam) for at in _slices(len(new), done // 4)]
            found, s = (np.concatenate(p) for p in zip(*parts))
            own = v[new] @ v[new].T
            np.fill_diagonal(own, -np.inf)
            k = min(beam // 2, len(new))
            near = np.argpartition(-own, k - 1, axis=1)[:, :k]
            cand = np.concatenate([found, new[near]], axis=1)
            sim = np.concatenate([s, np.take_along_axis(own, near, axis=1)], axis=1)
            sim = np.where((cand >= 0) & np.isfinite(sim), sim, -np.inf)
            cand = np.where(np.isfinite(sim), cand, -1)
            best = np.argsort(-sim, axis=1, kind="stable")
            cand, sim = np.take_along_axis(cand, best, axis=1), np.take_along_axis(sim, best, axis=1)
            links[new] = _spread(v, new, cand, sim, degree)
            # the other way: nodes that were chosen take the new ones among their neighbours
            src = np.repeat(new, degree)
            dst = links[new].ravel()
            ok = dst >= 0
            src, dst = src[ok], dst[ok]
            order = np.argsort(dst, kind="stable")
            src, dst = src[order], dst[order]
            touched, start, times = np.unique(dst, return_index=True, return_counts=True)
            place = np.arange(len(dst)) - np.repeat(start, times)
            inside = place < 4 * degree
            more = np.full((len(touched), min(int(times.max()), 4 * degree)), -1, dtype=np.int64)
            more[np.repeat(np.arange(len(touched)), times)[inside], place[inside]] = src[inside]
            for at in _slices(len(touched), (degree + more.shape[1]) * v.shape[1]):
                links[touched[at]] = Graph._relinked(v, touched[at], np.concatenate([links[touched[at]], more[at]], axis=1), degree)
            done = to
        return links

    @staticmethod
    def _relinked(v: np.ndarray, touched: np.ndarray, cand: np.ndarray, degree: int) -> np.ndarray:
        """The neighbours that nodes keep of those they have and those that chose them."""
        sim = np.einsum("qkd,qd->qk", v[np.maximum(cand, 0)], v[touched])
        # a neighbour that is there twice counts once
        by = np.sort(cand, axis=1)
        at = np.argsort(cand, axis=1, kind="stable")
        twice = np.zeros_like(cand, dtype=bool)
        np.put_along_axis(twice, at[:, 1:], by[:, 1:] == by[:, :-1], axis=1)
        sim = np.where((cand >= 0) & ~twice, sim, -np.inf)
        best = np.argsort(-sim, axis=1, kind="stable")
        cand, sim = np.take_along_axis(cand, best, axis=1), np.take_along_axis(sim, best, axis=1)
        return _spread(v, touched, np.where(np.isfinite(sim), cand, -1), sim, degree)

    def entry(self, queries: np.ndarray) -> np.ndarray:
        """The place in the lowest layer from which each query starts, by descent."""
        at = None
        for nodes, links in reversed(self.layers[1:]):
            if at is None:
                start = (queries @ self.vectors[nodes].T).argmax(axis=1) if len(nodes) <= 4096 else np.zeros(len(queries), dtype=np.int64)
            else:
                start = np.searchsorted(nodes, at)
            found, _ = _search(self.vectors[nodes], links, queries, start, 8)
            at = nodes[found[:, 0]]
        return at if at is not None else np.zeros(len(queries), dtype=np.int64)

    def within(self, queries: np.ndarray, threshold: float, beam: int) -> list[np.ndarray]:
        """Of each query, nodes at least that similar (in single precision, a little below): a
        beam that ends full of hits is searched again at four times the width."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(queries)
        links = self.layers[0][1]
        todo, entry = np.arange(len(queries)), self.entry(queries)
        while len(todo) and beam <= max(FIRST_BEAM, len(self.vectors) * WIDEST):
            again = []
            step = max(1, (16 << 20) // max(len(self.vectors), 12 * beam))
            for a in range(0, len(todo), step):
                rows = todo[a : a + step]
                ids, sims = _search(self.vectors, links, queries[rows], entry[rows], min(beam, len(self.vectors)))
                hit = (ids >= 0) & (sims >= threshold - NEAR)
                full = hit[:, -1] & (beam < len(self.vectors))
                for r, i, h, f in zip(rows, ids, hit, full):
                    if f:
                        again.append(r)
                    else:
                        out[r] = i[h]
            todo, beam = np.array(again, dtype=np.int64), beam * 4
        for r, hits in zip(todo, self.scan(queries[todo], threshold)):
            out[r] = hits
        if len(self.stray):
            for r, sims in enumerate(queries @ self.vectors[self.stray].T):
                out[r] = np.union1d(out[r], self.stray[sims >= threshold - NEAR])
        return out

    def scan(self, queries: np.ndarray, threshold: float) -> Iterator[np.ndarray]:
        """Like within, by looking at every point."""
        step = max(1, (16 << 20) // max(1, len(self.vectors)))
        for a in range(0, len(queries), step):
            for sims in queries[a : a + step] @ self.vectors.T:
                yield np.flatnonzero(sims >= threshold - NEAR)

    def judged(self, queries: np.ndarray, threshold: float, beam: int, verified: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of each query, how many verified hits there are and how many such a beam finds.
        verified(k, hits) says which of query k's hits are, and leaves out the query itself."""
        true = np.array([len(verified(k, hits)) for k, hits in enumerate(self.scan(queries, threshold))], dtype=np.int64)
        found = np.zeros_like(true)
        some = np.flatnonzero(true)
        for at in _slices(len(some), len(self.vectors)):
            for k, hits in zip(some[at], self.within(queries[some[at]], threshold, beam)):
                found[k] = len(verified(k, hits))
        return true, found

    def planted(self, threshold: float, beam: int, count: int) -> tuple[int, int]:
        """(queries planted, how many of them find the point they were planted by). The cosines between a query
        and its point are spread evenly from the threshold to 1, its direction is any."""
        rng = np.random.default_rng(5)
        own = rng.permutation(len(self.vectors))[:count]
        base = _unit(self.vectors[own].astype(np.float64))
        away = rng.normal(size=base.shape)
        away -= np.einsum("qd,qd->q", away, base)[:, None] * base
        size = np.sqrt((away * away).sum(axis=1, keepdims=True))
        cosine = np.linspace(1, threshold, len(own) + 1)[:-1, None]
        # in one dimension there is nothing to turn to
        queries = np.where(size > 1e-9, cosine * base + np.sqrt(1 - cosine * cosine) * away / np.maximum(size, 1e-9), base)
        found = 0
        for at in _slices(len(own), len(self.vectors)):
            found += sum(int((h == o).any()) for h, o in zip(self.within(queries[at].astype(np.float32), threshold, beam), own[at]))
        return len(own), found

    def audited_beam(self, threshold: float, recall: float = RECALL, audit: int = AUDIT, tested: int = TESTED) -> tuple[int, float]:
        """The audits of a graph asked by its own points alone: (the first beam, of ever wider ones,
        that finds that share of a point's hits on others, on average, and of planted queries; the first share)."""
        n = len(self.vectors)
        order = np.random.default_rng(3).permutation(n)
        beam = FIRST_BEAM
        while True:
            own = order[:audit]
            true, found = self.judged(self.vectors[own], threshold, beam, lambda k, hits: hits[(hits != own[k]) & (self.vectors[hits] @ self.vectors[own[k]] >= threshold)])
            some = true > 0
            share = float((found[some] / true[some]).mean()) if some.any() else 1.0
            if beam > max(FIRST_BEAM, n * WIDEST):  # every point was looked at
                return beam, share
            if some.sum() < tested and audit < min(n, MOST_AUDIT):
                audit *= 4
                continue
            n_planted, hit = self.planted(threshold, beam, PLANTED)
            if share >= recall and hit >= recall * n_planted:
                return beam, share
            else:
                beam *= 2

    def to_bytes(self) -> bytes:
        return pack(self.vectors.ravel(), *(x.astype(np.int32).ravel() for layer in self.layers for x in layer))

    @classmethod
    def from_bytes(cls, data: bytes, dim: int) -> Graph:
        flat = unpack(data)
        layers = [(n.astype(np.int64), l.reshape(len(n), -1).astype(np.int64)) for n, l in zip(flat[1::2], flat[2::2])]
        return cls(flat[0].reshape(-1, dim), layers)


def _unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def _raw(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, dim)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles; null for those that link with nothing."""
    for b in batches:
        out = []
        for v in b.column("embedding").to_pylist():
            a = np.array(v if v is not None and None not in v else [], dtype=np.float64)
            a = a + 0.0  # -0 is 0
            out.append(a.tobytes() if a.size and np.isfinite(a).all() and np.isfinite(a @ a) and a @ a > 0 else None)
        yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("vec_id"), pa.array(out, pa.binary())], ["rid", "vec_id", "raw"])


def _asks(home: Column, shard: Column, shards: Column) -> Column:
    """Whether a shard's points ask that shard: each its own, and of two shards one the other, each about half of all."""
    ahead = F.pmod(shard - home, shards)
    return (2 * ahead < shards) | ((2 * ahead == shards) & (home < shard))


def _forest(a: np.ndarray, b: np.ndarray, parent: dict[int, int]) -> np.ndarray:
    """Which links are needed to keep connected what they connect, besides those before that parent knows."""

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    keep = np.zeros(len(a), dtype=bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            keep[k] = True
    return keep


def vector_groups(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", shard_points: int = SHARD_POINTS) -> DataFrame:
    """(id, n_links, component_id, kept, recall, recall_tested, planted_recall, beam) for every row of vectors.

    Rows are linked when their cosine, in double precision, is at least the threshold and they
    are found: audits of all shards decide how wide beams are. recall is the
    share of a point's links that brute force found and the search too, on average over points that have
    any (the least of vectors of any length; null if none was tested), recall_tested the number of such
    points that it asked with, planted_recall the share of planted queries that found their point
    (null without points), beam the widest first beam. Null and zero vectors, and those with
    null or non-finite components, link with nothing, as do vectors of different lengths.
    component_id is the least id (null ids count as none) that links lead to; kept says whether it
    is the row's own, and is false for null ids. Repeated rows are linked. Extra columns are
    not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    kind = dict(vectors.dtypes)[id_col]
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"))
    rows = scratch.store(rows.mapInArrow(_packed, f"rid long, vec_id {kind}, raw binary"))
    # equal vectors are one point, told by all their bytes
    points = scratch.store(rows.where("raw IS NOT NULL").groupBy("raw").agg(F.min("rid").alias("point"), F.count("*").alias("copies")).withColumn("dim", (F.length("raw") / 8).cast("int")))
    sizes = points.groupBy("dim").agg(F.count("*").alias("n"))
    shards = sizes.withColumn("shards", F.least(F.col("n"), F.greatest(F.lit(LEAST_SHARDS), F.ceil(F.col("n") / shard_points))).cast("int")).withColumn("asks", F.ceil(F.col("n") / F.col("shards") / ASK).cast("int"))
    # one row for each length of vectors there is
    dealt = points.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("point"), F.col("shards")).cast("int")).withColumn("ask", F.pmod(F.xxhash64("point", F.lit("ask")), F.col("asks")).cast("int"))

    def build(group: pa.Table) -> pa.Table:
        dim, shard = group.column("dim")[0].as_py(), group.column("shard")[:1]
        group = group.sort_by("point")
        raw = _raw(group.column("raw"), dim)
        # while the graph is built its vectors alone are held open
        members, vectors = pack(group.column("point").to_numpy(), group.column("copies").to_numpy(), raw.ravel()), _unit(raw).astype(np.float32)
        del group, raw
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": shard, "graph": pa.array([Graph.build(vectors).to_bytes()], pa.binary()), "members": pa.array([members], pa.binary())})

    n_tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, 20_000))
    # that many partitions whatever their bytes: a graph's work is not told by them
    graphs = scratch.store(dealt.select("dim", "shard", "point", "copies", "raw").repartition(n_tasks, "dim", "shard").groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, graph binary, members binary"))

    def block(group: pa.Table) -> pa.Table:
        return pa.table({"dim": group.column("dim")[:1], "home": group.column("home")[:1], "ask": group.column("ask")[:1], "shards": group.column("shards")[:1], "queries": pa.array([pack(group.column("point").to_numpy(), group.column("copies").to_numpy(), _raw(group.column("raw"), group.column("dim")[0].as_py()).ravel())], pa.binary())})

    def met(some: DataFrame, beams: dict[int, int]) -> DataFrame:
        """The graph of every shard, as often as tasks ask it, before those points in blocks. Points with a home
        ask as _asks() says, those without (-1) every shard."""
        asks = scratch.store(some.select("dim", "home", "ask", "shards", "point", "copies", "raw").groupBy("dim", "home", "ask").applyInArrow(block, "dim int, home int, ask int, shards int, queries binary"))
        # blocks of a shard are dealt over tasks; there are never more of these than blocks
        per_dim = asks.groupBy("dim", "shards").agg(F.greatest(F.lit(1), F.least(F.count("*"), F.ceil(F.lit(n_tasks) / F.col("shards")))).cast("int").alias("salts"))
        wide = F.broadcast(per_dim.join(F.broadcast(spark.createDataFrame(list(beams.items()), "dim int, beam int")), "dim"))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        nothing = F.lit(None).cast("binary")
        left = graphs.join(wide, "dim").select("dim", "shard", each("salts").alias("salt"), "beam", F.lit(None).cast("int").alias("home"), "graph", "members", nothing.alias("queries"))
        # one row a shard that has a graph
        there = F.broadcast(graphs.select("dim", "shard"))
        right = asks.join(wide.drop("shards"), "dim").join(there, "dim").where((F.col("home") < 0) | _asks(F.col("home"), F.col("shard"), F.col("shards"))).select("dim", "shard", F.pmod(F.xxhash64("home", "ask"), F.col("salts")).cast("int").alias("salt"), "beam", "home", nothing.alias("graph"), nothing.alias("members"), "queries")
        return left.unionByName(right).repartition(2 * n_tasks, "dim", "shard", "salt").sortWithinPartitions("dim", "shard", "salt", F.col("queries").isNotNull())

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(dim, graph, members, None), then the same with (beam, whether they are members, queries) for each block
        that asks."""
        dim = graph = members = None
        for batch in batches:
            for d, shard, beam, home, g, m, q in zip(*(batch.column(c).to_pylist() for c in ("dim", "shard", "beam", "home")), *(batch.column(c) for c in ("graph", "members", "queries"))):
                if g.is_valid:
                    dim = graph = members = None  # the one before goes first
                    point, copies, raw = unpack(m.as_py())
                    dim, graph, members = d, Graph.from_bytes(g.as_py(), d), (point, copies, _unit(raw.reshape(-1, d)))
                    yield dim, graph, members, None
                else:
                    point, copies, raw = unpack(q.as_py())
                    yield dim, graph, members, (beam, home == shard, point, copies, _unit(raw.reshape(-1, dim)))

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, graph, (m_point, _, m_unit), ask in asked(batches):
            if ask:
                beam, _, q_point, _, q_unit = ask
                true, found = graph.judged(q_unit.astype(np.float32), threshold, beam, lambda k, hits: hits[(m_unit[hits] @ q_unit[k] >= threshold) & (m_point[hits] != q_point[k])])
                some = true > 0
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(some.sum()), dim, dtype=np.int32)), pa.array(q_point[some]), pa.array(true[some]), pa.array(found[some])], ["dim", "point", "true", "found"])

    # one row for each length of vectors there is
    n_points = {r["dim"]: r["n"] for r in sizes.collect()}
    draws, beams = dict.fromkeys(n_points, AUDIT), dict.fromkeys(n_points, FIRST_BEAM)
    measured: dict[int, tuple[float | None, int, float]] = {}

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, g in zip(batch.column("dim").to_pylist(), batch.column("graph")):
                graph = Graph.from_bytes(g.as_py(), d)
                count = min(len(graph.vectors), -(-PLANTED * len(graph.vectors) // n_points[d]))
                yield pa.RecordBatch.from_pydict({"dim": pa.array([d], pa.int32()), "planted": [count], "hit": [graph.planted(threshold, beams[d], count)[1]]})

    while open_ := [d for d in n_points if d not in measured]:
        # a sample by hash: about as many points as are to be drawn, from all shards
        place, share = F.pmod(F.xxhash64("point", F.lit("audit")), F.lit(2**31)), F.broadcast(spark.createDataFrame([(d, draws[d] / n_points[d] * 2**31, -(-draws[d] // ASK)) for d in open_], "dim int, upto double, blocks int"))
        drawn = dealt.join(share, "dim").where(place < F.col("upto")).withColumn("home", F.lit(-1)).withColumn("ask", F.pmod(F.xxhash64("point", F.lit("ask")), F.col("blocks")).cast("int"))
        judged = scratch.store(met(drawn, {d: beams[d] for d in open_}).mapInArrow(audit, "dim int, point long, true long, found long"), batch_rows=1)
        each = judged.groupBy("dim", "point").agg((F.sum("found") / F.sum("true")).alias("share"))
        seen = {r["dim"]: (r["share"], r["tested"]) for r in each.groupBy("dim").agg(F.avg("share").alias("share"), F.count("*").alias("tested")).collect()}
        # stored, so that a worker gets one graph at once
        found_planted = scratch.store(graphs.where(F.col("dim").isin(open_)).select("dim", "graph").mapInArrow(plant, "dim int, planted long, hit long"), batch_rows=1).groupBy("dim").agg((F.sum("hit") / F.sum("planted")).alias("share"))
        planted = {r["dim"]: r["share"] for r in found_planted.collect()}
        for d in open_:
            found, tested = seen.get(d, (None, 0))
            if min(planted[d], 1.0 if found is None else found) < RECALL and beams[d] < EVERY:
                beams[d] = beams[d] * 2 if beams[d] * 2 <= shard_points * WIDEST else EVERY
            elif tested < TESTED and draws[d] < min(n_points[d], MOST_AUDIT):
                draws[d] *= 4
            else:
                measured[d] = (found, tested, planted[d])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(a, b, n):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])

        def counted(point, n):
            some = n > 0
            return rows(point[some], np.full(int(some.sum()), -1, dtype=np.int64), n[some])

        of_members = None  # links of the graph's own points that blocks have found so far
        for _, graph, (m_point, m_copies, m_unit), ask in asked(batches):
            if not ask:
                if of_members:
                    yield counted(*of_members)
                of_members = m_point, np.zeros(len(m_point), dtype=np.int64)
                continue
            beam, members_ask, q_point, q_copies, q_unit = ask
            n_links = np.zeros(len(q_point), dtype=np.int64)
            parent: dict[int, int] = {}
            # a query may hit a whole shard: no more queries at once than would then fill the room
            for some in _slices(len(q_point), len(m_point)):
                a, b = [q_point[:0]], [q_point[:0]]
                for k, hits in enumerate(graph.within(q_unit[some].astype(np.float32), threshold, beam), some.start):
                    if members_ask:
                        hits = hits[m_point[hits] > q_point[k]]
                    hits = hits[m_unit[hits] @ q_unit[k] >= threshold]
                    n_links[k] = m_copies[hits].sum()
                    of_members[1][hits] += q_copies[k]
                    a.append(np.full(len(hits), q_point[k]))
                    b.append(m_point[hits])
                a, b = np.concatenate(a), np.concatenate(b)
                keep = _forest(a, b, parent)
                yield rows(a[keep], b[keep], np.zeros(int(keep.sum()), dtype=np.int64))
            yield counted(q_point, n_links)
        if of_members:
            yield counted(*of_members)

    found = scratch.store(met(dealt.withColumn("home", F.col("shard")), beams).mapInArrow(search, "a long, b long, n long"), batch_rows=1)
    counts = found.where("b < 0").groupBy(F.col("a").alias("point")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b >= 0").select("a", "b"), scratch)
    per_point = points.join(counts, "point", "left").join(roots, F.col("point") == F.col("v"), "left").select("raw", F.coalesce("root", "point").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    member = scratch.store(rows.where("raw IS NOT NULL").join(per_point, "raw").select("vec_id", "n_links", "root"))
    # stored, so that a hot component's rows can be split over tasks
    least = scratch.store(member.groupBy("root").agg(F.min("vec_id").alias("component_id")))
    alone = rows.where("raw IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = member.join(least, "root").select("vec_id", "n_links", "component_id").unionByName(alone)
    recall, tested = min((r for r, _, _ in measured.values() if r is not None), default=None), sum(n for _, n, _ in measured.values())
    told = [F.lit(recall).cast("double").alias("recall"), F.lit(tested).cast("long").alias("recall_tested"), F.lit(min((p for _, _, p in measured.values()), default=None)).cast("double").alias("planted_recall"), F.lit(max(beams.values(), default=None)).cast("int").alias("beam")]
    return out.select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), *told)


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_groups(table(spark, sf_dir, "embeddings"))

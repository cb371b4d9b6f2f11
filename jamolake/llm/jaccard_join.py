"""N-gram Jaccard self-join with R-trees over count vectors.

The shingles of a text are hashed into groups, and the group counts make the text a point. The
overlap of two sets is at most the sum of the lesser counts, and that of two boxes of an R-tree at
most the sum of the lesser upper corners, so pairs of boxes, then points, that cannot reach the
overlap they need are left out, and the rest are verified on the sets themselves.

Points of unrelated texts differ little in each of many coordinates, so one tree over the corpus
would meet itself nearly everywhere. The trees are therefore built over texts that have one of
their first shingles in common (in an order of all shingles with common ones last, two similar
sets share one of their first few), which loses no pair.

Texts with equal sets are one point. Small groups of texts with the same least shingle hash are
linked first, by a tree of their own: every pair that it names is verified unless it is connected already,
so a group of near copies comes out whole. The blocks' trees then look only at pairs not yet connected, so
a group of thousands of near copies does not become millions of pairs. A block of more than a tile is
cut into pages; those of the component with most of its texts meet the other texts' pages only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import pack, steps, unpack
from ._common import Scratch, mix, shuffles_freed, table, tokenize, windows, word_keys
from ._components import components

#: Groups of the trees' points. Pairs of points meet again on finer groups, of which texts of more
#: than LONG shingles have more: the finer, the less do texts that share a passage seem to overlap.
GROUPS, FINE_GROUPS, LONG_GROUPS, LONG, FANOUT = 64, 256, 1024, 1000, 16
#: Rows of a task's call that joins many small blocks at once.
CALL_ROWS = 50_000
#: A pair with several first shingles in common is met in the block of each. Where these are among
#: the EARLIEST of both texts, the block of the least of them alone names the pair.
EARLIEST = 16
#: Texts and shingles of a group of first links (a longer text has a group of its own), and least
#: hashes by which a text comes into such groups (common shingles included; large groups are dealt
#: anew for each, so that their parts meet); texts of a tree's tile.
GROUP_TEXTS, GROUP_SHINGLES, GROUP_HASHES, TILE = 512, 4_000_000, 4, 1024
#: The order of shingles comes from a sample of about this many documents: those in one of 500 are
#: common. It only decides which shingles come first, never which pairs are found.
ORDER_ROWS, COMMON = 20_000, 500


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted names of the distinct shingles of each text: runs of that many words, or the whole
    sequence if shorter; none without words."""
    bounds, ids, vocabulary = tokenize(texts, lower=True)
    keys = word_keys(vocabulary)[ids]
    by_width = {words: windows(keys, words)}
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        n = int(b - a)
        if n >= words:
            out.append(np.unique(by_width[words][a : b - words + 1]))
        elif n:
            # names of different widths can be the same pairs of pairs, so the width is part of it
            out.append(mix(windows(keys[a:b], n)[:1], np.full(1, n, dtype=np.uint64)))
        else:
            out.append(keys[:0])
    return out


def _pieces(b: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for at in range(0, b.num_rows, rows):
        yield b.slice(at, rows)


def least_overlap(total: np.ndarray, per_cent: int) -> np.ndarray:
    """The overlap that sets of that total size need: 100 * I >= per_cent * (total - I)."""
    return -(-per_cent * total // (100 + per_cent))


def group_counts(shingles: np.ndarray) -> bytes:
    """Fine counts as single bytes, or should one not fit the coarse ones as eight each."""
    g = LONG_GROUPS if len(shingles) > LONG else FINE_GROUPS
    fine = np.bincount((shingles % np.uint64(g)).astype(np.int64), minlength=g)
    return fine.astype("u1").tobytes() if fine.max() < 256 else fine.reshape(-1, GROUPS).sum(axis=0).astype("<u8").tobytes()


def opened_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8" if len(data) == 8 * GROUPS else "u1").astype(np.int64)


def finest_overlap(p: np.ndarray, q: np.ndarray) -> int:
    """Bound of the overlap on the finest groups that both have; coarser ones are sums of finer."""
    g = min(len(p), len(q))
    return int(np.minimum(p.reshape(-1, g).sum(axis=0), q.reshape(-1, g).sum(axis=0)).sum())


def _points(words: int, per_cent: int, common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _pieces(whole):
                sets = shingle_sets(b.column("text"), words)
                d1, d2, firsts, counts = [], [], [], []
                least = [s[:GROUP_HASHES].astype(np.int64).tolist() for s in sets]
                for s in sets:
                    with np.errstate(over="ignore"):
                        d1.append(int(mix(s, s).sum(dtype=np.uint64).astype(np.int64)))
                        d2.append(int(np.bitwise_xor.reduce(mix(s, np.full_like(s, 77))).astype(np.int64)) if len(s) else 0)
                    counts.append(group_counts(s))
                    k = len(s) - -(-per_cent * len(s) // 100) + 1 if len(s) else 0
                    if len(common) and len(s):
                        late = np.isin(s, common, assume_unique=True)
                        s = np.concatenate([s[~late][:k], s[late]])
                    firsts.append(s[:k].astype(np.int64))
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in firsts])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(firsts) if firsts else np.zeros(0, np.int64))), pa.array(counts, pa.binary()), pa.array(least, pa.list_(pa.int64()))], ["rid", "doc_id", "n", "d1", "d2", "firsts", "counts", "least"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _pieces(whole):
                yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array([pack(steps(s)) for s in shingle_sets(b.column("text"), words)], pa.binary())], ["rid", "shingles"])

    return run


def _shingles(words: int):
    """One row for each distinct shingle of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _pieces(whole):
                sets = shingle_sets(b.column("text"), words)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64))], ["shingle"])

    return run


def opened(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed)[0], dtype=np.uint64)


def similar(a: np.ndarray, b: np.ndarray, per_cent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= per_cent * (len(a) + len(b) - both) and both > 0


def group_links(sets: list[np.ndarray], per_cent: int) -> list[tuple[int, int]]:
    """Links (i, j) that connect what similar pairs of these sets connect: a spanning forest. An R-tree over the
    sets' points names the pairs that may be similar; of these, every one is verified but those connected by
    then and those whose finer counts cannot overlap enough. For each set the likeliest pairs go first."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    fine = np.stack([np.bincount((s % np.uint64(FINE_GROUPS)).astype(np.int64), minlength=FINE_GROUPS) for s in sets]).astype(np.int32)
    i, j = tree_pairs(fine.reshape(len(sets), -1, GROUPS).sum(axis=1), sizes, np.arange(len(sets)), per_cent)
    i, j = np.maximum(i, j), np.minimum(i, j)
    bound = np.concatenate([np.minimum(fine[i[at : at + 16_384]], fine[j[at : at + 16_384]]).sum(axis=1) for at in range(0, len(i), 16_384)] or [i])
    ok = bound >= np.maximum(least_overlap(sizes[i] + sizes[j], per_cent), 1)
    i, j, bound = i[ok], j[ok], bound[ok]
    order = np.lexsort((-bound, i))
    tree = np.arange(len(sets))  # of each set, the least of those it is connected with
    out = []
    for a, b in zip(i[order].tolist(), j[order].tolist()):
        if tree[a] != tree[b] and similar(sets[a], sets[b], per_cent):
            out.append((a, b))
            low, high = sorted((tree[a], tree[b]))
            tree[tree == high] = low
    return out


def _link_in_groups(words: int, per_cent: int):
    def run(group: pa.Table) -> pa.Table:
        rids = group.column("rid").to_numpy()
        links = np.array(group_links(shingle_sets(group.column("text"), words), per_cent), dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(rids[links[:, 0]]), "b": pa.array(rids[links[:, 1]])})

    return run


def tree_pairs(points: np.ndarray, sizes: np.ndarray, owner: np.ndarray, per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j in the returned arrays' rows) of points that may overlap enough and whose
    owners differ, by descending two copies of an R-tree packed in order of size and counts."""
    m = len(sizes)
    order = np.lexsort((*points.T[:4], sizes))
    p, n = points[order].astype(np.int64), sizes[order]
    levels = [(p, n)]  # upper corners and least sizes; the boxes of a level hold FANOUT of the one below
    while len(levels[-1][1]) > FANOUT:
        top, least = levels[-1]
        cuts = np.arange(0, len(least), FANOUT)
        levels.append((np.maximum.reduceat(top, cuts), np.minimum.reduceat(least, cuts)))
    top, _ = levels[-1]
    i, j = np.triu_indices(len(top))
    for depth in range(len(levels) - 1, -1, -1):
        top, least = levels[depth]
        keep = np.zeros(len(i), dtype=bool)
        for at in range(0, len(i), 65_536):
            s = slice(at, at + 65_536)
            keep[s] = np.minimum(top[i[s]], top[j[s]]).sum(axis=1) >= least_overlap(least[i[s]] + least[j[s]], per_cent)
        i, j = i[keep], j[keep]
        if depth:
            below = len(levels[depth - 1][1])
            ci, cj = i[:, None] * FANOUT + np.arange(FANOUT), j[:, None] * FANOUT + np.arange(FANOUT)
            i, j = np.repeat(ci, FANOUT, axis=1).ravel(), np.tile(cj, (1, FANOUT)).ravel()
            ok = (i < below) & (j < below) & (i <= j)
            i, j = i[ok], j[ok]
    own = owner[order]
    ok = (i < j) & (own[i] != own[j])
    return (order[i[ok]], order[j[ok]]) if m else (i[:0], j[:0])


def block_pairs(block: np.ndarray, points: np.ndarray, sizes: np.ndarray, owner: np.ndarray, per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """tree_pairs() inside every block of rows sorted by block. Blocks that are a single leaf are
    joined side by side: rows k apart, for each k."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
    length = np.diff(starts)
    leaf = np.repeat(length <= FANOUT, length)
    left, right = [], []
    for k in range(1, FANOUT):
        i = np.flatnonzero(leaf[:-k] & (block[:-k] == block[k:]) & (owner[:-k] != owner[k:])) if k < len(block) else np.zeros(0, dtype=np.int64)
        for at in range(0, len(i), 65_536):
            x = i[at : at + 65_536]
            ok = np.minimum(points[x], points[x + k]).sum(axis=1) >= least_overlap(sizes[x] + sizes[x + k], per_cent)
            left.append(x[ok])
            right.append(x[ok] + k)
    for n, at in zip(length, starts):
        if n > FANOUT:
            i, j = tree_pairs(points[at : at + n], sizes[at : at + n], owner[at : at + n], per_cent)
            left.append(i + at)
            right.append(j + at)
    return np.concatenate(left or [starts[:0]]), np.concatenate(right or [starts[:0]])


def named_here(shingle: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the block of that shingle names the pair, given the earliest first shingles of both
    texts as rows: it is the least that the rows have in common, or they have none."""
    out = np.empty(len(shingle), dtype=bool)
    top = np.iinfo(np.int64).max
    for at in range(0, len(shingle), 8192):
        s = slice(at, at + 8192)
        least = np.where((p[s][:, :, None] == q[s][:, None, :]).any(axis=2), p[s], top).min(axis=1)
        out[s] = (least == top) | (least == shingle[s])
    return out


def _tree_join(per_cent: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("shingle", "ascending"), ("x", "ascending"), ("y", "ascending")])
        rids, x, y, page = (group.column(c).to_numpy() for c in ("rid", "x", "y", "page"))
        key = np.stack([group.column("shingle").to_numpy(), x, y])
        block = np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0))])
        once = dict(zip(rids.tolist(), group.column("counts")))  # a text is in many blocks
        fine = {r: opened_counts(c.as_py()) for r, c in once.items()}
        coarse = {r: f.reshape(-1, GROUPS).sum(axis=0) for r, f in fine.items()}
        points = np.stack([coarse[r] for r in rids.tolist()])
        earliest = np.stack([np.resize(e.values.to_numpy(), EARLIEST) for e in group.column("earliest")])  # short ones repeat
        sizes = group.column("n").to_numpy()
        i, j = block_pairs(block, points, sizes, group.column("root").to_numpy(), per_cent)
        ok = (x[i] == y[i]) | (page[i] != page[j])  # pairs of one page have a tile of their own
        i, j = i[ok], j[ok]
        ok = named_here(key[0][i], earliest[i], earliest[j])
        i, j = i[ok], j[ok]
        a, b = np.minimum(rids[i], rids[j]), np.maximum(rids[i], rids[j])
        _, once = np.unique(np.stack([a, b]), axis=1, return_index=True)
        i, j, a, b = i[once], j[once], a[once], b[once]
        need = least_overlap(sizes[i] + sizes[j], per_cent)
        ok = np.array([finest_overlap(fine[p], fine[q]) >= n for p, q, n in zip(a.tolist(), b.tolist(), need.tolist())], dtype=bool)
        return pa.table({"a": a[ok], "b": b[ok]})

    return run


def _verified(per_cent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(opened(x.as_py()), opened(y.as_py()), per_cent) for x, y in zip(b.column("sa"), b.column("sb"))]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def jaccard_groups(docs: DataFrame, words: int = 5, per_cent: int = 80, row_id: str | None = None) -> DataFrame:
    """(rid, doc_id, n_shingles, component_id, root) for every row of docs. root names the component;
    rid is a row's number, that of the column row_id if docs has been stored with one.

    Rows are linked when 100 * intersection >= per_cent * union of their shingle sets;
    component_id is the least doc_id that links lead to, a row's own included (null ids count
    as none). A-Z is lowered. Texts without words, and null texts, have no shingles and are
    linked with nothing. Repeated rows have equal sets and are linked; rid tells them apart.
    Columns other than doc_id and text are not read; an empty table gives no rows. Texts are
    taken whole and no pair is dropped.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.col(row_id).alias("rid"), "doc_id", "text") if row_id else scratch.numbered(docs.select("doc_id", "text"))
    texts = rows.select("rid", "text")

    n_docs = rows.count()
    n_sample = min(ORDER_ROWS, n_docs)
    sample = texts.where(F.pmod(F.xxhash64("rid", F.lit("order")), F.lit(max(1, n_docs))) < ORDER_ROWS).select("text")
    # a shingle in one of COMMON sampled texts; at most COMMON times the shingles of a mean text
    often = max(8, -(-n_sample // COMMON))
    with shuffles_freed(spark):
        common = np.array(sorted(r[0] for r in sample.mapInArrow(_shingles(words), "shingle long").groupBy("shingle").count().where(F.col("count") >= often).select("shingle").collect()), dtype=np.int64).view(np.uint64)
    common.sort()

    points = scratch.store(rows.mapInArrow(_points(words, per_cent, common), f"rid long, doc_id {kind}, n long, d1 long, d2 long, firsts array<long>, counts binary, least array<long>"))
    slim = scratch.store(points.select("rid", "doc_id", "n", "d1", "d2"))
    some = slim.where("n > 0")
    classes = scratch.store(some.groupBy("d1", "d2", "n").agg(F.min("rid").alias("rep")))
    reps = scratch.store(points.where("n > 0").select("rid", "n", "firsts", "counts", "least").join(classes.select(F.col("rep").alias("rid")), "rid", "left_semi"))
    scratch.drop(points)

    # first links: inside small groups of texts with one of their least hashes in common
    first = reps.select("rid", "n", F.explode("least").alias("shingle"))
    dealt = F.ceil(F.greatest(F.count("*") / GROUP_TEXTS, F.sum("n") / GROUP_SHINGLES))
    # stored, so that a hot shingle's rows can be split over tasks
    sizes = scratch.store(first.groupBy("shingle").agg(F.count("*").alias("m"), dealt.alias("salts")).where("m > 1"))
    grouped = first.join(sizes, "shingle").select("rid", "shingle", F.pmod(F.xxhash64("rid", "shingle"), F.col("salts")).alias("salt"))
    near = texts.join(grouped.hint("shuffle_hash"), "rid").groupBy("shingle", "salt").applyInArrow(_link_in_groups(words, per_cent), "a long, b long")
    links = scratch.store(near)
    roots = components(links, scratch)

    # blocks of texts that share a first shingle and are not all connected yet
    known = reps.join(roots, F.col("rid") == F.col("v"), "left").withColumn("root", F.coalesce("root", "rid"))
    at = known.select("rid", "root", F.explode("firsts").alias("shingle"))
    blocks = scratch.store(at.groupBy("shingle").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("shingle", "m"))
    # of blocks beyond a tile, the component with most texts: they are connected, so they need not meet
    large = blocks.where(F.col("m") > TILE)
    per_root = at.join(large.select("shingle"), "shingle", "left_semi").groupBy("shingle", "root").agg(F.count("*").alias("most"))
    main = per_root.groupBy("shingle").agg(F.max_by("root", F.struct("most", "root")).alias("main"), F.max("most").alias("most"))
    pages = lambda n: F.ceil(n / TILE).cast("int")
    mains = large.join(main, "shingle").select("shingle", "m", "main", "most", pages(F.col("m") - F.col("most")).alias("pages"), pages(F.col("most")).alias("main_pages"))
    whole = blocks.where(F.col("m") <= TILE).select("shingle", "m", F.lit(None).cast("long").alias("main"), F.lit(0).cast("long").alias("most"), F.lit(1).alias("pages"), F.lit(0).alias("main_pages"))
    cut = scratch.store(whole.unionByName(mains)) if large.limit(1).count() else whole
    each = (F.col("m") - F.col("most")) * (F.col("pages") + F.col("main_pages")) + F.col("most") * F.col("pages")
    n_rows = cut.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0]
    calls = int(-(-n_rows // CALL_ROWS)) or 1
    is_main = F.coalesce(F.col("root") == F.col("main"), F.lit(False))
    page = F.when(is_main, F.col("pages") + F.pmod(F.xxhash64("rid"), F.greatest("main_pages", F.lit(1)))).otherwise(F.pmod(F.xxhash64("rid"), F.col("pages"))).cast("int")
    paged = at.join(cut, "shingle").withColumn("page", page).withColumn("upto", F.when(is_main, F.col("pages")).otherwise(F.col("pages") + F.col("main_pages")))
    tiles = paged.select("rid", "shingle", "page", F.explode(F.sequence(F.lit(0), F.col("upto") - 1)).alias("other")).select("rid", "shingle", "page", F.least("page", "other").alias("x"), F.greatest("page", "other").alias("y"))
    met = tiles.join(known.select("rid", "n", "root", "counts", F.slice("firsts", 1, EARLIEST).alias("earliest")), "rid").withColumn("call", F.pmod(F.xxhash64("shingle", "x", "y"), F.lit(calls))).groupBy("call").applyInArrow(_tree_join(per_cent), "a long, b long")
    pairs = scratch.store(met.distinct())

    # verification on the sets of the texts in question
    asked = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()
    sets = scratch.store(texts.join(asked.hint("shuffle_hash"), "rid").mapInArrow(_sets(words), "rid long, shingles binary"))
    both = pairs.join(sets.select(F.col("rid").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("rid").alias("b"), F.col("shingles").alias("sb")), "b")
    more = scratch.store(both.select("a", "b", "sa", "sb").mapInArrow(_verified(per_cent), "a long, b long"))
    scratch.drop(reps, blocks, sets, pairs, *([] if row_id else [rows]))

    final = components(links.unionByName(more), scratch)
    member = some.select("rid", "doc_id", "n", "d1", "d2").join(classes, ["d1", "d2", "n"]).join(final, F.col("rep") == F.col("v"), "left").select("rid", "doc_id", "n", F.coalesce("root", "rep").alias("root"))
    member = scratch.store(member)
    # stored, so that a hot component's rows can be split over tasks
    least = scratch.store(member.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    linked = member.join(least, "root").select("rid", "doc_id", F.col("n").alias("n_shingles"), "component_id", "root")
    return linked.unionByName(slim.where("n = 0").select("rid", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("rid").alias("root")))


def op9_jaccard_join(spark, sf_dir):
    return jaccard_groups(table(spark, sf_dir, "documents"), words=4, per_cent=85).drop("rid", "root")

"""Memory that does not grow with a shard."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from jamolake.llm import vector_dedup


def test_graph_is_built_in_bounded_steps(monkeypatch):
    rng = np.random.default_rng(2)
    v = vector_dedup._unit(rng.normal(size=(3000, 64))).astype(np.float32)

    def built():
        tracemalloc.start()
        g = vector_dedup.Graph.build(v)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return g.to_bytes(), peak

    whole, most = built()
    monkeypatch.setattr(vector_dedup, "ROOM", 1 << 17, raising=False)
    cut, least = built()
    assert cut == whole and least < most * 2 / 3


def test_shards_have_a_size(spark):
    rng = np.random.default_rng(4)
    raw = rng.normal(size=(2000, 64))
    graph = vector_dedup.Graph.build(vector_dedup._unit(raw).astype(np.float32))
    held = len(graph.to_bytes()) + len(vector_dedup.pack(raw.ravel()))
    # what a task gets at once, however many points there are
    assert held / len(raw) * vector_dedup.SHARD_POINTS < 32 << 20
    # of two shards one asks the other, each its own
    for n in (1, 2, 3, 4, 7, 8):
        pairs = spark.range(n).crossJoin(spark.range(n).toDF("to")).where(vector_dedup._asks(F.col("id"), F.col("to"), F.lit(n))).collect()
        assert sorted(tuple(sorted(p)) for p in pairs) == [(a, b) for a in range(n) for b in range(a, n)]


def test_links_across_many_shards(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 16))
    v = np.repeat(centres, 8, axis=0) + rng.normal(scale=0.15, size=(480, 16))
    unit = vector_dedup._unit(v)
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    rows = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)] + [(480, list(map(float, v[3])))], "vec_id long, embedding array<double>")
    # shards of an odd and an even number
    for points in (69, 80):
        got = {r["vec_id"]: r["n_links"] for r in vector_dedup.vector_groups(rows, shard_points=points).collect()}
        twin = links[:, 3] | (np.arange(480) == 3)
        want = dict(enumerate((links.sum(axis=1) + twin).tolist())) | {480: int(links[3].sum()) + 1}
        assert got == want and sum(want.values()) > 480

"""Vector search at any number of queries, the inverted-file index, mini-batch k-means."""



import numpy as np
from pyspark.sql import functions as F

from tessera.operators import ivf, minibatch, vector
from tessera.sources import fixtures as fx, sinks


def unit(rng, n, dim=16, centers=12):
    c = rng.normal(size=(centers, dim))
    x = c[rng.integers(centers, size=n)] + 0.35 * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, key="memory_id", value="embedding", name="m{:05d}"):
    return spark.createDataFrame([(name.format(i), [float(a) for a in v]) for i, v in enumerate(x)], f"{key} string, {value} array<float>")


def test_many_queries_meet_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = unit(rng, 700)
    x[300:420] = x[0]  # ties
    rows, asked = frame(spark, x), frame(spark, x[:90], "query_id", "query", "q{:03d}")
    want = sorted(map(tuple, vector.knn(rows, asked, 7).collect()))
    monkeypatch.setattr(vector, "QUERY_BLOCK", 10)
    monkeypatch.setattr("tessera.operators.pairing.paired.__defaults__", (None, None, 100, 16))
    got = vector.knn(rows, asked, 7)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().toString() and sorted(map(tuple, got.collect())) == want
    assert vector.knn(rows.limit(0), asked, 7).count() == 0


def test_index_finds_what_exact_search_finds(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = unit(rng, 3000)
    x[1000:1600] = x[7]  # a hot cell
    rows, asked = frame(spark, x), frame(spark, unit(rng, 60), "query_id", "query", "q{:03d}")
    index = ivf.InvertedIndex(spark, str(tmp_path / "i"))
    index.build(rows, cells=40)
    exact = index.exact(asked, 10)
    assert ivf.recall(index.search(asked, 10, probes=8), exact) >= 0.9
    assert sorted(map(tuple, index.search(asked, 10, probes=40).collect())) == sorted(map(tuple, exact.collect()))
    plan = index.rows_of.read(where=F.col("cell") == 3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan  # other cells' folders aren't read
    # adds move vectors to other cells, removes leave no trace
    new = frame(spark, np.vstack([x[2999], -x[5], x[11]]), name="m{:05d}")  # m00000, m00001, m00002 have new vectors
    index.add(new)
    index.remove(spark.createDataFrame([("m00007",), ("none",)], "memory_id string"))
    now = {f"m{i:05d}": v for i, v in enumerate(x)} | {"m00000": x[2999], "m00001": -x[5], "m00002": x[11]}
    del now["m00007"]
    rows = index.rows().collect()
    assert {r.memory_id for r in rows} == set(now) and len(rows) == len(now)
    some = frame(spark, np.vstack([x[2999], -x[5], x[7]]), "query_id", "query", "q{}")
    got = {(r.query_id, r["rank"]): r.memory_id for r in index.search(some, 3, probes=40).collect()}
    assert {got["q0", 1], got["q0", 2]} == {"m00000", "m02999"} and got["q1", 1] == "m00001" and got["q2", 1] == "m01000"
    assert sorted(map(tuple, index.search(some, 5, probes=40).collect())) == sorted(map(tuple, index.exact(some, 5).collect()))


def test_index_recall_on_the_memories(spark, sf_dir, tmp_path):
    rows = fx.table(spark, "/root/testdata/sf0.01", "embeddings").selectExpr("cast(vec_id as string) memory_id", "embedding", "vec_id")
    index = ivf.InvertedIndex(spark, str(tmp_path / "i"))
    index.build(rows)
    asked = rows.where("vec_id % 20 = 0").selectExpr("memory_id query_id", "embedding query")
    probes = index.tuned(asked, 10)
    assert probes < 44 and ivf.recall(index.search(asked, 10, probes), index.exact(asked, 10)) >= 0.9


def test_mini_batches_equal_a_plain_model(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = unit(rng, 1200, 8, 6)
    batches = [x[i : i + 300].astype(np.float32) for i in range(0, 1200, 300)]
    model = minibatch.MiniBatch(sinks.Versions(spark, str(tmp_path / "k"), "cluster"), k=6)
    rows = frame(spark, x)
    assert {r.cluster for r in model.assign(rows).collect()} == {0}  # nothing learnt yet
    start = None
    for i, b in enumerate(batches):
        d = frame(spark, b)
        if start is None:
            start = minibatch.started(d, 6).orderBy("cluster").collect()
            c, n = np.array([r.centroid for r in start]), np.zeros(6)
        at = ((b[:, None, :].astype(float) - c[None]) ** 2).sum(-1).argmin(1)
        for j in range(6):
            if (at == j).any():
                c[j] = (c[j] * n[j] + b[at == j].astype(float).sum(0)) / (n[j] + (at == j).sum())
                n[j] += (at == j).sum()
        assert model.partial_fit(d, "s", i) == i
    assert model.partial_fit(frame(spark, batches[0]), "s", 3) == 3  # a batch again
    got = minibatch.MiniBatch(sinks.Versions(spark, str(tmp_path / "k"), "cluster"), k=6).centroids().orderBy("cluster").collect()
    assert np.allclose([r.centroid for r in got], c) and [r.n for r in got] == n.tolist()
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    flat = rows.select(array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("features"))
    best = min(KMeans(k=6, seed=s).fit(flat).summary.trainingCost for s in (1, 2, 3))
    assert model.inertia(rows) <= 1.5 * best

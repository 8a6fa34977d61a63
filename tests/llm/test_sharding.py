import itertools

import numpy as np
from pyspark.sql import functions as F

from corpus import documents, mixed
from ledgerlens.llm import sharding


def test_hilbert_curve_visits_every_cell_and_moves_one_step():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        index = sharding.hilbert_index(list(cells.T), bits)
        assert sorted(index.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_runs_are_even_gapless_and_in_curve_order(spark):
    df = documents(spark, mixed(spark), extra=["run", "rid", "kind"])
    out = sharding.cut_runs(sharding.with_hilbert(df, ["lang", "source", "n_chars", "doc_id"]), ["hilbert", "doc_id"], 7).toPandas()
    assert len(out) == df.count() and set(df.columns) < set(out.columns)
    sizes = out.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 7
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    ordered = out.sort_values(["shard", "slot"]).hilbert.tolist()
    assert ordered == sorted(ordered)


def test_fewer_rows_than_shards_and_empty_tables(spark):
    df = documents(spark, [(1, "a"), (2, None)], extra=[])
    out = sharding.cut_runs(sharding.with_hilbert(df, ["source", "n_chars"]), ["hilbert"], 16).toPandas()
    assert sorted(out.slot) == [0, 0] and out.shard.is_unique
    none = df.limit(0)
    assert sharding.cut_runs(sharding.with_hilbert(none, ["source", "n_chars"]), ["hilbert"], 16).count() == 0


def test_manifest_prunes_shards(spark, scratch):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") * 7919 % 4000).alias("n_chars"))
    cut = sharding.cut_runs(sharding.with_hilbert(df, ["doc_id", "n_chars"]), ["hilbert", "doc_id"], 16)
    made = sharding.write_shards(cut, f"{scratch}/shards", ["doc_id", "n_chars"])
    hit = sharding.prune(made, "n_chars", 0, 400)
    assert 0 < hit.count() <= 8
    read = spark.read.parquet(f"{scratch}/shards")
    assert read.count() == 4000
    inside = read.filter("n_chars <= 400").select("shard").distinct().toPandas().shard
    assert set(inside) <= set(hit.toPandas().shard)

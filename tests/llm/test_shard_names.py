"""Shards of documents whose columns are called like the folders."""

from resultmart.llm.sharding import shard, write_shards


def test_columns_called_like_the_folders(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * (i % 7), f"p{i}", i, "y", 1.5) for i in range(40)], "doc_id long, text string, Prefix string, part long, prefix_ string, uid double")
    write_shards(docs, shard(docs, 30), f"{tmp_path}/s")
    found = spark.read.parquet(f"{tmp_path}/s")
    assert {"doc_id", "text", "Prefix__", "part_", "prefix_", "uid", "prefix", "part"} == set(found.columns)
    assert sorted((r.doc_id, r["Prefix__"], r.part_, r.prefix_) for r in found.select("doc_id", "Prefix__", "part_", "prefix_").collect()) == [(i, f"p{i}", i, "y") for i in range(40)]

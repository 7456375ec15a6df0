import threading

import pytest
from pyspark.sql import functions as F

from formweave.llm import sharding

SCHEMA = "doc_id bigint, text string, _sh_group int, _sh_name string, _SHARD string, _shard_bytes int"


def docs(spark, n, first=0):
    return spark.createDataFrame([(first + i if i % 9 else None, f"text {i} " * (1 + i % 50) if i % 7 else None, i, "n", "own", i) for i in range(n)], SCHEMA)


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_arrivals_merge_and_old_versions_stay(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    parts = [docs(spark, 40, 100 * k) for k in range(3)]
    for part in parts:
        sharding.append(part, root, rows_per_shard=7)
    old = sharding.load(spark, root)
    m = sharding.compact(spark, root, target=1 << 20)
    assert m.version == 4 and sharding.versions(spark, root) == [1, 2, 3, 4] and len(m.shards) < len(old.shards)
    # merged files hold rows of several arrivals
    columns = parts[0].columns
    back = sharding.read(spark, root)
    assert back.columns == [*columns, "_shard_", "_shard_bytes_"]
    every = parts[0].union(parts[1]).union(parts[2])
    assert same(back.select(columns), every)
    mixed = back.where("doc_id is not null").groupBy("_shard_").agg(F.count_distinct(F.floor(F.col("doc_id") / 100)).alias("n"))
    assert mixed.agg(F.max("n")).head()[0] == 3
    for version, rows in ((1, parts[0]), (2, parts[0].union(parts[1])), (3, every)):
        assert same(sharding.read(spark, root, version).select(columns), rows)
    sharding.append(parts[0].limit(5), root)
    sharding.vacuum(spark, root, keep=2)
    assert sharding.versions(spark, root) == [4, 5] and same(sharding.read(spark, root, 4).select(columns), every)
    assert sharding.read(spark, root).count() == 125
    sharding.vacuum(spark, root)
    assert sharding.versions(spark, root) == [5] and sharding.read(spark, root).count() == 125


def test_one_of_many_writers_commits_a_version(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    won, lost = [], []

    def write(k):
        try:
            sharding.commit(spark, root, sharding.Manifest(1, docs(spark, 1).schema.json(), (sharding.Shard(f"f{k}", k),)))
            won.append(k)
        except sharding.VersionTaken:
            lost.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 7
    assert sharding.load(spark, root).shards == (sharding.Shard(f"f{won[0]}", won[0]),)


def test_racing_appends_all_arrive(spark, tmp_path):
    root = f"file://{tmp_path}/a"
    threads = [threading.Thread(target=sharding.append, args=(docs(spark, 10, 100 * k), root)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sharding.versions(spark, root) == [1, 2, 3, 4]
    assert sharding.read(spark, root).count() == 40


def test_empty_tables_and_refusals(spark, tmp_path):
    root = f"file://{tmp_path}/e"
    with pytest.raises(ValueError):
        sharding.read(spark, root)
    rows, m = sharding.shard_documents(docs(spark, 0), root)
    assert rows.count() == 0 and m.version == 2 and rows.columns[-1] == "_shard_bytes_"
    sharding.append(docs(spark, 3), root)
    assert sharding.read(spark, root).count() == 3

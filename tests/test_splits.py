"""Files that are read in several splits, hashes compared as numbers, and rows that arrive in another order."""

from pyspark.sql import functions as F

from lurelens.functions import hashing as H
from lurelens.operators import evidence as E
from lurelens.sources import readers as R


def test_source_rows_of_a_split_file(spark, tmp_path):
    (tmp_path / "many.txt").write_text("".join(f"host{i}.example.com\n" for i in range(4000)))
    (tmp_path / "other.csv").write_text("Domain\n" + "".join(f"site{i}.example.org\n" for i in range(3000)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = R.to_contexts(R.read_lines(spark, str(tmp_path / "many.txt")).withColumnRenamed("url", R.HEADERS["detected"][0]), "many.txt")
        assert [(r["detected_domain"], r["source_row"]) for r in lines.orderBy("source_row").collect()] == [(f"host{i}.example.com", i + 2) for i in range(4000)]
        table = R.read_csv(spark, str(tmp_path / "other.csv"))
        assert table.rdd.getNumPartitions() > 1 and table.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_values_over_lines_keep_their_file_whole(spark, tmp_path):
    (tmp_path / "quoted.csv").write_text('Domain,Note\na.example.com,"one\ntwo"\nb.example.com,"say ""x"""\n')
    rows = {r["Domain"]: r["Note"] for r in R.read_csv(spark, str(tmp_path / "quoted.csv")).collect()}
    assert rows == {"a.example.com": "one\ntwo", "b.example.com": 'say "x"'}


def test_nearest_hash_against_every_pair(spark):
    own = ["00ff00ff00ff00ff", "ffffffffffffffff", "0", "8000000000000000", "no hash", "other", "", None]
    others = ["00ff00ff00ff00fe", "8000000000000001", "no hash", "", None, "7f", "7f"]
    rows = spark.createDataFrame(list(enumerate(own)), "id bigint, h string")
    refs = spark.createDataFrame([(x,) for x in others], "hash string")
    every = {r["id"]: r["s"] for r in rows.crossJoin(refs).groupBy("id").agg(F.round(F.max(H.hash_similarity(F.col("h"), F.col("hash"))), 6).alias("s")).collect()}
    for limit in (1000, 2):
        assert {r["id"]: r["s"] for r in E.nearest_hash(rows, "h", refs, limit, "s").collect()} == every


def test_hash_scores_come_back_by_content(spark):
    rows = spark.createDataFrame([(1, "f0", ["a", "b"]), (2, "f1", ["b"]), (3, "", ["a"]), (4, None, ["a"]), (5, "f0", ["c"]), (6, "f0", ["a", "b"])], "id bigint, h string, keys array<string>")
    refs = spark.createDataFrame([("a", "f0"), ("b", "f1")], "key string, hash string")
    found = {r["id"]: r["s"] for r in E._hash_score(rows.repartition(3), "h", F.col("keys"), refs, "s").collect()}
    assert found == {1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 1.0}

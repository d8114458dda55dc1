from chainweft.operators.spread import spread


def test_few_small_files_are_dealt_out(spark, tmp_path):
    path = str(tmp_path / "with blank")
    spark.range(1000).coalesce(1).write.parquet(path)
    rows = spread(spark.read.parquet(path).select("id"))
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert rows.count() == 1000 and rows.agg({"id": "sum"}).first()[0] == 499500


def test_others_stay(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(1000).repartition(8).write.parquet(path)
    many = spark.read.parquet(path)
    assert spread(many) is many
    made = spark.range(10)
    assert spread(made) is made
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        assert spread(one) is one
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")

from pyspark.sql import functions as F

from discern.sources.tables import read_table


def rows_of_tasks(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_a_file_of_one_row_group_is_dealt_out(spark, tmp_path):
    spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/docs.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        plain, dealt = read_table(spark, str(tmp_path), "docs"), read_table(spark, str(tmp_path), "docs", spread=True)
        assert plain.rdd.getNumPartitions() > 4 and rows_of_tasks(plain) == [4000]  # many tasks, one with rows
        assert rows_of_tasks(dealt) == [1000] * 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tables_of_many_files_are_read_as_they_are(spark, tmp_path):
    spark.range(400).repartition(8).write.parquet(f"{tmp_path}/docs.parquet")
    df = read_table(spark, str(tmp_path), "docs", spread=True)
    assert "Exchange" not in df._jdf.queryExecution().toString()

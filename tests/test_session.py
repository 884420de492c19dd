from driftrank.session import DEFAULT_CONF, configure


def test_the_size_of_a_task_is_bounded_unless_the_cluster_says_otherwise(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        configure(spark)
        assert spark.conf.get(key) == DEFAULT_CONF[key] == str(16 << 20)
        spark.conf.set(key, "8m")
        configure(spark)
        assert spark.conf.get(key) == "8m"
    finally:
        spark.conf.set(key, before)

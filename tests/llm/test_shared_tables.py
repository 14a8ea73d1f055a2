"""Tables written to the shared folder between the steps of an operator."""
import time

from leadvane.llm.common import written


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {line for line in found.splitlines() if "/shuffle_" in line}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = spark.range(10_000).repartition(5, "id").groupBy("id").count()
    table = written(rows, "freed")
    for _ in range(100):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert table.count() == 10_000


def test_a_frame_written_and_collected_keeps_its_own_shuffle(spark):
    rows = spark.range(1000).repartition(5, "id")
    assert len(rows.collect()) == written(rows, "first").count() == len(rows.collect()) == written(rows, "second").count() == 1000

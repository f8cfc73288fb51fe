import glob
import time

from fitloom.plans.materialize import cut


def test_stored_table_leaves_no_shuffle_files(spark):
    def left():
        folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for folder in folders for f in glob.glob(f"{folder}/**/shuffle_*", recursive=True)}

    before = left()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(name, None)
    table = cut(spark.range(1000).selectExpr("id % 7 AS k", "id").groupBy("k").sum("id"))
    for _ in range(50):
        if left() <= before:
            break
        time.sleep(0.1)
    assert left() <= before
    assert table.count() == 7 and spark.conf.get(name, None) == setting

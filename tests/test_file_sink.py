"""The file sink: all files of a job or none."""

import os

import pytest
from pyspark.sql import functions as F

from veinstone.sources import file_sink


def files(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names)


def test_commit_and_replace(spark, tmp_path):
    spark.dataSource.register(file_sink.FileSink)
    out = f"{tmp_path}/out"
    docs = spark.range(7).select(F.concat(F.lit("r"), F.col("id") % 2, F.lit("/"), "id", F.lit(".xml")).alias("name"), F.concat(F.lit("<ead>é"), "id").alias("content")).repartition(3)
    docs.write.format("description_files").mode("append").save(f"file://{out}")
    assert files(out) == sorted(f"r{k % 2}/{k}.xml" for k in range(7))
    assert open(f"{out}/r1/3.xml", encoding="utf-8").read() == "<ead>é3"
    with pytest.raises(Exception, match="files exist"):
        docs.where("name = 'r1/3.xml'").withColumn("content", F.lit("new")).write.format("description_files").mode("append").save(f"file://{out}")
    docs.where("name = 'r1/3.xml'").withColumn("content", F.lit("new")).write.format("description_files").mode("overwrite").save(f"file://{out}")
    assert open(f"{out}/r1/3.xml").read() == "new" and len(files(out)) == 7


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(file_sink.FileSink)
    out = f"{tmp_path}/out"
    rows = spark.range(0, 40, 1, 4).select(F.concat(F.when(F.col("id") == 35, "../").otherwise(""), F.col("id").cast("string")).alias("name"), F.lit("x").alias("content"))
    with pytest.raises(Exception, match="no file name"):
        rows.write.format("description_files").mode("append").save(f"file://{out}")
    assert [f for f in files(out) if not f.startswith("_attempt-")] == []
    os.makedirs(f"{out}/_attempt-dead/a")
    assert file_sink.drop_attempts(f"file://{out}") >= 1 and files(out) == [] and file_sink.drop_attempts(f"file://{out}") == 0


@pytest.mark.parametrize("name", [None, "", "/a", "a/../b", "a//b", "./a", "_attempt-1/x"])
def test_names(name):
    with pytest.raises(ValueError):
        file_sink.checked(name)

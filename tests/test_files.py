import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidewater.sources import files, tables


def listed(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


def test_files_of_all_tasks(spark, tmp_path):
    rows = spark.range(40).repartition(5).select(F.format_string("a/%02d.bin", "id").alias("name"), F.encode(F.repeat(F.lit("x"), F.col("id").cast("int")), "utf-8").alias("content"), F.lit(1).alias("more"))
    files.write_files(rows, str(tmp_path))
    assert listed(tmp_path) == [f"a/{i:02d}.bin" for i in range(40)]
    assert (tmp_path / "a/07.bin").read_bytes() == b"x" * 7 and (tmp_path / "a/00.bin").read_bytes() == b""
    for name in ("a/03.bin", "../out.bin", "/abs", "same"):  # exists; leaves the folder; twice
        bad = spark.range(2 if name == "same" else 1).select(F.lit(name).alias("name"), F.lit(b"1").alias("content"))
        with pytest.raises(Exception, match="exist|leaves|name one"):
            files.write_files(bad, str(tmp_path))
    assert len(listed(tmp_path)) == 40 and not [d for d in os.listdir(tmp_path) if d.startswith(".staging")]
    files.write_files(rows.limit(0), str(tmp_path))


def test_a_failed_task_publishes_nothing(spark, tmp_path):
    rows = spark.range(8).repartition(4).select(F.col("id").cast("string").alias("name"), F.when(F.col("id") == 5, F.raise_error(F.lit("broken"))).otherwise(F.lit(b"1")).alias("content"))
    with pytest.raises(Exception, match="broken"):
        files.write_files(rows, str(tmp_path))
    assert [f for f in listed(tmp_path) if not f.startswith(".staging")] == []


def test_one_of_two_writers_wins(spark, tmp_path):
    out, results = str(tmp_path / "t"), {}
    slow = spark.range(4).repartition(2).mapInPandas(lambda parts: (time.sleep(1.5) or p for p in parts), "id long")

    def write(i):
        try:
            results[i] = tables.publish(slow, out, {"writer": i})
        except (files.Busy, ValueError) as e:
            results[i] = e

    threads = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [i for i, r in results.items() if isinstance(r, dict)]
    assert len(won) == 1 and sum(isinstance(r, (files.Busy, ValueError)) for r in results.values()) == 2
    assert tables.load_published(spark, out, {"writer": won[0]}).count() == 4
    assert sorted(os.listdir(tmp_path)) == ["t"]


def test_a_killed_writer_is_cleaned_up(spark, tmp_path):
    out, df = str(tmp_path / "t"), spark.range(3)
    dead = files.Claim(spark, out)
    assert dead._create()
    os.makedirs(f"{dead.staging()}/data")
    with pytest.raises(files.Busy):
        tables.publish(df, out, {"v": 1})
    old = time.time() - 3600
    os.utime(dead.file, (old, old))
    assert tables.publish(df, out, {"v": 1})["rows"] == 3
    assert sorted(os.listdir(tmp_path)) == ["t"]
    # the dead one wakes up: its claim is gone, so it cannot publish over what is there
    with pytest.raises(files.Busy, match="lost"):
        dead.commit()


def test_a_working_writer_keeps_its_claim(spark, tmp_path):
    out = str(tmp_path / "t")
    with files.Claim(spark, out, stale_after=0.6):
        time.sleep(1.5)
        with pytest.raises(files.Busy):
            files.Claim(spark, out, stale_after=0.6).__enter__()
    assert os.listdir(tmp_path) == []


def test_a_failed_write_gives_the_claim_back(spark, tmp_path):
    out = str(tmp_path / "t")
    with pytest.raises(Exception, match="broken"):
        tables.publish(spark.range(1).select(F.raise_error(F.lit("broken")).cast("long").alias("x")), out, {})
    assert os.listdir(tmp_path) == [] and tables.publish(spark.range(2), out, {})["rows"] == 2

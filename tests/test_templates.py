import tarfile

from pyspark.sql import functions as F

from pagewise.functions import text as t
from pagewise.operators import sampling
from pagewise.sources import archives


def test_tar_shards_and_resume(spark, tmp_path):
    pages = spark.createDataFrame([(i // 3, f"{i:03d}", bytes([i]), f'{{"id":{i}}}') for i in range(7)] + [(2, "900", None, None)], "shard int, id string, image binary, record string")
    log = archives.write_tar(pages, f"file://{tmp_path}/out")
    archives.append_log(log, f"{tmp_path}/log")
    assert archives.run_summary(archives.read_log(spark, f"{tmp_path}/log")).first() == (3, 8)
    with tarfile.open(tmp_path / "out" / "shard-00001.tar") as tar:
        assert tar.getnames() == ["003.png", "003.json", "004.png", "004.json", "005.png", "005.json"]
        assert tar.extractfile("004.json").read() == b'{"id":4}' and tar.extractfile("004.png").read() == b"\x04"
    plan = sampling.plan_shards(spark, 0, 12, 3)
    assert [r.shard for r in sampling.pending(plan, archives.read_log(spark, f"{tmp_path}/log")).collect()] == [3]
    assert archives.read_log(spark, f"{tmp_path}/none").count() == 0


def test_font_names(spark):
    df = spark.createDataFrame([("fonts/Amiri-Bold.ttf",), ("Noto_Sans.otf",), ("X[wght].ttf",), ("A-ExtraBold.ttf",), ("B-ExtraLight.ttf",)], "f string")
    rows = df.select(t.font_family(F.col("f")), t.weight_rank(F.col("f"))).collect()
    assert [r[0] for r in rows] == ["Amiri", "Noto", "X", "A", "B"] and [r[1] for r in rows] == [6, 3, 3, 6, 1]

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent


def test_only_the_result_is_left(spark, tmp_path):
    from tarn.storage import Scratch

    with Scratch(spark, "t") as s:
        a = s.cut(spark.range(5), "a")
        b = s.cut(a.where("id > 1"), "b")
        out = s.finish(b.where("id > 2"))
        root = Path(s.root.removeprefix("file://"))
        assert sorted(x.id for x in out.collect()) == [3, 4]
        assert [p.name for p in root.iterdir()] == ["003-result"]
    assert not root.exists()


CODE = """
from pyspark.sql import SparkSession
from tarn.storage import Scratch, shared_dir
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
x = Scratch(s, "t")
print("ROWS", x.cut(s.range(3)).count(), x.root)
"""


def test_a_stock_session_needs_no_setting(tmp_path):
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_")} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(REPO)}
    got = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=180, check=True).stdout
    line = next(x for x in got.splitlines() if x.startswith("ROWS"))
    assert line.split()[1] == "3" and not Path(line.split()[2].removeprefix("file://")).exists()


def test_no_local_folder_on_a_cluster():
    from tarn import storage

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session())

"""Lineage cuts that survive lost executors.

``cut`` writes a DataFrame as parquet below the folder named in
``spark.checkpoint.dir`` and returns the written table. Nothing is kept on
an executor's own disk, so a lost executor costs no recomputation of earlier
rounds.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tarn.session import settle

_SETTING = "spark.checkpoint.dir"
#: The temporary folder of a local session that names none.
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Where none is set, a temporary one for a session on this machine only (tests); an error on a cluster."""
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"{_SETTING} must name a folder that all machines of {master} share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tarn-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        found = "file://" + _own[0]
    return found.rstrip("/")


class Scratch:
    """Tables that one operator run writes below the shared folder.

    ``finish`` leaves only the result of the run there; what is left is deleted by ``close`` (or at the
    end of a ``with`` block), at the latest when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        settle(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tarn/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._live: set[str] = set()
        fs, path = self._fs(self.root)
        fs.deleteOnExit(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def cut(self, df: DataFrame, name: str = "step") -> DataFrame:
        """Write ``df`` and read it back: the plan so far is run once and its lineage ends here."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tarn_path = path
        self._live.add(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for t in tables:
            self._delete(getattr(t, "_tarn_path", None))

    def finish(self, df: DataFrame) -> DataFrame:
        """The result of the run as a written table, every other table of it deleted."""
        out = self.cut(df, "result")
        for path in self._live - {out._tarn_path}:
            self._delete(path)
        return out

    def close(self) -> None:
        """Delete all that the run has written."""
        fs, path = self._fs(self.root)
        fs.delete(path, True)
        self._live.clear()

    def _delete(self, path: str | None) -> None:
        if path in self._live:
            fs, p = self._fs(path)
            fs.delete(p, True)
            self._live.discard(path)

"""Tables that cut lineage, written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset, one temporary folder per process, in local mode alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="tallymark-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return f"file://{_own['dir']}"


class Scratch:
    """Written tables of one operator call; drop() removes those that its result does not read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def save(self, df: DataFrame) -> DataFrame:
        """Write the rows once and read them back: a lost executor re-reads files instead of running the lineage again."""
        path = f"{self.root}/{self.made}"
        self.made += 1
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path  # type: ignore[attr-defined]
        return back

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more, and let Spark's cleaner see the shuffles that fed them."""
        jvm = self.spark.sparkContext._jvm
        for frame in frames:
            path = jvm.org.apache.hadoop.fs.Path(frame._scratch_path)  # type: ignore[attr-defined]
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def tidy(self) -> None:
        """Ask the driver's JVM to collect garbage, so that shuffle files of finished steps leave the executors' disks."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

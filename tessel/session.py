"""Session defaults, the shared folder, and lineage cutting."""

from __future__ import annotations

import re
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller's own session is used."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    ``spark.checkpoint.dir`` is used where it is set. Only where it is not (a local test session) a folder of this
    machine is made, once per session.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessel-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def read_shared(folder: str, columns: list[str]) -> pa.Table | None:
    """Columns of the Parquet files of a folder of the shared folder, read by a worker; none if it does not exist."""
    if re.match("[a-z0-9]+:/", folder):
        files, path = fs.FileSystem.from_uri(re.sub("^file:/*", "file:///", folder))
    else:
        files, path = fs.LocalFileSystem(), folder
    found = sorted(f.path for f in files.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet"))
    return pa.concat_tables([pq.read_table(name, columns=columns, filesystem=files, partitioning=None) for name in found]) if found else None

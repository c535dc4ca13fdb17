"""Sinks and caches: Parquet tables named by a fingerprint of all that made them, with a JSON note beside them."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F


def fingerprint(settings: dict[str, Any], **source: Any) -> str:
    """Twelve hex digits of md5 over all settings and the source's snapshot, keys sorted."""
    return hashlib.md5(json.dumps({"settings": settings, "source": source}, sort_keys=True, default=str).encode()).hexdigest()[:12]


def snapshot(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """The files under a path, their sizes and times of change in microseconds, by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return sorted(tuple(r) for r in files.select("path", "length", F.unix_micros("modificationTime")).collect())


def cache_path(root: str, prefix: str, model: str, mark: str, split: str | None = None, limit: int | None = None) -> str:
    name = prefix if split is None else split + (f"_limit{limit}" if limit is not None else "")
    return f"{root.rstrip('/')}/{name}_{model}_{mark}"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """A table counts only when its writer has finished."""
    fs, p = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def stream_path(spark: SparkSession, path: str) -> str:
    """The path for a file stream: a folder as it is, a single file as a pattern that only it matches."""
    fs, p = _fs(spark, path)
    return f"{p.getParent()}/{{{p.getName()}}}" if fs.exists(p) and fs.getFileStatus(p).isFile() else path


def save_json(spark: SparkSession, path: str, note: dict) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(note, indent=2, sort_keys=True, default=str).encode()))
    out.close()


def load_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], note: dict | None = None, force: bool = False) -> DataFrame:
    """The table at path; made and written if it isn't there or force is set."""
    if force or not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
        save_json(spark, f"{path}_meta.json", note or {})
    return spark.read.parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset and all tasks run on this machine, as in tests, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lumenfold-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df written to a table of its own in the shared folder and read again, so that what uses it several times doesn't compute it again."""
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV by declared columns, so all parts have one header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def manifest(spark: SparkSession, path: str, settings: dict, tables: dict[str, str]) -> None:
    save_json(spark, path, {"settings": settings, "tables": tables})

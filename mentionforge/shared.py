"""The folder that driver and executors share, and paths in it."""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from pyspark.sql import SparkSession


def base_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. On one machine a temporary folder takes its place; a cluster must name one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        base = "file://" + tempfile.mkdtemp(prefix="mentionforge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def work_folder(spark: SparkSession, name: str = "run") -> str:
    """A new path in the shared folder."""
    return f"{base_folder(spark)}/{name}-{uuid.uuid4().hex}"


def run_folder(base: str, environ=os.environ) -> str:
    """base and a folder named by the scheduler's job id, else by the time."""
    tag = next((environ[k] for k in ("SLURM_JOB_ID", "JOB_ID", "RUN_ID") if environ.get(k)), None)
    return f"{base.rstrip('/')}/run-{tag or time.strftime('%Y%m%d-%H%M%S')}"


def resolved(path: str, base: str) -> str:
    """Absolute paths and addresses stay; relative ones are taken from base."""
    return path if os.path.isabs(path) or "://" in path else os.path.join(base, path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def files(spark: SparkSession, folder: str, glob: str) -> list[str]:
    """Names in a folder that match, sorted: files, and folders of the parts of one table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder, glob)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(f.getPath().getName() for f in found or [])


def needed(spark: SparkSession, *paths: str) -> None:
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise FileNotFoundError(", ".join(missing))


def secret(name: str, file: str | None = None, environ=os.environ) -> str:
    """A key from the environment, else from a file without its line ends; never logged."""
    value = environ.get(name) or ""
    if not value and file and os.path.isfile(file):
        with open(file, encoding="utf-8") as f:
            value = f.read().replace("\r", "").replace("\n", "")
    if not value.strip():
        raise KeyError(f"no key in {name}" + (f" or {file}" if file else ""))
    return value.strip()

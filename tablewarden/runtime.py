"""Session set-up, the shared working folder, and file-system helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Folders of local sessions without the setting, by application.
_LOCAL_DIRS: dict[str, str] = {}


def build_session(app: str = "tablewarden", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on.

    UTC is pinned so that text forms of timestamps agree everywhere; adaptive
    execution coalesces small shuffle partitions and splits skewed join sides.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # call sites of every expression cost more than planning it
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as named by ``spark.checkpoint.dir``.

    Only a local session may run without the setting; it then gets a temporary
    folder. On a cluster a missing setting is an error, never a local folder.
    """
    configured = spark.conf.get(_CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_CONF} to a folder every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_DIRS:
        _LOCAL_DIRS[application] = tempfile.mkdtemp(prefix="tablewarden-")
    return _LOCAL_DIRS[application]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, so that runs never collide."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and read it back.

    A written table survives the loss of any executor, and both readers of the
    result see the same rows.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, path: str):
    """``(file system, path)`` of Hadoop for a local, HDFS or object-store path."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def list_dir(spark: SparkSession, path: str) -> list[str]:
    """Names directly below ``path``; empty when it does not exist."""
    fs, p = hadoop_path(spark, path)
    if not fs.exists(p):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(p))


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return bool(fs.exists(p))


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the Parquet data below a path, or of the file it is."""
    fs, p = hadoop_path(spark, path)
    if fs.getFileStatus(p).isFile():
        return int(fs.getFileStatus(p).getLen())
    return sum(int(s.getLen()) for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet"))


def delete_path(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return bool(fs.delete(p, True))


def write_small_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Create a file that must not exist yet; raises if another writer was first.

    It is filled under another name, which readers pass over, and renamed when
    complete: a file of the final name is never empty or half written.
    """
    fs, p = hadoop_path(spark, path)
    parent, name = path.rsplit("/", 1)
    _, filled = hadoop_path(spark, f"{parent}/.{name}.{uuid.uuid4().hex}")
    out = fs.create(filled, False)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    # a rename onto an existing name is refused by file systems with atomic renames, and reported as false or an error
    if fs.exists(p) or not fs.rename(filled, p):
        fs.delete(filled, False)
        raise FileExistsError(f"{path} exists already")


def read_small_file(spark: SparkSession, path: str) -> bytes:
    fs, p = hadoop_path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def first_character(spark: SparkSession, path: str) -> str:
    """The first character of a file that is not blank; empty for a blank file."""
    fs, p = hadoop_path(spark, path)
    stream = fs.open(p)
    try:
        while (byte := stream.read()) != -1:
            if not chr(byte).isspace():
                return chr(byte)
        return ""
    finally:
        stream.close()


def run_together(spark: SparkSession, jobs: list[Callable[[], object]], at_once: int = 8) -> list:
    """Run independent actions side by side, so small tables fill idle cores."""
    if len(jobs) < 2:
        return [job() for job in jobs]
    with ThreadPoolExecutor(min(at_once, len(jobs))) as pool:
        return list(pool.map(lambda job: inheritable_thread_target(spark)(job)(), jobs))

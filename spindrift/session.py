"""Session helpers: durable intermediate tables and bounded broadcasts.

Nothing here keeps state on one machine.  Intermediate results go to the folder
that the session names in ``spark.checkpoint.dir`` (shared by all executors, so
a lost executor costs a re-read and not a recomputation).  Where that setting is
absent, a temporary folder is created in local mode only; on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup side may be broadcast; checked by counting, beyond it a shuffle join is used.
BROADCAST_ROWS = 100_000

_own_dir: str | None = None


def local_session(name: str = "spindrift", cores: int = 4, partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; cluster jobs bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the one set on the context; in local mode a temporary one where neither is set."""
    global _own_dir
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="spindrift-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return _own_dir


#: Lets Spark remove the shuffle files of a write as soon as it has ended; nobody can read them again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage and makes the rows stable: whoever reads the result twice
    sees the same rows, also after an executor was lost.  The table lasts until
    the :func:`scratch` block around it ends, :func:`drop_materialized` is called, or the process ends with its session up.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spindrift-{label}-{uuid.uuid4().hex}"
    schema = df.schema
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    _registered(spark, path)
    return spark.read.schema(schema).parquet(path)


def _registered(spark: SparkSession, path: str) -> None:
    if not _paths:
        atexit.unregister(drop_materialized)
        atexit.register(drop_materialized)  # after Spark's own hooks were registered, so that it runs before them
    _paths.append((spark, path))


def materialize_by(df: DataFrame, label: str, key: str) -> DataFrame:
    """As :func:`materialize`, but bucketed by ``key``: whoever joins or groups the result by it needs no shuffle of it, however often."""
    spark = df.sparkSession
    n = shuffle_partitions(spark)
    name = f"spindrift_{label}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_dir(spark)}/{name}"
    with _shuffles_dropped(spark):
        df.repartition(n, key).write.format("parquet").option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(name)
    _registered(spark, path)
    _names[path] = name
    return spark.table(name)


_paths: list[tuple[SparkSession, str]] = []
#: Catalog names of the bucketed ones.
_names: dict[str, str] = {}


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_materialized(since: int = 0) -> int:
    """Delete every table that :func:`materialize` wrote in this process (from the ``since``-th on); results that still read one become invalid."""
    n = 0
    while len(_paths) > since:
        spark, path = _paths.pop()
        try:
            if path in _names:
                spark.sql(f"DROP TABLE IF EXISTS {_names.pop(path)}")
            p, fs = _path(spark, path)
            n += bool(fs.delete(p, True))
        except Exception:  # the session is gone
            pass
    return n


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder for a caller's own tables; dropped like those of :func:`materialize`."""
    path = f"{shared_dir(spark)}/spindrift-{label}-{uuid.uuid4().hex}"
    _registered(spark, path)
    return path


@contextmanager
def scratch() -> Iterator[None]:
    """Intermediate tables written inside the block are deleted at its end; write the results within it."""
    since = len(_paths)
    try:
        yield
    finally:
        drop_materialized(since)


def built_once(spark: SparkSession, source: str, label: str, build: Callable[[str], None]) -> str:
    """Folder of what ``build(folder)`` makes of the data in ``source``, made once and used again.

    The name is formed of the source's path and its files' names, sizes and
    times, so changed data get a new folder; a mark that is written last tells
    a whole folder from a half-made one.
    """
    root, fs = _path(spark, source)
    files = fs.listFiles(root, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    name = hashlib.blake2b("\n".join([source, *sorted(seen)]).encode(), digest_size=12).hexdigest()
    path = f"{shared_dir(spark)}/spindrift-{label}-{name}"
    mark, fs = _path(spark, f"{path}/_BUILT")
    if not fs.exists(mark):
        with _shuffles_dropped(spark), scratch():
            build(path)
        fs.create(mark, True).close()
    return path


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint if a count proves it has at most ``max_rows`` rows, else ``df`` as it is."""
    small = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df), True) if small else (df, False)

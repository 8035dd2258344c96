"""Session helpers: shared work folder and materialisation.

Paid, non-deterministic results (model replies) are written to the shared
folder the cluster names in ``spark.checkpoint.dir`` and read back, so a lost
executor or a re-planned stage never pays for the same call twice.  A
``cache()`` is not enough: evicted blocks are recomputed.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "lexiflow", master: str | None = None, shuffle_partitions: int = 8,
                  extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (the cluster brings its own)."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        b = b.master(master)
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for materialised stages.

    Read from the session; only a local session without one gets a fresh
    private folder (as in tests).  A cluster must name it.
    """
    d = spark.conf.get(_CKPT_KEY, None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    d = tempfile.mkdtemp(prefix="lexiflow-ckpt-")
    spark.conf.set(_CKPT_KEY, d)
    spark.sparkContext.setCheckpointDir(d)
    return d


@contextmanager
def session_conf(spark: SparkSession, conf: dict):
    """Session settings that apply inside the block only (restored after)."""
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``lexiflow`` importable in Python workers, once per application.

    The package is zipped and registered with ``addPyFile``, which serves the
    file from the driver to every executor, whatever their working folder (a
    cluster may also install the package; then this adds a redundant copy).
    The zip goes to the shared checkpoint folder when that is a mounted
    path, else to the driver's own temp folder (``addPyFile`` ships it).
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    base = checkpoint_root(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    if not (base.startswith("/") and os.path.isdir(base)):
        base = tempfile.mkdtemp(prefix="lexiflow-pkg-")
    dest = os.path.join(base, f"lexiflow-pkg-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(dest, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, names in os.walk(pkg):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(dest)
    _SHIPPED.add(sc.applicationId)


class WorkDir:
    """One run's folder under the checkpoint root; stages are Parquet tables.

    With a ``path`` of its own and ``resume``, a run that was interrupted goes on: tables
    and waves of paid calls that were completely written are read, not made again.  A new
    input needs a new path.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, resume: bool = False):
        ship_package(spark)
        self.spark = spark
        self.path = path or os.path.join(checkpoint_root(spark), "lexiflow-" + uuid.uuid4().hex[:12])
        self.resume = resume and path is not None
        self.queues: list = []
        self.replies: dict[str, DataFrame] = {}      # of each paid stage, by its name

    def table(self, name: str) -> str:
        return os.path.join(self.path, name)

    def exists(self, name: str) -> bool:
        """Whether the table was completely written, on any file system Spark can reach."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.table(name), "_SUCCESS"))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def materialize(self, df: DataFrame, name: str, conf: dict | None = None) -> DataFrame:
        """Write ``df`` as a Parquet table and return a DataFrame reading it.

        ``conf``: session settings that apply to this write only (restored after).
        """
        p = self.table(name)
        if not (self.resume and self.exists(name)):
            with session_conf(self.spark, conf or {}):
                df.write.mode("overwrite").parquet(p)
        # the schema is known: no footer inference on read-back
        return self.spark.read.schema(df.schema).parquet(p)

    def paid(self, todo: DataFrame, call, name: str, key: list[str], calls_per_wave: int,
             conf: dict | None = None, stored: bool = False, tag: str = "") -> DataFrame:
        """The replies ``call(calls, number of calls)`` to the rows of ``todo``, paid for in waves of about ``calls_per_wave``.

        ``todo`` is written first unless it is ``stored``.  See :mod:`lexiflow.operators.queue`: a wave is
        paid for once, also by a later run on the same folder with ``resume``, and the result has the replies to these
        calls only.  ``tag``: settings that change a reply; another tag is another run.
        """
        from .operators.queue import PaidQueue
        calls = todo if stored else self.materialize(todo, f"{name}-calls")
        queue = PaidQueue(self, calls, name, key, calls_per_wave, tag)
        self.queues.append(queue)
        self.replies[name] = queue.run(call, conf)
        return self.replies[name]

    def spent(self, settings=None) -> DataFrame:
        """Calls, errors, tokens and dollars of all paid stages of this run, from their manifests (one row)."""
        from .config import DEFAULT
        from .operators.queue import spent
        return spent(self.queues, settings or DEFAULT)


def work_dir(spark: SparkSession, path: str | None = None, resume: bool = False) -> WorkDir:
    return WorkDir(spark, path, resume)

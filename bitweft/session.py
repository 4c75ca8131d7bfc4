"""Session helpers: local test sessions, table access, and shared-folder storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "bitweft", cpus: int | str = 8, partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, read from the session.

    It is set here only where it is unset and the session is a local one (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="bitweft-"))
    return sc.getCheckpointDir().rstrip("/")


class Workspace:
    """Written tables of one run below the shared folder: they cut lineage and survive lost executors.

    put() writes and rereads, drop() deletes as soon as nothing reads a table any more; what a lazy
    result still reads stays until close() or the end of the application."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/bitweft/{name}-{uuid.uuid4().hex}"
        self._n = 0
        path, fs = self._at(self.root)
        fs.deleteOnExit(path)  # whatever is not dropped before goes when the application ends

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        out = self.path(name)
        df.write.parquet(out)
        back = self.spark.read.schema(df.schema).parquet(out)
        back._bitweft_path = out
        return back

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and getattr(t, "_bitweft_path", None):
                self._delete(t._bitweft_path)

    def close(self) -> None:
        self._delete(self.root)

    def _at(self, path: str) -> tuple:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select columns by exact name under new names: pick(df, id="doc_id").

    Works beside extra columns whose names clash (other case, dots, repeated names: the first counts)."""
    from pyspark.sql import functions as F

    names = df.columns
    missing = [c for c in columns.values() if c not in names]
    if missing:
        raise ValueError(f"no column {missing} in {names}")
    plain = df.toDF(*[f"__c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"__c{names.index(c)}").alias(out) for out, c in columns.items()])


#: Ids up to this count (some 30 MB) go to every executor; more are joined by a shuffle.
BROADCAST_IDS = 400_000


def small(df: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """df, marked for broadcast if a count shows that it has at most `limit` rows."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df.hint("merge")


def without(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose id is not in ids(id); rows without an id stay. All columns stay as they are."""
    from pyspark.sql import functions as F

    names = df.columns
    plain = df.toDF(*[f"__c{i}" for i in range(len(names))])
    gone = small(ids.select(F.col("id").alias("__gone")).distinct())
    return plain.join(gone, F.col(f"__c{names.index(id_col)}") == F.col("__gone"), "left_anti").toDF(*names)

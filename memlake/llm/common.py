"""What the training-data operators share: written tables, fresh column names, size checks.

Lineage is cut with tables written to the folder that ``spark.checkpoint.dir`` names, which every
executor of a cluster can read; a lost executor then costs the tasks it ran and nothing upstream.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker gets at once. Texts may be long, so batches are kept short.
BATCH_ROWS = 256

_OWN: dict[str, str] = {}
#: Paths written since the innermost alone() began.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder for written tables: ``spark.checkpoint.dir``, or on an unset local session a temporary one.

    A session on a cluster without that setting gets an error, since a machine-local folder would not
    be seen by the other machines.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/") + "/memlake-" + spark.sparkContext.applicationId
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="memlake-")
    return "file://" + _OWN[app]


def written(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends here."""
    spark = df.sparkSession
    # A union may keep its sides' partitioning, which the adaptive planner of 4.1 can misjudge after it coalesces one.
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path, compression=compression)
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def alone(spark: SparkSession, what: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, written; then every table that ``make`` wrote on the way is removed from the shared folder.

    Only the result may leave ``make``: other DataFrames over its tables can't be read any more.
    """
    made: list[str] = []
    around = _MADE.set(made)
    try:
        kept = written(make(), what)
    finally:
        _MADE.reset(around)
    *passing, own = made
    outer = _MADE.get()
    if outer is not None:
        outer.append(own)
    for path in passing:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return kept


def short_batches(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch, for tables of texts. All operators use one bound, as results are lazy."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: By operator, what makes a Python worker forget what that operator remembers in it.
_FORGET: dict[str, Callable[[], None]] = {}
_AT: list[str] = []


def remembers(operator: str, forget: Callable[[], None]) -> None:
    """States how a worker forgets what ``operator`` keeps from task to task."""
    _FORGET[operator] = forget


def turn_to(operator: str) -> None:
    """Called in a Python worker with each batch: when another operator's batches came before, all they left is given back.

    Workers outlive a stage, so an executor would else hold what every stage before remembered.
    """
    if _AT == [operator]:
        return
    if _AT:
        for name, forget in _FORGET.items():
            if name != operator:
                forget()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
    _AT[:] = [operator]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so (whatever its case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(doc_id, n: int):
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n

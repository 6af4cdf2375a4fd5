"""What the operators of this subpackage share: shared-storage cuts, text normalisation, small literals."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII white space, the separators of words in most contracts.
BLANK = r"[\x20\x09-\x0D]"

#: Memory that a table sent to every executor may take there.
BROADCAST_BYTES = 48 << 20

#: Bytes of a split: a table with so many for each core has splits enough.
SPLIT_BYTES = 128 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a local one where it is unset and the
    executors are threads of the driver (tests).  Raises RuntimeError where it is unset on a cluster."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = getattr(shared_dir, "own", None)
        if not named:
            named = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="quillon-")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through reliable storage, so that a lost executor costs no more than a re-read."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back; compact where checkpoint() isn't.  Removed at exit."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quillon-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)  # codecs that use direct buffers hold them until a collection
    if not _written:
        atexit.register(remove_stored)
    _written.append((spark, path))
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def remove_stored(*tables: DataFrame) -> None:
    """Deletes these tables that stored() has written, or all of them; only once nothing reads them any more."""
    paths = {t.stored_at for t in tables}
    gone = [(spark, path) for spark, path in _written if not tables or path in paths]
    for spark, path in gone:
        context = spark.sparkContext
        if context._jsc is not None and not context._jsc.sc().isStopped():
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
        _written.remove((spark, path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet")) if name in ("documents", "pages") else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small table of fewer files than there are cores, dealt out over the cores row by row: its few row groups would hold
    up the work on texts.  Others are as they are: their splits suffice, and nothing is shuffled."""
    spark = df.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, df.inputFiles()
    if len(files) >= cores:
        return df
    conf, make = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    size = sum(make(f).getFileSystem(conf).getFileStatus(make(f)).getLen() for f in files)
    return df.repartition(cores) if size < cores * SPLIT_BYTES else df


def bounded(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, to be broadcast where its rows take no more than so many bytes.  It is read to be measured, so it should be a
    stored table or a cheap selection from one."""
    fixed = 48 + 8 * len(df.columns)  # a hash table's entry, and what each value takes at least
    wide = [F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) for f in df.schema if f.dataType.simpleString().startswith(("string", "binary", "array", "struct", "map"))]
    taken = df.agg(F.sum(sum(wide, F.lit(fixed)).cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if taken <= most else df


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else.  lower() does just that to pure ASCII, and faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def words_of(c: Column) -> Column:
    """Words parted by ASCII white space; null and blank texts have none."""
    bare = F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK + "+"))


def let(value: Column, body) -> Column:
    """body(value) with value worked out once; a lambda's variable is never inlined."""
    return F.transform(F.array(value), body)[0]

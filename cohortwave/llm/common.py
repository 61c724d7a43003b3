"""What the corpus operators share: shared storage, text columns, salted lookups."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"



def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is read from ``spark.checkpoint.dir`` (or the context's checkpoint
    folder). Where neither is set, a session inside one process, as in tests,
    gets a new temporary folder; on a cluster that is an error, as each machine
    would write to a disk of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cohortwave-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


_PATHS: list[str] = []
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used; ``forget`` will delete it."""
    _PATHS.append(f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}")
    return _PATHS[-1]


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, safe from lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[table] = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete written tables from which nothing will be read any more."""
    for table in tables:
        if path := _WRITTEN.pop(table, None):
            _delete(table.sparkSession, path)
            _PATHS.remove(path)


def forget(spark: SparkSession) -> None:
    """Delete what this process wrote to the shared folder, once no result needs it any more."""
    while _PATHS:
        _delete(spark, _PATHS.pop())


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def packed(df: DataFrame, name: str = "_row") -> Column:
    """All columns in one struct, so that an operator's own columns clash with none: ``select("_row.*")`` unpacks them."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias(name)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def held_out(key: Column | str) -> Column:
    """True for the fifth of the ids that no model learns from."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: A key of more than this part of all rows is hot.
HOT_SHARE = 1e-3
#: Rows of a lookup table that may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000


def hot_lookup(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """Left join of ``rows`` to ``facts``, unique by ``key`` and already written.

    ``count`` is the column of ``facts`` that says how many rows bear the key.
    Fewer than ``1 / HOT_SHARE`` keys can each have over ``HOT_SHARE`` of all
    rows: these are broadcast, so that no task meets a hot key; all others go by
    shuffle. The column ``count`` does not come out; ``rows`` is read twice.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    hot = facts.where(F.col(count) > total * HOT_SHARE).drop(count)
    met = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    facts = facts.where(F.col(count) <= total * HOT_SHARE).drop(count)
    others = [c for c in facts.columns if c != key]
    cold = met.where("_hot is null").drop("_hot", *others).join(facts, key, "left")
    return met.where("_hot").drop("_hot").unionByName(cold)


def salted_lookup(rows: DataFrame, facts: DataFrame, keys: list[str], salt: Column, salts: int = 64, how: str = "left") -> DataFrame:
    """Join ``rows`` to ``facts`` (unique by ``keys``), a hot key spread over ``salts`` tasks.

    ``salt`` is any evenly spread, deterministic integer of a row. Each fact is
    repeated once per salt, so facts must be few beside rows, or narrow.
    """
    left = rows.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    right = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def checked_lookup(rows: DataFrame, facts: DataFrame, key: str, salt: Column, most: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of ``rows`` to ``facts``, unique by ``key`` and already written.

    ``facts`` is counted first: up to ``most`` rows are broadcast, more are
    joined with hot keys spread by ``salt``. Both ways give the same rows.
    """
    if facts.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(facts), key, "left")
    return salted_lookup(rows, facts, [key], salt)

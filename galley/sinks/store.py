"""A keyed table in versions: rows are written first, then one small file makes them a version.

A version's rows lie in a folder of their own. What makes them version n is the file ``_versions/v<n>``, which names
that folder and is put in place, whole, only if no such file exists. So a reader sees all of a version or none,
a job that is lost leaves rows that nothing names, and of two writers that start from the same version one
commits; the other finds the number taken, starts again from what is now the newest, and loses nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSIONS = "_versions"


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _committed(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(number, folder of its rows) of each version, the oldest first."""
    fs, path = _files(spark, folder)
    top = path(f"{folder}/{VERSIONS}")
    if not fs.exists(top):
        return []
    names = sorted(str(x.getPath().getName()) for x in fs.listStatus(top))
    names = [n for n in names if n.startswith("v") and n[1:].isdigit()]
    read = lambda n: spark._jvm.org.apache.commons.io.IOUtils.toString(fs.open(path(f"{folder}/{VERSIONS}/{n}")), "UTF-8")
    return [(int(n[1:]), f"{folder}/{read(n).strip()}") for n in names]


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Folders of the committed versions' rows, the oldest first."""
    return [f for _, f in _committed(spark, folder)]


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version."""
    if not (found := versions(spark, folder)):
        raise FileNotFoundError(f"no version in {folder}")
    return spark.read.parquet(found[-1])


def _commit(spark: SparkSession, folder: str, number: int, rows: str) -> bool:
    """Make the rows in folder ``rows`` version ``number``; False where that exists."""
    fs, path = _files(spark, folder)
    fs.mkdirs(path(f"{folder}/{VERSIONS}"))
    draft, final = path(f"{folder}/{VERSIONS}/_{uuid.uuid4().hex}"), path(f"{folder}/{VERSIONS}/v{number:09d}")
    out = fs.create(draft, False)
    out.write(bytearray(rows.encode()))
    out.close()
    try:
        if fs.getScheme() != "file":
            return bool(fs.rename(draft, final))  # never onto a file that exists
        # a local rename would replace the file; a second name for it is made only if there is none
        local = lambda p: spark._jvm.java.nio.file.Path.of(fs.makeQualified(p).toUri())
        if spark._jvm.java.nio.file.Files.exists(local(final), spark.sparkContext._gateway.new_array(spark._jvm.java.nio.file.LinkOption, 0)):
            return False
        try:
            spark._jvm.java.nio.file.Files.createLink(local(final), local(draft))
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True
    finally:
        fs.delete(draft, False)


def update(spark: SparkSession, folder: str, change: Callable[[DataFrame | None], DataFrame], tries: int = 20) -> DataFrame:
    """Commit ``change`` of the newest version (None: there is none yet) as the next one.

    Where another writer committed meanwhile, ``change`` is done again on that version.
    """
    for _ in range(tries):
        found = _committed(spark, folder)
        number, base = found[-1] if found else (0, None)
        rows = f"rows-{uuid.uuid4().hex}"
        change(spark.read.parquet(base) if base else None).write.parquet(f"{folder}/{rows}")
        if _commit(spark, folder, number + 1, rows):
            return spark.read.parquet(f"{folder}/{rows}")
        fs, path = _files(spark, folder)
        fs.delete(path(f"{folder}/{rows}"), True)
    raise RuntimeError(f"other writers committed to {folder} {tries} times meanwhile")


def save(df: DataFrame, folder: str) -> DataFrame:
    """Commit ``df`` as the next version, whatever the one before holds."""
    return update(df.sparkSession, folder, lambda _: df)


def _whole(old: DataFrame | None, folder: str) -> DataFrame:
    if old is None:
        raise FileNotFoundError(f"no version in {folder}")
    return old


def upsert(spark: SparkSession, folder: str, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of their key; a key that ``new`` repeats must repeat its row."""
    return update(spark, folder, lambda old: _whole(old, folder).join(new.select(key), key, "left_anti").unionByName(new.dropDuplicates([key])))


def delete(spark: SparkSession, folder: str, keys: DataFrame, key: str) -> DataFrame:
    return update(spark, folder, lambda old: _whole(old, folder).join(keys.select(key), key, "left_anti"))


def delete_all(spark: SparkSession, folder: str) -> DataFrame:
    return update(spark, folder, lambda old: _whole(old, folder).where(F.lit(False)))


def rewrite(spark: SparkSession, folder: str, change: Callable[[DataFrame], DataFrame], where: str = "true") -> DataFrame:
    """The rows that meet ``where`` changed, the others as they are; columns that ``change`` adds are null there."""
    met = F.coalesce(F.expr(where), F.lit(False))
    return update(spark, folder, lambda old: _whole(old, folder).where(~met).unionByName(change(old.where(met)), allowMissingColumns=True))


def vacuum(spark: SparkSession, folder: str, keep: int = 1) -> None:
    """Delete all but the newest ``keep`` versions, once no query reads them."""
    fs, path = _files(spark, folder)
    for number, rows in _committed(spark, folder)[: -keep or None]:
        fs.delete(path(f"{folder}/{VERSIONS}/v{number:09d}"), False)
        fs.delete(path(rows), True)


def write_documents(df: DataFrame, folder: str, key: str) -> None:
    """One JSON object a line, in files of rows that stand together by ``key``."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value"), key).repartition(F.col(key)).select("value").write.mode("overwrite").text(folder)

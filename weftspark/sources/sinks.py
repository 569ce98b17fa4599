"""Writing results: paired outputs, content-addressed bundles, pointers, resumable vectors.

Data goes through Spark writers; only small documents (reports, manifests, pointers) are written by the driver, through
Hadoop's file system API, so that any store Spark knows will do.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.session import stored


class PublicationError(RuntimeError):
    """Something is in the way of a publication."""


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _path(spark, path)
    return bool(fs.exists(where))


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _path(spark, path)
    fs.delete(where, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    fs, to = _path(spark, target)
    fs.mkdirs(to.getParent())
    if not fs.rename(_path(spark, source)[1], to):
        raise PublicationError(f"{source} could not become {target}")


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file onto another one in one step: at no time is there no target."""
    jvm = spark.sparkContext._jvm
    fs, to = _path(spark, target)
    fs.mkdirs(to.getParent())
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(context.makeQualified(_path(spark, source)[1]), context.makeQualified(to), how)


def write_text(spark: SparkSession, path: str, text: str, attempts: int = 3) -> None:
    """A small file, complete or as it was before: written beside its place, then renamed onto it; tried again if a store
    fails in passing."""
    fs, _ = _path(spark, path)
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    for attempt in range(attempts):
        try:
            out = fs.create(_path(spark, beside)[1], True)
            out.write(bytearray(text.encode("utf-8")))
            out.close()
            replace(spark, beside, path)
            return
        except Py4JJavaError:
            if attempt == attempts - 1:
                remove(spark, beside)
                raise
            time.sleep(0.2 * 2**attempt)


def read_text(spark: SparkSession, path: str) -> str:
    return bytes(spark.read.format("binaryFile").load(path).first()["content"]).decode("utf-8")


def canonical(value: object) -> str:
    """JSON with sorted keys, no spaces and text as it is."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def content_hash(value: object) -> str:
    return hashlib.sha256(canonical(value).encode("utf-8")).hexdigest()


def write_pair(spark: SparkSession, outputs: dict[str, DataFrame], folder: str, overwrite: bool = False) -> None:
    """Several tables as one publication: all are staged, then the folder is renamed; what stood there is kept until then."""
    if exists(spark, folder) and not overwrite:
        raise PublicationError(f"{folder} exists")
    staging, backup = (f"{folder.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("staging", "backup"))
    try:
        for name, df in outputs.items():
            df.write.json(f"{staging}/{name}", ignoreNullFields=False)
        if exists(spark, folder):
            rename(spark, folder, backup)
        try:
            rename(spark, staging, folder)
        except PublicationError:
            if exists(spark, backup):
                rename(spark, backup, folder)
            raise
    finally:
        for left in (staging, backup):
            remove(spark, left)


def publish_bundle(spark: SparkSession, root: str, key: str, payloads: dict[str, object], switch_current: bool = True) -> dict[str, object]:
    """Documents below root/bundles/key, once and for all, and a pointer to it.

    The same documents under the same key are accepted again; other documents under that key are an error.
    """
    hashes = {name: content_hash(value) for name, value in sorted(payloads.items())}
    folder = f"{root}/bundles/{key}"
    reused = exists(spark, f"{folder}/manifest.json")
    if reused:
        if json.loads(read_text(spark, f"{folder}/manifest.json")) != hashes:
            raise PublicationError(f"bundle {key} has other contents")
    else:
        staging = f"{root}/staging-{uuid.uuid4().hex}"
        for name, value in payloads.items():
            write_text(spark, f"{staging}/{name}.json", canonical(value))
        write_text(spark, f"{staging}/manifest.json", canonical(hashes))
        rename(spark, staging, folder)
    if switch_current:
        write_text(spark, f"{root}/CURRENT", key)
    return {"key": key, "hashes": hashes, "reused": reused}


def current_bundle(spark: SparkSession, root: str) -> str | None:
    return read_text(spark, f"{root}/CURRENT").strip() if exists(spark, f"{root}/CURRENT") else None


#: Texts that are encoded and committed together.
CHUNK_ROWS = 200_000


def encode_missing(texts: DataFrame, encode, path: str, identity: str, key: str = "id", text: str = "text", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Vectors of all texts, encoding only those that path/identity=... doesn't have yet.

    Texts are encoded chunk by chunk, and each chunk is committed before the next one starts: what a broken run has
    finished stays, and the next run goes on behind it.
    """
    spark = texts.sparkSession
    folder = f"{path}/identity={identity}"
    wanted = texts.withColumn("text_sha256", F.sha2(text, 256))

    def todo() -> DataFrame:
        return wanted.join(spark.read.parquet(folder).select(key, "text_sha256"), [key, "text_sha256"], "left_anti") if exists(spark, folder) else wanted

    chunks = max(1, -(-todo().count() // chunk_rows))
    for k in range(chunks):
        part = todo().filter(F.pmod(F.xxhash64(key), F.lit(chunks)) == k).select(*texts.columns)
        encode(part).withColumn("text_sha256", F.sha2(text, 256)).drop(text).write.mode("append").parquet(folder)
    return spark.read.parquet(folder).join(wanted.select(key, "text_sha256"), [key, "text_sha256"], "left_semi")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of every file, written out, so that it stays what it is now."""
    return stored(spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256")), "hashes")


def unchanged(spark: SparkSession, path: str, before: DataFrame | None = None) -> DataFrame:
    """SHA-256 of every file at path (see file_hashes); with `before`, an error if any file differs, is new or is gone."""
    now = file_hashes(spark, path)
    if before is not None and before.exceptAll(now).union(now.exceptAll(before)).limit(1).count():
        raise PublicationError(f"inputs at {path} changed")
    return now

"""Numbered manifests in a folder: who commits a number first has it, so two writers at once are told apart."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _files(spark: SparkSession, folder: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/manifests")
    return jvm, jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf) if path.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf), path.getFileSystem(conf), path


def latest(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """Number and content of the last manifest; (0, {}) where there is none."""
    jvm, _, fs, path = _files(spark, folder)
    if not fs.exists(path):
        return 0, {}
    numbers = [int(f.getPath().getName().removesuffix(".json")) for f in fs.listStatus(path) if f.getPath().getName()[0].isdigit()]
    return (max(numbers), read(spark, folder, max(numbers))) if numbers else (0, {})


def read(spark: SparkSession, folder: str, number: int) -> dict:
    """A manifest by its number."""
    return json.loads(spark.read.text(f"{folder}/manifests/{number:020d}.json", wholetext=True).first()[0])


def commit(spark: SparkSession, folder: str, number: int, content: dict) -> bool:
    """Makes content the manifest of that number, whole or not at all; False if another writer has the number.

    The text is written beside it and then renamed without overwriting, which is as atomic as the file system's rename.
    """
    jvm, context, fs, path = _files(spark, folder)
    fs.mkdirs(path)
    name = jvm.org.apache.hadoop.fs.Path
    draft, final = name(path, f".draft-{uuid.uuid4().hex}"), name(path, f"{number:020d}.json")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
    try:
        context.rename(context.makeQualified(draft), context.makeQualified(final), options)
        return True
    except Exception as e:
        if not fs.exists(final):
            raise
        if "FileAlreadyExists" not in str(e):
            raise
        fs.delete(draft, False)
        return False

"""Fitted models, kept by what they were fitted on: once per session, and in a folder where one is named.

``spark.loam.models.dir`` names a folder, shared by the drivers that use it, for models of later sessions; unset, models are
kept in memory only. The files are pickles, so the folder must be one that only trusted users write to.
"""

from __future__ import annotations

import gc
import hashlib
import pickle
from collections import OrderedDict
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Models a session keeps in memory, of different kinds.
KEPT = 3
_KEPT: OrderedDict[str, Any] = OrderedDict()


def signature(*tables: DataFrame) -> str | None:
    """A digest of the files that the tables are read from, with sizes and times of change; None if one has no files."""
    digest = hashlib.sha256()
    for table in tables:
        files = sorted(table.inputFiles())
        if not files:
            return None
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        for name in files:
            path = jvm.org.apache.hadoop.fs.Path(name)
            status = path.getFileSystem(conf).getFileStatus(path)
            digest.update(f"{name}\t{status.getLen()}\t{status.getModificationTime()}\n".encode())
    return digest.hexdigest()


def save_model(spark: SparkSession, model: Any, path: str) -> None:
    """Write a model to a path of any Hadoop file system: to a name of its own first, so that nobody reads half of it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{jvm.java.util.UUID.randomUUID()}")
    system = target.getFileSystem(conf)
    out = system.create(part, True)
    try:
        out.write(bytearray(pickle.dumps(model)))
    finally:
        out.close()
    system.delete(target, False)
    system.rename(part, target)


def load_model(spark: SparkSession, path: str) -> Any:
    """The model of a path; FileNotFoundError if there is none."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source = jvm.org.apache.hadoop.fs.Path(path)
    system = source.getFileSystem(conf)
    if not system.exists(source):
        raise FileNotFoundError(path)
    stream = system.open(source)
    try:
        return pickle.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def fitted(name: str, fit: Callable[..., Any], *tables: DataFrame) -> Any:
    """``fit(*tables)``, or what it gave before for tables of the same files. Of a kind (``name``) one model is kept in memory."""
    spark = tables[0].sparkSession
    of = signature(*tables)
    if of is None:
        return fit(*tables)
    key = f"{name}-{of[:32]}"
    if key in _KEPT:
        _KEPT.move_to_end(key)
        return _KEPT[key]
    folder = spark.conf.get("spark.loam.models.dir", None)
    model = None
    if folder:
        try:
            model = load_model(spark, f"{folder}/{key}.pickle")
        except FileNotFoundError:
            pass
    if model is None:
        # A model of the same kind for other files makes room first: the driver need not hold both.
        for other in [k for k in _KEPT if k.startswith(f"{name}-")]:
            del _KEPT[other]
        gc.collect()
        model = fit(*tables)
        if folder:
            save_model(spark, model, f"{folder}/{key}.pickle")
    _KEPT[key] = model
    while len(_KEPT) > KEPT:
        _KEPT.popitem(last=False)
    return model

"""Batches of bounded bytes for Python, and columns kept apart by name; tables are settled by ``loomtext.storage``."""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm import memory
from loomtext.storage import Scratch, discard, hadoop_path, settle, shared_folder  # noqa: F401


#: Bytes of rows that reach a Python worker at a time. Texts may be very long, so rows are no measure.
ARROW_BYTES = 2 << 20


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with batches of bounded bytes, whatever the length of the texts; workers give memory back."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))

    def frugal(batches):
        memory.large_arrays_apart()
        yield from run(batches)
        memory.trim()

    return df.mapInArrow(frugal, schema)


def aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all but the needed columns under names that clash with nothing, and what gives their names back.

    Columns go by their exact names, so one that differs in case only is an extra one.
    """
    names = docs.columns
    safe = [n if n in needed and names.index(n) == i else f"_extra_{i}" for i, n in enumerate(names)]
    return docs.toDF(*safe), lambda out: out.select(*safe).toDF(*names)


def only(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns alone."""
    return aside(docs, *needed)[0].select(*needed)


def kept_model(spark: SparkSession, name: str, learned_from: object, make: Callable[[], object]) -> object:
    """The model that ``make`` gives, trained once: it is kept in the shared folder under a hash of the rows and settings it is learned from.

    Training is a function of these alone, so a model that is there is the one that would be made. A file is renamed into its place when it is whole.
    """
    digest = hashlib.sha256(repr(learned_from).encode("utf-8", "surrogatepass")).hexdigest()[:32]
    fs, where = hadoop_path(spark, f"{shared_folder(spark)}/loomtext/models/{name}-{digest}")
    if fs.exists(where):
        stream = fs.open(where)
        try:
            return pickle.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()
    model = make()
    _, new = hadoop_path(spark, f"{shared_folder(spark)}/loomtext/models/.{uuid.uuid4().hex}")
    out = fs.create(new)
    out.write(bytearray(pickle.dumps(model)))
    out.close()
    if not fs.rename(new, where):  # another has kept it meanwhile
        fs.delete(new, False)
    return model

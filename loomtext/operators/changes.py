"""Documents and shares as a log of changes that is merged when it is read.

A change is a row: seq, kind, doc_id, by (who makes it), user_id, title, content. Kinds and what they ask for:

create    by becomes the document's creator; a later create of the same document does nothing
rename    by the creator; takes a title that is not empty, and always clears the share list
share     by the creator: user_id may read the document
unshare   by the creator: user_id may not
delete    by the creator: the document is gone, and later changes of it do nothing; by another, who leaves it

Batches of changes are appended and nothing else is written, so a rename touches neither the other documents nor their shares.
State is what sums over keys give: the least create and delete of a document, its last rename, the last change of each
(document, user). These are partial before they are shuffled, whatever the number of changes of one document.
``compact`` replaces a log by its rows that still decide something, and the state stays the same, also under changes
that come later. A version names the batches that count; of two writers one commits and the other raises.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.storage import commit_manifest, latest_manifest

COLUMNS = "seq long, kind string, doc_id long, by long, user_id long, title string, content string"
KINDS = ("create", "rename", "share", "unshare", "delete")


def effective(log: DataFrame) -> DataFrame:
    """The changes that count, with the document's creator and the seq of its creation: by one who may, after the create and not after the delete.

    Changes by others than the creator count if they are deletes: who makes one leaves the document.
    """
    made = log.filter("kind = 'create'").groupBy("doc_id").agg(F.min("seq").alias("created"), F.min_by("by", "seq").alias("creator"))
    known = log.join(made, "doc_id")
    own = known.filter((F.col("kind") == "delete") & (F.col("by") == F.col("creator")) & (F.col("seq") > F.col("created")))
    gone = own.groupBy("doc_id").agg(F.min("seq").alias("deleted"))
    first = (F.col("kind") == "create") & (F.col("seq") == F.col("created"))
    later = (F.col("kind") != "create") & (F.col("seq") > F.col("created")) & ((F.col("by") == F.col("creator")) | (F.col("kind") == "delete"))
    until = F.col("deleted").isNull() | (F.col("seq") <= F.col("deleted"))
    return known.join(gone, "doc_id", "left").filter((first | later) & until)


def documents(counted: DataFrame) -> DataFrame:
    """doc_id, title, creator, content, is_delete, cleared (the seq of the last rename) from effective changes."""
    named = (F.col("kind") == "create") | (F.col("kind") == "rename") & (F.coalesce(F.col("title"), F.lit("")) != "")
    return counted.groupBy("doc_id").agg(
        F.max_by(F.when(named, F.col("title")), F.when(named, F.col("seq"))).alias("title"), F.max("creator").alias("creator"), F.max(F.when(F.col("kind") == "create", F.col("content"))).alias("content"),
        F.max(F.when(F.col("deleted").isNull(), "0").otherwise("1")).alias("is_delete"), F.max(F.when(F.col("kind") == "rename", F.col("seq"))).alias("cleared"),
    )


def _last_of_users(counted: DataFrame) -> DataFrame:
    """doc_id, user_id and the last change of that user's access: seq, kind."""
    who = F.when(F.col("kind") == "delete", F.when(F.col("by") != F.col("creator"), F.col("by"))).when(F.col("kind").isin("share", "unshare"), F.col("user_id"))
    return counted.withColumn("user_id", who).filter("user_id is not null").groupBy("doc_id", "user_id").agg(F.max("seq").alias("seq"), F.max_by("kind", "seq").alias("kind"))


def shares(counted: DataFrame) -> DataFrame:
    """doc_id, user_id of the shares that stand: a user's last change is a share, and no rename has cleared it. Deleted documents keep theirs."""
    cleared = counted.groupBy("doc_id").agg(F.max(F.when(F.col("kind") == "rename", F.col("seq"))).alias("cleared"))
    last = _last_of_users(counted).filter("kind = 'share'").join(cleared, "doc_id")
    return last.filter(F.col("cleared").isNull() | (F.col("seq") > F.col("cleared"))).select("doc_id", "user_id")


def notices_left(notices: DataFrame, docs: DataFrame) -> DataFrame:
    """Notices without those of deleted documents."""
    return notices.join(docs.filter("is_delete = '1'").select("doc_id"), "doc_id", "left_anti")


def compacted(log: DataFrame) -> DataFrame:
    """The changes that still decide something: a document's create, its last rename and last title, its delete, and the last change of each user since the last rename."""
    counted = effective(log)
    change = F.struct("seq", "kind", "doc_id", "by", "user_id", "title", "content")
    last = lambda when: F.max_by(F.when(when, change), F.when(when, F.col("seq")))
    renamed = F.col("kind") == "rename"
    own = counted.groupBy("doc_id").agg(
        F.array(last(F.col("kind") == "create"), last(renamed), last(renamed & (F.coalesce(F.col("title"), F.lit("")) != "")), last((F.col("kind") == "delete") & (F.col("by") == F.col("creator")))).alias("c")
    )
    own = own.select(F.explode(F.filter(F.array_distinct("c"), lambda c: c.isNotNull())).alias("c")).select("c.*")
    standing = shares(counted).withColumn("standing", F.lit(True))
    users = _last_of_users(counted).filter("kind = 'share'").join(standing, ["doc_id", "user_id"], "left_semi")
    by = counted.groupBy("doc_id").agg(F.max("creator").alias("by"))
    users = users.join(by, "doc_id").select("seq", "kind", "doc_id", "by", "user_id", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("content"))
    return own.unionByName(users)


class ChangeLog:
    """A log under a path, as one version of its manifest has it."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.spark, self.path, self.manifest = spark, path, manifest

    @staticmethod
    def open(spark: SparkSession, path: str) -> ChangeLog:
        """The latest version; an empty log where there is none."""
        return ChangeLog(spark, path, latest_manifest(spark, path) or {"version": 0, "batches": [], "compacted": None})

    def _written(self, rows: DataFrame) -> str:
        name = f"b-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/log/{name}")
        return name

    def _commit(self, **changes) -> ChangeLog:
        return ChangeLog(self.spark, self.path, commit_manifest(self.spark, self.path, self.manifest | changes))

    def rows(self) -> DataFrame:
        """The changes of all batches."""
        read = [self.spark.read.schema(COLUMNS).parquet(f"{self.path}/log/{b}") for b in self.manifest["batches"]]
        return reduce(DataFrame.unionByName, read) if read else self.spark.createDataFrame([], COLUMNS)

    def append(self, changes: DataFrame) -> ChangeLog:
        """Adds a batch. Kinds are checked, and no seq may be from before the last compaction, which has forgotten what it would meet."""
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        rows = changes.select(*(F.col(c) if c in changes.columns else F.lit(None).alias(c) for c in names))
        rows = rows.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in COLUMNS.split(", ")))
        name = self._written(rows)
        batch = self.spark.read.schema(COLUMNS).parquet(f"{self.path}/log/{name}")
        least, odd = batch.agg(F.min("seq"), F.count_if(~F.col("kind").isin(*KINDS) | F.col("kind").isNull() | F.col("seq").isNull())).first()
        if odd:
            raise ValueError(f"{odd} changes have no seq or are of no kind of {', '.join(KINDS)}")
        if least is not None and self.manifest["compacted"] is not None and least <= self.manifest["compacted"]:
            raise ValueError(f"seq {least} is not after {self.manifest['compacted']}, to which the log is compacted")
        return self._commit(batches=[*self.manifest["batches"], name])

    def compact(self) -> ChangeLog:
        """The log as one batch of what still decides something."""
        last = self.rows().agg(F.max("seq")).first()[0]
        return self._commit(batches=[self._written(compacted(self.rows()))], compacted=last)

    def documents(self) -> DataFrame:
        return documents(effective(self.rows())).drop("cleared")

    def shares(self) -> DataFrame:
        return shares(effective(self.rows()))

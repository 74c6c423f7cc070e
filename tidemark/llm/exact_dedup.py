"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to
one row per digest before anything is shuffled (so a group of copies, however
large, costs one row per map task), anti-joined with the index by sort-merge on
the bucketing, and what is new is appended.

Semantics
* Texts are equal when their UTF-8 bytes are identical; a null text counts as the
  empty text.
* Of equal texts in a batch the row with the largest ``doc_id`` stays, unless the
  index already holds the digest: then the indexed row stays and the whole batch
  group goes.
* Rows that repeat a ``doc_id`` with the same text are one document: all of them
  carry the same decision. A null ``doc_id`` never beats a number; a new group with
  only null ids has a null ``keep_id`` and is kept. Once it is in the index, later rows
  with its text go like any others, and their ``keep_id`` is null.
* An empty batch gives no rows and leaves the index as it was. Columns other than
  the id and the text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import delete, file_system, new_path
from .work import discard, key_and_text, materialize

#: A digest with this share of a batch, or more, is finished by a broadcast instead of a
#: shuffle; at most 1/HOT_SHARE digests can have it, so the broadcast is bounded.
HOT_SHARE = 1 / 2000
HOT_LEAST = 64
#: About 160 MB of digests and ids in a bucket.
BUCKET_ROWS, LEAST_BUCKETS = 4_000_000, 32
#: Every append adds a file to each bucket, and a bucket of several files is sorted when it is read; beyond this many they are merged.
MOST_FILES = 8


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest`` (32 bytes) for every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return key_and_text(docs, id_col, text_col).select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"))


class DigestIndex:
    """A digest index in the folder ``path``: Parquet, bucketed and sorted by digest.

    A version of it is a folder ``vN-bB`` of B buckets; the newest one with a _SUCCESS mark counts, so
    another session finds what an earlier one has written. ``compact`` writes the next version.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or new_path(spark, "digest-index")
        self.table: str | None = None
        found = self._newest()
        if found:
            self._open(*found)
        elif buckets:
            self._open(0, buckets)

    def _newest(self) -> tuple[int, int] | None:
        root, fs = file_system(self.spark, self.path)
        if not fs.exists(root):
            return None
        at = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        whole = [n for n in names if n.startswith("v") and fs.exists(at(f"{self.path}/{n}/_SUCCESS"))]
        return max((tuple(int(x) for x in n[1:].split("-b")) for n in whole), default=None)

    def _open(self, version: int, buckets: int) -> None:
        self.version, self.buckets = version, buckets
        self.location = f"{self.path}/v{version}-b{buckets}"
        self.table = f"tidemark_index_{_slug(self.location)}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.location}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Digests of the batch (one row each) that the index lacks: a sort-merge anti-join on its buckets."""
        return batch.hint("merge").join(self.read().select("digest"), "digest", "left_anti")

    def append(self, new: DataFrame) -> None:
        """Add ``digest, keep_id`` rows, one sorted file a bucket."""
        rows = new.select("digest", "keep_id").repartition(self.buckets, "digest").sortWithinPartitions("digest")
        rows.write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def files_a_bucket(self) -> float:
        at, fs = file_system(self.spark, self.location)
        return sum(s.getPath().getName().startswith("part-") for s in fs.listStatus(at)) / self.buckets if fs.exists(at) else 0.0

    def compact(self, buckets: int | None = None) -> None:
        """Write the index anew with one sorted file a bucket, in as many buckets as its size asks for."""
        old, old_table, old_location = self.read(), self.table, self.location
        self._open(self.version + 1, buckets or max(self.buckets, buckets_for(old.count())))
        self.append(old)
        self.spark.sql(f"DROP TABLE IF EXISTS {old_table}")
        delete(self.spark, old_location)

    def close(self) -> None:
        """Forget the catalog's entry; the files stay for the next session."""
        if self.table:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
            self.table = None

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Decide every row of ``docs`` and append what is new.

        Returns ``doc_id, keep_id, group_size, kept, digest``, one row per input row.
        """
        rows = materialize(digests(docs, id_col, text_col), "digests")
        groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        groups = materialize(groups, "digest-groups")
        if self.table is None:
            self._open(0, buckets_for(groups.count()))
        # What the anti-join lets through stays and is appended; the rest meets the row the index has.
        new = materialize(self.unseen(groups).withColumn("is_new", F.lit(True)), "new-digests")
        index = self.read().withColumnRenamed("keep_id", "known_id")
        old = groups.hint("merge").join(index, "digest").select("digest", F.col("known_id").alias("keep_id"), "group_size", F.lit(False).alias("is_new"))
        decided = materialize(new.unionByName(old), "digest-decisions")
        self.append(new)
        if self.files_a_bucket() > MOST_FILES:
            self.compact()
        discard(groups, new)
        return _decide(rows, decided)


def buckets_for(n: int) -> int:
    """Buckets of an index of ``n`` digests: a power of two, with up to ``BUCKET_ROWS`` digests each."""
    buckets = LEAST_BUCKETS
    while buckets * BUCKET_ROWS < n:
        buckets *= 2
    return buckets


def _slug(path: str) -> str:
    import hashlib

    return hashlib.md5(path.encode()).hexdigest()


def _decide(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """Give each row its group's decision; groups above HOT_SHARE take the bounded broadcast."""
    total = rows.count()
    # Disjoint groups of at least this size: there are at most 1 / HOT_SHARE of them.
    least = max(HOT_LEAST, math.ceil(total * HOT_SHARE))
    hot = decided.filter(F.col("group_size") >= least)
    cold = decided.filter(F.col("group_size") < least)
    hot = F.broadcast(hot.select("digest", F.struct("keep_id", "group_size", "is_new").alias("hot")))
    marked = rows.join(hot, "digest", "left")
    done = marked.filter(F.col("hot").isNotNull()).select("doc_id", "digest", "hot.*")
    rest = marked.filter(F.col("hot").isNull()).select("doc_id", "digest").join(cold, "digest").select("doc_id", "digest", "keep_id", "group_size", "is_new")
    kept = F.col("is_new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return done.unionByName(rest).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicate ``docs`` against ``index``, or against a new empty one, which goes afterwards."""
    if index is not None:
        return index.dedup(docs, id_col, text_col)
    index = DigestIndex(docs.sparkSession)
    out = index.dedup(docs, id_col, text_col)
    index.close()
    delete(docs.sparkSession, index.path)
    return out


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

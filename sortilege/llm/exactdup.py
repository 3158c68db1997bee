"""Exact deduplication by keyed streaming state.

A stream of digests keeps, for each digest and without expiry, the stable
identifier and the content locator of the row that stays. The state lives in a
disk-backed store in a folder that outlives the query: rows that come later meet the digests of all rows
before, whose texts are not read again. The aggregation combines on the map side, so thousands of
copies reach the store as a few rows. Digests seen more than once are then
checked on the full bytes, which an earlier row's locator leads to.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, numbered

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # a store takes local disk only while its task runs
    # All stores of an executor share one small cache and small write buffers, as each lives for a task only.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "32",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}
#: Micro-batches in which one call's digests go through the state.
BATCHES = 2
#: Repeated digests are sent to every executor up to so many rows of about 100 bytes; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def normalised(text: Column) -> Column:
    """Runs of white space become one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def locator(docs: DataFrame) -> Column | None:
    """Where a row's content lies: file and row number of a bare file scan; None for anything else."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return None
    return F.concat(F.col("_metadata.file_path"), F.lit("#"), F.col("_metadata.row_index").cast("string"))


def content_at(spark: SparkSession, located: DataFrame) -> DataFrame:
    """Adds norm to rows that have a `locator`, from the files that these name. Only those files are read."""
    at = located.select("*", F.regexp_replace("locator", "#[0-9]+$", "").alias("file_"), F.substring_index("locator", "#", -1).cast("long").alias("row_"))
    files = [r[0] for r in at.select("file_").distinct().collect()]  # as many as files with a hit
    if not files:
        return located.withColumn("norm", F.lit(None).cast("string"))
    rows = spark.read.parquet(*files).select(F.col("_metadata.file_path").alias("f_"), F.col("_metadata.row_index").alias("i_"), normalised(F.col("text")).alias("norm"))
    return at.join(rows, (F.col("file_") == F.col("f_")) & (F.col("row_") == F.col("i_"))).select(*located.columns, "norm")


class Ledger:
    """What has been seen so far, in a folder: digests of all rows, the keyed state, and its changes by call.

    The number of the state's partitions is that of the session's shuffle partitions at the first call, and stays.
    """

    def __init__(self, spark: SparkSession, folder: str, digest=sha256) -> None:
        self.spark, self.folder, self.digest = spark, folder, digest
        self.own = spark.newSession()  # so that the caller's settings stay as they are
        for k, v in ROCKSDB.items():
            self.own.conf.set(k, v)
        self.own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))

    def _stream(self, digests: DataFrame, call: str, files_per_batch: int | None) -> DataFrame:
        """Sends the digests of this call, which lie in the folder, through the state; (digest, keep_id, keep_locator, group_size) of the keys that it changed.

        Each micro-batch writes its changes under its own number, so a repeated batch overwrites
        itself; values only fall (keep_id) or rise (group_size), so their extremes
        over the batches are the final ones.
        """
        if not files_per_batch:
            files_per_batch = max(1, -(-len(digests.inputFiles()) // BATCHES))
        reader = self.own.readStream.schema(digests.schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator")).alias("first")
        state = reader.parquet(f"{self.folder}/digests").groupBy("digest").agg(first, F.count(F.lit(1)).alias("group_size"))
        out = f"{self.folder}/changes/{call}"
        query = (
            state.writeStream.outputMode("update")
            .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
            .option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        # So that the folder is a table even if no batch ran. Rows made by the driver's Python would start a second set of workers in each executor.
        none = self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in state.schema])
        none.write.parquet(f"{out}/batch=-1")
        last = self.spark.read.schema(state.schema).parquet(out).groupBy("digest").agg(F.min("first").alias("first"), F.max("group_size").alias("group_size"))
        return last.select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.locator").alias("keep_locator"), "group_size")

    def add(self, docs: DataFrame, files_per_batch: int | None = None) -> DataFrame:
        """Takes in docs and returns one row for each: doc_id, keep_id, group_size, kept, text_sha256, keep_locator, as all rows seen so far have it.

        Rows of earlier calls count, though their texts are not read again but where a digest is hit: then the text
        that its locator names is compared. Docs that are no bare scan of files are written to the folder first, so that they
        can be found again. A row with a smaller id than an earlier one's takes its place from now on.
        """
        call = uuid.uuid4().hex
        where = locator(docs)
        if where is None:
            docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).write.parquet(f"{self.folder}/rows/{call}")
            docs = self.spark.read.schema("doc_id long, text string").parquet(f"{self.folder}/rows/{call}")
            where = locator(docs)
        norm = docs.select("doc_id", normalised(F.col("text")).alias("norm"), where.alias("locator")).withColumn("digest", self.digest(F.col("norm")))
        path = f"{self.folder}/digests/{call}"
        made = norm.select("digest", "doc_id", "locator")
        made.write.parquet(path)
        digests = self.spark.read.schema(made.schema).parquet(path)
        keepers = self._stream(digests, call, files_per_batch)
        keepers.write.parquet(f"{self.folder}/keepers/{call}")
        keepers = self.spark.read.schema(keepers.schema).parquet(f"{self.folder}/keepers/{call}")

        repeated = keepers.filter("group_size > 1").select(F.col("digest").alias("r_digest"), F.col("keep_locator").alias("r_locator"))
        hits = norm.join(_small(repeated), F.col("digest") == F.col("r_digest")).select("digest", "norm", F.col("locator"), "r_locator")
        # Keepers of earlier calls are read from where they lie.
        mine = digests.select(F.col("locator").alias("l"))
        before = keepers.filter("group_size > 1").select("digest", F.col("keep_locator").alias("locator")).join(mine, F.col("locator") == F.col("l"), "left_anti") if self.earlier(call) else None
        if before is not None:
            hits = hits.unionByName(content_at(self.spark, before).select("digest", "norm", "locator", F.col("locator").alias("r_locator")))
        # Grouping by the text itself compares whole byte strings, after copies have met within their tasks. A digest is
        # clean if it has one text, and if the content that the state's locator names is among that text's rows.
        by_bytes = hits.groupBy("digest", "norm").agg(F.max((F.col("locator") == F.col("r_locator")).cast("int")).alias("held"))
        clashes = by_bytes.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.min("held").alias("held")).filter("texts > 1 OR held = 0")
        clashes.select("digest").write.parquet(f"{self.folder}/clashes/{call}")
        clashes = self.spark.read.schema("digest string").parquet(f"{self.folder}/clashes/{call}")

        found = digests.join(keepers, "digest")
        hash_ = F.col("digest") if self.digest is sha256 else F.lit(None).cast("string")
        plain = found.select("doc_id", "keep_id", "group_size", hash_.alias("text_sha256"), "keep_locator", "digest")
        if clashes.isEmpty():
            clear = plain.drop("digest")
        else:  # all rows ever seen with such a digest are told apart by their bytes
            seen = self.spark.read.schema(digests.schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/digests").join(clashes, "digest", "left_semi")
            groups = content_at(self.spark, seen).groupBy(F.col("norm").alias("b_norm")).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            again = norm.join(clashes, "digest", "left_semi").join(groups, F.col("norm") == F.col("b_norm"))
            again = again.select("doc_id", "keep_id", "group_size", sha256(F.col("norm")).alias("text_sha256"), F.lit(None).cast("string").alias("keep_locator"))
            clear = plain.join(clashes, "digest", "left_anti").drop("digest").unionByName(again)
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
        return clear.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "keep_locator")

    def earlier(self, call: str) -> bool:
        """Whether other calls came before."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/keepers")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return any(f.getPath().getName() != call for f in fs.listStatus(path))


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def find_copies(docs: DataFrame, digest=sha256, files_per_batch: int | None = None, folder: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, keep_locator.

    Texts are equal when their normalised forms are; null counts as empty. The
    row with the smallest doc_id stays; a null doc_id stays only if its whole
    group has none. Rows that repeat the id that stays are all marked kept. An
    empty table gives no rows; other columns are ignored; texts of any length are hashed and compared whole. `digest` may be any
    function of the text: rows whose digests agree but whose bytes do not are
    grouped by their bytes. With a `folder` the state stays there, and a later call's rows meet these;
    without one it is dropped once the decisions are made.
    """
    if folder:
        return Ledger(docs.sparkSession, folder, digest).add(docs, files_per_batch)
    scratch = Scratch(docs.sparkSession, "exactdup")
    found = Ledger(docs.sparkSession, scratch.path("ledger"), digest).add(docs, files_per_batch)
    scratch.drop("ledger/state", "ledger/changes")
    return found


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns, whatever these are named.

    Decisions travel by id and digest, so of an id with different texts each text
    has its own. Of rows that repeat both the id and the text that stay, one
    stays, as it does of a group without any id. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "exactdup-rows")
    found = scratch.save(find_copies(docs).select("doc_id", "kept", "text_sha256"), "found")
    gone = found.filter("NOT kept").select(F.col("doc_id").alias("g_id"), F.col("text_sha256").alias("g_sha")).distinct()
    gone = scratch.save(gone, "gone")
    again = found.filter("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = scratch.save(again.select(F.col("doc_id").alias("g_id"), F.col("text_sha256").alias("g_sha")), "again")
    own, name = numbered(docs)
    own = own.withColumn("sha_", sha256(normalised(F.col(name["text"]))))
    same = F.col(name["doc_id"]).eqNullSafe(F.col("g_id")) & (F.col("sha_") == F.col("g_sha"))
    left = own.join(_small(gone), same, "left_anti")
    if not again.isEmpty():
        few = _small(again)
        once = left.join(few, same, "left_semi").dropDuplicates([name["doc_id"], "sha_"])
        left = left.join(few, same, "left_anti").unionByName(once)
    return left.drop("sha_").toDF(*docs.columns)

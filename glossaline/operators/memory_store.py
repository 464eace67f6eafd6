"""A stored translation memory: a partitioned base, small deltas beside it, merged when read.

``base/bucket=k`` holds the entries whose key hashes to k; ``deltas/batch=n`` holds what changed in the
n-th change: the last save per key, hits per key, or removed keys (tombstones), by bucket too.  Saving one
per cent of a large memory writes one per cent of it; nothing is rewritten until :func:`compact`, which
folds the deltas into the buckets they touch, by dynamic partition overwrite, and leaves all other
buckets as they are.

Reading folds each key's changes, in order of their batch, onto its entry.  Entries of buckets that no
delta touches pass by without a shuffle.  A new key gets the next free id, in order of batch and first
save; ids are never given again, because removed entries stay in the base as empty rows.  An entry of
the base knows the last batch folded into it, so deltas that a broken compaction left behind change
nothing when they are read again; a change that is written again overwrites its own batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.ordered import number_rows
from ..session import discard, materialize
from .memory import KEY, acceptable, with_key

TEXTS = ["source_text", "translated_text", "provider", "model"]
ENTRY = ["id", *KEY, *TEXTS, "created_at", "updated_at", "hit_count"]
BASE = (
    "id BIGINT, source_lang STRING, target_lang STRING, source_text_hash STRING, source_text STRING, translated_text STRING, provider STRING, model STRING, "
    "created_at TIMESTAMP, updated_at TIMESTAMP, hit_count BIGINT, batch BIGINT, deleted BOOLEAN, bucket INT"
)
DELTA = (
    "source_lang STRING, target_lang STRING, source_text_hash STRING, op STRING, source_text STRING, translated_text STRING, provider STRING, model STRING, "
    "at TIMESTAMP, first_at TIMESTAMP, first_no STRING, hits BIGINT, batch BIGINT, bucket INT"
)
SAVE, HIT, REMOVE = "save", "hit", "remove"


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")


def create(tm: DataFrame, path: str, buckets: int = 64) -> None:
    """Write a memory as the base of a new store."""
    rows = tm.select(*ENTRY).withColumns({"batch": F.lit(0).cast("bigint"), "deleted": F.lit(False), "bucket": bucket_of(buckets)})
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/base")
    tm.sparkSession.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{path}/layout")


def _base(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BASE).parquet(f"{path}/base")


def _deltas(spark: SparkSession, path: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/deltas")
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        return spark.createDataFrame([], DELTA)
    return spark.read.schema(DELTA).parquet(f"{path}/deltas")


def _buckets(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/layout").first()["buckets"]


def _write(changes: DataFrame, path: str, batch: int) -> None:
    spark = changes.sparkSession
    known = {f.name for f in changes.schema}
    names = [f for f in spark.createDataFrame([], DELTA).schema if f.name not in ("batch", "bucket")]
    whole = changes.select(*[F.col(f.name) if f.name in known else F.lit(None).cast(f.dataType).alias(f.name) for f in names])
    placed = whole.withColumn("bucket", bucket_of(_buckets(spark, path)))
    placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/deltas/batch={batch}")


def save(incoming: DataFrame, path: str, batch: int) -> None:
    """Add saves (as for :func:`memory.upsert`) as one delta: the last one per key, and when the first came."""
    keyed = with_key(acceptable(incoming), "source_text")
    order = F.struct("saved_at", "save_no")
    latest = keyed.groupBy(*KEY).agg(F.max_by(F.struct(*TEXTS, "saved_at"), order).alias("_s"), F.min(order).alias("_f"))
    unknown = F.lit("unknown")
    _write(latest.select(
        *KEY, F.lit(SAVE).alias("op"), F.col("_s.source_text").alias("source_text"), F.col("_s.translated_text").alias("translated_text"),
        F.coalesce(F.nullif("_s.provider", F.lit("")), unknown).alias("provider"), F.coalesce(F.nullif("_s.model", F.lit("")), unknown).alias("model"),
        F.col("_s.saved_at").alias("at"), F.col("_f.saved_at").alias("first_at"), F.col("_f.save_no").cast("string").alias("first_no"),
    ), path, batch)


def hit(hits: DataFrame, path: str, batch: int, at: str = "looked_up_at") -> None:
    """Add the hits of a lookup (rows with a key and a found ``tm_id``) as one delta."""
    found = hits.filter(F.col("tm_id").isNotNull()).groupBy(*KEY).agg(F.count("*").alias("hits"), F.max(at).alias("at"))
    _write(found.withColumn("op", F.lit(HIT)), path, batch)


def remove(spark: SparkSession, path: str, ids: DataFrame, batch: int) -> None:
    """Add tombstones for the entries of these ids."""
    gone = read(spark, path).select("id", *KEY).join(ids.select("id").distinct(), "id", "left_semi")
    _write(gone.select(*KEY, F.lit(REMOVE).alias("op")), path, batch)


def _folded(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """Entries and tombstones of the touched buckets after all changes, with ``born``: when each new incarnation of the key began."""
    held = ["id", *TEXTS, "created_at", "updated_at", "hit_count", "batch", "deleted"]
    change = F.struct("batch", "op", *TEXTS, "at", "first_at", "first_no", "hits")
    nothing = deltas.select(change.alias("c")).schema["c"].dataType
    entry = base.select(*KEY, "bucket", F.struct(*held).alias("b"), F.lit(None).cast(nothing).alias("c"))
    changes = deltas.select(*KEY, "bucket", F.lit(None).cast(entry.schema["b"].dataType).alias("b"), change.alias("c"))
    # A key has one row in the base and at most one in each delta.
    met = entry.unionByName(changes).groupBy(*KEY, "bucket").agg(F.max("b").alias("b"), F.sort_array(F.collect_list("c")).alias("changes"))
    births = "array<struct<batch:bigint,first_at:timestamp,first_no:string>>"

    def state(**values: Column) -> Column:
        return F.struct(*[values[n].alias(n) for n in (*TEXTS, "created_at", "updated_at", "hit_count", "deleted", "batch", "born")])

    none = F.lit(None)
    start = state(
        **{n: F.col(f"b.{n}") for n in (*TEXTS, "created_at", "updated_at")}, hit_count=F.coalesce("b.hit_count", F.lit(0).cast("bigint")),
        deleted=F.coalesce("b.deleted", F.lit(True)), batch=F.coalesce("b.batch", F.lit(-1).cast("bigint")), born=F.array().cast(births),
    )

    def step(s: Column, c: Column) -> Column:
        saved = state(
            **{n: c[n] for n in TEXTS}, created_at=F.when(s["deleted"], c["first_at"]).otherwise(s["created_at"]), updated_at=c["at"],
            hit_count=F.when(s["deleted"], F.lit(0).cast("bigint")).otherwise(s["hit_count"]), deleted=F.lit(False), batch=c["batch"],
            born=F.when(s["deleted"], F.concat(s["born"], F.array(F.struct(c["batch"].alias("batch"), c["first_at"].alias("first_at"), c["first_no"].alias("first_no"))))).otherwise(s["born"]),
        )
        used = state(
            **{n: s[n] for n in (*TEXTS, "created_at", "deleted", "born")}, updated_at=F.when(s["deleted"], s["updated_at"]).otherwise(F.greatest(s["updated_at"], c["at"])),
            hit_count=F.when(s["deleted"], s["hit_count"]).otherwise(s["hit_count"] + c["hits"]), batch=c["batch"],
        )
        removed = state(
            **{n: none.cast("string") for n in TEXTS}, created_at=none.cast("timestamp"), updated_at=s["updated_at"], hit_count=F.lit(0).cast("bigint"),
            deleted=F.lit(True), batch=c["batch"], born=s["born"],
        )
        return F.when(c["batch"] <= s["batch"], s).when(c["op"] == SAVE, saved).when(c["op"] == HIT, used).otherwise(removed)

    done = met.withColumn("s", F.aggregate("changes", start, step))
    return done.select(*KEY, "bucket", F.col("b.id").alias("id"), "s.*")


def _merged(spark: SparkSession, path: str, deltas: DataFrame) -> tuple[DataFrame, list[int]]:
    """The touched buckets after all changes, ids given, and which buckets those are."""
    touched = sorted(r["bucket"] for r in deltas.select("bucket").distinct().collect())  # at most one row per bucket
    base = _base(spark, path)
    done = materialize(_folded(base.filter(F.col("bucket").isin(touched)), deltas), "memory-folded")
    births = done.filter(F.size("born") > 0).select(*KEY, F.posexplode("born").alias("nth", "birth"), F.size("born").alias("of"))
    numbered = number_rows(births.select(*KEY, "birth.*", (F.col("nth") + 1 == F.col("of")).alias("last")), [], ["batch", "first_at", "first_no", *KEY], "next")
    top = base.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("top"))
    fresh = numbered.filter("last").select(*KEY, (top.scalar() + F.col("next")).alias("new_id"))
    return done.join(fresh, KEY, "left").withColumn("id", F.coalesce("new_id", "id")).drop("new_id", "born"), touched


def read(spark: SparkSession, path: str) -> DataFrame:
    """The memory with all changes."""
    deltas = _deltas(spark, path)
    base = _base(spark, path)
    if deltas.isEmpty():
        return base.filter(~F.col("deleted")).select(*ENTRY)
    merged, touched = _merged(spark, path, deltas)
    untouched = base.filter(~F.col("bucket").isin(touched) & ~F.col("deleted")).select(*ENTRY)
    return untouched.unionByName(merged.filter(~F.col("deleted")).select(*ENTRY))


def compact(spark: SparkSession, path: str) -> list[int]:
    """Fold all deltas into the buckets they touch, and drop them; returns those buckets."""
    deltas = _deltas(spark, path)
    batches = [r["batch"] for r in deltas.select("batch").distinct().collect()]
    if not batches:
        return []
    merged, touched = _merged(spark, path, deltas)
    # Written beside the base first: the rewrite reads what it replaces.
    staged = materialize(merged.select(*[c for c in _base(spark, path).columns]), "memory-compacted")
    staged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/base")
    discard(staged)
    for batch in batches:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/deltas/batch={batch}")
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
    return touched

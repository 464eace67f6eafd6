"""A corpus pipeline over ``documents``: language, toxicity, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, folder) and works on all that the stage before kept.  All but the last
return the columns of ``documents``; :func:`run` writes every stage's result to the shared folder and
reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from glossaline.llm import bpe, langid, minhash, mixing, toxicity
from glossaline.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_COVERAGE = 0.25  # share of a text's n-grams that its language holds
TOXIC = 0.7
SHARDS = 16

#: SQL has neither the filters, the samples nor the tokens; tests compare near-duplicates, mix and tokens with plain versions on all given
#: documents, and the language and toxicity operators with theirs on fixtures.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops null texts, texts without letters, and texts in none of the languages of the table."""
    found = langid.predict(docs.select(*COLUMNS), langid.fit(docs))
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_coverage") >= MIN_COVERAGE)).select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops texts that score as toxic by the labelled ones among them."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = toxicity.score(docs.select(*COLUMNS), toxicity.fit(docs, labels))
    return scored.filter(F.col("toxic_score") < TOXIC).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps exactly the rows that the operator keeps, found again by a hash of id and text."""
    found = materialize(minhash.keyed_classes(docs), "near-duplicates")
    # Of rows equal in id and text all are kept (texts without words) or at most one.
    rows = found.groupBy("doc_id", "same").agg(F.count_if("kept").alias("kept"), F.count("*").alias("n")).filter("kept > 0")
    rows = rows.select(F.col("doc_id").alias("kept_id"), F.col("same").alias("kept_same"), "kept", "n")
    whole = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("same"))
    kept = whole.join(rows, (F.col("same") == F.col("kept_same")) & F.col("doc_id").eqNullSafe(F.col("kept_id")))
    return kept.filter("kept = n").select(*COLUMNS).unionByName(kept.filter("kept < n").select(*COLUMNS).dropDuplicates(["doc_id", "text"]))


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row for each run of words that the mix takes: whole texts but where a source's share or a shard ends.

    Rows are slim until the texts join by id and hash.  Equal rows are counted and numbered, each takes
    its own place in the mix, and one of them lends its text to all.
    """
    row = F.xxhash64(*COLUMNS)
    sizes = mixing.sized(docs.select(*COLUMNS, row.alias("hash")), keep=("doc_id", "hash")).filter("size > 0")
    equal = sizes.groupBy("doc_id", "hash", "source", "size").agg(F.count("*").alias("n"))
    numbered = equal.withColumn("number", F.explode(F.sequence(F.lit(1), F.col("n"))))
    rows = materialize(numbered.withColumn("key", F.xxhash64("doc_id", "hash", "number")), "mix-sizes")
    taken = mixing.mix(rows, mixing.targets(rows), SHARDS, keep=("doc_id", "number"))
    pieces = materialize(taken.select(F.col("doc_id").alias("id"), F.col("hash").alias("of"), "n", "size", F.explode("pieces").alias("p")), "mix-pieces")
    whole = docs.select(*COLUMNS, row.alias("hash"))
    repeated = whole.join(rows.filter("n > 1").select("hash").distinct(), "hash", "left_semi").dropDuplicates(["hash"])

    def met(texts: DataFrame, some: DataFrame) -> DataFrame:
        return texts.join(some, (F.col("hash") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id"))).select(*COLUMNS, "p", "size")

    joined = met(whole, pieces.filter("n = 1")).unionByName(met(repeated, pieces.filter("n > 1")))
    text = mixing.cut(F.col("text"), F.col("p.first"), F.col("p.words"), F.col("size"))
    return joined.withColumn("text", text).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Adds the packed token ids, their number, and whether they decode to the text."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.decode(bpe.encode(docs.select(*COLUMNS), ranks, public_tokenizers.PATTERN), ranks)
    return coded.withColumns({"n_tokens": bpe.count(), "exact": F.col("decoded") == F.encode("text", "UTF-8")}).drop("decoded")


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("mix", mixed), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

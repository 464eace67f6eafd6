"""The operators over the given tables, and SQL twins where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize
from . import bpe, hnsw, html_templates, langid, maxent, minhash, mixing, pivots, preference, sharding, toxicity, turn_repair, vectors, whitening
from .common import fold, in_fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_minhash")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.classes(table(spark, folder, "documents"))


@query("op2_toxicity")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").filter(fold("doc_id", 3) != 1)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select(
        "doc_id", in_fold("doc_id", 3, 1).alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.7).cast("int").alias("predicted"), F.size("toxic_evidence").alias("n_neighbours"),
        F.try_element_at("toxic_evidence", F.lit(1))["example"].alias("nearest_id"),
    )


@query("op3_hnsw_search")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    asked = vectors.valid(rows.filter(F.col("vec_id") % 20 == 0)).select(F.col("vec_id").alias("query_id"), "embedding")
    return hnsw.search(hnsw.index(rows), asked)


@query("op4_language_id")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    filters = langid.fit(docs.filter(fold("doc_id", 5) != 0))
    return langid.predict(docs.select("doc_id", "text"), filters).select(
        "doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_coverage").alias("coverage")
    )


@query("op5_pivot_neardup")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, folder, "embeddings"))


@query("op6_mix_sources")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialize(mixing.sized(table(spark, folder, "documents")), "mix-sizes")
    mixed = mixing.mix(rows, mixing.targets(rows))
    return mixed.select("doc_id", "size", "source_size", "target", mixing.taken().alias("taken"))


def _rendered(turns: str) -> str:
    return f"coalesce(array_to_string(list_transform({turns}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '')"


def _span_text(turns: str) -> str:
    ends = f"list_transform({turns}, lambda t, i: list_sum(list_transform({turns}[1:i], lambda u: length(u.role) + length(u.text) + 13)))"
    spans = f"list_transform({turns}, lambda t, i: CASE WHEN t.role = 'assistant' THEN CAST({ends}[i] - length(t.text) - 8 AS BIGINT) || '-' || CAST({ends}[i] AS BIGINT) END)"
    return f"coalesce(array_to_string(list_filter({spans}, lambda s: s IS NOT NULL), ','), '')"


@query("op7_preference_pairs", f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
a AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS k FROM t WHERE role = 'assistant'),
l AS (SELECT conv_id, max(turn) FILTER (k = 1) AS last_turn, max(text) FILTER (k = 2) AS stale, count(*) AS n FROM a WHERE k <= 2 GROUP BY conv_id),
r AS (SELECT t.conv_id, turn, role, CASE WHEN role = 'assistant' AND turn = last_turn THEN stale ELSE text END AS text
      FROM t LEFT JOIN l USING (conv_id) WHERE NOT coalesce(role = 'assistant' AND turn = last_turn AND n = 1, false)),
cl AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS c FROM t GROUP BY conv_id),
rl AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS r FROM r GROUP BY conv_id),
b AS (SELECT conv_id, c, coalesce(r, []) AS r FROM cl LEFT JOIN rl USING (conv_id)),
p AS (SELECT *, coalesce(list_position(list_transform(range(1, greatest(len(c), len(r)) + 1), lambda i: coalesce(c[i] = r[i], false)), false) - 1, len(c)) AS n FROM b),
q AS (SELECT conv_id, n, c[1:n] AS m, c[n + 1:] AS cc, r[n + 1:] AS rr FROM p)
SELECT conv_id, CAST(n AS INTEGER) AS prompt_turns, {_rendered("m")} AS prompt, {_rendered("cc")} AS chosen, {_span_text("cc")} AS chosen_spans,
       {_rendered("rr")} AS rejected, {_span_text("rr")} AS rejected_spans FROM q""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    found = preference.pairs(turns, preference.stale_answers(turns, "pair_id"))

    def told(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(spans)

    return found.select(F.col("pair_id").alias("conv_id"), "prompt_turns", "prompt", "chosen", told("chosen_spans"), "rejected", told("rejected_spans"))


@query("op8_maxent_lm")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = maxent.fit(docs.filter(~in_fold("doc_id", 7, 2)))
    return maxent.score(docs, model).withColumn("held_out", in_fold("doc_id", 7, 2))


@query("op9_byte_bpe")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return coded.select(
        "doc_id", bpe.count().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op10_html_main_text")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = html_templates.extract(table(spark, folder, "pages"))
    text = F.array_join("blocks", "\n")
    return found.select("page_id", "url", text.alias("text"), F.length(text).cast("bigint").alias("n_chars"))


@query("op11_turn_repair")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    report, repaired = turn_repair.repair(turn_repair.damage(turns))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = report.select(F.col("conv_id").alias("of_id"), *numbers, "audit")
    sums = turn_repair.digests(repaired).withColumnRenamed("conv_id", "sum_id")
    every = turns.select("conv_id").distinct()
    met = every.join(found, F.col("conv_id").eqNullSafe(F.col("of_id")), "left").join(sums, F.col("conv_id").eqNullSafe(F.col("sum_id")), "left")
    return met.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query("op12_whitening")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    x = whitening.whole(table(spark, folder, "embeddings"))
    return whitening.apply(x, whitening.fit(x))


@query("op13_sharding")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = table(spark, folder, "documents").select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.shuffle(docs, 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )

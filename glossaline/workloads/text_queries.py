"""Text, language, encoding, redaction and error queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import encoding, errors, language, linguistic, redaction
from ..functions import text as T
from ..operators import segments as S
from ..sources import files
from .base import (
    LINES, SPACE, any_of, count_class, in_list, mapped, norm, query, re2, seg_hash, strip, table, text, texts,
)


def document_lines(spark, sf):
    docs = texts(spark, sf)
    return docs.select("doc_id", "lang", "source", F.posexplode(T.lines(F.col("text"))).alias("ln", "line"))


@query("segment_normalize_hash", f"""
SELECT doc_id, length({norm('text')}) AS norm_chars, {seg_hash("lang", "'vi'", 'text')} AS source_text_hash FROM documents
""")
def segment_normalize_hash(spark, sf):
    docs = texts(spark, sf)
    return docs.select(
        "doc_id", F.length(T.normalize(F.col("text"))).cast("bigint").alias("norm_chars"),
        T.segment_hash(F.col("lang"), F.lit("vi"), F.col("text")).alias("source_text_hash"),
    )


@query("segment_duplicates", f"""
WITH keyed AS (SELECT lang, {seg_hash("lang", "'vi'", 'text')} AS h, length(text) AS n FROM documents),
     groups AS (SELECT lang, h, count(*) AS copies, sum(n) AS chars FROM keyed GROUP BY lang, h)
SELECT lang, CAST(sum(copies) AS BIGINT) AS segments, count(*) AS distinct_segments,
       CAST(sum(copies - 1) AS BIGINT) AS would_be_hits, max(copies) AS most_copies, CAST(sum(chars) AS BIGINT) AS chars
FROM groups GROUP BY lang
""")
def segment_duplicates(spark, sf):
    """The flagship: repeated segments per language, and the memory hits they would be."""
    keyed = texts(spark, sf).select(
        "lang", T.segment_hash(F.col("lang"), F.lit("vi"), F.col("text")).alias("h"), F.length("text").alias("n")
    )
    groups = keyed.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("copies"), F.sum("n").alias("chars"))
    return groups.groupBy("lang").agg(
        F.sum("copies").alias("segments"), F.count(F.lit(1)).alias("distinct_segments"),
        F.sum(F.col("copies") - 1).alias("would_be_hits"), F.max("copies").alias("most_copies"), F.sum("chars").alias("chars"),
    )


_CLEAN = strip(
    f"regexp_replace(regexp_replace(regexp_replace(html, '\\(cid:[0-9]+\\)', '', 'g'), "
    f"'[\\x00-\\x08\\x0b-\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]', '', 'g'), {text(f'[{SPACE}]+')}, ' ', 'g')"
)


@query("clean_extracted_text", f"SELECT page_id, length({_CLEAN}) AS chars, md5({_CLEAN}) AS digest FROM pages")
def clean_extracted_text(spark, sf):
    cleaned = texts(spark, sf, "pages").select("page_id", T.clean_extracted(F.col("html")).alias("c"))
    return cleaned.select("page_id", F.length("c").cast("bigint").alias("chars"), F.md5("c").alias("digest"))


@query("previews_and_labels", """
SELECT page_id, left(html, 80) AS preview, CASE WHEN length(html) > 80 THEN left(html, 80) || '...' ELSE html END AS preview_dots,
       regexp_extract(url, '([^/\\\\]+)[/\\\\]*$', 1) AS label
FROM pages
""")
def previews_and_labels(spark, sf):
    return texts(spark, sf, "pages").select(
        "page_id", T.preview(F.col("html")).alias("preview"), T.preview(F.col("html"), ellipsis=True).alias("preview_dots"),
        T.file_label(F.col("url")).alias("label"),
    )


# Codes for the pair checks: every document gets a target code from its length.
_TARGETS = ["en", "vi", "zh_CN", "auto", "", "xx", "ZH-tw"]
_TARGET_SQL = "[" + ", ".join(text(t) for t in _TARGETS) + "][CAST(n_chars % 7 AS INTEGER) + 1]"


def _with_target(docs):
    return docs.withColumn(
        "target", F.get(F.array(*[F.lit(t) for t in _TARGETS]), (F.col("n_chars") % 7).cast("int"))
    )


@query("language_codes", f"""
WITH d AS (SELECT doc_id, lang, {_TARGET_SQL} AS target FROM documents)
SELECT target, count(*) AS documents,
       max(CASE WHEN lower(target) = 'auto' THEN 'auto' ELSE coalesce({mapped('lower(target)', V.LANGUAGE_CODE_MAP)}, target) END) AS code,
       max(CASE WHEN lower(target) = 'auto' THEN '{V.OCR_AUTO}' ELSE {mapped('lower(target)', V.OCR_LANGUAGE_MAP, "'eng'")} END) AS ocr
FROM d GROUP BY target
""")
def language_codes(spark, sf):
    docs = _with_target(texts(spark, sf))
    return docs.groupBy("target").agg(
        F.count(F.lit(1)).alias("documents"), F.max(language.normalize_code(F.col("target"))).alias("code"),
        F.max(language.ocr_code(F.col("target"))).alias("ocr"),
    )


_LANGS = in_list([c for c in V.SUPPORTED_LANGUAGES if c == c.lower()])


@query("language_pairs", f"""
WITH d AS (SELECT doc_id, CASE WHEN source < 'src2' THEN 'auto' ELSE lang END AS source, {_TARGET_SQL} AS target FROM documents),
r AS (SELECT *, CASE WHEN source = '' THEN 'missing_source' WHEN target = '' THEN 'missing_target'
  WHEN lower(source) = 'auto' AND lower(target) = 'auto' THEN 'auto_to_auto'
  WHEN lower(source) = 'auto' AND lower(target) IN {_LANGS} THEN NULL
  WHEN lower(source) <> 'auto' AND lower(source) NOT IN {_LANGS} THEN 'unsupported_source'
  WHEN lower(target) NOT IN {_LANGS} THEN 'unsupported_target'
  WHEN lower(source) <> 'auto' AND source = target THEN 'same_language' END AS reason FROM d)
SELECT source, target, coalesce(reason, 'accepted') AS outcome, count(*) AS documents FROM r GROUP BY 1, 2, 3
""")
def language_pairs(spark, sf):
    docs = _with_target(texts(spark, sf))
    docs = docs.withColumn("source", F.when(F.col("source") < "src2", "auto").otherwise(F.col("lang")))
    reason = language.pair_reject_reason(F.col("source"), F.col("target"))
    return docs.groupBy("source", "target", F.coalesce(reason, F.lit("accepted")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("documents")
    )


_ASCII_RATIO = f"{count_class('text', 'A-Za-z' + chr(9) + '-' + chr(13) + chr(28) + '- ')} / greatest(length(text), 1)::DOUBLE"


@query("language_signals", f"""
SELECT doc_id, regexp_matches(text, {text(f'[{V.VIETNAMESE_LETTERS}]')})
         OR list_has_any(regexp_split_to_array(lower(text), {text(f'[{SPACE}]+')}), [{', '.join(text(w) for w in V.VIETNAMESE_WORDS)}]) AS has_vietnamese,
       regexp_matches(text, '[぀-ヿ一-龯]') AS has_japanese, regexp_matches(text, '[一-鿿]') AS has_han,
       round({_ASCII_RATIO}, 6) AS ascii_ratio,
       CASE WHEN lang = 'en' THEN {_ASCII_RATIO} > 0.8 END AS evidence, length({strip('text')}) >= 2 AS translate
FROM documents
""")
def language_signals(spark, sf):
    signals = language.script_signals(F.col("text"))
    return texts(spark, sf).select(
        "doc_id", signals["has_vietnamese"].alias("has_vietnamese"), signals["has_japanese"].alias("has_japanese"),
        signals["has_han"].alias("has_han"), F.round(signals["ascii_ratio"], 6).alias("ascii_ratio"),
        language.language_evidence(F.col("text"), F.col("lang")).alias("evidence"),
        language.is_source_language(F.col("text")).alias("translate"),
    )


_CLEAR = (
    f"length(s) > 0 AND {count_class('s', chr(92) + 'p{L}' + chr(92) + 'p{N}' + SPACE)} >= 3 "
    f"AND {count_class('s', chr(92) + 'p{L}' + chr(92) + 'p{N}')} >= length(s) * 0.3"
)


@query("recognized_text_clear", f"""
WITH {LINES}, s AS (SELECT doc_id, {strip('line')} AS s FROM doc_lines)
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE {_CLEAR}) AS clear_lines FROM s GROUP BY doc_id
""")
def recognized_text_clear(spark, sf):
    return document_lines(spark, sf).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(language.is_text_clear(F.col("line"))).alias("clear_lines")
    )


_CODE = (
    f"(regexp_matches(s, {re2(V.FLIGHT_CODE_PATTERN)}) OR (regexp_matches(s, '[0-9]') AND regexp_matches(s, {re2(V.NUMERIC_PATTERN)})) "
    "OR (NOT regexp_matches(s, '[^\\x00-\\x7f]') AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]') "
    "AND NOT regexp_matches(s, '[A-Za-z]{3}')))"
)


def _skip_sql(flavor: str) -> str:
    path = V.DOCUMENT_PATH_PATTERN if flavor == "word" else V.SLIDE_PATH_PATTERN
    alnum = "WHEN NOT regexp_matches(s, '[\\p{L}\\p{N}]') THEN 'no_alphanumeric' " if flavor == "word" else ""
    return (
        f"CASE WHEN s = '' THEN 'blank' {alnum}WHEN regexp_matches(s, {re2(V.URL_PATTERN)}) THEN 'url' "
        f"WHEN regexp_matches(s, {re2(V.EMAIL_PATTERN)}) THEN 'email' WHEN regexp_matches(s, {re2(path)}) THEN 'path' "
        f"WHEN regexp_matches(s, {re2(V.FIELD_HINT_PATTERN)}) THEN 'field' WHEN {_CODE} THEN 'code' END"
    )


# Words of all lines stand for runs and cell texts: they hold numbers, addresses, symbols.
_WORDS = f"words AS (SELECT doc_id, ln, unnest(string_split(line, ' ')) AS word FROM doc_lines)"


@query("skip_text_reasons", f"""
WITH {LINES}, {_WORDS}, s AS (SELECT {strip('word')} AS s FROM words)
SELECT coalesce({_skip_sql('word')}, 'translate') AS word_reason, coalesce({_skip_sql('slides')}, 'translate') AS slides_reason,
       s = '' OR {_CODE} OR regexp_matches(s, '^[A-Za-z]$') AS unchanged_ok, count(*) AS texts
FROM s GROUP BY 1, 2, 3
""")
def skip_text_reasons(spark, sf):
    words = document_lines(spark, sf).select(F.explode(F.split("line", " ", -1)).alias("word"))
    # Equal texts are judged once: the counts shuffle one row per distinct text.
    counted = words.groupBy(T.strip(F.col("word")).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    word = F.col("word")
    return counted.groupBy(
        F.coalesce(linguistic.skip_reason(word), F.lit("translate")).alias("word_reason"),
        F.coalesce(linguistic.skip_reason(word, "slides"), F.lit("translate")).alias("slides_reason"),
        linguistic.unchanged_is_fine(word).alias("unchanged_ok"),
    ).agg(F.sum("n").alias("texts"))


@query("translatable_segments", f"""
WITH {LINES}, s AS (SELECT source, {strip('line')} AS s FROM doc_lines)
SELECT source, count(*) AS lines, count(*) FILTER (WHERE length(s) >= 2) AS segments,
       count(*) FILTER (WHERE s <> '' AND lower(s) NOT IN ('nan', 'none')) AS table_values
FROM s GROUP BY source
""")
def translatable_segments(spark, sf):
    return document_lines(spark, sf).groupBy("source").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(linguistic.is_translatable(F.col("line"), 2)).alias("segments"),
        F.count_if(linguistic.table_value_counts(F.col("line"))).alias("table_values"),
    )


# Letters whose UTF-8 bytes, read as single-byte text, give the two-character sequences.
_MISREAD = [(c, c.encode("utf-8").decode("latin-1")) for c in "éèêçàâîïôûùüöäßáíóúñÉÈÊÇÀÜÖÄÁÍÓÚÑ"]


def _misread_sql(x: str) -> str:
    for plain, broken in _MISREAD:
        x = f"replace({x}, {text(plain)}, {text(broken)})"
    return x


def _misread(x):
    for plain, broken in _MISREAD:
        x = F.replace(x, F.lit(plain), F.lit(broken))
    return x


_MOJI = text(encoding.MOJIBAKE_REGEX)


@query("mojibake_repair", f"""
WITH d AS (SELECT doc_id, text, CASE WHEN lang IN ('fr', 'es') THEN {_misread_sql('text')} ELSE text END AS received FROM documents)
SELECT doc_id, regexp_matches(received, {_MOJI}) AS damaged,
       md5(CASE WHEN regexp_matches(received, {_MOJI}) AND NOT regexp_matches(text, {_MOJI}) THEN text ELSE received END) AS repaired
FROM d
""")
def mojibake_repair(spark, sf):
    docs = texts(spark, sf)
    received = F.when(F.col("lang").isin("fr", "es"), _misread(F.col("text"))).otherwise(F.col("text"))
    return docs.select("doc_id", received.alias("received")).select(
        "doc_id", encoding.has_mojibake(F.col("received")).alias("damaged"),
        F.md5(encoding.repair_mojibake(F.col("received"))).alias("repaired"),
    )


_FIRST = "CASE " + " ".join(f"WHEN contains(line, {text(p)}) THEN {text(p)}" for p in dict.fromkeys(V.MOJIBAKE_PATTERNS)) + " END"


@query("mojibake_scan", f"""
WITH {LINES.replace('FROM documents', f"FROM (SELECT doc_id, lang, source, CASE WHEN lang IN ('fr', 'es') THEN {_misread_sql('text')} ELSE text END AS text FROM documents)")},
hits AS (SELECT doc_id, ln + 1 AS line_no, {_FIRST} AS pattern FROM doc_lines WHERE regexp_matches(line, {_MOJI}))
SELECT doc_id, count(*) AS issues, min(line_no) AS first_line, arg_min(pattern, line_no) AS first_pattern
FROM hits WHERE pattern IS NOT NULL GROUP BY doc_id
""")
def mojibake_scan(spark, sf):
    docs = texts(spark, sf)
    received = F.when(F.col("lang").isin("fr", "es"), _misread(F.col("text"))).otherwise(F.col("text"))
    report = files.mojibake_report(docs.select("doc_id", received.alias("text")), ["doc_id"])
    return report.withColumn("first_line", F.col("first_line").cast("bigint"))


def _secrets_sql(x: str) -> str:
    for pattern in V.SECRET_PATTERNS:
        x = f"regexp_replace({x}, {re2(pattern)}, {text(V.KEY_MASK)}, 'g')"
    return x


# Sentences with key-like settings around each text, since the tables hold none of their own.
_CONFIG_SQL = "'google_api_key = K' || doc_id || ', AIzaSy' || md5(lang) || ' Authorization: Bearer tok' || n_chars || '; sk-' || doc_id || ' ' || text"


def _config(docs):
    return F.concat(
        F.lit("google_api_key = K"), F.col("doc_id"), F.lit(", AIzaSy"), F.md5("lang"), F.lit(" Authorization: Bearer tok"),
        F.col("n_chars"), F.lit("; sk-"), F.col("doc_id"), F.lit(" "), F.col("text"),
    )


@query("redact_secrets", f"""
SELECT 'documents' AS origin, doc_id AS id, md5({_secrets_sql(_CONFIG_SQL)}) AS digest FROM documents
UNION ALL SELECT 'conversations', conv_id * 1000 + turn, md5({_secrets_sql('text')}) FROM conversations
""")
def redact_secrets(spark, sf):
    docs = texts(spark, sf)
    one = docs.select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), redaction.redact_secrets(_config(docs)).alias("t"))
    two = texts(spark, sf, "conversations").select(
        F.lit("conversations").alias("origin"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        redaction.redact_secrets(F.col("text")).alias("t"),
    )
    return one.unionByName(two).select("origin", "id", F.md5("t").alias("digest"))


@query("redact_rows", f"""
SELECT doc_id, md5({_secrets_sql(_CONFIG_SQL)}) AS top_digest, md5({_secrets_sql(_CONFIG_SQL)}) AS nested_digest, source AS label FROM documents
""")
def redact_rows(spark, sf):
    """The schema-driven form, over a struct holding an array and a map."""
    docs = texts(spark, sf)
    nested = docs.select(
        "doc_id", _config(docs).alias("top"), F.struct(F.array(_config(docs)).alias("items"), F.create_map(F.lit("label"), F.col("source")).alias("m")).alias("n")
    )
    out = redaction.redact_rows(nested)
    return out.select(
        "doc_id", F.md5("top").alias("top_digest"), F.md5(F.get("n.items", F.lit(0))).alias("nested_digest"), F.col("n.m")["label"].alias("label")
    )


def _sub(x: str, pattern: str, mask: str) -> str:
    return f"regexp_replace({x}, {re2(pattern)}, {text(mask)}, 'g')"


_PROVIDER_SQL = f"left({_sub(_sub(_sub(f'replace(t, lang, {text(V.KEY_MASK)})', V.AUTH_HEADER_PATTERN, V.AUTH_HEADER_MASK), V.BEARER_PATTERN, V.BEARER_MASK), V.GOOGLE_KEY_PATTERN, V.KEY_MASK)}, 500)"
_CATALOG_SQL = f"left(translate({_sub(_sub('t', V.AUTH_HEADER_PATTERN, V.AUTH_HEADER_MASK), V.GOOGLE_KEY_PATTERN, V.KEY_MASK)}, chr(13) || chr(10), '  '), 400)"
_ROUTER_SQL = _sub(_sub(_sub("tail", V.GOOGLE_KEY_PATTERN, V.KEY_MASK), V.ROUTER_BEARER_PATTERN, V.ROUTER_BEARER_MASK), V.ROUTER_SK_PATTERN, V.KEY_MASK)


@query("redact_profiles", f"""
WITH d AS (SELECT doc_id, lang, {_CONFIG_SQL} AS t, {strip("'AIzaSy' || md5(lang) || ' Bearer tok' || n_chars || ' sk-' || doc_id || ' ' || text")} AS tail, text FROM documents),
r AS (SELECT *, {_ROUTER_SQL} AS router FROM d)
SELECT doc_id, {_PROVIDER_SQL} AS provider_error, {_CATALOG_SQL} AS catalog_error,
       CASE WHEN {any_of('lower(router)', V.ROUTER_BANNED_WORDS)} THEN {text(V.ROUTER_BANNED_MASK)}
            WHEN length(router) > 80 THEN left(router, 80) || '...' ELSE router END AS router_error,
       md5(CASE WHEN {any_of('lower(text)', [m.lower() for m in V.REPORT_MARKS])} THEN {text(V.REPORT_MASK)} ELSE text END) AS report_text
FROM r
""")
def redact_profiles(spark, sf):
    docs = texts(spark, sf)
    tail = F.concat(F.lit("AIzaSy"), F.md5("lang"), F.lit(" Bearer tok"), F.col("n_chars"), F.lit(" sk-"), F.col("doc_id"), F.lit(" "), F.col("text"))
    return docs.select("doc_id", "lang", _config(docs).alias("t"), tail.alias("tail"), "text").select(
        "doc_id", redaction.redact_provider_error(F.col("t"), F.col("lang")).alias("provider_error"),
        redaction.redact_catalog_error(F.col("t")).alias("catalog_error"),
        redaction.redact_router_error(F.col("tail")).alias("router_error"),
        F.md5(redaction.redact_whole(F.col("text"))).alias("report_text"),
    )


@query("mask_keys", """
SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN '***' ELSE '****' || right(c_name, 4) END AS masked,
       CASE WHEN length(c_mktsegment) <= 4 THEN '***' ELSE '****' || right(c_mktsegment, 4) END AS masked_segment FROM customer
""")
def mask_keys(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", redaction.mask_key(F.col("c_name")).alias("masked"), redaction.mask_key(F.col("c_mktsegment")).alias("masked_segment")
    )


_CHUNKS = (
    "chunks AS (SELECT doc_id, i AS chunk_no, substring(text, i * {n} + 1, {n}) AS chunk FROM documents, "
    "(SELECT unnest(range((SELECT max(length(text)) FROM documents) // {n} + 1)) AS i) WHERE i * {n} < length(text))"
)


@query("chunk_documents", f"""
WITH {_CHUNKS.format(n=V.MAX_CHUNK_CHARS)}
SELECT doc_id, chunk_no, length(chunk) AS chars, md5(chunk) AS digest, length({strip('chunk')}) < 2 AS passes_through FROM chunks
""")
def chunk_documents(spark, sf):
    docs = texts(spark, sf).select("doc_id", "text")
    return S.explode_chunks(docs).select(
        "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.length("chunk").cast("bigint").alias("chars"),
        F.md5("chunk").alias("digest"), "passes_through",
    )


@query("sub_chunk_documents", f"""
WITH {_CHUNKS.format(n=V.MAX_CHUNK_CHARS)},
subs AS (SELECT doc_id, chunk_no, i AS sub_no, substring(chunk, i * {V.SUB_CHUNK_CHARS} + 1, {V.SUB_CHUNK_CHARS}) AS piece
         FROM chunks, (SELECT unnest(range(2)) AS i) WHERE i * {V.SUB_CHUNK_CHARS} < length(chunk))
SELECT doc_id, count(*) AS pieces, max(length(piece)) AS longest FROM subs GROUP BY doc_id
""")
def sub_chunk_documents(spark, sf):
    docs = texts(spark, sf).select("doc_id", "text")
    pieces = S.sub_chunks(S.explode_chunks(docs).select("doc_id", "chunk_no", "chunk"))
    return pieces.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.max(F.length("chunk")).cast("bigint").alias("longest"))


@query("chunk_rejoin", "SELECT doc_id, length(text) AS chars, md5(text) AS digest FROM documents WHERE length(text) > 0")
def chunk_rejoin(spark, sf):
    docs = texts(spark, sf).select("doc_id", "text")
    joined = S.rejoin(S.explode_chunks(docs), ["doc_id"], ["chunk_no"], "chunk")
    return joined.select("doc_id", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


@query("conversation_text", """
SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest, count(*) AS parts FROM conversations GROUP BY conv_id
""")
def conversation_text(spark, sf):
    """Ordered reassembly of a document from its parts."""
    turns = texts(spark, sf, "conversations")
    whole = S.rejoin(turns, ["conv_id"], ["turn"], "text", "\n")
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts"))
    return whole.join(counts, "conv_id").select("conv_id", F.md5("text").alias("digest"), "parts")


@query("overflow_mentions", """
SELECT source, CAST(sum((length(t) - length(replace(t, 'overflow fallback', ''))) // 17) AS BIGINT) AS mentions
FROM (SELECT source, lower(replace(text, 'the ', 'overflow Fallback ')) AS t FROM documents) GROUP BY source
""")
def overflow_mentions(spark, sf):
    docs = texts(spark, sf)
    log = F.replace(F.col("text"), F.lit("the "), F.lit("overflow Fallback "))
    return docs.groupBy("source").agg(F.sum(T.overflow_mentions(log)).alias("mentions"))


@query("version_check", """
WITH v AS (SELECT o_orderstatus AS status, CASE WHEN o_custkey % 10 = 0 THEN 'x.y' ELSE (o_custkey % 4) || '.' || (o_orderkey % 12) END AS version FROM orders)
SELECT status, count(*) AS releases, count(*) FILTER (WHERE CASE WHEN version = 'x.y' THEN [0]
  ELSE [CAST(split_part(version, '.', 1) AS INTEGER), CAST(split_part(version, '.', 2) AS INTEGER)] END > [2, 5]) AS newer FROM v GROUP BY status
""")
def version_check(spark, sf):
    orders = table(spark, sf, "orders")
    version = F.when(F.col("o_custkey") % 10 == 0, "x.y").otherwise(F.concat_ws(".", F.col("o_custkey") % 4, F.col("o_orderkey") % 12))
    return orders.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("releases"), F.count_if(T.is_newer_version(version, F.lit("2.5"))).alias("newer")
    )


def error_class_sql(t: str) -> str:
    return (
        f"CASE WHEN {t} IN {in_list(V.ERROR_CLASSES)} THEN {t} WHEN {any_of(t, V.AUTH_HINTS)} THEN 'auth_failure' "
        f"WHEN {any_of(t, V.QUOTA_HINTS)} THEN 'quota_rate_limit' "
        f"WHEN contains({t}, '400') AND {any_of(t, V.MODEL_ERROR_HINTS)} THEN 'model_error' "
        f"WHEN {any_of(t, V.TOKEN_LIMIT_HINTS)} THEN 'token_limit' WHEN {any_of(t, V.TIMEOUT_HINTS)} THEN 'timeout' "
        f"WHEN {any_of(t, V.TRANSPORT_HINTS)} THEN 'transport_error' WHEN {any_of(t, V.MODEL_ERROR_HINTS)} THEN 'model_error' "
        f"WHEN {any_of(t, V.MODEL_UNAVAILABLE_HINTS)} THEN 'model_unavailable' "
        f"WHEN {any_of(t, V.SERVER_ERROR_HINTS)} THEN 'provider_5xx' ELSE 'unknown_transport_error' END"
    )


_CODES = [401, 429, 400, 404, 503, 200]
_STATUS_SQL = f"CAST({_CODES}[CAST(page_id % 6 AS INTEGER) + 1] AS INTEGER)"
_REFINED = (
    f"CASE WHEN first IN ('unknown_error', 'network_error', 'endpoint_not_found') THEN CASE WHEN {any_of('t', V.RECHECK_AUTH)} THEN 'auth_error' "
    f"WHEN {any_of('t', V.RECHECK_QUOTA)} THEN 'quota_or_rate_limited' WHEN {any_of('t', V.RECHECK_MODEL)} THEN 'model_not_found' "
    f"WHEN {any_of('t', V.RECHECK_WRAPPER)} THEN 'provider_wrapper_error' ELSE first END ELSE first END"
)


@query("error_classify", f"""
WITH p AS (SELECT page_id, {_STATUS_SQL} AS code, lower(html) AS t, lower('HTTP ' || {_STATUS_SQL} || ' ' || url) AS m FROM pages),
c AS (SELECT page_id, code, t, m, {error_class_sql('t')} AS by_text FROM p),
k AS (SELECT page_id, code, m AS t, by_text, CASE WHEN code IN (401, 403) THEN 'auth_failure' WHEN code = 429 THEN 'quota_rate_limit'
   WHEN code = 400 AND {any_of('t', V.MODEL_ERROR_HINTS)} THEN 'model_error'
   WHEN code IN (404, 410) AND {any_of('t', V.MODEL_ERROR_HINTS + V.MODEL_UNAVAILABLE_HINTS)} THEN 'model_unavailable'
   WHEN code BETWEEN 500 AND 599 THEN 'provider_5xx' ELSE by_text END AS by_status FROM c),
h AS (SELECT *, {mapped('by_status', V.HEALTH_STATUS_BY_ERROR, "'unknown_error'")} AS health FROM k),
f AS (SELECT *, CASE WHEN code = 404 THEN CASE WHEN {any_of('t', V.MODEL_HINTS_404)} THEN 'model_not_found' ELSE 'endpoint_not_found' END
   WHEN code = 400 THEN CASE WHEN {any_of('t', V.MODEL_HINTS_400)} THEN 'model_not_found' ELSE 'payload_error' END ELSE health END AS first FROM h)
SELECT page_id, by_text, by_status, health, {_REFINED} AS refined FROM f
""")
def error_classify(spark, sf):
    pages = texts(spark, sf, "pages")
    code = F.get(F.array(*[F.lit(c) for c in _CODES]), (F.col("page_id") % 6).cast("int"))
    named = pages.withColumn("code", code).select(
        "page_id", "code", F.concat(F.lit("HTTP "), F.col("code"), F.lit(" "), F.col("url")).alias("message"),
        errors.error_class(F.col("html")).alias("by_text"), errors.error_class(F.col("html"), F.col("code")).alias("by_status"),
    )
    return named.select(
        "page_id", "by_text", "by_status", errors.health_status(F.col("by_status")).alias("health"),
        errors.refined_health_status(F.col("by_status"), F.col("message")).alias("refined"),
    )



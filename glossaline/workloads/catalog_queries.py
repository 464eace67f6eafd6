"""Model catalog, provider profile and file queries.  Brands are providers, part names are models."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..operators import blocks as B
from ..operators import catalog as C
from ..session import new_shared_path
from ..sources import catalog_json, files, small_files
from .base import any_of, in_list, mapped, query, table, text, texts

_SOURCES = ["user", "default", "api_discovered", "docs_known", "", "legacy"]
_VISIBLE = ["unverified", "live_validated", "unavailable", "", "current_key_visible"]


def _entries(parts, shift: int):
    def item(values, number):
        return F.get(F.array(*[F.lit(v) for v in values]), ((number + shift) % len(values)).cast("int"))

    key = F.col("p_partkey")
    at = F.timestamp_seconds(F.lit(1704067200) + key * 60)
    return parts.select(
        F.col("p_brand").alias("provider"), key.cast("int").alias("ordinal"), F.concat(F.lit(" "), F.col("p_name")).alias("id"),
        F.when((key + shift) % 3 == 0, F.col("p_type")).when((key + shift) % 3 == 1, F.col("p_name")).alias("label"),
        F.when((key + shift) % 5 != 0, key % 2 == 0).alias("enabled"), item(_SOURCES, key).alias("source"),
        item(_VISIBLE, F.col("p_size")).alias("visibility"),
        F.struct(
            F.lit(None).cast("boolean").alias("text"), ((key + shift) % 7 == 0).alias("vision"), (key % 11 == 0).alias("embedding"),
            F.lit(None).cast("boolean").alias("rerank"), F.lit(False).alias("unknown"),
        ).alias("capabilities"),
        F.when((key + shift) % 2 == 0, at).alias("discovered_at"), F.lit(None).cast("timestamp").alias("last_validated_at"),
        F.when((key + shift) % 4 == 0, F.col("p_brand")).alias("display_name"), F.when(key % 6 == 0, F.col("p_type")).otherwise("").alias("raw_metadata"),
    )


def base_entries(spark, sf):
    return _entries(table(spark, sf, "part"), 0)


def incoming_entries(spark, sf):
    """What a refresh lists: the parts somebody ordered lately."""
    ordered = table(spark, sf, "lineitem").filter("l_shipdate >= '2000-01-01'").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return _entries(table(spark, sf, "part").join(ordered, "p_partkey", "left_semi"), 1)


def _entries_sql(source: str, shift: int, which: int) -> str:
    def item(values, number):
        return "[" + ", ".join(text(v) for v in values) + f"][CAST(({number} + {shift}) % {len(values)} AS INTEGER) + 1]"

    k = "p_partkey"
    return (
        f"SELECT {which} AS list, p_brand AS provider, {k} AS ordinal, p_name AS id, "
        f"CASE WHEN ({k} + {shift}) % 3 = 0 THEN p_type WHEN ({k} + {shift}) % 3 = 1 THEN p_name "
        f"WHEN ({k} + {shift}) % 4 = 0 THEN p_brand ELSE p_name END AS label, "
        f"CASE WHEN ({k} + {shift}) % 5 <> 0 THEN {k} % 2 = 0 ELSE TRUE END AS enabled, "
        f"CASE {item(_SOURCES, k)} WHEN 'default' THEN 'seed' WHEN '' THEN 'user' ELSE {item(_SOURCES, k)} END AS source, "
        f"CASE {item(_VISIBLE, 'p_size')} WHEN '' THEN 'unverified' ELSE {item(_VISIBLE, 'p_size')} END AS visibility, "
        f"({k} + {shift}) % 7 = 0 AS vision, {k} % 11 = 0 AS embedding, "
        f"CASE WHEN ({k} + {shift}) % 2 = 0 THEN TIMESTAMP '2024-01-01' + to_seconds({k} * 60) END AS discovered_at, "
        f"CASE WHEN ({k} + {shift}) % 4 = 0 THEN p_brand END AS display, CASE WHEN {k} % 6 = 0 THEN p_type END AS raw FROM {source}"
    )


_INCOMING = "(SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01'))"
MERGED_SQL = f"""
base AS ({_entries_sql('part', 0, 0)}), incoming AS ({_entries_sql(_INCOMING, 1, 1)}),
rows_ AS (SELECT *, coalesce(display, label) AS display_name, row_number() OVER (ORDER BY list, ordinal) AS n,
  {mapped('source', V.SOURCE_PRIORITY, '0')} AS sp, {mapped('visibility', V.VISIBILITY_PRIORITY, '0')} AS vp FROM (SELECT * FROM base UNION ALL SELECT * FROM incoming)),
merged AS (SELECT provider, id, min(n) AS first_n, coalesce(arg_max(label, n) FILTER (WHERE label <> id), id) AS label, arg_max(enabled, n) AS enabled,
  list(source ORDER BY sp DESC, n DESC)[1] AS source, list(visibility ORDER BY vp DESC, n DESC)[1] AS visibility, bool_or(vision) AS vision, bool_or(embedding) AS embedding,
  arg_max(discovered_at, n) FILTER (WHERE discovered_at IS NOT NULL) AS discovered_at, arg_max(display_name, n) AS display_name, arg_max(raw, n) FILTER (WHERE raw IS NOT NULL) AS raw_metadata
  FROM rows_ GROUP BY provider, id),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY provider ORDER BY first_n) - 1 AS INTEGER) AS ordinal FROM merged)
"""


@query("catalog_merge", f"WITH {MERGED_SQL} SELECT * EXCLUDE (first_n) FROM placed")
def catalog_merge(spark, sf):
    merged = C.merge(base_entries(spark, sf), incoming_entries(spark, sf))
    return merged.select(
        "provider", "id", "label", "enabled", "source", "visibility", F.col("capabilities.vision").alias("vision"),
        F.col("capabilities.embedding").alias("embedding"), "discovered_at", "display_name", "raw_metadata", "ordinal",
    )


@query("catalog_refresh", f"""
WITH {MERGED_SQL} SELECT p.provider, p.id, CASE WHEN i.id IS NOT NULL THEN p.visibility WHEN p.source = 'api_discovered' THEN 'unavailable' ELSE 'unverified' END AS visibility
FROM placed p LEFT JOIN (SELECT DISTINCT provider, id FROM incoming) i USING (provider, id)
""")
def catalog_refresh(spark, sf):
    found = C.normalize_entries(incoming_entries(spark, sf))
    merged = C.merge(base_entries(spark, sf), incoming_entries(spark, sf))
    return C.mark_missing(merged, found).select("provider", "id", "visibility")


def unique_models(spark, sf):
    """One entry per provider and id, in part order."""
    return C.merge(base_entries(spark, sf), base_entries(spark, sf).filter(F.lit(False)))


UNIQUE_SQL = MERGED_SQL.replace(_INCOMING, "(SELECT * FROM part WHERE FALSE)")


@query("catalog_defaults", f"""
WITH {UNIQUE_SQL}, cur AS (SELECT provider, min(id) AS default_model FROM placed GROUP BY 1), en AS (SELECT * FROM placed WHERE enabled)
SELECT provider, CASE WHEN max(en.id) FILTER (WHERE en.id = cur.default_model) IS NOT NULL THEN any_value(default_model) ELSE coalesce(arg_min(en.id, en.ordinal), '') END AS default_model
FROM cur LEFT JOIN en USING (provider) GROUP BY provider
""")
def catalog_defaults(spark, sf):
    entries = unique_models(spark, sf)
    current = entries.groupBy("provider").agg(F.min("id").alias("default_model"))
    return C.elect_defaults(entries, current)


@query("catalog_edits", f"""
WITH {UNIQUE_SQL},
lastmodel AS (SELECT provider, max(ordinal) AS m FROM placed GROUP BY 1),
ed AS (SELECT p.provider, p.id, CASE WHEN ordinal = 0 THEN 'move_down' WHEN ordinal = 3 THEN 'remove' WHEN ordinal = 4 THEN 'disable' WHEN ordinal = 5 THEN 'toggle' WHEN ordinal = m AND ordinal > 6 THEN 'enable' END AS op FROM placed p JOIN lastmodel USING (provider)),
kept AS (SELECT p.provider, p.id, p.label, CASE ed.op WHEN 'disable' THEN FALSE WHEN 'enable' THEN TRUE WHEN 'toggle' THEN NOT p.enabled ELSE p.enabled END AS enabled,
   p.ordinal + CASE WHEN ed.op = 'move_down' THEN 1.5 ELSE 0 END AS place FROM placed p JOIN ed USING (provider, id) WHERE ed.op IS DISTINCT FROM 'remove'),
dense AS (SELECT provider, id, label, enabled, row_number() OVER (PARTITION BY provider ORDER BY place) AS place FROM kept),
added AS (SELECT provider, 'new ' || s_name AS id, s_name AS label, TRUE AS enabled, 1000000 + s_suppkey AS place FROM supplier JOIN (SELECT DISTINCT provider FROM placed) ON provider = 'Brand#' || (s_suppkey % 25 + 1)),
al AS (SELECT * FROM dense UNION ALL SELECT * FROM added)
SELECT provider, id, label, enabled, CAST(row_number() OVER (PARTITION BY provider ORDER BY place) - 1 AS INTEGER) AS ordinal FROM al
""")
def catalog_edits(spark, sf):
    from ..session import materialize

    entries = materialize(unique_models(spark, sf), "models")
    last = entries.groupBy("provider").agg(F.max("ordinal").alias("m"))
    at = F.col("ordinal")
    op = (
        F.when(at == 0, "move_down").when(at == 3, "remove").when(at == 4, "disable").when(at == 5, "toggle")
        .when((at == F.col("m")) & (at > 6), "enable")
    )
    edits = entries.join(last, "provider").select(at.cast("bigint").alias("change_no"), op.alias("op"), "provider", "id", "label").filter("op IS NOT NULL")
    brand = F.concat(F.lit("Brand#"), F.col("s_suppkey") % 25 + 1)
    adds = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("change_no"), F.lit("add").alias("op"), brand.alias("provider"),
        F.concat(F.lit("new "), F.col("s_name")).alias("id"), F.col("s_name").alias("label"),
    ).join(last.select("provider"), "provider", "left_semi")
    return C.edit_entries(entries, edits.unionByName(adds)).select("provider", "id", "label", "enabled", "ordinal")


@query("catalog_allowed", f"""
WITH {UNIQUE_SQL}, kept AS (SELECT provider, id, ordinal FROM placed WHERE id IN (SELECT p_name FROM part WHERE p_retailprice < 1500)),
top AS (SELECT max(ordinal) AS t FROM kept)
SELECT * FROM kept UNION ALL SELECT s_name, 'default', CAST(s_suppkey + t + 1 AS INTEGER) FROM supplier, top WHERE s_name NOT IN (SELECT provider FROM kept)
""")
def catalog_allowed(spark, sf):
    cheap = table(spark, sf, "part").filter("p_retailprice < 1500").select(F.col("p_name").alias("id"))
    kept = C.keep_allowed(unique_models(spark, sf), cheap).select("provider", "id", "ordinal")
    defaults = table(spark, sf, "supplier").select(F.col("s_name").alias("provider"), F.lit("default").alias("id"), F.col("s_suppkey").cast("int").alias("ordinal"))
    return C.append_missing(kept, defaults, ["provider", "id"])


_WORDS = ["vision-l", "embed-2", "rerank", "gemini-2.5-flash", "tts-1", "gemini-pro-vl", "chat", "gemma-4-31b-it"]
_ID_SQL = "[" + ", ".join(text(w) for w in _WORDS) + "][CAST(p_partkey % 8 AS INTEGER) + 1]"


@query("model_profiles", f"""
WITH m AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN {_ID_SQL} || '-' || p_size ELSE {_ID_SQL} END AS id FROM part), l AS (SELECT *, lower(id) AS t FROM m)
SELECT p_partkey, NOT {any_of('t', V.MEDIA_WORDS)} AND id IN {in_list(V.TEXT_MODELS)} AS text_profile,
  NOT {any_of('t', V.MEDIA_WORDS)} AND CASE WHEN {any_of('t', V.VISION_WORDS)} THEN NOT (contains(t, 'gemini') AND contains(t, 'pro')) ELSE id IN {in_list(V.VISION_MODELS)} END AS vision_profile,
  NOT (contains(t, 'embed') OR contains(t, 'rerank')) AS cap_text, {any_of('t', V.VISION_WORDS)} AS cap_vision, contains(t, 'embed') AS cap_embedding FROM l
""")
def model_profiles(spark, sf):
    word = F.get(F.array(*[F.lit(w) for w in _WORDS]), (F.col("p_partkey") % 8).cast("int"))
    ids = F.when(F.col("p_size") % 3 == 0, F.concat_ws("-", word, "p_size")).otherwise(word)
    models = table(spark, sf, "part").select("p_partkey", ids.alias("id"))
    caps = C.capabilities_of(F.col("id"))
    return models.select(
        "p_partkey", C.fits_profile(F.col("id"), "text").alias("text_profile"), C.fits_profile(F.col("id"), "vision").alias("vision_profile"),
        caps["text"].alias("cap_text"), caps["vision"].alias("cap_vision"), caps["embedding"].alias("cap_embedding"),
    )


@query("refresh_due", """
WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 40 = 0 THEN 'google' ELSE c_name END AS name, c_nationkey % 2 = 0 AS refreshable, CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE 'http://x' END AS url,
  c_acctbal > 0 AS has_key, max(o_orderdate) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_custkey, name <> 'google' AND refreshable AND trim(url) <> '' AND has_key
  AND (last IS NULL OR c_custkey % 11 = 0 OR TIMESTAMP '2000-10-01' >= last + INTERVAL 720 HOUR) AS due FROM p
""")
def refresh_due(spark, sf):
    last = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    rows = table(spark, sf, "customer").join(last, "c_custkey", "left")
    key = F.col("c_custkey")
    stamp = F.when(key % 11 == 0, "not a date").otherwise(F.date_format("last", "yyyy-MM-dd'T'HH:mm:ss"))
    due = C.refresh_due(
        F.when(key % 40 == 0, "google").otherwise(F.col("c_name")), F.col("c_nationkey") % 2 == 0, F.when(key % 7 == 0, " ").otherwise("http://x"),
        F.col("c_acctbal") > 0, stamp, F.lit("2000-10-01").cast("timestamp"), ttl_hours=720,
    )
    return rows.select("c_custkey", due.alias("due"))


@query("refresh_state", """
WITH l AS (SELECT o_custkey AS provider, o_orderdate AS ts, o_orderkey AS log_no, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'error' ELSE 'odd' END AS status, o_custkey % 50 AS n,
  'Authorization: Bearer k' || o_orderkey || ', ' || o_orderpriority AS error FROM orders)
SELECT provider, max(ts) AS last_refreshed_at, CASE arg_max(status, (ts, log_no)) WHEN 'odd' THEN 'error' ELSE arg_max(status, (ts, log_no)) END AS last_status,
  arg_max(n, (ts, log_no)) AS last_count, regexp_replace(arg_max(error, (ts, log_no)), 'Bearer [^,]+', '[REDACTED_API_KEY]') AS last_error FROM l GROUP BY provider
""")
def refresh_state(spark, sf):
    log = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("provider"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("log_no"),
        F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "error").otherwise("odd").alias("status"),
        (F.col("o_custkey") % 50).alias("count"), F.concat(F.lit("Authorization: Bearer k"), F.col("o_orderkey"), F.lit(", "), F.col("o_orderpriority")).alias("error"),
    )
    return C.refresh_state(log)


@query("catalog_json_roundtrip", f"WITH {UNIQUE_SQL} SELECT provider, id, label, enabled, source, visibility, vision, discovered_at, ordinal, '' AS default_model FROM placed")
def catalog_json_roundtrip(spark, sf):
    """One catalog document per provider, written as JSON and read back."""
    entries = unique_models(spark, sf)
    defaults = entries.select("provider", F.lit("").alias("default_model")).distinct()
    objects = catalog_json.provider_json(entries, defaults)
    document = F.concat(F.lit('{"version": 1, "providers": {"'), F.col("provider"), F.lit('": '), F.col("json"), F.lit("}}"))
    back = catalog_json.parse_catalogs(objects.select(document.alias("text")))
    return back.select("provider", "id", "label", "enabled", "source", "visibility", F.col("capabilities.vision").alias("vision"), "discovered_at", "ordinal", "default_model")


@query("provider_profiles", f"""
WITH {UNIQUE_SQL}, pool AS (SELECT provider, list(id ORDER BY ordinal) AS ids FROM placed WHERE enabled GROUP BY 1),
p AS (SELECT s_suppkey, 'Brand#' || s_suppkey AS name, CASE WHEN s_nationkey % 2 = 0 THEN 'openai_compatible' ELSE 'google_translate' END AS type, s_acctbal > 0 AS enabled, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'http://b' END AS url FROM supplier),
j AS (SELECT p.*, ids, coalesce(list_filter(ids, lambda x: x = 'red widget')[1], CASE WHEN ids IS NULL THEN 'own-a' END) AS d FROM p LEFT JOIN pool ON provider = name)
SELECT name, type, enabled, array_to_string(CASE WHEN ids IS NULL THEN ['own-a', 'own-b'] WHEN d IS NULL THEN ids ELSE list_concat([d], list_filter(ids, lambda x: x <> d)) END, '|') AS models,
  coalesce(d, ids[1]) AS default_model, type <> 'google_translate' AS supports_glossary, '[REDACTED_API_KEY],[REDACTED_API_KEY]' AS api_keys, type = 'openai_compatible' AND url <> '' AS supports_refresh FROM j
""")
def provider_profiles(spark, sf):
    entries = unique_models(spark, sf)
    defaults = entries.filter("enabled AND id = 'red widget'").select("provider", F.col("id").alias("default_model"))
    providers = table(spark, sf, "supplier").select(
        F.concat(F.lit("Brand#"), F.col("s_suppkey")).alias("name"), F.when(F.col("s_nationkey") % 2 == 0, " OpenAI_Compatible").otherwise("google_translate").alias("type"),
        (F.col("s_acctbal") > 0).alias("enabled"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise("http://b").alias("base_url"),
        F.array(F.col("s_name"), F.lit("k")).alias("api_keys"), F.array(F.lit("own-a"), F.lit("own-b")).alias("models"), F.lit(None).cast("boolean").alias("supports_glossary"),
    )
    out = C.public_profiles(C.provider_profiles(providers, entries, defaults))
    return out.select(
        "name", "type", "enabled", F.array_join("models", "|").alias("models"), "default_model", "supports_glossary",
        F.array_join("api_keys", ",").alias("api_keys"), "supports_refresh",
    )


# --- files --------------------------------------------------------------------------------

_EXT = [".TXT", ".pdf", ".xlsx", ".PNG", ".exe", "", ".ppt"]
_PATH_SQL = "CASE WHEN page_id % 50 = 0 THEN '/etc/' || page_id WHEN page_id % 31 = 0 THEN '/data/../' || page_id ELSE '/data/' || md5(url) END || [" + ", ".join(text(e) for e in _EXT) + "][CAST(page_id % 7 AS INTEGER) + 1]"


@query("file_manifest", f"""
WITH f AS (SELECT page_id, {_PATH_SQL} AS path, lower([{', '.join(text(e) for e in _EXT)}][CAST(page_id % 7 AS INTEGER) + 1]) AS ext, length(html) * 12000 AS size FROM pages)
SELECT path, ext, CASE WHEN contains(path, '..') THEN 'path_traversal' WHEN path LIKE '/etc%' THEN 'restricted_path' WHEN ext NOT IN {in_list(V.ALLOWED_EXTENSIONS)} THEN 'unsupported_extension'
  WHEN size / (1024 * 1024) > 100 THEN 'file_too_large' END AS reject_reason, size / (1024 * 1024) > 30 AS is_large, {mapped('ext', {e: r for e, (r, _) in V.FILE_ROUTES.items()})} AS route,
  left(path, length(path) - length(ext)) || '_translated_20240506' || {mapped('ext', {e: o for e, (_, o) in V.FILE_ROUTES.items()})} AS output_name FROM f
""")
def file_manifest(spark, sf):
    key = F.col("page_id")
    ext = F.get(F.array(*[F.lit(e) for e in _EXT]), (key % 7).cast("int"))
    folder = (
        F.when(key % 50 == 0, F.concat(F.lit("/etc/"), key)).when(key % 31 == 0, F.concat(F.lit("/data/../"), key))
        .otherwise(F.concat(F.lit("/data/"), F.md5("url")))
    )
    listed = texts(spark, sf, "pages").select(F.concat(folder, ext).alias("path"), (F.length("html") * 12000).cast("bigint").alias("length"))
    return files.manifest_rows(listed, F.lit("2024-05-06").cast("date")).drop("length")


@query("decode_files", r"""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md5(regexp_replace(text, '\r\n?', chr(10), 'g')) ELSE md5(regexp_replace(text, '\r\n?', chr(10), 'g')) END AS digest, 'utf-8-sig' AS encoding_used FROM documents
""")
def decode_files(spark, sf):
    """Whole texts as file contents, every third with a byte order mark."""
    docs = texts(spark, sf)
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(files.BOM), F.col("text"))).otherwise(F.col("text")).cast("binary")
    decoded = files.decode_bytes(docs.select("doc_id", content.alias("content")))
    return decoded.select("doc_id", F.md5("text").alias("digest"), "encoding_used")


@query("decode_single_byte_files")
def decode_single_byte_files(spark, sf):
    """Texts stored in a single-byte code; which codec accepts them depends on their bytes."""
    docs = texts(spark, sf)
    fits = ~F.col("text").rlike(r"[^\x00-\xff]")
    content = F.when(fits, F.encode(F.when(fits, F.col("text")), "ISO-8859-1")).otherwise(F.col("text").cast("binary"))
    return files.decode_bytes(docs.select("doc_id", content.alias("content"))).select("doc_id", "encoding_used", F.length("text").alias("chars"))


@query("decode_codec_files", """
SELECT c_custkey, c_name || CASE c_custkey % 4 WHEN 1 THEN chr(12354) WHEN 2 THEN chr(233) || ' x' WHEN 3 THEN chr(65533) || ' x' ELSE '' END AS text,
  CASE c_custkey % 4 WHEN 0 THEN 'utf-8-sig' WHEN 1 THEN 'cp932' WHEN 2 THEN 'cp1252' ELSE 'utf-8-replace' END AS encoding_used FROM customer
""")
def decode_codec_files(spark, sf):
    """Names followed by bytes that one codec of the list after the other accepts: Japanese, Western, none."""
    key = F.col("c_custkey") % 4
    tail = F.unhex(F.when(key == 1, "82A0").when(key == 2, "E92078").when(key == 3, "812078").otherwise(""))
    content = F.concat(F.col("c_name").cast("binary"), tail)
    return files.decode_bytes(table(spark, sf, "customer").select("c_custkey", content.alias("content")))


@query("job_folder_scan", """
SELECT 'jobs/' || c_mktsegment || '/job_' || c_custkey AS folder, CASE WHEN c_custkey % 17 <> 0 AND c_custkey % 19 <> 0 THEN 'job_' || c_custkey END AS job_id,
  CASE WHEN c_custkey % 17 <> 0 THEN CAST(c_nationkey AS INTEGER) END AS total_segments, c_custkey % 17 = 0 OR c_custkey % 19 = 0 AS is_corrupt FROM customer
""")
def job_folder_scan(spark, sf):
    """Every customer as a job folder with its small file; some are cut short, some lack their id."""
    key = F.col("c_custkey")
    whole = F.to_json(F.struct(F.when(key % 19 != 0, F.concat(F.lit("job_"), key)).alias("job_id"), F.lit("running").alias("status"), F.col("c_nationkey").cast("int").alias("total_segments")))
    job = table(spark, sf, "customer").select(
        F.concat(F.lit("jobs/"), "c_mktsegment", F.lit("/job_"), key, F.lit("/job.json")).alias("path"),
        F.when(key % 17 == 0, F.substring(whole, 1, 20)).otherwise(whole).alias("text"),
    )
    notes = table(spark, sf, "nation").select(F.concat(F.lit("jobs/notes_"), "n_nationkey", F.lit(".txt")).alias("path"), F.col("n_name").alias("text"))
    root = new_shared_path(spark, "job-folders")
    small_files.write_files(job.unionByName(notes), root)
    found = files.job_files(spark, root)
    return found.select(F.regexp_extract("path", r"(jobs/.*)/job\.json$", 1).alias("folder"), "job_id", "total_segments", "is_corrupt")


@query("table_detections", """
WITH t AS (SELECT l_orderkey AS doc_id, l_linenumber % 3 AS page, CAST(l_quantity AS INTEGER) % 4 AS rows_, CAST(l_suppkey % 3 AS INTEGER) AS cols_, CASE WHEN l_returnflag = 'A' THEN 'lattice' ELSE 'stream' END AS method,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS table_no, l_extendedprice AS accuracy FROM lineitem),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, rows_, cols_ ORDER BY l_no) AS n FROM (SELECT *, accuracy AS l_no FROM t) WHERE method = 'stream'
  AND (doc_id, page, rows_, cols_) NOT IN (SELECT (doc_id, page, rows_, cols_) FROM t WHERE method = 'lattice'))
SELECT doc_id, page, rows_ AS rows, cols_ AS cols, method, accuracy FROM t WHERE method = 'lattice'
UNION ALL SELECT doc_id, page, rows_, cols_, method, accuracy FROM s WHERE n = 1
""")
def table_detections(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3).alias("page"), (F.col("l_quantity").cast("int") % 4).alias("rows"),
        (F.col("l_suppkey") % 3).cast("int").alias("cols"), F.when(F.col("l_returnflag") == "A", "lattice").otherwise("stream").alias("method"),
        F.col("l_extendedprice").alias("table_no"), F.col("l_extendedprice").alias("accuracy"),
    )
    return B.merge_table_detections(lines).drop("table_no")

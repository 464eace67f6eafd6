import hashlib
import re

import pytest
from pyspark.sql import functions as F

from glossaline import fixed_values as V
from glossaline.functions import encoding, errors, language, linguistic, redaction
from glossaline.functions import text as T
from glossaline.operators.fit import width_units


def column(spark, values, expr, types="v STRING"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i INT, {types}").select("i", expr(F.col("v")).alias("r"))
    return [r["r"] for r in df.orderBy("i").collect()]


def test_normalize(spark):
    texts = ["  hello   world  ", "hello\n  world   \t ", "\n\nhello\n\n", "", "a\r\nb\x85c\u2028d", "a\n\n \n b", "\x1fa\xa0\n"]
    want = ["\n".join(re.sub(r"[ \t]+", " ", x).strip() for x in t.splitlines()).strip() for t in texts]
    assert column(spark, texts, T.normalize) == want


def test_segment_hash_is_sha256_of_key(spark):
    got = column(spark, ["  こんにちは   世界  "], lambda c: T.segment_hash(F.lit(" JA "), F.lit("Vi"), c))
    assert got == [hashlib.sha256("ja:vi:こんにちは 世界".encode()).hexdigest()]


def test_lines_like_splitlines(spark):
    texts = ["a\nb\n", "a\r\nb", "x", "\n", "a\u2029b\x1cc"]
    assert column(spark, texts, T.lines) == [t.splitlines() for t in texts]


def test_chunks_keep_every_character(spark):
    text = "𝄞é\n" * 4000
    got = column(spark, [text], T.chunks)[0]
    assert "".join(got) == text and [len(c) for c in got] == [4500, 4500, 3000]


@pytest.mark.parametrize("flavor", ["word", "slides"])
def test_skipped_texts(spark, flavor):
    skipped = ["VJ767", "7kg + 20kg", "0.000", "/06", "https://x.y/z", "a@b.co", "C:\\a\\b", "PAGE 1", "  "]
    kept = ["H", "l", "Hello world", "chapter 12 begins", "Năm 2024"]
    reasons = column(spark, skipped + kept, lambda c: linguistic.skip_reason(c, flavor))
    assert all(reasons[: len(skipped)]) and reasons[len(skipped) :] == [None] * len(kept)
    assert column(spark, ["---"], lambda c: linguistic.skip_reason(c, flavor)) == (["no_alphanumeric"] if flavor == "word" else [None])


def test_unchanged_translation(spark):
    assert column(spark, ["H", "l", "", "VJ767", "Hello"], linguistic.unchanged_is_fine) == [True, True, True, True, False]


def test_failed_translations(spark):
    bad = ["", "   ", "Translation failed: timeout", "error: API limit reached", "Failed to translate cell", None]
    assert column(spark, bad + ["Xin chào"], linguistic.is_failed_translation) == [True] * 6 + [False]


def test_mojibake_detection_and_repair(spark):
    plain = "Tiếng Việt có dấu"
    broken = plain.encode("utf-8").decode("latin-1")
    via_cp1252 = "Xin chào thế giới".encode("utf-8").decode("cp1252", errors="ignore")
    assert column(spark, [broken, plain, "a\ufffd"], encoding.has_mojibake) == [True, False, True]
    repaired = column(spark, [broken, plain, "a\ufffd", via_cp1252], encoding.repair_mojibake)
    assert repaired[:3] == [plain, plain, "a\ufffd"]
    assert repaired[3] in ("Xin chào thế giới", via_cp1252)


def test_first_pattern_in_list_order(spark):
    assert column(spark, ["xx áº Tiáº"], encoding.first_mojibake_pattern) == ["Tiáº"]


def test_redaction_leaves_no_key(spark):
    key = "AIzaSySentinelTestKey1234567890"
    texts = [f"failed with {key}", "google_api_key = abc, rest", "my sentinel_key_9 x"]
    got = column(spark, texts, redaction.redact_secrets)
    assert got == [f"failed with {V.KEY_MASK}", f"{V.KEY_MASK}, rest", f"my {V.KEY_MASK} x"]


def test_redact_rows_at_any_depth(spark):
    key = "AIzaSy1234567890"
    df = spark.createDataFrame([({"k": [key, "ok"]}, (key, 3))], "m MAP<STRING, ARRAY<STRING>>, s STRUCT<a: STRING, n: INT>")
    row = redaction.redact_rows(df).first()
    assert row["m"] == {"k": [V.KEY_MASK, "ok"]} and tuple(row["s"]) == (V.KEY_MASK, 3)


def test_bundle_drops_sensitive_fields(spark):
    df = spark.createDataFrame([("/a/b.pdf", ("secret", "x", "uses sk-1"))], "input_file STRING, q STRUCT<source_text: STRING, label: STRING, note: STRING>")
    out = redaction.sanitize_bundle(df)
    assert out.schema["q"].dataType.names == ["label", "note"]
    assert tuple(out.first()["q"]) == ("x", "[redacted]") and out.first()["input_file"] == "b.pdf"


def test_report_text_redaction(spark):
    got = column(spark, ["Prompt leaked with AIza-secret and Bearer token", "fine", None], redaction.redact_whole)
    assert got == ["[redacted]", "fine", None]


def test_mask_key(spark):
    assert column(spark, ["", " abc ", "abcd", "abcdefgh"], redaction.mask_key) == ["", "***", "***", "****efgh"]


def test_error_classes(spark):
    texts = ["HTTP 401", "Quota exceeded", "400 invalid model", "token limit hit", "request timed out", "connection refused", "unknown model", "410 gone", "bad gateway",
             "??", "provider_5xx", "auth_failure"]
    assert column(spark, texts, errors.error_class) == [
        "auth_failure", "quota_rate_limit", "model_error", "token_limit", "timeout", "transport_error", "model_error", "model_unavailable", "provider_5xx",
        "unknown_transport_error", "provider_5xx", "auth_failure",
    ]


def test_refined_status(spark):
    got = column(spark, ["HTTP 404 no such model", "HTTP 404 here", "HTTP 400 bad field"], lambda c: errors.refined_health_status(F.lit("transport_error"), c))
    assert got == ["model_not_found", "endpoint_not_found", "payload_error"]


def test_languages(spark):
    assert column(spark, ["zh", "ZH_cn", "auto", "AUTO", "fr", None], language.normalize_code) == ["zh-CN", "zh-CN", "auto", "auto", "fr", None]
    assert column(spark, ["ja", "xx", "Auto"], language.ocr_code) == ["jpn+eng", "eng", "jpn+eng+vie+chi_sim"]
    pairs = spark.createDataFrame([("en", "vi"), ("", "vi"), ("auto", "auto"), ("en", "en"), ("xx", "vi"), ("en", "yy")], "s STRING, t STRING")
    got = [r[0] for r in pairs.select(language.pair_reject_reason(F.col("s"), F.col("t"))).collect()]
    assert got == [None, "missing_source", "auto_to_auto", "same_language", "unsupported_source", "unsupported_target"]
    evidence = [("Xin chào của tôi", "vi"), ("日本", "ja"), ("汉字", "zh"), ("Hello there", "en"), ("12345", "en"), ("x", "de")]
    df = spark.createDataFrame(evidence, "t STRING, c STRING")
    assert [r[0] for r in df.select(language.language_evidence(F.col("t"), F.col("c"))).collect()] == [True, True, True, True, False, None]


def test_versions(spark):
    assert column(spark, ["2.6.0", "2.5", "2.4.9", "x", "10.0"], lambda c: T.is_newer_version(c, F.lit("2.5"))) == [True, False, False, False, True]


def reference_width(ch):
    if ch.isspace():
        return 33
    if re.match("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]", ch):
        return 100
    for chars, width in (("0123456789", 56), ("ilIjtfr", 34), ("mwMW@#%&", 92), (".,;:'`!|", 24), ("-_()/\\[]{}", 32), ("+*=<>^~", 52)):
        if ch in chars:
            return width
    return 70 if ch.isupper() else 58


def test_width_units(spark):
    texts = ["Hello, (World)-[42] {x}/\\_", "日本 ABC Éé", "ilIjtfr mwMW@#%&", "+*=<>^~"]
    assert column(spark, texts, width_units) == [sum(map(reference_width, t)) for t in texts]


def test_lines_and_normalized_texts_equal_the_patterns_whatever_the_white_space(spark):
    import itertools
    import re

    from glossaline import fixed_values as V
    from glossaline.functions import text as T

    signs = ["a", " ", "\n", "\r", "\t", " ", "\xa0", "\x1f"]
    texts = ["".join(p) for n in range(5) for p in itertools.product(signs, repeat=n)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", T.lines(df.t).alias("l"), T.line_count(df.t).alias("n"), T.normalize(df.t).alias("s")).collect():
        parts = re.split(V.LINE_END, row.t)
        parts = parts[:-1] if parts[-1] == "" else parts
        inline = f"[{V.INLINE_SPACE_CLASS}]*"
        tidy = re.sub(f"{inline}\n{inline}", "\n", re.sub(V.LINE_END, "\n", re.sub(r"[ \t]+", " ", row.t))).strip(V.WHITESPACE)
        assert (row.l, row.n, row.s) == (parts, len(parts), tidy), repr(row.t)

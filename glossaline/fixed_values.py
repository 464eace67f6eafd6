"""Word lists, limits, patterns and lookup tables the results depend on."""

from __future__ import annotations

# --- fixed values: characters -------------------------------------------------------------
# White space as str.strip() sees it, and the line ends str.splitlines() breaks on.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
INLINE_SPACE_CLASS = r"\t\x1f\x20\xa0\u1680\u2000-\u200a\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
ALNUM_CLASS = r"\p{L}\p{N}"
# Characters with a digit value: decimal digits plus super/subscript and enclosed digits.
DIGIT_VALUE_CLASS = (
    r"\p{Nd}²³¹፩-፱᧚⁰⁴-⁹₀-₉①-⑨⑴-⑼"
    r"⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒"
)

# --- fixed values: languages --------------------------------------------------------------
SUPPORTED_LANGUAGES = ["auto", "en", "ja", "vi", "zh", "zh-CN", "zh-TW", "zh-cn", "zh-tw"]
LANGUAGE_CODE_MAP = {"zh": "zh-CN", "zh-cn": "zh-CN", "zh-tw": "zh-TW", "zh_cn": "zh-CN", "zh_tw": "zh-TW"}
OCR_LANGUAGE_MAP = {
    "ja": "jpn+eng",
    "en": "eng",
    "vi": "vie+eng",
    "zh": "chi_sim+eng",
    "zh-cn": "chi_sim+eng",
    "zh-tw": "chi_tra+eng",
}
OCR_AUTO = "jpn+eng+vie+chi_sim"
OCR_DEFAULT = "eng"
VIETNAMESE_LETTERS = "àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ"
VIETNAMESE_WORDS = ["của", "và", "là", "được", "cho", "với", "trong", "này", "đó", "có", "không"]
LANGUAGE_NAMES = {
    "vi": ["vi", "vietnamese"],
    "ja": ["ja", "japanese"],
    "zh": ["zh", "zh-cn", "chinese"],
    "en": ["en", "english"],
}

# --- fixed values: limits -----------------------------------------------------------------
MAX_CHUNK_CHARS = 4500
SUB_CHUNK_CHARS = 4000
MAX_GLOSSARY_TERMS = 20
MIN_CACHE_CHARS = 2
PREVIEW_CHARS = 80
ERROR_MESSAGE_CHARS = 500
MAX_FILE_MB = 100
WARN_FILE_MB = 30
COOLDOWN_SECONDS = 300
MAX_RETRIES = 2
DEFAULT_LATENCY = 500.0
DEFAULT_QUALITY = 5.0
LATENCY_KEEP = 0.8
LATENCY_NEW = 0.2
REFRESH_TTL_HOURS = 24
FRAGMENTED_MIN_RUNS = 2
FRAGMENTED_MIN_CHARS = 20
SCANNED_MAX_CHARS = 100
SCANNED_PAGES = 3
WHITE_PIXEL = 250
BATCH_DELIMITER = "|||TXSEP|||"

# --- fixed values: translation memory -----------------------------------------------------
FAILED_TRANSLATION_MARKS = ["translation failed", "error:", "exception:", "timeout", "failed to translate"]
TM_POLICIES = ["tm_prefer_cache", "tm_suggest_only", "tm_retranslate_and_update", "tm_disabled"]
GLOSSARY_CSV_HEADER = ["source_term", "target_term", "source_lang", "target_lang", "domain", "note", "is_active"]
INACTIVE_MARKS = ["0", "false", "no", "f"]

# --- fixed values: jobs -------------------------------------------------------------------
JOB_STATUSES = ["pending", "running", "paused", "completed", "failed", "cancelled"]
RESUMABLE_STATUSES = ["pending", "running", "paused", "failed"]
CHECKPOINT_EVENTS = [
    "segment_started",
    "segment_completed",
    "segment_completed_after_retry",
    "segment_failed",
    "provider_success",
    "provider_fail",
    "job_paused",
    "job_completed",
    "job_failed",
    "job_resumed",
]

# --- fixed values: text that is not language ----------------------------------------------
URL_PATTERN = r"(?iU)^(?:https?://|www\.)\S+$"
EMAIL_PATTERN = r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+$"
DOCUMENT_PATH_PATTERN = (
    r"^(?:[A-Za-z]:\\|\\\\)(?:[^\\]+\\)*[^\\]+$|^(?:/[A-Za-z0-9_-]+){2,}(?:\.[A-Za-z0-9]+)?$"
)
SLIDE_PATH_PATTERN = r"^(?:[A-Za-z]:\\|\\\\|/)[^\r\n]+$"
FIELD_HINT_PATTERN = r"(?iU)\b(?:HYPERLINK|MERGEFIELD|PAGE|NUMPAGES|TOC)\b"
FLIGHT_CODE_PATTERN = r"^[A-Z]{1,4}\p{Nd}{1,4}[A-Z]?$"
NUMERIC_PATTERN = r"(?U)^[\p{Nd}\s.,:/()%+\-]+$"

# --- fixed values: redaction --------------------------------------------------------------
KEY_MASK = "[REDACTED_API_KEY]"
GOOGLE_KEY_PATTERN = r"AIza[0-9A-Za-z\-_]{8,}"
SECRET_PATTERNS = [
    GOOGLE_KEY_PATTERN,
    r"(?iU)\b(?:gemini|google)?[_-]?api[_-]?key\b\s*[:=]\s*[^\s,;]+",
    r"(?iU)\bsentinel(?:[_-]?api)?(?:[_-]?key)?[0-9A-Za-z\-_]*\b",
]
AUTH_HEADER_PATTERN = r"(?iU)Authorization\s*:\s*Bearer\s+[^\s,;]+"
AUTH_HEADER_MASK = "Authorization: [REDACTED_API_KEY]"
BEARER_PATTERN = r"(?iU)Bearer\s+[^\s,;]+"
BEARER_MASK = "Bearer [REDACTED_API_KEY]"
ROUTER_BEARER_PATTERN = r"(?iU)Bearer\s+[A-Za-z0-9\-\._~+/=]+"
ROUTER_BEARER_MASK = "Bearer [REDACTED]"
ROUTER_SK_PATTERN = r"sk-[A-Za-z0-9\-_]+"
ROUTER_BANNED_WORDS = ["api_key", "authorization", "prompt", "source_text"]
ROUTER_BANNED_MASK = "[REDACTED_SENSITIVE_ERROR]"
REPORT_MASK = "[redacted]"
REPORT_MARKS = ["AIza", "sk-", "Bearer ", "prompt", "source text:", "translated text:"]
BUNDLE_MARKS = ["AIza", "sk-", "Bearer ", "Authorization", "prompt", "source text:", "translated text:"]
BUNDLE_SENSITIVE_KEYS = [
    "text", "prompt", "api_key", "authorization", "hash", "image_bytes", "grayscale_samples", "source_span_ids",
]
BUNDLE_PATH_KEYS = ["input_file", "output_file", "source_path", "path", "document_id"]

# --- fixed values: provider errors --------------------------------------------------------
AUTH_HINTS = [
    "401", "403", "unauthorized", "authentication", "auth failure", "invalid api key", "incorrect api key",
    "permission denied", "forbidden", "api key", "invalid key",
]
QUOTA_HINTS = ["429", "quota", "rate limit", "rate_limit", "resource exhausted", "too many requests"]
CALL_TIMEOUT_SECONDS = 30
TIMEOUT_HINTS = ["timeout", "timed out"]
TRANSPORT_HINTS = [
    "connection failed", "connection aborted", "connection refused", "connection reset", "connection error",
    "actively refused", "winerror 10061", "winerror 10054", "winerror 11001", "remote end closed connection",
    "temporary failure in name resolution", "name or service not known", "no address associated with hostname",
    "network is unreachable", "failed to establish a new connection", "max retries exceeded",
]
MODEL_UNAVAILABLE_HINTS = ["404", "410", "not found", "model unavailable"]
MODEL_ERROR_HINTS = ["invalid model", "model not found", "unknown model", "unsupported model"]
TOKEN_LIMIT_HINTS = ["token limit", "token_limit", "prompt token", "context length"]
SERVER_ERROR_HINTS = [
    "500", "502", "503", "504", "server error", "bad gateway", "service unavailable", "gateway timeout",
]
ERROR_CLASSES = [
    "auth_failure", "quota_rate_limit", "model_error", "token_limit", "timeout", "transport_error",
    "model_unavailable", "provider_5xx", "unknown_transport_error",
]
HEALTH_STATUS_BY_ERROR = {
    "auth_failure": "auth_error",
    "quota_rate_limit": "quota_or_rate_limited",
    "token_limit": "quota_or_rate_limited",
    "timeout": "timeout",
    "transport_error": "network_error",
    "unknown_transport_error": "network_error",
    "model_error": "model_not_found",
    "model_unavailable": "model_not_found",
    "provider_5xx": "network_error",
    "endpoint_not_found": "endpoint_not_found",
    "payload_error": "payload_error",
    "cancelled": "cancelled",
    "provider_wrapper_error": "provider_wrapper_error",
}
MODEL_HINTS_404 = ["model", "engine", "no endpoints found", "does not exist", "no such model", "unknown model"]
MODEL_HINTS_400 = ["model", "engine", "not found", "does not exist", "no such model", "unknown model"]
RECHECK_AUTH = [
    "api key", "api_key", "invalid key", "unauthorized", "auth", "credential", "forbidden", "403", "401",
]
RECHECK_QUOTA = ["429", "quota", "rate limit", "exhausted", "too many requests"]
RECHECK_MODEL = ["model", "engine", "does not exist", "unknown model", "unsupported model"]
RECHECK_WRAPPER = ["fallback is disabled", "ai translation failed"]
QUALITY_SCORES = {
    "gemini": 9.0, "groq": 7.5, "cerebras": 7.5, "openrouter": 8.0, "mistral": 7.0, "sambanova": 7.5,
    "github": 7.5, "ai21": 7.5, "cloudflare": 6.5, "huggingface": 6.5, "google": 5.0,
}

# --- fixed values: model catalog ----------------------------------------------------------
SOURCE_PRIORITY = {"user": 4, "api_discovered": 3, "docs_known": 2, "seed": 1, "legacy": 1}
VISIBILITY_PRIORITY = {"live_validated": 4, "current_key_visible": 3, "unverified": 2, "unavailable": 1}
TEXT_MODELS = [
    "gemini-3.5-flash", "gemini-3.1-flash-lite", "gemini-2.5-flash", "gemini-2.5-flash-lite",
    "gemini-3-flash-preview", "gemma-4-31b-it", "gemma-4-26b-a4b-it",
]
VISION_MODELS = ["gemini-2.5-flash", "gemini-3-flash-preview"]
MEDIA_WORDS = ["imagen", "veo", "tts", "native-audio", "audio", "robotics", "computer-use"]
VISION_WORDS = ["vision", "vl", "multimodal", "gui"]
REFRESH_STATUSES = ["never", "success", "error"]

# --- fixed values: page layout ------------------------------------------------------------
# Signs that make a formula by themselves, and spreadsheet-like references.
FORMULA_PATTERN = r"(?iU)(?:[=^∑√∫±≤≥≈]|\bSUM\(|\bAVG\(|\b[A-Za-z]\d+:\w+\d+\b)"
CAPTION_CUE_PATTERN = (
    r"(?iU)(?:\bfigure\b|\bfig\.\b|\btable\b|\bchart\b|\bcaption\b|hình|図|表|biểu\s+đồ)"
)
CHART_CUE_PATTERN = r"(?iU)(?:\bfigure\b|\bfig\.\b|\bchart\b|hình|図|表|biểu\s+đồ)"
NO_PARAGRAPH_FLAGS = ["protected", "formula_like", "table_like", "noisy", "non_translatable"]
PROTECTED_KINDS = ["formula", "image", "drawing", "table", "chart", "scanned_page"]
UNTRANSLATABLE_KINDS = ["formula", "table", "image", "drawing", "chart", "scanned_page", "noisy"]

# Why a block is a candidate or a region; the texts stand in published reports.
FORMULA_FLAG_REASON = "formula_like flag from canonical model"
FORMULA_TOKEN_REASON = "math-like token pattern"
FORMULA_SHORT_REASON = "short block with high symbol/digit ratio"
TABLE_FLAG_REASON = "table_like flag from canonical model"
TABLE_DELIMITER_REASON = "delimiter-heavy block with numeric content"
NOISY_REASON = "tiny or non-informative text block"
CAPTION_REASON = "caption-like block near image or drawing"
CHART_REASON = "visual block with nearby chart or figure caption cue"
VISUAL_REASON = "non-text visual block"
SCANNED_REASON = "page contains only visual blocks and no translatable text"

# --- fixed values: the translation prompt -------------------------------------------------
PROMPT_TASK = "Translate the following text from "
PROMPT_TO = " to "
PROMPT_RULE = ".\nProvide ONLY the translation, without any explanations or notes.\n"
PROMPT_GLOSSARY = "\nUse this glossary strictly:\n"
PROMPT_TEXT = "\nTEXT: "
PROMPT_ANSWER = "\n\nTRANSLATION:"

# --- fixed values: text width, in hundredths of the font size -----------------------------
CJK_CLASS = r"぀-ヿ㐀-䶿一-鿿豈-﫿"
CJK_HINTS = ["ja", "jp", "jpn", "zh", "zh-cn", "zh-tw", "zho", "cn", "ko", "kor"]
WIDTH_SPACE = 33
WIDTH_CJK = 100
WIDTH_DIGIT = 56
WIDTH_NARROW, NARROW_LETTERS = 34, "ilIjtfr"
WIDTH_WIDE, WIDE_LETTERS = 92, "mwMW@#%&"
WIDTH_POINT, POINT_MARKS = 24, ".,;:'`!|"
WIDTH_BRACKET, BRACKET_MARKS = 32, "-_()/\\[]{}"
WIDTH_SIGN, SIGN_MARKS = 52, "+*=<>^~"
WIDTH_UPPER = 70
WIDTH_OTHER = 58

# --- fixed values: visual comparison thresholds -------------------------------------------
VISUAL_THRESHOLDS = {
    "warning_mean": 0.15,
    "fail_mean": 0.35,
    "warning_max": 0.30,
    "fail_max": 0.60,
    "allow_page_count_mismatch": False,
    "allow_dimension_mismatch": False,
}

# --- fixed values: files ------------------------------------------------------------------
ALLOWED_EXTENSIONS = [
    ".xlsx", ".xls", ".docx", ".doc", ".pptx", ".ppt", ".txt", ".pdf", ".png", ".jpg", ".jpeg", ".bmp", ".gif",
    ".tiff", ".webp",
]
# extension -> (route, output extension)
FILE_ROUTES = {
    ".xlsx": ("excel", ".xlsx"),
    ".xls": ("excel", ".xlsx"),
    ".docx": ("word", ".docx"),
    ".doc": ("word", ".docx"),
    ".pptx": ("powerpoint", ".pptx"),
    ".ppt": ("powerpoint", ".pptx"),
    ".txt": ("text", ".txt"),
    ".pdf": ("pdf", ".docx"),
}
READ_ENCODINGS = ["utf-8-sig", "utf-8", "cp932", "shift_jis", "cp1252"]

# --- fixed values: mis-decoded text -------------------------------------------------------
MOJIBAKE_PATTERNS = [
    "Ã‚", "Ãƒ", "Ã„", "Ã…", "Ã†", "Ã‡", "Ãˆ", "Ã‰", "ÃŠ", "Ã‹", "ÃŒ", "ÃŽ",
    "Ã‘", "Ã’", "Ã“", "Ã”", "Ã•", "Ã–", "Ã—", "Ã˜", "Ã™", "Ãœ",
    "ÃŸ", "Ã¡", "Ã¢", "Ã³", "Ã´", "Ãµ", "Ã¶", "Ã·", "Ã¸", "Ã¹", "Ãº", "Ã»", "Ã¼",
    "ã‚", "ãƒ", "ã€", "ã€€", "ã‚¬", "ã‚®", "ã‚°", "ã‚²", "ã‚", "ã‚¶", "ã‚¸", "ã‚º", "ã‚¼",
    "ã‚¾", "ãƒ€", "ãƒぢ", "ãƒ竚", "ãƒ・", "ãƒ・",
    "縺", "譁", "繧", "繝",
    "Tiáº", "Há»", "Nháº", "Cáº", "áº", "á»", "áº¿", "á»‡", "áº¡", "áº£", "áº¥", "áº§", "áº©",
    "áº«", "áº\xad", "áº¯", "áº±", "áº¹", "áº»", "áº½", "áº¿", "á»?", "á»ƒ",
    "á»‡", "á»‰", "á»±", "á»»", "á»½",
    "Â\xa0", "Â°", "Â©", "Â®",
    "D辿", "Ngﾃ", "Khﾃ", "ﾆ", "ｷ", "蘯", "黛", "盻", "ﾄ", "辿", "ﾃ", "窶", "ﾜ",
]
REPLACEMENT_CHARACTER = "\ufffd"
# The characters cp1252 gives to bytes 0x80-0x9f, and those bytes.
CP1252_SPECIALS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_BYTES = (
    "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
)

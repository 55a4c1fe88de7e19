"""Tunable settings and fixed vocabularies.

Everything here is plain data: transforms take a ``Settings`` instance (or
use ``DEFAULT``) so a job can change thresholds without touching code.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values. These must stay equal to the behaviour being reproduced
# (thresholds, allowlist, label vocabularies, keyword lists), so they are
# written out literally, in their natural order.
# ---------------------------------------------------------------------------

EMAIL_THRESHOLD = 0.70
URL_THRESHOLD = 0.85
URL_OVERRIDE_THRESHOLD = 0.80
MAX_BATCH_SIZE = 32
MAX_PAYLOAD_BYTES = 5 * 1024 * 1024
MAX_UPLOAD_BYTES = 20 * 1024 * 1024
RATE_LIMIT_REQUESTS = 100
RATE_LIMIT_WINDOW_SECONDS = 60
RATE_LIMIT_EXEMPT_PATHS = ("/health", "/docs", "/openapi.json")
ALLOWLIST_CONFIDENCE = 0.99
HISTORY_DEFAULT_LIMIT = 100
TOP_IMPORTANCE_WORDS = 7

KNOWN_SAFE_DOMAINS = (
    "fastapi.tiangolo.com",
    "google.com",
    "github.com",
    "microsoft.com",
    "apple.com",
    "linkedin.com",
    "amazon.com",
    "youtube.com",
    "cloudflare.com",
)

TRACKING_PREFIXES = ("utm_",)
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid")

URL_LABEL_MAP = {
    "legitimate": 0,
    "benign": 0,
    "phishing": 1,
    "malware": 1,
    "defacement": 1,
    "spam": 1,
    "0": 0,
    "1": 1,
    "2": 1,
    "3": 1,
    "4": 1,
    "0.0": 0,
    "1.0": 1,
    "yes": 1,
    "valid": 1,
}

EMAIL_LABEL_MAP = {
    "legitimate": 0,
    "safe": 0,
    "safe email": 0,
    "ham": 0,
    "benign": 0,
    "spam": 1,
    "phishing": 2,
    "phishing email": 2,
    "malware": 2,
    "0": 0,
    "1": 1,
    "2": 2,
    "0.0": 0,
    "1.0": 1,
    "2.0": 2,
}

# The profiling script's own (drifted) email vocabulary.
LEGACY_EMAIL_LABEL_MAP = {
    "legitimate": 0,
    "legitimate email": 0,
    "ham": 0,
    "benign": 0,
    "spam": 1,
    "phishing": 2,
    "phishing email": 2,
    "malware": 2,
    "0": 0,
    "1": 1,
    "2": 2,
    "0.0": 0,
    "1.0": 1,
    "2.0": 2,
}

STOP_WORDS = (
    "the", "and", "to", "of", "a", "in", "for", "is", "on", "that", "by",
    "this", "with", "i", "you", "it", "not", "or", "be", "are", "from", "at",
    "as", "your", "we", "have", "will", "an", "has", "can", "if",
)

POSITIVE_CLASS_NAMES = ("phishing", "phishing email", "spam", "malware", "1", "2")
NEGATIVE_CLASS_NAMES = ("legitimate", "safe", "safe email", "benign", "ham", "0")

PHISHING_SOURCE_KEYWORDS = ("nazario", "phishing", "fraud", "nigerian")
URL_PATH_MARKERS = ("url datasets", "url_cleaned")
EMAIL_PATH_MARKERS = ("email datasets",)
URL_SOURCE_KEYWORDS = ("url", "phishtank", "majestic", "tranco", "top-1m")
PROFILE_URL_KEYWORDS = ("url", "phishtank")
EXCLUDED_SOURCE = "iscx-url-2016"
EXCLUDED_EMAIL_FILE = "it4lia_phishingemailcurateddatasets_cleaned.csv"

LABEL_NAME_HINTS = ("label", "status", "type", "class", "target", "verified")
PROFILE_LABEL_NAME_HINTS = ("label", "status", "type", "class")
TEXT_NAME_HINTS = ("text", "url", "body", "content", "message", "email", "domain")
BANNED_TEXT_NAME_PARTS = ("id", "file", "path", "rank", "index", "count", "ratio", "length", "len")

THREAT_FEED_HEADER = "# id,dateadded,url"
THREAT_FEED_SCAN_LINES = 100

SEED = 42
EMAIL_MAX_TOKENS = 512
URL_MAX_TOKENS = 128

MSG_ALLOWLIST = "Domain is in the verified safe allowlist."
MSG_PHISHING = "Phishing detected"
MSG_SPAM = "Spam detected"
MSG_SAFE = "Content appears safe"
MSG_UNKNOWN = "No valid text or URLs provided to analyze."
MSG_URL_OVERRIDE_NO_SCORES = "High-confidence phishing URL detected in content."
MSG_URL_ONLY_DEFAULT = "URL analysis only."
REASON_URL_OVERRIDE = "High-confidence phishing URL detected — "
REASON_EMAIL = "Email analysis — "
REASON_URL = "URL analysis — "
REASON_EMAIL_BODY = "Email body analysis: "

# Python's str.isspace() set, as a regex character-class body usable by both
# Java regex and RE2 (``\s`` differs between the two and from Python).
PY_WS_CLASS = (
    r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

PY_WS_CHARS = "".join(
    [chr(c) for c in range(0x9, 0xE)] + [chr(c) for c in range(0x1C, 0x21)]
    + [chr(0x85), chr(0xA0), chr(0x1680)] + [chr(c) for c in range(0x2000, 0x200B)]
    + [chr(0x2028), chr(0x2029), chr(0x202F), chr(0x205F), chr(0x3000)]
)

# Schemes for which an empty-host URL is rebuilt with "//" (stdlib urllib).
USES_NETLOC = (
    "", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file",
    "mms", "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu",
    "rsync", "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss",
    "itms-services",
)

# ---------------------------------------------------------------------------
# Lexical scorer vocabulary (ours). A transparent, SQL-expressible stand-in
# for a trained model: counts of cue substrings become rational class scores.
# ---------------------------------------------------------------------------

EMAIL_CUE_WORDS = {
    "legitimate": ("meeting", "thanks", "regards", "schedule", "report", "attached", "team", "the", "und", "la"),
    "spam": ("free", "offer", "winner", "prize", "discount", "cheap", "money", "unsubscribe", "spam"),
    "phishing": ("verify", "password", "account", "login", "bank", "urgent", "suspended", "confirm", "phishing",
                 "http", "https", "www"),
}
EMAIL_CUE_CHARS = {"legitimate": (), "spam": ("!", "$"), "phishing": ()}
EMAIL_PRIORS = {"legitimate": 2, "spam": 1, "phishing": 1}

URL_CUES = {
    "legitimate": ("https://", "/en/", "/de/"),
    "phishing": ("http://", "@", "login", "verify", "secure", "account", "update", "bank", "free", ".net", "ref=", "-", "%"),
}
URL_PRIORS = {"legitimate": 1, "phishing": 1}
URL_CUE_WEIGHT = 4


@dataclass(frozen=True)
class Settings:
    email_threshold: float = EMAIL_THRESHOLD
    url_threshold: float = URL_THRESHOLD
    url_override_threshold: float = URL_OVERRIDE_THRESHOLD
    max_batch_size: int = MAX_BATCH_SIZE
    max_payload_bytes: int = MAX_PAYLOAD_BYTES
    max_upload_bytes: int = MAX_UPLOAD_BYTES
    rate_limit: int = RATE_LIMIT_REQUESTS
    rate_window_seconds: int = RATE_LIMIT_WINDOW_SECONDS
    rate_exempt_paths: tuple = RATE_LIMIT_EXEMPT_PATHS
    allowlist_confidence: float = ALLOWLIST_CONFIDENCE
    safe_domains: tuple = KNOWN_SAFE_DOMAINS
    tracking_keys: tuple = TRACKING_KEYS
    tracking_prefixes: tuple = TRACKING_PREFIXES
    seed: int = SEED
    # Host rules beyond parity: scheme-less hosts are hosts; userinfo, port and
    # inner "www." do not change the allowlist lookup.
    bare_host: bool = False
    strict_host: bool = False
    # Largest side (rows) this library will ever hint as broadcast.
    broadcast_row_limit: int = 1_000_000
    extra: dict = field(default_factory=dict)


DEFAULT = Settings()

# The evaluation targets, as (must lie above, bound).
METRIC_TARGETS = {
    "phishing_precision": (True, 0.92),
    "phishing_recall": (True, 0.95),
    "macro_f1": (True, 0.93),
    "false_negative_rate": (False, 0.05),
    "false_positive_rate": (False, 0.03),
}

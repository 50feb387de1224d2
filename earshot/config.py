"""Frozen constants and small dimensions.

The values in this module are fixed: they must equal the published thresholds for results to
agree, so they are stated plainly and nowhere else.
"""

# Sources, in enum order.
SOURCES = (
    "reddit", "youtube", "youtube_comment", "tiktok", "instagram",
    "google_maps", "facebook", "trustpilot", "g2", "news",
)
REVIEW_SOURCES = ("google_maps", "facebook", "trustpilot", "g2")
COMMENT_SOURCES = ("reddit", "youtube_comment", "tiktok", "instagram")
THREAD_SOURCES = ("reddit", "youtube_comment")
AUTHOR_CLUSTER_SOURCES = ("tiktok", "instagram")
MENTION_CLUSTER_SOURCES = ("youtube", "google_maps", "facebook", "trustpilot", "g2", "news")
ENGAGEMENT_KEYS = ("upvotes", "likes", "comments", "shares", "views", "replies", "votes")

SEED = 777
B_LIVE = 2000
B_FROZEN = 10000
CI_LEVEL = 0.95
ALPHA = 0.05

WINDOW_DAYS = 14
SPLIT_DAYS = 7

MIN_CLUSTERS = 5
MIN_MENTIONS = 20

EVENT_MIN_COUNT = 5
EVENT_MAD_MULTIPLIER = 3.0
EVENT_MIN_CLUSTERS = 3
EVENT_DAYS = 14

TIEBREAK_CONFIDENCE = 0.6
TIEBREAK_CAP = 0.40
AUDIT_FRACTION = 0.10
RATING_NEGATIVE_MAX = 2
RATING_POSITIVE_MIN = 4
RATIONALE_WORDS = 20
RATIONALE_CHARS = 200
BATCH_SIZE = 20

H1_MAX_USD = 5.0
H2_MIN_DESIGN_EFFECT = 1.5
H3_MIN_AGREEMENT = 0.85
H4_MIN_USD = 0.0
STRATIFIED_SAMPLE = 50

TOPIC_MIN_SIZE = 3
TOPIC_MIN_BREADTH = 2
TOPIC_CUT = 0.35
TOPIC_EXEMPLARS = 3
TOPIC_NAME_WORDS = 6

TOP_MENTIONS = 10
QUOTE_CHARS = 240
TOP_K = 20
BRIEFS_PER_MONTH = 4
INCUMBENT_USD_MONTH = 349

TEXT_KEY_CHARS = 200
MIN_TOKEN_CHARS = 3

USABLE_STATUSES = ("ok", "cached")
FAILED_LABEL_STATUSES = ("refused", "unparseable", "error")
POLARITIES = ("positive", "negative", "neutral")
FAILED_RUN_STATUSES = ("TIMED_OUT", "FAILED", "BLOCKED", "STOPPED", "ABORTED", "CANCELLED")
BILLED = "/v1/runs"
VOICE_PROVIDER = "elevenlabs"
LLM_KINDS = ("classify", "tiebreak", "embed", "name_topic", "narrate", "ask")
EXCLUSION_REASONS = (
    "not_about_brand", "irrelevant_label", "refused", "unparseable", "error",
    "dedup_native_id", "dedup_url", "dedup_text",
)
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "mc_cid", "mc_eid",
)

# One row per source: provider, unit of the cap, caps (smoke, lite, full), price per result and
# per call, whether a lookup call comes first and what it costs, cluster rule.
SOURCE_PLAN_SCHEMA = (
    "source string, provider string, cap_unit string, cap_smoke int, cap_lite int, cap_full int, "
    "per_result_usd double, per_call_usd double, lookup_usd double, cluster_rule string, "
    "has_rating boolean, has_timestamps boolean"
)
SOURCE_PLAN = (
    ("reddit", "apify", "results", 40, 20, 40, 0.0057, 0.02, 0.0, "post_id", False, True),
    ("youtube", "apify", "results", 0, 5, 10, 0.0045, 0.0, 0.0, "mention_id", False, True),
    ("youtube_comment", "apify", "results", 0, 30, 60, 0.00225, 0.0, 0.0, "video_id", False, False),
    ("tiktok", "apify", "results", 0, 20, 40, 0.00045, 0.0, 0.0, "author_hash", False, True),
    ("instagram", "apify", "results", 0, 15, 30, 0.0, 0.00345, 0.0, "author_hash", False, False),
    ("google_maps", "apify", "results", 50, 25, 50, 0.000675, 0.0, 0.0, "mention_id", True, True),
    ("facebook", "apify", "results", 0, 15, 30, 0.003, 0.001, 0.0, "mention_id", True, True),
    ("trustpilot", "trustpilot", "calls", 0, 1, 1, 0.0, 0.03, 0.03, "mention_id", True, True),
    ("g2", "g2", "calls", 0, 1, 1, 0.0, 0.05, 0.02, "mention_id", True, True),
    ("news", "tinyfish", "pages", 0, 2, 3, 0.0, 0.0, 0.0, "mention_id", False, True),
)

# USD per million tokens: input, cached input, output.
MODEL_RATES_SCHEMA = "model string, input_usd double, cached_usd double, output_usd double"
MODEL_RATES = (
    ("gpt-5.6-luna", 0.20, 0.20, 1.20),
    ("gpt-5.6-terra", 2.00, 2.00, 12.00),
    ("text-embedding-3-small", 0.02, 0.02, 0.0),
)

# Secret patterns replaced by the redactor, and names of map keys whose value is blanked.
REDACTED = "[REDACTED]"
MIN_SECRET_CHARS = 8
SECRET_PATTERNS = (
    r"monid_(?:live|test)_[A-Za-z0-9]{8,}",
    r"sk-[A-Za-z0-9_-]{20,}",
    r"Bearer\s+[A-Za-z0-9._-]{8,}",
)
SECRET_KEY_PATTERN = r"(?i)authorization|api[-_]?key|token|secret|password|cookie"

# Patterns the privacy scan reports.
PRIVACY_PATTERNS = {
    "key_sk": r"sk-[A-Za-z0-9]{20,}",
    "key_monid": r"monid_live_[A-Za-z0-9]{20,}",
    "key_ghp": r"ghp_[A-Za-z0-9]{36}",
    "key_xoxb": r"xoxb-[0-9]{10,}-[A-Za-z0-9]{24,}",
    "key_akia": r"AKIA[A-Z0-9]{16}",
    "handle_twitter": r'"twitter_handle"\s*:\s*"[^"]*"',
    "handle_x": r'"x_handle"\s*:\s*"[^"]*"',
    "handle_instagram": r'"instagram_handle"\s*:\s*"[^"]*"',
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
}
PLACEHOLDER_PATTERN = r"(?U)\b(?:TBD|TODO)\b"

X_GAP = ("x", "unavailable", "no endpoint for this source")
X_NOTE = "x: no endpoint for this source"

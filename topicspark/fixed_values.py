"""Constants that results depend on and that must stay as they are."""

# --- text ------------------------------------------------------------------
# A web address, or any bare dotted lower-case word, up to and including the
# whitespace after it (flavour: leftmost-first, '.' excludes LF only).
URL_PATTERN = (
    r"(http:\/\/www\.|https:\/\/www\.|http:\/\/|https:\/\/)?[a-z0-9]+([\-\.]{1}[a-z0-9]+)*"
    r"\.[a-z]{2,5}(:[0-9]{1,5})?(\/.*)?\s"
)
URL_MASK = " __url__ "
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"
LABEL_PREFIX = "__label__"
SEGMENT_SEPARATOR = " ,.!?"
SUPPORTED_URL = r"^(?:http)s?://"

# --- sizes and thresholds -----------------------------------------------------
MIN_CONTENT_LENGTH = 100
FALLBACK_TEXT_LENGTH = 100
FRAGMENT_SIZE = 10
FEED_SAMPLE_SIZE = 20
EXTRACT_LIMIT = 3000
SUMMARY_SENTENCES = 5
NUM_KEYWORDS = 5
MIN_REQUEST_TOKENS = 5
MAX_REQUEST_TOKENS = 2048
MIN_ENTITY_LENGTH = 9
SEGMENT_LIMIT = 20
TOP_TFIDF_TERMS = 300
STACK_LABELS = 500
DASHBOARD_TOP = 30
MAX_DF = 0.8
LABEL_CANDIDATES = 4
LABEL_THRESHOLD = 0.001
SWEEP_THRESHOLDS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5)
DECISION_THRESHOLD = 0.5

# --- codes, names and messages ---------------------------------------------------
LANGUAGE_CODES = {"en": 0, "cn": 1}
LANGUAGE_NAMES = {"en": "English", "cn": "Chinese"}
TOO_SHORT = "Too short text for prediction."
TOO_LONG = "Too long text."
URL_MISSING = "URL missing in post data."
URL_UNSUPPORTED = "URL not supported."
TEXT_MISSING = "fulltext, description or title is missing in post data"
URL_NOT_FETCHABLE = "URL is wrong or not fetchable"
DEFAULT_TAG_LIST = [("python", "Python")]
DEFAULT_TAG_MAP = [("ML", "machine-learning")]
ARTICLE_HOST = "towardsdatascience.com"
EMBEDDING_SHARE = 1.0
UNUSED_SLOT = "[unused"
POSTER = "info.poster"

"""Values that define the data contract. Everything here is a fixed value."""

# Gate labels, and the ones that let a text into the store.
GATE_LABELS = ("store", "too_short", "chit_chat", "system_noise", "uncertain")
STORE_LABELS = ("store", "uncertain")

ENTRY_TYPES = ("observation", "decision", "action_item", "reference", "project_note")
TAG_COLUMNS = ("topics", "people", "projects", "action_items")

DUPLICATE_THRESHOLD = 0.98     # strictly greater
MEMORY_FLOOR = 0.3             # greater or equal, applied after the top-k limit
MEMORY_LIMIT = 3

SEARCH_LIMIT = 10
SEARCH_LIMIT_CAP = 50
RECENT_DAYS = 7
RECENT_LIMIT = 50
STATS_DAYS = 30
TOP_TAGS = 10

MONTHLY_BUDGET = 10.0
ALERT_LEVELS = (("warning", 0.8), ("exceeded", 1.0))  # of the unrounded share of the budget
MAX_ATTEMPTS = 3
IVF_LISTS = 100

# Column widths of the stored tables; longer values are quarantined.
MAX_SOURCE_CLIENT = 100
MAX_PROVIDER = 50
MAX_MODEL = 100
MAX_OPERATION = 50

DEFAULT_SOURCE = "unknown"
USER_TURN_SOURCE = "open_webui_user"
ASSISTANT_TURN_SOURCE = "open_webui_assistant"

DUPLICATE_REASON = "Near-duplicate entry already exists (cosine similarity > 0.98)"
MEMORY_SEPARATOR = "\n\n---\n\n"

# Texts of outcomes.
STORED_REASON = "Stored as {entry_type} (confidence {confidence})"
FILTERED_REASON = "Filtered by relevance gate: {label} — {reason}"
ERROR_REASON = "Error: {error}"
UNAVAILABLE_REASON = "Classifier unavailable: {error}"

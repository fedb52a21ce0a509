"""Table schemas of the data model, as Spark DDL."""

ITEM = "struct<type: string, text: string, image_url: string, file_url: string>"
MESSAGE = f"struct<role: string, content_text: string, content_items: array<{ITEM}>>"
REQUESTS = f"request_id string, ts timestamp, user_id string, session_id string, recent_rounds_full int, input array<{MESSAGE}>"
ROUNDS = f"user_id string, session_id string, round_no int, round_id string, ts timestamp, messages array<{MESSAGE}>, first_user_text string"
CONTEXTS = (
    "hash string, user_id string, session_id string, round_id string, kept_message string, omitted_messages string, "
    "query_text string, kept_text string, omitted_text string, created_at timestamp, expires_at timestamp"
)
MEMORIES = "id string, user_id string, data string, vector array<float>, hash string, created_at timestamp, updated_at timestamp"
ACTIONS = "request_id string, pos int, user_id string, id string, text string, event string, old_memory string"

#: Roles of messages and types of content items.
ROLES = ("user", "assistant", "system", "tool")
ITEM_TYPES = ("input_text", "input_image", "file")

#: Defaults of the service's settings.
ROUNDS_KEPT = 50
RECENT_FULL = 3
SESSION_TTL = 86_400
CONTEXT_TTL = 86_400
RELEVANCE = 0.35
SCORE = 1.2
TOP_K = 10
DIMS = 1024

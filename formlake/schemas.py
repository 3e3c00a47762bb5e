"""Fixed schemas of the store tables, the item table and the event tables."""

from pyspark.sql.types import (ArrayType, BinaryType, BooleanType, IntegerType, LongType,
                               MapType, StringType, StructField, StructType, TimestampType)

S, TS, L, B, I = StringType(), TimestampType(), LongType(), BooleanType(), IntegerType()

# Column order of the current-state table (one row per qid).
SUBMISSION_FIELDS = [
    ("qid", S), ("app_status", S), ("app_tid", S), ("app_pid", S), ("app_name", S),
    ("app_champion", S), ("app_team_email", S), ("user_name", S), ("timestamp", TS),
    ("answer", S), ("comments", S), ("action_items", S), ("submitter_email", S),
]
SUBMISSION = StructType([StructField(n, t) for n, t in SUBMISSION_FIELDS])
SUBMISSION_COLUMNS = [n for n, _ in SUBMISSION_FIELDS]

AUDIT = StructType([StructField("audit_id", L)] + SUBMISSION.fields
                   + [StructField("audit_timestamp", TS)])

# Append-only log from which current state and audit history are derived.
EVENT_LOG = StructType(SUBMISSION.fields + [StructField("seq", L), StructField("op", S),
                                            StructField("event_ts", TS)])

ANSWERS = StructType([StructField("qid", S), StructField("answers", MapType(S, S))])
CHANGES = StructType([StructField("qid", S), StructField("key", S), StructField("value", S),
                      StructField("ts", TS), StructField("seq", L)])
FILES = StructType([StructField("path", S), StructField("modificationTime", TS),
                    StructField("length", L), StructField("content", BinaryType())])
REQUESTS = StructType([StructField("ts", TS), StructField("client", S), StructField("path", S),
                       StructField("content_type", S), StructField("content_length", L)])
LOG = StructType([StructField("ts", TS), StructField("level", S), StructField("message", S),
                  StructField("seq", L)])
DIRECTORY = StructType([StructField("account", S), StructField("mail", S), StructField("name", S),
                        StructField("memberOf", ArrayType(S))])

# Status values of the review lifecycle.
DRAFT, SUBMITTED, IN_REVIEW, APPROVED = "Draft", "Submitted", "In Review", "Approved"
REVISION, DELETED = "Revision", "DELETED"

# One template item as written in JSON. Nested ``items`` stay raw JSON text so that
# the recursive tree can be parsed level by level (Spark has no recursive types).
ITEM_JSON_FIELDS = [
    ("type", S), ("id", S), ("text", S), ("cond", S), ("auth", S), ("className", S),
    ("warn", S), ("severity", S), ("why", S), ("name", S), ("todo", S), ("customTitle", S),
    ("default", S), ("required", B), ("inputType", S), ("inputPattern", S), ("inputTitle", S),
    ("placeholder", S), ("maxlength", I), ("yes", S), ("no", S), ("defaultChoice", B),
    ("choices", ArrayType(MapType(S, S))), ("choicesConds", ArrayType(MapType(S, S))),
    ("insertBefore", S), ("insertAfter", S),
]

# Flattened template: one row per item and per group choice, in pre-order.
ITEM = StructType([StructField(n, t) for n, t in [
    ("template_id", S), ("version", I), ("item_id", S), ("ordinal", I), ("depth", I),
    ("parent_id", S), ("parent_type", S), ("ancestors", ArrayType(S)), ("type", S),
    ("text", S), ("cond", S), ("auth", S), ("class_name", S), ("warn", B), ("severity", S),
    ("why", S), ("name", S), ("todo", S), ("custom_title", S), ("default_value", S),
    ("required", B), ("input_type", S), ("input_pattern", S), ("input_title", S),
    ("placeholder", S), ("maxlength", I), ("yes", S),
    ("no", S), ("default_choice", B), ("is_choice", B)]])

# Format settings of stored templates and answers: the class that hides an item and the
# answer-key prefix under which a to-do's status is stored. Set them to the values your
# stored templates and answers use.
INVISIBLE_CLASS = "invisible"
TODO_KEY_PREFIX = "todo_"

# Item types known to the questionnaire (fixed values).
KNOWN_TYPES = ["block", "box", "check", "checkgroup", "info", "line", "radio", "radiogroup",
               "spacer", "tip", "upload", "yesno"]
VALUE_TYPES = ["box", "check", "line", "radio", "tip", "upload", "yesno"]
CONTAINER_TYPES = ["block", "checkgroup", "radiogroup"]
GROUP_TYPES = {"checkgroup": "check", "radiogroup": "radio"}

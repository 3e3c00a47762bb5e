"""Scalar rules of the store and the forms, as Column builders (all JVM-side).

Each function takes and returns ``Column`` objects so it can be used inside any
``select``/``filter`` and stays within whole-stage code generation.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values of the reference (kept verbatim).
# ---------------------------------------------------------------------------
# Characters removed from stored text, in this order.
SANITIZE_REMOVALS = ["'", ";", "--", "|"]
# Ticket keys found in answers.
ACTION_ITEM_PATTERN = r"[A-Z]{2,}-\d+"
# A submission id: 12 alphanumeric characters.
QID_PATTERN = r"^[0-9A-Za-z]{12}$"
# Allowed user names (prefix match) and their maximum length.
USERNAME_PATTERN = r"^[a-zA-Z0-9@\\/.]+"
USERNAME_MAX_LENGTH = 40
# Accepted upload file extensions.
UPLOAD_EXTENSIONS = ["pdf", "odt", "doc", "docx"]
# Namespace of the two tracker keys in the answers (``<namespace>app_tid``/``app_pid``); a
# setting: use the prefix your stored answers carry.
TRACKER_NAMESPACE = "tracker:"
# Text of the generated "none" choice of groups.
DEFAULT_CHOICE_TEXT = "None of the above."
# Project summary layout.
PROJECT_SUMMARY_FORMAT = ("<b>Project overview:</b><br /><br />%s <br /><br />"
                          "<b>Significant changes:</b><br /><br />%s <br /><br />"
                          "<b>Security landscape changes:</b><br /><br />%s")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sanitize(col) -> Column:
    """Remove quote, semicolon, double dash and pipe (in that order); null stays null."""
    out = _c(col)
    for ch in SANITIZE_REMOVALS:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def truthy(col) -> Column:
    """A string answer counts as set when it is neither null nor empty."""
    return F.coalesce(_c(col), F.lit("")) != F.lit("")


def action_items(answers) -> Column:
    """All ticket keys in every answer value (key order), comma-joined; null if none."""
    entries = F.array_sort(F.map_entries(_c(answers)))
    found = F.flatten(F.transform(
        entries, lambda e: F.regexp_extract_all(F.coalesce(e["value"], F.lit("")),
                                                F.lit(ACTION_ITEM_PATTERN), 0)))
    return F.when(F.size(found) > 0, F.array_join(found, ","))


def action_items_text(text) -> Column:
    """Ticket keys in one text, comma-joined; null if none."""
    found = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(ACTION_ITEM_PATTERN), 0)
    return F.when(F.size(found) > 0, F.array_join(found, ","))


def action_item_links(action_items_col, base_url: str) -> Column:
    """Split the comma list and prefix every key with the tracker URL."""
    return F.transform(F.split(_c(action_items_col), ","), lambda i: F.concat(F.lit(base_url), i))


def valid_qid(col) -> Column:
    return F.coalesce(_c(col).rlike(QID_PATTERN), F.lit(False))


def valid_username(col) -> Column:
    c = _c(col)
    return F.coalesce(c.rlike(USERNAME_PATTERN) & (F.length(c) <= USERNAME_MAX_LENGTH), F.lit(False))


def like_contains_pattern(keyword) -> Column:
    """``%kw%`` for (I)LIKE with ``%``/``_`` kept as wildcards and backslash escaped."""
    kw = F.replace(sanitize(keyword), F.lit("\\"), F.lit("\\\\"))
    return F.concat(F.lit("%"), kw, F.lit("%"))


def upload_parts(col) -> Column:
    """``fileId|filename`` → struct(file_id, filename); null unless exactly two parts."""
    parts = F.split(_c(col), r"\|")
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("file_id"), parts[1].alias("filename")))


def upload_extension_ok(filename) -> Column:
    ext = F.lower(F.substring_index(_c(filename), ".", -1))
    return ext.isin(*UPLOAD_EXTENSIONS)


def tip_label(custom_title, warn, severity) -> Column:
    """Heading of a tip: custom title, else Warning (+ risk level), else Tip."""
    sev = F.nullif(_c(severity), F.lit(""))
    warning = F.when(sev.isNotNull(),
                     F.concat(F.lit("Warning — possible "), sev, F.lit("-risk issue"))
                     ).otherwise(F.lit("Warning"))
    return (F.when(truthy(custom_title), _c(custom_title))
            .when(F.coalesce(_c(warn), F.lit(False)), warning)
            .otherwise(F.lit("Tip")))


def tip_severity(warn, severity) -> Column:
    """Severity class of a warning tip, ``medium`` by default; null for plain tips."""
    return F.when(F.coalesce(_c(warn), F.lit(False)),
                  F.coalesce(F.nullif(_c(severity), F.lit("")), F.lit("medium")))


def status_from_action(path) -> Column:
    p = _c(path)
    return F.when(p.endswith("/submit"), F.lit("Submitted")).when(p.endswith("/savedraft"), F.lit("Draft"))


def answer_file_name(qid, app_name, app_champion, app_team_email, app_tid, app_pid) -> Column:
    """``<qid>_<name>_<champion>_<email>_<tid>_<pid>.txt`` with empty parts skipped."""
    parts = [F.nullif(_c(x), F.lit("")) for x in (qid, app_name, app_champion, app_team_email,
                                                  app_tid, app_pid)]
    return F.concat(F.concat_ws("_", *parts), F.lit(".txt"))


def answers_download_name(remote_qid, app_name, app_team_email, questionnaire_id) -> Column:
    """Download name of an answer file (trailing ``,…`` dropped, first ``/`` → ``_``)."""
    named = F.concat(_c(app_name), F.lit("_"), _c(app_team_email), F.lit(".json"))
    named = F.regexp_replace(named, r",[^/,]+$", "")
    named = F.regexp_replace(named, r"^([^/]*)/", "$1_")
    base = F.when(truthy(app_name) & truthy(app_team_email), named).otherwise(_c(questionnaire_id))
    return F.concat(F.lit("answers_"), F.coalesce(_c(remote_qid), F.lit("")), F.lit("_"), base)


def template_id_from_path(path) -> Column:
    """Base name without extension, first ``/`` replaced by ``_``."""
    base = F.regexp_extract(_c(path), r"([^/]+)$", 1)
    return F.regexp_replace(base, r"\.[^/.]+$", "")


def latest_file_target_name(token, app_name, app_champion, app_team_email) -> Column:
    """``<id>_<name>_<champion>_<email>.json``: quotes removed, separators → space."""
    name = F.regexp_replace(F.replace(F.coalesce(_c(app_name), F.lit("null")), F.lit('"'), F.lit("")), "/", " ")
    champ = F.regexp_replace(F.replace(F.coalesce(_c(app_champion), F.lit("null")), F.lit('"'), F.lit("")),
                             r"[;,/<>]", " ")
    mail = F.regexp_replace(F.replace(F.coalesce(_c(app_team_email), F.lit("null")), F.lit('"'), F.lit("")),
                            r"[;,/<>]", " ")
    return F.concat(F.concat_ws("_", _c(token), name, champ, mail), F.lit(".json"))


def project_summary(answers) -> Column:
    a = _c(answers)
    return F.format_string(PROJECT_SUMMARY_FORMAT,
                           F.coalesce(a["app_documentation"], F.lit("")),
                           F.coalesce(a["app_project_significant_change_detail"], F.lit("")),
                           F.coalesce(a["app_project_security_change_detail"], F.lit("")))


def contact_link(template: str, app_team_email, app_name) -> Column:
    """Mail link: placeholders replaced by the team address and application name."""
    out = F.replace(F.lit(template), F.lit("TEAM_DEVELOPER_EMAIL"), _c(app_team_email))
    return F.replace(out, F.lit("APPLICATION_NAME"), _c(app_name))


def tracker_filter_link(base: str, project_name) -> Column:
    return F.when(_c(project_name).isNotNull(),
                  F.concat(F.lit(base), F.lit("%22"), _c(project_name), F.lit("%22")))


# Characters that Spark's form encoding escapes though a URL component may hold them (fixed values), and its space.
_UNESCAPED = {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}


def url_component(col) -> Column:
    """Percent-encoded UTF-8 of all but letters, digits and ``- _ . ! ~ * ' ( )``."""
    out = F.url_encode(_c(col))
    for escaped, plain in _UNESCAPED.items():
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    return out


def request_content(pattern: str, *cols) -> Column:
    """``pattern`` with each ``%s`` replaced by an encoded value; a null value makes it null."""
    values = [url_component(_c(c).cast("string")) for c in cols]
    filled = F.format_string(pattern, *values)
    missing = [v.isNull() for v in values]
    return F.when(~functools.reduce(lambda a, b: a | b, missing, F.lit(False)), filled)


def deterministic_token(col, length: int = 12) -> Column:
    """Stable 12-character upper-case id derived from a value (replaces random ids)."""
    return F.upper(F.substring(F.sha2(_c(col).cast("string"), 256), 1, length))

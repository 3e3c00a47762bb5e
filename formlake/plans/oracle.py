"""DuckDB SQL oracles for the registered queries (same adapters, written independently).

The template-based oracles spell out the shipped vendor template's conditions by hand as
SQL expressions over pivoted answers.
"""

from __future__ import annotations

from formlake.plans.queries import AS_OF, GRID_FILTER, MAIL_HOST, MAIL_REVIEWERS, SAVED_CUTOFF
from formlake import schemas

SUBS = """
subs AS (
  SELECT 'Q' || lpad(CAST(o.o_orderkey AS VARCHAR), 11, '0') AS qid,
    CASE WHEN o.o_orderstatus = 'P' THEN 'In Review' WHEN o.o_orderstatus = 'F' THEN 'Approved'
         WHEN substr(o.o_orderpriority, 1, 1) IN ('1', '2') THEN 'Submitted' ELSE 'Draft' END AS app_status,
    n.n_name AS app_tid, o.o_orderpriority AS app_pid, c.c_name AS app_name, c.c_mktsegment AS app_champion,
    lower(c.c_mktsegment) || '@example.com' AS app_team_email,
    'user' || CAST(o.o_custkey AS VARCHAR) AS user_name, o.o_orderdate AS "timestamp",
    CAST(NULL AS VARCHAR) AS comments, '' AS action_items,
    'user' || CAST(o.o_custkey AS VARCHAR) || '@example.com' AS submitter_email
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey)
"""

LOG = """
log AS (
  SELECT 'U' || lpad(CAST(user_id AS VARCHAR), 11, '0') AS qid,
    CASE event_type WHEN 'signup' THEN 'Draft' WHEN 'view' THEN 'Submitted' WHEN 'click' THEN 'In Review'
                    WHEN 'purchase' THEN 'Approved' END AS app_status,
    'user' || CAST(user_id AS VARCHAR) AS user_name, ts AS "timestamp",
    'app' || CAST(user_id % 17 AS VARCHAR) AS app_name,
    '{"' || event_type || '": "' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS VARCHAR) || '"}' AS answer,
    event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'save' END AS op, ts AS event_ts
  FROM events),
lagged AS (
  SELECT *, lag(op) OVER w AS p_op, lag(app_status) OVER w AS p_status, lag(user_name) OVER w AS p_user,
         lag("timestamp") OVER w AS p_ts, lag(answer) OVER w AS p_answer,
         lead(event_ts) OVER w AS valid_to
  FROM log WINDOW w AS (PARTITION BY qid ORDER BY event_ts, seq)),
audit AS (
  SELECT seq * 2 AS audit_id, qid, p_status AS app_status, p_user AS user_name, p_ts AS "timestamp",
         p_answer AS answer, event_ts AS audit_timestamp
  FROM lagged WHERE p_op IS NOT NULL AND p_op <> 'delete'
  UNION ALL
  SELECT seq * 2 + 1, qid, 'DELETED', 'ADMIN', p_ts, CAST(NULL AS VARCHAR), event_ts
  FROM lagged WHERE p_op IS NOT NULL AND p_op <> 'delete' AND op = 'delete'),
cur AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY event_ts DESC, seq DESC) AS rn FROM log)
  WHERE rn = 1 AND op <> 'delete')
"""

TIERS = "('tier_shared'), ('tier_dedicated'), ('tier_onprem')"

CHANGES = f"""
ev AS (
  SELECT 'U' || lpad(CAST(user_id AS VARCHAR), 11, '0') AS qid, event_id AS seq, ts, event_type AS t,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events),
ch0 AS (
  SELECT qid, seq, ts,
    CASE WHEN t = 'signup' THEN 'has_policy' WHEN t = 'view' AND k % 4 < 2 THEN 'uses_cloud'
         WHEN t = 'view' THEN 'cert_iso'
         WHEN t = 'click' THEN CASE k % 3 WHEN 0 THEN 'tier_shared' WHEN 1 THEN 'tier_dedicated' ELSE 'tier_onprem' END
         WHEN t = 'purchase' THEN 'vendor_code' WHEN t = 'error' THEN 'incident_log' END AS key,
    CASE WHEN t = 'signup' THEN CASE k % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE '' END
         WHEN t = 'view' AND k % 4 < 2 THEN CASE WHEN k % 2 = 0 THEN 'checked' ELSE '' END
         WHEN t = 'view' THEN CASE WHEN k % 4 = 2 THEN 'checked' ELSE '' END
         WHEN t = 'click' THEN 'checked'
         WHEN t = 'purchase' THEN CASE WHEN k % 5 = 0 THEN 'x' || CAST(k AS VARCHAR) ELSE 'VC' || CAST(k * k AS VARCHAR) END
         WHEN t = 'error' THEN CASE k % 4 WHEN 0 THEN 'Sev 1 outage, see OPS-' || CAST(k AS VARCHAR)
                                          WHEN 1 THEN 'minor glitch' WHEN 2 THEN ''
                                          ELSE 'tracked as INC-' || CAST(k AS VARCHAR) END END AS value
  FROM ev),
ch AS (
  SELECT qid, seq, ts, key, value FROM ch0 WHERE key NOT IN ('tier_shared', 'tier_dedicated', 'tier_onprem')
  UNION ALL
  SELECT c.qid, c.seq, c.ts, r.tier, CASE WHEN r.tier = c.key THEN c.value ELSE '' END
  FROM ch0 c CROSS JOIN (VALUES {TIERS}) r(tier)
  WHERE c.key IN ('tier_shared', 'tier_dedicated', 'tier_onprem')),
lv AS (
  SELECT qid, key, value, ts, seq FROM (
    SELECT *, row_number() OVER (PARTITION BY qid, key ORDER BY ts DESC, seq DESC) AS rn FROM ch) WHERE rn = 1),
a AS (
  SELECT qid,
    coalesce(max(value) FILTER (WHERE key = 'vendor_code'), '') AS vc,
    CASE WHEN max(value) FILTER (WHERE key = 'has_policy') IN ('yes', 'no')
         THEN max(value) FILTER (WHERE key = 'has_policy') ELSE '' END AS hp,
    coalesce(max(value) FILTER (WHERE key = 'uses_cloud'), '') = 'checked' AS uc,
    coalesce(max(value) FILTER (WHERE key = 'cert_iso'), '') = 'checked' AS iso,
    coalesce(max(value) FILTER (WHERE key = 'tier_shared'), '') = 'checked' AS sh,
    coalesce(max(value) FILTER (WHERE key = 'tier_dedicated'), '') = 'checked' AS de,
    coalesce(max(value) FILTER (WHERE key = 'incident_log'), '') AS il
  FROM lv GROUP BY qid)
"""

# The shipped vendor template, item by item: (item_id, ordinal, shown, visible) as SQL over ``a``.
SEV = "regexp_matches(il, 'sev[ -]?1', 'i')"
TRACKED = "(contains(il, '-') AND NOT (hp = 'yes'))"
VENDOR_ITEMS = [
    ("_anon_0", 0, "TRUE", "TRUE"), ("profile", 1, "TRUE", "TRUE"), ("_anon_0_0_0", 2, "TRUE", "TRUE"),
    ("vendor_code", 3, "TRUE", "TRUE"), ("has_policy", 4, "TRUE", "TRUE"),
    ("tip_policy", 5, "hp = 'no'", "hp = 'no'"), ("uses_cloud", 6, "TRUE", "TRUE"),
    ("cloud", 7, "uc", "uc"), ("cloud_tier", 8, "TRUE", "uc"), ("tier_shared", 9, "TRUE", "uc"),
    ("tier_dedicated", 10, "TRUE", "uc"), ("tier_onprem", 11, "TRUE", "uc"),
    ("tip_shared", 12, "sh", "uc AND sh"), ("isolation_notes", 13, "(sh OR de)", "uc AND (sh OR de)"),
    ("incidents", 14, "TRUE", "TRUE"), ("incident_log", 15, "TRUE", "TRUE"),
    ("tip_sev1", 16, SEV, SEV), ("tip_tracked", 17, TRACKED, TRACKED),
    ("ir_team", 18, "TRUE", "TRUE"), ("ir_none", 19, "TRUE", "TRUE"),
    ("tip_ir", 20, "(uc AND hp = 'no')", "(uc AND hp = 'no')"),
    ("reviewer", 21, "FALSE", "FALSE"), ("reviewer_comment", 22, "TRUE", "FALSE"),
    ("_anon_0_4", 23, "TRUE", "TRUE"), ("certs", 24, "TRUE", "TRUE"), ("cert_iso", 25, "TRUE", "TRUE"),
    ("cert_soc", 26, "uc", "uc"), ("certs_none", 27, "TRUE", "TRUE"),
    ("evidence", 28, "iso", "iso"), ("tip_nocert", 29, "NOT iso", "NOT iso"),
]
TIPS = {  # item_id: (warn, severity, todo)
    "tip_policy": (True, "high", "Write and publish a security policy."),
    "tip_shared": (True, "medium", "Describe how tenants are isolated."),
    "tip_sev1": (True, "critical", "Attach the post-mortem."),
    "tip_tracked": (False, None, None),
    "tip_ir": (True, "medium", "Name an incident contact."),
    "tip_nocert": (True, "medium", None),
}


def _q(s):
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def _with(*parts: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts) + "\n"


def _visibility_union(src: str = "a", extra: str = "") -> str:
    sel = [f"SELECT qid, {extra}'{i}' AS item_id, CAST({o} AS INTEGER) AS ordinal, ({s}) AS shown, ({v}) AS visible "
           f"FROM {src}" for i, o, s, v in VENDOR_ITEMS]
    return "\nUNION ALL\n".join(sel)


VALUE_ITEM_TYPES = [("vendor_code", "line"), ("has_policy", "yesno"), ("tip_policy", "tip"), ("uses_cloud", "check"),
                    ("tier_shared", "radio"), ("tier_dedicated", "radio"), ("tier_onprem", "radio"),
                    ("tip_shared", "tip"), ("isolation_notes", "box"), ("incident_log", "box"), ("tip_sev1", "tip"),
                    ("tip_tracked", "tip"), ("ir_team", "radio"), ("ir_none", "radio"), ("tip_ir", "tip"),
                    ("reviewer_comment", "box"), ("cert_iso", "check"), ("cert_soc", "check"),
                    ("certs_none", "check"), ("evidence", "upload"), ("tip_nocert", "tip")]
ALL_IDS = ", ".join(f"('{i}')" for i, *_ in VENDOR_ITEMS)

VERSIONS = """
pe AS (SELECT qid, ts, seq,
    max(CASE WHEN key = 'vendor_code' THEN value END) AS k_vc, max(CASE WHEN key = 'has_policy' THEN value END) AS k_hp,
    max(CASE WHEN key = 'uses_cloud' THEN value END) AS k_uc, max(CASE WHEN key = 'cert_iso' THEN value END) AS k_iso,
    max(CASE WHEN key = 'tier_shared' THEN value END) AS k_sh, max(CASE WHEN key = 'tier_dedicated' THEN value END) AS k_de,
    max(CASE WHEN key = 'incident_log' THEN value END) AS k_il
  FROM ch GROUP BY qid, ts, seq),
run AS (SELECT qid, ts, seq, last_value(k_vc IGNORE NULLS) OVER w AS r_vc, last_value(k_hp IGNORE NULLS) OVER w AS r_hp,
    last_value(k_uc IGNORE NULLS) OVER w AS r_uc, last_value(k_iso IGNORE NULLS) OVER w AS r_iso,
    last_value(k_sh IGNORE NULLS) OVER w AS r_sh, last_value(k_de IGNORE NULLS) OVER w AS r_de,
    last_value(k_il IGNORE NULLS) OVER w AS r_il
  FROM pe WINDOW w AS (PARTITION BY qid ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
av AS (SELECT qid, ts, seq, coalesce(r_vc, '') AS vc, CASE WHEN r_hp IN ('yes', 'no') THEN r_hp ELSE '' END AS hp,
    coalesce(r_uc, '') = 'checked' AS uc, coalesce(r_iso, '') = 'checked' AS iso,
    coalesce(r_sh, '') = 'checked' AS sh, coalesce(r_de, '') = 'checked' AS de, coalesce(r_il, '') AS il FROM run)
"""


def _answer_oracles() -> dict[str, str]:
    types = ", ".join(f"('{i}', '{t}')" for i, t in VALUE_ITEM_TYPES)
    diff_rows = """SELECT lv.qid, lv.key, lv.value AS current_value, sv.value AS saved_value
            FROM lv LEFT JOIN sv ON lv.qid = sv.qid AND lv.key = sv.key
            WHERE NOT starts_with(lv.key, 'q_version') AND lv.value IS DISTINCT FROM sv.value"""
    sv = f"""sv AS (SELECT qid, key, value FROM (SELECT *, row_number() OVER
              (PARTITION BY qid, key ORDER BY ts DESC, seq DESC) AS rn FROM ch WHERE ts < TIMESTAMP '{SAVED_CUTOFF}')
              WHERE rn = 1)"""
    return {
        "answer_items": _with(CHANGES, f"it(key, type) AS (VALUES {types})")
        + "SELECT lv.qid, lv.key, it.type, lv.value FROM lv JOIN it ON lv.key = it.key",
        "unknown_answers": _with(LOG, f"ids(item_id) AS (VALUES {ALL_IDS})") + """SELECT l.qid, l.seq,
              e.event_type AS key, CAST(CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS VARCHAR) AS value
            FROM log l JOIN events e ON l.seq = e.event_id
            WHERE e.event_type NOT IN (SELECT item_id FROM ids)""",
        "diff_toc": _with(CHANGES, sv, f"vis AS ({_visibility_union()})", f"d AS ({diff_rows})")
        + "SELECT d.* FROM d JOIN vis ON d.qid = vis.qid AND d.key = vis.item_id WHERE vis.visible",
        "visibility_transitions": _with(CHANGES, VERSIONS, f"vis AS ({_visibility_union('av', 'ts, seq, ')})",
                                        """lagged AS (SELECT qid, seq, item_id, visible,
              lag(visible) OVER (PARTITION BY qid, item_id ORDER BY ts, seq) AS was FROM vis)""")
        + """SELECT qid, seq, item_id, CASE WHEN visible THEN 'SHOWN' ELSE 'HIDDEN' END AS event
            FROM lagged WHERE was IS NOT NULL AND visible <> was""",
    }


def _vis_of(item):
    for i, o, s, v in VENDOR_ITEMS:
        if i == item:
            return v, o
    raise KeyError(item)


def _tips() -> str:
    sel = []
    for tid, (warn, sev, _) in TIPS.items():
        v, _o = _vis_of(tid)
        sel.append(f"SELECT qid, '{tid}' AS item_id, {str(warn).upper()} AS warn, CAST({_q(sev)} AS VARCHAR) AS severity, "
                   f"CAST(NULL AS VARCHAR) AS name FROM a WHERE {v}")
    return "\nUNION ALL\n".join(sel)


def _todos() -> str:
    sel = []
    for tid, (_w, _s, todo) in TIPS.items():
        if not todo:
            continue
        v, o = _vis_of(tid)
        sel.append(f"SELECT qid, '{schemas.TODO_KEY_PREFIX}{tid}' AS todo_key, CAST({o} AS INTEGER) AS ordinal, {_q(todo)} AS description, "
                   f"CAST(NULL AS VARCHAR) AS todo_status FROM a WHERE {v}")
    return "\nUNION ALL\n".join(sel)


UNANSWERED = """
SELECT qid, block_id, CAST(n AS INTEGER) AS unanswered FROM (
  SELECT qid,
    CAST(vc = '' AS INTEGER) + CAST(hp = '' AS INTEGER) AS p,
    CAST(uc AND (sh OR de) AS INTEGER) AS c,
    CAST(il = '' AS INTEGER) + 1 AS i,
    0 AS r,
    CAST(iso AS INTEGER) AS e
  FROM a) x
CROSS JOIN LATERAL (VALUES ('_anon_0', p + c + i + r + e), ('profile', p), ('cloud', c), ('incidents', i),
                           ('reviewer', r)) t(block_id, n)
"""

FIELD_ISSUES = """
SELECT qid, 'vendor_code' AS item_id, 'required_missing' AS rule FROM a WHERE vc = ''
UNION ALL SELECT qid, 'vendor_code', 'pattern_violation' FROM a WHERE vc <> '' AND NOT regexp_full_match(vc, '[A-Z]{2}[0-9]+')
UNION ALL SELECT qid, 'vendor_code', 'maxlength_violation' FROM a WHERE length(vc) > 5
UNION ALL SELECT qid, 'incident_log', 'required_missing' FROM a WHERE il = ''
"""

TRANSITIONS_SQL = """
allowed(from_status, to_status) AS (VALUES (CAST(NULL AS VARCHAR), 'Draft'), (NULL, 'Submitted'),
  ('Draft', 'Draft'), ('Draft', 'Submitted'), ('Submitted', 'Submitted'), ('Submitted', 'In Review'),
  ('In Review', 'Submitted'), ('In Review', 'Approved'), ('Approved', 'In Review'))
"""

GRID = """SELECT qid AS Col0_qid, app_status AS Col1_app_status, app_name AS Col2_app_name,
  app_champion AS Col3_app_champion, app_team_email AS Col4_app_team_email, app_tid AS Col5_app_tid,
  app_pid AS Col6_app_pid, user_name AS Col7_last_modified_by, "timestamp" AS Col8_last_modified,
  submitter_email AS Col9_submitter_email, action_items AS ColA_action_items FROM subs"""


def _grid_filter() -> str:
    cols = ["Col0_qid", "Col1_app_status", "Col2_app_name", "Col3_app_champion", "Col4_app_team_email",
            "Col5_app_tid", "Col6_app_pid", "Col7_last_modified_by", "Col9_submitter_email", "ColA_action_items"]
    f = GRID_FILTER.upper()
    cond = " OR ".join(f"coalesce(contains(upper(CAST({c} AS VARCHAR)), '{f}'), FALSE)" for c in cols)
    return _with(SUBS, f"g AS ({GRID})") + f"SELECT * FROM g WHERE {cond}"


def oracle_sql() -> dict[str, str]:
    like = "'%Customer#00000012_%'"
    search_cond = " OR ".join(f"{c} ILIKE {like}" for c in ["app_tid", "app_name", "app_champion", "qid", "app_pid"])
    q = {
        "wildcard_search": _with(SUBS) + f"""SELECT qid, app_status, app_tid, app_pid, app_name, app_champion,
            app_team_email, user_name AS modified_by, "timestamp" AS last_modified, comments, action_items,
            submitter_email FROM subs WHERE {search_cond}""",
        "status_grid": _with(SUBS, f"g AS ({GRID})") + """SELECT * FROM g
            WHERE Col1_app_status IN ('', 'In Review', 'Submitted', 'Draft')
            ORDER BY Col2_app_name ASC, Col8_last_modified DESC""",
        "grid_text_filter": _grid_filter(),
        "upsert_current": _with(LOG) + 'SELECT qid, app_status, user_name, "timestamp", answer, seq FROM cur',
        "audit_log": _with(LOG) + 'SELECT audit_id, qid, app_status, user_name, "timestamp", answer, audit_timestamp FROM audit',
        "revisions": _with(LOG) + """SELECT qid AS owner_qid, qid || '-' || CAST(audit_id AS VARCHAR) AS revision_id,
            app_status, user_name, "timestamp" FROM audit
            UNION ALL SELECT qid, qid, app_status, user_name, "timestamp" FROM cur""",
        "latest_saved": _with(LOG, """na AS (SELECT qid, answer, audit_id FROM (SELECT *, row_number() OVER
            (PARTITION BY qid ORDER BY audit_timestamp DESC, audit_id DESC) AS rn FROM audit) WHERE rn = 1)""")
        + """SELECT coalesce(na.qid, cur.qid) AS qid,
            CASE WHEN na.qid IS NOT NULL THEN na.answer ELSE cur.answer END AS answer,
            CASE WHEN na.qid IS NOT NULL THEN 'audit' ELSE 'current' END AS source, na.audit_id
            FROM na FULL OUTER JOIN cur ON na.qid = cur.qid""",
        "revision_as_of": _with(LOG) + f"""SELECT qid, seq, app_status, event_ts AS valid_from, valid_to FROM lagged
            WHERE op <> 'delete' AND event_ts <= TIMESTAMP '{AS_OF}'
              AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AS_OF}')""",
        "status_durations": _with(LOG) + """SELECT qid, app_status,
            CAST(sum(epoch_us(valid_to) - epoch_us(event_ts)) AS BIGINT) AS duration_us, count(*) AS n_versions
            FROM lagged WHERE op <> 'delete' AND valid_to IS NOT NULL GROUP BY qid, app_status""",
        "transition_violations": _with(LOG, TRANSITIONS_SQL, """t AS (SELECT qid, seq,
              CASE WHEN p_op IS NOT NULL AND p_op <> 'delete' THEN p_status END AS from_status,
              app_status AS to_status FROM lagged WHERE op <> 'delete')""")
        + """SELECT qid, seq, from_status, to_status, 'transition not allowed' AS reason FROM t
            WHERE NOT EXISTS (SELECT 1 FROM allowed al WHERE al.from_status IS NOT DISTINCT FROM t.from_status
                                                        AND al.to_status = t.to_status)""",
        "merge_answers": _with(CHANGES) + "SELECT qid, key, value FROM lv",
        "answer_diff": _with(CHANGES, f"""sv AS (SELECT qid, key, value FROM (SELECT *, row_number() OVER
              (PARTITION BY qid, key ORDER BY ts DESC, seq DESC) AS rn FROM ch WHERE ts < TIMESTAMP '{SAVED_CUTOFF}')
              WHERE rn = 1)""")
        + """SELECT lv.qid, lv.key, lv.value AS current_value, sv.value AS saved_value
            FROM lv LEFT JOIN sv ON lv.qid = sv.qid AND lv.key = sv.key
            WHERE NOT starts_with(lv.key, 'q_version') AND lv.value IS DISTINCT FROM sv.value""",
        "revision_diff": _with(CHANGES, """r AS (SELECT qid, key, seq, value,
              lag(value) OVER w AS old_value, row_number() OVER w AS n
              FROM ch WINDOW w AS (PARTITION BY qid, key ORDER BY ts, seq))""")
        + """SELECT qid, key, seq, old_value, value AS new_value,
              CASE WHEN n = 1 THEN 'added' ELSE 'changed' END AS change
            FROM r WHERE n = 1 OR value IS DISTINCT FROM old_value""",
        "conversation_revision_diff": """WITH c AS (SELECT 'C' || lpad(CAST(conv_id AS VARCHAR), 11, '0') AS qid,
              role AS key, turn AS seq, text AS value FROM conversations),
            r AS (SELECT qid, key, seq, value, lag(value) OVER w AS old_value, row_number() OVER w AS n
              FROM c WINDOW w AS (PARTITION BY qid, key ORDER BY seq))
            SELECT qid, key, seq, md5(coalesce(old_value, '')) AS old_md5, md5(value) AS new_md5,
              CASE WHEN n = 1 THEN 'added' ELSE 'changed' END AS change
            FROM r WHERE n = 1 OR value IS DISTINCT FROM old_value""",
        "item_visibility": _with(CHANGES) + _visibility_union(),
        "active_tips": _with(CHANGES) + _tips(),
        "todo_list": _with(CHANGES) + _todos(),
        "unanswered_count": _with(CHANGES) + UNANSWERED,
        "field_issues": _with(CHANGES) + FIELD_ISSUES,
        "risk_rollup": _with(CHANGES, LOG, f"tips AS ({_tips()})")
        + """SELECT t.severity, coalesce(cur.app_status, 'Deleted') AS app_status, count(*) AS n_warnings,
              count(DISTINCT t.qid) AS n_submissions
            FROM tips t LEFT JOIN cur ON t.qid = cur.qid WHERE t.warn
            GROUP BY t.severity, coalesce(cur.app_status, 'Deleted')""",
        "action_items_docs": r"""SELECT doc_id, CASE WHEN len(m) > 0 THEN array_to_string(m, ',') END AS action_items
            FROM (SELECT doc_id, list_concat(
                    regexp_extract_all(upper(lang) || '-' || CAST(doc_id AS VARCHAR), '[A-Z]{2,}-\d+'),
                    regexp_extract_all(coalesce(text, ''), '[A-Z]{2,}-\d+')) AS m FROM documents)""",
        "sanitize_docs": """SELECT doc_id, CAST(length(s) AS INTEGER) AS sanitized_len, md5(s) AS sanitized_md5 FROM (
            SELECT doc_id, replace(replace(replace(replace(text, '''', ''), ';', ''), '--', ''), '|', '') AS s
            FROM documents)""",
    }
    q.update(_request_oracles())
    q.update(_template_oracles())
    q.update(_review_oracles())
    q.update(_command_oracles())
    q.update(_answer_oracles())
    cols = ["app_tid", "app_name", "app_champion", "qid", "app_pid"]
    hit = " OR ".join(f"s.{c} ILIKE '%' || t.term || '%'" for c in cols)
    q["search_batch"] = _with(SUBS, "terms AS (SELECT n_nationkey AS term_id, n_name AS term FROM nation)") + f"""
        SELECT t.term_id, 'search' AS kind, s.qid, s.app_status, s.app_name, CAST(NULL AS BIGINT) AS audit_id,
          CAST(NULL AS VARCHAR) AS error FROM terms t JOIN subs s ON ({hit})"""
    q["search_terms"] = _with(SUBS, """kinds AS (SELECT n_nationkey AS k, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9]) AS i,
          unnest([lower(n_name), substr(n_name, 1, 2) || '_' || substr(n_name, 4), substr(n_name, 1, 2) || '%' || right(n_name, 2), substr(n_name, 1, 2),
                  lower(substr(n_name, 2, 2)), repeat('_', n_nationkey + 16), n_name || '-x-1', 'no word-' || length(n_name), '#0000' || n_nationkey || '%',
                  'back' || chr(92) || n_name]) AS term FROM nation),
        terms AS (SELECT 100 * i + k AS term_id, i, replace(term, chr(92), chr(92) || chr(92)) AS term FROM kinds)""") + """
        SELECT term_id, 'search' AS kind, qid, app_status, app_name, CAST(NULL AS VARCHAR) AS error FROM terms JOIN subs
          ON app_tid ILIKE '%' || term || '%' ESCAPE chr(92) OR app_name ILIKE '%' || term || '%' ESCAPE chr(92) OR app_champion ILIKE '%' || term || '%' ESCAPE chr(92)
          OR qid ILIKE '%' || term || '%' ESCAPE chr(92) OR app_pid ILIKE '%' || term || '%' ESCAPE chr(92)
        WHERE i NOT IN (6, 7)
        UNION ALL SELECT term_id, 'rejected', NULL, NULL, NULL, 'invalid search term' FROM terms WHERE i IN (6, 7)"""
    q["search_customers"] = _with(SUBS) + """SELECT c_custkey AS term_id, qid, app_name FROM subs JOIN customer ON app_name = c_name"""
    q["search_first_hits"] = _with(SUBS) + """SELECT term_id, qid, app_status, "timestamp" FROM (SELECT c_custkey AS term_id, subs.*,
              row_number() OVER (PARTITION BY c_custkey ORDER BY "timestamp" DESC NULLS LAST, qid) AS rn FROM subs JOIN customer ON app_name = c_name) WHERE rn = 1"""
    q["revisions_newest_first"] = _with(LOG, """rev AS (SELECT qid AS owner_qid, qid || '-' || CAST(audit_id AS VARCHAR) AS revision_id, app_status, "timestamp" FROM audit
              UNION ALL SELECT qid, qid, app_status, "timestamp" FROM cur)""") + """SELECT owner_qid, revision_id, app_status,
              row_number() OVER (PARTITION BY owner_qid ORDER BY "timestamp" DESC NULLS LAST, revision_id) AS position FROM rev"""
    q["encoded_docs"] = """WITH e AS (SELECT doc_id, 'doc=' || doc_id || '&text=' || replace(replace(replace(replace(replace(
              url_encode(text), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*') AS c FROM documents)
            SELECT doc_id, length(c) AS n_chars, md5(c) AS content_md5 FROM e"""
    q["review_mails"] = _with(LOG) + f"""SELECT qid, seq, app_status,
              'QID: ' || qid || ' : Security Architecture Review for project: ' || app_name AS subject,
              CASE app_status
                WHEN 'Draft' THEN 'Your answers to questionnaire ' || link || ' are saved as a draft. '
                WHEN 'Submitted' THEN 'Questionnaire ' || link || ' waits for a review.<br /><b>Project overview:</b><br /><br /> <br /><br />'
                  || '<b>Significant changes:</b><br /><br /> <br /><br /><b>Security landscape changes:</b><br /><br /><br />Regards, ' || user_name
                WHEN 'In Review' THEN 'Questionnaire ' || link || ' is being reviewed. '
                WHEN 'Approved' THEN 'Questionnaire ' || link || ' is approved. ' END AS body,
              ['{MAIL_REVIEWERS[0]}', user_name] AS recipients
            FROM (SELECT *, '<a href="{MAIL_HOST}' || qid || '">' || qid || '</a>' AS link FROM log)
            WHERE op <> 'delete' AND app_status IN ('Draft', 'Submitted', 'In Review', 'Approved')"""
    q["risk_levels"] = "WITH RECURSIVE " + ",".join(p.strip() for p in (CHANGES, LOG, SUBS, REVIEWS, f"tips AS ({_tips()})")) + """, w AS (
              SELECT qid, 'vendor_review' AS template_id, severity FROM tips WHERE warn
              UNION ALL SELECT qid, tid, 'medium' FROM rt WHERE c AND tip),
            st AS (SELECT qid, app_status FROM cur UNION ALL SELECT qid, app_status FROM subs),
            j AS (SELECT w.qid, template_id, coalesce(severity, '') AS severity, coalesce(app_status, 'Deleted') AS app_status FROM w LEFT JOIN st ON w.qid = st.qid)
            SELECT template_id, severity, app_status, CAST(4 * grouping(template_id) + 2 * grouping(severity) + grouping(app_status) AS INTEGER) AS level,
              count(*) AS n_warnings, count(DISTINCT qid) AS n_submissions FROM j GROUP BY CUBE (template_id, severity, app_status)"""
    q["error_digest_by_source"] = """WITH l AS (SELECT ts, CASE WHEN event_type = 'error' THEN 'ERROR'
                WHEN event_type = 'purchase' THEN 'CRITICAL' ELSE 'INFO' END AS level,
              event_type || ' by user ' || CAST(user_id AS VARCHAR) AS message, event_id AS seq,
              'host' || CAST(user_id % 4 AS VARCHAR) AS source FROM events),
            b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts, seq) - 1 AS rnk
                  FROM l WHERE level IN ('ERROR', 'CRITICAL'))
            SELECT source, CAST(rnk // 10 AS BIGINT) AS digest_id, min(seq) AS first_seq, max(seq) AS last_seq,
              count(*) AS n_records, count(*) FILTER (WHERE level = 'ERROR') AS n_errors,
              coalesce(string_agg(CASE WHEN level = 'ERROR' THEN message END, chr(13) || chr(10) ORDER BY rnk), '') AS body
            FROM b GROUP BY source, rnk // 10 HAVING count(*) = 10"""
    q["error_digest_stream"] = q["error_digest_by_source"]
    q["revision_lookup"] =_with(LOG) + """SELECT audit_id AS term_id, 'revision' AS kind, qid, 'Revision' AS app_status,
          app_name, audit_id, CAST(NULL AS VARCHAR) AS error
        FROM (SELECT a.*, l.app_name FROM audit a JOIN (SELECT DISTINCT qid, app_name FROM log) l ON a.qid = l.qid)"""
    q["template_siblings"] =_with(LINES) + """SELECT tid AS template_id, item_id, parent_id,
          lag(item_id) OVER w AS previous_id, lead(item_id) OVER w AS next_id
        FROM items WINDOW w AS (PARTITION BY tid, parent_id ORDER BY ordinal)"""
    q["status_changes"] = _with(LOG, """cmd AS (SELECT 'U' || lpad(CAST(user_id AS VARCHAR), 11, '0') AS qid,
          CASE WHEN event_type = 'purchase' THEN 'a' ELSE 'r' END AS flag,
          'reviewer' || CAST(user_id % 3 AS VARCHAR) AS usr, ts FROM events WHERE event_type IN ('click', 'purchase'))""") + """
        SELECT c.qid,
          CASE WHEN cur.qid IS NOT NULL THEN CASE WHEN c.flag = 'a' THEN 'Approved' ELSE 'In Review' END END AS app_status,
          CASE WHEN cur.qid IS NOT NULL THEN c.usr END AS user_name,
          CASE WHEN cur.qid IS NOT NULL THEN c.ts END AS "timestamp",
          CASE WHEN cur.qid IS NULL THEN 500 END AS error
        FROM cmd c LEFT JOIN cur ON c.qid = cur.qid"""
    q["modified_submissions"] = _with(CHANGES, f"""sv AS (SELECT qid, key, value FROM (SELECT *, row_number() OVER
              (PARTITION BY qid, key ORDER BY ts DESC, seq DESC) AS rn FROM ch WHERE ts < TIMESTAMP '{SAVED_CUTOFF}')
              WHERE rn = 1)""") + """SELECT lv.qid, count(*) AS n_changed
            FROM lv LEFT JOIN sv ON lv.qid = sv.qid AND lv.key = sv.key
            WHERE NOT starts_with(lv.key, 'q_version') AND lv.value IS DISTINCT FROM sv.value GROUP BY lv.qid"""
    q["pending_changes"] = _with(LOG, CHANGES, f"""sv AS (SELECT qid, max(event_ts) AS saved_ts FROM log
              WHERE op = 'save' AND event_ts < TIMESTAMP '{SAVED_CUTOFF}' GROUP BY qid)""") + """
        SELECT c.qid, count(DISTINCT c.key) AS pending FROM ch0 c LEFT JOIN sv ON c.qid = sv.qid
        WHERE sv.saved_ts IS NULL OR c.ts > sv.saved_ts GROUP BY c.qid"""
    q["submission_rows"] = _with(CHANGES) + r"""SELECT qid, CAST(NULL AS VARCHAR) AS app_status, '' AS app_tid,
          '' AS app_pid, CAST(NULL AS VARCHAR) AS user_name,
          coalesce(nullif(array_to_string(regexp_extract_all(il, '[A-Z]{2,}-\d+'), ','), ''), '') AS action_items
        FROM a"""
    headings = {"tip_policy": "Warning — possible high-risk issue", "tip_shared": "Warning",
                "tip_sev1": "Warning — possible critical-risk issue", "tip_tracked": "Tip",
                "tip_ir": "Warning — possible medium-risk issue", "tip_nocert": "Certification missing"}
    sel = []
    for tid, heading in headings.items():
        v, _o = _vis_of(tid)
        sel.append(f"SELECT qid, '{tid}' AS item_id, '{heading}' AS heading FROM a WHERE {v}")
    q["tip_headings"] = _with(CHANGES) + "\nUNION ALL\n".join(sel)
    q["audit_append_only"] ="""SELECT CAST(NULL AS BIGINT) AS audit_id, CAST(NULL AS VARCHAR) AS qid,
          CAST(NULL AS VARCHAR) AS app_status, CAST(NULL AS TIMESTAMP) AS audit_timestamp WHERE FALSE"""
    q["export_roundtrip"] ="""SELECT CAST(NULL AS VARCHAR) AS template_id, CAST(NULL AS VARCHAR) AS item_id,
            CAST(NULL AS VARCHAR) AS change, CAST(NULL AS VARCHAR) AS fields WHERE FALSE"""
    # Streaming twins must give the batch result.
    for stream, batch in [("answers_stream", "merge_answers"), ("autosave_stream", "autosave_batches"),
                          ("audit_stream", "audit_log"), ("sessions_stream", "user_sessions"),
                          ("oversized_stream", "oversized_requests"), ("notices_stream", "review_notices")]:
        q[stream] = q[batch]
    q["rate_limit_stream"] = _with(REQ) + """SELECT gateway, date_trunc('day', ts) AS window_start,
            count(*) AS n_requests, count(*) - 200 AS rejected FROM r
            GROUP BY gateway, date_trunc('day', ts) HAVING count(*) > 200"""
    return q


TOKEN_RE = r'"(?:\\.|[^"\\])*"|&&|\|\||[!(),]|[^ ()!&|,"]+'

LINES = """
li AS (
  SELECT 'T' || lpad(CAST(l_orderkey AS VARCHAR), 11, '0') AS tid, l_orderkey AS ok, l_partkey AS pk,
    l_suppkey AS sk, CAST(row_number() OVER w AS INTEGER) AS ln,
    CASE WHEN l_quantity > 48 THEN 'dropdown' WHEN l_returnflag = 'R' THEN 'yesno'
         WHEN l_returnflag = 'A' THEN 'check' ELSE 'line' END AS qtype,
    l_linestatus = 'O' AS open_line,
    CASE WHEN row_number() OVER w = 1 THEN NULL
         WHEN l_discount >= 0.08 THEN 'q_' || l_partkey || '/yes && !(q_' || l_suppkey || ')'
         WHEN l_tax >= 0.06 THEN 'matches(q_' || l_partkey || '/value, "^[0-9]+$")'
         WHEN l_quantity < 3 THEN 'q_' || l_partkey || ' & q_' || l_suppkey
         WHEN l_quantity < 5 THEN '(q_' || l_partkey || ' q_' || l_suppkey || ')'
         ELSE 'q_' || l_partkey || ' || ^o' || l_orderkey || '_l1' END AS cond,
    CAST(row_number() OVER w AS INTEGER) AS r
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
                                                        l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)),
items AS (
  SELECT DISTINCT tid, 'o' || ok AS item_id, 0 AS ordinal, 0 AS depth, CAST(NULL AS VARCHAR) AS parent_id,
    'block' AS type, CAST(NULL AS VARCHAR) AS cond FROM li
  UNION ALL SELECT tid, 'o' || ok || '_l' || ln, 2 * r - 1, 1, 'o' || ok, 'block', cond FROM li
  UNION ALL SELECT tid, 'q_' || pk, 2 * r, 2, 'o' || ok || '_l' || ln, qtype, NULL FROM li)
"""

TOKENS = f"""
tk AS (
  SELECT tid, item_id, CAST(unnest(range(len(toks))) AS INTEGER) AS pos, unnest(toks) AS token
  FROM (SELECT tid, item_id, regexp_extract_all(cond, '{TOKEN_RE}') AS toks FROM items
        WHERE cond IS NOT NULL AND trim(cond) <> '')),
tokens AS (
  SELECT tid, item_id, pos, token,
    CASE WHEN token IN ('&&', '||', ',') THEN 'binop' WHEN token = '!' THEN 'not' WHEN token = '(' THEN 'open'
         WHEN token = ')' THEN 'close' WHEN starts_with(token, '"') THEN 'string'
         WHEN token IN ('matches', 'contains') THEN 'func' ELSE 'name' END AS kind
  FROM tk)
"""

EXT = """
ext AS (
  SELECT 'T' || lpad(CAST(o.o_orderkey AS VARCHAR), 11, '0') AS tid, o.o_orderkey AS ok,
    o.o_orderkey % 7 = 0 AS bad_version, o.o_orderkey % 2 = 1 AS after,
    CASE WHEN o.o_orderkey % 11 = 0 THEN 9 WHEN o.o_orderkey % 2 = 1 THEN 1 ELSE m.last END AS target_line
  FROM orders o JOIN (SELECT l_orderkey, count(*) AS last FROM lineitem GROUP BY l_orderkey) m
    ON o.o_orderkey = m.l_orderkey),
tgt AS (SELECT e.*, li.r AS t FROM ext e LEFT JOIN li ON li.ok = e.ok AND li.ln = e.target_line),
errs AS (
  SELECT tid, 0 AS apply_order, 'extension version does not match the base template' AS error FROM tgt WHERE bad_version
  UNION ALL
  SELECT tid, 0, 'Target item id "o' || ok || '_l' || target_line || '" was not found' FROM tgt WHERE t IS NULL)
"""


REVIEWS = """
rl AS (
  SELECT l_orderkey AS ok, 'Q' || lpad(CAST(l_orderkey AS VARCHAR), 11, '0') AS qid, 'T' || lpad(CAST(l_orderkey AS VARCHAR), 11, '0') AS tid,
    CAST(row_number() OVER w AS INTEGER) AS n, CAST(count(*) OVER (PARTITION BY l_orderkey) AS INTEGER) AS m,
    l_tax AS tax, l_discount AS disc, l_quantity AS qty,
    CASE l_returnflag WHEN 'R' THEN 'yesno' WHEN 'A' THEN 'check' ELSE 'line' END AS t,
    CASE l_returnflag WHEN 'R' THEN CASE CAST(l_quantity AS BIGINT) % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE '' END
         WHEN 'A' THEN CASE WHEN CAST(l_quantity AS BIGINT) % 2 = 0 THEN 'checked' ELSE '' END
         ELSE CASE WHEN l_linestatus = 'O' THEN CAST(l_partkey AS VARCHAR) ELSE '' END END AS v
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
                                                        l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)),
rc AS (
  SELECT *, TRUE AS c FROM rl WHERE n = 1
  UNION ALL
  SELECT x.*, CASE WHEN x.tax >= 0.06 THEN regexp_matches(p.v, '^[0-9]{4}') OR p.c
                   WHEN x.disc >= 0.05 THEN (p.c AND p.t = 'check' AND p.v = 'checked') AND NOT (p.c AND f.v <> '')
                   WHEN x.qty < 10 THEN (NOT (p.c AND p.t = 'check' AND p.v = 'checked') OR contains(f.v, '7')) AND p.c
                   ELSE (p.c AND (p.v = 'checked' AND p.t = 'check' OR p.v = 'yes' AND p.t = 'yesno')) OR p.v <> '' END
  FROM rc p JOIN rl x ON x.ok = p.ok AND x.n = p.n + 1 JOIN rl f ON f.ok = p.ok AND f.n = 1),
rt AS (SELECT *, (c AND (v = 'checked' AND t = 'check' OR v = 'yes' AND t = 'yesno')) OR v <> '' AS tip FROM rc)
"""


def _review_oracles() -> dict[str, str]:
    head = "WITH RECURSIVE " + REVIEWS.strip() + "\n"
    return {
        "visibility_many_templates": head + """SELECT DISTINCT qid, tid AS template_id, 'o' AS item_id, 0 AS ordinal, TRUE AS shown, TRUE AS visible FROM rt
            UNION ALL SELECT qid, tid, 'l' || n, 3 * n - 2, c, c FROM rt
            UNION ALL SELECT qid, tid, 'q' || n, 3 * n - 1, TRUE, c FROM rt
            UNION ALL SELECT qid, tid, 't' || n, 3 * n, tip, c AND tip FROM rt""",
        "merged_visibility": head + """, x AS (SELECT *, CASE WHEN n > 1 THEN 3 ELSE 0 END AS d FROM rt)
            SELECT DISTINCT qid, tid AS template_id, 'o' AS item_id, 0 AS ordinal, TRUE AS shown, TRUE AS visible FROM x
            UNION ALL SELECT qid, tid, 'l' || n, 3 * n - 2 + d, c, c FROM x
            UNION ALL SELECT qid, tid, 'q' || n, 3 * n - 1 + d, TRUE, c FROM x
            UNION ALL SELECT qid, tid, 't' || n, 3 * n + d, tip, c AND tip FROM x
            UNION ALL SELECT qid, tid, 'ext:' || unnest(['review', 'note', 'check']), unnest([4, 5, 6]), unnest([TRUE, TRUE, v <> '']), unnest([TRUE, TRUE, v <> ''])
              FROM x WHERE n = 1""",
        "tips_many_templates": head + """SELECT qid, tid AS template_id, 't' || n AS item_id, TRUE AS warn, 'medium' AS severity, CAST(NULL AS VARCHAR) AS name
            FROM rt WHERE c AND tip""",
        "unanswered_many_templates": head + """, u AS (SELECT *, CAST(c AND t <> 'check' AND v = '' AS INTEGER) AS missing FROM rt)
            SELECT qid, tid AS template_id, 'l' || n AS block_id, missing AS unanswered FROM u
            UNION ALL SELECT qid, tid, 'o', CAST(sum(missing) AS INTEGER) FROM u GROUP BY ALL""",
        "template_lint_order": head + """, o AS (SELECT DISTINCT ok, tid, m FROM rl)
            SELECT tid AS template_id, 'l' || unnest([2, 3]) AS item_id, 'cycle' AS rule, 'condition depends on itself' AS detail FROM o WHERE ok % 5 = 0 AND m >= 3
            UNION ALL SELECT tid, 'l2', 'forward_reference', 'q3' FROM o WHERE ok % 5 = 0 AND m >= 3
            UNION ALL SELECT tid, 'l1', 'forward_reference', 'q1/value' FROM o WHERE ok % 9 = 0
            UNION ALL SELECT tid, 'l1', 'invalid_condition', 'wrong number of arguments' FROM o WHERE ok % 9 = 0
            UNION ALL SELECT tid, NULL, 'root', 'expected one root item, found 2' FROM o WHERE ok % 7 = 0"""}


COMMANDS = LOG.split("lagged AS")[0].rstrip().rstrip(",") + """,
cm AS (
  SELECT e.*, event_type IN ('signup', 'view') AS is_save, event_type = 'error' AS is_del
  FROM (SELECT log.*, events.event_type FROM log JOIN events ON log.seq = events.event_id) e),
cb AS (
  SELECT *, last_value(CASE WHEN is_save THEN seq END IGNORE NULLS) OVER w AS saved_seq,
    last_value(CASE WHEN is_save THEN TRUE WHEN is_del THEN FALSE END IGNORE NULLS) OVER v AS stood
  FROM cm WINDOW w AS (PARTITION BY qid ORDER BY event_ts, seq),
    v AS (PARTITION BY qid ORDER BY event_ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cl AS (
  SELECT c.qid, c.seq, c.event_ts, c.is_del,
    CASE WHEN c.is_save OR c.is_del THEN s.app_status WHEN c.event_type = 'purchase' THEN 'Approved' ELSE 'In Review' END AS app_status,
    CASE WHEN c.is_save OR c.is_del THEN s.user_name ELSE 'reviewer' || c.seq % 3 END AS user_name,
    CASE WHEN c.is_save OR c.is_del THEN s."timestamp" ELSE c.event_ts END AS "timestamp",
    CASE WHEN NOT c.is_save AND NOT c.is_del THEN CASE WHEN c.event_type = 'purchase' THEN 'Approved' ELSE 'In Review' END END AS answer_status
  FROM cb c LEFT JOIN log s ON s.seq = c.saved_seq WHERE c.is_save OR c.stood)
"""


def _command_oracles() -> dict[str, str]:
    return {
        "commands_current": _with(COMMANDS) + """SELECT qid, app_status, user_name, "timestamp", seq, answer_status FROM cl
            QUALIFY row_number() OVER (PARTITION BY qid ORDER BY event_ts DESC, seq DESC) = 1 AND NOT is_del""",
        "commands_audit": _with(COMMANDS, """p AS (SELECT *, lag(is_del) OVER w AS p_del, lag(app_status) OVER w AS p_status, lag(user_name) OVER w AS p_user,
              lag("timestamp") OVER w AS p_ts FROM cl WINDOW w AS (PARTITION BY qid ORDER BY event_ts, seq))""") + """
            SELECT 2 * seq AS audit_id, qid, p_status AS app_status, p_user AS user_name, p_ts AS "timestamp", event_ts AS audit_timestamp FROM p WHERE NOT p_del
            UNION ALL SELECT 2 * seq + 1, qid, 'DELETED', 'ADMIN', p_ts, event_ts FROM p WHERE NOT p_del AND is_del""",
        "commands_rejected": _with(COMMANDS) + """SELECT qid, CASE WHEN is_del THEN 'delete' ELSE 'status' END AS command,
              CASE WHEN event_type = 'purchase' THEN 'a' ELSE 'r' END AS status, 'reviewer' || seq % 3 AS user, event_ts, seq, 500 AS error
            FROM cb WHERE NOT is_save AND NOT coalesce(stood, FALSE)"""}


def _template_oracles() -> dict[str, str]:
    lint_sql = _with(LINES, TOKENS, """lagged_tokens AS (SELECT *, lag(kind) OVER (PARTITION BY tid, item_id ORDER BY pos) AS prev
              FROM tokens)""") + f"""
        SELECT tid AS template_id, 'q_' || pk AS item_id, 'unknown_type' AS rule, 'dropdown' AS detail FROM li WHERE qtype = 'dropdown'
        UNION ALL
        SELECT tid, item_id, 'duplicate_id', CAST(count(*) AS VARCHAR) FROM items GROUP BY tid, item_id HAVING count(*) > 1
        UNION ALL
        SELECT tid, 'q_' || pk, 'property', 'yes and no are mandatory' FROM li WHERE qtype = 'yesno' AND NOT open_line
        UNION ALL
        SELECT t.tid, t.item_id, 'unknown_reference', t.token FROM tokens t
        WHERE t.kind = 'name' AND t.token <> 'false' AND NOT EXISTS (
          SELECT 1 FROM items i WHERE i.tid = t.tid
            AND i.item_id = regexp_replace(regexp_replace(t.token, '^\\^', ''), '(/yes|/no|/value)$', ''))
        UNION ALL
        SELECT tid, item_id, 'invalid_condition', 'unterminated string or stray character' FROM items
        WHERE cond IS NOT NULL AND trim(cond) <> '' AND trim(regexp_replace(cond, '{TOKEN_RE}', '', 'g')) <> ''
        UNION ALL
        SELECT tid, item_id, 'invalid_condition', 'missing operator' FROM lagged_tokens
        WHERE (kind IN ('name', 'string', 'func')) AND prev IN ('name', 'string', 'func', 'close')"""
    merged = _with(LINES, EXT, """good AS (SELECT * FROM tgt WHERE NOT bad_version AND t IS NOT NULL)""") + """
        SELECT i.tid AS template_id, i.item_id,
          CAST(CASE WHEN i.depth = 0 THEN 0
                    WHEN (g.after AND li.r <= g.t) OR (NOT g.after AND li.r < g.t) THEN i.ordinal
                    ELSE i.ordinal + 2 END AS INTEGER) AS ordinal,
          i.depth, i.parent_id, i.type, 'base' AS source
        FROM items i JOIN good g ON i.tid = g.tid
        LEFT JOIN li ON li.tid = i.tid AND ((i.depth = 1 AND i.item_id = 'o' || li.ok || '_l' || li.ln)
                                         OR (i.depth = 2 AND i.parent_id = 'o' || li.ok || '_l' || li.ln))
        UNION ALL
        SELECT tid, 'ext:review', CAST(CASE WHEN after THEN 2 * t + 1 ELSE 2 * t - 1 END AS INTEGER), 1, 'o' || ok,
          'block', 'extension' FROM good
        UNION ALL
        SELECT tid, 'ext:note', CAST(CASE WHEN after THEN 2 * t + 2 ELSE 2 * t END AS INTEGER), 2, 'ext:review',
          'line', 'extension' FROM good"""
    return {
        "flatten_template": _with(LINES) + """SELECT tid AS template_id, item_id, CAST(ordinal AS INTEGER) AS ordinal,
            CAST(depth AS INTEGER) AS depth, parent_id, type, cond FROM items""",
        "condition_tokens": _with(LINES, TOKENS) + "SELECT tid AS template_id, item_id, pos, token, kind FROM tokens",
        "template_lint": lint_sql,
        "merge_templates": merged,
        "merge_errors": _with(LINES, EXT) + "SELECT tid AS template_id, CAST(apply_order AS INTEGER) AS apply_order, error FROM errs",
    }


REQ = """
r AS (SELECT ts, 'client' || CAST(user_id AS VARCHAR) AS client, 'gw' || CAST(user_id % 2 AS VARCHAR) AS gateway,
    '/' || CASE event_type WHEN 'purchase' THEN 'submit' WHEN 'click' THEN 'savedraft' ELSE event_type END AS path,
    CASE WHEN event_id % 3 = 0 THEN 'application/json' ELSE 'application/x-www-form-urlencoded' END AS content_type,
    CAST(round(value * 1000) AS BIGINT) AS content_length, event_id AS seq FROM events)
"""

LIMITS = """
lim(path, max_length) AS (VALUES ('/submit', CAST(1048576 AS BIGINT)), ('/savedraft', 1048576), ('/diff', 256),
  ('/loadone', 256), ('/status', 256), ('/submissions', 256), ('/logout', 256), ('/login', 256))
"""


def _request_oracles() -> dict[str, str]:
    return {
        "rate_limit_violations": _with(REQ, """x AS (SELECT gateway, seq, ts,
              row_number() OVER (PARTITION BY gateway, date_trunc('hour', ts) ORDER BY ts, seq) AS rank_hour,
              row_number() OVER (PARTITION BY gateway, date_trunc('day', ts) ORDER BY ts, seq) AS rank_day FROM r)""")
        + "SELECT gateway, seq, ts, rank_hour, rank_day FROM x WHERE rank_hour > 50 OR rank_day > 200",
        "user_sessions": _with(REQ, """g AS (SELECT client, ts,
              CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 300 SECOND THEN 1 ELSE 0 END AS new_s
              FROM r WINDOW w AS (PARTITION BY client ORDER BY ts))""",
                                """s AS (SELECT client, ts, sum(new_s) OVER (PARTITION BY client ORDER BY ts
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM g)""")
        + """SELECT client, min(ts) AS session_start, max(ts) + INTERVAL 300 SECOND AS session_end,
              count(*) AS n_requests FROM s GROUP BY client, sid""",
        "oversized_requests": _with(REQ, LIMITS) + """SELECT r.ts, r.client, r.path, r.content_length,
              coalesce(lim.max_length, 256) AS max_length FROM r LEFT JOIN lim ON r.path = lim.path
            WHERE r.content_length > coalesce(lim.max_length, 256)
              AND contains(r.content_type, 'application/x-www-form-urlencoded')""",
        "error_digest": """WITH l AS (SELECT ts, CASE WHEN event_type = 'error' THEN 'ERROR'
                WHEN event_type = 'purchase' THEN 'CRITICAL' ELSE 'INFO' END AS level,
              event_type || ' by user ' || CAST(user_id AS VARCHAR) AS message, event_id AS seq FROM events),
            b AS (SELECT *, row_number() OVER (ORDER BY ts, seq) - 1 AS rnk FROM l WHERE level IN ('ERROR', 'CRITICAL'))
            SELECT CAST(rnk // 10 AS BIGINT) AS digest_id, min(seq) AS first_seq, max(seq) AS last_seq,
              count(*) AS n_records, count(*) FILTER (WHERE level = 'ERROR') AS n_errors,
              coalesce(string_agg(CASE WHEN level = 'ERROR' THEN message END, chr(13) || chr(10) ORDER BY rnk), '') AS body
            FROM b GROUP BY rnk // 10 HAVING count(*) = 10""",
        "autosave_batches": _with(CHANGES, """b AS (SELECT qid, make_timestamp(epoch_us(ts) // 2000000 * 2000000) AS batch_start,
              key, value, seq, ts FROM ch0)""")
        + """SELECT qid, batch_start, key, value, seq FROM (SELECT *, row_number() OVER
              (PARTITION BY qid, batch_start, key ORDER BY ts DESC, seq DESC) AS rn FROM b) WHERE rn = 1""",
        "review_notices": _with(LOG) + """SELECT qid, seq, app_status,
              'QID: ' || qid || ' : Security Architecture Review for project: ' || app_name AS subject,
              CASE app_status WHEN 'Draft' THEN 'MAIL_BODY_DRAFT' WHEN 'Submitted' THEN 'MAIL_BODY_SUBMITTED'
                WHEN 'In Review' THEN 'MAIL_BODY_IN_REVIEW' WHEN 'Approved' THEN 'MAIL_BODY_APPROVED' END AS body_template
            FROM log WHERE op <> 'delete' AND app_status IN ('Draft', 'Submitted', 'In Review', 'Approved')""",
    }

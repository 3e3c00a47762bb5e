"""Status and delete commands folded into the log."""

import datetime as dt
import json

from formlake.operators import audit, commands, store
from formlake.schemas import EVENT_LOG


def _at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def test_commands_become_versions(spark):
    def save(qid, n, status="Draft"):
        return (qid, status, "t", "p", f"app{n}", None, None, f"u{n}", _at(n), json.dumps({"k": str(n)}), None, "", None, n, "save", _at(n))

    log = spark.createDataFrame([save("A", 1), save("A", 6), save("B", 2)], EVENT_LOG)
    rows = [("A", "status", "a", "r1", _at(0), 0), ("A", "status", "x", "r1", _at(3), 3), ("A", "status", "a", "r2", _at(4), 4),
            ("B", "delete", None, "r1", _at(5), 5), ("B", "delete", None, "r1", _at(7), 7), ("B", "status", "a", "r1", _at(8), 8),
            ("none", "status", "a", "r1", _at(9), 9), ("A", "status", "a", "r3", _at(40), 40)]
    asked = spark.createDataFrame(rows, "qid string, command string, status string, user string, event_ts timestamp, seq long")
    out, rejected = commands.apply_commands(log, asked)
    assert {(r.qid, r.seq, r.error) for r in rejected.collect()} == {("A", 0, 500), ("B", 7, 500), ("B", 8, 500), ("none", 9, 500)}
    current = store.current_state(out).collect()
    assert [(r.qid, r.app_status, r.user_name, r.app_name, r.timestamp) for r in current] == [("A", "Approved", "r3", "app6", _at(40))]
    assert json.loads(current[0].answer) == {"k": "6", "app_status": "Approved", "timestamp": "2024-01-02 16:00:00"}
    log_rows = {(r.audit_id, r.qid, r.app_status, r.user_name) for r in audit.audit_log(out).collect()}
    assert log_rows == {(6, "A", "Draft", "u1"), (8, "A", "In Review", "r1"), (12, "A", "Approved", "r2"), (80, "A", "Draft", "u6"),
                        (10, "B", "Draft", "u2"), (11, "B", "DELETED", "ADMIN")}

"""Answer-file import/export (fixture files written to a fresh temporary folder)."""

import json
import os

from pyspark.sql import functions as F

from formlake.functions.text import deterministic_token
from formlake.sources import files


def _write(path, content, mtime):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(content)
    os.utime(path, (mtime, mtime))


def test_import_revisions(spark, tmp_path):
    root = str(tmp_path)
    _write(f"{root}/a/v1.txt", json.dumps({"qid": "AAAAAAAAAAAA", "app_name": "One"}), 1_700_000_000)
    _write(f"{root}/a/v2.txt", json.dumps({"qid": "OTHER", "app_name": "One; v2", "q_version_0_2": "checked"}),
           1_700_000_100)
    _write(f"{root}/b/x1.txt", "not json", 1_700_000_000)
    _write(f"{root}/b/x2.txt", json.dumps({"app_name": "Two", "app_status": "Draft"}), 1_700_000_050)
    log, rejected = files.import_revisions(spark, root)
    rows = sorted((r.qid, r.app_name, r.app_status, r.user_name, r.op) for r in log.collect())
    token = spark.range(1).select(deterministic_token(F.lit(f"file:{root}/b")).alias("t")).first().t
    assert rows == sorted([("AAAAAAAAAAAA", "One", "Submitted", "admin", "import"),
                           ("AAAAAAAAAAAA", "One v2", "Submitted", "admin", "import"),
                           (token, "Two", "Draft", "admin", "import")])
    assert [r.path.endswith("x1.txt") for r in rejected.collect()] == [True]
    flags = {r.app_name: json.loads(r.answer).get("q_version_0_1") for r in log.collect()}
    assert flags == {"One": "checked", "One v2": None, "Two": "checked"}


def test_read_answers_and_lookup(spark, tmp_path):
    root = str(tmp_path)
    _write(f"{root}/QID1_App_x.txt", json.dumps({"qid": "QID1"}), 1_700_000_000)
    _write(f"{root}/QID2_Other.txt", json.dumps({"qid": "QID2", "q_version_0_2": "checked"}), 1_700_000_000)
    _write(f"{root}/broken.txt", "[1, 2]", 1_700_000_000)
    got = {os.path.basename(r.path): (r.answers, r.error) for r in files.read_answers(spark, root).collect()}
    assert got["QID1_App_x.txt"][0] == {"qid": "QID1", "q_version_0_1": "checked"}
    assert got["QID2_Other.txt"][0] == {"qid": "QID2", "q_version_0_2": "checked"}
    assert got["broken.txt"] == (None, "not a JSON object")
    bf = spark.read.format("binaryFile").load(root)
    assert [os.path.basename(r.path) for r in files.find_answer_file(bf, "qid1").collect()] == ["QID1_App_x.txt"]


def test_snapshot_round_trip(spark, tmp_path):
    from formlake.schemas import AUDIT, SUBMISSION

    answers = spark.createDataFrame([("Q", "Draft", "", "", "n", "c", "m", "u", None, "{}", None, "", None)], SUBMISSION)
    audit = spark.createDataFrame([], AUDIT)
    first = files.export_snapshot({"Answers": answers, "Audit": audit}, str(tmp_path))
    second = files.export_snapshot({"Answers": answers.limit(0), "Audit": audit.limit(0)}, str(tmp_path))
    assert second > first and files.restore_snapshot(spark, str(tmp_path), second)["Answers"].count() == 0
    back = files.restore_snapshot(spark, str(tmp_path), first)
    assert back["Answers"].collect() == answers.collect() and back["Audit"].count() == 0


def test_imported_versions_are_numbered_once(spark, tmp_path):
    """Several directories, two of which name the same qid: no seq or audit id occurs twice."""
    from formlake.operators import audit

    for k, qid in enumerate(["Q1", "Q1", "Q2"]):
        (tmp_path / f"d{k}").mkdir()
        for v in range(3):
            f = tmp_path / f"d{k}" / f"v{v}.txt"
            f.write_text("{" if (k, v) == (2, 1) else json.dumps({"qid": qid, "app_name": f"a{k}{v}"}))
            os.utime(f, (1_700_000_000 + 10 * v, 1_700_000_000 + 10 * v))  # the same times in every directory
    log, rejected = files.import_revisions(spark, str(tmp_path))
    rows = log.select("qid", "seq", "event_ts").collect()
    assert len(rows) == 8 and len({r.seq for r in rows}) == 8 and rejected.count() == 1
    assert [r.seq for r in sorted(rows, key=lambda r: (r.event_ts, r.seq))] == sorted(r.seq for r in rows)
    ids = [r.audit_id for r in audit.audit_log(log).select("audit_id").collect()]
    assert len(ids) == len(set(ids)) == 6

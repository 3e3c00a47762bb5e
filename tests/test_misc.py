"""Smaller rules: answer defaults, status changes, revision lookup, uploads, tips, links, files."""

import datetime as dt

from pyspark.sql import functions as F

from formlake.functions import text
from formlake.operators import audit, diff, requests, store
from formlake.operators.templates import flatten_templates, siblings, templates_from_texts
from formlake.schemas import SUBMISSION
from formlake.sources import files


def test_submission_columns_and_defaults(spark):
    df = spark.createDataFrame([({"qid": "Q'1", "app_name": "N;ame", text.TRACKER_NAMESPACE + "app_tid": "T1", "login_user": "u",
                                  "login_userMail": "u@x", "note": "see AB-12"},)], "answers map<string,string>")
    r = store.submission_columns(df, ts=F.lit(dt.datetime(2024, 1, 1))).first()
    assert (r.qid, r.app_name, r.app_tid, r.app_pid, r.user_name, r.action_items, r.comments) == \
        ("Q1", "Name", "T1", "", "u", "AB-12", None)
    m = df.select(store.apply_save_defaults(F.col("answers"), F.lit("/submit"), F.lit("me"), F.lit("me@x"),
                                            F.lit("NEWQID")).alias("m")).first().m
    assert m["app_status"] == "Submitted" and m["q_version_0_2"] == "checked" and m["qid"] == "Q'1"
    m = spark.range(1).select(store.apply_load_defaults(F.create_map().cast("map<string,string>"),
                                                        F.lit("NEWQID")).alias("m")).first().m
    assert m == {"qid": "NEWQID", "q_version_0_1": "checked"}
    row = spark.createDataFrame([("Q", "Approved", '{"app_status": "Draft", "x": "1"}')],
                                "qid string, app_status string, answer string")
    assert store.load_answer_view(row).first().answers == {"app_status": "Approved", "x": "1"}


def _current(spark):
    return spark.createDataFrame([("Q1", "Submitted", "", "", "n", "c", "m", "u", dt.datetime(2024, 1, 1),
                                   '{"a": "1"}', None, "", None)], SUBMISSION)


def test_set_status(spark):
    cmds = spark.createDataFrame([("Q1", "a", "rev", dt.datetime(2024, 2, 1)), ("Q9", "r", "rev", dt.datetime(2024, 2, 1))],
                                 "qid string, status string, user string, ts timestamp")
    got = {r.qid: (r.app_status, r.user_name, r.error) for r in store.set_status(_current(spark), cmds).collect()}
    assert got == {"Q1": ("Approved", "rev", None), "Q9": (None, None, 500)}


def test_search_dispatch_and_revision_lookup(spark):
    aud = spark.createDataFrame([(7, "Q1", "Draft", "n")], "audit_id long, qid string, app_status string, app_name string")
    terms = spark.createDataFrame([(1, "Q1-7"), (2, "q1"), (3, "a-b-c"), (4, "Q1-x")], "term_id int, term string")
    got = {r.term_id: (r.kind, r.app_status) for r in store.search_dispatch(_current(spark), aud, terms).collect()}
    assert got == {1: ("revision", "Revision"), 2: ("search", "Submitted"), 3: ("rejected", None),
                   4: ("rejected", None)}


def test_upload_tip_and_link_rules(spark):
    df = spark.createDataFrame([("f1|a.pdf", "a.PDF", None, True, "high"), ("x", "b.exe", "Custom", False, None)],
                               "u string, n string, title string, warn boolean, sev string")
    rows = df.select(text.upload_parts("u").alias("p"), text.upload_extension_ok("n").alias("ok"),
                     text.tip_label("title", "warn", "sev").alias("label"),
                     text.tip_severity("warn", "sev").alias("s")).collect()
    assert rows[0].p.file_id == "f1" and rows[0].ok and rows[0].label.startswith("Warning") and rows[0].s == "high"
    assert rows[1].p is None and not rows[1].ok and rows[1].label == "Custom" and rows[1].s is None
    one = spark.createDataFrame([("AB-1,CD-2", "app/x,y", "t@x", "Q1", {"app_documentation": "doc"})],
                                "ai string, name string, mail string, q string, a map<string,string>")
    r = one.select(text.action_item_links("ai", "https://t/").alias("l"),
                   text.answers_download_name("q", "name", "mail", F.lit("qid")).alias("d"),
                   text.project_summary("a").alias("s"),
                   text.contact_link("mailto:TEAM_DEVELOPER_EMAIL?s=APPLICATION_NAME", "mail", "name").alias("c"),
                   text.status_from_action(F.lit("/savedraft")).alias("st"),
                   text.template_id_from_path(F.lit("/q/dir/tpl.json")).alias("tid")).first()
    assert r.l == ["https://t/AB-1", "https://t/CD-2"]
    assert r.d == "answers_Q1_app_x"
    assert r.s.startswith("<b>Project overview:</b><br /><br />doc ")
    assert r.c == "mailto:t@x?s=app/x,y" and r.st == "Draft" and r.tid == "tpl"


def test_siblings_and_existing(spark):
    t = '{"questionnaire":[{"type":"block","text":"r","items":[{"type":"line","id":"a","text":"A"},' \
        '{"type":"line","id":"b","text":"B"}]}]}'
    items = flatten_templates(templates_from_texts(spark, {"t": t}), materialize=False)
    got = {r.item_id: (r.previous_id, r.next_id) for r in siblings(items).collect()}
    assert got["a"] == (None, "b") and got["b"] == ("a", None)
    batch = spark.createDataFrame([("Q1",), ("Q2",)], "qid string")
    assert [r.qid for r in store.existing_qids(batch, _current(spark)).collect()] == ["Q1"]
    assert [r.qid for r in store.new_qids(batch, _current(spark)).collect()] == ["Q2"]


def test_append_only_and_counts(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "audit_id long, v string")
    assert audit.audit_is_append_only(a, a.union(spark.createDataFrame([(3, "z")], a.schema))).count() == 0
    assert audit.audit_is_append_only(a, a.where("audit_id = 1")).count() == 1
    d = spark.createDataFrame([("Q", "k1"), ("Q", "k2")], "qid string, key string")
    assert diff.any_modified(d).first().n_changed == 2
    ch = spark.createDataFrame([("Q", "k", dt.datetime(2024, 1, 2)), ("Q", "k2", dt.datetime(2023, 1, 1))],
                               "qid string, key string, ts timestamp")
    saves = spark.createDataFrame([("Q", dt.datetime(2024, 1, 1))], "qid string, saved_ts timestamp")
    assert diff.pending_changes(ch, saves).first().pending == 1


def test_reviewers_and_usernames(spark):
    d = spark.createDataFrame([("a", "a@x", "A", ["CN=Sec"]), ("b", "b@x", "B", []), ("c", "c@x", "C", None)],
                              "account string, mail string, name string, memberOf array<string>")
    got = {r.account: r.is_reviewer for r in requests.reviewer_flags(d, "CN=Sec", ["c", ""]).collect()}
    assert got == {"a": True, "b": False, "c": True}
    u = spark.createDataFrame([("ok.user",), ("#bad",), ("x" * 41,)], "user_name string")
    assert [r.user_name for r in requests.invalid_usernames(u).collect()] == ["#bad", "x" * 41]


def test_file_names_and_allow_list(spark, tmp_path):
    cur = _current(spark)
    assert files.answer_files(cur).first().file_name == "Q1_n_c_m.txt"
    files.write_answer_files(cur, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().file_name == "Q1_n_c_m.txt"
    t = spark.createDataFrame([("/q/a.json",), ("/q/b.json",)], "path string")
    assert [r.path for r in files.served_templates(t, ["a.json"]).collect()] == ["/q/a.json"]
    bf = spark.createDataFrame([("/d/1.txt", dt.datetime(2024, 1, 1), 1, bytearray(b'{"app_name": "x/y"}')),
                                ("/d/2.txt", dt.datetime(2024, 1, 2), 1, bytearray(b'{"app_name": "new", '
                                                                                  b'"app_champion": "a;b"}'))],
                               "path string, modificationTime timestamp, length long, content binary")
    r = files.latest_file_per_dir(bf).first()
    assert r.path == "/d/2.txt" and r.target.endswith("_new_a b_null.json")


def test_error_digests_global_and_per_source(spark):
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(45):
        level = ["ERROR", "CRITICAL", "INFO"][i % 3]
        rows.append((base + dt.timedelta(minutes=i), level, f"m{i}", i, f"host{i % 2}"))
    logs = spark.createDataFrame(rows, "ts timestamp, level string, message string, seq long, host string")
    # 30 buffered records → 3 full digests of 10; the body keeps only the ERROR lines
    g = requests.error_digests(logs).orderBy("digest_id").collect()
    assert [(r.digest_id, r.n_records, r.n_errors) for r in g] == [(0, 10, 5), (1, 10, 5), (2, 10, 5)]
    assert g[0].body.split("\r\n") == ["m0", "m3", "m6", "m9", "m12"]
    # per host: 15 buffered records each → one full digest per host
    p = {r.host: (r.digest_id, r.n_records) for r in requests.error_digests(logs, source="host").collect()}
    assert p == {"host0": (0, 10), "host1": (0, 10)}


class _State:
    """Stand-in for the streaming group state (exists / get / update)."""

    def __init__(self):
        self.value = None

    @property
    def exists(self):
        return self.value is not None

    @property
    def get(self):
        return self.value

    def update(self, v):
        self.value = v


def test_digest_state_carries_records_between_batches():
    import pandas as pd

    from formlake.streaming.streams import _digest_group

    fn = _digest_group(10)
    rows = [(pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i), i, "ERROR" if i % 2 else "CRITICAL", f"m{i}")
            for i in range(25)]
    frame = pd.DataFrame(rows, columns=["ts", "seq", "level", "message"])
    st = _State()
    out1 = next(fn(("h",), iter([frame.iloc[:7]]), st))   # 7 waiting
    out2 = next(fn(("h",), iter([frame.iloc[7:18]]), st))  # 18 → one digest, 8 waiting
    out3 = next(fn(("h",), iter([frame.iloc[18:]]), st))   # 15 → one digest, 5 waiting
    assert len(out1) == 0 and list(out2["digest_id"]) == [0] and list(out3["digest_id"]) == [1]
    assert (out2.iloc[0]["first_seq"], out2.iloc[0]["last_seq"]) == (0, 9)
    assert (out3.iloc[0]["first_seq"], out3.iloc[0]["last_seq"]) == (10, 19)
    assert out3.iloc[0]["body"].split("\r\n") == ["m11", "m13", "m15", "m17", "m19"]
    assert st.value[0] == 2 and st.value[2] == [20, 21, 22, 23, 24]


def test_keyword_hits_use_the_rarest_trigram(spark):
    """Against every keyword compared with every row, and without a nested loop in the plan."""
    import itertools
    import random
    import re

    rng = random.Random(8)
    texts = ["".join(rng.choice("abAB%_\\é ") for _ in range(rng.randrange(9))) for _ in range(120)] + [None, "", "aaa", "Straße", "x" * 5000 + "needle"]
    rows = spark.createDataFrame([(str(i), a, b) for i, (a, b) in enumerate(itertools.product(rng.sample(texts, 12), texts))], "qid string, a string, b string")
    words = ["a", "AB", "aba", "abab", "%", "", "_", "a_b", "a%b", "___", "é", "ab\\", "\\a", "STRASSE", "straße", "b %", "needle", "ab_ab%a", None]
    terms = spark.createDataFrame(list(enumerate(words)), "term_id int, kw string")
    hits = store.keyword_hits(rows, terms, ["a", "b"])
    assert not re.search("NestedLoop|Cartesian", hits._jdf.queryExecution().executedPlan().toString())

    def matches(word, text):
        pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in word.lower())
        return text is not None and re.search(pattern, text.lower(), re.S) is not None

    want = sorted((i, r.qid) for i, w in enumerate(words) if w is not None for r in rows.collect() if matches(w, r.a) or matches(w, r.b))
    assert sorted((r.term_id, r.qid) for r in hits.collect()) == want


def test_keyword_hits_once_a_row_and_by_long_pieces(spark):
    """Every row (repeated ones too) comes once a term, as a comparison of all with all says."""
    import re

    texts = [("customer#000000012", "Q00000000012", "x"), ("customer#000000012", "Q00000000012", "x"), ("Customer#000000121", None, "customer#000000012"),
             (None, None, None), ("", None, None), ("a%b_c", "AB", "zz"), ("ab", "cab", "dab"), ("line\none", "é" * 40, "x" * 70)]
    words = [(1, "customer_000000012"), (2, "Customer#000000012"), (3, "ab"), (4, ""), (5, "__"), (6, "%"), (7, "a%c"), (8, "x" * 65), (9, None),
             (10, "e_o"), (11, "_" * 41), (12, "éé_é"), (2, "AB"), (13, "0000000_2"), (14, "no such text")]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)] + [(0, *texts[0])], "n int, a string, b string, c string")
    found = store.keyword_hits(rows, spark.createDataFrame(words, "term_id int, kw string"), ["a", "b", "c"])

    def hit(kw, text):
        if not re.search("[%_]", kw):
            return kw.lower() in text.lower()
        return re.search("".join(".*" if x == "%" else "." if x == "_" else re.escape(x) for x in kw.lower()), text.lower(), re.S) is not None

    want = sorted((t, n) for t, kw in words if kw is not None for n, *cells in [(i, *x) for i, x in enumerate(texts)] + [(0, *texts[0])]
                  if any(x is not None and hit(kw, x) for x in cells))
    assert sorted((r.term_id, r.n) for r in found.collect()) == want
    assert found.columns == ["term_id", "n", "a", "b", "c"]
    # a keyword of nine digits meets the texts that share eight of them, not all that share three
    many = spark.range(3000).selectExpr("id", "concat('Customer#', lpad(cast(id as string), 9, '0')) as name")
    assert store.keyword_hits(many, many.selectExpr("id as term_id", "replace(name, '#', '_') as kw"), ["name"]).count() == 3000

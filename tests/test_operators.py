"""Operators against loop models, known values and edge cases."""

import html
import math
import random
import re
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lakewarden.functions import stats, text
from lakewarden.functions.present import present, strip_quotes
from lakewarden.operators import analysis, audit, matching, normalize, stability
from lakewarden.operators.enforce import Rule, check_rules, enforce, scope_flags
from lakewarden.operators.nested import node_rows
from lakewarden.sources import records, sinks
from lakewarden.sources.tables import bounded_rows, cut, shared_dir
from lakewarden.streaming.flows import scope_stream, session_stream


def one(spark, column, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first().v


# Enforcement against a plain loop


def model(plan, rules, catalog, matched, approved, defer):
    known, gated = {a for a, _ in catalog}, {a for a, g in catalog if g}
    plan, found = [a for a in plan or [] if a in known], []
    for r in rules:
        if r.kind == "mandatory" and r.rule_id in (matched or []) and r.action not in plan:
            plan = [r.action, *plan]
            found.append((r.rule_id, "missing_mandatory"))
    changed = True
    while changed:
        changed = False
        for r in rules:
            if r.kind != "prohibit_before" or r.action not in plan or r.before in plan[: plan.index(r.action)]:
                continue
            if (r.rule_id, "order_violation") not in found:
                found.append((r.rule_id, "order_violation"))
            plan = [a for a in plan if a != r.before]
            plan.insert(plan.index(r.action), r.before)
            changed = True
    for r in rules:
        if r.kind == "require_approval" and r.action in plan and r.action in gated and r.action not in (approved or []):
            found.append((r.rule_id, "approval_deferred" if defer else "approval_required"))
            if not defer:
                plan = [a for a in plan if a != r.action]
    return list(dict.fromkeys(a for a in plan if a in known)), found


@pytest.mark.parametrize("seed", range(6))
def test_enforce_against_loop(spark, seed):
    rng = random.Random(seed)
    names = list("abcdef")
    catalog = [(a, rng.random() < 0.5) for a in names if rng.random() < 0.9]
    rules = [Rule(f"M{i}", "mandatory", rng.choice([*names, "zz"])) for i in range(3)]
    while True:
        order = [Rule(f"O{i}", "prohibit_before", *(lambda p: (p[0], "hard", p[1]))(rng.sample(names, 2))) for i in range(4)]
        try:
            check_rules(order)
            break
        except ValueError:
            continue
    rules += order + [Rule(f"A{i}", "require_approval", rng.choice(names)) for i in range(3)]
    rows = [(i, [rng.choice([*names, "unknown"]) for _ in range(rng.randrange(8))], rng.sample(["M0", "M1", "M2"], rng.randrange(4)), rng.sample(names, 2), rng.random() < 0.5) for i in range(120)]
    rows += [(200, None, None, None, False), (201, [], ["M0"], [], True)]
    df = spark.createDataFrame(rows, "i int, plan array<string>, matched array<string>, approved array<string>, defer boolean").withColumn("violations", F.lit("clash"))
    out = {r.i: r for r in enforce(df, rules, catalog, defer=F.col("defer")).collect()}
    for i, plan, matched, approved, defer in rows:
        want, found = model(plan, rules, catalog, matched, approved, defer)
        assert (out[i].enforced, [(v.rule_id, v.type) for v in out[i].found]) == (want, found)
    # Without deferral no gated action is left, and order repairs are idempotent.
    again = enforce(enforce(df, order, catalog).select("i", F.col("enforced").alias("plan"), "matched", "approved"), order, catalog)
    assert again.where(F.array_join("plan", ",") != F.array_join("enforced", ",")).count() == 0
    assert enforce(df.limit(0), rules, catalog).count() == 0


def test_rule_cycles():
    with pytest.raises(ValueError, match="cycle"):
        check_rules([Rule("1", "prohibit_before", "a", before="b"), Rule("2", "prohibit_before", "b", before="a")])
    with pytest.raises(ValueError, match="cycle"):
        check_rules([Rule("1", "prohibit_before", "a", before="a")])
    check_rules([Rule(str(i), "prohibit_before", f"n{i}", before=f"n{i + 1}") for i in range(2000)])


def test_scope(spark):
    rules = [
        Rule("1", "mandatory", "a", scope={"event_type_contains": ["X"], "command_contains": ["p", "q"]}),
        Rule("2", "mandatory", "a", scope={"global": ["true"]}),
        Rule("3", "mandatory", "a", scope={"severity_contains": ["hi"]}),
    ]
    rows = [("i", "xx", None, "q p", "HIGH", ""), ("j", "xx", None, "p", None, None), ("k", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "incident_id string, event_type string, category string, command string, severity string, details_text string")
    assert {r.incident_id: r.matched for r in scope_flags(df, rules).collect()} == {"i": ["1", "3"], "j": [], "k": []}
    assert scope_flags(df.limit(0), rules).count() == 0 and scope_flags(df, []).count() == 3


# Statistics


def test_statistics(spark):
    low, high = stats.wilson(F.lit(72), F.lit(200))
    assert (one(spark, low), one(spark, high)) == (0.2967, 0.4286)
    assert [one(spark, x) for x in stats.wilson(F.lit(0), F.lit(0))] == [0.0, 0.0]
    assert [one(spark, x) for x in stats.wilson(F.lit(0), F.lit(200))] == [0.0, 0.0188]
    for x in (0.0, 0.1, 1.0, 2.5, 5.9, 7.0):
        assert one(spark, stats.erf(F.lit(x))) == pytest.approx(math.erf(x), abs=1e-13)
    chi, p = stats.mcnemar(F.lit(4), F.lit(18))
    assert one(spark, chi) == pytest.approx(7.681818) and one(spark, p) == pytest.approx(0.0056, abs=1e-4)
    assert [one(spark, x) for x in stats.mcnemar(F.lit(0), F.lit(0))] == [0.0, 1.0]
    assert one(spark, stats.mcnemar(F.lit(5), F.lit(5))[0]) == pytest.approx(0.1)
    assert [one(spark, x) for x in stats.two_proportions(F.lit(1), F.lit(0), F.lit(1), F.lit(5))] == [0.0, 1.0]
    assert [one(spark, x) for x in stats.two_proportions(F.lit(5), F.lit(5), F.lit(5), F.lit(5))] == [0.0, 1.0]
    assert one(spark, stats.cohens_h(F.lit(0.87), F.lit(0.36))) == pytest.approx(1.1169, abs=1e-4)
    assert one(spark, stats.rounded(F.lit(0.10835), 4)) == 0.1084
    ps = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.04)], "k string, p double")
    assert {r.k: r.h for r in stats.holm(ps, "p", "h", ["k"]).collect()} == {"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.09}


# Texts and values


def test_texts(spark):
    df = spark.createDataFrame([(" N/A ",), ("None",), ("none",), ("",), (None,), (" a ",), ("\t'\"x\"' ",)], "t string")
    assert [r[0] for r in df.select(present("t")).collect()] == [None, None, "none", None, None, "a", "'\"x\"'"]
    values = [
        (text.slug(F.lit("A--b ç")), "a_b"), (text.slug(F.lit("--")), "unknown"), (text.slug(F.lit(None).cast("string")), "unknown"), (text.tag_part(F.lit("é x/")), "é_x"),
        (text.digits(F.lit("a1b2")), "12"), (text.digits(F.lit("")), "000000"), (text.match_form(F.lit("<b>Ação</b>  Größe\n")), "acao große"), (strip_quotes(F.lit("\"'x'\"")), "x"),
        (text.format_p(F.lit(0.00001)), "<0.0001"), (text.format_p(F.lit(0.5)), "0.5000"), (normalize.relative_path(F.lit("/x/data/y"), "data"), "data/y"), (normalize.relative_path(F.lit("/x"), "data"), "/x"),
        (normalize.source_type(F.lit("Dataset-IPS_x")), "IPS"), (normalize.source_type(F.lit("other")), "OTHER"), (F.array_join(normalize.csv_items(F.lit(" a, b,,a ")), "|"), "a|b"),
    ]
    for column, want in values:
        assert one(spark, column) == want
    assert one(spark, text.tokens(F.lit("The log_1 of 123 ab"), ["the"])) == ["log_1"]
    for raw, want in ((r"C:\Users", r"C:\\Users"), (r"a\\nb\q\u12x\u00e9", r"a\\nb\\q\\u12x\u00e9"), ("end\\", "end\\\\"), (r"\\\\q", r"\\\\q")):
        assert one(spark, records.repaired_json(F.lit(raw))) == want
    assert one(spark, records.readable_json(F.lit(r'{"a":"C:\Vault"}'))) == r'{"a":"C:\\Vault"}'
    assert one(spark, records.readable_json(F.lit("{cut"))) is None


# Runs


def test_run_rows_edges(spark, small):
    v = spark.read.parquet(f"{small}/verifier_output.parquet")
    rows = analysis.run_rows(v)
    assert rows.count() == v.select("run_id").distinct().count()
    assert rows.where("model_label is null or mode = 'humano' or latency_ms < 0 or cost_usd < 0").count() == 0
    empty = analysis.run_rows(v.limit(0))
    for op in (analysis.by_model, analysis.by_rule, analysis.by_rule_treatment, analysis.pairwise, analysis.latest_runs):
        assert op(empty).count() == 0
    assert analysis.summary(empty).first().run_violation_rate == 0.0
    nulls = v.limit(3).select("run_id", *[F.lit(None).cast(v.schema[c].dataType).alias(c) for c in v.columns if c != "run_id"])
    made = analysis.run_rows(nulls).first()
    assert (made.model_label, made.violation_count, made.jaccard_raw) == ("unknown", 0, 0.0)


def test_latest_and_first(spark):
    df = spark.createDataFrame([("i", "m", "t2", 1), ("i", "m", "t2", 0), ("i", "m", "t1", 5), ("j", "m", None, 7)], "incident_key string, model_label string, run_tag string, run_id bigint")
    assert {r.incident_key: r.run_id for r in analysis.latest_runs(df).collect()} == {"i": 0, "j": 7}
    assert {r.incident_key: r.run_id for r in analysis.first_per(df, ["incident_key"], ["run_id"]).collect()} == {"i": 0, "j": 7}


# Matching and audits


def test_matching_edges(spark):
    rules = [matching.TechniqueRule("R", "T1", "TA", ["a"], command=["x", "y"], weights=(0.9, 0.3, 0, 0), least=0.95)]
    rows = [(1, "AB", "X y", None, None), (2, None, None, None, None), (3, "a", None, None, None)]
    found = matching.candidates(spark.createDataFrame(rows, "event_id int, event_type string, command string, category string, source_type string"), rules)
    assert {r.event_id: (r.score, r.signals) for r in found.collect()} == {1: (1.0, ["event_type", "command:x", "command:y"]), 3: (0.9, ["event_type"])}
    assert [r.v for r in matching.matches(found).select(matching.evidence().alias("v")).collect()] == ["event_type, command:x, command:y | X y"]
    assert found.limit(0).count() == 0
    texts = spark.createDataFrame([(1, "k1 k2"), (2, "k1"), (3, None), (4, "k3 k4"), (5, "k3")], "i int, t string")
    trules = [matching.TextRule("one", ["k1"]), matching.TextRule("both", ["k1", "k2"], every=True), matching.TextRule("p", ["k3"], priority=1), matching.TextRule("q", ["k4"], priority=1)]
    got = {r.i: (r.verdict, r.action_id) for r in matching.ranked_rules(texts, "t", trules).collect()}
    assert got == {1: ("multi", "both"), 2: ("single", "one"), 3: ("zero", None), 4: ("ambiguous", None), 5: ("single", "p")}


def test_audits(spark):
    orders = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1), ("c", None), ("d", 2), ("d", 3)], "k string, o int")
    assert {r.k: r.valid for r in audit.contiguous_order(orders, "k", "o").collect()} == {"a": True, "b": False, "c": False, "d": False}
    docs = spark.createDataFrame([(1, "x a@b.org 10.255.0.1 8.8.8.8\nuser_1@masked.local a@b.org"), (2, None), (3, "")], "d int, t string")
    found = {(r.d, r.line_no, r.kind, r.value) for r in audit.personal_data(docs, "d", "t", terms=["ORG"]).collect()}
    assert found == {(1, 1, "email", "a@b.org"), (1, 1, "term", "ORG"), (1, 2, "term", "ORG")}
    seen = spark.createDataFrame([("i", 1, "x"), ("i", 2, "y"), ("i", 3, "x"), ("i", 4, None), ("j", 9, "y")], "k string, n int, v string")
    assert {(r.k, r.v): r.token for r in audit.first_seen_tokens(seen, "k", "n", "v").collect()} == {("i", "x"): 1, ("i", "y"): 2, ("j", "y"): 1}
    meta = spark.createDataFrame([("i", "low", 2, 1), ("j", "odd", None, 5)], "incident_id string, severity string, s bigint, e bigint")
    acts = spark.createDataFrame([("i", None)], "incident_id string, approval boolean")
    ev = spark.createDataFrame([("i",)], "incident_id string")
    got = {r.incident_id: r.issues for r in audit.incident_issues(meta, acts, ev, "s", "e").collect()}
    assert got == {"i": ["approval_missing", "window_reversed"], "j": ["no_events", "no_actions", "bad_severity", "no_window"]}


def test_masks(spark):
    rows = [(1, "i", "8.8.8.8 and 1.1.1.1, 8.8.8.81"), (2, "i", "1.1.1.1"), (3, "j", "1.1.1.1 9.9.9.9"), (4, None, "9.9.9.9"), (5, "i", None), (6, "i", "none"), (7, "i", "")]
    df = spark.createDataFrame(rows, "d int, k string, t string").withColumn("token", F.lit("clash"))
    got = {r.d: r.m for r in audit.mask_numbered(df, "d", "k", "d", "t", text.IPV4, "ip_", "m").collect()}
    assert got == {1: "ip_1 and ip_2, ip_3", 2: "ip_2", 3: "ip_1 ip_2", 4: "ip_1", 5: None, 6: "none", 7: ""}


def test_exports(spark):
    props = "struct<cs_severity:string,cs_hostname:string,cs_username:string,cs_command_line:string,cs_source_ip:string,status_do_incidente:string>"
    schema = f"incident_id string, incident_type_ids array<string>, severity_code string, resolution_id string, start_date bigint, inc_start bigint, end_date bigint, inc_last_modified_date bigint, discovered_date bigint, name string, description string, properties {props}, extracted_notes array<struct<id:int,text:string,create_date:bigint,user_name:string>>"
    rows = [
        ("a", ["Big Thing"], "HIGH", None, None, 1000, None, None, 5, "n", "", ("low", "h", "u", "", "", "Done!"), [(1, "<p> x </p>", 7, "w"), (2, "<br>", 8, "w"), (3, None, 9, None)]),
        ("b", None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    a, b = normalize.export_meta(df).orderBy("incident_id").collect()
    assert (a.incident_type, a.severity, a.time_window_start, a.time_window_end, a.final_status) == ("big_thing", "high", "1970-01-01T00:00:01.000Z", "1970-01-01T00:00:01.000Z", "done")
    assert (b.incident_type, b.severity, b.time_window_start, b.final_status) == ("suspicious_activity", "medium", None, "unknown")
    events = [(r.incident_id, r.line_no, r.event_type, r.category, r.command) for r in normalize.export_events(df).orderBy("incident_id", "line_no").collect()]
    assert events == [("a", 1, "command_execution_attempt", "n", None), ("a", 2, "case_note", "soar_note", "x"), ("b", 1, "command_execution_attempt", "detection", None)]
    flat = spark.createDataFrame([({"Event Name": " N/A ", "FortinetSeverity (custom)": '"high"', "Username": "null", "Account Name (custom)": "me"},), (None,)], "r map<string,string>")
    got = [(r.event_type, r.severity, r.username, r.source_type) for r in normalize.vendor_events(flat, "r", "X").collect()]
    assert got == [("unknown", "high", "me", "X"), ("unknown", None, None, "X")]


def test_stability(spark):
    slots = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, s int")
    spare = spark.createDataFrame([("a", 9), ("c", 4)], "k string, r int")
    assert [tuple(r) for r in stability.fill_slots(slots, spare, ["k"], ["s"], ["r"]).collect()] == [("a", 1, 9)]
    made = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 1.0)], "k string, v double")
    said = spark.createDataFrame([("a", 1.0005), ("b", 2.1), ("d", 1.0)], "k string, v double")
    assert {r.k: r.ok for r in stability.conformance(made, said, ["k"], "v", 0.001).collect()} == {"a": True, "b": False, "c": False, "d": False}


# Sources and sinks


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a":1}\n\n{broken\n{"a":2,"b":3}\n')
    rows = records.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()
    assert sorted((r.a or 0, r._corrupt) for r in rows) == [(0, "{broken"), (1, None), (2, None)]
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        records.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a int", strict=True).collect()
    (tmp_path / "d.json").write_text('[{"a":\n1},{"a":2}]')
    assert records.read_json_documents(spark, str(tmp_path / "d.json"), "a int").count() == 2
    (tmp_path / "r.json").write_text("")
    assert records.read_rules(str(tmp_path / "r.json")) == []
    (tmp_path / "r.json").write_text("[1]")
    with pytest.raises(ValueError, match="list of objects"):
        records.read_rules(str(tmp_path / "r.json"))
    df = spark.createDataFrame([(1, "x", "now"), (2, None, "now")], "a int, b string, generated_at_utc string")
    target = str(tmp_path / "out")
    assert sinks.write_if_changed(df, target)
    assert not sinks.write_if_changed(df.withColumn("generated_at_utc", F.lit("later")), target)
    assert sinks.write_if_changed(df.withColumn("a", F.col("a") + 1), target)
    sinks.write_csv(df, str(tmp_path / "csv"), ["b", "a"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["b", "a"]
    sinks.write_json_lines(df, str(tmp_path / "jl"))
    sinks.write_versioned(df, str(tmp_path / "v"), "1")
    assert spark.read.parquet(str(tmp_path / "v/canonical")).count() == 2
    assert sinks.rows_as_markdown(df.select("a", "b").collect(), ["a", "b"]).splitlines()[2:] == ["| 1 | x |", "| 2 |  |"]
    bundle = spark.createDataFrame(
        [([("t", "n1", None, None, [("s", "1")]), ("t", "n2", False, None, [("o", "9"), ("s", "1")]), ("t", "gone", True, None, [("s", "2")]), ("u", "x", None, None, [("s", "3")])],)],
        "objects array<struct<type:string,name:string,revoked:boolean,deprecated:boolean,external_references:array<struct<source_name:string,external_id:string>>>>",
    )
    assert [tuple(r) for r in records.active_objects(bundle, "t", "s").collect()] == [("1", "n2")]
    assert bounded_rows(df, 1) is None and len(bounded_rows(df, 2)) == 2
    assert cut(df).count() == 2 and shared_dir(spark)


# Streams


def test_session_stream(spark, tmp_path):
    from lakewarden.operators.sessions import sessionize

    rng = random.Random(4)
    minute = 60 * 10**6
    rows = [(i, rng.choice(["a", "b", "c"]), rng.randrange(0, 3000) * minute) for i in range(300)]
    rows += [(1000, "x", 0), (1001, "x", 30 * minute), (1002, "y", 0), (1003, "y", 30 * minute + 1), (1003, "y", 30 * minute + 1), (1004, None, 5), (1005, "a", None)]
    # A stream's watermark begins at 1970, so its events lie later.
    rows = [(i, who, us if us is None else us + 10**15) for i, who, us in rows]
    df = spark.createDataFrame(rows, "event_id bigint, who string, us bigint").withColumn("at", F.timestamp_micros("us"))
    for n, part in enumerate(df.randomSplit([0.5, 0.5], 1)):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    # An event far later closes all windows.
    spark.createDataFrame([(9999, "end", 10**15 + 10**7 * minute)], "event_id bigint, who string, us bigint").withColumn("at", F.timestamp_micros("us")).coalesce(1).write.parquet(str(tmp_path / "in" / "p2"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = session_stream(source, "who", "at", "event_id", late="60 days").writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.sql("SELECT who, start_us, end_us, event_count FROM found WHERE who <> 'end'").collect()}
    batch = sessionize(df.select("event_id", "who", "us").distinct(), "who", "us").drop("duration_us")
    assert got == {tuple(r) for r in batch.collect()}
    rules = [Rule("1", "mandatory", "a", scope={"event_type_contains": ["x"]})]
    static = spark.createDataFrame([("xx", None, None, None, None)], "event_type string, category string, command string, severity string, details_text string")
    assert scope_stream(static, rules).first().matched == ["1"]


def plain_form(t):
    t = " ".join(re.sub("<[^>]+>", " ", html.unescape(t)).lower().split())
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


def test_match_form_against_plain_python(spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    texts += ["Caf&eacute; &amp; Łódź Őrs", "&lt;b&gt; x", "½ ﬁn … №5 ™", "İstanbul\xa0 ẞ", "", None, "a < b > c", "plain  ASCII\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.match_form("t").alias("f")).collect()
    assert {r.i: r.f for r in rows} == {i: None if t is None else plain_form(t) for i, t in enumerate(texts)}


def plain_sanitized(rows, terms):
    """rows: (id, key, text) in order; the steps one after another over a key's texts, with names in order of first appearance."""
    names, out = defaultdict(dict), {}
    made = {"m": lambda n: f"user_{n:04d}@masked.local", "i": lambda n: f"10.255.{(n - 1) // 250 + 1}.{(n - 1) % 250 + 1}", "p": lambda n: f"<phone_{n:04d}>"}
    for i, key, t in sorted(rows):
        for term, instead in terms.items() if t is not None else ():
            t = re.sub(rf"\b{re.escape(term)}\b", instead, t, flags=re.I)
        out[i] = t
    for kind, pattern in (("m", text.EMAIL), ("i", text.IPV4), ("p", text.PHONE)):
        for i, key, _ in sorted(rows):
            own = names[(key if key is not None else f"row {i}"), kind]
            if out[i] is not None:
                out[i] = re.sub(pattern, lambda m, own=own, kind=kind: own.setdefault(m[0], made[kind](len(own) + 1)), out[i], flags=re.A)
    for i, t in out.items():
        if t is not None:
            out[i] = re.sub(text.POSIX_USER, r"\1user_home", re.sub(text.WINDOWS_USER, r"\1user_home", t))
    return out


def test_sanitize_against_plain_python(spark):
    rng = random.Random(4)
    pieces = ["a.b@x.org", "c@y.com", "8.8.8.8", "1.1.1.1", "+55 (11) 91234-5678", "4004 (11) 12345678", "call Acme now", "ACME", "acmeish", r"C:\Users\joe\x", "/home/ann/f /Users/Bo", "10.0.0.300", "$1 \\ 5", "", "1.2.3.4.5"]
    rows = [(i, rng.choice(["k1", "k2", None]), " ".join(rng.choices(pieces, k=rng.randrange(7)))) for i in range(120)] + [(900, "k1", None), (901, None, "8.8.8.8 8.8.8.8")]
    rows += [(1000 + i, "many", f"10.1.{i // 200}.{i % 200} 9.9.9.9") for i in range(600)]
    df = spark.createDataFrame(rows, "i int, k string, t string").repartition(5)
    got = {r.i: r.s for r in audit.sanitize(df, "i", "k", "i", "t", {"acme": "the firm"}, "s").collect()}
    assert got == plain_sanitized(rows, {"acme": "the firm"})
    assert got[901] == "10.255.1.1 10.255.1.1" and "10.255.3." in got[1500]
    tokens = audit.first_seen_tokens(spark.createDataFrame([("k", n, f"v{n * 7 % 50}") for n in range(500)], "k string, n bigint, v string"), "k", "n", "v", span=9)
    assert {(r.v, r.token) for r in tokens.collect()} == {(f"v{n * 7 % 50}", n + 1) for n in range(50)}


def test_sanitize_nested_values(spark):
    doc = '{"mail":"a@b.org","n":5,"list":[{"ip":"8.8.8.8","deep":{"er":["a@b.org and c@d.org"]}}]}'
    df = spark.createDataFrame([(1, doc), (2, '{"mail":"c@d.org"}')], "id bigint, doc string")
    rows = node_rows(df, "id", ["doc"]).withColumns({"k": F.lit("k"), "row": F.concat_ws("/", "owner_id", "group_path", "node_path")})
    rows = rows.withColumn("n", F.col("owner_id") * 10 + F.length("node_path"))
    got = {r.row: r.fields for r in audit.sanitize_values(rows, "row", "k", "n", {}).collect()}
    assert got == {
        "1/doc/": {"mail": "user_0001@masked.local", "n": "5"}, "1/doc.list[]/doc.list[0]": {"ip": "10.255.1.1"},
        "1/doc.list[].deep.er[]/doc.list[0].deep.er[0]": {"value": "user_0001@masked.local and user_0002@masked.local"}, "2/doc/": {"mail": "user_0002@masked.local"},
    }


def test_personal_data_kinds(spark):
    digest = "ab12345678901234567890123456789012"
    rows = [(1, "call +55 11 91234-5678 or <phone_0001>"), (2, f"sha256 {digest}"), (3, f"sum {digest}"), (4, "in /tmp/workbench of bigbank Bank.")]
    found = audit.personal_data(spark.createDataFrame(rows, "d int, t string"), "d", "t", terms=["bank"], markers=["workbench"], whole_words=True)
    got = {(r.d, r.kind, r.value) for r in found.collect()}
    assert got == {(1, "phone", "+55 11 91234-5678"), (3, "phone", re.search(text.PHONE, digest)[0]), (4, "term", "bank"), (4, "marker", "workbench")}


def test_records_without_a_key_all_stay(spark, small):
    from lakewarden.sources.tables import latest_copy

    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b"), (None, "c")], "k int, v string")
    assert sorted(str(r.k) for r in latest_copy(df, "k").collect()) == ["1", "None", "None", "None"]
    events = spark.read.parquet(f"{small}/telemetry.parquet").limit(50).withColumn("event_id", F.lit(None).cast("bigint"))
    assert normalize.event_rows(events).count() == 50


def test_a_cluster_has_to_name_the_shared_folder(monkeypatch):
    from lakewarden.sources import tables

    class Fake:
        master = "spark://there:7077"
        sparkContext = property(lambda self: self)
        _jsc = property(lambda self: self)

        def sc(self):
            return self

        def getCheckpointDir(self):
            return self

        def isDefined(self):
            return False

        def getConf(self):
            return {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_dir(Fake())


def test_files_against_a_manifest(spark, tmp_path):
    import hashlib

    for name in ("a", "b", "d"):
        (tmp_path / f"{name}.txt").write_text(name)
    files = spark.read.format("binaryFile").load(f"{tmp_path}/*.txt").select(F.regexp_extract("path", "[^/]+$", 0).alias("path"), "content")
    sums = [(f"{n}.txt", hashlib.sha256(n.encode()).hexdigest().upper()) for n in "abc"]
    told = spark.createDataFrame([sums[0], ("b.txt", "00"), sums[2]], "path string, sha256 string")
    got = {r.path: r.verdict for r in audit.verify_files(told, files).collect()}
    assert got == {"a.txt": "ok", "b.txt": "changed", "c.txt": "missing", "d.txt": "undeclared"}


def test_select_profiles(spark):
    registry = spark.createDataFrame([("n1", "d", True), ("n2", "d", False), ("d", "x", False)], "name string, deployment string, enabled boolean")
    assert {r.name for r in analysis.select_profiles(registry).collect()} == {"n1"}
    asked = spark.createDataFrame([("d",), ("n2",), ("free",)], "selector string")
    got = {r.selector: (r.name, r.deployment, r.ad_hoc) for r in analysis.select_profiles(registry, asked).collect()}
    assert got == {"d": ("d", "x", False), "n2": ("n2", "d", False), "free": ("free", "free", True)}


def test_parse_response(spark):
    rows = ["```json\n{\"a\": [\"x\"]}\n```", "no", "[1]", '{"b": 1}', '{"a": "x"}', '{"a": [" x ", "y", "x", 5, null, "q", "q"]}', None, "", '{"a": []}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = {r.i: tuple(r.p) for r in df.select("i", matching.parse_response("t", "a", ["x", "y"]).alias("p")).collect()}
    assert [got[i][0] for i in range(len(rows))] == ["fenced", "broken", "no_object", "no_key", "no_list", None, "broken", "broken", None]
    assert got[5][1:] == (["x", "y"], ["5", "None", "q", "q"]) and got[8][1:] == ([], [])
    loose = df.where("i = 0").select(matching.parse_response("t", "a", ["x"], fence_allowed=True).alias("p")).first().p
    assert tuple(loose) == (None, ["x"], [])


def test_outcomes_of_a_grid(spark):
    incidents = spark.createDataFrame([("i1",), ("i2",)], "incident_key string")
    runs = spark.createDataFrame([(1, "i1", "m", "z", "t1", 2), (2, "i1", "m", "z", "t2", 0), (3, "i2", "m", "z", None, 1), (4, "i2", None, "z", None, 1)], "run_id int, incident_key string, llm_deployment string, llm_arm string, run_tag string, llm_action_count int")
    got = {(r.incident_key, r.repeat): (r.run_id, r.error) for r in analysis.outcomes(analysis.grid(incidents, ["m"], ["z"], 2), runs).collect()}
    assert got == {("i1", 1): (1, None), ("i1", 2): (2, "empty_plan"), ("i2", 1): (3, None), ("i2", 2): (None, "missing")}

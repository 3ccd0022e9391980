"""Detection, flow, graph, mapping, diff, suggestion, report, dashboard and stream operators on small fixtures."""

import datetime as dt
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakesift import pipeline
from lakesift.config import Config, CustomSink, CustomType, PathRule, config_of, parse_frameworks, read_config
from lakesift.functions import lexing, names
from lakesift.plans import scan_queries
from lakesift.functions.globs import glob_regex
from lakesift.operators import baseline, dashboard, facts, flow, frameworks, graph, reports, suggest
from lakesift.rules.dictionary import CONFIDENCE_RANK, DICTIONARY
from lakesift.sources import files as src
from lakesift.operators.delivery import SeenState
from lakesift.rules import hints
from lakesift.rules.articles import ARTICLES
from lakesift.rules.frameworks import RULES
from lakesift.rules.literals import LITERALS, SAFE_NAMES
from lakesift.streaming.latest import daily_totals, distinct_deliveries, latest_documents, merge_subscriptions, scan_stream

TS = """import { apiKey } from './keys';
export const userEmail = 'someone@mail.org';
interface User { email: string; phone?: string }
function save(user: User) {
  console.log(user.email);
  db.save(user.phone);
  fetch('/x', { body: apiKey });
}
const telephone = 1;
const nothing = 2;
"""
KEYS = "export const apiKey = 'abcdef';\n"
PY = '''class A:
    def __init__(self, email):
        self.email = email
        logger.info("x %s", self.email)


def pay(card_number, count):
    requests.post("http://h", json={"ssn": card_number})
'''


def sources(spark, rows):
    return spark.createDataFrame(rows, "repository string, path string, language string, source string")


@pytest.fixture(scope="module")
def found(spark):
    rows = [("r", "src/user.ts", "typescript", TS), ("r", "src/keys.ts", "typescript", KEYS), ("r", "src/a.py", "python", PY), ("r", "src/empty.go", "go", ""), ("r", "n.java", "java", None)]
    return pipeline.scan(sources(spark, rows), ["repository"], Config(frameworks=["gdpr", "pci_dss"])).cache()


def test_scan_finds_and_flows(found):
    rows = {(r.path, r.location.line, r.pii_type): r for r in found.collect()}
    assert rows["src/user.ts", 5, "email"].data_flow.sink.kind == "log_output" or rows["src/user.ts", 5, "email"].data_flow is None
    assert ("src/user.ts", 2, "email") in rows and ("src/keys.ts", 1, "api_key") in rows
    assert not any(r.location.line == 9 for k, r in rows.items() if k[0] == "src/user.ts")  # telephone is a safe name
    assert ("src/a.py", 7, "credit_card") in rows and ("src/a.py", 8, "national_id") in rows
    crossed = [r for r in found.collect() if "->" in r.id]
    assert [(r.path, r.pii_type, r.data_flow.sink.kind) for r in crossed] == [("src/user.ts", "api_key", "third_party_api")]
    assert any(m.framework == "gdpr" and m.article == "Art.44" for m in crossed[0].framework_mappings)
    assert found.select("id").distinct().count() == found.count()


def test_scan_is_stable_under_order(spark):
    rows = [("r", f"f{i}.ts", "typescript", TS) for i in range(4)]
    a = pipeline.scan(sources(spark, rows), ["repository"]).select("id", "path", "pii_type")
    b = pipeline.scan(sources(spark, rows[::-1]), ["repository"]).select("id", "path", "pii_type")
    assert a.exceptAll(b).isEmpty() and a.count() == b.count()
    assert pipeline.scan(sources(spark, []), ["repository"]).count() == 0


def test_scan_rules(spark):
    config = Config(
        custom_types=[CustomType("badge", ["^nothing$"], "critical")], custom_sinks=[CustomSink(r"^db\.save$", "database", True)], allow=["console"],
        exceptions=[PathRule(["gen/**"], "skip"), PathRule(["src/**"], "reduce_severity", "low")],
    )
    rows = [("r", "gen/user.ts", "typescript", TS), ("r", "src/user.ts", "typescript", TS)]
    out = pipeline.scan(sources(spark, rows), ["repository"], config, cross_file=False).collect()
    assert {r.path for r in out} == {"src/user.ts"} and {r.severity for r in out} == {"low"}
    assert any(r.pii_type == "badge" for r in out) and not any("console" in r.code_snippet for r in out)


def model(name):
    best = None
    for t, _, _, patterns in DICTIONARY:
        for p, k in patterns:
            import re

            if re.search(p, name, re.I) and (best is None or CONFIDENCE_RANK[k] > CONFIDENCE_RANK[best[1]]):
                best = (t, k)
    return best


WORDS = st.lists(st.sampled_from("user email phone number id card token secret key name first_ last home addr zip code tax social ip gps lat health data x".split()), min_size=1, max_size=3).map("".join)


@settings(max_examples=4, deadline=None)
@given(st.lists(WORDS, min_size=20, max_size=40))
def test_dictionary_equals_model(spark_words):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        pytest.skip("no session")
    df = spark.createDataFrame([(w,) for w in spark_words], "name string")
    got = {r.name: (r.pii_type, r.confidence) for r in names.match_names(df, "name").collect()}
    assert got == {w: model(w) for w in spark_words if model(w)}


@pytest.mark.parametrize(
    ("text", "kind"),
    [("user@example.com", "email"), ("10.0.0.1", "ip_address"), ("999.999.999.999", None), ("4111111111111111", "credit_card"), ("1234 5678 9012", "my_number"), ("DE89370400440532013000", "iban"),
     ("a@b.co 10.0.0.1", "email"), ("", None), (None, None), ("1234567890", None)],
)
def test_literals(spark, text, kind):
    assert spark.createDataFrame([(text,)], "t string").select(names.literal_type(F.col("t"))).first()[0] == kind


@pytest.mark.parametrize(
    ("callee", "kind"),
    [("console.log", "log_output"), ("logger.info", "log_output"), ("print", "log_output"), ("db.query", "database"), ("list.add", "database"), ("fetchUser", "third_party_api"), ("axios.post", "third_party_api"),
     ("gotoPage", "third_party_api"), ("res.json", "response"), ("jsonify", None), ("utils.format", None), ("myFunc", None)],
)
def test_sinks(spark, callee, kind):
    assert spark.createDataFrame([(callee,)], "c string").select(names.sink_kind(F.col("c"))).first()[0] == kind


def test_custom_sinks_and_variables(spark):
    df = spark.createDataFrame([("audit.push", "user.email"), ("x.y", "const total = 3"), ("z", "plain"), ("z", None)], "c string, s string")
    kinds = df.select(names.sink_kind(F.col("c"), [CustomSink("^audit", "file_system")]), flow.variable_of(F.col("s"))).collect()
    assert [tuple(r) for r in kinds] == [("file_system", "email"), (None, "total"), (None, None), (None, None)]


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [("node_modules/**", "node_modules/a/b.js", True), ("**/*.test.ts", "a/b.test.ts", True), ("**/*.test.ts", "b.test.ts", True), ("*.min.js", "x/y.min.js", True), ("a/{b,c}.py", "a/c.py", True),
     ("a/?.py", "a/bb.py", False), ("dist/**", "src/dist/x", False), ("[ab].go", "a.go", True), ("[!ab].go", "a.go", False), ("a.b", "axb", False)],
)
def test_globs(glob, path, hit):
    import re

    assert bool(re.search(glob_regex(glob), path)) is hit


def test_exclude_takes_subtrees(spark):
    df = spark.createDataFrame([("build/x/y.ts",), ("src/build/y.ts",), ("a/test_x.py",)], "p string")
    assert [r[0] for r in df.select(src.excluded(F.col("p"), ["build", "**/test_*.py"])).collect()] == [True, False, True]


def test_discover(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.ts").write_text("const email = 1;")
    (tmp_path / "src/big.py").write_text("x" * 200)
    (tmp_path / "src/bad.js").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "src/c.txt").write_text("no")
    (tmp_path / "node_modules/d.ts").write_text("no")
    files, skipped = src.discover(spark, str(tmp_path), Config(max_file_size=100))
    assert [(r.path, r.language) for r in files.collect()] == [("src/a.ts", "typescript")]
    assert skipped.first()[0] == 2


def test_staged(spark):
    files = sources(spark, [("r", "a/b/c.ts", "typescript", ""), ("r", "xb/c.ts", "typescript", "")])
    assert [r.path for r in src.staged(files, spark.createDataFrame([("b/c.ts",), ("b/c.ts",)], "path string")).collect()] == ["a/b/c.ts"]


def test_config(tmp_path):
    assert parse_frameworks(["GDPR", "pci-dss", "pcidss", "nope"]) == ["gdpr", "pci_dss"]
    c = config_of({"frameworks": ["pci-dss"], "unknown": 1, "rules": {"custom_sinks": [{"pattern": "(", "kind": "log"}, {"pattern": "x", "kind": "db"}]}, "pii_types": {"custom": [{"name": "n", "patterns": ["("]}]}})
    assert c.frameworks == ["pci_dss"] and [s.kind for s in c.custom_sinks] == ["database"] and not c.custom_types
    (tmp_path / "c.yml").write_text("a: [")
    with pytest.warns(UserWarning):
        assert read_config(str(tmp_path / "c.yml")) == Config()
    assert read_config(str(tmp_path / "none.yml")) == Config()


@pytest.mark.parametrize("language", ["typescript", "javascript", "go", "java", "csharp", "python"])
@pytest.mark.parametrize("source", ["", "\n", "((((", '"open', "é日本 = `", "x" * 50_000, "}" * 20])
def test_lexing_never_fails(language, source):
    f = lexing.facts_of(source, language)
    assert len(f.warnings) <= lexing.MAX_FAULTS


def test_registered_scan_covers_every_file(spark, monkeypatch):
    big = "const email = user.email;\n" + "// padding\n" * 110_000
    rows = [(1, "r", "a.ts", big), (2, None, "b.ts", "const a = 1\n"), (3, None, "b.ts", "const b = 2\n"), (4, "r", "c.ts", "import { x } from './a'\n"), (5, "r", "c.ts", "let z\n")]
    stored = spark.createDataFrame(rows, "file_id bigint, repository string, path string, source string")
    monkeypatch.setattr(scan_queries, "table", lambda *_: stored)
    assert [(r.language, r.files) for r in scan_queries.facts_by_language(spark, "").collect()] == [("typescript", 4)]
    assert [(r.repository, r.importer, r.imported) for r in scan_queries.module_edges(spark, "").collect()] == [("r", "c.ts", "a.ts")]
    assert "a.ts" in {r.path for r in scan_queries.scan_parsed_files(spark, "").collect()}


def test_lexing_long_imports():
    names = [f"name{i}" for i in range(120)]
    f = lexing.facts_of("import {\n" + ",\n".join(names) + ",\n} from './x';\nimport e, {\n f as g }\n from\n './y'\nimport './z'\n", "typescript")
    assert [i["source"] for i in f.imports] == ["./x", "./y", "./z"]
    assert [s["imported"] for s in f.imports[0]["specifiers"]] == names
    cut = lexing.facts_of("import foo\nconst a = './no'\nimport b from './b'\nimport {\n type", "typescript")
    assert [i["source"] for i in cut.imports] == ["./b"]


def test_lexing_deep_truncated_calls():
    f = lexing.facts_of("".join(f"f{i}(a{i}, () => {{ " for i in range(12)) + "log(user.email", "typescript")
    args = {c["callee"]: c["argument_identifiers"] for c in f.calls}
    assert all(f"a{i}" in args[f"f{i}"] for i in range(12)) and args["log"]
    assert len(f.warnings) == lexing.MAX_FAULTS


@pytest.mark.parametrize(
    ("source", "line", "hint"),
    [("a\nlet f = x => [1;\n", 2, hints.ARROW), ("if (a) {\n f();\n", 1, hints.BRACKETS[0][2]), ("f(\n", 1, hints.BRACKETS[1][2]), ("f(a,\n b],\n)", 2, hints.BRACKETS[2][2]), ("}{\n{}}", 1, hints.OTHERWISE)],
)
def test_lexing_hints(source, line, hint):
    first = lexing.facts_of(source, "typescript").warnings[0]
    assert (first["line"], first["hint"]) == (line, hint)


def test_lexing_modules():
    f = lexing.facts_of("import d, { a as b } from './m';\nimport * as n from 'n';\nexport { x as y } from './z';\nexport default 1;\nexport class C {}\n", "typescript")
    assert [(i["source"], [(s["kind"], s["local"], s["imported"]) for s in i["specifiers"]]) for i in f.imports] == [("./m", [("default", "d", "default"), ("named", "b", "a")]), ("n", [("namespace", "n", "*")])]
    assert [(e["name"], e["kind"], e["reexport_source"]) for e in f.exports] == [("y", "re_export", "./z"), ("default", "default", None), ("C", "named", None)]
    g = lexing.facts_of('package p\nimport (\n  "a/b"\n  c "d"\n)\nfunc Do(in *X) { log.Printf("value", in.Email) }\n', "go")
    assert [i["specifiers"][0]["local"] for i in g.imports] == ["b", "c"] and [e["name"] for e in g.exports] == ["Do"]
    assert [(c["callee"], c["argument_identifiers"]) for c in g.calls] == [("log.Printf", ["in.Email", "Email"])]
    j = lexing.facts_of("import java.util.List;\npublic class A { void f() { store.save(u.getEmail()); } }", "java")
    assert "email" in [x["name"] for x in j.identifiers] and j.imports[0]["specifiers"][0]["local"] == "List" and j.exports[0]["name"] == "A"


def test_graph_reach_with_cycle_and_diamond(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "a"), ("x", "y"), ("y", "x"), ("p", "q"), ("p", "r"), ("q", "s"), ("r", "s"), ("p", "q")], "importer string, imported string")

    def reach(f, s):
        return sorted(r.node for r in f(e, spark.createDataFrame([(s,)], "start string"), []).collect())

    assert reach(graph.dependents, "b") == ["a", "c", "d"] and reach(graph.dependencies, "x") == ["x", "y"]
    assert reach(graph.dependencies, "p") == ["q", "r", "s"] and reach(graph.dependencies, "none") == []


def test_import_resolution(spark):
    rows = [("r", "src/a.ts", "typescript", "import x from './b';\nimport y from '../lib';\nimport z from 'react';\nimport w from './c.d';"), ("r", "src/b.tsx", "typescript", ""), ("r", "src/b.js", "javascript", ""),
            ("r", "lib/index.ts", "typescript", ""), ("other", "src/c.ts", "typescript", ""), ("r", "src/c.ts", "typescript", ""), ("r", "pkg/m.py", "python", "from .n import a\nfrom . import b\n"), ("r", "pkg/n.py", "python", "a = 1\n")]
    parsed = facts.extract(sources(spark, rows), ["repository"])
    got = sorted((r.importer, r.imported) for r in graph.edges(graph.resolved_imports(parsed, ["repository"]), ["repository"]).collect())
    assert ("src/a.ts", "src/b.tsx") in got and ("src/a.ts", "lib/index.ts") in got and ("src/a.ts", "src/c.ts") in got and ("pkg/m.py", "pkg/n.py") in got


def finding(i="1", file="a/b.ts", line=1, sev="high", kind=None, snippet="console.log(user.email)", t="email", conf="high", n=0):
    end = {"kind": kind, "label": "l", "location": None}
    return {
        "id": i, "severity": sev, "pii_type": t, "category": "c", "location": {"file": file, "line": line, "column": 1}, "code_snippet": snippet,
        "data_flow": {"source": end, "sink": end, "path": []} if kind else None, "framework_mappings": [{"framework": "gdpr", "article": f"A{k}", "title": "t", "risk_description": "", "recommendation": ""} for k in range(n)],
        "confidence": conf,
    }


def findings(spark, *rows):
    return spark.createDataFrame(list(rows), src.FINDING)


@pytest.mark.parametrize(
    ("old", "new", "want"),
    [
        ([finding()], [finding()], {"unchanged": 1}),
        ([], [finding()], {"added": 1}),
        ([finding()], [], {"removed": 1}),
        ([finding(line=1)], [finding(line=2)], {"modified": 1}),
        ([finding(sev="low")], [finding(sev="high")], {"modified": 1}),
        ([finding(t="phone")], [finding()], {"added": 1, "removed": 1}),
        ([finding()], [finding(kind="database")], {"added": 1, "removed": 1}),
        ([finding(file="a\\b.ts", snippet="x  y")], [finding(file="a/b.ts", snippet=" x y ")], {"unchanged": 1}),
        ([finding("1"), finding("2")], [finding("3")], {"unchanged": 1}),
        ([finding(n=1)], [finding(n=2)], {"modified": 1}),
        ([], [], {}),
    ],
)
def test_baseline_diff(spark, old, new, want):
    d = baseline.diff(findings(spark, *old), findings(spark, *new))
    got = {r.change: r.n for r in d.groupBy("change").agg(F.count("*").alias("n")).collect()}
    assert got == want
    s = baseline.summary(d).first()
    assert s.total_current == len(new) and (s.added, s.removed) == (want.get("added", 0), want.get("removed", 0))
    assert baseline.displayed(d).where("change = 'unchanged'").count() == 0
    assert baseline.in_order(d).count() == d.count()


@pytest.mark.parametrize(
    ("kind", "snippet", "want"),
    [
        ("log_output", "log(user.email, user.email)", "log(maskEmail(user.email), maskEmail(user.email))"),
        ("response", "res.json(email)", 'res.json("[REDACTED]")'),
        ("database", "db.save(u.userEmail)", "db.save(encrypt(u.userEmail))"),
        ("third_party_api", "  fetch(x)", "  // TODO: mask or remove email before sending to third-party API"),
        (None, "  f(x)", "  // TODO: review handling of email — ensure encryption at rest, minimize collection"),
    ],
)
def test_suggestions(spark, kind, snippet, want):
    s = suggest.suggest(findings(spark, finding(kind=kind, snippet=snippet))).first()
    assert s.replacement_line == want and s.unified_diff.startswith("--- a/a/b.ts\n+++ b/a/b.ts\n@@ -1,1 +1,1 @@\n-")


def test_suggestions_from_sources(spark):
    src_df = spark.createDataFrame([("a/b.ts", "x\n  log(me.email)\n")], "path string, source string")
    rows = findings(spark, finding(line=2, kind="log_output"), finding("2", line=9, kind="log_output", snippet=""), finding("3", line=1, kind="log_output", snippet=None))
    s = suggest.suggest(rows, src_df)
    assert {r.finding_id: r.original_line for r in s.collect()} == {"1": "  log(me.email)", "3": "x"}
    done = suggest.applied(src_df, s.where("finding_id = '1'")).first()
    assert done.source == "x\n  log(maskEmail(me.email))\n"


def test_reports(spark, found):
    assert "Art.44" in reports.markdown(found, "gdpr") and "&lt;" not in reports.html_report(found.limit(0), "gdpr")
    line = json.loads(reports.sarif_lines(findings(spark, finding())).first().result)
    assert line["level"] == "error" and line["locations"][0]["physicalLocation"]["region"]["startLine"] == 1
    p = reports.upload_payload(findings(spark, finding(), finding("2", sev="LOW", t="phone"))).first()
    assert (p.high, p.low, p.total, p.pii_type_summary) == (1, 1, 2, {"email": 1, "phone": 1})
    assert pipeline.fails(findings(spark, finding(sev="high"))) and not pipeline.fails(findings(spark, finding(sev="medium")))
    assert [r.id for r in pipeline.in_order(findings(spark, finding("b", file="a-b/x"), finding("a", file="a/x"), finding("c", sev="critical"))).collect()] == ["c", "a", "b"]
    assert reports.diagnostics(findings(spark, finding(sev=None))).first().level == "HINT"
    assert reports.table_rows(findings(spark, finding(file="x" * 60))).first().file == "..." + "x" * 35
    assert frameworks.article_table(spark).count() == 32


def test_buckets(spark):
    df = spark.createDataFrame([(v,) for v in (0, 5, 50, 100, 500, 1000, 9999, None)], "v int")
    got = [r[0] for r in df.select(reports.bucket(F.col("v"), [0, 10, 50, 100, 500, 1000], ["0", "1-10", "11-50", "51-100", "101-500", "501-1000", "1000+"])).collect()]
    assert got == ["0", "1-10", "11-50", "51-100", "101-500", "501-1000", "1000+", None]


def test_saved_scans_and_events(spark, tmp_path, monkeypatch):
    (tmp_path / "s.json").write_text(json.dumps({"findings": [finding(), finding("2") | {"pii_type": {"custom": "badge"}}], "metadata": {}}))
    assert [r.pii_type for r in src.saved_scan(spark, str(tmp_path / "s.json")).orderBy("id").collect()] == ["email", "badge"]
    (tmp_path / "e.jsonl").write_text('{"event":"a","properties":{"n":"1"}}\nnot json\n')
    assert [r.event for r in src.event_lines(spark, str(tmp_path / "e.jsonl")).collect()] == ["a"]
    reports.save_scan(findings(spark, finding()), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    many = findings(spark, *[finding(str(i), n=i % 3) for i in range(20)], finding("none", snippet=None))
    monkeypatch.setattr(reports, "SET_SIZE", 4)
    reports.save_scan(many, str(tmp_path / "many"), {"path": "p", "files_scanned": 3, "frameworks": ["gdpr", "ccpa"]})
    back = src.saved_scan(spark, str(tmp_path / "many"))
    assert sorted(map(str, back.collect())) == sorted(map(str, many.collect()))
    assert baseline.diff(many, back).where("change in ('added', 'removed')").count() == 0
    about = src.saved_metadata(spark, str(tmp_path / "many")).first()
    assert (about.path, about.files_scanned, about.frameworks, about.tool_version) == ("p", 3, ["gdpr", "ccpa"], None)
    reports.save_scan(many.limit(0), str(tmp_path / "none"))
    assert src.saved_scan(spark, str(tmp_path / "none")).count() == 0


def test_rule_counts():
    assert (len(DICTIONARY), sum(len(p) for *_, p in DICTIONARY), len(RULES), len(ARTICLES), len(LITERALS), len(SAFE_NAMES)) == (56, 112, 31, 32, 5, 34)


def test_dictionary_lookup_equals_patterns(spark):
    table = names.lookup([CustomType("badge", ["^x(y|z)?$", "badge.+no"])])
    assert len(table.patterns) == 4 and table.names["xz"][0] == "badge" and table.names["user_email"][3] == "high"
    assert names.spellings("^a.$") is None and names.spellings("^a|b$") is None and names.spellings("a") is None and names.spellings("^[ab]{2}$") == ["aa", "ab", "ba", "bb"]
    df = spark.createDataFrame([(x,) for x in ("xY", "theBadge_No", "EMAILS", "Telephone", "clientIP", None, "")], "name string")
    assert {r.name: r.pii_type for r in names.match_names(df, "name", [CustomType("badge", ["^x(y|z)?$", "badge.+no"])]).collect()} == {"xY": "badge", "theBadge_No": "badge", "EMAILS": "email", "clientIP": "ip_address"}


def test_signed_payloads(spark):
    import hashlib
    import hmac

    secret = "whsec_" + "k" * 80
    mac = hmac.new(secret.encode(), b'1000.{"a":1}', hashlib.sha256).hexdigest()
    rows = [('{"a":1}', f"t=1000,v1={mac}", True), ('{"a":1}', f"t=1000,v1={'0' * 64},v1={mac.upper()}", True), ('{"a":2}', f"t=1000,v1={mac}", False), ('{"a":1}', f"t=1,v1={mac}", False), ('{"a":1}', "v1=" + mac, False), (None, f"t=1000,v1={mac}", False), ("x", None, False)]
    df = spark.createDataFrame(rows, "p string, h string, want boolean")
    assert all(r.got == r.want for r in df.select("want", dashboard.signed(F.col("p"), F.col("h"), secret, F.lit(1100)).alias("got")).collect())


def test_owners_and_stored_findings(spark):
    t = dt.datetime(2025, 1, 1)
    users = spark.createDataFrame([("u1", "a", "owner", "x@y", t), ("u0", "a", "owner", "z@y", t + dt.timedelta(1)), ("u2", "a", "member", "m@y", t), ("u3", None, "owner", "n@y", t)], "id string, team_id string, role string, email string, created_at timestamp")
    teams = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [tuple(r) for r in dashboard.owners(teams, users).collect()] == [("a", "u1", "x@y")]
    row = reports.stored_findings(findings(spark, finding(kind="database", n=1)), F.lit("s"), F.lit(t)).first()
    assert json.loads(row.data_flow)["sink"]["kind"] == "database" and json.loads(row.framework_mappings)[0]["article"] == "A0" and (row.scan_id, row.file_path) == ("s", "a/b.ts")


def test_diff_and_suggestion_lines(spark):
    d = baseline.diff(findings(spark, finding(line=1)), findings(spark, finding(line=2), finding("2", t="phone")))
    assert {(r.change, r.changes) for r in reports.diff_rows(d).collect()} == {("modified", "line: 1 -> 2"), ("added", "")}
    assert {json.loads(r.entry)["kind"] for r in reports.diff_lines(d).collect()} == {"modified", "added"}
    line = reports.suggestion_lines(suggest.suggest(findings(spark, finding(kind="log_output")))).first()
    assert json.loads(line.suggestion)["replacement_line"].endswith("maskEmail(user.email))") and line.diff.startswith("--- a/")


def test_reach_too_long_is_an_error(spark):
    e = spark.createDataFrame([(str(i), str(i + 1)) for i in range(5)], "importer string, imported string")
    with pytest.raises(RuntimeError):
        graph.reach(e, spark.createDataFrame([("0",)], "start string"), "importer", "imported", [], max_rounds=3)


def test_message_streams(spark, tmp_path):
    schema = "delivery_no bigint, id string, event_type string, payload string, received_at timestamp"
    body = '{"object":{"id":"sub","customer":"c","status":"%s"}}'
    rows = [(1, "a", "x", body % "active", None), (2, "a ", "x", body % "canceled", None), (3, None, "x", None, None), (4, None, "x", None, None)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    state = SeenState(spark, str(tmp_path / "seen"), 4)
    kept = dashboard.Subscriptions(spark, str(tmp_path / "subs"))
    for late in (None, [(90, "a", "x", None, None), (5, "b", "x", body % "trialing", None)]):
        if late:
            spark.createDataFrame(late, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        distinct_deliveries(stream, state, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(120)
        merge_subscriptions(stream, kept, str(tmp_path / "c2")).awaitTermination(120)
    assert sorted(r.delivery_no for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3, 4, 5]
    assert [(r.subscription, r.status, r.delivery_no) for r in kept.current().collect()] == [("sub", "trialing", 5)] and kept.version() == 2


def test_latest_prefers_a_known_order(spark):
    df = spark.createDataFrame([("a", None, "x"), ("a", 1, "y"), ("b", None, "z")], "k string, n int, v string")
    assert sorted(r.v for r in dashboard.latest_by(df, "k", F.col("n")).collect()) == ["y", "z"]


def test_dashboard_edges(spark):
    empty = spark.createDataFrame([], "id string, team_id string, project_name string, created_at timestamp, received_at timestamp, findings_count int, critical_count int, high_count int, pii_type_summary string")
    for df in (dashboard.daily_trend(empty), dashboard.type_distribution(empty), dashboard.weekly_stats(empty), dashboard.top_projects(empty), reports.alerts(empty)):
        assert df.count() == 0
    t = dt.datetime(2025, 1, 6)
    rows = [("1", "a", "p", t, t, None, None, 1, '{"x": 2, "y": 5}'), ("2", "a", "p", t - dt.timedelta(days=7), t, 3, 0, 0, None), (None, None, None, None, None, None, None, None, None)]
    some = spark.createDataFrame(rows, empty.schema)
    assert [(r.findings, r.before, r.trend) for r in dashboard.weekly_stats(some).orderBy("week").collect()] == [(3, 0, "up"), (0, 3, "down")]
    assert [r.top_types for r in reports.alerts(some).collect()] == ["y,x"]
    stored = dashboard.stored_scan(spark.createDataFrame([(["a"], {"k": 1})], "frameworks array<string>, m map<string,int>")).first()
    assert stored.frameworks == '["a"]' and stored.m == '{"k":1}'


def test_streams(spark, tmp_path):
    docs = str(tmp_path / "docs")
    spark.createDataFrame([("u1", 1, "old"), ("u1", 2, "const email = 'a@mail.org';"), ("u2", 1, "x"), ("u2", 3, None)], "uri string, version bigint, text string").write.parquet(docs)
    assert sorted((r.uri, r.version) for r in latest_documents(spark.read.parquet(docs)).collect()) == [("u1", 2), ("u2", 3)]
    stream = spark.readStream.schema("uri string, version bigint, text string").parquet(docs)
    q = scan_stream(stream, lambda d: d.select("path", names.literal_type(F.col("source")).alias("t")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [(r.path, r.t) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("u1", "email")]
    t = dt.datetime(2025, 1, 1, 5)
    spark.createDataFrame([("1", t, 2), ("2", t + dt.timedelta(days=9), 1)], "id string, created_at timestamp, findings_count int").write.parquet(str(tmp_path / "scans"))
    daily = daily_totals(spark.readStream.schema("id string, created_at timestamp, findings_count int").parquet(str(tmp_path / "scans")))
    q = daily.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("daily").count() == 2


def test_command_line(spark, tmp_path, capsys):
    from lakesift.__main__ import main

    tree, old, new = tmp_path / "tree", str(tmp_path / "old"), str(tmp_path / "new")
    tree.mkdir()
    (tree / "a.ts").write_text("console.log(user.email);\n")
    assert main(["scan", str(tree), "--out", old]) == 1 and "email" in capsys.readouterr().out
    (tree / "b.ts").write_text("const gender = 1;\n")
    assert main(["scan", str(tree), "--out", new, "--baseline", old]) == 0 and "added" in capsys.readouterr().out
    assert main(["diff", old, new, "--json", str(tmp_path / "d")]) == 0 and "gender" in capsys.readouterr().out
    assert main(["report", new, "gdpr"]) == 0 and "GDPR report" in capsys.readouterr().out
    assert main(["suggest", new, str(tree), "--json", str(tmp_path / "s")]) == 0 and "maskEmail(user.email)" in capsys.readouterr().out
    assert spark.read.text(str(tmp_path / "d")).count() == 2 and spark.read.text(str(tmp_path / "s")).count() == 2

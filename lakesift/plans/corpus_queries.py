"""Queries of parsing, detection, flow and the module graph over the code base in ``corpus``; their SQL states the expected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift import pipeline
from lakesift.config import Config, config_of
from lakesift.operators import facts, graph, suggest
from lakesift.plans.corpus import FILES
from lakesift.runtime import file_system, fresh_path
from lakesift.sources.files import discover, event_lines

KEYS = ["repository"]


def _files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("shop", p, lang, s) for p, (lang, s) in FILES.items()], "repository string, path string, language string, source string")


def _facts(spark: SparkSession, kind: str) -> DataFrame:
    return facts.facts_table(facts.extract(_files(spark), KEYS), kind, KEYS).drop("repository")


def facts_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of every file, in order."""
    return _facts(spark, "identifiers").select("path", "ord", "name", "line", "column")


def facts_literals(spark: SparkSession, sf: str) -> DataFrame:
    """String literals of at least five bytes."""
    return _facts(spark, "literals").select("path", "value", "line", "column")


def facts_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls with the names among their arguments."""
    return _facts(spark, "calls").select("path", "callee", "line", "column", F.array_join("argument_identifiers", ",").alias("arguments"))


def facts_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Imports and what each brings in."""
    spec = F.transform("specifiers", lambda s: F.concat_ws(":", s["kind"], s["local"], s["imported"]))
    return _facts(spark, "imports").select("path", "source", "line", F.array_join(spec, " ").alias("specifiers"))


def facts_exports(spark: SparkSession, sf: str) -> DataFrame:
    """Exports of every file."""
    return _facts(spark, "exports").select("path", "name", "kind", "line", "reexport_source")


def facts_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """Files that do not parse, with the line of the first fault."""
    return _facts(spark, "warnings").groupBy("path").agg(F.min("line").alias("line"))


def _resolved(spark: SparkSession) -> DataFrame:
    return graph.resolved_imports(facts.extract(_files(spark), KEYS), KEYS)


def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Imports that resolve to files of the code base."""
    return graph.edges(_resolved(spark), KEYS).drop("repository")


def graph_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names each importer gets from the exports of another file."""
    parsed = facts.extract(_files(spark), KEYS)
    return graph.resolved_names(graph.resolved_imports(parsed, KEYS), graph.export_index(parsed, KEYS), KEYS).drop("repository")


def _starts(spark: SparkSession) -> DataFrame:
    return _files(spark).select("repository", F.col("path").alias("start"))


def graph_dependents(spark: SparkSession, sf: str) -> DataFrame:
    """Files that import each file, directly or through others."""
    return graph.dependents(graph.edges(_resolved(spark), KEYS), _starts(spark), KEYS).select("start", "node")


def graph_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """Files each file imports, directly or through others."""
    return graph.dependencies(graph.edges(_resolved(spark), KEYS), _starts(spark), KEYS).select("start", "node")


def _scan(spark: SparkSession) -> DataFrame:
    return pipeline.scan(_files(spark), KEYS, Config(frameworks=["gdpr"]))


def scan_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of the code base: place, type, confidence, snippet and sink."""
    return _scan(spark).select(
        "path", F.col("location.line").alias("line"), "pii_type", "confidence", F.col("data_flow.source.label").alias("variable"), F.col("data_flow.sink.label").alias("callee"),
        F.col("data_flow.sink.kind").alias("sink"), F.element_at(F.split("id", "->"), -1).startswith("PII-").alias("own"),
    )


def scan_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """Suggested lines for the findings of the code base whose data a log or a response takes out, from the sources."""
    rows = _scan(spark).where("data_flow.sink.kind in ('log_output', 'response') and id not like '%->%'")
    return suggest.suggest(rows, _files(spark).select("path", "source")).select("file", "line", "description", "replacement_line")


#: A configuration as a YAML file gives it: own types and sinks, an allowed sink, a skipped folder, a cap on severity, an allow list and an ignored type.
RULES = {
    "frameworks": ["GDPR"],
    "rules": {
        "allow_identifiers": ["hunter"],
        "custom_sinks": [{"pattern": "^store$", "kind": "file"}, {"pattern": "^console[.]", "kind": "log", "allowed": True}],
        "exceptions": [{"paths": ["go/**"], "action": "skip"}, {"paths": ["src/**"], "action": "reduce_severity", "max_severity": "low"}],
    },
    "pii_types": {"custom": [{"name": "badge", "patterns": ["^row$"], "severity": "critical"}], "ignore": ["salary"]},
}


def scan_with_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of the code base under a configuration."""
    found = pipeline.scan(_files(spark), KEYS, config_of(RULES), cross_file=False)
    return found.select("path", F.col("location.line").alias("line"), "pii_type", "severity", F.col("data_flow.sink.kind").alias("sink"))


def _write(spark: SparkSession, path: str, content: bytes) -> None:
    fs, hadoop_path = file_system(spark, path)
    out = fs.create(hadoop_path(path), True)
    out.write(bytearray(content))
    out.close()


def discovered_files(spark: SparkSession, sf: str) -> DataFrame:
    """The code base as a tree of files, with some that are excluded, too large, not UTF-8 or of no known language: what discovery finds, and how many it skips."""
    root = fresh_path(spark, "tree")
    for p, (_, source) in FILES.items():
        _write(spark, f"{root}/{p}", source.encode())
    for p, content in (("src/huge.ts", b"x" * 5000), ("src/latin.py", b"# caf\xe9\n"), ("src/web/routes.test.js", b"x"), ("lib/build/out.js", b"x"), ("build/out.js", b"x"), ("README.md", b"x"), ("src/UPPER.TS", b"y")):
        _write(spark, f"{root}/{p}", content)
    config = Config(languages=["typescript", "javascript", "python"], exclude=["build/**", "**/*.test.js"], include=["**/*.{ts,js,py,TS}"], max_file_size=4000)
    files, skipped = discover(spark, root, config)
    return files.select("path", "language", F.octet_length("source").alias("bytes")).crossJoin(F.broadcast(skipped))  # one row


def telemetry_events(spark: SparkSession, sf: str) -> DataFrame:
    """Event lines, of which some do not parse, with one property."""
    path = fresh_path(spark, "events")
    _write(spark, f"{path}/e.jsonl", b'{"event":"scan","session_id":"s1","timestamp":5,"properties":{"files":"3"}}\n{"event":"scan"\nnot json\n{"event":"report","properties":{}}\n')
    return event_lines(spark, path).select("event", "session_id", "timestamp", F.try_element_at("properties", F.lit("files")).alias("files"))


QUERIES = {
    f.__name__: f
    for f in (
        facts_names, facts_literals, facts_calls, facts_imports, facts_exports, facts_warnings, graph_edges, graph_names, graph_dependents, graph_dependencies, scan_corpus, scan_suggestions,
        scan_with_rules, discovered_files, telemetry_events,
    )
}


def _rows(columns: str, rows: str) -> str:
    quoted = ", ".join(f'"{c.strip()}"' for c in columns.split(","))
    return f"SELECT {quoted} FROM (VALUES {rows}) t({quoted})"


#: The rows that reading the files gives: each file's own, in order.
SQL = {
    "facts_names": _rows(
        "path, ord, name, line, column",
        r"""
        ('broken/half.ts', 0, 'email', 1, 7), ('broken/half.ts', 1, 'email', 1, 25),
        ('cs/Login.cs', 0, 'password', 5, 12), ('cs/Login.cs', 1, 'passport', 7, 23), ('cs/Login.cs', 2, 'token', 8, 13), ('cs/Login.cs', 3, 'Trim', 8, 30), ('cs/Login.cs', 4, 'WriteLine', 9, 17),
        ('go/main.go', 0, 'Email', 9, 2), ('go/main.go', 1, 'token', 10, 2), ('go/main.go', 2, 'guest', 13, 11), ('go/main.go', 3, 'passport', 13, 24), ('go/main.go', 4, 'address', 14, 2),
        ('go/main.go', 5, 'Email', 14, 19), ('go/main.go', 6, 'Println', 15, 6), ('go/main.go', 7, 'Write', 16, 7), ('go/main.go', 8, 'Email', 16, 19),
        ('jv/Order.java', 0, 'salary', 5, 20), ('jv/Order.java', 1, 'order', 7, 22), ('jv/Order.java', 2, 'count', 7, 33), ('jv/Order.java', 3, 'fullName', 8, 16),
        ('jv/Order.java', 4, 'fullName', 8, 33), ('jv/Order.java', 5, 'salary', 9, 37),
        ('py/people.py', 0, 'ssn', 6, 24), ('py/people.py', 1, 'email', 6, 32), ('py/people.py', 2, 'ssn', 7, 14), ('py/people.py', 3, 'info', 8, 13), ('py/people.py', 4, 'ssn', 8, 34),
        ('py/people.py', 5, '_hidden', 11, 1), ('py/people.py', 6, 'card_number', 12, 1), ('py/people.py', 7, 'total', 15, 9), ('py/people.py', 8, 'iban', 16, 12),
        ('py/tools.py', 0, 'text', 5, 10), ('py/tools.py', 1, 'row', 9, 10), ('py/tools.py', 2, 'post', 10, 14),
        ('src/model/user.ts', 0, 'id', 2, 28), ('src/model/user.ts', 1, 'email', 2, 40), ('src/model/user.ts', 2, 'phone', 2, 55), ('src/model/user.ts', 3, 'userEmail', 3, 14),
        ('src/model/user.ts', 4, 'id', 4, 26), ('src/model/user.ts', 5, 'row', 5, 9), ('src/model/user.ts', 6, 'query', 5, 18), ('src/model/user.ts', 7, 'apiKey', 9, 11),
        ('src/util/crypt.ts', 0, 'password', 2, 14), ('src/util/crypt.ts', 1, 'text', 3, 22),
        ('src/web/index.ts', 0, 'secret', 3, 19),
        ('src/web/routes.js', 0, 'phone', 5, 9), ('src/web/routes.js', 1, 'name', 5, 16), ('src/web/routes.js', 2, 'label', 5, 22), ('src/web/routes.js', 3, 'get', 6, 5),
        ('src/web/routes.js', 4, 'req', 6, 17), ('src/web/routes.js', 5, 'res', 6, 22), ('src/web/routes.js', 6, 'log', 7, 11), ('src/web/routes.js', 7, 'ip', 7, 25),
        ('src/web/routes.js', 8, 'json', 8, 7), ('src/web/routes.js', 9, 'body', 8, 14)""",
    ),
    "facts_literals": _rows(
        "path, value, line, column",
        r"""
        ('cs/Login.cs', 'secret-value', 5, 23),
        ('go/main.go', 'example/mailer', 5, 7), ('go/main.go', 'sent to', 15, 14),
        ('jv/Order.java', 'none-at-all', 5, 29),
        ('py/people.py', '4111111111111111', 12, 15), ('py/people.py', 'made %s', 8, 18),
        ('py/tools.py', 'http://h', 10, 19),
        ('src/model/user.ts', '../util/crypt', 1, 22), ('src/model/user.ts', 'k-000111', 9, 20), ('src/model/user.ts', 'nobody@mail.test', 3, 26), ('src/model/user.ts', 'select one', 5, 24),
        ('src/util/crypt.ts', '../model/user', 1, 19), ('src/util/crypt.ts', 'hunter-22', 2, 30),
        ('src/web/index.ts', '../util/crypt', 2, 26), ('src/web/index.ts', './routes', 1, 8), ('src/web/index.ts', '/login', 3, 7),
        ('src/web/routes.js', '../model/user', 1, 51), ('src/web/routes.js', '../util/crypt', 2, 24), ('src/web/routes.js', '../util/crypt', 4, 30), ('src/web/routes.js', 'express', 3, 21)""",
    ),
    "facts_calls": _rows(
        "path, callee, line, column, arguments",
        r"""
        ('broken/half.ts', 'read', 1, 15, 'user.email,email,f'),
        ('cs/Login.cs', 'Console.WriteLine', 9, 9, 'token'), ('cs/Login.cs', 'passport.Trim', 8, 21, ''),
        ('go/main.go', 'fmt.Println', 15, 2, 'address'), ('go/main.go', 'mail.Write', 16, 2, 'Guest,Email,passport'),
        ('jv/Order.java', 'logger.info', 9, 9, 'fullName,order.salary,salary'), ('jv/Order.java', 'order.getFullName', 8, 27, ''),
        ('py/people.py', 'log.info', 8, 9, 'self.ssn,ssn'), ('py/people.py', 'store', 16, 5, 'card_number'),
        ('py/tools.py', 'requests.post', 10, 5, 'row'), ('py/tools.py', 'text.lower', 6, 12, ''),
        ('src/model/user.ts', 'db.query', 5, 15, 'id'),
        ('src/util/crypt.ts', 'seal', 2, 25, ''),
        ('src/web/index.ts', 'fetch', 3, 1, 'secret,password'),
        ('src/web/routes.js', 'app.get', 6, 1, 'req,res,console.log,log,mail,req.ip,ip,res.json,json,body,phone'), ('src/web/routes.js', 'console.log', 7, 3, 'mail,req.ip,ip'),
        ('src/web/routes.js', 'loadUser', 5, 32, ''), ('src/web/routes.js', 'res.json', 8, 3, 'body,phone')""",
    ),
    "facts_imports": _rows(
        "path, source, line, specifiers",
        r"""
        ('cs/Login.cs', 'System', 1, 'namespace:System:*'), ('cs/Login.cs', 'System.Text.Json', 2, 'namespace:Json:*'),
        ('go/main.go', 'example/mailer', 5, 'namespace:mail:*'), ('go/main.go', 'fmt', 4, 'namespace:fmt:*'),
        ('jv/Order.java', 'java.util.List', 2, 'namespace:List:*'),
        ('py/people.py', '.tools', 1, 'named:mask:mask named:store:save'), ('py/people.py', 'logging', 2, 'namespace:log:*'),
        ('py/tools.py', '.', 1, 'named:people:people'), ('py/tools.py', 'os.path', 2, 'namespace:*:*'),
        ('src/model/user.ts', '../util/crypt', 1, 'named:seal:seal'),
        ('src/util/crypt.ts', '../model/user', 1, 'default:Store:default'),
        ('src/web/index.ts', '../util/crypt', 2, 'named:password:password'), ('src/web/index.ts', './routes', 1, ''),
        ('src/web/routes.js', '../model/user', 1, 'default:Base:default named:mail:userEmail named:loadUser:loadUser'), ('src/web/routes.js', '../util/crypt', 2, 'namespace:crypt:*'),
        ('src/web/routes.js', 'express', 3, 'default:express:default')""",
    ),
    "facts_exports": _rows(
        "path, name, kind, line, reexport_source",
        r"""
        ('cs/Login.cs', 'Login', 'named', 4, NULL),
        ('go/main.go', 'Guest', 'named', 8, NULL), ('go/main.go', 'Send', 'named', 13, NULL),
        ('jv/Order.java', 'Order', 'named', 4, NULL),
        ('py/people.py', 'Person', 'named', 5, NULL), ('py/people.py', 'card_number', 'named', 12, NULL), ('py/people.py', 'pay', 'named', 15, NULL),
        ('py/tools.py', 'mask', 'named', 5, NULL), ('py/tools.py', 'save', 'named', 9, NULL),
        ('src/model/user.ts', 'default', 'default', 8, NULL), ('src/model/user.ts', 'loadUser', 'named', 4, NULL), ('src/model/user.ts', 'userEmail', 'named', 3, NULL),
        ('src/util/crypt.ts', 'password', 'named', 2, NULL), ('src/util/crypt.ts', 'seal', 'named', 3, NULL),
        ('src/web/routes.js', 'lock', 're_export', 4, '../util/crypt')""",
    ),
    "facts_warnings": _rows(
        "path, line",
        r"""
        ('broken/half.py', 1),
        ('broken/half.ts', 1)""",
    ),
    "graph_edges": _rows(
        "importer, imported",
        r"""
        ('py/people.py', 'py/tools.py'),
        ('src/model/user.ts', 'src/util/crypt.ts'),
        ('src/util/crypt.ts', 'src/model/user.ts'),
        ('src/web/index.ts', 'src/util/crypt.ts'), ('src/web/index.ts', 'src/web/routes.js'),
        ('src/web/routes.js', 'src/model/user.ts'), ('src/web/routes.js', 'src/util/crypt.ts')""",
    ),
    "graph_names": _rows(
        "importer, imported, local, exported",
        r"""
        ('py/people.py', 'py/tools.py', 'mask', 'mask'), ('py/people.py', 'py/tools.py', 'store', 'save'),
        ('src/model/user.ts', 'src/util/crypt.ts', 'seal', 'seal'),
        ('src/util/crypt.ts', 'src/model/user.ts', 'Store', 'default'),
        ('src/web/index.ts', 'src/util/crypt.ts', 'password', 'password'),
        ('src/web/routes.js', 'src/model/user.ts', 'Base', 'default'), ('src/web/routes.js', 'src/model/user.ts', 'loadUser', 'loadUser'),
        ('src/web/routes.js', 'src/model/user.ts', 'mail', 'userEmail'), ('src/web/routes.js', 'src/util/crypt.ts', 'crypt', '*')""",
    ),
    "graph_dependents": _rows(
        "start, node",
        r"""
        ('py/tools.py', 'py/people.py'),
        ('src/model/user.ts', 'src/model/user.ts'), ('src/model/user.ts', 'src/util/crypt.ts'), ('src/model/user.ts', 'src/web/index.ts'), ('src/model/user.ts', 'src/web/routes.js'),
        ('src/util/crypt.ts', 'src/model/user.ts'), ('src/util/crypt.ts', 'src/util/crypt.ts'), ('src/util/crypt.ts', 'src/web/index.ts'), ('src/util/crypt.ts', 'src/web/routes.js'),
        ('src/web/routes.js', 'src/web/index.ts')""",
    ),
    "graph_dependencies": _rows(
        "start, node",
        r"""
        ('py/people.py', 'py/tools.py'),
        ('src/model/user.ts', 'src/model/user.ts'), ('src/model/user.ts', 'src/util/crypt.ts'),
        ('src/util/crypt.ts', 'src/model/user.ts'), ('src/util/crypt.ts', 'src/util/crypt.ts'),
        ('src/web/index.ts', 'src/model/user.ts'), ('src/web/index.ts', 'src/util/crypt.ts'), ('src/web/index.ts', 'src/web/routes.js'),
        ('src/web/routes.js', 'src/model/user.ts'), ('src/web/routes.js', 'src/util/crypt.ts')""",
    ),
    "scan_corpus": _rows(
        "path, line, pii_type, confidence, variable, callee, sink, own",
        r"""
        ('broken/half.ts', 1, 'email', 'high', NULL, NULL, NULL, true),
        ('cs/Login.cs', 5, 'password', 'high', NULL, NULL, NULL, true), ('cs/Login.cs', 7, 'passport_number', 'high', NULL, NULL, NULL, true),
        ('cs/Login.cs', 8, 'auth_token', 'high', NULL, NULL, NULL, true),
        ('go/main.go', 9, 'email', 'high', NULL, NULL, NULL, true), ('go/main.go', 10, 'auth_token', 'high', NULL, NULL, NULL, true),
        ('go/main.go', 13, 'passport_number', 'high', NULL, NULL, NULL, true), ('go/main.go', 14, 'address', 'high', NULL, NULL, NULL, true),
        ('go/main.go', 14, 'email', 'high', NULL, NULL, NULL, true), ('go/main.go', 16, 'email', 'high', NULL, NULL, NULL, true),
        ('jv/Order.java', 5, 'salary', 'high', 'salary', 'logger.info', 'log_output', true), ('jv/Order.java', 8, 'full_name', 'high', NULL, NULL, NULL, true),
        ('jv/Order.java', 9, 'salary', 'high', 'info', 'logger.info', 'log_output', true),
        ('py/people.py', 6, 'email', 'high', NULL, NULL, NULL, true), ('py/people.py', 6, 'national_id', 'high', NULL, NULL, NULL, true),
        ('py/people.py', 7, 'national_id', 'high', 'ssn', 'log.info', 'log_output', true), ('py/people.py', 8, 'national_id', 'high', 'info', 'log.info', 'log_output', true),
        ('py/people.py', 12, 'credit_card', 'high', NULL, NULL, NULL, true), ('py/people.py', 16, 'iban', 'high', NULL, NULL, NULL, true),
        ('src/model/user.ts', 2, 'email', 'high', NULL, NULL, NULL, true), ('src/model/user.ts', 2, 'phone_number', 'high', NULL, NULL, NULL, true),
        ('src/model/user.ts', 3, 'email', 'high', NULL, NULL, NULL, true), ('src/model/user.ts', 9, 'api_key', 'high', NULL, NULL, NULL, true),
        ('src/util/crypt.ts', 2, 'password', 'high', NULL, NULL, NULL, true),
        ('src/web/index.ts', 3, 'password', 'high', 'password (from src/util/crypt.ts)', 'fetch', 'third_party_api', false), ('src/web/index.ts', 3, 'password', 'high', NULL, NULL, NULL, true),
        ('src/web/routes.js', 5, 'full_name', 'low', NULL, NULL, NULL, true), ('src/web/routes.js', 5, 'phone_number', 'high', NULL, NULL, NULL, true),
        ('src/web/routes.js', 7, 'email', 'high', 'mail (from src/model/user.ts)', 'console.log', 'log_output', false),
        ('src/web/routes.js', 7, 'ip_address', 'high', 'log', 'console.log', 'log_output', true)""",
    ),
    "scan_suggestions": _rows(
        "file, line, description, replacement_line",
        r"""
        ('jv/Order.java', 5, 'Mask salary before logging to prevent PII leakage', '    private String maskPii(salary) = "none-at-all";'),
        ('jv/Order.java', 9, 'Mask salary before logging to prevent PII leakage', '        logger.info(fullName, maskPii(order.salary));'),
        ('py/people.py', 7, 'Mask national_id before logging to prevent PII leakage', '        // TODO: mask PII (national_id) before logging'),
        ('py/people.py', 8, 'Mask national_id before logging to prevent PII leakage', '        // TODO: mask PII (national_id) before logging'),
        ('src/web/routes.js', 7, 'Mask ip_address before logging to prevent PII leakage', '  // TODO: mask PII (ip_address) before logging')""",
    ),
    "scan_with_rules": _rows(
        "path, line, pii_type, severity, sink",
        r"""
        ('broken/half.ts', 1, 'email', 'high', NULL),
        ('cs/Login.cs', 5, 'password', 'critical', NULL), ('cs/Login.cs', 7, 'passport_number', 'critical', NULL), ('cs/Login.cs', 8, 'auth_token', 'critical', NULL),
        ('jv/Order.java', 8, 'full_name', 'high', NULL),
        ('py/people.py', 6, 'email', 'high', NULL), ('py/people.py', 6, 'national_id', 'critical', NULL), ('py/people.py', 7, 'national_id', 'critical', 'log_output'),
        ('py/people.py', 8, 'national_id', 'critical', 'log_output'), ('py/people.py', 12, 'credit_card', 'critical', 'file_system'), ('py/people.py', 16, 'iban', 'critical', NULL),
        ('py/tools.py', 9, 'badge', 'critical', NULL),
        ('src/model/user.ts', 2, 'email', 'low', NULL), ('src/model/user.ts', 2, 'phone_number', 'low', NULL), ('src/model/user.ts', 3, 'email', 'low', NULL), ('src/model/user.ts', 5, 'badge', 'low', 'database'),
        ('src/model/user.ts', 9, 'api_key', 'low', NULL),
        ('src/web/index.ts', 3, 'password', 'low', NULL),
        ('src/web/routes.js', 5, 'full_name', 'low', NULL), ('src/web/routes.js', 5, 'phone_number', 'low', NULL)""",
    ),
    "discovered_files": _rows(
        "path, language, bytes, files_skipped",
        r"""
        ('broken/half.py', 'python', 21, 2),
        ('broken/half.ts', 'typescript', 45, 2),
        ('lib/build/out.js', 'javascript', 1, 2),
        ('py/people.py', 'python', 280, 2),
        ('py/tools.py', 'python', 142, 2),
        ('src/model/user.ts', 'typescript', 322, 2),
        ('src/util/crypt.ts', 'typescript', 132, 2),
        ('src/web/index.ts', 'typescript', 100, 2),
        ('src/web/routes.js', 'javascript', 321, 2)""",
    ),
    "telemetry_events": _rows(
        "event, session_id, timestamp, files",
        r"""
        ('report', NULL, NULL, NULL),
        ('scan', 's1', 5, '3')""",
    ),
}

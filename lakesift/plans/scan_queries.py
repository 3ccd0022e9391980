"""Queries of detection, flow, mapping, diff, suggestion and report operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift import pipeline
from lakesift.config import DEFAULT_EXCLUDE, Config, PathRule
from lakesift.functions import names
from lakesift.functions.globs import glob_regex
from lakesift.operators import baseline, detect, facts, flow, frameworks, graph, reports, suggest
from lakesift.rules.articles import ARTICLES
from lakesift.rules.dictionary import SEVERITY_RANK
from lakesift.rules.frameworks import FRAMEWORKS, GROUPS, RULES
from lakesift.rules.literals import LITERALS, SAFE_NAMES, TEST_CONTEXT
from lakesift.rules.sinks import DATABASE_ENDS, HTTP_STARTS, LOG_CALLS, LOG_ENDS, MASKS, RESPONSE_ENDS, RESPONSE_HOLDERS
from lakesift.runtime import fresh_path, materialise, table
from lakesift.sources.files import any_glob, excluded, saved_metadata, saved_scan, staged, table_files

def lit_doc_first_type(spark: SparkSession, sf: str) -> DataFrame:
    """The first literal type of every document that has one."""
    return table(spark, sf, "documents").select("doc_id", names.literal_type(F.col("text")).alias("pii_type")).where("pii_type is not null")


def lit_line_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Literal findings by document and line, each type once per line."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), names.literal_type(F.col("line")).alias("pii_type")).where("pii_type is not null")


def lit_lang_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a literal by language and type, with subtotals."""
    rows = table(spark, sf, "documents").select(F.lower("lang").alias("lang"), names.literal_type(F.col("text")).alias("pii_type")).where("pii_type is not null")
    return rows.rollup("lang", "pii_type").agg(F.count("*").alias("n"))


def dict_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of stored snippets that the dictionary knows, with how often they stand there."""
    words = table(spark, sf, "scan_findings").select(F.explode(F.regexp_extract_all("code_snippet", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))).alias("name"))
    counted = words.groupBy("name").agg(F.count("*").alias("n"))
    return names.match_names(counted, "name").select("name", "n", "pii_type", "category", "severity", "confidence")


def context_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Stored findings by whether their path is a test's and their line an example's."""
    rows = table(spark, sf, "scan_findings").where("code_snippet is not null")
    return rows.groupBy(names.in_test_context(F.col("file_path")).alias("in_test"), names.in_example_context(F.col("code_snippet")).alias("in_example")).agg(F.count("*").alias("n"))


def allow_ignore_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Stored findings after an allow list, ignored types and severity rules."""
    config = Config(
        allow=["analytics", "TODO"], ignore_types=["gender"],
        exceptions=[PathRule(["lib/**"], "reduce_severity", "medium"), PathRule(["services/*/load_*"], "suppress_low")],
    )
    rows = table(spark, sf, "scan_findings").where("code_snippet is not null").withColumnRenamed("file_path", "path")
    return detect.apply_rules(rows, config).groupBy("pii_type", "severity").agg(F.count("*").alias("n"))


def glob_exclude(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed files by whether the default exclude globs take them out."""
    path = F.regexp_replace(F.translate("path", "\\", "/"), r"^(?:\./)+", "")
    return table(spark, sf, "parsed_files").groupBy(excluded(path, DEFAULT_EXCLUDE).alias("excluded"), any_glob(path, ["**/*.{ts,tsx,mts}"]).alias("typescript")).agg(F.count("*").alias("n"))


def staged_files(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed files whose path is, or ends in, the path of a saved finding."""
    files = table(spark, sf, "parsed_files").select("file_id", F.regexp_replace(F.translate("path", "\\", "/"), r"^(?:\./)+", "").alias("path"))
    changed = table(spark, sf, "findings").select(F.col("location.file").alias("path")).where("path is not null")
    return staged(files, changed).select("file_id", "path")


def flow_variables(spark: SparkSession, sf: str) -> DataFrame:
    """Variables that stored snippets are about."""
    return table(spark, sf, "scan_findings").select(flow.variable_of(F.col("code_snippet")).alias("variable")).where("variable is not null").groupBy("variable").agg(F.count("*").alias("n"))


def sink_classify(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of stored snippets by where they take data; each distinct callee is judged once."""
    calls = table(spark, sf, "scan_findings").select(F.explode(F.regexp_extract_all("code_snippet", F.lit(r"([A-Za-z_][A-Za-z0-9_.]*)\("), F.lit(1))).alias("callee"))
    return calls.groupBy("callee").agg(F.count("*").alias("n")).withColumn("kind", names.sink_kind(F.col("callee"))).where("kind is not null")


def _mapped(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "findings").select("id", "severity", "pii_type", "data_flow")
    return frameworks.with_mappings(rows, FRAMEWORKS)


def fw_mapping_explode(spark: SparkSession, sf: str) -> DataFrame:
    """Number of saved findings each rule of each framework maps."""
    return _mapped(spark, sf).select(F.explode("framework_mappings").alias("m")).groupBy("m.framework", "m.article", "m.title").agg(F.count("*").alias("n"))


def fw_article_report(spark: SparkSession, sf: str) -> DataFrame:
    """Report rows of every framework."""
    mapped = materialise(_mapped(spark, sf), "mapped")
    parts = [frameworks.article_report(mapped, f).withColumn("framework", F.lit(f)) for f in FRAMEWORKS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def article_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Every described article with the number of saved findings mapped to it."""
    mapped = _mapped(spark, sf).select(F.explode("framework_mappings").alias("m")).groupBy("m.framework", "m.article").agg(F.count("*").alias("n"))
    return frameworks.article_table(spark).join(mapped, ["framework", "article"], "left").select("framework", "article", "title", "description", F.coalesce("n", F.lit(0)).alias("n"))


def severity_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Stored findings of each severity by type."""
    return reports.severity_summary(table(spark, sf, "scan_findings"), "pii_type")


def failon_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Scans whose stored findings reach critical."""
    return pipeline.gate(table(spark, sf, "scan_findings"), "critical", "scan_id")


def first_per_line(spark: SparkSession, sf: str) -> DataFrame:
    """One stored finding per scan, file, line and type: that with the smallest id."""
    rows = table(spark, sf, "scan_findings").select("scan_id", F.col("file_path").alias("path"), "line", "pii_type", "id", F.lit(0).alias("detector"), F.col("id").alias("ord"), F.lit(1).alias("column"))
    return detect.once_per_line(rows, ["scan_id"]).select("scan_id", "path", "line", "pii_type", "id")


def worst_findings(spark: SparkSession, sf: str) -> DataFrame:
    """The first fifty saved findings of at least medium severity as they are shown (a top-n report)."""
    return pipeline.in_order(pipeline.shown(table(spark, sf, "findings"), "medium")).limit(50).select("id", "location.file", "location.line", F.lower("severity").alias("severity"))


def shown_table(spark: SparkSession, sf: str) -> DataFrame:
    """Saved findings as the terminal table shows them, with the number of articles."""
    rows = reports.table_rows(table(spark, sf, "findings"))
    return rows.select("id", "severity", "pii_type", "file", "line", F.size(F.filter(F.split("articles", ", "), lambda a: a != "")).alias("articles"))


def diff_shown(spark: SparkSession, sf: str) -> DataFrame:
    """The first fifty entries of the diff of the two scans as they are shown (a top-n report)."""
    old, new = _two_scans(spark, sf)
    entries = baseline.in_order(baseline.displayed(baseline.diff(old, new, F.col("id")))).limit(50)
    return reports.diff_rows(entries).select("change", "id", "pii_type", "changes")


def saved_and_read(spark: SparkSession, sf: str) -> DataFrame:
    """Saved findings, written as a saved scan with what it says of itself and read again, by type and framework."""
    path = fresh_path(spark, "saved-scan")
    reports.save_scan(table(spark, sf, "findings"), path, {"path": "/src", "files_scanned": 7, "frameworks": ["gdpr"]})
    back = saved_scan(spark, path)
    per = back.groupBy("pii_type", "severity").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size("framework_mappings"), F.lit(0))).alias("mappings"), F.count("data_flow.sink.kind").alias("sinks"))
    return per.crossJoin(F.broadcast(saved_metadata(spark, path).select("files_scanned")))  # one row


def upload_totals(spark: SparkSession, sf: str) -> DataFrame:
    """What an upload of the saved findings says: counts by severity and the types."""
    return reports.upload_payload(table(spark, sf, "findings")).select(*reports.LEVELS, "total", F.explode("pii_type_summary").alias("pii_type", "n"))


def quick_fixes(spark: SparkSession, sf: str) -> DataFrame:
    """Editor diagnostics of the saved findings by level and title of their quick fix."""
    rows = table(spark, sf, "findings").where("id is not null").dropDuplicates(["id"])
    return reports.diagnostics(rows).groupBy("level", "quick_fix").agg(F.count("*").alias("n"))


def order_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Saved findings with the keys they are shown by."""
    rows = pipeline.shown(table(spark, sf, "findings"))
    return rows.select("id", names.rank(F.col("severity"), SEVERITY_RANK).alias("severity_rank"), F.array_join(F.split("location.file", "/"), "|").alias("parts"), F.col("location.line").alias("line"))


def _two_scans(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "findings").where("id is not null").dropDuplicates(["id"])
    capped = F.when(F.lower("severity") == "critical", "high").otherwise(F.lower("severity"))
    old = rows.where("coalesce(confidence, '') <> 'low'").withColumn("severity", F.lower("severity"))
    return old, rows.where("coalesce(severity, '') <> 'low'").withColumn("severity", capped)


def diff_two_scans(spark: SparkSession, sf: str) -> DataFrame:
    """Saved findings of low confidence come, of low severity go, and critical ones become high: the diff by kind and id."""
    old, new = _two_scans(spark, sf)
    d = baseline.diff(old, new, F.col("id"))
    return d.select("change", F.col("finding.id").alias("id"), F.array_join(F.transform("changes", lambda c: c["field"]), ",").alias("fields"))


def diff_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the same diff."""
    old, new = _two_scans(spark, sf)
    return baseline.summary(baseline.diff(old, new, F.col("id")))


def type_map(spark: SparkSession, sf: str) -> DataFrame:
    """Stored findings by type."""
    return reports.type_counts(table(spark, sf, "scan_findings"))


def suggest_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Suggestions for saved findings, each id once."""
    rows = table(spark, sf, "findings").dropDuplicates(["id"])
    return suggest.suggest(rows).select("finding_id", "description", "replacement_line", F.sha2("unified_diff", 256).alias("diff_hash"))


def sarif_levels(spark: SparkSession, sf: str) -> DataFrame:
    """SARIF results by rule and level."""
    return reports.sarif_results(table(spark, sf, "findings")).groupBy("rule_id", "level").agg(F.count("*").alias("n"))


#: Marks the key of a file that has no repository: the file itself stands for one.
ALONE = "\0"


def _files(spark: SparkSession, sf: str) -> DataFrame:
    owner = F.coalesce("repository", F.concat(F.lit(ALONE), F.col("file_id").cast("string")))
    rows = table_files(table(spark, sf, "parsed_files")).withColumn("repository", owner)
    first = F.min_by(F.struct("language", "source"), "file_id").alias("r")
    return rows.groupBy("repository", "path").agg(first).select("repository", "path", "r.*")


def _shown_owner(rows: DataFrame) -> DataFrame:
    return rows.withColumn("repository", F.when(F.col("repository").startswith(ALONE), "").otherwise(F.col("repository")))


def facts_by_language(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of parsed files by language."""
    parsed = facts.extract(_files(spark, sf), ["repository"])
    return parsed.groupBy("language").agg(F.count("*").alias("files"), *[F.sum(F.size(k)).alias(k) for k in facts.FACTS])


def scan_parsed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of a whole scan of the parsed files, all frameworks, across files."""
    found = pipeline.shown(pipeline.scan(_files(spark, sf), ["repository"], Config(frameworks=list(FRAMEWORKS))))
    return _shown_owner(found).select("id", "repository", "path", "severity", "pii_type", "confidence", F.col("location.line").alias("line"), F.col("data_flow.sink.kind").alias("sink"), F.size("framework_mappings").alias("mappings"))


def module_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Imports of parsed files that resolve to files of the same repository."""
    return _shown_owner(graph.edges(graph.resolved_imports(facts.extract(_files(spark, sf), ["repository"]), ["repository"]), ["repository"]))


QUERIES = {
    f.__name__: f
    for f in (
        lit_doc_first_type, lit_line_findings, lit_lang_rollup, dict_words, context_flags, allow_ignore_cap, glob_exclude, staged_files, flow_variables, sink_classify,
        fw_mapping_explode, fw_article_report, article_texts, severity_summary, failon_gate, first_per_line, worst_findings, shown_table, diff_shown, saved_and_read, upload_totals, quick_fixes, order_keys, diff_two_scans, diff_summary, type_map, suggest_patches, sarif_levels,
        facts_by_language, scan_parsed_files, module_edges,
    )
}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _literal(col: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, {_q(p)}) THEN {_q(t)}" for t, p in LITERALS) + " END"


_RANK = "CASE lower(trim(severity)) WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"
_ENTRIES = names.dictionary_entries()
_CHAIN = "CASE " + " ".join(f"WHEN regexp_matches(name, {_q('(?i)' + p)}) THEN {i}" for i, _, _, _, p, _ in _ENTRIES) + " END"
_RULE_ROWS = ", ".join(f"({i}, {_q(t)}, {_q(c)}, {_q(s)}, {_q(k)})" for i, t, c, s, _, k in _ENTRIES)


def _any(parts: list[str]) -> str:
    return "(" + " OR ".join(parts) + ")"


_SINK = (
    "CASE WHEN low IN (" + ", ".join(map(_q, LOG_CALLS)) + ") OR (" + _any([f"ends_with(callee, {_q(e)})" for e in LOG_ENDS]) + " AND contains(low, 'log')) THEN 'log_output' "
    "WHEN " + _any([f"ends_with(low, {_q(e)})" for e in DATABASE_ENDS]) + " THEN 'database' "
    "WHEN " + _any([f"starts_with(low, {_q(e)})" for e in HTTP_STARTS]) + " THEN 'third_party_api' "
    "WHEN " + _any([f"ends_with(low, {_q(e)})" for e in RESPONSE_ENDS]) + " AND " + _any([f"contains(low, {_q(h)})" for h in RESPONSE_HOLDERS]) + " THEN 'response' END"
)


def _fires(trigger: str) -> str:
    if trigger.startswith("sink:"):
        return f"sink = {_q(trigger[5:])}"
    return "sink IS NOT NULL" if trigger == "flow" else "pii_type IN (" + ", ".join(map(_q, GROUPS[trigger])) + ")"


_MAPPED = "WITH f AS (SELECT id, severity, pii_type, data_flow.sink.kind AS sink FROM findings), mapped AS (" + " UNION ALL ".join(
    f"SELECT id, {_RANK} AS rank, {_q(f)} AS framework, {_q(a)} AS article, {_q(t)} AS title, {n} AS pos FROM f WHERE {_fires(g)}" for n, (f, a, t, g, _, _) in enumerate(RULES)
) + ") "

_FP = r"sha256(concat_ws('|', coalesce(replace(location.file, '\', '/'), '~'), coalesce(pii_type, '~'), coalesce(trim(regexp_replace(code_snippet, '\s+', ' ', 'g')), '~'), coalesce(data_flow.sink.kind, '')))"
_DIFF = f"""WITH one AS (SELECT DISTINCT ON (id) * FROM findings WHERE id IS NOT NULL),
b AS (SELECT *, lower(severity) AS sv, {_FP} AS k FROM one WHERE coalesce(confidence, '') <> 'low'),
c AS (SELECT *, CASE WHEN lower(severity) = 'critical' THEN 'high' ELSE lower(severity) END AS sv, {_FP} AS k FROM one WHERE coalesce(severity, '') <> 'low'),
f AS (SELECT DISTINCT ON (k) * FROM b ORDER BY k, id),
m AS (SELECT c.id, f.id IS NULL AS fresh, concat_ws(',', CASE WHEN coalesce(f.sv, 'none') <> coalesce(c.sv, 'none') THEN 'severity' END,
    CASE WHEN coalesce(CAST(f.location.line AS VARCHAR), 'none') <> coalesce(CAST(c.location.line AS VARCHAR), 'none') THEN 'line' END,
    CASE WHEN (f.data_flow IS NULL) <> (c.data_flow IS NULL) THEN 'data_flow' END,
    CASE WHEN coalesce(len(f.framework_mappings), 0) <> coalesce(len(c.framework_mappings), 0) THEN 'framework_mappings' END,
    CASE WHEN coalesce(f.confidence, 'none') <> coalesce(c.confidence, 'none') THEN 'confidence' END) AS fields FROM c LEFT JOIN f USING (k)),
d AS (SELECT CASE WHEN fresh THEN 'added' WHEN fields <> '' THEN 'modified' ELSE 'unchanged' END AS change, id, CASE WHEN fresh THEN '' ELSE fields END AS fields FROM m
  UNION ALL SELECT 'removed', id, '' FROM b WHERE k NOT IN (SELECT k FROM c)) """

_DESCRIBED = """CASE kind WHEN 'log_output' THEN 'Mask ' || pii_type || ' before logging to prevent PII leakage' WHEN 'third_party_api' THEN 'Mask ' || pii_type || ' before sending to third-party API'
  WHEN 'response' THEN 'Redact ' || pii_type || ' from API response payload' WHEN 'database' THEN 'Encrypt ' || pii_type || ' before storing in database' ELSE 'Review handling of ' || pii_type || ' to ensure compliance' END"""
_MASK = "CASE " + " ".join(f"WHEN pii_type = {_q(t)} THEN {_q(m)}" for t, m in MASKS.items()) + " ELSE 'maskPii' END"

_PATH = r"regexp_replace(replace(path, '\', '/'), '^(?:\./)+', '')"


def _globs(col: str, globs: list[str]) -> str:
    return _any([f"regexp_matches({col}, {_q(glob_regex(g))})" for g in globs])


SQL = {
    "lit_doc_first_type": f"SELECT * FROM (SELECT doc_id, {_literal('text')} AS pii_type FROM documents) WHERE pii_type IS NOT NULL",
    "lit_line_findings": f"""SELECT * FROM (SELECT doc_id, line_no, {_literal('line')} AS pii_type FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS BIGINT) AS line_no FROM documents)) WHERE pii_type IS NOT NULL""",
    "lit_lang_rollup": f"SELECT lang, pii_type, count(*) AS n FROM (SELECT lower(lang) AS lang, {_literal('text')} AS pii_type FROM documents) WHERE pii_type IS NOT NULL GROUP BY ROLLUP (lang, pii_type)",
    "dict_words": f"""WITH w AS (SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(code_snippet, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM scan_findings) GROUP BY name),
m AS (SELECT name, n, {_CHAIN} AS rule FROM w WHERE lower(name) NOT IN ({', '.join(map(_q, SAFE_NAMES))}))
SELECT name, n, pii_type, category, severity, confidence FROM m JOIN (VALUES {_RULE_ROWS}) r(rule, pii_type, category, severity, confidence) USING (rule)""",
    "context_flags": f"""SELECT coalesce(regexp_matches(lower(file_path), '{TEST_CONTEXT}'), NULL) AS in_test,
  ((contains(low, 'example.com') AND (contains(low, '"test') OR contains(low, '"user@') OR contains(low, '"demo'))) OR {' OR '.join(f"contains(low, {_q(m)})" for m in ("// example", "# example", "// dummy", "# dummy", "// placeholder", "// mock", "todo!"))}) AS in_example,
  count(*) AS n FROM (SELECT file_path, lower(code_snippet) AS low FROM scan_findings WHERE code_snippet IS NOT NULL) GROUP BY ALL""",
    "allow_ignore_cap": r"""WITH s AS (SELECT pii_type, replace(file_path, '\', '/') AS p, CASE lower(trim(severity)) WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS r
  FROM scan_findings WHERE code_snippet IS NOT NULL AND NOT contains(code_snippet, 'analytics') AND NOT contains(code_snippet, 'TODO') AND pii_type <> 'gender'),
t AS (SELECT pii_type, p, CASE WHEN regexp_matches(p, '^lib/.*$') THEN least(r, 1) ELSE r END AS r FROM s)
SELECT pii_type, CASE r WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM t
WHERE NOT (regexp_matches(p, '^services/.*/load_.*$') AND r = 0) GROUP BY ALL""",
    "glob_exclude": f"""WITH p AS (SELECT {_PATH} AS p FROM parsed_files)
SELECT {_any([_globs("p", list(DEFAULT_EXCLUDE)), *[f"len(list_filter(range(1, len(string_split(p, '/'))), lambda n: {_globs("array_to_string(list_slice(string_split(p, '/'), 1, n), '/')", list(DEFAULT_EXCLUDE))})) > 0"]])} AS excluded,
  {_globs("p", ["**/*.{ts,tsx,mts}"])} AS typescript, count(*) AS n FROM p GROUP BY ALL""",
    "staged_files": f"""WITH p AS (SELECT file_id, {_PATH} AS path FROM parsed_files), c AS (SELECT DISTINCT location.file AS f FROM findings WHERE location.file IS NOT NULL)
SELECT file_id, path FROM p WHERE EXISTS (SELECT 1 FROM c WHERE path = f OR ends_with(path, '/' || f))""",
    "flow_variables": r"""SELECT variable, count(*) AS n FROM (SELECT coalesce(nullif(regexp_extract(code_snippet, '(\w+)\.(\w+)', 2), ''),
  nullif(regexp_extract(code_snippet, '(?:const|let|var|)\s*(\w+)\s*=', 1), '')) AS variable FROM scan_findings) WHERE variable IS NOT NULL GROUP BY ALL""",
    "sink_classify": rf"""WITH c AS (SELECT callee, lower(callee) AS low, count(*) AS n FROM (SELECT unnest(regexp_extract_all(code_snippet, '([A-Za-z_][A-Za-z0-9_.]*)\(', 1)) AS callee FROM scan_findings) GROUP BY callee)
SELECT callee, n, kind FROM (SELECT callee, n, {_SINK} AS kind FROM c) WHERE kind IS NOT NULL""",
    "fw_mapping_explode": _MAPPED + "SELECT framework, article, title, count(*) AS n FROM mapped GROUP BY ALL",
    "article_texts": _MAPPED
    + "SELECT a.framework, a.article, a.title, a.description, coalesce(c.n, 0) AS n FROM (VALUES "
    + ", ".join("(" + ", ".join(map(_q, a)) + ")" for a in ARTICLES)
    + ") a(framework, article, title, description) LEFT JOIN (SELECT framework, article, count(*) AS n FROM mapped GROUP BY ALL) c USING (framework, article)",
    "fw_article_report": _MAPPED
    + """SELECT framework, article, count(DISTINCT id) AS findings, max(rank) AS max_rank, arg_min(title, (per, id)) AS title, CASE WHEN max(rank) >= 2 THEN 'AT RISK' ELSE 'REVIEW' END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY framework, id ORDER BY pos) AS per FROM (SELECT DISTINCT * FROM mapped)) GROUP BY framework, article""",
    "severity_summary": "SELECT pii_type, "
    + ", ".join(f"count(*) FILTER (lower(trim(severity)) = '{s}') AS {s}" for s in reports.LEVELS)
    + ", count(*) AS total FROM scan_findings GROUP BY pii_type",
    "failon_gate": f"SELECT scan_id, bool_or({_RANK} >= 3) AS fails, max({_RANK}) AS worst FROM scan_findings GROUP BY scan_id",
    "first_per_line": "SELECT scan_id, file_path AS path, line, pii_type, min(id) AS id FROM scan_findings GROUP BY scan_id, file_path, line, pii_type",
    "worst_findings": f"""SELECT id, location.file AS file, location.line AS line, lower(severity) AS severity FROM findings WHERE {_RANK} >= 1 AND lower(trim(confidence)) IN ('medium', 'high')
ORDER BY {_RANK} DESC, string_split(location.file, '/') NULLS FIRST, location.line NULLS FIRST, id NULLS FIRST LIMIT 50""",
    "shown_table": """SELECT id, severity, pii_type, CASE WHEN length(location.file) > 38 THEN '...' || right(location.file, 35) ELSE location.file END AS file, location.line AS line,
  CASE WHEN framework_mappings IS NOT NULL THEN CAST(len(list_distinct(list_transform(framework_mappings, lambda m: CASE WHEN m.framework IS NOT NULL AND m.article IS NOT NULL THEN m.framework || ' ' || m.article END))) AS INTEGER) END AS articles FROM findings""",
    "saved_and_read": "SELECT pii_type, severity, count(*) AS n, CAST(sum(coalesce(len(framework_mappings), 0)) AS BIGINT) AS mappings, count(data_flow.sink.kind) AS sinks, CAST(7 AS BIGINT) AS files_scanned FROM findings GROUP BY pii_type, severity",
    "upload_totals": "SELECT *, (SELECT count(*) FROM findings) AS total FROM (SELECT "
    + ", ".join(f"count(*) FILTER (lower(trim(severity)) = '{s}') AS {s}" for s in reports.LEVELS)
    + " FROM findings), (SELECT pii_type, count(*) AS n FROM findings GROUP BY pii_type)",
    "quick_fixes": f"""WITH one AS (SELECT DISTINCT ON (id) * FROM findings WHERE id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY location.file, location.line ORDER BY id) AS k, data_flow.sink.kind AS kind FROM one)
SELECT CASE {_RANK} WHEN 3 THEN 'ERROR' WHEN 2 THEN 'WARNING' WHEN 1 THEN 'INFORMATION' ELSE 'HINT' END AS level, CASE WHEN k = 1 THEN {_DESCRIBED} END AS quick_fix, count(*) AS n FROM p GROUP BY ALL""",
    "suggest_patches": f"""WITH one AS (SELECT DISTINCT ON (id) id, pii_type, location.file AS file, location.line AS line, code_snippet AS s, data_flow.sink.kind AS kind FROM findings),
w AS (SELECT *, lower(pii_type) AS t, replace(lower(pii_type), '_', '') AS u, regexp_extract_all(s, '\\b(\\w+\\.\\w+(?:\\.\\w+)*)', 1) AS paths, regexp_extract_all(s, '\\b(\\w+)\\b', 1) AS words, regexp_extract(s, '^(\\s*)', 1) AS ind
  FROM one WHERE s IS NOT NULL AND trim(s, ' ') <> ''),
e AS (SELECT *, coalesce(list_filter(paths, lambda p: contains(lower(string_split(p, '.')[-1]), t) OR contains(lower(string_split(p, '.')[-1]), u))[1], list_filter(words, lambda p: contains(lower(p), t) OR contains(lower(p), u))[1]) AS x FROM w),
r AS (SELECT *, CASE kind
  WHEN 'log_output' THEN CASE WHEN x IS NOT NULL THEN replace(s, x, {_MASK} || '(' || x || ')') ELSE ind || '// TODO: mask PII (' || pii_type || ') before logging' END
  WHEN 'third_party_api' THEN CASE WHEN x IS NOT NULL THEN replace(s, x, {_MASK} || '(' || x || ')') ELSE ind || '// TODO: mask or remove ' || pii_type || ' before sending to third-party API' END
  WHEN 'response' THEN CASE WHEN x IS NOT NULL THEN replace(s, x, '"[REDACTED]"') ELSE ind || '// TODO: redact ' || pii_type || ' from response' END
  WHEN 'database' THEN CASE WHEN x IS NOT NULL THEN replace(s, x, 'encrypt(' || x || ')') ELSE ind || '// TODO: encrypt ' || pii_type || ' before database storage' END
  ELSE ind || '// TODO: review handling of ' || pii_type || ' — ensure encryption at rest, minimize collection' END AS y FROM e)
SELECT id AS finding_id, {_DESCRIBED} AS description, y AS replacement_line,
  sha256('--- a/' || file || chr(10) || '+++ b/' || file || chr(10) || '@@ -' || line || ',1 +' || line || ',1 @@' || chr(10) || '-' || s || chr(10) || '+' || y || chr(10)) AS diff_hash FROM r""",
    "diff_shown": _DIFF.rstrip() + f""", x AS (SELECT d.*, CASE WHEN change = 'removed' THEN b.sv ELSE c.sv END AS severity, one.pii_type, one.location AS loc, f.sv AS fsv, c.sv AS csv, f.location.line AS fl, c.location.line AS cl,
    f.data_flow IS NULL AS ff, c.data_flow IS NULL AS cf, coalesce(len(f.framework_mappings), 0) AS fm, coalesce(len(c.framework_mappings), 0) AS cm, f.confidence AS fc, c.confidence AS cc
  FROM d JOIN one ON d.id = one.id LEFT JOIN b ON d.change = 'removed' AND b.id = d.id LEFT JOIN c ON d.change <> 'removed' AND c.id = d.id LEFT JOIN f ON f.k = c.k WHERE change <> 'unchanged')
SELECT change, id, pii_type, CASE WHEN change = 'modified' THEN concat_ws(', ', CASE WHEN coalesce(fsv, 'none') <> coalesce(csv, 'none') THEN 'severity: ' || coalesce(fsv, 'none') || ' -> ' || coalesce(csv, 'none') END,
  CASE WHEN coalesce(CAST(fl AS VARCHAR), 'none') <> coalesce(CAST(cl AS VARCHAR), 'none') THEN 'line: ' || coalesce(CAST(fl AS VARCHAR), 'none') || ' -> ' || coalesce(CAST(cl AS VARCHAR), 'none') END,
  CASE WHEN ff <> cf THEN 'data_flow: ' || CASE WHEN ff THEN 'none' ELSE 'present' END || ' -> ' || CASE WHEN cf THEN 'none' ELSE 'present' END END,
  CASE WHEN fm <> cm THEN 'framework_mappings: ' || fm || ' mapping(s) -> ' || cm || ' mapping(s)' END,
  CASE WHEN coalesce(fc, 'none') <> coalesce(cc, 'none') THEN 'confidence: ' || coalesce(fc, 'none') || ' -> ' || coalesce(cc, 'none') END) ELSE '' END AS changes
FROM x ORDER BY CASE change WHEN 'added' THEN 1 WHEN 'modified' THEN 2 WHEN 'removed' THEN 3 ELSE 4 END, {_RANK} DESC, string_split(loc.file, '/') NULLS FIRST, loc.line NULLS FIRST, id LIMIT 50""",
    "order_keys": f"""SELECT id, {_RANK} AS severity_rank, replace(location.file, '/', '|') AS parts, location.line AS line FROM findings
WHERE lower(trim(confidence)) IN ('medium', 'high')""",
    "diff_two_scans": _DIFF + "SELECT change, id, fields FROM d",
    "diff_summary": _DIFF
    + """SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'removed') AS removed,
  count(*) FILTER (change = 'unchanged') AS unchanged, count(*) FILTER (change <> 'added') AS total_baseline, count(*) FILTER (change <> 'removed') AS total_current FROM d""",
    "type_map": "SELECT pii_type, count(*) AS n FROM scan_findings GROUP BY pii_type",
    "sarif_levels": f"SELECT pii_type AS rule_id, CASE WHEN {_RANK} >= 2 THEN 'error' WHEN {_RANK} = 1 THEN 'warning' ELSE 'note' END AS level, count(*) AS n FROM findings GROUP BY ALL",
}

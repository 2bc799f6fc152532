"""Report sinks: scan results as JSON, findings and summary as CSV, SARIF, and an HTML page.

Findings are written by executors.  Only the summaries (one row per type, level or top file) come to the driver; a SARIF
log is one document by definition, so large ones are cut into parts.
"""

from __future__ import annotations

import html
import json
from datetime import datetime
from string import Template

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sundew.functions import masking
from sundew.functions.masking import lookup
from sundew.session import durable

# Rules of the SARIF report, in order of their index: id, type, level.
SARIF_RULES = (
    ("PI001", "TFN", "error"),
    ("PI002", "MEDICARE", "error"),
    ("PI003", "ABN", "warning"),
    ("PI004", "BSB", "warning"),
    ("PI005", "CREDIT_CARD", "error"),
    ("PI006", "EMAIL", "note"),
    ("PI007", "PHONE", "note"),
    ("PI008", "NAME", "note"),
    ("PI009", "ADDRESS", "warning"),
    ("PI010", "PASSPORT", "error"),
    ("PI011", "DRIVER_LICENSE", "warning"),
    ("PI012", "IP_ADDRESS", "note"),
)
SARIF_VERSION = "2.1.0"
LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note"}
#: Columns of saved findings.
SAVED = "file string, line int, col int, kind string, value string, context string, validated boolean, confidence double, risk_level string, is_test boolean, detector_name string"
#: Namespace of addresses for name-based UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def rule_id(kind: Column) -> Column:
    return lookup(kind, {k: i for i, k, _ in SARIF_RULES}, F.lit("PI999"))


def rule_index(kind: Column) -> Column:
    """Position of the type's rule, -1 for types without one."""
    return lookup(kind, {k: n for n, (_, k, _) in enumerate(SARIF_RULES)}, F.lit(-1))


def default_level(kind: Column) -> Column:
    return lookup(kind, {k: level for _, k, level in SARIF_RULES}, F.lit("note"))


def risk_level(risk: Column) -> Column:
    """SARIF level of a risk level, none for unknown ones."""
    return lookup(risk, LEVELS, F.lit("none"))


def uri(path: Column, base: str = "") -> Column:
    """Path with forward slashes, relative to the base if it lies under it."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    if not base:
        return slashed
    return F.when(slashed.startswith(base), F.regexp_replace(F.substr(slashed, F.lit(len(base) + 1)), "^/", "")).otherwise(slashed)


def fingerprint(path: Column, kind: Column, line: Column, value: Column) -> Column:
    """Hex of the text of the name-based UUID of path:type:line:match, so 72 characters."""
    name = F.concat_ws(":", path, kind, line.cast("string"), value)
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))))
    text = F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 19, 2), F.lit("-"), F.substring(digest, 21, 12),
    )
    return F.lower(F.hex(F.encode(text, "UTF-8")))


def csv_rows(
    findings: DataFrame, repository: str, branch: str, at: datetime, masked: bool = True, context: bool = False, metadata: dict | None = None
) -> DataFrame:
    """Findings as text columns under the report's headings.

    ``findings`` has file, line, col, kind, value, validated; confidence, risk_level, risk_score, impact, likelihood,
    exposure, category, environment, proximity and the three compliance flags are used where present, else stand for
    nothing known (0.00, UNKNOWN, unknown, false).
    """
    has = set(findings.columns)
    number = lambda c: F.format_string("%.2f", F.coalesce(F.col(c).cast("double"), F.lit(0.0))) if c in has else F.lit("0.00")
    text = lambda c, d="": F.coalesce(F.col(c), F.lit(d)) if c in has else F.lit(d)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("string") if c in has else F.lit("false")
    test = F.col("environment").isin("test", "mock").cast("string") if "environment" in has else F.lit("false")
    columns = {
        "Timestamp": F.lit(at.strftime("%Y-%m-%d %H:%M:%S")),
        "Repository": F.lit(repository),
        "Branch": F.lit(branch),
        "File Path": text("file"),
        "Line": F.coalesce(F.col("line"), F.lit(0)).cast("string"),
        "Column": F.coalesce(F.col("col"), F.lit(0)).cast("string"),
        "PI Type": text("kind"),
        "PI Type Display": masking.display(text("kind")),
        "Validated": flag("validated"),
        "Test Data": test,
        "Confidence Score": number("confidence"),
        "Risk Level": text("risk_level", "UNKNOWN"),
        "Risk Score": number("risk_score"),
    }
    if masked:
        columns["Masked Value"] = masking.masked(text("value"), text("kind"))
    columns |= {"Impact Score": number("impact"), "Likelihood Score": number("likelihood"), "Exposure Score": number("exposure")}
    columns |= {"Risk Category": text("category"), "Environment": text("environment", "unknown")}
    if context:
        columns |= {"Code Context": text("context"), "Proximity Context": text("proximity")}
    columns |= {"APRA Relevant": flag("apra"), "Privacy Act Issue": flag("privacy_act"), "Notifiable Breach": flag("notifiable")}
    if metadata is not None:
        columns |= {"Scan ID": F.lit(metadata.get("scan_id", "")), "Commit Hash": F.lit(metadata.get("commit_hash", ""))}
        columns |= {"Scan Duration (seconds)": F.lit(f"{metadata.get('seconds', 0):.2f}"), "Tool Version": F.lit(metadata.get("version", ""))}
    return findings.select(*[e.alias(n) for n, e in columns.items()])


def percentage(value: Column, total: Column) -> Column:
    """Share in percent with one digit, 0.0% of nothing."""
    return F.when(total == 0, "0.0%").otherwise(F.format_string("%.1f%%", F.coalesce(F.try_divide(value, total), F.lit(0.0)) * 100))


def summary_rows(findings: DataFrame, repository: str, branch: str, at: datetime, seconds: float) -> DataFrame:
    """The eleven rows of the summary: Metric, Value, Percentage; one pass over the findings."""
    c = findings.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("risk_level") == r).alias(r) for r in LEVELS],
        F.count_if("validated").alias("valid"),
        F.count_if("is_test").alias("test"),
    )
    row = lambda m, v, p: F.struct(F.lit(m).alias("Metric"), v.alias("Value"), p.alias("Percentage"))
    counted = [("Critical Risk", "CRITICAL"), ("High Risk", "HIGH"), ("Medium Risk", "MEDIUM"), ("Low Risk", "LOW"), ("Validated PI", "valid"), ("Test Data", "test")]
    rows = [
        row("Repository", F.lit(repository), F.lit("")),
        row("Branch", F.lit(branch), F.lit("")),
        row("Scan Date", F.lit(at.strftime("%Y-%m-%d %H:%M:%S")), F.lit("")),
        row("Scan Duration", F.lit(f"{seconds:.2f} seconds"), F.lit("")),
        row("Total Findings", F.col("total").cast("string"), F.lit("100.0%")),
    ]
    rows += [row(m, F.col(n).cast("string"), percentage(F.col(n), F.col("total"))) for m, n in counted]
    return c.select(F.inline(F.array(*rows)))


def sarif_result(base: str = "") -> Column:
    """The SARIF result of a finding with file, line, col, kind, value, context and validated."""
    kind, value = F.col("kind"), F.col("value")
    stop = F.col("col") + F.length(value)
    shown = masking.masked(value, kind)
    region = F.struct(
        F.col("line").alias("startLine"), F.col("col").alias("startColumn"), F.col("line").alias("endLine"), stop.alias("endColumn"),
        F.when(F.col("context") != "", F.struct(F.col("context").alias("text"))).alias("snippet"),
    )
    place = F.struct(F.struct(uri(F.col("file"), base).alias("uri")).alias("artifactLocation"), region.alias("region"))
    index = rule_index(kind)
    return F.struct(
        rule_id(kind).alias("ruleId"),
        F.when(index > 0, index).alias("ruleIndex"),
        default_level(kind).alias("level"),
        F.struct(F.concat(masking.display(kind), F.lit(" detected: "), shown).alias("text")).alias("message"),
        F.array(F.struct(place.alias("physicalLocation"))).alias("locations"),
        F.struct(fingerprint(F.col("file"), kind, F.col("line"), value).alias("primaryLocationLineHash")).alias("partialFingerprints"),
        F.struct(kind.alias("piType"), F.coalesce("validated", F.lit(False)).alias("validated"), shown.alias("match")).alias("properties"),
    )


def sarif_fixes(mitigations: Column, base: str = "") -> Column:
    """SARIF fixes of a finding: one per mitigation (title, description, priority, effort, timeline, category) of priority
    CRITICAL or HIGH, which replaces the match by a comment; null for none."""
    region = F.struct(F.col("line").alias("startLine"), F.col("col").alias("startColumn"), F.col("line").alias("endLine"), (F.col("col") + F.length("value")).alias("endColumn"))
    comment = F.struct(F.concat(F.lit("/* REDACTED - "), F.col("kind"), F.lit(" */")).alias("text"))
    change = F.struct(
        F.struct(uri(F.col("file"), base).alias("uri")).alias("artifactLocation"), F.array(F.struct(region.alias("deletedRegion"), comment.alias("insertedContent"))).alias("replacements")
    )
    urgent = F.filter(mitigations, lambda m: m["priority"].isin("CRITICAL", "HIGH"))
    fixes = F.transform(
        urgent,
        lambda m: F.struct(
            F.struct(F.concat(m["title"], F.lit(": "), m["description"]).alias("text")).alias("description"),
            F.array(change).alias("artifactChanges"),
            F.struct(*[m[c].alias(c) for c in ("priority", "effort", "timeline", "category")]).alias("properties"),
        ),
    )
    return F.when(F.size(urgent) > 0, fixes)


def sarif_risk_result(columns: list[str], base: str = "") -> Column:
    """``sarif_result`` of a finding that also has risk_score, risk_level, category, impact, likelihood, exposure, and if
    present confidence, environment, proximity and mitigations: the level follows the risk, the rank is its hundredfold."""
    plain, has = sarif_result(base), set(columns)
    rated = F.col("risk_score").isNotNull()
    risk = F.struct(
        F.col("risk_score").alias("overallRisk"), F.col("risk_level").alias("riskLevel"), F.col("category").alias("riskCategory"), F.col("impact").alias("impactScore"),
        F.col("likelihood").alias("likelihoodScore"), F.col("exposure").alias("exposureScore"),
    )
    more = {"confidence": "confidenceScore", "environment": "environment", "proximity": "proximityInfo"}
    properties = F.struct(
        *[plain["properties"][c].alias(c) for c in ("piType", "validated", "match")], F.when(rated, risk).alias("riskAssessment"), *[F.col(c).alias(n) for c, n in more.items() if c in has]
    )
    kept = [plain[c].alias(c) for c in ("ruleId", "ruleIndex", "message", "locations", "partialFingerprints")]
    fixes = [sarif_fixes(F.col("mitigations"), base).alias("fixes")] if "mitigations" in has else []
    level = F.when(rated, risk_level(F.col("risk_level"))).otherwise(plain["level"])
    return F.struct(*kept, level.alias("level"), F.when(rated, F.col("risk_score") * 100).alias("rank"), properties.alias("properties"), *fixes)


def sarif_report(findings: DataFrame, tool: str, version: str, by: list[str], base: str = "", chunk: int = 20_000, risk: bool = False, invocation: dict | None = None) -> DataFrame:
    """SARIF logs, one row each: the columns ``by``, ``part`` and the JSON text ``body``; with ``risk`` the results are
    those of ``sarif_risk_result``, an ``invocation`` (started, finished, ok) becomes the run's.

    A log is a single document, so findings are cut by ``by`` (repository, say) and, within a value of it, by line hash
    into parts of about ``chunk`` results; no row grows with the data.
    """
    parts = findings.groupBy(*[F.col(k).alias(f"_by_{k}") for k in by]).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("_parts"))
    part = F.pmod(F.xxhash64("file", "kind", "line", "col", "value"), F.col("_parts")).cast("int")
    same = [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in by]
    rows = findings.join(parts, same).select(*by, part.alias("part"), (sarif_risk_result(findings.columns, base) if risk else sarif_result(base)).alias("result"))
    rules = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(masking.DISPLAY[k]).alias("name"), F.struct(F.lit(lv).alias("level")).alias("defaultConfiguration")) for i, k, lv in SARIF_RULES])
    driver = F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), rules.alias("rules"))
    told = []
    if invocation is not None:
        ran = F.struct(F.lit(bool(invocation.get("ok", True))).alias("executionSuccessful"), F.lit(invocation.get("started")).alias("startTimeUtc"), F.lit(invocation.get("finished")).alias("endTimeUtc"))
        told = [F.array(ran).alias("invocations")]
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), *told, F.col("results"))
    report = F.struct(F.lit(SARIF_VERSION).alias("version"), F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.array(run).alias("runs"))
    return rows.groupBy(*by, "part").agg(F.collect_list("result").alias("results")).select(*by, "part", F.to_json(report).alias("body"))


def scan_result(findings: DataFrame, repository: dict, started: datetime, finished: datetime, files: dict, error: str = "") -> dict:
    """The head of a scan's result with its counts by type and risk; findings themselves are written by ``write_json``."""
    rows = findings.groupBy("kind", "risk_level").count().collect()  # types times levels, so few
    by_type: dict[str, int] = {}
    by_risk: dict[str, int] = {}
    for r in rows:
        by_type[r.kind] = by_type.get(r.kind, 0) + r["count"]
        by_risk[r.risk_level] = by_risk.get(r.risk_level, 0) + r["count"]
    head = {
        "repository": repository,
        "scan_started": started.isoformat(),
        "scan_finished": finished.isoformat(),
        "duration": int((finished - started).total_seconds() * 1e9),
        "files_scanned": files.get("scanned_files", 0),
        "stats": {**files, "findings_by_type": by_type, "findings_by_risk": by_risk},
    }
    return head | ({"error": error} if error else {})


def write_json(findings: DataFrame, head: dict, folder: str) -> None:
    """A scan's result: its head in ``scan.json`` and its findings as JSON lines in ``findings``; folders are made."""
    findings.write.mode("overwrite").json(f"{folder}/findings")
    write_head(head, folder, findings.sparkSession)


def write_head(head: dict, folder: str, spark: SparkSession) -> None:
    write_text(spark, f"{folder}/scan.json", json.dumps(head, indent=2, sort_keys=True))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text in a file of whatever file system the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_csv(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)


# The page: its parts as tables first ---------------------------------------------------------------------------------


def by_level(findings: DataFrame) -> dict[str, DataFrame]:
    """The findings of each risk level, each in order of file, line and column."""
    return {r: findings.where(F.col("risk_level") == r).orderBy("file", "line", "col") for r in LEVELS}


def with_risk(findings: DataFrame, risks: DataFrame, key: str) -> DataFrame:
    """Findings beside their risk assessment by ``key``; a finding without one keeps nulls, clashing names the finding's."""
    more = [c for c in risks.columns if c != key and c not in findings.columns]
    return findings.join(risks.select(key, *more), key, "left")


def environment_of(file: Column, is_test: Column) -> Column:
    """mock, config, test or production, by the file's name and the finding's test flag."""
    low = F.lower(file)
    return (
        F.when(low.rlike("mock|stub|fake"), "mock")
        .when(F.coalesce(is_test, F.lit(False)) | low.rlike("test|spec"), "test")
        .when(low.rlike(r"\.(?:ya?ml|json|toml|ini|cfg|conf|config|env|properties)$"), "config")
        .otherwise("production")
    )


def distributions(findings: DataFrame) -> DataFrame:
    """(dimension, member, n, share): findings by type, risk level, file type, environment and validity, in one pass."""
    file_type = F.coalesce(F.nullif(F.lower(F.regexp_extract("file", r"\.([^./\\]*)$", 1)), F.lit("")), F.lit("none"))
    members = {
        "type": F.col("kind"),
        "risk": F.col("risk_level"),
        "file_type": file_type,
        "environment": environment_of(F.col("file"), F.col("is_test")),
        "validated": F.coalesce("validated", F.lit(False)).cast("string"),
    }
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(m, F.lit("unknown")).alias("member")) for d, m in members.items()]))
    counts = findings.select(pairs.alias("x")).groupBy("x.dimension", "x.member").agg(F.count(F.lit(1)).alias("n"))
    total = findings.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def top_risks(findings: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` pairs of type and risk level that weigh most: level first, then number; a top-k report."""
    order = F.array_position(F.array(*[F.lit(r) for r in LEVELS]), F.col("risk_level"))
    counts = findings.where(F.col("risk_level").isin(*LEVELS)).groupBy("risk_level", "kind").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(order, F.desc("n"), "kind").limit(n)


# Helpers of templates: plain values to text.


def percent(x: float | None) -> str:
    return f"{(x or 0) * 100:.1f}%"


def score_text(x: float | None) -> str:
    return f"{x or 0:.2f}"


def date_text(t: datetime, time: bool = True) -> str:
    return t.strftime("%Y-%m-%d %H:%M:%S" if time else "%Y-%m-%d")


def risk_class(level: str | None) -> str:
    """The style class of a risk level."""
    return f"risk-{(level or 'unknown').lower()}"


PAGE = Template(
    """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>$title</title>
<style>body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:4px 8px;text-align:left}
.bar{background:#69c;height:1em}.risk-critical{color:#b00}.risk-high{color:#d50}.risk-medium{color:#a80}.risk-low{color:#484}</style>
</head><body><h1>$title</h1><h2>Summary</h2>$summary$sections<h2>Most affected files</h2>$files$lists</body></html>
"""
)


def _table(rows: list[tuple], heads: tuple[str, ...]) -> str:
    cell = lambda tag, x: f"<{tag}>{html.escape(str(x))}</{tag}>"
    body = "".join("<tr>" + "".join(cell("td", x) for x in r) + "</tr>" for r in rows)
    return "<table><tr>" + "".join(cell("th", h) for h in heads) + f"</tr>{body}</table>"


def _bars(rows: list[tuple[str, int, float]]) -> str:
    """A chart of shares: a bar per member."""
    line = lambda m, n, x: f'<tr><td>{html.escape(m)}</td><td>{n}</td><td style="width:20em"><div class="bar" style="width:{x * 100:.1f}%"></div></td></tr>'
    return "<table>" + "".join(line(*r) for r in rows) + "</table>"


SECTIONS = {"type": "By type", "risk": "By risk level", "file_type": "By file type", "environment": "By environment"}


def html_page(findings: DataFrame, title: str, top: int = 10, shown: int = 100) -> str:
    """A page with counts and shares, the validation rate, the heaviest risks, the ``top`` files and the first ``shown``
    findings of each level, values masked; everything is escaped.

    To the driver come a row per member of a distribution and the rows that are shown; file types beyond the hundred most
    frequent are summed up.
    """
    counts = durable(distributions(findings))  # a few rows, read once per section
    members = [r for d in SECTIONS for r in counts.where(F.col("dimension") == d).orderBy(F.desc("n"), "member").limit(100).collect()]
    total, valid = findings.agg(F.count(F.lit(1)).alias("n"), F.count_if("validated").alias("v")).first()
    levels = {r.member: r.n for r in members if r.dimension == "risk"}
    files = findings.groupBy("file").count().orderBy(F.desc("count"), "file").limit(top).collect()
    summary = [("All findings", total), *[(level.title(), levels.get(level, 0)) for level in LEVELS], ("Validated", valid), ("Validation rate", percent(valid / total if total else 0))]
    sections = ""
    for d, name in SECTIONS.items():
        mine = [(masking.DISPLAY.get(r.member, r.member) if d == "type" else r.member, r.n, r.share) for r in members if r.dimension == d]
        rest = total - sum(n for _, n, _ in mine)
        sections += f"<h2>{name}</h2>" + _bars(mine + ([("others", rest, rest / total)] if rest > 0 and total else []))
    risks = [(r.risk_level, masking.DISPLAY.get(r.kind, r.kind), r.n) for r in top_risks(findings).collect()]
    sections += "<h2>Top risks</h2>" + _table(risks, ("Level", "Type", "Findings"))
    lists = ""
    for level, rows in by_level(findings).items():
        told = rows.select("file", "line", "kind", masking.masked(F.col("value"), F.col("kind")).alias("value"), "confidence").limit(shown).collect()
        if told:
            cells = [(r.file, r.line, masking.DISPLAY.get(r.kind, r.kind), r.value, score_text(r.confidence)) for r in told]
            lists += f'<h2 class="{risk_class(level)}">{level.title()} ({levels.get(level, 0)})</h2>' + _table(cells, ("File", "Line", "Type", "Value", "Confidence"))
    return PAGE.substitute(
        title=html.escape(title), summary=_table(summary, ("Metric", "Value")), sections=sections, files=_table([(r.file, r["count"]) for r in files], ("File", "Findings")), lists=lists
    )

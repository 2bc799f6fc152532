"""Words around a match: labels, kinds of context, structure, semantics and the scores made of them.

Everything is a Column expression over the text, the match and its offsets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sundew.functions import patterns, spans
from sundew.functions.let import has_any, let
from sundew.functions.masking import lookup

# Labels, words and patterns of contexts.
TEST_WORDS = ("test", "testing", "example", "mock", "mocked", "sample", "demo", "fake", "dummy", "placeholder")
LABELS = (
    "ssn", "social security number", "social security no", "tfn", "tax file number", "tax file no", "medicare no", "medicare number",
    "medicare card", "medicare", "abn", "australian business number", "business number", "company abn", "bsb", "bank state branch",
    "bsb code", "branch code", "routing code", "bank code", "address", "street address", "postal address", "home address",
    "residential address", "credit card", "cc", "card number", "phone", "phone number", "mobile", "tel", "telephone", "email",
    "email address", "e-mail", "driver license", "dl", "license number", "drivers license", "passport", "passport number", "passport no",
)
DOCUMENTATION = r"""(?s)//.*?$|/\*.*?\*/|#.*?$|<!--.*?-->|--.*?$|\"\"\".*?\"\"\"|'''.*?'''"""
FORM = (
    r"""(?i)<input[^>]*>|<textarea[^>]*>.*?</textarea>|<select[^>]*>|<option[^>]*>|&\w+=[^&\s]*|\?\w+=[^&\s]*"""
    r"""|\w+=[^&\s%]*%[0-9A-Fa-f]{2}|^\s*\{.*"\w+"\s*:\s*"[^"]*\""""
)
DATABASE = (
    r"(?i)\bSELECT\b.*?\bFROM\b|\bINSERT\s+INTO\b|\bUPDATE\b.*?\bSET\b|\bDELETE\s+FROM\b|\bWHERE\b.*?=|\.where\s*\(|\.filter\s*\("
    r"|\.findOne\s*\(|mongodb://|jdbc:"
)
LOG = (
    r"(?i)\b(INFO|DEBUG|ERROR|WARN|TRACE|FATAL)\s*[:]\s*|\d{4}-\d{2}-\d{2}.*?(INFO|DEBUG|ERROR|WARN)|logger\.(info|debug|error|warn|trace)"
    r"|console\.(log|info|debug|error|warn)|<\d+>.*?:"
)
CONFIG = (
    r"^\s*[a-zA-Z_][a-zA-Z0-9_]*\s*=\s*[^=]|(?i:\w+\.\w+(\.\w+)*\s*=\s*[^=\[])|^\s*[a-zA-Z_][a-zA-Z0-9_]*\s*:\s*[^:]|(?i:export\s+\w+\s*=)"
    r"|(?i:\[\w+\])|(?i:(default|fallback|initial|config|setting)_\w+\s*=)|(?i:\w+_(tfn|ssn|medicare|abn|bsb)_\w+\s*=)"
    r"""|\{[^}]*"[^"]+"\s*:\s*"[^"]+"\s*\}"""
)
VARIABLE = (
    r"(?i)\b(var|let|const)\s+\w+\s*=|^\s*[a-zA-Z_]\w*\s*=\s*[^=]|(var|string|int|float|double)\s+\w+.*?=|function\s+\w+\s*\([^)]*="
    r"|\(\s*\w+\s*=|const\s*\{\s*\w+\s*=|const\s*\[\s*\w+\s*=|(test_|mock|sample_|demo_|fake_|dummy_)\w+\s*="
)
STRONG_LOG = ("INFO:", "DEBUG:", "ERROR:", "WARN:", "TRACE:", "FATAL:")
STRONG_CONFIG = ("default_", "initial_", "fallback_", "config_", "setting_", "app.config", ".config.", "_validation_", "_pattern")
STRONG_TEST = ("test", "mock", "fake", "dummy", "sample", "example")
BASE_SCORES = {
    "label": 0.9, "form": 0.8, "database": 0.8, "production": 0.8, "log": 0.7, "config": 0.6, "documentation": 0.4, "variable": 0.3, "test": 0.1,
}
STRUCTURES = {
    "url": r"(?i)(https?://[^\s<>]+|ftp://[^\s<>]+)",
    "html": r"(?i)(?s)<(input|textarea|select|form)[^>]*>",
    "xml": r"(?s)<[^>]+>[^<]*</[^>]+>|<[^>]+/>",
    "json": r"""(?s)[{,]\s*"[^"]*"\s*:\s*"[^"]*\"""",
    "sql": r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|FROM|WHERE|SET)\b",
    "code": r"(?i)\b(var|let|const|function|class|if|for|while|return)\b",
    "yaml": r"(?m)^\s*\w+\s*:\s*",
}
PERSON_WORDS = ("customer", "user", "client", "person", "individual", "verification", "authentication", "secure", "private", "confidential")
DOUBT_WORDS = ("test", "mock", "sample", "demo", "example", "fake", "dummy")
GROUP_WORDS = {
    "database": (("database", "table", "query", "select", "insert", "update", "where"), 0.05, ("database", "query")),
    "form": (("form", "input", "field", "submit", "validation"), 0.05, ("form", "input")),
    "documentation": (("documentation", "comment", "example", "reference", "guide"), -0.1, ("documentation",)),
    "log": (("log", "info", "debug", "error", "warn", "trace"), 0.03, ("log",)),
}
TYPE_HINTS = {
    "SSN": ("ssn", "social security"), "TFN": ("tfn", "tax file"), "Medicare": ("medicare",), "Email": ("email", "@"),
    "Phone": ("phone", "mobile", "tel"), "Credit Card": ("credit", "card", "cc"),
}
REASONS = {
    "label": "PI context label detected", "form": "form field context", "database": "database query context", "log": "log entry context",
    "config": "configuration context", "variable": "variable assignment context", "documentation": "documentation context",
    "production": "production code context",
}
TEST_REASONS = ("demo", "fake", "dummy", "mock", "sample", "example", "test")
CONTEXT_GROUPS = {
    "database": ("select", "insert", "update", "delete", "where", "from"), "form": ("input", "form", "field", "value"),
    "log": ("info", "debug", "error", "warn", "trace"), "config": ("config", "setting", "parameter", "default"),
    "variable": ("var", "let", "const", "variable"), "doc": ("comment", "documentation", "example"),
}


def _test_pattern() -> str:
    forms = []
    for w in TEST_WORDS:
        forms += [rf"\b{w}\b", rf"\b{w}[_-]", rf"[_-]{w}\b", f"{w}data", rf"\b{w}[a-z]"]
    return "(?i)" + "|".join(forms)


TEST_DATA = _test_pattern()
LABEL = "(?i)" + "|".join(rf"{label}\s*[:=\s]" for label in sorted(LABELS, key=len, reverse=True))


#: Words of which one is in every match of a long alternation, so that plain searches decide most texts.
GUARDS = {TEST_DATA: TEST_WORDS, LABEL: tuple(w for w in LABELS if not any(v != w and v in w for v in LABELS))}


def guarded(text: Column, pattern: str, then: Column, otherwise: Column) -> Column:
    """``then``, which looks for the pattern, where the pattern may match at all."""
    return F.when(has_any(F.lower(text), GUARDS[pattern]), then).otherwise(otherwise)


def has(text: Column, pattern: str) -> Column:
    found = text.rlike(patterns.java(pattern))
    return has_any(F.lower(text), GUARDS[pattern]) & found if pattern in GUARDS else found


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return has_any(text, words)


def words(text: Column) -> Column:
    """Lower-case words: runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit("[0-9A-Za-z_]+"), F.lit(0))


def word_distance(text: Column, target: Column, start: Column, stop: Column, reach: int = 100) -> Column:
    """Words between a match and a target word: first before it (counted back), then after; null if not near."""
    back, ahead = F.reverse(words(spans.before(text, start, reach))), words(spans.after(text, stop, reach))
    low = F.lower(target)
    b, a = F.array_position(back, low), F.array_position(ahead, low)
    return F.when(b > 0, b).when(a > 0, a)


def nearest_keyword(text: Column, keywords: list[str], start: Column, stop: Column) -> Column:
    """struct<distance, order, keyword> of the nearest keyword, the first in the list on ties; null if none is near."""
    each = [F.struct(word_distance(text, F.lit(k), start, stop).alias("distance"), F.lit(i).alias("order"), F.lit(k).alias("keyword")) for i, k in enumerate(keywords)]
    return F.array_min(F.filter(F.array(*each), lambda x: x["distance"].isNotNull()))


def count_keywords(text: Column, keywords: list[str]) -> Column:
    """How many whole words of the text are among the keywords; keywords of several words never are."""
    listed = F.array(*[F.lit(k.lower()) for k in dict.fromkeys(keywords)])
    return F.size(F.filter(words(text), lambda w: F.array_contains(listed, w)))


def window_sizes(text: Column, start: Column, stop: Column) -> Column:
    """struct<before, after>: the characters there are on either side."""
    n = F.length(text)
    a, b = F.least(F.greatest(start, F.lit(0)), n), F.least(stop, n)
    return F.struct(F.when(n == 0, 0).otherwise(a).alias("before"), F.when(n == 0, 0).otherwise(n - b).alias("after"))


def labels(text: Column) -> Column:
    """Labels of personal information in order of first appearance, each once whatever its case."""
    matched = guarded(text, LABEL, F.regexp_extract_all(text, F.lit(patterns.java(LABEL)), F.lit(0)), F.when(text.isNotNull(), F.array().cast("array<string>")))
    found = F.transform(matched, lambda m: F.trim(F.regexp_replace(F.regexp_replace(m, r"\s+$", ""), r"[:=]+$", "")))
    kept = F.filter(found, lambda m: m != "")

    def step(out: Column, m: Column) -> Column:
        return F.when(F.exists(out, lambda o: F.lower(o) == F.lower(m)), out).otherwise(F.array_append(out, m).cast("array<string>"))

    return F.aggregate(kept, F.array().cast("array<string>"), step)


def test_confidence(text: Column) -> Column:
    """0 without test words; else 0.3 a hit, up to 1, and 0.2 for each strong word, up to 1."""
    hits = guarded(text, TEST_DATA, F.regexp_count(text, F.lit(patterns.java(TEST_DATA))), F.when(text.isNotNull(), 0))
    strong = reduce(lambda a, b: a + b, [F.when(F.contains(F.lower(text), F.lit(w)), 0.2).otherwise(0.0) for w in STRONG_TEST])
    return F.when(hits == 0, 0.0).otherwise(F.least(F.lit(1.0), F.least(F.lit(1.0), hits * 0.3) + strong))


def context_confidence(text: Column) -> Column:
    """Sum of what speaks for and against personal information, within 0 and 1."""
    part = lambda c, v: F.when(c, v).otherwise(0.0)
    total = (
        part(has(text, LABEL), 0.8) + part(has(text, DATABASE), 0.6) + part(has(text, FORM), 0.6) + part(has(text, LOG), 0.4)
        + part(has(text, CONFIG), 0.3) + part(has(text, DOCUMENTATION), -0.3) + part(has(text, VARIABLE), -0.2)
    )
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def context_type(text: Column) -> Column:
    """By the matcher's order: test, label, database, form, log, config, variable, documentation, production."""
    order = (("test", TEST_DATA), ("label", LABEL), ("database", DATABASE), ("form", FORM), ("log", LOG), ("config", CONFIG), ("variable", VARIABLE), ("documentation", DOCUMENTATION))
    out = F.lit("production")
    for name, pattern in reversed(order):
        out = F.when(has(text, pattern), name).otherwise(out)
    return out


# Words that tell of each kind of context.
SQL_WORDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "FROM", "WHERE", "SET", "INTO", "VALUES")
SQL_NAMES = ("ssn", "tfn", "medicare")
LOG_LEVELS = ("INFO", "DEBUG", "ERROR", "WARN", "TRACE", "FATAL")
DECLARATIONS = ("var", "let", "const")
FORM_WORDS = ("input", "form", "field", "name", "value", "type")


def keywords_of_type(text: Column, kind: str) -> Column:
    """Sorted set of the keywords that a text gives as a context of one kind: SQL words and telling column names, log levels,
    keys of settings, declarations and the declared names, words of documentation, words of forms.  Other kinds give none;
    null text gives null."""
    words = F.filter(F.split(text, r"[ \t\n\f\r]+"), lambda w: w != "")
    if kind == "database":
        sql = F.filter(F.transform(words, lambda w: F.upper(F.btrim(w, F.lit("(),'\"")))), lambda w: w.isin(*SQL_WORDS))
        named = F.filter(F.transform(words, F.lower), lambda w: reduce(lambda a, b: a | b, [F.contains(w, F.lit(n)) for n in SQL_NAMES]))
        found = F.concat(sql, named)
    elif kind == "log":
        found = F.filter(F.transform(words, lambda w: F.upper(F.btrim(w, F.lit(":")))), lambda w: w.isin(*LOG_LEVELS))
    elif kind == "config":
        found = F.filter(F.transform(F.filter(words, lambda w: F.contains(w, F.lit("="))), lambda w: F.substring_index(w, "=", 1)), lambda w: w != "")
    elif kind == "variable":

        def declared(ws: Column) -> Column:
            is_word = lambda w: F.lower(w).isin(*DECLARATIONS)
            after = F.transform(F.filter(F.arrays_zip(ws.alias("w"), F.slice(ws, 2, F.size(ws)).alias("n")), lambda x: is_word(x["w"])), lambda x: F.btrim(F.coalesce(x["n"], F.lit("")), F.lit("=")))
            return F.concat(F.transform(F.filter(ws, is_word), F.lower), F.filter(after, lambda w: w != ""))

        found = let(words, declared)
    elif kind == "documentation":
        found = F.filter(F.transform(words, lambda w: F.btrim(w, F.lit("/*-#"))), lambda w: F.octet_length(w) > 2)
    elif kind == "form":
        low = F.lower(text)
        braces = F.contains(text, F.lit("{")) & F.contains(text, F.lit("}"))
        found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in FORM_WORDS], *[F.when(braces, F.lit(w)) for w in ("json", "structured")]))
    else:
        found = F.when(text.isNotNull(), F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(found))


def relevant_keywords(text: Column) -> Column:
    """Sorted set of labels, test words and the groups whose words occur."""
    low = F.lower(text)
    matched = guarded(text, TEST_DATA, F.regexp_extract_all(text, F.lit(patterns.java(TEST_DATA)), F.lit(0)), F.when(text.isNotNull(), F.array().cast("array<string>")))
    tests = F.transform(matched, lambda m: F.lower(F.regexp_replace(m, "^[_-]+|[_-]+$", "")))
    groups = F.array_compact(F.array(*[F.when(contains_any(low, w), F.lit(g)) for g, w in CONTEXT_GROUPS.items()]))
    return F.array_sort(F.array_distinct(F.concat(F.transform(labels(text), F.lower), tests, groups)))


def detector_window(text: Column, value: Column, start: Column, stop: Column) -> Column:
    """50 characters on either side of the match, or the whole text if it is under 100 characters."""
    return F.when(F.length(text) < 100, text).otherwise(F.concat(spans.before(text, start, 50), value, spans.after(text, stop, 50)))


def detector_context(near: Column) -> Column:
    """By the detector's order, of its window."""
    order = (
        ("documentation", has(near, DOCUMENTATION)),
        ("database", has(near, DATABASE)),
        ("log", has(near, LOG) & contains_any(near, STRONG_LOG)),
        ("config", has(near, CONFIG) & contains_any(F.lower(near), STRONG_CONFIG)),
        ("label", has(near, LABEL)),
        ("form", has(near, FORM)),
        ("variable", has(near, VARIABLE)),
    )
    out = F.lit("production")
    for name, test in reversed(order):
        out = F.when(test, name).otherwise(out)
    return out


def label_distance(before: Column, found: Column) -> Column:
    """Words from the nearest label to the match: 1 if little text is before, at most 5, 5 if no label is before."""
    n_words = F.size(F.filter(F.split(before, r"\s+"), lambda w: w != ""))
    low = F.lower(before)

    def behind(label: Column) -> Column:
        tail = F.substr(low, F.length(low) - F.instr(F.reverse(low), F.reverse(F.lower(label))) + 2)
        return F.when(F.contains(low, F.lower(label)), F.size(F.filter(F.split(tail, r"\s+"), lambda w: w != "")) + 1)

    least = F.least(n_words, F.coalesce(F.array_min(F.array_compact(F.transform(found, behind))), n_words))
    return F.when((F.length(F.trim(before)) < 20) | (n_words == 0), 1).when((least == n_words) | (least > 5), 5).otherwise(least)


def proximity_score(context: Column, distance: Column) -> Column:
    """Base score of the context; a label more than two words away loses a twentieth per word, up to three tenths."""
    base = lookup(context, BASE_SCORES, F.lit(0.5))
    far = F.greatest(F.lit(0.7), 1.0 - (distance - 2) * 0.05)
    return F.when((context == "label") & (distance > 2), base * far).otherwise(base)


def structure(text: Column, start: Column, stop: Column) -> Column:
    """struct<type, nesting, element> of 200 characters on either side, the most specific type first."""
    near, low = spans.around(text, start, stop, 200), F.lower(spans.around(text, start, stop, 200))
    kind = F.lit("plain_text")
    for name, pattern in reversed(STRUCTURES.items()):
        kind = F.when(has(near, pattern), name).otherwise(kind)
    count = lambda c: F.length(near) - F.length(F.replace(near, F.lit(c), F.lit("")))
    indent = F.array_max(F.transform(spans.lines(near), lambda x: F.length(x) - F.length(F.ltrim(F.replace(x, F.lit("\t"), F.lit(" "))))))
    nesting = (
        F.when(kind == "json", count("{") + count("[")).when(kind.isin("xml", "html"), F.floor(count("<") / 2).cast("int"))
        .when(kind == "yaml", F.floor(indent / 2).cast("int")).otherwise(0)
    )
    first = lambda options, default: F.coalesce(*[F.when(F.contains(low, F.lit(o)), F.lit(o)) for o in options], F.lit(default))
    element = F.when(kind == "html", first(("input", "textarea", "select"), "form")).when(kind == "sql", first(("select", "insert", "update", "delete"), "query")).otherwise("")
    return F.struct(kind.alias("type"), nesting.alias("nesting"), element.alias("element"))


def semantics(text: Column, start: Column, stop: Column) -> Column:
    """struct<confidence, indicators, types> of the 100 characters on either side, the match itself left out."""
    near = F.lower(F.concat(spans.before(text, start, 100), spans.after(text, stop, 100)))
    score, marks = F.lit(0.5), []
    for found, gain in ((PERSON_WORDS, 0.1), (("ssn",), 0.2), (DOUBT_WORDS, -0.2)):
        for w in found:
            score = score + F.when(F.contains(near, F.lit(w)), gain).otherwise(0.0)
            marks.append(F.when(F.contains(near, F.lit(w)), F.lit(w)))
    for found, gain, names in GROUP_WORDS.values():
        test = contains_any(near, found)
        score = score + F.when(test, gain).otherwise(0.0)
        marks += [F.when(test, F.lit(n)) for n in names]
    hints = F.array_compact(F.array(*[F.when(contains_any(near, w), F.lit(k)) for k, w in TYPE_HINTS.items()]))
    bounded = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    return F.struct(bounded.alias("confidence"), F.array_distinct(F.array_compact(F.array(*marks))).alias("indicators"), hints.alias("types"))


def is_test_match(text: Column, value: Column, start: Column, stop: Column) -> Column:
    """Is there a test word within 30 characters?"""
    return has(F.concat(spans.before(text, start, 30), value, spans.after(text, stop, 30)), TEST_DATA)


def analysis(text: Column, value: Column, start: Column, stop: Column) -> Column:
    """struct<score, reason, context, is_test, distance>: test data has score 0.1 and ends the analysis."""

    def tested(near: Column) -> Column:
        low, why = F.lower(near), F.lit("test data indicator")
        for w in reversed(TEST_REASONS):
            why = F.when(F.contains(low, F.lit("demo " if w == "demo" else w)), F.lit(f"{w} data indicator")).otherwise(why)
        none = F.lit(None).cast("int")
        return F.struct(F.lit(0.1).alias("score"), why.alias("reason"), F.lit("test").alias("context"), F.lit(True).alias("is_test"), none.alias("distance"))

    def placed(context: Column, distance: Column) -> Column:
        why = lookup(context, REASONS, F.lit("general context"))
        score = proximity_score(context, distance)
        return F.struct(score.alias("score"), why.alias("reason"), context.alias("context"), F.lit(False).alias("is_test"), distance.cast("int").alias("distance"))

    def real(window: Column) -> Column:
        before = spans.before(text, start, 50)
        far = lambda c: F.when(c == "label", label_distance(before, labels(window))).when(c == "production", 5).otherwise(1)
        both = let(detector_context(window), lambda c: F.struct(c.alias("c"), far(c).alias("d")))
        return let(both, lambda x: placed(x["c"], x["d"]))

    near = F.concat(spans.before(text, start, 30), value, spans.after(text, stop, 30))
    return let(near, lambda n: F.when(has(n, TEST_DATA), tested(n)).otherwise(let(detector_window(text, value, start, stop), real)))


def enhanced(text: Column, value: Column, confidence: Column, risk: Column) -> Column:
    """struct<confidence, context_modifier, risk_level, before, after>: a finding after analysis at its first occurrence."""

    def result(at: Column, a: Column) -> Column:
        return F.struct(
            (confidence * a["score"]).alias("confidence"),
            F.when(a["is_test"], 0.1).otherwise(a["score"]).alias("context_modifier"),
            F.when(a["is_test"], "LOW").otherwise(risk).alias("risk_level"),
            spans.before(text, at, 25).alias("before"),
            spans.after(text, at + F.length(value), 25).alias("after"),
        )

    at = F.greatest(F.instr(text, value) - 1, F.lit(0))
    return let(at, lambda p: let(analysis(text, value, p, p + F.length(value)), lambda a: result(p, a)))

"""Credentials in source text: keyword automaton, issuer formats, structure checks, placeholders of the same shape.

1. One Aho-Corasick automaton over the lower-case text names the rules that can match; most texts name none and are
   done.
2. Each named rule's pattern is applied to the whole text: an assignment of any spelling, an authorization header,
   user and password of a URL or command, an issuer's token format, or a private key block.
3. The value must not be a placeholder, a reference (variable, template, vault, call), a UUID or a content hash, and
   must hold the structure of its kind (a JWT's header is JSON, Basic credentials decode to user and password, a key
   block is base64...).  Tokens that carry a CRC32 (GitHub's, npm's) and pass it are taken at once; one that fails must
   still look random, as issuers' older formats carry none.
4. Values are replaced by placeholders of equal length whose letters and digits stay in the same alphabet, in every
   given text of the row, so the code around them keeps its syntax and its offsets.

Cases: null texts stay null; empty texts have no credentials; a value met in one text of a row is also replaced where
it stands in the others, a value under eight characters only where it stands alone; texts are searched whole, however
long, in bounded batches.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sundew.llm.words import pieces
from sundew.session import once

KEY_NAMES = (
    "access_key", "access_token", "accesstoken", "api_key", "api-key", "api_secret", "apikey", "auth_key", "auth_token",
    "authtoken", "client_secret", "clientsecret", "credential", "credentials", "db_pass", "db_password", "encryption_key",
    "passphrase", "passwd", "password", "private_token", "pwd", "secret", "secret_key", "signing_key", "smtp_password", "token",
)
#: Automaton keywords of each rule; all lower case.
RULE_KEYWORDS = {
    "assign": KEY_NAMES,
    "basic": ("basic ",),
    "bearer": ("bearer ",),
    "url": ("://",),
    "command": (" -u ", " --user "),
    "block": ("private key-----",),
    "aws": ("akia", "asia"),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"),
    "stripe": ("sk_live_", "rk_live_"),
    "bot": ("xwb-", "xoxb-", "xoxp-", "xoxa-"),
    "tok": ("tok_",),
    "pat": ("pat.", "glpat-"),
    "mail": ("key-",),
    "jwt": ("eyj",),
    "google": ("aiza", "ya29."),
    "hook": ("hooks.slack.com/services/",),
    "npm": ("npm_",),
    "sendgrid": ("sg.",),
    "azure": ("accountkey=", "sharedaccesskey="),
}
VALUE = r"""[^\s"'<>,;()\\`]+"""
_KEYS = "|".join(sorted((re.escape(k) for k in KEY_NAMES), key=len, reverse=True))
#: Name of a variable that ends in a credential word, then what may stand between it and its value.
ASSIGN = re.compile(
    rf"""(?i)(?:(?P<flag>--?)|(?<![A-Za-z0-9]))(?:[A-Za-z0-9]+[_-])*(?:{_KEYS})
         (?:["']?[\ \t]*(?::=|=>|[:=])[\ \t]*|["']?>|(?=[\ \t])(?(flag)[\ \t]+|(?!))|[\ \t]*,[\ \t]*(?=["']))
         (?P<value>[^\r\n]*)""",
    re.VERBOSE,
)
PATTERNS = {
    "basic": re.compile(r"(?i:\bbasic)[ \t]+([A-Za-z0-9+/]{8,}={0,2})"),
    "bearer": re.compile(r"(?i:\bbearer)[ \t]+([A-Za-z0-9._~+/=-]{12,})"),
    "url": re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@\"'<>]*:([^\s/@\"'<>]+)@[A-Za-z0-9_.\[-]"),
    "command": re.compile(r"(?:^|\s)(?:-u|--user)[ =]+[\"']?[^\s:\"']+:([^\s\"']+)"),
    "block": re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----((?:\s|\\r|\\n|[A-Za-z0-9+/=:,-](?!----))*[A-Za-z0-9+/=])"),
    "aws": re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[0-9A-Z]{16})(?![A-Za-z0-9])"),
    "github": re.compile(r"(?<![A-Za-z0-9_])(gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,})(?![A-Za-z0-9])"),
    "stripe": re.compile(r"(?<![A-Za-z0-9_])([sr]k_live_[A-Za-z0-9]{16,})"),
    "bot": re.compile(r"(?<![A-Za-z0-9-])(xwb-[A-Za-z0-9]{16,}|xox[bpa]-[A-Za-z0-9-]{16,})"),
    "tok": re.compile(r"(?<![A-Za-z0-9_])(tok_[A-Za-z0-9]{16,})(?![A-Za-z0-9_])"),
    "pat": re.compile(r"(?<![A-Za-z0-9.])(pat\.[A-Za-z0-9]{16,}|glpat-[A-Za-z0-9_-]{16,})"),
    "mail": re.compile(r"(?<![A-Za-z0-9-])(key-[A-Za-z0-9]{20,})(?![A-Za-z0-9-])"),
    "google": re.compile(r"(?<![A-Za-z0-9_-])(AIza[0-9A-Za-z_-]{35}|ya29\.[0-9A-Za-z_-]{20,})(?![A-Za-z0-9_-])"),
    "hook": re.compile(r"hooks\.slack\.com/services/(T[A-Za-z0-9]{6,}/B[A-Za-z0-9]{6,}/[A-Za-z0-9]{16,})"),
    "npm": re.compile(r"(?<![A-Za-z0-9_])(npm_[A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "sendgrid": re.compile(r"(?<![A-Za-z0-9_-])(SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43})(?![A-Za-z0-9_-])"),
    "azure": re.compile(r"(?i:AccountKey|SharedAccessKey)=([A-Za-z0-9+/]{43,}={0,2})"),
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]{8,})"),
}
WRAPPERS = " \t\"'(<[`"
NOT_A_VALUE = re.compile(
    r"""(?ix)^(?:
        \$\{|\$\(|\$[A-Z_]|\{\{|%\(|%[A-Z_]+%|<?your[-_ ]|\#\{                     # variables and templates
      | <%|@@|vault:|ssm:|arn:|secretsmanager:|op://|keyring:|env[.:(]|file:       # stores
      | os\.(?:environ|getenv)|process\.env|System\.getenv|getenv|ENV\[|config\[   # environment
      | change[-_ ]?me|change[-_ ]?it|x{4,}|\*{3,}|\.{3,}|_{3,}|replace[-_ ]?|insert[-_ ]|todo|tbd|example|dummy|sample
      | placeholder|redacted|\[?edited|removed|hidden|none\b|null\b|nil\b|true\b|false\b|undefined\b|n/a\b
      | sha(?:1|224|256|384|512)[-:]                                               # content hashes
      | [0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-z-])  # UUIDs
      | -----BEGIN                                                                 # key blocks have a rule of their own
      | ssh-(?:rsa|ed25519|dss)\s|ecdsa-
      | new\s | [A-Za-z_][\w.]*(?:\[[^\]]*\])?\(                                   # calls
    )"""
)
REFERENCE = re.compile(r"^[A-Za-z_][A-Za-z_]*(?:\.[A-Za-z_]\w*)+$|^[a-z]+$|^[A-Z_]+$|^\d{1,5}$|^[A-Z][a-z]+$|^0x[0-9a-f]{1,8}$")

#: What names a credential itself, so isn't one.
NAMING = frozenset((*KEY_NAMES, "user", "username", "string", "text", "value", "hidden", "input"))
#: Digits of the CRC32 at the end of a token.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _automaton():
    def build():
        import ahocorasick

        a = ahocorasick.Automaton()
        rules: dict[str, set[str]] = {}
        for rule, words in RULE_KEYWORDS.items():
            for w in words:
                rules.setdefault(w, set()).add(rule)
        for w, names in rules.items():
            a.add_word(w, tuple(sorted(names)))
        a.make_automaton()
        return a

    return once("secret keywords", build)


def crc_token(prefix: str, body: str) -> str:
    """A token of an issuer that ends in the CRC32 of its random part, in six base-62 digits."""
    n, digits = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return f"{prefix}_{body}{digits.rjust(6, '0')}"


def _issued(value: str) -> bool:
    """Does a token with room for a checksum pass it, or at least look random?"""
    prefix, _, rest = value.partition("_")
    return crc_token(prefix, rest[:-6]) == value or len(set(rest)) >= 4


def _json_header(part: str) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, TypeError, binascii.Error):
        return False


def _basic_pair(part: str) -> bool:
    """Does it decode to user:password, the password being no placeholder?"""
    try:
        text = base64.b64decode(part + "=" * (-len(part) % 4)).decode()
    except (ValueError, binascii.Error):
        return False
    user, colon, password = text.partition(":")
    return bool(user and colon and password) and text.isprintable() and not NOT_A_VALUE.match(password)


def _is_value(value: str, quoted: bool, least: int = 6) -> bool:
    if len(value) < least or NOT_A_VALUE.match(value):
        return False
    return value.lower() not in NAMING if quoted and value.isalpha() else not REFERENCE.match(value)


def _assigned(text: str, m: re.Match) -> list[tuple[int, int]]:
    """Spans of the credential in the rest of the line after a credential's name; parts joined by + are all of it."""
    spans: list[tuple[int, int]] = []
    at, end = m.start("value"), m.end("value")
    while at < end:
        start = at
        while start < end and text[start] in WRAPPERS:
            start += 1
        head = text[start:end]
        # a placeholder in angle brackets or a reference may begin within the wrappers
        if NOT_A_VALUE.match(head) or NOT_A_VALUE.match(text[at:end].lstrip(" \t\"'(`")):
            return []
        if re.match(r"(?i)(?:basic|bearer)[ \t]", head):
            return []
        v = re.match(VALUE, head)
        stop = start + v.end() if v else start
        if not v or not _is_value(v[0], start > 0 and text[start - 1] in "\"'" and text[stop : stop + 1] == text[start - 1]):
            return []
        if "://" in v[0]:
            return []
        spans.append((start, start + v.end()))
        more = re.compile(r"""["'][ \t]*\+[ \t]*(?=["'])""").match(text, start + v.end())
        if not more:
            break
        at = more.end()
    return spans


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, rule) of each credential value in the text, in order and without overlap."""
    if not text:
        return []
    rules: set[str] = set()
    for _, names in _automaton().iter(text.lower()):
        rules.update(names)
    if not rules:
        return []
    found: list[tuple[int, int, str]] = []
    for rule in rules:
        if rule == "assign":
            at = 0
            while m := ASSIGN.search(text, at):
                got = _assigned(text, m)
                found += [(a, b, rule) for a, b in got]
                at = got[-1][1] if got else m.start("value")
                if at <= m.start():
                    at = m.start() + 1
            continue
        for m in PATTERNS[rule].finditer(text):
            value = m[1]
            if rule in ("github", "npm") and not _issued(value):
                continue
            if rule == "jwt" and not _json_header(value.partition(".")[0]):
                continue
            if rule == "basic" and not _basic_pair(value):
                continue
            if rule in ("bearer", "url", "command") and (NOT_A_VALUE.match(value) or rule != "bearer" and len(value) < 4):
                continue
            if rule == "block" and len(re.sub(r"\\[rn]|\s", "", value)) < 16:
                continue
            found.append((m.start(1), m.end(1), rule))
    found.sort(key=lambda s: (s[0], -s[1]))
    kept: list[tuple[int, int, str]] = []
    for s in found:
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
    return kept


def placeholder(value: str) -> str:
    """Same length, same alphabets: lower-case letters become x (a in hex values), upper-case X (A), digits 0."""
    hexadecimal = re.fullmatch(r"[0-9a-fA-F]+", value) is not None
    low, high = ("a", "A") if hexadecimal else ("x", "X")
    breaks = {m.start() + 1 for m in re.finditer(r"\\[rn]", value)}
    return "".join(
        c if i in breaks else "0" if c.isdigit() else low if c.islower() else high if c.isupper() else c for i, c in enumerate(value)
    )


def redact(texts: list[str | None]) -> list[str | None]:
    """The texts of one row with every credential value replaced, wherever in the row it stands."""
    values: set[str] = set()
    out: list[str | None] = []
    for t in texts:
        at, parts = 0, []
        for a, b, _ in spans(t):
            values.add(t[a:b])
            parts += [t[at:a], placeholder(t[a:b])]
            at = b
        out.append(t if t is None else "".join(parts) + t[at:])
    for v in sorted(values, key=len, reverse=True):
        if len(v) >= 8:
            out = [t and t.replace(v, placeholder(v)) for t in out]
        elif any(t and v in t for t in out):
            alone = re.compile(rf"(?<![^\W_]){re.escape(v)}(?![^\W_])")
            out = [t and alone.sub(lambda m, p=placeholder(v): p, t) for t in out]
    return out


def find(df: DataFrame, id_column: str, text_columns: list[str]) -> DataFrame:
    """(id, rules): the rows of which a text holds a credential value, with the rules that found it."""
    schema = T.StructType([T.StructField(id_column, T.LongType()), T.StructField("rules", T.StringType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, list(range(1, whole.num_columns)), 2000):
                columns = [c.to_pylist() for c in batch.columns[1:]]
                at, rules = [], []
                for i, texts in enumerate(zip(*columns)):
                    got = {s[2] for t in texts for s in spans(t)}
                    if got:
                        at.append(i)
                        rules.append(",".join(sorted(got)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(rules, pa.string())], schema.names)

    return df.select(F.col(id_column).cast("bigint"), *[F.col(c).cast("string") for c in text_columns]).mapInArrow(kernel, schema)


def redacted(df: DataFrame, id_column: str, text_columns: list[str]) -> DataFrame:
    """All rows of ``df`` (id and texts) with the credentials of their texts replaced."""
    schema = T.StructType([T.StructField(id_column, T.LongType()), *[T.StructField(c, T.StringType()) for c in text_columns]])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, list(range(1, whole.num_columns)), 2000):
                rows = [redact(list(texts)) for texts in zip(*[c.to_pylist() for c in batch.columns[1:]])]
                columns = list(zip(*rows)) if rows else [()] * len(text_columns)
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), pa.string()) for c in columns]], schema.names)

    return df.select(F.col(id_column).cast("bigint"), *[F.col(c).cast("string") for c in text_columns]).mapInArrow(kernel, schema)

"""Personal details in free text: checked patterns, and a skip-chain CRF for names of people.

E-mail addresses, phones, identity numbers and street addresses are found by form and verified by structure (check
digits, labels, not part of a longer number or of a URL's user part).  Whether two or three words name a person is
decided by a conditional random field over the row's candidate spans.  Its nodes have features of cues and forms, its
chain edges join neighbours in a text.  Skip edges join equal or similar candidates anywhere in the row's texts: all
mentions of a name hang on one node for that name, which holds what is known of the name itself, so edges grow with the
mentions, not with their pairs, and a cue at one mention reaches all others however many they are (a mention without
cues is no evidence either way); names that differ by a slip are joined at these nodes.  Loopy belief propagation passes
messages over all rows of a batch at once until they settle.

The weights are trained here on ``TRAINING_ROWS`` rows from fixed generators of labelled sentences (cues below, invented
names), node weights by maximum likelihood of each name given its mentions, edge weights by pseudo-likelihood; no table
is read.  E-mail addresses, phones, identity numbers and addresses are patterns alone.

Cases: null and empty texts have no details; overlapping finds keep the longest of the first kind in ``KINDS`` order;
texts are read whole; a row without any candidate passes no messages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sundew.llm.words import one_slip, pieces

KINDS = ("EMAIL", "ADDRESS", "ID_NUMBER", "PHONE", "PERSON")
TRAINING_ROWS = 1500
#: Most rounds of messages, and the change under which they have settled.
ROUNDS = 60
SETTLED = 1e-3

USER = re.compile(r"[A-Za-z0-9_%+](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?$")
USER_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w@])")
AT_SIGN = re.compile(r"(?i)[(\[{<]\s?at\s?[)\]}>]")
SPELLED = re.compile(
    r"[A-Za-z0-9][A-Za-z0-9._%+-]*\s*(?:[(\[{<]\s*(?i:at)\s*[)\]}>]|\sAT\s)\s*"
    r"[A-Za-z0-9-]+(?:\s*(?:\.|[(\[{<]\s*(?i:dot)\s*[)\]}>]|\sDOT\s)\s*[A-Za-z0-9-]+)*?\s*(?:\.|[(\[{<]\s*(?i:dot)\s*[)\]}>]|\sDOT\s)\s*[A-Za-z]{2,}(?![\w])"
)
STREET = (
    "Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Terrace|Tce|Crescent|Cres|Close|Court|Ct|Drive|Dr|Place|Pl|Parade|Pde|Way|Boulevard|Blvd|"
    "Highway|Hwy|Square|Circuit|Grove|Esplanade|Walk|Row|Mews"
)
STATE = "NSW|VIC|QLD|SA|WA|TAS|NT|ACT"
_W = r"[^\W\d_][^\W\d_'’-]*"
ADDRESS = re.compile(
    rf"(?i)(?<![\w/.-])\d{{1,5}}[a-z]?(?:\s*/\s*\d{{1,5}}[a-z]?)?\s+(?:"
    rf"(?:{_W}\s+){{1,3}}(?:{STREET})\b\.?(?:[\s,;]{{1,3}}(?:{_W}[\s,;]{{1,3}}){{1,4}}(?:{STATE})\b(?:[\s,;]{{1,3}}\d{{4}}\b)?)?"
    rf"|(?:{_W}[\s,;]{{1,3}}){{2,6}}(?:{STATE})[\s,;]{{1,3}}\d{{4}}\b)"
)
_S = r"[ \t.-]{0,2}"
_FREE = r"(?<![\w+/])(?<!\d[ \t.-])(?<!\d[ \t.-][ \t.-])(?<!\d\.)"
_END = r"(?!\w)(?![ \t.-]{1,2}\d)"
PHONE = re.compile(
    rf"{_FREE}(?:\+61{_S}(?:\(0\){_S})?[2-478]|(?<!\+)61{_S}[2-478]|\(0[2-478]\)|0[2-478])(?:{_S}\d){{8}}{_END}"
    rf"|{_FREE}\+61{_S}(?:\(0\){_S})?[2-478](?:{_S}\d){{8}}{_END}|{_FREE}1[38]00{_S}\d{{3}}{_S}\d{{3}}{_END}"
)
PLUS_PHONE = re.compile(rf"(?<![\w+])\+61{_S}(?:\(0\){_S})?[2-478](?:{_S}\d){{8}}{_END}")
TAX = re.compile(rf"{_FREE}\d{{3}}{_S}\d{{3}}{_S}\d{{3}}{_END}")
MEDICARE = re.compile(rf"{_FREE}[2-6]\d{{3}}{_S}\d{{5}}{_S}\d(?:/\d)?{_END}")
LICENCE = re.compile(
    r"(?i)(?<![a-z])(?:driv\w{0,4}['’]?s?[ \t_-]*licen[cs]e|licen[cs]e[ \t_-]*(?:no|num|number|id)(?![a-z])|DL[ \t_-]*(?:no|num|number|#)(?![a-z]))"
    r"(?:[ \t_-]*(?:no|num|number|id)(?![a-z]))?[\"'”\s:=#.]{0,6}(\d{4}[ -]?\d{4}|[A-Z]{0,2}\d{5,10})(?!\w)"
)
PASSPORT = re.compile(r"(?i)(?<![a-z])(?:passport|travel[ \t_-]*document)(?:[ \t_-]*(?:no|num|number|id)(?![a-z]))?[\"'”\s:=#.]{0,6}([A-Z]{1,2}[ -]?\d{7})(?!\w)")
DIGIT = re.compile(r"\d")
TYPED_LICENCE = re.compile(r"(?<!\w)(?:\d{4}[ -]?\d{4}|[A-Za-z]{0,2}\d{5,10})(?!\w)")
TYPED_PASSPORT = re.compile(r"(?<!\w)[A-Za-z]{1,2}[ -]?\d{7}(?!\w)")

#: Weights of the digits of tax file and Medicare numbers; fixed values.
TAX_WEIGHTS = (1, 4, 3, 7, 5, 8, 6, 9, 10)
MEDICARE_WEIGHTS = (1, 3, 7, 9, 1, 3, 7, 9)

#: Words before a person's name, and what people do after it.
PERSON_CUES = (
    "by", "to", "ask", "caller", "dear", "owner", "author", "contact", "customer", "customername", "beneficiary", "attn", "from",
    "patient", "client", "name", "fullname", "full_name", "employee", "member", "members", "user", "login", "payee", "cc",
    "regards", "signed", "reported-by", "reviewer", "spoke", "called", "manager", "holder", "tenant_name",
)
TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof", "sir")
PERSON_VERBS = ("lodged", "moved", "gave", "said", "wrote", "signed", "called", "asked", "lives", "phoned", "visited", "over", "on", "claims", "reported")
#: Words of things that are named like people: products, teams, places, companies, documents.
THING_WORDS = (
    "gateway", "module", "bridge", "warehouse", "pipeline", "release", "cluster", "ledger", "branch", "office", "team", "group", "service",
    "server", "project", "product", "holdings", "pty", "ltd", "limited", "inc", "company", "bank", "institute", "university", "school",
    "street", "road", "lane", "avenue", "terrace", "court", "drive", "place", "parade", "square", "map", "public", "terms", "license",
    "licence", "main", "modules", "data", "centre", "center", "phase", "two", "strategy", "system", "platform", "engine", "portal",
    "suite", "manager", "controller", "framework", "library", "department", "division", "unit", "station", "tower", "park",
    "heights", "authors", "tax", "file", "number", "medicare", "supplier", "telephone", "address", "internal", "use", "only", "general",
    "version", "api", "key", "begin", "certificate", "public", "private", "network", "queue", "database", "schema", "registry", "console", "hub",
)
THING_CUES = ("title", "target", "deploy", "the", "see", "license", "module", "project", "release", "h1", "h2", "h3", "product", "app", "service", "system", "new")
THING_VERBS = ("ready", "restarts", "notes", "widget", "starts", "build", "deployed", "map", "failed", "stopped", "release", "section", "version", "public", "terms")

_NAME = r"[^\W\d_]['’]?[^\W\d_]+(?:['’-][^\W\d_]+)*"
_CAP = r"[A-Z]['’]?[^\W\d_]+(?:['’-][^\W\d_]+)*"
_WRAP = "[ \\t\"'“‘(<]{0,4}"
#: Two words after the sign that follows a field's name; capitalised words in prose; any two after a strong cue.
FIELD = re.compile(rf"[:=>][ \t]{{0,2}}{_WRAP}(?P<name>{_NAME}(?:[ \t]*,[ \t]*|[ \t]+){_NAME})(?![\w@.(])")
PROSE = re.compile(rf"(?<![\w@.])(?P<name>{_CAP}(?:[ \t]*,[ \t]*|[ \t]+){_CAP})(?![\w@(])")
STRONG = re.compile(
    rf"(?i:(?<![^\W_])(?:dear|attn|login\ by|signed\ (?:off\ )?by|mrs?|ms|miss|dr)[.,:]?[ \t]{{1,2}}){_WRAP}(?P<name>{_NAME}(?:[ \t]*,[ \t]*|[ \t]+){_NAME})(?![\w@.(])"
)
VALUES = re.compile(rf"(?i)\bVALUES\s*\([\d\s,]*[\"']{{1,2}}[\s(<]*(?P<name>{_NAME}(?:[ \t]*,[ \t]*|[ \t]+){_NAME})(?![\w@])")
_TITLE_CASE = r"[A-Z](?:['’][A-Z])?[a-zà-ÿ]+(?:['’-][A-Za-zà-ÿ]+)*"
CAPITALISED = re.compile(rf"(?<![\w@.])(?P<name>{_TITLE_CASE}(?:[ \t]+{_TITLE_CASE}){{1,2}})(?![\w@(])")
WHOLE = re.compile(rf"^[\s\"'“”‘’(<\[;,]*(?P<name>{_NAME}(?:\s*,\s*|\s+){_NAME}(?:\s+{_NAME})?)[\s\"'“”‘’)>\];,.]*$")
WORDS = re.compile(r"[^\W\d_]+")

FEATURES = ("bias", "thing_word", "title", "person_cue", "person_verb", "detail_near", "thing_cue", "thing_verb", "swapped", "lower", "upper", "bare", "typed")
#: The first of these are of the name, the others of one mention of it.
NAME_FEATURES = 2


def _digits(s: str) -> str:
    return re.sub(r"\D", "", s)


def tax_number(s: str) -> bool:
    d = _digits(s)
    return len(d) == 9 and d.strip("0") != "" and sum(int(a) * b for a, b in zip(d, TAX_WEIGHTS)) % 11 == 0


def medicare_number(s: str) -> bool:
    d = _digits(s.partition("/")[0])
    return len(d) == 10 and d[0] in "23456" and sum(int(a) * b for a, b in zip(d, MEDICARE_WEIGHTS)) % 10 == int(d[8])


def _in_url_user(text: str, at: int) -> bool:
    """Is the position within the user part of a URL, that is, after :// without white space between?"""
    start = text.rfind("://", 0, at)
    return start >= 0 and not re.search(r"[\s\"'<>/]", text[start + 3 : at])


def plain_details(text: str, kind: str | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all details but names, in order and without overlap; ``kind`` is the type given to a bare match."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        for at in re.finditer("@", text):
            first = at.start()
            while first and text[first - 1] in USER_LETTERS:
                first -= 1
            host, user = HOST.match(text, at.end()), USER.search(text[first : at.start()].lstrip(".-"))
            if not host or not user:
                continue
            start, after = at.start() - len(user[0]), text[host.end() : host.end() + 2]
            if _in_url_user(text, start) or (after[:1] == ":" and (after[1:].isalpha() or after[1:] in "/~") and after[1:]):
                continue
            found.append((start, host.end(), "EMAIL"))
    if "AT " in text or AT_SIGN.search(text):
        found += [(m.start(), m.end(), "EMAIL") for m in SPELLED.finditer(text)]
    if DIGIT.search(text):
        found += [(m.start(), m.end(), "ADDRESS") for m in ADDRESS.finditer(text)]
        found += [(m.start(), m.end(), "PHONE") for m in PHONE.finditer(text)]
        if "+61" in text:
            found += [(m.start(), m.end(), "PHONE") for m in PLUS_PHONE.finditer(text)]
        found += [(m.start(), m.end(), "ID_NUMBER") for m in TAX.finditer(text) if tax_number(m[0])]
        found += [(m.start(), m.end(), "ID_NUMBER") for m in MEDICARE.finditer(text) if medicare_number(m[0])]
        lower = text.lower()
        if "licen" in lower or "dl" in lower:
            found += [(m.start(1), m.end(1), "ID_NUMBER") for m in LICENCE.finditer(text)]
        if "passport" in lower or "travel" in lower:
            found += [(m.start(1), m.end(1), "ID_NUMBER") for m in PASSPORT.finditer(text)]
        if kind in ("DRIVERLICENSE", "DRIVERLICENCE") and not found:
            found += [(m.start(), m.end(), "ID_NUMBER") for m in TYPED_LICENCE.finditer(text)]
        if kind == "PASSPORT" and not found:
            found += [(m.start(), m.end(), "ID_NUMBER") for m in TYPED_PASSPORT.finditer(text)]
    if len(found) > 1:
        found.sort(key=lambda s: (s[0], KINDS.index(s[2]), -s[1]))
        kept = found[:1]
        for s in found[1:]:
            if s[0] >= kept[-1][1]:
                kept.append(s)
        return kept
    return found


_THINGS = frozenset(THING_WORDS)
_BY_LENGTH: dict[int, list[str]] = {}
for _t in sorted(_THINGS):
    if len(_t) >= 5:
        for _n in (len(_t) - 1, len(_t), len(_t) + 1):
            _BY_LENGTH.setdefault(_n, []).append(_t)
_THING_MEMORY: dict[str, bool] = {}


def is_thing(word: str) -> bool:
    """Is the word one for things, slips of spelling included?"""
    if word in _THINGS:
        return True
    known = _THING_MEMORY.get(word)
    if known is None:
        if len(_THING_MEMORY) > 100_000:
            _THING_MEMORY.clear()
        known = _THING_MEMORY[word] = any(one_slip(word, t) for t in _BY_LENGTH.get(len(word), ()) if t[0] == word[0] or t[1] == word[0] or t[-1] == word[-1])
    return known


PEOPLE_VALUES = re.compile(r"(?i)(?:members|customers|users|people|persons|patients|clients)\W+VALUES")
_BEFORE = re.compile(r"([^\W\d_][\w-]*)\W*$")
_AFTER = re.compile(r"(?:(?!\n)\W){0,3}([^\W\d_]+)")
_CUE_SET, _TITLE_SET, _PERSON_VERB_SET = frozenset(PERSON_CUES), frozenset(TITLES), frozenset(PERSON_VERBS)
_THING_CUE_SET, _THING_VERB_SET = frozenset(THING_CUES), frozenset(THING_VERBS)


_ALL_CUES = _CUE_SET | _TITLE_SET | _THING_CUE_SET
_NAMING = _CUE_SET | _TITLE_SET
_PARTS = re.compile(r"[A-Z]?[a-z]+\d?|[A-Z]+")
_HAS_STRONG = re.compile(r"(?i)\b(?:dear|attn|by|mrs?|ms|miss|dr)\b")


def _cues(text: str, at: int) -> set[str]:
    """The word before a position of its line, in lower case, and the parts of its camelCase or snake_case."""
    line, look = text.rfind("\n", 0, at) + 1, 40
    while True:  # farther back only where the word, or what follows it, is that long
        first = max(line, at - look)
        m = _BEFORE.search(text[first:at])
        if first == line or (m and m.start()):
            break
        look *= 4
    if not m:
        return set()
    parts = {p.lower() for p in _PARTS.findall(m[1])}
    return set() if parts & {"secret", "token", "key", "password", "pass"} else {m[1].lower(), *parts}


def _normal(words: list[str]) -> str:
    return " ".join(sorted(w.lower() for w in words))


def candidates(
    text: str, details: list[tuple[int, int, str]], bare: bool, typed: bool, known: frozenset[str] = frozenset()
) -> list[tuple[int, int, str, list[float]]]:
    """(start, end, normalized name, features) of each span that may name a person.

    Three capitalised words of which two are a ``known`` name are that name beside a word that began or ended a sentence.
    """
    spans: dict[int, int] = {}
    if bare:
        m = WHOLE.match(text)
        if m:
            spans[m.start("name")] = m.end("name")
    else:
        found = []
        at = 0
        while m := CAPITALISED.search(text, at):  # a cue that is capitalised itself is no part of the name
            at = m.end()
            first, _, rest = m["name"].replace("\t", " ").partition(" ")
            cue = first.lower() in _NAMING
            if known and " " in rest.strip():
                w = list(WORDS.finditer(text, m.start("name"), m.end("name")))
                two = next((x for x in (w[:2], w[-2:]) if len(w) == 3 and _normal([y[0] for y in x]) in known), None)
                if two:
                    at = two[1].end()
                    found.append((two[0].start(), at))
                    continue
            if not cue or " " in rest.strip():
                found.append((m.end("name") - len(rest.lstrip()) if cue else m.start("name"), m.end("name")))
        found += [m.span("name") for m in FIELD.finditer(text) if _cues(text, m.start()) & _ALL_CUES]
        if "VALUES" in text:
            found += [m.span("name") for m in VALUES.finditer(text)]
        found += [m.span("name") for m in PROSE.finditer(text) if _cues(text, m.start()) & _NAMING]
        if _HAS_STRONG.search(text):
            found += [m.span("name") for m in STRONG.finditer(text)]
        for a, b in found:
            if not any(s < b and a < e for s, e in spans.items()):
                spans[a] = b
    out = []
    people = []  # from VALUES of a table of people to the end of its statement
    if "VALUES" in text.upper():
        for m in PEOPLE_VALUES.finditer(text):
            people.append((m.end(), min(x for x in (text.find(";", m.end()), text.find("\n", m.end()), len(text)) if x >= 0)))
    for a, b in sorted(spans.items()):
        if any(s < b and a < e for s, e, _ in details):
            continue
        name = text[a:b]
        after, cues = _AFTER.match(text, b), _cues(text, a)
        verb = after[1].lower() if after else ""
        words = [w.lower() for w in WORDS.findall(name)]
        near = any(0 <= s - b <= 24 and "\n" not in text[b:s] for s, _, k in details if k in ("EMAIL", "PHONE", "ADDRESS"))
        listed = people and any(p <= a <= q for p, q in people)
        x = [
            1.0,
            float(any(map(is_thing, words))),
            float(bool(cues & _TITLE_SET)),
            float(bool(listed or cues & _CUE_SET)),
            float(verb in _PERSON_VERB_SET),
            float(near),
            float(bool(cues & _THING_CUE_SET)),
            float(verb in _THING_VERB_SET),
            float("," in name),
            float(name.islower()),
            float(name.isupper()),
            float(bare),
            float(bare and typed),
        ]
        out.append((a, b, _normal(words), x))
    return out


def row_candidates(texts: list[str | None], found: list[list[tuple[int, int, str]]], typed: bool) -> list[list[tuple[int, int, str, list[float]]]]:
    """The candidates of each text of a row; the first text is the bare match."""
    got = [candidates(t, found[i], i == 0, typed) if t else [] for i, t in enumerate(texts)]
    names = {c[2] for cs in got for c in cs}
    known = frozenset(n for n in names if n.count(" ") == 1)
    if known and len(known) < len(names):
        for i, cs in enumerate(got):
            if i and any(c[2].count(" ") == 2 for c in cs):
                got[i] = candidates(texts[i], found[i], False, typed, known)
    return got


def similar(names: list[str]) -> list[tuple[int, int]]:
    """Pairs of distinct names one slip apart, found by keys: a name without one letter, or with two letters swapped.

    Names that differ in the same place are joined to the first of them, so pairs grow with the names' letters only.
    """
    sizes = {len(n) for n in names}
    full = {n: i for i, n in enumerate(names)}
    first: dict[tuple[int, str], int] = {}
    pairs = set()
    for i, n in enumerate(names):
        shorter, same = len(n) - 1 in sizes, sum(len(m) == len(n) for m in names[:64]) > 1 or len(names) > 64
        if not shorter and not same:
            continue
        for k in range(len(n)):
            cut = n[:k] + n[k + 1 :]
            if shorter and cut in full:
                pairs.add((min(i, full[cut]), max(i, full[cut])))
            if same:
                j = first.setdefault((k, cut), i)
                if j != i:
                    pairs.add((j, i))
                if k + 1 < len(n) and (j := full.get(n[:k] + n[k + 1] + n[k] + n[k + 2 :], i)) < i:
                    pairs.add((j, i))
    return sorted(pairs)


def edges_of(names: list[str], chains: list[int]) -> tuple[list[int], list[tuple[int, int]], list[tuple[int, int]]]:
    """(number of each mention's name, chain edges among mentions, edges among names one slip apart) of one row's
    candidates; ``chains`` numbers the text of each.  Neighbours of one name need no chain edge, and two names that stand
    beside each other again get no second one: messages going round such loops would count one cue many times."""
    pairs: dict[tuple[str, str], tuple[int, int]] = {}
    for i in range(len(names) - 1):
        if chains[i] == chains[i + 1] and names[i] != names[i + 1]:
            pairs.setdefault((min(names[i : i + 2]), max(names[i : i + 2])), (i, i + 1))
    chain = list(pairs.values())
    number: dict[str, int] = {}
    of = [number.setdefault(n, len(number)) for n in names]
    return of, chain, similar(list(number)) if len(number) > 1 else []


def beliefs(score: np.ndarray, edges: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Loopy belief propagation for binary labels: log-odds of label 1 per node.

    Each edge prefers equal labels by ``weight``.  Messages are log-odds, updated in parallel and damped, until none
    changes by more than ``SETTLED``.
    """
    if not len(edges):
        return score
    a = np.concatenate([edges[:, 0], edges[:, 1]])
    b = np.concatenate([edges[:, 1], edges[:, 0]])
    w = np.concatenate([weight, weight])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    message = np.zeros(len(a))
    for i in range(ROUNDS):
        total = score + np.bincount(b, message, len(score))
        x = total[a] - message[back]
        new = np.logaddexp(0, w + x) - np.logaddexp(w, x)
        if i:
            new = 0.25 * message + 0.75 * new
        moved = np.abs(new - message).max()
        message = new
        if moved < SETTLED:
            break
    return score + np.bincount(b, message, len(score))


class SkipChainCrf:
    """Node weights over ``FEATURES``, and one weight each for edges between neighbours, a mention and its name, and names
    one slip apart."""

    def __init__(self, node: np.ndarray, chain: float, mention: float, slip: float) -> None:
        self.node, self.chain, self.mention, self.slip = node, chain, mention, slip

    def decide(self, rows: list[list[tuple[str, int, list[float]]]]) -> list[list[bool]]:
        """Per row and candidate (name, text number, features): does it name a person?"""
        features, of_name, pairs, weights, at, names = [], [], [], [], 0, 0
        count = sum(map(len, rows))
        first_of: list[int] = []  # a mention of each name
        for row in rows:
            of, chain, slips = edges_of([n for n, _, _ in row], [c for _, c, _ in row])
            pairs += [(at + i, at + j) for i, j in chain] + [(count + names + i, count + names + j) for i, j in slips]
            weights += [self.chain] * len(chain) + [self.slip] * len(slips)
            for i, k in enumerate(of):
                if names + k == len(first_of):
                    first_of.append(at + i)
            of_name += [names + k for k in of]
            features += [x for _, _, x in row]
            at += len(row)
            names = len(first_of)
        if not at:
            return [[] for _ in rows]
        x, n = np.array(features), NAME_FEATURES
        score = np.concatenate([x[:, n:] @ self.node[n:], x[first_of, :n] @ self.node[:n]])
        hung = np.stack([np.arange(count), np.array(of_name) + count], 1)
        edges = np.concatenate([np.array(pairs, np.int64).reshape(-1, 2), hung])
        odds = beliefs(score, edges, np.concatenate([np.array(weights), np.full(count, self.mention)]))
        out, at = [], 0
        for row in rows:
            out.append((odds[at : at + len(row)] > 0).tolist())
            at += len(row)
        return out


def training_rows(seed: int = 11) -> list[tuple[list[tuple[str, bool]], bool]]:
    """Labelled rows: lists of (text with one candidate, names a person?), with a flag whether the first is a bare match."""
    rng = np.random.default_rng(seed)
    starts, ends = ("ba", "de", "li", "mo", "ra", "su", "te", "vo", "ka", "ne"), ("rin", "lan", "mere", "sen", "ton", "dale", "vik", "bury")
    pick = lambda options: options[int(rng.integers(len(options)))]
    word = lambda: (pick(starts) + pick(starts) + pick(ends)).capitalize()
    things = [w.capitalize() for w in THING_WORDS]
    rows: list[tuple[list[tuple[str, bool]], bool]] = [([(f"{word().lower()} at {word()} {word()} {pick(('soon', 'again', 'here'))}", False)], False) for _ in range(TRAINING_ROWS // 5)]
    for _ in range(TRAINING_ROWS // 10):  # bare matches that the type alone speaks for
        person = bool(rng.integers(2))
        second = word() if person else pick(things)
        rows.append(([(f"{second}, {word()}" if rng.integers(4) == 0 else f"{word()} {second}", person)], True))
        name = f"{word()} {word()}"  # a thing that only its cue tells
        rows.append(([(name, False), (f"{pick(THING_CUES)}: {name}", False)], True))
    for _ in range(TRAINING_ROWS):
        person = bool(rng.integers(2))
        first, second = word(), word() if person else pick(things)
        form = pick(("plain", "plain", "lower", "upper", "swapped"))
        name = f"{second}, {first}" if form == "swapped" else f"{first} {second}"
        name = name.lower() if form == "lower" else name.upper() if form == "upper" else name
        if person:
            cued = pick(
                [f'{c}{s}{name}' for c in PERSON_CUES for s in (": ", " = \"", "=", " ")] + [f"{t.capitalize()} {name} {v} it" for t in TITLES for v in PERSON_VERBS[:6]]
                + [f"call {name} on 0400 000 000", f"{name} <x@y.example>"]
            )
        else:
            cued = pick([f'{c}{s}{name}' for c in THING_CUES for s in (": ", " = \"", " ", ">")] + [f"// {name} {v} at night" for v in THING_VERBS] + [f"{pick(PERSON_CUES)}: {name}"])
        row = [(cued, person)]
        bare = bool(rng.integers(2))
        if bare:
            row.insert(0, (name, person))
        if rng.integers(3) == 0:  # more mentions without a cue, some with a slip; now and then the same words mean something else
            for _ in range(int(rng.integers(1, 5))):
                k = int(rng.integers(1, len(name) - 1))
                said = name[:k] + name[k + 1 :] if rng.integers(4) == 0 else name
                row.append((f"again {pick(('seen', 'met', 'with', 'then'))} {said} {pick(('here', 'soon', 'later'))}", person ^ (rng.integers(40) == 0)))
        if rng.integers(3) == 0:
            row.append((f"{pick(THING_CUES)}: {word()} {pick(things)}", False) if rng.integers(2) else (f"{pick(PERSON_CUES)}: {word()} {word()}", True))
        rows.append((row, bare))
    return rows


def training_lists(seed: int = 12) -> list[tuple[str, list[bool]]]:
    """Labelled texts with several candidates each: neighbours are mostly of one sort, as in a list of recipients."""
    rng = np.random.default_rng(seed)
    starts, ends = ("ba", "de", "li", "mo", "ra", "su", "te", "vo", "ka", "ne"), ("rin", "lan", "mere", "sen", "ton", "dale", "vik", "bury")
    pick = lambda options: options[int(rng.integers(len(options)))]
    word = lambda: (pick(starts) + pick(starts) + pick(ends)).capitalize()
    texts = []
    for _ in range(TRAINING_ROWS // 3):
        labels = [bool(rng.integers(2))]
        while len(labels) < int(rng.integers(2, 6)):
            labels.append(labels[-1] ^ (rng.integers(3) == 0))
        parts = [f"{word()} {word() if y else pick(THING_WORDS).capitalize()}" for y in labels]
        cued = [f"{pick(PERSON_CUES if y else THING_CUES)}: {p}" if rng.integers(2) else f"again {p}" for y, p in zip(labels, parts)]
        texts.append((" / ".join(cued), labels))
    return texts


def trained() -> SkipChainCrf:
    """Node weights by maximum likelihood of each name's label given all its mentions (names that may owe their label
    to another name aside), then the weight of each kind of edge by pseudo-likelihood: labels given their scores and
    their neighbours' (those of chains without scores, as beside each other stand mostly names that have none)."""
    rows = []  # of (name, text number, features, label)
    for row, bare in training_rows():
        got = [(candidates(t, plain_details(t), bare and i == 0, bare and i == 0), y) for i, (t, y) in enumerate(row)]
        rows.append([(c[0][2], i, c[0][3], y) for i, (c, y) in enumerate(got) if c])
    for text, labels in training_lists():
        got = candidates(text, plain_details(text), False, False)
        if len(got) == len(labels):
            rows.append([(n, 0, x, y) for (_, _, n, x), y in zip(got, labels)])
    names, truth, graphs = [], [], []
    n = NAME_FEATURES
    for nodes in rows:
        of, chain, slips = edges_of([name for name, _, _, _ in nodes], [c for _, c, _, _ in nodes])
        held = [[m for m, k in zip(nodes, of) if k == j] for j in range(max(of, default=-1) + 1)]
        graphs.append((nodes, [len(names) + k for k in of], chain, [(len(names) + i, len(names) + j) for i, j in slips]))
        names += [h[0][2][:n] + np.sum([m[2][n:] for m in h], 0).tolist() for h in held]
        truth += [2 * sum(m[3] for m in h) >= len(h) for h in held]
    tied = {max(e) for _, _, _, slips in graphs for e in slips} | {of[i] for _, of, chain, _ in graphs for e in chain for i in e}
    x, y = np.array(names), np.array(truth, float)
    alone = np.array([i not in tied for i in range(len(y))])
    w = _logistic(x[alone], y[alone])
    score, sign = x @ w, 2 * y - 1
    mentions = [(sign[k], float(np.dot(m[2][n:], w[n:])), m[3]) for nodes, of, _, _ in graphs for m, k in zip(nodes, of)]
    neighbours = [(2.0 * nodes[j][3] - 1, 0.0, nodes[i][3]) for nodes, of, chain, _ in graphs for p in chain for i, j in (p, p[::-1])]
    slips = [(sign[j], score[i], y[i]) for _, _, _, found in graphs for p in found for i, j in (p, p[::-1])]
    weight = lambda rows: float(max(_logistic(np.array([[r[0]] for r in rows]), np.array([r[2] for r in rows], float), np.array([r[1] for r in rows]))[0], 0.0))
    return SkipChainCrf(w, weight(neighbours), weight(mentions), weight(slips))


def _logistic(x: np.ndarray, y: np.ndarray, base: np.ndarray | float = 0.0) -> np.ndarray:
    """Weights of a logistic regression with fixed base log-odds, by gradient ascent with a little decay."""
    w = np.zeros(x.shape[1])
    for _ in range(800):
        p = 1 / (1 + np.exp(-(x @ w + base)))
        w += 1.0 * (x.T @ (y - p) / len(y) - 2e-4 * w)
    return w


def details(rows: list[tuple[str | None, list[str | None]]], crf: SkipChainCrf) -> list[list[list[tuple[int, int, str]]]]:
    """Per row (type, texts; the first text is the bare match) and text the spans of all details."""
    plain, pending, at = [], [], []
    for kind, texts in rows:
        kind = re.sub(r"[^A-Z]", "", kind.upper()) if kind else None
        found = [plain_details(t, kind if i == 0 else None) if t else [] for i, t in enumerate(texts)]
        names = [(n, i, x, a, b) for i, cs in enumerate(row_candidates(texts, found, kind == "NAME")) for a, b, n, x in cs]
        plain.append(found)
        if names:
            pending.append(names)
            at.append(len(plain) - 1)
    decided = crf.decide([[(n, i, x) for n, i, x, _, _ in names] for names in pending])
    for k, names, labels in zip(at, pending, decided):
        for (_, i, _, a, b), person in zip(names, labels):
            if person:
                plain[k][i].append((a, b, "PERSON"))
        for spans in plain[k]:
            spans.sort()
    return plain


def _columns(df: DataFrame, id_column: str, type_column: str, text_columns: list[str]) -> DataFrame:
    return df.select(F.col(id_column).cast("bigint").alias("_id"), F.col(type_column).cast("string").alias("_type"), *[F.col(c).cast("string").alias(f"_t{i}") for i, c in enumerate(text_columns)])


def find(df: DataFrame, id_column: str, type_column: str, text_columns: list[str], crf: SkipChainCrf | None = None) -> DataFrame:
    """(id, kind): each kind of detail found in a row's texts, once."""
    crf = crf or trained()
    schema = T.StructType([T.StructField(id_column, T.LongType()), T.StructField("kind", T.StringType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, list(range(2, whole.num_columns)), 2000):
                columns = [c.to_pylist() for c in batch.columns[1:]]
                got = details([(r[0], list(r[1:])) for r in zip(*columns)], crf)
                pairs = [(i, k) for i, texts in enumerate(got) for k in sorted({s[2] for spans in texts for s in spans})]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([i for i, _ in pairs], pa.int64())), pa.array([k for _, k in pairs], pa.string())], schema.names
                )

    return _columns(df, id_column, type_column, text_columns).mapInArrow(kernel, schema)


def masked(df: DataFrame, id_column: str, type_column: str, text_columns: list[str], crf: SkipChainCrf | None = None) -> DataFrame:
    """All rows with every detail replaced by its kind in square brackets; null texts stay null."""
    crf = crf or trained()
    schema = T.StructType([T.StructField(id_column, T.LongType()), *[T.StructField(c, T.StringType()) for c in text_columns]])

    def replaced(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
        if not spans:
            return text
        parts, at = [], 0
        for a, b, kind in spans:
            if a >= at:
                parts += [text[at:a], f"[{kind}]"]
                at = b
        return "".join(parts) + text[at:]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, list(range(2, whole.num_columns)), 2000):
                rows = [(r[0], list(r[1:])) for r in zip(*[c.to_pylist() for c in batch.columns[1:]])]
                got = details(rows, crf)
                columns = [[replaced(texts[i], spans[i]) for (_, texts), spans in zip(rows, got)] for i in range(len(text_columns))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string()) for c in columns]], schema.names)

    return _columns(df, id_column, type_column, text_columns).mapInArrow(kernel, schema)

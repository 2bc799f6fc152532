"""Settings: defaults, files in a small subset of YAML, environment, merging and checks; and rule files.  Driver only."""

from __future__ import annotations

import copy
import json
import os
import re
from pathlib import Path

from sundew.functions import patterns

DEFAULTS: dict[str, dict] = {
    "scanner": {"max_file_size": 10 * 1024 * 1024, "workers": 0, "proximity_distance": 10, "min_confidence": 0.4},
    "discovery": {"include": [], "exclude": [], "include_hidden": True, "exclude_binary": True},
    "detectors": {"pattern": True, "rules": True, "context_validation": True, "checksums": True, "proximity": False, "rule_set": "all", "rule_file": ""},
    "report": {"format": "json", "masked": True, "context": False, "metadata": False},
}
FORMATS = ("json", "csv", "sarif", "html")


def merged(base: dict, over: dict) -> dict:
    """``base`` with the values of ``over``, section by section; nothing is changed in place."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def _value(text: str) -> object:
    text = text.strip()
    if text in ("", "~", "null"):
        return None
    if text.startswith("[") and text.endswith("]"):
        return [_value(x) for x in re.findall(r"\"[^\"]*\"|'[^']*'|[^,\[\]]+", text[1:-1])]
    if text[0] in "\"'" and text[-1] == text[0]:
        return text[1:-1]
    try:
        return json.loads(text)
    except ValueError:
        return text


def parse(text: str) -> dict:
    """Settings of a YAML text: nested maps by indentation, lists of scalars, comments."""
    root: dict = {}
    stack: list[tuple[int, dict | list]] = [(-1, root)]
    last: tuple[dict, str] | None = None
    for raw in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if not line.strip():
            continue
        indent = len(line) - len(line.lstrip())
        body = line.strip()
        if body.startswith("- "):
            holder, key = last if last else ({}, "")
            if not isinstance(holder.get(key), list):
                holder[key] = []
            holder[key].append(_value(body[2:]))
            continue
        while stack[-1][0] >= indent:
            stack.pop()
        key, _, value = body.partition(":")
        here = stack[-1][1]
        if value.strip():
            here[key.strip()] = _value(value)
        else:
            here[key.strip()] = {}
            stack.append((indent, here[key.strip()]))
        last = (here, key.strip())
    return root


def render(settings: dict, indent: int = 0) -> str:
    """The YAML text of settings, which ``parse`` reads back."""
    out = []
    for k, v in settings.items():
        pad = " " * indent
        if isinstance(v, dict):
            out += [f"{pad}{k}:", render(v, indent + 2)]
        else:
            out.append(f"{pad}{k}: {json.dumps(v)}")
    return "\n".join(out)


def from_environment(prefix: str = "SUNDEW_", environment: dict[str, str] | None = None) -> dict:
    """Settings named SECTION__KEY after the prefix."""
    out: dict = {}
    for name, value in sorted((os.environ if environment is None else environment).items()):
        if name.startswith(prefix) and "__" in name:
            section, _, key = name[len(prefix) :].lower().partition("__")
            out.setdefault(section, {})[key] = _value(value)
    return out


def problems(settings: dict) -> list[str]:
    """What is wrong with the settings; empty if nothing is."""
    s, out = merged(DEFAULTS, settings), []
    if s["scanner"]["max_file_size"] <= 0:
        out.append("scanner.max_file_size must be positive")
    if s["scanner"]["workers"] < 0:
        out.append("scanner.workers must not be negative")
    if not 0 <= s["scanner"]["min_confidence"] <= 1:
        out.append("scanner.min_confidence must lie between 0 and 1")
    if s["detectors"]["rule_set"] not in patterns.RULE_SETS:
        out.append(f"detectors.rule_set must be one of {', '.join(patterns.RULE_SETS)}")
    if s["report"]["format"] not in FORMATS:
        out.append(f"report.format must be one of {', '.join(FORMATS)}")
    return out


def load(path: str | None = None, environment: dict[str, str] | None = None) -> dict:
    """Defaults, then the file's settings, then the environment's; raises ValueError on bad ones."""
    s = merged(DEFAULTS, parse(Path(path).read_text()) if path else {})
    s = merged(s, from_environment(environment=environment))
    if bad := problems(s):
        raise ValueError("; ".join(bad))
    return s


def save(settings: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(render(settings) + "\n")


def load_rules(path: str) -> dict[str, tuple]:
    """Rules of a TOML file, as ``operators.detect`` takes them: id -> (pattern, keywords, type or None[, tags])."""
    return rule_file(path)[0]


def rule_file(path: str) -> tuple[dict[str, tuple], tuple[str, ...]]:
    """(rules, allowed patterns) of a TOML file: the file's allowlists, its rules' and, by ``stopwords``, plain words.

    ``[extend] useDefault = true`` puts the file's rules on top of the built-in ones.  A bad pattern raises ValueError.
    """
    import tomllib

    data = tomllib.loads(Path(path).read_text())
    extends = data.get("extend", {}).get("useDefault", False)
    rules: dict[str, tuple] = dict(patterns.SECRET_RULES) if extends else {}
    allowed: list[str] = list(patterns.SECRET_ALLOWED) if extends else []
    lists = [data.get("allowlist", {}), *data.get("allowlists", [])]
    for r in data.get("rules", ()):
        tags = tuple(r.get("tags", ()))
        try:
            re.compile(patterns.python(r["regex"]))
        except re.error as e:
            raise ValueError(f"rule {r['id']}: {e}") from e
        rules[r["id"]] = (r["regex"], tuple(k.lower() for k in r.get("keywords", ())), r.get("type"), *([tags] if tags else []))
        lists += [r.get("allowlist", {}), *r.get("allowlists", [])]
    for one in lists:
        allowed += one.get("regexes", [])
        allowed += [f"(?i:{patterns.any_of((w,))})" for w in one.get("stopwords", [])]
    return rules, tuple(allowed)

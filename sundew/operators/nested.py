"""Nested semi-structured records into related flat tables that keep parent and child links.

``shred`` runs a deterministic tree automaton over each JSON body.  The grammar gives, per node kind (the
supertype), the fields that lead to child nodes and the paths of the scalars to keep.  The automaton walks down by
the grammar and, coming back up, gives each node a *variant*: the set of optional parts that it really has and in
which shape (array, bare object, empty, null, absent).  A node row holds the keys common to its supertype (record,
kind, positions of itself and its ancestors) and its variant, by which ``subtype_table`` routes it to a typed table.

Cases: null, cut off, wrapped or foreign bodies give no rows unless they unwrap to one whole object; a bare object
in place of an array is its only element; null elements count for positions but give no row; scalars of another type
than text are kept as JSON text, absent ones are null.  Nesting deeper than the grammar is never walked.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sundew.session import slices

#: kind -> (fields leading to child kinds, scalars kept by name and path); scalars named in NUMBERS are whole numbers
SARIF_GRAMMAR = {
    "report": ({"runs": "run"}, {"version": ("version",)}),
    "run": ({"results": "result", "invocations": "invocation"}, {"tool": ("tool", "driver", "name"), "tool_version": ("tool", "driver", "version")}),
    "invocation": ({}, {"ok": ("executionSuccessful",), "started": ("startTimeUtc",)}),
    "result": ({"locations": "location", "fixes": "fix"}, {"rule": ("ruleId",), "level": ("level",), "message": ("message", "text")}),
    "location": (
        {},
        {
            "uri": ("physicalLocation", "artifactLocation", "uri"),
            "line": ("physicalLocation", "region", "startLine"),
            "column": ("physicalLocation", "region", "startColumn"),
            "logical": ("logicalLocation", "name"),
        },
    ),
    "fix": ({}, {"description": ("description", "text")}),
}

NUMBERS = frozenset(("line", "column"))
FLAGS = frozenset(("ok",))
#: Subtype -> (kind, states that its variant has, states that it lacks); the first that fits takes the node.
SARIF_SUBTYPES = {
    "unlocated_result": ("result", [], ["locations:array", "locations:object"]),
    "located_result": ("result", [], []),
    "file_location": ("location", ["+uri"], []),
    "logical_location": ("location", ["+logical"], ["+uri"]),
    "bare_location": ("location", [], ["+uri", "+logical"]),
    "invocation": ("invocation", [], []),
    "fix": ("fix", [], []),
}


def scalar_type(name: str) -> T.DataType:
    return T.LongType() if name in NUMBERS else T.BooleanType() if name in FLAGS else T.StringType()


def node_schema(grammar: dict) -> T.StructType:
    """Columns common to all nodes, then one typed struct per kind that has scalars, null for other kinds' nodes."""
    common = [
        T.StructField("record_id", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("variant", T.StringType()),
        T.StructField("positions", T.ArrayType(T.IntegerType())),
        T.StructField("parent_kind", T.StringType()),
        T.StructField("rest", T.StringType()),
    ]
    typed = [T.StructField(k, T.StructType([T.StructField(n, scalar_type(n)) for n in scalars])) for k, (_, scalars) in grammar.items() if scalars]
    return T.StructType(common + typed)


def unwrap(body: str | None) -> dict | None:
    """The one object that a body holds, or None.  A byte-order mark, white space, a Markdown fence and JSON text
    within JSON text, to any depth, are wrappings; each is longer than what it wraps, so the end is reached."""
    while body is not None:
        text = body.lstrip("﻿").strip()
        if text.startswith("```") and text.endswith("```") and len(text) > 6:
            text = text[3:-3]
            text = text.partition("\n")[2] if text[:1] not in "{[\"" else text
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            return None
        if isinstance(value, dict):
            return value
        if isinstance(value, list) and len(value) == 1:
            value = value[0]
            if isinstance(value, dict):
                return value
        if not isinstance(value, str):
            return None
        body = value
    return None


def _elements(value: object) -> tuple[str, list]:
    """Shape state and elements of a child field's value."""
    if isinstance(value, dict):
        return "object", [value]
    if isinstance(value, list):
        return ("array" if any(isinstance(x, dict) for x in value) else "hollow" if value else "empty"), value
    return ("null" if value is None else "other"), []


def _scalar(node: dict, path: tuple[str, ...], kind: T.DataType) -> object:
    value: object = node
    for name in path:
        if not isinstance(value, dict):
            return None
        value = value.get(name)
    if value is None:
        return None
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(kind, T.LongType):
        return value if isinstance(value, int) and not isinstance(value, bool) and abs(value) < 1 << 63 else None
    return value if isinstance(value, str) else json.dumps(value, sort_keys=True)


def _rest(node: dict, fields: dict, taken: list[tuple[str, ...]]) -> str | None:
    """What is neither walked nor kept, as JSON; None if there is nothing."""
    out: dict = {}
    for name, value in node.items():
        if name in fields:
            shape, items = _elements(value)
            loose = {str(i): x for i, x in enumerate(items) if x is not None and not isinstance(x, dict)}
            if shape == "other" or loose:
                out[name] = value if shape == "other" else loose
            continue
        paths = [p[1:] for p in taken if p[0] == name]
        if not paths:
            out[name] = value
        elif isinstance(value, dict) and () not in paths:
            inner = _rest(value, {}, paths)
            if inner:
                out[name] = json.loads(inner)
    return json.dumps(out, sort_keys=True) if out else None


def walk(root: dict, grammar: dict, start: str, rest: bool = False) -> Iterator[tuple]:
    """Rows (kind, variant, positions, parent kind, rest, scalars) of the accepted nodes, parents before children."""
    stack = [(start, root, (), None)]
    while stack:
        kind, node, at, parent = stack.pop()
        fields, scalars = grammar[kind]
        states = []
        for name, child in fields.items():
            shape, items = _elements(node[name]) if name in node else ("absent", [])
            states.append(f"{name}:{shape}")
            stack += [(child, x, (*at, i), kind) for i, x in enumerate(items) if isinstance(x, dict)]
        kept = {name: v for name, path in scalars.items() if (v := _scalar(node, path, scalar_type(name))) is not None}
        states += [f"+{name}" for name in kept]
        over = _rest(node, fields, [path for name, path in scalars.items() if name in kept]) if rest else None
        yield kind, ",".join(states), list(at), parent, over, kept


def shred(df: DataFrame, id_column: str, body_column: str, grammar: dict = SARIF_GRAMMAR, start: str = "report", rest: bool = False) -> DataFrame:
    """Node rows (``node_schema``) of all bodies; one pass, no shuffle, a record's nodes stay in its partition."""
    schema = node_schema(grammar)
    arrow = to_arrow_schema(schema)
    kinds = [f.name for f in schema.fields[6:]]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        common = [pa.array(list(c), f.type) for c, f in zip(zip(*[r[:6] for r in rows]), arrow)]
        typed = [pa.array([r[6] if r[1] == k else None for r in rows], arrow.field(k).type) for k in kinds]
        return pa.RecordBatch.from_arrays(common + typed, schema=arrow)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                out: list[tuple] = []
                for rid, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    root = unwrap(body)
                    if root is None or rid is None:
                        continue
                    out += [(rid, k, v, p, pk, o, s) for k, v, p, pk, o, s in walk(root, grammar, start, rest)]
                    if len(out) >= 20_000:
                        yield made(out)
                        out = []
                if out:
                    yield made(out)

    return df.select(F.col(id_column).cast("bigint"), F.col(body_column).cast("string")).mapInArrow(kernel, schema)


def fits(states: Column, has: list[str], lacks: list[str]) -> Column:
    """Has a variant (as an array of states) all of ``has`` and none of ``lacks``?"""
    return reduce(lambda a, b: a & b, [*[F.array_contains(states, s) for s in has], *[~F.array_contains(states, s) for s in lacks]], F.lit(True))


def routed(nodes: DataFrame, subtypes: dict = SARIF_SUBTYPES) -> DataFrame:
    """The nodes that belong to a subtype, with its name in ``subtype``; one pass routes to all of them."""
    states = F.split("variant", ",")
    name = F.coalesce(*[F.when((F.col("kind") == k) & fits(states, has, lacks), F.lit(n)) for n, (k, has, lacks) in subtypes.items()])
    return nodes.withColumn("subtype", name).where(F.col("subtype").isNotNull())


def subtype_table(nodes: DataFrame, kind: str, has: list[str] = (), lacks: list[str] = (), grammar: dict = SARIF_GRAMMAR) -> DataFrame:
    """The typed table of the nodes of one supertype whose variant has and lacks the given states: record_id, the position
    of each ancestor and of itself (``<kind>_no``), variant, its scalars as typed columns, and rest."""
    line = [kind]
    while parent := next((k for k, (fields, _) in grammar.items() if line[0] in fields.values()), None):
        line.insert(0, parent)
    places = [F.get("positions", F.lit(i)).alias(f"{k}_no") for i, k in enumerate(line[1:])]
    scalars = [F.col(f"{kind}.{c}").alias(c) for c in grammar[kind][1]]
    return nodes.where((F.col("kind") == kind) & fits(F.split("variant", ","), list(has), list(lacks))).select("record_id", *places, "variant", *scalars, "rest")


def native_variant(value: Column, schema: T.StructType) -> Column:
    """The variant of a native struct by the rules for JSON: the shape of each nested field, and the scalars that it has."""
    states = []
    for f in schema.fields:
        x = value[f.name]
        if isinstance(f.dataType, (T.ArrayType, T.MapType)):
            states.append(F.when(x.isNull(), f"{f.name}:null").when(F.size(x) > 0, f"{f.name}:array").otherwise(f"{f.name}:empty"))
        elif isinstance(f.dataType, T.StructType):
            states.append(F.when(x.isNull(), f"{f.name}:null").otherwise(f"{f.name}:object"))
            states += [F.when(x[g.name].isNotNull(), f"+{g.name}") for g in f.dataType.fields if not isinstance(g.dataType, (T.ArrayType, T.MapType, T.StructType))]
        else:
            states.append(F.when(x.isNotNull(), f"+{f.name}"))
    return F.concat_ws(",", *states)


def sarif_items(reports: DataFrame) -> DataFrame:
    """(record_kind, record_id, parent_no, child_no, leaf_no, item_key): one row per location of each result; a
    result without a location gives one row with leaf_no -1 and an empty key.

    Rows of the subtypes file, logical and bare location, and of unlocated results.
    """
    at = F.col("positions")
    located = F.col("subtype") != "unlocated_result"
    nodes = routed(shred(reports, "report_id", "body")).where(F.col("subtype").isin("file_location", "logical_location", "bare_location", "unlocated_result"))
    return nodes.select(
        F.lit("result").alias("record_kind"),
        "record_id",
        F.get(at, F.lit(0)).alias("parent_no"),
        F.get(at, F.lit(1)).alias("child_no"),
        F.when(located, F.get(at, F.lit(2))).otherwise(F.lit(-1)).alias("leaf_no"),
        F.when(F.col("subtype") == "file_location", F.col("location.uri")).otherwise(F.lit("")).alias("item_key"),
    )


#: Subtypes of a finding nested in a scan's result, by its variant; as ``SARIF_SUBTYPES``.
FINDING_SUBTYPES = {
    "plain": ("finding", ["validation:null"], []),
    "failed": ("finding", ["+validation_error"], []),
    "validated": ("finding", [], ["validation:null", "+validation_error"]),
}


def finding_table(results: DataFrame) -> DataFrame:
    """One row per non-null element of ``scan_results.findings``: parent id, position, subtype (as ``variant``) and typed
    fields."""
    f = F.col("f")
    schema = results.schema["findings"].dataType.elementType
    nodes = results.select("result_id", F.posexplode("findings").alias("position", "f")).where(f.isNotNull())
    nodes = nodes.select("result_id", "position", "f", F.lit("finding").alias("kind"), native_variant(f, schema).alias("variant"))
    return routed(nodes, FINDING_SUBTYPES).select(
        "result_id",
        "position",
        F.col("subtype").alias("variant"),
        *[f[c].alias(c) for c in ("pi_type", "match_text", "file_path", "line_no", "col_no", "risk_level", "confidence")],
        f["validation"]["validated"].alias("validated"),
        f["validation"]["validation_error"].alias("validation_error"),
    )


def stat_table(results: DataFrame) -> DataFrame:
    """One row per entry of the maps under ``scan_results.stats``: parent id, which map, key and count."""
    maps = F.explode(
        F.array(
            F.struct(F.lit("findings_by_type").alias("map_name"), F.col("stats.findings_by_type").alias("m")),
            F.struct(F.lit("findings_by_risk").alias("map_name"), F.col("stats.findings_by_risk").alias("m")),
        )
    )
    return results.select("result_id", maps.alias("x")).select("result_id", "x.map_name", F.explode("x.m").alias("entry_key", "entry_count"))


def nested_items(reports: DataFrame, results: DataFrame) -> DataFrame:
    """The union of SARIF results, nested findings and type counts in the common supertype columns."""
    none = F.lit(-1)
    findings = finding_table(results).select(
        F.lit("finding").alias("record_kind"),
        F.col("result_id").alias("record_id"),
        none.alias("parent_no"),
        F.col("position").alias("child_no"),
        none.alias("leaf_no"),
        F.coalesce("pi_type", F.lit("")).alias("item_key"),
    )
    stats = (
        stat_table(results)
        .where(F.col("map_name") == "findings_by_type")
        .select(
            F.lit("stat").alias("record_kind"),
            F.col("result_id").alias("record_id"),
            none.alias("parent_no"),
            none.alias("child_no"),
            none.alias("leaf_no"),
            F.col("entry_key").alias("item_key"),
        )
    )
    return sarif_items(reports).unionByName(findings).unionByName(stats)

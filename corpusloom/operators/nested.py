"""Deeply nested JSON turned into related flat tables by Dewey labelling.

Every element of a list gets a label made of steps, one for each enclosing list
element: ``["clauses[0]", ".risk.findings[1]"]``.  Joined, the steps are the
node's path; without the last one they are its parent's path, so parent links
come from truncation alone.  Positions taken out, they are the schema path that
names the node's table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = "key long, root string, kind string, steps array<string>, dewey array<int>, fields map<string,string>"
#: More list fields than this mean that names are data, not a schema; the operator refuses.
MAX_LIST_FIELDS = 10_000


class _MISSING:
    """Stands for what is no JSON; a class, since its identity survives the way to a worker."""




def _parse(text: str):
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return _MISSING


def _as_list(value) -> list[tuple[int, object]] | None:
    """The places and elements of a list however it is delivered: plain, as JSON text, under numbered keys, or wrapped in ``items``."""
    if isinstance(value, str) and value.lstrip()[:1] in ("[", "{"):
        value = _parse(value)
        if not isinstance(value, (list, dict)):
            return None
    if isinstance(value, list):
        return list(enumerate(value))
    if isinstance(value, dict) and value:
        if isinstance(value.get("items"), list) and set(value) <= {"items", "total", "count"}:
            return list(enumerate(value["items"]))
        if all(k.isascii() and k.isdigit() for k in value):
            return sorted((int(k), v) for k, v in value.items())  # a gap is a place without an element
    return None


def _forms(value, name: str, lists: set[str]) -> None:
    """Adds the schema paths at which a value is a list of objects (or of lists)."""
    stack = [(value, name)]
    while stack:
        v, path = stack.pop()
        items = _as_list(v)
        if items is not None:
            if any(isinstance(x, (dict, list)) for _, x in items):
                lists.add(path)
            stack += [(x, f"{path}[]") for _, x in items if isinstance(x, (dict, list))]
        elif isinstance(v, dict):
            stack += [(x, f"{path}.{k}") for k, x in v.items() if isinstance(x, (dict, list, str))]


def _walk(value, root: str, lists: frozenset) -> Iterator[tuple]:
    """The nodes of one document: (kind, steps, dewey, fields)."""

    def text(v) -> str | None:
        return None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    def listed(v, path: str):
        items = _as_list(v)
        if items is None and path in lists:
            if isinstance(v, str) and (p := _parse(v)) is not _MISSING and isinstance(p, dict):
                return [(0, p)]
            return [(0, v)] if isinstance(v, dict) else None
        if items is not None and isinstance(v, str) and path not in lists and not any(isinstance(x, (dict, list)) for _, x in items):
            return None  # a text that merely looks like a list of scalars
        return items

    stack: list[tuple] = [(listed(value, root), root, root, [], [])]
    while stack:
        items, prefix, path, steps, dewey = stack.pop()
        for i, x in items or []:
            step, label, here = f"{prefix}[{i}]", [*dewey, i], f"{path}[]"
            if isinstance(x, list):
                stack.append((list(enumerate(x)), step, here, steps, label))
                continue
            if x is None:
                continue
            if not isinstance(x, dict):
                yield "value", [*steps, step], label, {"value": text(x)}
                continue
            own, fields, inner = [*steps, step], {}, [("", x)]
            while inner:
                at, obj = inner.pop()
                for k, v in obj.items():
                    sub = listed(v, f"{here}{at}.{k}")
                    if sub is not None:
                        stack.append((sub, f"{at}.{k}", f"{here}{at}.{k}", own, label))
                    elif isinstance(v, dict):
                        inner.append((f"{at}.{k}", v))
                    elif v is not None or f"{here}{at}.{k}" not in lists:
                        fields[f"{at}.{k}"[1:]] = text(v)
            yield "object", own, label, fields


def list_fields(records: DataFrame, columns: list[str]) -> list[str]:
    """Schema paths (``clauses[].risk.findings``) at which any record holds a list of objects.

    How often a path holds a lone object instead makes no difference, nor do other paths with the same name.  An
    action over all rows; partitions pre-aggregate, so what reaches the driver is one row per path.
    """

    def collect(batches):
        lists: set[str] = set()
        for b in batches:
            for c in columns:
                for t in b[c]:
                    if isinstance(t, str) and (v := _parse(t)) is not _MISSING:
                        _forms(v, c, lists)
        yield pd.DataFrame({"path": sorted(lists)}, dtype=object)

    found = records.select(*columns).mapInPandas(collect, "path string").distinct().limit(MAX_LIST_FIELDS + 1).collect()
    if len(found) > MAX_LIST_FIELDS:
        raise ValueError("field names are not a schema")
    return sorted({*(r["path"] for r in found), *columns})


def flatten(records: DataFrame, columns: list[str], key: str, lists: list[str] | None = None) -> DataFrame:
    """One row per list element at any depth of the JSON texts in ``columns``.

    Returns ``key, root, kind, node_path, parent_path, schema_path, dewey, depth, fields``.  ``kind`` is
    ``object``, ``value`` (a scalar element) or ``rejected`` (a text that is no JSON; its path is the column).
    ``fields`` holds the node's scalars, those of plain inner objects under dotted names.  ``parent_path`` is
    the path of the nearest enclosing list element, or empty.

    Lists count however delivered (plain, JSON text, numbered keys, ``items`` wrapper, lone object in a field
    that elsewhere holds lists; see ``list_fields``, which runs if ``lists`` is not given).  Null elements keep
    their place and give no row; null, blank, ``null`` or empty columns give none; repeated records give rows
    each; an empty table gives an empty one.
    """
    known = frozenset(lists if lists is not None else list_fields(records, columns))

    def nodes(batches):
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                for c, t in zip(columns, row[1:]):
                    if not isinstance(t, str) or not t.strip():
                        continue
                    v = _parse(t)
                    if v is _MISSING:
                        out.append((row[0], c, "rejected", [c], [], {"text": t}))
                    else:
                        out += [(row[0], c, *n) for n in _walk(v, c, known)]
            yield pd.DataFrame(out, columns=["key", "root", "kind", "steps", "dewey", "fields"])

    flat = records.select(F.col(key).cast("long").alias("_k"), *columns).mapInPandas(nodes, NODE_SCHEMA)
    path = F.array_join("steps", "")
    return flat.select(
        F.col("key").alias(key), "root", "kind", path.alias("node_path"),
        F.array_join(F.slice("steps", F.lit(1), F.greatest(F.size("steps") - 1, F.lit(0))), "").alias("parent_path"),
        F.regexp_replace(path, r"\[\d+\]", "[]").alias("schema_path"), "dewey", F.size("steps").alias("depth"), "fields",
    )


def flat_table(nodes: DataFrame, schema_path: str, fields: list[str], key: str) -> DataFrame:
    """The table of one schema path: key, node_path, parent_path and the named scalars as text columns."""
    cols = [F.try_element_at("fields", F.lit(f)).alias(f.replace(".", "_")) for f in fields]
    return nodes.where((F.col("schema_path") == schema_path) & (F.col("kind") != "rejected")).select(key, "node_path", "parent_path", *cols)


def table_inventory(nodes: DataFrame) -> DataFrame:
    """The tables found: ``schema_path, kind, n_rows, n_fields, first_field, last_field`` (names in order)."""
    per = nodes.where("kind <> 'rejected'").groupBy("schema_path", "kind").agg(F.count("*").alias("n_rows"))
    names = nodes.where("kind <> 'rejected'").select("schema_path", "kind", F.explode(F.map_keys("fields")).alias("f")).distinct()
    names = names.groupBy("schema_path", "kind").agg(F.count("*").alias("n_fields"), F.min("f").alias("first_field"), F.max("f").alias("last_field"))
    return per.join(names, ["schema_path", "kind"], "left").withColumn("n_fields", F.coalesce("n_fields", F.lit(0)))

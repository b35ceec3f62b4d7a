"""Deeply nested JSON records into related flat tables, linked by interval labels.

Every node of a body gets a pre-order and a post-order number by one depth-first traversal; node d lies below
node a exactly if pre(a) < pre(d) and post(d) < post(a). Nodes of a known type come out with their labels, one table per type,
and every other value below them as a row of the table `members`. The links between the tables are found from the labels alone: in
pre-order, the parent of a node is the last one before it that still contains it. The nodes of a record are together and in
that order where they are labelled, so linking them there needs no shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.workspace import in_workers

# The parts of a body that make one known, and the keys that wrap one.
KNOWN_PARTS = ("fields", "per_fund", "per_field")
WRAPPERS = ("ground_truth", "evaluation", "data", "payload", "body", "record", "result")
CLASSES_PATH = "share_classes.share_classes"

#: Child table → parent table ("" is the body).
PARENT_OF = {"fields": "", "share_classes": "fields", "per_fund": "", "error_breakdown": "per_fund", "per_field": "", "funds_correct": "per_field", "funds_incorrect": "per_field"}
#: The bodies themselves, and what no other table holds.
BODIES, MEMBERS = "bodies", "members"

NODE_SCHEMA = "record_id bigint, child_table string, parent_table string, parent_key string, child_ord bigint, child_key string, body_ord int, depth int, pre bigint, post bigint, parent_pre bigint, scalars string, value string"
_NODE_TYPES = (pa.int64(), *[pa.string()] * 3, pa.int64(), pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 3, pa.string(), pa.string())
#: Rows of a batch that is handed on.
BATCH_ROWS = 20_000


def _loads(text: object) -> object:
    """JSON of `text` without byte-order mark; None where it is none."""
    try:
        return json.loads(str(text).lstrip("﻿ \t\r\n"))
    except (ValueError, RecursionError):
        return None


def bodies_of(text: str | None) -> list[tuple[dict, dict]]:
    """The bodies in a text, each with the scalars of its envelopes. Unwrapped from repeated JSON encoding, lists and envelopes; empty if unusable."""
    todo: list[tuple[object, dict]] = [(_loads(text), {})] if text is not None else []
    found = []
    while todo:
        x, envelope = todo.pop(0)
        if isinstance(x, str):
            todo.append((_loads(x), envelope))
        elif isinstance(x, list):
            todo.extend((v, envelope) for v in x)
        elif isinstance(x, dict):
            inner = [x[w] for w in WRAPPERS if isinstance(x.get(w), (dict, list, str))]
            if inner and not any(k in x for k in KNOWN_PARTS):
                around = envelope | {k: v for k, v in x.items() if not isinstance(v, (dict, list)) and k not in WRAPPERS}
                todo.extend((v, around) for v in inner)
            else:
                found.append((x, envelope))
    return found


def _named(x: object, *names: str) -> str:
    for n in names:
        if isinstance(x, dict) and x.get(n) is not None:
            return str(x[n])
    return ""


def _entries(x: object, kind: str, names: tuple[str, ...], role: str) -> list[tuple[object, str | None, str, int, str]]:
    """The entries of an object, or of a list of records that carry their key, as children of a type; other elements of a list have none."""
    if isinstance(x, dict):
        return [(v, kind, k, 0, role) for k, v in x.items()]
    if isinstance(x, list):
        return [(v, kind, _named(v, *names), 0, role) if isinstance(v, dict) else (v, None, "", i, "other") for i, v in enumerate(x, 1)]
    return []


def _children(x: object, role: str, key: str) -> list[tuple[object, str | None, str, int, str]]:
    """Children as (value, node type or None, key, ord, role)."""
    if role == "body":
        return [(v, None, k, 0, k if k in KNOWN_PARTS else "other") for k, v in x.items()]
    if role == "fields":
        return _entries(x, "fields", ("field_path", "path", "field"), "field")
    if role == "per_fund":
        return _entries(x, "per_fund", ("fund_name", "fund", "name"), "fund")
    if role == "per_field":
        return _entries(x, "per_field", ("field_path", "path", "field"), "field_result")
    if role == "fund" and isinstance(x, dict):
        return [(v, None, k, 0, k if k == "error_breakdown" else "other") for k, v in x.items()]
    if role == "error_breakdown":
        return _entries(x, "error_breakdown", ("error_type", "type"), "other")
    if role == "field_result" and isinstance(x, dict):
        return [(v, None, k, 0, k if k in ("funds_correct", "funds_incorrect") else "other") for k, v in x.items()]
    if role in ("funds_correct", "funds_incorrect") and isinstance(x, list):
        return [(v, role if v is not None else None, v if isinstance(v, str) else _named(v, "fund_name", "name") or json.dumps(v), i, "other") for i, v in enumerate(x, 1)]
    if role == "field":
        if isinstance(x, dict) and "expected" in x:
            return [(v, None, key if k == "expected" else k, 0, "expected" if k == "expected" else "other") for k, v in x.items()]
        return _children(x, "expected", key)
    if role == "expected" and key == CLASSES_PATH:
        x = _loads(x) if isinstance(x, str) else x
        records = x if isinstance(x, list) else [x] if isinstance(x, dict) else []
        return [(v, "share_classes" if isinstance(v, dict) else None, _named(v, "class_name"), i, "other") for i, v in enumerate(records, 1)]
    if isinstance(x, dict):
        return [(v, None, k, 0, "other") for k, v in x.items()]
    return [(v, None, "", i, "other") for i, v in enumerate(x, 1)] if isinstance(x, list) else []


class _Labeller:
    """Depth-first traversals that number all nodes of a record's bodies and keep those of the wanted tables.

    A kept node is a list in the order of NODE_SCHEMA; `members` are the leaves below a typed node that are not among its
    scalars, keyed by their path from it.
    """

    def __init__(self, record_id: int, tables: frozenset[str], content: bool) -> None:
        self.record_id, self.tables, self.content, self.pre, self.post, self.rows = record_id, tables, content, 0, 0, []

    def _open(self, x: object, table: str, key: str, ord_: int, depth: int, body: int, envelope: dict | None = None) -> list | None:
        """A row for a typed node, numbered on entry; None if its table is not wanted."""
        row = None
        if table in self.tables:
            scalars = value = None
            if self.content and isinstance(x, dict) and table != MEMBERS:
                scalars = json.dumps((envelope or {}) | {k: v for k, v in x.items() if not isinstance(v, (dict, list))}, ensure_ascii=False)
            elif self.content:
                value = json.dumps(x, ensure_ascii=False)
            row = [self.record_id, table, None, None, ord_, key, body, depth, self.pre, -1, None, scalars, value]
            self.rows.append(row)
        self.pre += 1
        return row

    def walk(self, body: dict, envelope: dict, number: int) -> None:
        """Number a body and all below it. Iterators on a stack of its own: depth of input is not depth of recursion."""
        members = MEMBERS in self.tables
        root = self._open(body, BODIES, "", 0, 0, number, envelope)
        # (children, row or None, path from the typed node above, whether a scalar child is one of its scalars)
        stack = [(iter(_children(body, "body", "")), root, "", True)]
        while stack:
            children, row, path, held = stack[-1]
            for x, kind, key, ord_, role in children:
                nested = isinstance(x, (dict, list)) or (role == "expected" and key == CLASSES_PATH and isinstance(x, str))
                name = "expected" if role == "expected" else key
                at = (f"{path}.{name}" if path else name) if name else f"{path}[{ord_}]"
                if kind is None and members and not (isinstance(x, str) and nested) and (not x and nested or not nested and not held):
                    self._open(x, MEMBERS, at, ord_, len(stack), number)[9] = self.post
                    self.post += 1
                elif kind is None and not nested:
                    self.pre += 1
                    self.post += 1
                else:
                    child = self._open(x, kind, key, ord_, len(stack), number) if kind is not None else None
                    self.pre += kind is None
                    stack.append((iter(_children(x, role, key)), child, "" if kind is not None else at, kind is not None and isinstance(x, dict)))
                    break
            else:
                stack.pop()
                if row is not None:
                    row[9] = self.post
                self.post += 1


def link_by_intervals(rows: list[list]) -> None:
    """Give each node of a record the node that contains it, by one merge over the labels in pre-order.

    Rows are lists in the order of NODE_SCHEMA. The open intervals are a stack: a node that ended before the next one is taken off.
    Of a typed node the parent is of the type that PARENT_OF names; of a member the nearest node, of whatever type.
    """
    inside: list[list] = []
    for row in sorted(rows, key=lambda r: r[8]):
        while inside and inside[-1][9] < row[9]:
            inside.pop()
        table = row[1]
        want = PARENT_OF.get(table)
        if want == "":
            row[2], row[3] = BODIES, ""
        parent = next((p for p in reversed(inside) if table == MEMBERS or p[1] == (want or BODIES)), None) if table != BODIES else None
        if parent is not None:
            row[2], row[3], row[10] = parent[1], parent[5], parent[8]
        inside.append(row)


def _flatten(batches: Iterator[pa.RecordBatch], tables: frozenset[str], content: bool) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
    # A child's parent has to be labelled to be found, also where only the child's table is asked for.
    labelled = tables | {PARENT_OF[t] or BODIES for t in tables if t in PARENT_OF} | ({BODIES, *PARENT_OF} if MEMBERS in tables else set())

    def batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _NODE_TYPES)], names=names)

    for b in batches:
        rows: list[list] = []
        for record_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            labeller = _Labeller(record_id, labelled, content)
            for n, (body, envelope) in enumerate(bodies_of(text)):
                labeller.walk(body, envelope, n)
            link_by_intervals(labeller.rows)
            rows += [r for r in labeller.rows if r[1] in tables]
            if len(rows) > BATCH_ROWS:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)


def flatten_records(raw: DataFrame, tables: tuple[str, ...] = (BODIES, *PARENT_OF, MEMBERS), content: bool = True) -> DataFrame:
    """The rows of the named flat tables of every usable body in `raw` (record_id, body), with the columns of NODE_SCHEMA.

    `child_table` is the table, `child_key` and `child_ord` name the row in its parent, `parent_table`, `parent_key` and
    `parent_pre` are the parent's, `pre` and `post` the interval labels, unique within a record; `body_ord` counts the bodies of a
    record. `scalars` has the direct scalar members of an object as JSON (of a body, with those of its envelopes), `value` the JSON
    of a node that is no object. What is nested deeper and of no type of its own comes as `members`: one row for each leaf or empty
    container, keyed by its path from the nearest row above. Without `content` both are null. Null, empty and unreadable
    bodies give no row; a body that was delivered twice under two record ids gives rows for both; a repeated record id repeats its rows.
    """
    wanted = frozenset(tables)
    return in_workers(raw.select(F.col("record_id").cast("bigint"), F.col("body").cast("string"))).mapInArrow(lambda it: _flatten(it, wanted, content), NODE_SCHEMA)


def child_table(flat: DataFrame, name: str, **columns: str) -> DataFrame:
    """One of the flat tables with typed columns taken from the scalars: `child_table(flat, "per_fund", accuracy="double")`.

    A scalar that cannot be read as its type is null there; it stays in the `scalars` of `flat`.
    """
    rows = flat.where(F.col("child_table") == name)
    schema = ", ".join(f"`{c}` string" for c in columns)
    if not columns:
        return rows
    rows = rows.withColumn("s", F.from_json("scalars", schema))
    labels = ("record_id", "body_ord", "parent_key", "child_ord", "child_key", "pre", "post", "parent_pre", "value")
    return rows.select(*labels, *[F.col(f"s.{c}").try_cast(t).alias(c) for c, t in columns.items()])

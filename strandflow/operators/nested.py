"""Deeply nested records to flat tables, linked by interval labels.

A depth-first traversal numbers every node on entry (``pre``) and on exit (``post``): a node lies inside another
exactly if its interval lies inside the other's. Nodes come out as rows with their type; :func:`contained` links a
child table to the nearest enclosing node of a type by one sort per record, without comparing pairs.

Defined results: null, blank and unreadable payloads have no nodes; a report inside a string or an array of one
(repeatedly) is unwrapped; a lone value where a list is usual counts as a list of one; null and absent as empty; null
elements keep their position but give no row; repeated rows give repeated nodes, which :func:`report_elements` removes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Node types of an annotation report by the path of the array that holds them.
REPORT_TYPES = {
    ("sequences",): "sequences",
    ("features",): "features",
    ("features", "db_xrefs"): "db_xrefs",
    ("features", "pfams"): "pfams",
    ("features", "pfams", "db_xrefs"): "pfam_db_xrefs",
}
#: A node of this type names (by the first field present) the element of another array with that id.
REPORT_LINKS = {"features": (("sequence", "contig"), ("sequences",), "id")}

NODE_SCHEMA = (
    "record_id bigint, payload_hash bigint, node_type string, step string, pre int, post int, parent_pre int, depth int, "
    "position int, linked_position int, value string"
)


_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"true|false|null|-?(?:Infinity|(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)|NaN")


def _past_space(text: str, i: int) -> int:
    return _SPACE.match(text, i).end()


def read_json(text: str):
    """The value of a JSON text of any depth: a reader with its own stack, for what the library's recursion can't take."""
    out: list = []
    stack: list[tuple] = [(out, None)]  # open containers, with the key that waits for its value
    i = _past_space(text, 0)
    while True:
        value, opened = None, False
        c = text[i : i + 1]
        if c and c in "{[":
            value, opened = ({} if c == "{" else []), True
            i += 1
        elif c == '"':
            value, i = scanstring(text, i + 1, True)
        else:
            m = _SCALAR.match(text, i)
            if m is None:
                raise ValueError(f"no JSON value at {i}")
            value, i = json.loads(m[0]), m.end()
        holder, key = stack[-1]
        if isinstance(holder, dict):
            holder[key] = value
        else:
            holder.append(value)
        if opened:
            stack.append((value, None))
        i = _past_space(text, i)
        # after a value, or at the beginning of a container: what may follow
        while len(stack) > 1:
            holder = stack[-1][0]
            end = "}" if isinstance(holder, dict) else "]"
            if text[i : i + 1] == end:
                stack.pop()
                i, opened = _past_space(text, i + 1), False
                continue
            if not opened:
                if text[i : i + 1] != ",":
                    raise ValueError(f"no comma at {i}")
                i = _past_space(text, i + 1)
            if isinstance(holder, dict):
                if text[i : i + 1] != '"':
                    raise ValueError(f"no key at {i}")
                key, i = scanstring(text, i + 1, True)
                i = _past_space(text, i)
                if text[i : i + 1] != ":":
                    raise ValueError(f"no colon at {i}")
                stack[-1] = (holder, key)
                i = _past_space(text, i + 1)
            break
        else:
            if i != len(text):
                raise ValueError(f"more text at {i}")
            return out[0]


def unwrap(text: str | None):
    """The report of a payload, or None where it can't be read."""
    if text is None:
        return None
    value = text
    while True:
        if isinstance(value, str):
            plain = value.strip("\ufeff \t\r\n")
            try:
                try:
                    value = json.loads(plain)
                except RecursionError:
                    value = read_json(plain)
            except ValueError:
                return None
        elif isinstance(value, list) and len(value) == 1:
            value = value[0]
        else:
            return value if isinstance(value, dict) else None


def as_list(value) -> list:
    return [] if value is None else value if isinstance(value, list) else [value]


def walk(root: dict, types: dict[tuple, str], links: dict, keep_untyped: bool = True) -> Iterator[tuple]:
    """(type, step, pre, post, parent_pre, depth, position, linked_position, value) of every node, children after parents.

    ``step`` is the key under which the node hangs, ``*`` for an element of an array in an array. Iterative and linear in the
    nodes, so depth is bounded by memory only. Objects and arrays are inner nodes; a typed array element is a node of its
    type, and the array itself has no node of its own. Without ``keep_untyped`` nothing is entered that can't hold a type.
    """
    places: dict[tuple, dict[str, int]] = {}
    for _, array, id_field in links.values():
        at = root
        for step in array:
            at = at.get(step) if isinstance(at, dict) else None
        index = places.setdefault(array, {})
        for i, x in enumerate(as_list(at)):
            if isinstance(x, dict) and x.get(id_field) is not None:
                index.setdefault(str(x[id_field]), i)
    leads = {p[:i] for p in types for i in range(len(p) + 1)}  # paths that are, or lead to, a type's; None is any other
    out: list[list] = []
    clock = 0
    stack: list[tuple] = [("in", root, (), "", -1, 0, -1)]
    while stack:
        what, value, path, step, parent, depth, position = stack.pop()
        if what == "out":
            out[value][3] = clock
            clock += 1
            continue
        kind = types.get(path) if position >= 0 else None
        linked = None
        if kind in links:
            linked = -1
            fields, array, _ = links[kind]
            named = next((value[f] for f in fields if value.get(f) is not None), None) if isinstance(value, dict) else None
            if named is not None:
                linked = places[array].get(str(named), -1)
        me = parent
        if kind or keep_untyped:
            me = len(out)
            leaf = None if isinstance(value, (dict, list)) else value if isinstance(value, str) else json.dumps(value)
            out.append([kind, step, clock, -1, out[parent][2] if parent >= 0 else None, depth, position, linked, leaf])
            clock += 1
            stack.append(("out", me, path, step, parent, depth, position))
        children = []
        if isinstance(value, dict):
            for k, v in value.items():
                p = (*path, k) if path is not None and (*path, k) in leads else None
                if v is None or (p is None and not keep_untyped):
                    continue
                if p in types or isinstance(v, list):
                    children += [("in", x, p, k, me, depth + 1, i) for i, x in enumerate(as_list(v)) if x is not None]
                elif keep_untyped or isinstance(v, dict):
                    children.append(("in", v, p, k, me, depth + 1, -1))
        elif isinstance(value, list) and keep_untyped:
            children = [("in", x, None, "*", me, depth + 1, i) for i, x in enumerate(value) if x is not None]
        stack.extend(reversed(children))
    for node in out:
        yield tuple(node)


def label_nodes(
    df: DataFrame, record_id: str, payload: str, types: dict[tuple, str] = REPORT_TYPES, links: dict = REPORT_LINKS, keep_untyped: bool = True
) -> DataFrame:
    """Node rows of every readable payload; ``keep_untyped=False`` leaves only nodes of a named type."""
    schema = NODE_SCHEMA
    rows_at_once = 20_000

    def run(batches):
        for batch in batches:
            ids, hashes, texts = batch.column(0), batch.column(1), batch.column(2)
            out: list[tuple] = []
            for i in range(batch.num_rows):
                root = unwrap(texts[i].as_py())
                if root is None:
                    continue
                rid, h = ids[i].as_py(), hashes[i].as_py()
                out.extend((rid, h, *node) for node in walk(root, types, links, keep_untyped))
                if len(out) >= rows_at_once:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    cols = df.select(F.col(record_id).cast("bigint").alias("record_id"), F.xxhash64(payload).alias("payload_hash"), F.col(payload).cast("string").alias("payload"))
    return cols.where("payload is not null").mapInArrow(run, schema)


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
_NAMES = [x.split()[0] for x in NODE_SCHEMA.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def node_tables(nodes: DataFrame, types: dict[tuple, str] = REPORT_TYPES) -> dict[str, DataFrame]:
    """One flat table per node type."""
    return {t: nodes.where(F.col("node_type") == t).drop("node_type") for t in types.values()}


def flat_table(nodes: DataFrame, node_type: str, fields: list[str]) -> DataFrame:
    """Elements of one type with their own values as columns, beside their labels and positions.

    A field that an element lacks, or that holds more than one value, is null. ``nodes`` must hold the untyped ones too.
    """
    leaves = nodes.where(F.col("node_type").isNull() & F.col("step").isin(fields) & F.col("value").isNotNull())
    one = lambda f, c: F.when(F.col("step") == f, F.col(c))
    values = leaves.groupBy("record_id", "payload_hash", F.col("parent_pre").alias("pre")).agg(
        *[F.when(F.min(one(f, "pre")) == F.max(one(f, "pre")), F.max(one(f, "value"))).alias(f) for f in fields]
    )
    elements = nodes.where(F.col("node_type") == node_type).select("record_id", "payload_hash", "pre", "post", "position", "linked_position")
    return elements.join(values, ["record_id", "payload_hash", "pre"], "left")


def contained(nodes: DataFrame, ancestors: dict[str, list[str]]) -> DataFrame:
    """``nodes`` with, per ancestor type, the asked columns of the enclosing node as ``<type>_<column>`` (null: none).

    Siblings of a type never overlap, so the enclosing node is the last one of the type that was entered before, if it
    hasn't been left yet: one sort per record, no pairs.
    """
    w = Window.partitionBy("record_id", "payload_hash").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    out = nodes
    for kind, columns in ancestors.items():
        state = F.last(F.when(F.col("node_type") == kind, F.struct("post", *columns)), ignorenulls=True).over(w)
        out = out.withColumn("_a", state)
        inside = F.col("_a.post") >= F.col("post")
        for c in columns:
            out = out.withColumn(f"{kind}_{c}", F.when(inside, F.col(f"_a.{c}")))
        out = out.drop("_a")
    return out


def report_elements(df: DataFrame, record_id: str = "report_id", payload: str = "payload") -> DataFrame:
    """(report_id, child, sequence_no, feature_no, item_no, sub_no) of every element of an annotation report."""
    nodes = label_nodes(df, record_id, payload, keep_untyped=False).drop("value", "step", "depth", "parent_pre")
    linked = contained(nodes, {"features": ["position", "linked_position"], "pfams": ["position"]})
    kind, none = F.col("node_type"), F.lit(-1)
    return linked.select(
        F.col("record_id").alias("report_id"),
        kind.alias("child"),
        F.when(kind == "sequences", F.col("position")).otherwise(F.coalesce("features_linked_position", none)).alias("sequence_no"),
        F.coalesce("features_position", none).alias("feature_no"),
        F.when(kind.isin("db_xrefs", "pfams"), F.col("position")).when(kind == "pfam_db_xrefs", F.col("pfams_position")).otherwise(none).alias("item_no"),
        F.when(kind == "pfam_db_xrefs", F.col("position")).otherwise(none).alias("sub_no"),
    ).distinct()

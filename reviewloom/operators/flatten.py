"""Nested JSON payloads as flat child tables (one row per list element, linked to its parent).

Pass one infers the merged schema of all payloads: each worker merges the fields of its rows into one tree, and only its
distinct nodes leave it. Pass two expands every list of that schema, level by level, in one scan: a child row carries the keys
of its parent record, the place of its list's owner and its own place. Both passes are narrow, so no key is ever gathered in
one task, and neither has a limit of depth. JSON is decoded in Arrow batches: decoding, unwrapping and re-encoding mixed shapes
with variant expressions took several times the processor time of the C decoder, as every level evaluates its input again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Distinct fields and lists that may reach the driver; more means that keys are data, which calls for a map and not for tables.
MAX_FIELDS = 10_000
#: Stands for the elements of a list inside a list in the name of the inner one.
ELEMENTS = "[]"

Path = tuple[str, ...]


@dataclass
class ListSpec:
    """A list inside a record: its path below the record, and the numbers of the lists inside its elements."""

    path: Path
    children: list[int] = field(default_factory=list)


@dataclass
class Node:
    """A field of the merged schema, or the elements of a list: whether it was a list, its fields, and its elements."""

    is_list: bool = False
    fields: dict[str, Node] = field(default_factory=dict)
    elements: Node | None = None


_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\]|\\.)*")|(-?\d[\d.eE+-]*|true|false|null|NaN|-?Infinity))', re.DOTALL)
_REST = re.compile(r"[ \t\n\r]*")


def _loads_deep(text: str) -> object:
    """json.loads for texts that are nested more deeply than its stack allows."""
    result: list = []
    inside: list = [result]
    names: list[str | None] = [None]
    wanted, at = "value", 0
    while inside:
        token = _TOKEN.match(text, at)
        if token is None:
            raise ValueError(f"no JSON at {at}")
        at, mark = token.end(), token.group(1)
        here = inside[-1]
        if mark in ("]", "}"):
            if wanted not in ("more", "first", "first name") or len(inside) == 1 or isinstance(here, dict) != (mark == "}"):
                raise ValueError(f"{mark} at {at}")
            inside.pop()
            names.pop()
            wanted = "more"
        elif mark == ",":
            if wanted != "more" or len(inside) == 1:
                raise ValueError(f", at {at}")
            wanted = "name" if isinstance(here, dict) else "value"
        elif mark == ":":
            if wanted != "colon":
                raise ValueError(f": at {at}")
            wanted = "value"
        elif wanted in ("name", "first name"):
            if token.group(2) is None:
                raise ValueError(f"no name at {at}")
            names[-1], wanted = json.loads(token.group(2)), "colon"
        elif wanted in ("value", "first"):
            value = {"[": list, "{": dict}[mark]() if mark else json.loads(token.group(2) or token.group(3))
            if isinstance(here, dict):
                here[names[-1]] = value
            else:
                here.append(value)
            wanted = "more"
            if mark:
                inside.append(value)
                names.append(None)
                wanted = "first" if mark == "[" else "first name"
        else:
            raise ValueError(f"unexpected value at {at}")
        if wanted == "more" and len(inside) == 1:
            break
    if _REST.match(text, at).end() < len(text):
        raise ValueError(f"more after the value at {at}")
    return result[0]


class _Written(str):
    """Text that is already JSON."""


def _dumps_deep(value: object) -> str:
    """json.dumps for values that are nested more deeply than its stack allows."""
    out, left = [], [value]
    while left:
        here = left.pop()
        if isinstance(here, _Written):
            out.append(here)
        elif isinstance(here, dict):
            parts = [x for i, (k, v) in enumerate(here.items()) for x in (_Written(f"{', ' if i else ''}{json.dumps(k, ensure_ascii=False)}: "), v)]
            left += reversed([_Written("{"), *parts, _Written("}")])
        elif isinstance(here, list):
            parts = [x for i, v in enumerate(here) for x in (_Written(", " if i else ""), v)]
            left += reversed([_Written("["), *parts, _Written("]")])
        else:
            out.append(json.dumps(here, ensure_ascii=False))
    return "".join(out)


def _loads(text: str) -> object:
    try:
        return json.loads(text)
    except RecursionError:
        return _loads_deep(text)


def decode(text: str | None) -> object:
    """Value of a JSON text; looks through any string encoding, code fences and text around the JSON. None if there is none."""
    value: object = text
    while isinstance(value, str):
        try:
            value = _loads(value)
        except ValueError:
            inner = re.search(r"[\[{].*[\]}]", value, re.DOTALL)
            if inner is None:
                return None
            try:
                value = _loads(inner.group())
            except ValueError:
                return None
    return value


def elements(value: object) -> list:
    """Elements of a list; an object in its place is a list of one; a string may hold either."""
    if isinstance(value, str):
        value = decode(value)
    if isinstance(value, list):
        return value
    return [value] if isinstance(value, dict) else []


class _Fields:
    """Fields and lists of the values of one worker, numbered; 0 is the value itself."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, str | None], int] = {}
        self.lists: set[int] = set()

    def child(self, node: int, name: str | None) -> int:
        return self.known.setdefault((node, name), len(self.known) + 1)

    def add(self, value: object) -> None:
        open_values = [(value, 0)]
        while open_values:
            here, node = open_values.pop()
            if isinstance(here, dict):
                for name, inner in here.items():
                    child = self.child(node, name)
                    if isinstance(inner, (dict, list)):
                        open_values.append((inner, child))
            elif isinstance(here, list):
                self.lists.add(node)
                child = self.child(node, None)
                open_values += [(inner, child) for inner in here if isinstance(inner, (dict, list))]

    def rows(self) -> Iterator[tuple[str, str, str | None, bool]]:
        """(id, parent, name, is_list) with ids that are the same on every worker; a NULL name stands for elements."""
        ids = {0: ""}
        yield "", "", None, 0 in self.lists
        for (node, name), child in self.known.items():  # parents were added before their children
            ids[child] = blake2b(f"{ids[node]}/{'e' if name is None else 'f' + name}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
            yield ids[child], ids[node], name, child in self.lists


def _infer(payload: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Fields()
        for batch in batches:
            for text in batch.column(payload).to_pylist():
                found.add(decode(text))
        rows = list(found.rows())
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.string(), pa.bool_()))]
        yield pa.RecordBatch.from_arrays(columns, ["id", "parent", "name", "is_list"])

    return run


def infer_schema(df: DataFrame, payload: str) -> Node:
    """Merged schema of a JSON text column over all rows. Its size follows the schema, not the rows."""
    found = df.select(payload).mapInArrow(_infer(payload), "id string, parent string, name string, is_list boolean").distinct()
    rows = found.limit(2 * MAX_FIELDS + 1).collect()  # a field may be a list in some rows and none in others
    nodes: dict[str, Node] = {}
    for r in rows:
        node = nodes.setdefault(r["id"], Node())
        node.is_list |= r["is_list"]
    if len(nodes) > MAX_FIELDS or len(rows) > 2 * MAX_FIELDS:
        raise ValueError(f"more than {MAX_FIELDS} distinct fields in {payload}")
    for r in rows:
        if r["id"]:
            parent = nodes[r["parent"]]
            if r["name"] is None:
                parent.elements = nodes[r["id"]]
            else:
                parent.fields[r["name"]] = nodes[r["id"]]
    return nodes.get("", Node())


def record_roots(schema: Node, root_fields: Iterable[str]) -> list[tuple[Path, Node]]:
    """Where the record may stand inside wrapper objects, shortest path first: where a root field was seen."""
    wanted, found, open_nodes = set(root_fields), [], [((), schema)]
    for path, node in open_nodes:  # grows while it is read, level by level
        if not wanted.isdisjoint(node.fields):
            found.append((path, node))
        open_nodes += [((*path, name), node.fields[name]) for name in sorted(node.fields) if node.fields[name].fields]
    return found


def declare_lists(node: Node, names: Iterable[str]) -> None:
    """Lists that are known by name, so that they keep their level even where no row here shows them as lists."""
    for name in names:
        here = node
        for part in name.split("."):
            here = here.fields.setdefault(part, Node())
        here.is_list = True


def _forms_of_elements(lists: list[Node]) -> list[Node]:
    """All forms of the elements of lists: an object in place of a list is its only element, lists in lists hold elements too."""
    forms = []
    for node in lists:
        while node is not None:
            forms.append(node)
            node = node.elements
    return forms


def list_specs(records: list[Node]) -> list[ListSpec]:
    """The lists inside a record, of which `records` are all forms; the first entry stands for the record itself.

    A field that is a list in some rows is one in all. Lists are named by number, so that no depth is too much to pickle.
    """
    specs = [ListSpec(())]
    open_records = [(records, specs[0])]
    while open_records:
        forms, owner = open_records.pop()
        open_fields = [((), forms)]
        while open_fields:
            path, nodes = open_fields.pop()
            for name in sorted({f for n in nodes for f in n.fields}):
                inner = [n.fields[name] for n in nodes if name in n.fields]
                if any(n.is_list for n in inner):
                    owner.children.append(len(specs))
                    specs.append(ListSpec((*path, name)))
                    open_records.append((_forms_of_elements(inner), specs[-1]))
                elif any(n.fields for n in inner):
                    open_fields.append(((*path, name), inner))
    return specs


def _at(value: object, path: Path) -> object:
    for name in path:
        value = value.get(name) if isinstance(value, dict) else None
    return value


def _expand(items: list, number: int, name: str, specs: list[ListSpec], out: list[tuple]) -> None:
    open_lists = [(items, specs[number], name, "", None)]
    while open_lists:
        items, spec, name, prefix, parent = open_lists.pop()
        for i, item in enumerate(items):
            if item is None:
                continue
            place = f"{prefix}{i}"
            out.append((name, place, i, parent, item))
            for child in (specs[n] for n in spec.children):
                if inner := elements(_at(item, child.path)):
                    open_lists.append((inner, child, f"{name}.{'.'.join(child.path)}", f"{place}.", place))
            if isinstance(item, list) and item:
                open_lists.append((item, spec, f"{name}.{ELEMENTS}", f"{place}.", place))


def _text(value: object) -> str | None:
    """A value as text."""
    if value is None or isinstance(value, str):
        return value
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        return _dumps_deep(value)


def _expander(payload: str, keys: list[str], specs: list[ListSpec], roots: list[Path], root_fields: set[str], root_list: str | None, fields: tuple[str, ...], with_value: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def record(value: object) -> object:
        for path in roots:
            here = _at(value, path)
            if isinstance(here, dict) and not root_fields.isdisjoint(here):
                return here
        return value if not roots else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            owners: list[int] = []
            for n, text in enumerate(batch.column(payload).to_pylist()):
                value, out = decode(text), []
                if root_list is not None:
                    _expand(elements(value), 0, root_list, specs, out)
                elif isinstance(value := record(value), dict):
                    for n_list in specs[0].children:
                        path = specs[n_list].path
                        _expand(elements(_at(value, path)), n_list, ".".join(path), specs, out)
                rows += out
                owners += [n] * len(out)
            taken = batch.select(keys).take(pa.array(owners, pa.int64()))
            arrays = [pa.array([r[i] for r in rows], kind) for i, kind in ((0, pa.string()), (1, pa.string()), (2, pa.int32()), (3, pa.string()))]
            arrays += [pa.array([_text(r[4].get(f)) if isinstance(r[4], dict) else None for r in rows], pa.string()) for f in fields]
            if with_value:
                arrays.append(pa.array([_text(r[4]) for r in rows], pa.string()))
            names = [*keys, "list_name", "item_path", "ordinal", "parent_path", *fields, *(["value"] if with_value else [])]
            yield pa.RecordBatch.from_arrays([*taken.columns, *arrays], names)

    return run


def flatten_nested(
    df: DataFrame,
    payload: str,
    keys: list[str],
    root_fields: Iterable[str] = (),
    root_list: str | None = None,
    declared: Iterable[str] = (),
    fields: Iterable[str] = (),
    with_value: bool = False,
) -> DataFrame:
    """Child rows of every list in a JSON text column, at any depth, with the parent's keys and the place in the list.

    df: any table; payload: its JSON text column; keys: columns that identify the parent (they must not be named like the
    result's own columns); root_fields: names that mark the record inside wrapper objects; root_list: the list's name if
    the payload is itself a list; declared: names that are lists even if no row here shows one; fields: element fields to
    return as text columns; with_value: return the whole element as text.

    Result: keys, list_name, item_path (0-based, `outer.inner`), ordinal, parent_path (of the owning element), fields.
    JSON nulls give no row but count in the places; an object in place of a list is a list of one; bare values are
    elements without fields; a list directly inside a list is an element and, as `outer.[]`, a list of its own. NULL, blank or broken payloads and empty lists give no rows; an empty table an empty result.
    """
    fields, wanted = tuple(fields), set(root_fields)
    own = {"list_name", "item_path", "ordinal", "parent_path", "value", *fields}
    if own & set(keys):
        raise ValueError(f"key columns named like the result's: {sorted(own & set(keys))}")
    rows = df.select(*dict.fromkeys([*keys, payload])).where(df[payload].isNotNull())
    schema = infer_schema(rows, payload)
    if root_list is None:
        roots = record_roots(schema, wanted) if wanted else []
        forms = [node for _, node in roots] or [schema]
        for node in forms:
            declare_lists(node, declared)
    else:
        roots = []
        forms = _forms_of_elements([schema])
        declare_lists(schema, [d[len(root_list) + 1 :] for d in declared if d.startswith(root_list + ".")])
    specs = list_specs(forms)
    columns = [df.schema[k] for k in keys] + [T.StructField(n, T.StringType()) for n in ("list_name", "item_path")] + [T.StructField("ordinal", T.IntegerType()), T.StructField("parent_path", T.StringType())]
    columns += [T.StructField(f, T.StringType()) for f in fields] + ([T.StructField("value", T.StringType())] if with_value else [])
    return rows.mapInArrow(_expander(payload, keys, specs, [path for path, _ in roots], wanted, root_list, fields, with_value), T.StructType([T.StructField(c.name, c.dataType) for c in columns]))

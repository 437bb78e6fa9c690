"""Deeply nested records as related flat tables (problem 3).

Every object is canonicalised and hashed bottom-up: its own fields and the hashes of its children, with their
places, make its identity (a Merkle hash). Identical objects are stored once; every occurrence is kept by
bridge rows (parent's place, ordinal, child hash) and is written out again by walking the bridge from the roots.

The bridge rows of a subtree are kept together, in one row under the hash of its topmost object, up to a number of
nodes that the subtree itself determines; below it, subtrees are entered by their own hash. So equal subtrees are cut
alike, most trees are walked by one join, and a tree of any depth by few. A tree is one row and is taken apart in one
pass; nothing else is ever gathered by tree.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import written

TEXTS = ("id", "content", "type", "number")
FIELDS = (*TEXTS, "level", "is_edit", "num_tokens")
LINK_SCHEMA = "hash binary, height int, root_of bigint, levels int, broken boolean, below array<struct<above:string,pos:int,hash:binary,open:boolean,broken:boolean>>"
FIELD_SCHEMA = "id string, content string, type string, number string, level double, is_edit boolean, num_tokens bigint"
#: Nodes whose bridge rows are kept together; one more for every 16 levels below, so that deep chains take few joins.
FRAGMENT = 256
#: Joins of the walk that may stand in one plan; after them the frontier is written.
STEPS = 4

_SCALAR = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")
_BLANK = re.compile(r"[ \t\n\r]*")


def parsed(text: str):
    """``json.loads`` for any depth: beyond what that can nest, an explicit stack takes over. ValueError if broken."""
    try:
        return json.loads(text)
    except RecursionError:
        pass
    stack: list = [[]]  # open containers; an object is [dict, key or None]
    at, due = _BLANK.match(text, 0).end(), "value"

    def close(value) -> None:
        top = stack[-1]
        if isinstance(top, list):
            top.append(value)
        else:
            top["fields"][top["key"]] = value

    while at < len(text):
        c, top = text[at], stack[-1]
        if c in "[{" and due in ("value", "first"):
            stack.append([] if c == "[" else {"fields": {}, "key": None})
            due, at = "first" if c == "[" else "firstkey", at + 1
        elif (c == "]" and isinstance(top, list) and due in ("first", "next")) or (c == "}" and isinstance(top, dict) and due in ("firstkey", "next")):
            done = stack.pop()
            if not stack:
                raise ValueError("a bracket too many")
            close(done if isinstance(done, list) else done["fields"])
            due, at = "next", at + 1
        elif c == "," and due == "next" and len(stack) > 1:
            due, at = "value" if isinstance(top, list) else "key", at + 1
        elif c == '"' and due in ("key", "firstkey"):
            top["key"], at = json.decoder.scanstring(text, at + 1)
            at = _BLANK.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError("a colon is missing")
            due, at = "value", at + 1
        elif due in ("value", "first"):
            if c == '"':
                value, at = json.decoder.scanstring(text, at + 1)
            elif m := _SCALAR.match(text, at):
                value, at = json.loads(m[0]), m.end()
            else:
                raise ValueError("no value")
            close(value)
            due = "next"
        else:
            raise ValueError("out of place")
        at = _BLANK.match(text, at).end()
    if len(stack) != 1 or len(stack[0]) != 1:
        raise ValueError("not one value")
    return stack[0][0]


def children_of(node: dict) -> tuple[list, bool]:
    """(the child list of a node, native or in JSON; whether it was there but could not be read).

    Null and blank mean no children. Broken JSON, or anything but a list, gives no children and is reported.
    """
    kids = node.get("children")
    if kids is None:
        text = node.get("children_json")
        if text is None or (isinstance(text, str) and not text.strip()):
            return [], False
        try:
            kids = parsed(text)
        except (TypeError, ValueError):
            return [], True
        if kids is None:
            return [], False
    return (kids, False) if isinstance(kids, list) else ([], True)


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        return None


def own_fields(node: dict) -> tuple:
    """The typed fields of a node; what cannot be read as its type is null, as is a text too deep to be printed."""

    def number(value, kind):
        try:
            return None if value is None or isinstance(value, bool) else kind(value)
        except (TypeError, ValueError, OverflowError):
            return None

    texts = [_text(node.get(k)) for k in TEXTS]
    edit = node.get("is_edit")
    tokens = number(node.get("num_tokens"), int)
    return (*texts, number(node.get("level"), float), edit if isinstance(edit, bool) else None, tokens if tokens is None or abs(tokens) < 1 << 63 else None)


class Object:
    """An object of a tree: its hash and, as long as it is not ``open``, the objects below it."""

    __slots__ = ("broken", "hash", "height", "kids", "levels", "node", "open", "size")

    def __init__(self, node: dict, kids: list[Object | None], broken: bool) -> None:
        own = json.dumps([*own_fields(node), [k and k.hash.hex() for k in kids]], ensure_ascii=False)
        self.hash = hashlib.blake2b(own.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        self.node, self.kids, self.broken, self.open = node, kids, broken, False
        there = [k for k in kids if k]
        self.height = 1 + max((k.height for k in there), default=-1)
        self.size = 1 + sum(1 if k.open else k.size for k in there)
        #: joins that lead from here to the last node below
        self.levels = max((k.levels + k.open for k in there), default=0)

    def cut(self, fragment: int) -> list[Object]:
        """Opens the children that have children themselves if the bridge rows from here on are too many."""
        if self.size <= fragment + self.height // 16:
            return []
        opened = [k for k in self.kids if k and k.kids]
        for k in opened:
            k.open = True
        self.size = 1 + sum(k is not None for k in self.kids)
        self.levels = max((k.levels + k.open for k in self.kids if k), default=0)
        return opened

    def below(self) -> list[dict]:
        """The bridge rows down to the next open objects: place of the parent, ordinal, child."""
        rows, stack = [], [("", self)]
        while stack:
            above, top = stack.pop()
            for pos, k in enumerate(top.kids):
                if k:
                    rows.append({"above": above, "pos": pos, "hash": k.hash, "open": k.open, "broken": k.broken})
                    if k.kids and not k.open:
                        stack.append((f"{above}.{pos}", k))
        return rows


def walk_up(root: dict, fragment: int = FRAGMENT) -> Iterator[tuple[Object, list[dict] | None]]:
    """(object, bridge rows or None) of all nodes, children first, the root last; no recursion, any depth.

    Bridge rows come with the root and with the objects that are entered by their own hash; the latter come twice.
    """
    done: dict[int, Object] = {}
    stack = [(root, *children_of(root), False)]
    while stack:
        node, kids, broken, seen = stack.pop()
        if not seen:
            stack.append((node, kids, broken, True))
            stack.extend((k, *children_of(k), False) for k in kids if isinstance(k, dict))
            continue
        made = Object(node, [done.pop(id(k)) if isinstance(k, dict) else None for k in kids], broken)
        for k in made.cut(fragment):
            yield k, k.below()
            k.kids = []
        done[id(node)] = made
        yield made, made.below() if node is root else None


_LINKS = [
    ("hash", pa.binary()),
    ("height", pa.int32()),
    ("root_of", pa.int64()),
    ("levels", pa.int32()),
    ("broken", pa.bool_()),
    ("below", pa.list_(pa.struct([("above", pa.string()), ("pos", pa.int32()), ("hash", pa.binary()), ("open", pa.bool_()), ("broken", pa.bool_())]))),
]
_FIELD_TYPES = [*[(k, pa.string()) for k in TEXTS], ("level", pa.float64()), ("is_edit", pa.bool_()), ("num_tokens", pa.int64())]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def tree_objects(trees: DataFrame, with_fields: bool = True, fragment: int = FRAGMENT) -> DataFrame:
    """One row per object and batch of trees, and one per root (``root_of`` set); not yet distinct across batches.

    Without fields only the rows that hold bridge rows.
    """
    schema = pa.schema(_LINKS + _FIELD_TYPES * with_fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[bytes, bool]] = set()
            rows: list[tuple] = []
            held = 0
            for tree, text in zip(batch.column("tree_id").to_pylist(), batch.column("tree").to_pylist(), strict=True):
                root = json.loads(text)
                for made, below in walk_up(root, fragment):
                    top = made.node is root
                    mark = (made.hash, below is not None)
                    if not top and (mark in seen or not (with_fields or below)):
                        continue
                    seen.add(mark)
                    rows.append((made.hash, made.height, tree if top else None, made.levels if below is not None else None, made.broken, below, *(own_fields(made.node) if with_fields else ())))
                    held += 1 + len(below or ())
                if held >= 20_000:
                    yield _batch(rows, schema)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, schema)

    root = F.to_json(F.struct(*[F.col(c) for c in (*FIELDS, "children") if c in trees.columns]))
    out = f"{LINK_SCHEMA}, {FIELD_SCHEMA}" if with_fields else LINK_SCHEMA
    return trees.where(F.col("tree_id").isNotNull()).select("tree_id", root.alias("tree")).mapInArrow(run, out)


def merkle_tables(objects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(objects, bridge, roots): each distinct object once, the bridge rows below it once, and the hash of each tree."""
    fields = [c for c in FIELDS if c in objects.columns]
    distinct = objects.select("hash", *fields).dropDuplicates(["hash"])
    bridge = objects.where("below is not null").select("hash", "below").dropDuplicates(["hash"])
    roots = objects.where("root_of is not null").select(F.col("root_of").alias("tree_id"), "hash", "levels", "broken").dropDuplicates(["tree_id"])
    return distinct, bridge, roots


def occurrences(objects: DataFrame) -> DataFrame:
    """(tree_id, node_path, parent_path, pos, hash, broken): every node of every tree, by walking the bridge.

    ``objects`` must be a written table. One join leads from a tree's root to all nodes of its fragment, further ones
    to the fragments below; after every few of them the frontier is written, so the plan does not grow with the depth.
    Null entries are no nodes but count in positions. Trees with a null id are left out.
    """
    _, bridge, roots = merkle_tables(objects)
    links = bridge.select(F.col("hash").alias("_top"), "below")
    levels = roots.agg(F.max("levels")).first()[0] or 0
    out = roots.select("tree_id", F.lit("0").alias("node_path"), F.lit("").alias("parent_path"), F.lit(0).alias("pos"), "hash", "broken")
    frontier = out.select("tree_id", F.col("node_path").alias("_from"), "hash")
    for level in range(levels + 1):
        found = (
            frontier.join(links, F.col("hash") == F.col("_top"))
            .select("tree_id", "_from", F.explode("below").alias("k"))
            .select("tree_id", F.concat("_from", "k.above").alias("parent_path"), F.col("k.pos").alias("pos"), F.col("k.hash").alias("hash"), F.col("k.open").alias("open"), F.col("k.broken").alias("broken"))
        )
        if level < levels and level % STEPS == STEPS - 1:
            found = written(found, "frontier")
        found = found.withColumn("node_path", F.concat("parent_path", F.lit("."), "pos"))
        out = out.unionByName(found.drop("open"))
        frontier = found.where("open").select("tree_id", F.col("node_path").alias("_from"), "hash")
    return out


def written_objects(trees: DataFrame, with_fields: bool, fragment: int = FRAGMENT) -> DataFrame:
    """``tree_objects`` as a written table; without fields it holds bridge rows only."""
    return written(tree_objects(trees, with_fields, fragment), "objects")


def node_links(trees: DataFrame) -> DataFrame:
    """(tree_id, node_path, parent_path) of every node."""
    return occurrences(written_objects(trees, False)).select("tree_id", "node_path", "parent_path")


def broken_children(trees: DataFrame) -> DataFrame:
    """(tree_id, node_path) of the nodes whose child list was there but could not be read: their children are lost."""
    return occurrences(written_objects(trees, False)).where("broken").select("tree_id", "node_path")


def flat_nodes(trees: DataFrame) -> DataFrame:
    """Every node with its place, its depth below the root and its fields: occurrences joined with distinct objects."""
    objects = written_objects(trees, True)
    distinct, _, _ = merkle_tables(objects)
    places = occurrences(objects).withColumn("depth", F.regexp_count("node_path", F.lit(r"\.")))
    return places.join(distinct, "hash").drop("hash", "broken")

"""Deeply nested JSON as flat, related tables.

Every JSON object and array is canonicalised and hashed bottom-up (a Merkle identity: the hash covers its members and,
through their hashes, everything below it), so equal ones have one identity wherever they occur. Three tables result:

* bridge: one row per occurrence of an object or array, with the path and identity of its container and its ordinal
  there, so that the original nesting can be walked or rebuilt,
* objects: one row per identity, its canonical text stored once,
* attributes: one row per scalar member or element of a stored object or array.

Nothing is lost: rebuild() gives every text's value back from the three tables.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import one_delivery

BRIDGE = (
    "page_id long, field_name string, item_key string, node_path string, parent_path string, kind string, "
    "node_hash string, parent_hash string, ordinal int, canon string"
)


class Members(list):
    """The members of one object in their order, repeated keys included."""


class Number(str):
    """A number as it is written, so that no digit is lost."""


def _refuse(_: str):
    raise ValueError("not JSON")


#: Containers a text may open before the fast parser's recursion would end; deeper texts take the parser below.
RECURSION_SAFE = 400
_SCALAR = json.JSONDecoder(parse_constant=_refuse, parse_float=Number, parse_int=Number)
_WS = " \t\n\r"


def _deep(text: str):
    """The same result as json.loads, with an explicit stack, for texts of any depth."""
    n, pos = len(text), 0
    root: list = []
    stack: list = [root]
    keys: list = []

    def skip(i: int) -> int:
        while i < n and text[i] in _WS:
            i += 1
        return i

    def key(i: int):
        if i >= n or text[i] != '"':
            raise ValueError("not JSON")
        k, i = json.decoder.scanstring(text, i + 1, True)
        i = skip(i)
        if i >= n or text[i] != ":":
            raise ValueError("not JSON")
        return k, skip(i + 1)

    def put(v) -> None:
        if isinstance(stack[-1], Members):
            stack[-1].append((keys.pop(), v))
        else:
            stack[-1].append(v)

    pos = skip(0)
    while True:
        if pos >= n:
            raise ValueError("not JSON")
        c = text[pos]
        if c in "{[":
            new = Members() if c == "{" else []
            pos = skip(pos + 1)
            if pos < n and text[pos] == ("}" if c == "{" else "]"):
                pos += 1
                put(new)
            else:
                stack.append(new)
                if c == "{":
                    k, pos = key(pos)
                    keys.append(k)
                continue
        else:
            v, pos = _SCALAR.scan_once(text, pos)
            put(v)
        while True:  # after a value
            pos = skip(pos)
            if len(stack) == 1:
                if pos != n:
                    raise ValueError("not JSON")
                return root[0]
            if pos >= n:
                raise ValueError("not JSON")
            top, c = stack[-1], text[pos]
            if c == ",":
                pos = skip(pos + 1)
                if isinstance(top, Members):
                    k, pos = key(pos)
                    keys.append(k)
                break
            if c == ("}" if isinstance(top, Members) else "]"):
                pos += 1
                stack.pop()
                put(top)
                continue
            raise ValueError("not JSON")


def parse(text: str):
    """The value of a JSON text, objects as Members; ValueError if it isn't strictly valid JSON."""
    if text.count("[") + text.count("{") < RECURSION_SAFE:
        return json.loads(text, object_pairs_hook=Members, parse_constant=_refuse, parse_float=Number, parse_int=Number)
    try:
        return _deep(text)
    except (StopIteration, IndexError) as e:
        raise ValueError("not JSON") from e


def _tagged(x, ident: dict[int, str]) -> list:
    """[tag, text] of a member: r a stored object or array by its identity, s a string, n a number as written, b true
    or false, z null (without a text). The tag keeps a string apart from anything that looks like it."""
    if isinstance(x, list):
        return ["r", ident[id(x)]]
    if isinstance(x, Number):
        return ["n", str(x)]
    if isinstance(x, str):
        return ["s", x]
    return ["z", None] if x is None else ["b", "true" if x else "false"]


def occurrences(value, root: str = "$", canonical: bool = True) -> list[tuple]:
    """(path, path of the enclosing object, kind, hash, container's hash, ordinal in the container, canonical text) of
    every object and array of a value, parents first. The ordinal is the place among all members, as written.

    The canonical text of an object lists its members by key (repeated keys in their order), that of an array its
    elements. Without `canonical` only paths and kinds are worked out, the rest is None.
    """
    nodes: list[tuple] = []  # (value, path, path of the enclosing object, index of the container or -1, ordinal)
    todo: list[tuple] = [(value, root, "", -1, 0)]
    while todo:
        v, path, outer, up, ordinal = node = todo.pop()
        here = len(nodes)
        nodes.append(node)
        if isinstance(v, Members):
            inner = [(x, f"{path}.{k}", path, here, i) for i, (k, x) in enumerate(v) if isinstance(x, list)]
        else:
            inner = [(x, f"{path}[{i}]", outer, here, i) for i, x in enumerate(v) if isinstance(x, list)]
        todo.extend(reversed(inner))
    kind = lambda v: "object" if isinstance(v, Members) else "array"
    if not canonical:
        return [(path, outer, kind(v), None, None, o, None) for v, path, outer, _, o in nodes]
    ident: dict[int, str] = {}
    canon: list[str] = [""] * len(nodes)
    for at in range(len(nodes) - 1, -1, -1):  # what is inside has a larger index
        v = nodes[at][0]
        if isinstance(v, Members):
            shape: dict = {"object": sorted(([k, *_tagged(x, ident)] for k, x in v), key=lambda m: m[0])}
        else:
            shape = {"array": [_tagged(x, ident) for x in v]}
        canon[at] = json.dumps(shape, ensure_ascii=False, separators=(",", ":"))
        ident[id(v)] = hashlib.blake2b(canon[at].encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
    return [
        (path, outer, kind(v), ident[id(v)], ident[id(nodes[up][0])] if up >= 0 else "", o, canon[at])
        for at, (v, path, outer, up, o) in enumerate(nodes)
    ]


def _flatten(batches: Iterator[pd.DataFrame], canonical: bool) -> Iterator[pd.DataFrame]:
    cols = [c.split()[0] for c in BRIDGE.split(", ")]
    for pdf in batches:
        rows = []
        for pid, field, item, text in zip(pdf["page_id"], pdf["field_name"], pdf["item_key"], pdf["text"]):
            try:
                value = parse(text)
            except (ValueError, RecursionError):
                continue
            for path, parent, kind, h, ph, o, c in occurrences(value, canonical=canonical):
                rows.append((pid, field, item, _utf8(path), _utf8(parent), kind, h, ph, o, c and _utf8(c)))
        yield pd.DataFrame(rows, columns=cols)


def _utf8(s: str) -> str:
    """Lone surrogates, which JSON escapes can name, have no UTF-8 form; they become U+FFFD."""
    return s if s.isascii() else s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def json_texts(page: DataFrame) -> DataFrame:
    """(page_id, field_name, item_key, text): JSON-LD blocks and those meta values that open an object or array."""
    one = one_delivery(page, "page_id", "jsonld", F.map_entries("meta").alias("meta"))
    ld = one.select("page_id", F.lit("jsonld").alias("field_name"), F.posexplode("jsonld").alias("i", "text")).select(
        "page_id", "field_name", F.col("i").cast("string").alias("item_key"), "text"
    )
    meta = one.select("page_id", F.lit("meta").alias("field_name"), F.explode("meta").alias("m")).select(
        "page_id", "field_name", F.col("m.key").alias("item_key"), F.col("m.value").alias("text")
    )
    opens = F.col("text").rlike(r"^[ \t\r\n]*[\{\[]")
    return ld.where(opens).unionByName(meta.where(opens))


def flatten_json(page: DataFrame, canonical: bool = True) -> DataFrame:
    """The bridge: one row per occurrence of a JSON object or array in page.jsonld and page.meta.

    Empty objects count; texts that aren't strictly valid JSON (a trailing comma, NaN, a cut end) give no rows, nor do
    null arrays, null entries and scalars. A key repeated in one object gives a row for each value under it, with the
    same path. Duplicate deliveries of a page count once. Texts of any depth and numbers of any size are handled.
    Without `canonical` the identities are not worked out and null: enough for paths.
    """
    return json_texts(page).mapInPandas(lambda it: _flatten(it, canonical), BRIDGE)


def objects(bridge: DataFrame) -> DataFrame:
    """One row per distinct object or array: identity, kind, canonical text, number of occurrences."""
    return bridge.groupBy("node_hash").agg(F.min("kind").alias("kind"), F.min("canon").alias("canon"), F.count(F.lit(1)).alias("n_occurrences"))


_MEMBERS = "struct<object:array<array<string>>,array:array<array<string>>>"


def attributes(stored: DataFrame) -> DataFrame:
    """(node_hash, ordinal, key, type, value): scalar members of the stored objects and scalar elements of the stored
    arrays (key null there). ordinal: place in the canonical text; type: string, number (as written), boolean or null,
    whose value is null; what is an object or array itself is in the bridge. stored: the table of objects()."""
    j = F.from_json("canon", F.lit(_MEMBERS))
    none = F.lit(None).cast("string")
    each = F.coalesce(
        F.transform(j["object"], lambda m: F.struct(m[0].alias("key"), m[1].alias("tag"), F.try_element_at(m, F.lit(3)).alias("value"))),
        F.transform(j["array"], lambda m: F.struct(none.alias("key"), m[0].alias("tag"), F.try_element_at(m, F.lit(2)).alias("value"))),
    )
    m = stored.select("node_hash", F.posexplode(each).alias("ordinal", "m")).where("m.tag <> 'r'")
    names = F.create_map(*[F.lit(x) for p in (("s", "string"), ("n", "number"), ("b", "boolean"), ("z", "null")) for x in p])
    return m.select("node_hash", "ordinal", F.col("m.key").alias("key"), names[F.col("m.tag")].alias("type"), F.col("m.value").alias("value"))


def rebuild(node: str, canon: dict[str, str]):
    """The value of a stored node: canonical texts put together again. Objects come back as Members by key."""
    made: dict[str, list] = {}
    todo = [node]
    while todo:
        h = todo[-1]
        shape = json.loads(canon[h])
        rows = [["", *m] for m in shape["array"]] if "array" in shape else shape["object"]
        missing = [r[2] for r in rows if r[1] == "r" and r[2] not in made]
        if missing:
            todo.extend(missing)
            continue
        todo.pop()
        plain = {"r": made.get, "s": str, "n": Number, "b": lambda x: x == "true", "z": lambda _: None}
        values = [(k, plain[t](x)) for k, t, x in rows]
        made[h] = [v for _, v in values] if "array" in shape else Members(values)
    return made[node]

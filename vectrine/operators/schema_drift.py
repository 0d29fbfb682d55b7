"""Schemas that drift between the files of a stream: changes, edit scripts, one table.

1. Every record is parsed once into ``(file, id, field, type, value hash)``,
   a row for each node of its tree: fields, and what objects and arrays hold.
2. Counts per file, node and type give the schema tree of each file.
3. Neighbouring files of a stream are compared. Nodes that only one of them
   has are paired if their values agree for every common id.
4. A minimum-cost edit script between the two schema trees (keep, retype,
   rename, move, add, delete) is made for each pair of files. The report tells
   what the script does to the fields.
5. The scripts compose to one name for each node over a whole stream, and
   compile into a projection that all files share.

A node is named by its field, ``metadata.<key>`` or ``<key>``, and for a nested
one by the keys below it, after a ``SEP`` each; the elements of an array are
its node ``[]``.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrine.session import materialize

#: Costs of the edit operations. A rename or a move needs equal values, so it is always cheaper than delete and add.
COST = {"keep": 0.0, "retype": 0.5, "rename": 0.25, "move": 0.75, "add": 1.0, "delete": 1.0}
#: Share of a file's records that must hold a node.
LEAST_SHARE = 0.25
#: Between the keys of nested nodes; levels below a field that are looked into.
SEP, DEEPEST = "\x1f", 32


def _no_constant(text: str) -> None:
    raise ValueError(f"{text} is no JSON")


def _number(text: str) -> int | float:
    try:
        return int(text)
    except ValueError:  # more digits than Python converts
        return float(text)


def parse_object(text: str | None) -> dict | None:
    """The JSON object in ``text``; None if it is null, broken or no object. Of repeated keys the last counts."""
    if text is None:
        return None
    try:
        found = json.loads(text, parse_constant=_no_constant, parse_int=_number)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def json_type(value: object) -> str:
    """string, number, boolean, array or object."""
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (int, float)):
        return "number"
    return "array" if isinstance(value, list) else "object"


def canonical(value: object) -> str:
    """A text that is equal for equal JSON values: sorted keys, whole numbers without a fraction."""

    def plain(v: object) -> object:
        if isinstance(v, float) and v.is_integer() and abs(v) < 1e300:
            return int(v)
        if isinstance(v, list):
            return [plain(x) for x in v]
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return v

    return json.dumps(plain(value), sort_keys=True)


def fields_of(kind: str, record: dict) -> dict[str, object]:
    """Top-level fields that are not null: ``metadata.<key>``, and for kind 'json' also ``<key>``."""
    if kind != "json":
        return {f"metadata.{k}": v for k, v in record.items() if v is not None}
    found = {k: v for k, v in record.items() if v is not None and k not in ("id", "metadata")}
    inner = record.get("metadata")
    if isinstance(inner, dict):
        found |= {f"metadata.{k}": v for k, v in inner.items() if v is not None}
    return found


def nested(field: str, value: object) -> Iterator[tuple[str, str, object]]:
    """``(node, type, value)`` of a field and of all that it holds, one row for a node.

    Below arrays a node has several values: their list stands for them, and the
    commonest type, of equally common ones the first by name.
    """
    yield field, json_type(value), value
    many: dict[str, list] = {}
    todo = deque([(field, value, 0, False)])
    while todo:
        path, v, depth, several = todo.popleft()
        if depth == DEEPEST or not isinstance(v, (dict, list)):
            continue
        inside = v.items() if isinstance(v, dict) else [("[]", x) for x in v]
        for k, x in inside:
            if x is None:
                continue
            name, below = f"{path}{SEP}{k}", several or isinstance(v, list)
            if below:
                many.setdefault(name, []).append(x)
            else:
                yield name, json_type(x), x
            todo.append((name, x, depth + 1, below))
    for name, values in many.items():
        kinds = [json_type(x) for x in values]
        yield name, min(set(kinds), key=lambda t: (-kinds.count(t), t)), values


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out: list[tuple] = []
        for file_no, kind, name, text in zip(batch["file_no"], batch["kind"], batch["id"], batch["body"]):
            record = parse_object(text)
            if record is None:
                continue
            if kind == "json":
                own = record.get("id")
                name = None if own is None else canonical(own)
            out.append((file_no, name, None, None, None))  # the record itself
            out.extend((file_no, name, f, t, canonical(x)) for field, v in fields_of(kind, record).items() for f, t, x in nested(field, v))
        yield pd.DataFrame(out, columns=["file_no", "id", "field", "type", "value"])


def parsed_fields(rows: DataFrame, payloads: DataFrame, files: DataFrame) -> DataFrame:
    """``(file_no, id, field, type, value)``: a row for each node of each record, and one with a null field for each record.

    ``id`` and ``value`` are 64-bit hashes; ids of 'rows' and of 'json' files
    are never compared with one another. Text that is no JSON object gives no
    row. Rows of a file that ``files`` doesn't list, or lists with the other
    kind, are left out.
    """
    a = rows.select("file_no", F.lit("rows").alias("kind"), F.col("id").cast("string").alias("id"), F.col("metadata").alias("body"))
    b = payloads.select("file_no", F.lit("json").alias("kind"), F.lit(None).cast("string").alias("id"), F.col("payload").alias("body"))
    known = files.select("file_no", "kind")
    told = a.unionByName(b).join(known, ["file_no", "kind"], "left_semi")
    schema = "file_no bigint, id string, field string, type string, value string"
    made = told.select("file_no", "kind", "id", "body").mapInPandas(_parse, schema)
    return made.select("file_no", F.when(F.col("id").isNotNull(), F.xxhash64("id")).alias("id"), "field", "type", F.when(F.col("value").isNotNull(), F.xxhash64("value")).alias("value"))


def file_schemas(parsed: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """``(file_no, field, type)``: fields held by at least ``least`` of a file's records, with the commonest type (ties: the first by name)."""
    n = parsed.groupBy("file_no", "field", "type").agg(F.count(F.lit(1)).alias("n"))
    records = n.where(F.col("field").isNull()).select("file_no", F.col("n").alias("records"))
    per = n.where(F.col("field").isNotNull()).groupBy("file_no", "field").agg(F.sum("n").alias("held"), F.min(F.struct(-F.col("n"), F.col("type"))).alias("top"))
    return per.join(records, "file_no").where(F.col("held") >= F.col("records") * least).select("file_no", "field", F.col("top.type").alias("type"))


def file_pairs(files: DataFrame) -> DataFrame:
    """``(file_no, former_no)`` of files of which another file of the stream has a lower ``seq_no``. Files without stream or ``seq_no`` have none."""
    order = Window.partitionBy("stream").orderBy("seq_no", "file_no")
    listed = files.where(F.col("stream").isNotNull() & F.col("seq_no").isNotNull() & F.col("file_no").isNotNull()).select("file_no", "stream", "seq_no").distinct()
    return listed.select("file_no", F.lag("file_no").over(order).alias("former_no")).where(F.col("former_no").isNotNull())


def compare(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """``(file_no, field, former_field, type, former_type, evidence)``: the aligned fields of each pair of files.

    Kept fields have both names equal. A field of one file only has the other
    name null, and once more a row with ``evidence`` for each field of the other
    file that has the same values for every common id (one at least).
    """
    schemas, pairs = materialize(file_schemas(parsed), "schemas"), file_pairs(files)
    later = pairs.join(schemas, "file_no").select("file_no", "former_no", "field", "type")
    former = pairs.join(schemas.withColumnRenamed("file_no", "former_no"), "former_no").select("file_no", "former_no", F.col("field").alias("former_field"), F.col("type").alias("former_type"))
    same = (F.col("field") == F.col("former_field"))
    l, f = later.alias("l"), former.alias("f")
    aligned = l.join(f, (F.col("l.file_no") == F.col("f.file_no")) & same, "full_outer").select(
        F.coalesce("l.file_no", "f.file_no").alias("file_no"), F.coalesce("l.former_no", "f.former_no").alias("former_no"), "field", "former_field", "type", "former_type"
    )
    aligned = materialize(aligned, "aligned")

    def values(side: str, name: str) -> DataFrame:
        """For each pair, field of one side only and id: size and hashes of the set of its values."""
        only = aligned.where(F.col("former_field" if name == "field" else "field").isNull()).select(F.col("file_no").alias("pair"), F.col(side).alias("at"), F.col(name).alias("field"))
        held = parsed.where(F.col("field").isNotNull() & F.col("id").isNotNull()).withColumnRenamed("file_no", "at")
        distinct = held.join(only, ["at", "field"]).select("pair", "field", "id", "value").distinct()
        mixed = F.xxhash64("value", F.lit(1))
        return distinct.groupBy("pair", "id", "field").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("value").alias("x"), F.bit_xor(mixed).alias("y"))

    a = values("former_no", "former_field").select("pair", "id", F.col("field").alias("former_field"), F.struct("n", "x", "y").alias("was"))
    b = values("file_no", "field").select("pair", "id", "field", F.struct("n", "x", "y").alias("now"))
    agreed = a.join(b, ["pair", "id"]).groupBy(F.col("pair").alias("file_no"), "field", "former_field").agg(F.min(F.col("was") == F.col("now")).alias("evidence"))
    agreed = agreed.where("evidence")
    kinds = aligned.where(F.col("field").isNull() | F.col("former_field").isNull())
    t = agreed.join(kinds.where(F.col("field").isNotNull()).select("file_no", "field", "type"), ["file_no", "field"]).join(
        kinds.where(F.col("former_field").isNotNull()).select("file_no", "former_field", "former_type"), ["file_no", "former_field"]
    )
    columns = ["file_no", "field", "former_field", "type", "former_type", "evidence"]
    return aligned.withColumn("evidence", F.lit(False)).select(*columns).unionByName(t.select(*columns))


# edit scripts


def assign(cost: list[list[float]]) -> list[int]:
    """Columns of a minimum-cost assignment of all rows (no more rows than columns): shortest augmenting paths."""
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = [float("inf")] * (m + 1), [False] * (m + 1), [0] * (m + 1)
        while match[j0]:
            used[j0], i0, delta, j1 = True, match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def parent(node: str) -> str:
    """The node that holds a node: an object, an array, the container ``metadata`` or the root, ''."""
    if SEP in node:
        return node.rpartition(SEP)[0]
    return "metadata" if node.startswith("metadata.") else ""


def _below(top: str, node: str) -> bool:
    return node.startswith(top + SEP)


def _size(top: str, tree: dict[str, str]) -> int:
    """Nodes of a subtree."""
    return 1 + sum(_below(top, n) for n in tree)


def edit_script(former: dict[str, str], later: dict[str, str], agreed: set[tuple[str, str]]) -> list[tuple[str, str, str, float]]:
    """Script ``(operation, node, former_node, cost)`` of least cost between two schema trees ``{node: type}``.

    The trees are unordered and matched from the top: below matched nodes, those
    of equal name are kept or retyped. All others, of all matched nodes, are
    assigned at least total cost: a pair of ``agreed`` (later, former) may be
    renamed (below the same node) or moved, which costs that, a retype if the
    types differ, and the script between what they hold; or the one is
    deleted and the other added, with all that they hold. What then hangs below
    a deleted or an added node is assigned in the same way, so that it may have
    moved out of or into it.
    """
    script: list[tuple[str, str, str, float]] = []
    held: dict[tuple[str, str], list] = {}

    def inner(x: str, y: str) -> list[tuple[str, str, str, float]]:
        """Script between what x and y hold."""
        if (x, y) not in held:
            sub = lambda top, tree: {n[len(top) + 1 :]: t for n, t in tree.items() if _below(top, n)}
            a, b = sub(x, former), sub(y, later)
            pairs = {(m[len(y) + 1 :], n[len(x) + 1 :]) for m, n in agreed if _below(y, m) and _below(x, n)}
            ops = edit_script(a, b, pairs) if a or b else []
            gone = lambda op: op == "delete"
            held[x, y] = [(op, f"{x if gone(op) else y}{SEP}{m}", f"{x}{SEP}{n}" if n else "", c) for op, m, n, c in ops]
        return held[x, y]

    # nodes of equal name below matched ones
    matched, gone, new = {"": "", "metadata": "metadata"}, [], []
    for n in sorted(former.keys() & later.keys(), key=lambda n: (n.count(SEP), n)):
        if parent(n) in matched or parent(n) not in former:
            matched[n] = n
            op = "keep" if former[n] == later[n] else "retype"
            script.append((op, n, n, COST[op]))
    gone = [n for n in sorted(former) if n not in matched and (parent(n) in matched or parent(n) not in former)]
    new = [n for n in sorted(later) if n not in matched and (parent(n) in matched or parent(n) not in later)]
    taken_x: set[str] = set()
    taken_y: set[str] = set()
    seen, far = {*gone, *new}, 1e6
    while gone and new:
        cost = []
        for i, x in enumerate(gone):
            row = []
            for y in new:
                if (y, x) in agreed:
                    pair = COST["rename" if parent(x) == parent(y) else "move"] + COST["retype"] * (former[x] != later[y]) + sum(c for *_, c in inner(x, y))
                    row.append(pair - COST["add"] * _size(y, later))
                else:
                    row.append(far)
            cost.append(row + [COST["delete"] * _size(x, former) if k == i else far for k in range(len(gone))])
        for x, j in zip(list(gone), assign(cost)):
            if j < len(new) and (new[j], x) in agreed:
                op = "rename" if parent(x) == parent(new[j]) else "move"
                script.append((op, new[j], x, COST[op] + COST["retype"] * (former[x] != later[new[j]])))
                script += inner(x, new[j])
                taken_x.add(x)
                taken_y.add(new[j])
        left_x, left_y = [x for x in gone if x not in taken_x], [y for y in new if y not in taken_y]
        down_x = [n for n in sorted(former) if parent(n) in left_x and n not in seen]
        down_y = [n for n in sorted(later) if parent(n) in left_y and n not in seen]
        if not down_x and not down_y:
            break
        seen.update(down_x, down_y)
        gone, new = left_x + down_x, left_y + down_y
    inside = lambda n, tops: n in tops or any(_below(t, n) for t in tops)
    script += [("delete", n, "", COST["delete"]) for n in sorted(former) if n not in matched and not inside(n, taken_x)]
    script += [("add", n, "", COST["add"]) for n in sorted(later) if n not in matched and not inside(n, taken_y)]
    return script


def told(script: list[tuple[str, str, str, float]], agreed: set[tuple[str, str]]) -> list[tuple]:
    """``(operation, field, former_field, cost, change, about)``: the script, and what the report says of each step.

    The report is about fields, not about what they hold. A field that moved
    out of or into another is added or removed in it. A field whose values
    agree with more than one is renamed once in a script; for the report, which
    tells each such pair, it has a step 'alias' of no cost for every other one.
    """
    is_field = lambda n: SEP not in n
    named = {(y, x) for op, y, x, _ in script if op in ("rename", "move") and is_field(y) and is_field(x)}
    ys, xs = {y for y, _ in named}, {x for _, x in named}
    alias = sorted((y, x) for y, x in agreed - named if is_field(y) and is_field(x) and (y in ys or x in xs))
    ys, xs = ys | {y for y, _ in alias}, xs | {x for _, x in alias}
    out = []
    for op, y, x, c in script:
        change, about = "", y
        if (y, x) in named:
            change = "renamed"
        elif op == "retype" and is_field(y) and y == x:
            change = "retyped"
        elif op == "delete" and is_field(y) and y not in xs:
            change = "removed"
        elif op in ("add", "move", "rename") and is_field(y) and y not in ys:
            change = "added"
        elif op in ("move", "rename") and is_field(x) and x not in xs:
            change, about = "removed", x
        out.append((op, y, x, c, change, about))
    return out + [("alias", y, x, 0.0, "renamed", y) for y, x in alias]


def _scripts(group: pd.DataFrame) -> pd.DataFrame:
    plain = group[~group["evidence"]]
    later = {f: t for f, t in zip(plain["field"], plain["type"]) if f is not None}
    former = {f: t for f, t in zip(plain["former_field"], plain["former_type"]) if f is not None}
    proof = group[group["evidence"]]
    agreed = set(zip(proof["field"], proof["former_field"]))
    made = pd.DataFrame(told(edit_script(former, later, agreed), agreed), columns=["operation", "field", "former_field", "cost", "change", "about"])
    made.insert(0, "file_no", group["file_no"].iloc[0])
    return made


def edit_scripts(compared: DataFrame) -> DataFrame:
    """``(file_no, operation, field, former_field, cost, change, about)``: the script from its former file to each file.

    A group holds the nodes of two schemas, never their records.
    """
    return compared.groupBy("file_no").applyInPandas(_scripts, "file_no bigint, operation string, field string, former_field string, cost double, change string, about string")


def changes(scripts: DataFrame) -> DataFrame:
    """``(file_no, change, field, former_field)``: the report of all changes."""
    former = F.when(F.col("change") == "renamed", F.col("former_field")).otherwise("")
    return scripts.where("change <> ''").select("file_no", "change", F.col("about").alias("field"), former.alias("former_field"))


def drift_report(rows: DataFrame, payloads: DataFrame, files: DataFrame) -> DataFrame:
    """All changes between neighbouring files of a stream; see :func:`changes`.

    A file without records has no fields, so everything is removed in it and
    added in the next. Empty inputs give an empty report.
    """
    parsed = materialize(parsed_fields(rows, payloads, files), "fields")
    return changes(edit_scripts(compare(parsed, files)))


# one table


def _lineage(group: pd.DataFrame) -> pd.DataFrame:
    """One name for each node over all files of a stream: the name under which it was seen first."""
    out, names = [], {}
    for file_no, part in sorted(group.groupby("seq_no"), key=lambda x: x[0]):
        now = {}
        for op, field, former in zip(part["operation"], part["field"], part["former_field"]):
            if op in ("keep", "retype", "rename", "move"):
                now[field] = names.get(former, former)
        taken = set(now.values())
        for op, field in zip(part["operation"], part["field"]):
            if op in ("add", "first"):
                name = field
                while name in taken:  # a name that another field was known by before
                    name += "_"
                now[field] = name
                taken.add(name)
        names = now
        out += [(part["file_no"].iloc[0], f, c) for f, c in now.items()]
    return pd.DataFrame(out, columns=["file_no", "field", "column"])


def lineage(scripts: DataFrame, schemas: DataFrame, files: DataFrame) -> DataFrame:
    """``(file_no, field, column)``: the consistent column of each field of each file.

    The group of a stream holds its scripts, a few rows a file.
    """
    order = files.select("file_no", "stream", "seq_no")
    first = order.join(file_pairs(files), "file_no", "left_anti").join(schemas, "file_no")
    first = first.select("file_no", "stream", "seq_no", F.lit("first").alias("operation"), "field", F.lit("").alias("former_field"))
    rest = scripts.join(order, "file_no").where("operation <> 'alias'").select(*first.columns)
    both = first.unionByName(rest).where(F.col("stream").isNotNull() & F.col("seq_no").isNotNull())
    return both.groupBy("stream").applyInPandas(_lineage, "file_no bigint, field string, column string")


def leaves(field: str, value: object) -> Iterator[tuple[str, object]]:
    """A field, or where it is an object what that holds: all but objects, and empty ones."""
    todo = [(field, value, 0)]
    while todo:
        path, v, depth = todo.pop()
        if isinstance(v, dict) and v and depth < DEEPEST:
            todo += [(f"{path}{SEP}{k}", x, depth + 1) for k, x in v.items() if x is not None]
        else:
            yield path, v


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for n, (file_no, kind, name, text) in enumerate(zip(batch["file_no"], batch["kind"], batch["id"], batch["body"])):
            record = parse_object(text)
            if record is None:
                continue
            if kind == "json" and record.get("id") is not None:
                name = record["id"] if isinstance(record["id"], str) else canonical(record["id"])
            found = {f: v if isinstance(v, str) else canonical(v) for field, x in fields_of(kind, record).items() for f, v in leaves(field, x)}
            out.append((file_no, kind, name, found))
        yield pd.DataFrame(out, columns=["file_no", "kind", "id", "fields"])


def column_names(columns: list[str]) -> list[str]:
    """Names for columns that differ whatever their case, and from the fixed ones."""
    out: list[str] = []
    for c in columns:
        name = c.replace(".", "_").replace(SEP, "_")
        while name.lower() in {x.lower() for x in out} | {"file_no", "kind", "id", "other"}:
            name += "_"
        out.append(name)
    return out


def one_table(rows: DataFrame, payloads: DataFrame, files: DataFrame) -> DataFrame:
    """Every record of every file as ``(file_no, kind, id, <one text column for each consistent node>)``.

    The scripts compile into one projection: each column reads, in each file,
    the node that carries it there; null where the file has none. Objects are
    told by what they hold, empty ones among the others, arrays as a whole. Records whose node is too rare
    in its file to be part of the schema keep it in ``other``, a map. Values
    are JSON texts, strings without their quotes.
    """
    parsed = materialize(parsed_fields(rows, payloads, files), "fields")
    schemas = file_schemas(parsed)
    names = materialize(lineage(edit_scripts(compare(parsed, files)), schemas, files), "lineage")
    objects = schemas.groupBy("field").agg(F.min(F.col("type") == "object").alias("never")).where("never").select("field")  # these have no text
    inside = names.where(~F.col("field").contains(SEP + "[]")).join(objects, "field", "left_anti")
    columns = sorted(r[0] for r in inside.select("column").distinct().collect())  # bounded by the width of the schema
    maps = inside.groupBy("file_no").agg(F.map_from_entries(F.collect_list(F.struct("column", "field"))).alias("names"))
    a = rows.select("file_no", F.lit("rows").alias("kind"), F.col("id").cast("string").alias("id"), F.col("metadata").alias("body"))
    b = payloads.select("file_no", F.lit("json").alias("kind"), F.lit(None).cast("string").alias("id"), F.col("payload").alias("body"))
    told = a.unionByName(b).join(files.select("file_no", "kind"), ["file_no", "kind"], "left_semi")
    read = told.mapInPandas(_texts, "file_no bigint, kind string, id string, fields map<string,string>").join(maps, "file_no", "left")
    known = F.coalesce(F.map_values("names"), F.array().cast("array<string>"))
    other = F.map_filter("fields", lambda k, _: ~F.array_contains(known, k))
    return read.select("file_no", "kind", "id", *[F.col("fields")[F.col("names")[F.lit(c)]].alias(n) for c, n in zip(columns, column_names(columns))], other.alias("other"))

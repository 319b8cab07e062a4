"""Table schemas: dataclasses, the text form `table<props>{group<props>{family<props>,...},...}`, validation and change."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]{0,511}")


class SchemaError(ValueError):
    pass


# --- the text form as a tree -------------------------------------------------


@dataclass
class Node:
    name: str
    props: dict[str, str] = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)

    def depths(self) -> set[int]:
        return {1 + d for c in self.children for d in c.depths()} or {1}

    def __str__(self) -> str:
        props = f"<{','.join(f'{k}={v}' for k, v in self.props.items())}>" if self.props else ""
        inner = f"{{{','.join(map(str, self.children))}}}" if self.children else ""
        return f"{self.name}{props}{inner}"


_TOKEN = re.compile(r"\s+|(?P<mark>[<>{},=])|(?P<word>(?:\\#|[^\s<>{},=#:])+(?::(?:\\#|[^\s<>{},=#])*)?)")


def _tokens(text: str) -> list[str]:
    text = re.sub(r"(?<!\\)#[^\n]*", "", text)
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SchemaError(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup:
            out.append(m[0].replace("\\#", "#"))
        at = m.end()
    return out


def parse_tree(text: str) -> Node:
    """The tree that a schema text stands for; SchemaError where it is malformed."""
    tokens, at = _tokens(text), 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take(wanted: str | None = None) -> str:
        nonlocal at
        got = peek()
        if not got or (wanted and got != wanted) or (wanted is None and got in "<>{},="):
            raise SchemaError(f"expected {wanted or 'a name'}, found {got or 'the end'}")
        at += 1
        return got

    def node() -> Node:
        name = take()
        if ":" in name:
            raise SchemaError(f"bad name {name}")
        out = Node(name)
        if peek() == "<":
            take("<")
            while peek() != ">":
                key = take()
                take("=")
                out.props[key] = take()
                if peek() != ">":
                    take(",")
            take(">")
        if peek() == "{":
            take("{")
            while True:
                out.children.append(node())
                if peek() == ",":
                    take(",")
                if peek() == "}":
                    break
            take("}")
        return out

    root = node()
    if at != len(tokens):
        raise SchemaError(f"unexpected {peek()}")
    return root


# --- the schema --------------------------------------------------------------


@dataclass(frozen=True)
class Family:
    name: str
    group: str = "lg0"
    maxversions: int = 1
    ttl: int = 0
    diskquota: int = -1
    type: str = "bytes"
    gtxn: bool = False
    notify: bool = False


@dataclass(frozen=True)
class Group:
    name: str
    compress: str = "snappy"
    storage: str = "disk"
    blocksize: int = 4


@dataclass(frozen=True)
class TableSchema:
    name: str
    families: tuple[Family, ...] = ()
    groups: tuple[Group, ...] = (Group("lg0"),)
    mode: str = "table"  # or kv, ttlkv
    rawkey: str = "binary"
    splitsize: int = 512
    mergesize: int = 0
    txn: bool = False
    hash: bool = False
    version: int = 0
    extra: tuple[tuple[str, str], ...] = ()

    def family(self, name: str) -> Family:
        for f in self.families:
            if f.name == name:
                return f
        raise KeyError(name)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.families]


_YES = {"on": True, "yes": True, "true": True, "1": True, "off": False, "no": False, "false": False, "0": False}


def _flag(v: str) -> bool:
    if v.lower() not in _YES:
        raise SchemaError(f"not a switch: {v}")
    return _YES[v.lower()]


def _int(v: str) -> int:
    try:
        return int(v)
    except ValueError:
        raise SchemaError(f"not a number: {v}") from None


_FAMILY = {"maxversions": _int, "minversions": _int, "ttl": _int, "diskquota": _int, "type": str, "gtxn": _flag, "notify": _flag}
_GROUP = {"compress": str, "storage": str, "blocksize": _int, "use_memtable_on_leveldb": _flag, "memtable_ldb_write_buffer_size": _int, "memtable_ldb_block_size": _int, "sst_size": _int}
_TABLE = {"rawkey": str, "splitsize": _int, "mergesize": _int, "admin_group": str, "admin": str, "wal": _flag, "txn": _flag, "hash": _flag, "bloom_filter_bits_per_key": _int}


def _props(node: Node, known: dict) -> dict:
    out = {}
    for k, v in node.props.items():
        if k not in known:
            raise SchemaError(f"{node.name}: unknown property {k}")
        out[k] = known[k](v)
    return out


def _family(node: Node, group: str) -> Family:
    p = _props(node, _FAMILY)
    p.pop("minversions", None)  # stored elsewhere, consulted nowhere
    return Family(node.name, group, **p)


def _group(node: Node) -> Group:
    p = _props(node, _GROUP)
    return Group(node.name, **{k: v for k, v in p.items() if k in ("compress", "storage", "blocksize")})


def parse_schema(text: str) -> TableSchema:
    """One level: key-value; two: families in group lg0; three: groups of families. Unequal depths are an error."""
    root = parse_tree(text)
    depths = root.depths()
    if len(depths) > 1 or max(depths) > 3:
        raise SchemaError("families must all stand at one depth of at most three")
    p = _props(root, _TABLE)
    shown = {k: v for k, v in p.items() if k in ("splitsize", "mergesize", "txn", "hash", "rawkey")}
    extra = tuple((k, root.props[k]) for k in p if k not in shown)
    depth = depths.pop()
    if depth == 1:
        schema = TableSchema(root.name, mode="ttlkv" if shown.get("rawkey") == "ttlkv" else "kv", groups=(Group("kv"),), extra=extra, **shown)
    elif depth == 2:
        schema = TableSchema(root.name, tuple(_family(c, "lg0") for c in root.children), extra=extra, **shown)
    else:
        schema = TableSchema(root.name, tuple(_family(f, g.name) for g in root.children for f in g.children), tuple(_group(g) for g in root.children), extra=extra, **shown)
    validate(schema)
    return schema


def validate(s: TableSchema) -> None:
    for n in [s.name, *s.names, *(g.name for g in s.groups)]:
        if not NAME.fullmatch(n):
            raise SchemaError(f"bad name {n!r}")
    for what in (s.names, [g.name for g in s.groups]):
        if len(set(what)) < len(what):
            raise SchemaError("a name stands twice")
    if s.splitsize and s.mergesize and s.splitsize < 3 * s.mergesize:
        raise SchemaError("splitsize must be three times mergesize or more")
    if s.mode == "table" and not s.families:
        raise SchemaError("a table needs a family")
    if s.mode != "table" and s.txn:
        raise SchemaError("key-value tables have no transactions")
    if any(f.gtxn for f in s.families) and not s.txn:
        raise SchemaError("gtxn needs txn=on")
    if any(f.maxversions < 1 or f.ttl < 0 for f in s.families):
        raise SchemaError("maxversions is 1 or more, ttl 0 or more")


def format_schema(s: TableSchema) -> str:
    """A text that parse_schema reads back."""
    base = TableSchema(s.name)
    table = {k: str(getattr(s, k)) for k in ("rawkey", "splitsize", "mergesize") if getattr(s, k) != getattr(base, k)} | {k: "on" for k in ("txn", "hash") if getattr(s, k)} | dict(s.extra)
    if s.mode != "table":
        return str(Node(s.name, table))
    groups = []
    for g in s.groups:
        gp = {k: str(getattr(g, k)) for k in ("compress", "storage", "blocksize") if getattr(g, k) != getattr(Group(g.name), k)}
        fams = []
        for f in s.families:
            if f.group == g.name:
                fp = {k: str(getattr(f, k)) for k in ("maxversions", "ttl", "diskquota", "type") if getattr(f, k) != getattr(Family(f.name), k)} | {k: "on" for k in ("gtxn", "notify") if getattr(f, k)}
                fams.append(Node(f.name, fp))
        if fams:
            groups.append(Node(g.name, gp, fams))
    return str(Node(s.name, table, groups))


def update_schema(s: TableSchema, change: str) -> TableSchema:
    """Apply `table:prop=v`, `group:prop=v`, `family:prop=v`, `family:op=add|del` items, separated by commas; the version goes up."""
    families = list(s.families)
    groups = {g.name: g for g in s.groups}
    table: dict = {}
    for item in filter(None, (x.strip() for x in change.split(","))):
        m = re.fullmatch(r"([^:=]+):([^:=]+)=(.+)", item)
        if not m:
            raise SchemaError(f"bad change {item!r}")
        name, key, value = m.groups()
        at = next((i for i, f in enumerate(families) if f.name == name), None)
        if key == "op":
            if value == "add" and at is None:
                families.append(Family(name, s.groups[0].name))
            elif value == "del" and at is not None:
                families.pop(at)
            else:
                raise SchemaError(f"can't {value} family {name}")
        elif name == s.name and key in _TABLE:
            if key in ("rawkey", "hash"):
                raise SchemaError(f"{key} can't change")
            table[key] = _TABLE[key](value)
        elif name in groups and key in _GROUP:
            groups[name] = replace(groups[name], **({key: _GROUP[key](value)} if key in ("compress", "storage", "blocksize") else {}))
        elif at is not None and key in _FAMILY:
            families[at] = replace(families[at], **({} if key == "minversions" else {key: _FAMILY[key](value)}))
        else:
            raise SchemaError(f"unknown {name}:{key}")
    out = replace(s, families=tuple(families), groups=tuple(groups.values()), version=s.version + 1, **{k: v for k, v in table.items() if k in ("splitsize", "mergesize", "txn")})
    validate(out)
    return out


def with_notify_group(s: TableSchema) -> TableSchema:
    """The schema with the hidden family and group of notifications, if any family notifies."""
    if not any(f.notify for f in s.families) or "_N_" in s.names:
        return s
    return replace(s, families=(*s.families, Family("_N_", "notify")), groups=(*s.groups, Group("notify")))

"""Statement text: splitting scripts, classifying statements, and the few rewrites Spark's parser needs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Statement:
    kind: str
    text: str
    args: dict = field(default_factory=dict)


def split_script(script: str) -> list[str]:
    """Statements of a script, cut at ``;`` outside quotes; ``--`` comments are dropped."""
    out, current, quoted = [], [], False
    lines = [line if (cut := _comment_at(line)) < 0 else line[:cut] for line in script.splitlines()]
    for ch in " \n".join(lines):
        if ch == "'":
            quoted = not quoted
        if ch == ";" and not quoted:
            out.append("".join(current))
            current = []
        else:
            current.append(ch)
    out.append("".join(current))
    return [s.strip() for s in out if s.strip()]


def _comment_at(line: str) -> int:
    quoted = False
    for i, ch in enumerate(line):
        if ch == "'":
            quoted = not quoted
        elif not quoted and line.startswith("--", i):
            return i
    return -1


def normalise_select(text: str) -> str:
    """Spark SQL for a SELECT of the dialect.

    Commas between the WHEN branches of a CASE become blanks, ``INTEGER``-like
    type names Spark lacks are replaced, and an integer interval may be quoted.
    """
    masked: list[str] = []

    def mask(m: re.Match) -> str:
        masked.append(m[0])
        return f"\x00{len(masked) - 1}\x00"

    text = re.sub(r"'(?:[^']|'')*'", mask, text)
    text = re.sub(r",(\s*WHEN\b)", r"\1", text, flags=re.I)
    text = re.sub(r"\bBIGINTEGER\b", "BIGINT", text, flags=re.I)
    text = re.sub(r"\bAS\s+DECIMAL\s*\)", "AS DECIMAL(16,2))", text, flags=re.I)
    text = _cast_to_char(text)
    return re.sub("\x00(\\d+)\x00", lambda m: masked[int(m[1])], text)


_CAST, _TO_CHAR = re.compile(r"\bCAST\s*\($", re.I), re.compile(r"\bAS\s+CHAR\s*(?:\(\s*(\d+)\s*\))?\s*\)", re.I)


def _cast_to_char(text: str) -> str:
    """``CAST(x AS CHAR(n))`` as the first n characters of x as a string; n is 1 where it is left out."""
    while m := _TO_CHAR.search(text):
        depth, at = 1, m.start()
        while depth and at:
            at -= 1
            depth += {")": 1, "(": -1}.get(text[at], 0)
        opened = _CAST.search(text[: at + 1])
        if depth or not opened:
            raise ValueError("AS CHAR outside of a CAST")
        inner = text[at + 1 : m.start()].rstrip()
        text = f"{text[: opened.start()]}LEFT(CAST({inner} AS STRING), {m[1] or 1}){text[m.end() :]}"
    return text


_EXPLAIN = re.compile(
    r"EXPLAIN\s+(TASK\s+GRAPH|DATA\s+FLOW\s+GRAPH|DATA\s+FLOW|FLOUNDER|ASM|PERFORMANCE|TIMES|TASK\s+LOAD|TASK\s+TRACES|"
    r"DRAM\s+BANDWIDTH)?\s*(SELECT\b.*)",
    re.I | re.S,
)
_SAMPLE = re.compile(
    r"SAMPLE\s+(?:ASSEMBLY|OPERATORS|MEMORY|HISTORICAL\s+MEMORY)\b.*?(?:WITH\s+FREQ(?:UENCY)?\s+\d+\s+)?(SELECT\b.*)", re.I | re.S
)
_COPY = re.compile(
    r"COPY\s+(\w+)\s+FROM\s+'([^']+)'\s*(?:WITH\s*)?(?:\(\s*DELIMITER\s+'([^']+)'\s*\))?\s*$", re.I | re.S
)
_INSERT = re.compile(r"INSERT\s+INTO\s+(\w+)\s*(?:\(([^)]*)\)\s*)?VALUES\s*(.*)", re.I | re.S)
_CREATE = re.compile(r"CREATE\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?(\w+)\s*\((.*)\)\s*$", re.I | re.S)
_COMMANDS = [
    ("tables", r"\.tables"),
    ("table", r"\.table\s+(?P<name>\w+)"),
    ("stop", r"\.(?:stop|quit|exit)"),
    ("config", r"\.config"),
    ("cores", r"\.set\s+cores\s+(?P<n>\d+)"),
    ("load", r"\.load\s+file\s+'(?P<path>[^']+)'"),
    ("import", r"\.import\s+csv\s+'(?P<path>[^']+)'\s+into\s+(?P<name>\w+)(?:\s+separated\s+by\s+'(?P<sep>[^']+)')?"),
    ("statistics", r"\.update\s+statistics\s+(?P<name>\w+)"),
    ("store", r"\.store\s+'(?P<path>[^']+)'"),
    ("restore", r"\.restore\s+'(?P<path>[^']+)'"),
]
_TYPES = {"INT": "int", "INTEGER": "int", "BIGINT": "bigint", "BIGINTEGER": "bigint", "DATE": "date", "BOOL": "boolean", "BOOLEAN": "boolean"}


def classify(text: str) -> Statement:
    """One statement with its parsed arguments; ValueError for what the dialect does not know."""
    text = text.strip().rstrip(";").strip()
    if text.startswith("."):
        for kind, pattern in _COMMANDS:
            if m := re.fullmatch(pattern, text, re.I):
                return Statement(kind, text, m.groupdict())
        raise ValueError(f"unknown command: {text}")
    if m := _EXPLAIN.fullmatch(text):
        level = re.sub(r"\s+", " ", (m[1] or "plan").lower())
        return Statement("explain", text, {"level": level, "select": normalise_select(m[2])})
    if m := _SAMPLE.fullmatch(text):
        raise ValueError("hardware sampling is not available on this engine")
    if m := _COPY.fullmatch(text):
        return Statement("import", text, {"name": m[1], "path": m[2], "sep": m[3] or ";"})
    if m := _INSERT.fullmatch(text):
        columns = [c.strip() for c in m[2].split(",")] if m[2] else None
        return Statement("insert", text, {"name": m[1], "columns": columns, "values": m[3]})
    if m := _CREATE.fullmatch(text):
        return Statement("create", text, {"if_not_exists": bool(m[1]), "name": m[2], "columns": parse_columns(m[3])})
    if re.match(r"SELECT\b|WITH\b", text, re.I):
        return Statement("select", text, {"select": normalise_select(text)})
    raise ValueError(f"cannot parse: {text[:80]}")


def parse_columns(body: str) -> list[dict]:
    """Column definitions: name, Spark type, nullable, primary key, and CHAR length."""
    out = []
    for item in re.split(r",(?![^(]*\))", body):
        m = re.fullmatch(r"\s*(\w+)\s+(\w+)\s*(?:\(([^)]*)\))?\s*(.*?)\s*", item, re.S)
        if not m:
            raise ValueError(f"bad column definition: {item.strip()}")
        name, kind, size, flags = m[1], m[2].upper(), m[3], re.sub(r"\s+", " ", m[4].upper())
        length = None
        if kind == "DECIMAL":
            precision, _, scale = (size or "16,2").partition(",")
            spark_type = f"decimal({min(int(precision), 38)},{int(scale or 0)})"
        elif kind == "CHAR":
            spark_type, length = "string", int(size or 1)
        elif kind in _TYPES:
            spark_type = _TYPES[kind]
        else:
            raise ValueError(f"unknown type: {kind}")
        nullable = bool(re.search(r"(?<!NOT )\bNULL\b", flags))
        out.append({"name": name, "type": spark_type, "dialect": f"{kind}({size})" if size else kind, "nullable": nullable, "primary_key": "PRIMARY KEY" in flags, "length": length})
    return out

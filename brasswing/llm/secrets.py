"""Secret scans: a keyword automaton over the whole text, anchored patterns near its hits only, then checksums.

Base kinds are assign, access and hex. The method adds kinds whose format carries
a check: tokens with an embedded CRC-32, private key blocks, and JSON web
tokens whose header decodes. A run of hexadecimal digits has no keyword; its
proposals come from probing every eighth character, of which any run of 16 holds two.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from brasswing.llm.shared import pick

BASE_KINDS = ("assign", "access", "hex")
#: Order of kinds in digests.
KINDS = (*BASE_KINDS, "github", "npm", "jwt", "private_key")

# The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16

GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]{8,}")
PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")
HEX_DIGITS = "0123456789abcdef"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: Keywords of the automaton on ASCII-lowered text, and the kind each proposes.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm", "eyj": "jwt", "-----begin ": "private_key",
}

_PROBE = re.compile(r"[0-9a-f]{2,}")
RESULT = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"

Span = tuple[str, int, int]


def automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        machine.add_word(word, (kind, len(word)))
    machine.make_automaton()
    return machine


def base62_crc32(text: str) -> str:
    """CRC-32 of ``text`` as six base-62 digits."""
    n, out = zlib.crc32(text.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = BASE62[digit] + out
    return out


def _checked(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[2]) >= ASSIGN_LENGTH
    if kind == "access":
        return len(match[0]) >= ACCESS_LENGTH
    if kind in ("github", "npm"):
        return base62_crc32(match[1]) == match[2]
    if kind == "jwt":
        head = match[0].split(".")[0]
        try:
            return isinstance(json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))).get("alg"), str)
        except (ValueError, AttributeError, binascii.Error, RecursionError):
            return False
    return True


_ANCHORED = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM, "jwt": JWT, "private_key": PRIVATE_KEY}


def scan(text: str | None, machine) -> list[Span]:
    """All spans of one text, by start and then kind. Matches of a kind are leftmost and do not overlap."""
    if not text:
        return []
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    found: list[Span] = []
    past = dict.fromkeys(_ANCHORED, 0)
    hits = sorted((end - size + 1, kind) for end, (kind, size) in machine.iter(lowered))
    for start, kind in hits:
        if start >= past[kind] and (m := _ANCHORED[kind].match(text, start)):
            past[kind] = m.end()
            if _checked(kind, m):
                found.append((kind, m.start(), m.end()))
    end = 0
    for probe in _PROBE.finditer(text[7::8]):
        for at in range(7 + 8 * probe.start(), 8 * probe.end() - 8, 8):
            if at < end:
                continue
            begin = at
            while begin and text[begin - 1] in HEX_DIGITS:
                begin -= 1
            end = HEX.match(text, begin).end()
            if end - begin >= HEX_LENGTH:
                found.append(("hex", begin, end))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan_batches() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                spans = scan(text.as_py(), machine)
                base = [s for s in spans if s[0] in BASE_KINDS]
                counts = [sum(s[0] == k for s in base) for k in BASE_KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan_documents(docs: DataFrame) -> DataFrame:
    """Secrets of every row of ``docs`` (doc_id, text): counts, digest of the base spans, and all spans.

    Null and empty texts have none; repeated rows are scanned each; other columns are ignored.
    """
    return pick(docs, "doc_id", "text").mapInArrow(_scan_batches(), RESULT)


def redact(text: str | None, machine) -> str | None:
    """``text`` with every span (overlapping ones as one) replaced by its kind in brackets."""
    if not text:
        return text
    out, at = [], 0
    for kind, start, end in scan(text, machine):
        if start >= at:
            out.append(text[at:start] + f"[{kind.upper()}]")
        at = max(at, end)
    return "".join(out) + text[at:]


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan every document of ``documents``."""
    return scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

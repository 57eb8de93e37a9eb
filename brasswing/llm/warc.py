"""WARC archives of pages, and reading them back by boundary-chain verification.

A record's head holds its length, so it names the offset of its successor.
Readers take byte ranges of a file at once; each emits a link from every
offset where the magic stands to the offset its head leads to. Links from
inside payloads are rejected because no chain from the file's start reaches
them: pointer jumping doubles the reach of every link until the start's chain
is complete. Within one range a link is first followed to the range's end, so
only one jump a range is left for the distributed rounds.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brasswing.llm.shared import Scratch, filesystem, pick, shared_dir

MAGIC = b"WARC/1.0\r\n"
#: Payloads below this size are always stored whole.
REVISIT_BYTES = 1000
#: Bytes in a file before the next one is begun.
FILE_BYTES = 64 << 20
#: Bytes of a file that one task scans.
RANGE_BYTES = 8 << 20
#: Bytes read behind a range for the last head in it; longer heads are read on to their end.
HEAD_BYTES = 64 << 10
#: Groups of equal payloads that are sent to every executor, at most (about 100 bytes each); beyond it the join is shuffled.
BROADCAST_GROUPS = 500_000
#: Rows of a group from which on it counts as large: 10^10 pages hold at most 10^5 such groups.
LARGE_GROUP = 100_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

MANIFEST = "path string, bytes bigint"
LINKS = "path string, range_no bigint, at bigint, next bigint, leaves bigint"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload_ok boolean"


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit carries the digest and size of its payload but not the payload."""
    head = [
        b"WARC/1.0",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        f"WARC-Record-ID: {page_urn(page_id)}".encode(),
        f"WARC-Date: {DATE}".encode(),
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        f"X-Payload-Length: {len(payload)}".encode(),
    ]
    if url is not None:
        head.append(b"WARC-Target-URI: " + url.encode("utf-8", "surrogatepass").replace(b"%", b"%25").replace(b"\r", b"%0D").replace(b"\n", b"%0A"))
    if revisit:
        head += [f"WARC-Refers-To: {page_urn(refers_to)}".encode(), f"WARC-Profile: {REVISIT_PROFILE}".encode()]
    body = b"" if revisit else payload
    head += [b"Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}".encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


_LENGTH = re.compile(rb"\r\nContent-Length: *([0-9]{1,18})(?=\r\n)", re.I)
_END = b"\r\n\r\n"


def successor(data: bytes, at: int) -> int | None:
    """Offset in ``data`` just after the record whose magic stands at ``at``; None if no such head is there."""
    end = data.find(_END, at)
    if end < 0:
        return None
    lengths = _LENGTH.findall(data[at : end + 2])
    if len(lengths) != 1:
        return None
    return end + 4 + int(lengths[0]) + 4


def successors(data: bytes, until: int) -> dict[int, int]:
    """``successor`` of every magic before ``until`` that has one; ends and lengths of heads are looked for once, so long heads and many magics cost no more."""
    ends = [m.start() for m in re.finditer(_END, data)]
    lengths = [(m.start(), int(m[1])) for m in _LENGTH.finditer(data)]
    places = [p for p, _ in lengths]
    out: dict[int, int] = {}
    at = data.find(MAGIC)
    while 0 <= at < until:
        k = bisect_left(ends, at)
        if k < len(ends):
            i = bisect_left(places, at)
            if bisect_left(places, ends[k]) - i == 1:
                out[at] = ends[k] + 4 + lengths[i][1] + 4
        at = data.find(MAGIC, at + 1)
    return out


def read_head(file, begin: int, data: bytes, at: int, size: int) -> bytes:
    """``data``, the bytes of ``file`` from ``begin``, read on until the head at ``data[at]`` ends or the file of ``size`` bytes does."""
    seen, step = at, HEAD_BYTES
    while data.find(_END, seen) < 0 and begin + len(data) < size:
        seen = max(at, len(data) - 3)
        file.seek(begin + len(data))
        data += file.read(min(step, size - begin - len(data)))
        step *= 2
    return data


def _write(root: str, file_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(root)
        done: list[tuple[str, int]] = []
        out, path, size = None, "", 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "revisit")]
            for page_id, url, html, digest, refers_to, revisit in zip(*columns, strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    path, size = f"{base}/{uuid.uuid4().hex}.warc", 0
                    out = fs.open_output_stream(path)
                data = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers_to, revisit)
                out.write(data)
                size += len(data)
                if size >= file_bytes:
                    out.close()
                    done.append((path, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], names=["path", "bytes"])

    return run


def plan_records(pages: DataFrame) -> DataFrame:
    """Pages with digest, record type and target of their record.

    Among equal payloads of at least ``REVISIT_BYTES`` the largest page_id is
    the response. Rows that share that page_id are all responses; a group with
    null identifiers only has no largest, so all its rows are responses.
    """
    rows = pick(pages, "page_id", "url", "html")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = rows.withColumn("digest", F.sha1(payload)).withColumn("size", F.octet_length(payload))
    groups = (
        rows.filter(F.col("size") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND largest IS NOT NULL")
        .select(F.col("digest").alias("d"), "largest", "n")
    )
    groups = Scratch(pages.sparkSession).table(groups)
    if groups.count() <= BROADCAST_GROUPS:
        joined = rows.join(F.broadcast(groups), F.col("digest") == F.col("d"), "left")
    else:
        # Large groups are few by their size and are sent to the rows; their rows, and those too small for a group, are dealt out instead of gathered by digest.
        large = groups.filter(F.col("n") > LARGE_GROUP).select(F.col("d").alias("large_d"), F.col("largest").alias("of_large"))
        marked = rows.join(F.broadcast(large), F.col("digest") == F.col("large_d"), "left")
        alone = F.col("large_d").isNotNull() | (F.col("size") < REVISIT_BYTES)
        dealt = marked.withColumn("k", F.when(alone, F.concat(F.lit("row "), F.monotonically_increasing_id())).otherwise(F.col("digest")))
        joined = dealt.join(groups.select("d", F.col("largest").alias("of_group")), F.col("k") == F.col("d"), "left").withColumn("largest", F.coalesce("of_large", "of_group"))
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, F.col("largest")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, root: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) under the URI ``root``; returns (path, bytes) per file.

    Null html is an empty payload; null url gives no target; repeated rows give
    repeated records; other columns are ignored; no rows give no files.
    """
    return Scratch(pages.sparkSession).table(plan_records(pages).mapInArrow(_write(root, file_bytes), MANIFEST))


def _scan(root: str, range_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(root)
        for batch in batches:
            for path, size, number in zip(*[batch.column(c).to_pylist() for c in ("path", "bytes", "range_no")], strict=True):
                begin, end = number * range_bytes, min(size, (number + 1) * range_bytes)
                with fs.open_input_file(path) as file:
                    file.seek(begin)
                    data = file.read(min(size, end + HEAD_BYTES) - begin)
                    last = data.rfind(MAGIC, 0, end - begin + len(MAGIC) - 1)
                    if last >= 0:
                        data = read_head(file, begin, data, last, size)
                links = {begin + at: begin + after for at, after in successors(data, end - begin).items() if begin + after <= size}
                leaves: dict[int, int] = {}
                for start in sorted(links, reverse=True):  # a successor lies behind, so its way out is known
                    leaves[start] = leaves.get(links[start], links[start])
                n = len(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * n, pa.string()), pa.array([number] * n, pa.int64()), pa.array(list(links), pa.int64()), pa.array(list(links.values()), pa.int64()), pa.array([leaves[x] for x in links], pa.int64())],
                    names=["path", "range_no", "at", "next", "leaves"],
                )

    return run


def candidate_links(manifest: DataFrame, root: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every offset with the magic and a readable head, its successor, and where its chain leaves the byte range."""
    count = F.greatest(F.lit(1), F.ceil(F.col("bytes") / range_bytes)).cast("bigint")
    ranges = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("range_no"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    return ranges.repartition(n, F.xxhash64("path", "range_no")).mapInArrow(_scan(root, range_bytes), LINKS)


def entries(scratch: Scratch, manifest: DataFrame, links: DataFrame) -> DataFrame:
    """(path, at): the first record of every byte range that the chain from the file's start reaches.

    Pointer jumping over the ways out of the ranges: after round k the reach
    holds 2^k range entries of each file and every link spans 2^k ranges.
    """
    jumps = scratch.table(links.select("path", "at", F.col("leaves").alias("to")))
    reached = scratch.table(manifest.filter("bytes > 0").select("path", F.lit(0).cast("bigint").alias("at")))
    known = reached.count()
    while True:
        step = reached.join(jumps, ["path", "at"]).select("path", F.col("to").alias("at"))
        grown = scratch.table(reached.unionByName(step).distinct())
        n = grown.count()
        if n == known:
            return grown
        reached, known = grown, n
        onward = jumps.select("path", F.col("at").alias("to"), F.col("to").alias("far"))
        jumps = scratch.table(jumps.join(onward, ["path", "to"], "left").select("path", "at", F.coalesce("far", "to").alias("to")))


_HEAD = re.compile(rb"^([A-Za-z-]+): *(.*?)\r?$", re.M)


def parse_head(data: bytes) -> dict[str, str]:
    return {k.decode().lower(): v.decode("utf-8", "surrogatepass") for k, v in _HEAD.findall(data)}


def _number(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+|null)>", urn or "")
    return None if not found or found[1] == "null" else int(found[1])


def _read(root: str, range_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(root)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload_ok"]
        for batch in batches:
            for path, size, at in zip(*[batch.column(c).to_pylist() for c in ("path", "bytes", "at")], strict=True):
                end, rows = min(size, (at // range_bytes + 1) * range_bytes), []
                with fs.open_input_file(path) as file:
                    file.seek(at)
                    data = file.read(min(size, end + HEAD_BYTES) - at)
                    i = 0
                    while at + i < end:
                        data = read_head(file, at, data, i, size)
                        after = successor(data, i)
                        if after is None or data[i : i + len(MAGIC)] != MAGIC:
                            raise ValueError(f"{path}: no record at {at + i}")
                        if after > len(data):
                            file.seek(at + len(data))
                            data += file.read(after - len(data))
                        begin = data.find(_END, i) + 4
                        head, body = parse_head(data[i:begin]), data[begin : after - 4]
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        kind = head["warc-type"]
                        sound = kind == "revisit" or hashlib.sha1(body).hexdigest() == digest
                        url = head.get("warc-target-uri")
                        url = url and url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
                        rows.append((_number(head["warc-record-id"]), int(head["x-payload-length"]), digest, kind, _number(head.get("warc-refers-to")), url, sound))
                        i = after
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def read_archives(manifest: DataFrame, root: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every record that the chain from its file's start reaches, parsed; ``payload_ok``: the stored payload has its digest."""
    scratch = Scratch(manifest.sparkSession)
    links = scratch.table(candidate_links(manifest, root, range_bytes))
    starts = entries(scratch, manifest, links).join(manifest, "path").filter("at < bytes")
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    return starts.select("path", "bytes", "at").repartition(n, F.xxhash64("path", "at")).mapInArrow(_read(root, range_bytes), RECORDS)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write an archive record per row of ``pages`` and return what reading the archives back gives."""
    root = f"{shared_dir(spark)}/warc"
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), root)
    return read_archives(manifest, root).drop("url")


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS largest FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN g.largest IS NOT NULL AND d.page_id IS DISTINCT FROM g.largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.largest IS NOT NULL AND d.page_id IS DISTINCT FROM g.largest THEN g.largest END AS refers_to,
  TRUE AS payload_ok
FROM d LEFT JOIN g ON d.payload_digest = g.payload_digest
"""

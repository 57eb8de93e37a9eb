"""Sorted string tables: documents by identifier in prefix-compressed blocks.

File layout, little-endian::

    block*            zstd frame of entries: varint shared, varint unshared,
                      varint value length, key suffix, value
    bloom             bit array, BLOOM_BITS bits a key
    index             per block: u32 key length, last key, u64 offset, u32 length, u64 tokens before it
    footer            u64 bloom offset, u64 index offset, u64 entries, u64 tokens, u32 hash count, 8-byte magic

A key is the identifier as 8 big-endian bytes with the sign bit turned, so byte
order is number order; a null identifier is the empty key and comes first. A
value is one width byte (2 or 4) and the token ids of that width. Repeated keys
are kept, next to one another.
"""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard

MAGIC = b"BWSST\x00\x01\n"
FOOTER = struct.Struct("<QQQQI8s")
BLOCK_BYTES = 256 << 10
BLOOM_BITS = 10
BLOOM_HASHES = 7
_SIGN = 1 << 63


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + _SIGN) & (2 * _SIGN - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - _SIGN if key else None


def pack_ids(ids: np.ndarray) -> bytes:
    narrow = ids.size == 0 or int(ids.max()) < 1 << 16
    return b"\x02" + ids.astype("<u2").tobytes() if narrow else b"\x04" + ids.astype("<u4").tobytes()


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u2" if value[0] == 2 else "<u4", offset=1)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _probes(key: bytes, bits: int, count: int = BLOOM_HASHES) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    first, step = h & 0xFFFFFFFF, (h >> 32) | 1
    return [(first + i * step) % bits for i in range(count)]


class Writer:
    """Streams entries in key order to an output file; memory holds one block, the index and 8 bytes a key."""

    def __init__(self, out, block_bytes: int = BLOCK_BYTES) -> None:
        self.out, self.block_bytes = out, block_bytes
        self.offset = self.entries = self.tokens = self._before = self._size = 0
        self.first = self.last = None
        self._block: list[bytes] = []
        self._index: list[tuple[bytes, int, int, int]] = []
        self._hashes: list[int] = []
        self._zip = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.last is not None and key < self.last:
            raise ValueError("keys out of order")
        previous = self.last if self._block else b""
        shared = 0
        while shared < min(len(previous), len(key)) and previous[shared] == key[shared]:
            shared += 1
        value = pack_ids(ids)
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self._block.append(entry)
        self._size += len(entry)
        self.first = key if self.first is None else self.first
        self.last = key
        self.entries += 1
        self.tokens += int(ids.size)
        self._hashes.append(xxhash.xxh64_intdigest(key))
        if self._size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self._block:
            data = self._zip.compress(b"".join(self._block))
            self.out.write(data)
            self._index.append((self.last, self.offset, len(data), self._before))
            self.offset += len(data)
            self._before, self._block, self._size = self.tokens, [], 0

    def finish(self) -> None:
        self._flush()
        bits = max(64, self.entries * BLOOM_BITS)
        hashes = np.array(self._hashes, np.uint64)
        first, step = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
        field = np.zeros((bits + 7) // 8, np.uint8)
        for i in range(BLOOM_HASHES):
            at = (first + np.uint64(i) * step) % np.uint64(bits)
            np.bitwise_or.at(field, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        bloom = struct.pack("<Q", bits) + field.tobytes()
        index = b"".join(struct.pack("<I", len(k)) + k + struct.pack("<QIQ", o, n, t) for k, o, n, t in self._index)
        self.out.write(bloom + index)
        at = self.offset + len(bloom)
        self.out.write(FOOTER.pack(self.offset, at, self.entries, self.tokens, BLOOM_HASHES, MAGIC))


class Reader:
    """Random access to one file: Bloom filter, then binary search over the block index."""

    def __init__(self, file, size: int) -> None:
        self.file = file
        file.seek(size - FOOTER.size)
        bloom_at, index_at, self.entries, self.tokens, self.hashes, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a sorted string table")
        file.seek(bloom_at)
        tail = file.read(size - FOOTER.size - bloom_at)
        self.bits = struct.unpack_from("<Q", tail)[0]
        self.bloom = tail[8 : index_at - bloom_at]
        self.last_keys, self.blocks = [], []
        at = index_at - bloom_at
        while at < len(tail):
            n = struct.unpack_from("<I", tail, at)[0]
            self.last_keys.append(tail[at + 4 : at + 4 + n])
            self.blocks.append(struct.unpack_from("<QIQ", tail, at + 4 + n))
            at += 4 + n + 20
        self._unzip = zstandard.ZstdDecompressor()

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _probes(key_of(doc_id), self.bits, self.hashes))

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        offset, length, _ = self.blocks[i]
        self.file.seek(offset)
        data = self._unzip.decompress(self.file.read(length), max_output_size=1 << 31)
        at, key = 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            fresh, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + fresh]
            at += fresh
            yield key, unpack_ids(data[at : at + n])
            at += n

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The token ids of every entry under ``doc_id``; empty when there is none."""
        if not self.may_hold(doc_id):
            return []
        key, found = key_of(doc_id), []
        i = bisect.bisect_left(self.last_keys, key)
        while i < len(self.blocks):
            for k, ids in self.block(i):
                if k == key:
                    found.append(ids)
                elif k > key:
                    return found
            i += 1
        return found

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.blocks)):
            for key, ids in self.block(i):
                yield id_of(key), ids

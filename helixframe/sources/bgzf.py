"""Block gzip: gzip members of up to 64 KiB, each naming its own size.

A place in the text is a virtual offset: the start of a block in the file and
the place inside the block.  Blocks are independent, so files split anywhere.
"""

from __future__ import annotations

import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from typing import BinaryIO

from ..functions.bins import make_virtual_offset, split_virtual_offset

MAX_BLOCK = 65536
#: Payload of a block that is written; leaves room for data that does not compress.
PAYLOAD = 65280
# The start of a block's header and the empty block that ends a file.
MAGIC = b"\x1f\x8b\x08\x04"
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def compress(payload: bytes, level: int = 6) -> bytes:
    """One block."""
    if len(payload) > MAX_BLOCK:
        raise ValueError("a block holds 64 KiB at most")
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(payload) + deflate.flush()
    size = len(body) + 26
    if size > MAX_BLOCK:
        return compress(payload, 0) if level else b"".join(compress(payload[i : i + 32768], 0) for i in (0, 32768))
    head = struct.pack("<4sLBBH2sHH", MAGIC, 0, 0, 255, 6, b"BC", 2, size - 1)
    return head + body + struct.pack("<LL", zlib.crc32(payload), len(payload))


def compress_all(data: bytes, level: int = 6) -> bytes:
    """Blocks for any amount of data, without the end mark."""
    return b"".join(compress(data[i : i + PAYLOAD], level) for i in range(0, len(data), PAYLOAD))


def block_size(head: bytes) -> int | None:
    """The size of the block that starts with ``head`` (18 bytes or more), or None."""
    if len(head) < 18 or head[:4] != MAGIC:
        return None
    extra = struct.unpack_from("<H", head, 10)[0]
    at, end = 12, min(12 + extra, len(head))
    while at + 4 <= end:
        kind, n = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and n == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return None


def read_block(stream: BinaryIO) -> tuple[int, bytes] | None:
    """Compressed size and payload of the block at the stream's place; None at the end."""
    head = stream.read(18)
    if not head:
        return None
    size = block_size(head)
    if size is None:
        raise ValueError("not a block of a block-gzip file")
    rest = stream.read(size - len(head))
    block = head + rest
    if len(block) < size:
        raise ValueError("a block is cut off")
    extra = struct.unpack_from("<H", block, 10)[0]
    payload = zlib.decompressobj(-15).decompress(block[12 + extra : -8])
    crc, length = struct.unpack("<LL", block[-8:])
    if length != len(payload):
        raise ValueError(f"a block should hold {length} bytes, not {len(payload)}")
    if crc != zlib.crc32(payload):
        raise ValueError("a block's checksum does not fit")
    return size, payload


def next_block(stream: BinaryIO, at: int, window: int = 1 << 17) -> int | None:
    """Start of the first block at or after a place in the file."""
    stream.seek(at)
    data = stream.read(window + 64)
    i = data.find(MAGIC)
    while i >= 0:
        size = block_size(data[i : i + 64])
        if size is not None:
            # A block by its look is one if another, or the end, follows.
            stream.seek(at + i + size)
            after = stream.read(18)
            if not after or block_size(after) is not None:
                return at + i
        i = data.find(MAGIC, i + 1)
    return None


class BgzfReader:
    """Random access to the text of a block-gzip file, by virtual offset."""

    def __init__(self, filename: str | None = None, fileobj: BinaryIO | None = None, mode: str = "r", max_cache: int = 100, encoding: str = "utf-8"):
        if max_cache < 1:
            raise ValueError("the cache holds one block at least")
        if "w" in mode or "a" in mode:
            raise ValueError("a reader is opened for reading")
        self._stream = fileobj if fileobj is not None else open(filename, "rb")  # noqa: SIM115
        self._encoding, self._max = encoding, max_cache
        self._cache: OrderedDict[int, tuple[int, bytes]] = OrderedDict()
        self._start = self._place = 0
        self._size, self._data = 0, b""
        self._load(0)

    def _load(self, start: int) -> None:
        if start in self._cache:
            self._cache.move_to_end(start)
        else:
            self._stream.seek(start)
            self._cache[start] = read_block(self._stream) or (0, b"")
            if len(self._cache) > self._max:
                self._cache.popitem(last=False)
        self._start, self._place = start, 0
        self._size, self._data = self._cache[start]

    def tell(self) -> int:
        if self._place == len(self._data) and self._size:
            return make_virtual_offset(self._start + self._size, 0)
        return make_virtual_offset(self._start, self._place)

    def seek(self, offset: int) -> int:
        start, within = split_virtual_offset(offset)
        if start != self._start:
            self._load(start)
        if within > len(self._data):
            raise ValueError("the place is beyond its block")
        self._place = within
        return offset

    def read(self, size: int) -> str:
        if size < 0:
            raise NotImplementedError("say how much to read")
        parts = []
        while size and self._size:
            part = self._data[self._place : self._place + size]
            parts.append(part)
            size -= len(part)
            self._place += len(part)
            if self._place == len(self._data):
                self._load(self._start + self._size)
        return b"".join(parts).decode(self._encoding)

    def readline(self) -> str:
        return self.readline_bytes().decode(self._encoding)

    def readline_bytes(self) -> bytes:
        parts = []
        while self._size:
            end = self._data.find(b"\n", self._place)
            stop = len(self._data) if end < 0 else end + 1
            parts.append(self._data[self._place : stop])
            self._place = stop
            if self._place == len(self._data):
                self._load(self._start + self._size)
            if end >= 0:
                break
        return b"".join(parts)

    def readlines(self, hint: int = -1) -> list[str]:
        out, size = [], 0
        for line in self:
            out.append(line)
            size += len(line)
            if 0 < hint <= size:
                break
        return out

    def __iter__(self) -> Iterator[str]:
        return self

    def __next__(self) -> str:
        line = self.readline()
        if not line:
            raise StopIteration
        return line

    def readable(self) -> bool:
        return True

    def writable(self) -> bool:
        return False

    def seekable(self) -> bool:
        return True

    def write(self, data) -> None:
        raise OSError("opened for reading")

    writelines = truncate = write

    @property
    def closed(self) -> bool:
        return self._stream.closed

    def close(self) -> None:
        self._stream.close()
        self._cache.clear()

    def __enter__(self) -> BgzfReader:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class BgzfWriter:
    """Writes text or bytes as blocks; closing adds the end mark."""

    def __init__(self, filename: str | None = None, fileobj: BinaryIO | None = None, level: int = 6, encoding: str = "utf-8"):
        self._stream = fileobj if fileobj is not None else open(filename, "wb")  # noqa: SIM115
        self._level, self._encoding, self._held = level, encoding, bytearray()

    def write(self, data: str | bytes) -> int:
        self._held += data.encode(self._encoding) if isinstance(data, str) else data
        while len(self._held) >= PAYLOAD:
            self._stream.write(compress(bytes(self._held[:PAYLOAD]), self._level))
            del self._held[:PAYLOAD]
        return len(data)

    def writelines(self, lines) -> None:
        for line in lines:
            self.write(line)

    def tell(self) -> int:
        return make_virtual_offset(self._stream.tell(), len(self._held))

    def flush(self) -> None:
        if self._held:
            self._stream.write(compress(bytes(self._held), self._level))
            self._held.clear()
        self._stream.flush()

    def read(self, *_):
        raise OSError("opened for writing")

    readline = readlines = seek = truncate = read

    def readable(self) -> bool:
        return False

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    @property
    def closed(self) -> bool:
        return self._stream.closed

    def close(self) -> None:
        if not self.closed:
            self.flush()
            self._stream.write(EOF_BLOCK)
            self._stream.close()

    def __enter__(self) -> BgzfWriter:
        return self

    def __exit__(self, *_) -> None:
        self.close()

"""BGZF: gzip blocks of at most 64 KiB that name their size, so a file can be entered at any block.

A place in the contents is a virtual offset: the block's offset in the file, and 16 bits for the place in the block.
Damage is an error (``Damaged``) unless the caller goes on behind it; a whole file ends with an empty block.
"""

from __future__ import annotations

import struct
import zlib

from ridgeline.sources import files

MAGIC, HEAD = b"\x1f\x8b\x08\x04", 18
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Contents of a block that is written.
FULL = 65_280


class Damaged(ValueError):
    """A file that is cut short or whose blocks don't hold what they say."""


class Blocks:
    """A file's blocks by offset. ``opened`` counts those that were inflated."""

    def __init__(self, uri: str):
        system, path = files.store(uri)
        self.uri, self.file, self.opened = uri, system.open_input_file(path), 0
        self.size = self.file.size()

    def __enter__(self) -> Blocks:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def _bytes(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def whole(self) -> bool:
        """Does the file end as it must?"""
        return self.size >= len(END) and self._bytes(self.size - len(END), len(END)) == END

    def block(self, offset: int) -> tuple[bytes, int] | None:
        """(contents, size on disk); None only at the file's end."""
        if offset == self.size:
            return None
        head = self._bytes(offset, HEAD)
        if len(head) < HEAD or head[:4] != MAGIC or head[12:14] != b"BC":
            raise Damaged(f"{self.uri}: no block starts at {offset} of {self.size} bytes")
        n = struct.unpack("<H", head[16:])[0] + 1
        raw = self._bytes(offset, n)
        if len(raw) < n:
            raise Damaged(f"{self.uri}: the block at {offset} is cut short")
        try:
            data = zlib.decompress(raw[HEAD:-8], -15)
        except zlib.error as e:
            raise Damaged(f"{self.uri}: the block at {offset} is damaged ({e})") from e
        if struct.unpack("<II", raw[-8:]) != (zlib.crc32(data), len(data)):
            raise Damaged(f"{self.uri}: the block at {offset} has another checksum")
        self.opened += 1
        return data, n

    def next_block(self, offset: int, end: int) -> int:
        """Where the first sound block at or after ``offset`` starts; ``end`` if none starts before it."""
        while offset < end:
            window = self._bytes(offset, 1 << 17)
            at = window.find(MAGIC)
            while 0 <= at and offset + at < end:
                try:
                    _, n = self.block(offset + at)
                    if offset + at + n == self.size or self._bytes(offset + at + n, 4) == MAGIC:
                        return offset + at
                except Damaged:
                    pass
                at = window.find(MAGIC, at + 1)
            offset += max(1, len(window) - len(MAGIC) + 1)
        return end


def packed(data: bytes) -> bytes:
    """One block."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    return MAGIC + b"\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


class Writer:
    """Writes contents in blocks to an open stream; ``at`` is the virtual offset of what comes next."""

    def __init__(self, out):
        self.out, self.offset, self.held = out, 0, bytearray()

    @property
    def at(self) -> int:
        return self.offset << 16 | len(self.held)

    def write(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= FULL:
            self._block(FULL)

    def flush(self) -> None:
        """Ends the block, so that what follows starts a new one."""
        if self.held:
            self._block(len(self.held))

    def _block(self, n: int) -> None:
        block = packed(bytes(self.held[:n]))
        self.out.write(block)
        self.offset += len(block)
        del self.held[:n]

    def close(self) -> None:
        self.flush()
        self.out.write(END)

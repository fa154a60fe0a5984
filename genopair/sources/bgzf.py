"""Block-gzip text and its tabix index.

A block-gzip file is a row of small gzip members, each of which tells its own size, so a reader can
begin at any of them; a virtual offset names a block by its place in the file and a byte in what it
holds. The index tells in which virtual offsets the records of a region lie. The formats are public
ones; nothing here knows Spark.
"""

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

from genopair.storage import file_size, read_range

# Fixed values of the public formats: a block's header with its one extra field, the empty block that
# ends a file, the most bytes of a block, the index's magic and its binning.
BLOCK_HEADER = struct.Struct("<4BI2BH2BHH")
BLOCK_MAGIC = b"\x1f\x8b\x08\x04"
END_OF_FILE = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MOST_IN_BLOCK = 0xFF00
MOST_BYTES = 1 << 16
INDEX_MAGIC = b"TBI\x01"
VCF_FORMAT = (2, 1, 2, 0, ord("#"), 0)  # preset, columns of name, begin and end, comment, lines to skip
WINDOW = 14  # bits of a position below the linear index
BIN_LEVELS = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))  # first bin and bits of a position below it
PSEUDO_BIN = 37450

READ_AT_ONCE = 1 << 20


def is_block_gzip(head: bytes) -> bool:
    return block_size(head) is not None


def block_size(head: bytes, at: int = 0) -> int | None:
    """Bytes of the block whose header is at ``at``; None where no header is."""
    if head[at : at + 4] != BLOCK_MAGIC or len(head) < at + 12:
        return None
    (extra,) = struct.unpack_from("<H", head, at + 10)
    field, end = at + 12, at + 12 + extra
    while field + 4 <= min(end, len(head)):
        (length,) = struct.unpack_from("<H", head, field + 2)
        if head[field : field + 2] == b"BC" and length == 2 and field + 6 <= len(head):
            return struct.unpack_from("<H", head, field + 4)[0] + 1
        field += 4 + length
    return None


def compress(text: bytes, level: int = 6) -> bytes:
    """One block of at most ``MOST_IN_BLOCK`` bytes of text."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(text) + packer.flush()
    if len(body) + 26 > MOST_BYTES:
        packer = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = packer.compress(text) + packer.flush()
    head = BLOCK_HEADER.pack(*BLOCK_MAGIC, 0, 0, 255, 6, ord("B"), ord("C"), 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(text), len(text))


def decompress(block: bytes) -> bytes:
    (extra,) = struct.unpack_from("<H", block, 10)
    text = zlib.decompress(block[12 + extra : -8], -15)
    crc, size = struct.unpack("<II", block[-8:])
    if zlib.crc32(text) != crc or len(text) != size:
        raise ValueError("damaged block")
    return text


class Blocks:
    """Blocks of a file from a place on, read a megabyte at a time. ``read`` counts them."""

    def __init__(self, path: str):
        self.path, self.size = path, file_size(path) or 0
        self.start, self.buffer, self.read = 0, b"", 0

    def _have(self, start: int, length: int) -> memoryview:
        end = min(start + length, self.size)
        if start < self.start or end > self.start + len(self.buffer):
            self.start, self.buffer = start, read_range(self.path, start, min(max(length, READ_AT_ONCE), self.size - start))
        return memoryview(self.buffer)[start - self.start : end - self.start]

    def first_from(self, start: int) -> int:
        """Place of the first block that begins at ``start`` or later; the file's size if none does.

        Bytes that look like a header count only if another header or the end of the file follows
        where they say, and what lies between is a block.
        """
        while start < self.size:
            head = bytes(self._have(start, 2 * MOST_BYTES))
            at = head.find(BLOCK_MAGIC)
            if at < 0:
                start += max(1, len(head) - len(BLOCK_MAGIC) + 1)
                continue
            start += at
            if self._is_block(start):
                return start
            start += 1
        return self.size

    def _is_block(self, at: int) -> bool:
        size = block_size(bytes(self._have(at, 512)))
        if size is None or at + size > self.size:
            return False
        after = at + size
        if after < self.size and block_size(bytes(self._have(after, 512))) is None:
            return False
        try:
            decompress(bytes(self._have(at, size)))
        except (ValueError, zlib.error, struct.error):
            return False
        return True

    def from_(self, at: int) -> Iterator[tuple[int, bytes]]:
        """Place and text of each block from the one at ``at`` on."""
        while at < self.size:
            size = block_size(bytes(self._have(at, 512)))
            if size is None:
                raise ValueError(f"{self.path}: no block at {at}")
            yield at, decompress(bytes(self._have(at, size)))
            self.read += 1
            at += size


def lines(blocks: Blocks, start: int, end: int, skip: int | None = None, stop: int | None = None) -> Iterator[list[bytes]]:
    """The lines of the blocks that begin in [start, end), block by block.

    A range cut anywhere has neither ``skip`` nor ``stop``. It begins behind the first line end of its
    blocks, unless it begins the file, and goes on behind its last block to the next line end: what
    one range passes over the one before it reads, so that together they give each line once. With
    ``skip`` a line begins that many bytes into the block at ``start``; with ``stop`` the range holds
    that many bytes of the block at ``end``, and ends there.
    """
    exact = skip is not None or start == 0
    first = start if exact else blocks.first_from(start)
    if first > end or (first == end and not stop):
        return
    rest, dropping = b"", not exact
    for at, text in blocks.from_(first):
        if at == first and skip:
            text = text[skip:]
        if at == end and stop:
            text = text[: stop - (skip or 0 if at == first else 0)]
        elif at >= end:
            if stop is not None or dropping:
                break
            cut = text.find(b"\n")
            rest += text if cut < 0 else text[:cut]
            if cut >= 0:
                yield [rest]
                return
            continue
        if dropping:
            cut = text.find(b"\n")
            if cut < 0:
                continue
            text, dropping = text[cut + 1 :], False
        parts = (rest + text).split(b"\n")
        rest = parts.pop()
        if parts:
            yield parts
        if at == end:
            break
    if rest:
        yield [rest]


def pieces(blocks: Blocks, start: int, end: int, separator: bytes) -> Iterator[list[bytes]]:
    """The text cut at ``separator``, of the blocks that begin in [start, end), block by block; what follows the last separator is a piece, if there is any.

    Ranges cut anywhere give each piece once together: a range has those that begin in its blocks, and reads on
    behind them to the end of its last one. The bytes before its blocks tell whether a separator ends at their begin.
    """
    first = blocks.first_from(start)
    if first >= min(end, blocks.size):
        return
    held, before = b"", blocks.first_from(max(0, first - 2 * MOST_BYTES))
    for at, text in blocks.from_(before):
        if at >= first:
            break
        held = (held + text)[-len(separator) :]
    inside = before == 0 and not held
    for at, text in blocks.from_(first):
        if at >= end and not (inside and held):
            return
        found = (held + text).split(separator)
        held = found.pop()
        if not inside:
            if not found:
                held = held[-len(separator) :]
                continue
            found, inside = found[1:], True
        if at >= end and found:
            yield found[:1]
            return
        if found:
            yield found
    if inside and held:
        yield [held]


# --- the index --------------------------------------------------------------------------------------


def bin_of(begin: int, end: int) -> int:
    """The smallest bin that holds [begin, end)."""
    for first, bits in reversed(BIN_LEVELS):
        if begin >> bits == (end - 1) >> bits:
            return first + (begin >> bits)
    return 0


def bins_over(begin: int, end: int) -> set[int]:
    """All bins that records of [begin, end) can be in."""
    return {b for first, bits in BIN_LEVELS for b in range(first + (begin >> bits), first + ((end - 1) >> bits) + 1)}


class IndexBuilder:
    """Bins and the linear index of records that come in the order of the file."""

    def __init__(self):
        self.names: dict[str, int] = {}
        self.bins: list[dict] = []
        self.linear: list[dict] = []

    def add(self, name: str, begin: int, end: int, at: int, after: int) -> None:
        """A record of [begin, end), whose line lies between two virtual offsets."""
        if name not in self.names:
            self.names[name] = len(self.names)
            self.bins.append(defaultdict(list))
            self.linear.append({})
        k = self.names[name]
        chunks = self.bins[k][bin_of(begin, end)]
        if chunks and chunks[-1][1] == at:
            chunks[-1][1] = after
        else:
            chunks.append([at, after])
        for window in range(begin >> WINDOW, (end - 1 >> WINDOW) + 1):
            self.linear[k].setdefault(window, at)

    def content(self) -> bytes:
        names = b"".join(n.encode() + b"\0" for n in self.names)
        out = [INDEX_MAGIC, struct.pack("<8i", len(self.names), *VCF_FORMAT, len(names)), names]
        for bins, linear in zip(self.bins, self.linear):
            out.append(struct.pack("<i", len(bins)))
            for number, chunks in sorted(bins.items()):
                out.append(struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
            n, last = max(linear, default=-1) + 1, 0
            out.append(struct.pack("<i", n))
            for window in range(n):
                last = linear.get(window, last)
                out.append(struct.pack("<Q", last))
        text = b"".join(out)
        return b"".join(compress(text[at : at + MOST_IN_BLOCK]) for at in range(0, len(text), MOST_IN_BLOCK)) + END_OF_FILE


class Index:
    """A tabix index as read."""

    def __init__(self, content: bytes):
        text, at = [], 0
        while at < len(content):
            size = block_size(content, at)
            if size is None:
                raise ValueError("not an index in blocks")
            text.append(decompress(content[at : at + size]))
            at += size
        data = b"".join(text)
        if data[:4] != INDEX_MAGIC:
            raise ValueError("not a tabix index")
        n, *_, size = struct.unpack_from("<8i", data, 4)
        at = 36
        self.names = [x.decode() for x in data[at : at + size].split(b"\0")[:n]]
        at += size
        self.bins, self.linear = [], []
        for _ in range(n):
            (n_bins,) = struct.unpack_from("<i", data, at)
            at += 4
            bins = {}
            for _ in range(n_bins):
                number, n_chunks = struct.unpack_from("<Ii", data, at)
                flat = struct.unpack_from(f"<{2 * n_chunks}Q", data, at + 8)
                bins[number] = list(zip(flat[::2], flat[1::2]))
                at += 8 + 16 * n_chunks
            (n_windows,) = struct.unpack_from("<i", data, at)
            self.linear.append(struct.unpack_from(f"<{n_windows}Q", data, at + 4))
            at += 4 + 8 * n_windows
            self.bins.append(bins)

    def chunks(self, name: str, begin: int, end: int) -> list[tuple[int, int]]:
        """Ranges of virtual offsets with all records that overlap [begin, end), in order and apart."""
        if name not in self.names or begin >= end:
            return []
        k = self.names.index(name)
        linear = self.linear[k]
        window = begin >> WINDOW
        least = linear[min(window, len(linear) - 1)] if linear else 0
        top = 1 << BIN_LEVELS[0][1]
        wanted = bins_over(min(begin, top - 1), min(end, top))
        found = sorted(c for b, chunks in self.bins[k].items() if b in wanted and b != PSEUDO_BIN for c in chunks if c[1] > least)
        out: list[list[int]] = []
        for a, b in found:
            a = max(a, least)
            # chunks that share a block, or meet, are one range
            if out and a >> 16 <= out[-1][1] >> 16:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return [tuple(c) for c in out]

"""Compound files, the container of legacy office formats: streams by name, with the standard library."""

from __future__ import annotations

import struct

SIGNATURE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
FREE = 0xFFFFFFFA  # sector numbers from here on are marks, not sectors
SMALL = 4096
IN_HEAD = 109  # sectors of the table that the head names


class NoCompound(ValueError):
    pass


class Compound:
    def __init__(self, content: bytes):
        if content[:8] != SIGNATURE:
            raise NoCompound("no compound file")
        self.content = content
        shift, small_shift = struct.unpack_from("<HH", content, 30)
        self.size, self.small_size = 1 << shift, 1 << small_shift
        first_dir, _, self.cutoff, first_small, _, more, n_more = struct.unpack_from("<IIIIIII", content, 48)
        listed = list(struct.unpack_from("<109I", content, 76))
        for _ in range(n_more):
            if more >= FREE:
                break
            block = struct.unpack(f"<{self.size // 4}I", self.sector(more))
            listed += block[:-1]
            more = block[-1]
        self.next: list[int] = []
        for n in listed:
            if n < FREE:
                self.next += struct.unpack(f"<{self.size // 4}I", self.sector(n))
        small = self.chain(first_small)
        self.small_next = struct.unpack(f"<{len(small) // 4}I", small)
        self.entries: dict[str, tuple[int, int]] = {}
        entries = self.chain(first_dir)
        root = (0, 0)
        for at in range(0, len(entries), 128):
            n = struct.unpack_from("<H", entries, at + 64)[0]
            kind, start, length = entries[at + 66], *struct.unpack_from("<IQ", entries, at + 116)
            if kind == 5:
                root = (start, length)
            elif kind == 2:
                self.entries[entries[at : at + max(0, n - 2)].decode("utf-16-le")] = (start, length & 0xFFFFFFFF)
        self.small = self.chain(root[0])

    def sector(self, n: int) -> bytes:
        return self.content[(n + 1) * self.size : (n + 2) * self.size]

    def chain(self, n: int) -> bytes:
        out, seen = [], set()
        while n < FREE and n not in seen:
            seen.add(n)
            out.append(self.sector(n))
            n = self.next[n] if n < len(self.next) else FREE
        return b"".join(out)

    def stream(self, name: str) -> bytes:
        if name not in self.entries:
            raise NoCompound(f"no stream {name}")
        n, length = self.entries[name]
        if length >= self.cutoff:
            return self.chain(n)[:length]
        out, seen = [], set()
        while n < FREE and n not in seen:
            seen.add(n)
            out.append(self.small[n * self.small_size : (n + 1) * self.small_size])
            n = self.small_next[n] if n < len(self.small_next) else FREE
        return b"".join(out)[:length]


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file with these streams (for tests and fixtures); short ones are filled up to the size of large ones."""
    size, marks = 512, []  # marks: the table of sectors
    body: list[bytes] = []

    def put(data: bytes) -> int:
        first, count = len(body), max(1, -(-len(data) // size))
        body.extend(data[k * size : (k + 1) * size].ljust(size, b"\0") for k in range(count))
        marks.extend([*range(first + 1, first + count), 0xFFFFFFFE])
        return first

    placed = {name: (put(data.ljust(SMALL, b"\0")), max(len(data), SMALL)) for name, data in streams.items()}

    def entry(name: str, kind: int, start: int, length: int, child: int = 0xFFFFFFFF, right: int = 0xFFFFFFFF) -> bytes:
        raw = name.encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) + 2, kind, 1, 0xFFFFFFFF, right, child) + bytes(36) + struct.pack("<IQ", start, length)

    names = list(placed)
    listed = entry("Root Entry", 5, 0xFFFFFFFE, 0, 1) + b"".join(entry(n, 2, *placed[n], right=k + 2 if k + 1 < len(names) else 0xFFFFFFFF) for k, n in enumerate(names))
    first_dir = put(listed.ljust(-(-len(listed) // size) * size, b"\0"))
    tables, lists = 1, 0  # sectors of the table, and of the list of those that the head has no room for
    while (len(marks) + tables + lists) * 4 > tables * size:
        tables += 1
        lists = max(0, -(-(tables - IN_HEAD) // (size // 4 - 1)))
    at = len(body)
    marks += [0xFFFFFFFD] * tables + [0xFFFFFFFC] * lists
    raw = struct.pack(f"<{len(marks)}I", *marks).ljust(tables * size, b"\xff")
    body += [raw[k * size : (k + 1) * size] for k in range(tables)]
    places, room, first_list = list(range(at, at + tables)), size // 4 - 1, at + tables
    for k in range(lists):
        part = places[IN_HEAD + k * room : IN_HEAD + (k + 1) * room]
        body.append(struct.pack(f"<{room + 1}I", *part, *[0xFFFFFFFF] * (room - len(part)), first_list + k + 1 if k + 1 < lists else 0xFFFFFFFE))
    head = SIGNATURE + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, tables, first_dir, 0, SMALL, 0xFFFFFFFE, 0, first_list if lists else 0xFFFFFFFE, lists)
    places = places[:IN_HEAD]
    return head + struct.pack("<109I", *places, *[0xFFFFFFFF] * (IN_HEAD - len(places))) + b"".join(body)

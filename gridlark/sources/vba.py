"""VBA projects: the compound file that holds them, and their compressed sources."""

from __future__ import annotations

import struct

from ..errors import MalformedWorkbook

FREE, END = 0xFFFFFFFF, 0xFFFFFFFE
#: Record ids of the project's directory stream.
PROJECT_NAME, MODULE_NAME, MODULE_STREAM, MODULE_OFFSET, CODE_PAGE, REFERENCE_NAME, PROCEDURAL, DOCUMENT = 0x04, 0x19, 0x1A, 0x31, 0x03, 0x16, 0x21, 0x22


class CompoundFile:
    """Streams of a compound binary file by path."""

    def __init__(self, data: bytes):
        if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
            raise MalformedWorkbook("Not a compound file.")
        self.data = data
        self.size, self.small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
        first_directory, _, self.cutoff, first_small = struct.unpack_from("<IIII", data, 48)
        table = [x for x in struct.unpack_from("<109I", data, 76) if x < END]
        more, = struct.unpack_from("<I", data, 68)
        while more < END and len(table) * self.size <= len(data):
            found = struct.unpack(f"<{self.size // 4}I", self._sector(more))
            table += [x for x in found[:-1] if x < END]
            more = found[-1]
        self.next = [x for s in table for x in struct.unpack(f"<{self.size // 4}I", self._sector(s))]
        small = self._chain(first_small)
        self.next_small = list(struct.unpack(f"<{len(small) // 4}I", small))
        directory = self._chain(first_directory)
        self.entries = [directory[i : i + 128] for i in range(0, len(directory), 128)]
        start, = struct.unpack_from("<I", self.entries[0], 116)
        self.mini = self._chain(start)
        self.streams: dict[str, bytes] = {}
        self._walk(struct.unpack_from("<I", self.entries[0], 76)[0], "", set())

    def _sector(self, i: int) -> bytes:
        return self.data[(i + 1) * self.size : (i + 2) * self.size].ljust(self.size, b"\0")

    def _chain(self, at: int) -> bytes:
        out, seen = [], 0
        while at < END and seen * self.size <= len(self.data):
            out.append(self._sector(at))
            at = self.next[at] if at < len(self.next) else END
            seen += 1
        return b"".join(out)

    def _walk(self, i: int, folder: str, seen: set[int]) -> None:
        if i >= len(self.entries) or i in seen:
            return
        seen.add(i)
        e = self.entries[i]
        length, kind = struct.unpack_from("<HB", e, 64)
        name = e[: max(0, length - 2)].decode("utf-16-le", "replace")
        left, right, child = struct.unpack_from("<III", e, 68)
        start, size = struct.unpack_from("<IQ", e, 116)
        self._walk(left, folder, seen)
        if kind == 1:
            self._walk(child, f"{folder}{name}/", seen)
        elif kind == 2:
            self.streams[f"{folder}{name}".lower()] = self._stream(start, size)
        self._walk(right, folder, seen)

    def _stream(self, at: int, size: int) -> bytes:
        if size >= self.cutoff:
            return self._chain(at)[:size]
        out = []
        while at < END and len(out) * self.small < size:
            out.append(self.mini[at * self.small : (at + 1) * self.small])
            at = self.next_small[at] if at < len(self.next_small) else END
        return b"".join(out)[:size]


def decompress(data: bytes) -> bytes:
    """A compressed container: chunks of literals and copies from what the chunk has given so far."""
    if not data or data[0] != 1:
        raise MalformedWorkbook("Not a compressed stream.")
    out, at = bytearray(), 1
    while at + 2 <= len(data):
        head, = struct.unpack_from("<H", data, at)
        end = min(len(data), at + (head & 0xFFF) + 3)
        at += 2
        start = len(out)
        if not head & 0x8000:
            out += data[at:end]
            at = end
            continue
        while at < end:
            flags = data[at]
            at += 1
            for bit in range(8):
                if at >= end:
                    break
                if not flags >> bit & 1:
                    out.append(data[at])
                    at += 1
                    continue
                token, = struct.unpack_from("<H", data, at)
                at += 2
                bits = max(4, (len(out) - start - 1).bit_length())
                offset, length = (token >> (16 - bits)) + 1, (token & (0xFFFF >> bits)) + 3
                if offset > len(out) - start:
                    raise MalformedWorkbook("A copy reaches before its chunk.")
                for _ in range(length):
                    out.append(out[-offset])
    return bytes(out)


def project(data: bytes) -> list[dict]:
    """Items of kind vba_project, vba_reference and vba_module; a module's detail is its source text."""
    streams = CompoundFile(data).streams
    found = next((s for n, s in streams.items() if n.endswith("vba/dir")), None)
    if found is None:
        raise MalformedWorkbook("The macro project has no directory.")
    records, at, directory = [], 0, decompress(found)
    while at + 6 <= len(directory):
        kind, size = struct.unpack_from("<HI", directory, at)
        if kind == 0x09:  # the version's size doesn't count its minor part
            size = 6
        records.append((kind, directory[at + 6 : at + 6 + size]))
        at += 6 + size
    page, name, out, module = "cp1252", None, [], None
    item = lambda kind, name, detail=None, parts=(): {"sheet": None, "kind": kind, "name": name, "ref": None, "parts": list(parts), "detail": detail}
    modules = []
    for kind, value in records:
        if kind == CODE_PAGE and len(value) >= 2:
            page = f"cp{struct.unpack_from('<H', value)[0]}"
        elif kind == PROJECT_NAME:
            name = value.decode(page, "replace")
        elif kind == REFERENCE_NAME:
            out.append(item("vba_reference", value.decode(page, "replace")))
        elif kind == MODULE_NAME:
            module = {"name": value.decode(page, "replace"), "stream": None, "offset": 0, "type": "procedural"}
            modules.append(module)
        elif module is not None and kind == MODULE_STREAM:
            module["stream"] = value.decode(page, "replace")
        elif module is not None and kind == MODULE_OFFSET and len(value) >= 4:
            module["offset"] = struct.unpack_from("<I", value)[0]
        elif module is not None and kind == DOCUMENT:
            module["type"] = "document"
    for m in modules:
        stream = streams.get(f"vba/{m['stream'] or m['name']}".lower())
        source = decompress(stream[m["offset"] :]).decode(page, "replace") if stream and len(stream) > m["offset"] else None
        out.append(item("vba_module", m["name"], source, [m["type"]]))
    return [item("vba_project", name), *out]

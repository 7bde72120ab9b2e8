"""Secrets in texts, also under nested encodings.

Every text is a layer. A worklist takes layers one by one: it scans the layer, finds what is encoded
in it, and puts each decoded layer back, until no layer yields another:

* percent and Unicode escapes are decoded in their whole line, so that a finding may begin before an
  escape and end behind it, and bytes of which only some are escaped come together;
* base64, plain or URL-safe, also wrapped over lines, is decoded from each of four characters on,
  because a separator before it may belong to its alphabet;
* UTF-16 of ASCII letters, either way round, loses its zeros;
* gzip, zlib, bzip2, xz and Zstandard bytes, of one or several members and also cut off, are unpacked
  as a stream and scanned in overlapping windows, wherever in a layer they begin.

Decoded bytes become characters one by one (Latin-1): all that is looked for is ASCII, and so every
character keeps its place. A layer that was seen before at the same place of the text, as a compressed
file that holds itself gives, is not taken again; the same content at another place is.
Every layer carries, for each of its characters, the span of the original text it came from, so
findings in any layer are spans of the original.
"""

from __future__ import annotations

import base64
import bz2
import gzip
import hashlib
import io
import lzma
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import arrow_map, texts

#: The three kinds of secrets, in their order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # whole runs: a run of fewer never matches, a longer one is taken from its start
ASSIGN_WORDS = ("passw", "secret", "token", "api")

LINE = re.compile(r"[^\n]+")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,6})\}|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{8,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
#: Where compressed bytes may begin: gzip, bzip2, xz, Zstandard, zlib. Fixed values of those formats.
MAGIC = r"\x1f\x8b\x08[\x00-\x1f]|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|x[\x01\x5e\x9c\xda]"
PACKED, PACKED_BYTES = re.compile(MAGIC), re.compile(MAGIC.encode())
LATIN = re.compile(r"[\x00-\xff]+")
WIDE = re.compile(r"(?:[\x09-\x7e]\x00){8,}|(?:\x00[\x09-\x7e]){8,}")
#: Decoded bytes without any of these hold neither a secret nor another layer.
LEADS = re.compile(rb"(?i)passw|secret|token|api_?key|akia|[0-9a-f]{32}|%[0-9a-f]{2}|\\[ux]|[a-z0-9+/_-]{8}\r?\n|[a-z0-9+/_-]{16}|(?:[\x09-\x7e]\x00){8}")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets in one layer."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def zlib_members(data: bytes, n: int) -> Iterator[bytes]:
    while data[:1] == b"\x78":
        member, rest = zlib.decompressobj(), data
        while not member.eof and (chunk := member.decompress(rest, n)):
            yield chunk
            rest = member.unconsumed_tail
        data = member.unused_data if member.eof else b""


def opened(data: bytes, n: int = 1 << 20) -> Iterator[bytes] | None:
    """The content of compressed bytes in chunks of at most ``n``, None if they don't look compressed."""
    source = io.BytesIO(data)
    if data[:3] == b"\x1f\x8b\x08":
        read: Callable[[int], bytes] = gzip.GzipFile(fileobj=source).read1
    elif data[:3] == b"BZh":
        read = bz2.BZ2File(source).read1
    elif data[:6] == b"\xfd7zXZ\x00":
        read = lzma.LZMAFile(source).read1
    elif data[:4] == b"\x28\xb5\x2f\xfd":
        read = zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True).read1
    elif len(data) > 2 and data[0] == 0x78 and (data[0] << 8 | data[1]) % 31 == 0:
        return zlib_members(data, n)
    else:
        return None
    return iter(lambda: read(n), b"")


def starts_packed(head: bytes) -> bool:
    """Whether bytes begin as compressed ones do: a little of them unpacks, or more of them is needed."""
    if opened(head) is None:
        return False
    if head[:1] == b"x":
        try:
            zlib.decompressobj().decompress(head)
        except zlib.error:
            return False
    return True


def extent(data: bytes, n: int = 1 << 20) -> tuple[int, bool]:
    """How many bytes the compressed members at the start of ``data`` take, and whether they end there: else all of them, as for Zstandard."""
    rest = data
    try:
        while opened(rest) is not None and rest[:4] != b"\x28\xb5\x2f\xfd":
            if rest[:3] == b"BZh" or rest[:6] == b"\xfd7zXZ\x00":
                stream = bz2.BZ2Decompressor() if rest[:3] == b"BZh" else lzma.LZMADecompressor()
                stream.decompress(rest, n)
                while not stream.eof and not stream.needs_input:
                    stream.decompress(b"", n)
            else:
                stream = zlib.decompressobj(47)
                stream.decompress(rest, n)
                while not stream.eof and stream.unconsumed_tail:
                    stream.decompress(stream.unconsumed_tail, n)
            if not stream.eof:
                return len(data), False
            rest = stream.unused_data
    except (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError):
        return len(data), False
    return (len(data) - len(rest), True) if len(rest) < len(data) and rest[:4] != b"\x28\xb5\x2f\xfd" else (len(data), False)


def unpacked(data: bytes) -> Iterator[bytes]:
    """What can be unpacked of ``data``: a stream that is cut off or only looks compressed ends where it breaks."""
    try:
        yield from opened(data) or ()
    except (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError, zstandard.ZstdError):
        return


class Worklist:
    """Layers of one text: (characters, their starts, their ends), without numbers for the text itself, two numbers for unpacked bytes.

    ``window`` bounds what is unpacked and scanned at once; windows overlap by ``overlap``. Compressed
    bytes inside of compressed bytes are unpacked if they are at most ``most``, else counted in ``skipped``.
    """

    def __init__(self, text: str, most: int = 64 << 20, window: int = 4 << 20, overlap: int = 1 << 16) -> None:
        self.most, self.window, self.overlap, self.skipped = most, window, overlap, 0
        self.seen: set[bytes] = set()
        self.todo: list[tuple] = [(text, None, None)]

    def put(self, text: str, starts, ends) -> None:
        mark = hashlib.sha256(text.encode("utf-8", "surrogatepass"))
        mark.update(np.asarray(starts, np.int64).tobytes() + b"|" + np.asarray(ends, np.int64).tobytes())
        if text and mark.digest() not in self.seen:
            self.seen.add(mark.digest())
            self.todo.append((text, starts, ends))

    def put_packed(self, data: bytes, start: int, end: int) -> bool:
        """Unpack compressed bytes; all of their characters come from the whole segment. False if they are not compressed."""
        chunks = unpacked(data)
        held = next(chunks, b"")
        if not held:
            return False
        mark = hashlib.sha256(data + b"%d:%d" % (start, end)).digest()
        if mark in self.seen:
            return True
        self.seen.add(mark)
        if opened(held) is not None:  # compressed again
            inner = bytearray(held)
            while len(inner) <= self.most and (chunk := next(chunks, b"")):
                inner += chunk
            if len(inner) > self.most:
                self.skipped += 1
                return True
            if self.put_packed(bytes(inner), start, end):
                return True
            held, chunks = bytes(inner), iter(())
        for chunk in chunks:
            held += chunk
            if len(held) >= self.window:
                self.put_bytes(held, start, end)
                held = held[-self.overlap :]
        self.put_bytes(held, start, end)
        return True

    def put_bytes(self, data: bytes, starts, ends) -> None:
        if LEADS.search(data) or PACKED_BYTES.search(data):
            self.put(data.decode("latin-1"), starts, ends)

    def run(self) -> set[tuple[int, int, int]]:
        found = set()
        while self.todo:
            text, starts, ends = self.todo.pop()
            for s, kind, e in scan(text):
                if starts is None:
                    found.add((s, kind, e))
                elif isinstance(starts, int):
                    found.add((starts, kind, ends))
                else:
                    found.add((int(starts[s]), kind, int(ends[s:e].max())))
            self.unwrap(text, starts, ends)
        return found

    def unwrap(self, text: str, starts, ends) -> None:
        if starts is None:
            of = lambda at: (at, at + 1)
        elif isinstance(starts, int):
            of = lambda at: (np.full(len(at), starts), np.full(len(at), ends))
        else:
            of = lambda at: (starts[at], ends[at])
        for sign, escape, decode in (("%", PERCENT, self.percent), ("\\", UNICODE, self.unicode)):
            if sign in text and escape.search(text):
                for line in LINE.finditer(text):
                    if sign in line[0] and escape.search(line[0]):
                        decode(line[0], line.start(), of)
        self.compressed(text, of)
        if "\0" in text:
            for m in WIDE.finditer(text):
                one = m.start() + (text[m.start()] == "\0")  # the letters; each one's zero stands behind or before it
                at = np.arange(one, m.end(), 2)
                low = at - (one - m.start())
                self.put(text[one : m.end() : 2], of(low)[0], of(low + 1)[1])
        for m in BASE64.finditer(text):
            self.base64(m[0], np.arange(m.start(), m.end()), of)
        if "\n" in text:
            for m in WRAPPED.finditer(text):
                at = np.array([i for i, c in enumerate(m[0], m.start()) if c not in "\r\n \t"])
                self.base64("".join(m[0].split()), at, of)
                # Where the first line is no part of it, base64 begins with the second.
                rest = m[0].index("\n")
                if len(m[0]) - rest > 17:
                    self.base64("".join(m[0][rest:].split()), at[len("".join(m[0][:rest].split())) :], of)

    def compressed(self, text: str, of: Callable) -> None:
        """Unpack what is compressed in a layer, at any place of it; members that follow each other come with the first."""
        if not PACKED.search(text):
            return
        for run in LATIN.finditer(text):
            if not PACKED.search(text, run.start(), run.end()):
                continue
            data, done = memoryview(run[0].encode("latin-1")), 0
            for m in PACKED.finditer(text, run.start(), run.end()):
                first = m.start() - run.start()
                if first < done or not starts_packed(bytes(data[first : first + 512])):
                    continue
                held = bytes(data[first:])
                size, whole = extent(held)
                starts, ends = of(np.array([m.start(), m.start() + size - 1]))
                if self.put_packed(held[:size], int(starts[0]), int(ends[1])) and whole:
                    done = first + size

    def base64(self, run: str, at: np.ndarray, of: Callable) -> None:
        """Decode a run at the places ``at``, the padding at its end included."""
        run = run.rstrip("=").replace("-", "+").replace("_", "/")
        for phase in range(4):
            body = run[phase:]
            body = body[: len(body) - (len(body) % 4 == 1)]
            if len(body) < 8:
                continue
            data = base64.b64decode(body + "=" * (-len(body) % 4))
            starts, ends = of(at[[phase, -1]])
            if self.put_packed(data, int(starts[0]), int(ends[1])) or not (LEADS.search(data) or PACKED_BYTES.search(data)):
                continue
            byte = np.arange(len(data))
            self.put(data.decode("latin-1"), of(at[phase + byte * 4 // 3])[0], of(at[phase + ((byte + 1) * 4 + 2) // 3 - 1])[1])

    def _replaced(self, line: str, base: int, of: Callable, first: np.ndarray, stop: np.ndarray, codes: np.ndarray) -> None:
        """Put a line in which each escape (first, stop) is the character of its code."""
        points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").copy()
        points[first] = np.where((codes < 0x110000) & ((codes < 0xD800) | (codes > 0xDFFF)), codes, 0xFFFD)
        inside = np.zeros(len(points) + 1, np.int64)
        np.add.at(inside, first + 1, 1)
        np.add.at(inside, stop, -1)
        kept = np.flatnonzero(np.cumsum(inside)[:-1] == 0)
        last = np.arange(len(points))
        last[first] = stop - 1
        self.put(points[kept].tobytes().decode("utf-32-le", "surrogatepass"), of(base + kept)[0], of(base + last[kept])[1])

    def percent(self, line: str, base: int, of: Callable) -> None:
        points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")
        digit = DIGITS[np.minimum(points, 128)]
        first = np.flatnonzero((points[:-2] == 37) & (digit[1:-1] >= 0) & (digit[2:] >= 0))
        self._replaced(line, base, of, first, first + 3, digit[first + 1] * 16 + digit[first + 2])

    def unicode(self, line: str, base: int, of: Callable) -> None:
        found = [(m.start(), m.end(), int(m[1] or m[2] or m[3] or m[4], 16)) for m in UNICODE.finditer(line)]
        first, stop, codes = np.array(found, np.int64).T
        # Two halves of a letter beyond 16 bits are one character.
        high = (codes[:-1] >> 10 == 0x36) & (codes[1:] >> 10 == 0x37) & (stop[:-1] == first[1:])
        at = np.flatnonzero(high)
        codes[at], stop[at] = 0x10000 + ((codes[at] & 0x3FF) << 10) + (codes[at + 1] & 0x3FF), stop[at + 1]
        keep = np.ones(len(first), bool)
        keep[at + 1] = False
        self._replaced(line, base, of, first[keep], stop[keep], codes[keep])


#: The value of each ASCII hex digit, -1 for other characters.
DIGITS = np.array([int(chr(c), 16) if chr(c) in "0123456789abcdefABCDEF" else -1 for c in range(129)], np.int64)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


FOUND = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_unscanned", pa.int64())])
FOUND_DDL = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_unscanned long"


def secret_scan(docs: DataFrame, most_packed: int = 64 << 20) -> DataFrame:
    """Secrets of every whole text, in one pass without a shuffle.

    ``n_*`` and ``base_sha256`` are those of the text itself, ``spans`` has the decoded layers'
    findings too. Unpacked bytes are scanned whole, in windows that overlap: only an encoded run of
    over 64 KB across a border of 4 MB, or compressed bytes of over ``most_packed`` inside of compressed
    bytes, is not unwrapped; the latter are counted in ``n_unscanned``. A null text is empty; null
    keys stay; repeated rows give repeated rows; an empty table gives none; other columns are not read.
    """

    def each(batch: pa.RecordBatch) -> dict:
        out: dict = {f.name: [] for f in FOUND}
        out["doc_id"] = batch.column(0)
        for text in batch.column(1).to_pylist():
            base = scan(text)
            work = Worklist(text, most_packed)
            spans = work.run()
            kinds = [k for _, k, _ in base]
            for k, name in enumerate(KINDS):
                out[f"n_{name}"].append(kinds.count(k))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
            out["n_unscanned"].append(work.skipped)
        return out

    return texts(docs).mapInArrow(arrow_map(FOUND, each, 256), FOUND_DDL)

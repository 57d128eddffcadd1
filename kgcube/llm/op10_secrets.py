"""Secret scans with a recursive decoding worklist.

Every text is layer 0. A layer is searched for secrets and for encoded parts. Its URL and backslash escapes
and HTML references together, its quoted-printable escapes, the plus signs of form data and its base64 runs of text
are each replaced in the whole layer, so that a secret may stand in several encoded parts and plain ones, and
each base64 run, whose lines are joined first, is decoded by itself too. Each gives a new layer that knows where its
characters come from, and new layers join the worklist until none is left. A layer whose content was seen before in
the same document is not opened again, so cycles and repeated blobs end.

Encodings: URL escapes (%41, %u0041), backslash escapes (\\u0041, \\u{41}, \\U00000041, \\x41, \\101), HTML references
(&#65; &#x41; &quot;), quoted-printable (=41), base64 (plain or URL-safe), UTF-16, and below another encoding the
compressed forms gzip, zlib, raw deflate, bzip2 and xz, anywhere in what was decoded or decompressed. Decoded bytes
needn't be text: each is the character of its number, as all that is searched for is ASCII. A base64 run is decoded from
each of its first four characters, so that what is glued to it doesn't matter; raw deflate, which has no mark of its
own, is tried from the first. A span found in a decoded layer is reported in the original text, from the first to the
last character that carries it; of what was compressed that is all of it.

Defined cases: a null text is empty and has no spans; equal spans are reported once; repeated rows are
scanned one by one; an empty table gives an empty table; further columns don't matter. Of a very long text a layer holds
its characters and the places of what was replaced, not a number a character. Compressed data of any number of members
are a stream, chained for data compressed again at once, and searched in overlapping parts of ``MOST_LAYER`` bytes as
they come, so that a bomb can't fill the memory; of a chain of over ``CHAIN`` compressions the last is opened as a layer of
its own. Only what is compressed, encoded as text and then compressed again is cut where such a part ends.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgcube.llm.words import chunks

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

URL_RUN, URL = re.compile(r"[A-Za-z0-9_.~+/=:&%-]+"), re.compile(r"%[0-9A-Fa-f]{2}")
FORM = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?(?:\++[:=]|[:=]\+)", re.A)
# The names of HTML references that can stand in a secret's pattern.
NAMED = {"quot": '"', "apos": "'", "amp": "&", "equals": "=", "colon": ":", "lowbar": "_", "plus": "+", "sol": "/", "period": ".", "nbsp": " "}


def _char(digits: str, base: int = 16) -> str:
    return chr(n) if (n := int(digits, base)) < 0x110000 else "\ufffd"


#: Escapes by number in base 16 (groups 1 to 7), 8 and 10, and by name, which are replaced together; and quoted-printable,
#: which is by itself, as an equals sign also stands before a plain secret.
ESCAPE = re.compile(r"%u([0-9A-Fa-f]{4})|%([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,8})\}|\\U([0-9A-Fa-f]{8})|&#[xX]([0-9A-Fa-f]{1,6});?|\\([0-3][0-7]{2})|&#([0-9]{1,7});?|&(" + "|".join(NAMED) + ");")
PRINTABLE = re.compile(r"=([0-9A-F]{2})|=\r?\n")


def _escape(m: re.Match) -> str:
    kind = m.lastindex
    return NAMED[m[10]] if kind == 10 else _char(m[kind], 10 if kind == 9 else 8 if kind == 8 else 16)


BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)*={0,2}")
MAGIC = ((b"\x1f\x8b", lambda: zlib.decompressobj(31)), (b"x", lambda: zlib.decompressobj()), (b"BZh", bz2.BZ2Decompressor), (b"\xfd7zXZ", lzma.LZMADecompressor))
PACKED = r"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00"
START, WIDE = re.compile(PACKED), re.compile(r"(?:[\x01-\xff]\x00){12,}|(?:\x00[\x01-\xff]){12,}")
#: Bytes without any of these hold no secret, neither plain nor encoded: the shortest has 12 characters.
WORTH = re.compile(rb"[\x20-\x7e]{12}|(?:[\x01-\xff]\x00){12}|(?:\x00[\x01-\xff]){12}|" + PACKED.encode())
PLAIN = re.compile(rb"[\x20-\x7e\r\n\t]+")

#: Bytes of a decompressed layer that are held at once, and how far two parts of it overlap.
MOST_LAYER, OVERLAP = 4 << 20, 1 << 16
#: Bytes that a decompressor is fed at once, and compressions of compressions that are chained.
FEED, CHAIN = 1 << 16, 50

#: First and last end of what carries a character.
Place = Callable[[int], int]

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the secrets that stand in plain sight."""
    found = []
    lowered = text.lower()
    if any(w in lowered for w in WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return found


def replaced(text: str, pieces: list[tuple[int, int, str]], within: list[tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[str, Place, Place]:
    """The whole text with pieces (start, end, new characters) in their places, and where its characters come from;
    ``within`` has the places of each piece's own characters, without it the whole piece carries them."""
    out, at = [], 0
    for start, end, new in pieces:
        out += [text[at:start], new]
        at = end
    starts, ends = (np.fromiter((p[k] for p in pieces), np.int64, len(pieces)) for k in (0, 1))
    sizes = np.fromiter((len(p[2]) for p in pieces), np.int64, len(pieces))
    first = starts + np.cumsum(sizes - (ends - starts)) - (sizes - (ends - starts))  # of the piece's characters in the new text

    def place(i: int, last: bool) -> int:
        k = int(np.searchsorted(first, i, "right")) - 1
        if k >= 0 and i < first[k] + sizes[k]:
            return int(within[k][last][i - first[k]] if within else (ends if last else starts)[k])
        return i + last if k < 0 else int(ends[k] + i - first[k] - sizes[k]) + last

    return "".join([*out, text[at:]]), lambda i: place(i, False), lambda i: place(i, True)


def deflated(data: bytes) -> Iterator[bytes]:
    """What raw deflate holds, in parts of at most MOST_LAYER, if all of the data are: so the first part must come from
    data that either go on or end as they should."""
    d, first = zlib.decompressobj(-15), True
    while not d.eof:
        try:
            out = d.decompress(data, MOST_LAYER)
        except zlib.error:
            return
        data = d.unconsumed_tail
        if not out or len(d.unused_data) >= 4 or (first and not (d.eof or data or len(out) == MOST_LAYER)):
            return
        yield out
        first = False


def inflated(source: Iterator[bytes], done: list[int]) -> Iterator[bytes]:
    """What a stream of bytes holds if it begins with compressed data, in parts of at most MOST_LAYER, with
    the members that follow the first one. done[0]: bytes of the members that have ended."""
    data, fed = b"", 0
    while True:
        while len(data) < 8 and (more := next(source, None)) is not None:
            data, fed = data + more, fed + len(more)
        new = next((new for magic, new in MAGIC if data.startswith(magic)), None)
        if new is None:
            return
        d = new()
        try:
            while not d.eof:
                out = d.decompress(data, MOST_LAYER)
                if out:
                    yield out
                data = getattr(d, "unconsumed_tail", b"")
                if not (out or data or d.eof) and getattr(d, "needs_input", True):
                    if (data := next(source, None)) is None:
                        return
                    fed += len(data)
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            return
        data = d.unused_data
        done[0] = fed - len(data)
        data = data.lstrip(b"\0")


def opened(source: Iterator[bytes], done: list[int], above: tuple[bytes, ...] = ()) -> Iterator[tuple[str, bool]]:
    """Overlapping texts of all that is compressed in a stream from its beginning on."""
    return searched(inflated(source, done), above)


def searched(parts: Iterator[bytes], above: tuple[bytes, ...] = ()) -> Iterator[tuple[str, bool]]:
    """Overlapping texts of decompressed parts, and of what is compressed in these from their beginning on; no level is held as a
    whole. A stream that begins like one above it isn't opened again. With each text: does it begin with compressed
    data that this chain doesn't open?"""
    waiting, tail = [], b""
    if (first := next(parts, None)) is None:
        return
    begins = hashlib.blake2b(first, digest_size=16).digest()
    full = len(above) >= CHAIN and begins not in above

    def own() -> Iterator[tuple[str, bool]]:
        nonlocal tail
        while waiting:
            whole = tail + waiting.pop(0)
            yield whole.decode("latin-1"), full
            tail = whole[-OVERLAP:]

    def passing() -> Iterator[bytes]:
        for x in chain([first], parts):
            waiting.append(x)
            yield x

    through = passing()
    if begins not in above and not full:
        for text in opened(through, [0], (*above, begins)):
            yield from own()
            yield text
    for _ in through:
        yield from own()
    yield from own()


def below(data: bytes, start: int = 0) -> Iterator[tuple[str, bool, int]]:
    """Texts of what is compressed anywhere in the data from a place on, and where it begins."""
    end = start
    for m in START.finditer(data.decode("latin-1"), start):
        if (at := m.start()) >= end:
            done = [0]
            for out, full in opened((data[i : i + FEED] for i in range(at, len(data), FEED)), done):
                yield out, full, at
            end = at + done[0]


Layer = tuple[str, Place, Place, bool | None]


def encoded(text: str, opens: bool | None) -> Iterator[Layer]:
    """Decoded layers of a text: (text, where a character begins and ends in this text, and for decompressed ones whether
    they begin with what is still to be opened). A byte of an URL escape is the character of its number: all that is
    searched for is ASCII. ``opens`` is that of the text itself, none if it wasn't decompressed."""
    def one(start: int, end: int) -> tuple[Place, Place]:
        return lambda i: start, lambda i: end

    if opens is not None and START.search(text, 0 if opens else 1):
        for out, full, _ in below(text.encode("latin-1"), 0 if opens else 1):
            yield out, *one(0, len(text)), full
    if ("%" in text or "\\" in text or "&" in text) and (pieces := [(m.start(), m.end(), _escape(m)) for m in ESCAPE.finditer(text)]):
        yield *replaced(text, pieces), None
    if "=" in text and (pieces := [(m.start(), m.end(), _char(m[1]) if m[1] else "") for m in PRINTABLE.finditer(text)]):
        yield *replaced(text, pieces), None
    if "+" in text and FORM.search(text):
        yield text.replace("+", " "), lambda i: i, lambda i: i + 1, None
    if "%" in text:
        for m in URL_RUN.finditer(text):
            if URL.search(m[0]):
                for out, full, _ in below(unquote_to_bytes(m[0])):
                    yield out, *one(m.start(), m.end()), full
    texts, within = [], []
    for m in BASE64.finditer(text):
        run = m[0].rstrip("=")
        where = np.arange(m.start(), m.start() + len(run))
        if not run.isascii() or any(c in run for c in "\r\n\t "):
            where = where[~np.isin(np.frombuffer(run.encode("utf-32-le"), "<u4"), [13, 10, 9, 32])]
            run = re.sub(r"[\r\n\t ]", "", run)
        run = run.replace("-", "+").replace("_", "/")
        for k in range(4):
            n = len(run) - k - ((len(run) - k) % 4 == 1)
            data = base64.b64decode(run[k : k + n] + "=" * (-n % 4))
            if not k:
                for out, full in searched(deflated(data)):
                    yield out, *one(m.start(), m.end()), full
            if not WORTH.search(data):
                continue
            begin = lambda i, w=where, k=k: int(w[k + i // 3 * 4 + i % 3])
            stop = lambda i, w=where, k=k: int(w[k + i // 3 * 4 + i % 3 + 1]) + 1
            yield data.decode("latin-1"), begin, stop, None
            if not k and PLAIN.fullmatch(data):
                at = np.arange(len(data))
                at = at // 3 * 4 + at % 3
                ends = where[at + 1] + 1
                ends[-1] = m.end()
                texts.append((m.start(), m.end(), data.decode("latin-1")))
                within.append((where[at], ends))
            for out, full, i in below(data):
                yield out, *one(begin(i), m.end()), full
    if texts:
        yield *replaced(text, texts, within), None
    if "\0" in text:
        for m in WIDE.finditer(text):
            at = m.start() + (m[0][0] == "\0")
            yield text[at : m.end() : 2], lambda i, at=at: at + 2 * i, lambda i, at=at: at + 2 * i + 1, None


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each sorted by start and kind."""
    base = base_spans(text)
    found, seen, work = set(base), {(digest(text), 0)}, [(encoded(text, None), None)]

    def origin(i: int, node: tuple | None, last: bool) -> int:
        while node:
            i = node[1 if last else 0](i) - last
            node = node[2]
        return i + last

    while work:  # depth first, so that only one layer of each depth is held
        layers, above = work[-1]
        if (layer := next(layers, None)) is None:
            work.pop()
            continue
        out, begin, stop, full = layer
        if not out:
            continue
        node = (begin, stop, above)
        if (key := (digest(out), origin(0, node, False))) in seen:
            continue
        seen.add(key)
        found |= {(origin(s, node, False), origin(e - 1, node, True), kind) for s, e, kind in base_spans(out)}
        work.append((encoded(out, full), node))
    order = lambda x: (x[0], x[2], x[1])
    return sorted(base, key=order), sorted(found, key=order)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in found)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: secrets in plain sight by kind, and the spans of all secrets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                rows = [spans(t or "") for t in part.column("text").to_pylist()]
                n = [[sum(x[2] == k for x in base) for base, _ in rows] for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in n), pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in rows], pa.string()), pa.array([joined(a) for _, a in rows], pa.string())],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for s, e, _ in spans(text)[1]:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with each secret in their text replaced by a mark; n_chars, if there, follows."""
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                old = part.column("text").to_pylist()
                new = [t if t is None else redacted(t, mark) for t in old]
                k = part.schema.get_field_index("text")
                part = part.set_column(k, part.schema.field(k), pa.array(new, part.schema.field(k).type))
                j = part.schema.get_field_index("n_chars")
                if j >= 0:
                    sizes = [c if a == b else len(b) for a, b, c in zip(old, new, part.column(j).to_pylist(), strict=True)]
                    part = part.set_column(j, part.schema.field(j), pa.array(sizes, part.schema.field(j).type))
                yield part

    return docs.mapInArrow(run, fields)

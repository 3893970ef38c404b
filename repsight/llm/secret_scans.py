"""#6 Secret scans with a recursive decoding worklist.

Three base kinds are searched in the text as it stands. Besides, encoded
stretches are unwrapped: percent escapes, Unicode escapes, base64, and
compressed bytes inside base64. Each unwrapped layer is searched again and may
hold further encoded stretches, which join the worklist; a layer whose content
was already met at the same place of the text isn't unwrapped again, so the
list ends. Every character of a layer knows the stretch of the original text
it came from; a secret found in a layer is reported at that place, under the
kind ``<layer>/<layer>/.../<kind>``.

A base64 stretch may be wrapped into lines and glued to other characters of
its alphabet: lines are joined, it is decoded at each of the four alignments,
and compressed bytes are looked for at every ``H4sI`` and the like. Joined lines hold nothing but 16 or more characters of
base64 and blanks around them; only the first and the last may be shorter.

Decoded bytes are searched wherever they hold ``LEAST`` printable characters
in a row, in UTF-8 (other bytes stand for themselves) or UTF-16; no base kind
and no encoding of one is shorter. Concatenated compressed members are one
layer; of damaged ones, what comes before the damage is searched.

Edge cases: null and empty texts have no spans; null doc_ids and repeated rows
are scanned row by row; further columns are ignored, whatever their names; an
empty table gives an empty table. A compressed layer that unpacks to more than
``MAX_LAYER_BYTES`` is reported as kind ``oversized`` and searched in segments
of about that size, which bounds a task's memory against decompression bombs;
a segment repeats the end of its predecessor: ``OVERLAP`` bytes, or from where
an encoded stretch begins that the end cuts (up to half a segment).
"""

from __future__ import annotations

import base64
import bz2
import itertools
import lzma
import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("assign", "access", "hex")
MAX_LAYER_BYTES = 64 << 20
OVERLAP = 1 << 16
#: Bytes handed to a decompressor and taken from it at once.
STEP = 1 << 16
#: Characters of the shortest base kind (``token=`` and six more).
LEAST = 12

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: A hex or access match that is long enough stands inside a run of this kind.
_LONG_RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Base64 long enough for LEAST bytes; lines are joined, the first and the last may be shorter.
_BASE64 = re.compile(r"(?:(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++[ \t]*+\r?\n[ \t]*+)?[A-Za-z0-9+/_-]{16,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]{16,}+)*+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)?+={0,2}")
_SYMBOL = re.compile(r"[A-Za-z0-9+/_-]")
_ONE_RUN = dict.fromkeys(map(ord, " \t\r\n=")) | {ord("-"): "+", ord("_"): "/"}
#: Where compressed bytes may begin in base64: gzip, bzip2 and xz anywhere, zlib (two bytes) at the start of a run or line and after a delimiter.
_PACKED = re.compile(r"H4sI|Qlpo|[/_]Td6WFoA|(?<![A-Za-z0-9])(?:eA[E-H]|eF[4-7]|eJ[w-z]|eN[o-r])")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
_PRINTABLE = re.compile(rb"[\x20-\x7e\t\r\n]{%d}" % LEAST)
_WIDE = re.compile(rb"((?:[\x20-\x7e\t\r\n]\x00){%d,})|(?:\x00[\x20-\x7e\t\r\n]){%d,}" % (LEAST, LEAST))
#: Bytes of encoded stretches, also wrapped or in UTF-16.
_STRETCH = re.compile(rb"[A-Za-z0-9+/_=%\\&#;\r\n\t\x00-]*")

Found = list[tuple[str, int, int]]


def find(text: str) -> Found:
    """(kind, start, end) of the base kinds in one text or layer."""
    out: Found = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    for run in _LONG_RUN.finditer(text):
        a, b = run.span()
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text, a, b) if m.end() - m.start() >= 20]
        out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text, a, b) if m.end() - m.start() >= 24]
    return out


class Same:
    """``n`` times one place."""

    def __init__(self, value: int, n: int) -> None:
        self.value, self.n = value, n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, at: int | slice) -> int | array:
        return array("q", [self.value]) * len(range(*at.indices(self.n))) if isinstance(at, slice) else self.value


class Layer:
    """Decoded text; character i came from ``begin[i]:end[i]`` of the original, ``new[i]`` if it was decoded by this layer."""

    def __init__(self, chain: str, text: str, begin: array | Same, end: array | Same, new: bytearray | None) -> None:
        self.chain, self.text, self.begin, self.end, self.new = chain, text, begin, end, new

    def place(self, a: int, b: int) -> tuple[int, int]:
        return self.begin[a], max(self.end[a:b])

    def fresh(self, a: int, b: int) -> bool:
        return self.new is None or any(self.new[a:b])


def _lines_with(layer: Layer, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    """(start, end) of the lines that hold a fresh match; a line is left at its first one, so each is walked once."""
    at = 0
    while m := pattern.search(layer.text, at):
        at = m.end()
        if layer.fresh(*m.span()):
            stop = layer.text.find("\n", m.end())
            at = len(layer.text) if stop < 0 else stop
            yield layer.text.rfind("\n", 0, m.start()) + 1, at


def _escapes(layer: Layer, name: str, pattern: re.Pattern, decode) -> Iterator[Layer]:
    """One layer per line that holds escapes: the line with all of them decoded."""
    for line, stop in _lines_with(layer, pattern):
        parts, begin, end, new, at = [], array("q"), array("q"), bytearray(), line
        for m in pattern.finditer(layer.text, line, stop):
            parts.append(layer.text[at : m.start()])
            begin += layer.begin[at : m.start()]
            end += layer.end[at : m.start()]
            new += bytes(m.start() - at)
            for char, a, b in decode(m[0]):
                parts.append(char)
                begin.append(layer.begin[m.start() + a])
                end.append(layer.end[m.start() + b - 1])
                new.append(1)
            at = m.end()
        parts.append(layer.text[at:stop])
        begin += layer.begin[at:stop]
        end += layer.end[at:stop]
        new += bytes(stop - at)
        yield Layer(f"{layer.chain}{name}/", "".join(parts), begin, end, new)


def _percent(run: str) -> Iterator[tuple[str, int, int]]:
    at = 0
    for char in bytes.fromhex(run.replace("%", "")).decode("utf-8", "surrogateescape"):
        n = len(char.encode("utf-8", "surrogateescape"))
        yield (char if char.isprintable() or char.isspace() else "�"), at, at + 3 * n
        at += 3 * n


def _unicode(run: str) -> Iterator[tuple[str, int, int]]:
    if run[0] == "&":
        n = int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1])
        yield (chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else "�"), 0, len(run)
        return
    step = 6 if run[1] == "u" else 4
    units = [int(run[i + 2 : i + step], 16) for i in range(0, len(run), step)]
    i = 0
    while i < len(units):
        n, used = units[i], 1
        if 0xD800 <= n < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
            n, used = 0x10000 + ((n - 0xD800) << 10) + (units[i + 1] - 0xDC00), 2
        yield (chr(n) if not 0xD800 <= n < 0xE000 else "�"), i * step, (i + used) * step
        i += used


_GZIP, _ZLIB = (lambda: zlib.decompressobj(31)), zlib.decompressobj
_FORMATS = (("gzip", re.compile(rb"\x1f\x8b\x08"), _GZIP), ("bzip2", re.compile(rb"BZh[1-9](?:1AY&SY|\x17rE8P\x90)"), bz2.BZ2Decompressor),
            ("xz", re.compile(rb"\xfd7zXZ\x00"), lzma.LZMADecompressor), ("zlib", re.compile(rb"x[\x01\x5e\x9c\xda]"), _ZLIB))


def _inflated(chunks: Iterator[bytes], make, whole: list[bool]) -> Iterator[bytes]:
    """The content of all members of a compressed stream, up to its end (then ``whole`` gets a True) or to damage."""
    engine, begins = make(), False
    for chunk in chunks:
        while True:
            chunk = chunk.lstrip(b"\0") if begins else chunk
            if begins and not chunk:
                break
            begins = False
            try:
                out = engine.decompress(chunk, STEP)
            except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
                return
            if out:
                yield out
            if engine.eof:
                chunk, engine, begins = engine.unused_data, make(), True
                continue
            chunk = getattr(engine, "unconsumed_tail", b"")
            if not chunk and len(out) < STEP and getattr(engine, "needs_input", True):
                break
    if begins:
        whole.append(True)


def _opened(chunks: Iterator[bytes], whole: list[bool]) -> tuple[str, Iterator[bytes]]:
    """(formats, content): all compressed formats at the start of the stream undone, one in another; ``whole`` gets a True when the outer one ends undamaged."""
    names = ""
    while True:
        head = b""
        for chunk in chunks:
            head += chunk
            if len(head) >= 10:
                break
        chunks = itertools.chain([head], chunks)
        found = next(((name, make) for name, magic, make in _FORMATS if magic.match(head)), None)
        if found is None or (found[0] == "zlib" and next(_inflated(iter([head]), zlib.decompressobj, []), None) is None and len(head) >= 64):
            return names, chunks
        names, chunks = f"{names}{found[0]}/", _inflated(chunks, found[1], [] if names else whole)


def _segments(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    """(segment, whether others came before) of at most about one and a half MAX_LAYER_BYTES."""
    held, kept = bytearray(), 0
    for chunk in chunks:
        held += chunk
        if len(held) - kept > MAX_LAYER_BYTES:
            yield bytes(held), kept > 0
            kept = max(OVERLAP, _STRETCH.match(held[: -(MAX_LAYER_BYTES // 2) - 1 : -1]).end())
            del held[:-kept]
            kept = len(held)
    if len(held) > kept:
        yield bytes(held), kept > 0


def _texts(data: bytes) -> Iterator[tuple[str, int, Callable[[str], int]]]:
    """(text, its first byte, bytes of a character) of each reading of decoded bytes that can hold a secret."""
    if _PRINTABLE.search(data):
        yield data.decode("utf-8", "surrogateescape"), 0, lambda char: len(char.encode("utf-8", "surrogateescape"))
    for little, odd in sorted({(m[1] is not None, m.start() % 2) for m in _WIDE.finditer(data)}):
        yield data[odd : len(data) - (len(data) - odd) % 2].decode("utf-16-le" if little else "utf-16-be", "surrogatepass"), odd, lambda char: 4 if ord(char) > 0xFFFF else 2


def _decoded(body: str) -> bytes:
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _encoded(layer: Layer, oversized: Found) -> Iterator[Layer]:
    """The layers of base64 stretches that hold readable text or compressed bytes."""
    for m in _BASE64.finditer(layer.text):
        a, b = m.span()
        if not layer.fresh(a, b):
            continue
        body, spots, unpacked = m[0].translate(_ONE_RUN), None, False
        for p in (x.start() for x in _PACKED.finditer(layer.text, a, b)):
            spots, ended = spots or array("q", (x.start() for x in _SYMBOL.finditer(layer.text, a, b))), []
            names, content = _opened((_decoded(body[i : i + STEP]) for i in range(bisect_left(spots, p), len(body), STEP)), ended)
            if not names:
                continue
            chain = f"{layer.chain}base64/{names}"
            for segment, later in _segments(content):
                whole = layer.place(p, b)
                if later:
                    oversized.append((f"{chain}oversized", *whole))
                for text, _, _ in _texts(segment):
                    yield Layer(chain, text, Same(whole[0], len(text)), Same(whole[1], len(text)), None)
            unpacked = unpacked or bool(ended) and p == a
            if unpacked:
                break
        for shift in () if unpacked else range(4):
            for text, at, width in _texts(_decoded(body[shift:])):
                spots = spots or array("q", (x.start() for x in _SYMBOL.finditer(layer.text, a, b)))
                begin, end = array("q"), array("q")
                for char in text:
                    n = width(char)
                    begin.append(layer.begin[spots[shift + at * 8 // 6]])
                    end.append(layer.end[spots[min(len(spots) - 1, shift + ((at + n) * 8 - 1) // 6)]])
                    at += n
                yield Layer(f"{layer.chain}base64/", text, begin, end, None)


def scan(text: str | None) -> tuple[Found, Found]:
    """(base spans, spans found in layers), each sorted by start, then kind."""
    if not text:
        return [], []
    base, extra = find(text), []
    could = ("%" in text and _PERCENT.search(text)) or (("\\" in text or "&#" in text) and _UNICODE.search(text)) or _BASE64.search(text)
    if could:
        ordinals = array("q", range(len(text) + 1))
        work, met = [Layer("", text, ordinals[:-1], ordinals[1:], None)], set()
        while work:
            layer = work.pop()
            for new in (*_escapes(layer, "url", _PERCENT, _percent), *_escapes(layer, "unicode", _UNICODE, _unicode), *_encoded(layer, extra)):
                key = (new.text, new.begin[0] if new.begin else 0, new.end[-1] if new.end else 0)
                if new.text and key not in met:
                    met.add(key)
                    extra += [(new.chain + kind, *new.place(a, b)) for kind, a, b in find(new.text) if new.fresh(a, b)]
                    work.append(new)
    return sorted(base, key=lambda x: (x[1], BASE_KINDS.index(x[0]))), sorted(set(extra), key=lambda x: (x[1], x[0], x[2]))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added): arrays of struct<kind, start, end> of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [scan(t) for t in batch["text"]]
            rows = {"doc_id": batch["doc_id"].astype("Int64")}
            for k, name in enumerate(("base", "added")):
                rows[name] = [[{"kind": s[0], "start": s[1], "end": s[2]} for s in f[k]] for f in found]
            yield pd.DataFrame(rows)

    span = "array<struct<kind: string, start: bigint, end: bigint>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, f"doc_id bigint, base {span}, added {span}")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's rows: counts per base kind, checksum of the base spans, all spans."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    rank = lambda s: F.array_position(F.array(*map(F.lit, BASE_KINDS)), s["kind"])
    every = F.concat(F.transform("base", lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))),
                     F.transform("added", lambda s: F.struct(s["start"].alias("start"), F.lit(len(BASE_KINDS) + 1).cast("long").alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return scanned.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.sort_array(every)).alias("spans"))

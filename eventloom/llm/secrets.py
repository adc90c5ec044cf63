"""Find secrets in texts, also inside nested encodings: a worklist of decoded layers.

The raw text is the first layer. Every layer is scanned, then each decoder rewrites all its
regions (URL escapes, Unicode escapes, base64 on one line or wrapped) and the result joins the
worklist unless the same text was seen before. What a region decodes to stays bytes while it is zlib
or gzip data, however often it was compressed; then it is read as UTF-8, bad bytes replaced. The
list runs dry at the fixpoint. Every layer carries, for each of its characters, the span of the
original text it came from, so a find in any layer is reported where it stands in the original.

Compressed data is unfolded as a stream. Content longer than ``PART`` characters is scanned in parts
that overlap by ``OVERLAP``, each a layer of its own that is decoded further like any other.

Texts without a hint of a secret or of an encoding cost a few substring searches. Rows are
independent: no shuffle, memory is one Arrow batch plus the layers of one text.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches

# The kinds in their stated order, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{24}")
LEAST = {"assign": 6, "access": 20, "hex": 24}

HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Shortest run of word characters that base64 or a long hex run can hide in.
LONG_WORD = 16
WRAPPED = re.compile(
    r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}\r?\n(?:[ \t]*[A-Za-z0-9+/_-]{16,}\r?\n)*[ \t]*[A-Za-z0-9+/_-]{1,}={0,2}"
)
BREAKS = re.compile(r"[/+_-]+")
LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
#: Bytes of unfolded content that are scanned as one layer, and that two neighbouring parts share.
PART, OVERLAP = 1 << 22, 1 << 16
CHUNK = 1 << 16
#: Content with more undecodable characters than one in so many is no text.
BAD_SHARE = 8


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping per kind."""
    found = [
        (m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]
    ]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if HEX_LONG.search(text):
        found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return found


class Parts:
    """Content too long for one layer: overlapping parts, unfolded as they are asked for."""

    def __init__(self, chunks: Iterator[bytes], held: bytes):
        self.chunks, self.held = chunks, held

    def __iter__(self) -> Iterator[str]:
        held = self.held
        for chunk in self.chunks:
            held += chunk
            if len(held) >= PART:
                yield held.decode("utf-8", "replace")
                held = held[-OVERLAP:]
        yield held.decode("utf-8", "replace")


def _marked(raw: bytes) -> bool:
    """Whether bytes begin with the mark of gzip or zlib."""
    return raw[:2] == b"\x1f\x8b" or raw[:1] == b"\x78" and len(raw) > 1 and (raw[0] * 256 + raw[1]) % 31 == 0


def _compressed(raw: bytes, whole: bool = True) -> bool:
    """Whether bytes are zlib or gzip data: they start and decode like it, up to its end if they
    are ``whole``. Text may start like it, which does not suffice."""
    if not _marked(raw):
        return False
    out = zlib.decompressobj(wbits=47)
    try:
        got = bool(out.decompress(raw, CHUNK))
        while not out.eof and out.unconsumed_tail:
            out.decompress(out.unconsumed_tail, CHUNK)
    except zlib.error:
        return False
    return out.eof or got and not whole


def _inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Content of one zlib or gzip stream; it ends where the data ends or breaks."""
    out = zlib.decompressobj(wbits=47)
    try:
        for chunk in chunks:
            while chunk:
                content = out.decompress(chunk, CHUNK)
                if content:
                    yield content
                if out.eof:
                    return
                chunk = out.unconsumed_tail
    except zlib.error:
        return


def _unfolded(raw: bytes) -> Iterator[bytes] | None:
    """What lies under all layers of compression, as a stream; None if there is none."""
    chunks: Iterator[bytes] = iter(())
    first, whole, depth = raw, True, 0
    while _compressed(first, whole):
        chunks, first, depth = _inflate(chain([first], chunks)), b"", depth + 1
        for chunk in chunks:
            first += chunk
            if len(first) >= CHUNK:
                break
        whole = len(first) < CHUNK
    return chain([first], chunks) if depth else None


def _content(raw: bytes) -> str | Parts | None:
    """The text that bytes hold, or None for what is no text."""
    if not raw:
        return None
    chunks = _unfolded(raw)
    if chunks is None:
        text = raw.decode("utf-8", "replace")
        return text if text.count("\ufffd") * BAD_SHARE <= len(text) else None
    held = b""
    for chunk in chunks:
        held += chunk
        if len(held) >= PART:
            return Parts(chunks, held)
    return held.decode("utf-8", "replace") or None


# What a region decodes to: text and, for each character, begin and end of its source in the region.
Decoded = tuple[str, np.ndarray, np.ndarray]


def _steps(text: str, at) -> Decoded:
    """``at`` holds each character's place in the region, and the region's size."""
    at = np.asarray(at, dtype=np.int64)
    return text, at[:-1], np.maximum(at[1:], at[:-1] + 1)


def _whole(text: str, size: int) -> Decoded:
    """Content that is known to come from the region as a whole only."""
    return text, np.zeros(len(text), np.int64), np.full(len(text), size)


def _between(run: str, start: int, end: int, inner: Decoded) -> Decoded:
    """Content of a stretch of the region, the characters around it as they are."""
    text, begin, stop = inner
    own = np.arange(len(run), dtype=np.int64)
    return (
        run[:start] + text + run[end:], np.concatenate([own[:start], begin + start, own[end:]]),
        np.concatenate([own[:start] + 1, np.minimum(stop + start, end), own[end:] + 1]),
    )


def _url(run: str) -> Decoded | Parts:
    raw = bytes.fromhex(run.replace("%", ""))
    if _compressed(raw) and (content := _content(raw)) is not None:
        return content if isinstance(content, Parts) else _whole(content, len(run))
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
        return _steps(text, [3 * i for i in range(len(raw) + 1)])
    return _steps(text, np.cumsum([0, *(3 * len(c.encode("utf-8")) for c in text)]))


def _unicode(run: str) -> Decoded:
    units = [int(run[i + 2 : i + 6], 16) for i in range(0, len(run), 6)]
    chars, at, k = [], [0], 0
    while k < len(units):
        pair = 0xD800 <= units[k] < 0xDC00 and k + 1 < len(units) and 0xDC00 <= units[k + 1] < 0xE000
        if pair:
            chars.append(chr(0x10000 + ((units[k] - 0xD800) << 10) + units[k + 1] - 0xDC00))
        else:
            chars.append(chr(units[k]) if not 0xD800 <= units[k] < 0xE000 else "\ufffd")
        k += 2 if pair else 1
        at.append(6 * k)
    return _steps("".join(chars), at)


def _base64_bytes(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return None


def _promising(head: str) -> bool:
    """Whether the first bytes of a run look like text or compressed data, so that long binary
    content is not decoded once more for every mark in it."""
    raw = _base64_bytes(head[: len(head) // 4 * 4]) or b""
    return _marked(raw) or raw.decode("utf-8", "replace").count("\ufffd") <= 2


def _base64(run: str) -> Decoded | Parts | None:
    """A run, or what of it follows a path or a joining mark, such as the payload after `data/`."""
    for start in (0, *(m.end() for m in BREAKS.finditer(run))):
        size = len(run) - start
        if size < LONG_WORD:
            return None
        if start and not _promising(run[start : start + 32]):
            continue
        raw = _base64_bytes(run[start:])
        content = None if raw is None else _content(raw)
        if isinstance(content, Parts):
            return content
        if content is None:
            continue
        if _compressed(raw) or "\ufffd" in content:
            inner = _whole(content, size)
        else:
            at = np.cumsum([0, *(len(c.encode("utf-8")) for c in content)]) * 4 // 3
            at[-1] = size
            inner = _steps(content, at)
        return _between(run, start, len(run), inner) if start else inner
    return None


def _block(run: str) -> list[re.Match]:
    """The lines of wrapped base64: all of one width, then one that may be shorter."""
    lines = list(LINE.finditer(run))
    width = len(lines[1 if len(lines) > 2 else 0][0])
    for k, line in enumerate(lines):
        if k and len(line[0]) != width:
            lines = lines[: k + (len(line[0]) < width)]
            break
    # A short word in lower case begins the text that follows.
    last = lines[-1][0]
    return lines[:-1] if len(last) < LONG_WORD and last.isalpha() and last.islower() else lines


def _wrapped(run: str) -> Decoded | Parts | None:
    """Base64 over several lines."""
    lines = _block(run)
    if len(lines) < 2:
        return None
    raw = _base64_bytes("".join(line[0] for line in lines))
    content = None if raw is None else _content(raw)
    if content is None or isinstance(content, Parts):
        return content
    end = lines[-1].end()
    return _between(run, 0, end, _whole(content, end))


DECODERS = (("%", URL, _url), ("\\u", UNICODE, _unicode), ("\n", WRAPPED, _wrapped), ("", BASE64, _base64))


class Layer:
    """A decoded text; starts[i] and ends[i] bound what its character i came from."""

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray):
        self.text, self.starts, self.ends = text, starts, ends

    def digest(self) -> bytes:
        return hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest()

    def span(self, start: int, end: int) -> tuple[int, int]:
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def decoded(self, mark: str, pattern: re.Pattern, decode) -> tuple[Layer | None, list[Iterator[Layer]]]:
        """This layer with every region of one encoding replaced by its content, and the layers of
        regions whose content is too long to stand in its place."""
        apart: list[Iterator[Layer]] = []
        if mark not in self.text:
            return None, apart
        texts, starts, ends, done = [], [], [], 0
        for m in pattern.finditer(self.text):
            got = decode(m[0])
            if got is None:
                continue
            if isinstance(got, Parts):
                apart.append(_apart(got, *self.span(m.start(), m.end())))
                continue
            content, begin, end = got
            texts += [self.text[done : m.start()], content]
            starts += [self.starts[done : m.start()], self.starts[m.start() + begin]]
            ends += [self.ends[done : m.start()], self.ends[m.start() + end - 1]]
            done = m.end()
        if not done:
            return None, apart
        texts.append(self.text[done:])
        starts.append(self.starts[done:])
        ends.append(self.ends[done:])
        return Layer("".join(texts), np.concatenate(starts), np.concatenate(ends)), apart


def _apart(parts: Parts, start: int, end: int) -> Iterator[Layer]:
    for text in parts:
        size = len(text)
        yield Layer(text, np.full(size, start), np.full(size, end))


def all_spans(text: str) -> tuple[set[tuple[int, str, int]], int]:
    """Spans over all layers, and the number of layers scanned."""
    at = np.arange(len(text), dtype=np.int64)
    first = Layer(text, at, at + 1)
    found: set[tuple[int, str, int]] = set()
    work: list[Iterator[Layer]] = [iter([first])]
    seen = {first.digest()}
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        for start, kind, end in base_spans(layer.text):
            a, b = (start, end) if layer is first else layer.span(start, end)
            found.add((a, kind, b))
        for decoder in DECODERS:
            after, apart = layer.decoded(*decoder)
            work += apart
            if after is not None and (key := after.digest()) not in seen:
                seen.add(key)
                work.append(iter([after]))
    return found, len(seen)


def _has_encoding(raw: bytes, longest: int) -> bool:
    return b"%" in raw or b"\\u" in raw or longest >= LONG_WORD


def scan_text(raw: bytes) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]], int]:
    """Base spans, all spans, number of layers; both in order of start, then kind."""
    lower = raw.lower()
    longest = max(map(len, raw.split()), default=0)
    hinted = b"AKIA" in raw or longest >= LEAST["hex"] or any(h in lower for h in HINTS)
    encoded = _has_encoding(raw, longest)
    if not hinted and not encoded:
        return [], [], 1
    text = raw.decode("utf-8")
    order = lambda s: (s[0], KINDS.index(s[1]), s[2])
    base = sorted(base_spans(text), key=order) if hinted else []
    if not encoded or not any(
        mark in text and any(d(m[0]) is not None for m in p.finditer(text)) for mark, p, d in DECODERS
    ):
        return base, base, 1
    spans, layers = all_spans(text)
    return base, sorted(spans | set(base), key=order), layers


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


SCANNED = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
    "n_layers long, n_spans long"
)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base counts and digest, all spans, layers scanned.

    A null text counts as empty and has no spans; the digest of no spans is that of the empty
    string. Repeated rows give repeated results, a null id stays null, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            rows = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                base, spans, layers = scan_text(raw.as_py() or b"")
                digest = hashlib.sha256(joined(base).encode()).hexdigest() if base else none
                counts = [sum(k == kind for _, k, _ in base) for kind in KINDS] if base else [0, 0, 0]
                rows.append((doc_id, *counts, digest, joined(spans), layers, len(spans)))
            columns = list(zip(*rows)) or [[] for _ in range(8)]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            names = [c.split()[0] for c in SCANNED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        give_back()

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(run, SCANNED)


def redacted(raw: bytes, mark: str) -> str:
    """The text with every span, overlapping ones joined, replaced by ``mark``."""
    text, spans = raw.decode("utf-8"), scan_text(raw)[1]
    out, done = [], 0
    for start, _, end in spans:
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join([*out, text[done:]]) if spans else text


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns, secrets in ``text_col`` replaced; a null text stays null."""

    @F.pandas_udf("string")
    def clean(texts):
        clear = texts.map(lambda t: None if t is None else redacted(t.encode("utf-8"), mark))
        give_back()
        return clear

    small_batches(docs.sparkSession)
    return docs.withColumn(text_col, clean(F.col(text_col)))

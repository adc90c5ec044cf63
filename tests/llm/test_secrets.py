"""Secret scan: base spans against a plain scan, planted secrets under layers of encoding."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import time
import urllib.parse
import zlib

import pytest

from eventloom.llm import secrets
from eventloom.llm.queries import op4_secret_scan
from eventloom.llm.secrets import redact, scan, scan_text

SECRET = "password=hunter2hunter2"


def plain(text):
    """The contract, word for word."""
    kinds = {
        "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "access": "AKIA[A-Z0-9]+",
        "hex": "[0-9a-f]+",
    }
    out = []
    for i, (kind, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text):
            value, least = (m[2], 6) if kind == "assign" else (m[0], 20 if kind == "access" else 24)
            if len(value) >= least:
                out.append((m.start(), i, kind, m.end()))
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def test_base_equals_plain_scan(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = 0
    for r in op4_secret_scan(spark, sf).collect():
        want = plain(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [
            sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")
        ]
        assert set(want) <= set(r.spans.split(","))
        found += len(want)
    assert found


def url(s):
    return "".join(f"%{b:02X}" for b in s.encode())


def b64(s):
    return base64.b64encode(s if isinstance(s, bytes) else s.encode()).decode()


def wrap(raw, width=76):
    whole = b64(raw)
    return "\r\n".join(whole[k : k + width] for k in range(0, len(whole), width))


def uni(s):
    return "".join(f"\\u{ord(c):04x}" for c in s)


@pytest.mark.parametrize(
    "hide",
    [
        url, b64, uni,
        lambda s: b64(gzip.compress(s.encode())),
        lambda s: b64(zlib.compress(s.encode())),
        lambda s: url(b64(uni(s))),
        lambda s: b64(zlib.compress(b64(url(s)).encode())),
        lambda s: urllib.parse.quote(b64(b64(s))),
        lambda s: b64("no-break\u00a0space \u3000 \ufeff \x0c " + s),
        lambda s: b64(b"bad \xff byte, " + s.encode()),
        lambda s: b64(gzip.compress(zlib.compress(s.encode()))),
        lambda s: b64(gzip.compress(gzip.compress(zlib.compress(s.encode())))),
        lambda s: "".join(f"%{x:02x}" for x in gzip.compress(s.encode())),
        lambda s: "data/" + b64(s),
        lambda s: "x/data/" + b64(gzip.compress(s.encode())),
        lambda s: wrap(gzip.compress((s + " ".join(map(str, range(400)))).encode())),
        lambda s: wrap(("filler " * 40 + s + " filler" * 9).encode(), 64),
        lambda s: b64(gzip.compress(b"\x00\x01\xfe\xff" * 50 + s.encode())),
    ],
)
def test_secret_under_layers_maps_to_its_span(hide):
    before, after = "Ünïcode text before ", " and after."
    hidden = hide(SECRET)
    base, spans, layers = scan_text((before + hidden + after).encode())
    inside = [s for s in spans if s[1] == "assign" and s[0] >= len(before) and s[2] <= len(before + hidden)]
    assert inside and layers > 1


def test_partly_escaped_value_is_mapped_exactly():
    text = "é token=abc%64ef x"
    assert scan_text(text.encode())[0] == []
    assert scan_text(text.encode())[1] == [(2, "assign", 16)]


def test_long_content_is_scanned_in_parts(monkeypatch):
    monkeypatch.setattr(secrets, "PART", 4096)
    monkeypatch.setattr(secrets, "OVERLAP", 512)
    filler = "plain words, " * 4000
    hidden = b64(gzip.compress((filler + SECRET + " " + filler + url(b64(SECRET.replace("hunter", "fisher"))) + filler).encode()))
    text = f"é before {hidden} after"
    assert scan_text(text.encode())[1] == [(9, "assign", 9 + len(hidden))]
    for at in range(4000, 4200, 7):
        cut = b64(gzip.compress(("x " * (at // 2) + SECRET + " y" * 4000).encode()))
        assert scan_text(f"é before {cut} after".encode())[1] == [(9, "assign", 9 + len(cut))]


def test_redaction_reaches_compressed_and_wrapped_layers(spark):
    hidden = [b64(gzip.compress(gzip.compress(SECRET.encode()))), wrap(("filler " * 40 + SECRET).encode()), "data/" + b64(SECRET)]
    docs = spark.createDataFrame([(i, f"kept before {h}\nkept after") for i, h in enumerate(hidden)], "doc_id long, text string")
    for r in redact(docs).collect():
        assert r.text.startswith("kept before ") and r.text.endswith("\nkept after") and "[SECRET]" in r.text
        assert hidden[r.doc_id] not in r.text


def test_fixpoint_ends():
    for text in ("%25" * 50, b64(b64(b64("plain words here and there"))), "%2525252525"):
        assert scan_text(text.encode())[2] < 60


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, 5), (2, "", 5), (None, SECRET, 5), (3, SECRET, 5), (3, SECRET, 5), (4, "token: 12345", 5)],
        "doc_id long, text string, spans long",
    )
    rows = sorted(scan(docs).collect(), key=lambda r: (r.doc_id or 0, r.spans))
    assert [(r.doc_id, r.spans) for r in rows] == [
        (None, "assign:0:23"), (1, ""), (2, ""), (3, "assign:0:23"), (3, "assign:0:23"), (4, ""),
    ]
    clean = {(r.doc_id, r.text) for r in redact(docs).collect()}
    assert clean == {(1, None), (2, ""), (None, "[SECRET]"), (3, "[SECRET]"), (4, "token: 12345")}
    assert scan(docs.limit(0)).count() == 0


def test_long_binary_content_takes_no_square_time():
    noise = b64(random.Random(4).randbytes(2_000_000))
    text = f"x {noise} y {b64(SECRET)}"
    started = time.monotonic()
    assert [s[1] for s in scan_text(text.encode())[1]] == ["assign"]
    assert time.monotonic() - started < 60


def test_very_long_text():
    text = "word " * 200_000 + SECRET
    base, spans, _ = scan_text(text.encode())
    assert base == spans == [(1_000_000, "assign", 1_000_000 + len(SECRET))]

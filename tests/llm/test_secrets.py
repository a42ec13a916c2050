"""Secrets in texts against plain patterns over strings, and secrets under random nestings of encodings."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import zlib

import pytest
import zstandard

from shelfwise.llm import queries, secret_scan
from tests.llm import ugly

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def plain(text):
    """Base spans spelt out on code points."""
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


SECRET = "AKIA" + "QWERTYUIOP234567"
HARD = [
    (30, "é Password = 'hunter2hunter2' token:abc secret=abc%20defgh ſecret=abcdefgh toKen=abcdefgh"), (31, "x" + SECRET + "AKIA" + "short AKIA"),
    (32, "api_key:api_key=0123456789abcdef0123456789abcdef"), (33, "passwd=\"" + "ab12" * 3 + "\" " + "0123456789abcdef" * 2 + "G"),
    (34, "token token=" + "a" * 6 + " token=é"), (35, "SECRETSECRET:  value=x"), (36, "😀" * 5 + "deadbeef" * 3), (37, "%" * 40), (38, "\\u" * 40), (39, "&#&#x;" * 9),
    (40, "😀password%3Dhunter22😀"), (41, "%2525252541KIAQWERTYUIOP234567"), (42, "\\u0041KIAQWERTYUIOP234567 &#65;KIAQWERTYUIOP234567"),
]


def test_base_spans_and_query_columns(spark, tmp_path):
    rows = ugly.TEXTS + HARD
    ugly.documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_secrets(spark, str(tmp_path)).collect()
    want = sorted((str(k), hashlib.sha256(",".join(plain(t)).encode()).hexdigest()) for k, t in rows)
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in got) == want
    for r in got:
        texts = [t for k, t in rows if k == r["doc_id"]]
        spans = r["spans"].split(",") if r["spans"] else []
        assert any(set(plain(t)) <= set(spans) and len(spans) == len(plain(t)) + r["n_added"] for t in texts)
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)
        assert r["n_assign"] + r["n_access"] + r["n_hex"] == len(spans) - r["n_added"] and r["unopened"] == 0
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[40]["spans"] == "assign:1:20" and by_id[41]["spans"] == "access:0:30"
    assert by_id[42]["spans"] == "access:0:25,access:26:50"
    assert secret_scan.find_secrets(ugly.nothing(spark)).count() == 0


def test_base_spans_of_given_texts(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
    got = secret_scan.find_secrets(documents).collect()
    assert {r["doc_id"]: [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["base"]] for r in got} == {k: plain(t) for k, t in texts.items()}


def url(body, draw):
    return b"".join(b"%%%02X" % c if chr(c) in "%=" or draw.random() < 0.4 else bytes((c,)) for c in body)


def unicode(body, draw):
    text = body.decode()
    forms = [lambda c: f"\\u{ord(c):04x}", lambda c: f"\\x{ord(c):02x}", lambda c: f"&#{ord(c)};", lambda c: f"&#x{ord(c):X};", lambda c: f"\\U{ord(c):08X}"]
    return "".join(draw.choice(forms)(c) if c in "\\&=" or draw.random() < 0.4 else c for c in text).encode()


def packer(pack):
    return lambda body, draw: base64.b64encode(pack(body))


ENCODINGS = [url, unicode, packer(bytes), lambda b, d: base64.urlsafe_b64encode(b).rstrip(b"="), packer(gzip.compress), packer(zlib.compress), packer(bz2.compress),
             packer(lzma.compress), packer(zstandard.ZstdCompressor().compress), lambda b, d: b"\n".join(base64.b64encode(b)[i:i + 64] for i in range(0, len(base64.b64encode(b)), 64))]


@pytest.mark.parametrize("seed", range(40))
def test_secrets_under_nested_encodings(seed):
    draw = random.Random(seed)
    body = SECRET.encode()
    for _ in range(draw.randint(1, 4)):
        body = draw.choice(ENCODINGS)(body, draw)
    before, after = "vorher é ".encode(), b" nachher"
    base, added, layers, unopened = secret_scan.scan(before + body + after)
    if before + body + after == before + SECRET.encode() + after:
        assert ("access", len(before), len(before) + len(body)) in base
        return
    inside = [s for s in added if s[0] == "access"]
    assert inside and layers and not unopened
    for _, start, end in inside:
        assert len(before) <= start < end <= len(before) + len(body)
        assert SECRET.encode() in secret_under(b" " + (before + body + after)[start:end] + b" ") or end - start < len(body)


def secret_under(body):
    """Everything that unwrapping finds in a piece of text, joined."""
    waiting, out = [secret_scan.Layer(body)], b""
    while waiting:
        layer = waiting.pop()
        out += b"\n" + layer.body
        waiting += secret_scan.children(layer, 1 << 20)[0]
    return out


def test_spans_lie_on_the_characters_that_hold_the_secret():
    token = base64.b64encode(b"some words before " + SECRET.encode() + b" and after")
    (kind, start, end), = secret_scan.scan(b"x " + token)[1]
    bits = (start - 2) * 6, (end - 2) * 6
    at = len(b"some words before ") * 8
    assert kind == "access" and bits[0] <= at < bits[0] + 6 and bits[1] - 6 < at + len(SECRET) * 8 <= bits[1]


def test_guards_and_cycles():
    bomb = base64.b64encode(gzip.compress(gzip.compress(b"\0" * (40 << 20)) * 1))
    assert secret_scan.scan(b"x " + bomb)[3] == 1
    nested = b"password=hunter22"
    for _ in range(300):
        nested = base64.b64encode(zlib.compress(nested))
    base, added, layers, unopened = secret_scan.scan(nested)
    assert added and layers >= 600 and not unopened  # a stream may hold a stored token as it is
    assert secret_scan.scan(nested, most_layers=10)[3] > 0
    again = b"%41KIAQWERTYUIOP234567 " * 3
    assert [s[1:] for s in secret_scan.scan(again)[1]] == [(0, 22), (23, 45), (46, 68)]


def test_a_stream_that_unpacks_to_itself_ends(monkeypatch):
    monkeypatch.setattr(secret_scan, "unpack", lambda body, kind, most: (body, False))
    assert secret_scan.scan(b"x " + base64.b64encode(gzip.compress(b"loop")))[2] == 1

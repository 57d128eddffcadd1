"""Every form of encoding, nested at any depth, and bounded memory of long texts."""

import base64
import bz2
import gzip
import quopri
import tracemalloc
import zlib

import pytest

from kgcube.llm import op10_secrets

SECRET = "password = hunter22x"


def b64(data):
    return base64.b64encode(data).decode()


def deflate(data):
    d = zlib.compressobj(9, zlib.DEFLATED, -15)
    return d.compress(data) + d.flush()


FORMS = {
    "gzip in gzip after a header": b64(gzip.compress(b"hdr " + gzip.compress(SECRET.encode()))),
    "bzip2 in gzip in zlib": b64(zlib.compress(b"a " + gzip.compress(b"b " + bz2.compress(SECRET.encode()) + b" c"))),
    "raw deflate": b64(deflate(SECRET.encode() * 3)),
    "gzip in raw deflate": b64(deflate(b"head " + gzip.compress(SECRET.encode()))),
    "%u": "".join(f"%u{ord(c):04X}" for c in SECRET),
    "long U": "".join(f"\\U{ord(c):08x}" for c in SECRET),
    "braces": "".join(f"\\u{{{ord(c):x}}}" for c in SECRET),
    "octal": "".join(f"\\{ord(c):03o}" for c in SECRET),
    "decimal references": "".join(f"&#{ord(c)};" for c in SECRET),
    "hexadecimal references": "".join(f"&#x{ord(c):X};" for c in SECRET),
    "names": "&quot;password&quot;&colon; &quot;hunter22x&quot;",
    "quoted-printable": "".join(f"={ord(c):02X}" for c in SECRET),
    "soft line ends": quopri.encodestring(("pass=word " + "x" * 60 + " " + SECRET).encode()).decode().replace("password", "pass=\nword"),
    "form data": "q=1&password+=+hunter22x",
    "references in base64 in escapes": "".join(f"\\x{ord(c):02x}" for c in b64("".join(f"&#{ord(c)};" for c in SECRET).encode())),
}


@pytest.mark.parametrize("form", FORMS)
def test_forms(form):
    base, found = op10_secrets.spans(f"see {FORMS[form]} there")
    assert not base and found and all(4 <= s < e <= 4 + len(FORMS[form]) for s, e, _ in found)
    assert "hunter22" not in op10_secrets.redacted(f"see {FORMS[form]} there")


@pytest.mark.parametrize("pack, depth", [(gzip.compress, 130), (lambda x: gzip.compress(b"pad " + x), 40), (lambda x: b64(x).encode(), 12)])
def test_any_depth(pack, depth):
    data = SECRET.encode()
    for _ in range(depth):
        data = pack(data)
    text = data.decode() if data.isascii() else b64(data)
    assert op10_secrets.spans(f"see {text} there")[1]


@pytest.mark.parametrize("inner", [(b"plain words " * 500_000) + SECRET.encode() + b" end", gzip.compress(SECRET.encode()), gzip.compress(b"plain words " * 500_000 + SECRET.encode())])
def test_all_of_raw_deflate_is_searched(inner):
    text = b64(deflate(inner))
    assert (4, 4 + len(text), 0) in op10_secrets.spans(f"see {text} there")[1]


def test_a_layer_that_holds_itself_ends():
    assert op10_secrets.spans("%25" * 2000 + " " + "&amp;" * 2000)[1] == []


def test_spans_are_exact():
    text = "é%70assword%3D%22hunter22x%22 end"
    assert op10_secrets.spans(text)[1] == [(1, 26, 0)] and op10_secrets.redacted(text) == "é[SECRET]%22 end"


def test_a_long_text_with_many_escapes_needs_little_memory():
    text = "plain words and %41 more of them \\u0041 = &#65; so on " * 90_000 + "password%3Dhunter22x"
    assert len(text) > 4 << 20
    tracemalloc.start()
    found = op10_secrets.spans(text)[1]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(len(text) - 20, len(text), 0)]
    assert most < 90 << 20  # and in proportion

"""Secret scan: Aho-Corasick keyword prefilter, anchored expressions at hits, then checksum or structure validation.

One automaton runs over the ASCII-folded text.  Its words are the literal starts of each kind and, for plain hexadecimal
runs, all 65,536 four-digit words: every run of 16 digits begins with one.  An expression is tried only at a hit, anchored
there.  Expressions of a kind begin only at its keywords, so hits in order, skipping what a match of that kind covers, give
the leftmost non-overlapping matches.

Beside the base kinds the scan finds tokens that carry their own proof: prefixed tokens whose last six characters are the
base-62 CRC-32 of the thirty before (github, npm), JSON web tokens whose header decodes to an object with "alg" (jwt), and
private-key header lines (pem).  Null texts count as empty; offsets are code points.  Texts are scanned whole whatever their
length, repeated rows one by one; spans that begin together are told in the order of the kinds.  An empty table gives an empty
result; columns beside doc_id and text aren't read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import re
import zlib
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm", "jwt", "pem")
# Expressions and least lengths of the base kinds.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
# Publicly documented token formats.
GITHUB = re.compile(r"gh[oprsu]_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("gho_", "ghp_", "ghr_", "ghs_", "ghu_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "pem": ("-----begin ",),
}
#: Longer headers prove nothing.
MOST_HEADER = 1 << 16
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum62(body: str) -> str:
    x, out = zlib.crc32(body.encode()), ""
    while x:
        x, k = divmod(x, 62)
        out = BASE62[k] + out
    return out.rjust(6, "0")


def _has_checksum(token: str) -> bool:
    return checksum62(token[:30]) == token[30:]


def _has_header(token: str) -> bool:
    head = token.split(".", 1)[0]
    if len(head) > MOST_HEADER:
        return False
    try:
        found = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, RecursionError):  # nested too deeply for a header
        return False
    return isinstance(found, dict) and "alg" in found


#: Expression and validation of the match.
TESTS = {
    "assign": (ASSIGN, lambda m: len(m[1]) >= LEAST["assign"]),
    "access": (ACCESS, lambda m: len(m[0]) >= LEAST["access"]),
    "hex": (HEX, lambda m: len(m[0]) >= LEAST["hex"]),
    "github": (GITHUB, lambda m: _has_checksum(m[1])),
    "npm": (NPM, lambda m: _has_checksum(m[1])),
    "jwt": (JWT, lambda m: _has_header(m[0])),
    "pem": (PEM, lambda m: True),
}


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            found.add_word(w, (kind, len(w)))
    for digits in itertools.product("0123456789abcdef", repeat=4):
        found.add_word("".join(digits), ("hex", 4))
    found.make_automaton()
    return found


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span, by start and then kind as listed in KINDS."""
    if not text:
        return []
    folded = text.lower() if text.isascii() else text.encode().lower().decode()
    free, out = dict.fromkeys(KINDS, 0), []
    for last, (kind, n) in _automaton().iter(folded):
        start = last - n + 1
        if start < free[kind]:
            continue
        expression, valid = TESTS[kind]
        if m := expression.match(text, start):
            free[kind] = m.end()
            if valid(m):
                out.append((start, m.end(), kind))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_proven of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [scan(t) for t in batch.column(1).to_pylist()]
            base = [[x for x in spans if x[2] in BASE] for spans in found]
            counts = [pa.array([sum(x[2] == k for x in spans) for spans in base], pa.int64()) for k in BASE]
            digests = [hashlib.sha256(_told(spans).encode()).hexdigest() for spans in base]
            proven = pa.array([len(a) - len(b) for a, b in zip(found, base, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digests, pa.string()), pa.array([_told(x) for x in found], pa.string()), proven],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_proven"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_proven bigint"
    )

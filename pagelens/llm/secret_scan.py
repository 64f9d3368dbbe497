"""Secret scanning with structural confirmation.

Three base patterns are reported as they stand. Beyond them, base64 and hex runs are decoded
and reported only if their structure confirms a secret: DER key encodings, encrypted ones too,
whose nested lengths fill the input exactly, OpenSSH key blobs, PEM private keys whose body
decodes to one of these (or is enciphered as its headers say), and signed tokens whose header is
JSON that names an algorithm. Base64 may be wrapped, with line breaks as such or written as \\n;
there the length at the head of the key tells where it ends. Every pass is linear in the text but
for the decoding of candidates, each of which is bounded by its own key.

Defined results: a null text is empty and has no spans (the digest is that of the empty string);
offsets are code points, end exclusive; repeated rows get equal results; overlapping spans of
different kinds are all reported, but for the base64 of a key inside its PEM marks.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import common

#: Fixed patterns of the base kinds. "Either case" means ASCII letters only.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Cheap signs that a text can hold an assign match at all.
HINTS = ("passw", "secret", "token", "api")
#: The dot after a token's header, by what follows it; the header is the run before.
JWT = re.compile(r"\.(?=([A-Za-z0-9_-]*+\.[A-Za-z0-9_-]{8,}+))")
URLSAFE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"
MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----")
#: Whole runs of both alphabets, and in each of them those of either one, as a run of one may touch the other's characters.
RUN64 = re.compile(r"[A-Za-z0-9+/_-]{40,}+={0,2}")
BASE64 = [re.compile(rf"[{x}]{{40,}}+={{0,2}}") for x in ("A-Za-z0-9+/_-", "A-Za-z0-9+/", "A-Za-z0-9_-")]
KEYHEAD = re.compile(r"M[A-I]|b3BlbnNza")
BREAK = r"(?:\r?\n|(?:\\+r)?\\+n)"
#: Lines of base64 that follow each other, the first of them long.
WRAPPED = re.compile(rf"[A-Za-z0-9+/]{{40,}}+(?:{BREAK}[ \t]*[A-Za-z0-9+/]++)+={{0,2}}")
LINE = re.compile(rf"(?:{BREAK}[ \t]*)?([A-Za-z0-9+/]+)")
SCANNER, OBJECT = json.JSONDecoder(), re.compile(r'\{\s*"')
#: More than any private key has, in bytes.
LARGEST = 1 << 16
#: Identifiers of password-based encryption (PKCS 5 and PKCS 12), as DER holds them.
PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
ENCIPHERED = re.compile(r"\s*Proc-Type:\s*4,ENCRYPTED\s+DEK-Info:\s*[A-Z0-9-]+,([0-9A-Fa-f]{16,64})\s+")
HEXKEY = re.compile(r"[0-9A-Fa-f]{48,}")
SSH = b"openssh-key-v1\0"
KINDS = ("assign", "access", "hex", "jwt", "pem", "key64", "keyhex")


def tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the value of the DER element at this place, or None if it does not fit."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= end else None


def der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    items = []
    while at < end:
        if (x := tlv(data, at, end)) is None:
            return None
        items.append(x)
        at = x[2]
    return items


def der_key(data: bytes) -> str | None:
    """rsa, ec, pkcs8 or encrypted, if the bytes are just one such private key with consistent nested lengths."""
    outer = tlv(data, 0, len(data))
    if outer is None or outer[0] != 0x30 or outer[2] != len(data):
        return None
    items = der_items(data, outer[1], outer[2])
    if not items:
        return None
    tags, version = [x[0] for x in items], data[items[0][1] : items[0][2]]
    if tags == [0x30, 0x04]:  # how it is enciphered, and the ciphertext
        algorithm = der_items(data, *items[0][1:])
        named = algorithm and algorithm[0][0] == 0x06 and data[algorithm[0][1] : algorithm[0][2]].startswith(PASSWORD_BASED)
        return "encrypted" if named and items[1][2] - items[1][1] >= 16 else None
    if tags[0] != 0x02:
        return None
    if tags[:9] == [0x02] * 9 and version in (b"\0", b"\1"):
        return "rsa"
    if version == b"\1" and tags[1:2] == [0x04] and items[1][2] - items[1][1] >= 16:
        return "ec"
    if version in (b"\0", b"\1") and tags[1:3] == [0x30, 0x04]:
        algorithm = der_items(data, *items[1][1:])
        if algorithm and algorithm[0][0] == 0x06:
            return "pkcs8"
    return None


def ssh_size(data: bytes) -> int | None:
    """Bytes of the OpenSSH key that the data begin with, by its nested lengths, or None."""
    at = len(SSH)
    if not data.startswith(SSH):
        return None
    keys = 0
    for i in range(5):  # cipher, derivation, its options, (number of keys, then) a public key, the private part
        if i == 3:
            keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if at + 4 > len(data) or (i >= 3 and keys != 1):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at if at <= len(data) else None


def ssh_key(data: bytes) -> str | None:
    at = len(SSH)
    if not data.startswith(SSH):
        return None
    for _ in range(3):  # cipher, derivation and its options, each with its length before it
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return "openssh" if at + 4 <= len(data) and int.from_bytes(data[at : at + 4], "big") >= 1 else None


def unbase64(text: str) -> bytes | None:
    """The bytes in either alphabet, without white space; line breaks may be written as \\n and \\r."""
    bare = re.sub(r"\s+|\\+[nr]", "", text).rstrip("=")
    if len(bare) % 4 == 1:
        return None
    try:
        return base64.b64decode(bare.replace("-", "+").replace("_", "/") + "=" * (-len(bare) % 4), validate=True)
    except binascii.Error:
        return None


def key_structure(data: bytes | None) -> str | None:
    return (der_key(data) or ssh_key(data)) if data else None


def token_header(text: str) -> bool:
    """Whether the parts are base64 and the first is a JSON object that names an algorithm."""
    head, body, sign = text.split(".")[:3]
    raw = unbase64(head)
    if raw is None or unbase64(body) is None or unbase64(sign) is None:
        return False
    try:
        found = json.loads(raw)
    except (ValueError, RecursionError):
        return False
    return isinstance(found, dict) and isinstance(found.get("alg"), str)


def openings(head: str) -> Iterator[int]:
    """Places after the start where the rest of the run decodes to one JSON object and nothing else, by the four ways to align it."""
    data: dict[int, tuple[int, str]] = {}
    for x in re.finditer("e[wy]", head):
        k = x.start()
        if k % 4 not in data:
            raw = unbase64(head[k:])
            data[k % 4] = (k, raw.decode("latin-1").rstrip(" \t\r\n") if raw is not None else "")
        first, plain = data[k % 4]
        at = (k - first) // 4 * 3
        if plain.endswith("}") and OBJECT.match(plain, at):
            try:
                if SCANNER.raw_decode(plain, at)[1] == len(plain):
                    yield k
            except (ValueError, RecursionError):
                continue


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of signed tokens. A header may follow characters of its own alphabet; it then has to begin as an object does."""
    done = 0
    for m in JWT.finditer(text):
        part = text[text.rfind(".", 0, m.start()) + 1 : m.start()]
        head = part[len(part.rstrip(URLSAFE)) :]
        for k in chain([0], (k for k in openings(head) if k)):
            start = m.start() - len(head) + k
            if start >= done and token_header(f"{head[k:]}.{m[1]}"):
                done = m.end(1)
                yield start, done
                break


def enciphered(body: str) -> bool:
    """Whether headers name a cipher and what follows them is whole blocks of it."""
    bare = re.sub(BREAK, "\n", body)
    m = ENCIPHERED.match(bare)
    data = unbase64(bare[m.end() :]) if m else None
    return bool(data) and len(m[1]) % 16 == 0 and len(data) % (len(m[1]) // 2) == 0


def pem_spans(text: str) -> Iterator[tuple[int, int]]:
    """Marks in order: only an END right after a BEGIN of the same name can close a key."""
    opened = None
    for m in MARK.finditer(text):
        if m[1] == "BEGIN":
            opened = m
        elif opened is not None:
            body = text[opened.end() : m.start()]
            if opened[2] == m[2] and (key_structure(unbase64(body)) or enciphered(body)):
                yield opened.start(), m.end()
            opened = None


def wrapped_spans(text: str) -> Iterator[tuple[int, int]]:
    """Keys in base64 over several lines, each from the start of a line to where its own length ends it."""
    for block in WRAPPED.finditer(text):
        lines = [m.span(1) for m in LINE.finditer(text, *block.span())]
        bare = "".join([text[a:b] for a, b in lines])
        places = [0, *accumulate(b - a for a, b in lines)]  # where the lines begin in bare
        done = 0
        for i, (start, end) in enumerate(lines):
            if places[i] < done or not KEYHEAD.match(text, start, end) or not (size := declared(bare[places[i] : places[i] + 2 * LARGEST])):
                continue
            stop = places[i] + -(-size * 4 // 3)
            last = bisect_left(places, stop) - 1
            if i < last < len(lines) and key_structure(unbase64(bare[places[i] : stop])):
                at = lines[last][0] + stop - places[last]
                yield start, at + min(2, len(text[at : at + 2]) - len(text[at : at + 2].lstrip("=")))
                done = stop


def declared(bare: str) -> int | None:
    """Bytes of the key whose base64 this begins with, as its head or its nested lengths say."""
    head = unbase64(bare[:16]) or b""
    if head[:1] == b"\x30" and len(head) > 6:
        n = head[1] & 0x7F if head[1] >= 0x80 else 0
        size = int.from_bytes(head[2 : 2 + n], "big") if n else head[1]
        return 2 + n + size if n <= 4 and size <= LARGEST else None
    return ssh_size(unbase64(bare[: len(bare) - (len(bare) % 4 == 1)]) or b"")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    folded = text.lower()
    if any(h in folded for h in HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    out += [("jwt", a, b) for a, b in tokens(text)]
    if "PRIVATE KEY-----" in text:
        out += [("pem", a, b) for a, b in pem_spans(text)]
    # Cheap: a DER key begins with a sequence (0x30, base64 M and A to I by its length), an OpenSSH blob with "openssh".
    if KEYHEAD.search(text):
        found = {m.span() for run in RUN64.finditer(text) for p in BASE64 for m in p.finditer(text, *run.span()) if KEYHEAD.match(m[0]) and key_structure(unbase64(m[0]))}
        whole, pems = set(wrapped_spans(text)), [x[1:] for x in out if x[0] == "pem"]  # in order, apart
        starts, begins = {a for a, _ in whole}, [a for a, _ in pems]
        found = {x for x in found if x[0] not in starts} | whole  # not the first line of a longer key
        out += [("key64", a, b) for a, b in found if not ((i := bisect_right(begins, a)) and b <= pems[i - 1][1])]
    if "30" in text or "6f70656e737368" in text:
        for m in HEXKEY.finditer(text):
            if len(m[0]) % 2 == 0 and key_structure(bytes.fromhex(m[0])):
                out.append(("keyhex", m.start(), m.end()))
    return out


def spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans, each by start, then kind."""
    text = text or ""
    by = lambda s: (s[1], KINDS.index(s[0]))
    base = base_spans(text)
    return sorted(base, key=by), sorted(base + confirmed_spans(text), key=by)


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def redact(text: str, found: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every maximal run of overlapping spans replaced by the mark."""
    out, done = [], 0
    for _, a, b in sorted(found, key=lambda s: s[1]):
        if a >= done:
            out += [text[done:a], mark]
        done = max(done, b)
    return "".join(out) + text[done:]


SCANNED = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string"


def scan(docs: DataFrame, redacted: bool = False) -> DataFrame:
    """Adds a struct `secrets` of SCANNED to docs; redacted texts only where asked for and where there are spans."""
    fields = SCANNED if redacted else SCANNED.rsplit(",", 1)[0]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for t in texts.to_pylist():
                base, every = spans(t)
                row = {f"n_{k}": sum(s[0] == k for s in base) for k in KINDS[:3]} | {"base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "spans": joined(every)}
                rows.append(row | ({"redacted": redact(t, every) if every else None} if redacted else {}))
            kinds = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), *([("redacted", pa.string())] * redacted)]
            yield pa.array(rows, pa.struct(kinds))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn("secrets", F.arrow_udf(run, fields)(F.col("text")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "secrets.*")

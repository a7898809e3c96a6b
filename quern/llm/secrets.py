"""Secret scans with structural confirmation.

Three base patterns find assignments, access key ids and long hex runs. Beyond
them, a base64 or hex run is reported only if what it decodes to has the
structure of a key: DER private keys whose nested lengths add up, OpenSSH
private keys, or a signed token's header and payload.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "pem", "der", "openssh", "jwt")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, as shorter ones are dropped
# Candidates are of 30 bytes or more: no key that is in use is shorter.
LEAST = 30
_HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){30,}(?![0-9A-Fa-f])")
#: What keys begin with in base64: a sequence of a short or long length that holds a version of 0 or 1, or OpenSSH's magic.
_HEAD = re.compile(r"M[A-H][AEIMQUYcgkosw048]CAQ[AE]|MI[E-H][\w+/-]AgE[AB]|MI[I-L][\w+/-][\w+/-][AQgw]IB|MI[M-P][\w+/-]{4}|b3BlbnNzaC1rZXktdjEA", re.A)
#: Both alphabets of base64, in lines that may be indented and may end in line ends as JSON and .env files write them.
_RUN = re.compile(r"[A-Za-z0-9+/_-]+(?:(?:\r?\n|\\+r\\+n|\\+n)[ \t]*+[A-Za-z0-9+/_-]+)*")
_PIECE = re.compile(r"(?:\r?\n|\\+r\\+n|\\+n)[ \t]*+")
#: What may stand before a key: nothing that could be a part of it, the end of a path's step, or a line end as such files write it.
_BEFORE = re.compile(r"(?:^|[^A-Za-z0-9]|\\[rn])\Z")
_ESCAPE = re.compile(r"(?<!\\)\\++[rn]")  # a line end as JSON and .env files write it
_DEK = re.compile(r"DEK-Info:\s*([A-Z0-9-]+),([0-9A-Fa-f]+)")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,64}?PRIVATE KEY)-----")


def base_spans(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns; matches that are too short are dropped after matching."""
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            yield m.start(), m.end(), "assign"
    for m in _ACCESS.finditer(text):
        if m.end() - m.start() >= 20:
            yield m.start(), m.end(), "access"
    for m in _HEX.finditer(text):
        yield m.start(), m.end(), "hex"


def _unit(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of the DER unit at ``at``; None if its length isn't minimal or leaves ``end``."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 0x80:
        wide = n & 0x7F
        if not 1 <= wide <= 4 or at + wide > end:
            return None
        n, at = int.from_bytes(data[at : at + wide], "big"), at + wide
        if n < 0x80 or n >> 8 * (wide - 1) == 0:
            return None
    return (tag, at, at + n) if at + n <= end else None


def _units(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The units that fill at..end exactly; none if they are more than a key has."""
    found = []
    while at < end:
        if len(found) == 10 or (unit := _unit(data, at, end)) is None:
            return None
        found.append(unit)
        at = unit[2]
    return found


def is_der_key(data: bytes) -> bool:
    return _der_end(data, 0) == len(data)


def _der_end(data: bytes, start: int) -> int | None:
    """Where the private key in DER at ``start`` ends: PKCS#1 (nine integers with the version or more), DSA (six), SEC1 or PKCS#8, each length nested rightly."""
    outer = _unit(data, start, len(data))
    if outer is None or outer[0] != 0x30 or not _is_key(data, outer):
        return None
    return outer[2]


def _is_key(data: bytes, outer: tuple[int, int, int]) -> bool:
    parts = _units(data, outer[1], outer[2])
    if not parts or parts[0][0] != 0x02 or parts[0][2] - parts[0][1] != 1 or data[parts[0][1]] > 1:
        return False
    tags = [p[0] for p in parts]
    if len(tags) >= 9 and set(tags[:9]) == {0x02}:
        return True
    if tags == [0x02] * 6:  # version, p, q, g, y, x
        return data[parts[0][1]] == 0
    if tags[1:2] == [0x04] and 16 <= parts[1][2] - parts[1][1] <= 72:
        return all(t in (0xA0, 0xA1) for t in tags[2:])
    if tags[1:3] == [0x30, 0x04]:
        algorithm = _units(data, parts[1][1], parts[1][2])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return False


def is_encrypted_key(data: bytes) -> bool:
    """An EncryptedPrivateKeyInfo in DER: an algorithm that begins with an object identifier, and an octet string, nothing more."""
    outer = _unit(data, 0, len(data))
    if outer is None or outer[0] != 0x30 or outer[2] != len(data):
        return False
    parts = _units(data, outer[1], outer[2])
    if not parts or [p[0] for p in parts] != [0x30, 0x04] or parts[1][1] == parts[1][2]:
        return False
    algorithm = _units(data, parts[0][1], parts[0][2])
    return bool(algorithm) and algorithm[0][0] == 0x06


def _openssh_end(data: bytes, start: int = 0) -> int | None:
    """Where the OpenSSH private key at ``start`` ends: the magic, cipher, kdf and options, a count, that many public keys and the private part."""
    if not data.startswith(b"openssh-key-v1\0", start):
        return None
    at, strings, count = start + 15, 3, None
    while strings:
        if at + 4 > len(data):
            return None
        at, strings = at + 4 + int.from_bytes(data[at : at + 4], "big"), strings - 1
        if not strings and count is None:
            if at + 4 > len(data):
                return None
            count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
            if not 0 < count <= 64:
                return None
            strings = count + 1
    return at if at <= len(data) else None


def is_openssh_key(data: bytes) -> bool:
    return _openssh_end(data) == len(data)


def _plain(run: str) -> bytes | None:
    run = run.replace("\r", "").replace("\n", "").rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except binascii.Error:
        return None


def is_signed_token(run: str) -> bool:
    """header.payload.signature, with a JSON header that names an algorithm and a JSON payload."""
    parts = run.split(".")
    if len(parts) != 3:
        return False
    try:
        header, payload = (json.loads(_plain(p) or b"") for p in parts[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(payload, dict) and (bool(parts[2]) or header["alg"].lower() == "none")


def _pem_body(inner: str) -> str:
    """What is between the marks, without headers and white space; ``inner`` has its escaped line ends as such."""
    body = "".join(x for x in inner.split("\n") if ":" not in x)
    if not body.strip():  # all on one line: a header's name and its value are words
        words = inner.split()
        body = "".join(w for before, w in zip(["", *words], words) if ":" not in w and not before.endswith(":"))
    return "".join(body.split())


def _is_pem_key(label: str, inner: str) -> bool:
    inner = _ESCAPE.sub("\n", inner)
    data = _plain(_pem_body(inner))
    if not data:
        return False
    if label.startswith("ENCRYPTED"):
        return is_encrypted_key(data)
    if "ENCRYPTED" in inner:  # the old form: a cipher and its start, then whole blocks
        dek = _DEK.search(inner)
        return dek is not None and len(data) % (16 if dek[1].startswith("AES") else 8) == 0
    return is_der_key(data) or is_openssh_key(data)


def _pem_spans(text: str) -> Iterator[tuple[int, int, str]]:
    """Blocks from the last BEGIN before an END of its label, each mark looked at once."""
    begun: dict[str, re.Match] = {}
    for m in _MARK.finditer(text):
        if m[1] == "BEGIN":
            begun[m[2]] = m
        elif m[2] in begun:
            start = begun[m[2]]
            begun.clear()
            if _is_pem_key(m[2], text[start.end() : m.start()]):
                yield start.start(), m.end(), "pem"


class _Run:
    """Lines of base64 from a place in a text on, put together once; what they decode to from each of four places is made when first asked for."""

    def __init__(self, text: str, start: int):
        self.text, self.end = text, _RUN.match(text, start).end()
        self.begins, self.places, parts, at, size = [], [], [], start, 0
        for end, after in [*((m.start(), m.end()) for m in _PIECE.finditer(text, start, self.end)), (self.end, self.end)]:
            self.begins.append(size)
            self.places.append(at)
            parts.append(text[at:end])
            size, at = size + end - at, after
        self.clean, self._decoded = "".join(parts), {}

    def index(self, place: int) -> int:
        k = bisect_right(self.places, place) - 1
        return self.begins[k] + place - self.places[k]

    def place(self, index: int) -> int:
        k = bisect_right(self.begins, index) - 1
        return self.places[k] + index - self.begins[k]

    def decoded(self, phase: int) -> bytes:
        if phase not in self._decoded:
            part = self.clean[phase:].replace("-", "+").replace("_", "/")
            part = part[: len(part) - (len(part) % 4 == 1)]
            self._decoded[phase] = base64.b64decode(part + "=" * (-len(part) % 4))
        return self._decoded[phase]


def _key_at(run: _Run, place: int) -> tuple[int, str] | None:
    """Where the key that begins at a place of a run ends, and its kind. What it decodes to says how long it is."""
    i = run.index(place)
    phase = i % 4
    data, at = run.decoded(phase), (i - phase) // 4 * 3
    kind = "der" if data[at : at + 1] == b"0" else "openssh"
    end = _der_end(data, at) if kind == "der" else _openssh_end(data, at)
    if end is None or end - at < LEAST:
        return None
    last = i + -(-4 * (end - at) // 3)
    whole = run.clean[i:last]
    if len(whole) < last - i or ("-" in whole or "_" in whole) and ("+" in whole or "/" in whole):
        return None
    stop = run.place(last - 1) + 1
    if run.text[stop : stop + 1].isalnum():  # a key ends where its line does
        return None
    while stop < len(run.text) and run.text[stop] == "=" and (last - i) % 4:
        stop, last = stop + 1, last + 1
    return stop, kind


def _key_spans(text: str) -> Iterator[tuple[int, int, str]]:
    """Keys in base64, wherever they begin in a run of lines of it. A run is decoded four times at most, and a beginning costs a look at ten lengths."""
    run, at = None, 0
    while m := _HEAD.search(text, at):
        at = m.start() + 1
        if not _BEFORE.search(text[max(0, m.start() - 2) : m.start()]):
            continue
        if run is None or m.start() >= run.end:
            run = _Run(text, m.start())
        if found := _key_at(run, m.start()):
            at = found[0]
            yield m.start(), *found


def confirmed_spans(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of candidates whose decoded content has the structure of a secret.

    The time is in proportion to the text: runs of base64 don't overlap, and each
    is decoded a fixed number of times.
    """
    if "eyJ" in text:
        for m in _JWT.finditer(text):
            if is_signed_token(m[0]):
                yield m.start(), m.end(), "jwt"
    if "-----BEGIN " in text:
        yield from _pem_spans(text)
    yield from _key_spans(text)
    for m in _HEX_ANY.finditer(text):
        data = bytes.fromhex(m[0])
        kind = "der" if is_der_key(data) else "openssh" if is_openssh_key(data) else None
        if kind:
            yield m.start(), m.end(), kind


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, base and spans, arrays of (start, end, kind) in code points, end exclusive.

    A null text is empty and has no spans. A text is scanned whole in one task,
    in time and memory in proportion to its length; ids may be null or repeated,
    an empty table gives no rows, and other columns are left out, whatever their
    names.
    """
    kept = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spans = "array<struct<start:int,end:int,kind:string>>"
    schema = kept.select("doc_id", F.lit(None).cast(spans).alias("base"), F.lit(None).cast(spans).alias("more")).schema
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    named = lambda found: [{"start": s, "end": e, "kind": k} for s, e, k in found]

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            base = pa.array([named(base_spans(t)) for t in texts], kind)
            more = pa.array([named(confirmed_spans(t)) for t in texts], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), base, more], ["doc_id", "base", "more"])

    return kept.mapInArrow(run, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: counts by base kind, the base spans' digest and all spans as text."""
    order = F.array(*map(F.lit, KINDS))
    placed = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("s"), F.array_position(order, s["kind"]).alias("k"), s["end"].alias("e"))))
    text = lambda spans: F.array_join(F.transform(placed(spans), lambda s: F.concat_ws(":", F.element_at(order, s["k"].cast("int")), s["s"], s["e"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned(docs, id_col, text_col).select("doc_id", *map(count, KINDS[:3]), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.concat("base", "more")).alias("spans"))


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every document's secrets: counts and digest of the base spans, and all spans."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))

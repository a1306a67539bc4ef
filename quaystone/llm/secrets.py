"""Secret scans: an Aho-Corasick keyword pass, anchored expressions at its hits, embedded checksums.

Kinds, in their order: ``assign``, ``access``, ``hex`` (the base), then ``forge`` (code-forge and
package tokens whose last six characters are the base-62 CRC-32 of the rest), ``card`` (payment card
numbers after a keyword, Luhn) and ``iban`` (account numbers after a keyword, modulo 97).
The base kinds have no embedded checksum, so every match of theirs stays.

Null and empty texts have no spans; repeated rows are scanned alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import string
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import map_batches, table, text_bytes

KINDS = ("assign", "access", "hex", "forge", "card", "iban")
# Keywords and the expressions that are tried where a keyword begins.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
FORGE_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
CARD_WORDS = ("card", "visa", "mastercard", "amex")
IBAN_WORDS = ("iban",)
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"(?<![0-9a-f])[0-9a-f]{24,}")
FORGE = re.compile(rb"(gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
CARD = re.compile(rb"[^0-9]{0,12}?([0-9](?:[ -]?[0-9]){12,18})(?![0-9])")
IBAN = re.compile(rb"[^A-Z0-9]{0,12}([A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})(?![A-Za-z0-9])")
BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase

SPAN = "struct<kind:string,start:int,end:int>"
SCHEMA = f"doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, found array<{SPAN}>"


def base62_crc(body: bytes) -> bytes:
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.encode()


def luhn(digits: bytes) -> bool:
    d = [c - 48 for c in digits if 48 <= c <= 57]
    total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
    return len(set(d)) > 1 and total % 10 == 0


def mod97(account: bytes) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(chr(c), 36)) for c in moved)) % 97 == 1


def automaton():
    """The keyword machine; each word carries its length and the kind it leads to."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", ("akia",)), ("forge", FORGE_WORDS), ("card", CARD_WORDS), ("iban", IBAN_WORDS)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def scan(raw: bytes, machine) -> list[tuple[int, int, str]]:
    """(start, end, kind) of one text in bytes, by start and then kind as listed."""
    found, last = [], dict.fromkeys(KINDS, 0)
    low = raw.lower().decode("latin-1")
    hits = [(end - n + 1, kind, n) for end, (kind, n) in machine.iter(low)]
    if len(hits) > 1:
        hits.sort()
    for at, kind, n in hits:
        if at < last[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(raw, at):
                last[kind] = m.end()
                if len(m[2]) >= 6:
                    found.append((at, m.end(), kind))
        elif kind == "access":
            if m := ACCESS.match(raw, at):
                last[kind] = m.end()
                if m.end() - at >= 20:
                    found.append((at, m.end(), kind))
        elif kind == "forge":
            if (m := FORGE.match(raw, at)) and base62_crc(m[2]) == m[3]:
                last[kind] = m.end()
                found.append((at, m.end(), kind))
        elif kind == "card":
            if (m := CARD.match(raw, at + n)) and luhn(m[1]) and m.start(1) >= last[kind]:
                last[kind] = m.end(1)
                found.append((m.start(1), m.end(1), kind))
        elif (m := IBAN.match(raw, at + n)) and mod97(m[1]) and m.start(1) >= last[kind]:
            last[kind] = m.end(1)
            found.append((m.start(1), m.end(1), kind))
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(raw)]
    if len(found) > 1:
        found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return found


def code_points(raw: bytes, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Byte offsets to code points."""
    if not found or raw.isascii():
        return found
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=at[1:])
    return [(int(at[s]), int(at[e]), k) for s, e, k in found]


def listed(found: Iterable[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = automaton()
    for batch in batches:
        data, offs = text_bytes(batch.column("text"))
        whole, rows = data.tobytes(), []
        for i in range(batch.num_rows):
            raw = whole[offs[i] : offs[i + 1]]
            rows.append(code_points(raw, scan(raw, machine)))
        base = [[x for x in r if x[2] in KINDS[:3]] for r in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64())]
            + [pa.array([sum(x[2] == k for x in r) for r in base], pa.int64()) for k in KINDS[:3]]
            + [
                pa.array([hashlib.sha256(listed(r).encode()).hexdigest() for r in base]),
                pa.array([listed(r) for r in rows]),
                pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in r] for r in rows], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))),
            ],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"],
        )


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document with the counts, the digest of the base spans and all spans.

    ``found`` holds the spans as structs (code points, end exclusive). No shuffle: one map over the scan.
    """
    return map_batches(docs.select("doc_id", "text"), _run, SCHEMA)


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = automaton()
    for batch in batches:
        col = batch.column("text")
        data, offs = text_bytes(col)
        whole, out = data.tobytes(), []
        for i, known in enumerate(col.is_valid().to_pylist()):
            raw = whole[offs[i] : offs[i + 1]]
            found = scan(raw, machine) if known else []
            if found:
                parts, at = [], 0
                for s, e, k in found:
                    if s >= at:
                        parts += [raw[at:s], f"[{k.upper()}]".encode()]
                    at = max(at, e)
                raw = b"".join([*parts, raw[at:]])
            out.append(raw.decode("utf-8", "replace") if known else None)
        k = batch.schema.get_field_index("text")
        yield batch.set_column(k, batch.schema.field(k).with_type(pa.string()), pa.array(out, pa.string()))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """Every span replaced by the name of its kind in brackets, of overlapping ones the first.

    All columns stay; ``n_chars`` follows the text; null texts stay null.
    """
    out = docs.mapInArrow(_redact, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents")).drop("found")

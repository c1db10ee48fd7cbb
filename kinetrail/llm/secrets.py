"""Secret scans: fixed patterns, and random strings found by their token efficiency.

A string that a byte-pair vocabulary has not seen needs many tokens for its characters. Runs of 16 or more characters of [A-Za-z0-9+/_=-] are
split at their separators and the parts encoded with a tiktoken vocabulary; few characters per token mark a random part, and 16 or more characters of such parts
a random string, whatever names or prefixes stand before them. Known digests (hexadecimal of 32, 40, 56, 64, 96 or 128 digits), UUIDs, numbers, dates
and the names of mail addresses are identifiers, not secrets, and go first.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinetrail.llm import kernels as K

ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})$")
UUID = re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![A-Za-z0-9])")
PART = re.compile(r"[A-Za-z0-9]+")
#: A name, perhaps numbered; shorter ones than NAME letters are too short to tell from random ones.
PLAIN = re.compile(r"[A-Za-z]+[0-9]{0,4}$")
NAME = 6
#: Characters of a random string at least, and those encoded at once.
LEAST, SLICE = 16, 1024
_RUN_BYTES = np.zeros(256, bool)
_RUN_BYTES[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_HEX_BYTES = np.zeros(256, bool)
_HEX_BYTES[[ord(c) for c in "0123456789abcdef"]] = True
_WORDS = np.array([int.from_bytes(w, "little") for w in (b"pass", b"secr", b"toke", b"apik", b"api_", b"akia")], np.uint32)
#: Vocabulary that the box provides; the path is a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict = {}


def encoder(path: str):
    """The vocabulary at path, loaded once in each process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("secrets", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, by start, then kind."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def random_parts(run: str, encode, most: float) -> list[tuple[int, int]]:
    """(start, end) of a run's parts with few characters per token."""
    out = []
    for m in PART.finditer(UUID.sub(lambda u: "-" * len(u.group()), run)):
        s = m.group()
        if s.isdigit() or DIGEST.match(s) or (len(s) < NAME and PLAIN.match(s)):
            continue
        if len(s) <= most * sum(len(encode(s[i : i + SLICE])) for i in range(0, len(s), SLICE)):
            out.append(m.span())
    return out


def random_spans(text: str, base: list[tuple[int, int, int]], encode, most: float) -> list[tuple[int, int, int]]:
    """A run counts if its random parts have LEAST characters; beside a base span only its random parts of that size do."""
    out = []
    for m in RUN.finditer(text):
        a, b = m.span()
        if text[b : b + 1] == "@" and text[max(0, a - 1) : a] != ":":
            continue
        parts = [(a + x, a + y) for x, y in random_parts(m.group(), encode, most)]
        if sum(y - x for x, y in parts) < LEAST:
            continue
        if not any(x < b and a < y for x, y, _ in base):
            out.append((a, b, 3))
        else:
            out += [(x, y, 3) for x, y in parts if y - x >= LEAST and not any(p < y and x < q for p, q, _ in base)]
    return out


def suspects(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Texts in which some pattern may match: all others have no span. Byte tests over the whole batch."""
    n, out = len(data), np.zeros(len(offs) - 1, bool)
    if n < 4:
        return out
    low = K.LOWER[data]
    key = np.zeros(n - 3, np.uint32)
    for j in range(4):
        key |= low[j : n - 3 + j].astype(np.uint32) << np.uint32(8 * j)
    hits = np.zeros(n - 3, bool)
    for w in _WORDS:
        hits |= key == w
    at = [np.flatnonzero(hits)]
    for table, least in ((_HEX_BYTES, 24), (_RUN_BYTES, 16)):
        starts, ends, _ = K.word_bounds(data, offs, table)
        long = ends - starts >= least
        at.append(starts[long])
    out[np.searchsorted(offs, np.concatenate(at), "right") - 1] = True
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


class SecretScan:
    """scan(): a row per document with its spans (array of kind, start, end, base), code points, end exclusive.

    Fixed patterns give base spans; random strings that overlap none are added. Spans are by start, then by kind. Null counts as empty and has no span;
    repeated rows each get their row; extra columns are ignored; an empty table gives an empty result. most: characters per token up to
    which a string is random. vocabulary: path of a tiktoken rank file that every executor can open.
    """

    def __init__(self, most: float = 2.0, vocabulary: str = VOCABULARY):
        self.most, self.vocabulary = most, vocabulary

    def scan(self, docs: DataFrame) -> DataFrame:
        most, vocabulary = self.most, self.vocabulary

        def run(batches):
            encode = encoder(vocabulary).encode_ordinary
            for b in batches:
                column = b.column("text")
                data, offs = K.buffers(column)
                found: list[list] = [[] for _ in range(b.num_rows)]
                for lo, hi in K.groups(offs):
                    for i in np.flatnonzero(suspects(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])) + lo:
                        text = column[int(i)].as_py()
                        base = base_spans(text)
                        spans = sorted(base + random_spans(text, base, encode, most), key=lambda s: (s[0], s[2]))
                        found[i] = [{"kind": KINDS[k], "start": a, "end": z, "base": k < 3} for a, z, k in spans]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return docs.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def digest(scanned: DataFrame) -> DataFrame:
    """The columns of the query op8 from scan()'s spans."""

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])
    count = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return scanned.select("doc_id", *count, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def brute_digest(text: str | None) -> str:
    return hashlib.sha256(joined(base_spans(text or "")).encode()).hexdigest()

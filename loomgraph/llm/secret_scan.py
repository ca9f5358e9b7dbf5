"""Secret scans: an Aho-Corasick pass for keywords, anchored patterns at its hits only, then checksums.

Plain kinds (``assign``, ``access``, ``hex``) are taken as their pattern says. The other kinds carry a
checksum and count only if it holds: tokens with a base-62 CRC-32, base-58 keys with a double
SHA-256, and bech32 keys. Runs of hex digits have no keyword; a run of 32 holds two
neighbouring places of every sixteenth character, so only these are looked at first.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Public formats of secrets and the alphabets of their checksums.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
TOKEN = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
EXTENDED_KEY = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")
FILE_KEY = re.compile(r"(AGE-SECRET-KEY-)1([02-9AC-HJ-NP-Z]{58})(?![02-9A-Z])")
NOTE_KEY = re.compile(r"(nsec)1([02-9ac-hj-np-z]{58})(?![02-9a-z])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "xprv": ("xprv",),
    "age": ("age-secret-key-1",),
    "nsec": ("nsec1",),
}
KINDS = ("assign", "access", "hex", "github", "npm", "xprv", "age", "nsec")
HEX_LENGTH = 32

SPANS = "array<struct<kind: string, start: int, end: int>>"
_STRIDE = HEX_LENGTH // 2
_HEX_PAIR = re.compile(r"[0-9a-f](?=[0-9a-f])")


def crc_holds(body: str, check: str) -> bool:
    """The last six characters are the CRC-32 of the others in base 62."""
    value = 0
    for c in check:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body.encode())


def base58_holds(key: str) -> bool:
    """The last four bytes are the first four of the SHA-256 of the SHA-256 of the others."""
    value = 0
    for c in key:
        value = value * 58 + BASE58.index(c)
    raw = value.to_bytes((value.bit_length() + 7) // 8, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32_holds(prefix: str, data: str) -> bool:
    """The checksum polynomial of prefix and data leaves 1."""
    prefix, data = prefix.lower(), data.lower()
    check = 1
    for v in [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.index(c) for c in data]:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(BECH32_GENERATOR):
            if top >> i & 1:
                check ^= g
    return check == 1


def _checked(kind: str, found: re.Match) -> bool:
    if kind == "assign":
        return len(found[2]) >= 8
    if kind == "access":
        return len(found[0]) >= 16
    if kind in ("github", "npm"):
        return crc_holds(found[1], found[2])
    if kind == "xprv":
        return base58_holds(found[0])
    return bech32_holds(found[1], found[2])


_PATTERN = {"assign": ASSIGN, "access": ACCESS, "github": TOKEN, "npm": TOKEN, "xprv": EXTENDED_KEY, "age": FILE_KEY, "nsec": NOTE_KEY}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, keywords in KEYWORDS.items():
        for word in keywords:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def _hex_runs(text: str):
    done = 0
    for hit in _HEX_PAIR.finditer(text[_STRIDE - 1 :: _STRIDE]):
        at = hit.start() * _STRIDE + _STRIDE - 1
        if at < done:
            continue
        start = at
        while start > done and text[start - 1] in "0123456789abcdef":
            start -= 1
        done = HEX.match(text, at).end()
        if done - start >= HEX_LENGTH:
            yield "hex", start, done


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """``kind, start, end`` of every secret (code points, end exclusive), by start, then kind as in KINDS.
    Matches of one kind are leftmost and do not overlap; matches that fail their check still use up their place."""
    if not text:
        return []
    # ASCII letters only, so that places stay the same.
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    begins: dict[str, list[int]] = {}
    for end, (kind, size) in _automaton().iter(lowered):
        begins.setdefault(kind, []).append(end - size + 1)
    spans = list(_hex_runs(text))
    for kind, places in begins.items():
        done = 0
        for at in sorted(places):
            if at >= done and (found := _PATTERN[kind].match(text, at)):
                done = found.end()
                if _checked(kind, found):
                    spans.append((kind, at, done))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redact(text: str | None, mark: str = "<secret>") -> str | None:
    """The text with every stretch covered by a secret replaced by ``mark``."""
    spans = find_secrets(text)
    if not spans:
        return text
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _spans(texts: pd.Series) -> pd.Series:
    names = ("kind", "start", "end")
    return pd.Series([[dict(zip(names, s, strict=True)) for s in find_secrets(t)] for t in texts], dtype=object)


def _redacted(texts: pd.Series) -> pd.Series:
    return pd.Series([redact(t) for t in texts], dtype=object)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` of each row: all secrets of its whole text. Null and empty texts have none; repeated rows and
    null ids are rows like others; an empty table gives an empty result; other columns are ignored."""
    return docs.select("doc_id", F.pandas_udf(_spans, SPANS)("text").alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs``, all rows and columns, with every secret of ``text`` replaced; ``n_chars`` follows where it exists."""
    out = docs.withColumn("text", F.pandas_udf(_redacted, "string")("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))
    return out


def report(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts and digest of the plain kinds, and all spans as text."""

    def text_of(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin("assign", "access", "hex"))

    def count(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in ("assign", "access", "hex")]
    return scan(docs).select("doc_id", *counts, F.sha2(text_of(base), 256).alias("base_sha256"), text_of(spans).alias("spans"))

"""Secrets in texts: keyword prefilter, anchored patterns near hits, checksums.

One Aho-Corasick automaton reads every text twice: the lower-cased bytes for the
keywords, and a view in which each hexadecimal digit is the same character, where
a run of 24 of them is a keyword as well. Patterns are tried only at the places
the automaton names. Kinds with a checksum of their own are kept only if it holds.
"""

import hashlib
import re
import zlib
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefboard.functions.portions import joined, portions
from prefboard.llm.texts import each_as_bytes, unused_name

# Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "github", "npm", "xprv")

SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType(), False),
        T.StructField("start", T.LongType(), False),
        T.StructField("end", T.LongType(), False),
    ]
)
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

# Patterns, each anchored at a keyword. `assign` reads lower-cased bytes.
_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_NPM = re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_XPRV = re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![A-Za-z0-9])")

# Keywords of each kind, lower-cased.
_KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "xprv": ("xprv",),
}
_HEX_DIGITS = b"0123456789abcdef"
_HEX_RUN = 24
_HEX_VIEW = bytes(0x30 if b in _HEX_DIGITS else 0x2E for b in range(256))
_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def _number(digits: bytes, alphabet: bytes) -> int:
    value = 0
    for digit in digits:
        value = value * len(alphabet) + alphabet.index(digit)
    return value


def crc32_holds(body: bytes, check: bytes) -> bool:
    """The last six characters are the CRC-32 of the body in base 62."""
    return _number(check, _BASE62) == zlib.crc32(body)


def base58check_holds(text: bytes) -> bool:
    """The last four bytes are those of a doubled SHA-256 of the rest."""
    try:
        raw = _number(text, _BASE58).to_bytes(82, "big")
    except OverflowError:
        return False
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


@lru_cache(1)
def _automaton():
    machine = ahocorasick.Automaton()
    for kind, words in _KEYWORDS.items():
        for word in words:
            machine.add_word(word, (kind, len(word)))
    machine.make_automaton()
    runs = ahocorasick.Automaton()
    runs.add_word("0" * _HEX_RUN, ("hex", _HEX_RUN))
    runs.make_automaton()
    return machine, runs


def _match(kind, text, lowered, at):
    """(end, kept) of the kind's pattern anchored at `at`, or None."""
    if kind == "assign":
        m = _ASSIGN.match(lowered, at)
        return m and (m.end(), len(m[2]) >= 6)
    if kind == "access":
        m = _ACCESS.match(text, at)
        return m and (m.end(), len(m[0]) >= 20)
    if kind in ("github", "npm"):
        m = (_GITHUB if kind == "github" else _NPM).match(text, at)
        return m and (m.end(), crc32_holds(m[1], m[2]))
    m = _XPRV.match(text, at)
    return m and (m.end(), base58check_holds(m[0]))


def find_spans(text: bytes) -> list:
    """`(kind, start, end)` in code points, by start, then kind as listed.

    Matches of one kind never overlap; a match that fails its length or checksum
    still uses up its characters.
    """
    machine, runs = _automaton()
    lowered = text.lower()
    found, used = [], dict.fromkeys(KINDS, 0)
    hits = [(last - n + 1, kind) for last, (kind, n) in machine.iter(lowered.decode("latin-1"))]
    for at, kind in sorted(hits):
        if at >= used[kind] and (m := _match(kind, text, lowered, at)):
            used[kind] = m[0]
            if m[1]:
                found.append((kind, at, m[0]))
    view = text.translate(_HEX_VIEW)
    for last, (kind, n) in runs.iter(view.decode("latin-1")):
        if last >= used[kind]:  # the first 24 of a run; later hits in it are skipped
            start = last - n + 1
            end = view.find(b".", last)
            used[kind] = len(view) if end < 0 else end
            found.append((kind, start, used[kind]))
    if not found:
        return found
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    if text.isascii():
        return found
    places, at, points = {}, 0, 0
    for place in sorted({p for _, start, end in found for p in (start, end)}):
        points += len(text[at:place].decode())
        at = place
        places[place] = points
    return [(kind, places[start], places[end]) for kind, start, end in found]


@F.arrow_udf(returnType=T.ArrayType(SPAN, False))
def _spans(text: pa.Array) -> pa.Array:
    return pa.array([find_spans(t) for t in each_as_bytes(text)], _ARROW_SPANS)


def scan_secrets(df: DataFrame, text="text", into="secrets") -> DataFrame:
    """`df` with an array of `(kind, start, end)` of every secret in a text.

    Null and empty texts have an empty array. All other columns stay; one named
    like `into` is replaced. Repeated rows are each scanned. Row-wise, no shuffle.
    """
    return df.withColumn(into, _spans.asNondeterministic()(F.col(text).cast("string")))


def joined_spans(spans: Column, kinds=KINDS) -> Column:
    """`kind:start:end`, comma-joined, of the spans of these kinds."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    parts = F.transform(
        chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(parts, ",")


def redact_secrets(df: DataFrame, text="text", mark="<secret>") -> DataFrame:
    """Every secret replaced by `mark`; overlapping spans become one.

    Texts without a secret, null and empty ones stay as they are. When there is an
    `n_chars` column, it is set anew for changed texts.
    """

    def redacted(value):
        spans = find_spans(value.encode()) if value else []
        if not spans:
            return value
        parts, at = [], 0
        for _, start, end in spans:
            if start >= at:
                parts += [value[at:start], mark]
            at = max(at, end)
        return "".join(parts) + value[at:]

    @F.arrow_udf(returnType=T.StringType())
    def cut(column: pa.Array) -> pa.Array:
        return joined(([redacted(v) for v in values] for (values,) in portions(column)), pa.string())

    names = df.columns
    after = unused_name("cleaned", names)
    cleaned = df.withColumn(after, cut.asNondeterministic()(F.col(text).cast("string")))
    if "n_chars" in names:
        kept = F.col(after).eqNullSafe(F.col(text))
        count = F.char_length(after).cast(df.schema["n_chars"].dataType)
        cleaned = cleaned.withColumn("n_chars", F.when(kept, F.col("n_chars")).otherwise(count))
    return cleaned.withColumn(text, F.col(after)).select(*[F.col(f"`{n}`") for n in names])

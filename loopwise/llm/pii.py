"""Format-preserving pseudonyms for personal data.

Validated numbers and dates are permuted within their own format by a keyed
Feistel network, so equal values get equal pseudonyms in every document and
nothing but the key is kept.  Cards keep a valid check digit, addresses stay
addresses, dates stay dates.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 8
#: Letters and digits that are permuted as one number; longer values in pieces.
PIECE = 64
#: Different hexadecimal digits that a secret has at least.
SECRET_DIGITS = 8
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

# One alternation; its order settles overlaps.
_FOUND = re.compile(
    r"""(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+)
    |(?P<secret>(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z]))
    |(?P<phone>(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}(?![0-9]))
    |(?P<ipv4>(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9]))
    |(?P<date>(?<![0-9-])(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9](?![0-9-]))
    |(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))
    |(?P<card>(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]))""",
    re.VERBOSE,
)
_GROUP = re.compile(r"[0-9]+")
_LIKELY = re.compile(r"[0-9@]")


def permute(value: int, size: int, key: bytes, tweak: str, backwards: bool = False) -> int:
    """A keyed permutation of range(size): a Feistel network over pairs below
    the square root, walked on until it is back in range."""
    if size < 2:
        return value
    side = math.isqrt(size - 1) + 1
    while True:
        left, right = divmod(value, side)
        for i in reversed(range(ROUNDS)) if backwards else range(ROUNDS):
            of = left if backwards else right
            digest = hashlib.blake2b(f"{tweak}/{size}/{i}/{of}".encode(), key=key, digest_size=32).digest()
            mixed = int.from_bytes(digest) % side
            left, right = ((right - mixed) % side, left) if backwards else (right, (left + mixed) % side)
        value = left * side + right
        if value < size:
            return value


def luhn_digit(digits: str) -> str:
    """The check digit that follows `digits`."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _letters(text: str, key: bytes, kind: str, alphabet: str | None = None, backwards: bool = False) -> str:
    """Permutes the letters and digits of a text within their classes, as one
    number; other characters stay."""
    classes = [alphabet] if alphabet else ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    at = [(i, c) for i, ch in enumerate(text) for c in classes if ch in c]
    out = list(text)
    for first in range(0, len(at), PIECE):
        piece, value = at[first : first + PIECE], 0
        size = math.prod(len(c) for _, c in piece)
        for i, c in piece:
            value = value * len(c) + c.index(text[i])
        shape = "".join(str(classes.index(c)) for _, c in piece)
        value = permute(value, size, key, f"{kind}/{first}/{shape}", backwards)
        for i, c in reversed(piece):
            value, n = divmod(value, len(c))
            out[i] = c[n]
    return "".join(out)


def pseudonym(kind: str, text: str, key: bytes, backwards: bool = False) -> str | None:
    """The pseudonym of a valid value (with `backwards`: the value of a
    pseudonym); None if it isn't valid."""
    if kind == "card":
        digits = re.sub("[ -]", "", text)
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        size = 10 ** (len(digits) - 1)
        body = int(digits[:-1])
        while True:  # a pseudonym is a valid card too: not of one digit alone
            body = permute(body, size, key, "card", backwards)
            new = f"{body:0{len(digits) - 1}d}"
            new += luhn_digit(new)
            if len(set(new)) > 1:
                break
        fresh = iter(new)
        return "".join(next(fresh) if c.isdigit() else c for c in text)
    if kind == "ipv4":
        octets = text.split(".")
        if any(int(o) > 255 or o != str(int(o)) for o in octets):
            return None
        value = permute(int.from_bytes(bytes(map(int, octets))), 1 << 32, key, "ipv4", backwards)
        return ".".join(map(str, value.to_bytes(4)))
    if kind == "date":
        try:
            day = datetime.date.fromisoformat(text).toordinal()
        except ValueError:
            return None
        return datetime.date.fromordinal(_FIRST_DAY + permute(day - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, key, "date", backwards)).isoformat()
    if kind == "ssn":
        area, group, serial = map(int, text.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        areas = [a for a in range(1, 900) if a != 666]
        value = (areas.index(area) * 99 + group - 1) * 9999 + serial - 1
        value, serial = divmod(permute(value, len(areas) * 99 * 9999, key, "ssn", backwards), 9999)
        area, group = divmod(value, 99)
        return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"
    if kind == "phone":
        country = re.match(r"\+[0-9]{1,3}(?=[ .(-])|\+[0-9]", text)[0]
        if country[1] == "0" or sum(c.isdigit() for c in text) > 15:
            return None
        return country + _letters(text[len(country) :], key, "phone/" + country, "0123456789", backwards)
    if kind == "email":
        local, _, domain = text.partition("@")
        return _letters(local, key, "email/" + domain.lower(), None, backwards) + "@" + domain
    if kind != "secret" or not backwards and (len(set(text)) < SECRET_DIGITS or text.isalpha() or text.isdigit()):
        return None
    return _letters(text, key, kind, "0123456789ABCDEF" if any(c in "ABCDEF" for c in text) else "0123456789abcdef", backwards)


def found(text: str, known: Callable[[str, str], str | None]) -> Iterator[tuple[str, int, int, str]]:
    """Kind, start, end and pseudonym of each valid value, in order.  Of a run of
    digit groups the longest part that is a card counts, from the first group that
    begins one; the search goes on right behind what was used, or at the next
    group if nothing was."""
    at = 0
    while m := _FOUND.search(text, at):
        kind, start, end = m.lastgroup, m.start(), m.end()
        new = known(kind, m[0])
        if new is None and kind == "card":
            for g in reversed(list(_GROUP.finditer(text, start, end))[:-1]):
                part = text[start : g.end()]
                if 13 <= sum(c.isdigit() for c in part) and (new := known(kind, part)) is not None:
                    end = g.end()
                    break
        if new is not None:
            yield kind, start, end, new
            at = end
        else:
            at = _GROUP.match(text, start).end() if kind == "card" else end


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", SPANS)])


def pseudonymised(docs: DataFrame, key: str, into: str = "__spans") -> DataFrame:
    """`docs` with text rewritten and, as column `into` (a column of that name is
    replaced), the spans found: kind, start, end in characters, as they stand in the
    new text.

    Equal values get equal pseudonyms in every row, so repeated rows stay equal; of
    values that overlap the first in `_FOUND` counts.  Null stays null; empty texts
    and those without a valid value stay as they are, with no span; very long texts
    and values are read to their end; other columns, whatever their names, stay;
    an empty table gives an empty result.  The domain of an address stays in clear:
    only numbers, dates and names are permuted."""
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()

    @F.arrow_udf(RESULT)
    def rewrite(text: pa.Array) -> pa.Array:
        known = lru_cache(100_000)(lambda kind, value: pseudonym(kind, value, secret))
        out = []
        for t in text.to_pylist():
            if t is None or not _LIKELY.search(t):
                out.append({"text": t, "spans": []})
                continue
            parts, spans, at, size = [], [], 0, 0
            for kind, start, end, new in found(t, known):
                parts += [t[at:start], new]
                size += start - at
                spans.append({"kind": kind, "start": size, "end": size + len(new)})
                size += len(new)
                at = end
            out.append({"text": "".join([*parts, t[at:]]), "spans": spans})
        return pa.array(out, pa.struct([("text", pa.string()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))]))

    whole = docs.select(F.struct("*").alias("row"), rewrite("text").alias("found"))
    keep = [F.col("found.text").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c != into]
    return whole.select(*keep, F.col("found.spans").alias(into))


#: The key of the registered query; a user gives their own.
DEMO_KEY = "an example key"


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = pseudonymised(docs, DEMO_KEY)
    return rows.select("doc_id", "text", F.size("__spans").cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct("__spans.kind")), ",").alias("kinds"), F.to_json("__spans").alias("spans"))

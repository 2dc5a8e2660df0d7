"""Secret scans: known forms, and sliding-window entropy per character class.

Known forms are found by pattern. Besides them, every run of a class's
characters is a candidate string, over which a window slides: counts of its
characters are kept up to date, one character in and one out, and a window
whose Shannon entropy reaches the class's limit is suspicious. Windows that
overlap make one span; spans that meet an allow-listed passage are suppressed.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.llm.common import arrow_map

# Kind, pattern, group whose length counts, least length. A match that is too short is dropped
# after matching, so that what it covers is not matched again.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
BASE_KINDS = [kind for kind, *_ in BASE]
SPANS = "array<struct<kind string, start int, end int>>"
# Entropy terms are whole multiples of 2**-32, so that incremental sums are exact.
UNIT = 1 << 32


@dataclass(frozen=True)
class CharacterClass:
    """Alphabet of a kind of secret, its window and the bits a window must reach.

    ``mixed`` lists sub-alphabets of which a window must hold a character each:
    words and plain numbers have one kind of character only.
    """

    kind: str
    alphabet: str
    window: int
    bits: float
    mixed: tuple[str, ...]


CLASSES = (
    CharacterClass("entropy16", "0-9A-Fa-f", 24, 3.0, ("0123456789", "ABCDEFabcdef")),
    CharacterClass("entropy64", "A-Za-z0-9+/_-", 24, 3.9, (
        "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")),
)
# Passages that look random and are no secrets.
ALLOWED = (
    r"[A-Za-z][A-Za-z0-9+.-]*://[^\s?#\"'<>]*",  # addresses, without their parameters
    r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Fa-f])",  # universal identifiers
    r"(?i:md5|sha-?1|sha-?224|sha-?256|sha-?384|sha-?512|checksum|digest|etag|commit|integrity)[\"']?[\x20:=_-]*[\"']?[A-Za-z0-9+/=_-]+",
    r"[A-Za-z0-9+/_-]*(?i:example|placeholder|changeme|abcdefghij|0123456789|xxxxxx)[A-Za-z0-9+/_-]*",
)


def entropy_terms(window: int) -> list[int]:
    """``c * log2(c)`` for all counts of a window, in units."""
    return [0, *(round(c * math.log2(c) * UNIT) for c in range(1, window + 1))]


def suspicious(run: str, cls: CharacterClass) -> list[tuple[int, int]]:
    """Merged windows of ``run`` at or above the class's entropy, as ``(start, end)``."""
    size, terms = cls.window, entropy_terms(cls.window)
    # H = log2(size) - sum(c * log2 c) / size >= bits
    most = math.floor(size * (math.log2(size) - cls.bits) * UNIT)
    group = {c: k for k, part in enumerate(cls.mixed) for c in part}
    counts: Counter = Counter()
    held = [0] * (len(cls.mixed) + 1)
    total, spans = 0, []
    for at, new in enumerate(run):
        if at >= size:
            old = run[at - size]
            total += terms[counts[old] - 1] - terms[counts[old]]
            counts[old] -= 1
            held[group.get(old, -1)] -= 1
        total += terms[counts[new] + 1] - terms[counts[new]]
        counts[new] += 1
        held[group.get(new, -1)] += 1
        if at >= size - 1 and total <= most and all(held[:-1]):
            if spans and at - size + 1 <= spans[-1][1]:
                spans[-1] = (spans[-1][0], at + 1)
            else:
                spans.append((at - size + 1, at + 1))
    return spans


class Scanner:
    """Compiled patterns of one task."""

    def __init__(self, classes: Sequence[CharacterClass], allowed: Sequence[str]) -> None:
        self.base = [(kind, re.compile(pattern, re.ASCII), group, least) for kind, pattern, group, least in BASE]
        self.classes = [
            (c, re.compile(f"(?<![{c.alphabet}])[{c.alphabet}]{{{c.window},}}")) for c in classes
        ]
        self.allowed = re.compile("|".join(f"(?:{p})" for p in allowed)) if allowed else None

    def known(self, text: str) -> list[tuple[str, int, int]]:
        found = []
        for kind, pattern, group, least in self.base:
            if kind == "assign" and ":" not in text and "=" not in text:
                continue
            found += [(kind, *m.span()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
        return found

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        """All spans: base ones, and the entropy spans that neither a base span covers nor an allowed passage meets."""
        known = self.known(text)
        more = []
        for cls, pattern in self.classes:
            for m in pattern.finditer(text):
                at = m.start()
                more += [(cls.kind, at + a, at + b) for a, b in suspicious(m.group(), cls)]
        if more:
            covers = [(a, b) for _, a, b in known]
            allowed = [m.span() for m in self.allowed.finditer(text)] if self.allowed else []
            more = [
                (kind, a, b) for kind, a, b in more
                if not any(x <= a and b <= y for x, y in covers) and not any(x < b and a < y for x, y in allowed)
            ]
            # What two classes both find is reported for the first of them.
            seen: list[tuple[str, int, int]] = []
            for kind, a, b in more:
                if not any(x <= a and b <= y for _, x, y in seen):
                    seen.append((kind, a, b))
            more = seen
        order = {kind: k for k, kind in enumerate([*BASE_KINDS, *(c.kind for c, _ in self.classes)])}
        return sorted(known + more, key=lambda s: (s[1], order[s[0]], s[2]))


def find_secrets(df: DataFrame, text_col: str = "text", out: str = "secrets", *,
                 classes: Sequence[CharacterClass] = CLASSES, allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """Replace ``text_col`` by ``out``: the text's spans ``(kind, start, end)``, in code points, end exclusive.

    Other columns stay; one named ``out`` is replaced. Whole texts are
    scanned, of any length. Null and empty texts have no spans; equal rows have
    equal spans; an empty table gives an empty one. Spans are ordered by start,
    then by kind: the known forms first, then the classes as listed.
    """
    kept = df.drop(*({out} - {text_col}))
    place = kept.columns.index(text_col)
    made: list[Scanner] = []

    def run(batch):
        if not made:
            made.append(Scanner(classes, allowed))
        spans = [
            [{"kind": k, "start": a, "end": b} for k, a, b in made[0].scan(t)] if t else []
            for t in batch.column(place).to_pylist()
        ]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return [*(c for k, c in enumerate(batch.columns) if k != place), pa.array(spans, kind)]

    rest = [f for f in kept.schema.fields if f.name != text_col]
    return arrow_map(kept, run, T.StructType([*rest, *T._parse_datatype_string(f"{out} {SPANS}").fields]))


def span_list(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = F.filter("secrets", lambda s: s["kind"].isin(BASE_KINDS))

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find_secrets(docs).select(
        "doc_id", *map(count, BASE_KINDS), F.sha2(span_list(base), 256).alias("base_sha256"), span_list("secrets").alias("spans"),
    )

"""Byte-pair encoding and decoding with a public tokenizer file.

A text is cut into pieces; a piece's symbols form a doubly linked list, and a
priority queue holds the rank and place of every neighbouring pair that can
merge. Entries whose symbols have changed since are skipped. Decoding
concatenates vocabulary strings.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import arrow_map, text_bytes

# The piece pattern and byte alphabet of byte-level BPE files.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

# Words and pieces whose ids a task remembers at most twice over, which changes no result.
REMEMBERED_WORDS = 200_000
REMEMBERED_PIECES = 150_000
LONGEST_REMEMBERED = 100
# A pair of symbols as one number, and a queue entry's rank and place as one.
PAIR_BITS, PLACE_BITS = 24, 40
# A merge's rank and symbol as one number. Up to this many symbols, looking
# through all pairs costs less than a queue of them.
SYMBOL_BITS, NO_MERGE = 24, 1 << 62
SHORT_PIECE = 40


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in vocabulary strings."""
    others = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(others)}


class BpeModel:
    """Vocabulary, merges and added tokens of a byte-level tokenizer file.

    Its parts are plain values of a fixed size, which are shipped to every task.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if (
            model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
            or not pre.get("use_regex", True) or spec["normalizer"]
            or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        ):
            raise ValueError("only plain byte-level BPE files are supported")
        alphabet = byte_alphabet()
        vocab = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.first = [0] * 256
        for char, byte in alphabet.items():
            self.first[byte] = vocab[char]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left] << PAIR_BITS | vocab[right]] = (rank, vocab[left + right])
        self.strings = {i: bytes(alphabet[c] for c in s) for s, i in vocab.items()}
        self.strings |= {i: s.encode() for s, i in self.added.items()}

    def parts(self) -> tuple[list[int], dict, dict]:
        return self.first, self.merges, self.added


def merge_symbols(symbols: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """Apply merges by rank, leftmost first, until none is left.

    ``after`` and ``before`` link the symbols that are left. A queue entry is
    stale if the pair at its place is gone or has another rank by now.
    """
    size, find, place = len(symbols), merges.get, (1 << PLACE_BITS) - 1
    queue = []
    for at in range(size - 1):
        found = find(symbols[at] << PAIR_BITS | symbols[at + 1])
        if found:
            queue.append(found[0] << PLACE_BITS | at)
    if not queue:
        return symbols
    before, after = list(range(-1, size)), list(range(1, size + 1))
    heapq.heapify(queue)
    while queue:
        entry = heapq.heappop(queue)
        at = entry & place
        nxt = after[at]
        if nxt >= size or symbols[at] < 0:
            continue
        found = find(symbols[at] << PAIR_BITS | symbols[nxt])
        if not found or found[0] != entry >> PLACE_BITS:
            continue
        symbols[at] = merged = found[1]
        symbols[nxt] = -1
        after[at] = follow = after[nxt]
        if follow < size:
            before[follow] = at
            found = find(merged << PAIR_BITS | symbols[follow])
            if found:
                heapq.heappush(queue, found[0] << PLACE_BITS | at)
        ahead = before[at]
        if ahead >= 0:
            found = find(symbols[ahead] << PAIR_BITS | merged)
            if found:
                heapq.heappush(queue, found[0] << PLACE_BITS | ahead)
    return [s for s in symbols if s >= 0]


def packed_merges(merges: dict[int, tuple[int, int]]) -> dict[int, int]:
    """Rank and symbol of each merge as one number, which sorts by rank."""
    return {pair: rank << SYMBOL_BITS | symbol for pair, (rank, symbol) in merges.items()}


def merge_short(symbols: list[int], packed: dict[int, int]) -> list[int]:
    """Like :func:`merge_symbols`, with a list of all neighbours' merges in which the least is looked for each time."""
    find, mask = packed.get, (1 << SYMBOL_BITS) - 1
    found = [find(a << PAIR_BITS | b, NO_MERGE) for a, b in zip(symbols, symbols[1:])]
    last = len(found) - 1
    while last >= 0:
        least = min(found)
        if least == NO_MERGE:
            break
        at = found.index(least)
        symbols[at] = merged = least & mask
        del symbols[at + 1], found[at]
        last -= 1
        if at <= last:
            found[at] = find(merged << PAIR_BITS | symbols[at + 1], NO_MERGE)
        if at:
            found[at - 1] = find(symbols[at - 1] << PAIR_BITS | merged, NO_MERGE)
    return symbols


class Store(dict):
    """Values by text, made on first use, in two generations of ``limit`` texts.

    When the younger one is full it takes the older one's place; a text found
    there moves back, so frequent ones stay.
    """

    def __init__(self, make: Callable[[str], bytes], limit: int) -> None:
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, text: str) -> bytes:
        value = self.older.pop(text, None)
        if value is None:
            value = self.make(text)
        if len(text) <= LONGEST_REMEMBERED:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[text] = value
        return value


class Encoder:
    """Packed ids of texts; remembers words, each with a space before it, and the pieces that words consist of."""

    def __init__(self, first: list[int], merges: dict, added: dict) -> None:
        self.first, self.merges, self.added = first, merges, added
        self.packed = packed_merges(merges)
        self.pieces_of = regex.compile(PIECES).findall
        longest_first = sorted(added, key=len, reverse=True)
        self.split_added = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        self.pieces = Store(self.piece, REMEMBERED_PIECES)
        self.words = Store(self.word, REMEMBERED_WORDS)

    def piece(self, piece: str) -> bytes:
        symbols = list(map(self.first.__getitem__, piece.encode("utf-8")))
        ids = merge_short(symbols, self.packed) if len(symbols) <= SHORT_PIECE else merge_symbols(symbols, self.merges)
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, word: str) -> bytes:
        """Ids of a word after a space; plain letters are one piece, which need not be looked for."""
        if word.isascii() and word.isalpha():
            return self.pieces[" " + word]
        return self.plain(" " + word)

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pieces_of(text)))

    def ordinary(self, text: str) -> bytes:
        """Ids of a text without added tokens.

        No piece reaches across a single space before another character, so
        the text may be cut there; runs of spaces are matched as a whole.
        """
        if "  " in text:
            parts = regex.split(r"(?<! ) (?=[^ ])", text)
        else:
            parts = text.split(" ")
        return self.plain(parts[0]) + b"".join(map(self.words.__getitem__, parts[1:]))

    def encode(self, text: str) -> bytes:
        if self.split_added is None:
            return self.ordinary(text)
        parts = self.split_added.split(text) if any(t in text for t in self.added) else [text]
        return b"".join(
            struct.pack("<I", self.added[p]) if k % 2 else self.ordinary(p) if p else b"" for k, p in enumerate(parts)
        )


def encode(df: DataFrame, model_path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``: the text's token ids as packed little-endian unsigned 32-bit integers.

    All columns of ``df`` stay; one named ``out`` is replaced. A null text
    counts as empty and gives no ids. Added tokens in the text become their
    ids, no others are added; texts of any length are encoded whole. Equal
    rows get equal ids; an empty table gives an empty one.
    """
    shipped = df.sparkSession.sparkContext.broadcast(BpeModel(model_path).parts())
    kept = df.drop(out)
    place = kept.columns.index(text_col)
    made: list[Encoder] = []

    def run(batch):
        if not made:
            made.append(Encoder(*shipped.value))
        texts = [x or "" for x in batch.column(place).to_pylist()]
        return [*batch.columns, pa.array([made[0].encode(t) for t in texts], pa.binary())]

    return arrow_map(kept, run, kept.withColumn(out, F.lit(b"")).schema)


def joined(packed: bytes, string_of: dict[int, bytes]) -> str:
    """Text of packed ids: their vocabulary strings, concatenated."""
    ids = np.frombuffer(packed, dtype="<u4").tolist()
    try:
        text = b"".join(map(string_of.__getitem__, ids))
    except KeyError:
        text = b"".join(string_of.get(i, b"") for i in ids)
    return text.decode("utf-8", "replace")


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the text of packed token ids, special tokens included.

    All columns of ``df`` stay; one named ``out`` is replaced. Null or empty
    ids give an empty text; ids outside the vocabulary give nothing; bytes that
    are no UTF-8 become U+FFFD. Equal rows get equal texts; an empty table gives
    an empty one.
    """
    shipped = df.sparkSession.sparkContext.broadcast(BpeModel(model_path).strings)
    kept = df.drop(out)
    place = kept.columns.index(ids_col)

    def run(batch):
        return [*batch.columns, pa.array([joined(p, shipped.value) for p in text_bytes(batch.column(place))], pa.string())]

    return arrow_map(kept, run, kept.withColumn(out, F.lit("")).schema)


def recode(df: DataFrame, model_path: str, text_col: str = "text", ids_out: str = "ids", text_out: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` of what it gave, in one worker: replaces ``text_col`` by ids and decoded text.

    Null texts, repeated rows and empty tables are as in these two.
    """
    model = BpeModel(model_path)
    context = df.sparkSession.sparkContext
    parts, strings = context.broadcast(model.parts()), context.broadcast(model.strings)
    kept = df.drop(*({ids_out, text_out} - {text_col}))
    place = kept.columns.index(text_col)
    made: list[Encoder] = []

    def run(batch):
        if not made:
            made.append(Encoder(*parts.value))
        packed = [made[0].encode(t or "") for t in batch.column(place).to_pylist()]
        texts = [joined(p, strings.value) for p in packed]
        rest = [c for k, c in enumerate(batch.columns) if k != place]
        return [*rest, pa.array(packed, pa.binary()), pa.array(texts, pa.string())]

    schema = kept.drop(text_col).withColumn(ids_out, F.lit(b"")).withColumn(text_out, F.lit("")).schema
    return arrow_map(kept, run, schema)


def default_model() -> str:
    """Path of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded_digests(docs: DataFrame, model_path: str) -> DataFrame:
    return recode(docs.select("doc_id", "text"), model_path).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())

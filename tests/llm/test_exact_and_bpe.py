import hashlib
import random
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

from creditloom.llm import bpe, exact_dedup

SPACES = re.compile(r"[\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\t", "a b", "a  b", "a\tb ", " a b", "a b", "é" * 9000, ("word " * 4000), ("word  " * 4000), "x" * 70000]


def test_exact_duplicates_match_brute_force(docs_of):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (3, None), (4, "a b"), (4, "a b"), (None, "only"), (None, "only")]
    for digest_bytes in (16, 1):  # with one byte, different chunks share digests
        got = exact_dedup.exact_duplicates(docs_of(rows), digest_bytes=digest_bytes).collect()
        groups = {}
        for i, t in rows:
            groups.setdefault(SPACES.sub(" ", t or ""), []).append(i)
        assert len(got) == len(rows)
        sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
        for r in got:
            ids = sha[r.text_sha256]
            known = [i for i in ids if i is not None]
            assert r.group_size == len(ids) and r.keep_id == (min(known) if known else None)
        assert sum(r.kept for r in got) == len(groups)


def test_exact_duplicates_of_nothing(docs_of):
    assert exact_dedup.exact_duplicates(docs_of([])).count() == 0


def test_chunks_are_cut_alike_after_an_insertion():
    random.seed(3)
    text = bytes(random.randrange(97, 123) for _ in range(60000))
    weights = exact_dedup.byte_weights()

    def chunks(t):
        ends = exact_dedup.cut_points(t, weights)
        assert ends[-1] == len(t) and ends == sorted(set(ends))
        return {t[a:b] for a, b in zip([0, *ends], ends)}

    assert len(chunks(text) & chunks(b"inserted" + text)) > len(chunks(text)) // 2


def test_bpe_equals_the_library(docs_of):
    path = bpe.default_model()
    library = Tokenizer.from_file(path)
    random.seed(9)
    bits = [" ", "  ", "   ", "\n", "\t", "a", "Wörter", "1", "22", ".", "!!", "'s", "'t", "<|endoftext|>", " ", "　", "日本", "😀", "\r\n", "\x1c"]
    texts = [*ODD, *("".join(random.choices(bits, k=random.randint(0, 12))) for _ in range(500))]
    got = {r.doc_id: r for r in bpe.recode(docs_of(list(enumerate(texts))), path).collect()}
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want
        assert got[i].decoded == library.decode(want, skip_special_tokens=False) == (text or "")


def test_bpe_encode_then_decode_keeps_columns(docs_of):
    path = bpe.default_model()
    docs = docs_of([(1, "two words"), (2, None)])
    coded = bpe.encode(docs, path)
    assert set(coded.columns) == set(docs.columns)  # its own column of that name was replaced
    again = bpe.decode(coded, path, out="lang")
    assert {r.doc_id: r.lang for r in again.collect()} == {1: "two words", 2: ""}
    assert bpe.encode(docs_of([]), path).count() == 0


def test_merges_skip_stale_pairs():
    merges = {a << bpe.PAIR_BITS | b: found for (a, b), found in {(0, 1): (1, 2), (1, 1): (0, 3), (2, 1): (2, 4)}.items()}
    assert bpe.merge_symbols([0, 1, 1, 0, 1], merges) == [0, 3, 2]


def test_more_words_than_a_store_holds():
    """Two small generations give the ids of a large one, also within one text."""
    model = bpe.BpeModel(bpe.default_model())
    random.seed(4)
    words = ["".join(random.choices("abcdefgh", k=random.randint(1, 6))) for _ in range(3000)]
    text = " ".join(random.choices(words, k=20_000))
    small, large = bpe.Encoder(*model.parts()), bpe.Encoder(*model.parts())
    small.words.limit, small.pieces.limit = 50, 20
    assert small.encode(text) == large.encode(text)
    assert len(small.words) <= 50 and len(small.words.older) <= 50 and len(small.pieces) <= 20 < len(large.pieces)


def test_short_pieces_merge_without_a_queue(monkeypatch):
    """Looking through the pairs gives the queue's ids, also of repeated letters, and a plain word is no regex match."""
    model = bpe.BpeModel(bpe.default_model())
    random.seed(5)
    words = ["".join(random.choices("aeinrst\u00e9'9.", k=random.randint(1, 60))) for _ in range(2000)]
    words += ["a" * n for n in range(1, 70)] + [" ", "", "''s", "don't"]
    texts = [" ".join(random.choices(words, k=50)) for _ in range(40)]
    got = [bpe.Encoder(*model.parts()).encode(t) for t in texts]
    monkeypatch.setattr(bpe, "SHORT_PIECE", 0)
    monkeypatch.setattr(bpe.Encoder, "word", lambda self, word: self.plain(" " + word))
    assert got == [bpe.Encoder(*model.parts()).encode(t) for t in texts]
    monkeypatch.undo()
    encoder = bpe.Encoder(*model.parts())
    monkeypatch.setattr(bpe, "merge_symbols", None)
    encoder.pieces_of = lambda text: [text] if text in ("", "some") else pytest.fail("matched")
    assert encoder.encode("some plain letters") == bpe.Encoder(*model.parts()).encode("some plain letters")

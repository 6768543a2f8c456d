"""Array helpers against plain Python."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tests.llm.cases import hard_texts
from tickloom.llm import tokens, words
from tickloom.llm.common import buffer_of

TEXTS = [t for _, t in hard_texts()] + [
    "  a b", "a b ", " x", "a\n b\tc d", "x\ty z\x01w q", "it's we'll I 'm O'Neil's", "a  b", "Σας ΣΑΣ Σ é ́ x. Σ a.Σ b",
    "12 345 6", "a　 b c  d", "z \n\n y", "a. b, c.d ,e", "word.\nNext one, two.",
]


def test_words_hashes_and_windows():
    data, bounds = buffer_of(pa.array(TEXTS))
    starts, ends, counts = words.spans(data, bounds, words.SPACED)
    want = [(t or "").encode().split() for t in TEXTS]
    assert counts.tolist() == [len(w) for w in want]
    raw = data.tobytes()
    flat = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    assert flat == [w for ws in want for w in ws]
    hashes = words.word_hashes(data, starts, ends).tolist()
    assert len(set(zip(flat, hashes, strict=True))) == len(set(flat)) == len(set(hashes))
    seen = words.window_hashes(np.array(hashes, np.uint64), 3).tolist()
    grams = list(zip(flat, flat[1:], flat[2:], strict=False))
    assert len(seen) == len(grams) and len(set(zip(grams, seen, strict=True))) == len(set(grams)) == len(set(seen))


def test_hashes_do_not_depend_on_steps(monkeypatch):
    data, bounds = buffer_of(pa.array(["alpha beta gamma " * 50, "q" * 5000 + " end"]))
    starts, ends, _ = words.spans(data, bounds, words.SPACED)
    whole = words.word_hashes(data, starts, ends)
    windows = words.window_hashes(whole, 5)
    monkeypatch.setattr(words, "STEP", 64)
    assert (words.word_hashes(data, starts, ends) == whole).all()
    assert (words.window_hashes(whole, 5) == windows).all()


@pytest.mark.parametrize(("file", "mark"), [("byte_bpe_50k.json", tokens.BYTE_LEVEL), ("word_bpe_49k.json", tokens.SPACE_DROPPED)])
def test_pieces_give_the_ids_of_whole_texts(file, mark):
    ours = tokens.encoder(public_tokenizers.path(file), mark)
    for _ in range(2):  # the second time from memory
        ids, cuts = ours.encode(*buffer_of(pa.array(TEXTS)), 7)
        got = [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        found = ours.tokenizer.encode_batch([t or "" for t in TEXTS], add_special_tokens=False)
        assert got == [x.ids + [7] for x in found]

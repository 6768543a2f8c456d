"""SentencePiece models on the tokenizers library: encoding, decoding and a check of parity.

The model file is a protobuf; its pieces, scores and settings are read here and the tokenizer is
put together from them: normaliser (identity or the model's own character map, the space before
the text, the marker for spaces), unigram scores or the merges that BPE scores stand for, and
byte fallback.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.common import buffer_of, plain, slices
from tickloom.llm.tokens import Encoder

MARKER = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def protobuf(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one message: whole numbers, or the bytes of anything else."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}[key & 7] if key & 7 != 2 else number()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True


def parsed(data: bytes) -> Model:
    """What encoding needs of a model file (fields of ModelProto, TrainerSpec, NormalizerSpec)."""
    model = Model()
    for number, value in protobuf(data):
        if number == 1:
            piece = dict(protobuf(value))
            score = struct.unpack("<f", piece.get(2, bytes(4)))[0]
            model.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(protobuf(value))
            model.kind, model.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        elif number == 3:
            rules = dict(protobuf(value))
            model.charsmap, model.dummy_prefix = rules.get(2, b""), bool(rules.get(3, 1))
            model.squeeze = bool(rules.get(4, 1))
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """Every way to put a piece together from two, the best pieces first."""
    plain_pieces = {p: s for p, s, kind in model.pieces if kind == NORMAL}
    out = []
    for piece in sorted(plain_pieces, key=lambda p: -plain_pieces[p]):
        out += [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in plain_pieces and piece[i:] in plain_pieces]
    return out


def tokenizer(model: Model):
    """The model as a Tokenizer."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    unknown = next(i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback)
    elif model.kind == BPE:
        core = models.BPE(
            {p: i for i, (p, _, _) in enumerate(model.pieces)}, merges(model),
            unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback,
        )
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARKER))
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARKER)])
    back = [decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.dummy_prefix:
        back.append(decoders.Strip(" ", 1, 0))
    out.decoder = decoders.Sequence(back)
    return out


class WordPieces(Encoder):
    """A text's ids put together from those of its words, each encoded once.

    That gives the ids of the whole text if no vocabulary entry goes on after a space, and the
    normaliser only marks spaces.
    """

    stops = False

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self._forget()

    @staticmethod
    def serves(model: Model) -> bool:
        crossing = any(MARKER in p.lstrip(MARKER) for p, _, kind in model.pieces if kind in (NORMAL, USER))
        return model.dummy_prefix and not (crossing or model.squeeze or model.charsmap)

    def _new(self, texts: list[str]) -> list[np.ndarray]:
        return self._batch([t[1:] for t in texts])  # the tokenizer puts the space before it


class Whole:
    """A text's ids by encoding all of it."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class ByWords(Whole):
    """The same ids from words that are remembered."""

    def __init__(self, tokenizer):
        super().__init__(tokenizer)
        self.words = WordPieces(tokenizer)

    def ids(self, texts: list[str]) -> list[list[int]]:
        spaced = pa.array([" " + t if t else "" for t in texts], pa.string())
        ids, cuts = self.words.encode(*buffer_of(spaced), None)
        return [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@cache
def loaded(file: str, threads: int):
    """Our encoder and the library's own processor, one pair per worker process."""
    os.environ.update(TOKENIZERS_PARALLELISM="true", RAYON_NUM_THREADS=str(threads))
    import sentencepiece

    with open(file, "rb") as data:
        model = parsed(data.read())
    ours = ByWords(tokenizer(model)) if WordPieces.serves(model) else Whole(tokenizer(model))
    return ours, sentencepiece.SentencePieceProcessor(model_file=file)


SCHEMA = "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean"


def encode(docs: DataFrame, file: str, threads: int = 2) -> DataFrame:
    """Per row: the number of ids, their CRC-32 (little-endian, unsigned, 32 bits), whether the
    library itself gives the same ids, and whether decoding gives the text again.

    Null texts are empty; empty texts have no ids. Repeated rows are each encoded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours, theirs = loaded(file, threads)
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = ours.ids(texts)
            same = [a == b for a, b in zip(ids, theirs.encode(texts, num_threads=1), strict=True)]
            back = [a == b for a, b in zip(texts, ours.tokenizer.decode_batch(ids, skip_special_tokens=False), strict=True)]
            sums = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array(sums, pa.int64()), pa.array(same), pa.array(back)],
                SCHEMA.replace(",", "").split()[::2],
            )

    return plain(docs, doc_id="long", text="string").mapInArrow(run, SCHEMA)

"""Packing, shards, records, SentencePiece and the pipeline against brute force."""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given as drawn
from hypothesis import settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.cases import ROOT, hard_texts
from tests.llm.cases import given as given_rows
from tests.llm.test_text_operators import kept, linked
from tickloom.llm import packing, quality, queries, records, sentencepieces, sharding, tokens
from tickloom.llm.common import Scratch

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def ids_of(file, texts, end):
    tokenizer = Tokenizer.from_file(file)
    found = tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.array(x.ids + [end], "<u4") for x in found]


def pieces_of(rows, capacity):
    out = []
    for (doc, _), ids in zip(rows, ids_of(BYTES, [t for _, t in rows], 2), strict=True):
        first = (len(ids) - 1) % capacity + 1
        edges = [0, *range(first, len(ids) + 1, capacity)]
        out += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return sorted(out, key=repr)


def assert_packed(found, capacity):
    by_sequence: dict[int, list] = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("capacity", [1024, 64])
def test_pack(docs, texts, nothing, capacity, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 5)
    found = packing.pack(docs, BYTES, tokens.BYTE_LEVEL, capacity=capacity).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=repr) == pieces_of(texts, capacity)
    used = assert_packed(found, capacity)
    counts = Counter(r.length for r in found)
    assert used == sum(n for _, n in packing.plan(counts, capacity)) <= 1.02 * packing.lower_bound(counts, capacity) + 1
    assert packing.pack(nothing, BYTES, tokens.BYTE_LEVEL).count() == 0


def fewest(sizes, capacity):
    """By trying every way: items in order, each into any open bin or a new one."""
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i]:
                go(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best


@settings(max_examples=60, deadline=None)
@drawn(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_plan_is_optimal_on_small_sets(sizes):
    plan = packing.plan(Counter(sizes), 20)
    assert Counter(s for f, n in plan for s in f * n) == Counter(sizes)
    assert all(sum(f) <= 20 for f, _ in plan)
    assert sum(n for _, n in plan) == fewest(sorted(sizes, reverse=True), 20)


def test_plan_tries_fillings_as_full_as_others():
    sizes = [10, 9, 9, 9, 8, 5, 5, 3, 2]
    plan = packing.plan(Counter(sizes), 20)
    assert Counter(s for f, n in plan for s in f * n) == Counter(sizes)
    assert sum(n for _, n in plan) == 3
    left = Counter(sizes[1:])
    assert set(packing.undominated(sorted(left), left, 10, 1000)) == {(9,), (8, 2), (5, 5)}


def test_fillings_get_fuller_and_are_maximal():
    left = {2: 1, 3: 2, 5: 1, 8: 1}
    found = list(packing.fillings(sorted(left), left, 11, 1000))
    assert found[0] == (8, 3) and sum(found[-1]) == max(
        sum(c) for n in range(1, 5) for c in combinations_with_replacement([2, 3, 5, 8], n)
        if sum(c) <= 11 and all(c.count(s) <= left[s] for s in c)
    )
    assert [sum(f) for f in found] == sorted({sum(f) for f in found})


@pytest.mark.parametrize("shards", [16, 3, 1])
def test_shards(docs, texts, nothing, shards, monkeypatch):
    monkeypatch.setattr(sharding, "TOGETHER", 10)
    found = sharding.shard(docs, shards).collect()
    want = [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts]
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in found), key=repr) == sorted(want, key=repr)
    by_shard: dict[int, list] = {}
    for r in found:
        by_shard.setdefault(r.shard, []).append(r)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    for rows in by_shard.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    sizes = [sum(r["size"] for r in by_shard.get(s, [])) for s in range(shards)]
    largest = max(r["size"] for r in found)
    assert max(sizes) - min(sizes) <= max(largest, 2 * max(1, sharding.HEAVY * sum(sizes) / shards))
    for crc, n in Counter(r.text_crc32 for r in found).items():
        group = [r for r in found if r.text_crc32 == crc]
        if sum(r["size"] for r in group) <= sum(sizes) / shards:
            assert len({r.shard for r in group}) == 1, n
    assert sharding.shard(nothing).count() == 0


def test_a_group_over_a_share_is_spread(session):
    rows = [(i, "same text " * 20) for i in range(400)] + [(1000 + i, f"t{i} " * 10) for i in range(300)]
    found = sharding.shard(session.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r["size"]
    assert len(found) == 700 and max(sizes.values()) <= 1.02 * min(sizes.values())


def plain_crc32c(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    assert records.crc32c(b"123456789") == 0xE3069283
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1023, 1024, 1025, 1027, 3000):
        data = rng.bytes(n)
        assert records.crc32c(data) == plain_crc32c(data)
    record = records.framed(b"payload")
    assert records.unframed(record) == (b"payload", len(record))
    for i in range(len(record)):
        broken = record[:i] + bytes([record[i] ^ 1]) + record[i + 1 :]
        with pytest.raises((ValueError, struct.error, MemoryError, OverflowError)):
            records.unframed(broken)


def test_records_round_trip(session, docs, texts, nothing, monkeypatch):
    monkeypatch.setattr(records, "FILE_BYTES", 100_000)
    folder = Scratch(session, "records").path("ids")
    parts = records.write_records(docs, folder, WORDS, tokens.SPACE_DROPPED)
    assert len(parts) > 3 and sum(n for _, n, _ in parts) == len(texts)
    found = [tuple(r) for r in records.read_records(session, folder).collect()]
    found.sort(key=lambda r: r[1])
    assert [r[0] for r in found] == sorted((d for d, _ in texts), key=lambda d: (d is not None, d))
    ids = ids_of(WORDS, [t for _, t in texts], 1)
    want = Counter((d, len(x), zlib.crc32(x.tobytes())) for (d, _), x in zip(texts, ids, strict=True))
    assert Counter((d, n, crc) for d, _, n, crc in found) == want
    at = 0
    for _, start, n, _ in found:
        assert start == at
        at += n
    fs, root = records.store(folder)
    index = np.frombuffer(fs.open_input_file(f"{root}/part-000001.idx").read(), "<u8")
    data = fs.open_input_file(f"{root}/part-000001.rec").read()
    for offset in index[::-1].tolist():  # any order
        records.unframed(data, offset)
    again = Scratch(session, "records").path("ids")
    assert records.write_records(nothing, again, WORDS, tokens.SPACE_DROPPED) == []
    assert records.read_records(session, again).count() == 0


def test_sentencepiece_parity_on_documents(docs, texts, nothing):
    theirs = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter()
    for d, t in texts:
        ids = theirs.encode(t or "")
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True, theirs.decode(ids) == (t or "")] += 1
    found = Counter(map(tuple, sentencepieces.encode(docs, PIECES).collect()))
    assert found == want and all(r[4] for r in found)
    assert sentencepieces.encode(nothing, PIECES).count() == 0


def test_words_give_the_ids_of_whole_texts():
    ours, theirs = sentencepieces.loaded(PIECES, 2)
    texts = [t or "" for _, t in hard_texts()] + [
        "Hello  world", "  a b ", "Éà\n\nx\ty", "日本 <s> x ﬁ", "a  b", "   ", " ", "</s>a<unk>", "▁a b", "a ▁b", "a\u3000 b. c",
    ]
    assert isinstance(ours, sentencepieces.ByWords)
    for _ in range(2):
        assert ours.ids(texts) == sentencepieces.Whole(ours.tokenizer).ids(texts) == theirs.encode(texts)


def message(*fields) -> bytes:
    """A protobuf message from (number, value) pairs."""

    def number(n: int) -> bytes:
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    out = b""
    for key, value in fields:
        if isinstance(value, int):
            out += number(key << 3) + number(value)
        elif isinstance(value, float):
            out += number(key << 3 | 5) + struct.pack("<f", value)
        else:
            out += number(key << 3 | 2) + number(len(value)) + value
    return out


@pytest.mark.parametrize("fallback", [True, False])
def test_sentencepiece_unigram_model(tmp_path, fallback):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if fallback:
        pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [("▁", -3.0, 1), ("▁a", -2.0, 1), ("b", -4.0, 1), ("ab", -2.5, 1), ("a", -4.5, 1), ("▁ab", -3.9, 1), ("ba", -3.3, 1), ("c", -6.0, 1)]
    data = message(
        *((1, message((1, p.encode()), (2, s), (3, k))) for p, s, k in pieces),
        (2, message((3, 1), (4, len(pieces)), (35, int(fallback)))), (3, message((1, b"identity"), (3, 1), (4, 1))),
    )
    file = tmp_path / "unigram.model"
    file.write_bytes(data)
    ours, theirs = sentencepieces.loaded(str(file), 1)
    assert sentencepieces.parsed(data).kind == sentencepieces.UNIGRAM
    for text in ("ab ab", "abba  cab", " a b ", "", "zé ab", "aabbaabb cc"):
        (ids,) = ours.ids([text])
        assert ids == theirs.encode(text), text
        if fallback:
            assert ours.tokenizer.decode(ids, skip_special_tokens=False) == theirs.decode(ids)


def test_pipeline(session, tmp_path):
    found = corpus_pipeline.run(session, ROOT).collect()
    rows = [(r["doc_id"], r["text"]) for r in given_rows()]
    texts = pa.array([t for _, t in rows])
    values = dict(zip(quality.MEASURES, quality.measured(pa.RecordBatch.from_arrays([texts], ["text"])), strict=True))
    fails = np.zeros(len(rows), bool)
    for _, condition in quality.RULES:
        fails |= eval(condition, {}, values)  # noqa: S307  the rules are plain comparisons
    rows = [r for r, f in zip(rows, fails, strict=True) if not f]
    stay = {d for c, d, _ in linked(rows) if c == d}
    rows = [r for r in rows if r[0] in stay]
    split = {d: (t or "").split() for d, t in rows}
    left = removed_words(rows)
    assert {d for d, *_ in kept(rows, 35)} == set(split)
    rows = [(d, left[d]) for d, _ in rows]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=repr) == pieces_of(rows, 1024)
    assert_packed(found, 1024)
    docs = session.read.parquet(f"{ROOT}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(session, docs, ROOT).columns == docs.columns


def removed_words(rows, width=35):
    split = {d: (t or "").encode().split() for d, t in rows}
    count = Counter(tuple(w[i : i + width]) for w in split.values() for i in range(len(w) - width + 1))
    out = {}
    for d, w in split.items():
        gone = {i + k for i in range(len(w) - width + 1) if count[tuple(w[i : i + width])] > 1 for k in range(width)}
        out[d] = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
    return out


@pytest.mark.parametrize("name", ["op2_best_fit_packing", "op6_prefix_sum_shards", "op7_framed_records", "op8_sentencepiece"])
def test_queries_return_the_contract(session, name):
    found = queries.QUERIES[name](session, ROOT)
    columns = {
        "op2_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
        "op6_prefix_sum_shards": "doc_id size text_crc32 law shard slot grown_shard",
        "op7_framed_records": "doc_id start n_tokens ids_crc32",
        "op8_sentencepiece": "doc_id n_tokens ids_crc32 parity round_trip",
    }[name].split()
    assert found.columns == columns
    assert {r.doc_id for r in found.collect()} == {r["doc_id"] for r in given_rows()}

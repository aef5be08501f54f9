import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from evflow.llm import packing, records
from evflow.llm.text import split_words
from evflow.llm.tokenize import default_tokenizer, token_bytes
from tests.llm.conftest import HARD


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_words_are_those_of_bytes():
    texts = [t for _, t in HARD]
    for array in (pa.array(texts), pa.array(["skip", *texts]).slice(1)):
        w = split_words(array)
        for k, t in enumerate(texts):
            assert [w.vocab[i].encode() for i in w.ids[w.offsets[k] : w.offsets[k + 1]]] == (t or "").encode().lower().split()


def test_tokens_equal_the_library():
    texts = [t for _, t in HARD]
    for _ in range(2):
        found = [np.frombuffer(b, "<u4").tolist() for b in token_bytes(pa.array(texts), default_tokenizer())]
        assert found == reference(texts)


def test_added_tokens_and_old_letters_equal_the_library():
    added = ["a <|endoftext|> b", "x<|endoftext|>Y<|StartOfText|> É<|startoftext|>.", "<|ENDOFTEXT|>!", "<|endoftext|>", "<|endof text|>", None, "A plain one."]
    letters = [c for c in map(chr, range(0x530)) if c.isalpha()]
    texts = [*added, " ".join(letters), " ".join(f"a{c}b. {c}{c.upper()}," for c in letters)]
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in token_bytes(pa.array(texts), default_tokenizer())] == reference(texts)


def test_memory_that_starts_again_changes_nothing(monkeypatch):
    monkeypatch.setattr("evflow.llm.tokenize.MEMORY_WORDS", 3)
    texts = [t for _, t in HARD]
    for k in range(len(texts)):
        part = texts[k:] + texts[:k]
        assert [np.frombuffer(b, "<u4").tolist() for b in token_bytes(pa.array(part), default_tokenizer())] == reference(part)


def test_records_round_trip(spark, hard):
    index = records.with_starts(records.write_records(hard, shards=3))
    rows = records.read_records(index.orderBy("size")).collect()
    ordered = sorted(((i, t or "") for i, t in HARD), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start, want = 0, []
    for (i, _), ids in zip(ordered, reference([t for _, t in ordered]), strict=True):
        ids = [*ids, 2]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), ids))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


def test_damaged_records_are_found():
    record = records.frame(b"payload")
    assert records.unframe(record) == b"payload"
    for k in range(len(record)):
        with pytest.raises((ValueError, struct.error)):
            records.unframe(record[:k] + bytes([record[k] ^ 1]) + record[k + 1 :])


def test_records_of_nothing(none):
    assert records.write_records(none).count() == 0


def check_packing(rows, docs, tiers=(512, 1024, 2048, 4096)):
    windows, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length, r.tier))
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
    for inside in windows.values():
        end = 0
        for offset, length, tier in sorted(inside):
            assert offset == end
            end += length
        assert end == tier <= tiers[-1] and end & (end - 1) == 0
    assert sum(length for inside in pieces.values() for _, length, _ in inside) == docs


def test_packing_covers_every_token(spark, hard):
    rows = packing.pack(hard, lot=3, ids=True).collect()
    check_packing(rows, sum(len(x) + 1 for x in reference([t for _, t in HARD])))
    own = {i: ids for (i, _), ids in zip(HARD, reference([t for _, t in HARD]), strict=True)}
    for r in rows:
        whole = [*own[r.doc_id], 2]
        assert r.ids == whole[r.start : r.start + r.length] and r.doc_tokens == len(whole)
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *r.ids))


def test_step_groups_are_balanced():
    windows = [(512, [(512, 0, 0)])] * 5 + [(4096, [(2048, 0, 0), (2048, 1, 0)]), (4096, [(4096, 2, 0)])] * 4
    groups = packing.groups_of(windows, 8192)
    for g in set(groups):
        own = [t for (t, _), k in zip(windows, groups, strict=True) if k == g]
        assert len(set(own)) == 1 and sum(own) <= 8192


def test_packing_nothing(none):
    assert packing.pack(none).count() == 0
    with pytest.raises(ValueError):
        packing.pack(none, tiers=(100,))

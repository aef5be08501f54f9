import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from evflow.llm import align as A
from evflow.llm.mph import PerfectHash


def plain(texts):
    """Groups of each text by both libraries on the whole text."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = A.default_tokenizers()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    shown = A.byte_letters()
    out = []
    for t in texts:
        if not t:
            out.append([])
            continue
        ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        raw_a = [bytes(shown[c] for c in a.id_to_token(k)) for k in ids_a]
        raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k in ids_b for p in [b.id_to_piece(k)]]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + t).encode():
            out.append([])
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        shared, groups, i, j = set(ends_a) & set(ends_b), [], 0, 0
        for end in sorted(shared):
            p, q = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((ids_a[i:p], ids_b[j:q]))
            i, j = p, q
        out.append(groups)
    return out


def brute(texts):
    every = plain(texts)
    links = [[(x, y) for g in doc for x in g[0] for y in g[1]] for doc in every]
    count = Counter(pair for own in links for pair in set(own))
    highest = Counter()
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    out = []
    for doc, own in zip(every, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in doc)
        out.append((sum(len(x) for x, _ in doc), sum(len(y) for _, y in doc), len(doc), len(own), sum(count[p] == highest[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if doc else ""))
    return out


def texts_of(seed):
    r = random.Random(seed)
    odd = "  \n\n\t\r\x0b\x0c\x1c\x1f\x85\xa0 ᠎  ​  　﻿▁éßÉİσς漢字かな🙂👩‍👩‍👧́'’.,;{}()*/<>|_-0123456789abcXYZ"
    words = "the and Thheorou don't we'll <s> </s> <|endoftext|> straße 12345 ;\r\n /** }); naïve über 你好世界 Ελλάδα كتاب 한국어 <0x0A> \x00 '".split(" ")
    out = [None, "", " ", "  ", "\n", " \n ", "a ", "a  ", "▁", "a▁b", "x\r\n y", "word" * 3000]
    for _ in range(120):
        out.append("".join(r.choice(odd) if r.random() < 0.3 else r.choice(words) + r.choice(["", " ", " ", "\n"]) for _ in range(r.randint(1, 40))))
    for _ in range(200):
        out.append(" ".join(r.choices(words[:12], k=r.randint(1, 30))))
    return out + out[:30]


def found(df, **more):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return Counter(tuple(r[c] for c in columns) for r in A.align(df, **more).collect())


def test_against_whole_texts(spark, monkeypatch):
    texts = texts_of(1)
    want = Counter((k, *x) for k, x in enumerate(brute(texts)))
    df = spark.createDataFrame([(k, t, 3, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, row long, groups string, n_a int").repartition(3)
    assert found(df) == want
    for resident in (0, 40):
        assert found(df, resident=resident, groups=False) == want


def test_every_sign_alone():
    every = [f"ab{chr(k)} {chr(k)}\n{chr(k)}{chr(k)} c{chr(k)}d" for k in [*range(1, 0x3100), 0xFEFF, 0xFFFD, *range(0x1F600, 0x1F610)]]
    aligner = A.Aligner(*A.default_tokenizers())
    for own, groups in zip(aligner.places(every), plain(every), strict=True):
        text = ";".join(aligner.texts[k] for k in own.tolist())
        assert text == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def test_small_memories_change_nothing(spark, monkeypatch):
    texts = [t for t in texts_of(2) if t][:60]
    monkeypatch.setattr(A, "UNITS", 20)
    monkeypatch.setattr(A, "HELD", 50)
    monkeypatch.setattr(A, "BATCH", 30)
    monkeypatch.setattr(A, "WIDE", 2)
    aligner = A.Aligner(*A.default_tokenizers())
    for t, groups in zip(texts, plain(texts), strict=True):
        own = aligner.places([t])[0]
        codes, times, _ = aligner.pairs_of(own)
        got = Counter()
        for code, n in zip(codes.tolist(), times.tolist(), strict=True):
            got[divmod(code, aligner.size_b)] += n
        assert got == Counter((x, y) for g in groups for x in g[0] for y in g[1])
        assert aligner.sums.rows()[own, 2].sum() == len(groups)


def test_hard_rows_and_empty_table(spark, hard, none):
    assert found(none) == Counter()
    rows = hard.collect()
    assert found(hard) == Counter((r.doc_id, *x) for r, x in zip(rows, brute([r.text for r in rows]), strict=True))


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n))
    h = PerfectHash.build(keys)
    again = PerfectHash(h.sizes, h.words, h.keys)
    assert sorted(again.find(keys).tolist()) == list(range(len(keys)))
    assert (again.find(keys + 1)[~np.isin(keys + 1, keys)] == -1).all()
    if n > 1:
        with pytest.raises(ValueError):
            PerfectHash.build(np.concatenate([keys[:1], keys]))

"""Token ids of whole texts by a public tokenizer file, with a memory of words already encoded.

The tokenizer drops white space and no token crosses it, so a text's ids are those of its words in turn, and each
word is encoded once by each worker.  Words of letters alone are one piece each, which goes straight to the
tokenizer's model; signs that end a word are encoded apart from it.  Any other word, and every word that holds an added
token such as ``<|endoftext|>``, goes through the whole tokenizer by itself.
"""

from __future__ import annotations

import os
import unicodedata
from array import array

import numpy as np
import pyarrow as pa

from evflow.llm.text import split_words

#: Words remembered by a worker, at about 170 bytes each; beyond that the memory starts again.
MEMORY_WORDS = 600_000
_TAIL = ".,!?;:"
#: Letters below are old enough for all libraries to agree on them.
_OLD_LETTERS = "԰"
_encoders: dict[str, WordEncoder] = {}


def default_tokenizer() -> str:
    """Path of the public word-level BPE file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of words by ``tokenizers``, add_special_tokens=False."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized or t.content.isalpha() for t in added):
            raise ValueError("added tokens must match by themselves alone")
        pieces = (ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(n)) for n in range(256))
        shown = dict(zip((b for n in range(256) for b in chr(n).encode()), "".join(p[0][0] for p in pieces), strict=False))
        self.letters = {b: c for b, c in shown.items() if b != ord(c)}
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _piece(self, word: str) -> bytes | None:
        """Ids of a word of letters alone, of which those of ASCII are in lower case; none for another word."""
        if not word.isalpha():
            return None
        if word.isascii():
            form = word
        elif max(word) < _OLD_LETTERS and "Σ" not in word and unicodedata.is_normalized("NFC", word) and (form := word.lower()).isalpha():
            form = "".join(self.letters.get(b) or chr(b) for b in form.encode())
        else:
            return None
        return array("I", [t.id for t in self.model.tokenize(form)]).tobytes()

    def encode(self, vocab: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        pieces, words = self.pieces, self.words
        if len(pieces) + len(words) > MEMORY_WORDS:
            pieces.clear()
            words.clear()
        out: list[bytes | None] = []
        alone: dict[str, list[int]] = {}
        tails: dict[str, list[tuple[int, bytes]]] = {}
        for at, word in enumerate(vocab):
            core = word.rstrip(_TAIL)
            size = len(core)
            if core.isascii():
                core = core.lower()
            ids = pieces.get(core)
            if ids is None and (ids := self._piece(core)) is not None:
                pieces[core] = ids
            if ids is None:
                ids = words.get(word)
                if ids is None:
                    alone.setdefault(word, []).append(at)
            elif size < len(word):
                tail = word[size:]
                end = words.get(tail)
                if end is None:
                    tails.setdefault(tail, []).append((at, ids))
                    ids = None
                else:
                    ids += end
            out.append(ids)
        for word, ids in self._whole(alone):
            words[word] = ids
            for at in alone[word]:
                out[at] = ids
        for tail, end in self._whole(tails):
            words[tail] = end
            for at, ids in tails[tail]:
                out[at] = ids + end
        return out

    def _whole(self, words: dict) -> list[tuple[str, bytes]]:
        found = self.tokenizer.encode_batch_fast(list(words), add_special_tokens=False) if words else []
        return [(w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(words, found, strict=True)]


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_bytes(texts: pa.Array, path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers."""
    words = split_words(texts, lower=False)
    coded = pa.array(encoder(path).encode(words.vocab), pa.large_binary()).take(pa.array(words.ids))
    ends = np.frombuffer(coded.buffers()[1], np.int64, len(coded) + 1)[words.offsets] if len(coded) else np.zeros(len(texts) + 1, np.int64)
    raw = memoryview(coded.buffers()[2] or b"")
    return [bytes(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

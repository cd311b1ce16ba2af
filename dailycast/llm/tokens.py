"""Token ids of whole texts with a public tokenizer file (the tokenizers library inside tasks).

The file lower-cases, splits at white space and between letters, digits and
signs, and merges inside these pieces only.  So a text's ids are the ids of its
pieces in turn: each distinct piece of a task is encoded once by the library,
and the texts are put together from the pieces' ids.  Pieces are found by a hash,
and their bytes are compared before known ids are used.  Texts with the characters
``<|`` may hold a special token across pieces and go through the library whole, as
do texts with a piece that shares its hash with another one."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from dailycast.llm import words

#: Id that ends a document.
END = 1
#: Bytes of text worked on at a time, and distinct pieces kept at most in a task's table.
CHUNK, KEPT = 1 << 20, 1 << 19
#: Words of letters only: one piece, so their ids end with exactly one word-end token.
PLAIN = re.compile("[a-zÀ-ÖØ-öø-ÿ]+")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
_LATIN = np.zeros(256, bool)  # second bytes of the Latin-1 letters
_LATIN[[c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]] = True
_MADE: dict[str, "Encoder"] = {}


def vocabulary(path: str | None = None) -> str:
    """The tokenizer file's text; by default the installed public word-end BPE file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoder(text: str) -> "Encoder":
    """One encoder for each Python worker."""
    if text not in _MADE:
        _MADE.clear()
        _MADE[text] = Encoder(text)
    return _MADE[text]


class Encoder:
    def __init__(self, text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.keys, self.slots = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.first, self.ids = np.zeros(1, np.int64), np.empty(0, np.uint32)
        self.raw, self.begins = np.empty(0, np.uint8), np.zeros(1, np.int64)  # the known pieces' bytes

    def _ids(self, texts: list[str], at_once: int = 2048) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for i in range(0, len(texts), at_once)
                for e in self.tokenizer.encode_batch_fast(texts[i:i + at_once], add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Append the ids of new pieces to the table, in their order."""
        plain = [bool(PLAIN.fullmatch(p)) for p in pieces]
        rows = [p for p, x in zip(pieces, plain) if x]
        lines = self._ids([" ".join(rows[i:i + 64]) for i in range(0, len(rows), 64)])
        flat = np.concatenate([np.empty(0, np.uint32), *lines])
        stops = np.flatnonzero(self.ends[flat]) + 1
        if len(stops) != len(rows):
            raise ValueError("the tokenizer file does not end each word with a word-end token")
        other = self._ids([p for p, x in zip(pieces, plain) if not x])
        size = np.empty(len(pieces), np.int64)
        mask = np.asarray(plain, bool)
        size[mask] = np.diff(stops, prepend=0)
        size[~mask] = [len(x) for x in other]
        first = np.cumsum(size)
        ids = np.empty(int(first[-1]) if len(first) else 0, np.uint32)
        of_plain = np.repeat(mask, size)
        ids[of_plain] = flat
        ids[~of_plain] = np.concatenate([np.empty(0, np.uint32), *other])
        self.first = np.concatenate([self.first, self.first[-1] + first])
        self.ids = np.concatenate([self.ids, ids])

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, set[int]]:
        """All texts' ids, where each text's begin, and the texts that must go through the library whole."""
        data, begins = words.joined([t.lower() for t in texts])
        after = np.zeros(len(data), bool)  # the byte before ends a letter or a digit
        after[1:] = _LETTER[data[:-1]]
        after[2:] |= _LATIN[data[1:-1]] & (data[:-2] == 0xC3)
        starts, ends = words.spans(data, after & _SIGN[data])
        distinct, at, which = np.unique(words.hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, distinct)
        place[place == len(self.keys)] = 0
        known = self.keys[place] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        slot = np.empty(len(distinct), np.int64)
        if known.any():
            slot[known] = self.slots[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            slot[new] = len(self.first) - 1 + np.arange(len(new))
            raw = data.tobytes()
            pieces = [raw[s:e] for s, e in zip(starts[at[new]], ends[at[new]])]
            self._learn([p.decode("utf-8", "replace") for p in pieces])
            self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(pieces), np.uint8)])
            self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum([len(p) for p in pieces])])
            keys = np.concatenate([self.keys, distinct[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.slots = keys[order], np.concatenate([self.slots, slot[new]])[order]
        of = slot[which]
        size = (self.first[1:] - self.first[:-1])[of]
        stop = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=stop[1:])
        flat = self.ids[np.repeat(self.first[of] - stop[:-1], size) + np.arange(stop[-1])]
        bounds = np.searchsorted(starts, begins)
        other = np.flatnonzero(~words.same_spans(data, starts, ends, self.raw, self.begins[of], self.begins[of + 1]))
        wrong = set((np.searchsorted(bounds, other, "right") - 1).tolist())  # texts with a piece whose hash another piece has
        if len(self.keys) > KEPT:
            self.forget()
        return flat, stop[bounds], wrong

    def encode(self, texts: list[bytes]):
        """For each text in turn its ids (unsigned 32-bit, without the end id)."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
                size += len(texts[j])
                j += 1
            whole = {k for k in range(i, j) if b"<|" in texts[k]}
            flat, stop, wrong = self._encode([b"" if k in whole else texts[k] for k in range(i, j)])
            whole |= {i + k for k in wrong}
            for k in range(i, j):
                if k in whole:
                    yield self._ids([texts[k].decode("utf-8", "replace")])[0]
                else:
                    yield flat[stop[k - i]:stop[k - i + 1]]
            i = j


def ids_of(batch: pa.RecordBatch, encoder: Encoder, rows: int = 512) -> Iterator[tuple[list, list[np.ndarray]]]:
    """A batch (id, text) in short pieces: document ids, and each one's token ids with the end id."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part.column(0).to_pylist(), [np.append(x, np.uint32(END)) for x in encoder.encode(words.texts_of(part.column(1)))]
    words.give_back()

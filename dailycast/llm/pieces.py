"""SentencePiece encoding and decoding of whole texts (operator 13).

A merge-type (BPE) model joins the best adjacent pair of a text again and again.
The same ids come from left to right by backtracking:

1. Aho-Corasick gives the longest piece that begins at each place.
2. A piece follows another one only if merging the two pieces' text anew gives
   just these two; a sequence all of whose neighbours fit is the merged one.
3. Where a piece does not fit, the next shorter piece that begins like it is
   tried; where none is left, the place is marked in a bitfield of failed
   positions and the piece before it is taken back.  Only one sequence of fitting
   pieces can end at a place, so a marked place never has to be tried again.

No piece can span two neighbouring bytes that stand together in no piece (a
letter and a full stop, a letter and the space before the next word).  A text falls
apart there into units that are encoded on their own: a task encodes each distinct
unit once, finds it again by a hash, and compares its bytes before its ids are used.
Signs that are no piece become byte pieces.  Nothing is shuffled: documents are
encoded where they lie."""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailycast.llm import common, words

SPACE = "▁"
#: Fixed values of the model format: kinds of pieces, and the kind of model.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2
#: Remembered units and pairs at most, bytes of text worked on at a time, rows of an output batch.
KEPT, PAIRS, CHUNK, ROWS = 1 << 20, 1 << 19, 2 << 20, 512
_MADE: dict[bytes, "Pieces"] = {}


def model_bytes(path: str | None = None) -> bytes:
    """The model file; by default the installed public one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def pieces(model: bytes) -> "Pieces":
    """One table for each Python worker."""
    if model not in _MADE:
        _MADE.clear()
        _MADE[model] = Pieces(model)
    return _MADE[model]


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol-buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at:at + size]
            at += size


class Pieces:
    """Exact encoder and decoder of a merge-type model with byte pieces.

    Models with user-defined or unused pieces, of another type, without byte
    pieces, or with pieces that hold a space sign inside raise ``ValueError``."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.text: list[str] = []
        self.kind: list[int] = []
        self.score: list[float] = []
        trainer: dict[int, int | bytes] = {}
        normal: dict[int, int | bytes] = {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.text.append(piece.get(1, b"").decode())
                self.score.append(float(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0]))
                self.kind.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        self.id = {t: i for i, t in enumerate(self.text) if self.kind[i] == NORMAL}
        signs = {c for t in self.id for c in t}
        if (not signs or trainer.get(3, 1) != MERGES or not trainer.get(35, 0) or {USER_DEFINED, UNUSED} & set(self.kind)
                or any(SPACE in t.lstrip(SPACE) for t in self.id) or not signs <= set(self.id)):
            raise ValueError("not a merge-type model with byte pieces, without user-defined and unused ones")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        #: Without a table of replaced signs a text is only marked with space signs; other models use the library's rules.
        self.plain = not normal.get(2) and normal.get(3, 1) == 1 and normal.get(4, 1) == 0 and normal.get(5, 1) == 1
        self.end = self.library.eos_id()
        self.byte = {int(self.text[i][3:5], 16): i for i, k in enumerate(self.kind) if k == BYTE}
        self.of_byte = {i: b for b, i in self.byte.items()}
        # fixed value: the text of an unknown piece
        self.shown = [t if k == NORMAL else " ⁇ " if k == UNKNOWN else "" for t, k in zip(self.text, self.kind)]
        for b, i in self.byte.items():
            if b < 0x80:
                self.shown[i] = chr(b)  # a sign by itself, whatever bytes are beside it
        self.odd = {i for i, k in enumerate(self.kind) if k == UNKNOWN or k == BYTE and self.of_byte[i] >= 0x80}
        self.unknown = re.compile("[^" + "".join(map(re.escape, sorted(signs))) + "]")
        self.units = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self._learn()

    def merge(self, text: str) -> list[int]:
        """Plain merging: the pair with the best score first, the leftmost of equal ones."""
        parts, best = list(text), 0
        while best is not None:
            best, top = None, 0.0
            for i in range(len(parts) - 1):
                j = self.id.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or self.score[j] > top):
                    best, top = i, self.score[j]
            if best is not None:
                parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return [self.id[p] for p in parts]

    def _learn(self) -> None:
        import ahocorasick

        self.size = [len(t) for t in self.text]
        reached = {t: i for t, i in self.id.items() if self.merge(t) == [i]}  # others no merge can give
        self.shorter = [-1] * len(self.text)
        self.matcher = ahocorasick.Automaton()
        for t, i in reached.items():
            self.matcher.add_word(t, i)
            self.shorter[i] = next((reached[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in reached), -1)
        self.matcher.make_automaton()
        self.pairs: dict[int, bool] = {}
        #: Bytes that stand together in a piece (a space for the space sign), or in one sign.
        self.inside = np.zeros(1 << 16, bool)
        for t in reached:
            raw = np.frombuffer(t.replace(SPACE, " ").encode(), np.uint8).astype(np.int64)
            self.inside[raw[:-1] << 8 | raw[1:]] = True
        self.inside.reshape(256, 256)[:, 0x80:0xC0] = True
        self.forget()

    def forget(self) -> None:
        self.keys, self.slots = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.first, self.ids = np.zeros(1, np.int64), np.empty(0, np.int32)
        self.raw, self.begins = np.empty(0, np.uint8), np.zeros(1, np.int64)  # the known units' bytes

    def fits(self, a: int, b: int) -> bool:
        """Whether piece ``b`` may follow piece ``a``."""
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merge(self.text[a] + self.text[b]) == [a, b]
        return found

    def _run(self, text: str) -> list[int]:
        """Ids of a text all of whose signs are pieces."""
        n, size = len(text), self.size
        longest = array("i", [-1]) * n
        for last, i in self.matcher.iter(text):  # at each place the longer matches come later
            longest[last + 1 - size[i]] = i
        failed = bytearray(n // 8 + 1)
        out: list[int] = []
        at, piece = 0, longest[0]
        while True:
            after = at + size[piece]
            if not failed[after >> 3] >> (after & 7) & 1 and (not out or self.fits(out[-1], piece)):
                out.append(piece)
                at = after
                if at == n:
                    return out
                piece = longest[at]
            elif self.shorter[piece] >= 0:
                piece = self.shorter[piece]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= size[piece]

    def _unit(self, unit: str) -> list[int]:
        out: list[int] = []
        at = 0
        for odd in self.unknown.finditer(unit):
            if odd.start() > at:
                out += self._run(unit[at:odd.start()])
            out += [self.byte[b] for b in odd[0].encode("utf-8", "replace")]
            at = odd.end()
        return out + self._run(unit[at:]) if at < len(unit) else out

    def encode(self, text: str) -> list[int]:
        """The text's ids without begin and end ids."""
        if self.plain:
            text = text and SPACE + text.replace(" ", SPACE)
        else:
            text = self.library.normalize(text)
        return [i for unit in self.units.findall(text) for i in self._unit(unit)]

    def _learn_units(self, units: list[bytes]) -> None:
        """Append the ids of new units to the table, in their order."""
        found = [self._unit(u.decode().replace(" ", SPACE)) for u in units]
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.int32)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum([len(x) for x in found])])
        self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(units), np.uint8)])
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum([len(u) for u in units])])

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """Each text's ids with the end id; ``texts`` in UTF-8 (other bytes count as replacement signs)."""
        if not self.plain:
            return [np.array([*self.encode(t.decode("utf-8", "replace")), self.end], np.int32) for t in texts]
        marked = []
        for t in texts:
            try:
                t.decode()
            except UnicodeDecodeError:
                t = t.decode("utf-8", "replace").encode()
            marked.append(b" " + t.replace(SPACE.encode(), b" ") if t else t)
        data = np.frombuffer(b"".join(marked), np.uint8)
        begins = np.concatenate([[0], np.cumsum([len(t) for t in marked])])
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = ~self.inside[data[:-1].astype(np.int32) << 8 | data[1:]]
        cut[begins] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        distinct, at, which = np.unique(words.hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        if len(self.keys):
            known = self.keys[np.minimum(place, len(self.keys) - 1)] == distinct
        slot = np.empty(len(distinct), np.int64)
        slot[known] = self.slots[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            slot[new] = len(self.first) - 1 + np.arange(len(new))
            raw = data.tobytes()
            self._learn_units([raw[s:e] for s, e in zip(starts[at[new]], ends[at[new]])])
            self.keys = np.insert(self.keys, place[new], distinct[new])
            self.slots = np.insert(self.slots, place[new], slot[new])
        of = slot[which]
        size = (self.first[1:] - self.first[:-1])[of]
        stop = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=stop[1:])
        flat = self.ids[np.repeat(self.first[of] - stop[:-1], size) + np.arange(stop[-1])]
        bounds = np.searchsorted(starts, begins)
        other = np.flatnonzero(~words.same_spans(data, starts, ends, self.raw, self.begins[of], self.begins[of + 1]))
        wrong = set((np.searchsorted(bounds, other, "right") - 1).tolist())  # texts with a unit whose hash another unit has
        if len(self.keys) > KEPT:
            self.forget()
        out = []
        for k, t in enumerate(marked):
            ids = self.encode(texts[k].decode("utf-8", "replace")) if k in wrong else flat[stop[bounds[k]]:stop[bounds[k + 1]]]
            out.append(np.append(np.asarray(ids, np.int32), np.int32(self.end)))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: control ids give nothing, bytes that are not UTF-8 a replacement sign each."""
        if not self.plain:
            return self.library.decode(ids)
        if self.odd.isdisjoint(ids):
            text = "".join([self.shown[i] for i in ids])
            return text.removeprefix(SPACE).replace(SPACE, " ")
        out: list[str] = []
        run, first = bytearray(), True  # first: nothing was shown yet, and no space sign taken off
        for i in ids:
            if i in self.of_byte:
                run.append(self.of_byte[i])
                continue
            if run:
                out.append(run.decode("utf-8", "byte_by_byte"))
                run, first = bytearray(), False
            part = self.shown[i]
            if first and part:
                part, first = part.removeprefix(SPACE), False
            out.append(part.replace(SPACE, " "))
        return "".join(out) + run.decode("utf-8", "byte_by_byte")


codecs.register_error("byte_by_byte", lambda error: ("\ufffd", error.start + 1))


def encode(docs: DataFrame, model_path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids: every whole text's ids and the end id.

    A NULL text counts as empty (the end id alone); a NULL id stays NULL; repeated
    rows give a row each; an empty table gives none; other columns are not read;
    bytes that are not UTF-8 count as replacement signs."""
    common.python_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(model_path))  # one file, 0.5 MB

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(shared.value)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                first, size, texts = at, 0, []
                while at < batch.num_rows and at - first < ROWS and size < CHUNK:
                    texts.append(batch.column(1)[at].as_py() or b"")
                    size, at = size + len(texts[-1]), at + 1
                found = table.encode_all(texts)
                ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                ids = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, at - first), ids], ["doc_id", "ids"])
            words.give_back()

    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").cast("binary").alias("text"))
    return picked.mapInArrow(work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``text``, the decoded ids; NULL and empty ids give an empty text."""
    common.python_ready(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(model_bytes(model_path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lists = [table.decode(x.values.to_numpy().tolist() if x.is_valid else []) for x in part.column(1)]
                text = pa.array(lists, pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), text], ["doc_id", "ids", "text"])
            words.give_back()

    picked = encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    return picked.mapInArrow(work, "doc_id long, ids array<int>, text string")


def piece_digests(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """Per document: number of ids, and digests of the ids (decimal, one space between) and of the decoded text.

    See :func:`encode` for odd inputs."""
    rows = decode(encode(docs, model_path), model_path)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
                       F.sha2(F.col("text"), 256).alias("decoded_sha256"))

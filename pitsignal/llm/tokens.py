"""Token ids by the tokenizers library, with the ids of frequent chunks remembered."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

REMEMBERED = 700_000  # chunks kept per worker; the others are encoded once per batch
JOINED = 200
BATCH_CHARS = 8_000_000

# white space other than U+0020 and U+0009..U+000D, which chunk borders do not know, the chunk sign, the mark's opening
_ODD = ("<|", *"\0\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))
# white space beside white space: then chunks are not simply what is between spaces and line ends
_RUNS = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c")
_CHUNK = re.compile(r"\s*\S+|\s+")


class ChunkEncoder:
    """Encodes texts exactly like `Tokenizer.encode(text, add_special_tokens=False).ids`.

    Both vocabularies cut a text before white space that follows a visible character, whatever
    stands around it. A text is therefore the concatenation of such chunks, and a chunk seen before
    need not be encoded again. Arrow cuts the texts of a batch, numbers its different chunks and puts
    their ids in place, so that only different chunks are Python strings. New chunks of a batch are encoded together, separated by `mark`, an
    added token that always splits a text, or as running text where the ids show the borders. Texts with the mark's opening or with other white space
    are encoded whole. Ids are unsigned 16-bit integers.
    """

    def __init__(self, path: str, mark: str = "<|endoftext|>", *, spaces_count: bool = True, remembered: int = REMEMBERED) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._mark, self._mark_id = mark, self._tokenizer.token_to_id(mark)
        self._spaces_count = spaces_count
        # In running text, a chunk that is one word: where spaces count, its first id is the only one that
        # starts with its space or line end. Else, Latin letters and a full stop or comma: the last id of
        # the letters and that of the stop are the only ones that end a word.
        self._plain = re.compile("\n?[^\\s\\x00]+" if spaces_count else "[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?").fullmatch
        self._edge = np.zeros(1 << 16, dtype=bool)
        for token, i in self._tokenizer.get_vocab().items():
            self._edge[i] = token.startswith(("Ġ", "Ċ")) if spaces_count else token.endswith("</w>")
        self._known: dict[str, bytes] = {}
        self._remembered = remembered

    def _whole(self, texts: Sequence[str]) -> list[bytes]:
        return [array("H", e.ids).tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _simple(self, text: str) -> bool:
        """Whether the chunks of a text are what is between single spaces and before line ends."""
        return text[0] not in " \n" and text[-1] != " " and not any(map(text.__contains__, _RUNS))

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, pa.Array]:
        """Where the chunks of each text begin, and end those of the last, and all chunks in a row.

        Where spaces count, a chunk is written without its leading space; one that has none starts with
        a line end or, in any other case, with the sign "\\0". Else there may be empty chunks.
        """
        if not self._spaces_count:
            cut = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        elif all(map(self._simple, texts)):
            cut = pc.split_pattern(pa.array(["\0" + t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
        else:
            each = ([c[1:] if c[0] == " " and c[1:2] != "\n" else "\0" + c for c in _CHUNK.findall(t)] for t in texts)
            cut = pa.array(each, pa.list_(pa.large_string()))
        return cut.offsets.to_numpy(), cut.values

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Little-endian 16-bit ids of each text; null is empty."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and size < BATCH_CHARS:
                size += len(texts[upto] or "")
                upto += 1
            out += self._batch(texts[at:upto])
            at = upto
        return out

    def _batch(self, texts: Sequence[str | None]) -> list[bytes]:
        out = [b""] * len(texts)
        kinds: dict[str, list[int]] = {"simple": [], "spaced": [], "odd": []}
        for i, text in enumerate(texts):
            if text:
                odd = any(map(text.__contains__, _ODD))
                kinds["odd" if odd else "simple" if not self._spaces_count or self._simple(text) else "spaced"].append(i)
        for i in kinds["odd"]:
            out[i] = self._whole([texts[i]])[0]
        for group in (kinds["simple"], kinds["spaced"]):
            if group:
                for i, ids in zip(group, self._chunked([texts[i] for i in group])):
                    out[i] = ids
        return out

    def _chunked(self, texts: list[str]) -> list[bytes]:
        known = self._known
        begins, chunks = self._cut(texts)
        numbered = chunks.dictionary_encode()
        words = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        parts = list(map(known.get, words))
        new = [w for w, ids in zip(words, parts) if ids is None and (w or self._spaces_count)]
        plain = [c for c in new if self._plain(c)]
        fresh = self._encode_new(plain, self._between_plain)
        fresh.update(self._encode_new([c for c in new if c not in fresh], self._between_marks))
        if len(known) < self._remembered:
            known.update(fresh)
        parts = [fresh.get(w, b"") if ids is None else ids for w, ids in zip(words, parts)]
        placed = pa.array(parts, pa.large_binary()).take(numbered.indices)
        ends = np.frombuffer(placed.buffers()[1], dtype=np.int64)[begins].tolist()
        data = memoryview(placed.buffers()[2])
        return [bytes(data[a:b]) for a, b in zip(ends, ends[1:])]

    def _encode_new(self, chunks: list[str], together: Callable[[list[str]], tuple[bytes, list[int]]]) -> dict[str, bytes]:
        fresh: dict[str, bytes] = {}
        for at in range(0, len(chunks), JOINED):
            part = chunks[at : at + JOINED]
            ids, bounds = together([c[1:] if c[:1] == "\0" else c if c[:1] == "\n" else " " + c for c in part] if self._spaces_count else part)
            for chunk, begin, end in zip(part, bounds, bounds[1:]):
                fresh[chunk] = ids[begin:end]
        return fresh

    def _between_marks(self, chunks: list[str]) -> tuple[bytes, list[int]]:
        """Ids of any chunks, a mark before each of them, and where in the bytes each begins, and ends the last."""
        ids = np.frombuffer(self._whole([self._mark + self._mark.join(chunks)])[0], dtype="<u2")
        marks = np.flatnonzero(ids == self._mark_id)
        bounds = (marks - np.arange(len(marks))) * 2
        return ids[ids != self._mark_id].tobytes(), [*bounds.tolist(), 2 * (len(ids) - len(marks))]

    def _between_plain(self, chunks: list[str]) -> tuple[bytes, list[int]]:
        """The same for words of letters, as one running text: ids tell by themselves where a word begins or ends."""
        ids = self._whole([("" if self._spaces_count else " ").join(chunks)])[0]
        edges = np.flatnonzero(self._edge[np.frombuffer(ids, dtype="<u2")]) * 2
        if self._spaces_count:
            bounds = [*edges.tolist(), len(ids)]
        else:
            pieces = np.cumsum([1 + (c[-1] in ".,") for c in chunks]) - 1
            bounds = [0, *(edges[pieces] + 2).tolist()]
        assert len(bounds) == len(chunks) + 1 and bounds[-1] == len(ids)
        return ids, bounds


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, *, spaces_count: bool, remembered: int = REMEMBERED) -> ChunkEncoder:
    """One encoder per worker process and vocabulary."""
    key = (path, spaces_count)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, spaces_count=spaces_count, remembered=remembered)
    return _ENCODERS[key]

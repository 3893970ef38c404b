"""Tokenizing whole texts inside Spark tasks.

The public ``word_bpe_49k`` tokenizer lower-cases, drops white space and never
lets a token cross a space, so a text's ids are the ids of its chunks between
spaces and line ends, one after the other. Arrow splits a batch of texts into
chunks and numbers the distinct ones; only these are looked at. Chunks of
plain letters and signs are split into the tokenizer's pieces, all by one
search, and each Python worker keeps the ids of the pieces it has met in a
bounded table. All other chunks, and those that hold an added token
(``<|endoftext|>``), go to the library as they are. The ids of the texts are
gathered from the chunks' ids. ``tests/llm`` compares the result with encoding
the whole text by the library as loaded.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 1
#: Entries of a worker's table of pieces and ids held for them; a full table is emptied, which costs time only.
PIECE_ENTRIES, HELD_IDS = 800_000, 8_000_000
#: Bytes of texts handled at once; longer texts are cut into segments of about so many characters.
BATCH_BYTES, SEGMENT_CHARS = 16 << 20, 4 << 20
# The tokenizer's split pattern, restricted to printable ASCII and the Latin letters U+00C0..U+017F after lower-casing.
_PIECES = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\sa-z0-9ß-öø-ſ]+")
#: Chunks of these characters are in normal form, lower-case letter by letter, and hold no white space.
_PLAIN = r"^[!-~\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{17f}]+$"


def default_vocabulary() -> str:
    """Path of the default vocabulary file on the machine that runs the task."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_names() -> list[str]:
    """The characters that stand for the bytes in byte-level vocabularies: printable Latin-1 for itself, the others in turn from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def _gather(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``flat[start : start + n]`` of all entries, one after the other."""
    ends = np.cumsum(n)
    return flat[np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class _Pieces(dict):
    """piece -> number; the piece's ids stand in ``flat`` from ``first[number]`` on. Number 0 is the line end, without ids."""

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.names = _byte_names()
        self.empty()

    def empty(self) -> None:
        self.clear()
        self["\n"] = 0
        self.flat, self.first = array("i"), array("q", [0, 0])

    def __missing__(self, piece: str) -> int:
        named = piece if piece.isascii() else "".join([self.names[b] for b in piece.encode()])
        self.flat.extend([t.id for t in self.tokenizer.model.tokenize(named)])
        self.first.append(len(self.flat))
        self[piece] = n = len(self.first) - 2
        return n

    def _plain(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain chunks, one after the other, and how many each has."""
        if not len(chunks):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks), "\n")[0].as_py()
        items = _PIECES.findall(joined.lower())
        number = np.fromiter(map(self.__getitem__, items), np.int64, len(items))
        first = np.frombuffer(self.first, np.int64)
        n = first[number + 1] - first[number]
        ids = _gather(np.frombuffer(self.flat, np.int32), first[number], n)
        return ids, np.add.reduceat(n, np.concatenate(([0], np.flatnonzero(number == 0))))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts (none null), one after the other, and how many each has."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        chunks = lists.flatten().dictionary_encode()
        distinct = chunks.dictionary.cast(pa.string())
        plain = pc.match_substring_regex(distinct, _PLAIN)
        for token in self.added:
            plain = pc.and_not(plain, pc.match_substring(distinct, token))
        mask = np.asarray(plain.to_numpy(zero_copy_only=False), bool)
        known, n_known = self._plain(distinct.filter(plain))
        others = [e.ids for e in self.tokenizer.encode_batch_fast(distinct.filter(pc.invert(plain)).to_pylist(), add_special_tokens=False)]
        flat = np.concatenate([known, *(np.array(o, np.int32) for o in others)])
        n = np.zeros(len(distinct), np.int64)
        n[mask], n[~mask] = n_known, [len(o) for o in others]
        start = np.zeros(len(distinct), np.int64)
        start[mask] = np.cumsum(n[mask]) - n[mask]
        start[~mask] = len(known) + np.cumsum(n[~mask]) - n[~mask]
        at = chunks.indices.to_numpy()
        ids = _gather(flat, start[at], n[at])
        # every text has a chunk, if only an empty one
        sizes = np.add.reduceat(n[at], np.cumsum(np.concatenate(([0], np.asarray(lists.value_lengths())[:-1])))) if len(texts) else np.zeros(0, np.int64)
        if len(self) > PIECE_ENTRIES or len(self.flat) > HELD_IDS:
            self.empty()
        return ids, sizes


@lru_cache(maxsize=2)
def _pieces(path: str) -> _Pieces:
    return _Pieces(path)


def segments(text: str) -> Iterator[str]:
    """The text in parts of about SEGMENT_CHARS, cut only at spaces."""
    at = 0
    while len(text) - at > SEGMENT_CHARS:
        cut = text.find(" ", at + SEGMENT_CHARS)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def encode(text: str | None, path: str) -> np.ndarray:
    """The ids of a whole text (null: none) with the end id appended, as little-endian unsigned 32-bit integers."""
    table = _pieces(path)
    return np.concatenate([*(table.ids(pa.array([part]))[0] for part in segments(text or "")), [END_ID]]).astype("<u4")


def encode_all(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """``encode`` of every text of an Arrow column, in order; about BATCH_BYTES of texts at once."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(texts):
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), BATCH_BYTES, side="right")))
        if end == at + 1:
            yield encode(texts[at].as_py(), path)
        else:
            ids, n = _pieces(path).ids(pc.fill_null(texts.slice(at, end - at), ""))
            ends = np.cumsum(n)
            ids = np.insert(ids, ends, END_ID).astype("<u4")
            for k, e in enumerate(ends.tolist()):
                yield ids[e - int(n[k]) + k : e + k + 1]
        at = end

"""Token ids of whole texts, with the tokenizers library."""

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ID = np.dtype("<u4")

#: Fixed: the character that stands for each byte in a byte-level vocabulary. Printable bytes stand for themselves.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: b for b in _PRINTABLE} | {
    b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))
}
_BLANK = chr(_BYTE_CHARS[32])
#: Letters up to here are the same in every version of Unicode.
_LATIN_END = "\u0250"


#: ASCII marks of which a run after a letter is cut off and kept whole by every tokenizer in use. The apostrophe is not one: it
#: begins contractions.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~"
#: A word of Latin letters; not the one that folds to a letter and a mark.
_WORD = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+$"


class _Marks(dict):
    """Ids (as bytes) of a run of marks, or of a line feed, after a letter."""

    #: Runs can be of any length; more of them than this are not remembered.
    MOST = 10_000

    def __init__(self, encoder: "TextEncoder"):
        super().__init__({"": b""})
        self.encoder = encoder

    def __missing__(self, marks: str) -> bytes:
        ids = self.encoder.whole("a" + marks)[len(self.encoder.whole("a")) :]
        if len(self) < self.MOST:
            self[marks] = ids
        return ids


class _Pieces(dict):
    """Ids (as bytes) of a piece after ``blank``, made when asked for; None if it can't be cut out of its text."""

    def __init__(self, encoder: "TextEncoder", blank: str):
        super().__init__()
        self.encoder, self.blank = encoder, blank
        self.older: dict[str, bytes | None] = {}
        self.marks = _Marks(encoder)

    def __missing__(self, piece: str) -> bytes | None:
        if piece in self.older:
            ids = self.older[piece]
        elif (word := self.encoder.word(piece, self.blank)) is not None:
            ids = word
        elif not piece or piece[0].isspace() or piece[-1].isspace() or self.encoder.has_special(piece):
            ids = None
        elif piece[-1] in _MARKS and self.encoder.ends_in_letter(head := piece.rstrip(_MARKS)):
            ids = self._joined(self[head], piece[len(head) :], b"")
        elif piece.count("\n") == 1:
            head, tail = piece.split("\n")
            ids = self._joined(self[head], "\n", self.encoder.starts[tail])
        else:
            ids = self.encoder.whole(self.blank + piece)
        self[piece] = ids
        return ids

    def _joined(self, head: bytes | None, mark: str, tail: bytes | None) -> bytes | None:
        return None if head is None or tail is None else head + self.marks[mark] + tail

    def forget(self) -> None:
        """Drop what has not been asked for since the last time."""
        self.older = dict(self)
        self.clear()


class TextEncoder:
    """Ids of texts under one tokenizer file, as little-endian unsigned 32-bit integers.

    The tokenizers in use never merge across a blank or a line feed that stands alone between two other characters, nor
    across the end of a run of letters. So texts are split at their blanks, marks behind Latin words are cut off, and the ids
    of each different piece are looked up, once for all texts of a call. Of a piece not seen yet, a Latin word goes straight to
    the library's BPE model, other marks at its end or a line feed are taken off, and anything else goes through the library's
    whole pipeline. A text with other white space beside a blank does so in one go.
    """

    #: When so many pieces are remembered, those not asked for since the last time are forgotten.
    MAX_PIECES = 200_000

    def __init__(self, path: str, max_pieces: int | None = None):
        from tokenizers import Tokenizer

        self.max_pieces = max_pieces or self.MAX_PIECES
        # so much text at a time that its different words are not more than may be remembered
        self.slice_bytes = min(4 << 20, 24 * self.max_pieces)
        self.tokenizer = Tokenizer.from_file(path)
        # texts that hold the string of a special token go through the library whole
        self.specials = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a character that is in all of them, and has no case: most pieces are without it
        self.in_specials = next((c for c in min(self.specials, default="") if not c.isalpha() and all(c in s for s in self.specials)), "")
        self.tokenize = self.tokenizer.model.tokenize
        # one kind keeps case and marks the blank before a word, the other folds case and marks the end of a word
        self.folds = self.tokenizer.normalizer is not None
        self.pieces = _Pieces(self, " ")
        self.starts = self.pieces if self.folds else _Pieces(self, "")
        for word in ("a", "The", "Straße", "déjà"):
            if self.word(word, " ") != self.whole(" " + word) or self.word(word, "") != self.whole(word):
                raise ValueError(f"words are cut in another way by {path}")

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def word(self, piece: str, blank: str) -> bytes | None:
        """Ids of Latin letters after ``blank``; None if it is something else."""
        if not piece.isalpha():
            return None
        if self.folds:
            piece, blank = piece.lower(), ""
        if not piece.isascii():
            if not piece.isalpha() or max(piece) >= _LATIN_END:
                return None
            piece = piece.encode().decode("latin-1").translate(_BYTE_CHARS)
        return array("I", [t.id for t in self.tokenize(_BLANK + piece if blank else piece)]).tobytes()

    def ends_in_letter(self, head: str) -> bool:
        """Whether the last character that the tokenizer sees of ``head`` is a Latin letter; folding may add a mark to it."""
        last = (head.lower() if self.folds else head)[-1:]
        return last.isalpha() and last < _LATIN_END

    def has_special(self, piece: str) -> bool:
        if self.in_specials not in piece:
            return False
        low = piece.lower()
        return any(s in low for s in self.specials)

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Arrow splits the texts and puts the ids of their pieces together; here each different piece is looked up once."""
        texts = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return []
        lists = pc.split_pattern(texts, " ")
        bounds = lists.offsets.to_numpy()
        firsts = lists.flatten().take(pa.array(bounds[:-1]))
        places = lists.flatten().dictionary_encode()
        codes, pieces = places.indices.to_numpy(), places.dictionary
        if self.starts is not self.pieces:
            # a text's first piece, which has no blank before it, gets a code of its own
            codes = codes.copy()
            codes[bounds[:-1]] = len(pieces) + np.arange(len(texts))
            used = np.zeros(len(pieces) + len(texts), bool)
            used[codes] = True
            ids, lost = self._ids(pieces, used)
            others = [self.starts[p] for p in firsts.to_pylist()]
            ids = pa.concat_arrays([ids, pa.array([i or b"" for i in others], pa.large_binary())])
            lost = np.append(lost, [i is None for i in others])
        else:
            ids, lost = self._ids(pieces, np.ones(len(pieces), bool))
        ends, data = _bytes(ids.take(pa.array(codes)))
        ends = ends[bounds].tolist()
        out = [bytes(data[a:b]) for a, b in zip(ends, ends[1:])]
        if lost.any():
            for i in np.flatnonzero(np.logical_or.reduceat(lost[codes], bounds[:-1])).tolist():
                out[i] = self.whole(texts[i].as_py())
        for remembered in (self.pieces, self.starts):
            if len(remembered) > self.max_pieces:
                remembered.forget()
        return out

    def _ids(self, pieces: pa.Array, used: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Ids of each of the different ``pieces``, and where there are none. Marks after a word are not remembered with it."""
        heads = pc.ascii_rtrim(pieces, characters=_MARKS)
        words = pc.match_substring_regex(heads, _WORD).to_numpy(zero_copy_only=False)
        if self.specials:
            words &= ~pc.match_substring(pieces, self.in_specials).to_numpy(zero_copy_only=False)
        # each piece as a head and its marks, side by side over the same bytes
        ends, data = _bytes(pieces)
        cuts = np.repeat(ends, 2)[1:]
        cuts[1::2] = np.where(words, ends[:-1] + pc.binary_length(heads).to_numpy(), ends[1:])
        parts = pa.StringArray.from_buffers(2 * len(pieces), pa.py_buffer(cuts), pa.py_buffer(data)).dictionary_encode()
        codes, n = parts.indices.to_numpy().reshape(-1, 2), len(parts.dictionary)
        asked = np.zeros((2, n), bool)
        asked[0, codes[used[: len(pieces)], 0]] = True
        asked[1, codes[:, 1]] = True
        texts = _strings(parts.dictionary)
        heads = [self.pieces[p] if a else b"" for p, a in zip(texts, asked[0].tolist())]
        marks = [self.pieces.marks[texts[i]] for i in np.flatnonzero(asked[1]).tolist()]
        codes = np.column_stack([codes[:, 0], n + np.cumsum(asked[1])[codes[:, 1]] - 1])
        table = pa.array(heads + marks, pa.large_binary())
        ends, data = _bytes(table.take(pa.array(codes.ravel())))
        joined = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(ends[::2].copy()), pa.py_buffer(data)])
        return joined, table.is_null().to_numpy(zero_copy_only=False)[codes[:, 0]]


@lru_cache(maxsize=4)
def text_encoder(path: str, max_pieces: int | None = None) -> TextEncoder:
    """One for each Python worker; it lives on from task to task."""
    return TextEncoder(path, max_pieces)


def _bytes(array: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Where the values of an Arrow array of strings or bytes end (and the first begins), and the bytes themselves."""
    kind = np.int64 if array.type in (pa.large_string(), pa.large_binary()) else np.int32
    _, ends, data = array.buffers()
    ends = np.frombuffer(ends, kind)[array.offset : array.offset + len(array) + 1]
    return ends, memoryview(data or b"")


def _strings(pieces: pa.Array) -> list[str]:
    """``pieces`` as a list. None of them holds a blank; one string cut at its blanks is made faster than they are one by one."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(pieces)], pieces), " ")[0].as_py().split(" ")


def text_slices(batch: pa.RecordBatch, size: int) -> Iterator[tuple[list, pa.Array]]:
    """The first column of an Arrow batch as a list, and its second one, texts; about ``size`` bytes of text at a time."""
    numbers, texts = batch.columns
    before = np.cumsum(np.append(0, pc.binary_length(texts).to_numpy())[:-1])
    starts = np.unique(before // size, return_index=True)[1].tolist()
    for start, end in zip(starts, [*starts[1:], batch.num_rows]):
        yield numbers.slice(start, end - start).to_pylist(), texts.slice(start, end - start)

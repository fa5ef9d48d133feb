"""Encoding with the tokenizers library, fast enough for a corpus.

The library spends most of its time on text that it has seen before. A text is cut where no
token can cross (before white space that follows something else), each distinct piece is
encoded once per worker, and a text's ids are the pieces' ids in order. The ids are those of
encoding the whole text, since both kinds of vocabulary split there before they merge anything.
Many texts are cut at once, at spaces and line ends, by Arrow's kernels, which also find the
distinct pieces; ids are gathered by numpy. A text that this would cut elsewhere is cut by itself.
A piece of Latin letters is split further by the vocabulary's own pattern, and the library's
model encodes each distinct part; any other piece goes through the whole library. A text that
holds the string of a special token goes to the library whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import string
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: White space as the vocabularies' own patterns define it (Unicode White_Space).
SPACE = "\t-\r \x85\xa0  -     　"
_PIECES = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: White space that a piece can end with, and classes of a piece's last byte (a byte 0 opens a text).
_ENDS = frozenset(chr(x).encode() for x in range(0x3001) if re.fullmatch(f"[{SPACE}]", chr(x)))
_BYTE_SPACE = np.array([bytes([x]) in _ENDS for x in range(256)])
_BYTE_SOLID = np.array([x == 0 or bytes([x]).isalnum() for x in range(256)])
#: The pattern of byte-level vocabularies that name none.
PARTS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Below this character, normal forms and letter classes are the same in every version of Unicode.
_LATIN = re.compile("[\x00-ɏ]*")
#: Pieces that a worker remembers: two halves, the older one goes when the newer one is full. As many parts.
CACHE_PIECES = 300_000
#: Longer pieces are rare and are encoded without being remembered.
LONGEST_CACHED = 64

_ENCODERS: dict[str, CachedEncoder] = {}


def read_vocabulary(path: str) -> str:
    """The tokenizer file's text, read on the driver; a few MB, sent to the workers as a broadcast."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and number the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(x): x for x in plain}
    letters |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in set(plain))}
    return letters


class _Memory(dict):
    """Pieces to ids; a piece that is not there is looked up among the older ones, then learned."""

    def __init__(self, learn, older: dict):
        super().__init__()
        self.learn, self.older = learn, older

    def __missing__(self, piece):
        ids = self.older.get(piece)
        if ids is None:
            ids = self.learn(piece)
        if len(piece) <= LONGEST_CACHED:
            self[piece] = ids
        return ids


class CachedEncoder:
    """Text to ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: str, pieces: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        settings = json.loads(vocabulary)
        self.special = [x["content"].encode() for x in settings.get("added_tokens") or []]
        before, normal = settings.get("pre_tokenizer") or {}, settings.get("normalizer") or {}
        steps, forms = before.get("pretokenizers") or [before], [x.get("type") for x in normal.get("normalizers") or ([normal] if normal else [])]
        # where the pattern leaves white space out, any of it parts the words
        self.words_only = (settings.get("model") or {}).get("end_of_word_suffix") is not None
        self.lower = "Lowercase" in forms
        if [s.get("type") for s in steps] == ["Split", "ByteLevel"] and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and self.words_only:
            self.parts = regex.compile(steps[0]["pattern"]["Regex"])
        elif [s.get("type") for s in steps] == ["ByteLevel"] and steps[0].get("use_regex", True) and not forms:
            self.parts = regex.compile(PARTS)
        else:
            raise ValueError("neither a byte-level vocabulary nor one of words and byte-level letters")
        if steps[-1].get("add_prefix_space") or not {*forms} <= {"NFC", "Replace", "Lowercase"}:
            raise ValueError("a vocabulary whose texts cannot be cut at white space")
        self.letters = {x: c for c, x in byte_letters().items()}
        self.before_word = "" if self.words_only else self.letters[0x20]
        some = ("" if self.words_only else " ") + string.ascii_lowercase
        self.plain_words = self.words_only == self.lower and self.parts.findall(some) == [some]
        self._remember(pieces)

    def _remember(self, pieces: int) -> None:
        self.half = max(1, pieces // 2)
        self.memory = _Memory(self._learn, {})
        self.known: dict[str, bytes] = {}

    def _ids(self, letters: str) -> bytes:
        return array("I", [x.id for x in self.model.tokenize(letters)]).tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of one pre-token."""
        return self._ids(part.encode().decode("latin-1").translate(self.letters))

    def _text(self, piece: str | bytes) -> str:
        """What a piece stands for; bytes are a name that ``_cut`` gave."""
        if isinstance(piece, str):
            return piece
        if piece[:1] == b"\1" or piece[:1] == b"\0" and not self.words_only:
            return piece[1:].decode()
        return piece.decode() if self.words_only or piece[:1] == b"\n" else " " + piece.decode()

    def _learn(self, piece: str | bytes) -> bytes:
        if self.plain_words and isinstance(piece, bytes) and piece.isalpha():  # ASCII letters after a space: one pre-token
            return self._ids(self.before_word + piece.decode())
        text = self._text(piece)
        if not text.isascii() and not _LATIN.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if self.lower:
            text = text.lower() if text.isascii() else "".join(map(str.lower, text))
        return self._split(text)

    def _split(self, text: str) -> bytes:
        known, out = self.known, []
        for part in self.parts.findall(text):
            ids = known.get(part)
            if ids is None:
                ids = self._part(part)
                if len(part) <= LONGEST_CACHED:
                    if len(known) >= 2 * self.half:
                        known.clear()
                    known[part] = ids
            out.append(ids)
        return b"".join(out)

    def _whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _alone(self, text: bytes) -> bytes:
        """Ids of one text, by its own pieces."""
        low = text.lower() if self.lower else text
        if any(x in low for x in self.special):
            return self._whole(text)
        return b"".join(map(self.memory.__getitem__, map(bytes.decode, low.split()) if self.words_only else _PIECES.findall(text.decode())))

    def _cut(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """All pieces of the texts in order, and how many each text has.

        One that begins with a comma or a full stop has a byte 1 in front. Without words only, a piece is
        named by what follows a space; one that begins with a line end keeps it, and one that opens a
        text has a zero byte in front.
        """
        if self.words_only:
            joined = [(x.lower() if self.lower else x).replace(b",", b" \1,").replace(b".", b" \1.") for x in texts]
            found = pc.ascii_split_whitespace(pa.array(joined, pa.binary()).view(pa.string()))
            return found.flatten().view(pa.binary()), np.diff(found.offsets.to_numpy()).astype(np.int64)
        n = np.fromiter((1 + sum(map(x.count, (b" ", b"\n", b",", b"."))) for x in texts), dtype=np.int64, count=len(texts))
        joined = (b"\0" + b" \0".join(texts)).replace(b"\n", b" \n").replace(b",", b" \1,").replace(b".", b" \1.")
        return pc.split_pattern(pa.array([joined], pa.binary()), " ").flatten(), n

    def _doubtful(self, names: pa.Array, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Pieces with no sure cut after them (white space that is kept, if it does not end a text) or before them (a comma or a full stop, if no letter or number comes first)."""
        ends = np.frombuffer(names.buffers()[1], dtype=np.int32)[: len(names) + 1]
        data = np.frombuffer(names.buffers()[2], dtype=np.uint8)
        some = np.diff(ends) > 0
        head, tail = (np.full(len(names), 0x20, dtype=np.uint8) for _ in range(2))
        head[some], tail[some] = data[ends[:-1][some]], data[ends[1:][some] - 1]
        space, solid = _BYTE_SPACE[tail], _BYTE_SOLID[tail]
        for i in np.flatnonzero(tail >= 0x80).tolist():
            end = names[i].as_py()[-4:].decode(errors="ignore")[-1:]
            space[i], solid[i] = end.encode() in _ENDS, end < "ɐ" and (end + end.lower()[-1:]).isalpha()  # a small letter can end in a mark
        inside = (head == 1)[at]
        if self.words_only:
            solid[tail == 0] = False  # a zero byte opens no text here
            solid[~some] = True  # white space before
            inside[first] = False
            out = np.zeros(len(at), dtype=bool)
        else:
            out = space[at]
            out[last] = False
        out[1:] |= inside[1:] & ~solid[at[:-1]]
        return out

    def arrays(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids end."""
        if not texts:
            return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        low = [x.lower() for x in texts] if self.lower else texts
        mark = [*self.special, b"\1"] if self.words_only else [*self.special, b"\0", b"\1"]
        alone = np.fromiter((any(x in t for x in mark) for t in low), dtype=bool, count=len(texts))
        pieces, n = self._cut([b"" if x else t for t, x in zip(texts, alone.tolist(), strict=True)])
        coded = pieces.dictionary_encode()
        names, at = coded.dictionary, coded.indices.to_numpy()
        ids = list(map(self.memory.__getitem__, names.to_pylist()))
        if len(self.memory) >= self.half:
            self.memory = _Memory(self._learn, dict(self.memory))
        length = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        begin, pieces_end = np.cumsum(length) - length, np.cumsum(n)
        alone |= np.add.reduceat(self._doubtful(names, at, pieces_end - n, pieces_end - 1), pieces_end - n, dtype=np.int64) > 0
        count = length[at]
        total = np.concatenate([[0], np.cumsum(count)])
        ends = total[pieces_end]
        kind = np.int32 if total[-1] < 1 << 31 else np.int64
        source = np.repeat((begin[at] - total[:-1]).astype(kind), count)
        source += np.arange(total[-1], dtype=kind)
        out = np.frombuffer(b"".join(ids), dtype="<u4")[source]
        if not alone.any():
            return out, ends
        parts = [np.frombuffer(self._alone(t), dtype="<u4") if x else out[b:e] for t, x, b, e in zip(texts, alone.tolist(), np.concatenate([[0], ends[:-1]]), ends, strict=True)]
        return np.concatenate(parts), np.cumsum([len(x) for x in parts])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        ids, ends = self.arrays(texts)
        return [ids[b:e].tobytes() for b, e in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)] if len(texts) else []


def encoder(vocabulary: str) -> CachedEncoder:
    """One encoder for each vocabulary and worker; tasks that follow in the same worker find its pieces."""
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = CachedEncoder(vocabulary)
    return _ENCODERS[key]

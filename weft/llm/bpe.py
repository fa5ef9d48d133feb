"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece there is exactly one token that ends its encoding. The candidates
for a prefix are the vocabulary's tokens that are suffixes of it; an automaton over the
vocabulary reports them in one sweep. A candidate is right if it is compatible with the last
token of the prefix that it leaves: their concatenation encodes to these two tokens. Back
pointers from the end then give the ids. The work is linear in the text, and a run of a
million equal bytes takes no more than prose.

Compatibility of two tokens x, y. While merges run by rank, the token that borders on the seam
from the left is one of x's right spine (x's last merge undone again and again), and from the
right one of y's left spine. Each lives from the rank that made it to the rank that used it up.
The pair survives if no merge of a left with a right one has a rank within both lives; at equal
ranks the leftmost merge goes first.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from weft.llm.arrow import as_bytes, key_and_text, map_batches, sized, slices
from weft.llm.tokenize import CACHE_PIECES, PARTS, CachedEncoder, byte_letters, read_vocabulary

_NEVER = 1 << 60
#: Remembered compatibility tests; forgotten all at once when full.
SEAMS = 1_000_000

_CODERS: dict[str, PrefixCoder] = {}


class PrefixCoder(CachedEncoder):
    """Exact ids of a byte-level BPE vocabulary without a merge loop, and texts of ids."""

    def __init__(self, vocabulary: str, pieces: int = CACHE_PIECES):
        import ahocorasick

        settings = json.loads(vocabulary)
        model, before = settings["model"], settings.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or settings.get("normalizer"):
            raise ValueError("a byte-level BPE vocabulary that splits by its own pattern is needed")
        letters = byte_letters()
        self.texts: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        ids = model["vocab"]
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(ids[a], ids[b]): r for r, (a, b) in enumerate(pairs)}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            self.halves.setdefault(ids[a + b], (r, ids[a], ids[b]))
        self._spines: tuple[dict, dict] = ({}, {})
        self.seams: dict[int, bool] = {}
        self.bits = max(self.texts).bit_length()
        automaton = ahocorasick.Automaton()
        self.whole: dict[bytes, int] = {}
        for i, text in self.texts.items():
            if self._stands(i):
                automaton.add_word(text.decode("latin-1"), (i, len(text)))
                self.whole[text] = i
        automaton.make_automaton()
        self.automaton = automaton
        added = sorted(settings.get("added_tokens") or [], key=lambda x: -len(x["content"]))
        self.added = {x["content"]: x["id"] for x in added}
        self.texts |= {x["id"]: x["content"].encode() for x in added}
        self.cut_at = regex.compile("(" + "|".join(regex.escape(x) for x in self.added) + ")") if self.added else None
        self.special, self.words_only, self.lower = [x.encode() for x in self.added], False, False
        self.parts = regex.compile(PARTS)
        self._remember(pieces)

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, rank that uses it up) from the whole token down. side 0: right spine, 1: left spine."""
        known = self._spines[side]
        if token not in known:
            out, at, until = [], token, _NEVER
            while True:
                out.append((at, until))
                half = self.halves.get(at)
                if half is None:
                    break
                until, at = half[0], half[2 - side]
            known[token] = out
        return known[token]

    def _parted(self, x: int, y: int, until: int = _NEVER) -> bool:
        """No merge joins the two across the seam, before ``until``."""
        for a, end_a in self._spine(x, 0):
            for b, end_b in self._spine(y, 1):
                r = self.rank.get((a, b))
                if r is not None and r < min(end_a, until) and r <= end_b:
                    return False
        return True

    def _stands(self, token: int) -> bool:
        """The token's own bytes encode to it: its halves do, and only its own merge joins them."""
        half = self.halves.get(token)
        return half is None or self._parted(half[1], half[2], half[0])

    def piece(self, text: bytes) -> list[int]:
        """Ids of one pre-token."""
        one = self.whole.get(text)
        if one is not None:
            return [one]
        last = [-1] * (len(text) + 1)
        seams, bits = self.seams, self.bits
        for end, (token, size) in self.automaton.iter(text.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            begin = end - size
            if begin:
                seam = last[begin] << bits | token
                fits = seams.get(seam)
                if fits is None:
                    if len(seams) >= SEAMS:
                        seams.clear()
                    fits = seams[seam] = self._parted(last[begin], token)
                if not fits:
                    continue
            last[end] = token
        out, end = [], len(text)
        while end:
            token = last[end]
            if token < 0:
                raise ValueError("the vocabulary lacks single bytes")
            out.append(token)
            end -= len(self.texts[token])
        return out[::-1]

    def _part(self, part: str) -> bytes:
        return np.array(self.piece(part.encode()), dtype="<u4").tobytes()

    def _learn(self, piece: str | bytes) -> bytes:
        return self._split(self._text(piece))

    def _whole(self, text: bytes) -> bytes:
        """The strings of added tokens become those tokens, what stands between is encoded by itself."""
        parts = self.cut_at.split(text.decode())
        plain = self.encode([x.encode() for x in parts[::2]])
        return b"".join(x + self.added[a].to_bytes(4, "little") for x, a in zip(plain, parts[1::2], strict=False)) + plain[-1]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.texts.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def coder(vocabulary: str) -> PrefixCoder:
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _CODERS:
        _CODERS[key] = PrefixCoder(vocabulary)
    return _CODERS[key]


def encode(documents: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers): one row per row of ``documents``.

    A null or empty text has no ids; a null id stays null; repeated rows give repeated rows; an
    empty table gives none. Other columns are not read. Rows do not meet: nothing is shuffled.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches):
        own = coder(shipped.value)
        for part in sized(batches, 1):
            ids = own.encode(as_bytes(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return map_batches(key_and_text(documents, key, text), run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, vocabulary_path: str, ids: str = "ids") -> DataFrame:
    """The columns of ``encoded`` and ``decoded``, the text of its ids (null ids: empty). A column of that name is replaced."""
    shipped = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    plain = encoded.drop("decoded")
    names = plain.columns
    at = names.index(ids)

    def run(batches):
        own = coder(shipped.value)
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([own.decode(x or b"") for x in part.column(at).to_pylist()], pa.string())], names=[*names, "decoded"])

    return map_batches(plain, run, ", ".join(f"`{n}` {t}" for n, t in plain.dtypes) + ", decoded string")


def digests(documents: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode each text, decode its ids, and keep digests of both. Rows as in encode()."""
    shipped = documents.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches):
        own = coder(shipped.value)
        for part in sized(batches, 1):
            ids = own.encode(as_bytes(part.column(1)))
            texts = [hashlib.sha256(own.decode(x).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(key_and_text(documents, key, text), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

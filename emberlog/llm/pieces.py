"""Encoding of text batches by their distinct pieces.

Arrow cuts the texts of a batch at safe boundaries and numbers the distinct pieces; only those are
encoded, joined to longer texts, and the results are gathered per text with numpy. A boundary is a
single space between two characters that are not white space. A text with white space at an end or
two white space characters in a row is encoded whole.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 24 << 20  # texts whose pieces are numbered together
JOINED_BYTES = 1 << 15  # pieces encoded in one call
# White space as in Unicode, with U+001C to U+001F.
_W = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = rf"{_W}{_W}|^{_W}|{_W}$"
# For sentencepiece, also what its normaliser might join to a space, and its own mark for one.
_ODD_MARKED = rf"{_ODD}| [^\x21-\x7e\pL\pN]|\x{{2581}}"


class ByteLevel:
    """Byte-level BPE from a tokenizers file; a piece keeps the space before it.

    The ids are those of the tokenizers library with add_special_tokens=False: strings of special
    tokens in a text become these tokens. The merges run in tiktoken over the file's own vocabulary,
    in which a rank is an id; ``tests/llm`` compares both libraries.
    """

    odd = _ODD

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {_bytes_of(token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        # Fixed value: the pre-tokeniser's published pattern.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)
        self.sizes = np.zeros(max(*ranks.values(), *special.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)
        for token, i in special.items():
            self.sizes[i] = len(token.encode())

    def whole(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special=self.special, disallowed_special=())

    def later(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, each after a space, and the number of ids of each."""
        ids = self.whole(" " + _joined(pieces))
        ends = np.cumsum(pc.binary_length(pieces).to_numpy().astype(np.int64) + 1)
        at = np.searchsorted(np.cumsum(self.sizes[ids]), ends, "left") + 1
        return ids, np.diff(at, prepend=0)

    def first(self, pieces: list[str]) -> list[np.ndarray]:
        return [self.whole(p) for p in pieces]


class Marked:
    """sentencepiece; it gives a lone piece the mark that stands for the space before it in a text."""

    odd = _ODD_MARKED

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.starts = np.array([n.startswith("▁") for n in names])
        if any("▁" in n.lstrip("▁") for n in names):
            self.odd = ""  # an entry crosses a boundary: every text is encoded whole

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), dtype=np.uint32)

    def later(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = self.whole(_joined(pieces))
        at = np.flatnonzero(self.starts[ids])
        if len(at) != len(pieces):  # a piece that the normaliser empties or cuts
            each = self.first(pieces.to_pylist())
            return np.concatenate(each), np.array([len(x) for x in each])
        return ids, np.diff(at, append=len(ids))

    def first(self, pieces: list[str]) -> list[np.ndarray]:
        return [self.whole(p) for p in pieces]


_models: dict[str, ByteLevel | Marked] = {}


def model(path: str) -> ByteLevel | Marked:
    """One model per worker process and file, by the file's kind."""
    if path not in _models:
        _models[path] = (Marked if path.endswith(".model") else ByteLevel)(path)
    return _models[path]


def _bytes_of(token: str) -> bytes:
    """Byte-level vocabularies write printable Latin-1 bytes as they are and the rest from U+0100 on, in order."""
    if not _BYTES:
        plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
        _BYTES.update({chr(b): b for b in plain})
        _BYTES.update({chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)})
    return bytes(_BYTES[c] for c in token)


_BYTES: dict[str, int] = {}


def _ragged(offsets: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the rows ``picks`` of a ragged array, one after another, and the rows' lengths."""
    n = offsets[picks + 1] - offsets[picks]
    ends = np.cumsum(n)
    return np.repeat(offsets[picks] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0), n


def _joined(pieces: pa.Array) -> str:
    return pc.binary_join(pa.ListArray.from_arrays([0, len(pieces)], pieces), " ")[0].as_py()


def _table(m: ByteLevel | Marked, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct pieces as a ragged array."""
    ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for part in runs(pieces, JOINED_BYTES):
        a, n = m.later(part)
        ids.append(a)
        counts.append(n)
    return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)


def runs(texts: pa.Array, limit: int = RUN_BYTES):
    """Slices of about ``limit`` bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    sizes = sizes.astype(np.int64) + 1
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(limit, int(sizes.sum()) + limit, limit), "left") + 1
    begin = 0
    for c in dict.fromkeys(min(int(c), len(texts)) for c in [*cuts, len(texts)]):
        if c > begin:
            yield texts.slice(begin, c - begin)
            begin = c


class Encoded:
    """A run of texts, cut and with its distinct pieces encoded."""

    def __init__(self, m: ByteLevel | Marked, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, m.odd) if m.odd else pa.array([True] * len(texts))
        odd = pc.or_(odd, pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        self.odd = {int(i): m.whole(texts[int(i)].as_py()) for i in np.flatnonzero(odd)}
        lists = pc.split_pattern(pc.if_else(pa.array(odd), "x", texts), " ")
        self.offsets = lists.offsets.to_numpy().astype(np.int64)
        self.offsets = self.offsets - self.offsets[0]
        coded = lists.flatten().dictionary_encode()
        self.codes, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        heads, places = np.unique(self.codes[self.offsets[:-1]], return_inverse=True)
        self.heads, self.head_of = m.first(names.take(pa.array(heads)).to_pylist()), places
        self.ids, self.starts = _table(m, names)
        self.n = len(texts)

    def lengths(self) -> np.ndarray:
        n = np.diff(self.starts)[self.codes]
        n[self.offsets[:-1]] = np.array([len(h) for h in self.heads], dtype=np.int64)[self.head_of]
        out = np.add.reduceat(n, self.offsets[:-1]) if self.n else np.zeros(0, np.int64)
        for i, ids in self.odd.items():
            out[i] = len(ids)
        return out

    def ids_of(self, i: int) -> np.ndarray:
        """Ids of text i."""
        if i in self.odd:
            return self.odd[i]
        rest, _ = _ragged(self.starts, self.codes[self.offsets[i] + 1 : self.offsets[i + 1]])
        return np.concatenate([self.heads[self.head_of[i]], self.ids[rest]])

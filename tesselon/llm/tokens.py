"""Token ids of whole batches of texts, by files of public tokenizers."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .words import tidy, words

#: Pieces whose ids a worker remembers, at most; the first ones, among which the frequent ones are.
REMEMBERED = 100_000
#: Characters for which lower case, classes and composition are settled.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: How a word-end tokenizer cuts a lower-cased plain word (fixed by its file).
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: The settings under which a text's ids are those of its words in turn (fixed by the file).
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pattern": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
}


def tokenizer_path(name: str) -> str:
    """A path as it is; a bare name is looked up among the installed public tokenizers."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Codec:
    """Encodes Arrow arrays of texts with one tokenizer file.

    Where the file's settings make a text's ids those of its words one after
    another, each distinct word of a batch is encoded once; other files encode
    whole texts.
    """

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_word = (
            spec.get("normalizer") == BY_WORD["normalizer"]
            and steps[0].get("pattern") == {"Regex": BY_WORD["pattern"]}
            and steps[0].get("behavior") == "Removed"
            and bool(spec["model"].get("end_of_word_suffix"))
            and all(t["content"].startswith("<|") and " " not in t["content"] for t in spec.get("added_tokens", []))
        )
        letters = _byte_letters()
        plain = (chr(c) for c in range(0x21, 0x100) if PLAIN.fullmatch(chr(c)))
        self.letters = {ord(c): "".join(letters[b] for b in c.encode()) for c in plain}
        self.pieces: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        self.packed = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            found = b"".join([self.packed[t.id] for t in self.model.tokenize(piece.translate(self.letters))])
            if len(self.pieces) < REMEMBERED:
                self.pieces[piece] = found
        return found

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _words(self, distinct: list[str]) -> list[bytes]:
        out: list[bytes] = []
        late: list[int] = []
        for k, word in enumerate(distinct):
            if PLAIN.fullmatch(word) and "<|" not in word:  # added tokens begin so
                pieces = PIECE.findall(word.lower())
                out.append(self._piece(pieces[0]) if len(pieces) == 1 else b"".join(map(self._piece, pieces)))
            else:
                out.append(b"")
                late.append(k)
        if late:
            for k, ids in zip(late, self._whole([distinct[k] for k in late]), strict=True):
                out[k] = ids
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids begin (and the end)."""
        if not self.by_word:
            each = self._whole(texts.to_pylist())
            starts = np.concatenate(([0], np.cumsum([len(e) // 4 for e in each], dtype=np.int64)))
            return np.frombuffer(b"".join(each), dtype="<u4"), starts
        split = words(texts)
        each = self._words(split.distinct.to_pylist())
        sizes = np.fromiter((len(e) // 4 for e in each), np.int64, len(each))
        first = np.concatenate(([0], np.cumsum(sizes)))
        flat = np.frombuffer(b"".join(each), dtype="<u4")
        size = sizes[split.codes]
        ends = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(ends[-1]) + np.repeat(first[split.codes] - ends[:-1], size)
        return flat[at], ends[split.starts]


@lru_cache(maxsize=2)
def codec(name: str) -> Codec:
    """The codec of this worker for a file."""
    made = Codec(name)
    tidy()  # reading the file takes more than the codec keeps
    return made


def with_end(ids: np.ndarray, starts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` after each text's ids."""
    return np.insert(ids, starts[1:], end_id).astype("<u4", copy=False), starts + np.arange(len(starts))


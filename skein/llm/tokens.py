"""Ids of whole texts by the tokenizers library, made word by word where the file's rules allow it.

Under the normaliser and split pattern below nothing joins what white space parts, so a text's ids
are those of its ASCII-white-space words, one after the other. A worker keeps the ids of words it
has met. Words of Latin-1 letters with ASCII marks but no apostrophe after them, whose normal form is
their lower case, go to the library's BPE model as the one or two pieces that the pattern makes of
them; all others through its whole encode(). The file is held against these rules when it is read:
under any other rules each text goes through encode() as a whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from skein.llm.common import claim, raw

VOCABULARY = "word_bpe_49k.json"
#: The rules of a vocabulary file under which words are taken one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLIT = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27)
#: Stems a worker keeps, some 200 bytes each, and half as many words.
MOST_WORDS = 800_000
#: Bytes of text whose words are told apart at once.
STRETCH_BYTES = 8 << 20


def byte_letters() -> list[str]:
    """Each byte's letter in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, n = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(0x100 + n)
            n += 1
    return [out[b] for b in range(256)]


_LETTERS = dict(enumerate(byte_letters()))


def by_word(normalizer: dict | None, split: dict | None, after: object, specials: list[str]) -> bool:
    """Whether a vocabulary file has the rules under which the words of a text stand for themselves."""
    return normalizer == NORMALIZER and split == SPLIT and after is None and not any(c.isspace() for x in specials for c in x)


def _letters_and_marks(word: bytes) -> tuple[bytes, bytes] | None:
    """The letters in lower case, and the marks after them, if word is nothing else."""
    core = word.rstrip(_MARKS)
    if core.isalpha() or not core:  # of bytes: ASCII letters
        return core.lower(), word[len(core) :]
    if _LATIN.fullmatch(text := core.decode()):
        return text.lower().encode(), word[len(core) :]
    return None


def _rules(part: object) -> dict | None:
    return json.loads(part.__getstate__()) if part is not None else None


class WordIds(dict):
    """Word (bytes) to its ids as little-endian unsigned 32-bit integers; forgets all at half of `most` words."""

    def __init__(self, path: str, most: int = MOST_WORDS):
        from tokenizers import Tokenizer

        super().__init__()
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.model, self.most, self.stems = self.lib.model, most, {}
        added = self.lib.get_added_tokens_decoder().values()
        # a special that such a word could hold would be cut out of it
        self.by_word = not any(x.normalized or x.lstrip or x.rstrip or _letters_and_marks(x.content.encode()) for x in added) and by_word(_rules(self.lib.normalizer), _rules(self.lib.pre_tokenizer), self.lib.post_processor, [x.content for x in added])
        self.four = [i.to_bytes(4, "little") for i in range(self.lib.get_vocab_size())]

    def library(self, word: str) -> bytes:
        return np.array(self.lib.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def stem(self, word: bytes) -> bytes:
        found = self.stems.get(word)
        if found is None:
            if len(self.stems) >= self.most:
                self.stems.clear()
            letters = word.decode("latin-1") if word.isascii() else word.decode("latin-1").translate(_LETTERS)
            found = b"".join([self.four[x.id] for x in self.model.tokenize(letters)])
            self.stems[word] = found
        return found

    def __missing__(self, word: bytes) -> bytes:
        if 2 * len(self) >= self.most:  # fewer than stems: a word of a known stem is soon made again
            self.clear()
        plain = _letters_and_marks(word)
        if plain and plain[0]:  # letters alone are one piece, and marks after them another
            found = self.stem(plain[0]) + self.stem(plain[1]) if plain[1] else self.stem(plain[0])
        else:
            found = self.library(word.decode())
        self[word] = found
        return found

    def encode(self, text: bytes | None) -> bytes:
        """A whole text's ids, as bytes."""
        if not self.by_word:
            return self.library(text.decode()) if text else b""
        return b"".join(map(self.__getitem__, text.split())) if text else b""


    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Each text's ids. The words of some megabytes of text are told apart by the column's own hash table; only different ones are looked up here."""
        if not self.by_word:
            yield from map(self.encode, raw(texts))
            return
        for at, n in stretches(texts):
            split = pc.ascii_split_whitespace(pc.fill_null(texts.slice(at, n).cast(pa.large_string()), ""))
            words = split.flatten().dictionary_encode()
            ids = [self[w] if w else b"" for w in _bytes(words.dictionary)]
            size, which = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2, words.indices.to_numpy()
            count = size[which]
            ends = np.concatenate(([0], np.cumsum(count)))
            # the place of each id of each word among the ids of all different words
            place = np.repeat(((np.cumsum(size) - size)[which] - ends[:-1]).astype(np.int32), count)
            place += np.arange(len(place), dtype=np.int32)
            out = np.frombuffer(b"".join(ids), "<u4")[place]
            bounds = ends[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                yield out[s:e].tobytes()


def _bytes(words: pa.Array) -> list[bytes]:
    """A large_string array without nulls as bytes, cut out of its buffer: to_pylist() makes an object of its own of each first."""
    if not len(words):
        return []
    at = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset).tolist()
    data = memoryview(words.buffers()[2] or b"")[at[0] : at[-1]].tobytes()
    return [data[s - at[0] : e - at[0]] for s, e in zip(at[:-1], at[1:], strict=True)]


def stretches(texts: pa.Array, most: int = STRETCH_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, rows) of about so many bytes together; a longer text is one by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, upto - at
        at = upto


@lru_cache(2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def word_ids(path: str, most: int = MOST_WORDS) -> WordIds:
    found = _word_ids(path)
    found.most = most
    claim("tokens", found, found.stems)
    return found


def vocabulary(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)

"""Token ids of whole texts, fast: the tokenizers library encodes each distinct word
once per worker, and numpy splits the texts and puts the ids together.

This holds for tokenizers that normalise (NFC, lower case), split into words and
encode every word for itself, ending it with a mark; ``Encoder`` looks at the
tokenizer's file and encodes whole texts with the library wherever that is not so,
also single texts with an apostrophe (contractions), a special token or a sigma.
"""

from __future__ import annotations

import json
import os
import sys
import unicodedata

import numpy as np

from suitelens.llm.words import fresh_key, word_names

#: fixed values: the word pattern and the order of normalisation this module can stand in for
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ("NFC", "Replace", "Lowercase")
WORD_END = "</w>"
#: fixed values: the code points of Unicode's White_Space
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_SLOTS = 1 << 20
_POOL_IDS = 6 << 20
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_KEY = fresh_key()  # names of words never leave this worker
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for the tokenizer file at ``path``."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _classes() -> np.ndarray:
    kind = {"L": _LETTER, "N": _NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(sys.maxunicode + 1)), np.uint8)
    table[WHITE_SPACE] = _SPACE
    return table


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm = tuple(n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", ()))
        pres = (spec.get("pre_tokenizer") or {}).get("pretokenizers", ())
        split = pres[0].get("pattern", {}).get("Regex") if pres else None
        self.by_word = norm == NORMALIZERS and split == WORD_PATTERN and spec["model"].get("end_of_word_suffix") == WORD_END
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        if not self.by_word:
            return
        self.single = Tokenizer.from_file(path)  # for words that are already normalised
        self.single.normalizer = normalizers.Sequence([])
        self.single.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.full.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith(WORD_END)]] = True
        self.classes = _classes()
        self._forget()

    def _forget(self) -> None:
        """Empty the worker's memory of words (it is bounded)."""
        self.slot_name = np.zeros(_SLOTS, np.uint64)
        self.slot_at, self.slot_n = np.zeros(_SLOTS, np.int64), np.zeros(_SLOTS, np.int64)
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of each text's."""
        texts = [t or "" for t in texts]
        odd = [k for k, t in enumerate(texts) if not self.by_word or self._odd(t)]
        if not odd:
            return self._words(texts)
        whole = dict(zip(odd, self.full.encode_batch([texts[k] for k in odd], add_special_tokens=False), strict=True))
        ids, counts = self._words(["" if k in whole else t for k, t in enumerate(texts)]) if len(odd) < len(texts) else (np.zeros(0, np.uint32), np.zeros(len(texts), np.int64))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for k, e in whole.items():
            parts[k] = np.array(e.ids, np.uint32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _odd(self, text: str) -> bool:
        return "'" in text or "Σ" in text or any(s in text for s in self.special)

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        texts = [(t if t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)).lower() for t in texts]
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        joined = " ".join(texts) + " "
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.classes[code]
        cut = np.ones(len(code) + 1, bool)  # a boundary stands before this character
        cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        inside = kind != _SPACE
        starts, ends = np.flatnonzero(inside & cut[:-1]), np.flatnonzero(inside & cut[1:]) + 1
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        names = word_names(code, starts, ends, _KEY)
        slot = (names >> np.uint64(44)).astype(np.int64)
        at, n = self.slot_at[slot], self.slot_n[slot]
        miss = np.flatnonzero((self.slot_name[slot] != names) | (n == 0))
        if len(miss):
            new, one, back = np.unique(names[miss], return_index=True, return_inverse=True)
            new_at, new_n = self._learn([joined[a:b] for a, b in zip(starts[miss[one]].tolist(), ends[miss[one]].tolist(), strict=True)])
            at[miss], n[miss] = new_at[back], new_n[back]
            where = slot[miss[one]]
            self.slot_name[where], self.slot_at[where], self.slot_n[where] = new, new_at, new_n
        before = np.cumsum(n) - n
        ids = self.pool[np.repeat(at - before, n) + np.arange(int(n.sum()))]
        total = np.concatenate([before, [len(ids)]])
        edge = total[np.searchsorted(starts, begin, "left")]
        if self.used > _POOL_IDS:
            self._forget()
        return ids, np.diff(edge)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode words and keep their ids; place and number of each word's."""
        found = self.single.encode_batch_fast([" ".join(words[k:k + 400]) for k in range(0, len(words), 400)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in found])
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != len(words):
            raise ValueError("the tokenizer does not end every word with its mark")
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[self.used:self.used + len(ids)] = ids
        at = np.concatenate([[0], last[:-1]])
        n = last - at
        at = at + self.used
        self.used += len(ids)
        return at, n

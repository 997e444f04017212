"""Encoding with a public tokenizer file of the `tokenizers` library, each distinct part of a word once."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A character that sends its text through the library whole: beyond the others, Unicode versions and normal forms may differ.
ODD = r"[^\x00-\x1b\x20-\x{24f}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20ac}]"
#: Parts of words that are no runs of letters, as the pattern of such tokenizers has them; white space is what ASCII has.
BREAKS = r"'(?:s|t|re|ve|m|ll|d)|\p{N}|[^\s\x0b\p{L}\p{N}]+"
#: The pattern that BREAKS and runs of letters stand for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Longer parts are not kept, and bytes that an entry takes besides its own.
LONGEST, ENTRY = 256, 200


class WordEncoder:
    """Encodes texts by the parts of their words, each distinct part once.

    For tokenizers whose tokens mark the end of a word, which drop white space and lower-case: a part's ids do not
    depend on its neighbours. Texts are lower-cased, parted at white space and around what is no letter, and their parts
    numbered, all in Arrow; new parts are encoded by the library in calls of some thousands, whose ids are told apart at the
    word ends, and a text's ids are gathered by its parts' numbers. Texts with special tokens' strings or unusual characters,
    and all texts of other kinds of tokenizers, go through the library whole. What is remembered is forgotten when it
    takes `most` bytes, so memory is bounded.
    """

    def __init__(self, path: str, most: int = 192 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        split = [p["pattern"]["Regex"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", ()) if p["type"] == "Split"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", ())]
        suffix = spec["model"].get("end_of_word_suffix")
        self.by_words = bool(suffix) and split == [PATTERN] and kinds == ["NFC", "Replace", "Lowercase"]
        if self.by_words:
            self.last = np.zeros(max(spec["model"]["vocab"].values()) + 1, dtype=bool)
            self.last[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.most, self.held = most, 0

    def _ids(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts."""
        if self.held > self.most:
            self.known.clear()
            self.held = 0
        get = self.known.get
        out = [get(p) for p in parts]
        new = [k for k, ids in enumerate(out) if ids is None]
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([parts[k] for k in some])], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("the tokenizer does not end every word with a word end")
            raw, a = ids.tobytes(), 0
            for k, b in zip(some, (ends * 4).tolist(), strict=True):
                out[k] = raw[a:b]
                a = b
                if len(parts[k]) <= LONGEST:
                    self.known[parts[k]] = out[k]
                    self.held += len(parts[k]) + len(out[k]) + ENTRY
        return out

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4") for t in texts]

    def _by_parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        low = pa.array([t.lower() for t in texts], pa.large_string())
        for white in ("\x85", "\xa0"):
            low = pc.replace_substring(low, white, " ")
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(low, pattern=BREAKS, replacement=r" \0 "))
        parts = lists.flatten().dictionary_encode()
        names, number = parts.dictionary.to_pylist(), np.asarray(parts.indices)
        empty = names.index("") if "" in names else None
        ids = [b""] * len(names)
        asked = [k for k in range(len(names)) if k != empty]
        for k, got in zip(asked, self._ids([names[k] for k in asked]), strict=True):
            ids[k] = got
        size = np.array([len(x) // 4 for x in ids], dtype=np.int64)
        first = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        n = size[number]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.repeat(first[number] - ends[:-1], n) + np.arange(ends[-1])]
        return out, ends[np.asarray(lists.offsets)]

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts without special tokens, one behind another, and where each text's begin and the last's end."""
        odd = np.asarray(pc.match_substring_regex(texts, ODD)) if self.by_words else np.ones(len(texts), dtype=bool)
        strings = texts.to_pylist()
        odd = odd | np.array(["<|" in t and any(s in t for s in self.special) for t in strings], dtype=bool)
        if not odd.any():
            return self._by_parts(strings)
        rows = np.flatnonzero(~odd)
        ids, ends = self._by_parts([strings[k] for k in rows])
        got: list[np.ndarray] = [ids[:0]] * len(strings)
        for k, a, b in zip(rows, ends[:-1], ends[1:], strict=True):
            got[k] = ids[a:b]
        for k, one in zip(np.flatnonzero(odd), self._whole([strings[k] for k in np.flatnonzero(odd)]), strict=True):
            got[k] = one
        return np.concatenate(got), np.cumsum([0, *map(len, got)])

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text without special tokens, as little-endian unsigned 32-bit integers."""
        ids, ends = self.encode_flat(pa.array(texts, pa.string()))
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]


@lru_cache(maxsize=2)
def encoder(path: str, most: int = 192 << 20) -> WordEncoder:
    """One encoder a worker process."""
    return WordEncoder(path, most)

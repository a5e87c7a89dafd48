"""Token ids of documents (shared by packing and binary output)."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The id that ends each document.
END_ID = 1
#: The rules of a tokenizer whose words can be cut into pieces here. Any other encodes whole texts itself.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: Words of these characters are the same after Unicode composition, and lower-case letter by letter.
PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
PIECES = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+)"
_encoders: dict[str, WordEncoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def laid_out(ids: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ids (n of each) in the order of `at`, and where each begins (one bound more than runs)."""
    each = n[at]
    ends = np.zeros(len(at) + 1, np.int64)
    np.cumsum(each, out=ends[1:])
    return ids[np.repeat((np.cumsum(n) - n)[at] - ends[:-1], each) + np.arange(ends[-1])], ends


class Known:
    """The ids of strings that were asked for lately, up to `most` strings; `of` gives those of new ones, and how many each has."""

    def __init__(self, of: Callable[[list[str]], tuple[list[int], list[int]]], most: int):
        self.of, self.most = of, most
        self.forget()

    def forget(self) -> None:
        self.at, self.ids, self.n = {}, np.empty(0, "<u4"), np.empty(0, np.int64)

    def places(self, wanted: list[str]) -> np.ndarray:
        """Where the ids of each are among self.ids, in runs of self.n; too many are forgotten first."""
        new = [w for w in wanted if w not in self.at]
        if len(self.at) + len(new) > self.most:
            self.forget()
            new = wanted
        if new:
            ids, n = self.of(new)
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.ids, self.n = np.concatenate([self.ids, np.array(ids, "<u4")]), np.concatenate([self.n, np.array(n, np.int64)])
        return np.fromiter(map(self.at.__getitem__, wanted), np.int64, len(wanted))


class WordEncoder:
    """Ids of texts as little-endian 32-bit integers; pieces of words are kept, up to `most` of them.

    A tokenizer by the rules above drops white space and never joins what stands on two sides of it, so a text's ids are
    those of its words in turn. Distinct words of plain letters, digits and signs are cut into pieces, and each distinct
    piece goes through the vocabulary's merges once; all other words go through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole, self.pieces, self.odd = Tokenizer.from_file(path), Known(self.piece_ids, most), Known(self.odd_ids, most)
        rules = json.loads(self.whole.to_str())
        marks = rules["added_tokens"]
        self.by_words = (
            (rules["normalizer"] or {}).get("normalizers") == NORMALIZERS
            and (rules["pre_tokenizer"] or {}).get("pretokenizers") == PRE_TOKENIZERS
            and rules["model"]["type"] == "BPE"
            and not any(rules[k] for k in ("truncation", "padding"))
            and all(m["content"].startswith("<|") and not m["content"].split()[1:] and not (m["lstrip"] or m["rstrip"] or m["single_word"]) for m in marks)
        )
        self.model = self.whole.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(192, 256)}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one bound more than texts); null is empty."""
        if not self.by_words:
            own = [e.ids for e in self.whole.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            bounds = np.zeros(len(own) + 1, np.int64)
            np.cumsum([len(x) for x in own], out=bounds[1:])
            return np.array([i for x in own for i in x], "<u4"), bounds
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        ids, ends = laid_out(*self.word_ids(words.dictionary), np.asarray(words.indices))
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(split), 0)), out=bounds[1:])
        return ids, ends[bounds]

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words in a row, and how many each has."""
        plain = pc.and_not(pc.match_substring_regex(words, PLAIN), pc.match_substring(words, "<|"))
        cut = pc.replace_substring_regex(pc.utf8_lower(words.filter(plain)), PIECES, r"\1 ")
        cut = pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(cut))
        pieces = cut.flatten().dictionary_encode()
        own = self.pieces.places(pieces.dictionary.to_pylist())
        odd = self.odd.places(words.filter(pc.invert(plain)).to_pylist())
        # a word that isn't plain is one part of its own, after the pieces
        plain = np.asarray(plain)
        n_parts = np.ones(len(words), np.int64)
        n_parts[plain] = np.asarray(pc.list_value_length(cut))
        at = own[np.asarray(pieces.indices)]
        if len(odd):
            of_plain, both = np.repeat(plain, n_parts), np.empty(n_parts.sum(), np.int64)
            both[of_plain], both[~of_plain] = at, len(self.pieces.n) + odd
            at = both
        ids, ends = laid_out(np.concatenate([self.pieces.ids, self.odd.ids]), np.concatenate([self.pieces.n, self.odd.n]), at)
        bounds = np.zeros(len(words) + 1, np.int64)
        np.cumsum(n_parts, out=bounds[1:])
        return ids, np.diff(ends[bounds])

    def piece_ids(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        tokens, letters, ids, n = self.model.tokenize, self.letters, [], []
        for p in pieces:
            found = tokens(p if p.isascii() else p.translate(letters))
            n.append(len(found))
            ids += [t.id for t in found]
        return ids, n

    def odd_ids(self, words: list[str]) -> tuple[list[int], list[int]]:
        own = [e.ids for e in self.whole.encode_batch(words, add_special_tokens=False)]
        return [i for x in own for i in x], list(map(len, own))


def encoder(path: str) -> WordEncoder:
    """One for each Python worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with END_ID after each text."""
    return np.insert(ids, bounds[1:], END_ID), bounds + np.arange(len(bounds))

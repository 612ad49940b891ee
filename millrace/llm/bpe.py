"""Byte-pair encoding of white-space pieces, exact against the tokenizer file's own library.

The vocabulary splits at white space, so a text's ids are the concatenation of its pieces' ids.
Common pieces (printable ASCII and Latin letters) are split and merged here, thousands of words at a
time with numpy; any other piece (other scripts, control characters, special-token strings, very long
runs) goes to the ``tokenizers`` library by itself.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

DEFAULT_TOKENIZER = "word_bpe_49k.json"
SIMPLE = re.compile("[!-~À-įı-ſ]+")
PRETOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zA-ZÀ-ÖØ-öø-ſ]+|[0-9]|[^a-zA-Z0-9À-ÖØ-öø-ſ]+")
LONGEST_WORD = 40
CACHE_PIECES = 700_000
NONE = np.int32(2**31 - 1)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        chars = byte_alphabet()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int32)
        self.size = max(vocab.values()) + 1
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]], np.int64)
        keys = pairs[:, 0] * self.size + pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int32), pairs[order, 2].astype(np.int32)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
        self.tokens = [tokens.get(i, "") for i in range(max(tokens) + 1)]

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.ranks[at], NONE), self.merged[at]

    def merge_rows(self, ids: np.ndarray) -> np.ndarray:
        """Merge every row of symbol ids (padded with -1) to its end, lowest rank and leftmost first."""
        out, live = ids.copy(), np.arange(len(ids))
        if ids.shape[1] < 2:
            return out
        rank, new = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while len(live):
            j = rank.argmin(1)
            rows = np.arange(len(live))
            go = rank[rows, j] < NONE
            if not go.all():
                done = live[~go]
                out[done] = -1
                out[done, : ids.shape[1]] = ids[~go]
                ids, rank, new, live, j = ids[go], rank[go], new[go], live[go], j[go]
                rows = np.arange(len(live))
                if not len(live):
                    break
            ids[rows, j] = new[rows, j]
            width = ids.shape[1] - 1
            cols = np.arange(width)
            ids = np.take_along_axis(ids, cols + (cols > j[:, None]), 1)
            cols = np.arange(width - 1)
            shift = cols + (cols >= j[:, None])
            rank, new = np.take_along_axis(rank, shift, 1), np.take_along_axis(new, shift, 1)
            if width == 1:
                out[live] = -1
                out[live, :1] = ids
                break
            for at in (j - 1, j):
                ok = (at >= 0) & (at < width - 1)
                r, c = rows[ok], at[ok]
                rank[r, c], new[r, c] = self.pair_ranks(ids[r, c], ids[r, c + 1])
        return out

    def merge_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word (bytes of one pre-token)."""
        found: list[tuple[int, ...]] = [()] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        for start in range(0, len(order), 8192):
            part = order[start : start + 8192]
            n = lengths[part]
            flat = np.frombuffer(b"".join(words[i] for i in part), np.uint8)
            ids = np.full((len(part), int(n.max())), -1, np.int32)
            ids[np.arange(ids.shape[1]) < n[:, None]] = self.inner[flat]
            ends = np.cumsum(n) - 1
            ids[np.arange(len(part)), n - 1] = self.final[flat[ends]]
            merged = self.merge_rows(ids)
            sizes = (merged >= 0).sum(1)
            for i, row, size in zip(part, merged.tolist(), sizes.tolist(), strict=True):
                found[i] = tuple(row[:size])
        return found

    def split_piece(self, piece: bytes) -> list[bytes] | None:
        """The piece's pre-tokens, or None where the library must decide."""
        if piece.isalpha() and len(piece) <= LONGEST_WORD:  # ASCII letters only
            return [piece.lower()]
        text = piece.decode("utf-8", "replace")
        if not SIMPLE.fullmatch(text) or self.special.search(text):
            return None
        words = [w.encode() for w in PRETOKEN.findall(text.lower())]
        return words if len(piece) <= LONGEST_WORD or max(map(len, words)) <= LONGEST_WORD else None

    def by_library(self, piece: bytes) -> tuple[int, ...]:
        return tuple(self.library.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids)


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


class Numbering(dict):
    """Gives each new key the next number and remembers it in ``fresh``."""

    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        self.fresh.append(key)
        number = self[key] = len(self)
        return number


class PieceEncoder:
    """Encodes batches of texts; keeps a bounded cache of pieces, with an optional lexicon in front.

    ``lexicon(words) -> list`` gives the ids of words it knows and None for others, which are merged.
    """

    def __init__(self, bpe: WordBpe, lexicon=None):
        self.bpe, self.lexicon = bpe, lexicon
        self.clear()

    def clear(self) -> None:
        self.words: dict[bytes, tuple[int, ...]] = {}
        self.pieces = Numbering()
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def learn(self, new: list[bytes]) -> None:
        words = self.words
        split = list(map(self.bpe.split_piece, new))
        fresh = list({w for s in split if s for w in s if w not in words})
        known = self.lexicon(fresh) if self.lexicon else [None] * len(fresh)
        words.update((w, ids) for w, ids in zip(fresh, known, strict=True) if ids is not None)
        unseen = [w for w, ids in zip(fresh, known, strict=True) if ids is None]
        words.update(zip(unseen, self.bpe.merge_words(unseen), strict=True))
        flat: list[int] = []
        ends = []
        for p, s in zip(new, split, strict=True):
            if s is None:
                flat += self.bpe.by_library(p)
            else:
                for w in s:
                    flat += words[w]
            ends.append(len(flat))
        lengths = np.diff(np.array([0, *ends], np.int64))
        self.lengths = np.concatenate([self.lengths, lengths])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.array(ends, np.int64) - lengths])
        self.flat = np.concatenate([self.flat, np.array(flat, np.uint32)])

    def index(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text (null: empty) the numbers of its pieces, in order."""
        if len(self.pieces) > CACHE_PIECES:
            self.clear()
        number = self.pieces.__getitem__
        found = []
        for text in texts:
            pieces = (text or "").encode("utf-8", "replace").split()
            found.append(np.fromiter(map(number, pieces), np.int64, len(pieces)))
        if self.pieces.fresh:
            fresh, self.pieces.fresh = self.pieces.fresh, []
            self.learn(fresh)
        return found

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The uint32 ids of each text."""
        out = []
        for at in self.index(texts):
            n = self.lengths[at]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.flat[np.repeat(self.starts[at] - (ends - n), n) + np.arange(total)])
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> PieceEncoder:
    """The worker's encoder of this vocabulary, whose cache of pieces serves one task after another."""
    return PieceEncoder(load(path))

"""Exact byte-pair encoding by dynamic programming over prefixes.

For every prefix of a piece exactly one token can be the last of the prefix's encoding: the
token that ends there and whose pair with the last token of the shorter prefix is stable,
that is, encodes to itself. An automaton over the vocabulary gives the tokens ending at each
byte; the stored last tokens are then followed backwards. The work is linear in the bytes,
however long a piece is.
"""

from __future__ import annotations

import json
from array import array

import ahocorasick
import regex

# The published split pattern of this vocabulary.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CACHED_PIECES = 1 << 18
CACHED_CHARS = 48


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the vocabulary file for the 256 bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(shifted)}


class _Pieces(dict):
    """Piece to its ids as packed integers; forgets everything when full."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        packed = array("i", self.encode(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = packed
        return packed


class PrefixEncoder:
    """Encoder over a vocabulary file with merges (`content`: its bytes)."""

    def __init__(self, content: bytes):
        model = json.loads(content)["model"]
        to_byte = byte_alphabet()
        raw = lambda token: bytes(to_byte[c] for c in token)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        base = sorted(to_byte)
        ranks = {bytes([to_byte[c]]): k for k, c in enumerate(base)}
        ids = [model["vocab"][c] for c in base]
        # Tokens are numbered by the time of their merge; single bytes come first.
        self.left, self.right = list(range(256)), list(range(256))
        self.merged: dict[tuple[int, int], int] = {}
        lengths = [1] * 256
        for a, b in pairs:
            x, y = ranks[raw(a)], ranks[raw(b)]
            k = len(ids)
            ranks[raw(a + b)] = k
            ids.append(model["vocab"][a + b])
            lengths.append(lengths[x] + lengths[y])
            self.left.append(x)
            self.right.append(y)
            self.merged[x, y] = k
        self.ids, self.lengths = array("i", ids), lengths
        self.ends = ahocorasick.Automaton()
        for token, k in ranks.items():
            self.ends.add_word(token.decode("latin-1"), k)
        self.ends.make_automaton()
        self.stable_pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.split = regex.compile(SPLIT_PATTERN).findall
        self.pieces = _Pieces(self.encode_piece)

    def _undisturbed(self, a: int, b: int, before: int) -> bool:
        """Whether no merge across the border of a and b comes before rank `before` or before
        the merges, undone one by one from the latest, that formed the tokens at the border."""
        merged = self.merged
        while True:
            across = merged.get((a, b))
            if across is not None and across < before:
                return False
            if a < 256 and b < 256:
                return True
            if a > b:  # formed last; an equal merge further right would come after it
                before, a = a, self.right[a]
            else:  # an equal merge further left would come before it
                before, b = b + 1, self.left[b]

    def stable(self, a: int, b: int) -> bool:
        found = self.stable_pairs.get((a, b))
        if found is None:
            if len(self.stable_pairs) >= 1 << 20:
                self.stable_pairs.clear()
            found = self.stable_pairs[a, b] = self._undisturbed(a, b, 1 << 60)
        return found

    def encodes_to_itself(self, token: int) -> bool:
        found = self.whole.get(token)
        if found is None:
            a, b = self.left[token], self.right[token]
            found = self.whole[token] = token < 256 or self._undisturbed(a, b, token)
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        if not piece:
            return []
        last = [-1] * (len(piece) + 1)
        lengths, stable = self.lengths, self.stable
        for end, token in self.ends.iter(piece.decode("latin-1")):
            if last[end + 1] >= 0:
                continue
            start = end + 1 - lengths[token]
            if self.encodes_to_itself(token) if start == 0 else last[start] >= 0 and stable(last[start], token):
                last[end + 1] = token
        out, at = [], len(piece)
        while at:
            out.append(self.ids[last[at]])
            at -= lengths[last[at]]
        out.reverse()
        return out

    def packed(self, text: str) -> bytes:
        """The ids of a text as packed 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()


_loaded: dict[int, PrefixEncoder] = {}


def encoder(content: bytes) -> PrefixEncoder:
    """One encoder a process."""
    key = hash(content)
    if key not in _loaded:
        _loaded[key] = PrefixEncoder(content)
    return _loaded[key]

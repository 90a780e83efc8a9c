"""Exact encoding with public byte-pair vocabularies, shared by the token operators.

A slice of texts is cut into pre-tokens with array operations, the different pre-tokens are
looked up in a bounded per-worker table, and only those not seen before are encoded: first
as one whole token where that is proved, else by speculation (greedy longest match, every
adjacent pair tested for compatibility), else by exact merging. All of Unicode goes this way:
letters are classed by tables over all code points, filled as code points are met, and texts with
the strings of special tokens are cut at them. Within a slice pre-tokens are told apart by 64-bit
hashes; the worker's table knows them by their letters.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from quarryline.llm.common import mix

#: Different pre-tokens kept by a worker before its table starts afresh.
TABLE_LIMIT = 600_000
#: Bytes of a pre-token beyond which it is merged by a heap of its own; ids are the same either way.
LONG = 1024
_LETTER, _NUMBER, _OTHER, _SPACE = 0, 1, 2, 3


def tokenizer_path(name: str) -> str:
    return public_tokenizers.path(name)


@functools.cache
def library(path: str) -> Tokenizer:
    """The library's tokenizer without truncation or padding."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Letters:
    """Class, lower case and a random 64-bit value of every code point; classes and lower cases are filled as code points are met.

    The class of a code point is what the pre-tokenizer's pattern takes it for: it is asked once for each code point whether it joins
    a letter, a number or another sign.
    """

    UNKNOWN = -2

    def __init__(self):
        self.classes = np.full(0x110000, self.UNKNOWN, np.int8)
        self.lower = np.arange(0x110000, dtype=np.uint32)
        self.values = np.random.default_rng(7).integers(1, 2**63, 0x110000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.learn(np.arange(0x180))

    def meet(self, codes: np.ndarray) -> None:
        new = codes[self.classes[codes] == self.UNKNOWN]
        if len(new):
            self.learn(np.unique(new))

    def learn(self, codes: np.ndarray) -> None:
        folded = normalizers.Lowercase()
        for c in codes.tolist():
            small = folded.normalize_str(chr(c))
            if len(small) == 1:
                self.lower[c] = ord(small)
        codes = np.unique(np.concatenate([codes, self.lower[codes]]))
        asked = "".join(f"\na{chr(c)}\n1{chr(c)}\n!{chr(c)}" for c in codes.tolist())
        pieces = {span for _, span in pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(asked)}
        for i, c in enumerate(codes.tolist()):
            at = 9 * i + 1
            joins = [(at + 3 * k, at + 3 * k + 2) in pieces for k in range(3)]
            self.classes[c] = joins.index(True) if any(joins) else _SPACE


@functools.cache
def letters_table() -> Letters:
    return Letters()


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64 for i below n; one table of the longest slice so far."""
    if not _POWERS or len(_POWERS[0]) < n:
        base, size = 0xD6E8FEB86659FD93, n + n // 8
        with np.errstate(over="ignore"):
            made = [np.full(size, b, np.uint64) for b in (base, pow(base, -1, 1 << 64))]
            for table in made:
                table[:1] = 1
                np.cumprod(table, out=table)
        _POWERS[:] = made
    return _POWERS[0][:n], _POWERS[1][:n]


@functools.cache
def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in kept)
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


def merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Exact byte-pair merging: the pair of lowest rank first, the leftmost among equals."""
    parts, get, none = list(symbols), ranks.get, 1 << 30
    order = [get(pair, none) for pair in zip(parts, parts[1:])]
    while order:
        least = min(order)
        if least == none:
            break
        i = order.index(least)
        parts[i] += parts.pop(i + 1)
        del order[i]
        if i < len(order):
            order[i] = get((parts[i], parts[i + 1]), none)
        if i:
            order[i - 1] = get((parts[i - 1], parts[i]), none)
    return parts


class Vocabulary:
    """A byte-pair vocabulary: with word ends (lower case, white space dropped) or byte-level with spaces kept."""

    #: Size of the hash table of merges, about a tenth full.
    HASH_BITS = 19

    def __init__(self, path: str, speculation: bool = False):
        self.speculation = speculation
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.path = path
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special_at = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.ids: dict[str, int] = model["vocab"]
        self.strings = {i: s for s, i in self.ids.items()}
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        #: Strings proved to encode alone as the one token that they are.
        self.whole = {s for s in self.ids if merge(self.symbols(s), self.ranks) == [s]}
        back = {ord(c): b for b, c in _byte_letters().items()}
        self.alone: dict[str, int] = {}
        for s in self.whole:
            if s.endswith(self.end) and len(s) > len(self.end):
                try:
                    self.alone[s[: len(s) - len(self.end)].translate(back).encode("latin-1").decode()] = self.ids[s]
                except UnicodeError:
                    pass  # a part of a letter is no pre-token
        letter = _byte_letters()
        self.base = np.array([self.ids[letter[b]] for b in range(256)], np.int64)
        self.base_end = np.array([self.ids[letter[b] + self.end] for b in range(256)], np.int64)
        keys = np.array([(self.ids[a] << 32) | self.ids[b] for a, b in self.ranks], np.int64)
        made = np.array([self.ids[a + b] for a, b in self.ranks], np.int64)
        self.merge_keys, self.merge_rank, self.merge_made = keys, np.arange(len(keys)), made
        self._merge_ranks: dict[int, int] | None = None
        self.hash_at = np.full(1 << self.HASH_BITS, -1, np.int32)
        with np.errstate(over="ignore"):
            slots = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.HASH_BITS)).tolist()
        taken: dict[int, int] = {}
        for i, slot in enumerate(slots):
            while slot in taken:
                slot = (slot + 1) & ((1 << self.HASH_BITS) - 1)
            taken[slot] = i
        self.hash_at[list(taken)] = list(taken.values())
        self.longest: dict[str, int] = {}
        for s in self.whole:
            body = s[:2]
            self.longest[body] = max(self.longest.get(body, 0), len(s))
            self.longest[s[0]] = max(self.longest.get(s[0], 0), 1)
        self.pair_keys, self.pair_fits = np.zeros(0, np.int64), np.zeros(0, bool)
        self.exact_merges = self.seen = self.spoken_whole = 0
        self._fresh()

    def _fresh(self) -> None:
        self.rows: dict[str, int] = {}
        self.flat, self.begin, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 15, np.int64), 0

    def symbols(self, string: str) -> list[str]:
        """A vocabulary string's smallest parts; a word end belongs to the letter before it."""
        if self.end and string.endswith(self.end) and len(string) > len(self.end):
            body = string[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(string)

    # pre-tokens

    def prepared(self, text: str) -> str:
        """The text as it is cut: where words end and letters are small, composed, and without the one letter whose small form is two."""
        if not self.end or text.isascii():
            return text
        if not unicodedata.is_normalized("NFC", text):
            text = normalizers.NFC().normalize_str(text)
        return text.replace("\u0130", "i\u0307")

    def cut(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """All texts end to end as they are looked up, starts and ends of their pre-tokens, and the number of pre-tokens of each text."""
        texts = [self.prepared(t) for t in texts]
        joined = "".join(texts)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        table = letters_table()
        table.meet(codes)
        if self.end:
            codes = table.lower[codes]
            joined = codes.tobytes().decode("utf-32-le")
        classes = table.classes
        self._codes = codes
        n = len(codes)
        if not n:
            return joined, offsets[:0], offsets[:0], np.zeros(len(texts), np.int64)
        kind = classes[codes]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        none = np.full(1, -1, kind.dtype)  # of the same type, so that nothing is widened
        before = np.concatenate([none, kind[:-1]])
        before[first[:-1]] = -1
        after = np.concatenate([kind[1:], none])
        after[first[1:]] = -1
        start = before != kind
        space = kind == _SPACE
        if self.end:
            start |= (kind == _NUMBER) | space
        else:
            blank_before = np.concatenate([[False], codes[:-1] == 32]) & (before == _SPACE)
            start &= space | ~blank_before
            start |= space & (after >= 0) & (after != _SPACE)
        quote = np.flatnonzero(codes == 39)
        if len(quote):
            prev = before[quote]
            free = (prev != _OTHER) if self.end else (prev == -1) | (prev == _LETTER) | (prev == _NUMBER) | ((prev == _SPACE) & (codes[quote - 1] != 32))
            quote = quote[free]
            stop = offsets[np.searchsorted(offsets, quote, side="right")]
            padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
            one, two = np.where(quote + 1 < stop, padded[quote + 1], 0), np.where(quote + 2 < stop, padded[quote + 2], 0)
            length = np.where(np.isin(one, [115, 116, 109, 100]), 2, 0)  # 's 't 'm 'd
            pair = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)  # 're 've 'll
            length = np.where(pair, 3, length)
            quote, length, stop = quote[length > 0], length[length > 0], stop[length > 0]
            start[quote + 1] = False
            behind = quote + length
            inside = behind < stop
            start[behind[inside][~(space[behind[inside]])]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], n)
        if self.end:
            keep = ~space[starts]
            starts, ends = starts[keep], ends[keep]
        counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
        return joined, starts, ends, counts

    def _hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        codes, values = self._codes, letters_table().values
        power, inverse = _powers(len(codes))
        with np.errstate(over="ignore"):
            total = np.zeros(len(codes) + 1, np.uint64)
            total[1:] = values[codes]
            total[1:] *= power
            np.cumsum(total, out=total)
            return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))

    # encoding of different pre-tokens

    def letters(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(_byte_letters())

    def speculate(self, string: str) -> list[str] | None:
        """Greedy longest match over the proved strings; None where it gets stuck."""
        out, at, n, whole, longest, end = [], 0, len(string), self.whole, self.longest, self.end
        body = n - len(end)
        while at < n:
            most = min(n, at + longest.get(string[at : at + 2], longest.get(string[at], 0)))
            while most > at:
                if (not end or most < body or most == n) and string[at:most] in whole:
                    break
                most -= 1
            if most <= at:
                return None
            out.append(string[at:most])
            at = most
        return out

    def fits(self, keys: np.ndarray) -> np.ndarray:
        """Whether each pair of ids (left << 32 | right), side by side, stays as it is under merging."""
        wanted = np.unique(keys)
        at = np.searchsorted(self.pair_keys, wanted)
        known = (at < len(self.pair_keys)) & (self.pair_keys[np.minimum(at, max(0, len(self.pair_keys) - 1))] == wanted) if len(self.pair_keys) else np.zeros(len(wanted), bool)
        new = wanted[~known]
        if len(new):
            if len(self.pair_keys) + len(new) > 4 * TABLE_LIMIT:
                self.pair_keys, self.pair_fits = np.zeros(0, np.int64), np.zeros(0, bool)
                new = wanted
            fits = []
            for key in new.tolist():
                a, b = self.strings[key >> 32], self.strings[key & 0xFFFFFFFF]
                fits.append(self._pair(a, b))
            keys_all, fits_all = np.concatenate([self.pair_keys, new]), np.concatenate([self.pair_fits, np.array(fits, bool)])
            order = np.argsort(keys_all, kind="stable")
            self.pair_keys, self.pair_fits = keys_all[order], fits_all[order]
        return self.pair_fits[np.searchsorted(self.pair_keys, keys)]

    def _pair(self, a: str, b: str) -> bool:
        return merge([*self.symbols_inside(a), *self.symbols(b)], self.ranks) == [a, b]

    def symbols_inside(self, string: str) -> list[str]:
        return list(string)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens end to end, and the number of each one's: whole tokens, then speculation with
        vectorised tests (where asked for), then exact merging of what is left."""
        found: list = [None if i is None else (i,) for i in map(self.alone.get, pieces)]
        rest = [i for i, x in enumerate(found) if x is None]
        self.seen, self.spoken_whole = self.seen + len(pieces), self.spoken_whole + len(pieces) - len(rest)
        if self.speculation and rest:
            left, right, owner, ids = [], [], [], self.ids
            for i in rest:
                guess = self.speculate(self.letters(pieces[i]) + self.end)
                if guess is not None:
                    found[i] = guess = [ids[g] for g in guess]
                    left += guess[:-1]
                    right += guess[1:]
                    owner += [i] * (len(guess) - 1)
            if owner:
                bad = ~self.fits((np.array(left, np.int64) << 32) | np.array(right, np.int64))
                for i in set(np.array(owner)[bad].tolist()):
                    found[i] = None
            rest = [i for i in rest if found[i] is None]
        self.exact_merges += len(rest)
        sizes = np.array([0 if x is None else len(x) for x in found], np.int64)
        merged, lengths = self.merge_all([pieces[i].encode() for i in rest])
        sizes[rest] = lengths
        total = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.zeros(total[-1], np.uint32)
        chosen = np.zeros(len(pieces), bool)
        chosen[rest] = True
        mask = np.repeat(chosen, sizes)
        flat[mask] = merged
        flat[~mask] = np.fromiter((i for x in found if x is not None for i in x), np.uint32)
        return flat, sizes

    def _ranks(self, left: np.ndarray, right: np.ndarray, same: np.ndarray, none: np.int64) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of ids (none where it doesn't merge) and the id that it makes."""
        pair = (left << 32) | right
        slot = (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.HASH_BITS)
        rank, made = np.full(len(pair), none), np.zeros(len(pair), np.int64)
        open_ = np.flatnonzero(same)
        slot = slot.astype(np.int64)
        while len(open_):
            at = self.hash_at[slot[open_]]
            hit = self.merge_keys[at] == pair[open_]
            found = open_[hit & (at >= 0)]
            rank[found], made[found] = self.merge_rank[self.hash_at[slot[found]]], self.merge_made[self.hash_at[slot[found]]]
            open_ = open_[~hit & (at >= 0)]
            slot[open_] = (slot[open_] + 1) & ((1 << self.HASH_BITS) - 1)
        return rank, made

    def merge_long(self, piece: bytes) -> list[int]:
        """Exact merging of one long pre-token: a heap of (rank, place) over neighbours, the leftmost among equals first."""
        raw = np.frombuffer(piece, np.uint8)
        symbols = self.base[raw]
        symbols[-1] = self.base_end[raw[-1]]
        none = np.int64(1 << 40)
        rank, _ = self._ranks(symbols[:-1], symbols[1:], np.ones(len(raw) - 1, bool), none)
        at = np.flatnonzero(rank < none)
        ids, n, merges = symbols.tolist(), len(raw), self._merges()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap, bits = np.sort((rank[at] << 32) | at).tolist(), (1 << 32) - 1  # sorted, so a heap
        pop, push, get, pairs = heapq.heappop, heapq.heappush, merges.get, self._merge_pairs
        while heap:
            top = pop(heap)
            i, (left, right, made) = top & bits, pairs[top >> 32]
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two has been merged since
            k = after[j]
            ids[i], ids[j], after[i] = made, -1, k
            if k < n:
                before[k] = i
                if (r := get((made << 32) | ids[k])) is not None:
                    push(heap, (r << 32) | i)
            h = before[i]
            if h >= 0 and (r := get((ids[h] << 32) | made)) is not None:
                push(heap, (r << 32) | h)
        return [x for x in ids if x >= 0]

    def _merges(self) -> dict[int, int]:
        """The rank of each pair of ids; made when a worker meets its first long pre-token."""
        if self._merge_ranks is None:
            keys, made = self.merge_keys.tolist(), self.merge_made.tolist()
            self._merge_pairs = [(k >> 32, k & 0xFFFFFFFF, m) for k, m in zip(keys, made)]
            self._merge_ranks = dict(zip(keys, self.merge_rank.tolist()))
        return self._merge_ranks

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many pre-tokens: those of more than LONG bytes one by one, the rest at once."""
        long = [i for i, p in enumerate(pieces) if len(p) > LONG]
        if not long:
            return self.merge_short(pieces)
        short = [i for i, p in enumerate(pieces) if len(p) <= LONG]
        flat, sizes = self.merge_short([pieces[i] for i in short])
        parts: list = [None] * len(pieces)
        for i, found in zip(short, np.split(flat, np.cumsum(sizes)[:-1]) if short else []):
            parts[i] = found
        for i in long:
            parts[i] = np.array(self.merge_long(pieces[i]), np.uint32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def merge_short(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many pre-tokens at once, as arrays.

        In each round every pre-token merges all places of its pair of lowest rank. Where they overlap (runs
        of one letter) every other one is taken, from the left. A round passes over all that is left, and a pre-token has
        as many rounds as pairs of different rank, so that this is for pre-tokens of ordinary length.
        """
        lengths = np.array([len(p) for p in pieces], np.int64)
        if not len(pieces):
            return np.zeros(0, np.uint32), lengths
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = self.base[raw]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        last = np.cumsum(lengths) - 1
        symbols[last] = self.base_end[raw[last]]
        none, made = np.int64(1 << 40), None
        rank, made = self._ranks(symbols[:-1], symbols[1:], owner[:-1] == owner[1:], none)
        rank, made = np.append(rank, none), np.append(made, 0)
        done_symbols, done_owner = [], []
        while len(symbols):
            n = len(symbols)
            head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            width = np.diff(np.append(head, n))
            least = np.minimum.reduceat(rank, head)
            best = np.flatnonzero((rank == np.repeat(least, width)) & (rank < none))
            lone = np.append(True, np.diff(best) > 1)  # pairs that overlap: runs of one letter
            place = best[(np.arange(len(best)) - np.flatnonzero(lone)[np.cumsum(lone) - 1]) % 2 == 0] if len(best) else best
            symbols[place] = made[place]
            going = np.repeat(least < none, width)
            drop = np.zeros(n, bool)
            drop[place + 1] = True
            done_symbols.append(symbols[~going])
            done_owner.append(owner[~going])
            keep = going & ~drop
            now = (np.cumsum(keep) - 1)[place]
            symbols, owner, rank, made = symbols[keep], owner[keep], rank[keep], made[keep]
            if not len(symbols):
                break
            near = np.zeros(len(symbols), bool)
            near[now] = near[np.maximum(now - 1, 0)] = True
            touched = np.flatnonzero(near)
            after = np.minimum(touched + 1, len(symbols) - 1)
            rank[touched], made[touched] = self._ranks(symbols[touched], symbols[after], (owner[touched] == owner[after]) & (after > touched), none)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order].astype(np.uint32), np.bincount(owner, minlength=len(pieces)).astype(np.int64)

    # texts

    def _rows(self, joined: str, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table's row of each pre-token; pre-tokens not in it are encoded and added."""
        told = pa.array(hashes).dictionary_encode()  # by a hash table, in order of appearance
        inverse, at = np.asarray(told.indices), np.zeros(len(told.dictionary), np.int64)
        at[inverse[::-1]] = np.arange(len(hashes))[::-1]  # the first place of each
        keys = [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        if len(self.rows) + len(keys) > TABLE_LIMIT:
            self._fresh()
        rows = list(map(self.rows.get, keys))
        new = [i for i, r in enumerate(rows) if r is None]
        if new:
            pieces = [keys[i] for i in new]
            base = len(self.rows)
            flat, sizes = self.encode_pieces(pieces)
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while base + len(new) + 1 > len(self.begin):
                self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.flat[self.used : self.used + len(flat)] = flat
            self.begin[base + 1 : base + len(new) + 1] = self.used + np.cumsum(sizes)
            self.used += len(flat)
            for row, slot in enumerate(new, base):
                self.rows[keys[slot]] = rows[slot] = row
        return np.array(rows, np.int64)[inverse]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        return self._each(texts, False)[1]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of each text's."""
        return self._each(texts, True)

    def _each(self, texts: list[str], want_ids: bool) -> tuple[np.ndarray, np.ndarray]:
        if self.special_at is None or not any(s in t for t in texts for s in self.special):
            return self._ordinary(texts, want_ids)
        # Texts are cut at special strings: every other part of a text is one of them.
        parts = [self.special_at.split(t) for t in texts]
        flat, counts = self._ordinary([p for found in parts for p in found[::2]], want_ids)
        offsets, k, out, sizes = np.concatenate([[0], np.cumsum(counts)]), 0, [], []
        for found in parts:
            n = (len(found) + 1) // 2
            sizes.append(int(offsets[k + n] - offsets[k]) + n - 1)
            for i in range(n if want_ids else 0):
                out.append(flat[offsets[k + i] : offsets[k + i + 1]])
                if i < n - 1:
                    out.append(np.array([self.special[found[2 * i + 1]]], np.uint32))
            k += n
        return np.concatenate(out) if out else flat, np.array(sizes, np.int64)

    def _ordinary(self, texts: list[str], want_ids: bool) -> tuple[np.ndarray, np.ndarray]:
        """Texts without special strings."""
        joined, starts, ends, pieces = self.cut(texts)
        flat, counts = np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if len(starts):
            rows = self._rows(joined, self._hashes(starts, ends), starts, ends)
            begin = self.begin[rows]
            size = self.begin[rows + 1] - begin
            total = np.concatenate([[0], np.cumsum(size)])
            stops = np.concatenate([[0], np.cumsum(pieces)])
            counts = total[stops[1:]] - total[stops[:-1]]
            if want_ids:
                flat = self.flat[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        return flat, counts


@functools.cache
def vocabulary(path: str, speculation: bool = False) -> Vocabulary:
    """The worker's own copy; its table lives as long as the worker."""
    return Vocabulary(path, speculation)

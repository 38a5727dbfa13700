"""Token ids of whole texts by a public tokenizer file.

Both supported kinds of file have borders that no token crosses. ``word_bpe`` drops white space, so words are on their
own. In ``byte_bpe`` a space before a word opens the word's first token, and of other white space between words all but
the last character is one run of tokens, the last another. So a text is cut into pieces at these borders; a piece of up
to ``SHORT`` bytes is encoded once by the tokenizers library and remembered with its bytes under a 64-bit hash, and texts
are put together from pieces in numpy. A piece that is found has its bytes compared, so no collision of hashes changes an
id. Longer pieces, as of scripts without spaces, are encoded where they occur and not remembered, so what a worker holds
is bounded in bytes. A text with white space beyond ASCII's, or with an added token's string, goes to the library as a whole.
"""

from __future__ import annotations

import os
import re
from codecs import charmap_decode
from unicodedata import is_normalized

import numpy as np

from .common import U64, Grown, mix, ranges
from .words import Words

#: White space beyond ASCII's, and marks of no width: texts with them are encoded as a whole.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeff]")
#: Characters that may follow a run of letters in a piece and surely part from it.
PUNCTUATION = ".,;:!?*%$&#()"
#: The characters by which these models know the 256 bytes: printable ones stand for themselves, others follow from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: The same as one string, by byte.
SHOWN = "".join(chr(BYTES.get(b, b)) for b in range(256))
#: Pieces that are remembered at most, and the bytes of the longest; beyond that number, all are forgotten.
MOST, SHORT = 1_600_000, 48


class HashIndex:
    """Numbers of 64-bit hashes, by open addressing in numpy."""

    def __init__(self):
        self.n = 0
        self._room(1 << 16)

    def _room(self, size: int) -> None:
        self.keys, self.values, self.shift = np.zeros(size, U64), np.zeros(size, np.int32), U64(64 - size.bit_length() + 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if there is none."""
        out = np.full(len(h), -1, np.int32)
        left = np.arange(len(h))
        slot = (h >> self.shift).astype(np.int64)
        while len(left):
            key = self.keys[slot]
            hit = key == h[left]
            out[left[hit]] = self.values[slot[hit]]
            more = ~hit & (key != 0)
            left, slot = left[more], (slot[more] + 1) % len(self.keys)
        return out

    def add(self, h: np.ndarray) -> None:
        """Number new, distinct hashes in their order."""
        if 2 * (self.n + len(h)) > len(self.keys):
            used = self.keys != 0
            keys, values = self.keys[used], self.values[used]
            size = len(self.keys)
            while size < 4 * (self.n + len(h)):
                size *= 2
            self._room(size)
            self._put(keys, values)
        self._put(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.n += len(h)

    def _put(self, h: np.ndarray, v: np.ndarray) -> None:
        slot = (h >> self.shift).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            take = free[first]
            self.keys[slot[take]], self.values[slot[take]] = h[take], v[take]
            rest = np.ones(len(h), bool)
            rest[take] = False
            h, v, slot = h[rest], v[rest], (slot[rest] + 1) % len(self.keys)


class Encoder:
    def __init__(self, path: str, spaces_kept: bool, most: int = MOST):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.most = most
        self.t, self.kept = Tokenizer.from_file(path), spaces_kept
        #: In a text with one of these the library looks for borders on each side of it.
        self.special = [a.content for a in self.t.get_added_tokens_decoder().values()]
        self.tails: dict[str, list[int]] = {"": []}
        self.reset()

    def reset(self) -> None:
        self.index = HashIndex()
        self.ids, self.start, self.len = Grown(np.uint32), Grown(np.uint32), Grown(np.uint32)
        #: Of remembered pieces, their lengths and their bytes by eights.
        self.size, self.at, self.eights = Grown(np.uint8), Grown(np.uint32), Grown(U64)

    def pieces(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, end, text) of the pieces of all texts, in order."""
        of = np.repeat(np.arange(len(w.lens)), w.lens)
        if not self.kept:
            return w.hash, w.start, w.end, of
        # what lies between a word and what is before it in its text, and what lies behind the last word
        text_start = w.borders - w.sizes
        first = np.cumsum(w.lens) - w.lens
        before = np.concatenate([[0], w.end[:-1]]) if len(w.end) else w.end
        has = w.lens > 0
        before[first[has]] = text_start[has]
        gap = w.start - before
        spaced = (gap > 0) & (w.buffer[np.maximum(w.start - 1, 0)] == 32)
        hashes, starts, ends, texts, order = [mix(w.hash + spaced.astype(U64))], [w.start - spaced], [w.end], [of], [3 * w.start + 2]
        run = np.flatnonzero(gap > 1)
        one = np.flatnonzero((gap > 0) & ~spaced)
        behind = np.where(has, w.end[np.minimum(np.cumsum(w.lens) - 1, max(len(w.end) - 1, 0))] if len(w.end) else 0, text_start)
        last = np.flatnonzero(w.borders - 1 > behind)
        for s, e, t in ((before[run], w.start[run] - 1, of[run]), (w.start[one] - 1, w.start[one], of[one]), (behind[last], w.borders[last] - 1, last)):
            key = np.fromiter((hash_space(w.buffer[a:b]) for a, b in zip(s.tolist(), e.tolist())), U64, len(s))
            for out, v in zip((hashes, starts, ends, texts, order), (key, s, e, t, 3 * s)):
                out.append(v)
        at = np.argsort(np.concatenate(order), kind="stable")
        return tuple(np.concatenate(x)[at] for x in (hashes, starts, ends, texts))

    def encode(self, pieces: list[str]) -> None:
        """Add the ids of pieces at the end; letters and the punctuation behind them are never in one token."""
        tokenize, kept, rest = self.t.model.tokenize, self.kept, []
        # ids of all pieces lie in one list, as a list for each would be work for the collector
        flat: list[int] = []
        ends: list[int] = []
        for i, p in enumerate(pieces):
            core = p[1:] if kept and p[:1] == " " else p
            tail, body = "", p
            if not (core.isascii() and core.isalpha()):
                body = p.rstrip(PUNCTUATION)
                core = body[1:] if kept and body[:1] == " " else body
                if not core.isalpha() or not core.isascii() and not (is_normalized("NFC", core) and "Σ" not in core and core.lower().isalpha()):
                    rest.append(i)
                    ends.append(len(flat))
                    continue
                tail = p[len(body) :]
                if tail not in self.tails:
                    if len(self.tails) > 10_000:
                        self.tails = {"": []}
                    self.tails[tail] = self.t.encode(tail, add_special_tokens=False).ids
            # a run of letters is one word to the model, so nothing has to look for borders in it
            run = body if kept else body.lower()
            flat += [k.id for k in tokenize(charmap_decode(run.encode(), "strict", SHOWN)[0])]
            if tail:
                flat += self.tails[tail]
            ends.append(len(flat))
        lens = np.diff(np.array([0, *ends]))
        start = np.array(ends, np.int64) - lens
        for i, e in zip(rest, self.t.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)):
            start[i], lens[i] = len(flat), len(e.ids)
            flat += e.ids
        self.start.extend(self.ids.n + start)
        self.len.extend(lens)
        self.ids.extend(np.array(flat, np.uint32))

    def learn(self, w: Words, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Encode and remember short pieces with new, distinct hashes."""
        self.encode(texts_at(w, start, end))
        size = end - start
        eights = -(-size // 8)
        self.size.extend(size)
        self.at.extend(self.eights.n + np.cumsum(eights) - eights)
        step = ranges(eights) * 8
        self.eights.extend(w.eight(np.repeat(start, eights) + step, np.repeat(size, eights) - step))
        self.index.add(h)

    def same(self, w: Words, found: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the remembered pieces ``found`` (all are numbers) have the bytes at these places."""
        size = end - start
        ok = self.size.a[found] == size
        left, done = np.flatnonzero(ok), 0
        while len(left):
            ok[left] = self.eights.a[self.at.a[found[left]] + done // 8] == w.eight(start[left] + done, size[left] - done)
            done += 8
            left = left[ok[left] & (size[left] > done)]
        return ok

    def __call__(self, texts: list[str], terms: bool = False) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """(ids, hashes of the pieces or None) of each text."""
        if self.index.n > self.most:
            self.reset()
        odd = [ODD_SPACE.search(t) is not None or any(s in t for s in self.special) for t in texts]
        w = Words([b"" if o else t.encode() for t, o in zip(texts, odd)])
        h, start, end, of = self.pieces(w)
        short = end - start <= SHORT
        found = np.where(short, self.index.find(h), -1)
        new = np.flatnonzero(short & (found < 0))
        if len(new):
            _, first = np.unique(h[new], return_index=True)
            first = new[first]
            self.learn(w, h[first], start[first], end[first])
            found[new] = self.index.find(h[new])
        at = np.flatnonzero(short)
        found[at[~self.same(w, found[at], start[at], end[at])]] = -1
        # long pieces, and others under the hash of one that is known, are encoded here and forgotten
        alone, n_ids = np.flatnonzero(found < 0), self.ids.n
        found[alone] = self.index.n + np.arange(len(alone))
        self.encode(texts_at(w, start[alone], end[alone]))
        n = self.len.a[found].astype(np.int64)
        ids = self.ids.a[np.repeat(self.start.a[found].astype(np.int64), n) + ranges(n)]
        self.ids.n, self.start.n, self.len.n = n_ids, self.index.n, self.index.n
        if len(self.ids.a) > 2 * n_ids + (8 << 20):  # room that one long text took
            self.ids.a = self.ids.a[: n_ids + 1024].copy()
        cut = np.append(0, np.cumsum(np.bincount(of, minlength=len(texts))))
        ends = np.append(0, np.cumsum(n))[cut]
        term = (h & U64(0xFFFFFFFF)).astype(np.uint32) if terms else None
        out = []
        for i, t in enumerate(texts):
            if odd[i]:
                parts = Words([t.encode()]).hash if terms else None
                out.append((np.array(self.t.encode(t, add_special_tokens=False).ids, np.uint32), None if parts is None else (parts & U64(0xFFFFFFFF)).astype(np.uint32)))
            else:
                out.append((ids[ends[i] : ends[i + 1]], None if term is None else term[cut[i] : cut[i + 1]]))
        return out


def texts_at(w: Words, start: np.ndarray, end: np.ndarray) -> list[str]:
    if not len(start):
        return []
    flat = w.buffer.tobytes()
    return [flat[a:b].decode() for a, b in zip(start.tolist(), end.tolist())]


def hash_space(x: np.ndarray) -> int:
    """Of white space alone, so that no word has the same but by chance."""
    import xxhash

    return xxhash.xxh3_64_intdigest(b"\n" + x.tobytes()) or 1


_encoders: dict[tuple[str, bool, int], Encoder] = {}


def encoder(path: str, spaces_kept: bool, most: int = MOST) -> Encoder:
    """One encoder for each Python worker."""
    key = path, spaces_kept, most
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(*key)
    return _encoders[key]

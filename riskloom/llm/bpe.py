"""Byte-level BPE over Arrow batches: words are cut with numpy, merged once each, then gathered.

The vocabulary is a public `tokenizers` JSON file, named by path. Texts whose characters all lie
in the Latin blocks are cut into pre-tokens by array operations, and each pre-token's ids come
from a table that keeps what has been merged before, with its characters, which are compared: a
pre-token of an equal hash but other characters is merged by itself. Every other text, and every text
that holds a special token's string, goes through `tokenizers` itself. Both give the same ids.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np

from riskloom.llm.kernels import span_hashes

#: Code points under this are cut by the array path.
LATIN = 0x250
#: Pre-token contractions of the vocabulary's public pattern (fixed values): 's 't 'm 'd and 're 've 'll.
ONE, TWO = "stmd", ("re", "ve", "ll")
#: Places of the table, and ids and characters it keeps at most before it starts anew (some 60 MB in all).
_SLOTS, _POOL = 1 << 20, 4 << 20
_loaded: dict[str, "Bpe"] = {}


def _byte_letters() -> dict[str, int]:
    """Byte-level BPE writes bytes as printable characters: the printable ones as themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.whole = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        letters, special = _byte_letters(), set(self.special)
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.zero = ranks[b"\x00"]
        self.merge = tiktoken.Encoding("merge", pat_str=r"[^\x00]+|\x00", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        kinds = {"L": 1, "N": 2}
        self.kind = np.array([3 if chr(c).isspace() and c not in range(0x1C, 0x20) else kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(LATIN)], np.uint8)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.off, self.len = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.int32), np.zeros(_SLOTS, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.said, self.chars, self.told = np.zeros(_SLOTS, np.int32), np.zeros(1 << 16, np.uint16), 0  # characters of each place

    def _add(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Merge words, a NUL between two, in one call; a word with a NUL is a run of them by itself."""
        nul = [i for i, t in enumerate(texts) if "\x00" in t]
        got = np.array(self.merge("\x00".join("" if "\x00" in t else t for t in texts)), np.uint32)
        cut = np.concatenate([[-1], np.flatnonzero(got == self.zero), [len(got)]])
        off, n = self.used + cut[:-1] + 1, np.diff(cut) - 1
        got = np.concatenate([got, *(np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, np.uint32) for i in nul)])
        end = self.used + cut[-1]
        for i in nul:
            n[i] = len(self.whole.encode(texts[i], add_special_tokens=False).ids)
            off[i], end = end, end + n[i]
        need = self.used + len(got)
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(got), len(self.pool)), np.uint32)])
        self.pool[self.used : need] = got
        self.used = need
        return off, n

    def _keep(self, cp: np.ndarray, s: np.ndarray, size: np.ndarray, h: np.ndarray, slot: np.ndarray, off: np.ndarray, n: np.ndarray) -> None:
        """Give new words their places with all they need; of words for one place the last gets it."""
        at = self.told + np.cumsum(size) - size
        need = self.told + int(size.sum())
        if need > len(self.chars):
            self.chars = np.concatenate([self.chars[: self.told], np.zeros(max(need - self.told, len(self.chars)), np.uint16)])
        self.chars[self.told : need] = cp[np.repeat(s - (at - self.told), size) + np.arange(need - self.told)]
        self.told = need
        last = len(slot) - 1 - np.unique(slot[::-1], return_index=True)[1]
        to = slot[last]
        self.keys[to], self.off[to], self.len[to], self.said[to] = h[last], off[last], n[last], at[last]

    def _starts(self, cp: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where pre-tokens start; cp: code points, at: the texts' offsets in them."""
        n, k = len(cp), self.kind[cp]
        border = np.zeros(n + 1, bool)
        border[at] = True
        start = np.ones(n + 1, bool)
        start[1:n] = k[1:] != k[:-1]
        start |= border
        white = k == 3
        # a run of white space gives its last character up to what follows in the same text
        last = np.flatnonzero(white[:-1] & ~white[1:] & ~border[1:n])
        start[last] = True
        start[last[cp[last] == 0x20] + 1] = False
        q = np.flatnonzero(cp[: n - 1] == 0x27)
        q = q[start[q] & start[q + 1] & ~border[q + 1] & (k[q + 1] == 1)]
        one = np.isin(cp[q + 1], [ord(c) for c in ONE])
        nxt = np.minimum(q + 2, n - 1)
        two = ~one & (q + 2 < n) & ~border[q + 2] & np.any([(cp[q + 1] == ord(a)) & (cp[nxt] == ord(b)) for a, b in TWO], axis=0)
        start[q[one | two] + 1] = False
        for hit, m in ((q[one], 2), (q[two], 3)):
            end = hit + m
            inner = end[end < n]
            start[inner[k[inner] == 1]] = True
        return np.flatnonzero(start[:n])

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of consecutive UTF-8 texts, and each text's number of ids."""
        counts, parts = np.zeros(len(at) - 1, np.int64), []
        raw = data.tobytes()
        slow = np.zeros(len(at) - 1, bool)
        wide = np.flatnonzero(data >= 0xC9)  # 0xC8 leads the last Latin block whole; 0xC9 goes on beyond it
        if len(wide):
            slow[np.unique(np.searchsorted(at, wide, "right") - 1)] = True
        for mark in self.special:
            m, p = mark.encode(), raw.find(mark.encode())
            while p >= 0:
                slow[int(np.searchsorted(at, p, "right")) - 1] = True
                p = raw.find(m, p + 1)
        i = 0
        while i < len(slow):
            j = i + 1
            while j < len(slow) and slow[j] == slow[i]:
                j += 1
            if slow[i]:
                for r in range(i, j):
                    ids = self.whole.encode(raw[at[r] : at[r + 1]].decode("utf-8", "replace"), add_special_tokens=False).ids
                    counts[r] = len(ids)
                    parts.append(np.array(ids, np.uint32))
            else:
                ids, n = self._latin(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                counts[i:j] = n
                parts.append(ids)
            i = j
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), counts

    def _latin(self, raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not raw:
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        text = raw.decode("utf-8")
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lead = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=lead[1:])
        at = lead[at]
        s = self._starts(cp, at)
        e = np.append(s[1:], len(cp))
        if max(self.used, self.told) > _POOL:
            self._clear()
        h, size = span_hashes(cp, s, e), e - s
        slot = (h >> np.uint64(44)).astype(np.int64)
        off, n = self.off[slot].astype(np.int64), self.len[slot].astype(np.int64)
        known = self.keys[slot] == h
        # pre-tokens tile the text: compare every character with that of the place, known or not
        at_char = np.repeat(self.said[slot] - s, size) + np.arange(len(cp))
        differs = self.chars[np.minimum(at_char, max(0, self.told - 1))] != cp
        known &= ~np.logical_or.reduceat(differs, s)
        miss = np.flatnonzero(~known)
        if len(miss):
            texts: dict[str, int] = {}
            back = np.array([texts.setdefault(text[a:b], len(texts)) for a, b in zip(s[miss].tolist(), e[miss].tolist())])
            first = np.unique(back, return_index=True)[1]
            pick = miss[first]
            o, m = self._add(list(texts))
            off[miss], n[miss] = o[back], m[back]
            self._keep(cp, s[pick], size[pick], h[pick], slot[pick], o, m)
        ends = np.cumsum(n)
        ids = self.pool[np.repeat(off - (ends - n), n) + np.arange(int(ends[-1]))]
        upto = np.concatenate([[0], ends])[np.searchsorted(s, at)]
        return ids, np.diff(upto)


def unload() -> None:
    """Forget all tables (a fifth of a second builds one): workers live on when packing is done."""
    _loaded.clear()


def load(path: str) -> Bpe:
    """One table per Python worker and vocabulary, until `unload`."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]

"""Token ids of a byte-level BPE vocabulary, by the tokenizers library, with each distinct pre-token encoded once.

The library encodes about a megabyte a second. A byte-level BPE never merges across pre-tokens, and a corpus
repeats its pre-tokens, so texts are cut into pre-tokens in numpy, distinct ones are looked up by a 64-bit hash,
and only those not seen before go to the library. Texts with characters whose class may differ between Unicode
versions, texts that hold the string of an added token, and any tokenizer of another kind, go to the library whole.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np

from .common import RunHasher, ranges, row_runs

#: A worker keeps at most this many pre-tokens; beyond that it starts anew.
MEMO = 1_500_000
#: Characters that are encoded at once; a longer text is cut where a blank lies between two ASCII letters, over which no pre-token reaches.
RUN = 1 << 19
CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
OTHER, LETTER, NUMBER, SPACE, UNSURE = range(5)
#: The characters of the Unicode property White_Space.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point; UNSURE where Unicode 3.2 and this Python's Unicode differ."""
    now, old = unicodedata.category, unicodedata.ucd_3_2_0.category
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.full(0x110000, UNSURE, np.uint8)
    for c in range(0x30000):
        k = now(chr(c))
        if k != "Cn" and k[0] == old(chr(c))[0]:
            out[c] = kinds.get(k[0], OTHER)
    out[WHITE] = SPACE
    return out


def pretokens(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in the code points of several texts, as a mask.

    The pattern is 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+.
    """
    n = len(cp)
    kind = classes()[cp]
    first = np.zeros(n + 1, bool)  # of a text; n as the end of the last
    first[starts[starts < n]] = True
    first[n] = True
    run = first.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    glued = np.zeros(n, bool)  # preceded by a single blank of the same text, which belongs to this run
    glued[1:] = (cp[:-1] == 32) & ~first[1:n] & ~space[1:]
    out = run[:n] & ~glued
    # The last character of a blank run before another run stands alone, or opens the next pre-token.
    last = space & run[1:] & ~first[1:]
    out |= last
    # Contractions: a lone apostrophe with letters behind it.
    for i in np.flatnonzero((cp == 39) & run[:n] & ~glued & run[1:]):
        if first[i + 1] or i + 1 >= n:
            continue
        a = cp[i + 1]
        if a in (115, 116, 109, 100):  # s t m d
            size = 1
        elif i + 2 < n and not first[i + 2] and (a, cp[i + 2]) in ((114, 101), (118, 101), (108, 108)):  # re ve ll
            size = 2
        else:
            continue
        out[i + 1] = False
        if i + 1 + size < n:
            out[i + 1 + size] = True
    return out


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        conf = json.load(open(path, encoding="utf-8"))
        self.added = [t["content"] for t in conf.get("added_tokens") or []]  # the library gives each its single id
        pre = conf.get("pre_tokenizer") or {}
        self.direct = conf.get("normalizer") is not None or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or conf["model"].get("type") != "BPE"
        self.size = self.tok.get_vocab_size()
        self.hasher = RunHasher()
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.count, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Encode words that are not in the memo; keys is ascending."""
        flat, count = [self.flat], np.zeros(len(words), np.int64)
        for i in range(0, len(words), 2000):
            e = self.tok.encode(words[i : i + 2000], is_pretokenized=True, add_special_tokens=False)
            flat.append(np.array(e.ids, np.uint32))
            np.add.at(count, np.array(e.word_ids, np.int64) + i, 1)
        at = len(self.flat) + np.cumsum(count) - count
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.count = np.insert(self.keys, where, keys), np.insert(self.at, where, at), np.insert(self.count, where, count)
        self.flat = np.concatenate(flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and n + 1 offsets. Texts are encoded in runs of about RUN characters."""
        if self.direct:
            return _joined(self._plain(texts))
        pieces, of = [], []
        for i, t in enumerate(texts):
            a = 0
            while len(t) - a > RUN and not any(x in t or " " in x for x in self.added) and (m := CUT.search(t, a + RUN // 2)):
                pieces.append(t[a : m.start()])
                of.append(i)
                a = m.start()
            pieces.append(t[a:] if a else t)
            of.append(i)
        ids, count = [], np.zeros(len(pieces), np.int64)
        for i, j in row_runs(np.concatenate([[0], np.cumsum([len(x) for x in pieces])]), RUN):
            x, at = self._run(pieces[i:j])
            ids.append(x)
            count[i:j] = np.diff(at)
        per_text = np.bincount(np.array(of, np.int64), count, len(texts)).astype(np.int64)
        return np.concatenate(ids or [np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum(per_text)])

    def _run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > MEMO:
            self._clear()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = classes()[cp]
        unsure = np.unique(np.searchsorted(ends, np.flatnonzero(kind == UNSURE), side="right"))
        if added := [a for a in self.added if a in joined]:
            unsure = np.union1d(unsure, [i for i, t in enumerate(texts) if any(a in t for a in added)]).astype(np.int64)
        begin = np.flatnonzero(pretokens(cp, starts, ends))
        lengths = np.diff(np.append(begin, len(cp)))
        ids, per_text = np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if len(begin):
            import pandas as pd

            code, uniq = pd.factorize(self.hasher(cp, begin, lengths))
            order = np.argsort(uniq)
            known = np.searchsorted(self.keys, uniq)
            found = np.zeros(len(uniq), bool) if not len(self.keys) else self.keys[np.minimum(known, len(self.keys) - 1)] == uniq
            new = order[~found[order]]
            if len(new):
                at = np.full(len(uniq), -1, np.int64)
                at[code[::-1]] = np.arange(len(code))[::-1]  # the first place of each
                b, n = begin[at[new]], lengths[at[new]]
                self._learn(uniq[new], [joined[x : x + y] for x, y in zip(b.tolist(), n.tolist())])
            known = np.searchsorted(self.keys, uniq)[code]
            count = self.count[known]
            ids = self.flat[ranges(self.at[known], count)]
            sums = np.concatenate([[0], np.cumsum(count)])
            edges = np.searchsorted(begin, np.append(starts, len(cp)))
            per_text = np.diff(sums[edges])
        offsets = np.concatenate([[0], np.cumsum(per_text)])
        if not len(unsure):
            return ids, offsets
        parts = [ids[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
        for i, x in zip(unsure.tolist(), self._plain([texts[i] for i in unsure.tolist()])):
            parts[i] = x
        return _joined(parts)


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(parts or [np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

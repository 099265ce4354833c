"""Token ids by the tokenizers library, with the ids of repeated words kept.

Most of the library's time goes into words that it has already seen. A text is therefore cut at
single spaces between two characters that are not white space. There both vocabularies here always
end one pre-token and start the next, so encoding the parts gives the ids of the whole
(tests/llm/test_ops.py compares the two on random texts). Words of plain letters are one pre-token, so the vocabulary's merges
are made for many of them at once, if a comparison at the start shows that this gives the same ids.
"""

from __future__ import annotations

import gc
import json
import os
import re

import numpy as np

_INNER = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"\s$|\s \s*$")
_SPACE = re.compile(r"\s")
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
#: A word with marks after it and perhaps the next line's first word; both vocabularies cut it into these groups.
_SHAPE = re.compile(f"({_LETTERS})([.,]+)?(?:(\n)({_LETTERS}))?")
_PLAIN = re.compile(_LETTERS)


def _stand_ins() -> list[str]:
    """The characters that stand for the 256 bytes in a byte-level vocabulary."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Merges:
    """Byte-pair merges of many words at once: in each round every word makes its leftmost merge of lowest rank, as the library does."""

    #: Bytes of a word, with one before it; a merge's key holds its rank and place.
    MOST = 63
    _NONE = 1 << 40

    def __init__(self, model: dict):
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("not plain byte-pair merges")
        vocabulary, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.inner = np.array([vocabulary.get(c, -1) for c in _stand_ins()], np.int64)
        self.last = np.array([vocabulary.get(c + suffix, -1) for c in _stand_ins()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        self.bits = (4 * len(pairs)).bit_length()
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self._NONE, np.int64)
        place, todo = self._hash(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[place[todo]] < 0]
            self.keys[place[free]], self.ranks[place[free]] = keys[free], free
            todo = todo[self.keys[place[todo]] != keys[todo]]
            place[todo] = (place[todo] + 1) & ((1 << self.bits) - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 32 | b
        place = self._hash(keys)
        found, out = self.keys[place], self.ranks[place]
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            place = (place[todo] if len(place) != len(todo) else place) + 1 & ((1 << self.bits) - 1)
            found = self.keys[place]
            out[todo] = self.ranks[place]
            on = (found != keys[todo]) & (found >= 0)
            out[todo[found < 0]] = self._NONE
            todo, place = todo[on], place[on]
        return out

    def encode(self, words: list[str], leading: bool) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of ids, ids of all words); the words are not empty, hold no space and are of `MOST` bytes at most."""
        data = np.frombuffer((" " + " ".join(words)).encode(), np.uint8)
        begin = np.flatnonzero(data == 32)
        if not leading:
            data, begin = data[data != 32], begin - np.arange(len(begin))
        n = len(data)
        size = np.diff(begin, append=n)
        sym = np.append(self.inner[data], 1 << 31)  # after the last the symbol of no pair
        end = begin + size - 1
        sym[end] = self.last[data[end]]
        following, before, alive = np.arange(1, n + 2), np.arange(-1, n), np.ones(n, bool)
        following[end], before[begin] = n, n
        key = (self.rank(sym[:-1], sym[following[:-1]]) << 6) | (np.arange(n) - np.repeat(begin, size))
        own, start, sizes = begin, begin, size  # of the words that are not done: first symbol, first key, number of keys
        none = self._NONE << 6
        while True:
            low = np.minimum.reduceat(key, start)
            on = low < none
            if not on.all():
                if not on.any():
                    break
                key, own, sizes, low = key[np.repeat(on, sizes)], own[on], sizes[on], low[on]
                start = np.cumsum(sizes) - sizes
            at = own + (low & 63)
            right = following[at]
            after, left, shift = following[right], before[at], start - own
            sym[at] = self.made[low >> 6]
            following[at], before[after], alive[right] = after, at, False
            key[right + shift] = none
            inner = np.flatnonzero(left < n)
            a, b = np.concatenate([at, left[inner]]), np.concatenate([after, at[inner]])
            shift, own_ = np.concatenate([shift, shift[inner]]), np.concatenate([own, own[inner]])
            key[a + shift] = (self.rank(sym[a], sym[b]) << 6) | (a - own_)
        return np.add.reduceat(alive, begin, dtype=np.int64), sym[:-1][alive].astype("<u4")


class Table:
    """Words and their ids in flat arrays: tens of bytes for a word, where an entry of a dictionary takes hundreds."""

    def __init__(self):
        import pyarrow as pa

        self.words, self.size, self.met, self.flat = pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, "<u4")

    def __len__(self) -> int:
        return len(self.size)

    def find(self, words) -> np.ndarray:
        """The place of each word of an Arrow array, -1 if it is not here."""
        import pyarrow.compute as pc

        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy()
        self.met[at[at >= 0]] = True
        return at

    def known(self, words: list[str]) -> dict[str, bytes]:
        """The ids of those words that are here."""
        import pyarrow as pa

        at = self.find(pa.array(words, pa.large_string()))
        ends = np.cumsum(self.size)
        return {words[i]: self.flat[ends[k] - self.size[k] : ends[k]].tobytes() for i, k in enumerate(at.tolist()) if k >= 0}

    def add(self, words: list[str], ids: list[bytes]) -> None:
        """Words that are not here yet."""
        import pyarrow as pa

        if words:
            self.words = pa.concat_arrays([self.words, pa.array(words, pa.large_string())])
            self.size = np.concatenate([self.size, np.fromiter(map(len, ids), np.int64, len(ids)) // 4])
            self.met = np.concatenate([self.met, np.zeros(len(ids), bool)])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<u4")])

    def trim(self, limit: int) -> None:
        """Keep the words that were met again since the last time, or none if they are more than ``limit``."""
        import pyarrow as pa

        keep = self.met if self.met.sum() <= limit else np.zeros(len(self), bool)
        self.words, self.flat = self.words.filter(pa.array(keep)), self.flat[np.repeat(keep, self.size)]
        self.size = self.size[keep]
        self.met = np.zeros(len(self.size), bool)


class WordCache:
    """bytes of little-endian uint32 ids for texts. Beyond ``limit`` words only those met more than once are kept."""

    def __init__(self, path: str, leading_space: bool, limit: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.leading, self.limit = leading_space, limit
        self.mark = "\n" if leading_space else " 7 "
        (self.mark_id,) = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.first = Table()
        self.later = Table() if leading_space else self.first
        self.lower = False
        try:
            self.merges = Merges(json.loads(self.tokenizer.to_str())["model"])
            self.direct = any(self._same_direct(lower) for lower in (False, True))
        except (KeyError, ValueError):  # another kind of model
            self.direct = False

    def _same_direct(self, lower: bool) -> bool:
        """Whether the merges alone give the ids of plain words, in lower case or as they are."""
        self.lower = lower
        letters = [chr(c) for c in range(0x41, 0x100) if _PLAIN.fullmatch(chr(c))]
        probes = letters + [a + b for a in letters for b in letters[::7]] + ["".join(letters[i : i + 31]) for i in range(0, len(letters), 31)] + ["Été", "naïve", "tokenizers", "Straße", "INTERNATIONAL"]
        if any(_PLAIN.fullmatch(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()):
            return False
        for prefix in ("", " ") if self.leading else ("",):
            found: dict[str, bytes] = {}
            self._encode_direct(probes, found, prefix)
            whole = self.tokenizer.encode_batch([prefix + w for w in probes], add_special_tokens=False)
            if any(found[w] != np.array(e.ids, dtype="<u4").tobytes() for w, e in zip(probes, whole)):
                return False
        return True

    def _encode_direct(self, new: list[str], known: dict[str, bytes], prefix: str) -> None:
        """Encode words of plain letters by the merges."""
        for i in range(0, len(new), 20_000):
            block = new[i : i + 20_000]
            size, ids = self.merges.encode([w.lower() for w in block] if self.lower else block, bool(prefix))
            data, ends = ids.tobytes(), (4 * np.cumsum(size)).tolist()
            for w, x, y in zip(block, [0, *ends], ends):
                known[w] = data[x:y]

    def _encode_new(self, new: list[str], known: dict[str, bytes], prefix: str) -> None:
        """Encode words in bulk: joined by a separator of one id that no word yields."""
        if self.direct:
            letters, other = [], []
            for w in new:  # letters are at most 62 bytes
                (letters if len(w) < 32 and (w.isascii() and w.isalpha() or _PLAIN.fullmatch(w)) else other).append(w)
            self._encode_direct(letters, known, prefix)
            new = other
        mark = self.mark.strip(" ")
        plain = [w for w in new if w.isalpha() or w and mark not in w and not _SPACE.search(w)]
        groups = [plain[i : i + 50] for i in range(0, len(plain), 50)]
        glue = self.mark + prefix
        for i in range(0, len(groups), 200):
            texts = [prefix + glue.join(g) for g in groups[i : i + 200]]
            for group, e in zip(groups[i : i + 200], self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(e.ids, dtype="<u4")
                cut = np.flatnonzero(ids == self.mark_id)
                if len(cut) != len(group) - 1:
                    raise ValueError("the separator was not encoded as one id")
                data, at = ids.tobytes(), (cut * 4).tolist()
                for w, x, y in zip(group, [0, *(k + 4 for k in at)], [*at, len(data)]):
                    known[w] = data[x:y]
        odd = list(set(new).difference(plain))
        for i in range(0, len(odd), 2000):
            found = self.tokenizer.encode_batch([prefix + w for w in odd[i : i + 2000]], add_special_tokens=False)
            known.update((w, np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(odd[i : i + 2000], found))

    def _learn(self, new_first: set[str], new_later: list[str]) -> dict[str, bytes]:
        """Add words to the tables, those of ``new_later`` being new and distinct; returns the ids of ``new_first`` as first words.

        Words with marks are put together from their parts, so only the parts are encoded.
        """
        cut, whole, parts = [], [], set(new_first)
        for w in new_later:
            m = None if w.isalpha() else _SHAPE.fullmatch(w)
            if m and m.lastindex > 1:
                head, *rest = [g for g in m.groups() if g and (self.leading or g != "\n")]
                cut.append((w, head, rest))
                whole.append(head)
                parts.update(rest)
            else:
                whole.append(w)
        later: dict[str, bytes] = {}
        if self.leading:
            first = self.first.known(list(parts))
            new = [w for w in parts if w not in first]
            self._encode_new(new, first, "")
            self.first.add(new, [first[w] for w in new])
        else:
            first = later
            whole += parts
        self._encode_new(list(dict.fromkeys(whole)), later, " " if self.leading else "")
        for w, head, rest in cut:
            later[w] = later[head] + b"".join([first[p] for p in rest])
        self.later.add(new_later, [later[w] for w in new_later])
        return first

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Meanwhile no search for reference cycles walks over the many words; there are none."""
        on = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if on:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        """The distinct words of all texts are looked up once; only new ones become strings of Python. numpy puts the ids of the texts together."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not texts:
            return []
        for table in (self.first, self.later):
            if len(table) > self.limit:
                table.trim(self.limit // 2)
        lead = self.leading
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        starts = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy()
        odd: set[int] = set()
        place = self.later.find(words).copy()
        fresh = np.flatnonzero(place < 0)
        missed = words.take(pa.array(fresh)).to_numpy(zero_copy_only=False).tolist()
        if lead and (loose := [i for i, w in enumerate(missed) if not w.isalpha() and (not w or w[0].isspace() or w[-1].isspace())]):
            hit = np.zeros(len(words), bool)
            hit[fresh[loose]] = True
            hit = hit[code]
            hit[starts[:-1]] = False  # a first word may be empty or begin with white space
            odd = set((np.searchsorted(starts, np.flatnonzero(hit), side="right") - 1).tolist())
            odd.update(i for i, t in enumerate(texts) if t[:1].isspace() or _ODD.search(t[: len(t.split(" ", 1)[0]) + 1]))
            fresh = np.delete(fresh, loose)
            missed = words.take(pa.array(fresh)).to_numpy(zero_copy_only=False).tolist()
        heads = [t.split(" ", 1)[0] for t in texts] if lead else []
        place[fresh] = len(self.later) + np.arange(len(fresh))
        first = self._learn(set(heads), missed)
        size = np.where(place < 0, 0, self.later.size[place]) if len(self.later) else np.zeros(len(words), np.int64)
        begin = (np.cumsum(self.later.size) - self.later.size)[place] if len(self.later) else size
        flat = self.later.flat
        if lead:
            ids = [first[w] for w in heads]
            own = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            size, begin = np.concatenate([size, own]), np.concatenate([begin, len(flat) + np.cumsum(own) - own])
            flat = np.concatenate([flat, np.frombuffer(b"".join(ids), "<u4")])
            code = code.copy()
            code[starts[:-1]] = len(words) + np.arange(len(texts))
        each = size[code]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        small = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
        at = np.repeat((begin[code] - (ends - each)).astype(small), each)
        at += np.arange(total, dtype=small)
        data, cut = flat[at].tobytes(), (np.concatenate([[0], ends])[starts] * 4).tolist()
        out = [data[x:y] for x, y in zip(cut, cut[1:])]
        if odd:
            rest = {i: _INNER.split(texts[i]) for i in odd}
            inner = list(set().union(*(p[1:] for p in rest.values())))
            new = np.flatnonzero(self.later.find(pa.array(inner, pa.large_string())) < 0)
            first = self._learn({p[0] for p in rest.values()}, [inner[i] for i in new.tolist()])
            later = self.later.known(inner)
            for i, p in rest.items():
                out[i] = first[p[0]] + b"".join([later[w] for w in p[1:]])
        return out


_CACHES: dict[tuple[str, bool], WordCache] = {}


def cache(path: str, leading_space: bool) -> WordCache:
    """One cache for each worker process; it outlives a task when the worker is used again."""
    key = (path, leading_space)
    if key not in _CACHES:
        _CACHES[key] = WordCache(path, leading_space)
    return _CACHES[key]

"""Encoding of whole texts with a tokenizer file, remembering the ids of words seen before."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Latin letters, or ASCII signs other than the apostrophe: both tokenizer families split exactly between such runs.
_SIGNS = frozenset(".,;:!?)")
_RUNS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[!-&(-/:-@\[-^`{|}~]+")

#: Words that a worker remembers.
REMEMBERED = 1_000_000
_CACHED: dict[tuple[str, int], "Encoder"] = {}


def default_tokenizer(name: str) -> str:
    """Path of a public tokenizer's file; import here, so that only its users need the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts as little-endian bytes (2 or 4 a token, by the vocabulary's size).

    The library splits texts into pieces before it encodes them. A single space or line break between other characters always starts a new piece, and
    the space belongs to the piece behind it. So a text without neighbouring blanks is the sum of its words, whose ids are remembered; any
    other text is encoded in one go. New words of letters are encoded many at a time, joined, and their ids are told apart by the
    vocabulary's marks (word beginnings or word ends). At most about ``limit`` words are remembered, the latest first.
    """

    def __init__(self, path: str, limit: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if len(vocabulary) <= 1 << 16 else "<u4")
        self.limit = limit
        self.first: dict[str, bytes] = {}  # words at the start of a text or line, or behind signs
        self.old: dict[str, bytes] = {}  # the generation of later words before this one
        self.later: dict[str, bytes] = {}  # words after a space; with their line break if they start a line
        self.has_ends = any(t.endswith("</w>") for t in vocabulary)
        self.marks = np.zeros(max(vocabulary.values()) + 1, bool)
        self.marks[[k for t, k in vocabulary.items() if (t.endswith("</w>") if self.has_ends else t.startswith("Ġ"))]] = True
        self.line_break = self._encode(["\n"])[0]

    def _encode(self, texts: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in done]

    def _letters(self, words: list[str], spaced: bool) -> list[bytes]:
        """Ids of words of letters, encoded together."""
        out: list[bytes] = []
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            glue = " " if spaced or self.has_ends else "\n"
            ids = np.frombuffer(self._encode([(" " if spaced else "") + glue.join(part)])[0], self.dtype)
            if self.has_ends:
                ends = np.flatnonzero(self.marks[ids]) + 1
                starts = np.append(0, ends[:-1])
            elif spaced:
                starts = np.flatnonzero(self.marks[ids])
                ends = np.append(starts[1:], len(ids))
            else:
                breaks = np.flatnonzero(ids == np.frombuffer(self.line_break, self.dtype)[0])
                starts, ends = np.append(0, breaks + 1), np.append(breaks, len(ids))
            if len(starts) == len(part):
                raw, size = ids.tobytes(), self.dtype.itemsize
                out += [raw[a:b] for a, b in zip((starts * size).tolist(), (ends * size).tolist())]
            else:
                out += self._encode([" " * spaced + w for w in part])
        return out

    def _learn(self, known: dict[str, bytes], new: list[str], spaced: bool) -> None:
        """Ids of ``new`` words; runs of letters and signs are put together from their own ids."""
        runs, other = {}, []
        for w in new:
            if w.isalpha():  # one piece in any script
                runs[w] = (w,)
                continue
            if w[-1:] in _SIGNS and w[:-1].isalpha():
                runs[w] = (w[:-1], w[-1])
                continue
            found = _RUNS.findall(w)
            if found and sum(map(len, found)) == len(w):
                runs[w] = found
            else:
                other.append(w)
        known.update(zip(other, self._encode([" " * spaced + w for w in other])))
        for table, wanted, after in ((known, {r[0] for r in runs.values()}, spaced), (self.first, {x for r in runs.values() for x in r[1:]}, False)):
            wanted = [w for w in wanted if w not in table]
            letters = [w for w in wanted if w.isalpha()]
            signs = [w for w in wanted if not w.isalpha()]
            table.update(zip(letters, self._letters(letters, after)))
            table.update(zip(signs, self._encode([" " * after + w for w in signs])))
        first = self.first
        known.update((w, known[r[0]] + b"".join([first[x] for x in r[1:]])) for w, r in runs.items() if len(r) > 1)

    def _renew(self) -> None:
        """Forget the words that no text since the last call but one had, once there are too many."""
        if len(self.later) > self.limit // 2:
            self.old, self.later = self.later, {}
        if len(self.first) > self.limit // 2:
            self.first = {}

    def _known(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without neighbouring blanks; Python sees each different word of them once."""
        self._renew()
        lists = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
        starts = lists.offsets.to_numpy()
        coded = lists.values.dictionary_encode()
        words, places = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
        heads = lists.values.take(pa.array(starts[:-1])).to_numpy(zero_copy_only=False).tolist()
        new = list(set(words).difference(self.later))
        if self.old:
            again = {w: self.old[w] for w in new if w in self.old}
            self.later.update(again)
            new = [w for w in new if w not in again]
        broken = {w for w in new if w[0:1] == "\n"}
        odd = [w for w in broken if w[1:2].isspace()]  # other blanks may join the line break
        lines = {w for w in broken if not w[1:2].isspace()}
        self._learn(self.first, list({*heads, *(w[1:] for w in lines)} - self.first.keys()), False)
        self._learn(self.later, [w for w in new if w not in broken], True)
        self.later.update((w, self.line_break + self.first[w[1:]]) for w in lines)
        self.later.update(zip(odd, self._encode(odd)))
        ids = pa.array([*map(self.later.__getitem__, words), *map(self.first.__getitem__, heads)], pa.large_binary())
        places[starts[:-1]] = np.arange(len(words), len(ids))  # a text's first word has no space before it
        joined = ids.take(pa.array(places))
        ends = np.frombuffer(joined.buffers()[1], np.int64)[: len(joined) + 1][starts].tolist()
        data = memoryview(joined.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in zip(ends[:-1], ends[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of ``texts``, of which callers give some MB at a time."""
        out: list[bytes] = [b""] * len(texts)
        plain = []
        for k, t in enumerate(texts):
            if "  " in t or " \n" in t or "\n " in t or "\n\n" in t or t[:1] == "\n" or t[-1:] == "\n":
                out[k] = self._encode([t])[0]
            else:
                plain.append(k)
        for at, ids in zip(plain, self._known([texts[j] for j in plain]) if plain else ()):
            out[at] = ids
        return out


def encoder(path: str, limit: int = REMEMBERED) -> Encoder:
    """This worker's encoder for ``path``."""
    if (path, limit) not in _CACHED:
        _CACHED[path, limit] = Encoder(path, limit)
    return _CACHED[path, limit]

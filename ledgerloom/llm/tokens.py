"""Tokenising whole texts with the public tokenizers, a bounded cache of words per worker.

Texts repeat words, and both tokenizers here never merge over a single space
between two non-space characters. So Arrow cuts texts at those spaces and at
single line ends and finds the distinct pieces of a batch. Nor does either
merge letters with the signs behind them, so a piece of letters and signs is
two atoms, and only atoms that the cache lacks reach the tokenizers library,
many at a time. The cache has two generations, so that it stays bounded and
words still in use survive.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from codecs import charmap_decode

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Atoms in a generation of the cache; there are two.
GENERATION = 250_000
#: Longer atoms are encoded but not kept.
CACHE_CHARS = 64
#: Words that go through the library as one text.
TOGETHER = 20_000

#: The mark of a text's first piece, and texts whose spaces do not simply separate words.
_FIRST = "\x02"
_ODD = "^[ \n]|[ \n]$|[ \n][ \n]|[\x02\t\v\f\r\x1c-\x1f\x85\xa0  -     　]"
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Latin letters, and ASCII signs other than the apostrophe.
_LETTERS, _SIGNS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", r"[!-&(-/:-@\[-`{-~]*"
_LEAD = f"^[\n{_FIRST}]?"
_NO_LETTERS = "\n" + _FIRST + "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")


def _bytes_as_letters() -> str:
    """The letters by which byte-level vocabularies write bytes: printable ones themselves, others from U+0100 on; a line end stays."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    letters = [chr(b if b in shown else next(rest)) for b in range(256)]
    letters[0x0A] = "\n"
    return "".join(letters)


class Encoder:
    """Ids of texts, the tokenizer's own and no special tokens."""

    def __init__(self, path: str, spaced: bool):
        """spaced: tokens carry the space before them (byte-level); else spaces only separate words, and case does not matter."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.spaced = spaced
        # The library's model alone, for texts that are one word each: no pattern, and no second cache.
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        end = model.get("end_of_word_suffix")
        self.direct = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **({"end_of_word_suffix": end} if end else {})))
        self.direct.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.letters = _bytes_as_letters()
        #: Whether an id opens (spaced) or closes a word.
        self.edge = np.zeros(max(model["vocab"].values()) + 1, dtype=bool)
        self.edge[[k for t, k in model["vocab"].items() if (t.startswith("Ġ") if spaced else t.endswith("</w>"))]] = True
        self.kind = np.dtype("<u2" if len(self.edge) <= 1 << 16 else "<u4")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each text as little-endian unsigned 32-bit integers."""
        ids, ends = self.encode_arrow(pa.array(texts, pa.large_string()))
        data, at = ids.astype("<u4").tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip(at, at[1:])]

    def encode_arrow(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, where each text begins among them and the end); a null text is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        strange = pc.match_substring_regex(texts, _ODD)
        odd = np.flatnonzero(strange.to_numpy(zero_copy_only=False)).tolist()
        # An odd text is empty here and comes as pieces of its own.
        even = pc.if_else(strange, pa.scalar("", pa.large_string()), texts) if odd else texts
        if self.spaced:
            even = pc.binary_join_element_wise(pa.scalar(_FIRST, pa.large_string()), pc.replace_substring(even, "\n", " \n"), pa.scalar("", pa.large_string()))
        else:
            even = pc.ascii_lower(pc.replace_substring(even, "\n", " "))
        lists = pc.split_pattern(even, " ")
        coded = lists.flatten().dictionary_encode()
        codes, sizes = coded.indices.to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
        atoms, n_words, cut, cut_sizes = self._cut(coded.dictionary)
        if odd:
            at = {a: k for k, a in enumerate(atoms)}
            more = [[at.setdefault(a, len(at)) for a in self._odd(texts[k].as_py())] for k in odd]
            # An empty text has one piece, which now stands for all atoms of the odd one.
            codes = codes.copy()
            codes[(np.cumsum(sizes) - 1)[odd]] = len(cut_sizes) + np.arange(len(odd))
            atoms, cut = list(at), np.concatenate([cut, *(np.array(x, dtype=np.int64) for x in more)])
            cut_sizes = np.concatenate([cut_sizes, [len(x) for x in more]])
        values = self._values(atoms, n_words)
        flat = np.frombuffer(b"".join(values), dtype=self.kind)
        length = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // self.kind.itemsize
        for at, n in ((cut, cut_sizes), (codes, sizes)):
            flat, begins = _gather(flat, length, at, n)
            length = np.diff(begins)
        return flat, begins

    def _cut(self, pieces: pa.Array) -> tuple[list[str], int, np.ndarray, np.ndarray]:
        """Distinct pieces -> (atoms, how many of them from the second on are words, numbers of atoms end to end, atoms per piece)."""
        plain = pc.match_substring_regex(pieces, _LEAD + _LETTERS + _SIGNS + "$").to_numpy(zero_copy_only=False)
        simple = pieces.filter(pa.array(plain))
        core = pc.ascii_trim(simple, characters=_NO_LETTERS)
        signed = np.flatnonzero(pc.match_substring_regex(simple, "[^A-Za-zÀ-ÿ]$").to_numpy(zero_copy_only=False))
        tail = pc.replace_substring_regex(simple.take(pa.array(signed)), _LEAD + _LETTERS, "").dictionary_encode()
        parts = np.full((len(pieces), 3), -1, dtype=np.int64)
        atoms = ["\n"]
        if self.spaced:
            line, first = pc.starts_with(simple, "\n"), pc.starts_with(simple, _FIRST)
            lead = pc.if_else(pc.or_(line, first), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
            core = pc.binary_join_element_wise(lead, core, pa.scalar("", pa.large_string()))
            parts[np.flatnonzero(plain)[line.to_numpy(zero_copy_only=False)], 0] = 0
        core = core.dictionary_encode()
        parts[plain, 1] = core.indices.to_numpy(zero_copy_only=False) + len(atoms)
        atoms += core.dictionary.to_numpy(zero_copy_only=False).tolist()
        n_words = len(atoms) - 1
        parts[np.flatnonzero(plain)[signed], 2] = tail.indices.to_numpy(zero_copy_only=False) + len(atoms)
        atoms += tail.dictionary.to_numpy(zero_copy_only=False).tolist()
        rest = np.flatnonzero(~plain)
        sizes, flat = (parts >= 0).sum(axis=1), parts[parts >= 0]
        if not len(rest):
            return atoms, n_words, flat, sizes
        # Other pieces are cut here; their atoms follow, and are then put in their places.
        at = {a: k for k, a in enumerate(atoms)}
        more = [[at.setdefault(a, len(at)) for a in self._atoms(p)] for p in pieces.take(pa.array(rest)).to_numpy(zero_copy_only=False).tolist()]
        sizes[rest] = [len(x) for x in more]
        out = np.empty(int(sizes.sum()), dtype=np.int64)
        other = np.repeat(~plain, sizes)
        out[~other], out[other] = flat, [k for x in more for k in x]
        return list(at), n_words, out, sizes

    def _odd(self, text: str) -> list[str]:
        """Atoms of any text."""
        if not self.spaced:
            return text.replace("\n", " ").split(" ")
        return [a for k, p in enumerate(_CUT.split(text)) for a in self._lines(" " * (k > 0) + p)]

    def _atoms(self, piece: str) -> list[str]:
        """Texts that encode by themselves and follow each other in a piece of an even text, with the space before them."""
        if not self.spaced:
            return [piece]
        if piece[0] == _FIRST:
            return [piece[1:]]
        return ["\n", piece[1:]] if piece[0] == "\n" else [" " + piece]

    @staticmethod
    def _lines(piece: str) -> list[str]:
        """Cut at single line ends, if all are."""
        lines = piece.split("\n")
        if len(lines) > 1 and all(x and not x[-1].isspace() and (k == 0 or not x[0].isspace()) for k, x in enumerate(lines)):
            return [y for k, x in enumerate(lines) for y in (["\n"] * (k > 0) + [x])]
        return [piece]

    def _values(self, atoms: list[str], n_words: int) -> list[bytes]:
        """ids of distinct atoms, from the cache or the library; n_words: see _cut."""
        young, old = self.young, self.old
        out = list(map(young.get, atoms))
        words: list[int] = []
        others: list[int] = []
        for k in [k for k, v in enumerate(out) if v is None]:
            a = atoms[k]
            if (v := old.get(a)) is not None:
                out[k] = young[a] = v
            elif 0 < k <= n_words and (a[0] == " ") == self.spaced:
                words.append(k)
            else:
                others.append(k)
        for k, e in zip(others, self.tok.encode_batch_fast([atoms[k] for k in others], add_special_tokens=False)):
            out[k] = np.array(e.ids, dtype=self.kind).tobytes()
        for k in range(0, len(words), TOGETHER):
            some = words[k : k + TOGETHER]
            for n, v in zip(some, self._words([atoms[n] for n in some])):
                out[n] = v
        for k in itertools.chain(words, others):
            if len(atoms[k]) <= CACHE_CHARS:
                young[atoms[k]] = out[k]
        if len(young) > GENERATION:
            self.old, self.young = young, {}
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """ids of words of Latin letters, encoded together and told apart by their edge tokens."""
        text = "\n".join(words) if self.spaced else "\n".join(words).lower()
        ids = np.array(self.direct.encode_batch_fast([charmap_decode(text.encode(), "strict", self.letters)[0]], add_special_tokens=False)[0].ids, dtype=self.kind)
        edges = np.flatnonzero(self.edge[ids]) * self.kind.itemsize
        data, size = ids.tobytes(), self.kind.itemsize
        at = [*edges.tolist(), len(data)] if self.spaced else [0, *(edges + size).tolist()]
        if len(at) != len(words) + 1:
            raise RuntimeError("words and edge tokens differ in number")
        return [data[a:b] for a, b in zip(at, at[1:])]


def _gather(flat: np.ndarray, length: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of `flat` (entry k has length[k] values) named by codes, put end to end, and where each of the groups of `sizes` codes begins."""
    first = np.cumsum(length) - length
    n = length[codes]
    ends = np.concatenate(([0], np.cumsum(n)))
    out = flat[np.repeat(first[codes] - ends[:-1], n) + np.arange(ends[-1])]
    return out, ends[np.concatenate(([0], np.cumsum(sizes)))]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """One encoder per worker process and file."""
    key = (path, spaced)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, spaced)
    return _ENCODERS[key]

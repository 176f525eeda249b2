"""Token ids of whole texts, for the two tokenizer files that the packing and output operators use.

``IdEncoder`` gives exactly what ``Tokenizer.encode(text, add_special_tokens=False).ids`` gives, as bytes
of little-endian unsigned 32-bit integers. Texts repeat their words, so ids are kept: a text is cut
where no token can cross (before a blank or a line end that follows a word), and a word of plain
letters, digits and marks is cut into pre-tokens as the tokenizer cuts it; only pre-tokens not seen
before go through the library's model. Every other word (apostrophes, special tokens' marks, letters
outside Latin-1), and every text whose white space doesn't allow the cut, goes through the library.

``batch`` does the same for an Arrow column: words are cut and numbered by Arrow, a chunk's distinct words are cut into
pre-tokens together, and the chunk's ids are gathered by numpy.

Both stores are bounded: when one is full, what's new is computed and not kept, which changes no
result.
"""

from __future__ import annotations

import gc
import os
import re
from array import array

import numpy as np

from cairn.llm.common import kept

WORDS, PARTS, CHUNK = 400_000, 400_000, 8 << 20
# Letters, digits and marks for which the cuts below are the tokenizers' own; the apostrophe is left out.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = "!-&(-/:-@\\[-`{-~"
_CASED = re.compile(f"[ ]?[{_LETTERS}]+|[ ]?[{_MARKS}]+|[ ]?[0-9]+|\n")
_LOWER = re.compile(f"[{_LETTERS}]+|[{_MARKS}]+|[0-9]")
#: Stands between words; no plain word has it.
_SEP = "\0"
_BLANK_LIKE = "\u180e\u200b\u200c\u200d\u200e\u200f\ufeff"


def _stand_ins() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_STAND_IN = _stand_ins()


class _Parts(dict):
    """Ids of single pre-tokens, by the library's model."""

    def __init__(self, model):
        self.model = model

    def __missing__(self, part: str) -> bytes:
        shown = part if part.isascii() and part.isalnum() else part.encode().decode("latin-1").translate(_STAND_IN)
        ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        if len(self) < PARTS:
            self[part] = ids
        return ids


class _Uncut(Exception):
    """White space that doesn't allow the cut."""


class _Words(dict):
    """Ids of words: what stands between two blanks, with the line end before it if there's one."""

    def __init__(self, owner: IdEncoder):
        self.owner = owner

    def __missing__(self, word: str) -> bytes:
        owner = self.owner
        if owner.lower:
            shown = word.lower()
        else:
            shown = word if word[:1] == "\n" else " " + word
            if (lead := shown[1:2]) and (lead.isspace() or lead in _BLANK_LIKE):
                raise _Uncut
        parts = owner.cut(shown)
        plain = "".join(parts) == shown and "<|" not in word
        ids = b"".join(map(owner.parts.__getitem__, parts)) if plain else owner.library(word if owner.lower else shown)
        if len(self) < WORDS:
            self[word] = ids
        return ids


class IdEncoder:
    """``ids(text)`` as bytes. ``path``: a tokenizers file, byte-level BPE or lower-casing BPE with word ends."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.lower = self.tokenizer.normalizer is not None  # lower case, white space dropped
        self.cut = (_LOWER if self.lower else _CASED).findall
        self.cut_all = re.compile((_LOWER if self.lower else _CASED).pattern + "|" + _SEP).findall
        self.odd = re.compile(f"[^ {_LETTERS}{_MARKS}0-9{'' if self.lower else chr(10)}]|<[|]")
        self.parts, self.words = _Parts(self.tokenizer.model), _Words(self)
        self.parts[_SEP] = b""
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def plain(self, text: str) -> bool:
        """Whether its blanks and line ends allow the cut, as far as they alone tell."""
        return self.lower or not (not text or "<|" in text or "  " in text or " \n" in text or "\n\n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n")

    def word(self, word: str) -> bytes | None:
        try:
            return self.words[word]
        except _Uncut:
            return None

    def batch(self, column):
        """For each chunk of an Arrow column of strings: all ids (unsigned 32-bit) of its texts, and for each text the number of ids."""
        sizes = np.cumsum(np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])) if len(column) else []
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK, "right")))
            was = gc.isenabled()
            gc.disable()  # a chunk makes long lists and no cycles; going through them took a fifth of its time
            try:
                out = self.chunk(column.slice(at, end - at))
            finally:
                if was:
                    gc.enable()
            yield out
            at = end

    def chunk(self, column) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        cut = np.ones(len(column), bool) if self.lower else np.array([self.plain(t) for t in column.to_pylist()], bool)
        texts = column if cut.all() else column.take(np.flatnonzero(cut))
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " " if self.lower else " \n"), " ")
        counts = lists.value_lengths().to_numpy()
        coded = lists.flatten().dictionary_encode()
        at, every = coded.indices.to_numpy(), coded.dictionary
        # words have no blanks, so that one text of them all is cut again, much faster than a list of single values is made
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(every)], every), " ")[0].as_py() if len(every) else ""
        words = joined.split(" ") if len(every) else []
        firsts = np.cumsum(counts) - counts
        first_words = [] if self.lower else [words[k] for k in at[firsts]]
        extra = {}  # ids of the words that aren't plain
        if found := [m.start() for m in self.odd.finditer(joined)]:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            for k in np.unique(np.searchsorted(ends, found, "right")).tolist():
                extra[k], words[k] = self.word(words[k]), ""
        if not self.lower and (wrong := [k for k, ids in extra.items() if ids is None]):  # a text with such a word goes through the library whole, unless it's the first word
            odd = np.isin(at, wrong)
            odd[firsts] = False
            bad = np.add.reduceat(odd, firsts, dtype=np.int64) > 0
            at, first_words = at[~np.repeat(bad, counts)], [w for w, b in zip(first_words, bad) if not b]
            cut[np.flatnonzero(cut)[bad]] = False
            counts = counts[~bad]
        shown = _SEP.join(words).lower() if self.lower else _SEP.join([w if w[:1] == "\n" else " " + w if w else "" for w in words])
        parts = self.cut_all(shown)
        table = list(map(self.parts.__getitem__, parts))
        of_word = np.cumsum(np.fromiter(map(_SEP.__eq__, parts), bool, len(parts)))
        lens = np.bincount(of_word, np.fromiter(map(len, table), np.int64, len(table)) // 4, len(words)).astype(np.int64)
        begins = np.cumsum(lens) - lens
        # what a text is made of: its words, or the one entry that the library gives for it
        units = np.ones(len(column), np.int64)
        units[cut] = counts
        starts = np.cumsum(units) - units
        more = [ids or b"" for ids in extra.values()]
        more += [self.library(column[int(k)].as_py()) for k in np.flatnonzero(~cut)]
        more += map(self.library, first_words)
        n = np.fromiter(map(len, more), np.int64, len(more)) // 4
        begins, lens = np.append(begins, lens.sum() + np.cumsum(n) - n), np.append(lens, n)
        own = np.arange(len(words))
        own[list(extra)] = len(words) + np.arange(len(extra))
        at_all, by_word = np.empty(int(units.sum()), np.int64), np.repeat(cut, units)
        at_all[by_word] = own[at]
        whole, kept = int((~cut).sum()), len(words) + len(extra)
        at_all[~by_word] = kept + np.arange(whole)
        if not self.lower:
            at_all[starts[cut]] = kept + whole + np.arange(len(first_words))
        flat, n = np.frombuffer(b"".join(table + more), "<u4"), lens[at_all]
        ends = np.cumsum(n)
        ids = flat[np.repeat(begins[at_all] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        before = np.append(0, ends)
        return ids, before[starts + units] - before[starts]

    def ids(self, text: str) -> bytes:
        if self.lower:
            return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))
        if not self.plain(text):
            return self.library(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        try:
            return self.library(first) + b"".join(map(self.words.__getitem__, rest))
        except _Uncut:
            return self.library(text)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """A chunk with ``end_id`` after each text's ids."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


_encoders: dict[str, IdEncoder] = {}


def encoder(path: str) -> IdEncoder:
    """The process's encoder for a file; Python workers live on, so their store does too, until a ``tidy`` task that doesn't keep it."""
    kept["encoders"] = _encoders.clear
    if path not in _encoders:
        _encoders[path] = IdEncoder(path)
    return _encoders[path]


def tokenizer_path(name: str) -> str:
    """Where the machine keeps a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)

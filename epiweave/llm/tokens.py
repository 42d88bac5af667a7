"""Exact tokenizers-library encoding, word by word, with a cache of word parts."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BEFORE_SPACE = re.compile(r"(?<=\S)(?= \S)")
_TEXT = pa.large_string()
#: Letters and marks whose runs both vocabularies split off alike, whatever stands beside them (the apostrophe is not one).
_LETTERS, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r"!-&(-/:-@\[-`{-~"
_UNSAFE = f"<\\||[^\\n{_LETTERS}0-9{_MARKS}]"


def _byte_names() -> dict[int, str]:
    """Byte-level BPE's letter for each byte that is none itself: U+0100 and on, in byte order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Encodes whole texts as the tokenizers library does.

    Both kinds of public vocabularies split a text into words, and words into runs of letters, digits and
    marks, before they merge bytes; a text is the concatenation of its parts' ids. keeps_space: a part
    carries the one space before it (byte-level BPE); else white space is dropped and letters are lower-cased.
    Arrow cuts the texts at blanks and line feeds, numbers their distinct words, and cuts those into parts;
    the library's BPE model encodes each part once, and its ids stay in a cache of about `most` parts, which
    is emptied when full. Words with other characters go to the library whole, and texts with other white
    space, or runs of it that the vocabulary does not split everywhere, are cut at safe places only or not
    at all, so results equal the library's on every text.
    """

    def __init__(self, blob: str, keeps_space: bool, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer, self.keeps_space, self.most = Tokenizer.from_str(blob), keeps_space, most
        self.model = Tokenizer(self.tokenizer.model)  # the same merges, for parts that are cut already
        self.model.pre_tokenizer = CharDelimiterSplit("\n")
        self.names = _byte_names()
        del self.names[10]
        self.cut = f"( ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|\\n)" if keeps_space else f"([{_LETTERS}]+|[0-9]|[{_MARKS}]+)"
        self._forget()

    def _forget(self) -> None:
        """Row r of the cache is part parts[r], with ids pool[start[r] : start[r] + count[r]]."""
        line = np.array(self.tokenizer.encode("\n", add_special_tokens=False).ids, "<u4")
        self.parts = pa.array(["", "\n"], _TEXT)
        self.start, self.count, self.pool = np.zeros(2, np.int64), np.array([0, len(line)]), line

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str], whole: list[str]) -> None:
        """Adds parts, encoded by the model many at a time (in ASCII only blanks have other names there), and whole words, encoded by the library one by one."""
        ids, count = [self.pool], [self.count]
        for k in range(0, len(parts), 5000):
            group = parts[k : k + 5000]
            text = "\n".join(group)
            text = text.replace(" ", self.names[32]) if text.isascii() else text.encode().decode("latin-1").translate(self.names)
            made = self.model.encode(text, add_special_tokens=False)
            ids.append(np.array(made.ids, "<u4"))
            count.append(np.bincount(np.array(made.word_ids, np.int64), minlength=len(group)))
        words = self.plain(whole)
        self.pool = np.concatenate([*ids, *words])
        self.count = np.concatenate([*count, np.fromiter(map(len, words), np.int64, len(words))])
        self.start = np.cumsum(self.count) - self.count
        self.parts = pa.concat_arrays([self.parts, pa.array(parts, _TEXT), pa.array(whole, _TEXT)])

    def _odd(self, text: str) -> np.ndarray:
        """A text that is not a row of words: cut where one space parts two words, if at all; the library does the rest."""
        if not self.keeps_space or "<|" in text:
            return self.plain([text])[0]
        cut = [0, *(m.start() for m in _BEFORE_SPACE.finditer(text)), len(text)]
        return np.concatenate(self.plain([text[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]))

    def _spread(self, rows: np.ndarray, at: np.ndarray, start: np.ndarray, count: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pool[start[r] : start[r] + count[r]] for each r of rows, one after another; how many of them in rows[at[i] : at[i + 1]])."""
        own = count[rows]
        ends = np.append(0, np.cumsum(own))
        return pool[np.repeat(start[rows] - ends[:-1], own) + np.arange(ends[-1])], np.diff(ends[at])

    def _vocabulary(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of distinct words one after another, number of ids of each, which ones make their text odd)."""
        spaced = words
        if self.keeps_space:
            spaced = pc.if_else(pc.or_(pc.starts_with(words, "\n"), pc.equal(words, "")), words, pc.binary_join_element_wise(pa.scalar("", _TEXT), words, pa.scalar(" ", _TEXT)))
        unsafe = pc.match_substring_regex(words, _UNSAFE)
        odd = np.zeros(len(words), bool)
        own: list[str] = []
        for i in np.flatnonzero(unsafe.to_numpy(zero_copy_only=False)).tolist():
            w = words[i].as_py()
            bare = w[1:] if w[0] == "\n" else w
            odd[i] = bare.split() != [bare] or "\0" in w or "<|" in w
            own.append("" if odd[i] else spaced[i].as_py())
        safe = pc.replace_substring_regex(spaced if self.keeps_space else pc.utf8_lower(spaced), self.cut, "\\1\0")
        if own:
            safe = pc.replace_with_mask(safe, unsafe, pa.array([w + "\0" for w in own], _TEXT))
        lists = pc.split_pattern(safe, "\0")
        coded = lists.values.dictionary_encode()
        row = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.parts), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(row < 0)
        if len(new):
            known, full = coded.dictionary.take(pa.array(new)).to_pylist(), set(own)
            parts, whole = sorted((p for p in known if p not in full), key=str.isascii), [p for p in known if p in full]
            place = {p: len(self.parts) + i for i, p in enumerate([*parts, *whole])}
            self._learn(parts, whole)
            row[new] = [place[p] for p in known]
        ids, total = self._spread(row[coded.indices.to_numpy()], lists.offsets.to_numpy(), self.start, self.count, self.pool)
        return ids, total, odd

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each); end_id ends each text. Null counts as empty.

        With kept space every line feed begins a word, and each text gets an extra one before it, so that its
        first word has no space either.
        """
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        if len(self.parts) > self.most:
            self._forget()
        texts = pc.fill_null(texts.cast(_TEXT), "")
        marked = pc.binary_join_element_wise(pa.scalar("", _TEXT), texts, pa.scalar("\n", _TEXT)) if self.keeps_space else texts
        lists = pc.split_pattern(pc.replace_substring(marked, "\n", " \n" if self.keeps_space else " "), " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        at, index = at - at[0], coded.indices.to_numpy()
        pool, count, strange = self._vocabulary(coded.dictionary)
        odd = strange[index]
        if self.keeps_space:
            line = pc.starts_with(coded.dictionary, "\n").to_numpy(zero_copy_only=False)
            size = pc.binary_length(coded.dictionary).to_numpy()
            void, alone = size == 0, line & (size == 1)
            odd |= void[index]
            odd[at[:-1]] = False  # the empty word before the extra line feed
            empty = np.flatnonzero(alone[index])  # an empty line: regular if a full one follows
            last = np.zeros(len(index) + 1, bool)
            last[at - 1] = True
            after = index[np.minimum(empty + 1, len(index) - 1)]
            odd[empty] = last[empty] | ~line[after] | alone[after]
        ids, total = self._spread(index, at, np.cumsum(count) - count, count, pool)
        odd = np.flatnonzero(np.logical_or.reduceat(odd, at[:-1])).tolist()
        lead, add = int(self.keeps_space), int(end_id is not None)
        if odd:
            each = np.split(ids, np.cumsum(total)[:-1])
            for i in odd:
                text = texts[i].as_py()
                each[i] = np.concatenate([np.zeros(lead, "<u4"), self._odd(text)]) if text else np.zeros(lead, "<u4")
            ids, total = np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
        ends = np.cumsum(total - lead + add)
        out = np.full(ends[-1], end_id or 0, "<u4")
        place, source = np.ones(len(out), bool), np.ones(len(ids), bool)
        if add:
            place[ends - 1] = False
        if lead:  # the extra line feed goes
            source[np.cumsum(total) - total] = False
        out[place] = ids[source]
        return out, total - lead + add


_ENCODERS: dict[tuple[int, bool], Encoder] = {}


def encoder(blob: str, keeps_space: bool, most: int = 1_000_000) -> Encoder:
    """One encoder for each vocabulary and worker process, so the cache outlives a task."""
    key = (hash(blob), keeps_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(blob, keeps_space, most)
    return _ENCODERS[key]


def read_vocabulary(path: str) -> str:
    """The tokenizer file as text: some MB, whatever the corpus; it travels with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()

"""Encoding with the tokenizers library at the speed of a word lookup.

A worker keeps the ids of the words that it has met, as little-endian bytes, and asks the library only for new ones.
Texts are cut where the tokenizer itself never joins two sides, so the ids equal those of the whole text.
"""

from __future__ import annotations

import os
import re
from itertools import compress, repeat

import numpy as np

from lumenweft.llm._common import REMEMBERED

#: Words in the newer half of what a worker remembers; there is an older half as well. Bounds memory, not results.
MEMO_ENTRIES = 1_000_000


class WordEncoder:
    """Ids of whole texts, as bytes of unsigned `width`-bit little-endian integers.

    glue: whether a blank belongs to the word behind it (byte-level files) or to no word (files that drop white space).
    special: whether the string of a special token in a text is that token, as is the library's default, or plain text.
    """

    def __init__(self, path: str, glue: bool, width: int = 16, entries: int = MEMO_ENTRIES, special: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        # Texts that may hold the string of a special token go to the library whole; what it normalises are letters.
        signs = {re.split("[A-Za-z]", t.content)[0] for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.signs = [x for x in signs if not any(y != x and y in x for y in signs)] if special else []
        if self.tokenizer.get_vocab_size() > 1 << width:
            raise ValueError(f"{path} has ids of more than {width} bits")
        self.glue, self.size, self.entries = glue, width // 8, entries
        self.kind = f"<u{self.size}"
        self.mark = "\t" if glue else "|"
        own = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.mark_id = own[0] if len(own) == 1 else -1
        self.memo: dict[str, bytes] = {}  # if glue, of words with a blank before them
        # words are asked for once, so the library's own cache only costs
        getattr(self.tokenizer.model, "_resize_cache", lambda n: None)(0)
        self.old: dict[str, bytes] = {}
        self.odd = re.compile(r" \s").search  # a blank before white space does not begin a word

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > self.entries:  # words that come up again move from the older half to the newer one
            self.old, self.memo = self.memo, {}
        get, out = self.memo.get, [b""] * len(texts)
        rows: list[tuple[int, str, list[str], list[bytes | None]]] = []
        whole: list[int] = []
        missing: set[str] = set()
        for i, text in enumerate(texts):
            if any(x in text for x in self.signs):
                whole.append(i)
                continue
            if not self.glue:
                first, words = "", text.replace("\n", " ").split(" ")
            elif self.odd(text):
                whole.append(i)
                continue
            else:
                words = text.split(" ")
                first = words.pop(0)
            known = list(map(get, words))
            if None in known:
                missing.update(compress(words, [x is None for x in known]))
            rows.append((i, first, words, known))
        self._learn(missing)
        memo = self.memo
        firsts = self._ask([first for _, first, _, _ in rows]) if self.glue else repeat(b"")
        for (i, _, words, known), head in zip(rows, firsts):
            out[i] = head + b"".join([memo[w] if x is None else x for w, x in zip(words, known)])
        for i in whole:
            out[i] = self._ask([texts[i]])[0]
        return out

    def _learn(self, missing: set[str]) -> None:
        """Asks for many words in one text, put apart by a mark that is a token of its own and in none of them."""
        memo, old, size, blank = self.memo, self.old, self.size, " " if self.glue else ""
        memo.update((w, old[w]) for w in missing if w in old)
        words = [w for w in missing if w not in old]
        joint = self.mark + blank if self.glue else f" {self.mark} "
        alone: list[str] = []
        for i in range(0, len(words), 2048):
            some = words[i : i + 2048]
            text = blank + joint.join(some)
            data = self._ask([text])[0] if text.count(self.mark) == len(some) - 1 and "" not in some else b""
            ends = np.flatnonzero(np.frombuffer(data, self.kind) == self.mark_id)
            if not data or len(ends) != len(some) - 1:  # a word holds the mark, or white space that takes it in
                alone.extend(some)
                continue
            begins = [0, *((ends + 1) * size).tolist()]
            memo.update(zip(some, [data[x:y] for x, y in zip(begins, [*(ends * size).tolist(), len(data)], strict=True)], strict=True))
        for i in range(0, len(alone), 1024):
            some = alone[i : i + 1024]
            memo.update(zip(some, self._ask([blank + w for w in some]), strict=True))


_ENCODERS: dict[tuple[str, bool, int, int, bool], WordEncoder] = {}
REMEMBERED.append(_ENCODERS)


def encoder(path: str, glue: bool, width: int = 16, entries: int = MEMO_ENTRIES, special: bool = False) -> WordEncoder:
    """The worker's encoder for this file; kept between batches and tasks."""
    key = (path, glue, width, entries, special)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(*key)
    return _ENCODERS[key]

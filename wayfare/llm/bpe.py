"""Byte-pair encoding by backtracking over longest token matches, and decoding by an offset table.

An encoding is what the merge rules give if and only if every two neighbouring
tokens are compatible, that is, the rules applied to the two joined strings
leave just these two.  The encoder takes the longest token at each place (found
by one Aho-Corasick pass), keeps it if compatible with the token before, else
tries the next shorter prefix token, else steps back; a place found dead is
never entered again, so a word of n symbols takes time proportional to n.

Defined results: a null or empty text has no tokens and decodes to the empty
string; special-token strings in a text become their ids as the library does;
repeated rows each give a row; texts and words of any length are encoded whole;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from wayfare.llm.common import text_ids, typed_ids
from wayfare.llm.wordtable import WordTable, gather, lists

#: Texts of these characters only are split by ``_FAST_WORDS``; all others by the library's own splitter.
_FAST_TEXT = re.compile("[\t\n\r\x20-\x7eÀ-įı-ɏ]*")
_FAST_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


_BYTE_CHARACTERS = byte_characters()


class BacktrackingBpe:
    """Exact merges for one vocabulary with ordered merge rules and a word-end suffix."""

    END = "\n"  # stands for the suffix in the automaton's strings; no byte character equals it

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self._suffix = suffix
        own = {s: self._own(s) for s in vocab}
        made = {a + b: (a, b) for a, b in ((self._own(a), self._own(b)) for a, b in merges)}
        # Order: symbols first, then merged tokens by the rank of their rule.
        symbols = sorted(x for x in own.values() if x not in made)
        self._order = {x: i for i, x in enumerate([*symbols, *made])}
        self._symbols = len(symbols)
        self._id = np.zeros(len(self._order), dtype=np.uint32)
        for s, i in vocab.items():
            self._id[self._order[own[s]]] = i
        self._left = [0] * self._symbols + [self._order[a] for a, _ in made.values()]
        self._right = [0] * self._symbols + [self._order[b] for _, b in made.values()]
        self._pair = {p: self._symbols + i for i, p in enumerate(zip(self._left[self._symbols :], self._right[self._symbols :]))}
        self._checked: dict[tuple[int, int], bool] = {}
        live = [True] * len(self._order)
        for t in range(self._symbols, len(live)):
            a, b = self._left[t], self._right[t]
            live[t] = live[a] and live[b] and self._compatible(a, b, t)
        self._length = [len(x) for x in self._order]
        self._shorter = [-1] * len(live)
        self._automaton = ahocorasick.Automaton()
        for x, t in self._order.items():
            if live[t]:
                self._automaton.add_word(x, (t, len(x)))
                for n in range(len(x) - 1, 0, -1):
                    p = self._order.get(x[:n], -1)
                    if p >= 0 and live[p]:
                        self._shorter[t] = p
                        break
        self._automaton.make_automaton()

    def _own(self, token: str) -> str:
        if self._suffix and token.endswith(self._suffix) and len(token) > len(self._suffix):
            return token[: -len(self._suffix)] + self.END
        return token

    def _compatible(self, left: int, right: int, limit: int = 1 << 60) -> bool:
        """Undo the later merge on either side until symbols are left; no rule that
        joins the two sides may come before the merges undone so far."""
        while True:
            joined = self._pair.get((left, right))
            if joined is not None and joined < limit:
                return False
            if left > right:
                if left < self._symbols:
                    return True
                limit, left = left, self._right[left]
            else:
                if right < self._symbols:
                    return True
                limit, right = right + 1, self._left[right]

    def compatible(self, left: int, right: int) -> bool:
        found = self._checked.get((left, right))
        if found is None:
            if len(self._checked) > 1_000_000:
                self._checked.clear()
            found = self._checked[left, right] = self._compatible(left, right)
        return found

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, written in byte characters."""
        text = word + self.END if self._suffix else word
        size = len(text)
        longest = [-1] * (size + 1)
        for end, (token, length) in self._automaton.iter(text):
            longest[end + 1 - length] = token
        lengths, shorter, compatible = self._length, self._shorter, self.compatible
        alive = bytearray(b"\1") * (size + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            while token >= 0:
                end = at + lengths[token]
                if alive[end] and (not out or compatible(out[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at]
            else:
                alive[at] = 0
                if not out:
                    raise ValueError("the vocabulary does not cover the text")
                token = out.pop()
                at -= lengths[token]
                token = shorter[token]
        return self._id[out].tolist()


class WordBpe:
    """A tokenizer file of lower-cased words with word ends, as ``tokenizers`` applies it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self._library = Tokenizer.from_file(path)
        self._bpe = BacktrackingBpe(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")")
        self._table = WordTable(lambda words: lists([self._word(w) for w in words]))
        tokens = {i: s for s, i in [*model["vocab"].items(), *self._special.items()]}
        self._text = _offset_table([(tokens[i] + " ").encode("utf-8") for i in range(len(tokens))])
        self._digits = _offset_table([f"{i} ".encode() for i in range(len(tokens))])

    def _word(self, word: str) -> list[int]:
        """Words of the library's splitter come in byte characters already and are marked by a leading null."""
        if word in self._special:
            return [self._special[word]]
        if word[0] == "\0":
            return self._bpe.encode_word(word[1:])
        return self._bpe.encode_word("".join([_BYTE_CHARACTERS[b] for b in word.encode("utf-8")]))

    def words(self, text: str) -> list[str]:
        """The words of a text, special tokens kept whole."""
        if "<|" in text and self._split.search(text):
            return [w for part in self._split.split(text) if part for w in ([part] if part in self._special else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if _FAST_TEXT.fullmatch(text):
            return _FAST_WORDS.findall(text.lower())
        normal = self._library.normalizer.normalize_str(text)
        return ["\0" + w for w, _ in self._library.pre_tokenizer.pre_tokenize_str(normal)]

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        numbers = [self._table.number(self.words(t)) if t else np.zeros(0, dtype=np.int64) for t in texts]
        self._table.flush()
        out = [self._table.ids(n) for n in numbers]
        self._table.trim()
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The library's ``decode(ids, skip_special_tokens=False)`` in UTF-8: token strings joined by a space."""
        return gather(*self._text, ids.astype(np.int64)).tobytes()[:-1]

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids as decimal numbers joined by a space."""
        return gather(*self._digits, ids.astype(np.int64)).tobytes()[:-1]


def _offset_table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return np.frombuffer(b"".join(parts), dtype=np.uint8), starts


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def tokenize(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row (and ``ids, decoded`` on demand)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = load(path)
        for batch in batches:
            for begin in range(0, len(batch), 500):
                part = batch.iloc[begin : begin + 500]
                ids = coder.encode_batch(list(part["text"]))
                decoded = [coder.decode(x) for x in ids]
                out = pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].to_numpy(),
                        "n_tokens": [len(x) for x in ids],
                        "ids_sha256": [hashlib.sha256(coder.decimal(x)).hexdigest() for x in ids],
                        "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in decoded],
                    }
                )
                if with_ids:
                    out["ids"] = [x.astype(np.int64) for x in ids]
                    out["decoded"] = [x.decode("utf-8") for x in decoded]
                yield out

    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if with_ids else "")
    return typed_ids(text_ids(docs.select("doc_id", "text")).mapInPandas(run, schema), docs)

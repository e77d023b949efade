"""Token-id output compressed by Re-Pair, in files that decode any document or span alone.

Documents are range-partitioned into ascending ids, encoded, ended with id 0
and cut into blocks of bounded size.  In each block frequent neighbouring pairs
are replaced by nonterminals, round after round, until none is frequent.  A
block's file holds the rules, the expansion length of every nonterminal, the
place of every document and the remaining symbols, so a reader expands only what
it is asked for; a document begins where the lengths of the symbols before it say.  Files are rows of a table in the
shared folder: the writer's commit protocol keeps them whole when executors are lost.

Defined results: a null text is encoded as an empty one (the end id alone); rows
that repeat an id follow each other (by hash of the text, then the text); null ids come
first; special-token strings in a text become their ids as the library does; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.common import Scratch, batches_of, shuffle_partitions, text_ids
from wayfare.llm.hashing import span_hashes
from wayfare.llm.wordtable import KeyTable, gather, lists

END_ID = 0
MAGIC = b"WFRP"


@dataclass(frozen=True)
class RePairParams:
    """``block_tokens`` bounds a block (but for a longer single document).  Rounds go on until no pair
    has ``least_uses`` places; each replaces the most frequent: at most ``rules_per_round``, none with less than a ``spread``-th of the
    places of the first (lower ones would take places that it makes better use of).  A rule costs 12 bytes and a use
    saves one symbol of 2, or of 4 where symbols are more than 65,536."""

    block_tokens: int = 1 << 20
    rules_per_round: int = 3_000
    spread: int = 16
    least_uses: int = 8


# ---- grammar -----------------------------------------------------------------


def compress(ids: np.ndarray, starts: np.ndarray, params: RePairParams = RePairParams()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols, their document starts, the rules (n x 2), the lengths of their expansions and the first nonterminal.

    No pair crosses a document's start, so documents stay separately decodable.
    """
    symbols, places = ids.astype(np.uint32), starts[:-1].astype(np.int64)
    first = int(symbols.max()) + 1 if len(symbols) else 1
    rules, sizes = [np.zeros((0, 2), dtype=np.uint32)], [np.zeros(0, dtype=np.int64)]
    lengths = np.ones(first, dtype=np.int64)  # of every symbol
    want = params.rules_per_round
    pairs = _Pairs(symbols, places, params.least_uses)
    while True:
        at, place, top = pairs.most_frequent(symbols, want, params.spread)
        if not len(top):
            break
        # of overlapping places, every second of a run from its left end
        even = _offsets(at) % 2 == 0
        at, place = at[even], place[even]
        uses = np.bincount(place, minlength=len(top))
        kept = uses >= min(max(3, params.least_uses // 2), params.least_uses)
        if not kept.any():
            want = 1  # these pairs take each other's places; one alone has all of its own
            continue
        want = params.rules_per_round
        if not kept.all():
            chosen = kept[place]
            at, place = at[chosen], (np.cumsum(kept) - 1)[place[chosen]]
        top = top[kept]
        rules.append(np.stack([(top >> np.uint64(32)).astype(np.uint32), top.astype(np.uint32)], axis=1))
        sizes.append(lengths[rules[-1]].sum(axis=1))
        symbols[at] = (len(lengths) + place).astype(np.uint32)
        lengths = np.concatenate([lengths, sizes[-1]])
        stay = np.ones(len(symbols), dtype=bool)
        stay[at + 1] = False
        stay = np.flatnonzero(stay)
        symbols = symbols.take(stay)
        places = places - np.searchsorted(at, places)
        pairs.replaced(at, stay, symbols, places)
    return symbols, np.append(places, len(symbols)), np.concatenate(rules), np.concatenate(sizes), first


class _Pairs:
    """Where the pairs stand that have ``least`` places or more, with their exact counts.

    A pair has its most places in the round that makes its symbols; later ones only take places away.  So
    what has too few then is never looked at again, and a round looks up only the places beside new symbols.
    Pairs of a symbol with itself are held apart: which of a run's places count depends on its left end.
    """

    def __init__(self, symbols: np.ndarray, places: np.ndarray, least: int):
        self._least = least
        self._known = np.zeros(0, dtype=np.uint64)
        self._counts = np.zeros(0, dtype=np.int64)
        self._twins = np.zeros(0, dtype=np.int64)  # ascending places
        self._code = np.full(len(symbols), -1, dtype=np.int32)  # the pair that begins at each place
        self._add(np.arange(len(symbols)), symbols, places)

    def _add(self, at: np.ndarray, symbols: np.ndarray, places: np.ndarray) -> None:
        """Take up the pairs at these ascending places: none of them is known.  No pair crosses a document's start."""
        last = np.zeros(len(symbols), dtype=bool)
        last[places[(places > 0) & (places < len(symbols))] - 1] = True
        last[-1:] = True
        at = at[~last.take(at)]
        left, right = symbols.take(at), symbols.take(at + 1)
        twins = left == right
        self._twins = np.union1d(self._twins, at[twins])
        # counts by hash bucket come first: a bucket may hold several pairs, so one with too few
        # places holds no frequent pair, and only the places in the others are looked at
        bits = max(10, len(at).bit_length())
        bucket = left * np.uint32(0x9E3779B1)
        bucket ^= right * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F)
        bucket *= np.uint32(0xC2B2AE35)
        bucket >>= np.uint32(32 - bits)
        bucket = bucket.astype(np.intp)
        often = (np.bincount(bucket, minlength=1 << bits) >= self._least).take(bucket)
        often &= ~twins
        often = np.flatnonzero(often)
        at, bucket = at.take(often), bucket.take(often)
        pairs = left.take(often).astype(np.uint64) << np.uint64(32) | right.take(often)
        # one pair of each bucket is counted by it, the others are sorted
        held = np.zeros(1 << bits, dtype=np.uint64)
        held[bucket] = pairs
        mine = held.take(bucket) == pairs
        if not mine.all():
            other = ~mine
            found, place, counts = np.unique(pairs[other], return_inverse=True, return_counts=True)
            self._know(at[other], found, counts, place)
            at, bucket = at[mine], bucket[mine]
        self._know(at, held, np.bincount(bucket, minlength=1 << bits), bucket)

    def _know(self, at: np.ndarray, pairs: np.ndarray, counts: np.ndarray, place: np.ndarray) -> None:
        """Keep the pairs that have enough places; ``place`` is the pair of each place of ``at``."""
        often = np.flatnonzero(counts >= self._least)
        number = np.full(len(pairs), -1, dtype=np.int32)
        number[often] = len(self._known) + np.arange(len(often))
        self._code[at] = number.take(place)
        self._known = np.concatenate([self._known, pairs[often]])
        self._counts = np.concatenate([self._counts, counts[often]])

    def most_frequent(self, symbols: np.ndarray, want: int, spread: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the ``want`` most frequent pairs, with the rank of each place's pair, and the pairs by rank;
        of equal counts the smaller pair first, and none with less than a ``spread``-th of the first's places."""
        even = self._twins[_offsets(self._twins) % 2 == 0]
        doubled, twin_place, twin_counts = np.unique(symbols[even], return_inverse=True, return_counts=True)
        pairs = np.concatenate([self._known, doubled.astype(np.uint64) << np.uint64(32) | doubled])
        counts = np.concatenate([self._counts, twin_counts])
        top = np.flatnonzero(counts >= max(self._least, -(-counts.max(initial=0) // spread)))
        if len(top) > want:
            top = top[counts[top] >= np.partition(counts[top], -want)[-want]]
        top = top[np.lexsort((pairs[top], -counts[top]))[:want]]
        rank = np.full(len(pairs) + 1, -1, dtype=np.int32)  # the last for places without a pair
        rank[top] = np.arange(len(top))
        place = rank[self._code]
        at = np.flatnonzero(place >= 0)
        place = place.take(at)
        twin_place = rank[len(self._known) + twin_place]
        even, twin_place = even[twin_place >= 0], twin_place[twin_place >= 0]
        if len(even):
            at, place = np.concatenate([at, even]), np.concatenate([place, twin_place])
            order = np.argsort(at)
            at, place = at[order], place[order]
        return at, place, pairs[top]

    def replaced(self, at: np.ndarray, stay: np.ndarray, symbols: np.ndarray, places: np.ndarray) -> None:
        """The symbols at ``at`` and after it have become one; ``stay`` are the places that are left, ``symbols`` and
        ``places`` those after it."""
        changed = np.zeros(len(self._code), dtype=bool)
        for gone in (at, at + 1, at[at > 0] - 1):
            self._counts -= np.bincount(self._code.take(gone) + 1, minlength=len(self._counts) + 1)[1:]
            self._code[gone] = -1
            changed[gone] = True
        self._twins = self._twins[~changed.take(self._twins)]
        self._twins -= np.searchsorted(at, self._twins)
        self._code = self._code.take(stay)
        beside = (at - np.arange(len(at))).repeat(2)
        beside[::2] -= 1
        self._add(beside[np.diff(beside, prepend=-1) > 0], symbols, places)


def _offsets(at: np.ndarray) -> np.ndarray:
    """How far each of ascending places is from the left end of its run of neighbours."""
    begins = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    return np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))


def symbol_table(grammar: np.ndarray, lengths: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """What every symbol stands for, flat, with starts: a token for itself, then the nonterminals.

    The expansion lengths say where each expansion stands.  A rule's parts are filled in before it is, so rules are
    taken by how deep they nest.
    """
    starts = np.concatenate([np.arange(first, dtype=np.int64), first + np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])])
    flat = np.empty(int(starts[-1]), dtype=np.uint32)
    flat[:first] = np.arange(first, dtype=np.uint32)
    ready = np.zeros(first + len(grammar), dtype=bool)
    ready[:first] = True
    sizes_of = np.diff(starts)
    left = np.arange(len(grammar))
    parts = grammar.astype(np.int64)
    if (sizes_of[first:] != sizes_of[parts].sum(axis=1)).any():
        raise ValueError("the lengths are not those of the rules")
    while len(left):
        now = ready[parts[left]].all(axis=1)
        if not now.any():
            raise ValueError("the grammar refers to itself")
        rules, left = left[now], left[~now]
        for side, begin in ((0, starts[first + rules]), (1, starts[first + rules] + sizes_of[parts[rules, 0]])):
            piece = gather(flat, starts, parts[rules, side])
            sizes = sizes_of[parts[rules, side]]
            ends = np.cumsum(sizes)
            flat[np.repeat(begin - ends + sizes, sizes) + np.arange(len(piece))] = piece
        ready[first + rules] = True
    return flat, starts


# ---- file format -------------------------------------------------------------


def write_block(ids: np.ndarray, starts: np.ndarray, params: RePairParams = RePairParams()) -> bytes:
    """A block's file: header, rules, expansion lengths, token and symbol starts of documents, symbols."""
    symbols, places, grammar, lengths, first = compress(ids, starts, params)
    kind = "<u2" if first + len(grammar) <= 1 << 16 else "<u4"
    head = struct.pack("<4sBIIQQI", MAGIC, int(kind[2]), first, len(grammar), len(ids), len(symbols), len(starts) - 1)
    return b"".join(
        [head, grammar.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), starts.astype("<u8").tobytes(), places.astype("<u8").tobytes(), symbols.astype(kind).tobytes()]
    )


class Block:
    """A reader of one file."""

    def __init__(self, data: bytes):
        magic, width, self.first, rules, self.n_tokens, n_symbols, self.n_docs = struct.unpack_from("<4sBIIQQI", data)
        if magic != MAGIC:
            raise ValueError("not a block")
        at = struct.calcsize("<4sBIIQQI")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        self.grammar = take("<u4", 2 * rules).reshape(-1, 2)
        self.lengths = take("<u4", rules)
        self.starts = take("<u8", self.n_docs + 1).astype(np.int64)
        self.places = take("<u8", self.n_docs + 1).astype(np.int64)
        self.symbols = take(f"<u{width}", n_symbols)
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def _symbols_table(self) -> tuple[np.ndarray, np.ndarray]:
        if self._table is None:
            self._table = symbol_table(self.grammar, self.lengths, self.first)
        return self._table

    def document(self, i: int) -> np.ndarray:
        """All ids of the i-th document."""
        return gather(*self._symbols_table(), self.symbols[self.places[i] : self.places[i + 1]])

    def documents(self) -> list[np.ndarray]:
        """All ids of all documents, cut where the expansion lengths of the symbols before each say."""
        if not self.n_docs:
            return []
        flat, begins = self._symbols_table()
        ends = np.concatenate([[0], np.cumsum(np.diff(begins)[self.symbols])])
        cuts = ends[self.places]
        if (cuts != self.starts).any():
            raise ValueError("the lengths of the symbols do not add up to the documents")
        return np.split(gather(flat, begins, self.symbols), cuts[1:-1])

    def span(self, begin: int, end: int) -> np.ndarray:
        """Ids ``begin`` to ``end`` of the block: only the symbols that cover the span are expanded,
        found by the documents' starts and the expansion lengths."""
        begin, end = max(begin, 0), min(end, self.n_tokens)
        if begin >= end:
            return np.zeros(0, dtype=np.uint32)
        doc = int(np.searchsorted(self.starts, begin, "right")) - 1
        last = int(np.searchsorted(self.starts, end, "left"))
        run = self.symbols[self.places[doc] : self.places[last]].astype(np.int64)
        sizes = np.ones(len(run), dtype=np.int64)
        high = run >= self.first
        sizes[high] = self.lengths[run[high] - self.first]
        ends = self.starts[doc] + np.cumsum(sizes)
        a, z = int(np.searchsorted(ends, begin, "right")), int(np.searchsorted(ends, end, "left"))
        out: list[int] = []
        for s in run[a : z + 1].tolist():
            stack = [s]
            while stack:
                x = stack.pop()
                if x >= self.first:
                    p, q = self.grammar[x - self.first].tolist()
                    stack += [q, p]
                else:
                    out.append(x)
        skip = begin - int(ends[a] - sizes[a])
        return np.array(out[skip : skip + end - begin], dtype=np.uint32)


# ---- encoding ----------------------------------------------------------------

#: Byte classes of the byte-level splitter: white space, letters (with the bytes of two-byte Latin letters),
#: digits, other, end of a text; 9 marks bytes whose texts are split by the library itself.
_KIND = np.full(256, 9, dtype=np.uint8)
_KIND[[9, 10, 13, 32]] = 0
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = _KIND[0x80:0xC0] = _KIND[0xC3:0xCA] = 1
_KIND[39] = 9  # an apostrophe may begin a contraction
_KIND[0] = 4
_NO_LETTER = (b"\xc3\x97", b"\xc3\xb7")  # the two signs among the Latin letters


def word_bounds(data: np.ndarray) -> np.ndarray:
    """Starts of the words of texts that each end with a zero byte; an ending is a word of its own.

    A word is a run of letters, digits or other characters with the space before it, or
    white space: a run's last character stands apart where something follows.
    """
    kind = np.frombuffer(data.tobytes().translate(_KIND.tobytes()), dtype=np.uint8)
    before, after = np.concatenate([[4], kind[:-1]]), np.concatenate([kind[1:], [4]])
    space = kind == 0
    joined = np.concatenate([[False], data[:-1] == 32])
    starts = space & ((before != 0) | ((after != 0) & (after != 4)))
    starts |= ~space & (kind != before) & ~joined
    starts |= kind == 4
    return np.flatnonzero(starts)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different values in ascending order, a place of each (any: no stable sort is needed) and each place's number among them."""
    order = np.argsort(values)
    sorted_ = values.take(order)
    new = np.ones(len(values), dtype=bool)
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
    codes = np.empty(len(values), dtype=np.int64)
    codes[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return sorted_.take(at), order.take(at), codes


class ByteCoder:
    """A byte-level tokenizer file as the ``tokenizers`` library applies it.

    The library encodes each different word once; words are what its byte-level
    splitter cuts, so the ids are those of the whole text.  Words are told apart by
    64-bit hashes.  Texts with anything but plain Latin text go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # a task has one core: the library's own threads would only wait for each other
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._library = Tokenizer.from_file(path)
        self._special = [t.content.encode() for t in self._library.get_added_tokens_decoder().values()]
        self._table = KeyTable()
        # tokens that begin with a space, which is what byte-level vocabularies write as this letter
        self._begins = np.zeros(self._library.get_vocab_size(), dtype=bool)
        self._begins[[i for token, i in self._library.get_vocab().items() if token.startswith("\u0120")]] = True

    def _encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of the words ``data[start:end]``.

        A space and letters are a word wherever they stand, so many such words are encoded as one
        text and told apart by the tokens that begin with a space; others one by one.
        """
        raw = data.tobytes()
        joinable = (data[starts] == 32) & (ends - starts > 1) & (_KIND[data[ends - 1]] == 1)
        spans = np.stack([starts[joinable], ends[joinable]])
        easy = gather(data, np.append(spans.T.ravel(), 0), 2 * np.arange(spans.shape[1])).tobytes()
        cuts = np.append(np.concatenate([[0], np.cumsum(spans[1] - spans[0])])[::64], len(easy)).tolist()
        joined = self._encode([easy[a:z].decode("utf-8", "surrogatepass") for a, z in zip(cuts, cuts[1:]) if a < z])
        ids = lists(joined)[1]
        begins = np.flatnonzero(self._begins[ids])
        if len(begins) != spans.shape[1]:
            return lists(self._encode([raw[a:z].decode("utf-8", "surrogatepass") for a, z in zip(starts.tolist(), ends.tolist())]))
        lengths = np.zeros(len(starts), dtype=np.int64)
        lengths[joinable] = np.diff(np.append(begins, len(ids)))
        other, other_ids = lists(self._encode([raw[a:z].decode("utf-8", "surrogatepass") for a, z in zip(starts[~joinable].tolist(), ends[~joinable].tolist())]))
        lengths[~joinable] = other
        flat = np.empty(int(lengths.sum()), dtype=np.uint32)
        easy_ids = np.repeat(joinable, lengths)
        flat[easy_ids], flat[~easy_ids] = ids, other_ids
        return lengths, flat

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, raw: list[bytes]) -> list[bool]:
        """Which texts are of known bytes only, without the signs and strings that words cannot be cut by."""
        joined = b"\0".join(raw)
        odd = np.flatnonzero(np.frombuffer(joined.translate(_KIND.tobytes()), dtype=np.uint8) > 4)
        out = [b"\0" not in b for b in raw]
        at = np.cumsum([len(b) + 1 for b in raw])
        for i in np.unique(np.searchsorted(at, odd, "right")).tolist():
            out[i] = False
        for text in (*_NO_LETTER, *self._special):
            if text in joined:
                out = [o and text not in b for o, b in zip(out, raw)]
        return out

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        plain = self._plain(raw)
        whole = iter(self._encode([t for t, p in zip(texts, plain) if not p]))
        known = iter(self._encode_plain([b for b, p in zip(raw, plain) if p]))
        return [next(known) if p else np.array(next(whole), dtype=np.uint32) for p in plain]

    def _encode_plain(self, raw: list[bytes]) -> list[np.ndarray]:
        if not raw:
            return []
        joined = b"\0".join(raw) + b"\0"
        data = np.frombuffer(joined, dtype=np.uint8)
        starts = word_bounds(data)
        ends = np.append(starts[1:], len(data))
        ending = data[starts] == 0
        text_of = np.cumsum(ending)[~ending]
        starts, ends = starts[~ending], ends[~ending]
        keys, first, codes = _distinct(span_hashes(data, starts, ends))

        def encode(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            parts = [self._encode_words(data, starts[first[at]], ends[first[at]]) for at in np.array_split(new, -(-len(new) // 20_000))]
            return np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])

        words = self._table.number(keys, encode)[codes]
        lengths = self._table.lengths(words)
        per_text = np.bincount(text_of, weights=lengths, minlength=len(raw)).astype(np.int64)
        out = np.split(self._table.ids(words), np.cumsum(per_text)[:-1])
        self._table.trim()
        return out


@lru_cache(maxsize=2)
def coder(path: str) -> ByteCoder:
    return ByteCoder(path)


def write_shards(docs: DataFrame, path: str, params: RePairParams = RePairParams()) -> DataFrame:
    """Files ``shard, block, doc_ids, n_tokens, data`` of all documents in ascending order of id, in the shared folder."""
    element = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, block = TaskContext.get().partitionId(), 0
        names: list = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> pd.DataFrame:
            starts = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)
            data = write_block(np.concatenate(held), starts, params)
            return pd.DataFrame({"shard": [shard], "block": [block], "doc_ids": [list(names)], "n_tokens": [int(starts[-1])], "data": [data]})

        end = np.array([END_ID], dtype=np.uint32)
        for batch in batches:
            for begin in range(0, len(batch), 500):
                part = batch.iloc[begin : begin + 500]
                for name, ids in zip(part["doc_id"], coder(path).encode_batch(list(part["text"]))):
                    if held and size + len(ids) + 1 > params.block_tokens:
                        yield close()
                        names, held, size, block = [], [], 0, block + 1
                    names.append(name)
                    held.append(np.concatenate([ids, end]))
                    size += len(ids) + 1
        if held:
            yield close()

    # rows of one id may be split between ranges, by the hash of their texts; copies alike in both stay together
    text = [F.xxhash64("text"), F.col("text")]
    ordered = (
        docs.select("doc_id", "text")
        .repartitionByRange(shuffle_partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(), text[0])
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), *text)
    )
    files = text_ids(ordered).mapInPandas(run, "shard int, block int, doc_ids array<string>, n_tokens long, data binary")
    with batches_of(docs.sparkSession, 1_000):
        return Scratch(docs.sparkSession, "repair").table(files.withColumn("doc_ids", F.col("doc_ids").cast(f"array<{element}>")), "blocks")


def read_shards(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from its file."""
    element = files.schema["doc_ids"].dataType.elementType.simpleString()
    # one row a shard, then one a block: metadata only
    by_shard = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    shards = by_shard.select(F.col("shard").alias("shard_"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    in_shard = Window.partitionBy("shard").orderBy("block")
    blocks = files.select(F.col("shard").alias("s_"), F.col("block").alias("b_"), (F.sum("n_tokens").over(in_shard) - F.col("n_tokens")).alias("inner"))
    base = blocks.join(shards, F.col("s_") == F.col("shard_")).select("s_", "b_", (F.col("before") + F.col("inner")).alias("base"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, number, doc_ids, data in zip(batch["shard"], batch["block"], batch["doc_ids"], batch["data"]):
                block = Block(data)
                ids = block.documents()
                yield pd.DataFrame(
                    {
                        "doc_id": pd.Series(list(doc_ids), dtype=object),
                        "shard": shard,
                        "block": number,
                        "at": block.starts[:-1],
                        "n_tokens": [len(x) for x in ids],
                        "ids_crc32": [zlib.crc32(x.astype("<u4", copy=False)) for x in ids],
                    }
                )

    named = files.select("shard", "block", F.col("doc_ids").cast("array<string>").alias("doc_ids"), "data")
    decoded = named.mapInPandas(run, "doc_id string, shard int, block int, at long, n_tokens long, ids_crc32 long")
    decoded = decoded.withColumn("doc_id", F.col("doc_id").cast(element))
    with batches_of(files.sparkSession, 1):  # a file of megabytes at a time
        decoded = Scratch(files.sparkSession, "decoded").table(decoded, "documents")
    return decoded.join(base, (F.col("shard") == F.col("s_")) & (F.col("block") == F.col("b_"))).select(
        "doc_id", (F.col("base") + F.col("at")).cast("long").alias("start"), "n_tokens", "ids_crc32"
    )

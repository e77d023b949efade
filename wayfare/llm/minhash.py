"""Near-duplicate detection: banded MinHash candidates, b-bit signatures, exact confirmation.

1. Each document's set of 5-word shingles gives minima under many hash
   functions.  Bands of minima make candidate buckets; of each minimum only the
   low 4 bits are kept, packed into longs.
2. Documents with equal sets are one node from here on, whatever their number.
3. In each bucket every node is paired with one pivot (the node that meets most others), not
   with every other.  Pairs whose similarity, estimated from the signatures by bit counts
   and corrected for chance agreement, is clearly too low are dropped; the others
   are confirmed on the full sets.  Links are closed into components.
4. Buckets that still hold several components are open: their nodes outside the largest
   component are compared with all others of different components.  In a small bucket such
   pairs are gathered.  In a large one (a passage that many texts share, a cloud of near copies)
   an exact bound comes first: of a node's shingles only those that some other node has
   can lie in an intersection, so a node with too few of them for any partner in its bucket can have no link
   there and leaves it.  What stays meets in blocks of bounded bytes and is confirmed in place.
   No candidate is left out and no group is expanded into all pairs.

With 32 bands of 5 minima a link is missed by all bands with probability 3e-6 at a
similarity of 0.8, 7e-9 at 0.85 and 4e-13 at 0.9.  The check of the signatures drops a link
at the threshold with probability 4e-10 at 80 per cent and 8e-10 at 85.  Shingles are 64-bit
hashes and nodes 128-bit digests of their sets.

Defined results: a text without words (or null) has an empty set, is linked with
nothing and stays; fewer than 5 words are one shingle; a null id takes part but
is no component's id while another member has one; rows that repeat an id each get the
component of their own text; extra columns are ignored; an empty table gives no rows.
``one_of_each`` decides by row: of a component's rows the one with the smallest id (nulls last; then by the
text's hash, then by the whole row) stays, whatever its id shares with other rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import Scratch, batches_of, fresh
from wayfare.llm.hashing import BASE, mix, span_hashes

SHINGLE = 5


@dataclass(frozen=True)
class MinHashParams:
    """``percent``: least 100 * intersection / union of a link.

    ``slack`` standard deviations of the estimate below the threshold are still
    confirmed.  ``broadcast_rows`` is the most node ids sent to every executor;
    beyond it the same join is shuffled.  Buckets of more than ``small`` nodes are confirmed in
    blocks of about ``block_bytes`` a side.  A pivot's partners are confirmed ``star`` at a time, and
    shingles are counted ``count_at_once`` at a time.
    """

    percent: int = 80
    bands: int = 32
    rows: int = 5
    slack: float = 6.5
    broadcast_rows: int = 1_000_000
    block_bytes: int = 2_000_000
    small: int = 64
    star: int = 1_000
    count_at_once: int = 1 << 19

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def longs(self) -> int:
        return -(-self.hashes * BITS // 64)

    @property
    def least_equal(self) -> int:
        """Least number of equal packed minima of a pair that is worth confirming."""
        p = self.percent / 100 + (1 - self.percent / 100) / (1 << BITS)
        return int(self.hashes * p - self.slack * sqrt(self.hashes * p * (1 - p)))


BITS = 4  # kept of each minimum
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FACTORS = np.random.default_rng(11).integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Rows that carry texts are handed to Python so many at a time.
BATCH_ROWS = 1_000
#: Bytes of a node in a block besides its text.
NODE_BYTES = 600


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words, A-Z lower-cased."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    return span_hashes(data, starts, ends)


def shingles(text: str | None) -> np.ndarray:
    """The sorted set of 5-word shingle hashes; the whole sequence for fewer words; empty for none."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = max(1, len(words) - SHINGLE + 1)
    total = np.full(n, min(len(words), SHINGLE), dtype=np.uint64)
    for j in range(min(SHINGLE, len(words))):
        total += words[j : j + n] * _FACTORS[j]
    return np.unique(mix(total))


def minima(found: np.ndarray, params: MinHashParams) -> np.ndarray:
    """Minimum of each hash function over a set."""
    rng = np.random.default_rng(5)
    a = (rng.integers(0, 1 << 31, params.hashes, dtype=np.uint32) << np.uint32(1) | np.uint32(1))[:, None]
    b = rng.integers(0, 1 << 32, params.hashes, dtype=np.uint32)[:, None]
    x = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    out = np.full(params.hashes, 0xFFFFFFFF, dtype=np.uint32)
    for begin in range(0, len(x), 1024):
        np.minimum(out, (x[None, begin : begin + 1024] * a + b).min(axis=1), out=out)
    return out


def signature(found: np.ndarray, params: MinHashParams) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits of the minima (longs), and the band keys (longs; a band's number is part of its key)."""
    low = minima(found, params)
    keys = np.arange(1, params.bands + 1, dtype=np.uint64) * np.uint64(BASE)
    for column in low.reshape(params.bands, params.rows).T:
        keys = mix(keys + column)
    nibbles = np.zeros(params.longs * 64 // BITS, dtype=np.uint8)
    nibbles[: params.hashes] = low & np.uint32((1 << BITS) - 1)
    return (nibbles[::2] | nibbles[1::2] << 4).view(np.int64), keys.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(both) - common)


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def features(docs: DataFrame, params: MinHashParams = MinHashParams()) -> DataFrame:
    """``doc_id, text_key, n_shingles, node, sig, bands`` of every row.

    ``text_key`` is a hash of the text, ``node`` a digest of its set (null if empty).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = shingles(text)
                if len(found):
                    sig, keys = signature(found, params)
                    rows.append((len(found), _digest(found), sig, keys))
                else:
                    rows.append((0, None, None, None))
            out = pd.DataFrame(rows, columns=["n_shingles", "node", "sig", "bands"])
            out.insert(0, "row", batch["row"].to_numpy())
            yield out

    # the id travels as text: a column of integers with nulls would come as floats
    id_type = docs.schema["doc_id"].dataType
    row = F.concat_ws(" ", F.xxhash64("text").cast("string"), F.col("doc_id").cast("string"))
    found = docs.select(row.alias("row"), "text").mapInPandas(run, "row string, n_shingles long, node binary, sig array<long>, bands array<long>")
    space, whole = F.instr("row", " "), F.col("row")
    key = F.when(space > 0, F.substring(whole, F.lit(1), space - 1)).otherwise(whole)
    doc_id = F.when(space > 0, F.substring(whole, space + 1, F.length("row"))).cast(id_type)
    return found.select(doc_id.alias("doc_id"), key.cast("long").alias("text_key"), "n_shingles", "node", "sig", "bands")


def equal_minima(a: Column, b: Column, params: MinHashParams) -> Column:
    """Number of hash functions whose packed minima agree, by bit counts."""
    lanes = sum(1 << (BITS * i) for i in range(64 // BITS))
    mask = F.lit(lanes - (1 << 64) if lanes >> 63 else lanes)
    different = F.lit(0)
    for i in range(params.longs):
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        different = different + F.bit_count(x.bitwiseAND(mask))
    return F.lit(params.hashes) - different


def estimate(equal: Column, params: MinHashParams) -> Column:
    """Similarity from agreeing packed minima, corrected for agreement by chance."""
    chance = 1 / (1 << BITS)
    return (equal / F.lit(float(params.hashes)) - chance) / (1 - chance)


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``node, root`` of every node of ``edges`` (``a, b``): alternating large and small stars.

    Each round is a table in the shared folder; the driver sees two numbers a round.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    now = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        seen = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join meets two plain exchanges and a hub's rows can be split between tasks
        near = scratch.table(both.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m")).withColumn("m", F.least("of", "m")), "least")
        large = both.join(near, F.col("a") == F.col("of")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.table(large, "edges")
        least = scratch.table(large.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m")), "least")
        joined = large.join(least, F.col("a") == F.col("of"))
        small = joined.select("a", F.col("m").alias("b")).unionByName(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        before, now = now, scratch.table(small.distinct(), "edges")
        scratch.drop(before, near, large, least)


def _confirm(pairs: DataFrame, texts: DataFrame, params: MinHashParams) -> DataFrame:
    """The pairs (``a, b``; a written table) whose full sets are similar enough.

    The partners of one ``a`` are dealt into pieces of about ``params.star``; each piece gets the text of
    ``a`` once, before its partners' texts.
    """
    pieces = F.ceil(F.count("*") / F.lit(params.star)).cast("int")
    hubs = pairs.groupBy(F.col("a").alias("hub")).agg(pieces.alias("pieces"))
    text = texts.select(F.col("node").alias("of"), "text")
    first = hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")).join(text, F.col("hub") == F.col("of"))
    first = first.select("hub", "piece", F.lit(None).cast("binary").alias("b"), "text")
    rest = pairs.join(hubs, F.col("a") == F.col("hub")).select("hub", F.pmod(F.xxhash64("b"), F.col("pieces")).cast("int").alias("piece"), "b")
    rest = rest.join(text, F.col("b") == F.col("of")).select("hub", "piece", "b", "text")
    percent = params.percent

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            keep = np.zeros(len(batch), dtype=bool)
            for i, (b, text) in enumerate(zip(batch["b"], batch["text"])):
                if b is None:
                    own = shingles(text)
                else:
                    keep[i] = similar(own, shingles(text), percent)
            yield pd.DataFrame({"a": batch["hub"][keep], "b": batch["b"][keep]})

    ordered = first.unionByName(rest).repartition("hub", "piece").sortWithinPartitions("hub", "piece", F.col("b").asc_nulls_first())
    return ordered.mapInPandas(run, "a binary, b binary")


def _worth(pairs: DataFrame, nodes: DataFrame, params: MinHashParams) -> DataFrame:
    """The pairs (``a, b``) that sizes and signatures do not rule out."""
    na = nodes.select(F.col("node").alias("na"), F.col("sig").alias("sig_a"), F.col("n_shingles").alias("size_a"))
    nb = nodes.select(F.col("node").alias("nb"), F.col("sig").alias("sig_b"), F.col("n_shingles").alias("size_b"))
    joined = pairs.join(nb, F.col("b") == F.col("nb")).join(na, F.col("a") == F.col("na"))
    fits = F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * params.percent
    return joined.where(fits & (equal_minima(F.col("sig_a"), F.col("sig_b"), params) >= params.least_equal)).select("a", "b")


# ---- open buckets ------------------------------------------------------------------

_COUNTED = np.dtype([("shingle", "<u8"), ("high", "<u8"), ("low", "<u8")])


def _spread(parts: int, at_once: int):
    """Nodes' shingles beside the nodes, packed and dealt into ``parts`` ranges of shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pd.DataFrame:
            rows = np.concatenate(held)
            part = ((rows["shingle"] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            rows, part = rows[order], part[order]
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            return pd.DataFrame({"part": part[cuts], "packed": [x.tobytes() for x in np.split(rows, cuts[1:])]})

        for batch in batches:
            for node, text in zip(batch["node"], batch["text"]):
                found = shingles(text)
                rows = np.empty(len(found), dtype=_COUNTED)
                rows["shingle"] = found
                rows["high"], rows["low"] = np.frombuffer(node, dtype="<u8")
                held.append(rows)
                size += len(rows)
                if size >= at_once:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _count_alone(batch: pd.DataFrame) -> pd.DataFrame:
    """Of one range: how many shingles each node has that no other node has."""
    rows = np.concatenate([np.frombuffer(x, dtype=_COUNTED) for x in batch["packed"]])
    rows = rows[np.argsort(rows["shingle"], kind="stable")]
    new = np.concatenate([[True], rows["shingle"][1:] != rows["shingle"][:-1], [True]])
    alone = rows[new[:-1] & new[1:]]
    nodes, counts = np.unique(np.stack([alone["high"], alone["low"]], axis=1), axis=0, return_counts=True)
    return pd.DataFrame({"node": [x.astype("<u8").tobytes() for x in nodes], "alone": counts.astype(np.int64)}, columns=["node", "alone"])


def shared_sizes(members: DataFrame, texts: DataFrame, params: MinHashParams) -> DataFrame:
    """``node, alone``: how many of a node's shingles no other node of ``members`` (``node, n_shingles``) has; none: no row.

    Shingles travel packed, a row a range and a flush of a task; a range holds about
    ``params.count_at_once`` of them.
    """
    total = members.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-total // params.count_at_once))
    own = members.select("node").join(texts.select(F.col("node").alias("of"), "text"), F.col("node") == F.col("of")).select("node", "text")
    packed = own.mapInPandas(_spread(parts, params.count_at_once), "part long, packed binary")
    counted = packed.groupBy("part").applyInPandas(_count_alone, "node binary, alone long")
    return counted.groupBy("node").agg(F.sum("alone").alias("alone"))


class _BlockSets:
    """The shingle sets of a block, as small numbers, for one-against-many intersections."""

    def __init__(self, texts: np.ndarray):
        sets = [shingles(t) for t in texts]
        self.sizes = np.array([len(x) for x in sets])
        _, self._flat = np.unique(np.concatenate(sets), return_inverse=True)
        self._starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self._mark = np.zeros(int(self._flat.max()) + 1, dtype=bool)

    def _of(self, i: int) -> np.ndarray:
        return self._flat[self._starts[i] : self._starts[i + 1]]

    def linked(self, i: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Which of ``others`` (none empty) are linked with row i."""
        self._mark[self._of(i)] = True
        parts = [self._of(j) for j in others]
        common = np.add.reduceat(self._mark[np.concatenate(parts)].astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in parts])[:-1]]))
        self._mark[self._of(i)] = False
        return 100 * common >= percent * (self.sizes[i] + self.sizes[others] - common)


def _compare_block(block: pd.DataFrame, params: MinHashParams, confirm: bool) -> tuple[list, list]:
    """Pairs of a query and a base row of one block: of different components, not ruled out by
    size, shared shingles or signature, in the first band that the two share.

    When confirming, only linked pairs are given.  A query's likeliest partners come first, and a pair of components that
    the block has joined already is passed over, so links are fewer than nodes.
    """
    lanes = np.uint64(sum(1 << (BITS * i) for i in range(64 // BITS)))
    query = block["query"].to_numpy(dtype=bool)
    rows, others = np.flatnonzero(query), np.flatnonzero(~query)
    a: list = []
    b: list = []
    if not len(rows) or not len(others):
        return a, b
    sigs = np.stack(block["sig"].to_numpy()).astype(np.int64).view(np.uint64)
    keys = np.stack(block["bands"].to_numpy()).astype(np.int64)
    sizes, shared, minor, nodes = block["n_shingles"].to_numpy(), block["shared"].to_numpy(), block["minor"].to_numpy(dtype=bool), block["node"].to_numpy()
    order = pd.factorize(nodes, sort=True)[0]
    labels = pd.factorize(block["label"])[0]
    band = block["band"].iloc[0]
    sets = _BlockSets(block["text"].to_numpy()) if confirm else None
    for i in rows:
        n = sizes[others]
        ok = (labels[others] != labels[i]) & (np.minimum(n, sizes[i]) * 100 >= np.maximum(n, sizes[i]) * params.percent)
        ok &= (100 + params.percent) * np.minimum(shared[others], shared[i]) >= params.percent * (n + sizes[i])
        if minor[i]:
            ok &= ~minor[others] | (order[i] < order[others])  # of two queries once is enough
        at = others[ok]
        if not len(at):
            continue
        x = sigs[i] ^ sigs[at]
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        equal = params.hashes - np.bitwise_count(x & lanes).sum(axis=-1).astype(np.int64)
        near = equal >= params.least_equal
        at, equal = at[near], equal[near]
        if not len(at):
            continue
        here = keys[i][np.argmax(keys[at] == keys[i], axis=1)] == band
        at = at[here][np.argsort(-equal[here], kind="stable")]
        if not confirm:
            a += [nodes[i]] * len(at)
            b += nodes[at].tolist()
            continue
        while len(at):
            some, at = at[:64], at[64:]
            for j in some[sets.linked(i, some, params.percent)]:
                if labels[j] != labels[i]:
                    labels[labels == labels[j]] = labels[i]
                    a.append(nodes[i])
                    b.append(nodes[j])
            at = at[labels[at] != labels[i]]
    return a, b


def _in_blocks(params: MinHashParams, confirm: bool):
    """``_compare_block`` over a stream of rows sorted by block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        now = None
        for batch in batches:
            key = batch[["band", "i", "j"]].to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            a, b = [], []
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                of = tuple(key[begin])
                if held and of != now:
                    p, q = _compare_block(pd.concat(held, ignore_index=True), params, confirm)
                    a += p
                    b += q
                    held = []
                now = of
                held.append(batch.iloc[begin:end])
            yield pd.DataFrame({"a": a, "b": b}, dtype=object)
        if held:
            a, b = _compare_block(pd.concat(held, ignore_index=True), params, confirm)
            yield pd.DataFrame({"a": a, "b": b}, dtype=object)

    return run


def _buckets(rows: DataFrame) -> DataFrame:
    """Of rows ``band, node, label, n_shingles, bytes``, the open buckets' rows with ``size, bytes_, minor_bytes, least`` of
    the bucket and whether a node is ``minor``, outside its largest component."""
    labels = rows.groupBy("band", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("weight"), F.min("n_shingles").alias("low"))
    largest = F.struct("n", "label", "weight")
    open_ = labels.groupBy(F.col("band").alias("band_")).agg(
        F.sum("n").alias("size"), F.sum("weight").alias("bytes_"), F.max(largest).alias("most"), F.min("low").alias("least"), F.count("*").alias("labels")
    ).where("labels > 1")
    open_ = open_.select("band_", "size", "bytes_", (F.col("bytes_") - F.col("most.weight")).alias("minor_bytes"), "least", F.col("most.label").alias("main"))
    return rows.join(open_, F.col("band") == F.col("band_")).withColumn("minor", F.col("label") != F.col("main")).drop("band_", "main")


def _dealt(open_: DataFrame, nodes: DataFrame, params: MinHashParams, confirm: bool) -> DataFrame:
    """Every row of an open bucket as base of its block column in each block row, and every minor row as query of its
    block row in each block column."""
    base_blocks = F.ceil(F.col("bytes_") / params.block_bytes).cast("int") if confirm else F.lit(1)
    query_blocks = F.ceil(F.col("minor_bytes") / params.block_bytes).cast("int") if confirm else F.lit(1)
    mine = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    fields = ["band", "node", "label", "minor"]
    base = open_.select(*fields, F.lit(False).alias("query"), F.explode(F.sequence(F.lit(0), query_blocks - 1)).alias("i"), mine(base_blocks).alias("j"))
    query = open_.where("minor").select(*fields, F.lit(True).alias("query"), mine(query_blocks).alias("i"), F.explode(F.sequence(F.lit(0), base_blocks - 1)).alias("j"))
    of_node = nodes.select(F.col("node").alias("of"), "sig", "bands", "n_shingles", "shared")
    return base.unionByName(query).join(of_node, F.col("node") == F.col("of")).drop("of")


def _remaining_links(live: DataFrame, nodes: DataFrame, texts: DataFrame, roots: DataFrame, params: MinHashParams, scratch: Scratch) -> list[DataFrame]:
    """Written links (``a, b``) in buckets that still hold several components."""
    spark = live.sparkSession
    r = roots.select(F.col("node").alias("of"), "root")
    label = F.coalesce("root", "node").alias("label")
    labelled = live.join(r, F.col("node") == F.col("of"), "left").select("band", "node", label, "n_shingles", F.lit(NODE_BYTES).cast("long").alias("bytes"))
    open_ = scratch.table(_buckets(labelled), "open")

    def over(rows: DataFrame, confirm: bool) -> DataFrame:
        ordered = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
        return ordered.mapInPandas(_in_blocks(params, confirm), "a binary, b binary").distinct()

    whole = nodes.withColumn("shared", F.col("n_shingles"))
    with batches_of(spark, BATCH_ROWS):
        pairs = scratch.table(over(_dealt(open_.where(F.col("size") <= params.small), whole, params, False), False), "pairs")
        found = [scratch.table(_confirm(pairs, texts, params), "links")]

    large = open_.where(F.col("size") > params.small).select("band", "node", "label", "n_shingles")
    if large.isEmpty():
        return found
    with batches_of(spark, BATCH_ROWS):
        members = scratch.table(large.select("node", "n_shingles").distinct(), "members")
        alone = scratch.table(shared_sizes(members, texts, params), "alone")
    own = members.select("node", "n_shingles").join(alone.select(F.col("node").alias("of"), "alone"), F.col("node") == F.col("of"), "left")
    own = own.select("node", (F.col("n_shingles") - F.coalesce("alone", F.lit(0))).alias("shared"), "n_shingles").where(F.col("shared") * 100 >= F.col("n_shingles") * params.percent)
    weight = texts.select(F.col("node").alias("of"), (F.octet_length("text") + NODE_BYTES).cast("long").alias("bytes"))
    own = scratch.table(own.join(weight, F.col("node") == F.col("of")).drop("of"), "able")
    able = own.select(F.col("node").alias("of"), "shared", "bytes")
    rows = large.join(able, F.col("node") == F.col("of")).drop("of")
    # a partner has at least the bucket's smallest size, and an intersection at most the shared shingles
    least = rows.groupBy(F.col("band").alias("of")).agg(F.min("n_shingles").alias("smallest"))
    can = (100 + params.percent) * F.col("shared") >= params.percent * (F.col("n_shingles") + F.col("smallest"))
    rows = rows.join(least, F.col("band") == F.col("of")).where(can).drop("of", "smallest", "shared")
    rest = scratch.table(_buckets(rows), "large")
    bounded = nodes.join(able.select(F.col("of").alias("able_"), "shared"), F.col("node") == F.col("able_"))
    dealt = _dealt(rest, bounded, params, True).join(texts.select(F.col("node").alias("of"), "text"), F.col("node") == F.col("of")).drop("of")
    with batches_of(spark, BATCH_ROWS):
        found.append(scratch.table(over(dealt, True), "links"))
    scratch.drop(open_, pairs, members, alone, own, rest)
    return found


def _linked(docs: DataFrame, params: MinHashParams, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Written tables: every row as ``doc_id, text_key, n_shingles, node``, and ``node, root`` of the nodes that
    are linked or have several rows."""
    spark = docs.sparkSession
    with batches_of(spark, BATCH_ROWS):
        found = scratch.table(features(docs, params), "rows")
    nodes = (
        found.where("node is not null")
        .groupBy("node")
        .agg(
            F.min_by(F.struct("doc_id", "text_key"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("rep"),
            F.count("*").alias("copies"),
            F.first("sig").alias("sig"),
            F.first("bands").alias("bands"),
            F.first("n_shingles").alias("n_shingles"),
        )
    )
    nodes = scratch.table(nodes, "nodes")
    rows = nodes.select("node", "n_shingles", F.explode("bands").alias("band"))
    shared = rows.groupBy(F.col("band").alias("of")).agg(F.count("*").alias("n")).where("n > 1")
    live = scratch.table(rows.join(shared, F.col("band") == F.col("of")).select("band", "node", "n_shingles", "n"), "buckets")
    met = live.groupBy("node").agg(F.sum("n").alias("met"))
    live_nodes = scratch.table(nodes.join(met, "node").select("node", "rep", "sig", "bands", "n_shingles", "met"), "live")

    # Only texts of nodes in some bucket are moved: each node's from the row that stands for it.
    wanted = live_nodes.select(F.col("rep.doc_id").alias("rep_"), F.col("rep.text_key").alias("key_"), "node")
    wanted = F.broadcast(wanted) if live_nodes.count() <= params.broadcast_rows else wanted
    own = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("rep_")) & (F.xxhash64("text") == F.col("key_")))
    texts = scratch.table(own.select("node", "text").dropDuplicates(["node"]), "texts")

    by_met = live.join(live_nodes.select(F.col("node").alias("of"), "met"), F.col("node") == F.col("of"))
    pivots = by_met.groupBy(F.col("band").alias("in_")).agg(F.max_by("node", F.struct("met", "node")).alias("pivot"))
    stars = live.join(pivots, F.col("band") == F.col("in_")).where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    stars = scratch.table(_worth(stars, live_nodes, params), "stars")
    with batches_of(spark, BATCH_ROWS):
        links = scratch.table(_confirm(stars, texts, params), "links")
    roots = scratch.table(components(links, scratch), "roots")
    rest = _remaining_links(live, live_nodes, texts, roots, params, scratch)
    edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    for more in rest:
        edges = edges.unionByName(more)
    closed = components(edges, scratch)
    in_component = nodes.join(closed.select(F.col("node").alias("of"), "root"), F.col("node") == F.col("of"), "left")
    grouped = scratch.table(in_component.where("root is not null or copies > 1").select("node", F.coalesce("root", "node").alias("root"), "rep"), "grouped")
    scratch.keep_only(found, grouped)
    return found, grouped


def link_components(docs: DataFrame, params: MinHashParams = MinHashParams()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    found, grouped = _linked(docs, params, Scratch(docs.sparkSession, "minhash"))
    least = grouped.groupBy(F.col("root").alias("root_")).agg(F.min("rep.doc_id").alias("component"))
    answer = grouped.join(least, F.col("root") == F.col("root_")).select(F.col("node").alias("of"), "component")
    out = found.select("doc_id", "n_shingles", "node").join(answer, F.col("node") == F.col("of"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, params: MinHashParams = MinHashParams()) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates; all columns, rows without words all stay.

    Decided by row: a row is its id and the hash of its text.  Rows that go are fewer than those
    that stay, so texts meet the keys that go, broadcast up to ``params.broadcast_rows``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "one-of-each")
    found, grouped = _linked(docs, params, scratch)
    first = F.struct(F.col("rep.doc_id").isNull(), F.col("rep.doc_id"), F.col("rep.text_key"))
    best = grouped.groupBy(F.col("root").alias("root_")).agg(F.min_by("rep", first).alias("best"))
    stays = grouped.join(best, F.col("root") == F.col("root_")).select(F.col("node").alias("of"), "best")
    rows = found.where("node is not null").join(stays, F.col("node") == F.col("of"))
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
    key = [F.col("doc_id").alias("id_"), F.col("text_key").alias("key_")]
    marked = scratch.table(rows.groupBy(*key).agg(F.max(same).alias("stays"), F.count("*").alias("rows")).where("not stays or rows > 1"), "marked")
    gone, twice = marked.where("not stays").select("id_", "key_"), marked.where("stays").select("id_", "key_")
    own, text_key = docs.columns, fresh(docs.columns, "text_key")
    keyed = docs.withColumn(text_key, F.xxhash64("text"))
    renamed = [fresh([*own, text_key], "id_"), fresh([*own, text_key], "key_")]
    on = F.col("doc_id").eqNullSafe(F.col(renamed[0])) & (F.col(text_key) == F.col(renamed[1]))
    small = marked.count() <= params.broadcast_rows
    sent = lambda t: F.broadcast(t.toDF(*renamed)) if small else t.toDF(*renamed)
    kept = keyed.join(sent(gone), on, "left_anti")
    if twice.isEmpty():
        return kept.select(*own)
    # of rows alike in id and text one stays, by the hash of all columns; a group of any size is reduced in each task first
    whole = F.struct(*[F.col(c) for c in own])
    repeats = kept.join(sent(twice), on, "left_semi").groupBy("doc_id", text_key).agg(F.min_by(whole, F.xxhash64(*own)).alias("row"))
    single = kept.join(sent(twice), on, "left_anti").select(*own)
    return single.unionByName(repeats.select("row.*"))


#: The same links and components in DuckDB SQL, at 85 per cent.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM d WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), r AS (
  SELECT doc_id AS x, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.x
)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.x = d.doc_id GROUP BY d.doc_id
"""

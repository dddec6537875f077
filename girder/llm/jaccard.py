"""Similarity join of documents on their word shingles (Jaccard), with rare-first prefix filtering.

1. Every text becomes its set of shingles (64-bit hashes). Equal sets fall
   into one class by a digest of the set.
2. A document's prefix is the few rarest shingles of its set: two sets that
   are similar enough share one of them. Rare is a global order: of the
   shingles in a part of the hash range, those of one document alone come
   first; those found most often come last; all others go by hash. Any order
   gives the same result; this one leaves most documents without near copies
   no candidates, and keeps shared passages out of prefixes.
3. Documents that share a prefix shingle are candidates, cut by the lengths of
   the sets, by the position of the shared shingle, and by a suffix filter: the
   parities of two sets, folded to a few hundred bits, differ in no more places
   than the sets do.
4. Candidates are verified on the whole sets, each pair once.

The result is the component of every document, so links inside a component
that is known already need no check. The first round checks every document
against a few members of each prefix group, which joins a group of
near copies without comparing all its pairs. Later rounds see only documents
of one prefix group that still are in different components; the last of them
checks all that is left, so no link between components is lost. A prefix
group with many such documents is compared in blocks over many tasks.

Null or empty text, and text without words, has an empty set and no links. A
text with fewer words than a shingle is one shingle as a whole. Repeated rows
of one doc_id are taken as one document by their id and keep a row each. Rows
without doc_id have no component. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.llm.components import components
from girder.llm.kernels import WordHasher, shingles, slices, text_bytes
from girder.llm.scratch import BROADCAST_IDS, rows_of_ids, scratch
from girder.session import settle

NARROW, BROAD = 512, 4096  # bits of the parities that travel with prefix shingles
CHAIN = 3  # members after it that each member of a prefix group is compared with in the first round
FREQUENT = 200_000  # shingles whose order by count is kept (16 bytes each); all others count as rare
# Shingles whose hash is in this share of the range are counted, so that those of one document come first.
COUNTED = 0.22
FEW = 16  # members of a prefix group that is compared as it is; larger groups go in blocks
CROWD = 2  # pairs left per document above which the nearest are checked before the rest
BLOCK = 2048  # documents of a prefix group compared in one block; a larger group sends a row to each block it meets
STAR = 64  # sets that are compared with one set where it has been sent to
TASK_PAIRS = 500_000  # different pairs that a task holds before it sends them on
PAIRS = "doc_id long, other long, apart int"
SETS = "doc_id long, n int, set_key binary, bits binary, counted int, token long, seen long"
PACK_BYTES = 8 << 20  # text per pack of prefix shingles
SLICE = 8 << 20  # bytes of text whose prefix shingles a task packs at once


def _sets(batch: pa.RecordBatch, hasher: WordHasher, size: int) -> Iterator[np.ndarray]:
    words, counts = hasher.words(text_bytes(batch.column("text")))
    ends = np.cumsum(counts)
    for start, end in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        yield np.unique(shingles(words[start:end], size))


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _summarise(size: int):
    """Rows of two kinds: a document with figures of its set, and a shingle frequent in this block of rows."""
    limit = np.uint64(int(COUNTED * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        held: list[np.ndarray] = []
        room = 0

        def frequent() -> pa.RecordBatch:
            nonlocal held, room
            tokens, seen = np.unique(np.concatenate(held), return_counts=True)
            at = seen >= max(3, len(held) // 400)
            n = int(at.sum())
            held, room = [], 0
            return pa.record_batch(
                {
                    "doc_id": pa.nulls(n, pa.int64()),
                    "n": pa.nulls(n, pa.int32()),
                    "set_key": pa.nulls(n, pa.binary()),
                    "bits": pa.nulls(n, pa.binary()),
                    "counted": pa.nulls(n, pa.int32()),
                    "token": tokens[at].astype(np.int64),
                    "seen": seen[at].astype(np.int64),
                }
            )

        for whole in batches:
            for batch in slices(whole):
                sizes, keys, bits, counted = [], [], [], []
                for found in _sets(batch, hasher, size):
                    sizes.append(len(found))
                    keys.append(_digest(found))
                    bits.append(_short_parity(found) if len(found) else None)
                    counted.append(int(np.searchsorted(found, limit)))
                    held.append(found)
                    room += len(found)
                none = pa.nulls(len(sizes), pa.int64())
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id"), "n": np.array(sizes, np.int32), "set_key": pa.array(keys, pa.binary()),
                        "bits": pa.array(bits, pa.binary()), "counted": np.array(counted, np.int32), "token": none, "seen": none,
                    }
                )
                if room > 4_000_000:
                    yield frequent()
        if held:
            yield frequent()

    return run


def _needed(n: int, percent: int) -> int:
    """Smallest overlap that a set of ``n`` can have with a similar one."""
    return -(-percent * n // 100)


def _parity(found: np.ndarray, width: int) -> bytes:
    """For each of ``width`` places, a power of two, whether an odd number of shingles falls on it."""
    bits = np.bincount((found >> np.uint64(20)).astype(np.int64) & (width - 1), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _short_parity(found: np.ndarray) -> bytes:
    """Enough places to tell most unrelated sets apart."""
    return _parity(found, min(BROAD, max(NARROW, 1 << int(0.4 * len(found)).bit_length())))


def _wide_parity(found: np.ndarray) -> bytes:
    """Two places for each shingle at least."""
    return _parity(found, max(64, 1 << (2 * len(found) - 1).bit_length()))


OTHERS = 1 << 40  # above any rank
PLACES = "array<struct<row_block: int, column_block: int, own: int, split: boolean>>"
PACKED = "pack int, keys binary, ids binary, places binary"


def _narrow(values: np.ndarray) -> np.ndarray:
    """Ids as 32-bit numbers where they all are."""
    return values.astype(np.uint32) if not len(values) or (values.min() >= 0 and values.max() < 1 << 32) else values


def _packed_prefixes(size: int, percent: int, order, bits: int):
    """Prefix shingles of a slice of documents by pack (leading bits of the hash): 32 more bits, documents, and places in their sets' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        tokens, ranks = order.value
        limit = np.uint64(int(COUNTED * 2**64))
        known: set[bytes] = set()
        for batch in (part for whole in batches for part in slices(whole, limit=SLICE)):
            prefixes, ids = [], []
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), _sets(batch, hasher, size), strict=True):
                if doc_id is None or not len(found):
                    continue
                if len(known) < 200_000:  # copies met in this task need one prefix
                    key = _digest(found)
                    if key in known:
                        continue
                    known.add(key)
                at = np.minimum(np.searchsorted(tokens, found), max(len(tokens) - 1, 0))
                rank = np.where(tokens[at] == found, ranks[at], 0) if len(tokens) else np.zeros(len(found), np.int64)
                length = len(found) - _needed(len(found), percent) + 1
                # Counted shingles come before the others, both by rank and then hash; sets come sorted by hash.
                inside = int(np.searchsorted(found, limit))
                first = np.argsort(rank + (np.arange(len(found)) >= inside) * OTHERS, kind="stable")[: max(length, inside)]
                prefixes.append(found[first])
                ids.append(doc_id)
            if not ids:
                continue
            sizes = np.array([len(p) for p in prefixes])
            hashes = np.concatenate(prefixes)
            owners = np.repeat(np.array(ids, np.int64), sizes)
            places = (np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint32)
            by = np.argsort(hashes, kind="stable")
            hashes, owners, places = hashes[by], owners[by], places[by]
            pack = (hashes >> np.uint64(64 - bits)).astype(np.int64)
            keys = ((hashes << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
            cuts = np.flatnonzero(np.append(True, pack[1:] != pack[:-1]))
            ends = np.append(cuts[1:], len(pack))
            where = [(a, b) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
            short = [places[a:b].astype(np.uint16) if places[a:b].max() < 1 << 16 else places[a:b] for a, b in where]
            yield pa.record_batch(
                {
                    "pack": pack[cuts].astype(np.int32),
                    "keys": pa.array([keys[a:b].tobytes() for a, b in where], pa.binary()),
                    "ids": pa.array([_narrow(owners[a:b]).tobytes() for a, b in where], pa.binary()),
                    "places": pa.array([x.tobytes() for x in short], pa.binary()),
                }
            )

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, doc_id, pos, members) of shingles that two documents have; rows come sorted by pack.

    A token is the pack and the 32 bits of a shingle's hash. Two shingles with
    one token only make more candidates.
    """

    def resolve(pack: int, rows: list) -> pa.RecordBatch:
        keys = np.concatenate([np.frombuffer(k, np.uint32) for k, _, _ in rows])
        ids = np.concatenate([np.frombuffer(i, np.int64 if len(i) == 2 * len(k) else np.uint32).astype(np.int64) for k, i, _ in rows])
        places = np.concatenate([np.frombuffer(p, np.uint32 if len(p) == len(k) else np.uint16).astype(np.int32) for k, _, p in rows])
        by = np.argsort(keys, kind="stable")
        keys, ids, places = keys[by], ids[by], places[by]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(np.append(heads, len(keys)))
        kept = np.repeat(np.minimum.reduceat(ids, heads) < np.maximum.reduceat(ids, heads), size)
        return pa.record_batch(
            {
                "token": (np.int64(pack) << 32) | keys[kept].astype(np.int64),
                "doc_id": ids[kept],
                "pos": places[kept],
                "members": np.repeat(size, size)[kept],
            }
        )

    held: list = []
    last = None
    for batch in batches:
        for pack, *row in zip(*(batch.column(c).to_pylist() for c in ("pack", "keys", "ids", "places")), strict=True):
            if held and pack != last:
                yield resolve(last, held)
                held = []
            held.append(row)
            last = pack
    if held:
        yield resolve(last, held)


def _apart(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """In how many places parities differ; the wider is folded to the narrower, which keeps parities."""
    out = np.zeros(len(one), np.int64)
    by_width: dict[tuple[int, int], list[int]] = {}
    for i, (a, b) in enumerate(zip(one, two, strict=True)):
        by_width.setdefault((len(a), len(b)), []).append(i)
    for (wide_a, wide_b), at in by_width.items():
        narrow = min(wide_a, wide_b)
        a, b = (
            np.bitwise_xor.reduce(np.frombuffer(b"".join(x[i] for i in at), np.uint8).reshape(len(at), -1, narrow), axis=1) for x in (one, two)
        )
        out[at] = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
    return out


def _crossing(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (doc_id, other, apart) of different components, with both: the smaller as one, the larger as two."""
    of_doc = labels.select(F.col("node").alias("doc_id"), F.col("component").alias("own"))
    of_other = labels.select(F.col("node").alias("other"), "component")
    own, component = F.coalesce("own", "doc_id"), F.coalesce("component", "other")
    both = pairs.join(of_doc, "doc_id", "left").join(of_other, "other", "left").where(own != component)
    return both.select("doc_id", "other", "apart", F.least(own, component).alias("one"), F.greatest(own, component).alias("two"))


def _verify(pairs: DataFrame, docs: DataFrame, size: int, percent: int, repeated: bool, stepwise: bool = False) -> DataFrame:
    """The pairs (doc_id, other) whose whole sets are similar enough, as settled links (a, b).

    Parities as wide as the sets sort out most pairs of long documents before
    whole sets travel. Sets travel to the set of ``other``, which is sent once
    for STAR of them. With ``stepwise`` the nearest pair of each document is
    checked first, then the nearest of any two components that pairs are left
    between, then all pairs that still are between components: links inside a
    component that is joined already are left out.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for whole in batches:
            for batch in slices(whole):
                found = list(_sets(batch, hasher, size))
                rows = pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id"),
                        "n": np.array([len(x) for x in found], np.int32),
                        "wide": pa.array([_wide_parity(x) if len(x) else b"" for x in found], pa.binary()),
                        "tokens": pa.array([x.tobytes() for x in found], pa.binary()),
                    }
                )
                yield rows.filter(pa.array([len(x) > 0 for x in found], pa.bool_()))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("n").to_numpy().astype(np.int64) + batch.column("other_n").to_numpy()
            allowed = total - 2 * np.ceil(total * percent / (100.0 + percent) - 1e-9)
            apart = _apart(batch.column("wide").to_pylist(), batch.column("other_wide").to_pylist())
            out = pa.record_batch({"doc_id": batch.column("doc_id"), "other": batch.column("other"), "apart": apart.astype(np.int32)})
            yield out.filter(pa.array(apart <= allowed))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.uint64)
        for batch in batches:
            links = []
            columns = (batch.column(c).to_pylist() for c in ("star", "doc_id", "is_hub"))
            for star, doc_id, is_hub, tokens in zip(*columns, batch.column("tokens"), strict=True):
                found = np.frombuffer(tokens.as_buffer(), np.uint64)
                if is_hub:
                    hub = found.copy()
                    continue
                union = len(np.union1d(hub, found))
                if 100 * (len(hub) + len(found) - union) >= percent * union:
                    links.append((doc_id, star))
            a, b = (pa.array([x[i] for x in links], pa.int64()) for i in (0, 1))
            yield pa.record_batch({"a": a, "b": b})

    def joined(named: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
        own, other = found.select("doc_id", *columns), found.select(F.col("doc_id").alias("other"), *[F.col(c).alias(f"other_{c}") for c in columns])
        return named.join(own, "doc_id").join(other, "other")

    def stars(pairs: DataFrame) -> DataFrame:
        """(doc_id, star, block, is_hub): which sets meet where."""
        crowded = pairs.groupBy("other").count().where(F.col("count") > STAR).select("other", F.ceil(F.col("count") / STAR).alias("blocks"))
        dealt = pairs.join(crowded, "other", "left")
        block = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("blocks")), F.lit(0)).cast("int").alias("block")
        rays = dealt.select("doc_id", F.col("other").alias("star"), block, F.lit(False).alias("is_hub"))
        return rays.unionByName(rays.select(F.col("star").alias("doc_id"), "star", "block", F.lit(True).alias("is_hub")).distinct())

    def compared(pairs: DataFrame, found: DataFrame, store) -> DataFrame:
        places = store(stars(pairs.select("doc_id", "other")))
        # A row of places is four times an id.
        small = places.count() <= BROADCAST_IDS // 4
        key = ["star", "block"]
        met = found.select("doc_id", "tokens").join(F.broadcast(places) if small else places, "doc_id")
        in_order = met.repartition(*key).sortWithinPartitions(*key, F.desc("is_hub"))
        return in_order.mapInArrow(linked, "a long, b long")

    with scratch(docs.sparkSession) as store:
        named = store(pairs.select("doc_id", "other"))
        wanted = store(named.select("doc_id").unionByName(named.select(F.col("other").alias("doc_id"))).distinct())
        rows = rows_of_ids(docs, wanted)
        fields = "doc_id long, n int, wide binary, tokens binary"
        found = store((rows.dropDuplicates(["doc_id"]) if repeated else rows).mapInArrow(sets, fields))
        close = store(joined(named, found, "n", "wide").mapInArrow(near, PAIRS))
        if not stepwise:
            return settle(compared(close, found, store))
        near_one = F.min(F.struct("apart", "other", "doc_id")).alias("x")
        checked = store(close.groupBy("doc_id").agg(near_one).select("doc_id", "x.other"))
        links, left = settle(compared(checked, found, store)), close
        for between in (True, False):
            left = store(_crossing(left.select("doc_id", "other", "apart").join(checked, ["doc_id", "other"], "left_anti"), components(links)))
            if left.isEmpty():
                break
            checked = store(left.groupBy("one", "two").agg(near_one).select("x.doc_id", "x.other") if between else left.select("doc_id", "other"))
            links = settle(links.unionByName(compared(checked, found, store)))
        return links


class Rows:
    """Rows of prefix groups as arrays, and the filters that pairs of them have to pass."""

    def __init__(self, parts: list[pa.RecordBatch], percent: int) -> None:
        data = pa.Table.from_batches(parts)
        self.percent = percent
        self.ids, self.n, self.pos, self.component = (data.column(c).to_numpy() for c in ("doc_id", "n", "pos", "component"))
        self.keys = np.stack([data.column(c).to_numpy() for c in ("token", "row_block", "column_block")])
        self.own, self.split = data.column("own").to_numpy(), data.column("split").to_numpy()
        self.bits = data.column("bits").to_pylist()
        change = (self.keys[:, 1:] != self.keys[:, :-1]).any(0)
        self.heads = np.flatnonzero(np.append(True, change))
        self.group = np.cumsum(np.append(0, change))

    def passing(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs (a, b) in different components, those past the length, position and suffix filters."""
        total = self.n[a].astype(np.int64) + self.n[b]
        need = np.ceil(total * self.percent / (100.0 + self.percent) - 1e-9)
        similar = np.minimum(self.n[a], self.n[b]) * np.int64(100) >= np.maximum(self.n[a], self.n[b]) * np.int64(self.percent)
        reach = np.minimum(self.n[a] - self.pos[a], self.n[b] - self.pos[b]) >= need
        keep = np.flatnonzero(similar & reach & (self.component[a] != self.component[b]))
        a, b, allowed = a[keep], b[keep], (total - 2 * need)[keep]
        apart = _apart([self.bits[i] for i in a], [self.bits[i] for i in b])
        close = apart <= allowed
        return a[close], b[close], apart[close]

    def pairs(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """(larger id, smaller id, apart) of pairs of rows."""
        a, b, apart = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
        one, two = self.ids[a], self.ids[b]
        return np.stack([np.maximum(one, two), np.minimum(one, two), apart], axis=1)


def _once(found: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Pairs of all groups of a task: two documents share many shingles of their prefixes, but leave it once.

    Where more than TASK_PAIRS different pairs are held they are sent on, and may come again.
    """

    def distinct(parts: list[np.ndarray]) -> np.ndarray:
        pairs = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        return pairs[np.append(True, (pairs[1:, :2] != pairs[:-1, :2]).any(1))] if len(pairs) else pairs

    def batch(pairs: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"doc_id": pairs[:, 0], "other": pairs[:, 1], "apart": pairs[:, 2].astype(np.int32)})

    held: list[np.ndarray] = []
    room = 0
    for pairs in found:
        held.append(pairs)
        room += len(pairs)
        if room > 2 * TASK_PAIRS:
            held = [distinct(held)]
            room = len(held[0])
            if room > TASK_PAIRS:
                yield batch(held[0])
                held, room = [], 0
    yield batch(distinct(held))


def _chained(percent: int):
    """Each row against the CHAIN rows after it in its group; rows come sorted by group."""

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        tail: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = Rows([batch] if tail is None else [tail, batch], percent)
            found = []
            for k in range(1, CHAIN + 1):
                at = np.flatnonzero(rows.group[k:] == rows.group[:-k])
                found.append(rows.passing(at, at + k))
            yield rows.pairs(found)
            tail = batch.slice(max(0, batch.num_rows - CHAIN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _once(chained(batches))

    return run


def _compared(percent: int):
    """All pairs of each group or pair of blocks; rows come sorted by them."""

    def resolve(parts: list[pa.RecordBatch]) -> np.ndarray:
        rows = Rows(parts, percent)
        sizes = np.diff(np.append(rows.heads, len(rows.ids)))
        small = (sizes <= FEW) & ~rows.split[rows.heads]
        in_small = small[rows.group]
        found = []
        for k in range(1, FEW):
            at = np.flatnonzero((rows.group[k:] == rows.group[:-k]) & in_small[k:])
            if not len(at):
                break
            found.append(rows.passing(at, at + k))
        for head, size in zip(rows.heads[~small], sizes[~small], strict=True):
            members = np.arange(head, head + size)
            left = members[rows.own[members] == 0]
            right = members[rows.own[members] == 1] if rows.split[head] else left
            for i in left:
                at = right if rows.split[head] else right[right > i]
                found.append(rows.passing(np.full(len(at), i), at))
        return rows.pairs(found)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("token", "row_block", "column_block")])
            last = int(np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0)))[-1])
            if held:
                before = [held[-1].column(c)[-1].as_py() for c in ("token", "row_block", "column_block")]
                first = np.flatnonzero(np.append((keys != np.array(before)[:, None]).any(0), True))[0]
                if first == batch.num_rows:  # the group goes on
                    held.append(batch)
                    continue
                held.append(batch.slice(0, first))
                yield resolve(held)
                held, batch, last = [], batch.slice(first), last - first
            if last > 0:
                yield resolve([batch.slice(0, last)])
            held = [batch.slice(last)]
        if held:
            yield resolve(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _once(compared(batches))

    return run


FIGURES = ["token", "doc_id", "n", "pos", "bits"]


def _chain_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Candidates (doc_id, other, apart) of prefix groups (token, doc_id, n, pos, members, bits), each once.

    A group is read in a random order, its own for each token, and each member
    meets those next to it. Large groups are dealt to many tasks.
    """
    blocks = F.when(F.col("members") > FEW, F.ceil(F.col("members") / BLOCK)).otherwise(1)
    dealt = rows.select(*FIGURES, F.pmod(F.xxhash64("doc_id", "token"), blocks).cast("int").alias("block"))
    in_order = dealt.repartition("token", "block").sortWithinPartitions("token", "block", F.xxhash64("doc_id", "token"))
    in_order = in_order.select(*FIGURES, F.col("doc_id").alias("component"), *_in_block("block", "block"))
    return in_order.mapInArrow(_chained(percent), PAIRS).dropDuplicates(["doc_id", "other"])


def _block_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Candidates (doc_id, other, apart) of the members of groups (token, doc_id, n, pos, component, bits) in different components.

    Members of the component with the most of a group need not meet each other:
    their blocks meet those of the others, which also meet among themselves.
    Where most of a group is joined already, its rows are sent about once.
    """
    counted = rows.groupBy("token", "component").count().groupBy("token")
    totals = counted.agg(F.max(F.struct("count", "component")).alias("most"), F.sum("count").alias("rows"))
    totals = totals.where(F.col("most.count") < F.col("rows")).select(
        "token",
        F.col("most.component").alias("most"),
        F.ceil(F.col("most.count") / BLOCK).cast("int").alias("most_blocks"),
        F.ceil((F.col("rows") - F.col("most.count")) / BLOCK).cast("int").alias("blocks"),
    )
    first = F.col("component") == F.col("most")
    block = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.when(first, F.col("most_blocks")).otherwise(F.col("blocks"))).cast("int")
    dealt = rows.join(totals, "token").withColumns({"first": first, "block": block})
    facing = F.when(F.col("first"), F.col("blocks")).otherwise(F.col("most_blocks"))

    def with_most(k: Column) -> Column:
        one, two = F.when(F.col("first"), F.col("block")).otherwise(k), F.when(F.col("first"), k).otherwise(F.col("block"))
        return F.struct(one.alias("row_block"), (-1 - two).alias("column_block"), (~F.col("first")).cast("int").alias("own"), F.lit(True).alias("split"))

    def among_others(k: Column) -> Column:
        return F.struct(*_in_block(F.col("block"), k))

    met = F.transform(F.sequence(F.lit(0), facing - 1), with_most)
    others = F.when(~F.col("first"), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), among_others))
    dealt = dealt.select(*FIGURES, "component", F.explode(F.concat(met, F.coalesce(others, F.array().cast(PLACES)))).alias("at"))
    key = ["token", "row_block", "column_block"]
    in_order = dealt.select(*FIGURES, "component", "at.*").repartition(*key).sortWithinPartitions(*key)
    return in_order.mapInArrow(_compared(percent), PAIRS)


def _in_block(block: Column | str, other: Column | str) -> list[Column]:
    """Where a row of ``block`` is compared with those of another, or of its own."""
    block, other = (F.col(x) if isinstance(x, str) else x for x in (block, other))
    return [
        F.least(block, other).alias("row_block"),
        F.greatest(block, other).alias("column_block"),
        (block > other).cast("int").alias("own"),
        (block != other).alias("split"),
    ]


def _open_pairs(slim: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Candidates (doc_id, other, apart), each once, between components, of prefix groups whose members have not all met."""

    def labelled(rows: DataFrame) -> DataFrame:
        found = rows.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        return found.withColumn("component", F.coalesce("component", "doc_id"))

    # Groups of one block lie together for the window already. All CHAIN + 1 members of one have met in the first round.
    group = Window.partitionBy("token")
    rows = labelled(slim.where(F.col("members").between(CHAIN + 2, BLOCK)))
    rows = rows.withColumns({"low": F.min("component").over(group), "high": F.max("component").over(group), "rows": F.count("*").over(group)})
    rows = rows.where((F.col("low") < F.col("high")) & (F.col("rows") > CHAIN + 1)).withColumn("block", F.lit(0))
    whole = rows.select(*FIGURES, "component", *_in_block("block", "block")).sortWithinPartitions("token")
    large = labelled(slim.where(F.col("members") > BLOCK))
    return whole.mapInArrow(_compared(percent), PAIRS).unionByName(_block_pairs(large, percent)).dropDuplicates(["doc_id", "other"])


def similar_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the smallest doc_id that its similar documents reach."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    summary = settle(docs.mapInArrow(_summarise(size), SETS))
    sets = summary.where("set_key is not null")
    members = sets.select("doc_id", "n", "set_key")

    # The order of rarity: bounded by FREQUENT rows, gathered and sent to the tasks.
    top = (
        summary.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "token").limit(FREQUENT)
    )
    rows = np.array([(r["token"], r["seen"]) for r in top.collect()], np.int64).reshape(-1, 2)
    by_token = np.argsort(rows[:, 0].astype(np.uint64))
    order = spark.sparkContext.broadcast((rows[by_token, 0].astype(np.uint64), rows[by_token, 1]))

    with scratch(spark) as store:
        links = _links(docs, sets, size, percent, order, store)
    labels = components(links)
    of_set = (
        members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id").groupBy("set_key").agg(F.min("component").alias("component"))
    )
    first = members.groupBy("set_key").agg(F.min("doc_id").alias("low"))
    classes = first.join(of_set, "set_key", "left")
    least = classes.where("component is not null").groupBy("component").agg(F.min("low").alias("least"))
    classes = classes.join(least, "component", "left").select("set_key", F.coalesce("least", "low").alias("component_id"))
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return members.join(classes, "set_key").select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def _links(docs: DataFrame, sets: DataFrame, size: int, percent: int, order, store) -> DataFrame:
    """Verified links (a, b) that join every component; ``sets`` has the size, parity and counted shingles of every document."""
    sets = sets.where("doc_id is not null and n > 0")
    repeated = not sets.groupBy("doc_id").count().where("count > 1").isEmpty()
    if repeated:
        sets = sets.dropDuplicates(["doc_id", "set_key"])
    figures, bits = sets.select("doc_id", "n", "counted"), sets.select("doc_id", "bits")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wide = min(31, max(6, int(total // PACK_BYTES).bit_length()))
    # Shingles travel once, ten bytes each; what one document alone has ends here.
    packed = docs.mapInArrow(_packed_prefixes(size, percent, order, wide), PACKED)
    met = packed.repartition("pack").sortWithinPartitions("pack").mapInArrow(_met, "token long, doc_id long, pos int, members long")
    # Counted shingles of one document alone come first in the order. A document
    # with enough of them for its whole prefix has no candidates and is gone.
    of_doc = Window.partitionBy("doc_id")
    inside = F.col("pos") < F.col("counted")
    alone = F.col("counted") - F.count_if(inside).over(of_doc)
    place = F.when(inside, alone + F.row_number().over(of_doc.orderBy("pos")) - 1).otherwise(F.col("pos"))
    length = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1
    placed = met.join(figures, "doc_id").withColumn("place", place.cast("int")).where(F.col("place") < length)
    # With the parities, whose rows of one document lie next to each other.
    slim = store(placed.select("token", "doc_id", "n", F.col("place").alias("pos"), "members").join(bits, "doc_id"))

    # First round: every document against a few members of each of its prefix groups.
    chained = _chain_pairs(slim, percent)
    links = _verify(chained, docs, size, percent, repeated, stepwise=True)

    # Later rounds: what shares a prefix shingle and is not in one component yet.
    nearest_only = True
    while True:
        labels = components(links)
        found = store(_open_pairs(slim, labels, percent))
        # Many pairs are left only where groups of near copies have not met yet: for these, the nearest first.
        nearest_only = nearest_only and found.count() > CROWD * sets.count()
        if nearest_only:
            # For each document and each component beside its own, the nearest by parity.
            side = labels.select(F.col("node").alias("other"), "component")
            aimed = found.join(side, "other", "left").withColumn("component", F.coalesce("component", "other"))
            found = aimed.groupBy("doc_id", "component").agg(F.min(F.struct("apart", "other")).alias("x")).select("doc_id", F.col("x.other").alias("other"))
        more = _verify(found.select("doc_id", "other"), docs, size, percent, repeated)
        links = settle(links.unionByName(more))
        if not nearest_only:
            return links
        nearest_only = more.count() > 0

"""Removing byte strings that also start in an earlier document, found with suffix arrays.

Every string of ``length`` bytes has an anchor: the place in it whose
GRAM bytes have the least hash. Equal strings have equal anchors, so only
texts around anchors that two documents share need to be compared.

0. Documents whose whole text stands in an earlier one are settled by a digest.
1. Each task lists the anchors of its documents, packed by the leading bits
   of their hashes; one task per pack finds those of two or more documents.
2. Documents with shared anchors give the text around each: the segment that
   covers the strings it is the anchor of. Segments meet by anchor.
3. In a task, the segments of many anchors are ordered side by side by suffix
   arrays (linear grouping). Strings that are equal stand together in the
   order; all but those of the smallest doc_id are covered.
4. Covered ranges go back to their documents and are cut.

An anchor in a large part of the documents does not meet in one task: a task
sends one entry for all documents it saw the anchor in, equal segments of a
task travel as one, and past HOT documents the strings of the anchor are sent
by their own content instead.

Null text is empty. Texts shorter than ``length`` keep all bytes. Rows that
repeat a doc_id, with one text or several, never cover each other, and each
loses what stands in its own text; rows without doc_id neither cover nor are
covered. An empty table gives an empty result. Bytes that are left may not be
valid UTF-8, so the kept text is binary. Columns named like an added one are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.llm.kernels import BASE, byte_values, mix, slices, text_bytes
from girder.llm.scratch import rows_of_ids
from girder.llm.suffixes import suffix_arrays
from girder.session import settle

GRAM = 24
GROUP = 1 << 18  # bytes of text handled at once; the arrays of an ordering are many times as large
PACK_BYTES = 8 << 20  # text per pack of anchors: about a twelfth of it are anchors
SLICE = 8 << 20  # bytes of text whose anchors a task lists at once
HOT = 100_000
# Where a segment stands: 16 bytes each in one value; three arrays take four times as many of a shuffled row.
OWNER = np.dtype([("doc", "<i8"), ("start", "<i4"), ("mark", "<i4")])
SPLIT = 32  # segments ordered in one string; the steps of an ordering go with it, whatever the size of a group


class Anchors:
    """Anchors of the strings of ``length`` bytes in byte strings."""

    def __init__(self, length: int) -> None:
        self.length, self.values = length, byte_values(fold=False)

    def _gram_hashes(self, data: np.ndarray) -> np.ndarray:
        """Hash of the GRAM bytes at each place, built from those of 1, 2, 4 .. bytes."""
        out, width, rest = None, 0, GRAM
        power, factor, step = self.values[data], BASE, 1
        while rest:
            if rest & 1:
                if out is None:
                    out = power
                else:
                    n = len(data) - width - step + 1
                    out = power[:n] * np.uint64(pow(BASE, width, 1 << 64)) + out[step : step + n]
                width += step
            rest >>= 1
            if rest:
                power = power[:-step] * np.uint64(factor) + power[step:]
                factor, step = factor * factor % (1 << 64), 2 * step
        return mix(out)

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(text, hash, first start, last start) of runs of strings with one anchor."""
        found = [self._group(group) for group in self._groups(texts)]
        if not found:
            return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _groups(self, texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
        """Parts (text, offset, bytes) of about GROUP bytes; a long text is cut so that no string is lost."""
        group: list[tuple[int, int, bytes]] = []
        size = 0
        for i, text in enumerate(texts):
            if len(text) < self.length:
                continue
            for start in range(0, len(text) - self.length + 1, GROUP):
                part = text[start : start + GROUP + self.length - 1]
                if group and size + len(part) > GROUP:
                    yield group
                    group, size = [], 0
                group.append((i, start, part))
                size += len(part)
        if group:
            yield group

    def _group(self, group: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join(part for _, _, part in group), np.uint8)
        sizes = np.array([len(part) for _, _, part in group])
        bounds = np.cumsum(sizes)
        hashes = self._gram_hashes(data)
        # The place in the low bits makes the leftmost of equal hashes the least.
        low = np.uint64((1 << 21) - 1)
        least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        width, span = self.length - GRAM + 1, 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: span - width], least[width - span :])
        anchor = (least & low).astype(np.int64)
        valid = np.ones(len(data), bool)
        for k in range(1, self.length):
            valid[bounds - k] = False
        starts = np.flatnonzero(valid[: len(anchor)])
        anchor = anchor[starts]
        cut = np.ones(len(starts), bool)
        cut[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(starts)) - 1
        part = np.searchsorted(bounds, starts[first], side="right")
        shift = np.array([start for _, start, _ in group]) - (bounds - sizes)
        text = np.array([i for i, _, _ in group])[part]
        # Least hashes crowd at the low end, and packs go by the leading bits: mixed once more, they spread evenly.
        return text, mix(hashes[anchor[first]]) >> np.uint64(8), starts[first] + shift[part], starts[last] + shift[part]


def _pack(length: int, bits: int):
    """A task's anchors by pack: (pack, keys, ids, times), and at once those that it knows to be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        for batch in (part for whole in batches for part in slices(whole, limit=SLICE)):
            ids = batch.column("doc_id").to_numpy()
            text, hashes, _, _ = anchors.find(text_bytes(batch.column("text")))
            if not len(text):
                continue
            by = np.lexsort((ids[text], hashes))
            hashes, owners = hashes[by], ids[text[by]]
            new = np.ones(len(by), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
            hashes, owners = hashes[new], owners[new]
            head = np.ones(len(hashes), bool)
            head[1:] = hashes[1:] != hashes[:-1]
            heads = np.flatnonzero(head)
            times = np.diff(np.append(heads, len(hashes)))
            local = np.repeat(times > 1, times)
            if local.any():
                n = int(local.sum())
                yield _rows(hashes[local], owners[local], n)
            pack = (hashes[heads] >> np.uint64(56 - bits)).astype(np.int64)
            cuts = np.flatnonzero(np.append(True, pack[1:] != pack[:-1]))
            ends = np.append(cuts[1:], len(pack))
            narrow = np.uint32 if owners.min() >= 0 and owners.max() < 1 << 32 else np.int64
            low = (hashes[heads] & np.uint64(0xFFFFFFFF)).astype(np.uint32) if bits >= 24 else (hashes[heads] >> np.uint64(24 - bits)).astype(np.uint32)
            keys = [low[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]
            owned = [owners[heads[a:b]].astype(narrow).tobytes() for a, b in zip(cuts, ends, strict=True)]
            seen = [np.minimum(times[a:b], 65535).astype(np.uint16).tobytes() for a, b in zip(cuts, ends, strict=True)]
            none = pa.nulls(len(cuts), pa.int64())
            yield pa.record_batch(
                {
                    "pack": pack[cuts].astype(np.int32), "keys": pa.array(keys, pa.binary()), "ids": pa.array(owned, pa.binary()),
                    "times": pa.array(seen, pa.binary()), "doc_id": none, "anchor": none,
                }
            )

    def _rows(hashes: np.ndarray, owners: np.ndarray, n: int) -> pa.RecordBatch:
        none = pa.nulls(n, pa.binary())
        # They only pass through the packs' tasks, so they go to any of them.
        pack = (mix(owners.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int32)
        anchor = _short(hashes, bits)
        return pa.record_batch({"pack": pack, "keys": none, "ids": none, "times": none, "doc_id": owners, "anchor": anchor})

    return run


def _short(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The pack and the 32 bits kept of an anchor's hash, as one number."""
    pack = (hashes >> np.uint64(56 - bits)).astype(np.int64)
    low = (hashes >> np.uint64(24 - bits)).astype(np.uint32) if bits < 24 else (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return (pack << 32) | low.astype(np.int64)


PACKED = "pack int, keys binary, ids binary, times binary, doc_id long, anchor long"


def _shared(hot: int):
    """(doc_id, anchor, hot) of anchors in two documents or more; rows come sorted by pack."""

    def resolve(pack: int, rows: list) -> pa.RecordBatch:
        keys = np.concatenate([np.frombuffer(k, np.uint32) for k, _, _ in rows])
        ids = np.concatenate([np.frombuffer(i, np.int64 if len(i) == 2 * len(k) else np.uint32).astype(np.int64) for k, i, _ in rows])
        times = np.concatenate([np.frombuffer(t, np.uint16) for _, _, t in rows]).astype(np.int64)
        by = np.argsort(keys, kind="stable")
        keys, ids, times = keys[by], ids[by], times[by]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(np.append(heads, len(keys)))
        least, most = np.minimum.reduceat(ids, heads), np.maximum.reduceat(ids, heads)
        documents = np.add.reduceat(times, heads)
        share = np.repeat(least < most, size)
        anchor = (np.int64(pack) << 32) | keys.astype(np.int64)
        is_hot = np.repeat(documents > hot, size)
        kept = share | is_hot
        return pa.record_batch({"doc_id": ids[kept], "anchor": anchor[kept], "hot": is_hot[kept]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        last = None
        # A batch can be all that a task reads: it is taken out in small parts.
        for batch in (part for whole in batches for part in slices(whole, "keys", limit=1 << 20)):
            known = batch.filter(batch.column("anchor").is_valid())
            if known.num_rows:
                yield pa.record_batch({"doc_id": known.column("doc_id"), "anchor": known.column("anchor"), "hot": np.zeros(known.num_rows, bool)})
            packed = batch.filter(batch.column("keys").is_valid())
            for pack, *row in zip(*(packed.column(c).to_pylist() for c in ("pack", "keys", "ids", "times")), strict=True):
                if held and pack != last:
                    yield resolve(last, held)
                    held = []
                held.append(row)
                last = pack
        if held:
            yield resolve(last, held)

    return run


def _segments(length: int, bits: int, hot_anchors):
    """(anchor, owners, segment) of a batch's shared anchors; equal segments are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        hot = hot_anchors.value
        for batch in (part for whole in batches for part in slices(whole.filter(whole.column("anchors").is_valid()), limit=SLICE)):
            ids, marks = batch.column("doc_id").to_numpy(), batch.column("mark").to_pylist()
            texts = text_bytes(batch.column("text"))
            wanted = batch.column("anchors")
            text, hashes, first, last = anchors.find(texts)
            short = _short(hashes, bits)
            counts = wanted.value_lengths().to_numpy()
            asked = np.stack([np.repeat(np.arange(len(ids)), counts), wanted.flatten().to_numpy()])
            keep = _among(text, short, asked)
            rows: dict[tuple[int, bytes], list] = {}

            def add(key: int, segment: bytes, owner: int, start: int, rows=rows, ids=ids, marks=marks) -> None:
                rows.setdefault((key, segment), []).append((int(ids[owner]), start, marks[owner]))

            for i, key, a, b in zip(text[keep].tolist(), short[keep].tolist(), first[keep].tolist(), last[keep].tolist(), strict=True):
                if key in hot:
                    for s in range(a, b + 1):
                        piece = texts[i][s : s + length]
                        add(xxhash.xxh3_64_intdigest(piece) >> 1, piece, i, s)
                else:
                    add(key, texts[i][a : b + length], i, a)
            owners = np.array([o for x in rows.values() for o in x], OWNER).tobytes()
            ends = (np.cumsum([len(x) for x in rows.values()], dtype=np.int64) * OWNER.itemsize).tolist()
            yield pa.record_batch(
                {
                    "anchor": np.array([k for k, _ in rows], np.int64),
                    "owners": pa.array([owners[a:b] for a, b in zip([0, *ends], ends)], pa.binary()),  # noqa: B905
                    "segment": pa.array([s for _, s in rows], pa.binary()),
                }
            )

    return run


def _among(text: np.ndarray, short: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which (text, short) pairs are in ``asked``."""
    both = np.concatenate([np.stack([text, short]), asked], axis=1)
    by = np.lexsort((both[1], both[0]))
    change = np.append(True, (both[:, by[1:]] != both[:, by[:-1]]).any(0))
    code = np.empty(len(by), np.int64)
    code[by] = np.cumsum(change)
    wanted = np.zeros(int(code.max(initial=0)) + 1, bool)
    wanted[code[len(text) :]] = True
    return wanted[code[: len(text)]]


def _window_least(segments: list[bytes], groups: np.ndarray, firsts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string of ``length`` bytes in distinct segments: the smallest document of its group that has it.

    Returns the numbers, segment by segment, and where each segment's begin.
    A string whose hash is alone in its group has no equal and is left out of
    the order; runs of the others are ordered by suffix arrays, at most SPLIT
    runs in one string.
    """
    sizes = np.array([len(s) for s in segments])
    bounds = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(segments), np.uint8)
    windows = sizes - length + 1
    begin = np.cumsum(windows) - windows
    segment = np.repeat(np.arange(len(sizes)), windows)
    place = np.repeat(bounds - begin, windows) + np.arange(int(windows.sum()))
    least = firsts[segment]
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    values = byte_values(fold=False)[data]
    power = np.multiply.accumulate(np.full(length, BASE, np.uint64))
    hashes = np.zeros(len(data) - length + 1, np.uint64)
    for k in range(length):
        hashes += values[k : k + len(hashes)] * power[k]
    marks = mix(hashes[place] ^ mix(groups[segment].astype(np.uint64)))
    by = np.argsort(marks, kind="stable")
    same = marks[by][1:] == marks[by][:-1]
    open_ = np.zeros(len(place), bool)
    open_[by[1:][same]] = True
    open_[by[:-1][same]] = True
    at = np.flatnonzero(open_)
    if not len(at):
        return least, begin
    cut = np.append(True, (at[1:] != at[:-1] + 1) | (segment[at[1:]] != segment[at[:-1]]))
    heads = np.flatnonzero(cut)
    tails = np.append(heads[1:], len(at)) - 1
    # Runs of strings to order, equal ones of a group once.
    runs: dict[tuple[int, bytes], int] = {}
    run_of = np.empty(len(heads), np.int64)
    for r, (a, b) in enumerate(zip(at[heads].tolist(), at[tails].tolist(), strict=True)):
        key = (int(groups[segment[a]]), data[place[a] : place[b] + length].tobytes())
        run_of[r] = runs.setdefault(key, len(runs))
    run_group = np.array([g for g, _ in runs])
    run_text = [np.frombuffer(t, np.uint8) for _, t in runs]
    owner = np.full(len(runs), np.iinfo(np.int64).max)
    np.minimum.at(owner, run_of, firsts[segment[at[heads]]])
    by = np.argsort(run_group, kind="stable")
    codes, codes_size, starts, of_run, offsets = [], [], [], [], []
    size = 0
    part = 0
    for k, r in enumerate(by.tolist()):
        text = run_text[r]
        new = k and (run_group[r] != run_group[by[k - 1]] or part == SPLIT)
        if new:
            codes.append(np.zeros(1, np.int16))
            codes_size.append(part_size + 1)
            size += 1
        if not k or new:
            part, part_size = 0, 0
        codes += [text.astype(np.int16) + 2, np.ones(1, np.int16)]
        n = len(text) - length + 1
        starts.append(np.arange(size, size + n))
        of_run.append(np.full(n, r))
        offsets.append(np.arange(n))
        size += len(text) + 1
        part_size += len(text) + 1
        part += 1
    codes.append(np.zeros(1, np.int16))
    codes_size.append(part_size + 1)
    codes = np.concatenate(codes)
    starts, of_run, offsets = np.concatenate(starts), np.concatenate(of_run), np.concatenate(offsets)
    order = suffix_arrays(codes, np.array(codes_size))
    rank = np.full(len(codes), -1, np.int64)
    rank[starts] = np.arange(len(starts))
    ordered = rank[order]
    ordered = ordered[ordered >= 0]
    text = np.lib.stride_tricks.sliding_window_view((np.maximum(codes, 1) - 2).astype(np.uint8), length)[starts]
    # Equal strings stand together; where the order was split, the first of each are compared once more.
    fresh = np.append(True, (text[ordered[1:]] != text[ordered[:-1]]).any(1) | (run_group[of_run[ordered[1:]]] != run_group[of_run[ordered[:-1]]]))
    heads_ = np.flatnonzero(fresh)
    lowest = np.minimum.reduceat(owner[of_run[ordered]], heads_)
    lead = ordered[heads_]
    keys = np.empty(len(lead), np.dtype((np.void, length + 8)))
    keys_view = keys.view(np.uint8).reshape(len(lead), length + 8)
    keys_view[:, :length] = text[lead]
    keys_view[:, length:] = run_group[of_run[lead]].astype(np.int64).view(np.uint8).reshape(-1, 8)
    _, back = np.unique(keys, return_inverse=True)
    joined = np.full(int(back.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(joined, back, lowest)
    of_string = np.empty(len(starts), np.int64)
    of_string[ordered] = np.repeat(joined[back], np.diff(np.append(heads_, len(ordered))))
    # Back from runs to the strings of the segments.
    run_begin = np.zeros(len(runs), np.int64)
    run_begin[of_run[offsets == 0]] = np.flatnonzero(offsets == 0)
    for_at = run_begin[np.repeat(run_of, tails - heads + 1)] + (np.arange(len(at)) - np.repeat(heads, tails - heads + 1))
    least[at] = np.minimum(least[at], of_string[for_at])
    return least, begin


def _covered(length: int):
    """(doc_id, mark, start, end) of covered ranges; rows come sorted by anchor."""

    def resolve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        data = pa.Table.from_batches(rows).combine_chunks()
        anchors = data.column("anchor").to_numpy()
        texts = data.column("segment").to_pylist()
        held = data.column("owners").to_pylist()
        owners = np.frombuffer(b"".join(held), OWNER)
        counts = np.array([len(x) for x in held]) // OWNER.itemsize
        docs, starts, marks = owners["doc"], owners["start"], owners["mark"]
        distinct: dict[tuple[int, bytes], int] = {}
        of_row = np.array([distinct.setdefault(x, len(distinct)) for x in zip(anchors.tolist(), texts, strict=True)])
        lowest = np.full(len(distinct), np.iinfo(np.int64).max)
        segment = np.repeat(of_row, counts)
        np.minimum.at(lowest, segment, docs)
        least, begin = _window_least([t for _, t in distinct], np.array([a for a, _ in distinct], np.int64), lowest, length)
        windows = np.array([len(t) - length + 1 for _, t in distinct])
        sizes = windows[segment]
        ahead = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(docs)), sizes)
        inner = np.arange(int(sizes.sum())) - ahead[owner]
        hit = least[begin[segment[owner]] + inner] < docs[owner]
        at = np.flatnonzero(hit)
        if not len(at):
            none = np.zeros(0, np.int64)
            return pa.record_batch({"doc_id": none, "mark": none.astype(np.int32), "start": none, "end": none})
        cut = np.append(True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]]))
        heads = np.flatnonzero(cut)
        tails = np.append(heads[1:], len(at)) - 1
        who = owner[at[heads]]
        return pa.record_batch(
            {"doc_id": docs[who], "mark": marks[who], "start": starts[who] + inner[at[heads]], "end": starts[who] + inner[at[tails]] + length}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("anchor").to_numpy()
            start = 0
            while start < batch.num_rows:
                # Whole anchors, until there is enough text for one pass.
                if size > GROUP and keys[start] != held[-1].column("anchor")[-1].as_py():
                    yield resolve(held)
                    held, size = [], 0
                end = start + int(np.searchsorted(keys[start:], keys[min(start + 2000, len(keys) - 1)], side="right"))
                part = batch.slice(start, end - start)
                held.append(part)
                size += part.nbytes
                start = end
        if held:
            yield resolve(held)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed, spans = [], [], []
        columns = (text_bytes(batch.column("text")), batch.column("mark").to_pylist(), batch.column("ranges").to_pylist())
        for text, mark, ranges in zip(*columns, strict=True):
            parts, at, gone, runs, end = [], 0, 0, 0, -1
            for x in sorted((r["start"], r["end"]) for r in ranges or () if r["mark"] == mark):
                if x[0] > end:
                    runs += 1
                    parts.append(text[at : x[0]])
                if x[1] > at:
                    gone += x[1] - max(x[0], end) if end > x[0] else x[1] - x[0]
                    at = end = x[1]
            parts.append(text[at:])
            kept.append(b"".join(parts))
            removed.append(gone)
            spans.append(runs)
        names = [c for c in batch.schema.names if c != "ranges"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
            [*names, "n_removed", "n_spans", "kept"],
        )


def whole_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, mark) of documents whose whole text is that of a smaller doc_id."""
    texts = docs.select("doc_id", "mark", F.md5("text").alias("digest")).where("doc_id is not null and digest is not null")
    first = texts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    return texts.join(first, "digest").where("doc_id > first").select("doc_id", "mark").distinct()


def covered_ranges(texts: DataFrame, length: int = 50, hot: int = HOT) -> DataFrame:
    """(doc_id, mark, start, end): byte ranges of ``texts`` (doc_id, mark, text) covered by strings that start in a smaller doc_id too.

    ``mark`` is a hash of the text that tells the rows of one doc_id apart.
    """
    spark = texts.sparkSession
    long_enough = texts.where(f"doc_id is not null and octet_length(text) >= {length}")
    total = long_enough.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, int(total // PACK_BYTES).bit_length())
    packed = long_enough.mapInArrow(_pack(length, bits), PACKED)
    shared = packed.repartition("pack").sortWithinPartitions("pack").mapInArrow(_shared(hot), "doc_id long, anchor long, hot boolean")
    wanted = settle(
        shared.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    )
    # Few by definition: at most one for every ``hot`` entries of documents.
    hot_anchors = {r["anchor"] for r in wanted.select(F.explode("hot").alias("anchor")).distinct().collect()}
    hot_sent = spark.sparkContext.broadcast(hot_anchors)
    # A left join like the last one, so that both read one shuffle of the texts.
    segments = texts.join(wanted.select("doc_id", "anchors"), "doc_id", "left").mapInArrow(
        _segments(length, bits, hot_sent), "anchor long, owners binary, segment binary"
    )
    met = segments.repartition("anchor").sortWithinPartitions("anchor")
    return met.mapInArrow(_covered(length), "doc_id long, mark int, start long, end long")


def drop_repeats(docs: DataFrame, length: int = 50, hot: int = HOT) -> DataFrame:
    """``docs`` with n_removed, n_spans and kept: the bytes of the text that are left.

    A document whose whole text stands in a smaller doc_id is covered as it is,
    and what it could cover, the smaller one does.
    """
    own = [c for c in docs.columns if c.lower() not in ("n_removed", "n_spans", "kept")]
    # Other columns travel in a struct, where no name meets one used here.
    others = [c for c in own if c not in ("doc_id", "text")]
    packed = [F.struct(*others).alias("own")] if others else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.hash("text").alias("mark"), *packed)
    copies = settle(whole_copies(docs.where(f"octet_length(text) >= {length}")))
    # The columns in one order, or the two joins by doc_id would shuffle the texts twice.
    texts = rows_of_ids(docs, copies, keep=False).select(*docs.columns)
    ranges = covered_ranges(texts.select("doc_id", "text", "mark"), length, hot)
    ranges = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("mark", "start", "end")).alias("ranges"))
    back = [F.col(c) if c in ("doc_id", "text") else F.col("own")[c].alias(c) for c in own]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    cut = texts.join(ranges, "doc_id", "left").select(*docs.columns, "ranges").mapInArrow(_cut, f"{kinds}, n_removed long, n_spans long, kept binary")
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    whole = size >= length
    again = rows_of_ids(docs, copies).select(
        *back,
        F.when(whole, size).otherwise(0).cast("long").alias("n_removed"),
        whole.cast("long").alias("n_spans"),
        F.when(whole, F.lit("").cast("binary")).otherwise(F.coalesce("text", F.lit("")).cast("binary")).alias("kept"),
    )
    return cut.select(*back, "n_removed", "n_spans", "kept").unionByName(again)

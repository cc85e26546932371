"""Exact removal of repeated byte strings through a run-length Burrows-Wheeler index.

Every string of ``LEAST`` bytes is known by its anchor, the least by hash of the
``GRAM``-byte strings in it; equal strings have equal anchors. Blocks of texts first ask
the shards of the hash space which of their anchors other blocks have too. Around the
anchors that recur they send the few dozen bytes that hold the strings in question
(snippets) to the same shards, which index them, and get back for every string the
least id of a document with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Block, checkpointed, mixed, packed_blocks, power_back, prefix_hash, shards, span_hash, tidy, total_bytes

#: Bytes of a string that counts as repeated, and of an anchor.
LEAST, GRAM = 50, 20

#: Places of a block that are hashed in step; bytes of snippets that are indexed in step.
STEP, PART = 1 << 19, 1 << 20

#: Stands for the id of a document without one: above all others.
NO_ID = np.iinfo(np.int64).max


def _press(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpress(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class Anchors:
    """The anchors of a block's strings, in the order of the strings they stand for.

    Strings that start at ``first[k]`` to ``last[k]`` have the anchor with hash ``hash[k]``,
    lie in document ``doc[k]``, and all their bytes together have the hash ``content[k]``.
    ``STEP`` places are looked at at a time, so memory follows them and not a text.
    """

    def __init__(self, block: Block, least: int):
        parts = [self._part(block, least, k) for k in range(0, max(1, len(block.data)), STEP)]
        self.first, self.last, self.hash, self.content = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.doc = np.searchsorted(block.ends, self.first, side="right")

    @staticmethod
    def _part(block: Block, least: int, at: int) -> tuple[np.ndarray, ...]:
        data = block.data[at : at + STEP + least - 1]
        whole = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        if len(data) < least:
            return whole
        # Strings that end before their document does.
        docs = slice(np.searchsorted(block.ends, at, side="right"), np.searchsorted(block.starts, at + STEP))
        low = np.maximum(block.starts[docs], at) - at
        high = np.minimum(block.ends[docs] - least + 1, at + STEP) - at
        room = np.maximum(high - low, 0)
        start = np.repeat(low, room) + _ranges(room)
        if not len(start):
            return whole
        prefix = prefix_hash(data)
        grams = mixed((prefix[GRAM:] - prefix[:-GRAM]) * power_back(len(prefix) - GRAM))
        place = np.arange(len(grams), dtype=np.uint64)
        order = (grams & np.uint64(0xFFFFFFFF00000000)) | place
        # Least of the grams in each string: minima over 1, 2, 4 ... of them, then two that overlap.
        width, span = least - GRAM + 1, 1
        while 2 * span <= width:
            order = np.minimum(order[:-span], order[span:])
            span *= 2
        if span < width:
            order = np.minimum(order[: len(order) - width + span], order[width - span :])
        anchor = (order[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = _cuts(anchor)
        first, last = start[new], start[_stops(new, len(start)) - 1]
        # Least hashes are small; hashed again they are spread over all shards.
        return first + at, last + at, mixed(~grams[anchor[new]]), span_hash(prefix, first, last + least)


def _shard(hashes: np.ndarray, n: int) -> np.ndarray:
    """Shards are ranges of the hash space."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _short(hashes: np.ndarray) -> np.ndarray:
    """48 bits do to ask whether an anchor recurs: more anchors recur then, none fewer."""
    return hashes >> np.uint64(16)


def _listed(values: np.ndarray) -> bytes:
    """Sorted 48-bit numbers as compressed differences, their bytes sorted by place."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return _press(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes())


def _unlisted(data: bytes, n: int) -> np.ndarray:
    steps = np.zeros((n, 8), dtype=np.uint8)
    steps[:, :6] = np.frombuffer(_unpress(data), dtype=np.uint8).reshape(6, n).T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _cuts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)


def _stops(starts: np.ndarray, n: int) -> np.ndarray:
    """Where each run ends, of runs that fill ``n`` places."""
    return np.append(starts, n)[1:] if len(starts) else starts


def _ranges(n: np.ndarray) -> np.ndarray:
    """0 to n[k] - 1 for each k, one after the other."""
    total = int(n.sum())
    return np.arange(total) - np.repeat(np.cumsum(n) - n, n)


# --- the index -------------------------------------------------------------------------------


class RunIndex:
    """A run-compressed Burrows-Wheeler transform of a collection of short strings.

    The transform of all strings, each closed by a symbol of its own, is kept as runs of
    equal symbols: where each run starts, and where its first symbol leads (LF); within
    a run LF goes up by one. Closing symbols, past which nothing is matched, make one run. Instead of a sample of the suffix array at
    run ends, which would give a text place, the ends of the runs of suffixes that
    share their first ``least`` bytes are sampled with the least document among them.
    """

    def __init__(self, data: np.ndarray, sizes: np.ndarray, docs: np.ndarray, least: int):
        self.least, self.sizes = least, sizes
        # Symbols: byte + 1; 0 stands for all closing symbols, the smallest, which differ by string.
        ends = np.cumsum(sizes + 1)
        symbol = np.zeros(int(ends[-1]), dtype=np.int64)
        inside = np.ones(len(symbol), dtype=bool)
        inside[ends - 1] = False
        symbol[inside] = data.astype(np.int64) + 1
        owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.close = ends - 1
        left = self.close[owner] - np.arange(len(symbol))
        # Ranks of suffixes by their first k, 2k, 4k ... symbols. One that closes within them is
        # cut off there and told from others by its string, so no order looks into the next string.
        bits = len(sizes).bit_length()
        depth, longest, same = max(1, (63 - bits) // 9), int(sizes.max()) + 1, None
        padded = np.concatenate([symbol, np.zeros(depth, dtype=np.int64)])
        key = np.zeros(len(symbol), dtype=np.int64)
        for k in range(depth):
            key = key << 9 | np.where(left > k, padded[k : k + len(symbol)], 0)
        key = key << bits | np.where(left < depth, owner + 1, 0)
        rank = np.unique(key, return_inverse=True)[1]
        while depth < longest:
            if same is None and 2 * depth >= least:  # ranks by exactly ``least`` symbols
                same = np.unique(self._pair(rank, least - depth), return_inverse=True)[1]
            rank = np.unique(self._pair(rank, depth), return_inverse=True)[1]
            depth *= 2
        if same is None:
            same = rank
        order = np.argsort(rank, kind="stable")
        before = symbol[order - 1]
        before[order == 0] = 0
        lead = np.empty(len(order), dtype=np.int64)
        lead[np.argsort(before, kind="stable")] = np.arange(len(order))
        self.run_start = _cuts(before)
        self.run_lead = lead[self.run_start]
        # Runs of suffixes with the same first bytes, and the least document in each.
        self.same_start = _cuts(same[order])
        self.same_doc = np.minimum.reduceat(docs[owner[order]], self.same_start)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.entry = place[self.close]

    @staticmethod
    def _pair(rank: np.ndarray, step: int) -> np.ndarray:
        later = np.zeros(len(rank), dtype=np.int64)
        if step < len(rank):
            later[: len(rank) - step] = rank[step:] + 1
        return rank.astype(np.int64) * (int(rank.max()) + 2) + later

    def stream(self) -> np.ndarray:
        """For each string and each start of ``least`` bytes in it, the least document with them.

        All strings are matched backwards in step, from their ends. A suffix matches
        itself, so no match breaks off; it is ``least`` long or more from there on.
        """
        room = self.sizes - self.least + 1
        out = np.empty(int(room.sum()), dtype=np.int64)
        base = np.cumsum(room) - room
        lane = np.argsort(-self.sizes, kind="stable")
        place, left = self.entry[lane], self.sizes[lane].copy()
        while len(lane):
            run = np.searchsorted(self.run_start, place, side="right") - 1
            place = self.run_lead[run] + place - self.run_start[run]
            left -= 1
            long = self.sizes[lane] - left >= self.least
            if long.any():
                got = self.same_doc[np.searchsorted(self.same_start, place[long], side="right") - 1]
                out[base[lane[long]] + left[long]] = got
            alive = left > 0
            if not alive.all():
                lane, place, left = lane[alive], place[alive], left[alive]
        return out


def least_documents(hashes: np.ndarray, sizes: np.ndarray, docs: np.ndarray, data: np.ndarray, least: int) -> np.ndarray:
    """For each snippet and each string in it, the least document that any equal string has.

    Equal snippets are indexed once. Snippets of an anchor that has just one need no
    index: all their strings have the same documents.
    """
    ends = np.cumsum(sizes)
    content = span_hash(prefix_hash(data), ends - sizes, ends) ^ mixed(sizes.astype(np.uint64))
    order = np.lexsort((docs, content, hashes))
    kind_start = _cuts(_pairs(hashes[order], content[order]))
    kind = np.empty(len(order), dtype=np.int64)
    kind[order] = np.repeat(np.arange(len(kind_start)), _stops(kind_start, len(order)) - kind_start)
    one = order[kind_start]  # the least document of each kind comes first
    room = sizes[one] - least + 1
    found = np.repeat(docs[one], room)
    base = np.cumsum(room) - room
    anchor_start = _cuts(hashes[one])
    kinds = _stops(anchor_start, len(one)) - anchor_start
    some = np.flatnonzero(np.repeat(kinds > 1, kinds))
    if len(some):
        rows = one[some]
        spots = np.repeat(ends[rows] - sizes[rows], sizes[rows]) + _ranges(sizes[rows])
        index = RunIndex(data[spots], sizes[rows], docs[rows], least)
        found[np.repeat(base[some], room[some]) + _ranges(room[some])] = index.stream()
    all_room = sizes - least + 1
    return found[np.repeat(base[kind], all_room) + _ranges(all_room)]


def least_runs(hashes: np.ndarray, sizes: np.ndarray, docs: np.ndarray, data: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """``least_documents`` as runs ``(snippet, length, document)``, in order of snippets.

    About ``PART`` bytes are looked at at a time; the snippets of an anchor, which alone
    can share strings, stay together.
    """
    order = np.argsort(hashes, kind="stable")
    cut = _cuts(hashes[order])
    upto = np.cumsum(sizes[order])[_stops(cut, len(order)) - 1] if len(cut) else cut
    lots = _cuts(upto // PART)
    starts = cut[lots]
    ends = np.cumsum(sizes)
    out = []
    for a, b in zip(starts, _stops(starts, len(order)), strict=True):
        rows = order[a:b]
        spots = np.repeat(ends[rows] - sizes[rows], sizes[rows]) + _ranges(sizes[rows])
        got = least_documents(hashes[rows], sizes[rows], docs[rows], data[spots], least)
        owner = np.repeat(rows, sizes[rows] - least + 1)
        runs = _cuts(_pairs(owner, got))
        out.append((owner[runs], _stops(runs, len(got)) - runs, got[runs]))
    owner, length, value = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (ends,) * 3
    by = np.argsort(owner, kind="stable")
    return owner[by], length[by], value[by]


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.rec.fromarrays([a, b])


# --- the steps -------------------------------------------------------------------------------


def _asked(n: int, least: int):
    """Blocks to lists of their anchors, one list per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                short = np.unique(_short(Anchors(block, least).hash))
                where = _shard(short << np.uint64(16), n)
                start = _cuts(where)
                lists = np.split(short, start[1:]) if len(start) else []
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(where[start], pa.int32()),
                        pa.array([block.block_id] * len(lists), pa.int64()),
                        pa.array([len(x) for x in lists], pa.int32()),
                        pa.array([_listed(x) for x in lists], pa.binary()),
                    ],
                    names=["shard", "block_id", "n", "list"],
                )

    return run


def _answered(table: pa.Table) -> pa.Table:
    """The lists of a shard to bits: does another block have the anchor?"""
    rows = table.to_pylist()
    lists = [_unlisted(r["list"], r["n"]) for r in rows]
    both = np.sort(np.concatenate(lists))
    again = np.unique(both[1:][both[1:] == both[:-1]])
    bits = []
    for x in lists:
        at = np.searchsorted(again, x)
        at[at == len(again)] = 0
        bits.append(np.packbits(again[at] == x if len(again) else np.zeros(len(x), dtype=bool)).tobytes())
    return pa.table({"block_id": pa.array([r["block_id"] for r in rows], pa.int64()), "shard": pa.array([r["shard"] for r in rows], pa.int32()), "bits": pa.array(bits, pa.binary())})


class Snippets:
    """The recurring anchors of a block and their different snippets, in an order that
    the same block and the same answers always give."""

    def __init__(self, block: Block, answers: pa.Table, n: int, least: int):
        self.anchors = anchors = Anchors(block, least)
        short = _short(anchors.hash)
        known = np.unique(short)
        where = _shard(known << np.uint64(16), n)
        start = _cuts(where)
        stop = _stops(start, len(known))
        again = np.zeros(len(known), dtype=bool)
        bits = dict(zip(answers.column("shard").to_pylist(), answers.column("bits").to_pylist(), strict=True))
        for a, b in zip(start, stop, strict=True):
            again[a:b] = np.unpackbits(np.frombuffer(bits[int(where[a])], dtype=np.uint8), count=b - a)
        # Or two documents of this block have it.
        order = np.lexsort((anchors.doc, short))
        s, d = short[order], anchors.doc[order]
        again |= np.isin(known, s[1:][(s[1:] == s[:-1]) & (d[1:] != d[:-1])])
        self.uses = np.flatnonzero(again[np.searchsorted(known, short)]) if len(known) else np.zeros(0, dtype=np.int64)
        first, stop = anchors.first[self.uses], anchors.last[self.uses] + least
        self.size = stop - first
        self.hash = anchors.hash[self.uses]
        ids = np.where(block.known, block.ids, NO_ID)
        self.doc = ids[anchors.doc[self.uses]] if len(self.uses) else np.zeros(0, dtype=np.int64)
        content = anchors.content[self.uses]
        order = np.lexsort((self.doc, self.size, content, self.hash))
        start = _cuts(np.rec.fromarrays([self.hash[order], content[order], self.size[order]]))
        self.kind = np.empty(len(order), dtype=np.int64)
        self.kind[order] = np.repeat(np.arange(len(start)), _stops(start, len(order)) - start)
        self.one = order[start]
        self.shard = _shard(_short(self.hash[self.one]) << np.uint64(16), n)
        self.first = first


def _sent(n: int, least: int):
    """Blocks and their answers to snippets, one row per shard."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("shard", "block_id", "hashes", "docs", "sizes", "data")}
        for row in left.to_pylist():
            block = Block(row)
            sn = Snippets(block, right, n, least)
            start = _cuts(sn.shard)
            for a, b in zip(start, _stops(start, len(sn.shard)), strict=True):
                rows = sn.one[a:b]
                spots = np.repeat(sn.first[rows], sn.size[rows]) + _ranges(sn.size[rows])
                out["shard"].append(int(sn.shard[a]))
                out["block_id"].append(block.block_id)
                out["hashes"].append(sn.hash[rows].tobytes())
                out["docs"].append(sn.doc[rows].tobytes())
                out["sizes"].append(sn.size[rows].astype(np.uint8).tobytes())
                out["data"].append(_press(block.data[spots].tobytes()))
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})

    return run


def _found(least: int):
    """The snippets of a shard to runs of least documents, one row per block."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        hashes = np.concatenate([np.frombuffer(r["hashes"], dtype=np.uint64) for r in rows])
        docs = np.concatenate([np.frombuffer(r["docs"], dtype=np.int64) for r in rows])
        sizes = np.concatenate([np.frombuffer(r["sizes"], dtype=np.uint8) for r in rows]).astype(np.int64)
        data = np.frombuffer(b"".join(_unpress(r["data"]) for r in rows), dtype=np.uint8)
        owner, runs, values = least_runs(hashes, sizes, docs, data, least)
        tidy()
        runs = runs.astype(np.uint8)
        of = np.searchsorted(np.cumsum([len(r["hashes"]) // 8 for r in rows]), owner, side="right")
        stop = np.searchsorted(of, np.arange(len(rows)), side="right")
        start = np.concatenate([[0], stop[:-1]])
        return pa.table({
            "block_id": pa.array([r["block_id"] for r in rows], pa.int64()),
            "shard": pa.array([r["shard"] for r in rows], pa.int32()),
            "runs": pa.array([runs[a:b].tobytes() for a, b in zip(start, stop, strict=True)], pa.binary()),
            "values": pa.array([_press(values[a:b].tobytes()) for a, b in zip(start, stop, strict=True)], pa.binary()),
        })

    return run


def repeated_bytes(block: Block, answers: pa.Table, found: pa.Table, n: int, least: int) -> np.ndarray:
    """Which bytes of the block lie in a string that a smaller document has too."""
    sn = Snippets(block, answers, n, least)
    by_shard = {r["shard"]: r for r in found.to_pylist()}
    marks = np.zeros(len(block.data) + 1, dtype=np.int32)
    if len(sn.uses):
        rows = [by_shard[int(k)] for k in sn.shard[_cuts(sn.shard)]]
        runs = np.concatenate([np.frombuffer(r["runs"], dtype=np.uint8) for r in rows])
        values = np.concatenate([np.frombuffer(_unpress(r["values"]), dtype=np.int64) for r in rows])
        # The runs of each kind, and then of each use of it.
        length = runs.astype(np.int64)
        upto = np.cumsum(length)
        kind_end = np.cumsum(sn.size[sn.one] - least + 1)
        run_end = np.searchsorted(upto, kind_end) + 1
        run_start = np.concatenate([[0], run_end[:-1]])
        n_runs = (run_end - run_start)[sn.kind]
        use = np.repeat(np.arange(len(sn.uses)), n_runs)
        run = run_start[sn.kind][use] + _ranges(n_runs)
        gone = values[run] < sn.doc[use]
        use, run = use[gone], run[gone]
        kind_start = kind_end - (sn.size[sn.one] - least + 1)
        start = sn.first[use] + upto[run] - length[run] - kind_start[sn.kind[use]]
        np.add.at(marks, start, 1)
        np.subtract.at(marks, start + length[run] - 1 + least, 1)
    return np.cumsum(marks[:-1]) > 0


def _marked(n: int, least: int, whole_characters: bool, schema: pa.Schema):
    """Blocks and all answers to one row per document."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = right.filter(pa.compute.is_valid(right.column("bits")))
        found = right.filter(pa.compute.is_valid(right.column("runs")))
        tables = []
        for row in left.to_pylist():
            block = Block(row)
            gone = repeated_bytes(block, answers, found, n, least)
            if whole_characters and len(gone):
                # A character goes only if all of its bytes do.
                lead = np.flatnonzero((block.data & 0xC0) != 0x80)
                size = np.diff(np.append(lead, len(gone)))
                gone = np.repeat(np.add.reduceat(gone, lead, dtype=np.int64) == size, size)
            step = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            opened = np.zeros(len(gone), dtype=bool)
            opened[:] = step[:-1] == 1
            # A run does not go on from one document to the next.
            inner = block.starts[(block.starts < len(gone)) & (block.ends > block.starts)]
            opened[inner] = gone[inner]
            kept, spans = [], []
            starts = np.flatnonzero(opened)
            stops = np.flatnonzero(gone & np.append(opened[1:] | ~gone[1:], True)) + 1 if len(gone) else starts
            a = np.searchsorted(starts, block.starts)
            b = np.searchsorted(starts, block.ends)
            for k, (s, e) in enumerate(zip(block.starts, block.ends, strict=True)):
                kept.append(block.data[s:e][~gone[s:e]].tobytes())
                spans.append([{"start": int(x - s), "stop": int(y - s)} for x, y in zip(starts[a[k] : b[k]], stops[a[k] : b[k]], strict=True)])
            columns = [
                pa.array([int(i) if ok else None for i, ok in zip(block.ids, block.known, strict=True)], pa.int64()),
                pa.array(block.ends - block.starts, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                pa.array(kept, pa.binary()),
            ]
            if block.rest:
                columns += [c.combine_chunks() for c in pa.ipc.open_stream(block.rest).read_all().columns]
            tables.append(pa.table(columns, schema=schema))
        return pa.concat_tables(tables) if tables else schema.empty_table()

    return run


def deduplicate(
    documents: DataFrame, *rest: str, least: int = LEAST, whole_characters: bool = False, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, spans, kept`` and the columns ``rest``.

    Every byte of the UTF-8 text goes that is covered by a string of ``least`` bytes (32
    to 128) which also starts in a document with a smaller id; strings are judged on the
    input and never cross documents. ``spans`` are the maximal removed runs ``(start,
    stop)`` in bytes; ``kept`` is what is left, joined. ``whole_characters`` keeps a
    character of which some byte stays, so that ``kept`` is UTF-8.

    A null text is empty; a null id is above all others, and texts of equal ids remove
    nothing from one another; an empty table gives no rows. A result's name that ``rest``
    has too gets a leading underscore. A string in very many
    documents is one snippet per block, and each shard holds a range of the hash space
    whose size follows from the table's, so neither tasks nor the driver grow with it.
    Blocks are made afresh for the first question, so the table must read alike twice.
    """
    if not 32 <= least <= 128:
        raise ValueError("least must be from 32 to 128")
    spark = documents.sparkSession
    n = shards(spark, total_bytes(documents, text))
    parts = packed_blocks(documents, doc_id, text, *rest)
    by_block = parts.groupBy("block_id")
    asked = packed_blocks(documents, doc_id, text, then=_asked(n, least), schema="shard int, block_id long, n int, list binary")
    answers = checkpointed(asked.groupBy("shard").applyInArrow(_answered, "block_id long, shard int, bits binary"))
    sent = by_block.cogroup(answers.groupBy("block_id")).applyInArrow(
        _sent(n, least), "shard int, block_id long, hashes binary, docs binary, sizes binary, data binary"
    )
    found = sent.groupBy("shard").applyInArrow(_found(least), "block_id long, shard int, runs binary, values binary")
    both = answers.unionByName(found, allowMissingColumns=True)
    names = []
    for name in ("doc_id", "n_bytes", "spans", "kept"):
        while name.lower() in {c.lower() for c in rest}:
            name = f"_{name}"
        names.append(name)
    kinds = ("long", "long", "array<struct<start: long, stop: long>>", "binary")
    struct = T.StructType.fromDDL(", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    for name in rest:
        struct.add(documents.schema[name])
    return by_block.cogroup(both.groupBy("block_id")).applyInArrow(_marked(n, least, whole_characters, to_arrow_schema(struct)), struct)


def deduplicated_documents(documents: DataFrame, *, least: int = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with the kept text of each; ``n_chars``, where there is one, follows it."""
    rest = [c for c in documents.columns if c not in (doc_id, text)]
    made = deduplicate(documents, *rest, least=least, whole_characters=True, doc_id=doc_id, text=text)
    own, _, _, kept = made.columns[:4]
    columns = {doc_id: F.col(own), text: F.when(F.col(kept).isNotNull(), F.decode(F.col(kept), "UTF-8"))}
    if "n_chars" in rest:
        columns["n_chars"] = F.char_length(columns[text]).cast(documents.schema["n_chars"].dataType)
    return made.select(*[columns.get(c, F.col(f"`{c}`")).alias(c) for c in documents.columns])

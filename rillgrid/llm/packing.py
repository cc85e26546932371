"""Packing documents into token windows by minimum bin slack."""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

#: Remainders are held until there are so many, and packed until so few are left.
HOLD, LEAVE = 2048, 512

#: Entries of a worker's table from words to their ids.
CACHE = 800_000

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

#: Lower case of Latin-1, and a full stop or comma that closes a word.
_LOWER = bytes(ord(chr(i).lower()) if len(chr(i).lower()) == 1 and ord(chr(i).lower()) < 256 else i for i in range(256))
_CLOSING = re.compile(rb"(?<=[a-z\xdf-\xf6\xf8-\xff])([.,])(?= |$)")

_tokenizers: dict = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        closes = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
        closes[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        _tokenizers[path] = (tokenizer, closes, {})
    return _tokenizers[path]


def _learn(tokenizer, closes: np.ndarray, parts: list) -> dict:
    """The ids of each part. Plain words are encoded many in one text; a word's last id closes it."""
    out, odd, plain = {}, [], []
    for x in parts:
        text = x.decode("latin-1") if isinstance(x, bytes) else x
        (plain if text.isalpha() else odd).append((x, text))
    lots = [plain[k : k + 256] for k in range(0, len(plain), 256)]
    for lot, e in zip(lots, tokenizer.encode_batch_fast([" ".join(t for _, t in lot) for lot in lots], add_special_tokens=False), strict=True):
        ids = np.array(e.ids, dtype="<u4")
        ends = (np.flatnonzero(closes[ids]) + 1).tolist()
        if len(ends) != len(lot):
            odd += lot
            continue
        raw, start = ids.tobytes(), 0
        for (x, _), end in zip(lot, ends, strict=True):
            out[x] = raw[4 * start : 4 * end]
            start = end
    for (x, _), e in zip(odd, tokenizer.encode_batch_fast([t for _, t in odd], add_special_tokens=False), strict=True):
        out[x] = array("I", e.ids).tobytes()
    return out


def encode(path: str, text: str) -> bytes:
    """The ids of ``text`` as little-endian 32-bit numbers.

    The tokenizer lowers case, drops white space and encodes each word by itself, so a
    text's ids are those of the strings between its spaces and line ends, which recur
    and are kept. Latin-1 texts are lowered first and a comma or full stop after a
    letter is taken off, which the tokenizer would do, so that fewer strings differ.
    """
    tokenizer, closes, known = _tokenizer(path)
    try:
        if "<|" in text:  # may be a special token, in the case it has
            raise UnicodeError
        raw = text.encode("latin-1")
        parts = _CLOSING.sub(rb" \1", raw.translate(_LOWER).replace(b"\n", b" ")).split(b" ")
    except UnicodeError:
        parts = text.replace("\n", " ").split(" ")
    if new := [x for x in set(parts) if x not in known]:
        made = _learn(tokenizer, closes, new)
        if len(known) + len(new) <= CACHE:
            known.update(made)
        else:  # the words that come first come most; the others are encoded each time
            return b"".join([known[x] if x in known else made[x] for x in parts])
    return b"".join(map(known.__getitem__, parts))


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take so that their sum is nearest below ``capacity``.

    Bit ``s`` of ``reach`` says that some choice among the lengths so far sums to
    ``s``; what was reachable before each length lets the counts be read back.
    """
    reach, stages, mask = 1, [], (1 << (capacity + 1)) - 1
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        stages.append((length, reach))
        step = reach
        for _ in range(min(counts[length], capacity // length)):
            step = (step << length) & mask
            if not step:
                break
            reach |= step
        if reach >> capacity & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, before in reversed(stages):
        while not before >> total & 1:
            total -= length
            taken[length] = taken.get(length, 0) + 1
    return taken


class Packer:
    """Deals the pieces of one input partition to sequences of at most ``window`` ids."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.waiting: dict[int, list] = defaultdict(list)
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        full = n - n % self.window
        for start in range(0, full, self.window):
            self._write([(doc_id, start, ids[4 * start : 4 * (start + self.window)], n)])
        if full < n:
            self._hold((doc_id, full, ids[4 * full :], n))
        if self.held >= HOLD:
            self.pack(LEAVE)

    def _hold(self, piece: tuple) -> None:
        self.waiting[len(piece[2]) // 4].append(piece)
        self.held += 1

    def _take(self, length: int) -> tuple:
        pieces = self.waiting[length]
        piece = pieces.pop()
        if not pieces:
            del self.waiting[length]
        self.held -= 1
        return piece

    def _write(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, ids, n, self.sequence, offset))
            offset += len(ids) // 4
        self.sequence += 1

    def pack(self, leave: int) -> None:
        """Fill windows until at most ``leave`` remainders wait, or too little for a window."""
        waiting_ids = sum(k * len(v) for k, v in self.waiting.items())
        while self.held > leave and waiting_ids >= self.window:
            pieces = [self._take(max(self.waiting))]
            room = self.window - len(pieces[0][2]) // 4
            if room:
                counts = {k: len(v) for k, v in self.waiting.items()}
                for length, times in best_fill(counts, room).items():
                    pieces += [self._take(length) for _ in range(times)]
                    room -= length * times
            if room:  # no choice fills the window: the longest remainder is cut
                doc_id, start, ids, n = self._take(max(self.waiting))
                pieces.append((doc_id, start, ids[: 4 * room], n))
                self._hold((doc_id, start + room, ids[4 * room :], n))
            self._write(pieces)
            waiting_ids -= self.window

    def finish(self) -> None:
        """Pack all; what does not fill a window goes to sequences of powers of two."""
        self.pack(0)
        rest = [self._take(k) for k in sorted(self.waiting, reverse=True) for _ in range(len(self.waiting[k]))]
        while rest:
            size = 1 << (sum(len(p[2]) for p in rest) // 4).bit_length() - 1
            pieces = []
            while size:
                doc_id, start, ids, n = rest.pop(0)
                cut = min(size, len(ids) // 4)
                pieces.append((doc_id, start, ids[: 4 * cut], n))
                if 4 * cut < len(ids):
                    rest.insert(0, (doc_id, start + cut, ids[4 * cut :], n))
                size -= cut
            self._write(pieces)

    def flush(self) -> pa.RecordBatch:
        names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
        kinds = (pa.int64(),) * 3 + (pa.binary(),) + (pa.int64(),) * 3
        columns = list(zip(*self.rows, strict=True))
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def pack(
    documents: DataFrame, tokenizer_path: str, *, window: int = 4096, end_id: int = 2, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece of a document: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    A document's ids, with ``end_id`` after them, are cut into whole windows and one
    remainder. Remainders wait, 2,048 at most, and windows are filled one after the
    other: the longest remainder, then the multiset of waiting lengths that a bitset
    subset-sum finds nearest to the room left. If none fills a window, one more
    remainder is cut to do so. At the end of an input partition what is left becomes
    sequences whose lengths are powers of two, so no sequence needs padding. Every
    input partition is packed by itself in one pass: no shuffle, memory bounded by
    the waiting remainders and the longest text, and a task that runs again gives the
    same rows. Sequences are numbered from the partition's number times 2**33.

    A null text is an empty one and gives one piece, ``end_id`` alone. A null or
    repeated id is carried as it is. An empty table gives no rows; further columns of
    ``documents`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(window, TaskContext.get().partitionId() << 33)
        end, held = np.array([end_id], dtype="<u4").tobytes(), 0
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(tokenizer_path, t.as_py() or "") + end
                packer.add(i.as_py(), ids)
                held += len(ids)
                if held >= 16 << 20 and packer.rows:
                    yield packer.flush()
                    held = 0
        packer.finish()
        if packer.rows:
            yield packer.flush()

    return documents.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(tidied(run), PIECES)

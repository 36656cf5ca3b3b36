"""Suffix-array dedup: bytes of a document that an earlier document already has in a run of ``MIN_BYTES``.

A global suffix array does not fit a cluster, but every 50-byte string has one
minimizer: the least (by hash, leftmost among equals) of the 16-byte grams it
holds. Equal strings have equal minimizers, so suffixes only meet in the bucket
of their minimizer, and each bucket gets a suffix order of its own:

1. Documents are packed, compressed, into rows of a few MB (``packs``).
2. A 50-byte string reaches at least 17 bytes past its minimizer on one side. So
   a pack sends for each minimizer the hash of the gram with its 17 bytes to the
   left, and that with those to the right; a bucket returns the hashes that
   several documents hold. Only minimizers with such a hash are looked at
   further. (The hash only filters; its width grows with the input.)
3. For these, a pack sends each distinct context (the union of the 50-byte
   strings of one minimizer) once, with its smallest document id. Contexts grow
   faster than the input while more of it repeats; beyond one repeated hash for
   ``SHARE_BYTES`` bytes of text this and the next step take one share of the
   buckets after the other, each as large as that. Every bucket has its turn.
4. A bucket sorts the strings of its contexts in suffix order and forms their
   longest-previous-factor array, truncated to 50: the nearest string before and
   after in suffix order that is in a smaller document gives the longest factor
   that an earlier document has too. A string goes if its factor reaches 50. A
   bucket returns one bit a string.
5. Packs delete what is covered.

A group of copies costs one context for each pack, never a pair. A passage that
very many packs hold would gather the differing texts around it in the bucket of
its minimizer; strings with such a hash (``HOT_PACKS``) go one by one to buckets
by their own 50 bytes instead. Equal strings have equal hashes, so both ways
agree. Steps 3 and 5 derive the same contexts again instead of storing them.

Defined cases: a null text counts as an empty one; texts under 50 bytes lose
nothing; rows that share an id never shorten each other, nor do parts of one
document; rows with a null id lose nothing and shorten no other; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.llm.arrow import frugal, slices
from spandrel.session import materialize, sweep

MIN_BYTES, GRAM, SIDE = 50, 16, 17
SPARE_BITS, HOT_PACKS, SHARE_BYTES = 14, 192, 28
PACK_BYTES, BUCKET_BYTES = 2 << 20, 6 << 20
SLICE = 1 << 22
POSITION_BITS = 23
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _words(data: np.ndarray, order: str = "<u8") -> np.ndarray:
    """The 8-byte word at every offset."""
    return np.ndarray((len(data) - 7,), dtype=order, buffer=data, strides=(1,)).astype(np.uint64)


def minimizer_runs(data: np.ndarray, valid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, place, first, last) of each run of 50-byte strings, by start, that share a minimizer.

    ``valid`` tells which starts count, such as those of strings inside one document.
    """
    empty = np.empty(0, dtype=np.int64)
    if len(data) < MIN_BYTES:
        return empty.astype(np.uint64), empty, empty, empty
    parts = []
    for at in range(0, len(data) - MIN_BYTES + 1, SLICE):
        piece = np.ascontiguousarray(data[at : at + SLICE + MIN_BYTES - 1])
        words = _words(piece)
        mixed = words[:-8] * np.uint64(0x9E3779B97F4A7C15) + words[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        ranked = (mixed >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS)) | np.arange(len(mixed), dtype=np.uint64)
        low = ranked
        for shift in (1, 2, 4, 8, 16):
            low = np.minimum(low[:-shift], low[shift:])
        rest = MIN_BYTES - GRAM + 1 - 32
        low = np.minimum(low[:-rest], low[rest:])
        place = (low & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
        new = place[1:] != place[:-1]
        counts = None if valid is None else valid[at : at + len(place)]
        first = np.flatnonzero(np.r_[True, new if counts is None else new | (counts[1:] != counts[:-1])])
        last = np.r_[first[1:], len(place)] - 1
        if counts is not None:
            first, last = first[counts[first]], last[counts[first]]
        parts.append((mixed[place[first]], place[first] + at, first + at, last + at))
    return tuple(np.concatenate(x) for x in zip(*parts))


def side_keys(data: np.ndarray, gram: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``bits`` bits of each gram with its ``SIDE`` bytes to the left and to the right.

    0 where those are missing in the gram's document, which goes from ``low`` to ``high``.
    """
    padded = np.concatenate([np.zeros(24, dtype=np.uint8), data, np.zeros(24 + GRAM, dtype=np.uint8)])
    view = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    sides = []
    for salt, offsets in ((0x8CB92BA72F3D8DD7, (-8, -16, -SIDE)), (0xA24BAED4963EE407, (GRAM, GRAM + 8, GRAM + SIDE - 8))):
        key = gram + np.uint64(salt)
        for offset in offsets:
            key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25) + view[place + 24 + offset]
        key = (key ^ (key >> np.uint64(28))) * np.uint64(0xD6E8FEB86659FD93)
        sides.append(np.maximum((key ^ (key >> np.uint64(32))) >> np.uint64(64 - bits), np.uint64(1)))
    return np.where(place - SIDE >= low, sides[0], np.uint64(0)), np.where(place + GRAM + SIDE <= high, sides[1], np.uint64(0))


class _Pack:
    """A pack's text and the minimizers of its documents with ids; ``owner`` is the document's number."""

    def __init__(self, row: dict):
        self.ids, self.sizes = row["ids"], np.array(row["sizes"], dtype=np.int64)
        self.text = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"]), dtype=np.uint8)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.known = np.array([-1 if i is None else i for i in self.ids], dtype=np.int64)
        used = np.flatnonzero((self.sizes >= MIN_BYTES) & np.array([i is not None for i in self.ids], dtype=bool))
        size = max(1, len(self.text) - MIN_BYTES + 2)
        edges = np.bincount(self.at[used], minlength=size) - np.bincount(self.at[used] + self.sizes[used] - MIN_BYTES + 1, minlength=size)
        valid = np.cumsum(edges)[: size - 1] > 0
        self.gram, self.place, self.first, self.last = minimizer_runs(self.text, valid)
        self.owner = np.searchsorted(self.at, self.first, side="right") - 1 if len(self.at) else self.first

    def sides(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        low = self.at[self.owner]
        return side_keys(self.text, self.gram, self.place, low, low + self.sizes[self.owner], bits)


def _squeeze(values: np.ndarray) -> bytes:
    """Sorted whole numbers as compressed byte planes of their differences."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    planes = gaps.view(np.uint8).reshape(-1, 8).T
    kept = max(1, int(np.flatnonzero(planes.any(axis=1))[-1]) + 1) if planes.any() else 1
    return bytes([kept]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:kept]).tobytes())


def _unsqueeze(blob: bytes) -> np.ndarray:
    kept, raw = blob[0], np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), dtype=np.uint8)
    planes = np.zeros((len(raw) // kept, 8), dtype=np.uint8)
    planes[:, :kept] = raw.reshape(kept, -1).T
    return np.cumsum(planes.view("<u8").ravel(), dtype=np.uint64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["batch", "ids", "sizes", "data", "n"]
    press, seen = zstandard.ZstdCompressor(level=6), 0
    task = TaskContext.get().partitionId()

    def row(held):
        held.sort(key=lambda x: (x[0] is None, x[0] or 0))
        raw = b"".join(x[1] for x in held)
        columns = [[(task << 28) | seen], [[x[0] for x in held]], [[len(x[1]) for x in held]], [press.compress(raw)], [len(raw)]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    held, size = [], 0
    for batch in slices(batches):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = (text or "").encode("utf-8", "surrogatepass")
            held.append((doc, raw))
            size += len(raw) + 16
            if size >= PACK_BYTES:
                yield row(held)
                held, size, seen = [], 0, seen + 1
    if held:
        yield row(held)


def _key_rows(buckets: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                pack = _Pack(row)
                key, owner = np.concatenate(pack.sides(bits)), np.tile(pack.known[pack.owner], 2)
                real = key > 0
                key, owner = key[real], owner[real]
                order = np.argsort(key)
                key, owner = key[order], owner[order]
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, dtype=np.int64)
                if not len(first):
                    continue
                many = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
                key = key[first]
                # The lowest bit of what is sent says whether several documents of the pack hold the key.
                cut = np.searchsorted(key, _starts(buckets, bits))
                sent = key << np.uint64(1) | many.astype(np.uint64)
                some = np.flatnonzero(np.diff(np.r_[cut, len(key)]))
                ends = np.r_[cut[1:], len(key)]
                low = _starts(buckets, bits) << np.uint64(1)
                blobs = [_squeeze(sent[cut[k] : ends[k]] - low[k]) for k in some]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array([row["batch"]] * len(some), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "batch", "blob"])

    return run


def _starts(buckets: int, bits: int) -> np.ndarray:
    """Smallest key of each bucket; buckets are ranges of keys, so that sorted keys lie close."""
    return np.array([(k << bits) // buckets for k in range(buckets)], dtype=np.uint64)


def _repeated(table: pa.Table) -> pa.Table:
    """For each pack of a bucket, its keys that several documents hold, relative to the bucket's smallest."""
    blobs = [_unsqueeze(b) for b in table["blob"].to_pylist()]
    key = np.concatenate(blobs)
    who = np.repeat(np.arange(len(blobs)), [len(b) for b in blobs])
    bare = key >> np.uint64(1)
    order = np.argsort(bare)
    bare, who, many = bare[order], who[order], (key[order] & np.uint64(1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bare[1:] != bare[:-1]])
    sizes = np.diff(np.r_[first, len(bare)])
    keep = np.repeat((sizes > 1) | (np.add.reduceat(many, first) > 0), sizes)
    hot = np.repeat(sizes >= HOT_PACKS, sizes)[keep]
    bare, who = bare[keep], who[keep]
    order = np.argsort(who, kind="stable")
    bare, who, hot = bare[order], who[order], hot[order]
    cut = np.searchsorted(who, np.arange(len(blobs) + 1))
    some = np.flatnonzero(np.diff(cut))
    spans = [slice(cut[i], cut[i + 1]) for i in some]
    hottest = [_squeeze(bare[s][hot[s]]) if hot[s].any() else b"" for s in spans]
    return pa.table({"batch": pa.array(table["batch"].to_numpy()[some]), "bucket": pa.array(table["bucket"].to_numpy()[some]), "blob": pa.array([_squeeze(bare[s]) for s in spans], pa.binary()), "hot": pa.array(hottest, pa.binary()), "n": pa.array(np.diff(cut)[some])})


class _Pieces:
    """The runs of a pack whose minimizers are repeated, as arrays, and the distinct contexts among them.

    A piece covers the 50-byte strings that start from ``start`` to ``last`` in
    the pack's text. ``rep`` is the piece of equal bytes with the smallest id. ``order`` lists
    those pieces by bucket, which is the order they are sent and judged in.
    """

    def __init__(self, row: dict, buckets: int, bits: int):
        low = _starts(buckets, bits)
        held = sorted(row["blobs"] or [], key=lambda x: x["bucket"])
        none = np.empty(0, dtype=np.uint64)
        wanted = np.concatenate([none, *[_unsqueeze(x["blob"]) + low[x["bucket"]] for x in held]])
        hottest = np.concatenate([none, *[_unsqueeze(x["hot"]) + low[x["bucket"]] for x in held if x["hot"]]])
        pack = _Pack(row)
        self.ids, self.sizes, self.text, self.at = pack.ids, pack.sizes, pack.text, pack.at
        left, right = pack.sides(bits)
        hit = np.flatnonzero(_among(left, wanted) | _among(right, wanted))
        gram, place, first, last, doc = pack.gram[hit], pack.place[hit], pack.first[hit], pack.last[hit], pack.known[pack.owner[hit]]
        x, y = _among(left[hit], hottest), _among(right[hit], hottest)
        cool = ~(x | y)
        found = [(first[cool], last[cool], gram[cool] % np.uint64(buckets), doc[cool])]
        if not cool.all():
            # Strings that reach SIDE bytes to the right belong to that side's hash, the others to the left one's.
            gram, place, first, last, doc, x, y = (v[~cool] for v in (gram, place, first, last, doc, x, y))
            for hot, start, end in ((x, first, np.minimum(last, place - SIDE - 1)), (y, np.maximum(first, place - SIDE), last)):
                some = start <= end
                calm = some & ~hot
                found.append((start[calm], end[calm], gram[calm] % np.uint64(buckets), doc[calm]))
                warm = some & hot
                each = _spread(start[warm], end[warm] - start[warm] + 1)
                found.append((each, each, self.digest(each, each) % np.uint64(buckets), np.repeat(doc[warm], end[warm] - start[warm] + 1)))
        self.start, self.last, bucket, self.doc = (np.concatenate(p) for p in zip(*found))
        self.bucket = bucket.astype(np.int64)
        self.rep = self.equal()
        self.order = np.flatnonzero(self.rep == np.arange(len(self.rep)))
        self.order = self.order[np.argsort(self.bucket[self.order], kind="stable")]

    def digest(self, start: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of each piece's bytes: of its first 50 and its last 50, which cover it."""
        view = np.ndarray((max(0, len(self.text) - 7),), dtype="<u8", buffer=self.text, strides=(1,))
        out = (last - start).astype(np.uint64)
        for base in (start, last):
            for offset in (0, 8, 16, 24, 32, 40, MIN_BYTES - 8):
                out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25) + view[base + offset]
        return (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(1)

    def equal(self) -> np.ndarray:
        """Piece of the smallest document with the same bytes, the first of several; the hash only says where to compare them."""
        rep = np.arange(len(self.start))
        if not len(rep):
            return rep
        key = self.digest(self.start, self.last)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        raw = self.text.tobytes()
        seen: dict[bytes, int] = {}
        some = np.sort(order[np.r_[same, False] | np.r_[False, same]])
        for i in some[np.argsort(self.doc[some], kind="stable")].tolist():
            rep[i] = seen.setdefault(raw[self.start[i] : self.last[i] + MIN_BYTES], i)
        return rep

    def rows(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """(bucket, ids, sizes, bytes) of the distinct contexts of each bucket."""
        start, size = self.start[self.order], self.last[self.order] - self.start[self.order] + MIN_BYTES
        bucket, doc = self.bucket[self.order], self.doc[self.order]
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, dtype=np.int64)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(bucket)]):
            yield int(bucket[a]), doc[a:b].astype("<i8").tobytes(), size[a:b].astype(np.uint8).tobytes(), self.text[_spread(start[a:b], size[a:b])].tobytes()

    def gone(self, words: np.ndarray) -> np.ndarray:
        """Which bytes of the pack's text go; ``words`` has a bit a string for each distinct context in order."""
        mask = np.zeros(len(self.rep), dtype=np.uint64)
        mask[self.order] = words
        count = self.last - self.start + 1
        whole = (np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)
        mask = np.where(self.doc > self.doc[self.rep], whole, mask[self.rep])
        full, part = mask == whole, (mask != whole) & (mask > 0)
        one = _spread(self.start[part], count[part])
        bit = one - np.repeat(self.start[part], count[part])
        one = one[(np.repeat(mask[part], count[part]) >> bit.astype(np.uint64) & np.uint64(1)) > 0]
        size = len(self.text) + 1
        up = np.bincount(np.concatenate([self.start[full], one]), minlength=size)
        down = np.bincount(np.concatenate([self.last[full], one]) + MIN_BYTES, minlength=size)
        return np.cumsum(up - down)[:-1] > 0


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, … for each start, ``count`` of them."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted ``known``; a table of their lowest bits rules most others out first."""
    out = np.zeros(len(keys), dtype=bool)
    if len(known):
        low = np.uint64((1 << 21) - 1)
        table = np.zeros(1 << 21, dtype=bool)
        table[known & low] = True
        some = np.flatnonzero(table[keys & low])
        out[some] = known[np.minimum(np.searchsorted(known, keys[some]), len(known) - 1)] == keys[some]
    return out


def _context_rows(buckets: int, bits: int, turn: int, turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                if not row["blobs"]:
                    continue
                made = [(k, row["batch"], press.compress(ids), sizes, press.compress(texts)) for k, ids, sizes, texts in _Pieces(row, buckets, bits).rows() if k % turns == turn]
                if made:
                    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=["bucket", "batch", "ids", "sizes", "texts"])

    return run


def suffix_order(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``starts`` in the order of their first ``MIN_BYTES`` bytes, and the rank of each; equal prefixes
    share a rank.

    Sorted by 8 bytes first. Of the runs that share these, those whose neighbours are not all equal are sorted by the
    next bytes, run number before them in one word, until all runs are of equal prefixes.
    """
    view = _words(np.r_[text, np.zeros(MIN_BYTES + 8, dtype=np.uint8)], ">u8")
    order = np.argsort(view[starts])
    head = view[starts[order]]
    new = np.r_[True, head[1:] != head[:-1]][: len(head)]
    rows, offset = np.arange(len(order)), 8
    while len(rows):
        # Runs of the rows still open, and which of them have a row that differs from the one before.
        run = np.cumsum(new[rows]) - 1
        inner = np.flatnonzero(~new[rows])
        here, there = starts[order[rows[inner]]], starts[order[rows[inner - 1]]]
        differ = np.zeros(len(inner), dtype=bool)
        for k in (*range(offset, MIN_BYTES - 8, 8), MIN_BYTES - 8):
            differ |= view[here + k] != view[there + k]
        if not differ.any():
            break
        open_ = np.zeros(run[-1] + 1, dtype=bool)
        open_[run[inner[differ]]] = True
        rows, run = rows[open_[run]], (np.cumsum(open_) - 1)[run[open_[run]]]
        step = min(MIN_BYTES - offset, (64 - int(run[-1]).bit_length()) // 8)
        key = run.astype(np.uint64) << np.uint64(8 * step) | view[starts[order[rows]] + offset] >> np.uint64(64 - 8 * step) if step < 8 else view[starts[order[rows]] + offset]
        turn = np.argsort(key)
        order[rows] = order[rows[turn]]
        key = key[turn]
        new[rows[1:]] |= key[1:] != key[:-1]
        offset += step
    ranks = np.empty(len(order), dtype=np.int64)
    ranks[order] = np.cumsum(new) - 1
    return order, ranks


def suffix_classes(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return suffix_order(text, starts)[1]


def _smaller_before(value: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Place of the nearest smaller value before each, as long as all places up to it are ``joined`` to the one before them; else -1.

    All at once: a place whose candidate is not smaller goes on to that one's own candidate.
    """
    found = np.where(joined, np.arange(-1, len(value) - 1), -1)
    todo = np.flatnonzero(found >= 0)
    while True:
        todo = todo[value[found[todo]] >= value[todo]]
        if not len(todo):
            return found
        found[todo] = found[found[todo]]
        todo = todo[found[todo] >= 0]


def previous_factors(classes: np.ndarray, owner: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """The longest-previous-factor array of suffixes, truncated to ``MIN_BYTES``.

    In suffix order, the earlier suffix with the longest common prefix is the nearest one before or after with a smaller
    owner. ``classes`` ranks suffixes by their first ``MIN_BYTES`` bytes, so the common prefix of neighbours reaches
    that length if they share a class; shorter factors count as 0, and no search goes past one.
    """
    order = np.argsort(classes, kind="stable") if order is None else order
    rank, value = classes[order], owner[order]
    joined = np.r_[False, rank[1:] == rank[:-1]][: len(rank)]
    before = _smaller_before(value, joined) >= 0
    after = (_smaller_before(value[::-1], np.r_[False, joined[:0:-1]][: len(rank)]) >= 0)[::-1]
    lpf = np.empty(len(rank), dtype=np.uint8)
    lpf[order] = np.where(before | after, np.uint8(MIN_BYTES), np.uint8(0))
    return lpf


def _judge(table: pa.Table) -> pa.Table:
    """For each pack of a bucket, one word a context: bit t tells that its t-th string is in a document with a smaller id."""
    found: dict[bytes, int] = {}
    texts: list[bytes] = []
    least: list[int] = []
    sent = []
    for ids, sizes, pressed in zip(table["ids"].to_pylist(), table["sizes"].to_pylist(), table["texts"].to_pylist()):
        raw, at, own = zstandard.ZstdDecompressor().decompress(pressed), 0, []
        docs = np.frombuffer(zstandard.ZstdDecompressor().decompress(ids), dtype="<i8")
        for doc, size in zip(docs.tolist(), np.frombuffer(sizes, dtype=np.uint8).tolist()):
            text = raw[at : at + size]
            at += size
            number = found.get(text)
            if number is None:
                number = found[text] = len(texts)
                texts.append(text)
                least.append(doc)
            elif doc < least[number]:
                least[number] = doc
            own.append(number)
        sent.append((docs, np.array(own, dtype=np.int64)))
    size = np.array([len(t) for t in texts], dtype=np.int64)
    start = np.cumsum(size) - size
    count = size - MIN_BYTES + 1
    number = np.repeat(np.arange(len(texts)), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first_doc = np.array(least, dtype=np.int64)
    order, classes = suffix_order(np.frombuffer(b"".join(texts), dtype=np.uint8), start[number] + within)
    lpf = previous_factors(classes, first_doc[number], order)
    first = np.cumsum(count) - count
    words = []
    for docs, own in sent:
        n = count[own]
        place = np.repeat(first[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        earlier = (lpf[place] >= MIN_BYTES) | np.repeat(docs > first_doc[own], n)
        bit = (place - np.repeat(first[own], n)).astype(np.uint64)
        words.append(np.add.reduceat(earlier.astype(np.uint64) << bit, np.cumsum(n) - n).tobytes())
    return pa.table({"batch": table["batch"], "bucket": table["bucket"], "words": pa.array(words, pa.binary())})


def _remove(buckets: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                pieces = _Pieces(row, buckets, bits)
                judged = sorted(row["judged"] or [], key=lambda x: x["bucket"])
                gone = pieces.gone(np.concatenate([np.empty(0, dtype=np.uint64), *[np.frombuffer(x["words"], dtype=np.uint64) for x in judged]]))
                out = []
                for doc, at, size in zip(pieces.ids, pieces.at.tolist(), pieces.sizes.tolist()):
                    data, lost = pieces.text[at : at + size], gone[at : at + size]
                    removed = int(np.count_nonzero(lost))
                    spans = int(lost[0]) + int(np.count_nonzero(lost[1:] & ~lost[:-1])) if removed else 0
                    out.append((doc, size, removed, spans, hashlib.sha256(data[~lost].tobytes() if removed else data.tobytes()).hexdigest()))
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (*[pa.int64()] * 4, pa.string()))], names=names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: bytes, removed bytes, maximal removed runs and the digest of what is left."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    packs = materialize(own.mapInArrow(frugal(_pack), "batch long, ids array<long>, sizes array<long>, data binary, n long"), "packs")
    total = packs.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    bits = min(62, max(32, int(total).bit_length() + SPARE_BITS))
    keys = packs.mapInArrow(frugal(_key_rows(buckets, bits)), "bucket long, batch long, blob binary")
    repeated = keys.groupBy("bucket").applyInArrow(_repeated, "batch long, bucket long, blob binary, hot binary, n long")
    wanted = materialize(repeated.groupBy("batch").agg(F.collect_list(F.struct("bucket", "blob", "hot")).alias("blobs"), F.sum("n").alias("n")), "repeats")
    # The shuffled hashes go before the contexts come.
    del keys, repeated
    sweep(spark)
    turns = max(1, -(-(wanted.agg(F.sum("n")).first()[0] or 0) * SHARE_BYTES // max(1, total)))
    joined = packs.join(wanted.drop("n"), "batch", "left")

    def judged(turn: int) -> DataFrame:
        sent = joined.mapInArrow(frugal(_context_rows(buckets, bits, turn, turns)), "bucket long, batch long, ids binary, sizes binary, texts binary")
        return sent.groupBy("bucket").applyInArrow(_judge, "batch long, bucket long, words binary")

    words = None
    for turn in range(turns):
        # The contexts of a share go before the next one's come. The last share stays in the plan of the result, whose other
        # step takes the very same join, so that both read one shuffle of the packs.
        share = judged(turn) if turn == turns - 1 else materialize(judged(turn), "judged")
        words = share if words is None else words.unionByName(share)
        if turn < turns - 1:
            sweep(spark)
    told = words.groupBy("batch").agg(F.collect_list(F.struct("bucket", "words")).alias("judged"))
    return joined.join(told, "batch", "left").mapInArrow(frugal(_remove(buckets, bits)), RESULT)

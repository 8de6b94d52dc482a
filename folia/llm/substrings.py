"""Repeated substrings across documents, by distributed bucket-pointer refinement.

Suffixes (byte positions) are put into buckets by their first ``SEED`` bytes; a bucket of q-grams
is refined by the bucket identifiers of the positions q bytes later, which gives buckets of
2q-grams, and the refined identifiers are used again for the next step, up to ``HALF`` bytes.
The last refinement, to ``LENGTH`` bytes, sorts each bucket's positions on the identifiers of
the buckets ``LENGTH - HALF`` bytes later. Identifiers are 64-bit fingerprints made of the two
that they refine, not ranks, so that those of different tasks are the same ones and no order
over the whole corpus is needed; the last step has a pair of them, so two windows that have
nothing in common pass for equal with a chance of 2**-128, and two that share their first or
last HALF bytes with one of 2**-64.

Only buckets that hold several documents are worth refining. To find them without sending
every position, each window of LENGTH bytes is stood for by the position of the least
``ANCHOR``-byte identifier in it (its anchor): equal windows have equal anchors at equal
offsets. The windows of one anchor are a run of bytes, its context.

1. Anchors, with identifiers of their contexts and their documents, are sent by anchor as
   packed arrays. An anchor of one document is done. Among equal contexts, those of all but
   the least document are repeats as they are. What is left, the least document's context of
   each anchor with several contexts, goes back to its document to be refined.
2. Documents send the pairs of identifiers of those contexts' windows, dealt by both, to be
   sorted; a window repeats in all documents but the least.
3. Documents drop the bytes that repeats cover.

No task gets all copies of anything: of entries that are equal within a sending task only the
least document's go on, as the others are known to repeat at once. An anchor of more than
``HOT`` contexts of several documents in a sending task is dealt by anchor and context, with one
note to the anchor's own part that it has to be refined. Parts grow in number with the input
(``PART_BYTES`` of text each), not in size.

A null text is the empty one; texts are taken whole, in overlapping pieces. Rows without a
doc_id neither lose bytes nor cause others to; rows that repeat a doc_id (equal or not) never
count against each other. Matches don't cross documents. An empty table gives an empty one;
columns of any other names are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm.common import slices, stored, table, utf8

LENGTH, SEED, ANCHOR, HALF = 50, 8, 24, 32
TAIL = LENGTH - HALF
SPAN = LENGTH - ANCHOR + 1
#: Bytes of one document worked on at once; the pieces overlap, so results don't depend on it.
CHUNK = 1 << 20
#: Bytes of text for each part; contexts of an anchor, in one sending task, beyond which they are dealt apart.
PART_BYTES, HOT = 32 << 20, 64
#: Entries that a task gathers before it sends them.
SENT = 1 << 20

_A, _B, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


def refine(first: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Identifiers of buckets refined by the identifiers at a later offset."""
    h = (first * _A) ^ (later * _B + (first >> np.uint64(32)))
    h ^= h >> np.uint64(29)
    h *= _M
    h ^= h >> np.uint64(32)
    return h


def buckets(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the ANCHOR-byte and HALF-byte buckets of every position (none of texts that are too short)."""
    n = len(data)
    seed = np.zeros(max(0, n - SEED + 1), np.uint64)
    for k in range(SEED):  # the bytes themselves: the initial buckets are exact
        seed |= data[k : n - SEED + 1 + k].astype(np.uint64) << np.uint64(8 * k)
    found, size = {SEED: seed}, SEED
    while size < HALF:
        own = found[size]
        found[size * 2] = refine(own[:-size], own[size:])
        if size < ANCHOR < size * 2:
            found[ANCHOR] = refine(own[: size - ANCHOR], seed[size:])
        size *= 2
    return found[ANCHOR], found[HALF]


def _mirrored(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` values in sequence, by doubling."""
    m, length = x, 1
    while length * 2 <= size:
        m = np.minimum(m[:-length], m[length:])
        length *= 2
    return np.minimum(m[: len(x) - size + 1], m[size - length : size - length + len(x) - size + 1]) if length < size else m


def contexts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of windows with one anchor: anchor, context, first window, windows; and all HALF-byte identifiers.

    A run ends where the least identifier changes. A context is the chain of the identifiers of its
    first and last windows and those between, so equal ones have the same bytes.
    """
    if len(data) < LENGTH:
        none = np.empty(0, np.uint64)
        return none, none, np.empty(0, np.int64), np.empty(0, np.int64), none
    anchor, half = buckets(data)
    least = _mirrored(anchor, SPAN)
    first = np.concatenate([[0], np.nonzero(least[1:] != least[:-1])[0] + 1])
    count = np.diff(np.append(first, len(least)))
    window = lambda at: refine(half[at], half[at + TAIL])
    # Windows overlap, so few of them fix all bytes: the first, the last and one every LENGTH between.
    chain = refine(window(first), window(first + count - 1) + count.astype(np.uint64))
    for k in range(LENGTH, int(count.max()), LENGTH):
        long = count > k
        chain[long] = refine(chain[long], window(first[long] + k))
    return least[first], chain, first, count, half


def _pieces(b: bytes):
    """(offset, bytes) of pieces whose windows together are the text's, each in one piece."""
    for k in range(0, max(1, len(b) - LENGTH + 1), CHUNK):
        yield k, np.frombuffer(b, np.uint8, count=min(len(b) - k, CHUNK + LENGTH - 1), offset=k)


#: All rows that tasks send each other: entries and windows by part; what goes back, spans and texts by the part of the document.
ROW = "part int, kind int, doc_id long, pack binary"
ENTRIES, BACK, SPANS, TEXT, WINDOWS = range(5)
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]


def _rows(rows: list[tuple]):
    """Batches of rows of ROW; packs of many parts are as many small rows."""
    for k in range(0, len(rows), 256):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 256]), _KINDS)], names=["part", "kind", "doc_id", "pack"])


def _packed(kind: int, part: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """One row for each part, of the columns' values of that part in their order."""
    packer = zstandard.ZstdCompressor(level=1)
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.nonzero(np.concatenate([[True], part[1:] != part[:-1]]))[0].tolist() if len(part) else []
    return [
        (int(part[i]), kind, None, packer.compress(b"".join(c[order[i:j]].tobytes() for c in columns)))
        for i, j in zip(first, [*first[1:], len(part)])
    ]


def _unpacked(packs: list[bytes], *kinds: type) -> list[np.ndarray]:
    """The columns of all packs, joined."""
    unpacker, found = zstandard.ZstdDecompressor(), [[np.empty(0, k)] for k in kinds]
    width = sum(np.dtype(k).itemsize for k in kinds)
    for pack in packs:
        raw = unpacker.decompress(pack)
        n, at = len(raw) // width, 0
        for own, kind in zip(found, kinds):
            own.append(np.frombuffer(raw, kind, n, at))
            at += own[-1].nbytes
    return [np.concatenate(x) for x in found]


def _home(doc: np.ndarray, parts: int) -> np.ndarray:
    """Parts of documents."""
    return ((doc.view(np.uint64) * _A) >> np.uint64(33)).astype(np.int64) % parts


def _tag(b: bytes) -> int:
    """Tells apart the texts of rows that repeat a doc_id."""
    return int.from_bytes(xxhash.xxh3_64_digest(b), "big", signed=True)


def _span_rows(texts: np.ndarray, spot: np.ndarray, start: np.ndarray, end: np.ndarray, parts: int) -> list[tuple]:
    """Rows of the maximal runs of each text's spans. texts: (doc_id, tag), spot: numbers of texts."""
    if not len(spot):
        return []
    line = int(end.max()) + 1  # texts one after another
    runs = covered(np.stack([start, end], 1) + (spot.astype(np.int64) * line)[:, None])
    doc, tag = texts[runs[:, 0] // line].T
    return _packed(SPANS, _home(doc, parts), doc, tag, runs[:, 0] % line, runs[:, 1] - runs[:, 0])


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where sorted columns have other values than the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _known(doc: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Rows, sorted by document within groups that begin where new, that aren't of their group's least document."""
    return doc != doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]


def _entries(parts: int):
    def entries(batches):
        """Packed entries for each part of the anchors, and spans that are known to repeat a lesser document's."""
        texts, found, size = [], [], 0
        for batch in batches:
            ids, at = batch.column(0).to_pylist(), 0
            for piece in slices(batch.column(1)):
                for b in piece:
                    at += 1
                    if len(b) < LENGTH:
                        continue
                    texts.append((ids[at - 1], _tag(b)))
                    for offset, data in _pieces(b):
                        key, chain, first, count, _ = contexts(data)
                        found.append((key, chain, np.full(len(key), len(texts) - 1, np.uint32), first + offset, first + offset + count + LENGTH - 1))
                        size += len(key)
                    if size > SENT:
                        yield from _rows(_dealt(texts, found, parts))
                        texts, found, size = [], [], 0
        if size:
            yield from _rows(_dealt(texts, found, parts))

    return entries


def _dealt(texts: list, found: list, parts: int) -> list[tuple]:
    key, chain, spot, start, end = map(np.concatenate, zip(*found))
    texts = np.array(texts, np.int64)
    doc = texts[spot, 0]
    order = np.lexsort((doc, chain, key))
    key, chain, doc, spot = key[order], chain[order], doc[order], spot[order]
    new = _changes(key, chain)
    known = _known(doc, new)
    rows = _span_rows(texts, spot[known], start[order[known]], end[order[known]], parts)
    key, chain, doc = key[new], chain[new], doc[new]
    anchors = np.nonzero(_changes(key))[0]
    contexts_of = np.diff(np.append(anchors, len(key)))
    hot = (contexts_of > HOT) & (np.minimum.reduceat(doc, anchors) != np.maximum.reduceat(doc, anchors))
    again = np.repeat(hot, contexts_of)
    part = (np.where(again, refine(key, chain), key) % np.uint64(parts)).astype(np.int64)
    note = anchors[hot]
    note_part = (key[note] % np.uint64(parts)).astype(np.int64)
    flags = np.concatenate([again, np.full(len(note), 2, np.uint8)]).astype(np.uint8)
    part, doc, key, chain = (np.concatenate([x, y]) for x, y in ((part, note_part), (doc, doc[note]), (key, key[note]), (chain, chain[note])))
    return rows + _packed(ENTRIES, part, doc, key, chain, flags)


def _of_kinds(batches, *kinds: int):
    """Packs of each kind of a task's rows, and the other rows, a few at once."""
    found, others = {k: [] for k in kinds}, []
    for batch in batches:
        for k in range(0, len(batch), 256):
            for row in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns)):
                found[row[1]].append(row[3]) if row[1] in found else others.append(row)
    return *found.values(), others


def _settled(parts: int):
    def settled(batches):
        """Refines the part's buckets: sends each document the contexts that repeat as they are, and those to be refined further."""
        packs, others = _of_kinds(batches, ENTRIES)
        yield from _rows(others)  # spans, which are known already
        doc, key, chain, flag = _unpacked(packs, np.int64, np.uint64, np.uint64, np.uint8)
        del packs, others
        if not len(doc):
            return
        order = np.lexsort((doc, chain, flag == 2, key))  # notes stand last among their anchor's entries
        doc, key, chain, flag = doc[order], key[order], chain[order], flag[order]
        anchor = _changes(key)
        new = _changes(key, chain) | (flag == 2)
        whole = _known(doc, new)
        # An anchor's contexts are refined if it has several of them, of several documents, here or in some task's share.
        starts = np.nonzero(anchor)[0]
        several = np.add.reduceat((new & (flag < 2)).astype(np.int64), starts) > 1
        mixed = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
        elsewhere = np.maximum.reduceat(flag, starts) > 0
        again = new & (several & mixed | elsewhere)[np.cumsum(anchor) - 1]
        out = (whole | again) & (flag < 2)
        yield from _rows(_packed(BACK, _home(doc[out], parts), doc[out], key[out], chain[out], whole[out].astype(np.uint8)))

    return settled


def _texts(parts: int):
    def texts(batches):
        """Texts, compressed, by the part of their document; null ids, of which there may be many, by their texts."""
        packer = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            ids, at = batch.column(0).to_pylist(), 0
            for piece in slices(batch.column(1)):
                own = ids[at : at + len(piece)]
                at += len(piece)
                keys = np.array([_tag(b) if i is None else i for i, b in zip(own, piece)], np.int64)
                yield from _rows([(p, TEXT, i, packer.compress(b)) for p, i, b in zip(_home(keys, parts).tolist(), own, piece)])

    return texts


def _with_texts(batches, kind: int):
    """First the packs of ``kind``, then each (doc_id, text) of a task's rows, which are sorted by kind."""
    unpacker, packs, told = zstandard.ZstdDecompressor(), [], False
    for batch in batches:
        for k in range(0, len(batch), 256):
            for _, own, doc_id, pack in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns)):
                if own == kind:
                    packs.append(pack)
                    continue
                if not told:
                    told = True
                    yield None, packs
                    packs = []
                yield doc_id, unpacker.decompress(pack)


def _ranges(*columns: np.ndarray) -> dict:
    """First and end of each run of equal values of sorted columns."""
    first = np.nonzero(_changes(*columns))[0]
    names = [c[first].tolist() for c in columns]
    return dict(zip(names[0] if len(names) == 1 else zip(*names), zip(first.tolist(), [*first[1:].tolist(), len(columns[0])]))) if len(first) else {}


def _refined(parts: int):
    def refined(batches):
        """Spans of contexts that repeat, and packed windows of those to be refined."""
        rows = _with_texts(batches, BACK)
        doc, key, chain, whole = _unpacked(next(rows, (None, []))[1], np.int64, np.uint64, np.uint64, np.uint8)
        wanted, whole = refine(key, chain), whole > 0
        order = np.lexsort((~whole, wanted, doc))  # rows that repeat a doc_id may bring a context as both
        doc, wanted, whole = doc[order], wanted[order], whole[order]
        of = _ranges(doc)
        texts, spans, windows, size = [], [], [], 0
        for doc_id, b in rows:
            if doc_id not in of:
                continue
            i, j = of[doc_id]
            own, own_whole = wanted[i:j], whole[i:j]
            texts.append((doc_id, _tag(b)))
            for offset, data in _pieces(b):
                k, c, first, count, half = contexts(data)
                if not len(k):
                    continue
                mine = refine(k, c)
                place = np.minimum(np.searchsorted(own, mine), len(own) - 1)
                met = own[place] == mine
                hit, more = met & own_whole[place], np.nonzero(met & ~own_whole[place])[0]
                start = first[hit] + offset
                spans.append((np.full(len(start), len(texts) - 1, np.uint32), start, start + count[hit] + LENGTH - 1))
                n = count[more]
                pos = np.repeat(first[more] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                windows.append((np.full(len(pos), len(texts) - 1, np.uint32), pos + offset, half[pos], half[pos + TAIL]))
                size += len(pos) + len(start)
            if size > SENT:
                yield from _rows(_found(texts, spans, windows, parts))
                texts, spans, windows, size = [], [], [], 0
        if size:
            yield from _rows(_found(texts, spans, windows, parts))

    return refined


def _found(texts: list, spans: list, windows: list, parts: int) -> list[tuple]:
    """Rows of spans, among them windows that a lesser document of this task holds, and of all other windows for each part."""
    texts = np.array(texts, np.int64)
    spot, start, one, two = map(np.concatenate, zip(*windows))
    doc = texts[spot, 0]
    order = np.lexsort((doc, two, one))
    known = np.empty(len(order), bool)
    known[order] = _known(doc[order], _changes(one[order], two[order]))
    spans = [*spans, (spot[known], start[known], start[known] + LENGTH)]
    rows = _span_rows(texts, *map(np.concatenate, zip(*spans)), parts)
    spot, start, one, two = (x[~known] for x in (spot, start, one, two))
    # In the order of texts, in which all but the identifiers takes little room.
    return rows + _packed(WINDOWS, (refine(one, two) % np.uint64(parts)).astype(np.int64), *texts[spot].T, start, one, two)


def _matched(parts: int):
    def matched(batches):
        """Sorts the buckets of a part's windows on the identifiers at the later offset; spans of those that a lesser document holds too."""
        packs, others = _of_kinds(batches, WINDOWS)
        yield from _rows(others)  # spans, which are known already
        doc, tag, start, one, two = _unpacked(packs, np.int64, np.int64, np.int64, np.uint64, np.uint64)
        del packs, others
        order = np.lexsort((doc, two, one))
        hit = order[_known(doc[order], _changes(one[order], two[order]))] if len(order) else order
        hit.sort()
        doc, tag, start = doc[hit], tag[hit], start[hit]
        yield from _rows(_packed(SPANS, _home(doc, parts), doc, tag, start, np.full(len(doc), LENGTH)))

    return matched


def covered(spans: np.ndarray) -> np.ndarray:
    """The maximal runs of (start, end) spans."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    first = np.nonzero(new)[0]
    return np.stack([spans[first, 0], np.append(reach[first[1:] - 1], reach[-1])], 1)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary, runs array<long>"


def _removed(with_text: bool):
    def removed(batches):
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.list_(pa.int64())]
        names = [c.split()[0] for c in RESULT.split(", ")]
        rows = _with_texts(batches, SPANS)
        doc, tag, start, size = _unpacked(next(rows, (None, []))[1], *[np.int64] * 4)
        order = np.lexsort((tag, doc))
        spans = np.stack([start, start + size], 1)[order]
        of = _ranges(doc[order], tag[order])
        del doc, tag, start, size, order
        out, held = [], 0
        for doc_id, b in rows:
            i, j = of.get((doc_id, _tag(b)), (0, 0))
            own = covered(spans[i:j])
            cuts = [0, *own.ravel().tolist(), len(b)]
            kept = b"".join(b[x:y] for x, y in zip(cuts[::2], cuts[1::2]))
            out.append((doc_id, len(b), len(b) - len(kept), len(own), hashlib.sha256(kept).hexdigest(), kept if with_text else None, cuts[1:-1]))
            held += len(kept) + 100
            if held > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return removed


def remove_repeats(docs: DataFrame, text: str = "text", parts: int | None = None, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, the kept bytes if asked for, and the removed runs.

    parts: shares that anchors and documents are dealt out to; by default as many as the input's
    bytes ask for, at least the session's shuffle partitions.
    """
    spark = docs.sparkSession
    if parts is None:
        total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(text).alias("b"))
    known = docs.filter(F.col("doc_id").isNotNull())
    dealt = lambda rows: rows.repartitionById(parts, F.col("part"))
    sorted_ = lambda rows: dealt(rows).sortWithinPartitions("kind")
    back = stored(dealt(known.mapInArrow(_entries(parts), ROW)).mapInArrow(_settled(parts), ROW), "repeats")
    texts = known.mapInArrow(_texts(parts), ROW)
    found = sorted_(back.filter(F.col("kind") == BACK).unionByName(texts)).mapInArrow(_refined(parts), ROW)
    hits = stored(dealt(found).mapInArrow(_matched(parts), ROW), "hits")
    spans = back.filter(F.col("kind") == SPANS).unionByName(hits)
    return sorted_(spans.unionByName(docs.mapInArrow(_texts(parts), ROW))).mapInArrow(_removed(with_text), RESULT)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op3_substrings": op3_substrings}
SQL: dict[str, str] = {}

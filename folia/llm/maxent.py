"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

A token is reached by three choices of one in GROUPS each: the group of its class, its class in
the group, and its leaf in the class. The most frequent words are a class by themselves; other
words share the classes of their endings, where the most frequent have a leaf of their own and
all others share the last one. The model gives
    P(token | history) = P(group | history) P(class | group, history) P(leaf | class, history) P(token | leaf),
three softmaxes whose weights are rows of hashed tables, added up over the features of the
history: the word before and the classes before (n-grams), and the second word before (a skip).
Every word, whatever its count, is a context by its own fingerprint. P(token | leaf) is 1 for a
leaf of one word and else the token's smoothed share of the leaf's training tokens.

Weights begin at the damped logarithms of how much more often a row is met with each choice than
expected, by counts over all training tokens. Then, in ROUNDS rounds that together run over all
training tokens, tasks send the gradients of their tokens, which are summed up in a tree, and
each weight takes one step scaled by its curvature. All that tasks send is sums, so the model
and the scores are those of the table, however it is cut into tasks (up to rounding).

Texts are tokenized once, into chunks of whole texts' ids with a dictionary each. Counts of words
cover all training tokens and grow with the corpus; they stay a distributed table. Only the
``HEAD`` most frequent words of at most ``HEAD_BYTES`` bytes are sent to the executors; other
words are joined with the table of counts.
The tables of weights have 28 MB, twice as many for every four times the distinct words beyond
2**19; driver and tasks hold them whole. Scoring is in sparse numpy batches.

A null text is empty: one end token. Texts are taken whole, however long. Repeated rows count and
are scored each. A row without a doc_id is not held out. Ties in counts go by the words' bytes.
Without training rows all counts are 0 and the choices stay uniform; an empty table gives an
empty one. Columns of any other names are left alone.
"""

from __future__ import annotations

import math
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm.common import forget, stored, table, utf8

FOLDS, HELD_OUT = 10, 0
SMOOTH = 0.1
#: Words sent to the executors and their longest: at most HEAD * (HEAD_BYTES + 8) bytes, 15 MB.
HEAD, HEAD_BYTES = 1 << 18, 48
GROUPS = 16
CLASSES = GROUPS * GROUPS
#: Words with a class of their own.
SINGLE = 128
#: Bits of the row numbers of the three tables; distinct words beyond which they grow.
BITS, DISTINCT = (16, 18, 17), 1 << 19
#: Rows of a block that sums are sent in, bytes of a chunk's texts, tokens of a stream and of a softmax at once, tokens of a training task.
BLOCK, CHUNK_BYTES, STREAM, BATCH, TASK = 1 << 12, 6 << 20, 1 << 17, 1 << 12, 1 << 27
#: Damping of the start, tokens of a row's prior, rounds, their rate, and the least curvature.
DAMP, PRIOR, ROUNDS, RATE, LEAST = 0.5, 8.0, 2, 0.3, 8.0
END = b""


MARKS = b".,;:!?|\"')"


def ending(word: bytes) -> int:
    """The class of a word that has none of its own."""
    return SINGLE + zlib.crc32(word.rstrip(MARKS)[-3:]) % (CLASSES - SINGLE)


def tail_id(word: bytes) -> int:
    """The id of a word that isn't in the head: negative, of 24 bits of its fingerprint and its class."""
    return -1 - (zlib.crc32(word) >> 8 << 7 | ending(word) - SINGLE)


def tail_ids(words: list[bytes]) -> np.ndarray:
    """tail_id of each word."""
    prints = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    ends = np.fromiter((zlib.crc32(w.rstrip(MARKS)[-3:]) for w in words), np.int64, len(words))
    return -1 - (prints >> 8 << 7 | ends % (CLASSES - SINGLE))


def listed(words: pa.Array) -> list[bytes]:
    """Words as Python's bytes; many times as fast as to_pylist."""
    return words.to_numpy(zero_copy_only=False).tolist()


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


_START, _CLASS, _GROUP = mixed(np.array([1 << 40]))[0], np.uint64(0xD6E8FEB86659FD93), np.uint64(0x8CB92BA72F3D8DD7)


def _hashed(value: np.ndarray, kind: int, bits: int, rare: np.ndarray | None = None) -> np.ndarray:
    """Rows of a table's first half, or of its second half where rare."""
    h = value * np.uint64(0x9E3779B97F4A7C15 + 0x2468ACF0 * kind)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    rows = (h >> np.uint64(65 - bits)).astype(np.int64)
    return rows if rare is None else rows + (rare.astype(np.int64) << (bits - 1))


CHUNKS = "rows binary, doc_ids array<long>, lengths binary, held binary, ids binary, words array<binary>, counts array<long>"


def _chunk(parts: list[tuple]) -> pa.RecordBatch:
    """A chunk of Arrow columns row, doc_id, held_out, text: ids into its own words, and their counts in the training texts."""
    rows, doc_ids, held, texts = (pa.concat_arrays(x) for x in zip(*parts))
    held = held.to_numpy(zero_copy_only=False).astype(np.uint8)
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    coded = split.values.dictionary_encode()
    words, local, at = coded.dictionary.view(pa.binary()), coded.indices.to_numpy(), split.offsets.to_numpy()
    end = pc.index(words, END).as_py()  # of white space at a text's ends, or of none
    if end < 0:
        end, words = len(words), pa.concat_arrays([words, pa.array([END], pa.binary())])
    word = local != end
    before = np.concatenate([[0], np.cumsum(word)])
    lengths = before[at[1:]] - before[at[:-1]] + 1
    ids, inside = np.full(int(lengths.sum()), end, np.int32), np.ones(int(lengths.sum()), bool)
    inside[np.cumsum(lengths) - 1] = False
    ids[inside] = local[word]
    counts = np.bincount(ids[np.repeat(held, lengths) == 0], minlength=len(words))
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    raw = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
    columns = [raw(rows.to_numpy(), "<i8"), one(doc_ids), raw(lengths, "<i8"), raw(held, "u1"), raw(ids, "<i4"), one(words), one(pa.array(counts))]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in CHUNKS.split(", ")])


def _chunked(batches):
    parts, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(3)).to_numpy())
        a = 0
        while a < len(batch):
            done = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, done + CHUNK_BYTES - size, "right")))
            parts.append(tuple(c.slice(a, b - a) for c in batch.columns))
            size, a = size + int(ends[b - 1]) - done, b
            if size >= CHUNK_BYTES or len(parts) > 64:
                yield _chunk(parts)
                parts, size = [], 0
    if parts:
        yield _chunk(parts)


class Vocabulary:
    """What executors know of the counts: the head's words in order of falling count, and sums of the shared leaves."""

    def __init__(self, head: list[tuple[bytes, int]]):
        self.words = [w for w, _ in head]
        self.counts = np.array([c for _, c in head] or [0], np.int64)
        self.classes = np.array([k if k < SINGLE else ending(w) for k, w in enumerate(self.words)] or [0], np.int64)
        # The first words of each class in the order of counts have a leaf each.
        order = np.argsort(self.classes, kind="stable")
        sizes = np.bincount(self.classes, minlength=CLASSES)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.leaves = np.minimum(rank, GROUPS - 1)
        self.alone = self.leaves < GROUPS - 1
        self.tokens = self.distinct = 0
        self.rest_tokens, self.rest_words = np.zeros(CLASSES), np.zeros(CLASSES)  # of the last leaves
        self.sized(0)
        self._ids: dict[bytes, int] | None = None

    def __getstate__(self):
        return self.__dict__ | {"_ids": None}

    def sized(self, distinct: int) -> None:
        """Bits of the tables, and the contexts of the head's words; those of frequent words are kept apart from all others."""
        more = max(0, int(math.log2(max(distinct, 1) / DISTINCT) // 2))
        self.bits = tuple(b + more for b in BITS)
        self.frequent = 1 << (self.bits[0] - 3)
        self.contexts = mixed(np.array([k if k < self.frequent else (1 << 33) + zlib.crc32(w) for k, w in enumerate(self.words)] or [0], np.int64))
        # Rows of the features that are one word of the head, or classes only.
        b1, b2, b3 = self.bits
        rare = np.arange(len(self.contexts)) >= self.frequent
        self.of_words = [np.append(_hashed(self.contexts, kind, b1, rare), _hashed(np.array([_START]), kind, b1)) for kind in (1, 2)]
        near = np.arange(CLASSES + 1)
        self.of_pair = _hashed(mixed(np.arange((CLASSES + 1) ** 2) + (1 << 41)), 4, b1)
        self.of_group = _hashed(mixed(near + (1 << 42))[:, None] ^ np.arange(GROUPS).astype(np.uint64) * _GROUP, 7, b2).ravel()
        self.of_class = _hashed(mixed(near + (1 << 43))[:, None] ^ np.arange(CLASSES).astype(np.uint64) * _CLASS, 9, b3).ravel()

    def finished(self) -> None:
        """log10 of the smoothed counts, and of the last factor, of the head's words."""
        self.log_count = np.log10(self.counts + SMOOTH)
        self.log_rest = np.log10(self.rest_tokens + SMOOTH * (self.rest_words + 1))
        self.log_share = np.where(self.alone, 0.0, self.log_count - self.log_rest[self.classes])

    @property
    def ids(self) -> dict[bytes, int]:
        if self._ids is None:
            self._ids = {w: k for k, w in enumerate(self.words)}
        return self._ids


def _rest(alone):
    def rest(batches):
        """Tokens and words of all and of each class's last leaf, of a task's share of the table of counts."""
        tokens, distinct, own = np.zeros(CLASSES + 1, np.int64), np.zeros(CLASSES + 1, np.int64), alone.value
        for batch in batches:
            words, counts = listed(batch.column(0)), batch.column(1).to_numpy()
            classes = np.fromiter((CLASSES if w in own else ending(w) for w in words), np.int64, len(words))
            tokens += np.bincount(classes, counts, CLASSES + 1).astype(np.int64)
            distinct += np.bincount(classes, minlength=CLASSES + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES + 1)), pa.array(tokens), pa.array(distinct)], names=["class", "tokens", "words"])

    return rest


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    """counts: (word, c), one row a word."""
    spark = counts.sparkSession
    top = counts.filter(F.octet_length("word") <= HEAD_BYTES).orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
    v = Vocabulary(list(zip((bytes(w) for w in top.column(0).to_pylist()), top.column(1).to_pylist())))
    # At most SINGLE + (CLASSES - SINGLE) * (GROUPS - 1) words have a leaf of their own.
    alone = spark.sparkContext.broadcast({w for w, a in zip(v.words, v.alone.tolist()) if a})
    sums = counts.mapInArrow(_rest(alone), "class long, tokens long, words long").groupBy("class").agg(F.sum("tokens"), F.sum("words")).collect()
    for k, tokens, words in sums:
        v.tokens, v.distinct = v.tokens + tokens, v.distinct + words
        if k < CLASSES:
            v.rest_tokens[k], v.rest_words[k] = tokens, words
    v.sized(v.distinct)
    v.finished()
    return v


def chunk_ids(v: Vocabulary, words: list[bytes]) -> np.ndarray:
    """Ids of a chunk's words, negative where they aren't in the head."""
    ids = np.fromiter(map(v.ids.get, words, repeat(-1)), np.int64, len(words))
    tail = np.nonzero(ids < 0)[0]
    ids[tail] = tail_ids([words[k] for k in tail.tolist()])
    return ids


class Choices:
    """One softmax's share of a stream: tokens it applies to (none: all), their biases, choices, and rows of each feature."""

    def __init__(self, at, bias, target, rows):
        self.at, self.bias, self.target, self.rows = at, bias, target, rows


class Stream:
    """The features of the tokens of several texts, one after another."""

    def __init__(self, v: Vocabulary, ids: np.ndarray, lengths: np.ndarray):
        self.lengths = lengths
        n, tail = len(ids), np.nonzero(ids < 0)[0]
        known = np.maximum(ids, 0)
        context, self.classes, leaf, self.share, rare = v.contexts[known], v.classes[known], v.leaves[known], v.log_share[known], known >= v.frequent
        code = -1 - ids[tail]
        context[tail] = mixed((code >> 7) + (1 << 34))
        by_word = [of[known] for of in v.of_words]
        for kind, of in enumerate(by_word, 1):
            of[tail] = _hashed(context[tail], kind, v.bits[0], np.ones(len(tail), bool))
        self.classes[tail], leaf[tail], rare[tail] = SINGLE + (code & 127), GROUPS - 1, True
        self.share[tail] = -v.log_rest[self.classes[tail]]  # the words' counts are added later
        starts = np.cumsum(lengths) - lengths
        heads = [starts, np.concatenate([starts, starts[lengths > 1] + 1])]

        def before(values: np.ndarray, k: int, start) -> np.ndarray:
            out = np.empty_like(values)
            out[k:] = values[:-k]
            out[heads[k - 1]] = start
            return out

        one, two = (before(context, k, _START) for k in (1, 2))
        rare_one, rare_two = (before(rare, k, False) for k in (1, 2))
        near, far = (before(self.classes, k, CLASSES) for k in (1, 2))
        _, b2, b3 = v.bits
        group, member = self.classes // GROUPS, self.classes % GROUPS
        by_group = group.astype(np.uint64) * _GROUP
        rows1 = [*(before(of, k, v.of_words[k - 1][-1]) for k, of in enumerate(by_word, 1)), v.of_pair[near * (CLASSES + 1) + far]]
        rows2 = [_hashed(one ^ by_group, 5, b2, rare_one), _hashed(two ^ by_group, 6, b2, rare_two), v.of_group[near * GROUPS + group]]
        shared = np.nonzero(self.classes >= SINGLE)[0]
        own = self.classes[shared]
        rows3 = [_hashed(one[shared] ^ own.astype(np.uint64) * _CLASS, 8, b3, rare_one[shared]), v.of_class[near[shared] * CLASSES + own]]
        self.choices = [Choices(None, np.zeros(n, np.int64), group, rows1), Choices(None, group, member, rows2), Choices(shared, own, leaf[shared], rows3)]


def zero_counts(bits: tuple[int, ...]) -> list[dict]:
    """For each table: how often each choice was met by bias and by row, and the greatest bias met with a row."""
    return [{"bias": np.zeros((CLASSES, GROUPS)), "rows": np.zeros((1 << b, GROUPS), np.int32), "of": np.zeros(1 << b, np.uint8)} for b in bits]


def add_counts(counts: list[dict], s: Stream) -> None:
    for own, c in zip(counts, s.choices):
        own["bias"] += np.bincount(c.bias * GROUPS + c.target, minlength=CLASSES * GROUPS).reshape(CLASSES, GROUPS)
        flat = own["rows"].reshape(-1)
        for rows in c.rows:
            np.add.at(flat, rows * GROUPS + c.target, np.int32(1))
            np.maximum.at(own["of"], rows, c.bias.astype(np.uint8))


class Model:
    """Weights of the three softmaxes: of biases and of rows; and the curvature of each row's weights."""

    def __init__(self, counts: list[dict]):
        self.bias, self.rows, self.curve = [], [], []
        for own in counts:
            prior = (own["bias"] + 0.5) / (own["bias"].sum(1, keepdims=True) + 0.5 * GROUPS)
            self.bias.append(np.log(prior).astype(np.float32))
            met = own["rows"].astype(np.float32)
            expected, total = prior.astype(np.float32)[own["of"]], met.sum(1, keepdims=True)
            self.rows.append(np.float32(DAMP) * (np.log((met + PRIOR * expected) / (total + PRIOR)) - np.log(expected)))
            half = len(met) // 2  # rows of rare words stay as they begin
            self.curve.append((met * (1 - met / np.maximum(total, 1)))[:half] + np.float32(LEAST))

    def __getstate__(self):
        return self.__dict__ | {"curve": None}

    def shares(self, k: int, c: Choices, b: slice) -> tuple[np.ndarray, np.ndarray]:
        """Shares of all choices of the k-th softmax, and their sums, by which they are to be divided."""
        z = np.take(self.bias[k], c.bias[b], axis=0)
        for rows in c.rows:
            z += np.take(self.rows[k], rows[b], axis=0)
        np.exp(z, out=z)  # the weights are logarithms of bounded ratios, so nothing overflows
        return z, z @ np.ones(GROUPS, np.float32)

    def chances(self, k: int, c: Choices, b: slice) -> np.ndarray:
        """Probabilities of all choices of the k-th softmax."""
        z, total = self.shares(k, c, b)
        return z / total[:, None]

    def log_chances(self, s: Stream) -> np.ndarray:
        """log10 probability of each token's choices."""
        out = np.zeros(len(s.classes))
        for k, c in enumerate(s.choices):
            for a in range(0, len(c.target), BATCH):
                b = slice(a, a + BATCH)
                z, total = self.shares(k, c, b)
                chance = np.log10(z[np.arange(len(z)), c.target[b]] / total)
                out[b if c.at is None else c.at[b]] += chance
        return out

    def add_gradient(self, sums: list[np.ndarray], s: Stream) -> None:
        """Adds the gradients of the rows that are trained to ``sums``: for each table, (choice, row)."""
        for k, c in enumerate(s.choices):
            n, half = len(c.target), sums[k].shape[1]
            g = np.empty((GROUPS, n))
            for a in range(0, n, BATCH):
                z, total = self.shares(k, c, slice(a, a + BATCH))
                np.divide(z.T, total, out=g[:, a : a + BATCH])
            g[c.target, np.arange(n)] -= 1
            # Rows beyond the half, those of rare words, are left out.
            kept = [np.nonzero(rows < half)[0] for rows in c.rows]
            rows, at = np.concatenate([rows[i] for rows, i in zip(c.rows, kept)]), np.concatenate(kept)
            for j in range(GROUPS):
                sums[k][j] += np.bincount(rows, np.take(g[j], at), half)

    def step(self, sums: list[np.ndarray]) -> None:
        for rows, total, curve in zip(self.rows, sums, self.curve):
            rows[: len(curve)] -= np.float32(RATE * ROUNDS) * total.T / curve


SUMS = "kind int, block int, task int, pack binary"


def _streams(v: Vocabulary, chunk: dict, chosen: np.ndarray | None = None):
    """Streams of a chunk's texts, or of those chosen, each with the range of texts."""
    lengths = np.frombuffer(chunk["lengths"], "<i8")
    ids = chunk_ids(v, chunk["words"])[np.frombuffer(chunk["ids"], "<i4")]
    if chosen is not None:
        ids, lengths = ids[np.repeat(chosen, lengths)], lengths[chosen]
    ends = np.cumsum(lengths)
    a = 0
    while a < len(lengths):
        first = int(ends[a] - lengths[a])
        b = max(a + 1, int(np.searchsorted(ends, first + STREAM, "right")))
        yield a, b, Stream(v, ids[first : int(ends[b - 1])], lengths[a:b])
        a = b


def _chunks(batches):
    read = {"words": lambda c: listed(c.values), "doc_ids": lambda c: c.as_py()}
    for batch in batches:
        for k in range(len(batch)):
            yield {n: read.get(n, lambda c: c.as_buffer())(batch.column(n)[k]) for n in batch.schema.names if n != "counts"}


def _training(chunk: dict, part: int | None = None) -> np.ndarray:
    """Which texts are trained on (in a round: those of its part, which doc_id and length decide)."""
    chosen = np.frombuffer(chunk["held"], np.uint8) == 0
    if part is not None:
        ids = np.array([-1 if i is None else i for i in chunk["doc_ids"]], np.int64)
        chosen &= mixed(ids * 3 + np.frombuffer(chunk["lengths"], "<i8")) % np.uint64(ROUNDS) == part
    return chosen


def _sent(kinds: list[tuple[int, np.ndarray]], task: int):
    """Arrays by blocks of rows, those of zeros left out; kind: what they are."""
    packer = zstandard.ZstdCompressor(level=1)
    for kind, array in kinds:
        for k in range(0, len(array), BLOCK):
            own = array[k : k + BLOCK]
            if own.any():
                own = np.ascontiguousarray(own)
                columns = [[kind], [k // BLOCK], [task], [packer.compress(own.tobytes())]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["kind", "block", "task", "pack"])


#: Kinds of arrays by their type: three of each.
_TYPES = [np.float64] * 3 + [np.int32] * 3 + [np.uint8] * 3 + [np.float32] * 3


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _tallied(vocabulary):
    def tallied(batches):
        counts = zero_counts(vocabulary.value.bits)
        for chunk in _chunks(batches):
            for *_, s in _streams(vocabulary.value, chunk, _training(chunk)):
                add_counts(counts, s)
        yield from _sent([(3 * j + k, own[name]) for j, name in enumerate(("bias", "rows", "of")) for k, own in enumerate(counts)], _task())

    return tallied


def zero_sums(model: Model) -> list[np.ndarray]:
    return [np.zeros((GROUPS, len(w) // 2)) for w in model.rows]


def _gradients(vocabulary, model, part: int):
    def gradients(batches):
        own = model.value
        sums = zero_sums(own)
        for chunk in _chunks(batches):
            for *_, s in _streams(vocabulary.value, chunk, _training(chunk, part)):
                own.add_gradient(sums, s)
        yield from _sent([(9 + k, x.reshape(-1, GROUPS).astype(np.float32)) for k, x in enumerate(sums)], _task())

    return gradients


def _summed(batches):
    """Sums of the blocks of a task's share (of biases of rows: the greatest)."""
    unpacker, sums = zstandard.ZstdDecompressor(), {}
    for batch in batches:
        for kind, block, task, pack in (x for k in range(len(batch)) for x in zip(*(c.to_pylist() for c in batch.slice(k, 1).columns))):
            own = np.frombuffer(unpacker.decompress(pack), _TYPES[kind])
            found = sums.get((kind, block, task))
            if found is None:
                sums[kind, block, task] = own.copy()
            else:
                (np.maximum if _TYPES[kind] is np.uint8 else np.add)(found, own, out=found)
    packer = zstandard.ZstdCompressor(level=1)
    for (kind, block, task), own in sums.items():
        columns = [[kind], [block], [task], [packer.compress(own.tobytes())]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["kind", "block", "task", "pack"])


def _gathered(rows: DataFrame, tasks: int, arrays: dict[int, np.ndarray]) -> None:
    """Adds up what tasks sent, in a tree of two levels, into the arrays of each kind."""
    fan = max(1, math.isqrt(tasks))
    some = rows.withColumn("task", F.pmod("task", F.lit(fan))).repartition("kind", "block", "task").mapInArrow(_summed, SUMS)
    total = some.withColumn("task", F.lit(0)).repartition("kind", "block").mapInArrow(_summed, SUMS)
    unpacker = zstandard.ZstdDecompressor()
    total = stored(total, "sums", "none")
    for batch in total.select("kind", "block", "pack").toArrow().to_batches():
        for kind, block, pack in zip(*(c.to_pylist() for c in batch.columns)):
            own = np.frombuffer(unpacker.decompress(pack), _TYPES[kind])
            flat = arrays[kind].reshape(-1)
            at = block * BLOCK * (arrays[kind].size // len(arrays[kind]))
            flat[at : at + len(own)] = own
    forget(total)


def train(chunks: DataFrame, v: Vocabulary) -> Model:
    """A model of the chunks' training texts."""
    sc = chunks.sparkSession.sparkContext
    tasks = max(2 * sc.defaultParallelism, -(-v.tokens // TASK))
    vocabulary, chunks = sc.broadcast(v), chunks.select("doc_ids", "lengths", "held", "ids", "words").coalesce(tasks)
    counts = zero_counts(v.bits)
    _gathered(chunks.mapInArrow(_tallied(vocabulary), SUMS), tasks, {3 * j + k: own[name] for j, name in enumerate(("bias", "rows", "of")) for k, own in enumerate(counts)})
    model = Model(counts)
    del counts
    for part in range(ROUNDS):
        sent, sums = sc.broadcast(model), zero_sums(model)
        flat = {9 + k: np.zeros((x.size // GROUPS, GROUPS), np.float32) for k, x in enumerate(sums)}
        _gathered(chunks.mapInArrow(_gradients(vocabulary, sent, part), SUMS), tasks, flat)
        model.step([flat[9 + k].reshape(x.shape) for k, x in enumerate(sums)])
        sent.unpersist()
    return model


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_head long, base double, score double, words array<binary>, times array<long>"


def _scored(vocabulary, model):
    def scored(batches):
        v = vocabulary.value
        norm = math.log10(v.tokens + SMOOTH * (v.distinct + 1))
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = [c.split()[0] for c in SCORED.split(", ")]
        for chunk in _chunks(batches):
            rows, lengths, held = (np.frombuffer(chunk[n], t) for n, t in (("rows", "<i8"), ("lengths", "<i8"), ("held", np.uint8)))
            local, words, doc_ids = np.frombuffer(chunk["ids"], "<i4"), pa.array(chunk["words"], pa.binary()), chunk["doc_ids"]
            of = chunk_ids(v, chunk["words"])
            log_count = np.where(of >= 0, v.log_count[np.maximum(of, 0)], 0.0) - norm
            for a, b, s in _streams(v, chunk):
                n, starts = len(s.lengths), np.cumsum(s.lengths) - s.lengths
                first = int(lengths[:a].sum())
                own = local[first : first + int(s.lengths.sum())]
                head = of[own] >= 0
                score = np.add.reduceat(model.value.log_chances(s) + s.share, starts)
                base, known = np.add.reduceat(log_count[own], starts), np.add.reduceat(head.astype(np.int64), starts)
                # Each text's distinct words that aren't in the head, and how often it has them.
                text = np.repeat(np.arange(n), s.lengths)[~head]
                pairs, times = np.unique(text * len(words) + own[~head], return_counts=True)
                ends = pa.array(np.searchsorted(pairs, np.arange(n + 1) * len(words)).astype(np.int32))
                columns = [pa.array(c, t) for c, t in zip((rows[a:b], doc_ids[a:b], held[a:b] > 0, s.lengths, known, base, score), kinds)]
                columns += [pa.ListArray.from_arrays(ends, words.take(pa.array(pairs % len(words)))), pa.ListArray.from_arrays(ends, pa.array(times))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return scored


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def score(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    sc = docs.sparkSession.sparkContext
    held = held_out(F.col("doc_id").cast("long"))
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), utf8(text).alias("b"))
    chunks = stored(docs.mapInArrow(_chunked, CHUNKS), "chunks")
    words = chunks.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select(F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    counts = stored(words.filter("c > 0").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    v = vocabulary_of(counts)
    scored = stored(chunks.drop("counts").mapInArrow(_scored(sc.broadcast(v), sc.broadcast(train(chunks, v))), SCORED), "scored")
    forget(chunks)
    tail = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("t")).select("row", F.col("t.words").alias("word"), F.col("t.times").alias("n"))
    c = F.coalesce("c", F.lit(0))
    met = tail.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(c + SMOOTH)).alias("rest"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more")
    )
    rest, more = F.coalesce("rest", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return scored.drop("words", "times").join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + more).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rest).alias("base_score"), (F.col("score") + rest).alias("score"),
    )


def op6_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op6_maxent": op6_maxent}
SQL: dict[str, str] = {}

"""Byte-level BPE: encoding and decoding by given ranks; tokenizers are never trained here.

Each match of the split pattern is encoded by itself. A segment tree over its byte positions
stores the leftmost minimum pair rank; a merge takes the root and makes logarithmic point
updates on the merged position and its live left neighbour. Pieces met for the first time
are encoded together: one numpy tree for each piece of the same width, all stepped at once.
Long pieces, of which there are few, get a tree of their own. Ids of pieces are kept for
later texts in a bounded store that is emptied when full; results don't depend on it.

Nulls: a null text is the empty text (no ids). Bytes that are not UTF-8 are read as U+FFFD.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm.common import bounded, slices, struct_array, table, unused, utf8

NONE = 1 << 30
#: Pieces of more bytes than this get a tree of their own.
TOGETHER = 64
#: Kept pieces of a worker, and the bytes of the longest that is kept.
KEPT, KEPT_BYTES = 200_000, 64
#: Characters of a text split at once.
SPAN = 1 << 20


def read_ranks(path: str, most: int = 64 << 20) -> bytes:
    """The rank file's bytes; at most ``most``, as they are sent to every executor."""
    with open(path, "rb") as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise ValueError(f"{path} has over {most} bytes")
    return data


class Tokenizer:
    def __init__(self, rank_file: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.pattern = regex.compile(pattern)
        self.words: dict[int, bytes] = {i: t for t, i in ranks.items()}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.kept: dict[str, bytes] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.merged[at], NONE)

    def together(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of at most ``width`` bytes (a power of two) as little-endian bytes."""
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
        length = np.array([len(p) for p in pieces])
        spot = np.arange(width)
        ids = np.where(spot < length[:, None], self.of_byte[raw], -1)
        after = np.broadcast_to(spot + 1, (n, width)).copy()  # the next live position; its own length where there is none
        before = np.broadcast_to(spot - 1, (n, width)).copy()
        # A node holds rank * width + position: the least is the lowest rank, and of equals the leftmost.
        tree = np.full((n, 2 * width), NONE * width, dtype=np.int64)
        rank = np.full((n, width), NONE, dtype=np.int64)
        if width > 1:
            rank[:, :-1] = self._ranks(ids[:, :-1], ids[:, 1:])
        tree[:, width:] = rank * width + spot
        for level in range(width.bit_length() - 2, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        live = np.nonzero(tree[:, 1] < NONE * width)[0]
        while len(live):
            top = tree[live, 1]
            here, new = top % width, top // width
            gone = after[live, here]
            ids[live, here], ids[live, gone] = new, -1
            then = after[live, gone]
            after[live, here] = then
            inside = then < width
            before[live[inside], then[inside]] = here[inside]
            last = before[live, here]
            right = np.where(inside, ids[live, np.minimum(then, width - 1)], -1)
            left = np.where(last >= 0, ids[live, np.maximum(last, 0)], -1)
            tree[live, width + gone] = NONE * width
            tree[live, width + here] = self._ranks(new, right) * width + here
            some = last >= 0
            tree[live[some], width + last[some]] = self._ranks(left, new)[some] * width + last[some]
            for node in (gone, here, np.maximum(last, 0)):
                node = (node + width) >> 1
                while node[0]:
                    tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
                    node = node >> 1
            live = live[tree[live, 1] < NONE * width]
        flat, ends = ids[ids >= 0].astype("<u4").tobytes(), np.cumsum((ids >= 0).sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends.tolist()[:-1]], ends.tolist())]

    def alone(self, piece: bytes) -> bytes:
        """Ids of one long piece by a tree of its own."""
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        ids = self.of_byte[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        start = np.full(2 * width, NONE * width, dtype=np.int64)
        array = np.array(ids, dtype=np.int64)
        start[width : width + n - 1] = self._ranks(array[:-1], array[1:]) * width + np.arange(n - 1)
        for level in range(width.bit_length() - 2, -1, -1):
            a = 1 << level
            start[a : 2 * a] = np.minimum(start[2 * a : 4 * a : 2], start[2 * a + 1 : 4 * a : 2])
        tree, pairs, end = start.tolist(), self.pairs, NONE * width

        def put(spot: int, value: int) -> None:
            spot += width
            tree[spot] = value
            spot >>= 1
            while spot:
                a, b = tree[2 * spot], tree[2 * spot + 1]
                value = a if a < b else b
                if tree[spot] == value:
                    break
                tree[spot] = value
                spot >>= 1

        while tree[1] < end:
            new, here = divmod(tree[1], width)
            gone = after[here]
            then, last = after[gone], before[here]
            ids[here], ids[gone], after[here] = new, -1, then
            put(gone, end)
            if then < n:
                before[then] = here
                put(here, pairs.get(new << 32 | ids[then], NONE) * width + here)
            else:
                put(here, end)
            if last >= 0:
                put(last, pairs.get(ids[last] << 32 | new, NONE) * width + last)
        return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()

    def pieces(self, new: list[str]) -> dict[str, bytes]:
        groups: dict[int, list[tuple[str, bytes]]] = {}
        found: dict[str, bytes] = {}
        for p in new:
            b = p.encode("utf-8", "replace")
            if len(b) > TOGETHER:
                found[p] = self.alone(b)
            else:
                groups.setdefault(max(2, 1 << (len(b) - 1).bit_length()), []).append((p, b))
        for width, group in groups.items():
            for k in range(0, len(group), 1 << 14):
                part = group[k : k + (1 << 14)]
                found |= zip([p for p, _ in part], self.together([b for _, b in part], width))
        return found

    def _split(self, text: str):
        if len(text) <= SPAN:
            yield self.pattern.findall(text)
        else:  # lists of a bounded length; the matches are those of the whole text
            matches = (m.group() for m in self.pattern.finditer(text))
            while part := list(islice(matches, SPAN // 4)):
                yield part

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        wait: list[tuple[int, list[str]]] = []
        held = 0

        def flush() -> None:
            kept = self.kept
            new = set().union(*[part for _, part in wait]).difference(kept)
            more = self.pieces(list(new))
            long = {p: more[p] for p in new if len(p) > KEPT_BYTES}
            if len(kept) + len(more) > KEPT:
                kept.clear()
                more |= self.pieces(list({p for _, part in wait for p in part if p not in more}))
            kept |= more
            for k, part in wait:
                out[k].append(b"".join(map(kept.__getitem__, part)))
            for p in long:
                del kept[p]
            wait.clear()

        for k, text in enumerate(texts):
            for part in self._split(text):
                wait.append((k, part))
                held += len(part)
                if held > SPAN:
                    flush()
                    held = 0
        flush()
        return [b"".join(x) for x in out]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_built: dict[tuple[int, str], Tokenizer] = {}


def _tokenizer(ranks: bytes, pattern: str) -> Tokenizer:
    key = (hash(ranks), pattern)
    if key not in _built:
        _built.clear()
        _built[key] = Tokenizer(ranks, pattern)
    return _built[key]


def _column(spark: SparkSession, ranks_path: str, pattern: str, with_ids: bool):
    bounded(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    kind = "struct<n_tokens:long,ids_sha256:string,decoded_sha256:string" + (",ids:array<int>>" if with_ids else ">")

    @F.arrow_udf(kind)
    def bpe(texts: pa.Array) -> pa.Array:
        tokenizer = _tokenizer(ranks.value, pattern)
        n, ids_sha, decoded_sha, ids = [], [], [], []
        for part in slices(texts):
            for x in tokenizer.encode_all([b.decode("utf-8", "replace") for b in part]):
                n.append(len(x) // 4)
                ids_sha.append(hashlib.sha256(x).hexdigest())
                decoded_sha.append(hashlib.sha256(tokenizer.decode(x)).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(x, dtype="<i4"))
        names, kinds = ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()]
        columns = [n, ids_sha, decoded_sha]
        if with_ids:
            names, kinds, columns = [*names, "ids"], [*kinds, pa.list_(pa.int32())], [*columns, ids]
        return struct_array(names, columns, kinds)

    return bpe


def encode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """The rows with a column ``bpe``: n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids.

    Works on each row by itself: no shuffle, no row lost or repeated, whatever the other columns
    are (one of the name ``bpe`` is replaced). An empty table gives an empty table.
    """
    return docs.withColumn("bpe", _column(docs.sparkSession, ranks_path, pattern, with_ids)(utf8()))


def tokenized(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The rows' own columns, then n_tokens, ids_sha256, decoded_sha256 and ids; underscores precede names that the rows have."""
    name = unused("bpe", docs.columns)
    rows = docs.withColumn(name, _column(docs.sparkSession, ranks_path, pattern, True)(utf8()))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(name)[c].alias(unused(c, docs.columns)) for c in ("n_tokens", "ids_sha256", "decoded_sha256", "ids")])


def decode(rows: DataFrame, ids: str, ranks_path: str, pattern: str, out: str = "decoded") -> DataFrame:
    """The rows with the bytes that an array column of ids stands for; a null array stays null."""
    ranks = rows.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    @F.arrow_udf("binary")
    def back(column: pa.Array) -> pa.Array:
        tokenizer = _tokenizer(ranks.value, pattern)
        return pa.array([None if x is None else tokenizer.decode(np.array(x, dtype="<u4").tobytes()) for x in column.to_pylist()], type=pa.binary())

    return rows.withColumn(out, back(F.col(ids)))


def public_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), *public_ranks(), with_ids=False)
    return rows.select("doc_id", "bpe.*")


QUERIES = {"op5_bpe": op5_bpe}
SQL: dict[str, str] = {}

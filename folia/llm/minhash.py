"""Near-duplicates by b-bit MinHash.

A text's set is its distinct shingles of ``SHINGLE`` words. Of each of ``HASHES`` minima the low
two bits are kept, packed into longs; bands of ``ROWS`` whole minima give candidates. A
candidate's similarity is estimated by bit counts, corrected for lanes that agree by
chance, and those that may be similar are confirmed on the full sets.

Texts of equal sets are one node, so copies are never compared. In a band's bucket each node
is compared with the best-connected one, then, if the bucket still holds several components,
with a few others. Nodes of different components that are then left are compared with each
other if the bits allow it: as rows in buckets of up to FEW nodes, and within tasks in larger
ones. There a bucket is cut into tiles, each pair of tiles is a unit of bounded size, a pair of
nodes is settled in the first band it shares, and only links that join two components leave the
unit. So no pair that shares a bucket goes unsettled, and rows grow with nodes, not with pairs.
At a similarity of 0.8 a pair shares no bucket with a chance of (1 - 0.8**5)**32 = 3e-6, and is
estimated below MAYBE with one of 1e-5.

Null, empty and word-less texts have the empty set and are linked with nothing. Fewer words
than a shingle are one shingle. Texts are taken whole, however long. Rows without a doc_id are
never linked: component_id is null and they are kept. Rows that repeat a doc_id are one node for
each set, joined by the id. Of equal texts the least doc_id is kept (ties can't be). An empty
table gives an empty one; columns of any other names are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.llm.common import forget, lists, slices, stored, struct_type, table, utf8
from folia.llm.graph import components

BANDS, ROWS = 32, 5
#: Minima of a text; the first BANDS * ROWS make bands, all leave their low bits.
HASHES = 512
LANES = 32  # of two bits in a long
LONGS = HASHES // LANES
#: Candidates estimated below this are not confirmed; at 0.8 the estimate deviates by 0.021.
MAYBE = 0.71
#: Nodes of a bucket that the others meet before all of them do.
GUESTS = 4
#: Nodes of a bucket whose pairs are rows; of larger ones, nodes of a tile and bytes of its sets.
FEW, TILE, TILE_BYTES = 32, 4096, 32 << 20
#: Pairs of lanes compared at once in a unit.
BLOCK = 1 << 16
CHANCE = 0.25  # that lanes of two bits agree

_rng = np.random.default_rng(20)
_A = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) << 1 | 1)[:, None]
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]
_PLACES = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SHIFTS = 2 * np.arange(LANES, dtype=np.uint64)
#: Shingles hashed at once.
SPAN = 1 << 10


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def shingles(b: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text, A-Z lower-cased, words split at ASCII white space."""
    words = b.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), n)], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    h = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        h += w[k : n - size + 1 + k] * _PLACES[k]
    return np.unique(_mixed(h))


def minima(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), SPAN):
        y = x[None, k : k + SPAN] * _A
        y += _B
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        np.minimum(least, y.min(axis=1), out=least)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """The minima's two low bits, in longs."""
    lanes = (least & np.uint32(3)).astype(np.uint64).reshape(LONGS, LANES)
    return np.bitwise_or.reduce(lanes << _SHIFTS, axis=1).view(np.int64)


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS)
    h = (rows * _PLACES[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _PLACES[8]
    return _mixed(h).view(np.int64)


def _signature(size: int):
    kind = struct_type(n=T.LongType(), d1=T.LongType(), d2=T.LongType(), bands=T.ArrayType(T.LongType()), bits=T.ArrayType(T.LongType()))

    @F.arrow_udf(kind)
    def signature(texts: pa.Array) -> pa.Array:
        # Straight into arrays: Python objects of a whole batch would take many times their bytes.
        n = len(texts)
        head, bands, bits = np.zeros((3, n), np.int64), np.empty((n, BANDS), np.int64), np.empty((n, LONGS), np.int64)
        at = 0
        for part in slices(texts):
            for b in part:
                s = shingles(b, size)
                head[:, at] = len(s), *np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                if len(s):
                    least = minima(s)
                    bands[at], bits[at] = band_keys(least), packed(least)
                at += 1
        some = head[0] > 0
        columns = [*map(pa.array, head), lists(bands[some], some), lists(bits[some], some)]
        return pa.StructArray.from_arrays(columns, names=["n", "d1", "d2", "bands", "bits"])

    return signature


def _sets(size: int):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def sets(texts: pa.Array) -> pa.Array:
        found = [shingles(b, size).view(np.int64) for part in slices(texts) for b in part]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))

    return sets


def estimate(a: Column, b: Column) -> Column:
    """Similarity by the lanes that agree, corrected for agreement by chance."""
    differ = F.lit(0)
    for k in range(LONGS):
        x = a[k].bitwiseXOR(b[k])
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return ((1 - differ / HASHES) - CHANCE) / (1 - CHANCE)


def _confirmed(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those of ``percent`` similarity on full sets, as edges. nodes: (id, bits, s)."""
    left, right = nodes.select(F.col("id").alias("a"), F.col("bits").alias("bits_a")), nodes.select(F.col("id").alias("b"), F.col("bits").alias("bits_b"))
    likely = pairs.join(left, "a").join(right, "b").filter(estimate(F.col("bits_a"), F.col("bits_b")) >= MAYBE).select("a", "b").distinct()
    met = likely.join(nodes.select(F.col("id").alias("a"), "s"), "a").join(nodes.select(F.col("id").alias("b"), F.col("s").alias("t")), "b")
    common = F.size(F.array_intersect("s", "t"))
    alike = common * 100 >= (F.size("s") + F.size("t") - common) * percent
    return met.filter(alike & (common > 0)).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _placed(members: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components of the edges, rows (key, id, c) of the buckets that hold several components)."""
    found = stored(components(edges), "components")
    rows = members.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    mixed = rows.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low != high").select("key")
    return found, stored(rows.join(mixed, "key"), "mixed")


def _candidates(bits: np.ndarray, bands: np.ndarray, c: np.ndarray, side: np.ndarray, band: int) -> np.ndarray:
    """(a, b) of a unit's rows: of different components and, if there are two, tiles, similar by their bits, and sharing no earlier band."""
    names, own = np.unique(c, return_inverse=True)
    most = np.bincount(own).argmax()
    rest = np.nonzero(own != most)[0]  # the largest component is compared with the others, not with itself
    two = side.min() != side.max()
    place = np.full(len(c), -1)
    place[rest] = np.arange(len(rest))
    lanes = bits.view(np.uint64)
    differ_most = HASHES * (1 - CHANCE) * (1 - MAYBE)
    found, step = [], max(1, BLOCK // len(c))
    for k in range(0, len(rest), step):
        a = rest[k : k + step]
        differ = np.zeros((len(a), len(c)), np.uint16)
        for j in range(LONGS):
            x = lanes[a, j, None] ^ lanes[None, :, j]
            x |= x >> np.uint64(1)
            x &= np.uint64(0x5555555555555555)
            differ += np.bitwise_count(x)
        i, b = np.nonzero((differ <= differ_most) & (own[a][:, None] != own))
        i = a[i]
        keep = (place[b] < 0) | (i < b)  # each pair once
        if two:
            keep &= side[i] != side[b]
        i, b = i[keep], b[keep]
        keep = (bands[i] == bands[b]).argmax(axis=1) == band
        found.append(np.stack([i[keep], b[keep]]))
    return np.concatenate(found, axis=1).T if found else np.empty((0, 2), np.int64)


def _settled(percent: int):
    def settled(rows: pa.Table) -> pa.Table:
        """Links of a unit's nodes, as few as join the components that are linked."""
        columns = [rows.column(k).combine_chunks() for k in ("id", "c", "tile", "bits", "bands", "s")]
        columns = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in columns]
        ids, c, side = (x.to_numpy(zero_copy_only=False) for x in columns[:3])
        bits, bands = (pc.list_flatten(x).to_numpy().reshape(len(ids), -1) for x in columns[3:5])
        ends, values = np.cumsum([0, *pc.list_value_length(columns[5]).to_pylist()]), pc.list_flatten(columns[5]).to_numpy().view(np.uint64)
        up = {x: x for x in c.tolist()}

        def root(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        band = int(np.nonzero(bands[0] == rows.column("key")[0].as_py())[0][0])
        links = []
        for i, j in _candidates(bits, bands, c, side, band).tolist():
            x, y = root(int(c[i])), root(int(c[j]))
            if x == y:
                continue
            s, t = values[ends[i] : ends[i + 1]], values[ends[j] : ends[j + 1]]
            if len(s) > len(t):
                s, t = t, s
            common = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
            if common and common * 100 >= (len(s) + len(t) - common) * percent:
                up[max(x, y)] = min(x, y)
                links.append((i, j))
        at = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"u": pa.array(ids[at[:, 0]], pa.int64()), "v": pa.array(ids[at[:, 1]], pa.int64())})

    return settled


def _apart(mixed: DataFrame, nodes: DataFrame, bands: DataFrame, percent: int) -> DataFrame:
    """Links between the components that buckets (key, id, c) still hold."""
    sizes = mixed.join(nodes.select("id", F.size("s").alias("length")), "id").groupBy("key").agg(
        F.count("*").alias("n"), F.ceil(F.greatest(F.count("*") / TILE, F.sum("length") * 8 / TILE_BYTES)).cast("int").alias("tiles")
    )
    mixed = stored(mixed.join(sizes, "key"), "apart")
    few = mixed.filter(F.col("n") <= FEW)
    left, right = few.select("key", F.col("id").alias("a"), F.col("c").alias("ca")), few.select("key", F.col("id").alias("b"), F.col("c").alias("cb"))
    pairs = left.join(right, "key").filter(F.col("ca") < F.col("cb")).select("a", "b").distinct()
    tile = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    many = mixed.filter(F.col("n") > FEW).withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    many = many.select("key", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "id", "c", "tile")
    units = many.join(nodes, "id").join(bands, "id").groupBy("key", "low", "high").applyInArrow(_settled(percent), "u long, v long")
    return _confirmed(pairs, nodes, percent).unionByName(units)


def near_duplicates(docs: DataFrame, text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row; size: words of a shingle, percent: least similarity of a link."""
    docs = docs.select("doc_id", F.col(text).alias("text"))
    all_rows = stored(docs.select("doc_id", _signature(size)(utf8()).alias("g")).select("doc_id", "g.*"), "signatures")
    rows = all_rows.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    reps = rows.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"))
    own = rows.withColumnRenamed("doc_id", "id").join(reps, ["d1", "d2", "id"], "left_semi")
    keys = own.select("id", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n")).filter("least != most").select("key", "n")
    members = stored(keys.join(buckets, "key"), "members")
    degrees = members.groupBy("id").agg(F.sum("n").alias("degree"))
    # Full sets of the texts that share a bucket with another.
    sets = docs.join(degrees.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), _sets(size)(utf8()).alias("s"))
    nodes = stored(sets.join(own.select("id", "bits"), "id"), "sets")
    # Each node meets its bucket's best-connected one, which is likely the text that others are copies of.
    met = members.join(degrees, "id")
    leaders = met.groupBy("key").agg(F.max(F.struct("degree", -F.col("id"))).alias("m")).select("key", (-F.col("m.col2")).alias("a"))
    stars = members.join(leaders, "key").filter("id != a").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
    edges = stored(_confirmed(stars, nodes, percent), "links")
    _, mixed = _placed(members.select("key", "id"), edges)
    # Where a bucket still holds several components, each node meets a few others at random ...
    some = mixed.groupBy("key").agg(*[F.min(F.struct(F.xxhash64("id", F.lit(k)), "id", "c")).alias(f"m{k}") for k in range(GUESTS)])
    some = some.select("key", F.explode(F.array(*[F.struct(F.col(f"m{k}.id").alias("a"), F.col(f"m{k}.c").alias("ca")) for k in range(GUESTS)])).alias("m"))
    some = some.select("key", "m.*").distinct()
    guests = mixed.join(some, "key").filter("c != ca").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
    first, edges = edges, stored(edges.unionByName(_confirmed(guests, nodes, percent)), "links")
    before, (found, mixed) = mixed, _placed(mixed.select("key", "id"), edges)
    forget(first, before, members)
    # ... and then, where components are left apart, all nodes of other components that the bits allow.
    more = stored(_apart(mixed, nodes, own.select("id", "bands"), percent), "links")
    if not more.isEmpty():
        found = stored(components(edges.unionByName(more)), "components")
    forget(nodes, edges, mixed, more)
    of_set = reps.join(found.withColumnRenamed("node", "id"), "id", "left").select("d1", "d2", F.coalesce("component", "id").alias("c"))
    # Rows that are linked with nothing, of which any number may be alike, stay out of the join.
    linked = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    result = all_rows.filter(linked).select("doc_id", "n", "d1", "d2").join(of_set, ["d1", "d2"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))
    alone = all_rows.filter(~linked).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return result.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of which each group of near-duplicates keeps the one with the least doc_id."""
    gone = near_duplicates(docs, size=size, percent=percent).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


QUERIES = {"op2_minhash": op2_minhash}
SQL: dict[str, str] = {}

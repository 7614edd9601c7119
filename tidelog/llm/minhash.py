"""Near-duplicate documents by b-bit MinHash over word shingles, with every link confirmed on the full shingle sets.

1. One pass over the texts makes 240 minima per document; five at a time give 48 band keys, the only wide thing that leaves
   Python, 400 bytes a document.
2. Documents with equal shingle sets (a 128-bit digest) are one *class*; all later work is on classes, so thousands
   of copies are one row.
3. Classes that share a band key with another are candidates. For these alone a second pass makes the packed signature (two
   mixed bits of 768 minima) and the full set. A bitmap of bounded size says which texts to look at.
4. Each bucket has a hub, its class that shares buckets with most others. A class is at *home* with the one hub it shares most
   bands with. Homes are compared in parts of bounded size, the hub in every part: bit counts of two packed signatures
   give the share of equal bit pairs, and ``(share - 1/4) / (1 - 1/4)`` estimates the similarity without the
   chance collisions; pairs that may reach the threshold by this and by their set sizes are decided on the full sets at once.
   A part gives a star for each component of its links, fewer rows than it has members. These make components over all.
5. What still holds several components is compared across them: homes of many parts, and buckets of several homes. First by
   estimate; a member that may have a link goes on, once, and full sets decide among those, again giving stars. Pairs inside a
   component cannot change the result, so no link that matters is left out.

All steps but 5 are linear in the rows. Step 5 reads a group of n classes that are alike but *below* the threshold in n / BLOCK copies.

A pair at similarity 0.8 shares no band with probability 5e-9, and its estimate is off by more than the margin (over
5.8 standard errors of 0.0172, whatever the sizes of the sets) with 4e-9.

Results by case: null and empty texts, or texts of white space only, have no shingles and are linked with nothing;
a text with fewer words than a shingle is one shingle; repeated rows are copies of each other, also under one
doc_id; a null doc_id takes part and never names a component unless all members are null; an empty table gives an
empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, bitmap, filtered, fresh, pick, slices
from .components import components

PERMS, BANDS, ROWS, BITS = 768, 48, 5, 2
WORDS = PERMS * BITS // 64
#: How far below the threshold an estimate may be for the pair to be decided on full sets.
SLACK = 0.1
#: A class is at home with a hub of at least so many common bands; what this misses is left to the comparison across homes.
HUB_BANDS = 3
#: Members of a part of a home, and of one side of a block across components; and shingles of either, in the mean.
HOME, BLOCK, ITEMS = 256, 512, 1 << 21

_SIG_SCHEMA = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("keys", pa.list_(pa.int64()))])
_SIG_DDL = "doc_id long, digest binary, n_shingles long, cls binary, keys array<long>"
_SET_SCHEMA = pa.schema([("cls", pa.binary()), ("n_shingles", pa.int64()), ("sig", pa.binary()), ("keys", pa.binary()), ("items", pa.list_(pa.int64()))])
_SET_DDL = "cls binary, n_shingles long, sig binary, keys binary, items array<long>"


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; works in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _mix32(x: np.ndarray) -> np.ndarray:
    """A 32-bit finalizer; works in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text: ASCII lower case, words between white space."""
    words = [(t or b"").lower().split() for t in texts]
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(w) for ws in words for w in ws), np.uint64, sum(map(len, words)))
    n = max(0, len(hashes) - size + 1)
    rolled = np.full(n, size, np.uint64)
    for j in range(size):
        rolled = _mix(rolled + hashes[j : n + j])
    out, at = [], 0
    for ws in words:
        count = len(ws)
        if count >= size:
            out.append(np.unique(rolled[at : at + count - size + 1]))
        elif count:
            one = np.full(1, count, np.uint64)
            for j in range(count):
                one = _mix(one + hashes[at + j : at + j + 1])
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
        at += count
    return out


_RNG = np.random.default_rng(20)
_A = (_RNG.integers(0, 1 << 31, PERMS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, PERMS, dtype=np.uint64).astype(np.uint32)


def minima(items: np.ndarray, count: int = PERMS) -> np.ndarray:
    """The first ``count`` minima of a set, in blocks, so that memory does not follow the text's length."""
    low = np.full(count, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(items), 256):
        x = (items[i : i + 256] >> np.uint64(32)).astype(np.uint32)[:, None] * _A[:count]
        x += _B[:count]
        np.minimum(low, x.min(axis=0), out=low)
    return low


def pack(low: np.ndarray) -> np.ndarray:
    """(documents, PERMS) minima to (documents, WORDS) unsigned longs of two bits each of the mixed minima.

    The low bits of ``a * x + b`` itself follow from those of x, the same for all permutations, so they do not average out.
    """
    two = (_mix32(low.copy()) & np.uint32(3)).astype(np.uint8)
    return np.ascontiguousarray(two[:, 0::4] | (two[:, 1::4] << 2) | (two[:, 2::4] << 4) | (two[:, 3::4] << 6)).view(np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected estimates from packed signatures, whose last axis is WORDS; the others broadcast."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x &= np.uint64(0x5555555555555555)
    equal = 1 - np.bitwise_count(x).sum(axis=-1, dtype=np.int64) / PERMS
    chance = 1 / (1 << BITS)
    return (equal - chance) / (1 - chance)


def band_keys(low: np.ndarray) -> np.ndarray:
    """(documents, PERMS) minima to (documents, BANDS) keys."""
    groups = low[:, : BANDS * ROWS].reshape(len(low), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(40), groups.shape[:2]).copy()
    for j in range(ROWS):
        key = _mix(key + groups[:, :, j])
    return key.view(np.int64)


def class_of(items: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None


def signatures(rows: DataFrame, size: int) -> DataFrame:
    """doc_id, digest, n_shingles, class and band keys (none without shingles) of (doc_id, text, digest) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 20):
            sets = shingle_sets(batch.column(1).to_pylist(), size)
            full = [s for s in sets if len(s)]
            offsets = np.zeros(len(sets) + 1, np.int32)
            np.cumsum([BANDS if len(s) else 0 for s in sets], out=offsets[1:])
            flat = band_keys(np.stack([minima(s, BANDS * ROWS) for s in full])).reshape(-1) if full else np.empty(0, np.int64)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(class_of, sets), pa.binary()), keys], schema=_SIG_SCHEMA)

    return rows.selectExpr("doc_id", "CAST(text AS BINARY) AS text", "digest").mapInArrow(run, _SIG_DDL)


def full_sets(rows: DataFrame, size: int) -> DataFrame:
    """Class, size, packed signature, band keys and the sorted shingle hashes of the texts that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, 1 << 20):
            sets = [s for s in shingle_sets(batch.column(0).to_pylist(), size) if len(s)]
            if not sets:
                continue
            low = np.stack([minima(s) for s in sets])
            offsets = np.zeros(len(sets) + 1, np.int32)
            np.cumsum([len(s) for s in sets], out=offsets[1:])
            columns = [pa.array(map(class_of, sets), pa.binary()), pa.array(offsets[1:] - offsets[:-1], pa.int64())]
            columns += [pa.array([row.tobytes() for row in m], pa.binary()) for m in (pack(low), band_keys(low))]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))], schema=_SET_SCHEMA)

    return rows.selectExpr("CAST(text AS BINARY) AS text").mapInArrow(run, _SET_DDL)


class Blocks:
    """Partition function over rows that lie block by block: ``work(table of one block)`` gives rows, if any.

    block: the columns that name a block; no more than one block and one batch are held at a time.
    """

    def __init__(self, block: list[str], work):
        self.block, self.work = block, work

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the block that has not ended
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in self.block), strict=True))
            start = 0
            for i in range(len(names)):
                if names[i] != last:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if held:
                        yield from self.work(pa.Table.from_batches(held).combine_chunks())
                    held, start, last = [], i, names[i]
            held.append(batch.slice(start))
        if held:
            yield from self.work(pa.Table.from_batches(held).combine_chunks())


class Forest:
    """Union-find over the members of a block."""

    def __init__(self, labels: list):
        first: dict = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels)]
        self.first = list(first.values())

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.root(j)] = self.root(i)

    def star(self) -> list[tuple[int, int]]:
        """What has been joined, as (root, member), one for each label but the root's."""
        return [(r, i) for i in self.first if (r := self.root(i)) != i]


def _signatures(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint64).reshape(-1, WORDS)


class Sets:
    """The sets of a block, numbered anew, so that one intersection is a look-up and a count."""

    def __init__(self, t: pa.Table):
        column = t["items"].combine_chunks()
        column = column if isinstance(column, pa.ListArray) else pa.concat_arrays(column.chunks)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        every, codes = np.unique(flat, return_inverse=True)
        ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))[:-1]
        self.codes = np.split(codes.astype(np.int32), ends)
        self.marks = np.zeros(len(every), bool)

    def linked(self, i: int, those: np.ndarray, threshold: int, forest: Forest) -> Iterator[int]:
        """Members of ``those`` that reach the threshold with ``i``; what has the same root by then is left out."""
        mine = self.codes[i]
        self.marks[mine] = True
        for j in those.tolist():
            if forest.root(i) != forest.root(j):
                other = self.codes[j]
                both = int(np.count_nonzero(self.marks[other]))
                if 100 * both >= threshold * (len(mine) + len(other) - both):
                    yield j
        self.marks[mine] = False


_PAIR = pa.schema([("a", pa.binary()), ("b", pa.binary())])
_PAIR_DDL = "a binary, b binary"


def _edges(found: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found, strict=True)], schema=_PAIR)


def at_home(threshold: int):
    """All pairs of a part of a home; its rows hold the hub first."""

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if t.num_rows < 2:
            return
        cls, n, sig, sets = t["cls"].to_pylist(), t["n_shingles"].to_numpy(), _signatures(t), Sets(t)
        forest = Forest(cls)
        for i in range(len(cls) - 1):
            fit = 100 * np.minimum(n[i], n[i + 1 :]) >= threshold * np.maximum(n[i], n[i + 1 :])
            fit &= similarity(sig[i][None, :], sig[i + 1 :]) >= threshold / 100 - SLACK
            for j in sets.linked(i, i + 1 + np.flatnonzero(fit), threshold, forest):
                forest.join(i, j)
        yield from _edges([(cls[i], cls[j]) for i, j in forest.star()])

    return work


_FLAG_DDL = "grp binary, sl int, sr int, left boolean, cls binary, comp binary, fam binary"
_FLAG = pa.schema([("grp", pa.binary()), ("sl", pa.int32()), ("sr", pa.int32()), ("left", pa.bool_()), ("cls", pa.binary()), ("comp", pa.binary()), ("fam", pa.binary())])


def may_link(threshold: int):
    """The members of a block that by estimate may be linked with one of the other side and another component.

    A pair counts in the first bucket that it shares only; not if both are of one home, unless the block is of a home (key is null).
    """

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        side = t["left"].to_numpy()
        ours, theirs = np.flatnonzero(side), np.flatnonzero(~side)
        if not len(ours) or not len(theirs):
            return
        n, sig, key = t["n_shingles"].to_numpy(), _signatures(t), t["key"][0].as_py()
        keys = np.frombuffer(b"".join(t["keys"].to_pylist()), np.int64).reshape(-1, BANDS)
        numbers: dict[bytes, int] = {}
        comp, fam, cls = (np.array([numbers.setdefault(x, len(numbers)) for x in t[c].to_pylist()]) for c in ("comp", "fam", "cls"))
        inner = t["inner"].to_numpy()
        flagged = np.zeros(t.num_rows, bool)
        for i in ours:
            fit = (comp[i] != comp[theirs]) & (100 * np.minimum(n[i], n[theirs]) >= threshold * np.maximum(n[i], n[theirs]))
            fit &= ~inner[theirs] | (cls[i] < cls[theirs])  # both on the left in some block: once a pair
            if key is not None:
                fit &= (fam[i] != fam[theirs]) & (fam[i] != cls[theirs]) & (cls[i] != fam[theirs])
            at = theirs[fit]
            at = at[similarity(sig[i][None, :], sig[at]) >= threshold / 100 - SLACK]
            if key is not None and len(at):
                same = keys[i] == keys[at]
                at = at[keys[i][np.argmax(same, axis=1)] == key]
            if len(at):
                flagged[i] = True
                flagged[at] = True
        if flagged.any():
            yield from t.filter(pa.array(flagged)).select(_FLAG.names).cast(_FLAG).to_batches()

    return work


def across(threshold: int):
    """Links of a block's left members with others of another component: one row less than the components that they join."""

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        side = t["left"].to_numpy()
        ours, theirs = np.flatnonzero(side), np.flatnonzero(~side)
        if not len(ours) or not len(theirs):
            return
        cls, n, sig, sets = t["cls"].to_pylist(), t["n_shingles"].to_numpy(), _signatures(t), Sets(t)
        forest = Forest(t["comp"].to_pylist())
        for i in ours.tolist():
            fit = 100 * np.minimum(n[i], n[theirs]) >= threshold * np.maximum(n[i], n[theirs])
            fit &= similarity(sig[i][None, :], sig[theirs]) >= threshold / 100 - SLACK
            for j in sets.linked(i, theirs[fit], threshold, forest):
                forest.join(i, j)
        yield from _edges([(cls[i], cls[j]) for i, j in forest.star()])

    return work


def in_blocks(rows: DataFrame, block: list[str], work, ddl: str, *inside: Column) -> DataFrame:
    """``work`` on every block of ``rows``, whose rows come in the order of ``inside``."""
    return rows.repartition(*block).sortWithinPartitions(*block, *inside).mapInArrow(Blocks(block, work), ddl)


def near_duplicates(df: DataFrame, *, shingle: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept (doc_id = component_id).

    Two documents are linked if 100 * intersection >= threshold * union of their sets of ``shingle`` words.
    """
    sigs, final = _grouped(pick(df, doc_id=id_col, text=text_col).withColumn("digest", F.lit(None).cast("binary")), shingle, threshold)
    out = sigs.select("doc_id", "n_shingles", "cls").join(final.select("cls", F.col("first.doc_id").alias("component_id"), F.lit(True).alias("known")), "cls", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _hash(column: str) -> Column:
    return F.xxhash64(F.col(column))


def _grouped(rows: DataFrame, shingle: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of (doc_id, text, digest) rows; and of each class that is not alone (cls, first, n_rows) of its component.

    first is the component's row (unnamed, doc_id, digest) that is smallest, null ids last; n_rows counts its rows.
    """
    keep = Scratch()
    rows = rows.selectExpr("CAST(doc_id AS LONG) AS doc_id", "CAST(text AS STRING) AS text", "digest")
    sigs = keep(signatures(rows, shingle), "signatures")
    classes = sigs.where("n_shingles > 0").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")).alias("first"), F.count("*").alias("n_rows"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    classes = keep(classes, "classes")
    bands = classes.select("cls", "n_shingles", F.explode("keys").alias("key"))
    shared = keep(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    members = filtered(bands, bitmap(shared.select("key")), F.col("key")).join(shared, "key")
    # a class in many and large buckets is central: it is the hub of its buckets
    degree = F.sum("n").over(Window.partitionBy("cls"))
    members = keep(members.select("key", "cls", "n_shingles", F.struct(degree.alias("degree"), _hash("cls").alias("h")).alias("rank")), "members")
    homes = keep(_homes(members), "homes")
    own, led = homes.where("NOT hub").select("cls", "fam", "part", "parts"), homes.where("hub").select("fam", "part", "cls", "hub")
    sets = keep(_candidate_sets(rows, classes, members, shingle).join(own, "cls", "left"), "sets")
    wide = ["cls", "n_shingles", "sig", "items"]
    hubs = led.join(filtered(sets.select(wide), bitmap(led.select(_hash("cls"))), _hash("cls")), "cls")
    there = sets.where("fam IS NOT NULL").select("fam", "part", F.lit(False).alias("hub"), *wide).union(hubs.select("fam", "part", "hub", *wide))
    inside = keep(in_blocks(there, ["fam", "part"], at_home(threshold), _PAIR_DDL, F.col("hub").desc()), "inside")
    roots = components(inside, keep)
    wider = keep(_across(members, sets, roots, threshold, keep), "across")
    ends = _labelled(_labelled(wider.select(F.col("a").alias("a_cls"), F.col("b").alias("b_cls")), roots, "a_cls", "a"), roots, "b_cls", "b")
    joined = components(ends.select("a", "b"), keep)
    named = keep(_labelled(_labelled(classes.select("cls", "first", "n_rows"), roots), joined, "comp", "whole").select("cls", "whole", "first", "n_rows"), "named")
    whole = named.groupBy("whole").agg(F.min("first").alias("first"), F.sum("n_rows").alias("n_rows")).where("n_rows > 1")
    final = keep(named.select("cls", "whole").join(keep(whole, "wholes"), "whole").select("cls", "first", "n_rows"), "final")
    keep.end(sigs, final)  # the result reads these two alone
    return sigs, final


def _candidate_sets(rows: DataFrame, classes: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """The full sets of classes that share a bucket, from one of their rows each.

    Texts whose id is surely none of these stay where they are and are not cut into words again.
    """
    those = members.select("cls").distinct()
    ids = those.join(classes.select("cls", F.xxhash64("first.doc_id").alias("h")), "cls").select("h")
    found = full_sets(filtered(rows, bitmap(ids), _hash("doc_id")).select("text"), shingle)
    found = filtered(found, bitmap(those.select(_hash("cls"))), _hash("cls"))
    one = found.groupBy("cls").agg(*(F.first(c).alias(c) for c in ("n_shingles", "sig", "keys", "items")))
    return one.join(those, "cls", "left_semi")


def _homes(members: DataFrame) -> DataFrame:
    """(fam, part, cls, hub): each class with the hub it shares most bands with, and the hub in every part of its home."""
    hubs = members.groupBy("key").agg(F.max(F.struct("rank", "cls")).alias("hub")).select("key", F.col("hub.cls").alias("fam"), F.col("hub.rank").alias("fam_rank"))
    common = members.join(hubs, "key").where("cls <> fam").groupBy("cls", "fam", "fam_rank", "n_shingles").agg(F.count("*").alias("n")).where(F.col("n") >= HUB_BANDS)
    best = common.groupBy("cls", "n_shingles").agg(F.max(F.struct("n", "fam_rank", "fam")).alias("best")).select("cls", "n_shingles", F.col("best.fam").alias("fam"))
    parts = F.ceil(F.greatest(F.count("*") / HOME, F.sum("n_shingles") / ITEMS)).cast("int")
    sizes = best.groupBy("fam").agg(parts.alias("parts"))
    own = best.join(sizes, "fam").select("fam", F.pmod(_hash("cls"), F.col("parts")).cast("int").alias("part"), "cls", F.lit(False).alias("hub"), "parts")
    led = sizes.select("fam", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("fam").alias("cls"), F.lit(True).alias("hub"), "parts")
    return own.union(led)


def _labelled(df: DataFrame, labels: DataFrame, column: str = "cls", label: str = "comp") -> DataFrame:
    """``df`` with the component of a node column; a node without links is its own component."""
    named = labels.select(F.col("node").alias(column), F.col("comp").alias(label))
    return df.join(named, column, "left").withColumn(label, F.coalesce(label, column))


def _across(members: DataFrame, sets: DataFrame, roots: DataFrame, threshold: int, keep: Scratch) -> DataFrame:
    """Links between components, as stars of each block."""
    at = sets.select("cls", "fam")
    buckets = _labelled(members.select("key", "cls", "n_shingles"), roots).join(at, "cls", "left").select(F.unhex(F.hex("key")).alias("grp"), "key", "cls", "comp", F.coalesce("fam", "cls").alias("fam"), "n_shingles")
    large = sets.where("parts > 1").select(F.col("fam").alias("grp"), F.lit(None).cast("long").alias("key"), "cls", "fam", "n_shingles")
    large = _labelled(large, roots).select("grp", "key", "cls", "comp", F.col("cls").alias("fam"), "n_shingles")
    rows = keep(buckets.union(large), "groups")

    def most(column: str) -> DataFrame:
        """Of each group the commonest value and how many rows have another one."""
        counts = rows.groupBy("grp", column).agg(F.count("*").alias("n"))
        found = counts.groupBy("grp").agg(F.max(F.struct("n", column)).alias("m"), F.sum("n").alias("rows"))
        return found.select("grp", F.col(f"m.{column}").alias(f"main_{column}"), (F.col("rows") - F.col("m.n")).alias(f"off_{column}"))

    mixed = most("comp").where("off_comp > 0").join(most("fam").where("off_fam > 0"), "grp")
    # every pair of different components and homes has a member outside the commonest component, and one outside the commonest home
    placed = rows.join(keep(mixed, "mixed"), "grp").withColumn("inner", F.when(F.col("off_comp") <= F.col("off_fam"), F.col("comp") != F.col("main_comp")).otherwise(F.col("fam") != F.col("main_fam")))
    placed = keep(placed.select("grp", "key", "cls", "comp", "fam", "n_shingles", "inner"), "placed")
    salts = lambda those: F.ceil(F.greatest(F.count(F.when(those, 1)) / BLOCK, F.sum(F.when(those, F.col("n_shingles"))) / ITEMS)).cast("int")
    sizes = placed.groupBy("grp").agg(salts(F.col("inner")).alias("lefts"), salts(F.lit(True)).alias("rights"))
    placed = placed.drop("n_shingles").join(sizes, "grp")
    salt = lambda n: F.pmod(_hash("cls"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["grp", "sl", "sr", "key", "left", "inner", "cls", "comp", "fam"]
    left = placed.where("inner").withColumn("sl", salt("lefts")).withColumn("sr", every("rights")).withColumn("left", F.lit(True)).select(columns)
    right = placed.withColumn("sr", salt("rights")).withColumn("sl", every("lefts")).withColumn("left", F.lit(False)).select(columns)
    block = ["grp", "sl", "sr"]
    narrow = sets.select("cls", "n_shingles", "sig", "keys")
    flagged = keep(in_blocks(left.union(right).join(narrow, "cls"), block, may_link(threshold), _FLAG_DDL), "flagged")
    wanted = filtered(sets.select("cls", "n_shingles", "sig", "items"), bitmap(flagged.select(_hash("cls"))), _hash("cls"))
    return in_blocks(flagged.join(wanted, "cls"), block, across(threshold), _PAIR_DDL)


def _digest(text: str) -> Column:
    """128 bits of a text's SHA-256."""
    return F.substring(F.unhex(F.sha2(F.col(text).cast("string").cast("binary"), 256)), 1, 16)


def keep_one(df: DataFrame, *, shingle: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all their columns, without near duplicates: of each group the row with the smallest id stays.

    A row is its id (null or not) and its text, so one id may stay with one text and go with another. Of several texts
    of a group under its smallest id the one with the smallest digest stays, of exactly equal rows any one. Rows without
    words all stay.
    """
    key, digest = F.col(f"`{id_col}`").cast("long"), _digest(f"`{text_col}`")
    keep = Scratch()
    sigs, final = _grouped(pick(df, doc_id=id_col, text=text_col).withColumn("digest", _digest("text")), shingle, threshold)
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    row_id, row_digest = fresh(df, "row_id"), fresh(df, "row_digest")
    found = sigs.where("cls IS NOT NULL").groupBy("cls", "doc_id", "digest").agg(F.count("*").alias("n")).join(final.select("cls", "first"), "cls")
    found = keep(found.select(F.col("doc_id").alias(row_id), F.col("digest").alias(row_digest), "n", stays.alias("stays")).where("NOT stays OR n > 1"), "found")

    named, hashed, word = bitmap(found.select(F.xxhash64(row_id, row_digest))), F.xxhash64(key, digest), fresh(df, "row_word")

    def at(those: DataFrame, how: str) -> DataFrame:
        """Texts that may be named move for an exact join; most are not and stay in place."""
        same = key.eqNullSafe(F.col(row_id)) & (F.when(F.col(word) != 0, digest) == F.col(row_digest))
        return filtered(df, named, hashed, keep=word).join(those, same, how).drop(word)

    rest = filtered(df, named, hashed, inside=False)
    gone, tied = (found.where(w).select(row_id, row_digest) for w in ("NOT stays", "stays"))
    if not tied.limit(1).count():
        return rest.union(at(gone, "left_anti"))
    return rest.union(at(gone.union(tied), "left_anti")).union(at(tied, "left_semi").dropDuplicates([id_col, text_col]))

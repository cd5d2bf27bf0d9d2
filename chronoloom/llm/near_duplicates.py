"""Near-duplicate records with small edits.

Order MinHash: each text gives `sketches` buckets. For each, the `length` occurrence-labelled words that come first in a
random order are taken and hashed in the order in which they stand in the text. The random order is weighted, so that rare
words come first more often than the words of a template (the weights come from counts over all texts). PLAIN further buckets
are plain MinHash of the word set, for texts of common words that differ in rare ones. Texts that
share a bucket and pass two lossless bounds (number of words, 64-bit map of the words) are candidates; these are verified by
banded alignment of their words, and where the order of words leaves that open, by exact comparison of the word sets.

Texts with equal word sets are one class from the start, so copies never meet in a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.components import connected_components
from chronoloom.session import materialize, shuffle_partitions

#: Buckets per text. With weighted similarity s of two texts a bucket agrees with a chance of about s**length.
SKETCHES = 24
#: Words per bucket: two already keep order, and a pair whose parts were moved still agrees half as often.
LENGTH = 2
#: Buckets per text by its different words alone, all of one weight and without order, and words of each: a pair at 0.8 agrees in one
#: with a chance of about a half. They meet pairs that differ in rare words only, or in how often words are repeated.
PLAIN, PLAIN_LENGTH = 12, 3
#: Texts of at least so many different words carry a map of 192 more bits: 64 are nearly all set for them.
LONG = 20
#: Texts with fewer different words are left out.
MIN_WORDS = 6
#: A bucket with more texts is compared in blocks of this many, each pair of blocks in a task of its own.
BLOCK = 20_000
#: Share of the classes by which such buckets are looked for beforehand, and how many are kept out of the shuffle by bucket at most;
#: those not foreseen are put off when they are met.
LOOK, FORESEEN = 0.01, 10_000
#: A word in more than one of so many texts has its weight looked up; the number of such words is at most COMMON times the
#: mean number of words of a text, whatever the number of texts. All rarer words weigh the most.
COMMON = 1000
#: Part of the longer text's words that the alignment may be off the diagonal: a pair that it can settle at 0.8 is not further off.
BAND = 0.2
#: Pairs aligned at a time.
PAIRS = 4096

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


# ---- texts and classes --------------------------------------------------------------------------------------------


def word_rows(texts: DataFrame) -> DataFrame:
    """(table_name, field, id, seq, wkey): hashes of the words a-z0-9 in text order, and a key of the word set."""
    words = F.regexp_extract_all(F.lower(F.col("text")), F.lit("([a-z0-9]+)"), F.lit(1))
    return (
        texts.select("table_name", "field", "id", words.alias("w"))
        .where(F.size("w") >= MIN_WORDS)
        .withColumn("s", F.array_sort(F.array_distinct("w")))
        .where(F.size("s") >= MIN_WORDS)
        .select("table_name", "field", "id", F.transform("w", lambda x: F.xxhash64(x)).alias("seq"), F.unhex(F.md5(F.concat_ws(" ", "s"))).alias("wkey"))
    )


def classes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes): members has a row per record with the class id cid; classes has cid, field and the words of one
    member (that of the smallest id)."""
    slim = materialize(rows, "words")
    own = slim.groupBy("table_name", "field", "wkey").agg(F.min_by("seq", "id").alias("seq"))
    classes = materialize(own.withColumn("cid", F.monotonically_increasing_id()), "classes")
    members = slim.select("table_name", "field", "id", "wkey").distinct().join(classes.select("table_name", "field", "wkey", "cid"), ["table_name", "field", "wkey"])
    return members.select("table_name", "field", "id", "cid"), classes


def word_weights(classes: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each field the common words (hashes, sorted) and their weights; every other word weighs 1. Bounded, see COMMON."""
    n = {(r["table_name"], r["field"]): r["n"] for r in classes.groupBy("table_name", "field").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = classes.select("table_name", "field", F.explode(F.array_distinct("seq")).alias("h")).groupBy("table_name", "field", "h").agg(F.count(F.lit(1)).alias("df"))
    limit = F.lit(None).cast("double")
    for (t, f), k in n.items():
        limit = F.when((F.col("table_name") == t) & (F.col("field") == f), F.lit(max(4.0, k / COMMON))).otherwise(limit)
    out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    common = counts.where(F.col("df") > limit).toPandas()
    for (t, f), k in n.items():
        own = common[(common.table_name == t) & (common.field == f)].sort_values("h")
        rare = np.log(max(2.0, k / max(4.0, k / COMMON)))
        w = np.maximum(0.01, np.log(np.maximum(1.0, k / own["df"].to_numpy(float))) / rare) ** 2
        out[f"{t}.{f}"] = (own["h"].to_numpy(np.int64), np.minimum(1.0, w).astype(np.float32))
    return out


# ---- sketches -----------------------------------------------------------------------------------------------------


def order_sketches(h: np.ndarray, offsets: np.ndarray, weights: np.ndarray, length: int = LENGTH, sketches: int = SKETCHES) -> np.ndarray:
    """Order MinHash of texts given as one flat array of word hashes: (texts, sketches) bucket keys."""
    n, lens = len(h), np.diff(offsets)
    owner = np.repeat(np.arange(len(lens)), lens)
    order = np.lexsort((np.arange(n), h, owner))
    same = np.zeros(n, bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    start = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = (np.arange(n) - start).astype(np.uint64)
    label = _mix(h.view(np.uint64) + occurrence * _M3)
    out = np.empty((len(lens), sketches), np.int64)
    heads = offsets[:-1]
    for i in range(sketches):
        seed = np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64)
        u = (_mix(label ^ seed) >> np.uint64(40)).astype(np.float32)
        value = -np.log((u + np.float32(0.5)) * np.float32(2.0**-24)) / weights
        picked = np.empty((len(lens), length), np.int64)
        for j in range(length):
            least = np.minimum.reduceat(value, heads)
            hit = np.flatnonzero(value == np.repeat(least, lens))
            _, first = np.unique(owner[hit], return_index=True)
            picked[:, j] = hit[first]
            value[picked[:, j]] = np.inf
        picked.sort(axis=1)
        key = np.full(len(lens), seed, np.uint64)
        for j in range(length):
            key = _mix(key * _M3 + label[picked[:, j]])
        out[:, i] = key.view(np.int64)
    return out


def plain_sketches(h: np.ndarray, offsets: np.ndarray, length: int = PLAIN_LENGTH, sketches: int = PLAIN) -> np.ndarray:
    """MinHash of the word sets of texts given as one flat array of word hashes: (texts, sketches) keys of the `length` least words."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    words, lens = h[once].view(np.uint64), np.bincount(owner[once], minlength=n)
    heads = np.cumsum(lens) - lens
    out = np.empty((n, sketches), np.int64)
    for i in range(sketches):
        seed = np.uint64((i + 1) * 0xD6E8FEB86659FD93 % 2**64)
        value = _mix(words ^ seed)
        key = np.full(n, seed, np.uint64)
        for j in range(length):
            least = np.minimum.reduceat(value, heads)
            key = _mix(key * _M3 + least)
            if j + 1 < length:
                value[value == np.repeat(least, lens)] = np.uint64(2**64 - 1)
        out[:, i] = key.view(np.int64)
    return out


def _bitmaps(h: np.ndarray, offsets: np.ndarray, n_words: np.ndarray) -> list[np.ndarray]:
    """The 64-bit map of each text's words, and the three words of the longer map (0 for short texts)."""
    x = _mix(h.view(np.uint64))
    out = [np.bitwise_or.reduceat(np.uint64(1) << (x & np.uint64(63)), offsets[:-1]).view(np.int64)]
    place = (x >> np.uint64(20)) % np.uint64(192)
    for i in range(3):
        bit = np.where(place // np.uint64(64) == i, np.uint64(1) << (place & np.uint64(63)), np.uint64(0))
        out.append(np.where(n_words >= LONG, np.bitwise_or.reduceat(bit, offsets[:-1]).view(np.int64), 0))
    return out


def _list_column(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def bucket_rows(classes: DataFrame, weights: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(bucket, cid, n_words and the maps) for every class and sketch."""
    shared = classes.sparkSession.sparkContext.broadcast(weights)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            h, offsets = _list_column(b.column("seq"))
            w = np.ones(len(h), np.float32)
            names = np.array(b.column("f").to_pylist())
            owner = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            salt = np.zeros(b.num_rows, np.uint64)
            for f in np.unique(names):
                known, value = shared.value.get(f, (np.zeros(0, np.int64), np.zeros(0, np.float32)))
                salt[names == f] = np.uint64(hash_text(f))
                mine = np.flatnonzero((names == f)[owner])
                if len(known):
                    at = np.minimum(np.searchsorted(known, h[mine]), len(known) - 1)
                    w[mine] = np.where(known[at] == h[mine], value[at], np.float32(1))
            keys = np.concatenate([order_sketches(h, offsets, w), plain_sketches(h, offsets)], axis=1)
            keys = _mix(keys.view(np.uint64) ^ salt[:, None]).view(np.int64)
            size = b.column("n").to_numpy()
            columns = [b.column("cid").to_numpy(), size.astype(np.int32), *_bitmaps(h, offsets, size)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *[pa.array(np.repeat(c, keys.shape[1])) for c in columns]], names=ROW)

    slim = classes.select("cid", F.concat_ws(".", "table_name", "field").alias("f"), "seq", F.size(F.array_distinct("seq")).alias("n"))
    return slim.mapInArrow(rows, ROW_SCHEMA)


def hash_text(s: str) -> int:
    x = 1469598103934665603
    for c in s.encode():
        x = (x ^ c) * 1099511628211 % 2**63
    return x


# ---- candidates ---------------------------------------------------------------------------------------------------


ROW = ["bucket", "cid", "n_words", "bits", "m0", "m1", "m2"]
ROW_SCHEMA = "bucket long, cid long, n_words int, bits long, m0 long, m1 long, m2 long"
PAIR_SCHEMA = "a long, b long, " + ROW_SCHEMA


def _columns(t: pa.Table) -> dict[str, np.ndarray]:
    return {c: t.column(c).to_numpy() for c in ROW}


def _close(r: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Both bounds of the word sets' similarity for rows i and j: sizes, and the least number of words that only one has."""
    n1, n2 = r["n_words"][i], r["n_words"][j]
    ok = np.minimum(n1, n2) >= threshold * np.maximum(n1, n2) - 1e-9
    most = (1 - threshold) / (1 + threshold) * (n1 + n2) + 1e-9
    ok &= np.bitwise_count((r["bits"][i] ^ r["bits"][j]).view(np.uint64)) <= most
    long = np.flatnonzero(ok & (n1 >= LONG) & (n2 >= LONG))
    if len(long):
        a, b = i[long], j[long]
        differ = sum(np.bitwise_count((r[m][a] ^ r[m][b]).view(np.uint64)).astype(np.int32) for m in ("m0", "m1", "m2"))
        ok[long] = differ <= most[long]
    return ok


def _runs_pairs(r: dict[str, np.ndarray], bucket: np.ndarray, threshold: float):
    """Pairs within runs of equal bucket, run by offset, so that memory follows the number of rows."""
    at, cid, d = np.arange(len(bucket)), r["cid"], 1
    while len(at):
        at = at[at + d < len(bucket)]
        at = at[bucket[at] == bucket[at + d]]
        keep = at[_close(r, at, at + d, threshold)]
        if len(keep):
            a, b = cid[keep], cid[keep + d]
            yield np.minimum(a, b), np.maximum(a, b)
        d += 1


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = [pa.nulls(len(a), pa.int32() if c == "n_words" else pa.int64()) for c in ROW]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *none], names=["a", "b", *ROW])


def crowded_buckets(buckets: DataFrame) -> list[int]:
    """Buckets that probably have more than BLOCK texts, from the buckets of a sample of LOOK of the classes; FORESEEN at most."""
    counts = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 0.5 * LOOK * BLOCK)
    return [r["bucket"] for r in counts.orderBy(F.desc("k"), "bucket").limit(FORESEEN).collect()]


def _one_column(df: DataFrame, values: list[int]) -> DataFrame:
    # FORESEEN numbers at most
    return F.broadcast(df.sparkSession.createDataFrame([(v,) for v in values], "bucket long"))


def candidate_pairs(buckets: DataFrame, threshold: float, crowded: list[int] | None = None) -> DataFrame:
    """Distinct pairs (a, b) of classes that share a bucket and pass the bounds. Buckets above BLOCK, the crowded ones without being
    brought together first, are put off whole and then compared by pairs of blocks; no row is dropped.
    """

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put_off(t: pa.Table) -> pa.RecordBatch:
            none = pa.nulls(t.num_rows, pa.int64())
            return pa.RecordBatch.from_arrays([none, none, *[t.column(c).combine_chunks() for c in ROW]], names=["a", "b", *ROW])

        def work(t: pa.Table):
            r = _columns(t)
            bucket = r["bucket"]
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            size = np.repeat(np.diff(edges), np.diff(edges))
            big = size > BLOCK
            if big.any():
                yield put_off(t.filter(pa.array(big)))
            some = (size > 1) & ~big
            for a, b in _runs_pairs({c: r[c][some] for c in ROW}, bucket[some], threshold):
                yield _pair_batch(a, b)

        rest, hot = None, None  # hot: the bucket whose rows go by, as it has more than a block
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if hot is not None and t.num_rows:
                own = int(np.searchsorted(t.column("bucket").to_numpy(), hot, "right"))
                if own:
                    yield put_off(t.slice(0, own))
                    t = t.slice(own)
                if t.num_rows:
                    hot = None
            if rest is not None:
                t = pa.concat_tables([rest, t])
            if not t.num_rows:
                rest = None
                continue
            bucket = t.column("bucket").to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1], "left"))
            rest = t.slice(cut)
            if cut:
                yield from work(t.slice(0, cut))
            if rest.num_rows > BLOCK:
                yield put_off(rest)
                rest, hot = None, bucket[-1]
        if rest is not None and rest.num_rows:
            yield from work(rest)

    spread = buckets if not crowded else buckets.join(_one_column(buckets, crowded), "bucket", "left_anti")
    sorted_rows = spread.repartition("bucket").sortWithinPartitions("bucket")
    first = sorted_rows.mapInArrow(within, PAIR_SCHEMA)
    if crowded:
        nothing = F.lit(None).cast("long")
        first = first.unionByName(buckets.join(_one_column(buckets, crowded), "bucket", "left_semi").select(nothing.alias("a"), nothing.alias("b"), *ROW))
    first = materialize(first, "candidates")
    pairs = first.where("bucket is null").select("a", "b")
    put_off = first.where("bucket is not null").select(*ROW)
    sizes = put_off.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"))
    if sizes.limit(1).count():
        blocks = put_off.join(sizes, "bucket").withColumn("nb", F.ceil(F.col("k") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("cid"), "nb").cast("int"))
        spread = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        spread = spread.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *ROW[1:])

        def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in groups_of(batches, ["bucket", "i", "j"]):
                r, own = _columns(t), t.column("own").to_numpy()
                i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
                if i == j:
                    for a, b in _runs_pairs(r, r["bucket"], threshold):
                        yield _pair_batch(a, b)
                    continue
                x, y, cid = np.flatnonzero(own == i), np.flatnonzero(own == j), r["cid"]
                for p in x:
                    q = y[_close(r, np.full(len(y), p), y, threshold)]
                    if len(q):
                        yield _pair_batch(np.minimum(cid[p], cid[q]), np.maximum(cid[p], cid[q]))

        many = spread.repartition(4 * shuffle_partitions(buckets.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        pairs = pairs.unionByName(many.mapInArrow(across, PAIR_SCHEMA).select("a", "b"))
    return pairs.distinct()


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows sorted by keys, each whole."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if not t.num_rows:
            continue
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            c = t.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(new)
        for lo, hi in zip(np.concatenate([[0], cuts[:-1]]), cuts, strict=True) if len(cuts) else ():
            yield t.slice(int(lo), int(hi - lo))
        rest = t.slice(int(cuts[-1])) if len(cuts) else t
    if rest is not None and rest.num_rows:
        yield rest


# ---- verification -------------------------------------------------------------------------------------------------


def aligned_distance(x: np.ndarray, xo: np.ndarray, y: np.ndarray, yo: np.ndarray) -> np.ndarray:
    """Edit distance of word sequences within a band around the diagonal (an upper bound outside of it), for many pairs at once."""
    lx, ly = np.diff(xo), np.diff(yo)
    n = len(lx)
    width, height = int(ly.max()), int(lx.max())
    band = int(max(2, np.ceil(BAND * max(width, height)), np.abs(lx - ly).max()))
    far = np.int32(1 << 20)
    pad_y = np.full((n, max(width, height) + 2 * band + 2), -1, np.int64)
    cols = np.arange(len(y)) - np.repeat(yo[:-1], ly) + band
    pad_y[np.repeat(np.arange(n), ly), cols] = y
    pad_x = np.full((n, height), -2, np.int64)
    pad_x[np.repeat(np.arange(n), lx), np.arange(len(x)) - np.repeat(xo[:-1], lx)] = x
    k = np.arange(2 * band + 1, dtype=np.int32)
    row = np.where((k - band >= 0)[None, :], (k - band)[None, :], far).astype(np.int32).repeat(n, axis=0)
    out = np.where(lx == 0, ly, 0).astype(np.int32)
    for i in range(1, height + 1):
        j = i + k - band
        match = pad_y[:, i - 1 : i + 2 * band] == pad_x[:, i - 1 : i]
        best = row + np.where(match, 0, 1).astype(np.int32)
        best[:, :-1] = np.minimum(best[:, :-1], row[:, 1:] + 1)
        best[:, j < 0] = far
        best[:, j == 0] = i
        row = np.minimum.accumulate(best - k, axis=1) + k
        row[:, j < 0] = far
        ended = np.flatnonzero(lx == i)
        if len(ended):
            out[ended] = row[ended, np.clip(ly[ended] - i + band, 0, 2 * band)]
    return out


def shared_words(x: np.ndarray, xo: np.ndarray, y: np.ndarray, yo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of sequences the number of different words they share and the number found in either."""
    n = len(xo) - 1
    owner = np.concatenate([np.repeat(np.arange(n), np.diff(xo)), np.repeat(np.arange(n), np.diff(yo))])
    h = np.concatenate([x, y])
    side = np.concatenate([np.zeros(len(x), np.int8), np.ones(len(y), np.int8)])
    order = np.lexsort((side, h, owner))
    o, h, side = owner[order], h[order], side[order]
    new = np.concatenate([[True], (o[1:] != o[:-1]) | (h[1:] != h[:-1])])
    group = np.cumsum(new) - 1
    sides = np.zeros(group[-1] + 1, np.int8)
    np.bitwise_or.at(sides, group, (side + 1).astype(np.int8))
    first = o[new]
    return np.bincount(first[sides == 3], minlength=n), np.bincount(first, minlength=n)


def _some(x: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """These rows of a flat list column."""
    size = np.diff(offsets)[rows]
    at = np.concatenate([[0], np.cumsum(size)])
    return x[np.repeat(offsets[rows] - at[:-1], size) + np.arange(at[-1])], at


def verified_pairs(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, settled, edit_similarity) of the candidate pairs whose word sets share at least the threshold.

    The banded alignment comes first: of the words that it matches, as many are different and shared as it matches more than a text
    repeats, and where these are enough the pair is settled. The others (words moved, or far off the diagonal) are settled by the exact
    word sets. settled tells by which: align or words.
    """
    seqs = classes.select("cid", "seq", F.size(F.array_distinct("seq")).alias("n"))
    both = pairs.join(seqs.withColumnsRenamed({"cid": "b", "seq": "y", "n": "m"}), "b").join(seqs.withColumnsRenamed({"cid": "a", "seq": "x"}), "a").select("a", "b", "x", "y", "n", "m")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            length = whole.column("x").value_lengths().to_numpy(zero_copy_only=False)
            ordered = whole.take(pa.array(np.argsort(length, kind="stable")))
            lo = 0
            while lo < ordered.num_rows:
                # long texts in smaller steps, so that the alignment's table stays small
                longest = max(1, int(ordered.column("x").slice(lo, PAIRS).value_lengths().to_numpy(zero_copy_only=False).max()))
                b = ordered.slice(lo, max(1, min(PAIRS, 4_000_000 // longest)))
                lo += b.num_rows
                x, xo = _list_column(b.column("x"))
                y, yo = _list_column(b.column("y"))
                lx, ly = np.diff(xo), np.diff(yo)
                distance = aligned_distance(x, xo, y, yo)
                longer = np.maximum(lx, ly)
                edit = 1 - np.minimum(distance, longer) / longer
                nx, ny = b.column("n").to_numpy(), b.column("m").to_numpy()
                least = longer - distance - np.minimum(lx - nx, ly - ny)
                aligned = least >= threshold * (nx + ny - least) - 1e-9
                ok = aligned.copy()
                if not aligned.all():
                    open_ = np.flatnonzero(~aligned)
                    shared, either = shared_words(*_some(x, xo, open_), *_some(y, yo, open_))
                    ok[open_] = shared >= threshold * either - 1e-9
                if ok.any():
                    keep = pa.array(ok)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("a").filter(keep), b.column("b").filter(keep), pa.array(np.where(aligned, "align", "words")[ok]), pa.array(edit[ok])],
                        names=["a", "b", "settled", "edit_similarity"],
                    )

    return both.mapInArrow(check, "a long, b long, settled string, edit_similarity double")


def near_duplicate_classes(texts: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, links) of texts (table_name, field, id, text): members maps records to classes of equal word sets, links are
    the pairs of classes that are at least `threshold` similar. Both are written tables.

    A record counts once per field however often it is delivered; should its copies differ, each text counts. Null and empty texts, and texts with fewer than 6 different
    words, are in neither. Other columns are ignored; empty input gives empty results.
    """
    members, classes = classes_of(word_rows(texts.where(F.col("id").isNotNull())))
    weights = word_weights(classes)
    crowded = crowded_buckets(bucket_rows(classes.where(F.pmod(F.xxhash64("cid"), F.lit(round(1 / LOOK))) == 0), weights))
    pairs = candidate_pairs(bucket_rows(classes, weights), threshold, crowded)
    return members, materialize(verified_pairs(pairs, classes, threshold), "links")


def near_duplicate_pairs(texts: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(table_name, field, id_a, id_b): every pair of records, id_a < id_b, whose word sets are at least `threshold` similar."""
    members, links = near_duplicate_classes(texts, threshold)
    m = materialize(members, "members")
    one = m.select(F.col("cid").alias("a"), F.col("id").alias("i"))
    two = m.select("table_name", "field", F.col("cid").alias("b"), F.col("id").alias("j"))
    across = links.select("a", "b").join(one, "a").join(two, "b")
    within = one.withColumnRenamed("a", "b").join(two, "b").where("i < j")
    cols = ["table_name", "field", F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")]
    return across.select(*cols).unionByName(within.select(*cols))


def near_duplicate_groups(texts: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row per record that has a near-duplicate: table_name, field, id, group_id (the smallest id of its group), n_records of
    the group, and n_links, the number of other records it is itself similar to. Copies are counted, not expanded."""
    members, links = near_duplicate_classes(texts, threshold)
    m = materialize(members, "members")
    size = m.groupBy("cid").agg(F.count(F.lit(1)).alias("n"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(size.withColumnRenamed("cid", "b"), "b").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "cid")
    parts = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("id").alias("cid"), "component")
    rows = (
        m.join(size, "cid")
        .join(degree, "cid", "left")
        .join(parts, "cid", "left")
        .withColumn("component", F.coalesce("component", "cid"))
        .withColumn("n_links", F.col("n") - 1 + F.coalesce("others", F.lit(0)))
        .where("n_links > 0")
    )
    groups = rows.groupBy("component").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n_records"))
    return rows.join(groups, "component").select("table_name", "field", "id", "group_id", "n_records", "n_links")


def stored_texts(nodes: DataFrame, patterns: DataFrame) -> DataFrame:
    """The texts of problem 4: content and summary of nodes, matched_line of detected patterns."""
    n = [nodes.select(F.lit("graph_nodes").alias("table_name"), F.lit(c).alias("field"), "id", F.col(c).alias("text")) for c in ("content", "summary")]
    p = patterns.select(F.lit("detected_patterns").alias("table_name"), F.lit("matched_line").alias("field"), F.col("pattern_id").alias("id"), F.col("matched_line").alias("text"))
    return n[0].unionByName(n[1]).unionByName(p)

"""N-gram Jaccard self-join by vertical partitioning of the global n-gram order.

Shingle sets are classes of equal sets, so copies cost one row. The global order is rare first. A set that may have a
partner must share one of its first n - ceil(t n) + 1 n-grams with it, so sets with too many n-grams of their own drop
out before any pair is formed. The sets that stay are cut by fixed pivots of that order into fragments; overlaps of
candidate pairs are counted fragment by fragment and summed for each pair.

Candidates come in two rounds, so that a group of near copies costs no quadratic number of pairs: first every set with
the list-mate it shares most rare n-grams with, then, once these links have joined sets into components, every pair
that shares a rare n-gram and still lies in two components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isofield.llm.common import Scratch, in_small_batches, named, unnamed
from isofield.llm.components import components
from isofield.llm.words import U, blocks, mixed, tidy, words

WIDTH = 5
NUMERATOR, DENOMINATOR = 75, 100
#: N-grams that one task orders by frequency; more n-grams make more tasks.
TOKENS_PER_PART = 2_500_000
LEAST_PARTS = 16
#: An n-gram of so many sets or more is hot: tasks send it to its sets at once, and no task gathers its list.
HOT_SETS = 200_000
#: Documents that hot n-grams are looked for in, at least; one in MOST_SPARSE at least is taken, so that a hot n-gram shows 16 times.
SAMPLE_SETS, MOST_SPARSE = 2_000, HOT_SETS // 16
#: Base of the bands of set sizes: linked sets lie in the same band or in neighbouring ones.
BAND = DENOMINATOR / NUMERATOR + 0.01
#: Candidate pairs are sent to every task only up to this many.
BROADCAST_PAIRS = 1_000_000
#: The global order is cut where document frequency passes these values.
PIVOTS = (2, 4, 16)
#: 64-bit words of a set's bitmap. A bit is the parity of the n-grams that hash to it, so two bitmaps differ in no more
#: bits than their sets differ in n-grams.
BITMAP = 16
TOKEN = pa.binary()


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each n-gram, n-gram hash, set size of each row, 64-bit key of each row's set).

    N-grams are distinct within a row and sorted by row and hash.
    """
    for first, n, data, offsets in blocks(column):
        row, _, _, value = words(data, offsets, lower=True)
        begin = np.searchsorted(row, np.arange(n + 1))
        count = np.diff(begin)
        m = len(row)
        roll = np.zeros(m, U)
        factors = [U(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(width)]
        for k in range(min(width, m)):
            roll[:m - k] += value[k:] * factors[k]
        full = np.zeros(m, bool)
        if m >= width:
            full[:m - width + 1] = row[width - 1:] == row[:m - width + 1]
        grams, rows = mixed(roll[full] + U(width)), row[full]
        brief = np.flatnonzero((count > 0) & (count < width))
        if len(brief):
            own = []
            for r in brief:
                v = value[begin[r]:begin[r + 1]]
                own.append(sum(int(x) * int(f) for x, f in zip(v, factors)) + len(v) & (1 << 64) - 1)
            grams = np.concatenate([grams, mixed(np.array(own, U))])
            rows = np.concatenate([rows, brief])
        order = np.lexsort((grams, rows))
        grams, rows = grams[order], rows[order]
        keep = np.ones(len(grams), bool)
        keep[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
        grams, rows = grams[keep], rows[keep]
        size = np.bincount(rows, minlength=n).astype(np.int64)
        total = np.zeros(len(grams) + 1, U)
        np.cumsum(mixed(grams + U(7)), out=total[1:])
        ends = np.cumsum(size)
        key = mixed(total[ends] - total[ends - size] + size.astype(U) * U(0xD6E8FEB86659FD93)).view(np.int64)
        yield first, n, rows, grams, size, key


def set_table(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, n, key) of docs(id, text): size and key of each document's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, _, _, size, key in shingle_sets(batch.column(1), width):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(size), pa.array(key)], names=["id", "n", "key"])

    return in_small_batches(docs).mapInArrow(tidy(run), "id long, n long, key long")


def _pack5(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack5(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _dealt(part: np.ndarray, key: np.ndarray, n: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """Elements grouped by part: (part, keys, sizes, counts, values...), each set once in a part. Sorted by part, then key run."""
    if not len(part):
        return
    new = np.ones(len(part), bool)
    new[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1])
    run = np.flatnonzero(new)
    count = np.diff(np.append(run, len(part)))
    edge = np.flatnonzero(np.append(True, part[run][1:] != part[run][:-1]))
    for lo, hi in zip(edge, np.append(edge[1:], len(run))):
        a, b = run[lo], run[hi] if hi < len(run) else len(part)
        yield (int(part[a]), key[run[lo:hi]], n[run[lo:hi]], count[lo:hi], *(v[a:b] for v in values))


def distinct_pairs(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of n-gram and set number, sorted, however many sets there are."""
    order = np.lexsort((at, grams))
    grams, at = grams[order], at[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (at[1:] != at[:-1])
    return grams[keep], at[keep]


def frequency_class(df: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(4 * np.log2(np.maximum(df, 1))), 255).astype(np.uint8)


def hot_grams(docs: DataFrame, n_sets: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of HOT_SETS sets or more, their frequency class), as a sample of documents tells, both sorted by n-gram.

    The sample serves the split of work and the order of n-grams alone: any order gives the same links.
    """
    rate = max(1, min(n_sets // SAMPLE_SETS, MOST_SPARSE))
    if n_sets < HOT_SETS:
        return np.zeros(0, U), np.zeros(0, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, rows, grams, _, key in shingle_sets(batch.column(0), width):
                yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(grams.view(np.int64))], names=["key", "gram"])

    counts = in_small_batches(docs.where(F.pmod(F.xxhash64("id"), F.lit(rate)) == 0).select("text")).mapInArrow(tidy(run), "key long, gram long").distinct() \
        .groupBy("gram").agg((F.count(F.lit(1)) * rate).alias("sets")).where(F.col("sets") >= HOT_SETS).toPandas()
    grams = counts["gram"].to_numpy(np.int64).view(U)
    order = np.argsort(grams)
    return grams[order], frequency_class(counts["sets"].to_numpy(float)[order])


def frequencies(docs: DataFrame, parts: int, width: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows (home, body): of each set, its n-grams that occur in other sets too, with their frequency class.

    N-grams are dealt by hash over parts, where their sets are counted; hot ones go straight to the homes of their sets,
    as rows of part -1 - home. Each task sends a set that it meets twice only once.
    """
    hot_gram, hot_class = hot

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for _, _, rows, grams, size, key in shingle_sets(batch.column(0), width):
                _, once = np.unique(key, return_index=True)
                fresh = np.zeros(len(key), bool)
                fresh[once] = True
                fresh &= ~np.isin(key, seen) & (size > 0)
                seen = np.concatenate([seen, key[fresh]])
                pick = fresh[rows]
                rows, grams = rows[pick], grams[pick]
                part = ((grams & U(0xFFFFFF)) % U(parts)).astype(np.int64)
                kinds = (pa.int32(), *[pa.binary()] * 5)
                if len(hot_gram):
                    at = np.minimum(np.searchsorted(hot_gram, grams), len(hot_gram) - 1)
                    warm = hot_gram[at] == grams
                    home = np.mod(key[rows[warm]], parts)
                    order = np.lexsort((rows[warm], home))
                    r, h, t, d = rows[warm][order], home[order], token_of(grams[warm], part[warm])[order], hot_class[at[warm]][order]
                    out = [(-1 - p, k.tobytes(), m.astype("<i4").tobytes(), c.astype("<i4").tobytes(), _pack6(t_), d_.tobytes())
                           for p, k, m, c, t_, d_ in _dealt(h, key[r], size[r], t, d)]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["part", "k", "n", "c", "g", "d"])
                    rows, grams, part = rows[~warm], grams[~warm], part[~warm]
                order = np.lexsort((rows, part))
                rows, grams, part = rows[order], grams[order], part[order]
                out = [(p, k.tobytes(), m.astype("<i4").tobytes(), c.astype("<i4").tobytes(), _pack5(g >> U(24)), None)
                       for p, k, m, c, g in _dealt(part, key[rows], size[rows], grams)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["part", "k", "n", "c", "g", "d"])

    def count(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        cat = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
        keys, sizes, counts = cat("k", np.int64), cat("n", "<i4"), cat("c", "<i4")
        names, kinds = ["home", "k", "n", "c", "t", "d"], (pa.int32(), *[pa.binary()] * 5)
        if part < 0:  # hot n-grams of the sets of one home, already with their class
            body = {n: table[c].to_pylist() for n, c in zip(names[1:], ("k", "n", "c", "g", "d"))}
            return pa.Table.from_arrays([pa.array([-1 - part] * len(table), pa.int32()), *[pa.array(x, pa.binary()) for x in body.values()]], names=names)
        grams = _unpack5(b"".join(table["g"].to_pylist()))
        sets, first, at = np.unique(keys, return_index=True, return_inverse=True)
        sizes = sizes[first]
        grams, at = distinct_pairs(grams, np.repeat(at, counts))
        new = np.append(True, grams[1:] != grams[:-1])
        df = np.diff(np.append(np.flatnonzero(new), len(grams)))[np.cumsum(new) - 1]
        shared = df > 1
        grams, at, df = grams[shared], at[shared], df[shared]
        home = np.mod(sets[at], parts)
        order = np.lexsort((at, home))
        grams, at, df, home = grams[order], at[order], df[order], home[order]
        out = [(p, k.tobytes(), m.astype("<i4").tobytes(), c.astype("<i4").tobytes(), _pack6(t), d.tobytes())
               for p, k, m, c, t, d in _dealt(home, sets[at], sizes[at], token_of(grams << U(24), np.int64(part)), frequency_class(df))]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, kinds)], names=names)

    return in_small_batches(docs.select("text")).mapInArrow(tidy(deal), "part int, k binary, n binary, c binary, g binary, d binary") \
        .groupBy("part").applyInArrow(count, "home int, k binary, n binary, c binary, t binary, d binary")


def token_of(grams: np.ndarray, part: np.ndarray) -> np.ndarray:
    """48 bits that name an n-gram: the upper 40 of its hash, and the last 8 of its part."""
    return (grams >> U(24) << U(8)) | (part & 0xFF).astype(U)


def _pack6(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack6(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<i8").ravel()


def fragments(shared: DataFrame) -> DataFrame:
    """Sets that can have a partner, cut by the pivots: (key, n, own, fragment, tokens, rare, bits).

    own counts the n-grams that no other set has; rare has the n-grams of the prefix and bits
    the bitmap of all shared n-grams, on the row of fragment 0 alone.
    """
    pivots = np.floor(4 * np.log2(np.array(PIVOTS))).astype(np.int64)

    def run(table: pa.Table) -> pa.Table:
        cat = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
        keys, sizes, counts, df = cat("k", np.int64), cat("n", "<i4"), cat("c", "<i4"), cat("d", np.uint8)
        tokens = _unpack6(b"".join(table["t"].to_pylist()))
        sets, first, at = np.unique(keys, return_index=True, return_inverse=True)
        n = sizes[first].astype(np.int64)
        at = np.repeat(at, counts)
        # A set that several tasks met has its hot n-grams from each of them.
        order = np.lexsort((tokens, at))
        order = order[np.append(True, (at[order][1:] != at[order][:-1]) | (tokens[order][1:] != tokens[order][:-1]))] if len(order) else order
        at, tokens, df = at[order], tokens[order], df[order]
        have = np.bincount(at, minlength=len(sets))
        prefix = n - -(-NUMERATOR * n // DENOMINATOR) + 1 - (n - have)
        keep = prefix[at] > 0
        at, tokens, df = at[keep], tokens[keep], df[keep]
        order = np.lexsort((tokens, df, at))
        at, tokens, df = at[order], tokens[order], df[order]
        begin = np.searchsorted(at, np.arange(len(sets) + 1))
        out: list[tuple] = []
        for i in np.flatnonzero(prefix > 0):
            own, d = tokens[begin[i]:begin[i + 1]], df[begin[i]:begin[i + 1]]
            spot = np.bitwise_xor.reduce((U(1) << (own.astype(U) & U(63)))[:, None] * (((own >> 6) % BITMAP)[:, None] == np.arange(BITMAP)), axis=0, dtype=U).view(np.int64)
            cuts = np.concatenate([[0], np.searchsorted(d, pivots, "right"), [len(d)]])
            for f in range(len(PIVOTS) + 1):
                part = np.sort(own[cuts[f]:cuts[f + 1]])
                if len(part) or not f:
                    packed = part.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                    out.append((int(sets[i]), int(n[i]), int(n[i] - have[i]), f, packed, own[:prefix[i]] if not f else None, spot if not f else None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 7, kinds)],
                                    names=["key", "n", "own", "fragment", "tokens", "rare", "bits"])

    return shared.groupBy("home").applyInArrow(run, "key long, n long, own long, fragment int, tokens binary, rare array<long>, bits array<long>")


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [len(np.intersect1d(_unpack6(x), _unpack6(y), assume_unique=True))
               for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "na", "nb")), pa.array(got, pa.int64())],
                                         names=["a", "b", "na", "nb", "partial"])


def links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose sets reach the threshold: partial overlaps of each fragment, summed for each pair.

    pairs is a written table. Fragments travel to their partner a, so that a set which leads many pairs is read once;
    pairs are sent to every task only if they are few.
    """
    few = F.broadcast if pairs.count() <= BROADCAST_PAIRS else (lambda df: df)
    cutted = sets.select("key", "n", "fragment", "tokens")
    x = cutted.join(few(pairs), F.col("b") == F.col("key")).select("a", "b", "fragment", F.col("n").alias("nb"), F.col("tokens").alias("x"))
    leads = cutted.join(few(pairs.select(F.col("a").alias("key")).distinct()), "key", "left_semi").withColumnRenamed("fragment", "g")
    both = x.join(leads, (F.col("a") == F.col("key")) & (F.col("fragment") == F.col("g"))) \
        .select("a", "b", F.col("n").alias("na"), "nb", "x", F.col("tokens").alias("y"))
    total = both.mapInArrow(_overlap, "a long, b long, na long, nb long, partial long") \
        .groupBy("a", "b", "na", "nb").agg(F.sum("partial").alias("common"))
    return total.where(F.lit(DENOMINATOR) * F.col("common") >= F.lit(NUMERATOR) * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def least_votes(na: Column, nb: Column) -> Column:
    """How many n-grams two linked sets have in common within their prefixes, at least.

    Beyond the prefix that ends first, the sets share at most what that set has left: ceil(t n) - 1 n-grams.
    """
    up = lambda x, by: F.ceil(x / F.lit(float(by)))
    most = F.greatest(up(F.lit(NUMERATOR) * na, DENOMINATOR), up(F.lit(NUMERATOR) * nb, DENOMINATOR)) - 1
    return F.greatest(F.lit(1), up(F.lit(NUMERATOR) * (na + nb), NUMERATOR + DENOMINATOR) - most)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row for each document: (id, n_shingles, component_id).

    Two documents link when 100 * |A & B| >= 75 * |A | B| for their sets of distinct five-word shingles (the whole
    sequence where there are fewer words). component_id is the smallest id that a document reaches by links. Null,
    empty and word-less texts have an empty set and link with nothing. Repeated rows are returned as often as they
    come. Only the two named columns are read. Shingles are told apart by 64-bit hashes within a document, by 48 bits
    between documents. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        sizes, moved = linked(docs, width, scratch)
        scratch.keep(sizes, moved)
    return sizes.join(moved, "key", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component_id"))


def linked(docs: DataFrame, width: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((id, n, key) of every document, (key, component) of the sets with copies or links)."""
    cut = scratch.cut
    sizes = cut(set_table(docs, width), "sets")
    classes = cut(sizes.where("n > 0").groupBy("key").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.count(F.lit(1)).alias("copies")), "classes")
    total, n_sets = classes.agg(F.sum("n"), F.count(F.lit(1))).first()
    parts = max(LEAST_PARTS, -(-int(total or 0) // TOKENS_PER_PART))
    sets = cut(fragments(frequencies(docs, parts, width, hot_grams(docs, n_sets, width))), "fragments")
    own = sets.where("fragment = 0")
    entries = cut(own.select("key", "n", "own", F.explode("rare").alias("token")), "rare")
    # First round: each set with the set that leads most of the lists it is in. A list is led by the set with the
    # smallest share of n-grams of its own, which in a group of near copies is the text that they were made from.
    lead = entries.groupBy("token").agg(F.min_by("key", F.struct(F.col("own") / F.col("n"), "key")).alias("hub"), F.count(F.lit(1)).alias("mates")).where("mates > 1")
    star = entries.join(lead, "token").where("hub <> key").groupBy("key", "hub").agg(F.count(F.lit(1)).alias("votes"))
    best = Window.partitionBy("key").orderBy(F.desc("votes"), "hub")
    first = cut(star.withColumn("place", F.row_number().over(best)).where("place = 1")
                .select(F.col("hub").alias("a"), F.col("key").alias("b")), "first")
    good = cut(links(first, sets), "good")
    comp = cut(components(good), "comp")
    # Second round: list-mates that still lie in two components.
    label = F.coalesce("component", "key").alias("component")
    apart_still = cut(entries.join(comp.withColumnRenamed("node", "key"), "key", "left").select("token", "key", "n", "own", label), "named")
    open_lists = apart_still.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    mates = apart_still.join(open_lists.select("token"), "token", "left_semi").join(own.select("key", "bits"), "key") \
        .withColumn("band", F.floor(F.log("n") / F.log(F.lit(BAND))).cast("int"))
    # Two linked sets differ in (n + m) / 7 n-grams at most, so one of them has no more than n / 7 of its own; sizes bound
    # each other too. Both hold before a pair is formed: l has few of its own, and its band is one of three of r.
    tight = F.lit(NUMERATOR + DENOMINATOR) * F.col("own") <= F.lit(DENOMINATOR - NUMERATOR) * F.col("n")
    l, r = mates.where(tight).alias("l"), mates.withColumn("tight", tight).withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).alias("r")
    apart = F.col("l.own") + F.col("r.own")
    for k in range(BITMAP):
        apart = apart + F.bit_count(F.get("l.bits", F.lit(k)).bitwiseXOR(F.get("r.bits", F.lit(k))))
    near = F.lit(NUMERATOR + DENOMINATOR) * apart <= F.lit(DENOMINATOR - NUMERATOR) * (F.col("l.n") + F.col("r.n"))
    once = ~F.col("r.tight") | (F.col("l.key") < F.col("r.key"))
    rest = (l.join(r, (F.col("l.token") == F.col("r.token")) & (F.col("l.band") == F.col("r.band")) & (F.col("l.component") != F.col("r.component")) & once & near)
            .groupBy(F.least("l.key", "r.key").alias("a"), F.greatest("l.key", "r.key").alias("b"))
            .agg(F.count(F.lit(1)).alias("votes"), F.min("l.n").alias("na"), F.min("r.n").alias("nb")).where(F.col("votes") >= least_votes(F.col("na"), F.col("nb"))).select("a", "b"))
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = cut(links(cut(rest.join(tried, ["a", "b"], "left_anti"), "rest"), sets), "second")
    # Labels become document ids; the smallest id of a class stands for it.
    reps = classes.select("key", "rep")
    ids = good.unionByName(second).join(reps.withColumnRenamed("rep", "ra"), F.col("a") == F.col("key")).drop("key") \
        .join(reps.withColumnRenamed("rep", "rb"), F.col("b") == F.col("key")).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    final = cut(components(ids), "final")
    # Only sets with copies or links need a look-up; the others are components of their own.
    moved = cut(classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").where("copies > 1 or component is not null")
                .select("key", F.coalesce("component", "rep").alias("component")), "moved")
    return sizes, moved


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """docs without near copies: of each component the document with the smallest id stays, in the columns of docs.

    Documents without words and those with a null id stay; of rows that repeat an id and a text one stays.
    """
    gone = join(docs, id_col, text_col, width).where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("id")).distinct()
    rows = named(docs, id=docs[f"`{id_col}`"].cast("long"), h1=F.xxhash64(docs[f"`{text_col}`"]), h2=F.hash(docs[f"`{text_col}`"]))
    left = rows.join(gone, "id", "left_anti")
    once = left.where("id is not null").dropDuplicates(["id", "h1", "h2"]).unionByName(left.where("id is null"))
    return unnamed(once, docs.columns)

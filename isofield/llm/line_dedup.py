"""Line deduplication over a corpus by a segment-partition edit join, in DataFrame functions alone.

A line goes when an equal line, or one within the edit threshold, comes earlier in the corpus (by document id, then by
line number). Lines of few words are sequences of characters, longer ones sequences of words. Sequences within k edits
share one of k + 1 even segments of the shorter one, at one of a few places that the lengths allow; these segments are
the index, the substrings at such places the probes. Pairs that meet are verified by a banded bit-parallel edit
distance: for each number of errors a bit vector over the 2k + 1 diagonals of the band.

A segment that very many lines share is split further: what two near lines have left without it is within k edits too,
so its own k + 1 segments refine the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isofield.llm.common import Scratch, named, unnamed

THRESHOLD = 1
#: Shorter lines say too little to be near others; only equal ones go.
MIN_CHARS = 20
#: Least words of a line, and the word edits that it may be away from another. Lines of fewer words are held by characters.
WORD_EDITS = ((10, 1), (20, 2))
#: Letters whose counts rule pairs out: an edit changes their sum of differences by two at most.
LETTERS = "etaoinsr"
#: Words are counted by hash in so many buckets of ten bits.
BUCKETS, BUCKET_BITS = 6, 10
#: Tables of line ids, and of keys alone, are sent to every task only up to this many rows.
BROADCAST_LINES, BROADCAST_KEYS = 500_000, 2_000_000
#: Keys with more lines are refined, so many times at most.
HOT, REFINEMENTS = 300, 3


def letter_counts(line: Column) -> Column:
    """Counts of eight letters, each modulo 128, in one number."""
    out = F.lit(0).cast("long")
    for k, letter in enumerate(LETTERS):
        count = F.length(line) - F.length(F.replace(line, F.lit(letter), F.lit("")))
        out = out.bitwiseOR(F.shiftleft(F.pmod(count, F.lit(128)).cast("long"), 7 * k))
    return out


def letter_gap(a: Column, b: Column) -> Column:
    """Sum of differences of letter counts."""
    out = F.lit(0)
    for k in range(len(LETTERS)):
        gap = F.abs(F.shiftright(a, 7 * k).bitwiseAND(F.lit(127)) - F.shiftright(b, 7 * k).bitwiseAND(F.lit(127)))
        out = out + F.least(gap, F.lit(128) - gap)
    return out


def word_counts(words: Column) -> Column:
    """Counts of words in a few buckets by hash, in one number; null for arrays that might overflow a bucket."""
    one = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), (F.pmod(F.xxhash64(w), F.lit(BUCKETS)) * BUCKET_BITS).cast("int"))
    return F.when(F.size(words) < (1 << BUCKET_BITS), F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s + one(w)))


def word_gap(a: Column, b: Column) -> Column:
    """Sum of differences of word counts; null where either is."""
    mask = F.lit((1 << BUCKET_BITS) - 1)
    out = F.lit(0)
    for k in range(BUCKETS):
        out = out + F.abs(F.shiftright(a, BUCKET_BITS * k).bitwiseAND(mask) - F.shiftright(b, BUCKET_BITS * k).bitwiseAND(mask))
    return out


def spots(k: int, gap: int) -> list[int]:
    """The index and probe rows of a sequence held against ones of gap symbols less, within k edits, each as one number.

    Errors left of a segment bound its shift by its number i, errors right of it by k - i.
    """
    out = []
    for i in range(k + 1):
        for shift in range(max(-i, gap - (k - i)), min(i, gap + (k - i)) + 1):
            out.append(k << 24 | gap << 16 | i << 8 | shift + 64 << 1 | int(gap > 0 or shift != 0))
    return out


def read_spot(spot: str, n: str) -> dict[str, str]:
    """SQL of what a spot says for a sequence of n symbols: k, gap, segment, start, length, and whether the row only asks."""
    k, gap, i, shift = f"shiftright({spot}, 24)", f"(shiftright({spot}, 16) & 255)", f"(shiftright({spot}, 8) & 255)", f"((shiftright({spot}, 1) & 127) - 64)"
    start, end = f"({i} * ({n} - {gap}) div ({k} + 1))", f"(({i} + 1) * ({n} - {gap}) div ({k} + 1))"
    return {"k": k, "gap": gap, "segment": i, "start": f"cast(greatest({start} + {shift}, 0) as int)", "length": f"cast({end} - {start} as int)", "asks": f"({spot} & 1)"}


def edits(n: str, by_words: str, threshold: int) -> str:
    """SQL of the edits that a line of n symbols may be away from a line that is no shorter."""
    steps = " ".join(f"when {n} >= {least} then {k}" for least, k in reversed(WORD_EDITS))
    return f"case when not {by_words} then {threshold} {steps} else 0 end"


def laid_out(n: str, by_words: str, threshold: int) -> str:
    """SQL of the array of spots of a line."""
    cases = [("not " + by_words, threshold, gap) for gap in range(threshold + 1)]
    for at, (least, k) in enumerate(WORD_EDITS):
        for gap in range(k + 1):
            below = f" and {n} - {gap} < {WORD_EDITS[at + 1][0]}" if at + 1 < len(WORD_EDITS) else ""
            cases.append((f"{by_words} and {n} - {gap} >= {least}{below}", k, gap))
    return "concat(" + ", ".join(f"if({c}, array({', '.join(map(str, spots(k, gap)))}), cast(array() as array<int>))" for c, k, gap in cases) + ")"


def key_of(symbols: str, spot: dict[str, str], *what: str) -> str:
    """SQL of an index or probe row's key."""
    return f"xxhash64({', '.join(what)}, {spot['segment']}, slice({symbols}, {spot['start']} + 1, {spot['length']}))"


def within(a: Column, b: Column, k: int) -> Column:
    """Whether two strings are within k edits of characters."""
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    return within_symbols(chars(a), chars(b), k)


def within_symbols(a: Column, b: Column, k: int) -> Column:
    """Whether two arrays are within k edits: bit d of state e says that diagonal d - k is reached with at most e errors."""
    bits = (1 << (2 * k + 1)) - 1
    start = F.array(*[F.lit(sum(1 << (k + j) for j in range(e + 1))).cast("long") for e in range(k + 1)])

    def reached(x: Column, y: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            match = F.lit(0).cast("long")
            for d in range(-k, k + 1):
                same = F.get(y, i + d) == F.get(x, i)
                match = match.bitwiseOR(F.when((i + d >= 0) & same, F.lit(1 << (k + d)).cast("long")).otherwise(F.lit(0).cast("long")))

            def levels(m: Column) -> Column:
                out = [F.get(state, F.lit(0)).bitwiseAND(m)]
                for e in range(1, k + 1):
                    less = F.get(state, F.lit(e - 1))
                    out.append(F.get(state, F.lit(e)).bitwiseAND(m).bitwiseOR(less).bitwiseOR(F.shiftright(less, 1))
                               .bitwiseOR(F.shiftleft(out[-1], 1).bitwiseAND(F.lit(bits).cast("long"))))
                return F.array(*out)

            return bound(match, levels)

        last = F.size(y) - F.size(x)
        done = F.aggregate(F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1)).otherwise(F.array().cast("array<int>")), start, step)
        bit = F.call_function("getbit", F.get(done, F.lit(k)), F.greatest(F.least(last, F.lit(k)), F.lit(-k)) + k)
        return (F.abs(last) <= k) & (bit == 1)

    return bound(F.struct(a.alias("x"), b.alias("y")), lambda p: reached(p["x"], p["y"]))


def bound(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines_of(docs: DataFrame) -> DataFrame:
    """(id, copy, place, line, line_id, twin) of each line of docs(id, text).

    copy tells texts under one id apart; line_id and twin are two hashes of the line, 96 bits together.
    """
    return docs.where("text is not null").select(
        "id", F.xxhash64("text").alias("copy"), F.posexplode(F.split("text", "\n", -1)).alias("place", "line")) \
        .withColumns({"line_id": F.xxhash64("line"), "twin": F.hash("line")})


def sized(table: DataFrame, bound: int = BROADCAST_LINES) -> DataFrame:
    """table, to be sent to every task if it is small; otherwise the join shuffles both sides."""
    return F.broadcast(table) if table.count() <= bound else table


def shared_keys(rows: DataFrame) -> DataFrame:
    """(key) of those that two lines have, one of them as an index row; counted before the shuffle, so a hot key costs little."""
    return rows.groupBy("key").agg(F.min("line_id").alias("lo"), F.max("line_id").alias("hi"), F.min("asks").alias("asks")) \
        .where("lo < hi and asks = 0").select("key")


def near_earlier(docs: DataFrame, threshold: int, min_chars: int, scratch: Scratch) -> DataFrame:
    """(line_id, twin) of lines with another, earlier line that is near."""
    lines = lines_of(docs).where(F.length("line") >= min_chars)
    by_words = f"(size(words) >= {WORD_EDITS[0][0]})"
    shaped = lines.withColumn("words", F.split("line", " ")) \
        .withColumn("symbols", F.expr(f"if({by_words}, words, split(line, ''))")).withColumn("n", F.size("symbols")).withColumn("by_words", F.expr(by_words))
    spot = read_spot("spot", "n")
    rows = scratch.cut(shaped.withColumn("spot", F.explode(F.expr(laid_out("n", "by_words", threshold))))
                       .select("line_id", "spot", F.expr(key_of("symbols", spot, "by_words", f"n - {spot['gap']}")).alias("key")), "rows") \
        .withColumn("asks", F.expr(spot["asks"]))
    keys = scratch.cut(shared_keys(rows), "keys")
    met = scratch.cut(rows.join(sized(keys, BROADCAST_KEYS), "key", "left_semi").select("key", "line_id", "spot", "asks").distinct(), "met")
    # Text, first place and counts of the lines that meet under a key, alone.
    wanted = scratch.cut(met.select("line_id").distinct(), "wanted")
    text = lines.join(sized(wanted), "line_id").groupBy("line_id", "twin").agg(F.min(F.struct("id", "place", "copy")).alias("seen"), F.min("line").alias("line")) \
        .withColumn("words", F.split("line", " ")).withColumn("by_words", F.expr(by_words)) \
        .withColumn("symbols", F.expr("if(by_words, words, split(line, ''))")).withColumn("n", F.size("symbols")) \
        .withColumn("sums", F.when(F.col("by_words"), word_counts(F.col("words"))).otherwise(letter_counts(F.col("line")))) \
        .select("line_id", "twin", "seen", "line", "n", "by_words", "sums")
    text = scratch.cut(text, "text")
    level = met.join(text.drop("line"), "line_id").select(
        "key", "asks", "line_id", "twin", "seen", "n", "by_words", "sums", *[F.expr(spot[c]).alias(c) for c in ("k", "gap", "start", "length")])
    level, near = scratch.cut(level, "level"), None
    own = ["line_id", "twin"]

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs with another line the lines that are near it; only now the text is fetched."""
        pairs = scratch.cut(pairs.distinct(), "pairs")
        few, theirs = sized(pairs), ["e_line_id", "e_twin"]
        x = text.select(*own, "by_words", F.col("line").alias("x")).join(few, own)
        y = text.select(F.col("line_id").alias("e_line_id"), F.col("twin").alias("e_twin"), F.col("line").alias("y")).join(few.drop("k"), theirs)
        both = x.join(y, [*own, *theirs]).withColumns({"a": F.expr("if(by_words, split(x, ' '), null)"), "b": F.expr("if(by_words, split(y, ' '), null)")})
        good = ~F.col("by_words") & within(F.col("x"), F.col("y"), threshold)
        for k in sorted({k for _, k in WORD_EDITS}):
            good = good | (F.col("by_words") & (F.col("k") == k) & within_symbols(F.col("a"), F.col("b"), k))
        return both.where(good).select(*own).distinct()

    def fitting(pairs: DataFrame) -> DataFrame:
        """Pairs of a line and an earlier one that lengths and counts of symbols leave."""
        k = F.expr(edits("least(n, e_n)", "by_words", threshold))
        gap = F.when(F.col("by_words"), word_gap(F.col("sums"), F.col("e_sums"))).otherwise(letter_gap(F.col("sums"), F.col("e_sums")))
        return pairs.where((F.col("e_seen") < F.col("seen")) & ((F.col("asks") == 0) | (F.col("e_asks") == 0)) & (F.abs(F.col("n") - F.col("e_n")) <= k)
                           & F.coalesce(gap <= 2 * k, F.lit(True))).select(*own, "e_line_id", "e_twin", k.alias("k"))

    for depth in range(REFINEMENTS + 1):
        # First against the earliest line under each key: a group of like lines costs one pair for each line.
        other = [F.col(c).alias("e_" + c) for c in ("asks", "seen", "n", "sums", "line_id", "twin")]
        heads = level.groupBy("key").agg(F.min_by(F.struct(*other), F.struct("seen", "asks")).alias("e"),
                                         F.approx_count_distinct("line_id").alias("many"), F.max("seen").alias("latest"))
        heads = scratch.cut(heads.where("e.e_seen < latest").select("key", "many", "e.*"), "heads")
        near_now = scratch.cut(verified(fitting(level.join(heads, "key"))), "first")
        near = near_now if near is None else scratch.cut(near.unionByName(near_now).distinct(), "near")
        # Then what is still undecided against all earlier lines under its keys, but for keys that are refined first.
        undecided = level.join(near, own, "left_anti")
        hot = scratch.cut(heads.where(F.col("many") > HOT).select("key"), "hot") if depth < REFINEMENTS else None
        more = hot is not None and bool(hot.take(1))
        if more:
            undecided = undecided.join(hot, "key", "left_anti")
        rest = undecided.join(level.select("key", *other), "key")
        near = scratch.cut(near.unionByName(verified(fitting(rest))).distinct(), "near")
        if not more:
            return near
        level = scratch.cut(refined(level.join(hot, "key", "left_semi"), text, threshold), "level")
    return near


def refined(level: DataFrame, text: DataFrame, threshold: int) -> DataFrame:
    """Rows of level under finer keys: the segments of what each sequence has left without the segments of its keys."""
    rest = F.expr("concat(slice(symbols, 1, start), slice(symbols, start + length + 1, size(symbols)))")
    if "rest" not in level.columns:
        level = level.join(text.select("line_id", "twin", F.expr("if(by_words, split(line, ' '), split(line, ''))").alias("symbols")), ["line_id", "twin"])
    else:
        level = level.withColumnRenamed("rest", "symbols")
    left = level.withColumn("rest", rest).withColumn("m", F.size("rest")).drop("symbols", "start", "length").withColumnRenamed("asks", "asked")
    edits_and_gaps = [(k, gap) for k in range(1, max(threshold, *(k for _, k in WORD_EDITS)) + 1) for gap in range(k + 1)]
    layout = " ".join(f"when k = {k} and gap = {gap} then array({', '.join(map(str, spots(k, gap)))})" for k, gap in edits_and_gaps)
    spot = read_spot("spot", "m")
    rows = left.withColumn("spot", F.explode(F.expr(f"case {layout} end"))).select(
        F.expr(key_of("rest", spot, "key")).alias("key"), F.greatest("asked", F.expr(spot["asks"])).alias("asks"), "line_id", "twin", "seen", "n", "by_words", "sums",
        "k", "gap", F.expr(spot["start"]).alias("start"), F.expr(spot["length"]).alias("length"), "rest")
    return rows.join(shared_keys(rows), "key", "left_semi")


def dropped(docs: DataFrame, threshold: int, min_chars: int | None) -> DataFrame:
    """(id, copy, places) of the lines that go from each text of docs(id, text)."""
    least = MIN_CHARS if min_chars is None else min_chars
    own = ["line_id", "twin"]
    with Scratch(docs.sparkSession) as scratch:
        near = near_earlier(docs, threshold, least, scratch)
        compared = F.length("line") >= least
        if min_chars is None:
            compared = compared | F.rlike("line", F.lit(r"\S"))
        lines = scratch.cut(lines_of(docs).where(compared).select("id", "copy", "place", *own), "lines")
        repeated = lines.groupBy(*own).agg(F.min(F.struct("id", "place", "copy")).alias("seen"), F.count(F.lit(1)).alias("n")) \
            .join(sized(near.withColumn("near", F.lit(True))), own, "left").where("n > 1 or near") \
            .select(*own, "seen", F.coalesce("near", F.lit(False)).alias("near"))
        repeated = scratch.cut(repeated, "repeated")
        gone = scratch.cut(lines.join(sized(repeated), own).where(F.col("near") | (F.struct("id", "place", "copy") != F.col("seen")))
                           .groupBy("id", "copy").agg(F.collect_set("place").alias("places")), "gone")
        scratch.keep(gone)
        return gone


def rebuilt(docs: DataFrame, id_col: str, text_col: str, threshold: int = THRESHOLD, min_chars: int | None = None) -> DataFrame:
    """(row, text, n_lines, n_dropped): docs in the struct column row, and the texts that are left."""
    gone = sized(dropped(docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text")), threshold, min_chars))
    rows = named(docs, id=id_col, old=text_col).withColumn("copy", F.xxhash64("old")).alias("d")
    lines = F.split("old", "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.array_contains(F.col("places"), i))
    joined = rows.join(gone.alias("g"), F.col("d.id").eqNullSafe(F.col("g.id")) & (F.col("d.copy") == F.col("g.copy")), "left")
    return joined.select("row", F.when(F.col("places").isNull(), F.col("old")).otherwise(F.array_join(kept, "\n")).alias("text"),
                         F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_chars: int | None = None) -> DataFrame:
    """docs in their own columns, whatever their names, with the texts that dedup() leaves."""
    return unnamed(rebuilt(docs, id_col, text_col, threshold, min_chars), docs.columns, **{text_col: F.col("text")})


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_chars: int | None = None) -> DataFrame:
    """(id, text, n_lines, n_dropped): every document with the lines that no earlier line is like.

    Lines are parted by newlines alone, words by single spaces. A line goes when an equal line comes earlier or, from
    MIN_CHARS characters on, a near one, whether that one stays or not. Lines of fewer than ten words are near within
    threshold edits of characters; lines of ten words and more are near within the edits of words that WORD_EDITS gives
    the shorter one. Ids are ordered with nulls first, lines by their number. Blank lines stay; with min_chars, all
    shorter lines do, and it is the bound of near lines as well. A text of dropped lines alone becomes empty; its
    document stays. Null texts stay null with no lines. Rows that repeat an id and a text are one document and come back
    as often as they came; other texts of the same id are ordered by a hash. Lines are told apart by 96 bits of hashes.
    Other columns are not read. An empty table gives an empty result.
    """
    rows = rebuilt(docs.select(id_col, text_col), id_col, text_col, threshold, min_chars)
    return rows.select(F.col("row").getField(id_col).alias(id_col), F.col("text").alias(text_col), "n_lines", "n_dropped")

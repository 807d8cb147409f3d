import bisect
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from isofield.llm import mixing, oracles, packing
from isofield.llm.words import tidy

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]


def test_pieces_hold_every_token_once_and_sequences_are_full(spark):
    rng = random.Random(1)
    odd = ["", None, " \n", "it's <|endoftext|>x DON'T ½ é ÀÉ ﬁ 你好 İ x\x1cy\x85z ''s 12a3 ß", "word " * 5000, "x" * 3000]
    docs = list(enumerate(odd)) + [(10 + k, " ".join(rng.choice(["alpha", "Beta,", "gamma.", "é", "42"]) for _ in range(rng.randint(1, 900)))) for k in range(80)] + [(10, "same"), (10, "same"), (None, "none")]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), PATH).collect()
    want = sorted((repr(i), k, at, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for i, t in docs for ids in [ids_of(t)] for k, at in enumerate(range(0, len(ids), 2048)) for p in [ids[at:at + 2048]])
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_whole_pieces_come_back_with_their_ids(spark):
    text = "alpha beta " * 3000
    parts = packing.pieces(spark.createDataFrame([(1, text, 2)], "doc_id long, text string, ids int"), PATH, with_ids=True).collect()
    assert [x for r in sorted(parts, key=lambda r: r.piece) for x in r.ids] == ids_of(text)


@pytest.mark.parametrize("seed", range(3))
def test_sum_of_squares_wastes_little(seed):
    lengths = np.sort(np.random.default_rng(seed).integers(1, 2048, 3000))[::-1]
    where, offset = packing.sum_of_squares(lengths, 2048)
    ends = np.zeros(where.max() + 1)
    np.maximum.at(ends, where, offset + lengths)
    assert ends.max() <= 2048 and (np.bincount(where, lengths) == ends).all()
    gaps: list[int] = []  # best fit in falling order; the sum of lengths alone is no bound that any packing reaches
    for size in lengths.tolist():
        k = bisect.bisect_left(gaps, size)
        left = gaps.pop(k) - size if k < len(gaps) else 2048 - size
        bisect.insort(gaps, left)
    assert len(ends) <= len(gaps) + 2


def fill(sizes, weights, epochs=3.0):
    total, clamped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in sizes if s not in clamped]
        level = (total - sum(epochs * sizes[s] for s in clamped)) / sum(weights[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weights[s] * level > epochs * sizes[s]}
        if not over:
            return {s: epochs * sizes[s] if s in clamped else weights[s] * level for s in sizes}
        clamped |= over


def test_mix_meets_its_targets(spark):
    rng = random.Random(2)
    docs = [(k, "w " * rng.randint(0, 60), rng.choice(["a", "a", "a", "b", "Z", "é", None])) for k in range(1500)]
    docs += [(2000, None, "b"), (2001, "", "void"), (2002, "tiny", "tiny"), (2003, "a b c", "Z"), (3, "w w", "a"), (3, "w w", "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumnRenamed("zz", "size")
    rows = mixing.mix(df).collect()
    assert len(rows) == len(docs)
    by = {i: s for i, _, s in docs}
    size = {}
    for r in rows:
        size[by[r.doc_id]] = size.get(by[r.doc_id], 0) + r["size"]
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want = fill(size, {s: k % 3 + 1 for k, s in enumerate(order)})
    taken = {}
    for r in rows:
        s = by[r.doc_id]
        taken[s] = taken.get(s, 0) + r.taken
        assert r.source_size == size[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 3 * r["size"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in size)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=repr)
    assert mixing.mix(df.limit(0)).count() == 0


def test_mix_equals_its_sql(spark):
    rng = random.Random(5)
    docs = [(k, "w " * rng.randint(0, 40), rng.choice(["hot", "hot", "b", "é", "Z", None])) for k in range(1200)]
    docs += [(None, "n w", "hot"), (None, None, "b"), (7, "w w w", "hot"), (7, "w w w", "hot"), (3000, "", "void"), (3001, "one", "tiny"), (3002, "x\x0by\u00a0z", "Z")]
    schema = "doc_id long, text string, source string"
    want = duckdb.connect()
    documents = pd.DataFrame(docs, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})  # noqa: F841, read by the SQL
    rows = want.execute(oracles.SQL["op10_source_mixing"]).fetchall()
    names = [c[0] for c in want.description]
    got = mixing.mix(spark.createDataFrame(docs, schema)).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows))
    assert sum(r.taken > r["size"] for r in got) and sum(0 < r.taken < r["size"] for r in got)


def test_repeated_documents_carry_the_words_taken(spark):
    docs = [(k, f"w{k} x y z", "abc"[k % 3], 5) for k in range(90)] + [(100, None, "a", 0), (101, "\n", "b", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, size int")
    rows = mixing.repeated(df).collect()
    taken = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    words = {}
    for r in rows:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {k: v for k, v in taken.items() if v}
    assert rows[0].__fields__ == ["doc_id", "text", "source", "size"]


def test_word_ids_are_the_same_after_a_drop():
    known = packing.WordIds(PATH)
    data, offsets = np.frombuffer(b"one two 33 one", np.uint8), np.array([0, 7, 14])
    before = known(data, offsets)
    known.drop()
    assert known.keys.nbytes + known.slot.nbytes + known.flat.nbytes + known.start.nbytes + known.length.nbytes == 0
    assert all((a == b).all() for a, b in zip(before, known(data, offsets)))


def test_a_finished_task_holds_no_words():
    known = packing.WordIds(PATH)
    data, offsets = np.frombuffer(b"one two", np.uint8), np.array([0, 7])
    seen = list(tidy(lambda batches: (known(data, offsets)[0].size for _ in batches), known.drop)(iter([0, 1])))
    assert len(seen) == 2 and known.count == 0 and not known.keys.nbytes


def test_texts_reach_python_in_small_batches_and_a_bound_of_ones_own_stays(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from isofield.llm import ngram_join, toxicity

    def spied(place):
        def tidy_(run, *_):
            def noted(batches):
                def seen():
                    for k, batch in enumerate(batches):
                        (place / f"{k}").write_text(str(batch.nbytes))
                        yield batch
                yield from run(seen())
            return noted
        return tidy_

    def most(session, name, module, run):
        place = tmp_path / name
        place.mkdir()
        monkeypatch.setattr(module, "tidy", spied(place))
        rows = run(session.range(0, 100, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 20_000).alias("text"))).count()
        return rows, max(int(p.read_text()) for p in place.iterdir())

    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    for name, module, run in (("packing", packing, lambda d: packing.pieces(d, PATH)), ("toxicity", toxicity, lambda d: toxicity.with_scores(d, model)), ("sets", ngram_join, ngram_join.set_table)):
        own = spark.newSession()
        rows, size = most(own, name, module, run)
        assert rows >= 100 and size < 5_000_000, name
        own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
        assert most(own, f"{name}-own", module, run)[1] < 2_000_000, name

"""Text operators against the tokenizers' own libraries, plain versions and hand-made cases."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F, types as T

from pulsegrid.llm import bpe, chat, langid, licenses, packing, quality, queries, simhash, tokencount, tokenizers
from pulsegrid.session import clear_scratch, scratch_path, shared_path

BYTE, WORD, PIECE = (P.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, n_tokens string"


def docs(spark, texts, lang="en"):
    """Rows with columns whose names clash with those that operators add."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", "y", "z") for i, t in texts], DOCS)


def tricky(n=400, seed=4):
    parts = ["a", "The", " ", "  ", "\n", "\t", "é", "É", "12", "!", "'s", "'LL", "<|endoftext|>", " ", "日本", "\x1c", "\u0085",
             "😀", "ing", " the", "aaaa", "▁", "é", "᠎", "\r\n", "İ", "Σ", "ﬁ", "word, ", "next.\n", "</s>", "[INST]", "<|start|>", "\\"]
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)] + ["", "x" * 3000, " " * 700 + "a", "ab " * 5000]


def test_ids_and_text_are_the_librarys(spark):
    from tokenizers import Tokenizer

    library, texts = Tokenizer.from_file(BYTE), [*tricky(), None, "same", "same"]
    rows = bpe.round_trip(docs(spark, enumerate(texts)).drop("ids"), BYTE).orderBy("doc_id").collect()
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [r["ids"] for r in rows] == want
    assert [r["decoded"] for r in rows] == [library.decode(i, skip_special_tokens=False) for i in want]


def test_bytes_that_are_no_text_decode_to_replacement_characters(spark):
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(BYTE), random.Random(3)
    lists = [[rng.randrange(50257) for _ in range(12)] for _ in range(200)] + [[], None]
    got = bpe.decode(spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, ids array<int>"), BYTE).orderBy("i").collect()
    assert [r["decoded"] for r in got] == [library.decode(x or [], skip_special_tokens=False) for x in lists]


@pytest.mark.parametrize("path,words", [(WORD, True), (PIECE, False)])
def test_chunks_give_the_ids_of_whole_texts(path, words):
    model, texts = tokenizers.load(path, words), tricky(3000, 9)
    flat, n = model.chunks.encode(pa.array(texts))
    whole, m = model.encode_whole(texts)
    assert np.array_equal(flat, whole) and np.array_equal(n, m)
    assert np.array_equal(model.chunks.count(pa.array(texts)), m)


def test_a_full_cache_starts_anew_without_another_result(monkeypatch):
    from pulsegrid.llm import chunks

    monkeypatch.setattr(chunks, "CACHE_ENTRIES", 40)
    model = tokenizers.WordBpe(WORD)
    for seed in range(5):
        texts = [" ".join(random.Random(seed * 50 + i).choices("abcdefghij klm nop qrs tuv".split() + [f"w{i}"], k=9)) for i in range(30)]
        flat, n = model.chunks.encode(pa.array(texts))
        whole, m = model.encode_whole(texts)
        assert np.array_equal(flat, whole) and np.array_equal(n, m)


def test_token_counts_use_and_fill_the_cache(spark):
    cache, texts = scratch_path(spark, "test-cache"), [*tricky(60), None, "one two", "one two"]
    model = tokenizers.load(PIECE)
    want = model.encode_whole([t or "" for t in texts])[1].tolist()
    rows = tokencount.count_tokens(docs(spark, enumerate(texts)), PIECE, cache).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in rows] == want and [r["n_bytes"] for r in rows] == [len((t or "").encode()) for t in texts]
    held = spark.read.parquet(cache)
    assert held.count() == len({t or "" for t in texts})
    # A stored count is believed: what is there is not encoded again.
    other = "one two three"
    fake = spark.createDataFrame([(hashlib.sha256(other.encode()).digest(), 77, tokenizers.version(PIECE))], tokencount.CACHE)
    fake.write.mode("append").partitionBy("tokenizer").parquet(cache)
    got = tokencount.count_tokens(docs(spark, [(1, other), (2, "new"), (None, "one two")]), PIECE, cache).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {1: 77, 2: len(model.model.encode("new")), None: len(model.model.encode("one two"))}
    assert spark.read.parquet(cache).count() == len({t or "" for t in texts}) + 2
    assert tokencount.count_tokens(docs(spark, []), PIECE, cache).count() == 0


@pytest.mark.parametrize("few", [0, 2, 1000])
def test_few_and_many_misses_give_the_same_counts(spark, monkeypatch, few):
    monkeypatch.setattr(tokencount, "FEW", few)
    cache, texts = scratch_path(spark, "test-cache"), ["one two", "three", None, "one two", "", "four five six"]
    run = lambda rows: [r["n_tokens"] for r in tokencount.count_tokens(docs(spark, enumerate(rows)), PIECE, cache).orderBy("doc_id").collect()]
    model = tokenizers.load(PIECE)
    want = [len(model.model.encode(t or "")) for t in texts]
    assert run(texts) == want and run(texts) == want and spark.read.parquet(cache).count() == 4
    assert run([*texts, "new", "new"]) == [*want, *[len(model.model.encode("new"))] * 2] and spark.read.parquet(cache).count() == 5
    # Counts of another tokenizer are no use here.
    assert tokencount.count_tokens(docs(spark, enumerate(texts)), WORD, cache).count() == 6 and spark.read.parquet(cache).count() == 9


def test_columns_of_the_same_names_are_replaced(spark):
    """Whatever their types and case, columns named like those that an operator adds give way; all others stay."""
    clash = spark.createDataFrame([(1, "The house is red.", 5, "x", 1.5, "k"), (2, None, 6, "y", 2.5, "k")],
                                  "doc_id long, text string, IDS int, score string, Lang_Pred double, other string")
    encoded = bpe.encode(clash, BYTE)
    assert [c.lower() for c in encoded.columns].count("ids") == 1 and len(encoded.select("ids").collect()[0]["ids"]) > 2
    both = bpe.round_trip(clash, BYTE)
    assert [r["decoded"] for r in both.orderBy("doc_id").select("decoded", "other", "score").collect()] == ["The house is red.", ""]
    scored = quality.score(clash, quality.fit([(b"good text", 1), (b"bad words", 0)] * 9))
    assert dict(scored.dtypes)["score"] == "double" and scored.select("score", "ids", "other").count() == 2
    marked = langid.predict(clash, langid.fit([(b"the house", "en"), (b"das haus", "de")] * 9))
    assert dict(marked.dtypes)["lang_pred"] == "string" and marked.where("doc_id = 2").first()["lang_pred"] == langid.UNKNOWN
    for frame in (encoded, both, scored, marked):
        assert {r["other"] for r in frame.collect()} == {"k"}
    empty = clash.limit(0)
    assert [f.count() for f in (bpe.round_trip(empty, BYTE), quality.score(empty, quality.fit([])), langid.predict(empty, langid.fit([])))] == [0, 0, 0]
    assert langid.predict(clash.drop("text").withColumnRenamed("other", "text"), langid.fit([]), out="text").columns.count("text") == 1


def test_pieces_and_places_with_columns_of_the_same_names(spark):
    clash = spark.createDataFrame([(1, "The house is red.", 5, "x", 1, 2, 3), (2, None, 6, "y", 1, 2, 3), (None, "a b", 6, "y", 1, 2, 3)],
                                  "doc_id long, text string, piece int, ids string, sequence_id int, offset int, Length int")
    cut = packing.pieces(clash, WORD)
    assert len({c.lower() for c in cut.columns}) == len(cut.columns) and cut.count() == 3
    placed = packing.place(cut, ["doc_id", "piece"])
    assert len({c.lower() for c in placed.columns}) == len(placed.columns) and placed.select("sequence_id", "offset", "length").count() == 3
    none = packing.place(packing.pieces(clash.limit(0), WORD), ["doc_id", "piece"])
    assert none.count() == 0


def test_the_query_meets_the_counts_of_earlier_runs(spark, sf_dir):
    run = lambda: sorted(map(str, queries.QUERIES["op10_token_count_cache"](spark, sf_dir).collect()))
    cache = shared_path(spark, "token-counts")
    first, held = run(), spark.read.schema(tokencount.CACHE).parquet(cache).count()
    clear_scratch(spark)
    assert run() == first and spark.read.schema(tokencount.CACHE).parquet(cache).count() == held > 0


def test_whitespace_may_be_normalised_where_the_vocabulary_drops_it(spark):
    cache = scratch_path(spark, "test-cache")
    collapse = lambda c: F.trim(F.regexp_replace(c, "[ \n\t]+", " "))
    rows = tokencount.count_tokens(docs(spark, [(1, "a  b"), (2, "a\nb "), (3, "a b")]), WORD, cache, normalise=collapse).collect()
    assert {r["n_tokens"] for r in rows} == {2} and spark.read.parquet(cache).count() == 1


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ")
             .replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints(spark):
    texts = ["", " \n ", "One", "one TWO three four five", "É a b c d e f", "a b c d " * 9, None, *tricky(50)]
    rows = simhash.fingerprints(docs(spark, enumerate(texts))).select("doc_id", simhash.hexed("fingerprint").alias("f")).orderBy("doc_id").collect()
    assert [int(r["f"], 16) for r in rows] == [plain_fingerprint(t or "") for t in texts]
    assert all(len(r["f"]) == 16 for r in rows)


def test_every_pair_within_the_radius_shares_a_bucket():
    masks = simhash.covering_masks(4)
    assert len(masks) == 31
    rng = random.Random(2)
    for _ in range(3000):
        differ = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(differ & m == 0 for m in masks)


def brute_components(fps, radius=4):
    x = np.array(fps, np.uint64)
    near, label = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius, np.arange(len(x))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label.tolist()
        label = new


@pytest.mark.parametrize("spread,dense", [(7, 1024), (5, 16), (64, 1024)])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, spread, dense):
    # Small buckets make the other exact way run; the executors get the value with the function.
    rng = random.Random(spread)
    base, fps = rng.getrandbits(64), []
    for _ in range(500):
        f = base
        for _ in range(rng.randint(0, spread)):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    monkeypatch.setattr(simhash, "DENSE", dense)
    frame = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "doc_id long, fingerprint long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.groups(frame).collect()}
    assert [got[i] for i in range(len(fps))] == brute_components(fps)


def test_large_buckets_go_by_midpoints():
    fps = np.unique(np.random.default_rng(1).integers(0, 1 << 12, 600).astype(np.int64) << 3)
    rows = [pa.RecordBatch.from_arrays([pa.array(np.zeros(len(p), np.int32)), pa.array(np.zeros(len(p), np.int64)), pa.array(p)], names=["table", "bucket", "fp"])
            for p in np.array_split(fps, 7)]
    old, simhash.DENSE = simhash.DENSE, 64
    try:
        out = pa.Table.from_batches(simhash._bucket_links(4)(iter(rows)))
    finally:
        simhash.DENSE = old
    assert out["b"].null_count == len(out) and sorted(out["a"].to_pylist()) == fps.tolist()
    masks = simhash.covering_masks(4)
    points = pa.Table.from_batches(simhash._midpoints(4, masks)(iter([pa.RecordBatch.from_arrays([pa.array([0, 0], pa.int32()), pa.array([5, -9])], names=["table", "fp"])])))
    free = 64 - (masks[0] & (1 << 64) - 1).bit_count()
    assert points.num_rows == 2 * (1 + free + free * (free - 1) // 2)


def test_groups_of_null_ids_repeats_and_nothing(spark):
    frame = spark.createDataFrame([(3, 0), (2, 0), (2, 0), (None, 0), (None, 1 << 40), (9, -1)], "doc_id long, fingerprint long")
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.groups(frame).collect()), key=str)
    assert got == sorted([(3, 0, 2), (2, 0, 2), (2, 0, 2), (None, 0, 2), (None, 1 << 40, 2), (9, -1, 9)], key=str)
    assert simhash.groups(frame.limit(0)).count() == 0


def test_one_document_of_a_group_stays(spark):
    text = " ".join(f"word{i}" for i in range(300))
    rows = docs(spark, [(5, text), (3, text + " end"), (4, "other words entirely here now"), (4, "other words entirely here now"), (None, text), (6, None), (7, "")])
    kept = simhash.keep_one(rows)
    assert kept.columns == rows.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([3, 4, 6, None], key=str)


def test_clashing_ids_with_different_texts_are_told_apart(spark):
    one, two = (" ".join(f"{w}{i}" for i in range(300)) for w in ("word", "thing"))
    alone = "other words entirely here now"
    rows = docs(spark, [(4, one), (4, one), (4, one + " end"), (4, alone), (5, two), (3, two + " end"), (5, "a sixth text that is like none")])
    got = sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(rows).collect())
    assert [i for i, _ in got] == [3, 4, 4, 5] and got[0][1] == two + " end"
    assert (4, alone) in got and (5, "a sixth text that is like none") in got and {t for i, t in got if i == 4} - {alone} <= {one, one + " end"}


def labelled(spark, n=240):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice("the of and house tree water light over under walks sees found small green river".split()) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice(["BUY!!", "$$$", "###", "click", "||", "%%%"]) + rng.choice("abcdef") for _ in range(60))
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(n)]
    return docs(spark, rows), spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, "clash") for i in range(n)], "doc_id long, quality int, text string")


def test_quality_on_held_out_rows(spark):
    frame, labels = labelled(spark)
    fold = quality.remainder("doc_id", 3)
    assert {r[0]: r[1] for r in frame.select("doc_id", fold).collect()} == {i: zlib.crc32(str(i).encode()) % 3 for i in range(240)}
    model = quality.train(frame, labels, usable=fold != 1)
    again = quality.train(frame.repartition(7), labels, usable=fold != 1)
    assert np.array_equal(model.weights, again.weights) and model.dictionaries == again.dictionaries
    got = quality.score(frame, model, out="p").where(fold == 1).collect()
    assert len(got) > 50 and np.mean([(r["p"] >= 0.5) == (r["doc_id"] % 4 != 0) for r in got]) > 0.95


def test_quality_without_labels_or_texts(spark):
    frame, labels = labelled(spark, 12)
    for none in (labels.limit(0), labels.where("quality = 1"), labels.withColumn("quality", F.lit(None).cast("int"))):
        scores = {r["p"] for r in quality.score(frame, quality.train(frame, none), out="p").collect()}
        assert len(scores) == 1 and 0 <= scores.pop() <= 1
    odd = docs(spark, [(1, None), (2, ""), (2, ""), (None, "x" * 50000)])
    rows = quality.score(odd, quality.train(frame, labels), out="p").collect()
    assert len({r["p"] for r in rows if not r["text"]}) == 1 and all(0 <= r["p"] <= 1 for r in rows)


def test_languages_on_held_out_rows(spark):
    words = {"aa": "the and with from house river", "bb": "der und nicht über straße wasser", "cc": "что это как дом река"}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(words[k].split(), k=rng.randint(3, 150))), k) for i, k in enumerate(list(words) * 70)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fold = quality.remainder("doc_id", 4)
    net = langid.train(frame, usable=fold != 2)
    got = langid.predict(frame, net).where(fold == 2).collect()
    assert len(got) > 30 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97 and all(0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? ---"), (4, "the " * 9000), (4, "the " * 9000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(odd, net).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "aa"
    assert {r["lang_pred"] for r in langid.predict(odd, langid.train(frame.limit(0))).collect()} == {"und"}


def test_windows_hold_every_ngram_of_a_text():
    for n in (1, 255, 256, 257, 509, 510, 2000):
        text = bytes(random.Random(n).choices(range(1, 256), k=n))
        windows, count = langid.windows_of([b"", text])
        assert count.tolist() == [0, len(windows)]
        seen = {w.tobytes()[i:i + 4] for w in windows for i in range(langid.STRIDE)}
        assert {text[i:i + 4] for i in range(n - 3)} <= seen


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spots in by.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_round_trip(spark):
    texts = [*tricky(150), None, "tail " * 9000, "same", "same"]
    frame = docs(spark, enumerate(texts)).select("doc_id", "text", "source")
    cut = packing.pieces(frame, WORD)
    rows = packing.place(spark.createDataFrame(cut.collect(), cut.schema), ["doc_id", "piece"]).collect()
    library, got = tokenizers.load(WORD, True), {}
    for r in sorted(rows, key=lambda r: r["piece"]):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and r["start"] == len(got.get(r["doc_id"], []))
        got.setdefault(r["doc_id"], []).extend(ids)
    flat, n = library.encode_whole([t or "" for t in texts])
    want = [[*x.tolist(), 1] for x in np.split(flat, np.cumsum(n)[:-1])]
    assert [got[i] for i in range(len(texts))] == want
    n_sequences = check_packing(rows, packing.CAPACITY)
    assert n_sequences <= -(-sum(map(len, want)) // packing.CAPACITY) + 1


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_the_histogram_exactly(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(64, 1 + rng.geometric(0.08, 3000))
    histogram = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
    for plan in (packing.plan(histogram, 64), packing.plan(histogram, 64, fitted=False), packing.best_plan(histogram, 64)):
        used = {}
        for pattern, times in plan:
            assert sum(n * m for n, m in pattern) <= 64 and times > 0
            for n, m in pattern:
                used[n] = used.get(n, 0) + m * times
        assert used == histogram
        assert sum(t for _, t in plan) <= -(-sum(n * c for n, c in histogram.items()) // 64) + 2
    assert packing.plan({}, 64) == []


def test_the_fit_takes_part():
    histogram = {40: 100, 24: 100, 30: 60, 34: 60, 20: 30, 44: 30}
    patterns = packing.enumerate_patterns(list(histogram), 64)
    assert ((40, 1), (24, 1)) in patterns
    x = packing.fit_counts(patterns, histogram)
    left = dict(histogram)
    for p, t in zip(patterns, x, strict=True):
        assert t >= 0
        for n, m in p:
            left[n] -= m * t
    assert max(map(abs, left.values())) < 1


def test_places_are_those_of_the_fitted_plan(spark):
    rng = np.random.default_rng(76)  # of these the plain plan would make one sequence less
    lengths = rng.choice(rng.integers(600, 2500, 12), 80)
    histogram = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
    plain = packing.plan(histogram, fitted=False)
    rows = spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")
    got = {}
    for r in packing.place(rows, ["doc_id", "piece"]).collect():
        got.setdefault(r["sequence_id"], []).append(r["length"])
    made = lambda plan: sorted(sorted(n for n, m in p for _ in range(m)) for p, t in plan for _ in range(t))
    assert sorted(map(sorted, got.values())) == made(packing.plan(histogram)) != made(plain)


def test_a_length_that_most_pieces_share_is_numbered_in_slices(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") % 3 == 0, F.lit(100)).otherwise(F.lit(1366)).cast("long").alias("length"))
    got = packing.place(rows, ["doc_id", "piece"]).collect()
    assert len(got) == 6000 and len({r["doc_id"] for r in got}) == 6000
    assert check_packing(got, packing.CAPACITY) <= -(-(2000 * 100 + 4000 * 1366) // 4096) * 1.6


def conversation_rows():
    rng, rows = random.Random(5), []
    for c in range(40):
        for t in range(rng.randint(1, 12)):
            role = "system" if t == 0 and c % 3 == 0 else ["user", "assistant"][t % 2]
            rows.append((c, t, role, rng.choice(tricky(30, c + 50))))
    rows += [(100, t, ["user", "assistant"][t % 2], f"turn {t} " + "word " * (t % 90)) for t in range(700)]
    rows += [(101, 0, "system", "rules " * 30), *[(101, t, ["assistant", "user"][t % 2], "x " * 200) for t in range(1, 60)]]
    rows += [(102, None, "assistant", None), (102, None, "assistant", None), (102, 1, None, "a"), (None, 0, "assistant", "no id"), (103, 0, "assistant", "y " * 9000)]
    return rows


def test_windows_read_back_and_keep_their_budget(spark):
    rows, budget = conversation_rows(), chat.Budget(512, 64, 96)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("span", F.lit("clash"))
    made = chat.windows(frame, BYTE, budget, slice=64)
    windows = made.orderBy("conv_id", "span").collect()
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        plain = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256(plain.encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c]["formatted_chars"] == sum(len(w["text"]) for w in windows if w["conv_id"] == c)
    later = [w for w in windows if w["span"] > 0]
    assert len(later) > 20
    assert all(w["n_tokens"] <= budget.window for w in windows if w["conv_id"] in (100, 101))
    assert all(w["text"].startswith(f"{chat.START}system{chat.BODY}rules") and w["n_context"] >= 1 for w in later if w["conv_id"] == 101)
    assert any(w["n_context"] > 1 for w in later)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.windows(empty, BYTE)).count() == 0


def test_escapes_are_reversible(spark):
    texts = [t for t in tricky(300, 77)] + ["<|start|>", "<\\|start|>", "[INST]", "[\\\\/INST]", "<<|end|>>", queries.TRICKY, "\\<|body|>\\"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(chat.escape(F.col("t"))).collect()]
    assert not any(c in g for g in got for c in chat.CONTROL)
    assert [chat.unescape(g) for g in got] == texts


def test_licences_and_where_they_come_from(spark):
    mit, gpl = licenses.NOTICES["MIT"], licenses.NOTICES["GPL-3.0"]
    files = [("LICENSE", mit), ("a/x.txt", "plain words"), ("a/b/COPYING", f"Some words first\n{gpl}"), ("a/b/c/d/y.txt", "text"),
             ("a/b/z.txt", f"body\n# {licenses.NOTICES['Apache-2.0'].upper()}."), ("q/r.txt", None), ("q/r.txt", ""), (None, "lost"),
             ("a/b/c/word.txt", "The license of the house is a version of the public work and a " * 200), ("bb/e.txt", licenses.NOTICES["CC-BY-NC-4.0"])]
    frame = spark.createDataFrame([(p, t, "clash") for p, t in files], "path string, text string, license string")
    got = {r["path"]: (r["license"], r["declared_in"]) for r in licenses.scan(frame).collect()}
    assert got == {"LICENSE": ("MIT", "LICENSE"), "a/x.txt": ("MIT", "LICENSE"), "a/b/COPYING": ("GPL-3.0", "a/b/COPYING"),
                   "a/b/c/d/y.txt": ("GPL-3.0", "a/b/COPYING"), "a/b/z.txt": ("Apache-2.0", "a/b/z.txt"), "q/r.txt": ("MIT", "LICENSE"),
                   None: ("MIT", "LICENSE"), "a/b/c/word.txt": ("GPL-3.0", "a/b/COPYING"), "bb/e.txt": ("CC-BY-NC-4.0", "bb/e.txt")}
    assert licenses.scan(frame.limit(0)).count() == 0


def test_wrapped_notices_headers_and_whole_licence_texts(spark):
    gnu = ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n"
           "# the Free Software Foundation, either version {} of the License, or\n# (at your option) any later version.\n#\nimport os\nprint(os.name)\n")
    texts = {p.stem: p.read_text() for p in licenses.TEXTS.glob("*.txt")}
    mit = texts["MIT"].replace("Permission is", "Copyright (c) 2020 Jane Doe\n\nPermission is")
    files = {"GPL-3.0": ["This work is licensed under the GNU General\nPublic License, version 3", gnu.format(3), texts["GPL-3.0"]],
             "GPL-2.0": [gnu.format(2), texts["GPL-2.0"]],
             "MIT": ["Copyright (c) 2020 Jane Doe. Released under the MIT License.", mit, "/*\n * " + mit.replace("\n", "\n * ") + "\n */\n\nint main() { return 0; }\n"],
             "BSD-2-Clause": [licenses.long_templates()["BSD-2-Clause text"]], "BSD-3-Clause": [texts["BSD-3-Clause"]],
             "Apache-2.0": [texts["Apache-2.0"]], "AGPL-3.0": [licenses.long_templates()["AGPL-3.0 text"]], "ISC": [texts["ISC"]],
             None: ["Some words\nabout nothing in particular.", "The work of the public is a version of the license that you may use."]}
    rows = [(f"{k}/{i}", k, t) for k, ts in files.items() for i, t in enumerate(ts)] + [(f"fill/{i}", None, f"the plain words of a house {i}") for i in range(300)]
    frame = spark.createDataFrame([(p, t) for p, _, t in rows], "path string, text string")
    got = {r["path"]: r for r in licenses.notices_of(frame, whole=F.lit(True)).collect()}
    assert {p: r["license"] for p, r in got.items()} == {p: k for p, k, _ in rows if k}
    assert got["MIT/1"]["chars"] >= licenses.STANDALONE * len(mit)


def test_anchors_leave_no_match_out():
    counts = licenses.vocabulary(licenses.NOTICES)
    idf = {t: 1 + len(t) / 7 for c in counts.values() for t in c}
    vectors = licenses.weigh(counts, idf)
    found = licenses.anchors(vectors, licenses.LEAST)
    for w in vectors.values():
        assert sum(x * x for t, x in w.items() if t not in found) < licenses.LEAST ** 2

"""Toxicity, language model, packing and the pipeline."""

import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from orrery.llm import class_lm, html_extraction, license_scan, packing, pii, quality_rules, sharding, toxicity

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def toxic_frame(spark, n=400):
    rows = []
    for k in range(n):
        bad = k % 4 == 0
        rows.append((k, f"word{k % 7} and some quiet prose number {k} " + (("you are an idiot" if k % 8 else "you are a grumbul") if bad else "about a garden"), int(bad)))
    docs = spark.createDataFrame([(k, t, 0.5) for k, t, _ in rows] + [(9001, None, 0.5), (9002, "", 0.5), (9003, "you grumbul", 0.5)], "doc_id long, text string, score double")
    return docs, spark.createDataFrame([(k, b, 1) for k, _, b in rows] + [(None, 1, 1), (77_777, 0, 1)], "doc_id long, toxic int, quality int")


def test_toxicity_learns_and_holds_out(spark):
    docs, labels = toxic_frame(spark)
    rows = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(rows) == 403
    assert all(r.held_out == (fold(k) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for k, r in rows.items())
    assert all(rows[k].predicted == (k % 4 == 0) for k in range(400) if rows[k].held_out)
    assert rows[9001].score == rows[9002].score < 0.5
    assert rows[9003].predicted == 1  # a word that only the labels teach


def test_toxicity_without_labels(spark):
    docs, labels = toxic_frame(spark, 20)
    got = {r.doc_id: r.score for r in toxicity.score(docs, labels.limit(0)).collect()}
    assert got[4] == 0.9 and got[1] == 0.1
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_toxicity_sees_obfuscation():
    p = toxicity.Params()
    f = dict(zip(toxicity.FEATURES, toxicity.features_of("you 1d10t! i-d-i-o-t SHOUT stuuupid", {}, p), strict=True))
    assert f["obfuscated_hits"] >= 2 and f["capitals"] > 0 and f["drawn_out"] > 0


def lm_frame(spark):
    texts = []
    for k in range(300):
        words = ("the", "cat", "sat", "here") if k % 2 else ("der", "hund", "lief", "dort")
        texts.append(" ".join(words[(k * 7 + j * j) % 4] for j in range(40)) + f" rare{k % 50} odd{k % 20} seldom{k}")
    return texts + [None, "", "Unseen words only"]


def cut(text):
    return [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [""]


LM = class_lm.Params(share=5e-3, classes=6, slot_bits=7, ending_bits=2)


def trained(spark, texts, p=LM):
    """What score() does up to the classes, and the numbers of each training row."""
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    scratch = class_lm.Scratch(spark, "lm-test")
    docs = df.selectExpr("doc_id", "lower(coalesce(text, '')) as text").withColumn("held_out", class_lm.held_out())
    vocabulary = scratch.save(class_lm.count_words(docs))
    frequent = class_lm.find_frequent(docs, vocabulary, p)
    encoded = scratch.save(class_lm.encode(docs.selectExpr("*", "doc_id as row"), frequent, p))
    return scratch, vocabulary, frequent, encoded


def test_class_model_equals_a_plain_model(spark):
    texts = lm_frame(spark)
    df = spark.createDataFrame([(k, t, 0.0) for k, t in enumerate(texts)], "doc_id long, text string, score double")
    rows = {r.doc_id: r for r in class_lm.score(df, LM).collect()}
    counts = Counter(w for k, t in enumerate(texts) if fold(k) != 1 for w in cut(t))
    n, v = sum(counts.values()), len(counts)

    scratch, vocabulary, frequent, encoded = trained(spark, texts)
    assert frequent.words and len(frequent.words) < v - 50 and (frequent.tokens, frequent.vocabulary) == (n, v)
    of, bigrams = class_lm.exchange(encoded, frequent, scratch, LM)
    number = lambda w: 0 if w == "" else frequent.words.get(w.encode()) or class_lm.rare_number(w.encode(), LM)
    cls = lambda w: int(of.of_numbers(np.array([number(w)]))[0])
    assert sum(o != class_lm.POOLED for o in of.slots) > 20  # rarer words have classes of their own
    members, mass, follow = Counter(map(cls, counts)), Counter(), Counter()
    for k, t in enumerate(texts):
        if fold(k) != 1:
            c = [cls(w) for w in cut(t)]
            mass.update(c)
            follow.update(zip([0, *c], c))
    assert all(bigrams[a, b] == follow[a, b] for a in range(6) for b in range(6))
    gain = 0
    for k, t in enumerate(texts):
        r, tokens = rows[k], cut(t)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), rel_tol=1e-9)
        want, before = 0.0, 0
        for w in tokens:
            c = cls(w)
            unigram = (mass[c] + 0.5) / (n + 0.5 * 6)
            want += math.log10((follow[before, c] + LM.backing * unigram) / (sum(follow[before, b] for b in range(6)) + LM.backing))
            want += math.log10((counts[w] + 0.5) / (mass[c] + 0.5 * (members[c] + 1)))
            before = c
        assert math.isclose(r.score, want, rel_tol=1e-9)
        gain += r.held_out * (r.score - r.base_score)
    assert gain > 0
    assert class_lm.score(df.limit(0), LM).count() == 0


def test_counts_of_neighbours_travel_as_arrays(spark):
    scratch, _, frequent, encoded = trained(spark, lm_frame(spark))
    of = class_lm.start_classes(frequent, LM)
    of.slots[::3] = np.random.default_rng(5).integers(1, 6, len(of.slots[::3]))
    sent, k = spark.sparkContext.broadcast(of), LM.classes
    for turn in (0, 1):
        want = {}
        for r in encoded.where("not held_out").collect():
            now = np.frombuffer(bytes(r.numbers), "<u4").astype(np.int64)
            cls = of.of_numbers(now).tolist()
            for number, before, own, after in zip(now.tolist(), [0, *cls], cls, [*cls[1:], 0]):
                found = [(-1 - before, own)]
                slot, pool = number & len(of.slots) - 1, (number & class_lm.RARE - 1) // len(of.slots)
                if 0 < number < class_lm.RARE and number % 2 == turn:
                    found += [(number, before), (number, k + after)]
                if number >= class_lm.RARE and of.slots[slot] == class_lm.POOLED and pool % 2 == turn:
                    found += [(class_lm.POOL + pool, before), (class_lm.POOL + pool, k + after)]
                if number >= class_lm.RARE and turn >= LM.slots_from and slot % LM.cycle == turn % LM.cycle:
                    found += [(number, 2 * k + before * k + after)]
                for name, code in found:
                    want.setdefault(name, Counter())[code] += 1
        want = {x: c for x, c in want.items() if not class_lm.RARE <= x < class_lm.POOL or sum(c.values()) >= LM.least_count}
        counted = class_lm.neighbours(encoded, sent, turn, LM, tokens_at_once=300)
        assert "HashAggregate" not in counted._jdf.queryExecution().executedPlan().toString()  # no row for each number and code
        rows = counted.collect()
        assert {r.number: dict(zip(r.codes, r.counts, strict=True)) for r in rows} == want and len(rows) == len(want)
        assert any(x >= class_lm.POOL for x in want) and any(class_lm.RARE <= x < class_lm.POOL for x in want) == (turn == 1)
    words = ["a", "ab", "abc", "straße", "x" * 300]
    assert [class_lm.rare_number(w.encode(), LM) for w in words] == class_lm.rare_numbers([w.encode() for w in words], LM).tolist()
    assert all(class_lm.rare_number(w.encode(), LM) == class_lm.RARE | (zlib.crc32(w.encode()[-2:]) >> 7 & 3) << 7 | zlib.crc32(w.encode()) & 127 for w in words)


def test_a_move_is_the_best_of_all_classes(spark):
    texts = lm_frame(spark)
    scratch, _, frequent, encoded = trained(spark, texts)
    draw = np.random.default_rng(3)
    of = class_lm.start_classes(frequent, LM)
    of.slots[::3] = np.random.default_rng(3).integers(1, 6, len(of.slots[::3]))
    train = [np.frombuffer(bytes(r.numbers), "<u4").astype(np.int64) for r in encoded.where("not held_out").collect()]
    counts = Counter(int(i) for x in train for i in x)
    shared = Counter(i & len(of.slots) - 1 for i in counts if i >= class_lm.RARE)
    itself = {int(i) for x in train for i in x[1:][x[1:] == x[:-1]]}
    moved, exact = set(), 0
    for turn in range(6):
        sent = spark.sparkContext.broadcast(of)
        counted = scratch.save(class_lm.neighbours(encoded, sent, turn, LM, tokens_at_once=500))
        bigrams = class_lm.transitions(counted, LM)
        for r in class_lm.best_classes(counted, sent, bigrams, LM).collect():
            moved.add(r.number)
            assert r.number >= class_lm.POOL or r.n == counts[r.number] >= LM.least_count
            # what follows itself is in its own histograms, and a pool has many words: there the gain is an estimate, as for slots with two words
            if r.number in itself or r.number >= class_lm.POOL or r.number >= class_lm.RARE and shared[r.number & len(of.slots) - 1] > 1:
                continue
            tried = {}
            for c in range(1, 6):
                now = of.moved(np.array([r.number]), np.array([c], np.uint8))
                g = np.zeros((6, 6))
                for x in train:
                    cls = now.of_numbers(x)
                    np.add.at(g, (np.concatenate([[0], cls[:-1]]), cls), 1)
                tried[c] = class_lm.likelihood(g)
            assert tried[r["class"]] >= max(tried.values()) - 1e-9
            exact += 1
    assert exact > 20 and any(m < class_lm.RARE for m in moved) and any(class_lm.RARE <= m < class_lm.POOL for m in moved) and any(m >= class_lm.POOL for m in moved)


def test_exchange_goes_on_while_it_gains(spark, monkeypatch):
    reached, turns = [], []
    measure, move = class_lm.transitions, class_lm.neighbours
    monkeypatch.setattr(class_lm, "transitions", lambda *a: [out := measure(*a), reached.append(class_lm.likelihood(out))][0])
    monkeypatch.setattr(class_lm, "neighbours", lambda *a: [turns.append(a[2]), move(*a)][1])
    scratch, _, frequent, encoded = trained(spark, lm_frame(spark))
    class_lm.exchange(encoded, frequent, scratch, LM)
    assert len(turns) > 6 and turns == list(range(len(turns))) and len(reached) == len(turns)
    assert reached[-1] - reached[-3] < LM.least_gain and reached[-1] > reached[0]
    assert all(reached[k] - reached[k - 2] >= LM.least_gain for k in range(7, len(turns) - 1))


def test_class_model_is_a_distribution():
    p = class_lm.Params(classes=4)
    bigrams = np.arange(16.0).reshape(4, 4)
    distinct = np.array([1, 5, 0, 7])
    move, divisor = class_lm.score_tables(bigrams, distinct, p)
    assert np.allclose((10**move).sum(axis=1), 1)
    # the words of a class share counts + add each, one unknown has add
    assert np.allclose((bigrams.sum(axis=0) + p.add * (distinct + 1)) / 10**divisor, 1)


def test_packing_gives_plain_words_to_the_merges_alone(monkeypatch):
    packing._words.cache_clear()
    whole = packing._tokenizer("")
    odd = ["don't I'LL we've 'tis ''s O'Reilly's", "Straße ÉTÉ çà N° ½ ª º µm ×÷", "x²y 12345 a1b2 _under_score_ --'s !!", "\u0130stanbul ΟΔΟΣ e\u0301t\u0301 \u212b ﬁne 中文字 १२", "tab\there nb\u00a0sp\r\nline\u2028sep", "a<|endoftext|>b <|startoftext|> <|no <b>", "\0 \x7f \u200b 🙂👍🏽", "", "   "]
    letters = [chr(k) + "a" + chr(k) + chr(k) for k in range(1, 0x250)]

    def right(texts, p):
        for text, ids in zip(texts, packing._encoded(texts, p), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == [*whole.encode(text, add_special_tokens=False).ids, 2], text

    for texts in (odd, odd, letters):
        right(texts, packing.Params())
    for _ in range(3):
        right(["one two three four five"], packing.Params(cached_words=2))
    assert len(packing._words("", 2)) == 2

    class MergesAlone:
        to_str, model, get_vocab_size, get_added_tokens_decoder = whole.to_str, whole.model, whole.get_vocab_size, whole.get_added_tokens_decoder

        def encode(self, *args, **kwargs):
            raise AssertionError("the whole way")

    packing._words.cache_clear()
    monkeypatch.setattr(packing, "_tokenizer", lambda path: MergesAlone())
    right(["Zorblat's Größe, (été) 4x4!"], packing.Params())
    packing._words.cache_clear()


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["It's a test, don't panic 123 ÄÖ", None, "", "  \n ", "word " * 9000, "a\tb c d", "same", "same"] + [f"text number {k} about things" for k in range(200)]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, row int")
    rows = packing.pack(df, with_ids=True).collect()
    pieces, sequences = {}, {}
    for r in rows:
        assert r.length == len(r.ids) // 4 and zlib.crc32(r.ids) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for k, t in enumerate(texts):
        own = sorted(pieces[k], key=lambda r: r.start)
        got = np.frombuffer(b"".join(bytes(r.ids) for r in own), "<u4").tolist()
        assert got == [*tk.encode(t or "", add_special_tokens=False).ids, 2] and all(r.doc_tokens == len(got) for r in own)
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1])
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == list(np.cumsum([0] + [r.length for r in s])[:-1])
    full = [sum(r.length for r in s) for _, s in sorted(sequences.items())]
    assert all(n == 4096 for n in full[:-1]) and full[-1] <= 4096
    assert packing.pack(df.limit(0)).count() == 0


def test_the_stream_follows_the_curve(spark):
    draw = np.random.default_rng(5)
    texts = [" ".join(f"topic{k % 7} word{draw.integers(40 * (k % 7), 40 * (k % 7) + 40)}" for _ in range(int(draw.integers(5, 60)))) for k in range(150)]
    p = packing.Params(length=500, range_rows=20)
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), p).where("start = 0").collect()
    keys = packing._keys(list(packing._encoded(texts, p)), p)
    along = [int(keys[r.doc_id]) for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
    assert along == sorted(along) and len(set(along)) > 100


def test_hilbert_is_a_walk_through_all_points():
    side = np.arange(8)
    points = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    keys = packing.hilbert(points, 3)
    assert sorted(keys) == list(range(512))
    walk = points[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@needs_tables
def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, columns = docs, docs.columns
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        now = stage(spark, now, SF).cache()
        assert now.columns == columns
        kept[name] = {r.doc_id for r in now.select("doc_id").collect()}
    bad = {r.doc_id for r in toxicity.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    assert kept["toxicity"] == {r.doc_id for r in docs.select("doc_id").collect()} - bad
    assert kept["near_dedup"] >= kept["decontamination"] == kept["pii"]
    assert {r.doc_id for r in pipeline.run(spark, SF).select("doc_id").collect()} == kept["pii"]


@needs_tables
def test_oracles(spark):
    duckdb = pytest.importorskip("duckdb")
    from orrery.llm.queries import ORACLES, QUERIES

    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    for name, sql in ORACLES.items():
        want = duck.execute(sql).fetchdf()
        got = QUERIES[name](spark, SF).toPandas()[list(want.columns)]
        assert sorted(map(str, got.itertuples(index=False))) == sorted(map(str, want.itertuples(index=False))), name


def test_very_long_texts(spark):
    words = " ".join(f"w{k}" for k in range(120_000))
    docs = spark.createDataFrame([(1, words), (2, words + " you idiot"), (3, "x" * 300_000)], "doc_id long, text string")
    scored = {r.doc_id: r.score for r in toxicity.score(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()}
    assert scored == {1: 0.1, 2: 0.9, 3: 0.1}
    assert {r.doc_id: r.n_tokens for r in class_lm.score(docs, LM).collect()} == {1: 120_001, 2: 120_003, 3: 2}
    assert len(sharding.shard(docs).collect()) == 3


def test_null_and_repeated_ids(spark):
    big = 2**62 + 1
    rows = [(None, "some text of a@b.org"), (None, None), (big, "more text"), (big, "more text"), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ids = sorted(str(r[0]) for r in rows)
    labels = spark.createDataFrame([(1, 1), (big, 0)], "doc_id long, toxic int")
    for got in (pii.find(df), toxicity.score(df, labels), class_lm.score(df, class_lm.Params(classes=3)), packing.pack(df), sharding.shard(df), license_scan.scan(df), quality_rules.ledger(df)):
        assert sorted(str(r.doc_id) for r in got.collect()) == ids
    pages = spark.createDataFrame([(None, None, None), (big, "u", "<p>x"), (big, "u", "<p>x")], "page_id long, url string, html string")
    assert sorted(str(r.page_id) for r in html_extraction.extract(pages).collect()) == sorted(["None", str(big), str(big)])

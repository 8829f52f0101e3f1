"""Near copies, benchmark passages and shards against brute force."""

import hashlib
import random
import re
import zlib

from orrery.llm import decontamination, near_dedup, sharding

SPACE = r"[^\x20\x09-\x0D]+"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def corpus(seed=3):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    prose = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    texts = [None, "", "  ", "one two", "ONE two", "one two three"]
    passage = prose(60)
    for _ in range(25):
        texts.append(" ".join(passage + prose(draw.randint(20, 60))))  # share a passage, are no copies
    for _ in range(6):
        base = prose(draw.randint(30, 150))
        texts.append(" ".join(base))
        for _ in range(draw.randint(1, 12)):  # near copies, and chains of them
            base = list(base) if draw.random() < 0.5 else base
            base[draw.randrange(len(base))] = "changed" + str(draw.random())
            texts.append(" ".join(base))
        texts.append(" ".join(base).upper())
    texts += [" ".join(prose(80)) for _ in range(20)]
    return texts


def shingles(text, n):
    w = re.findall(SPACE, lower(text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(texts, n):
    sets = [shingles(t, n) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in range(len(texts))}


def frame(spark, texts):
    return spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, component_id int")


def test_near_copies_equal_brute_force(spark):
    texts = corpus()
    for n in (4, 5):
        got = near_dedup.assign(frame(spark, texts), near_dedup.Params(shingle=n)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, n)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_copies_with_short_sketches_still_equal_brute_force(spark):
    texts = corpus(9)
    p = near_dedup.Params(shingle=4, k=24, overlap=7, broadcast_rows=0)
    got = near_dedup.assign(frame(spark, texts), p).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, 4)


def test_near_copies_without_chance_and_with_hot_centres_in_pieces(spark):
    texts = corpus(11)
    for p in (near_dedup.Params(shingle=4, **near_dedup.EXACT), near_dedup.Params(shingle=4, block_rows=2), near_dedup.Params(shingle=4, k=24, overlap=7, broadcast_rows=0, block_rows=3, star_rounds=0)):
        got = near_dedup.assign(frame(spark, texts), p).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, 4)


def test_a_very_long_text_and_its_near_copy(spark):
    words = [f"w{k}" for k in range(60_000)]
    got = {r.doc_id: r.component_id for r in near_dedup.assign(frame(spark, [" ".join(words), " ".join(words[5_000:]), " ".join(words[30_000:])])).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_near_copies_among_repeated_rows(spark):
    texts = corpus(5)
    rows = [(k, t) for k, t in enumerate(texts)] + [(k, texts[k]) for k in range(6, len(texts), 2)]
    got = near_dedup.assign(spark.createDataFrame(rows, "doc_id long, text string"), near_dedup.Params(shingle=4, k=24, overlap=7)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, 4)


def test_near_copies_of_odd_tables(spark):
    assert near_dedup.assign(frame(spark, [])).count() == 0
    same = spark.createDataFrame([(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.assign(same).collect()}
    assert got == {(1, 1, True), (2, 1, False), (None, None, True)}
    lent = spark.createDataFrame([(5, "a b c d e f"), (1, "a b c d e f"), (5, ""), (6, None), (6, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.assign(lent).collect()) == [(1, 1, True), (5, 1, False), (5, 1, False), (6, 6, True), (6, 6, True)]


def brute_hits(texts, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    out = {}
    for k, text in enumerate(texts):
        w, hit, found = cut(text), set(), set()
        for item, passage in items:
            v = cut(passage)
            n = min(len(v), 10)
            for i in range(len(v) - n + 1 if v else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[i : i + n]:
                        hit |= set(range(j, j + n))
                        found.add(str(item))
        out[k] = (len(w), len(hit), len(found), ",".join(sorted(found)))
    return out


def test_passages_equal_brute_force(spark):
    draw = random.Random(4)
    v = [f"t{k}" for k in range(30)]
    prose = lambda n: " ".join(draw.choice(v) for _ in range(n))
    items = [(k, prose(draw.choice([1, 2, 3, 5, 9, 10, 11, 25, 40]))) for k in range(12)] + [(50, None), (51, " ... "), (100, "same words twice over here"), (101, "Same-words, twice over here!")]
    items += [(60, "x " * 30)]
    texts = [None, "", "...", "Same words; TWICE over-here and on", "x " * 50, prose(3)]
    for _ in range(30):
        _, passage = draw.choice([i for i in items if i[1]])
        cut = passage.split()
        texts.append(prose(draw.randint(0, 20)) + " " + " ".join(cut[draw.randint(0, max(0, len(cut) - 10)) :]).upper() + " " + prose(draw.randint(0, 20)))
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, h int")
    bench = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, doc_id int")
    want = brute_hits(texts, items)
    for p in (decontamination.Params(), decontamination.Params(broadcast_rows=0), decontamination.Params(shingle=2)):
        got = decontamination.decontaminate(docs, bench, p).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, ",".join(r.item_ids)) for r in got} == want
    assert {r.n_hit for r in decontamination.decontaminate(docs, bench.limit(0)).collect()} == {0}
    assert decontamination.decontaminate(docs.limit(0), bench).count() == 0


def test_common_shingles_of_an_item_are_not_looked_up(spark, monkeypatch):
    """Two hundred documents repeat a shingle of an item that has a rarer one."""
    common = " ".join(["one", "two", "three", "four"] * 50)
    item = "one two three four rare words end this very window"
    rows = [(k, common) for k in range(200)] + [(200, "so " + item), (201, "rare words end"), (None, item), (None, "clean")]
    seen = []
    monkeypatch.setattr(decontamination, "matches", lambda *a, f=decontamination.matches: [out := f(*a), seen.append(out.count())][0])
    got = decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("i", item)], "item_id string, text string")).collect()
    assert sorted((str(r.doc_id), r.n_hit) for r in got if r.n_hit) == [("200", 10), ("None", 10)] and len(got) == 204
    assert seen == [2]


def test_a_passage_in_a_very_long_text(spark):
    words = [f"w{k}" for k in range(100_000)]
    rows = decontamination.decontaminate(frame(spark, [" ".join(words)]), spark.createDataFrame([("i", " ".join(words[70_000:70_030]))], "item_id string, text string")).collect()
    assert [(r.n_words, r.n_hit) for r in rows] == [(100_000, 30)]


def test_shards(spark):
    texts = ["same"] * 37 + [f"pair {k // 2}" for k in range(60)] + [f"single {k}" for k in range(200)] + [None, "", "é"]
    df = frame(spark, texts)
    for p in (sharding.Params(shards=8), sharding.Params(shards=8, bucket_rows=10), sharding.Params(shards=8, bucket_rows=10, broadcast_rows=0)):
        rows = sharding.shard(df, p).collect()
        assert len(rows) == len(texts)
        by = {}
        for r in rows:
            t = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(t) + 16, zlib.crc32(t))
            by.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 8
        homes = {}
        for r in rows:
            homes.setdefault(texts[r.doc_id] or "", set()).add(r.shard)
        pairs = [len(h) for t, h in homes.items() if t.startswith("pair")]
        assert sum(n == 1 for n in pairs) >= 27  # of 30
        assert len(homes["same"]) <= 2  # 37 of 300 rows are one shard's quota
    assert sharding.shard(df.limit(0)).count() == 0
    few = sharding.shard(df.limit(3), sharding.Params(shards=8)).collect()
    assert sorted(r.slot for r in few) == [0, 0, 0] and len({r.shard for r in few}) == 3
    assert hashlib.sha256 and sharding.shard(spark.createDataFrame([(None, "a"), (None, "a"), (1, None)], "doc_id long, text string")).count() == 3

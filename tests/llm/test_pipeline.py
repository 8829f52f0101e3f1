"""The pipeline against a plain model of its five stages, over rows without ids, repeated ids, null texts and clashing columns."""

import random
import re
import zlib

import numpy as np
import pytest

from orrery.llm import filters, toxicity
from orrery.llm.store import shared_folder

pipeline = pytest.importorskip("corpus_pipeline")

ITEM = "the very passage of the benchmark that no document may hold"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def rows():
    draw = random.Random(8)
    prose = lambda n: " ".join(draw.choice("abcdefgh") + draw.choice("klmnop") + str(draw.randint(0, 30)) for _ in range(n))
    base = [prose(40) for _ in range(12)]
    near = base[3].split()
    near[0] = "changed"
    texts = [(k, t) for k, t in enumerate(base)] + [(20, base[2]), (21, " ".join(near)), (22, base[5] + " " + ITEM), (23, "you utter idiot " + base[6]), (24, prose(40) + " write to someone@host.org or 10.0.0.1")]
    texts += [(None, base[1]), (None, base[1]), (None, ITEM), (None, "what an idiot"), (None, None), (None, "")]  # each a document of its own
    texts += [(30, None), (31, ""), (32, "short"), (33, "SHORT")]
    texts += [(40, base[8]), (40, base[8] + " and more"), (41, "clean words here"), (41, "idiot"), (42, "few"), (42, ITEM), (5, "")]  # one document each
    return [(k, t, "en", "s", len(t or ""), "x", 7, t) for k, t in texts]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, held_out string, row int, _id string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def dropped(data, bad):
    """Rows but those that are bad, or share an id with one that is."""
    ids = {r[0] for r in data if r[0] is not None and bad(r[1])}
    return [r for r in data if r[0] not in ids and not (r[0] is None and bad(r[1]))]


def toxic(text):
    return any(w in toxicity.INSULTS for w in toxicity.LETTERS.findall((text or "").lower()))


def without_copies(data):
    keyed = [r for r in data if r[0] is not None]
    root = {r[0]: r[0] for r in keyed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(r[0], shingles(r[1])) for r in keyed]
    for a, s in sets:
        for b, t in sets:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    best = {}
    for r in keyed:
        if find(r[0]) == r[0] and (r[0] not in best or len(r[1] or "") > len(best[r[0]][1] or "")):
            best[r[0]] = r
    return [*best.values(), *(r for r in data if r[0] is None)]


def contaminated(text):
    w, item = plain_words(text), plain_words(ITEM)
    return any(w[i : i + 10] == item[j : j + 10] for i in range(len(w) - 9) for j in range(len(item) - 9))


def redacted(text):
    return text if text is None else re.sub(r"\d+\.\d+\.\d+\.\d+", "[IP]", re.sub(r"[\w.]+@[\w-]+(?:\.[\w-]+)+", "[EMAIL]", text))


@pytest.fixture
def tables(spark, tmp_path):
    def write(data):
        spark.createDataFrame(data, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame([(1, 0, 0), (None, 1, 0)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
        spark.createDataFrame([(1, ITEM, 5)], "item_id long, text string, doc_id int").write.parquet(str(tmp_path / "benchmark.parquet"))
        return str(tmp_path)

    return write


def plain(found):
    return sorted(map(str, (tuple(r) for r in found)))


def test_every_stage_equals_a_plain_model(spark, tables):
    from tokenizers import Tokenizer
    import public_tokenizers

    data = rows()
    at = tables(data)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    models = {"toxicity": lambda d: dropped(d, toxic), "near_dedup": without_copies, "decontamination": lambda d: dropped(d, contaminated), "pii": lambda d: [(r[0], redacted(r[1]), *r[2:4], None if r[1] is None else len(redacted(r[1])), *r[5:]) for r in d]}
    now, want = docs, data
    for name, stage in pipeline.STAGES[:-1]:
        path = f"{at}/{name}"
        stage(spark, now, at).write.parquet(path)
        now, want = spark.read.parquet(path), models[name](want)
        assert now.columns == docs.columns
        assert plain(now.collect()) == plain(want), name
    assert {r[0] for r in want} == {0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 24, 30, 31, 32, None} and sum(r[0] is None for r in want) == 4

    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = lambda t: np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    pieces = [(r[0], 0, len(ids(r[1])), zlib.crc32(ids(r[1]).tobytes()), len(ids(r[1])), 0) for r in want]
    got = pipeline.run(spark, at).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()
    assert plain(r[:-1] for r in got) == plain(pieces)
    assert sorted(r.offset for r in got) == list(np.cumsum([0, *(r.length for r in sorted(got, key=lambda r: r.offset))])[:-1])


def test_an_empty_table_passes_all_stages(spark, tables):
    assert pipeline.run(spark, tables([])).count() == 0


def test_a_run_leaves_only_its_result(spark, tables):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = tables(rows())
    top = hadoop.Path(shared_folder(spark))
    listed = lambda: {str(s.getPath()) for s in top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(top)}
    before = listed()
    out = pipeline.run(spark, at)
    new = listed() - before
    assert len(new) == 1 and out.count() > 0
    inside = hadoop.Path(new.pop())
    assert len(inside.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(inside)) == 1


def test_filters(spark):
    docs = spark.createDataFrame([(1, "a", 1), (1, "bb", 2), (2, "c", 3), (None, "d", 4), (None, "d", 4)], "doc_id long, text string, _of int").repartition(2)
    ids = lambda *k: spark.createDataFrame([(x,) for x in k], "doc_id long")
    texts = lambda df: sorted(r.text for r in df.collect())
    assert texts(filters.only(docs, ids(1, None, 1))) == ["a", "bb", "d", "d"] and texts(filters.without(docs, ids(1, None))) == ["c", "d", "d"]
    assert texts(filters.one_each(docs)) == ["bb", "c", "d", "d"] and filters.one_each(docs).columns == docs.columns
    assert filters.one_each(docs.limit(0)).count() == filters.only(docs.limit(0), ids(1)).count() == 0
    keys = [r._key for r in filters.keyed(docs).collect()]
    assert sorted(keys)[:3] == ["1", "1", "2"] and len(set(keys)) == 4

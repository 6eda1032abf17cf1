"""The exact k best rows of each query, against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from quarrykit.operators import best, search


def test_terms_shared_by_all_and_by_few(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd", *(f"w{i}" for i in range(60))]) for _ in range(rng.randrange(1, 30))) for _ in range(150)]
    texts += [texts[0]] * 20 + ["", None, "x"]
    rows = [(i if i != 7 else None, t) for i, t in enumerate(texts)] + [(3, "aa w1"), (3, "w1 dd dd")]
    tf: dict = {}
    for i, t in rows:
        words = (t or "").split() if t != "x" else []
        tf.setdefault(i, Counter()).update(words + [" ".join(p) for p in zip(words, words[1:])])
    total = sum(tf.values(), Counter())
    kept = sorted(total, key=lambda x: (-total[x], x))[:400]
    df = Counter(x for c in tf.values() for x in c)
    vectors = {}
    for i, c in tf.items():
        w = {x: c[x] * (math.log((1 + len(rows)) / (1 + df[x])) + 1) for x in c.keys() & set(kept)}
        norm = math.sqrt(sum(v * v for v in w.values()))
        vectors[i] = {x: v / norm for x, v in w.items()}
    want = set()
    for q in (i for i in vectors if i is not None and i % 5 == 0):
        scores = [(-round(sum(v * vectors[q][x] for x, v in w.items() if x in vectors[q]), 6), i is None, i) for i, w in vectors.items() if w.keys() & vectors[q].keys()]
        want |= {(q, i, -s, rank + 1) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:4])}
    for name, value in (("QUERIES", 10), ("HELD", 30), ("CHUNK", 16)):
        monkeypatch.setattr(best, name, value)
    v = search.tfidf_vectors(spark.createDataFrame(rows, "id long, t string"), "id", "t", vocabulary=400)
    got = best.sharing_top(v, v.where("id % 5 = 0").withColumnRenamed("id", "query"), "id", "query", 4).collect()
    assert {(r.query, r.id, r.score, r.rank) for r in got} == want and len(got) == len(want)


def test_pairs_whose_bound_is_too_low_are_not_scored(spark, monkeypatch):
    rng = np.random.default_rng(4)
    weights = np.zeros((1200, 900))
    for i, x in enumerate(weights):  # half of the weight lies on thirty of the terms, the rest on terms that few rows hold
        x[rng.integers(0, 30, 12)], x[rng.integers(30, 900, 25)] = 1, 1 + i % 3
    weights[5], weights[900:910] = 0, weights[17]
    weights /= np.sqrt((weights**2).sum(1))[:, None].clip(1e-9)
    lists = [np.flatnonzero(x) for x in weights]
    table = pa.table({"id": np.arange(1200), "terms": [x.astype(np.int32) for x in lists], "weights": [w[x] for w, x in zip(weights, lists)]})
    asked = table.filter(pa.array(np.arange(1200) % 10 == 0)).rename_columns(["query", "terms", "weights"])
    for name, value in (("GROUPS", 12), ("FREQUENT", 0.2), ("CHUNK", 64), ("PRODUCTS", 500)):
        monkeypatch.setattr(best, name, value)
    block = best._Block(asked, "terms", "weights", np.full(120, np.inf))
    row, term, weight = best._csr(table.column("terms"), table.column("weights"))
    known = term < block.size
    near, true = block.bounds(row[known], term[known], weight[known], 1200), weights @ weights[::10].T
    assert (block.group >= 0).sum() > best.GROUPS and (block.group < 0).sum() > 500  # both kinds of terms are there
    assert (near >= true).all() and ((near > 0) >= (true > 0)).all() and (near - true).mean() < 0.2
    scored, products = [], best._Block.products
    monkeypatch.setattr(best._Block, "products", lambda self, *a: scored.append(len(a[-1])) or products(self, *a))
    found = {}
    for floor in (np.full(120, np.inf), -np.sort(np.round(true[:300], 6), axis=0)[-4]):
        block.floor, kept = floor, best.Kept(120, 4, pa.int64())
        best._sharing(table.to_batches()[0], block, kept)
        found[len(found)] = sum(scored)
        scored.clear()
        got = kept.table().filter(pc.less_equal(kept.table().column("key"), 0))
        for q in range(120):
            s = np.round(true[:, q], 6)
            want = [i for i in np.lexsort((np.arange(1200), -s))[:4] if true[i, q] > 0]
            mine = got.filter(pc.equal(got.column("query"), q))
            assert mine.column("id").to_pylist() == want and np.allclose(mine.column("score"), s[want], atol=1.1e-6)
    assert found[1] < found[0] < 0.5 * 120 * 1200


def test_a_sample_gives_the_first_bounds(spark, monkeypatch):
    words = F.expr("transform(sequence(1, 6), i -> concat('t', pmod(xxhash64(id, i), 40 + 20 * i)))")
    docs = spark.range(1500).select("id", F.concat_ws(" ", words).alias("t")).unionAll(spark.createDataFrame([(None, "t1 t2"), (1501, "")], "id long, t string"))
    v = search.tfidf_vectors(docs, "id", "t")
    asked = v.where("id % 20 = 0").withColumnRenamed("id", "query")
    plain = best.sharing_top(v, asked, "id", "query", 3).collect()
    floors, made = [], best._floors
    monkeypatch.setattr(best, "SAMPLE", 300)
    monkeypatch.setattr(best, "_floors", lambda *a: floors.append(made(*a)) or floors[-1])
    assert sorted(best.sharing_top(v, asked, "id", "query", 3).collect()) == sorted(plain) and len(plain) == 225
    assert len(floors) == 1 and len(floors[0]) == 75 and np.isfinite(floors[0]).sum() > 60


def test_copies_are_scored_once(spark, monkeypatch):
    texts = F.concat_ws(" ", F.expr("transform(sequence(1, 5), i -> concat('t', pmod(xxhash64(pmod(id, m), i), 30)))"))
    answers, searched, top = {}, [], best._top
    monkeypatch.setattr(best, "_top", lambda df, name, asked, *a: searched.append((df.count(), asked.count())) or top(df, name, asked, *a))
    for contents in (40, 350):
        docs = spark.range(400).withColumn("m", F.lit(contents)).select("id", texts.alias("t")).unionAll(spark.createDataFrame([(None, "t1 t2"), (500, "t1 t2")], "id long, t string"))
        for most in (1000, 0):
            monkeypatch.setattr(best, "NAMES", most)
            v = search.tfidf_vectors(docs, "id", "t")
            rows = best.sharing_top(v, v.where("id % 10 = 0").withColumnRenamed("id", "query"), "id", "query", 4).collect()
            answers[contents, most] = sorted((r.query, r.rank, r.id is None, r.id or 0, r.score) for r in rows)
        assert answers[contents, 1000] == answers[contents, 0] and len(answers[contents, 0]) == 41 * 4
    assert [n for n, _ in searched] == [42, 402, 352, 402] and searched[0][1] <= 5


def test_a_vocabulary_ends_among_terms_as_frequent_as_its_last(spark, monkeypatch):
    texts = ["bb aa", "CC dd", "ee ee ff", "aa\u212a gg", None, "x", "ff"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    total = Counter()
    for t in texts:
        words = [w for w in (t or "").lower().split() if len(w) > 1]
        total.update(words + [" ".join(p) for p in zip(words, words[1:])])
    want = sorted(total, key=lambda x: (-total[x], x))
    number = {int(search._words(pa.array([t]))[1][0]) if " " not in t else int(search._paired(search._words(pa.array([t]))[1], np.array([0]))[0]): t for t in want}
    kept, made = [], search._most_frequent
    monkeypatch.setattr(search, "_most_frequent", lambda *a: kept.append(made(*a)) or kept[-1])
    for most in (1000, 0):
        monkeypatch.setattr(search, "TIES", most)
        for size in (1, 2, 3, 7, len(want), 100):
            v = search.tfidf_vectors(df, "id", "t", vocabulary=size)
            assert {number[int(h)] for h in kept[-1]} == set(want[:size])
    assert {r.id for r in v.collect()} == {0, 1, 2, 3, 6}


@pytest.mark.parametrize("measure", ["distance", "cosine"])
def test_vectors_with_copies_nulls_and_zeros(spark, monkeypatch, measure):
    rng = random.Random(5)
    vectors = [[float(rng.randrange(-3, 4)) for _ in range(4)] for _ in range(120)] + [[1.0, 2.0, 0.0, 1.0]] * 40 + [[0.0] * 4, None, [1.0, None, 0.0, 2.0]]
    rows = list(enumerate(vectors))

    def score(a, b):
        if a is None or b is None or None in a or None in b:
            return None
        if measure == "distance":
            return float(best.rounded(math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b))), 5))
        n = sum(x * x for x in a) * sum(x * x for x in b)
        return float(best.rounded(sum(x * y for x, y in zip(a, b)) / math.sqrt(n), 5)) if n else math.nan

    def place(s):  # as SQL: nulls last, NaN the greatest number
        return (s is None, 0 if s is None else (math.inf if measure == "distance" else -math.inf) if math.isnan(s) else s if measure == "distance" else -s)

    want = []
    for q, a in rows[:160:10] + rows[160:]:
        scored = sorted(((score(a, b), i) for i, b in rows), key=lambda x: (place(x[0]), x[1]))[:6]
        want += [(q, i, str(s), rank + 1) for rank, (s, i) in enumerate(scored)]
    for name, value in (("QUERIES", 4), ("HELD", 20), ("ROWS", 50), ("CHUNK", 16)):
        monkeypatch.setattr(best, name, value)
    df = spark.createDataFrame(rows, "id long, v array<float>")
    asked = df.where("id % 10 = 0 OR id >= 160").select(F.col("id").alias("query"), "v")
    got = best.nearest_top(df, asked, "id", "v", "query", 6, measure).collect()
    assert sorted((r.query, r.id, str(r.score), r.rank) for r in got) == sorted(want)


def test_a_distance_that_is_nan_stands_before_null(spark):
    rows = [(0, [0.0, 1.0]), (1, None), (2, [float("nan"), 1.0]), (3, [0.0, 3.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    got = best.nearest_top(v, v.where("id = 0").withColumnRenamed("id", "query"), "id", "v", "query", 3, "distance").orderBy("rank").collect()
    assert [r.id for r in got] == [0, 3, 2] and math.isnan(got[2].score)


def test_tasks_of_vectors_follow_the_cores_until_their_rows_are_many():
    assert [best._tasks(n, 8) for n in (0, 1, 5_001, 600_000, 10_000_000)] == [1, 1, 2, 16, 200]


def test_an_index_has_files_of_the_same_size_whatever_the_input(spark, tmp_path, monkeypatch):
    from quarrykit.operators import text_index

    monkeypatch.setattr(text_index, "PART", 400)
    monkeypatch.setattr(text_index, "MOST", 5)
    docs = spark.createDataFrame([(i, f"the fox {i % 7}x the") for i in range(200)] + [(3, "fox")], "id long, t string")
    index = text_index.TextIndex(spark, str(tmp_path), 2)
    index.add(docs, "id", "t")
    index.delete(spark.range(0, 20), "id")
    index.add(docs.where("id < 10"), "id", "t")
    for files in (3, 3):
        folder = sorted(index.state["segments"])[0]
        assert len(list((tmp_path / "postings" / folder).glob("bucket=*/*.parquet"))) >= files
        found = {r.id: r.positions for r in index.postings(["the"]).collect()}
        assert set(found) == {*range(10), *range(20, 200)} and all(p == [0, 3] for p in found.values())
        assert {r.id: r.positions for r in index.postings(["fox"]).collect()}[3] == [0, 1]
        index.merge()


def test_a_task_of_an_index_has_one_share_of_one_bucket(spark, tmp_path, monkeypatch):
    from quarrykit.operators import text_index

    monkeypatch.setattr(text_index, "PART", 500)
    docs = spark.createDataFrame([(i, f"the fox {i % 7}x the") for i in range(200)], "id long, t string")
    index = text_index.TextIndex(spark, str(tmp_path), 4)
    index.add(docs, "id", "t")
    for _ in range(2):
        names = [p.name.split("-")[1] for p in (tmp_path / "postings" / max(index.state["segments"])).glob("bucket=*/*.parquet")]
        assert len(names) > 4 and len(names) == len(set(names))  # a name begins with its task's number
        assert {r.id: r.positions for r in index.postings(["the"]).collect()} == {i: [0, 3] for i in range(200)}
        index.merge()


def test_a_task_that_makes_postings_has_a_share_of_the_text(spark, tmp_path, monkeypatch):
    from quarrykit.operators import text_index

    monkeypatch.setattr(text_index, "PART", 1_000_000)
    monkeypatch.setattr(text_index, "TEXTS", 2_000_000)
    seen, put, setting = [], text_index.TextIndex._put, "spark.sql.files.maxPartitionBytes"

    def counted(self, lists, size, folder):
        tasks = lists.groupBy(F.spark_partition_id()).agg(F.sum(F.size("positions")))  # words of each task before the shares are dealt
        seen.append(([r[1] for r in tasks.collect()], self.spark.conf.get(setting)))
        put(self, lists, size, folder)

    monkeypatch.setattr(text_index.TextIndex, "_put", counted)
    before = spark.conf.get(setting)
    text = F.concat_ws(" ", F.expr("transform(sequence(1, 2000), i -> hex(xxhash64(id, i)))"))
    spark.range(0, 400, 1, 1).select("id", text.alias("t")).write.parquet(str(tmp_path / "docs"))  # one file, 13 MB of text
    docs = spark.read.parquet(str(tmp_path / "docs"))
    index = text_index.TextIndex(spark, str(tmp_path / "index"), 2)
    index.add(docs, "id", "t")
    index.add(docs.unionAll(docs).where("id < 200"), "id", "t")  # ids twice
    index.merge()
    total = [sum(words) for words, _ in seen]
    assert total == [800_000, 800_000, 1_200_000] and index.any_of(["nothere"]).count() == 0
    assert all(max(words) < total[i] / 3 for i, (words, _) in enumerate(seen))
    assert seen[2][1] == "2000000" and spark.conf.get(setting) == before


def test_rules_that_are_a_literal_are_tested_where_it_stands():
    from quarrykit.operators import rules

    block = (("a", r"\bfoxes\b", False), ("b", r"(?i)\bfoxes", False), ("c", r"foxes$", False), ("d", r"^Fo[xy]es", False))
    compiled = rules._compiled(block)
    assert len(compiled) == 4 and {0, 2} <= compiled[3] and 3 not in compiled[3]
    for text in ("foxesx foxes a", "xfoxes", "FOXES", "İİ foxes", "a foxes", "Foxes foxesé", ""):
        assert rules._met(text, *compiled) == [i for i, (_, p, _) in enumerate(block) if __import__("re").search(p, text)]

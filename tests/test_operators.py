"""Operators of the corpus on small tables, with answers worked out by hand or by plain Python."""

import datetime as dt
import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrykit.functions import columns as c
from quarrykit.functions import udfs
from quarrykit.operators import dedupe, graph, payloads, plans, search
from quarrykit.sources import archives, sinks
from quarrykit.sources import files as src
from quarrykit.streaming import jobs


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect())


def one(spark, value, kind, column):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("name", "ext"), [("a.PDF", ".pdf"), ("x.tar.gz", ".gz"), (".bashrc", ""), ("none", ""), ("", "")])
def test_extension(spark, name, ext):
    assert one(spark, name, "string", c.extension) == ext


def test_buckets(spark):
    got = {e: one(spark, e, "string", c.bucket) for e in (".pdf", ".jpg", ".mp3", ".what")}
    assert got == {".pdf": "Documents", ".jpg": "Images", ".mp3": "Music", ".what": "Other"}


@pytest.mark.parametrize("size", [0, 65536, 65537, 131072, 131073])
def test_quick_signature(spark, size):
    import hashlib

    data = bytes(i % 251 for i in range(size))
    got = one(spark, data, "binary", c.quick_signature)
    tail = data[max(65536, size - 65536) :] if size > 65536 else b""
    assert (got.size, got.head_sha1, got.tail_sha1) == (size, hashlib.sha1(data[:65536]).hexdigest(), hashlib.sha1(tail).hexdigest())


@pytest.mark.parametrize(("n", "chunks"), [(0, 0), (1, 1), (600, 2), (601, 2), (1120, 3)])
def test_chunks(spark, n, chunks):
    words = [f"w{i}" for i in range(n)]
    got = one(spark, " ".join(words), "string", c.chunks)
    assert len(got) == chunks
    assert sorted({w for part in got for w in part.split()}) == sorted(words)


def test_letters(spark):
    got = {n: one(spark, n, "int", c.letters) for n in (1, 26, 27, 52, 53, 702)}
    assert got == {1: "A", 26: "Z", 27: "AA", 52: "AZ", 53: "BA", 702: "ZZ"}


def test_layer_norm(spark):
    x = [1.0, 2.0, 4.0]
    got = one(spark, x, "array<double>", c.layer_norm)
    assert np.allclose(got, (np.array(x) - np.mean(x)) / np.sqrt(np.var(x) + 1e-5))


def test_numbers_have_no_gap(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = dedupe.numbered(df, ["k"], "n", 5).collect()
    assert sorted((r.k, r.n) for r in got) == [(i, i + 5) for i in range(1000)]


def test_dedupe(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, "a", 4), (4, "b", None), (5, None, 1)], "id long, h string, age int")
    assert rows(dedupe.keep_oldest(df, "h", "age", "id"), "loser", "winner") == [(1, 3), (2, 3)]
    assert rows(dedupe.duplicate_groups(df.where("h IS NOT NULL"), "h", "id"), "h", "copies", "members") == [("a", 3, [1, 2, 3])]
    s = dedupe.summary(df.fillna(0), "h", "age").first()
    assert s.total == 5 and s.unique_rows + s.duplicates == s.total
    full = dedupe.two_phase(df.where("h IS NOT NULL"), ["h"], F.col("h"), ["id"], "id")
    assert rows(full, "id", "canonical_id") == [(1, 1), (2, 1), (3, 1), (4, 4)]


def test_row_changes(spark):
    old = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, s string")
    new = spark.createDataFrame([(2, "x"), (3, "z"), (3, "y")], "id long, s string")
    assert rows(dedupe.insert_new(old, new, "id", ["s"]), "id", "s") == [(1, "a"), (1, "a"), (2, "b"), (3, "y")]
    merged = dedupe.merge_edges(old, new)
    assert rows(dedupe.merge_edges(merged, new), "id", "s") == rows(merged, "id", "s")
    assert rows(dedupe.upsert(old, new.limit(1), "id"), "id", "s") == [(1, "a"), (1, "a"), (2, "x")]
    assert rows(dedupe.most_recent(spark.createDataFrame([(1, 5), (2, 9), (1, 10)], "k int, p int"), "k", "p", 1), "k", "last") == [(1, 10)]


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8)], "src long, dst long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert rows(graph.neighbours(edges, ids(2)), "id") == [1, 2, 3]
    assert rows(graph.between(edges, ids(1, 2, 9)), "src", "dst") == [(1, 2)]
    parents = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (10, 11), (11, 10), (7, 99)], "id long, parent long")
    assert rows(graph.below(parents, 1, 9), "id") == [2, 3, 4, 5, 6]
    assert rows(graph.below(parents, 10, 6), "id") == [10, 11]
    folders = spark.createDataFrame([("/a",), ("/a/b",), ("/c",)], "folder string")
    assert rows(graph.empty_folders(folders, spark.createDataFrame([("/a/b/x.txt",)], "path string")), "folder") == ["/c"]


def test_full_text(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "fox red"), (3, "red red fox foxes"), (4, None)], "id long, t string")
    index = search.postings(docs, "id", "t")
    assert rows(search.match_all(index, "id", ["red", "fox"]), "id") == [1, 2, 3]
    assert rows(search.match_phrase(index, "id", ["red", "fox"]), "id", "hits") == [(1, 1), (3, 1)]
    assert rows(search.match_prefix_not(index, "id", "fo", "foxes"), "id") == [1, 2]
    assert rows(search.keyword_top(docs, "id", "t", "RED", 2), "id", "score") == [(1, 1), (3, 2)]


def test_softmax_and_budget(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 2.0, True), ("a", 9.0, False), ("b", 1.0, False)], "g string, s double, m boolean")
    got = {(r.g, r.s): r.weight for r in search.masked_softmax(df, "g", "s", "m").collect()}
    assert got["b", 1.0] is None and got["a", 9.0] == 0 and abs(got["a", 1.0] + got["a", 2.0] - 1) < 1e-9
    parts = spark.createDataFrame([(i, 10) for i in range(5)], "i int, n int")
    assert rows(search.within_budget(parts, ["i"], "n", 21), "i") == [0, 1, 2]


def test_sources(spark, tmp_path):
    for name in ("a.TXT", "b.txt", "c.pdf", "sub/d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    found = src.scan_files(spark, [str(tmp_path), str(tmp_path / "missing")], [".txt"])
    assert [p.rsplit("/", 1)[1] for p in rows(found, "path")] == ["a.TXT", "b.txt", "d.txt"]
    assert set(rows(found, "root")) == {str(tmp_path)}
    with pytest.raises(FileNotFoundError):
        src.scan_files(spark, [str(tmp_path / "missing")], on_missing="error")
    (tmp_path / "c.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert rows(src.read_corpus(spark, str(tmp_path / "c.jsonl"), "a int"), "a") == [1, 2]
    (tmp_path / "m.json").write_text('[{"id": "F", "rules": ["x"]}, {"id": "G"}]')
    assert rows(src.read_manifest(spark, str(tmp_path / "m.json"), ["rules"], ["id"]), "id", "rules") == [("F", ["x"]), ("G", [])]
    (tmp_path / "n.csv").write_text("id:ID,label\n1,Document\n2,Name\n")
    assert rows(src.read_graph(spark, str(tmp_path / "n.csv"), {"id": ["id", "id:ID"], "label": ["label"], "none": ["z"]}).drop("none"), "id", "label") == [("1", "Document"), ("2", "Name")]
    assert one(spark, b"caf\xe9", "binary", lambda x: src.decoded(x, 10)) == "café" == one(spark, "café".encode(), "binary", lambda x: src.decoded(x, 10))


def test_archives(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name in ("ok.txt", "../bad.txt", "/abs.txt", "d/in.txt"):
            z.writestr(name, name)
    files = spark.createDataFrame([("x.zip", data.getvalue()), ("y.zip", b"broken"), ("z.zip", None)], "path string, content binary")
    assert rows(archives.zip_members(files, True), "container", "member", "content") == [("x.zip", "d/in.txt", b"d/in.txt"), ("x.zip", "ok.txt", b"ok.txt")]


def test_sniffing():
    for d in ",\t;|":
        assert udfs.sniff_csv(f"a{d}b\n1{d}2\n") == (["a", "b"], d, 1)
    cases = {"": ("empty", []), "[{\"b\":1,\"a\":2}]": ("array", ["a", "b"]), '{"k":1}': ("object", ["k"]), "3": ("scalar", []), "{": ("unparseable", []), '{"a":1}\n{"a":2}': ("jsonl", ["a"])}
    assert {t: udfs.sniff_json(t) for t in cases} == cases
    assert udfs.partial_ratio("abc", "xxabcxx") == 100 and udfs.partial_ratio("abc", "") == 0


def test_secrets(spark):
    secret = "password=" + "abcdef0123"
    df = spark.createDataFrame([(1, f"here {secret} and {secret} end"), (2, "clean"), (3, None)], "id long, t string")
    got = udfs.secret_matches(df, "id", "t").collect()
    assert [r.start for r in got] == [5, 29] and all("abcdef" not in r.context for r in got)


def test_payloads(spark):
    raw = ['{"parties": [{"name": "P"}], "timeline": [{"date": "d"}]}', "{}", "not json", None]
    p = payloads.parsed(spark.createDataFrame(list(enumerate(raw)), "id long, raw string"), "raw")
    assert rows(p.select("id", payloads.first_name(F.col("parties"), "name").alias("n")), "id", "n") == [(0, "P"), (1, ""), (2, ""), (3, "")]
    assert rows(payloads.children(p, "id", "timeline"), "id", "date", "actor") == [(0, "d", "")]
    checked = spark.createDataFrame([('{"a": "x", "d": "2024-01-01", "l": ["q"]}',), ('{"d": "no", "l": 3}',), ("{",)], "j string")
    got = checked.select(payloads.issues(F.col("j"), ["a"], ["d"], ["l"]).alias("i")).collect()
    assert [r.i for r in got] == [[], ["missing a", "not a date d", "not a list l"], ["not JSON"]]
    assert "b" in payloads.with_column(checked, "b", "int").columns


def test_streams(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    day = lambda n: None if n is None else dt.datetime(2024, 1, n)
    arrivals = [[("k", day(5), 1), ("k", None, 2)], [("k", day(3), 3), ("j", day(1), 9)], [("k", day(4), 4)]]
    for i, batch in enumerate(arrivals):
        spark.createDataFrame(batch, "key string, age timestamp, id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("key string, age timestamp, id long").parquet(str(tmp_path / "in"))
        jobs.drain(jobs.keep_oldest_stream(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    losers = rows(spark.read.parquet(str(tmp_path / "out")), "loser", "winner")
    assert losers == [(1, 3), (2, 1), (4, 3)]
    for i in (1, 2):
        spark.createDataFrame([("p", i, f"t{i}"), (f"q{i}", i, "x")], "path string, v int, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "files"))
        stream = spark.readStream.schema("path string, v int, text string").parquet(str(tmp_path / "files"))
        rules = lambda b: b.where("text LIKE 't%'").select("path", F.col("text").alias("hit"))
        jobs.catalogue(stream, str(tmp_path / "table"), str(tmp_path / "cat"), "path", "v", rules, str(tmp_path / "hits"))
    assert rows(jobs.latest(spark, str(tmp_path / "table")), "path", "v") == [("p", 2), ("q1", 1), ("q2", 2)]
    assert rows(jobs.latest(spark, str(tmp_path / "hits")), "path", "hit") == [("p", "t2")]


def test_free_names(spark):
    moves = spark.createDataFrame([(1, "d", "a.txt"), (2, "d", "a.txt"), (3, "d", "a.txt"), (4, "d", "b"), (5, "e", "a.txt")], "id long, folder string, name string")
    taken = spark.createDataFrame([("d", "a (1).txt"), ("d", "b")], "folder string, name string")
    got = {r.id: (r.folder, r.final) for r in plans.free_names(moves, taken, ["id"]).collect()}
    assert got[1] == ("d", "a.txt") and got[4] == ("d", "b (1)") and got[5] == ("e", "a.txt")
    assert len(set(got.values())) == 5 and not set(got.values()) & {("d", "a (1).txt"), ("d", "b")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "a", ["x"])], "id long, s string, found array<string>")
    sinks.write_manifest(df.select("id", "s"), str(tmp_path / "m"), ["id"])
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "m/csv")), "id", "s") == [("1", "a"), ("2", "b")]
    sinks.write_findings(df, "found", str(tmp_path / "f"))
    assert rows(spark.read.json(str(tmp_path / "f")), "id") == [1]
    for _ in range(2):
        sinks.append_ledger(df, "seen", ["id"], str(tmp_path / "l"))
    assert sinks.read_ledger(spark, str(tmp_path / "l")).count() == 4
    sinks.write_graph(df.select("id", F.col("s").alias("kind")), df.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.col("s").alias("type")), str(tmp_path / "g"))
    assert spark.read.option("header", True).csv(str(tmp_path / "g/nodes")).columns == ["id:ID", ":LABEL"]
    sinks.write_lines(df, str(tmp_path / "t"), "s", ["id"])
    assert rows(spark.read.text(str(tmp_path / "t")), "value") == ["a", "b"]


def test_registry_names_every_oracle():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "dedupe_summary" in e.queries()


def test_fuzz_occurrences(spark):
    rng = random.Random(0)
    texts = ["".join(rng.choice("abAB ") for _ in range(rng.randrange(30))) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert rows(df.select("i", c.occurrences(F.col("t"), "ab").alias("n")), "i", "n") == [(i, t.lower().count("ab")) for i, t in enumerate(texts)]


def test_context_budget_of_short_documents(spark, tmp_path):
    from quarrykit.plans import catalog

    spark.range(1000).selectExpr("id AS doc_id", "CASE WHEN id % 10 = 0 THEN NULL ELSE 19L END AS n_chars", "'x' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(r.doc_id for r in catalog.QUERIES["w08_context_budget"](spark, str(tmp_path)).collect())
    kept, before = [], 0
    for i in range(1000):
        if before - 1 <= 16000:
            kept.append(i)
        before += 0 if i % 10 == 0 else 20
    assert got == kept and len(kept) > 200


@pytest.mark.parametrize(("n", "text"), [(625280, "610.62 KB"), (1152, "1.12 KB"), (1, "1.00 B"), (3 * 2**40, "3.00 TB")])
def test_human_size_halves_go_to_even(spark, n, text):
    assert one(spark, n, "long", c.human_size) == text


def test_decoded_cuts_no_character(spark):
    at = lambda data, n: one(spark, bytearray(data), "binary", lambda x: src.decoded(x, n))
    assert at("éééé..".encode(), 5) == "éé"
    assert at("aé".encode(), 100) == "aé"
    assert at("a€".encode(), 3) == "a"
    assert at(b"\x93x\x94 \xe9", 100) == "“x” é"
    assert at(b"", 5) == ""


def test_members_that_cannot_be_read(spark):
    import tarfile

    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.txt", b"plain")
        z.writestr("b.txt", b"locked")
    raw = bytearray(packed.getvalue())
    for mark, flag in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        raw[raw.rindex(mark) + flag] |= 1  # b.txt is marked as encrypted
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        for name in ("d/x.txt", "../bad"):
            info = tarfile.TarInfo(name)
            info.size = 2
            t.addfile(info, io.BytesIO(b"hi"))
    files = spark.createDataFrame([("z", raw), ("t", bytearray(tar.getvalue())), ("broken", bytearray(b"no")), ("none", None)], "path string, content binary")
    got = {r.member: (r.content and bytes(r.content), bool(r.error)) for r in archives.zip_members(files.where("path != 't'"), content=True).collect()}
    assert got == {"a.txt": (b"plain", False), "b.txt": (None, True)}
    assert [(r.member, bytes(r.content)) for r in archives.tar_members(files.where("path != 'z'"), content=True).collect()] == [("d/x.txt", b"hi")]
    assert archives.zip_members(files.where("path = 'z'"), content=True, most_bytes=2).where("error = 'too long'").count() == 2


def test_below_ends_in_cycles_and_walks_each_node_once(spark):
    parents = spark.createDataFrame([(2, 1), (3, 1), (4, 2), (4, 3), (5, 4), (1, 5), (9, None)], "id long, parent long")
    assert rows(graph.below(parents, 1, 10), "id") == [1, 2, 3, 4, 5]
    assert rows(graph.below(parents, 1, 2), "id") == [2, 3, 4]
    assert graph.below(parents, 77, 5).count() == 0


@pytest.mark.parametrize(("n", "label"), [(702, "ZZ"), (703, "AAA"), (18278, "ZZZ"), (18279, "AAAA"), (26**8, "YYYYYYYZ")])
def test_letters_have_no_end(spark, n, label):
    assert one(spark, n, "long", c.letters) == label


def test_partial_ratio_against_subsequences():
    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(4)
    texts = ["", "a", "é😀b", *("".join(rng.choices("abcé ", k=rng.randrange(14))) for _ in range(60))]
    for needle in ("abc", "é b", "cab ac"):
        n = len(needle)
        expected = [max(round(200 * common(needle, t[i : i + n]) / (n + min(n, len(t)))) for i in range(max(1, len(t) - n + 1))) if t else 0 for t in texts]
        assert udfs.partial_ratios(needle, texts).tolist() == expected


def test_passes_stop_at_their_budget_and_go_on(spark, tmp_path):
    for i in range(5):
        spark.range(i, i + 1).coalesce(1).write.parquet(f"{tmp_path}/in/part{i}")
    seen = []
    stream = lambda: jobs.file_stream(spark, f"{tmp_path}/in/*", "id long", most_files=2)
    work = lambda batch, n: seen.extend(r.id for r in batch.collect())
    assert jobs.budgeted_pass(stream(), work, f"{tmp_path}/state", batches=1) == 1
    assert len(seen) == 2
    while jobs.daemon_step(stream(), work, f"{tmp_path}/state", f"{tmp_path}/ledger"):
        pass
    assert sorted(seen) == [0, 1, 2, 3, 4]
    assert sinks.read_ledger(spark, f"{tmp_path}/ledger").count() == 3


def test_text_by_type(spark):
    from quarrykit.sources import extract

    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:r><w:t>One &amp; two</w:t></w:r></w:p><w:p><w:t xml:space='preserve'>three</w:t></w:p>")
    page = b"<html><script>x</script><p>Hi <b>you</b></p></html>"
    files = spark.createDataFrame([("a.DOCX", bytearray(packed.getvalue())), ("b.html", bytearray(page)), ("c.txt", bytearray(b" ")), ("d.bin", bytearray(b"x")), ("e.docx", bytearray(b"x")), ("f.md", None)], "name string, content binary")
    got = {r.name: (r.status, r.text) for r in extract.extracted(files, "name", "content").collect()}
    assert got == {"a.DOCX": ("done", "One & two\nthree"), "b.html": ("done", "Hi you"), "c.txt": ("empty", " "), "d.bin": ("unsupported", None), "e.docx": ("failed", None), "f.md": ("failed", None)}


def test_duplicates_as_rows(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None), (5, "y")], "id long, h string")
    assert rows(dedupe.duplicate_members(df, "h", "id"), "first", "member") == [(1, 1), (1, 2), (3, 3), (3, 4)]


def test_null_keys(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, "x"), (3, "k", "y"), (4, "k", None), (5, "k", None), (6, "j", "z")], "id long, k string, t string")
    assert rows(dedupe.with_canonical(df, ["k"], ["id"], "id"), "id", "canonical_id") == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 6)]
    assert rows(dedupe.two_phase(df, ["k"], F.md5("t"), ["id"], "id"), "id", "canonical_id") == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 6)]
    assert rows(dedupe.two_phase(df, ["k"], F.md5("t"), ["id"], "id", ["t"]), "id", "canonical_id") == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 6)]
    assert rows(dedupe.ranked(df, ["k"], ["id"], "n"), "id", "n") == [(1, 1), (2, 2), (3, 1), (4, 2), (5, 3), (6, 1)]
    assert rows(dedupe.keep_oldest(df.withColumn("a", F.lit(1)), "k", "a", "id"), "loser", "winner") == [(2, 1), (4, 3), (5, 3)]
    soft = search.masked_softmax(df.select("id", "k", F.lit(1.0).alias("s"), F.lit(True).alias("m")), "k", "s", "m")
    assert [round(x, 6) for _, x in rows(soft, "id", "weight")] == [0.5, 0.5, 0.333333, 0.333333, 0.333333, 1.0]
    empty = df.limit(0)
    assert dedupe.two_phase(empty, ["k"], F.md5("t"), ["id"], "id").count() == dedupe.ranked(empty, ["k"], ["id"], "n").count() == 0


def test_upsert_of_repeated_and_null_keys(spark):
    kind = "k string, v int, x string"
    old = spark.createDataFrame([("a", 1, "old"), (None, 1, "old"), ("b", 1, "old")], kind)
    new = spark.createDataFrame([("a", 2, "p"), ("a", 3, "q"), ("a", None, "r"), (None, 2, "n"), (None, 3, "m")], kind)
    once = dedupe.upsert(old, new, "k", "v")
    assert {(r.k, r.v, r.x) for r in once.collect()} == {("a", 3, "q"), (None, 3, "m"), ("b", 1, "old")}
    assert dedupe.upsert(once, new, "k", "v").count() == 3


def test_a_stuck_pass_raises(spark, tmp_path):
    import time

    spark.range(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    with pytest.raises(TimeoutError):
        jobs.budgeted_pass(stream, lambda batch, n: time.sleep(20), str(tmp_path / "state"), wait=1.0)


def test_text_index(spark, tmp_path):
    from quarrykit.operators.text_index import TextIndex

    kind = "doc_id long, text string, term string"
    docs = spark.createDataFrame([(1, "the cat and the hat", "x"), (2, "the dog and cat", "x"), (3, None, "x"), (None, "the cat", "x"), (4, "", "x"), (5, "THE CAT! cat-cat", "x")], kind)
    index = TextIndex(spark, str(tmp_path / "i"), 8)
    with pytest.raises(ValueError):
        index.all_of(["cat"])
    index.add(docs, "doc_id", "text")
    assert rows(index.all_of(["the", "cat"]), "id") == [1, 2, 5]
    assert rows(index.any_of(["cat", "hat", "none"]), "id", "hits") == [(1, 2), (2, 1), (5, 3)]
    assert rows(index.phrase(["the", "cat"]), "id", "hits") == [(1, 1), (5, 1)]
    assert rows(index.phrase(["cat", "cat"]), "id", "hits") == [(5, 2)]
    assert rows(index.without(index.prefix("ha"), ["dog"]), "id") == [1]
    plan = index.phrase(["the", "cat"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [", 1)[1].split("]")[0]
    # Another handle reads the same log; an added id hides its old rows, a deleted one all.
    other = TextIndex(spark, str(tmp_path / "i"))
    other.add(spark.createDataFrame([(1, "only dogs", "x"), (6, "the cat", "x")], kind), "doc_id", "text")
    other.delete(spark.createDataFrame([(2,), (None,), (99,)], "k long"), "k")
    assert rows(other.all_of(["cat"]), "id") == [5, 6] and rows(other.any_of(["dogs", "dog"]), "id", "hits") == [(1, 1)]
    assert rows(index.all_of(["cat"]), "id") == [1, 2, 5]  # as it was when opened
    with pytest.raises(Exception, match="lready exists"):
        index.delete(docs, "doc_id")
    other.add(docs.where("doc_id = 2"), "doc_id", "text")
    before = rows(other.any_of(["cat", "the", "only"]), "id", "hits")
    other.merge()
    other.drop_old()
    assert before == [(1, 1), (2, 2), (5, 4), (6, 2)] == rows(TextIndex(spark, str(tmp_path / "i")).any_of(["cat", "the", "only"]), "id", "hits")
    assert rows(other.frequencies(["cat", "dog"]), "term", "documents") == [("cat", 3), ("dog", 1)]
    assert len(list((tmp_path / "i/postings").iterdir())) == 1


def test_rules(spark, monkeypatch):
    import re

    from quarrykit.operators import rules

    assert [rules.literal(p) for p in ("abc", "a|b", "(?i)ABdE", "x?yz+w", "(foo)+bar", "[0-9]{4}", r"\bthe\b end", "(?i)task", "a(?=b)cd", "é+lan", "(?:ab|cd)ef")] == ["abc", "", "abde", "yz", "foo", "", "the end", "ta", "cd", "lan", "ef"]
    rng = random.Random(4)
    patterns = ["ab", "(?i)Ab", "a+b", "^b", "b$", r"\bab\b", "[ab]{3}", "(", "*", None, "", "x" * 5000, "(ab|ba)b", "a.b", "(?i)k", "a(?!b)", "é", "b(?i:A)b"]
    texts = [None, "", "K", "ſ", "É é", *("".join(rng.choice("abAB éK\n") for _ in range(rng.randrange(30))) for _ in range(120)), "a" * 3000]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in enumerate(texts)], "id long, text string, name int, rule_id string").repartition(3)
    table = spark.createDataFrame([(i, p) for i, p in enumerate(patterns)], "rule_id long, pattern string")

    def works(p):
        try:
            return bool(p) and len(p) <= rules.LONGEST and re.compile(p) is not None
        except re.error:
            return False

    want = sorted((i, str(j)) for i, t in enumerate(texts) for j, p in enumerate(patterns) if t is not None and works(p) and re.search(p, t))
    for block in (rules.BLOCK, 3):
        monkeypatch.setattr(rules, "BLOCK", block)
        assert rows(rules.hits(df, "id", "text", table), "id", "rule_id") == want
    assert rows(rules.faults(table), "rule_id") == ["11", "7", "8", "9"]
    words = spark.createDataFrame([("AB", "F1"), ("é", "F2"), ("ab", "F1"), (None, "F3")], "word string, form_id string")
    forms = sorted((i, f) for i, t in enumerate(texts) for w, f in (("ab", "F1"), ("é", "F2")) if t is not None and w in t.lower())
    assert rows(rules.keyword_forms(df, "id", "text", words), "id", "form_id") == forms
    assert rules.hits(df, "id", "text", table.limit(0)).count() == rules.hits(df.limit(0), "id", "text", table).count() == 0


def test_approximate_vectors(spark, monkeypatch):
    from quarrykit.operators import nearest

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24))
    points = centres[rng.integers(0, 12, 1500)] + 0.7 * rng.normal(size=(1500, 24))
    points[7] = points[8]
    points[:200] = points[0]  # a list with a great many copies
    df = spark.createDataFrame([(i, p.tolist(), 1) for i, p in enumerate(points)] + [(5000, None, 1), (5001, [0.0] * 24, 1)], "vid long, v array<double>, list int").repartition(5)
    monkeypatch.setattr(nearest, "ROWS", 60)
    monkeypatch.setattr(nearest, "QUERIES", 10)
    lists = nearest.fit(df, "vid", "v")
    index = nearest.assigned(df, "vid", "v", lists)
    assert index.count() == 1501 and lists.probes < len(lists.centroids)
    got = {}
    for r in nearest.approximate_top(index, df.where("vid % 10 = 0 OR vid > 1500"), "vid", "v", lists, 5).collect():
        got.setdefault(r.query, {})[r["rank"]] = r.id
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 5)
    hits = total = 0
    for i in range(200, 1500, 10):
        want = sorted(range(1500), key=lambda j: (-scores[i, j], j))[:5]
        assert set(got[i]) == {1, 2, 3, 4, 5}
        hits, total = hits + len(set(got[i].values()) & set(want)), total + 5
    assert hits / total >= 0.9 and [got[0][r] for r in range(1, 6)] == [0, 1, 2, 3, 4] and 5000 not in got
    none = df.limit(0)
    lists = nearest.fit(none, "vid", "v")
    assert nearest.approximate_top(nearest.assigned(none, "vid", "v", lists), none, "vid", "v", lists, 5).count() == 0


def test_cut_texts_say_so(spark, monkeypatch):
    from quarrykit.sources import extract

    monkeypatch.setattr(extract, "LIMIT", 4)
    df = spark.createDataFrame([("a.txt", b"long text"), ("b.txt", b"shrt"), ("c.txt", b""), ("d.bin", b"long text"), ("e.txt", None)], "name string, content binary")
    assert rows(extract.extracted(df, "name", "content"), "name", "status") == [("a.txt", "cut"), ("b.txt", "done"), ("c.txt", "empty"), ("d.bin", "unsupported"), ("e.txt", "failed")]


def test_differing_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dedupe, "BLOCK", 4)
    monkeypatch.setattr(dedupe, "BLOCKS", 2)
    monkeypatch.setattr(dedupe, "PAIRS", 100)
    data = [(i, "hot" if i < 90 else f"k{i % 7}" if i < 110 else None, i % 5 if i % 11 else None) for i in range(115)] + [(200, "alone", 1), (None, "hot", 9), (7, "hot", 6)]
    df = spark.createDataFrame(data, "id long, k string, v int")
    found = dedupe.differing_pairs(df, "k", "id", "v")
    want = sorted((a, b) for a, k, v in data for b, o, w in data if None not in (a, b, k, v, w) and k == o and a < b and v != w)
    assert rows(found, "a_id", "b_id") == want
    assert rows(dedupe.differing_pairs(df.where("id = 200"), "k", "id", "v"), "a_id", "b_id") == []


def test_the_file_of_all_pairs_stays_small(spark, tmp_path):
    from quarrykit.plans.catalog import QUERIES

    text = F.concat(F.lit("t"), F.col("id"))
    docs = spark.range(0, 240_000, 120).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.col("id").alias("n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    QUERIES["j05_contradiction_pairs"](spark, str(tmp_path)).write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 2000 * 1999 // 2
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 2000 * 1999 // 4

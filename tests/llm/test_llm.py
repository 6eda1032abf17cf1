"""Each operator against plain Python on small tables: nulls, empty and long texts, ties, repeats, clashing columns."""

import collections
import hashlib
import itertools
import os
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrykit.llm import decontam, langid, line_dedup, mixing, ngram_join, pii, quality_lm, quality_rules, scan, substring_dedup, warc
from quarrykit.plans.tables import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, component string"


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, None if i % 5 == 4 else "en", None if i % 7 == 6 else "s", len(t or ""), 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", "   \n\t ", "one", "One", "a b", "x" * 5000, "é è ü ß", "the the the the the the"]


def mutated(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
    return " ".join(words)


def brute_components(rows, k, percent):
    sets, parent = {}, {}
    for i, t in rows:
        w = words_of(lowered(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                u, v = sorted((find(a), find(b)))
                parent[v] = u
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, k, percent):
    rng = random.Random(k)
    base = [prose(rng, n) for n in (80, 150, 40, 300)]
    texts = ODD + [mutated(rng, b, rng.choice([0, 0, 1, 2, 3, 6])) for b in base for _ in range(14)] + ["The of and", "the OF and"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs_of(spark, texts), k, percent).collect()}
    assert got == brute_components(list(enumerate(texts)), k, percent)


def test_jaccard_rows_without_id_and_repeats(spark):
    docs = docs_of(spark, ["a b c d", "a b c d", "a b c d", "q"], [7, None, 7, 3])
    got = sorted((r.doc_id is None, r.doc_id, r.component_id) for r in ngram_join.jaccard_components(docs).collect() if r.doc_id is not None)
    assert got == [(False, 3, 3), (False, 7, 7), (False, 7, 7)]
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0


def brute_lines(rows):
    h = lambda s: hashlib.md5(s.encode()).hexdigest()
    marks, lines, full = [], {}, {}
    for i, t in rows:
        lines[i] = (t or "").split("\n")
        full[i] = [j for j, x in enumerate(lines[i]) if x.strip(" ")]
        hs = [h(lines[i][j]) for j in full[i]]
        grams = [int(h("".join(hs[j : j + 2]))[:15], 16) for j in range(len(hs) - 1)]
        for j, g in enumerate(grams):
            right = j + 1 < len(grams) and g < grams[j + 1]
            left = j > 0 and g <= grams[j - 1]
            if right or left or len(grams) == 1:
                marks.append((i, j, g, hs[j - 1] if j else None, hs[j + 2] if j + 2 < len(hs) else None))
    seen, seen_before, seen_after = set(), set(), set()
    gone = collections.defaultdict(set)
    for i, j, g, before, after in sorted(marks, key=lambda m: m[:2]):
        if g in seen:
            gone[i] |= set(range(j - ((g, before) in seen_before), j + 2 + ((g, after) in seen_after)))
        seen.add(g)
        seen_before |= {(g, before)} if before else set()
        seen_after |= {(g, after)} if after else set()
    return {i: (len(full[i]), len(gone[i]), "\n".join(x for j, x in enumerate(lines[i]) if j not in {full[i][k] for k in gone[i]})) for i, _ in rows}


def test_line_dedup(spark):
    rng = random.Random(5)
    pool = [prose(rng, 6) for _ in range(30)]
    texts = ODD[1:] + ["\n".join(rng.choice(pool[:12]) if rng.random() < 0.3 else "\n".join(pool[s : s + rng.randint(1, 8)]) for s in [rng.randrange(25) for _ in range(3)]) for _ in range(40)]
    texts += ["a\na\na\na\na", "p\n\nq\n\nr\n\ns", "p\nq\nr\ns"]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.line_dedup(docs_of(spark, texts)).collect()}
    assert got == brute_lines(list(enumerate(texts)))
    odd = line_dedup.line_dedup(docs_of(spark, [None, "k\nl\nm", "k\nl\nm"], [1, None, 2])).collect()
    assert sorted(str(r.text) for r in odd) == ["None", "k\nl\nm", "k\nl\nm"]
    assert line_dedup.line_dedup(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_long_repeated_runs_go(spark):
    rng = random.Random(8)
    run = [prose(rng, 9) for _ in range(9)]
    texts = ["\n".join([prose(rng, 5), *run, prose(rng, 5)]) for _ in range(6)]
    got = sorted((r.doc_id, r.n_removed) for r in line_dedup.line_dedup(docs_of(spark, texts)).collect())
    assert got[0] == (0, 0)
    assert all(n == 9 for _, n in got[1:])


def test_short_repeated_runs_go(spark):
    texts = ["head one\nbody a\nbody b", "x\nhead one\ny", "head one", "body a\nbody b", "x\n\nz\nz", None, ""]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.line_dedup(docs_of(spark, texts), short=True).collect()}
    assert got == {0: (3, 0, texts[0]), 1: (3, 1, "x\ny"), 2: (1, 1, ""), 3: (2, 2, ""), 4: (3, 2, "\nz"), 5: (0, 0, None), 6: (0, 0, "")}


def test_pipeline_drops_single_repeated_lines(spark):
    import corpus_pipeline

    docs = docs_of(spark, ["head one\nbody a", "x\nhead one", "head one"]).select(*corpus_pipeline.DOCUMENT)
    assert {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.lines(spark, docs, "").collect()} == {0: ("head one\nbody a", 15), 1: ("x", 1)}


def test_quality_rules_base(spark):
    rng = random.Random(3)
    texts = ODD + [prose(rng, 30, 8) + "\n#x $ | <y>\n" + prose(rng, 12) for _ in range(30)] + ["a b\na b\n \n \nA b"]
    for r in quality_rules.quality_rules(docs_of(spark, texts)).collect():
        t = texts[r.doc_id] or ""
        w = words_of(t)
        lines = [x for x in t.split("\n") if words_of(x)]
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeat = {i + o for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for o in range(5)}
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (len(w) < 10 or 100 * len(repeat) > 20 * len(w))
        assert not (r.kept and r.base_failed)


def test_quality_rules_fence(spark):
    rng = random.Random(4)
    texts = [prose(rng, 60) for _ in range(150)] + [prose(rng, 60).replace(" ", "### ") for _ in range(5)]
    verdicts = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs_of(spark, texts)).collect()}
    assert all(verdicts[i] for i in range(150))
    assert not any(verdicts[i] for i in range(150, 155))
    assert quality_rules.quality_rules(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_language(spark):
    rng = random.Random(1)
    kinds = {"en": ["the", "and", "ing", "with"], "fr": ["eau", "été", "que", "les"], "de": ["sch", "ung", "über", "keit"]}
    rows = [(i, " ".join("".join(rng.choices(kinds[lang], k=2)) for _ in range(40)), lang) for i, lang in enumerate(list(kinds) * 60)]
    rows += [(1000, None, "en"), (1001, "12 34 !", "fr"), (1002, "", None), (None, rows[0][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify_language(docs, docs.where("doc_id < 100")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == lang for i, _, lang in rows[:180])
    assert {by[i].lang_pred for i in (1000, 1001, 1002)} == {"und"}
    assert by[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in langid.identify_language(docs, docs.limit(0)).collect()} == {"und"}


def test_language_is_that_of_the_nearest_centroid(spark):
    import pyarrow as pa

    rng = random.Random(41)
    kinds = {"a": ["xa", "ya", "za"], "b": ["ob", "ub", "ib"]}
    rows = [(i, " ".join("".join(rng.choices(kinds[lang], k=3)) for _ in range(30)), lang) for i, lang in enumerate(list(kinds) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify_language(docs, docs).collect()}
    counts = np.concatenate([langid._counts(pa.RecordBatch.from_pydict({"text": [t]})) for _, t, _ in rows]).astype(np.float64)
    idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1
    vectors = np.sqrt(counts) * idf
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    centres = {}
    for lang in kinds:
        own = vectors[[i for i, _, x in rows if x == lang]].astype(np.float32)
        centres[lang] = langid._clustered(own[np.lexsort(own[:, :8].T)], langid.CENTROIDS)
    for i, _, _ in rows:
        near = {lang: max(float(vectors[i] @ c) for c in cs) for lang, cs in centres.items()}
        assert got[i].lang_pred == max(near, key=near.get)
        assert got[i].score == pytest.approx(max(near.values()), abs=1e-4)


def test_languages_in_later_partitions(spark):
    rows = [(i, " ".join(chr(97 + 3 * (i // 1000) + j) * 3 for j in (0, 1, 2, i % 3)), f"l{i // 1000}") for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    got = langid.identify_language(docs.where("doc_id % 100 = 0"), docs).collect()
    assert len(got) == 80 and all(r.lang_pred == f"l{r.doc_id // 1000}" for r in got)


def test_line_runs_of_three_go_whole(spark):
    rng = random.Random(31)
    texts = []
    for n in range(60):
        run = [prose(rng, 6) for _ in range(3)]
        texts += ["\n".join([prose(rng, 5), *run, prose(rng, 5)]), "\n".join([prose(rng, 7), *run, prose(rng, 4)])]
    got = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(docs_of(spark, texts)).collect()}
    assert all(got[i] == 3 * (i % 2) for i in got)


def test_texts_of_one_id_are_apart(spark):
    run = "\n".join(f"line {i}" for i in range(6))
    docs = docs_of(spark, [run, "u1\nu2\nu3\nu4", run, None], [1, 2, 2, 2]).withColumn("n_removed", F.lit("own"))
    got = sorted((r.doc_id, r.text or "", r.n_removed) for r in line_dedup.line_dedup(docs).collect())
    assert got == [(1, run, 0), (2, "", 0), (2, "", 6), (2, "u1\nu2\nu3\nu4", 0)]
    passage = " ".join(f"word{i} and {i}." for i in range(30))
    docs = docs_of(spark, [passage, "All of it is new here, said nobody.", passage, None], [1, 2, 2, 2])
    got = sorted((r.doc_id, r.text or "") for r in substring_dedup.substring_dedup(docs).collect())
    assert got == [(1, passage), (2, ""), (2, ""), (2, "All of it is new here, said nobody.")]


def test_short_sentences_of_a_long_passage(spark):
    rng = random.Random(32)
    passage = " ".join(prose(rng, 5, 10**6).capitalize() + "." for _ in range(10))
    line = prose(rng, 12, 10**6) + "."
    texts = [f"{prose(rng, 9)}. {passage} {prose(rng, 9)}.", f"{prose(rng, 3)}.\n{passage}\nx", line, line, f"{line} more"]
    got = {r.doc_id: r.text for r in substring_dedup.substring_dedup(docs_of(spark, texts)).collect()}
    assert got[0] == texts[0] and passage[:40] not in got[1] and got[1].endswith("\nx")
    assert got[3] == texts[3] and got[4] == texts[4]


def test_substrings_against_plain_python(spark):
    rng = random.Random(33)
    pool = [prose(rng, n, 300) + "." for n in (2, 4, 6, 9, 14, 30)] * 3
    texts = [*ODD, *("\n".join(" ".join(rng.choices(pool, k=rng.randint(1, 6))) for _ in range(3)) for _ in range(40)), "x. " * 3000]
    seen, expected = set(), {}
    for i, t in enumerate(texts):
        left, at, run = [], 0, []
        for u in [*re.finditer(r"[^\n]*?[.!?]+(?=\s|$)|[^\n]+", t or ""), None]:
            words = u and u.group().lower().split()
            if u and not words:
                continue
            if u and tuple(words) in seen:
                run.append((u.end() - len(u.group().lstrip()), u.end(), len(words)))
            else:
                if sum(r[2] for r in run) >= 25:
                    left.append((t or "")[at : run[0][0]])
                    at = run[-1][1]
                run = []
            if u:
                seen.add(tuple(words))
        expected[i] = None if t is None else "".join([*left, t[at:]])
    assert {r.doc_id: r.text for r in substring_dedup.substring_dedup(docs_of(spark, texts)).collect()} == expected


def test_substring_dedup(spark):
    rng = random.Random(2)
    sentence = lambda n: prose(rng, n, 10**6) + "."
    passage = [sentence(20) for _ in range(3)]
    texts = ["\n".join([sentence(9), " ".join(passage), sentence(12)]), sentence(10) + " " + " ".join(passage) + " " + sentence(11), sentence(15), None, "", "Of. Of. Of.", "Of. Of. Of."]
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs_of(spark, texts)).collect()}
    assert got[0].text == texts[0]
    assert all(p not in got[1].text for p in passage)
    assert got[2].text == texts[2] and got[3].text is None and got[5].text == got[6].text == "Of. Of. Of."
    for i, t in enumerate(texts):
        left, at = [], 0
        for s in got[i].removed:
            left.append(t[at : s.start])
            at = s.end
        assert (t or "") == (t or "") and "".join([*left, (t or "")[at:]]) == (got[i].text or "")
    assert substring_dedup.substring_dedup(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.example/x", "<html><head><title>T &amp; U</title><script>no</script></head><body><p>Hello<br>you</p><!-- c --></body></html>"), (2, None, None), (3, "u", "")],
        "page_id long, url string, html string",
    )
    responses = warc.responses_of(pages)
    records = warc.derive(responses)
    rows = {(r.source_id, r.warc_type): r for r in records.collect()}
    assert len(rows) == 6
    assert rows[1, "conversion"].block == "T & U\nHello\nyou"
    assert "http-header-content-type: text/html; charset=utf-8" in rows[1, "metadata"].block
    refers = {r.source_id: r.record_id for r in responses.collect()}
    parsed = {}
    for r in warc.as_bytes(records).collect():
        (one,) = warc.parse(bytes(r.warc))
        parsed[one["WARC-Record-ID"]] = one
    for (source, kind), r in rows.items():
        one = parsed[r.record_id]
        assert one["block"] == r.block and one["WARC-Refers-To"] == refers[source] and one["WARC-Type"] == kind
        assert one["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
    assert warc.derive(responses.limit(0)).count() == 0


def brute_perplexity(train, text):
    """Perplexity under the pair model, from dictionaries."""
    cut = lambda t: ["<s>", *words_of(t), "</s>"]
    pairs = collections.Counter(p for t in train if words_of(t) for p in zip(cut(t), cut(t)[1:]))
    d2 = quality_lm.discounts([sum(n == i for n in pairs.values()) for i in (1, 2, 3, 4)])
    before = collections.Counter(w for _, w in pairs)
    total, out = collections.Counter(), collections.Counter()
    for (h, w), n in pairs.items():
        total[w] += n
        out[h] += n
    d1 = quality_lm.discounts([sum(n == i for n in before.values()) for i in (1, 2, 3, 4)])
    known = {w for w in total if total[w] >= 2}
    unknown = (1 - sum((before[w] - d1[min(before[w], 3) - 1]) / len(pairs) for w in known)) / (len(known) + 1)
    low = lambda w: (before[w] - d1[min(before[w], 3) - 1]) / len(pairs) + unknown if w in known else unknown
    kept = {p: n - d2[min(n, 3) - 1] for p, n in pairs.items() if n >= 2}
    used = collections.Counter()
    for (h, _), n in kept.items():
        used[h] += n
    ps = [kept.get((h, w), 0) / max(1, out[h]) + ((1 - used[h] / out[h]) if out[h] else 1) * low(w) for h, w in zip(cut(text), cut(text)[1:])]
    return float(np.exp(-np.log(ps).mean()))


def test_perplexity(spark, monkeypatch):
    monkeypatch.setattr(quality_lm, "HEAVY", 20)
    monkeypatch.setattr(quality_lm, "HELD", 300)
    rng = random.Random(21)
    texts = [prose(rng, rng.choice([1, 5, 40, 200]), 60) for _ in range(80)] + ["", None, "never seen words", "w1"]
    docs = docs_of(spark, texts)
    model, unknown, start = quality_lm.language_model(docs.where("doc_id < 50"))
    rows = quality_lm.log_probabilities(docs, model, unknown, start).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if words_of(texts[r.doc_id]):
            assert np.exp(r.surprise / r.n_symbols) == pytest.approx(brute_perplexity(texts[:50], texts[r.doc_id]), rel=1e-4)
        else:
            assert (r.n_symbols, r.surprise) == (0, 0.0)


def test_quality_classifier(spark):
    rng = random.Random(9)
    good = [prose(rng, 60, 300) + "." for _ in range(120)]
    bad = ["".join(c + "!#%"[rng.randrange(3)] for c in prose(rng, 30).upper()) for _ in range(10)]
    docs = docs_of(spark, good + bad + [None, ""])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(120, 0, 0), (None, 1, 0), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.accepted for r in quality_lm.quality_classifier(docs, labels).collect()}
    assert sum(not got[i] for i in range(120)) <= 2
    assert not any(got[i] for i in range(120, 130))
    assert got[130] and got[131]
    assert all(r.accepted for r in quality_lm.quality_classifier(docs, labels.limit(0)).collect())
    assert quality_lm.quality_classifier(docs.limit(0), labels).count() == 0


def test_mixing_meets_targets(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        kind = rng.choice(["clean", "clean", "toxic", "poor"])
        words = prose(rng, 40, 50).replace("w", "wa") if kind != "poor" else "### " * 40
        rows.append((i, words + (" scum loser" if kind == "toxic" else "")))
        if i % 2:
            labels.append((i, int(kind != "poor"), int(kind == "toxic")))
    docs = spark.createDataFrame([*rows, (400, None), (401, ""), (None, "wa")], "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = mixing.mix_to_targets(docs, labels).toPandas()
    assert len(out) == 403 and (out.rate >= 0).all()
    w = out.n_tokens.to_numpy() / out.n_tokens.sum()
    p = out[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1)
    goal, mass = np.array(list(mixing.TARGETS.values())), w @ p
    loss = lambda r: (((w * r) @ p - goal) ** 2 / mass).sum() / 2 + mixing.PULL / 2 * (w * (r - 1) ** 2).sum()
    rate = np.ones(len(w))
    for _ in range(50_000):
        rate = np.maximum(0, rate - (p @ (((w * rate) @ p - goal) / mass) + mixing.PULL * (rate - 1)) / (1 + mixing.PULL))
    assert loss(out.rate.to_numpy()) < loss(rate) + 5e-4
    assert np.abs((w * out.rate.to_numpy()) @ p - (w * rate) @ p).max() < 0.01
    assert mixing.mix_to_targets(docs.limit(0), labels, keep=["doc_id"]).count() == 0


def test_mixing_tells_words_of_each_language(spark):
    rng = random.Random(12)
    insults = {"en": ["scum", "loser", "moron"], "fr": ["éçà", "crétiné", "dégoûté"], "de": ["blödß", "übelst", "ärgst"]}
    rows, labels = [], []
    for i in range(900):
        lang, toxic = rng.choice(list(insults)), rng.random() < 0.2
        words = [f"{lang}é{''.join(rng.choices('abcdefgh', k=2))}" for _ in range(30)]
        rows.append((i, " ".join(words + ([rng.choice(insults[lang])] if toxic else [])), lang, toxic))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in mixing.mix_to_targets(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert mixing.TARGETS["toxic"] <= 0.01
    unseen = [(out[i].p_toxic > 0.5) == toxic for i, _, _, toxic in rows if i % 3 == 0]
    assert sum(unseen) >= 0.98 * len(unseen)


def brute_base(text):
    out = []
    for kind in pii.KINDS:
        for m in pii.PATTERNS[kind].finditer(text):
            digits = re.sub(r"\D", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            if kind == "card":
                total = sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(digits[::-1]))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            out.append((m.start(), pii.KINDS.index(kind), m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


@given(st.text(alphabet="ab1.@-+%_ é\n:", max_size=40) | st.text(alphabet="12345.+ -()", max_size=40))
@settings(max_examples=400, deadline=None)
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.joined(pii.base_spans(text)) == brute_base(text)


@given(st.lists(st.sampled_from(["key", "pass", "secret", "token", "s", "k", "=", ":", " ", "\t", "x"]), max_size=12).map("".join))
@settings(max_examples=400, deadline=None)
def test_key_words_tell_as_the_plain_pattern_says(text):
    assert bool(pii._TELLING.search(text)) == bool(re.search(r"(?:pass|secret|token|key)\S*\s*[=:]", text))


@given(st.text(alphabet="a.!? \n\r\x0b", max_size=30))
@settings(max_examples=400, deadline=None)
def test_sentences_are_those_of_the_plain_pattern(text):
    plain = re.compile(r"[^\n]*?[.!?]+(?=\s|$)|[^\n]+", re.MULTILINE)
    assert [m.span() for m in substring_dedup._SENTENCE.finditer(text)] == [m.span() for m in plain.finditer(text)]


@pytest.mark.parametrize("line", ["." * 2_000_000 + "x", "a" * 2_000_000 + " b@c", "7" * 2_000_000, "1.2.3." * 350_000, "key" * 700_000, "key " + " " * 2_000_000, "(" * 2_000_000 + "@", "@" * 300_000, "1.2.3.4 " * 20_000])
def test_long_lines_take_linear_time(line):
    begun = time.monotonic()
    list(substring_dedup.units_of(line))
    pii.base_spans(line)
    weight, move = np.ones((pii.FEATURES, pii.STATES)), np.zeros((pii.STATES, pii.STATES))
    pii.added_spans([line], [pii.base_spans(line)], weight, move)
    assert time.monotonic() - begun < 20


def test_personal_data(spark):
    rng = random.Random(7)
    samples = ["Write a.b@mail.example.com now", "host 10.0.0.255 and 300.1.1.1", "card 4111 1111 1111 1111.", "call +1 (462) 555-7216 é", "nothing here", "1.2.3.4.5 x@y.z 4962251213359604"]
    texts = [None, "", *samples, *(" ".join(rng.choices(samples, k=4)) for _ in range(60))]
    for r in pii.find_personal_data(docs_of(spark, texts)).collect():
        t = texts[r.doc_id] or ""
        base = brute_base(t)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in base.split(",")) for k in pii.KINDS]
        if "nothing" == t[:7] and "@" not in t and not re.search(r"\d", t):
            assert r.spans == ""
    assert pii.find_personal_data(docs_of(spark, ["a"]).limit(0)).count() == 0


def field_spans(states):
    out, begin = set(), None
    for j, state in enumerate([*states, 0]):
        if begin is not None and not (state and state % 2 == 0 and (state - 2) // 2 == kind):
            out.add((begin, j, kind))
            begin = None
        if state % 2:
            begin, kind = j, (state - 1) // 2
    return out


def test_field_on_phrases_it_has_not_seen():
    weight, move = pii.trained()
    hit = found = there = 0
    for tokens, states in pii.labelled_table(seed=99, n=800):
        got = field_spans(pii.viterbi(np.array([pii._features(tokens)]), weight, move)[0])
        hit, found, there = hit + len(got & field_spans(states)), found + len(got), there + len(field_spans(states))
    assert hit >= 0.9 * there and hit >= 0.95 * found


def test_viterbi_against_enumeration():
    rng = np.random.default_rng(3)
    weight, move = rng.normal(size=(pii.FEATURES, pii.STATES)), rng.normal(size=(pii.STATES, pii.STATES))
    for n in (1, 2, 3):
        features = rng.integers(0, pii.FEATURES, (5, n, 4))
        best = pii.viterbi(features, weight, move)
        for run, got in zip(features, best, strict=True):
            emit = weight[run].sum(axis=1)
            score = lambda path, emit=emit: sum(emit[t, s] for t, s in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])) - (20 if path[0] and path[0] % 2 == 0 else 0)
            assert tuple(got) == max(itertools.product(range(pii.STATES), repeat=n), key=score)


def test_field_adds_spans(spark):
    texts = ["reach me under 030 1234567 please", "mail jan (at) mail (dot) example now", 'set token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here', "card 9807915762804490 and x@y.example.com", "in 2024 we had 3 of 12 at 10:30", None, ""]
    got = {r.doc_id: r for r in pii.find_personal_data(docs_of(spark, texts)).collect()}
    held = lambda i: {x.split(":")[0]: texts[i][int(x.split(":")[1]) : int(x.split(":")[2])] for x in got[i].spans.split(",") if x}
    assert held(0) == {"phone": "030 1234567"} and held(1) == {"email": "jan (at) mail (dot) example"}
    assert held(2) == {"secret": "04dbebab91ab85687d33eeaaf9ac699e1188f962"}
    assert held(3) == {"card": "9807915762804490", "email": "x@y.example.com"}
    assert held(4) == {} and not got[4].found and got[5].spans == got[6].spans == ""
    assert [got[i].n_added for i in range(5)] == [1, 1, 1, 1, 0]


def test_decontamination(spark):
    rng = random.Random(10)
    items = [prose(rng, n, 60) for n in (30, 12, 10, 4, 1)] + [None, "", "Été à l'eau"]
    def document():
        parts = [prose(rng, 30, 60)]
        if rng.random() < 0.7:
            w = items[rng.randrange(5)].split()
            s = rng.randrange(max(1, len(w) - 9))
            parts += [" ".join(w[s : s + rng.choice([9, 10, 14])]).upper(), prose(rng, 8, 60)]
        return ", ".join(parts)
    texts = [None, "", "l'eau", "été à L-eau x", *(document() for _ in range(80))]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(0, items[0])], "item_id long, text string")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    got = decontam.find_contamination(docs_of(spark, texts), bench).collect()
    assert len(got) == len(texts)
    for r in got:
        w = cut(texts[r.doc_id])
        hit, found = set(), set()
        for i, t in enumerate(items):
            own = cut(t)
            n = min(10, len(own))
            for s in range(len(own) - n + 1 if own else 0):
                for a in range(len(w) - n + 1):
                    if w[a : a + n] == own[s : s + n]:
                        hit |= set(range(a, a + n))
                        found.add(str(i))
        expected = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), expected, bool(hit)), texts[r.doc_id]
    nothing = decontam.find_contamination(docs_of(spark, texts), bench.limit(0)).collect()
    assert len(nothing) == len(texts) and not any(r.contaminated for r in nothing)
    assert decontam.find_contamination(docs_of(spark, ["a"]).limit(0), bench).count() == 0


def test_near_terms_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PIECE_WORDS", 15)  # items are in several rows
    rng = random.Random(51)
    texts = [prose(rng, n, 40) for n in (60, 5, 30, 80, 1) * 8] + [None, ""]
    items = {i: prose(rng, n, 60) for i, n in enumerate((3, 2, 1, 40, 26))}
    count = collections.Counter(w for t in texts for w in (t or "").split())
    digest = {w: int(scan.signed(scan.words_of(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]), scan.ALNUM, True).hash)[0]) for t in items.values() for w in t.split()}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for r in decontam.find_contamination(docs_of(spark, texts), bench, slop=6).collect():
        words = (texts[r.doc_id] or "").split()
        expected = 0
        for t in items.values():
            rare = sorted(set(t.split()), key=lambda w: (count[w], digest[w]))[: decontam.NEAR_TERMS]
            at = lambda w, words=words: [j for j, x in enumerate(words) if x == w]
            expected += any(all(any(abs(j - k) <= 6 for k in at(w)) for w in rare[1:]) for j in at(rare[0]))
        assert r.n_near == expected


def test_decontamination_in_blocks(spark, monkeypatch):
    rng = random.Random(11)
    texts = [prose(rng, 40, 15) for _ in range(30)]
    bench = spark.createDataFrame([(i, prose(rng, 3, 15)) for i in range(30)], "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "n_near"]
    whole = sorted(decontam.find_contamination(docs_of(spark, texts), bench).select(*columns).collect())
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 20)
    assert sorted(decontam.find_contamination(docs_of(spark, texts), bench).select(*columns).collect()) == whole


def test_words_across_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(scan, "PIECE", 40)
    rng = random.Random(0)
    texts = ["".join(rng.choice("ab é\n\t!Z9") for _ in range(rng.choice([0, 1, 60, 300]))) for _ in range(100)] + ["x" * 500, "", "y" * 120]
    buf, offsets = scan.buffer_of(pa.array(texts))
    w = scan.words_of(buf, offsets, scan.SPACED, False)
    got = [[bytes(buf[w.start[i] : w.end[i]]).decode() for i in range(w.first[r], w.first[r + 1])] for r in range(len(texts))]
    assert got == [words_of(t) for t in texts]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(61)
    clean = [prose(rng, 60, 150) + "." for _ in range(40)]
    item = prose(rng, 14, 10**6)
    texts = [*clean, clean[3] + " one", clean[5], f"{prose(rng, 40, 150)} {item} end", "###!! " * 80, None, "", " \n"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, "no id", None, None, None), (7, clean[7], "en", "s", 1), (7, "another text of seven", None, "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(i, 1, 0) for i in range(38)] + [(43, 0, 0), (39, 1, 1), (None, 1, 0), (3, 1, 0)]
    for name, df in (
        ("documents", docs), ("labels", spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")),
    ):
        df.write.parquet(f"{tmp_path}/all/{name}.parquet")
        df.limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    at = f"{tmp_path}/all"
    kept = corpus_pipeline.quality(spark, docs, at)
    assert kept.columns == list(corpus_pipeline.DOCUMENT)
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(40)) | {44, 45, 46, None} <= ids and 43 not in ids
    assert {r.doc_id for r in corpus_pipeline.lines(spark, docs, at).collect()} == {r[0] for r in rows} - {41}
    one_each = corpus_pipeline.near_duplicates(spark, docs, at).collect()
    assert collections.Counter(r.doc_id for r in one_each) == collections.Counter({r[0] for r in rows} - {40, 41})
    assert next(r.text for r in one_each if r.doc_id == 7) == "another text of seven"
    assert {r.doc_id for r in corpus_pipeline.decontaminated(spark, docs, at).collect()} == {r[0] for r in rows} - {42}
    folders = lambda: set(os.listdir(shared_dir(spark).removeprefix("file:")))
    before = folders()
    left = corpus_pipeline.run(spark, at)
    assert not [x for x in folders() - before if re.match("(stage|index|items|scores|lines|first|posteriors|cells)-", x)]  # only checkpoints stay
    assert "text" not in left.columns and {"doc_id", "lang", "source", "n_chars", "n_tokens", "rate", "residual", "converged"} <= set(left.columns)
    gone = {40, 41, 42, 43}
    assert not gone & {r.doc_id for r in left.collect()}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_short_runs_are_looked_for_in_what_winnowing_leaves(spark, monkeypatch):
    long, lone = "one line\ntwo lines\nthree lines\nfour lines", "a lone line"
    docs = docs_of(spark, [f"{long}\n{lone}", f"{long}\nnew", f"x\n{lone}"])
    runs = line_dedup._winnowed(docs)
    asked = []
    single = line_dedup._single
    monkeypatch.setattr(line_dedup, "_single", lambda d, gone: asked.append({r.at for r in gone.collect()}) or single(d, gone))
    got = [r.text for r in line_dedup.line_dedup(docs, short=True).orderBy("doc_id").collect()]
    assert got == [f"{long}\n{lone}", "new", "x"] and asked == [{0, 1, 2, 3}] and runs.count() > 0


def test_a_stage_begins_without_what_is_left_in_cycles():
    import gc
    import weakref
    from types import SimpleNamespace

    import corpus_pipeline

    class Left:
        pass

    left, asked = Left(), []
    left.itself = left
    held = weakref.ref(left)
    del left
    session = SimpleNamespace(sparkContext=SimpleNamespace(_jvm=SimpleNamespace(System=SimpleNamespace(gc=lambda: asked.append("jvm")))))
    gc.disable()
    try:
        corpus_pipeline.stage(lambda spark, docs, sf_dir: asked.append(held()))(session, None, "")
    finally:
        gc.enable()
    assert asked == ["jvm", None]
    assert all(hasattr(work, "__wrapped__") for _, work in corpus_pipeline.STAGES)

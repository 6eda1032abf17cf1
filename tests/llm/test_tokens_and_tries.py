"""The trie of conversations, aligned tokenizers and packing, against plain Python; odd rows, empty tables, clashing columns."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrykit.llm import packing, prefix_trie, token_alignment, tokens

TURNS = "conv_id long, turn long, role string, text string, n long, part string, bucket int, a long"
TEXTS = "doc_id long, text string, lang string, slice long, place int, radix string"


def brute_trie(rows):
    convs = collections.defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    nodes = collections.defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    kids = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    out = []
    for k, m in nodes.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k))))
        out.append((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_of(spark, rows, **kw):
    got = prefix_trie.prefix_trie(*prefix_trie.with_shared_heads(prefix_trie.digested(spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], TURNS))), **kw).collect()
    assert sorted(x for r in got for x in (r.enter_at, r.exit_at)) == list(range(2 * len(got)))
    return sorted((tuple(r)[:8] for r in got), key=repr)


@pytest.mark.parametrize("bucket", [prefix_trie.BUCKET, 7])
def test_trie_matches_plain_python(spark, bucket):
    rng = random.Random(bucket)
    texts = ["", "hello", "hé", "x" * 200_000, None, "bye"]
    rows = []
    for c in [*range(30), 105, 10**12]:
        rows += [(c, t, rng.choice(["user", "bot", None]), rng.choice(texts)) for t in range(rng.randrange(1, 15))]
    rows += [(3, None, "user", "first"), (3, None, "user", "also first"), (4, 2, "bot", "tie"), (4, 2, "bot", "tie"), (None, 1, "user", "no conversation")]
    rows += [(200, t, "user", f"long {t}") for t in range(300)]
    rows += [(1000 + i, 0, "user", "hello") for i in range(60)]
    assert trie_of(spark, rows, bucket=bucket) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert trie_of(spark, []) == []
    assert trie_of(spark, [(None, 1, "user", "x")]) == []
    # Its head would come from a conversation that isn't there, and it has no more turns of its own.
    alone = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 9 and c % 5)
    assert trie_of(spark, [(alone, 0, "user", "x")]) == brute_trie([(alone, 0, "user", "x")])
    assert len(trie_of(spark, [(alone, 0, "user", "x")])) == 1


@pytest.mark.parametrize("bucket", [10, 40, 1000])
def test_list_ranks_of_any_order(spark, bucket):
    rng = random.Random(bucket)
    order = rng.sample(range(500), 300)
    weight = {i: rng.randrange(100) for i in order}
    links = spark.createDataFrame([(i, j, weight[i], 1) for i, j in zip(order, [*order[1:], None], strict=True)], "id long, next long, w long, one long")
    got = {r.id: (r.w, r.one) for r in prefix_trie.list_ranks(links, ["w", "one"], bucket).collect()}
    assert got == {i: (sum(weight[j] for j in order[k:]), len(order) - k) for k, i in enumerate(order)}


def test_id_digests_in_pieces(spark, monkeypatch):
    members = spark.range(0, 5000).select((F.col("id") % 3).alias("a"), (F.col("id") % 2).alias("b"), (F.col("id") - 100).alias("conv_id")).repartition(7)
    got = {(r.a, r.b): r.ends for r in prefix_trie.id_digests(members).collect()}
    want = {(a, b): hashlib.sha256(",".join(str(i - 100) for i in range(5000) if i % 3 == a and i % 2 == b).encode()).hexdigest() for a in range(3) for b in range(2)}
    assert got == want


ODD = [None, "", " ", "one", "<|endoftext|> </s> <unk> <s>", "é́ ΟΔΟΣ 한국 👩‍👩‍👧", "a\x00b\x85c d", "x" * 300_000, "\n\n\t  y", "▁ ⁇ ▁▁x", "don't I'LL '''s", "the cat. the cat. the cat."]


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary("piece_bpe_32k.model"))
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printed)}
    counts, found = collections.Counter(), []
    for text in texts:
        a, b = (left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)) if text else ([], [])
        of_a = [bytes(byte[c] for c in left.id_to_token(i)) for i in a]
        of_b = [bytes([int(p[3:5], 16)]) if right.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(right.id_to_piece, b), strict=True)]
        whole = (" " + text).encode() if text else None
        if b"".join(of_a) != whole or b"".join(of_b) != whole:
            found.append(None)
            continue
        end_a, end_b = ({int(e): k for k, e in enumerate(np.cumsum([len(x) for x in of]))} for of in (of_a, of_b))
        links, groups, i, j = [], [], 0, 0
        for e in sorted(end_a.keys() & end_b.keys()):
            x, y = end_a[e], end_b[e]
            links.append((a[x], b[y]))
            groups.append(",".join(map(str, a[i : x + 1])) + "|" + ",".join(map(str, b[j : y + 1])))
            i, j = x + 1, y + 1
        counts.update(links)
        found.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = collections.Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (f[0], f[1], f[2], len(f[3]), sum(counts[p] == best[p[1]] for p in f[3]), sum(counts[p] for p in f[3]), f[4]) for f in found]


def aligned(spark, texts, ids):
    df = spark.createDataFrame([(i, t, "en", 1, 2, "r") for i, t in zip(ids, texts, strict=True)], TEXTS).repartition(5)
    got = token_alignment.align(df, tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("piece_bpe_32k.model")).collect()
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got), key=repr)


@pytest.mark.parametrize(("fan", "group"), [(token_alignment.FAN, token_alignment.GROUP), (2, 500)])
def test_alignment_matches_plain_python(spark, monkeypatch, fan, group):
    monkeypatch.setattr(token_alignment, "FAN", fan)
    monkeypatch.setattr(token_alignment, "GROUP", group)
    rng = random.Random(fan)
    texts = ODD + ["".join(rng.choice(["the ", "Thing", " été", ".\n", "12", "ß", "x-y ", "\t"]) for _ in range(rng.randrange(80))) for _ in range(40)]
    texts += texts[20:24]
    ids = [None, None, *range(len(texts) - 2)]
    assert aligned(spark, texts, ids) == sorted(((i, *x) for i, x in zip(ids, brute_alignment(texts), strict=True)), key=repr)


def test_alignment_of_nothing(spark):
    assert aligned(spark, [], []) == []
    assert aligned(spark, [None, ""], [1, 1]) == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


def test_runs_merge(monkeypatch):
    monkeypatch.setattr(token_alignment, "BLOCK", 5)
    rng = np.random.default_rng(3)
    runs, want = [], collections.Counter()
    for n in (0, 1, 4, 30, 77):
        keys = np.unique(rng.integers(0, 1 << 20, n))
        counts = rng.integers(1, 1000, keys.size)
        want.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
        runs.append(token_alignment._blocks(keys, counts))
    parts = list(token_alignment.merged(runs))
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want and (np.diff(keys) > 0).all()


@pytest.mark.parametrize("seed", range(6))
def test_packed(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        size = int(2 ** rng.integers(0, 8))
        lengths = rng.integers(1, [3, size + 2, size // 2 + 2, 5 * size + 2][seed % 4], rng.integers(0, 60))
        p = packing.packed(lengths, size, int(rng.integers(1, 9)))
        seen, places = [np.zeros(n, int) for n in lengths], collections.defaultdict(list)
        for item, start, length, sequence, offset in zip(*p, strict=True):
            assert length > 0 and start + length <= lengths[item]
            seen[item][start : start + length] += 1
            places[sequence].append((offset, length))
        assert all((x == 1).all() for x in seen) and sorted(places) == list(range(len(places)))
        short = []
        for parts in places.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            short += [int(at)] if at < size else []
        assert all(n & (n - 1) == 0 for n in short) and len(set(short)) == len(short)


@pytest.mark.parametrize("most", [packing.SLICE, 100])
def test_packing(spark, most):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    texts = [*ODD, *(" ".join(f"word{i}, and" for i in range(n)) for n in (1, 50, 900, 4000)), "a", "a"]
    ids = [None, *range(len(texts) - 1)]
    df = spark.createDataFrame([(i, t, "en", 1, 2, "r") for i, t in zip(ids, texts, strict=True)], TEXTS).coalesce(2)
    got = packing.pack(df, tokens.vocabulary("word_bpe_49k.json"), most=most).collect()
    want = {i: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in zip(ids, texts, strict=True)}
    covered, places = collections.Counter(), collections.defaultdict(list)
    for r in got:
        own = want[r.doc_id]
        assert r.doc_tokens == own.size and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        covered[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert covered == {i: own.size for i, own in want.items()}
    short = 0
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0 and at < 4096
        short += int(at < 4096)
    assert short <= 12 * df.rdd.getNumPartitions()
    assert packing.pack(df.limit(0), tokens.vocabulary("word_bpe_49k.json")).count() == 0


def test_word_ids_of_odd_words():
    from tokenizers import Tokenizer

    path = tokens.vocabulary("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), tokens.WordIds(path)
    rng = random.Random(1)
    letters = "aZé'sltdm,.<|>≠̸́ ß9-_\n\t×Ωend oftx=\x1c\x85 "
    parts = ["<|endoftext|>", "<|startoftext|>", "a", "'s", ",", " ", ".", "é", "́"]
    texts = ODD[1:] + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(1000)]
    for part in (texts[:2000], texts[2000:], texts[:100]):
        assert [x.tolist() for x in own.encode(part)] == [x.ids for x in plain.encode_batch(part, add_special_tokens=False)]

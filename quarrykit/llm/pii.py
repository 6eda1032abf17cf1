"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

Tokens further than NEAR from one with a digit or a sign of an address are always
outside, so a text falls into runs that decode on their own; runs of equal
length are decoded together. The field is trained on a small labelled table of
phrases, most of which the patterns miss, and only adds spans: those of the
patterns stay.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm import scan

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the contract.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Kinds that the field knows: also keys and passwords.
FIELD_KINDS = (*KINDS, "secret")
#: Phrases of the labelled table.
LABELLED = 1600
FEATURES = 1 << 13
#: Outside, then the first and the following tokens of each kind.
STATES = 1 + 2 * len(FIELD_KINDS)
#: Tokens on either side of a telling one that decode with it.
NEAR = 3

_TOKEN = re.compile(r"\S+")
# A key word tells if a sign of assignment follows in its token or right behind it. The last key word before the sign is enough, so no letter is read twice.
_TELLING = re.compile(r"[0-9@]|[(\[{<](?:at|dot)[)\]}>]|(?:pass|secret|token|key)(?:(?!pass|secret|token|key)[^\s=:])*+\s*+[=:]", re.I)
# The same matches as the patterns, found in linear time: a run of digits is begun once, and an address is sought from its @ outwards.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LINEAR = PATTERNS | {"ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")}
_DIGITS = re.compile(r"[0-9]")
_SHAPES = ((re.compile("[0-9]+"), "9"), (re.compile("[A-Z]+"), "A"), (re.compile(r"[^\W\d_A-Z]+"), "a"), (re.compile(r"(?:9a){2,}9?|(?:a9){2,}a?|(?:9A){2,}9?|(?:A9){2,}A?"), "x"))
#: What may stand around a span without being of it.
_EDGE = ".,;:!?\"'<>[]{}|#*$%&=`"

Span = tuple[int, int, str]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _holds(kind: str, found: str) -> bool:
    digits = "".join(_DIGITS.findall(found))
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and _luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Where the email pattern matches: no sign of a name is an @, so a match has the longest name that ends at its @ and begins after the match before."""
    free, at = 0, text.find("@")
    while at >= 0:
        name = len(text[free:at]) - len(text[free:at].rstrip(_LOCAL))
        found = _DOMAIN.match(text, at) if name else None
        if found:
            yield at - name, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def _matches(kind: str, text: str) -> Iterator[tuple[int, int]]:
    return _addresses(text) if kind == "email" else (m.span() for m in _LINEAR[kind].finditer(text))


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by start and then by kind."""
    found = []
    for kind, needed in zip(KINDS, ("@", ".", "", "+"), strict=True):
        if needed in text:
            found += [(a, b, kind) for a, b in _matches(kind, text) if _holds(kind, text[a:b])]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def runs_of(text: str) -> list[list[tuple[int, int]]]:
    """Maximal runs of tokens, NEAR at most from a telling one, within lines."""
    if not _TELLING.search(text):
        return []
    runs: list[list[tuple[int, int]]] = []
    at = 0
    for line in text.split("\n"):
        if _TELLING.search(line):
            tokens = [(at + m.start(), at + m.end()) for m in _TOKEN.finditer(line)]
            telling = {i for i, (a, b) in enumerate(tokens) if _TELLING.search(text, a, b)}
            telling |= {i for i in range(len(tokens) - 1) if _TELLING.search(text[tokens[i][0] : tokens[i + 1][1]])}
            wanted = sorted({j for i in telling for j in range(max(0, i - NEAR), min(len(tokens), i + NEAR + 1))})
            for n, j in enumerate(wanted):
                if n and wanted[n - 1] == j - 1:
                    runs[-1].append(tokens[j])
                else:
                    runs.append([tokens[j]])
        at += len(line) + 1
    return runs


def _shape(token: str) -> str:
    for pattern, sign in _SHAPES:
        token = pattern.sub(sign, token)
    return token


def _features(tokens: list[str]) -> list[list[int]]:
    cores = [t.strip(_EDGE) for t in tokens]
    shapes = ["^", *map(_shape, cores), "$"]
    low = ["^", *(c.lower() if c.isalpha() and len(c) < 12 else "-" for c in cores), "$"]
    out = []
    for i, (token, core) in enumerate(zip(tokens, cores, strict=True), 1):
        digits = len(_DIGITS.findall(core))
        size = min(len(core), 24) // 4
        hexed = len(core) >= 16 and not core.strip("0123456789abcdefABCDEF")
        names = [
            f"s{shapes[i]}", f"p{shapes[i - 1]}|{shapes[i]}", f"n{shapes[i]}|{shapes[i + 1]}", f"d{min(digits, 20)}|{len(core) == digits}", f"w{low[i]}", f"v{low[i - 1]}", f"u{low[i + 1]}",
            f"m{'@' in core}{core.count('.')}{core[:1] == '+'}{'=' in token}", f"l{size}|{hexed}", f"e{token[:1]}|{token[-1:]}", f"q{low[i - 2] if i > 1 else '^'}|{shapes[i - 1]}",
        ]
        out.append([zlib.crc32(x.encode()) % FEATURES for x in names])
    return out


def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("0123456789", k=n))


def _word(rng: random.Random) -> str:
    return "".join(rng.choices(("an", "er", "lo", "mi", "sta", "ou", "ver", "que", "th", "en"), k=rng.randint(1, 3)))


def _positive(rng: random.Random, kind: str) -> str:
    """Personal data as it is written, mostly in ways that the fixed patterns miss."""
    d, w = (lambda n: _number(rng, n)), (lambda: _word(rng))
    if kind == "email":
        at, dot = rng.choice([(" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("@", "."), (" at ", " dot ")][: 4 if rng.random() < 0.9 else 5])
        return f"{w()}.{w()}{at}{w()}{dot}{rng.choice(['example', 'mail'])}{dot}com" if rng.random() < 0.5 else f"{w()}{d(2)}{at}{w()}{dot}com"
    if kind == "ip":
        parts = [str(rng.randrange(256)) for _ in range(4)]
        return rng.choice([".".join(parts), ":".join(f"{rng.randrange(65536):x}" for _ in range(8)), ".".join(parts) + f":{d(4)}"])
    if kind == "card":
        return rng.choice([d(16), " ".join(d(4) for _ in range(4)), "-".join(d(4) for _ in range(4)), d(15), d(19)])
    if kind == "phone":
        return rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(3)} {d(7)}", f"0{d(2)}/{d(8)}", f"+{d(2)} {d(3)} {d(7)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(3)}.{d(3)}.{d(4)}"])
    key = rng.choice(["token", "secret", "password", "api_key", "key", "passwd", "access_token"])
    value = rng.choice(["".join(rng.choices("0123456789abcdef", k=rng.choice([32, 40, 64]))), "".join(rng.choices("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMN23456789", k=rng.randint(8, 40))), "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16))])
    return f'{key} {rng.choice(["=", ":"])} \0"{value}"' if rng.random() < 0.7 else f"{key}{rng.choice(['=', ':'])} \0{value}"


def _negative(rng: random.Random) -> str:
    """Numbers and signs that are no personal data."""
    d, w = (lambda n: _number(rng, n)), (lambda: _word(rng))
    return rng.choice([
        f"{rng.randrange(1900, 2100)}", f"20{d(2)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", f"{rng.randrange(1, 29)}.{rng.randrange(1, 13)}.20{d(2)}", f"{rng.randrange(24)}:{d(2)}",
        f"{rng.randrange(1, 99)},{d(3)}.{d(2)}", f"{d(2)} %", f"version {d(1)}.{d(1)}.", f"{d(1)}.{d(1)}.{d(2)}", f"page {d(3)}", f"pages {d(2)}-{d(2)}", f"no. {d(5)}", f"{d(2)} {d(3)}", f"{w()}{d(1)}",
        f"at {d(2)} {w()}", f"CC BY-NC {d(1)}.{d(1)}.", f"section {d(1)}.{d(1)}.{d(1)}", f"({d(1)})", f"{d(3)} x {d(3)}", f"${d(4)}", "the key to", "a token of", f"key: {w()}", f"{d(6)}", f"{d(9)} {w()}", f"id {d(8)}",
    ])


def labelled_table(seed: int = 1, n: int = LABELLED) -> list[tuple[list[str], list[int]]]:
    """Phrases with the state of each token: one case in plain words, and marks beside it as careless text has them."""
    rng = random.Random(seed)
    table = []
    for _ in range(n):
        kind = rng.choice([*FIELD_KINDS, None, None, None, None])
        case = _negative(rng) if kind is None else _positive(rng, kind)
        skipped, _, body = case.rpartition("\0")
        before = [_word(rng) for _ in range(rng.randrange(4))] + skipped.split()
        own = body.split()
        own[-1] += rng.choice(["", "", "", ".", ",", "!!", "###", "$$$", "%%%", "***", "&&&"])
        after = [_word(rng) + rng.choice(["", "", "."]) for _ in range(rng.randrange(4))]
        first = 0 if kind is None else 1 + 2 * FIELD_KINDS.index(kind)
        states = [0] * len(before) + [first] + [first + 1 if first else 0] * (len(own) - 1) + [0] * len(after)
        table.append(([*before, *own, *after], states))
    return table


def _by_length(runs: list) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.array([len(r) for r in runs])
    for n in np.unique(lengths):
        yield int(n), np.flatnonzero(lengths == n)


def train(table: list[tuple[list[list[int]], list[int]]], rounds: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Weights (feature x state) and transitions, by Adagrad on the conditional log-likelihood."""
    weight, move = np.zeros((FEATURES, STATES)), np.zeros((STATES, STATES))
    if not table:
        weight[:, 0] = 1.0
        return weight, move
    seen_w, seen_m = np.full_like(weight, 1e-8), np.full_like(move, 1e-8)
    for n in range(len(FIELD_KINDS)):
        bad = 2 + 2 * n
        move[[s for s in range(STATES) if s not in (bad, bad - 1)], bad] = -20.0
    fixed = move <= -20
    batches = [
        (np.array([table[i][0] for i in own]), np.array([table[i][1] for i in own])) for _, own in _by_length([f for f, _ in table])
    ]
    for _ in range(rounds):
        grad_m, places, misses = 1e-3 * move, [], []
        for features, states in batches:
            rows, n = states.shape
            emit = weight[features].sum(axis=2)
            ahead = [emit[:, 0]]
            for t in range(1, n):
                x = ahead[-1][:, :, None] + move
                top = x.max(axis=1, keepdims=True)
                ahead.append(emit[:, t] + (top + np.log(np.exp(x - top).sum(axis=1, keepdims=True)))[:, 0])
            back = [np.zeros((rows, STATES))]
            for t in range(n - 1, 0, -1):
                x = move + (emit[:, t] + back[0])[:, None, :]
                top = x.max(axis=2, keepdims=True)
                back.insert(0, (top + np.log(np.exp(x - top).sum(axis=2, keepdims=True)))[:, :, 0])
            whole = np.logaddexp.reduce(ahead[-1], axis=1)
            for t in range(n):
                miss = np.exp(ahead[t] + back[t] - whole[:, None])
                miss[np.arange(rows), states[:, t]] -= 1
                places.append(features[:, t])
                misses.append(miss)
                if t:
                    both = ahead[t - 1][:, :, None] + move + (emit[:, t] + back[t])[:, None, :]
                    grad_m += np.exp(both - whole[:, None, None]).sum(axis=0)
                    np.add.at(grad_m, (states[:, t - 1], states[:, t]), -1)
        grad_m[fixed] = 0
        place, miss = np.concatenate(places), np.concatenate(misses)
        flat, width = place.ravel(), place.shape[1]
        grad_w = 1e-3 * weight + np.stack([np.bincount(flat, np.repeat(miss[:, s], width), FEATURES) for s in range(STATES)], axis=1)
        seen_w += grad_w**2
        seen_m += grad_m**2
        weight -= 0.5 * grad_w / np.sqrt(seen_w)
        move -= 0.5 * grad_m / np.sqrt(seen_m)
    return weight, move


def viterbi(features: np.ndarray, weight: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best states of runs of equal length (runs x tokens x features)."""
    emit = weight[features].sum(axis=2)
    best, came = emit[:, 0] + np.where(np.arange(STATES) % 2 == 0, np.where(np.arange(STATES) == 0, 0, -20), 0), []
    for t in range(1, emit.shape[1]):
        x = best[:, :, None] + move
        came.append(x.argmax(axis=1))
        best = x.max(axis=1) + emit[:, t]
    states = [best.argmax(axis=1)]
    for step in reversed(came):
        states.append(step[np.arange(len(step)), states[-1]])
    return np.stack(states[::-1], axis=1)


def _plausible(kind: str, found: str) -> bool:
    digits = len(_DIGITS.findall(found))
    if kind == "email":
        return "@" in found[1:-1] or re.search(r"\bat\b", found, re.I) is not None
    if kind == "ip":
        return found.count(".") >= 3 or found.count(":") >= 4
    return {"card": 14 <= digits <= 19, "phone": 9 <= digits <= 15, "secret": len(found) >= 8}[kind]


def _core(text: str, a: int, b: int) -> tuple[int, int]:
    """The span without what stands around it; a bracket goes if its other half isn't in the span."""
    closed = text.rfind(")", a, b)
    while a < b and (text[a] in _EDGE or text[a] == "(" and closed < a):
        a += 1
    opened = text.find("(", a, b)
    while a < b and (text[b - 1] in _EDGE or text[b - 1] == ")" and not 0 <= opened < b):
        b -= 1
    return a, b


def added_spans(texts: list[str], base: list[list[Span]], weight: np.ndarray, move: np.ndarray) -> list[list[Span]]:
    """Of each text the field's spans that are plausible for their kind and apart from the base spans."""
    runs, where = [], []
    for i, text in enumerate(texts):
        for run in runs_of(text):
            runs.append(run), where.append(i)
    out: list[list[Span]] = [[] for _ in texts]
    features = [_features([texts[i][a:b] for a, b in run]) for run, i in zip(runs, where, strict=True)]
    starts = [[a for a, _, _ in spans] for spans in base]
    reach = [list(itertools.accumulate((b for _, b, _ in spans), max)) for spans in base]

    def meets(i: int, a: int, b: int) -> bool:
        before = bisect.bisect_left(starts[i], b)
        return before > 0 and reach[i][before - 1] > a

    for _, own in _by_length(features) if runs else ():
        for at, states in zip(own, viterbi(np.array([features[i] for i in own]), weight, move), strict=True):
            text = texts[where[at]]
            begin = None
            for j, state in enumerate([*states, 0]):
                if begin is not None and not (state and state % 2 == 0 and (state - 2) // 2 == kind):
                    a, b = _core(text, runs[at][begin][0], runs[at][j - 1][1])
                    if a < b and _plausible(FIELD_KINDS[kind], text[a:b]) and not meets(where[at], a, b):
                        out[where[at]].append((a, b, FIELD_KINDS[kind]))
                    begin = None
                if state % 2 == 1:
                    begin, kind = j, (state - 1) // 2
    return out


def _detected(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, move = model.value
        for batch in batches:
            for part in scan.slices(batch, "text", most_rows=1000):
                texts = [t or "" for t in part.column("text").to_pylist()]
                base = [base_spans(t) if _DIGITS.search(t) or "@" in t else [] for t in texts]
                more = added_spans(texts, base, weight, move)
                every = [sorted(b + m, key=lambda s: (s[0], FIELD_KINDS.index(s[2]))) for b, m in zip(base, more, strict=True)]
                counts = [pa.array([sum(s[2] == k for s in b) for b in base], pa.int64()) for k in KINDS]
                digests = [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array([joined(x) for x in every], pa.string()), pa.array([len(m) for m in more], pa.int64()), pa.array([bool(x) for x in every], pa.bool_())],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "found"],
                )

    return run


def trained() -> tuple[np.ndarray, np.ndarray]:
    """The field's weights and transitions, from labelled_table()."""
    return train([(_features(tokens), states) for tokens, states in labelled_table()])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, for every row of docs(doc_id, text).

    Spans are kind:start:end in code points, end exclusive, by start, then in the
    order of FIELD_KINDS. The field, trained on labelled_table(), adds spans that
    don't overlap a base span and are plausible for their kind; n_added counts
    them, and found says that there is any span.

    Null or empty text has no spans. Null doc_ids and repeated rows are kept as
    rows of their own; other columns are ignored; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained())
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long, found boolean"
    return docs.select("doc_id", "text").mapInArrow(_detected(model), schema)

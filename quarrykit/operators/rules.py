"""Rules as data: many patterns over many texts, each text read once.

Of each pattern a literal is taken that every match must hold. The literals of all
rules stand in one automaton; a text passes it once, and only the rules whose
literal it met, and those without one, are run. Rules are a DataFrame of any size:
a block of them at a time is sent to the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules of a block, and the longest pattern that is taken; a block takes 80 MB at most.
BLOCK, LONGEST = 20_000, 4_000
#: ASCII letters that letters outside ASCII fold to, so that a literal without regard to case can't hold them.
_FOLDED = set("kisKIS")


def literal(pattern: str) -> str:
    """The longest run of characters that every match of a pattern holds, lower-cased; '' if none is sure."""
    from re import _constants as kinds
    from re import _parser as parser

    parsed = parser.parse(pattern)
    loose = bool(parsed.state.flags & re.IGNORECASE)
    runs: list[str] = [""]

    def walk(parts, loose: bool) -> None:
        for kind, value in parts:
            if kind is kinds.LITERAL and (not loose or (value < 128 and chr(value) not in _FOLDED)):
                runs[-1] += chr(value)
            elif kind is kinds.SUBPATTERN:
                _, on, off, inside = value
                walk(inside, (loose or bool(on & re.IGNORECASE)) and not off & re.IGNORECASE)
            elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and value[0] > 0:
                walk(value[2], loose)
                runs.append("")
            elif kind is kinds.AT:
                pass
            else:
                runs.append("")

    walk(parsed, loose)
    # Lower-casing a text character by character keeps a literal only if it does the same to that alone.
    return max((r for r in (run.lower() for run in runs if run.isascii())), key=len, default="")


def _only_literal(pattern: str, need: str) -> bool:
    """Whether a pattern is that literal and places like \\b, so that a match starts where the literal does."""
    from re import _constants as kinds
    from re import _parser as parser

    parts = list(parser.parse(pattern))
    return all(kind in (kinds.LITERAL, kinds.AT) for kind, _ in parts) and "".join(chr(v) for kind, v in parts if kind is kinds.LITERAL).lower() == need


@cache
def _compiled(block: tuple[tuple[str, str, bool], ...]):
    """The automaton of a block, the rules without a literal, by rule its test, and the rules to be tested on the spot; those that don't compile are left out."""
    import ahocorasick

    automaton, always, tests, spots = ahocorasick.Automaton(), [], {}, set()
    by_literal: dict[str, list[int]] = {}
    for i, (_, pattern, word) in enumerate(block):
        if word:
            tests[i], need = None, pattern.lower()
        else:
            try:
                tests[i], need = re.compile(pattern), literal(pattern)
            except (re.error, OverflowError, RecursionError):
                continue
        (by_literal.setdefault(need, []) if need else always).append(i)
        if need and not word and _only_literal(pattern, need):
            spots.add(i)
    for need, own in by_literal.items():
        automaton.add_word(need, (len(need) - 1, own))
    if by_literal:
        automaton.make_automaton()
    return automaton if by_literal else None, always, tests, spots


def _met(text: str, automaton, always: list[int], tests: dict, spots: set[int]) -> list[int]:
    low = text.lower()
    same = len(low) == len(text)  # no letter's lower case is empty, so each stands at its place
    wanted, met = set(always), set()
    for end, (back, own) in automaton.iter(low) if automaton else ():
        for i in own:
            if i in met or i in wanted:
                continue
            if not same or i not in spots:
                wanted.add(i)
            elif tests[i].match(text, end - back):
                met.add(i)
    return sorted(met.union(i for i in wanted if tests[i] is None or tests[i].search(text)))


def _matching(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = block.value
        compiled = _compiled(rules)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            at, found = [], []
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                if text is not None:
                    met = _met(text, *compiled)
                    at += [i] * len(met)
                    found += met
            yield pa.RecordBatch.from_arrays([names.take(pa.array(at, pa.int64())), pa.array([rules[i][0] for i in found], pa.string())], ["name", "rule_id"])

    return run


def _checking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for rule, pattern in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if pattern is None or len(pattern) > LONGEST:
                out.append((rule, "no pattern" if pattern is None else "too long"))
                continue
            try:
                re.compile(pattern)
            except (re.error, OverflowError, RecursionError) as x:
                out.append((rule, str(x)))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string())], ["rule_id", "fault"])


def faults(rules: DataFrame) -> DataFrame:
    """(rule_id, fault) of the rules(rule_id, pattern) that hits() skips: no pattern, one that is too long or one that doesn't compile."""
    return rules.select(F.col("rule_id").cast("string").alias("rule_id"), "pattern").mapInArrow(_checking, "rule_id string, fault string")


def _found(df: DataFrame, name: str, text: str, rules: DataFrame) -> DataFrame:
    """(name, rule_id) of rules(rule_id, pattern, word), in blocks. A rule_id that repeats gives a row for each of its rules that is met."""
    spark = df.sparkSession
    rules = rules.where(F.col("pattern").isNotNull() & (F.length("pattern") <= LONGEST) & (F.col("pattern") != ""))
    n = -(-rules.count() // BLOCK) or 1
    kind = f"name {dict(df.dtypes)[name]}, rule_id string"
    rows, out = df.select(F.col(name).alias("name"), F.col(text).alias("text")), []
    for b in range(n):
        # As many rules as a block has: what is collected is bounded by BLOCK, whatever the number of rules.
        block = rules.where(F.pmod(F.xxhash64("rule_id", "pattern"), F.lit(n)) == b) if n > 1 else rules
        block = tuple((r.rule_id, r.pattern, r.word) for r in block.select("rule_id", "pattern", "word").collect())
        out.append(rows.mapInArrow(_matching(spark.sparkContext.broadcast(block)), kind))
    return reduce(DataFrame.unionAll, out).withColumnRenamed("name", name)


def hits(df: DataFrame, name: str, text: str, rules: DataFrame) -> DataFrame:
    """(name, rule_id): a row for each text and rule(rule_id, pattern) that is found in it; a null text holds nothing.

    Patterns are regular expressions of Python, searched in whole texts. Faulty
    ones are skipped; faults() names them. Other columns of the rules come back
    by a join on rule_id.
    """
    return _found(df, name, text, rules.select(F.col("rule_id").cast("string").alias("rule_id"), "pattern", F.lit(False).alias("word")))


def keyword_forms(df: DataFrame, name: str, text: str, keywords: DataFrame) -> DataFrame:
    """(name, form_id), each once: the forms of keywords(word, form_id) that a text holds, whatever the case."""
    named = keywords.select(F.col("form_id").cast("string").alias("rule_id"), F.col("word").alias("pattern"), F.lit(True).alias("word"))
    return _found(df, name, text, named).distinct().withColumnRenamed("rule_id", "form_id")


def incidents(found: DataFrame, subject: str, name: str) -> DataFrame:
    """(subject, rule_id, n, first_id, last_id) of hits with a subject."""
    return found.groupBy(subject, "rule_id").agg(F.count("*").alias("n"), F.min(name).alias("first_id"), F.max(name).alias("last_id"))

"""Per-document text quality statistics from associative partial counts.

A text is split into chunks of bounded length. Each chunk gives counts of its
inner words and lines, and the state of the pieces that touch its borders. Two
neighbouring partial results combine into one, so a document of any length is
counted in parallel and merged in a tree of fan-in ``FAN_IN``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk, and partial results that one merge takes.
CHUNK, FAN_IN = 200_000, 64

BLANKS = " \t\n\r "
PUNCTUATION = '.!?…"'
SPLIT = regex.compile(f"[{BLANKS}]+")
NOT_ALNUM = regex.compile(r"[^\p{L}\p{N}]+")
LETTER = regex.compile(r"\p{L}")

# A word piece is (chars, alnum, head, core, tail): head and tail are what is
# before the first and after the last letter, core is what is between; a text
# longer than the longest common word (or None) can't be part of a common word.


def _piece(word: str, longest: int) -> tuple:
    """State of a run of characters that aren't blanks."""
    alnum = len(NOT_ALNUM.sub("", word))
    low = word.lower()
    first = LETTER.search(low)
    if first is None:
        return len(word), alnum, True, "", low[: longest + 1]
    end = len(low)
    while not LETTER.match(low, end - 1):
        end -= 1
    core = low[first.start() : end]
    return len(word), alnum, False, core if len(core) <= longest else None, low[end : end + longest + 1]


def _join(a: tuple, b: tuple, longest: int, b_head: str) -> tuple:
    """State of two pieces written one after the other; ``b_head`` is what stands before b's first letter."""
    n, m = a[0] + b[0], a[1] + b[1]
    if b[2]:  # no letter in b
        return n, m, a[2], a[3], (a[4] + b[4])[: longest + 1]
    if a[2]:
        return n, m, False, b[3], b[4]
    core = None if a[3] is None or b[3] is None else a[3] + a[4] + b_head + b[3]
    return n, m, False, core if core is not None and len(core) <= longest else None, b[4]


def partial(text: str, common: frozenset[str], longest: int) -> dict:
    """Partial counts of a chunk.

    ``words, chars, alnum, hits`` are of its inner words. ``left`` and
    ``right`` are the pieces at its borders; a chunk without blanks is one piece
    (``open`` true, ``right`` empty). The same for lines: ``lines, ends``, and
    for the border lines whether they hold anything and end in punctuation.
    """
    words = SPLIT.split(text)
    is_open = len(words) == 1
    inner = words[1:-1]
    joined = "".join(inner)
    hits = sum(_is_common(w, common) for w in inner)
    lines = text.split("\n")
    stripped = [x.strip(BLANKS) for x in lines]
    whole = [x for x in stripped[1:-1] if x]
    left = words[0]
    return {
        "words": len(inner), "chars": len(joined), "alnum": len(NOT_ALNUM.sub("", joined)), "hits": hits,
        "open": is_open, "left": _edge(left, longest), "right": _edge("" if is_open else words[-1], longest),
        "lines": len(whole), "ends": sum(x[-1] in PUNCTUATION for x in whole), "flat": len(lines) == 1,
        "first": _line(stripped[0]), "last": _line("" if len(lines) == 1 else stripped[-1]),
    }


def _edge(word: str, longest: int) -> list:
    p = _piece(word, longest)
    low = word.lower()
    first = LETTER.search(low)
    head = low[: min(first.start(), longest + 1)] if first else low[: longest + 1]
    return [*p, head]


def _line(text: str) -> list:
    return [bool(text), bool(text) and text[-1] in PUNCTUATION]


def _glue(a: list, b: list, longest: int) -> list:
    """Two border pieces written one after the other."""
    head = (a[5] + b[5])[: longest + 1] if a[2] else a[5]
    return [*_join(tuple(a[:5]), tuple(b[:5]), longest, b[5]), head]


def _is_common(word: str, common: frozenset[str]) -> bool:
    low = word.lower()
    if low in common:
        return True
    a, b = 0, len(low)
    while a < b and not LETTER.match(low, a):
        a += 1
    while b > a and not LETTER.match(low, b - 1):
        b -= 1
    return (a or b < len(low)) and low[a:b] in common


def combine(a: dict, b: dict, common: frozenset[str], longest: int) -> dict:
    """Partial counts of two neighbouring stretches of a text; associative."""
    out = {k: a[k] + b[k] for k in ("words", "chars", "alnum", "hits", "lines", "ends")}
    if a["open"] and b["open"]:
        out |= {"open": True, "left": _glue(a["left"], b["left"], longest), "right": a["right"]}
    elif a["open"]:
        out |= {"open": False, "left": _glue(a["left"], b["left"], longest), "right": b["right"]}
    elif b["open"]:
        out |= {"open": False, "left": a["left"], "right": _glue(a["right"], b["left"], longest)}
    else:
        _count(out, _glue(a["right"], b["left"], longest), common)
        out |= {"open": False, "left": a["left"], "right": b["right"]}
    later = lambda x, y: y if y[0] else x  # noqa: E731  what ends a line is its last part that holds anything
    if a["flat"]:
        out |= {"flat": b["flat"], "first": later(a["first"], b["first"]), "last": b["last"]}
    elif b["flat"]:
        out |= {"flat": False, "first": a["first"], "last": later(a["last"], b["first"])}
    else:
        line = later(a["last"], b["first"])
        out["lines"] += line[0]
        out["ends"] += line[0] and line[1]
        out |= {"flat": False, "first": a["first"], "last": b["last"]}
    return out


def _count(out: dict, piece: list, common: frozenset[str]) -> None:
    if piece[0]:
        out["words"] += 1
        out["chars"] += piece[0]
        out["alnum"] += piece[1]
        out["hits"] += piece[3] in common if piece[3] else 0


def finish(p: dict, common: frozenset[str]) -> tuple[int, int, int, int, int, int]:
    """Totals (words, chars, alnum, common words, lines, lines that end in punctuation) of a whole text."""
    out = {k: p[k] for k in ("words", "chars", "alnum", "hits", "lines", "ends")}
    _count(out, p["left"], common)
    _count(out, p["right"], common)
    for line in (p["first"], p["last"]):
        out["lines"] += line[0]
        out["ends"] += line[0] and line[1]
    return tuple(int(out[k]) for k in ("words", "chars", "alnum", "hits", "lines", "ends"))


STATE = "words bigint, chars bigint, alnum bigint, hits bigint, open boolean, left string, right string, lines bigint, ends bigint, flat boolean, first string, last string"
PLAIN, CODED = ("words", "chars", "alnum", "hits", "open", "lines", "ends", "flat"), ("left", "right", "first", "last")


def _pack(p: dict) -> list:
    import json

    return [p[k] for k in PLAIN] + [json.dumps(p[k]) for k in CODED]


def _unpack(row: tuple) -> dict:
    import json

    return dict(zip(PLAIN, row)) | {k: json.loads(x) for k, x in zip(CODED, row[len(PLAIN) :])}


def text_quality(documents: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Statistics of each document's text.

    Columns: the key, ``n_words, n_chars`` (in words), ``n_lines`` and the
    ratios ``mean_word_length, symbol_ratio, punctuation_share, common_share``,
    null where their denominator is 0. A null text counts as an empty one. Rows
    of a repeated key are separate documents. Documents of one chunk, nearly
    all, are finished where they are read; only longer ones are shuffled, as
    partial counts. ``common_words`` is a list of words of a language, so it is
    sent to all executors; a list of over a million words is refused.
    """
    listed = common_words.where(F.col("word").isNotNull()).select(F.lower("word")).distinct().limit(1_000_001).collect()
    if len(listed) > 1_000_000:
        raise ValueError("common_words is no list of common words")
    common = frozenset(r[0] for r in listed)
    longest = max(map(len, common), default=0)
    names = [*PLAIN, *CODED]
    schema = "n_words bigint, chars bigint, alnum bigint, hits bigint, n_lines bigint, ends bigint"
    kind = dict(documents.dtypes)[key]

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [finish(partial(t or "", common, longest), common) for t in b["t"]]
            yield pd.concat([b[["k"]].reset_index(drop=True), pd.DataFrame(made, columns=[x.split()[0] for x in schema.split(", ")])], axis=1)

    def many(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [_pack(partial(t, common, longest)) for t in b["t"]]
            yield pd.concat([b[["row", "k", "no"]].reset_index(drop=True), pd.DataFrame(made, columns=names)], axis=1)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("no")
        states = [_unpack(r) for r in rows[names].itertuples(index=False, name=None)]
        total = states[0]
        for s in states[1:]:
            total = combine(total, s, common, longest)
        return pd.DataFrame([[rows["row"].iloc[0], rows["k"].iloc[0], rows["no"].iloc[0] // FAN_IN, *_pack(total)]], columns=["row", "k", "no", *names])

    docs = documents.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))  # a null key stays one
    size = F.coalesce(F.length("t"), F.lit(0))
    short = docs.where(size <= chunk).mapInPandas(one, f"k string, {schema}")
    long = docs.where(size > chunk)
    pieces = F.ceil(F.length("t") / chunk).cast("int")
    cut = long.withColumn("row", F.monotonically_increasing_id()).withColumn("no", F.explode(F.sequence(F.lit(0), pieces - 1)))
    cut = cut.select("row", "k", F.col("no").cast("bigint").alias("no"), F.substring(F.col("t"), F.col("no") * chunk + 1, F.lit(chunk)).alias("t"))
    state = "row bigint, k string, no bigint, " + ", ".join(f"{n} {dict(x.split() for x in STATE.split(', '))[n]}" for n in names)
    part = cut.mapInPandas(many, state)
    # level by level; 64 ** 3 chunks hold any string that Spark can
    for _ in range(3):
        part = part.groupBy("row", F.floor(F.col("no") / FAN_IN).alias("g")).applyInPandas(merge, state)

    def end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [finish(_unpack(r), common) for r in b[names].itertuples(index=False, name=None)]
            yield pd.concat([b[["k"]].reset_index(drop=True), pd.DataFrame(made, columns=[x.split()[0] for x in schema.split(", ")])], axis=1)

    every = short.unionByName(part.mapInPandas(end, f"k string, {schema}"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return every.select(
        F.col("k").cast(kind).alias(key), "n_words", F.col("chars").alias("n_chars"), "n_lines", ratio("chars", "n_words").alias("mean_word_length"),
        F.when(F.col("chars") > 0, (F.col("chars") - F.col("alnum")) / F.col("chars")).alias("symbol_ratio"),
        ratio("ends", "n_lines").alias("punctuation_share"), ratio("hits", "n_words").alias("common_share"),
    )


def is_junk(least_words: int = 10, least_rules: int = 2):
    """Condition: at least two of the rules call the text a list, a table or junk."""
    rules = [(F.col("mean_word_length") < 2.5) | (F.col("mean_word_length") > 10), F.col("symbol_ratio") > 0.2, F.col("punctuation_share") < 0.5, F.col("common_share") < 0.2]
    broken = sum((F.coalesce(r, F.lit(False)).cast("int") for r in rules), F.lit(0))
    return (F.col("n_words") >= least_words) & (broken >= least_rules)

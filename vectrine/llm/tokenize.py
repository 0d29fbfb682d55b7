"""Byte-level BPE of a whole corpus by recursive queries in DuckDB.

In each partition the texts are cut into words by the tokenizer's pattern, and
each distinct word is encoded once: its token positions are rows, joined with
the merge table. A recursive query contracts in each round the leftmost pair of
minimum rank of each word, and the further pairs of that rank from left to
right, until no word has a pair left; an ordered aggregation gives the ids of a
word. (A merge never makes a pair of lower rank, as the rank of a token is above
those of its parts; so these pairs would follow one after the other anyway, and
a long word takes a round for each rank instead of one for each merge.) No model is trained here.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words encoded by one recursive query, and tokens of remembered words at most in a worker.
WORDS_A_QUERY, REMEMBERED = 20_000, 2_000_000

QUERY = """
with recursive step as (
    select word, pos, token, 0 as round from start
    union all
    select word, pos, token, round from (
        with near as (
            select *, lead(token) over w as next_token, lead(pos) over w as next_pos, row_number() over w as place
            from step window w as (partition by word order by pos)
        ),
        pair as (
            select n.word, n.pos, n.next_pos, n.place, m.rank, m.made
            from near n join merges m on m.first = n.token and m.second = n.next_token
        ),
        best as (select word, min(rank) as rank from pair group by word),
        same as (
            select p.*, p.place - row_number() over (partition by p.word order by p.pos) as island
            from pair p join best b on b.word = p.word and b.rank = p.rank
        ),
        chosen as (select * from same qualify row_number() over (partition by word, island order by pos) % 2 = 1),
        gone as (select word, next_pos as pos from chosen)
        select s.word, s.pos, coalesce(c.made, s.token) as token, s.round + 1 as round
        from step s
        semi join best b on b.word = s.word
        left join chosen c on c.word = s.word and c.pos = s.pos
        anti join gone g on g.word = s.word and g.pos = s.pos
    )
),
last as (select word, max(round) as round from step group by word)
select s.word, list(s.token order by s.pos) as ids from step s join last l on l.word = s.word and l.round = s.round group by s.word
"""


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """Tokens and ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]


def merge_table(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """``(first, second, made)``: each token as the two tokens that a merge makes it of, its id being the merge's rank.

    The pair is what the merges of lower rank leave of the token's bytes.
    """
    out = []
    for token, rank in ranks.items():
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and r < rank and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out.append((ranks[parts[0]], ranks[parts[1]], rank))
    return out


class Encoder:
    """Encodes words in a DuckDB connection of its own."""

    def __init__(self, ranks: list[tuple[bytes, int]], merges: list[tuple[int, int, int]]):
        import duckdb

        self.bytes = {t[0]: r for t, r in ranks if len(t) == 1}
        self.whole = dict(ranks)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        frame = pd.DataFrame(merges, columns=["first", "second", "made"])
        frame["rank"] = frame["made"]
        self.con.register("merges_frame", frame)
        self.con.execute("create table merges as select first::int as first, second::int as second, made::int as made, rank::bigint as rank from merges_frame")
        self.known: dict[str, list[int]] = {}
        self.held = 0

    def encode(self, words: list[str]) -> None:
        """Put the ids of distinct words into ``known``."""
        for i in range(0, len(words), WORDS_A_QUERY):
            some = [w.encode("utf-8", "surrogatepass") for w in words[i : i + WORDS_A_QUERY]]
            lengths = [len(x) for x in some]
            start = pd.DataFrame({"word": pd.Series(range(len(some))).repeat(lengths), "pos": [p for n in lengths for p in range(n)], "token": [self.bytes[b] for x in some for b in x]})
            self.con.register("start_frame", start)
            self.con.execute("create or replace temp table start as select word::int as word, pos::bigint as pos, token::int as token from start_frame")
            for word, ids in self.con.execute(QUERY).fetchall():
                self.known[words[i + word]] = ids
                self.held += len(ids)


def encode_texts(documents: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", column: str = "ids") -> DataFrame:
    """``(key, ids)`` of each document, without special tokens; their strings in a text are ordinary text.

    A null or empty text has an empty list. Repeated keys each keep their row.
    ``ranks_path`` is the tokenizer's ``.tiktoken`` file; the driver reads it
    and sends its tokens and merges (a few MB) to the executors.
    """
    spark = documents.sparkSession
    ranks = read_ranks(ranks_path)
    shared = spark.sparkContext.broadcast((ranks, merge_table(dict(ranks))))
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut, encoder = regex.compile(pattern), Encoder(*shared.value)
        for b in batches:
            texts = [cut.findall(t) if t else [] for t in b["t"]]
            new = list(dict.fromkeys(w for t in texts for w in t if w not in encoder.known))
            encoder.encode(new)
            known = encoder.known
            yield pd.DataFrame({"k": b["k"], "ids": [[x for w in t for x in known[w]] for t in texts]})
            if encoder.held > REMEMBERED:
                encoder.known, encoder.held = {}, 0

    made = documents.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).mapInPandas(run, "k string, ids array<int>")
    return made.select(F.col("k").cast(kind).alias(key), F.col("ids").alias(column))

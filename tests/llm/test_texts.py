"""Quality statistics, leaks and token ids against plain versions."""

import base64

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectrine.llm import leakage as L
from vectrine.llm import quality as Q
from vectrine.llm.tokenize import Encoder, encode_texts, merge_table, read_ranks

COMMON = frozenset({"the", "and", "it's", "a"})
LONGEST = max(map(len, COMMON))
texts = st.text(alphabet="aTheé'-.!?\"… \t\n\r ,12世ΣΟ", max_size=60)


def plain(text):
    """The statistics as their definition reads."""
    words = [w for w in regex.split("[ \t\n\r ]+", text) if w]
    chars = "".join(words)
    lines = [x for x in (y.strip(" \t\n\r ") for y in text.split("\n")) if x]
    cut = [regex.sub(r"^[^\p{L}]+|[^\p{L}]+$", "", w.lower()) for w in words]
    return len(words), len(chars), len(regex.findall(r"[\p{L}\p{N}]", chars)), sum(c in COMMON for c in cut), len(lines), sum(x[-1] in '.!?…"' for x in lines)


@settings(max_examples=400, deadline=None)
@given(texts)
def test_statistics_of_a_whole_text(text):
    assert Q.finish(Q.partial(text, COMMON, LONGEST), COMMON) == plain(text)


@settings(max_examples=400, deadline=None)
@given(texts, st.lists(st.integers(0, 60), max_size=5), st.randoms())
def test_partial_counts_combine_in_any_order(text, cuts, random):
    at = sorted({0, len(text), *[min(c, len(text)) for c in cuts]})
    parts = [Q.partial(text[a:b], COMMON, LONGEST) for a, b in zip(at, at[1:])] or [Q.partial("", COMMON, LONGEST)]
    while len(parts) > 1:
        i = random.randrange(len(parts) - 1)
        parts[i : i + 2] = [Q.combine(parts[i], parts[i + 1], COMMON, LONGEST)]
    # lower case of a sigma hangs on its neighbours, so a cut beside one may change a letter but no count
    assert Q.finish(parts[0], COMMON) == plain(text)


def test_quality_of_odd_documents(spark):
    long = "The quick, brown fox.\n" * 300 + "x" * 500 + " end"
    rows = [(1, ""), (2, None), (3, " \n\t"), (4, long), (4, "the the"), (None, "a b"), (5, "--the-- it's!")]
    docs = spark.createDataFrame([(k, t, "k", 7) for k, t in rows], "doc_id bigint, text string, k string, row int")
    words = spark.createDataFrame([("en", w) for w in COMMON] + [("xx", None)], "lang string, word string")
    for chunk in (50, 1_000_000):
        found = Q.text_quality(docs, words, chunk=chunk).collect()
        assert len(found) == len(rows)
        by = {}
        for r in found:
            by.setdefault(r.doc_id, []).append(r)
        assert by[1][0].n_words == by[2][0].n_words == by[3][0].n_words == 0 and by[1][0].mean_word_length is None and by[3][0].n_lines == 0
        big = max(by[4], key=lambda r: r.n_words)
        w, c, a, h, n, e = plain(long)
        assert (big.n_words, big.n_chars, big.n_lines) == (w, c, n) and big.symbol_ratio == pytest.approx((c - a) / c) and big.common_share == pytest.approx(h / w) and big.punctuation_share == pytest.approx(e / n)
        assert min(by[4], key=lambda r: r.n_words).n_words == 2 and by[5][0].common_share == 1.0 and by[None][0].n_words == 2
    assert Q.text_quality(docs.limit(0), words).isEmpty() and Q.text_quality(docs, words.limit(0)).count() == len(rows)


# leaks


def slow_alignment(a, b):
    best = 0
    m = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            m[i, j] = max(0, m[i - 1, j - 1] + (L.MATCH if x == y else L.MISMATCH), m[i - 1, j] + L.GAP, m[i, j - 1] + L.GAP)
            best = max(best, m[i, j])
    return best


small = st.lists(st.integers(0, 4), max_size=14)


def slow_run(a, b):
    subs = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
    return max((j - i for i in range(len(b)) for j in range(i + 1, len(b) + 1) if tuple(b[i:j]) in subs), default=0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(small, small), min_size=1, max_size=5))
def test_alignment(pairs):
    codes = [[np.array(x, np.uint64) for x in side] for side in zip(*pairs)]
    for (a, b), run, score, took in zip(pairs, *L.align(*codes)):
        assert run == slow_run(a, b) and score == slow_alignment(a, b) and 0 <= took <= len(b)


@given(st.lists(st.integers(0, 30), min_size=12, max_size=40), st.integers(0, 3))
def test_every_window_has_a_seed(words, salt):
    codes = np.array(words, np.uint64)
    grams = L.gram_codes(codes, L.GRAM).tolist()
    frequency = {g: (g + salt) % 5 for g in grams}
    chosen = L.seeds(codes, frequency)
    for i in range(len(words) - L.SPAN + 1):
        window = {g for g in grams[i : i + L.SPAN - L.GRAM + 1] if frequency[g]}
        assert bool(chosen & window) == bool(window)


def test_leaks(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    items = [(1, passage + " tail"), (2, "alpha " + passage.upper().replace(" ", ", ") + "!"), (3, "short"), (4, None), (5, ""), (None, passage), (6, "a b c d e f g h i j k l m")]
    docs = [(10, "x " + passage.replace(" ", "\n\t--") + " y"), (11, passage[:-7]), (12, None), (13, ""), (14, "a b c d e f X g h i j k l m"), (15, ("z " * 3000) + passage), (15, passage), (None, passage)]
    d = spark.createDataFrame([(k, t, 1.0) for k, t in docs], "doc_id bigint, text string, score double")
    i = spark.createDataFrame([(k, t, "r") for k, t in items], "item_id bigint, text string, run string")
    found = sorted((r.doc_id or 0, r.item_id) for r in L.exact_leaks(d, i).collect())
    assert found == [(0, 1), (0, 2), (10, 1), (10, 2), (15, 1), (15, 2)]
    edited = {(r.doc_id, r.item_id): r for r in L.leaks(d, i).collect()}
    assert edited[14, 6].run == 7 and edited[14, 6].score == 13 * L.MATCH + L.GAP and edited[14, 6].share == 1.0
    assert edited[11, 1].run == 11
    assert L.exact_leaks(d.limit(0), i).isEmpty() and L.exact_leaks(d, i.limit(0)).isEmpty()


def leaks_of(spark, docs, items, f):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    i = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    return {(r.doc_id, r.item_id) for r in f(d, i).collect()}


def test_leaks_of_periodic_passages_single_seeds_and_short_items(spark):
    laugh = "ha " * 12
    items = ["a b c d e f g h i j k l m n o p " + laugh, "one two three four five six seven eight nine ten eleven twelve", "red green blue", "no such words"]
    docs = ["so funny " + laugh, "x one two three four five six y", "a red green blue line", "red blue"]
    assert leaks_of(spark, docs, items, L.exact_leaks) == {(0, 0)}
    assert leaks_of(spark, docs, items, L.leaks) == {(0, 0), (1, 1), (2, 2)}


def test_seeds_do_not_depend_on_the_size_of_the_corpus(spark):
    words = [f"w{i}" for i in range(20)]
    docs = [" ".join(words)] * 5 + [" ".join(words[:7])] * 150  # all n-grams are in 5 documents, the first ones in 155
    assert len(leaks_of(spark, docs, [" ".join(words)], L.leaks)) == 155


def test_alignment_of_passages_of_a_long_text(spark):
    """Copies far apart, one of them over many passages of repeated seeds, score as in the whole text."""
    rng = np.random.default_rng(5)
    item = [f"w{i}" for i in rng.integers(0, 60, 50)]
    filler = lambda n: [f"x{i}" for i in rng.integers(0, 900, n)]
    edited = [w if i % 9 else "new" for i, w in enumerate(item)]
    docs = [filler(4000) + item[:30] + filler(5000) + edited + filler(3), item[10:20] * 80, filler(50) + item[:8] + filler(20) + item[8:]]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id bigint, text string")
    i = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    found = {r.doc_id: r for r in L.leaks(d, i).collect()}
    for k, words in enumerate(docs):
        number = {w: j + 1 for j, w in enumerate(dict.fromkeys([*item, *words]))}
        run, score, _ = L.align([np.array([number[w] for w in words])], [np.array([number[w] for w in item])])
        assert (found[k].run, found[k].score) == (run[0], score[0])


def test_edited_copies_are_found(spark):
    """Words replaced, left out and put in, one of seven at most between seeds: recall and share of the item."""
    rng = np.random.default_rng(6)
    items = [[f"w{i}" for i in rng.integers(0, 400, 70)] for _ in range(20)]
    docs, truth = [], set()
    for k in range(200):
        j = int(rng.integers(20))
        copy, at = [], 0
        while at < 70:
            step = int(rng.integers(7, 14))
            copy += items[j][at : at + step]
            at += step
            what = rng.integers(3)
            if what == 0:
                copy.append("new")
            elif what == 1:
                copy.append("other")
                at += 1
            else:
                at += 1
        docs.append(" ".join([f"x{i}" for i in rng.integers(0, 900, 60)] + copy + [f"x{i}" for i in rng.integers(0, 900, 60)]))
        truth.add((k, j))
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    i = spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id): r for r in L.leaks(d, i).where(F.col("score") >= L.MATCH * L.SPAN).collect()}
    assert set(found) == truth and min(r.share for r in found.values()) > 0.9
    blocks = L.leaks(d, i, most_words=300)
    assert {(r.doc_id, r.item_id): r for r in blocks.where(F.col("score") >= L.MATCH * L.SPAN).collect()} == found


# tokens


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(tiktoken_encoding):
    ranks = read_ranks(tiktoken_encoding[0])
    return Encoder(ranks, merge_table(dict(ranks)))


def test_every_merge_is_found(tiktoken_encoding):
    ranks = read_ranks(tiktoken_encoding[0])
    merges = merge_table(dict(ranks))
    assert len(merges) == len(ranks) - 256 and all(m[2] > max(m[:2]) or min(m[:2]) < 256 for m in merges)


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aaabehtTnigr '1é世😀\n", min_size=1, max_size=30), max_size=6, unique=True))
def test_words(encoder, tiktoken_encoding, words):
    encoder.known = {}
    encoder.encode(words)
    for w in words:
        assert encoder.known[w] == tiktoken_encoding[1]._core_bpe.encode_single_piece(w.encode())


def test_documents(spark, tiktoken_encoding):
    path, plain_ = tiktoken_encoding
    rows = [(1, "Hello world, it's <|endoftext|>"), (2, ""), (3, None), (4, "  \n\n  x y"), (5, "ab" * 3000 + "a" * 777), (6, "世界😀 naïve\tZÜRICH 12345"), (1, "again"), (None, "no id")]
    docs = spark.createDataFrame([(k, t, [1], "x") for k, t in rows], "doc_id bigint, text string, ids array<int>, k string")
    found = sorted((r.doc_id or 0, tuple(r.ids)) for r in encode_texts(docs, path, public_tokenizers.PATTERN).collect())
    assert found == sorted((k or 0, tuple(plain_.encode_ordinary(t) if t else [])) for k, t in rows)
    assert encode_texts(docs.limit(0), path, public_tokenizers.PATTERN).isEmpty()

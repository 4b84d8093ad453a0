import os
import random

import numpy as np
import pytest

pytest.importorskip("ahocorasick")
from leadloom.llm import packing, tokens  # noqa: E402

RANKS = os.path.join(tokens.TOKENIZER_DIR, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="vocabulary files are not here")
TEXTS = ["", " ", "Hello, world", "don't we'll I'M", "naïve café — “quoted” 🚀👩🏽‍💻", "数据平台很重要；它影响每一位客户。", "क्या आप जयपुर में", "a" * 3000, "\n\n\t  x\r\n", "<|endoftext|> is text", "x1234567890.50%", " " * 77 + "y", "ééà" * 40]


@pytest.fixture(scope="module")
def known():
    return tokens.vocabulary(RANKS)


@pytest.fixture(scope="module")
def library():
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(os.path.join(tokens.TOKENIZER_DIR, "byte_bpe_50k.json"))
    library.encode_special_tokens = True
    return lambda text: library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_the_library(known, library, text):
    assert known.encode(text) == library(text)


def test_random_texts_round_trip(known, library):
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab c'sl\n12é數🚀.,THe") for _ in range(rng.randint(0, 60)))
        ids = known.encode(text)
        assert ids == library(text)
        assert b"".join(known.token[i] for i in ids).decode() == text


def test_prefixes_and_definition(known):
    data = "internationalisation".encode()
    last = known.last_tokens(data)
    for n in range(1, len(data) + 1):
        ids = known.merged(data[:n])
        assert last[n] == ids[-1]
    assert known.last_tokens(data, known.last_tokens(data[:7])) == last


def test_appends_and_edits(known, library):
    rng = random.Random(2)
    text = tokens.Encoded(known, "We'll see what you're up to.")
    for _ in range(60):
        if rng.random() < 0.4:
            text.append(rng.choice(["l", "'", " x", "  ", "ré", "'l", "s"]))
        else:
            start = rng.randint(0, len(text.text))
            text.replace(start, min(len(text.text), start + rng.randint(0, 4)), rng.choice(["", "'", "ll", " ", "é", "ing"]))
        assert text.ids == library(text.text)


def test_query_over_odd_rows(spark, known):
    docs = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "hi there", "c"), (3, "hi there", "c"), (4, "x" * 20000, "c")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, len(r.ids)) for r in tokens.token_ids(docs).collect())
    assert got == [(1, 0), (2, 0), (3, 2), (3, 2), (4, len(known.encode("x" * 20000)))]
    assert tokens.token_ids(docs.limit(0)).count() == 0


@pytest.mark.parametrize("capacity", [64, 512, 8192])
def test_windows_hold_all_items(capacity):
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 300, 1500):
        sizes = np.minimum(rng.lognormal(4, 1, n).astype(int) + 1, capacity)
        got = packing.windows(sizes, capacity)
        assert sorted(i for w in got for i in w) == list(range(n))
        assert all(sizes[w].sum() <= capacity for w in got)
        assert packing.least_windows(sizes, capacity) <= len(got) <= packing.least_windows(sizes, capacity) * 1.03 + 1


def test_least_windows_is_a_bound():
    rng = np.random.default_rng(8)
    for _ in range(60):
        k, capacity = int(rng.integers(1, 9)), int(rng.integers(4, 60))
        parts = [np.diff(np.sort(np.concatenate([[0, capacity], rng.integers(0, capacity, rng.integers(0, 5))]))) for _ in range(k)]
        sizes = np.concatenate(parts)
        assert packing.least_windows(sizes[sizes > 0], capacity) <= k  # they fit in k windows by construction
    assert packing.least_windows(np.full(10, 6), 10) == 10 and packing.least_windows(np.full(10, 4), 10) == 5 and packing.least_windows(np.array([7, 7, 5, 5]), 10) == 3


def test_exchange_levels_what_differencing_left():
    sizes = np.array([6, 5, 4, 4, 5, 6])
    found = [[0, 1], [2, 3], [4, 5]]
    assert packing.exchange(sizes, found, 10)
    assert sorted(i for w in found for i in w) == list(range(6)) and all(sizes[w].sum() == 10 for w in found)
    assert not packing.exchange(np.array([6, 6]), [[0, 1]], 10)


def test_differencing_levels_windows():
    sizes = np.random.default_rng(1).integers(1, 100, 500)
    sums = [int(sizes[w].sum()) for w in packing.difference(sizes, 10)]
    assert sum(sums) == sizes.sum() and max(sums) - min(sums) <= 2
    assert [sorted(w) for w in packing.difference(np.array([5]), 3)] == [[0]]


def test_pack_query(spark):
    docs = spark.createDataFrame([(i, None if i % 9 == 0 else "word " * (i * 7)) for i in range(60)], "doc_id long, text string")
    specs = spark.createDataFrame([(1, 100, "byte_bpe_50k"), (2, 5000, "byte_bpe_50k"), (3, 0, "byte_bpe_50k"), (4, None, "byte_bpe_50k")], "spec_id int, capacity_tokens int, tokenizer string")
    got = packing.pack(docs, specs).toPandas()
    counts = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs).collect()}
    assert set(got.spec_id) == {1, 2}
    for spec, capacity in ((1, 100), (2, 5000)):
        rows = got[got.spec_id == spec]
        assert rows.groupby("doc_id").n_tokens.sum().to_dict() == counts
        assert rows.groupby("container_id").n_tokens.sum().max() <= capacity
        assert not rows.duplicated(["container_id", "place"]).any()
        split = rows.groupby("doc_id").size()
        assert all(counts[d] > capacity for d in split[split > 1].index)
        ordered = rows.sort_values(["container_id", "place"])
        assert (ordered.groupby("container_id").n_tokens.cumsum() - ordered.n_tokens == ordered.token_offset).all()
        pieces = rows.sort_values(["doc_id", "piece"])
        assert (pieces.groupby("doc_id").n_tokens.cumsum() - pieces.n_tokens == pieces.token_start).all()
    assert packing.pack(docs.limit(0), specs).count() == 0


def test_count_below_the_result_fails(monkeypatch):
    tried, real = [], packing.difference
    monkeypatch.setattr(packing, "difference", lambda sizes, k: tried.append(k) or real(sizes, k))
    monkeypatch.setattr(packing, "least_windows", lambda sizes, capacity: 40)
    for n in (40, 41, 47, 48, 64, 100):
        tried.clear()
        assert len(packing.windows(np.full(n, 6), 10)) == n
        assert n in tried and (n == 40 or n - 1 in tried)

"""The pipeline's near-dedup stage against brute-force Jaccard over sets of five-word shingles."""

import random

import pytest

pytest.importorskip("public_tokenizers")
pytest.importorskip("flowlab.llm")

from flowlab.llm import similar as jaccard  # noqa: E402

WORDS = [f"w{k}" for k in range(5000)]
SCHEMA = "doc_id long, text string"


def shingles(text):
    words = text.split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def some_words(rnd, n):
    return [rnd.choice(WORDS) for _ in range(n)]


def components(spark, texts):
    """Component of each text (ids are positions)."""
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    return dict(jaccard.similar_dedup(df).select("doc_id", "component_id").collect())


def brute(texts):
    root = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            if root[i] != root[j] and similarity(a, texts[j]) >= 0.8:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return dict(enumerate(root))


def test_repeated_lines_weigh_once(spark):
    """A repeated line neither makes unlike texts copies nor near copies unlike."""
    rnd = random.Random(1)
    line, a, b, c = " ".join(some_words(rnd, 8)), *(" ".join(some_words(rnd, 300)) for _ in range(3))
    texts = [f"{a} " + f"{line} " * 40, f"{b} " + f"{line} " * 40, c, f"{c} " + f"{line} " * 20]
    assert similarity(texts[0], texts[1]) < 0.1 and similarity(texts[2], texts[3]) > 0.9
    assert components(spark, texts) == {0: 0, 1: 1, 2: 2, 3: 2}


def test_stage_with_null_and_repeated_ids(spark, sf_dir):
    """Unlike texts under null ids or one repeated id all stay; near copies among them leave one row a component, the one with the least id."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(2)
    a, b, c, d, e, f, g = (some_words(rnd, 200) for _ in range(7))
    near = lambda words: words[:-1] + ["end"]
    rows = [(None, a), (None, b), (None, near(b)), (None, near(c)), (1, c), (7, d), (7, e), (7, near(f)), (2, f), (9, g), (9, g)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], SCHEMA).repartition(3)
    out = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, df, sf_dir).collect()]
    one_of_b = [r for r in out if r[1] in (" ".join(b), " ".join(near(b)))]
    assert len(one_of_b) == 1 and one_of_b[0][0] is None
    want = [(None, a), (1, c), (7, d), (7, e), (2, f), (9, g)]
    assert sorted((str(i), t) for i, t in out if (i, t) not in one_of_b) == sorted((str(i), " ".join(t)) for i, t in want)


def test_links_only_at_the_limit_or_above(spark):
    """Pairs somewhat under 0.8 stay apart; exactly 0.8 links."""
    rnd = random.Random(3)
    texts, kinds = [], []
    for changed in (30, 28, 26, 24, 22, 21, 20, 19, 15) * 3:  # new words at the end of 204: 200 shingles a text
        words = some_words(rnd, 204)
        texts += [" ".join(words), " ".join(words[:-changed] + some_words(rnd, changed))]
        kinds.append(similarity(*texts[-2:]))
    words = some_words(rnd, 184)  # 180 shingles of 225 in both together
    texts += [" ".join(words), " ".join(words + some_words(rnd, 45))]
    kinds.append(similarity(*texts[-2:]))
    assert kinds[-1] == 0.8 and sum(0.7 < k < 0.8 for k in kinds) >= 9 and sum(0.8 <= k < 0.84 for k in kinds) >= 6
    assert components(spark, texts) == brute(texts)


def test_bands_miss_no_pair_at_the_limit():
    rnd, bands = random.Random(4), jaccard.band_count(0.8)
    for _ in range(300):
        words = some_words(rnd, 184)
        a, b = (jaccard.band_keys(jaccard.shingle_set(" ".join(t), 5), bands) for t in (words, words + some_words(rnd, 45)))  # 180 of 225 shingles
        assert set(a.tolist()) & set(b.tolist())
    assert (1 - 0.8**jaccard.ROWS) ** bands <= 1e-5

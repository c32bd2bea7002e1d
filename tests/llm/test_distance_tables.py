"""The pipeline's near-dedup compares all pairs of a posting through its table of distances to reference members."""

import random

import pytest

pytest.importorskip("public_tokenizers")
similar = pytest.importorskip("flowlab.llm.similar")

from pyspark.sql import functions as F  # noqa: E402


def texts(seed, copies):
    """Texts of 200 words of which each differs from the one before at a word more."""
    rnd = random.Random(seed)
    words = [f"w{rnd.randrange(5000)}" for _ in range(200)]
    return [" ".join(words[: 200 - k] + ["x"] * k) for k in range(copies)]


def hashed(spark, seeds, copies):
    df = spark.createDataFrame([(100 * s + k, t) for s in seeds for k, t in enumerate(texts(s, copies))], "doc_id long, text string")
    return similar.shingle_rows(df, 5, similar.band_count(0.8), "doc_id", "text").cache()


def test_table_holds_distances_to_references(spark):
    rows = hashed(spark, (1, 2), 10)
    prints = {r["node"]: r["fp"] for r in rows.collect()}
    few, many = sorted(prints)[:3], sorted(prints)
    members = spark.createDataFrame([(1, n, 3) for n in few] + [(2, n, len(many)) for n in many], "key long, node long, n long")
    got = similar.distance_table(members, rows).collect()
    apart = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(prints[a], prints[b], strict=True))
    assert len(got) == 23
    for r in got:
        of = few if r["key"] == 1 else many
        assert [e["node"] for e in r["ends"]] == [min(of), max(of)]
        refs = list(dict.fromkeys(min(of, key=lambda n, p=p: n ^ p) for p in similar.PICKS))[: 2 if r["key"] == 1 else None]
        assert r["table"] == [apart(r["node"], x) for x in refs] and (r["key"] == 1 or len(refs) > 2)


def test_all_pairs_pass_the_table(spark, monkeypatch):
    """Near copies link; none does once the table puts all members far from each other."""
    rows = hashed(spark, (3,), 12)
    assert similar.set_links(rows, 0.8).count()
    made = similar.distance_table
    place = F.pmod("node", F.lit(1_000_003)).cast("int") * 600 + 600
    monkeypatch.setattr(similar, "distance_table", lambda members, sets: made(members, sets).withColumn("table", F.transform("table", lambda _: place)))
    assert similar.set_links(rows, 0.8).count() == 0

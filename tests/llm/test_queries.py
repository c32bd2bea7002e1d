"""The registered queries, all contract columns, against brute force on hand-made tables: nulls, empty and very long texts, ties, repeated rows, empty
tables, and further columns whose names operators use inside."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("flowlab.llm")

import duckdb  # noqa: E402
import tiktoken  # noqa: E402
import tokenizers  # noqa: E402
from flowlab.llm import queries  # noqa: E402
from flowlab.llm.secrets import checksum  # noqa: E402

KEY = "B" * 30
RND = random.Random(12)
WORDS = [f"word{k}" for k in range(400)]
BASE = [RND.choice(WORDS) for _ in range(300)]
TEXTS = [None, "", " \t\r\n ", "one", "One two", "one\x0btwo", "one two three", "it's we'll 'd", "x" * 3000, "".join(RND.choice("abcdefghijklmnop") for _ in range(30_000)), " ".join(BASE), " ".join(BASE), " ".join(BASE[:-1] + ["end"]), " ".join(BASE).upper(), "lorem  ipsum\ndolor " * 9000, "ünï Σ İ ß 日本語 🎉 Ᲊ", "<|endoftext|>", f"password = abcdefghijklm AKIA{'Z9' * 9} 0123456789abcdef0 ghp_{KEY}{checksum(KEY)}", "token: 'short' AKIA1 abc123", "secret=secret=secret=1234567", "tok\x00en:abcdefghijklmnop"]
ROWS = [(k, t) for k, t in enumerate(TEXTS)] + [(3, "one"), (None, "one"), (None, None), (2**60 + 1, " ".join(BASE)), (-5, "one two")] + [(1000 + k, " ".join(RND.choice(WORDS) for _ in range(RND.randint(1, 900)))) for k in range(60)]
CLASH = "digest string, fp long, bin int, node long, key string, old boolean, winner long, row long, shard int, slot long, k0 long, size long, spans string, ids string, score double, piece int, length string, start string, y int"


@pytest.fixture(scope="module", params=["rows", "none"])
def case(request, spark, tmp_path_factory):
    """(folder of tables, rows of documents)"""
    where, rows = tmp_path_factory.mktemp(request.param), ROWS if request.param == "rows" else []
    spark.createDataFrame([(*r, "en", "s", len(r[1] or ""), *[None] * 19) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").repartition(5).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(k, 1, k % 3 == 0) for k in range(0)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "cast(toxic as int) toxic").write.parquet(f"{where}/labels.parquet")
    pages = [(k, f"http://a/{k}", t) for k, t in rows]
    spark.createDataFrame([(*p, None, None) for p in pages], "page_id long, url string, html string, payload string, seq long").repartition(5).write.parquet(f"{where}/pages.parquet")
    return str(where), rows


def run(spark, case, name):
    return [tuple(r) for r in queries.QUERIES[name](spark, case[0]).collect()]


def same(got, want):
    assert Counter(map(str, got)) == Counter(map(str, want))


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path(queries.WORDS))


def against_sql(spark, case, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{case[0]}/{t}.parquet/*.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, case[0]).select(*want.columns)
    same([tuple(r) for r in got.collect()], want.fetchall())


def test_op1(spark, case):
    against_sql(spark, case, "op1_warc", "pages")


def test_op9(spark, case):
    against_sql(spark, case, "op9_exact_dedup", "documents")


def test_op2(spark, case, library):
    got, bins, want = run(spark, case, "op2_pack"), defaultdict(list), []
    for i, t in case[1]:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    same([r[:5] for r in got], want)
    for r in got:
        bins[r[5]].append((r[6], r[3]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= sum(r[3] for r in want) / 2048 * 1.05 + 2


def test_op3(spark, case):
    def brute(t):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16])

    got, want = run(spark, case, "op3_secrets"), []
    for i, t in case[1]:
        found = brute(t or "")
        base = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found]
        n = Counter(k for _, k, _ in found)
        more = [(m.start(), f"github:{m.start()}:{m.end()}") for m in re.finditer(rf"ghp_{KEY}\w+", t or "")]
        every = [s for _, s in sorted([(a, s) for (a, _, _), s in zip(found, base, strict=True)] + more, key=lambda x: x[0])]
        want.append((i, n[0], n[1], n[2], sha(",".join(base)), ",".join(every)))
    same(got, want)


def test_op4(spark, case):
    got = run(spark, case, "op4_shard")
    same([r[:3] for r in got], [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in case[1]])
    slots, sizes = defaultdict(list), Counter()
    for _, size, _, law, shard, slot, grown in got:
        assert law == "bytes" and 0 <= shard < 40 and grown is None
        slots[shard].append(slot)
        sizes[shard] += size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if got:
        mean, largest = sum(sizes.values()) / 40, max(r[1] for r in got)
        assert all(abs(sizes[k] - mean) <= mean / 100 + largest for k in range(40))
        places = defaultdict(list)  # equal texts stand together
        for r in got:
            places[r[2]].append((r[4], r[5]))
        ordered = [r[2] for r in sorted(got, key=lambda r: (r[4], r[5]))]
        assert sum(a != b for a, b in zip(ordered, ordered[1:], strict=False)) == len(places) - 1


def test_op5(spark, case, library):
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in case[1]]
    same(run(spark, case, "op5_token_counts"), want)


def test_op6(spark, case):
    def fingerprint(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fingerprint(t or "") for _, t in case[1]]
    root = {f: f for f in fps}
    for a in sorted(root):
        for b in sorted(root):
            if a < b and (a ^ b).bit_count() <= 3 and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = {f: lo if r == hi else r for f, r in root.items()}
    least = {}
    for (i, _), f in zip(case[1], fps, strict=True):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    same(run(spark, case, "op6_simhash"), [(i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(case[1], fps, strict=True)])


def test_op7(spark, case):
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(queries.RANKS), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [(i, len(ids := enc.encode_ordinary(t or "")), sha(np.array(ids, "<u4").tobytes()), sha(t or "")) for i, t in case[1]]
    same(run(spark, case, "op7_byte_bpe"), want)


def test_op8(spark, case):
    """Without labels every text has a score all the same; with the given ones see ``test_op8_held_out``."""
    got = run(spark, case, "op8_toxicity")
    same([r[:2] for r in got], [(i, i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in case[1]])
    by_text = defaultdict(set)
    for (i, _, score, predicted) in got:
        assert 0 <= score <= 1 and predicted == (score >= 0.7)
        by_text[{j: t or "" for j, t in case[1]}[i]].add(score) if i is not None else None
    assert all(len(v) == 1 for t, v in by_text.items() if t != "one")


def test_op8_held_out(spark):
    """Labels of held-out rows decide nothing: other labels there give the same scores. Repeated and null labels are allowed."""
    where = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    from flowlab.llm import toxicity
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(queries.in_training(), F.col("toxic")).otherwise(1 - F.col("toxic"))).withColumn("text", F.lit("clash"))
    odd = turned.union(turned.limit(5)).union(turned.limit(3).withColumn("toxic", F.lit(None).cast("int"))).union(turned.limit(3).withColumn("doc_id", F.lit(None).cast(labels.schema["doc_id"].dataType)))
    a, b = (dict(toxicity.score(docs, toxicity.learn(docs, x, queries.in_training())).collect()) for x in (labels, odd))
    assert a == b
    true = dict(labels.where(~queries.in_training() & F.col("toxic").isNotNull()).select("doc_id", "toxic").collect())
    assert sum((a[i] >= 0.7) == (y == 1) for i, y in true.items() if i in a) >= 0.95 * len(true)


def test_op10(spark, tmp_path):
    rng = np.random.default_rng(13)
    x = {k: rng.normal(size=16) for k in range(300)}
    x |= {k: x[0] for k in range(40, 75)}
    rows = [(k, v.tolist(), "clash") for k, v in x.items()] + [(400, None, None), (420, [0.0] * 16, None), (440, [float("nan")] * 16, None)]
    for rows_ in (rows, []):
        where = str(tmp_path / str(len(rows_)))
        spark.createDataFrame(rows_, "vec_id long, embedding array<float>, prefix string").write.parquet(f"{where}/embeddings.parquet")
        got = defaultdict(list)
        for q, rank, i, score in run(spark, (where,), "op10_permutation_index"):
            got[q].append((rank, i, score))
        if not rows_:
            assert not got
            continue
        v = {k: np.array(r, np.float32).astype(float) for k, r, _ in rows[:300]}
        assert set(got) == {k for k in v if k % 20 == 0}
        for q, found in got.items():
            want = sorted(((-float(v[i] @ v[q]), i) for i in v if i != q))[:20]
            found.sort()
            assert [(r, i) for r, i, _ in found] == [(k + 1, i) for k, (_, i) in enumerate(want)]  # so small a table is reranked whole
            assert np.allclose([s for _, _, s in found], [-s for s, _ in want], rtol=0, atol=1e-9)


def brute_runs(w):
    """(start, length, period) of all runs: every period up to a quarter of the words, the least one of each stretch."""
    n, out = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i < n - p:
            a = i
            while i < n - p and w[i] == w[i + p]:
                i += 1
            if i - a + p >= max(6, 4 * p):
                out.setdefault((a, i + p), p)
            i += 1
    return sorted((a, e - a, p) for (a, e), p in out.items())


def test_op11(spark, case):
    rows = [(k, "again and " * 9 + "end " * 7 + " ".join(RND.choice("ab") for _ in range(k % 50))) for k in range(3000, 3040)]
    extra = spark.createDataFrame([(i, t) for i, t in rows] if case[1] else [], "doc_id long, text string")
    docs = spark.read.parquet(f"{case[0]}/documents.parquet")
    where = f"{case[0]}-runs"
    docs.unionByName(extra, allowMissingColumns=True).write.mode("overwrite").parquet(f"{where}/documents.parquet")
    want = []
    for i, t in case[1] + (rows if case[1] else []):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = [(0, 27_000, 3)] if len(w) == 27_000 and h % 10 else brute_runs(w)
        gone = {k for a, n, p in found for k in range(a + p, a + n)}
        best = min(found, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2])) if found else (None,) * 3
        want.append((i, len(found), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{a},{n},{p}\n" for a, n, p in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    got = run(spark, (where,), "op11_runs")
    same(got, want)
    assert not case[1] or max(r[1] for r in got) > 1 and any(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in got)


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "lost"), (None, 1, "assistant", "found"), (1, 0, "user", "a"), (1, 1, "assistant", "<|user|> \\\\ </s> <\\/s> [\\\\/INST] [INST] < [ <<s> ü🎉"), (1, 1, "assistant", "tie"), (1, 1, "assistant", "tie"), (1, None, "user", None), (1, 7, None, ""), (2, 0, "assistant", "x" * 300_000), (3, 5, "a|b </s>\n", "odd role")], [(9, k, ("user", "assistant")[k % 2], f"t{k} " * (k % 5)) for k in range(700)]])
def test_op12(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], "conv_id long, turn long, role string, text string, node long, tree string, up int").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    against_sql(spark, (str(tmp_path),), "op12_reply_trees", "conversations")
    by = defaultdict(list)
    for c, turn, role, text in [*rows, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]:
        by[c].append((-1 if turn is None else turn, role or "", text or ""))
    want = []
    for c, turns in by.items():
        lost = "".join(t for _, r, t in sorted(turns) if r == "assistant")
        want.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in sorted(turns))), len(lost), sha(lost)))
    same([r[:5] for r in run(spark, (str(tmp_path),), "op12_reply_trees")], want)


def test_op13(spark, case, tmp_path):
    words = [w for s in ("colour", "color", "colours", "collour", "naïveté", "naiveté", "häuser", "hauser", "abcdef", "abcdeg", "abcdeh", "bcdef", "aabcdef", "ÄRGER", "ärger") for w in [s] * RND.choice([2, 3, 5, 20, 60])]
    rows = [(5000 + k, " ".join(RND.sample(words, 30)) + "-×÷_" + RND.choice(words)) for k in range(40)]
    spark.read.parquet(f"{case[0]}/documents.parquet").unionByName(spark.createDataFrame(rows if case[1] else [], "doc_id long, text string"), allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, t in case[1] + (rows if case[1] else []):
        for w in re.findall(r"[A-Za-z\u00C0-\u00FF]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            if i is not None and (h := zlib.crc32(f"{i}:{w}".encode())) % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}
    near = {w: brute_near(w, n) for w in n}
    form = {w: f for w in n if near[w] and n[f := min(near[w], key=lambda x: (-n[x], x))] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    same(run(spark, (str(tmp_path),), "op13_spelling"), [(w, form.get(w), root(w), k, len(near[w]), n.get(form.get(w))) for w, k in n.items()])
    assert not n or len(form) > 3


def brute_near(w, words):
    """The words that one edit away gives, tried out."""
    letters = sorted({x for v in words for x in v})
    return {v for k in range(len(w) + 1) for v in (w[:k] + w[k + 1 :], *(w[:k] + x + w[k:] for x in letters), *(w[:k] + x + w[k + 1 :] for x in letters)) if v != w and v in words} if len(w) < 100 else set()


def test_pipeline_of_an_empty_table(spark, case):
    got = run(spark, case, "pipeline")
    assert bool(got) == bool(case[1])
    if got:  # the base text, its copy, its upper case and its near copy are one document
        assert {r[0] for r in got} & {10, 11, 12, 13, 2**60 + 1} == {10}

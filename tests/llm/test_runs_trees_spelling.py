"""Square catching, reply trees and acceptors by themselves, against brute force."""

import random
from collections import defaultdict

import pytest

pytest.importorskip("flowlab.llm")

from flowlab.llm import reply_trees, runs, spelling  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from test_queries import brute_near, brute_runs  # noqa: E402

RND = random.Random(8)


def odd_words(length, letters):
    """Stretches that repeat, of all exponents about four, and noise between them."""
    out = []
    while len(out) < length:
        p = RND.choice([1, 2, 3, 4, 5, 8, 9, 16, 17, 31, 33])
        base = [RND.randrange(letters) for _ in range(p)]
        base = (base[: max(1, p // 3)] * p)[:p] if RND.random() < 0.3 else base
        out += [base[i % p] for i in range(int(p * RND.choice([0.5, 2, 3, 3.9, 4, 4.1, 5, 9])))]
    return [b"%d" % x for x in out[:length]]


@pytest.mark.parametrize("piece", [1, 3, 50, 1 << 14])
def test_runs_do_not_depend_on_pieces(monkeypatch, piece):
    monkeypatch.setattr(runs, "PIECE", piece)
    for _ in range(60):
        texts = [odd_words(RND.choice([0, 1, 5, 30, 200, 600]), RND.choice([1, 2, 3, 50])) for _ in range(RND.randint(0, 4))]
        assert runs.text_runs(texts) == [brute_runs(t) for t in texts]


def test_runs_appended_word_by_word():
    words = odd_words(400, 2)
    stream = runs.Catchers(len(words))
    for w in words:
        stream.append(runs.np.array([int(w)]))
    assert stream.finish() == brute_runs(words)


def test_long_texts_take_linear_time():
    """A hundred thousand equal words, three that alternate, and words of few repeats."""
    n = 100_000
    for words, want in (([b"a"] * n, [(0, n, 1)]), ([b"%d" % (k % 3) for k in range(n)], [(0, n, 3)]), ([b"%d" % (k.bit_count() % 2) for k in range(n)], [])):
        assert runs.text_runs([words]) == [want]


def test_equal_hashes_of_unlike_words(monkeypatch):
    """Hashes only propose: with as many equal ones as there can be the runs are the same."""
    monkeypatch.setattr(runs, "_mixed", lambda a, b: (a + b) % runs.np.uint64(2))
    for _ in range(40):
        words = odd_words(120, 4)
        assert runs.text_runs([words]) == [brute_runs(words)]


def test_escapes_are_reversible():
    parts = ["<", "[", "\\", "|", "|>", "/s>", "s>", "INST]", "/INST]", "a", "\n", "user"]
    for _ in range(3000):
        turns = [(RND.choice(["user", "assistant", "", "a|b<c>/\n%"]), "".join(RND.choices(parts, k=RND.randint(0, 12))), RND.random() < 0.5) for _ in range(RND.randint(0, 5))]
        text, spans = reply_trees.format_turns(turns)
        assert reply_trees.read_turns(text) == [t[:2] for t in turns]
        assert [reply_trees.unescape(text[a : a + n]) for a, n in spans] == [t[1] for t in turns if t[2]]
        assert all(c not in reply_trees.escape(t[1]) for t in turns for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))


@pytest.mark.parametrize("branches", [1, 2, None])
def test_trees(spark, branches):
    """Threads with branches, orphans, repeated ids, circles and unknown scores, against plain recursion."""
    rows = [("none", None, None, "user", "no id", 1.0), ("none", None, None, "user", "no id", 1.0), (None, 1, None, "user", "null tree", None), (None, 2, 1, "assistant", "under it", 2.0), ("c", 1, 2, "user", "circle", 1.0), ("c", 2, 1, "assistant", "circle too", 1.0), ("c", 3, 2, "user", "below", 1.0), ("d", 1, None, "user", "b twice", 0.5), ("d", 1, None, "user", "a twice", 0.5), ("d", 2, 1, "assistant", "under a", 0.5), ("o", 1, 99, None, None, 0.1), ("s", 1, 1, "user", "answers itself", 0.0)]
    for tree in ("t", "u"):
        rows += [(tree, k, None if k == 0 else RND.randrange(max(0, k - 6), k), RND.choice(["user", "assistant"]), f"{tree} {k} [INST]", RND.choice([None, 0.0, 0.5, 0.75, 2.0])) for k in range(60)]
    rows += [("long", k, k - 1 if k else None, ("user", "assistant")[k % 2], f"x{k}", None) for k in range(130)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "thread string, mid long, answers long, who string, said string, votes double, node int").repartition(3)
    messages = reply_trees.tree_messages(df, "thread", "mid", "answers", "who", "said", "votes")
    formatted = reply_trees.format_trees(messages, branches)
    got = defaultdict(list)
    for r in formatted.collect():
        got[r["tree"]].append((r["rank"], reply_trees.read_turns(r["formatted"]), [reply_trees.unescape(r["formatted"][s["start"] : s["start"] + s["length"]]) for s in r["loss"]]))
    plain = sorted(((t, i, p, r or "", x or "", s) for t, i, p, r, x, s in rows), key=lambda r: (str(r[0]), r[3], r[4]))
    first = {}
    for k, (t, i, *_) in enumerate(plain):
        if i is not None:
            first.setdefault((t, i), k)
    up = {k: first.get((t, p)) for k, (t, _, p, *_) in enumerate(plain)}
    up = {k: None if v == k else v for k, v in up.items()}
    wanted, answered = defaultdict(lambda: defaultdict(list)), set(up.values())
    for k in up:
        path = [k]
        while k not in answered and up[path[-1]] is not None and len(path) < 500:
            path.append(up[path[-1]])
        if k not in answered and len(path) < 500:
            known = [plain[x][5] for x in path if plain[x][5] is not None]
            wanted[plain[k][0]][path[-1]].append((-sum(known) / len(known) if known else 1e9, [plain[x][3:5] for x in path[::-1]], path))
    assert set(got) == set(wanted)
    for tree, roots in wanted.items():
        n = sum(min(len(v), branches or len(v)) for v in roots.values())
        assert len(got[tree]) == n
        every = [(found[0], found[1]) for v in roots.values() for found in v]
        assert all(any(turns == want for _, want in every) for _, turns, _ in got[tree])
        if branches == 1:
            assert sorted(turns for _, turns, _ in got[tree] if len(roots) == 1) in ([], *[[w] for s, w in every if s == min(s for s, _ in every)])
        shown = {x for v in roots.values() for found in v for x in found[2] if plain[x][3] == "assistant"}
        if branches is None:  # each assistant text is trained once, however many paths it is on
            assert sorted(t for _, _, loss in got[tree] for t in loss) == sorted(plain[x][4] for x in shown)
    assert reply_trees.format_trees(reply_trees.tree_messages(df.limit(0), "thread", "mid", "answers", "who", "said", "votes")).count() == 0


@pytest.mark.parametrize("limit", [1, 3, 10, 20_000])
def test_spelling_partitions(spark, limit):
    """Pairs do not depend on how often partitions are cut, nor on hot prefixes; of words of thousands of letters too."""
    words = {"".join(RND.choices("abé", k=RND.randint(5, 9))) for _ in range(150)} | {"prefix" + "".join(RND.choices("xyz", k=4)) for _ in range(60)} | {"q" * 3000, "q" * 3001, "q" * 2999 + "r"}
    n = {w: RND.choice([3, 4, 5, 9, 40, 41]) for w in sorted(words)}
    counts = spark.createDataFrame([*n.items(), ("rare", 99), ("rarer", 2), (None, 50)], "word string, n long").repartition(3)
    got = {r["word"]: r for r in spelling.variants(counts, limit=limit).collect()}
    assert set(got) == set(n)
    for w, r in got.items():
        near = brute_near(w, n) if len(w) < 100 else {v for v in n if v[:2000] == w[:2000] and v != w and (len(v) == len(w) or v + "q" == w or w + "q" == v or v[:-1] + "qq" == w or w[:-1] + "qq" == v)} - {v for v in n if {v, w} == {"q" * 3001, "q" * 2999 + "r"}}
        assert r["n_near"] == len(near), w
        best = min(near, key=lambda x: (-n[x], x)) if near else None
        assert r["form"] == (best if near and n[best] >= 2 * n[w] else None)
    assert spelling.variants(counts.where(F.lit(False))).count() == 0

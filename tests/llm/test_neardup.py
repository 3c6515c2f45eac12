import numpy as np
from docs import ODD, clashing, corpus, frame, near, words

from relaypack.llm import neardup


def brute(rows, k, percent=80):
    sets = {}
    for d, t, *_ in rows:
        sets.setdefault(d, neardup.shingle_set((t or "").encode(), k))
    ids = sorted(d for d in sets if d is not None and sets[d])
    up = {d: d for d in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return sorted(((d, len(sets[d]), top(d) if d in up else d, d is None or (top(d) if d in up else d) == d) for d, *_ in rows), key=key)


def key(r):
    return tuple(map(str, r))


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


def test_shingle_set():
    assert neardup.shingle_set(b"A b\x0bC", 2) == {(b"a", b"b"), (b"b", b"c")}
    assert neardup.shingle_set("É a".encode(), 2) == {("É".encode(), b"a")}  # only A-Z are lower-cased
    assert neardup.shingle_set(b"one", 2) == {(b"one",)} and neardup.shingle_set(b" \t", 2) == set() == neardup.shingle_set(None, 2)
    assert neardup.shingle_set("a b\x1cc d".encode(), 2) == {("a b\x1cc".encode(), b"d")}  # other blanks part no words


def test_equals_brute_force(spark):
    rows = corpus() + ODD
    for k in (2, 5):
        want = brute(rows, k)
        assert result(neardup.near_duplicates(spark, frame(spark, rows), shingle=k)) == want
        assert sum(not r[3] for r in want) >= 7


def test_hot_groups_chains_and_threshold(spark):
    """Chains of edits, a large group of near copies, pairs just at and just below the threshold."""
    base = words(90, 7)
    rows = [(i, near(base, i, 2), "en", "s", 1) for i in range(120)]
    chain = [words(120, 77)]
    for i in range(12):
        chain.append(near(chain[-1], 1000 + i, 4))
    rows += [(200 + i, t, "en", "s", 1) for i, t in enumerate(chain)]
    for i in range(30):  # sets of n and m shingles with a known overlap
        w = [f"q{i}x{j}" for j in range(101)]
        cut = 80 if i % 2 else 79  # intersection 80 or 79 of a union of 100
        rows += [(300 + 2 * i, " ".join(w), "en", "s", 1), (301 + 2 * i, " ".join(w[: cut + 1]), "en", "s", 1)]
    want = brute(rows, 2)
    assert result(neardup.near_duplicates(spark, frame(spark, rows), shingle=2)) == want
    by = {r[0]: r for r in want}
    assert all(by[301 + 2 * i][3] == (i % 2 == 0) for i in range(30))


def test_leftover_pairs_are_searched_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 8)
    rows = [(i, near(words(60, 3), i, 5), "en", "s", 1) for i in range(60)]
    assert result(neardup.near_duplicates(spark, frame(spark, rows), shingle=2)) == brute(rows, 2)


def test_clashing_columns_and_empty_table(spark):
    rows = corpus()
    assert result(neardup.near_duplicates(spark, clashing(frame(spark, rows)), shingle=2)) == brute(rows, 2)
    assert neardup.near_duplicates(spark, frame(spark, [])).collect() == []


def test_bayesian_pruning_keeps_its_promise():
    """Pairs at the threshold are lost more rarely than the chosen chance at each look, with a margin for the looks."""
    need = neardup.needed_matches(0.8, 1e-3)
    r = np.random.default_rng(1)
    a = np.zeros((20_000, neardup.SIZE), np.uint16)
    b = (r.random(a.shape) >= 0.8).astype(np.uint16)
    assert len(neardup.survivors(a, b, need)) >= len(a) * (1 - len(need) * 1e-3)
    assert len(neardup.survivors(a, (r.random(a.shape) >= 0.3).astype(np.uint16), need)) == 0


def test_signatures_estimate_similarity():
    texts = [words(400, 5).encode(), near(words(400, 5), 9, 20).encode()]
    doc, w, bound = neardup._hashes(texts, 2)
    s = neardup.signatures(doc, w, 2)
    x, y = set(w[: bound[1]]), set(w[bound[1] :])
    assert abs((s[0] == s[1]).mean() - len(x & y) / len(x | y)) < 0.12

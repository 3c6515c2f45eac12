import re
from collections import defaultdict

from docs import ODD, clashing, corpus, frame, words

from relaypack.llm import mixing

COLUMNS = ("doc_id", "size", "source_size", "target", "taken")


def sized(rows):
    return [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, _, s, _ in rows]


def water_fill(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by bisection of the level, apart from the operator's way."""
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, lo, hi = share * sum(sizes.values()), 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(mid * w[s], most * sizes[s]) for s in sizes) < total else (lo, mid)
    return {s: min(hi * w[s], most * sizes[s]) for s in sizes}


def big_corpus():
    rows = [(1000 + i, words(30 + i % 90, i), "en", "hot" if i % 3 else f"src{i % 5}", 1) for i in range(600)]
    return rows + corpus() + ODD


def check(spark, rows, df=None):
    got = mixing.mix(spark, df if df is not None else frame(spark, rows)).select(*COLUMNS, "source").collect()
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((d or -1, n) for d, _, n in sized(rows))
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, s, n in sized(rows):
        sizes[s] += n
    want = water_fill(sizes)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-3 and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    return got, taken, want


def test_targets_and_bounds(spark):
    rows = big_corpus()
    got, taken, want = check(spark, rows)
    for s in ("hot", "src0", "src1"):
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 60), (s, taken[s], want[s])
    again = mixing.mix(spark, frame(spark, rows).repartition(3)).select(*COLUMNS).collect()
    order = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:5] for r in got), key=order) == sorted((tuple(r) for r in again), key=order)


def test_clashing_columns_and_empty_table(spark):
    rows = corpus()
    check(spark, rows, clashing(frame(spark, rows)))
    assert mixing.mix(spark, frame(spark, [])).collect() == []


def test_targets_reshare_the_excess(spark):
    sums = spark.createDataFrame([("a", 10), ("b", 1000), (None, 1000)], "source string, n bigint")
    t = {r.source: r.target for r in mixing.targets(spark, sums).collect()}
    assert t["a"] == 20 and abs(sum(t.values()) - 3015) < 1e-6 and abs(t["b"] / t[None] - 2) < 1e-6 or t["b"] == 2000


def test_weights_go_by_code_point_over_many_sources(spark):
    names = [chr(0x10FFFF - 7 * i) for i in range(300)] + ["\U0001F642", "\uFF5E", "a", "B", None]
    got = {r.source: r.weight for r in mixing.weighed(spark, spark.createDataFrame([(x, 1) for x in names], "source string, n bigint"), (5, 2, 1)).collect()}
    order = [*sorted({x for x in names if x is not None}), None]
    assert got == {x: (5.0, 2.0, 1.0)[i % 3] for i, x in enumerate(order)}


def drawn(spark, rows, most=2.0, tilt=0.02, seed=7):
    """The draw in plain Python, row by row: (doc_id, size, taken) of each row."""
    hashed = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "i bigint, doc_id bigint, text string").selectExpr("i", f"(shiftrightunsigned(xxhash64({seed}, doc_id), 11) + 0.5D) / 9007199254740992D as u", "xxhash64(text) as tie").collect()
    hashes = {r.i: (r.u, r.tie) for r in hashed}
    sizes, by = defaultdict(int), defaultdict(list)
    for i, (d, s, n) in enumerate(sized(rows)):
        sizes[s] += n
        by[s].append((i, d, n))
    out, goals = {}, water_fill(sizes)
    for s, members in by.items():
        factor = lambda n: 1 + tilt * (n.bit_length() - 1)
        level, lo, hi = 0.0, 0.0, 1e6
        for _ in range(300):
            level = (lo + hi) / 2
            lo, hi = (level, hi) if sum(min(most, level * factor(n)) * n for _, _, n in members if n) < goals[s] else (lo, level)
        whole, p = {}, {}
        for i, _, n in members:
            e = min(most, hi * factor(n)) if n else 0.0
            e = round(e, 9)
            whole[i], p[i] = int(e), e - int(e)
        gap = goals[s] - sum(whole[i] * n for i, _, n in members)
        held = dict(whole)

        def key(m):
            i, d, _ = m
            u, tie = hashes[i]
            odds = u / (1 - u)
            x = odds / (odds + p[i] / (1 - p[i])) if p[i] > 0 else None  # noqa: B023
            first = x is not None and held[i] == whole[i]  # noqa: B023
            return (x / 2 if first else 0.5 + (1.0 if x is None else x) / 2), d is not None, d or 0, tie

        may = lambda m: m[2] and (p[m[0]] > 0 and held[m[0]] == whole[m[0]] or held[m[0]] + 1 <= most)  # noqa: B023, E731
        while gap > mixing.FINE * goals[s]:
            able = sorted((m for m in members if may(m) and m[2] < gap + 0.5), key=key)
            if not able:
                break
            room = gap + 0.5
            for m in able:
                if m[2] >= room:
                    break
                room -= m[2]
                gap -= m[2]
                held[m[0]] += 1
        if gap > mixing.FINE * goals[s]:
            near = sorted((abs(m[2] - gap), m) for m in members if may(m) and abs(m[2] - gap) < gap)
            if near:
                held[near[0][1][0]] += 1
        for i, d, n in members:
            out[i] = (d, n, held[i] * n)
    return sorted(map(str, out.values()))


def test_draw_equals_plain_python(spark, sf_dir):
    for rows in (corpus(), [(i, words(1 + (i * 37) % 300, i), "en", f"src{i % 3}", 1) for i in range(120)], [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]):
        got = sorted(str((r.doc_id, r.size, r.taken)) for r in mixing.mix(spark, frame(spark, rows)).collect())
        assert got == drawn(spark, rows)


def test_equal_rows_are_drawn_one_by_one(spark):
    rows = [(i, words(10, i), "en", "a", 1) for i in range(400)] + [(1000 + i, words(10, i), "en", "b", 1) for i in range(400)] + 400 * [(5000, words(10, 1), "en", "c", 1)]
    got, taken, want = check(spark, rows)
    assert all(abs(taken[s] - want[s]) <= 10 for s in "abc") and want["c"] > 1000


def test_inclusion_rises_with_size(spark):
    """Draws over many seeds keep to the expected copies."""
    rows = [(i, words(20 if i % 2 else 200, i), "en", "s" if i < 40 else "t", 1) for i in range(80)]
    df = frame(spark, rows).cache()
    total = 0
    for seed in range(5):
        r = mixing.mix(spark, df, seed=seed).groupBy("source").sum("taken", "size").collect()
        total += sum(x["sum(taken)"] for x in r)
    assert abs(total / 5 / (1.5 * sum(n for _, _, n in sized(rows))) - 1) < 0.03


def test_draw_goes_on_past_what_does_not_fit(spark):
    """One long text among short ones: every short one is taken, whatever its place in the order."""
    rows = [(0, words(20_000, 1), "en", "s", 1)] + [(i, words(200, i), "en", "s", 1) for i in range(1, 51)]
    df = frame(spark, rows).cache()
    for seed in range(3):
        got = {r.doc_id: r.taken for r in mixing.mix(spark, df, seed=seed).collect()}
        assert got == {0: 20_000} | dict.fromkeys(range(1, 51), 400)


def test_nothing_that_fits_is_left(spark):
    """Very unequal lengths, repeated rows: a gap remains only where no copy fits it."""
    rows = [(i, words(1 + (i * i * 37) % (3000 if i % 7 == 0 else 90), i), "en", f"src{i % 4}", 1) for i in range(160)]
    rows += 3 * [(500, words(40, 500), "en", "src1", 1)]
    got, taken, want = check(spark, rows)
    for s in want:
        gap = want[s] - taken[s]
        assert gap <= mixing.FINE * want[s] or all(r.taken + r.size > 2 * r.size or r.size >= gap + 0.5 for r in got if r.source == s and r.size), (s, gap)

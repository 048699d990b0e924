import pytest

from pointweave.llm import mixing


def test_targets_stop_at_three_passes():
    assert mixing.share_out([100, 100, 800], [5, 2, 1]) == [300, 300, 400]
    assert mixing.share_out([1000, 1000, 1000], [5, 2, 1]) == pytest.approx([1875, 750, 375])
    assert mixing.share_out([0, 10], [5, 1]) == [0, 10]
    assert mixing.share_out([], []) == []


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", mixing.F.lit("clash")).withColumn("s", mixing.F.lit(1))


def test_taken_is_near_target(spark):
    rows = [(i, " ".join(["w"] * (i % 50)), "é" if i % 3 else ("Z" if i % 2 else None)) for i in range(600)]
    out = mixing.taken_words(mixing.mix(docs(spark, rows), slots=2000)).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(600))
    assert {r["doc_id"]: r["size"] for r in out} == {i: i % 50 for i in range(600)}
    by = {}
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        n, t, size = by.get(r["source"], (0, 0, 0))
        by[r["source"]] = (n + r["taken"], r["target"], r["source_size"])
    sizes = {k: v[2] for k, v in by.items()}
    want = dict(zip(["Z", "é", None], mixing.share_out([sizes["Z"], sizes["é"], sizes[None]], [5, 2, 1])))
    for k, (n, t, _) in by.items():
        assert t == pytest.approx(want[k])
        assert n == pytest.approx(t, abs=40)
    again = mixing.taken_words(mixing.mix(docs(spark, rows[::-1]).repartition(3), slots=2000)).collect()
    assert {r["doc_id"]: r["taken"] for r in out} == {r["doc_id"]: r["taken"] for r in again}


def test_schedule_keeps_to_the_shares(spark):
    goals = spark.createDataFrame([(0, 0.0, 0.5, 200.0), (1, 0.5, 0.75, 100.0), (2, 0.75, 1.0, 100.0), (3, 1.0, 1.0, 0.0)], "s long, from_share double, to_share double, target double")
    slots = sorted(mixing.schedule(goals.withColumn("tier", mixing.F.lit(0)).withColumn("block", mixing.F.lit(1))).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in slots] == list(range(400))
    seen = [0, 0, 0]
    for i, r in enumerate(slots, 1):
        assert r["rank"] == seen[r["s"]]
        seen[r["s"]] += 1
        assert all(abs(n - i * p) < 3 for n, p in zip(seen, (0.5, 0.25, 0.25)))


def slow_taken(rows, at, weights=(5, 2, 1), passes=3, slots=100_000):
    """Words that the mix takes of each document, from its place in its source's line, by walking the schedule slot by slot."""
    size = {}
    for i, n, source in rows:
        size[source] = size.get(source, 0) + n
    order = sorted(size, key=lambda x: (x is None, x or ""))
    goal = mixing.share_out([size[x] for x in order], [weights[k % 3] for k in range(len(order))], passes)
    blocks, block = [], max(1, sum(size.values()) // slots)
    while True:
        blocks.append(block)
        if block == 1:
            break
        block = max(1, block // 64)
    tier = {x: next(k for k, b in enumerate(blocks) if g >= 100 * b or b == 1) for x, g in zip(order, goal)}
    taken = {i: 0 for i, *_ in rows}
    for k, block in enumerate(blocks):
        mine = [(x, g) for x, g in zip(order, goal) if tier[x] == k]
        whole, edges, got = sum(g for _, g in mine), [], {}
        for x, g in mine:
            edges.append((edges[-1] if edges else 0.0) + g / whole if whole else 0.0)
        for slot in range(round(whole / block)):
            u = slot * mixing.GOLDEN % 1.0
            for x in [x for (x, _), e in zip(mine, edges) if u < e][:1]:
                got[x] = got.get(x, 0) + 1
        for i, n, source in rows:
            if tier[source] == k:
                for turn in range(passes):
                    lo = turn * size[source] + at[i]
                    taken[i] += max(0, min(lo + n, got.get(source, 0) * block) - lo)
    return taken, dict(zip(order, goal))


def test_small_sources_come_near_their_targets_as_in_the_slow_version(spark):
    rows = [(i, 40 + i % 30, "big" if i % 2 else "next") for i in range(600)]
    rows += [(1000 + i, 1 + i % 5, f"tiny{i % 9}") for i in range(60)] + [(2000, 3, None), (2001, 0, "none")]
    table = docs(spark, [(i, " ".join(["w"] * n), x) for i, n, x in rows])
    mixed = mixing.mix(table, slots=500)
    out = {r["doc_id"]: r for r in mixing.taken_words(mixed).collect()}
    want, goal = slow_taken(rows, {r["doc_id"]: r["at"] for r in mixed.documents.collect()}, slots=500)
    assert {i: r["taken"] for i, r in out.items()} == want
    by = {}
    for i, n, x in rows:
        assert out[i]["target"] == pytest.approx(goal[x])
        by[x] = by.get(x, 0) + want[i]
    assert all(abs(by[x] - g) <= max(1.5, 0.02 * g) for x, g in goal.items())
    assert sorted(r["place"] for r in mixed.pieces.collect())[-1] < 1


def test_one_very_long_text(spark):
    out = {r["doc_id"]: r for r in mixing.taken_words(mixing.mix(docs(spark, [(1, "w " * 2_000_000, "a"), (2, "w w", "b")]))).collect()}
    assert out[1]["size"] == 2_000_000 and out[1]["taken"] == pytest.approx(out[1]["target"], rel=0.01) and out[2]["taken"] == 6 * (out[2]["target"] == 6)


def test_pieces_cover_each_document_once_a_pass(spark):
    rows = [(i, " ".join(["w"] * (7 * i % 90)), "a") for i in range(40)]
    mixed = mixing.mix(docs(spark, rows), slots=100)
    size = {i: 7 * i % 90 for i in range(40)}
    seen = {}
    for r in mixed.pieces.collect():
        seen.setdefault((r["doc_id"], r["pass"]), []).append((r["from_word"], r["n_words"]))
    for (i, k), parts in seen.items():
        at = 0
        for lo, n in sorted(parts):
            assert lo == at
            at += n
        assert at == size[i] or k > 0


def test_empty_and_wordless(spark):
    assert mixing.taken_words(mixing.mix(docs(spark, []))).count() == 0
    out = mixing.taken_words(mixing.mix(docs(spark, [(1, None, None), (2, "", "a"), (2, "", "a"), (None, " ", "a")]))).collect()
    assert len(out) == 4 and all(r["taken"] == 0 and r["target"] == 0 for r in out)

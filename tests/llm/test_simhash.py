import random

import xxhash

from pointweave.llm import simhash


def slow_print(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\r\x0b\x0c":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_groups(prints, radius):
    group = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= radius and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return group


def test_groups_match_brute_force(spark):
    rng = random.Random(1)
    vocabulary = ["été", "Alpha", "b", "c,", "dd", "İx"] + [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 120))) for _ in range(60)]
    for i in range(60):
        words = texts[i].split(" ")
        words[rng.randrange(len(words))] = "edited"
        texts.append(rng.choice([" ", "\n", "\t "]).join(words))
    texts += [texts[0]] * 30 + ["", "", None, "\x0b \r", "one two", "ONE two", "a b c d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("id", simhash.F.lit(1))
    got = {r["id"]: r for r in simhash.simhash_groups(docs).collect()}
    prints = {i: slow_print(t) for i, t in enumerate(texts)}
    assert {i: r["fp"] % (1 << 64) for i, r in got.items()} == prints
    assert {i: r["component"] for i, r in got.items()} == slow_groups(prints, 3)


def test_chunked_shards_lose_no_link(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    values = list({base} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(120)} | {rng.getrandbits(64) for _ in range(50)})
    prints = dict(enumerate(values))
    classes = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in prints.items()], "id long, fp long").selectExpr("id", "array(fp) as fps", "0L as fp2")
    links = simhash.near_links(classes, shard_rows=8)
    found = {r["node"]: r["component"] for r in simhash.connected_components(links).collect()}
    assert {i: found.get(i, i) for i in prints} == slow_groups(prints, 3)


def test_empty_table_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(none).count() == 0
    rows = simhash.simhash_groups(spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b")], "doc_id long, text string")).collect()
    assert sorted((r["id"] or 0, r["component"]) for r in rows if r["id"]) == [(3, 3), (3, 3)]
    assert [r["component"] for r in rows if r["id"] is None] == [None]


def test_tree_finds_all_within():
    rng = random.Random(3)
    values = [rng.getrandbits(12) for _ in range(300)]
    tree = simhash.BKTree()
    for v in values:
        tree.insert(v)
    for q in range(0, 4096, 97):
        assert {tree.values[i] for i in tree.within(q, 3)} == {v for v in values if (v ^ q).bit_count() <= 3}


def test_check_tells_copies_from_like_vocabulary(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(150)]
    one, other = rng.choices(words, k=400), rng.choices(words, k=400)
    near = one[:200] + ["new"] + one[201:]
    docs = spark.createDataFrame(list(enumerate(" ".join(t) for t in (one, rng.sample(one, 400), near, other, one))), "doc_id long, text string")
    got = {r["id"]: r["component"] for r in simhash.simhash_groups(docs, kinds=(simhash.Kind(1, True), simhash.Kind(1, True, 43)), max_distance=4, check=simhash.Check()).collect()}
    assert got[2] == got[4] == got[0] == 0 and got[1] == 1 and got[3] == 3

import math
import random
import re
import time

from pyspark.sql import functions as F

from pointweave.llm import privacy

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n // 10 + n % 10
    return total % 10 == 0


def slow(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def random_texts(n):
    rng = random.Random(9)
    bits = ["a@b.c", "x.y@z-1.com.", "@", "..", ".", "_d@e.f", "1.2.3.4", "255.256.1.1", "0001.2.3.00255.6", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "+1 (555) 123-4567", "+", "555", " ", "\n", "é", "👩‍🚀", "\x01", "\x02", "-", "--", "(", "12", "+49.30.1234567", "a..b@c.d", "a@b", "@b.c"]
    return ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(n)]


def test_base_spans_match_the_patterns(spark):
    texts = [*random_texts(1500), None, "", "1 " * 6000, "a." * 20_000 + "@" + "b." * 20_000, "9" * 5000, "+" + "1" * 3000, "a" * 30_000 + "@x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, text string").withColumn("spans", F.expr(privacy.base_spans("coalesce(text, '')")))
    got = {r["i"]: r["s"] for r in docs.select("i", F.expr(privacy.listed("spans")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == slow(t), repr(t)[:200]


def bound(k, m):
    """Wilson's lower bound of a share, one standard error."""
    p = k / m
    return (p + 1 / (2 * m) - math.sqrt(p * (1 - p) / m + 1 / (4 * m * m))) / (1 + 1 / m)


def slow_terms(rows, left_bits=0.9, gain_bits=1.0, reach=120, together=3):
    """Spans of kind term by counting over all documents."""
    texts = [t or "" for _, t in rows]
    word = re.compile(r"[^\W\d_]{3,}")
    has = [set(w.lower() for w in word.findall(t)) for t in texts]
    entity, holds, near = {}, {}, {}
    for i, t in enumerate(texts):
        for kind, start, end in ((k, int(a), int(b)) for k, a, b in (x.split(":") for x in slow(t).split(",") if x)):
            value = re.sub("[^0-9]", "", t[start:end]) if kind == "card" else t[start:end]
            e = entity.setdefault((kind, value), len(entity))
            holds.setdefault(e, set()).add(i)
            left, right = t[max(0, start - reach) : start], t[end : end + reach]
            left = re.sub(r"^[^\W\d_]+", "", left) if start > reach else left
            right = re.sub(r"[^\W\d_]+$", "", right) if end + reach < len(t) else right
            for w in word.findall(f"{left} {right}"):
                near.setdefault((e, w.lower()), set()).add(i)
    n, out = len(rows), [set() for _ in rows]
    reveal, elsewhere = {}, {}
    for (e, w), docs in near.items():
        with_t = sum(w in h for h in has)
        low = bound(len(docs), with_t)
        if -math.log2(low) <= left_bits and math.log2(low / (len(holds[e]) / n)) >= gain_bits:
            reveal.setdefault(e, set()).add(w)
            if with_t > len(docs):
                elsewhere.setdefault(e, set()).add(w)
    for e, ws in reveal.items():
        for i in range(n):
            other = elsewhere.get(e, set()) & has[i]
            gone = ws if i in holds[e] else other if len(other) >= together else set()
            out[i] |= {(m.start(), m.end()) for m in word.finditer(texts[i]) if m[0].lower() in gone}
    return out


def test_terms_match_the_slow_version(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 6))) for _ in range(700)] + ["Écho", "12", "x"]
    common = vocabulary[:30] * 20
    rows = [(i, " ".join(rng.choices(vocabulary + common, k=rng.randint(0, 60)))) for i in range(300)]
    for i in range(40):
        k = rng.randrange(8)
        said = [f"Zebulon{'abcdefgh'[k]} Quist{'abcdefgh'[k]} of Nowhere{'abcdefgh'[k]}", f"write p{k}@host.org or +1 555 010 999{k}"]
        rows.append((500 + i, f"{rows[i][1]}\n{' '.join(said[: 1 if i % 9 == 0 else 2])} {rows[i + 40][1]}"))
    rows += [(None, "p1@host.org"), (900, None), (900, "Quista elsewhere"), (901, "copied Lonesome one@two.org")] + [(902, "copied Lonesome one@two.org")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("spans", F.lit("clash"))
    out = privacy.all_spans(privacy.find(docs.repartition(3))).collect()
    want = sorted((i is None, i or 0, t or "", sorted(x)) for (i, t), x in zip(rows, slow_terms(rows)))
    by_text = {t or "": x for (_, t), x in zip(rows, slow_terms(rows))}
    assert len(out) == len(rows)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, sorted((s["start"], s["end"]) for s in r["spans"] if s["kind"] == 4)) for r in out)
    assert got == sorted((a, b, x) for a, b, _, x in want)
    assert any(x and "@" not in t for t, x in by_text.items())  # a document that reveals without naming
    assert all([s for s in r["spans"] if s["kind"] < 4] == r["base"] for r in out)
    assert privacy.all_spans(privacy.find(docs.limit(0))).count() == 0


def test_the_measure_does_not_move_with_the_corpus(spark):
    """The same documents beside ten times as many others lose the same terms, and a word seen once stays."""
    said = [(i, f"ask Quirin Vandal q{i // 4}@host.org {'lonely' if i == 5 else ''} today") for i in range(4)] + [(5, "Solitary sits by only@once.org")]
    found = []
    for more in (40, 400):
        rows = said + [(100 + i, f"today others ask other{'abcdefghij'[i % 10]}") for i in range(more)]
        out = privacy.all_spans(privacy.find(spark.createDataFrame(rows, "doc_id long, text string"))).where("doc_id < 100").collect()
        found.append({r["doc_id"]: [s["value"] for s in r["spans"] if s["kind"] == 4] for r in out})
    assert found[0] == found[1] and found[0][0] == ["Quirin", "Vandal"] and found[0][5] == []


def test_a_long_line_full_of_addresses(spark):
    line = " ".join(f"name{i} word{i % 700} é a{i}@b{i % 50}.org" for i in range(30_000))
    began = time.time()
    docs = spark.createDataFrame([(1, line), (2, line[:100_000]), (3, "none here")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in privacy.all_spans(privacy.find(docs)).collect()}
    assert len(out[1]["base"]) == 30_000 and len(out[3]["spans"]) == 0
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitised(docs, length_col=None).collect()}
    assert clean[1].count("[EMAIL]") == 30_000 and "@" not in clean[1] and clean[3] == "none here"
    assert time.time() - began < 90


def test_redaction(spark):
    text = "é a@b.c and +1 555 123 4567 8 x"
    row = spark.createDataFrame([(text,)], "text string").withColumn("spans", F.expr(privacy.base_spans("text")))
    assert row.select(F.expr(privacy.redacted("text", "spans")).alias("t")).first()["t"] == "é [EMAIL] and [PHONE] x"

"""Personal data, and the terms that reveal it, in DataFrame functions only.

Base spans are found by fixed patterns, each kind leftmost and non-overlapping, and checked (parts of an
address, digits of a phone, Luhn's sum of a card).  Places are code points: a text is split by
a pattern, and the lengths of pieces and matches add up.  Patterns are written so that Java neither
recurses nor rescans: separators inside a card number and dots inside a domain are first replaced by
a mark of the same length.

Terms.  Each distinct value found is a protected entity e.  A term t (a lower-cased word of
three letters or more, known by its hash) that stands within ``reach`` code points of e leaves of its information IC(e) = -log2 P(e)

    left(t, e) = IC(e) - PMI(t, e) = -log2 P(e|t)

bits open: 0 if t occurs only with e.  P(e|t) is taken at its lower confidence bound (Wilson's, of one standard error), so that what was seen
seldom proves little: seen once it is 1/2, twice 2/3.  A term that leaves at most ``left_bits`` open, and whose PMI by the same bound is
``gain_bits`` or more, is removed like e itself, wherever it stands, from documents that hold e: it gets spans of kind ``term``.
Neither bound moves with the size of the corpus: a larger one of the same make has the same terms.  Each copy of a document counts.  A word that
occurs in one document only says nothing beyond it, and stays.  A document without e that holds ``together``
or more of the terms that reveal it tells who is meant by their combination, and loses these terms too; fewer than
that are chance.  Terms are removed, not generalised: the corpus holds no broader words to put in their place.

Cost.  A text is cut into blocks of ``BLOCK`` code points once, and what lies around a span is cut from
its blocks; running sums go by groups of ``GROUP`` matches.  So work grows with a text's length, whatever number
of spans it holds.  Only words that stand by an entity often enough to reveal it are counted, summed in each task before the shuffle.  Finding spans sends the
marked rows' ids to the texts, by broadcast if they are few; replacing them joins each text with its terms, which shuffles it once.

Defined cases: a null text is empty; rows that repeat an id, or lack one, are documents of
their own; a text that holds U+0001 or U+0002 is searched as if these were other letters; an entity that all
documents hold has no terms; a text is searched whole, whatever its length.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.sources.scratch import Scratch

BLOCK, GROUP = 1000, 256

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = r"A-Za-z0-9._%+\x01-"
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9\x01]{2,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_SPAN = "struct<start:int,kind:int,end:int,value:string>"  # in the order to sort by


def _marked(text: str, inner: str) -> str:
    """SQL: the text with each inner separator replaced by U+0001, and its own U+0001 by U+0002."""
    return f"regexp_replace(translate({text}, '\\u0001', '\\u0002'), r'{inner}', '\\u0001')"


def _scan(items: str, start: str, step: str, out: str, kind: str) -> str:
    """SQL: for each x of an array what ``out`` makes of it and of the state s before it, in groups, so that the cost is linear; ``step`` is the next state."""
    empty, groups = f"cast(array() as array<{kind}>)", f"cast(array() as array<array<{kind}>>)"
    inner = f"aggregate(g, struct(o.s as s, {empty} as found), (i, x) -> struct({step.replace('s.', 'i.s.')} as s, array_append(i.found, {out.replace('s.', 'i.s.')}) as found))"
    cut = f"transform(sequence(0, greatest(size(it) - 1, 0) div {GROUP}), k -> slice(it, k * {GROUP} + 1, {GROUP}))"
    each = _once(inner, "r", "struct(r.s as s, array_append(o.all, r.found) as all)")
    return _once(items, "it", f"aggregate({cut}, struct({start} as s, {groups} as all), (o, g) -> {each}, o -> flatten(o.all))")


def _once(value: str, name: str, then: str) -> str:
    """SQL: an expression that reads a value by name, which is so computed once."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def _places(text: str, pattern: str) -> str:
    """SQL: the matches m of a pattern with their start."""
    matches = f"regexp_extract_all({text}, r'{pattern}', 0)"
    pieces = f"zip_with(slice(split({text}, r'{pattern}', -1), 1, size({matches})), {matches}, (p, m) -> struct(length(p) as p, m as m))"
    return _scan(pieces, "struct(0 as at)", "struct(s.at + x.p + length(x.m) as at)", "struct(s.at + x.p as start, x.m as m)", "struct<start:int,m:string>")


def _found(kind: int, text: str, pattern: str, may: str, value: str, sound: str) -> str:
    """SQL: spans of one kind; ``may`` tells cheaply whether there can be any, ``value`` and ``sound`` read m."""
    spans = f"transform({_places(text, pattern)}, y -> named_struct('start', y.start, 'kind', {kind}, 'end', y.start + length(y.m), 'value', {value.replace('m.', 'y.m')}))"
    return f"case when {may} then filter({spans}, x -> {sound}) else cast(array() as array<{_SPAN}>) end"


def blocks(text: str) -> str:
    """SQL: a text in blocks of BLOCK code points."""
    return f"regexp_extract_all({text}, r'(?s).{{1,{BLOCK}}}+', 0)"


def _cut(of: str, lo: str, hi: str) -> str:
    """SQL: code points lo to hi of a text that is given as blocks."""
    inside = f"array_join(slice({of}, ({lo}) div {BLOCK} + 1, (({hi}) - 1) div {BLOCK} - ({lo}) div {BLOCK} + 1), '')"
    return f"if(({hi}) > ({lo}), substring({inside}, ({lo}) % {BLOCK} + 1, ({hi}) - ({lo})), '')"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


#: Each second digit from the right counts double, its own digits summed.
_LUHN = """(aggregate(sequence(1, length(D)), 0, (s, i) -> s + if(i % 2 = 1, int(substring(D, length(D) - i + 1, 1)),
    element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), int(substring(D, length(D) - i + 1, 1)) + 1))) % 10 = 0)"""


def base_spans(text: str) -> str:
    """SQL: all base spans of a text column, by start, then kind."""
    email = _found(0, _marked(text, "(?<=[A-Za-z0-9-])[.](?=[A-Za-z0-9-])"), EMAIL, f"contains({text}, '@')", "replace(m., '\\u0001', '.')", "true")
    ip = _found(1, text, IP, f"{text} rlike r'[0-9][.][0-9]+[.][0-9]'", "m.", f"x.value rlike '^{OCTET}([.]{OCTET}){{3}}$'")
    card = _found(2, _marked(text, r"(?<=[0-9])[\x20-](?=[0-9])"), CARD, f"{text} rlike r'[0-9](?:[\\x20-]?[0-9]){{13}}'", _digits("m."), f"length(x.value) between 14 and 19 and {_LUHN.replace('D', 'x.value')}")
    phone = _found(3, text, PHONE, f"contains({text}, '+')", "m.", f"length({_digits('x.value')}) between 10 and 15")
    return f"array_sort(concat({email}, {ip}, {card}, {phone}))"


def listed(spans: str) -> str:
    """SQL: spans as text, kind:start:end joined by commas."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat_ws(':', element_at(array({names}), x.kind + 1), x.start, x.end)), ',')"


def _words(text: str) -> str:
    """SQL: hashes of the distinct lower-cased words of three letters or more."""
    return f"array_distinct(transform(regexp_extract_all(lower({text}), r'\\p{{L}}{{3,}}+', 0), w -> xxhash64(w)))"


class Found(NamedTuple):
    """``rows``: row, doc_id, text, spans (base), carry.  ``terms``: row, more (spans of kind term)."""

    rows: DataFrame
    terms: DataFrame


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", left_bits: float = 0.9, gain_bits: float = 1.0, reach: int = 120, together: int = 3, whole: bool = False, broadcast_rows: int = 1_000_000) -> Found:
    """whole: the rows keep all other columns of the documents in ``carry.c``, and in ``carry.gone`` whether the text was null.  Up to ``broadcast_rows`` terms go to the words of all documents by broadcast, more by a shuffle."""
    tmp = Scratch(docs.sparkSession, "privacy")
    others = F.struct(*[c for c in docs.columns if c != text_col])
    carry = F.struct(others.alias("c"), F.col(text_col).isNull().alias("gone")) if whole else F.lit(0)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), carry.alias("carry"))
    spans = texts.withColumn("spans", F.expr(base_spans("text"))).withColumn("row", F.monotonically_increasing_id())
    rows = tmp.write(spans.select("row", "doc_id", "text", "spans", "carry"), "spans")
    # What stands around each entity; a word that the reach cuts is left out.
    before = f"regexp_replace({_cut('blocks', f'greatest(s.start - {reach}, 0)', 's.start')}, if(s.start > {reach}, r'^\\p{{L}}+', r'\\A\\z'), '')"
    after = f"regexp_replace({_cut('blocks', 's.end', f'least(s.end + {reach}, n)')}, if(s.end + {reach} < n, r'\\p{{L}}+$', r'\\A\\z'), '')"
    near = f"transform(spans, s -> named_struct('e', xxhash64(s.kind, s.value), 'ts', {_words(f"concat_ws(' ', {before}, {after})")}))"
    near = _once(blocks("text"), "blocks", _once("length(text)", "n", near))
    held = rows.where("size(spans) > 0")
    around = tmp.write(held.select("row", F.explode(F.expr(near)).alias("x")).select("row", "x.*"), "around")
    holds = tmp.write(around.select("row", "e").distinct(), "holds")
    seen = holds.groupBy("e").agg(F.count("*").alias("with_e"))
    pair = around.select("row", "e", F.explode("ts").alias("t")).distinct()
    enough = 2.0**-left_bits
    # A term has at least as many documents as it shares with e, so its bound is at most k / (k + 1).
    both = pair.groupBy("e", "t").agg(F.count("*").alias("both")).where(F.col("both") / (F.col("both") + 1) >= enough)
    both = tmp.write(both, "pairs")
    asked = tmp.write(both.select("t").distinct(), "asked")
    # In how many documents each of these stands: all documents count; summed in each task first.
    word = rows.select("row", F.explode(F.expr(_words("text"))).alias("t"))
    sent = F.broadcast(asked) if asked.count() <= broadcast_rows else asked
    every = word.join(sent, "t", "left_semi").groupBy("t").agg(F.count("*").alias("with_t"))
    n = rows.count()
    m, share = F.col("with_t"), F.col("both") / F.col("with_t")
    low = (share + 0.5 / m - F.sqrt(share * (1 - share) / m + 0.25 / (m * m))) / (1 + 1 / m)
    known = both.join(every, "t").join(seen, "e").where((low >= enough) & (low * n >= F.col("with_e") * 2.0**gain_bits))
    known = tmp.write(known.select("e", "t", (F.col("with_t") > F.col("both")).alias("elsewhere")), "revealing")
    # Each document meets the terms it has, not all that its entities have.
    hit = word.join(F.broadcast(known) if known.count() <= broadcast_rows else known, "t").join(holds.withColumn("held", F.lit(True)), ["row", "e"], "left")
    hit = tmp.write(hit.where("held or elsewhere").select("row", "e", "t", F.coalesce("held", F.lit(False)).alias("held")), "hits")
    # Documents that don't hold the entity, but enough of its terms.
    many = hit.where("not held").groupBy("row", "e").agg(F.count("*").alias("k")).where(F.col("k") >= together)
    told = hit.where("not held").join(many, ["row", "e"], "left_semi")
    marks = tmp.write(hit.where("held").unionByName(told).select("row", "t").distinct(), "marks")
    runs = F.explode(F.expr(_places("text", r"\p{L}{3,}+"))).alias("x")
    run = rows.join(marks.select("row").distinct(), "row", "left_semi").select("row", runs).select("row", F.xxhash64(F.lower("x.m")).alias("t"), F.expr("named_struct('start', x.start, 'kind', 4, 'end', x.start + length(x.m), 'value', x.m)").alias("s"))
    found = run.join(marks, ["row", "t"], "left_semi").groupBy("row").agg(F.collect_list("s").alias("more"))
    terms = tmp.write(found, "terms")
    tmp.drop(around, holds, both, asked, known, hit, marks)
    return Found(rows, terms)


def all_spans(found: Found) -> DataFrame:
    """``row, doc_id, base, spans`` of every document: base spans, and all spans."""
    return _with_terms(found.rows.select("row", "doc_id", F.col("spans").alias("base")), found.terms).select("row", "doc_id", "base", "spans")


def _with_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    every = "concat(base, coalesce(more, cast(array() as array<%s>)))" % _SPAN
    return rows.join(terms, "row", "left").withColumn("spans", F.expr(f"array_sort({every})"))


def redacted(text: str, spans: str) -> str:
    """SQL: the text with each span replaced by its kind in brackets; overlapping spans give one gap."""
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    marked = f"array_append({spans}, named_struct('start', length({text}), 'kind', -1, 'end', length({text}), 'value', ''))"
    gaps = _scan("m", "struct(0 as at)", "struct(greatest(s.at, x.end) as at)", "struct(s.at as lo, x.start as hi, x.kind as kind)", "struct<lo:int,hi:int,kind:int>")
    label = f"if(y.kind < 0, '', element_at(array({names}), y.kind + 1))"
    piece = f"case when y.hi >= y.lo then concat({_cut('b', 'y.lo', 'y.hi')}, {label}) else '' end"
    return _once(blocks(text), "b", _once(marked, "m", f"array_join(transform({gaps}, y -> {piece}), '')"))


def sanitised(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", **how: object) -> DataFrame:
    """The documents with spans replaced in their texts; those without spans pass as they are."""
    found = find(docs, text_col=text_col, whole=True, **how)
    every = _with_terms(found.rows.withColumnRenamed("spans", "base"), found.terms)
    new = F.expr(f"case when size(spans) > 0 then {redacted('text', 'spans')} when not carry.gone then text end")
    every = every.select("carry.c", (F.size("spans") > 0).alias("changed"), new.alias("new"))
    fresh = {text_col: F.col("new")}
    if length_col:
        fresh[length_col] = F.when(F.col("changed"), F.length("new"))
    old = {c: F.col("c").getField(c) for c in docs.columns if c != text_col}
    columns = [F.coalesce(fresh[c].cast(docs.schema[c].dataType), *([old[c]] if c in old else [])).alias(c) if c in fresh else old[c].alias(c) for c in docs.columns]
    return every.select(*columns)

"""URL filters by rules, and by what links tell about hosts that no rule decides.

A rule is a host and a path, such as ``example.com/en/``: it fits the urls of its host and all subdomains whose path starts with
its path.  The longest rule that fits decides (of rules as long, the one with the longer host).

Link graph.  Every ``href`` with a host of its own is an edge from the page's host to that host; edges between two hosts count
once, and those of a host to itself don't count.  Two personalised PageRanks run over the edges:

* trust starts from hosts with allowed pages, by the share of a host's pages that rules allow, and follows links;
* distrust starts from hosts with blocked pages, by the share that rules block, and follows links backwards: who links to
  blocked hosts is distrusted.

A host's mass is (1 - damping) of its own share and ``damping`` of what its neighbours pass on in equal parts.  The shares aren't
divided by the number of hosts, so a mass means the same in a corpus of any size: a host without links all of whose pages are
blocked has a distrust of 0.15.  A host is blocked if distrust less trust reaches ``(1 - damping) * share``, with a share
of one half: as much as half of one's pages being blocked, no page allowed and no links.  Pages of other hosts, of hosts that no
seed reaches and without a host are allowed.

Masses are whole numbers of ``UNIT`` parts, so that a run's result doesn't depend on the order of sums.  They start from nothing and
only rise; ``rounds`` rounds are walks of fewer links than that, and what longer walks would add is below ``damping ** rounds``
of all seeds.  The loop ends early when nothing rises.

Cost.  One pass reads the pages; what is kept of a page is its host, path, rule and distinct linked hosts.  Each round is a join of edges
with masses by host and a sum that is aggregated before the shuffle.  Verdicts reach pages by a join with the blocked hosts
only, under ``salts`` keys a host, as one host may hold a third of all pages.

Defined cases: a null url, or one without ``://``, has an empty host and path; a null html has no links; a host may hold a
port or a user, as it stands; rows that repeat an id are pages of their own; a long host is matched by its last labels, as
many as a rule has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.sources.scratch import Scratch

UNIT = 1_000_000_000
DAMPING = 85  # per cent

_LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'<>\s]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: str) -> Column:
    at = F.instr(F.coalesce(F.col(url).cast("string"), F.lit("")), "://")
    return F.when(at > 0, F.substr(F.col(url).cast("string"), at + 3)).otherwise("")


def host_of(url: str) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the rules (verdict, host and path) that fits, as a struct ``size, host_size, rule, verdict``; null if none does."""
    parted = [(verdict, rule, *rule.partition("/")[::2]) for verdict, rule in rules]
    names = F.split(host, r"\.", -1)
    most = max((h.count(".") + 1 for *_, h, _ in parted), default=1)
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(names), F.lit(most))), lambda k: F.array_join(F.slice(names, -k, k), "."))
    found = [
        F.when(F.array_contains(ends, h) & F.startswith(path, F.lit("/" + p)), F.struct(F.lit(len(rule)).alias("size"), F.lit(len(h)).alias("host_size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))
        for verdict, rule, h, p in parted
    ]
    none = F.lit(None).cast("struct<size:int,host_size:int,rule:string,verdict:string>")
    return F.array_max(F.array(none, *found))


def ruled(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict`` (null: no rule fits) and ``links``, the distinct other hosts that a page links to."""
    links = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(html_col).cast("string"), F.lit("")), F.lit(_LINK), F.lit(1)), lambda h: F.translate(h, _UPPER, _LOWER)))
    base = pages.select(F.col(id_col).alias("page_id"), host_of(url_col).alias("host"), path_of(url_col).alias("path"), links.alias("links"))
    out = base.withColumn("r", fitting_rule(F.col("host"), F.col("path"), rules))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"), F.filter("links", lambda h: h != F.col("host")).alias("links"))


def host_seeds(found: DataFrame) -> DataFrame:
    """``kind, host, seed``: the share of a host's pages that rules allow (kind trust) or block (kind distrust), where there are any."""
    n = found.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "allow").alias("trust"), F.count_if(F.col("verdict") == "block").alias("distrust"))
    shares = n.select("host", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.expr(f"({UNIT} * {k}) div n").alias("seed")) for k in ("trust", "distrust")])).alias("s"))
    return shares.select("s.kind", "host", "s.seed").where("seed > 0")


def host_edges(found: DataFrame) -> DataFrame:
    """``src, dst``: each pair of hosts of which one links to the other, once."""
    return found.where("host <> ''").select(F.col("host").alias("src"), F.explode("links").alias("dst")).distinct()


def propagated(seeds: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``kind, host, mass``: trust along the edges and distrust against them (kinds of seeds), in parts of UNIT."""
    tmp = Scratch(seeds.sparkSession, "trust")
    base = tmp.write(seeds.select("kind", "host", F.expr(f"((100 - {DAMPING}) * seed) div 100").alias("mass")), "base")
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = both.groupBy("kind", "src").agg(F.count("*").alias("degree"))
    both = tmp.write(both.join(degree, ["kind", "src"]), "edges")
    now, total = base, None
    if both.isEmpty():
        return now
    for _ in range(rounds - 1):
        passed = both.join(now.select("kind", F.col("host").alias("src"), "mass"), ["kind", "src"])
        passed = passed.select("kind", F.col("dst").alias("host"), F.expr(f"(cast(mass as decimal(28,0)) * {DAMPING}) div (100 * degree)").alias("mass"))
        then = tmp.write(base.unionByName(passed).groupBy("kind", "host").agg(F.sum("mass").alias("mass")), "round")
        if now is not base:
            tmp.drop(now)
        now, before = then, total
        total = now.agg(F.sum(F.col("mass").cast("decimal(38,0)"))).first()[0]
        if total == before:  # masses only rise, so an equal sum means equal masses
            break
    return now


def distrusted_hosts(masses: DataFrame, share: float = 0.5) -> DataFrame:
    """``host``: those whose distrust less trust reaches the threshold."""
    net = masses.groupBy("host").agg(F.sum(F.when(F.col("kind") == "distrust", F.col("mass")).otherwise(-F.col("mass"))).alias("net"))
    return net.where(F.col("net") >= int((100 - DAMPING) * UNIT * share) // 100).select("host")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], rounds: int = 50, share: float = 0.5, salts: int = 64) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page; ``verdict`` is the rule's, or else what the links tell about the host."""
    tmp = Scratch(pages.sparkSession, "urls")
    found = tmp.write(ruled(pages, rules), "pages")
    blocked = distrusted_hosts(propagated(host_seeds(found), host_edges(found), rounds), share)
    blocked = blocked.select("host", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), F.lit("block").alias("_told"))
    salted = found.withColumn("_salt", F.when(F.col("rule").isNull(), F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int")))  # a ruled page asks nobody
    out = salted.join(blocked, ["host", "_salt"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "_told", F.lit("allow")).alias("verdict"))

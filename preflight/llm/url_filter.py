"""Operator 6 — URL rules and a weighted URL vocabulary.

Rules name a host and the start of a path; a rule fits its host and all
subdomains, and the longest that fits decides.  Where none does, an
Aho-Corasick automaton finds the vocabulary's terms in the URL (A-Z
lowered) in one scan; a term counts only between characters other than
letters and digits.  One strict term, or ``MIN_SOFT`` distinct soft ones,
block the page.

Host and path: the host follows the first ``://`` up to ``/``, ``?``, ``#`` or the
end, A-Z lowered; the path goes on to ``?``, ``#`` or the end.

Cases: a null URL or one without ``://`` has an empty host and path and fits
no rule; a null URL has no terms; repeated rows get equal rows; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preflight.llm.ship import ship

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))
STRICT = ("camgirls", "escorts", "hentai", "malware", "phishing", "porn", "sexcam", "spam", "warez", "xxx")
SOFT = ("adult", "bet", "betting", "bonus", "casino", "cheap", "crack", "dating", "free", "gambling", "jackpot",
        "keygen", "loans", "nude", "payday", "pills", "poker", "replica", "sex", "slots", "torrent", "viagra", "win")
MIN_SOFT = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TABLE = str.maketrans(UPPER, LOWER)


def automaton(strict=STRICT, soft=SOFT):
    a = ahocorasick.Automaton()
    for term in strict:
        a.add_word(term, (term, True))
    for term in soft:
        a.add_word(term, (term, False))
    a.make_automaton()
    return a


def terms(url: str | None, a) -> tuple[set, set]:
    """Strict and soft terms that stand alone in a URL."""
    strict, soft = set(), set()
    if url:
        u = url.translate(_TABLE)
        own = [c.isascii() and c.isalnum() for c in u]
        for end, (term, hard) in a.iter(u):
            begin = end - len(term)
            if (begin < 0 or not own[begin]) and (end + 1 == len(u) or not own[end + 1]):
                (strict if hard else soft).add(term)
    return strict, soft


def _count(strict, soft):
    def run(batches):
        a = automaton(strict, soft)
        for b in batches:
            got = [terms(u, a) for u in b.column(b.schema.get_field_index("url")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([len(x) for x, _ in got], pa.int32()), pa.array([len(y) for _, y in got], pa.int32())],
                names=[*b.schema.names, "n_strict", "n_soft"])
    return run


def parts():
    """Host and path of the column ``url``."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substring(F.col("url"), at + 3, F.length("url"))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return (F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def judge(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, min_soft: int = MIN_SOFT) -> DataFrame:
    """``page_id, host, path, rule, verdict, n_strict, n_soft`` for every row
    of ``pages`` (page_id, url)."""
    ship(pages.sparkSession)
    slim = pages.select("page_id", "url")
    kind = slim.schema["page_id"].dataType.simpleString()
    found = slim.mapInArrow(_count(strict, soft), f"page_id {kind}, url string, n_strict int, n_soft int")
    host, path = parts()
    found = found.withColumns({"host": host, "path": path})
    rule = action = None
    for act, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, slash, rest = text.partition("/")
        fits = (((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(slash + rest))
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        action = F.when(fits, F.lit(act)) if action is None else action.when(fits, F.lit(act))
    own = F.when((F.col("n_strict") > 0) | (F.col("n_soft") >= min_soft), "block").otherwise("allow")
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, own).alias("verdict"),
                        "n_strict", "n_soft")


def op6_url_filter(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_sql() -> str:
    alone = lambda t: f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INT)"
    order = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    fits = [f"(host = '{t.split('/')[0]}' OR ends_with(host, '.{t.split('/')[0]}')) AND starts_with(path, '{t[t.index('/'):]}')"
            for _, t in order]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{t}'" for f, (_, t) in zip(fits, order)) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{a}'" for f, (a, _) in zip(fits, order)) + \
        f" WHEN n_strict > 0 OR n_soft >= {MIN_SOFT} THEN 'block' ELSE 'allow' END"
    low = f"translate(%s, '{UPPER}', '{LOWER}')"
    return (f"WITH p AS (SELECT page_id, {low % "coalesce(url, '')"} AS u, "
            "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages), "
            f"q AS (SELECT page_id, {low % "regexp_extract(rest, '^([^/?#]*)', 1)"} AS host, "
            "regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, "
            f"{' + '.join(alone(t) for t in STRICT)} AS n_strict, {' + '.join(alone(t) for t in SOFT)} AS n_soft FROM p) "
            f"SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, n_strict, n_soft FROM q")

"""URL filter: rules first, then logistic regression on hashed character n-grams; DataFrame functions only.

The model is fitted on a small labelled URL table of a fixed size on the driver and
enters the plan as one literal array.
"""

from __future__ import annotations

import math
import random
import zlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, GRAM = 4096, 4
#: At most so many labelled URLs are used.
MAX_LABELLED = 5000

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


# Words of unwanted and of wanted URLs.
BAD = "casino poker bet slots jackpot lottery bingo roulette pills viagra cialis pharma steroid xxx porn adult sexy nude escort webcam ads advert banner popunder tracker click affiliate doubleclick redirect promo spam loan payday forex binary crack warez keygen torrent malware phish".split()
GOOD = "news blog docs wiki shop school library museum city health science travel music garden recipes weather forum support press journal history art sports market books cloud code data learn help maps photo radio team village church theatre law energy trade".split()
BAD_PATHS = "bonus win free cheap buy-now prize click track redirect offer deal video-xxx go out aff landing signup-bonus no-deposit hot unsubscribe".split()
GOOD_PATHS = "article page about guide en fr de es post archive index.html story chapter product category tag author section events contact".split()
_ONSETS, _VOWELS = "b br c ch d f g gr h k l m n p pr r s st t th tr v w".split(), "a e i o u ai ea ou".split()


def labelled_urls(part: int = 0, size: int = 1200) -> list[tuple[str, int]]:
    """The default labelled table, made by a rule from word lists and invented names: 1 is unwanted.

    Parts hold different names and combinations, and a tenth of the URLs of either kind shows no telling word in its host; part 1 is for measuring.
    """
    rng = random.Random(f"urls-{part}")
    name = lambda: "".join(rng.choice(_ONSETS) + rng.choice(_VOWELS) for _ in range(rng.randint(2, 4)))
    out = []
    for i in range(size):
        bad = i % 2 == 1
        words, paths = (BAD, BAD_PATHS) if bad else (GOOD, GOOD_PATHS)
        word, own = rng.choice(words), name()
        host = own if i % 10 < 1 else rng.choice([f"{word}.{own}", f"{own}-{word}", f"{word}{rng.randint(1, 99)}-{own}", f"{own}{word}", f"www.{word}-{own}", f"{word}-{rng.choice(words)}"])
        tld = rng.choice("com net org biz info io ru xyz".split() if bad else "com net org edu gov io de fr".split())
        path = "/".join(rng.choice([rng.choice(paths), rng.choice(paths), name(), str(rng.randint(1, 9999)), rng.choice(words)]) for _ in range(rng.randint(1, 4)))
        out.append((f"{rng.choice(['http', 'https'])}://{host}.{tld}/{path}{rng.choice(['', '', '/', '.html', '?id=7'])}", int(bad)))
    return out


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _split(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    host = rest
    for c in "/?#":
        host = host.partition(c)[0]
    path = rest[len(host) :].partition("?")[0].partition("#")[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def _grams(host: str, path: str) -> list[int]:
    text = f"^{host}$"
    texts = [text, f"|{path}|"]
    return [zlib.crc32(t[i : i + GRAM].encode()) % BUCKETS for t in texts for i in range(max(1, len(t) - GRAM + 1))]


def train(labelled: list[tuple[str, int]], rounds: int = 30, decay: float = 1e-3) -> list[float]:
    """Weights of the buckets, then the bias, by gradient descent on the mean of n-gram weights."""
    rows = [(_grams(*_split(u)), y) for u, y in labelled[:MAX_LABELLED]]
    w, bias = [0.0] * BUCKETS, 0.0
    for _ in range(rounds if rows else 0):
        for grams, y in rows:
            n = len(grams)
            z = bias + sum(w[g] for g in grams) / n
            left = y - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            bias += 0.05 * left
            for g in grams:
                w[g] += 2.0 * (left - decay * w[g]) / n
    return [*w, bias]


@lru_cache(maxsize=1)
def default_weights() -> tuple[float, ...]:
    return tuple(train(labelled_urls()))


def _scored(host: Column, path: Column, weights) -> Column:
    table = F.array(*map(F.lit, weights[:-1])) if len(weights) < 64 else F.split(F.lit(",".join(map(repr, weights[:-1]))), ",").cast("array<double>")

    def grams(text: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (GRAM - 1)))
        return F.transform(starts, lambda i: F.element_at(table, (F.crc32(F.substring(text, i, GRAM)) % BUCKETS + 1).cast("int")))

    each = F.concat(grams(F.concat(F.lit("^"), host, F.lit("$"))), grams(F.concat(F.lit("|"), path, F.lit("|"))))
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    return 1 / (1 + F.exp(-(F.lit(weights[-1]) + total / F.size(each))))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] = RULES, weights: list[float] | None = None) -> DataFrame:
    """One row per page: (page_id, host, path, rule, verdict, score).

    A rule (verdict, host + path) fits its host and all subdomains if the URL's path starts with the
    rule's; the longest that fits decides (on equal length the first listed), else the model: block at a score of 0.5 or more.

    Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and gets the
    model's score of empty strings; an empty path starts with no rule's path; null ids stay; repeated rows are judged alike; other columns are ignored.
    """
    weights = weights or default_weights()
    host, path = host_path(F.col("u"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("u")).select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(reversed(rules), key=lambda r: len(r[1])):  # later, longer and first listed rules go in front
        own, _, rest = text.partition("/")
        fits = ((F.col("host") == own) | F.col("host").endswith(f".{own}")) & F.col("path").startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    out = rows.withColumn("rule", rule).withColumn("by_rule", verdict).withColumn("score", _scored(F.col("host"), F.col("path"), weights))
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")

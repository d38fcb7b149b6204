"""URL filters: rules first, then naive Bayes over segmented host and path words.

Method: host names run words together, so every letter run of a host or path is split by
a unigram Viterbi search: the split whose words have the largest product of probabilities,
unknown words costing a factor of ten for each letter; no word has more than `LONGEST_WORD`
letters. Word counts come from the path words of all URLs of the table; a host's run is often
several words in one and teaches none, and so does a path's that consists of dictionary words.
Words of the dictionary have a share of `DICTIONARY_SHARE` at least, so that they are found
in tables of any size.

The words go to a multinomial naive Bayes model whose log odds have two parts. One comes from
a general dictionary of words that speak for blocking or allowing (or a table of such words
that the caller gives), with add-one smoothing. The other comes from the sites of the table:
sites whose words speak for blocking by `SURE` or more by the first part teach that class, all
others teach the class to allow, each word once for each site, smoothed by `BACKGROUND`
words of the whole table's distribution. So words that stand beside telling ones become telling, and those
that stand everywhere tell nothing; no word gets more than `SURE` this way. The model stays a
table and is joined to the words.

Only distinct runs are segmented; the counts of all words that stand in a run come by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import stored

#: The least probability of a word of the dictionary.
DICTIONARY_SHARE = 1e-4
#: The share of sites to block that is assumed before any word is seen.
PRIOR = 0.3
#: A word of the dictionary counts as so many occurrences.
DICTIONARY_WEIGHT = 10
#: Log odds, without the prior, from which on a site teaches the class to block.
SURE = 2.0
#: Words of the whole table's distribution that are added to either class of sites.
BACKGROUND = 50
LONGEST_WORD = 24

#: Fixed values: (host and path prefix, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Words that speak for blocking: gambling, adult content, medicines sold by mail, fraud and
#: junk, advertising networks, stolen software.
BLOCK_WORDS = """
    casino casinos gambling gamble poker roulette blackjack jackpot slots slot bet bets betting bookmaker bookie lottery lotto baccarat wager bingo
    porn porno sex sexy xxx adult nude nudes escort escorts erotic fetish hentai milf camgirl webcam cams hookup brothel
    viagra cialis levitra pill pills pharmacy steroids steroid painkillers tramadol xanax opioids slimming diet weightloss
    spam scam scams phishing phish fraud fake hoax payday loans loan cash money millionaire prize prizes winner giveaway backlinks linkfarm replica replicas counterfeit
    ads advert adserver adserv banner banners popup popunder affiliate affiliates clickbait tracker trackers tracking
    malware virus trojan spyware ransomware keygen keylogger crack cracked cracks warez torrent torrents pirate pirated hack hacks cheats
""".split()

#: Words that speak for allowing: news, learning, public services, culture, home and work.
ALLOW_WORDS = """
    news times journal daily weekly gazette herald tribune press magazine report reports article articles archive editorial
    science research institute university college school academy library museum gallery education course lesson lecture history physics biology chemistry math
    government council ministry parliament city town village county public service health hospital clinic doctor weather climate transport police court law
    music film theatre theater art book books poetry novel review reviews sport sports football league tennis club
    cooking recipe recipes kitchen garden home family travel guide hotel map maps nature animals photo photos
    software code developer docs documentation manual wiki forum community support help contact about privacy terms technology engineering business company bank jobs careers
""".split()


@dataclass(frozen=True)
class Words:
    """Log10 probabilities of known words, and the total count behind them."""

    known: dict[str, float]
    total: float

    @classmethod
    def of(cls, counts: dict[str, int]) -> Words:
        total = sum(counts.values())
        return cls({w: math.log10(n / total) for w, n in counts.items()}, total)

    def log(self, word: str) -> float:
        return self.known.get(word, 1 - math.log10(self.total) - len(word))

    def split(self, run: str) -> list[str]:
        """The most probable words of a run of letters; ties prefer the longer last word."""
        best = [0.0] + [-math.inf] * len(run)
        start = [0] * (len(run) + 1)
        for end in range(1, len(run) + 1):
            for at in range(max(0, end - LONGEST_WORD), end):
                score = best[at] + self.log(run[at:end])
                if score > best[end]:
                    best[end], start[end] = score, at
        out, end = [], len(run)
        while end:
            out.append(run[start[end] : end])
            end = start[end]
        return out[::-1]


def dictionary(spark, block: Sequence[str] = BLOCK_WORDS, allow: Sequence[str] = ALLOW_WORDS) -> DataFrame:
    """(w, bad, good): how often each word of the general dictionary counts for either class."""
    rows = [(w, DICTIONARY_WEIGHT * (w in {*block}), DICTIONARY_WEIGHT * (w in {*allow})) for w in sorted({*block, *allow})]
    return spark.createDataFrame(rows, "w string, bad long, good long")


def bayes(counts: DataFrame) -> DataFrame:
    """(w, odds): log odds of blocking of each word, by add-one smoothing, from (w, bad, good)."""
    size, bad, good = counts.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    odds = F.log((F.col("bad") + 1) / F.lit(float(bad + size or 1))) - F.log((F.col("good") + 1) / F.lit(float(good + size or 1)))
    return counts.select("w", F.round(odds, 9).alias("odds"))


def learnt(site_words: DataFrame, words: DataFrame) -> DataFrame:
    """(w, odds) from the dictionary (w, bad, good) and the distinct (host, w) of all sites."""
    told = bayes(words)
    sums = site_words.join(told, "w", "left").groupBy("host").agg(F.sum(F.coalesce("odds", F.lit(0.0))).alias("odds"))
    taught = site_words.join(sums.select("host", (F.col("odds") >= SURE).cast("long").alias("bad")), "host")
    taught = stored(taught.groupBy("w").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")), "taught")
    bad, good = taught.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    usual = BACKGROUND * (F.col("bad") + F.col("good")) / F.lit(float(bad + good or 1))
    odds = F.log((F.col("bad") + usual) / F.lit(float(bad + BACKGROUND))) - F.log((F.col("good") + usual) / F.lit(float(good + BACKGROUND)))
    sites = taught.select("w", F.round(F.greatest(F.least(odds, F.lit(SURE)), F.lit(-SURE)), 9).alias("more"))
    return told.join(sites, "w", "full").select("w", (F.coalesce("odds", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))).alias("odds"))


def parts(url):
    """Host (A-Z lower-cased) and path of a URL column; both empty without ://."""
    # translate() and not lower(): only A-Z change
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = url.isNotNull() & (F.locate("://", url) > 0)
    rest = F.substring_index(url, "://", 1)
    rest = F.substring(url, F.length(rest) + 4, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.when(found, F.translate(host, upper, lower)).otherwise(""), F.when(found, path).otherwise("")


def rule_of(host, path, rules: Sequence[tuple[str, str]]):
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    fitting = []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, way = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + way)
        fitting.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fitting) if fitting else F.lit(None).cast("struct<rule:string,verdict:string>")


def word_counts(urls: DataFrame) -> DataFrame:
    """(w, n): how often each path word of two to LONGEST_WORD letters stands in the URLs."""
    runs = urls.select(F.explode(F.expr("regexp_extract_all(lower(path), '[a-z]+', 0)")).alias("w"))
    return runs.filter(f"length(w) between 2 and {LONGEST_WORD}").groupBy("w").agg(F.count("*").alias("n"))


def segmented(runs: DataFrame, counts: DataFrame, known_words: frozenset[str]) -> DataFrame:
    """(run, split): the words of each of the distinct runs."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(20.0, DICTIONARY_SHARE * total)
    total += least * len(known_words)
    pieces = f"transform(sequence(1, length(run) - 1), i -> transform(sequence(2, least({LONGEST_WORD}, length(run) - i + 1)), n -> substring(run, i, n)))"
    pieces = runs.filter("length(run) > 1").select("run", F.explode(F.expr(f"array_distinct(flatten({pieces}))")).alias("w"))
    found = pieces.join(counts, "w").groupBy("run").agg(F.collect_list("w").alias("ws"), F.collect_list("n").alias("ns"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for run, ws, ns in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                inside = known_words & {run[a:b] for a in range(len(run)) for b in range(a + 2, min(len(run), a + LONGEST_WORD) + 1)}
                known = {w: n for w, n in zip(ws or (), ns or (), strict=True) if w in inside or not _composed(w, known_words)}
                known = {w: known.get(w, 0) + (least if w in inside else 0) for w in {*known, *inside}}
                out.append(Words({w: math.log10(n / total) for w, n in known.items()}, total).split(run))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["run", "split"])

    return runs.join(found, "run", "left").select("run", "ws", "ns").mapInArrow(split, "run string, split array<string>")


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, words: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, host, path, rule, verdict, words and log_odds of every row.

    A rule is a host suffix of whole labels, a slash and a path prefix; the longest that
    fits decides, else naive Bayes blocks when its log odds are above zero. words (w, bad, good) replaces the
    general dictionary; it is held in memory and so a table of a dictionary's size. Null URLs and
    those without :// have empty host and path, no words and the verdict of the prior.
    Rows are judged one by one, whatever their ids; repeated rows repeat their verdict and teach once.
    Extra columns are ignored. An empty table gives an empty result.
    """
    words = dictionary(pages.sparkSession) if words is None else words
    host, path = parts(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"))
    urls = stored(urls.withColumn("k", F.monotonically_increasing_id()), "urls")
    runs = urls.select("k", "host", F.posexplode(F.expr("regexp_extract_all(concat(host, ' ', lower(path)), '[a-z]+', 0)")).alias("at", "run"))
    known_words = frozenset(r.w for r in words.select("w").collect())
    splits = stored(segmented(runs.select("run").distinct(), stored(word_counts(urls), "counts"), known_words), "splits")
    site_words = runs.select("host", "run").distinct().join(splits, "run").select("host", F.explode("split").alias("w")).distinct()
    odds = learnt(stored(site_words, "site_words"), words)
    weighed = splits.select("run", F.explode("split").alias("w")).join(odds, "w").groupBy("run").agg(F.sum("odds").alias("odds"))
    weighed = splits.join(weighed, "run", "left")
    rows = runs.select("k", "at", "run").join(weighed, "run").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("at", "split"))).alias("words"), F.sum("odds").alias("odds"))
    prior = math.log(PRIOR) - math.log(1 - PRIOR)
    judged = urls.join(rows, "k", "left").withColumn("log_odds", F.coalesce("odds", F.lit(0.0)) + prior)
    judged = judged.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
    found = F.coalesce(F.flatten("words.split"), F.array().cast("array<string>"))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), found.alias("words"), "log_odds")


def _composed(run: str, words) -> bool:
    """Is the run made of two or more of the words, each of three letters or more?"""
    reach = [True] + [False] * len(run)
    for end in range(1, len(run) + 1):
        reach[end] = any(reach[at] and run[at:end] in words for at in range(max(0, end - LONGEST_WORD), end - 2))
    return reach[-1] and run not in words


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages."""
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")

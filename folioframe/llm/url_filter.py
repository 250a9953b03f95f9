"""URL filter: rules, and logistic regression on hashed character n-grams.

Host and path are cut out of the url, a rule list decides where one fits, and
elsewhere a logistic regression on the hashed character 3- to 5-grams of host
and path, trained from a small labelled table of urls.  Everything is
DataFrame functions and Spark's own estimators; pages never meet.
"""

from __future__ import annotations

import random
from functools import lru_cache

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind

#: Buckets of the hashed n-grams, lengths of the n-grams.
BUCKETS = 1 << 16
GRAMS = (3, 4, 5)

#: (verdict, host, path).  A rule fits its host and all subdomains where the
#: url's path starts with the rule's; the longest host + path wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

# Words of the labelled table.  Unwanted: adult, gambling, drugs,
# money, goods, fraud, copies.  Bait: words that such hosts add to any other.
_UNWANTED = (
    "adult porn porno xxx sex sexy sexcam nude nudes escort escorts milf fetish erotic hookup camgirl webcamsex singles slut "
    "bet bets bets10 sportbet bookmaker casino casinos gamble gambler jackpot lottery lotto poker roulette slot slots blackjack bingo wager "
    "pill pills pharma medz viagra cialis levitra xanax tramadol steroids weed drugs painkillers rx "
    "loan loans payday cash crypto bitcoin forex pyramid getrich invest millionaire debt "
    "replica replicas fake fakes counterfeit knockoff spam spamfarm phishing scam malware virus trojan keylogger botnet hack hacked hacks "
    "crack cracked cracks keygen serialz warez torrent torrents nulled pirate iptv"
).split()
_BAIT = "cheap free buy hot win prize best fast easy instant money secret login verify account secure update bonus deal now online 24 4u x vip club".split()
_ORDINARY = (
    "archive art atlas autumn bakery beta better betty bicycle bird blog book books bridge cabinet camera castle cello chapel chess city class classic coast cocktail coffee college compass cooking cotton country craft dance design "
    "docs doctor sextant essence expert exchange farm field film finance flower forest forum garden geology glass harbor health history horse hospital house institute island jazz journal kitchen lake language "
    "law library light lunch maps market math medicine medieval meadow metal mountain museum music nature news ocean office opera orchard paint paper park pharmacology photo physics piano pilot plant planet poetry pottery press "
    "radio railway ranch recipes research review river road sail school science seminar shop slope sport station stone street study summer system tax teacher theatre therapist tools torque tourism town travel tree "
    "university valley village violin walking water weather web wiki winter wood workshop world writing yoga zoology"
).split()
#: What places and families put before or behind any short syllable, also behind one that is a word above.
_PLACE_STARTS, _PLACE_ENDS = "al bar ches dor el hert il kent lan mid nor ol somer suf tun wes".split(), "ady am aney bourne bury by combe dale don ell en er ers field ford gate ham hurst ier ingham ington land ley low man mere mouth ney nor on ridge sey shire side son stead stone ten ter thorpe ton tree vale ville wall well wick wood worth y".split()
_SYLLABLES = "ther tion ing ed re on an en th ou st er at es or ha nd ti ble wh sh ly".split()
_ONSETS = "b bl br c ch cl cr d dr f fl fr g gl gr h j k kn l m n p pl pr qu r s sc sh sk sl sp st str t th tr tw v w wh y z".split()
_RIMES = "a ab ack ad ade ain al all am an and ane ar ark art ase ast ate ave ay e ea ead ear eat ed ee eel een en ent er est et ew i ice ick id ide ike ile ill im in ind ine ing ip ite o oad oat ob ock od og oint old on one ong ood ook oom oon op or ore ot ound out ow own u ub uck ue um un up ur ust ut y".split()
_SUFFIXES = "com net org info example.org example.net example.com".split()
_PAGES = "about articles en de fr es blog news item page post topic guide help contact".split()


def labelled_urls(n: int = 12000, seed: int = 3, part: int | None = None, of: int = 5) -> list[tuple[str, int]]:
    """A small table (url, 1 = block), made by rule from words of hosts and paths.

    Every ``of``-th word of the unwanted and ordinary ones is left out with
    ``part`` 0, and only those are used with ``part`` 1: a table to learn from
    and one of words never learned.  The bait is the same in both.
    """
    rng, rows = random.Random(seed), []
    use = lambda words: [w for i, w in enumerate(words) if part is None or (i % of == 0) == bool(part)]
    unwanted, ordinary = use(_UNWANTED), use(_ORDINARY)
    short = [w for w in unwanted if len(w) <= 5]

    def spelled(word: str) -> str:
        """A word as those who hide it write it: digits for letters, k for c, a letter twice, an end more."""
        kind = rng.random()
        if kind < 0.08:
            return "".join({"a": "4", "e": "3", "i": "1", "o": "0", "s": "5"}.get(c, c) if rng.random() < 0.5 else c for c in word)
        if kind < 0.14:
            return word.replace("c", "k").replace("ph", "f")
        if kind < 0.2:
            at = rng.randrange(len(word))
            return word[: at + 1] + word[at:]
        return word + rng.choice(["s", "er", "z", "ing"]) if kind < 0.28 else word

    for i in range(n):
        bad = int(i % 5 < 2)
        name = "".join(rng.choice(_ONSETS) + rng.choice(_RIMES) for _ in range(rng.randint(1, 3)))
        plain = rng.choice([rng.choice(ordinary), rng.choice(ordinary) + rng.choice(["", "-", ""]) + rng.choice(ordinary), "".join(rng.choices(_SYLLABLES, k=rng.randint(2, 4))), name, name + rng.choice(["", "-"]) + rng.choice(ordinary), rng.choice(short) + rng.choice(_PLACE_ENDS), rng.choice(_PLACE_STARTS) + rng.choice(short)])
        word, glue = spelled(rng.choice(unwanted)), rng.choice(["", "-", "-", ""])
        spam = rng.choice([word, rng.choice(_BAIT) + glue + word, word + glue + rng.choice(_BAIT), glue.join([rng.choice(_BAIT), word, rng.choice(_BAIT)]), word + glue + rng.choice(unwanted)])
        in_path = bad and rng.random() < 0.2
        host = rng.choice(["", "", "www.", "www.", "m.", "blog."]) + (spam if bad and not in_path else plain) + "." + rng.choice(_SUFFIXES)
        path = rng.choice(["", "/", f"/{rng.choice(_PAGES)}/", f"/{rng.choice(_PAGES)}/{rng.randint(1, 999)}", f"/{rng.choice(ordinary)}", f"/{rng.choice(_PAGES)}/{rng.choice(ordinary)}.html"])
        rows.append((f"https://{host}{path.rstrip('/') + '/' + spam if in_path else path}", bad))
    return rows


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for null or a url without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def with_parts(df: DataFrame, url_col: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    host, path = host_and_path(F.col(url_col))
    return df.select(*keep, host.alias("host"), path.alias("path"))


def with_rule(df: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Adds ``rule`` ("net/es/", null if none fits) and ``rule_verdict``."""
    rule = verdict = None
    for kind, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    empty = F.lit(None).cast("string")
    return df.withColumn("rule", empty if rule is None else rule).withColumn("rule_verdict", empty if verdict is None else verdict)


def grams(host: Column, path: Column) -> Column:
    """Array of the character n-grams of ``host path``, the ends marked."""
    letters = F.split(F.concat(F.lit("^"), host, F.lit(" "), F.lower(path), F.lit("$")), "")

    def of_length(c: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(c) - n)), lambda i: F.concat_ws("", *[F.get(c, i + j) for j in range(n)]))

    return bind(letters, lambda c: F.concat(*[of_length(c, n) for n in GRAMS]))


def train(spark: SparkSession, labelled: list[tuple[str, int]] | None = None) -> PipelineModel:
    """Logistic regression from (url, 1 = block) rows; ``labelled_urls()`` by default."""
    rows = spark.createDataFrame(labelled or labelled_urls(), "url string, label int")
    parts = with_parts(rows, keep=("label",))
    ready = parts.select(F.col("label").cast("double").alias("label"), grams(F.col("host"), F.col("path")).alias("grams"))
    stages = [HashingTF(numFeatures=BUCKETS, binary=True, inputCol="grams", outputCol="features"), LogisticRegression(regParam=0.02, maxIter=60)]
    return Pipeline(stages=stages).fit(ready.coalesce(1))


@lru_cache(maxsize=2)
def _trained(spark: SparkSession) -> PipelineModel:
    return train(spark)


def judge(df: DataFrame, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), rules: tuple[tuple[str, str, str], ...] = RULES, model: PipelineModel | None = None) -> DataFrame:
    """``keep`` columns plus ``host, path, rule, verdict`` ("allow" or "block").

    The rule's verdict, or else the regression's.  Null urls and urls without
    ``://`` have empty host and path and are allowed unless a rule fits them.
    Rows are independent; an empty table gives an empty one.
    """
    ruled = with_rule(with_parts(df, url_col, keep), rules).withColumn("grams", grams(F.col("host"), F.col("path")))
    scored = (model or _trained(df.sparkSession)).transform(ruled)
    nothing = (F.col("host") == "") & (F.col("path") == "")
    own = F.when(nothing, "allow").when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return scored.select(*keep, "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"))

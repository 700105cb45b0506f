"""Free-entered values to entries of a reference list.

Over distinct values only:

1. each distinct word is linked to the words of the list and of its alias tables by
   their deletions of up to two letters (:func:`leadloom.llm.common.close_words`), so typos
   disappear;
2. a prefix-filter set-similarity join: each value, now a set of list words, is joined to
   the entries through the rarest word of an entry. All words of an entry have to be in the
   value, so this prefix of length one loses nothing; length and containment are verified
   exactly and the best Jaccard value is kept.

What is left is choice between entries of the same name by the region or country the
value states.

Defined results: null and blank values give nothing; a value equal to an entry's name
gives nothing; values without an entry give 0; a location that names two places gives
two rows; ties go to the least id; repeated values give one row per row of the table;
very long values are read whole; empty tables give empty results (an empty list gives
0 for every value); extra columns are not read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.llm.common import EPSILON, close_spelling, close_words, fold_words
from leadloom.runtime import bounded_rows, durable

#: US states, code and name.
STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut", "de": "delaware",
    "dc": "district of columbia", "fl": "florida", "ga": "georgia", "hi": "hawaii", "id": "idaho", "il": "illinois", "in": "indiana", "ia": "iowa", "ks": "kansas",
    "ky": "kentucky", "la": "louisiana", "me": "maine", "md": "maryland", "ma": "massachusetts", "mi": "michigan", "mn": "minnesota", "ms": "mississippi",
    "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada", "nh": "new hampshire", "nj": "new jersey", "nm": "new mexico", "ny": "new york",
    "nc": "north carolina", "nd": "north dakota", "oh": "ohio", "ok": "oklahoma", "or": "oregon", "pa": "pennsylvania", "ri": "rhode island",
    "sc": "south carolina", "sd": "south dakota", "tn": "tennessee", "tx": "texas", "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington",
    "wv": "west virginia", "wi": "wisconsin", "wy": "wyoming",
}
#: Names and codes of countries, folded.
COUNTRIES = {
    "united states": "us usa america", "united kingdom": "uk gb gbr england scotland britain", "germany": "de deu ger deutschland", "france": "fr fra",
    "spain": "es esp espana", "portugal": "pt prt", "italy": "it ita italia", "netherlands": "nl nld holland nederland", "ireland": "ie irl",
    "switzerland": "ch che schweiz suisse", "poland": "pl pol polska", "india": "in ind", "canada": "ca can", "australia": "au aus", "singapore": "sg sgp",
    "japan": "jp jpn", "brazil": "br bra brasil", "mexico": "mx mex", "argentina": "ar arg",
}
#: Other names of cities, folded.
CITY_ALIASES = {
    "nyc": "new york", "manhattan": "new york", "brooklyn": "new york", "sf": "san francisco", "san fran": "san francisco", "frisco": "san francisco", "la": "los angeles", "philly": "philadelphia", "slc": "salt lake city",
    "saint louis": "st louis", "munchen": "munich", "muenchen": "munich", "koln": "cologne", "koeln": "cologne", "zuerich": "zurich", "geneve": "geneva", "genf": "geneva", "lisboa": "lisbon",
    "milano": "milan", "roma": "rome", "warszawa": "warsaw", "cracow": "krakow", "bangalore": "bengaluru", "cdmx": "mexico city", "ciudad de mexico": "mexico city", "mexico df": "mexico city",
    "sevilla": "seville", "wien": "vienna", "turin": "torino", "bombay": "mumbai", "vegas": "las vegas", "atl": "atlanta", "washington dc": "washington", "nola": "new orleans", "indy": "indianapolis", "capd": "cape town",
}
#: Words of locations that name no place.
PLACE_NOISE = (
    "and or office hq hybrid greater area downtown metro bay fully remote remotely client site field based multiple locations various worldwide see description "
    "anywhere within the work from home wfh region onsite on headquarters global emea latam apac tbd city of de df"
)
#: Abbreviations of titles; a phrase of words to the words it stands for.
TITLE_ALIASES = {
    "eng": "engineer", "engr": "engineer", "mgr": "manager", "prod": "product", "dev": "developer", "solns": "solutions", "soln": "solutions", "solution": "solutions", "sr": "senior", "snr": "senior",
    "jr": "junior", "jnr": "junior", "ld": "lead", "bi": "business intelligence", "qa": "quality assurance", "ml": "machine learning", "sre": "site reliability engineer",
    "swe": "software engineer", "csm": "customer success manager", "back end": "backend", "front end": "frontend", "arch": "architect", "sw": "software", "pm": "product manager",
}
#: Words of titles that belong to no job.
TITLE_NOISE = "team req all genders m w d f x full time part urgent permanent contract onsite hybrid remote and of the or for"

_MATCH = T.ArrayType(T.IntegerType())
#: Least share of letter pairs of a word and the list word it spells, and of two spellings of a word no list has.
MIN_JACCARD, SETTLED_JACCARD = 0.25, 0.4
#: Most remote entries, one per country; a longer list raises.
MOST_REMOTE = 300


def spelled(spark: SparkSession, words: DataFrame, lexicon: list[str] | DataFrame, exact_only: set[str] = frozenset()) -> DataFrame:
    """word, lexeme: the word of the lexicon each observed word spells; words without one are missing. ``exact_only``: codes that no typo may give."""
    if isinstance(lexicon, list):
        lexicon = spark.createDataFrame([(w,) for w in sorted(set(lexicon))], "lexeme string")
    pairs = close_words(words.distinct(), lexicon.distinct()).filter(F.col("jaccard") >= MIN_JACCARD - EPSILON)
    same = F.col("word") == F.col("lexeme")
    typo = close_spelling(F.col("word"), F.col("lexeme")) & (F.length("word") >= 3) & (F.length("lexeme") >= 3)
    typo &= (F.length("lexeme") >= 4) | (F.substring("word", 1, 1) == F.substring("lexeme", 1, 1))
    if exact_only:
        typo &= ~F.col("lexeme").isin(sorted(exact_only))
    return pairs.filter(same | typo).groupBy("word").agg(F.max_by("lexeme", F.struct(same, "jaccard", -F.levenshtein("word", "lexeme"), F.length("lexeme"), "lexeme")).alias("lexeme"))


def lexeme_values(spark: SparkSession, values: DataFrame, lexicon: list[str] | DataFrame, exact_only: set[str] = frozenset()) -> tuple[DataFrame, DataFrame]:
    """``ids``: vid, value of each distinct value. ``spelt``: vid, lexemes (its words in order, spelled as the lexicon has them), extra (words it doesn't have).

    Values with the same folded words share a vid and are handled once. Only ids travel
    with the words, so a very long value is never copied per word. Values without words
    are in ``ids`` only.
    """
    worded = durable(values.select("value", F.array_join(fold_words(F.col("value")), " ").alias("form")))
    forms = durable(worded.groupBy("form").agg(F.lit(1).alias("_")).select("form", F.monotonically_increasing_id().alias("vid")))
    split = forms.filter("form <> ''").select("vid", F.posexplode(F.split("form", " ")).alias("pos", "word"))
    links = spelled(spark, split.select("word"), lexicon, exact_only)
    each = split.join(links, "word", "left")
    parts = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("lexeme", "word").alias("w"), F.col("lexeme").isNull().alias("x"))))
    out = each.groupBy("vid").agg(parts.alias("p"))
    return worded.join(forms, "form").select("vid", "value"), out.select("vid", F.transform("p", lambda x: x["w"]).alias("lexemes"), F.transform(F.filter("p", lambda x: x["x"]), lambda x: x["w"]).alias("extra"))


def replace_phrases(words: list[str], table: dict[tuple[str, ...], list[str]], longest: int) -> list[str]:
    out, i = [], 0
    while i < len(words):
        for n in range(min(longest, len(words) - i), 0, -1):
            if (key := tuple(words[i : i + n])) in table:
                out += table[key]
                i += n
                break
        else:
            out.append(words[i])
            i += 1
    return out


def settle_spellings(words: DataFrame, ratio: int = 8) -> DataFrame:
    """word, settled: rare words that are close spellings of a word at least ``ratio`` times as frequent, and that word.

    ``words``: word, n. For words no list has, such as names of teams.
    """
    counts = durable(words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.length("word") >= 4))
    if counts.limit(1).count() == 0:
        return counts.select("word", F.col("word").alias("settled"))
    pairs = close_words(counts.select("word"), counts.select(F.col("word").alias("lexeme"))).filter((F.col("word") != F.col("lexeme")) & (F.col("jaccard") >= SETTLED_JACCARD - EPSILON))
    pairs = pairs.join(counts, "word").join(counts.select(F.col("word").alias("lexeme"), F.col("n").alias("m")), "lexeme").filter(F.col("m") >= F.col("n") * ratio)
    return pairs.groupBy("word").agg(F.max_by("lexeme", F.struct("m", "jaccard", "lexeme")).alias("settled"))


def phrase_table(aliases: dict[str, str]) -> tuple[dict[tuple[str, ...], list[str]], int]:
    table = {tuple(k.split()): v.split() for k, v in aliases.items()}
    return table, max(map(len, table))


def contained_entries(values: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries whose words are all in a value.

    ``values``: vid, tokens (distinct). ``entries``: entry, tokens (distinct).
    Rows: vid, entry, jaccard. Joined through the entry's rarest word, verified exactly.
    """
    rarity = entries.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    ranked = entries.withColumn("t", F.explode("tokens")).join(rarity, "t").groupBy("entry", "tokens").agg(F.min(F.struct("df", "t")).alias("r"))
    keyed = ranked.select("entry", F.col("tokens").alias("et"), F.col("r.t").alias("t"))
    posted = values.select("vid", F.explode("tokens").alias("t"))
    pairs = posted.join(keyed, "t").drop("t").join(values.select("vid", F.col("tokens").alias("vt")), "vid").filter(F.size("et") <= F.size("vt"))
    pairs = pairs.filter(F.size(F.array_except("et", "vt")) == 0)
    return pairs.select("vid", "entry", (F.size("et") / F.size("vt")).alias("jaccard"))


def map_titles(spark: SparkSession, values: DataFrame, titles: DataFrame) -> DataFrame:
    """value, ref_id, tokens (list words), extra (other words). ``titles``: title_id, title_name."""
    table, longest = phrase_table(TITLE_ALIASES)
    noise = set(TITLE_NOISE.split())
    ref = titles.select(F.col("title_id").alias("entry"), F.array_distinct(fold_words(F.col("title_name"))).alias("tokens"))
    lexicon = ref.select(F.explode("tokens").alias("lexeme")).unionByName(
        spark.createDataFrame([(w,) for w in sorted({x for k in TITLE_ALIASES for x in k.split()} | noise)], "lexeme string")
    )

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def expand(lists: pd.Series) -> pd.Series:
        return pd.Series([[w for w in replace_phrases(list(x), table, longest) if w not in noise] for x in lists], dtype=object)

    ids, spelt = lexeme_values(spark, values, lexicon)
    spelt = durable(spelt.select("vid", "extra", F.array_distinct(expand("lexemes")).alias("tokens")))
    best = contained_entries(spelt.select("vid", "tokens"), ref).groupBy("vid").agg(F.max_by("entry", F.struct("jaccard", -F.col("entry"))).alias("ref_id"))
    none = F.expr("array()").cast("array<string>")
    out = ids.join(spelt, "vid", "left").join(best, "vid", "left")
    return out.select("value", F.coalesce("ref_id", F.lit(0)).cast("int").alias("ref_id"), F.coalesce("tokens", none).alias("tokens"), F.coalesce("extra", none).alias("extra"))


def _choose(words: list[str], found: list, remote_entries: dict[str, int], phrases: dict, longest: int) -> list[int]:
    """Entries a location names; ``found``: entries whose city words are all in it."""
    spans: dict[tuple[int, int], list] = {}
    used = [False] * len(words)
    by_name: dict[tuple[str, ...], list] = {}
    for e in found:
        by_name.setdefault(tuple(e["name"]), []).append(e)
    for name in sorted(by_name, key=lambda x: (-len(x), x)):
        for i in range(len(words) - len(name) + 1):
            if tuple(words[i : i + len(name)]) == name and not any(used[i : i + len(name)]):
                spans[(i, i + len(name))] = by_name[name]
                used[i : i + len(name)] = [True] * len(name)
    if not spans:  # words of a name apart or in another order
        for name in sorted(by_name, key=lambda x: (-len(x), x)):
            if len(name) > 1 and set(name) <= set(words):
                at = [words.index(w) for w in name]
                if not any(used[i] for i in at):
                    spans[(min(at), max(at) + 1)] = by_name[name]
                    for i in at:
                        used[i] = True
    hints: list[tuple[int, str]] = []  # position, state code or country
    i = 0
    while i < len(words):
        for n in range(min(longest, len(words) - i), 0, -1):
            if (key := tuple(words[i : i + n])) in phrases:
                hints += [(i, x) for x in phrases[key]]
                i += n
                break
        else:
            i += 1

    def agreed(e, span: tuple[int, int]) -> int:  # noqa: ANN001
        """Distance to the nearest hint outside the name that agrees; large if none."""
        own = [min(abs(p - span[0]), abs(p - span[1] + 1)) for p, x in hints if (x in ("state:" + (e["region"] or "").lower(), "country:" + e["country"].lower())) and not span[0] <= p < span[1]]
        return min(own, default=99)

    names = {tuple(words[a:b]): (a, b) for a, b in spans}
    for name in (("new", "york"), ("washington",)):  # also states: the city of that state comes first
        code = "NY" if name == ("new", "york") else "WA"
        if name in names and any(e["region"] == code for s, es in spans.items() if s != names[name] for e in es):
            del spans[names[name]]
    out: list[int] = []
    for span, entries in sorted(spans.items()):
        ranked = sorted(entries, key=lambda e: (agreed(e, span), e["id"]))
        best = ranked[0]
        if agreed(best, span) == 99:
            outside = {x for p, x in hints if not any(a <= p < b for a, b in spans)}
            states = {x[6:] for x in outside if x.startswith("state:")}
            countries = {x[8:] for x in outside if x.startswith("country:")}
            if len(spans) == 1 and (states or countries):
                continue  # a place of that name elsewhere
        if best["id"] not in out:
            out.append(best["id"])
    if not spans and any(w in ("remote", "remotely", "anywhere", "wfh", "home") for w in words):
        for _, x in hints:
            if x.startswith("country:") and x[8:] in remote_entries:
                return [remote_entries[x[8:]]]
    return out


def map_locations(spark: SparkSession, values: DataFrame, places: DataFrame) -> DataFrame:
    """value, ref_ids (0 to several), tokens. ``places``: location_id, city, region, country.

    The list of remote entries (one per country) is the only part of the list that is
    read to the driver; it is bounded by the number of countries.
    """
    table, longest_alias = phrase_table(CITY_ALIASES)
    phrases: dict[tuple[str, ...], list[str]] = {}
    for code, name in STATES.items():
        for k in (code, name):
            phrases.setdefault(tuple(k.split()), []).append("state:" + code)
    phrases.setdefault(("calif",), []).append("state:ca")
    phrases.setdefault(("qc",), []).append("country:canada")
    phrases.setdefault(("on",), []).append("country:canada")
    for name, codes in COUNTRIES.items():
        for k in [name, *codes.split()]:
            phrases.setdefault(tuple(k.split()), []).append("country:" + name)
    longest = max(map(len, phrases))
    remote = {(r["country"] or "").lower(): r["location_id"] for r in bounded_rows(places.filter("city is null"), MOST_REMOTE)}
    cities = places.filter("city is not null").select(F.col("location_id").alias("id"), fold_words(F.col("city")).alias("name"), "region", F.coalesce("country", F.lit("")).alias("country"))
    fixed = {w for k, v in CITY_ALIASES.items() for w in (k + " " + v).split()} | {w for k in phrases for w in k} | set(PLACE_NOISE.split())
    lexicon = cities.select(F.explode("name").alias("lexeme")).unionByName(spark.createDataFrame([(w,) for w in sorted(fixed)], "lexeme string"))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def expand(lists: pd.Series) -> pd.Series:
        return pd.Series([_expand(list(x), table, longest_alias) for x in lists], dtype=object)

    codes = {w for k in phrases for w in k if len(k) == 1 and len(w) <= 3}
    ids, spelt = lexeme_values(spark, values, lexicon, codes)
    spelt = durable(spelt.select("vid", expand("lexemes").alias("words")).withColumn("tokens", F.array_distinct("words")))
    entries = cities.select(F.struct("id", "name", "region", "country").alias("entry"), F.array_distinct("name").alias("tokens"))
    hits = contained_entries(spelt.select("vid", "tokens"), entries).groupBy("vid").agg(F.collect_list("entry").alias("found"))

    @F.pandas_udf(_MATCH)
    def choose(words: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([_choose(list(w), list(f) if f is not None else [], remote, phrases, longest) for w, f in zip(words, found, strict=True)], dtype=object)

    chosen = spelt.join(hits, "vid", "left").select("vid", choose("words", "found").alias("ref_ids"), "tokens")
    out = ids.join(chosen, "vid", "left")
    return out.select("value", F.coalesce("ref_ids", F.expr("array()").cast("array<int>")).alias("ref_ids"), F.coalesce("tokens", F.expr("array()").cast("array<string>")).alias("tokens"))


#: Words beside a short name of a city.
_BESIDE = set(PLACE_NOISE.split()) | {"ca", "calif", "california", "us", "usa", "united", "states"}


def _expand(words: list[str], table: dict, longest: int) -> list[str]:
    """City aliases replaced; ``la`` and ``dc`` only where nothing else names a city."""
    rest = set(words) - _BESIDE
    if rest == {"dc"}:
        return replace_phrases(words, table | {("dc",): ["washington", "dc"]}, longest)
    if rest != {"la"}:
        table = {k: v for k, v in table.items() if k != ("la",)}
    return replace_phrases(words, table, longest)

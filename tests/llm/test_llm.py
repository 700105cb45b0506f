"""Training-data operators: brute force, round trips, held-out accuracy, and the edge cases each must define."""

import collections
import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadloom.llm import common, formatting, history, language, mapping, names, packing, queries, tokens
from leadloom.llm.survivors import STEP, Field, survivors

LONG = "word " * 40000


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- shared joins -----------------------------------------------------------------


def test_close_words_against_brute_force(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 11))) for _ in range(160)} | {"q" * n + "abcdefgh" * 6 + e for n in (0, 1, 2, 3) for e in ("", "x", "ba", "xyz")} | {"ab" * 700 + "x", "ab" * 700 + "xy", "ab" * 700})
    left, right = words[::2], words[1::2]
    got = {(r["word"], r["lexeme"]) for r in common.close_words(spark.createDataFrame([(w,) for w in left], "word string"), spark.createDataFrame([(w,) for w in right], "lexeme string")).collect()}

    def distance(a, b):
        if abs(len(a) - len(b)) > 2 or (min(len(a), len(b)) > 100 and a[:100] != b[:100]):
            return 9
        if min(len(a), len(b)) > 100:
            return 0 if a == b else 1 if abs(len(a) - len(b)) == 1 else 2
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    def close(a, b):
        d = distance(a, b)
        return d <= 1 or (d == 2 and (sorted(a) == sorted(b) or min(len(a), len(b)) >= 8))

    assert got == {(a, b) for a, b in itertools.product(left, right) if close(a, b)} and got


def test_encode_join_with_a_hot_key(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"))
    d = df.filter("k is not null").groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.upper("k"))
    out = common.encode_join(df, "k", d, "n", 5000)
    assert out.count() == 5000 and out.filter("not (v <=> upper(k))").count() == 0
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()


# --- survivors --------------------------------------------------------------------


def test_survivors(spark):
    df = spark.createDataFrame([("u", 1, "new", 1.0, "2025-01-01", "r"), ("u", 2, "old", 0.5, "2025-01-01", "r"), ("u", 3, "old", 0.6, "2025-01-01", None), ("v", 4, "x", 1.0, None, None), (None, 5, "x", 1.0, None, None), ("w", 6, None, None, None, None), ("w", 7, None, 1.0, None, None)],
                               "g string, id long, s string, trust double, at string, value string").withColumn("at", F.to_timestamp_ntz("at"))
    fields = [Field("s", F.col("s")), Field("value", F.col("value"))]
    got = {r["g"]: r for r in survivors(df, "g", "id", fields, F.col("trust"), F.col("at")).collect()}
    assert set(got) == {"u", "w"} and got["u"]["s"] == "old" and got["u"]["s_id"] == 2 and got["u"]["value_id"] == 1 and got["w"]["s"] is None and got["w"]["s_id"] is None
    old = df.withColumn("at", F.when(F.col("s") == "old", F.to_timestamp_ntz(F.lit("2022-06-01"))).otherwise(F.col("at")))
    assert survivors(old, "g", "id", fields[:1], F.col("trust"), F.col("at")).filter("g = 'u'").first()["s"] == "new"
    prior = [Field("s", F.col("s"), F.when(F.col("s") == "old", STEP).otherwise(0))]
    assert survivors(old, "g", "id", prior, F.col("trust"), F.col("at")).filter("g = 'u'").first()["s"] == "old"
    assert survivors(df.limit(0), "g", "id", fields).count() == 0


def test_priors_outweigh_any_votes(spark):
    """One vote a century old for the better value against 100,000 new ones."""
    df = spark.range(100_000).selectExpr("'g' g", "id + 1 as id", "'many' s", "timestamp_ntz'2090-01-01 00:00:00' at").unionByName(spark.sql("select 'g' g, 0L id, 'one' s, timestamp_ntz'1930-01-01 00:00:00' at"))
    better = [Field("s", F.col("s"), F.when(F.col("s") == "one", STEP).otherwise(0))]
    assert survivors(df, "g", "id", better, F.lit(1.0), F.col("at")).first()["s"] == "one"
    assert survivors(df, "g", "id", [Field("s", F.col("s"))], F.lit(1.0), F.col("at")).first()["s"] == "many"


def test_p1_survivors_against_plain_python(spark, sf):
    """Winners by votes alone, summed in plain Python from the rows."""
    import math

    opened = queries._openings(spark, sf).collect()
    epoch = __import__("datetime").datetime(2025, 1, 1)
    groups = collections.defaultdict(list)
    for r in opened:
        groups[r["canonical_apply_url"]].append(r)
    got = {r["canonical_apply_url"]: r for r in queries.p1_survivors(spark, sf).collect()}
    assert got.keys() == {k for k, v in groups.items() if len(v) > 1}
    for k in got:
        votes = collections.defaultdict(float)
        for r in groups[k]:
            votes[r["status"].strip().lower()] += r["trust"] * 2.0 ** (math.floor((r["moment"] - epoch).total_seconds()) / 86400 / 90)
        assert votes[got[k]["status"]] >= max(votes.values()) * (1 - 1e-5)


def test_p1_against_plain_python(spark, sf):
    got = {r["canonical_apply_url"]: r for r in queries.p1_found(spark, sf).collect()}
    opened = queries._openings(spark, sf).collect()
    groups = collections.defaultdict(list)
    for r in opened:
        groups[r["canonical_apply_url"]].append(r)
    groups = {k: v for k, v in groups.items() if len(v) > 1}
    assert got.keys() == groups.keys()
    for k, v in groups.items():
        def place(r):
            return len(queries.STATUS_ORDER) - queries.STATUS_ORDER.index(r["status"].strip().lower())

        paid = [r for r in v if r["pay"]]
        assert got[k]["status_job_id"] == max(v, key=lambda r: (place(r), r["moment"], -r["id"]))["id"]
        assert got[k]["found_job_id"] == max(v, key=lambda r: (r["moment"], -r["id"]))["id"]
        assert got[k]["salary_job_id"] == (max(paid, key=lambda r: (r["moment"], -r["id"]))["id"] if paid else 0)


# --- formatting -------------------------------------------------------------------

FIELDS = "id long, company string, title string, location string, apply_url string, value string"


def test_formatting_classes(spark):
    r = [
        (1, "Acme Foods", "Data Engineer", "Ulm, DE", "https://h/x?a=1&b=2", "e"), (2, "ACME  foods!", "data-engineer", "DE / Ulm", "HTTPS://h/x/?b=2&a=1", "e"),
        (3, "Foods, Acme", "Ｄａｔａ Engineer", "Ulm, DE", " https://h/x?a=1&b=2\n", "e"), (4, "AcmeFoods", "Data Engineer", "ulm de", "https://h/x?a=1&b=2", None),
        (5, "Acme Foods", "Data Engineer", "Ulm, DE", "https://h/x?a=1&b=3", None), (6, "Acme Foods", "Data Engineer", None, "https://h/y", None), (7, "acme foods", "Data Engineer", None, "https://H/y", None),
        (8, "Acme Foods", "Data Engineer", "", "https://h/y", None), (9, "Acme Foods", "Data Engineer", None, None, None), (10, "Acme Foods", "Data Engineer", None, None, None), (11, LONG, "t", "l", "u", None), (12, LONG.upper(), "t", "l", "u", None),
    ]
    df = spark.createDataFrame(r, FIELDS)
    groups, members = formatting.collapse(df, "id", ["company", "title", "location"], "apply_url")
    assert rows(members) == [(1, 2), (1, 3), (1, 4), (11, 12), (6, 7)]
    assert dict(rows(groups)) == {1: 4, 5: 1, 6: 2, 8: 1, 11: 2}
    groups, members = formatting.collapse(df.limit(0), "id", ["company", "title", "location"], "apply_url")
    assert groups.count() == members.count() == 0


def test_formatting_links_need_rows_not_columns(spark):
    """An unrelated row never joins two others; a chain of rows does."""
    r = [(1, "c", "ab c", "l", "u"), (2, "c", "bc a", "l", "u"), (3, "c", "a bc", "l", "other"), (4, "c", "San Francisco, CA", "l", "w"), (5, "c", "CA / SanFrancisco", "l", "w"),
         (8, "c", "ab c", "l", "v"), (9, "c", "a bc", "l", "v"), (10, "c", "bc a", "l", "v"), (11, "c", "t", "l", "x/apply"), (12, "c", "t", "l", "x#apply")]
    groups, members = formatting.collapse(spark.createDataFrame(r, FIELDS.removesuffix(", value string")), "id", ["company", "title", "location"], "apply_url")
    assert rows(members) == [(11, 12), (4, 5), (8, 10), (8, 9)]
    assert dict(rows(groups)) == {1: 1, 2: 1, 3: 1, 4: 2, 8: 3, 11: 2}


def test_formatting_against_union_find_over_row_pairs(spark):
    rng = random.Random(4)

    def value():
        words = rng.sample(["ab", "c", "a", "bc"], rng.randint(1, 3))
        return rng.choice([" ", "", ", ", "-"]).join(w.upper() if rng.random() < 0.3 else w for w in words)

    r = [(i, value(), value(), value(), rng.choice(["u", "v", None])) for i in range(300)]
    parent = {x[0]: x[0] for x in r}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = {x[0]: [set(formatting.text_keys(v)) | {formatting.text_keys(v)[1] + "|b"} for v in x[1:4]] for x in r}
    for x, y in itertools.combinations([x for x in r if x[4]], 2):
        if x[4] == y[4] and all(p & q for p, q in zip(keys[x[0]], keys[y[0]], strict=True)):
            parent[max(root(x[0]), root(y[0]))] = min(root(x[0]), root(y[0]))
    _, members = formatting.collapse(spark.createDataFrame(r, FIELDS.removesuffix(", value string")), "id", ["company", "title", "location"], "apply_url")
    assert rows(members) == sorted(((root(i), i) for i in parent if root(i) != i), key=str)


def test_components_against_union_find(spark):
    rng = random.Random(5)
    links = {(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)} | {(i, i + 1) for i in range(1000, 1100)} | {(2000, i) for i in range(2001, 2100)}
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = dict(rows(common.components(spark.createDataFrame(sorted(links), "a long, b long"))))
    assert got == {x: root(x) for e in links for x in e if e[0] != e[1]}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_p7_members_share_canonical_text(spark, sf):
    jobs = {r["id"]: r for r in spark.read.parquet(f"{sf}/jobs.parquet").collect()}

    def key(j):
        return [formatting.url_key(j["apply_url"]), *("".join(sorted(formatting.text_keys(j[c])[0])) if j[c] is not None else None for c in ("company", "title", "location"))]

    found = rows(queries.p7_found(spark, sf))
    assert found and all(a < b and key(jobs[a]) == key(jobs[b]) for a, b in found)


# --- tokens -----------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("aZ09 .,'\n\té<|> ", max_size=80)))
def test_pieces_are_the_librarys_encoding(text):
    p = tokens.Pieces(tokens.vocabulary())
    whole = p.tokenizer.encode(text, add_special_tokens=False).ids if text else []
    assert [i for x in p.of(text) for i in x] == whole
    assert b"".join(tokens._token_bytes(tokens.vocabulary())[i] for i in whole).decode("utf-8", "replace") == text


def test_token_columns(spark):
    texts = [None, "", "Ünï 👩‍💻 x", "<|endoftext|>", LONG]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    path = tokens.vocabulary()
    out = {r["doc_id"]: r for r in df.select("doc_id", tokens.encode(F.col("text"), path).alias("ids"), tokens.count_tokens(F.col("text"), path).alias("n"), tokens.encode_with_offsets(F.col("text"), path).alias("o")).collect()}
    assert out[0]["ids"] == out[1]["ids"] == [] and out[3]["ids"] != [50256]
    for i in range(5):
        assert len(out[i]["ids"]) == out[i]["n"] == len(out[i]["o"]) and [x["id"] for x in out[i]["o"]] == out[i]["ids"]
    assert all(0 <= x["start"] <= x["stop"] <= len(texts[2]) for x in out[2]["o"])
    back = df.select("text", tokens.decode(tokens.encode(F.col("text"), path), path).alias("t")).collect()
    assert [r["t"] for r in back] == ["" if t is None else t for t in texts]
    half = spark.createDataFrame([(out[2]["ids"][:4],)], "ids array<int>").select(tokens.decode(F.col("ids"), path).alias("t")).first()["t"]
    assert half.startswith("Ün")


# --- packing ----------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(50, 90))
def test_bins_hold_every_item_once(sizes, capacity):
    bins = packing.best_two_fit(dict(collections.Counter(sizes)), capacity)
    assert collections.Counter(s for b in bins for s in b) == collections.Counter(sizes) and all(sum(b) <= capacity for b in bins)
    assert len(bins) <= max(1, 2 * -(-sum(sizes) // capacity))


def test_pack(spark):
    items = spark.createDataFrame([(1, 5), (2, 10), (3, 27), (4, 0), (5, None), (6, -3), (7, 5)], "id long, size int")
    got = packing.pack(items, {1: 10, 2: 0, 3: None}, 7).collect()
    assert collections.Counter((r["id"], r["piece"], r["size"]) for r in got) == collections.Counter([(1, 0, 5), (2, 0, 10), (3, 0, 10), (3, 1, 10), (3, 2, 7), (7, 0, 5)])
    assert len({r["bin"] for r in got}) == 5 and packing.pack(items.limit(0), {1: 10}, 0).count() == 0 and packing.pack(items, {}, 7).count() == 0


def test_p9_fills_containers(spark, sf):
    got = queries.p9_containers(spark, sf).toPandas()
    per = got.groupby(["container_id", "capacity_tokens", "container"]).n_tokens.sum().reset_index()
    assert (per.n_tokens <= per.capacity_tokens).all() and not got.duplicated(["container_id", "doc_id", "piece_no"]).any()
    assert got.groupby("container_id").n_tokens.sum().nunique() == 1
    unused = {r["container_id"]: r for r in queries.p9_unused(spark, sf).collect()}
    for k, g in per.groupby("container_id"):
        assert len(g) == unused[k]["containers"] and abs(1 - g.n_tokens.sum() / g.capacity_tokens.sum() - unused[k]["unused"]) < 1e-5


def test_containers_are_full(spark):
    """The bound is what the README states: 99 % of the space is used, for items of up to the smallest container, but for one open bin."""
    rng = random.Random(9)
    items = spark.createDataFrame([(i, rng.randint(1, 700)) for i in range(4000)], "id long, size int")
    for capacity in (512, 2048):
        bins = packing.pack(items, {1: capacity}, 4000).groupBy("bin").agg(F.sum("size").alias("n")).toPandas().n
        assert bins.sum() >= 0.99 * capacity * (len(bins) - 1)
    assert packing.best_two_fit({7: 1, 5: 1, 4: 1}, 9) == [[5, 4], [7]]


def test_texts_are_cut_only_for_the_tokenizer_it_is_proven_for(tmp_path):
    import json

    assert tokens.cuts_at_spaces(tokens.vocabulary())
    t = json.loads(open(tokens.vocabulary(), encoding="utf-8").read())
    t["pre_tokenizer"] = {"type": "Whitespace"}
    (tmp_path / "t.json").write_text(json.dumps(t))
    assert not tokens.cuts_at_spaces(str(tmp_path / "t.json"))
    assert len(tokens.Pieces(str(tmp_path / "t.json")).of("We work. You work")) == 1


# --- mapping ----------------------------------------------------------------------

PLACES = [(101, "Austin, TX", "Austin", "TX", "United States"), (109, "Portland, OR", "Portland", "OR", "United States"), (110, "Portland, ME", "Portland", "ME", "United States"), (117, "New York, NY", "New York", "NY", "United States"),
          (118, "Buffalo, NY", "Buffalo", "NY", "United States"), (161, "Washington, DC", "Washington", "DC", "United States"), (113, "Los Angeles, CA", "Los Angeles", "CA", "United States"), (107, "Seattle, WA", "Seattle", "WA", "United States"),
          (178, "Cologne, Germany", "Cologne", None, "Germany"), (210, "Remote, United States", None, None, "United States")]
LOCATIONS = {
    "austin, texas": [101], "Ausitn TX (Hybrid)": [101], "ME - Portland": [110], "Portland, OR or Austin, TX": [101, 109], "Buffalo, New York": [118], "New York City": [117], "Seattle, Washington": [107], "DC metro area": [161],
    "L.A., Calif.": [113], "Köln": [178], "Remote (US)": [210], "Fully remote": [], "Nairobi, Kenya": [], "Austin, MN": [], "TBD": [], LONG + "Austin": [101],
}


def test_locations(spark):
    places = spark.createDataFrame(PLACES, "location_id int, location_name string, city string, region string, country string")
    got = {r["value"]: sorted(r["ref_ids"]) for r in mapping.map_locations(spark, spark.createDataFrame([(v,) for v in LOCATIONS], "value string"), places).collect()}
    assert {k[-30:]: got[k] for k in LOCATIONS} == {k[-30:]: v for k, v in LOCATIONS.items()}


def test_a_long_list_of_remote_entries_raises(spark):
    places = spark.range(301).selectExpr("cast(id as int) location_id", "concat('Remote, ', id) location_name", "cast(null as string) city", "cast(null as string) region", "cast(id as string) country")
    with pytest.raises(ValueError, match="more than 300"):
        mapping.map_locations(spark, spark.createDataFrame([("Remote",)], "value string"), places)


def test_titles(spark):
    titles = spark.createDataFrame([(1, "Data Engineer"), (2, "Senior Data Engineer"), (3, "Business Intelligence Developer"), (4, "Junior Backend Engineer")], "title_id int, title_name string")
    want = {"Sr. Engineer, Data | Nobenupa Team": 2, "dtaa engnieer": 1, "BI Dev - Remote": 3, "Jr Back-end Eng (m/w/d)": 4, "Payroll Clerk": 0, "Senior Receptionist": 0}
    got = {r["value"]: r["ref_id"] for r in mapping.map_titles(spark, spark.createDataFrame([(v,) for v in want], "value string"), titles).collect()}
    assert got == want
    assert mapping.map_titles(spark, spark.createDataFrame([("Data Engineer",)], "value string"), titles.limit(0)).first()["ref_id"] == 0


def test_p5_covers_every_other_value(spark, sf):
    jobs = spark.read.parquet(f"{sf}/jobs.parquet")
    names_ = {r[0] for r in spark.read.parquet(f"{sf}/ref_titles.parquet").select("title_name").collect()}
    want = {r["id"] for r in jobs.select("id", "title").collect() if r["title"].strip() and r["title"] not in names_}
    got = [r["job_id"] for r in queries.p5_found(spark, sf).filter("field_name = 'title'").collect()]
    assert set(got) == want and len(got) == len(want)


# --- names ------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("name", "words"),
    [("The Acme Foods, L.L.C. (hiring)", ("acme", "foods")), ("acmefoods.example", ("acmefoods",)), ("Acme & Sons Gesellschaft mbH", ("acme", "sons")), ("A.F.", ("af",)), ("Co", ("co",)), ("", ()), ("Ａｃｍｅ B.V.", ("acme",))],
)
def test_core_words(name, words):
    assert names.core_words(name) == words


def test_channel_prefers_the_nearer_form():
    true, other = ("korangant", "media"), ("korangast", "media")
    for seen in (("korangnat", "media"), ("media", "korangant"), ("koranant",), ("korangantmedia",)):
        assert names.channel_cost(seen, true) < names.channel_cost(seen, other)
    assert names._edits("abcd", "abdc", 2) == 1 and names._edits("abc", "xyz", 1) == 2


def test_attribution(spark):
    seen = [("Korangant Media", "korangantmedia", 30), ("Korangast Mobility", "korangastmobility", 20), ("Koragnant Media", None, 1), ("KORANGANT", None, 2), ("Mobility, Korangast Inc", None, 1), ("K.M.", "korangantmedia", 1), (None, "korangantmedia", 1),
            ("Alone & Far", None, 3), ("  ", None, 4), (None, None, 5), (LONG, None, 1)]
    got = {(r["name"], r["tenant"]): r["org"] for r in names.attribute(spark.createDataFrame(seen, "name string, tenant string, n long")).collect()}
    for k in (("Koragnant Media", None), ("KORANGANT", None), ("K.M.", "korangantmedia"), (None, "korangantmedia")):
        assert got[k] == "korangantmedia"
    assert got[("Mobility, Korangast Inc", None)] == "korangastmobility" and got[("Alone & Far", None)] == "alonefar"
    assert (None, None) not in got and ("  ", None) not in got and (LONG, None) in got
    assert names.attribute(spark.createDataFrame([], "name string, tenant string, n long")).count() == 0


def test_spellings_beyond_the_candidate_joins(spark):
    seen = [("Dorenbrick Security", "dorenbricksecurity", 30), ("Junolwick International", "junolwickinternational", 30), ("DROENBICK  SEC.", None, 1), ("Jnuoleick Intl", None, 1), ("Alone & Far", None, 3)]
    got = {(r["name"], r["tenant"]): r["org"] for r in names.attribute(spark.createDataFrame(seen, "name string, tenant string, n long")).collect()}
    assert got[("DROENBICK  SEC.", None)] == "dorenbricksecurity" and got[("Jnuoleick Intl", None)] == "junolwickinternational" and got[("Alone & Far", None)] == "alonefar"


def test_a_tenant_is_one_observation_among_others(spark):
    seen = [("Korangast Mobility", "korangastmobility", 20), ("Korangast Mobility", "jobs", 1), ("K.M.", "korangastmobility", 1), (None, "jobs", 1), ("Korangast Mobilty", None, 1)]
    got = {(r["name"], r["tenant"]): (r["org"], r["posterior"]) for r in names.attribute(spark.createDataFrame(seen, "name string, tenant string, n long")).collect()}
    assert got[("Korangast Mobility", "jobs")][0] == "korangastmobility" and 0.9 < got[("Korangast Mobility", "jobs")][1] < 1
    assert {k: v[0] for k, v in got.items() if k[0] != "Korangast Mobility"} == {("K.M.", "korangastmobility"): "korangastmobility", (None, "jobs"): "jobs", ("Korangast Mobilty", None): "korangastmobility"}


def test_candidates_of_the_channel_against_brute_force(spark):
    """Every pair of words or of whole names the channel relates comes out of the joins."""
    rng = random.Random(8)
    stems = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 16))) for _ in range(40)] + ["manufacturing", "international", "z" * 45 + "abcdefgh" * 3]

    def typo(w):
        w = list(w)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w) + 1)
            w[i : i + 2] = rng.choice([w[i : i + 2][::-1], w[i + 1 : i + 2], ["e", *w[i : i + 2]], ["d", *w[i + 1 : i + 2]]])
        return "".join(w)[: rng.choice([99, 99, 4, 44])] or "a"

    seen = sorted({typo(rng.choice(stems)) for _ in range(250)} | {"mfg", "mgf", "intl"})
    got = {tuple(r) for r in names.word_links(spark.createDataFrame([(w,) for w in seen], "word string"), spark.createDataFrame([(w,) for w in stems], "lexeme string")).collect()}
    assert got == {(a, b) for a, b in itertools.product(seen, stems) if names._word_cost(a, b) < float("inf")}
    for a, b in itertools.product(seen, stems):
        if names._whole_edits(a, b) is not None:
            assert names.whole_signatures(a, False) & names.whole_signatures(b, True), (a, b)


def test_no_length_of_a_name_is_left_out(spark):
    """A cut after 18 letters, the initials of seven words, a long compound with a typo, a common word as the first."""
    known = ["Quantum Biotherapeutics", "Alpha Beta Gamma Delta Epsilon Zeta Eta", "Global Korangant Nurseries", *[f"Global {w}" for w in ("Foods", "Media", "Energy", "Robotics", "Freight", "Studios")]]
    seen = [(n, "".join(n.lower().split()), 30) for n in known] + [("Quantumbiotherapeu", None, 1), ("ABGDEZE", None, 1), ("quantumbiotehrapeutics", None, 1), ("Global Nurseries", None, 1), ("Glboal Mdeia", None, 1)]
    got = {(r["name"], r["tenant"]): r["org"] for r in names.attribute(spark.createDataFrame(seen, "name string, tenant string, n long")).collect()}
    assert {k: got[(k, None)] for k, _, _ in seen[len(known) :]} == {
        "Quantumbiotherapeu": "quantumbiotherapeutics", "ABGDEZE": "alphabetagammadeltaepsilonzetaeta", "quantumbiotehrapeutics": "quantumbiotherapeutics", "Global Nurseries": "globalkorangantnurseries", "Glboal Mdeia": "globalmedia",
    }


def test_frequent_spellings_without_a_tenant_are_forms(spark):
    seen = [("Dorenbrick Security", None, 40), ("Dorenbrcik Security", None, 2), ("Dorenbrick Sec.", None, 1), ("Alone & Far", None, 3)]
    got = {r["name"]: r["org"] for r in names.attribute(spark.createDataFrame(seen, "name string, tenant string, n long")).collect()}
    assert got == {"Dorenbrick Security": "dorenbricksecurity", "Dorenbrcik Security": "dorenbricksecurity", "Dorenbrick Sec.": "dorenbricksecurity", "Alone & Far": "alonefar"}


@pytest.mark.parametrize(
    ("job", "url", "req", "tenant"),
    [("REQ_010003579", None, "10003579", None), ("#10010103", None, "10010103", None), (None, "https://www.careers.acme.example/openings/10009701?lang=fr", "10009701", "acme"), (None, "https://boards.h.example/acme-2?gh_jid=10015223&gh_src=460678", "10015223", "acme"),
     ("ID 190DD051_005e_46ca_a67c_00000098c8a1", "https://acme.wd5.w.example/en-US/C/job/X/y_JR01", "190dd051005e46caa67c00000098c8a1", "acme"), (None, None, None, None), ("", "  ", None, None), ("n/a", "https://h.example//acme/jobs/123456/", "123456", "acme")],
)
def test_requisition_and_tenant(spark, job, url, req, tenant):
    r = spark.createDataFrame([(job, url)], "j string, u string").select(names.requisition(F.col("j"), F.col("u")).alias("r"), names.tenant(F.col("u")).alias("t")).first()
    assert (r["r"], r["t"]) == (req, tenant)


def test_p4_pairs_name_one_tenant(spark, sf):
    jobs = {r["id"]: r["t"] for r in spark.read.parquet(f"{sf}/jobs.parquet").select("id", names.tenant(F.col("apply_url")).alias("t")).collect()}
    reg = {r["id"]: r["t"] for r in spark.read.parquet(f"{sf}/source_registry.parquet").select("id", names.tenant(F.col("normalized_url")).alias("t")).collect()}
    found = rows(queries.p4_found(spark, sf))
    assert found and all(jobs[a] is None or jobs[a] == reg[b] for a, b in found)


# --- history ----------------------------------------------------------------------


def test_index_by_batches_equals_brute_force(spark, tmp_path):
    rng = random.Random(1)
    sets = [(f"s{i}", sorted(rng.sample("abcdefghij", rng.randint(1, 5)))) for i in range(60)]
    index = history.PostingIndex(spark, str(tmp_path / "i"), threshold=0.6)
    df = spark.createDataFrame(sets, "key string, tokens array<string>")
    index.create(df.limit(20).select(F.explode("tokens").alias("token"), F.lit(1).alias("n")))
    got, known = set(), []
    for k in range(0, 60, 20):
        batch = sets[k : k + 20]
        hits = history.check_batch(index, spark.createDataFrame(batch, df.schema)).collect()
        got |= {(r["probe"], r["key"]) for r in hits}
        want = {(a, b) for a, x in batch for b, y in known if len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.6}
        assert {(r["probe"], r["key"]) for r in hits} == want
        known += batch
    assert got


def test_a_probe_reads_its_own_buckets_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "TOKENS_PER_BUCKET", 60)
    index = history.PostingIndex(spark, str(tmp_path / "i"), threshold=0.8)
    sets = spark.range(2000).selectExpr("cast(id as string) key", "array(concat('a', id), concat('b', id), concat('c', id)) tokens")
    index.create(sets.select(F.explode("tokens").alias("token"), F.lit(1).alias("n")))
    index.append(sets)
    assert index.buckets == 100
    hits = index.probe(sets.filter("key in ('7', '1999')"))
    assert rows(hits) == [("1999", "1999", 1.0), ("7", "7", 1.0)]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert any("bucket" in x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:])


@pytest.mark.parametrize("steps", [1, 5])
def test_openings_do_not_depend_on_the_steps(spark, tmp_path, steps):
    rng = random.Random(6)
    titles = {10: ["t:data", "t:senior"], 11: ["t:data", "t:senniir"], 12: ["t:data", "t:senniro"], 13: ["t:data", "t:staff"]}
    codes = spark.createDataFrame([(1, ["o:a"]), (2, ["o:b"]), (3, ["l:1"]), *titles.items(), *[(c, ["t:senior", f"t:x{c}"]) for c in range(20, 50)]], "code long, tokens array<string>")
    r = [(i, f"b{rng.randint(0, 6)}", rng.choice([None, None, f"r{rng.randint(0, 30)}"]), rng.choice([1, 2]), rng.choice([10, 11, 12, 13, *range(20, 50)]), rng.choice([3, None])) for i in range(300)]
    df = spark.createDataFrame(r, "id long, batch string, req string, o long, t long, l long")
    got = dict(rows(history.openings(df, codes, history.PostingIndex(spark, str(tmp_path / "i"), history.LEAST_OVERLAP), steps).select("id", "opening")))
    whole = dict(rows(history.openings(df, codes, history.PostingIndex(spark, str(tmp_path / "w"), history.LEAST_OVERLAP), 3).select("id", "opening")))
    assert got == whole and len(set(got.values())) < 300


def test_repeats(spark):
    codes = spark.createDataFrame([(1, ["o:a"]), (2, ["t:x", "t:y"]), (3, ["l:1"]), (4, ["o:b"])], "code long, tokens array<string>")
    r = [(1, "", "r1", 1, 2, 3), (2, "b1", "r1", 1, 2, 3), (3, "b1", None, 1, 2, 3), (4, "b0", None, 4, 2, None), (5, "b0", None, 4, 2, None), (6, "b2", None, 4, 2, None), (7, "b2", "r2", 4, 2, 3), (8, "b2", None, None, None, None), (9, "b3", None, None, None, None)]
    df = spark.createDataFrame(r, "id long, batch string, req string, o long, t long, l long")
    assert rows(history.repeats(df, codes)) == [(1, 2), (1, 3), (4, 6)]
    assert history.repeats(df.limit(0), codes).count() == 0


def test_repeats_with_misspelled_titles(spark):
    titles = {10: ["t:data", "t:senior"], 11: ["t:data", "t:senniir"], 12: ["t:data", "t:senniro"], 13: ["t:data", "t:staff"]}
    codes = spark.createDataFrame([(1, ["o:a"]), (2, ["o:b"]), (3, ["l:1"])] + [(c, w) for c, w in titles.items()] + [(c, ["t:senior", f"t:x{c}"]) for c in range(20, 50)], "code long, tokens array<string>")
    r = [(1, "b1", "r1", 1, 10, 3), (2, "b2", None, 1, 11, 3), (3, "b2", None, 1, 13, 3), (4, "b2", None, 2, 11, 3), (5, "b3", None, 2, 10, 3), (6, "b4", None, 2, 12, 3), (7, "b4", None, 1, 11, None)]
    r += [(100 + c, "b0", f"q{c}", 1, c, None) for c in range(20, 50)]
    df = spark.createDataFrame(r, "id long, batch string, req string, o long, t long, l long")
    assert rows(history.repeats(df, codes)) == [(1, 2), (4, 5), (4, 6)]


def test_p6_against_requisitions(spark, sf):
    jobs = spark.read.parquet(f"{sf}/jobs.parquet").select("id", F.coalesce("ingest_batch_id", F.lit("")).alias("b"), names.requisition(F.col("source_job_id"), F.col("apply_url")).alias("r")).collect()
    first = {}
    for j in sorted(jobs, key=lambda j: (j["b"], j["id"])):
        if j["r"]:
            first.setdefault(j["r"], (j["b"], j["id"]))
    want = {(first[j["r"]][1], j["id"]) for j in jobs if j["r"] and j["b"] > first[j["r"]][0]}
    got = set(rows(queries.p6_found(spark, sf)))
    with_req = {j["id"] for j in jobs if j["r"]}
    assert {x for x in got if x[1] in with_req} == want


# --- language ---------------------------------------------------------------------

SENTENCES = {
    "en": ["We are looking for a person who likes the work and the team.", "You will keep the numbers right and help others with them.", "The office is quiet and the hours are flexible."],
    "de": ["Wir suchen eine Person, die gerne mit dem Team arbeitet.", "Du hältst die Zahlen richtig und hilfst anderen damit.", "Das Büro ist ruhig und die Zeiten sind flexibel."],
    "fr": ["Nous cherchons une personne qui aime travailler avec cette équipe.", "Vous gardez les chiffres justes et aidez les autres.", "Le bureau est calme et les horaires sont souples."],
}


def test_sentences_and_repair():
    assert language.sentences("# Senior Data Engineer (Austin, TX)\nPython | Spark\n40h\nWe work well with all of you.") and not language.sentences("Senior Data Engineer - Remote\n12345 / 2025-03\n---")
    assert language.repair("basÃ© Ã\xa0 Austin") == "basé à Austin" and "http" not in language.repair("see https://a.example/x now")


def test_labels(spark):
    df = spark.createDataFrame([(v,) for v in ("en", "EN_gb", " English ", "Français", "deu", "es-419", "und", "xx", "", None, "pt-PT")], "l string")
    assert [r[0] for r in df.select(language.label_language(F.col("l"))).collect()] == ["en", "en", "en", "fr", "de", "es", None, None, None, None, "pt"]


def test_language_of_blocks(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(SENTENCES[c]) for _ in range(3)), c if i % 9 else "en") for i, c in enumerate(itertools.islice(itertools.cycle(SENTENCES), 150))]
    docs += [(900, SENTENCES["en"][0] + "\n\n" + SENTENCES["de"][1] + "\n\n---", "en"), (901, None, "en"), (902, "", None), (903, "Spark | Python", "de"), (904, SENTENCES["fr"][2] + " " + LONG, None)]
    df = spark.createDataFrame(docs, "id long, text string, label string").withColumn("lang", F.lit("clash"))
    got = collections.defaultdict(dict)
    for r in language.label_documents(df, language.Training(epochs=12, rate=1.0)).collect():
        got[r["id"]][r["block_no"]] = r["lang"]
    truth = {i: c for i, c in enumerate(itertools.islice(itertools.cycle(SENTENCES), 150))}
    assert sum(got[i][0] == c for i, c in truth.items()) >= 147
    assert {k: v for k, v in got[900].items() if k} == {1: "en", 2: "de", 3: "de"} and not {901, 902, 903} & set(got) and 904 in got
    assert language.label_documents(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def model():
    import pandas as pd

    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text", "lang"]).dropna()
    docs = docs[docs.lang.isin(language.LANGUAGES) & (docs.doc_id % 5 != 0)]
    sample = [(i, t, c) for i, text, c in docs.itertuples(index=False) for t, _ in language.sentences(language.repair(text))[:12]]
    return language.train([t for _, t, _ in sample], [c for _, _, c in sample], [i if i % 7 == 0 else None for i, _, _ in sample], language.Training(epochs=12))


@pytest.mark.parametrize(
    "text",
    ["Etsimme henkilöä, joka pitää työstä ja tiimistä. Toimisto on hiljainen ja ajat joustavat.", "Olyan munkatársat keresünk, aki szereti a munkát és a csapatot.", "asdkj qwlkej zxmcnb qpwoei alskdj zmxncb. wqeoi asldk zmxnc qwepo.",
     "xkcd fghj rtyu vbnm lkjh qwrt."],
)
def test_other_languages_and_noise_are_rejected(model, text):
    assert model.least >= 0.5 and language._read(text, model)[0][1] == language.UNKNOWN


def test_known_languages_are_accepted(model):
    assert {c: language._read(" ".join(v), model)[0][1] for c, v in SENTENCES.items()} == {c: c for c in SENTENCES}


def test_calibration_keeps_the_error_of_untouched_documents():
    import numpy as np

    rng = np.random.default_rng(0)
    truth, sure = rng.integers(0, 8, 4000), rng.random(4000)
    z = np.where(np.arange(9) == np.where(rng.random(4000) < 0.5 + sure / 2, truth, (truth + 1) % 8)[:, None], 6 * sure[:, None], 0.0)
    temperature, least = language.calibrate(z, truth, np.arange(4000) // 20, 0.05)
    e = np.exp(z / temperature)
    taken = (e / e.sum(axis=1, keepdims=True))[:, :8].max(axis=1) >= least
    of_label = np.repeat((z[:, :8].argmax(axis=1) == truth).reshape(-1, 20).mean(axis=1) >= 0.75, 20)
    assert 0.05 < taken.mean() < 0.95 and 1 - (z[:, :8].argmax(axis=1) == truth)[taken & of_label].mean() <= 0.07


def test_p10_labels_that_were_held_out(spark):
    """Every fifth document has no label while the model is trained; most two-letter labels are right, and accepted answers should give them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"))
    hidden = F.col("id") % 5 == 0
    found = language.label_documents(docs.withColumn("label", F.when(~hidden, F.col("label")))).filter(hidden & (F.col("block_no") == 0) & ~F.col("mixed"))
    got = found.join(docs.select("id", F.col("label").alias("truth")), "id").filter(F.col("truth").isin(*language.LANGUAGES)).select(F.count("*"), F.avg((F.col("lang") == language.UNKNOWN).cast("int")), F.avg((F.col("lang") == F.col("truth")).cast("int"))).first()
    assert got[0] > 80 and got[1] < 0.05 and got[2] > 0.85

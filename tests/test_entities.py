import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.functions import kernels
from concord.functions.keys import keys
from concord.functions.metaphone import codes
from concord.operators import labels, resolve, similarity
from concord.operators.graph import connected_components
from concord.operators.predicates import Index, Simple, from_config
from concord.operators.similarity import canopies, documents, levenshtein_neighbours
from concord.plans import rules
from concord.plans import variables as V
from concord.plans.matching import Deduplicator, Gazetteer, NotTrained, RecordLink
from concord.plans.model import DataModel, Logistic, fit_logistic
from concord.sources import models
from concord.storage import keeper

PEOPLE = [(0, "Bob", "51"), (1, "Linda", "50"), (2, "Gene", "12"), (3, "Tina", "15"), (4, "Bob B.", "51"), (5, "bob belcher", "51"), (6, "linda ", "50"), (7, "Gene Belcher", "12")]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "id bigint, name string, age string")


def found(spark, name, value, as_string=True, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return sorted(df.select(keys(name, F.col("x"), df.schema["x"].dataType, as_string).alias("k")).first()["k"])


@pytest.mark.parametrize(
    ("name", "value", "expected"),
    [
        ("tokenFieldPredicate", "do\nal d", ["al", "d", "do"]),
        ("firstTwoTokensPredicate", "foo bar baz", ["foo bar"]),
        ("commonIntegerPredicate", "00 7 007", ["0", "7"]),
        ("nearIntegersPredicate", "10", ["10", "11", "9"]),
        ("hundredIntegersOddPredicate", "1230 111", ["101", "1200"]),
        ("sameThreeCharStartPredicate", "a b cde", ["abc"]),
        ("sameThreeCharStartPredicate", "...", [""]),
        ("twoGramFingerprint", "a", []),
        ("oneGramFingerprint", "banana split", ["abilnpst"]),
        ("suffixArray", "abcdefg", ["abcdefg", "bcdefg", "cdefg"]),
        ("commonFourGram", "héllo", ["héll", "éllo"]),
        ("wholeFieldPredicate", "", []),
        ("firstIntegerPredicate", "007 x", ["007"]),
    ],
)
def test_string_keys(spark, name, value, expected):
    assert found(spark, name, value) == sorted(expected)


def test_other_keys(spark):
    assert found(spark, "roundTo1", -22315.0, False, "double") == ["-20000"]
    assert found(spark, "orderOfMagnitude", 0.0, False, "double") == []
    assert found(spark, "wholeFieldPredicate", 1.0e7, False, "double") == ["10000000.0"]
    assert found(spark, "wholeFieldPredicate", 0.0001, False, "double") == ["0.0001"]
    assert found(spark, "latLongGridPredicate", [42.535, -5.012], False, "array<double>") == ["(42.5, -5.0)"]
    assert found(spark, "latLongGridPredicate", [0.0, 0.0], False, "array<double>") == []
    assert found(spark, "commonTwoElementsPredicate", ["b", "a", "c"], False, "array<string>") == ["a b", "b c"]


def test_metaphone():
    assert codes("Smith") == ("SM0", "XMT")
    assert codes("Schmidt") == ("XMT", "SMT")
    assert codes("Thompson") == ("TMPSN", "TMPSN")
    assert codes("") == ("", "")


def scalar_affine(a, b):
    if a == b:
        return 0.5 if a else math.nan
    if (len(a), a) < (len(b), b):
        a, b = b, a
    f = np.float32
    above = [f(0)] + [f(10 + 7 * j) for j in range(1, len(a) + 1)]
    down = [f(2**31)] * (len(a) + 1)
    for i, y in enumerate(b, 1):
        row, right = [f(10 + 7 * i)], f(2**31)
        for j, x in enumerate(a, 1):
            k = f(1) if j <= len(b) else f(0.125)
            right = min(right, row[j - 1] + f(10) * k) + f(7) * k
            down[j] = min(down[j], above[j] + f(10)) + f(7)
            row.append(min(right, down[j], above[j - 1] + (f(1) if x == y else f(11))))
        above = row
    return float(above[-1] / f(len(a) + len(b)))


def test_affine_gap_equals_the_scalar_recurrence():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(9))) for _ in range(60)]
    pairs = [(rng.choice(words), rng.choice(words)) for _ in range(300)] + [(None, "a"), ("", "")]
    got = kernels.affine_gap([p[0] for p in pairs], [p[1] for p in pairs])
    for (a, b), d in zip(pairs, got, strict=True):
        want = math.nan if a is None or b is None else scalar_affine(a, b)
        assert (math.isnan(d) and math.isnan(want)) or d == pytest.approx(want, abs=1e-6), (a, b)


def test_crf_is_a_probability_and_nan_for_empty():
    d = kernels.crf_distance(["abc", "", "abc"], ["abd", "x", "abc"])
    assert 0 < d[0] < 1 and math.isnan(d[1]) and d[2] != d[0]


def test_linkage_cuts_and_confidences():
    pairs = [(0, 1, 0.9), (0, 2, 0.9), (1, 2, 0.9), (2, 3, 0.2)]
    clusters = kernels.cluster_component(["a", "b", "c", "d"], pairs, 0.5)
    assert [c for c, _ in clusters] == [["a", "b", "c"]]
    assert clusters[0][1] == pytest.approx([0.9] * 3, abs=1e-6)
    assert kernels.cluster_component([1, 2], [(0, 1, 0.5)], 0.5) == []


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    df = spark.createDataFrame(edges, "src int, dst int")
    got = {r["node"]: r["component"] for r in connected_components(df, keeper(spark)).collect()}
    assert got == {n: root(n) for e in edges if e[0] != e[1] for n in e}
    assert connected_components(df.limit(0), keeper(spark)).count() == 0


def test_greedy_matching_equals_the_sequential_one(spark):
    rng = random.Random(7)
    edges = {(rng.randrange(12), 100 + rng.randrange(12)): rng.randrange(1, 5) / 5 for _ in range(50)}
    df = spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()], "id_a int, id_b int, score float")
    used, want = set(), set()
    for s, a, b in sorted(((s, a, b) for (a, b), s in edges.items()), reverse=True):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    assert {(r["id_a"], r["id_b"]) for r in resolve.one_to_one(df, keeper(spark)).collect()} == want


@pytest.mark.parametrize("few", [0, 1000])
@pytest.mark.parametrize("both_ways", [False, True])
def test_canopies_equal_the_sequential_rule(spark, monkeypatch, few, both_ways):
    monkeypatch.setattr(similarity, "FEW_LINKS", few)
    rng = random.Random(11)
    near = {(a, b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(60)) if a != b}
    near |= {(b, a) for a, b in near} if both_ways else set()
    want, centre = {}, {}
    for d in range(30):
        if d in want:
            continue
        members = sorted(b for a, b in near if a == d)
        if members:
            centre[d] = want[d] = d
            for m in members:
                want.setdefault(m, d)
    df = spark.createDataFrame(sorted(near), "query_id int, doc_id int")
    assert {r["doc_id"]: r["canopy"] for r in canopies(df, keeper(spark)).collect()} == want


def test_edit_distance_search_equals_brute_force(spark):
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(13)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 8))) for _ in range(40)})
    df = spark.createDataFrame(list(enumerate(words)), "doc_id int, doc string")
    for k in (1, 3):
        got = {(r[0], r[1]) for r in levenshtein_neighbours(df, df, k).collect()}
        assert got == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if lev(a, b) <= k}


def test_documents_of_a_field(spark, people):
    rows = {r["id"]: r["doc_id"] for r in documents(people, "name", "Levenshtein", "id").collect()}
    assert rows[0] == 0 and len(rows) == 8


def test_partition_of_people(spark, people):
    matcher = Deduplicator([V.string("name"), V.string("age")])
    with pytest.raises(NotTrained):
        matcher.pairs(people)
    matcher.predicates = [Index("TfidfNGram", "Canopy", 0.4, "name")]
    matcher.model = Logistic([-0.3376218, -0.4207086], 1.8078122, 0.1)
    got = models.clusters_to_python(matcher.partition(people, 0.5))
    assert [ids for ids, _ in got] == [(0, 4), (1, 6), (2, 7), (3,), (5,)]
    assert [round(c[0], 5) for _, c in got] == pytest.approx([0.792416, 0.744947, 0.79232, 1, 1], abs=1e-5)


def test_links_and_gazetteer(spark, people, tmp_path):
    left, right = people.filter("id % 2 = 0"), people.filter("id % 2 = 1")
    link = RecordLink([V.string("name"), V.exact("age", has_missing=True)])
    link.predicates, link.model = [Simple("wholeFieldPredicate", "age", False)], Logistic([-0.3, 1.0, 0.0], 1.0)
    pairs = {(r["id_a"], r["id_b"]) for r in link.join(left, right, 0.0, "many-to-many").collect()}
    assert pairs == {(0, 5), (4, 5), (2, 7), (6, 1)}
    assert link.join(left, right, 0.0).count() == 3
    with pytest.raises(ValueError):
        link.join(left, right, constraint="all")
    link.write_settings(str(tmp_path / "model.json"))
    gazetteer = Gazetteer.from_settings(str(tmp_path / "model.json"))
    gazetteer.index(right)
    gazetteer.index(right)
    assert gazetteer.indexed_len == 4
    got = {r["id"]: [m["id"] for m in r["matches"]] for r in gazetteer.search(left, n_matches=2).collect()}
    assert got == {0: [5], 4: [5], 2: [7], 6: [1]}
    gazetteer.unindex(right.filter("id = 5"))
    assert {r["id"]: len(r["matches"]) for r in gazetteer.search(left).collect()} == {0: 0, 4: 0, 2: 1, 6: 1}


def test_logistic_optimum():
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    model = fit_logistic(x, np.array([0, 0, 1, 1]), 1.0)
    p = model.probabilities(x)
    gradient = np.array(model.weights) + x.T @ (p - [0, 0, 1, 1])
    assert abs(gradient[0]) < 1e-6 and abs((p - [0, 0, 1, 1]).sum()) < 1e-6


def test_distance_row(spark):
    records = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "a", None)], "id int, type string, name string")
    model = DataModel([V.categorical("type", ["a", "b"], name="type"), V.exact("name", name="name", has_missing=True), V.interaction("type", "name")])
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "id_a int, id_b int")
    rows = {(r["id_a"], r["id_b"]): r["d"] for r in model.rows(pairs, records, records, "id").collect()}
    assert len(model) == len(rows[1, 2])
    assert rows[1, 2][:5] == [0, 1, 1, 0, 1]
    assert rows[1, 3][2] == 0 and rows[1, 3][5:] == [0, 0, 0]
    with pytest.raises(ValueError):
        DataModel([])
    with pytest.raises(ValueError):
        DataModel([V.exact("name"), V.interaction("none")])


def test_rule_search():
    matches = {0: frozenset({0, 1}), 1: frozenset({2}), 2: frozenset({0, 1, 2})}
    compared = {0: {1, 2}, 1: {3}, 2: set(range(9))}
    assert sorted(rules.learn(["p", "q", "r"], matches, compared, 3)) == ["p", "q"]
    assert rules.learn(["p", "q", "r"], {}, compared, 3) == []


def test_files(tmp_path):
    pair = ({"name": "a", "tags": frozenset({"y", "x"})}, {"name": "b", "place": (1.0, 2.0)})
    models.write_training({"match": [pair], "distinct": []}, str(tmp_path / "t.json"))
    assert models.read_training(str(tmp_path / "t.json"))["match"] == [pair]
    for p in V.string("x", has_missing=True).predicates:
        assert from_config(p.config()) == p
    v = V.string("x", crf=True)
    assert V.from_config(v.config()).crf and len(v.predicates) == 48
    # fixed values: the key functions of a text, and what strings have besides
    base = """wholeFieldPredicate firstTokenPredicate firstTwoTokensPredicate commonIntegerPredicate nearIntegersPredicate firstIntegerPredicate
        hundredIntegerPredicate hundredIntegersOddPredicate alphaNumericPredicate sameThreeCharStartPredicate sameFiveCharStartPredicate
        sameSevenCharStartPredicate commonTwoTokens commonThreeTokens fingerprint oneGramFingerprint twoGramFingerprint sortedAcronym""".split()
    more = "commonFourGram commonSixGram tokenFieldPredicate suffixArray doubleMetaphone metaphoneToken".split()
    for v, names in ((V.text("x"), base), (V.string("x"), base + more), (V.short_string("x"), base + more)):
        assert [p.function for p in v.predicates if isinstance(p, Simple)] == names
    assert len(V.short_string("x").predicates) == 40 and len(V.text("x").predicates) == 34 and len(V.set_of("x").predicates) == 15


def test_samples_and_labels(spark, people):
    pairs = labels.random_pairs(spark, 8, 10, 1).collect()
    assert len(pairs) == 10 == len(set(map(tuple, pairs))) and all(0 <= r["i"] < r["j"] < 8 for r in pairs)
    assert labels.random_pairs(spark, 5, 100).count() == 10
    same = {(r[0], r[1]) for r in labels.common_key_matches(people, "age", "id").collect()}
    assert same == {(0, 4), (0, 5), (4, 5), (1, 6), (2, 7)}
    assert labels.label_pair(("a", "b"), "unsure") == {"match": [("a", "b")], "distinct": [("a", "b")]}


def test_canonical(spark):
    rows = spark.createDataFrame([(1, "mary crane", None), (2, "mary crane", "x"), (3, "mary cran", "x")], "id int, name string, note string")
    clusters = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "cluster_id int, id int")
    got = {r["field"]: r["value"] for r in resolve.canonical(rows, clusters, "id").collect()}
    assert got == {"name": "mary crane", "note": "x"}


def test_canonical_records(spark):
    rows = [(1, "mary crane", "123 main st", "12345"), (2, "mary crane", "123 main st", None), (3, "bob", None, None)]
    df = spark.createDataFrame(rows, "id int, name string, address string, zip string")
    clusters = spark.createDataFrame([(1, 1), (1, 2), (3, 3)], "cluster_id int, id int")
    got = {r["cluster_id"]: tuple(r)[1:] for r in resolve.canonical_records(df, clusters, "id").collect()}
    assert got == {1: ("mary crane", "123 main st", "12345"), 3: ("bob", None, None)}


def test_cuts_keep_the_two_best_edges(spark):
    keep = keeper(spark)
    edges = [(i, i + 1, 0.5) for i in range(6)]  # all scores alike, so the cut is above them
    df = spark.createDataFrame(edges, "id_a int, id_b int, score float")
    got = {(r["id_a"], r["id_b"]) for r in resolve.components(df, keep, 4).collect()}
    assert got == {(0, 1), (1, 2)}


def test_conjunctions_count_as_rules():
    matcher = Deduplicator([V.exact("name")])
    matcher._pool, matcher._cover, matcher._rules = [(1, 2), (1, 3), (2, 3)], {0: {(1, 2), (1, 3)}, 1: {(1, 3)}, 2: {(2, 3)}}, [(0, 1), (2,)]
    assert matcher._covered().tolist() == [False, True, True]
    matcher._rules = []
    assert not matcher._covered().any()
    matcher.training = {"match": [({"id": 1}, {"id": 2})], "distinct": [({"id": 1}, {"id": 3})]}
    assert matcher.flatten_training() == ([({"id": 1}, {"id": 2}), ({"id": 1}, {"id": 3})], [1, 0])


def test_a_large_component_is_cut(spark):
    edges = [(i, i + 1, 0.9 if i != 3 else 0.1) for i in range(7)]
    df = spark.createDataFrame(edges, "id_a int, id_b int, score float")
    got = resolve.components(df, keeper(spark), max_component=5).select("component").distinct().collect()
    assert {r[0] for r in got} == {0, 4}


def test_marking_fits_on_all_labels(spark, people):
    matcher = Deduplicator([V.exact("name"), V.exact("age")])
    matcher.prepare_training(people)
    rows = [dict(zip(("id", "name", "age"), p, strict=True)) for p in PEOPLE]
    matches = [(rows[0], {**rows[0], "id": 100 + i}) for i in range(20)]
    matcher.mark_pairs({"match": matches, "distinct": [(rows[0], rows[1])] * 520})
    # same in both fields, in none
    p = matcher._fitted.probabilities(np.array([[1.0, 1.0], [0.0, 0.0]]))
    assert p[0] > 0.5 > p[1]


def test_training_counts_terms_over_the_index_sample_and_starts_from_seeds(spark):
    rng = random.Random(17)
    words = [f"w{min(rng.randrange(1, 30), rng.randrange(1, 30))}" for _ in range(900)]
    names = sorted({" ".join(words[3 * i : 3 * i + 3]) for i in range(300)})
    df = spark.createDataFrame(list(enumerate(names)), "id bigint, name string")
    left, right = df.filter("id % 2 = 0"), df.filter("id % 2 = 1")
    link = RecordLink([V.text("name")])
    link.prepare_training(left, right, sample_size=30)
    assert link._a.count() == link._b.count() == 30 and link._context.count() == right.count()
    predicates = [(i, p) for i, p in enumerate(link._predicate_list) if isinstance(p, Index) and p.family == "TfidfText"]
    sampled = {(a, b) for a in link._by_id for b in link._by_id_b}
    some = 0
    for i, p in predicates:
        docs = [documents(x, "name", "TfidfText", "id").select("doc_id", "doc").dropDuplicates(["doc_id"]) for x in (right, left)]
        whole = {(r["query_id"], r["doc_id"]) for r in similarity.tfidf_neighbours(*docs, p.threshold).collect()}
        assert link._cover.get(i, set()) == whole & sampled
        some += len(whole & sampled)
    assert some
    # fitted and with rules before the first answer; the answers alone are the training data
    assert link._fitted is not None and link._rules and link.training == {"match": [], "distinct": []}
    link.uncertain_pairs()
    dedup = Deduplicator([V.exact("name")])
    dedup.prepare_training(df, sample_size=40, index_size=70)
    assert dedup._a.count() == 40 and dedup._context.count() == 70
    assert dedup._a.join(dedup._context, "id", "left_anti").isEmpty() and dedup._fitted.probabilities(np.array([[1.0]]))[0] > 0.5

"""Matchers: de-duplicate a table, link two tables, or look records up in a gazetteer."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.operators import labels, resolve
from concord.operators.blocking import block_keys, pairs_between, pairs_within
from concord.operators.predicates import Compound, Index, Simple, index_parts
from concord.plans import rules
from concord.plans.model import DataModel, Logistic, grid_search
from concord.sources import models
from concord.storage import keeper

#: Sizes of what training looks at: records per side, records that similarity searches count terms over, candidate pairs.
SAMPLE_ONE, SAMPLE_LINK, INDEXED, CANDIDATES = 5000, 4000, 50_000, 10_000


class NotTrained(RuntimeError):
    """A matcher that has no rules and no model yet was asked to match."""


class Exhausted(IndexError):
    """There are no more pairs to label."""


class _Matcher:
    modes = "Canopy"

    def __init__(self, variables: list, id_col: str = "id", seed: int = 0):
        self.variables, self.id_col, self.seed = list(variables), id_col, seed
        self.data_model = DataModel(self.variables)
        self.predicates: list = []
        self.model: Logistic | None = None
        self.training: dict[str, list] = {"match": [], "distinct": []}
        self._pool = None

    # -- a stored model

    @classmethod
    def from_settings(cls, path: str, id_col: str = "id"):
        variables, predicates, model = models.read_settings(path)
        found = cls(variables, id_col)
        found.predicates, found.model = predicates, model
        return found

    @property
    def field_names(self) -> list[str]:
        return self.data_model.fields

    @property
    def data_model_len(self) -> int:
        return len(self.data_model)

    def write_settings(self, path: str) -> None:
        self._ready()
        models.write_settings(path, self.variables, self.predicates, self.model)

    def write_training(self, path: str) -> None:
        models.write_training(self.training, path)

    def read_training(self, path: str) -> None:
        self.mark_pairs(models.read_training(path))

    def _ready(self) -> None:
        if self.model is None or not self.predicates:
            raise NotTrained("train the matcher first, or read a stored model")

    # -- training: labelled pairs are ids of the prepared records, or the records themselves

    def _candidate_predicates(self) -> list:
        return [p for p in self.data_model.predicates if not isinstance(p, Index) or p.mode == self.modes]

    def _prepare(self, left: DataFrame, right: DataFrame | None, size: int, index_size: int) -> None:
        for side in (left,) if right is None else (left, right):
            self.data_model.check(side)
            if side.isEmpty():
                raise ValueError("there are no records")
        keep = keeper(left.sparkSession)
        fields = [self.id_col, *self.data_model.fields]
        # the side that is searched gives the index sample, and of that come the records that are looked at
        context = keep(labels.sample_records((left if right is None else right).select(*fields), max(size, index_size), self.seed + 2), "index-sample")
        a = keep(labels.sample_records(context if right is None else left.select(*fields), size, self.seed), "sample")
        b = None if right is None else keep(labels.sample_records(context, size, self.seed + 1), "sample")
        predicates = self._candidate_predicates()
        cover = rules.comparison_cover(a, predicates, self.id_col, keep, b, context)
        weights: dict[tuple, float] = {}
        for pairs in cover.values():
            for p in pairs:
                weights[p] = weights.get(p, 0.0) + 1 / len(pairs)
        rng = np.random.default_rng(self.seed)
        names = sorted(weights)
        if len(names) > CANDIDATES:
            w = np.array([weights[n] for n in names])
            order = np.argsort(-np.log(rng.random(len(names))) / w)[:CANDIDATES]
            names = [names[i] for i in sorted(order)]
        self._a, self._b, self._context, self._keep, self._cover, self._predicate_list = a, b, context, keep, cover, predicates
        self._pool = names
        self._pool_rows = self._rows_of(names)
        self._by_id = {r[self.id_col]: r.asDict() for r in a.collect()}
        self._by_id_b = self._by_id if b is None else {r[self.id_col]: r.asDict() for r in b.collect()}
        self._labelled: list[tuple] = []
        self._y: list[int] = []
        self._rng = random.Random(self.seed)
        self._fitted: Logistic | None = None
        self._rules: list[tuple[int, ...]] = []  # predicates by number, several for a conjunction
        # labels to start from, which don't count in the final model: a random record with itself, and a random pair
        ones, twos = ([by_id[i] for i in sorted(by_id)] for by_id in (self._by_id, self._by_id_b))
        one = self._rng.choice(ones)
        others = [r for r in twos if right is not None or r is not one] or twos
        two = self._rng.choice(others)
        self._seeds = {"match": [(one, one)] * 4, "distinct": [(one, two)]}
        self._refit()

    def _rows_of(self, pairs: list[tuple]) -> np.ndarray:
        if not pairs:
            return np.zeros((0, len(self.data_model)))
        spark = self._a.sparkSession
        kind = self._a.schema[self.id_col].dataType.simpleString()
        table = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], f"n int, id_a {kind}, id_b {kind}")
        rows = self.data_model.rows(table, self._a, self._b if self._b is not None else self._a, self.id_col)
        found = {(r["id_a"], r["id_b"]): r["d"] for r in rows.collect()}
        return np.array([found[p] for p in pairs], dtype=float)

    def _covered(self) -> np.ndarray:
        pairs = set().union(*[set.intersection(*[self._cover[p] for p in rule]) for rule in self._rules])
        return np.array([p in pairs for p in self._pool], dtype=bool)

    def uncertain_pairs(self) -> list[tuple[dict, dict]]:
        """One pair of records whose label would help most.

        First pairs that the model takes for matches and the rules don't cover;
        else, of the covered, the one whose probability is nearest a random
        draw; else one by how much model and rules differ.
        """
        if self._pool is None:
            raise NotTrained("prepare the training first")
        if not self._pool:
            raise Exhausted("there are no more unlabelled pairs")
        p = self._fitted.probabilities(self._pool_rows) if self._fitted else np.full(len(self._pool), 0.5)
        covered = self._covered()
        missed = (p > 0.5) & ~covered
        if missed.any():
            places = np.flatnonzero(missed)
            i = int(self._rng.choices(places.tolist(), weights=p[places].tolist())[0])
        elif covered.any():
            places = np.flatnonzero(covered)
            i = int(places[np.abs(p[places] - self._rng.random()).argmin()])
        else:
            gap = np.abs(p - covered) / 2
            i = int(self._rng.choices(range(len(p)), weights=gap.tolist())[0]) if gap.sum() else self._rng.randrange(len(p))
        pair = self._pool.pop(i)
        self._pool_rows = np.delete(self._pool_rows, i, axis=0)
        return [(self._by_id[pair[0]], self._by_id_b[pair[1]])]

    def mark_pairs(self, labelled: dict[str, list]) -> None:
        """Add labels: {match: [(record, record)], distinct: [...]}; records are dicts with their id."""
        for label in ("match", "distinct"):
            for a, b in labelled.get(label, []):
                self.training[label].append((dict(a), dict(b)))
        if self._pool is not None:
            self._refit()

    def _labels(self, seeds: bool) -> dict[str, list]:
        return {label: [*(self._seeds[label] if seeds else []), *self.training[label]] for label in ("match", "distinct")}

    def _training_table(self, seeds: bool):
        pairs = [(a, b, int(label == "match")) for label, own in self._labels(seeds).items() for a, b in own]
        spark = self._a.sparkSession
        fields = self.data_model.fields
        schema = ", ".join(["id int", *[f"`{f}` {self._a.schema[f].dataType.simpleString()}" for f in fields]])
        left = spark.createDataFrame([(i, *[a.get(f) for f in fields]) for i, (a, _, _) in enumerate(pairs)], schema)
        right = spark.createDataFrame([(i, *[b.get(f) for f in fields]) for i, (_, b, _) in enumerate(pairs)], schema)
        return pairs, left, right

    def _features(self, seeds: bool = False) -> tuple[np.ndarray, np.ndarray]:
        pairs, left, right = self._training_table(seeds)
        same = left.select(F.col("id").alias("id_a"), F.col("id").alias("id_b"))
        rows = {r["id_a"]: r["d"] for r in self.data_model.rows(same, left, right, "id").collect()}
        return np.array([rows[i] for i in range(len(pairs))], dtype=float), np.array([y for _, _, y in pairs])

    def _refit(self) -> None:
        x, y = self._features(seeds=True)
        self._fitted = grid_search(x, y)
        matches = self._match_cover()
        chosen = rules.learn(list(range(len(self._predicate_list))), matches, self._cover, len(self._labels(True)["match"]))
        self._rules = [c.parts if isinstance(c, Compound) else (c,) for c in chosen]

    def _match_cover(self) -> dict[int, frozenset[int]]:
        """Which labelled matches each predicate would bring together, searches looking among the sample and the labelled records."""
        spark = self._a.sparkSession
        fields = self.data_model.fields
        schema = ", ".join(["id bigint", *[f"`{f}` {self._a.schema[f].dataType.simpleString()}" for f in fields]])
        labelled = self._labels(True)["match"]
        sides = []
        for side, (place, sample) in enumerate(((0, self._a), (1, self._b if self._b is not None else self._a))):
            own = spark.createDataFrame([(2 * i + side, *[pair[place].get(f) for f in fields]) for i, pair in enumerate(labelled)], schema)
            context = sample.select(F.lit(None).cast("bigint").alias("id"), *fields)
            sides.append((own, context))
        n = len(labelled)
        if self._b is None:
            both = sides[0][0].unionByName(sides[1][0])
            if index_parts(self._predicate_list):
                context = sides[0][1].withColumn("id", F.monotonically_increasing_id() + 2 * n)
                both = both.unionByName(context)
            keys = self._keep(block_keys(both, self._predicate_list, "id", self._keep, context=self._context), "match-keys")
            return rules.match_cover(keys, keys, [(2 * i, 2 * i + 1) for i in range(n)])
        left, right = sides[0][0], sides[1][0]
        searched = right.unionByName(sides[1][1].withColumn("id", F.monotonically_increasing_id() + 2 * n))
        a = self._keep(block_keys(left, self._predicate_list, "id", self._keep, searched=searched, context=self._context), "match-keys")
        b = self._keep(block_keys(searched, self._predicate_list, "id", self._keep, is_target=True), "match-keys")
        return rules.match_cover(a, b, [(2 * i, 2 * i + 1) for i in range(n)])

    def train(self, recall: float = 1.0, index_predicates: bool = True) -> None:
        """Learn the match model from all labels, and the cheapest rules that cover the asked share of matches."""
        if self._pool is None:
            raise NotTrained("prepare the training first")
        if not self.training["match"] and not self.training["distinct"]:
            raise ValueError("there are no labelled pairs")
        self.model = grid_search(*self._features())
        matches = self._match_cover()
        usable = {i for i, p in enumerate(self._predicate_list) if index_predicates or not index_parts([p])}
        matches = {k: v for k, v in matches.items() if k in usable}
        self.predicates = rules.learn(self._predicate_list, matches, self._cover, len(self._labels(True)["match"]), recall, self.seed)
        if not self.predicates:
            raise ValueError("no predicate covers a labelled match")

    def flatten_training(self) -> tuple[list[tuple[dict, dict]], list[int]]:
        """The labelled pairs, matches first, and 1 or 0 for each."""
        own = self.training
        return [*own["match"], *own["distinct"]], [1] * len(own["match"]) + [0] * len(own["distinct"])

    # -- scoring

    def featurize(self, pairs: DataFrame, left: DataFrame, right: DataFrame | None = None) -> DataFrame:
        """(id_a, id_b, d): the distance row of every pair, in the order of ``data_model.names``."""
        return self.data_model.rows(pairs, left, left if right is None else right, self.id_col)

    def _scores(self, pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
        rows = self.data_model.rows(pairs, left, right, self.id_col)
        return rows.select("id_a", "id_b", self.model.score().alias("score")).filter("score > 0")


class Deduplicator(_Matcher):
    """Finds the records of one table that stand for the same thing."""

    def prepare_training(self, records: DataFrame, training_file: str | None = None, sample_size: int = SAMPLE_ONE, index_size: int = INDEXED) -> None:
        self._prepare(records, None, sample_size, index_size)
        if training_file:
            self.read_training(training_file)

    def blocks(self, records: DataFrame) -> DataFrame:
        """(predicate, key, id): which records share a key of which rule."""
        self._ready()
        keep = keeper(records.sparkSession)
        return keep(block_keys(records, self.predicates, self.id_col, keep), "blocks")

    def pairs(self, records: DataFrame) -> DataFrame:
        return pairs_within(self.blocks(records))

    def score(self, pairs: DataFrame, records: DataFrame) -> DataFrame:
        self._ready()
        return self._scores(pairs, records, records)

    def cluster(self, scores: DataFrame, threshold: float = 0.5) -> DataFrame:
        return resolve.cluster(scores, keeper(scores.sparkSession), threshold)

    def one_to_one(self, scores: DataFrame, threshold: float = 0.0) -> DataFrame:
        return resolve.one_to_one(scores, keeper(scores.sparkSession), threshold)

    def many_to_one(self, scores: DataFrame, threshold: float = 0.0) -> DataFrame:
        return resolve.many_to_one(scores, threshold)

    def partition(self, records: DataFrame, threshold: float = 0.5) -> DataFrame:
        """(cluster_id, id, confidence) of every record."""
        self.data_model.check(records)
        clusters = self.cluster(self.score(self.pairs(records), records), threshold)
        return resolve.with_singletons(clusters, records, self.id_col)


class RecordLink(_Matcher):
    """Links the records of two tables."""

    modes = "Search"

    def prepare_training(self, left: DataFrame, right: DataFrame, training_file: str | None = None, sample_size: int = SAMPLE_LINK, index_size: int = INDEXED) -> None:
        self._prepare(left, right, sample_size, index_size)
        if training_file:
            self.read_training(training_file)

    def blocks(self, left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(predicate, key, id) of either side."""
        self._ready()
        keep = keeper(left.sparkSession)
        return block_keys(left, self.predicates, self.id_col, keep, searched=right), block_keys(right, self.predicates, self.id_col, keep, is_target=True)

    def pairs(self, left: DataFrame, right: DataFrame) -> DataFrame:
        return pairs_between(*self.blocks(left, right))

    def score(self, pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
        self._ready()
        return self._scores(pairs, left, right)

    def join(self, left: DataFrame, right: DataFrame, threshold: float = 0.5, constraint: str = "one-to-one") -> DataFrame:
        if constraint not in ("one-to-one", "many-to-one", "many-to-many"):
            raise ValueError(f"{constraint!r} is not one-to-one, many-to-one or many-to-many")
        scores = self.score(self.pairs(left, right), left, right)
        if constraint == "one-to-one":
            return resolve.one_to_one(scores, keeper(left.sparkSession), threshold)
        return resolve.many_to_one(scores, threshold) if constraint == "many-to-one" else resolve.many_to_many(scores, threshold)


class Gazetteer(RecordLink):
    """Looks messy records up in a table of canonical ones."""

    def __init__(self, variables: list, id_col: str = "id", seed: int = 0):
        super().__init__(variables, id_col, seed)
        self._records: DataFrame | None = None

    @property
    def indexed_len(self) -> int:
        return 0 if self._records is None else self._records.count()

    def index(self, records: DataFrame) -> None:
        """Add records; one with a known id takes the place of the old."""
        self._ready()
        own = records.select(self.id_col, *self.data_model.fields)
        if self._records is not None:
            own = self._records.join(own.select(self.id_col), self.id_col, "left_anti").unionByName(own)
        self._store(own)

    def unindex(self, records: DataFrame) -> None:
        if self._records is not None:
            self._store(self._records.join(records.select(self.id_col), self.id_col, "left_anti"))

    def _store(self, records: DataFrame) -> None:
        keep = keeper(records.sparkSession)
        self._records = keep(records, "gazetteer")
        self._keys = keep(block_keys(self._records, self.predicates, self.id_col, keep, is_target=True), "gazetteer-keys")

    def many_to_n(self, scores: DataFrame, threshold: float = 0.0, n_matches: int = 1) -> DataFrame:
        """The n best pairs of each record that is looked up; all of them for n = 0."""
        return resolve.top_n(scores, threshold, n_matches)

    def search(self, records: DataFrame, threshold: float = 0.0, n_matches: int = 1) -> DataFrame:
        """(id, matches array<struct<id, score>>) of every record, best first; empty where nothing matches."""
        self._ready()
        if self._records is None:
            raise ValueError("the gazetteer is empty")
        keep = keeper(records.sparkSession)
        asked = block_keys(records, self.predicates, self.id_col, keep, searched=self._records)
        scores = self._scores(pairs_between(asked, self._keys), records, self._records)
        best = resolve.top_n(scores, threshold, n_matches).groupBy("id_a").agg(F.collect_list(F.struct("score", F.col("id_b").alias("id"))).alias("m"))
        ordered = F.transform(F.reverse(F.array_sort("m")), lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score")))
        out = records.select(F.col(self.id_col).alias("id")).join(best.select(F.col("id_a").alias("id"), ordered.alias("matches")), "id", "left")
        kind = records.schema[self.id_col].dataType.simpleString()
        return out.withColumn("matches", F.coalesce("matches", F.expr(f"cast(array() as array<struct<id:{kind},score:float>>)")))


def console_label(matcher, ask=input, show=print) -> None:
    """Label pairs at the console: y, n or u for unsure, f to finish, p to take the last answer back."""
    history: list[tuple] = []
    waiting: list[tuple] = []
    while True:
        try:
            pair = waiting.pop() if waiting else matcher.uncertain_pairs()[0]
        except Exhausted:
            break
        for record in pair:
            show("\n".join(f"{f} : {record.get(f)}" for f in matcher.field_names) + "\n")
        answer = ask("Do these records refer to the same thing? (y)es / (n)o / (u)nsure / (f)inished / (p)revious\n")
        if answer == "f":
            break
        if answer == "p" and history:
            waiting += [pair, history.pop()[0]]
        elif answer in ("y", "n", "u"):
            history.append((pair, {"y": "match", "n": "distinct", "u": "unsure"}[answer]))
            if len(history) > 1:
                done, label = history.pop(0)
                matcher.mark_pairs(labels.label_pair(done, label))
        else:
            waiting.append(pair)
    for pair, label in history:
        matcher.mark_pairs(labels.label_pair(pair, label))


__all__ = ["Deduplicator", "RecordLink", "Gazetteer", "NotTrained", "Exhausted", "console_label", "Simple"]

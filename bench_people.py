"""Blocking, scoring and clustering of synthetic people on local[$BENCH_CPUS]; prints one JSON line with the seconds of each phase.

$BENCH_PEOPLE records (8000 unless set): names of two invented words and an age;
three in five people have one record, the others two or three, of which all but the first are misspelt.
"""

from __future__ import annotations

import json
import os
import random
import time

from pyspark.sql import SparkSession

from concord.operators.predicates import Index, Simple
from concord.plans import variables as V
from concord.plans.matching import Deduplicator
from concord.plans.model import Logistic
from concord.storage import keeper

# The syllables of the published workload, which its number of candidate pairs depends on.
FIRST = "ba be bi bo ca ce ci da de fa fi ga ha ja ka la ma na pa ra sa ta va wa".split()
SECOND = "ker son ley ton man ford berg stein well croft shaw ridge dale wick more hart".split()
THIRD = "an el in or ur ad ed id od al il ol".split()
LAST = "derson son sky ova etti ez man and er ing".split()
SUFFIXES = "jr sr ii iii".split()

PREDICATES = [
    *[Simple(f, "name") for f in ("wholeFieldPredicate", "firstTokenPredicate", "commonTwoTokens", "sortedAcronym", "sameThreeCharStartPredicate", "commonFourGram", "firstTwoTokensPredicate")],
    *[Index(family, mode, t, "name") for family, t in (("TfidfNGram", 0.4), ("TfidfText", 0.4), ("Levenshtein", 1)) for mode in ("Canopy", "Search")],
]


def misspelt(name: str, chance: random.Random) -> str:
    at = chance.randrange(len(name))
    kinds = {"upper": name.upper(), "joined": name.replace(" ", ""), "dropped": name[:at] + name[at + 1 :], "suffix": f"{name} {chance.choice(SUFFIXES)}", "vowel": name.replace("e", "i"), "same": name}
    return kinds[chance.choices(list(kinds), weights=(20, 15, 15, 15, 15, 20))[0]]


def people(n: int, seed: int = 2024) -> list[tuple[int, str, str]]:
    chance, rows = random.Random(seed), []
    while len(rows) < n:
        name = "".join(map(chance.choice, (FIRST, SECOND))) + " " + "".join(map(chance.choice, (FIRST, THIRD, LAST)))
        age = str(chance.randint(18, 90))
        names = [name] + [misspelt(name, chance) for _ in range(chance.choices((0, 1, 2), weights=(3, 1, 1))[0])]
        rows += [(len(rows) + i, x, age) for i, x in enumerate(names)]
    return rows[:n]


def main() -> None:
    cpus, n = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_PEOPLE", "8000"))
    conf = {"spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    keep = keeper(spark)
    records = keep(spark.createDataFrame(people(n), "id bigint, name string, age string"), "people")
    matcher = Deduplicator([V.string("name"), V.string("age")])
    # far names and ages are unlike; the weights put about the share of pairs above 0.5 that people with near names are
    matcher.predicates, matcher.model = PREDICATES, Logistic([-1.0, -0.5], 5.0)
    took, began = {}, time.time()

    def phase(name, df):
        nonlocal began
        out = keep(df, name)
        took[name], began = round(time.time() - began, 2), time.time()
        return out

    pairs = phase("pairs", matcher.pairs(records))
    scores = phase("score", matcher.score(pairs, records))
    clusters = phase("cluster", matcher.cluster(scores, 0.5))
    print(json.dumps({"metric": "people_seconds", "value": round(sum(took.values()), 2), "unit": "sec", "records": n, "pairs": pairs.count(), "clusters": clusters.select("cluster_id").distinct().count(), "phases": took, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()

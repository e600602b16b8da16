import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from concord.llm import chat, exactdedup, fingerprint, linededup, mixing, neardup, packing, quality, simple8b, tokenio
from concord.llm.common import BATCH_BYTES, set_up
from concord.llm.html import extract_text, main_text
from concord.llm.shingles import shingle_sets
from concord.llm.tokens import TextEncoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "a", "Ab  c\n\nd ", "don't STOP.\nNow, é́ à İ ΣΑΣ", "x y " * 900, "line one is long\nline two is long\n" * 3, "line one is long\nother", "<|endoftext|> hi"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randrange(90)) for _ in range(60)) for _ in range(12)]
    texts = ODD + base + base[:4]
    for b in base[:6]:
        words = b.split()
        words[rng.randrange(60)] = "changed"
        texts.append(" ".join(words))
    rows = [(i, t, f"s{i % 3}" if i % 5 else None, i) for i, t in enumerate(texts)]
    # a repeated row, a null id, and columns whose names the operators use themselves
    rows += [rows[12], (None, base[0], "s1", 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n bigint").withColumn("key", F.lit("k")).withColumn("score", F.lit(1)).withColumn("label", F.lit("x"))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def texts_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def order(x):
    return (x[0] is None, x)


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for n in [*range(66), 5000]:
        for top in (2, 300, 50_000, 2**62, 2**64):
            values = np.minimum(rng.random(n) ** 5 * top, 2.0**63).astype(np.uint64)
            assert (simple8b.decode(simple8b.encode(values), n) == values).all()


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_the_library(path):
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    texts = [t or "" for t in ODD]
    got = TextEncoder(path).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_takes_words_of_letters_as_they_stand():
    """Such words, the first ones of texts too, need no normalising; the library's ids all the same."""
    whole = Tokenizer.from_file(WORDS)
    whole.encode_special_tokens = True
    rng = random.Random(7)
    alphabet = "abcdeßéöÿxyzt"
    plain = [" ".join("".join(rng.choices(alphabet, k=rng.randrange(1, 9))) for _ in range(30)) for _ in range(50)]
    odd = [" ".join("".join(rng.choices(alphabet + "Éİ\u0958\ufb2cªºµŁÞ×÷'$.,7²\u00ad\u0301\u0345ΣςẞǅⅣ한\u1112\u1161\t\x0b\x1c\x85\xa0\u2028", k=rng.randrange(6))) for _ in range(30)) for _ in range(300)]
    odd += [f"a{c}{mark} b" for c in "İ\u0958\u09df\u0a5e\u0b5c\u0f69\ufb1d\ufb4e" for mark in ".,"]
    encoder = TextEncoder(WORDS)
    normalised = []
    one_by_one, joined = encoder._one_by_one, encoder._joined
    encoder._one_by_one = lambda texts: normalised.extend(texts) or one_by_one(texts)
    encoder._joined = lambda tokenizer, pieces, lengths: normalised.extend(pieces if tokenizer.normalizer else []) or joined(tokenizer, pieces, lengths)
    for texts, some in ((plain, False), (odd, True), (plain + odd, True)):
        got = encoder.encode(texts)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert bool(normalised) == some


def test_encoder_takes_words_with_marks_after_them_as_they_stand():
    """A word and the marks after it are two words to the library, neither of which needs normalising."""
    whole = Tokenizer.from_file(WORDS)
    whole.encode_special_tokens = True
    rng = random.Random(11)
    marks = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
    letters = "abcdeßéöÿstmd"
    some = marks.replace(".", "").replace(",", "")  # else texts are encoded whole
    plain = [" ".join("".join(rng.choices(letters, k=rng.randrange(7))) + "".join(rng.choices(some, k=rng.randrange(1, 4))) for _ in range(60)) for _ in range(100)]
    plain.append("theast!! word### end.")
    odd = [" ".join("".join(rng.choices(letters + marks + "''''É7̸́", k=rng.randrange(9))) for _ in range(60)) for _ in range(300)]
    odd += ["", "a's! it'll? <|endoftext|> </w> x</w>!", "a≮ b≠!"]
    encoder = TextEncoder(WORDS)
    normalised = []
    joined = encoder._joined
    encoder._joined = lambda tokenizer, pieces, lengths: normalised.extend(pieces if tokenizer.normalizer else []) or joined(tokenizer, pieces, lengths)
    for texts, more in ((plain, False), (odd, True), (plain + odd, True)):
        got = encoder.encode(texts)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert bool(normalised) == more


def test_packing(docs, empty):
    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = True
    rows = packing.pack_sequences(docs, BYTES, capacity=64).collect()
    want = sorted(((d, tuple([*tokenizer.encode(t, add_special_tokens=False).ids, 0])) for d, t in texts_of(docs)), key=order)
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r["length"] == len(r["ids"]) // 4 > 0
        by_doc.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    padding = sum(64 - sum(n for _, n in p) for p in by_sequence.values())
    assert padding <= 64 * 8
    for doc, ids in want:
        whole = [x for _, part in sorted(by_doc[doc]) for x in part]
        assert len(whole) % len(ids) == 0 and sorted(whole) == sorted(ids * (len(whole) // len(ids)))
    assert packing.pack_sequences(empty, BYTES).count() == 0


def test_sum_of_squares_choice():
    levels = packing.SumOfSquares(10, lambda piece, n: (piece[:n], piece[n:]), 1.0)
    assert levels.place(6, "aaaaaa") == []
    assert levels.place(6, "bbbbbb") == [["aaaaaa", "bbbb"]]  # two windows of a level would count 4, one of level 2 counts 1
    assert levels.place(8, "cccccccc") == [["bb", "cccccccc"]]
    assert levels.place(3, "ddd") == [] and levels.place(4, "eeee") == []
    assert levels.drain() == [["ddd", "eeee"]] and levels.drain() == []


def test_sum_of_squares_against_all_choices():
    """Every placement is the one that a search over all levels and all single cuts finds, and open windows stay few."""
    rng, top, price = random.Random(8), 12, 1.0
    levels = packing.SumOfSquares(top, lambda piece, n: (piece[:n], piece[n:]), price)

    def counts():
        return [len(w) if 0 < level < top else 0 for level, w in enumerate(levels.windows)]

    def change(moves):
        n = counts()
        before = sum(x * x for x in n)
        for source, target in moves:
            if source and not n[source]:
                return None
            n[source] -= bool(source)
            n[target] += target < top
        return sum(x * x for x in n) - before

    tokens, filled = 0, []
    for i in range(3000):
        size = rng.randrange(1, top)
        whole = min(x for level in range(top - size + 1) if (x := change([(level, level + size)])) is not None)
        cuts = [x for level in range(top - size + 1, top) for rest in [size - (top - level)] for then in [(0, rest), (top - rest, top)] if (x := change([(level, top), then])) is not None]
        was = sum(x * x for x in counts())
        found = levels.place(size, str(i % 10) * size)
        after = sum(x * x for x in counts())
        if not cuts or min(cuts) + price >= whole:
            assert after - was == whole
        else:
            assert after - was < whole and found
        tokens += size
        filled += found
        assert sum(counts()) <= 2 * top
    assert all(sum(map(len, w)) == top for w in filled)
    assert tokens == len(filled) * top + sum(len(p) for w in levels.drain() for p in w)


@pytest.mark.parametrize("n", [2000, 8000])
def test_few_tokens_are_placed_at_the_end_of_a_stream(n):
    rng = np.random.default_rng(3)
    levels = packing.SumOfSquares(1024, lambda piece, k: (piece[:k], piece[k:]), packing.CUT_PRICE)
    sizes = np.minimum(1 + rng.lognormal(5.5, 1.2, n).astype(int), 30_000)
    for size in sizes.tolist():
        if size % 1024:
            levels.place(size % 1024, range(size % 1024))
    assert sum(len(p) for w in levels.drain() for p in w) < 0.02 * sizes.sum()


def test_token_file(spark, docs, empty, tmp_path):
    path = f"file://{tmp_path}/tokens"
    tokenio.write_token_file(docs, path, WORDS, 2, shards=3, block_ids=100)
    rows = sorted(tokenio.read_token_file(spark, path).collect(), key=lambda r: r["start"])
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    want = sorted(texts_of(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    at = 0
    for r, (doc, text) in zip(rows, want, strict=True):
        assert r["doc_id"] == doc and r["start"] == at
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        at += r["n_tokens"]
    tokenio.write_token_file(empty, f"{path}-none", WORDS, 2)
    assert tokenio.read_token_file(spark, f"{path}-none").count() == 0


def test_binary_fuse():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 300, 20_000):
        own = rng.integers(0, 2**63, n, dtype=np.uint64)
        built = exactdedup.BinaryFuse.build(np.concatenate([own, own[:3]]))
        assert built.holds(own).all()
        assert built.holds(rng.integers(0, 2**63, 50_000, dtype=np.uint64)).mean() < 0.001


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(docs, empty, weak):
    digest = (lambda t: F.unhex(F.rpad(F.hex(F.substring(t, 1, 8)), 16, "0"))) if weak else (lambda t: F.unhex(F.sha2(t, 256)))
    got = exactdedup.exact_groups(docs, digest=digest).collect()
    groups = {}
    for d, t in texts_of(docs):
        groups.setdefault(t, []).append(d)
    want = sorted(((d, max((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for d in g), key=order)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=order) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    assert exactdedup.exact_groups(empty).count() == 0
    assert exactdedup.drop_exact_copies(docs).columns == docs.columns


def test_exact_groups_go_by_the_screening(spark, monkeypatch):
    df = spark.createDataFrame([(i, "same" if i < 3 else f"own {i}") for i in range(9)], "doc_id bigint, text string")

    def sizes():
        got = exactdedup.exact_groups(df).collect()
        return sorted((r["doc_id"], r["group_size"]) for r in got)

    def answer(positive):
        monkeypatch.setattr(exactdedup, "_screen", lambda incoming, filters: incoming.append_column("positive", pa.array([positive] * incoming.num_rows, type=pa.bool_())))

    right = [(i, 3 if i < 3 else 1) for i in range(9)]
    assert sizes() == right
    answer(True)
    assert sizes() == right
    # negatives never meet the exact buckets: filters that cleared everything would leave each batch its own classes
    answer(False)
    assert sizes() == [(i, 1) for i in range(9)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def shingles(text, width):
    w = words_of(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_components(rows, width, percent):
    sets = [(d, shingles(t, width)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {d: (len(s), root(d)) for d, s in sets}


def test_near_duplicates(docs, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, 4).collect() if r["doc_id"] is not None}
    assert got == brute_components(texts_of(docs), 4, 80)
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.drop_near_copies(docs, 4)
    assert kept.columns == docs.columns and kept.count() < docs.count()


def test_near_duplicates_of_a_large_group(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(90):  # edits of all strengths, so that links cross components
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(80)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_components(rows, 4, 80)
    for small_list in (0, neardup.SMALL_LIST, 1000):  # short and long lists are compared in different ways
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, 4, small_list=small_list).collect()}
        assert got == want


def test_overlaps_follow_from_the_percent():
    assert [neardup.sure_overlap(k, 0.8, 1e-9) for k in (64, 256)] == [30, 163]
    assert [neardup.sure_overlap(k, 0.5, 1e-9) for k in (64, 256)] == [9, 81]
    assert neardup.sure_overlap(64, 1.0, 1e-9) == 64 and neardup.sure_overlap(4096, 0.5, 1e-9) > 1500


@pytest.mark.parametrize("percent", [90, 70, 60, 50, 15])
def test_near_duplicates_of_a_low_percent(spark, percent):
    rng = random.Random(6)
    rows = []
    for g in range(20):  # three texts of a group: 0 and 2 are near, 1 is nearer to 0; sets longer than the wide sketches
        shared = [f"g{g}w{i}" for i in range(400)]
        for part, share in enumerate((1.0, 0.95, 2 * percent / (100 + percent) + 0.01)):
            n = int(400 * share)
            rows.append((3 * g + part, " ".join(shared[:n] + [f"t{g}p{part}x{rng.randrange(10**6)}" for _ in range(400 - n)])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, 2, percent, wide=256).collect()}
    want = brute_components(rows, 2, percent)
    assert got == want
    if percent <= 60:
        assert {c for _, c in want.values()} == set(range(0, 60, 3))


def test_line_dedup(docs, empty):
    got = linededup.drop_repeated_lines(docs, batches=3).collect()
    owner = {}
    rows = [(2**63 - 1 if d is None else d, d, t) for d, t in texts_of(docs)]

    def key(line):
        k = re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
        return k if len(k) >= 10 else None

    for o, _, t in rows:
        for line in t.split("\n"):
            owner[key(line)] = min(o, owner.get(key(line), o))
    want = []
    for o, d, t in rows:
        lines = t.split("\n")
        kept = [x for x in lines if key(x) is None or owner[key(x)] == o]
        want.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got), key=order) == sorted(want, key=order)
    assert linededup.drop_repeated_lines(empty).count() == 0


def test_line_dedup_of_rows_without_an_id(spark):
    """Such rows count as one document; each has only its own lines to lose."""
    own = [f"a line of row {i} alone" for i in range(30)]
    rows = [(1, "the line that all have")] + [(None, f"the line that all have\n{x}") for x in own] + [(None, f"the line that all have\n{own[0]}")]
    got = linededup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r["text"] for r in got if r["doc_id"] is None) == sorted([*own, own[0]])


def test_clashing_names_and_empty_tables(spark, docs, empty):
    names = ["_of", "_rate", "_copy", "row", "of", "draw", "rate", "_text", "_lost_id", "doc", "kept", "c", "rep", "v", "hashes", "size"]
    odd = docs.withColumns({name: F.lit(name) for name in names})
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int").withColumn("text", F.lit("x"))
    for keep in (lambda d: quality.keep_good(d, labels), exactdedup.drop_exact_copies, mixing.mix_documents, neardup.drop_near_copies):
        kept = keep(odd)
        assert kept.columns == odd.columns and kept.filter("row <> 'row' or c <> 'c'").isEmpty() and not kept.isEmpty()
        assert keep(empty).count() == 0
    prints = fingerprint.fingerprint_documents(empty)
    assert fingerprint.merge_fingerprints(prints, "doc_id").count() == 0
    assert chat.read_chats(chat.format_chats(spark.createDataFrame([], "conv_id bigint, turn int, role string, text string"))).count() == 0


def test_very_long_texts(spark):
    """Texts of megabytes beside short ones, by every operator over documents."""
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(300_000))
    edited = long.replace("w7 ", "x ", 3)
    rows = [(1, long, "s"), (2, edited, "s"), (3, "short text of a few words only", "s"), (4, long, "t")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, 4).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}
    assert {r["doc_id"]: r["keep_id"] for r in exactdedup.exact_groups(df).collect()} == {1: 4, 2: 2, 3: 3, 4: 4}
    prints = {r["doc_id"]: fingerprint.from_text(r["fingerprint"]) for r in fingerprint.fingerprint_documents(df).collect()}
    assert fingerprint.resemblance(prints[1], prints[4]) == 1 and fingerprint.resemblance(prints[1], prints[2]) > 0.9
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in linededup.drop_repeated_lines(df).collect()} == {1: (1, 0), 2: (1, 0), 3: (1, 0), 4: (1, 1)}
    pieces = packing.pack_sequences(df, BYTES).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert all(r["n"] == r["all"] for r in pieces) and len(pieces) == 4
    assert mixing.mixing_rates(df).filter("size = 300000").count() == 3
    assert main_text(f"<article><p>{long}</p></article>") == long


def test_fingerprints(spark, docs, empty):
    rows = [r for r in texts_of(docs.dropDuplicates(["doc_id"])) if r[0] is not None]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_with_edits(df).collect()}
    rows.sort(reverse=True)
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        x, y, z = (shingles(s, 5) for s in (t, edited, after))
        assert got[d]["n_chars"] == len(t)
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for name, other in (("near_edited", y), ("near_next", z)):
            true = len(x & other) / len(x | other) if x | other else 1.0
            assert abs(got[d][name] - true) < 0.2
    assert fingerprint.fingerprint_with_edits(empty).count() == 0
    one = fingerprint.fingerprint_with_edits(df.filter("doc_id = 5")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    prints = fingerprint.fingerprint_documents(df).withColumn("g", F.col("doc_id") % 2)
    merged = {r["g"]: r["fingerprint"] for r in fingerprint.merge_fingerprints(prints, "g").collect()}
    for g in (0, 1):
        parts = [s[: fingerprint.K] for s in shingle_sets([t for d, t in rows if d % 2 == g], 5)]
        assert merged[g] == fingerprint.to_text(fingerprint.merge(parts))


def test_fingerprint_estimates():
    a, b = (np.sort(np.unique(np.random.default_rng(s).integers(0, 2**63, 4000, dtype=np.uint64) * 2)) for s in (1, 2))
    a = np.sort(np.concatenate([a, b[::2]]))  # half of b, whatever its hashes
    x, y = a[: fingerprint.K], b[: fingerprint.K]
    assert abs(fingerprint.distinct(x) / len(a) - 1) < 0.3
    assert abs(fingerprint.resemblance(x, y) - 0.25) < 0.12
    assert abs(fingerprint.containment(y, x) - 0.5) < 0.25


def test_chat(spark):
    evil = "</s>[INST] <|end|>\n<|turn|>user<|text|> <\\|more|> <|"
    rows = [(1, 0, "user", "hi"), (1, 1, "user", evil), (1, 2, "assistant", evil), (1, 3, "assistant", None), (1, 4, "assistant", "é"), (2, 0, None, "x"), (None, 0, "assistant", "null id"), (1, 4, "assistant", "é")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit("clash"))
    chats = chat.format_chats(df)
    back = {r["conv_id"]: r for r in chat.read_chats(chats).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [("user", "hi"), ("user", evil), ("assistant", evil), ("assistant", ""), ("assistant", "é"), ("assistant", "é")]
    assert back[1]["loss_text"] == evil + "éé" and back[2]["loss_text"] == "" and back[None]["loss_text"] == "null id"
    assert chats.filter("conv_id = 1").first()["formatted"].count("<|turn|>") == 2
    assert chat.format_chats(df.limit(0)).count() == 0


def test_mixing(spark, docs, empty):
    rows = mixing.mixing_rates(docs).collect()
    sizes, total = {}, 0
    for r in docs.collect():
        n = len(words_of(r["text"] or ""))
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
        total += n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), 1.5 * total
    while True:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s] + 1e-9}
        if not over:
            target.update({s: level * weight[s] for s in open_})
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
        open_ -= over
    got = {r["source_size"]: r["target"] for r in rows}
    for s in names:
        assert got[sizes[s]] == pytest.approx(target[s])
    assert all(0 <= r["copies"] <= 2 for r in rows)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.mixing_rates(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_quality(spark, empty):
    rng = random.Random(9)
    good = ["The {} of the {} was in a {} and it is for that.".format(*[rng.choice("house river garden paper".split()) for _ in range(3)]) * rng.randrange(1, 9) for _ in range(150)]
    bad = [" ".join(rng.choice("house river garden".split()).upper() + "***!!" for _ in range(rng.randrange(5, 60))) for _ in range(80)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)] + [(999, None), (None, "the end")], "doc_id bigint, text string")
    known = spark.createDataFrame([(i, int(i < 150)) for i in range(230)] + [(3, None), (999, None)], "doc_id bigint, quality int")
    rows = {r["doc_id"]: r for r in quality.score_documents(df, known).collect()}
    for i in range(230):
        assert rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert rows[i]["predicted"] == int(i < 150)
    assert 0 <= rows[999]["score"] <= 1 and 0 <= rows[None]["score"] <= 1
    assert quality.score_documents(df.limit(0), known).count() == 0
    assert quality.score_documents(df, known.limit(0)).select("score").distinct().collect() == [(0.5,)]
    assert quality.keep_good(df, known).filter("doc_id < 230").count() == 150


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a>b">Home</a></ul></nav>
    <!-- c --><div class="cookie-notice">We and you are in the cookies of the page</div><article><h1>Head&amp;line</h1><p><b>One&nbsp;two<br>three<p>Short.</p><form>Name</form>
    <div class="comments"><p>I am a reader</p></div></article><footer>&copy; me</footer></body>"""
    assert main_text(page) == "Head&line\nOne two three\nShort."
    assert main_text(None) == "" and main_text("<p>plain") == "plain" and main_text("<!-- never closed") == ""
    long = "This is the text of the page that we want to have, and it is not so short. " * 4
    assert main_text(f"<div id=menu><a href=x>Home</a></div><p>{long}</p><p>Short one.</p><p>{long}</p><div class='side bar sidebar'>{long}</div>").count("\n") == 2
    quotes = """<article><p title='5" tall' data-hidden="false">One > two</p><p alt="a > b" class=it's>Three</p><p data-x='class=ad'>Four</p><p class="\nad">x</p></article>"""
    assert main_text(quotes) == "One > two\nThree\nFour"
    assert main_text(f"<ul class=menu><li>Home</ul><h1>Head</h1><p>{long}</p><p>Short end.</p><div class=footer>us</div>") == f"Head\n{long.strip()}\nShort end."
    assert main_text(f"<article><p>{long * 3}</p></article><div>{long}</div>").count("\n") == 0
    assert main_text("<a b='1' c='2' " * 20000).count("<a") == 20000  # without an end it is no tag
    df = spark.createDataFrame([(1, "u", page), (2, None, None)], "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    assert [r["text"] for r in extract_text(df).orderBy("page_id").collect()] == [main_text(page), ""]
    assert extract_text(df.limit(0)).count() == 0


def test_html_options_without_end_tags():
    long = "This is the text of the page that we want to have, and it is not so short. " * 4
    menus = ["<select><option>A<option>B</select>", "<datalist id=x><option>A<option>B<option>C</datalist>", "<select><optgroup><option>A</option><option>B</optgroup></select>", "<div><option>A<option>B</div>", "<svg><text>x</select>y</svg>"]
    for menu in menus:
        assert main_text(f"{menu}<article><p>{long}</p></article>") == long.strip(), menu


LONG_TEXT = "This is the text of the page that we want to have, and it is not so short. " * 4


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><header><h1>Title</h1></header><p>{0}</p></article>", "Title\n{0}"),
        ("<header>Site of the day and the week</header><article><p>{0}</p></article>", "{0}"),
        ("<div class='article-with-sidebar'><article><p>{0}</p></article><div class='sidebar-left'>{0}</div></div>", "{0}"),
        ("<article><p id='search-engines-history'>{0}</p><p class='share-holders'>{0}</p><div class='share-buttons'>{0}</div></article>", "{0}\n{0}"),
        ("<article><p>Before <span class='advert'>buy <span>it</span> now</span> after. {0}</p></article>", "Before after. {0}"),
        ("<article><p>One <a class='share' href=x>Share</a> two. {0}</p></article>", "One two. {0}"),
        ("<article><div><button>Press</div><p>{0}</p></article>", "{0}"),
        ("<article><p>{0}</p></article><article><h2>Other story</h2><p>A teaser.</p></article>", "{0}"),
        ("<article><h2>First</h2><p>{0}</p></article><article><h2>Second</h2><p>{0}</p></article>", "First\n{0}\nSecond\n{0}"),
        ("<article><p>{0}</p><ul><li><a href=a>More on this here</a></li></ul><p>A short end.</p></article>", "{0}\nA short end."),
        ("<div><p>{0}</p><p>A short one.</p><p>Links</p><p><a href=a>All of</a> the links</p></div><footer>us</footer>", "{0}\nA short one."),
        ("<p>Kurz und gut Wort Satz Zahl</p>", "Kurz und gut Wort Satz Zahl"),
    ],
)
def test_html_rules(page, want):
    text = LONG_TEXT.strip()
    assert main_text(page.replace("{0}", text)) == want.replace("{0}", text)


def test_html_without_article_elements():
    """Density, length and neighbours find the article too where no element names it."""
    from pyarrow import parquet

    pages = parquet.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist()
    whole = lost = more = 0
    for page in pages:
        named, bare = (main_text(x).split("\n") for x in (page, re.sub(r"</?article\b[^>]*>", "", page or "")))
        whole += len(named)
        lost += sum(x not in bare for x in named)
        more += sum(x not in named for x in bare)
    assert whole > 1000 and lost <= 0.01 * whole and more <= 0.01 * whole


def test_the_packing_stage_keeps_the_tokens(spark, docs):
    import corpus_pipeline

    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = True
    some = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    pieces = {}
    for r in corpus_pipeline.packed_sequences(spark, some, "").collect():
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()))
    got = {doc: [x for _, ids in sorted(parts) for x in ids] for doc, parts in pieces.items()}
    assert got == {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for d, t in texts_of(some)}


def test_pipeline_runs_over_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    words = "the of and to in house river garden paper stone".split()
    texts = [" ".join(rng.choice(words) + (str(rng.randrange(99)) if rng.random() < 0.4 else "") for _ in range(60)) for _ in range(40)]
    texts += texts[:5] + [" ".join(["JUNK***!!"] * 40)] * 5
    spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 45), 0) for i in range(50)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "source mix", "packing"]
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    packed = {r["doc_id"] for r in rows}
    assert packed <= set(range(5, 45)) and len(packed) > 25

    # every stage after the classifier against brute force over what the classifier keeps
    kept = corpus_pipeline.good_documents(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    last = {}
    for r in kept:
        last[r["text"]] = max(r["doc_id"], last.get(r["text"], -1))
    left = [r for r in kept if last[r["text"]] == r["doc_id"]]
    first = {d: root for d, (_, root) in brute_components([(r["doc_id"], r["text"]) for r in left], 5, 80).items()}
    left = [r for r in left if first[r["doc_id"]] == r["doc_id"]]
    sizes = {name: sum(len(words_of(r["text"])) for r in left if r["source"] == name) for name in ("s0", "s1")}
    share = 1.5 * sum(sizes.values())
    rate = {"s0": min(2.0, share * 3 / 4 / sizes["s0"]), "s1": min(2.0, share / 4 / sizes["s1"])}
    if rate["s0"] == 2.0:  # what s0 can't take goes to s1
        rate["s1"] = min(2.0, (share - 2 * sizes["s0"]) / sizes["s1"])
    tokenizer, want, got = Tokenizer.from_file(BYTES), {}, {}
    for r in left:
        draw = int(hashlib.md5(f"mix|{r['doc_id']}".encode()).hexdigest()[:12], 16) / 2**48
        whole = int(rate[r["source"]])
        copies = whole + (draw < rate[r["source"]] - whole)
        if copies:
            want[r["doc_id"]] = copies * (len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1)
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_arrow_batches_end_by_bytes_unless_the_session_has_a_bound(spark):
    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    other = spark.newSession()
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    other.conf.set(bound, "1000000")
    set_up(other)
    assert other.conf.get(bound) == "1000000"
    fresh = spark.newSession()
    set_up(fresh)
    assert int(fresh.conf.get(bound)) == BATCH_BYTES
    size = BATCH_BYTES // 1000
    rows = fresh.range(3000).select(F.repeat(F.lit("x"), size).alias("t")).coalesce(1)
    counts = [r["n"] for r in rows.mapInArrow(count, "n bigint").collect()]
    assert sum(counts) == 3000 and len(counts) >= 3
    long = fresh.range(2).select(F.repeat(F.lit("x"), 2 * BATCH_BYTES).alias("t")).coalesce(1)
    assert sum(r["n"] for r in long.mapInArrow(count, "n bigint").collect()) == 2

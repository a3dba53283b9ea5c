"""Toxicity, source divergence and the conversation trie against plain brute force, with nulls, empty and long texts, ties and odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterloom.llm import divergence, toxicity, trie

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- source divergence


def plain_audit(docs, top):
    groups, df = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        words = TERM.findall((text or "").translate(LOWER))
        groups[lang or "", source or ""].update(words)
        df[lang or ""].update(set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in df[lang].items() if n >= 3), key=str.encode)
        counts = {s: [c[t] for t in kept] for (of, s), c in groups.items() if of == lang}
        p = {s: [1 + 10**9 * (n + 1) // (sum(c) + len(kept)) for n in c] for s, c in counts.items()}
        whole = [sum(c[k] for c in counts.values()) for k in range(len(kept))]
        q = [1 + 10**9 * (n + 1) // (sum(whole) + len(kept)) for n in whole]
        far = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(sum(map(far, p[s], p[o])), o) for o in counts if o != s]
            terms = [(far(a, b), t) for a, b, t, n in zip(p[s], q, kept, counts[s], strict=True) if n and a > b]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ordered)}
    return out


def sourced(seed, n):
    r = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{'É' * (k % 3)}{chr(97 + k // 26)}" for k in range(200)]
    docs = [(r.choice(["en", "de", None]), f"s{min(r.randrange(12), r.randrange(12)):02}", " ".join(r.choices(words, [1 / (k + 1) for k in range(200)], k=r.randrange(40)))) for _ in range(n)]
    docs += [("en", "s00", "The THE the-the 12 a_b a_b"), ("en", "s00", "The THE the-the 12 a_b a_b"), ("en", None, None), ("de", "", ""), ("xx", "one", "alone alone alone"), ("yy", "a", "only"), ("yy", "b", None)]
    return [*docs, ("en", "hot", "wa " * 50_000)]


@pytest.mark.parametrize(("tile", "groups"), [(1 << 19, 8), (40, 3), (7, 1)])
def test_divergence_is_that_of_brute_force(spark, monkeypatch, tile, groups):
    monkeypatch.setattr(divergence, "ENTRIES", 150)
    docs = sourced(tile, 400)
    table = spark.createDataFrame(docs, "lang string, source string, text string").withColumn("Term", F.lit(1)).withColumn("value", F.lit("x")).repartition(3)
    rows = divergence.audit(table, top=20, tile=tile, groups=groups).collect()
    got = [(x["lang"], x["source"], x["part"], x["item"], x["value"], x["rank"]) for x in rows]
    assert len(got) == len(set(got))
    assert set(got) == plain_audit(docs, 20)


def test_divergence_of_an_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


@pytest.mark.parametrize("blocks", [1, 2, 3, 7, 8])
def test_every_two_blocks_meet_once(spark, blocks):
    moved = divergence.travels(spark.range(blocks).select(F.col("id").cast("int").alias("block"), F.lit(blocks).alias("blocks"))).collect()
    met = [frozenset((x["block"], x["home"])) for x in moved if x["round"] >= 0]
    assert sorted(map(sorted, met)) == [[a, b] for a in range(blocks) for b in range(a + 1, blocks)]
    assert max(Counter((x["round"], b) for x in moved if x["round"] >= 0 for b in (x["block"], x["home"])).values(), default=1) == 1
    assert sorted(x["home"] for x in moved if x["round"] < 0) == list(range(blocks))


# --- conversation trie


def plain_turns(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            told = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[c].append((turn is not None, turn or 0, told, role, text))
    return {c: [x[3:] for x in sorted(found)] for c, found in turns.items()}


def plain_rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    return out


def plain_trie(conversations):
    members = defaultdict(list)
    for c, said in conversations.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    children, saved, leaves = Counter(n[:-1] for n in members if n), Counter(), Counter()
    for node, found in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(found) - 1) * len(node[-1][1].encode()) if node else 0
            leaves[node[:d]] += not children[node]
    out = set()
    for node, found in members.items():
        ends = ",".join(map(str, sorted(c for c in found if len(conversations[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(found), len(node), parent, len(found), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def talked(seed, n):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(r.choice([1, 2, 3, 5, 12])):
            rows.append((c * r.choice([1, 1, 1, 3]), turn, r.choice(["user", "assistant"]), r.choice(["hi", "hé", "", None, "what", "long " * 300])))
    rows += [(7, None, None, None), (7, None, "user", "first"), (7, 1, "user", "tie"), (7, 1, "user", "tie"), (None, 0, "user", "nobody's"), (10**12, 0, "user", "x" * 300_000)]
    return rows + [(500 + k % 2, k, "user", f"t{k % 3}") for k in range(400)] + [(600 + k, 0, "user", "copy") for k in range(60)]


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize(("radix", "piece"), [(8, 1 << 16), (2, 3)])
def test_trie_is_that_of_brute_force(spark, monkeypatch, radix, piece):
    monkeypatch.setattr(trie, "RADIX", radix)
    monkeypatch.setattr(trie, "PIECE", piece)
    rows = talked(radix, 60)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("C", F.lit("x")).withColumn("row", F.lit(2)).repartition(5)
    for made, wanted in ((trie.rebuilt_trie(table), plain_rebuilt(plain_turns(rows))), (trie.conversation_trie(table), plain_turns(rows))):
        got = [tuple(x[c] for c in COLUMNS) for x in made.collect()]
        assert len(got) == len(set(got))
        assert set(got) == plain_trie(wanted)


def test_preorder_intervals_nest(spark):
    nodes = trie.conversation_trie(spark.createDataFrame(talked(5, 40), "conv_id long, turn long, role string, text string")).collect()
    assert sorted(x["preorder"] for x in nodes) == list(range(1, len(nodes) + 1))
    by_place = sorted(nodes, key=lambda x: x["preorder"])
    for x in nodes:
        inside = by_place[x["preorder"] - 1 : x["subtree_end"]]
        assert all(y["depth"] > x["depth"] for y in inside[1:])
        assert sum(y["n_children"] == 0 for y in inside) == x["n_leaves"]


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "a")]])
def test_trie_of_nobody(spark, rows):
    assert trie.rebuilt_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect() == []


def test_turnless_conversations_are_the_roots(spark):
    alone = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2][:3]
    rows = [(c, 0, "user", "gone") for c in alone]
    (root,) = trie.rebuilt_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert tuple(root[c] for c in COLUMNS) == next(iter(plain_trie({c: [] for c in alone})))


def test_sums_run_over_partitions(spark):
    r = random.Random(3)
    rows = [(min(r.randrange(9), r.randrange(9)), k, r.randrange(100)) for k in range(900)] + [(4, 1000 + k, 1) for k in range(900)]
    found = trie.running(spark.createDataFrame(rows, "k long, o long, v long").repartition(7), ["k"], ["o"], ["v"], "sums").collect()
    so_far, n = Counter(), Counter()
    wanted = set()
    for k, o, v in sorted(rows):
        so_far[k] += v
        n[k] += 1
        wanted.add((k, o, v, n[k], so_far[k]))
    assert {tuple(x) for x in found} == wanted
    assert len(found) == len(rows)


# --- toxicity


def invented(seed, n, rude=("scumbag", "vermin"), named=()):
    """Texts of plain words; a third is rude and labelled so. Of those, some name a group, which clean texts hardly do."""
    r = random.Random(seed)
    docs = []
    for k in range(n):
        words = [f"{r.choice('bcdfgklmnprst')}{r.choice('aeiou')}{r.choice('bcdfgklmnprst')}{r.choice('aeiou')}" for _ in range(30)]
        toxic = k % 3 == 0
        if toxic:
            words[r.randrange(30)] = r.choice(rude)
            if named and r.random() < 0.7:
                words[r.randrange(30)] = r.choice(named)
        docs.append((k, " ".join(words) + ".", int(toxic)))
    return docs


def learnt(spark, docs, **how):
    rows = spark.createDataFrame(docs, "doc_id long, text string, toxic int").repartition(3)
    return toxicity.fit(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), **how)


def test_insults_are_learnt_and_held_out_rows_are_not(spark):
    docs = invented(1, 400)
    table = spark.createDataFrame([(i, t) for i, t, _ in docs] + [(None, None), (-1, ""), (-2, "scumbag " * 50_000), (0, docs[0][1])], "doc_id long, text string").withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame([(i, y) for i, _, y in docs] + [(None, 1), (5, None), (-9, 1)], "doc_id long, toxic int")
    found = toxicity.toxicity(table, labels).collect()
    assert len(found) == len(docs) + 4
    by_id = {x["doc_id"]: x for x in found}
    for i, _, y in docs:
        assert by_id[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert by_id[i]["predicted"] == y == (by_id[i]["score"] >= 0.7)
    assert by_id[None]["held_out"] is False and by_id[None]["score"] == by_id[-1]["score"] < 0.5
    assert by_id[-2]["predicted"] == 1
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in docs]
    again = toxicity.toxicity(table, spark.createDataFrame(turned, "doc_id long, toxic int")).collect()
    assert sorted((x["doc_id"] or 0, x["score"]) for x in again if x["doc_id"] is not None) == sorted((x["doc_id"], x["score"]) for x in found if x["doc_id"] is not None)


def test_swaps_keep_group_names_neutral(spark):
    docs = invented(2, 600, named=("muslims", "jews", "women"))
    plain, fair = learnt(spark, docs, fairness=0.0), learnt(spark, docs, fairness=50.0)
    neutral = "gale muslims and women tomo a kiru."
    assert plain.score(neutral) > 2 * plain.score("gale tables and chairs tomo a kiru.")
    assert fair.score(neutral) < plain.score(neutral) / 2
    assert abs(fair.weights["muslims"]) < abs(plain.weights["muslims"]) / 3
    assert fair.score("scumbag vermin muslims") > 0.7


def test_swapped_sentences():
    found = list(toxicity.swapped("Nothing here. Women and MEN ate!\nMuslims too", (("people", "women", "men"), ("believers", "muslims", "jews")), swaps=3))
    assert found == [
        (" women and men ate", " people and people ate"), (" women and men ate", " men and women ate"), ("muslims too", "believers too"), ("muslims too", "jews too"),
    ]


def test_gradient_is_that_of_differences():
    import pyarrow as pa

    model_rows = toxicity._rows(["bad", "women", "wom*"], toxicity.IDENTITIES)
    rows = list(model_rows(iter([pa.RecordBatch.from_pydict({"text": ["bad bad women here.", "men only", ""], "label": pa.array([1, 0, 0], pa.int32()), "weight": [1.0, 2.0, 0.5]})])))

    class Context:
        partitionId = staticmethod(lambda: 0)

    toxicity.TaskContext, kept = type("T", (), {"get": staticmethod(lambda: Context)}), toxicity.TaskContext
    try:
        at = lambda w: next(toxicity._gradient(w, 3.0)(iter(rows))).to_pylist()[0]
        w = np.array([0.3, -0.2, 0.5, 0.1])
        slope = [(at(w + d)["loss"] - at(w - d)["loss"]) / 2e-5 for d in np.eye(4) * 1e-5]
        assert np.allclose(slope, np.frombuffer(at(w)["grad"]), atol=1e-6)
    finally:
        toxicity.TaskContext = kept


def test_labels_of_one_kind_or_none(spark):
    docs = [(i, t, 0) for i, t, _ in invented(3, 30)]
    assert learnt(spark, docs).score("scumbag") < 0.2
    assert learnt(spark, []).score("scumbag") == 0.5
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.toxicity(empty, spark.createDataFrame([], "doc_id long, toxic int")).collect() == []


def test_sample_is_bounded_and_weighted(spark):
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    rows = toxicity.labelled(labels, sample=20).collect()
    there = Counter(i % 4 == 0 for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1)
    assert Counter(bool(x["label"]) for x in rows) == {True: 20, False: 20}
    assert {bool(x["label"]): x["weight"] for x in rows} == {k: n / 20 for k, n in there.items()}


def test_long_texts_go_in_stretches(monkeypatch):
    text = "Ab1 cdé_f-gh " * 40
    whole = toxicity.word_counts(text)
    for stretch in (1, 2, 7):
        monkeypatch.setattr(toxicity, "STRETCH", stretch)
        assert toxicity.word_counts(text) == whole


def test_vocabulary_finds_words_and_starts():
    words = Counter({"abcdefghij": 2, "abcd": 1, "abx": 5, "ab": 7, "zzz": 1, "abcdefgh": 3})
    names = ["abcd*", "abcdefgh*", "abcd", "ab", "zzz*", "zzz", "abcdefghij"]
    plain = Counter()
    for word, n in words.items():
        for name in names:
            if name == word or name.endswith("*") and len(word) > len(name) - 1 and word.startswith(name[:-1]):
                plain[name] += n
    assert toxicity.Vocabulary(names).counts(words) == plain

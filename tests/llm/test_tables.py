"""Operators over whole tables, against plain brute force, with nulls, empty texts, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql.types import LongType, StringType, StructField, StructType

import corpus_pipeline
from meterloom.llm import bpe, chat, decontam, idstore, mixing, simhash, warc
from meterloom.session import cut, scratch_path

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("source", StringType())])
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema).repartition(3)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(500)}" for _ in range(n))


# --- near-duplicates


def plain_print(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum((2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << k for k in range(64))


def plain_classes(prints, radius):
    """id -> smallest id reachable, by all pairs."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_rows():
    base = prose(1, 300)
    rows = [(k, prose(100 + k, 80), "s") for k in range(60)]
    rows += [(200 + k, re.sub(r"w\d+", f"edit{k}", base, count=1 + k % 2), "s") for k in range(25)]
    rows += [(300 + k, base.upper() if k % 2 else base, "s") for k in range(10)]
    return [*rows, (400, None, "s"), (401, "", "s"), (402, " \n", None), (403, "one", "s"), (404, "One", "s"), (405, "É two", "s")]


@pytest.mark.parametrize(("radius", "shard", "most"), [(2, 4096, 16384), (2, 8, 5), (4, 2, 3)])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, radius, shard, most):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "SHARD_MOST", most)
    monkeypatch.setattr(simhash, "QUERIES", 7)
    rows = near_rows()
    got = simhash.near_duplicates(frame(spark, rows), radius).collect()
    prints = {i: plain_print(t) for i, t, _ in rows}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == plain_classes(prints, radius)


def test_tables_leave_no_link_out():
    r = random.Random(3)
    for radius in (2, 4):
        for n in (1, 10**5, 10**8, 10**10):
            tables = simhash._tables(n, radius)
            for _ in range(200):
                a = r.getrandbits(64)
                b = a
                for bit in r.sample(range(64), radius):
                    b ^= 1 << bit
                key = lambda x, t: [x >> s & (1 << w) - 1 for _, s, w in t]
                assert any(key(a, t) == key(b, t) for t in tables)


def test_tree_finds_all_within_the_radius():
    r = np.random.default_rng(1)
    for words, radius in ((1, 2), (4, 20)):
        points = np.unique(r.integers(0, 1 << 12, (700, words)).astype(np.uint64), axis=0)
        q, p = simhash.BKTree(points).within(points, radius)
        want = {(i, j) for i in range(len(points)) for j in np.flatnonzero(simhash._apart(points[i], points) <= radius).tolist()}
        assert set(zip(q.tolist(), p.tolist(), strict=True)) == want and len(q) == len(want)


def test_long_chains_become_one_component(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 90), (95, 90), (95, 100)]
    got = {r.u: r.v for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {95: 90, 100: 90}


def test_one_of_each_class_stays(spark):
    rows = [(*r, r[0] * 2) for r in near_rows()] + [(300, prose(1, 300), "s", 600)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, TEXT_HASH long").repartition(3)
    kept = simhash.one_of_each(docs, simhash.classes(docs))
    assert kept.columns == docs.columns
    classes = plain_classes({r[0]: plain_print(r[1]) for r in rows}, 2)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes.values()))
    assert simhash.near_duplicates(docs.where("doc_id < 0")).count() == 0 and simhash.one_of_each(docs.where("doc_id < 0"), simhash.similar(docs.where("doc_id < 0"))).count() == 0


@pytest.mark.parametrize("most", [4096, 20])
def test_similar_texts_link_and_others_do_not(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "WIDE_SHARD", 4)
    monkeypatch.setattr(simhash, "WIDE_MOST", most)
    monkeypatch.setattr(simhash, "WIDE_QUERIES", 7)
    base = [prose(40 + k, 300).split() for k in range(12)]

    def edited(words, k, n):
        out = list(words)
        for at in random.Random(k).sample(range(len(words)), n):
            out[at] = f"new{k}x{at}"
        return " ".join(out)

    rows = [(k, " ".join(w), "s") for k, w in enumerate(base)]
    rows += [(100 + 10 * k + n, edited(w, 10 * k + n, 1 + n), "s") for k, w in enumerate(base) for n in range(4)]  # similarity 0.87 and more
    rows += [(300 + k, edited(w, 900 + k, 30), "s") for k, w in enumerate(base)]  # under 0.5
    rows += [(500 + k, edited(base[0], 2000 + k, 1), "s") for k in range(60)]  # a large group
    rows += [(900, None, "s"), (901, "", "s")]
    got = {r.doc_id: r.component_id for r in simhash.similar(frame(spark, rows)).collect()}
    want = {k: k for k, _, _ in rows} | {100 + 10 * k + n: k for k in range(12) for n in range(4)} | {500 + k: 0 for k in range(60)} | {901: 900}
    assert got == want


@pytest.mark.parametrize(("ranks", "big"), [(simhash.RANKS, simhash.BIG), ((0, 1, 2, 4, 1 << 30), 2), ((0, 1, 1 << 30), 1)])
def test_links_are_those_of_exact_similarity(spark, monkeypatch, ranks, big):
    monkeypatch.setattr(simhash, "RANKS", ranks)
    monkeypatch.setattr(simhash, "BIG", big)
    monkeypatch.setattr(simhash, "VISITED", 3)

    def edited(k, n):
        r, out = random.Random(k), prose(k, 300).split()
        for at in r.sample(range(300), n):
            out[at] = f"new{n}x{at}"
        # sentences end elsewhere in every copy, which is no difference
        r = random.Random(1000 * k + n)
        return " ".join(w.capitalize() + r.choice(".,!") if r.random() < 0.2 else w for w in out)

    texts = {20 * k + n: edited(k, 3 * n) for k in range(15) for n in range(8)}  # similarity from 1 down to 0.5, many near 0.8
    even = {i: re.sub(r"[.,!]", "", t.lower()).split() for i, t in texts.items()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(296)} for i, w in even.items()}
    root = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {x: low if v == high else v for x, v in root.items()}
    got = {r.doc_id: r.component_id for r in simhash.similar(frame(spark, [(i, t, "s") for i, t in texts.items()])).collect()}
    assert got == root and 15 < len(set(root.values())) < 120
    assert sum(len(sets[i]) > 0 and root[i] != i for i in texts) > 20  # of the near copies none is missed


def test_words_of_similarity():
    assert simhash.even_words("The, CAT. É!") == ["the".encode(), "cat".encode(), "é".encode()]
    assert simhash.even_words("?! ..") == [b"?!", b".."] and simhash.even_words("") == []
    assert simhash.jaccard("a, b c. d e", "A b C d e!") == 1 and simhash.jaccard("!", "?") == 0


def test_scratch_tables_go_when_they_are_done_with(spark):
    from pathlib import Path

    from meterloom.session import shared_dir

    before = set(Path(shared_dir(spark)).iterdir())
    left = simhash.components(spark.createDataFrame([(k, k + 1) for k in range(40)], "u long, v long"))
    assert len(set(Path(shared_dir(spark)).iterdir()) - before) == 1 and left.count() == 40


@pytest.mark.parametrize("edges, rounds", [([], 0), ([(5, 1), (7, 1), (9, 2)], 0), ([(5, 1), (5, 1)], 1), ([(1, 5)], 1), ([(3, 3), (4, 3)], 1), ([(9, 5), (9, 2), (7, 5)], 2)])
def test_no_star_round_is_written_that_changes_nothing(spark, monkeypatch, edges, rounds):
    written = []
    monkeypatch.setattr(simhash, "cut", lambda df, name: written.append(name) or cut(df, name))
    got = simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()
    least = {n: n for e in edges for n in e}
    for _ in edges:
        for u, v in edges:
            least[u] = least[v] = min(least[u], least[v])
    assert sorted(map(tuple, got)) == sorted((u, v) for u, v in least.items() if u != v)
    assert len(written) == 4 * rounds


# --- mixing


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    out, free, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


@pytest.mark.parametrize("blocks", [256, 1])
def test_mix_meets_its_targets(spark, monkeypatch, blocks):
    monkeypatch.setattr(mixing, "LEAST_BLOCKS", blocks)
    r = random.Random(5)
    rows = [(k, prose(k, r.randrange(1, 200)), r.choice(["a", "a", "a", "a", "a", "b", "é", "zz", None, "tiny"]) if k > 5 else "tiny") for k in range(250)]
    rows = [(k, "one two", s) if s == "tiny" else (k, t, s) for k, t, s in rows] + [(900, None, "a"), (901, "", "only empty"), (1, "one two", "tiny"), (1, "one two", "tiny")]
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    assert Counter((x.doc_id, x.size, x.source) for x in got) == Counter((i, len(WORDS.findall(t or "")), s) for i, t, s in rows)
    sizes, taken = Counter(), Counter()
    for x in got:
        sizes[x.source] += x.size
        taken[x.source] += x.taken
    want = plain_targets(dict(sizes))
    for x in got:
        assert x.target == pytest.approx(want[x.source]) and x.source_size == sizes[x.source] and 0 <= x.taken <= 3 * x.size
    for s, n in taken.items():
        assert abs(n - want[s]) <= max(3, 0.02 * want[s])
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mixed_rows_keep_their_columns(spark):
    rows = [(k, prose(k, 50), "a" if k % 3 else "b", k) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, Mix_Copies long")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    took = {x.doc_id: x.taken / x.size for x in mixing.mix(docs).collect()}
    assert {k: n for k, n in Counter(r.doc_id for r in out.collect()).items()} == {k: round(v) for k, v in took.items() if round(v)}
    assert mixing.mixed(docs.where("doc_id < 0")).count() == 0


# --- decontamination


def plain_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max() / (2 * len(a))


def test_alignment_is_that_of_the_whole_table():
    r = random.Random(2)
    for _ in range(60):
        a, b = ([bytes([97 + r.randrange(3)]) for _ in range(r.randrange(1, 12))] for _ in range(2))
        assert decontam.align(a, b) == pytest.approx(plain_align(a, b))


def test_leaks_are_found_and_others_left(spark, monkeypatch):
    items = [(k, prose(1000 + k, 40)) for k in range(8)] + [(50, "Short one."), (51, ""), (52, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    edited = items[1][1].split()
    for k in (7, 19, 31):
        edited[k] = "changed"
    texts = {0: prose(1, 200) + " " + items[0][1] + " " + prose(2, 50), 1: items[1][1].upper().replace(" ", ", "), 2: " ".join(edited), 3: "then short one", 10: prose(3, 400), 11: None, 12: "", 13: " ".join(items[2][1].split()[:6]) + " " + prose(4, 90)}
    texts |= {100 + k: prose(5000 + k, 30) + "\n" + items[3][1] for k in range(40)}
    rows = [(k, t, "s") for k, t in texts.items()] + [(0, texts[0], "s")]
    want = {(0, 0), (1, 1), (2, 1), (3, 50)} | {(100 + k, 3) for k in range(40)}
    monkeypatch.setattr(decontam, "RARE", 5)
    for slice_words in (1 << 21, 100):
        monkeypatch.setattr(decontam, "SLICE_WORDS", slice_words)
        got = decontam.matches(frame(spark, rows), bench).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
    left = decontam.clean(frame(spark, rows), bench)
    assert left.columns == ["doc_id", "text", "source"] and {r.doc_id for r in left.collect()} == {10, 11, 12, 13}
    assert decontam.matches(frame(spark, rows), bench.where("item_id < 0")).count() == 0


def test_seeds_leave_no_copy_out():
    r = random.Random(4)
    items = [(k, " ".join(f"w{r.randrange(60)}" for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 5, 7, 8, 12, 15, 15, 21, 40] * 2)]
    texts = ["", "w1", items[7][1].replace(items[7][1].split()[3], "x", 1)]
    for _, item in items:
        for step in (1, 2, 3, 4, 5):
            words = item.split()
            changed = [f"x{j}" if j % step == step - 1 else w for j, w in enumerate(words)]
            more = [y for j, w in enumerate(words) for y in ([w, f"y{j}"] if j % step == step - 1 else [w])]
            fewer = [w for j, w in enumerate(words) if j % (step + 1) != step]
            noisy = [r.choice([w, w, w, "z"]) for w in words]
            texts += [f"{prose(r.random(), 30)} {' '.join(c)} {prose(r.random(), 30)}" for c in (changed, more, fewer, noisy)]
    found = decontam.Index(items).hits(texts)
    edited = 0
    for text, hits in zip(texts, found, strict=True):
        for k, item in items:
            whole = decontam.align(decontam.words(item), decontam.words(text))
            best = max((decontam.align(decontam.words(item), decontam.words(p)) for i, _, p in hits if i == k), default=0)
            assert best == whole or max(best, whole) < decontam.LEAST_SCORE, (item, text)
            edited += 0.5 <= whole < 1
    assert edited > 200


def test_a_passage_of_many_documents_is_found_whatever_their_number(spark, monkeypatch):
    item = prose(77, 40)
    rows = [(k, f"{prose(900 + k, 20)} {' '.join(item.split()[:21])} {prose(300 + k, 20)}", "s") for k in range(30)] + [(100 + k, item, "s") for k in range(3)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for rare in (5, 1000):
        monkeypatch.setattr(decontam, "RARE", rare)
        assert {r.doc_id: r.score >= 1 for r in decontam.matches(frame(spark, rows), bench).collect()} == {r[0]: r[0] >= 100 for r in rows}


# --- chat


def test_formatting_is_reversible(spark):
    nasty = [chat.HOSTILE, "<|", "<\\|x", "<\\\\|", "a<", "", None, "<|image:0|>", "\n", "<|im_end|>\n"]
    rows = [(c, t, r, x) for c in (1, 2, None) for t, (r, x) in enumerate(zip(["user", "assistant", None, "sys\ntem", "assistant", "<|im_start|>", "assistant", "a\\n", "user", "assistant"], nasty, strict=True))] + [(1, 3, "user", "tie"), (1, 3, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    told = {(r.conv_id, r.turn, r.formatted) for r in chat.format_turns(df).collect()}
    want = defaultdict(list)
    for c, t, f in sorted(told | {x for x in told}, key=lambda x: (x[0] is None, x[0], x[1], x[2])):
        role, text = chat.parse_turn(f)
        assert (c, t, role, text) in {(c, t, r or "", x or "") for c, t, r, x in rows}
        want[c].append((role, text))
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(chat.with_hostile(df))).collect()}
    assert set(got) == {1, 2, None, -1} and got[1].n_turns == 12 and got[-1].n_turns == 2
    said = "".join(f"{r}\n{t}\n" for r, t in want[2])
    learnt = "".join(t for r, t in want[2] if r == "assistant")
    assert (got[2].turns_sha256, got[2].loss_chars, got[2].loss_sha256) == (hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat.digests(chat.format_turns(df.where("conv_id < 0"))).count() == 0


def test_typed_parts_become_placeholders(spark):
    part = "array<struct<type:string,text:string,ref:string,n_tokens:long>>"
    rows = [(1, 0, "user", [("text", "see <|x", None, None), ("image", None, "i.png", None), ("document", None, "d.pdf", 7), ("audio", None, None, None)]), (1, 1, "assistant", None)]
    a, b = chat.format_turns(spark.createDataFrame(rows, f"conv_id long, turn long, role string, p {part}"), "p").orderBy("turn").collect()
    assert a.formatted == "<|im_start|>user\nsee <\\|x<|image:0|><|document:1|><|audio:2|><|im_end|>\n"
    assert [(x.type, x.ref, x.n_tokens) for x in a.attachments] == [("image", "i.png", 576), ("document", "d.pdf", 7), ("audio", "", 750)]
    assert a.expanded_tokens == 576 + 7 + 750 and not a.loss and b.formatted == "<|im_start|>assistant\n<|im_end|>\n"
    assert chat.parse_turn(a.formatted) == ("user", "see <|x<|image:0|><|document:1|><|audio:2|>")


# --- archives


def test_archives_read_back_what_was_written(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1500)
    body = "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + "x" * 200
    rows = [(k, f"https://h/{k % 4}", body) for k in (7, 3, 9, 5)] + [(20, None, None), (21, "", ""), (22, "a b\nc", "y" * 99), (23, "u", "y" * 99), (24, "é", "é" * 50), (25, "u", "é" * 50), (3, "again", body)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = warc.archived(pages).collect()
    first = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        if len((h or "").encode()) >= 100:
            first.setdefault(h, i)
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        again = first.get(h, i) != i
        want[(i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[h] if again else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc.archived(pages.where("page_id < 0")).count() == 0


def test_files_keep_to_their_bound(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 5000)
    rows = [(k, "u", f"{k} " + "z" * (900 if k else 20_000)) for k in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    folder = warc.write_warc(pages, f"{tmp_path}/warc")
    sizes = sorted(p.stat().st_size for p in (tmp_path / "warc").glob("part-*"))
    assert len(sizes) > 8 and sizes[-1] > 20_000 and sizes[-2] < 6000
    assert {r.page_id for r in warc.read_warc(spark, folder).collect()} == set(range(30))


def test_a_revisit_without_its_response_raises(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 200), (2, "u", "x" * 200)], "page_id long, url string, html string")
    alone = warc.convert(pages).where("value LIKE '%WARC-Type: revisit%'")
    with pytest.raises(ValueError, match="page 1"):
        warc.read_warc(spark, warc.write_records(alone, f"{tmp_path}/warc"))


def test_both_versions_of_legacy_archives():
    for version in (1, 2):
        (record,) = warc.parse_arc(warc.write_arc(version, "http://h/", "20200102030405", b"a\nb\n\n"))
        assert (record.version, record.fields["url"], record.fields["date"], record.payload) == (version, "http://h/", "20200102030405", b"a\nb\n\n")
        ((head, block),) = warc.parse_warc(warc.to_warc(record, 5) + b"\r\n\r\n")
        assert head["WARC-Date"] == "2020-01-02T03:04:05Z" and block.endswith(b"a\nb\n\n") and head["WARC-Payload-Digest"] == f"sha256:{hashlib.sha256(record.payload).hexdigest()}"
    with pytest.raises(ValueError):
        list(warc.parse_arc(warc.write_arc(1, "http://h/", "20200102030405", b"abc")[:-3]))
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"http://h/ 0 0 0 0\n\n"))
    assert warc.timestamp("199607") == "1996-07-01T00:00:00Z" and warc.timestamp("199607042359") == "1996-07-04T23:59:00Z"


def arc_file(version, records):
    """A plain archive of several records; ``records`` are the fields of their lines, without the length, and their payloads."""
    about = f"{version} 0 archive\n{' '.join(warc.ARC_NAMES[version])}\n".encode()
    fields = " ".join(["-"] * (len(warc.ARC_FIELDS[version]) - 4))
    out = f"filedesc://a.arc 0.0.0.0 19970101000000 text/plain {fields[: -2] + ' ' if version == 2 else ''}{len(about)}\n".encode() + about + b"\n"
    return out + b"".join(f"{line} {len(data)}\n".encode() + data + b"\n" for line, data in records)


def test_archives_of_many_records_become_warc(spark, tmp_path):
    import gzip

    said = b"HTTP/1.0 404 Not Found\r\nServer: x\r\n\r\n<p>gone</p>\n"
    one = [("http://a/ 1.2.3.4 19970101020304 text/html", said), ("http://a/with space 1.2.3.4 199701010203 text/plain", b"bare"), ("dns:a 1.2.3.4 19970101020304 text/dns", b"a 1.2.3.4")]
    two = [("http://b/ 1.2.3.4 19980101020304 text/html 301 - http://b/new 0 b.arc", b""), ("http://b/x 1.2.3.4 19980101020304 no-type 200 c - 9 b.arc", b"\n\nbody\n")]
    (tmp_path / "a.arc").write_bytes(arc_file(1, one))
    (tmp_path / "b.arc.gz").write_bytes(gzip.compress(arc_file(2, two)))
    (tmp_path / "other.txt").write_bytes(b"no archive")
    rows = warc.arc_to_warc(spark, str(tmp_path)).orderBy("file", "offset").collect()
    read = [next(warc.parse_warc(bytes(r.value) + b"\r\n\r\n")) for r in rows]
    assert [h["WARC-Type"] for h, _ in read] == ["response", "response", "resource", "response", "response"]
    assert [h["WARC-Target-URI"] for h, _ in read] == ["http://a/", "http://a/with space", "dns:a", "http://b/", "http://b/x"]
    assert read[0][1] == said and read[0][0]["WARC-Payload-Digest"] == f"sha256:{hashlib.sha256(b'<p>gone</p>' + bytes([10])).hexdigest()}"
    assert read[1][1] == b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\nbare" and read[1][0]["WARC-Date"] == "1997-01-01T02:03:00Z" and read[2][1] == b"a 1.2.3.4"
    assert read[3][1] == b"HTTP/1.1 301 Moved Permanently\r\nContent-Type: text/html\r\nLocation: http://b/new\r\n\r\n" and read[4][1].endswith(b"octet-stream\r\n\r\n\n\nbody\n")
    facts = warc.read_warc(spark, warc.write_records(warc.arc_to_warc(spark, str(tmp_path)), f"{tmp_path}/out")).collect()
    assert sorted(r.payload_bytes for r in facts) == sorted([12, 4, 9, 0, 7])


# --- id store


def test_store_gives_back_every_id(spark):
    same = prose(9, 4000)
    rows = [(k, prose(k, 30 * k), "s") for k in range(20)] + [(50 + k, f"{prose(70 + k, 9)} {same} {prose(80 + k, 9)}", "s") for k in range(6)] + [(90, None, "s"), (91, "", "s"), (92, "<|endoftext|>", "s"), (5, prose(5, 150), "s"), (5, "another", "s"), (-3, "minus", "s")]
    whole = bpe.Encoder(bpe.vocabulary_path(), list, sum).tokenizer
    folder = idstore.write_store(frame(spark, rows), scratch_path(spark, "teststore"))
    got = idstore.read_store(spark, folder).collect()
    assert len(got) == len(rows)
    ids = defaultdict(Counter)
    for i, t, _ in rows:
        stream = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        ids[i][len(stream), zlib.crc32(np.array(stream, "<u4").tobytes())] += 1
    assert {i: Counter((r.n_tokens, r.ids_crc32) for r in got if r.doc_id == i) for i in ids} == ids
    at = 0
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at
        at += r.n_tokens
    chunks = spark.read.parquet(f"{folder}/kind=chunk")
    assert chunks.count() == chunks.select("dest").distinct().count()
    assert sum(len(r.ids) for r in chunks.collect()) < 2 * at - 4 * 2 * 4000  # the shared passage is stored once or little more
    assert idstore.stored(frame(spark, rows).where("doc_id < -9")).count() == 0


def rewritten(spark, folder, table, change):
    """The table of a store with each row as ``change`` leaves it; what it turns to None goes."""
    df = spark.read.parquet(f"{folder}/{table}")
    rows = [x for k, r in enumerate(df.orderBy(df.columns[0]).collect()) if (x := change(k, r.asDict())) is not None]
    spark.createDataFrame(rows, df.schema).write.mode("overwrite").parquet(f"{folder}/{table}")


@pytest.mark.parametrize(
    ("table", "change", "says"),
    [
        ("kind=chunk", lambda k, r: r | {"ids": bytes([r["ids"][0] ^ 1]) + r["ids"][1:]} if k == 0 else r, "address"),
        ("kind=chunk", lambda k, r: r if k else None, "address"),
        ("recipes", lambda k, r: r if k else None, "manifest"),
        ("recipes", lambda k, r: r | {"root": bytes(16)} if k == 0 else r, "manifest"),
        ("recipes", lambda k, r: r | {"chunks": r["chunks"][:-1]} if k == 0 else r, "recipe"),
        ("manifest", lambda k, r: r if k else None, "head"),
        ("manifest", lambda k, r: r | {"root": bytes(16)} if k == 0 else r, "head"),
        ("head", lambda k, r: r | {"root": bytes(16)}, "head"),
    ],
)
def test_what_is_lost_or_changed_raises(spark, table, change, says):
    folder = idstore.write_store(frame(spark, [(k, prose(k, 900), "s") for k in range(6)]), scratch_path(spark, "teststore"))
    rewritten(spark, folder, table, change)
    with pytest.raises(Exception, match=says):
        idstore.read_store(spark, folder).collect()


def test_joined_checksums():
    for n in (0, 1, 5, 4096):
        a, b = b"abc" * 7, bytes(range(256)) * (n // 256) + b"z" * (n % 256)
        assert idstore.joined_crc(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


def test_the_crcs_of_many_documents_are_joined_at_once():
    r = random.Random(4)
    made = [[r.randbytes(4 * r.choice([0, 1, 100, 70_000])) for _ in range(r.randrange(1, 7))] for _ in range(60)]
    pieces = [piece for one in made for piece in one]
    firsts = np.cumsum([0, *map(len, made)])[:-1]
    got = idstore.joined_crcs(np.array([zlib.crc32(x) for x in pieces]), np.array([len(x) for x in pieces]), firsts)
    assert got.tolist() == [zlib.crc32(b"".join(one)) for one in made]


def test_cuts_cover_the_stream_within_bounds():
    ids = np.random.default_rng(0).integers(0, 50_000, 60_000).astype("<u2")
    streams = [ids, np.zeros(30_000, "<u2"), ids[:1], ids[:0], ids[5:9000]]
    together = idstore.cuts(np.concatenate(streams), [len(s) for s in streams])
    for stream, ends in zip(streams, together, strict=True):
        sizes = np.diff([0, *ends])
        assert sizes.sum() == len(stream) and (sizes <= idstore.CHUNK_MOST).all() and (sizes[:-1] >= idstore.CHUNK_LEAST).all()
        assert ends == idstore.cuts(stream, [len(stream)])[0]  # whatever stands before


# --- pipeline


def test_pipeline_stages_take_effect(spark, tmp_path):
    clean = [(k, prose(k, 120), "en", f"src{k % 4}", 0, k) for k in range(40)]
    leak = prose(999, 40)
    rows = clean + [(100, clean[0][1], "en", "src0", 0, 1), (101, prose(7777, 60) + " " + leak, "en", "src1", 0, 1), (102, "too short", "en", "src1", 0, 1), (103, None, None, None, None, None), (104, "again and again " * 60, "en", "src2", 0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id for r in docs.collect()})
    ids = set(range(40))
    assert kept[0] == ids | {100, 101} and kept[1] == ids | {101} and kept[2] == ids and kept[3] <= ids and kept[4] == kept[3]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "token_ids"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()

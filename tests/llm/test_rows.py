"""Operators that look at one row at a time: quality, personal data, token counts, main text; against plain brute force."""

import hashlib
import os
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from meterloom.llm import bpe, html_text, idstore, pii, repetition, tokencount
from meterloom.llm.common import runs_of
from meterloom.session import ROOT

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])
ODD = [None, "", " ", "\n\n", "a", "é̃x ﬁ ½ Ⅷ", "x y  z\t\n q", "<|endoftext|> hi", "don't  'tis\r\nok.", "\x00\x1c!", "a\n\nb \n c  d e f", "日本語 テキスト です", "tail \n"]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta été über, the. of\n and".split(" ")) + str(r.randrange(60)) * (r.random() < 0.7) for _ in range(n))


# --- quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_quality(text):
    words = WORDS.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    inside = {k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def plain_share(text, n):
    words = WORDS.findall(text)
    grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    inside = {k for i in range(len(words) - n + 1) if grams[tuple(words[i : i + n])] > 1 for k in range(i, i + n)}
    return sum(len(words[k]) for k in inside)


def test_quality_is_that_of_brute_force(spark):
    texts = [*ODD, *(prose(k, 40 * k) for k in range(12)), "one two three four " * 30, "same line of words\n" * 40, prose(1, 300) + "\n" + prose(1, 300)]
    got = {r.doc_id: r for r in repetition.quality(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_quality(text or "")
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
        assert [r.dup_5gram_chars, r.dup_7gram_chars, r.dup_10gram_chars] == [plain_share(text or "", n) for n in (5, 7, 10)]
        seen, again = set(), 0
        for line in (text or "").split("\n"):
            again += len("".join(WORDS.findall(line))) if line in seen else 0
            seen.add(line)
        shares = [(plain_share(text or "", n), most) for n, most in ((5, 0.40), (7, 0.35), (10, 0.30))] + [(again, 0.30)]
        assert r.dup_line_chars == again and r.kept == (not r.base_failed and all(n <= most * r.word_chars for n, most in shares))
    assert got[len(ODD) + 11].kept and not got[len(texts) - 1].kept


def test_quality_takes_any_lengths():
    rules = repetition.Rules(ngram_share=((1, 0.9), (2, 0.5), (3, 0.4), (6, 0.2)))
    for text in ("a b a b c", "one two three " * 4 + "x", prose(4, 300), "a", "a a", "w " * 70, prose(5, 3) + " " + prose(5, 3)):
        told = dict(zip([f.name for f in repetition.schema(rules).fields], repetition.measure(text, rules), strict=True))
        assert [told[f"dup_{n}gram_chars"] for n in (1, 2, 3, 6)] == [plain_share(text, n) for n in (1, 2, 3, 6)]
        assert told["n_repeat_words"] == plain_quality(text)[4]


def test_quality_of_very_long_texts():
    text = prose(6, 200_000)
    n_words, chars, _, _, n_repeat, *_ = repetition.measure(text)
    assert (n_words, chars, n_repeat) == (plain_quality(text)[0], plain_quality(text)[1], plain_quality(text)[4])


def test_quality_keeps_columns_with_clashing_names(spark):
    rows = spark.createDataFrame([(1, prose(3, 200), "x", 5), (2, "short", "y", 6), (1, prose(3, 200), "x", 5)], "doc_id long, text string, quality string, Q long")
    kept = repetition.keep(rows)
    assert kept.columns == rows.columns and [tuple(r)[2:] for r in kept.collect()] == [("x", 5)] * 2
    assert repetition.quality(rows.where("doc_id < 0")).count() == 0


# --- personal data

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(*m.span(), "email") for m in EMAIL.finditer(text)]
    out += [(*m.span(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(*m.span(), "card") for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


def test_personal_data_is_that_of_brute_force(spark):
    r = random.Random(7)
    made = ["".join(r.choice(["a", "b.c", "@", "@x.y", ".", "1", "12", "4111 1111-1111 1111", "+1 (555) 123-4567", "10.2.3.4", "300.1.1.1", " ", "é", "-", "00.0.0.0", "\n"]) for _ in range(40)) for _ in range(300)]
    texts = [*ODD, *made, "a@b@c.d e@f.g@h.i", "1.2.3.4.5.6.7.8", "9" * 4000 + ".1.1.1", "IBAN account DE89370400440532013000 ok", "IBAN account DE89370400440532013001 no", "token = \"" + "0123456789abcdef" * 2 + "\""]
    got = {x.doc_id: x for x in pii.personal_data(docs(spark, texts)).collect()}
    for k, text in enumerate(texts):
        want = plain_spans(text or "")
        said = ",".join(f"{kind}:{s}:{e}" for s, e, kind in want)
        assert [got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone] == [sum(x[2] == kind for x in want) for kind in pii.KINDS[:4]], text
        assert got[k].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(got[k].spans.split(","))
    kinds = [got[len(texts) - k].spans.split(":")[0] for k in (3, 2, 1)]
    assert kinds == ["iban", "", "secret"]
    hidden = pii.redacted(docs(spark, ["mail me@x.org now", None])).collect()
    assert [x.text for x in hidden] == ["mail [email] now", None]


@pytest.mark.parametrize("text", ["a" * 60_000, "1" * 60_000, "1 " * 30_000, "+1" * 30_000, "@a" * 30_000, "x.y" * 20_000, "AB12 " * 12_000])
def test_personal_data_takes_linear_time(text):
    import time

    t = time.process_time()
    pii.find(text + " @")
    assert time.process_time() - t < 2


# --- tokens


def test_token_counts_are_the_librarys(spark):
    texts = [*ODD, *(prose(k, 100) for k in range(20)), *["the cat sat, the dog ran.\nThe cat's hat " * 5] * 3, "word!!! a_b x1y " * 20, "end\n", " lead and trail "]
    whole = bpe.Encoder(bpe.vocabulary_path(), len, sum).tokenizer
    got = {r.doc_id: r for r in tokencount.token_counts(docs(spark, texts).repartition(5)).collect()}
    for k, text in enumerate(texts):
        n = len(whole.encode(text or "", add_special_tokens=False).ids)
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((text or "").encode()), n, n > 512)
    assert tokencount.token_counts(docs(spark, texts).where("doc_id < 0")).count() == 0


def test_a_unit_may_hold_any_character(spark):
    texts = ["a b\x00c d e", "a b\x00c d e", "x a\x00b y"] * 3 + ["x a b y"] * 3 + [*(prose(k, 80) for k in range(10)), "the cat sat, the dog ran. antidisestablishmentarianism again " * 4]
    assert any("\x00" in u for u in tokencount.frequent_units(docs(spark, texts)))
    whole = bpe.Encoder(bpe.vocabulary_path(), len, sum).tokenizer
    got = {r.doc_id: r.n_tokens for r in tokencount.token_counts(docs(spark, texts).repartition(3)).collect()}
    assert got == {k: len(whole.encode(text, add_special_tokens=False).ids) for k, text in enumerate(texts)}


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_UNITS", 5)
    e = bpe.Encoder(bpe.vocabulary_path(), list, lambda parts: [x for p in parts for x in p])
    texts = [prose(k, 60) for k in range(6)] + [t or "" for t in ODD]
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert e.encode(texts) == want and [x for t in texts for x in e.encode([t])] == want


def test_units_of_all_kinds_are_the_librarys():
    e = bpe.Encoder(bpe.vocabulary_path(), list, lambda parts: [x for p in parts for x in p])
    kinds = ["word", "Ünder", "слово", "٣٤", "漢字", "ᏣᎳᎩ", "x1", "12", "½", "²", "€", "a€", "don't", "'s", "it's", "a.b", "…", "é", "e\u0301", "\u00ad", "ǅ", "ª", "_", "", "\u2028", "a\u00a0b", "\ufeff"]
    tails = ["", ",", "!!", "'s", "'", "\"", "€", "€,", "_", "-", "…."]
    r = random.Random(6)
    texts = [("\n" if n % 5 == 0 else " ").join(r.choice(kinds) + r.choice(tails) for _ in range(12)) for n in range(400)]
    assert e.encode(texts) == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_python_sees_each_unit_once_a_run():
    class Asked(dict):
        n = 0

        def get(self, *key):
            Asked.n += 1
            return super().get(*key)

    r = random.Random(3)
    words = ["".join(r.choices("abcdefgh", k=7)) for _ in range(2000)]
    column = pa.array([" ".join(r.choices(words, k=120)) for _ in range(2500)] + [None, "a  b c", "one"])  # 2.4 MB: one run
    e = bpe.Encoder(bpe.vocabulary_path(), list, lambda parts: [x for p in parts for x in p])
    e.units = Asked()
    got = [ids for texts in runs_of(column) for ids in e.encode(texts)]
    assert got == [x.ids for x in e.tokenizer.encode_batch([t or "" for t in column.to_pylist()], add_special_tokens=False)]
    assert Asked.n == len({w for t in column.to_pylist()[:2500] for w in t.split(" ")[1:-1]})


def test_the_model_takes_the_new_words_of_a_run_in_one_call():
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghéж", k=8)) for _ in range(3000)]
    columns = [pa.array([" ".join(w + r.choice(["", ",", "."]) for w in r.choices(words, k=100)) for _ in range(200)] + [None]) for _ in range(3)]
    e = idstore.IdsEncoder(bpe.vocabulary_path(), 0)
    one, asked = e.tokenize, []
    e.tokenize = lambda word: asked.append(word) or one(word)
    for column in columns:
        assert e.encode(column) == [np.array(x.ids, "<u2").tobytes() for x in e.tokenizer.encode_batch([t or "" for t in column.to_pylist()], add_special_tokens=False)]
    assert not asked


@pytest.mark.parametrize("remembered", [1, 5, 40, None])
def test_ids_of_units_of_all_kinds_are_the_librarys(remembered):
    e = idstore.IdsEncoder(bpe.vocabulary_path(), 0, remembered)
    kinds = ["word", "Ünder", "слово", "ԱԲ", "\u04ff", "\u0500", "٣٤", "漢字", "x1", "12", "½", "²", "a€", "don't", "'s", "a.b", "…", "é", "e\u0301", "\u00ad", "ǅ", "ª", "_", "\x00", "a\x00b", "Ġa", "Ċ", "\ufeff", ",", "\n", "\nword", "\nслово"]
    tails = ["", ",", "!!", "'s", "'", "€,", "_", "…."]
    r = random.Random(9)
    for _ in range(6):
        texts = [" ".join(r.choice(kinds) + r.choice(tails) for _ in range(9)) for _ in range(80)]
        assert e.encode(pa.array(["left out", *texts, None]).slice(1)) == [np.array(x.ids, "<u2").tobytes() for x in e.tokenizer.encode_batch([*texts, ""], add_special_tokens=False)]
        assert len(e.stems) == len(e.ids) <= 2 * e.remembered


def test_no_call_of_the_model_takes_all_words_of_a_long_text(monkeypatch):
    monkeypatch.setattr(idstore, "WORDS", 100, raising=False)
    e = idstore.IdsEncoder(bpe.vocabulary_path(), 0)
    one, taken = e.lines, []
    e.lines = type("Lines", (), {"encode_batch_fast": lambda self, texts, **more: taken.append(texts[0].count("\n") + 1) or one.encode_batch_fast(texts, **more)})()
    r = random.Random(2)
    text = " ".join("".join(r.choices("abcdé", k=9)) for _ in range(1002))
    assert e.encode([text]) == [np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()]
    assert max(taken) <= 100 and sum(taken) == len(set(text.split(" ")[1:-1]))


def test_runs_of_a_column():
    column = pa.array(["x", "é" * 40, None, "", "y" * 500, "z", None]).slice(1)
    for most in (1, 80, 100, 5000):
        runs = list(runs_of(column, most))
        assert [t for run in runs for t in run.to_pylist()] == column.to_pylist() and all(len(run) for run in runs)
        assert all(sum(len((t or "").encode()) for t in run.to_pylist()[:-1]) < most for run in runs)
    assert list(runs_of(column.slice(6))) == []


HELD = """
import ctypes, random, re
from types import SimpleNamespace
import pyarrow as pa, pyspark
from meterloom.llm import bpe, idstore, tokencount

pyspark.TaskContext.get = lambda: SimpleNamespace(partitionId=lambda: 0)
anon = lambda: int(re.search(r"Anonymous: +([0-9]+)", open("/proc/self/smaps_rollup").read())[1]) >> 10
r = random.Random(1)
names = ["".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(20_000)]
texts = pa.array([" ".join(r.choices(names, k=300)) for _ in range(6_000)])
for batch in idstore._cut_documents(bpe.vocabulary_path(), 0)([pa.record_batch([pa.array(range(6_000)), texts], names=["doc_id", "text"])]):
    del batch
held = anon()
pa.default_memory_pool().release_unused()
ctypes.CDLL(None).malloc_trim(0)
print(held - anon())
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="reads Linux's own figures")
def test_a_worker_holds_no_freed_memory_after_its_task():
    done = subprocess.run([sys.executable, "-c", HELD], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 16  # MB


def test_values_join_to_whole_texts_of_all_kinds():
    """Texts that are encoded whole, among others, as ids, as bytes of ids and as lengths."""
    r = random.Random(8)
    kinds = ["word", "слово", "漢字", "x1", "don't", "é,", "", "\t", "a\t", "\u00a0", "\x1c", "<|endoftext|>", "\u2028", "\v\v"]
    texts = [r.choice(["", " ", "\n"]).join(r.choice([" ", " ", "\n", "\n\n"]) + r.choice(kinds[: r.choice([6, 14])]) for _ in range(r.randrange(9)))[r.randrange(2) :] for _ in range(600)]
    want = [x.ids for x in bpe.Encoder(bpe.vocabulary_path(), list, sum).tokenizer.encode_batch(texts, add_special_tokens=False)]
    column = pa.array(texts)
    assert bpe.Encoder(bpe.vocabulary_path(), list, lambda parts: [x for p in parts for x in p]).encode(column) == want
    assert idstore.IdsEncoder(bpe.vocabulary_path(), 0).encode(column) == [np.array(x, "<u2").tobytes() for x in want]
    assert tokencount.LengthsEncoder(bpe.vocabulary_path(), len, sum).encode(column) == [len(x) for x in want]
    for e in (idstore.IdsEncoder(bpe.vocabulary_path(), 0), tokencount.LengthsEncoder(bpe.vocabulary_path(), len, sum)):
        assert e.encode([""] * 2) == [e.join([])] * 2 and e.encode(column.slice(600)) == []


# --- main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">Cookies</div><main><article class=post><header><h1>A &amp; B</h1></header><p>One <b>bold</b><br>two<p>Three &#233;&nbsp;x<ul><li>a<li>b</ul>
<div class=ad>Buy</div><form>Sub</form><script>var a="</p>";</script><!-- no --><section id="comments"><article>reader</article></section></article></main><aside>s</aside><footer>f</footer></body></html>"""


def test_main_text_of_odd_pages():
    assert html_text.main_text(PAGE) == "A & B\n\nOne bold two\n\nThree é x\n\na\n\nb"
    assert html_text.main_text("") == "" and html_text.main_text("no tags < 3 &lt; 4") == "no tags < 3 < 4"
    assert html_text.main_text("<p>a<p>b</div>c<!-- open") == "a\n\nbc"
    assert html_text.main_text("<body><header><h1>Site</h1></header><p>x</p></body>") == "x"
    assert html_text.main_text("<article><p>x</p></article><article class=comment>no</article><article><p>y</article>") == "x\n\ny"
    assert html_text.main_text('<div id="comments"><p>no</p></div><article><p>x</p></article>') == "x"


LONG = "word " * 20


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><div style="overflow:hidden"><p>a</p></div></article>', "a"),
        ('<article data-hidden="false"><p>b</p></article>', "b"),
        ('<article><div data-id="comments"><p>c</p></div></article>', "c"),
        ('<div class="layout has-sidebar"><article><p>d</p></article></div>', "d"),
        ('<div class="layout sidebar"><article><p>d</p></article></div>', "d"),
        ('<article><div class="entry-header"><h1>T</h1></div><p>e</p></article>', "T\n\ne"),
        (f'<article><section id="social-policy"><p>{LONG}</p></section></article>', LONG.strip()),
        (f'<article><p title="{"x>" * 6000}">f</p></article>', "f"),
        ("<article><p x=\"a>b\" y='>'>g</p><a href=\"foo>h</a><p>i</p></article>", "g\n\nh\n\ni"),
        ("<form id=all><article><p>j</p><input><button>k</button></article></form><form>l</form>", "j"),
        ("<article><p HIDDEN>a</p><p aria-hidden=TRUE>b</p><p role='Navigation'>c</p><div class='Cookie-Notice x'>d</div>e</article>", "e"),
        ("<article>a<article>reader</article></article><ol class=comment-list><li><article class=comment-body>b</article></ol>", "a\n\nreader"),
    ],
)
def test_words_of_classes_and_ids_spare_the_article(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("text", ["<p", "<div>", "<b><p>x", '<a href="', "<a href='\">", "<!--", "</div>", "<script>", "<p>&amp;"])
def test_pages_take_linear_time(text):
    import time

    t = time.process_time()
    html_text.main_text(text * 20_000)
    assert time.process_time() - t < 5


def test_templates_are_counted_by_content(spark):
    page = lambda k, own: f"<body><div><p>{own}</p></div><div><span>Follow our site {k % 1}</span></div></body>"
    rows = [(k, f"https://h.example/{k}", page(k, f"own words {k}")) for k in range(8)] + [(100 + k, "https://copies.example/", page(0, "the same article")) for k in range(8)] + [(200, None, None), (201, "", "<p>x</p>")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "own words 3" and got[103].text == "the same article\n\nFollow our site 0"
    assert (got[200].text, got[200].n_chars, got[201].text) == ("", 0, "x")


def plain_prose(seed, n):
    return " ".join(prose(seed, n).split())


def site(k, host, article, advert, menu="menu of words"):
    """A page whose boilerplate has no tag or role of its own."""
    return (k, f"https://{host}/{k}", f"<body><div class=x1><span>{menu}</span></div><div class=ad>{advert}</div><article><h1>T&amp;{k}</h1>{article}<p>Read on <a href=x>here</a></p></article><div class=x2>All rights</div></body>")


def test_what_recurs_on_a_host_goes(spark):
    own = lambda k: f"<p>{plain_prose(k, 30)}</p><p>{plain_prose(k + 500, 9)}</p>"
    shared = plain_prose(9999, 40)
    rows = [site(k, "a.example", own(k), f"buy {k}") for k in range(12)]
    rows += [site(20 + k, "shared.example", own(k) + (f"<p>{shared}</p>" if k % 3 == 0 else ""), "buy") for k in range(12)]
    rows += [site(40 + k, "copies.example", f"<p>{plain_prose(77, 60)}</p><p>{plain_prose(78, 20)} {k}</p>", "buy") for k in range(12)]
    rows += [site(60, "few.example", own(60), "buy"), (61, None, None), (62, "", "<p>x</p>"), (63, None, "<p>x</p>")] + [site(0, "a.example", own(0), "buy 0")] * 2
    pages = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, outside string, TEXT int").repartition(3)
    got = defaultdict(set)
    for r in html_text.extract(pages).collect():
        got[r.page_id].add(r.text)
        assert r.n_chars == len(r.text)
    words = lambda k: f"{plain_prose(k, 30)}\n\n{plain_prose(k + 500, 9)}"
    assert all(got[k] == {f"T&{k}\n\n{words(k)}"} for k in range(12))
    assert all(got[20 + k] == {f"T&{20 + k}\n\n{words(k)}" + (f"\n\n{shared}" if k % 3 == 0 else "")} for k in range(12))
    assert all(got[40 + k] == {f"T&{40 + k}\n\n{plain_prose(77, 60)}\n\n{plain_prose(78, 20)} {k}\n\nRead on here"} for k in range(12))  # one article, whatever its copies
    assert got[60] == {f"T&60\n\n{words(60)}\n\nRead on here"} and (got[61], got[62], got[63]) == ({""}, {"x"}, {"x"})
    assert html_text.extract(pages).count() == len(rows) and html_text.extract(pages.where("page_id < 0")).count() == 0
    assert all("Read on" in html_text.main_text(x) for _, _, x in rows[:24])  # it is the counts that take this away


def bare(k, host, text, more=""):
    """A page that says with no tag, role, class or id what is what."""
    return (k, f"https://{host}/{k}", f"<body><div><div><span>Home of all things</span></div></div><div><h1>T{k}</h1>{text}</div><div><p>Rights are <b>ours</b></p>{more}</div></body>")


RECIPE = "<article><h1>T{k}</h1><p>{prose}</p><h2>Ingredients</h2><ul><li>Salt</li><li>own {k}</li></ul><h2>Method</h2><p>{more}</p><p>Serve warm.</p></article>"


def recipes(host, n, first):
    return [(first + k, f"https://{host}/{k}", "<body><div>Top</div>" + RECIPE.format(k=k, prose=plain_prose(k, 30), more=plain_prose(k + 50, 30)) + "</body>") for k in range(n)]


def test_an_article_keeps_what_others_have_too(spark):
    """Headings, list items and short paragraphs that every article of a host has, on hosts of any size."""
    sizes = (1, 2, 3, 6, 12)
    rows = [row for n in sizes for row in recipes(f"r{n}.example", n, 100 * n)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n in sizes:
        for k in range(n):
            assert got[100 * n + k] == f"T{k}\n\n{plain_prose(k, 30)}\n\nIngredients\n\nSalt\n\nown {k}\n\nMethod\n\n{plain_prose(k + 50, 30)}\n\nServe warm."


def test_pages_without_articles_lose_only_what_recurs_outside_the_text(spark):
    text = lambda k: f"<p>{plain_prose(k, 30)}</p><h2>Method</h2><p>Serve warm.</p><p>{plain_prose(k + 90, 20)}</p>"
    rows = [bare(k, "b.example", text(k), f"<i>once {k}</i>") for k in range(6)] + [bare(9, "one.example", text(9))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    own = lambda k: f"T{k}\n\n{plain_prose(k, 30)}\n\nMethod\n\nServe warm.\n\n{plain_prose(k + 90, 20)}"
    assert all(got[k] == f"{own(k)}\n\nonce {k}" for k in range(6))
    assert got[9] == f"Home of all things\n\n{own(9)}\n\nRights are ours"  # nothing recurs on one page
    assert all("Home of all things" in html_text.main_text(x) for _, _, x in rows)  # it is the counts that take it away


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<body><form id="aspnetForm"><input><div><label>Search</label><select><option>a</select><p>{LONG}</p></div></form></body>', f"Search\n\n{LONG.strip()}"),
        (f'<article><h1>T</h1><form>Sign up: {LONG}</form><p>{LONG * 3}</p></article>', f"T\n\n{(LONG * 3).strip()}"),
        (f'<article><h1>T</h1><div class="cookie-recipe"><p>{LONG * 2}</p></div></article>', f"T\n\n{(LONG * 2).strip()}"),
        (f'<article><h1>T</h1><p>{LONG}</p><section id="side-effects"><p>Nausea and headache.</p></section></article>', f"T\n\n{LONG.strip()}\n\nNausea and headache."),
        (f'<article><p>{LONG}</p><div class="ad-slot-3 top">{LONG}</div><div class="sidebar">short</div><div id="post-comments"><p>{LONG}</p></div></article>', LONG.strip()),
        (f"<div><article><p>teaser</p></article><article><p>teaser</p></article></div><div><h1>T</h1><p>{LONG * 2}</p></div>", f"teaser\n\nteaser\n\nT\n\n{(LONG * 2).strip()}"),
        (f"<body><p>{LONG}</p><main><p>{LONG} end</p></main></body>", f"{LONG}end"),
    ],
)
def test_forms_names_and_places(page, text):
    assert html_text.main_text(page) == text


def test_adverts_and_links_in_articles_go_where_they_recur(spark):
    extra = '<p>Get our newsletter now</p><div><a href=/a>One</a> <a href=/b>Two</a></div><ul><li><a href=/x>More on this</a></ul>'
    rows = [(k, f"https://n.example/{k}", f'<article><h1>T{k}</h1><p>{plain_prose(k, 40)}</p>{extra}<div class="related">{plain_prose(k + 70, 25)}</div><p>See <a href=/{k}>only here</a></p></article>') for k in range(8)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"T{k}\n\n{plain_prose(k, 40)}\n\nSee only here" for k in range(8))


def test_templates_are_those_of_plain_counts(spark):
    r = random.Random(8)
    crumbs = [f"<div class=c{k % 4}>crumb {k}</div>" for k in range(6)]
    rows = [(k, f"https://h{k % 3}.example/", "<body>" + "".join(r.sample(crumbs, 3)) + f"<article><h1>x</h1><p>{plain_prose(k // 2, 25)}</p></article></body>") for k in range(60)]
    got = {r.host: {c: set(r[c]) for c in ("outside", "inside", "prose")} for r in html_text.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for host in ("h0.example", "h1.example", "h2.example"):
        own = [html_text.signs(page) for _, url, page in rows if host in url]
        n = len({content for content, _ in own})
        beside = defaultdict(set)
        for _, found in own:
            for subtree, other in found:
                beside[subtree].add(other)
        for name, (least, share) in (("outside", html_text.OUTSIDE), ("inside", html_text.INSIDE), ("prose", html_text.PROSE)):
            assert got[host][name] == {s for s, others in beside.items() if len(others) >= max(least, share * n)}
        assert got[host]["outside"] and n == 20


def test_very_long_pages(spark):
    row = (1, "https://long.example/", "<article>" + "".join(f"<p>{plain_prose(k, 40)}</p>" for k in range(4000)) + "</article>")
    (got,) = html_text.extract(spark.createDataFrame([row], "page_id long, url string, html string")).collect()
    assert got.text == "\n\n".join(plain_prose(k, 40) for k in range(4000))

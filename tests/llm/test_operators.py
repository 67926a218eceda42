"""The operators against brute force, and on odd input."""

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import (
    common,
    decontaminate,
    html_extract,
    licenses,
    line_dedup,
    mixing,
    near_dedup,
    quality_model,
    quality_rules,
    sharding,
    token_store,
)
from tessera.llm.registry import tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class_id string, row int, n_words string, _key string, kept int"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"word{k}" for k in range(30_000))
PROSE = " ".join(f"some{k} plain" for k in range(60))
NEAR = PROSE.replace("some30 ", "other ")
ODD = [
    (1, None, "en", "b", 0, "x", 1, "n", "k", 1), (2, "", "en", "a", 0, None, 1, "n", "k", 1), (None, PROSE, None, None, None, None, None, None, None, None),
    (3, LONG, "en", "a", 9, "x", 1, "n", "k", 1), (4, PROSE, "en", "a", 9, "x", 1, "n", "k", 1), (4, PROSE, "en", "a", 9, "x", 1, "n", "k", 1),
    (5, NEAR, "en", None, 9, "x", 1, "n", "k", 1), (6, "one", "en", "c", 9, "x", 1, "n", "k", 1), (7, "All Rights Reserved\n\n \nCC BY all rights reserved", "de", "c", 9, "x", 1, "n", "k", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([("q1", " ".join(f"some{k} plain" for k in range(20, 40)), 1), ("q2", "One", 1), ("q3", None, 1), (None, "absent words", 1)], "item_id string, text string, doc_id int")


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_near_duplicates_odd(odd, none):
    got = rows(near_dedup.near_duplicates(odd))
    assert len(got) == len(ODD)
    of = {r["doc_id"]: r["class_id"] for r in got}
    assert of[4] == of[5] == of[None] == 4 and of[1] == of[2] == 1 and of[3] == 3
    kept = rows(near_dedup.drop_near_duplicates(odd))
    assert sorted(r["doc_id"] for r in kept) == [1, 3, 4, 6, 7] and set(kept[0]) == set(odd.columns)
    assert rows(near_dedup.near_duplicates(none)) == [] and rows(near_dedup.drop_near_duplicates(none)) == []


def test_near_duplicates_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pdf = docs.toPandas()
    w = near_dedup.corpus_weights(docs.select("text"))
    sets = [near_dedup.shingles(t) for t in pdf.text]
    weights = [w.of(*s) for s in sets]
    root = list(range(len(pdf)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(pdf)):
        for b in range(a):
            _, i, j = np.intersect1d(sets[a][0], sets[b][0], assume_unique=True, return_indices=True)
            both = np.minimum(weights[a][i], weights[b][j]).sum()
            if len(i) and both >= 0.8 * (weights[a].sum() + weights[b].sum() - both) - 1e-6:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {int(pdf.doc_id[k]): int(pdf.doc_id[find(k)]) for k in range(len(pdf))}
    assert {r["doc_id"]: r["class_id"] for r in rows(near_dedup.near_duplicates(docs))} == want


def test_large_group_of_near_copies_is_one_class(spark):
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(300):
        own = list(base)
        own[int(rng.integers(120))] = f"edit{k}"
        texts.append((k, " ".join(own)))
    got = rows(near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")))
    assert {r["class_id"] for r in got} == {0} and got[0]["class_size"] == 300


def test_quality_model(spark, odd, none):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = rows(quality_model.score(docs).join(labels, "doc_id"))
    right = sum(r["kept"] == (r["quality"] == 1) for r in got) / len(got)
    assert right >= 0.95
    assert all(r["kept"] for r in got if r["quality"] == 1)
    assert len(rows(quality_model.score(odd))) == len(ODD) and quality_model.keep(odd).columns == odd.columns
    assert rows(quality_model.score(none)) == [] and rows(quality_model.keep(none)) == []


def test_line_dedup(spark, odd, none):
    docs = spark.createDataFrame([(1, "a first line of some text\nanother line here\n\nx"), (2, " a first line of some text \nx\nunique"), (3, "a first line of some texts, a"), (4, None), (None, "unique")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(line_dedup.dedup_lines(docs))}
    assert got[1]["dropped"] == [] and got[1]["n_lines"] == 3 and got[2]["dropped"] == [0, 1] and got[4]["n_lines"] == 0 and got[None]["dropped"] == [0]
    clean = {r["doc_id"]: r["text"] for r in rows(line_dedup.without_lines(docs))}
    assert clean[2] == "unique" and clean[1] == "a first line of some text\nanother line here\n\nx" and clean[4] is None and clean[None] == ""
    twice = rows(line_dedup.without_lines(spark.createDataFrame([(1, "same line of text\nmore", "x")] * 3, "doc_id long, text string, row string")))
    assert sorted((r["doc_id"], r["text"], r["row"]) for r in twice) == [(1, "", "x"), (1, "", "x"), (1, "same line of text\nmore", "x")]
    assert len(rows(line_dedup.dedup_lines(odd))) == len(ODD) and rows(line_dedup.dedup_lines(none)) == []


def test_html(spark):
    page = "<html><head><title>t</title><script>var x='</p>';</script></head><body><nav><ul><li>Menu</li></ul></nav><div class='ad'>Buy</div>" \
        "<article><h1>Head &amp; line</h1><p><b>One\n two<br><p>Th&#233;</p><div id=comments><p>nice</p></div></article><footer>foot</footer>"
    plain = "<body><div>Site</div><p>Text {}</p><div>Bottom</div>"
    data = [(1, "http://a/x/1", page, "z"), (2, "http://b/1", plain.format(1), "z"), (3, "http://b/2", plain.format(2), "z"), (4, None, None, None), (5, "http://b/3", "", None), (5, "bad", "<", None)]
    got = rows(html_extract.extract(spark.createDataFrame(data, "page_id long, url string, html string, host string")))
    of = {(r["page_id"], r["url"]): r for r in got}
    assert of[1, "http://a/x/1"]["text"] == "Head & line\nOne two\nThé" and of[1, "http://a/x/1"]["n_chars"] == 23
    assert of[2, "http://b/1"]["text"] == "Text 1" and of[3, "http://b/2"]["text"] == "Text 2" and of[4, None]["text"] == "" and len(got) == 6
    assert html_extract.common_lines(list("abcbd"), list("bcd")) in ({1, 2, 4},)
    assert rows(html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string"))) == []


def _text(html, partner=None):
    return html_extract.article(html_extract.page_lines(html), html_extract.page_lines(partner) if partner else None)[0]


@pytest.mark.parametrize("tag", ["article", "main"])
def test_op4_names_inside_the_article(tag):
    for kept in ('id="related-work"', 'class="share-price"', 'id="search"', 'class="commentary"', 'class="header"'):
        assert _text(f"<{tag}><p>One</p><section {kept}><p>Two</p></section></{tag}>") == "One\nTwo"
    for gone in ('class="commentList"', 'class="userComments"', 'class="responses"', 'id="comment-12"', 'class="ad-slot"'):
        assert _text(f"<{tag}><p>One</p><div {gone}><p>Two</p></div></{tag}>") == "One"
    assert _text(f'<{tag}><p>One</p></{tag}><article class="comment"><p>Two</p></article>') == "One"
    assert _text("<article><p>One</p><article><p>Reply</p></article></article>") == "One"


def test_op4_differencing_decides_without_article():
    page = "<body><div>Site name</div><div>Home</div><div><p>Body {0} first</p><p>Body {0} second</p></div><div>All about us</div></body>"
    assert _text(page.format("a"), page.format("b")) == "Body a first\nBody a second"
    # A teaser in an <article> does not replace the body beside it; shared lines of an article stay.
    beside = "<div>Menu</div><article><p>Teaser</p></article><div><p>The body of {} is long.</p></div>"
    assert _text(beside.format("a"), beside.format("b")) == "Teaser\nThe body of a is long."
    shared = "<div>Menu</div><article><p>Same passage here</p><p>{}</p></article>"
    assert _text(shared.format("a"), shared.format("b")) == "Same passage here\na"


def test_op4_hostile_pages_take_linear_time():
    import time

    began = time.time()
    for html in ("<a " * 100_000, "<a href=\"" * 60_000, "<" * 300_000, "<!-" * 100_000, "<script>" * 50_000, "<div>" * 30_000 + "</p>" * 30_000, "<p 'x\">" * 50_000):
        html_extract.page_lines(html)
    same = [(0, "same")] * 40_000
    assert html_extract.article(same, same + same[:1])[1] == 40_000
    assert time.time() - began < 20


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def test_op4_repeated_lines_align_by_a_longest_common_subsequence():
    import random
    import time

    draw = random.Random(7)
    for n in range(300):
        letters = "abcdefghij"[: 1 + n % 10]
        a, b = ([draw.choice(letters) for _ in range(draw.randrange(70))] for _ in range(2))
        for own in (html_extract.common_lines(a, b), html_extract._common_dense(a, b)):
            assert len(own) == _lcs(a, b)
            at = iter(b)
            assert all(a[k] in at for k in sorted(own))  # in order in b
    more, site = "<div>More</div>", "".join(f"<div>Part {k}</div>" for k in range(10))
    assert _text(more * 5 + site + more * 5 + "<p>Body a</p>", site + more * 5 + "<p>Body b</p>") == "More\n" * 5 + "Body a"
    began = time.time()
    a, b = ["x", "y", "z"] * 7_000 + ["x"], ["y", "x"] * 10_000
    assert len(html_extract.common_lines(a, b)) >= 14_000
    assert time.time() - began < 10


def test_op4_equals_brute_force_whatever_the_ranges(spark):
    """A host without <article>, with copies side by side, over many ranges: each page against its nearest neighbours."""
    body = "<div>Site {h}</div><div>{k} own line</div><p>passage {m}</p><div>Bottom {h}</div>"
    data = []
    for h in range(3):
        for k in range(60):
            data.append((h * 100 + k, f"http://h{h}/dir{k % 7}/p{k}", body.format(h=h, k=k if k % 10 else 0, m=k % 3)))
    ordered = sorted(data, key=lambda r: (r[1].split("/")[2], "/" + "/".join(r[1].split("/")[3:]), r[0]))
    want = {}
    for i, (page_id, url, html) in enumerate(ordered):
        lines = html_extract.page_lines(html)
        near = []
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(ordered) and ordered[j][1].split("/")[2] == url.split("/")[2] and html_extract.page_lines(ordered[j][2]) == lines:
                j += step
            if 0 <= j < len(ordered) and ordered[j][1].split("/")[2] == url.split("/")[2]:
                near.append(ordered[j])
        best = max(near, key=lambda r: html_extract._near(url, r[1]))
        want[page_id] = html_extract.article(lines, html_extract.page_lines(best[2]))[0]
    assert all("Site" not in x and "Bottom" not in x for x in want.values())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    for n in ("1", "7", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            assert {r["page_id"]: r["text"] for r in rows(html_extract.extract(df))} == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)


def test_token_store(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    tricky = [(10, "It's THE!! end² Été é x\ty\x1cz 12ab don't,'s <|endoftext|> ΣΑΣ 中文 \r\n a_b"), (-3, "  "), (-(1 << 63), "least ALİ, VELİ.")]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(tricky, "doc_id long, text string"))
    root = f"file://{tmp_path}/store"
    token_store.write(docs, root, tokenizer_path())
    got = sorted(rows(token_store.read(spark, root)), key=lambda r: r["start"])
    ids = Counter((k, tuple([*t.encode(x or "", add_special_tokens=False).ids, 2])) for k, x in [(r.doc_id, r.text) for r in docs.collect()])
    want = Counter((k, len(v), zlib.crc32(np.array(v, "<u4").tobytes())) for k, v in ids.elements())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in got), key=lambda x: (x is not None, x or 0))
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    store = token_store.Store(spark, root)
    encoded = lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 2]
    for key in {r.doc_id for r in docs.collect()} - {None}:
        assert sorted(x.tolist() for x in store.get(key)) == sorted(encoded(r.text) for r in docs.where(f"doc_id = {key}").collect())
    assert store.get(987654) == [] and store.get(1 << 62) == [] and store.get(-5) == []
    assert rows(token_store.store(none, tokenizer_path())) == []


def test_op5_ids_equal_whole_text_encoding():
    """Every letter before every kind of mark, and random texts of letters, marks, digits and blanks of many kinds."""
    import sys

    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(tokenizer_path()), token_store.Encoder(tokenizer_path(), 2, True)
    letters = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isalpha() and not (0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xD7A4 or c >= 0x17000 and c < 0x33480)]
    texts = [" ".join(f"x{c}{m} {c}{m}" for c in letters[k : k + 50]) for k in range(0, len(letters), 50) for m in (".", "),", "'s", "!\u0301", "")]
    texts += ["ALİ, VELİ.", "Kadirİ, sonra", "KADİ.", "İ.", " \u0301a. e\u0301.", "\u0958. \ufb2a, \u212a!"]
    rng = np.random.default_rng(8)
    marks = list(token_store.Encoder.MARKS) + list("'   \n\n\t\r\x1c\u00a0\u0301\u0307\u05b401²½Ⅷ一€😀") + ["'s", "'LL", "<|endoftext|>"]
    pool = letters[:400] + [letters[int(k)] for k in rng.integers(0, len(letters), 400)] + ["İ"] * 40 + marks * 8
    texts += ["".join(pool[int(k)] for k in rng.integers(0, len(pool), int(rng.integers(1, 30)))) for _ in range(20_000)]
    for lo in range(0, len(texts), 64):
        for text, ids in zip(texts[lo : lo + 64], own.encode(texts[lo : lo + 64]), strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == [*t.encode(text, add_special_tokens=False).ids, 2], ascii(text)


def test_op5_words_are_encoded_once(monkeypatch):
    """A word goes to the tokenizer once in a call, whatever is remembered, and not by way of offsets; long ones are not kept."""
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(tokenizer_path()), token_store.Encoder(tokenizer_path(), 2, True)
    given = Counter()

    class Counting:
        normalizer, pre_tokenizer = own.tokenizer.normalizer, own.tokenizer.pre_tokenizer

        def encode(self, text, **how):
            given["by offsets"] += len(text.split())
            return t.encode(text, **how)

        def encode_batch_fast(self, texts, **how):
            given["words"] += sum(len(x.split()) for x in texts)
            return t.encode_batch_fast(texts, **how)

    monkeypatch.setattr(own, "tokenizer", Counting())
    monkeypatch.setattr(own, "parts", {"": b""}, raising=False)
    rng = np.random.default_rng(3)
    words = sorted({"".join("aeionrstlé"[int(k)] for k in rng.integers(0, 10, 9)) for _ in range(3000)})
    texts = [" ".join(words[int(k)] + ["", ",", ".", ")."][int(k) % 4] for k in rng.integers(0, len(words), 200)) for _ in range(300)]
    texts[7:7] = ["", " \n\x0b\x0c\r\t ", "x" * 5000 + ".", "KADİ. don't <|endoftext|> 12,5\x0bVeli\x0cé"]
    for most in (0, 500, 600_000):
        monkeypatch.setattr(token_store.Encoder, "PARTS", most, raising=False)
        given.clear()
        got = own.encode(texts)
        assert given["words"] <= len(words) + 10 and given["by offsets"] <= 510  # one run
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    given.clear()
    assert own.encode(texts) == got and given["words"] == 1  # the long one
    wide = token_store.Encoder(tokenizer_path(), 1 << 16, True)
    assert [np.frombuffer(x, "<u4").tolist() for x in wide.encode(texts[:9])] == [[*t.encode(x, add_special_tokens=False).ids, 1 << 16] for x in texts[:9]]
    whole = token_store.Encoder(tokenizer_path(), 2, False)
    assert whole.encode(texts[:9]) == got[:9] and own.encode([]) == []


def test_op5_groups(spark, monkeypatch):
    """Shards are the same whatever texts are encoded together."""
    import pyarrow as pa

    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("text").toArrow()["text"].combine_chunks()
    own = token_store.Encoder(tokenizer_path(), 2, True)
    ids, n = own.ids(docs)
    monkeypatch.setattr(token_store.Encoder, "LAID", 7)
    each = [own.ids(docs.slice(k, 30)) for k in range(0, len(docs), 30)]
    assert np.array_equal(np.concatenate([x for x, _ in each]), ids) and np.array_equal(np.concatenate([x for _, x in each]), n)
    assert n.sum() == len(ids) and len(own.ids(pa.array([], pa.string()))[0]) == 0


def test_perfect_hash():
    keys = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 5000)
    keys = np.unique(keys)
    pilots, slot = token_store.build_hash(keys)
    assert sorted(slot.tolist()) == list(range(len(keys))) and (token_store.find_slots(keys, pilots, len(keys)) == slot).all()


def test_mixing(spark, odd, none):
    got = rows(mixing.report(odd))
    assert len(got) == len(ODD) and all(r["taken"] <= 3 * r["size"] for r in got)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = rows(mixing.report(docs).join(docs.select("doc_id", "source"), "doc_id"))
    by = {s: [x for x in r if x["source"] == s] for s in {x["source"] for x in r}}
    for own in by.values():
        assert sum(x["size"] for x in own) == own[0]["source_size"]
        assert abs(sum(x["taken"] for x in own) - own[0]["target"]) <= 0.05 * own[0]["target"] + 3
    assert sorted(map(str, r)) == sorted(map(str, rows(mixing.report(docs).join(docs.select("doc_id", "source"), "doc_id"))))
    mixed = rows(mixing.mix(docs))
    taken = {x["doc_id"]: x["taken"] for x in r}
    assert all(len(SPACE.findall(m["text"])) == taken[m["doc_id"]] for m in mixed) and {m["doc_id"] for m in mixed} == {k for k, v in taken.items() if v}
    assert rows(mixing.report(none)) == [] and rows(mixing.mix(none)) == [] and mixing.mix(odd).columns == odd.columns
    # Caps: a small heavy source stops at three times its size.
    tiny = spark.createDataFrame([(1, "a", "w " * 900), (2, "b", "w " * 10), (3, None, None)], "doc_id long, source string, text string")
    of = {r["doc_id"]: r for r in rows(mixing.report(tiny))}
    assert of[2]["target"] == 30 and 20 <= of[2]["taken"] <= 30 and of[1]["target"] == 880 and of[3]["taken"] == 0
    # Taken whole or in parts, words keep the line breaks between them.
    lines = spark.createDataFrame([(k, "ab"[k % 2], "one two\nthree\n\nfour " * 400) for k in range(4)], "doc_id long, source string, text string")
    assert all("one two\nthree\n\nfour one" in r["text"] for r in rows(mixing.mix(lines)))


def test_op6_equals_brute_force(spark):
    """Draws, permutations, layout and sums redone in Python from the drawn slots and the hashes of rows."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 9 > 0, F.col("source")))
    sized = mixing.sized(docs)
    plan = {r["_key"]: r for r in rows(mixing.targets(sized))}
    # Targets, by lowering the level until the mix has as many words as there are.
    size = {k: r["source_size"] for k, r in plan.items()}
    names = sorted(size, key=lambda k: (k == "n", k))
    weight = {k: i % 3 + 1 for i, k in enumerate(names)}
    lo, hi = 0.0, float(sum(size.values()))
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(3 * size[k], mid * weight[k]) for k in names) < sum(size.values()) else (lo, mid)
    assert all(abs(plan[k]["target"] - min(3 * size[k], lo * weight[k])) < 1e-6 * size[k] + 1e-6 for k in names)
    taken = {}
    for seed in (11, 12):
        slots = rows(mixing.slots(mixing.targets(sized), seed))
        total = sum(plan[k]["target"] / plan[k]["block"] for k in names)
        assert sorted(r["id"] for r in slots) == list(range(round(total)))
        drawn = Counter(r["_key"] for r in slots)
        for k in names:
            goal = plan[k]["target"] / plan[k]["block"]
            assert abs(drawn[k] - goal) <= 5 * goal**0.5
        at = rows(mixing.taken_blocks(mixing.targets(sized), seed))
        by = {k: [r for r in at if r["_key"] == k] for k in names}
        for k in names:
            n = plan[k]["blocks"]
            assert sorted(r["slot"] for r in by[k]) == list(range(min(drawn[k], 3 * n)))
            for e in range(3):
                own = [r["index"] for r in by[k] if r["slot"] // n == e]
                assert len(set(own)) == len(own) and all(0 <= x < n for x in own)
        times = Counter((r["_key"], r["index"]) for r in at)
        want, place = {}, Counter()
        buckets = max(16, -(-sized.count() // mixing.BUCKET_ROWS))
        layout = rows(sized.withColumn("b", F.pmod(F.xxhash64("_place", F.lit(mixing.SEED)), F.lit(buckets))))
        for r in sorted(layout, key=lambda r: (r["_key"], r["b"], r["_place"], r["_row"])):
            block, start = plan[r["_key"]]["block"], place[r["_key"]]
            want[r["_id"]] = sum(times[r["_key"], (start + j) // block] for j in range(r["_size"]))
            place[r["_key"]] += r["_size"]
        got = {r["doc_id"]: r["taken"] for r in rows(mixing.report(docs, seed))}
        assert got == want
        taken[seed] = got
        blocks = rows(mixing.blocks(docs, seed))
        assert sum(b["n_words"] for b in blocks) == sum(got.values()) and all(len(SPACE.findall(b["text"])) == b["n_words"] for b in blocks)
        assert len({(b["shard"], b["place"]) for b in blocks}) == len(blocks)
        shards = Counter((r["shard"], r["_key"]) for r in slots)
        full = [k for k in names if drawn[k] <= 3 * plan[k]["blocks"]]
        key = lambda s: "n" if s is None else "s" + s
        assert all(sum(b["shard"] == s and key(b["source"]) == k for b in blocks) == n for (s, k), n in shards.items() if k in full)
    assert taken[11] != taken[12]


def test_op6_other_draws_change_the_mix(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["taken"] for r in rows(mixing.report(docs))}
    real = mixing.slots
    monkeypatch.setattr(mixing, "slots", lambda plan, seed=0: real(plan, seed).where(F.col("id") % 2 == 0))
    after = {r["doc_id"]: r["taken"] for r in rows(mixing.report(docs))}
    assert abs(sum(after.values()) - sum(before.values()) / 2) < 0.05 * sum(before.values())


def test_licenses(odd, none):
    got = {r["doc_id"]: r for r in rows(licenses.report(odd))}
    assert (got[7]["n_words"], got[7]["n_base"], got[7]["first_word"], got[7]["last_word"]) == (8, 3, 0, 5)
    assert got[7]["base_labels"] == "cc-by,reserved" and got[7]["score"] == 1.0 and got[1]["n_base"] == 0 and got[1]["first_word"] is None and got[1]["labels"] == ""
    assert len(rows(licenses.report(odd))) == len(ODD) and rows(licenses.report(none)) == []


def _scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in rows(licenses.report(docs))}


def test_op7_notices_at_production_values(spark):
    """One word put in, left out or changed inside a notice; words that tell it from others; texts; no false spans."""
    mit = licenses.TEXTS[0][0]
    texts = [
        "intro Licensed under the really Apache License, Version 2.0 end", "permission is hereby granted",
        "under the under the under the under the under the", "the mit the mit the mit the mit", "released under the bsd license",
        "It is released under our mit license now", "licensed under the gnu general public license version 2",
        "Redistribution and use in source or binary forms, with or without modification, are permitted", "x " * 50 + mit, mit.replace("sublicense", "resell").replace("Software", "Program", 1),
        "licensed under the gnu lesser general public license", "license general public", "released under the mit license " * 3,
    ]
    got = _scan(spark, texts)
    assert [got[k]["labels"] for k in range(len(texts))] == [
        "apache-2.0", "", "", "", "", "mit", "gpl", "bsd", "mit", "mit", "gpl,lgpl", "", "mit"]
    assert got[6]["n_base"] == 1 and got[6]["first_word"] == 4 and got[12]["score"] == 1.0 and got[10]["score"] == 1.0


def test_op7_equals_brute_force(spark):
    """Base columns by regular expressions over words; labels by sliding every template over every text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [("All rights reserved. " * 3 + licenses.TEXTS[k][0] if k < 9 else licenses.NOTICES[k - 9][0]) for k in range(9 + len(licenses.NOTICES))]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(10_000 + k, x) for k, x in enumerate(extra)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows(licenses.report(docs)):
        w = ALNUM.findall((texts[r["doc_id"]] or "").translate(LOWER))
        base = [(p, label) for phrase, label in licenses.PHRASES for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        at = [p for p, _ in base]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(base), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in base}))
        labels, score = {x for _, x in base}, 1.0 if base else 0.0
        for _, phrase, label, k, own, keys in licenses.known():
            if phrase:
                continue
            where = {}
            for q in range(len(own) - k + 1):
                where.setdefault(tuple(own[q : q + k]), []).append(q)
            votes = {}
            for p in range(len(w) - k + 1):
                for q in where.get(tuple(w[p : p + k]), ()):
                    votes.setdefault(p - q, set()).add(q)
            for d in votes:
                near = {x: votes[x] for x in range(d - 2, d + 3) if x in votes}
                every = set().union(*near.values())
                share = len({q + j for q in every for j in range(k)}) / len(own)
                if max(near, key=lambda x: (len(near[x]), -x)) == d and share >= 0.8 and set(keys) <= every:
                    labels.add(label)
                    score = max(score, share)
        assert r["labels"] == ",".join(sorted(labels)) and abs(r["score"] - score) < 1e-9


def test_op7_base_columns_equal_sql(spark):
    import duckdb

    sql = f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM '{SF}/documents.parquet'),
      p AS (SELECT doc_id, i - 1 AS i, CASE WHEN w[i:i+1] = ['cc', 'by'] THEN 'cc-by' WHEN w[i:i+2] = ['general', 'public', 'license'] THEN 'gpl' WHEN w[i:i+2] = ['all', 'rights', 'reserved'] THEN 'reserved' END AS label
            FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d))
      SELECT d.doc_id, len(w) AS n_words, count(label) AS n_base, min(i) AS first_word, max(i) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
      FROM d LEFT JOIN (SELECT * FROM p WHERE label IS NOT NULL) USING (doc_id) GROUP BY ALL"""
    want = {x[0]: x[1:] for x in duckdb.sql(sql).fetchall()}
    got = rows(licenses.report(spark.read.parquet(f"{SF}/documents.parquet")))
    assert {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got} == want


def test_quality_rules(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows(quality_rules.report(docs)):
        text = texts[r["doc_id"]]
        w = SPACE.findall(text)
        grams = list(zip(w, w[1:], w[2:], strict=False))
        seen = Counter(grams)
        hit = {p + d for p, g in enumerate(grams) if seen[g] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if SPACE.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r["kept"] and r["base_failed"])
    assert len(rows(quality_rules.report(odd))) == len(ODD) and rows(quality_rules.report(none)) == []


def test_decontaminate(odd, none, items):
    got = rows(decontaminate.report(odd, items))
    words = lambda t: ALNUM.findall((t or "").translate(LOWER))
    windows = {}
    for i in items.collect():
        w = words(i.text)
        k = min(10, len(w))
        for p in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[p : p + k]), set()).update([i.item_id] if i.item_id else [])
    want = Counter()
    for r in ODD:
        w, hit, ids = words(r[1]), set(), set()
        for k in {len(x) for x in windows}:
            for p in range(len(w) - k + 1):
                if (g := tuple(w[p : p + k])) in windows:
                    hit |= set(range(p, p + k))
                    ids |= windows[g]
        want[r[0], len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == want
    assert sorted(r["doc_id"] for r in rows(decontaminate.decontaminate(odd, items))) == [1, 2, 3, 7]
    cleaned = sorted(rows(decontaminate.without_spans(odd, items)), key=str)
    assert len(cleaned) == len(ODD) and set(cleaned[0]) == set(odd.columns)
    of = {r["doc_id"]: r["text"] for r in cleaned}
    # A window is ten words of q1: of five words "some<k>" and as many "plain".
    assert of[1] is None and of[6] == "" and of[7] == ODD[8][1] and of[4] == " ".join(PROSE.split()[:40] + PROSE.split()[80:])
    assert rows(decontaminate.report(none, items)) == [] and not any(r["contaminated"] for r in rows(decontaminate.report(odd, items.limit(0))))


def test_sharding(spark, odd, none, tmp_path):
    assert len(rows(sharding.sharded(odd))) == len(ODD) and rows(sharding.sharded(none)) == []
    store = sharding.Store(spark, f"file://{tmp_path}/s")
    for k in range(6):
        store.append(spark.range(k * 100, k * 100 + 100).coalesce(2), 10)
    before = store.manifest()
    store.compact(4000)
    after = store.manifest()
    assert len(after["shards"]) < len(before["shards"]) and after["version"] > before["version"]
    assert sorted(r.id for r in store.read().collect()) == list(range(600)) == sorted(r.id for r in store.read(before["version"]).collect())
    with pytest.raises(RuntimeError, match="committed already"):
        store.commit(before, None, set(), [])
    assert not store._save(f"{store.root}/versions/{after['version']:08d}.json", "{}")
    assert all(s["bytes"] <= 4000 or s in before["shards"] for s in after["shards"]) and len({s["file"] for s in after["shards"]}) == len(after["shards"])
    # A part that a commit does not change is kept by name.
    parts = store.manifest()["parts"]
    store.append(spark.range(3).coalesce(1), 10)
    assert store.manifest()["parts"][: len(parts)] == parts and len(store.manifest()["parts"]) == len(parts) + 1


def _chain(size, step, n):
    """n texts of `size` words; each replaces `step` words of the one before, so only near neighbours are alike."""
    return [" ".join(f"c{k * step + j}" for j in range(size)) for k in range(n)]


def test_links_of_large_buckets_are_whole(spark):
    """Texts that share buckets but have no common hub: all links equal brute force."""
    rng = np.random.default_rng(5)
    texts = _chain(400, 12, 120)
    for c in range(6):  # groups around one template: most pairs of two groups are below the threshold, some are above
        base = [f"t{k}" for k in range(300)]
        for k in rng.choice(300, 2 + c, replace=False):
            base[int(k)] = f"g{c}x{k}"
        for m in range(40):
            own = list(base)
            for k in rng.choice(300, int(rng.integers(0, 9)), replace=False):
                own[int(k)] = f"m{c}y{m}z{k}"
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    w = near_dedup.corpus_weights(docs.select("text"))
    sets = [near_dedup.shingles(t) for t in texts]
    weights = [w.of(*s) for s in sets]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if root[a] != root[b]:
                _, i, j = np.intersect1d(sets[a][0], sets[b][0], assume_unique=True, return_indices=True)
                both = np.minimum(weights[a][i], weights[b][j]).sum()
                if both >= 0.8 * (weights[a].sum() + weights[b].sum() - both) - 1e-6:
                    x, y = sorted((root[a], root[b]))
                    root = [x if r == y else r for r in root]
    assert len(set(root)) > 1
    assert {r["doc_id"]: r["class_id"] for r in rows(near_dedup.near_duplicates(docs))} == dict(enumerate(root))


def test_left_over_pairs_without_hubs(spark):
    """Hubs that link nothing (every candidate of the stars is refused): the blocks alone find the links of a bucket."""
    from tessera.llm import lsh
    from pyspark.sql import functions as F

    none = F.array(*[F.lit(0).cast("long")] * 4)
    bucket = spark.range(1500).select(F.col("id").alias("node"), F.lit(1).cast("long").alias("key"), F.lit(1500).cast("long").alias("n"), none.alias("sketch"))
    asked = []
    refuse = lambda pairs: asked.append(pairs.count()) or pairs.where("false")
    texts = lambda nodes: nodes.select("node", (F.col("node") % 750).cast("string").alias("text"))
    close = lambda a, b: np.array(a, object)[:, None] == np.array(b, object)[None, :]
    roots = lsh.linked(bucket, lambda nodes: (refuse, texts(nodes)), int, close, lambda a, b: a == b, 0, 1)
    root = {r.node: r.root for r in roots.collect()}
    assert asked == [1499] and len(root) == 1500 and len(set(root.values())) == 750 and all(root[k] == root[k + 750] for k in range(750))


def test_sketch_lanes_that_differ(spark):
    from tessera.llm import lsh
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, (50, 60), dtype=np.uint64) for _ in range(2))
    b[:, ::3] = a[:, ::3]
    x, y = lsh.sketch(a), lsh.sketch(b)
    df = spark.createDataFrame([(k, x[k].tolist(), y[k].tolist()) for k in range(50)], "k int, x array<long>, y array<long>")
    want = ((a & np.uint64(15)) != (b & np.uint64(15))).sum(axis=1)
    assert [r.d for r in df.select("k", lsh.differing(F.col("x"), F.col("y")).alias("d")).orderBy("k").collect()] == want.tolist()


def test_components_equal_union_find(spark):
    from tessera.llm.graph import components

    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(1000, 1200)] + [(2000, 2100 - k) for k in range(100)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    named = {}
    for r in got:
        named.setdefault(r.root, set()).add(r.node)
    want = {}
    for x in root:
        want.setdefault(find(x), set()).add(x)
    assert sorted(map(sorted, named.values())) == sorted(map(sorted, want.values())) and all(k in v for k, v in named.items())


def test_line_blocks_equal_exact_similarity():
    rng = np.random.default_rng(2)
    lines = ["".join(rng.choice(list("abcd "), int(rng.integers(1, 60)))) for _ in range(60)]
    lines += [x[: int(rng.integers(1, len(x) + 1))] + "q" * int(rng.integers(0, 3)) for x in lines]
    sets = [line_dedup._line_shingles(x) for x in lines]
    got = line_dedup._close(0.8, width=16)(sets, sets)
    want = np.array([[len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)) for y in sets] for x in sets])
    assert (got == want).all()


def test_op3_picks_all_repeated_lines_and_shared_keys(spark):
    import collections
    import random

    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    unique = [" ".join(word() for _ in range(12)) for _ in range(400)]
    near = [unique[k] + " end" for k in range(0, 60, 2)]
    texts = ["\n".join(unique[k : k + 4]) for k in range(0, 400, 4)] + near + unique[100:140:2] + [unique[200] + "\n" + unique[200], "", None]
    given = line_dedup._given(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7))
    picked = rows(line_dedup._picked(given))
    lines = [x for t in texts for x in (t or "").split("\n") if x]
    assert sum(r["node"] for r in picked if r["line"] < 0) == len(lines) and sum(r["line"] < 0 for r in picked) == len(texts)
    distinct = sorted(set(lines))
    keys = collections.defaultdict(set)
    for x, own in zip(distinct, line_dedup.band_keys(line_dedup.signatures(distinct)).tolist(), strict=True):
        for key in own:
            keys[key].add(line_dedup.line_hash(x))
    want = {(node, key) for key, nodes in keys.items() if len(nodes) > 1 for node in nodes}
    assert len(want) > 100 and want <= {(r["node"], key) for r in picked for key in r["keys"]}
    assert all(len(r["sketch"]) == (4 if r["keys"] else 0) for r in picked)
    counts, own = collections.Counter(map(line_dedup.line_hash, lines)), collections.Counter(r["node"] for r in picked if r["line"] >= 0)
    assert all(own[node] == n for node, n in counts.items() if n > 1)
    assert sum(node not in {x for x, _ in want} and counts[node] == 1 for node in own) < 10


def test_op3_keys_of_lines_alike_in_half_their_hash_are_shared(spark):
    rng = np.random.default_rng(4)
    keys = rng.integers(-(1 << 63), (1 << 63) - 1, (400, line_dedup.BANDS))
    keys[200:300] = keys[:100]
    nodes = rng.integers(-(1 << 63), (1 << 63) - 1, 400)
    nodes[200:300] = nodes[:100] ^ (1 << 35)  # another line, the lower half of the hash alike
    nodes[300:] = nodes[100:200]  # the same lines again, keys alike
    keys[300:] = keys[100:200]
    signed = [np.concatenate([k, np.zeros(4, np.int64)]).tobytes() for k in keys]
    lines = spark.createDataFrame(list(zip(nodes.tolist(), signed, strict=True)), "node long, signed binary").selectExpr("0 AS line", "*").repartition(3)
    shared, again = line_dedup._repeats(lines, 64)
    assert line_dedup._repeated(shared, keys[:100].ravel(), 64).all() and line_dedup._repeated(shared, keys[100:200].ravel(), 64).sum() < 5
    assert line_dedup._repeated(again, nodes[100:200], 64).all() and line_dedup._repeated(again, nodes[:100], 64).sum() < 5


def test_op3_leaves_no_shuffle_of_its_keys(spark):
    def shuffled():
        files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().iterator()
        found = set()
        while files.hasNext():
            found.add(files.next().getName())
        return {x for x in found if x.startswith("shuffle_")}

    docs = spark.createDataFrame([(k, f"line {k} of a text, one of its own\nand one of {k % 20}") for k in range(200)], "doc_id long, text string")
    lines = common.cut(line_dedup._given(docs).mapInArrow(line_dedup._sign, line_dedup._LINES))
    before = shuffled()
    assert line_dedup._repeats(lines, 16).any() and line_dedup._marks(lines.select("node")).any()
    until = time.monotonic() + 10  # files go in the background
    while shuffled() - before and time.monotonic() < until:
        time.sleep(0.1)
    assert not shuffled() - before


def test_marks_miss_no_number(spark):
    numbers = [0, -1, -(1 << 63), (1 << 63) - 1, *np.random.default_rng(8).integers(-(1 << 63), (1 << 63) - 1, 3000).tolist()]
    table = line_dedup._marks(spark.createDataFrame([(x,) for x in numbers], "node long"))
    assert line_dedup._marked(table, np.array(numbers)).all()
    assert line_dedup._marked(table, np.random.default_rng(9).integers(-(1 << 63), (1 << 63) - 1, 100_000)).sum() < 20


def test_op1_bounded_sampling_equals_plain():
    rng = np.random.default_rng(5)
    sampler = near_dedup.Sampler(60)
    for n in (1, 199, 200, 1000, 5000):
        hashes = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        counts = np.where(rng.random(len(hashes)) < 0.05, 3, 1)
        weights = ((1 + near_dedup.IDF_SHARE * rng.random(len(hashes))) * counts).astype(np.float32)
        _, _, value = sampler._plain(hashes, np.log(weights))
        assert (sampler.sample(hashes, weights) == value).all()


def _line_roots(lines, width):
    """Brute force: the components of lines by Jaccard similarity of at least 0.8."""
    sets = [{x[k : k + width] for k in range(max(1, len(x) - width + 1))} if len(x) >= width else {x} for x in lines]
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    size = np.array([len(s) for s in sets])
    for a in range(len(lines)):
        for b in np.flatnonzero((size[:a] >= 0.8 * size[a]) & (0.8 * size[:a] <= size[a])).tolist():
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (size[a] + size[b] - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(k) for k in range(len(lines))]


def test_op3_short_edits_in_ordinary_lines(spark):
    """One letter or one word changed in lines of 40 to 120 characters: what brute force drops is dropped. The banding
    finds a pair at similarity 0.8 with a chance of 0.99, so a line or two of the 82 may stay; no other line is dropped."""
    rng = np.random.default_rng(9)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    lines = []
    for n in range(40, 121, 2):
        w = [word(int(rng.integers(2, 8))) for _ in range(n // 4)]
        line = " ".join(w)[:n].strip()
        at = len(line) // 2
        lines += [line, line[:at] + "#" + line[at + 1 :]]
        own = line.split()
        own[len(own) // 2] = word(len(own[len(own) // 2])).upper()
        lines.append(" ".join(own))
    root = _line_roots(lines, line_dedup.SHINGLE)
    want = {k: root[k] != k for k in range(len(lines))}
    assert sum(want[k] for k in range(1, len(lines), 3)) >= 34 and sum(want[k] for k in range(2, len(lines), 3)) >= 15
    got = rows(line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")))
    of = {r["doc_id"]: r["n_dropped"] == 1 for r in got}
    assert not [k for k in of if of[k] and not want[k]] and sum(want[k] and not of[k] for k in of) <= 2


def test_op3_whole_query_equals_brute_force(spark):
    """All documents of sf0.001, with their rows dealt by a shuffle into small partitions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    place, distinct = [], {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        for k, line in enumerate((r.text or "").split("\n")):
            if line.strip():
                place.append((r.doc_id, k, distinct.setdefault(line.strip(), len(distinct))))
    root = _line_roots(list(distinct), line_dedup.SHINGLE)
    first, want = {}, {r.doc_id: [] for r in docs.collect()}
    for doc, k, node in place:
        if first.setdefault(root[node], (doc, k)) != (doc, k):
            want[doc].append(k)
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8k")
    try:
        dealt = docs.groupBy("doc_id").agg({"text": "first"}).withColumnRenamed("first(text)", "text")
        got = {r["doc_id"]: r for r in rows(line_dedup.dedup_lines(dealt))}
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert sum(r["n_lines"] for r in got.values()) == len(place)
    assert not [k for k in want if set(got[k]["dropped"]) - set(want[k])]
    assert sum(len(set(want[k]) - set(got[k]["dropped"])) for k in want) <= 0.01 * sum(map(len, want.values())) + 1


def test_op8_windows_that_share_forty_hash_bits(spark):
    """Two different windows whose hashes agree in 40 bits, by turns: each still counts as repeated."""
    from pyspark.sql import functions as F

    made = spark.range(4_000_000).select(F.shiftright(F.xxhash64(F.lit("a"), F.lit("b"), F.concat(F.lit("w"), "id")), 24).alias("h"), "id")
    x, y = made.groupBy("h").agg(F.sort_array(F.collect_list("id")).alias("ids")).where("size(ids) > 1").orderBy("h").first().ids[:2]
    text = " ".join(f"s{k} a b w{v} t{k}" for k, v in enumerate([x, y, x, y]))
    assert rows(quality_rules.report(spark.createDataFrame([(1, text)], "doc_id long, text string")))[0]["n_repeat_words"] == 12


def test_op2_bad_documents_only(spark):
    texts = [(k, "\n".join(["WIN!!! $$$ ### NOW!!!"] * (40 + k))) for k in range(5)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert [r["kept"] for r in rows(quality_model.score(docs))] == [False] * 5 and rows(quality_model.keep(docs)) == []


def test_op2_trains_three_hundred_steps():
    rng = np.random.default_rng(4)
    x = rng.random((80, 6)).astype(np.float32)
    y, w = (x[:, 0] + 0.3 * rng.random(80) > 0.6).astype(float), np.ones(80)
    theta, m, v = np.zeros(7), np.zeros(7), np.zeros(7)
    whole = np.hstack([x, np.ones((80, 1))]).astype(float)
    for t in range(1, 301):
        p = 1 / (1 + np.exp(-np.clip(whole @ theta, -30, 30)))
        g = whole.T @ ((p - y) / 80) + quality_model.DECAY * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - quality_model.RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    got, bias = quality_model.train(x, y, w)
    assert np.allclose(np.append(got, bias), theta, atol=0.01)

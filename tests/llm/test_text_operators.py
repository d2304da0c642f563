"""Secrets, personal data, packing, decontamination, HTML and languages against plain versions and edge cases."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.llm import decontaminate, html_text, langid, packing, pii, secrets
from granary.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, ddl="doc_id long, text string"):
    return spark.createDataFrame(list(enumerate(texts)), ddl)


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def base_secrets(t):
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(ASSIGN, t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return joined(out)


def luhn(x):
    total = 0
    for i, c in enumerate(reversed(x)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_pii(t):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        x = re.sub("[^0-9]", "", m[0])
        if 14 <= len(x) <= 19 and luhn(x):
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return joined(out)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def fuzz(alphabet, n, size, seed):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(alphabet, rng.integers(0, size))) for _ in range(n)]


def test_secret_base_spans(spark):
    pieces = ["token", "=", ":", " ", '"', "abcdef12", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "é", "\x01", "Secret", "api_key", "𝒳", "password"]
    texts = fuzz(pieces, 800, 14, 1) + ["", "token=token: abcdef", "x" * 50_000]
    got = {r.doc_id: r for r in secrets.scan(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i].base_sha256 == sha(base_secrets(t)), t
        assert set(filter(None, base_secrets(t).split(","))) <= set(got[i].spans.split(","))


def window_entropy(s, w):
    best = 0.0
    for i in range(len(s) - w + 1):
        part = s[i : i + w]
        best = max(best, -sum(c / w * math.log2(c / w) for c in (part.count(x) for x in set(part))))
    return best


def test_sliding_entropy(spark):
    strings = fuzz(list("abcdefgh0123"), 60, 60, 2) + ["a" * 40, "abcdefghijklmnopqrst" * 2]
    strings = [s for s in strings if len(s) >= 20]
    rows = table(spark, strings).select("doc_id", secrets.entropy(F.col("text"), 20).alias("e")).collect()
    for r in rows:
        assert r.e == pytest.approx(window_entropy(strings[r.doc_id], 20), abs=1e-9)


def test_entropy_spans_and_allow_list(spark):
    texts = ["key 8fK2xQ9zLm4Tn7Wp3Rv6Yb1C here", "123e4567-e89b-12d3-a456-426614174000", "example8fK2xQ9zLm4Tn7Wp3Rv6", "thing" * 8 + "1", "blob " + "aB3dE5fG7h" * 20_000, None]
    got = {r.doc_id: r.spans for r in secrets.scan(table(spark, texts)).collect()}
    assert got == {0: "entropy:4:28", 1: "", 2: "", 3: "", 4: "", 5: ""}


def test_long_texts_with_many_spans(spark):
    """Spans of a long text are compared and replaced in about linear time, and as a plain version does it."""
    rng = np.random.default_rng(4)
    parts = [f"token=ab{i}cdefg" if i % 3 else "".join(rng.choice(list("abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ123456789"), 24)) for i in range(3000)]
    text = "é ".join(parts)
    row = secrets.scan(table(spark, [text])).first()
    assert row.n_assign == 2000 and row.base_sha256 == sha(base_secrets(text))
    places = sorted(tuple(map(int, s.split(":")[1:])) for s in row.spans.split(","))
    out, at = "", 0
    for a, b in places:
        out += text[at:a] + "[SECRET]"
        at = b
    assert row.n_entropy > 500 and secrets.redacted(table(spark, [text])).first().text == out + text[at:]


def test_redaction_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, 'a token = "abcdef123" b', "x"), (2, "clean", "y"), (3, None, "z")], "doc_id long, text string, __secrets_base string")
    out = secrets.redacted(docs.drop("__secrets_base").withColumn("spans", F.lit(7))).orderBy("doc_id").collect()
    assert [r.text for r in out] == ['a [SECRET]" b', "clean", None] and out[0].spans == 7
    assert secrets.redacted(docs.drop("__secrets_base").limit(0)).count() == 0


def test_pii_base_spans(spark):
    texts = fuzz(list("a1.@b%+- 2(9)_é\x01"), 1500, 60, 3) + ["", "1" * 20_000, "a." * 5_000 + "@", "4111 1111 1111 1111-", "256.1.1.1 0000.01.1.255", "+1 (886) 555-9674", "a@b.c_d@e.f"]
    got = {r.doc_id: r for r in pii.scan(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i].base_sha256 == sha(base_pii(t)), t[:80]


def revealing_corpus():
    filler = ["word%d thing%d stuff%d" % (i, i * 7, i * 11) for i in range(60)]
    other = ["apple", "brick", "cloud", "delta", "ember", "frost", "grape"]
    told = [f"{other[i]} {other[i + 1]} Zyxander writes from zyx@mail.example.com {other[-i]} {other[i]}" for i in range(6)]
    return filler + told + ["Zyxander was here alone", "unrelated text"]


def test_terms_that_reveal_entities(spark):
    texts = revealing_corpus()
    got = {r.doc_id: r for r in pii.scan(table(spark, texts)).collect()}
    for i in range(60, 66):
        t = texts[i]
        a = t.index("Zyxander")
        assert f"term:{a}:{a + 8}" in got[i].spans.split(",") and got[i].n_email == 1
    assert got[66].spans == "term:0:8" and got[67].spans == "" and got[0].spans == ""
    out = pii.redacted(table(spark, texts), pii.terms(table(spark, texts))).orderBy("doc_id").collect()
    assert "Zyxander" not in out[60].text and "[EMAIL]" in out[60].text and out[67].text == "unrelated text"


def test_copies_are_no_evidence(spark):
    texts = ["alpha beta gamma Delta me@x.example.com eta theta iota"] * 20 + ["other text %d" % i for i in range(20)]
    assert all("term" not in r.spans for r in pii.scan(table(spark, texts)).collect())
    # and term counts by brute force
    corpus = revealing_corpus()
    (row,) = [r for r in pii.terms(table(spark, corpus)).collect() if r.term == "zyxander"]
    n, ne, nt, net = len(corpus), 6, 7, 6
    assert row.disclosure == pytest.approx(math.log2(net * n / (ne * nt)) / math.log2(n / ne))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 1 << 20), st.integers(0, 12))
def test_cuts_are_powers_of_two(n, k):
    parts = packing.cuts(n, 1 << k)
    assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 1 << k for p in parts) and parts == sorted(parts, reverse=True)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    texts = ["It's a test, isn't it? <|endoftext|> ok", "a<|startoftext|>b <|ENDOFTEXT|> Hello", "", None, "ÉÀ ǰ J̌ \x01 a\x01b", "  spaced\tout\n ", "été " * 3000, "x" * 5000, "İSTANBUL ΣΑΣ"]
    pieces = packing.pack(table(spark, texts), tokenizer_path(), 256).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    for i, t in enumerate(texts):
        mine = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        ids = np.frombuffer(b"".join(bytes(p.ids) for p in mine), "<u4").tolist()
        assert ids == plain.encode(t or "", add_special_tokens=False).ids + [1]
        assert [p.start for p in mine] == [sum(q.length for q in mine[:k]) for k in range(len(mine))]
        assert all(p.length & (p.length - 1) == 0 and p.doc_tokens == len(ids) and p.offset == 0 for p in mine)
    d = packing.digests(packing.pack(table(spark, texts), tokenizer_path())).collect()
    assert all(0 <= r.ids_crc32 < 1 << 32 for r in d)
    one = packing.digests(packing.pack(table(spark, [None]), tokenizer_path())).first()
    assert one.ids_crc32 == zlib.crc32((1).to_bytes(4, "little"))
    assert packing.pack(table(spark, ["a"]).limit(0), tokenizer_path()).count() == 0


def test_ids_of_any_text_are_the_tokenizers():
    from tokenizers import Tokenizer

    plain, coder = Tokenizer.from_file(tokenizer_path()), packing.WordIds(tokenizer_path())
    assert coder.quick is not None
    rng = np.random.default_rng(5)
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|end", "oftext|>", "hello", " ", "  ", "World", "'s", "don't", "\u00e9", "e\u0301", "A\u0300B", "\u00df", "\u4e2d\u6587", "\u00a0", "\u3000", "123", "x1", "...", "\n", "\t", "\x01", "\x00", "\u0130", "\U0001d4b3", "<b>"]
    texts = ["".join(rng.choice(pieces, rng.integers(0, 14))) for _ in range(4000)]
    for a in range(0, len(texts), 200):
        ids, sizes = coder.encode([t.encode() for t in texts[a : a + 200]])
        ends = np.cumsum(sizes)
        for t, b, n in zip(texts[a : a + 200], ends, sizes):
            assert ids[b - n : b].tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(t, items, n):
    w, hit, found = words(t), set(), set()
    for item, x in items:
        x = words(x)
        size = min(n, len(x))
        for i in range(len(x) - size + 1) if x else ():
            for j in range(len(w) - size + 1):
                if w[j : j + size] == x[i : i + size]:
                    hit |= set(range(j, j + size))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("max_windows", [1_000_000, 7])
def test_decontamination_by_brute_force(spark, max_windows):
    rng = np.random.default_rng(5)
    vocab = ["a", "b", "C", "dé", "e1", "f-g", "h", "i", "j", "k"]
    items = [(i, " ".join(rng.choice(vocab, rng.integers(0, 9)))) for i in range(12)] + [(50, None), (51, "..."), (3, "a b")]
    texts = [" ".join(rng.choice(vocab, rng.integers(0, 60))) for _ in range(60)] + ["", None, "A, b; C"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.scan(table(spark, texts), bench, 4, max_windows).collect()}
    usable = [(i, x) for i, x in items if x is not None]
    for i, t in enumerate(texts):
        n, hit, found = brute(t, usable, 4)
        assert (got[i].n_words, sum(h.end - h.start for h in got[i].hits), got[i]["items"]) == (n, hit, found)


def test_one_large_item_is_dealt_into_blocks(spark):
    """Items of one text, and an item of many windows, keep the bound of a block."""
    rng = np.random.default_rng(6)
    long = [f"w{x}" for x in rng.integers(0, 40, 700)]
    bench = spark.createDataFrame([(1, " ".join(long))] + [(i, "same text of five words") for i in range(2, 40)], "item_id long, text string")
    found = list(decontaminate.blocks(bench, 3, 50, "item_id", "text"))
    sizes = [sum(len(rows) for _, _, _, rows, _ in b.value.by_size) for b in found]
    assert len(found) > 10 and max(sizes) <= 50
    texts = [" ".join(long[k : k + 5]) for k in range(0, 690, 7)] + ["x same text of five words y", "five of text"]
    got = {r.doc_id: r for r in decontaminate.scan(table(spark, texts), bench, 3, 50).collect()}
    for i, t in enumerate(texts):
        n, hit, items = brute(t, [(1, " ".join(long))] + [(i, "same text of five words") for i in range(2, 40)], 3)
        assert (got[i].n_words, sum(h.end - h.start for h in got[i].hits), got[i]["items"]) == (n, hit, items)


def test_cleaning_cuts_passages_only(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    rows = [(1, f"before it. {passage.upper()}! after " + "more words " * 20, "en"), (2, "clean text stays", "en"), (3, passage, "en"), (4, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in decontaminate.cleaned(docs, bench).collect()}
    assert set(out) == {1, 2, 4} and out[1].text.startswith("before it. \n! after") and out[2].text == "clean text stays" and out[4].text is None
    assert decontaminate.contamination(decontaminate.cleaned(docs, bench), bench).where("contaminated").count() == 0
    assert decontaminate.cleaned(docs, bench.limit(0)).count() == 4


HTML = [
    ("<p>One\n two<p>three <b>bold</b>text<br>next", "One two\n\nthree boldtext\nnext"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><ol start=3><li>x<li>y</ol>", "- a\n- b\n  - c\n- d\n\n3. x\n4. y"),
    ("<table><tr><th>Name<th>N<tr><td>alpha<td>1<tr><td>b<td>22222</table>", "Name  | N\nalpha | 1\nb     | 22222"),
    ("<table><tr><td colspan=2>ab<td>c<tr><td>d<td>e<td>f</table>", "ab |   | c\nd  | e | f"),
    ("<head><title>t</title><style>x</style></head>a<script>b</script><div hidden>c</div><i style='display:none'>d</i><!-- e -->f", "af"),
    ("<style>.ad, p#x{color:red;display:none} /* .b{display:none} */</style>a<div class='b ad'>c</div><p id=x>d</p><p class=b>e", "a\n\ne"),
    ("<svg><title>t</title><text>shown</text></svg><math><mi>y</mi></math>", "showny"),
    ("<details><summary>s</summary>no</details><details open>yes</details>", "s\nyes"),
    ("<pre> a\n  b</pre>&amp;&lt;", " a\n  b\n\n&<".lstrip("\n")),
    ("a < b & c <unclosed", "a < b & c <unclosed"),
    ("<div><p>x</div>y<h1>t</h1>z", "x\n\ny\n\nt\n\nz"),
    ("", ""),
]


@pytest.mark.parametrize("html, text", HTML)
def test_html_layout(html, text):
    assert html_text.visible_text(html) == text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "<b>", "<div hidden>", "</div>", "word", " ", "<!--", "-->", "<script>", "</script>", '<a "', ">", "&amp;", "<pre>", "\n"]), max_size=60))
def test_broken_html_never_fails(parts):
    html_text.visible_text("".join(parts))


def test_html_hard_cases(spark):
    for h in ("<div>" * 20_000 + "deep", "<table><tr><td>" * 300 + "deep", "<ul><li>" * 2_000 + "deep"):
        assert html_text.visible_text(h).endswith("deep")
    pages = spark.createDataFrame([(1, None), (2, "<p>a"), (2, "<p>a"), (None, "b")], "page_id long, html string")
    pages = pages.withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    assert sorted((r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [("", 0), ("a", 1), ("a", 1), ("b", 1)]
    assert html_text.extract(pages.limit(0)).count() == 0


def chain_posteriors(emit, move):
    f, out = np.exp(emit[0]), []
    ahead = [f / f.sum()]
    for t in range(1, len(emit)):
        f = ahead[-1] @ np.exp(move) * np.exp(emit[t])
        ahead.append(f / f.sum())
    back = [np.ones(emit.shape[1])]
    for t in range(len(emit) - 1, 0, -1):
        b = np.exp(move) @ (np.exp(emit[t]) * back[-1])
        back.append(b / b.sum())
    for a, b in zip(ahead, back[::-1]):
        out.append(a * b / (a * b).sum())
    return np.array(out)


def test_forward_backward():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 0, 130, 64, 65, 240, 3])
    emit, move = rng.normal(size=(lengths.sum(), 3)) * 2, rng.normal(size=(3, 3))
    got, at = langid.posteriors(emit, move, lengths), 0
    for n in lengths:
        if n:
            assert np.abs(got[at : at + n] - chain_posteriors(emit[at : at + n], move)).max() < 1e-9
        at += n


def test_posteriors_by_enumeration(monkeypatch):
    from itertools import product

    rng = np.random.default_rng(3)
    emit, move = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    weight = {p: math.exp(sum(emit[t, p[t]] for t in range(5)) + sum(move[p[t], p[t + 1]] for t in range(4))) for p in product(range(3), repeat=5)}
    z = sum(weight.values())
    e = langid.scaled(emit)
    ahead, back = langid.both_ways(e, np.arange(5), np.array([5]), move, 2)
    pairs = langid.pair_posteriors(e, ahead, back, move, np.arange(1, 5))
    for t in range(5):
        for i in range(3):
            assert (ahead[t] * back[t] / (ahead[t] @ back[t]))[i] == pytest.approx(sum(w for p, w in weight.items() if p[t] == i) / z)
            for j in range(3):
                assert t == 4 or pairs[t, i, j] == pytest.approx(sum(w for p, w in weight.items() if (p[t], p[t + 1]) == (i, j)) / z)
    # little room: blocks grow and groups of blocks follow each other
    monkeypatch.setattr(langid, "ROOM", 300)
    lengths = np.array([500, 0, 3, 170])
    emit = rng.normal(size=(673, 3))
    want = np.concatenate([chain_posteriors(emit[:500], move), chain_posteriors(emit[500:503], move), chain_posteriors(emit[503:], move)])
    assert np.abs(langid.posteriors(emit, move, lengths) - want).max() < 1e-9
    mean = langid.means(langid.scaled(emit), np.arange(673), lengths, move)
    assert np.abs(mean - np.array([want[:500].mean(axis=0), np.zeros(3), want[500:503].mean(axis=0), want[503:].mean(axis=0)])).max() < 1e-9


def test_many_languages_and_words_without_spaces(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(70 * 6):
        syllables = [chr(0x4E00 + 40 * (i % 70) + k) for k in range(20)]
        rows.append((i, " ".join("".join(rng.choice(syllables, 4)) for _ in range(12)), f"l{i % 70:02d}"))
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 70
    run = lambda k, n: "".join(rng.choice([chr(0x4E00 + 40 * k + j) for j in range(20)], n))
    texts = [run(3, 20) + run(9, 4960) + run(3, 20), run(69, 5000), run(5, 41)]
    out = {r.doc_id: r.lang_pred for r in langid.identify(table(spark, texts), model).collect()}
    assert out == {0: "l09", 1: "l69", 2: "l05"}
    assert langid.spaced(("a" * 85 + " b").encode()).split() == [b"a" * 40, b"a" * 40, b"a" * 5, b"b"]


def test_languages_held_out(spark):
    rng = np.random.default_rng(1)
    pools = {"aa": ["tha", "ing", "wer", "and"], "bb": ["ción", "que", "ar", "los"], "cc": ["üng", "sch", "keit", "der"]}
    rows = []
    for i in range(240):
        lang = list(pools)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(pools[lang], rng.integers(1, 4))) for _ in range(30)), lang))
    rows += [(900, None, "aa"), (901, "123 !!", "bb"), (902, "", None), (903, "que los", None), (None, "tha ing", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in langid.languages(docs).collect()}
    known = {i: lang for i, _, lang in rows if i is not None and i < 900}
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in known)
    right = [out[i].lang_pred == known[i] for i in known if out[i].held_out]
    assert np.mean(right) > 0.97
    assert all((out[i].lang_pred, out[i].score) == ("und", 0.0) for i in (900, 901, 902)) and out[903].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in out.values())
    none = langid.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert langid.accepted(docs, langid.train(docs), 0.4).where("doc_id IN (900, 901, 902)").count() == 0
    # code-switched text: words get their own language
    model = langid.train(docs)
    known = langid.Emissions(model)
    (numbers,) = known.of(["thaing weran inging, ciónque losar arque".encode()])
    post = langid.posteriors(np.log(known.rows[numbers]), model.move, np.array([6]))
    assert [model.langs[k] for k in post.argmax(axis=1)] == ["aa"] * 3 + ["bb"] * 3


def test_spans_by_sql(spark):
    """The method's spans too, against the plain patterns and windows in SQL."""
    import duckdb
    import pandas as pd

    from granary.llm import sql

    pieces = ["token", "=", "a1B2", "c3D4e5F6", "g7H8i9J0", "kLmN", "deadbeef01", "1.", "2", "@", "x.y", "+1 555 ", "444", "é", " ", "example", '"']
    rows = list(enumerate(revealing_corpus() + fuzz(pieces, 500, 14, 3) + ["AKIA" + "A1B2" * 5])) + [(5000, None), (7, "dup 8fK2xQ9zLm4Tn7Wp3Rv6Yb1C"), (7, "dup 8fK2xQ9zLm4Tn7Wp3Rv6Yb1C")]
    docs, con = spark.createDataFrame(rows, "doc_id long, text string"), duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    for df, text in ((secrets.scan(docs), sql.secrets_sql()), (pii.scan(docs), sql.pii_sql())):
        cur = con.execute(text)
        columns = [d[0] for d in cur.description]
        assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(cur.fetchall(), key=str)
    assert secrets.scan(docs).where("n_entropy > 0").count() > 10 and pii.scan(docs).where("n_term > 0").count() > 5


@pytest.mark.parametrize("html, text", [
    ("<table><tr><form><td>Name</td><td>x</td></form></tr></table>", "Name | x"),
    ("<table><tr><table><tr><td>in</td><td>b</td></tr></table></tr></table>", "in | b"),
    ("<table><tr><div>text</div><td>x</td></tr></table>", "text\nx"),
    ("<table><tr><a href=q>link</a><td>x</td></tr></table>", "link\nx"),
    ("<table><tr><center>mid</center></tr></table>", "mid"),
    ("<table><tr><form><input type=submit value=Go><td>x</td></form></tr></table>", "Go\nx"),
    ("<table><tr><div hidden>no</div><td>a</td><td>b</td></tr></table>", "a | b"),
])
def test_html_rows_keep_all_text(html, text):
    assert html_text.visible_text(html) == text


@pytest.mark.parametrize("html, text", [
    ("<style>@media print{.np{display:none}}</style><p class=np>shown on screen</p>", "shown on screen"),
    ("<style>@media print, screen and (min-width: 600px){.np{display:none}}</style><p class=np>no</p>b", "b"),
    ("<style>@media (max-width:600px){.np{display:none} .q{display:none}} .r{display:none}</style><p class=np>a</p><p class=q>b</p><p class=r>c", "a\n\nb"),
    ("<style>@media not print{.np{display:none}}</style><i class=np>no</i>yes", "yes"),
    ("<style>@media (prefers-color-scheme: dark){p{display:none}} @font-face{src:x} @import 'y'; @supports (display:grid){i{display:none}}</style><p>a<i>b</i>", "a"),
    ("<style media=print>p{display:none}</style><p>a", "a"),
    ("<style>.a{display:none} .a{display:block}</style><p class=a>again", "again"),
    ("<style>.a{display:none !important} .a{display:block}</style><p class=a>no</p>b", "b"),
    ("<style>#x{display:block} p{display:none}</style><p id=x>by id</p><p>no", "by id"),
    ("<style>p.a.b{display:none}</style><p class='a'>one</p><p class='b a'>two", "one"),
    ("<style>div p{display:none} p:hover{display:none}</style><p>kept", "kept"),
    ("<p hidden style='display:block'>by style</p><p style='display:none;display:inline'>last", "by style\n\nlast"),
    ("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>", "yes"),
    ("<style>.v{visibility:hidden} .w{visibility:visible}</style><table class=v><tr><td>no</td><td class=w>yes</td></tr></table>", " | yes"),
    ("<table><tr><td>a<br>b</td><td>c</td></tr><tr><td>dd</td><td>e</td></tr></table>", "a  | c\nb  |\ndd | e"),
    ("<table><tr><td>x</td><td><p>one</p><p>two</p></td></tr><tr><td colspan=2>wide</td></tr></table>", "x    | one\n     | two\nwide |"),
    ("<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr><tr><td>d</td><td>e</td></tr></table>", "a | b\n  | c\nd | e"),
    ("<table><tr><td colspan=150>a</td><td>z</td></tr><tr><td>b</td><td>c</td></tr></table>", "a |   | z\nb | c |"),
    ("<table><tr><td><table><tr><td>in</td><td>b</td></tr></table></td><td>side</td></tr><tr><td>p</td><td>q</td></tr></table>", "in | b\nside\np | q"),
])
def test_html_styles_and_cells(html, text):
    assert html_text.visible_text(html) == text


class Plain:
    """A second renderer: makes a random document, its markup and, by itself, the text that is to come out."""

    def __init__(self, seed):
        self.rng = np.random.default_rng(seed)

    def pick(self, n):
        return int(self.rng.integers(0, n))

    def tag(self, name, attrs=""):
        return f"<{name.upper() if self.pick(4) == 0 else name}{attrs}{[' ', '', chr(10)][self.pick(3)]}>"

    def inline(self):
        html, text = [], []
        for _ in range(self.pick(6)):
            word = ["word", "caf\u00e9", "x&y", "a<b", "\u4e2d"][self.pick(5)]
            gap = [" ", "  \n", ""][self.pick(3)]
            coded = word.replace("&", "&amp;").replace("<", "&lt;").replace("\u00e9", "&eacute;")
            kind = self.pick(6)
            if kind == 0:
                coded = f"{self.tag('b')}{coded}</b>"
            elif kind == 1:
                coded += "<span class=h>gone</span><!-- note -->"
            elif kind == 2:
                coded += "<script>if (a<b) c('</p>')</script>"
            html.append(coded + gap)
            text.append(word + gap)
        return "".join(html), " ".join("".join(text).split())

    def end(self, name):
        return "" if self.pick(3) == 0 else f"</{name}>"

    def blocks(self, depth, lists=0):
        """(markup, entries): entries are gaps (numbers) and lines."""
        html, out = [], []
        for _ in range(1 + self.pick(3)):
            kind = self.pick(7 if depth else 3)
            inner, text = self.inline()
            if kind == 0:
                html.append(f"{self.tag('p')}{inner}{self.end('p')}")
                out += [2, *([text] if text else []), 2]
            elif kind == 1:
                html.append(f"{self.tag('h2')}{inner}</h2>")
                out += [2, *([text] if text else []), 2]
            elif kind == 2:
                html.append(f"<div{[' hidden', ' class=h', ' style=' + chr(34) + 'display: none' + chr(34)][self.pick(3)]}>{inner}</div>")
            elif kind == 3:
                below, entries = self.blocks(depth - 1, lists)
                html.append(f"{self.tag('div')}{below}</div>")
                out += [1, *entries, 1]
            elif kind in (4, 5):
                name, items = ("ul", "ol")[kind - 4], []
                gap = 1 if lists else 2
                out.append(gap)
                for k in range(1 + self.pick(3)):
                    inner, text = self.inline()
                    below, entries = self.blocks(depth - 1, lists + 1) if self.pick(3) == 0 and text else ("", [])
                    items.append(f"{self.tag('li')}{inner}{below}{self.end('li') if not below else '</li>'}")
                    marker = "- " if name == "ul" else f"{k + 1}. "
                    if text:
                        out += [1, marker + text, *([1] if below and entries else []), *(e if isinstance(e, int) else " " * len(marker) + e for e in entries), 1]
                    else:
                        out += [1, 1]
                html.append(f"{self.tag(name)}{''.join(items)}</{name}>")
                out.append(gap)
            else:
                n, m = 1 + self.pick(3), 1 + self.pick(3)
                cells = [[[self.inline() for _ in range(1 + self.pick(2))] for _ in range(m)] for _ in range(n)]
                cells = [[[(h, t) for h, t in c if t] or [("x", "x")] for c in row] for row in cells]
                html.append("<table>" + "".join("<tr>" + "".join(f"{self.tag('td')}{'<br>'.join(h for h, _ in c)}{self.end('td')}" for c in row) + self.end("tr") for row in cells) + "</table>")
                wide = [max(len(t) for row in cells for _, t in row[j]) for j in range(m)]
                out.append(2)
                for row in cells:
                    for i in range(max(map(len, row))):
                        out.append(" | ".join((c[i][1] if i < len(c) else "").ljust(wide[j]) for j, c in enumerate(row)).rstrip())
                        out.append(1)
                out.append(2)
        return "".join(html), out

    def document(self):
        html, entries = self.blocks(3)
        text, gap = "", 0
        for e in entries:
            if isinstance(e, int):
                gap = max(gap, e)
            else:
                text += ("\n" * gap if text else "") + e
                gap = 0
        return "<html><head><title>t</title><style>.h{display:none}</style></head><body>" + html, text


def test_html_by_a_second_renderer():
    for seed in range(3000):
        html, text = Plain(seed).document()
        assert html_text.visible_text(html) == text, (seed, html)

"""Byte-level BPE, HTML extraction, chat formatting, PII and language ID against brute force on small tables."""

import base64
import hashlib
import random
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from spindlewatch.llm import byte_bpe, chat_format, html_extract, langid, pii
from spindlewatch.llm import queries as llm_queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
LONG = "Ärger im Café: it's 3 o'clock. " * 9000 + "\n\n  \t" * 50 + "x" * 70_000 + " end"


@pytest.fixture(scope="module")
def plain():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def docs(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id bigint, text string" + more)


# byte-level BPE


def test_pieces_are_encoded_like_the_whole(plain):
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["a", "B", "é", " ", "  ", "\n", "'s", "7", "!", "　", " ́", "zz "]) for _ in range(300))
        cut = byte_bpe.pieces(text, 17)
        assert "".join(cut) == text
        assert byte_bpe.encode(plain, text, 17) == plain.encode_ordinary(text)


def test_bpe_digests(spark, plain):
    rows = [(1, None), (2, ""), (3, LONG), (4, "a b"), (4, "a b"), (None, "<|endoftext|> \x00 €")]
    out = byte_bpe.digests(docs(spark, [(*r, "x") for r in rows], ", n_tokens string"), RANKS, PATTERN).collect()
    assert len(out) == len(rows)
    want = []
    for i, t in rows:
        ids = plain.encode_ordinary(t or "")
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)
    assert byte_bpe.digests(docs(spark, []), RANKS, PATTERN).count() == 0


def test_bpe_columns_round_trip(spark):
    df = docs(spark, [(1, "héllo  wörld"), (2, None)])
    back = byte_bpe.decode_column(byte_bpe.encode_column(df, RANKS, PATTERN), RANKS, PATTERN).orderBy("doc_id").collect()
    assert [bytes(r["decoded"]).decode() for r in back] == ["héllo  wörld", ""]


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T one</title><script>if (a < b) document.write("<p>no</p>")</script></head><body>
<header class="top"><p>Site name and slogan here</p></header><nav><ul><li><a href="/a">Menu one</a></li><li><a href='/b'>Menu two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site to do many things for you.</p></div>{open}<h1>The &amp; title</h1>
<p>First   paragraph with <b>bold</b> words,<br>a break &lt;tag&gt; and caf&eacute;.<p>Second paragraph, left open, goes on for some words.
<aside><p>Read also these other stories about something else entirely.</p></aside>
<form><label>Mail</label><input name=q><button>Subscribe now</button></form>
<ul><li>item one of the list</li><li>item two of the list</li></ul><table><tr><td>cell a</td><td>cell b</td></tr></table>
<div id="comments"><p>I, a reader, liked this article very much indeed.</p></div>{close}
<div class="ad">Buy things now, cheap things, many of them!</div><footer>&copy; Site, all rights reserved</footer></body></html>"""
TEXT = "The & title\nFirst paragraph with bold words, a break <tag> and café.\nSecond paragraph, left open, goes on for some words.\nitem one of the list\nitem two of the list\ncell a\ncell b"


def test_html_article(spark):
    rows = [(1, "u", PAGE.format(open="<article>", close="</article>")), (2, "u", PAGE.format(open="<main>", close="</main>"))]
    rows += [(3, None, None), (4, "u", ""), (5, "u", "<nav>only menu</nav>"), (6, "u", "<article><p>cut off & unfinished"), (1, "u", rows[0][2])]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id bigint, url string, html string, text string")
    out = html_extract.extract_pages(df).collect()
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in out)
    texts = {1: TEXT, 2: TEXT, 3: "", 4: "", 5: "", 6: "cut off & unfinished"}
    assert got == sorted((i, texts[i], len(texts[i])) for i, _, _ in rows)
    assert html_extract.extract_pages(df.filter("page_id > 9")).count() == 0


def test_html_without_named_article_uses_learnt_weights(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    weights = html_extract.fit(html_extract.label_counts(pages))
    assert all(w < 0 for k, w in weights.items() if k.startswith("t:"))
    for r in pages.limit(40).collect():
        bare = re.sub("<(/?)article>", r"<\1div>", r["html"])
        assert html_extract.extract(bare, weights) == html_extract.extract(r["html"], weights)


STORY = "<p>The story goes on for a good many words in this paragraph.</p><p>And it has a second one that is about as long.</p>"
STORY_TEXT = "The story goes on for a good many words in this paragraph.\nAnd it has a second one that is about as long."


def test_articles_that_are_cards_or_comments():
    cards = "".join(f'<article><h3><a href="/{i}">Teaser {i}</a></h3><p>Read more of it</p></article>' for i in range(4))
    said = '<article class="comment"><p>I, a reader, liked this very much indeed, and write so.</p></article>'
    for page in (f"<div>{STORY}</div><div>{cards}</div>", f"<div>{STORY}</div>{said}", f"<article>{STORY}</article>{said * 9}"):
        assert html_extract.extract(f"<body>{page}</body>", {}) == STORY_TEXT


def test_listed_words_do_not_veto_what_holds_the_article():
    for name in ("content has-sidebar", "no-sidebar", "page-with-header", "header-fixed", "side-by-side", "sidebar"):
        assert html_extract.extract(f'<body><div class="{name}"><article>{STORY}</article></div></body>', {}) == STORY_TEXT
        if name != "sidebar":
            assert html_extract.extract(f'<body><div class="{name}">{STORY}</div></body>', {}) == STORY_TEXT
    for name in ("discussion", "related-work", "search", "form", "social-science"):
        page = f'<article>{STORY}<h2 id="{name}">Next</h2><section id="{name}"><p>More of it.</p></section></article>'
        assert html_extract.extract(page, {}) == STORY_TEXT + "\nNext\nMore of it."
    aside = '<div class="sidebar"><article><p>A teaser in the side bar of some more words.</p></article></div>'
    assert html_extract.extract(f"<main>{STORY}</main>{aside}", {}) == STORY_TEXT
    assert html_extract.extract(f"<div>{STORY}</div>{aside}", {}) == STORY_TEXT


def test_best_region_is_the_maximum():
    rng = random.Random(2)
    for _ in range(300):
        scores = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        a, b = html_extract.best_region(scores)
        most = max([sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)], default=0)
        assert sum(scores[a:b]) == max(0, most)


def test_hostile_html():
    for page in ("<", "<<<>>><p", "<!-- open", "<script>never closed", "</p></div>", "<p a='\">x", "<a" * 5000, "<div>" * 3000 + "deep"):
        assert isinstance(html_extract.extract(page, {}), str)


# chat

MESSAGES = "tree_id bigint, node_id bigint, parent_id bigint, role string, text string, score double"


def brute_paths(rows):
    """Every root-to-leaf path by recursion."""
    trees = {}
    for t, n, p, role, text, score in rows:
        trees.setdefault(t, {})[n] = (p, role or "", text or "", score or 0.0)
    out = []
    for t, nodes in trees.items():
        parents = {v[0] for v in nodes.values()}
        for leaf in (n for n in nodes if n not in parents):
            path, at = [], leaf
            while at is not None and at in nodes:
                path.append(at)
                at = nodes[at][0]
            out.append((t, leaf, sum(nodes[n][3] for n in path), [nodes[n][1:3] for n in reversed(path)]))
    return out


def test_trees_and_branches(spark):
    rng = random.Random(4)
    rows = []
    for t in (None, 1, 2, 3):
        for n in range(rng.randint(1, 30)):
            parent = rng.choice([None, *range(n)]) if n else None
            rows.append((t, n, parent, rng.choice(["user", "assistant", None, "a\n<|im_end|>"]), rng.choice([None, "", "<|im_end|>", "<\\|x|", "hi\nthere"]), rng.choice([None, 0.5, -1.0, 2.0])))
    rows += [(9, 1, 77, "user", "orphan", 1.0), (8, 1, 2, "user", "ring", 0.0), (8, 2, 1, "user", "ring", 0.0)]
    out = chat_format.read_back(chat_format.format_trees(spark.createDataFrame(rows, MESSAGES), None)).collect()
    want = {(t, leaf): (score, path) for t, leaf, score, path in brute_paths([r for r in rows if r[0] != 8])}
    assert {(r["tree"], r["leaf"]) for r in out} == set(want)
    for r in out:
        score, path = want[r["tree"], r["leaf"]]
        assert abs(r["branch_score"] - score) < 1e-9
        assert [tuple(x) for x in r["turns"]] == path
        assert r["loss_text"] == "".join(text for role, text in path if role == "assistant")
    best = chat_format.branches(spark.createDataFrame(rows, MESSAGES), 1).select("tree", "leaf").distinct().collect()
    for r in best:
        assert r["leaf"] == min((-s, leaf) for (t, leaf), (s, _) in want.items() if t == r["tree"])[1]


def test_chat_query_on_odd_rows(spark, tmp_path):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "<|im_start|>x<|im_end|>\n"), (2, 5, "assistant", "é🙂"), (2, 5, "assistant", "é🙂"), (None, 0, "system", ""), (3, None, None, "t")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, tree int")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in llm_queries.op6_chat(spark, str(tmp_path)).collect()}
    said = "<|im_end|><|im_start|>assistant ok"
    turns = {1: [("user", ""), ("assistant", rows[1][3])], 2: [("assistant", "é🙂")] * 2, None: [("system", "")], 3: [("", "t")], -1: [("user", said), ("assistant", said)]}
    assert set(got) == set(turns)
    for i, t in turns.items():
        loss = "".join(x for role, x in t if role == "assistant")
        assert got[i]["n_turns"] == len(t)
        assert got[i]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest()
        assert (got[i]["loss_chars"], got[i]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    empty = df.limit(0).select("conv_id", "turn", "role", "text")
    assert chat_format.format_trees(chat_format.as_trees(empty)).count() == 0


# PII


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def bare(value):
    return re.sub("[^0-9]", "", value)


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(bare(v)) <= 19 and luhn(bare(v))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(bare(v)) <= 15),
]


def brute_spans(text):
    found = []
    for i, (kind, pattern, ok) in enumerate(BASE):
        found += [(m.start(), i, kind, m.end()) for m in re.finditer(pattern, text) if ok(m[0])]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def test_pii_base_spans(spark):
    rng = random.Random(6)
    parts = ["a@b.c", "x_d@e-f.gh.i", "@", "1.2.3.4", "001.2.0255.4", "256.1.1.1", ".5", "4111 1111 1111 1111", "4111-1111-1111-1112", "0", " ", "-", "+49 (170) 123-4567", "+", "+1", "é🙂", "\n", "a" * 9, "12345678901234567890", "30569309025904", ".", "%"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    texts += ["", None, "a" * 60_000 + "@", "1" * 60_000, "1 " * 30_000, "+1" + " " * 60_000, "x@y.z " * 3000]
    rows = list(enumerate(texts))
    out = pii.find(docs(spark, [(*r, 0) for r in rows], ", pii int")).collect()
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["pii"] if s["kind"] in pii.BASE] for r in out}
    for i, t in rows:
        assert got[i] == brute_spans(t or ""), (t or "")[:200]
        for s in next(r for r in out if r["doc_id"] == i)["pii"]:
            assert t[s["start"] : s["end"]] == s["value"]
    assert pii.find(docs(spark, [])).count() == 0


def test_pii_checksums_and_context(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00.", "DE89370400440532013001", "my ssn is 123-45-6789", "part 123-45-6789", "ssn 000-45-6789", "mail me: a@b.co"]
    out = {r["doc_id"]: r["pii"] for r in pii.find(docs(spark, list(enumerate(texts)))).collect()}
    assert [[s["kind"] for s in out[i]] for i in range(6)] == [["iban"], [], ["ssn"], [], [], ["email"]]
    assert out[0][0]["value"] == "DE89 3704 0044 0532 0130 00" and out[5][0]["score"] == 1.0


def test_ibans_end_where_their_country_says(spark):
    at, es = "AT61 1904 3002 3457 3201", "ES9121000418450200051332"
    cases = {
        f"IBAN {at} BIC GIBAATWW": [at], f"{es} BIC X": [es], "AT611904300234573201 12 May": ["AT611904300234573201"],
        f"é🙂 {at} {es} 2024": [at, es], f"AB12 {at} 77": [at], f"AB12 3456 7890 {at} OK": [at], f"{at}x": [], f"{at} DE89 3704 0044 0532 0130 00": [at, "DE89 3704 0044 0532 0130 00"],
        "AT61 1904 3002 3457 3202 BIC X": [],
    }
    out = {r["doc_id"]: r["pii"] for r in pii.find(docs(spark, list(enumerate(cases)))).collect()}
    for i, (text, values) in enumerate(cases.items()):
        spans = [s for s in out[i] if s["kind"] == "iban"]
        assert [s["value"] for s in spans] == values, text
        assert all(text[s["start"] : s["end"]] == s["value"] for s in spans)


def test_pii_redaction(spark):
    df = spark.createDataFrame(
        [(1, "é a@b.co and 4111 1111 1111 1111!", "en", 33), (2, "clean", "en", 5), (3, None, None, None)],
        "doc_id bigint, text string, lang string, n_chars bigint",
    )
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redact_documents(df).collect()}
    assert got == {1: ("é [EMAIL] and [CARD]!", 21), 2: ("clean", 5), 3: (None, None)}


# language


def test_language_on_held_out_documents(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    out = llm_queries.op10_language(spark, small).join(df.select("doc_id", "lang"), "doc_id")
    held = [r for r in out.collect() if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def test_language_odd_rows(spark, small):
    train = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", None), (-3, "123 !? ...", "de"), (-4, "und " * 300_000, None), (-5, "the", "en"), (-5, "the", "en")], train.schema)
    both = train.unionByName(odd).withColumn("language", F.lit("x"))
    model = langid.fit_documents(both)
    got = {r["doc_id"]: r["language"] for r in langid.predict(both, model).filter("doc_id < 0").collect()}
    for i in (-1, -2, -3):
        assert (got[i]["lang"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
    assert got[-4]["lang"] in model.languages and 0 <= got[-4]["score"] <= 1
    kept = {r["doc_id"] for r in langid.keep_identified(both.drop("language")).collect()}
    assert not kept & {-1, -2, -3} and {r["doc_id"] for r in train.collect()} <= kept
    assert langid.fit_documents(train.filter("lang IS NULL")) is None
    assert langid.predict(train.limit(2), None).filter("language.rejected").count() == 2
    assert langid.keep_identified(train.limit(0)).count() == 0


def test_texts_of_two_languages_are_kept(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").filter("length(text) BETWEEN 400 AND 4000").collect()
    model = langid.fit_documents(spark.read.parquet(f"{small}/documents.parquet"))
    one = {r["lang"]: r["text"] for r in rows}
    mixed = [one[a][:400] + " " + one[b][:400] for a in one for b in one if a < b]
    assert (model.score_texts(mixed).max(axis=1) >= model.threshold).mean() >= 0.9


def test_language_scores_do_not_depend_on_blocks():
    texts = ["the cat sat on the mat " * 30, "der Hund und die Katze", "ß"]
    model = langid.train([("en", *langid.features(texts[0])), ("de", *langid.features(texts[1]))] * 4)
    whole = model.score_texts(texts)
    assert abs(whole - [model.score_texts([t])[0] for t in texts]).max() < 1e-9


def test_language_sample_cuts_no_language(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 300)
    monkeypatch.setattr(langid, "train", lambda sample: sample)
    rows = [(None, f"null {i} aaa", "a") for i in range(400)] + [(5, f"five {i} bbb", "b") for i in range(400)] + [(7, "same text", "c")] * 400
    rows += [(1000 * k + i, f"word{k} text{i}", f"l{k:02}") for k in range(40) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3, "lang")
    seen = {}
    for s in langid.fit_documents(df):
        seen[s[0]] = seen.get(s[0], 0) + 1
    assert seen == {"a": 6, "b": 6, "c": 1} | {f"l{k:02}": 6 for k in range(40)}


UNLEARNT = [
    "Minä olen tänään kotona ja luen kirjaa, koska ulkona sataa vettä ja tuuli on kova.",
    "Dziś wieczorem pójdziemy do kina, bo grają nowy film polskiego reżysera.",
    "Сегодня вечером мы пойдём в кино, потому что показывают новый фильм.",
    "今日は天気がいいので公園を散歩しました。",
    "Bugün hava çok güzel olduğu için parkta uzun bir yürüyüş yaptık.",
    "xqzvk wjqpx zzkqv vbxjq kkwzx qjxvz pqwkz xxjvq",
]


def test_unlearnt_languages_are_rejected(spark, small):
    train = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    for known in (train, train.filter("lang = 'en'")):
        model = langid.fit_documents(known)
        odd = langid.predict(spark.createDataFrame([(t,) for t in UNLEARNT], "text string"), model)
        assert odd.filter("NOT language.rejected").count() == 0
        assert langid.predict(known, model).filter("language.rejected").count() <= 0.01 * known.count()

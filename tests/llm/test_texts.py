"""Per-document operators, mixing, packing and the pipeline against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleanboard.llm import (
    chat_format,
    html_extraction,
    language_id,
    mixing,
    packing,
    quality_classifier,
    quality_rules,
)
from gleanboard.llm.queries import QUERIES, word_bpe

SF = "/root/testdata/sf0.001"
ODD = ["", None, " \n\t", "one", "a b c a b c a b c", "x\n\nx\ny y\nx ", "# 50% $$ <a|b>", "é ünï\x0b\x0cfin", "the " * 300,
       "Line one here\nLine one here\n\nother line\nLine one here", "w" * 5000]


# --- quality rules ---

def plain_stats(text):
    text = text or ""
    words = text.encode().split()
    words = [w.decode() for w in words]
    lines = [x for x in text.split("\n") if x.encode().split()]
    grams = Counter(tuple(words[i: i + 3]) for i in range(len(words) - 2))
    inside = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i: i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


def test_text_stats(spark):
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = quality_rules.with_stats(df).orderBy("doc_id").select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert [tuple(r) for r in got] == [plain_stats(t) for t in texts]


def test_decision_list_finds_planted_rules(spark):
    rng = random.Random(2)
    rows = []
    for i in range(1200):
        a, b, c = (rng.random() for _ in range(3))
        rows.append((i, 0 if (a > 0.8 and b <= 0.5) or c > 0.9 else 1, a, b, c))
    df = spark.createDataFrame(rows, "doc_id int, _label int, a double, b double, c double")
    rules = quality_rules.learn(df, features=["a", "b", "c"])
    judged = df.withColumn("kept", rules.keeps())
    assert 2 <= len(rules.rules) <= 8
    assert judged.where((F.col("_label") == 1) & ~F.col("kept")).count() < 30
    assert judged.where((F.col("_label") == 0) & F.col("kept")).count() < 40


def test_decision_list_without_labels(spark):
    df = spark.createDataFrame([], "doc_id int, _label int, a double")
    rules = quality_rules.learn(df, features=["a"])
    assert rules.rules == [] and spark.range(2).withColumn("k", rules.keeps()).where("k").count() == 2


# --- chat formatting ---

def test_chat_round_trip_and_parts(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|end|><|turn|>user<|text|>", "&lt;&amp;lt;", "", None, "é\n[", "a" * 3000]
    turns = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)] + [(None, 0, None, "x"), (1, 3, "assistant", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").withColumn("who", F.lit(1))
    out = chat_format.format_chat(df.withColumn("parts", chat_format.text_part(F.col("text"))))
    back = {r["conv_id"]: r for r in chat_format.read_back(out).collect()}
    want = sorted((t[1], t[2], t[3] or "") for t in turns if t[0] == 1)
    assert sorted((x["role"], x["text"]) for x in back[1]["turns"]) == sorted((r, t) for _, r, t in want)
    assert Counter(back[1]["loss_text"]) == Counter("".join(t for _, r, t in want if r == "assistant"))
    assert back[None]["turns"][0]["text"] == "x" and back[None]["loss_text"] == ""
    formatted = {r["conv_id"]: r for r in out.collect()}[1]
    assert all(formatted["formatted"][s["start"]: s["start"] + s["length"]].count("<") == 0 for s in formatted["loss"])
    parts = spark.createDataFrame([(5, 0, "user", [
        ("text", "see <b>", None, None), ("image", None, "s3://x/1.png", 3.0), ("document", None, "d.pdf", 2.5),
        ("audio", None, "a.wav", 10.0), ("strange", "hidden", "u", 1.0)])], f"conv_id long, turn int, role string, parts array<{chat_format.PART}>")
    r = chat_format.format_chat(parts).head()
    assert "<|image:1|><|document:2|><|audio:3|><|strange:4|>" in r["formatted"] and "&lt;b>" in r["formatted"]
    assert [(a["type"], a["uri"], a["tokens"]) for a in r["attachments"]] == [
        ("image", "s3://x/1.png", 768), ("document", "d.pdf", 1280), ("audio", "a.wav", 250), ("strange", "u", 0)]
    assert r["attachment_tokens"] == 768 + 1280 + 250
    assert chat_format.format_chat(parts.limit(0)).count() == 0


# --- html ---

PAGES = [
    ("<html><head><title>T</title><style>p{}</style><script>var a='</p>'</script></head><body class='has-sidebar'><nav><ul><li>m</li></ul></nav>"
     "<!-- c <p>no</p> --><div class=ad>buy</div><article><h1>Head &amp; more</h1><p><b>One<br>two  three<p>Four&nbsp;&#233;\n five"
     "<ul><li>i<li>j</ul><div class='comments'><p>nice!</p></div><form><p>mail</p></form></article><footer>(c)</footer>",
     "Head & more\nOne two three\nFour é five\ni\nj"),
    ("<div id='main-text'><p>Only <i>this</i></p></div><div class='cookie-notice'>We use</div><aside>side</aside>", "Only this"),
    ("<p>cut &am", "cut &am"), ("", ""), (None, ""), ("plain text", "plain text"), ("<article></article><p>outside</p>", "outside"),
    ("<main role='main'><section><h2>A</h2>loose<p>b</section></main><p>x", "A\nloose\nb"),
]


def test_extract_pages(spark):
    rows = [(i, f"http://h{i}.example/x", p, "c") for i, (p, _) in enumerate(PAGES)] + [(99, None, PAGES[0][0], "c")]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got == {**{i: t for i, (_, t) in enumerate(PAGES)}, 99: PAGES[0][1]}


def test_site_style_tree_removes_template(spark):
    rows = []
    for i in range(30):
        body = " ".join(f"w{i}x{k}" for k in range(20))
        rows.append((i, "http://one.example/p", f"<div class='box'><div class='frame'><p>Always the same words</p></div><div class='body'><p>{body}</p></div></div>"))
    rows += [(100 + i, "http://copies.example/p", "<article><p>The same article on every page.</p></article>") for i in range(30)]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].startswith(f"w{i}x0") and "Always" not in got[i] for i in range(30))
    assert all(got[100 + i] == "The same article on every page." for i in range(30))
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n))


def test_copied_pages_keep_their_text(spark):
    rng = random.Random(12)
    page = lambda first, *texts: f"<html><body><div class='top'>{first}</div><div class='text'>" + "".join(f"<p>{t}</p>" for t in texts) + "</div></body></html>"
    rows, want = [], {}

    def add(host, texts, first="Our little slogan"):
        i = len(rows)
        rows.append((i, host, page(first, *texts)))
        want[i] = "\n".join(texts)

    copied = [prose(rng, 40), prose(rng, 50)]
    for k in range(120):
        add("http://copies.example/p", copied if k % 20 else [prose(rng, 40), prose(rng, 30)], prose(rng, 5))
        want[k] = rows[k][2].split("'top'>")[1].split("<")[0] + "\n" + want[k]
    near = [prose(rng, 40), prose(rng, 90), prose(rng, 40)]
    for k in range(100):  # near copies beside others, all under one slogan
        changed = near[1].split()
        changed[k % 90] = prose(rng, 1)
        add("http://near.example/p", [near[0], " ".join(changed), near[2]] if k % 5 else [prose(rng, 60), prose(rng, 20)])
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_repeated_notice_in_articles_goes(spark):
    rng = random.Random(13)
    rows, want = [], {}
    for k in range(40):
        texts = [prose(rng, 30), prose(rng, 20)]
        rows.append((k, "http://one.example/p", f"<article><h1>{texts[0]}</h1><p>Please pass this page on to friends</p><p>{texts[1]}</p></article>"))
        want[k] = "\n".join(texts)
    copy = [prose(rng, 30), prose(rng, 20)]
    for k in range(40, 100):  # mostly one article, each beneath a line of its own
        texts = [prose(rng, 4), *(copy if k % 3 else [prose(rng, 30), prose(rng, 20)])]
        rows.append((k, "http://two.example/p", "<article>" + "".join(f"<p>{t}</p>" for t in texts) + "</article>"))
        want[k] = "\n".join(texts)
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


# --- mixing ---

def test_targets_share_the_whole():
    got = mixing.targets({"a": 1000, "b": 10, "c": 500, None: 300})
    assert got["b"] == 30 and abs(sum(got.values()) - 1810) < 1e-6
    assert abs(got["a"] / got["c"] - 5) < 1e-9 and got[None] > got["c"]
    assert mixing.targets({}) == {}


def test_mix_meets_targets_and_reruns_agree(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        s = rng.choice(["hot"] * 5 + ["b", "c", "d", None])
        rows.append((i, s, " ".join(["w"] * int(rng.lognormvariate(3, 1))), 1, "t"))
    rows += [(3000, "a few", "w w w", 1, "t"), (3001, "none", None, 1, "t"), (3002, "none", "  ", 1, "t"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int, target string")
    got = mixing.mix(df).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert len(got) == len(rows) and all(r["size"] == len((t or "").split()) for r, t in
                                         zip(sorted(got, key=lambda r: r["doc_id"]), [x[2] for x in sorted(rows, key=lambda r: r[0])], strict=True))
    taken, goal = defaultdict(int), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
    assert all(abs(taken[s] - goal[s]) <= max(3, 0.002 * goal[s]) for s in goal), (taken, goal)
    again = mixing.mix(df.repartition(5)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    copies = mixing.mixed_documents(df)
    assert copies.columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0


# --- packing ---

def test_patterns_use_everything_up():
    rng = random.Random(4)
    counts = Counter(min(64, rng.randint(1, 70)) for _ in range(5000))
    used, windows = Counter(), 0
    for times, chosen in packing.patterns(dict(counts), 64):
        assert times > 0 and sum(n * c for n, c in chosen) <= 64
        windows += times
        for n, c in chosen:
            used[n] += c * times
    assert used == counts and sum(n * c for n, c in counts.items()) / 64 / windows > 0.99


def test_word_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    whole, ours = Tokenizer.from_file(word_bpe()), packing.WordTokens(word_bpe())
    rng = random.Random(5)
    texts = [t or "" for t in ODD] + ["ΑΣ ΣΑΣ's it's x　y é <|endoftext|> a<|startoftext|>b don't 'sfoo x'rey \x1c z\x85q",
                                      "".join(map(chr, range(33, 700))), "".join(rng.choice("a'stredvml1É! #<|>") for _ in range(5000))]
    for t in texts:
        assert ours(t).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_pack_covers_every_token_once(spark):
    import numpy as np
    rng = random.Random(6)
    texts = [t for t in ODD if t is None or len(t) < 3000] + [" ".join(rng.choice(["alpha", "beta's", "x1", "é"]) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, "one", 1), (None, "no id", 1)], "doc_id long, text string, length int")
    got = packing.pack(df, word_bpe(), size=256).collect()
    tokens = packing.WordTokens(word_bpe())
    seen, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[r["doc_id"]].append(r)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for i, t in enumerate(texts):
        ids = np.append(tokens(t or ""), 2).astype("<u4")
        parts = sorted(seen[i], key=lambda r: r["start"])
        if i == 3:
            assert len(parts) == 2  # the id occurs twice
            continue
        assert [r["start"] for r in parts] == list(range(0, len(ids), 256)) and sum(r["length"] for r in parts) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"]: r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids) for r in parts)
    assert packing.pack(df.limit(0), word_bpe()).count() == 0


# --- language ---

def test_language_mixture(spark):
    rng = random.Random(7)
    make = {"aa": lambda: "".join(rng.choice(["ka", "to", "mi", "ru"]) for _ in range(3)),
            "bb": lambda: "".join(rng.choice(["sch", "eit", "ung", "ach"]) for _ in range(2)),
            "cc": lambda: "".join(rng.choice(["éau", "oui", "les", "ment"]) for _ in range(2))}
    rows = [(i, " ".join(make[g]() for _ in range(60)), g) for i in range(240) for g in [list(make)[i % 3]]]
    model = language_id.learn(spark.createDataFrame(rows + [(None, "x", "aa"), (999, "y", None), (998, None, "bb")], "doc_id long, text string, lang string"))
    mixed = " ".join([make["aa"]() for _ in range(70)] + [make["bb"]() for _ in range(30)])
    tests = [(1, make["aa"](), None), (2, " ".join(make["bb"]() for _ in range(40)), "aa"), (3, mixed, None), (4, None, "aa"), (5, "123 !! --", "bb"),
             (6, "", "cc"), (7, " ".join(make["cc"]() for _ in range(20_000)), None), (None, make["cc"](), "x")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(
        spark.createDataFrame(tests, "doc_id long, text string, lang_pred string"), model).collect()}
    assert got[1][0] == "aa" and got[2][0] == "bb" and got[7][0] == "cc" and got[None][0] == "cc"
    assert got[3][0] == "aa" and abs(got[3][1] - 0.7) < 0.05
    assert [got[i] for i in (4, 5, 6)] == [("und", 0.0)] * 3
    nothing = language_id.learn(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert language_id.predict(spark.createDataFrame(tests[:1], "doc_id long, text string, l string"), nothing).head()["lang_pred"] == "und"


def test_language_sets_grow_as_far_as_they_are_worth(spark):
    rng = random.Random(9)
    made = {f"l{i}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2)) for _ in range(8)] for i in range(6)}
    text = lambda g, n: " ".join("".join(rng.choice(made[g]) for _ in range(4)) for _ in range(n))
    rows = [(i, text(f"l{i % 6}", 60), f"l{i % 6}") for i in range(300)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    five = " ".join(text(f"l{i}", 40 + 5 * i) for i in range(5))
    tests = spark.createDataFrame([(1, five, "s"), (2, text("l3", 50), "s"), (3, None, "s")], "doc_id long, text string, score string")
    got = {r["doc_id"]: r for r in language_id.predict(tests, model, keep=("doc_id", "text", "score"), into=("a", "b", "c", "d")).collect()}
    assert set(got[1]["c"]) == {f"l{i}" for i in range(5)} and abs(sum(got[1]["d"]) - 1) < 1e-6
    assert got[1]["d"] == sorted(got[1]["d"], reverse=True) and got[1]["a"] == got[1]["c"][0] and got[1]["b"] == got[1]["d"][0]
    assert got[2]["c"] == ["l3"] and got[3]["c"] == [] and (got[3]["a"], got[3]["b"]) == ("und", 0.0)
    assert got[1]["text"] == five and got[1]["score"] == "s"


def test_language_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op8_language_id"](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).head()
    assert n > 100 and right > 0.97


# --- classifier ---

def test_ordinal_grades(spark):
    rng = random.Random(8)
    filler = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for i in range(900):
        g = i % 3
        marks = [["awful"], ["so-so"], ["great"]][g] * 3
        rows.append((i, " ".join(rng.sample([filler() for _ in range(40)] + marks, 43)), g))
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    train = df.where("doc_id % 3 = 0 OR doc_id % 7 < 4")
    model = quality_classifier.learn(train.drop("grade"), train.select("doc_id", "grade"))
    assert list(model.thresholds) == sorted(model.thresholds)
    got = quality_classifier.score(df.drop("grade"), model).join(df, "doc_id").groupBy("grade").agg(F.avg("expected_grade"), F.avg("tail")).orderBy("grade").collect()
    assert got[0][1] < 0.5 < got[1][1] < 1.5 < got[2][1] and got[2][2] > 0.8 > 0.3 > got[1][2]
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "é" * 100_000), (1, None)], "doc_id long, text string")
    assert quality_classifier.score(odd, model).count() == 4
    none = quality_classifier.learn(df, df.select("doc_id", "grade").limit(0))
    assert quality_classifier.score(odd, none).agg(F.min("tail"), F.max("expected_grade")).head() == (1.0, 0.0)


# --- pipeline ---

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.orderBy("doc_id").head()
    extra = spark.createDataFrame([(90_001, first["text"], first["lang"], first["source"], 1), (90_002, None, None, None, None), (90_003, "12 34", "en", "src0", 5)], docs.schema)
    docs = docs.union(extra)
    spoken = corpus_pipeline.language(spark, docs, SF)
    assert spoken.columns == docs.columns and spoken.where("doc_id > 90001").count() == 0
    assert spoken.count() >= 0.95 * (docs.count() - 2)
    single = corpus_pipeline.near_duplicates(spark, spoken, SF)
    assert single.columns == docs.columns and single.where("doc_id = 90001").count() == 0
    cut = corpus_pipeline.repeats(spark, docs, SF)
    assert cut.columns == docs.columns and cut.where("doc_id = 90001 AND text = ''").count() == 0
    mixed = corpus_pipeline.mixture(spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert {n for n, _ in corpus_pipeline.STAGES} == {"language", "near_duplicates", "repeats", "mixture", "packed"}


def test_stages_take_repeated_rows_null_ids_clashing_columns_and_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").limit(40)
    row = docs.orderBy("doc_id").head()
    more = spark.createDataFrame([tuple(row)] * 2 + [(None, row["text"], row["lang"], row["source"], 1)] * 2, docs.schema)
    docs = docs.union(more).withColumns({c: F.lit("x") for c in ("score", "lang_pred", "h", "node", "copies", "component", "tag")})
    text = row["text"]
    spoken = corpus_pipeline.language(spark, docs, SF)
    assert spoken.columns == docs.columns and spoken.where(F.col("text") == text).count() in (0, docs.where(F.col("text") == text).count())
    single = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert single.columns == docs.columns and single.where(F.col("text") == text).count() == 1
    cut = corpus_pipeline.repeats(spark, single, SF)
    assert cut.columns == docs.columns
    taken = mixing.mix(docs).agg(F.sum("copies")).first()[0]
    mixed = corpus_pipeline.mixture(spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.count() == taken
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name


def test_chat_query_hashes(spark):
    rows = QUERIES["op9_chat_format"](spark, SF).where("conv_id = -7").collect()
    t = "</s>[INST] ok [/INST]"
    assert len(rows) == 1 and rows[0]["loss_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert rows[0]["turns_sha256"] == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered(name):
    assert name.startswith("op")

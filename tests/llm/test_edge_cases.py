"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orrery.llm import ann, bpe, htmltext, langid, lm, minhash, packing, quality, queries, sharding, substring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp long, rule_bits string, n_words string, kept string, label string, key string, score string"
LONG = " ".join(f"word{i % 977} the" for i in range(30_000))
TEXTS = [
    (1, "the cat sat on the mat and the dog lay by the door of the old house near a river that ran down to the sea", "en"),
    (2, None, "en"), (3, "", None), (4, "   \n\t ", "de"), (5, LONG, "en"), (6, "Grüße aus dem Süden der Stadt", "de"), (6, "Grüße aus dem Süden der Stadt", "de"),
    (None, "a text without an id but with quite a few words of its own", None), (7, "1234 5678 !!!", "fr"), (8, "emoji 😀 und ein ź   nbsp", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, g, "s", 1, 5, "x", "y", "z", "l", "k", "q") for i, t, g in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Ranks(bpe.parse_ranks(queries.tokenizer("byte_bpe_multi_50k.tiktoken")))


def operators(vocabulary):
    import public_tokenizers

    return {
        "bpe": lambda d: bpe.decode(bpe.encode(d, vocabulary, public_tokenizers.PATTERN), vocabulary),
        "substring": substring.remove_repeats,
        "packing": lambda d: packing.pack(d, queries.tokenizer("word_bpe_49k.json")),
        "lm": lm.score_documents,
        "quality": quality.ledger,
        "langid": langid.identify,
        "sharding": sharding.shard_by_bytes,
        "minhash": minhash.near_duplicates,
    }


@pytest.mark.parametrize("name", ["bpe", "substring", "packing", "lm", "quality", "langid", "sharding", "minhash"])
def test_every_row_has_a_result(spark, docs, vocabulary, name):
    found = operators(vocabulary)[name](docs)
    ids = sorted((r.doc_id for r in found.select("doc_id").collect()), key=lambda x: (x is None, x))
    want = sorted((i for i, _, _ in TEXTS), key=lambda x: (x is None, x))
    assert (sorted(set(ids) - {None}) == sorted(set(want) - {None}) and None in ids) if name == "packing" else ids == want
    empty = operators(vocabulary)[name](docs.limit(0))
    assert empty.columns == found.columns and empty.count() == 0


def test_defined_values(spark, docs, vocabulary):
    rows = {r.doc_id: r for r in operators(vocabulary)["lm"](docs).collect()}
    assert rows[2].n_tokens == 1 and rows[3].score == pytest.approx(rows[2].score) and rows[None].held_out is False
    rows = {r.doc_id: r for r in operators(vocabulary)["langid"](docs).collect()}
    assert rows[2].lang_pred == rows[7].lang_pred == "und" and rows[2].score == 0.0
    rows = {r.doc_id: r for r in operators(vocabulary)["minhash"](docs).collect()}
    assert rows[2].n_shingles == 0 and rows[2].kept and rows[7].n_shingles == 1 and rows[None].component_id is None and rows[None].kept
    rows = {r.doc_id: r for r in operators(vocabulary)["packing"](docs).collect() if r.doc_id in (2, 3, 4)}
    assert all(r.length == 1 for r in rows.values())
    rows = {r.doc_id: r for r in operators(vocabulary)["sharding"](docs).collect()}
    assert rows[2].size == 1 and rows[2].text_crc32 == 0 and {r.law for r in rows.values()} == {"bytes"}
    rows = {r.doc_id: r for r in operators(vocabulary)["substring"](docs).collect()}
    assert rows[2].n_words == 0 and rows[2].kept_text == "" and rows[6].n_removed == 0
    found = quality.ledger(docs)
    assert set(docs.columns) <= set(found.columns) and dict(found.dtypes)["rule_bits"] == "bigint"


def test_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<p>Only text.</p>"), (3, "u", "<p>Only text.</p>"), (4, "u", "<article><p>cut off &am"), (5, None, "plain words < 3")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text) for r in htmltext.extract(pages).collect())
    assert got == [(1, ""), (2, ""), (3, "Only text."), (3, "Only text."), (4, "cut off &am"), (5, "plain words < 3")]
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_substring_edit_keeps_columns_of_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(70))
    rows = [(1, text, "a", "b", 7, "c"), (2, text + " end", "a", "b", 7, "c"), (3, None, "a", "b", 7, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept_text string, n_removed long, grp string")
    found = {r.doc_id: r for r in substring.edit_repeats(df).collect()}
    assert substring.edit_repeats(df).columns == df.columns
    assert found[1].text == text and found[2].text == "end" and found[3].text is None and {(r.n_words, r.kept_text, r.n_removed, r.grp) for r in found.values()} == {("a", "b", 7, "c")}


def test_one_very_long_word_and_tables_of_repeated_rows(spark, vocabulary):
    word = "".join(chr(97 + (i * i) % 26) for i in range(2000))
    long = spark.createDataFrame([(1, word * 40), (2, word * 40), (3, "a " * 3)], "doc_id long, text string")
    same = spark.createDataFrame([(5, "the cat sat on the mat by the door of the house")] * 3000, "doc_id long, text string").repartition(3)
    for name, run in operators(vocabulary).items():
        if name in ("langid", "bpe"):  # their own tests
            continue
        assert run(long).select("doc_id").distinct().count() == 3, name
        assert run(same).count() == 3000, name
    assert bpe.encode(same, vocabulary, r"\S+|\s+").select("n_tokens").distinct().count() == 1
    kept = {r.doc_id: r.component_id for r in minhash.near_duplicates(long).collect()}
    assert kept == {1: 1, 2: 1, 3: 3}


def test_one_row_of_each_kept_doc_id(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(1, text)] * 3 + [(2, "quite another text with no near copy of any other row in this table")] + [(None, text)] * 2 + [(3, text)]
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id or 0 for r in kept.collect())) == [0, 0, 1, 2]


def test_language_filter_without_any_label(spark):
    rows = [(1, "a clean text", None), (2, None, None), (3, "", None), (4, "12 + 3", None), (5, "żółw", None)]
    kept = langid.filter_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5]


def test_article_keeps_captions_and_anchored_headings():
    page = """<article><h2 id="market-share">Market share</h2><h2 id='search'>Search</h2><section id="related-work"><p>Earlier work.</p></section>
    <figure><img src="x"><figcaption>A caption.</figcaption></figure><div class="share buttons">Share this</div></article>"""
    assert htmltext.main_text(page).split("\n") == ["Market share", "Search", "Earlier work.", "A caption."]


def test_page_without_article_in_a_further_language():
    long = ["Wczoraj rano mieszkańcy starego miasta zobaczyli, jak rzeka zalewa drogę prowadzącą do portu.", "Рано утром жители старого города увидели, что река вышла из берегов и залила дорогу к порту."]
    for text in long:
        assert htmltext.main_text(f"<p>{text}</p>") == text
        page = f"<nav><a href='/'>Start</a></nav><div><p>{text}</p><p>{text}</p></div><footer>{text}</footer>"
        assert htmltext.main_text(page) == f"{text}\n{text}"


PROSE = {
    "en": "The house of the man was by the sea, and it was not far from the town that he had left in the winter of that year.",
    "pl": "Wczoraj rano mieszkańcy starego miasta zobaczyli, jak rzeka zalewa drogę prowadzącą do portu, a potem cały rynek.",
    "zh": "昨天早上，老城的居民看到河水淹没了通往港口的道路，随后整个市场都被水淹没，人们只好离开家园。",
}


@pytest.mark.parametrize("lang", sorted(PROSE))
@pytest.mark.parametrize("wrap", [
    '<div class="content share-enabled"><article>{}</article></div>', '<div class="has-sidebar"><main>{}</main></div>', '<div class="layout-sidebar-wrapper"><article>{}</article></div>',
    "<div id='post'>{}</div>", "<div class='sidebar-right-layout'>{}</div>", "{}",
])
def test_wrappers_and_pages_without_articles(lang, wrap):
    text = PROSE[lang]
    body = f"<header><h1>{text[:9]}</h1></header><p>{text}</p><p>{text}</p>" if "<article>" in wrap else f"<p>{text}</p><p>{text}</p>"
    page = f"<body><nav><ul><li><a href=/>Start</a></li></ul></nav><div class=ad>{text}</div>{wrap.format(body)}<div class='comments'><p>{text}</p><p>{text}</p><p>{text}</p></div><footer>{text}</footer></body>"
    want = ([text[:9]] if "<header>" in body else []) + [text, text]
    assert htmltext.main_text(page).split("\n") == want


def test_both_passes_change_results():
    long, few = PROSE["en"], "Price list: oak 12, pine 9, beech 14, larch 11, spruce 8, maple 21, cherry 30, walnut 44, elm 17, ash 16."
    page = f"<div><h2>Title</h2><p>{long}</p><p>Short line.</p><p>{long}</p></div><div><p>{few}</p><p>Buy now</p><p>{few}</p></div><div><a href=/x>{long}</a></div>"
    found, strength = htmltext.blocks(page)
    first = htmltext.first_pass(found)
    assert first == [None, True, None, True, False, None, False, False]
    assert htmltext.second_pass(found, htmltext.bar_parts(found, strength, first)) == [True, True, True, True, False, False, False, False]
    assert htmltext.main_text(page).split("\n") == ["Title", long, "Short line.", long]


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, None]), (6, []), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]),
            (50, [0.0, 2.0]), (8, [2.0, 0.0]), (9, [3.0, 0.0]), (10, [1.0, 1.0])]
    found = ann.nearest(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string"))
    got = {q: [r.vec_id for r in sorted(found.where(F.col("query_id") == q).collect(), key=lambda r: r["rank"])] for q in (0, 50)}
    assert got == {0: [8, 9, 10, 50], 50: [10, 0, 8, 9]}
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pipeline_stages_on_empty_and_odd_rows(spark, docs, tmp_path):
    import corpus_pipeline

    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for part, sub in ((plain, "odd"), (plain.limit(0), "none")):
        part.write.parquet(str(tmp_path / sub / "documents.parquet"))
        step = spark.read.parquet(str(tmp_path / sub / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before, step = step.collect(), stage(spark, step, str(tmp_path / sub)).cache()
            assert step.columns == plain.columns and step.count() <= len(before)
        kept = sorted((r.doc_id for r in step.collect()), key=lambda x: (x is None, x))
        packed = corpus_pipeline.run(spark, str(tmp_path / sub)).where("piece = 0").collect()
        assert sorted((r.doc_id for r in packed), key=lambda x: (x is None, x)) == kept
        if sub == "odd":
            assert 1 in kept and not {2, 3, 4, 7} & set(kept)
        else:
            assert kept == []

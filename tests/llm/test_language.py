from pyspark.sql import functions as F

from emberlane.llm import language
from tests.llm.tables import TEXTS, no_documents, odd_documents


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = language.fit(docs.filter(~out))
    found = language.identify(docs.filter(out), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) >= 0.95
    assert sum(r.accepted for r in found) / len(found) >= 0.98
    assert all(0 <= r.score <= 1 for r in found)
    assert not model.predict(["привет мир это просто тест для языка"])[0][2]


def test_odd_rows(spark):
    docs = odd_documents(spark)
    model = language.fit(docs, rows_per_language=5)
    found = language.identify(docs, model).collect()
    assert len(found) == len(TEXTS)
    for row in found:
        text = next(t for i, t in TEXTS if i == row.doc_id)
        assert (row.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
    kept = language.keep_accepted(docs, model)
    assert kept.columns == docs.columns and kept.filter("text is null").count() == 0
    assert language.identify(no_documents(spark), model).count() == 0


def test_without_labels_nothing_is_known(spark):
    docs = odd_documents(spark).withColumn("lang", F.lit(None).cast("string"))
    found = language.identify(docs, language.fit(docs)).collect()
    assert {(r.lang_pred, r.score, r.accepted) for r in found} == {("und", 0.0, False)}
    assert language.fit(no_documents(spark)).languages == []


def test_only_the_most_frequent_labels_are_learned(spark):
    rows = [(k, "some words of one language", "a" if k % 2 else "b" if k % 4 else "c") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert set(language.fit(docs, languages=1).languages) == {"a"}
    assert set(language.fit(docs, languages=2).languages) == {"a", "b"} and set(language.fit(docs).languages) == {"a", "b", "c"}


def test_counts_equal_counting_by_hand():
    text = "Ab ba"
    flat = b"ab ba   "
    by_hand = {}
    for n in (2, 3):
        for i in range(len(flat) - n + 1):
            if flat[i : i + n].strip():
                by_hand[flat[i : i + n]] = by_hand.get(flat[i : i + n], 0) + 1
    assert language.term_counts([text]).sum() == sum(by_hand.values())
    both = language.term_counts([text, "", text])
    assert (both[0] == both[2]).all() and both[1].sum() == 0


def test_scores_do_not_depend_on_the_order_or_partitions_of_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    first = {r.doc_id: r[1:] for r in language.identify(docs, model).collect()}
    mixed = docs.orderBy(F.xxhash64("doc_id")).repartition(7, F.xxhash64("text"))
    again = {r.doc_id: r[1:] for r in language.identify(mixed, model).collect()}
    assert first.keys() == again.keys()
    for key, (lang, score, kept) in first.items():
        assert (lang, kept) == (again[key][0], again[key][2]) and abs(score - again[key][1]) < 1e-5


# Italian, Dutch, Portuguese, Polish and Swedish, which no table has.
FOREIGN = [
    "La mattina presto il mercato si riempie di gente che cerca frutta fresca, pane appena sfornato e formaggi delle colline vicine. I venditori gridano i prezzi mentre i bambini corrono tra le bancarelle e gli anziani discutono della partita di ieri sera. Quando comincia a piovere tutti si riparano sotto i portici e aspettano con pazienza che torni il sole.",
    "In de vroege ochtend fietsen de leerlingen langs het kanaal naar school, terwijl de schippers hun boten klaarmaken voor de lange reis naar het zuiden. Op het plein worden kramen opgebouwd en ruikt het al naar verse broodjes en koffie. Als het begint te regenen schuilen de mensen onder de bomen en wachten ze geduldig tot de zon weer gaat schijnen.",
    "De manhã cedo os pescadores voltam ao porto com as redes cheias e as gaivotas voam em volta dos barcos à espera de restos. As mulheres escolhem os peixes mais frescos e discutem os preços em voz alta, enquanto as crianças brincam na areia. Quando começa a chover todos correm para debaixo dos toldos e esperam que o sol volte a brilhar.",
    "Wczesnym rankiem na targu pojawiają się pierwsi kupcy, którzy rozkładają świeże warzywa, chleb i sery z okolicznych wsi. Dzieci biegają między straganami, a starsi ludzie rozmawiają o wczorajszym meczu i o pogodzie. Kiedy zaczyna padać deszcz, wszyscy chowają się pod dachem i cierpliwie czekają, aż znowu zaświeci słońce.",
    "Tidigt på morgonen cyklar barnen längs kanalen till skolan medan fiskarna gör i ordning sina båtar för den långa resan söderut. På torget byggs stånden upp och det luktar redan nybakat bröd och kaffe. När det börjar regna söker alla skydd under träden och väntar tålmodigt på att solen ska komma fram igen.",
]


def test_other_languages_in_latin_script_go_and_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = language.fit(docs.filter(~out))
    for text in FOREIGN:
        assert not any(kept for _, _, kept in model.predict([text, text + " " + text]))
    found = language.identify(docs.filter(out), model).collect()
    assert sum(r.accepted for r in found) / len(found) >= 0.995

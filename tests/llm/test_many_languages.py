"""No language is left out because others are more frequent."""

from textmill.llm import quality
from textmill.llm.sampling import labelled_sample


def test_rare_languages_have_references_and_labels(spark):
    rows = []
    for k in range(70):
        text = " ".join(chr(0x4E00 + 50 * k + i % 7) * 3 if k == 69 else f"w{k}x{i % 7}" for i in range(0, 700, 5))
        rows += [(10 * k + c, text, f"l{k:02}") for c in range(1 if k == 69 else 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    references = quality.language_references(docs)
    assert [r.language for r in references.languages] == [f"l{k:02}" for k in range(70)]
    rare = quality.judge(docs.filter("lang = 'l69'"), references).first()
    assert (rare.nearest_language, rare.char_distance, rare.word_distance) == ("l69", 0.0, 0.0)
    assert labelled_sample(docs, "lang", 300, 100_000, None)["lang"].nunique() == 70

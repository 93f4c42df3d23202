"""The words that have bins are the most frequent ones, exactly, however many different ones a task meets."""

from collections import Counter

from emberline.llm import quality


def test_words_are_counted_exactly(spark, monkeypatch):
    monkeypatch.setattr(quality, "COUNTED", 50)
    if hasattr(quality, "KEPT_WORDS"):
        monkeypatch.setattr(quality, "KEPT_WORDS", 10)
    long = "averyveryverylongwordoverthirtysigns"
    # Each document of 60 different words, and a word in every second one.
    texts = [" ".join([f"w{60 * i + k}" for k in range(58)] + [long if i % 2 else "even", f"t{i % 7}"]) for i in range(60)]
    want = Counter(w for t in texts for w in t.split())
    best = sorted(want, key=lambda w: (-want[w], w))[:9]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").coalesce(1)
    assert quality.learn_words(docs, most=9) == sorted(best)

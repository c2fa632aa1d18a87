"""Learned exception phrases spare whole pairs of words only."""

from helpers import sentences
from toolguard.llm import toxicity


def test_learned_pairs_spare_no_longer_word(spark):
    texts = sentences(400, seed=3, words=30)
    rows = []
    for i, t in enumerate(texts):
        toxic = int(i % 4 == 0)
        words = t.split()
        for at in range(1, len(words), 6):
            words[at] = f"{words[at]} wretch" if toxic else words[at]
        rows.append((i, " ".join(words) if toxic or i % 16 != 1 else f"{t} pond wretch", toxic))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert any(p.strip() == "pond wretch" for p in model.exceptions)
    weigh = lambda t: model.weigh(toxicity.fold_text(t, toxicity.Folding()), model.matcher())
    assert weigh("pond wretch") == 0
    assert weigh("pond wretchbag") > 0

"""The pipeline's stages on the smallest sample, each against a plain version on its own input."""

from collections import Counter

import corpus_pipeline
from streakline.llm import decontamination, langid, mixing
from streakline.llm.common import stored, table
from streakline.llm.queries import QUERIES
from tests.llm.test_jaccard import brute
from tests.llm.test_mixing_sharding import balanced

SF_DIR = "/root/testdata/sf0.001"


def test_stages_match_plain_versions(spark):
    docs = table(spark, SF_DIR, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stored(stage(spark, docs, SF_DIR))
        seen[name] = (before, docs.collect())
        if name != "sharding":
            assert docs.columns == columns

    before, after = seen["language_id"]
    model = langid.sample_texts(table(spark, SF_DIR, "documents"), ~langid.held_out())
    encoders = list(langid._encoders(model))
    assert Counter(after) == Counter(r for r in before if not langid.classify(r.text, encoders)[3])

    before, after = seen["near_copies"]
    want = {i for i, (n, c) in brute([(r.doc_id, r.text) for r in before]).items() if i == c}
    assert {r.doc_id for r in after} == want and len(after) == len(want)

    before, after = seen["decontamination"]
    items = [r.text for r in table(spark, SF_DIR, "benchmark").collect()]
    kept = {r.doc_id for r in after}
    assert not any(item in r.text for r in after for item in items)
    matcher = decontamination.Matcher([decontamination.normal(x) for x in items])
    assert kept == {r.doc_id for r in before if not matcher.find(decontamination.normal(r.text))}

    before, after = seen["mixing"]
    copies = {r.doc_id: r.copies for r in mixing.mixed_words(spark.createDataFrame(before, table(spark, SF_DIR, "documents").schema)).collect()}
    assert Counter(r.doc_id for r in after) == Counter({d: c for d, c in copies.items() if c})

    before, after = seen["sharding"]
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
    balanced(after)


def test_registry_holds_the_operators_and_the_pipeline():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(QUERIES) | {"pipeline"} <= names
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_copies", "decontamination", "mixing", "sharding"]

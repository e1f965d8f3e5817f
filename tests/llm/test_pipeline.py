"""The pipeline's stages on a small table, and its registration."""

import corpus_pipeline as P
from geoq.llm.common import table
from tests.conftest import SF_SMALL
from tests.llm.cases import lines, words
from tests.llm.test_similarity import brute_classes, brute_left, shingles


def test_stages(spark):
    docs = table(spark, SF_SMALL, "documents")
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "near duplicates", "decontamination", "packing"]
    kept = [docs.count()]
    for _, stage in P.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF_SMALL)
        assert docs.dtypes == before.dtypes
        kept.append(docs.count())
    assert kept[0] > kept[1] == kept[2] >= kept[3] >= kept[4] > 0.7 * kept[0]
    packed = P.STAGES[-1][1](spark, docs, SF_SMALL)
    assert packed.select("doc_id").distinct().count() == kept[4]


def test_registered():
    import __spark_entry__ as E
    names = set(E.queries())
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x.startswith("op") and x[2].isdigit()}
    assert "pipeline" in names


def test_stages_against_brute_force(spark):
    """Rows of the stages between, on planted and real texts: line dedup, near
    duplicates and decontamination by their definitions."""
    plain = [(r["doc_id"], r["text"]) for r in table(spark, SF_SMALL, "documents").select("doc_id", "text").collect() if len(r["text"]) < 4000]
    items = [r["text"] for r in table(spark, SF_SMALL, "benchmark").collect()]
    passage, base = lines(99, 9), words(5, 120, 100000)
    rows = plain + [(10**6, lines(1, 6) + "\n" + passage), (10**6 + 1, passage + "\n" + lines(3, 7)),
                    (10**6 + 2, " ".join(base)), (10**6 + 3, " ".join([*base[:60], "changed", *base[61:]])),
                    (10**6 + 4, " ".join(words(8, 30)) + " " + max(items, key=len))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    docs = P.line_dedup(spark, docs, SF_SMALL)
    want = brute_left(rows)
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == want and want[10**6 + 1] == lines(3, 7)
    docs = P.near_duplicates(spark, docs, SF_SMALL)
    want = {d: want[d] for d, _, c in brute_classes(list(want.items())) if d == c}
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == want and 10**6 + 3 not in want
    docs = P.decontamination(spark, docs, SF_SMALL)
    for d, text in list(want.items()):
        for item in items:
            s = shingles(item)
            k, w = len(next(iter(s))), text.encode().lower().split()
            if len(s & {tuple(w[j:j + k]) for j in range(len(w) - k + 1)}) / len(s) >= 0.75:
                want.pop(d, None)
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == want and 10**6 + 4 not in want

import hashlib

import corpus_pipeline
import numpy as np
from bibspark.llm import quality
from bibspark.llm.common import table

from ..conftest import SF
from . import cases


def test_pipeline_matches_brute_force(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    docs = [(d, t) for d, t in docs if cases.kept_by_quality(t, quality.THRESHOLDS, quality.STOP_WORDS)]
    classes = cases.jaccard(docs)
    docs = [(d, t) for d, t in docs if classes[d][1] == d]
    hits = cases.leaks(docs, items)
    docs = [(d, t) for d, t in docs if not hits[d][1]]
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {}
    for d, t in docs:
        out, at = "", 0
        for _, s, e in cases.secret_spans(t):
            out, at = (out + t[at:s] + "[secret]" if s >= at else out), max(at, e)
        t = out + t[at:]
        ids = lib.encode(t, add_special_tokens=False).ids
        expected[d] = (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows} == expected
    assert all(len(r["ids"]) == 4 * r["n_tokens"] and hashlib.sha256(r["ids"]).hexdigest() == r["ids_sha256"] for r in rows)


def test_stages_keep_the_columns_and_stand_hard_rows(spark):
    frame = cases.frame(spark, [*cases.hard_docs(), (None, "the and of it " + " ".join(f"v{i}" for i in range(40)))])
    for docs in (frame, frame.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            out.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()


def test_rows_without_an_own_id_are_told_apart(spark):
    from bibspark.llm import decontaminate, secrets

    masks = [(None, 'a token = "abcdef123456" z'), (None, "plain text that has no secret and stays as it is"), (None, 'other words first, then secret: "zyx987654321" end'), (7, "seven"), (7, "password=hunter2hunter2 in the other seven"), (7, "seven")]
    got = sorted(r["text"] for r in secrets.redact(cases.frame(spark, masks)).collect())
    assert got == sorted(["a [secret]\" z", masks[1][1], "other words first, then [secret]\" end", "seven", "[secret] in the other seven", "seven"])

    passage = " ".join(f"p{i}" for i in range(12))
    leaks = [(None, "x " + passage), (None, "clean one"), (None, "clean two"), (3, passage + " y"), (3, "clean three"), (4, None)]
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    frame = cases.frame(spark, leaks)
    for small in (1_000_000, 0):
        assert sorted(str(r["text"]) for r in decontaminate.clean(frame, items, small=small).collect()) == ["None", "clean one", "clean three", "clean two"]
    assert sorted((str(r["doc_id"]), r["n_words"]) for r in decontaminate.report(frame, items).where("ranges is not null").collect()) == [("3", 13), ("None", 13)]
    assert decontaminate.report(frame, items).count() == len(leaks)
    spans = [(r["text"] or "").split() for r in decontaminate.clean(frame, items, mode="spans").collect()]
    assert sorted(spans) == [[], ["clean", "one"], ["clean", "three"], ["clean", "two"], ["x"], ["y"]]


def test_one_row_of_each_class_stays(spark):
    texts = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "abcd"}
    near = texts["b"] + " more"
    docs = [(None, texts["a"]), (None, texts["a"]), (5, texts["b"]), (5, texts["b"]), (None, near), (6, near), (8, texts["c"]), (8, texts["d"]), (9, texts["d"]), (None, ""), (None, None)]
    out = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, cases.frame(spark, docs), SF).collect()]
    assert sorted(map(str, out)) == sorted(map(str, [(None, texts["a"]), (5, texts["b"]), (8, texts["c"]), (8, texts["d"]), (None, ""), (None, None)]))
